"""Product codes of vectors: integer Lloyd rounds on each part of a vector, with triangle-inequality pruning by Elkan.

A component x becomes floor(scale * x); a vector is cut into equal consecutive parts, and each part position has a
codebook of its own. A codebook starts as that part of the vectors with the smallest ids. A round assigns each part to
its nearest entry (squared Euclidean distance in integers, ties to the lower index) and then replaces each entry by the
floor of its parts' mean; entries without parts stay.

Between rounds a written table keeps, beside each vector and its codes, an upper bound of every part's distance to its
entry and a lower bound of its distance to every entry. After an update the bounds are shifted by how far the entries
moved. An entry is skipped only if its lower bound, or half its distance from the part's own entry, is strictly above
the upper bound; whatever is left, ties included, is compared in integers. Bounds are rounded to the safe side: an upper
one is a float, a lower one a byte on a scale of eighths of an octave (zstd takes them to about half).

What comes to the driver are the sums of the codebooks' entries (entries x dimension numbers) and the first vectors.
Each pass reads the table before it, so that a lost executor repeats its own part of one pass.

Defined cases: rows whose vector is null, or holds null or non-finite components, are dropped; of the others the most
frequent length decides (the longer of two as frequent), and rows of another length, or all if it isn't a positive
multiple of the number of parts, are dropped; fewer rows than entries give as many entries as rows; rows with a null id
come after all others, rows with the same id are ordered by their vectors, and repeated rows count each; components
beyond +-2^b (b = 27 at 64 dimensions, so that no sum of squares leaves 64 bits) count as that bound; an empty table
gives no rows and empty codebooks; other columns are kept, but input columns named as the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import Scratch, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: What a byte of a lower bound stands for: nothing, then eighths of an octave from 2^0 on.
_LEVELS = np.r_[0.0, 2.0 ** (np.arange(255) / 8)]
#: Numbers that a block of comparisons may hold.
AT_ONCE = 2_000_000
#: Labels with more than this share of all rows are joined by a broadcast of at most its inverse rows.
HEAVY = 1e-3


def _above(x: np.ndarray) -> np.ndarray:
    return x * (1 + 1e-14)


def _below(x: np.ndarray) -> np.ndarray:
    return x * (1 - 1e-14)


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """The rows whose vector has finite components alone."""
    return vectors.where(F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: F.abs(x.cast("double")) < float("inf")))


def most(dim: int) -> int:
    """The largest component that keeps the sum of ``dim`` squared differences below 2^63."""
    return 1 << (61 - max(dim - 1, 1).bit_length()) // 2


def to_integers(values: np.ndarray, scale: float, bound: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values.astype(np.float64) * scale), -bound, bound).astype(np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each entry, in integers."""
    return ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)


def entry_distances(book: np.ndarray) -> np.ndarray:
    """Half the distance between any two entries of a part, at most: (parts, entries, entries)."""
    return np.stack([_below(np.sqrt(distances(entries, entries).astype(np.float64))) / 2 for entries in book])


def first_assignment(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code, squared distance, upper bound, lower bounds) of the rows of a part, all distances computed."""
    found = distances(x, entries)
    code = found.argmin(axis=1)
    squared = found[np.arange(len(x)), code]
    root = np.sqrt(found.astype(np.float64))
    return code, squared, _above(root[np.arange(len(x)), code]), _below(root)


def next_assignment(x: np.ndarray, entries: np.ndarray, half: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(code, upper bound, lower bounds, comparisons) of the rows of a part from shifted bounds."""
    rows = np.arange(len(x))

    def left(of: np.ndarray) -> np.ndarray:
        open_ = (lower[of] <= upper[of, None]) & (half[code[of]] <= upper[of, None])
        open_[np.arange(len(of)), code[of]] = False
        return open_

    loose = rows[left(rows).any(axis=1)]
    own = ((x[loose] - entries[code[loose]]) ** 2).sum(axis=1)
    upper[loose] = _above(np.sqrt(own.astype(np.float64)))
    lower[loose, code[loose]] = _below(np.sqrt(own.astype(np.float64)))
    at, entry = np.nonzero(left(loose))
    squared = ((x[loose[at]] - entries[entry]) ** 2).sum(axis=1)
    lower[loose[at], entry] = _below(np.sqrt(squared.astype(np.float64)))
    best, chosen = own.copy(), code[loose].copy()
    # entries come in order, so the first of equal ones has the lower index
    table = np.full((len(loose), len(entries)), np.iinfo(np.int64).max)
    table[at, entry] = squared
    table[np.arange(len(loose)), chosen] = own
    if len(loose):
        chosen = table.argmin(axis=1)
        best = table[np.arange(len(loose)), chosen]
    code[loose] = chosen
    upper[loose] = _above(np.sqrt(best.astype(np.float64)))
    return code, upper, lower, len(loose) + len(at)


def _slices(n: int, width: int) -> Iterator[slice]:
    step = max(1, AT_ONCE // max(width, 1))
    return (slice(at, min(at + step, n)) for at in range(0, n, step))


def _first_pass(kept: DataFrame, book: np.ndarray, scale: float) -> DataFrame:
    """(own, vector, codes, upper, lower) with all distances computed once."""
    parts, entries, width = book.shape
    dim = parts * width

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = to_integers(_matrix(batch.column(1), dim), scale, most(dim))
            n = len(values)
            codes, upper, lower = np.zeros((n, parts), np.uint8), np.zeros((n, parts)), np.zeros((n, parts, entries), np.uint8)
            for p in range(parts):
                for s in _slices(n, entries * width):
                    code, _, above, below = first_assignment(values[s, p * width : (p + 1) * width], book[p])
                    codes[s, p], upper[s, p], lower[s, p] = code, above, _level(below)
            yield _packed(batch.column(0), values, codes, upper, lower)

    return kept.select("own", "vector").mapInArrow(run, _schema(kept))


def _next_pass(table: DataFrame, book: np.ndarray, moved: np.ndarray) -> DataFrame:
    """The table with codes and bounds of the new codebooks; ``moved`` (parts, entries) is how far each entry moved, at least."""
    parts, _, width = book.shape
    half = entry_distances(book)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _packed(batch.column(0), *_reassigned(batch, book, half, moved)[:4])

    return table.mapInArrow(run, table.schema)


def _reassigned(batch: pa.RecordBatch, book: np.ndarray, half: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, ...]:
    parts, entries, width = book.shape
    values = _matrix(batch.column(1), parts * width).astype(np.int64)
    n = len(values)
    codes = _bytes(batch.column(2), parts).copy()
    upper = _bytes(batch.column(3), 4 * parts).view("<f4").astype(np.float64)
    lower = _bytes(batch.column(4), parts * entries).reshape(n, parts, entries).copy()
    for p in range(parts):
        for s in _slices(n, entries * width):
            code = codes[s, p].astype(np.int64)
            above = _above(upper[s, p] + moved[p][code])
            below = np.maximum(_below(_LEVELS[lower[s, p]] - moved[p]), 0.0)
            code, above, below, _ = next_assignment(values[s, p * width : (p + 1) * width], book[p], half[p], code, above, below)
            codes[s, p], upper[s, p], lower[s, p] = code, above, _level(below)
    return values, codes, upper, lower


def _last_pass(table: DataFrame, book: np.ndarray, moved: np.ndarray) -> DataFrame:
    """(own, code, error) of the final codebooks."""
    parts, _, width = book.shape
    half = entry_distances(book)
    which = np.arange(parts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, codes, _, _ = _reassigned(batch, book, half, moved)
            error = np.zeros(len(values), np.int64)
            for s in _slices(len(values), parts * width):
                error[s] = ((values[s].reshape(-1, parts, width) - book[which, codes[s]]) ** 2).sum(axis=(1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(codes), pa.array(error)], names=["own", "code", "error"])

    return table.mapInArrow(run, T.StructType([table.schema["own"], T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())]))


def _level(below: np.ndarray) -> np.ndarray:
    return (np.searchsorted(_LEVELS, below, side="right") - 1).astype(np.uint8)


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(bytearray().join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _binary(rows: np.ndarray) -> pa.Array:
    flat, width = rows.tobytes(), rows.shape[1] * rows.itemsize
    return pa.array([flat[i : i + width] for i in range(0, len(flat), width)], pa.binary())


def _packed(own: pa.Array, values: np.ndarray, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    vector = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel().astype(np.int32)))
    single = upper.astype("<f4")
    single = np.where(single < upper, np.nextafter(single, np.float32(np.inf)), single)
    columns = [own, vector, _binary(codes), _binary(single), _binary(lower.reshape(len(lower), -1))]
    return pa.RecordBatch.from_arrays(columns, names=["own", "vector", "codes", "upper", "lower"])


def _schema(kept: DataFrame) -> T.StructType:
    binary = [T.StructField(c, T.BinaryType()) for c in ("codes", "upper", "lower")]
    return T.StructType([kept.schema["own"], T.StructField("vector", T.ArrayType(T.IntegerType())), *binary])


def _updated(table: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebooks with each entry at the floor of its parts' mean."""
    parts, entries, width = book.shape
    cells = np.arange(parts) * entries

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _matrix(batch.column(0), parts * width).astype(np.int64).reshape(-1, width)
            cell = (_bytes(batch.column(1), parts).astype(np.int64) + cells).ravel()
            order = np.argsort(cell, kind="stable")
            here, starts = np.unique(cell[order], return_index=True)
            total[here] += np.add.reduceat(values[order], starts, axis=0)
            count += np.bincount(cell, minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, width)), pa.array(np.tile(np.arange(width), len(used))), pa.array(total[used].ravel()), pa.array(np.repeat(count[used], width))],
            names=["cell", "place", "total", "n"],
        )

    sums = table.select("vector", "codes").mapInArrow(run, "cell long, place long, total long, n long")
    new = book.reshape(parts * entries, width).copy()
    for row in sums.groupBy("cell", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        new[row.cell, row.place] = row.total // row.n
    return new.reshape(book.shape)


def _moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    return _above(np.sqrt(((new - old) ** 2).sum(axis=2).astype(np.float64)))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``vectors`` without the vector, with ``code`` (a byte for each part) and ``error`` (squared distance to what the code stands for); and the codebooks (parts, entries, numbers)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte: 1 to 256 entries")
    kept = usable(vectors, vector_col)
    own = [c for c in vectors.columns if c not in (vector_col, "code", "error")]
    lengths = kept.groupBy(F.size(vector_col).alias("dim")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("dim").desc()).first()
    if lengths is None or lengths.dim < parts or lengths.dim % parts:
        kept, lengths = kept.where(F.lit(False)), None
    dim = lengths.dim if lengths else parts
    kept = kept.where(F.size(vector_col) == dim)
    seeds = kept.orderBy(F.col(id_col).asc_nulls_last(), vector_col).select(vector_col).limit(entries).collect()
    kept = kept.select(F.struct(*own).alias("own"), F.col(vector_col).alias("vector"))
    book = to_integers(np.array([row[0] for row in seeds], np.float64).reshape(-1, dim), scale, most(dim))
    book = np.ascontiguousarray(book.reshape(-1, parts, dim // parts).swapaxes(0, 1))
    if not len(seeds):
        return kept.select("own.*", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), book
    moved = None
    with Scratch(vectors.sparkSession) as before:
        table = written(_first_pass(kept, book, scale), "codes-bounds", compression="zstd")
    for turn in range(rounds):
        if turn:
            with Scratch(vectors.sparkSession) as used:
                table = written(_next_pass(table, book, moved), "codes-bounds", compression="zstd")
            before.drop()
            before = used
        new = _updated(table, book)
        book, moved = new, _moved(book, new)
    moved = moved if rounds else np.zeros(book.shape[:2])
    coded = written(_last_pass(table, book, moved), "codes")
    before.drop()
    return coded.select("own.*", "code", "error"), book


def reconstruct(coded: DataFrame, book: np.ndarray, scale: float = SCALE) -> DataFrame:
    """``coded`` with ``vector``: what the code stands for, in the input's scale."""
    parts = np.arange(book.shape[0])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _bytes(batch.column(batch.schema.get_field_index("code")), len(parts))
            values = (book[parts, codes].reshape(len(codes), -1) / scale).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.list_(pa.float64()))], names=[*batch.schema.names, "vector"])

    return coded.mapInArrow(run, T.StructType([*coded.schema.fields, T.StructField("vector", T.ArrayType(T.DoubleType()))]))


def with_group_sum(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows with an equal ``key`` (nulls together).

    Keys with many rows, a bounded number, are broadcast; the others meet by their key.
    """
    sums = written(df.groupBy(F.col(key).alias("_key")).agg(F.sum(value).alias(out), F.count("*").alias("_n")), "codes-sums")
    total = sums.agg(F.sum("_n")).first()[0] or 0
    heavy = sums.where(F.col("_n") > HEAVY * total).select("_key", F.col(out).alias("_heavy"))
    light = sums.where(F.col("_n") <= HEAVY * total).select("_key", out)
    marked = df.join(F.broadcast(heavy), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    frequent = marked.where("_heavy IS NOT NULL").withColumnRenamed("_heavy", out)
    rare = marked.where("_heavy IS NULL").drop("_heavy")
    return frequent.unionByName(rare.join(light, F.col(key).eqNullSafe(F.col("_key"))).drop("_key").select(*frequent.columns))
