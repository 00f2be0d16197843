"""Exact top-k search by inner product over an impact-ordered index, scored segment by segment.

A component x becomes floor(scale * x). The index cuts the vectors into blocks; in a block each dimension's values are
quantised into ``LEVELS`` levels, and a posting segment lists the rows of one level, with the least and the greatest
value in it. For a query the impact of a segment is what its rows can add at most: the query's component times the
greatest value (the least one for a negative component), less what the dimension's weakest segment adds anyway.

A query processes the segments of all dimensions by descending impact and adds each impact to the accumulators of its
rows. What a row can still gain is bounded by the next impact of every dimension. From time to time the best accumulators
are scored exactly: the k-th such score is a bar, and rows whose accumulator and open gain stay below it are no members.
Processing stops only when so few rows can be members that they are all scored exactly; ties at the bar stay in. If that
never happens, all segments are processed, and rows are bounded by their quantised scores.

Queries are dealt in parts and met with every block: tasks hold a block and a part of bounded sizes. Each block gives
its k best for a query, the k best of which remain.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; of the others the most
frequent length decides (the longer of two as frequent), and others take no part; a row with a null id is a candidate
(after all others in ties) but no query; rows with the query's own id are not its candidates, and each row that repeats
is a candidate or a query of its own; fewer candidates than k give all; components beyond +-2^b (b = 27 at 64
dimensions, so that scores fit 64 bits) count as that bound; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written
from .vector_codes import most, to_integers, usable

K, SCALE, LEVELS = 5, 256, 16
#: Numbers in a block of the index, so that it has 16,384 rows of 64 dimensions, and queries in a part.
BLOCK_NUMBERS, PART = 1 << 20, 4096
#: The bar is looked at when the open gain has fallen to these shares of its start.
LOOKS = (0.1, 0.03)
#: Rows that are scored exactly at once: this many, or this share of a block.
FEW, FEW_SHARE = 64, 1 / 64


class Block:
    """The posting segments of a block of vectors (n x d, integers), by dimension and level."""

    #: What the written index keeps of a block, beside its ids: rows by dimension in the order of levels, where the levels end, and their extremes.
    STORED = {"vectors": np.int32, "postings": np.int32, "ends": np.int32, "least": np.int32, "greatest": np.int32}

    def __init__(self, **arrays: np.ndarray) -> None:
        self.vectors, self.postings, self.ends, self.least, self.greatest = (arrays[c].astype(np.int64) for c in self.STORED)
        self.starts = np.c_[np.zeros(len(self.ends), np.int64), self.ends[:, :-1]]
        self.used = self.ends > self.starts

    @classmethod
    def of(cls, vectors: np.ndarray, levels: int = LEVELS) -> Block:
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        level = (vectors - low) // ((high - low) // levels + 1)
        postings = np.argsort(level, axis=0, kind="stable").T
        sizes = np.stack([np.bincount(column, minlength=levels) for column in level.T])
        ends = np.cumsum(sizes, axis=1)
        least, greatest = np.zeros_like(ends), np.zeros_like(ends)
        for d, l in zip(*np.nonzero(sizes)):
            held = vectors[postings[d, ends[d, l] - sizes[d, l] : ends[d, l]], d]
            least[d, l], greatest[d, l] = held.min(), held.max()
        return cls(vectors=vectors, postings=postings, ends=ends, least=least, greatest=greatest)

    @classmethod
    def read(cls, row: dict[str, bytes], dim: int) -> Block:
        held = {c: np.frombuffer(row[c], kind) for c, kind in cls.STORED.items()}
        return cls(**{c: x.reshape(-1, dim) if c == "vectors" else x.reshape(dim, -1) for c, x in held.items()})

    def stored(self) -> dict[str, bytes]:
        return {c: getattr(self, c).astype(kind).tobytes() for c, kind in self.STORED.items()}

    def segments(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """(dimension, level, impact, open gain after it) of the segments by descending impact, and what every row has at least."""
        value = np.where(query[:, None] > 0, self.greatest, self.least) * query[:, None]
        floor = np.where(self.used, value, np.iinfo(np.int64).max).min(axis=1)
        impact = np.where(self.used, value - floor[:, None], 0)
        dims, levels = np.nonzero(impact)
        gains = impact[dims, levels]
        order = np.lexsort((dims, -gains))
        dims, levels, gains = dims[order], levels[order], gains[order]
        # a dimension's open gain is the impact of its next segment
        by_dim = np.argsort(dims, kind="stable")
        after = np.zeros(len(gains), np.int64)
        same = dims[by_dim][1:] == dims[by_dim][:-1]
        after[by_dim[:-1][same]] = gains[by_dim[1:][same]]
        start = int(impact.max(axis=1).sum())
        return dims, levels, gains, start - np.cumsum(gains - after), int(floor.sum())

    def top(self, query: np.ndarray, k: int, own: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, scores) of the k best rows outside ``own``, ties to the smaller of ``ids``; and the number of segments processed."""
        n = len(self.vectors)
        dims, levels, gains, open_gain, base = self.segments(query)
        total = np.full(n, base, np.int64)
        k = min(k, n - len(own))
        if k <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        few = max(FEW, int(n * FEW_SHARE), k)
        whole = open_gain[0] + gains[0] if len(gains) else 0
        stops = np.unique(np.r_[np.searchsorted(-open_gain, [-whole * share for share in LOOKS]) + 1, len(gains)])
        done = 0
        for stop in np.minimum(stops, len(gains)):
            for i in range(done, stop):
                d, l = dims[i], levels[i]
                total[self.postings[d, self.starts[d, l] : self.ends[d, l]]] += gains[i]
            done = stop
            left = int(open_gain[done - 1]) if done else 0
            total[own] = np.iinfo(np.int64).min // 2
            likely = np.argpartition(-total, k - 1)[:k]
            bar = (self.vectors[likely] @ query).min()
            members = np.flatnonzero(total + left >= bar)
            if len(members) <= few or done == len(gains):
                break
        scores = self.vectors[members] @ query
        best = np.lexsort((ids[members], -scores))[:k]
        return members[best], scores[best], int(done)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def search(vectors: DataFrame, asks: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: float = SCALE, block_rows: int | None = None, part: int = PART) -> DataFrame:
    """(query_id, rank, the id, score): the k rows with the highest inner products for each row for which ``asks`` holds."""
    if vectors.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("ids are integers")
    kept = usable(vectors, vector_col)
    lengths = kept.groupBy(F.size(vector_col).alias("dim")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("dim").desc()).first()
    dim, n = (lengths.dim, lengths.n) if lengths else (1, 0)
    block_rows = block_rows or max(64, BLOCK_NUMBERS // max(dim, 1))
    bound = most(max(dim, 1))
    rows = kept.where(F.size(vector_col) == dim).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks"))
    rows = written(rows.withColumn("place", F.monotonically_increasing_id()), "topk-rows")
    asked = rows.where("asks AND id IS NOT NULL").select("place", "id", "vector")
    n_parts, n_blocks = -(-asked.count() // part), max(1, -(-n // block_rows))
    deal = lambda many: F.pmod(F.xxhash64("place"), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(max(many, 1) - 1)))
    index = written(rows.select(deal(n_blocks).alias("block"), "id", "vector").groupBy("block").applyInArrow(_indexed(dim, scale, bound), _INDEX), "topk-index")
    left = index.withColumn("part", every(n_parts)).groupBy("block", "part")
    right = asked.withColumn("part", deal(max(n_parts, 1))).withColumn("block", every(n_blocks)).groupBy("block", "part")

    def run(block: pa.Table, queries: pa.Table) -> pa.Table:
        found: dict[str, list[np.ndarray]] = {c: [] for c in ("place", "query_id", "vec_id", "score")}
        nameless: list[np.ndarray] = []
        if block.num_rows and queries.num_rows:
            row = block.to_pylist()[0]
            ids, null, held = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nameless"], np.bool_), Block.read(row, dim)
            ranked = np.where(null, np.iinfo(np.int64).max, ids)
            by_id = np.argsort(ranked, kind="stable")
            by_id = by_id[~null[by_id]]
            values = to_integers(_matrix(queries["vector"], dim), scale, bound)
            for place, name, query in zip(queries["place"].to_numpy(), queries["id"].to_numpy(), values):
                first, last = np.searchsorted(ids[by_id], name, "left"), np.searchsorted(ids[by_id], name, "right")
                best, scores, _ = held.top(query, k, by_id[first:last], ranked)
                for c, x in (("place", np.full(len(best), place)), ("query_id", np.full(len(best), name)), ("vec_id", ids[best]), ("score", scores)):
                    found[c].append(x)
                nameless.append(null[best])
        columns = {c: np.concatenate(x) if x else np.zeros(0, np.int64) for c, x in found.items()}
        missing = np.concatenate(nameless) if nameless else np.zeros(0, bool)
        arrays = [pa.array(x, pa.int64(), mask=missing if c == "vec_id" else None) for c, x in columns.items()]
        return pa.Table.from_arrays(arrays, names=list(columns))

    found = left.cogroup(right).applyInArrow(run, "place long, query_id long, vec_id long, score long")
    order = Window.partitionBy("place").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")


_INDEX = "block int, ids binary, nameless binary, " + ", ".join(f"{c} binary" for c in Block.STORED)


def _indexed(dim: int, scale: float, bound: int):
    """A function that makes a block's rows one row of the index."""

    def run(table: pa.Table) -> pa.Table:
        ids = table["id"].combine_chunks()
        null, names = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        block = Block.of(to_integers(_matrix(table["vector"], dim), scale, bound))
        row = {"block": table["block"][0].as_py(), "ids": names.tobytes(), "nameless": null.tobytes(), **block.stored()}
        return pa.Table.from_arrays([pa.array([x], pa.int32() if c == "block" else pa.binary()) for c, x in row.items()], names=list(row))

    return run
