"""Benchmark decontamination with suffix arrays over shards of the training texts.

A shard is a run of whole documents of one task's input, about ``shard_words`` words. Its words become numbers (words
that no benchmark item has are zero and end every match), and the suffixes of its stretches of benchmark words are
sorted by prefix doubling. Every suffix of every benchmark item is then binary-searched in that array, all of them at
once and one word deeper each time; the interval left before a search fails is the longest verbatim match with all its
places. An occurrence never crosses documents, so shards need no exchange and the table is read once.

A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. A document
word inside any occurrence of a window is hit; a document with a hit is contaminated.

The benchmark is the stated query set: its items come to the driver in blocks of about ``block_mb`` of text, one after
another, and each block is broadcast and dropped again before the next; so the memory is that of one block, and a
benchmark of several blocks takes several passes. Defined cases: null and empty texts have no words; a null item id is written as the empty string;
repeated items count once; documents of any length are searched whole; repeated rows and null ids of documents stay as
they are; empty tables give no rows or no hits; other columns are kept, those with the names of results replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import written

#: Bytes of words stay (A-Z in lower case), all others become a space; in UTF-8 every byte of a non-ASCII letter stays.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


@dataclass
class Items:
    """A block of benchmark items, ready to be searched for."""

    names: list[str]
    texts: list[str]
    window: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        flat, starts, ends, item = [], [], [], []
        for n, text in enumerate(self.texts):
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            starts += range(len(flat), len(flat) + len(own))
            ends += [len(flat) + len(own)] * len(own)
            item += [n] * len(own)
            flat += own
        self.texts = []
        self.length = np.bincount(np.array(item, np.int64), minlength=len(self.names))
        self.deepest = int(self.length.max(initial=0))
        self.flat = np.array(flat + [0] * (self.deepest + 1), np.int64)
        self.start, self.end, self.item = (np.array(x, np.int64) for x in (starts, ends, item))
        self.first = np.zeros(len(self.names) + 1, np.int64)
        np.cumsum(self.length, out=self.first[1:])
        self.need = np.minimum(self.window, self.length)[self.item]  # words of a window of the suffix's item
        self.least = int(self.need.min(initial=self.window))


def suffix_array(text: np.ndarray, deepest: int) -> np.ndarray:
    """Places of non-zero words, sorted by the words from there on; ties beyond ``deepest`` words may stay unsorted."""
    rank, step, order = text.astype(np.int64), 1, None
    while True:
        after = np.zeros_like(rank)
        after[:-step or None] = rank[step:] if step < len(rank) else 0
        key = rank * (int(rank.max(initial=0)) + 1) + after
        order = np.argsort(key, kind="stable")
        held = key[order]
        fresh = np.empty(len(held), bool)
        fresh[:1] = True
        np.not_equal(held[1:], held[:-1], out=fresh[1:])
        dense = np.cumsum(fresh)
        rank = np.empty_like(dense)
        rank[order] = dense
        step *= 2
        if step >= deepest or step >= len(text) or (len(dense) and dense[-1] == len(dense)):
            return order[text[order] > 0]


def search(text: np.ndarray, order: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each suffix of the items: longest match, its interval of ``order``, and the interval at the window's depth."""
    n = len(items.start)
    low, high = np.zeros(n, np.int64), np.full(n, len(order), np.int64)
    longest = np.zeros(n, np.int64)
    at_low, at_high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    padded = np.concatenate([text, np.zeros(items.deepest + 1, text.dtype)])
    live = np.arange(n) if len(order) else np.arange(0)
    depth = 0
    while len(live):
        wanted = items.flat[items.start[live] + depth]
        bounds = []
        for right in (False, True):
            lo, hi = low[live].copy(), high[live].copy()
            while (open_ := lo < hi).any():
                mid = (lo + hi) >> 1
                seen = padded[order[np.minimum(mid, len(order) - 1)] + depth]
                go = open_ & ((seen <= wanted) if right else (seen < wanted))
                lo, hi = np.where(go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
            bounds.append(lo)
        found = bounds[0] < bounds[1]
        live, depth = live[found], depth + 1
        low[live], high[live] = bounds[0][found], bounds[1][found]
        longest[live] = depth
        full = live[items.need[live] == depth]
        at_low[full], at_high[full] = low[full], high[full]
        live = live[items.start[live] + depth < items.end[live]]
    return longest, low, high, at_low, at_high


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after another, and which range each is of."""
    sizes = high - low
    which = np.repeat(np.arange(len(low)), sizes)
    return np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[which], which


class Shard:
    """Whole documents as one array of words."""

    def __init__(self, texts: list[list[bytes]]) -> None:
        self.texts = texts
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])

    def look(self, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, Items]:
        """Numbers of the kept words, with a zero between stretches; the place of each in the shard; the suffix array."""
        numbers = np.zeros(int(self.first[-1]) + len(self.texts) + 1, np.int64)
        places = np.full(len(numbers), -1, np.int64)
        get, at = items.vocabulary.get, 0
        for words_, first in zip(self.texts, self.first):
            if words_:
                numbers[at : at + len(words_)] = np.fromiter(map(get, words_, repeat(0)), np.int64, len(words_))
                places[at : at + len(words_)] = np.arange(first, first + len(words_))
            at += len(words_) + 1
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (numbers > 0).view(np.int8), [0]])))
        begins, ends = edges[::2], edges[1::2]
        long_ = ends - begins >= items.least
        index, _ = _ranges(begins[long_], ends[long_] + 1)  # with the zero that ends a stretch
        return numbers[index], places[index], suffix_array(numbers[index], items.deepest)


def scan(texts: list[list[bytes]], items: Items) -> tuple[np.ndarray, list[set[str]]]:
    """Which words of a shard are hit, and per document the ids of the items with occurring windows."""
    shard = Shard(texts)
    cover = np.zeros(int(shard.first[-1]) + 1, np.int64)
    named: list[set[str]] = [set() for _ in texts]
    text, places, order = shard.look(items)
    if len(order):
        _, _, _, low, high = search(text, order, items)
        some = np.flatnonzero(high > low)
        # equal windows have equal intervals: the places of each are taken once, and each keeps its items
        keys = np.stack([low[some], items.need[some]], axis=1)
        kinds, first, of = np.unique(keys, axis=0, return_index=True, return_inverse=True)
        of = of.reshape(-1)
        at, which = _ranges(kinds[:, 0], high[some][first])
        where, size = places[order[at]], kinds[which, 1]
        np.add.at(cover, where, 1)
        np.add.at(cover, where + size, -1)
        doc = np.searchsorted(shard.first, where, side="right") - 1
        owners: list[set[str]] = [set() for _ in kinds]
        for kind, item in zip(of, items.item[some]):
            owners[kind].add(items.names[item])
        for d, kind in np.unique(np.stack([doc, which], axis=1), axis=0) if len(doc) else ():
            named[d] |= owners[kind]
    return np.cumsum(cover)[:-1] > 0, named


def stretches(hit: np.ndarray) -> list[tuple[int, int]]:
    """First and last (exclusive) of each stretch of hit words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


class ItemBlocks:
    """The distinct items as blocks of about ``block_mb`` of text; the driver and each worker hold one block at a time."""

    def __init__(self, benchmark: DataFrame, id_col: str, text_col: str, window: int, block_mb: float) -> None:
        self.spark, self.window = benchmark.sparkSession, window
        rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.coalesce(text_col, F.lit("")).alias("text")).distinct()
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.count = max(1, int(np.ceil(size / (block_mb * 1e6))))
        self.rows = written(rows, "benchmark-items") if self.count > 1 else rows

    def block(self, n: int):
        """A broadcast."""
        rows = self.rows.where(F.pmod(F.xxhash64("name", "text"), F.lit(self.count)) == n).collect()
        return self.spark.sparkContext.broadcast(Items([r.name for r in rows], [r.text for r in rows], self.window))

    def each(self, of) -> DataFrame:
        """The rows that ``of`` (broadcast, number) gives for all blocks; with several, those of a block are written before the next one."""
        if self.count == 1:
            return of(self.block(0), 0)
        found = None
        for n in range(self.count):
            block = self.block(n)
            part = written(of(block, n), "benchmark-block")
            block.destroy()
            found = part if found is None else found.unionByName(part)
        return found


RESULTS = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType())]


def _shards(batch: pa.RecordBatch, text_col: str, shard_words: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The batch's documents in shards, each with the number of its first row."""
    first, held, size = 0, [], 0
    for n, text in enumerate(batch.column(batch.schema.get_field_index(text_col))):
        own = words(text.as_py())
        if held and size + len(own) > shard_words:
            yield first, held
            first, held, size = n, [], 0
        held.append(own)
        size += len(own)
    if held:
        yield first, held


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep_text: bool = True, window: int = 10, shard_words: int = 1_000_000, block_mb: float = 32) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 (of the sorted ids, comma-joined) and contaminated.

    A benchmark of several blocks takes a pass over the documents (a copy of them is written) for each.
    """
    blocks = ItemBlocks(benchmark, item_id, item_text, window, block_mb)
    docs = docs.drop(*(c for c, _ in RESULTS))
    kept = [f for f in docs.schema.fields if keep_text or f.name != text_col]
    if blocks.count > 1:
        return _mark_by_blocks(docs, blocks, text_col, kept, shard_words)
    block = blocks.block(0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, named = [], [], []
            for _, texts in _shards(batch, text_col, shard_words):
                hit, names = scan(texts, block.value)
                sizes = np.array([len(t) for t in texts])
                sums = np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], np.cumsum(sizes)])]
                n_words += sizes.tolist()
                n_hit += np.diff(sums).tolist()
                named += names
            digests = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in named]
            columns = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in named], pa.int64()), pa.array(digests, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_())]
            own = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays(own + columns, names=[f.name for f in kept] + [c for c, _ in RESULTS])

    return docs.mapInArrow(run, T.StructType(kept + [T.StructField(*r) for r in RESULTS]))


def _mark_by_blocks(docs: DataFrame, blocks: ItemBlocks, text_col: str, kept: list[T.StructField], shard_words: int) -> DataFrame:
    """``mark_contaminated`` with a pass for each block: stretches of hit words and ids meet by the document's row number."""
    numbered = written(docs.select(F.struct(*(f.name for f in kept)).alias("doc"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")), "decontamination-docs")

    def hits(block, n: int) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, found = batch.column(1).to_pylist(), []
                for first, texts in _shards(batch, "text", shard_words):
                    hit, named = scan(texts, block.value)
                    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
                    # the first block's pass counts the words of every document
                    found += [(rows[first + i], len(t), [{"first": a, "last": b} for a, b in stretches(hit[at[i] : at[i + 1]])], sorted(named[i])) for i, t in enumerate(texts) if named[i] or n == 0]
                columns = list(zip(*found)) or [()] * 4
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["row", "n_words", "hit", "named"])

        return numbered.select("text", "row").mapInArrow(run, "row long, n_words long, hit array<struct<first:long,last:long>>, named array<string>")

    # a row for each block that hits the document, so at most one for each block
    met = blocks.each(hits).groupBy("row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hit"))).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("named")))).alias("named"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(F.greatest(acc["at"], x["last"]).alias("at"), (acc["n"] + F.greatest(x["last"] - F.greatest(acc["at"], x["first"]), F.lit(0))).alias("n"))
    n_hit = F.aggregate("hit", start, step)["n"]
    counts = met.select("row", "n_words", n_hit.alias("n_hit"), F.size("named").cast("long").alias("n_items"), F.sha2(F.array_join("named", ","), 256).alias("items_sha256"))
    return numbered.select("row", "doc").join(counts, "row").select("doc.*", *(c for c, _ in RESULTS[:-1]), (F.col("n_hit") > 0).alias("contaminated"))


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, shard_words: int = 1_000_000, block_mb: float = 32) -> DataFrame:
    """The longest verbatim matches that cannot be extended to the left: document and item, first word in each, words.

    One row for each place of a longest match of an item's suffix that has at least a window's words.
    """
    blocks = ItemBlocks(benchmark, item_id, item_text, window, block_mb)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType)] + [T.StructField(c, t) for c, t in (("item_id", T.StringType()), ("doc_word", T.LongType()), ("item_word", T.LongType()), ("n_words", T.LongType()))])

    def matches(block, n: int) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                for first, texts in _shards(batch, "text", shard_words):
                    shard = Shard(texts)
                    items = block.value
                    text, places, order = shard.look(items)
                    longest, low, high, _, _ = search(text, order, items)
                    some = np.flatnonzero((longest >= items.need) & (longest > 0))
                    at, which = _ranges(low[some], high[some])
                    suffix, spot = some[which], order[at]
                    begin = items.first[items.item[suffix]]
                    before = np.where(items.start[suffix] > begin, items.flat[items.start[suffix] - 1], -1)
                    left = np.where(spot > 0, text[np.maximum(spot, 1) - 1], -2)
                    suffix, spot = suffix[before != left], spot[before != left]
                    where = places[spot]
                    doc = np.searchsorted(shard.first, where, side="right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(doc + first)), pa.array([items.names[i] for i in items.item[suffix]], pa.string()), pa.array(where - shard.first[doc]), pa.array(items.start[suffix] - items.first[items.item[suffix]]), pa.array(longest[suffix])],
                        names=schema.names,
                    )

        return source.mapInArrow(run, schema)

    return blocks.each(matches)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents without a hit, with their own columns whatever their names."""
    held = docs.select(F.struct("*").alias("doc"), F.col(text_col).alias("text"))
    return mark_contaminated(held, benchmark, keep_text=False, **options).where(~F.col("contaminated")).select("doc.*")
