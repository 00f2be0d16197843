"""SimHash near-duplicates: 64-bit fingerprints, pigeonring candidates, the full Hamming check, connected components.

A fingerprint's bits are the majority of the bits of the hashes (XXH64, seed 42) of the text's word shingles. Copies
share a fingerprint, so that everything after the first aggregation works on distinct fingerprints.

Candidates: the 64 bits are a ring of ``segments`` pieces. If two fingerprints differ in at most t bits, then from some
piece on every chain of l consecutive pieces holds at most l * t / segments differences. The first pieces of such a
chain have a budget below one and are equal: they are the key of an equi-join, with the budgets of the longer chains
and the full Hamming distance as its condition. A bucket of more than ``crowd`` fingerprints is not paired: its members
are dealt by the 65 values within one bit of them, and members that share a value are linked to the smallest such
member. Two fingerprints share such a value just when they differ in at most two bits, so both ways keep every
connection. For t = 1 they are dealt by their values without one of the bits, which two share just when they differ in
no other. For t > 2 the members of a crowded bucket are paired block by block, with the square of their number.

With ``similarity`` also texts whose sets of shingles have at least that Jaccard similarity link, however far apart
their fingerprints are (at 0.8 they lie 10 bits apart on average and up to 20, where pigeonring is left with pieces of 3
bits as keys). Distinct texts are keyed by ``BANDS`` bands of ``ROWS`` minima of their shingles' hashes: a pair of
similarity s shares no key with probability (1 - s^5)^32, 3e-6 at 0.8. First each key's texts meet its hub alone (the
text with the most company, then others by hash) until rounds link little, so a group of copies needs no pairs within
it. What is left in different classes meets in blocks. A pair whose sketches (bytes of 384 minima) agree too rarely (4.7
standard deviations below the similarity, a chance of 1e-6) is dropped; every other one is confirmed on the exact sets.
Texts of one key that are alike but below the similarity are all compared, in numpy: that work grows with the square of
their number.

Defined cases: null and empty texts and texts of white space have fingerprint zero and link like any other; fewer words
than a shingle has are one shingle; very long texts are read whole; repeated rows stay; rows with a null id get the class of their text, whose number
comes from the ids that are not null; different texts under one id each have their own class; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import Scratch, written
from .components import connected_components

SEED = 42
#: Bands of minima for ``similarity``; the hashes of a shingle are its XXH64 times an odd number, plus another.
#: A sketch has a byte of each minimum of the bands and of as many others as make it ``SKETCH`` bytes.
BANDS, ROWS, SKETCH = 32, 5, 384
_FACTORS, _OFFSETS = np.random.default_rng(SEED).integers(0, 2**63, (2, SKETCH), dtype=np.uint64) * np.array([[2], [1]], np.uint64) + np.array([[1], [0]], np.uint64)
#: Rounds of hubs go on while they link this share of the pairs that they test.
HUB_ROUNDS, HUB_SHARE = 6, 0.05
#: Ids up to this many are broadcast (some 30 bytes each).
BROADCAST_IDS = 2_000_000
#: Texts of a block, and pairs that numpy compares at once.
BLOCK, AT_ONCE = 1024, 50_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b in (9, 10, 11, 12, 13) else b for b in range(256))


def shingles(text: str | None, width: int = 3) -> list[int]:
    """The hashes of the word shingles in order; none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split(b" ")
    words = [w for w in words if w]
    if not words:
        return []
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < width:
        return [digest(join(words), SEED)]
    return [digest(join(s), SEED) for s in zip(*(words[i:] for i in range(width)))]


def fingerprint(text: str | None, width: int = 3) -> int:
    """The signed 64-bit SimHash of a whole text."""
    return _majority(shingles(text, width))


def _majority(hashes: list[int]) -> int:
    if not hashes:
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65280):
        part = np.array(hashes[at : at + 65280], dtype="<u8")
        lanes = np.unpackbits(part.view(np.uint8), bitorder="little").view("<u8").reshape(-1, 8)  # a byte for each bit
        total += np.add.reduceat(lanes, np.arange(0, len(lanes), 255)).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = np.packbits(total * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", column: str = "simhash", width: int = 3) -> DataFrame:
    """``docs`` with the fingerprint as a long; a column of that name is replaced."""
    docs = docs.drop(column) if column in docs.columns else docs

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            values = pa.array((fingerprint(t.as_py(), width) for t in texts), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, column])

    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.LongType())])
    return docs.mapInArrow(run, schema)


def _node(hashes: list[int]) -> int:
    """The number of a text: of its shingles in order."""
    return int(np.array(xxhash.xxh3_64_intdigest(np.array(hashes, dtype="<u8").tobytes()), np.uint64).view(np.int64))


def minima(distinct: np.ndarray) -> np.ndarray:
    """The least value of each of the ``SKETCH`` hashes over a set of shingles."""
    least = np.full(SKETCH, 2**64 - 1, np.uint64)
    for at in range(0, len(distinct), 1024):
        least = np.minimum(least, (distinct[at : at + 1024, None] * _FACTORS + _OFFSETS).min(axis=0))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """The ``BANDS`` keys of the minima, signed."""
    return np.array([xxhash.xxh3_64_intdigest(row.tobytes(), seed=i) for i, row in enumerate(least[: BANDS * ROWS].reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _with_bands(docs: DataFrame, width: int) -> DataFrame:
    """``docs`` with the fingerprint, the text's number and number of distinct shingles, the band keys and a byte of each minimum instead of the text."""
    own = [c for c in docs.columns if c != "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, nodes, sizes, bands, sketches = [], [], [], [], []
            for text in batch.column(batch.schema.get_field_index("text")):
                hashes = shingles(text.as_py(), width)
                distinct = np.unique(np.array(hashes, np.uint64))
                least = minima(distinct) if hashes else None
                prints.append(_majority(hashes))
                nodes.append(_node(hashes))
                sizes.append(len(distinct))
                bands.append(band_keys(least) if hashes else None)
                sketches.append(least.astype(np.uint8).tobytes() if hashes else None)
            made = [pa.array(prints, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in own), *made], names=[*own, "simhash", "node", "size", "bands", "sketch"])

    fields = [docs.schema[c] for c in own]
    fields += [T.StructField("simhash", T.LongType()), T.StructField("node", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())]
    return docs.mapInArrow(run, T.StructType(fields))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(node, members): the distinct shingle hashes of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), width) for t in batch.column(batch.schema.get_field_index("text"))]
            sets = pa.array((np.unique(np.array(h, np.uint64)).view(np.int64) for h in found), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array((_node(h) for h in found), pa.int64()), sets], names=["node", "members"])

    return docs.select("text").mapInArrow(run, "node long, members array<long>")


def in_blocks(members: DataFrame, keys: list[str], name: str, size: int) -> DataFrame:
    """``members`` (with n, the rows of their key) dealt into blocks of about ``size``: ``side`` 0 and 1 of (keys, low, high).

    Each block meets itself (low = high, side 0) and every other block once.
    """
    cut = members.withColumn("blocks", F.ceil(F.col("n") / size).cast("int"))
    cut = cut.withColumn("block", F.pmod(F.xxhash64(name, F.lit(SEED)), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = (F.col("block") > F.col("other")).cast("int").alias("side")
    return cut.select(*(c for c in members.columns if c not in ("n", *keys)), *keys, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), side)


def _least_agreeing(similarity: float) -> int:
    """How many of the minima agree at least, but for a chance of about 1e-6, at this similarity."""
    n = SKETCH
    return int(n * similarity - 4.7 * (n * similarity * (1 - similarity)) ** 0.5)


def _agreeing(a: np.ndarray, b: np.ndarray, need: int) -> np.ndarray:
    """Whether rows of two tables of sketches agree in so many bytes."""
    return (a == b).sum(axis=1) >= need


def _sketches(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), SKETCH)


def plausible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sketches (node, sketch) allow the similarity."""
    need = _least_agreeing(similarity)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = _agreeing(_sketches(batch.column(2)), _sketches(batch.column(3)), need)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    joined = pairs.join(sketches.withColumnsRenamed({"node": "a", "sketch": "sketch_a"}), "a").join(sketches.withColumnsRenamed({"node": "b", "sketch": "sketch_b"}), "b")
    return joined.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def likely_pairs(dealt: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of ``in_blocks``' (key, low, high) from different classes whose sizes and sketches allow the similarity.

    A pair comes from its first common band alone: the first whose bytes of the sketches are equal.
    """
    need = _least_agreeing(similarity)

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        group = np.stack([rows[c].to_numpy() for c in ("key", "low", "high")], axis=1)
        side, node, comp, size, band = (rows[c].to_numpy() for c in ("side", "node", "comp", "size", "band"))
        sketch = _sketches(rows["sketch"])
        starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(node)])
        start, end = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
        # rows of side 0 come first: in a group of two blocks they meet side 1, in one of a block what comes after
        second = np.add.reduceat(side == 0, starts)
        first = np.where(group[:, 1] == group[:, 2], np.arange(len(node)) + 1, start + np.repeat(second, sizes))
        many = np.where(side == 0, np.maximum(end - first, 0), 0)
        edges = np.r_[0, np.cumsum(many)]
        at = 0
        while at < len(node):
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + AT_ONCE, side="right")) - 1)
            a = np.repeat(np.arange(at, to), many[at:to])
            b = np.arange(len(a)) - np.repeat(edges[at:to] - edges[at], many[at:to]) + first[a]
            at = to
            fits = (comp[a] != comp[b]) & (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-6)
            a, b = a[fits], b[fits]
            alike = _agreeing(sketch[a], sketch[b], need)
            a, b = a[alike], b[alike]
            common = (sketch[a] == sketch[b])[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).all(axis=2)
            here = common.argmax(axis=1) == band[a]
            x, y = node[a[here]], node[b[here]]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last group, of at most about two blocks, may go on in the next batch
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            if not len(rows):
                continue
            differs = np.zeros(len(rows), bool)
            for c in ("key", "low", "high"):
                values = rows[c].to_numpy()
                differs |= values != values[-1]
            cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
            if cut:
                yield from compare(rows[:cut])
            held = rows[cut:]
        if held is not None and len(held):
            yield from compare(held)

    narrow = dealt.select("key", "low", "high", "side", "band", "node", "comp", "size", "sketch")
    return narrow.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "side").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs of nodes whose sets have the similarity."""
    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("set_a")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("members").alias("set_b")), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(shared >= F.lit(similarity) * (F.size("set_a") + F.size("set_b") - shared) - 1e-6).select("a", "b")


def similar_links(docs: DataFrame, banded: DataFrame, id_col: str, similarity: float, width: int) -> DataFrame:
    """Edges (a, b) between the fingerprints of texts whose shingle sets have a Jaccard similarity of ``similarity``.

    They connect what links; within a class not every such pair has an edge of its own. ``banded`` is what
    ``_with_bands`` made of ``docs``; the texts of candidates alone are read again.
    """
    def on_its_own(df: DataFrame, tag: str) -> tuple[DataFrame, Scratch]:
        with Scratch(docs.sparkSession) as used:
            return written(df, tag), used

    texts, used_texts = on_its_own(banded.where("bands IS NOT NULL").groupBy("node").agg(F.min(id_col).alias("least"), F.min("simhash").alias("fp"), *(F.first(c).alias(c) for c in ("size", "bands", "sketch"))), "similar-texts")
    keyed = texts.select("node", "size", F.posexplode("bands").alias("band", "key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared, used_shared = on_its_own(keyed.join(counts, "key"), "similar-keys")
    company = written(shared.groupBy("node").agg(F.sum("n").alias("company")), "similar-company")
    members, used_members = on_its_own(shared.join(company, "node").withColumn("comp", F.col("node")), "similar-members")
    asked = written(texts.drop("bands").join(company.select("node"), "node"), "similar-asked")
    used_texts.drop()
    used_shared.drop()
    own = docs.select(F.col(id_col).alias("_bw_id"), "text")
    ids = written(asked.select(F.col("least").alias("_bw_id")).distinct(), "similar-ids")
    if ids.count() <= BROADCAST_IDS:  # else the texts are shuffled once
        ids = F.broadcast(ids)
    named = own.join(ids, "_bw_id", "left_semi").unionByName(own.where("_bw_id IS NULL"))
    sets = written(_sets(named, width).join(asked.select("node"), "node", "left_semi").dropDuplicates(["node"]), "similar-sets")
    links = tested = None

    def fresh(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where("a != b").distinct()
        return pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")

    for turn in range(HUB_ROUNDS):
        order = F.col("company") if turn == 0 else F.xxhash64("node", F.lit(turn))
        hubs = members.groupBy("key").agg(F.max(F.struct(order.alias("order"), "node", "size", "comp")).alias("hub"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
        hubs = written(hubs.select("key", "hub"), "similar-hubs")
        sizes = F.least("size", "hub.size") >= F.lit(similarity) * F.greatest("size", "hub.size") - 1e-6
        met = members.join(hubs, "key").where((F.col("comp") != F.col("hub.comp")) & sizes)
        met, used_met = on_its_own(fresh(met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))), "similar-met")
        pairs = written(plausible(met, asked.select("node", "sketch"), similarity), "similar-candidates")
        used_met.drop()
        found = written(_confirmed(pairs, sets, similarity), "similar-links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        n_found, n_tested = found.count(), pairs.count()
        if n_found:
            roots = connected_components(links, "a", "b")
            members = members.drop("comp").join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
            members, newer = on_its_own(members, "similar-members")
            used_members.drop()
            used_members = newer
        if n_found <= HUB_SHARE * n_tested:
            break
    apart = members.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    left = members.join(written(apart, "similar-apart"), "key", "left_semi").join(asked.select("node", "sketch"), "node")
    pairs = written(fresh(likely_pairs(in_blocks(left, ["key"], "node", BLOCK), similarity)), "similar-candidates")
    links = links.unionByName(_confirmed(pairs, sets, similarity))
    prints = asked.select("node", "fp")
    ends = links.join(prints.withColumnsRenamed({"node": "a", "fp": "fp_a"}), "a").join(prints.withColumnsRenamed({"node": "b", "fp": "fp_b"}), "b")
    return ends.where("fp_a != fp_b").select(F.least("fp_a", "fp_b").alias("a"), F.greatest("fp_a", "fp_b").alias("b")).distinct()


def _pieces(segments: int) -> list[tuple[int, int]]:
    """Offset and width of each piece of the ring."""
    ends = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _piece(bits: Column, piece: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(bits, piece[0]).bitwiseAND(F.lit((1 << piece[1]) - 1))


def _fits(differing: Column, at: Column, segments: int, distance: int) -> Column:
    """Whether the chains from piece ``at`` on keep to their budgets."""
    ring = _pieces(segments)
    chains = []
    for start in range(segments):
        held, ok = F.lit(0), F.lit(True)
        for length in range(1, segments + 1):
            held = held + F.bit_count(_piece(differing, ring[(start + length - 1) % segments]))
            ok = ok & (held <= length * distance // segments)
        chains.append((start, ok))
    chosen = F.lit(False)
    for start, ok in chains:
        chosen = F.when(at == start, ok).otherwise(chosen)
    return chosen


def close_pairs(prints: DataFrame, distance: int = 2, segments: int = 5, crowd: int = 64) -> DataFrame:
    """Edges (a, b), a < b, that connect the fingerprints of the column ``fp`` (distinct) within ``distance`` bits.

    They connect what is that near; inside crowded buckets not every near pair has an edge of its own.
    """
    if distance == 0:  # distinct fingerprints differ
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    ring = _pieces(segments)
    exact = next(n for n in range(segments, 0, -1) if n * distance < segments)  # pieces that must be equal
    keys = []
    for start in range(segments):
        key, width = F.lit(start).cast("long"), 3 if segments <= 8 else 6
        for i in range(exact):
            piece = ring[(start + i) % segments]
            key = F.shiftleft(key, piece[1]).bitwiseOR(_piece(F.col("fp"), piece))
            width += piece[1]
        assert width < 64
        keys.append(F.struct(F.lit(start).cast("byte").alias("at"), key.alias("key")))
    keyed = prints.select("fp", F.inline(F.array(*keys)))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(keyed.join(sizes, "key"), "simhash-buckets")
    few = members.where(F.col("n") <= crowd).select("key", "at", "fp", F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("side"))
    if distance > 2:
        few = few.unionByName(in_blocks(members.where(F.col("n") > crowd), ["key", "at"], "fp", crowd))
    a = few.where("side = 0").select("key", "low", "high", "at", F.col("fp").alias("a"))
    b = few.where("low = high OR side = 1").select("key", "low", "high", F.col("fp").alias("b"))
    differing = F.col("a").bitwiseXOR(F.col("b"))
    b = b.withColumnsRenamed({c: f"{c}_b" for c in ("key", "low", "high")})
    met = (F.col("key") == F.col("key_b")) & (F.col("low") == F.col("low_b")) & (F.col("high") == F.col("high_b"))
    once = (F.col("a") < F.col("b")) | (F.col("low") < F.col("high"))
    near = a.join(b, met & once & _fits(differing, F.col("at"), segments, distance) & (F.bit_count(differing) <= distance))
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if distance > 2:
        return near.distinct()
    many = members.where(F.col("n") > crowd).select("fp").distinct()
    bits = [F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)]
    if distance == 2:
        values = [F.struct(F.lit(0).alias("bit"), v.alias("value")) for v in (F.col("fp"), *(F.col("fp").bitwiseXOR(bit) for bit in bits))]
    else:
        values = [F.struct(F.lit(i).alias("bit"), F.col("fp").bitwiseAND(F.bitwise_not(bit)).alias("value")) for i, bit in enumerate(bits)]
    dealt = many.select("fp", F.inline(F.array(*values)))
    hubs = dealt.groupBy("bit", "value").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    linked = dealt.join(hubs, ["bit", "value"]).where("hub < fp").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    return near.unionByName(linked).distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str, distance: int, width: int, segments: int, crowd: int, similarity: float | None) -> tuple[DataFrame, DataFrame]:
    """``docs`` without the text, with ``simhash``; and (simhash, root, component_id), root naming the class."""
    narrow = docs.drop("component_id").select(*(c for c in docs.columns if c not in ("component_id", "simhash")))
    if similarity is None:
        marked = written(with_fingerprint(narrow, text_col, "simhash", width).drop(text_col), "simhash")
    else:
        slim = docs.select(F.struct(*(c for c in narrow.columns if c != text_col)).alias("own"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        banded = written(_with_bands(slim, width), "simhash")
        marked = banded.select("own.*", "simhash")
    with Scratch(docs.sparkSession) as used:
        prints = written(marked.groupBy(F.col("simhash").alias("fp")).agg(F.min(id_col).alias("least")), "simhash-distinct")
        edges = close_pairs(prints.select("fp"), distance, segments, crowd)
        if similarity is not None:
            edges = edges.unionByName(similar_links(slim, banded, "id", similarity, width)).distinct()
        roots = connected_components(written(edges, "simhash-edges"), "a", "b")
        classed = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        least = classed.groupBy("root").agg(F.min("least").alias("component_id"))
        of_print = classed.join(least, "root").select(F.col("fp").alias("simhash"), "root", "component_id")
    of_print = written(of_print, "simhash-classes")
    used.drop()
    return marked, of_print


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, width: int = 3, segments: int = 5, crowd: int = 64, similarity: float | None = None) -> DataFrame:
    """``docs`` with ``simhash`` (long) and ``component_id``: the smallest id reachable over fingerprints that link.

    With ``similarity`` texts of that Jaccard similarity (shingles of ``width`` words) link too. The text column is dropped before anything is shuffled; join by id, or see ``keep_first``, where it is needed.
    """
    marked, classes = _classes(docs, id_col, text_col, distance, width, segments, crowd, similarity)
    return marked.join(classes.drop("root"), "simhash")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, width: int = 3, segments: int = 5, crowd: int = 64, similarity: float | None = None) -> DataFrame:
    """``docs`` without near copies: of each class one row, that with the smallest id.

    Of several rows with that id in the class, the one with the smallest fingerprint and then the smallest text stays; rows
    with one id and texts of different classes stay apart. Rows with a null id are kept where their class has no other id.
    """
    with Scratch(docs.sparkSession) as used:
        marked, classes = _classes(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", distance, width, segments, crowd, similarity)
    rows = marked.groupBy("id", "simhash").agg(F.count("*").alias("n")).join(classes.select("simhash", "root"), "simhash")
    best = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "simhash")).alias("best")  # false comes before true
    rows = rows.join(rows.groupBy("root").agg(best), "root").select("id", "simhash", "n", (F.col("best.id").eqNullSafe(F.col("id")) & (F.col("best.simhash") == F.col("simhash"))).alias("stays"))
    rows = written(rows, "simhash-rows")
    by_id = rows.groupBy("id").agg(F.sum("n").alias("n"), F.max("stays").alias("stays"))
    odd = written(by_id.where("id IS NULL OR n > 1").select("id"), "simhash-odd")  # their rows are told apart by their texts
    gone = written(by_id.where("id IS NULL OR n > 1 OR NOT stays").where("id IS NOT NULL").select(F.col("id").alias("_bw_id")), "simhash-gone")
    stays = written(rows.where("stays").join(odd, rows["id"].eqNullSafe(odd["id"]), "left_semi").select("id", "simhash"), "simhash-stays")
    used.drop()
    held = docs.select(F.col(id_col).alias("_bw_id"), F.struct("*").alias("doc"))
    small = gone.count() <= BROADCAST_IDS  # else the texts are shuffled once
    kept = held.where("_bw_id IS NOT NULL").join(F.broadcast(gone) if small else gone, "_bw_id", "left_anti").select("doc.*")
    if odd.limit(1).count() == 0:
        return kept
    few = F.broadcast(odd) if odd.count() <= BROADCAST_IDS else odd
    again = held.join(few, F.col("_bw_id").eqNullSafe(few["id"]), "left_semi").select("doc", F.col("_bw_id").alias("id"), F.col(f"doc.{text_col}").alias("text"))
    again = with_fingerprint(again, "text", "simhash", width)
    same = again["id"].eqNullSafe(stays["id"]) & (again["simhash"] == stays["simhash"])
    first = again.join(stays, same, "left_semi").groupBy("id", "simhash").agg(F.min_by("doc", F.struct(F.col("text").isNotNull(), "text")).alias("doc"))
    return kept.unionByName(first.select("doc.*"))
