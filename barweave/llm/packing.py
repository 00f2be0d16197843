"""Conflict-constrained best-fit packing of documents into training sequences.

Documents are dealt by a hash of their id into shards of about ``shard_docs``; a shard is packed by one task that holds
at most ``2 * shard_docs`` documents at a time (narrow rows, no text). Longest first, each piece looks among the open
bins, kept in the order of what room they have left, for the tightest one that fits: from the first bin with enough
room the search goes on to the next until a bin has neither the piece's source nor its duplicate cluster in its
bitmaps; if none is left a new bin opens. So no two pieces of a bin share a source or a cluster.

``pack`` places lengths; ``pack_texts`` gives the text of each piece too, so that the pieces of a bin by ``at`` are a
training sequence and those of a document, joined in order, its text.

A document of more than ``capacity`` units is cut: each full piece has a bin of its own and the rest is packed like a
short document. Defined cases: null and empty texts (length 0) take no room and get a row without a bin; a null source
or cluster conflicts with nothing; repeated rows are packed once each; ties go by id, then by cluster; other columns,
whatever their names, are left out of the result; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import WHITE, lower_ascii, words_of

PLACED = "doc_id long, piece int, start long, n_units long, bin_id string, at long"
ROW = "row"


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """Bin and place in it for every piece, given longest first; see the module."""
    source_bit = {s: 1 << n for n, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    shared = [c for c, n in Counter(c for c in clusters if c is not None).items() if n > 1]  # others can't conflict
    cluster_bit = {c: 1 << n for n, c in enumerate(shared)}
    rooms: list[tuple[int, int]] = []  # room left and bin, ascending
    in_source: list[int] = []
    in_cluster: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        s, c = source_bit.get(source, 0), cluster_bit.get(cluster, 0)
        for k in range(bisect_left(rooms, (size, -1)), len(rooms)):
            room, bin_ = rooms[k]
            if not (in_source[bin_] & s or in_cluster[bin_] & c):
                del rooms[k]
                break
        else:
            room, bin_ = capacity, len(in_source)
            in_source.append(0)
            in_cluster.append(0)
        in_source[bin_] |= s
        in_cluster[bin_] |= c
        out.append((bin_, capacity - room))
        if room > size:
            insort(rooms, (room - size, bin_))
    return out


def text_cluster(text: Column) -> Column:
    """A number that copies of a text share, up to case of A-Z and white space."""
    return F.xxhash64(F.array_join(words_of(lower_ascii(text)), " "))


def pack(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", length: Column | None = None, cluster: Column | None = None, text_col: str = "text", capacity: int = 2048, shard_docs: int = 4096, row: Column | None = None) -> DataFrame:
    """A row for each piece: doc_id, piece, start and n_units (in the document), bin_id, at (place in the bin).

    ``length`` is a document's number of units (its words unless given), ``cluster`` its duplicate cluster. A long
    ``row`` comes back as the column of that name.
    """
    length = F.size(words_of(F.col(text_col))) if length is None else length
    cluster = text_cluster(F.col(text_col)) if cluster is None else cluster
    shards = max(1, -(-docs.count() // shard_docs))
    # ids and clusters also go to Python as text: a column of longs with NULL would come as floats
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("name"), F.col(source_col).cast("string").alias("source"), length.cast("long").alias("size"), cluster.cast("long").alias("cluster"), cluster.cast("string").alias("copies"), (F.lit(0).cast("long") if row is None else row).alias(ROW))
    dealt = narrow.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(shards)).cast("int")).repartition("shard").sortWithinPartitions("shard", "doc_id", "cluster", "source", "size", ROW)

    def placed(rows: pd.DataFrame, name: str) -> pd.DataFrame:
        size = rows["size"].fillna(0).to_numpy(np.int64)
        full, rest = size // capacity, size % capacity
        out = []
        ids, numbers = [None if x is None else int(x) for x in rows.name], rows[ROW].tolist()
        for i in np.flatnonzero(full):
            out += [(ids[i], k, k * capacity, capacity, f"{name}.f{i}.{k}", 0, numbers[i]) for k in range(full[i])]
        order = [i for i in np.argsort(-rest, kind="stable") if rest[i]]
        source, clusters = rows.source.tolist(), rows.copies.tolist()
        for i, (bin_, at) in zip(order, best_fit([int(rest[i]) for i in order], [source[i] for i in order], [clusters[i] for i in order], capacity)):
            out.append((ids[i], full[i], full[i] * capacity, rest[i], f"{name}.{bin_}", at, numbers[i]))
        out += [(ids[i], 0, 0, 0, None, None, numbers[i]) for i in np.flatnonzero(size == 0)]
        return pd.DataFrame(out, columns=[*(c.split()[0] for c in PLACED.split(", ")), ROW]).astype({"doc_id": "Int64", "piece": "int32", "at": "Int64"})

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, shard, part = [], None, 0
        for batch in batches:
            for number, rows in batch.groupby("shard", sort=False):
                if number != shard:
                    if held:
                        yield placed(pd.concat(held, ignore_index=True), f"{shard}.{part}")
                    held, shard, part = [], number, 0
                held.append(rows)
                while sum(map(len, held)) >= 2 * shard_docs:
                    whole = pd.concat(held, ignore_index=True)
                    yield placed(whole[: 2 * shard_docs].reset_index(drop=True), f"{shard}.{part}")
                    held, part = [whole[2 * shard_docs :]], part + 1
        if held and sum(map(len, held)):
            yield placed(pd.concat(held, ignore_index=True), f"{shard}.{part}")

    placed_rows = dealt.mapInPandas(run, f"{PLACED}, {ROW} long")
    return placed_rows.drop(ROW) if row is None else placed_rows


def pack_texts(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", cluster: Column | None = None, capacity: int = 2048, shard_docs: int = 4096) -> DataFrame:
    """``pack`` by words with the ``text`` of each piece: from its first word to the next piece's; the first has what comes before.

    ``docs`` is read twice and must give the same rows in the same order each time, as a written table does.
    """
    numbered = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), *([] if cluster is None else [cluster.alias("cluster")]), F.monotonically_increasing_id().alias(ROW))
    placed = pack(numbered, cluster=None if cluster is None else F.col("cluster"), capacity=capacity, shard_docs=shard_docs, row=F.col(ROW))
    words = rf"[^{WHITE}]++[{WHITE}]*+"
    pieces = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(rf"^[{WHITE}]*+(?:{words}){{1,{capacity}}}+|(?:{words}){{1,{capacity}}}+"), F.lit(0))
    joined = placed.join(numbered.select(ROW, "text"), ROW)
    whole = (F.col("n_units") < capacity) & (F.col("piece") == 0)
    return joined.withColumn("text", F.when(whole, F.col("text")).otherwise(F.get(pieces, F.col("piece")))).drop(ROW)
