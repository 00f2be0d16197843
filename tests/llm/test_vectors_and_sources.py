"""Vector codes, exact search and the source audit against plain loops, and their defined cases."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.llm import divergence, top_k, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, error string, score string, vector string, own string, id string, place string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], l, *(["own"] * 7)) for i, v, l in rows], VECTORS)


def odd_vectors(n=150, dim=8, seed=1):
    """Few distinct values, so that distances and scores tie; odd rows and repeated ones."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), (rng.integers(-6, 7, dim) / 64).tolist(), int(i) % 3 if i % 4 else None) for i in rng.permutation(n)]
    odd = [(900, None, 1), (901, [None] + [0.1] * (dim - 1), 1), (902, [math.nan] + [0.1] * (dim - 1), 1), (903, [math.inf] * dim, 1), (904, [0.5] * (dim + 1), 1), (905, [], 1), (None, [0.25] * dim, None)]
    return rows + odd + rows[:7]


def plain_codes(rows, parts, entries, rounds, scale=256):
    dim = Counter(len(v) for _, v, _ in rows if v).most_common(1)[0][0]
    kept = [r for r in rows if r[1] is not None and len(r[1]) == dim and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = dim // parts
    whole = [[math.floor(np.float32(x).astype(float) * scale) for x in v] for _, v, _ in kept]
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v[p], c)), j) for j, c in enumerate(books[p]))

    for _ in range(rounds):
        groups = defaultdict(list)
        for v in cut:
            for p in range(parts):
                groups[p, nearest(v, p)[1]].append(v[p])
        for (p, j), held in groups.items():
            books[p][j] = tuple(sum(x) // len(held) for x in zip(*held))
    found = [[nearest(v, p) for p in range(parts)] for v in cut]
    return [(r[0], r[2], bytes(j for _, j in f), sum(d for d, _ in f)) for r, f in zip(kept, found)], books


@pytest.mark.parametrize("entries, rounds", [(16, 2), (16, 5), (200, 1), (3, 0)])
def test_codes_equal_plain_lloyd(spark, entries, rounds):
    rows = odd_vectors()
    coded, book = vector_codes.compress(vectors_of(spark, rows).repartition(5), parts=4, entries=entries, rounds=rounds)
    assert [c for c in coded.columns if c in VECTORS] and coded.columns[-2:] == ["code", "error"]
    want, books = plain_codes(rows, 4, entries, rounds)
    got = coded.collect()
    assert all(r.own == "own" and r.vector == "own" for r in got)
    assert Counter((r.vec_id, r.label, bytes(r.code), r.error) for r in got) == Counter(want)
    assert book.tolist() == [[list(e) for e in b] for b in books]
    back = vector_codes.reconstruct(coded.drop("vector"), book).where("vec_id = 3").first()
    assert back.vector == [x / 256 for p, j in enumerate(bytes(back.code)) for x in books[p][j]]


def test_pruning_skips_comparisons_but_no_tie():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-9, 10, (300, 4)) + c * 100 for c in range(12)])
    book = x[::300].copy()
    code, _, upper, lower = vector_codes.first_assignment(x, book)
    new = book + rng.integers(-3, 4, book.shape)
    new[5] = new[4]  # equal entries: the lower index wins
    moved = vector_codes._moved(book[None], new[None])[0]
    lower = np.maximum(vector_codes._below(vector_codes._LEVELS[vector_codes._level(lower)] - moved), 0)
    code, upper, lower, compared = vector_codes.next_assignment(x, new, vector_codes.entry_distances(new[None])[0], code, vector_codes._above(upper + moved[code]), lower)
    exact = vector_codes.distances(x, new)
    assert (code == exact.argmin(axis=1)).all() and (code != 5).all()
    assert (upper**2 >= exact.min(axis=1)).all() and (lower**2 <= exact).all()
    assert compared < 0.3 * exact.size


def test_codes_of_large_components_and_of_nothing(spark):
    rows = [(i, [3e38, -3e38, 1.0, float(i)], None) for i in range(3)]
    coded, book = vector_codes.compress(vectors_of(spark, rows), parts=2, entries=2, rounds=1)
    bound = vector_codes.most(4)
    assert book[0].tolist() == [[bound, -bound]] * 2 and {r.vec_id: r.error for r in coded.collect()}[0] == 0
    assert 4 * (2 * bound) ** 2 < 2**63 <= 4 * (4 * bound) ** 2 * 2
    for none in (vectors_of(spark, rows[:1]).limit(0), vectors_of(spark, [(1, [0.5] * 3, 1)])):
        coded, book = vector_codes.compress(none, parts=2)
        assert coded.count() == 0 and book.size == 0
    assert vector_codes.with_group_sum(coded, "label", "error", "label_error").count() == 0


def test_group_sums_of_frequent_and_rare_keys(spark, monkeypatch):
    rows = [(None if i % 3 == 0 else i % 50 if i % 3 == 1 else 7, i) for i in range(600)]
    sums = defaultdict(int)
    for k, v in rows:
        sums[k] += v
    for heavy in (0.2, 0.0, 2.0):
        monkeypatch.setattr(vector_codes, "HEAVY", heavy)
        got = vector_codes.with_group_sum(spark.createDataFrame(rows, "k int, v long"), "k", "v", "s").collect()
        assert Counter((r.k, r.v, r.s) for r in got) == Counter((k, v, sums[k]) for k, v in rows)


def plain_top(rows, dim, every, k, scale=256):
    kept = [(i, [math.floor(float(np.float32(x)) * scale) for x in v]) for i, v, _ in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    found = Counter()
    for q, v in kept:
        if q is not None and q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i is None, i or 0) for i, w in kept if i != q)
            found.update((q, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(scores[:k], 1))
    return found


@pytest.mark.parametrize("block_rows, part, k", [(1000, 4096, 5), (64, 7, 3), (20, 2, 300)])
def test_top_k_equals_brute_force(spark, block_rows, part, k):
    rows = odd_vectors(seed=2)
    found = top_k.search(vectors_of(spark, rows).repartition(4), F.col("vec_id") % 10 == 0, k=k, block_rows=block_rows, part=part)
    assert Counter(map(tuple, found.collect())) == plain_top(rows, 8, 10, k)


def test_top_k_of_few_rows(spark):
    asks = F.col("vec_id") % 2 == 0
    one = vectors_of(spark, [(2, [0.5, -0.5], 1)])
    assert top_k.search(one, asks).count() == 0 and top_k.search(one.limit(0), asks).count() == 0
    assert top_k.search(one, F.lit(False)).count() == 0
    two = top_k.search(one.unionByName(vectors_of(spark, [(3, [-1e38, 0.0], 1)])), asks).collect()
    assert [tuple(r) for r in two] == [(2, 1, 3, -128 * vector_codes.most(2))]
    with pytest.raises(TypeError):
        top_k.search(one.withColumn("vec_id", F.lit("a")), asks)


def test_processing_stops_on_proof_alone():
    rng = np.random.default_rng(5)
    vectors = rng.integers(0, 4, (4000, 32))
    vectors[:40, :4] += 2000 + 40 * np.arange(40)[:, None]  # few rows have nearly all of the score
    block, ids = top_k.Block.of(vectors), np.arange(4000)
    block = top_k.Block.read(block.stored(), 32)
    for query in (np.r_[np.full(4, 50), rng.integers(0, 3, 28)], rng.integers(-5, 6, 32), np.zeros(32, np.int64)):
        scores = vectors @ query
        want = [i for i in np.lexsort((ids, -scores)) if i not in (1, 2)][:5]
        rows, got, done = block.top(query, 5, np.array([1, 2]), ids)
        assert rows.tolist() == want and got.tolist() == scores[want].tolist()
        if query[0] == 50:
            assert done < 0.7 * len(block.segments(query)[0])


DOCS = "doc_id long, text string, lang string, source string, term string, n string, p string, rank string"


def plain_audit(rows, least, most):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        words = [w.translate(lower) for w in term.findall(text or "")]
        key = (lang or "", source or "")
        groups.add(key)
        counts[key].update(words)
        docs[key[0]].update(set(words))
    found = []
    for lang in {g[0] for g in groups}:
        kept = [w for w, n in docs[lang].items() if n >= least]
        of = {s: {w: counts[lang, s][w] for w in kept} for l, s in groups if l == lang}
        share = lambda c: {w: 1 + 1000000000 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in of.items()}, share({w: sum(c[w] for c in of.values()) for w in kept})
        for s in of:
            pairs = sorted((-sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o.encode()) for o in of if o != s)
            terms = sorted((-((p[s][w] - q[w]) ** 2 // q[w]), w.encode()) for w in kept if of[s][w] and p[s][w] > q[w])
            for part, items in (("pair", pairs), ("term", terms[:most])):
                found += [(lang, s, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(items, 1)]
    return Counter(found)


def test_audit_equals_plain_counts(spark):
    rng = np.random.default_rng(7)
    words = ["Aa", "b1b", "c_c", "Ünder", "ünder", "don't", "日本", "\U0001f600x", "zz", "y", "E", "É"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 12)).tolist()), str(rng.choice(["en", "de"])), str(rng.choice(["s1", "s2", "s3"]))) for _ in range(80)]
    rows += [(None, "en", "empty"), ("", "xx", "a"), ("12 34", "xx", "b"), ("once", "yy", None), ("aa b", None, "s1"), ("aa b", None, None), ("aa", None, ""), ("aa " * 5000, "en", "s1")] + rows[:3]
    df = spark.createDataFrame([(i, *r, *(["own"] * 4)) for i, r in enumerate(rows)], DOCS)
    for least, most in ((3, 200), (1, 2), (50, 5)):
        got = divergence.audit(df.repartition(4), least, most)
        assert Counter(map(tuple, got.collect())) == plain_audit(rows, least, most)
    assert divergence.audit(df.limit(0)).count() == 0


def test_shares_stay_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**18, 3 * 10**18, 7)], "n long, total long, v long")
    assert df.select(divergence._share("n", "total", "v")).first()[0] == 1 + 10**9 * (10**18 + 1) // (3 * 10**18 + 7)


def test_codebook_digest_is_in_reading_order():
    book = np.arange(12).reshape(2, 3, 2)
    assert hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest() == hashlib.sha256(b"0,1,2,3,4,5,6,7,8,9,10,11").hexdigest()
