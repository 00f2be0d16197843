"""The ten operators against brute force, exact round trips and held-out rows, and their defined cases."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barweave.llm import chat, common, components, decontaminate, language_id, packing, quality_model, quality_rules, queries, secret_scan, simhash, url_filter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, extra=False):
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    clash = ("n_words", "kept", "score", "spans", "simhash", "component_id", "_text", "doc", "id", "contaminated", "bin_id", "host", "payload")
    return df.withColumns({c: F.lit(f"own {c}") for c in clash}) if extra else df


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, a null id, a repeated row, a very long text, columns with the results' names."""
    texts = [None, "", " \t\n", "one", "a b", "one two three four " * 30, "x" * 50_000, "word " * 60_000, "one two three four " * 30]
    df = docs_of(spark, texts, True)
    return df.unionByName(df.where("doc_id = 5")).unionByName(df.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long"))).persist()


def empty(spark):
    return docs_of(spark, ["x"], True).limit(0)


# -- 1 WARC


def test_warc_round_trip(spark):
    html = [("a" * 10, 3), (None, 4), ("", 2), ("é<p>" * 4000, 9), ("a" * 10, 1), ("b", 7), ("a" * 10, 1), ("only", None)]
    pages = spark.createDataFrame([(i, None if i == 7 else f"http://x/{i}\r\nevil: 1", h) for h, i in html], "page_id long, url string, html string")
    index = warc.write_archives(pages, frame_bytes=300, bundle_bytes=5000)
    got = warc.read_archives(index).collect()
    assert len(got) == len(html)
    first = {}
    for h, i in sorted(html, key=lambda x: (x[1] is None, x[1])):
        first.setdefault(h or "", i)
    for r in got:
        assert r.record_type == ("response" if r.page_id == first_of(html, r) else "revisit")
    wanted = Counter((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), None if first[h or ""] == i else first[h or ""]) for h, i in html)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.refers_to) for r in got) == wanted
    bodies = {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"}
    assert bodies[9] == "é<p>" * 4000 and bodies[2] == ""
    one = warc.fetch(index, spark.createDataFrame([("<urn:page:9>",), ("<urn:page:none>",)], "record_id string")).collect()
    assert [r.page_id for r in one] == [9] and index.agg(F.max("frame")).first()[0] > 0
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def first_of(html, row):
    sha = {base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(): h or "" for h, _ in html}
    ids = [i for h, i in html if (h or "") == sha[row.payload_digest] and i is not None]
    return min(ids) if ids else None


def test_warc_plain_zstandard_reads_the_bundles(spark):
    import zstandard

    pages = spark.createDataFrame([(i, "u", f"page {i}" * 50) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(pages, frame_bytes=1000).first().path
    plain = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).readall()
    assert plain.count(b"WARC/1.1\r\n") == 20


# -- 2 packing


def plain_best_fit(sizes, sources, clusters, capacity):
    bins, out = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        fits = [(b["room"], n) for n, b in enumerate(bins) if b["room"] >= size and (source is None or source not in b["sources"]) and (cluster is None or cluster not in b["clusters"])]
        n = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"room": capacity, "sources": set(), "clusters": set()})
        out.append((n, capacity - bins[n]["room"]))
        bins[n]["room"] -= size
        bins[n]["sources"].add(source)
        bins[n]["clusters"].add(cluster)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_is_the_tightest(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randint(1, 99) for _ in range(400)), reverse=True)
    sources, clusters = [rng.choice([None, *range(12), 0, 0, 0]) for _ in sizes], [rng.choice([None, *range(200)]) for _ in sizes]
    assert packing.best_fit(sizes, sources, clusters, 100) == plain_best_fit(sizes, sources, clusters, 100)


def test_pack_whole_table(spark, odd):
    rows = packing.pack(odd, capacity=100, shard_docs=4).collect()
    bins = defaultdict(list)
    for r in rows:
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    for parts in bins.values():
        parts.sort(key=lambda r: r.at)
        assert sum(r.n_units for r in parts) <= 100 and all(a.at + a.n_units == b.at for a, b in zip(parts, parts[1:]))
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.n_units
    texts = Counter()
    for r in odd.collect():
        texts[r.doc_id] += len(WORD.findall(r.text or ""))
    assert total == texts and sum(1 for r in rows if r.doc_id == 5 and r.piece == 0) == 2
    assert packing.pack(empty(spark)).count() == 0
    facts = {r.doc_id: (r.source, " ".join(WORD.findall((r.text or "").lower()))) for r in odd.collect()}
    for parts in bins.values():
        own = [facts[r.doc_id] for r in parts]
        assert len(own) == len({x[1] for x in own}) and len([x for x in own if x[0]]) == len({x[0] for x in own if x[0]})


def test_pieces_have_the_texts(spark, odd):
    """The pieces of a document, joined in order, are its text with every space; the pieces of a bin fill it."""
    more = docs_of(spark, [" \n a  b\tc " * 40, "\x0b" + "w " * 300 + " \n", "é" * 10 + " x" * 99, " ".join("abc" for _ in range(100)), " lead"], True).withColumn("doc_id", F.col("doc_id") + 100)
    docs = odd.unionByName(more).coalesce(1)
    rows = packing.pack_texts(docs, capacity=100, shard_docs=4).collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text)
    for i, own in texts.items():
        parts = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert all(r.text is None or len(WORD.findall(r.text)) == r.n_units for r in parts)
        for n, text in enumerate(own):
            mine = parts[n :: len(own)]
            assert "".join(r.text or "" for r in mine) == (text or "")
    given = packing.pack_texts(docs, cluster=F.lit(1).cast("long"), capacity=100).where("n_units < 100 and bin_id is not null")
    assert given.groupBy("bin_id").count().where("count > 1").count() == 0
    assert packing.pack_texts(empty(spark)).count() == 0


# -- 3 quality rules


def counts(text):
    w = WORD.findall(text or "")
    seen = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_and_thresholds(spark, odd):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7)))
    texts = ["\n".join(" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(8)) + rng.choice(["", "\nsame\nsame", " #| $" * 20]) for _ in range(80)]
    for df in (odd, docs_of(spark, texts)):
        for r in quality_rules.judge(df, prior=10).collect():
            n = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            assert n == counts(r.text) and r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
            assert not (r.base_failed and r.kept)
    assert quality_rules.judge(empty(spark)).count() == 0
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and all(r.kept == "own kept" for r in kept.collect())


def plain_verdicts(rows, prior, reach):
    """kept of each of (lang, source, text), from sorted lists of values cut like the sketches' buckets."""
    names = ("marks", "capitals", "dups", "repeats", "length")
    found = []
    for lang, source, text in rows:
        n, chars, _, dups, repeats = counts(text)
        lines = sum(1 for x in (text or "").split("\n") if WORD.search(x))
        marks = sum(33 <= ord(c) < 127 and not c.isalnum() for c in text or "")
        capitals = sum("A" <= c <= "Z" or c == "!" for c in text or "")
        values = (1000 * marks // max(chars, 1), 1000 * capitals // max(chars, 1), 1000 * dups // max(lines, 1), 1000 * repeats // max(n, 1), 100 * chars // max(n, 1))
        found.append((lang or "", source or "", n < 50 or 2 * repeats > n, dict(zip(names, values))))
    cut = lambda v: v >> max(v.bit_length() - 6, 0) << max(v.bit_length() - 6, 0)

    def held(m, *key):
        return Counter(cut(v[m]) for lang, source, failed, v in found if not failed and key == (lang, source)[: len(key)] and (v[m] or m not in ("dups", "repeats")))

    def quartile(sketch, k):
        at, total = 0, sum(sketch.values())
        for b in sorted(sketch):
            at += sketch[b]
            if 4 * at >= k * total:
                return b

    groups = sorted({(lang, source) for lang, source, failed, _ in found if not failed})
    own = {}
    for m in names:
        for g in groups:
            if sketch := held(m, *g):
                low, middle, high = (quartile(sketch, k) for k in (1, 2, 3))
                own[m, g] = sum(sketch.values()), middle, min(middle - low, high - middle) if m == "length" else middle - low
    verdicts = []
    for lang, source, failed, values in found:
        fine = not failed
        for m in names if fine else ():
            near = [x for (k, g), x in own.items() if k == m and g[0] == lang]
            if near:
                centre, usual = (float(np.median([x[i] for x in near])) for i in (1, 2))
                whole = float(np.median([x[2] for (k, _), x in own.items() if k == m]))
                n, middle, width = own.get((m, (lang, source)), (0, centre, usual))
                leaning = lambda x, to: (n * x + prior * to) / (n + prior)
                times = reach * (2 if m in ("dups", "repeats") else 1)
                spread, outer = max(leaning(width, usual), usual) or whole, (usual or whole) + float(np.median([abs(x[1] - centre) for x in near]))
                if spread:
                    fine &= values[m] <= min(leaning(middle, centre) + times * spread, centre + 2 * times * outer)
                    fine &= m != "length" or values[m] >= max(leaning(middle, centre) - times * spread, centre - 2 * times * outer)
        verdicts.append(bool(fine))
    return verdicts


def test_quality_verdicts_by_brute_force(spark):
    """Groups with other habits have other fences, and one text has another verdict in each; a group of copies rejects nothing for a trifle."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(2, 8)))

    def text(commas, tail=""):
        return "\n".join(" ".join(word() + ("," if rng.random() < commas else "") for _ in range(12)) for _ in range(8)) + tail

    rows = [("en", "plain", text(0.05)) for _ in range(60)] + [("en", "code", text(0.9)) for _ in range(60)] + [("de", None, text(0.1)) for _ in range(5)] + [(None, "x", text(0.1, "\nsame\nsame")) for _ in range(5)]
    same = text(0.05)
    rows += [("fr", "copies", same)] * 40 + [("fr", "copies", text(0.06)) for _ in range(3)]
    shown = text(0.9)
    rows += [("en", "plain", shown), ("en", "code", shown), ("fr", "copies", text(0.1, " ### $$$" * 60)), ("de", "y", ""), ("de", "y", None)]
    df = spark.createDataFrame([(i, t, lang, s) for i, (lang, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    for prior, reach in ((5, 12), (100, 20)):
        found = {r.doc_id: r for r in quality_rules.judge(df, prior=prior, reach=reach).collect()}
        assert [found[i].kept for i in range(len(rows))] == plain_verdicts(rows, prior, reach)
        assert all(r.kept == (not r.failed_rules) and r.base_failed == (r.failed_rules == ["base"]) for r in found.values())
        if prior == 5:
            at = len(rows) - 5
            assert not found[at].kept and found[at + 1].kept and not found[at + 2].kept and all(found[i].kept for i in range(at - 3, at))
    limits = quality_rules.thresholds(quality_rules.sketches(quality_rules.document_counts(df))).collect()
    assert len({r.most_marks_per_mille for r in limits}) > 2


def test_quality_quantiles(spark):
    rng = np.random.default_rng(2)
    rows = [("en", s, int(v)) for s, n in (("a", 900), ("b", 500), ("tiny", 5)) for v in rng.gamma(2, 60 if s == "a" else 15, n)]
    df = spark.createDataFrame(rows, "lang string, source string, v long")
    df = df.select("lang", "source", F.lit(False).alias("base_failed"), *(F.col("v").alias(m) for m in quality_rules.METRICS))
    sketch = quality_rules.sketches(df)
    found = {r.source: r for r in quality_rules.quartiles(sketch, "lang", "source").collect()}
    for s in ("a", "b"):
        values = np.array([v for _, x, v in rows if x == s])
        for share, got in ((0.25, found[s].marks_per_mille_q25), (0.5, found[s].marks_per_mille_q50), (0.75, found[s].marks_per_mille_q75)):
            exact = np.quantile(values, share, method="inverted_cdf")
            assert exact * 31 / 32 - 1 <= got <= exact
    merged = quality_rules.quartiles(quality_rules.merged(sketch, "lang"), "lang").first()
    exact = np.quantile([v for *_, v in rows], 0.75, method="inverted_cdf")
    assert exact * 31 / 32 - 1 <= merged.marks_per_mille_q75 <= exact


@pytest.mark.parametrize("share, most_kept", [(0.1, 0.0), (0.2, 0.0), (0.3, 0.0), (0.4, 0.05), (0.6, 0.05), (0.9, 0.05)])
def test_junk_in_a_source_moves_no_fence(spark, share, most_kept):
    """One of twelve sources is bad by a share; its junk goes, and the other sources' fences stay where they were."""
    rng = np.random.default_rng(9)
    rows = [("en", f"s{s}", int(v)) for s in range(11) for v in rng.normal(28, 4.5, 200)] + [("de", "s1", int(v)) for v in rng.normal(24, 4, 200)]
    clean, junk = rng.normal(28, 4.5, round(400 * (1 - share))), rng.uniform(150, 400, round(400 * share))

    def limits(rows):
        df = spark.createDataFrame(rows, "lang string, source string, v long").select("lang", "source", F.lit(False).alias("base_failed"), *(F.col("v").alias(m) for m in quality_rules.METRICS))
        return {(r._bw_lang, r._bw_source): r.most_marks_per_mille for r in quality_rules.thresholds(quality_rules.sketches(df)).collect()}

    before, after = limits(rows), limits(rows + [("en", "bad", int(v)) for v in [*clean, *junk]])
    assert sum(v <= after["en", "bad"] for v in junk) <= most_kept * len(junk) and all(v <= after["en", "bad"] for v in clean)
    assert all(abs(after[g] - x) <= 3 and x > 50 for g, x in before.items())


def test_quality_salted_join_is_the_broadcast_join(spark, monkeypatch):
    df = docs_of(spark, [f"{w} " * 3 + " ".join(f"w{w}{i}" for i in range(60)) for w in range(40)])
    a = quality_rules.judge(df).orderBy("doc_id").collect()
    monkeypatch.setattr(quality_rules, "BROADCAST_GROUPS", 0)
    assert quality_rules.judge(df).orderBy("doc_id").collect() == a


# -- 4 language id


def test_gradients_by_differences():
    network = language_id.Network.fresh(["a", "b", "c"], 3, 1)
    rng = np.random.default_rng(0)
    windows, wanted = rng.integers(0, 256, (5, 7)).astype(np.uint8), rng.integers(0, 3, 5)
    _, found = network.gradients(windows, wanted)
    for weight, g in zip(network.weights(), found):
        for place in zip(*np.unravel_index(np.argsort(-np.abs(g).ravel())[:4], g.shape)):
            before = weight[place]
            weight[place] = before + 1e-2
            up = network.gradients(windows, wanted)[0]
            weight[place] = before - 1e-2
            down = network.gradients(windows, wanted)[0]
            weight[place] = before
            assert (up - down) / 2e-2 == pytest.approx(g[place], rel=0.05, abs=2e-4)


def plain_probabilities(network, data, window):
    """Mean over the bytes of a text of the label probabilities, each byte read in its window, by loops over gates."""
    h = network.hidden
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    total = np.zeros(len(network.labels))
    for start in range(0, len(data), window):
        begin = min(start, max(len(data) - window, 0))  # the last window reaches back
        read = list(data[begin : begin + window])
        read += [0] * (window - len(read))
        states = []
        for side in (0, 1):
            state, kept = [0.0] * h, {}
            for t in range(window) if side == 0 else reversed(range(window)):
                x, new = network.embed[side][read[t]], []
                inner = [sum(state[i] * float(network.turn[side][i][j]) for i in range(h)) for j in range(3 * h)]
                for j in range(h):
                    keep, reset = sigmoid(x[j] + inner[j]), sigmoid(x[h + j] + inner[h + j])
                    fresh = math.tanh(x[2 * h + j] + reset * inner[2 * h + j])
                    new.append(keep * state[j] + (1 - keep) * fresh)
                state = new
                kept[t] = state
            states.append(kept)
        for t in range(start - begin, min(window, len(data) - begin)):
            both = states[0][t] + states[1][t]
            scores = [sum(both[i] * float(network.out[i][k]) for i in range(2 * h)) + float(network.bias[k]) for k in range(len(network.labels))]
            weights = [math.exp(x - max(scores)) for x in scores]
            total += np.array(weights) / sum(weights)
    return total / max(len(data), 1)


def test_forward_pass_and_pooling_by_loops(spark):
    network = language_id.Network.fresh(["a", "b", "c"], 3, 4)
    texts = ["a", "short text", "exactly16letters", "Ünï – a text that takes more than one window of sixteen bytes", "x" * 33]
    rows = language_id.label_languages(docs_of(spark, texts), network, window=16).collect()
    for r in rows:
        wanted = plain_probabilities(network, r.text.encode(), 16)
        assert r.lang_pred == network.labels[int(wanted.argmax())] and r.score == pytest.approx(wanted.max(), abs=1e-5)


def test_windows_cover_every_byte_once():
    texts = [b"", b"a", b"x" * 10, b"y" * 11, b"z" * 25, bytes(range(97, 107)) * 3]
    windows, owner, first, last = language_id.cut(texts, 10)
    for n, text in enumerate(texts):
        mine = np.flatnonzero(owner == n)
        assert b"".join(bytes(windows[w][first[w] : last[w]]) for w in mine) == text


def test_language_held_out(spark):
    found = queries.op4_language_id(spark, "/root/testdata/sf0.001")
    truth = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 20 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.93
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_cases(spark, odd):
    network = language_id.train([(b"the and of to in " * 5, "en"), ("der und die das über ".encode() * 5, "de")], steps=40)
    rows = language_id.label_languages(odd, network).collect()
    assert len(rows) == odd.count()
    for r in rows:
        letter = any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred == "und" and r.score == 0) if not letter else r.lang_pred in ("en", "de")
    assert language_id.train([]) is None and language_id.train([(b"abc", "xx")]).labels == ["xx"]
    assert {r.lang_pred for r in language_id.label_languages(odd, None).collect()} == {"und"}
    assert language_id.label_languages(empty(spark), network).count() == 0
    mixed = spark.createDataFrame([(1, "the and of to in " * 20 + "der und die das über " * 20)], "doc_id long, text string")
    spans = language_id.label_positions(mixed, network).orderBy("first").collect()
    assert spans[0].first == 0 and spans[-1].last == len(mixed.first().text.encode()) and all(a.last == b.first for a, b in zip(spans, spans[1:]))


# -- 5 decontamination


def plain_hits(text, items, window=10):
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, named = tokens(text), set(), set()
    for name, item in items:
        words = tokens(item)
        k = min(window, len(words))
        for s in range(len(words) - k + 1) if k else ():
            for i in range(len(w) - k + 1):
                if w[i : i + k] == words[s : s + k]:
                    hit |= set(range(i, i + k))
                    named.add(name)
    return len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()


@pytest.mark.parametrize("block_mb, shard_words", [(32, 1_000_000), (0.0001, 50)])
def test_decontamination(spark, block_mb, shard_words):
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "of", "Über", "x1", "cat", "dog", "and"])
    items = [(str(i), " ".join(word() for _ in range(rng.choice([1, 3, 9, 10, 14, 25])))) for i in range(25)] + [("9", "the! CAT of"), ("e", ""), ("n", None), ("3", "dog dog")]
    items = [x for x in items if len((x[1] or "").split()) != 1]
    texts = [None, "", "the"] + [" ".join(word() for _ in range(rng.randint(0, 60))) + (" " + (rng.choice(items)[1] or "").upper() if i % 3 else "") for i in range(50)]
    benchmark = spark.createDataFrame(items + items[:3], "item_id string, text string")
    df = docs_of(spark, texts, True).repartition(2)
    for r in decontaminate.mark_contaminated(df, benchmark, block_mb=block_mb, shard_words=shard_words).collect():
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == plain_hits(r.text, items) and r.contaminated == (r.n_hit > 0)
    kept = decontaminate.remove_contaminated(df, benchmark)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(texts) if not plain_hits(t, items)[1]}


def test_longest_matches(spark):
    df = docs_of(spark, ["x a b c d y b c d e", "a b c d e f", None])
    found = decontaminate.longest_matches(df, spark.createDataFrame([("i", "a b c d e"), ("j", "b c d e")], "item_id string, text string"), window=3).collect()
    got = {(r.id, r.item_id, r.doc_word, r.item_word, r.n_words) for r in found}
    assert {(0, "i", 1, 0, 4), (0, "i", 6, 1, 4), (1, "i", 0, 0, 5), (0, "j", 6, 0, 4), (1, "j", 1, 0, 4)} <= got


def test_decontamination_cases(spark, odd):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.mark_contaminated(odd, nothing).where("contaminated").count() == 0
    assert decontaminate.mark_contaminated(empty(spark), nothing).count() == 0
    rows = decontaminate.mark_contaminated(odd, spark.createDataFrame([(None, "word")], "item_id long, text string")).where("contaminated").collect()
    assert len(rows) == 1 and rows[0].n_hit == 60_000 and rows[0].items_sha256 == hashlib.sha256(b"").hexdigest()


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 4, 300)
    order = decontaminate.suffix_array(text, 12)
    suffixes = [tuple(text[i : i + 12]) for i in order]
    assert suffixes == sorted(suffixes) and set(order) == set(np.flatnonzero(text))


# -- 6 quality model


def test_quality_model_held_out(spark):
    found = queries.op6_quality_model(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = found.join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.95 and all((r.score >= 0.3) == r.predicted for r in rows)


def plain_statistics(text):
    data = (text or "").encode()
    words = [w for w in re.split(rb"[ \t\n\x0b\x0c\r]+", data) if w]
    lines = [x for x in data.split(b"\n") if x.strip()]
    n, rows, size = max(len(words), 1), max(len(lines), 1), max(len(data), 1)
    share = lambda keep: sum(1 for b in data if keep(b)) / size
    among = lambda characters: share(lambda b: b in characters)
    return dict(
        log_bytes=math.log1p(len(data)), log_words=math.log1p(len(words)), word_length=sum(map(len, words)) / n, longest_word=max(map(len, words), default=0), unique_words=len(set(words)) / n, top_word=max((words.count(w) for w in set(words)), default=0) / n,
        lower=share(lambda b: 97 <= b <= 122), upper=share(lambda b: 65 <= b <= 90), digits=share(lambda b: 48 <= b <= 57), spaces=among(b" \t\n\x0b\x0c\r"), sentence_marks=among(b".,;:?"), other_marks=among(b"\"'()[]{}/\\-_=+"),
        symbols=among(b"#*$%&|<>^~@"), exclamations=among(b"!"), bars=among(b"|"), non_ascii=share(lambda b: b >= 128), lines=math.log1p(len(lines)), line_length=len(data) / rows, repeated_lines=1 - len(set(lines)) / rows,
        ended_lines=sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / rows,
    )


def test_statistics_by_loops():
    for text in (None, "", " \n\t", "One two. TWO three!\nOne two.\n\nno end ~@ |x| 12,5 \"q\" é", "a\x0bb\x0cc\r\nd ?\n" * 3):
        assert quality_model.statistics(text) == pytest.approx([plain_statistics(text)[k] for k in quality_model.STATISTICS])


def test_splits_by_brute_force():
    """The first tree's first split has the best gain over all cuts between values, and the leaves have their step."""
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 12, (300, 4)).astype(float)
    labels = (rows[:, 2] + rng.normal(0, 2, 300) > 6).astype(float)
    forest = quality_model.fit(rows, labels, trees=1, depth=1, rate=0.3, shrink=1.0)
    p = (labels.sum() + 0.5) / 301
    slope, bend = labels - p, np.full(300, p * (1 - p))
    score = lambda side: slope[side].sum() ** 2 / (bend[side].sum() + 1)
    best = max((score(rows[:, f] <= x) + score(rows[:, f] > x), f, x) for f in range(4) for x in range(11))
    left = rows[:, best[1]] <= best[2]
    assert forest.feature[0, 0] == best[1] and ((rows[:, best[1]] <= forest.threshold[0, 0]) == left).all()
    step = lambda side: 0.3 * slope[side].sum() / (bend[side].sum() + 1)
    wanted = 1 / (1 + np.exp(-(np.log(p / (1 - p)) + np.where(left, step(left), step(~left)))))
    assert np.allclose(forest.score(rows), wanted)


def test_flat_trees_walk_like_a_loop():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(500, 4))
    labels = ((rows[:, 0] > 0) ^ (rows[:, 1] > 0.5)).astype(float)
    forest = quality_model.fit(rows, labels, trees=12, depth=3)
    scores = forest.score(rows)
    for row, got in zip(rows[:50], scores):
        total = forest.start
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            k = 0
            while k < len(feature):
                k = 2 * k + 1 + int(row[feature[k]] > threshold[k])
            total += leaf[k - len(feature)]
        assert got == pytest.approx(1 / (1 + np.exp(-total)))
    assert np.mean((scores > 0.5) == labels) > 0.95


def test_quality_model_cases(spark, odd):
    every = F.lit(True)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_model.classify(odd, none, every).collect()} == {0.5}
    ones = spark.createDataFrame([(3, 1), (4, 1), (4, 1), (5, None), (None, 0)], "doc_id long, quality int")
    rows = quality_model.classify(odd, ones, every).collect()
    assert len(rows) == odd.count() and len({r.score for r in rows}) == 1 and rows[0].score > 0.7
    assert quality_model.classify(empty(spark), ones, every).count() == 0
    drawn = quality_model.learn(quality_model.with_statistics(odd), ones, every, sample_rows=1)
    assert drawn.score(np.zeros((1, 20)))[0] > 0


# -- 7 secrets

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_secret_patterns(spark, odd):
    hex40 = hashlib.sha1(b"x").hexdigest()
    texts = [
        f'é token = "{hex40}" 𝒳 password:abc secret=12345678', "token = api_key: 12345678", "TOKEN=token=abcdefgh PASSWD : 'x' apikey=zzzzzzzz", f"AKIA AKIA{'A' * 11} AKIA{'B' * 12} {hex40}{hex40}", "api_key\n=12345678 secret= =12345678",
        f"{hex40[:31]} {hex40[:32]}G", "toKen=K" + "a" * 8, "password=" * 300, f"token={hex40}" * 50,
    ]
    for df in (docs_of(spark, texts, True), odd):
        for r in secret_scan.scan(df).collect():
            assert [tuple(s) for s in r.base_spans] == plain_spans(r.text or "")
    assert secret_scan.scan(empty(spark)).count() == 0


def test_random_strings_are_found_and_words_are_not(spark):
    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    secrets = ["".join(rng.choice(alphabet) for _ in range(n)) for n in [40, 48, 64, 88] * 20]
    written = ["ThisIsAReadableIdentifierName2" * 2, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaA1", "AbAbAbAb12AbAbAbAb12AbAbAbAb12", "Donaudampfschifffahrtsgesellschaft", "a/path/to/Some/file_name/index2/page"]
    df = docs_of(spark, [f"see {s} there" for s in secrets] + [f"see {w} there" for w in written] + ["plain words only " * 50])
    rows = {r.doc_id: r for r in secret_scan.scan(df).collect()}
    found = [i for i in range(len(secrets)) if any(s.kind == 3 for s in rows[i].spans)]
    assert len(found) >= 0.9 * len(secrets)
    assert all((s.start, s.end) == (4, 4 + len(secrets[i])) for i in found for s in rows[i].spans)
    assert not any(rows[i].spans for i in range(len(secrets), len(rows)))


def test_secrets_of_other_alphabets_and_parts_of_runs(spark):
    rng = random.Random(8)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    kinds = {"lower36": lower + digits, "upper36": (lower + digits).upper(), "letters": lower + lower.upper()}
    for name, alphabet in kinds.items():
        secrets = ["".join(rng.choice(alphabet) for _ in range(80)) for _ in range(30)]
        texts = [f"see {s} there" for s in secrets] + [f"see https://example.org/path/to/index/page/{s} there" for s in secrets]
        rows = {r.doc_id: r for r in secret_scan.scan(docs_of(spark, texts)).collect()}
        places = [(i, texts[i].index(s), s) for i, s in enumerate(secrets * 2)]
        found = [any(x.kind == 3 and x.start <= at and at + len(s) <= x.end for x in rows[i].spans) for i, at, s in places]
        assert sum(found[:30]) >= 27 and sum(found[30:]) >= 27, name
    written = ["donaudampfschifffahrtsgesellschaftskapitaen", "GetTheReadableNameOfEveryElementInTheDocument", "some_readable_name_of_an_option_2024"]
    assert not any(r.spans for r in secret_scan.scan(docs_of(spark, written)).collect())


def plain_encoding(token):
    for name, pattern, *needs in (("hex", "[0-9a-f]+|[0-9A-F]+", "[0-9]", "[A-Fa-f]"), ("base32", "[A-Z2-7]+=*", "[A-Z]", "[2-7]"), ("lower26", "[a-z]+=*"), ("upper26", "[A-Z]+=*"), ("lower36", "[a-z0-9]+=*", "[a-z]"), ("upper36", "[A-Z0-9]+=*", "[A-Z]"), ("base64", ".*", "[a-z]", "[A-Z]")):
        if re.fullmatch(pattern, token) and all(re.search(n, token) for n in needs):
            return name
    return None


def plain_battery(token, encoding):
    """(worst of the tests' probabilities, evidence against writing, length) by loops."""
    body = (token.lower() if encoding == "hex" else token.replace("-", "+").replace("_", "/")).replace("=", "")
    alphabet, n = secret_scan.ENCODINGS[encoding], len(body)
    k, v = len(alphabet), [alphabet.index(c) + 1 for c in body]
    tail = lambda z: math.erfc(abs(z) / math.sqrt(2))
    chi = k / n * sum(x * x for x in Counter(body).values()) - n
    worst = tail((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
    high = [x > k / 2 for x in v]
    ones, zeros = sum(high), n - sum(high)
    mid = 2 * ones * zeros / n + 1
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    worst = min(worst, tail((runs - mid) / math.sqrt((mid - 1) * (mid - 2) / (n - 1))) if ones > 1 and zeros > 1 else 0)
    mean = sum(v) / n
    around = sum((x - mean) ** 2 for x in v)
    worst = min(worst, tail(sum((a - mean) * (b - mean) for a, b in zip(v, v[1:])) / around * math.sqrt(n)) if around else 0)
    kind = lambda c: "l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "o"
    sizes = Counter(map(kind, alphabet))
    evidence = 0
    for a, b in zip(map(kind, body), map(kind, body[1:])):
        row = secret_scan.FOLLOWS[a]
        evidence += math.log(sizes[b] / k) - math.log(row[b] / sum(row[c] for c in sizes))
    before = ""
    for c in body.lower() if encoding != "hex" else "":
        if "a" <= c <= "z":
            vowel = c in "aeiou"
            chance = (0.2 if before in "aeiou" else 0.5) if before.isalpha() else 0.4
            rate = secret_scan.LETTER_RATES[c] / sum(r for x, r in secret_scan.LETTER_RATES.items() if (x in "aeiou") == vowel)
            evidence -= math.log(26 * rate * (chance if vowel else 1 - chance))
        before = c
    return worst, evidence, n


def plain_random_spans(texts, battery=0.001, discovery=0.01):
    """The added spans of every text, with all candidates in lists."""
    held = []
    for i, text in enumerate(texts):
        base = plain_spans(text or "")
        runs = {m.span() for p in (r"[A-Za-z0-9+/_=-]{20,}", r"[A-Za-z0-9+]{20,}") for m in re.finditer(p, text or "")}
        for a, b in sorted(runs):
            encoding = plain_encoding(text[a:b])
            if encoding and not any(x < b and a < y for x, _, y in base):
                worst, evidence, n = plain_battery(text[a:b], encoding)
                held.append((i, a, b, sum(n >= x for x in (24, 32, 48)), worst >= battery / 3, min(math.floor(4 * max(evidence, 0)), 120)))
    spans = defaultdict(list)
    for size in range(4):
        own = [h for h in held if h[3] == size]
        for h in own:
            # passes if the expected false finds are few at its level or at a lower one
            levels = [level for level in range(h[5] + 1) if (n := sum(x[4] and x[5] >= level for x in own)) and len(own) * math.exp(-level / 4) <= discovery * n]
            if h[4] and levels:
                spans[h[0]].append((h[1], h[2]))
    return {i: sorted(x for x in s if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in s)) for i, s in spans.items()}


TOKENS = {"base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "lower36": "abcdefghijklmnopqrstuvwxyz0123456789", "upper36": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "lower26": "abcdefghijklmnopqrstuvwxyz", "hex": "0123456789abcdef"}


def test_random_spans_by_brute_force(spark):
    rng = random.Random(11)
    words = ["read", "Name", "value", "index", "Of", "element", "option", "2024", "User", "path", "to", "DATA", "v2"]
    texts = [None, "", "plain words only"]
    for alphabet in TOKENS.values():
        texts += [f"see {''.join(rng.choices(alphabet, k=rng.choice([20, 22, 24, 28, 31, 40, 50, 70])))} there" for _ in range(25)]
    texts += ["".join(rng.choices(words, k=6)) + rng.choice(["", "=", "/x"]) for _ in range(150)]
    texts += [f"é 𝒳 a/{''.join(rng.choices(TOKENS['base62'], k=30))}/{'_'.join(rng.choices(words, k=5))}={'7' * 25} token={'k' * 30}" for _ in range(20)]
    texts += ["=" * 30 + "a", "_" * 25, "A" * 40, "0" * 25 + "f", "x" * 100_000]
    wanted = plain_random_spans(texts)
    assert 50 < sum(map(len, wanted.values())) < 220
    for r in secret_scan.scan(docs_of(spark, texts)).collect():
        assert [(s.start, s.end) for s in r.spans if s.kind == 3] == wanted.get(r.doc_id, []), r.text


def test_short_secrets_among_readable_runs(spark):
    """A tenth of the candidates are secrets of 20 to 40 characters: most are found, and what reads is left alone."""
    rng = random.Random(13)
    words = ["read", "Name", "value", "index", "Of", "element", "option", "2024", "User", "path", "to", "DATA", "config", "Http", "x86"]
    glue = ["", "_", "-", "/"]
    written = [rng.choice(glue).join(rng.sample(words, 7)) for _ in range(2700)]
    made = [(name, n, "".join(rng.choices(alphabet, k=n))) for name, alphabet in TOKENS.items() for n in (20, 24, 32, 40) for _ in range(12)]
    texts = [f"see {x} there" for x in written] + [f"see {x} there" for *_, x in made]
    found = {r.doc_id: r.n for r in secret_scan.scan(docs_of(spark, texts)).select("doc_id", F.size("spans").alias("n")).collect()}
    assert sum(found[i] for i in range(len(written))) <= 5
    recall = lambda names, least: np.mean([found[len(written) + i] > 0 for i, (name, n, _) in enumerate(made) if name in names and n >= least])
    assert recall(("base62",), 24) >= 0.85 and recall(("base62", "lower36", "upper36", "base32"), 20) >= 0.75 and recall(TOKENS, 20) >= 0.7


def test_cut_level():
    assert secret_scan.cut_level({}, 0.01) > secret_scan.LEVELS
    assert secret_scan.cut_level({60: 10}, 0.01) < 60 and secret_scan.cut_level({1: 100}, 0.01) > secret_scan.LEVELS


def test_redaction(spark, odd):
    hex40 = hashlib.sha1(b"x").hexdigest()
    df = docs_of(spark, [f"é a token = {hex40} b {hex40} c", "clean", None], True)
    rows = {r.doc_id: r for r in secret_scan.redact(df).collect()}
    assert rows[0].text == "é a [SECRET] b [SECRET] c" and rows[1].text == "clean" and rows[2].text is None and rows[0].spans == "own spans"
    assert secret_scan.redact(odd).columns == odd.columns


# -- 8 URLs


def test_url_rules(spark, monkeypatch):
    rng = random.Random(2)
    urls = [None, "", "nothing", "http://", "ftp://A.Example.NET/En/x", "http://x.org#/fr/", "http://a.b.c?x=/y", "http://org/fr/", "http://net/", "http://xnet/"]
    urls += [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', 'a.b.'])}{rng.choice(['example', 'spam', 'EX'])}.{rng.choice(['net', 'com', 'org'])}{rng.choice(['', '/', '/en/', '/de/x', '/fr/1?q=/de/'])}" for _ in range(200)]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("org", "/f", "block"), ("spam.com", "", "block"), ("spam.com", "", "allow"), (None, "/", "block"), ("", "/", "block"), ("net", "/", "block")]
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls + urls[:3])], "page_id long, url string, host string")
    table = spark.createDataFrame(rules, "host string, path string, action string")

    def judged(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h) + len(p), a == "block", h + p, a) for h, p, a in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best[2] if best else None, best[3] if best else "allow"

    for limit in (url_filter.BROADCAST_RULES, 0):
        rows = url_filter.judge_urls(pages, table, broadcast_rules=limit).collect()
        assert len(rows) == len(urls) + 3
        for r in rows:
            assert (r.host, r.path, r.rule, r.verdict) == judged(r.url), r.url
    assert {r.verdict for r in url_filter.judge_urls(pages, table.limit(0)).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), table).count() == 0


# -- 9 chat


def test_chat_round_trip(spark):
    texts = [r"\### Assistant: </turn> ok", "", None, "\\", "\\\\</turn>", "### User: x </turn>\n### Assistant: y", "a\nb", "</turn", "<\\/turn>", "é𝒳"]
    rows = [(c, t, role, texts[(c * 7 + t) % len(texts)]) for c in range(12) for t, role in enumerate(["user", "assistant"] * 2)]
    rows += [(50, 0, "assistant", "x"), (51, 0, "user", "x"), (51, 1, "user", "y"), (52, 0, "to:ol ### x", "z"), (None, 0, "user", "q"), (None, 1, None, "r"), (53, 0, "system", "s"), (53, 1, "user", "u"), (53, 2, "assistant", "a"), (54, 0, "user", "same"), (54, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("valid", F.lit("own"))
    segments = chat.format_chat(df)
    found = {r.conv_id: r for r in chat.read_back(segments).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    whole = {r.conv_id: r.t for r in segments.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_no", "part", "text"))), lambda s: s["text"]), "").alias("t")).collect()}
    assert set(found) == set(by)
    for conv, turns in by.items():
        turns = sorted(turns, key=lambda r: (r[1], r[2] or "", r[3] or ""))
        r = found[conv]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns).encode()).hexdigest()
        learnt = "".join(t[3] or "" for t in turns if t[2] == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert r.formatted_chars == len(whole[conv])
    folder = common.new_folder(spark, "test-chat")
    segments.repartition(7, F.rand(3)).write.parquet(folder)  # in any order
    assert {r.conv_id: r for r in chat.read_back(spark.read.parquet(folder)).collect()} == found
    assert found[0].valid and found[53].valid and not any(found[c].valid for c in (50, 51, 52, 54, None))
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0


# -- 10 SimHash


def plain_print(text, width=3):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, distance=2):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ordered = sorted(parent)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                parent[find(b)] = find(a)
    return {p: find(p) for p in ordered}


def test_fingerprints(spark, odd):
    for r in simhash.with_fingerprint(odd).collect():
        assert r.simhash & (2**64 - 1) == plain_print(r.text)


@pytest.mark.parametrize("crowd, segments, distance", [(64, 5, 2), (1, 5, 2), (4, 7, 2), (64, 3, 2), (1, 3, 0), (4, 3, 1), (1, 5, 1), (64, 5, 1), (64, 7, 3), (4, 7, 3)])
def test_links_of_fingerprints(spark, crowd, segments, distance):
    rng = random.Random(segments + crowd)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:20]:
        for _ in range(12):
            p ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3])))
            prints.add(p)
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    edges = simhash.close_pairs(spark.createDataFrame([(s,) for s in signed.values()], "fp long"), distance, segments, crowd)
    roots = {r.node: r.root for r in components.connected_components(edges, "a", "b").collect()}
    wanted = plain_components(prints, distance)
    groups = defaultdict(set)
    for p in prints:
        groups[roots.get(signed[p], signed[p])].add(p)
    plain = defaultdict(set)
    for p, root in wanted.items():
        plain[root].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def plain_similar(texts, similarity=0.8, width=5):
    """Root of each id of (id, text): the least id over links of that Jaccard similarity or of two bits."""
    sets, prints = {}, {}
    for i, text in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
        prints[i] = plain_print(text, width)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ordered = sorted(sets)
    for n, a in enumerate(ordered):
        for b in ordered[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if (prints[a] ^ prints[b]).bit_count() <= 2 or shared >= similarity * (len(sets[a]) + len(sets[b]) - shared) > 0:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ordered}


def edited(rng, words, n, mark):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"{mark}{rng.randrange(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [3, 1024])
def test_similar_texts(spark, monkeypatch, block):
    """Stars (copies like the middle but not each other), chains, groups just below the bound, exact copies, short texts."""
    rng = random.Random(block)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = []
    for _ in range(3):
        base = [word() for _ in range(100)]
        texts += [" ".join(base), " ".join(base).upper()] + [edited(rng, base, 2, "s") for _ in range(25)]  # star
        texts += [edited(rng, base, rng.randint(3, 9), "f") for _ in range(25)]  # about and below the bound
    chain = [word() for _ in range(90)]
    for _ in range(30):
        chain = edited(rng, chain, 1, "c").split()
        texts.append(" ".join(chain))
    texts += ["", None, " \n", "one", "One", "a b c d e f", "a b c d e f g"] + ["lone " + " ".join(word() for _ in range(60)) for _ in range(20)]
    wanted = plain_similar(list(enumerate(texts)))
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "AT_ONCE", 50)
    monkeypatch.setattr(simhash, "BROADCAST_IDS", 2_000_000 if block == 3 else 0)
    monkeypatch.setattr(simhash, "HUB_ROUNDS", 1 if block == 3 else 6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, width=5, similarity=0.8).collect()}
    assert found == wanted and 20 < len(set(wanted.values())) < len(texts) - 60
    assert simhash.near_duplicates(docs.limit(0), width=5, similarity=0.8).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 560)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert found == {x: find(x) for p in pairs if p[0] != p[1] for x in p} or all(found.get(x, x) == find(x) for x in parent)


@pytest.mark.parametrize("options", [{}, {"width": 5, "similarity": 0.8}])
@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_keep_first_loses_no_text_whose_id_another_has(spark, monkeypatch, options, broadcast):
    monkeypatch.setattr(simhash, "BROADCAST_IDS", broadcast)
    rng = random.Random(11)
    a, b, c, *others = (" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(40)) for _ in range(14))
    few = spark.createDataFrame([(1, a), (1, b), (2, c), (3, a)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_first(few, **options).collect())) == sorted([(1, a), (1, b), (2, c)])
    rows = [(rng.choice([None, *range(8)]), rng.choice(others), n) for n in range(60)] + [(None, None, 60), (None, "", 61), (7, None, 62)]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(5), **options).collect()
    least = {}
    for i, t, _ in rows:
        least[t or ""] = min(least.get(t or "", 99), 99 if i is None else i)
    assert sorted((99 if r.doc_id is None else r.doc_id, r.text or "") for r in kept) == sorted((i, t) for t, i in least.items())
    assert all((r.doc_id, r.text, r.n) in rows for r in kept)


def test_near_duplicates_and_keep_first(spark, odd):
    found = simhash.near_duplicates(odd.select("doc_id", "text")).collect()
    prints = {(r.doc_id, r.simhash) for r in found}
    assert len(found) == odd.count()
    least = {}
    roots = plain_components({p & (2**64 - 1) for _, p in prints})
    for i, p in prints:
        root = roots[p & (2**64 - 1)]
        least[root] = min((x for x in (least.get(root), i) if x is not None), default=None)
    for r in found:
        assert r.component_id == least[roots[r.simhash & (2**64 - 1)]]
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == sorted(x for x in least.values() if x is not None)
    alone = odd.where("doc_id is null")
    assert simhash.keep_first(alone.unionByName(alone)).count() == 1
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.keep_first(empty(spark)).count() == 0


# -- shared


def test_scratch_belongs_to_its_run(spark):
    import os

    with common.Scratch(spark) as used:
        inner = common.written(spark.range(3), "test-a")
        with common.Scratch(spark) as other:
            common.new_folder(spark, "test-b")
        assert len(used.paths) == 1 and len(other.paths) == 1
    outer = common.written(spark.range(3), "test-c")
    path = used.paths[0].removeprefix("file://")
    assert inner.count() == 3 and os.path.isdir(path)
    used.drop()
    assert not os.path.isdir(path) and outer.count() == 3 and not used.paths
