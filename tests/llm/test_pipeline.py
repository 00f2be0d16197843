"""The pipeline's stages against what each operator's brute force says of its own input."""

import itertools
import random

import corpus_pipeline
from barweave.llm.common import written
from .test_operators import counts, plain_hits, plain_similar, plain_spans

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "packing"]

    def step(name, df):
        found = stages[name](spark, df, SF)
        out = {r.doc_id: r for r in found.collect()} if name != "packing" else found.collect()
        if name != "packing":
            assert found.columns == docs.columns
        return out, found

    before = {r.doc_id: r for r in docs.collect()}
    kept, df = step("quality_rules", docs)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for i, r in before.items():
        n = counts(r.text)
        if n[0] < 50 or 2 * n[4] > n[0]:
            assert i not in kept
        elif labels.get(i) == 1:
            assert i in kept

    roots = plain_similar([(i, r.text) for i, r in kept.items()])
    single, df = step("near_dedup", df)
    assert set(single) == set(roots.values())

    clean, df = step("decontamination", df)
    assert set(clean) == {i for i, r in single.items() if not plain_hits(r.text, benchmark)[1]}

    masked, df = step("secret_scan", df)
    assert set(masked) == set(clean)
    for i, r in clean.items():
        if plain_spans(r.text):
            assert not plain_spans(masked[i].text) and "[SECRET]" in masked[i].text
        assert masked[i].n_chars == len(masked[i].text)

    pieces, _ = step("packing", df)
    assert {p.doc_id for p in pieces} == set(masked) and sum(p.n_units for p in pieces) == sum(counts(r.text)[0] for r in masked.values())
    whole = corpus_pipeline.run(spark, SF)
    assert whole.count() == len(pieces)
    texts = {}
    for r in sorted(whole.collect(), key=lambda r: r.piece):
        texts[r.doc_id] = texts.get(r.doc_id, "") + r.text
    assert texts == {i: r.text for i, r in masked.items()}


def test_odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, ties and columns with the stages' own names."""
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(n)) + "."
    long, copy, secret = prose(30_000), prose(80), prose(60) + " password = abcdefgh12 " + prose(60)
    rows = [(1, long), (2, copy), (2, copy), (3, copy.upper()), (4, None), (5, ""), (6, secret), (None, copy), (None, prose(70)), (None, None), (7, prose(90)), (8, " \n ")]
    docs = spark.createDataFrame([(i, t, None if (i or 0) % 2 else "en", None if i == 6 else "web", f"own {n}", f"own {n}") for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, kept string, component_id string")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test-odd")
        assert name == "packing" or docs.columns == columns
    texts = {}
    for r in sorted(docs.collect(), key=lambda r: r.piece):
        texts[r.doc_id] = texts.get(r.doc_id, "") + r.text
    assert set(texts) == {1, 2, 6, 7, None} and texts[1] == long and texts[6] == secret.replace("password = abcdefgh12", "[SECRET]")


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_near_copies_go(spark):
    """Copies with a few words changed, too far apart for two bits, go; texts below the bound stay."""
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(5000)]
    rows = []
    for i in range(40):
        words = rnd.choices(vocabulary, k=rnd.randint(60, 300))
        rows.append((10 * i, " ".join(words), "en", "web"))
        for copy in range(1, 4):
            changed = list(words)
            for at in rnd.sample(range(len(words)), max(1, len(words) * copy // 60)):
                changed[at] = "other"
            rows.append((10 * i + copy, " ".join(changed), "en", "web"))
    hub = rnd.choices(vocabulary, k=80)  # a crowded bucket: more than 64 texts
    rows += [(1000 + i, " ".join([*hub, f"tail{i}"]), "en", "web") for i in range(150)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if 10 * shared >= 8 * (len(sets[a]) + len(sets[b]) - shared):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    wanted = {find(i) for i in sets}
    assert 42 < len(wanted) < 150
    docs = spark.createDataFrame([*rows, (None, rows[0][1] + " end", "en", "web")], "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, SF).collect()} == wanted
