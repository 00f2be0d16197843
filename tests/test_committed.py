"""Tables with commits: writers that meet, replayed batches, untouched files, versions."""

import datetime as dt
import random
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from barweave.operators import store
from barweave.sources.committed import CommittedTable, Conflict


def rows_of(spark, items):
    return spark.createDataFrame([(s, None if m is None else dt.datetime(2024, m, d), x) for s, m, d, x in items], "symbol string, ts timestamp_ntz, x double")


def content(df):
    return sorted((r.symbol, r.ts and (r.ts.month, r.ts.day), r.x) for r in df.collect())


def files(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet")}


KEYS = ["symbol", "ts"]


def test_versions_upserts_and_untouched_files(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"))
    assert table.create(rows_of(spark, [("a", 1, 1, 1.0), ("a", 1, 2, 2.0), ("a", 2, 1, 3.0), ("b", None, 0, 9.0)]), KEYS) == 1
    with pytest.raises(FileExistsError):
        table.create(rows_of(spark, []))
    before = {f for f in files(tmp_path / "t") if "2024-01" in f or "none" in f}
    assert table.upsert(rows_of(spark, [("a", 2, 1, 4.0), ("a", 3, 1, 5.0)]), KEYS, batch="one") == 2
    assert table.append_absent(rows_of(spark, [("a", 2, 1, 0.0), ("c", 2, 1, 6.0)]), KEYS) == 3
    assert content(table.read()) == [("a", (1, 1), 1.0), ("a", (1, 2), 2.0), ("a", (2, 1), 4.0), ("a", (3, 1), 5.0), ("b", None, 9.0), ("c", (2, 1), 6.0)]
    now = table._manifest()["months"]
    assert now["2024-01"] == table._manifest(1)["months"]["2024-01"] and before <= files(tmp_path / "t")
    assert content(table.read(1)) == [("a", (1, 1), 1.0), ("a", (1, 2), 2.0), ("a", (2, 1), 3.0), ("b", None, 9.0)]
    part = table.read(start="2024-01-02", end="2024-03-01")
    assert content(part) == [("a", (1, 2), 2.0), ("a", (2, 1), 4.0), ("c", (2, 1), 6.0)]
    assert all("2024-01" in f or "2024-02" in f or "2024-03" in f for f in part.inputFiles()) and len(part.inputFiles()) < len(table.read().inputFiles())
    assert table.replace_between(rows_of(spark, [("d", 1, 2, 7.0)]), "2024-01-02", "2024-03-01") == 4
    assert content(table.read()) == [("a", (1, 1), 1.0), ("a", (3, 1), 5.0), ("b", None, 9.0), ("d", (1, 2), 7.0)]
    with pytest.raises(ValueError):
        table.read(9)
    with pytest.raises(ValueError):
        table.upsert(rows_of(spark, []), ["symbol"])
    table.forget(4)
    assert table.versions() == [4] and len(content(table.read())) == 4


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"))
    first = rows_of(spark, [("a", 1, 1, 1.0)])
    assert table.upsert(first, KEYS, batch="x") == 1
    assert table.upsert(rows_of(spark, [("a", 1, 1, 2.0)]), KEYS, batch="y") == 2
    held = files(tmp_path / "t")
    assert table.upsert(first, KEYS, batch="x") == 2 and files(tmp_path / "t") == held and content(table.read()) == [("a", (1, 1), 2.0)]
    assert table.upsert(first.limit(0), KEYS) == 2


def test_writers_that_meet_lose_no_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    write = lambda i: CommittedTable(spark, path).upsert(rows_of(spark, [(f"s{i}", 1 + i % 2, 1, float(i)), ("all", 1, 1, float(i))]), KEYS, batch=f"b{i}", tries=40)
    with ThreadPoolExecutor(5) as pool:
        versions = list(pool.map(write, range(5)))
    assert sorted(versions) == [1, 2, 3, 4, 5]
    found = content(CommittedTable(spark, path).read())
    assert [r[0] for r in found] == ["all", *(f"s{i}" for i in range(5))]
    assert found[0][2] == float(versions.index(5))


def test_the_second_of_two_writers_begins_again(spark, tmp_path, monkeypatch):
    table, other = (CommittedTable(spark, str(tmp_path / "t")) for _ in range(2))
    table.create(rows_of(spark, [("a", 1, 1, 1.0)]))
    publish, tries = table._publish, []

    def late(manifest):
        tries.append(manifest["version"])
        if len(tries) == 1:
            other.upsert(rows_of(spark, [("a", 1, 1, 5.0), ("b", 1, 3, 6.0)]), KEYS)
        return publish(manifest)

    monkeypatch.setattr(table, "_publish", late)
    assert table.append_absent(rows_of(spark, [("b", 1, 3, 0.0), ("c", 1, 4, 7.0)]), KEYS) == 3 and tries == [2, 3]
    assert content(table.read()) == [("a", (1, 1), 5.0), ("b", (1, 3), 6.0), ("c", (1, 4), 7.0)]
    monkeypatch.setattr(table, "_publish", lambda manifest: False)
    with pytest.raises(Conflict):
        table.upsert(rows_of(spark, [("z", 1, 1, 0.0)]), KEYS, tries=2)
    assert len(files(tmp_path / "t")) == len({f for v in table.versions() for f in CommittedTable(spark, str(tmp_path / "t")).read(v).inputFiles()})


def test_new_columns_and_random_batches(spark, tmp_path):
    table, want, rng = CommittedTable(spark, str(tmp_path / "t")), {}, random.Random(3)
    for turn in range(4):
        batch = [(rng.choice("ab"), rng.randint(1, 3), rng.randint(1, 4), float(rng.randint(0, 99))) for _ in range(8)]
        table.upsert(rows_of(spark, batch).withColumn("at", F.col("x")), KEYS, newest="at")
        best = {}
        for s, m, d, x in batch:
            best[s, (m, d)] = max(x, best.get((s, (m, d)), -1))
        want |= best
    assert content(table.read()) == sorted((s, t, x) for (s, t), x in want.items())
    table.upsert(rows_of(spark, [("n", 1, 1, 1.0)]).withColumn("more", F.lit("m")), KEYS)
    assert {r.symbol: (r.more, r["at"]) for r in table.read().collect()}["n"] == ("m", None) and len(content(table.read())) == len(want) + 1


def test_one_per_key_does_not_depend_on_the_partitions(spark):
    df = spark.createDataFrame([(i % 3, i % 7, f"v{i}") for i in range(60)], "k int, at int, v string")
    one = lambda n, newest: sorted(map(tuple, store.one_per_key(df.repartition(n), ["k"], newest).collect()))
    assert one(1, None) == one(7, None) and one(1, "at") == one(5, "at") and all(r[1] == 6 for r in one(2, "at"))
