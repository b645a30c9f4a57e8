from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import sharding


def placed(spark, n, weights):
    return {r.id: r.s for r in spark.range(n).select("id", sharding.rendezvous(sharding.draws(F.col("id"), len(weights)), weights).alias("s")).collect()}


def test_one_more_shard_takes_rows_only_into_itself(spark):
    old, new = placed(spark, 4000, [1] * 16), placed(spark, 4000, [1] * 17)
    moved = {i for i in old if old[i] != new[i]}
    assert all(new[i] == 16 for i in moved) and 150 < len(moved) < 330


def test_weights(spark):
    got = Counter(placed(spark, 6000, [1, 2, 0, 3]).values())
    assert got[2] == 0 and abs(got[1] / got[0] - 2) < 0.35 and abs(got[3] / got[0] - 3) < 0.5
    for bad in ([0, 0], [-1, 2], []):
        with pytest.raises(ValueError):
            sharding.rendezvous(sharding.draws(F.col("id"), len(bad)), bad)


def test_slots(spark, documents):
    docs = documents(*[(i % 400, f"t{i % 400}") for i in range(900)], (None, "n"), (None, None))
    rows = sharding.assign(docs, "doc_id", [1.0] * 4).collect()
    assert len(rows) == 902
    for s in range(4):
        mine = sorted(r.slot for r in rows if r.shard == s)
        assert mine == list(range(len(mine)))
    assert all(r.grown_shard is None for r in rows)
    assert len({r.shard for r in rows if r.doc_id is None}) == 1


def test_empty_and_clashing(spark, documents):
    assert sharding.assign(documents("a").filter("false"), "doc_id", [1.0]).count() == 0
    docs = documents("a", "b").withColumnRenamed("lang", "shard").withColumnRenamed("source", "slot")
    assert sorted(r.slot for r in sharding.assign(docs, "doc_id", [1.0]).collect()) == [0, 1]


def test_equal_rows_and_rows_without_a_key_are_numbered(spark, documents, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 7)
    docs = documents(*[(None, f"t{i}") for i in range(300)], *[(None, "same")] * 200, *[(5, "x" * 100_000)] * 30)
    rows = sharding.assign(docs, "doc_id", [1.0, 1.0], [1.0] * 3, ["text"]).collect()
    assert len(rows) == 530 and len({r.shard for r in rows if r.doc_id is None}) == 1
    for s in (0, 1):
        mine = sorted(r.slot for r in rows if r.shard == s)
        assert mine == list(range(len(mine)))
    assert all(r.grown_shard in (r.shard, 2) for r in rows)
