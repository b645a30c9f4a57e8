"""The stages against what they promise, over a whole small table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_near_dup import brute  # noqa: E402


def test_stages(spark, sf_dir):
    from sparkloom.llm import mixing, packing, quality_rules, surrogates

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    kept = {r.doc_id for r in quality_rules.verdicts(spark, docs, labels).filter("kept").collect()}
    outs, now = [], docs
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf_dir)
        now = spark.createDataFrame(out.collect(), out.schema)
        outs.append(now)
    good, single, private, mixed, packed = (o.collect() for o in outs)
    assert {r.doc_id for r in good} == kept and all(o.columns == docs.columns for o in outs[:4])
    classes = brute([(r.doc_id, r.text) for r in good], 5)
    assert {r.doc_id for r in single} == {i for i, (_, c) in classes.items() if c == i}
    found = {r.doc_id: r.n_entities for r in surrogates.replace(spark, outs[1]).collect()}
    before = {r.doc_id: r.text for r in single}
    assert all((r.text == before[r.doc_id]) == (found[r.doc_id] == 0) and r.n_chars == len(r.text) for r in private)
    facts = mixing.source_targets(spark, outs[2].withColumn("size", mixing.word_count("text"))).collect()
    sizes, targets = {r.value: r.size for r in facts}, {r.value: r.target for r in facts}
    for source, target in targets.items():
        words = sum(len(r.text.split()) for r in mixed if r.source == source)
        sums = 1  # bit n: whole copies can make n words
        for r in private:
            if r.source == source:
                n = len(r.text.split())
                sums |= sums << n | sums << 2 * n
        best = min(abs(n - target) for n in range(sums.bit_length()) if sums >> n & 1)
        assert abs(words - target) <= best + 0.005 * sizes[source]
    assert {(r.doc_id, r.text) for r in mixed} <= {(r.doc_id, r.text) for r in private}
    assert len([r for r in packed if r.piece == 0]) == len(mixed) and max(r.length for r in packed) <= packing.CAPACITY


def test_run_equals_the_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    fill: dict[int, int] = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 4096 and len(fill) <= -(-sum(fill.values()) // 4096) + 2


EDGES = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t", None, None, 3), (None, None, None, None, None), (None, "some words " * 30, "en", "b", 330), (4, "x " * 40_000, "de", "a", 80_000)]


def rows_of(n):
    return [(100 + i, f"This is line {i} of plain text and it has quite a few words in it, mail a{i}@example.org, so that it is kept. " + " ".join(f"w{i}x{k}" for k in range(30)), "en", "ab"[i % 2], 0) for i in range(n)]


def through(spark, docs, sf_dir):
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(out.collect(), out.schema)
        outs.append(docs)
    return outs


def test_nulls_empty_texts_and_repeated_rows(spark, documents, sf_dir):
    schema = documents("x").schema
    rows = rows_of(12)
    docs = spark.createDataFrame(EDGES + rows + rows[:4] + rows[:1], schema)
    good, single, private, mixed, packed = through(spark, docs, sf_dir)
    assert {r.doc_id for r in good.collect()} == {r[0] for r in rows} and good.count() == 17
    assert sorted(r.doc_id for r in single.collect()) == sorted(r[0] for r in rows)
    assert all("@" in r.text and "example" not in r.text for r in private.collect())
    assert {r.text for r in mixed.collect()} <= {r.text for r in private.collect()}
    assert packed.filter("piece = 0").count() == mixed.count()
    # without the first stage, the others meet the empty texts and null ids too
    after = spark.createDataFrame(EDGES + EDGES + rows, schema)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, after, sf_dir)
        assert out.columns == schema.names
        after = spark.createDataFrame(out.collect(), out.schema)
    assert corpus_pipeline.STAGES[4][1](spark, after, sf_dir).filter("length < 1").count() == 0


def test_an_empty_table_and_extra_columns(spark, documents, sf_dir):
    schema = documents("x").schema
    assert [o.count() for o in through(spark, spark.createDataFrame([], schema), sf_dir)] == [0] * 5
    clash = {c: F.lit(7) for c in ("size", "n_entities", "component_id", "kept", "row", "stratum", "key", "id", "target")}
    outs = through(spark, spark.createDataFrame(rows_of(6), schema).withColumns(clash), sf_dir)
    assert all(o.columns == schema.names for o in outs[:4]) and outs[0].count() == 6
