from __future__ import annotations

import duckdb
import numpy as np
import pytest

from sparkloom.llm import mixing
from sparkloom.llm.common import Workspace


def test_shares_stop_at_the_cap(spark):
    totals = spark.createDataFrame([("a", 100, 3.0), ("b", 1000, 1.0), ("c", 100, 2.0), (None, 10, 3.0)], "value string, size bigint, weight double")
    got = {r.value: r.target for r in mixing.capped_shares(totals, 1.5 * 1210, 2).collect()}
    assert got["a"] == 200 and got["c"] == 200 and got[None] == 20 and got["b"] == pytest.approx(1815 - 420)
    assert {r.value: r.target for r in mixing.capped_shares(totals, 1e6, 2).collect()} == {"a": 200, "b": 2000, "c": 200, None: 20}
    assert mixing.capped_shares(totals.filter("false"), 0, 2).collect() == []


#: Sizes, source sizes and targets, the part of the contract that SQL can say.
FACTS = r"""
WITH RECURSIVE s AS (SELECT source, coalesce(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))), 0)::BIGINT AS n FROM documents GROUP BY source),
w AS (SELECT *, ([3, 1, 2])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
steps AS (
    SELECT 0 AS k, 1.5 * (SELECT sum(n) FROM w) / (SELECT sum(weight) FROM w) AS level
    UNION ALL
    SELECT k + 1, (SELECT (1.5 * sum(n) - coalesce(sum(2 * n) FILTER (weight * level > 2 * n), 0)) / nullif(sum(weight) FILTER (weight * level <= 2 * n), 0) FROM w)
    FROM steps WHERE k < 20 AND level IS NOT NULL
)
SELECT source, n AS source_size, least(2 * n, weight * coalesce((SELECT level FROM steps WHERE k = 20), 1e18))::DOUBLE AS target FROM w"""


def test_targets_equal_sql(spark, sf_dir):
    found = {r.source: (r.source_size, r.target) for r in mixing.op6_mix_sources(spark, sf_dir).select("source", "source_size", "target").distinct().collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
    want = con.sql(FACTS).fetchall()
    assert {s for s, _, _ in want} == set(found) and all(found[s] == (n, pytest.approx(t, rel=1e-9)) for s, n, t in want)


def test_many_sources_in_code_point_order(spark):
    names = [f"s{i}" for i in range(500)] + ["", "Z", "é", "\uffee", "\U00010000", None]
    df = spark.createDataFrame([(n, 10) for n in names], "source string, size bigint").repartition(7)
    got = {r.value: r.weight for r in mixing.source_targets(spark, df).collect()}
    order = sorted((n for n in names if n is not None), key=lambda n: [ord(c) for c in n]) + [None]
    assert got == {n: (3.0, 1.0, 2.0)[i % 3] for i, n in enumerate(order)}


def test_rows_that_repeat_are_split(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 7)
    docs = documents(*[(None, "a b c")] * 400, *[(1, "d e f g")] * 300, *[(i, "h " * i) for i in range(2, 60)])
    rows = mixing.mix_documents(spark, docs).collect()
    assert len(rows) == 758 and sum(r.doc_id is None for r in rows) == 400 and sum(r.doc_id == 1 for r in rows) == 300
    assert all(0 <= r.copies <= 2 and r.taken == r.copies * r.size for r in rows)
    assert abs(sum(r.taken for r in rows) - rows[0].target) <= 2


def test_long_texts_and_clashing_columns(spark, documents):
    docs = documents((1, "w " * 200_000), (2, "v " * 150_000), (3, "u"), (4, None))
    clash = docs.withColumnRenamed("lang", "size").withColumnRenamed("n_chars", "target")
    a, b = (sorted((r.doc_id, r.size, r.taken) for r in mixing.mix_documents(spark, d).collect()) for d in (docs, clash))
    assert a == b and [n for _, n, _ in a] == [200_000, 150_000, 1, 0]
    assert mixing.repeated(spark, clash).columns == clash.columns


def test_two_margins_are_met(spark):
    cells = spark.createDataFrame([("a", "x", 100), ("a", "y", 300), ("b", "x", 200), ("b", "y", 50)], "source string, lang string, size bigint")
    goal = {"source": {"a": 500.0, "b": 300.0}, "lang": {"x": 350.0, "y": 450.0}}
    tables = {name: spark.createDataFrame(list(goal[name].items()), "value string, target double") for name in goal}
    found = {name: {r.value: r.x for r in t.collect()} for name, t in mixing.balance(Workspace(spark, "t"), cells, tables).items()}
    taken = {(r.source, r.lang): r.size * np.exp(found["source"][r.source] + found["lang"][r.lang]) for r in cells.collect()}
    assert sum(v for (s, _), v in taken.items() if s == "a") == pytest.approx(500, rel=1e-6)
    assert sum(v for (_, x), v in taken.items() if x == "y") == pytest.approx(450, rel=1e-6)


def _met(spark, cells, goal, most=np.inf):
    tables = {name: spark.createDataFrame(list(goal[name].items()), "value string, target double") for name in goal}
    found = {name: {r.value: r.x for r in t.collect()} for name, t in mixing.balance(Workspace(spark, "t"), cells, tables, most=most).items()}
    rates = {tuple(r[n] for n in goal): min(most, np.exp(sum(found[n][r[n]] for n in goal))) for r in cells.collect()}
    return rates, {n: {v: sum(r.size * rates[tuple(r[m] for m in goal)] for r in cells.collect() if r[n] == v) for v in goal[n]} for n in goal}


def test_three_margins_are_met(spark):
    rng = np.random.default_rng(3)
    rows = [(a, b, c, int(n)) for (a, b, c), n in zip(((a, b, c) for a in ("a", "b", None) for b in "uvwx" for c in "pq"), rng.integers(1, 5000, 24), strict=True)]
    cells = spark.createDataFrame(rows, "source string, lang string, kind string, size bigint")
    tilt = {(a, b, c): float(np.exp(rng.normal(0, 0.4))) for a, b, c, _ in rows}  # what some rates reach can be reached
    goal = {name: {v: sum(r[3] * tilt[r[:3]] for r in rows if r[k] == v) for v in {r[k] for r in rows}} for k, name in enumerate(("source", "lang", "kind"))}
    _, reached = _met(spark, cells, goal)
    assert all(reached[n][v] == pytest.approx(goal[n][v], rel=1e-6) for n in goal for v in goal[n])


def test_rates_stop_at_the_cap_and_targets_are_met_still(spark):
    cells = spark.createDataFrame([("a", "x", 100), ("a", "y", 100), ("b", "x", 100), ("b", "y", 100)], "source string, lang string, size bigint")
    goal = {"source": {"a": 310.0, "b": 90.0}, "lang": {"x": 230.0, "y": 170.0}}
    rates, reached = _met(spark, cells, goal, 1.6)
    assert rates["a", "x"] == pytest.approx(1.6) and rates["a", "y"] == pytest.approx(1.5, rel=1e-6)
    assert all(reached[n][v] == pytest.approx(goal[n][v], rel=1e-6) for n in goal for v in goal[n])
    assert _met(spark, cells, goal)[0]["a", "x"] > 1.6


def test_targets_that_contradict_each_other_are_an_error(spark):
    cells = spark.createDataFrame([("a", "u", 100), ("b", "v", 100)], "p string, q string, size bigint")
    with pytest.raises(ValueError, match="no rates meet"):
        _met(spark, cells, {"p": {"a": 100.0, "b": 100.0}, "q": {"u": 150.0, "v": 50.0}})
    with pytest.raises(ValueError, match="different totals"):
        _met(spark, cells, {"p": {"a": 100.0, "b": 100.0}, "q": {"u": 150.0, "v": 150.0}})
    with pytest.raises(ValueError, match="no rates meet"):
        _met(spark, cells, {"p": {"a": 300.0, "b": 100.0}, "q": {"u": 300.0, "v": 100.0}}, most=2.0)


def test_values_without_a_target_are_left_out(spark):
    cells = spark.createDataFrame([("a", "x", 100), ("b", "x", 100), ("c", "y", 100)], "source string, lang string, size bigint")
    rates, _ = _met(spark, cells, {"source": {"a": 50.0, "b": 0.0, "c": 70.0}, "lang": {"x": 50.0, "y": 70.0}})
    assert rates["b", "x"] == 0 and rates["a", "x"] == pytest.approx(0.5) and rates["c", "y"] == pytest.approx(0.7)


def test_rounding_follows_the_rates():
    rng = np.random.default_rng(0)
    sizes = -np.sort(-rng.integers(1, 3000, 500))
    copies = mixing.round_block(sizes, np.full(500, 0.7), 2)
    assert set(copies) <= {0, 1, 2} and abs((copies * sizes).sum() - 0.7 * sizes.sum()) <= sizes[-1]


def test_rounding_near_the_most_copies():
    rng = np.random.default_rng(1)
    for n in (5, 12, 40):
        for rate in (0.05, 0.5, 1.87, 1.99):
            sizes = -np.sort(-rng.integers(1, 3000, n))
            copies = mixing.round_block(sizes, np.full(n, rate), 2)
            assert copies.min() >= 0 and copies.max() <= 2
            miss = abs((copies * sizes).sum() - rate * sizes.sum())
            assert miss <= (0.03 if n > 5 else 0.2) * max(sizes.sum() * min(rate, 1), sizes[0])


def test_documents(spark, documents):
    docs = documents(*[(i, "w " * (i % 50)) for i in range(600)], source="a").union(documents(*[(i, "w " * 20) for i in range(600, 700)], source="b")).union(documents((700, None), (701, ""), (702, "one two"), source=None))
    rows = mixing.mix_documents(spark, docs).collect()
    assert len(rows) == 703
    for s in ("a", "b", None):
        mine = [r for r in rows if r.source == s]
        assert sum(r.size for r in mine) == mine[0].source_size
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 2
        assert all(0 <= r.taken <= 2 * r.size for r in mine)
    again = {(r.doc_id, r.taken) for r in mixing.mix_documents(spark, docs.repartition(3)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_repeated_rows_and_none(spark, documents):
    docs = documents((1, "a b c"), (1, "a b c"), (2, "d e f"), (None, "g h i"), (None, "j k l"))
    out = mixing.repeated(spark, docs)
    assert out.columns == docs.columns and 6 <= out.count() <= 9
    assert mixing.mix_documents(spark, docs.filter("false")).count() == 0
