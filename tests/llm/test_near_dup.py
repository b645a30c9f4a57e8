from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import kernels, near_dup

rng = random.Random(3)
VOCABULARY = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]


def text(n=120):
    return " ".join(rng.choices(VOCABULARY, k=n))


def edited(t, share):
    return " ".join(rng.choice(VOCABULARY) if rng.random() < share else w for w in t.split())


def shingles(t, width=2):
    w = (t or "").encode().lower().split()
    n = min(width, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()


def brute(rows, width=2):
    sets = [(i, shingles(t, width)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            both = len(a & b)
            if a and b and 100 * both >= 80 * (len(a) + len(b) - both):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets}


def found(spark, documents, rows, width=2):
    got = near_dup.near_duplicates(spark, documents(*rows), width=width).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in got}


def test_equals_brute_force(spark, documents):
    rows, n = [], 0
    for _ in range(60):
        base = text(rng.randint(20, 200))
        for share in (0, 0, 0.02, 0.05, 0.08, 0.11, 0.15):
            rows.append((n, edited(base, share)))
            n += 1
    rng.shuffle(rows)
    assert found(spark, documents, rows) == brute(rows)


def test_five_words(spark, documents):
    rows = []
    for _ in range(30):
        base = text(rng.randint(3, 120))
        rows += [(len(rows) + k, edited(base, share)) for k, share in enumerate((0, 0, 0.01, 0.02, 0.04))]
    assert found(spark, documents, rows, 5) == brute(rows, 5)


def test_templates_below_the_threshold(spark, documents):
    """Families whose members are near each other but mostly not linked."""
    rows = []
    for share in (0.04, 0.055, 0.07):
        base = text(150)
        rows += [(len(rows) + k, edited(base, share)) for k in range(250)]
    assert found(spark, documents, rows) == brute(rows)


def test_rarest_shingles_find_every_link(spark, documents, monkeypatch):
    """A family of which blocks leave most outside: some link, most do not."""
    for name, value in (("FAMILY", 20), ("BLOCK", 16)):
        monkeypatch.setattr(near_dup, name, value)
    base, rows = text(90), []
    for _ in range(40):
        one = edited(base, 0.13)
        rows += [(len(rows) + k, edited(one, share) + " x" * (k % 3)) for k, share in enumerate((0.0, 0.03, 0.06, 0.09))]
    rng.shuffle(rows)
    want = brute(rows)
    assert found(spark, documents, rows) == want and 20 < len({c for _, c in want.values()}) < 150


def test_trees_meet_the_recall():
    depths = [near_dup.forest_shape(n) for n in (0, 1, 1 << 18, (1 << 18) + 1, 1 << 30, 1 << 38)]
    assert [d for d, _ in depths] == [3, 3, 3, 4, 6, 8] and [t for _, t in depths] == sorted(t for _, t in depths)


@pytest.mark.parametrize("more", [16, 1, 0])
def test_large_families_go_by_blocks(spark, documents, monkeypatch, more):
    for name, value in (("FAMILY", 20), ("SMALL", 12), ("MIDDLE", 20), ("PART", 6), ("BLOCK", 16), ("BLOCK_BYTES", 9000), ("MORE_DEPTH", more)):
        monkeypatch.setattr(near_dup, name, value)
    base = text(150)
    rows = [(i, edited(base, rng.choice([0.01, 0.03, 0.06, 0.1]))) for i in range(160)] + [(i, text()) for i in range(160, 200)]
    assert found(spark, documents, rows) == brute(rows)


def test_edges(spark, documents):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "one"), (9, "ONE"), (10, "a b"), (11, "A  b"), (12, "É a"), (13, "é a"), (14, "x" * 300_000), (15, "a b c")]
    got = found(spark, documents, rows)
    assert [got[i] for i in (5, 6, 7)] == [(0, 5), (0, 6), (0, 7)]
    assert got[9] == (1, 8) and got[11] == (1, 10)
    assert got[12] == (1, 12) and got[13] == (1, 13) and got[14] == (1, 14) and got[15] == (1, 15)


def test_repeated_rows_null_ids_and_no_rows(spark, documents):
    t = text()
    got = near_dup.near_duplicates(spark, documents((1, t), (1, t), (2, t), (None, t))).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 1, False), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_dup.near_duplicates(spark, documents((1, t)).filter("false")).count() == 0
    stay = near_dup.one_of_each(spark, documents((1, t), (1, t), (2, t), (None, "z y"), (3, "other words")))
    assert sorted((r.doc_id or 0) for r in stay.collect()) == [0, 1, 3] and stay.columns == documents("x").columns


def test_extra_columns_do_not_clash(spark, documents):
    docs = documents((1, "a b c"), (2, "a b c")).withColumnRenamed("lang", "node").withColumnRenamed("source", "id").withColumnRenamed("n_chars", "comp")
    assert near_dup.near_duplicates(spark, docs, width=2).filter("kept").count() == 1


def test_exact_threshold(spark, documents):
    words = [f"w{i}" for i in range(10)]
    a = " ".join(words)  # 9 shingles
    b = " ".join(words[:9])  # 8 of them: 8 / 9
    c = " ".join([*words[:9], "x", "y"])  # 8 of 9 and 2 more: 8 / 11
    assert found(spark, documents, [(1, a), (2, b)]) == {1: (9, 1), 2: (8, 1)}
    assert found(spark, documents, [(1, a), (2, c)])[2] == (10, 2)


@pytest.mark.parametrize("one_task", [0, 1_000_000])
def test_components_of_a_path(spark, monkeypatch, one_task):
    from sparkloom.llm.common import Workspace

    monkeypatch.setattr(near_dup, "ONE_TASK", one_task)
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a bigint, b bigint").repartition(7)
    got = near_dup.components(Workspace(spark, "t"), edges).collect()
    assert {r.id: r.comp for r in got} == {i: 0 for i in range(1, 61)}


@pytest.mark.parametrize("limit", [1, 7, 1 << 20])
def test_kernels_split_words(limit):
    texts = ["Ab  c\td\x0be", "", None, "x", "long " * 50, "é ß\n\n"]
    for row, stop, data, offsets in kernels.pieces(pa.array(texts), limit):
        starts, ends, at = kernels.words(data, offsets)
        words = [bytes(data[s:e]) for s, e in zip(starts, ends, strict=True)]
        for k in range(row, stop):
            assert words[at[k - row] : at[k - row + 1]] == (texts[k] or "").encode().split()


def test_span_hashes_see_content_only():
    data = np.frombuffer(b"abcXabcYab" + b"q" * 9000 + b"q" * 9000, np.uint8)
    starts, ends = np.array([0, 4, 8, 10, 9010]), np.array([3, 7, 10, 9010, 18010])
    h = kernels.span_hashes(data, starts, ends)
    assert h[0] == h[1] and h[3] == h[4] and len(set(h.tolist())) == 3
