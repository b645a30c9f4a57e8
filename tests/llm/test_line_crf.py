from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa

from sparkloom.llm import kernels, line_crf


def features(*texts):
    (_, _, data, offsets), = list(kernels.pieces(pa.array(texts)))
    return line_crf.line_features(data, offsets)


def test_lines_and_neighbours():
    x, size, text = features("Good line here.\n\n| a | b |\nLAST!! ONE!!", None, " \n", "one\none")
    assert text.tolist() == [0, 0, 0, 1, 2, 3, 3] and size.tolist() == [13, 5, 11, 1, 1, 3, 3]
    n = line_crf.SHARED
    assert np.allclose(x[1, line_crf.OWN : line_crf.OWN + n], x[0, :n]) and np.allclose(x[1, line_crf.OWN + n :], x[2, :n])
    assert not x[3, line_crf.OWN :].any() and x[6, 6] == 1 and x[5, 6] == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    score, trans = rng.normal(size=9), rng.normal(size=(2, 2))
    first, lengths = np.array([0, 4, 5]), np.array([4, 1, 4])
    share = rng.random(9)
    good, pairs = line_crf.marginals(score, first, lengths, trans, share)
    expect, expect_pairs = np.zeros(9), np.zeros((2, 2))
    for f, n in zip(first, lengths):
        total = 0.0
        for ys in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(score[f + i] * y for i, y in enumerate(ys)) + sum(trans[a, b] for a, b in zip(ys, ys[1:])))
            total += w
        for ys in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(score[f + i] * y for i, y in enumerate(ys)) + sum(trans[a, b] for a, b in zip(ys, ys[1:]))) / total
            for i, y in enumerate(ys):
                expect[f + i] += w * y
                if i:
                    expect_pairs[ys[i - 1], y] += w * share[f + i]
    assert np.allclose(good, expect) and np.allclose(pairs, expect_pairs)


def test_held_out_accuracy(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = line_crf.op7_line_crf_quality(spark, sf_dir).join(labels, "doc_id").collect()
    assert len(rows) == labels.count() and docs.count() == line_crf.op7_line_crf_quality(spark, sf_dir).count()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    assert all(0 <= r.score <= 1 and (r.predicted == 1) == (r.score >= 0.3) for r in rows)


def plain_features(text):
    """(own features, size) of each line with a word, byte by byte."""
    kinds = {k: set(v) for k, v in line_crf._KINDS.items()}
    out, seen = [], set()
    for line in (text or "").encode().split(b"\n"):
        words = line.split()  # the same white space, for bytes
        solid = b"".join(words)
        n, w = max(len(solid), 1), max(len(words), 1)
        count = {k: sum(c in v for c in line) for k, v in kinds.items()}
        stutter = sum(a == b for a, b in zip(words, words[1:]))
        row = [count["symbol"] / n, count["upper"] / n, count["digit"] / n, min(count["bang"] / w, 2), min(count["pipe"] / w, 2), count["stop"] / n, line in seen, stutter / w, math.log1p(len(words)) / 5, n / w / 10, len(words) < 4, count["symbol"] > len(words) / 2, count["upper"] > n / 2, 1]
        if line:
            seen.add(line)
        if words:
            out.append((row, len(solid)))
    return out or [([0.0] * (line_crf.OWN - 1) + [1], 1)]


def plain_score(model, text):
    """A document's score, state by state and line by line."""
    lines, n = plain_features(text), line_crf.SHARED
    none = [0.0] * n
    full = [[*row, *(lines[i - 1][0][:n] if i else none), *(lines[i + 1][0][:n] if i + 1 < len(lines) else none)] for i, (row, _) in enumerate(lines)]
    local = [sum((x - m) / s * w for x, m, s, w in zip(row, model.mean, model.scale, model.weights)) for row in full]
    alpha, beta = [[0.0, local[0]]], [[0.0, 0.0]]
    add = np.logaddexp
    for x in local[1:]:
        a = alpha[-1]
        alpha.append([add(a[0] + model.trans[0, y], a[1] + model.trans[1, y]) + x * y for y in (0, 1)])
    for x in reversed(local[1:]):
        b = beta[-1]
        beta.append([add(model.trans[y, 0] + b[0], model.trans[y, 1] + x + b[1]) for y in (0, 1)])
    good = [1 / (1 + math.exp(min(700, a[0] + b[0] - a[1] - b[1]))) for a, b in zip(alpha, reversed(beta))]
    quality = sum(g * size for g, (_, size) in zip(good, lines)) / sum(size for _, size in lines)
    q = min(max(quality, 1e-4), 1 - 1e-4)
    return 1 / (1 + math.exp(-(model.slope * math.log(q / (1 - q)) + model.shift)))


def test_scores_of_all_documents_against_a_plain_version(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = line_crf.train(spark, docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in line_crf.op7_line_crf_quality(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        assert math.isclose(got[i], plain_score(model, text), rel_tol=1e-6, abs_tol=1e-9)


def test_labels_of_held_out_rows_do_not_matter(spark, documents):
    from pyspark.sql import functions as F

    docs = documents(*[(i, "| x | y |\n" * 9 if i % 3 == 0 else f"A normal line number {i}.\nAnd one more.") for i in range(60)])
    labels = docs.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = line_crf.train(spark, docs, labels), line_crf.train(spark, docs, flipped)
    assert np.array_equal(a.weights, b.weights) and a.shift == b.shift
    scores = {r.doc_id: r.score for r in line_crf.score(docs, a).collect()}
    assert max(scores[i] for i in range(0, 60, 3)) < min(scores[i] for i in range(1, 60, 3))


def test_edges(spark, documents):
    docs = documents(None, "", "x" * 100_000, "a\n" * 3000).withColumnRenamed("lang", "score")
    model = line_crf.train(spark, docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    rows = line_crf.score(docs, model).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert line_crf.score(docs.filter("false"), model).count() == 0


def test_long_documents_and_repeated_rows_take_part_once(spark, documents, monkeypatch):
    rows = [(i, "| x | y |\n" * 900 if i % 2 else f"A normal line number {i}.\nAnd one more.") for i in range(40)]
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(40)], "doc_id bigint, quality int")
    one = line_crf.train(spark, documents(*rows), labels)
    scores = {r.doc_id: r.score for r in line_crf.score(documents(*rows), one).collect()}
    assert max(scores[i] for i in range(1, 40, 2)) < 0.3 < min(scores[i] for i in range(0, 40, 2))
    again = line_crf.train(spark, documents(*rows, *rows[:9]), labels.union(labels))
    assert np.array_equal(one.weights, again.weights) and one.shift == again.shift
    assert line_crf.score(documents(*rows, *rows[:9]), one).count() == 49
    monkeypatch.setattr(line_crf, "TRAIN_SEQUENCES", 10)
    assert 0 <= line_crf.train(spark, documents(*rows), labels).score(np.array([0.5]))[0] <= 1
