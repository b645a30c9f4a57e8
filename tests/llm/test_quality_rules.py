from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import quality_rules as Q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t", "one two", "a b c d e f g h " * 3, "a " * 40, "x y z\nx y z\n\n \nx y z\nq", "# * $ % & | < > £", "é ñ 𝄞 words", " ".join(f"w{i}" for i in range(30)),
    " ".join(f"w{i}" for i in range(10)) + " gap " + " ".join(f"w{i}" for i in range(10)), "long " + "y" * 100_000, "a b c\x1cd",
]


def test_counts(spark, documents):
    rows = Q.counts(documents(*TEXTS)).orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows] == [brute(t) for t in TEXTS]
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in rows)


@pytest.mark.parametrize(("n", "risk"), [(1, 0.1), (10, 0.1), (200, 0.03), (5000, 0.01), (200_000, 0.03)])
def test_binomial_tail(spark, n, risk):
    ks = sorted({0, 1, n // 50, int(n * risk * 0.9), int(n * risk), n - 1, n})
    want = []
    for k in ks:
        terms = [math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(risk) + (n - j) * math.log1p(-risk)) for j in range(k + 1)]
        want.append(math.fsum(terms) if k < n else 1.0)
    got = spark.createDataFrame([(k,) for k in ks], "k bigint").select("k", Q.tail(F.lit(n).cast("long"), F.col("k"), risk).alias("p")).orderBy("k").collect()
    assert [r.p for r in got] == pytest.approx(want, rel=1e-6, abs=1e-12)


def test_risk_is_held_by_the_rules_together(spark, documents):
    """Each rule alone rejects less than the risk of the good documents, all together more: none may."""
    plain = "plain words that go on and on in one line without any trouble at all for many readers of number {} here"
    spoilt = ["## && $$ %% ** || << >> # & $ % " + plain, "!!!! !!!! !!!! !!!! !!!! !!!! " + plain, plain + " " + "y" * 900]
    rows, labels = [], []
    for i in range(6000):
        kind = i % 200
        rows.append((i, (spoilt[kind % 3] if kind < 9 or kind >= 160 else plain).format(i)))
        labels.append((i, int(kind < 160)))
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int")
    docs = documents(*rows)
    counted = Q.counts(docs)
    lost = lambda risk: [r.quality for r in Q.judged(counted, Q.cutoffs(spark, counted, labels, risk=risk, losses=(1,))).filter("NOT kept").join(labels, "doc_id").collect()]
    assert lost(0.03) == []  # 9 of 160 good documents are like the bad ones
    assert sum(lost(0.2)) == 270 and len(lost(0.2)) == 1470


def test_repeated_labels_are_no_further_trials(spark, documents):
    docs = corpus(documents, 200)
    labels = docs.select("doc_id", (F.col("doc_id") % 10 != 0).cast("int").alias("quality"))
    many = labels
    for _ in range(20):
        many = many.union(labels)
    assert all(r.kept for r in Q.verdicts(spark, docs, many).collect())


def corpus(documents, n=1500):
    good = "plain words that go on and on in one line without any trouble at all for many readers of number {} here"
    bad = "$$ ## plain words ** that && go %% on || and <> on in one line with much trouble ## for $$ readers {} here"
    return documents(*[(i, (bad if i % 10 == 0 else good).format(i)) for i in range(n)])


def test_thresholds_catch_bad_and_keep_good(spark, documents):
    docs = corpus(documents)
    labels = docs.select("doc_id", (F.col("doc_id") % 10 != 0).cast("int").alias("quality"))
    rows = Q.verdicts(spark, docs, labels).collect()
    assert all(r.kept == (r.doc_id % 10 != 0) for r in rows)
    kept = Q.good_documents(spark, docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [r.doc_id for r in sorted(rows) if r.kept] or kept.count() == 1350


def test_too_few_labels_reject_nothing(spark, documents):
    docs = corpus(documents, 60)
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(60)], "doc_id bigint, quality int")
    assert all(r.kept for r in Q.verdicts(spark, docs, labels).collect())
    none = labels.filter("false")
    assert all(r.kept for r in Q.verdicts(spark, docs, none).collect())


def test_null_strata_repeated_rows_and_no_rows(spark, documents):
    docs = corpus(documents, 900).withColumn("lang", F.lit(None).cast("string"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 != 0).cast("int").alias("quality"))
    twice = docs.union(docs.limit(1))
    rows = Q.verdicts(spark, twice, labels).collect()
    assert len(rows) == 901 and all(r.kept == (r.doc_id % 10 != 0) for r in rows)
    assert Q.verdicts(spark, docs.filter("false"), labels).count() == 0
    clash = docs.withColumnRenamed("source", "kept").withColumnRenamed("n_chars", "stratum")
    assert Q.good_documents(spark, clash, labels).columns == clash.columns
