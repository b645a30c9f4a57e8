"""Quality rules with risk-controlled thresholds.

Every rule is a level from 0 to 1000 (a ratio in thousandths); a document whose level is above
the rule's cutoff is rejected.  Cutoffs come from labelled documents, stratum by stratum.  One half
of the labels proposes joint sets of cutoffs, from cautious to strict.  The other half is held out
to test them in this order: a set is certified as long as the exact binomial (Clopper-Pearson) bound
on the good documents that any of its rules rejects shows that at most ``risk`` of the stratum's good
documents are lost.  The first set that fails ends the sequence, which needs no further correction;
the error of being wrong in any stratum is ``error``, split over the strata (Bonferroni).  The last
certified set is taken; where there is none, the rules reject nothing.

DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD, Workspace, table, words

RISK = 0.03
ERROR = 0.05
#: A good document lost costs as much as so many bad ones caught: one set of cutoffs for each, in the order of the tests.
LOSSES = (1000, 200, 50, 20)
WINDOW = 8

#: Rule -> its level as SQL over the counts.
RULES = {
    "symbols": "least(1000, 1000 * n_symbols div greatest(n_words, 1))",
    "dup_lines": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "repeats": "1000 * n_repeat_words div greatest(n_words, 1)",
    "shouting": "least(1000, 1000 * n_bangs div greatest(n_words, 1))",
    "long_words": "least(1000, 10 * word_chars div greatest(n_words, 1))",
}


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where inner lambdas use it."""
    return F.transform(F.array(value), body)[0]


def _covered(hashes: Column) -> Column:
    """Words inside windows (given by hash, in order) that occur twice or more."""

    def spans(s: Column) -> Column:
        same = lambda e, j: ((j > 0) & (F.get(s, j - 1)["h"] == e["h"])) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False))
        at = F.sort_array(F.transform(F.filter(s, same), lambda e: e["i"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"))
        return F.aggregate(at, zero, step, lambda a: a["n"])

    return _let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), spans)


def counts(docs: DataFrame, keep: Column | None = None) -> DataFrame:
    """``doc_id``, ``stratum`` (lang) and the counts of each document; null and blank texts count nothing.

    ``keep`` is carried along as a column ``row``.
    """
    own = ["doc_id", "stratum", "row"] if keep is not None else ["doc_id", "stratum"]
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", F.col("lang").alias("stratum"), *([keep.alias("row")] if keep is not None else []), text.alias("text"), words(F.col("text")).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    hashed = split.select(*own, "text", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"), lines.alias("l"))
    window = lambda i: F.xxhash64(*[F.col("h")[i + k] for k in range(WINDOW)])
    no = F.array().cast("array<bigint>")
    windows = F.when(F.size("h") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), window)).otherwise(no)
    viewed = hashed.select(
        *own, F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), F.regexp_count("text", F.lit("!")).cast("long").alias("n_bangs"),
        F.size("l").cast("long").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), windows.alias("v"),
    )
    repeated = F.when(F.size(F.array_distinct("v")) == F.size("v"), F.lit(0)).otherwise(_covered(F.col("v"))).cast("long")
    out = viewed.withColumn("n_repeat_words", repeated).drop("v")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def tail(n: Column, k: Column, risk: float) -> Column:
    """P(Binomial(n, risk) <= k).  That it is at most the error means that the Clopper-Pearson bound is at most the risk."""
    zero = F.struct((n * F.log1p(F.lit(-risk))).alias("log"), F.exp(n * F.log1p(F.lit(-risk))).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        log = a["log"] + F.log((n - i + 1) / i) + F.log(F.lit(risk / (1 - risk)))
        return F.struct(log.alias("log"), (a["sum"] + F.exp(log)).alias("sum"))

    return F.when(k >= n, 1.0).otherwise(F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>")), zero, step, lambda a: a["sum"]))


def _cut(rule: str, test: int) -> str:
    return f"cut_{rule}_{test}"


def cutoffs(spark: SparkSession, counted: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, losses: tuple[float, ...] = LOSSES) -> DataFrame:
    """One row for each stratum with labels: a cutoff (null: rejects nothing) for each rule.

    ``labels`` has doc_id and quality (1 good, 0 bad, else: not labelled); a document with several
    labels is good if any says so, and counts once, as does one with several rows.  The halves are
    told apart by a digest of doc_id.  Base failures take no part, for the rules act on the others
    only.  Levels have 1001 values, so what is windowed is at most 1001 rows for each stratum and rule,
    however many documents there are; there may be any number of strata.
    """
    work = Workspace(spark, "quality-rules")
    labelled = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    levels = F.struct("stratum", *[F.expr(e).cast("int").alias(r) for r, e in RULES.items()])
    single = counted.filter(~F.col("base_failed")).groupBy("doc_id").agg(F.max(levels).alias("x")).join(labelled, "doc_id")
    half = (F.substring(F.md5(F.col("doc_id").cast("string")), F.lit(1), F.lit(1)) < "8").alias("proposes")
    known = work.save(single.select("x.*", "quality", half), "known")
    level = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("level")) for r in RULES]))
    seen = known.filter("proposes").select("stratum", "quality", level.alias("x")).groupBy("stratum", F.col("x.rule").alias("rule"), F.col("x.level").alias("level"))
    histogram = seen.agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    part = Window.partitionBy("stratum", "rule")
    above = part.orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tried = histogram.withColumns({"fp": F.coalesce(F.sum("good").over(above), F.lit(0)), "tp": F.coalesce(F.sum("bad").over(above), F.lit(0)), "goods": F.sum("good").over(part), "bads": F.sum("bad").over(part)})
    gain = lambda loss: F.round(F.col("tp") / F.greatest("bads", F.lit(1)) - loss * F.col("fp") / F.greatest("goods", F.lit(1)), 9)
    best = [F.max_by(F.when(F.col("rule") == r, F.col("level")), F.when(F.col("rule") == r, F.struct(gain(x), F.col("level")))).alias(_cut(r, i)) for i, x in enumerate(losses) for r in RULES]
    proposed = work.save(tried.groupBy("stratum").agg(*best), "proposed")
    rejects = lambda i: F.coalesce(F.greatest(*[F.col(r) > F.col(_cut(r, i)) for r in RULES]), F.lit(False))
    held = known.filter("NOT proposes AND quality = 1").join(proposed.withColumnRenamed("stratum", "s"), F.col("stratum").eqNullSafe(F.col("s")))
    tested = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(rejects(i)).alias(f"k{i}") for i in range(len(losses))])
    strata = max(1, known.select("stratum").distinct().count())
    passed, last = F.lit(True), F.lit(-1)
    for i in range(len(losses)):
        passed = passed & (tail(F.col("n"), F.col(f"k{i}"), risk) <= error / strata)
        last = F.when(passed, i).otherwise(last)
    taken = tested.select(F.col("stratum").alias("s"), last.alias("last")).join(proposed, F.col("stratum").eqNullSafe(F.col("s")))
    cuts = [F.element_at(F.array(*[F.col(_cut(r, i)) for i in range(len(losses))]), F.col("last") + 1).alias(f"cut_{r}") for r in RULES]
    return work.save(taken.filter("last >= 0").select("stratum", *cuts), "cutoffs")


def judged(counted: DataFrame, cuts: DataFrame) -> DataFrame:
    """``counted`` with ``kept``; a stratum without cutoffs loses its base failures only.

    Cutoffs are a written table, which is broadcast only as long as its size allows.
    """
    joined = counted.join(cuts.withColumnRenamed("stratum", "s"), F.col("stratum").eqNullSafe(F.col("s")), "left")
    rejected = F.lit(False)
    for r, level in RULES.items():
        rejected = rejected | F.coalesce(F.expr(level) > F.col(f"cut_{r}"), F.lit(False))
    # one expression over both sides: a conjunction would be split and pushed below the join
    return joined.withColumn("kept", F.when(F.col("base_failed") | rejected, False).otherwise(True)).drop("s", *[f"cut_{r}" for r in RULES])


def verdicts(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, base_failed and kept of every row of ``docs`` (doc_id, text, lang).

    Strata are languages, null one of them.  Null, empty and blank texts have no words and fail the
    base; very long texts are counted whole; rows that repeat get the same verdict each; no rows give
    no rows.  Other columns are not read.
    """
    counted = Workspace(spark, "quality-counts").save(counts(docs), "counts")
    return judged(counted, cutoffs(spark, counted, labels))


def good_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Rows are written with their counts, so that texts are counted once and never move.
    """
    counted = Workspace(spark, "quality-counts").save(counts(docs, F.struct(*docs.columns)), "counts")
    kept = judged(counted, cutoffs(spark, counted, labels)).filter("kept")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op9_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every text of ``documents``; see ``verdicts``."""
    out = verdicts(spark, table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bangs", "n_lines")


def _oracle() -> str:
    exprs = {r: f"({e.replace(' div ', ' // ')})::BIGINT" for r, e in RULES.items()}
    levels = " UNION ALL ".join(f"SELECT stratum, quality, '{r}' AS rule, {r} AS level FROM known WHERE proposes" for r in RULES)
    any_above = lambda cut: " OR ".join(f"coalesce({r} > {cut(r)}, false)" for r in RULES)
    tests = range(len(LOSSES))
    best = ", ".join(f"(max({{'g': round(tp / greatest(bads, 1) - {x} * fp / greatest(goods, 1), 9), 'l': level}}) FILTER (rule = '{r}')).l AS {_cut(r, i)}" for i, x in enumerate(LOSSES) for r in RULES)
    certain = lambda i: f"(SELECT coalesce(sum(exp(lgamma(n + 1) - CASE WHEN j > 0 THEN lgamma(j + 1) ELSE 0 END - CASE WHEN j < n THEN lgamma(n - j + 1) ELSE 0 END + j * ln({RISK}) + (n - j) * ln(1 - {RISK}))), 1) FROM unnest(range(0, least(k{i}, n - 1) + 1)) AS u(j)) + (k{i} >= n)::INT <= e"
    last = "CASE " + " ".join(f"WHEN NOT ok{i} THEN {i - 1}" for i in tests) + f" ELSE {len(LOSSES) - 1} END"
    cuts = ", ".join(f"CASE last {' '.join(f'WHEN {i} THEN {_cut(r, i)}' for i in tests)} END AS cut_{r}" for r in RULES)
    return rf"""
    WITH base AS (
        SELECT doc_id, lang AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
        FROM documents
    ), wins AS (
        SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS v FROM base, unnest(range(1, len(w) - 6)) AS u(i)
    ), dups AS (
        SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -8) AS p
        FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, v) AS c FROM wins) WHERE c > 1
    ), rep AS (SELECT doc_id, sum(least(8, i - p))::BIGINT AS n FROM dups GROUP BY doc_id),
    counted AS (
        SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM (
            SELECT doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                   len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(text, '!'))::BIGINT AS n_bangs,
                   len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
            FROM base LEFT JOIN rep USING (doc_id))
    ), leveled AS (SELECT *, {", ".join(f"{e} AS {r}" for r, e in exprs.items())} FROM counted),
    known AS (
        SELECT leveled.*, quality, substr(md5(doc_id::VARCHAR), 1, 1) < '8' AS proposes
        FROM leveled JOIN (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed
    ), hist AS (
        SELECT stratum, rule, level, sum(quality)::BIGINT AS good, sum(1 - quality)::BIGINT AS bad FROM ({levels}) GROUP BY ALL
    ), tried AS (
        SELECT stratum, rule, level, coalesce(sum(good) OVER a, 0) AS fp, coalesce(sum(bad) OVER a, 0) AS tp,
               sum(good) OVER p AS goods, sum(bad) OVER p AS bads FROM hist
        WINDOW a AS (PARTITION BY stratum, rule ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), p AS (PARTITION BY stratum, rule)
    ), proposed AS (SELECT stratum, {best} FROM tried GROUP BY stratum),
    tested AS (
        SELECT proposed.*, n, e, {", ".join(f"k{i}" for i in tests)} FROM proposed JOIN (
            SELECT k.stratum, count(*) AS n, {ERROR} / (SELECT count(*) FROM (SELECT DISTINCT stratum FROM known)) AS e,
                   {", ".join(f"count(*) FILTER ({any_above(lambda r, i=i: _cut(r, i))}) AS k{i}" for i in tests)}
            FROM known k JOIN proposed p ON k.stratum IS NOT DISTINCT FROM p.stratum WHERE NOT proposes AND quality = 1 GROUP BY k.stratum
        ) t ON proposed.stratum IS NOT DISTINCT FROM t.stratum
    ), passed AS (SELECT *, {", ".join(f"{certain(i)} AS ok{i}" for i in tests)} FROM tested),
    taken AS (SELECT stratum, {cuts} FROM (SELECT *, {last} AS last FROM passed))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
           NOT base_failed AND NOT ({any_above(lambda r: f"cut_{r}")}) AS kept, n_bangs, n_lines
    FROM leveled LEFT JOIN taken ON leveled.stratum IS NOT DISTINCT FROM taken.stratum"""


ORACLE = _oracle()
