"""Mixing sources to target weights by entropy balancing.

Every document gets a rate exp(sum of the multipliers of its margins' values), at most a cap: the
exponential tilt that stays nearest (in relative entropy, weighted by size) to taking each document once
and meets the token constraints.  The multipliers come from Newton steps on the convex dual, over cells
(distinct combinations of margin values).  One margin's Hessian is diagonal, so Spark takes the steps of
all its values at once.  Several margins take joint damped steps: Spark adds up the gradient and the
Hessian's entries (pairs of values that meet in a cell), and the driver solves for a step of as many
numbers as there are values.  Constraints that can't be met together are an error.  Rates are then rounded
into whole copies.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD, Workspace, table

#: Documents of one rounding block, about.
BLOCK_ROWS = 512
#: Documents of a block whose copies are chosen by exact sums.
TAIL = 32
#: Newton steps of one margin, and of several together; how near they come, relative to a target.
STEPS, JOINT, NEAR = 60, 80, 1e-8
#: Joint steps in a row that come no nearer, after which targets count as unmet.
STALE = 8
#: Values of several margins together, whose Hessian the driver solves.
VALUES = 4000
#: Rows of one document that are written out at once.
CHUNK = 10_000


def word_count(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def capped_shares(totals: DataFrame, total: float, cap: float) -> DataFrame:
    """``totals`` (size, weight) with ``target``: ``total`` shared by weight.

    A share stops at ``cap`` times its size and the excess goes to the rest by weight, so a target is
    the lesser of that and a level times the weight.  Each pass over the table raises the level to what
    the shares leave open that it has closed; only three sums reach the driver.
    """
    level, closed = 0.0, -1
    while True:
        full = F.col("weight") * level > cap * F.col("size")
        stopped, weight, n = totals.agg(F.coalesce(F.sum(F.when(full, cap * F.col("size"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)), F.count_if(full)).first()
        if n == closed or not weight:
            return totals.withColumn("target", F.least(cap * F.col("size"), F.col("weight") * level if weight else cap * F.col("size")).cast("double"))
        level, closed = (total - stopped) / weight, n


def _newton(goal: Column, start: Column) -> Column:
    """The x at which start * exp(x) is the goal, by damped Newton steps on the dual; -inf where nothing meets it."""
    step = lambda x, _: x + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), goal / (start * F.exp(x)) - 1))
    return F.when((goal > 0) & (start > 0), F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.lit(0.0), step)).otherwise(F.lit(float("-inf")))


def balance(work: Workspace, cells: DataFrame, margins: Mapping[str, DataFrame], size: str = "size", most: float = math.inf) -> dict[str, DataFrame]:
    """(value, x) of each margin: the multipliers for which the tilted tokens of every value meet its target.

    ``cells`` has a row for each combination of margin values with its tokens; margins have (value,
    target).  Values without tokens, or with target 0 or none, have no finite multiplier: -inf, rate 0.
    Rates are at most ``most``.  Several margins whose targets no rates meet raise ValueError.
    """
    sums = {name: cells.groupBy(F.col(name).alias("value")).agg(F.sum(size).cast("double").alias("n")) for name in margins}
    goals = {}
    for name, targets in margins.items():
        joined = sums[name].alias("c").join(targets.select("value", F.col("target").cast("double")).alias("t"), F.expr("c.value <=> t.value"), "left")
        goals[name] = work.save(joined.select("c.value", "c.n", F.coalesce("t.target", F.lit(0.0)).alias("goal")), "goals")
    if len(margins) == 1:
        ((name, goal),) = goals.items()
        return {name: work.save(goal.select("value", _newton(F.col("goal"), F.col("n")).alias("x")), "duals")}
    return _joint(work, cells, goals, size, most)


def _joint(work: Workspace, cells: DataFrame, goals: Mapping[str, DataFrame], size: str, most: float) -> dict[str, DataFrame]:
    """``balance`` of several margins by damped Newton steps on all their values together."""
    spark, names = work.spark, list(goals)
    alive = {name: goal.filter("goal > 0 AND n > 0").select("value", "goal").orderBy("value").limit(VALUES + 1).collect() for name, goal in goals.items()}
    first = np.cumsum([0, *(len(v) for v in alive.values())])
    if first[-1] > VALUES:
        raise ValueError(f"several margins of more than {VALUES} values together")
    goal = np.array([r.goal for values in alive.values() for r in values])
    each = [float(goal[a:b].sum()) for a, b in zip(first, first[1:], strict=False)]
    if max(each, default=0) - min(each, default=0) > NEAR * max(each, default=0):
        raise ValueError(f"targets of margins add up to different totals: {dict(zip(names, each, strict=True))}")
    place = cells.select(*names, F.col(size).cast("double").alias("__n"))
    for k, name in enumerate(names):
        numbered = spark.createDataFrame([(i, r.value) for i, r in enumerate(alive[name], int(first[k]))], f"__i{k} int, __v{k} {dict(goals[name].dtypes)['value']}")
        place = place.join(numbered, F.col(name).eqNullSafe(F.col(f"__v{k}"))).drop(f"__v{k}")
    ids = [f"__i{k}" for k in range(len(names))]
    place = work.save(place.groupBy(*ids).agg(F.sum("__n").alias("__n")), "places")

    def sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens that each value reaches, the Hessian), added up over cells."""
        table = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "__i int, __x double")
        tilt, rows = F.lit(0.0), place
        for i in ids:
            rows = rows.join(F.broadcast(table.select(F.col("__i").alias(i), F.col("__x").alias(f"x{i}"))), i)  # VALUES rows at most
            tilt = tilt + F.col(f"x{i}")
        free = tilt < math.log(most) if most < math.inf else F.lit(True)
        rate = F.exp(tilt) if most == math.inf else F.least(F.exp(tilt), F.lit(float(most)))
        pairs = F.explode(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for k, a in enumerate(ids) for b in ids[k:]]))
        rows = rows.select(pairs.alias("p"), (F.col("__n") * rate).alias("w"), free.alias("free"))
        reached, hessian = np.zeros(len(x)), np.zeros((len(x), len(x)))
        for a, b, w, f in rows.groupBy("p").agg(F.sum("w").alias("w"), F.coalesce(F.sum(F.when(F.col("free"), F.col("w"))), F.lit(0.0)).alias("f")).select("p.a", "p.b", "w", "f").collect():
            hessian[a, b] = hessian[b, a] = f
            if a == b:
                reached[a] = w
        return reached, hessian

    x, step, damp = np.zeros(len(goal)), np.zeros(len(goal)), 1e-9
    miss, last, stale = np.inf, None, 0
    for _ in range(JOINT):
        reached, hessian = sums(x + step)
        now = float((np.abs(goal - reached) / np.maximum(goal, 1)).max(initial=0))
        stale = 0 if now < 0.99 * miss else stale + 1
        if now < miss or last is None:  # a step that helped; one that didn't is shortened by more damping
            x, miss, last, damp = x + step, now, (reached, hessian), max(damp / 8, 1e-9)
        else:
            damp = max(damp * 16, 1e-6)
        if miss <= NEAR or stale >= STALE:
            break
        scale = np.diag(last[1]) + 1e-12 * goal
        step = np.linalg.lstsq(last[1] + np.diag(damp * scale), goal - last[0], rcond=1e-12)[0]
        step = step * min(1.0, 2.0 / max(1e-300, np.abs(step).max(initial=0)))
    if miss > NEAR:
        worst = int((np.abs(goal - last[0]) / np.maximum(goal, 1)).argmax())
        k = int(np.searchsorted(first, worst, "right")) - 1
        raise ValueError(f"no rates meet the targets of {names} together: {names[k]}={alive[names[k]][worst - first[k]].value!r} comes to {last[0][worst]:.6g} of {goal[worst]:.6g}")
    out = {}
    for k, name in enumerate(names):
        found = spark.createDataFrame([(r.value, float(x[i])) for i, r in enumerate(alive[name], int(first[k]))], f"v {dict(goals[name].dtypes)['value']}, x double")
        out[name] = work.save(goals[name].join(F.broadcast(found), F.col("value").eqNullSafe(F.col("v")), "left").select("value", F.coalesce("x", F.lit(float("-inf"))).alias("x")), "duals")
    return out


def _tilted(cells: DataFrame, duals: Mapping[str, DataFrame]) -> DataFrame:
    """``cells`` with ``__x``, the sum of their values' multipliers."""
    total = F.lit(0.0)
    for i, (name, dual) in enumerate(duals.items()):
        cells = cells.join(dual.select(F.col("value").alias(f"__v{i}"), F.col("x").alias(f"__x{i}")), F.col(name).eqNullSafe(F.col(f"__v{i}"))).drop(f"__v{i}")
        total = total + F.col(f"__x{i}")
    return cells.withColumn("__x", total).drop(*[f"__x{i}" for i in range(len(duals))])


def round_block(sizes: np.ndarray, rates: np.ndarray, most: int) -> np.ndarray:
    """Copies, 0 to ``most``, whose tokens meet the rates' sum as nearly as single changes can.

    Sizes fall.  Copies first follow the running sum; near ``most`` that may end behind, so single
    copies, and exchanges of one document's copy for another's, are added or taken while they help.
    Last, the smallest documents' copies are chosen anew among all sums that they can make.
    """
    copies = np.zeros(len(sizes), np.int64)
    behind = 0.0
    for i, (n, r) in enumerate(zip(sizes.tolist(), rates.tolist(), strict=True)):
        behind += n * r
        if n:
            c = min(most, max(0, math.floor(behind / n + 0.5)))
            copies[i] = c
            behind -= c * n
        else:
            copies[i] = min(most, round(r))
    full = sizes > 0
    for _ in range(64):
        sign = 1 if behind > 0 else -1
        can = np.flatnonzero(full & ((copies < most) if sign > 0 else (copies > 0)))
        back = np.flatnonzero(full & ((copies > 0) if sign > 0 else (copies < most)))
        if abs(behind) <= 1 or not len(can):
            break
        one = can[np.argmin(np.abs(sizes[can] - abs(behind)))]
        best, change = abs(abs(behind) - sizes[one]), [(one, sign)]
        if len(back):  # one document more, another less: sizes fall, so partners are found by bisection
            wanted = sizes[can] - abs(behind)
            at = np.clip(np.searchsorted(-sizes[back], -wanted), 1, len(back)) - 1
            for near in (at, np.minimum(at + 1, len(back) - 1)):
                miss = np.abs(sizes[back[near]] - wanted)
                k = int(np.argmin(np.where(back[near] == can, np.inf, miss)))
                if back[near[k]] != can[k] and miss[k] < best:
                    best, change = float(miss[k]), [(can[k], sign), (back[near[k]], -sign)]
        if best >= abs(behind):
            break
        for i, step in change:
            copies[i] += step
            behind -= step * sizes[i]
    tail = np.flatnonzero(full)[-TAIL:].tolist()
    if abs(behind) > 1 and tail:
        goal = behind + float((copies[tail] * sizes[tail]).sum())
        sums = [1]  # bit n of sums[k]: the first k of the tail can make n tokens
        for i in tail:
            now = sums[-1]
            for c in range(1, most + 1):
                now |= sums[-1] << c * int(sizes[i])
            sums.append(now)
        low = sums[-1] & ((1 << max(0, int(goal)) + 1) - 1)
        high = sums[-1] >> max(0, int(goal)) + 1
        options = [low.bit_length() - 1, *([int(goal) + 1 + (high & -high).bit_length() - 1] if high else [])]
        n = min((o for o in options if o >= 0), key=lambda o: abs(o - goal))
        if abs(n - goal) < abs(behind):
            for k in range(len(tail), 0, -1):
                size = int(sizes[tail[k - 1]])
                c = min((c for c in range(most + 1) if n >= c * size and sums[k - 1] >> (n - c * size) & 1), key=lambda c: abs(c - rates[tail[k - 1]]))
                copies[tail[k - 1]] = c
                n -= c * size
    return copies


def mix(spark: SparkSession, df: DataFrame, size: str, margins: Mapping[str, DataFrame], key: Sequence[str], most: int = 2, keep: Sequence[str] = ()) -> DataFrame:
    """``df``'s key, margin and kept columns, with ``rate``, ``copies`` and ``taken`` (copies * size).

    Rows that are equal in all these columns are one item: all of them but one get the whole part of
    what their rate comes to, so a row that is there ever so often is one in its block.  Rounding goes
    by blocks: hashed parts of a combination of margins of about BLOCK_ROWS items, so a combination with a
    third of all rows is many blocks.  Inside one, items pass in descending size and copies follow the
    running sum of rate * size, so a block is off by a few tokens.  Ties of size go by the other columns.
    Documents without words take 0 words; they are kept as often as their rate says.  Column names that begin
    with __ are reserved.
    """
    names = list(margins)
    work = Workspace(spark, "mixing")
    columns = list(dict.fromkeys([*key, *names, size, *keep]))
    items = work.save(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__m")), "items")
    cells = work.save(items.groupBy(*names).agg(F.sum(F.col(size) * F.col("__m")).alias(size), F.count(F.lit(1)).alias("__n")), "cells")
    rates = _tilted(cells, balance(work, cells, margins, size, most))
    rates = work.save(rates.select(*[F.col(n).alias(f"__c{i}") for i, n in enumerate(names)], F.least(F.exp("__x"), F.lit(float(most))).alias("rate"), F.ceil(F.col("__n") / BLOCK_ROWS).alias("__blocks")), "rates")
    on = F.lit(True)
    for i, n in enumerate(names):
        on = on & F.col(n).eqNullSafe(F.col(f"__c{i}"))
    part = F.col("__m") * (F.col("rate") - F.floor("rate"))
    rows = items.join(rates, on).drop(*[f"__c{i}" for i in range(len(names))])
    rows = rows.withColumns({"__block": F.pmod(F.xxhash64(*columns), F.col("__blocks")), "__more": F.floor(part), "__open": F.floor("rate") + part - F.floor(part)}).drop("__blocks")
    kinds = dict(rows.dtypes)
    passed = [*columns, "rate", "__m", "__more"]
    out = ", ".join(f"`{c}` {kinds[c]}" for c in passed) + ", __own bigint"

    def rounded(group: pa.Table) -> pa.Table:
        group = group.sort_by([(size, "descending"), *((c, "ascending") for c in columns)])
        copies = round_block(group[size].to_numpy(), group["__open"].to_numpy(), most)
        return group.select(passed).append_column("__own", pa.array(copies))

    done = rows.groupBy(*names, "__block").applyInArrow(rounded, out)
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__m") - 1, F.lit(CHUNK).cast("long")))
    single = done.withColumn("__first", chunk).withColumn("__k", F.explode(F.sequence(F.col("__first"), F.least(F.col("__first") + CHUNK, F.col("__m")) - 1)))
    copies = F.when(F.col("__k") == 0, F.col("__own")).otherwise(F.floor("rate") + F.when(F.col("__k") <= F.col("__more"), 1).otherwise(0))
    return single.select(*columns, "rate", copies.cast("long").alias("copies")).withColumn("taken", F.col("copies") * F.col(size))


def source_targets(spark: SparkSession, df: DataFrame, size: str = "size", source: str = "source", share: float = 1.5, cap: float = 2.0, weights: Sequence[float] = (3, 1, 2)) -> DataFrame:
    """(value, size, weight, target) by source.  Sources in code point order, null last, get the weights in turn.

    Places in the order come from a sort by ranges: a place inside a range, after what the ranges before hold.
    """
    work = Workspace(spark, "mixing-targets")
    totals = df.groupBy(F.col(source).alias("value")).agg(F.sum(size).cast("long").alias("size")).withColumn("none", F.col("value").isNull())
    dealt = work.save(totals.repartitionByRange("none", "value").withColumn("range", F.spark_partition_id()), "totals")
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("before"))  # a row a range
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("none", "value")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    weighed = work.save(dealt.join(ranges, "range").select("value", "size", weight.alias("weight")), "weights")
    total = weighed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return work.save(capped_shares(weighed, share * total, cap), "targets")


def mix_documents(spark: SparkSession, docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Copies of ``docs`` (doc_id, source, text) for the weights of ``source_targets``.

    Null, empty and blank texts have size 0; very long ones are counted whole; a null source is a source
    of its own; rows that repeat are rounded each; no rows give no rows.  Of other columns only ``keep``
    is read.
    """
    work = Workspace(spark, "mixing-sizes")
    sized = work.save(docs.withColumn("__size", word_count("text")).select("doc_id", "source", F.col("__size").alias("size"), *keep), "sized")
    targets = source_targets(spark, sized)
    mixed = mix(spark, sized, "size", {"source": targets}, ["doc_id"], keep=keep)
    facts = targets.select(F.col("value").alias("__s"), F.col("size").alias("source_size"), "target")
    return mixed.join(facts, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every row of ``documents``; see ``mix_documents``."""
    mixed = mix_documents(spark, table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate", "source")


def repeated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Rows are told apart by doc_id and a fingerprint of the text; rows equal in both share their copies.
    Column names that begin with __ are reserved.
    """
    marked = docs.withColumn("__print", F.xxhash64("text"))
    mixed = mix_documents(spark, marked.select("doc_id", "source", "text", "__print"), keep=["__print"])
    taken = Workspace(spark, "mixing-copies").save(mixed.groupBy("doc_id", "__print").agg(F.sum("copies").alias("__n"), F.count(F.lit(1)).alias("__rows")).toDF("__id", "__p", "__n", "__rows"), "copies")
    if not taken.filter("__rows > 1").isEmpty():
        marked = marked.dropDuplicates(["doc_id", "__print"])
    rows = marked.join(taken.filter("__n > 0").hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__print") == F.col("__p")))
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select(*docs.columns)
