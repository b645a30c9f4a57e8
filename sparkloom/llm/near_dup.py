"""Near-duplicate documents by a chosen-path set-similarity join.

A document is the set of its word shingles; documents link when their sets overlap by the
threshold.  Equal sets are one to begin with.  Then independent trees branch the sets from their
roots: a node's children are the values of minwise tokens (coordinates of a MinHash signature) that
the node itself chooses, 1 / threshold of them on average, so a linked pair is expected to stay
together in one child of every node however deep the tree goes.  The first levels need no shuffle,
since a node's choice follows from the node; their number grows with the logarithm of the number of
sets, and the number of trees follows from the depth and the recall that is asked.  Small nodes are
compared exhaustively by sketches; large ones in parts, each with two pivots, and branch on.

Pairs whose sketches are near enough join their documents into families, outside which there can
be no link.  Families prune the search (a node inside one family is done), so a third of the corpus
in one group of near copies costs a few comparisons for each copy.  At the end each family is
compared on whole sets, which alone decide the links; a large family first finds its main component
and then compares only what is outside it with all members, block by block.  Texts move once more
for that, in blocks of bounded bytes.  Where more than a block is outside (documents of one template,
near each other but mostly not linked), pairs come from an index of the family's rarest shingles instead:
two sets that link share one of the few rarest of each, at places that leave room for what is still
missing, and only such pairs are compared, on whole sets.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import kernels
from sparkloom.llm.common import Workspace, table

WIDTH = 5
THRESHOLD = Fraction(80, 100)
#: A sketch is a byte of the minwise shingle of each coordinate.
COORDINATES = 128
#: Share of the pairs at the threshold that the trees may miss.
MISS = 1e-5
#: Trees that run before the others, so that these meet the groups already merged.
FIRST_TREES = 4
#: Levels of a tree for up to so many sets; one more for every sixteenfold.
DEPTH, DEPTH_SETS = 3, 1 << 18
#: Levels below these after which a node that is still large is compared part by part.
MORE_DEPTH = 16
#: Members of a node that is compared in one group, of a node that is compared as a whole, part by part,
#: and of one such part.
SMALL, MIDDLE, PART = 512, 2048, 256
#: Of every four nodes one chooses two coordinates: 1.25 on average, for the threshold of 0.8.  Large
#: nodes beyond the first levels always choose two.
TWO_IN = 4
#: Sketches of sets at the threshold agree in 102.5 of 128 coordinates on average, with a standard
#: deviation of 4.5; so many must agree for a pair to count, 4.6 deviations fewer.
LEAST = 82
#: Members of a family that is compared as a whole; larger ones, or ones of more bytes than a block, go
#: by blocks of so many rows and bytes.
FAMILY, BLOCK, BLOCK_BYTES = 512, 1024, 4 << 20
#: Edges that one task joins, at most (16 bytes each).
ONE_TASK = 1_000_000

_generator = np.random.Generator(np.random.PCG64(77))
_MULTIPLIERS = _generator.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def forest_shape(sets: int) -> tuple[int, int]:
    """Depth and number of trees for so many sets.

    A pair at the threshold shares a coordinate with that probability, so its common nodes are a
    branching process; trees are as many as make the chance that it dies out in all of them MISS.
    """
    depth = DEPTH + max(0, math.ceil(math.log(max(sets, 1) / DEPTH_SETS, 16)))
    stay, lost = float(THRESHOLD), 0.0
    for level in range(MORE_DEPTH + depth):
        one = 1 - stay + stay * lost
        lost = one * one if level < MORE_DEPTH else one * (1 - 1 / TWO_IN) + one * one / TWO_IN
    return depth, math.ceil(math.log(MISS) / math.log(lost))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """For each set and coordinate a byte of the set's minwise shingle; 0 for the empty set."""
    out = np.zeros((len(sets), COORDINATES), np.uint8)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        first = np.cumsum([0, *(len(sets[i]) for i in full)])[:-1]
        for k, a in enumerate(_MULTIPLIERS):
            out[full, k] = (kernels.mix(np.minimum.reduceat(flat * a, first)) >> np.uint64(48)).astype(np.uint8)
    return out


SIGNED = "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, n_bytes bigint, sketch binary"


def _sum(sets: list[np.ndarray], salt: int) -> pa.Array:
    return pa.array(np.array([kernels.mix(s ^ np.uint64(salt)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64))


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, offsets in kernels.pieces(batch.column(1)):
                sets = kernels.shingles(data, offsets, width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, stop - row), pa.array([len(s) for s in sets], pa.int64()), _sum(sets, 1), _sum(sets, 2), pa.array(np.diff(offsets)), _rows_of(signatures(sets))],
                    names=["doc_id", "n_shingles", "h1", "h2", "n_bytes", "sketch"],
                )

    return run


def _rows_of(sketch: np.ndarray) -> pa.Array:
    return pa.array([s.tobytes() for s in sketch], pa.binary())


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of sketches as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), COORDINATES)


def _children(node: np.ndarray, sketch: np.ndarray, row: np.ndarray, deep: bool) -> tuple[np.ndarray, np.ndarray]:
    """The children of each node for the set of each row: the values of the coordinates that the node chooses."""
    out = []
    for k in (0, 1):
        here = np.arange(len(node)) if k == 0 or deep else np.flatnonzero(kernels.mix(node ^ np.uint64(5)) % np.uint64(TWO_IN) == 0)
        c = kernels.mix(node[here] ^ np.uint64(11 + k)) % np.uint64(COORDINATES)
        value = sketch[row[here], c.astype(np.int64)].astype(np.uint64)
        out.append((kernels.mix(kernels.mix(node[here] * _GOLDEN + np.uint64(k)) ^ (value + (c << np.uint64(16)) + np.uint64(1 << 32))), row[here]))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _paths(trees: range, depth: int):
    """The nodes of each set at the depth of each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sketch, ids = _matrix(batch.column("sketch")), batch.column("id").to_numpy()
            for t in trees:
                node, row = kernels.mix(np.full(len(ids), t + 1, np.uint64) * _GOLDEN), np.arange(len(ids))
                for _ in range(depth):
                    node, row = _children(node, sketch, row, False)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(ids[row])], names=["node", "id"])

    return run


FOUND = "child boolean, a bigint, b bigint"
PAIRS = "a bigint, b bigint"


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coordinates in which each sketch of ``x`` agrees with each of ``y``."""
    out = np.zeros((len(x), len(y)), np.uint8)
    for i in range(0, len(x), 64):
        np.sum(x[i : i + 64, None, :] == y[None, :, :], axis=2, dtype=np.uint8, out=out[i : i + 64])
    return out


def _spanning(near: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs that connect what all of them connect; equal labels are connected from the start.

    ``near`` is symmetric.  Each place is visited once, with one pass over its row.
    """
    _, first, group = np.unique(labels, return_index=True, return_inverse=True)
    members: dict[int, list[int]] = {}
    if len(first) < len(labels):
        for i, g in enumerate(group.tolist()):
            members.setdefault(g, []).append(i)
    waiting = np.ones(len(labels), bool)
    left, right = [], []
    for seed in np.flatnonzero(near.any(1)).tolist():
        if not waiting[seed]:
            continue
        waiting[seed] = False
        stack = [seed]
        while stack:
            i = stack.pop()
            for j in members.pop(int(group[i]), ()):
                if waiting[j]:
                    waiting[j] = False
                    stack.append(j)
            new = np.flatnonzero(near[i] & waiting)
            waiting[new] = False
            stack.extend(new.tolist())
            left.append(np.full(len(new), i))
            right.append(new)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _by_group(make):
    """``make`` over the rows of whole groups; rows come sorted by ``key`` and groups are of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            at = rows["key"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            yield from make(rows, cuts)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            at = rows["key"].to_numpy()
            start = int(np.searchsorted(at, at[-1], "left"))  # the last group may go on
            if start or (held and held[0]["key"][0].as_py() != at[-1]):
                yield from done(pa.concat_tables([*held, rows.slice(0, start)]))
                held = [rows.slice(start)]
            else:
                held.append(rows)
        if held:
            yield from done(pa.concat_tables(held))
        held.clear()
        kernels.trim()

    return run


def _compare_nodes(rows: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
    """Exhaustive comparison by sketches inside nodes or their parts, and the children of rows that branch."""
    ids, comp = rows["id"].to_numpy(), rows["comp"].to_numpy()
    sketch = _matrix(rows["sketch"])
    first, last = np.array(cuts[:-1]), np.array(cuts[1:])
    two = first[last - first == 2]
    hit = two[((sketch[two] == sketch[two + 1]).sum(1) >= LEAST) & (comp[two] != comp[two + 1])]
    left, right = [ids[hit]], [ids[hit + 1]]
    for s, e in zip(first[last - first > 2].tolist(), last[last - first > 2].tolist(), strict=True):
        near = (_alike(sketch[s:e], sketch[s:e]) >= LEAST) & (comp[s:e, None] != comp[None, s:e])
        i, j = _spanning(near, comp[s:e])
        left.append(ids[s:e][i])
        right.append(ids[s:e][j])
    a, b = np.concatenate(left), np.concatenate(right)
    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), bool)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["child", "a", "b"])
    grow = np.flatnonzero(rows["grow"].to_numpy())
    if len(grow):
        node, row = _children(rows["node"].to_numpy().view(np.uint64)[grow], sketch, grow, True)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(node), bool)), pa.array(node.view(np.int64)), pa.array(ids[row])], names=["child", "a", "b"])


def _overlaps(sets: list[np.ndarray], rows: int, wanted: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the first ``rows`` sets with all, at least where ``wanted``.

    Either pair by pair or, where that is more work, as products of 0/1 matrices of the tokens that sets share.
    """
    i, j = np.nonzero(wanted)
    out = np.zeros(wanted.shape, np.int64)
    lengths = [len(s) for s in sets]
    pairwise = len(i) * (12 + 0.05 * np.mean(lengths))  # both in microseconds, about
    if pairwise > 2000:
        _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        chunks = -(-np.count_nonzero(times > 1) // 4096)
        if pairwise > 0.1 * len(token) + wanted.size * chunks * 0.3:
            owner = np.repeat(np.arange(len(sets)), lengths)
            keep = times[token] > 1
            token, owner = (np.cumsum(times > 1) - 1)[token[keep]], owner[keep]
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            for start in range(0, chunks * 4096, 4096):
                a, b = np.searchsorted(token, (start, start + 4096))
                has = np.zeros((len(sets), 4096), np.float32)
                has[owner[a:b], token[a:b] - start] = 1
                out += (has[:rows] @ has.T).astype(np.int64)
            return out
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = (sets[a], sets[b]) if len(sets[a]) < len(sets[b]) else (sets[b], sets[a])
        out[a, b] = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
    return out


def _links(ids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], threshold: Fraction, rows: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links between different labels, on whole sets, that connect what all links connect; of the first ``rows`` with all if given."""
    n = len(ids) if rows is None else rows
    size = np.array([len(x) for x in sets])
    small, large = np.minimum(size[:n, None], size[None, :]), np.maximum(size[:n, None], size[None, :])
    wanted = (labels[:n, None] != labels[None, :]) & (small * threshold.denominator >= large * threshold.numerator) & (np.arange(n)[:, None] < np.arange(len(ids))[None, :])
    if len(ids) > 16:
        sketch = signatures(sets)
        wanted &= _alike(sketch[:n], sketch) >= LEAST
    both = _overlaps(sets, n, wanted)
    linked = np.zeros((len(ids), len(ids)), bool)
    linked[:n] = wanted & (both * threshold.denominator >= threshold.numerator * (size[:n, None] + size[None, :] - both))
    i, j = _spanning(linked | linked.T, labels)
    return ids[i], ids[j]


def _confirm(threshold: Fraction, width: int):
    """The links inside each group; if it has rows of ``few``, only those of these rows with all."""

    def run(rows: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        ids, labels, few = (rows[c].to_numpy() for c in ("id", "comp", "few"))
        sets: list[np.ndarray] = []
        for _, _, data, offsets in kernels.pieces(rows["text"]):
            sets += kernels.shingles(data, offsets, width)
        left, right = [], []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            order = s + np.argsort(~few[s:e], kind="stable")
            i, j = _links(ids[order], labels[order], [sets[k] for k in order.tolist()], threshold, int(few[s:e].sum()) or None)
            left.append(i)
            right.append(j)
        yield _pairs(np.concatenate(left), np.concatenate(right))

    return run


TOKENS = "family bigint, id bigint, comp bigint, few boolean, tokens array<bigint>"


def _tokens(width: int):
    """The whole set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, offsets in kernels.pieces(batch.column(4)):
                sets = kernels.shingles(data, offsets, width)
                ends = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64) if ends[-1] else np.zeros(0, np.int64)
                part = batch.slice(row, stop - row)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["family", "id", "comp", "few", "tokens"])

    return run


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of a partition's edges as stars around their smallest ids."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not got:
        return
    u, v = (np.concatenate(x) for x in zip(*got, strict=True))
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    up = list(range(len(ids)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        x, y = top(x), top(y)
        up[max(x, y)] = min(x, y)
    root = np.array([top(i) for i in range(len(ids))], np.int64)
    leaf = np.flatnonzero(root != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[leaf]), pa.array(ids[root[leaf]])], names=["u", "v"])


def components(work: Workspace, edges: DataFrame) -> DataFrame:
    """(id, comp) of every end of an edge (a, b): the smallest id connected with it.

    One task joins up to ONE_TASK edges.  Of more, every partition first makes stars of its own; if
    there still are more, alternating large-star and small-star steps go on until nothing changes.  There
    a star's centre may have any number of edges: minima combine before the shuffle, and the join with
    them may split a hot key.  ``edges`` is written, or cheap to read again.
    """
    joined = lambda rows: work.save(rows.coalesce(1).mapInArrow(_forest, "u bigint, v bigint"), "stars").select(F.col("u").alias("id"), F.col("v").alias("comp"))
    now = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v")
    if now.count() <= ONE_TASK:
        return joined(now)
    now = work.save(now.mapInArrow(_forest, "u bigint, v bigint"), "stars")
    if now.count() <= ONE_TASK:
        return joined(now)
    seen = None
    while True:
        sign = now.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if tuple(sign) == seen:
            return now.select(F.col("u").alias("id"), F.col("v").alias("comp"))
        seen = tuple(sign)
        both = now.union(now.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
        after = work.save(small, "stars")
        work.drop(now)
        now = after


def _freed(spark: SparkSession) -> None:
    """Let go of the shuffle files of what is written by now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _undecided(rows: DataFrame, merged: DataFrame | None) -> DataFrame:
    """(node, id, comp, n) of the nodes that have members of two families or more; an id in no pair yet is its own family."""
    labelled = rows.select("node", "id", F.col("id").alias("comp"))
    if merged is not None:
        labelled = rows.join(merged, "id", "left").select("node", "id", F.coalesce("comp", "id").alias("comp"))
    stats = labelled.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("node", "n")
    return labelled.join(stats, "node")


def _place(parts: Column) -> Column:
    return F.pmod(F.xxhash64("id"), parts)


def _dealt(members: DataFrame, last: bool) -> DataFrame:
    """(key, node, id, comp, grow): members by the groups in which they are compared.

    A small node is one group.  A large one is cut into parts.  If few of its members are outside
    its main family, these go to every part, and the node is done.  If not, every part of a node of
    middle size meets every other (of any node after the last level); in a larger node two members of
    different families go to every part, and its members branch.
    """
    small = members.filter(F.col("n") <= SMALL).select(F.col("node").alias("key"), "node", "id", "comp", F.lit(False).alias("grow"))
    large = members.filter(F.col("n") > SMALL)
    of = large.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("one")).groupBy("node").agg(F.max(F.struct("k", "comp", "one")).alias("main"), F.min(F.struct("k", "comp", "one")).alias("other"))
    parts = F.ceil(F.col("n") / PART)
    own = _place(parts)
    every = F.sequence(F.lit(0), parts - 1)
    few = F.col("n") - F.col("main.k") <= PART
    whole = F.lit(last) | (F.col("n") <= MIDDLE)
    pivot = F.col("id").isin(F.col("main.one"), F.col("other.one"))
    keys = (
        F.when(few & (F.col("comp") != F.col("main.comp")) | ~few & ~whole & pivot, F.transform(every, lambda p: F.xxhash64("node", p, p)))
        .when(few | ~whole, F.array(F.xxhash64("node", own, own)))
        .otherwise(F.transform(every, lambda p: F.xxhash64("node", F.least(own, p), F.greatest(own, p))))
    )
    placed = large.join(of, "node").select("node", "id", "comp", (~few & ~whole).alias("grow"), F.xxhash64("node", own, own).alias("own"), F.explode(keys).alias("key"))
    return small.unionByName(placed.select("key", "node", "id", "comp", (F.col("grow") & (F.col("key") == F.col("own"))).alias("grow")))


def families(spark: SparkSession, work: Workspace, reps: DataFrame) -> DataFrame:
    """(id, comp) of the sets (id, sketch) that are near others: the trees' walk."""
    sets = reps.count()  # no table below needs more tasks than the sets do
    depth, trees = forest_shape(sets)
    sketches = reps.select("id", "sketch")
    paths = lambda some: sketches.mapInArrow(_paths(some, depth), "node bigint, id bigint")
    merged, level = None, 0
    rows = paths(range(min(FIRST_TREES, trees)))
    while True:
        if level < 2:  # later ones are children, which are written
            rows = work.save(rows, "nodes", sets)
        members = work.save(_undecided(rows, merged), "members", sets)
        if level < 2:
            work.drop(rows)
        most = members.agg(F.max("n")).first()[0] or 0
        groups = members.select(F.col("node").alias("key"), "node", "id", "comp", F.lit(False).alias("grow"))
        if most > SMALL:
            groups = _dealt(members, level == MORE_DEPTH)
        sorted_ = groups.join(sketches, "id").repartition("key").sortWithinPartitions("key")
        found = work.save(sorted_.mapInArrow(_by_group(_compare_nodes), FOUND), "found", sets)  # written first: a task that compares and joins would need two workers
        pairs = found.filter("NOT child").select("a", "b")
        if merged is not None:
            pairs = pairs.union(merged.select(F.col("id").alias("a"), F.col("comp").alias("b")))
        merged = components(work, pairs)
        rows = found.filter("child").select(F.col("a").alias("node"), F.col("b").alias("id"))
        if level == 0 and trees > FIRST_TREES:
            rows = rows.union(paths(range(FIRST_TREES, trees)))
        elif most <= SMALL or rows.isEmpty():
            break
        work.drop(members)
        level += 1
    _freed(spark)
    return merged


def _read_groups(rows: DataFrame, threshold: Fraction, width: int) -> DataFrame:
    return rows.select("key", "id", "comp", "few", "text").repartition("key").sortWithinPartitions("key").mapInArrow(_by_group(_confirm(threshold, width)), PAIRS)


def _blocks(rows: Column, size: Column) -> Column:
    """The number of blocks for rows and bytes that are more than one group's."""
    return F.greatest(F.ceil(rows / BLOCK), F.ceil(size / BLOCK_BYTES), F.when(rows > FAMILY, 2).otherwise(1)).cast("int")


def confirmed(spark: SparkSession, work: Workspace, docs: DataFrame, near: DataFrame, reps: DataFrame, threshold: Fraction, width: int) -> DataFrame:
    """(id, comp) of the documents that are linked with others, by the whole sets of every family.

    First every block of a family is compared inside, together with the family's first member; then
    what that leaves outside a large family's main component is compared with all its members: a block of
    it with each block of these, and more than a block by ``rarest``.
    """
    members = near.unionByName(near.select(F.col("comp").alias("id"), "comp").distinct()).join(reps.select("id", "n_bytes"), "id")
    sizes = members.groupBy("comp").agg(_blocks(F.count(F.lit(1)), F.sum("n_bytes")).alias("blocks"))
    n = near.count()  # at most as many more that lead a family
    members = work.save(members.join(sizes, "comp").select("id", F.col("comp").alias("family"), "blocks"), "members", 2 * n)
    pool = docs.toDF("id", "text").join(members.hint("merge"), "id")
    large = not members.filter("blocks > 1").isEmpty()
    if large:
        pool = work.save(pool, "pool", 20 * n)
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = _place(F.col("blocks"))
    part = F.explode(F.when(F.col("id") == F.col("family"), every).otherwise(F.array(own.cast("int")))).alias("part")
    inside = pool.select("family", part, "id", F.col("id").alias("comp"), F.lit(False).alias("few"), "text").withColumn("key", F.xxhash64("family", "part"))
    links = work.save(_read_groups(inside, threshold, width), "links", 20 * n)
    linked = components(work, links)
    if large:
        known = pool.filter("blocks > 1").join(linked, "id", "left").select("family", "blocks", "id", F.coalesce("comp", "id").alias("comp"), "text")
        sums = known.select("family", "id", "comp", F.octet_length("text").alias("size")).groupBy("family", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("size"))
        main = sums.groupBy("family").agg(F.max(F.struct("k", "comp", "size")).alias("main"), F.sum("k").alias("k"), F.sum("size").alias("size"))
        main = main.select("family", F.col("main.comp").alias("main"), _blocks(F.col("k") - F.col("main.k"), F.col("size") - F.col("main.size")).alias("others"), (F.col("k") > F.col("main.k")).alias("open")).filter("open")
        known = work.save(known.join(main, "family").withColumn("few", F.col("comp") != F.col("main")), "known", 20 * n)
        across = F.sequence(F.lit(0), F.col("others") - 1)
        wide, few = known.filter("others > 1"), known.filter("others = 1")
        block = few.select("family", own.cast("int").alias("p"), F.explode(across).alias("q"), "id", "comp", F.lit(False).alias("few"), "text")
        outside = few.filter("few").select("family", F.explode(every).alias("p"), F.pmod(F.hash("id"), F.col("others")).alias("q"), "id", "comp", "few", "text")
        pairs = block.unionByName(outside).withColumn("key", F.xxhash64("family", "p", "q"))
        links = work.save(_read_groups(pairs, threshold, width), "links", 20 * n).union(linked.toDF("a", "b"))
        if not wide.isEmpty():
            links = links.union(work.save(rarest(work, wide, threshold, width), "links"))
        linked = components(work, links)
        work.drop(known, pool)
    work.drop(members)
    _freed(spark)
    return linked


def rarest(work: Workspace, known: DataFrame, threshold: Fraction, width: int) -> DataFrame:
    """(a, b): the links between components of one family that have a member outside the main one.

    Every set is put in one order, the family's rarest shingles first.  Of a pair that links, the larger set
    has a shared shingle among its first n - ceil(t * n) + 1, and the smaller among its first n - ceil(2t / (1 + t) * n) + 1;
    after the first shared one, enough must be left in both for the overlap that the threshold asks.
    """
    p, q = threshold.numerator, threshold.denominator
    sets = work.save(known.select("family", "id", "comp", "few", "text").mapInArrow(_tokens(width), TOKENS), "sets")
    each = sets.select("family", "id", "comp", "few", F.explode("tokens").alias("h"))
    rows = each.join(each.groupBy("family", "h").agg(F.count(F.lit(1)).alias("times")), ["family", "h"])
    order = F.transform(F.sort_array(F.collect_list(F.struct("times", "h"))), lambda x: x["h"])
    placed = rows.groupBy("family", "id", "comp", "few").agg(order.alias("tokens")).withColumn("n", F.size("tokens").cast("long"))
    first = F.slice("tokens", F.lit(1), F.expr(f"int(n - ({p} * n + {q} - 1) div {q} + 1)"))
    heads = placed.select("family", "id", "comp", "few", "n", F.expr(f"n - (2 * {p} * n + {p + q} - 1) div {p + q} + 1").alias("short"), F.posexplode(first).alias("at", "h"))
    heads = work.save(heads, "heads")
    x, y = heads.alias("x"), heads.filter("at < short").alias("y")
    left = F.least(F.expr("x.n - x.at"), F.expr("y.n - y.at"))
    fit = F.expr(f"(y.n < x.n OR y.n = x.n AND y.id < x.id) AND y.n * {q} >= x.n * {p} AND x.comp <> y.comp AND (x.few OR y.few)") & (left * (p + q) >= (F.col("x.n") + F.col("y.n")) * p)
    pairs = work.save(x.join(y, F.expr("x.family = y.family AND x.h = y.h") & fit).select(F.col("y.id").alias("a"), F.col("x.id").alias("b")).distinct(), "pairs")
    whole = sets.select("id", "tokens")
    both = pairs.join(whole.toDF("a", "s"), "a").join(whole.toDF("b", "t"), "b").withColumn("shared", F.size(F.array_intersect("s", "t")).cast("long"))
    return both.filter(F.col("shared") * q >= (F.size("s") + F.size("t") - F.col("shared")) * p).select("a", "b")


def near_duplicates(spark: SparkSession, docs: DataFrame, threshold: Fraction = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    A text without words has no shingles and is its own component; one with fewer words than a
    shingle has the whole sequence as its only one.  Rows that repeat a document share its component,
    and all of them are kept if its doc_id is the component's.  Rows of one doc_id with different texts
    count as linked.  Very long texts are read whole, piece by piece; other columns are not read.
    The search is random with fixed seeds; it misses a pair at the threshold with probability below
    MISS, and a little for its sketches (less for closer pairs), and reruns agree.
    """
    work = Workspace(spark, "near-dup")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = work.save(docs.mapInArrow(_sign(width), SIGNED), "signed")
    found = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("id"), F.max("n_bytes").alias("n_bytes"), F.first("sketch").alias("sketch"))
    reps = work.save(found, "reps")
    linked = confirmed(spark, work, docs, families(spark, work, reps), reps, threshold, width)
    keyed = signed.join(reps.select("n_shingles", "h1", "h2", "id"), ["n_shingles", "h1", "h2"], "left").select("doc_id", "n_shingles", "id")
    placed = keyed.join(linked, "id", "left").select("doc_id", "n_shingles", F.coalesce("comp", "id", "doc_id").alias("component_id"))
    return placed.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component, the one of the smallest doc_id.

    Of rows that repeat a doc_id one stays; rows without an id are in no component and stay.
    """
    found = near_duplicates(spark, docs)
    stay = found.filter(F.col("kept") & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    kept = Workspace(spark, "near-dup-kept").save(stay, "kept")
    out = docs.join(kept.select(F.col("doc_id").alias("__id")).hint("merge"), docs["doc_id"] == F.col("__id"), "left_semi")
    if not kept.filter("n > 1").isEmpty():
        out = out.dropDuplicates(["doc_id"])
    return out.unionByName(docs.filter(F.col("doc_id").isNull()))


def op1_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` by shingles of two words; see ``near_duplicates``."""
    return near_duplicates(spark, table(spark, sf_dir, "documents"), width=2)
