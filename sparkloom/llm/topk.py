"""Exact top-k inner products over an impact-ordered, score-at-a-time index.

Vectors are dealt to lanes, as many as their number asks for, each a task that indexes its vectors block
by block; they cross the shuffle once.  Every query goes to every lane as a stream.  A block's index holds posting segments
(quantised impact, dimension): the members whose component has that impact, with the component.  The
queries walk the levels of quantised impact downwards, adding each level's segments to the scores.
After a level, what is still missing from a score is at most |query| * |unread rest of the vector|
(Cauchy-Schwarz), so scores have proven limits.  The walk stops once the limits, and the scores of
which a query has k already, exclude enough vectors; those they can't exclude are possible members
and are scored again, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import Workspace, table

#: Vectors whose index is walked at once, and queries that walk it at once.
BLOCK, QUERY_BLOCK = 2048, 1024
#: Vectors of a lane: a LANES-th of all within these bounds.  Its index is some 70 bytes a component.
LANES, LEAST, MOST = 64, 2048, 1 << 15
#: Impacts (absolute components) are quantised by halving: level n holds 2^n .. 2^(n+1) - 1.
#: The walk stops when this share of the block, at most, are possible members.
OPEN_SHARE = 0.06
#: Sums of products below this are exact in single precision, below the next in double.
EXACT32, EXACT64 = 2**24, 2**53


def whole_vectors(df: DataFrame, key: str, vector: str, scale: int = 64) -> DataFrame:
    """(key, ints): floor(scale * x) of each vector that is not null and has no null or non-finite component."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return df.filter(F.col(vector).isNotNull()).select(key, x.alias("x")).filter(F.coalesce(finite, F.lit(False))).select(key, F.transform("x", lambda v: F.floor(v * scale)).alias("ints"))


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers; a shorter vector is as if filled up with zeros."""
    vectors = vectors.combine_chunks()
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64), vectors.offsets.to_numpy()
    lengths = np.diff(ends)
    out = np.zeros((len(vectors), width), np.int64)
    row = np.repeat(np.arange(len(vectors)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], lengths)] = flat
    return out


def build(matrix: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Posting segments (level, dimension, members, components), highest level first."""
    impact = np.abs(matrix)
    level = np.where(impact > 0, np.frexp(impact.astype(np.float64))[1] - 1, -1)
    out = []
    for n in range(int(level.max(initial=-1)), -1, -1):
        dims, members = np.nonzero((level == n).T)
        cut = np.flatnonzero(np.diff(dims)) + 1
        for m, d in zip(np.split(members, cut), np.split(dims, cut), strict=True):
            if len(m):
                out.append((n, int(d[0]), m.astype(np.int32), matrix[m, d[0]]))
    return out


class Block:
    """The index of one block of vectors."""

    def __init__(self, matrix: np.ndarray, ids: np.ndarray) -> None:
        self.matrix, self.ids = matrix, ids
        self.most = float(np.abs(matrix.astype(np.float64)).max(initial=0))
        segments = build(matrix)
        self.levels = sorted({s[0] for s in segments}, reverse=True)
        #: By level the segments' components, and what the squares of the levels below add up to.
        self.parts, self.rest = [], []
        rest = (matrix.astype(np.float64) ** 2).sum(1)
        for level in self.levels:
            part = np.zeros((matrix.shape[1], len(matrix)), np.int64)
            for _, dim, members, values in (s for s in segments if s[0] == level):
                part[dim, members] = values
                rest[members] -= values.astype(np.float64) ** 2
            self.parts.append(part)
            self.rest.append(np.sqrt(np.maximum(rest, 0)))


def _saturated(block: Block, queries: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All scores, where some may not fit 64 bits: exact, and those beyond the range at its ends."""
    exact = queries.astype(object) @ block.matrix.T.astype(object)
    rows, members = np.nonzero(~mine)
    return rows, members, np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in exact[rows, members]], np.int64)


def search(block: Block, queries: np.ndarray, query_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, member, score) of the k best of each query, and the levels that were read.

    Members with the query's own id are left out; ties go to the smaller id.  ``floor``: scores of which
    each query has k already; members that can't reach them are no possible members.
    """
    matrix, ids, levels = block.matrix, block.ids, block.levels
    n = len(matrix)
    order = np.argsort(ids, kind="stable")
    taken = np.searchsorted(ids[order], query_ids, "left"), np.searchsorted(ids[order], query_ids, "right")
    mine = np.zeros((len(queries), n), bool)
    for row in np.flatnonzero(taken[1] > taken[0]):
        mine[row, order[taken[0][row] : taken[1][row]]] = True
    own = float(np.abs(queries.astype(np.float64)).sum(1, initial=0).max(initial=0)) * max(1.0, block.most)
    at = len(levels)
    if own >= 2**62:
        rows, members, exact = _saturated(block, queries, mine)
    else:
        kind = np.float32 if own < EXACT32 else np.float64 if own < EXACT64 else np.longdouble
        q = queries.astype(kind)
        norm = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
        scores = np.zeros((len(q), n), kind)
        possible = ~mine
        for at, (part, rest) in enumerate(zip(block.parts, block.rest, strict=True), 1):
            scores += q @ part.astype(kind)
            margin = np.outer(norm, rest) * (1 + 1e-6) + (at < len(levels)) * 1e-3
            low = np.where(mine, -np.inf, scores - margin)
            kth = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(q), -np.inf)
            kth = kth if floor is None else np.maximum(kth, floor)
            possible = ~mine & (scores + margin >= kth[:, None])
            if possible.sum() <= max(OPEN_SHARE * n, 2 * k) * len(q):
                break
        rows, members = np.nonzero(possible)
        exact = np.zeros(len(rows), np.int64)
        for i in range(0, len(rows), 1 << 18):
            part = slice(i, i + (1 << 18))
            exact[part] = np.einsum("ij,ij->i", queries[rows[part]], matrix[members[part]])
    best = np.lexsort((ids[members], -exact.astype(object) if own >= 2**62 else -exact, rows))
    rows, members, exact = rows[best], members[best], exact[best]
    first = np.searchsorted(rows, np.arange(len(queries)))
    keep = np.arange(len(rows)) - first[rows] < k
    return rows[keep], members[keep], exact[keep], at


class _Best:
    """What a block of queries has met best so far."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int) -> None:
        self.ids, self.matrix, self.k = ids, matrix, k
        self.row, self.vec, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def meet(self, block: Block) -> None:
        count = np.bincount(self.row, minlength=len(self.ids))
        floor = np.full(len(self.ids), -np.inf)
        last = np.cumsum(count) - 1
        floor[count >= self.k] = self.score[last[count >= self.k]]
        row, member, score, _ = search(block, self.matrix, self.ids, self.k, floor)
        row, vec, score = np.concatenate((self.row, row)), np.concatenate((self.vec, block.ids[member])), np.concatenate((self.score, score))
        order = np.lexsort((vec, ~score, row))  # ~score falls as the score rises, and always fits
        row, vec, score = row[order], vec[order], score[order]
        keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(self.ids)))[row] < self.k
        self.row, self.vec, self.score = row[keep], vec[keep], score[keep]


def _walk(k: int, width: int):
    """A task's rows are a lane's: first its vectors, then the queries, which meet the blocks in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[Block] = []
        waiting: list[pa.RecordBatch] = []
        rows = 0

        def index() -> None:
            nonlocal waiting, rows
            if rows:
                part = pa.Table.from_batches(waiting)
                blocks.append(Block(_matrix(part["ints"], width), part["id"].to_numpy()))
            waiting, rows = [], 0

        for batch in batches:
            vectors = int((batch.column("kind").to_numpy() == 0).sum())
            part, rest = batch.slice(0, vectors), batch.slice(vectors)
            while part.num_rows:
                n = min(part.num_rows, BLOCK - rows)
                waiting.append(part.slice(0, n))
                part, rows = part.slice(n), rows + n
                if rows == BLOCK:
                    index()
            if rest.num_rows:
                index()
            for i in range(0, rest.num_rows if blocks else 0, QUERY_BLOCK):
                asked = rest.slice(i, QUERY_BLOCK)
                best = _Best(asked.column("id").to_numpy(), _matrix(pa.chunked_array([asked.column("ints")]), width), k)
                for block in blocks:
                    best.meet(block)
                yield pa.RecordBatch.from_arrays([pa.array(best.ids[best.row]), pa.array(best.vec), pa.array(best.score)], names=["query_id", "vec_id", "score"])

    return run


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, key: str, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with all vectors.

    Both inputs are (key, ints) as ``whole_vectors`` makes them, keys not null.  Every row that doesn't
    have the query's key is a candidate, rows that repeat each other too; the candidates of rows that
    repeat a query's key are ranked together.  Vectors of fewer dimensions count as filled up with
    zeros.  Scores beyond 64 bits count as the ends of that range.  No rows give no rows.
    """
    work = Workspace(spark, "topk")
    vectors = work.save(vectors.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), "ints"), "vectors")
    queries = work.save(queries.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), "ints"), "queries")
    widths = [df.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("ints")), F.lit(0))).first() for df in (vectors, queries)]
    n, width = widths[0][0], max(1, widths[0][1], widths[1][1])
    lanes = max(1, -(-n // min(MOST, max(LEAST, n // LANES))))
    dealt = vectors.select(F.lit(0).alias("kind"), "id", "ints", (F.monotonically_increasing_id() % lanes).cast("int").alias("lane"))  # a written table, so reruns agree
    met = dealt.unionByName(queries.select(F.lit(1).alias("kind"), "id", "ints", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")))
    met = met.repartitionById(lanes, F.col("lane")).sortWithinPartitions("kind").drop("lane")
    found = work.save(met.mapInArrow(_walk(k, width), "query_id bigint, vec_id bigint, score bigint"), "found")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_impact_ordered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all ``embeddings`` for every twentieth; see ``whole_vectors`` and ``top_k``."""
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(spark, vectors, vectors.filter("vec_id % 20 = 0"), "vec_id", 20)


ORACLE = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS ints FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.ints, c.ints), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20"""
