"""The jobs as queries: each runs its job twice into one new folder and returns what is there then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import answer_questions, chunk_feed
from sparkloom.plans.index import scratch

_CHUNKS_SQL = """
WITH RECURSIVE lines AS (
    SELECT doc_id, source, concat_ws('/', source, doc_id || '.md') AS path, text, string_split(text, chr(10)) AS l FROM documents
    WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))) > 0
), walk AS (
    SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS part, 0::BIGINT AS n, 0::BIGINT AS k FROM lines WHERE length(text) // 4 > 256
    UNION ALL
    SELECT w.doc_id, w.i + 1,
           CASE WHEN w.k > 0 AND w.n + length(l[w.i + 1]) // 4 > 256 THEN w.part + 1 ELSE w.part END,
           CASE WHEN w.k > 0 AND w.n + length(l[w.i + 1]) // 4 > 256 THEN length(l[w.i + 1]) // 4 ELSE w.n + length(l[w.i + 1]) // 4 END,
           CASE WHEN w.k > 0 AND w.n + length(l[w.i + 1]) // 4 > 256 THEN 1 ELSE w.k + 1 END
    FROM walk w JOIN lines USING (doc_id) WHERE w.i < len(l)
), parts AS (
    SELECT doc_id, part, string_agg(l[i], chr(10) ORDER BY i) AS content FROM walk JOIN lines USING (doc_id) WHERE i > 0 GROUP BY doc_id, part
    UNION ALL SELECT doc_id, 0, text FROM lines WHERE length(text) // 4 <= 256
), chunks AS (
    SELECT doc_id, source, 'feed_docs_' || substr(sha256(path), 1, 8) || '_' || printf('%04d', part) || '_' || substr(sha256(content), 1, 8) AS chunk_id,
           path AS source_file, part::INT AS part, (length(content) // 4)::INT AS tokens, content
    FROM parts JOIN lines USING (doc_id)
)"""

CHUNKS_SQL = _CHUNKS_SQL + " SELECT doc_id, source, chunk_id, source_file, part, tokens, sha256(content) AS content_hash FROM chunks"

ANSWERS_SQL = _CHUNKS_SQL + """, asked AS (SELECT conv_id, turn, sha256(text) AS id, text FROM conversations WHERE role = 'user' AND text IS NOT NULL),
texts AS (SELECT 'c' AS kind, source_file || '#' || printf('%06d', part) AS id, content FROM chunks UNION ALL SELECT DISTINCT 'q', id, text FROM asked),
words AS (SELECT kind, id, unnest(regexp_extract_all(lower(content), '[a-z0-9_]+')) AS w FROM texts),
counted AS (SELECT kind, id, ('0x' || substr(sha256(w), 1, 8))::BIGINT % 64 AS bucket, count(*) AS n FROM words GROUP BY ALL),
vectors AS (SELECT kind, id, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY kind, id)))::FLOAT::DOUBLE AS x FROM counted),
norms AS (SELECT kind, id, sqrt(sum(x * x)) AS norm FROM vectors GROUP BY kind, id),
products AS (SELECT q.id AS q, c.id AS c, sum(q.x * c.x) AS p FROM vectors q JOIN vectors c USING (bucket) WHERE q.kind = 'q' AND c.kind = 'c' GROUP BY ALL),
scored AS (SELECT a.id AS q, b.id AS c, 1 - coalesce(p, 0) / (a.norm * b.norm) AS d FROM norms a JOIN norms b ON a.kind = 'q' AND b.kind = 'c' LEFT JOIN products ON q = a.id AND c = b.id),
ranked AS (SELECT q, c, d, row_number() OVER (PARTITION BY q ORDER BY round(d, 12), c)::INT AS rank FROM scored QUALIFY rank <= 5)
SELECT conv_id, turn, rank, doc_id, chunk_id, source, round(d, 6) + 0.0::DOUBLE AS distance FROM asked JOIN ranked ON q = id JOIN chunks ON source_file || '#' || printf('%06d', part) = c"""


def job1_chunk_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of all documents after two runs over the feed; the second finds nothing new."""
    folder = scratch(spark, "job1")
    for _ in range(2):  # a pattern, for a stream's path is a folder or a pattern, and the table may be one file
        chunk_feed.run(spark, f"{sf_dir}/documents.parquet*", f"{folder}/output", f"{folder}/checkpoint")
    chunks = chunk_feed.current(spark, f"{folder}/output")
    return chunks.select("doc_id", "source", "chunk_id", "source_file", "part", "tokens", F.sha2("content", 256).alias("content_hash"))


def job2_answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages for all questions after two runs, of which the second writes the same again."""
    folder = scratch(spark, "job2")
    for _ in range(2):
        answer_questions.run(spark, f"{sf_dir}/conversations.parquet", f"{sf_dir}/documents.parquet", f"{folder}/output")
    return answer_questions.written(spark, f"{folder}/output").select("conv_id", "turn", "rank", "doc_id", "chunk_id", "source", (F.round("distance", 6) + 0.0).alias("distance"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_chunk_feed": job1_chunk_feed, "job2_answer_questions": job2_answer_questions}
ORACLES = {"job1_chunk_feed": CHUNKS_SQL, "job2_answer_questions": ANSWERS_SQL}
