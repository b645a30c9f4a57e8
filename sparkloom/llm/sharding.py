"""Sharding by weighted rendezvous hashing: each record key draws a score for every shard and
goes to the highest, so a shard that is added takes rows only into itself.

DataFrame expressions only.  The placing of a row needs nothing but its key; the gapless slots
come from one small count per (shard, key bucket), never from a window over a whole shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import table

#: Key buckets in which slots are numbered: 3 hexadecimal digits.
BUCKETS = 4096
#: Equal rows that are numbered at once.
CHUNK = 10_000


def _key(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("null"))


def draws(key: Column, shards: int) -> Column:
    """A number between 0 and 1 for every shard, from md5(key / shard); a null key is the key "null"."""
    return F.array(*[(F.conv(F.substring(F.md5(F.concat(_key(key), F.lit(f"/{shard}"))), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48) for shard in range(shards)])


def rendezvous(drawn: Column, weights: Sequence[float]) -> Column:
    """The shard of a key by its ``draws``: the argmax of weight / -ln(draw).

    Shards of weight 0 take nothing.  Ties go to the smaller shard.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must not be negative, nor all zero")
    scores = [F.struct((F.lit(float(w)) / -F.log(drawn[shard])).alias("score"), F.lit(-shard).alias("neg")) for shard, w in enumerate(weights) if w > 0]
    return (-(F.array_max(F.array(*scores)).getField("neg"))).cast("int")


def assign(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """Add ``shard``, ``grown_shard`` (under the weights ``grown``, else null) and ``slot``.

    Slots run from 0 without gaps in each shard, in the order of (bucket of the key, key, tie).
    Repeated rows share a shard and get slots of their own: equal rows are one row with a number until
    they have them, and rows without a key have buckets by ``tie``, so neither is one task's.  The counts
    that slots start from are one row for each (shard, bucket): at most len(weights) * 4096 rows, the
    bound of the broadcast.  No rows give no rows.  Columns of ``df`` named shard, grown_shard or slot are
    replaced; names that begin with two underscores are reserved.
    """
    rows = df.drop("shard", "grown_shard", "slot")
    names = rows.columns
    of = F.when(F.col(key).isNull(), F.concat(_key(F.col(key)), *[F.coalesce(F.col(t).cast("string"), F.lit("")) for t in tie])).otherwise(_key(F.col(key)))
    placed = rows.withColumn("__drawn", draws(F.col(key), max(len(weights), len(grown or ()))))
    placed = placed.withColumns({"shard": rendezvous(F.col("__drawn"), weights), "grown_shard": rendezvous(F.col("__drawn"), grown) if grown else F.lit(None).cast("int"), "__bucket": F.substring(F.md5(F.concat(of, F.lit("/slot"))), 1, 3)})
    single = placed.groupBy(*names, "shard", "grown_shard", "__bucket").agg(F.count(F.lit(1)).alias("__m"))
    counted = placed.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("shard", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__bucket").orderBy(F.col(key).asc_nulls_first(), *tie, *[n for n in names if n not in (key, *tie)]).rowsBetween(Window.unboundedPreceding, -1)
    numbered = single.withColumn("__row", F.coalesce(F.sum("__m").over(inside), F.lit(0))).join(F.broadcast(starts), ["shard", "__bucket"])
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__m") - 1, F.lit(CHUNK).cast("long")))
    spread = numbered.withColumn("__first", chunk).withColumn("__k", F.explode(F.sequence(F.col("__first"), F.least(F.col("__first") + CHUNK, F.col("__m")) - 1)))
    return spread.select(*names, "shard", "grown_shard", (F.col("__start") + F.col("__row") + F.col("__k")).cast("long").alias("slot"))


def op3_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 16 equal shards, and where a seventeenth would take them.

    A null text has size 1 and no checksum; an empty one size 1 and checksum 0; very long texts are
    read whole.  Documents without an id have one shard, that of the key "null".
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    out = assign(docs, "doc_id", [1.0] * 16, [1.0] * 17, ["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _oracle() -> str:
    def best(n: int) -> str:
        return "greatest(" + ", ".join(f"{{'s': 1.0::DOUBLE / -ln((('0x' || substr(md5(doc_id || '/{k}'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE), 'k': -{k}}}" for k in range(n)) + ")"

    # DuckDB has no crc32, so the checksum is built by the table-driven rule over the text's bytes.
    return f"""
    WITH RECURSIVE bits(i, v, k) AS (
        SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
        UNION ALL
        SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
    ), lut AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
    sized AS (
        SELECT doc_id, coalesce(strlen(text), 0)::BIGINT + 1 AS size,
               CASE WHEN text IS NULL THEN NULL WHEN text = '' THEN 0 ELSE
               xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(text), '..'), lambda d: ('0x' || d)::BIGINT)),
                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) END AS text_crc32
        FROM documents, lut
    ), placed AS (
        SELECT *, -({best(16)}).k AS shard, -({best(17)}).k AS grown_shard, substr(md5(doc_id || '/slot'), 1, 3) AS bucket FROM sized
    )
    SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
           row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1 AS slot, grown_shard::INT AS grown_shard
    FROM placed"""


ORACLE = _oracle()
