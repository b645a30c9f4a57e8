from __future__ import annotations

import shutil

from sparkloom.operators import chunking
from sparkloom.streaming import ingest
from tests.compare import from_spark


def test_windows_of_a_stream_equal_the_batch(spark, sf_dir, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    shutil.copy(f"{sf_dir}/events.parquet", folder / "events.parquet")
    batch = spark.read.parquet(str(folder))
    stream = spark.readStream.schema(batch.schema).parquet(str(folder))
    query = ingest.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination(120)
    round_ = lambda d: d.selectExpr("start", "event_type", "n", "round(total, 4) AS total")
    assert from_spark(round_(spark.table("windows"))) == from_spark(round_(ingest.windowed(batch)))


def test_files_stream_into_chunks(spark, tmp_path):
    source = tmp_path / "in"
    schema = "repo string, path string, content string, file_type string"
    spark.createDataFrame([("r", "a.md", "# A\n" + "x" * 60, "docs")], schema).write.parquet(str(source))
    got = []
    stream = spark.readStream.schema(schema).parquet(str(source))
    ingest.index_stream(stream, str(tmp_path / "check"), lambda c: got.extend(r.chunk_id for r in c.collect())).awaitTermination(120)
    expected = chunking.chunk_files(spark.read.schema(schema).parquet(str(source)))
    assert got == [r.chunk_id for r in expected.collect()] and len(got) == 1
