"""The fitted encoder against a decomposition of the whole matrix, and its retrieval against hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from sparkloom import queries
from sparkloom.operators import encode, fitted, search


def test_directions_are_those_of_the_whole_matrix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    model = fitted.fit(docs.repartition(3), dimensions=8)
    texts = [r.text for r in docs.collect()]
    x = model.rows(texts)
    assert np.allclose(model.weights, np.log((1 + len(texts)) / (1 + (x > 0).sum(0))) + 1)
    values, vectors = np.linalg.eigh(x @ x.T)
    top = vectors[:, ::-1][:, :8]
    assert ((x @ model.directions) ** 2).sum() > 0.98 * values[::-1][:8].sum()
    own = x @ model.directions[:, 0]
    assert abs(own @ top[:, 0]) / np.linalg.norm(own) > 0.999


def test_edges(spark):
    rows = spark.createDataFrame([(None,), ("",), ("alpha beta",), ("alpha beta",), ("? !",)], "text string")
    model = fitted.fit(rows, dimensions=4)
    got = model.encode(["alpha", "", "unknown words"])
    assert got.shape == (3, 4) and abs(np.linalg.norm(got[0]) - 1) < 1e-9 and not got[1].any()
    assert not fitted.fit(rows.filter("false"), dimensions=4).encode(["alpha"]).any()


def test_retrieval_is_better_than_by_hashing(spark):
    """Passages of ``benchmark`` must find the documents that hold them."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("text IS NOT NULL").select("doc_id", "text")
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    fitted.fit(docs, dimensions=64).register("fitted-test")
    holding: dict[int, set[int]] = {}
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    for i in items.collect():
        of = {d for d, t in texts if i.text in t}
        if of:
            holding[i.item_id] = of
    hits = {}
    for model in ("hashing-64", "fitted-test"):
        found = search.knn_join(encode.embed(items, "text", model), encode.embed(docs, "text", model), 10, "item_id", "doc_id").collect()
        hits[model] = np.mean([bool(of & {r.key for r in found if r.query == i}) for i, of in holding.items()])
    print(hits, len(holding))
    assert len(holding) >= 10 and hits["fitted-test"] > hits["hashing-64"]


def test_query(spark, sf_dir):
    rows = queries.QUERIES["search_fitted"](spark, sf_dir).collect()
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
    assert len(rows) == 10 * asked and {r.rank for r in rows} == set(range(1, 11))


def test_texts_are_taken_in_bounded_slices():
    """A batch of long texts isn't counted or multiplied at once (F6)."""
    batch = pa.RecordBatch.from_pydict({"n": [3, 3, 50, None, 1, 9, 0]})
    cut = [part.column(0).to_pylist() for part in fitted._cut(batch, batch.column(0), 3, 10)]
    assert cut == [[3, 3], [50], [None, 1, 9], [0]]
