"""A text encoder fitted to a corpus: latent semantic analysis by distributed subspace iteration (PRJ-21).

A text is its words' tf-idf weights, by buckets of their hashes, at unit length.  The directions in which the
corpus varies most are found by passes over it: each task multiplies its rows with the directions so far and
adds up what these say about buckets, Spark adds the tasks' sums, and the driver makes the sums (buckets x
dimensions, whatever the number of texts) orthogonal again.  Encoding needs one product with the directions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import encode

#: Buckets of words, passes over the corpus, directions beside those that are kept; texts of a product at most, and
#: their (text, bucket) pairs; texts that are counted at a time at most, and their characters.
BUCKETS, PASSES, EXTRA, ROWS = 4096, 3, 16, 256
PAIRS, COUNTED, CHARACTERS = 1 << 15, 256, 1 << 19


def counts(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, times) of the words of texts; words as the hashing encoder takes them."""
    found = [encode.buckets(text or "") % buckets for text in texts]
    if not any(map(len, found)):
        return (np.zeros(0, np.int64),) * 3
    pair, times = np.unique(np.repeat(np.arange(len(found)), list(map(len, found))) * buckets + np.concatenate(found), return_counts=True)
    return pair // buckets, pair % buckets, times


@dataclass
class Fitted:
    """Weights of buckets and directions (buckets x dimensions)."""

    weights: np.ndarray
    directions: np.ndarray

    def weighed(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, bucket, tf-idf weight): texts as rows of unit length, by text."""
        return self.weigh(*counts(texts, len(self.weights)), len(texts))

    def weigh(self, row: np.ndarray, bucket: np.ndarray, times: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of counted words, of ``n`` texts."""
        value = (1 + np.log(times)) * self.weights[bucket]
        norm = np.sqrt(np.bincount(row, weights=value**2, minlength=n))
        return row, bucket, value / norm[row]

    def rows(self, texts: list[str | None]) -> np.ndarray:
        """The same as a matrix."""
        row, bucket, value = self.weighed(texts)
        out = np.zeros((len(texts), len(self.weights)))
        out[row, bucket] = value
        return out

    def project(self, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Products of ``n`` weighed texts with the directions."""
        out = np.zeros((n, self.directions.shape[1]))
        here = np.unique(row)
        if len(here):
            out[here] = np.add.reduceat(value[:, None] * self.directions[bucket], np.searchsorted(row, here))
        return out

    def encode(self, texts: list[str]) -> np.ndarray:
        """One vector of unit length a text; zero for texts without words."""
        return _unit(self.project(*self.weighed(texts), len(texts)))

    def register(self, name: str) -> None:
        """Make it an encoder that ``encode.embed`` knows by that name in this session."""
        encode.register(name, lambda: self.encode, self.directions.shape[1])


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x**2).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def counted(corpus: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(kept columns, bucket, times): the words of each text, counted; to be written, for every pass reads them."""
    kinds = "".join(f"`{c}` {corpus.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _cut(batch, pa.compute.utf8_length(batch.column(len(keep))), COUNTED, CHARACTERS):
                row, bucket, times = counts(part.column(len(keep)).to_pylist(), BUCKETS)
                ends = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (bucket, times)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *lists], names=[*keep, "bucket", "times"])

    return corpus.select(*keep, F.col(text).cast("string")).mapInArrow(run, f"{kinds}bucket array<int>, times array<int>")


def _cut(batch: pa.RecordBatch, sizes: pa.Array, rows: int, most: int) -> Iterator[pa.RecordBatch]:
    """All of a batch in slices of so many rows at most and of ``most`` in their sizes, or of one row."""
    ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, "right"))))
        yield batch.slice(at, to - at)
        at = to


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, times) of counted rows."""
    bucket, times = batch.column("bucket"), batch.column("times")
    return np.repeat(np.arange(batch.num_rows), bucket.value_lengths().to_numpy()), bucket.flatten().to_numpy(), times.flatten().to_numpy()


def embedded(rows: DataFrame, model: Fitted, keep: Sequence[str]) -> DataFrame:
    """(kept columns, embedding) of ``counted`` rows."""
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _cut(batch, batch.column("bucket").value_lengths(), ROWS, PAIRS):
                x = _unit(model.project(*model.weigh(*_lists(part), part.num_rows), part.num_rows)).astype(np.float32)
                ends = pa.array(np.arange(part.num_rows + 1) * x.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=[*keep, "embedding"])

    return rows.select(*keep, "bucket", "times").mapInArrow(run, f"{kinds}embedding array<float>")


def _summed(parts: DataFrame, width: int) -> np.ndarray:
    """Sums by bucket of the tasks' (bucket, values), added up in Spark before they reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            for b, v in zip(batch.column(0).to_pylist(), values, strict=True):
                total[b] = total[b] + v if b in total else v.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["bucket", "values"])

    out = np.zeros((BUCKETS, width))
    for r in parts.repartition("bucket").mapInArrow(run, "bucket int, values array<double>").collect():
        out[r.bucket] = r["values"]
    return out


def _emit(sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    used = np.flatnonzero(sums.any(1))
    if len(used):
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sums[used].tolist(), pa.list_(pa.float64()))], names=["bucket", "values"])


def fit(corpus: DataFrame, text: str = "text", dimensions: int = 64, seed: int = 0) -> Fitted:
    """The directions of a corpus of texts; their counted words are written once, in a scratch folder."""
    from sparkloom.plans.index import scratch

    path = scratch(corpus.sparkSession, "counted")
    counted(corpus, text).write.parquet(path)
    return fit_counted(corpus.sparkSession.read.schema("bucket array<int>, times array<int>").parquet(path), dimensions, seed)


def fit_counted(rows: DataFrame, dimensions: int = 64, seed: int = 0) -> Fitted:
    """The directions of ``counted`` rows.  Null and wordless texts count as texts; reads them PASSES + 1 times."""
    rows = rows.select("bucket", "times")
    width = dimensions + EXTRA

    def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((BUCKETS, 2))
        for batch in batches:
            seen[:, 0] += np.bincount(_lists(batch)[1], minlength=BUCKETS)
            seen[0, 1] += batch.num_rows
        yield from _emit(seen)

    seen = _summed(rows.mapInArrow(document_counts, "bucket int, values array<double>"), 2)
    weights = np.log((1 + seen[0, 1]) / (1 + seen[:, 0])) + 1
    model = Fitted(weights, np.linalg.qr(np.random.default_rng(seed).normal(size=(BUCKETS, width)))[0])

    def products(now: Fitted):
        single = Fitted(now.weights, now.directions.astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((BUCKETS, width))
            for batch in batches:
                for part in _cut(batch, batch.column("bucket").value_lengths(), ROWS, PAIRS):
                    row, bucket, value = single.weigh(*_lists(part), part.num_rows)
                    if len(row):
                        value = value.astype(np.float32)
                        y = single.project(row, bucket, value, part.num_rows).astype(np.float32)
                        order = np.argsort(bucket, kind="stable")
                        here = np.unique(bucket)
                        sums[here] += np.add.reduceat(value[order, None] * y[row[order]], np.searchsorted(bucket[order], here))
            yield from _emit(sums)

        return run

    for _ in range(PASSES):
        sums = _summed(rows.mapInArrow(products(model), "bucket int, values array<double>"), width)
        if not sums.any():
            return Fitted(weights, np.zeros((BUCKETS, dimensions)))
        inner = np.linalg.eigh(model.directions.T @ sums)  # of the covariance inside the directions, for their order
        model = Fitted(weights, np.linalg.qr(sums @ inner[1][:, ::-1])[0])
    return Fitted(weights, model.directions[:, :dimensions])
