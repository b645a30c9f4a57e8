"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is good or bad.  Its features are shares of character kinds, sizes and
repetition, and the same shares of the lines before and after it.  The chain is trained by
penalised likelihood, lines taking their document's label; a document's quality is the mean of its
lines' forward-backward marginals, weighted by length and put on a scale by logistic calibration.
Neither labels, ids, languages nor sources are ever inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import kernels
from sparkloom.llm.common import table

#: The model is fitted on labelled documents, so many at most, cut into sequences of so many lines, of which
#: so many are taken; both by the smallest hashes of keys.  Scores cover every document, whole.
TRAIN_DOCUMENTS = 4000
TRAIN_LINES = 300
TRAIN_SEQUENCES = 6000
STEPS = 250
PENALTY = 1e-3
#: Documents whose crc32(id) has this remainder mod FOLDS are held out of training.
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

_KINDS = {"symbol": b"#$%&*<>=_~^\\/{}[]@+`", "pipe": b"|", "bang": b"!", "digit": b"0123456789", "stop": b".,;:?'\"-()", "upper": bytes(range(65, 91))}
_TABLES = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)).astype(np.uint8) for k, v in _KINDS.items()}
#: Own features, of which the first SHARED are also taken from either neighbour.
SHARED = 8
OWN = 14
WIDTH = OWN + 2 * SHARED


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length in bytes, text) of each line with a word; a text without any has one empty line."""
    texts = len(offsets) - 1
    starts, ends = kernels.runs(data != 10, offsets)
    own = np.zeros((len(starts), OWN), np.float64)
    size = np.zeros(len(starts), np.int64)
    text = np.searchsorted(offsets, starts, "right") - 1
    if len(starts):
        total = lambda flags: np.add.reduceat(flags, starts, dtype=np.int64)
        solid = ~kernels.IS_SPACE[data]
        size = total(solid)
        word_at, word_end = kernels.runs(solid, offsets)
        line = np.searchsorted(starts, word_at, "right") - 1
        words = np.bincount(line, minlength=len(starts))
        spelt = kernels.span_hashes(data, word_at, word_end)
        stutter = np.bincount(line[1:], weights=(spelt[1:] == spelt[:-1]) & (line[1:] == line[:-1]), minlength=len(starts))
        counts = {k: total(t[data]) for k, t in _TABLES.items()}
        n, w = np.maximum(size, 1), np.maximum(words, 1)
        hashes = kernels.span_hashes(data, starts, ends)
        order = np.lexsort((starts, hashes, text))
        again = np.zeros(len(starts), bool)
        again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
        columns = [counts["symbol"] / n, counts["upper"] / n, counts["digit"] / n, np.minimum(counts["bang"] / w, 2), np.minimum(counts["pipe"] / w, 2), counts["stop"] / n, again, stutter / w, np.log1p(words) / 5, n / w / 10, words < 4, counts["symbol"] > words / 2, counts["upper"] > n / 2]
        own[:, : OWN - 1] = np.stack(columns, 1)
    keep = size > 0
    own, size, text = own[keep], size[keep], text[keep]
    blank = np.setdiff1d(np.arange(texts), text)
    if len(blank):
        own, size, text = np.concatenate((own, np.zeros((len(blank), OWN)))), np.concatenate((size, np.ones(len(blank), np.int64))), np.concatenate((text, blank))
        order = np.argsort(text, kind="stable")
        own, size, text = own[order], size[order], text[order]
    own[:, OWN - 1] = 1
    near = np.zeros((len(own), 2 * SHARED))
    if len(own) > 1:
        same = (text[1:] == text[:-1])[:, None]
        near[1:, :SHARED] = own[:-1, :SHARED] * same
        near[:-1, SHARED:] = own[1:, :SHARED] * same
    return np.hstack((own, near)), size, text


def _steps(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences by falling length, and how many are longer than t for every t."""
    order = np.argsort(-lengths, kind="stable")
    alive = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), "left")
    return order, alive


def marginals(score: np.ndarray, first: np.ndarray, lengths: np.ndarray, trans: np.ndarray, share: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(P(good) of each line, expected transitions weighted by the later line's ``share``).

    ``score`` is a line's evidence for good over bad; sequences are runs of lines from ``first``.
    """
    order, alive = _steps(lengths)
    begin = first[order]
    alpha, beta = np.zeros((len(score), 2)), np.zeros((len(score), 2))
    both = np.stack((np.zeros(len(score)), score), 1)
    alpha[first] = both[first]
    for t in range(1, len(alive)):
        at = begin[: alive[t]] + t
        x = alpha[at - 1][:, :, None] + trans
        alpha[at] = np.logaddexp(x[:, 0], x[:, 1]) + both[at]
    for t in range(len(alive) - 1, 0, -1):
        at = begin[: alive[t]] + t
        x = trans + (both[at] + beta[at])[:, None, :]
        beta[at - 1] = np.logaddexp(x[:, :, 0], x[:, :, 1])
    end = first + lengths - 1
    z = np.logaddexp(alpha[end, 0], alpha[end, 1])
    line_z = np.repeat(z, lengths)
    good = np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - line_z, 0))
    if share is None:
        return good, np.zeros((2, 2))
    later = np.ones(len(score), bool)
    later[first] = False
    at = np.flatnonzero(later)
    pair = alpha[at - 1][:, :, None] + trans + (both[at] + beta[at])[:, None, :] - line_z[at][:, None, None]
    return good, (np.exp(pair) * share[at][:, None, None]).sum(0)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def quality(self, features: np.ndarray, size: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The length-weighted mean marginal of each sequence."""
        if not len(first):
            return np.zeros(0)
        good, _ = marginals(((features - self.mean) / self.scale) @ self.weights, first, lengths, self.trans)
        return np.add.reduceat(good * size, first) / np.add.reduceat(size, first)

    def score(self, quality: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * _logit(quality) + self.shift)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p) - np.log1p(-p)


def fit(features: np.ndarray, size: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> Model:
    """Penalised maximum likelihood by Adam steps; without documents of both labels, a flat model."""
    mean, scale = np.zeros(WIDTH), np.ones(WIDTH)
    if len(labels):
        mean, scale = features.mean(0), np.maximum(features.std(0), 1e-3)
        mean[OWN - 1], scale[OWN - 1] = 0, 1
    model = Model(mean, scale, np.zeros(WIDTH), np.zeros((2, 2)))
    if len(np.unique(labels)) < 2:
        model.slope, model.shift = 0.0, 2.0 if len(labels) == 0 or labels[0] else -2.0
        return model
    x = (features - mean) / scale
    first = np.cumsum(lengths) - lengths
    line_label = np.repeat(labels, lengths)
    share = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())  # both labels weigh the same
    line_share = np.repeat(share / lengths, lengths)  # and long documents as much as short ones
    seen = np.zeros((2, 2))
    for y in (0, 1):
        seen[y, y] = (share * (lengths - 1) / lengths)[labels == y].sum()
    theta, m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for step in range(1, STEPS + 1):
        w, trans = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
        good, agree = marginals(x @ w, first, lengths, trans, line_share)
        slope = np.empty_like(theta)
        slope[:WIDTH] = x.T @ (line_share * (line_label - good))
        slope[WIDTH:] = (seen - agree).ravel()
        slope -= PENALTY * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.weights, model.trans = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
    a = _logit(model.quality(features, size, first, lengths))
    coef = np.array([1.0, 0.0])
    design = np.stack((a, np.ones(len(a))), 1)
    for _ in range(30):  # Newton steps of the calibration
        p = 1 / (1 + np.exp(-np.clip(design @ coef, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        coef = coef + np.clip(np.linalg.solve(hessian, design.T @ (labels - p) - 1e-2 * (coef - [1.0, 0.0])), -1, 1)
    model.slope, model.shift = float(max(coef[0], 0.05)), float(coef[1])
    return model


SAMPLED = "doc_id bigint, sequence int, quality int, features binary, size binary"


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for row, _, data, offsets in kernels.pieces(batch.column(2)):
            features, size, text = line_features(data, offsets)
            first = np.searchsorted(text, np.arange(len(offsets)))
            for i, (start, end) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                at = list(range(start, end, TRAIN_LINES))
                parts = [(features[k : min(k + TRAIN_LINES, end)].astype("<f4").tobytes(), size[k : min(k + TRAIN_LINES, end)].astype("<i8").tobytes()) for k in at]
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[row + i]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([labels[row + i]] * n, pa.int32()), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())],
                    names=[x.split()[0] for x in SAMPLED.split(", ")],
                )


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled documents outside the held-out fold; the sample and its bounds are the module's.

    A document with several labels is good if any says so; equal rows of a document count once.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(TRAIN_DOCUMENTS)
    rows = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    by = [F.md5(F.concat_ws("/", "doc_id", "sequence")), "doc_id", "sequence", F.md5("features"), F.md5("size")]
    got = rows.mapInArrow(_sample, SAMPLED).distinct().orderBy(*by).limit(TRAIN_SEQUENCES).select("quality", "features", "size").collect()
    if not got:
        return fit(np.zeros((0, WIDTH)), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    sizes = [np.frombuffer(r[2], "<i8") for r in got]
    features = np.concatenate([np.frombuffer(r[1], "<f4").reshape(-1, WIDTH) for r in got]).astype(np.float64)
    return fit(features, np.concatenate(sizes), np.array([len(s) for s in sizes]), np.array([r[0] for r in got], np.float64))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1), its text left out.

    Null, empty and blank texts are scored as one empty line, very long ones whole; rows that repeat
    are scored each.  A column named score is replaced.
    """
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c not in ("score", text))
    kept = [c for c in docs.columns if c not in ("score", text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for row, stop, data, offsets in kernels.pieces(batch.column("__text")):
                features, size, of = line_features(data, offsets)
                lengths = np.bincount(of, minlength=stop - row)
                out[row:stop] = model.score(model.quality(features, size, np.cumsum(lengths) - lengths, lengths))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out)], names=[*kept, "score"])

    return docs.select(*kept, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"{kinds}, score double")


def op7_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every text of ``documents``, by a model that saw no held-out label; see ``train`` and ``score``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(spark, docs, table(spark, sf_dir, "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
