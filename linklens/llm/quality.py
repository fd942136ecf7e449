"""Operator 8: document quality by random Fourier features, ridge regression and isotonic calibration.

Statistics of the text alone (``STATISTICS``) are standardised and mapped to cosines of random projections, whose inner products approximate a
Gaussian kernel. Each partition sums its own normal equations; the sums are added in two steps, so the driver receives ``GROUPS``
matrices of a fixed size. The ridge scores are calibrated by pooling adjacent violators over a fixed number of score bins.

Labels are learned from rows whose crc32(doc_id as text) mod 3 is not 1: remainder 0 fits the weights, remainder 2 the
calibration. All labelled rows are used, none is sampled.

Defined cases: a null or empty text has its own flag and is scored; a null id is not held out and has no label; rows of labels without
quality are ignored, and several labels of one id count each; without labels of both kinds every score is the share of label 1, or
0.5 without labels; an empty table gives no row; other columns are kept by ``keep_good`` and not read by ``scores``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklens.llm.marks import flagged, place
from linklens.llm.words import lean, raw_texts, slices, unused_name
from linklens.session import stage

STATISTICS = ("log_bytes", "log_words", "word_length", "word_spread", "distinct_words", "top_word", "repeated_next", "repeated_pairs", "upper", "digits",
              "signs", "bars", "line_words", "repeated_lines", "last_signs", "upper_words", "empty")
FEATURES, RIDGE, SEED = 256, 1e-3, 11
GROUPS, BINS = 16, 1024

_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'-")
_END = frozenset(b"!#$%&*+/<=>?@^_|~")


def statistics(text: bytes) -> list[float]:
    """Statistics of one text, each bounded or logarithmic."""
    words = text.split()
    if not words:
        return [np.log1p(len(text)), *[0.0] * (len(STATISTICS) - 2), 1.0]
    n, size = len(words), len(text)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = text.split(b"\n")
    upper = sum(map(bytes.isupper, words))
    next_same = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    strip = len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(text.translate(None, b"0123456789"))
    signs = len(text.translate(None, _SIGNS))
    return [np.log1p(size), np.log1p(n), min(lengths.mean(), 50.0), min(lengths.std(), 50.0), len(counts) / n, counts.most_common(1)[0][1] / n,
            next_same / n, 1 - pairs / max(1, n - 1), (size - strip) / size, (size - digits) / size, (size - signs) / size, text.count(b"|") / n,
            np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), sum(w[-1] in _END for w in words) / n, upper / n, 0.0]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = np.array([statistics(t) for t in raw_texts(batch)], np.float64).reshape(batch.num_rows, len(STATISTICS))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(STATISTICS), pa.int32()), pa.array(rows.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), lists], ["doc_id", "text_key", "stats"])


def fold(doc_id) -> F.col:
    """crc32 of the id as text, modulo 3; a null id gives 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0))


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, stats`` of every row, staged: two passes of the fit and the scoring read it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    return stage(rows.mapInArrow(lean(_measure), "doc_id long, text_key long, stats array<double>"), "statistics")


def _lists(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), len(STATISTICS))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    values: np.ndarray
    prior: float

    def features(self, stats: np.ndarray) -> np.ndarray:
        return fourier((stats - self.mean) / self.scale)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(stats), self.prior)
        return np.clip(np.interp(self.raw(stats), self.edges, self.values), 0.0, 1.0)


def fourier(z: np.ndarray) -> np.ndarray:
    """Constant, the clipped inputs and random cosines whose products approximate exp(-|x - y|^2 / (2 * width^2))."""
    z = np.clip(z, -8, 8)
    rng = np.random.default_rng(SEED)
    width = np.sqrt(z.shape[1])
    turn = rng.standard_normal((z.shape[1], FEATURES)) / width
    shift = rng.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.ones((len(z), 1)), np.sqrt(2 / FEATURES) * np.cos(z @ turn + shift)])


def _normal(mean, scale):
    """Normal equations of a partition: one row."""
    size = FEATURES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        gram, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                cut = batch.slice(first, 4096)
                x = fourier((_lists(cut.column("stats")) - mean) / scale)
                gram += x.T @ x
                right += x.T @ np.asarray(cut.column("quality"), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), pa.array([np.vstack([gram, right]).tobytes()], pa.binary())],
                                         ["part", "sums"])
    return run


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros((FEATURES + 2) * (FEATURES + 1))
    for value in table.column("sums").to_pylist():
        total += np.frombuffer(value)
    return pa.table({"part": table.column("part").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def _raw_scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_lists(batch.column("stats")))), batch.column("quality")], ["raw", "quality"])
    return run


def isotonic(centre: np.ndarray, total: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators: rising means of ``good / total`` at the bins' centres."""
    blocks: list[list[float]] = []  # weight, sum, first centre, last centre
    for c, n, g in zip(centre, total, good):
        blocks.append([n, g, c, c])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
            n2, g2, _, last = blocks.pop()
            blocks[-1][0] += n2
            blocks[-1][1] += g2
            blocks[-1][3] = last
    edges, values = [], []
    for n, g, low, high in blocks:
        edges += [low, high] if high > low else [low]
        values += [g / n] * (2 if high > low else 1)
    return np.array(edges), np.array(values)


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Weights from fold 0 and calibration from fold 2; never from fold 1."""
    wanted = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality")).where(
        "label_id is not null and quality in (0, 1)").where(fold(F.col("label_id")) != 1)
    rows = stage(stats.join(wanted, F.col("doc_id") == F.col("label_id")).select("doc_id", fold(F.col("doc_id")).alias("fold"), "stats", "quality"), "labelled")
    names = [f"s{i}" for i in range(len(STATISTICS))]
    flat = rows.select("fold", "quality", *[F.col("stats")[i].alias(n) for i, n in enumerate(names)])
    sums = flat.agg(F.count("*").alias("n"), F.sum("quality").alias("good"), *[f(n).alias(f"{k}_{n}") for n in names for k, f in (("m", F.avg), ("d", F.stddev_pop))]).first()
    mean = np.array([sums[f"m_{n}"] or 0.0 for n in names])
    scale = np.array([sums[f"d_{n}"] or 1.0 for n in names])
    empty = Model(mean, scale, np.zeros(0), np.zeros(1), np.zeros(1), (sums["good"] or 0) / sums["n"] if sums["n"] else 0.5)
    if not sums["n"] or not 0 < sums["good"] < sums["n"]:
        return empty
    parts = rows.where("fold = 0").select("stats", "quality").mapInArrow(lean(_normal(mean, scale)), "part int, sums binary")
    added = parts.groupBy("part").applyInArrow(_add, "part int, sums binary").collect()
    total = sum((np.frombuffer(bytes(r["sums"])) for r in added), np.zeros((FEATURES + 2) * (FEATURES + 1))).reshape(FEATURES + 2, FEATURES + 1)
    gram, right = total[:-1], total[-1]
    if gram[0, 0] == 0:
        return empty
    ridge = RIDGE * np.eye(FEATURES + 1) * gram[0, 0] / (FEATURES + 1)
    ridge[0, 0] = 1e-9
    model = Model(mean, scale, np.linalg.solve(gram + ridge, right), np.zeros(1), np.zeros(1), empty.prior)

    raw = rows.where("fold = 2").select("stats", "quality").mapInArrow(lean(_raw_scores(model)), "raw double, quality int")
    place = F.floor(F.least(F.greatest("raw", F.lit(-0.5)), F.lit(1.5)) * (BINS / 2)).cast("int")
    bins = raw.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.sum("quality").alias("good"), F.avg("raw").alias("at")).orderBy("bin").collect()
    if not bins:  # no rows to calibrate on: the raw score
        model.edges, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return model
    at, n, good = (np.array([r[c] for r in bins], float) for c in ("at", "n", "good"))
    # half a row of each label keeps a pure block from being certain
    model.edges, model.values = isotonic(at, n + 1e-3, good + 5e-4)
    return model


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_lists(batch.column("stats"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(score)], ["doc_id", "text_key", "score"])
    return run


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text_key, score`` of every row."""
    stats = measured(docs)
    return stats.mapInArrow(lean(_score(fit(stats, labels))), "doc_id long, text_key long, score double")


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: whether it is held out, its score and the predicted label."""
    return scored(docs, labels).select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _keep(model: Model, columns: list[str], given: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, given):
            stats = np.array([statistics(t) for t in raw_texts(batch, given)], np.float64).reshape(batch.num_rows, len(STATISTICS))
            yield batch.select(columns).filter(pa.array(model.score(stats) >= 0.5))
    return run


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a predicted label of 1; decided in one pass over the texts, without a join."""
    wanted = labels.select(F.col("doc_id").cast("long").alias("label_id")).where(F.col("label_id").isNotNull()).where(fold(F.col("label_id")) != 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("place", place("doc_id"))
    # texts without a label are left out where they lie; the fit joins statistics and labels
    model = fit(measured(flagged(rows, wanted.select(place("label_id")), labelled=F.lit(True)).where("labelled")), labels)
    given = unused_name(docs.columns, "text_in")
    source = docs.select("*", F.col("text").cast("string").alias(given))
    return source.mapInArrow(lean(_keep(model, docs.columns, given)), docs.schema)
