"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of a document's whole text are standardised and mapped by random Fourier
features, ``sqrt(2 / D) * cos(W x + b)``, whose inner products approximate a Gaussian
kernel. Ridge weights solve the normal equations; each partition sums its own part of
``Z'Z`` and ``Z'y`` and the parts are added in levels, so the fit uses every labelled row
outside the held-out third and the driver adds the last level's few D x D matrices. Scores
of other labelled rows, summed in bins, are calibrated by isotonic regression.

Rows are dealt by ``crc32(id as text) mod 3``: 0 fits the weights, 2 the calibration, and 1
is held out: its labels are never read. Scores depend on texts alone.

Edge cases: a null text is an empty text, which has a score too; a null id is not held out
and has no label; an id with several label rows counts once for each; without labels all
scores are 0.5; repeated rows get the same score; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Random features, kernel width (in standard deviations), ridge and calibration bins.
N_FEATURES = 256
WIDTH = 4.0
RIDGE = 1e-2
BINS = 400
SEED = 7
LOW, HIGH = -0.5, 1.5
#: Partial sums that one task or the driver adds, about; more are added in levels.
FAN_IN = 16
STATS = (
    "log_bytes", "log_words", "mean_word", "upper", "digit", "symbol", "bang", "pipe", "punct", "space",
    "newline", "high_bytes", "distinct", "top_word", "line_distinct", "words_per_line", "entropy", "caps_words",
)
_CLASS = np.zeros((256, 9))
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>=@^~{}[]\\/_+", b"!", b"|", b".,;:?'\"()-", b" \t", b"\n\r", bytes(range(128, 256)))):
    _CLASS[list(_chars), _i] = 1.0


def statistics(text: str) -> list[float]:
    """The numbers that describe a text, in the order of STATS."""
    raw = text.encode()
    n = len(raw)
    if not n:
        return [0.0] * len(STATS)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    share = counts @ _CLASS / n
    p = counts[counts > 0] / n
    words = text.split()
    k = len(words)
    seen: dict[str, int] = {}
    caps = 0
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    for w, c in seen.items():
        if w.isupper():
            caps += c
    lines = [x for x in text.split("\n") if x]
    return [
        math.log1p(n), math.log1p(k), min(n / max(k, 1), 60.0), share[0], share[1], share[2], share[3], share[4], share[5], share[6],
        share[7], share[8], math.log1p(len(seen)) / math.log1p(max(k, 1)) if k else 0.0, max(seen.values(), default=0) / max(k, 1),
        len(set(lines)) / max(len(lines), 1), math.log1p(k / max(len(lines), 1)), float(-(p * np.log2(p)).sum()), caps / max(k, 1),
    ]


def _fourier() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.normal(size=(len(STATS), N_FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, N_FEATURES)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bin_at: np.ndarray
    bin_score: np.ndarray

    def z(self, x: np.ndarray) -> np.ndarray:
        w, b = _fourier()
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.ones((len(x), 1)), math.sqrt(2 / N_FEATURES) * np.cos(x @ w + b)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.z(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.bin_at, self.bin_score) if len(x) else np.zeros(0)


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def make():
        return lambda texts: [pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))]

    return common.map_rows(docs.select(id_col, text_col), 1, [T.StructField("x", T.ArrayType(T.DoubleType()))], make, keep=[id_col])


def _normal_equations(rows: DataFrame, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y, summed in each partition, then in levels of partial sums.

    Levels are grouped frames, not a reduce behind the mapper: a task needs one Python
    worker, and an executor keeps no more of them than it has slots.
    """
    d = N_FEATURES + 1

    def run(batches):
        a, b = np.zeros((d, d)), np.zeros(d)
        for batch in batches:
            if batch.num_rows:
                z, y = model.z(np.array(batch.column(0).to_pylist())), np.array(batch.column(1).to_pylist(), dtype=float)
                a += z.T @ z
                b += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], names=["part", "a", "b"])

    def added(parts) -> np.ndarray:
        return sum(np.frombuffer(p) for p in parts)

    def add(key, table):
        a, b = (added(x.as_py() for x in table[c]).tobytes() for c in ("a", "b"))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "a": pa.array([a], pa.binary()), "b": pa.array([b], pa.binary())})

    sums = rows.select("x", "y").mapInArrow(run, "part long, a binary, b binary")
    n = rows.rdd.getNumPartitions()  # a number of the plan; nothing runs
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        sums = sums.withColumn("part", F.col("part") % n).groupBy("part").applyInArrow(add, "part long, a binary, b binary")
    last = sums.collect()  # FAN_IN rows at most
    return added(bytes(r["a"]) for r in last).reshape(d, d), added(bytes(r["b"]) for r in last)


def _isotonic(totals: list[tuple[int, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Bin centres and calibrated scores from (bin, label sum, rows)."""
    blocks: list[list] = []
    for b, y, n in sorted(totals):
        blocks.append([[b], y, n])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            bins, y, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + bins, blocks[-1][1] + y, blocks[-1][2] + n]
    at, score = [], []
    for bins, y, n in blocks:
        for b in (bins[0], bins[-1]) if len(bins) > 1 else (bins[0],):
            at.append(LOW + (b + 0.5) * (HIGH - LOW) / BINS)
            score.append((y + 0.5) / (n + 1))
    return np.array(at), np.maximum.accumulate(score)


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> QualityModel:
    """Fit on ``stats`` (id, x) and the labels of rows that are not held out."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("y")).where("y is not null and _id is not null")
    known = known.where(fold("_id") != 1)
    rows = stats.join(known, stats[id_col] == known["_id"]).select("x", "y", fold("_id").alias("fold"))
    rows = common.staged(rows, "quality-train")
    k = len(STATS)
    moments = rows.agg(F.count(F.lit(1)).alias("n"), *[f(F.col("x")[i]).alias(f"{name}{i}") for i in range(k) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    flat = QualityModel(np.zeros(k), np.ones(k), np.zeros(N_FEATURES + 1), np.array([0.0]), np.array([0.5]))
    if not moments["n"]:
        return flat
    flat.mean = np.array([moments[f"m{i}"] for i in range(k)])
    flat.scale = np.array([max(moments[f"s{i}"], 1e-3) for i in range(k)])
    both = {r[0] for r in rows.select("fold").distinct().collect()} == {0, 2}
    a, b = _normal_equations(rows.where("fold = 0") if both else rows, flat)
    flat.weights = np.linalg.solve(a + RIDGE * np.eye(len(b)), b)
    model = flat

    def run(batches):
        for batch in batches:
            raw = model.raw(np.array(batch.column(0).to_pylist())) if batch.num_rows else np.zeros(0)
            place = np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place), batch.column(1)], names=["bin", "y"])

    held = (rows.where("fold = 2") if both else rows).select("x", "y").mapInArrow(run, "bin long, y double")
    totals = [tuple(r) for r in held.groupBy("bin").agg(F.sum("y"), F.count(F.lit(1))).collect()]  # BINS rows at most
    model.bin_at, model.bin_score = _isotonic(totals)
    return model


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted of every document."""
    stats = common.staged(with_statistics(docs, id_col, text_col), "quality-stats")
    model = fit(stats, labels, id_col)
    out = T.StructType([stats.schema[id_col], T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            s = model.score(np.array(batch.column(1).to_pylist())) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=out.names)

    scored = stats.mapInArrow(run, out)
    return scored.select(id_col, F.coalesce(fold(id_col) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def filter_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, all columns unchanged."""
    model = fit(common.staged(with_statistics(docs, id_col, text_col), "quality-stats"), labels, id_col)

    def make():
        return lambda texts: [pa.array(model.score(np.array([statistics(t) for t in texts])) >= least)]

    return common.map_rows(docs, docs.columns.index(text_col), [], make, where=lambda new: new[0])
