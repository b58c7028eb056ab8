"""Quality classifier: regularised quadratic discriminant over statistics of a text."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm.common import Scratch, held_out, slices, small_table, table
from roadweave.llm.labelled import labelled_rows

SHRINK = 0.10  # weight of the pooled covariance in a class's own
RIDGE = 0.02  # weight of the identity, in the transformed unit-variance space
STATISTICS = ("words", "distinct", "most_common", "repeats_in_row", "word_length", "word_length_spread", "punctuation", "upper", "digits", "bars", "symbols", "exclamations", "non_ascii", "lines", "compression", "worst_part", "least_distinct", "longest_word")
_UPPER, _DIGIT, _BAR, _BANG = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"|", b"!"
_SYMBOL, _POINT = b"#$%&*+/<=>@\\^_`{}~[]", b".,;:?!'\"()-"


def statistics(text: str | None) -> list[float]:
    """The numbers of STATISTICS for a whole text; a null text counts as empty, which gives zeros."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    size = len(raw)
    seen = Counter(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    bytes_ = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    share = lambda kinds: float(bytes_[list(kinds)].sum()) / size
    again = sum(map(bytes.__eq__, words, words[1:])) / n
    worst, least = 0.0, 1.0
    step = 40
    for at in range(0, n, step):
        part = words[at : at + step]
        if len(part) < 10 and n >= 10:
            continue
        joined = b"".join(part)
        odd = len(joined) - len(joined.translate(None, _SYMBOL + _BAR + b"!"))
        worst = max(worst, odd / max(1, len(joined)))
        least = min(least, len(set(part)) / len(part))
    packed = len(zlib.compress(raw, 1)) / size
    return [float(n), len(seen) / n, max(seen.values()) / n, again, float(lengths.mean()), float(lengths.std()), share(_POINT), share(_UPPER), share(_DIGIT), share(_BAR), share(_SYMBOL), share(_BANG), float(bytes_[128:].sum()) / size, raw.count(b"\n") / n, packed, worst, least, float(lengths.max())]


def transformed(x: np.ndarray) -> np.ndarray:
    """Logarithms of the counts, and of the shares with an offset, which draw their long tails in."""
    out = np.log(x + 0.01)
    k = STATISTICS.index("words")
    out[:, k] = np.log1p(x[:, k])
    # What a share of distinct words means depends on the length, so the product is a statistic as well.
    cross = out[:, [STATISTICS.index("distinct")]] * out[:, [k]]
    return np.hstack([out, cross, out[:, [STATISTICS.index("compression")]] * out[:, [k]]])


@dataclass
class Moments:
    """Rows, mean and scatter (sums of products of deviations from the mean) of transformed statistics; two of them add up exactly, without a second look at the rows."""

    rows: int
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        z = transformed(x.reshape(-1, len(STATISTICS)))
        mean = z.mean(0) if len(z) else np.zeros(z.shape[1])
        return cls(len(z), mean, (z - mean).T @ (z - mean))

    def __add__(self, other: Moments) -> Moments:
        n = self.rows + other.rows
        if not n:
            return self
        d = other.mean - self.mean
        return Moments(n, self.mean + d * (other.rows / n), self.scatter + other.scatter + np.outer(d, d) * (self.rows * other.rows / n))


def curve_sums(a: float, b: float, raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Gradient and second derivatives of the weighted logistic loss of a * raw + b."""
    p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
    w, e = weight * p * (1 - p), weight * (p - y)
    return float((e * raw).sum()), float(e.sum()), float((w * raw * raw).sum()), float((w * raw).sum()), float(w.sum())


@dataclass
class Discriminant:
    """Gaussian class densities with shrunken covariances; their inverse Cholesky factors are kept."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    inverse: list[np.ndarray]
    logdet: list[float]
    slope: float = 1.0
    offset: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, counts: dict[int, int], shrink: float = SHRINK, ridge: float = RIDGE) -> Discriminant:
        """x: statistics by row; counts: rows of each class, for the prior, where x is not in their proportion.

        Without rows of one class every score is the other class's share.
        """
        out = cls.of_moments([Moments.of(x[y == k]) for k in (0, 1)], counts, shrink, ridge)
        if out.slope:
            # A logistic curve of the log-density difference, weighted to the classes' true shares.
            weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
            weight = weight / weight.mean()
            raw = out.difference(x)
            out.calibrate(lambda a, b: curve_sums(a, b, raw, y, weight), counts)
        return out

    @classmethod
    def of_moments(cls, own: list[Moments], counts: dict[int, int], shrink: float = SHRINK, ridge: float = RIDGE) -> Discriminant:
        """The densities by the two classes' moments, which hold all that is needed of the rows; the curve is not fitted."""
        whole = own[0] + own[1]
        n, d = whole.rows, len(whole.mean)
        centre, scale = (whole.mean, np.sqrt(np.maximum(np.diag(whole.scatter), 0) / n) + 1e-6) if n else (np.zeros(d), np.ones(d))
        if min(m.rows for m in own) < 2:
            prior = 1.0 if counts.get(1, 0) >= counts.get(0, 0) else 0.0
            eye = np.eye(d)
            return cls(centre, scale, [np.zeros(d)] * 2, [eye, eye], [0.0, 0.0], 0.0, 20.0 * prior - 10.0)
        spread = [m.scatter / np.outer(scale, scale) / (m.rows - 1) for m in own]
        pooled = sum(m.rows * c for m, c in zip(own, spread)) / n
        factors = [np.linalg.cholesky((1 - shrink - ridge) * c + shrink * pooled + ridge * np.eye(d)) for c in spread]
        return cls(centre, scale, [(m.mean - centre) / scale for m in own], [np.linalg.inv(f) for f in factors], [2 * float(np.log(np.diag(f)).sum()) for f in factors])

    def calibrate(self, sums: Callable[[float, float], tuple[float, ...]], counts: dict[int, int]) -> None:
        """Newton's steps on the logistic curve; sums: curve_sums over all rows for a slope and an offset."""
        a, b, n = 0.1, float(np.log(counts[1] / counts[0])), counts[0] + counts[1]
        for _ in range(50):
            ga, gb, haa, hab, hbb = sums(a, b)
            if max(abs(ga), abs(gb)) < 1e-9 * n:
                break
            step = np.linalg.solve(np.array([[haa + 1e-6, hab], [hab, hbb + 1e-6]]), np.array([ga, gb]))
            a, b = a - float(np.clip(step[0], -0.5, 0.5)), b - float(np.clip(step[1], -2, 2))
        self.slope, self.offset = max(a, 0.0), b

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        z = (transformed(x) - self.centre) / self.scale
        d = [((z - m) @ f.T) for m, f in zip(self.means, self.inverse)]
        logs = [-0.5 * (v * v).sum(1) - 0.5 * t for v, t in zip(d, self.logdet)]
        return np.clip(np.arcsinh((logs[1] - logs[0]) / 4) * 4, -400, 400)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -40, 40)))


def measured(rows: DataFrame) -> DataFrame:
    """label and statistics of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array([statistics(t) for t in part.column("text").to_pylist()], pa.list_(pa.float64()))], names=["label", "x"])

    return rows.select("label", "text").mapInArrow(run, "label int, x array<double>")


def moments(rows: DataFrame) -> list[Moments]:
    """The moments of both classes over all of measured's rows: each task adds its rows up, and a task a class adds those sums, in the order of the tasks."""
    schema = "label int, task int, n long, mean array<double>, scatter array<double>"
    names = ["label", "task", "n", "mean", "scatter"]
    size = len(STATISTICS) + 2

    def row(label: int, task: int, m: Moments) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([task], pa.int32()), pa.array([m.rows], pa.int64()), pa.array([m.mean.tolist()], pa.list_(pa.float64())), pa.array([m.scatter.ravel().tolist()], pa.list_(pa.float64()))], names=names)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Moments.of(np.zeros((0, len(STATISTICS)))) for _ in (0, 1)]
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)) if batch.num_rows else np.zeros((0, len(STATISTICS)))
            y = batch.column("label").to_numpy()
            held = [m + Moments.of(x[y == k]) for k, m in enumerate(held)]
        for k, m in enumerate(held):
            if m.rows:
                yield row(k, TaskContext.get().partitionId(), m)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Moments] = {}
        for batch in batches:
            for r in batch.to_pylist():
                m = Moments(r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(size, size))
                held[r["label"]] = held[r["label"]] + m if r["label"] in held else m
        for k, m in held.items():
            yield row(k, 0, m)

    out = [Moments.of(np.zeros((0, len(STATISTICS)))) for _ in (0, 1)]
    for r in rows.mapInArrow(partial, schema).repartition(2, "label").sortWithinPartitions("label", "task").mapInArrow(total, schema).collect():
        out[r["label"]] = Moments(r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(size, size))
    return out


def summed_curve(raw: DataFrame, at: DataFrame) -> DataFrame:
    """curve_sums over raw's rows (label, raw), each of weight 1, for the slope and offset of at's only row.

    The sums are decimals, which add up to the same in any order. As columns, slope and offset leave the code that Spark generates
    the same for all of Newton's steps; as literals, each step's code would be compiled, and kept, by every executor.
    """
    rows = raw.crossJoin(F.broadcast(at))
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("slope") * F.col("raw") + F.col("offset")))))
    r, w, e = F.col("raw"), p * (1 - p), p - F.col("label")
    return rows.select(*(F.sum(t.cast("decimal(28,15)")) for t in (e * r, e, w * r * r, w * r, w)))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """Fits on the statistics of all training documents, whole; executors add them up, so that the driver gets sums alone.

    The statistics, 18 numbers a document, are kept in the shared folder for the time of the fit. Reruns agree.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.stored(measured(labelled_rows(docs, labels, label)), "statistics")
    own = moments(rows)
    counts = {k: m.rows for k, m in enumerate(own)}
    model = Discriminant.of_moments(own, counts)
    if model.slope:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
                    yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(model.difference(x))], names=["label", "raw"])

        raw = scratch.stored(rows.mapInArrow(run, "label int, raw double"), "differences")

        def sums(a: float, b: float) -> tuple[float, ...]:
            return tuple(float(v or 0) for v in summed_curve(raw, small_table(scratch.spark, [[a], [b]], "slope double, offset double")).first())

        model.calibrate(sums, counts)
        scratch.drop(raw)
    scratch.drop(rows)
    return model


def score_quality(docs: DataFrame, model: Discriminant, column: str = "quality_score", text: str = "text") -> DataFrame:
    """All columns of docs and the score of each whole text; a column of that name is replaced. No shuffle; only the text goes to Python, and only the score comes back."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            x = np.array([statistics(t.as_py()) for t in texts]).reshape(-1, len(STATISTICS))
            yield pa.array(model.score(x), pa.float64())

    return docs.withColumn(column, score(F.col(text)))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; a null text scores as an empty one."""
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs.select("doc_id", "text"), model, "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
