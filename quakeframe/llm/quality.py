"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Class moments are summed over all labelled rows; each class covariance is shrunk towards the pooled one and towards
the identity.  Scores are logistic in the difference of the two log densities, computed with Cholesky factors that
are inverted once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeframe.llm.common import extended, materialise, strings

FEATURES = ("log_bytes", "upper", "digit", "junk", "shout", "stop", "comma", "long_bytes", "word_length", "distinct_words", "words_a_line", "top_byte")


def _masks() -> np.ndarray:
    def of(chars: str) -> np.ndarray:
        m = np.zeros(256)
        m[[ord(c) for c in chars]] = 1
        return m

    upper = np.zeros(256)
    upper[65:91] = 1
    letters = np.zeros(256)
    letters[65:91] = letters[97:123] = 1
    letters[128:] = 1
    return np.stack([upper, of("0123456789"), of("#$%&*|<>{}[]=~^\\/_@+"), of("!?"), of("."), of(",;:"), np.concatenate([np.zeros(128), np.ones(128)]), letters], axis=1)


MASKS = _masks()


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of one text: logarithms of sizes and of smoothed shares."""
    raw = np.frombuffer(text, dtype=np.uint8)
    counts = np.bincount(raw, minlength=256)
    upper, digit, junk, shout, stop, comma, wide, letters = (counts @ MASKS).tolist()
    words = text.split()
    n_words, n_lines = len(words), text.count(b"\n") + 1
    counts[32] = 0

    def share(part: float, whole: float) -> float:
        return float(np.log((part + 0.5) / (whole + 20.0)))

    size = len(raw)
    return [
        float(np.log1p(size)),
        share(upper, letters),
        share(digit, size),
        share(junk, size),
        share(shout, size),
        share(stop, n_words),
        share(comma, n_words),
        share(wide, size),
        float(np.log1p(letters) - np.log1p(n_words)),
        float(np.log((len(set(words)) + 1) / (n_words + 1))) / float(np.log(n_words + 3)),
        float(np.log1p(n_words / n_lines)),
        share(float(counts.max()) if size else 0.0, size),
    ]


def add_statistics(docs: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """Add the array column ``out``; null counts as empty."""
    kept = docs.select(*[c for c in docs.columns if c != out])

    def run(batches):
        for batch in batches:
            values = [statistics(t) for t in strings(batch.column(batch.schema.get_field_index(text)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.list_(pa.float64()))], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, extended(kept, **{out: "array<double>"}))


@dataclass
class Discriminant:
    """Prior log odds, and for each class the mean, the inverted Cholesky factor and the log determinant."""

    centre: np.ndarray
    scale: np.ndarray
    log_odds: float
    classes: list[tuple[np.ndarray, np.ndarray, float]]

    @classmethod
    def fit(cls, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pool: float, ridge: float) -> Discriminant:
        """From count, sum and sum of outer products of each class.  A missing class leaves the prior alone."""
        present = {c: m for c, m in moments.items() if m[0] > 0}
        k = len(FEATURES)
        n = {c: present[c][0] if c in present else 0.0 for c in (0, 1)}
        log_odds = float(np.log((n[1] + 1) / (n[0] + 1)))
        if len(present) < 2:
            return cls(np.zeros(k), np.ones(k), log_odds, [])
        total = sum(m[0] for m in present.values())
        within = sum(m[2] - np.outer(m[1], m[1]) / m[0] for m in present.values()) / total
        centre = sum(m[1] for m in present.values()) / total
        scale = np.sqrt(np.maximum(np.diag(within), 1e-12))
        pooled = within / np.outer(scale, scale)
        classes = []
        for c in (0, 1):
            count, sums, outer = present[c]
            mean = sums / count
            own = (outer / count - np.outer(mean, mean)) / np.outer(scale, scale)
            weight = pool + (1 - pool) * k / (k + count)  # few rows: lean on the pooled covariance
            cov = (1 - ridge) * ((1 - weight) * own + weight * pooled) + ridge * np.eye(k)
            factor = np.linalg.cholesky((cov + cov.T) / 2)
            classes.append(((mean - centre) / scale, np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum())))
        return cls(centre, scale, log_odds, classes)

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        odds = np.full(len(stats), self.log_odds)
        if self.classes:
            z = (stats - self.centre) / self.scale
            density = [-0.5 * ((((z - mean) @ inverse.T) ** 2).sum(axis=1) + log_det) for mean, inverse, log_det in self.classes]
            odds = odds + density[1] - density[0]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def learn(labelled: DataFrame, label: str, stats: str = "stats", pool: float = 0.1, ridge: float = 0.02) -> Discriminant:
    """Fit on every row with label 0 or 1: moments are summed inside tasks, then over the few partial rows."""
    k = len(FEATURES)

    def run(batches):
        held = {c: np.zeros(1 + k + k * k) for c in (0, 1)}
        for batch in batches:
            classes = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            for c in (0, 1):
                own = x[classes == c]
                held[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).reshape(-1)])
        for c, sums in held.items():
            if sums[0]:
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["c", "sums"])

    rows = labelled.filter(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("c"), stats)
    partial = rows.mapInArrow(run, "c int, sums array<double>")
    sums = partial.select("c", F.posexplode("sums")).groupBy("c", "pos").agg(F.sum("col").alias("v")).toPandas()
    moments = {}
    for c, part in sums.groupby("c"):
        v = part.sort_values("pos")["v"].to_numpy()
        moments[int(c)] = (v[0], v[1 : 1 + k], v[1 + k :].reshape(k, k))
    return Discriminant.fit(moments, pool, ridge)


def score_quality(docs: DataFrame, labels: DataFrame, held_out, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Fits on the rows of ``docs`` that are not ``held_out`` and have a label 0 or 1 in ``labels``; null and other
    labels are ignored, repeated labels count each time.  Text alone decides: null counts as empty, and empty texts
    are scored like others.  Without labels of both classes every score is the smoothed prior.
    """
    stats = materialise(add_statistics(docs.select("doc_id", "text")).select("doc_id", "stats"))
    known = stats.filter(~held_out(F.col("doc_id"))).join(labels.select("doc_id", "quality"), "doc_id")
    model = learn(known, "quality")

    def run(batches):
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(x))], names=["doc_id", "held_out", "score"])

    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "stats").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
