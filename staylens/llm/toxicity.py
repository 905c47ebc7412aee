"""Toxicity: cumulative-link ordinal regression over words and word prefixes.

One weight vector serves all grades; grade thresholds are ordered cut points on its
score: P(grade > k) = sigmoid(w.x - cut_k). The expected severity is the sum of these
probabilities. Features are presences of whole words and of their first characters (a
language that inflects its slurs shares the stem), chosen on the training rows by how
far they tell toxic rows from clean ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import bound_batches, text_or_empty

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
# Documented bounds of the fit: rows of each kind (toxic, clean) and features kept.
FIT_ROWS = 4000
FEATURES = 1024
# Features in fewer rows, or less than so many times as frequent in one kind, say nothing.
LEAST_ROWS = 5
LEAST_RATIO = 3.0


def features(text: str) -> set[str]:
    """Distinct words and marked word prefixes of a text."""
    words = set(WORD.findall(text.lower()))
    return words.union(*({w[:n] + "~" for w in words if len(w) > n} for n in PREFIXES)) if words else words


@dataclass
class SeverityModel:
    """Shared weights by feature and one cut point per grade above the lowest."""

    weights: dict[str, float]
    cuts: np.ndarray

    def score(self, text: str) -> float:
        get = self.weights.get
        words = set(WORD.findall(text.lower()))
        total = sum(get(w, 0.0) for w in words)
        for n in PREFIXES:
            total += sum(get(p, 0.0) for p in {w[:n] + "~" for w in words if len(w) > n})
        return total

    def above(self, score: float) -> np.ndarray:
        """P(grade > k) for every k, falling in k."""
        return 1 / (1 + np.exp(np.clip(self.cuts - score, -50, 50)))


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int, steps: int = 300, decay: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered cuts by gradient descent on the sum of all threshold losses.

    ``x`` has one row per text and one 0/1 column per feature, ``y`` grades from 0.
    Cuts are a first cut plus gaps that cannot be negative. A grade without rows gets a
    cut beyond the last one that has some.
    """
    f = x.shape[1]
    w, first, gaps = np.zeros(f, x.dtype), 0.0, np.zeros(max(0, grades - 2))
    targets = (y[:, None] > np.arange(grades - 1)[None, :]).astype(float)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    moment = np.zeros(f + grades - 1)
    rate = 4.0 / max(1.0, x.sum(1).mean())
    for _ in range(steps):
        cuts = first + np.concatenate([[0.0], np.cumsum(np.log1p(np.exp(gaps)))])
        p = 1 / (1 + np.exp(np.clip(cuts[None, :] - (x @ w)[:, None], -50, 50)))
        error = (p - targets) * share[:, None]
        by_cut = -error.sum(0)
        tail = np.cumsum(by_cut[::-1])[::-1]
        slope = np.concatenate([x.T @ error.sum(1).astype(x.dtype) + decay * w, [tail[0]], tail[1:] / (1 + np.exp(-gaps))])
        moment = 0.9 * moment + slope
        w -= (rate * moment[:f]).astype(x.dtype)
        first -= moment[f]
        gaps -= moment[f + 1:]
    return w, first + np.concatenate([[0.0], np.cumsum(np.log1p(np.exp(gaps)))])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    grade_col: str = "grade",
    grades: int = 3,
    fit_rows: int = FIT_ROWS,
    keep: int = FEATURES,
) -> SeverityModel:
    """Fit on at most ``fit_rows`` toxic and ``fit_rows`` clean rows, drawn by a hash of the id.

    ``labels`` gives a grade (0 = clean, up to ``grades`` - 1) per id; rows with a missing
    id or grade are left out, of several grades of one id the highest counts. The driver
    receives the chosen features of the drawn rows only. Without labelled rows the model
    gives every text severity near 0.
    """
    bound_batches(docs.sparkSession)
    graded = (
        labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{grade_col}`").cast("int").alias("grade"))
        .where("id is not null and grade is not null")
        .groupBy("id")
        .agg(F.least(F.max("grade"), F.lit(grades - 1)).alias("grade"))
    )
    draw = F.xxhash64("id", F.lit(17))
    drawn = graded.where("grade > 0").orderBy(draw, "id").limit(fit_rows).unionByName(
        graded.where("grade = 0").orderBy(draw, "id").limit(fit_rows)
    )
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text"))
    # at most 2 * fit_rows ids are broadcast, whatever the size of the table of labels
    sample = texts.join(F.broadcast(drawn), "id").select("grade", "text")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"grade": batch["grade"], "found": [sorted(features(t)) for t in batch["text"]]})

    found = sample.mapInPandas(extract, "grade int, found array<string>").cache()
    try:
        sizes = dict(found.groupBy((F.col("grade") > 0).alias("bad")).count().collect())
        if not sizes.get(True):
            return SeverityModel({}, np.arange(grades - 1) + 6.0)
        bad, good = sizes[True], max(1, sizes.get(False, 0))
        counts = (
            found.select((F.col("grade") > 0).cast("int").alias("bad"), F.explode("found").alias("feature"))
            .groupBy("feature")
            .agg(F.sum("bad").alias("b"), F.sum(1 - F.col("bad")).alias("g"))
            .where(F.col("b") + F.col("g") >= min(LEAST_ROWS, bad))
        )
        odds = F.log((F.col("b") + 0.5) / (bad + 1.0)) - F.log((F.col("g") + 0.5) / (good + 1.0))
        gain = F.abs(odds) * F.sqrt((F.col("b") / bad + F.col("g") / good))
        chosen = [r[0] for r in counts.where(F.abs(odds) >= F.log(F.lit(LEAST_RATIO))).orderBy(gain.desc(), "feature").limit(keep).collect()]
        index = {name: k for k, name in enumerate(chosen)}

        def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"grade": batch["grade"], "at": [[index[f] for f in fs if f in index] for fs in batch["found"]]})

        rows = found.mapInPandas(narrow, "grade int, at array<int>").collect()
    finally:
        found.unpersist()
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for k, row in enumerate(rows):
        x[k, row["at"]] = 1.0
    w, cuts = fit_ordinal(x, np.array([r["grade"] for r in rows]), grades)
    return SeverityModel(dict(zip(chosen, w.tolist())), cuts)


def score_severity(
    docs: DataFrame, model: SeverityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5
) -> DataFrame:
    """All columns of ``docs`` that are scored by: id, ``severity``, ``toxic`` and ``p_above``.

    One row per input row. ``severity`` is the expected grade, ``p_above`` the
    probabilities of exceeding each grade, ``toxic`` whether the severity reaches
    ``threshold``. A missing text is an empty one, which scores by the cuts alone. Whole
    texts are read; repeated rows give repeated results; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            above = [model.above(model.score(t)) for t in batch["text"]]
            severity = [float(a.sum()) for a in above]
            yield pd.DataFrame({
                "id": batch["id"], "severity": severity, "toxic": [s >= threshold for s in severity],
                "p_above": [a.tolist() for a in above],
            })

    found = source.mapInPandas(score, f"id {kind}, severity double, toxic boolean, p_above array<double>")
    return found.withColumnRenamed("id", id_col)


def drop_toxic(
    docs: DataFrame, model: SeverityModel, text_col: str = "text", threshold: float = 0.5
) -> DataFrame:
    """The rows of ``docs`` below the threshold, with all their columns as they were."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def severity(texts: pd.Series) -> pd.Series:
        return pd.Series([float(model.above(model.score(t)).sum()) for t in texts], dtype="float64")

    return docs.where(severity(text_or_empty(text_col)) < threshold)


def grades_of(labels: DataFrame, toxic_col: str = "toxic", quality_col: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """Severity grades of labelled rows: 0 clean, 1 toxic, 2 toxic and of low quality."""
    toxic, quality = F.col(f"`{toxic_col}`"), F.coalesce(F.col(f"`{quality_col}`"), F.lit(1))
    grade = F.when(toxic.isNull(), None).when(toxic == 0, 0).otherwise(1 + (quality == 0).cast("int"))
    return labels.select(F.col(f"`{id_col}`"), grade.alias("grade"))
