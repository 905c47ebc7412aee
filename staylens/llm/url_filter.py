"""URL verdicts: host and path rules, else logistic regression on hashed character n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.llm.common import bound_batches, text_or_empty

NGRAMS = (3, 4, 5)
BITS = 15
# Documented bound on the rows a model is fitted on; a longer table is refused, not cut.
MAX_ROWS = 20_000


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains and all paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, rule: str) -> Rule:
        host, slash, path = rule.partition("/")
        return cls(verdict, host, slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path


# Words of hosts and paths for the small labelled table, joined by `seed_urls`.
BAD_WORDS = "spam cheap pills casino bonus adult viagra poker ads track lottery payday loans replica xxx cams farm clicks torrent warez".split()
GOOD_WORDS = "library museum news docs school garden weather history science journal council health travel sports music recipes university forum archive city".split()
SYLLABLES = "th re on in er an sh ti ha ea or ou le be de".split()
HOMES = ("example.com", "example.net", "example.org")
PARTS = ("", "www.", "blog.", "m.")
TAILS = ("/", "/en/17", "/de/203.html", "/fr/8?page=2", "/es/64/", "/item/5#top")


def seed_urls(spark: SparkSession) -> DataFrame:
    """The labelled table, ``url`` and ``blocked``: pairs of words as hosts, made by rule.

    Hosts of advertising and piracy words are blocked; hosts of everyday words and of
    plain syllables are not. Homes, subdomains and paths are the same on both sides, so
    that only the names tell them apart.
    """
    rows = []
    k = 0
    for blocked, words, joint in ((1, BAD_WORDS, "-"), (0, GOOD_WORDS, "-"), (0, SYLLABLES, ""), (0, GOOD_WORDS, ""), (1, BAD_WORDS, "")):
        for a in words:
            for b in words:
                name = f"{a}{joint}{b}" if a != b else a
                name += words[(k * 7) % len(words)] if words is SYLLABLES else ""
                rows.append((f"http://{PARTS[k % 4]}{name}.{HOMES[k % 3]}{TAILS[k % 6]}", blocked))
                k += 1
    return spark.createDataFrame(rows, "url string, blocked int")


def host_of(url: Column) -> Column:
    """What follows the first ``://``, up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    return F.translate(
        F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def grams(host: str, path: str) -> np.ndarray:
    """Distinct hashed n-grams; host and path have n-grams of their own."""
    found = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in NGRAMS:
            found.update(zlib.crc32(f"{mark}{text[i:i + n]}".encode("utf-8", "replace")) for i in range(len(text) - n + 1))
    return np.unique(np.fromiter(found, np.int64, len(found)) & ((1 << BITS) - 1))


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", steps: int = 300, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last is the intercept) by full-batch gradient descent.

    ``labelled`` is a small table of at most ``MAX_ROWS`` rows. Rows without a label
    are left out; a table without rows gives a model that allows everything.
    """
    url = text_or_empty(url_col)
    rows = (
        labelled.where(F.col(f"`{label_col}`").isNotNull())
        .select(host_of(url).alias("h"), path_of(url).alias("p"), F.col(f"`{label_col}`").cast("double").alias("y"))
        .orderBy("h", "p", "y")
        .limit(MAX_ROWS + 1)
        .collect()
    )
    if len(rows) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} labelled URLs")
    weights = np.zeros((1 << BITS) + 1)
    if not rows:
        weights[-1] = -1.0
        return weights
    sets = [grams(r["h"], r["p"]) for r in rows]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    col = np.concatenate(sets)
    scale = 1.0 / np.sqrt(np.array([max(1, len(s)) for s in sets]))
    y = np.array([r["y"] for r in rows])
    moment = np.zeros_like(weights)
    for _ in range(steps):
        z = np.bincount(row, weights[col], len(sets)) * scale + weights[-1]
        error = (1 / (1 + np.exp(-z)) - y) / len(y)
        slope = np.bincount(col, (error * scale)[row], len(weights)) + decay * weights
        slope[-1] = error.sum()
        moment = 0.9 * moment + slope
        weights -= 2.0 * moment
    return weights


def rule_for(host: str, path: str, rules: dict[str, list[Rule]]) -> Rule | None:
    """The longest rule that fits; of equally long ones the first in alphabetical order."""
    best = None
    while host:
        for rule in rules.get(host, ()):
            if path.startswith(rule.path) and (best is None or (-len(rule.text), rule.text) < (-len(best.text), best.text)):
                best = rule
        host = host.partition(".")[2]
    return best


def judge_urls(
    pages: DataFrame,
    weights: np.ndarray,
    rules: Sequence[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    threshold: float = 0.5,
) -> DataFrame:
    """One row per input row: id, host, path, ``rule``, ``score`` and ``verdict``.

    ``rule`` is the text of the rule that decided, null where the model did; ``score``
    is the model's probability that the URL is to be blocked and is given for every
    row. A missing URL or one without ``://`` has an empty host and path and is judged
    by the model. Rows are independent; repeated rows give repeated results. ``rules``
    is an operator's list that is sent to every task (write it as files of a few
    thousand lines, not as a table that grows with the corpus).
    """
    bound_batches(pages.sparkSession)
    url = text_or_empty(url_col)
    source = pages.select(F.col(f"`{id_col}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    by_host: dict[str, list[Rule]] = {}
    for rule in rules:
        by_host.setdefault(rule.host, []).append(rule)
    kind = source.schema["id"].dataType.simpleString()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [grams(h, p) for h, p in zip(batch["host"], batch["path"])]
            scores = [1 / (1 + np.exp(-(weights[s].sum() / np.sqrt(max(1, len(s))) + weights[-1]))) for s in sets]
            found = [rule_for(h, p, by_host) for h, p in zip(batch["host"], batch["path"])]
            verdicts = [r.verdict if r else "block" if s >= threshold else "allow" for r, s in zip(found, scores)]
            yield batch.assign(rule=[r.text if r else None for r in found], score=scores, verdict=verdicts)

    found = source.mapInPandas(judge, f"id {kind}, host string, path string, rule string, score double, verdict string")
    return found.withColumnRenamed("id", id_col)
