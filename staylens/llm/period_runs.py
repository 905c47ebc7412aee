"""Periodic runs of words, found by a sparse dynamic program over diagonals.

A diagonal is a lag: how far back the earlier occurrence of a word lies. Going through the
words in order, each earlier occurrence within reach adds one to the match length of its
lag; a lag that the next word does not extend ends, and gives its run at once if it was
long enough.

A run of period q needs at least q matches on its diagonal, and six at least. So lags in
[K, 2K) are followed on grams of K words instead of words (K = 6, 12, 24, ...; the first
level has all lags below 12): text that does not repeat itself has no equal grams and
costs no step. Inside a run of period p that is known from a lower level, no run of another
period q > p can reach p + q words back (two periods that overlap by their sum have a
common divisor as period); such occurrences are skipped, so that a word repeated all over
a text costs a few steps a word and not its square.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.llm.common import bound_batches, text_or_empty

LEAST_WORDS = 12
GRAM = 6

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    return (x ^ (x >> np.uint64(29))) * _ODD


def _first_grams(codes: np.ndarray) -> np.ndarray:
    """A hash of each ``GRAM`` consecutive word codes."""
    n = len(codes) - GRAM + 1
    out = np.zeros(n, np.uint64)
    for j in range(GRAM):
        out = _mix(out ^ codes[j : j + n].astype(np.uint64))
    return out


def _agreeing(codes: np.ndarray, end: int, lag: int) -> int:
    """How many words up to ``end`` equal the word ``lag`` before them, without a gap."""
    total, step = 0, 64
    while True:
        low = max(end - total - step + 1, lag)
        if low > end - total:
            return total
        same = codes[low : end - total + 1] == codes[low - lag : end - total + 1 - lag]
        if not same.all():
            return total + len(same) - 1 - int(np.flatnonzero(~same)[-1])
        total += len(same)
        step *= 2


def _is_smallest(codes: np.ndarray, start: int, length: int, period: int) -> bool:
    """Whether no divisor of ``period`` is a period too; with two whole periods only divisors can be."""
    stretch = codes[start : start + length]
    rest, factor = period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            shorter = period // factor
            if (stretch[shorter:] == stretch[:-shorter]).all():
                return False
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return True


def _level(codes: np.ndarray, grams: np.ndarray, size: int, low: int, high: int, known: list[tuple[int, int, int]]) -> tuple[list, bool]:
    """Runs whose period is in [low, high), and whether any gram of this level repeats at all.

    ``grams`` holds a hash of the ``size`` words from each position on, ``known`` the runs of
    smaller periods.
    """
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    again = ranked[1:] == ranked[:-1]
    if not again.any():
        return [], False
    near = again & (order[1:] - order[:-1] < high)
    places = np.sort(order[1:][near]).tolist()
    if not places:
        return [], True
    n = len(codes)
    reach = np.full(n, n, np.int64)  # earlier grams from here on are inside a known run
    for start, length, period in known:
        np.minimum(reach[start : start + length], start + period, out=reach[start : start + length])
    lists, rank = order.tolist(), np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    groups = np.concatenate([[0], np.cumsum(~again)])
    first = np.searchsorted(groups, groups)  # where the group of each rank begins
    at_rank, begins, limit = rank.tolist(), first.tolist(), reach.tolist()
    word = codes.tolist()
    found: list[tuple[int, int, int]] = []
    active: dict[int, int] = {}
    last = -2

    def close(lag: int, end: int) -> None:
        # a lag that was only skipped further on has not ended
        if end + 1 < n and word[end + 1] == word[end + 1 - lag]:
            return
        matches = _agreeing(codes, end, lag)
        if matches >= max(LEAST_WORDS - lag, lag):
            start = end - matches - lag + 1
            if _is_smallest(codes, start, matches + lag, lag):
                found.append((start, matches + lag, lag))

    for i in places:
        end = i + size - 1
        if last != i - 1:
            for lag in active:
                close(lag, last + size - 1)
            active = {}
        r = at_rank[i]
        begin = begins[r]
        # the earlier gram ends at end - lag, which must lie before the reach of known runs
        top = min(i - low, limit[end] - size)
        k = r - 1 if lists[r - 1] <= top else bisect_right(lists, top, begin, r) - 1
        now: dict[int, int] = {}
        while k >= begin:
            lag = i - lists[k]
            if lag >= high:
                break
            now[lag] = active.get(lag, 0) + 1
            k -= 1
        for lag in active:
            if lag not in now:
                close(lag, end - 1)
        active, last = now, i
    for lag in active:
        close(lag, last + size - 1)
    return found, True


def runs_of(words: Sequence) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence, by start, then period.

    A run is a stretch with smallest period q, of at least twice q and twelve words, that
    no neighbouring word extends keeping the period.
    """
    n = len(words)
    if n < LEAST_WORDS:
        return []
    table: dict = {}
    codes = np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, n)
    if len(table) == n:
        return []
    grams, size, low = _first_grams(codes), GRAM, 1
    found: list[tuple[int, int, int]] = []
    while True:
        runs, repeats = _level(codes, grams, size, low, 2 * size, found)
        found += runs
        low = 2 * size
        if not repeats or 2 * low > n:
            return sorted(found, key=lambda r: (r[0], r[2]))
        grams = _mix(_mix(grams[: n - low + 1]) ^ grams[size : size + n - low + 1])
        size = low


def repeated_words(n: int, runs: Sequence[tuple[int, int, int]]) -> np.ndarray:
    """Whether a word lies in a run after that run's first period."""
    gone = np.zeros(n, bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return gone


_RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])


def find_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prepare: Callable[[object, list[bytes]], list[bytes]] | None = None,
    texts: bool = True,
    digests: bool = False,
) -> DataFrame:
    """One row per input row: id, ``n_words``, ``runs`` and ``collapsed``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. ``runs`` lists every run as a struct of
    start (word number from 0), length and period, by start, then period; ``collapsed`` is the
    text of the words that no run repeats, joined by one space. Missing and empty texts have
    no words, no runs and an empty collapsed text. Rows are independent: repeated ids and rows
    give a row each, a missing id stays missing, other columns are not read. ``prepare`` may
    replace the words of a row, given its id and words. With ``digests=True`` two columns with
    the SHA-256 of the listed runs and of the collapsed text are added, with ``texts=False``
    ``collapsed`` is left out. No shuffle; a text is held by one task.
    """
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text"))
    fields = [source.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN))]
    fields += [T.StructField("collapsed", T.StringType())] if texts else []
    fields += [T.StructField(name, T.StringType()) for name in ("runs_sha256", "collapsed_sha256")] if digests else []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sizes, flat, left, run_sums, text_sums = [], [], [], [], [], []
            for key, text in zip(batch.column(0), batch.column(1)):
                words = text.as_py().encode("utf-8", "replace").split()
                if prepare is not None:
                    words = prepare(key.as_py(), words)
                runs = runs_of(words)
                collapsed = b" ".join(words if not runs else [words[i] for i in np.flatnonzero(~repeated_words(len(words), runs))])
                counts.append(len(words))
                sizes.append(len(runs))
                flat += runs
                if texts:
                    left.append(collapsed.decode("utf-8"))
                if digests:
                    run_sums.append(hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest())
                    text_sums.append(hashlib.sha256(collapsed).hexdigest())
            parts = np.array(flat, np.int64).reshape(-1, 3)
            struct = pa.StructArray.from_arrays([pa.array(parts[:, i]) for i in range(3)], names=["start", "length", "period"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, struct)]
            columns += [pa.array(left, pa.string())] if texts else []
            columns += [pa.array(run_sums, pa.string()), pa.array(text_sums, pa.string())] if digests else []
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return source.mapInArrow(work, T.StructType(fields)).withColumnRenamed("id", id_col)


def longest_run(runs) -> dict:
    """Columns start, length, period and exponent_milli of the longest run; of equals the first, then the shortest period."""
    best = F.get(F.array_sort(F.transform(runs, lambda r: F.struct((-r["length"]).alias("size"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    length = -best["size"]
    return {
        "n_runs": F.size(runs).cast("long"),
        "start": best["start"],
        "length": length,
        "period": best["period"],
        "exponent_milli": F.floor(F.lit(1000) * length / best["period"]).cast("long"),
    }
