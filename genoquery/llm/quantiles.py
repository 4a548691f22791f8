"""Percentiles from mergeable rank-interval summaries.

A summary is a sorted list of tuples (value, lt_lo, lt_hi, le_lo, le_hi): bounds
on how many values are below, and at most, the value. Fresh summaries are exact;
merging adds bounds; compression drops tuples while the ranks between two kept
neighbours stay within twice the permitted uncertainty. ``rank_error`` of a
summary is half its widest gap and is measured, not assumed, after each merge.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoquery.session import ship

PERMITTED = 0.0005  # of n, each way
BUFFER = 100_000  # values held per group before they are summarised
HELD = 4_000_000  # values that a task holds in all groups
TUPLES = 1_000_000  # tuples of summaries that a task holds before it passes them on
FAN_IN = 32
COLUMNS = ["n", "rank_error", "value", "lt_lo", "lt_hi", "le_lo", "le_hi"]
SCHEMA = "n long, rank_error double, value array<double>, lt_lo array<long>, lt_hi array<long>, le_lo array<long>, le_hi array<long>"


class Summary:
    """Rank-interval tuples as arrays."""

    def __init__(self, n: int, value, lt_lo, lt_hi, le_lo, le_hi):
        self.n, self.value = int(n), np.asarray(value, float)
        self.lt_lo, self.lt_hi, self.le_lo, self.le_hi = (np.asarray(x, np.int64) for x in (lt_lo, lt_hi, le_lo, le_hi))

    @classmethod
    def of(cls, values: np.ndarray) -> Summary:
        v, c = np.unique(values, return_counts=True)
        le = np.cumsum(c)
        return cls(len(values), v, le - c, le - c, le, le)

    def bounds(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bounds of the counts below and at most each of ``at``."""
        if not len(self.value):
            z = np.zeros(len(at), np.int64)
            return z, z, z, z
        i = np.searchsorted(self.value, at)
        hit = (i < len(self.value)) & (self.value[np.minimum(i, len(self.value) - 1)] == at)
        j = np.minimum(i, len(self.value) - 1)
        low = np.where(i > 0, self.le_lo[np.maximum(i - 1, 0)], 0)
        high = np.where(i < len(self.value), self.lt_hi[j], self.n)
        return tuple(np.where(hit, x[j], y) for x, y in ((self.lt_lo, low), (self.lt_hi, high), (self.le_lo, low), (self.le_hi, high)))

    def merge(self, other: Summary) -> Summary:
        at = np.union1d(self.value, other.value)
        a, b = self.bounds(at), other.bounds(at)
        return Summary(self.n + other.n, at, *(x + y for x, y in zip(a, b)))

    def compress(self, permitted: float = PERMITTED) -> Summary:
        room, k = 2 * permitted * self.n, len(self.value)
        if k <= 1 / permitted or k < 3:
            return self
        keep, i = [0], 0
        while i < k - 1:
            i = max(i + 1, min(k - 1, int(np.searchsorted(self.lt_hi, self.le_lo[i] + room, side="right")) - 1))
            keep.append(i)
        return Summary(self.n, *(x[keep] for x in (self.value, self.lt_lo, self.lt_hi, self.le_lo, self.le_hi)))

    def rank_error(self) -> float:
        if not self.n:
            return 0.0
        gaps = np.append(self.lt_hi, self.n) - np.append(0, self.le_lo)
        own = np.maximum(self.lt_hi - self.lt_lo, self.le_hi - self.le_lo)
        return float(max(gaps.max(), own.max(initial=0))) / 2

    def at_rank(self, r: int) -> tuple[float, int]:
        """A value of about rank ``r`` and how far its rank may be from it."""
        off = np.maximum(np.maximum(r - self.le_lo, self.lt_hi + 1 - r), 0)
        i = int(off.argmin())
        return float(self.value[i]), int(off[i])

    def row(self) -> tuple:
        return self.n, self.rank_error(), self.value, self.lt_lo, self.lt_hi, self.le_lo, self.le_hi


def _from_row(r) -> Summary:
    return Summary(r.n, r.value, r.lt_lo, r.lt_hi, r.le_lo, r.le_hi)


def summarise(df: DataFrame, keys: Sequence[str], measure: str, value: str, permitted: float = PERMITTED) -> DataFrame:
    """A summary per group and input partition of a long table (keys, measure, value), then merged. See ``combine``.

    Null and NaN values are left out; null keys are a group of their own. Values are summarised where they lie, so only
    summaries move, however many rows one group has. A task holds at most ``HELD`` values and ``TUPLES`` tuples (and a batch):
    beyond these the largest groups are summarised, and the summaries passed on to be merged.
    """
    cols = [*keys, measure]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[np.ndarray]] = {}
        size: dict[tuple, int] = {}
        done: dict[tuple, Summary] = {}

        def flush(k: tuple) -> None:
            s = Summary.of(np.concatenate(held.pop(k)))
            size.pop(k)
            done[k] = (done[k].merge(s) if k in done else s).compress(permitted)

        def out() -> pd.DataFrame:
            rows = [(*k, *s.row()) for k, s in done.items()]
            done.clear()
            return pd.DataFrame(rows, columns=[*cols, *COLUMNS])

        for batch in batches:
            batch = batch[batch[value].notna()]
            for k, part in batch.groupby(cols, dropna=False, sort=False)[value]:
                k = tuple(None if x is None or x != x else x for x in k)
                held.setdefault(k, []).append(part.to_numpy(float))
                size[k] = size.get(k, 0) + len(part)
                if size[k] >= BUFFER:
                    flush(k)
            if sum(size.values()) > HELD:
                for k in sorted(size, key=size.get, reverse=True):
                    flush(k)
                    if sum(size.values()) * 2 < HELD:
                        break
            if sum(len(s.value) for s in done.values()) > TUPLES:
                yield out()
        for k in list(held):
            flush(k)
            if len(done) % 1000 == 0 and sum(len(s.value) for s in done.values()) > TUPLES:
                yield out()
        yield out()

    ship(df.sparkSession)
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)
    parts = df.select(*cols, F.col(value).cast("double").alias(value)).mapInPandas(run, f"{fields}, {SCHEMA}")
    return combine(parts, cols, permitted)


def combine(summaries: DataFrame, keys: Sequence[str], permitted: float = PERMITTED) -> DataFrame:
    """One summary per group from any number of them (partitions, loads, days), in levels of ``FAN_IN``; the rank error is tracked.

    A null and an absent summary are the same. A single summary comes back as it is, compressed. The summaries of a group
    are merged in an order that their contents give, so the result does not depend on how tasks were cut or which came first;
    a task holds ``FAN_IN`` summaries of one group.
    """
    ship(summaries.sparkSession)
    fields = ", ".join(f"`{c}` {summaries.schema[c].dataType.simpleString()}" for c in keys)

    def tree(todo: list[Summary]) -> Summary:
        while len(todo) > 1:  # in pairs, so that each tuple is merged log2 times
            todo = [todo[i].merge(todo[i + 1]).compress(permitted) if i + 1 < len(todo) else todo[i] for i in range(0, len(todo), 2)]
        return todo[0].compress(permitted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, mine = None, []
        for pdf in batches:
            out = []
            for k, r in zip(pdf[list(keys)].itertuples(index=False, name=None), pdf.itertuples(index=False)):
                k = tuple(None if x is None or x != x else x for x in k)
                if mine and k != at:
                    out.append((*at, *tree(mine).row()))
                    mine = []
                at = k
                mine.append(_from_row(r))
                if len(mine) >= FAN_IN:
                    mine = [tree(mine)]
            yield pd.DataFrame(out, columns=[*keys, *COLUMNS])
        if mine:
            yield pd.DataFrame([(*at, *tree(mine).row())], columns=[*keys, *COLUMNS])

    mark = F.xxhash64("n", "value", "le_lo", "lt_hi")
    order = [*keys, "n", "__mark"]
    some = summaries.where(F.col("n").isNotNull()).withColumn("__mark", mark)
    first = some.withColumn("__part", F.pmod("__mark", F.lit(FAN_IN))).repartition(*keys, "__part").sortWithinPartitions(*keys, "__part", "n", "__mark")
    parts = first.drop("__mark", "__part").mapInPandas(run, f"{fields}, {SCHEMA}")
    return parts.withColumn("__mark", mark).repartition(*keys).sortWithinPartitions(*order).drop("__mark").mapInPandas(run, f"{fields}, {SCHEMA}")


def percentiles(summaries: DataFrame, keys: Sequence[str], pcts: Sequence[float]) -> DataFrame:
    """``keys, pct, value, n, rank_error`` for each percentile: the value at about rank ceil(pct * n / 100)."""
    ship(summaries.sparkSession)
    fields = ", ".join(f"`{c}` {summaries.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                s = _from_row(r)
                for p in pcts if s.n else []:
                    out.append((*[getattr(r, c) for c in keys], float(p), *s.at_rank(max(1, int(np.ceil(p * s.n / 100 - 1e-9)))), s.n))
            yield pd.DataFrame(out, columns=[*keys, "pct", "value", "rank_error", "n"])

    return summaries.mapInPandas(run, f"{fields}, pct double, value double, rank_error long, n long")


def counts_at(summaries: DataFrame, keys: Sequence[str], limits: dict[str, Sequence[float]], measure: str) -> DataFrame:
    """Bounds of the counts below and at most each limit of a measure: ``keys, limit, n, lt_lo, lt_hi, le_lo, le_hi``."""
    ship(summaries.sparkSession)
    fields = ", ".join(f"`{c}` {summaries.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                at = np.array(sorted(limits.get(getattr(r, measure), ())), float)
                b = _from_row(r).bounds(at)
                out += [(*[getattr(r, c) for c in keys], float(x), r.n, *(int(y[i]) for y in b)) for i, x in enumerate(at)]
            yield pd.DataFrame(out, columns=[*keys, "limit", "n", "lt_lo", "lt_hi", "le_lo", "le_hi"])

    return summaries.mapInPandas(run, f"{fields}, limit double, n long, lt_lo long, lt_hi long, le_lo long, le_hi long")
