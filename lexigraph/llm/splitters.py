"""Sampled splitters: balanced ranges of a sort order, by DataFrame functions alone.

A range is an interval of (key, tie). Splitters are quantiles of a weight-proportional sample; ranges that still hold
more than twice the mean weight get splitters of their own sample. Only the sample and one row a range reach the
driver, both bounded by parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sampled rows a range, and ranges at most.
OVERSAMPLE, MOST_RANGES, ROUNDS = 24, 1024, 3
_UNIT = 1 << 40

Splitter = tuple[int, int]


def range_of(key: Column, tie: Column, splitters: list[Splitter]) -> Column:
    """The number of splitters at or below (key, tie), by binary choice."""

    def pick(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        k, t = splitters[mid]
        return F.when((key < k) | ((key == k) & (tie < t)), pick(low, mid)).otherwise(pick(mid + 1, high))

    return pick(0, len(splitters))


def sampled(rows: DataFrame, weight: Column, each: float, turn: int) -> list[tuple[int, int, int]]:
    """(key, tie, weight) rows in order, each taken with a chance of weight / each (surely from 1 on)."""
    drawn = F.pmod(F.xxhash64("key", "tie", F.lit(turn)), F.lit(_UNIT)).cast("double") / _UNIT
    got = rows.select("key", "tie", weight.cast("double").alias("w")).where(drawn < F.col("w") / each).collect()
    return sorted((r[0], r[1], max(r[2], each)) for r in got)


def quantiles(sample: list[tuple[int, int, int]], parts: int) -> list[Splitter]:
    total, seen, out = sum(x[2] for x in sample), 0.0, []
    for key, tie, w in sample:
        seen += w
        if len(out) < parts - 1 and seen >= total * (len(out) + 1) / parts:
            out.append((key, tie))
            while len(out) < parts - 1 and seen >= total * (len(out) + 1) / parts:
                out.append((key, tie))
    return sorted(set(out))


def splitters_of(rows: DataFrame, weight: Column, ranges: int) -> list[Splitter]:
    """``rows`` has key and tie, both bigint."""
    ranges = min(ranges, MOST_RANGES)
    total = rows.agg(F.sum(weight.cast("double"))).first()[0]
    if not total:
        return []
    mean = total / ranges
    found = quantiles(sampled(rows, weight, mean / OVERSAMPLE, 0), ranges)
    for turn in range(1, ROUNDS):
        held = rows.groupBy(range_of(F.col("key"), F.col("tie"), found).alias("range")).agg(F.sum(weight.cast("double")).alias("w"), F.count("*").alias("n")).collect()
        overfull = [r["range"] for r in held if r["w"] > 2 * mean and r["n"] > 1]
        if not overfull or len(found) >= 2 * MOST_RANGES:
            break
        own = rows.where(range_of(F.col("key"), F.col("tie"), found).isin(overfull))
        share = sum(r["w"] for r in held if r["range"] in overfull) / mean
        found = sorted({*found, *quantiles(sampled(own, weight, mean / OVERSAMPLE, turn), int(2 * share) + 1)})
    return found
