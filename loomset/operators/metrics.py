"""Ranking metrics and weighted scores, as columns over arrays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset import patterns as P


def ranked(c: Column) -> Column:
    """Predictions without blanks; their order is their rank."""
    return F.filter(c, lambda x: x.isNotNull() & (x != ""))


def _or_none(value: Column, gold: Column, optional: bool, empty) -> Column:
    """The value; on empty gold null where the metric is optional, else what is given."""
    return F.when(F.size(gold) > 0, value).otherwise(F.lit(None) if optional else F.lit(empty))


def hit_at(pred: Column, gold: Column, k: int, optional: bool = False) -> Column:
    return _or_none(F.arrays_overlap(F.slice(ranked(pred), 1, k), gold).cast("int"), gold, optional, 0)


def recall_at(pred: Column, gold: Column, k: int, optional: bool = False) -> Column:
    found = F.size(F.array_intersect(F.slice(ranked(pred), 1, k), gold)) / F.nullif(F.size(F.array_distinct(gold)), F.lit(0))
    return _or_none(found, gold, optional, 0.0)


def reciprocal_rank(pred: Column, gold: Column, optional: bool = False) -> Column:
    held = F.transform(ranked(pred), lambda x, i: F.when(F.array_contains(gold, x), i + 1))
    return _or_none(F.coalesce(1.0 / F.array_min(F.filter(held, lambda x: x.isNotNull())), F.lit(0.0)), gold, optional, 0.0)


def report(df: DataFrame, pairs: Mapping[str, tuple[str, str, bool]], ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Adds <name>_hit_at_k, <name>_recall_at_k and <name>_mrr; pairs: name -> (predictions, gold, optional)."""
    added = {}
    for name, (pred, gold, optional) in pairs.items():
        p, g = F.col(pred), F.coalesce(F.col(gold), F.array().cast("array<string>"))
        for k in ks:
            added |= {f"{name}_hit_at_{k}": hit_at(p, g, k, optional), f"{name}_recall_at_{k}": recall_at(p, g, k, optional)}
        added[f"{name}_mrr"] = reciprocal_rank(p, g, optional)
    return df.withColumns(added)


def weighted_mean(parts: Mapping[str, Column], weights: Mapping[str, float] = P.SCORE_WEIGHTS) -> Column:
    """The mean of the parts that are there, weights made to sum to one; 0 for none."""
    total = used = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.coalesce(parts[name] * w, F.lit(0.0))
        used = used + F.when(parts[name].isNotNull(), w).otherwise(0.0)
    return F.coalesce(total / F.nullif(used, F.lit(0.0)), F.lit(0.0))


def _sum(*terms: Column) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def intent_overall(goal: Column, constraints: Column, forbidden: Column, revision: Column, final: Column) -> Column:
    return _sum(goal * 0.25, constraints * 0.25, forbidden * 0.20, revision * 0.15, final * 0.15)


def process_overall(*five: Column) -> Column:
    return _sum(*five) / len(five)


def dialogue_overall(a: Column, b: Column, c: Column, d: Column) -> Column:
    return _sum(a * 0.30, b * 0.35, c * 0.20, d * 0.15)


def exploration_overall(a: Column, b: Column, c: Column, d: Column, e: Column, noise: Column) -> Column:
    return _sum(a * 0.20, b * 0.20, c * 0.20, d * 0.20, e * 0.10, (1.0 - noise) * 0.10)


def resolved(tests: Column, intent: Column) -> Column:
    """Tests passed, and the intent matched where that is known."""
    return tests & F.coalesce(intent, F.lit(True))
