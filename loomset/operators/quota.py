"""Diverse selection under two quotas."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def select_diverse(df: DataFrame, order: Sequence[Column], group: str, domain: str, total: int, per_group: int, domain_share: float) -> DataFrame:
    """At most `total` rows in order: at most `per_group` of a group, and in the first pass at most share x total (one at least) of a domain; the
    second pass fills up without the domain's limit. Adds `pass` and `position`.

    Where each group has one domain this is two ranked windows and a limit: a group's rows beyond its quota are cut before the shuffle, and no
    domain has more rows than groups x quota. Otherwise the greedy choice depends on both counts at once; then only rows that can be chosen at all,
    per_group of each (group, domain), come to the driver one by one, and it stops at `total`.
    """
    cap = max(1, int(total * domain_share))
    mixed = df.groupBy(group).agg(F.min(domain).alias("a"), F.max(domain).alias("b")).where("not a <=> b").limit(1).count()
    if mixed:
        return _greedy(df, order, group, domain, total, per_group, cap)
    ranked = df.withColumn("_group_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_group_rank") <= per_group)
    ranked = ranked.withColumn("_domain_rank", F.row_number().over(Window.partitionBy(domain).orderBy(*order)))
    ranked = ranked.withColumn("pass", F.when(F.col("_domain_rank") <= cap, 1).otherwise(2))
    chosen = ranked.orderBy("pass", *order).limit(total).drop("_group_rank", "_domain_rank")
    return chosen.withColumn("position", F.row_number().over(Window.orderBy("pass", *order)))


def _greedy(df: DataFrame, order: Sequence[Column], group: str, domain: str, total: int, per_group: int, cap: int) -> DataFrame:
    window = Window.partitionBy(group, domain).orderBy(*order)
    held = df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= per_group).drop("_rank").orderBy(*order)
    first, later = [], []
    groups, domains = Counter(), Counter()
    for row in held.toLocalIterator():
        if len(first) >= total:
            break
        if groups[row[group]] < per_group:
            if domains[row[domain]] < cap:
                first.append(row)
                groups[row[group]] += 1
                domains[row[domain]] += 1
            else:
                later.append(row)
    second = []
    for row in later:
        if len(first) + len(second) >= total:
            break
        if groups[row[group]] < per_group:
            second.append(row)
            groups[row[group]] += 1
    rows = [(*r, p, i + 1) for i, (r, p) in enumerate([(r, 1) for r in first] + [(r, 2) for r in second])]
    schema = T.StructType([*df.schema.fields, T.StructField("pass", T.IntegerType()), T.StructField("position", T.IntegerType())])
    return df.sparkSession.createDataFrame(rows, schema)
