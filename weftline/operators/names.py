"""Linking names by containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contained_in(inner: DataFrame, outer: DataFrame, inner_name: str, outer_name: str) -> DataFrame:
    """Pairs (inner name, outer name) where the inner name occurs in the outer, ignoring
    case; blank names match nothing.

    Every stretch of an outer name that is as long as some inner name becomes a join
    key, so this is an equi-join whose matches are all real: no name is compared with
    all others. The keys per outer name are bounded by its length times the number of
    distinct inner lengths, which suits names, not long texts.
    """
    small = inner.select(F.col(inner_name).alias("inner_name")).distinct() \
        .withColumn("_key", F.upper("inner_name")).where(F.length("_key") > 0)
    large = outer.select(F.col(outer_name).alias("outer_name")).distinct() \
        .withColumn("_text", F.upper("outer_name"))
    lengths = sorted(r[0] for r in small.select(F.length("_key")).distinct().collect())
    if not lengths:
        lengths = [1]

    starts = lambda n: F.sequence(F.lit(1), F.length("_text") - n + 1)
    fitting = F.filter(
        F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("_text")
    )
    stretches = F.array_distinct(F.flatten(F.transform(
        fitting, lambda n: F.transform(starts(n), lambda at: F.substr(F.col("_text"), at, n))
    )))
    keyed = large.select("outer_name", F.explode(stretches).alias("_key"))
    return keyed.join(small, "_key").select("inner_name", "outer_name")


def substring_link(a: DataFrame, b: DataFrame, a_name: str, b_name: str) -> DataFrame:
    """Pairs of names (``a_name``, ``b_name``) where either contains the other, ignoring case."""
    within = contained_in(a, b, a_name, b_name).toDF(a_name, b_name)
    around = contained_in(b, a, b_name, a_name).toDF(b_name, a_name)
    return within.unionByName(around).distinct()
