"""Pattern scan over text columns, its advice classes and roll-up."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: how much of a matching text is shown with a hit.
SHOWN_CHARACTERS = 200

# Patterns that mark embedded distributed-engine code.
ENGINE_PATTERNS = (
    r"\bSpark\b",
    r"\bPySpark\b",
    r"\bSparkSQL\b",
    r"\bSpark\s*Session\b",
    r"\bSparkContext\b",
    r"\bDataFrame\b",
    r"\bRDD\b",
    r"\bSparkConf\b",
    r"import\s+org\.apache\.spark",
    r"from\s+pyspark",
    r"import\s+pyspark",
    r"spark\.sql\(",
    r"spark\.read\(",
    r"spark\.write",
    r"Java\s+Transformation",
    r"JAVASESSION",
    r"Spark\s+Engine",
    r"ELT\s+Mapping",
    r"\beltMode\b",
    r"org\.apache\.spark",
)


_STEP = re.compile(r"(?P<escape>\\.)|(?P<set>\[\^?\]?(?:\\.|[^\]])*\])|(?P<repeat>[*+?]|\{[^}]*\})|(?P<group>[()|])|(?P<any>[.^$])|(?P<plain>.)", re.DOTALL)


def needed_text(pattern: str) -> str | None:
    """The longest stretch of characters, in lower case, that stands in every match of a pattern; None if
    that can't be told simply (groups and alternatives are not looked into)."""
    runs, run = [], ""
    for m in _STEP.finditer(pattern):
        if m["group"]:
            return None
        if m["repeat"]:
            # What is repeated need not be there, or not once only.
            runs, run = [*runs, run[:-1] if m["repeat"] != "+" else run], ""
        elif m["plain"] or (m["escape"] and not m["escape"][1].isalnum()):
            run += m["plain"] or m["escape"][1]
        else:
            runs, run = [*runs, run], ""
    longest = max([*runs, run], key=len)
    return longest.lower() if longest and longest.isascii() else None


def pattern_scan(
    df: DataFrame, row_id: str, columns: Sequence[str], patterns: Sequence[str] = ENGINE_PATTERNS
) -> DataFrame:
    """One row per (row, column, pattern) that matches anywhere in the whole text,
    ignoring case, in a single pass over the table.

    Each text is put in lower case once. A pattern is tried only on texts that hold the
    plain characters all its matches have (a search for bytes, many times faster than a pattern).
    """
    lower = {c: f"_lower{i}" for i, c in enumerate(columns)}
    df = df.select(row_id, *[c for c in columns if c != row_id], *[F.lower(F.col(c)).alias(n) for c, n in lower.items()])

    def matches(name: str, pattern: str) -> Column:
        needed, found = needed_text(pattern), F.col(name).rlike(f"(?i){pattern}")
        return found if needed is None else F.col(lower[name]).contains(needed) & found

    hits = F.array_compact(F.array(*[
        F.when(
            matches(c, p),
            F.struct(
                F.lit(c).alias("column_name"), F.lit(p).alias("pattern"),
                F.left(F.col(c), F.lit(SHOWN_CHARACTERS)).alias("matched_text"),
            ),
        )
        for c in columns for p in patterns
    ]))
    return df.select(row_id, F.inline(hits))


def classify_hit(pattern: Column) -> Column:
    """Advice class of a matched pattern; the first that fits wins."""
    return (
        F.when(pattern.contains("Java"), "rewrite as custom code")
        .when(F.lower(pattern).contains("spark"), "run as a distributed job")
        .when(pattern.contains("RDD") | pattern.contains("DataFrame"), "refactor to SQL")
        .otherwise("review by hand")
    )


def scan_summary(df: DataFrame, hits: DataFrame, row_id: str) -> DataFrame:
    """Every scanned row with its number of hits and whether there are any."""
    counted = hits.groupBy(row_id).agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return df.select(row_id).join(counted, row_id, "left").select(
        row_id, (n > 0).alias("has_hits"), n.alias("hit_count")
    )
