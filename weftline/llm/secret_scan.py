"""Secret scans over an incremental ledger of blobs, in DataFrame functions only.

Every version of a text is addressed by its content. The ledger says which pairs of blob
and rule version were scanned and what was found; a scan looks only at the pairs it does
not hold, each blob once however many paths and versions have it, and the findings are
joined back to all of them.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import cut_lineage, scratch_path

LEDGER = "blob binary, kind string, version int, spans array<struct<start:long,stop:long>>"


class Rule(NamedTuple):
    """A kind of secret: a match counts if its group ``counted`` has ``least`` characters.

    A changed pattern takes a new version; blobs scanned by the older one are scanned again.
    """

    kind: str
    version: int
    pattern: str
    counted: int = 0
    least: int = 1


# The kinds in the order in which spans of equal start are listed.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    # Runs that are too short have no shorter match inside, so the length may stand in the pattern.
    Rule("access", 1, "AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, "[0-9a-f]{32,}"),
)


def spans_of(text: Column, rule: Rule) -> Column:
    """Where the rule's leftmost matches that do not overlap lie: code points from 0, end exclusive.

    A match's start is the length of what stands before it: the pieces between matches, and
    the matches before.
    """
    pattern = F.lit(rule.pattern)
    none = F.array().cast("array<struct<start:long,stop:long>>")
    lengths = lambda parts: F.transform(parts, lambda x: F.length(x).cast("long"))
    found = F.arrays_zip(
        lengths(F.split(text, rule.pattern, -1)).alias("gap"), lengths(F.regexp_extract_all(text, pattern, F.lit(0))).alias("long"),
        lengths(F.regexp_extract_all(text, pattern, F.lit(rule.counted))).alias("counted"))
    # The text after the last match has no match behind it.
    found = F.filter(found, lambda x: x["long"].isNotNull())
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))
    placed = F.aggregate(found, start, lambda state, x: F.struct(
        (state["at"] + x["gap"] + x["long"]).alias("at"),
        F.when(x["counted"] >= rule.least, F.concat(state["spans"], F.array(F.struct(
            (state["at"] + x["gap"]).alias("start"), (state["at"] + x["gap"] + x["long"]).alias("stop"))))).otherwise(state["spans"]).alias("spans")),
        lambda state: state["spans"])
    return F.when(F.regexp_like(text, pattern), placed).otherwise(none)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The pairs scanned so far; none where there is no ledger yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def _blob(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, *, text: str = "text") -> DataFrame:
    """Scan what the ledger doesn't hold yet and add it there; returns the new pairs (see LEDGER).

    One row for each pair of a different text and a rule version, also if nothing was found.
    Null texts hold nothing and have no blob; an empty text is a blob. A ledger that was
    written twice for a pair, by runs at the same time, gives its spans once.
    """
    spark = versions.sparkSession
    texts = versions.select(F.col(f"`{text}`").alias("text")).where("text is not null").select(_blob(F.col("text")).alias("blob"), "text")
    known = read_ledger(spark, ledger).groupBy("blob").agg(
        F.collect_set(F.struct("kind", "version")).alias("known"))
    # One text for each blob, cut down in each task of the scan first.
    blobs = texts.dropDuplicates(["blob"]).join(known, "blob", "left")
    rows = []
    for rule in rules:
        pair = F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"))
        seen = F.coalesce(F.array_contains("known", pair), F.lit(False))
        rows.append(F.when(~seen, F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"),
                                           spans_of(F.col("text"), rule).alias("spans"))))
    new = blobs.select("blob", F.inline(F.array_compact(F.array(*rows)))).select("blob", "kind", "version", "spans")
    new = cut_lineage(new)
    new.write.mode("append").parquet(ledger)
    return new


def findings(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, *, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of every version with ``found``: all spans (start, kind, stop) of its text, by start, then by rule.

    Reads the pairs of these rule versions from the ledger. A null text, and one that was not scanned, has none.
    """
    spark = versions.sparkSession
    place = reduce(lambda c, r: c.when((F.col("kind") == r[1].kind) & (F.col("version") == r[1].version), F.lit(r[0])),
                   enumerate(rules), F.when(F.lit(False), F.lit(0)))
    hits = read_ledger(spark, ledger).where(F.size("spans") > 0).withColumn("_rule", place).where("_rule is not null")
    spans = hits.groupBy("blob", "_rule", "kind").agg(F.first("spans").alias("spans"))
    listed = spans.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list(F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), F.col("_rule").alias("rule"), s["stop"].alias("stop"), F.col("kind").alias("kind")))))).alias("_found"))
    # Written, so that both sides of the join are dealt anew and a blob that many paths have can be split.
    listed = cut_lineage(listed)
    paths = versions.select(*[F.col(f"`{c}`") for c in keep], _blob(F.col(f"`{text}`")).alias("_blob"))
    joined = paths.join(listed, paths["_blob"] == listed["blob"], "left")
    none = F.array().cast(listed.schema["_found"].dataType)
    return joined.select(*[paths[c] for c in keep], F.coalesce("_found", none).alias("found"))


def scan_all(versions: DataFrame, rules: tuple[Rule, ...] = RULES, *, keep: list[str], text: str = "text", ledger: str | None = None) -> DataFrame:
    """Scan all versions into the ledger (a new one in the shared folder if none is named) and return every version's findings."""
    ledger = ledger or scratch_path(versions.sparkSession, "ledger")
    scan(versions, ledger, rules, text=text)
    return findings(versions, ledger, rules, keep=keep, text=text)
