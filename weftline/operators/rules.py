"""Rule lookup by prefix, nearest entry, rewrite chain and the tiers over them."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.joins import first_per_key, lookup
from weftline.operators.rewrites import to_sql
from weftline.operators.vectors import nearest
from weftline.session import cut_lineage

# Confidence per method.
RULE_CONFIDENCE = 0.97
REWRITE_CONFIDENCE = 0.88
UNTRANSLATED_CONFIDENCE = 0.4
BLANK_CONFIDENCE = 1.0
NEAREST_ABOVE = 0.80
LOW_BELOW = 0.70


def _strip(text: str) -> Column:
    return F.btrim(F.col(text), F.lit(" \t\r\n"))


#: Rules up to this size are sent to every task.
SENT_BYTES = 32 << 20


def rule_lookup(df: DataFrame, rules: DataFrame, text: str, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Add ``rule_id`` and ``replacement`` of the first approved rule (lowest ``rule_id``)
    whose ``pattern`` is a prefix of the stripped text; null when there is none.

    Rules of a checked size (``sent_bytes`` of text) are sent to all tasks, by pattern, and a
    text's prefixes of the lengths that patterns have are looked up there: nothing is
    shuffled. With more rules the distinct texts are exploded into such prefixes and joined
    once. No text is compared with all rules, and both ways give the same rows.
    """
    approved = rules.where("approved").where(F.length("pattern") > 0)
    # Written once: the rules are read again below.
    patterns = cut_lineage(first_per_key(
        approved.select("rule_id", "pattern", "replacement"), ["pattern"], [F.col("rule_id")]
    ))
    size = patterns.agg(F.sum(F.octet_length("pattern") + F.coalesce(F.octet_length("replacement"), F.lit(0)) + 16)).first()[0] or 0
    if size <= sent_bytes:
        return _rule_lookup_sent(df, patterns, text)
    # Distinct lengths are few whatever the number of rules; the longest pattern bounds them.
    lengths = [r[0] for r in patterns.select(F.length("pattern")).distinct().collect()]
    return _rule_lookup_exploded(df, patterns, text, lengths)


def _rule_lookup_sent(df: DataFrame, patterns: DataFrame, text: str) -> DataFrame:
    kind = patterns.schema["rule_id"].dataType
    known = {r.pattern: (r.rule_id, r.replacement) for r in patterns.collect()}
    sent = df.sparkSession.sparkContext.broadcast((known, sorted({len(p) for p in known})))

    @F.pandas_udf(f"rule_id {kind.simpleString()}, replacement string")
    def first(texts: pd.Series) -> pd.DataFrame:
        known, lengths = sent.value

        def of(given: str | None) -> tuple:
            stripped = (given or "").strip(" \t\r\n")
            fitting = (known.get(stripped[:n]) for n in lengths if n <= len(stripped))
            return min((f for f in fitting if f), key=lambda f: f[0], default=(None, None))

        answers = {t: of(t) for t in texts.unique()}
        found = [answers[t] for t in texts]
        return pd.DataFrame({"rule_id": pd.Series([f[0] for f in found], dtype=object), "replacement": pd.Series([f[1] for f in found], dtype=object)})

    return df.withColumn("_first", first(F.col(text))).select(*df.columns, "_first.rule_id", "_first.replacement")


def _rule_lookup_exploded(
    df: DataFrame, patterns: DataFrame, text: str, lengths: Sequence[int]
) -> DataFrame:
    stripped = _strip(text)
    fitting = F.filter(
        F.array(*[F.lit(n) for n in sorted(lengths)]), lambda n: n <= F.length(stripped)
    )
    prefixes = F.transform(fitting, lambda n: F.substr(stripped, F.lit(1), n))
    texts = df.select(text).where(F.col(text).isNotNull()).distinct()
    best = (
        texts.select(text, F.explode(prefixes).alias("pattern"))
        .join(patterns, "pattern")
        .groupBy(text)
        .agg(F.min(F.struct("rule_id", "replacement")).alias("_rule"))
    )
    found = lookup(df, best, {text: text}, ["_rule"], unique=True)
    return _first_rule(found, [F.col("_rule")], df.columns)


def _first_rule(found: DataFrame, candidates: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    rule = F.array_min(F.array_compact(F.array(*candidates))) if candidates \
        else F.lit(None).cast("struct<rule_id:long,replacement:string>")
    found = found.withColumn("_first", rule)
    return found.select(*columns, "_first.rule_id", "_first.replacement")


def rewrite_chain(
    df: DataFrame, text: str, rules: Sequence[tuple[str, str]] | None = None,
    output: str = "rewritten", changed: str = "changed",
) -> DataFrame:
    """Rewrite source-language calls to SQL, nested ones too, and flag what changed.

    Calls nest, which patterns cannot follow, so each batch rewrites its different texts
    with :func:`weftline.operators.rewrites.to_sql`. With ``rules``, (pattern, replacement) pairs are applied in order
    instead, ignoring case; ``$1`` names a group. A null text stays null.
    """
    if rules is None:
        @F.pandas_udf("string")
        def rewritten(texts: pd.Series) -> pd.Series:
            different = {t: to_sql(t) for t in texts.dropna().unique()}
            return pd.Series([different.get(t) for t in texts], dtype=object)

        result = rewritten(F.col(text))
    else:
        result = F.col(text)
        for pattern, replacement in rules:
            result = F.regexp_replace(result, f"(?i){pattern}", replacement)
    df = df.withColumn(output, result)
    return df.withColumn(changed, F.coalesce(F.col(output) != F.col(text), F.lit(False)))


def tiered_match(
    df: DataFrame, text: str, rules: DataFrame,
    vectors: tuple[str, str] | None = None, entries: DataFrame | None = None,
    rewrites: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """Add ``translated``, ``confidence`` and ``method`` from the first tier that answers:
    rule, nearest entry, rewrite, or the text itself.

    ``vectors`` names the row id and vector columns of ``df``; ``entries`` has ``entry_id``,
    ``logic`` and ``embedding``. Without them the nearest tier is left out.
    """
    kept = df.columns
    # Read twice below: by the search and by the join with what it finds.
    out = cut_lineage(rule_lookup(df, rules, text))
    if vectors is not None and entries is not None:
        row_id, vector = vectors
        # Only rows the first tier left open are searched for.
        is_open = F.col("rule_id").isNull() & (_strip(text) != "") & F.col(vector).isNotNull()
        near = nearest(
            out.where(is_open).select(row_id, vector), entries, (row_id, vector),
            ("entry_id", "embedding"), min_similarity=NEAREST_ABOVE,
        )
        near = lookup(near, entries, {"entry_id": "entry_id"}, ["logic"], unique=True)
        out = lookup(out, near, {row_id: row_id}, ["logic", "similarity"], unique=True)
    else:
        out = out.withColumns({
            "logic": F.lit(None).cast("string"), "similarity": F.lit(None).cast("double")})
    out = rewrite_chain(out, text, rewrites)

    def answer(translated: str, score, method: str) -> Column:
        score = score if isinstance(score, Column) else F.lit(score)
        return F.struct(
            F.col(translated).alias("translated"), score.alias("confidence"),
            F.lit(method).alias("method"),
        )

    blank = F.coalesce(_strip(text) == "", F.lit(True))
    chosen = (
        F.when(blank, answer(text, BLANK_CONFIDENCE, "passthrough"))
        .when(F.col("rule_id").isNotNull(),
              answer("replacement", RULE_CONFIDENCE, "deterministic"))
        .when(F.col("similarity").isNotNull(), answer("logic", F.col("similarity"), "semantic"))
        .when(F.col("changed"), answer("rewritten", REWRITE_CONFIDENCE, "regex"))
        .otherwise(answer(text, UNTRANSLATED_CONFIDENCE, "passthrough"))
    )
    return out.withColumn("_answer", chosen).select(*kept, "_answer.*")


def low_confidence(df: DataFrame, column: str = "confidence", below: float = LOW_BELOW) -> DataFrame:
    return df.where(F.col(column) < below)
