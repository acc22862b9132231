from __future__ import annotations

from pyspark.sql import functions as F

from weftline import functions as E
from weftline.operators.feedback import promote_feedback, semantic_append
from weftline.operators.patterns import ENGINE_PATTERNS, classify_hit, pattern_scan, scan_summary
from weftline.operators.rules import low_confidence, rewrite_chain, tiered_match
from weftline.plans.catalog import query
from weftline.plans.joining import _RULES_SQL, part_rules

# ASCII only: the two regular expression engines agree on these.
_PATTERNS = (
    r"licen[sc]e", r"[a-z0-9._%+-]+@[a-z0-9.-]+[.][a-z]{2,}", r"[0-9]{4,}", r"src1[0-9]",
    r"the [a-z]+ of", r"from\s+pyspark", r"Java\s+Transformation",
)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_SCAN_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS column_name, {_quoted(p)} AS pattern, left({c}, 200) AS matched_text "
    f"FROM documents WHERE regexp_matches({c}, {_quoted('(?i)' + p)})"
    for c in ("text", "source") for p in _PATTERNS
)


def _hits(t):
    return pattern_scan(t.documents, "doc_id", ["text", "source"], _PATTERNS)


@query("pattern_scan", _SCAN_SQL)
def pattern_scan_query(t):
    return _hits(t)


_DEFAULT_SQL = " UNION ALL ".join(
    f"SELECT doc_id, 'text' AS column_name, {_quoted(p)} AS pattern, left(text, 200) AS matched_text "
    f"FROM marked WHERE regexp_matches(text, {_quoted('(?i)' + p)})" for p in ENGINE_PATTERNS)


@query("pattern_scan_engine", f"""
    WITH marked AS (SELECT doc_id, CASE doc_id % 50 WHEN 7 THEN 'from pyspark ' || text WHEN 11 THEN text || ' Spark  Session spark.sql(x)'
        WHEN 23 THEN 'JAVAsession import org.apache.spark.rdd ' || text ELSE text END AS text FROM documents) {_DEFAULT_SQL}""")
def pattern_scan_engine(t):
    """The default patterns over all documents, some of which are marked with code."""
    mark = F.when(F.col("doc_id") % 50 == 7, F.concat(F.lit("from pyspark "), "text")) \
        .when(F.col("doc_id") % 50 == 11, F.concat("text", F.lit(" Spark  Session spark.sql(x)"))) \
        .when(F.col("doc_id") % 50 == 23, F.concat(F.lit("JAVAsession import org.apache.spark.rdd "), "text")).otherwise(F.col("text"))
    return pattern_scan(t.documents.select("doc_id", mark.alias("text")), "doc_id", ["text"])


@query("pattern_advice", f"""
    SELECT pattern, CASE WHEN contains(pattern, 'Java') THEN 'rewrite as custom code'
        WHEN contains(lower(pattern), 'spark') THEN 'run as a distributed job'
        WHEN contains(pattern, 'RDD') OR contains(pattern, 'DataFrame') THEN 'refactor to SQL'
        ELSE 'review by hand' END AS advice, count(*) AS n
    FROM (SELECT pattern FROM ({_SCAN_SQL}) UNION ALL SELECT 'DataFrame ' || p_type FROM part
          UNION ALL SELECT 'Java ' || p_brand FROM part UNION ALL SELECT 'spark.sql ' || p_brand FROM part)
    GROUP BY pattern""")
def pattern_advice(t):
    """Advice for the patterns hit, and for made-up ones of every class from the parts."""
    patterns = _hits(t).select("pattern")
    for prefix, column in (("DataFrame ", "p_type"), ("Java ", "p_brand"), ("spark.sql ", "p_brand")):
        patterns = patterns.union(t.part.select(F.concat(F.lit(prefix), column)))
    counted = patterns.groupBy("pattern").agg(F.count("*").alias("n"))
    return counted.withColumn("advice", classify_hit(F.col("pattern")))


@query("pattern_summary", f"""
    WITH h AS (SELECT doc_id, count(*) AS n FROM ({_SCAN_SQL}) GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0) > 0 AS has_hits, coalesce(n, 0) AS hit_count
    FROM documents LEFT JOIN h USING (doc_id)""")
def pattern_summary(t):
    return scan_summary(t.documents, _hits(t), "doc_id")


def _expressions(t):
    """Expression texts in the source language made from the parts."""
    name = F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")))
    call = lambda before, after: F.concat(F.lit(before), name, F.lit(after))
    return t.part.select("p_partkey", E.decode(
        "p_type", "ECONOMY", call("NVL(", ", 0)"), "LARGE", call("UPPER(SUBSTR(", ", 1, 3))"),
        "MEDIUM", call("IIF(ISNULL(", "), 0, 1)"), "PROMO", call("ADD_TO_DATE(", ", 'DD', 30)"),
        "SMALL", call("TRUNC(SYSDATE) || ", ""), name).alias("text"))


_EXPRESSIONS_SQL = """
    names AS (SELECT p_partkey, p_type, upper(replace(p_name, ' ', '_')) AS n FROM part),
    expressions AS (SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'NVL(' || n || ', 0)'
        WHEN 'LARGE' THEN 'UPPER(SUBSTR(' || n || ', 1, 3))' WHEN 'MEDIUM' THEN 'IIF(ISNULL(' || n || '), 0, 1)'
        WHEN 'PROMO' THEN 'ADD_TO_DATE(' || n || ', ''DD'', 30)' WHEN 'SMALL' THEN 'TRUNC(SYSDATE) || ' || n
        ELSE n END AS text,
        CASE p_type WHEN 'ECONOMY' THEN 'COALESCE(' || n || ', 0)'
        WHEN 'LARGE' THEN 'UPPER(SUBSTRING(' || n || ', 1, 3))'
        WHEN 'MEDIUM' THEN 'CASE WHEN ' || n || ' IS NULL THEN 0 ELSE 1 END'
        WHEN 'PROMO' THEN n || ' + INTERVAL ''30'' DAY' WHEN 'SMALL' THEN 'DATE_TRUNC(''day'', NOW()) || ' || n
        ELSE n END AS rewritten FROM names)"""


@query("rewrite_chain", f"""
    WITH {_EXPRESSIONS_SQL} SELECT p_partkey, text, rewritten, rewritten <> text AS changed FROM expressions""")
def rewrite_chain_query(t):
    return rewrite_chain(_expressions(t), "text")


_FORMS = {
    "ECONOMY": ("ISNULL(", " OR FLAG)", "(", " OR FLAG) IS NULL"),
    "LARGE": ("DECODE(", ", NULL, 'n', OTHER, 'o', 'y')", "CASE WHEN ", " IS NULL THEN 'n' WHEN {n} IS NOT DISTINCT FROM OTHER THEN 'o' ELSE 'y' END"),
    "MEDIUM": ("TRUNC(", " + TAX) -- it's (a sum", "TRUNC(", " + TAX) -- it's (a sum"),
    "PROMO": ("DATE_DIFF(ADD_TO_DATE(", ", 'DD', 30), SYSDATE, 'DD') * 2", "DATEDIFF(DAY, NOW(), ", " + INTERVAL '30' DAY) * 2"),
    "SMALL": ("TRUNC(NVL(", ", /* none */ 0)) = ISNULL(B)", "TRUNC(COALESCE(", ", /* none */ 0)) = (B IS NULL)"),
}


def _form_sql(at: int) -> str:
    quote = lambda s: "'" + s.replace("'", "''").replace("{n}", "' || n || '") + "'"
    cases = " ".join(f"WHEN '{kind}' THEN {quote(f[at])} || n || {quote(f[at + 1])}" for kind, f in _FORMS.items())
    return f"CASE p_type {cases} ELSE n END"


@query("rewrite_tree", f"""
    SELECT p_partkey, text, rewritten, rewritten <> text AS changed FROM (
        SELECT p_partkey, {_form_sql(0)} AS text, {_form_sql(2)} AS rewritten
        FROM (SELECT p_partkey, p_type, upper(replace(p_name, ' ', '_')) AS n FROM part))""")
def rewrite_tree(t):
    """Expressions whose calls become operators, with comments, nulls and sums."""
    name = F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")))
    forms = [x for kind, f in _FORMS.items() for x in (kind, F.concat(F.lit(f[0]), name, F.lit(f[1])))]
    return rewrite_chain(t.part.select("p_partkey", E.decode("p_type", *forms, name).alias("text")), "text")


_TIERED_SQL = f"""
    WITH {_RULES_SQL}, {_EXPRESSIONS_SQL},
    inputs AS (SELECT e.p_partkey, CASE WHEN p_size <= 3 THEN ' ' WHEN p_size <= 20 THEN p_name ELSE text END AS text,
                      rewritten, list_transform(embedding::DOUBLE[], lambda x: x + p_size / 1000.0::DOUBLE) AS v
               FROM expressions e JOIN part p USING (p_partkey) LEFT JOIN embeddings ON vec_id = e.p_partkey),
    hits AS (SELECT p_partkey, min(rule_id) AS rule_id FROM inputs
             JOIN rules ON approved AND starts_with(text, pattern) GROUP BY p_partkey),
    d AS (SELECT p_partkey, vec_id, label, 1 - list_distance(v, embedding::DOUBLE[]) AS similarity
          FROM inputs, embeddings WHERE v IS NOT NULL),
    near AS (SELECT p_partkey, label, similarity FROM (SELECT *, row_number() OVER (
                 PARTITION BY p_partkey ORDER BY similarity DESC, vec_id) AS n FROM d)
             WHERE n = 1 AND similarity > 0.80),
    answers AS (SELECT i.p_partkey, i.text,
        CASE WHEN trim(i.text) = '' THEN i.text WHEN h.rule_id IS NOT NULL THEN r.replacement
             WHEN near.similarity IS NOT NULL THEN 'logic ' || label
             WHEN i.text <> i.rewritten AND p_size > 20 THEN i.rewritten ELSE i.text END AS translated,
        CASE WHEN trim(i.text) = '' THEN 1.0 WHEN h.rule_id IS NOT NULL THEN 0.97
             WHEN near.similarity IS NOT NULL THEN round(near.similarity, 6)
             WHEN i.text <> i.rewritten AND p_size > 20 THEN 0.88 ELSE 0.4 END::DOUBLE AS confidence,
        CASE WHEN trim(i.text) = '' THEN 'passthrough' WHEN h.rule_id IS NOT NULL THEN 'deterministic'
             WHEN near.similarity IS NOT NULL THEN 'semantic'
             WHEN i.text <> i.rewritten AND p_size > 20 THEN 'regex' ELSE 'passthrough' END AS method
        FROM inputs i JOIN part p ON p.p_partkey = i.p_partkey LEFT JOIN hits h ON h.p_partkey = i.p_partkey
        LEFT JOIN rules r ON r.rule_id = h.rule_id LEFT JOIN near ON near.p_partkey = i.p_partkey)"""


def _tiered(t):
    """Texts from blank to expression, with vectors moved off a stored one by part size."""
    sized = t.part.select("p_partkey", "p_name", "p_size")
    moved = F.transform(
        F.col("embedding").cast("array<double>"), lambda x: x + F.col("p_size") / F.lit(1000.0))
    text = F.when(F.col("p_size") <= 3, " ").when(F.col("p_size") <= 20, F.col("p_name")) \
        .otherwise(F.col("text"))
    inputs = _expressions(t).join(sized, "p_partkey") \
        .join(t.embeddings, F.col("p_partkey") == F.col("vec_id"), "left") \
        .select("p_partkey", text.alias("text"), moved.alias("vector"))
    entries = t.embeddings.select(
        F.col("vec_id").alias("entry_id"), F.concat(F.lit("logic "), "label").alias("logic"), "embedding")
    answers = tiered_match(inputs, "text", part_rules(t), ("p_partkey", "vector"), entries)
    return answers.drop("vector").withColumn("confidence", F.round("confidence", 6))


@query("tiered_match", f"{_TIERED_SQL} SELECT * FROM answers")
def tiered_match_query(t):
    return _tiered(t)


@query("low_confidence", f"{_TIERED_SQL} SELECT * FROM answers WHERE confidence < 0.70")
def low_confidence_query(t):
    return low_confidence(_tiered(t))


def _reviewed(t):
    """Orders as translations, and again as corrected by a reviewer."""
    old = t.orders.select(
        "o_orderkey", F.concat(F.lit("EXPR "), "o_orderpriority").alias("original"),
        F.col("o_orderstatus").alias("translated"),
        (F.col("o_totalprice") / 500000).alias("confidence"))
    corrected = F.when(F.col("o_orderpriority") == "5-LOW", F.concat("o_orderstatus", F.lit("*"))) \
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat("o_orderstatus", F.lit(" "))) \
        .otherwise(F.col("o_orderstatus"))
    new = t.orders.where("o_orderpriority <> '1-URGENT'").select(
        "o_orderkey", corrected.alias("translated"))
    return promote_feedback(
        old, new, ["o_orderkey"], F.concat(F.lit("Human review: "), F.col("o_orderkey")))


_FEEDBACK_SQL = """
    WITH f AS (SELECT o_orderkey, 'EXPR ' || o_orderpriority AS original, o_orderstatus AS translated,
        CASE o_orderpriority WHEN '5-LOW' THEN o_orderstatus || '*' WHEN '2-HIGH' THEN o_orderstatus || ' '
             ELSE o_orderstatus END AS corrected FROM orders
        WHERE o_orderpriority <> '1-URGENT' AND (o_orderpriority = '5-LOW' OR o_totalprice / 500000 < 0.75))"""


@query("feedback_audit", f"""{_FEEDBACK_SQL}
    SELECT o_orderkey, original AS original_logic, translated AS output, corrected AS corrected_output,
           'Human review: ' || o_orderkey AS reason FROM f""")
def feedback_audit(t):
    return _reviewed(t)[0]


@query("feedback_rules", f"""{_FEEDBACK_SQL}
    SELECT o_orderkey, original AS pattern, corrected AS replacement, 0.9::DOUBLE AS confidence,
           true AS approved, 0 AS usage_count FROM f""")
def feedback_rules(t):
    return _reviewed(t)[1]


@query("semantic_append", """
    SELECT vec_id, 'logic ' || label AS logic, list_sum(embedding::DOUBLE[]) > 0 AS positive, 0.9::DOUBLE AS confidence
    FROM embeddings
    UNION ALL SELECT vec_id + 1000000, 'new ' || label, list_sum(embedding::DOUBLE[]) > 0, 0.7::DOUBLE FROM embeddings""")
def semantic_append_query(t):
    entry = lambda prefix, shift: t.embeddings.select(
        (F.col("vec_id") + shift).alias("vec_id"), F.concat(F.lit(prefix), "label").alias("logic"), "embedding")
    entries = semantic_append(entry("logic ", 0).withColumn("confidence", F.lit(0.9)), entry("new ", 1000000))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return entries.select("vec_id", "logic", (total > 0).alias("positive"), "confidence")
