from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators.feedback import promote_feedback, semantic_append
from weftline.operators.names import contained_in, substring_link
from weftline.operators.patterns import ENGINE_PATTERNS, classify_hit, needed_text, pattern_scan, scan_summary
from weftline.operators.rewrites import to_sql
from weftline.operators.rules import low_confidence, rewrite_chain, rule_lookup, tiered_match

RULES = [
    (1, "NVL(", "use coalesce", True), (2, "NVL(A", "never first", True), (3, "II", "not approved", False),
    (5, "IIF(X", "wide", True), (4, "IIF(XY", "narrow but first", True), (6, "", "empty", True),
    (8, "IIF(X", "same pattern, later", True),
]


@pytest.fixture
def rules(spark):
    return spark.createDataFrame(RULES, "rule_id int, pattern string, replacement string, approved boolean")


@pytest.mark.parametrize("sent", [32 << 20, 0])
def test_rule_lookup(spark, rules, sent):
    texts = [" NVL(A, 0)", "\tIIF(XY, 1)", "IIF(X, 1)", "II", "", None, "nvl(", "NVL("] * 2
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r["id"]: (r["rule_id"], r["replacement"])
           for r in rule_lookup(df, rules, "text", sent).collect()}
    for i, text in enumerate(texts):
        fitting = [r for r in RULES if r[3] and r[1] and text and text.strip().startswith(r[1])]
        first = min(fitting) if fitting else None
        assert got[i] == ((first[0], first[2]) if first else (None, None)), text
    assert len(got) == len(texts)


@pytest.mark.parametrize("sent", [32 << 20, 0])
def test_rule_lookup_without_rules(spark, rules, sent):
    df = spark.createDataFrame([("a",)], "text string")
    row = rule_lookup(df, rules.limit(0), "text", sent).first()
    assert (row["rule_id"], row["replacement"]) == (None, None)


REWRITES = [
    ("IIF(STATUS = 'A', 1, 0)", "CASE WHEN STATUS = 'A' THEN 1 ELSE 0 END"),
    ("SYSDATE", "NOW()"),
    ("TO_DATE(LOAD_DATE, 'YYYY-MM-DD')", "TO_TIMESTAMP(LOAD_DATE, 'YYYY-MM-DD')"),
    ("TRUNC(AMT * QTY)", "TRUNC(AMT * QTY)"),
    ("TRUNC(AMT, 2)", "TRUNC(AMT, 2)"),
    ("TRUNC(SYSDATE) || A", "DATE_TRUNC('day', NOW()) || A"),
    ("IIF(UPPER(A)='X', NVL(B,0), 1)", "CASE WHEN UPPER(A)='X' THEN COALESCE(B, 0) ELSE 1 END"),
    ("IIF(ISNULL(A), SUBSTR(B,1,3), C)", "CASE WHEN A IS NULL THEN SUBSTRING(B, 1, 3) ELSE C END"),
    ("DECODE(A,1,'x',2,'y',3,'z','w')", "CASE WHEN A=1 THEN 'x' WHEN A=2 THEN 'y' WHEN A=3 THEN 'z' ELSE 'w' END"),
    ("DECODE(A,1,'x')", "CASE WHEN A=1 THEN 'x' END"),
    ("'NVL(A, 0) it''s' || NVL(')', B)", "'NVL(A, 0) it''s' || COALESCE(')', B)"),
    ("ADD_TO_DATE(D, 'MM', N + 1)", "D + (N + 1) * INTERVAL '1' MONTH"),
    ("NVL(A, (B", "NVL(A, (B"),
    ("MY_NVL(A, (B + 1))", "MY_NVL(A, (B + 1))"),
    ("TRUNC(D, 'MM')", "DATE_TRUNC('month', D)"),
    ("nvl(DISCOUNT, 0)", "COALESCE(DISCOUNT, 0)"),
    ("LTRIM(RTRIM(NAME))", "LTRIM(RTRIM(NAME))"),
    ("UPPER(SUBSTR(CODE, 1, 3))", "UPPER(SUBSTRING(CODE, 1, 3))"),
    ("DECODE(TYPE, 'A', 'Active', 'I', 'Inactive', 'Unknown')",
     "CASE WHEN TYPE='A' THEN 'Active' WHEN TYPE='I' THEN 'Inactive' ELSE 'Unknown' END"),
    ("ADD_TO_DATE(LOAD_DATE, 'DD', 30)", "LOAD_DATE + INTERVAL '30' DAY"),
    ("GET_DATE_PART(BIRTH_DATE, 'YEAR')", "YEAR(BIRTH_DATE)"),
    ("IIF(ISNULL(A), 0, A)", "CASE WHEN A IS NULL THEN 0 ELSE A END"),
    ("LENGTH(A) + LEN(B)", "CHAR_LENGTH(A) + CHAR_LENGTH(B)"),
    ("TO_DECIMAL(A, 10, 2)", "CAST(A AS DECIMAL(10,2))"),
    ("ISNULL(A OR B)", "(A OR B) IS NULL"),
    ("NOT ISNULL(A = B) AND C", "NOT (A = B) IS NULL AND C"),
    ("ISNULL(A) = ISNULL(B)", "(A IS NULL) = (B IS NULL)"),
    ("DECODE(X, NULL, 'n', 'y')", "CASE WHEN X IS NULL THEN 'n' ELSE 'y' END"),
    ("DECODE(X, Y, 1, -2, 2)", "CASE WHEN X IS NOT DISTINCT FROM Y THEN 1 WHEN X=-2 THEN 2 END"),
    ("DECODE(TRUE, A > 5 AND B, 'big', ISNULL(A), 'none', 'small')", "CASE WHEN A > 5 AND B THEN 'big' WHEN A IS NULL THEN 'none' ELSE 'small' END"),
    ("DECODE(A OR B, TRUE, 1)", "CASE WHEN (A OR B) IS NOT DISTINCT FROM TRUE THEN 1 END"),
    ("TRUNC(AMT + TAX)", "TRUNC(AMT + TAX)"),
    ("TRUNC(-(AMT - TAX))", "TRUNC(-(AMT - TAX))"),
    ("TRUNC(NVL(AMT, 0))", "TRUNC(COALESCE(AMT, 0))"),
    ("TRUNC(IIF(A > B, ROUND(C, 1), D))", "TRUNC(CASE WHEN A > B THEN ROUND(C, 1) ELSE D END)"),
    ("TRUNC(SYSDATE - 1)", "DATE_TRUNC('day', NOW() - 1)"),
    ("TRUNC(SYSDATE - TO_DATE(A, 'YYYY'))", "TRUNC(NOW() - TO_TIMESTAMP(A, 'YYYY'))"),
    ("TRUNC(LOAD_DATE)", "DATE_TRUNC('day', LOAD_DATE)"),
    ("A - ADD_TO_DATE(D, 'DD', 2)", "A - (D + INTERVAL '2' DAY)"),
    ("2 * LENGTH(A || B)", "2 * CHAR_LENGTH(A || B)"),
    ("INSTR(A OR B, 'x')", "POSITION('x' IN (A OR B))"),
    ("INSTR(A, 'x', 2)", "INSTR(A, 'x', 2)"),
    ("IIF(A BETWEEN LEN(B) AND 3 AND C NOT IN ('x', 'y'), 1, 0)", "CASE WHEN A BETWEEN CHAR_LENGTH(B) AND 3 AND C NOT IN ('x', 'y') THEN 1 ELSE 0 END"),
    ("IIF(A IS NOT NULL AND B LIKE 'x%', NVL(A, B), 0) -- it's (open", "CASE WHEN A IS NOT NULL AND B LIKE 'x%' THEN COALESCE(A, B) ELSE 0 END -- it's (open"),
    ("NVL(A, -- first (of two\n  B)", "COALESCE(A, -- first (of two\n  B)"),
    ("/* don't */ NVL( A , B /* or ) */ )", "/* don't */ COALESCE(A, B /* or ) */)"),
    ("SUBSTR( A,1 ,2 ) || UPPER( B )", "SUBSTRING(A, 1, 2) || UPPER( B )"),
    ("NVL(A,)", "NVL(A,)"),
    ("NVL(A, 'open)", "NVL(A, 'open)"),
    ("NVL(A, 0))", "NVL(A, 0))"),
    ("A = ", "A = "),
    ("NVL()", "NVL()"),
    ("", ""),
    ("ÜBER_NVL(Ä) || NVL(Ö, 1)", "ÜBER_NVL(Ä) || COALESCE(Ö, 1)"),
    ("SRC.AMT >= :LKP.RATE(ID) || $$PARAM", "SRC.AMT >= :LKP.RATE(ID) || $$PARAM"),
    ("(" * 2000 + "A" + ")" * 2000, "(" * 2000 + "A" + ")" * 2000),
]


def test_rule_lookup_shuffles_no_input(spark, rules):
    """Any number of pattern lengths, and the input stays where it is."""
    more = rules.unionByName(spark.range(1, 40).selectExpr("cast(id + 100 as int) rule_id", "repeat('Z', cast(id as int)) pattern", "'z' replacement", "true approved"))
    df = spark.range(1000).selectExpr("id", "concat(repeat('Z', cast(id % 50 as int)), '!') text")
    out = rule_lookup(df, more, "text")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.rule_id) for r in out.collect()} == {(i, 101 if i % 50 else None) for i in range(1000)}


def test_rewrites(spark):
    rows = rewrite_chain(spark.createDataFrame(REWRITES, "text string, expected string"), "text").collect()
    wrong = [(r["text"], r["rewritten"]) for r in rows if r["rewritten"] != r["expected"] or r["changed"] != (r["text"] != r["expected"])]
    assert not wrong and len(rows) == len(REWRITES)


def test_rewrites_parse_and_give_the_values_of_the_source(spark):
    """Expected values, not texts: what each expression means for a row."""
    row = spark.createDataFrame([(None, 7, -2.75, "ab,c", "2020-02-29 10:30:00")], "N int, I int, X double, S string, T string").withColumn("D", F.to_timestamp("T"))
    cases = {
        "ISNULL(N) = ISNULL(I)": False, "DECODE(N, NULL, 'null', 'other')": "null", "DECODE(N, I, 1, N, 2)": 2, "IIF(ISNULL(N), NVL(N, I) * 2, 0)": 14,
        "INSTR(S, ',') + LEN(S)": 7, "SUBSTR(S, 1, 2) || '-' || TO_CHAR(I)": "ab-7", "TO_INTEGER('12') - TO_INTEGER('2')": 10,
        "GET_DATE_PART(ADD_TO_DATE(D, 'MM', I + 5), 'YEAR')": 2021, "DATE_DIFF(ADD_TO_DATE(D, 'DD', 30), D, 'DD')": 30, "GET_DATE_PART(TRUNC(D, 'MM'), 'DD')": 1,
        "DECODE(TRUE, I > 10, 'much', I > 5, 'some', 'few')": "some",
    }
    for text, expected in cases.items():
        # Spark's name of a text of any length.
        sql = to_sql(text).replace("VARCHAR", "STRING")
        assert row.select(F.expr(sql).alias("v")).first()["v"] == expected, text


def test_tiers(spark, rules):
    data = [
        (1, "NVL(A)", None), (2, "near", [0.0, 0.1]), (3, "far SYSDATE", [5.0, 5.0]), (4, "plain", None),
        (5, "  ", [0.0, 0.0]), (6, None, None), (7, "NVL(B)", [0.0, 0.0]),
    ]
    df = spark.createDataFrame(data, "id int, text string, vec array<double>")
    entries = spark.createDataFrame([(10, "stored", [0.0, 0.0])], "entry_id int, logic string, embedding array<double>")
    out = tiered_match(df, "text", rules, ("id", "vec"), entries)
    assert out.columns == ["id", "text", "vec", "translated", "confidence", "method"]
    got = {r["id"]: (r["translated"], round(r["confidence"], 6), r["method"]) for r in out.collect()}
    assert got == {
        1: ("use coalesce", 0.97, "deterministic"), 2: ("stored", 0.9, "semantic"),
        3: ("far NOW()", 0.88, "regex"), 4: ("plain", 0.4, "passthrough"),
        5: ("  ", 1.0, "passthrough"), 6: (None, 1.0, "passthrough"),
        7: ("use coalesce", 0.97, "deterministic"),
    }
    without = {r["id"]: r["method"] for r in tiered_match(df, "text", rules).collect()}
    assert without[2] == "passthrough"
    assert [r["id"] for r in low_confidence(out).collect()] == [4]


def test_feedback(spark):
    columns = "k int, original string, translated string, confidence double"
    old = spark.createDataFrame([
        (1, "A", "a", 0.9), (2, "B", "b", 0.9), (3, "C", "c", 0.7), (4, "", "d", 0.1), (5, "E", "e", None),
        (6, "F", "f", 0.1)], columns)
    new = spark.createDataFrame(
        [(1, "a "), (2, "B2"), (3, "c"), (4, "x"), (5, "e")], "k int, translated string")
    audit, rules = promote_feedback(old, new, ["k"], F.lit("why"))
    assert sorted((r["k"], r["output"], r["corrected_output"]) for r in audit.collect()) \
        == [(2, "b", "B2"), (3, "c", "c")]
    assert sorted((r["pattern"], r["replacement"], r["confidence"], r["approved"]) for r in rules.collect()) \
        == [("B", "B2", 0.9, True), ("C", "c", 0.9, True)]
    entries = spark.createDataFrame([("a", 0.9)], "logic string, confidence double")
    added = semantic_append(entries, spark.createDataFrame([("b",)], "logic string"))
    assert sorted(tuple(r) for r in added.collect()) == [("a", 0.9), ("b", 0.7)]


def test_pattern_scan_and_summary(spark):
    long = "x" * 300 + " from PySpark import it"
    df = spark.createDataFrame([
        (1, "Java Transformation", "Uses spark.sql( to process"), (2, "Expression", None), (3, long, "rdd here")],
        "id int, kind string, description string")
    hits = pattern_scan(df, "id", ["kind", "description"])
    got = {(r["id"], r["column_name"], r["pattern"]) for r in hits.collect()}
    assert got == {
        (1, "kind", r"Java\s+Transformation"), (1, "description", r"\bSpark\b"),
        (1, "description", r"spark\.sql\("), (3, "kind", r"\bPySpark\b"), (3, "kind", r"from\s+pyspark"),
        (3, "description", r"\bRDD\b")}
    assert {len(r["matched_text"]) for r in hits.where("id = 3 AND column_name = 'kind'").collect()} == {200}
    assert sorted(tuple(r) for r in scan_summary(df, hits, "id").collect()) \
        == [(1, True, 3), (2, False, 0), (3, True, 3)]
    advice = hits.select(classify_hit(F.col("pattern")).alias("a")).distinct().collect()
    assert {r["a"] for r in advice} == {"rewrite as custom code", "run as a distributed job", "refactor to SQL"}


def test_substring_link_matches_brute_force(spark):
    pick = random.Random(5)
    word = lambda n: "".join(pick.choice("abAB_") for _ in range(pick.randint(0, n)))
    a, b = {word(3) for _ in range(30)}, {word(9) for _ in range(60)}
    frame = lambda words, name: spark.createDataFrame([(w,) for w in words], f"{name} string")
    inside = {(x, y) for x in a for y in b if x and x.upper() in y.upper()}
    got = contained_in(frame(a, "x"), frame(b, "y"), "x", "y").collect()
    assert {tuple(r) for r in got} == inside and len(got) == len(inside)
    either = inside | {(x, y) for x in a for y in b if y and y.upper() in x.upper()}
    got = substring_link(frame(a, "x"), frame(b, "y"), "x", "y").collect()
    assert {tuple(r) for r in got} == either and len(got) == len(either)
    assert contained_in(frame(["a"], "x").limit(0), frame(b, "y"), "x", "y").count() == 0


@pytest.mark.parametrize("pattern, needed", [
    (r"\bSpark\b", "spark"), (r"\bSpark\s*Session\b", "session"), (r"import\s+org\.apache\.spark", "org.apache.spark"), (r"spark\.sql\(", "spark.sql("),
    (r"licen[sc]e", "licen"), (r"[0-9]{4,}", None), (r"[a-z0-9._%+-]+@[a-z0-9.-]+[.][a-z]{2,}", "@"), (r"ab?cd*eg+f", "eg"), (r"a|b", None), (r"(x)yz", None),
    (r"x{2}yz", "yz"), (r"[]a]bc", "bc"), (r"ümlaut", None), (r"\d+", None), ("", None),
])
def test_needed_text(pattern, needed):
    assert needed_text(pattern) == needed


def test_every_match_holds_the_needed_text():
    import re
    pick = random.Random(6)
    for _ in range(20_000):
        pattern = "".join(pick.choice(["a", "B", " ", r"\.", "[ab]", "a?", "b*", "c+", "a{2}", r"\s", ".", "[^a]", r"\b"]) for _ in range(pick.randint(1, 5)))
        needed = needed_text(pattern)
        text = "".join(pick.choice("abcABC. ") for _ in range(8))
        if needed and re.search(pattern, text, re.IGNORECASE):
            assert needed in text.lower(), (pattern, text)
    assert all(needed_text(p) for p in ENGINE_PATTERNS)
