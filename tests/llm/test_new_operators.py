"""The conversation trie, the secret scan and the hard negatives against brute force and on odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from oracle import connect, difference
from weftline.llm import conversation_trie, hard_negatives as mining
from weftline.llm.conversation_trie import prefix_trie, turn_rows, with_heads
from weftline.llm.hard_negatives import hard_negatives, usable
from weftline.llm.queries import ORACLES, QUERIES
from weftline.llm.secret_scan import RULES, Rule, findings, read_ledger, scan, scan_all

TURNS = "conv_id long, turn long, role string, text string, node string, turns string, ended string"


def turns(spark, rows):
    """(conv_id, turn, role, text) rows with columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS)


def brute_trie(rows):
    """(conv_id, depth): the node's other values."""
    said = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        said.setdefault(conv, []).append((role or "", text or ""))
    members = {}
    for conv, path in said.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(conv)
    out = {}
    for node, convs in members.items():
        below = [x for x in members if x[:len(node)] == node]
        ends = sorted(c for c in convs if len(said[c]) == len(node))
        out[min(convs), len(node)] = (
            min(members[node[:-1]]) if node else None, len(convs), sum(len(x) == len(node) + 1 for x in below),
            sum(not any(y != x and y[:len(x)] == x for y in below) for x in below),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return out


def trie(rows_df):
    got = prefix_trie(rows_df).collect()
    assert len({(r.conv_id, r.depth) for r in got}) == len(got)
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}


@pytest.mark.parametrize("piece", [1024, 3])
def test_trie_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(conversation_trie, "PIECE", piece)
    rng, rows = random.Random(piece), []
    base = [("user" if i % 2 else "system", f"turn {i} " * rng.randrange(1, 9)) for i in range(12)]
    for conv in range(150):
        # Many copies, many beginnings of one conversation, branches at every depth, and some alone.
        path = base[:rng.choice([0, 1, 1, 3, 5, 12, 12, 12])] + [("user", f"own {rng.randrange(3)}")] * rng.randrange(0, 3)
        rows += [(conv * 7 - 200, t, *turn) for t, turn in enumerate(path)]
    assert trie(turn_rows(turns(spark, rows))) == brute_trie(rows)


def test_trie_of_odd_input(spark):
    rows = [(1, None, None, None), (1, None, "user", "b"), (1, 5, "user", "a"), (1, 5, "user", "a"), (2, 1, "", ""), (2, 2, "user", "b"),
            (None, 1, "user", "lost"), (3, 9, "user", "Ünï" * 20_000), (3, 9, "assistant", "first by role"), (4, 1, "use", "rb"), (4, 2, "user", "")]
    assert trie(turn_rows(turns(spark, rows))) == brute_trie(rows)
    assert prefix_trie(turn_rows(turns(spark, []))).count() == 0
    empty = spark.createDataFrame([(8, None), (5, []), (None, [])], "conv_id long, turns array<struct<id:string,size:long>>")
    assert trie(empty) == {(5, 0): (None, 2, 0, 1, 0, hashlib.sha256(b"5,8").hexdigest())}


def test_heads_of_another_conversation(spark):
    rows = [(100, t, "user", f"h{t}") for t in range(3)] + [(101, t, "user", f"o{t}") for t in range(6)] + [(102, 0, "user", "only")] + [(201, 0, "user", "far")]
    mixed = with_heads(turn_rows(turns(spark, rows)), F.col("conv_id") - F.col("conv_id") % 100, F.lit(4), 5)
    assert {r.conv_id: len(r.turns) for r in mixed.collect()} == {100: 3, 101: 3 + 2, 102: 3, 201: 0}


def brute_spans(text):
    kinds = [("assign", re.compile(RULES[0].pattern, re.ASCII), 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)]
    return [(m.start(), place, m.end(), kind) for place, (kind, pattern, group, least) in enumerate(kinds)
            for m in pattern.finditer(text or "") if len(m[group]) >= least]


SECRETS = ["password: abcdefgh1", "TOKEN='short'", "secret=token:abcdefgh1234", "api_key = \"ABCDEF/+._=-123\"", "AKIAABCDEFGHIJKL9", "AKIAAKIAAKIAAKIA", "AKIAxx",
           "deadbeef" * 4, "deadbeef" * 3, "passwd:=verylongvalue", "ſecret=notasecret99", "apikey:x" * 3, "tokentoken=0123456789abcdef0123456789abcdef"]


def test_spans_equal_brute_force(spark):
    rng, rows = random.Random(5), [(1, None), (2, ""), (3, " "), (4, "AKIA"), (4, "AKIA"), (None, SECRETS[0]), (5, ("é𝔘 " + SECRETS[0] + " ") * 500), (6, "a" * 200_000)]
    for i in range(300):
        parts = [rng.choice([*SECRETS, "plain", "words", "é𝔘", "key", "\n", "="]) for _ in range(rng.randrange(0, 12))]
        rows.append((10 + i, rng.choice(["", " ", ", "]).join(parts)))
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, blob string, found string")
    got = sorted(((r.doc_id or 0, [tuple(f) for f in r.found]) for r in scan_all(df, keep=["doc_id"]).select("doc_id", "found").collect()), key=str)
    assert got == sorted(((i or 0, sorted(brute_spans(t))) for i, t in rows), key=str)
    assert scan_all(df.limit(0), keep=["doc_id", "blob"]).columns == ["doc_id", "blob", "found"]


def test_ledger_scans_only_what_it_does_not_hold(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    first = spark.createDataFrame([("a", 1, SECRETS[0]), ("b", 1, SECRETS[0]), ("a", 2, "clean"), ("c", 1, None)], "path string, version int, text string")
    assert scan(first, ledger).count() == 2 * len(RULES)
    later = first.unionByName(spark.createDataFrame([("a", 3, SECRETS[4]), ("d", 1, "clean")], first.schema))
    assert scan(later, ledger).count() == len(RULES)
    assert scan(later, ledger).count() == 0
    # A new version of one rule: that pair of every blob, and nothing else.
    newer = (Rule("assign", 2, "clean"), *RULES[1:])
    assert {(r.kind, r.version) for r in scan(later, ledger, newer).collect()} == {("assign", 2)}
    assert read_ledger(spark, ledger).count() == 3 * (len(RULES) + 1)
    named = lambda rules: {(r.path, r.version): [f.kind for f in r.found] for r in findings(later, ledger, rules, keep=["path", "version"]).collect()}
    assert named(RULES) == {("a", 1): ["assign"], ("b", 1): ["assign"], ("a", 2): [], ("c", 1): [], ("a", 3): ["access"], ("d", 1): []}
    assert named(newer)["d", 1] == ["assign"] and named(newer)["a", 1] == []


def test_secret_scan_uses_no_python(spark):
    plan = QUERIES["op12_secret_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_negatives(rows, anchors, k=5, low=80):
    out = set()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for a, label, v in rows:
        if a % anchors:
            continue
        scored = sorted(((-dot(v, w), i, other) for i, other, w in rows if i != a))
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            near = [(n, i) for n, i, other in scored if other != label and low * -s <= 100 * -n <= 100 * -s][:k]
            out |= {(a, p, rank + 1, i, -s, -n) for rank, (n, i) in enumerate(near)}
    return out


@pytest.mark.parametrize("block", [32_768, 3])
def test_negatives_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(mining, "ANCHORS", block)
    monkeypatch.setattr(mining, "SEARCHED", 20 if block == 3 else 65_536)
    rng = random.Random(block)
    centres = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(260):
        near = [c + rng.uniform(-0.2, 0.2) for c in rng.choice(centres)] if i % 3 else [0.5] * 6  # a third are equal
        rows.append((i, rng.randrange(3), near))
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, score string")
    got = {tuple(r) for r in hard_negatives(usable(df), "vec_id % 10 = 0").collect()}
    assert got == brute_negatives([(i, b, [math.floor(256 * x) for x in v]) for i, b, v in rows], 10)
    assert len(got) > 100


def test_negatives_of_odd_input(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 1.0]), (1, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 2, [1.0]), (3, 2, [1.0, nan]), (4, 2, [inf, 1.0]), (5, 2, [None, 1.0]), (6, 2, None),
            (7, None, [1.0, 1.0]), (None, 2, [1.0, 1.0]), (8, 2, [0.7, 0.7]), (9, 2, []), (20, 3, [-1.0, -1.0]), (21, 3, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, embedding array<double>, row int")
    got = {tuple(r) for r in hard_negatives(usable(df), "vec_id % 10 = 0").collect()}
    # 0 and 1 score 256 * 256 + 256 * 128; only 8 lies from 80 to 100 hundredths of it (2 and 21 score 65,536). The anchor 20 scores below 0.
    assert got == {(0, 1, 1, 8, 98304, 2 * 256 * 179)}
    assert hard_negatives(usable(df.limit(0)), "vec_id = 0").count() == 0
    assert hard_negatives(usable(df), "vec_id = 77").count() == 0


@pytest.mark.parametrize("name", ["op8_minhash_near_duplicates", "op11_conversation_trie", "op12_secret_scan", "op13_hard_negatives"])
def test_query_matches_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    assert difference(QUERIES[name](spark, folder), connect(folder), ORACLES[name]) is None


def brute_leak(text, item, threshold=0.5):
    """Whether a local alignment of the whole text with the item reaches the threshold."""
    a, b = text.lower().split(), item.lower().split()
    above, best = [0] * (len(a) + 1), 0
    for word in b:
        here = [0]
        for k, other in enumerate(a):
            here.append(max(0, above[k] + (2 if word == other else -1), above[k + 1] - 1, here[k] - 1))
        best, above = max(best, *here), here
    return best >= threshold * 2 * len(b)


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.2, 0.3, 0.34])
def test_leaks_by_edit_rate_against_whole_alignment(spark, rate):
    from weftline.llm.decontaminate import leaks
    rng = random.Random(int(rate * 100))
    some = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    items = {i: " ".join(some(rng.randrange(8, 40))) for i in range(25)}
    rows = []
    for i, item in items.items():
        for _ in range(4):
            words = []
            for w in item.split():
                edit = rng.random() / rate if rate else 9
                words += [] if edit < 0.2 else [*some(1), w] if edit < 0.4 else some(1) if edit < 1 else [w]
            rows.append((len(rows), i, " ".join([*some(rng.randrange(40)), *words, *some(rng.randrange(40))])))
    texts = spark.createDataFrame([(d, t) for d, _, t in rows], "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(texts, bench).collect()}
    due = {(d, i) for d, _, t in rows for i, item in items.items() if brute_leak(t, item)}
    assert got <= due
    # Up to three words in ten all are found; beyond, a text may keep no seed at all.
    assert len(got & due) >= (1.0 if rate <= 0.3 else 0.97) * len(due), sorted(due - got)


@pytest.mark.parametrize("every", [3, 4, 5])
def test_leaks_with_evenly_spread_changes(spark, every):
    from weftline.llm.decontaminate import leaks
    item = [f"q{i}" for i in range(36)]
    edited = [f"z{i}" if i % every == every - 1 else w for i, w in enumerate(item)]
    texts = spark.createDataFrame([(1, "before " + " ".join(edited) + " after"), (2, " ".join(item[::2]))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert [r.doc_id for r in leaks(texts, bench).collect()] == [1]


def test_leaks_are_looked_up_once_for_equal_stretches(spark):
    """A passage in very many different texts gives a row for each text, not for each of its words."""
    from weftline.llm.decontaminate import leaks, without_leaks
    rng = random.Random(8)
    item = " ".join(f"q{i}" for i in range(30))
    rows = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(20)) + f" {item} end{i}", 1) for i in range(400)] + [(1000, "clean text here", 1)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, text_key int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in leaks(texts, bench).collect()} == set(range(400))
    left = without_leaks(texts, bench)
    assert left.columns == texts.columns and [tuple(r) for r in left.collect()] == [(1000, "clean text here", 1)]


CLASHING = ["_set", "_sig", "_bands", "_row", "_least", "_label", "_first", "_leaf", "_id", "_full", "_e", "_at", "_tie", "_place", "_host", "_page",
            "_wrapper", "_pages", "_score", "_limit", "nll", "bin", "n", "share", "aside0", "_S"]


def test_callers_columns_keep_names_and_values(spark):
    """Columns whose names the operators use themselves come back as they were."""
    from weftline.llm.hilbert import hilbert_shards
    from weftline.llm.minhash import near_duplicates, one_of_each
    from weftline.llm.mixing import mix
    from weftline.llm.quality import quality
    from weftline.llm.wrappers import extract
    rng = random.Random(1)
    names = [c for c in CLASHING if c != "_S"]
    rows = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(30)), rng.choice(["en", "de"]), f"http://h{i % 2}.org/{i}", *[f"{c}{i}" for c in names]) for i in range(12)]
    df = spark.createDataFrame(rows, ["doc_id", "_text", "lang", "url", *names])
    same = lambda out: [tuple(r) for r in out.select("doc_id", "_text", "lang", *names).orderBy("doc_id").collect()] == [r[:3] + r[4:] for r in rows]
    near = near_duplicates(df, text="_text")
    assert same(near) and near.columns == [*df.columns, "n_shingles", "component_id", "kept"]
    assert one_of_each(df, text="_text").columns == df.columns and same(one_of_each(df, text="_text"))
    assert same(hilbert_shards(df, ["lang", "_leaf"], [], 3, order=["_id"]))
    assert same(extract(df, page="_text"))
    good = df.select("doc_id").limit(5)
    judged = quality(df, good, text="_text")
    assert same(judged) and judged.columns == [*df.columns, "chars", "perplexity", "limit", "kept"]
    drawn = mix(df, {"part": F.col("_leaf"), "lang": F.col("lang")}, [F.lit(1), F.lit(1)], F.length("_text"), F.col("_id"), fraction=1.0, max_epochs=1)
    assert same(drawn)


def test_headings_of_sections_stay_and_named_boxes_go(spark):
    from weftline.llm.wrappers import extract
    page = "<article><h1>Head {0}</h1><h2>Summary</h2><p>Text {0}<h2>Sources</h2><p>Of {0}</article>"
    boxes = "".join(f'<div class="{c}">box</div>' for c in ("post-comments", "top-menu", "cookie-bar", "ad-banner", "sidebar-left", "related-links", "user-reviews"))
    rows = [(i, f"http://a.org/{i}", page.format(i)) for i in range(6)] + [(9, "http://one.org/", f"<div><p>Only text</div>{boxes}")]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Head {i}\nSummary\nText {i}\nSources\nOf {i}" for i in range(6)} | {9: "Only text"}
