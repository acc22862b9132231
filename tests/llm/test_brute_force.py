"""Fingerprints, languages and urls against plain versions of their own, and what the results are worth."""

from __future__ import annotations

import random
import re
import struct
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import queries
from weftline.llm.language import FILTERS, WIDTHS, WINDOW, ByteNetwork, identify, training_sample
from weftline.llm.order_minhash import edited_fingerprints, fingerprints, likeness
from weftline.llm.urls import BUCKETS, LABELLED, RULES, SIZES, filter_urls, fit

FOLDER = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def chained(*values):
    """Spark's xxhash64: each value's hash is the next one's seed, nulls are passed over."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q", v), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_parts(text):
    """Tuple number -> the hash of its two members, in the order in which they stand in the text."""
    tokens = [t.encode() for t in re.findall(r"\S{1,16}", text, re.ASCII)]
    seen, least = {}, {}
    for at in range(max(1, len(tokens) - 2) if tokens else 0):
        run = chained(*tokens[at:at + 3])
        seen[run] = seen.get(run, 0) + 1
        value = chained(struct.pack("<q", run), struct.pack("<i", seen[run]))
        half = (abs(value) // 64 * (1 if value >= 0 else -1)) % 2
        kept = least.setdefault(value % 64, {})
        kept[half] = min(kept.get(half, (value, at)), (value, at))
    return {k: chained(*[v for v, _ in sorted(m.values(), key=lambda x: x[1])]) & 0xFFFF for k, m in least.items()}


def plain_likeness(a, b):
    return sum(a.get(k) == v for k, v in b.items()) / len({*a, *b}) if a or b else 1.0


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(4)
    kinds = [lambda: f"w{rng.randrange(30)}", lambda: "日本語" * rng.randrange(1, 9), lambda: "x" * rng.randrange(1, 60), lambda: "Ä\u00a0ö"]
    texts = ["", " \n", "one", "one two", *[" ".join(rng.choice(kinds)() for _ in range(rng.randrange(1, 400))) for _ in range(80)]]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    rows.sort(reverse=True)
    written = lambda parts: "".join(f"{k:02X}{v:04X}" for k, v in sorted(parts.items()))
    for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        own, edited, following = map(plain_parts, (text, text[:len(text) - half] + after[:half], after))
        assert (got[doc].fingerprint, got[doc].edited_fingerprint) == (written(own), written(edited))
        assert got[doc].near_edited == pytest.approx(plain_likeness(own, edited))
        assert got[doc].near_next == pytest.approx(plain_likeness(own, following))


def test_likeness_falls_with_edits_and_feels_order(spark):
    rng = random.Random(12)
    rates = [0.0, 0.01, 0.03, 0.1, 0.3]
    rows = []
    for doc in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(400)]
        for k, rate in enumerate(rates):
            rows.append((doc, k, " ".join(f"n{rng.randrange(3000)}" if rng.random() < rate else w for w in base)))
        pieces = [base[at:at + 20] for at in range(0, 400, 20)]
        rng.shuffle(pieces)
        rows.append((doc, len(rates), " ".join(w for p in pieces for w in p)))
    parts = fingerprints(spark.createDataFrame(rows, "doc long, kind int, text string"), ["doc", "kind"], "text")
    first = parts.where("kind = 0").select("doc", F.col("parts").alias("base"))
    found = parts.join(first, "doc").groupBy("kind").agg(F.avg(likeness(F.col("base"), F.col("parts"))).alias("near")).collect()
    near = [r.near for r in sorted(found, key=lambda r: r.kind)]
    # A run of three stays with the cube of a word's chance; the two members of a tuple agree like two draws of the runs' overlap.
    stay = [(1 - rate) ** 3 for rate in rates]
    assert near[:5] == pytest.approx([(p / (2 - p)) ** 2 for p in stay], abs=0.03)
    # Nine runs in ten are still there when stretches of twenty words change places: a plain set of runs is alike to
    # over four fifths, tuples in the order of the text are not.
    assert near[5] < 0.6


def plain_chances(network, data):
    """Sums of logarithms over windows, with the convolution written out over one-hot bytes."""
    total = np.zeros(len(network.labels))
    for at in range(0, len(data), WINDOW):
        part = data[at:at + WINDOW]
        hot = np.zeros((WINDOW, 256))
        hot[np.arange(WINDOW), [*part, *[0] * (WINDOW - len(part))]] = 1
        hidden = []
        for k, width in enumerate(WIDTHS):
            answers = [sum(hot[i + j] @ network.filters[k][j] for j in range(width)) for i in range(WINDOW - width + 1)]
            hidden += list(np.max(answers, axis=0) + network.bias[k * FILTERS:(k + 1) * FILTERS])
        z = np.maximum(hidden, 0) @ network.out + network.shift
        total += (z - np.log(np.exp(z).sum())) * (len(part) / WINDOW if len(data) > WINDOW else 1)
    chance = np.exp(total - total.max())
    return chance / chance.sum()


def test_languages_equal_brute_force(spark):
    rng, network = random.Random(6), ByteNetwork(["aa", "bb", "cc"])
    texts = ["a", "Zebra", *["".join(rng.choice("abcdefghÉßж ") for _ in range(n)) for n in (1 + WINDOW // 2, WINDOW, 700, 1500)]]
    out = identify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), network).collect()
    for r in out:
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), r.text).replace("É", "é").encode()
        chance = plain_chances(network, folded)
        assert r.lang_pred == network.labels[int(chance.argmax())] and r.score == pytest.approx(chance.max(), rel=1e-3)


def test_training_sample_is_the_first_by_order_of_all_tasks(spark):
    rows = [(i * 7919 % 10007, "aa" if i % 10 else "bb", f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "o int, lang string, text string").repartition(37)
    sample = training_sample(df, F.col("o"), documents=50)
    for lang in ("aa", "bb"):
        wanted = [t for _, l, t in sorted(rows) if l == lang][:50]
        assert list(sample[sample["lang"] == lang]["text"]) == wanted


@tables
def test_languages_of_held_out_documents(spark):
    df = queries.QUERIES["op10_language_id"](spark, FOLDER)
    lang = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang", "n_chars")
    rows = df.where("held_out and lang_pred <> 'und'").join(lang.where("lang IS NOT NULL"), "doc_id").collect()
    assert len(rows) > 150
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert np.mean([r.lang == r.lang_pred for r in rows if r.n_chars >= 200]) > 0.98


def plain_grams(part, seed):
    data = re.sub(r"[0-9]", "0", part).encode("utf-8", "replace")
    return {xxhash.xxh32_intdigest(data[i:i + n], seed) % BUCKETS for n in SIZES for i in range(len(data)) if i + n <= len(data)}


@tables
def test_urls_equal_brute_force(spark):
    odd = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.COM/en/a", "x://example.com/en", "x://example.com/en/?a://b", "x://www.example.com/en/1#f",
           "x://a.www.example.com/en/", "x://notexample.com/en/", "x://x.net/es/", "x://net/fr/?", "x://Ünet.net/fr/x", "x://a?b/c", "x://a\nb.net/es/1",
           "x://example.com:80/en/", "x://" + "y" * 5000 + ".com/", "x://net/" + "es/" * 3000, "a://b://net/es/"]
    urls = odd + [r.url for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("url").collect()]
    got = filter_urls(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string"), RULES, LABELLED).collect()
    weights, bias = fit(LABELLED)
    assert len(got) == len(urls)
    for r in got:
        after = (r.url or "").split("://", 1)
        host, path = re.match(r"([^/?#]*)([^?#]*)", after[1]).groups() if len(after) == 2 else ("", "")
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(rule), rule, says) for rule, says in RULES
                if f".{host}".endswith("." + rule.split("/", 1)[0]) and path.startswith("/" + rule.split("/", 1)[1])]
        _, rule, says = max(fits, default=(0, None, None))
        grams = plain_grams(f"^{host}$", 1) | plain_grams(f"^{path}$", 2)
        chance = 1 / (1 + np.exp(-(sum(weights[g] for g in grams) / max(len(grams), 1) ** 0.5 + bias)))
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.score == pytest.approx(chance, abs=1e-4)
        assert r.verdict == (says or ("block" if chance > 0.5 else "allow"))
