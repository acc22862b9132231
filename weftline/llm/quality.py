"""Quality classifier: an interpolated modified Kneser-Ney model over bytes, and per-language limits.

An n-gram is ORDER bytes of the text's UTF-8, packed into a whole number, so letters of
any script count as what they are. Counts come from all trusted text but a held-out share
and meet in tables dealt out by n-gram; so do the smoothing terms, which are aggregates and
joins of those tables. To score, documents are dealt into blocks; a block sends each of its
different n-grams once to the model's tables and gets its cost back, and a document's
perplexity is the sum over its own. No table is collected or held whole anywhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from weftline.llm.common import put_back, set_aside
from weftline.session import cut_lineage, small_batches

ORDER, BITS = 5, 8
SYMBOLS, LEAD = 1 << BITS, ORDER - 1
#: Bytes coded at a time (an n-gram of each takes 8 times that, a few times over); a text over this is coded in overlapping stretches.
STRETCH = 1 << 20
#: Texts copied out of a column at a time.
COPIED = 256
#: Bytes of text whose n-grams are looked up together.
BLOCK = 1 << 25
#: What a row counts towards its block besides its text.
ROW = 64
#: Steps of log perplexity in which limits are counted.
STEP = 0.001
#: One trusted document in so many is kept from the model and sets the limits, where a language has at least so many of them.
FOLDS, LEAST = 5, 5


def _packed(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams inside the pieces, and how many each piece has."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    code = np.zeros(len(data) - LEAD, np.int64)
    for i in range(ORDER):
        code <<= BITS
        code |= data[i:len(data) - LEAD + i]
    inside = np.ones(len(code), bool)
    ends = np.cumsum(sizes)[:-1]
    for i in range(1, LEAD + 1):
        inside[ends - i] = False
    return code[inside], sizes - LEAD


def _texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes | None]:
    """The UTF-8 of a column of texts, copied out some at a time."""
    for at in range(0, len(column), COPIED):
        yield from column.slice(at, COPIED).cast(pa.large_binary()).to_pylist()


def _different(found: Iterable[np.ndarray]) -> np.ndarray:
    """All different numbers of some arrays, ascending; put together each time the new ones are as many as those known."""
    known, new, held = np.empty(0, np.int64), [], 0
    for some in found:
        new.append(np.unique(some))
        held += len(new[-1])
        if held >= max(len(known), STRETCH):
            known, new, held = np.unique(np.concatenate([known, *new])), [], 0
    return np.unique(np.concatenate([known, *new])) if new else known


def coded(texts: Iterable[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of the texts' n-grams, one for each byte: (place of text, how many n-grams) of each piece, and the n-grams.

    A text starts after LEAD line breaks.
    """
    pieces, owners, held = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text or b""), STRETCH):
            pieces.append(text[max(0, at - LEAD):at].rjust(LEAD, b"\n") + text[at:at + STRETCH])
            owners.append(i)
            held += len(pieces[-1])
            if held >= STRETCH:
                code, sizes = _packed(pieces)
                yield np.array(owners), sizes, code
                pieces, owners, held = [], [], 0
    if pieces:
        code, sizes = _packed(pieces)
        yield np.array(owners), sizes, code


def count_ngrams(texts: DataFrame) -> DataFrame:
    """(code, n) over all of the one text column; each stretch of text adds up its own n-grams first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, code in coded(_texts(batch.column(0))):
                found, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["code", "n"])

    return texts.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _low(code: Column, k: int) -> Column:
    """The last k bytes of an n-gram."""
    return code.bitwiseAND(F.lit((1 << (BITS * k)) - 1).cast("long"))


def kneser_ney(counts: DataFrame) -> tuple[dict[int, DataFrame], dict[int, DataFrame]]:
    """By level: (code, p) of every n-gram seen, interpolated, and (context, gamma) of every context seen.

    Level ORDER holds whole n-grams; lower levels hold n-grams by how many bytes they
    were seen after. ``gamma`` is the weight that a context (an n-gram without its last
    byte) leaves to the next lower level. Discounts for counts of one, two and more come
    from how many n-grams were seen one to four times.
    """
    tables = {ORDER: counts.select("code", F.col("n").cast("double").alias("n"))}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = cut_lineage(tables[k + 1].groupBy(_low(F.col("code"), k).alias("code")).agg(F.count(F.lit(1)).cast("double").alias("n")))
    probs, gammas = {}, {}
    for k in range(1, ORDER + 1):
        seen = tables[k]
        n1, n2, n3, n4 = seen.agg(*[F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)]).first()
        y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
        # Where a count of counts is missing its discount falls back to the plain one.
        d1, d2, d3 = (min(max(i - (i + 1) * y * b / a, 0.0), float(i)) if a else y for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
        cut = seen.withColumn("d", F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3))
        cut = cut.withColumn("context", F.shiftright("code", BITS))
        context = cut.groupBy("context").agg(F.sum("n").alias("all"), F.sum("d").alias("left"))
        base = cut.join(context, "context").withColumn("gamma", F.col("left") / F.col("all"))
        direct = (F.col("n") - F.col("d")) / F.col("all")
        if k == 1:
            out = base.select("code", (direct + F.col("gamma") / SYMBOLS).alias("p"))
        else:
            short = probs[k - 1].select(F.col("code").alias("low"), F.col("p").alias("under"))
            out = base.join(short, _low(F.col("code"), k - 1) == F.col("low")).select("code", (direct + F.col("gamma") * F.col("under")).alias("p"))
        probs[k] = cut_lineage(out)
        gammas[k] = cut_lineage(context.select("context", (F.col("left") / F.col("all")).alias("gamma")))
    return probs, gammas


def costs_of(codes: DataFrame, probs: dict[int, DataFrame], gammas: dict[int, DataFrame]) -> DataFrame:
    """(code, cost): -log p of these different n-grams, also of those that the model has not seen.

    An n-gram not seen takes the probability of its last bytes, times what its context
    leaves to them, or all of it if the context was not seen either. Levels below the
    highest are written one by one: a plan of all of them takes much of the driver's memory.
    """
    levels = {ORDER: codes}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = cut_lineage(levels[k + 1].select(_low(F.col("code"), k).alias("code")).distinct())
    lower = None
    for k in range(1, ORDER + 1):
        rows = levels[k].withColumn("context", F.shiftright("code", BITS)).join(probs[k], "code", "left").join(gammas[k], "context", "left")
        under = F.lit(1.0 / SYMBOLS)
        if lower is not None:
            rows = rows.withColumn("low", _low(F.col("code"), k - 1)).join(lower.select(F.col("code").alias("low"), F.col("p").alias("under")), "low")
            under = F.col("under")
        lower = rows.select("code", F.coalesce("p", F.coalesce("gamma", F.lit(1.0)) * under).alias("p"))
        if k < ORDER:
            lower = cut_lineage(lower)
    return lower.select("code", (-F.log(F.greatest("p", F.lit(1e-12)))).alias("cost"))


def with_perplexity(docs: DataFrame, key: str, text: str, keep: list[str], probs: dict[int, DataFrame], gammas: dict[int, DataFrame]) -> DataFrame:
    """The columns ``keep`` with ``chars``, ``_bytes`` and ``nll``, the summed -log p of the whole text (null text: 0, 0 and 0).

    A block is a hash of id and text, so groups of equal ids or of equal texts are dealt
    out. A block over twice its share all the same (rows equal in both) is dealt out
    further by chance, and each part gets the block's costs.
    """
    spark, body = docs.sparkSession, F.col(f"`{text}`")
    size = F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + ROW
    blocks = -(-(docs.agg(F.sum(size)).first()[0] or 1) // BLOCK)
    block = F.pmod(F.xxhash64(f"`{key}`", f"`{text}`"), F.lit(blocks))
    # At most one row for each two shares of the whole input, and none where rows differ.
    large = docs.select(block.alias("_block"), size.alias("_size")).groupBy("_block").agg(F.sum("_size").alias("_size"))
    large = [(r[0], -(-r[1] // BLOCK)) for r in large.where(F.col("_size") > 2 * BLOCK).collect()]
    dealt = docs.select(block.alias("_block"), *[F.col(f"`{c}`") for c in dict.fromkeys([*keep, key, text])]).withColumn("_part", F.lit(0).cast("long"))
    if large:
        ways = spark.createDataFrame(large, "_block long, _ways long")
        dealt = dealt.drop("_part").join(ways, "_block", "left").withColumn(
            "_part", F.floor(F.rand(7) * F.coalesce("_ways", F.lit(1)))).drop("_ways")

    def grams(key: tuple, rows: pa.Table) -> pa.Table:
        found = _different(code for _, _, code in coded(_texts(rows.column(text))))
        return pa.table({"_block": pa.array(np.full(len(found), key[0].as_py(), np.int64)), "code": pa.array(found)})

    pairs = dealt.where(F.octet_length(body) > 0).select("_block", "_part", f"`{text}`").groupBy("_block", "_part").applyInArrow(
        grams, "_block long, code long")
    with small_batches(spark):
        pairs = cut_lineage(pairs.distinct() if large else pairs)
    costs = cut_lineage(costs_of(pairs.select("code").distinct(), probs, gammas))
    sent = pairs.join(costs, "code").withColumn("_part", F.lit(0).cast("long"))
    if large:
        sent = sent.drop("_part").join(ways, "_block", "left").withColumn(
            "_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_ways", F.lit(1)) - 1)))
    sent = sent.select("_block", "_part", "code", F.col("cost").cast("float").alias("cost"))
    kept = [c for c in dealt.columns if c in {*keep, key}]
    schema = StructType([*[dealt.schema[c] for c in kept], StructField("chars", LongType()), StructField("_bytes", LongType()), StructField("nll", DoubleType())])

    def score(rows: pa.Table, known: pa.Table) -> pa.Table:
        codes, cost = known.column("code").to_numpy(), known.column("cost").to_numpy()
        order = np.argsort(codes)
        codes, cost = codes[order], cost[order]
        del order
        n_bytes, nll = np.zeros(len(rows), np.int64), np.zeros(len(rows))
        for owners, sizes, code in coded(_texts(rows.column(text))):
            sums = np.add.reduceat(cost[np.searchsorted(codes, code)], np.cumsum(sizes) - sizes, dtype=np.float64)
            np.add.at(n_bytes, owners, sizes)
            np.add.at(nll, owners, sums)
        chars = pc.fill_null(pc.utf8_length(rows.column(text)), 0).cast(pa.int64())
        return rows.select(kept).append_column("chars", chars).append_column("_bytes", pa.array(n_bytes)).append_column("nll", pa.array(nll))

    by = ("_block", "_part")
    return dealt.groupBy(*by).cogroup(sent.groupBy(*by)).applyInArrow(score, schema)


def _quantiles(marked: DataFrame, value: Column, share: float, name: str) -> DataFrame:
    """(lang_, name): what ``share`` of a language's held-out documents don't exceed, in steps; of all its rows, if fewer than LEAST are held out."""
    counted = marked.groupBy("lang_", "_held", F.floor(value / STEP).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy("lang_")
    held = F.sum(F.when(F.col("_held"), F.col("n")).otherwise(0)).over(over)
    counted = counted.withColumn("_seen", held).where(F.col("_held") | (F.col("_seen") < LEAST)).groupBy("lang_", "bin").agg(F.sum("n").alias("n"))
    counted = counted.withColumn("share", F.sum("n").over(over.orderBy("bin")) / F.sum("n").over(over))
    return counted.groupBy("lang_").agg(F.min(F.when(F.col("share") >= share, (F.col("bin") + 1) * STEP)).alias(name))


def quality(
    docs: DataFrame, trusted: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", keep: list[str] | None = None,
    quantile: float = 0.99, slack: float = 0.5, prior: int = 40,
) -> DataFrame:
    """The columns ``keep`` (all, by default) of ``docs`` with ``chars``, ``perplexity``, ``limit`` and ``kept``.

    ``trusted`` has in its column ``key`` the ids of the documents to learn from, all of them:
    four fifths by a hash of the id make the model, and the rest, which it has not seen,
    set the limits. A document's perplexity is that of the bytes of its whole text, pulled to its
    language's middle as if ``prior`` bytes more had been seen, so that a short text is
    judged by what it shows. The limit of a language is the given quantile over its
    held-out trusted documents so pulled (over all trusted ones, if fewer than LEAST are held
    out), in log perplexity, plus ``slack`` times its distance from the median; a language without trusted documents, and null, takes the limit over all.

    A null or empty text has the language's median, and is kept. With no trusted document
    at all, the limit is null and everything is kept. Repeated rows are judged alike, and
    count as often as they occur; a null id is not trusted. Columns called chars,
    perplexity, limit or kept are replaced.
    """
    docs, names = set_aside(docs.drop("chars", "perplexity", "limit", "kept"), also=("nll", "lang_", "bin", "n", "share"))
    trusted = trusted.withColumnRenamed(key, names.get(key, key))
    key, text, lang = (names.get(c, c) for c in (key, text, lang))
    keep = [names.get(c, c) for c in keep] if keep else docs.columns
    keep = [c for c in keep if c in docs.columns]
    ids = trusted.select(F.col(f"`{key}`").alias("_id")).distinct().withColumn("_held", F.pmod(F.xxhash64("_id"), F.lit(FOLDS)) == 0)
    learn = ids.where("not _held").hint("merge")
    texts = docs.select(f"`{key}`", f"`{text}`").where(F.octet_length(F.col(f"`{text}`")) > 0).join(
        learn, F.col(f"`{key}`") == F.col("_id"), "left_semi").select(f"`{text}`")
    with small_batches(docs.sparkSession):
        counts = cut_lineage(count_ngrams(texts))
    probs, gammas = kneser_ney(counts)
    scored = with_perplexity(docs, key, text, [*keep, lang], probs, gammas)
    with small_batches(docs.sparkSession):
        scored = cut_lineage(scored)
    tongue = F.coalesce(F.col(f"`{lang}`"), F.lit(""))
    marked = cut_lineage(scored.select(F.col(f"`{key}`").alias("_key"), tongue.alias("lang_"), "_bytes", "nll").where("_bytes > 0").join(
        ids.hint("merge"), F.col("_key") == F.col("_id")).select("lang_", "_held", "_bytes", "nll"))
    # The null language stands for all.
    marked = marked.unionByName(marked.withColumn("lang_", F.lit(None).cast("string")))
    middles = cut_lineage(_quantiles(marked, F.col("nll") / F.col("_bytes"), 0.5, "_middle"))
    same = F.col("lang_").eqNullSafe(F.col("_of"))
    pulled = marked.join(middles.withColumnRenamed("lang_", "_of"), same)
    highs = _quantiles(pulled, (F.col("nll") + prior * F.col("_middle")) / (F.col("_bytes") + prior), quantile, "_high")
    limits = cut_lineage(middles.join(highs.withColumnRenamed("lang_", "_of"), same).select(
        "lang_", "_middle", (F.col("_high") + slack * (F.col("_high") - F.col("_middle"))).alias("_limit")))
    overall = limits.where("lang_ is null").select("_middle", "_limit").first() or (None, None)
    named = limits.where("lang_ is not null").select(F.col("lang_"), "_middle", "_limit")
    out = scored.join(named, tongue == F.col("lang_"), "left")
    middle, limit = (F.coalesce(F.col(c), F.lit(x).cast("double")) for c, x in zip(("_middle", "_limit"), overall, strict=True))
    level = (F.col("nll") + prior * middle) / (F.col("_bytes") + prior)
    return put_back(out.select(*[F.col(f"`{c}`") for c in keep], "chars", F.exp(level).alias("perplexity"), F.exp(limit).alias("limit"),
                               F.coalesce(level <= limit, F.lit(True)).alias("kept")), names)
