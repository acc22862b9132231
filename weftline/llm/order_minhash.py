"""Document fingerprints: order MinHash over runs of tokens, in DataFrame functions only.

A text's tokens are stretches of up to TOKEN characters that aren't white space; each run
of RUN tokens gets a number, which occurrence of that run it is. Of the numbered runs, the
minimal ones by hash are kept for each of TUPLES tuples, put in text order and hashed
together, so that a tuple agrees only if the same runs come in the same order. Within a
tuple each member is the least of its own class of hashes, so one hash per run serves all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import partitions, with_positions
from weftline.session import cut_lineage

RUN, TOKEN, TUPLES = 3, 16, 64
#: Numbers that are put in order together to find each row's successor, and how many of the next such block with them.
BLOCK, MARGIN = 64, 4


def numbered_runs(text: Column) -> Column:
    """A hash of every run of tokens, in text order; of all tokens if there are fewer than RUN."""
    tokens = F.regexp_extract_all(text, F.lit(r"\S{1,%d}" % TOKEN), F.lit(0))
    runs = lambda t: F.when(F.size(t) > 0, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(t) - RUN + 1, F.lit(1))),
        lambda i: F.xxhash64(*[F.try_element_at(t, i + j) for j in range(RUN)])))
    # The one-element array keeps the tokens from being taken apart once for each use.
    return F.element_at(F.transform(F.array(tokens), runs), 1)


def fingerprints(texts: DataFrame, keys: list[str], text: str, note: str | None = None) -> DataFrame:
    """(keys, ``parts``): the texts' tuples as strings of tuple number and hash, sorted.

    No parts for a null, empty or blank text. Equal texts have equal parts. Rows are
    grouped by ``keys``, which must name them; no row leaves its partition if the data is
    already dealt by one of the keys. The column ``note`` is passed on.
    """
    note = F.col(note) if note else F.lit(None).cast("string")
    runs = texts.select(*keys, note.alias("_note"), F.posexplode_outer(numbered_runs(F.col(text))).alias("_at", "_run"))
    # One run of each text carries the note.
    runs = runs.withColumn("_note", F.when(F.coalesce("_at", F.lit(0)) == 0, F.col("_note")))
    same = Window.partitionBy(*keys, "_run").orderBy("_at")
    hashed = runs.withColumn("_hash", F.when(F.col("_run").isNotNull(), F.xxhash64("_run", F.row_number().over(same))))
    hashed = hashed.withColumn("_tuple", F.pmod("_hash", F.lit(TUPLES)).cast("int"))
    first = F.when(F.pmod(F.call_function("div", F.col("_hash"), F.lit(TUPLES)), F.lit(2)) == 0, F.col("_hash"))
    other = F.when(first.isNull(), F.col("_hash"))
    least = hashed.groupBy(*keys, "_tuple").agg(
        F.min(first).alias("a"), F.min_by("_at", first).alias("at_a"), F.min(other).alias("b"), F.min_by("_at", other).alias("at_b"),
        F.max("_note").alias("_note"))
    # xxhash64 skips nulls, so a tuple with one member is the hash of that one.
    pair = F.when(F.col("at_b") < F.col("at_a"), F.xxhash64("b", "a")).otherwise(F.xxhash64("a", "b"))
    part = F.when(F.col("_tuple").isNotNull(), F.concat(
        F.lpad(F.hex(F.col("_tuple").cast("long")), 2, "0"), F.lpad(F.hex(pair.bitwiseAND(F.lit(0xFFFF))), 4, "0")))
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list(part)).alias("parts"), F.max("_note").alias("note"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal tuples among those that either text has; 1 if neither has any."""
    number = lambda x: F.transform(x, lambda p: F.substring(p, 1, 2))
    either = F.size(a) + F.size(b) - F.size(F.array_intersect(number(a), number(b)))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def _spots_by_id(ids: DataFrame) -> tuple[int, int] | None:
    """The greatest and least id, if ids are unique and close enough to be dealt out by themselves.

    Ids count down from the greatest; those of a block of BLOCK numbers go to one place, with the
    first MARGIN numbers of the next block. That finds every successor if each block but
    the last is followed by one with an id among those numbers. Only ids are read.
    """
    one = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    low, high, most, rows = one.agg(F.min("doc_id"), F.max("doc_id"), F.max("n"), F.count_if(F.col("doc_id").isNull())).first()
    if low is None or most > 1 or rows or not isinstance(low, int) or high - low >= 1 << 62:
        return None
    spot = F.lit(high).cast("long") - F.col("doc_id")
    first = one.groupBy(F.call_function("div", spot, F.lit(BLOCK)).alias("block")).agg(F.min(spot % BLOCK).alias("first"))
    follows = first.select((F.col("block") - 1).alias("block"), F.col("first").alias("next"))
    last = (high - low) // BLOCK
    gaps = first.where(F.col("block") != last).join(follows, "block", "left").where(F.coalesce("next", F.lit(BLOCK)) >= MARGIN)
    return (high, low) if gaps.limit(1).count() == 0 else None


def edited_fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all documents and of the same with their last half overwritten.

    The edited text has its last floor(n_chars / 2) characters replaced by the first as
    many (or all) of the next document, by descending id; after the last comes the first.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.

    A null text is an empty one, with an empty fingerprint; two empty ones are alike (1.0).
    Rows with equal ids and different texts follow each other by a hash of the text; rows
    equal in both are one document, and each gets its result. Null ids come last. A single
    document is its own next one. Other columns are ignored.

    Texts are dealt out once if ids are whole numbers without large gaps (order follows from
    the id itself), and twice otherwise (a place is numbered for each id, and joined).
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    ends = _spots_by_id(rows.select("doc_id"))
    if ends is not None:
        high, low = ends
        sited = rows.select((F.lit(high).cast("long") - F.col("doc_id")).alias("_place"), "text")
        total = high - low + 1
    else:
        named = rows.withColumn("_hash", F.xxhash64("text")).withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
        named = named.withColumn("_none", F.col("doc_id").isNull())
        by = ["_none", "_id", "_hash"]
        known = named.groupBy("doc_id", *by).agg(F.count(F.lit(1)).alias("_times"))
        placed, total = with_positions(known, [F.col("doc_id").desc_nulls_last(), F.col("_hash")], "_place")
        sited = named.dropDuplicates(by).join(placed.select(*by, "_place", "_times"), by).select("_place", "text")
    # Each block also gets the first rows of the next one; the last gets the very first, once more.
    block = F.call_function("div", F.col("_place"), F.lit(BLOCK))
    spots = F.array(F.struct(block.alias("block"), F.col("_place").alias("spot"), F.lit(True).alias("own")))
    extra = lambda b, s: F.array(F.struct(b.cast("long").alias("block"), s.cast("long").alias("spot"), F.lit(False).alias("own")))
    none = F.array().cast("array<struct<block:bigint,spot:bigint,own:boolean>>")
    spots = F.concat(
        spots, F.when((F.col("_place") % BLOCK < MARGIN) & (F.col("_place") >= BLOCK), extra(block - 1, F.col("_place"))).otherwise(none),
        F.when(F.col("_place") == 0, extra(F.lit((total - 1) // BLOCK), F.lit(total))).otherwise(none))
    both = sited.select(F.explode(spots).alias("_s"), "text").select(
        F.col("_s.block").alias("_block"), F.col("_s.spot").alias("_spot"), F.col("_s.own").alias("_own"), "text")
    order = Window.partitionBy("_block").orderBy("_spot")
    # A text's runs take many times its own room while they are sorted: small partitions.
    dealt = both.repartition(4 * partitions(docs.sparkSession), "_block").withColumn("_next", F.lead("text").over(order)).withColumn(
        "_after", F.lead("_spot").over(order) % F.lit(max(total, 1))).where("_own")
    dealt = dealt.withColumn("_edited", F.expr("concat(left(text, length(text) - length(text) div 2), left(_next, length(text) div 2))"))
    note = F.concat_ws(" ", F.sha2("_edited", 256), F.length("text").cast("string"), F.col("_after").cast("string"))
    variants = dealt.select("_block", "_spot", note.alias("_note"), F.posexplode(F.array("text", "_edited")).alias("_variant", "text"))
    variants = variants.select("_block", (F.col("_spot") * 2 + F.col("_variant")).alias("_key"), "text",
                               F.when(F.col("_variant") == 0, F.col("_note")).alias("_note"))
    parts = fingerprints(variants, ["_block", "_key"], "text", "_note").withColumn("_spot", F.shiftright("_key", 1))
    of = lambda v: F.max(F.when(F.col("_key") % 2 == v, F.col("parts")))
    kept = parts.groupBy("_block", "_spot").agg(of(0).alias("own"), of(1).alias("edited"), F.split(F.max("note"), " ").alias("note"))
    kept = cut_lineage(kept.select("_spot", "own", "edited", F.col("note")[0].alias("edited_sha256"), F.col("note")[1].cast("long").alias("n_chars"),
                                   F.col("note")[2].cast("long").alias("_after")))
    out = kept.join(kept.select(F.col("_spot").alias("_after"), F.col("own").alias("next")), "_after")
    if ends is not None:
        out = out.withColumn("doc_id", (F.lit(high).cast("long") - F.col("_spot")).cast(rows.schema["doc_id"].dataType))
    else:
        out = out.join(placed.select(F.col("_place").alias("_spot"), "doc_id", "_times"), "_spot")
        out = out.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "_times")))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("own", "").alias("fingerprint"), F.array_join("edited", "").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))
