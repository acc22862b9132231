"""Benchmark decontamination: rare word n-grams find the passages, local alignment scores them.

A seed is three words of an item: adjacent ones, or two, a gap of one word, and the third.
The gapped ones meet a text whose words were changed at regular places: no text that keeps
two thirds of an item's words in place can avoid both kinds for long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import WordHashes, hashes_of, mixed, words_of
from weftline.session import cut_counted, cut_lineage, small_batches

#: Words in a seed; their places without and with a gap.
SEED, ADJACENT, GAPPED = 3, (0, 1, 2), (0, 1, 3)
#: Places of the bitmap that goes to all tasks: so many for each seed, within these bounds (0.5 to 32 MB).
BITS_PER_SEED, LEAST_BITS, MOST_BITS = 1024, 1 << 22, 1 << 28
#: A seed is rare if not in more places than so many times its item's median seed, plus some.
TIMES, PLUS = 8, 16
#: A text with this share of an item's seeds is always aligned with it, however frequent those are.
ALWAYS = 0.125
MATCH, MISMATCH, GAP = 2, -1, -1


def grams_of(words: np.ndarray) -> list[np.ndarray]:
    """A hash of the three words of the adjacent and of the gapped seed at each place of a text's word hashes.

    The gap is no part of it, so an adjacent seed also meets a text that has a word put in, or left out.
    """
    kinds = []
    for places in ADJACENT, GAPPED:
        n = max(0, len(words) - places[-1])
        grams = np.zeros(n, np.uint64)
        for i, place in enumerate(places):
            grams = mixed(grams + words[place:place + n] + np.uint64(i + 1))
        kinds.append(grams)
    return kinds


def _bitmap(grams: DataFrame, seeds: int) -> tuple[np.ndarray, int]:
    """One bit for each place that a gram falls on, and the number of places."""
    count = LEAST_BITS
    while count < min(seeds * BITS_PER_SEED, MOST_BITS):
        count *= 2
    byte = F.pmod(F.shiftrightunsigned("gram", 20), F.lit(count))
    # A row for each byte that has a bit, MOST_BITS / 8 at most.
    bits = grams.select(F.shiftright(byte, 3).cast("int").alias("at"), F.call_function("shiftleft", F.lit(1), byte.bitwiseAND(F.lit(7)).cast("int")).alias("bit"))
    rows = bits.groupBy("at").agg(F.bit_or("bit").alias("bit")).toPandas()
    out = np.zeros(count // 8, np.uint8)
    out[rows["at"].to_numpy()] = rows["bit"].to_numpy()
    return out, count


def _seeds(items: DataFrame) -> DataFrame:
    """(item_id, words, seeds) of every item with at least SEED words; seeds are (j, gram)."""
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"], batch["text"], strict=True):
                words = hashes_of(words_of(text or ""), known)
                if len(words) >= SEED:
                    both = grams_of(words)
                    rows.append((item, words.astype(np.uint32).tobytes(), np.concatenate([np.arange(len(g)) for g in both]).astype(np.int32),
                                 np.concatenate(both).view(np.int64)))
            yield pd.DataFrame(rows, columns=["item_id", "words", "js", "grams"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.mapInPandas(split, f"item_id {kind}, words binary, js array<int>, grams array<long>")


def _hits(texts: DataFrame, bits: np.ndarray, count: int) -> DataFrame:
    """(text_key, words, stretches) of texts with grams on the bitmap.

    A stretch is a run of places whose seeds of one kind are all on it: where it starts, its two 64-bit names, and its grams.
    """
    sent = texts.sparkSession.sparkContext.broadcast(bits)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, bits = WordHashes(), sent.value
        for batch in batches:
            rows = []
            for key, text in zip(batch["text_key"], batch["text"], strict=True):
                hashes = hashes_of(words_of(text), known)
                stretches = []
                for grams in grams_of(hashes):
                    places = (grams >> np.uint64(20)) % np.uint64(count)
                    at = np.flatnonzero((bits[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1)
                    for run in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1) if len(at) else ():
                        held = grams[run[0]:run[-1] + 1]
                        name = xxhash.xxh3_128_digest(held.tobytes())
                        stretches.append((int(run[0]), int.from_bytes(name[:8], "big", signed=True), int.from_bytes(name[8:], "big", signed=True), held.view(np.int64)))
                if stretches:
                    rows.append((key, hashes.astype(np.uint32).tobytes(), *map(list, zip(*stretches, strict=True))))
            yield pd.DataFrame(rows, columns=["text_key", "words", "at", "one", "two", "grams"])

    return texts.mapInPandas(find, "text_key string, words binary, at array<int>, one array<long>, two array<long>, grams array<array<long>>")


def _used(placed: DataFrame, spread: DataFrame) -> DataFrame:
    """(item_id, j, gram): the seeds that pick texts.

    All but the most frequent of an item, and of those only so few, and only ones that aren't rare,
    that a text with ALWAYS of the item's seeds has one of the others.
    """
    known = placed.join(spread, "gram")
    median = known.groupBy("item_id").agg(F.percentile("n", F.lit(0.5)).alias("middle"))
    sizes = placed.groupBy("item_id").agg(F.count(F.lit(1)).alias("_all"))
    ranked = known.withColumn("_rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("n"), "gram", "j")))
    return ranked.join(median, "item_id").join(sizes, "item_id").where(
        (F.col("n") <= TIMES * F.col("middle") + PLUS) | (F.col("_rank") >= F.ceil(F.col("_all") * ALWAYS))).select("item_id", "j", "gram")


def align(text: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """The best Smith-Waterman score of a stretch of the text with a stretch of the item, and where it ends."""
    above = np.zeros(len(text) + 1, np.int32)
    slope = np.arange(len(text) + 1, dtype=np.int32) * -GAP
    best, end = 0, 0
    for word in item:
        here = np.zeros(len(text) + 1, np.int32)
        here[1:] = np.maximum(np.maximum(above[:-1] + np.where(text == word, MATCH, MISMATCH), above[1:] + GAP), 0)
        # A gap in the item carries any cell on to the right, at GAP a word.
        here = np.maximum.accumulate(here + slope) - slope
        top = int(here.argmax())
        if here[top] > best:
            best, end = int(here[top]), top
        above = here
    return best, end


def text_key(text: Column) -> Column:
    """The name of a text, equal for equal texts."""
    return F.md5(text)


def leaking_texts(texts: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", threshold: float = 0.5) -> DataFrame:
    """(text_key, item_id, score, first_word, last_word) of the different texts that hold an item; see :func:`leaks`.

    Texts with seeds are kept once each, as word hashes with their stretches of seeds. Equal
    stretches, as of one passage in many texts, are looked up among the seeds once.
    """
    texts = texts.select(F.col(f"`{text}`").alias("text")).where("text is not null")
    items = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text"))
    seeds, _ = cut_counted(_seeds(items))
    placed, count = cut_counted(seeds.select("item_id", F.inline(F.arrays_zip(F.col("js").alias("j"), F.col("grams").alias("gram")))))
    found = _hits(texts.select(text_key(F.col("text")).alias("text_key"), "text"), *_bitmap(placed, count))
    with small_batches(texts.sparkSession):
        hits = cut_lineage(found.dropDuplicates(["text_key"]))
    stretches = hits.select("text_key", F.inline(F.arrays_zip("at", "one", "two", "grams")))
    different = stretches.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n"), F.first("grams").alias("grams"))
    different = cut_lineage(different.select("one", "two", "n", F.posexplode("grams").alias("i", "gram")).join(
        placed.select("gram").distinct(), "gram"))
    # How many places of all different texts hold each seed.
    spread = different.groupBy("gram").agg(F.sum("n").alias("n"))
    held = different.join(_used(placed, spread), "gram").groupBy("one", "two", "item_id").agg(
        F.min(F.col("i") - F.col("j")).alias("low"), F.max(F.col("i") - F.col("j")).alias("high"))
    # Written, so that a stretch or an item that very many texts have can be split in the joins.
    held = cut_lineage(held)
    pairs = stretches.drop("grams").join(held, ["one", "two"]).groupBy("text_key", "item_id").agg(
        F.min(F.col("at") + F.col("low")).alias("low"), F.max(F.col("at") + F.col("high")).alias("high"))
    pairs = cut_lineage(pairs)
    met = pairs.join(seeds.select("item_id", F.col("words").alias("item")), "item_id").join(hits.select("text_key", "words"), "text_key")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                words, item = np.frombuffer(row.words, np.uint32), np.frombuffer(row.item, np.uint32)
                begin = max(0, row.low - len(item) // 2 - SEED)
                part = words[begin:row.high + len(item) + len(item) // 2 + SEED]
                # Each word of the item gives MATCH at most, if the part has it.
                if np.isin(item, part).sum() < threshold * len(item):
                    continue
                best, end = align(part, item)
                if best < threshold * MATCH * len(item):
                    continue
                _, back = align(part[:end][::-1], item[::-1])
                out.append((row.text_key, row.item_id, best / (MATCH * len(item)), begin + end - back, begin + end - 1))
            yield pd.DataFrame(out, columns=["text_key", "item_id", "score", "first_word", "last_word"])

    kind = seeds.schema["item_id"].dataType.simpleString()
    scored = met.select("text_key", "item_id", "low", "high", "words", "item").mapInPandas(
        score, f"text_key string, item_id {kind}, score double, first_word long, last_word long")
    # Rows of one item_id and several texts are items of their own; the best stands.
    return scored.groupBy("text_key", "item_id").agg(F.max(F.struct("score", "first_word", "last_word")).alias("b")).select("text_key", "item_id", "b.*")


def leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", threshold: float = 0.5) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word, text_key) for documents that hold an item.

    Texts are words (A-Z in lower case). Seeds of the items are counted over all different
    texts; all but the most frequent ones of each item (against its own median, and so few
    that a text with an eighth of the item's seeds has another one) pick the texts and where
    to align, however many documents share them. A document holds an item if the
    alignment of the item with the words around its seeds scores at least ``threshold`` of
    the item's own score (2 a word; -1 for a word changed, added or left out).

    One row for each pair; a document row that repeats gives one. Null and empty texts, and
    items of fewer than three words, are in no pair. Rows with equal ids and different
    texts count on their own and the best score stands; a null id is kept as null. Other
    columns are ignored.
    """
    found = leaking_texts(docs, items, text=text, item_id=item_id, threshold=threshold)
    with small_batches(docs.sparkSession):
        bad = cut_lineage(found)
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_key(F.col(f"`{text}`")).alias("text_key")).join(bad, "text_key")
    best = named.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "first_word", "last_word", "text_key")).alias("b"))
    return best.select("doc_id", "item_id", "b.*")


def without_leaks(docs: DataFrame, items: DataFrame, *, text: str = "text", **more) -> DataFrame:
    """The documents that hold no item; null and empty texts stay, repeated rows go or stay alike.

    The columns are those of ``docs``, whatever their names.
    """
    found = leaking_texts(docs, items, text=text, **more).select(F.col("text_key").alias("_leak")).distinct()
    with small_batches(docs.sparkSession):
        bad = cut_lineage(found)
    return docs.join(bad, text_key(docs[f"`{text}`"]) == bad["_leak"], "left_anti")
