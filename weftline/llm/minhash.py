"""MinHash near-duplicates: banded candidates, pruned batch by batch by their posterior, verified exactly.

Rows with the same set of shingles are one node from the start, whatever their number.
Nodes that share a band are compared signature batch by signature batch; a pair goes as
soon as, after the batches seen, the chance that it is similar enough is below ``miss``.
What is left links nodes to families, and within a family every pair that isn't ruled out
by size is confirmed on full shingle sets. Large buckets and families are cut into blocks,
and pairs of blocks are compared where both meet; each such meeting passes on a spanning
forest of its links, so that nothing grows with the square of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import WordHashes, components, forest, hashes_of, mixed, partitions, put_back, runs_of, set_aside, whole_groups, words_of
from weftline.session import cut_lineage, small_batches

BANDS, ROWS, BATCH = 20, 4, 16
HASHES = BANDS * ROWS
#: Members of a bucket or family that are compared in one place.
BLOCK = 512


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 63, HASHES, np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, HASHES, np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of each of HASHES hash functions over a set of 64-bit numbers."""
    least = np.full(HASHES, np.uint32(0xFFFFFFFF), np.uint32)
    for at in range(0, len(shingles), 2048):
        part = (a[:, None] * shingles[None, at:at + 2048] + b[:, None]) >> np.uint64(32)
        least = np.minimum(least, part.min(axis=1).astype(np.uint32))
    return least


def needed(threshold: float, miss: float) -> list[int]:
    """For each number of batches seen, the least number of equal hashes that keeps a pair.

    The similarity is taken as uniform beforehand, so after m of n equal hashes it has a
    Beta(m + 1, n - m + 1) distribution; a pair goes once its chance to reach the threshold
    is below ``miss``. That chance is the binomial sum of up to m successes in n + 1 trials.
    Signatures keep eight bits a hash: unequal minima look equal once in 256, which only
    keeps pairs.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, 0
        while m <= n:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append(m)
    return out


def with_signatures(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """``docs`` with the set's size, its 128-bit name, eight bits of each minimum, and band keys."""
    @F.pandas_udf("struct<n_shingles: long, set: string, sig: binary, bands: array<long>>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, (a, b) = WordHashes(), _multipliers()
        for batch in batches:
            rows = []
            for text in batch:
                words = words_of(text) if text else []
                if not words:
                    rows.append((0, None, None, None))
                    continue
                shingles = np.unique(runs_of(hashes_of(words, known), shingle))
                least = signature(shingles, a, b)
                keys = mixed(least.reshape(BANDS, ROWS).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                             + np.arange(ROWS, dtype=np.uint64))
                band = mixed(keys.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                rows.append((len(shingles), xxhash.xxh3_128_hexdigest(shingles.tobytes()), least.astype(np.uint8).tobytes(), band))
            yield pd.DataFrame(rows, columns=["n_shingles", "set", "sig", "bands"])

    return docs.withColumn("_s", sign(F.col(f"`{text}`"))).select(
        *docs.columns, F.col("_s.n_shingles"), F.col("_s.set").alias("_set"), F.col("_s.sig").alias("_sig"), F.col("_s.bands").alias("_bands"))


def blocks(df: DataFrame, keys: list[str], size: str, node: str) -> DataFrame:
    """Each row once for every meeting of its block with a block of its group; ``_side`` tells which.

    A group of up to BLOCK rows has one meeting. A larger one is cut into k blocks by a
    hash of the node, and block i meets every block j: meetings (i, j) with i <= j.
    """
    df = df.withColumn("_k", F.ceil(F.col(size) / BLOCK).cast("int"))
    df = df.withColumn("_mine", F.pmod(F.xxhash64(node, F.lit(7)), F.col("_k")).cast("int"))
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return df.withColumn("_meet", F.least("_mine", "_other") * 65536 + F.greatest("_mine", "_other")).withColumn(
        "_side", (F.col("_mine") > F.col("_other")).cast("int")).drop("_k", "_mine", "_other")


def _pairs_within(group: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places with the same group number, in blocks; equal numbers are adjacent."""
    n = len(group)
    ends = np.searchsorted(group, group, "right")
    left, right, held = [], [], 0
    for step in range(1, n):
        at = np.flatnonzero(np.arange(n) + step < ends)
        if not len(at):
            break
        left.append(at)
        right.append(at + step)
        held += len(at)
        if held >= limit:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def candidates(nodes: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Links (a, b) between nodes that share a band and are not ruled out by their signatures."""
    bands = nodes.select("_set", F.posexplode("_bands").alias("band", "key"))
    shared = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    met = blocks(bands.join(shared, ["band", "key"]), ["band", "key"], "_size", "_set")
    met = met.join(nodes.select("_set", "_sig", "n_shingles"), "_set")
    met = met.withColumn("_group", F.xxhash64("band", "key", "_meet")).select("_group", "_set", "_sig", "n_shingles")
    must = needed(threshold, miss)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_groups(batches, ["_group"]):
            sig = np.frombuffer(b"".join(rows["_sig"]), np.uint8).reshape(len(rows), HASHES)
            size = rows["n_shingles"].to_numpy().astype(np.float64)
            names = rows["_set"].to_numpy()
            for a, b in _pairs_within(pd.factorize(rows["_group"])[0]):
                # A set can't reach the threshold with one that is much larger.
                live = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
                a, b = a[live], b[live]
                equal = np.zeros(len(a), np.int32)
                for k, least in enumerate(must):
                    part = slice(k * BATCH, (k + 1) * BATCH)
                    equal += (sig[a, part] == sig[b, part]).sum(axis=1, dtype=np.int32)
                    live = equal >= least
                    a, b, equal = a[live], b[live], equal[live]
                used = forest(a, b, len(rows))
                if used:
                    yield pd.DataFrame({"a": names[a[used]], "b": names[b[used]]})

    return met.repartition(partitions(met.sparkSession), "_group").sortWithinPartitions("_group").mapInPandas(compare, "a string, b string").distinct()


def verified(nodes: DataFrame, families: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) of members of a family whose full shingle sets are similar enough."""
    sizes = families.groupBy("root").agg(F.count(F.lit(1)).alias("_size"))
    members = nodes.select("_set", "n_shingles", "_text").join(
        families.join(sizes, "root").select(F.col("node").alias("_set"), "root", "_size"), "_set")
    met = blocks(members, ["root"], "_size", "_set")
    met = met.withColumn("_group", F.xxhash64("root", "_meet")).select("_group", "_set", "n_shingles", "_side", "_text", (F.col("_size") > BLOCK).alias("_cut"))

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for rows in whole_groups(batches, ["_group"]):
            for _, group in rows.groupby("_group", sort=False):
                group = group.drop_duplicates("_set")
                names, n = group["_set"].to_numpy(), len(group)
                sets = [np.unique(runs_of(hashes_of(words_of(t), known), shingle)) for t in group["_text"]]
                size = np.array([len(s) for s in sets])
                used = _links(sets, size, percent)
                if used:
                    a, b = map(list, zip(*used, strict=True))
                    yield pd.DataFrame({"a": names[a], "b": names[b]})

    return met.repartition(partitions(met.sparkSession), "_group").sortWithinPartitions("_group").mapInPandas(
        confirm, "a string, b string").distinct()


def _links(sets: list[np.ndarray], size: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with 100 |a & b| >= percent |a or b|.

    Shared shingles are counted by the sorted occurrences of all: a shingle is looked up
    once, and the counts of one set against all others are one sum over its rows.
    """
    n = len(sets)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    used = []
    for i in range(n - 1):
        if n > 2 and all(root(j) == root(i) for j in range(i + 1, n)):
            continue
        low, high = np.searchsorted(every, sets[i], "left"), np.searchsorted(every, sets[i], "right")
        span = high - low
        places = np.repeat(low - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
        both = np.bincount(owner[places], minlength=n)
        near = np.flatnonzero(100 * both >= percent * (size[i] + size - both))
        for j in near[near > i].tolist():
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                used.append((i, j))
    return used


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 85, miss: float = 1e-7,
) -> DataFrame:
    """The rows of ``docs`` with ``n_shingles``, ``component_id`` and ``kept``.

    Documents are linked if 100 * |shared| >= percent * |all| over their distinct runs of
    ``shingle`` words; a component is what links reach, and ``component_id`` its smallest
    id. ``kept`` marks the row with that id. A pair at a similarity of s shares no band with chance
    (1 - s**ROWS)**BANDS (at 0.85 once in 2.6 million, at 0.8 once in 38,000) and is pruned by its signature
    with chance ``miss``; linked by others as well, it is lost more rarely still. No link that is reported is wrong.

    A null, empty or blank text has no shingles, links to nothing and is kept. Rows with a
    null id take part; their component takes the smallest id that isn't null, and is null
    (all rows kept) if there is none. Repeated rows are of one component and marked alike.
    Columns called n_shingles, component_id or kept are replaced.
    """
    docs, names = set_aside(docs)
    return put_back(_labelled(docs, names.get(doc_id, doc_id), names.get(text, text), shingle, percent, miss).drop("_first"), names)


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 85, miss: float = 1e-7) -> DataFrame:
    """One row of each component (one with its smallest id), and every row without shingles; ``docs``'s columns."""
    docs, names = set_aside(docs)
    labelled = _labelled(docs, names.get(doc_id, doc_id), names.get(text, text), shingle, percent, miss)
    return put_back(labelled.where("_first").select(*docs.columns), names)


def _labelled(docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int, miss: float) -> DataFrame:
    key = F.col(f"`{doc_id}`")
    rows = docs.drop(*({"n_shingles", "component_id", "kept"} - {doc_id, text}))
    with small_batches(docs.sparkSession):
        signed = cut_lineage(with_signatures(rows.withColumn("_row", F.monotonically_increasing_id()), text, shingle))
    nodes = signed.where("_set is not null").groupBy("_set").agg(
        F.min(F.struct(key.isNull().alias("none"), key.alias("id"), "_row")).alias("_least"),
        F.first("n_shingles").alias("n_shingles"), F.first("_sig").alias("_sig"), F.first("_bands").alias("_bands"))
    nodes = cut_lineage(nodes)
    with small_batches(docs.sparkSession):
        families = components(candidates(nodes, percent / 100, miss))
    # One text for each node of a family; dealt out alike whatever the size of either side.
    texts = signed.join(families.select(F.col("node").alias("_set")).hint("merge"), "_set", "left_semi").groupBy("_set").agg(
        F.first(F.col(f"`{text}`")).alias("_text"), F.first("n_shingles").alias("n_shingles"))
    with small_batches(docs.sparkSession):
        found = components(verified(texts, families, shingle, percent))
    labels = found.join(nodes.select(F.col("_set").alias("node"), "_least"), "node")
    least = labels.groupBy("root").agg(F.min("_least").alias("_label"))
    named = labels.select("node", "root").join(least, "root").select(F.col("node").alias("_set"), "_label")
    own = nodes.select("_set", "_least").join(named, "_set", "left").select("_set", F.coalesce("_label", "_least").alias("_label"))
    out = signed.join(own, "_set", "left")
    out = out.withColumn("component_id", F.when(F.col("_set").isNull(), key).otherwise(F.col("_label.id")))
    out = out.withColumn("kept", key.eqNullSafe(F.col("component_id")))
    out = out.withColumn("_first", F.col("_set").isNull() | (F.col("_row") == F.col("_label._row")))
    return out.drop("_set", "_sig", "_bands", "_row", "_label")
