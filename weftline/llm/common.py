"""What several operators share: global positions, connected components, text hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.session import cut_counted, cut_lineage


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def set_aside(df: DataFrame, also: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with names for its columns that no operator uses itself, and those names.

    Operators name what they add for themselves with a leading underscore, or as ``also`` says.
    """
    taken, names = {c.lower() for c in df.columns}, {}
    for c in df.columns:
        if c.startswith("_") or c.lower() in also:
            new = f"aside{len(names)}"
            while new in taken:
                new = f"x{new}"
            taken.add(new)
            names[c] = new
    return df.withColumnsRenamed(names) if names else df, names


def put_back(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns by the names they had before :func:`set_aside`."""
    return df.withColumnsRenamed({new: old for old, new in names.items()}) if names else df


def with_positions(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """All rows with their place 0, 1, 2, ... in the given order, and how many there are.

    Rows are dealt into ranges, sorted there and written once, so that the places cannot
    change when a task runs again; only the ranges' row counts (one number per
    partition) are summed in one place. Equal rows are told apart by where they were
    read, so no range has to hold a large group of them.
    """
    spark = df.sparkSession
    tie = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tie.repartitionByRange(partitions(spark), *order, F.col("_tie"))
    placed = ranged.sortWithinPartitions(*order, F.col("_tie")).withColumn("_at", F.monotonically_increasing_id())
    kept, rows = cut_counted(placed.drop("_tie"))
    part = F.shiftright("_at", 33)
    counts = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    # One row per partition of the step above: bounded by the number of partitions.
    out = kept.withColumn("_part", part).join(F.broadcast(starts), "_part")
    index = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn(name, F.col("_start") + index).drop("_at", "_part", "_start"), rows


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node reachable.

    Each round links every node to the least neighbour it knows, then that neighbour's
    neighbours likewise (alternating large and small stars), until no link changes.
    Rounds are written to the shared folder. Links are pre-aggregated by node, so a node
    with many neighbours is a partial minimum and rows, never a list.
    """
    links, _ = cut_counted(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        # Large star: every greater neighbour of a node goes to the least of all its neighbours.
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        # Small star: a node and its lesser neighbours go to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))).distinct()
        links, rows = cut_counted(small)
        mark = (rows, links.agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()[0])
        if mark == seen:
            break
        seen = mark
    roots = links.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    own = roots.select(F.col("root").alias("node"), "root").distinct()
    return cut_lineage(roots.unionByName(own))


class WordHashes(dict):
    """64-bit hashes of words, remembered while there is room."""

    most = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str) -> list[bytes]:
    """The words of a text, A-Z in lower case; only ASCII white space parts words."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def hashes_of(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def runs_of(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        out = mixed(out + words[i:len(words) - size + 1 + i] + np.uint64(i + 1))
    return out


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of sorted rows, cut so that no group of equal keys is in two of them."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        same = np.ones(len(batch), bool)
        for key in keys:
            same &= (batch[key] == batch[key].iloc[-1]).to_numpy()
        cut = len(batch) - int(np.argmin(same[::-1])) if not same.all() else 0
        rest = batch.iloc[cut:]
        if cut:
            yield batch.iloc[:cut].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Places of links (a, b) among nodes 0..n-1 that suffice to connect what all links connect."""
    parent, used = list(range(n)), []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
            used.append(k)
    return used
