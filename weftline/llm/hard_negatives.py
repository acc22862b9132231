"""Hard-negative mining by slots of scores.

A positive's score is the upper limit of its window. The distinct limits of an anchor cut
scores into disjoint slots, each from one limit down to above the next. Every task keeps
the first k rows of each slot; merging the slots from a limit downwards gives the rows of
its window in order, so one pass over the scores serves all windows that overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import partitions
from weftline.session import cut_counted, cut_lineage

#: Rows that meet in one cell at most, on average: anchors, and rows searched. Anchors of one product of matrices.
ANCHORS, SEARCHED, TILE = 32_768, 65_536, 128
SCALE = 256


def usable(rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(row, vec_id, label, vector): rows that take part, their components as floor(SCALE * x).

    Left out: a null id, label or vector, and any null or non-finite component. Rows equal in all three are one.
    """
    real = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), real.alias("vector"))
    kept = kept.where("vec_id is not null and label is not null and vector is not null").where(~F.exists("vector", bad))
    kept = kept.withColumn("vector", F.transform("vector", lambda x: F.floor(x * SCALE).cast("long")))
    return kept.withColumn("row", F.xxhash64("vec_id", "label", "vector")).dropDuplicates(["row", "vec_id"])


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """One row a vector; a shorter one ends in zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: by floats while all sums are whole numbers there, else by whole numbers of 64 bits."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2 ** 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def _first(group: np.ndarray, score: np.ndarray, vec: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group: greater scores first, then lesser ids."""
    order = np.lexsort((row, vec, -score, group))
    sorted_ = group[order]
    starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(order) else np.array([], int)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < k]


def _cells(anchors: DataFrame, n: int, rows: DataFrame, m: int, score, schema: str) -> DataFrame:
    """``score(anchors, rows)`` over cells in which each of n anchors meets each of m rows once.

    Anchors are dealt into blocks and rows into others; a cell is one of each, of a size that does not
    grow with the tables. More rows give more cells.
    """
    high, wide = max(1, -(-n // ANCHORS)), max(partitions(rows.sparkSession), -(-m // SEARCHED))
    deal = lambda count: F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = anchors.withColumn("_high", deal(high)).withColumn("_wide", all_of(wide))
    right = rows.withColumn("_wide", deal(wide)).withColumn("_high", all_of(high))
    return left.groupBy("_high", "_wide").cogroup(right.groupBy("_high", "_wide")).applyInPandas(score, schema)


def _tiles(anchors: pd.DataFrame, rows: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    if not len(anchors) or not len(rows):
        return
    width = max(max(map(len, anchors["vector"])), max(map(len, rows["vector"])))
    searched = _matrix(rows["vector"], width)
    for at in range(0, len(anchors), TILE):
        tile = anchors.iloc[at:at + TILE]
        yield tile, _products(_matrix(tile["vector"], width), searched)


def _positives(k: int):
    """The first k other rows of the anchor's label in a cell."""
    def score(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        vec, row, label = (rows[c].to_numpy() for c in ("vec_id", "row", "label"))
        for tile, scores in _tiles(anchors, rows):
            fits = (label == tile["label"].to_numpy()[:, None]) & (row != tile["row"].to_numpy()[:, None])
            if scores.shape[1] > k:
                # Only scores as great as the k-th can be among the first k.
                masked = np.where(fits, scores, np.iinfo(np.int64).min)
                fits &= scores >= np.partition(masked, masked.shape[1] - k, axis=1)[:, -k][:, None]
            at, of = np.nonzero(fits)
            best = _first(at, scores[at, of], vec[of], row[of], k)
            at, of = at[best], of[best]
            out.append(pd.DataFrame({"row": tile["row"].to_numpy()[at], "anchor_id": tile["vec_id"].to_numpy()[at],
                                     "score": scores[at, of], "vec_id": vec[of], "other": row[of]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(
            {c: pd.Series(dtype="int64") for c in ("row", "anchor_id", "score", "vec_id", "other")})

    return score


def _slots(k: int, low: int):
    """The first k rows of another label in each slot of the anchor's limits, in a cell."""
    def score(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        vec, row, label = (rows[c].to_numpy() for c in ("vec_id", "row", "label"))
        for tile, scores in _tiles(anchors, rows):
            width = max(map(len, tile["limits"]))
            # Limits from the greatest down; missing ones repeat the last.
            limits = np.array([[*x, *[x[-1]] * (width - len(x))] for x in map(list, tile["limits"])], np.int64)
            least = limits.min(axis=1)
            fits = (label != tile["label"].to_numpy()[:, None]) & (scores <= limits[:, :1]) & (100 * scores >= low * least[:, None])
            at, of = np.nonzero(fits)
            found = scores[at, of]
            # The slot is that of the last limit that is not below the score.
            slot = (limits[at] >= found[:, None]).sum(axis=1) - 1
            best = _first(at * width + slot, found, vec[of], row[of], k)
            at, of = at[best], of[best]
            out.append(pd.DataFrame({"row": tile["row"].to_numpy()[at], "limit": limits[at, slot[best]],
                                     "score": scores[at, of], "vec_id": vec[of], "other": row[of]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(
            {c: pd.Series(dtype="int64") for c in ("row", "limit", "score", "vec_id", "other")})

    return score


def hard_negatives(rows: DataFrame, is_anchor: str, *, positives: int = 5, negatives: int = 5, low: int = 80) -> DataFrame:
    """For every anchor and positive, the first rows of another label whose score is near the positive's.

    ``rows`` as :func:`usable` gives them; ``is_anchor`` is a condition on them. A row's
    score is its inner product with the anchor; greater scores come first, then lesser ids.
    An anchor's positives are its first ``positives`` other rows of its label. A negative's score is at most the
    positive's and at least ``low`` hundredths of it, so a positive of a score below 0 has none. Returns anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score.

    Vectors of unequal lengths are multiplied as far as both go. Different rows of one id are rows
    of their own (in the order of a hash of their content), and each is an anchor if its id is one. An empty table,
    and one without anchors, gives no row.

    Every anchor meets every row: the work is the product of their numbers, in cells of bounded size.
    Scores never leave a cell; it hands on ``positives`` rows an anchor, then ``negatives`` rows a slot.
    """
    rows, m = cut_counted(rows)
    anchors, n = cut_counted(rows.where(is_anchor))
    found = _cells(anchors, n, rows, m, _positives(positives), "row long, anchor_id long, score long, vec_id long, other long")
    order = [F.desc("score"), F.col("vec_id"), F.col("other")]
    ranked = found.withColumn("_rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("_rank") <= positives)
    chosen = cut_lineage(ranked.select("row", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("other").alias("_positive"),
                                       F.col("score").alias("positive_score")))
    # A window below 0 is empty.
    limits = chosen.where("positive_score >= 0").groupBy("row").agg(
        F.sort_array(F.collect_set("positive_score"), asc=False).alias("limits"))
    limited, n = cut_counted(anchors.join(limits, "row"))
    slots = _cells(limited, n, rows, m, _slots(negatives, low), "row long, limit long, score long, vec_id long, other long")
    in_slot = Window.partitionBy("row", "limit").orderBy(*order)
    kept = cut_lineage(slots.withColumn("_rank", F.row_number().over(in_slot)).where(F.col("_rank") <= negatives).drop("_rank"))
    # The slots from each positive's limit downwards, at most ``negatives`` rows of each.
    merged = chosen.join(kept, "row").where((F.col("limit") <= F.col("positive_score")) & (100 * F.col("score") >= low * F.col("positive_score")))
    downwards = Window.partitionBy("row", "positive_id", "_positive").orderBy(*order)
    return merged.withColumn("rank", F.row_number().over(downwards)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
