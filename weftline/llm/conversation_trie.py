"""Conversation prefix trie by truncation peeling.

A conversation is the row of its turns' hashes. Rows are dealt and sorted by that row, so
the conversations below any node lie next to each other. Each range is peeled in one pass:
a path stays open while conversations share it; where the next one departs, the open path
is stripped turn by turn from its greatest depth, each node merging the conversations that
end there with what survived below it, and handing its sums to its parent. Only nodes on
the path of a range's first or last conversation can go on in another range. Those are
given up as pieces, regrouped over all ranges, and peeled once more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import partitions
from weftline.session import cut_lineage

#: Characters of a turn's hash in a path; ids in one piece of a long list of ended conversations.
STEP, PIECE = 32, 1024
NODE, PART, ENDS = 0, 1, 2
_SCHEMA = ("kind int, path long, depth long, node string, parent string, conv_id long, n_convs long, n_children long, "
           "n_leaves long, saved_tokens long, size long, at long, ended string")
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


def turn_rows(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as an array of (id, size).

    ``id`` is a hash of role and text, ``size`` the text's code points; texts themselves
    don't leave their task. Null roles and texts are empty. Turns come by number, null
    first; equal numbers by role, the text's first 64 characters and the hash. Repeated rows are turns of
    their own. Rows without a conv_id, which no conversation holds, are left out.
    """
    said, by = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(""))
    rows = turns.where(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.struct(
            F.col(f"`{turn}`").alias("turn"), by.alias("role"), F.left(said, F.lit(64)).alias("head"), F.md5(F.concat(F.length(by).cast("string"), F.lit(":"), by, said)).alias("id"),
            F.length(said).cast("long").alias("size")).alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns"))


def with_heads(rows: DataFrame, donor: Column, count: Column, most: int) -> DataFrame:
    """Conversations whose first ``count`` turns are those of the conversation ``donor``.

    All of the donor's turns if it has fewer, none if there is no such conversation; then
    the own turns after the first ``count``. ``most`` bounds ``count``.
    """
    heads = rows.select(F.col("conv_id").alias("_donor"), F.slice("turns", 1, most).alias("_head"))
    joined = rows.withColumn("_donor", donor).join(heads, "_donor", "left")
    none = F.array().cast(rows.schema["turns"].dataType)
    head = F.coalesce(F.slice("_head", F.lit(1), count), none)
    # Slicing by a length that may be 0, and from a place that may be behind the end.
    own = F.slice("turns", count + 1, F.greatest(F.size("turns"), F.lit(0)))
    return joined.select("conv_id", F.concat(head, own).alias("turns"))


class _Open:
    """A node on the open path, with the sums of what is known of its subtree."""

    __slots__ = ("children", "conv", "cut", "ended", "first", "leaves", "n", "name", "saved", "size")

    def __init__(self, name: str, size: int, first: bool):
        self.name, self.size, self.first, self.cut = name, size, first, 0
        self.n = self.children = self.leaves = self.saved = 0
        self.conv, self.ended = None, []

    def merge(self, below: _Open) -> None:
        self.n, self.leaves, self.saved = self.n + below.n, self.leaves + below.leaves, self.saved + below.saved
        self.conv = below.conv if self.conv is None else min(self.conv, below.conv)


def _name(above: str, turn: str) -> str:
    return hashlib.blake2b((above + turn).encode(), digest_size=16).hexdigest()


def _joined(ids: list[int]) -> str:
    return ",".join(map(str, ids))


class _Peel:
    """The open path of one range, stripped from its end as conversations depart from it."""

    def __init__(self, range_: int):
        self.range, self.path, self.rows = range_, "", []
        self.open = [_Open(_name("", ""), 0, True)]

    def _row(self, kind: int, path: int | None, depth: int, node: _Open, at: int | None, ended: str | None, sums: bool = True) -> None:
        above = self.open[depth - 1].name if depth else None
        values = (node.conv, node.n, node.children, node.leaves, node.saved) if sums else (None, 0, 0, 0, 0)
        self.rows.append((kind, path, depth, node.name, above, *values, node.size, at, ended))

    def _flush(self, node: _Open, depth: int) -> None:
        """Ended conversations leave as a piece of a list, which is hashed once all pieces are there."""
        if node.ended:
            self._row(ENDS, self.range, depth, node, node.cut, _joined(node.ended), sums=False)
            node.cut, node.ended = node.cut + 1, []

    def strip(self, keep: int) -> None:
        """Close the open nodes deeper than ``keep``, the deepest first."""
        while len(self.open) - 1 > keep:
            depth, node = len(self.open) - 1, self.open.pop()
            if node.first:
                # It may have begun in the range before: only what lies wholly below it is known.
                self._flush(node, depth)
                self._row(PART, 2 * self.range, depth, node, None, None)
            else:
                node.leaves = node.leaves or 1
                node.saved += (node.n - 1) * node.size
                if node.cut:
                    self._flush(node, depth)
                ended = None if node.cut else hashlib.sha256(_joined(node.ended).encode()).hexdigest()
                self._row(NODE, None, depth, node, None, ended)
                self.open[-1].children += 1
            self.open[-1].merge(node)

    def add(self, conv: int, path: str, sizes, first: bool) -> None:
        depth, shared = len(path) // STEP, min(len(self.path), len(path)) // STEP
        if self.path[:STEP * shared] != path[:STEP * shared]:
            low = 0
            while low < shared:  # the longest row of turns that both begin with
                middle = (low + shared + 1) // 2
                if self.path[:STEP * middle] == path[:STEP * middle]:
                    low = middle
                else:
                    shared = middle - 1
        self.strip(shared)
        for d in range(shared, depth):
            self.open.append(_Open(_name(self.open[-1].name, path[STEP * d:STEP * (d + 1)]), int(sizes[d]), first))
        self.path, end = path, self.open[-1]
        end.n, end.conv = end.n + 1, conv if end.conv is None else min(end.conv, conv)
        end.ended.append(conv)
        if len(end.ended) >= PIECE:
            self._flush(end, depth)

    def end(self) -> None:
        """The path that is still open is that of the last conversation; what lies on it may go on in the next range."""
        while self.open:
            depth, node = len(self.open) - 1, self.open.pop()
            self._flush(node, depth)
            self._row(PART, 2 * self.range + 1, depth, node, None, None)
            if node.first:
                # The first conversation's path runs through here too; the sums are given once, above.
                self._row(PART, 2 * self.range, depth, node, None, None, sums=False)
            if self.open:
                self.open[-1].merge(node)


def _peel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    peel = None
    for batch in batches:
        for range_, conv, path, sizes in zip(batch["_range"], batch["conv_id"], batch["_path"], batch["_sizes"], strict=True):
            first = peel is None
            if first:
                peel = _Peel(int(range_))
            peel.add(int(conv), path, sizes, first)
            if len(peel.rows) >= 20_000:
                yield pd.DataFrame(peel.rows, columns=_COLUMNS)
                peel.rows = []
    if peel is not None:
        peel.end()
        yield pd.DataFrame(peel.rows, columns=_COLUMNS)


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, ends_sha256) from the sorted pieces of each node's list."""
    name, sha, out = None, None, []
    for batch in batches:
        for node, ended in zip(batch["node"], batch["ended"], strict=True):
            if node != name:
                if sha is not None:
                    out.append((name, sha.hexdigest()))
                name, sha = node, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ended.encode())
        if len(out) >= 20_000:
            yield pd.DataFrame(out, columns=["node", "ends_sha256"])
            out = []
    if sha is not None:
        out.append((name, sha.hexdigest()))
    yield pd.DataFrame(out, columns=["node", "ends_sha256"])


def prefix_trie(rows: DataFrame) -> DataFrame:
    """All nodes of the trie of conversations (conv_id, turns) as :func:`turn_rows` gives them.

    Each distinct sequence of first d turns (role and text) is a node of depth d, from the
    root (d = 0), which every conversation is a member of. Returns node, parent (names),
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (summed
    over the subtree: all members but one, times the size of the last turn) and ends_sha256
    (of the comma-joined ascending ids that end there).

    A null list of turns is an empty one. Rows without a conv_id are left out; rows of equal
    conv_id are conversations of their own. An empty table has no node. Other columns are ignored.

    A task holds the open path and as many hashes as a batch has; what it hands on besides whole
    nodes is the paths of two conversations. A list of ended conversations leaves in pieces
    of PIECE ids, and is put together by one task as a stream (a hash needs its order).
    """
    sized = F.coalesce("turns", F.array().cast(rows.schema["turns"].dataType))
    paths = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.array_join(F.transform(sized, lambda t: t["id"]), "").alias("_path"),
        F.transform(sized, lambda t: t["size"].cast("long")).alias("_sizes"))
    dealt = paths.repartitionByRange(partitions(rows.sparkSession), "_path", "conv_id").sortWithinPartitions("_path", "conv_id")
    peeled = cut_lineage(dealt.select(F.spark_partition_id().alias("_range"), "conv_id", "_path", "_sizes").mapInPandas(_peel, _SCHEMA))

    parts = peeled.where(F.col("kind") == PART)
    joint = parts.groupBy("depth", "node").agg(
        F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.max("size").alias("size"), F.min("path").alias("home"))
    joint = cut_lineage(joint)
    below = joint.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("_more"))
    joint = joint.join(below, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_more", F.lit(0)))
    joint = cut_lineage(joint.withColumns({
        "_leaf": (F.col("n_children") == 0).cast("long"), "_saved": (F.col("n_convs") - 1) * F.col("size")}))
    # Each joint node adds its own to all above it, on one of the paths that it lies on.
    deeper = Window.partitionBy("path").orderBy(F.desc("depth"))
    own = parts.select("path", "depth", "node").join(joint.select("node", "home", "_leaf", "_saved"), "node")
    mine = lambda c: F.sum(F.when(F.col("home") == F.col("path"), F.col(c)).otherwise(0)).over(deeper)
    sums = own.select("node", mine("_leaf").alias("_l"), mine("_saved").alias("_s")).groupBy("node").agg(
        F.sum("_l").alias("_l"), F.sum("_s").alias("_s"))
    joint = joint.join(sums, "node").withColumns({"n_leaves": F.col("n_leaves") + F.col("_l"), "saved_tokens": F.col("saved_tokens") + F.col("_s")})

    pieces = peeled.where(F.col("kind") == ENDS).select("node", "path", "at", "ended")
    lists = pieces.repartition(partitions(rows.sparkSession), "node").sortWithinPartitions("node", "path", "at").select("node", "ended")
    hashes = lists.mapInPandas(_hashed, "node string, ends_sha256 string")
    keep = ["node", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    whole = peeled.where(F.col("kind") == NODE)
    nodes = whole.select(*keep, F.col("ended").alias("ends_sha256")).unionByName(joint.select(*keep, F.lit(None).cast("string").alias("ends_sha256")))
    known = nodes.where("ends_sha256 is not null")
    rest = nodes.where("ends_sha256 is null").drop("ends_sha256").join(hashes, "node", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    nodes = cut_lineage(known.unionByName(rest))
    above = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(above, "parent", "left")
