"""Token counts that follow edits: a sum tree over each document's stretches of text.

A text is cut into stretches where no token can cross: before a single space between two
characters that aren't white space. Byte-level BPE with a pattern that takes one leading
space into a word starts a new piece exactly there, whatever stands around, so the counts
of stretches add up to the text's. An edit touches some stretches; those, widened to the
nearest cuts of the changed text, are encoded again, and the sums above them follow.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters in a stretch, if there is a cut.
STRETCH = 512
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: How a byte-level BPE of this kind takes a text apart: a fixed value that comes with the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of ``base64 rank`` lines, read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def cuts(text: str) -> list[int]:
    """Where stretches begin, about STRETCH characters apart."""
    out, at = [0], STRETCH
    while at < len(text):
        found = _CUT.search(text, at)
        if found is None:
            break
        out.append(found.start())
        at = found.start() + STRETCH
    return out


class TokenTree:
    """Characters and tokens of a text's stretches, summed up pairwise to the root.

    ``leaf`` sums sit at size..2*size-1 of two heaps, node i over 2i and 2i+1. A stretch that
    an edit has emptied keeps its place with sums of zero; one that an edit has grown keeps
    its text whole.
    """

    def __init__(self, text: str, count, leaves: list[tuple[str, int]] | None = None):
        """Over a text, or over ``leaves`` (stretch, tokens) that an earlier tree gave, of which none is encoded."""
        self.count = count
        if leaves:
            self.parts = [part for part, _ in leaves]
        else:
            begins = cuts(text)
            self.parts = [text[a:b] for a, b in zip(begins, [*begins[1:], len(text)], strict=True)]
        self.size = 1 << max(0, (len(self.parts) - 1).bit_length())
        self.chars, self.tokens = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        n = len(self.parts)
        self.chars[self.size:self.size + n] = [len(p) for p in self.parts]
        self.tokens[self.size:self.size + n] = [tokens for _, tokens in leaves] if leaves else count(self.parts)
        level = self.size
        while level > 1:
            half = level // 2
            for sums in (self.chars, self.tokens):
                sums[half:level] = sums[level:2 * level].reshape(-1, 2).sum(axis=1)
            level = half
        self.encoded = 0

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def leaves(self) -> list[tuple[str, int, int]]:
        """(stretch, characters, tokens) of all stretches that aren't empty."""
        kept = [i for i, part in enumerate(self.parts) if part]
        return [(self.parts[i], int(self.chars[self.size + i]), int(self.tokens[self.size + i])) for i in kept]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The stretch that holds a character, and where that stretch begins; the last one for the end."""
        node, begin = 1, 0
        while node < self.size:
            node *= 2
            if place >= begin + self.chars[node] and self.chars[node + 1]:
                begin += int(self.chars[node])
                node += 1
        return node - self.size, begin

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.parts[leaf] = text
        node = leaf + self.size
        self.chars[node], self.tokens[node] = len(text), tokens
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _beside(self, leaf: int, step: int) -> int | None:
        """The next stretch that isn't empty, before (-1) or after (1) another."""
        leaf += step
        while 0 <= leaf < len(self.parts) and not self.parts[leaf]:
            leaf += step
        return leaf if 0 <= leaf < len(self.parts) else None

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of the characters start..end (both kept within the text)."""
        length = int(self.chars[1])
        start = min(max(start, 0), length)
        end = min(max(end, start), length)
        first, begin = self.leaf_at(start)
        last, last_begin = self.leaf_at(max(start, end - 1))
        text = self.parts[first][:start - begin] + new + self.parts[last][end - last_begin:]
        # The region has to begin and end at cuts of the changed text.
        while (before := self._beside(first, -1)) is not None and not _is_cut(self.parts[before][-1:], text[:2]):
            text, first = self.parts[before] + text, before
        while (after := self._beside(last, 1)) is not None and not (text and _is_cut(text[-1:], self.parts[after][:2])):
            text, last = text + self.parts[after], after
        self.encoded += len(text)
        for leaf in range(first + 1, last + 1):
            if self.parts[leaf]:
                self._set(leaf, "", 0)
        self._set(first, text, self.count([text])[0])


def _is_cut(before: str, after: str) -> bool:
    return bool(before) and not before.isspace() and len(after) > 1 and after[0] == " " and not after[1].isspace()


def count_through_edits(docs: DataFrame, ranks: dict[bytes, int], *, text: str = "text", edits: str = "edits") -> DataFrame:
    """The rows with ``n_tokens``, ``n_tokens_edited``, ``n_chars_edited`` and ``chars_encoded``.

    ``edits`` holds, for each row, an array of (start, stop, put): places in the text as the
    edits before have left it, and what replaces them; they are applied in order. Tokens of the
    whole text are counted once, and each edit re-encodes what it touches: ``chars_encoded``
    tells how much that was. Ranks are a vocabulary's, of fixed size.

    A null text is an empty one, with no tokens; null edits are none, null places the text's
    end and a null replacement nothing. Places outside the text move to its ends. Repeated
    rows are counted alike; columns with the names above are replaced.
    """
    names = ["n_tokens", "n_tokens_edited", "n_chars_edited", "chars_encoded"]
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("struct<n_tokens: long, n_tokens_edited: long, n_chars_edited: long, chars_encoded: long>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import tiktoken
        coder = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=sent.value, special_tokens={})
        count = lambda parts: [len(coder.encode_ordinary(p)) for p in parts]
        for texts, changes in batches:
            rows = []
            for text, change in zip(texts, changes, strict=True):
                tree = TokenTree(text or "", count)
                before = tree.total
                for edit in (change if change is not None else []):
                    end = int(tree.chars[1])
                    place = [end if pd.isna(edit[k]) else int(edit[k]) for k in ("start", "stop")]
                    tree.replace(*place, "" if pd.isna(edit["put"]) else edit["put"])
                rows.append((before, tree.total, int(tree.chars[1]), tree.encoded))
            yield pd.DataFrame(rows, columns=names)

    counted = docs.drop(*names).withColumn("_t", run(F.col(f"`{text}`"), F.col(f"`{edits}`")))
    return counted.withColumns({n: F.col(f"_t.{n}") for n in names}).drop("_t")


LEAVES = "array<struct<stretch: string, chars: long, tokens: long>>"


def with_trees(docs: DataFrame, ranks: dict[bytes, int], *, text: str = "text", tree: str = "tree") -> DataFrame:
    """The rows with their text's tree, as the leaves in order, to be stored and edited by ``edit_trees``; a null text has none."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf(LEAVES)
    def build(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = _counter(sent.value)
        for texts in batches:
            yield pd.Series([_rows(TokenTree(text or "", count)) for text in texts])

    return docs.withColumn(tree, build(F.col(f"`{text}`")))


def edit_trees(trees: DataFrame, ranks: dict[bytes, int], *, tree: str = "tree", edits: str = "edits") -> DataFrame:
    """The rows with ``tree`` as their edits leave it, ``n_tokens``, ``n_chars`` and ``chars_encoded``.

    Only the stretches that edits touch are encoded; a null or empty tree is that of the
    empty text. Edits are those of ``count_through_edits``; the three columns are replaced.
    """
    names = ["n_tokens", "n_chars", "chars_encoded"]
    sent = trees.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf(f"struct<tree: {LEAVES}, n_tokens: long, n_chars: long, chars_encoded: long>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        count = _counter(sent.value)
        for held, changes in batches:
            rows = []
            for leaves, change in zip(held, changes, strict=True):
                kept = [(leaf["stretch"], int(leaf["tokens"])) for leaf in (leaves if leaves is not None else [])]
                now = TokenTree("", count, kept)
                for edit in (change if change is not None else []):
                    end = int(now.chars[1])
                    place = [end if pd.isna(edit[k]) else int(edit[k]) for k in ("start", "stop")]
                    now.replace(*place, "" if pd.isna(edit["put"]) else edit["put"])
                rows.append((_rows(now), now.total, int(now.chars[1]), now.encoded))
            yield pd.DataFrame(rows, columns=["tree", *names])

    out = trees.drop(*names).withColumn("_t", run(F.col(f"`{tree}`"), F.col(f"`{edits}`")))
    return out.withColumns({tree: F.col("_t.tree")} | {n: F.col(f"_t.{n}") for n in names}).drop("_t")


def _counter(ranks: dict[bytes, int]):
    import tiktoken
    coder = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda parts: [len(coder.encode_ordinary(p)) for p in parts]


def _rows(tree: TokenTree) -> list[dict]:
    return [{"stretch": part, "chars": chars, "tokens": tokens} for part, chars, tokens in tree.leaves()]
