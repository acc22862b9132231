"""Language ID: a byte convolutional network, trained in numpy, over all windows of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import partitions

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: Bounds of the training sample: documents of a language, and windows of a document.
DOCUMENTS, WINDOWS = 400, 3
UNKNOWN = "und"


def _fold() -> np.ndarray:
    """A-Z to a-z; the second byte of U+00C0 to U+00DE (after 0xC3) is folded in ``to_bytes``."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def to_bytes(text: str, fold: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    out = fold[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3) + 1
    lead = lead[(raw[lead] >= 0x80) & (raw[lead] <= 0x9E)]
    out[lead] += 32
    return out


def to_windows(data: np.ndarray) -> np.ndarray:
    """All of the bytes in rows of WINDOW, the last one filled up with zeros; none for no bytes."""
    rows = -(-len(data) // WINDOW)
    out = np.zeros((rows, WINDOW), np.uint8)
    out.reshape(-1)[:len(data)] = data
    return out


class ByteNetwork:
    """Filters of several widths over one-hot bytes, max pooling over a window, softmax."""

    def __init__(self, labels: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.filters = [rng.normal(0, 0.2, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.shift = np.zeros(len(labels), np.float32)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest answer of each filter in each window, and where it was."""
        best, where = [], []
        for width, table in zip(WIDTHS, self.filters, strict=True):
            n = WINDOW - width + 1
            answer = np.take(table[0], x[:, :n], axis=0)
            for j in range(1, width):
                answer += np.take(table[j], x[:, j:j + n], axis=0)
            at = answer.argmax(axis=1) if self.training else None
            best.append(answer.max(axis=1))
            where.append(at)
        return np.concatenate(best, axis=1) + self.bias, where

    training = False

    def log_chances(self, x: np.ndarray) -> np.ndarray:
        """Per window and label; windows go through in pieces that stay in cache."""
        parts = []
        for at in range(0, len(x), 32):
            hidden = np.maximum(self.pooled(x[at:at + 32])[0], 0)
            parts.append(hidden @ self.out + self.shift)
        z = np.concatenate(parts) if parts else np.zeros((0, len(self.labels)), np.float32)
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.08, seed: int = 11) -> None:
        """Stochastic gradients with a rate per weight that falls with its past gradients."""
        rng = np.random.default_rng(seed)
        weights = [*self.filters, self.bias, self.out, self.shift]
        past = [np.full_like(w, 0.1) for w in weights]
        self.training = True
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                pick = order[at:at + batch]
                xs, ys = x[pick], y[pick]
                raw, where = self.pooled(xs)
                hidden = np.maximum(raw, 0)
                z = hidden @ self.out + self.shift
                z = np.exp(z - z.max(axis=1, keepdims=True))
                z /= z.sum(axis=1, keepdims=True)
                z[np.arange(len(ys)), ys] -= 1
                z /= len(ys)
                back = (z @ self.out.T) * (raw > 0)
                steps = []
                for k, width in enumerate(WIDTHS):
                    grad = np.zeros_like(self.filters[k])
                    part = back[:, k * FILTERS:(k + 1) * FILTERS]
                    each = np.broadcast_to(np.arange(FILTERS), part.shape)
                    for j in range(width):
                        seen = xs[np.arange(len(ys))[:, None], where[k] + j]
                        np.add.at(grad[j], (seen, each), part)
                    steps.append(grad)
                steps += [back.sum(axis=0), hidden.T @ z, z.sum(axis=0)]
                for w, p, g in zip(weights, past, steps, strict=True):
                    p += g * g
                    w -= rate * g / np.sqrt(p)
        self.training = False


def training_sample(labelled: DataFrame, order: Column, documents: int = DOCUMENTS) -> pd.DataFrame:
    """Up to ``documents`` texts of each language, the first by ``order``; each cut to WINDOWS windows.

    Spark keeps the first rows of each language in every task before it moves any. What the
    tasks keep meets in several groups of tasks first, so that a language common to all of them
    is not gathered by one; those groups leave ``documents`` rows of it each.
    """
    start = F.greatest(F.lit(1), F.call_function("div", F.length("text") - WINDOWS * WINDOW, F.lit(2)) + 1)
    # Cut before anything moves: a language's rows that meet are short, up to ``documents`` from each task.
    short = labelled.select("lang", order.alias("_order"), F.substr("text", start.cast("int"), F.lit(WINDOWS * WINDOW)).alias("text"))
    groups = short.withColumn("_group", F.spark_partition_id() % partitions(labelled.sparkSession))
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("_order"))
    few = groups.withColumn("_n", first("lang", "_group")).where(F.col("_n") <= documents)
    picked = few.withColumn("_n", first("lang")).where(F.col("_n") <= documents)
    return picked.select("lang", "_n", "text").toPandas().sort_values(["lang", "_n"])


def train(sample: pd.DataFrame) -> ByteNetwork | None:
    labels = sorted(sample["lang"].unique())
    if not labels:
        return None
    fold, rng, x, y = _fold(), np.random.default_rng(3), [], []
    for lang, text in zip(sample["lang"], sample["text"], strict=True):
        windows = to_windows(to_bytes(text, fold))[:WINDOWS]
        for window in windows:
            x.append(window)
            y.append(labels.index(lang))
        # Short texts have to be told as well: a piece of the first window.
        if len(windows):
            length = int(np.count_nonzero(windows[0]))
            short = windows[0].copy()
            short[rng.integers(min(8, length), length + 1):] = 0
            x.append(short)
            y.append(labels.index(lang))
    network = ByteNetwork(labels)
    if x:
        network.fit(np.stack(x), np.array(y))
    return network


def identify(docs: DataFrame, network: ByteNetwork | None, *, text: str = "text") -> DataFrame:
    """The rows with ``lang_pred`` and ``score``.

    Every window of the whole text is judged; the chances of its windows are multiplied
    (evenly weighted, as a mean of logarithms would be, but for the last one, which counts by its share
    of bytes), and score is the winning language's part of their sum. A null text, one without
    a letter, and any text when nothing was learned are ``und`` with score 0. Ties go to
    the label that sorts first. Repeated rows are judged alike; columns called lang_pred
    or score are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net, fold = sent.value, _fold()
        for batch in batches:
            out = []
            for text in batch:
                if net is None or text is None or not any(map(str.isalpha, text)):
                    out.append((UNKNOWN, 0.0))
                    continue
                data = to_bytes(text, fold)
                total = np.zeros(len(net.labels))
                for at in range(0, len(data), WINDOW * 1024):
                    part = data[at:at + WINDOW * 1024]
                    logs = net.log_chances(to_windows(part)).astype(np.float64)
                    weight = np.ones(len(logs))
                    weight[-1] = ((len(part) - 1) % WINDOW + 1) / WINDOW if len(data) > WINDOW else 1.0
                    total += weight @ logs
                chance = np.exp(total - total.max())
                best = int(total.argmax())
                out.append((net.labels[best], float(chance[best] / chance.sum())))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return docs.drop("lang_pred", "score").withColumn("_j", judge(F.col(f"`{text}`"))).withColumns(
        {"lang_pred": F.col("_j.lang_pred"), "score": F.col("_j.score")}).drop("_j")
