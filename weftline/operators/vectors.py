"""Exact nearest-entry search by L2 distance.

A set of entries of checked size is sent to every task, and queries stream past it
without a shuffle. A larger set is divided into cells around pivot entries; triangle
inequality bounds tell which cells can hold a query's nearest entry (after Lu et al.,
"Efficient processing of k nearest neighbor joins using MapReduce", 2012). Neighbouring
cells share a block, and a query meets each block once that it has such a cell in.
Blocks are a few, even shares of the entries while that fits a task, which holds one block
and lets its queries stream past. Entries are stored by block, and queries once a round; tasks
read from there what they meet. So how often a row is written doesn't grow with the table or the blocks.

Vectors whose bounds exclude nothing (many dimensions, no clusters) are compared all with all,
by definition of the search: products of matrices in single precision leave those pairs
that can be among the nearest, and these are measured in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut_counted, cut_lineage, free_scratch, scratch_path, side_by_side

# Entries up to this many numbers (64 MB as doubles) are sent to every task whole.
SENT_NUMBERS = 8_000_000
#: Numbers of a matrix of distances, or of what is measured at a time.
_BLOCK_NUMBERS = 4_000_000
#: Numbers of a block and of the queries that pass it in one meeting, about at most; rows of either at least.
_HELD_NUMBERS, _PASSING_NUMBERS, _CHUNK_ROWS = 20_000_000, 48_000_000, 1_024
#: Blocks that entries are dealt into, and meetings of a block with queries in a round, if they fit.
_BLOCKS, _MEETINGS = 4, 12
#: Meetings of one plan, about at most, so that planning grows with their number.
_PLANNED = 48
#: Queries that are compared at a time in a meeting.
_PIECE_ROWS = 8_192
_PIVOTS = 128
#: Queries and entries of one product, and how many of its columns have their maximum taken together.
_ROWS, _TILE, _GROUP = 512, 4_096, 32
#: A score that no pair has.
_NONE = np.float32(-3e38)

#: The least distances of some queries (a slice of rows) from what each cell holds; infinite: the cell isn't met.
Least = Callable[[slice], np.ndarray]


def _matrix(vectors: pd.Series | list) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])


def _rows_of(vectors: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Vectors of that width, one a row."""
    if pc.any(pc.not_equal(pc.list_value_length(vectors), width)).as_py():
        raise ValueError(f"vectors differ in width from the entries' {width}")
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between the rows of two matrices, good to about `_slack`."""
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", vectors, vectors))


def _slack(lengths, width: int):
    """A bound on what rounding takes from or adds to `_distances`, from the two vectors' lengths."""
    return 4.0 * np.sqrt(np.finfo(np.float64).eps * (width + 4)) * lengths


def _usable(vector: str) -> Column:
    """Vectors with components, all of them finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def _numbers(df: DataFrame, vector: str) -> Column:
    """The vectors as floats, if they are so, or else as doubles."""
    kind = df.select(vector).schema[0].dataType.simpleString()
    return F.col(vector) if kind == "array<float>" else F.col(vector).cast("array<double>")


def nearest(
    queries: DataFrame, base: DataFrame, query: tuple[str, str], entry: tuple[str, str],
    k: int = 1, min_similarity: float | None = None, other_than_self: bool = False,
    sent_numbers: int = SENT_NUMBERS,
) -> DataFrame:
    """The ``k`` nearest entries of each query row as (query id, entry id, ``similarity``,
    ``place``), where similarity is ``1 - distance``; ties go to the lower entry id.

    ``query`` and ``entry`` name the id and vector columns; query ids are unique.
    ``min_similarity`` keeps only matches strictly above it. ``other_than_self`` ignores
    the entry that has the query's own id. Rows match nothing, on either side, when their
    vector is null or empty or has a null, NaN or infinite component; lengths must stay
    below 1e150, so that their squares are numbers. Both ways of searching give the same rows.
    """
    wanted = queries.select(
        F.col(query[0]).alias("q_id"), _numbers(queries, query[1]).alias("q_vec")).where(_usable("q_vec"))
    entries = base.select(
        F.col(entry[0]).alias("b_id"), _numbers(base, entry[1]).alias("b_vec")).where(_usable("b_vec"))

    # Of equal vectors only the lowest ids can be among the nearest. The limit applies
    # in each map task already, so many copies of one vector do not meet in one task.
    keep = k + 1 if other_than_self else k
    copies = Window.partitionBy("b_vec").orderBy("b_id")
    entries = cut_lineage(entries.withColumn("_n", F.row_number().over(copies))
                          .where(F.col("_n") <= keep).drop("_n"))

    size = entries.agg(
        F.count("*").alias("rows"), F.min(F.size("b_vec")).alias("low"),
        F.max(F.size("b_vec")).alias("high"),
        F.coalesce(F.sum(F.octet_length(F.col("b_id").cast("string"))), F.lit(0)).alias("id_bytes"),
    ).first()
    if size.low != size.high:
        raise ValueError(f"entry vectors differ in width: {size.low} to {size.high}")
    limit = None if min_similarity is None else 1.0 - min_similarity
    small = size.rows * (size.high or 0) + size.id_bytes // 8 <= sent_numbers
    if small:
        found = _search_sent(wanted, entries, size.high or 1, k, limit, other_than_self)
    else:
        found = _search_cells(wanted, entries, size.rows, size.high, k, limit, other_than_self)
    return found.select(
        F.col("q_id").alias(query[0]), F.col("b_id").alias(entry[0]),
        (1.0 - F.col("distance")).alias("similarity"), "place",
    )


def _same(q_ids: pa.Array, b_ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(query row, entry row) of equal ids, by query row; null equals nothing."""
    def known(ids: pa.Array) -> pd.DataFrame:
        at = pc.indices_nonzero(pc.is_valid(ids))
        return pd.DataFrame({"id": ids.take(at).to_pandas(), "at": at.to_numpy()})

    q, b = known(q_ids), known(b_ids)
    if q["id"].dtype != b["id"].dtype and object in (q["id"].dtype, b["id"].dtype):
        return np.empty(0, int), np.empty(0, int)
    both = q.merge(b, on="id").sort_values("at_x")
    return both["at_x"].to_numpy(int), both["at_y"].to_numpy(int)


def _by_pair(
    queries: np.ndarray, entries: np.ndarray, k: int, same: tuple[np.ndarray, np.ndarray], bound: np.ndarray, met: np.ndarray | None,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What :func:`_near` yields, in double precision and with a margin for each pair: for vectors of very different lengths."""
    step = max(1, _BLOCK_NUMBERS // len(entries))
    count = min(k, len(entries)) - 1
    for at in range(0, len(queries), step):
        part = slice(at, at + step)
        vectors = queries[part]
        rough = _distances(vectors, entries)
        slack = _slack(_norms(vectors)[:, None] + _norms(entries)[None, :], entries.shape[1])
        inside = (same[0] >= at) & (same[0] < at + step)
        rough[same[0][inside] - at, same[1][inside]] = np.inf
        if met is not None:
            rough[~met[part]] = np.inf
        most = np.minimum(np.partition(rough + slack, count, axis=1)[:, count], bound[part])
        query, entry = np.nonzero((rough - slack <= most[:, None]) & np.isfinite(rough))
        yield at + query, entry


def _near(
    queries: np.ndarray, entries: np.ndarray, cells: np.ndarray, k: int, same: tuple[np.ndarray, np.ndarray], bound: np.ndarray,
    least: Least | None,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query rows, entry rows) of all pairs that can be among a query's k nearest and within its bound, and few others.

    ``cells`` has the entries' cells, in ascending order. A pair's score, its product less half the entry's
    square, is the higher the nearer the entry is. Scores are of vectors shortened so that none is longer
    than 1; single precision then takes ``off`` from them at most.
    """
    width = entries.shape[1]
    scale = float(max(_norms(queries).max(), _norms(entries).max())) or 1.0
    off = 2.0 * (width + 16) * 2.0 ** -24
    starts = np.flatnonzero(np.diff(cells, prepend=cells[0] - 1))
    tiles, places, first = [], [], 0
    for cell, (start, end) in enumerate(zip(starts, [*starts[1:], len(cells)], strict=True)):
        for i in range(start, end, _TILE):
            rows = min(_TILE, end - i)
            wide = -(-rows // _GROUP)
            tiles.append((cell, first, wide))
            places.append(np.pad(np.arange(i, i + rows), (0, wide * _GROUP - rows), constant_values=-1))
            first += wide * _GROUP
    place = np.concatenate(places)
    real = np.flatnonzero(place >= 0)
    right = np.zeros((len(place), width + 1), np.float32)
    right[:, width] = _NONE
    for i in range(0, len(real), _TILE):
        shortened = entries[i:i + _TILE] / scale
        right[real[i:i + _TILE], :width], right[real[i:i + _TILE], width] = shortened, -0.5 * (shortened * shortened).sum(1)
    shortened = queries / scale
    left, squares = np.ones((len(queries), width + 1), np.float32), (shortened * shortened).sum(1)
    left[:, :width] = shortened
    del shortened
    floor = np.maximum((squares - (bound / scale) ** 2) / 2.0 - 2.0 * off, _NONE).astype(np.float32)
    product = np.empty(_ROWS * _TILE, np.float32)
    columns = np.arange(_GROUP)
    for at in range(0, len(queries), _ROWS):
        part = slice(at, min(at + _ROWS, len(queries)))
        ours, low = left[part], floor[part].copy()
        high = None
        if least is not None:
            high = (squares[part, None] - (least(part) / scale) ** 2) / 2.0 + off
        a, b = np.searchsorted(same[0], [part.start, part.stop])
        own_query, own_entry = same[0][a:b] - at, real[same[1][a:b]]
        found, groups, most = [], 0, len(ours) * (256 + 32 * k)
        for cell, first, wide in tiles:
            rows = np.arange(len(ours)) if high is None else np.flatnonzero(high[:, cell] >= low)
            if not len(rows):
                continue
            size = wide * _GROUP
            some = ours if len(rows) == len(ours) else ours[rows]
            scores = np.matmul(some, right[first:first + size].T, out=product[:len(rows) * size].reshape(len(rows), size))
            if len(own_query):
                inside = (own_entry >= first) & (own_entry < first + size)
                row = np.searchsorted(rows, own_query[inside])
                hit = rows[np.minimum(row, len(rows) - 1)] == own_query[inside]
                scores[row[hit], own_entry[inside][hit] - first] = -np.inf
            top = scores.reshape(len(rows), _GROUP, wide).max(1)
            limit = low[rows]
            if wide >= k:
                kth = top.max(1) if k == 1 else np.partition(top, wide - k, axis=1)[:, wide - k]
                limit = np.maximum(limit, kth - np.float32(2.0 * off))
                low[rows] = limit
            row, group = np.nonzero(top >= limit[:, None])
            groups += len(row)
            if groups > most:
                break
            column = group[:, None] + wide * columns
            score = scores[row[:, None], column]
            x, y = np.nonzero(score >= limit[row][:, None])
            found.append((rows[row[x]], first + column[x, y], score[x, y]))
        if groups > most:
            met = None if high is None else np.isfinite(high)[:, np.repeat(np.arange(len(starts)), np.diff([*starts, len(cells)]))]
            for query, entry in _by_pair(queries[part], entries, k, (same[0][a:b] - at, same[1][a:b]), bound[part], met):
                yield at + query, entry
        elif found:
            query, entry, score = (np.concatenate(f) for f in zip(*found, strict=True))
            kept = (score >= low[query]) & (place[entry] >= 0)
            yield at + query[kept], place[entry[kept]]


def _first_rows(
    query: np.ndarray, entry: np.ndarray, exact: np.ndarray, order: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query row, entry row, distance, place): the k nearest of these for each query, ties to the lower ``order``."""
    sorted_ = np.lexsort((order[entry], exact, query))
    query, entry, exact = query[sorted_], entry[sorted_], exact[sorted_]
    place = np.arange(len(query)) - np.searchsorted(query, query, "left")
    kept = place < k
    return query[kept], entry[kept], exact[kept], (place[kept] + 1).astype(np.int32)


def _order(b_ids: pa.Array) -> np.ndarray:
    return pc.rank(b_ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()


def _best_rows(
    q_ids: pa.Array, queries: np.ndarray, b_ids: pa.Array, entries: np.ndarray, k: int, limit: float | None, other_than_self: bool,
    cells: np.ndarray | None = None, bound: np.ndarray | None = None, least: Least | None = None, order: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query row, entry row, distance, place): the k nearest of a block of entries for each of a block of queries, none beyond its bound."""
    found = [(np.empty(0, int), np.empty(0, int), np.empty(0), np.empty(0, np.int32))]
    if len(q_ids) and len(b_ids):
        order = _order(b_ids) if order is None else order
        same = _same(q_ids, b_ids) if other_than_self else (np.empty(0, int), np.empty(0, int))
        bound = np.full(len(q_ids), np.inf) if bound is None else bound
        cells = np.zeros(len(b_ids), int) if cells is None else cells
        step = max(1, _BLOCK_NUMBERS // entries.shape[1])
        for query, entry in _near(queries, entries, cells, k, same, bound, least):
            exact = np.empty(len(query))
            for i in range(0, len(query), step):
                part = slice(i, i + step)
                # Added up from left to right, in every block alike.
                exact[part] = np.sqrt(np.add.accumulate((entries[entry[part]] - queries[query[part]]) ** 2, axis=1)[:, -1])
            if limit is not None:
                near = exact < limit
                query, entry, exact = query[near], entry[near], exact[near]
            found.append(_first_rows(query, entry, exact, order, k))
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def _best(q_ids: pa.Array, queries: np.ndarray, b_ids: pa.Array, *rest) -> pa.Table:
    """What :func:`_best_rows` finds as (q_id, b_id, distance, place)."""
    query, entry, exact, place = _best_rows(q_ids, queries, b_ids, *rest)
    return pa.table({"q_id": q_ids.take(pa.array(query)), "b_id": b_ids.take(pa.array(entry)), "distance": exact, "place": place})


def _types(wanted: DataFrame, entries: DataFrame) -> str:
    return f"q_id {wanted.schema['q_id'].dataType.simpleString()}, b_id {entries.schema['b_id'].dataType.simpleString()}, distance double"


def _search_sent(
    wanted: DataFrame, entries: DataFrame, width: int, k: int, limit: float | None, other_than_self: bool
) -> DataFrame:
    rows = entries.toArrow().combine_chunks()
    ids = pa.concat_arrays(rows.column("b_id").chunks) if len(rows) else None
    sent = wanted.sparkSession.sparkContext.broadcast((ids, _rows_of(rows.column("b_vec"), width) if len(rows) else None))

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = sent.value
        for frame in frames:
            if len(frame) and ids is not None:
                yield from _best(frame.column("q_id"), _rows_of(frame.column("q_vec"), width), ids, matrix, k, limit, other_than_self).to_batches()

    return wanted.mapInArrow(batches, f"{_types(wanted, entries)}, place int")


def _chain(pivots: np.ndarray) -> list[int]:
    """The pivots in an order in which each is followed by the nearest of those left."""
    distances = _distances(pivots, pivots)
    order, left = [0], set(range(1, len(pivots)))
    while left:
        order.append(min(left, key=lambda i: (distances[order[-1], i], i)))
        left.remove(order[-1])
    return order


def _nearest_pivot(matrix: np.ndarray, pivots: np.ndarray, distances: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The nearest pivot of each row, the first of equal ones. Rows have the same one whichever rows are beside them:
    pivots that rounding could put first are told apart by sums from left to right."""
    close = distances <= (distances.min(1) + 4.0 * _slack(lengths + _norms(pivots).max(), matrix.shape[1]))[:, None]
    row, pivot = np.nonzero(close)
    exact, step = np.empty(len(row)), max(1, _BLOCK_NUMBERS // matrix.shape[1])
    for i in range(0, len(row), step):
        part = slice(i, i + step)
        exact[part] = np.add.accumulate((matrix[row[part]] - pivots[pivot[part]]) ** 2, axis=1)[:, -1]
    sorted_ = np.lexsort((pivot, exact, row))
    return pivot[sorted_][np.searchsorted(row, np.arange(len(matrix)))]


def _dealt(counts: np.ndarray, order: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, how many blocks) of each cell. Cells that follow one another share a block of about ``most`` rows, as few
    and as even as whole cells allow and never more than a cell over; a cell of more than ``most`` rows has several of its own."""
    first, many = np.zeros(len(counts), int), np.maximum(1, -(-counts // most))
    cells = np.array(order)
    shared, large = cells[many[cells] == 1], cells[many[cells] > 1]
    rows = int(counts[shared].sum())
    blocks = -(-rows // most)
    if rows:
        middles = np.cumsum(counts[shared]) - counts[shared] / 2.0
        first[shared] = np.minimum((middles * blocks / rows).astype(int), blocks - 1)
    first[large] = blocks + np.cumsum(many[large]) - many[large]
    return first, many


def _pick(values: np.ndarray, at: Column) -> Column:
    return F.get(F.array(*[F.lit(int(v)) for v in values]), at)


def _ids(side: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(side.column(name).chunks)


def _runs(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(meeting, whether they are queries, rows): rows that follow one another and have these in common."""
    for frame in frames:
        meeting, query = frame.column("meeting").to_numpy(), pc.is_valid(frame.column("q_vec")).to_numpy(zero_copy_only=False)
        ends = np.flatnonzero((np.diff(meeting) != 0) | (np.diff(query) != 0)) + 1
        for start, end in zip([0, *ends], [*ends, len(frame)], strict=True):
            if end > start:
                yield int(meeting[start]), bool(query[start]), frame.slice(start, end - start)


def _pieces(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table | None, pa.Table]]:
    """(entries of a meeting, some of its queries); only a meeting's first piece has the entries, which may be no rows."""
    held, pending, now = [], [], None

    def piece() -> tuple[pa.Table | None, pa.Table]:
        return None if held is None else pa.Table.from_batches(held or [pending[0].slice(0, 0)]), pa.Table.from_batches(pending)

    for meeting, query, run in _runs(frames):
        if meeting != now:
            if pending:
                yield piece()
            held, pending, now = [], [], meeting
        if not query:
            held.append(run)
            continue
        pending.append(run)
        if sum(map(len, pending)) >= _PIECE_ROWS:
            yield piece()
            held, pending = None, []
    if pending:
        yield piece()


class _Block:
    """The entries of a block by cell, as a task holds them."""

    def __init__(self, entries: pa.Table, width: int) -> None:
        self.ids, self.cells = _ids(entries, "b_id"), entries.column("cell").to_numpy()
        self.matrix = _rows_of(entries.column("b_vec"), width)
        self.held, self.order = np.unique(self.cells), _order(self.ids)


def _ways(counts: np.ndarray, most: int) -> np.ndarray:
    """The tasks that each block meets its queries in, of about ``most`` queries each."""
    return np.where(counts > 0, np.maximum(1, np.rint(counts / most)), 0).astype(int)


def _meet(
    targets: DataFrame, placed: DataFrame, counts: np.ndarray, most: int, width: int,
    found_of: Callable[[pa.Table, np.ndarray, _Block], pa.RecordBatch], schema: str, parts: int,
) -> DataFrame:
    """What ``found_of`` gives for the queries sent to each block, some at a time, and that block's entries.

    ``counts`` says how many queries are sent to each block. About ``most`` of them meet the whole block in a task of
    their own, so no task grows with a block that many queries go to. Both sides are stored by block, or by ``part``
    (0 to ``parts`` - 1), and a task reads what it needs of either from there: nothing is shuffled, however many blocks
    a query is sent to and however many tasks hold a block. A task holds the entries only; the queries come after them
    and are read as they come. Run it :func:`side_by_side`.
    """
    meetings = []
    for block, ways in enumerate(np.minimum(_ways(counts, most), parts).tolist()):
        for i in range(ways):
            part = F.col("part").between(parts * i // ways, parts * (i + 1) // ways - 1)
            both = targets.where((F.col("block") == block) & part).drop("part") \
                .unionByName(placed.where(F.col("block") == block), allowMissingColumns=True)
            meetings.append(both.withColumn("meeting", F.lit(len(meetings)))
                            .coalesce(1).sortWithinPartitions(F.isnotnull("q_vec"), "cell"))
    if not meetings:
        return targets.sparkSession.createDataFrame([], schema)

    def met(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for entries, queries in _pieces(frames):
            if entries is not None:
                block = _Block(entries, width)
            yield found_of(queries, _rows_of(queries.column("q_vec"), width), block)

    return reduce(DataFrame.union, meetings).mapInArrow(met, schema)


def _lists(of: np.ndarray, rows: int, values: pa.Array) -> pa.ListArray:
    """``values`` as one list for each of so many rows; ``of`` has the values' rows in ascending order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(rows + 1)), pa.int32()), values)


def _search_cells(
    wanted: DataFrame, entries: DataFrame, rows: int, width: int, k: int, limit: float | None, other_than_self: bool
) -> DataFrame:
    """In two rounds, both run here: each query meets the block that its own cell is in, that cell first; what it finds
    there bounds its nearest, and it goes on to those blocks only that can hold a nearer one."""
    # Pivots are entries themselves, so distances to them bound the nearest from above.
    pivots = _matrix([
        r[0] for r in entries.orderBy(F.xxhash64(F.col("b_vec").cast("array<double>")), "b_id").limit(_PIVOTS)
        .select("b_vec").collect()
    ]) if rows else np.zeros((1, width or 1))
    width, keep = pivots.shape[1], k + 1 if other_than_self else k

    @F.pandas_udf("cell int, reach double, length double")
    def assign(vectors: pd.Series) -> pd.DataFrame:
        matrix = _matrix(vectors)
        distances, lengths = _distances(matrix, pivots), _norms(matrix)
        cell = _nearest_pivot(matrix, pivots, distances, lengths)
        return pd.DataFrame({"cell": cell, "reach": distances[np.arange(len(cell)), cell], "length": lengths})

    # Found anew by each reader, always the same.
    placed = entries.withColumn("_a", assign("b_vec")).select("b_id", "b_vec", "_a.*")
    radius, longest, counts = np.full(len(pivots), -np.inf), 0.0, np.zeros(len(pivots), int)
    for cell, reach, length, count in placed.groupBy("cell").agg(F.max("reach"), F.max("length"), F.count(F.lit(1))).collect():
        radius[cell], longest, counts[cell] = reach, max(longest, length), count

    def share(rows: int, parts: int, numbers: int) -> int:
        """Rows of one of so many parts of the rows, while these are so many numbers at most."""
        return max(1, min(numbers // width, max(_CHUNK_ROWS, -(-rows // parts))))

    first, many = _dealt(counts, _chain(pivots), share(rows, _BLOCKS, _HELD_NUMBERS))
    blocks = int((first + many).max())
    piece = lambda *row: (_pick(first, F.col("cell")) + F.pmod(F.xxhash64(*row), _pick(many, F.col("cell")))).cast("int")
    placed = placed.select("b_id", "b_vec", "cell", piece("b_id", "b_vec").alias("block"))
    of_cell = np.zeros((len(pivots), blocks), bool)
    for cell in np.flatnonzero(counts):
        of_cell[cell, first[cell]:first[cell] + many[cell]] = True

    @F.pandas_udf("cell int, bound double")
    def own_cell(vectors: pd.Series) -> pd.DataFrame:
        distances = _distances(_matrix(vectors), pivots)
        bound = np.full(len(distances), np.inf if limit is None else limit)
        if len(pivots) >= keep:
            bound = np.minimum(bound, np.partition(distances, keep - 1, axis=1)[:, keep - 1])
        # A rounded distance to a pivot is no bound to the last digit.
        bound += 4.0 * _slack(_norms(_matrix(vectors)) + longest, width)
        distances[:, ~np.isfinite(radius)] = np.inf
        return pd.DataFrame({"cell": distances.argmin(1), "bound": bound})

    def least_of(vectors: np.ndarray) -> np.ndarray:
        """The least distance that each of these can have from an entry of each cell."""
        distances = _distances(vectors, pivots)
        lower = np.maximum(distances - radius[None, :], (distances - distances.min(1)[:, None]) / 2.0)
        # Four rounded distances meet in a comparison.
        lower -= 4.0 * _slack(_norms(vectors) + longest, width)[:, None]
        return np.where(np.isfinite(radius)[None, :], np.maximum(lower, 0.0), np.inf)

    def at_home(queries: pa.Table, vectors: np.ndarray, block: _Block) -> pa.RecordBatch:
        """The nearest of the own block and the blocks to go on to, with the vectors of those that go on."""
        ids, own, bound = _ids(queries, "q_id"), queries.column("cell").to_numpy()[:, None], queries.column("bound").to_numpy().copy()
        found = [np.empty(0, int)] * 2 + [np.empty(0)]
        for home in (True, False):
            least = lambda rows: np.where((own[rows] == block.held) == home, least_of(vectors[rows])[:, block.held], np.inf)  # noqa: B023, E731
            more = _best_rows(ids, vectors, block.ids, block.matrix, k, limit, other_than_self, block.cells, bound, least, block.order)
            *found, place = _first_rows(*(np.concatenate(f) for f in zip(found, more[:3], strict=True)), block.order, k)
            last = place == k
            bound[found[0][last]] = np.minimum(bound[found[0][last]], found[2][last])
        on = np.empty((len(ids), blocks), bool)
        for i in range(0, len(ids), _ROWS):
            part = slice(i, i + _ROWS)
            on[part] = (least_of(vectors[part]) <= bound[part, None]) @ of_cell
        on[np.arange(len(ids)), queries.column("block").to_numpy()] = False
        going, to = np.nonzero(on)
        gone = ~on.any(1)
        near = pa.StructArray.from_arrays([block.ids.take(pa.array(found[1])), pa.array(found[2])], ["b_id", "distance"])
        return pa.RecordBatch.from_arrays([
            ids, _ids(queries, "q_vec").take(pa.array(np.arange(len(ids)), mask=gone)), pa.array(bound),
            _lists(going, len(ids), pa.array(to, pa.int32())), _lists(found[0], len(ids), near),
        ], ["q_id", "q_vec", "bound", "blocks", "near"])

    def elsewhere(queries: pa.Table, vectors: np.ndarray, block: _Block) -> pa.RecordBatch:
        query, entry, exact, _ = _best_rows(
            _ids(queries, "q_id"), vectors, block.ids, block.matrix, k, limit, other_than_self, block.cells,
            queries.column("bound").to_numpy(), lambda rows: least_of(vectors[rows])[:, block.held], block.order)
        return pa.RecordBatch.from_arrays(
            [_ids(queries, "q_id").take(pa.array(query)), block.ids.take(pa.array(entry)), pa.array(exact)], ["q_id", "b_id", "distance"])

    spark = wanted.sparkSession
    stored = [scratch_path(spark, "entries"), scratch_path(spark, "queries")]
    placed = cut_counted(placed, stored[0], ["block"])[0]

    def part_of(parts: int) -> Column:
        return F.pmod(F.xxhash64(F.lit("part"), "q_id", "q_vec"), F.lit(parts)).cast("int")

    def met(targets: DataFrame, counts: np.ndarray, most: int, found_of: Callable, schema: str, parts: int, **by: Column) -> DataFrame:
        """What a round finds, stored by some columns; blocks of about so many meetings have a plan and a run of their own."""
        runs, found = np.cumsum(np.minimum(_ways(counts, most), parts)) // _PLANNED, []
        with side_by_side(spark):
            for run in np.unique(runs):
                some = _meet(targets, placed, np.where(runs == run, counts, 0), most, width, found_of, schema, parts)
                found.append(cut_lineage(some.withColumns(by), list(by)))
        return reduce(DataFrame.union, found)

    # Read twice, to count them and to store them; what is found is of the second time.
    targets = wanted.withColumn("_h", own_cell("q_vec")).select("q_id", "q_vec", "_h.*").withColumn("block", piece("q_id", "q_vec"))
    sent = np.zeros(blocks, int)
    for block, count in targets.groupBy("block").count().collect():
        sent[block] = count
    most = share(int(sent.sum()) * _BLOCKS, _MEETINGS, _PASSING_NUMBERS)
    # Of the second round as many parts as any block can have meetings.
    parts, later = int(max(1, _ways(sent, most).max())), max(_MEETINGS, -(-int(sent.sum()) * width // _PASSING_NUMBERS))
    targets = cut_counted(targets.withColumn("part", part_of(parts)), stored[1], ["block", "part"])[0]
    q_vec, types = wanted.schema["q_vec"].dataType.simpleString(), _types(wanted, entries)
    b_id = entries.schema["b_id"].dataType.simpleString()
    homed = met(
        targets, np.maximum(sent, 1), most, at_home,
        f"q_id {wanted.schema['q_id'].dataType.simpleString()}, q_vec {q_vec}, bound double, blocks array<int>, near array<struct<b_id: {b_id}, distance: double>>",
        parts, part=part_of(later))
    sent = np.zeros(blocks, int)
    for block, count in homed.select(F.explode("blocks").alias("block")).groupBy("block").count().collect():
        sent[block] = count
    # Of the second round nothing is at home: each query meets several cells.
    targets = homed.select("q_id", "q_vec", "bound", "part", F.explode("blocks").alias("block")).withColumn("cell", F.lit(0))
    near = homed.select("q_id", F.explode("near").alias("_n")).select("q_id", "_n.*")
    far = met(targets, sent, share(int(sent.sum()), _MEETINGS, _PASSING_NUMBERS), elsewhere, types, later)
    free_scratch(spark, stored)
    place = F.row_number().over(Window.partitionBy("q_id").orderBy("distance", "b_id"))
    return near.unionByName(far).withColumn("place", place).where(F.col("place") <= k)
