from __future__ import annotations

import numpy as np
import pytest

from weftline.operators.vectors import nearest


def brute(queries, entries, k, min_similarity, other):
    found = set()
    for q, v in queries:
        ranked = sorted(
            (float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), b)
            for b, w in entries if not (other and b == q))
        for place, (d, b) in enumerate(ranked[:k], 1):
            if min_similarity is None or 1 - d > min_similarity:
                found.add((q, b, place, round(1 - d, 9)))
    return found


def data(seed, dims=4):
    """Clustered vectors; a third of the entries are copies of one of them."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    points = centres[rng.integers(0, 6, 240)] + rng.normal(scale=0.05, size=(240, dims))
    points[::3] = points[0]
    return [(i, [float(x) for x in p]) for i, p in enumerate(points)]


@pytest.mark.parametrize("sent", [10**9, 0], ids=["sent", "cells"])
@pytest.mark.parametrize("k, least, other", [
    (1, None, False), (1, None, True), (3, None, True), (2, 0.9, False), (1, 0.99, True)])
def test_nearest_matches_brute_force(spark, sent, k, least, other):
    entries = data(1)
    queries = entries if other else data(2)[:80]
    q = spark.createDataFrame(queries, "q int, qv array<double>").repartition(3)
    b = spark.createDataFrame(entries, "b int, bv array<double>").repartition(4)
    got = nearest(q, b, ("q", "qv"), ("b", "bv"), k, least, other, sent_numbers=sent).collect()
    got = [(r["q"], r["b"], r["place"], round(r["similarity"], 9)) for r in got]
    assert len(got) == len(set(got))
    assert set(got) == brute(queries, entries, k, least, other)


@pytest.mark.parametrize("sent", [10**9, 0], ids=["sent", "cells"])
def test_few_entries_null_vectors_and_floats(spark, sent):
    q = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [3.0, 4.0])], "q int, qv array<float>")
    b = spark.createDataFrame([("a", [0.0, 0.5]), ("z", None)], "b string, bv array<float>")
    got = nearest(q, b, ("q", "qv"), ("b", "bv"), k=3, sent_numbers=sent).collect()
    assert sorted((r["q"], r["b"], r["place"]) for r in got) == [(1, "a", 1), (3, "a", 1)]


def test_no_entries_and_unequal_widths(spark):
    q = spark.createDataFrame([(1, [0.0])], "q int, qv array<double>")
    b = spark.createDataFrame([(1, [0.0]), (2, [0.0, 1.0])], "b int, bv array<double>")
    assert nearest(q, b.limit(0), ("q", "qv"), ("b", "bv")).count() == 0
    with pytest.raises(ValueError, match="width"):
        nearest(q, b, ("q", "qv"), ("b", "bv"))


def test_large_cells_are_cut_in_chunks(spark, monkeypatch):
    from weftline.operators import vectors

    monkeypatch.setattr(vectors, "_PIVOTS", 2)
    monkeypatch.setattr(vectors, "_CHUNK_ROWS", 10)
    entries, queries = data(4), data(5)[:40]
    q = spark.createDataFrame(queries, "q int, qv array<double>")
    b = spark.createDataFrame(entries, "b int, bv array<double>")
    got = nearest(q, b, ("q", "qv"), ("b", "bv"), 2, sent_numbers=0).collect()
    assert {(r["q"], r["b"], r["place"], round(r["similarity"], 9)) for r in got} \
        == brute(queries, entries, 2, None, False)


def test_bad_components_and_long_vectors_give_the_same_rows_both_ways(spark):
    rng = np.random.default_rng(8)
    scale = 10.0 ** rng.integers(0, 7, 300)[:, None]
    good = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 6)) * scale)]
    good += [(300 + i, [x + 1e-3 for x in v]) for i, v in good[:100]]
    bad = [(1000, [float("nan")] * 6), (1001, [float("inf")] + [0.0] * 5), (1002, [None] + [0.0] * 5), (1003, [])]
    q = spark.createDataFrame(good + bad, "q int, qv array<double>")
    b = spark.createDataFrame(bad + good, "b int, bv array<double>").repartition(3)
    found = [
        {(r["q"], r["b"], r["place"], r["similarity"]) for r in
         nearest(q, b, ("q", "qv"), ("b", "bv"), 2, None, True, sent_numbers=sent).collect()}
        for sent in (10**9, 0)]
    assert found[0] == found[1]
    assert {r[:3] for r in found[0]} == {r[:3] for r in brute(good, good, 2, None, True)}


def test_rows_are_sent_to_blocks_not_to_cells(spark, monkeypatch):
    """Where bounds exclude no cell, a query goes to each block once, however many cells there are."""
    from weftline.operators import vectors

    sent, meet = [], vectors._meet
    monkeypatch.setattr(vectors, "_PIVOTS", 64)
    monkeypatch.setattr(vectors, "_meet", lambda targets, *a: (sent.append(targets.count()), meet(targets, *a))[1])
    points = np.random.default_rng(9).normal(size=(600, 24))
    entries = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    b = spark.createDataFrame(entries, "b int, bv array<float>").repartition(3)
    got = nearest(b.selectExpr("b q", "bv qv"), b, ("q", "qv"), ("b", "bv"), 2, None, True, sent_numbers=0).collect()
    assert sum(sent) <= 600 * 13
    exact = [(i, [float(x) for x in np.float32(p)]) for i, p in entries]
    assert {(r["q"], r["b"], r["place"], round(r["similarity"], 9)) for r in got} == brute(exact, exact, 2, None, True)


@pytest.mark.parametrize("cells", [1, 3])
@pytest.mark.parametrize("k", [1, 3])
def test_short_vectors_beside_a_long_one(cells, k):
    """Single precision can't tell these apart, so they are measured in double precision; equal ids are left out wherever they are."""
    import pyarrow as pa
    from weftline.operators.vectors import _best

    rng = np.random.default_rng(10)
    entries = np.vstack([rng.normal(size=(30_000, 3)), [[1e9, 0.0, 0.0]]])
    queries = np.vstack([entries[:40], [[1e9, 1.0, 0.0]]])
    ids = np.r_[np.arange(15_000), np.arange(15_000), 77_777]
    of = np.sort(np.arange(len(entries)) % cells)
    met = [c for c in range(cells) if c != 1]
    got = _best(pa.array(np.arange(41)), queries, pa.array(ids), entries, k, None, True, of, np.full(41, np.inf),
                lambda rows: np.where(np.isin(np.arange(cells), met), 0.0, np.inf)[None, :].repeat(len(queries[rows]), 0))
    expected = []
    for i, q in enumerate(queries):
        distances = np.sqrt(((entries - q) ** 2).sum(1))
        distances[(ids == i) | ~np.isin(of, met)] = np.inf
        expected += [(i, int(ids[j]), p) for p, j in enumerate(np.lexsort((ids, distances))[:k], 1)]
    assert [(r["q_id"], r["b_id"], r["place"]) for r in got.to_pylist()] == expected


def test_few_blocks_hold_entries_and_queries_pass_by(spark, monkeypatch):
    """Where bounds exclude no cell, the rows sent are a few times those given, on either side, whatever the number of cells."""
    from weftline.operators import vectors

    sent, meet = [], vectors._meet

    def counted(targets, placed, counts, most, *rest):
        rows = {r["block"]: r["count"] for r in placed.groupBy("block").count().collect()}
        sent.append(targets.count() + sum(n * -(-int(counts[b]) // most) for b, n in rows.items()))
        return meet(targets, placed, counts, most, *rest)

    monkeypatch.setattr(vectors, "_CHUNK_ROWS", 10)
    monkeypatch.setattr(vectors, "_meet", counted)
    points = np.random.default_rng(12).normal(size=(600, 24))
    entries = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    b = spark.createDataFrame(entries, "b int, bv array<double>").repartition(3)
    got = nearest(b.selectExpr("b q", "bv qv"), b, ("q", "qv"), ("b", "bv"), 2, None, True, sent_numbers=0).collect()
    assert sum(sent) <= 600 * 12
    assert {(r["q"], r["b"], r["place"], round(r["similarity"], 9)) for r in got} == brute(entries, entries, 2, None, True)


@pytest.mark.parametrize("k, least", [(1, None), (3, 0.5)])
def test_hot_blocks_cut_cells_and_small_pieces(spark, monkeypatch, k, least):
    """Queries of one place meet their block in several tasks, a few at a time; ids may be of different types."""
    from weftline.operators import vectors

    for name, value in {"_PIVOTS": 5, "_CHUNK_ROWS": 9, "_PIECE_ROWS": 7, "_HELD_NUMBERS": 200}.items():
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(13)
    entries = [(i, [float(x) for x in p]) for i, p in enumerate(rng.normal(size=(300, 4)) * np.where(np.arange(300) % 3, 0.1, 2.0)[:, None])]
    queries = [(f"q{i}", [float(x) for x in p]) for i, p in enumerate(rng.normal(size=(120, 4)) * np.where(np.arange(120) % 4, 0.05, 2.0)[:, None])]
    q = spark.createDataFrame(queries, "q string, qv array<double>").repartition(3)
    b = spark.createDataFrame(entries, "b int, bv array<double>").repartition(3)
    got = nearest(q, b, ("q", "qv"), ("b", "bv"), k, least, sent_numbers=0).collect()
    assert len(got) == len(set(got))
    assert {(r["q"], r["b"], r["place"], round(r["similarity"], 9)) for r in got} == brute(queries, entries, k, least, False)


def test_a_row_has_the_same_cell_whichever_rows_are_beside_it():
    from weftline.operators.vectors import _distances, _nearest_pivot, _norms

    rng = np.random.default_rng(14)
    pivots = rng.integers(0, 2, (40, 67)).astype(float) * 1000.1
    rows = (pivots[rng.integers(0, 40, 500)] + pivots[rng.integers(0, 40, 500)]) / 2.0
    cells = lambda some: _nearest_pivot(some, pivots, _distances(some, pivots), _norms(some))
    expected = [int(np.add.accumulate((pivots - r) ** 2, axis=1)[:, -1].argmin()) for r in rows]
    assert cells(rows).tolist() == expected
    assert [int(cells(rows[i:i + 1])[0]) for i in range(500)] == expected


def test_meetings_shuffle_nothing_and_rows_are_stored_once_a_round(spark, monkeypatch):
    """However many blocks a query is sent to, and however many tasks hold a block."""
    from weftline import session
    from weftline.operators import vectors

    plans, stored, meet, cut = [], [], vectors._meet, session.cut_counted

    def planned(targets, *rest):
        met = meet(targets, *rest)
        plans.append((met._jdf.queryExecution().executedPlan().toString(), met.rdd.getNumPartitions(), targets.count()))
        return met

    def counted(*a, **b):
        df, rows = cut(*a, **b)
        stored.append(rows)
        return df, rows

    for name, value in {"_BLOCKS": 10, "_MEETINGS": 20, "_CHUNK_ROWS": 10}.items():
        monkeypatch.setattr(vectors, name, value)
    monkeypatch.setattr(vectors, "_meet", planned)
    monkeypatch.setattr(vectors, "cut_counted", counted, raising=False)
    monkeypatch.setattr(session, "cut_counted", counted)
    points = np.random.default_rng(15).normal(size=(600, 24))
    entries = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    b = spark.createDataFrame(entries, "b int, bv array<double>").repartition(3)
    got = nearest(b.selectExpr("b q", "bv qv"), b, ("q", "qv"), ("b", "bv"), 2, None, True, sent_numbers=0).collect()
    assert {(r["q"], r["b"], r["place"], round(r["similarity"], 9)) for r in got} == brute(entries, entries, 2, None, True)
    assert [rows for *_, rows in plans][0] == 600 and plans[1][2] > 4_000
    assert not [plan for plan, *_ in plans if "Exchange" in plan]
    # A task for each meeting; found pairs are stored too, two a query and block.
    assert [tasks >= 10 for _, tasks, _ in plans] == [True, True]
    assert sum(stored[:4]) <= 4 * 600 and len(stored) == 5


def test_many_meetings_are_planned_some_at_a_time(spark, monkeypatch):
    from weftline.operators import vectors

    calls, meet = [], vectors._meet
    for name, value in {"_BLOCKS": 6, "_CHUNK_ROWS": 10, "_PLANNED": 5}.items():
        monkeypatch.setattr(vectors, name, value)
    def counted(*a):
        met = meet(*a)
        calls.append(met.rdd.getNumPartitions())
        return met

    monkeypatch.setattr(vectors, "_meet", counted)
    entries, queries = data(16, 12), data(17, 12)[:50]
    q = spark.createDataFrame(queries, "q int, qv array<double>")
    b = spark.createDataFrame(entries, "b int, bv array<double>")
    got = nearest(q, b, ("q", "qv"), ("b", "bv"), 2, sent_numbers=0).collect()
    assert len(calls) > 2 and 1 < max(calls) <= 10
    assert len(got) == len(set(got))
    assert {(r["q"], r["b"], r["place"], round(r["similarity"], 9)) for r in got} == brute(queries, entries, 2, None, False)
