"""Top lists and hard negatives against plain loops: ties, repeated ids, labels, many blocks, teams and parts."""

import random

import pytest

from gradeframe.llm import negatives, tiles, topk


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in {"BLOCK_VALUES": 12, "TEAM_BLOCKS": 2, "PART_BLOCKS": 3, "QUERY_TILE": 2, "FAN_IN": 2}.items():
        monkeypatch.setattr(tiles, name, value)


def rows_of(seed, n, most=3):
    rng = random.Random(seed)
    return [(rng.choice([i, i, i, i - i % 5]), rng.choice([1, 1, 1, 2, 3]),  # a hot label, repeated ids
             [rng.randint(-most, most) for _ in range(rng.choice([3, 3, 3, 2]))]) for i in range(n)]


def ranked(query, own, rows, wanted=lambda row: True):
    found = [(-sum(a * b for a, b in zip(query[2], r[2])), r[0]) for i, r in enumerate(rows)
             if i != own and len(r[2]) == len(query[2]) and wanted(r)]
    return [(-lost, vec_id) for lost, vec_id in sorted(found)]


@pytest.mark.parametrize("most", [3, 10**6, 10**10])
def test_top_k_of_many_blocks(spark, small_blocks, most):
    rows = rows_of(most, 70, most)
    table = spark.createDataFrame(rows, "vec_id long, label long, v array<long>").repartition(3)
    got = sorted(map(tuple, topk.top_k(table, table.where("vec_id % 2 = 0"), 4).collect()))
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    wanted = []
    for i, q in enumerate(rows):
        if q[0] % 2 == 0:
            scores = ranked(q, i, rows)
            if most > 10**9:  # long arithmetic wraps; the order is that of wrapped scores
                scores = [(-a, b) for a, b in sorted((-wrap(s), v) for s, v in scores)]
            wanted += [(q[0], r, v, s) for r, (s, v) in enumerate(scores[:4], 1)]
    assert got == sorted(wanted)


def test_blocks_of_very_many_tasks(spark, monkeypatch):
    rows = rows_of(5, 20)
    table = spark.createDataFrame(rows, "vec_id long, label long, v array<long>")
    blocks = tiles.packed(table).selectExpr("task + (2048L << 40) task", "number + (1L << 40) number", *tiles.BLOCKS_ARROW.names[2:])
    got = tiles.best_of_all(blocks, blocks, 3).collect()
    assert len(got) == 20 and min(r.task for r in got) >= 2048 << 40


@pytest.mark.parametrize("seed", range(3))
def test_negatives_against_loops(spark, small_blocks, seed):
    rows = rows_of(seed, 90)
    table = spark.createDataFrame(rows, "vec_id long, label long, v array<long>").repartition(4)
    got = sorted(map(tuple, negatives.hard_negatives(table, table.where("vec_id % 3 = 0"), 4, 3, 40, 100).collect()))
    wanted = []
    for i, a in enumerate(rows):
        if a[0] % 3 == 0:
            others = ranked(a, i, rows, lambda r: r[1] != a[1])
            for p, positive in ranked(a, i, rows, lambda r: r[1] == a[1])[:4]:
                window = [(s, v) for s, v in others if 40 * p <= 100 * s <= 100 * p][:3]
                wanted += [(a[0], positive, r, v, p, s) for r, (s, v) in enumerate(window, 1)]
    assert got == sorted(wanted) and len(got) > 50


def test_negatives_below_another_upper_limit(spark, small_blocks):
    rows = rows_of(9, 60, 9)
    table = spark.createDataFrame(rows, "vec_id long, label long, v array<long>")
    got = sorted(map(tuple, negatives.hard_negatives(table, table.where("vec_id % 4 = 0"), 3, 2, 33, 91).collect()))
    wanted = []
    for i, a in enumerate(rows):
        if a[0] % 4 == 0:
            others = ranked(a, i, rows, lambda r: r[1] != a[1])
            for p, positive in ranked(a, i, rows, lambda r: r[1] == a[1])[:3]:
                window = [(s, v) for s, v in others if 33 * p <= 100 * s <= 91 * p][:2]
                wanted += [(a[0], positive, r, v, p, s) for r, (s, v) in enumerate(window, 1)]
    assert got == sorted(wanted)


def test_no_task_holds_all_queries(spark, small_blocks):
    """A team holds a bounded share of the query blocks, and every tile is met once."""
    table = spark.createDataFrame(rows_of(2, 200), "vec_id long, label long, v array<long>").where("size(v) = 3")
    blocks = tiles.packed(table)
    count = blocks.count()
    teams = tiles.dealt(blocks, "team", -(-count // tiles.TEAM_BLOCKS)).groupBy("team").count().collect()
    assert count > 30 and max(r["count"] for r in teams) <= 4 * tiles.TEAM_BLOCKS
