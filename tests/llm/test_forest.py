"""The forest of labels against plain components, and with leaders of bounded number."""

import random

import numpy as np
import pyarrow as pa
import pytest

import brute
from gradeframe.llm import near_join

NAMES = ["key", "tail", "sid", "reach", "s0", "s1", "s2", "leader"]


def joined(n, pairs):
    """Component of every row."""
    of = list(range(n))

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for u, v in pairs:
        of[max(root(u), root(v))] = min(root(u), root(v))
    return [root(x) for x in range(n)]


def near_sketches(rng, n, centres, flips):
    middle = rng.integers(0, 2**63, (centres, 3), dtype=np.uint64)
    out = middle[rng.integers(0, centres, n)]
    for _ in range(flips):
        out[np.arange(n), rng.integers(0, 3, n)] ^= np.uint64(1) << rng.integers(0, 63, n).astype(np.uint64)
    return out


@pytest.mark.parametrize("flips", [0, 4, 24])
def test_walk_is_the_components_below_a_prefix(flips):
    rng = np.random.default_rng(flips)
    depth, most = near_join.depth_for(), near_join.sketch_distance()
    sketches = near_sketches(rng, 200, 12, flips)
    tails = np.sort(rng.integers(0, 4, 200) << near_join.tail_bits(depth) | rng.integers(0, 3, 200))
    label = near_join.walk(tails, sketches, np.zeros(200, np.int64), depth, most)
    distance = np.bitwise_count(sketches[:, None] ^ sketches[None]).sum(axis=2)
    wanted = joined(200, zip(*np.nonzero(distance <= most)))
    assert [label.tolist().index(x) for x in label] == wanted


def test_leaders_lose_no_pair():
    """Pairs within the distance still hang together when one prefix has more rows than may be held."""
    rng = np.random.default_rng(5)
    depth, most, n = near_join.depth_for(), near_join.sketch_distance(), 5_000
    sketches = near_sketches(rng, n, 40, 12).view(np.int64)
    sid = pa.array([i.to_bytes(16, "little") for i in range(n)], pa.binary())
    table = pa.Table.from_arrays([
        pa.array(np.full(n, 7)), pa.array(np.sort(rng.integers(0, 90, n))), sid, pa.array(np.zeros(n, np.int32)),
        *[pa.array(np.ascontiguousarray(sketches[:, i])) for i in range(3)], pa.nulls(n, pa.binary())], NAMES)
    pairs = [(int.from_bytes(u, "little"), int.from_bytes(v, "little"))
             for b in near_join.candidate_edges(iter(table.to_batches(max_chunksize=700)), depth, most, 300)
             for u, v in zip(*(c.to_pylist() for c in b.columns))]
    assert len(pairs) < 2 * n
    component = joined(n, pairs)
    values = sketches.view(np.uint64)
    for i in range(0, n, 50):
        near = np.flatnonzero(np.bitwise_count(values ^ values[i]).sum(axis=1) <= most)
        assert {component[j] for j in near} == {component[i]}


def test_a_label_all_sets_share_leaves_slices_as_leaders():
    rng = np.random.default_rng(9)
    n = 3_000
    sketches = near_sketches(rng, n, 1, 1).view(np.int64)
    keys = np.tile(np.arange(near_join.TREES), (n, 1))
    keys[:, 1:] += rng.integers(1, 2**60, (n, 1))
    batch = pa.RecordBatch.from_arrays([
        pa.array([i.to_bytes(16, "little") for i in range(n)], pa.binary()), pa.array(keys.tolist(), pa.list_(pa.int64())),
        pa.array(np.zeros_like(keys).tolist(), pa.list_(pa.int64())),
        pa.array(sketches.tolist(), pa.list_(pa.int64()))], ["sid", "keys", "tails", "sketch"])
    rows = pa.Table.from_batches(near_join.leading(iter([batch]), near_join.SLICE)).to_pylist()
    labels = [r for r in rows if r["leader"] is None]
    assert sum(r["key"] == 0 for r in labels) == 1
    assert len(labels) == 1 + n * (near_join.TREES - 1)
    assert len({r["sid"] for r in rows if r["leader"] is not None}) == n - 1


def test_links_are_whole_with_few_leaders(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    texts = {}
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        texts[i] = " ".join(words)
    links, classes = brute.near(texts)
    for name, value in {"LEADERS": 8, "SLICE": 16, "TILE": 32}.items():
        monkeypatch.setattr(near_join, name, value)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = near_join.near_join(docs).collect()
    assert {r.doc_id: (r.n_links, r.class_id) for r in got} == {k: (links[k], classes[k]) for k in texts}
