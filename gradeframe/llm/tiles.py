"""Every query against every vector, in tiles: blocks, matrix products, and the best of each query and slot.

Vectors are packed where they are read into blocks of bounded size, queries and vectors alike. Query blocks are
dealt to teams and vector blocks to parts; a task of a team and a part holds the team's queries, reads the
part's blocks one after another, and multiplies them tile by tile. So what a task holds is bounded
by the size of a team, not by the number of queries. A query's scores fall into slots (one, or the ranges
between its limits); each tile only adds what beats the entries a slot has so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.llm.common import slices, stored

BLOCK_VALUES = 262_144  # components of a block: at most 2 MB
TEAM_BLOCKS = 16  # query blocks of a team, on average
PART_BLOCKS = 1_024  # vector blocks of a part, on average
MOST_TASKS = 20_000
QUERY_TILE = 256  # queries multiplied at a time
FAN_IN = 16
ANY, SAME, OTHER = "any", "same", "other"  # labels that a query meets
BLOCKS = ("task bigint, number bigint, dim int, ids binary, labels binary, limits binary, width int, "
          "vectors binary, kind int")
BLOCKS_ARROW = pa.schema([("task", pa.int64()), ("number", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()),
                          ("labels", pa.binary()), ("limits", pa.binary()), ("width", pa.int32()),
                          ("vectors", pa.binary()), ("kind", pa.int32())])
TOPS = ("query_id bigint, task bigint, number bigint, i int, slot int, own bigint, part int, "
        "top array<struct<lost: bigint, vec_id: bigint>>")
ENTRY = pa.struct([("lost", pa.int64()), ("vec_id", pa.int64())])
LEAST = np.iinfo(np.int64).min
MOST = np.iinfo(np.int64).max


def finite(vector: Column) -> Column:
    """Whether the vector (array of double) is there and all its components are numbers."""
    number = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(number, F.lit(False))


def smallest(values: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them."""
    low, high = values.min(initial=0), values.max(initial=0)
    for kind in (np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return values.astype(kind)
    return values


def packed(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, label, v) in blocks of equal length, at most BLOCK_VALUES components each, by label.

    The blocks are written once to the shared folder, so that a lost executor changes none of them. Blocks of
    queries may get limits later, one row of ``width`` each: the falling upper limits of the slots, and the
    least score that is of use; without them there is one slot for all scores.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, labels, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().to_numpy()
            ends = np.cumsum(sizes)
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                rows = rows[np.argsort(labels[rows], kind="stable")]
                step = max(1, BLOCK_VALUES // max(int(dim), 1))
                for at in range(0, len(rows), step):
                    own = rows[at:at + step]
                    matrix = smallest(values[(ends[own] - dim)[:, None] + np.arange(dim)].astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(
                        (task, count, int(dim), ids[own].tobytes(), labels[own].tobytes(), b"", 0, matrix.tobytes(),
                         matrix.dtype.itemsize), BLOCKS_ARROW)], schema=BLOCKS_ARROW)
                    count += 1

    return stored(vectors.select("vec_id", F.col("label").cast("bigint"), "v").mapInArrow(blocks, BLOCKS))


class Block:
    """The vectors of a block, by label."""

    def __init__(self, row: dict):
        self.task, self.number, self.dim = row["task"], row["number"], row["dim"]
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        n = len(self.ids)
        self.limits = np.frombuffer(row["limits"], np.int64).reshape(n, row["width"])
        values = np.frombuffer(row["vectors"], {2: np.int16, 4: np.int32, 8: np.int64}[row["kind"]])
        self.exact = values.astype(np.int64).reshape(n, self.dim)
        self.real = self.exact.astype(np.float64)
        self.most = float(max(np.abs(self.real).max(initial=0), 1))

    def runs(self) -> Iterator[tuple[int, int, int]]:
        """label, first row and end of every run of one label."""
        labels, starts = np.unique(self.labels, return_index=True)
        yield from zip(labels.tolist(), starts.tolist(), [*starts[1:].tolist(), len(self.labels)])


def products(left: Block, a: slice, right: Block, b: slice) -> np.ndarray:
    """Inner products of the rows as 64-bit integers (they wrap beyond), in floating point where that is exact."""
    if left.most * right.most * max(left.dim, 1) < 2.0**53:
        return (left.real[a] @ right.real[b].T).astype(np.int64)
    return left.exact[a] @ right.exact[b].T


class Best:
    """The best ``k`` entries of every slot of the queries of a block: (lost, vec_id), lost falling as scores rise."""

    def __init__(self, block: Block, k: int, labels: str):
        self.block, self.k, self.meets = block, k, labels
        self.slots = max(block.limits.shape[1] - 1, 1)
        size = len(block.ids) * self.slots
        self.bound = np.full(size, MOST)  # the worst entry of a full slot
        self.group, self.lost, self.ids = (np.empty(0, np.int64) for _ in range(3))

    def meet(self, shard: Block) -> None:
        own = self.block
        if own.dim != shard.dim:
            return
        if self.meets == SAME:
            theirs = {label: slice(a, b) for label, a, b in shard.runs()}
            for label, a, b in own.runs():
                if label in theirs:
                    for at in range(a, b, QUERY_TILE):
                        self.tile(shard, slice(at, min(at + QUERY_TILE, b)), theirs[label])
        else:
            for at in range(0, len(own.ids), QUERY_TILE):
                self.tile(shard, slice(at, min(at + QUERY_TILE, len(own.ids))), slice(0, len(shard.ids)))

    def tile(self, shard: Block, mine: slice, theirs: slice) -> None:
        score = products(self.block, mine, shard, theirs)
        n = score.shape[1]
        if self.meets == OTHER:
            wanted = self.block.labels[mine][:, None] != shard.labels[theirs][None, :]
        else:
            wanted = np.ones(score.shape, bool)
        limits = self.block.limits[mine]
        if limits.shape[1]:
            # A slot holds the scores up to its limit and above the next one.
            wanted &= (score <= limits[:, :1]) & (score >= limits[:, -1:])
            q, s = np.nonzero(wanted)
            score = score[q, s]
            slot = (limits[q, :-1] >= score[:, None]).sum(axis=1) - 1
        else:
            lost = np.where(wanted, ~score, MOST)
            bound = self.bound[mine]
            if n > 2 * self.k and (bound == MOST).any():
                bound = np.minimum(bound, np.partition(lost, self.k - 1, axis=1)[:, self.k - 1])
            q, s = np.nonzero(wanted & (lost <= bound[:, None]))
            score, slot = score[q, s], 0
        group = (q + mine.start) * self.slots + slot
        better = ~score <= self.bound[group]
        self.add(group[better], ~score[better], shard.ids[theirs][s[better]])

    def add(self, group: np.ndarray, lost: np.ndarray, ids: np.ndarray) -> None:
        """Keeps the best k of each group of the entries so far and these."""
        if not len(group):
            return
        touched = np.isin(self.group, group)
        rest = [c[~touched] for c in (self.group, self.lost, self.ids)]
        group, lost, ids = (np.concatenate([c[touched], new]) for c, new in (
            (self.group, group), (self.lost, lost), (self.ids, ids)))
        order = np.lexsort((ids, lost, group))
        group, lost, ids = group[order], lost[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        nth = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        full = nth == self.k - 1
        self.bound[group[full]] = lost[full]
        keep = nth < self.k
        self.group, self.lost, self.ids = (np.concatenate([a, b[keep]]) for a, b in zip(rest, (group, lost, ids)))

    def rows(self, part: int) -> pa.RecordBatch:
        order = np.lexsort((self.ids, self.lost, self.group))
        group = self.group[order]
        groups, starts = np.unique(group, return_index=True)
        row, slot = groups // self.slots, groups % self.slots
        entries = pa.StructArray.from_arrays([pa.array(self.lost[order]), pa.array(self.ids[order])], fields=list(ENTRY))
        top = pa.ListArray.from_arrays(pa.array(np.append(starts, len(group)), pa.int32()), entries)
        own = ~(self.block.exact[row] ** 2).sum(axis=1)
        n = len(groups)
        return pa.RecordBatch.from_arrays([
            pa.array(self.block.ids[row]), pa.array(np.full(n, self.block.task)), pa.array(np.full(n, self.block.number)),
            pa.array(row, pa.int32()), pa.array(slot, pa.int32()), pa.array(own), pa.array(np.full(n, part), pa.int32()), top,
        ], ["query_id", "task", "number", "i", "slot", "own", "part", "top"])


def meetings(batches: Iterator[pa.RecordBatch], k: int, labels: str) -> Iterator[pa.RecordBatch]:
    """The best entries of the queries of every (part, team), from blocks sorted by it, queries first."""
    key, held = None, []
    for batch in slices(batches, 1):
        (row,) = batch.to_pylist()
        if (row["part"], row["team"]) != key:
            yield from (best.rows(key[0]) for best in held)
            key, held = (row["part"], row["team"]), []
        block = Block(row)
        if row["side"] == 0:
            held.append(Best(block, k, labels))
        else:
            for best in held:
                best.meet(block)
    yield from (best.rows(key[0]) for best in held)


def dealt(blocks: DataFrame, name: str, count: int) -> DataFrame:
    return blocks.withColumn(name, F.pmod(F.xxhash64("task", "number"), F.lit(count)).cast("int"))


def best_of_all(queries: DataFrame, shards: DataFrame, k: int, labels: str = ANY) -> DataFrame:
    """The best k entries of every slot of every query among all vectors, from packed blocks of both.

    One row per query and slot with an entry: query_id, task, number, i (which query), slot, own (the query's
    score with itself, lost), top (lost, vec_id; ascending). A query meets itself too, if labels allow.
    """
    query_blocks, shard_blocks = queries.count(), shards.count()
    partitions = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    teams = max(1, math.ceil(query_blocks / TEAM_BLOCKS))
    parts = max(1, math.ceil(shard_blocks / PART_BLOCKS), min(shard_blocks, math.ceil(partitions / teams)))
    every = lambda column, count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(column)
    # A query block goes to each part of its team, a vector block to each team of its part.
    asked = dealt(queries, "team", teams).select("*", every("part", parts)).withColumn("side", F.lit(0))
    met = dealt(shards, "part", parts).select("*", every("team", teams)).withColumn("side", F.lit(1))
    tasks = min(parts * teams, MOST_TASKS)
    key = (F.col("part").cast("bigint") * teams + F.col("team")) % tasks
    tops = (
        asked.unionByName(met).repartitionById(tasks, key.cast("int")).sortWithinPartitions("part", "team", "side")
        .mapInArrow(lambda batches: meetings(batches, k, labels), TOPS))
    groups = parts
    while True:
        groups = math.ceil(groups / FAN_IN)
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k)
        tops = tops.groupBy("query_id", "task", "number", "i", "slot", "own", F.floor(
            F.col("part") / FAN_IN).cast("int").alias("part")).agg(merged.alias("top"))
        if groups <= 1:
            return tops.drop("part")


def without_itself(k: int) -> Column:
    """The first k entries of ``top`` but the query's own row; equal entries are interchangeable."""
    at = F.array_position("top", F.struct(F.col("own").alias("lost"), F.col("query_id").alias("vec_id"))).cast("int")
    others = F.when(at > 0, F.concat(F.slice("top", F.lit(1), at - 1), F.slice("top", at + 1, F.size("top"))))
    return F.slice(F.coalesce(others, F.col("top")), 1, k)
