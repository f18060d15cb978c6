"""N-gram Jaccard join: a MinHash LSH forest over word shingles, followed by exact verification.

1. A text becomes the set of its five-word shingles (64-bit hashes). Equal sets are one node from here on.
2. The forest has ``TREES`` trees. A tree is a prefix trie over labels of ``DEPTH`` minimum hashes, kept as
   rows sorted by label. It is walked from the deepest prefixes upwards: sets below one prefix are hung
   together if their sketches (one bit of each minimum hash) differ no more than pairs at the threshold do
   with five standard deviations; then the prefix is shortened by one. A path ends where all sets below it
   hang together already, at the latest at the length where pairs at the threshold meet in some tree
   with the target recall (``depth_for``). Groups of sets that hang together are candidates.
   Sets whose sketches nearly equal that of another one with the same full label are left to that one, the
   leader, before the shuffle; a leader's reach (its farthest set) widens what it is compared with, so no
   pair is lost, and a label that a third of all sets share arrives as a few leaders from each slice.
3. Every set of a candidate group is compared with all others of its group, exactly and on whole sets. Large
   groups are dealt in tiles of two blocks of sets, so no task holds more than two blocks; a tile
   gives counts and a spanning forest, never pairs.

Links are counted between documents; classes are the components of the verified links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeframe.llm.common import checkpointed, keep_rows, read_table, slices
from gradeframe.llm.components import components, join_dealt

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 32, 8, 0.9999
TILE = 512  # sets of a block
TIGHT = 6  # sketch bits within which a set is left to a leader
SLICE = 8_192  # sets whose labels are sorted before the shuffle
LEADERS = 8_192  # leaders held of one prefix; beyond it they reach farther
COLUMNS = 4_096  # shingles multiplied at a time

_rng = np.random.default_rng(9_041)
MULTIPLIERS = _rng.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)
PLACES = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SKETCH = 192  # bits, three longs

SIGNED = ("doc_id bigint, text_hash bigint, sid binary, n int, keys array<bigint>, tails array<bigint>, "
          "sketch array<bigint>")
LABELS = "key bigint, tail bigint, sid binary, reach int, s0 bigint, s1 bigint, s2 bigint, leader binary"
SETS = "cluster binary, low int, high int, block int, sid binary, copies bigint, shingles binary"
LINKS = "sid binary, links bigint, root binary"


def depth_for(recall: float = RECALL, threshold: float = THRESHOLD) -> int:
    """The longest prefix at which pairs at the threshold meet in one of the trees with this recall."""
    for depth in range(DEPTH, 1, -1):
        if 1 - (1 - threshold**depth) ** TREES >= recall:
            return depth
    return 1


def tail_bits(depth: int) -> int:
    """Bits kept of each minimum hash behind the least depth; they only order the sets below a prefix."""
    return min(16, 63 // max(1, DEPTH - depth))


def sketch_distance(threshold: float = THRESHOLD) -> int:
    """Most sketch bits in which pairs at the threshold differ, five standard deviations allowed."""
    p = (1 - threshold) / 2
    return int(np.ceil(SKETCH * p + 5 * np.sqrt(SKETCH * p * (1 - p))))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def runs_of(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of this many words."""
    total = np.full(max(0, len(h) - width + 1), width, np.uint64)
    for i in range(width):
        total += mixed(h[i:len(total) + i] * PLACES[i])
    return mixed(total)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its runs of five words.

    A text of fewer words has one run of all its words; a text without a word, or null, has none.
    Words are told apart for all texts together, so each distinct word is hashed once.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = split.flatten()
    told = words.dictionary_encode()
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, told.dictionary.to_numpy(zero_copy_only=False)), np.uint64)
    there = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty one
    h = hashed[told.indices.to_numpy()][there]
    ends = np.concatenate([[0], np.cumsum(there)])[np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]
    runs, start = runs_of(h, WORDS), 0
    for end in ends.tolist():
        yield np.unique(runs[start:end - WORDS + 1] if end - start >= WORDS else runs_of(h[start:end], end - start)) \
            if end > start else np.empty(0, np.uint64)
        start = end


def minimum_hashes(x: np.ndarray, count: int) -> np.ndarray:
    least = np.full(count, 2**64 - 1, np.uint64)
    for at in range(0, len(x), 256):
        part = MULTIPLIERS[:count, None] * x[None, at:at + 256]
        part += SHIFTS[:count, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def signed(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Identity of the set, label in every tree (prefix of the least depth, and the rest), and sketch, for each document."""
    trees, count = np.arange(TREES, dtype=np.uint64), max(TREES * DEPTH, SKETCH)
    bits_kept = np.uint64(tail_bits(depth))
    for batch in slices(batches, 1_000):
        sids, sizes, keys, tails, sketches = [], [], [], [], []
        for x in shingle_sets(batch.column(2)):
            sids.append(xxhash.xxh3_128_digest(x.tobytes()))
            sizes.append(len(x))
            if len(x):
                least = minimum_hashes(x, count)
                key, tail = trees, np.zeros(TREES, np.uint64)
                labels = least[:TREES * DEPTH].reshape(TREES, DEPTH).T.astype(np.uint64)
                for values in labels[:depth]:
                    key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + values)
                for values in labels[depth:]:
                    tail = tail << bits_kept | mixed(values) >> np.uint64(64) - bits_kept
                keys.append(key.view(np.int64).tolist())
                tails.append(tail.view(np.int64).tolist())
                # A bit that does not depend on the size of the minimum.
                bits = mixed(least[:SKETCH].astype(np.uint64) + np.uint64(77)) & np.uint64(1)
                sketches.append(np.packbits(bits.astype(np.uint8)).view(np.int64).tolist())
            else:
                keys.append([])
                tails.append([])
                sketches.append([])
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array(sids, pa.binary()), pa.array(sizes, pa.int32()),
            pa.array(keys, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64())),
            pa.array(sketches, pa.list_(pa.int64())),
        ], ["doc_id", "text_hash", "sid", "n", "keys", "tails", "sketch"])


def groups_of(batches: Iterator[pa.RecordBatch], columns: tuple[int, ...]) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by the first columns; a table ends where a group ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            first = [batch.column(c)[0] for c in columns]
            changed = [i for i in range(batch.num_rows) if [batch.column(c)[i] for c in columns] != first][:1] \
                if [held[-1].column(c)[-1] for c in columns] == first else [0]
            end = changed[0] if changed else batch.num_rows
            if end:
                held.append(batch.slice(0, end))
                batch = batch.slice(end)
            if changed:
                yield pa.Table.from_batches(held)
                held = []
        if batch.num_rows:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def distances(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(sketches ^ one).sum(axis=1).astype(np.int64)


def led(sketches: np.ndarray, reach: np.ndarray, tight: int) -> tuple[np.ndarray, np.ndarray]:
    """Leader of every row, and the rows' reach: a row all of whose reach is within ``tight`` of an earlier leader is left to it."""
    leader, reach = np.arange(len(sketches)), reach.copy()
    left = leader
    while len(left) > 1:
        first, left = left[0], left[1:]
        far = distances(sketches[left], sketches[first]) + reach[left]
        near = far <= tight
        leader[left[near]] = first
        reach[first] = max(reach[first], far[near].max(initial=0))
        left = left[~near]
    return leader, reach


def hang_together(sketches: np.ndarray, reach: np.ndarray, label: np.ndarray, most: int) -> np.ndarray:
    """The labels after rows are joined whose sets may be at a distance of at most ``most`` bits.

    Rows with one label hang together already. A component grows from its first row; only rows not
    yet reached are compared, so a bucket of similar sets takes time in proportion to its rows.
    """
    out = label.copy()
    left = np.arange(len(label))
    while len(left):
        number = label[left[0]]
        same = label[left] == number
        front, left = left[same], left[~same]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for row in front:
                rest = ~near
                near[rest] = distances(sketches[left[rest]], sketches[row]) <= most + reach[row] + reach[left[rest]]
                if near.all():
                    break
            near = np.isin(label[left], label[left[near]])
            front, left = left[near], left[~near]
            out[front] = number
    return out


def walk(tails: np.ndarray, sketches: np.ndarray, reach: np.ndarray, depth: int, most: int) -> np.ndarray:
    """Component of every row below one prefix of the least depth; rows come sorted by the rest of their labels.

    Starts at the full labels and shortens them one by one; stops once all rows hang together.
    """
    label, bits = np.arange(len(tails)), tail_bits(depth)
    for dropped in range(DEPTH - depth + 1):
        prefix = tails >> bits * dropped if dropped < DEPTH - depth else np.zeros_like(tails)
        cuts = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1], [True]]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > 1 and (label[a:b] != label[a]).any():
                now = hang_together(sketches[a:b], reach[a:b], label[a:b], most)
                label[a:b] = now
        if (label == label[0]).all():
            break
    return label


def edges_of(us: list[np.ndarray], vs: list[np.ndarray], sid: pa.Array) -> tuple[pa.Array, pa.Array]:
    return sid.take(pa.array(np.concatenate(us))), sid.take(pa.array(np.concatenate(vs)))


def leading(batches: Iterator[pa.RecordBatch], sets: int) -> Iterator[pa.RecordBatch]:
    """Labels of a slice of sets, sorted; of sets with one full label and nearly one sketch, only the leader's.

    Rows with a ``leader`` are no labels but say which set is left to which.
    """
    names = [c.split()[0] for c in LABELS.split(", ")]
    for batch in slices(gathered(batches, sets), sets):
        sid = batch.column(0)
        key = batch.column(1).flatten().to_numpy()
        tail = batch.column(2).flatten().to_numpy()
        sketch = batch.column(3).flatten().to_numpy().reshape(-1, 3)
        row = np.repeat(np.arange(batch.num_rows), TREES)
        order = np.lexsort((tail, key))
        key, tail, row = key[order], tail[order], row[order]
        cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (tail[1:] != tail[:-1]), [True]]))
        reach, stays = np.zeros(len(key), np.int64), np.ones(len(key), bool)
        us, vs = [], []
        many = np.flatnonzero(np.diff(cuts) > 1)
        for a, b in zip(cuts[many], cuts[many + 1]):
            leader, reach[a:b] = led(sketch[row[a:b]].view(np.uint64), reach[a:b], TIGHT)
            other = np.flatnonzero(leader != np.arange(b - a))
            stays[a + other] = False
            us.append(row[a + other])
            vs.append(row[a + leader[other]])
        kept = row[stays]
        values = sketch[kept]
        yield pa.RecordBatch.from_arrays([
            pa.array(key[stays]), pa.array(tail[stays]), sid.take(pa.array(kept)),
            pa.array(reach[stays].astype(np.int32)), *[pa.array(np.ascontiguousarray(values[:, i])) for i in range(3)],
            pa.nulls(len(kept), pa.binary())], names)
        if us := [x for x in us if len(x)]:
            pairs = np.unique(np.concatenate(us) * len(sid) + np.concatenate(vs))
            u, v = edges_of([pairs // len(sid)], [pairs % len(sid)], sid)
            # Dealt by the set's own identity, so evenly.
            zeros = pa.array(np.zeros(len(u), np.int64))
            spread = np.frombuffer(b"".join(x[:8] for x in u.to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(spread), zeros, u, zeros.cast(pa.int32()), zeros, zeros, zeros, v], names)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``rows``, but for the last."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def candidate_edges(
    batches: Iterator[pa.RecordBatch], depth: int, most: int, leaders: int
) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) that hang the candidates below every prefix together; rows come sorted by label.

    The rows of the prefix at hand are held until its end. Beyond ``leaders`` rows the leaders reach
    farther until half as many are left, so memory is bounded; what is compared in the end only grows by it.
    """
    held: pa.Table | None = None
    reach = np.empty(0, np.int64)

    def sketches(table: pa.Table) -> np.ndarray:
        return np.stack([table.column(i).to_numpy() for i in (4, 5, 6)], axis=1).view(np.uint64)

    def edges(table: pa.Table, us: np.ndarray, vs: np.ndarray) -> pa.RecordBatch:
        u, v = edges_of([us], [vs], table.column(2).combine_chunks())
        return pa.RecordBatch.from_arrays([u, v], ["u", "v"])

    def walked(table: pa.Table, reach: np.ndarray) -> Iterator[pa.RecordBatch]:
        key = table.column(0).to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        tails, values = table.column(1).to_numpy(), sketches(table)
        a = cuts[:-1][np.diff(cuts) == 2]  # most prefixes with company have two rows
        near = np.bitwise_count(values[a] ^ values[a + 1]).sum(axis=1) <= most + reach[a] + reach[a + 1]
        us, vs = [a[near] + 1], [a[near]]
        many = np.flatnonzero(np.diff(cuts) > 2)
        for a, b in zip(cuts[many], cuts[many + 1]):
            label = walk(tails[a:b], values[a:b], reach[a:b], depth, most)
            other = np.flatnonzero(label != np.arange(b - a))
            us.append(other + a)
            vs.append(label[other] + a)
        if sum(map(len, us)):
            yield edges(table, np.concatenate(us), np.concatenate(vs))

    for batch in batches:
        table = pa.Table.from_batches([batch])
        known = table.filter(table.column(7).is_valid())
        if known.num_rows:
            yield pa.RecordBatch.from_arrays(
                [known.column(2).combine_chunks(), known.column(7).combine_chunks()], ["u", "v"])
        table = table.filter(table.column(7).is_null())
        if not table.num_rows:
            continue
        reach = np.concatenate([reach, table.column(3).to_numpy().astype(np.int64)])
        held = pa.concat_tables([held, table]) if held is not None else table
        key = held.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))  # rows before it belong to prefixes that have ended
        if last:
            yield from walked(held.slice(0, last), reach[:last])
            held, reach = held.slice(last), reach[last:]
        tight = TIGHT
        if held.num_rows > leaders:
            while held.num_rows > leaders // 2:
                leader, reach = led(sketches(held), reach, tight)
                stays = leader == np.arange(len(leader))
                other = np.flatnonzero(~stays)
                if len(other):
                    yield edges(held, other, leader[other])
                held, reach = held.take(pa.array(np.flatnonzero(stays))), reach[stays]
                tight *= 2
    if held is not None and held.num_rows:
        yield from walked(held, reach)


def sets_for_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of every candidate, once for each tile of its group; texts of other sets are dropped."""
    for batch in slices(batches, 64):
        rows = []
        sets = shingle_sets(batch.column(0))
        for x, sid, cluster, copies, blocks in zip(sets, *(c.to_pylist() for c in batch.columns[1:])):
            x = x.tobytes()
            if xxhash.xxh3_128_digest(x) != sid:
                continue  # another text with the same doc_id
            block = int.from_bytes(sid[:6], "little") % blocks
            for other in range(blocks):
                rows.append((cluster, min(block, other), max(block, other), block, sid, copies, x))
        if rows:
            types = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                             ["cluster", "low", "high", "block", "sid", "copies", "shingles"])


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets have this Jaccard similarity; shared shingles are counted by matrix products."""
    sizes = np.array([len(x) for x in sets])
    rows = np.repeat(np.arange(len(sets)), sizes)
    _, columns, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[columns] > 1
    rows, columns = rows[shared], (np.cumsum(counts > 1) - 1)[columns[shared]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    common = np.zeros((len(sets), len(sets)))
    last = int(columns[-1]) + 1 if len(columns) else 0
    for at in range(0, last, COLUMNS):
        a, b = np.searchsorted(columns, [at, at + COLUMNS])
        present = np.zeros((len(sets), min(COLUMNS, last - at)), np.float32)
        present[rows[a:b], columns[a:b] - at] = 1
        common += present @ present.T
    union = sizes[:, None] + sizes[None, :] - common
    return common >= threshold * union - 1e-9


def linked(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Of every tile: links of each set, weighted by copies, and the set it hangs on."""
    for table in groups_of(slices(batches, 256), (0, 1, 2)):
        columns = [table.column(i).to_pylist() for i in range(3)]
        tiles = list(zip(*columns))
        cuts = [i for i in range(len(tiles)) if i == 0 or tiles[i] != tiles[i - 1]] + [len(tiles)]
        for a, b in zip(cuts, cuts[1:]):
            part = table.slice(a, b - a).to_pydict()
            at = list({sid: i for i, sid in enumerate(part["sid"])}.values())  # a repeated row counts once
            sets = [np.frombuffer(part["shingles"][i], np.uint64) for i in at]
            sids = [part["sid"][i] for i in at]
            near = similar(sets, threshold)
            np.fill_diagonal(near, False)
            block = np.array([part["block"][i] for i in at])
            if part["low"][0] != part["high"][0]:
                near &= block[:, None] != block[None, :]  # pairs of one block are those of another tile
            weights = near @ np.array([part["copies"][i] for i in at], np.int64)
            root, left = np.arange(len(at)), np.ones(len(at), bool)
            for i in range(len(at)):
                if left[i]:
                    front = np.zeros(len(at), bool)
                    front[i] = True
                    while front.any():
                        left &= ~front
                        root[front] = i
                        front = near[front].any(axis=0) & left
            yield pa.RecordBatch.from_arrays([
                pa.array(sids, pa.binary()), pa.array(weights, pa.int64()),
                pa.array([sids[r] for r in root], pa.binary())], ["sid", "links", "root"])


def near_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, n_links, kept, text_hash.

    Words are runs of other characters than ASCII white space; shingles are five words, or all words
    of a shorter text. ``n_links`` counts the other documents whose shingle sets have a Jaccard similarity
    of at least ``threshold``, copies included; ``class_id`` is the smallest doc_id that links lead to,
    and one row with it is ``kept`` of each class; ``text_hash`` is xxhash64 of the text. A null text or one without words links to nothing and is a class of its own. Repeated rows are
    documents of their own; a null doc_id comes before all others. Other columns are ignored; an
    empty table gives an empty result.
    """
    depth, most = depth_for(recall, threshold), sketch_distance(threshold)
    ids = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), "text")
    marked = checkpointed(ids.mapInArrow(lambda batches: signed(batches, depth), SIGNED)
                          .withColumn("row", F.monotonically_increasing_id()))
    lone = marked.where("n = 0")
    sets = checkpointed(marked.where("n > 0").groupBy("sid").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "row")).alias("first"),
        F.first("keys").alias("keys"), F.first("tails").alias("tails"), F.first("sketch").alias("sketch")))

    slice_of, leaders = SLICE, LEADERS
    labels = sets.select("sid", "keys", "tails", "sketch").mapInArrow(
        lambda batches: leading(batches, slice_of), LABELS)
    edges = labels.repartition("key").sortWithinPartitions("key", "tail").mapInArrow(
        lambda batches: candidate_edges(batches, depth, most, leaders), "u binary, v binary")
    clusters = checkpointed(components(edges).select(F.col("node").alias("sid"), F.col("component").alias("cluster")))
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"))
    # The text of a set is looked up by the doc_id of its first document.
    members = join_dealt(clusters, sizes, "cluster").join(sets.select("sid", "copies", "first"), "sid")
    key = lambda doc_id: F.coalesce(doc_id, F.lit(-(1 << 63))).alias("key")
    text = ids.select(key(F.col("doc_id")), "text").join(
        members.select(key(F.col("first.doc_id")), "sid", "cluster", "copies", "blocks"), "key")
    tiles = text.select("text", "sid", "cluster", "copies", "blocks").mapInArrow(sets_for_tiles, SETS)
    keys = ["cluster", "low", "high"]
    links = checkpointed(tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        lambda batches: linked(batches, threshold), LINKS))

    counted = links.groupBy("sid").agg(F.sum("links").alias("links"))
    classes = components(links.select(F.col("sid").alias("u"), F.col("root").alias("v")))
    placed = sets.select("sid", "copies", "first").join(counted, "sid", "left").join(
        classes.select(F.col("node").alias("sid"), F.col("component")), "sid", "left"
    ).withColumn("component", F.coalesce("component", "sid"))
    least = placed.groupBy("component").agg(F.min("first").alias("least"), F.sum("copies").alias("class_size"))
    by_set = join_dealt(placed.select("sid", "component", "copies", "links"), least, "component").select(
        "sid", "least", "class_size", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    found = join_dealt(marked.where("n > 0").select("doc_id", "row", "text_hash", "sid"), by_set, "sid").select(
        "doc_id", F.col("least.doc_id").alias("class_id"), "class_size", "n_links",
        (F.col("row") == F.col("least.row")).alias("kept"), "text_hash")
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return found.unionByName(lone.select(
        "doc_id", F.col("doc_id").alias("class_id"), one.alias("class_size"), zero.alias("n_links"),
        F.lit(True).alias("kept"), "text_hash"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with one document of each class of near duplicates."""
    kept = near_join(docs).where("kept").select("doc_id", F.col("text_hash").alias("tag"))
    return keep_rows(docs, kept, F.xxhash64("text"))


def op9_near_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_join(read_table(spark, folder, "documents"))
