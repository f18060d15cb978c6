"""Cross-tokenizer alignment: groups, links and corpus-wide link counts between the tokens of two vocabularies.

A text's bytes are cut into tokens by A and by B. Where both cut, a group ends; two tokens are linked where their
bytes overlap. Between two cuts of either side lies one link, so a group of one A and one B token is one link.

Texts are cut into pieces where both vocabularies always cut: where A's pattern starts a token (``pieces``), and no
piece of B holds the two bytes on both sides. Each distinct piece is encoded and aligned once per worker
(``Aligned``). Two passes:

1. Counting. A task counts how often it meets each piece. Groups of one token on either side whose B id is the
   one that A's id stands for in the identity map (A id to the B id of the same bytes) are counted in a vector as
   long as A's vocabulary; only the links of other groups are counted as pairs. Vectors and pairs leave the
   task combined, one row per pair.
2. Scoring. The most frequent pairs (at most ``FREQUENT``) and the highest count of each B id are broadcast; a piece's
   links are looked up once. What the table does not hold is joined with the pair counts by pair. A pair outside
   the table has at most 2 / FREQUENT of all links, so no join key is hot.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeframe.llm.common import read_table, stored, tokenizer_path
from gradeframe.llm.pieces import ASKED, buffer_of, cached, cuts, items_of, load_tokenizer, parts_of
from gradeframe.llm.token_files import BYTE_TOKENIZER

PIECE_MODEL = "piece_bpe_32k.model"
FREQUENT = 1 << 18  # pairs of the broadcast table
CACHE_ENTRIES, CACHE_LINKS = 700_000, 12_000_000
PAIRS_HELD = 2_000_000  # pairs a task combines before it passes them on
SPACE_MARK = "▁"  # B's sign for a space; texts that hold it are encoded whole
SHIFT = 32  # a pair is (A id << SHIFT) + B id
NO_PIECE = -1
COUNTED = "pair bigint, n bigint"
SCORED = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
          "groups_sha256 string, missing array<struct<pair: bigint, n: bigint>>")
MISSING = pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())]))


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if printable, else counted from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Vocabularies:
    """Both tokenizers, the bytes of their tokens, and the identity map."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = load_tokenizer(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        entries = self.a.get_vocab()
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for token, number in entries.items():
            self.a_bytes[number] = bytes(alphabet[c] for c in token)
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else
                        self.b.id_to_piece(i).replace(SPACE_MARK, " ").encode() for i in range(self.b.get_piece_size())]
        # Of pieces with the same bytes the plain one comes before a single byte.
        same = {data: i for i, data in sorted(enumerate(self.b_bytes), key=lambda x: (not self.b.is_byte(x[0]), -x[0]))
                if data and not self.b.is_control(i) and not self.b.is_unknown(i)} | {
            data: i for i, data in enumerate(self.b_bytes)
            if data and not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))}
        self.identity = np.array([same.get(data, NO_PIECE) for data in self.a_bytes], np.int64)
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        # Which byte may follow which in a token of B; merges never join others.
        self.joined = np.zeros((256, 256), bool)
        for data in self.b_bytes:
            values = np.frombuffer(data, np.uint8)
            self.joined[values[:-1], values[1:]] = True
        # A line feed is a byte of its own in B, so what follows it is encoded as within a text.
        self.apart = self.b.encode("\n")

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both; B adds a space at the start by itself, which is not wanted within a word."""
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] if t.startswith(" ") else "\n" + t for t in texts], num_threads=1)
        skip = len(self.apart)
        return a, [ids if t.startswith(" ") else ids[skip:] for t, ids in zip(texts, b)]

    def whole(self, a: list[int], b: list[int], data: bytes) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a)) == data == b"".join(map(self.b_bytes.__getitem__, b))


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    count = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(count.sum())), count


class Alignment:
    """Groups and links of pieces of text that both vocabularies give back byte by byte."""

    def __init__(self, words: Vocabularies, pieces: list[bytes]):
        a, b = words.encode([p.decode("utf-8", "replace") for p in pieces])
        self.good = np.ones(len(pieces), bool)
        joined = b"".join(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        (a_ids, a_count), (b_ids, b_count) = flat(a), flat(b)
        if not (words.whole(a_ids.tolist(), b_ids.tolist(), joined) and self.ends_agree(words, a_ids, a_count, b_ids, b_count, sizes)):
            self.good[:] = [words.whole(x, y, data) for x, y, data in zip(a, b, pieces)]
            a, b = ([ids if ok else [] for ids, ok in zip(x, self.good)] for x in (a, b))
            sizes = np.where(self.good, sizes, 0)
            (a_ids, a_count), (b_ids, b_count) = flat(a), flat(b)
        self.n_a, self.n_b = a_count, b_count
        a_end, b_end = np.cumsum(words.a_size[a_ids]), np.cumsum(words.b_size[b_ids])
        both = a_end[b_end[np.minimum(np.searchsorted(b_end, a_end), len(b_end) - 1)] == a_end] if len(a_end) else a_end  # ends of groups
        cut = np.sort(np.concatenate([a_end, b_end]), kind="stable")
        cut = cut[np.append(cut[1:] != cut[:-1], True)] if len(cut) else cut  # ends of links
        a_at, b_at = np.searchsorted(a_end, cut), np.searchsorted(b_end, cut)
        self.pair = a_ids[a_at] << SHIFT | b_ids[b_at]
        ends = np.cumsum(sizes)
        owner = np.searchsorted(ends, cut)
        self.n_links = np.bincount(owner, minlength=len(pieces))
        self.n_groups = np.bincount(np.searchsorted(ends, both), minlength=len(pieces))
        group = np.searchsorted(both, cut)
        alone = np.bincount(group, minlength=len(both)) == 1
        self.regular = alone[group] & (words.identity[a_ids[a_at]] == b_ids[b_at])
        self.text = self.texts(a_ids, b_ids, a_end, b_end, both, ends[sizes > 0], self.good & (sizes > 0))

    @staticmethod
    def ends_agree(words, a_ids, a_count, b_ids, b_count, sizes) -> bool:
        """Whether both give every piece as many bytes as it has."""
        ends = np.cumsum(sizes)
        return all(np.array_equal(np.concatenate([[0], np.cumsum(size[ids])])[np.cumsum(count)], ends)
                   for size, ids, count in ((words.a_size, a_ids, a_count), (words.b_size, b_ids, b_count)))

    @staticmethod
    def texts(a_ids, b_ids, a_end, b_end, both, piece_ends, there) -> list[bytes]:
        """Groups of every piece as ``a1,a2|b1;...``."""
        side = np.concatenate([2 * np.searchsorted(both, a_end), 2 * np.searchsorted(both, b_end) + 1])
        order = np.argsort(side, kind="stable")
        side, ids = side[order], np.concatenate([a_ids, b_ids])[order]
        ends = np.ones(len(side), bool)
        ends[:-1] = side[1:] != side[:-1]
        last = np.zeros(len(both), bool)
        last[np.searchsorted(both, piece_ends)] = True
        last = last[side // 2]
        sign = np.where(~ends, 0, np.where(side % 2 == 0, 1, np.where(last, 3, 2)))
        found = "".join(chain.from_iterable(zip(map(str, ids.tolist()), map(",|;\n".__getitem__, sign.tolist())))).encode().split(b"\n")
        if there.all():
            return found[:-1]
        found = iter(found)
        return [next(found) if x else b"" for x in there.tolist()]


class Aligned:
    """Alignments of pieces met so far; beyond its bounds it keeps the half that was met most often."""

    def __init__(self, words: Vocabularies, entries: int = CACHE_ENTRIES):
        self.words, self.entries = words, entries
        self.forget()

    @classmethod
    def of(cls, a_path: str, b_path: str, **options) -> Aligned:
        return cls(Vocabularies(a_path, b_path), **options)

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.text: list[bytes] = []
        self.columns = {c: np.empty(0, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links", "first", "met")}
        self.good = self.regular = np.empty(0, bool)
        self.pair = np.empty(0, np.int64)
        self.scored, self.table = 0, None

    def trim(self) -> None:
        """Within bounds again: forgets all but the pieces met most often, at most half of the entries."""
        if len(self.index) <= self.entries and len(self.pair) <= CACHE_LINKS:
            return
        met = self.columns["met"]
        stay = np.sort(np.argsort(-met, kind="stable")[:len(met) // 2])
        stay = stay[met[stay] > 1]
        links = self.links_of(stay)
        self.pair, self.regular, self.good = self.pair[links], self.regular[links], self.good[stay]
        self.columns = {c: values[stay] for c, values in self.columns.items()}
        self.columns["first"] = np.cumsum(self.columns["n_links"]) - self.columns["n_links"]
        self.columns["met"] = np.zeros(len(stay), np.int64)
        pieces = list(self.index)
        self.index = {pieces[i]: n for n, i in enumerate(stay.tolist())}
        self.text = [self.text[i] for i in stay.tolist()]
        self.scored, self.table = 0, None

    def learn(self, pieces: list[bytes]) -> None:
        for at in range(0, len(pieces), ASKED):
            own = pieces[at:at + ASKED]
            new = Alignment(self.words, own)
            self.index.update(zip(own, range(len(self.index), len(self.index) + len(own))))
            first = len(self.pair) + np.cumsum(new.n_links) - new.n_links
            for name, values in (("n_a", new.n_a), ("n_b", new.n_b), ("n_groups", new.n_groups), ("n_links", new.n_links),
                                 ("first", first), ("met", np.zeros(len(own), np.int64))):
                self.columns[name] = np.concatenate([self.columns[name], values])
            self.text += new.text
            self.good, self.regular, self.pair = (np.concatenate(x) for x in (
                (self.good, new.good), (self.regular, new.regular), (self.pair, new.pair)))

    def numbers(self, pieces: pa.Array) -> np.ndarray:
        encoded = pieces.dictionary_encode()
        distinct = items_of(encoded.dictionary)
        new = [p for p in distinct if p not in self.index]
        if new:
            self.learn(new)
        if not len(pieces):
            return np.empty(0, np.int64)
        number = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))
        self.columns["met"][number] += np.bincount(encoded.indices.to_numpy(), minlength=len(distinct))
        return number[encoded.indices.to_numpy()]

    def read(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of every piece, and the first piece of each text (one more at the end).

        A text that is not made of pieces that both vocabularies give back is one piece, whole.
        """
        text = text.fill_null("")
        spaced = pc.if_else(pc.equal(pc.binary_length(text), 0), "", pc.binary_join_element_wise(" ", text, ""))
        marked = pc.match_substring(text, SPACE_MARK).to_numpy(zero_copy_only=False)
        number, first = self.cut(spaced, marked)
        bad = np.add.reduceat(np.concatenate([~self.good[number], [False]]), np.minimum(first[:-1], len(number))) if len(text) else first
        bad = (bad > 0) & (np.diff(first) > 1)
        return self.cut(spaced, marked | bad) if bad.any() else (number, first)

    def cut(self, text: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data, ends = buffer_of(text)
        start = cuts(data, "byte", None)
        start[1:] &= ~self.words.joined[data[:-1], data[1:]]
        if whole.any():
            start &= np.repeat(~whole, np.diff(ends))
        start[ends[:-1][ends[:-1] < ends[1:]]] = True
        at = np.flatnonzero(start)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [
            None, pa.py_buffer(np.append(at, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        return self.numbers(pieces), np.searchsorted(at, ends)

    def links_of(self, number: np.ndarray) -> np.ndarray:
        """Places in ``pair`` of all links of these pieces."""
        count = self.columns["n_links"][number]
        ends = np.cumsum(count)
        return np.repeat(self.columns["first"][number] - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)

    def score(self, table: PairTable) -> None:
        """Best links, counts and links outside the table of every piece that has none yet."""
        if self.table is not table:
            self.table, self.scored = table, 0
            self.best = self.sum = self.outside = np.empty(0, np.int64)
        begin = int(self.columns["first"][self.scored]) if self.scored < len(self.text) else len(self.pair)
        count, best, known = table.look_up(self.pair[begin:])
        firsts = np.append(self.columns["first"][self.scored:] - begin, len(count))
        for name, values in (("best", best & known), ("sum", np.where(known, count, 0)), ("outside", ~known)):
            total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
            setattr(self, name, np.concatenate([getattr(self, name), np.diff(total[firsts])]))
        self.scored = len(self.text)


class PairTable:
    """Counts of the frequent pairs, and the highest count of each B id."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, best: np.ndarray):
        order = np.argsort(pairs)
        self.pairs, self.counts, self.best = pairs[order], counts[order], best

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count of each pair, whether it is its B id's highest, and whether the pair is in the table."""
        if not len(self.pairs):
            return np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool), np.zeros(len(pairs), bool)
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        count, b_id = self.counts[at], np.minimum(pairs & (1 << SHIFT) - 1, len(self.best) - 1)
        return count, count == self.best[b_id], self.pairs[at] == pairs


class Counts:
    """How often a task met each pair: a vector over A's ids for the identity map, sorted pairs for others."""

    def __init__(self, words: Vocabularies):
        self.words = words
        self.vector = np.zeros(len(words.identity), np.int64)
        self.pairs = self.n = np.empty(0, np.int64)

    def add(self, cache: Aligned, number: np.ndarray) -> None:
        seen = np.bincount(number, minlength=len(cache.text))
        met = np.flatnonzero(seen)
        at = cache.links_of(met)
        times = np.repeat(seen[met], cache.columns["n_links"][met])
        regular = cache.regular[at]
        a_ids = cache.pair[at[regular]] >> SHIFT
        self.vector += np.bincount(a_ids, times[regular], len(self.vector)).astype(np.int64)  # exact below 2^53
        pairs, own = np.unique(np.concatenate([self.pairs, cache.pair[at[~regular]]]), return_inverse=True)
        n = np.concatenate([self.n, times[~regular]])
        self.n = np.bincount(own, n, len(pairs)).astype(np.int64)
        self.pairs = pairs

    def taken(self) -> Iterator[pa.RecordBatch]:
        a_ids = np.flatnonzero(self.vector)
        pairs = np.concatenate([a_ids << SHIFT | self.words.identity[a_ids], self.pairs])
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(np.concatenate([self.vector[a_ids], self.n]))],
                                             ["pair", "n"])
        self.__init__(self.words)


def count_pairs(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    """Pairs of the links of a task's texts, and how many links each has."""
    cache = cached((a_path, "aligned", b_path), lambda: Aligned.of(a_path, b_path))
    counts = Counts(cache.words)
    for batch in batches:
        for _, text in parts_of(batch.column(0)):
            cache.trim()
            number, _ = cache.read(text)
            counts.add(cache, number)
            if len(counts.pairs) > PAIRS_HELD:
                yield from counts.taken()
    yield from counts.taken()


def score_texts(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, table: PairTable) -> Iterator[pa.RecordBatch]:
    """What a document's row needs, with the links that the table does not hold."""
    cache = cached((a_path, "aligned", b_path), lambda: Aligned.of(a_path, b_path))
    for batch in batches:
        for at, text in parts_of(batch.column(1)):
            cache.trim()
            number, first = cache.read(text)
            cache.score(table)
            summed = lambda values: np.diff(np.concatenate([[0], np.cumsum(values[number])])[first])  # noqa: E731, B023
            columns = [summed(cache.columns[c]) for c in ("n_a", "n_b", "n_groups", "n_links")]
            columns += [summed(cache.best), summed(cache.sum)]
            names = list(map(cache.text.__getitem__, number.tolist()))
            digests = [hashlib.sha256(b";".join(names[a:b])).hexdigest() if n else ""
                       for n, a, b in zip(columns[0].tolist(), first.tolist(), first[1:].tolist())]
            missing: list[list[dict] | None] = [None] * len(text)
            holding = np.flatnonzero(cache.outside[number])
            if len(holding):
                links = cache.links_of(number[holding])
                owner = np.repeat(np.searchsorted(first, holding, side="right") - 1, cache.columns["n_links"][number[holding]])
                outside = ~table.look_up(cache.pair[links])[2]
                found, n = np.unique(np.stack([owner[outside], cache.pair[links[outside]]]), axis=1, return_counts=True)
                for doc, pair, times in zip(*found.tolist(), n.tolist()):
                    missing[doc] = (missing[doc] or []) + [{"pair": pair, "n": times}]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(text)), *map(pa.array, columns), pa.array(digests, pa.string()),
                 pa.array(missing, MISSING)],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "missing"])


def frequent_pairs(pairs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent pairs and their counts: those of as many powers of two, from the top, as hold at most ``most``."""
    by_size = pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).count().orderBy(F.desc("size")).collect()
    held, least = 0, None
    for row in by_size:  # one for each power of two
        held += row["count"]
        if held > most:
            break
        least = row["size"]
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    table = pairs.where(F.floor(F.log2("n")) >= least).select("pair", "n").toArrow()
    return table["pair"].to_numpy(), table["n"].to_numpy()


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes a space and the text, B the text, to which it adds a space; special strings are plain text.
    Null and empty texts, and texts that the tokens of A or B do not give back byte by byte, have no tokens:
    zeros and an empty string. ``n_best`` counts the links whose pair has the highest count of its B id, ties
    included; ``count_sum`` adds the counts of all links. Repeated rows are documents of their own, also in the
    counts; other columns are ignored; an empty table gives an empty result.
    """
    a_path, b_path = a_path or tokenizer_path(BYTE_TOKENIZER), b_path or tokenizer_path(PIECE_MODEL)
    context = docs.sparkSession.sparkContext
    counted = docs.select("text").mapInArrow(lambda batches: count_pairs(batches, a_path, b_path), COUNTED)
    pairs = stored(counted.groupBy("pair").agg(F.sum("n").alias("n")))
    b_id = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    # At most one row for each id of B's vocabulary.
    highest = pairs.groupBy(b_id.cast("int").alias("b")).agg(F.max("n").alias("best"))
    best = highest.toArrow()
    b_ids, most = best["b"].to_numpy(), best["best"].to_numpy()
    vector = np.zeros(int(b_ids.max(initial=0)) + 1, np.int64)
    vector[b_ids] = most
    table = context.broadcast((*frequent_pairs(pairs, frequent), vector))
    name = uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cached(("pairs", "table", name), lambda: PairTable(*table.value))
        yield from score_texts(batches, a_path, b_path, own)

    scored = stored(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(score, SCORED).withColumn(
        "row", F.monotonically_increasing_id()))
    missing = scored.where("missing is not null").select("row", F.explode("missing").alias("m")).select("row", "m.*")
    known = pairs.select("pair", F.col("n").alias("count"), b_id.cast("int").alias("b"))
    rest = (
        missing.join(known, "pair").join(F.broadcast(highest), "b").groupBy("row").agg(
            F.sum(F.when(F.col("count") == F.col("best"), F.col("n")).otherwise(0)).alias("more_best"),
            F.sum(F.col("n") * F.col("count")).alias("more_sum")))
    more = lambda column, extra: (F.col(column) + F.coalesce(extra, F.lit(0))).alias(column)
    return scored.join(rest, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", more("n_best", "more_best"), more("count_sum", "more_sum"), "groups_sha256")


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align(read_table(spark, folder, "documents"))
