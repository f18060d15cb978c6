"""Personal data: fixed patterns, and more identifiers found by bootstrapped contextual extraction.

The entities that the fixed patterns find are seeds. The two words before a mention are its lexical
pattern. Patterns and entities form a graph that Spark scores in rounds: a pattern is as reliable
for a kind as the share of its mentions that are entities of the kind; an entity that no fixed pattern
knows is of the kind with 1 - product(1 - reliability) over its patterns. Only patterns with enough
support and a high reliability count. Scores only grow, and rounds go on until they are settled. Unseen
identifiers that score high are added as spans.

Texts are read once; spans and mentions go to the checkpoint folder. Mentions are combined to weighted
edges before anything is joined, so a pattern or an entity with a third of all mentions is one row
per partner.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeframe.llm.common import checkpointed, read_table, slices

KINDS = ("email", "ip", "card", "phone")
LEAST_SUPPORT, LEAST_RELIABILITY, LEAST_SCORE = 3.0, 0.6, 0.8
SETTLED = 1e-6  # growth of all scores together in the last round
SMOOTHING = 1.0
SHORTEST = 5  # characters of an unseen identifier; shorter words stand for other things elsewhere
LONG = 64  # characters of words that are named by their digests
START = "\n"  # stands for a word before the text; no word has it

# Fixed values of the contract, written so that long runs take linear time: an address is looked for
# around each "@", and an ip starts where a run of digits starts.
LOCAL_CHARACTER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TELLING = re.compile(r"[0-9@][^\x20\t-\r]*")
WORDS = re.compile(r"\S+")
EDGES = ".,;:!?\"'()[]{}<>|*#&$"

SCANNED = ("doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
           "base array<struct<kind: int, start: int, end: int>>, "
           "mentions array<struct<kind: int, start: int, end: int, entity: string, pattern: string>>")


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARACTER:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """kind, start, end by kind and start."""
    found = [(0, *s) for s in emails(text)] if "@" in text else []
    return found + [(k, *s) for k, find in ((1, ips), (2, cards), (3, phones)) for s in find(text)]


def unseen_identifiers(text: str, known: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Words with a digit or "@" that overlap no known span, without the punctuation around them."""
    taken = sorted((s, e) for _, s, e in known)
    at = 0
    for m in TELLING.finditer(text):
        start, end = m.span()
        while start and text[start - 1] not in " \t\n\v\f\r":
            start -= 1
        while start < end and text[start] in EDGES:
            start += 1
        while start < end and text[end - 1] in EDGES:
            end -= 1
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if SHORTEST <= end - start and not (at < len(taken) and taken[at][0] < end):
            yield start, end


class Names:
    """Words of a text in lower case, and long ones by digests, so that no word is copied more than once."""

    def __init__(self, text: str):
        self.text, self.at, self.end, self.hash = text, -1, -1, hashlib.blake2b(digest_size=16)

    def of(self, start: int, end: int) -> str:
        """The name of text[start:end]; a prefix of the same word that grows from call to call is hashed once."""
        if end - start <= LONG:
            return self.text[start:end].lower()
        if start != self.at or end < self.end:
            self.at, self.end, self.hash = start, start, hashlib.blake2b(digest_size=16)
        self.hash.update(self.text[self.end:end].casefold().encode("utf-8", "surrogatepass"))
        self.end = end
        return START + self.hash.hexdigest()


def patterns_before(text: str, starts: list[int]) -> Iterator[str]:
    """The two words before each place, of whatever length; places come in order. START where there are fewer."""
    whole, part = Names(text), Names(text)
    before: list[str] = [START, START]
    words = WORDS.finditer(text)
    word = next(words, None)
    for start in starts:
        while word and word.end() <= start:
            before = [before[1], whole.of(*word.span())]
            word = next(words, None)
        if word and word.start() < start:  # within a word: what comes before counts as one
            yield f"{before[1]} {part.of(word.start(), start)}"
        else:
            yield " ".join(before)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1_000):
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            base = base_spans(text)
            counts = [0] * len(KINDS)
            for kind, _, _ in base:
                counts[kind] += 1
            places = sorted(base + [(-1, *s) for s in unseen_identifiers(text, base)], key=lambda x: x[1])
            names = Names(text)
            mentions = [{"kind": k, "start": s, "end": e, "entity": names.of(s, e), "pattern": p}
                        for (k, s, e), p in zip(places, patterns_before(text, [s for _, s, _ in places]))]
            rows.append((doc_id, *counts, [{"kind": k, "start": s, "end": e} for k, s, e in base], mentions))
        span = [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]
        types = [pa.int64()] * 5 + [pa.list_(pa.struct(span)), pa.list_(pa.struct(
            span + [("entity", pa.string()), ("pattern", pa.string())]))]
        fields = ["doc_id", *(f"n_{k}" for k in KINDS), "base", "mentions"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], fields)


def bootstrap(mentions: DataFrame) -> DataFrame:
    """entity, kind and score of unseen entities, from mentions (pattern, entity, kind; -1 if unseen).

    A higher score makes patterns more reliable and a more reliable pattern makes scores higher, so no score
    ever falls and rounds end; each is written to the checkpoint folder.
    """
    edges = checkpointed(mentions.groupBy("pattern", "entity", "kind").agg(F.count(F.lit(1)).alias("n")))
    sizes = edges.groupBy("pattern").agg(F.sum("n").alias("all"))
    seeds = edges.where("kind >= 0").select("pattern", "kind", "entity", "n", F.lit(1.0).alias("score"))
    unseen = edges.where("kind < 0").select("pattern", "entity", "n")
    scores, before = None, (0, 0.0)
    while True:
        known = seeds.select("pattern", "kind", "n", "score")
        if scores is not None:
            known = known.unionByName(unseen.join(scores, "entity").select("pattern", "kind", "n", "score"))
        reliable = (
            known.groupBy("pattern", "kind")
            .agg(F.sum("score").alias("support"), F.sum(F.col("n") * F.col("score")).alias("good"))
            .where(F.col("support") >= LEAST_SUPPORT).join(sizes, "pattern")
            .withColumn("reliability", F.col("good") / (F.col("all") + SMOOTHING))
            .where(F.col("reliability") >= LEAST_RELIABILITY).select("pattern", "kind", "reliability")
        )
        doubt = F.sum(F.log(F.lit(1.0) - F.least("reliability", F.lit(0.999999))))
        scores = checkpointed(
            unseen.join(reliable, "pattern").groupBy("entity", "kind").agg((1 - F.exp(doubt)).alias("score"))
        )
        after = scores.agg(F.count(F.lit(1)), F.coalesce(F.sum("score"), F.lit(0.0))).first()
        if after[0] == before[0] and after[1] - before[1] < SETTLED:
            return scores
        before = after


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Whole texts; null is empty. Spans are ``kind:start:end`` in code points, end exclusive, by kind in
    the order of KINDS and then by start. Counts and base_sha256 are those of the fixed patterns; spans
    adds the identifiers found in context, each with its best kind (ties: the first). Repeated rows
    give repeated rows; other columns are ignored; an empty table gives an empty result.
    """
    scanned = checkpointed(
        docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scan, SCANNED)
        .withColumn("row", F.monotonically_increasing_id()))
    mentions = scanned.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    scores = bootstrap(mentions.select("pattern", "entity", "kind")).where(F.col("score") >= LEAST_SCORE)
    best = scores.groupBy("entity").agg(
        F.max(F.struct("score", (-F.col("kind")).alias("lost"))).alias("best")
    ).select("entity", (-F.col("best.lost")).alias("found"))
    added = (
        mentions.where("kind < 0").join(best, "entity").groupBy("row")
        .agg(F.collect_list(F.struct(F.col("found").alias("kind"), "start", "end")).alias("added"))
    )
    kind = F.array(*map(F.lit, KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kind, s.kind + 1), s.start, s.end)), ",")
    everything = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(
        "array<struct<kind: int, start: int, end: int>>"))))
    return scanned.join(added, "row", "left").select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(everything).alias("spans"))


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    return find_personal_data(read_table(spark, folder, "documents"))
