"""Language identification by hierarchical discrimination.

Linear support vector machines over hashed letter bigrams and trigrams: one-versus-rest machines choose the
language family, then a one-versus-one machine for each pair of languages of that family votes.
Languages of a family are close relatives, which a flat classifier confuses most.

The machines are fitted on the driver from a sample of about ``SAMPLE_DOCS`` labelled documents in equal
shares per language, never more than twice that; only their sparse counts are collected. Predictions
read every whole text where it lies and shuffle nothing.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeframe.llm.common import read_table

SAMPLE_DOCS = 1_200
DIMENSIONS = 1 << 12
STEPS, COST, SLOPE = 100, 10.0, 4.0
UNKNOWN = "und"

# Language families by ISO 639-1 code. Other labels are families of their own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl no nb nn sv",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "am ar he mt",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


class Letters:
    """Which code points are letters; built once per worker."""

    table: np.ndarray | None = None

    @classmethod
    def among(cls, codes: np.ndarray) -> np.ndarray:
        if cls.table is None:
            cls.table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        return cls.table[codes]


def gram_counts(text: str | None) -> np.ndarray | None:
    """Hashed bigram and trigram counts of the letters, words set apart; None without a letter."""
    if not text:
        return None
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = Letters.among(codes)
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    two = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + codes[2:] * np.uint32(0x27D4EB2F)
    some = letter[:-1] | letter[1:]  # not between two separators
    grams = np.concatenate([two[some], three[some[:-1] | letter[2:]]])
    return np.bincount((grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20), minlength=DIMENSIONS)


def unit(counts: np.ndarray) -> np.ndarray:
    scaled = np.sqrt(counts.astype(np.float64))
    return scaled / np.sqrt((scaled * scaled).sum())


def fit_machine(rows: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, the bias last; accelerated gradient descent."""
    side = np.where(positive, 1.0, -1.0).astype(np.float32)
    share = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1)) * len(side)
    x = np.hstack([rows, np.ones((len(rows), 1))]).astype(np.float32)
    cost = (COST * share / len(side)).astype(np.float32)
    bound = np.float32(1 / len(side) + 2 * (cost * (x * x).sum(axis=1)).sum())
    weights = ahead = np.zeros(x.shape[1], np.float32)
    for step in range(STEPS):
        slack = np.maximum(0, 1 - side * (x @ ahead))
        gradient = ahead / len(side) - 2 * x.T @ (cost * side * slack)
        before, weights = weights, ahead - gradient / bound
        ahead = weights + step / (step + 3) * (weights - before)
    return weights.astype(np.float64)


class Model:
    """Families with their languages, a machine per family and one per pair of languages of a family."""

    def __init__(self, rows: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({FAMILY_OF.get(x, x) for x in self.langs})
        self.members = [[x for x in self.langs if FAMILY_OF.get(x, x) == f] for f in self.families]
        own = np.array(langs)
        family = np.array([FAMILY_OF.get(x, x) for x in langs])
        machines, self.pairs = [], []
        if len(self.families) > 1:
            machines += [fit_machine(rows, family == f) for f in self.families]
        self.first = len(machines)
        for members in self.members:
            for a, b in combinations(members, 2):
                here = (own == a) | (own == b)
                machines.append(fit_machine(rows[here], own[here] == a))
                self.pairs.append((a, b))
        self.weights = np.array(machines).T if machines else np.zeros((DIMENSIONS + 1, 0))

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = gram_counts(text) if self.langs else None
        if counts is None:
            return UNKNOWN, 0.0
        margins = unit(counts) @ self.weights[:-1] + self.weights[-1]
        sure, at = 1.0, 0
        if self.first:
            chances = np.exp(SLOPE * (margins[:self.first] - margins[:self.first].max()))
            at = int(chances.argmax())
            sure = chances[at] / chances.sum()
        members = self.members[at]
        won = dict.fromkeys(members, 0.0)
        for (a, b), margin in zip(self.pairs, margins[self.first:]):
            if a in won:
                chance = 1 / (1 + np.exp(-SLOPE * margin))
                won[a] += (margin > 0) + chance / 1_000
                won[b] += (margin <= 0) + (1 - chance) / 1_000
        best = max(members, key=lambda x: won[x])
        if len(members) > 1:  # mean chance of the winner against its relatives
            own = [m if a == best else -m for (a, b), m in zip(self.pairs, margins[self.first:]) if best in (a, b)]
            sure *= float(np.mean(1 / (1 + np.exp(-SLOPE * np.array(own)))))
        return best, float(sure)


def held_out() -> Column:
    """Documents nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Model:
    """The model learned from a sample of the labelled documents that are not held out."""

    @F.arrow_udf("binary")
    def sparse(text: pa.Array) -> pa.Array:
        out = []
        for value in text.to_pylist():
            counts = gram_counts(value)
            at = np.flatnonzero(counts) if counts is not None else np.empty(0, int)
            out.append(np.stack([at, counts[at]]).astype(np.int32).tobytes() if len(at) else None)
        return pa.array(out, pa.binary())

    labelled = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    quota = sample / max(len(sizes), 1)
    share = F.coalesce(*[F.when(F.col("lang") == x, quota / n) for x, n in sorted(sizes.items())], F.lit(0.0))
    drawn = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) < share * float(1 << 30)
    rows, langs = [], []
    for r in labelled.where(drawn).limit(2 * sample).select("lang", sparse(F.col("text")).alias("grams")).collect():
        if r.grams is not None:
            at, counts = np.frombuffer(r.grams, np.int32).reshape(2, -1)
            row = np.zeros(DIMENSIONS)
            row[at] = counts
            rows.append(unit(row))
            langs.append(r.lang)
    return Model(np.array(rows) if rows else np.zeros((0, DIMENSIONS)), langs)


def predicted(model: Model, text: Column) -> Column:
    """Struct of lang_pred and score."""

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(text: pa.Array) -> pa.Array:
        langs, scores = [], []
        for value in text.to_pylist():
            lang, score = model.predict(value)
            langs.append(lang)
            scores.append(score)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                          ["lang_pred", "score"])

    return predict(text)


def lettered(text: Column) -> Column:
    """Whether the text has a letter."""

    @F.arrow_udf("boolean")
    def has_letter(text: pa.Array) -> pa.Array:
        return pa.array([any(map(str.isalpha, value or "")) for value in text.to_pylist()], pa.bool_())

    return has_letter(text)


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    ``und`` with score 0 if the text is null or has no letter, or if nothing could be learned (no labelled
    document). A document without doc_id is neither learned from nor held out. Repeated rows give
    repeated rows; other columns are ignored; an empty table gives an empty result.
    """
    guess = predicted(fit(docs), F.col("text"))
    return docs.select("doc_id", held_out().alias("held_out"), guess.alias("g")).select(
        "doc_id", "held_out", "g.lang_pred", "g.score")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents, all columns, without those whose language is ``und``.

    A language can be told of every text with a letter, so only null and letterless texts go. Where nothing
    could be learned, ``und`` says nothing about a text, and those with a letter stay.
    """
    model = fit(docs)
    known = F.col("guess.lang_pred") != UNKNOWN if model.langs else F.col("guess")
    guess = predicted(model, F.col("text")) if model.langs else lettered(F.col("text"))
    return docs.select(F.struct("*").alias("doc"), guess.alias("guess")).where(known).select("doc.*")


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    return identify(read_table(spark, folder, "documents"))
