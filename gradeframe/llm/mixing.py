"""Mixing sources to target weights: Efraimidis-Spirakis sampling in complete epochs and a rest.

A source's target is that many times its size: the whole times are complete epochs in which every
document takes part, the rest is filled in the order of exponential keys ``-ln(u) / quality``, where
``u`` is a fixed hash of the doc_id, so reruns agree.

The order within a source needs no sort of the source: keys fall into about sqrt(n) ordered buckets,
bucket sizes are summed before the shuffle, and only the one bucket in which the budget ends is
sorted. So a source with a third of all rows costs two small windows of about sqrt(n) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gradeframe.llm.common import WORD, checkpointed, read_table

# Fixed values of the mixing contract.
WEIGHTS, SHARE, MOST_TIMES = (3, 1, 2), 1.5, 2
SEED = 7
# Words of prose have 3 to 12 characters on average, with the space; other texts count for less.
PROSE_WORD, PROSE_QUALITY, OTHER_QUALITY = (3.0, 12.0), 1.0, 0.25


def prose_quality(chars: str, size: str) -> Column:
    per_word = F.col(chars) / F.greatest(F.col(size), F.lit(1))
    return F.when(per_word.between(*PROSE_WORD), PROSE_QUALITY).otherwise(OTHER_QUALITY)


def source_targets(sizes: DataFrame) -> DataFrame:
    """Target of every source, from source and source_size.

    Sources in code point order, null last, weigh WEIGHTS in turn and share SHARE of all sizes. With
    the caps in the order of cap / weight, those that bind are a prefix: the first level that is not
    above the next cap holds for all sources behind it. One row per source, so one window serves.
    """
    cap = F.col("source_size") * MOST_TIMES
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(
        Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("weight", weight).withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("all_words", F.sum("source_size").over(everything) * F.lit(SHARE))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)))
        .withColumn("used", F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
        .withColumn("level", (F.col("all_words") - F.col("capped")) / (F.col("all_weight") - F.col("used")))
        .withColumn("share", F.min(F.when(F.col("level") <= F.col("ratio"),
                                          F.struct("ratio", "level", "all_words", "capped", "all_weight", "used"))
                                   ).over(everything))
        .withColumn("target", F.when(
            F.col("share").isNull() | (F.col("ratio") < F.col("share.ratio")), F.col("cap").cast("double")
        ).otherwise(F.least(
            F.col("cap").cast("double"),
            F.col("weight") * (F.col("share.all_words") - F.col("share.capped"))
            / (F.col("share.all_weight") - F.col("share.used")))))
        .select("source", "source_size", "target")
    )


def mix(docs: DataFrame, seed: int = SEED, **also: Column) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    ``size`` counts the runs of other characters than ASCII white space; null and empty texts have
    size 0 and nothing is taken of them. ``taken`` is size times the complete epochs, plus what the
    fractional selection takes; the one document of a source in which the budget ends gives a part,
    so taken words sum to the target rounded. Ties of keys are ordered by doc_id and size. A null
    source is a source of its own. Repeated rows are documents of their own. Other columns are
    ignored, but ``also`` names more columns to compute and return; an empty table gives an empty result.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(2**52)) + 0.5) / float(2**52)
    sized = checkpointed(
        docs.select("doc_id", "source", F.length("text").alias("chars"), size.alias("size"), uniform.alias("u"),
                    *[c.alias(n) for n, c in also.items()])
    )
    quality = prose_quality("chars", "size")
    # 1 - exp(-key) grows with the key and stays within 0 and 1, as buckets need.
    keyed = sized.select("doc_id", "source", "size", *also, (1 - F.pow("u", 1 / quality)).alias("at"))

    totals = keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = source_targets(totals.select("source", "source_size"))
    epochs = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))
    plan = (
        totals.select(F.col("source").alias("s"), "n").join(targets, F.col("s").eqNullSafe(F.col("source")))
        .select("source", "source_size", "target", epochs.alias("epochs"),
                F.ceil(F.sqrt("n")).alias("buckets"))
        .withColumn("rest", F.round("target").cast("bigint") - F.col("epochs") * F.col("source_size"))
    )
    same = F.col("k.source").eqNullSafe(F.col("p.source"))
    placed = keyed.alias("k").join(plan.alias("p"), same).select(
        "doc_id", *also, "k.source", "size", "at", "source_size", "target", "epochs", "rest",
        F.floor(F.col("at") * F.col("buckets")).alias("bucket"))

    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        placed.groupBy("source", "bucket", "rest").agg(F.sum("size").alias("words"))
        .withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .where((F.col("start") < F.col("rest")) & (F.col("start") + F.col("words") >= F.col("rest")))
        .select("source", F.col("bucket").alias("end"), "start")
    )
    marked = placed.alias("d").join(
        ends.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")), "left"
    ).select("d.*", "end", "start")
    whole = F.when(F.col("bucket") < F.col("end"), F.col("size")).otherwise(0)
    plain = marked.where("end is null or bucket <> end").withColumn("part", F.when(F.col("end").isNull(), 0).otherwise(whole))
    ahead = Window.partitionBy("source").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("start") - F.coalesce(F.sum("size").over(ahead), F.lit(0))
    cut = marked.where("bucket = end").withColumn("part", F.greatest(F.least("size", left), F.lit(0)))
    return plain.unionByName(cut).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("epochs") + F.col("part")).cast("bigint").alias("taken"), *also)


def take(docs: DataFrame) -> DataFrame:
    """The documents of the mix, all columns, as often as they are taken.

    Documents stay whole: the one in which a source's budget ends is taken once more as a whole. Rows
    that repeat doc_id, source and text are taken equally often.
    """
    key = lambda: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("key")
    times = (
        mix(docs, text_hash=F.xxhash64("text"), origin=F.xxhash64("source")).where("taken > 0")
        .groupBy(key(), "text_hash", "origin").agg(F.max(F.ceil(F.col("taken") / F.col("size"))).alias("times"))
    )
    named = docs.select(F.struct("*").alias("doc"), key(), F.xxhash64("text").alias("text_hash"),
                        F.xxhash64("source").alias("origin"))
    return named.join(times, ["key", "text_hash", "origin"]).select(
        "doc", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("nth")).select("doc.*")


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(read_table(spark, folder, "documents"))
