"""Mixing sources to target weights by weighted fair queueing.

Every document of a source waits in a queue in the order of a hash of its id. Its
virtual finish time is the number of words of its source up to its own end, divided by
the source's target. Documents of all sources, each queued once and once again, are
sorted by virtual finish time over range partitions and cut where the total budget is
spent. So at every point of the order the sources stand in the ratio of their targets,
and a source that reaches its target does so when all others do.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.store import dropped, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUDGET_SHARE = 1.5
PASSES = 2
# Documents of a source that are put in order together, and buckets whose totals are.
BUCKET_ROWS = 512
BUCKETS_TOGETHER = 1024
# Sources that may be broadcast: a row has a name and a few numbers.
BROADCAST_SOURCES = 100_000
SALTS = 64


def word_count(text: str = "text") -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """One row per source with its number, size, documents and target.

    Sources are numbered by code point, NULL last, and weigh WEIGHTS in turn. They share
    BUDGET_SHARE of all words; none gets more than PASSES times its own. With sources in
    the order of size over weight, the first ones reach that bound; the level at which
    the others share what is left follows from running sums.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    per = per.withColumn("number", number.cast("long"))
    per = per.withColumn("weight", F.element_at(weights, ((F.col("number") - 1) % len(WEIGHTS) + 1).cast("int")).cast("long"))
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything).cast("double") * BUDGET_SHARE
    spent = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * PASSES
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (budget - spent.cast("double")) / left.cast("double")
    leveled = per.withColumn("level", level)
    fits = F.col("level") * F.col("weight") <= (F.col("source_size") * PASSES).cast("double")
    # The first source that stays under its bound sets the level for it and all after it.
    first = F.min(F.when(fits, F.struct(F.col("source_size") / F.col("weight"), "number", "level"))).over(everything)
    share = F.col("weight") * first["level"]
    bound = (F.col("source_size") * PASSES).cast("double")
    return leveled.withColumn("target", F.coalesce(F.least(share, bound), bound)).drop("level", "weight")


def with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """`rows` with the columns of their source; a source may hold most of the rows.

    Few sources are broadcast. Many are copied once per salt, so that the rows of a large
    one are spread over as many tasks.
    """
    same = rows["source"].eqNullSafe(sources["source"])
    if sources.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(sources), same).drop(sources["source"])
    salted = rows.withColumn("salt_", (F.abs(F.xxhash64("order_", "doc_id")) % SALTS).cast("int"))
    copied = sources.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = salted["source"].eqNullSafe(copied["source"]) & (salted["salt_"] == copied["salt_"])
    return salted.join(copied, both).drop(copied["source"]).drop("salt_")


def queued(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Every row of `docs` with `words_to_end`, the words of its source up to its end.

    A running sum in three levels, so that no task holds a whole source: documents in a
    bucket of the hash, buckets in a group of buckets, groups of buckets in a source.
    """
    rows = with_source(docs, sources)
    buckets = F.ceil(F.col("source_docs") / BUCKET_ROWS)
    place = F.conv(F.substring("order_", 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = rows.withColumn("bucket_", F.least(F.floor(place * buckets), buckets - 1).cast("long"))
    totals = rows.groupBy("number", "bucket_").agg(F.sum("size").alias("words_"))
    totals = totals.withColumn("group_", F.floor(F.col("bucket_") / BUCKETS_TOGETHER))
    before = Window.partitionBy("number", "group_").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    groups = totals.groupBy("number", "group_").agg(F.sum("words_").alias("of_group_"))
    of_groups = Window.partitionBy("number").orderBy("group_").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("number", "group_", F.coalesce(F.sum("of_group_").over(of_groups), F.lit(0)).alias("past_groups_"))
    starts = totals.withColumn("past_", F.coalesce(F.sum("words_").over(before), F.lit(0)))
    starts = starts.join(groups, ["number", "group_"]).select("number", "bucket_", (F.col("past_") + F.col("past_groups_")).alias("past_"))
    ties = ["text_hash_"] if "text_hash_" in docs.columns else []
    within = Window.partitionBy("number", "bucket_").orderBy("order_", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("within_", F.sum("size").over(within)).join(starts, ["number", "bucket_"])
    return placed.withColumn("words_to_end", F.col("within_") + F.col("past_")).drop("within_", "past_", "bucket_")


def finish_time(again: int) -> Column:
    """Virtual finish time when queued for the time `again` (0 first); NULL for what can't be taken."""
    words = F.col("words_to_end") + again * F.col("source_size")
    return F.when((F.col("size") > 0) & (F.col("target") > 0), words.cast("double") / F.col("target"))


class Cut(NamedTuple):
    """The first queue entry that is not taken; None if all are."""

    finish: float | None
    number: int | None
    words: int | None


def mix_order(rows: DataFrame) -> DataFrame:
    """All queue entries sorted by virtual finish time over range partitions, `part` telling which.

    Ties go by the source's number and then by the place in its queue.
    """
    each = F.explode(F.array(*[F.struct(finish_time(k).alias("finish"), (F.col("words_to_end") + k * F.col("source_size")).alias("words")) for k in range(PASSES)]))
    entries = rows.select("doc_id", "number", "size", each.alias("e")).select("doc_id", "number", "size", "e.finish", "e.words")
    order = ["finish", "number", "words"]
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = entries.where("finish IS NOT NULL").repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return ranged.withColumn("part", F.spark_partition_id())


def cut_of(order: DataFrame, budget: float) -> Cut:
    """Where the budget is spent: totals per range partition, then the one that holds the cut."""
    totals = {r.part: r.words for r in order.groupBy("part").agg(F.sum("size").alias("words")).collect()}
    past = 0
    for part in sorted(totals):
        if past + totals[part] > budget:
            break
        past += totals[part]
    else:
        return Cut(None, None, None)
    sums = Window.orderBy("finish", "number", "words").rowsBetween(Window.unboundedPreceding, 0)
    first = (
        order.where(F.col("part") == part)
        .withColumn("total", F.sum("size").over(sums) + past)
        .where(F.col("total") > budget)
        .orderBy("finish", "number", "words")
        .select("finish", "number", "words")
        .first()
    )
    return Cut(*first)


def taken_times(cut: Cut) -> Column:
    """How often a queued row is taken."""
    times = F.lit(0)
    for k in range(PASSES):
        finish, words = finish_time(k), F.col("words_to_end") + k * F.col("source_size")
        if cut.finish is None:
            before = finish.isNotNull()
        else:
            tie = (finish == cut.finish) & ((F.col("number") < cut.number) | ((F.col("number") == cut.number) & (words < cut.words)))
            before = F.coalesce((finish < cut.finish) | tie, F.lit(False))
        times = times + before.cast("int")
    return times


class Plan(NamedTuple):
    """What decides how often a document is taken."""

    slim: DataFrame
    sources: DataFrame
    cut: Cut


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select("doc_id", "source", word_count().alias("size"), order.alias("order_"), *more)


def planned(docs: DataFrame) -> Plan:
    slim = written(_sized(docs), "mix-sizes")
    sources = written(source_targets(slim), "mix-sources")
    budget = sources.agg(F.sum("source_size").cast("double") * BUDGET_SHARE).first()[0] or 0.0
    entries = written(mix_order(queued(slim, sources)), "mix-order")
    cut = cut_of(entries, budget)
    dropped(entries)
    return Plan(slim, sources, cut)


def taken(docs: DataFrame) -> DataFrame:
    """`doc_id`, `size`, `source_size`, `target` and `times`, how often it is taken, of every row.

    NULL and empty texts have size 0 and are never taken; NULL is a source of its own,
    the last. Repeated rows are documents of their own. An empty table gives an empty
    result. Other columns than `doc_id`, `source` and `text` are not read.
    """
    plan = planned(docs)
    rows = queued(plan.slim, plan.sources)
    return rows.select("doc_id", "size", "source_size", "target", taken_times(plan.cut).alias("times"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of `docs` as often as it is taken, with all its columns.

    Which of two rows that share id and size but not text comes first in the queue is
    settled by the hash of the text. See `taken` for the other cases.
    """
    plan = planned(docs)
    dropped(plan.slim)
    whole = F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row_")
    rows = queued(_sized(docs, F.xxhash64("text").alias("text_hash_"), whole), plan.sources)
    copies = rows.select("row_", taken_times(plan.cut).alias("times")).where("times > 0")
    return copies.select("row_", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy_")).select("row_.*")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST)::BIGINT AS number
  FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][(number - 1) % 3 + 1]::BIGINT AS weight FROM per),
leveled AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - (2 * coalesce(sum(source_size) OVER before, 0))::DOUBLE)
         / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level,
         row_number() OVER (ORDER BY source_size::DOUBLE / weight, number) AS pos
  FROM weighed
  WINDOW before AS (ORDER BY source_size::DOUBLE / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
share AS (SELECT arg_min(level, pos) AS level FROM leveled WHERE level * weight <= (2 * source_size)::DOUBLE),
target AS (
  SELECT w.source, w.number, w.source_size, coalesce(least(w.weight * s.level, (2 * w.source_size)::DOUBLE), (2 * w.source_size)::DOUBLE) AS target
  FROM weighed w CROSS JOIN share s),
queue AS (
  SELECT d.doc_id, d.size, d.k, t.number, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY t.number ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS words
  FROM sized d JOIN target t ON d.source IS NOT DISTINCT FROM t.source),
entries AS (
  SELECT doc_id, number, size, words AS w0, words + p * source_size AS words,
         (words + p * source_size)::DOUBLE / target AS finish
  FROM queue, (VALUES (0), (1)) AS passes(p) WHERE size > 0 AND target > 0),
summed AS (
  SELECT number, w0, size, sum(size) OVER (ORDER BY finish, number, words ROWS UNBOUNDED PRECEDING) AS total FROM entries),
chosen AS (
  SELECT number, w0, sum(size)::BIGINT AS taken FROM summed
  WHERE total <= 1.5::DOUBLE * (SELECT sum(source_size) FROM per)::DOUBLE GROUP BY number, w0)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(CASE WHEN q.size > 0 THEN c.taken END, 0)::BIGINT AS taken
FROM queue q LEFT JOIN chosen c ON c.number = q.number AND c.w0 = q.words
"""
