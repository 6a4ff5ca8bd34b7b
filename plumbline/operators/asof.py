"""Point-in-time lookup: the latest feature at or before a row's time."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.names import quoted
from plumbline.session import settle

# Rows of one entity that a task goes through in order; entities with more are cut into time parts.
PART_ROWS = 2_000_000
# Steps of an entity's time span for each of its parts.
STEPS_PER_PART = 4
# What is sent to every executor about hot entities: 64 bytes a part, for which parts grow if need be.
BROADCAST_BYTES = 32 << 20


def _number(time: Column, dtype: T.DataType) -> Column:
    """A time as a number that never falls while the time rises."""
    if isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), time).cast("double")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(time).cast("double")
    return F.datediff(time, F.lit("1970-01-01")).cast("double") if isinstance(dtype, T.DateType) else time.cast("double")


def lookup_as_of(
    df: DataFrame,
    features: DataFrame,
    keys: list[str],
    time: str,
    feature_time: str | None = None,
    found_time: str | None = None,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Every row of `df` with the features of its keys that were the latest at or before its time.

    Rows and features are united, sorted by time within their entity and the last feature
    carried forward, so the work is one shuffle and no row meets more than one feature.
    An entity that holds many rows is cut into time parts: steps of its time span are
    counted and put together to parts of about `part_rows`, and each part begins with the
    feature that the parts before it carry over. A step is never cut, so many rows at one
    instant of one entity stay together.

    Rows without a key, a time or an earlier feature keep NULLs for the features; features
    without a key or a time are never found. Of features with equal keys and time the
    greatest by its columns counts, so these must be orderable. Repeated rows are kept.
    `feature_time` is the time column of `features` (`time` by default), `found_time` adds
    the time of the feature found under that name. Other columns may not share a name.
    """
    at = feature_time or time
    carried = [name for name in features.columns if name not in (*keys, at)]
    added = [*carried, *([found_time] if found_time else [])]
    clash = sorted(set(added) & set(df.columns)) + sorted(name for name in added if added.count(name) > 1)
    if clash:
        raise ValueError(f"both sides have columns {clash}")
    usable = reduce(and_, [quoted(name).isNotNull() for name in (*keys, time)])
    known = reduce(and_, [quoted(name).isNotNull() for name in (*keys, at)])
    key = [quoted(name) for name in keys]
    ask = df.where(usable).select(
        *key, quoted(time).alias("__time"), F.lit(1).alias("__side"), F.struct(*[quoted(c) for c in df.columns]).alias("__row")
    )
    # The struct has a field also where nothing is carried.
    values = [quoted(name) for name in carried] + ([quoted(at).alias(found_time)] if found_time else []) + [F.lit(True).alias("__met")]
    tell = features.where(known).select(
        *key, quoted(at).cast(df.schema[time].dataType).alias("__time"), F.lit(0).alias("__side"), F.struct(*values).alias("__feature")
    )
    tell = tell.groupBy(*key, "__time", "__side").agg(F.max("__feature").alias("__feature"))
    both = ask.unionByName(tell, allowMissingColumns=True).withColumn("__number", _number(F.col("__time"), df.schema[time].dataType))
    hot = _hot_entities(both, keys, part_rows)
    if hot is None:
        placed = both.withColumn("__part", F.lit(0))
    else:
        step = F.floor((F.col("__number") - F.col("__low")) / F.col("__width")).cast("int")
        part = F.coalesce(F.element_at("__parts", step + 1), F.lit(0))
        placed = both.join(F.broadcast(hot), keys, "left").withColumn("__part", part).drop("__low", "__width")
    order = Window.partitionBy(*key, "__part").orderBy("__time", "__side").rowsBetween(Window.unboundedPreceding, 0)
    met = placed.drop("__parts").withColumn("__last", F.last("__feature", ignorenulls=True).over(order)).where("__side = 1")
    if hot is not None:
        met = met.join(_carried(placed, hot, keys), [*keys, "__part"], "left")
        met = met.withColumn("__last", F.coalesce("__last", "__before"))
    answered = met.select("__row.*", *[F.col("__last").getField(name).alias(name) for name in added])
    rest = df.where(~usable).select("*", *[F.lit(None).cast(answered.schema[name].dataType).alias(name) for name in added])
    return answered.unionAll(rest)


def _hot_entities(both: DataFrame, keys: list[str], part_rows: int) -> DataFrame | None:
    """Entities of more than `part_rows` rows: where their time begins, the width of a step, and the part of each step."""
    key = [quoted(name) for name in keys]
    sizes = both.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.min("__number").alias("__low"), F.max("__number").alias("__high"))
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    # So there are fewer than total / limit hot entities, and parts, whatever the data.
    limit = max(part_rows, -(-total * 64 // BROADCAST_BYTES))
    steps = (F.ceil(F.col("__n") / limit) * STEPS_PER_PART).alias("__steps")
    hot = settle(sizes.where(F.col("__n") > limit).where("__high > __low").select(*key, "__low", "__high", steps))
    if not hot.count():
        return None
    # A little wider than the span, so that its end falls into the last step.
    width = ((F.col("__high") - F.col("__low")) / F.col("__steps") * (1 + 1e-9)).alias("__width")
    hot = hot.select(*key, "__low", "__steps", width)
    step = F.least(F.floor((F.col("__number") - F.col("__low")) / F.col("__width")), F.col("__steps") - 1).alias("__step")
    counted = both.select(*key, "__number").join(F.broadcast(hot), keys).groupBy(*key, step).agg(F.count(F.lit(1)).alias("__n"))
    every = hot.select(*key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__steps") - 1)).alias("__step"), F.lit(0).cast("bigint").alias("__n"))
    counted = counted.unionByName(every).groupBy(*key, "__step").agg(F.sum("__n").alias("__n"))
    before = Window.partitionBy(*key).orderBy("__step").rowsBetween(Window.unboundedPreceding, -1)
    part = F.floor(F.coalesce(F.sum("__n").over(before), F.lit(0)) / limit).cast("int").alias("__part")
    listed = counted.select(*key, "__step", part).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("__step", "__part"))).alias("__parts"))
    return settle(hot.drop("__steps").join(listed.select(*key, F.col("__parts.__part").alias("__parts")), keys))


def _carried(placed: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """For every part of a hot entity the last feature of the parts before it."""
    key = [quoted(name) for name in keys]
    told = placed.where("__side = 0 AND __parts IS NOT NULL").groupBy(*key, "__part").agg(F.max_by("__feature", "__time").alias("__own"))
    every = hot.select(*key, F.explode(F.array_distinct("__parts")).alias("__part"))
    before = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("__own", ignorenulls=True).over(before).alias("__before")
    return every.join(told, [*keys, "__part"], "left").select(*key, "__part", last)
