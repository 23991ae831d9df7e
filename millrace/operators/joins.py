"""Joins: equi, with a size-checked broadcast, as-of and by range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes up to which a side is broadcast by broadcast_if_small.
BROADCAST_BYTES = 64 << 20
#: Bytes of both sides that an as-of join sorts as one slice of time.
SLICE_BYTES = 256 << 20


def equi_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Joins on columns of the same names; null_safe lets nulls meet."""
    if not null_safe:
        return left.join(right, list(keys), how)
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's own estimate."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks df for broadcast if its estimate is within the limit; else joins shuffle, and adaptive
    execution splits skewed keys."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def key_condition(left: str, right: str, keys: Sequence[str], null_safe: bool = False) -> Column:
    """left.k = right.k for all keys; no keys match nothing."""
    if not keys:
        return F.lit(False)
    pair = lambda k: F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")) if null_safe else F.col(f"{left}.`{k}`") == F.col(f"{right}.`{k}`")
    condition = pair(keys[0])
    for k in keys[1:]:
        condition = condition & pair(k)
    return condition


def asof_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, columns: Sequence[str], prefix: str = "asof_", every: float | None = None) -> DataFrame:
    """For each row of left the latest row of right with the key and no later time.

    One shuffle: both sides meet in one sorted stream for each key, and the last right row is carried
    forward. Of right rows of one time the greatest columns count. With every, a key's stream is cut
    into slices of so many seconds (or units of a numeric time), so a key with many rows is shared out;
    each slice begins with the last right row of those before it. Without, sides of more than
    SLICE_BYTES, as the optimizer estimates them, are cut into slices of about that size."""
    values = F.struct(F.col(right_ts).alias(f"{prefix}{right_ts}"), *[F.col(c).alias(f"{prefix}{c}") for c in columns])
    row = F.struct(*[F.col(c) for c in left.columns])
    none = lambda df, name: F.lit(None).cast(df.schema[name].dataType)
    kind = right.schema[right_ts].dataType
    at = F.col("_t").cast("timestamp").cast("double") if kind.typeName() in ("timestamp", "timestamp_ntz", "date") else F.col("_t").cast("double")
    if every is None:
        every = _slice_length(left, left_ts, right, right_ts)
    slot = F.floor(at / every) if every else F.lit(0).cast("long")
    r = right.select(F.col(key).alias("_k"), F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), values.alias("_right")).withColumn("_slot", slot)
    l = left.select(F.col(key).alias("_k"), F.col(left_ts).cast(kind).alias("_t"), F.lit(1).alias("_side"), row.alias("_left")).withColumn("_slot", slot)  # noqa: E741
    both = l.withColumn("_right", none(r, "_right")).unionByName(r.withColumn("_left", none(l, "_left")))
    if every:
        last = r.groupBy("_k", "_slot").agg(F.max(F.struct("_t", "_right")).alias("_m"))
        slots = l.select("_k", "_slot").union(last.select("_k", "_slot")).distinct()
        earlier = Window.partitionBy("_k").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
        carried = slots.join(last, ["_k", "_slot"], "left").select("_k", "_slot", F.last("_m", ignorenulls=True).over(earlier).alias("_m")).filter("_m IS NOT NULL")
        both = both.unionByName(carried.select("_k", "_slot", "_m._t", "_m._right", F.lit(0).alias("_side"), none(l, "_left").alias("_left")))
    w = Window.partitionBy("_k", "_slot").orderBy("_t", "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_last", F.last("_right", ignorenulls=True).over(w)).filter("_side = 1").select("_left.*", "_last.*")


def _slice_length(left: DataFrame, left_ts: str, right: DataFrame, right_ts: str) -> float | None:
    """Time that makes a slice of all rows about SLICE_BYTES; None if one slice is enough."""
    slices = (estimated_bytes(left) + estimated_bytes(right)) // SLICE_BYTES
    if slices < 1:
        return None
    seconds = lambda df, c: F.col(c).cast("timestamp").cast("double") if df.schema[c].dataType.typeName() in ("timestamp", "timestamp_ntz", "date") else F.col(c).cast("double")
    ends = [df.agg(F.min(seconds(df, c)), F.max(seconds(df, c))).first() for df, c in ((left, left_ts), (right, right_ts))]
    known = [v for e in ends for v in e if v is not None]
    return (max(known) - min(known)) / (slices + 1) or None if known else None


#: Buckets that a range may touch before it goes to a level of buckets so many times as wide.
FAN = 16
#: Buckets of the first level beyond which a range is as good as endless; such ranges share one bucket.
ENDLESS = 2.0**60


def _level(low: str, high: str, bucket: float) -> Column:
    """0 for ranges of up to FAN buckets, 1 for up to FAN times that, and so on; -1 for endless ones."""
    length = (F.col(high).cast("double") - F.col(low).cast("double")) / F.lit(float(bucket))
    return F.when(length > ENDLESS, -1).when(length <= FAN, 0).otherwise(F.ceil(F.log(float(FAN), length)) - 1).cast("int")


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, bucket: float, how: str = "inner") -> DataFrame:
    """Points in [low, high] by equality of buckets: a range enters every bucket it touches on the level
    of its length, FAN + 1 or so, and a point one bucket of each level that has ranges. So no range, however
    wide, becomes many rows. Choose bucket near the usual length of a range. how keeps points or only pairs
    (inner, left, left_semi, left_anti): a range stands in several buckets, so those of its own kind cannot
    be kept. Null bounds, and bounds the wrong way round, hold nothing; null points are in no range."""
    kind = how.replace("_", "").replace("outer", "")
    if kind not in ("inner", "left", "leftsemi", "semi", "leftanti", "anti"):
        raise ValueError(f"a range join cannot be {how!r}")
    r = ranges.filter(F.col(low) <= F.col(high)).withColumn("_level", _level(low, high, bucket))
    levels = sorted(x["_level"] for x in r.select("_level").distinct().collect()) or [0]  # about log(ENDLESS) / log(FAN)
    width = F.lit(float(bucket)) * F.pow(F.lit(float(FAN)), F.col("_level"))
    place = lambda c: F.when(F.col("_level") < 0, F.lit(0).cast("long")).otherwise(F.floor(F.col(c) / width).cast("long"))
    r = r.withColumn("_bucket", F.explode(F.sequence(place(low), place(high))))
    p = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels))) if len(levels) > 1 else F.lit(levels[0])).withColumn("_bucket", place(point))
    within = (p["_level"] == r["_level"]) & (p["_bucket"] == r["_bucket"]) & (F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))
    if kind == "inner" or len(levels) == 1:
        return p.join(r, within, how).drop("_level", "_bucket")
    # a point stands on several levels now; whether it is in a range depends on its value alone
    pairs = p.join(r, within).drop("_level", "_bucket")
    found = p.join(r, within, "left_semi").select(F.col(point).alias("_found")).distinct()
    if kind in ("leftsemi", "semi"):
        return points.join(found, F.col(point) == F.col("_found"), "left_semi")
    missed = points.join(found, F.col(point) == F.col("_found"), "left_anti")
    if kind != "left":
        return missed
    return pairs.union(missed.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in ranges.schema]))
