"""Which noise goes where: sources held out for tests, plans of slices with numbered attempts, and rejection sampling by them.

Every draw is a hash of its keys, so a plan is the same however it is partitioned, and a round that is run again draws the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biowave.operators import scans
from biowave.operators.splitting import key_number, keyed_sample

HASH_BITS = 32


def split_sources(sources: DataFrame, by: str, source: str, held: int, salt: str = "held") -> DataFrame:
    """sources, distinct, with split: of each `by` the `held` ones with the smallest hashes are for tests, the rest trains.

    A source is in one split only, whatever is drawn from it later. Where there are no more than `held`, all test.
    """
    test = keyed_sample(sources, [by], source, held, salt).select(F.col(by).alias("_by"), F.col(source).alias("_test"))
    met = sources.join(test, F.col(by).eqNullSafe(F.col("_by")) & F.col(source).eqNullSafe(F.col("_test")), "left")
    return met.withColumn("split", F.when(F.col("_test").isNotNull(), "test").otherwise("train")).drop("_by", "_test")


def placed(rows: DataFrame, by: Column, key: str, name: str, salt: str) -> DataFrame:
    """rows numbered from 0 within `by`, in the order of a hash of their key; by ranges of the hash, so none is one task."""
    hashed = rows.withColumn("rec", by).withColumn("_hash", key_number(F.col(key), salt=salt))
    ranged = hashed.withColumn("_part", F.shiftright("_hash", HASH_BITS - 12))
    return scans.numbered(ranged, ["_hash", key], name).drop("rec", "_hash", "_part")


def assigned(items: DataFrame, sources: DataFrame) -> DataFrame:
    """items (split, noise_type, idx) with a source of their type and split (noise_type, source, split), each drawn by the item's key.

    Items of a type that has no source in their split give no row.
    """
    group = F.concat_ws("|", "split", "noise_type")
    numbered = placed(sources, group, "source", "_at", "source")
    sizes = numbered.groupBy("split", "noise_type").agg(F.count(F.lit(1)).alias("_sources"))
    drawn = items.join(sizes, ["split", "noise_type"])  # a row for each split and type
    drawn = drawn.withColumn("_at", key_number(F.col("split"), F.col("noise_type"), F.col("idx"), salt="draw") % F.col("_sources"))
    return drawn.join(numbered.select("split", "noise_type", "_at", "source"), ["split", "noise_type", "_at"]).drop("_at", "_sources")


def slice_plan(records: DataFrame, slots: DataFrame, attempts: int, size: int, hour: int, hours: int = 24, per_hour: int = 1) -> DataFrame:
    """(split, slot, attempt, hour, record, start, fits): numbered attempts at a slice of `size` samples for each slot.

    records have (record, length, split), slots (split, slot, hourly), numbered from 0. Hourly slots take turns with the hours of
    `hour` samples, per_hour slots each, and draw within theirs; others draw from the whole record, as hour -1. An attempt
    doesn't fit where its record is too short for it.
    """
    numbered = placed(records, F.col("split"), "record", "_at", "record")
    sizes = numbered.groupBy("split").agg(F.count(F.lit(1)).alias("_records"))
    tries = slots.join(sizes, "split").withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    draw = lambda salt: key_number(F.col("split"), F.col("slot"), F.col("attempt"), salt=salt)
    turn = (F.floor(F.col("slot") / per_hour) % hours).cast("int")
    tries = tries.withColumn("hour", F.when(F.col("hourly"), turn).otherwise(-1)).withColumn("_at", draw("record") % F.col("_records"))
    met = tries.join(numbered, ["split", "_at"])
    low = F.when(F.col("hour") < 0, 0).otherwise(F.col("hour") * F.lit(hour)).cast("bigint")
    high = F.when(F.col("hour") < 0, F.col("length")).otherwise(F.least(F.col("length"), (F.col("hour") + 1) * F.lit(hour)))
    room = high - low - size
    start = F.when(room > 1, low + draw("start") % (room + 1))
    return met.select("split", "slot", "attempt", "hour", "record", start.alias("start"), (room > 1).alias("fits"))


def first_accepted(plan: DataFrame, attempts: int, measured: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The attempts of a plan that are made, with status: each slot's up to the first accepted one.

    measured reads the slices of some attempts and adds `ok` and whatever it has read. Attempts are made in rounds: the next
    only for slots without an accepted one, so a slot costs as many reads as it takes. Attempts that don't fit are passed
    over; a slot with no accepted attempt has rejected ones only.
    """
    made, done = None, None
    for k in range(attempts):
        todo = plan.where((F.col("attempt") == k) & F.col("fits"))
        if done is not None:
            todo = todo.join(done, ["split", "slot"], "left_anti")
        got = scans.written(measured(todo))
        made = got if made is None else made.unionByName(got)
        accepted = got.where("ok").select("split", "slot")
        done = accepted if done is None else done.unionByName(accepted)
        if plan.where((F.col("attempt") > k) & F.col("fits")).join(done, ["split", "slot"], "left_anti").isEmpty():
            break
    return made.withColumn("status", F.when(F.coalesce("ok", F.lit(False)), "accepted").otherwise("rejected"))


def manifest(made: DataFrame) -> DataFrame:
    """Attempts with their number in the manifest of their split, and accepted ones with their number as items (idx, else null)."""
    ordered = made.withColumn("rec", F.col("split")).withColumn("_part", F.floor(F.col("slot") / scans.PART))
    whole = scans.numbered(ordered, ["slot", "attempt"], "index")
    items = scans.numbered(whole.where("status = 'accepted'").select("rec", "_part", "split", "slot", "attempt"), ["slot", "attempt"], "idx")
    return whole.join(items.select("split", "slot", "attempt", "idx"), ["split", "slot", "attempt"], "left").drop("rec", "_part")
