"""Queries over plans of draws: users' recordings are the records, parts the items of a library, suppliers its sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from biowave.functions import arrays as A
from biowave.operators import draws, samples
from biowave.plans.sample_queries import number_sql
from biowave.sources.adapters import signals, table

SIZE, HOUR, HOURS, ATTEMPTS, HELD = 8, 16, 4, 3, 4
SPREAD = 25.0  # of the values of a slice that is accepted


def records_of(spark, sf):
    """Users as records with their lengths; four are held out for tests."""
    lengths = table(spark, sf, "events").groupBy(F.col("user_id").alias("record")).agg(F.count(F.lit(1)).alias("length"))
    return draws.split_sources(lengths.withColumn("_all", F.lit(0)), "_all", "record", HELD).drop("_all")


def plan_of(spark, sf):
    """A slot for each user for training, by hours, and one for each fourth for tests, at random."""
    users = table(spark, sf, "events").select((F.col("user_id")).alias("slot")).distinct()
    train = users.select(F.lit("train").alias("split"), "slot", F.lit(True).alias("hourly"))
    test = users.where("slot % 4 = 0").select(F.lit("test").alias("split"), F.floor(F.col("slot") / 4).alias("slot"), F.lit(False).alias("hourly"))
    return draws.slice_plan(records_of(spark, sf), train.unionByName(test), ATTEMPTS, SIZE, HOUR, HOURS, 1)


def ecg_plan(spark, sf):
    """Attempts at slices: record, hour and start of each, -1 where none fits."""
    return plan_of(spark, sf).na.fill(-1, ["start"])


def ecg_manifest(spark, sf):
    """The attempts that were made, with their slices' spread; those of flat slices are made again."""
    whole = signals(spark, sf).groupBy("rec").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("signal"))
    library = whole.select(F.lit("ECG").alias("noise_type"), F.col("rec").alias("idx"), F.lit("").alias("path"), "signal")
    cut = samples.stretches(library, SIZE).select(F.col("idx").alias("record"), "block", "stretch")  # no record is a hot key

    def measured(todo):
        block = F.least((F.col("start") / SIZE).cast("int"), ((F.col("_n") - SIZE) / SIZE).cast("int"))
        sizes = library.select(F.col("idx").alias("record"), F.size("signal").alias("_n"))
        met = todo.join(sizes, "record").withColumn("block", block).join(cut, ["record", "block"], "left")
        part = F.slice("stretch", (F.col("start") - F.col("block") * SIZE + 1).cast("int"), F.lit(SIZE))
        spread = met.withColumn("spread", A.std(part)).drop("block", "stretch", "_n")
        return spread.withColumn("ok", F.col("spread") > SPREAD)

    made = draws.manifest(draws.first_accepted(plan_of(spark, sf), ATTEMPTS, measured))
    return made.select("split", "index", "slot", "attempt", "hour", "record", "start", F.round("spread", 5).alias("spread"), F.when(F.col("ok"), 0).otherwise(1).alias("flagged"), "status", F.coalesce("idx", F.lit(-1)).alias("idx"))


def library_pair(spark, sf):
    """Items of a training and a test library with their sources, of which none is in both."""
    kind = lambda c: F.element_at(F.array(*map(F.lit, ("MOA", "ECG"))), (c % 2).cast("int") + 1)
    sources = table(spark, sf, "supplier").select(kind(F.col("s_suppkey")).alias("noise_type"), F.col("s_suppkey").alias("source"))
    sources = draws.split_sources(sources, "noise_type", "source", HELD)
    split = F.when(F.col("p_size") % 4 == 0, "test").otherwise("train")
    items = table(spark, sf, "part").select(split.alias("split"), kind(F.col("p_partkey")).alias("noise_type"), F.col("p_partkey").alias("idx"))
    return draws.assigned(items, sources).select("split", "noise_type", "idx", "source")


QUERIES = {f.__name__: f for f in (ecg_plan, ecg_manifest, library_pair)}

PLAN_SQL = f"""
usr AS (SELECT user_id AS record, count(*) AS length FROM events GROUP BY user_id),
rec AS (
    SELECT *, CASE WHEN row_number() OVER (ORDER BY {number_sql("record", "'held'")}, record) <= {HELD} THEN 'test' ELSE 'train' END AS split FROM usr),
nrc AS (
    SELECT *, row_number() OVER (PARTITION BY split ORDER BY {number_sql("record", "'record'")}, record) - 1 AS k, count(*) OVER (PARTITION BY split) AS records FROM rec),
slo AS (
    SELECT 'train' AS split, record AS slot, (record % {HOURS})::INT AS hour FROM usr
    UNION ALL SELECT 'test', record // 4, -1 FROM usr WHERE record % 4 = 0),
try AS (SELECT slo.*, a::INT AS attempt FROM slo, range(0, {ATTEMPTS}) t(a)),
met AS (
    SELECT try.*, record, CASE WHEN hour < 0 THEN 0 ELSE hour * {HOUR} END AS low, CASE WHEN hour < 0 THEN length ELSE least(length, (hour + 1) * {HOUR}) END AS high
    FROM try JOIN nrc ON nrc.split = try.split AND nrc.k = {number_sql("try.split", "slot", "attempt", "'record'")} % nrc.records),
pln AS (
    SELECT split, slot, attempt, hour, record, CASE WHEN high - low - {SIZE} > 1 THEN low + {number_sql("split", "slot", "attempt", "'start'")} % (high - low - {SIZE} + 1) END AS start,
           high - low - {SIZE} > 1 AS fits FROM met)"""

ORACLE_SQL = {
    "ecg_plan": f"WITH {PLAN_SQL} SELECT * REPLACE (coalesce(start, -1) AS start) FROM pln",
    "ecg_manifest": f"""WITH {PLAN_SQL},
        sam AS (SELECT user_id AS record, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
        spr AS (
            SELECT split, slot, attempt, hour, record, start, stddev_pop(x) AS spread
            FROM pln JOIN sam USING (record) WHERE fits AND i >= start AND i < start + {SIZE} GROUP BY ALL),
        fst AS (SELECT split, slot, min(attempt) FILTER (WHERE spread > {SPREAD}) AS last FROM spr GROUP BY split, slot),
        mde AS (SELECT spr.*, spread > {SPREAD} AS ok FROM spr JOIN fst USING (split, slot) WHERE last IS NULL OR attempt <= last)
        SELECT split, row_number() OVER (PARTITION BY split ORDER BY slot, attempt) - 1 AS index, slot, attempt, hour, record, start, round(spread, 5) AS spread,
               CASE WHEN ok THEN 0 ELSE 1 END AS flagged, CASE WHEN ok THEN 'accepted' ELSE 'rejected' END AS status,
               CASE WHEN ok THEN row_number() OVER (PARTITION BY split, ok ORDER BY slot, attempt) - 1 ELSE -1 END AS idx FROM mde""",
    "library_pair": f"""WITH s AS (SELECT (['MOA', 'ECG'])[s_suppkey % 2 + 1] AS noise_type, s_suppkey AS source FROM supplier),
        h AS (
            SELECT *, CASE WHEN row_number() OVER (PARTITION BY noise_type ORDER BY {number_sql("source", "'held'")}, source) <= {HELD} THEN 'test' ELSE 'train' END AS split FROM s),
        n AS (
            SELECT *, row_number() OVER (PARTITION BY split, noise_type ORDER BY {number_sql("source", "'source'")}, source) - 1 AS k,
                   count(*) OVER (PARTITION BY split, noise_type) AS sources FROM h),
        i AS (SELECT CASE WHEN p_size % 4 = 0 THEN 'test' ELSE 'train' END AS split, (['MOA', 'ECG'])[p_partkey % 2 + 1] AS noise_type, p_partkey AS idx FROM part)
        SELECT i.split, i.noise_type, idx, source
        FROM i JOIN n ON n.split = i.split AND n.noise_type = i.noise_type AND k = {number_sql("i.split", "i.noise_type", "idx", "'draw'")} % sources""",
}
