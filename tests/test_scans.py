"""Scans give the same with stretches of a few samples as with one, and long recordings are many tasks."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

from biowave.operators import scans, sequences
from biowave.plans import catalogue, sequence_queries

SCANS = (
    "trial_islands", "rest_active_snr", "stimulus_sessions", "zero_cross_rate", "delta_features", "nearest_label_align", "burst_peaks", "rest_normalised",
)


@pytest.mark.parametrize("size", [5])
@pytest.mark.parametrize("name", SCANS)
def test_queries_with_many_seams(spark, sf_dir, monkeypatch, name, size):
    monkeypatch.setattr(scans, "PART", size)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf_dir}/events.parquet')")
    want = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    got = sequence_queries.QUERIES[name](spark, sf_dir).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def track_of(spark, recordings):
    rows = [(rec, i, x, label, i * 10) for rec, samples in recordings.items() for i, (x, label) in samples]
    return spark.createDataFrame(rows, "rec string, i int, x double, label int, us bigint")


def test_runs_over_whole_stretches_and_gaps(spark, monkeypatch):
    monkeypatch.setattr(scans, "PART", 4)
    here = {"long": range(2, 23), "cut": [*range(0, 8), *range(9, 12), 14, *range(16, 30)], "odd": [3, 5, 7, 8, 11], None: range(5)}
    df = track_of(spark, {rec: [(i, (1.0, 1)) for i in at] for rec, at in here.items()})
    got = {(r["rec"], r["i"]): r["run"] for r in scans.runs(scans.parted(df), "run").collect()}
    for rec, at in here.items():
        start, last = None, None
        for i in at:
            start = i if last is None or i != last + 1 else start
            last = i
            assert got.pop((rec, i)) == start
    assert not got


def test_values_before_changes_and_places(spark, monkeypatch):
    import random

    monkeypatch.setattr(scans, "PART", 3)
    rng = random.Random(5)
    data = {rec: [(i, (rng.choice([1.0, 2.0, None]), rng.choice([0, 1, None]))) for i in range(40) if rng.random() < 0.6] for rec in ("a", "b", None)}
    df = scans.parted(track_of(spark, data))
    before = {(r["rec"], r["i"]): r["b"] for r in scans.previous(df, "x", "b").collect()}
    changed = {(r["rec"], r["i"]): r["s"] for r in scans.changes(df, "label", "s").collect()}
    place = {(r["rec"], r["i"]): r["p"] for r in scans.numbered(df, ["i"], "p").collect()}
    for rec, samples in data.items():
        x, label, n = None, None, 0
        for k, (i, (now, of)) in enumerate(samples):
            n += k > 0 and of is not None and label is not None and of != label
            assert (before[rec, i], changed[rec, i], place[rec, i]) == (x, n, k)
            x, label = now, of


def test_marks_of_other_stretches(spark, monkeypatch):
    samples = spark.createDataFrame([("a", t, t) for t in range(0, 500, 3)] + [("none", 5, 1000)], "rec string, us bigint, id bigint")
    marks = spark.createDataFrame([("a", 40, 1), ("a", 46, 2), ("a", 46, 3), ("a", 404, 4), ("other", 1, 1)], "rec string, us bigint, label int")
    whole = sorted(map(tuple, sequences.align_nearest(samples, marks).collect()))
    monkeypatch.setattr(scans, "PART", 7)
    assert sorted(map(tuple, sequences.align_nearest(samples, marks).collect())) == whole
    near = {40: 1, 46: 3, 404: 4}
    assert whole == sorted([("a", t, t, near[min(near, key=lambda m: (abs(m - t), -m))]) for t in range(0, 500, 3)] + [("none", 1000, 5, None)])


def test_a_long_recording_is_many_tasks(spark):
    """Ten million samples of one recording: trials over many stretches, in at least 32 tasks."""
    n, cut = 10_000_000, 1_234_567
    track = spark.range(0, n, 1, 40).select(
        F.lit(1).alias("rec"), F.col("id").alias("i"), (F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % cut < 10, 0).otherwise(1).alias("label")
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        began = time.time()
        rows = scans.runs(scans.parted(track.where("label > 0")), "run")
        tasks = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()
        assert sum(t["n"] for t in tasks) == n - 10 * -(-n // cut) and len(tasks) >= 32 and max(t["n"] for t in tasks) < n / 10
        got = sequences.islands(track).orderBy("trial_start").select("trial_id", "trial_start", "trial_end", "n").collect()
        want = [(k, k * cut + 10, min(n, (k + 1) * cut) - 1) for k in range(-(-n // cut))]
        assert [tuple(r) for r in got] == [(k, a, b, b - a + 1) for k, a, b in want]
        assert time.time() - began < 300
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
