"""Plans of draws: strata, held-out sources, rejection by rounds, epochs."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from biowave.operators import draws, ecg, mixing, samples
from tests_support import put_record


@pytest.fixture(scope="module")
def ecg_files(tmp_path_factory):
    """Six records of five hours; one is flat throughout, one in its second hour, one is an hour short."""
    folder, rng = tmp_path_factory.mktemp("holter"), np.random.default_rng(4)
    hour, out = 3600 * ecg.RATE, {}
    for k in range(6):
        n = hour * (4 if k == 3 else 5)
        x = rng.integers(-800, 800, (n, 1))
        if k == 1:
            x[:] = 0
        if k == 2:
            x[hour : 2 * hour] = 0
        put_record(folder, f"r{k}", x)
        out[f"r{k}"] = n
    return folder, out


def test_ecg_items(spark, ecg_files):
    folder, lengths = ecg_files
    records = draws.split_sources(spark.createDataFrame([(0, r, n) for r, n in lengths.items()], "all int, record string, length bigint"), "all", "record", 2).drop("all")
    slots = spark.createDataFrame([("train", s, True) for s in range(20)] + [("test", s, False) for s in range(4)], "split string, slot bigint, hourly boolean")
    library, told = ecg.items(str(folder), records, slots, 2.0, 1000.0, attempts=10, hours=5)
    split = {r["record"]: r["split"] for r in records.collect()}
    assert Counter(split.values()) == {"train": 4, "test": 2}
    rows, items = told.collect(), library.collect()
    hour = 3600 * ecg.RATE
    for r in rows:
        assert split[r["record"]] == r["split"]
        low, high = (0, lengths[r["record"]]) if r["split"] == "test" else (r["hour"] * hour, (r["hour"] + 1) * hour)
        assert low <= r["start"] <= high - 256 and r["hour"] == (-1 if r["split"] == "test" else r["slot"] % 5)
        flat = r["record"] == "r1" or (r["record"] == "r2" and hour <= r["start"] <= 2 * hour - 256)
        border = r["record"] == "r2" and (hour - 256 < r["start"] < hour or 2 * hour - 256 < r["start"] < 2 * hour)
        assert border or (r["status"] == "rejected") == flat == bool(r["flagged"])
    assert any(r["status"] == "rejected" for r in rows)
    for s in ("train", "test"):
        mine = sorted((r for r in rows if r["split"] == s), key=lambda r: r["index"])
        assert [r["index"] for r in mine] == list(range(len(mine)))
        assert [(r["slot"], r["attempt"]) for r in mine] == sorted((r["slot"], r["attempt"]) for r in mine)
        accepted = [r for r in mine if r["status"] == "accepted"]
        assert [r["slot"] for r in accepted] == list(range(20 if s == "train" else 4)), "one for each slot"
        own = sorted((i for i in items if i["split"] == s), key=lambda i: i["idx"])
        assert [i["source"] for i in own] == [r["record"] for r in accepted] and [i["idx"] for i in own] == list(range(len(own)))
    assert all(len(i["signal"]) == 2000 and np.std(i["signal"]) > 1e-6 for i in items)


def test_rejection_makes_no_more_attempts_than_it_needs(spark):
    plan = spark.createDataFrame([("a", s, k, s != 2 or k > 0) for s in range(4) for k in range(5)], "split string, slot bigint, attempt int, fits boolean")
    asked = []

    def measured(todo):
        rows = todo.collect()
        asked.extend((r["slot"], r["attempt"]) for r in rows)
        return todo.withColumn("ok", (F.col("slot") == F.col("attempt")) | ((F.col("slot") == 2) & (F.col("attempt") == 3)))

    made = draws.manifest(draws.first_accepted(plan, 5, measured)).collect()
    want = [(0, 0), (1, 0), (1, 1), (2, 1), (2, 2), (3, 0), (3, 1), (3, 2), (3, 3)]
    assert sorted(asked) == want == [(r["slot"], r["attempt"]) for r in sorted(made, key=lambda r: r["index"])]
    assert {(r["slot"], r["idx"]) for r in made if r["status"] == "accepted"} == {(k, k) for k in range(4)}


def test_no_source_in_both_libraries(spark):
    sources = spark.createDataFrame([(t, f"{t}{k}") for t, n in (("MOA", 9), ("ECG", 3), ("few", 1)) for k in range(n)], "noise_type string, source string")
    split = draws.split_sources(sources, "noise_type", "source", 2)
    assert Counter((r["noise_type"], r["split"]) for r in split.collect()) == {("MOA", "test"): 2, ("MOA", "train"): 7, ("ECG", "test"): 2, ("ECG", "train"): 1, ("few", "test"): 1}
    items = spark.createDataFrame([(s, t, k) for s in ("train", "test") for t in ("MOA", "ECG", "few", "none") for k in range(40)], "split string, noise_type string, idx int")
    rows = draws.assigned(items, split).collect()
    assert len(rows) == 40 * 5 and sorted(map(tuple, rows)) == sorted(map(tuple, draws.assigned(items.repartition(7), split.repartition(5)).collect()))
    by = {s: {r["source"] for r in rows if r["split"] == s} for s in ("train", "test")}
    assert not by["train"] & by["test"] and len(by["train"]) >= 7


def test_epochs_differ_and_come_again(spark):
    keys = spark.createDataFrame([(k, [float(k % 5 + 1), -1.0, 2.0, 0.5] * 4) for k in range(50)], "seg bigint, clean array<double>")
    library = spark.createDataFrame([(t, k, f"{t}{k}", [float((k + 2) * (j % 7) - j % 3) for j in range(40)]) for t in mixing.NOISE_TYPES for k in range(3)], "noise_type string, idx int, path string, signal array<double>")

    def of(epochs, parts):
        jobs = samples.epoch_jobs(keys.repartition(parts), epochs, -12.0, 9.0, 2, 3)
        rows = samples.training_pairs(samples.mixed_samples(keys, jobs, library, 16, key=("epoch", "seg"))).collect()
        return {(r["epoch"], r["seg"]): r for r in rows}

    both, again = of([0, 1], 3), of([1], 5)
    assert len(both) == 100 and all(both[k] == r for k, r in again.items())
    assert sum(both[0, s]["snr"] != both[1, s]["snr"] for s in range(50)) > 45
    for r in both.values():
        c, n = np.array(r["clean"]), np.array(r["noisy"])
        assert -12 <= r["snr"] <= 9 and r["k"] in (2, 3) and len(r["noise_types"].split("+")) == r["k"]
        assert np.allclose(r["noisy_norm"], np.clip(n / r["scale"], -1, 1)) and np.allclose(r["clean_norm"], np.clip(c / r["scale"], -1, 1))
        assert np.isclose(r["scale"], np.quantile(abs(n), 0.99))
    stats = {(r["epoch"], r["kind"], r["name"]): r["n"] for r in samples.mixing_stats(samples.mixed_samples(keys, samples.epoch_jobs(keys, [0], -12.0, 9.0, 2, 3), library, 16, key=("epoch", "seg")), ["epoch"]).collect()}
    assert stats[0, "all", ""] == 50 and stats[0, "k", "2"] + stats[0, "k", "3"] == 50
    assert sum(n for (_, kind, _), n in stats.items() if kind == "type") == 2 * stats[0, "k", "2"] + 3 * stats[0, "k", "3"]


def test_noise_moves_once_to_where_its_segments_are(spark):
    """With no table small enough to be sent to all, samples are put together and meet their segments in one partitioning."""
    from biowave.plans import sample_queries

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sample_queries.mixed_grid(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(seg" in line]
    assert len(moved) == 2 and not any("snr" in line.split("hashpartitioning(")[1].split(")")[0] for line in moved)
