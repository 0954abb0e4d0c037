"""The workflow from recordings to summary on synthetic recordings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from biowave.functions import arrays as A
from biowave.operators import grading, mixing
from biowave.plans import workflow


@pytest.fixture(scope="module")
def recordings(spark):
    rows = []
    for subject in (1, 2, 3):
        rng = np.random.default_rng(subject)
        labels = np.zeros(16000, int)
        labels[2000:8000], labels[9000:15000] = 3, 5
        emg = [(rng.standard_normal(16000) * np.where(labels > 0, 1.0, 0.01)).tolist() for _ in range(2)]
        emg[1] = (np.array(emg[1]) * 0 + rng.standard_normal(16000)).tolist()  # a channel that never rests
        rows.append(("db1" if subject < 3 else "db9", f"/r/S{subject}_E1.mat", emg, labels.tolist()))
    return spark.createDataFrame(rows, "dataset string, path string, emg array<array<double>>, restimulus array<int>")


RULES = grading.Rules(smr_min=5.0, shr_min=1.0, ohm_max=2.0, hampel_a=1.0, hampel_b=1.0)


def test_quality_tells_the_channels_apart(recordings):
    q = workflow.quality(recordings, 2000.0)
    assert q.count() == 12
    graded = grading.grade(q, RULES)
    assert {r["ch"] for r in graded.where("pass_final").collect()} == {0}
    assert graded.where("ch = 1 AND snr_db < 1").count() == 6 and q.where("hamp_er BETWEEN 0 AND 1").count() == 12


def test_segments_to_summary(spark, recordings):
    index = workflow.index(workflow.quality(recordings, 2000.0), RULES)
    splits = spark.createDataFrame([("db1_1", "train"), ("db1_2", "valid")], "subject string, split string")
    s = workflow.segments(recordings, index, splits, "db9", 2000.0)
    rows = s.select("subject", "split", "trial_id", "seg_idx", F.size("clean").alias("n"), "clean_scale", "segment_id").collect()
    assert {(r["subject"], r["split"]) for r in rows} == {("db1_1", "train"), ("db1_2", "valid"), ("db9_3", "test")}
    assert len(rows) == 6 and all(r["n"] == 2000 and r["clean_scale"] > 0 for r in rows)  # 3 s trials hold one segment of 2 s
    tone = F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda i: F.sin(i * 2 * np.pi * 60 / 1000))
    noisy = s.withColumn("snr", F.lit(0)).withColumn("k", F.lit(1)).withColumn("noisy", mixing.mix(F.col("clean"), tone, A.power(F.col("clean"))))
    samples = noisy.select("clean", "noisy", "snr", "k", F.lit("PLI").alias("noise_types"), F.lit("").alias("noise_paths"))
    got = {(r["method"], r["metric"], r["snr"], r["k"]): r for r in workflow.summary(workflow.evaluate(samples, ["hp", "ts"], 1000.0)).collect()}
    assert got[("hp", "SNRimp", "0", "1")]["mean"] > 6 and got[("hp", "SNRimp", "Avg", "Avg")]["n"] == 6
    assert {k[1] for k in got} == {"SNRimp", "RMSE", "PRD", "LSD", "RMSE_ARV", "RMSE_ZCR", "RMSE_Kurtosis", "RMSE_MNF", "RMSE_MDF"}
