"""The whole preparation and evaluation workflow as one lineage: recordings, trials, quality, splits, segments, mixes, scores.

recordings have (dataset, path, emg array per channel, restimulus array). A stage's result is worth writing where it is used
again; `sources.files.write_table` writes it once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biowave.functions import arrays as A
from biowave.functions import kernels as K
from biowave.functions import metrics as M
from biowave.functions import spectral as X
from biowave.operators import grading, identity, lookups, margins, sequences
from biowave.operators.denoise import denoise


def trials(recordings: DataFrame, least: int = 16) -> DataFrame:
    """(path, trial_id, trial_start, trial_end, gesture) of every recording."""
    track = recordings.select(F.col("path").alias("rec"), F.posexplode("restimulus").alias("i", "label")).withColumn("x", F.lit(0.0))
    return sequences.islands(track, least).select(F.col("rec").alias("path"), "trial_id", "trial_start", "trial_end", "gesture")


def trial_signals(recordings: DataFrame, least: int = 16) -> DataFrame:
    """One row per trial and channel with the trial's samples and the channel's level at rest.

    A channel meets the list of its recording's trials and is cut where it stands, so it isn't copied for each of them.
    """
    lists = trials(recordings, least).groupBy("path").agg(F.collect_list(F.struct("trial_id", "trial_start", "trial_end", "gesture")).alias("trials"))
    channels = recordings.select("dataset", "path", "restimulus", F.posexplode("emg").alias("ch", "signal"))
    rest = F.filter(F.zip_with("signal", "restimulus", lambda v, lab: F.when(lab == 0, v)), lambda v: v.isNotNull())
    channels = channels.withColumn("_rest", rest).withColumn("_rest", F.when(F.size("_rest") > 0, F.col("_rest")).otherwise(F.col("signal")))
    level = F.sqrt(A.power(F.col("_rest")) / F.size("_rest") + 1e-12)
    cut = F.transform("trials", lambda t: F.struct(
        t["trial_id"].alias("trial_id"), t["trial_start"].alias("trial_start"), t["trial_end"].alias("trial_end"), t["gesture"].alias("gesture"),
        F.slice("signal", t["trial_start"].cast("int") + 1, (t["trial_end"] - t["trial_start"] + 1).cast("int")).alias("signal"),
    ))
    put = channels.withColumn("rest_rms", level).join(lists, "path").select("dataset", "path", "ch", "rest_rms", F.explode(cut).alias("t"))
    return put.select("dataset", "path", "ch", "rest_rms", "t.*")


def hampel_windows(signal, rate: float, seconds: float = 2.0, hop: float = 1.0, largest: bool = True):
    """The largest (or mean) energy that the Hampel filter takes from windows of a signal; null for short ones."""

    def of(x):
        size, step = round(seconds * rate), max(1, round(hop * rate))
        if x.shape[1] < size:
            return {"er": np.full(len(x), np.nan)}
        cut = np.lib.stride_tricks.sliding_window_view(x, size, axis=1)[:, ::step]
        er = K.hampel_energy(cut.reshape(-1, size)).reshape(len(x), -1)
        return {"er": er.max(axis=1) if largest else er.mean(axis=1)}

    return X.features(["er"], of, signal)["er"]


def quality(recordings: DataFrame, rate: float, least: int = 16) -> DataFrame:
    """Quality metrics of each trial and channel."""
    t = trial_signals(recordings, least)
    active = A.rms(F.col("signal"))
    t = t.withColumn("snr_db", 10.0 * F.log10(active * active / (F.col("rest_rms") * F.col("rest_rms") + 1e-12) + 1e-12))
    t = t.withColumn("q", X.quality(F.col("signal"), rate, 1024, 128)).withColumn("hamp_er", hampel_windows(F.col("signal"), rate))
    return t.select("dataset", "path", "ch", "trial_id", "trial_start", "trial_end", "gesture", "snr_db", "q.*", "hamp_er")


def index(metrics: DataFrame, rules: grading.Rules = grading.Rules()) -> DataFrame:
    """The passing rows with their cross-dataset subject."""
    kept = grading.grade(metrics, rules).where("pass_final")
    subject = identity.subject_of(F.col("path"))
    return kept.withColumn("subject", identity.cross_subject_id(F.col("dataset"), subject, F.col("path"))).select(
        "dataset", "path", "subject", "ch", "trial_id", "trial_start", "trial_end", "gesture", "qc_grade", "reason_flags"
    )


def segments(recordings: DataFrame, passing: DataFrame, splits: DataFrame, test_dataset: str, rate: float, target: float = 1000.0, seconds: float = 2.0,
             overlap: float = 0.0, low: float = 20.0, high: float = 500.0, scale: str = "Q99") -> DataFrame:
    """Segments of the passing trials: band-passed at the recorded rate, resampled, cut, with their scale.

    The key is (path, trial_id, ch, seg_idx); segment_id is a label that may repeat between files of a subject.
    """
    chosen = lookups.with_split(passing, splits, test_dataset).select("path", "ch", "trial_id", "subject", "split")
    size = int(seconds * target)
    step = max(1, int(size * (1 - overlap)))
    t = trial_signals(recordings).join(chosen, ["path", "ch", "trial_id"])
    t = t.withColumn("y", X.mapped(F.col("signal"), lambda x: K.resample(K.band_pass(x, rate, low, min(high, rate / 2 * 0.99)), rate, target)))
    starts = F.when(F.size("y") >= size, F.sequence(F.lit(0), F.size("y") - size, F.lit(step)))
    cut = t.select("dataset", "path", "subject", "ch", "trial_id", "gesture", "split", F.posexplode(F.transform(starts, lambda s: F.slice("y", s + 1, size))).alias("seg_idx", "clean"))
    return cut.withColumn("clean_scale", A.scale(F.col("clean"), scale)).withColumn(
        "segment_id", F.concat("subject", F.lit("_ch"), F.col("ch").cast("string"), F.lit("_t"), F.col("trial_id").cast("string"), F.lit("_seg"), F.col("seg_idx").cast("string"))
    )


def evaluate(samples: DataFrame, methods: list[str], rate: float, size: int = 200, params: dict | None = None) -> DataFrame:
    """Long metric rows (method, snr, k, noise_types, metric, value) of samples (clean, noisy, snr, k, noise_types, noise_paths)."""
    out = None
    c, d, n = F.col("clean"), F.col("denoised"), F.col("noisy")
    for method in methods:
        done = denoise(samples, method, rate, params=params)
        done = done.withColumn("e", X.spectral_errors(c, d, rate, size, 512, 128, 20.0, 500.0))
        values = F.create_map(
            F.lit("SNRimp"), M.snr_gain(c, d, n), F.lit("RMSE"), M.rmse(c, d), F.lit("PRD"), M.prd(c, d), F.lit("RMSE_ARV"), M.rmse_of(c, d, size, M.mean_rectified, tail=True),
            F.lit("RMSE_ZCR"), M.rmse_of(c, d, size, M.zero_crossing_rate(rate, size)), F.lit("RMSE_Kurtosis"), M.rmse_of(c, d, size, M.kurtosis),
            F.lit("LSD"), F.col("e.lsd"), F.lit("RMSE_MNF"), F.col("e.rmse_mnf"), F.lit("RMSE_MDF"), F.col("e.rmse_mdf"),
        )
        one = done.select(F.lit(method).alias("method"), "snr", "k", "noise_types", "noise_paths", "ok", F.explode(values).alias("metric", "value"))
        out = one if out is None else out.unionByName(one)
    return out


def summary(scores: DataFrame) -> DataFrame:
    """Mean, spread and number of each metric by method, SNR and k, with pooled margins."""
    return margins.cube_summary(scores, ["method", "metric", "snr", "k"]).where("method <> 'Avg' AND metric <> 'Avg'")
