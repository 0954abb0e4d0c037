"""Queries that denoise, synthesize, calibrate, classify and stream; where random numbers or long recursions rule SQL out, the tests hold them to properties."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from biowave.functions import arrays as A
from biowave.functions import kernels as K
from biowave.functions import metrics as M
from biowave.functions import spectral as X
from biowave.operators import calibrate, long_signals, margins, noise_library, order_statistics, samples, scans, scoring, splitting
from biowave.operators.denoise import denoise
from biowave.plans import sample_queries
from biowave.sources.adapters import SIGNALS_SQL, label_of, segments, signals, table
from biowave.streaming import windows

RATE = 128.0


def r(c, name: str, digits: int = 6):
    return F.round(c, digits).alias(name)


def noisy_segments(spark, sf, jobs=samples.drawn_jobs):
    """Mixed samples under the names of what was mixed in, tiled to 128 samples."""
    m = sample_queries.mixed(spark, sf, jobs)
    return m.select("seg", "snr", A.of_length(F.col("clean"), 128).alias("clean"), A.of_length(F.col("noisy"), 128).alias("noisy"), "noise_types", "noise_paths")


def calibration_segments(spark, sf):
    """What parameters are swept over: every segment with one kind of noise."""
    rows = noisy_segments(spark, sf, lambda s: samples.single_jobs(s, sample_queries.CALIBRATION_SNRS))
    return rows.select("clean", "noisy", "noise_types", "noise_paths")


def gains(spark, sf, method: str):
    rows = noisy_segments(spark, sf)
    if method in ("emd", "vmd", "ceemdan"):  # small rows that cost much: by their number, not their bytes
        rows = rows.repartition(4 * spark.sparkContext.defaultParallelism, "seg")
    d = denoise(rows, method, RATE)
    return d.select("seg", "snr", "noise_types", "ok", r(M.snr_gain(F.col("clean"), F.col("denoised"), F.col("noisy")), "gain", 5), F.size("denoised").alias("n"))


def denoise_iir(spark, sf):
    return gains(spark, sf, "hp")


def denoise_template(spark, sf, joined: int = 16):
    """Runs of segments one after the other, 8 seconds where none is missing, so that they hold several beats."""
    ecg = lambda seg: seg.select("seg", F.lit(0).alias("snr"), F.lit(1).alias("k"), F.array(F.lit("ECG")).alias("allowed"))
    m = sample_queries.mixed(spark, sf, ecg).withColumn("run", F.floor(F.col("seg") / joined))
    m = m.groupBy("run", "snr").agg(F.array_sort(F.collect_list(F.struct("seg", "clean", "noisy"))).alias("s"))
    whole = lambda name: F.flatten(F.transform("s", lambda v: v[name])).alias(name)
    rows = m.select((F.col("run") * joined).alias("seg"), "snr", whole("clean"), whole("noisy"), F.lit("ECG").alias("noise_types"), F.lit("").alias("noise_paths"))
    d = denoise(rows, "ts", RATE)
    return d.select("seg", "snr", "noise_types", "ok", r(M.snr_gain(F.col("clean"), F.col("denoised"), F.col("noisy")), "gain", 5), F.size("denoised").alias("n"))


def denoise_emd(spark, sf):
    return gains(spark, sf, "emd")


def denoise_vmd(spark, sf):
    return gains(spark, sf, "vmd")


def denoise_ceemdan(spark, sf):
    return gains(spark, sf, "ceemdan")


def denoise_summary(spark, sf):
    g = gains(spark, sf, "hp")
    kinds = F.when(F.col("noise_types") == "", "none").otherwise(F.col("noise_types"))
    return margins.cube_summary(g.select(kinds.alias("noise_types"), "snr", F.col("gain").alias("value")), ["noise_types", "snr"])


def filter_bands(spark, sf):
    """Power of each segment that a band, a high and a low-pass keep."""
    s = segments(spark, sf).select("seg", A.of_length(F.col("signal"), 128).alias("s"))
    kept = lambda of: A.power(X.mapped(F.col("s"), of))
    return s.select(
        "seg", r(kept(lambda x: K.band_pass(x, RATE, 8.0, 40.0)), "band"), r(kept(lambda x: K.high_pass(x, RATE, 20.0)), "high"),
        r(kept(lambda x: K.low_pass(x, RATE, 20.0)), "low"), r(kept(lambda x: K.without_tone(x, RATE, 30.0)), "notched"),
    )


def resample_poly(spark, sf):
    s = segments(spark, sf).select("seg", X.mapped(F.col("signal"), lambda x: K.resample(x, 1111, 1000)).alias("y"))
    return s.select("seg", F.size("y").alias("n"), r(A.power(F.col("y")), "power"))


def noise_synthesis(spark, sf):
    """A library item for each part: a type by its number."""
    kind = F.element_at(F.array(*map(F.lit, ("PLI", "WGN", "Color"))), (F.col("p_partkey") % 3).cast("int") + 1)
    jobs = table(spark, sf, "part").select(kind.alias("noise_type"), F.floor(F.col("p_partkey") / 3).alias("idx"))
    jobs = jobs.repartition(4 * spark.sparkContext.defaultParallelism)  # small rows that cost much
    n = noise_library.from_jobs(jobs, 256, 1000.0)
    return n.select("noise_type", F.coalesce("subtype", F.lit("")).alias("subtype"), "idx", F.size("signal").alias("n"), r(A.rms(F.col("signal")), "rms"))


def sweep_of(spark, sf, method: str, candidates: list):
    """Gains of candidates over the calibration samples, all of them, and how many of these each has worked on."""
    rows = calibration_segments(spark, sf)
    if method != "highpass":  # small rows that cost much
        rows = rows.repartition(4 * spark.sparkContext.defaultParallelism)
    return calibrate.sweep(rows, method, candidates, RATE).select("place", "candidate", r(F.col("gain"), "gain", 5), "n_ok", "best")


def sweep_highpass(spark, sf):
    return sweep_of(spark, sf, "highpass", [2.0, 5.0, 10.0, 20.0])


def sweep_emd(spark, sf):
    return sweep_of(spark, sf, "emd", [5.0, 10.0, 20.0])


def sweep_vmd(spark, sf):
    return sweep_of(spark, sf, "vmd", [3, 5, 8])


def sweep_ceemdan(spark, sf):
    return sweep_of(spark, sf, "ceemdan", [5.0, 20.0])


def fold_classification(spark, sf):
    """Scores of support vector machines that tell the halves of segments' labels from their samples, RMS and mean, three folds."""
    s = segments(spark, sf)
    x = F.col("signal")
    rows = s.select(F.col("seg").alias("id"), (F.col("seg") % 5).alias("subject"), (F.col("dataset") % 2).alias("label"), F.concat(F.array(A.rms(x), A.mean(x)), x).alias("features"))
    p = calibrate.cross_validated(splitting.stratified_folds(rows, "id", "label", 3), 3)
    return scoring.macro(p.select("label", "pred"), spark.range(2).select(F.col("id").cast("int").alias("class")))


def canvas_overwrite(spark, sf):
    """Every second window of 16 samples is put back scaled; what no segment covers stays."""
    t = signals(spark, sf).select("rec", "i", "x")
    s = t.withColumn("w", F.floor(F.col("i") / 16)).where("w % 2 = 0").groupBy("rec", "w").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"] * 0.5).alias("signal")
    )
    put = s.where(F.size("signal") == 16).select("rec", "w", F.posexplode("signal").alias("j", "y")).select("rec", (F.col("w") * 16 + F.col("j")).alias("i"), "y")
    canvas = t.join(put, ["rec", "i"], "left").withColumn("v", F.coalesce("y", "x"))
    return canvas.groupBy("rec").agg(F.count("y").alias("covered"), F.count(F.lit(1)).alias("n"), r(F.sum("v"), "total"))


def long_recordings(spark, sf):
    """Pieces of one recording for each type of event, in the order of the events."""
    rows = table(spark, sf, "events").select(label_of(F.col("event_type")).alias("rec"), "event_id", F.col("value").alias("x"))
    rows = scans.numbered(scans.parted_by_time(rows, "event_id"), ["event_id"], "i")
    return long_signals.pieces_of(rows, F.col("x"), 1000)


def long_filters(spark, sf):
    """Power of each recording in a band, without a tone, and at another rate, worked out in blocks of 512 samples."""
    p = long_recordings(spark, sf)
    band, toneless = long_signals.band_pass(p, RATE, 8.0, 40.0, 4, 512), long_signals.without_tone(p, RATE, 30.0, 5.0, 512)
    slower = long_signals.resampled(p, 1111, 1000, 512)
    of = lambda d, name: d.groupBy("rec").agg(F.sum(F.size("signal")).alias(f"{name}_n"), r(F.sum(A.power(F.col("signal"))), name, 3))
    return of(p, "whole").join(of(band, "band"), "rec").join(of(toneless, "toneless"), "rec").join(of(slower, "slower"), "rec")


def long_hampel(spark, sf):
    h = long_signals.hampel_windows(long_recordings(spark, sf), RATE, 0.5, 0.25, 512)
    return h.select("rec", "n", r(F.col("largest"), "largest"), r(F.col("mean"), "mean"))


def group_quantiles(spark, sf):
    """The 0.99-quantile of magnitudes about 50 by type of event, and of prices by return flag."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("of"), F.abs(F.col("value") - 50.0).alias("v"))
    p = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("of"), F.col("l_extendedprice").alias("v"))
    q = order_statistics.quantile(e.unionByName(p), ["of"], F.col("v"), 0.99)
    return q.select("of", "n", r(F.col("quantile"), "quantile", 4))


def stream_windows(spark, sf):
    """Hourly features of the events as a stream; windows come out when the watermark has passed them."""
    schema = table(spark, sf, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    samples = e.select(F.col("user_id").alias("rec"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("x"), label_of(F.col("event_type")).alias("label"))
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="biowave-")
    place = f"{base}/biowave/stream-{uuid.uuid4().hex}"
    out = windows.drain(spark, windows.windowed(samples, "1 hour"), f"{place}/out", f"{place}/state")
    return out.select("rec", F.unix_seconds("w.start").alias("start"), "n", r(F.col("arv"), "arv"), r(F.col("rms"), "rms"), "label")


QUERIES = {f.__name__: f for f in (
    denoise_iir, denoise_template, denoise_emd, denoise_vmd, denoise_ceemdan, denoise_summary, filter_bands, resample_poly, noise_synthesis, sweep_highpass, sweep_emd, sweep_vmd, sweep_ceemdan,
    fold_classification, canvas_overwrite, stream_windows, long_filters, long_hampel, group_quantiles,
)}

ORACLE_SQL = {
    "group_quantiles": """WITH v AS (
            SELECT event_type AS of, abs(value - 50.0) AS v FROM events UNION ALL SELECT l_returnflag, l_extendedprice FROM lineitem)
        SELECT of, count(v) AS n, round(quantile_cont(v, 0.99), 4) AS quantile FROM v GROUP BY of""",
    "canvas_overwrite": f"""WITH {SIGNALS_SQL},
        c AS (SELECT *, i // 16 AS w, count(*) OVER (PARTITION BY rec, i // 16) AS m FROM sig)
        SELECT rec, count(*) FILTER (WHERE w % 2 = 0 AND m = 16) AS covered, count(*) AS n, round(sum(CASE WHEN w % 2 = 0 AND m = 16 THEN x * 0.5 ELSE x END), 6) AS total
        FROM c GROUP BY rec""",
    "stream_windows": f"""WITH {SIGNALS_SQL},
        w AS (SELECT *, us // 3600000000 * 3600 AS start FROM sig)
        SELECT rec, start, count(*) AS n, round(avg(abs(x)), 6) AS arv, round(sqrt(avg(x * x)), 6) AS rms, max(label) AS label
        FROM w GROUP BY rec, start HAVING (start + 3600) * 1000000 <= (SELECT max(us) FROM sig) - 600000000""",
}
