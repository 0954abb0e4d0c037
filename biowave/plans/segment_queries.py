"""Queries over fixed segments: the driver's embeddings, 64 samples each."""

from __future__ import annotations

from pyspark.sql import functions as F

from biowave.functions import arrays as A
from biowave.functions import metrics as M
from biowave.functions import spectral as X
from biowave.operators import margins, mixing
from biowave.sources.adapters import SAMPLES_SQL, segments

GRID = (-15, -5, 0, 10)


def r(c, name: str, digits: int = 6):
    return F.round(c, digits).alias(name)


def mixed(spark, sf, snrs=GRID, most: int = 3):
    """Each segment mixed with k others at a total SNR: partner j of segment s is (31 s + 17 j + 7) modulo their number."""
    seg = segments(spark, sf)
    n = seg.count()
    powers = seg.select("seg", "dataset", "signal", A.power(F.col("signal")).alias("p"))
    partners = seg.select("seg", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("j")).withColumn("other", (F.col("seg") * 31 + F.col("j") * 17 + 7) % n)
    other = powers.select(F.col("seg").alias("other"), F.col("signal").alias("noise"), F.col("p").alias("noise_power"))
    # a segment meets its `most` partners once; every SNR and number of them is worked out in place
    met = partners.join(other, "other").groupBy("seg").agg(F.sort_array(F.collect_list(F.struct("j", "noise", "noise_power"))).alias("_parts"))
    clean = powers.select("seg", "dataset", F.col("signal").alias("clean"), F.col("p").alias("clean_power"))
    jobs = F.array(*[F.struct(F.lit(s).alias("snr"), F.lit(k).alias("k")) for s in snrs for k in range(1, most + 1)])

    def noise(job):
        target = mixing.component_power(F.col("clean_power"), job["snr"], job["k"], F.lit(False), F.lit(False))
        factor = lambda part: F.when(part["noise_power"] > mixing.TINY, F.sqrt(target / part["noise_power"])).otherwise(0.0)
        none = F.transform(F.col("_parts")[0]["noise"], lambda v: v * 0.0)
        added = lambda s, part: A.let(factor(part), lambda f: F.zip_with(s, part["noise"], lambda a, b: a + b * f))
        return F.aggregate(F.slice("_parts", 1, job["k"]), none, added)

    mix = F.transform(jobs, lambda job: F.struct(job["snr"].alias("snr"), job["k"].alias("k"), noise(job).alias("noise")))
    out = met.join(clean, "seg").select("seg", "dataset", "clean", "clean_power", F.explode(mix).alias("_m"))
    return out.select("seg", "dataset", "clean", "clean_power", "_m.*").withColumn("noisy", F.zip_with("clean", "noise", lambda a, b: a + b))


def mix_metric_margin(spark, sf):
    error = A.power(M.difference(F.col("clean"), F.col("noisy")))
    m = mixed(spark, sf).select("snr", "k", "clean_power", F.size("clean").alias("n"), error.alias("error"))
    c, e = F.col("clean_power"), F.col("error")
    rows = m.select("snr", "k", F.explode(F.create_map(
        F.lit("SNR"), M.snr_of(c, e), F.lit("RMSE"), F.sqrt(e / F.col("n")), F.lit("PRD"), M.prd_of(c, e)
    )).alias("metric", "value"))
    return margins.cube_summary(rows, ["metric", "snr", "k"]).where("metric <> 'Avg'").select("metric", "snr", "k", (F.round("mean", 5) + 0.0).alias("mean"), r(F.col("std"), "std", 5), "n")


def snr_by_k_table(spark, sf):
    m = mixed(spark, sf).select("snr", "k", M.rmse(F.col("clean"), F.col("noisy")).alias("value"))
    wide = margins.pivoted(m, "snr", "k", ["1", "2", "3"], prefix="k")
    return wide.select("snr", *[r(F.col(c), c, 5) for c in ("k1", "k2", "k3", "avg")])


def scale_factors_all(spark, sf):
    seg, out = segments(spark, sf), []
    for method in ("Q99", "Q95", "RMS", "MAD", "STD", "MAX"):
        out.append(r(A.scale(F.col("signal"), method), method.lower(), 7))
    return seg.select("seg", *out)


def scale_floors(spark, sf):
    zero = F.when(F.col("seg") % 5 == 0, F.transform("signal", lambda v: v * 0.0)).otherwise(F.col("signal"))
    seg = segments(spark, sf).select("seg", zero.alias("signal"))
    return seg.select("seg", r(A.scale(F.col("signal"), "RMS", "one"), "floor_one", 7), r(A.scale(F.col("signal"), "RMS", "tiny"), "floor_tiny", 7))


def normalize_clip(spark, sf):
    c = segments(spark, sf).select("seg", A.clipped(F.col("signal"), A.scale(F.col("signal"), "Q95")).alias("c"))
    at_limit = F.size(F.filter("c", lambda v: F.abs(v) >= 1.0))
    return c.select("seg", r(A.total(F.col("c")), "total"), r(A.power(F.col("c")), "power"), at_limit.alias("at_limit"))


def minmax_channels(spark, sf):
    c = segments(spark, sf).select("seg", A.min_max(F.col("signal")).alias("c"))
    return c.select("seg", r(A.total(F.col("c")), "total"), r(F.array_min("c"), "low"), r(F.array_max("c"), "high"))


def max_abs_decimate(spark, sf):
    c = segments(spark, sf).select("seg", F.posexplode(A.decimated(F.col("signal"), 10)).alias("j", "v"))
    return c.select("seg", "j", r(F.col("v"), "v"))


def length_normalise(spark, sf):
    s = F.col("signal")
    return segments(spark, sf).select("seg", r(A.total(A.of_length(s, 150)), "tiled", 6), r(A.total(A.of_length(s, 40)), "cut", 6), F.size(A.of_length(s, 150)).alias("n"))


def segment_metrics(spark, sf):
    m = mixed(spark, sf, (-5, 5), 1)
    c, o = F.col("clean"), F.col("noisy")
    return m.select(
        "seg", "snr", r(M.snr(c, o), "snr_db", 5), r(M.rmse(c, o), "rmse"), r(M.prd(c, o), "prd", 5),
        r(M.rmse_of(c, o, 20, M.mean_rectified, tail=True), "rmse_arv"), r(M.rmse_of(c, o, 20, M.zero_crossing_rate(1000.0, 20)), "rmse_zcr", 5),
        r(M.rmse_of(c, o, 20, M.kurtosis), "rmse_kurtosis", 5),
    )


def snr_gain(spark, sf):
    m = mixed(spark, sf, (0,), 1).withColumn("denoised", F.zip_with("clean", "noise", lambda c, n: c + 0.5 * n))
    return m.select("seg", r(M.snr_gain(F.col("clean"), F.col("denoised"), F.col("noisy")), "gain", 5))


def spectral_features(spark, sf):
    f = segments(spark, sf).select("seg", X.spectral(F.col("signal"), 64.0).alias("f"))
    return f.select("seg", r(F.col("f.mnf"), "mnf", 5), r(F.col("f.mdf"), "mdf", 5), r(F.col("f.tp"), "tp", 5), r(F.col("f.mp"), "mp", 5), r(F.col("f.dominant"), "dominant", 5))


def welch_quality(spark, sf):
    q = segments(spark, sf).select("seg", X.quality(F.col("signal"), 256.0, 64, 64).alias("q"))
    return q.select("seg", *[r(F.col(f"q.{c}"), c, 5) for c in ("smr_db", "spr_db", "shr_db", "ohm", "dpr_db")])


def lsd_frames(spark, sf):
    m = mixed(spark, sf, (0,), 1)
    e = m.select("seg", X.spectral_errors(F.col("clean"), F.col("noisy"), 64.0, 16, 16, 8, 4.0, 32.0).alias("e"))
    return e.select("seg", r(F.col("e.lsd"), "lsd", 5))


def spectral_error_metrics(spark, sf):
    m = mixed(spark, sf, (0,), 1)
    e = m.select("seg", X.spectral_errors(F.col("clean"), F.col("noisy"), 64.0, 16, 16, 8, 4.0, 32.0).alias("e"))
    return e.select("seg", r(F.col("e.rmse_mnf"), "rmse_mnf", 5), r(F.col("e.rmse_mdf"), "rmse_mdf", 5))


def hampel_time(spark, sf):
    h = segments(spark, sf).select("seg", X.hampel_time(F.col("signal"), 3, 3.0).alias("f"))
    return h.select("seg", F.col("f.replaced").cast("bigint").alias("replaced"), r(F.col("f.total"), "total"), r(F.col("f.power"), "power"))


def hampel_freq(spark, sf):
    return segments(spark, sf).select("seg", r(X.hampel_energy(F.col("signal"), 5, 3.0), "removed"))


def soft_threshold(spark, sf):
    by = A.universal_threshold(F.col("signal")) / 4.0
    s = segments(spark, sf).withColumn("by", by)
    return s.select("seg", r(F.col("by"), "threshold"), r(A.power(A.soft_threshold(F.col("signal"), F.col("by"))), "power"))


def interval_threshold(spark, sf):
    s = segments(spark, sf).select("seg", X.interval_shrunk(F.col("signal"), 4.0).alias("f"))
    return s.select("seg", r(F.col("f.total"), "total"), r(F.col("f.power"), "power"), F.col("f.runs").cast("bigint").alias("runs"))


def moving_average(spark, sf):
    m = segments(spark, sf).select("seg", F.posexplode(A.moving_average(F.col("signal"), 5)).alias("i", "v"))
    return m.select("seg", "i", r(F.col("v"), "v"))


def waveform_features(spark, sf):
    """Time-domain features of a window: RMS, mean magnitude, waveform length, crossings by product over n."""
    s = F.col("signal")
    steps = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.abs(b - a))
    turns = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.when(a * b < 0, 1.0).otherwise(0.0))
    return segments(spark, sf).select("seg", r(A.rms(s), "rms"), r(A.mean(A.absolute(s)), "mav"), r(A.total(steps), "wl"), r(A.total(turns) / F.size(s), "zc"))


def top_correlated(spark, sf):
    """The six segments of each dataset whose magnitude of correlation with its first segment is largest."""
    from pyspark.sql import Window

    seg = segments(spark, sf)
    first = seg.groupBy("dataset").agg(F.min_by(F.struct("seg", "signal"), "seg").alias("t"))
    s, t = F.col("signal"), F.col("t.signal")
    corr = (A.dot(s, t) / F.size(s) - A.mean(s) * A.mean(t)) / (A.std(s) * A.std(t))
    both = seg.join(first, "dataset").where("seg <> t.seg").withColumn("c", F.round(F.abs(corr), 8))
    order = Window.partitionBy("dataset").orderBy(F.desc("c"), "seg")
    return both.withColumn("place", F.row_number().over(order)).where("place <= 6").select("dataset", "place", "seg", r(F.col("c"), "c", 5))


QUERIES = {f.__name__: f for f in (
    mix_metric_margin, snr_by_k_table, scale_factors_all, scale_floors, normalize_clip, minmax_channels, max_abs_decimate, length_normalise,
    segment_metrics, snr_gain, spectral_features, welch_quality, lsd_frames, spectral_error_metrics, hampel_time, hampel_freq, soft_threshold,
    interval_threshold, moving_average, waveform_features, top_correlated,
)}


def mix_sql(snrs, most: int) -> str:
    grid = ", ".join(f"({s}, {k})" for s in snrs for k in range(1, most + 1))
    return f"""
WITH {SAMPLES_SQL},
pw AS (SELECT seg, sum(x * x) AS p FROM smp GROUP BY seg),
job AS (SELECT seg, snr, k FROM pw, (VALUES {grid}) g(snr, k)),
par AS (SELECT *, (seg * 31 + j * 17 + 7) % (SELECT count(*) FROM embeddings) AS other FROM (SELECT *, unnest(range(1, k + 1)) AS j FROM job)),
scl AS (
    SELECT par.seg, snr, k, other, CASE WHEN o.p > 1e-12 THEN sqrt(c.p / pow(10.0, snr / 10.0) / k / o.p) ELSE 0.0 END AS fac
    FROM par JOIN pw o ON o.seg = other JOIN pw c ON c.seg = par.seg),
noi AS (SELECT scl.seg, snr, k, i, sum(fac * x) AS noise FROM scl JOIN smp ON smp.seg = other GROUP BY scl.seg, snr, k, i),
mix AS (SELECT noi.seg, dataset, snr, k, noi.i AS i, x AS c, noise, x + noise AS o FROM noi JOIN smp ON noi.seg = smp.seg AND noi.i = smp.i),
met AS (
    SELECT seg, dataset, snr, k,
           CASE WHEN sum((o - c) * (o - c)) < 1e-12 THEN 100.0 ELSE 10.0 * log10(sum(c * c) / (sum((o - c) * (o - c)) + 1e-12)) END AS snr_db,
           sqrt(avg((o - c) * (o - c))) AS rmse, sqrt(sum((o - c) * (o - c)) / (sum(c * c) + 1e-12)) * 100.0 AS prd
    FROM mix GROUP BY seg, dataset, snr, k)"""


DFT_SQL = """
mean AS (SELECT seg, avg(x) AS m FROM smp GROUP BY seg),
dft AS (
    SELECT seg, f, (power(sum((x - m) * cos(2 * pi() * f * i / 64)), 2) + power(sum((x - m) * sin(2 * pi() * f * i / 64)), 2)) / 64 AS p
    FROM smp JOIN mean USING (seg), range(0, 32) r(f) GROUP BY seg, f),
cum AS (SELECT *, sum(p) OVER (PARTITION BY seg ORDER BY f) AS c, sum(p) OVER (PARTITION BY seg) AS t FROM dft),
han AS (
    SELECT seg, f, power(sum(x * h * cos(2 * pi() * f * i / 64)), 2) + power(sum(x * h * sin(2 * pi() * f * i / 64)), 2) AS p
    FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * i / 63) AS h FROM smp), range(0, 33) r(f) GROUP BY seg, f)"""

ORACLE_SQL = {
    "mix_metric_margin": f"""{mix_sql(GRID, 3)},
        l AS (SELECT snr, k, unnest(['SNR', 'RMSE', 'PRD']) AS metric, unnest([snr_db, rmse, prd]) AS value FROM met)
        SELECT metric, coalesce(snr::VARCHAR, 'Avg') AS snr, coalesce(k::VARCHAR, 'Avg') AS k, round(avg(value), 5) + 0.0 AS mean,
               round(CASE WHEN count(*) = 1 THEN 0.0 ELSE stddev_samp(value) END, 5) AS std, count(*) AS n
        FROM l GROUP BY GROUPING SETS ((metric, snr, k), (metric, snr), (metric, k), (metric))""",
    "snr_by_k_table": f"""{mix_sql(GRID, 3)}
        SELECT coalesce(snr::VARCHAR, 'Avg') AS snr, round(avg(rmse) FILTER (WHERE k = 1), 5) AS k1, round(avg(rmse) FILTER (WHERE k = 2), 5) AS k2,
               round(avg(rmse) FILTER (WHERE k = 3), 5) AS k3, round(avg(rmse), 5) AS avg
        FROM met GROUP BY GROUPING SETS ((snr), ())""",
    "scale_factors_all": f"""WITH {SAMPLES_SQL},
        m AS (SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY seg) AS m FROM smp)
        SELECT seg, round(quantile_cont(abs(x), 0.99), 7) AS q99, round(quantile_cont(abs(x), 0.95), 7) AS q95, round(sqrt(avg(x * x)), 7) AS rms,
               round(quantile_cont(abs(x - m), 0.5) * 1.4826, 7) AS mad, round(stddev_pop(x), 7) AS std, round(max(abs(x)), 7) AS max
        FROM m GROUP BY seg""",
    "scale_floors": f"""WITH {SAMPLES_SQL},
        z AS (SELECT seg, sqrt(avg(CASE WHEN seg % 5 = 0 THEN 0.0 ELSE x * x END)) AS s FROM smp GROUP BY seg)
        SELECT seg, round(CASE WHEN s < 1e-12 THEN 1.0 ELSE s END, 7) AS floor_one, round(greatest(s, 1e-12), 7) AS floor_tiny FROM z""",
    "normalize_clip": f"""WITH {SAMPLES_SQL},
        q AS (SELECT seg, quantile_cont(abs(x), 0.95) AS s FROM smp GROUP BY seg),
        c AS (SELECT seg, greatest(least(x / CASE WHEN s < 1e-12 THEN 1.0 ELSE s END, 1.0), -1.0) AS c FROM smp JOIN q USING (seg))
        SELECT seg, round(sum(c), 6) AS total, round(sum(c * c), 6) AS power, count(*) FILTER (WHERE abs(c) >= 1.0)::INT AS at_limit FROM c GROUP BY seg""",
    "minmax_channels": f"""WITH {SAMPLES_SQL},
        b AS (SELECT seg, min(x) AS lo, CASE WHEN max(x) - min(x) < 1e-12 THEN 1.0 ELSE max(x) - min(x) END AS d FROM smp GROUP BY seg)
        SELECT seg, round(sum((x - lo) / d), 6) AS total, round(min((x - lo) / d), 6) AS low, round(max((x - lo) / d), 6) AS high
        FROM smp JOIN b USING (seg) GROUP BY seg""",
    "max_abs_decimate": f"""WITH {SAMPLES_SQL},
        p AS (SELECT *, (i // 10)::INT AS j, row_number() OVER (PARTITION BY seg, i // 10 ORDER BY abs(x) DESC, i) AS p FROM smp WHERE i < 60)
        SELECT seg, j, round(x, 6) AS v FROM p WHERE p = 1""",
    "length_normalise": f"""WITH {SAMPLES_SQL},
        t AS (SELECT seg, i, x, unnest(range(0, 3)) AS c FROM smp)
        SELECT seg, round(sum(x) FILTER (WHERE c * 64 + i < 150), 6) AS tiled, round(sum(x) FILTER (WHERE c = 0 AND i < 40), 6) AS cut,
               count(*) FILTER (WHERE c * 64 + i < 150)::INT AS n FROM t GROUP BY seg""",
    "segment_metrics": f"""{mix_sql((-5, 5), 1)},
        w AS (
            SELECT seg, snr, i // 20 AS w, count(*) AS n, avg(abs(c)) AS ca, avg(abs(o)) AS oa, stddev_pop(c) AS cs, stddev_pop(o) AS os,
                   kurtosis_pop(c) AS ck, kurtosis_pop(o) AS ok,
                   sum(CASE WHEN sign(c) <> sign(cb) THEN 1 ELSE 0 END) / 0.02 AS cz, sum(CASE WHEN sign(o) <> sign(ob) THEN 1 ELSE 0 END) / 0.02 AS oz
            FROM (SELECT *, lag(c) OVER q AS cb, lag(o) OVER q AS ob FROM mix WINDOW q AS (PARTITION BY seg, snr, i // 20 ORDER BY i))
            GROUP BY seg, snr, i // 20),
        v AS (
            SELECT seg, snr, sqrt(avg(power(ca - oa, 2))) AS a, sqrt(avg(power(cz - oz, 2)) FILTER (WHERE n = 20)) AS z,
                   sqrt(avg(power(CASE WHEN cs > 1e-12 THEN ck ELSE 0 END - CASE WHEN os > 1e-12 THEN ok ELSE 0 END, 2)) FILTER (WHERE n = 20)) AS k
            FROM w GROUP BY seg, snr)
        SELECT seg, snr, round(snr_db, 5) AS snr_db, round(rmse, 6) AS rmse, round(prd, 5) AS prd, round(a, 6) AS rmse_arv, round(z, 5) AS rmse_zcr,
               round(v.k, 5) AS rmse_kurtosis FROM met JOIN v USING (seg, snr)""",
    "snr_gain": f"""{mix_sql((0,), 1)}
        SELECT seg, round(10.0 * log10(sum(c * c) / (sum(power(c + 0.5 * noise - c, 2)) + 1e-12)) - 10.0 * log10(sum(c * c) / (sum(power(o - c, 2)) + 1e-12)), 5) AS gain
        FROM mix GROUP BY seg""",
    "spectral_features": f"""WITH {SAMPLES_SQL}, {DFT_SQL},
        a AS (SELECT seg, sum(f * p) / max(t) AS mnf, min(f) FILTER (WHERE c >= t / 2) AS mdf, max(t) AS tp, avg(p) AS mp FROM cum GROUP BY seg),
        d AS (SELECT seg, f, row_number() OVER (PARTITION BY seg ORDER BY p DESC) AS r FROM han)
        SELECT a.seg, round(mnf, 5) AS mnf, round(mdf::DOUBLE, 5) AS mdf, round(tp, 5) AS tp, round(mp, 5) AS mp, round(f::DOUBLE, 5) AS dominant
        FROM a JOIN d ON a.seg = d.seg AND r = 1""",
    "welch_quality": f"""WITH {SAMPLES_SQL},
        wi AS (SELECT seg, i AS j, x - avg(x) OVER (PARTITION BY seg) AS x, 0.5 - 0.5 * cos(2 * pi() * i / 64) AS h FROM smp),
        ps AS (
            SELECT seg, k, 4.0 * k AS f, (power(sum(x * h * cos(2 * pi() * k * j / 64)), 2) + power(sum(x * h * sin(2 * pi() * k * j / 64)), 2)) / (256.0 * 24.0)
                   * CASE WHEN k BETWEEN 1 AND 31 THEN 2 ELSE 1 END AS p
            FROM wi, range(0, 33) q(k) GROUP BY seg, k),
        tz AS (SELECT *, lag(f) OVER (PARTITION BY seg ORDER BY k) AS g, lag(p) OVER (PARTITION BY seg ORDER BY k) AS q FROM ps),
        ar AS (
            SELECT seg, sum((p + q) / 2 * (f - g)) AS m0, sum((p * f + q * g) / 2 * (f - g)) AS m1, sum((p * f * f + q * g * g) / 2 * (f - g)) AS m2,
                   sum(CASE WHEN f <= 20 THEN (p + q) / 2 * (f - g) ELSE 0 END) AS lo, sum(CASE WHEN g >= 102.4 THEN (p + q) / 2 * (f - g) ELSE 0 END) AS hi,
                   sum(CASE WHEN k IN (12, 25) THEN p * 4.0 ELSE 0 END) AS li
            FROM tz WHERE g IS NOT NULL GROUP BY seg),
        sm AS (SELECT seg, k, avg(p) OVER (PARTITION BY seg ORDER BY k ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS v FROM ps),
        dp AS (SELECT seg, max(v) AS top, min(CASE WHEN (k + 6.5) * 4.0 >= 102.4 THEN v END) AS bottom FROM sm WHERE k <= 20 GROUP BY seg)
        SELECT seg, round(10 * log10((m0 + 1e-12) / (lo + 1e-12)), 5) AS smr_db, round(10 * log10((m0 + 1e-12) / (li + 1e-12)), 5) AS spr_db,
               round(10 * log10((m0 + 1e-12) / (hi + 1e-12)), 5) AS shr_db, round(sqrt(m2 / (m0 + 1e-12)) / (m1 / (m0 + 1e-12) + 1e-12), 5) AS ohm,
               round(10 * log10((top + 1e-12) / (bottom + 1e-12)), 5) AS dpr_db FROM ar JOIN dp USING (seg)""",
    "lsd_frames": f"""{mix_sql((0,), 1)},
        fr AS (
            SELECT seg, t, i - 8 * t + 8 AS j, c, o FROM mix, range(0, 9) q(t) WHERE i - 8 * t + 8 >= 0 AND i - 8 * t + 8 < 16),
        wi AS (SELECT *, (0.5 - 0.5 * cos(2 * pi() * j / 15)) / 7.5 AS h FROM fr),
        ft AS (
            SELECT seg, t, f, power(sum(c * h * cos(2 * pi() * f * j / 16)), 2) + power(sum(c * h * sin(2 * pi() * f * j / 16)), 2) AS pc,
                   power(sum(o * h * cos(2 * pi() * f * j / 16)), 2) + power(sum(o * h * sin(2 * pi() * f * j / 16)), 2) AS po
            FROM wi, range(1, 9) q(f) GROUP BY seg, t, f),
        d AS (SELECT seg, t, sqrt(avg(power(10 * log10(pc + 1e-10) - 10 * log10(po + 1e-10), 2))) AS d FROM ft GROUP BY seg, t)
        SELECT seg, round(avg(d), 5) AS lsd FROM d GROUP BY seg""",
    "hampel_time": f"""WITH {SAMPLES_SQL},
        w AS (SELECT seg, i, x, least(greatest(i + o, 0), 63) AS j FROM smp, range(-3, 4) q(o)),
        m AS (SELECT w.seg, w.i, any_value(w.x) AS x, quantile_cont(s.x, 0.5) AS mid FROM w JOIN smp s ON s.seg = w.seg AND s.i = j GROUP BY w.seg, w.i),
        a AS (SELECT *, abs(x - mid) AS away FROM m),
        v AS (SELECT seg, i, x, mid, away, least(greatest(i + o, 0), 63) AS j FROM a, range(-3, 4) q(o)),
        s AS (
            SELECT v.seg, v.i, any_value(v.x) AS x, any_value(v.mid) AS mid, any_value(v.away) AS away, 1.4286 * quantile_cont(a.away, 0.5) AS spread
            FROM v JOIN a ON a.seg = v.seg AND a.i = j GROUP BY v.seg, v.i),
        h AS (SELECT *, spread > 1e-12 AND away > 3.0 * spread AS hit FROM s)
        SELECT seg, count(*) FILTER (WHERE hit) AS replaced, round(sum(CASE WHEN hit THEN mid ELSE x END), 6) AS total,
               round(sum(CASE WHEN hit THEN mid * mid ELSE x * x END), 6) AS power FROM h GROUP BY seg""",
    "soft_threshold": f"""WITH {SAMPLES_SQL},
        t AS (SELECT seg, quantile_cont(abs(x), 0.5) / 0.6745 * sqrt(2 * ln(64)) / 4 AS fac FROM smp GROUP BY seg)
        SELECT seg, round(any_value(fac), 6) AS threshold, round(sum(power(greatest(abs(x) - fac, 0), 2)), 6) AS power FROM smp JOIN t USING (seg) GROUP BY seg""",
    "interval_threshold": f"""WITH {SAMPLES_SQL},
        t AS (SELECT seg, quantile_cont(abs(x), 0.5) / 0.6745 * sqrt(2 * ln(64)) / 4 AS fac FROM smp GROUP BY seg),
        c AS (SELECT *, CASE WHEN (x < 0) <> (lag(x) OVER (PARTITION BY seg ORDER BY i) < 0) THEN 1 ELSE 0 END AS cut FROM smp),
        n AS (SELECT *, sum(cut) OVER (PARTITION BY seg ORDER BY i) AS run FROM c),
        m AS (SELECT *, max(abs(x)) OVER (PARTITION BY seg, run) AS top FROM n),
        y AS (SELECT seg, run, CASE WHEN top = 0 THEN x ELSE x * greatest((top - fac) / top, 0) END AS y FROM m JOIN t USING (seg))
        SELECT seg, round(sum(y), 6) AS total, round(sum(y * y), 6) AS power, (max(run) + 1)::BIGINT AS runs FROM y GROUP BY seg""",
    "moving_average": f"""WITH {SAMPLES_SQL}
        SELECT seg, i::INT AS i, round(sum(x) OVER (PARTITION BY seg ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS v FROM smp""",
    "waveform_features": f"""WITH {SAMPLES_SQL},
        b AS (SELECT *, lag(x) OVER (PARTITION BY seg ORDER BY i) AS b FROM smp)
        SELECT seg, round(sqrt(avg(x * x)), 6) AS rms, round(avg(abs(x)), 6) AS mav, round(sum(abs(x - b)), 6) AS wl,
               round(count(*) FILTER (WHERE x * b < 0) / 64.0, 6) AS zc FROM b GROUP BY seg""",
    "top_correlated": f"""WITH {SAMPLES_SQL},
        f AS (SELECT dataset, min(seg) AS t FROM smp GROUP BY dataset),
        c AS (
            SELECT s.dataset, s.seg, round(abs(corr(s.x, o.x)), 8) AS c FROM smp s JOIN f ON f.dataset = s.dataset AND f.t <> s.seg
            JOIN smp o ON o.seg = f.t AND o.i = s.i GROUP BY s.dataset, s.seg),
        p AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY c DESC, seg) AS place FROM c)
        SELECT dataset, place::INT AS place, seg, round(c, 5) AS c FROM p WHERE place <= 6""",
    "hampel_freq": f"""WITH {SAMPLES_SQL},
        ft AS (SELECT seg, f, sum(x * cos(2 * pi() * f * i / 64)) AS re, sum(x * sin(2 * pi() * f * i / 64)) AS im FROM smp, range(0, 33) q(f) GROUP BY seg, f),
        v AS (SELECT seg, 0 AS part, f, re AS v FROM ft UNION ALL SELECT seg, 1, f, im FROM ft),
        w AS (SELECT seg, part, f, v, least(greatest(f + o, 0), 32) AS j FROM v, range(-5, 6) q(o)),
        m AS (SELECT w.seg, w.part, w.f, any_value(w.v) AS v, quantile_cont(n.v, 0.5) AS mid FROM w JOIN v n ON n.seg = w.seg AND n.part = w.part AND n.f = j GROUP BY w.seg, w.part, w.f),
        a AS (SELECT *, abs(v - mid) AS away FROM m),
        b AS (SELECT *, least(greatest(f + o, 0), 32) AS j FROM a, range(-5, 6) q(o)),
        s AS (
            SELECT b.seg, b.part, b.f, any_value(b.v) AS v, any_value(b.mid) AS mid, any_value(b.away) AS away, 1.4286 * quantile_cont(n.away, 0.5) AS spread
            FROM b JOIN a n ON n.seg = b.seg AND n.part = b.part AND n.f = j GROUP BY b.seg, b.part, b.f),
        e AS (SELECT seg, sum(v * v) AS e0, sum(CASE WHEN spread > 1e-12 AND away > 3.0 * spread THEN mid * mid ELSE v * v END) AS e1 FROM s GROUP BY seg)
        SELECT seg, round(least(greatest((e0 - e1) / e0, 0), 1), 6) AS removed FROM e""",
    "spectral_error_metrics": f"""{mix_sql((0,), 1)},
        fr AS (
            SELECT mix.seg, t, j, c, o FROM range(0, 5) q(t), range(0, 16) w(j), mix WHERE mix.i = least(greatest(16 * t + j - 8, 0), 63)),
        fm AS (
            SELECT seg, t, f, sqrt(power(sum(c * cos(2 * pi() * f * j / 64)), 2) + power(sum(c * sin(2 * pi() * f * j / 64)), 2)) AS c,
                   sqrt(power(sum(o * cos(2 * pi() * f * j / 64)), 2) + power(sum(o * sin(2 * pi() * f * j / 64)), 2)) AS o
            FROM fr, range(4, 32) q(f) GROUP BY seg, t, f),
        mn AS (SELECT seg, sqrt(avg(power(c - o, 2))) AS e FROM (SELECT seg, t, sum(f * c) / sum(c) AS c, sum(f * o) / sum(o) AS o FROM fm GROUP BY seg, t) GROUP BY seg),
        wi AS (SELECT seg, i // 16 AS t, i % 16 AS j, c * (0.5 - 0.5 * cos(2 * pi() * (i % 16) / 63)) AS c, o * (0.5 - 0.5 * cos(2 * pi() * (i % 16) / 63)) AS o FROM mix),
        wp AS (
            SELECT seg, t, f, power(sum(c * cos(2 * pi() * f * j / 64)), 2) + power(sum(c * sin(2 * pi() * f * j / 64)), 2) AS c,
                   power(sum(o * cos(2 * pi() * f * j / 64)), 2) + power(sum(o * sin(2 * pi() * f * j / 64)), 2) AS o
            FROM wi, range(4, 33) q(f) GROUP BY seg, t, f),
        cu AS (
            SELECT *, sum(c) OVER k AS cc, sum(o) OVER k AS oc, sum(c) OVER (PARTITION BY seg, t) AS ct, sum(o) OVER (PARTITION BY seg, t) AS ot
            FROM wp WINDOW k AS (PARTITION BY seg, t ORDER BY f)),
        md AS (
            SELECT seg, sqrt(avg(power(c - o, 2))) AS e
            FROM (SELECT seg, t, min(f) FILTER (WHERE cc >= ct / 2) AS c, min(f) FILTER (WHERE oc >= ot / 2) AS o FROM cu GROUP BY seg, t) GROUP BY seg)
        SELECT mn.seg, round(mn.e, 5) AS rmse_mnf, round(md.e, 5) AS rmse_mdf FROM mn JOIN md USING (seg)""",
}
