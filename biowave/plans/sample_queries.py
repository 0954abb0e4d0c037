"""Queries over mixed samples: segments are the clean signals, users' recordings the noise library."""

from __future__ import annotations

from pyspark.sql import functions as F

from biowave.functions import arrays as A
from biowave.functions import metrics as M
from biowave.operators import gesture, identity, margins, mixing, samples
from biowave.sources.adapters import SAMPLES_SQL, segments, signals, table

SIZE = 64
LABEL_ORDER = ("PLI", "ECG", "MOA", "WGN", "Color", "Pink", "Brown", "k=1", "k=2", "k=3", "k=4", "k=5")
FATIGUE_SNRS = (-10, 0, 10)
CALIBRATION_SNRS = (-10, -5, 0, 5, 10)


def r(c, name: str, digits: int = 5):
    return (F.round(c, digits) + 0.0).alias(name)


def noise_items(spark, sf):
    """Recordings as items of a library: user ids count from 0 without gaps, and the types take turns."""
    s = signals(spark, sf).groupBy("rec").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("signal"))
    kind = F.element_at(F.array(*map(F.lit, mixing.NOISE_TYPES)), (F.col("rec") % 5).cast("int") + 1)
    items = s.select(kind.alias("noise_type"), F.floor(F.col("rec") / 5).cast("int").alias("idx"), "signal")
    colour = F.when(F.col("noise_type") != "Color", "").when(F.col("idx") % 2 == 0, "_pink").otherwise("_brown")
    return items.withColumn("path", F.concat("noise_type", F.lit("/"), F.lower("noise_type"), colour, F.lit("_"), F.col("idx").cast("string"), F.lit(".npy")))


def mixed(spark, sf, jobs):
    seg = segments(spark, sf).select("seg", F.col("signal").alias("clean"))
    return samples.mixed_samples(seg, jobs(seg), noise_items(spark, sf), SIZE)


def digest(rows):
    noise = A.rms(M.difference(F.col("clean"), F.col("noisy")))
    return rows.select("seg", "snr", "k", "noise_types", "noise_paths", "wgn_capped", r(noise, "noise_rms"), r(A.total(F.col("noisy")), "total"), r(F.element_at("scalars", 1), "first_scalar"))


def mixed_grid(spark, sf):
    return digest(mixed(spark, sf, samples.grid_jobs))


def mixed_combined(spark, sf):
    return digest(mixed(spark, sf, samples.drawn_jobs))


def mixed_fatigue(spark, sf):
    return digest(mixed(spark, sf, lambda s: samples.grid_jobs(s, FATIGUE_SNRS, 4, for_all_k=True)))


def mixed_calibration(spark, sf):
    return digest(mixed(spark, sf, lambda s: samples.single_jobs(s, CALIBRATION_SNRS)))


def noise_type_table(spark, sf):
    """Means, spreads and numbers of each metric by label, in the labels' order."""
    c, o = F.col("clean"), F.col("noisy")
    rows = mixed(spark, sf, samples.drawn_jobs).select(
        F.explode(mixing.labels_of(F.col("noise_types"), F.col("noise_paths"))).alias("label"), M.rmse(c, o).alias("RMSE"), M.prd(c, o).alias("PRD"))
    wide = margins.label_table(rows, "label", ["RMSE", "PRD"], LABEL_ORDER)
    return wide.select("place", "label", *[r(F.col(f"{m}_{s}"), f"{m.lower()}_{s}", 4) for m in ("RMSE", "PRD") for s in ("mean", "std")], F.col("RMSE_n").alias("n"))


def gesture_raw(spark, sf):
    """Raw trials: band, resampling, 0 .. 1 and the largest of every ten."""
    s = segments(spark, sf).select("seg", gesture.from_raw(F.col("signal"), 128, 100, 8.0, 40.0).alias("x"))
    return s.select("seg", F.size("x").alias("n"), r(A.total(F.col("x")), "total"), F.size(gesture.sampled(F.col("x"), 10)).alias("n_sampled"))


def gesture_denoised(spark, sf):
    """Denoised trials: 0 .. 1 and the largest of every ten; and trials of the output rate, which are only scaled."""
    s = segments(spark, sf).select("seg", gesture.from_denoised(F.col("signal")).alias("x"))
    s = s.select("seg", "x", gesture.sampled(F.col("x"), 10).alias("y"), gesture.sampled(F.col("x"), 1).alias("z"))
    return s.select("seg", F.size("y").alias("n_sampled"), r(A.total(F.col("y")), "sampled"), F.size("z").alias("n"), r(A.total(F.col("z")), "total"))


def label_file_match(spark, sf):
    """The label file of each subject's trials: its name holds the trial's number, and of several the smallest last number wins."""
    s = table(spark, sf, "supplier")
    name = F.concat(F.lit("s"), F.col("s_nationkey").cast("string"), F.lit("_trial"), (F.col("s_suppkey") % 7).cast("string"), F.lit("_v"), F.col("s_suppkey").cast("string"), F.lit(".csv"))
    trials = s.select(F.col("s_nationkey").alias("subject"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("trial")).distinct()
    return identity.label_files(s.select(F.col("s_nationkey").alias("subject"), name.alias("name")), trials)


def online(spark, sf):
    """Two epochs of training samples: continuous SNRs and two to four kinds of noise, drawn anew for each."""
    seg = segments(spark, sf).select("seg", F.col("signal").alias("clean"))
    jobs = samples.epoch_jobs(seg, [0, 1], -15.0, 15.0, 2, 4)
    return samples.mixed_samples(seg, jobs, noise_items(spark, sf), SIZE, key=("epoch", "seg"))


def online_epochs(spark, sf):
    rows = samples.training_pairs(online(spark, sf))
    noise = A.rms(M.difference(F.col("clean"), F.col("noisy")))
    return rows.select(
        "epoch", "seg", "snr", "k", "noise_types", "noise_paths", "wgn_capped", r(noise, "noise_rms"), r(F.col("scale"), "scale"),
        r(A.total(F.col("clean_norm")), "clean_total", 4), r(A.total(F.col("noisy_norm")), "noisy_total", 4),
    )


def online_stats(spark, sf):
    s = samples.mixing_stats(online(spark, sf), ["epoch"])
    return s.select("epoch", "kind", "name", "n", r(F.col("snr_mean"), "snr_mean"), "snr_low", "snr_high")


QUERIES = {f.__name__: f for f in (
    online_epochs, online_stats, mixed_grid, mixed_combined, mixed_fatigue, mixed_calibration, noise_type_table, gesture_raw, gesture_denoised, label_file_match,
)}


def number_sql(*keys: str) -> str:
    return f"('0x' || substr(md5({" || '|' || ".join(keys)}), 1, 8))::BIGINT"


def drawn_sql(values, salt: str) -> str:
    return f"({list(values)})[{number_sql('vec_id', repr(salt))} % {len(values)} + 1]::INT"


def samples_sql(jobs: str, excluded: str, key: tuple[str, ...] = ("seg", "snr", "k")) -> str:
    """Up to one row per job and sample (smx), and the jobs' names and first scalars (nam)."""
    cols, key = ", ".join(dict.fromkeys([*key, "seg", "snr", "k"])), (*key, "ty")
    return f"""WITH {SAMPLES_SQL},
lib AS (
    SELECT (['PLI', 'WGN', 'ECG', 'MOA', 'Color'])[user_id % 5 + 1] AS ty, user_id // 5 AS idx, list(value ORDER BY ts, event_id) AS v, count(*) AS n
    FROM events GROUP BY user_id),
itm AS (
    SELECT *, CASE WHEN n < {SIZE} THEN n * ({SIZE} // n + 2) ELSE n END - {SIZE - 1} AS windows, count(*) OVER (PARTITION BY ty) AS items,
           ty || '/' || lower(ty) || CASE WHEN ty <> 'Color' THEN '' WHEN idx % 2 = 0 THEN '_pink' ELSE '_brown' END || '_' || idx || '.npy' AS path FROM lib),
job AS ({jobs}),
typ AS (
    SELECT job.*, ty, o, row_number() OVER (PARTITION BY {cols} ORDER BY {number_sql(*key, "'type'")}, ty) AS p
    FROM job, (VALUES ('PLI', 1), ('WGN', 2), ('ECG', 3), ('MOA', 4), ('Color', 5)) t(ty, o) WHERE NOT ({excluded})),
prt AS (SELECT *, bool_or(ty = 'WGN') OVER (PARTITION BY {cols}) AS wgn FROM typ WHERE p <= k),
num AS (SELECT prt.*, {number_sql(*key, "'item'")} % items AS idx FROM prt JOIN (SELECT DISTINCT ty, items FROM itm) USING (ty)),
put AS (SELECT num.*, path, v, n, {number_sql(*key, "'start'")} % windows AS start FROM num JOIN itm USING (ty, idx)),
win AS (SELECT {cols}, o, i, v[(start + i) % n + 1] AS y FROM put, range(0, {SIZE}) r(i)),
own AS (SELECT {cols}, o, sum(y * y) AS own FROM win GROUP BY ALL),
pow AS (SELECT seg, sum(x * x) AS cp, sum(x * x) / pow(10.0, -0.5) AS fl FROM smp GROUP BY seg),
fac AS (
    SELECT {cols.replace("seg", "put.seg")}, o, ty, path, wgn,
           sqrt(CASE WHEN wgn AND k > 1 AND cp / pow(10.0, snr / 10.0) / k > fl
                     THEN CASE WHEN ty = 'WGN' THEN fl ELSE greatest(cp / pow(10.0, snr / 10.0) - fl, 0) / (k - 1) END
                     ELSE cp / pow(10.0, snr / 10.0) / k END / own) AS f
    FROM put JOIN own USING ({cols}, o) JOIN pow ON pow.seg = put.seg),
nam AS (
    SELECT {cols}, string_agg(ty, '+' ORDER BY o) AS noise_types, string_agg(path, '|' ORDER BY o) AS noise_paths,
           any_value(wgn) AND k >= 2 AND snr + 10 * log10(k) < -5 AS wgn_capped, arg_min(f, o) AS first_scalar
    FROM fac GROUP BY {cols}),
noi AS (SELECT {cols}, i, sum(f * y) AS e FROM win JOIN fac USING ({cols}, o) GROUP BY {cols}, i),
smx AS (SELECT noi.*, x FROM noi JOIN smp USING (seg, i))"""


DIGEST_SQL = """
SELECT seg, snr, k, noise_types, noise_paths, wgn_capped, round(noise_rms, 5) + 0.0 AS noise_rms, round(total, 5) + 0.0 AS total, round(first_scalar, 5) + 0.0 AS first_scalar
FROM nam JOIN (SELECT seg, snr, k, sqrt(avg(e * e)) AS noise_rms, sum(x + e) AS total FROM smx GROUP BY seg, snr, k) USING (seg, snr, k)"""
ALONE = "k = 1 AND snr < -5 AND ty = 'WGN'"
GRID_JOBS = "SELECT vec_id AS seg, s::INT AS snr, k::INT AS k FROM embeddings, range(-15, 16, 5) a(s), range(1, 6) b(k)"
DRAWN_JOBS = f"SELECT vec_id AS seg, {drawn_sql(mixing.SNR_GRID, 'snr')} AS snr, {drawn_sql(range(1, 6), 'k')} AS k FROM embeddings"
PLACES = ", ".join(f"('{label}', {place})" for place, label in enumerate(LABEL_ORDER, 1))

EPOCH_JOBS = f"""
    SELECT epoch, vec_id AS seg, round(-15.0 + 30.0 * ({number_sql("epoch", "vec_id", "'snr'")} / 4294967296.0::DOUBLE), 3) AS snr,
           (2 + {number_sql("epoch", "vec_id", "'k'")} % 3)::INT AS k
    FROM embeddings, (VALUES (0), (1)) e(epoch)"""
ONLINE_SQL = samples_sql(EPOCH_JOBS, ALONE, ("epoch", "seg"))

ORACLE_SQL = {
    "online_epochs": ONLINE_SQL + """,
        q AS (SELECT epoch, seg, quantile_cont(abs(x + e), 0.99) AS q FROM smx GROUP BY epoch, seg),
        c AS (SELECT epoch, seg, CASE WHEN q < 1e-12 THEN 1.0 ELSE q END AS scale FROM q),
        t AS (
            SELECT epoch, seg, sqrt(avg(e * e)) AS noise_rms, any_value(scale) AS scale, sum(greatest(least(x / scale, 1), -1)) AS clean_total,
                   sum(greatest(least((x + e) / scale, 1), -1)) AS noisy_total
            FROM smx JOIN c USING (epoch, seg) GROUP BY epoch, seg)
        SELECT epoch, seg, snr, k, noise_types, noise_paths, wgn_capped, round(noise_rms, 5) + 0.0 AS noise_rms, round(scale, 5) + 0.0 AS scale,
               round(clean_total, 4) + 0.0 AS clean_total, round(noisy_total, 4) + 0.0 AS noisy_total
        FROM nam JOIN t USING (epoch, seg)""",
    "online_stats": ONLINE_SQL + """,
        w AS (
            SELECT epoch, snr, 'type' AS kind, unnest(string_split(noise_types, '+')) AS name FROM nam
            UNION ALL SELECT epoch, snr, 'k', k::VARCHAR FROM nam UNION ALL SELECT epoch, snr, 'all', '' FROM nam)
        SELECT epoch, kind, name, count(*) AS n, round(avg(snr), 5) + 0.0 AS snr_mean, min(snr) AS snr_low, max(snr) AS snr_high FROM w GROUP BY epoch, kind, name""",
    "mixed_grid": samples_sql(GRID_JOBS, ALONE) + DIGEST_SQL,
    "mixed_combined": samples_sql(DRAWN_JOBS, ALONE) + DIGEST_SQL,
    "mixed_fatigue": samples_sql("SELECT vec_id AS seg, s::INT AS snr, k::INT AS k FROM embeddings, (VALUES (-10), (0), (10)) a(s), range(1, 5) b(k)", "snr < -5 AND ty = 'WGN'") + DIGEST_SQL,
    "mixed_calibration": samples_sql(f"SELECT vec_id AS seg, {drawn_sql(CALIBRATION_SNRS, 'snr')} AS snr, 1 AS k FROM embeddings", "false") + DIGEST_SQL,
    "noise_type_table": samples_sql(DRAWN_JOBS, ALONE) + f""",
        met AS (SELECT seg, snr, k, sqrt(avg(e * e)) AS rmse, sqrt(sum(e * e) / (sum(x * x) + 1e-12)) * 100 AS prd FROM smx GROUP BY seg, snr, k),
        lab AS (
            SELECT seg, snr, k, unnest(list_concat(string_split(noise_types, '+'),
                CASE WHEN noise_paths LIKE '%\\_pink\\_%' ESCAPE '\\' THEN ['Pink'] WHEN noise_paths LIKE '%\\_brown\\_%' ESCAPE '\\' THEN ['Brown'] ELSE [] END, ['k=' || k])) AS label FROM nam)
        SELECT place, lab.label AS label, round(avg(rmse), 4) + 0.0 AS rmse_mean, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(rmse) END, 4) + 0.0 AS rmse_std,
               round(avg(prd), 4) + 0.0 AS prd_mean, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(prd) END, 4) + 0.0 AS prd_std, count(*) AS n
        FROM lab JOIN met USING (seg, snr, k) JOIN (VALUES {PLACES}) o(label, place) ON o.label = lab.label GROUP BY place, lab.label""",
    "gesture_denoised": f"""WITH {SAMPLES_SQL},
        b AS (SELECT seg, min(x) AS lo, CASE WHEN max(x) - min(x) < 1e-12 THEN 1.0 ELSE max(x) - min(x) END AS d FROM smp GROUP BY seg),
        m AS (SELECT seg, i, (x - lo) / d AS v FROM smp JOIN b USING (seg)),
        s AS (SELECT seg, i // 10 AS j, max(v) AS v FROM m WHERE i < 60 GROUP BY seg, i // 10),
        t AS (SELECT seg, count(*)::INT AS n_sampled, round(sum(v), 5) + 0.0 AS sampled FROM s GROUP BY seg)
        SELECT seg, n_sampled, sampled, n, total FROM t JOIN (SELECT seg, count(*)::INT AS n, round(sum(v), 5) + 0.0 AS total FROM m GROUP BY seg) USING (seg)""",
    "label_file_match": """WITH f AS (
            SELECT s_nationkey AS subject, s_suppkey, 's' || s_nationkey || '_trial' || (s_suppkey % 7) || '_v' || s_suppkey || '.csv' AS name FROM supplier),
        t AS (SELECT DISTINCT s_nationkey AS subject, unnest(range(0, 7))::INT AS trial FROM supplier),
        m AS (
            SELECT t.subject, trial, name, row_number() OVER (PARTITION BY t.subject, trial ORDER BY s_suppkey, name) AS p
            FROM t JOIN f ON f.subject = t.subject AND regexp_matches(name, '(^|[^0-9])' || trial || '([^0-9]|$)'))
        SELECT subject, trial, name FROM m WHERE p = 1""",
}
