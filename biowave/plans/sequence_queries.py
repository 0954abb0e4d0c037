"""Queries over recordings: the driver's events, one recording a user."""

from __future__ import annotations

from pyspark.sql import functions as F

from biowave.operators import sequences as S
from biowave.sources.adapters import SIGNALS_SQL, label_of, signals, table


def r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


def trial_islands(spark, sf):
    t = S.islands(signals(spark, sf), 2)
    return t.select("rec", F.col("trial_id").cast("bigint").alias("trial_id"), "trial_start", "trial_end", "gesture", "n")


def rest_active_snr(spark, sf):
    t = S.trial_snr(signals(spark, sf), 2)
    return t.select("rec", "trial_start", r("active_rms"), r("rest_rms"), r("snr_db"))


def stimulus_sessions(spark, sf):
    return S.sessions(signals(spark, sf), [1, 3]).select("rec", "session", "label", "first", "last", r("total"))


def tumbling_features(spark, sf):
    return S.tumbling(signals(spark, sf), 16).select("rec", "w", "n", r("arv"), *[F.coalesce(r(c, 5), F.lit(-1)).alias(c) for c in ("rms", "changes", "kurtosis")])


def sliding_boundary_skip(spark, sf):
    return S.sliding(signals(spark, sf), 8, 4).select("rec", "start", "label", r("mav"), r("wl"), r("rms"))


def sliding_waveforms(spark, sf):
    """Windows as arrays: their ends and total tell them apart."""
    w = S.sliding_waveforms(signals(spark, sf), 8, 4).withColumn("total", F.aggregate("signal", F.lit(0.0), lambda a, v: a + v))
    w = w.withColumn("first", F.col("signal")[0]).withColumn("last", F.col("signal")[7])
    return w.select("rec", "start", "label", r("first"), r("last"), r("total"))


def zero_cross_rate(spark, sf):
    return S.crossings(signals(spark, sf), F.round(F.col("x") - 50.0, 2))


def delta_features(spark, sf):
    return S.relative_to_rest(signals(spark, sf), 10).select("rec", "w", r("m"), r("ratio"), r("delta"))


def nearest_label_align(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("rec"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("id"), "event_type"
    )
    marks = e.where("event_type IN ('error', 'purchase', 'signup')").select("rec", "us", label_of(F.col("event_type")).alias("label"))
    return S.align_nearest(e.where("event_type IN ('view', 'click')"), marks).select("rec", "id", "label")


def label_resample_nn(spark, sf):
    out = S.resampled_labels(signals(spark, sf), F.ceil(F.col("n_in") * 2 / 5).cast("int"))
    return out.select("rec", F.col("j").cast("bigint").alias("j"), F.col("i").cast("bigint").alias("i"), "label")


def burst_peaks(spark, sf):
    return S.peaks_by_averages(signals(spark, sf), 16, 4, 2).na.fill(0, ["gap"])


def rest_normalised(spark, sf):
    y = S.normalised_by_rest(signals(spark, sf), 10)
    return y.groupBy("rec").agg(F.round(F.sum("y"), 6).alias("total"), F.round(F.max("y"), 6).alias("high"), F.count(F.lit(1)).alias("n"))


def subject_reindex(spark, sf):
    return S.numbered_by_appearance(table(spark, sf, "events"), "user_id", "event_id").select("user_id", "first", F.col("index").cast("bigint").alias("idx"))


QUERIES = {f.__name__: f for f in (
    trial_islands, rest_active_snr, stimulus_sessions, tumbling_features, sliding_boundary_skip, sliding_waveforms, zero_cross_rate, delta_features,
    nearest_label_align, label_resample_nn, burst_peaks, rest_normalised, subject_reindex,
)}

ISLANDS_SQL = f"""
WITH {SIGNALS_SQL},
act AS (SELECT *, i - row_number() OVER (PARTITION BY rec ORDER BY i) AS g FROM sig WHERE label > 0),
run AS (
    SELECT rec, g, min(i) AS trial_start, max(i) AS trial_end, count(*) AS n, sqrt(avg(x * x)) AS active_rms
    FROM act GROUP BY rec, g HAVING count(*) >= 2),
com AS (
    SELECT rec, g, label AS gesture, row_number() OVER (PARTITION BY rec, g ORDER BY count(*) DESC, label) AS p
    FROM act GROUP BY rec, g, label)"""

ORACLE_SQL = {
    "trial_islands": f"""{ISLANDS_SQL}
        SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY trial_start) - 1 AS trial_id, trial_start, trial_end, gesture, n
        FROM run JOIN com USING (rec, g) WHERE p = 1""",
    "rest_active_snr": f"""{ISLANDS_SQL},
        rest AS (SELECT rec, sqrt(coalesce(avg(CASE WHEN label = 0 THEN x * x END), avg(x * x)) + 1e-12) AS rest_rms FROM sig GROUP BY rec)
        SELECT rec, trial_start, round(active_rms, 6) AS active_rms, round(rest_rms, 6) AS rest_rms,
               round(10.0 * log10(active_rms * active_rms / (rest_rms * rest_rms + 1e-12) + 1e-12), 6) AS snr_db
        FROM run JOIN rest USING (rec)""",
    "stimulus_sessions": f"""WITH {SIGNALS_SQL},
        c AS (SELECT *, CASE WHEN label <> lag(label) OVER (PARTITION BY rec ORDER BY i) THEN 1 ELSE 0 END AS changed FROM sig),
        s AS (SELECT *, sum(changed) OVER (PARTITION BY rec ORDER BY i) AS session FROM c)
        SELECT rec, session::BIGINT AS session, label, min(i) AS first, max(i) AS last, round(sum(x), 6) AS total
        FROM s WHERE label IN (1, 3) GROUP BY rec, session, label""",
    "tumbling_features": f"""WITH {SIGNALS_SQL},
        c AS (SELECT *, i // 16 AS w, lag(x) OVER (PARTITION BY rec, i // 16 ORDER BY i) AS b FROM sig)
        SELECT rec, w, count(*) AS n, round(avg(abs(x)), 6) AS arv,
               CASE WHEN count(*) = 16 THEN round(sqrt(avg(x * x) + 1e-12), 5) ELSE -1 END AS rms,
               CASE WHEN count(*) = 16 THEN sum(CASE WHEN sign(x) <> sign(b) THEN 1 ELSE 0 END)::BIGINT ELSE -1 END AS changes,
               CASE WHEN count(*) = 16 THEN round(CASE WHEN stddev_pop(x) > 1e-12 THEN kurtosis_pop(x) ELSE 0.0 END, 5) ELSE -1 END AS kurtosis
        FROM c GROUP BY rec, w""",
    "sliding_boundary_skip": f"""WITH {SIGNALS_SQL},
        st AS (SELECT rec, unnest(range(0, n, 4)) AS start FROM (SELECT rec, max(i) + 1 AS n FROM sig GROUP BY rec)),
        w AS (
            SELECT st.rec, start, i, x, label, abs(x - lag(x) OVER (PARTITION BY st.rec, start ORDER BY i)) AS d
            FROM st JOIN sig ON sig.rec = st.rec AND i >= start AND i < start + 8),
        f AS (
            SELECT rec, start, count(*) AS n, max(CASE WHEN i = start THEN label END) AS a, max(CASE WHEN i = start + 4 THEN label END) AS label,
                   max(CASE WHEN i = start + 7 THEN label END) AS z, round(avg(abs(x)), 6) AS mav, round(sum(d), 6) AS wl, round(sqrt(avg(x * x)), 6) AS rms
            FROM w GROUP BY rec, start)
        SELECT rec, start, label, mav, wl, rms FROM f WHERE n = 8 AND a = z""",
    "sliding_waveforms": f"""WITH {SIGNALS_SQL},
        w AS (SELECT rec, i - (i // 4 - b) * 4 AS j, (i // 4 - b) * 4 AS start, x, label FROM sig, range(0, 2) o(b) WHERE i // 4 >= b),
        f AS (
            SELECT rec, start, count(*) AS n, max(label) FILTER (WHERE j = 0) AS a, max(label) FILTER (WHERE j = 4) AS label, max(label) FILTER (WHERE j = 7) AS z,
                   max(x) FILTER (WHERE j = 0) AS first, max(x) FILTER (WHERE j = 7) AS last, sum(x) AS total
            FROM w GROUP BY rec, start)
        SELECT rec, start, label, round(first, 6) AS first, round(last, 6) AS last, round(total, 6) AS total FROM f WHERE n = 8 AND a = z""",
    "zero_cross_rate": f"""WITH {SIGNALS_SQL},
        v AS (SELECT rec, i, round(x - 50.0, 2) AS v FROM sig),
        p AS (SELECT *, lag(v) OVER (PARTITION BY rec ORDER BY i) AS b FROM v)
        SELECT rec, count(*) FILTER (WHERE sign(v) <> sign(b)) AS by_sign, count(*) FILTER (WHERE v * b < 0) AS by_product FROM p GROUP BY rec""",
    "delta_features": f"""WITH {SIGNALS_SQL},
        m AS (SELECT rec, i // 10 AS w, avg(x) AS m, max(label) AS label FROM sig GROUP BY rec, i // 10),
        e AS (SELECT *, w < greatest(count(*) OVER (PARTITION BY rec) // 5, 1) AS early FROM m),
        b AS (
            SELECT *, m / coalesce(avg(CASE WHEN label = 0 THEN m END) OVER (PARTITION BY rec), avg(CASE WHEN early THEN m END) OVER (PARTITION BY rec)) AS ratio
            FROM e)
        SELECT rec, w, round(m, 6) AS m, round(ratio, 6) AS ratio,
               round(ratio - coalesce(lag(ratio) OVER (PARTITION BY rec ORDER BY w), ratio), 6) AS delta FROM b""",
    "nearest_label_align": f"""WITH {SIGNALS_SQL},
        e AS (SELECT user_id AS rec, epoch_us(ts) AS us, event_id AS id, event_type FROM events),
        k AS (
            SELECT user_id AS rec, epoch_us(ts) AS us,
                   max(CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 0 END) AS label
            FROM events WHERE event_type IN ('error', 'purchase', 'signup') GROUP BY user_id, epoch_us(ts)),
        j AS (
            SELECT e.rec, e.id, k.label, row_number() OVER (PARTITION BY e.rec, e.id ORDER BY abs(e.us - k.us), k.us DESC) AS p
            FROM e LEFT JOIN k ON e.rec = k.rec WHERE event_type IN ('view', 'click'))
        SELECT rec, id, label FROM j WHERE p = 1""",
    "label_resample_nn": f"""WITH {SIGNALS_SQL},
        n AS (SELECT rec, max(i) + 1 AS n_in, ceil((max(i) + 1) * 2 / 5)::BIGINT AS n_out FROM sig GROUP BY rec),
        p AS (SELECT *, unnest(range(0, n_out)) AS j FROM n),
        q AS (SELECT rec, j, least(round_even(j * n_in / n_out, 0)::BIGINT, n_in - 1) AS i FROM p)
        SELECT rec, j, i, label FROM q JOIN sig USING (rec, i)""",
    "burst_peaks": f"""WITH {SIGNALS_SQL},
        a AS (
            SELECT *, max(i) OVER (PARTITION BY rec) AS n,
                   sum(abs(x)) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN 8 PRECEDING AND 7 FOLLOWING) / 16
                   < sum(abs(x)) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4 AS up FROM sig),
        g AS (SELECT *, i - row_number() OVER (PARTITION BY rec ORDER BY i) AS g FROM a WHERE up),
        f AS (
            SELECT rec, g, count(*) AS n, max(i) AS last, max(a.n) AS len, arg_max(i, x) AS peak FROM g a GROUP BY rec, g
            HAVING count(*) >= 2 AND max(i) < max(a.n))
        SELECT rec, peak, n, coalesce(peak - lag(peak) OVER (PARTITION BY rec ORDER BY peak), 0) AS gap FROM f""",
    "rest_normalised": f"""WITH {SIGNALS_SQL},
        b AS (
            SELECT rec, CASE WHEN count(*) FILTER (WHERE label = 0) >= 10 THEN avg(x * x) FILTER (WHERE label = 0) ELSE avg(x * x) END + 1e-12 AS p
            FROM sig GROUP BY rec)
        SELECT rec, round(sum(x / sqrt(p)), 6) AS total, round(max(x / sqrt(p)), 6) AS high, count(*) AS n FROM sig JOIN b USING (rec) GROUP BY rec""",
    "subject_reindex": """WITH f AS (SELECT user_id, min(event_id) AS first FROM events GROUP BY user_id)
        SELECT user_id, first, row_number() OVER (ORDER BY first, user_id) - 1 AS idx FROM f""",
}
