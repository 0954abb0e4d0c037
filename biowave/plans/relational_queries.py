"""Queries over the driver's relational tables, read as subjects, trials, quality metrics and predictions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from biowave.functions import arrays as A
from biowave.operators import grading, identity, lookups, margins, mixing, scoring, splitting
from biowave.sources.adapters import table


def r(c, name: str, digits: int = 6):
    return F.round(c, digits).alias(name)


def quality_rows(spark, sf):
    """Quality metrics of parts, of which some are missing or not numbers."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    return p.select(
        k.alias("id"), (F.col("p_size") / 2.0).alias("snr_db"),
        F.when(k % 29 == 0, F.lit("bad")).otherwise((k % 37).cast("string")).alias("smr_db"), (k % 23).alias("shr_db"),
        F.when(k % 31 == 0, F.lit(float("nan"))).otherwise((k % 17) / 10.0).alias("ohm"), F.when(k % 13 != 0, (k % 11) / 100.0).alias("hamp_er"),
    )


def grade_and_reason(spark, sf):
    return grading.grade(quality_rows(spark, sf)).select("id", "pass_base", "qc_grade", "pass_hampel", "pass_final", "reason_flags")


def grade_funnel(spark, sf):
    return grading.funnel(grading.grade(quality_rows(spark, sf)))


def subjects(spark, sf):
    """A customer is a subject of the dataset its nation is; its orders give its segments."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(F.floor(F.col("o_totalprice") / 1000)).cast("bigint").alias("segments"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("db"), F.col("c_nationkey").cast("string")).alias("dataset"))
    return c.join(o, "o_custkey").select("dataset", F.concat_ws("_", "dataset", F.col("o_custkey").cast("string")).alias("subject"), "segments")


def subject_split(spark, sf):
    return splitting.subject_split(subjects(spark, sf).where("segments > 0"), "db3").select("dataset", "subject", "segments", "split")


def split_lookup(spark, sf):
    s = subjects(spark, sf)
    splits = splitting.subject_split(s.where("segments > 0 AND dataset <> 'db3'"), "none")
    return lookups.with_split(s, splits, "db3").groupBy("split").agg(F.count(F.lit(1)).alias("subjects"), F.sum("segments").alias("segments"))


def kfold(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return splitting.stratified_folds(labels, "doc_id", "quality", 3).groupBy("quality", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


def keyed_sample(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return splitting.keyed_sample(c, ["c_mktsegment"], "c_custkey", 7)


def wgn_allocation(spark, sf):
    """Component powers of every segment over the whole grid, with and without white noise: means by the grid's places."""
    power = A.power(F.col("embedding").cast("array<double>")) / F.size("embedding")
    g = mixing.grid(table(spark, sf, "embeddings").select(power.alias("clean_power")))
    both = F.array(F.lit(True), F.lit(False))
    g = g.select("*", F.explode(both).alias("has_wgn")).select("*", F.explode(both).alias("is_wgn"))
    g = g.where("has_wgn OR NOT is_wgn").where("k > 1 OR is_wgn = has_wgn")
    target = mixing.component_power(F.col("clean_power"), F.col("snr"), F.col("k"), F.col("has_wgn"), F.col("is_wgn"))
    capped, low = mixing.is_capped(F.col("snr"), F.col("k"), F.col("has_wgn")), F.col("snr") < mixing.WGN_FLOOR_DB
    g = g.withColumn("target", target).groupBy("snr", "k", "has_wgn", "is_wgn").agg(F.round(F.avg("target"), 6).alias("target"), F.count(F.lit(1)).alias("n"))
    return g.select("*", capped.alias("capped"), ((F.col("k") == 1) & F.col("has_wgn") & low).alias("excluded"))


def snr_grid_cross(spark, sf):
    s = table(spark, sf, "embeddings").select(F.col("vec_id").alias("seg"), F.col("label").alias("dataset"))
    g = mixing.grid(s)
    types = mixing.chosen(mixing.allowed_types(F.col("k"), F.col("snr")), F.col("k"), F.col("seg"), F.col("snr"), F.col("k"))
    return g.withColumn("types", F.array_join(types, "+")).groupBy("snr", "k").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("types").contains("WGN")).alias("with_wgn"), F.min("types").alias("first_types")
    )


def noise_rows(spark, sf):
    e = table(spark, sf, "events")
    kinds = F.array(*map(F.lit, ("PLI", "WGN", "Color", "ECG+Color", "MOA+WGN", "PLI+Color+MOA", " ")))
    paths = F.array(*map(F.lit, ("/n/pli_1.npy", "/n/wgn_2.npy", "/n/color_pink_3.npy", "/n/ecg_1.npy|/n/color_brown_2.npy", "/n/moa_nstdb_4.npy|/n/wgn_1.npy", "/n/color_pink_1.npy|/n/color_brown_1.npy|/n/moa_machado_2.npy", "")))
    pick = (F.col("event_id") % 7).cast("int") + 1
    return e.select("event_id", F.element_at(kinds, pick).alias("noise_types"), F.element_at(paths, pick).alias("noise_paths"), ((F.col("event_id") % 4) * 5 - 10).alias("snr"), F.col("value"))


def noise_label_fanout(spark, sf):
    n = noise_rows(spark, sf).select("value", F.explode(mixing.labels_of(F.col("noise_types"), F.col("noise_paths"))).alias("label"))
    order = F.array(*map(F.lit, ("PLI", "ECG", "MOA", "WGN", "Color", "Pink", "Brown", "k=1", "k=2", "k=3", "k=4", "k=5")))
    return n.groupBy("label").agg(*margins.summary()).select("label", F.array_position(order, F.col("label")).cast("int").alias("place"), r(F.col("mean"), "mean"), r(F.col("std"), "std"), "n")


def snr_by_type_table(spark, sf):
    """Means by SNR and single label; the margin over types counts a row once, whatever its labels."""
    n = noise_rows(spark, sf).where("trim(noise_types) <> ''")
    fanned = n.select("snr", "value", F.explode(mixing.labels_of(F.col("noise_types"), F.col("noise_paths"))).alias("label"))
    names = ["PLI", "ECG", "MOA", "WGN", "Color", "Pink", "Brown"]
    wide = margins.cube_summary(fanned, ["snr", "label"]).groupBy("snr").pivot("label", names).agg(F.first("mean"))
    pooled = n.select(F.col("snr").cast("string").alias("snr"), "value").rollup("snr").agg(F.avg("value").alias("avg")).select(F.coalesce("snr", F.lit("Avg")).alias("snr"), "avg")
    return wide.join(pooled, "snr").select("snr", *[r(F.col(c), c.lower(), 5) for c in names], r(F.col("avg"), "avg", 5))


def noise_tags(spark, sf):
    t, p = F.col("noise_types"), F.col("noise_paths")
    return noise_rows(spark, sf).select(
        "event_id", *[identity.has_tag(t, g).alias(f"has_{n}") for n, g in (("pli", "P"), ("ecg", "E"), ("wgn", "WG"), ("moa", "m"))],
        identity.is_coloured(t).alias("coloured"), identity.is_motion(t).alias("motion"), identity.motion_cutoff(t, p).alias("cutoff"),
    )


def predictions(spark, sf):
    """Quality as the truth and a rule on the text's length as the prediction, by source."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    pred = F.when(F.col("n_chars") < 700, 2).when(F.col("n_chars") < 3000, 1).otherwise(0)
    return d.select(F.col("source").alias("subject"), (F.col("quality") + F.col("toxic")).alias("label"), pred.alias("pred"), "doc_id")


def classes(spark):
    return spark.range(4).select(F.col("id").cast("int").alias("class"))


def confusion(spark, sf):
    return scoring.confusion(predictions(spark, sf), [0, 1, 2])


def per_class_scores(spark, sf):
    s = scoring.per_class(predictions(spark, sf), classes(spark))
    return s.select("class", "tp", "fp", "fn", "tn", *[r(F.col(c), c) for c in ("precision", "recall", "f1", "specificity", "balanced_accuracy", "accuracy")])


def macro_scores(spark, sf):
    s = scoring.macro(predictions(spark, sf), classes(spark))
    return s.select(*[r(F.col(c), c) for c in s.columns])


def subject_accuracy(spark, sf):
    return scoring.by_subject(predictions(spark, sf)).select("subject", "total", "correct", r(F.col("accuracy"), "accuracy"))


def inter_subject(spark, sf):
    return scoring.inter_subject(predictions(spark, sf)).select(r(F.col("mean_accuracy"), "mean_accuracy"), r(F.col("inter_subject_score"), "inter_subject_score"), "subjects")


def topk_accuracy(spark, sf):
    """Each segment's score of a class is the sum of every tenth sample from the class's number on."""
    e = table(spark, sf, "embeddings")
    s = e.select(F.col("vec_id").alias("id"), "label", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("class"), "embedding")
    s = s.withColumn("score", F.round(F.aggregate(F.filter("embedding", lambda v, i: i % 10 == F.col("class")), F.lit(0.0), lambda a, v: a + v), 6))
    out = scoring.top_k(s, 1).union(scoring.top_k(s, 3)).union(scoring.top_k(s, 5))
    return out.select("k", r(F.col("accuracy"), "accuracy"), "n")


def fold_summary(spark, sf):
    labels = splitting.stratified_folds(predictions(spark, sf), "doc_id", "label", 3)
    per = labels.groupBy("fold").agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"))
    return per.agg(r(F.avg("accuracy"), "mean"), r(F.stddev_pop("accuracy"), "std"), F.count(F.lit(1)).alias("folds"))


def class_weights(spark, sf):
    return scoring.class_weights(predictions(spark, sf), 3).select("label", "n", r(F.col("weight"), "weight"))


def delta_vs_baseline(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("method")).agg(F.avg("o_totalprice").alias("accuracy"), F.count(F.lit(1)).cast("double").alias("n"))
    return lookups.deltas(o, "method", "1-URGENT", ["accuracy", "n"]).select("method", r(F.col("accuracy"), "accuracy", 4), "n", r(F.col("d_accuracy"), "d_accuracy", 4), "d_n")


def best_method(spark, sf):
    """The parameter with the best mean of each priority; the first in their order of equals."""
    o = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.round(F.avg("o_totalprice"), 2).alias("score"))
    order = Window.partitionBy("o_orderpriority").orderBy(F.desc("score"), "o_orderstatus")
    return o.withColumn("p", F.row_number().over(order)).where("p = 1").drop("p")


def sweep_argmax(spark, sf):
    """Every segment at every candidate gain; the candidate with the best mean wins."""
    e = table(spark, sf, "embeddings").select(F.transform("embedding", lambda v: v.cast("double")).alias("s"))
    gains = F.explode(F.array(*[F.lit(g) for g in (0.25, 0.5, 0.75, 1.0, 1.25)])).alias("gain")
    g = e.select("s", gains).select("gain", F.aggregate("s", F.lit(0.0), lambda a, v: a + F.abs(F.abs(v) - F.col("gain"))).alias("cost"))
    means = g.groupBy("gain").agg(F.avg("cost").alias("mean_cost"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(F.lit(0)).orderBy("mean_cost", "gain")  # one row a candidate
    return means.withColumn("best", F.row_number().over(order) == 1).select("gain", r(F.col("mean_cost"), "mean_cost", 5), "n", "best")


def exclude_pairs(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", "l_quantity")
    kept = lookups.without_pairs(li, [(1, 1), (1, 2), (2, 3), (3, 1), (5, 4), (7, 2)], "l_suppkey", "l_linenumber")
    return kept.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


def grid_coverage(spark, sf):
    li = table(spark, sf, "lineitem")
    wanted = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("l_linenumber"))
    return lookups.coverage(wanted, li.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], "o_orderstatus")


def passing_lookup(spark, sf):
    """Orders with a line that passes, and how many lines of those pass: a semi join and a set of line numbers."""
    li = table(spark, sf, "lineitem").where("l_discount < 0.02 AND l_quantity > 40")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    some = o.join(li, "l_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))
    sets = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("lines")).join(o, "l_orderkey")
    return some.join(sets.groupBy("o_orderpriority").agg(F.sum(F.size("lines")).alias("lines")), "o_orderpriority")


def first_file(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return lookups.first_of(o, "o_custkey", ["o_orderkey"])


def noise_choice(spark, sf):
    """Each order with an item of its supplier group by a hash of its key: a choice that doesn't depend on row order."""
    s = table(spark, sf, "supplier")
    per = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    items = s.select(F.col("s_nationkey").alias("grp"), (F.row_number().over(per) - 1).cast("bigint").alias("idx"), "s_suppkey", F.count(F.lit(1)).over(Window.partitionBy("s_nationkey")).alias("size"))
    sizes = items.select("grp", "size").distinct()
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 25).cast("int").alias("grp")).join(sizes, "grp")
    chosen = lookups.nearest_choice(o, items.drop("size"), "grp", splitting.key_number(F.col("o_orderkey"), salt="noise") % F.col("size"))
    return chosen.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


def id_parse(spark, sf):
    p = table(spark, sf, "pages")
    n = F.col("page_id")
    path = F.when(n % 3 == 0, F.concat(F.lit("/d/db2/S"), n.cast("string"), F.lit("_E"), (n % 4).cast("string"), F.lit("_A1.mat"))).when(
        n % 3 == 1, F.concat(F.lit("/d/s"), n.cast("string"), F.lit(".mat"))).otherwise(F.concat(F.lit("/d/rec-"), n.cast("string"), F.lit(" x.mat")))
    p = p.select("page_id", path.alias("path"))
    s = identity.subject_of(F.col("path"))
    return p.select(
        "page_id", identity.base_name(F.col("path")).alias("base"), identity.stem(F.col("path")).alias("stem"), s.alias("subject"), identity.exercise_of(F.col("path")).alias("exercise"),
        identity.cross_subject_id(F.lit("db2"), s, F.col("path")).alias("cross_id"), identity.safe_token(F.col("path")).alias("token"),
    )


def segment_ids(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    sid = identity.segment_id(F.lit("db2"), (F.col("vec_id") % 40).cast("string"), F.col("label"), F.col("vec_id") % 7, F.col("vec_id"))
    p = e.select("vec_id", sid.alias("segment_id")).withColumn("p", identity.segment_parts(F.col("segment_id")))
    return p.select("vec_id", "segment_id", F.col("p.subject").alias("subject"), F.col("p.channel").alias("channel"), F.col("p.trial").alias("trial"), F.col("p.segment").alias("segment"))


def class_offsets(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_linenumber") % 3 + 1).alias("exercise"), (F.col("l_partkey") % 12 + 1).cast("int").alias("movement"))
    return li.groupBy("exercise", identity.class_of(F.col("exercise"), F.col("movement")).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n"))


def label_sets(spark, sf):
    """Concatenation, difference and intersection of id sets, and array sets by recording."""
    e = table(spark, sf, "events")
    a, b = (e.where(F.col("event_type") == t).select("user_id").distinct() for t in ("purchase", "error"))
    out = [(n, d.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("user_id"), F.lit(0)).alias("ids")).select(F.lit(n).alias("op"), "n", "ids")) for n, d in (
        ("union", a.unionByName(b).distinct()), ("concat", a.unionByName(b)), ("except", a.exceptAll(b)), ("intersect", a.intersect(b)))]
    first = out[0][1]
    for _, d in out[1:]:
        first = first.unionByName(d)
    return first


def array_sets(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("have"))
    want = F.array(*map(F.lit, ("click", "signup", "error")))
    return e.select("user_id", F.array_join(F.array_intersect(want, "have"), "+").alias("both"), F.array_join(F.array_except(want, "have"), "+").alias("lacking"))


def mixing_counts(spark, sf):
    n = noise_rows(spark, sf).withColumn("k", F.size(F.filter(F.split(F.trim("noise_types"), r"\+"), lambda t: t != "")))
    return n.groupBy("snr", "k").agg(F.count(F.lit(1)).alias("n"), r(F.min("value"), "low"), r(F.max("value"), "high"), r(F.avg("value"), "mean"), r(F.stddev_pop("value"), "std"))


def rms_ratios(spark, sf):
    """Ratios of two levels, their spread and the outliers beyond 5 or below 0.2."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("a"), F.min("l_quantity").alias("b"))
    ratio = li.withColumn("ratio", F.col("a") / F.greatest("b", F.lit(1e-12)))
    return ratio.agg(
        r(F.avg("ratio"), "mean"), r(F.expr("percentile(ratio, 0.5)"), "median"), r(F.stddev_pop("ratio"), "std"), r(F.min("ratio"), "low"), r(F.max("ratio"), "high"),
        F.count_if((F.col("ratio") > 5) | (F.col("ratio") < 0.2)).alias("outliers"), F.count(F.lit(1)).alias("n"),
    )


def running_means(spark, sf):
    """A meter's weighted average after each batch."""
    o = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.avg("o_totalprice").alias("v"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(F.lit(0)).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)  # one row a month
    return o.select("month", "n", r(F.sum(F.col("v") * F.col("n")).over(order) / F.sum("n").over(order), "average", 4))


def segment_estimates(spark, sf):
    """Whole segments of trials of given lengths and rates, resampled lengths, and places on a resampled time axis."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice")).cast("bigint").alias("n"))
    return o.select(
        "id", F.floor(F.col("n") / 2000.0 / 2.0).cast("bigint").alias("segments"), F.ceil(F.col("n") * 1000 / F.lit(1259)).cast("bigint").alias("resampled"),
        r(F.col("n") / F.lit(1259.0) / F.greatest(F.bround(F.col("n") * 1000 / F.lit(1259)) - 1, F.lit(1)) * 10, "tenth"),
    )


def latest_item(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy("o_orderpriority").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"), F.countDistinct("o_custkey").alias("customers"))


QUERIES = {f.__name__: f for f in (
    grade_and_reason, grade_funnel, subject_split, split_lookup, kfold, keyed_sample, wgn_allocation, snr_grid_cross, noise_label_fanout, snr_by_type_table,
    noise_tags, confusion, per_class_scores, macro_scores, subject_accuracy, inter_subject, topk_accuracy, fold_summary, class_weights, delta_vs_baseline,
    best_method, sweep_argmax, exclude_pairs, grid_coverage, passing_lookup, first_file, noise_choice, id_parse, segment_ids, class_offsets, label_sets,
    array_sets, mixing_counts, rms_ratios, running_means, segment_estimates, latest_item,
)}

GRADE_SQL = """
q AS (
    SELECT p_partkey AS id, p_size / 2.0 AS snr, CASE WHEN p_partkey % 29 <> 0 THEN (p_partkey % 37)::DOUBLE END AS smr, p_partkey % 23 AS shr,
           CASE WHEN p_partkey % 31 <> 0 THEN (p_partkey % 17) / 10.0 END AS ohm, CASE WHEN p_partkey % 13 <> 0 THEN (p_partkey % 11) / 100.0 END AS er
    FROM part),
b AS (SELECT *, smr IS NOT NULL AND ohm IS NOT NULL AS valid, coalesce(smr > 12 AND shr > 8 AND ohm < 1.4, false) AS base FROM q),
g AS (
    SELECT *, CASE WHEN NOT base THEN 'rejected' WHEN snr >= 18 THEN 'A_excellent' WHEN snr >= 10 THEN 'B_good' WHEN snr >= 1.8 THEN 'C_unacceptable'
                   ELSE 'rejected' END AS grade FROM b),
h AS (
    SELECT *, CASE grade WHEN 'A_excellent' THEN coalesce(er <= 0.08, false) WHEN 'B_good' THEN coalesce(er <= 0.05, false) ELSE true END AS gate FROM g),
f AS (
    SELECT id, base AS pass_base, grade AS qc_grade, gate AS pass_hampel, base AND grade IN ('A_excellent', 'B_good') AND gate AS pass_final,
           CASE WHEN NOT valid THEN 'nan_metric' WHEN NOT base THEN 'fail_spectral' WHEN grade = 'rejected' THEN 'fail_snr'
                WHEN grade IN ('A_excellent', 'B_good') AND NOT gate THEN 'fail_hampel' ELSE 'OK' END AS reason_flags FROM h)"""

SUBJECTS_SQL = """
s AS (
    SELECT 'db' || c_nationkey AS dataset, 'db' || c_nationkey || '_' || c_custkey AS subject, sum(floor(o_totalprice / 1000))::BIGINT AS segments
    FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey, c_custkey)"""


def split_sql(test: str, source: str) -> str:
    return f"""
k AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY segments, subject) - 1 AS rk, count(*) OVER (PARTITION BY dataset) AS n FROM {source}),
v AS (SELECT *, least(greatest(round_even((1.0::DOUBLE - 0.8::DOUBLE) * n, 0)::INT, 2), n - 1) AS v FROM k),
p AS (
    SELECT *, CASE WHEN dataset = '{test}' THEN 'test'
                   WHEN n > 1 AND list_contains(list_transform(range(0, greatest(v, 1)), lambda x: floor(x * ((n - 1)::DOUBLE / greatest(v - 1, 1)))::BIGINT), rk)
                   THEN 'valid' ELSE 'train' END AS split FROM v)"""


def md5_number(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 8))::BIGINT"


NOISE_SQL = """
n AS (
    SELECT event_id, value, (event_id % 4) * 5 - 10 AS snr,
           (['PLI', 'WGN', 'Color', 'ECG+Color', 'MOA+WGN', 'PLI+Color+MOA', ' '])[event_id % 7 + 1] AS noise_types,
           (['/n/pli_1.npy', '/n/wgn_2.npy', '/n/color_pink_3.npy', '/n/ecg_1.npy|/n/color_brown_2.npy', '/n/moa_nstdb_4.npy|/n/wgn_1.npy',
             '/n/color_pink_1.npy|/n/color_brown_1.npy|/n/moa_machado_2.npy', ''])[event_id % 7 + 1] AS noise_paths,
           ([['PLI', 'k=1'], ['WGN', 'k=1'], ['Color', 'Pink', 'k=1'], ['ECG', 'Color', 'Brown', 'k=2'], ['MOA', 'WGN', 'k=2'], ['PLI', 'Color', 'MOA', 'k=3'], []])[event_id % 7 + 1] AS labels
    FROM events)"""

PRED_SQL = """
p AS (
    SELECT source AS subject, doc_id, quality + toxic AS label, CASE WHEN n_chars < 700 THEN 2 WHEN n_chars < 3000 THEN 1 ELSE 0 END AS pred
    FROM documents JOIN labels USING (doc_id))"""

CLASS_SQL = """
c AS (
    SELECT x::INT AS class, count(*) FILTER (WHERE label = x AND pred = x) AS tp, count(*) FILTER (WHERE label <> x AND pred = x) AS fp,
           count(*) FILTER (WHERE label = x AND pred <> x) AS fn, count(*) FILTER (WHERE label <> x AND pred <> x) AS tn
    FROM range(0, 4) r(x), p GROUP BY x),
d AS (SELECT *, tp / (tp + fp + 1e-8) AS precision, tp / (tp + fn + 1e-8) AS recall, tn / (tn + fp + 1e-8) AS specificity FROM c),
e AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-8) AS f1, (recall + specificity) / 2 AS balanced_accuracy FROM d)"""

ORACLE_SQL = {
    "grade_and_reason": f"WITH {GRADE_SQL} SELECT * FROM f",
    "grade_funnel": f"""WITH {GRADE_SQL}
        SELECT count(*) AS n_total, count(*) FILTER (WHERE reason_flags = 'nan_metric') AS n_nan, count(*) FILTER (WHERE reason_flags = 'fail_spectral') AS n_fail_spectral,
               count(*) FILTER (WHERE reason_flags = 'fail_snr') AS n_fail_snr, count(*) FILTER (WHERE reason_flags = 'fail_hampel') AS n_fail_hampel,
               count(*) FILTER (WHERE pass_final) AS n_pass FROM f""",
    "subject_split": f"WITH {SUBJECTS_SQL}, s2 AS (SELECT * FROM s WHERE segments > 0), {split_sql('db3', 's2')} SELECT dataset, subject, segments, split FROM p",
    "split_lookup": f"""WITH {SUBJECTS_SQL}, s2 AS (SELECT * FROM s WHERE segments > 0 AND dataset <> 'db3'), {split_sql('none', 's2')},
        j AS (SELECT s.*, coalesce(p.split, CASE WHEN s.dataset = 'db3' THEN 'test' END) AS split FROM s LEFT JOIN p USING (subject))
        SELECT split, count(*) AS subjects, sum(segments)::BIGINT AS segments FROM j WHERE split IS NOT NULL GROUP BY split""",
    "kfold": f"""WITH f AS (
            SELECT quality, doc_id, ((row_number() OVER (PARTITION BY quality ORDER BY {md5_number("doc_id || '|fold'")}, doc_id) - 1) % 3)::INT AS fold FROM labels)
        SELECT quality, fold, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM f GROUP BY quality, fold""",
    "keyed_sample": f"""WITH f AS (
            SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {md5_number("c_custkey || '|sample'")}, c_custkey) AS p FROM customer)
        SELECT c_custkey, c_mktsegment FROM f WHERE p <= 7""",
    "wgn_allocation": """WITH p AS (SELECT list_sum([x::DOUBLE * x::DOUBLE for x in embedding]) / len(embedding) AS p FROM embeddings),
        g AS (
            SELECT s::INT AS snr, k::INT AS k, h AS has_wgn, w AS is_wgn, p / pow(10.0, s / 10.0) AS t, p / pow(10.0, -0.5) AS fl
            FROM p, range(-15, 16, 5) a(s), range(1, 6) b(k), (VALUES (true), (false)) c(h), (VALUES (true), (false)) d(w)
            WHERE (h OR NOT w) AND (k > 1 OR w = h))
        SELECT snr, k, has_wgn, is_wgn,
               round(avg(CASE WHEN has_wgn AND k > 1 AND t / k > fl THEN CASE WHEN is_wgn THEN fl ELSE greatest(t - fl, 0) / (k - 1) END ELSE t / k END), 6) AS target,
               count(*) AS n, has_wgn AND k >= 2 AND snr + 10 * log10(k) < -5 AS capped, k = 1 AND has_wgn AND snr < -5 AS excluded FROM g GROUP BY ALL""",
    "snr_grid_cross": f"""WITH g AS (
            SELECT vec_id AS seg, s::INT AS snr, k::INT AS k FROM embeddings, range(-15, 16, 5) a(s), range(1, 6) b(k)),
        t AS (
            SELECT g.*, ty, o, row_number() OVER (PARTITION BY seg, snr, k ORDER BY {md5_number("seg || '|' || snr || '|' || k || '|' || ty || '|type'")}, ty) AS p
            FROM g, (VALUES ('PLI', 1), ('WGN', 2), ('ECG', 3), ('MOA', 4), ('Color', 5)) v(ty, o) WHERE NOT (k = 1 AND snr < -5 AND ty = 'WGN')),
        c AS (SELECT seg, snr, k, string_agg(ty, '+' ORDER BY o) AS types FROM t WHERE p <= k GROUP BY seg, snr, k)
        SELECT snr, k, count(*) AS n, count(*) FILTER (WHERE types LIKE '%WGN%') AS with_wgn, min(types) AS first_types FROM c GROUP BY snr, k""",
    "noise_label_fanout": f"""WITH {NOISE_SQL}, l AS (SELECT value, unnest(labels) AS label FROM n)
        SELECT label, list_position(['PLI', 'ECG', 'MOA', 'WGN', 'Color', 'Pink', 'Brown', 'k=1', 'k=2', 'k=3', 'k=4', 'k=5'], label)::INT AS place,
               round(avg(value), 6) AS mean, round(CASE WHEN count(*) = 1 THEN 0.0 ELSE stddev_samp(value) END, 6) AS std, count(*) AS n FROM l GROUP BY label""",
    "snr_by_type_table": f"""WITH {NOISE_SQL},
        l AS (SELECT snr, value, unnest(labels) AS label FROM n),
        w AS (
            SELECT coalesce(snr::VARCHAR, 'Avg') AS snr, {", ".join(f"round(avg(value) FILTER (WHERE label = '{c}'), 5) AS {c.lower()}" for c in ("PLI", "ECG", "MOA", "WGN", "Color", "Pink", "Brown"))}
            FROM l GROUP BY GROUPING SETS ((snr), ())),
        a AS (SELECT coalesce(snr::VARCHAR, 'Avg') AS snr, round(avg(value), 5) AS avg FROM n WHERE trim(noise_types) <> '' GROUP BY GROUPING SETS ((snr), ()))
        SELECT w.*, a.avg FROM w JOIN a USING (snr)""",
    "noise_tags": f"""WITH {NOISE_SQL}
        SELECT event_id, noise_types LIKE '%PLI%' AS has_pli, noise_types LIKE '%ECG%' AS has_ecg, noise_types LIKE '%WGN%' AS has_wgn, noise_types LIKE '%MOA%' AS has_moa,
               noise_types LIKE '%Color%' AS coloured, noise_types LIKE '%MOA%' AS motion,
               CASE WHEN noise_paths LIKE '%machado%' THEN 40.0 WHEN noise_paths LIKE '%nstdb%' THEN 20.0 ELSE 40.0 END::DOUBLE AS cutoff FROM n""",
    "confusion": f"""WITH {PRED_SQL} SELECT label, count(*) FILTER (WHERE pred = 0) AS pred_0, count(*) FILTER (WHERE pred = 1) AS pred_1, count(*) FILTER (WHERE pred = 2) AS pred_2
        FROM p GROUP BY label""",
    "per_class_scores": f"""WITH {PRED_SQL}, {CLASS_SQL}
        SELECT class, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(specificity, 6) AS specificity,
               round(balanced_accuracy, 6) AS balanced_accuracy, round(tp / greatest(tp + fn, 1), 6) AS accuracy FROM e""",
    "macro_scores": f"""WITH {PRED_SQL}, {CLASS_SQL}
        SELECT round(avg(precision) * 100, 6) AS precision, round(avg(recall) * 100, 6) AS recall, round(avg(f1) * 100, 6) AS f1,
               round(avg(specificity) * 100, 6) AS specificity, round(avg(balanced_accuracy) * 100, 6) AS balanced_accuracy FROM e""",
    "subject_accuracy": f"""WITH {PRED_SQL} SELECT subject, count(*) AS total, count(*) FILTER (WHERE label = pred) AS correct,
        round(avg((label = pred)::INT), 6) AS accuracy FROM p GROUP BY subject""",
    "inter_subject": f"""WITH {PRED_SQL}, a AS (SELECT subject, avg((label = pred)::INT) AS a FROM p GROUP BY subject)
        SELECT round(avg(a), 6) AS mean_accuracy, round(stddev_pop(a), 6) AS inter_subject_score, count(*) AS subjects FROM a""",
    "topk_accuracy": """WITH s AS (
            SELECT vec_id AS id, label, c::INT AS class, round(list_sum(list_transform(embedding[c + 1 : 64 : 10], lambda v: v::DOUBLE)), 6) AS score FROM embeddings, range(0, 10) r(c)),
        b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, class) AS p FROM s),
        h AS (SELECT k, id, max((label = class)::INT) AS hit FROM b, (VALUES (1), (3), (5)) v(k) WHERE p <= k GROUP BY k, id)
        SELECT k, round(avg(hit), 6) AS accuracy, count(*) AS n FROM h GROUP BY k""",
    "fold_summary": f"""WITH {PRED_SQL},
        f AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY {md5_number("doc_id || '|fold'")}, doc_id) - 1) % 3 AS fold FROM p),
        a AS (SELECT fold, avg((label = pred)::INT) AS a FROM f GROUP BY fold)
        SELECT round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std, count(*) AS folds FROM a""",
    "class_weights": f"""WITH {PRED_SQL} SELECT label, count(*) AS n, round(sum(count(*)) OVER () / (3.0 * count(*)), 6) AS weight FROM p GROUP BY label""",
    "delta_vs_baseline": """WITH m AS (SELECT o_orderpriority AS method, avg(o_totalprice) AS a, count(*)::DOUBLE AS n FROM orders GROUP BY o_orderpriority),
        b AS (SELECT a AS ba, n AS bn FROM m WHERE method = '1-URGENT')
        SELECT method, round(a, 4) AS accuracy, n, round(a - ba, 4) AS d_accuracy, n - bn AS d_n FROM m, b""",
    "best_method": """WITH s AS (SELECT o_orderpriority, o_orderstatus, round(avg(o_totalprice), 2) AS score FROM orders GROUP BY ALL),
        p AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY score DESC, o_orderstatus) AS p FROM s)
        SELECT o_orderpriority, o_orderstatus, score FROM p WHERE p = 1""",
    "sweep_argmax": """WITH s AS (SELECT vec_id, gain, sum(abs(abs(v::DOUBLE) - gain)) AS cost FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings),
            (VALUES (0.25::DOUBLE), (0.5), (0.75), (1.0), (1.25)) g(gain) GROUP BY vec_id, gain),
        m AS (SELECT gain, avg(cost) AS c, count(*) AS n FROM s GROUP BY gain)
        SELECT gain, round(c, 5) AS mean_cost, n, row_number() OVER (ORDER BY c, gain) = 1 AS best FROM m""",
    "exclude_pairs": """SELECT l_linenumber, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem
        WHERE (l_suppkey, l_linenumber) NOT IN ((1, 1), (1, 2), (2, 3), (3, 1), (5, 4), (7, 2)) GROUP BY l_linenumber""",
    "grid_coverage": """WITH w AS (SELECT o_orderkey, o_orderstatus, unnest(range(1, 5)) AS ln FROM orders),
        h AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
        SELECT o_orderstatus, count(l_orderkey) AS matched, count(*) - count(l_orderkey) AS missing
        FROM w LEFT JOIN h ON l_orderkey = o_orderkey AND l_linenumber = ln GROUP BY o_orderstatus""",
    "passing_lookup": """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_discount < 0.02 AND l_quantity > 40)
        SELECT o_orderpriority, count(DISTINCT o_orderkey) AS orders, count(*) AS lines FROM orders JOIN l ON l_orderkey = o_orderkey GROUP BY o_orderpriority""",
    "first_file": """SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey""",
    "noise_choice": f"""WITH i AS (
            SELECT s_nationkey AS grp, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS idx, count(*) OVER (PARTITION BY s_nationkey) AS size FROM supplier),
        o AS (SELECT o_orderkey, o_custkey % 25 AS grp, {md5_number("o_orderkey || '|noise'")} AS h FROM orders)
        SELECT s_suppkey, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM o JOIN i ON i.grp = o.grp AND idx = h % size GROUP BY s_suppkey""",
    "id_parse": """WITH p AS (
            SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/d/db2/S' || page_id || '_E' || (page_id % 4) || '_A1.mat' WHEN 1 THEN '/d/s' || page_id || '.mat'
                   ELSE '/d/rec-' || page_id || ' x.mat' END AS path FROM pages)
        SELECT page_id, regexp_extract(path, '[^/]*$') AS base, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS stem,
               CASE WHEN page_id % 3 = 2 THEN -1 ELSE page_id END::INT AS subject, CASE page_id % 3 WHEN 0 THEN page_id % 4 WHEN 1 THEN -1 ELSE -1 END::INT AS exercise,
               CASE WHEN page_id % 3 = 2 THEN 'db2_UNK_' || substr(md5(path), 1, 8) ELSE 'db2_' || page_id END AS cross_id,
               trim(regexp_replace(path, '[^\\p{L}\\p{N}_-]', '_', 'g'), '_') AS token FROM p""",
    "segment_ids": """SELECT vec_id, 'db2_' || (vec_id % 40) || '_ch' || label || '_t' || (vec_id % 7) || '_seg' || vec_id AS segment_id, 'db2_' || (vec_id % 40) AS subject,
        label::INT AS channel, (vec_id % 7)::INT AS trial, vec_id::INT AS segment FROM embeddings""",
    "class_offsets": """WITH l AS (SELECT l_linenumber % 3 + 1 AS exercise, (l_partkey % 12 + 1)::INT AS movement FROM lineitem)
        SELECT exercise, (movement - 1 + CASE exercise WHEN 2 THEN 12 WHEN 3 THEN 29 ELSE 0 END)::INT AS class, count(*) AS n FROM l GROUP BY ALL""",
    "label_sets": """WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'),
        r AS (SELECT 'union' AS op, user_id FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'concat', user_id FROM (SELECT * FROM a UNION ALL SELECT * FROM b)
              UNION ALL SELECT 'except', user_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'intersect', user_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b))
        SELECT o.op, count(user_id) AS n, coalesce(sum(user_id), 0)::BIGINT AS ids FROM (VALUES ('union'), ('concat'), ('except'), ('intersect')) o(op) LEFT JOIN r ON r.op = o.op GROUP BY o.op""",
    "array_sets": """WITH e AS (SELECT user_id, list(DISTINCT event_type) AS have FROM events GROUP BY user_id)
        SELECT user_id, array_to_string(list_filter(['click', 'signup', 'error'], lambda x: list_contains(have, x)), '+') AS both,
               array_to_string(list_filter(['click', 'signup', 'error'], lambda x: NOT list_contains(have, x)), '+') AS lacking FROM e""",
    "mixing_counts": f"""WITH {NOISE_SQL} SELECT snr, CASE WHEN trim(noise_types) = '' THEN 0 ELSE len(string_split(noise_types, '+')) END::INT AS k, count(*) AS n,
        round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM n GROUP BY ALL""",
    "rms_ratios": """WITH l AS (SELECT max(l_quantity) / greatest(min(l_quantity), 1e-12) AS ratio FROM lineitem GROUP BY l_orderkey)
        SELECT round(avg(ratio), 6) AS mean, round(quantile_cont(ratio, 0.5), 6) AS median, round(stddev_pop(ratio), 6) AS std, round(min(ratio), 6) AS low, round(max(ratio), 6) AS high,
               count(*) FILTER (WHERE ratio > 5 OR ratio < 0.2) AS outliers, count(*) AS n FROM l""",
    "running_means": """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, avg(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY 1)
        SELECT month, n, round(sum(v * n) OVER (ORDER BY month) / sum(n) OVER (ORDER BY month), 4) AS average FROM m""",
    "segment_estimates": """WITH o AS (SELECT o_orderkey AS id, floor(o_totalprice)::BIGINT AS n FROM orders)
        SELECT id, floor(n / 2000.0 / 2.0)::BIGINT AS segments, ceil(n * 1000 / 1259)::BIGINT AS resampled,
               round(n / 1259.0::DOUBLE / greatest(round_even(n * 1000 / 1259, 0) - 1, 1) * 10, 6) AS tenth FROM o""",
    "latest_item": """SELECT o_orderpriority, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority""",
}
