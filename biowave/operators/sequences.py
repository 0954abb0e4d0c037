"""Islands, sessions, windows and alignment over long recordings (rec, i, x, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biowave.operators import scans

EPS = 1e-12
RANGES = 256  # by which all keys are numbered


def islands(track: DataFrame, least: int = 2) -> DataFrame:
    """Trials: maximal runs of labels above 0 with at least `least` samples. The gesture is the commonest label, the smallest of equals.

    Runs are followed over the seams of a recording's stretches, and trials numbered by them, so that a long recording is many tasks.
    """
    rows = scans.runs(scans.parted(track.where("label > 0")), "trial_start")
    # labels are counted first: a run of any length is a row for each of its labels
    kinds = rows.groupBy("rec", "trial_start", "label").agg(
        F.max("i").alias("_last"), F.count(F.lit(1)).alias("_n"), F.sum(F.col("x") * F.col("x")).alias("_squares"), F.count("x").alias("_known")
    )
    found = kinds.groupBy("rec", "trial_start").agg(
        F.max("_last").alias("trial_end"), F.max_by("label", F.struct("_n", -F.col("label"))).alias("gesture"), F.sum("_n").alias("n"),
        F.sqrt(F.sum("_squares") / F.sum("_known")).alias("active_rms"),
    )
    trials = scans.parted(scans.written(found.where(F.col("n") >= least)), "trial_start")
    return scans.numbered(trials, ["trial_start"], "trial_id").drop("_part")


def rest_levels(track: DataFrame) -> DataFrame:
    """RMS at rest (label 0) of each recording; of the whole where it never rests."""
    square = F.col("x") * F.col("x")
    rest = F.coalesce(F.avg(F.when(F.col("label") == 0, square)), F.avg(square))
    return track.groupBy("rec").agg(F.sqrt(rest + EPS).alias("rest_rms"))


def trial_snr(track: DataFrame, least: int = 2) -> DataFrame:
    joined = islands(track, least).join(rest_levels(track), "rec")
    ratio = F.col("active_rms") * F.col("active_rms") / (F.col("rest_rms") * F.col("rest_rms") + EPS) + EPS
    return joined.withColumn("snr_db", 10.0 * F.log10(ratio))


def sessions(track: DataFrame, keep: list[int]) -> DataFrame:
    """Runs of one label, cut where it changes; those of the labels in keep."""
    numbered = scans.changes(scans.parted(track), "label", "session")
    cut = numbered.groupBy("rec", "session", "label").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.sum("x").alias("total"))
    return cut.where(F.col("label").isin(keep))


def tumbling(track: DataFrame, size: int) -> DataFrame:
    """Windows of `size` samples: mean magnitude with the short last window, the other features without it."""
    order = Window.partitionBy("rec", "w").orderBy("i")
    cut = track.withColumn("w", F.floor(F.col("i") / size)).withColumn("_before", F.lag("x").over(order))
    change = F.when(F.signum("x") != F.signum("_before"), 1).otherwise(0)
    whole = F.count(F.lit(1)) == size
    features = cut.groupBy("rec", "w").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs("x")).alias("arv"),
        F.when(whole, F.sqrt(F.avg(F.col("x") * F.col("x")) + EPS)).alias("rms"),
        F.when(whole, F.sum(change)).alias("changes"),
        F.when(whole, F.when(F.stddev_pop("x") > EPS, F.kurtosis("x")).otherwise(0.0)).alias("kurtosis"),
    )
    return features


def _in_windows(track: DataFrame, size: int, step: int) -> DataFrame:
    """Each sample once for every window that holds it, with the window's start."""
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / step)).cast("int")
    last = F.floor(F.col("i") / step).cast("int")
    return track.withColumn("_k", F.explode(F.sequence(first, last))).withColumn("start", F.col("_k") * step)


def sliding_waveforms(track: DataFrame, size: int, step: int) -> DataFrame:
    """The windows of `sliding` as arrays of their samples (rec, start, label, signal), for models that take the signal itself."""
    cut = _in_windows(track, size, step).groupBy("rec", "start").agg(F.array_sort(F.collect_list(F.struct("i", "x", "label"))).alias("_w"))
    whole = cut.where((F.size("_w") == size) & (F.col("_w")[0]["label"] == F.col("_w")[size - 1]["label"]))
    return whole.select("rec", "start", F.col("_w")[size // 2]["label"].alias("label"), F.transform("_w", lambda v: v["x"]).alias("signal"))


def sliding(track: DataFrame, size: int, step: int) -> DataFrame:
    """Windows of `size` samples every `step`, whose label is the one at their middle; those whose ends' labels differ are skipped.

    A sample is copied to the windows that hold it, size / step of them, so a long recording is many groups.
    """
    put = _in_windows(track, size, step)
    at = lambda k: F.max(F.when(F.col("i") == F.col("start") + k, F.col("label")))
    order = Window.partitionBy("rec", "start").orderBy("i")
    put = put.withColumn("_d", F.abs(F.col("x") - F.lag("x").over(order)))
    cut = put.groupBy("rec", "start").agg(
        F.count(F.lit(1)).alias("_n"), at(0).alias("_first"), at(size // 2).alias("label"), at(size - 1).alias("_last"),
        F.avg(F.abs("x")).alias("mav"), F.sum("_d").alias("wl"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"),
    )
    return cut.where((F.col("_n") == size) & (F.col("_first") == F.col("_last"))).drop("_n", "_first", "_last")


def crossings(track: DataFrame, value: Column) -> DataFrame:
    """Zero crossings of each recording by both rules: a change of sign, and a negative product of neighbours."""
    rules = {"by_sign": F.signum("_v") != F.signum("_b"), "by_product": F.col("_v") * F.col("_b") < 0}
    return scans.neighbour_counts(scans.parted(track.withColumn("_v", value)), "_v", rules, "_b")


def relative_to_rest(track: DataFrame, size: int) -> DataFrame:
    """Window means over the mean of windows at rest (else of the first fifth), and their differences."""
    means = track.withColumn("w", F.floor(F.col("i") / size)).groupBy("rec", "w").agg(F.avg("x").alias("m"), F.max("label").alias("label"))
    means = scans.parted(scans.written(means), "w")
    place = scans.numbered(means.select("rec", "w", "_part"), ["w"], "_place")
    n = means.groupBy("rec").agg(F.count(F.lit(1)).alias("_n"))
    # what a recording is measured by is one row; joins can split a long one
    early = scans.beside(place, n).where(F.col("_place") < F.greatest(F.floor(F.col("_n") / 5), F.lit(1))).select(F.col("rec").alias("_er"), F.col("w").alias("_ew"), F.lit(True).alias("_early"))
    base = means.join(early, (means["rec"].eqNullSafe(F.col("_er"))) & (means["w"] == F.col("_ew")), "left").groupBy("rec").agg(
        F.coalesce(F.avg(F.when(F.col("label") == 0, F.col("m"))), F.avg(F.when(F.col("_early"), F.col("m")))).alias("_base")
    )
    ratio = scans.written(scans.beside(means, base).withColumn("ratio", F.col("m") / F.col("_base")).drop("_base"))
    return scans.previous(ratio, "ratio", "_b", "w").withColumn("delta", F.col("ratio") - F.coalesce("_b", "ratio")).drop("_b", "_part")


def align_nearest(samples: DataFrame, marks: DataFrame) -> DataFrame:
    """Each sample (rec, us, id) with the label of the nearest mark (rec, us, label); of equally near ones the later.

    Both sides are one sorted stream, cut into stretches of time; two running windows carry the marks before and after to the
    samples, and those of other stretches come to it as copies.
    """
    kinds = "struct<at:bigint,label:int>"
    marked = marks.groupBy("rec", "us").agg(F.max("label").alias("label"))
    both = samples.select("rec", "us", "id", F.lit(None).cast(kinds).alias("mark")).unionByName(
        marked.select("rec", "us", F.lit(None).cast("bigint").alias("id"), F.struct(F.col("us").alias("at"), F.col("label").cast("int").alias("label")).alias("mark"))
    )
    both = scans.with_nearest_marks(scans.parted_by_time(both, "us"), "mark", "us")
    order = Window.partitionBy("rec", "_part").orderBy("us")
    before = F.last("mark", True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("mark", True).over(order.rangeBetween(0, Window.unboundedFollowing))
    near = both.withColumn("_b", before).withColumn("_a", after).where("id IS NOT NULL")
    later = (F.col("_b").isNull()) | (F.col("_a.at") - F.col("us") <= F.col("us") - F.col("_b.at"))
    label = F.when(F.col("_a").isNotNull() & later, F.col("_a.label")).otherwise(F.col("_b.label"))
    return near.select("rec", "id", "us", label.alias("label"))


def resampled_labels(track: DataFrame, n_out: Column) -> DataFrame:
    """Labels at n_out places of each recording: the nearest index, halves to even."""
    lengths = track.groupBy("rec").agg((F.max("i") + 1).alias("n_in")).withColumn("n_out", n_out)
    places = lengths.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)))
    places = places.withColumn("i", F.least(F.bround(F.col("j") * F.col("n_in") / F.col("n_out")).cast("int"), F.col("n_in") - 1))
    return places.join(track.select("rec", "i", "label"), ["rec", "i"]).select("rec", "j", "i", "label")


def peaks_by_averages(track: DataFrame, slow: int, fast: int, least: int) -> DataFrame:
    """The largest sample of each run where a fast average of magnitudes tops a slow one for `least` samples and ends."""
    near = scans.with_margins(scans.parted(track.select("rec", "i", "x")), slow // 2 + fast // 2)
    order = Window.partitionBy("rec", "_part").orderBy("i")
    centred = lambda n: F.sum(F.abs("x")).over(order.rowsBetween(-(n // 2), n - n // 2 - 1)) / n
    above = near.withColumn("_up", centred(slow) < centred(fast)).where("_own AND _up").drop("_own", "_up")
    found = scans.runs(above, "_run").groupBy("rec", "_run").agg(
        F.count(F.lit(1)).alias("n"), F.max("i").alias("_last"), F.max_by("i", F.struct("x", -F.col("i"))).alias("peak")
    )
    lengths = track.groupBy("rec").agg(F.max("i").alias("_n"))
    found = scans.beside(found.where(F.col("n") >= least), lengths).where(F.col("_last") < F.col("_n"))
    found = scans.parted(scans.written(found.select("rec", "peak", "n")), "peak")
    return scans.previous(found, "peak", "_b", "peak").select("rec", "peak", "n", (F.col("peak") - F.col("_b")).alias("gap"))


def normalised_by_rest(track: DataFrame, least: int) -> DataFrame:
    """x over the RMS at rest of its recording; over that of the whole where under `least` samples rest."""
    square = F.col("x") * F.col("x")
    rest = F.when(F.count_if(F.col("label") == 0) >= least, F.avg(F.when(F.col("label") == 0, square)))
    levels = track.groupBy("rec").agg(F.coalesce(rest, F.avg(square)).alias("_level"))
    return scans.beside(track, levels).withColumn("y", F.col("x") / F.sqrt(F.col("_level") + EPS)).drop("_level")


def numbered_by_appearance(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Each key with a number from 0 by its first appearance: numbered within RANGES ranges of it, and moved by the ranges before."""
    first = rows.groupBy(key).agg(F.min(order).alias("first"))
    cuts = first.agg(F.percentile_approx("first", [k / RANGES for k in range(1, RANGES)])).first()[0] or []
    ranged = first.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("first"))) if cuts else F.lit(0))
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    sizes = ranged.groupBy(F.col("_range").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    row = F.row_number().over(Window.partitionBy("_range").orderBy("first", key)) - 1
    return ranged.withColumn("_row", row).join(F.broadcast(starts), F.col("_range") == F.col("_of")).select(key, "first", (F.col("_start") + F.col("_row")).alias("index"))
