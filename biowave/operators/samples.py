"""Mixed samples: clean segments meet windows of a noise library at requested signal-to-noise ratios.

A library item is long and few items serve every segment, so items are cut into stretches that overlap by a window: a
component meets the one stretch its window lies in, and no item is a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biowave.functions import arrays as A
from biowave.operators import mixing
from biowave.operators.splitting import key_number


def picked(values: list, *keys: Column, salt: str) -> Column:
    """One of a few constants by a hash of the keys."""
    return F.element_at(F.array(*map(F.lit, values)), (key_number(*keys, salt=salt) % len(values)).cast("int") + 1)


def stretches(library: DataFrame, size: int) -> DataFrame:
    """library (noise_type, idx, path, signal) as (noise_type, idx, block, path, stretch) with windows that start from each multiple of size.

    An item shorter than a window is repeated; a null or empty one gives no row.
    """
    n = F.size("signal")
    whole = F.when(n < size, F.flatten(F.array_repeat("signal", (F.lit(size) / n).cast("int") + 2))).otherwise(F.col("signal"))
    items = library.where(n > 0).withColumn("_whole", whole)
    last = ((F.size("_whole") - size) / size).cast("int")
    cut = items.withColumn("block", F.explode(F.sequence(F.lit(0), last)))
    return cut.select("noise_type", "idx", "block", "path", F.slice("_whole", F.col("block") * size + 1, F.lit(2 * size - 1)).alias("stretch"))


def starts(library: DataFrame, size: int) -> DataFrame:
    """How many windows each item has: (noise_type, idx, windows)."""
    n = F.size("signal")
    length = F.when(n < size, n * ((F.lit(size) / n).cast("int") + 2)).otherwise(n)
    return library.where(n > 0).select("noise_type", "idx", (length - size + 1).alias("windows"))


def mixed_samples(segments: DataFrame, jobs: DataFrame, library: DataFrame, size: int, key: tuple[str, ...] = ("seg", "snr", "k")) -> DataFrame:
    """Each job's segment with k kinds of noise: the key, seg, snr, k, noise_types, noise_paths, scalars, wgn_capped, clean, noisy.

    segments are (seg, clean) of `size` samples, jobs (seg, snr, k, allowed) distinct by their key, from which all is drawn, and
    items of a type are numbered from 0 without gaps. Types, items and places come from hashes of the job's key; where k is more than the
    types allowed, all of them are mixed. A segment without power comes back as it is, with scalars of 0 and no paths. Jobs of segments that are
    not there give no row.
    """
    drawn_by = [F.col(c) for c in key]
    key = list(dict.fromkeys([*key, "seg", "snr", "k"]))
    few = jobs.withColumn("types", mixing.chosen(F.col("allowed"), F.col("k"), *drawn_by))
    number = lambda salt: key_number(*drawn_by, F.col("noise_type"), salt=salt)
    # a row a type, of which there are five
    counts = library.where(F.col("noise_type").isin(*mixing.NOISE_TYPES)).groupBy("noise_type").agg((F.max("idx") + 1).alias("_items"))
    parts = few.select(*key, F.posexplode("types").alias("at", "noise_type")).join(F.broadcast(counts), "noise_type")
    parts = parts.withColumn("idx", (number("item") % F.col("_items")).cast("int"))
    parts = parts.join(starts(library, size), ["noise_type", "idx"]).withColumn("_start", (number("start") % F.col("windows")).cast("int"))
    parts = parts.withColumn("block", (F.col("_start") / size).cast("int")).withColumn("_off", F.col("_start") % size)
    met = parts.join(stretches(library, size), ["noise_type", "idx", "block"])
    met = met.select(*key, F.struct("at", "noise_type", "path", F.slice("stretch", F.col("_off") + 1, F.lit(size)).alias("noise")).alias("_part"))
    met = met.repartition("seg")  # where the segments are met, so that the noise moves once and not for its sample and its segment each
    whole = met.groupBy(*key).agg(F.sort_array(F.collect_list("_part")).alias("_parts")).join(segments.select("seg", "clean"), "seg")

    types, has_wgn = F.transform("_parts", lambda p: p["noise_type"]), F.col("_has_wgn")
    power, snr, k = F.col("_power"), F.col("snr").cast("double"), F.size("_parts")

    def factor(part: Column) -> Column:
        target = mixing.component_power(power, snr, k, has_wgn, part["noise_type"] == "WGN")
        return A.let(A.power(part["noise"]), lambda own: F.when((own > mixing.TINY) & (power >= mixing.TINY), F.sqrt(target / own)).otherwise(0.0))

    whole = whole.withColumn("_power", A.power(F.col("clean"))).withColumn("_has_wgn", F.array_contains(types, "WGN"))
    scaled = whole.withColumn("scalars", F.transform("_parts", factor))
    pairs = F.arrays_zip("_parts", "scalars")
    noisy = F.aggregate(pairs, F.col("clean"), lambda s, p: F.zip_with(s, p["_parts"]["noise"], lambda a, b: a + b * p["scalars"]))
    paths = F.when(power >= mixing.TINY, F.array_join(F.transform("_parts", lambda p: p["path"]), "|")).otherwise("")
    capped = mixing.is_capped(snr, k, has_wgn) & (power >= mixing.TINY)
    return scaled.select(*key, F.array_join(types, "+").alias("noise_types"), paths.alias("noise_paths"), "scalars", capped.alias("wgn_capped"), "clean", noisy.alias("noisy"))


def grid_jobs(keys: DataFrame, snrs=mixing.SNR_GRID, most: int = 5, for_all_k: bool = False) -> DataFrame:
    """Every segment at each SNR with 1 .. most kinds of noise."""
    return mixing.grid(keys.select("seg"), snrs, most).withColumn("allowed", mixing.allowed_types(F.col("k"), F.col("snr"), for_all_k))


def drawn_jobs(keys: DataFrame, snrs=mixing.SNR_GRID, most: int = 5) -> DataFrame:
    """Every segment once, at an SNR and with a number of kinds drawn by its key."""
    drawn = keys.select("seg", picked(list(snrs), F.col("seg"), salt="snr").alias("snr"), picked(list(range(1, most + 1)), F.col("seg"), salt="k").alias("k"))
    return drawn.withColumn("allowed", mixing.allowed_types(F.col("k"), F.col("snr")))


def single_jobs(keys: DataFrame, snrs=(-10, -5, 0, 5, 10)) -> DataFrame:
    """Every segment once with one kind of noise, any, at a drawn SNR: what parameters are calibrated on."""
    drawn = keys.select("seg", picked(list(snrs), F.col("seg"), salt="snr").alias("snr"), F.lit(1).alias("k"))
    return drawn.withColumn("allowed", F.array(*map(F.lit, mixing.NOISE_TYPES)))


def epoch_jobs(keys: DataFrame, epochs: list[int], low: float = -15.0, high: float = 15.0, least: int = 1, most: int = 5) -> DataFrame:
    """Every segment once an epoch: (epoch, seg, snr, k, allowed), an SNR anywhere from low to high (to a thousandth of a decibel) and
    from `least` to `most` kinds, drawn by epoch and segment; mix with key (epoch, seg). A retried task draws the same."""
    drawn = keys.select(F.explode(F.array(*map(F.lit, epochs))).alias("epoch"), "seg")
    number = lambda salt: key_number(F.col("epoch"), F.col("seg"), salt=salt)
    snr = F.round(low + (high - low) * (number("snr") / float(1 << 32)), 3)
    drawn = drawn.withColumn("snr", snr).withColumn("k", (least + number("k") % (most - least + 1)).cast("int"))
    return drawn.withColumn("allowed", mixing.allowed_types(F.col("k"), F.col("snr")))


def training_pairs(mixed: DataFrame, method: str = "Q99") -> DataFrame:
    """Mixed samples with clean and noisy over the noisy one's scale, cut to -1 .. 1: what a model is trained on."""
    scaled = mixed.withColumn("scale", A.scale(F.col("noisy"), method))
    return scaled.withColumns({f"{c}_norm": A.clipped(F.col(c), F.col("scale")) for c in ("clean", "noisy")})


def mixing_stats(mixed: DataFrame, by: list[str]) -> DataFrame:
    """What was mixed, by groups: (…, kind, name, n, snr_mean, snr_low, snr_high) for each type, each k, and all samples."""
    kinds = F.transform(F.split("noise_types", r"\+"), lambda t: F.struct(F.lit("type").alias("kind"), t.alias("name")))
    others = F.array(F.struct(F.lit("k").alias("kind"), F.col("k").cast("string").alias("name")), F.struct(F.lit("all").alias("kind"), F.lit("").alias("name")))
    rows = mixed.select(*by, "snr", F.explode(F.concat(kinds, others)).alias("_of")).select(*by, "snr", "_of.kind", "_of.name")
    return rows.groupBy(*by, "kind", "name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("snr").alias("snr_mean"), F.min("snr").alias("snr_low"), F.max("snr").alias("snr_high")
    )
