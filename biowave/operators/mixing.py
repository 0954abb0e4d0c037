"""Mixing noise into clean segments at requested signal-to-noise ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biowave.functions import arrays as A
from biowave.operators.splitting import key_number

WGN_FLOOR_DB = -5.0  # a white-noise component's SNR isn't below this
SNR_GRID = (-15, -10, -5, 0, 5, 10, 15)
NOISE_TYPES = ("PLI", "WGN", "ECG", "MOA", "Color")
TINY = 1e-12


def component_power(clean_power: Column, snr: Column, k: Column, has_wgn: Column, is_wgn: Column) -> Column:
    """Target power of one of k components. White noise is capped at its floor and the others share what that leaves."""
    all_noise = clean_power / F.pow(F.lit(10.0), snr / 10.0)
    floor = clean_power / F.lit(10.0 ** (WGN_FLOOR_DB / 10.0))
    capped = has_wgn & (k > 1) & (all_noise / k > floor)
    rest = F.greatest(all_noise - floor, F.lit(0.0)) / F.greatest(k - 1, F.lit(1))
    return F.when(capped & is_wgn, floor).when(capped, rest).otherwise(all_noise / k)


def is_capped(snr: Column, k: Column, has_wgn: Column) -> Column:
    return has_wgn & (k >= 2) & (snr + 10.0 * F.log10(k.cast("double")) < WGN_FLOOR_DB)


def allowed_types(k: Column, snr: Column, for_all_k: bool = False) -> Column:
    """Noise types to choose from: below the floor white noise alone is excluded, or with for_all_k from every mix."""
    every = F.array(*map(F.lit, NOISE_TYPES))
    low = snr < WGN_FLOOR_DB
    return F.when(low if for_all_k else low & (k == 1), F.array_remove(every, "WGN")).otherwise(every)


def chosen(types: Column, k: Column, *keys: Column) -> Column:
    """k of types, by hashes of the keys and the type, in the types' order."""
    ranked = F.array_sort(F.transform(types, lambda t: F.struct(key_number(*keys, t, salt="type").alias("h"), t.alias("t"))))
    picked = F.transform(F.slice(ranked, 1, k), lambda x: x["t"])
    return A.let(picked, lambda some: F.filter(types, lambda t: F.array_contains(some, t)))


def grid(segments: DataFrame, snrs=SNR_GRID, most: int = 5) -> DataFrame:
    """Each segment at each SNR with 1 .. most noise types; the grid is a few constants."""
    snr = F.explode(F.array(*map(F.lit, snrs))).alias("snr")
    return segments.select("*", snr).select("*", F.explode(F.array(*map(F.lit, range(1, most + 1)))).alias("k"))


def scaled(noise: Column, target: Column) -> Column:
    """noise with the target power; zeros where it has none."""

    def by(own: Column) -> Column:
        return A.let(F.when(own > TINY, F.sqrt(target / own)).otherwise(0.0), lambda f: F.transform(noise, lambda v: v * f))

    return A.let(A.power(noise), by)


def mix(clean: Column, noise: Column, target: Column) -> Column:
    """clean plus noise scaled to the target power."""
    return F.zip_with(clean, scaled(noise, target), lambda c, v: c + v)


def labels_of(types: Column, paths: Column) -> Column:
    """Labels under which a mix counts: its types, the colour where its paths name only one, and the number of types."""
    names = F.filter(F.transform(F.split(types, r"\+"), lambda t: F.trim(t)), lambda t: t != "")
    base = F.transform(F.split(F.lower(F.coalesce(paths, F.lit(""))), r"\|"), lambda p: F.element_at(F.split(F.trim(p), "/"), -1))
    colours = F.array_distinct(
        F.filter(
            F.transform(base, lambda b: F.when(b.contains("color") & b.contains("_pink_"), "Pink").when(b.contains("color") & b.contains("_brown_"), "Brown")),
            lambda c: c.isNotNull(),
        )
    )
    colour = F.when(F.array_contains(names, "Color") & (F.size(colours) == 1), colours).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(names) > 0, F.concat(names, colour, F.array(F.concat(F.lit("k="), F.size(names).cast("string"))))).otherwise(F.array().cast("array<string>"))
