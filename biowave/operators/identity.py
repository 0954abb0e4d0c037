"""Names, ids and tags of recordings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def subject_of(path: Column) -> Column:
    """The number after S, in `S<n>_E<m>` first, then anywhere in the name; -1 without one."""
    name = base_name(path)
    tries = [F.regexp_extract(name, p, 1) for p in (r"(?i)S(\d+)_E\d+", r"(?i)S(\d+)", r"(?i)subject_?(\d+)")]
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in tries], F.lit("-1")).cast("int")


def exercise_of(path: Column) -> Column:
    name = base_name(path)
    tries = [F.regexp_extract(name, p, 1) for p in (r"(?i)S\d+_E(\d+)", r"(?i)E(\d+)")]
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in tries], F.lit("-1")).cast("int")


def cross_subject_id(dataset: Column, subject: Column, path: Column) -> Column:
    """dataset_subject, or an id from the file's MD5 where the subject isn't known."""
    unknown = F.concat(dataset, F.lit("_UNK_"), F.substring(F.md5(path), 1, 8))
    return F.when(subject >= 0, F.concat_ws("_", dataset, subject.cast("string"))).otherwise(unknown)


def segment_id(dataset: Column, subject: Column, channel: Column, trial: Column, segment: Column) -> Column:
    return F.concat(dataset, F.lit("_"), subject, F.lit("_ch"), channel.cast("string"), F.lit("_t"), trial.cast("string"), F.lit("_seg"), segment.cast("string"))


def segment_parts(sid: Column) -> Column:
    """subject, channel, trial and segment of a segment id; null numbers where it isn't one."""
    number = lambda p: F.nullif(F.regexp_extract(sid, p, 1), F.lit("")).try_cast("int")
    return F.struct(
        F.regexp_extract(sid, r"^(.*)_ch\d+_t\d+_seg\d+$", 1).alias("subject"), number(r"_ch(\d+)_").alias("channel"),
        number(r"_t(\d+)_").alias("trial"), number(r"_seg(\d+)$").alias("segment"),
    )


def safe_token(text: Column) -> Column:
    """Letters, digits, `_` and `-`; anything else is `_`, none of them at the ends."""
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "_"), F.lit("_"))


def has_tag(noise_types: Column, tag: str) -> Column:
    """Substring test, by noise name or one of the short tags."""
    names = {"P": "PLI", "E": "ECG", "WG": "WGN", "m": "MOA", "Q": "MOA", "B": "BW"}  # fixed values
    return F.upper(F.coalesce(noise_types, F.lit(""))).contains(names.get(tag, tag).upper())


def is_coloured(noise_types: Column) -> Column:
    return F.lower(F.coalesce(noise_types, F.lit(""))).rlike("colou?r|pink|brown")


def is_motion(noise_types: Column) -> Column:
    up = F.upper(F.coalesce(noise_types, F.lit("")))
    return up.contains("MOA") | up.contains("+M") | (up == "M") | up.contains("MOTION")


def motion_cutoff(noise_types: Column, paths: Column, first: float = 40.0, second: float = 20.0, default: float = 40.0) -> Column:
    """High-pass cutoff by the source that the names tell."""
    s = F.lower(F.concat_ws(" ", noise_types, paths))
    return F.when(s.contains("machado"), first).when(s.contains("nstdb"), second).otherwise(default)


def class_of(exercise: Column, movement: Column) -> Column:
    """Class from 0: movements of later exercises follow those of earlier ones (12 and 17 of them)."""
    return movement - 1 + F.when(exercise == 2, 12).when(exercise == 3, 29).otherwise(0)


def best_match(name: Column, trial: Column) -> Column:
    """Whether a file name holds the trial's number with no digit beside it."""
    return F.regexp_like(name, F.concat(F.lit(r"(^|\D)"), trial.cast("string"), F.lit(r"(\D|$)")))


def label_files(files: DataFrame, trials: DataFrame) -> DataFrame:
    """(subject, trial, name): of a subject's files (subject, name) whose names hold the trial's number, the one with the smallest last number.

    A name is met by each of the numbers in it, so subject and number are the join's key; ties go by name, and trials without a file give no row.
    """
    numbers = F.regexp_extract_all("name", F.lit(r"(\d+)"), F.lit(1))
    held = files.select("subject", "name", numbers.alias("_n")).select("subject", "name", F.element_at("_n", -1).cast("decimal(38,0)").alias("_last"), F.explode(F.array_distinct("_n")).alias("_held"))
    met = trials.select("subject", "trial", F.col("trial").cast("string").alias("_held")).join(held, ["subject", "_held"])
    return met.groupBy("subject", "trial").agg(F.min_by("name", F.struct("_last", "name")).alias("name"))
