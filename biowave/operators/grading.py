"""Rule grading of quality metrics, and the funnel of what it keeps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """Fixed default thresholds; a gate's None leaves that grade without it."""

    smr_min: float = 12.0
    shr_min: float = 8.0
    ohm_max: float = 1.4
    snr_a: float = 18.0
    snr_b: float = 10.0
    snr_c: float = 1.8
    hampel_a: float | None = 0.08
    hampel_b: float | None = 0.05
    nan_is_fail: bool = True
    keep: tuple[str, ...] = ("A_excellent", "B_good")


def number(c: Column) -> Column:
    """A number or null: what isn't one, and NaN, is missing."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v), v)


def grade(metrics: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """metrics (snr_db, smr_db, shr_db, ohm, hamp_er and any keys) with pass_base, qc_grade, pass_hampel, pass_final, reason_flags."""
    m = {c: number(F.col(c)) for c in ("snr_db", "smr_db", "shr_db", "ohm", "hamp_er")}
    valid = m["snr_db"].isNotNull() & m["smr_db"].isNotNull() & m["shr_db"].isNotNull() & m["ohm"].isNotNull()
    spectral = (m["smr_db"] > rules.smr_min) & (m["shr_db"] > rules.shr_min) & (m["ohm"] < rules.ohm_max)
    out = metrics.withColumn("_valid", valid).withColumn("pass_base", valid & F.coalesce(spectral, F.lit(False)))
    snr = m["snr_db"]
    name = F.when(~F.col("pass_base"), "rejected").when(snr >= rules.snr_a, "A_excellent").when(snr >= rules.snr_b, "B_good")
    out = out.withColumn("qc_grade", name.when(snr >= rules.snr_c, "C_unacceptable").otherwise("rejected"))
    gate = F.lit(True)
    for grade_name, most in (("A_excellent", rules.hampel_a), ("B_good", rules.hampel_b)):
        if most is not None:
            gate = F.when(F.col("qc_grade") == grade_name, F.coalesce(m["hamp_er"] <= most, F.lit(not rules.nan_is_fail))).otherwise(gate)
    kept = F.col("qc_grade").isin(*rules.keep)
    out = out.withColumn("pass_hampel", gate).withColumn("pass_final", F.col("pass_base") & kept & F.col("pass_hampel"))
    flags = F.concat_ws(
        "|",
        F.when(~F.col("_valid"), "nan_metric"),
        F.when(F.col("_valid") & ~F.col("pass_base"), "fail_spectral"),
        F.when(F.col("pass_base") & (F.col("qc_grade") == "rejected"), "fail_snr"),
        F.when(F.col("pass_base") & kept & ~F.col("pass_hampel"), "fail_hampel"),
    )
    return out.withColumn("reason_flags", F.when(flags == "", "OK").otherwise(flags)).drop("_valid")


def funnel(graded: DataFrame) -> DataFrame:
    has = lambda flag: F.count_if(F.col("reason_flags").contains(flag))
    return graded.agg(
        F.count(F.lit(1)).alias("n_total"), has("nan_metric").alias("n_nan"), has("fail_spectral").alias("n_fail_spectral"),
        has("fail_snr").alias("n_fail_snr"), has("fail_hampel").alias("n_fail_hampel"), F.count_if("pass_final").alias("n_pass"),
    )


def quality_report(graded: DataFrame, dataset: str, hampel: bool = True) -> str:
    """The funnel of a dataset's graded rows as text; one row of counts comes to the driver."""
    n = funnel(graded).first()
    share = 100 * n["n_pass"] / n["n_total"] if n["n_total"] else 0.0
    stages = [("nan_metric", n["n_nan"]), ("fail_spectral", n["n_fail_spectral"]), ("fail_snr", n["n_fail_snr"])] + ([("fail_hampel", n["n_fail_hampel"])] if hampel else [])
    lines = [f"Quality filter: {dataset}", "", f"rows of trials and channels  {n['n_total']}", f"pass                         {n['n_pass']} ({share:.2f} %)", ""]
    return "\n".join([*lines, *[f"stage {k}, {name:<15} {count}" for k, (name, count) in enumerate(stages)]]) + "\n"
