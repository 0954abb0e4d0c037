"""Sharding by sampled splitters, with DataFrame operations only.

Records are ordered by (text hash, id). A size-weighted sample of these keys gives quantile boundaries, the records are
dealt to the ranges between them, and ranges that turn out overfull are sampled again and subdivided. Running sums
within the ranges, moved by the totals of the ranges before, give every record its place among all bytes; the shard is
that place cut into equal parts.
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biowave.llm.common import materialize

LOW = -(1 << 63)
PER_RANGE = 16  # sampled keys for each range
MAX_RANGES = 1 << 14  # bounds what the driver holds: the sample is about PER_RANGE times this
ROWS_PER_RANGE = 1 << 20
ROUNDS = 4  # of counting the ranges; overfull ones are subdivided between two


def _ranged(rows: DataFrame, at: list[tuple[int, int]]) -> DataFrame:
    """rows with the number of their range: how many of the splitters are <= (key, sub), by binary search.

    The splitters, at most max_ranges and their subdivisions, are the arrays of a one-row table that every task gets.
    """
    size = 1 << len(at).bit_length()
    top = (1 << 63) - 1
    padded = [*at, *[(top, top)] * (size - len(at))]
    table = rows.sparkSession.createDataFrame(
        [(0, [k for k, _ in padded], [s for _, s in padded])], "_one bigint, _keys array<bigint>, _subs array<bigint>"
    )
    halves = [size >> k for k in range(1, size.bit_length())] or [0]

    def step(found: Column, half: Column) -> Column:
        probe = found + half  # arrays count from 1: this is the last splitter of the nearer half
        k, s = F.element_at("_keys", probe), F.element_at("_subs", probe)
        return F.when((F.col("key") > k) | ((F.col("key") == k) & (F.col("sub") >= s)), probe).otherwise(found)

    out = rows.join(F.broadcast(table), F.pmod(F.col("sub"), F.lit(1)) == F.col("_one"))
    place = F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), step) if at else F.lit(0)
    return out.withColumn("range", place).drop("_one", "_keys", "_subs")


def _splitters(sample: list[tuple[int, int]], step: int) -> list[tuple[int, int]]:
    """Every step-th sampled key. A key that spans several picks is hot and is cut by its second part; others stay whole."""
    picked = sorted(sample)[step::step]
    count: dict[int, int] = {}
    for k, _ in picked:
        count[k] = count.get(k, 0) + 1
    return sorted({(k, s if count[k] > 1 else LOW) for k, s in picked})


def _sampled(rows: DataFrame, rate: float, salt: int) -> list[tuple[int, int]]:
    """Keys drawn with probability size * rate, by a hash of the row, so that a lost task draws the same again."""
    draw = F.shiftrightunsigned(F.xxhash64("sub", "key", F.lit(salt)), 11) / F.lit(float(1 << 53))
    return [(r[0], r[1]) for r in rows.where(draw < F.col("size") * F.lit(rate)).select("key", "sub").collect()]


def shard(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", slack: float = 0.01,
    max_ranges: int = MAX_RANGES, rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """One row per record: id, size, text_crc32, law, shard, slot, grown_shard.

    law is `bytes`: the shards' sums of sizes are near equal. size is the text's UTF-8 bytes (null: none) plus 16. Rows
    with equal texts stand together, and share a shard unless they hold over `slack` of a shard's bytes. slot counts the
    rows of a shard gaplessly from 0 in key order; grown_shard is null under this law. Null ids sort first; rows that
    repeat an id are separate records; an empty input gives an empty result; other columns are ignored. A single record
    larger than a shard's share leaves neighbouring shards short, and there may then be empty shards.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text).cast("bigint") + 16).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
            F.xxhash64(F.col(id_col)).alias("sub"),
        )
    )
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = min(max_ranges, max(32 * shards, math.ceil(count / rows_per_range))) if count else 1
    at = _splitters(_sampled(rows, PER_RANGE * ranges / total, 0), PER_RANGE) if ranges > 1 else []
    for again in range(1, ROUNDS + 1):
        sums = {
            r["range"]: (r["b"], r["n"])
            for r in _ranged(rows, at).groupBy("range").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
        }
        full = [k for k, (b, n) in sums.items() if n > 1 and b > 3 * total / ranges]
        if ranges == 1 or not full or again == ROUNDS:
            break
        drawn = _sampled(_ranged(rows, at).where(F.col("range").isin(full)), PER_RANGE * ranges / total, again)
        more: dict[int, list[tuple[int, int]]] = {}
        for x in drawn:
            more.setdefault(bisect.bisect_right(at, x), []).append(x)
        finer = sorted({*at, *(x for part in more.values() for x in _splitters(part, PER_RANGE))})
        if finer == at:
            break
        at = finer
    before, first, offsets = 0, 0, []
    for k in range(len(at) + 1):
        b, n = sums.get(k, (0, 0))
        offsets.append((k, before, first))
        before, first = before + b, first + n
    starts = docs.sparkSession.createDataFrame(offsets, "range int, range_bytes bigint, range_rows bigint")

    share = max(total, 1) / shards
    order = Window.partitionBy("range").orderBy("key", "sub", "_id")
    group = Window.partitionBy("range", "key")
    placed = (
        _ranged(rows, at)
        .withColumn("_end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_row", F.row_number().over(order))
        .withColumn("_group", F.sum("size").over(group))
        .withColumn("_group_end", F.max("_end").over(group))
    )
    whole = F.col("_group") <= F.lit(slack * share)
    middle = F.when(whole, F.col("_group_end") - F.col("_group") / 2).otherwise(F.col("_end") - F.col("size") / 2)
    # the table of range starts has at most max_ranges rows and those of the subdivisions
    placed = materialize(
        placed.join(F.broadcast(starts), "range").select(
            "_id", "size", "text_crc32",
            F.least(F.floor((F.col("range_bytes") + middle) / F.lit(share)), F.lit(shards - 1)).cast("int").alias("shard"),
            (F.col("range_rows") + F.col("_row") - 1).alias("_at"),
        )
    )
    firsts = placed.groupBy("shard").agg(F.min("_at").alias("_first"))  # one row a shard
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_at") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
