"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in hash order, are cut into blocks. Block j of a source with weight w is released at slot
floor((j - 1) / w) and due at ceil(j / w); one block is placed in each slot, of the released ones that with the earliest
deadline. So after any number of slots a source's blocks differ from its weight's part by less than one block.

The schedule is over blocks, of which there are at most `max_blocks` plus one a source whatever the input's size, and is
made on the driver; the documents are numbered and placed by Spark.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biowave.llm.common import fresh, materialize

MAX_BLOCKS = 1 << 15
UNIT = 1_000_000  # weights are rounded to whole millionths


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Positive weights as integers with the sum UNIT, by largest remainders."""
    total = sum(weights.values())
    exact = {s: w / total * UNIT for s, w in weights.items()}
    out = {s: max(1, math.floor(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: max(0, UNIT - sum(out.values()))]:
        out[s] += 1
    most = max(out, key=lambda s: (out[s], s))
    out[most] += UNIT - sum(out.values())
    return out


def earliest_deadline_first(weights: dict[str, int], slots: int) -> list[tuple[str, int, int, int]]:
    """(source, its block from 0, release, deadline) of each slot, for weights that sum to the whole."""
    total = sum(weights.values())
    waiting = [(0, s, 0) for s in sorted(weights)]
    ready: list[tuple[int, str, int, int]] = []
    out = []
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            release, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[s]), s, j, release))
        deadline, s, j, release = heapq.heappop(ready)
        out.append((s, j, release, deadline))
        heapq.heappush(waiting, ((j + 1) * total // weights[s], s, j + 1))
    return out


def timetable(blocks: dict[str, int], weights: dict[str, float]) -> list[tuple[str, int, int, int, int, str]]:
    """(source, block, slot, release, deadline, phase) of every block.

    The target weights hold as long as every weighted source can serve them; phase `rest` then interleaves what is
    left in proportion to what each source has left, so that nothing is lost and all end together.
    """
    if not blocks:
        return []
    wanted = whole_weights({s: weights[s] for s in blocks if weights.get(s, 0) > 0} or {s: n for s, n in blocks.items()})
    horizon = min(math.floor(blocks[s] / Fraction(w, UNIT)) for s, w in wanted.items())
    done = dict.fromkeys(blocks, 0)
    out = []
    for slot, (s, j, release, deadline) in enumerate(earliest_deadline_first(wanted, horizon)):
        out.append((s, j, slot, release, deadline, "target"))
        done[s] = j + 1
    left = {s: n - done[s] for s, n in blocks.items() if n > done[s]}
    for slot, (s, j, release, deadline) in enumerate(earliest_deadline_first(left, sum(left.values()))):
        out.append((s, done[s] + j, horizon + slot, horizon + release, horizon + deadline, "rest"))
    return out


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source",
    max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """One row per document: id, source, block, slot, release, deadline, phase, position.

    position numbers all documents gaplessly from 0 in the order of the mix. Without weights a source's weight is the
    square root of its number of documents. Sources without a weight come in phase `rest`; weights of sources without
    documents are left out. A null source is the source ''. A source's order is that of a hash of the id, ties by id; rows
    that repeat an id are placed each. An empty input gives an empty result, other columns are ignored.
    """
    spark = docs.sparkSession
    rows = materialize(
        docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"))
        .withColumn("_hash", F.xxhash64("_id", F.lit("mix")))
    )
    counts = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    size = max(1, math.ceil(total / max_blocks))
    blocks = {s: math.ceil(n / size) for s, n in counts.items()}
    placed, position = [], 0
    for s, j, slot, release, deadline, phase in timetable(blocks, weights or {s: math.sqrt(n) for s, n in counts.items()}):
        placed.append((s, j, slot, release, deadline, phase, position))
        position += min(size, counts[s] - j * size)
    table = spark.createDataFrame(
        placed, "source string, block bigint, slot bigint, release bigint, deadline bigint, phase string, _first bigint"
    )
    # a source is numbered in parts of its hash range, so that none is one task; parts are numbered by their sums before
    bits = min(16, max(0, (total // 1024).bit_length()))
    part = F.shiftrightunsigned("_hash", 64 - bits) if bits else F.lit(0).cast("bigint")
    parted = rows.withColumn("_part", part)
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parted.groupBy("source", "_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("source", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = parted.withColumn("_row", F.row_number().over(Window.partitionBy("source", "_part").orderBy("_hash", "_id")))
    numbered = numbered.join(starts, ["source", "_part"]).withColumn("_at", F.col("_start") + F.col("_row") - 1)
    numbered = numbered.withColumn("block", F.floor(F.col("_at") / size).cast("bigint"))
    # at most max_blocks rows and one for each source
    return numbered.join(F.broadcast(table), ["source", "block"]).select(
        F.col("_id").alias(id_col), "source", "block", "slot", "release", "deadline", "phase",
        (F.col("_first") + F.col("_at") - F.col("block") * size).alias("position"),
    )


def in_mixed_order(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All rows of docs with their columns, sorted over all partitions by their place in the mix."""
    key, place = fresh(docs, "_mix_id"), fresh(docs, "_mix_position")
    order = mix(docs, weights, id_col, source_col).groupBy(F.col(id_col).alias(key)).agg(F.min("position").alias(place))
    placed = docs.join(order, F.col(id_col).eqNullSafe(F.col(key))).drop(key)
    return placed.repartitionByRange(place).sortWithinPartitions(place).drop(place)
