"""Best-fit packing of tokenised documents by the sum-of-squares rule."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biowave.llm.common import materialize

CAPACITY = 2048
RANGE_BITS = 16  # places of the order that are summed in one group
LOT_SEQUENCES = 512  # sequences that one group fills, about
#: Beyond plain Latin text, and for its own special strings and very long runs, the tokenizer file itself is asked.
UNUSUAL = re.compile(r"[^\x00-ɏ]|<\||\S{1000}|\s{1000}")

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def encoder(json_path: str, ranks_path: str | None):
    """text -> list of ids. The same vocabulary as ranks is several times faster and gives the same ids on usual text."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    exact = lambda text: slow.encode(text, add_special_tokens=False).ids
    if ranks_path is None:
        return exact
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: exact(text) if UNUSUAL.search(text) else fast.encode_ordinary(text)


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, json_path: str, ranks_path: str | None, order: Column | None = None) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32. Only documents over the capacity are cut."""

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(json_path, ranks_path)
        for part in parts:
            rows = []
            for doc, text, at in zip(part["_id"].array, part["_text"], part["_at"].tolist(), strict=True):
                ids = np.array([*encode(text or ""), 0], "<u4")
                cut = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), at) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "_at"])
            yield out.astype({"doc_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), (F.lit(0) if order is None else order).cast("bigint").alias("_at"))
    return rows.mapInPandas(batch, PIECES + ", _at bigint")


def written_order(docs: DataFrame) -> Column:
    """The place of each row in the table that docs reads: its file's number and its row there; of other frames the row's own place."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return F.monotonically_increasing_id()
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("bigint")
    return F.shiftleft(F.coalesce(part, F.lit(0).cast("bigint")), 40) + F.col("_metadata.row_index")


def ranges(cut: DataFrame, tokens: int, lots: int) -> DataFrame:
    """cut with _lot: consecutive ranges of _at, of about as many tokens each."""
    parted = cut.withColumn("_part", F.shiftright("_at", RANGE_BITS))
    sums = parted.groupBy("_part").agg(F.sum("length").alias("_sum"))  # a row for each 2 ** RANGE_BITS places
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("_part").orderBy("_at", "doc_id", "piece", "_row").rowsBetween(Window.unboundedPreceding, -1)
    counted = parted.withColumn("_own", F.coalesce(F.sum("length").over(own), F.lit(0))).join(starts, "_part")
    size = max(1, -(-tokens // lots))
    return counted.withColumn("_lot", F.floor((F.col("_start") + F.col("_own")) / size).cast("bigint")).drop("_part", "_own", "_start")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, in the order given.

    A length goes into the open bin by which the sum over gaps of (open bins with that gap) squared becomes smallest,
    of equal choices into the tightest one; a bin is opened where none fits. Full bins have no gap and don't count.
    """
    open_bins = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    never = np.iinfo(np.int64).max
    for k, s in enumerate(lengths.tolist()):
        here = open_bins[s:]
        change = 2 * (open_bins[: capacity + 1 - s] - here) + 2
        change[0] -= 1  # a bin that becomes full leaves no gap behind
        change[here == 0] = never
        g = int(change.argmin())
        if here[g]:
            b = stacks[g + s].pop()
            open_bins[g + s] -= 1
        else:
            g, b, n = capacity - s, n, n + 1
        bins[k], offsets[k] = b, capacity - g - s
        if g:
            stacks[g].append(b)
            open_bins[g] += 1
    return bins, offsets


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, lot_sequences: int = LOT_SEQUENCES,
    json_path: str | None = None, ranks_path: str | None = None, order: Column | None = None,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and then id 0 (a null text: only that). One longer than the capacity is cut into pieces
    of the capacity, of which the first may be shorter. Pieces are dealt by hash to lots of about `lot_sequences`
    sequences, and each lot is packed by itself, longest first: lots are bounded at every input size, and a lot ends with
    a bin or so that isn't full. With an `order` (a bigint column) lots are consecutive ranges of it instead, and sequence_id
    rises with them. Rows that repeat an id are packed each, null ids too; an empty input gives no rows.
    """
    if json_path is None:
        json_path, ranks_path = default_paths()
    # rows that are alike in everything differ by their number, which is written with them
    cut = materialize(pieces(docs, id_col, text_col, capacity, json_path, ranks_path, order).withColumn("_row", F.monotonically_increasing_id()))
    tokens = cut.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    lots = max(1, round(tokens / capacity / lot_sequences))

    def lot(group: pd.DataFrame) -> pd.DataFrame:
        # ties in length go by document, so that a lot that is packed again comes out the same
        group = group.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True])
        bins, offsets = sum_of_squares(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=group["_lot"].to_numpy(np.int64) * (1 << 32) + bins, offset=offsets).drop(columns="_lot")

    dealt = ranges(cut, tokens, lots) if order is not None else cut.withColumn("_lot", F.pmod(F.xxhash64("doc_id", "piece", "_row"), F.lit(lots)))
    return dealt.drop("_at", "_row").groupBy("_lot").applyInPandas(lot, PIECES + ", sequence_id bigint, offset bigint")
