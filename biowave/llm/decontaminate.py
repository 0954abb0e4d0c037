"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are windows of consecutive words of the benchmark's items. The search looks at the last block (two words) of the
next possible place: a shift table tells how far on the first place is where that block could end a pattern, and a block that
no pattern has skips almost a whole pattern. Where the shift is 0, the bucket of that suffix has the windows that end so, and
comparing them directly with the text's words confirms an occurrence. Most words of most documents are never looked at.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biowave.llm.common import ascii_lower, materialize

WINDOW = 10
PART_BYTES = 32 << 20  # of the patterns that a task holds at once
#: every byte that is no part of a word becomes a blank; all bytes of characters beyond ASCII are parts of words
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOUND = "n_words bigint, spans array<struct<first:bigint,last:bigint>>, items array<bigint>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class Patterns:
    """Shift tables and suffix buckets for each length that patterns have."""

    def __init__(self, windows: Iterable[tuple[bytes, list[int]]]):
        """windows: (words joined by a blank, ids of its items)."""
        by_length = defaultdict(dict)
        for window, items in windows:
            words = tuple(window.split(b" "))
            by_length[len(words)][words] = items
        self.searches = [self._tables(n, found) for n, found in sorted(by_length.items())]

    @staticmethod
    def _tables(n: int, found: dict[tuple, list[int]]) -> tuple:
        block = min(2, n)
        shift, buckets = {}, defaultdict(dict)
        for words, items in found.items():
            for end in range(block, n + 1):
                key = words[end - block : end]
                shift[key] = min(shift.get(key, n), n - end)
            buckets[words[n - block :]][words] = items
        return n, block, shift, dict(buckets)

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[int]]:
        """(spans of words, first and last, that occurrences cover, apart from each other and ascending; ids of items that occur)."""
        spans, seen = [], set()
        size = len(words)
        for n, block, shift, buckets in self.searches:
            far, end = n - block + 1, n
            while end <= size:
                key = (words[end - 2], words[end - 1]) if block == 2 else (words[end - 1],)
                on = shift.get(key, far)
                if on:
                    end += on
                    continue
                items = buckets[key].get(tuple(words[end - n : end]))
                if items is not None:
                    spans.append((end - n, end - 1))
                    seen.update(items)
                end += 1
        return merged(spans), sorted(seen)


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def windows_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(window, items): each distinct window of words, joined by a blank, with the sorted ids of the items that have it.

    An item of fewer words is one window. Windows of an item without an id have no ids.
    """
    words = F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(WORDS), F.lit(0))
    rows = items.select(F.col(id_col).cast("bigint").alias("item"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    rows = rows.select("item", "words", F.explode(starts).alias("at"))
    return rows.groupBy(F.array_join(F.slice("words", F.col("at"), window), " ").alias("window")).agg(F.sort_array(F.collect_set("item")).alias("items"))


def contaminated_spans(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per document: id, n_words, spans (array of first, last: words from 0), items (sorted ids of items that occur).

    Documents are searched whole where they are read, and never move. Patterns go to the tasks in parts of about part_bytes;
    a benchmark with more is searched for part by part, over documents that are then written once with a number each. A null or empty
    text has no words; rows that repeat an id are searched each; an item without an id marks words but isn't listed; other
    columns are ignored. Without documents there are no rows, without items no spans.
    """
    found = materialize(windows_of(items, item_col, item_text_col, window))
    size = F.octet_length("window") + 8 * F.size("items") + 64
    total = found.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    parts = max(1, math.ceil(total / part_bytes))
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    if parts == 1:
        return _searched(rows, found, "_id bigint").withColumnRenamed("_id", id_col)
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()))
    dealt, every = found.withColumn("_part", F.pmod(F.xxhash64("window"), F.lit(parts))), None
    for k in range(parts):
        hits = _searched(rows, dealt.where(F.col("_part") == k), "_row bigint, _id bigint")
        hits = materialize(hits.where("size(spans) > 0") if k else hits)
        every = every.unionByName(hits) if every else hits
    spans = every.groupBy("_row").agg(
        F.min("_id").alias("_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return spans.select(F.col("_id").alias(id_col), "n_words", _merged(F.array_sort("spans")).alias("spans"), "items")


def _merged(spans: Column) -> Column:
    """Ascending spans, those that meet made one."""
    def add(done: Column, span: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        wider = F.struct(last["first"].alias("first"), F.greatest(last["last"], span["last"]).alias("last"))
        meets = (F.size(done) > 0) & (span["first"] <= last["last"] + 1)
        return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, F.slice(spans, 1, 0), add)


def _searched(rows: DataFrame, windows: DataFrame, keep: str) -> DataFrame:
    """rows searched for the windows of one part, whose bytes are bounded."""
    got = windows.select("window", "items").collect()
    patterns = rows.sparkSession.sparkContext.broadcast([(r["window"].encode("utf-8", "surrogatepass"), r["items"]) for r in got])
    names = [x.split()[0] for x in keep.split(", ")]
    span = pa.struct([("first", pa.int64()), ("last", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Patterns(patterns.value)
        for batch in batches:
            n, spans, items = [], [], []
            for text in batch.column("_text"):
                words = words_of(text.as_py())
                at, which = tables.search(words)
                n.append(len(words))
                spans.append([{"first": a, "last": b} for a, b in at])
                items.append(which)
            new = [pa.array(n, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(items, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *new], [*names, "n_words", "spans", "items"])

    return rows.mapInArrow(search, f"{keep}, {FOUND}")
