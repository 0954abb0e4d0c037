"""SimHash near-dedup with pigeonhole blocks.

Fingerprints are cut into m blocks. Two that differ in at most d bits agree on at least m - d whole blocks, so each
fingerprint is keyed by every choice of m - d blocks and only those that share a key are compared, exactly. Equal
fingerprints are one row throughout, and what leaves a bucket is a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biowave.llm.common import discard, fresh, materialize
from biowave.llm.graph import connected_components, forest

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
CHUNK = 2048  # members of a bucket that are compared with one another in one go
GROUP_ROWS = 1 << 16  # rows of one task's group, about
KEYED_ROWS = 1 << 20  # keys of blocks that one task works out, about


def _lanes(h: np.ndarray, lanes: int) -> np.ndarray:
    """`lanes` 64-bit hashes from each: lane 0 is the hash itself, others go through the splitmix64 finalizer."""
    z = h[:, None] + np.array([lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for lane in range(1, lanes)], np.uint64)[None]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.concatenate([h[:, None], z ^ (z >> np.uint64(31))], axis=1)


def _shingles(text: str | None, words: int) -> list[int]:
    """The hash of each shingle, repeats included; fewer words are one shingle."""
    found = WORD.findall((text or "").encode("utf-8").lower())
    if not found:
        return []
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) < words:
        return [digest(joined, 42)]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    return [digest(joined[a:b], 42) for a, b in zip((ends - lengths).tolist(), ends[words - 1 :].tolist(), strict=False)]


def wide_fingerprint(text: str | None, words: int, lanes: int) -> np.ndarray:
    """SimHash of a text's word shingles in `lanes` signed 64-bit numbers; zeros without words."""
    return _wide_of(_shingles(text, words), lanes)


def _wide_of(hashes: list[int], lanes: int) -> np.ndarray:
    if not hashes:
        return np.zeros(lanes, np.int64)
    bits = np.zeros(64 * lanes, np.int64)
    for k in range(0, len(hashes), 255 * 32):
        of = _lanes(np.array(hashes[k : k + 255 * 32], np.uint64), lanes).astype("<u8").view(np.uint8)
        rows = np.unpackbits(of, axis=1, bitorder="little")
        for j in range(0, len(rows), 255):  # as many as a byte can count
            bits += rows[j : j + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * bits > len(hashes), bitorder="little").view("<i8")


def fingerprint(text: str | None, words: int = 4) -> int:
    """The signed 64-bit SimHash of a text's word shingles; 0 without words."""
    return int(wide_fingerprint(text, words, 1)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(_id, fp bigint) for each row, over the whole text."""

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"_id": part["_id"], "fp": np.array([fingerprint(t, words) for t in part["_text"]], np.int64)})

    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInPandas(batch, "_id bigint, fp bigint")


def blocks_for(n: int, bits: int) -> int:
    """The fewest blocks for which chance alone gives a fingerprint under one partner; any number is exact."""
    for m in range(bits + 1, 16):
        if math.comb(m, bits) * n / 2 ** (64 * (m - bits) / m + 1) <= 1:
            return m
    return 16


def masks_for(m: int, bits: int) -> list[int]:
    """For each choice of m - bits of m blocks the mask of their bits, as a signed 64-bit number."""
    cut = [round(64 * k / m) for k in range(m + 1)]
    block = [((1 << (cut[k + 1] - cut[k])) - 1) << cut[k] for k in range(m)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(block[k] for k in c)) for c in itertools.combinations(range(m), m - bits)]


def _links_in(bits: int):
    def of(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["unit", "key", "mask"], kind="stable")
        fp, rep = group["fp"].to_numpy(np.int64).view(np.uint64), group["rep"].to_numpy(np.int64)
        same = np.ones(len(fp), bool)
        for c in ("unit", "key", "mask"):
            v = group[c].to_numpy()
            same[1:] &= v[1:] == v[:-1]
        same[:1] = False
        run = np.cumsum(~same)
        parent, used = np.arange(len(fp)), []
        left, lag = np.arange(len(fp)), 1
        while True:
            left = left[left + lag < len(fp)]
            left = left[run[left] == run[left + lag]]
            if not len(left):
                break
            hit = left[np.bitwise_count(fp[left] ^ fp[left + lag]) <= bits]
            if len(hit):
                used += forest(parent, hit, hit + lag)
            lag += 1
        a, b = np.array(used, np.int64).reshape(-1, 2).T
        return pd.DataFrame({"src": rep[a], "dst": rep[b]})

    return of


def links(distinct: DataFrame, bits: int = 4, blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Links (src, dst) between the representatives of distinct (fp, rep) that join all that differ in <= bits bits.

    A bucket with more than `chunk` members is dealt to parts by hash, and every pair of parts is compared in a group of
    its own: no cap, and no group larger than two parts. Each group emits the links that join its members, so a bucket
    of n near fingerprints gives about n rows.
    """
    distinct = distinct.where("rep IS NOT NULL")
    m = blocks or blocks_for(distinct.count(), bits)
    masks = masks_for(m, bits)
    keyed = distinct.select(
        "fp", "rep",
        F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(x)).alias("key")) for k, x in enumerate(masks)])).alias("_k"),
    ).select("fp", "rep", "_k.mask", "_k.key")
    shared = materialize(keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    parts = F.ceil(F.col("n") / chunk).cast("int")
    rows = shared.agg(F.coalesce(F.sum(F.col("n") * parts), F.lit(0))).first()[0]
    members = (
        keyed.join(shared, ["mask", "key"])
        .withColumn("_p", F.pmod(F.xxhash64("fp"), parts).cast("int"))
        .withColumn("_q", F.explode(F.sequence(F.lit(0), F.greatest(parts - 1, F.lit(0)))))
        .withColumn("unit", F.least("_p", "_q").cast("bigint") * (1 << 31) + F.greatest("_p", "_q"))
        .withColumn("_bin", F.pmod(F.xxhash64("mask", "key", "unit"), F.lit(max(1, rows // GROUP_ROWS) * 8)))
        .select("_bin", "unit", "mask", "key", "fp", "rep")
    )
    return members.groupBy("_bin").applyInPandas(_links_in(bits), "src bigint, dst bigint")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4, blocks: int | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Two fingerprints link when at most `bits` of their 64 bits differ. Null and empty texts, and those without words,
    have fingerprint zero and link like any other. Fewer words than a shingle has are one shingle. Rows that repeat an
    id come back each. A null id is nobody's component: such a row gets the component of its fingerprint, or null
    where no row with that fingerprint has an id. Other columns are ignored; an empty input gives an empty result.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, words))
    distinct = materialize(prints.groupBy("fp").agg(F.min("_id").alias("rep")))
    found = materialize(links(distinct, bits, blocks, chunk))
    parts = connected_components(found)
    classes = materialize(
        distinct.join(parts, distinct["rep"] == parts["node"], "left")
        .select("fp", F.coalesce("component", "rep").alias("component_id"))
    )
    discard(found)
    return prints.join(classes, "fp").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


LANES = 16  # of a wide fingerprint, 64 bits each
RECALL = 0.9  # of pairs just at the similarity, that share a block
SURE, DOUBTFUL = -2.5, 2.5  # standard deviations of the distance: links below, no links above, between them sets decide
PENDING = 1 << 20  # doubtful pairs that a group holds before it keeps a spanning forest of them


def _differs(similarity: float) -> float:
    """The chance that a bit differs: shingle sets of resemblance s have cosine 2s / (1 + s), and this is angle / pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def bits_apart(similarity: float, deviations: float, lanes: int = LANES) -> int:
    """Bits in which wide fingerprints differ: what the similarity leads to expect, and some standard deviations."""
    p = _differs(similarity)
    return round(64 * lanes * p + deviations * math.sqrt(64 * lanes * p * (1 - p)))


def block_chance(count: int, size: int, similarity: float, lanes: int = LANES) -> float:
    """The chance that a pair just at the similarity shares one of `count` blocks of `size` bits.

    The bits of a block are drawn without replacement, and all blocks of a pair see the same distance, which is binomial.
    """
    p, bits = _differs(similarity), 64 * lanes
    log_factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, bits + 1)))])
    d = np.arange(bits - size + 1)  # with more bits apart no block is free of them
    chance = np.exp(log_factorial[bits] - log_factorial[d] - log_factorial[bits - d] + d * math.log(p) + (bits - d) * math.log(1 - p))
    free = np.exp(log_factorial[bits - d] - log_factorial[bits - d - size] - log_factorial[bits] + log_factorial[bits - size])
    return float((chance * (1 - (1 - free) ** count)).sum())


def sampled_blocks(n: int, similarity: float, lanes: int = LANES, recall: float = RECALL) -> np.ndarray:
    """A row of places of bits for each block, drawn once and for all.

    As many blocks as make a pair just at the similarity share one with the probability `recall`, at every size. A block is five
    bits longer than the number of fingerprints is, so whatever that number is, chance shares about one block in forty.
    """
    size = max(12, math.ceil(math.log2(max(n, 1))) + 5)
    most = 1
    while block_chance(most, size, similarity, lanes) < recall:
        most *= 2
    count = bisect.bisect_left(range(most + 1), recall, lo=most // 2, key=lambda k: block_chance(k, size, similarity, lanes))
    rng = np.random.default_rng(64)
    return np.stack([rng.choice(64 * lanes, size, replace=False) for _ in range(count)])


def _keys_of(blocks: np.ndarray):
    """For each fingerprint its bits in each block, as numbers."""

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for a in range(0, len(part), 4096):
                some = part.iloc[a : a + 4096]
                bits = np.unpackbits(np.frombuffer(b"".join(some["fp"]), np.uint8).reshape(len(some), -1), axis=1, bitorder="little")
                keys = np.zeros((len(some), len(blocks)), np.int64)
                for k in range(blocks.shape[1]):
                    keys |= bits[:, blocks[:, k]].astype(np.int64) << k
                yield pd.DataFrame({"rep": some["rep"], "keys": list(keys)})

    return batch


def _wide_links_in(sure: int, limit: int):
    """Links within `sure` bits, and of the pairs within `limit` bits a least spanning forest between what these join."""

    def of(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["unit", "key", "mask", "rep"], kind="stable")
        fps = np.frombuffer(b"".join(group["fp"]), np.uint64).reshape(len(group), -1)
        rep = group["rep"].to_numpy(np.int64)
        same = np.ones(len(rep), bool)
        for c in ("unit", "key", "mask"):
            v = group[c].to_numpy()
            same[1:] &= v[1:] == v[:-1]
        same[:1] = False
        run = np.cumsum(~same)
        parent, pending = np.arange(len(rep)), [np.zeros((3, 0), np.int64)]

        def least_forest() -> np.ndarray:
            d, a, b = both = np.concatenate(pending, axis=1)
            order = np.lexsort((rep[b], rep[a], d))
            used = set(forest(parent.copy(), a[order], b[order]))
            return both[:, [x in used for x in zip(a.tolist(), b.tolist(), strict=True)]]

        left, lag = np.arange(len(rep)), 1
        while True:
            left = left[left + lag < len(rep)]
            left = left[run[left] == run[left + lag]]
            if not len(left):
                break
            for k in range(0, len(left), 1 << 16):
                some = left[k : k + (1 << 16)]
                d = np.bitwise_count(fps[some] ^ fps[some + lag]).sum(axis=1, dtype=np.int64)
                hit = some[d <= sure]
                if len(hit):
                    forest(parent, hit, hit + lag)
                at = (d > sure) & (d <= limit)
                pending.append(np.stack([d[at], some[at], some[at] + lag]))
            if sum(x.shape[1] for x in pending) > PENDING:
                pending = [least_forest()]
            lag += 1
        d, a, b = least_forest()
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        # to the smallest of the linked ones: groups that share members then tend to give the same pairs
        member = np.flatnonzero(parent != np.arange(len(rep)))
        src, dst = np.r_[rep[parent[member]], rep[a]], np.r_[rep[member], rep[b]]
        return pd.DataFrame({"src": np.minimum(src, dst), "dst": np.maximum(src, dst), "d": np.r_[np.zeros(len(member), np.int64), d]}).drop_duplicates()

    return of


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(_at, shingles) of docs (_at, _text): the sorted distinct hashes of a text's word shingles."""

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sets = [np.unique(np.array(_shingles(t, words), np.uint64)).view(np.int64) for t in part["_text"]]
            yield pd.DataFrame({"_at": part["_at"], "shingles": sets})

    return docs.mapInPandas(batch, "_at bigint, shingles array<bigint>")


def _resembling(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (src, dst) whose shingle sets have a resemblance of `similarity` or more; texts are (_at, _text)."""
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("_at")).distinct()
    sets = materialize(shingle_sets(texts.join(ends, "_at", "left_semi"), words))
    left, right = sets.toDF("src", "_left"), sets.toDF("dst", "_right")
    common = F.size(F.array_intersect("_left", "_right"))
    met = pairs.join(left, "src").join(right, "dst").select("src", "dst", common.alias("c"), (F.size("_left") + F.size("_right") - common).alias("u"))
    found = materialize(met.where(F.col("c") >= F.lit(similarity) * F.col("u")).select("src", "dst"))
    discard(sets)
    return found


def _parity(shingles: np.ndarray) -> bytes:
    """For each residue of a set's shingles, by a power of two from their number on, whether it has an odd number of them."""
    bits = 1 << max(6, int(len(shingles) - 1).bit_length())
    return np.packbits(np.bincount(shingles & (bits - 1), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _parities_apart(left: bytes, right: bytes) -> int:
    """Residues whose parities differ: two sets have at least as many elements that are not in both."""
    short, long = sorted((left, right), key=len)
    x = int.from_bytes(long, "little")
    for bits in (4 * len(long) >> k for k in range((len(long) // len(short)).bit_length() - 1)):
        x = x >> bits ^ x & (1 << bits) - 1
    return (x ^ int.from_bytes(short, "little")).bit_count()


def _words_apart(left: Column, right: Column) -> Column:
    """_parities_apart() of columns that hold parities as 64-bit words, one at most twice as many as the other."""
    short, long = F.when(F.size(left) <= F.size(right), left).otherwise(right), F.when(F.size(left) <= F.size(right), right).otherwise(left)
    half = F.size(short)
    folded = F.zip_with(F.slice(long, F.lit(1), half), F.slice(long, half + 1, half), lambda a, b: a.bitwiseXOR(b))
    folded = F.when(F.size(long) == half, long).otherwise(folded)
    return F.aggregate(F.zip_with(short, folded, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, more: n + more)


def _could_resemble(pairs: DataFrame, numbered: DataFrame, similarity: float) -> DataFrame:
    """The pairs (src, dst) without those whose parities prove that their sets resemble each other less, so that few sets are compared."""

    @F.pandas_udf("bigint")
    def apart(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([_parities_apart(a.tobytes(), b.tobytes()) for a, b in zip(left, right, strict=True)], dtype="int64")

    own = numbered.select("_at", "n", "parity")
    both = pairs.join(own.toDF("src", "_m", "_left"), "src").join(own.toDF("dst", "_n", "_right"), "dst")
    most = (F.col("_m") + F.col("_n") - apart("_left", "_right")) / 2  # of elements in both
    return both.where(most * (1 + similarity) >= similarity * (F.col("_m") + F.col("_n")) - 1e-6).select("src", "dst")


COUNTED, FREQUENT, MOST_FREQUENT = 1 << 14, 2, 1 << 19  # texts in which shingles are counted, at least; texts from which on one is frequent; frequent ones


def _frequent(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts have and how many, as a sample of them tells: every sixteenth text, or more of fewer texts.

    This sets an order only: what is found doesn't depend on it.
    """
    one_in = min(16, max(1, texts.count() // COUNTED))
    some = texts.where(F.pmod(F.xxhash64("_text"), F.lit(one_in)) == 0).select(F.lit(0).cast("bigint").alias("_at"), "_text")
    counts = shingle_sets(some, words).select(F.explode("shingles").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    top = counts.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).toArrow()
    h, n = top["h"].to_numpy(), top["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order].astype(np.int32)


def _prefix(shingles: np.ndarray, similarity: float, frequent: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """The first of a set's shingles, frequent ones last, as many as make two sets of that resemblance share one of theirs."""
    n = len(shingles)
    if not n:
        return shingles
    last = np.zeros(n, np.int32)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        last = np.where(frequent[at] == shingles, 1 if counts is None else counts[at], 0)
    return shingles[np.lexsort((shingles, last))][: n - math.ceil(similarity * n - 1e-9) + 1]


def _first_of_alike(at: DataFrame) -> DataFrame:
    """(h) of at (h, _at, _of, _place) in more than one component, and of those in the same rows the one with the first places."""
    rows = [F.bit_xor(F.xxhash64("_at", F.lit(k))).alias(f"_x{k}") for k in range(2)]
    of = at.groupBy("h").agg(F.min("_of").alias("_lo"), F.max("_of").alias("_hi"), F.min("_place").alias("_place"), F.count(F.lit(1)).alias("_rows"), *rows)
    first = of.where("_lo < _hi").groupBy("_rows", "_x0", "_x1").agg(F.min(F.struct("_place", "h")).alias("_first"))
    return first.select(F.col("_first.h").alias("h"))


def _not_yet_together(written: DataFrame, numbered: DataFrame, component: DataFrame, similarity: float) -> DataFrame:
    """All pairs (src, dst) of different components that could have the similarity.

    These are the pairs whose first shingles meet, whose sizes and parities allow it and where enough is left of both sets from the
    shingle where they meet: that holds for the first one that both have. Shingles that no other row has go first, with one column
    moved. Of those that the same rows have (told by 128 bits) only the one that comes first in all of them is kept: it is the first
    that any two of these rows have among them. All conditions are the join's own, so it gives only pairs whose sets must be compared.
    """
    rows = written.where("_id IS NOT NULL").select("_at", F.posexplode("prefix").alias("_place", "h"))
    twice = materialize(rows.groupBy("h").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select("h"))
    some = materialize(rows.join(twice, "h"))
    of = component.select(F.col("node").alias("_at"), F.col("component").alias("_of"))
    at = materialize(some.join(numbered.select("_at", "n").join(of, "_at", "left"), "_at").select("h", "_at", F.coalesce("_of", "_at").alias("_of"), "n", "_place"))
    discard(twice, some)
    met = materialize(at.join(_first_of_alike(at), "h").join(numbered.select("_at", "parity"), "_at").select("h", "_at", "_of", "n", "_place", "parity"))
    discard(at)
    a, b = met.toDF("h", "src", "_a", "_m", "_p", "_left"), met.toDF("h", "dst", "_b", "_n", "_q", "_right")
    fits = F.least("_m", "_n") >= F.lit(similarity) * F.greatest("_m", "_n") - 1e-6
    left = F.least(F.col("_m") - F.col("_p"), F.col("_n") - F.col("_q")) >= F.lit(similarity / (1 + similarity)) * (F.col("_m") + F.col("_n")) - 1e-6
    most = (F.col("_m") + F.col("_n") - _words_apart(F.col("_left"), F.col("_right"))) / 2
    near = (F.col("src") < F.col("dst")) & (F.col("_a") != F.col("_b")) & fits & left & (most * (1 + similarity) >= similarity * (F.col("_m") + F.col("_n")) - 1e-6)
    others = materialize(a.join(b, "h").where(near).select("src", "dst").distinct())
    discard(met)
    return others


def _digest(text_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, chunk: int = CHUNK) -> DataFrame:
    """One row per document: id, text_sha256, component_id, by shingles of `words` words with a resemblance of `similarity` or more.

    A radius that wide can't be searched with whole blocks of 64 bits. So fingerprints have 1024 bits here, blocks are sampled
    sets of bits, and those that share a block are compared. Hamming distance estimates the resemblance with a standard
    deviation of about 0.03. So pairs that are far nearer than the similarity asks for link, those far beyond it don't, and
    between groups of linked texts the shingle sets of the closest pair decide. Pairs that this leaves out are looked for after it,
    exactly: sets that resemble each other share one of their first shingles, whatever the order, and all such pairs that
    are not together yet are decided by their sets, but for those that parities of residues of their sets rule out for certain. Nulls, ids, repeated rows and empty
    inputs are treated as in near_groups().
    """

    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), _digest(text_col).alias("text_sha256"), F.col(text_col).alias("_text"))
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(rows.where("_text IS NOT NULL").select("_text"), words))

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for text in part["_text"]:
                hashes = _shingles(text, words)
                shingles = np.unique(np.array(hashes, np.uint64)).view(np.int64)
                found.append((_wide_of(hashes, LANES).tobytes(), len(shingles), np.frombuffer(_parity(shingles), np.int64), _prefix(shingles, similarity, *frequent.value)))
            own = pd.DataFrame(found, columns=["fp", "n", "parity", "prefix"], index=part.index)
            yield pd.concat([part.drop(columns="_text"), own], axis=1)

    written = rows.mapInPandas(batch, "_id bigint, text_sha256 string, fp binary, n bigint, parity array<bigint>, prefix array<bigint>")
    written = materialize(written.withColumn("_at", F.monotonically_increasing_id()))
    prints = written.select("_id", "text_sha256", "fp")
    # an id on several texts stands for several fingerprints, so links are between numbers of these, given as they are written
    first = written.where("_id IS NOT NULL").groupBy("fp").agg(F.min(F.struct("_id", "text_sha256", "_at", "n", "parity")).alias("_m"))
    numbered = materialize(first.select("fp", F.col("_m._id").alias("rep"), "_m.text_sha256", "_m._at", "_m.n", "_m.parity"))
    size = numbered.count()
    drawn = sampled_blocks(size, similarity)
    # few fingerprints fill a file and each gives a row a block, so they are dealt to tasks by the rows that they give
    dealt_to = 1 + size * len(drawn) // KEYED_ROWS
    own = numbered.select("fp", F.col("_at").alias("rep"))
    keyed = own.repartition(dealt_to, "rep").mapInPandas(_keys_of(drawn), "rep bigint, keys array<bigint>")
    keyed = keyed.select("rep", F.posexplode("keys").alias("mask", "key"))
    shared = materialize(keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = materialize(keyed.join(shared, ["mask", "key"]))  # without fingerprints, which most rows don't need
    parts = F.ceil(F.col("n") / chunk).cast("int")
    copied = members.agg(F.coalesce(F.sum(parts), F.lit(0))).first()[0]
    dealt = (
        members.join(own, "rep")
        .withColumn("_p", F.pmod(F.xxhash64("rep"), parts).cast("int"))
        .withColumn("_q", F.explode(F.sequence(F.lit(0), F.greatest(parts - 1, F.lit(0)))))
        .withColumn("unit", F.least("_p", "_q").cast("bigint") * (1 << 31) + F.greatest("_p", "_q"))
        .withColumn("_bin", F.pmod(F.xxhash64("mask", "key", "unit"), F.lit(max(1, copied // GROUP_ROWS) * 8)))
        .select("_bin", "unit", "mask", "key", "rep", "fp")
    )
    links_in = _wide_links_in(bits_apart(similarity, SURE), bits_apart(similarity, DOUBTFUL))
    found = materialize(dealt.groupBy("_bin").applyInPandas(links_in, "src bigint, dst bigint, d bigint").distinct())
    discard(members, shared)
    sure = found.where("d = 0").select("src", "dst")
    joined = connected_components(sure).select("node", "component")
    # between two groups of sure links the closest pair decides
    ends = found.where("d > 0").join(joined.toDF("src", "_a"), "src", "left").join(joined.toDF("dst", "_b"), "dst", "left")
    ends = ends.select("src", "dst", "d", F.coalesce("_a", "src").alias("_a"), F.coalesce("_b", "dst").alias("_b")).where("_a <> _b")
    closest = ends.groupBy(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).agg(F.min(F.struct("d", "src", "dst")).alias("_m"))
    pairs = materialize(_could_resemble(closest.select("_m.src", "_m.dst"), numbered, similarity))

    def texts_of(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("src", "dst")).alias("_at")).distinct()
        wanted = numbered.join(ends, "_at", "left_semi").select(F.col("rep").alias("_id"), "_at", "text_sha256")
        found = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text")).join(wanted, "_id")
        return found.where(_digest("_text") == F.col("text_sha256")).select("_at", "_text").dropDuplicates(["_at"])

    linked = materialize(sure.union(_resembling(pairs, texts_of(pairs), words, similarity)))
    discard(found, pairs)
    others = _not_yet_together(written, numbered, connected_components(linked), similarity)
    component = connected_components(linked.union(_resembling(others, texts_of(others), words, similarity)))
    placed = numbered.join(component, numbered["_at"] == component["node"], "left").select("fp", "rep", F.coalesce("component", "_at").alias("_of"))
    least = materialize(placed.groupBy("_of").agg(F.min("rep").alias("component_id")))
    classes = materialize(placed.join(least, "_of").select("fp", "component_id"))
    groups = materialize(prints.join(classes, "fp", "left").select(F.col("_id").alias(id_col), "text_sha256", "component_id"))
    discard(written, numbered, linked, others, least, classes)
    return groups


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, that come first of their component by id and then by the digest of their text.

    Rows without an id stay. Rows alike in id and text stay or go together.
    """
    key, digest = fresh(docs, "_gone_id"), fresh(docs, "_gone_sha256")
    groups = similar_groups(docs, id_col, text_col, words, similarity).where(F.col(id_col).isNotNull())
    first = groups.groupBy("component_id").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(F.col(id_col).alias("i"), "text_sha256")).alias("_first")).where("_n > 1")
    mine = F.struct(F.col(id_col).alias("i"), "text_sha256")
    gone = groups.join(first, "component_id").where(mine != F.col("_first")).select(F.col(id_col).alias(key), F.col("text_sha256").alias(digest))
    same = (F.col(id_col) == F.col(key)) & (_digest(text_col) == F.col(digest))
    return docs.join(gone, same, "left_anti")
