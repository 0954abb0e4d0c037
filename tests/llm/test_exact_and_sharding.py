import hashlib
import random
import zlib
from collections import defaultdict

import pytest
import xxhash

from biowave.llm import exact_dedup, sharding

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def norm(text):
    return (text or "").translate(LOWER)


def expected_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r["text"])].append(r["doc_id"])
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        last = len(ids) - 1 - ids[::-1].index(keep)  # of rows alike one stays
        out += [(i, keep, len(ids), k == last, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("bits", [64, 2])
def test_groups_match_brute_force(messy, bits):
    got = exact_dedup.exact_groups(messy, bits=bits).collect()
    assert sorted(repr(tuple(r)) for r in got) == expected_groups(messy.collect())


def test_groups_of_real_rows_with_provoked_collisions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = exact_dedup.exact_groups(docs, bits=6).collect()
    assert sorted(repr(tuple(r)) for r in got) == expected_groups(docs.collect())


def test_chunks_rebuild_the_text(spark, messy):
    from pyspark.sql import functions as F

    for r in messy.select("text", F.array_join(exact_dedup.chunks_of(F.coalesce("text", F.lit(""))), "").alias("again")).collect():
        assert (r["text"] or "") == r["again"]


def test_shared_passage_gives_shared_chunks(spark):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    passage = " ".join(rng.choice(["in", "the", "house", "of", "ants", "another", "is", "best", "when", "or", "on", "planets", "rise"]) for _ in range(4000))
    df = spark.createDataFrame([("start of one. " + passage,), ("a quite different start, longer than the other one. " + passage,)], "t string")
    a, b = (set(r[0]) for r in df.select(exact_dedup.chunks_of(F.col("t"))).collect())
    assert len(a & b) > 0.5 * len(a)


def test_drop_keeps_columns_and_one_row(messy):
    kept = exact_dedup.drop_exact_copies(messy)
    assert kept.columns == messy.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12]


def test_empty(empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    assert sharding.shard(empty).count() == 0


def check_shards(rows, docs, shards):
    assert len(rows) == len(docs)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    want = sorted(repr((d["doc_id"], len((d["text"] or "").encode()) + 16, zlib.crc32((d["text"] or "").encode()))) for d in docs)
    assert sorted(repr((r["doc_id"], r["size"], r["text_crc32"])) for r in rows) == want
    return {k: sum(r["size"] for r in part) for k, part in by.items()}


def signed(data, seed=42):
    h = xxhash.xxh64_intdigest(data, seed)
    return h - (1 << 64) if h >> 63 else h


def plain_shards(docs, shards, slack=0.01):
    """Shards by one running sum over all rows in key order, without ranges or splitters."""
    rows = []
    for d in docs:
        i, t = d["doc_id"], (d["text"] or "").encode()
        rows.append((signed(t), 42 if i is None else signed(i.to_bytes(8, "little")), -1 if i is None else i, len(t) + 16, zlib.crc32(t)))
    rows.sort()
    share, group, ends, run = sum(r[3] for r in rows) / shards, defaultdict(int), {}, 0
    for r in rows:
        group[r[0]] += r[3]
        run += r[3]
        ends[r[0]] = run
    out, run, first = [], 0, {}
    for at, (key, _, i, size, crc) in enumerate(rows):
        run += size
        middle = ends[key] - group[key] / 2 if group[key] <= slack * share else run - size / 2
        k = min(int(middle // share), shards - 1)
        out.append((i, size, crc, k, at - first.setdefault(k, at)))
    return sorted(out)


def plain_columns(rows):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in rows)


def test_shards_of_messy_rows(messy):
    rows = sharding.shard(messy, shards=3).collect()
    check_shards(rows, messy.collect(), 3)
    assert plain_columns(rows) == plain_shards(messy.collect(), 3)


@pytest.mark.parametrize("partitions", [1, 7])
def test_shards_by_splitters_match_brute_force(spark, sf_dir, partitions):
    from pyspark.sql import functions as F

    # groups of one to four equal texts, over enough rows for splitters, and the driver's own documents
    text = F.repeat(F.concat(F.lit("t"), F.floor(F.col("id") / (1 + F.col("id") % 4)).cast("string")), (1 + F.col("id") % 9).cast("int"))
    df = spark.range(6000).select(F.col("id").alias("doc_id"), text.alias("text")).repartition(partitions)
    assert plain_columns(sharding.shard(df, shards=10).collect()) == plain_shards(df.collect(), 10)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert plain_columns(sharding.shard(docs).collect()) == plain_shards(docs.collect(), 40)


def test_shards_are_even_with_a_hot_text(spark):
    from pyspark.sql import functions as F

    df = spark.range(9000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same text")).otherwise(F.repeat(F.col("id").cast("string"), (F.col("id") % 40).cast("int"))).alias("text")
    )
    sizes = check_shards(sharding.shard(df, shards=10).collect(), df.collect(), 10)
    mean = sum(sizes.values()) / 10
    assert len(sizes) == 10 and max(abs(s - mean) for s in sizes.values()) < 0.03 * mean


def test_small_groups_stay_whole(spark):
    from pyspark.sql import functions as F

    df = spark.range(8000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 2000).cast("string")).alias("text"))
    rows = sharding.shard(df, shards=10).collect()
    where = defaultdict(set)
    for r in rows:
        where[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_splitters_cut_hot_keys_only():
    sample = [(5, s) for s in range(100)] + [(k, 0) for k in range(10, 60)]
    at = sharding._splitters(sample, 10)
    assert sum(k == 5 for k, _ in at) > 5
    assert all(s == sharding.LOW for k, s in at if k != 5)


def test_one_of_many_rows_alike_stays(spark):
    """A third of the table is one row again and again; another differs in a column that the operator ignores."""
    from pyspark.sql import functions as F

    many = spark.range(3000).select(F.lit(5).cast("bigint").alias("doc_id"), F.lit("again and again").alias("text"), F.lit("a").alias("source"))
    other = spark.createDataFrame([(5, "Again AND again", "b"), (4, "again and again", "a"), (9, None, "c"), (9, "", "c")], "doc_id bigint, text string, source string")
    alone = spark.range(100, 300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("a").alias("source"))
    kept = exact_dedup.drop_exact_copies(many.unionByName(other).unionByName(alone))
    assert kept.columns == ["doc_id", "text", "source"] and kept.count() == 202
    assert [tuple(r) for r in kept.where("doc_id = 5").collect()] == [(5, "Again AND again", "b")]  # the first as JSON
    assert kept.where("doc_id = 9").count() == 1 and kept.where("doc_id = 4").isEmpty()
