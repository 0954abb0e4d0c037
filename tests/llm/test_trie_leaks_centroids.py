import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from biowave.llm import centroids, decontaminate, queries, trie
from biowave.llm.common import materialize


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_decontamination", "op13_centroids"])
def test_sql_twins(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def expected_trie(convs):
    """convs: id -> list of (role, text). One row a node, by a walk over all prefixes."""
    members, ends = defaultdict(set), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].add(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, of in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(of) - 1) * len(p[-1][1].encode()) if p else 0
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(of), len(p), min(members[p[:-1]]) if p else -1, len(of), children[p], leaves[p], saved[p], digest(ends[p])) for p, of in members.items()
    )


def nodes_of(found):
    ends = trie.ends_digest(found).withColumnRenamed("conv_id", "node")
    met = found.nodes.join(ends, (F.col("node") == F.col("conv_id")) & (ends["depth"] == found.nodes["depth"]), "left").drop(ends["depth"])
    rows = met.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_bytes", "ends_sha256").collect()
    none = hashlib.sha256(b"").hexdigest()
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:7], r[7] or none) for r in rows)


def test_trie_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "STRETCH", 5)
    rng = random.Random(3)
    rows = []
    for c in range(60):
        n = rng.choice([1, 2, 3, 7, 8, 9, 40])
        rows += [(c, t, rng.choice(["user", "bot"]) if t % 3 else "user", rng.choice("ab") * rng.choice([0, 1, 2])) for t in range(n)]
    rows += [(c, t, "user", f"copied {t}") for c in range(100, 160) for t in range(20)]  # most of the rows are copies of one conversation
    rows += [(200, t, "user", "again") for t in range(700)]  # and a conversation that is a third of them
    rows += [(300, None, "bot", "first"), (300, 1, "user", None), (300, 1, None, "tie"), (300, 1, None, "tie"), (300, 0, "user", "x" * 100_000), (None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("depth", F.lit(5)).withColumn("content", F.lit("own"))
    turns, contents = trie.named_turns(df)
    convs = defaultdict(list)
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs[c].append((role or "", text or ""))
    extra = spark.createDataFrame([(-7,), (999,)], "conv_id bigint")  # conversations without turns end in the root
    found = trie.prefix_trie(turns, turns.select("conv_id").distinct().unionByName(extra))
    assert nodes_of(found) == expected_trie(convs | {-7: [], 999: []})
    names = sorted((r["role"], r["text"], r["content"]) for r in contents.collect())
    assert [n[2] for n in names] == list(range(len(names))), "dense, in the order of role and text"
    met = found.nodes.join(contents, "content").where("conv_id = 300").orderBy("depth").select("role", "text").collect()
    assert [tuple(r) for r in met] == [("bot", "first"), ("user", "x" * 100_000), ("", "tie"), ("", "tie"), ("user", "")]


def test_rebuilt_conversations_by_brute_force(spark, sf_dir):
    import zlib

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    whole = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        whole[r["conv_id"]].append((r["role"] or "", r["text"] or ""))
    rebuilt = {c: (whole.get(c - c % 5, [])[: (h := zlib.crc32(str(c).encode()) % 9)] + turns[h:]) for c, turns in whole.items()}
    got = queries.op11_prefix_trie(spark, sf_dir).collect()
    assert sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in got) == expected_trie(rebuilt)


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    turns, _ = trie.named_turns(df)
    found = trie.prefix_trie(turns, turns.select("conv_id"))
    assert nodes_of(found) == []


def test_dense_names_and_numbers_of_a_hot_key(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7).alias("v"))
    assert sorted(r["name"] for r in trie.dense_names(df, "name").collect()) == list(range(5000))
    hot = spark.range(0, 3000, 1, 5).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("key"), (3000 - F.col("id")).alias("v"))
    got = materialize(trie.numbered(hot, "key", ["v"], "place")).collect()
    by = defaultdict(list)
    for r in got:
        by[r["key"]].append((r["place"], r["v"]))
    for rows in by.values():
        assert [p for p, _ in sorted(rows)] == list(range(1, len(rows) + 1)) and [v for _, v in sorted(rows)] == sorted(v for _, v in rows)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def expected_spans(text, items, window):
    w, hit, seen = words(text), set(), set()
    for item, of in items:
        p = words(of)
        n = min(window, len(p))
        for k in range(len(p) - n + 1 if p else 0):
            for at in range(len(w) - n + 1):
                if w[at : at + n] == p[k : k + n]:
                    hit |= set(range(at, at + n))
                    seen.add(item)
    return len(w), hit, sorted(i for i in seen if i is not None)


@pytest.mark.parametrize(("window", "part_bytes"), [(10, 1 << 25), (4, 1 << 25), (4, 600), (1, 500)])
def test_wu_manber_by_brute_force(spark, window, part_bytes):
    rng = random.Random(window)
    some = ["a", "b", "c", "Ünï", "日本", "x1", "the", "THE", "ß"]
    text = lambda n: rng.choice([" ", "  ", "-", "\n"]).join(rng.choice(some) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 3, 5, 9, 10, 11, 30]))) for k in range(14)] + [(3, text(12)), (None, text(11)), (50, None), (51, ""), (52, "!?"), (53, "unique é word")]
    docs = [(k, text(rng.choice([0, 1, 5, 10, 40, 200]))) for k in range(60)] + [(1, None), (None, text(30)), (1, "x" + (items[5][1] + " . ") * 30), (7, "A Unique É word, UNIQUE é WORD")]
    docs += [(90, "the " * 5000 + (items[12][1])), (2**62 + 1, items[4][1].upper().lower())] * 2
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("words", F.lit(1)).withColumn("_row", F.lit(1))
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumn("window", F.lit(1))
    got = decontaminate.contaminated_spans(d, i, window, part_bytes).collect()
    as_row = lambda doc, n, hit, seen: repr((doc, n, sorted(hit), seen))
    found = [as_row(r["doc_id"], r["n_words"], [x for s in r["spans"] for x in range(s["first"], s["last"] + 1)], r["items"]) for r in got]
    assert sorted(found) == sorted(as_row(doc, *expected_spans(t, items, window)) for doc, t in docs)


def test_skips_most_words():
    looked = []

    class Words(list):
        def __getitem__(self, k):
            looked.append(k)
            return list.__getitem__(self, k)

    patterns = decontaminate.Patterns([(b" ".join(b"p%d" % k for k in range(s, s + 10)), [s]) for s in range(50)])
    assert patterns.search(Words([b"w%d" % k for k in range(9000)])) == ([], [])
    assert len(set(looked)) < 9000 * 0.25


def test_leaks_of_nothing(spark, messy):
    no_items = spark.createDataFrame([], "item_id bigint, text string")
    got = decontaminate.contaminated_spans(messy, no_items).collect()
    assert len(got) == messy.count() and all(r["spans"] == [] and r["items"] == [] for r in got)
    assert decontaminate.contaminated_spans(messy.limit(0), messy.selectExpr("doc_id AS item_id", "text")).count() == 0


def expected_clusters(vectors, k, rounds, key, scale):
    """vectors: (id, components). Python's integers all the way."""
    kept = [(i, v) for i, v in vectors if v is not None and len(v) == 3 and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in kept]
    first = sorted(zip(kept, whole, strict=True), key=lambda p: (key(p[0][0]) is None, key(p[0][0]) or "", p[0][1]))[:k]
    now = [list(w[1]) for _, w in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in whole:
            groups[min(range(len(now)), key=lambda c: (far(v, now[c]), c))].append(v)
        now = [[sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)] if groups[c] else old for c, old in enumerate(now)]
    out = [(i, c := min(range(len(now)), key=lambda c: (far(v, now[c]), c)), far(v, now[c])) for i, v in whole]
    fits = lambda v: v if v < 1 << 63 else None
    spent = [sum(d for _, c, d in out if c == j) for j in range(len(now))]
    return sorted(map(repr, ((i, c, fits(d)) for i, c, d in out))), [(j, list(map(str, c)), fits(s), fits(sum(spent))) for j, (c, s) in enumerate(zip(now, spent, strict=True))]


def by_id(i):
    return None if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest()


@pytest.mark.parametrize(("k", "rounds", "scale", "wide"), [(4, 3, 256, 1), (5, 2, 256, 1e12), (5, 2, 256, 1e30), (6, 2, 256, 1e308), (3, 2, 10, 1), (200, 1, 256, 1)])
def test_centroids_by_brute_force(spark, monkeypatch, k, rounds, scale, wide):
    monkeypatch.setattr(centroids, "BLOCK", 16)
    rng = random.Random(k)
    rows = [(n % 90, [rng.choice([rng.gauss(0, 1), 0.5, -0.25, 1e-300]) * (wide if n % 40 == 0 else 1) for _ in range(3)]) for n in range(150)]
    rows += [(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 2.0]), (5, [1.0, math.nan, 2.0]), (6, [math.inf, 0.0, 0.0]), (None, [0.1, 0.2, 0.3]), (8, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("cluster", F.lit(1)).withColumn("_x", F.lit(1)).withColumn("distance", F.lit(1))
    order = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    found = centroids.cluster(df.repartition(3), k, rounds, order, dim=3, scale=scale)
    want = expected_clusters(rows, k, rounds, by_id, scale)
    assert sorted(repr(tuple(r)) for r in found.assigned.collect()) == want[0]
    assert [(r[0], list(r[1]), r[2], r[3]) for r in found.centroids.orderBy("cluster").collect()] == want[1]


def test_distances_stay_exact_at_the_bounds():
    rng = np.random.default_rng(1)
    for big in (1 << 20, 1 << 22, 1 << 25, 1 << 29, 1 << 40):
        x = rng.integers(-big, big, (20, 64)).astype(np.float64)
        c = rng.integers(-big, big, (7, 64)).astype(object)
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x]
        assert [[int(d) for d in row] for row in centroids.squared_distances(x, c).tolist()] == want


def test_centroids_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id bigint, embedding array<float>")
    found = centroids.cluster(df, 4, 2, F.col("vec_id"))
    assert found.assigned.collect() == [] and found.centroids.collect() == []
    assert centroids.cluster(df.limit(0), 4, 2, F.col("vec_id")).assigned.collect() == []
