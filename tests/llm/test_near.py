import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from biowave.llm import graph, simhash, vectors


def components(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(3)
    pairs = {
        "path": [(k, k + 1) for k in range(1, 60)], "star": [(500, k) for k in range(100)] + [(7, 900)],
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(120)], "none": [],
    }[kind]
    got = graph.connected_components(spark.createDataFrame([*pairs, (None, 3), (4, None)], "src bigint, dst bigint")).collect()
    nodes = {n for p in pairs for n in p}
    assert {r["node"]: r["component"] for r in got} == components(nodes, pairs)


def slow_print(text, words=4):
    w = text.encode().lower().split()
    w = [x for x in __import__("re").findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())]
    if not w:
        return 0
    sh = [b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints(messy):
    for r in simhash.fingerprints(messy, words=4).collect():
        pass
    for t in ("", None, "one", "A b c", "a b c d", "a  b\nc d e f g h", "Ünï " * 50):
        assert simhash.fingerprint(t) & (2**64 - 1) == slow_print(t or "")


def brute_groups(rows, bits=4):
    prints = [(i, slow_print(t or "")) for i, t in rows]
    ids = {i for i, _ in prints if i is not None}
    pairs = [(a, b) for (a, x), (b, y) in itertools.combinations([p for p in prints if p[0] is not None], 2) if (x ^ y).bit_count() <= bits]
    comp = components(ids, pairs)
    out = []
    for i, x in prints:
        same = [comp[j] for j, y in prints if y == x and j is not None]
        out.append((i, f"{x:016x}", comp[i] if i is not None else (same[0] if same else None)))
    return sorted(map(repr, out))


def near_texts(n, seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    base = [[rng.choice(vocab) for _ in range(220)] for _ in range(6)]
    rows = []
    for k in range(n):
        w = list(base[k % 6])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((k, " ".join(w)))
    return rows + [(n + 1, None), (n + 2, ""), (n + 3, "alone here"), (n + 4, " \n")]


@pytest.mark.parametrize("blocks, chunk", [(None, 2048), (5, 4), (6, 3), (8, 2048)])
def test_near_groups_match_brute_force(spark, blocks, chunk):
    rows = near_texts(90, 5)
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), blocks=blocks, chunk=chunk).collect()
    want = brute_groups(rows)
    assert sorted(repr(tuple(r)) for r in got) == want
    assert len({r["component_id"] for r in got}) < len(rows) - 20  # there is something to link


def test_near_groups_of_messy_rows(messy):
    got = sorted(repr(tuple(r)) for r in simhash.near_groups(messy).collect())
    assert got == brute_groups([(r["doc_id"], r["text"]) for r in messy.collect()])
    kept = simhash.drop_near_copies(messy)
    assert kept.columns == messy.columns and kept.where("doc_id IN (4, 10)").count() == 0 and kept.where("doc_id = 3").count() == 1


def test_empty(spark, empty):
    assert simhash.near_groups(empty).count() == 0 and simhash.drop_near_copies(empty).count() == 0
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_masks_cover_every_near_pair():
    rng = random.Random(1)
    for m in (5, 6, 7, 9):
        masks = simhash.masks_for(m, 4)
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), rng.randrange(5)):
                b ^= 1 << bit
            assert any(a & x & (2**64 - 1) == b & x & (2**64 - 1) for x in masks)


def brute_vectors(rows, cosine=0.98):
    ok = {}
    for k, (i, e, lab) in enumerate(rows):
        v = None if e is None or lab is None or i is None or any(x is None for x in e) else np.array(e, float)
        if v is not None and len(v) and np.isfinite(v).all() and (v != 0).any():
            ok[k] = v
    links = {k: 0 for k in range(len(rows))}
    pairs = []
    for a, b in itertools.combinations(ok, 2):
        x, y = ok[a], ok[b]
        if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= cosine:
            links[a] += 1
            links[b] += 1
            pairs.append((a, b))
    comp = components(range(len(rows)), pairs)
    least = {}
    for k, r in enumerate(rows):
        least[comp[k]] = min((x for x in (r[0], least.get(comp[k])) if x is not None), default=None)
    return sorted(repr((r[0], links[k], least[comp[k]], r[0] == least[comp[k]])) for k, r in enumerate(rows))


@pytest.mark.parametrize("part", [1024, 8, 3])
def test_vectors_match_brute_force(spark, part):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((9, 6))
    rows = []
    for k in range(150):
        v = base[k % 9] + rng.standard_normal(6) * rng.choice([0.0, 0.05, 0.15, 0.6])
        rows.append((k, [float(np.float32(x)) for x in v], int(k % 9 % 2)))
    rows += [(200, None, 1), (201, [0.0] * 6, 1), (202, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (203, [float("nan")] * 6, 0), (204, [float("inf")] * 6, 0)]
    rows += [(205, rows[0][1], None), (206, [1.0, 2.0], 1), (207, [2.0, 4.0], 1), (208, [], 1), (None, rows[1][1], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").select("*", F.lit(1).alias("space"), F.lit(2).alias("rep"), F.lit(3).alias("cell"))
    got = vectors.near_vectors(df, part=part).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_vectors(rows)


def test_vectors_in_many_cells_match_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((25, 5))
    rows = [(k, [float(np.float32(x)) for x in base[k % 25] + rng.standard_normal(5) * rng.choice([0.1, 0.3])], k % 11 % 2) for k in range(700)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = vectors.near_vectors(df, part=40).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_vectors(rows)


def test_repeated_ids_and_doubles(spark):
    rows = [(5, [1.0, 0.0], 0), (5, [0.0, 1.0], 0), (6, [1.0, 0.01], 0), (7, [1.0, 0.02], 0), (5, [0.0, 1.0], 0), (8, [1e300, 0.0], 1), (9, [1e300, 1e298], 1)]
    rows += [(10, [1e-310, 0.0], 1), (11, [0.1, 0.1 + 1e-12], 2), (12, [0.1, 0.1], 2)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    want = {(5, 2, 5): 1, (5, 1, 5): 2, (6, 2, 5): 1, (7, 2, 5): 1, (8, 2, 8): 1, (9, 2, 8): 1, (10, 2, 8): 1, (11, 1, 11): 1, (12, 1, 11): 1}
    found = [(r["vec_id"], r["n_links"], r["component_id"]) for r in got]
    assert {x: found.count(x) for x in found} == want


def test_dense_group_is_counted_whole(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(np.float32(x)) for x in np.r_[1.0, rng.standard_normal(7) * 0.01]], 0) for k in range(200)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"), part=64).collect()
    assert all(r["n_links"] == 199 and r["component_id"] == 0 for r in got)


def resemblance(a, b, words=5):
    sets = [{tuple(t.split()[k : k + words]) for k in range(max(1, len(t.split()) - words + 1))} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize("chunk", [2048, 3])
def test_similar_groups_by_resemblance(spark, chunk):
    rng = random.Random(9)
    rows = [(i, t) for i, t in near_texts(120, 8) if t and len(t) > 40]
    rows += [(500 + k, " ".join(rng.choice(["a", "b", "c", "d", "e"]) + str(rng.randrange(60)) for _ in range(200))) for k in range(40)]  # alone
    got = {r[0]: r[2] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), chunk=chunk).collect()}
    pairs = [(a, b, resemblance(x, y)) for (a, x), (b, y) in itertools.combinations(rows, 2)]
    near = [(a, b) for a, b, s in pairs if s >= 0.85]
    assert len(near) > 300 and sum(got[a] == got[b] for a, b in near) >= 0.99 * len(near)
    close = [(a, b) for a, b, s in pairs if 0.8 <= s < 0.85]
    assert len(close) > 30 and sum(got[a] == got[b] for a, b in close) >= 0.9 * len(close)
    assert all(got[a] != got[b] for a, b, s in pairs if s < 0.3)
    assert all(got[k] == k for k in range(500, 540))
    smallest = {}
    for i, c in got.items():
        smallest[c] = min(i, smallest.get(c, i))
    assert all(c == i for c, i in smallest.items())


def test_similar_groups_of_messy_rows(messy, empty):
    got = sorted((str(r[0]), str(r[2])) for r in simhash.similar_groups(messy).collect())
    assert len(got) == messy.count() and ("4", "3") in got and ("10", "3") in got and ("1", "1") in got and ("2", "1") in got
    assert simhash.similar_groups(empty).count() == 0


def test_more_lanes_begin_with_the_first():
    for t in ("", "a b", "one two three four five six"):
        assert simhash.wide_fingerprint(t, 4, 4)[0] == simhash.fingerprint(t, 4)


@pytest.mark.parametrize("n", [10**4, 10**6])
def test_sampled_blocks_reach_their_recall_at_every_size(n):
    blocks = simhash.sampled_blocks(n, 0.8)
    rng = np.random.default_rng(1)
    p = np.arccos(1.6 / 1.8) / np.pi
    shared = [not (rng.random(64 * simhash.LANES) < p)[blocks].any(axis=1).all() for _ in range(3000)]
    assert abs(np.mean(shared) - simhash.RECALL) < 0.02


def test_near_copies_go_by_row(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(500)]
    text = [rng.choice(words) for _ in range(300)]
    near, other = " ".join([*text[:-1], "new"]), " ".join(rng.choice(words) for _ in range(300))
    text = " ".join(text)
    rows = [(1, text), (5, near), (5, other), (6, other), (6, other), (None, near)]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(repr, kept)) == sorted(map(repr, [r for r in spark.createDataFrame([(1, text), (5, other), (None, near)], "doc_id bigint, text string").collect()]))


def test_no_pair_that_resembles_is_left_out(spark):
    """Pairs just at the resemblance, which share a block of bits or lie within the radius only by chance, all come together."""
    rng = np.random.default_rng(11)
    line = " ".join(f"licence{k}" for k in range(12))  # that all texts have
    rows, wanted = [], []
    for k in range(150):
        words = [f"w{v}" for v in rng.integers(0, 50_000, 88)]
        other = list(words)
        other[20], other[60] = "x", "y"
        rows += [(2 * k, f"{line} {' '.join(words)}"), (2 * k + 1, f"{line} {' '.join(other)}")]
        sets = [set(simhash._shingles(t, 5)) for _, t in rows[-2:]]
        assert 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.82
    got = {r[0]: r[2] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[2 * k] == got[2 * k + 1] == 2 * k for k in range(150))


def test_first_shingles_of_sets_that_resemble_meet():
    rng = np.random.default_rng(12)
    frequent = np.arange(0, 400, 3)
    for n in range(1, 60):
        a = np.sort(rng.choice(400, n, replace=False))
        b = np.unique(np.concatenate([a[rng.random(n) < 0.93], rng.choice(400, n // 12)]))
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            assert len(np.intersect1d(simhash._prefix(a, 0.8, frequent), simhash._prefix(b, 0.8, frequent)))


def test_parities_differ_in_no_more_places_than_sets():
    rng = np.random.default_rng(13)
    for n in (0, 1, 5, 64, 65, 500, 3000):
        for m in (0, 1, 4, 50, 1100, 9000):
            a = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
            b = np.unique(np.r_[a[: rng.integers(0, n + 1)], rng.integers(-(2**63), 2**63 - 1, m)])
            x, y = simhash._parity(a), simhash._parity(b)
            assert simhash._parities_apart(x, y) == simhash._parities_apart(y, x) <= len(np.setxor1d(a, b))
    assert simhash._parities_apart(simhash._parity(a), simhash._parity(a)) == 0


def test_few_sets_are_compared_where_many_texts_share_lines(spark, monkeypatch):
    """Texts made of the same lines meet in their first shingles; only pairs that could resemble each other get their sets."""
    rng = random.Random(14)
    lines = [" ".join(f"w{rng.randrange(5000)}" for _ in range(12)) for _ in range(40)]
    rows = [(k, " ".join(rng.sample(lines, 10))) for k in range(60)]
    for k in range(10):
        words = rows[k][1].split()
        words[30], words[80] = "x", "y"
        rows.append((100 + k, " ".join(words)))
    compared, whole = [], simhash._resembling
    monkeypatch.setattr(simhash, "_resembling", lambda pairs, *rest: compared.append(pairs.count()) or whole(pairs, *rest))
    got = {r[0]: r[2] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    near = [(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if resemblance(x, y) >= 0.8]
    assert len(near) == 10 and got == components([i for i, _ in rows], near)
    assert sum(compared) <= 3 * len(near)


def rows_of_joins(spark, key, run):
    """Rows that joins by this key have made while run() ran, as Spark's metrics tell."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    made, executions = 0, store.executionsList(before, store.executionsCount() - before)
    for k in range(executions.size()):
        of = executions.apply(k).executionId()
        metrics, nodes = store.executionMetrics(of), store.planGraph(of).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if "Join" in node.name() and f"[{key}#" in node.desc():
                for m in (node.metrics().apply(j) for j in range(node.metrics().size())):
                    if m.name() == "number of output rows" and metrics.contains(m.accumulatorId()):
                        made += int(metrics.apply(m.accumulatorId()).replace(",", ""))
    return made


def test_pairs_that_meet_dont_grow_with_the_square_of_a_family(spark):
    """Texts changed in eight places each lie below the resemblance to one another; two of them have a copy just above it."""
    made = {}
    for size in (20, 100):
        rng, rows = random.Random(15), []
        for k in range(size):
            words = [f"line{j}" for j in range(404)]
            for j in rng.sample(range(80), 8):
                words[5 * j] = f"own{k}of{j}"
            rows.append((k, " ".join(words)))
        for k in (3, 7):
            words = rows[k][1].split()
            for j in rng.sample(range(80), 8):
                words[5 * j] = f"copy{k}of{j}"
            rows.append((200 + k, " ".join(words)))
        near = [(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if resemblance(x, y) >= 0.8]
        assert near == [(3, 203), (7, 207)]
        got = {}
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        made[size] = rows_of_joins(spark, "h", lambda: got.update((r[0], r[2]) for r in simhash.similar_groups(docs).collect()))  # noqa: B023
        assert got == components([i for i, _ in rows], near)
    assert 0 < made[100] <= 6 * made[20]


def test_words_apart_are_parities_apart(spark):
    rng = np.random.default_rng(16)
    sets = [(np.unique(rng.integers(-(2**63), 2**63 - 1, n)), np.unique(rng.integers(-(2**63), 2**63 - 1, m))) for n in (1, 60, 65, 130, 700) for m in (n, n + n // 5)]
    pairs = [(simhash._parity(a), simhash._parity(b)) for a, b in sets]
    words = [tuple(np.frombuffer(x, np.int64).tolist() for x in p) for p in pairs]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(words)], "k int, a array<bigint>, b array<bigint>")
    for left, right in (("a", "b"), ("b", "a")):
        got = df.select("k", simhash._words_apart(F.col(left), F.col(right)).alias("n")).orderBy("k").collect()
        assert [r["n"] for r in got] == [simhash._parities_apart(x, y) for x, y in pairs]


def test_of_shingles_that_the_same_rows_have_the_first_is_kept(spark):
    rows = [(11, 1, 1, 0), (11, 2, 2, 3), (12, 1, 1, 4), (12, 2, 2, 5), (13, 1, 1, 6), (13, 2, 2, 6), (13, 3, 1, 0), (14, 1, 1, 9), (14, 3, 1, 9), (15, 2, 2, 1), (15, 3, 1, 2)]
    got = simhash._first_of_alike(spark.createDataFrame(rows, "h bigint, _at bigint, _of bigint, _place int")).collect()
    assert sorted(r["h"] for r in got) == [11, 13, 15]
