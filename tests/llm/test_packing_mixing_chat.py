import itertools
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from biowave.llm import chat, mixing, packing
from biowave.llm.common import materialize


def exact_ids(text):
    from tokenizers import Tokenizer

    t = exact_ids.__dict__.setdefault("t", Tokenizer.from_file(packing.default_paths()[0]))
    return t.encode(text, add_special_tokens=False).ids


ODD = [
    "", " ", "\n\n  x", "a" * 3000, " " * 2500 + "end", "tabs\t\tand\r\nlines", "I'll don't 'S it's", "<|endoftext|> in a text <|", "Ünï çödé ñ", "日本語 と 한국어 русский",
    "é combining ​ zero", "🙂🙃 emoji", "1234567 12.5 $%^&*", "\x00\x01\x1f\x85\xa0 odd blanks", "A" + " " + "B", "x  y   z ", "ʼn ſ ǆ ȳ",
]


def test_ids_are_those_of_the_tokenizer_file(sf_dir, spark):
    encode = packing.encoder(*packing.default_paths())
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    for t in texts:
        assert list(encode(t)) == exact_ids(t), repr(t[:40])


def check_packing(rows, docs, capacity):
    texts = Counter((d["doc_id"], d["text"] or "") for d in docs)
    total = 0
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        total += r["length"]
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    want = Counter()
    for (doc, text), n in texts.items():
        ids = np.array([*exact_ids(text), 0], "<u4")
        first = len(ids) % capacity or capacity
        cut = [0, *range(first, len(ids), capacity), len(ids)] if len(ids) > capacity else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            if b > a:
                want[(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    return len(by_seq), -(-total // capacity)


def test_packing_is_an_exact_round_trip(messy):
    check_packing(packing.pack(messy, capacity=64, lot_sequences=4).collect(), messy.collect(), 64)


def test_packing_fills_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    n, least = check_packing(packing.pack(docs).collect(), docs.collect(), 2048)
    assert n <= least * 1.01 + 1


def test_sum_of_squares_by_brute_force():
    """Each length goes where a full recount of the squares is smallest, the tightest of equals."""
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 17, 120))[::-1]
    bins, offsets = packing.sum_of_squares(lengths, 16)
    used = {}
    for s, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        gaps = {k: 16 - v for k, v in used.items()}

        def squares(choice, gaps=gaps, s=s):
            return sum(v * v for v in Counter(g - (s if k == choice else 0) for k, g in gaps.items() if g - (s if k == choice else 0)).values())

        fits = [k for k, g in gaps.items() if g >= s]
        if fits:
            best = min((squares(k), gaps[k]) for k in fits)
            assert b in fits and (squares(b), gaps[b]) == best and o == used[b]
        else:
            assert b not in used and o == 0
        used[b] = used.get(b, 0) + s


def test_pfair_deviation_is_below_one_block():
    blocks = {"a": 300, "b": 90, "c": 7, "d": 1}
    weights = {"a": 1.0, "b": 2.0, "c": 0.5}
    table = mixing.timetable(blocks, weights)
    whole = mixing.whole_weights(weights)
    assert Counter(s for s, *_ in table) == Counter(blocks) and [x[2] for x in table] == list(range(len(table)))
    target = [x for x in table if x[5] == "target"]
    left = {s: blocks[s] - sum(x[0] == s for x in target) for s in blocks}
    for part, share in ((target, {s: Fraction(w, mixing.UNIT) for s, w in whole.items()}), (table[len(target) :], {s: Fraction(n, sum(left.values())) for s, n in left.items()})):
        done = Counter()
        for t, (s, _, slot, release, deadline, _) in enumerate(part, 1):
            assert release <= slot < deadline
            done[s] += 1
            assert all(abs(done[x] - w * t) < 1 for x, w in share.items())


def test_mix_places_every_row_once(spark, messy):
    rows = mixing.mix(messy).collect()
    assert sorted(r["position"] for r in rows) == list(range(len(rows))) and len(rows) == messy.count()
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    rows = sorted(mixing.mix(docs, {"hot": 1.0, "s1": 1.0, "none": 3.0}, max_blocks=100).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(5000)) and len({r["doc_id"] for r in rows}) == 5000
    assert {r["source"] for r in rows if r["phase"] == "target"} == {"hot", "s1"}
    order = [(r["slot"], r["block"]) for r in rows]
    assert order == sorted(order, key=lambda x: x[0])


def plain_mix(docs, size):
    """Rows in the order of the mix: each slot goes to the released block with the earliest deadline, found by looking at all sources."""
    import xxhash

    def place(i):
        h = xxhash.xxh64_intdigest(b"mix", xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42))
        return (h - (1 << 64) if h >> 63 else h), i

    ids = defaultdict(list)
    for d in docs:
        ids[d["source"] or ""].append(d["doc_id"])
    ids = {s: sorted(v, key=place) for s, v in ids.items()}
    blocks = {s: [v[k : k + size] for k in range(0, len(v), size)] for s, v in ids.items()}
    weight = {s: Fraction(w, mixing.UNIT) for s, w in mixing.whole_weights({s: len(v) ** 0.5 for s, v in ids.items()}).items()}
    out, done = [], dict.fromkeys(ids, 0)
    for stop in (min(int(len(blocks[s]) / w) for s, w in weight.items()), None):
        if stop is None:  # what is left, in proportion
            left = {s: len(blocks[s]) - done[s] for s in ids if len(blocks[s]) > done[s]}
            weight, stop = {s: Fraction(n, sum(left.values())) for s, n in left.items()}, sum(left.values())
        here = dict.fromkeys(weight, 0)
        for slot in range(stop):
            released = [s for s, w in weight.items() if int(here[s] / w) <= slot]
            s = min(released, key=lambda s: (-int(-(here[s] + 1) / weight[s] // 1), s))
            out += blocks[s][done[s]]
            here[s], done[s] = here[s] + 1, done[s] + 1
    return out


@pytest.mark.parametrize("most", [1 << 15, 40])
def test_mix_matches_brute_force(spark, sf_dir, most):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    docs = docs.union(spark.range(1000, 1500).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.lit("hot"))))
    rows = sorted(mixing.mix(docs, max_blocks=most).collect(), key=lambda r: r["position"])
    assert [r["doc_id"] for r in rows] == plain_mix(docs.collect(), max(1, -(-docs.count() // most)))


def test_mixed_order_keeps_rows(messy, empty):
    out = mixing.in_mixed_order(messy)
    assert out.columns == messy.columns and sorted(map(repr, out.collect())) == sorted(map(repr, messy.collect()))
    assert mixing.in_mixed_order(empty).count() == 0 and mixing.mix(empty).count() == 0 and packing.pack(empty).count() == 0


def test_chat_collapses_snapshots(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", "bye"), ("assistant", None)]
    rows = [(c, t, *talk[t]) for c, n in ((1, 1), (2, 2), (3, 4), (4, 4)) for t in range(n)]
    rows += [(5, 0, "user", "hi"), (5, 1, "assistant", "other"), (6, None, None, "alone"), (6, None, None, "alone"), (None, 0, "user", "nobody"), (7, 0, "", ""), (8, 0, "user", "x" * 50000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").select("*", F.lit(1).alias("k"), F.lit(2).alias("h1"), F.lit(3).alias("n"))
    got = {r["conv_id"]: r for r in chat.render_maximal(df).collect()}
    assert set(got) == {3, 5, 6, 7, 8, None}
    assert got[3]["n_logged"] == 2 and got[3]["n_turns"] == 4 and got[6]["n_turns"] == 1
    assert got[3]["text"] == "".join(f"<|{r}|>\n{t or ''}\n<|end|>\n" for r, t in talk)
    assert chat.render_maximal(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [3, 40])
def test_chat_matches_brute_force(spark, n):
    rng = np.random.default_rng(n)
    talks = [[("user", str(rng.integers(2))) for _ in range(rng.integers(1, 5))] for _ in range(n)]
    rows = [(c, k, *t) for c, talk in enumerate(talks) for k, t in enumerate(talk)]
    got = {(r["conv_id"], r["n_logged"]) for r in chat.render_maximal(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    want = set()
    for c, talk in enumerate(talks):
        if talks.index(talk) == c and not any(len(o) > len(talk) and o[: len(talk)] == talk for o in talks):
            want.add((c, talks.count(talk)))
    assert got == want


@pytest.mark.parametrize("partitions", [1, 7])
def test_lots_follow_the_mix(spark, sf_dir, monkeypatch, partitions):
    whole = packing.pack
    monkeypatch.setattr(packing, "pack", lambda docs, **k: whole(docs, **k, capacity=256, lot_sequences=8))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(partitions)
    mixed = materialize(corpus_pipeline.mix_sources(spark, docs, sf_dir))
    place = {r["doc_id"]: r["position"] for r in mixing.mix(docs).collect()}

    def in_order(rows):
        lots = {}
        for r in rows:
            lots.setdefault(r["sequence_id"] >> 32, []).append(place[r["doc_id"]])
        return len(lots) > 5 and all(max(lots[a]) <= min(lots[b]) for a, b in itertools.pairwise(sorted(lots)))

    got = corpus_pipeline.pack(spark, mixed, sf_dir).collect()
    assert in_order(got)
    plain = corpus_pipeline.pack(spark, materialize(docs), sf_dir).collect()  # the stage left out
    assert not in_order(plain)
    key = lambda rows: sorted((r["doc_id"], r["piece"], r["length"]) for r in rows)
    assert key(got) == key(plain)


def test_rows_alike_fill_no_lot(spark):
    """40,000 rows alike in id and text: as many lots as their tokens ask for, and no lot with far more than its share."""
    df = spark.range(40_000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("one two three four five six seven eight nine ten " * 4).alias("text"))
    rows = packing.pack(df).groupBy((F.col("sequence_id") / (1 << 32)).cast("bigint").alias("lot")).agg(F.sum("length").alias("tokens"), F.count_distinct("sequence_id").alias("n")).collect()
    total = sum(r["tokens"] for r in rows)
    lots = max(1, round(total / 2048 / packing.LOT_SEQUENCES))
    assert lots >= 2 and len(rows) == lots and max(r["tokens"] for r in rows) < 1.2 * total / lots
    each = total // 40_000
    assert sum(r["n"] for r in rows) <= -(-40_000 // (2048 // each)) + lots
