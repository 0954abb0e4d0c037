import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from biowave.llm import lm
from biowave.llm.common import crc32_mod

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(docs, learns, order):
    """The model and scores in plain Python."""
    toks = [WORD.findall((t or "").encode().lower()) for _, t in docs]
    c = Counter(w for t, (i, _) in zip(toks, docs, strict=True) if learns(i) for w in [*t, None])
    total, kinds = sum(c.values()), len(c)
    n1, n2 = (sum(v == k for w, v in c.items() if w is not None) for k in (1, 2))
    disc = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    freq = {w for w, v in c.items() if w is not None}
    grams, hist = Counter(), Counter()
    for t, (i, _) in zip(toks, docs, strict=True):
        if learns(i):
            s = ["<s>", *[w if w in freq else 0 for w in t], "</s>"]
            for k in range(len(s)):
                for n in range(2, order + 1):
                    if k >= n - 1 and all(s[k - n + 1 : k + 1]):
                        grams[tuple(s[k - n + 1 : k + 1])] += 1
    for w in freq:
        hist[(w,)] = c[w]
    hist[("<s>",)] = sum(learns(i) for i, _ in docs)
    for g, v in grams.items():
        hist[g] = v
    arcs, led = Counter(), Counter()
    for g, v in grams.items():
        arcs[g[:-1]] += 1
        led[g[:-1]] += v

    def p(w, s, h):
        if not h:
            return (c[w] - disc) / total if c[w] else (disc * kinds / total if total else 1.0)
        lower = p(w, s, h[1:])
        if h in arcs:
            own = max(grams[(*h, s)] - lm.DISCOUNT, 0) if grams[(*h, s)] else 0
            return own / hist[h] + (lm.DISCOUNT * arcs[h] + hist[h] - led[h]) / hist[h] * lower
        return lower

    out = {}
    for t, (i, _) in zip(toks, docs, strict=True):
        s = ["<s>", *[w if w in freq else 0 for w in t], "</s>"]
        score = 0.0
        for k, w in enumerate([*t, None], 1):
            h = []
            for b in range(1, order):
                if k - b < 0 or not s[k - b]:
                    break
                h.insert(0, s[k - b])
            score += math.log10(p(w, s[k], tuple(h)))
        out[i] = (len(t) + 1, sum(c[w] > 0 for w in [*t, None]), total, sum(math.log10((c[w] + 1) / (total + kinds + 1)) for w in [*t, None]), score)
    sums = []
    for h in [("<s>",), *[(w,) for w in sorted(freq)[:3]], *[g for g in list(grams)[:5] if len(g) < order and g[-1] != "</s>"]]:
        sums.append(sum(p(w, "</s>" if w is None else (w if w in freq else 0), h) for w in [*c, b"never seen"]))
    return out, sums


@pytest.mark.parametrize("order, block, bucket", [(3, 4000, 10**6), (2, 10**9, 10**6), (3, 1, 500), (4, 20_000, 3000)])
def test_scores_match_brute_force(spark, sf_dir, order, block, bucket):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "the the the of the of")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = lm.score(df, crc32_mod(F.col("_id"), 7) != 2, order=order, block_chars=block, bucket_keys=bucket).collect()
    want, sums = brute(rows, lambda i: zlib.crc32(str(i).encode()) % 7 != 2, order)
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, abs=1e-9) and r["score"] == pytest.approx(score, abs=1e-8)
    assert all(s == pytest.approx(1.0, abs=1e-9) for s in sums)  # after every history, the unknown class included


@pytest.mark.parametrize("bucket", [10**6, 300])
def test_every_training_word_makes_states(spark, bucket):
    rows = [(k, f"rare{k} word{k % 50} follows{k} the common {'text of all ' * (k % 3)}") for k in range(1500)]
    rows += [(2000 + k, f"rare{k} word{k % 50} follows{k} the") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    learns = lambda i: i < 1500
    want, _ = brute(rows, learns, 3)
    got = {r["doc_id"]: r for r in lm.score(df, F.col("_id") < 1500, block_chars=3000, bucket_keys=bucket).collect()}
    assert all(got[i]["score"] == pytest.approx(want[i][4], abs=1e-8) and got[i]["n_known"] == want[i][1] for i, _ in rows)


def test_messy_rows_and_no_training(messy):
    rows = lm.score(messy, F.lit(True)).collect()
    assert len(rows) == messy.count() and all(r["score"] <= 0 and math.isfinite(r["score"]) for r in rows)
    none = lm.score(messy, F.lit(False)).collect()
    assert all(r["score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in none)


def test_empty(empty):
    assert lm.score(empty, F.lit(True)).count() == 0


def test_n_grams_gain_on_held_out_texts(spark):
    """Half a decimal digit a token more than the model's own first order, and nearly one more than the base."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lm.score(docs, crc32_mod(F.col("_id"), 7) != 2).where("NOT learnt")
    tokens, score, base = held.agg(F.sum("n_tokens"), F.sum("score"), F.sum("base_score")).first()
    texts = docs.select("doc_id", "text").toPandas()
    toks = [(zlib.crc32(str(i).encode()) % 7 != 2, [*WORD.findall((t or "").encode().lower()), None]) for i, t in texts.itertuples(index=False)]
    c = Counter(w for learn, ws in toks if learn for w in ws)
    n, once, twice = sum(c.values()), sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
    d = once / (once + 2 * twice)
    first = sum(math.log10((c[w] - d) / n if c[w] else d * len(c) / n) for learn, ws in toks if not learn for w in ws)
    assert score / tokens > first / tokens + 0.5 and score / tokens > base / tokens + 0.8


def test_packing_of_numbers():
    import numpy as np

    for ids in ([0, 1, 70000, 2**31, 5], [], [2**64 - 1, 3], list(range(100)), [0] * 50):
        v = np.array(ids, np.uint64)
        assert (lm._unpacked(lm._packed(v)) == v).all() and len(lm._unpacked(lm._packed(v))) == len(v)


def blocks_of(spark, docs, order, block_chars, learns):
    """The blocks of docs with what the rounds tell them, worked out here."""
    import pandas as pd

    df = spark.createDataFrame(docs, "doc_id bigint, text string").select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), learns.alias("_train"))
    blocks = lm.encoded(df.coalesce(1), block_chars).toPandas()
    buckets = [0, *[3] * order]

    def answered(sent):
        return pd.concat([lm._summed(g.copy()) for _, g in sent.groupby(["level", "bucket"])]) if len(sent) else pd.DataFrame(columns=[x.split()[0] for x in lm.SAID.split(", ")])

    said = answered(pd.concat(lm._first_round(buckets)([blocks])))
    for r in range(2, order + 1):
        sent = [lm._next_round(r, order, buckets)(None, blocks[blocks["block"] == b], said[said["block"] == b]) for b in blocks["block"]]
        said = pd.concat([said, answered(pd.concat(sent))])
    return [(row, said[said["block"] == row.block]) for row in blocks.itertuples()]


@pytest.mark.parametrize(("order", "block", "strip"), [(3, 10**9, 256), (3, 400, 5), (4, 900, 7), (2, 500, 3)])
def test_states_and_arcs_by_brute_force(spark, monkeypatch, order, block, strip):
    import random

    import numpy as np

    monkeypatch.setattr(lm, "STRIP", strip)
    rng = random.Random(order)
    docs = [(k, " ".join(rng.choice("aabbbcdefgh") for _ in range(rng.choice([0, 1, 2, 30, 90])))) for k in range(40)]
    train = [f"<s> {t} </s>".split() for k, t in docs if k % 4]
    grams = Counter(tuple(t[i : i + n]) for t in train for n in range(1, order + 1) for i in range(len(t) - n + 1))
    c = {g[0]: n for g, n in grams.items() if len(g) == 1 and g != ("<s>",)}
    total, once, twice = sum(c.values()), *(sum(v == k for w, v in c.items() if w != "</s>") for k in (1, 2))
    discount = once / (once + 2 * twice) if once and twice else 0.5

    def p(h, w):
        if not h:
            return (c[w] - discount) / total if w in c else discount * len(c) / total
        if h not in grams:
            return p(h[1:], w)
        kinds = sum(1 for g in grams if len(g) == len(h) + 1 and g[:-1] == h)
        return max(grams[(*h, w)] - lm.DISCOUNT, 0) / grams[h] + lm.DISCOUNT * kinds / grams[h] * p(h[1:], w)

    longest = lambda words: next((words[k:] for k in range(len(words)) if words[k:] in grams), ())
    arcs = 0
    for row, said in blocks_of(spark, docs, order, block, F.col("_id") % 4 != 0):
        g = lm.Grams(row, order)
        auto = lm.Automaton(g, lm.Known(g, said, order, order - 1), order, {"total": total, "kinds": len(c), "discount": discount})
        texts = {k: f"<s> {t} </s>".split() for k, t in docs}
        names, states, seen = {}, {0: ()}, set()
        places = [(["<s>"] + texts[d][1:], i) for d in row.docs for i in range(1, len(texts[d]))]
        for place, (words, i) in enumerate(places):  # what the numbers of words and states stand for
            names[int(g.at[1][place])] = words[i]
            for k in range(2, order + 1):
                arc = int(auto.by_place[k, place])
                if arc >= 0:
                    history = tuple(words[i - k + 1 : i])
                    assert states.setdefault(int(auto.source[arc]), history) == history and auto.level[auto.source[arc]] == k - 1
        for place, (words, i) in enumerate(places):
            for k in range(1, order + 1):
                history, arc = tuple(words[max(0, i - k + 1) : i]), int(auto.by_place[k, place])
                if len(history) < k - 1:
                    assert arc < 0
                    continue
                assert (arc >= 0) == (k == 1 or (*history, words[i]) in grams)
                if arc >= 0:
                    seen.add(arc)
                    assert names[int(auto.word[arc])] == words[i] and 10 ** auto.gain[arc] == pytest.approx(p(history, words[i]))
                    after = longest((*history, words[i])[-(order - 1) :])
                    assert states.get(int(auto.target[arc]), after) == after and auto.level[auto.target[arc]] == len(after)
        for s, history in states.items():
            if s:
                kinds = sum(1 for x in grams if len(x) == len(history) + 1 and x[:-1] == history)
                assert states.get(int(auto.up[s]), longest(history[1:])) == longest(history[1:]) == history[1:]
                assert 10 ** auto.weight[s] == pytest.approx(lm.DISCOUNT * kinds / grams[history])
        walked = auto.walk(g)
        assert np.allclose(walked, [math.log10(p(longest(tuple(words[max(0, i - order + 1) : i])), words[i])) for words, i in places])
        arcs += len(seen)
    assert arcs > 50
