import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from biowave.llm import quality, toxicity
from biowave.llm.common import crc32_mod


def rank_quality(rows, label):
    """Area under the ROC curve."""
    s = sorted(rows, key=lambda r: r["score"])
    ranks = {}
    k = 0
    while k < len(s):
        j = k
        while j < len(s) and s[j]["score"] == s[k]["score"]:
            j += 1
        for r in s[k:j]:
            ranks[id(r)] = (k + j + 1) / 2
        k = j
    pos = [r for r in rows if r[label] == 1]
    neg = len(rows) - len(pos)
    return (sum(ranks[id(r)] for r in pos) - len(pos) * (len(pos) + 1) / 2) / (len(pos) * neg)


@pytest.mark.parametrize("module, label, fold, least", [(quality, "quality", 5, 0.97), (toxicity, "toxic", 3, 0.85)])
def test_held_out_accuracy(spark, module, label, fold, least):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = 0 if fold == 5 else 1
    known = docs.join(labels.where(crc32_mod(F.col("doc_id"), fold) == held).select("doc_id"), "doc_id")
    docs = docs.join(labels.select("doc_id"), "doc_id").limit(3000).union(known)
    scored = module.classify(docs.dropDuplicates(["doc_id"]), labels, crc32_mod(F.col("doc_id"), fold) != held)
    rows = scored.join(labels, "doc_id").where(crc32_mod(F.col("doc_id"), fold) == held).collect()
    assert len(rows) > 500 and rank_quality(rows, label) > least


@pytest.mark.parametrize("module", [quality, toxicity])
def test_messy_rows_and_labels(module, messy, labels, empty):
    rows = module.classify(messy, labels, F.lit(True)).collect()
    assert len(rows) == messy.count() and all(0 <= r["score"] <= 1 and math.isfinite(r["score"]) and r["predicted"] in (0, 1) for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[3] == by[4] == by[10]  # null, empty and blank texts are alike
    assert module.classify(messy, labels.limit(0), F.lit(True)).count() == len(rows)
    assert module.classify(empty, labels, F.lit(True)).count() == 0


def test_labels_outside_the_fold_change_nothing(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = crc32_mod(F.col("doc_id"), 3) != 1
    turned = labels.withColumn("toxic", F.when(fold, F.col("toxic")).otherwise(1 - F.col("toxic")))
    one, two = (sorted(map(tuple, toxicity.classify(docs, x, fold).collect())) for x in (labels, turned))
    assert one == two


def test_trees_walk_like_nested_ifs():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] < -0.3)).astype(float)
    trees = quality.fit(x, y, trees=30, depth=3)
    score = trees.score(x)
    assert ((score > 0.5) == y).mean() > 0.95
    for k in range(20):
        total = trees.base
        for root in trees.roots:
            at = root
            while trees.left[at] != at:
                at = trees.left[at] if x[k, trees.feature[at]] <= trees.cut[at] else trees.right[at]
            total += trees.value[at]
        assert score[k] == pytest.approx(1 / (1 + math.exp(-total)))


def brute_kneser_ney(words, order, discount=toxicity.DISCOUNT):
    """p(k, byte, context before it) in plain Python: of the shared chain (k 0), or of the ordinary (1) or toxic model (2)."""
    raw = Counter()
    for w, *n in words:
        w = b"\x02" + w + b"\x03"
        for i in range(1, len(w)):
            for m in range(1, min(order, i + 1) + 1):
                for k in (1, 2):
                    raw[w[i - m + 1 : i + 1], k] += n[k - 1]
    grams = {g for g, _ in raw}

    def n(g, k):
        if k:
            return raw[g, k]
        if len(g) == order or len(g) > 1 and g[:1] == b"\x02":
            return raw[g, 1] + raw[g, 2]
        return len({h for h in grams if len(h) == len(g) + 1 and h[1:] == g})

    def p(k, byte, context):
        after = [(n(g, k), g) for g in grams if g[:-1] == context and len(g) == len(context) + 1]
        total, kinds = sum(c for c, _ in after), sum(c > 0 for c, _ in after)
        lower = p(0, byte, context) if k else p(0, byte, context[1:]) if context else 1 / 256
        if not total:
            return lower
        return max(n(context + bytes([byte]), k) - discount, 0) / total + discount * kinds / total * lower

    return p


def test_kneser_ney_by_brute_force():
    """Ratios are those of models in plain Python, whose probabilities of the next byte sum to one after every context."""
    words = [(b"aba", 3, 0), (b"abc", 1, 2), (b"bc", 2, 0), (b"cab", 0, 1), (b"abca", 0, 1), (b"rare", 1, 0)]
    order = 3
    p = brute_kneser_ney(words, order)
    for context in (b"\x02", b"ab", b"\x02a", b"bc", b"zz", b"ra"):
        for k in range(3):
            assert sum(p(k, byte, context) for byte in range(256)) == pytest.approx(1)
    names, counts = [w for w, *_ in words], np.array([n for _, *n in words], float).T
    models = toxicity.count(toxicity.grams_of(names, *counts, order=order), order=order)
    for word in [*names, b"zzz", b"abcab", b"", b"a", b"rar"]:
        w = b"\x02" + word + b"\x03"
        want = sum(
            math.log(p(2, w[i], w[max(0, i - order + 1) : i])) - math.log(p(1, w[i], w[max(0, i - order + 1) : i])) for i in range(1, len(w))
        )
        assert models.ratios([word])[0] == pytest.approx(want, abs=1e-5), word


def test_drop_toxic_keeps_columns(spark, messy, labels):
    kept = toxicity.drop_toxic(messy, labels, F.lit(True))
    assert kept.schema == messy.schema
    gone = toxicity.classify(messy, labels, F.lit(True)).where("predicted = 1").count()
    assert kept.count() == messy.count() - gone


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "best_fit_packing"]
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf_dir)
        assert after.columns == docs.columns and after.join(kept, "doc_id", "left_anti").count() == 0
        kept = spark.createDataFrame(after.toPandas(), docs.schema)
    texts = [r["text"].lower() for r in kept.collect()]
    assert len(set(texts)) == len(texts)
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in kept.collect()}
