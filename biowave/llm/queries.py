"""The training-data queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biowave.llm import centroids, chat, decontaminate, exact_dedup, lm, mixing, packing, quality, sharding, simhash, toxicity, trie, vectors
from biowave.llm.common import crc32_mod, materialize, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score(table(spark, sf_dir, "documents"), crc32_mod(F.col("doc_id"), 7) != 2)
    return found.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), words=4, bits=4)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = crc32_mod(F.col("doc_id"), 3)
    found = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold != 1)
    return found.select("doc_id", (fold == 1).alias("held_out"), "score", "predicted")


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_maximal(table(spark, sf_dir, "conversations"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = crc32_mod(F.col("doc_id"), 5)
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold != 0)
    return found.select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")


def _with_shared_openings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt, and their ids: the first h turns of conversation c - c % 5, then c's own after its first h."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    convs = turns.groupBy("conv_id").agg(F.max("depth").alias("_n"))
    convs = convs.select("conv_id", "_n", (F.col("conv_id") - F.col("conv_id") % 5).alias("_base"), h.alias("_h"))
    lengths = convs.select(F.col("conv_id").alias("_base"), F.col("_n").alias("_base_n"))
    convs = materialize(convs.join(lengths, "_base", "left").withColumn("_opening", F.least("_h", F.coalesce("_base_n", F.lit(0).cast("bigint")))))
    first = turns.where("depth <= 8").withColumnRenamed("conv_id", "_base")  # h is 8 at most, and five conversations share a base
    opening = convs.select("conv_id", "_base", "_h").join(first, "_base").where("depth <= _h").select("conv_id", "depth", "content", "bytes")
    own = turns.join(convs.select("conv_id", "_h", "_opening"), "conv_id").where("depth > _h")
    own = own.select("conv_id", (F.col("depth") - F.col("_h") + F.col("_opening")).alias("depth"), "content", "bytes")
    return materialize(opening.unionByName(own)), convs.select("conv_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, _ = trie.named_turns(table(spark, sf_dir, "conversations"))
    found = trie.prefix_trie(*_with_shared_openings(turns))
    return found.nodes.join(trie.ends_digest(found), ["depth", "conv_id"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved_bytes").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)
    items = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    found = centroids.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, order=order)
    last = found.centroids.select(
        "cluster", "cluster_inertia", "inertia", F.sha2(F.array_join("components", ",").cast("binary"), 256).alias("centroid_sha256")
    )
    return found.assigned.join(F.broadcast(last), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # 40 rows


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_sharding, op3_lm_scoring, op4_packing, op5_simhash, op6_toxicity, op7_vectors, op8_chat, op9_mixing, op10_quality,
        op11_prefix_trie, op12_decontamination, op13_centroids,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLE_SQL = {
    "op1_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """,
    "op8_chat": """
        WITH t AS (
            SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations),
        k AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
                   '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS line FROM t),
        c AS (
            SELECT conv_id, count(*) AS n_turns, string_agg(line, '' ORDER BY k) AS text,
                   list(role || chr(31) || text ORDER BY k) AS turns FROM k GROUP BY conv_id),
        w AS (SELECT turns, n_turns, min(text) AS text, min(conv_id) AS conv_id, count(*) AS n_logged FROM c GROUP BY turns, n_turns),
        p AS (SELECT DISTINCT turns[1:i] AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS i FROM w))
        SELECT conv_id, n_turns, n_logged, text FROM w WHERE turns NOT IN (SELECT turns FROM p)
    """,
    "op11_prefix_trie": """
        WITH t AS (
            SELECT conv_id, {role: coalesce(role, ''), text: coalesce(text, '')} AS said,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
            FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, list(said ORDER BY k) AS turns FROM t GROUP BY conv_id),
        ids AS (SELECT DISTINCT conv_id FROM c),
        bytes AS (SELECT conv_id, pos, ascii(substr(conv_id::VARCHAR, pos::INTEGER, 1)) AS b
                  FROM (SELECT conv_id, unnest(range(1, length(conv_id::VARCHAR) + 1)) AS pos FROM ids)),
        crc AS (
            WITH RECURSIVE r(conv_id, pos, bit, v) AS (
                SELECT conv_id, 0::BIGINT, 8, 4294967295::BIGINT FROM ids
                UNION ALL
                SELECT r.conv_id, CASE WHEN r.bit = 8 THEN r.pos + 1 ELSE r.pos END, CASE WHEN r.bit = 8 THEN 1 ELSE r.bit + 1 END,
                       CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END
                FROM (SELECT r.*, CASE WHEN r.bit = 8 THEN xor(r.v, b.b::BIGINT) ELSE r.v END AS y
                      FROM r LEFT JOIN bytes b ON r.bit = 8 AND b.conv_id = r.conv_id AND b.pos = r.pos + 1
                      WHERE r.bit < 8 OR b.b IS NOT NULL) r)
            SELECT conv_id, xor(arg_max(v, pos * 8 + bit), 4294967295) % 9 AS h FROM r GROUP BY conv_id),
        b AS (
            SELECT c.conv_id, list_concat(coalesce(o.turns, [])[1:h], c.turns[h + 1:]) AS turns
            FROM c JOIN crc USING (conv_id) LEFT JOIN c o ON o.conv_id = c.conv_id - c.conv_id % 5),
        p AS (SELECT conv_id, d AS depth, turns[1:d] AS prefix, d = len(turns) AS ended
              FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM b)),
        n AS (
            SELECT min(conv_id) AS conv_id, depth, prefix, count(*) AS n_convs,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends_sha256,
                   CASE WHEN depth = 0 THEN 0 ELSE strlen(prefix[depth].text) END AS size
            FROM p GROUP BY depth, prefix),
        k AS (SELECT n.*, up.conv_id AS parent_conv_id FROM n LEFT JOIN n up ON up.depth = n.depth - 1 AND up.prefix = n.prefix[1:n.depth - 1]),
        f AS (SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS n_children FROM k WHERE depth > 0 GROUP BY 1, 2),
        w AS (SELECT k.*, coalesce(n_children, 0) AS n_children FROM k LEFT JOIN f USING (depth, conv_id)),
        s AS (
            SELECT v.depth, v.prefix, sum((w.n_convs - 1) * w.size) AS saved, count(*) FILTER (WHERE w.n_children = 0) AS n_leaves
            FROM (SELECT w.*, unnest(range(0, depth + 1)) AS up FROM w) w JOIN n v ON v.depth = w.up AND v.prefix = w.prefix[1:w.up]
            GROUP BY v.depth, v.prefix)
        SELECT w.conv_id, w.depth::BIGINT AS depth, w.parent_conv_id, w.n_convs, w.n_children, s.n_leaves,
               s.saved::BIGINT AS saved_tokens, w.ends_sha256
        FROM w JOIN s ON s.depth = w.depth AND s.prefix = w.prefix
    """,
    "op12_decontamination": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        p AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + 9], ' ') AS x
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
        g AS (
            SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS x
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM p))),
        o AS (SELECT r, k, n, item_id FROM g JOIN p USING (n, x)),
        h AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS pos FROM o) GROUP BY r),
        m AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
              FROM (SELECT DISTINCT r, item_id FROM o WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (r) LEFT JOIN m USING (r)
    """,
    "op7_vectors": """
        WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
        c AS (
            SELECT a.vec_id AS x, b.vec_id AS y, list_cosine_similarity(a.v, b.v) AS cos
            FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
        p AS (SELECT x, y FROM c WHERE isfinite(cos) AND cos >= 0.98),
        r(x, root) AS (SELECT vec_id, vec_id FROM e UNION SELECT p.y, r.root FROM r JOIN p ON p.x = r.x),
        m AS (SELECT x, min(root) AS root FROM r GROUP BY x),
        n AS (SELECT x, count(*) AS n FROM p GROUP BY x)
        SELECT vec_id, coalesce(n.n, 0) AS n_links, m.root AS component_id, vec_id = m.root AS kept
        FROM e JOIN m ON m.x = vec_id LEFT JOIN n ON n.x = vec_id
    """,
}


def _centroids_sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds of assignment and exact floors of means, one common table expression each."""
    text = f"""
        WITH e AS (
            SELECT row_number() OVER () AS r, vec_id, [floor(256 * x)::BIGINT for x in embedding::DOUBLE[]] AS v FROM embeddings
            WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64),
        c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR)) - 1 AS c, v FROM e
               ORDER BY sha256('2:' || vec_id::VARCHAR) LIMIT {k})"""
    nearest = """
        a{0} AS (
            SELECT r, e.v, min({{d: list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(e.v, c{0}.v)])::BIGINT, c: c{0}.c}}) AS best
            FROM e, c{0} GROUP BY r, e.v)"""
    for j in range(rounds):
        text += "," + nearest.format(j) + f""",
        m{j} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n
                 FROM (SELECT best.c AS c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{j}) GROUP BY c, i),
        f{j} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM m{j} GROUP BY c),
        c{j + 1} AS (SELECT c, coalesce(f{j}.v, c{j}.v) AS v FROM c{j} LEFT JOIN f{j} USING (c))"""
    text += "," + nearest.format(rounds) + f"""
        SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia,
               sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN e USING (r) JOIN c{rounds} ON c{rounds}.c = best.c
    """
    return text


ORACLE_SQL["op13_centroids"] = _centroids_sql()
