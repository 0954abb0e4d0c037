"""Exact dedup by content-defined chunk recipes, with DataFrame operations only.

A text is cut where its content says so (a boundary pattern between a least and a greatest length), so shared passages
give shared chunks wherever they stand. Each distinct chunk is moved once, to verify that its identifier stands for one
content; from then on a document is its recipe, the ordered list of identifiers, and only recipes are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biowave.llm.common import ascii_lower, fresh, materialize

LEAST, GREATEST = 128, 2048


def chunk_pattern(least: int = LEAST, greatest: int = GREATEST) -> str:
    """A chunk ends at the first boundary `least` characters in, or at `greatest`.

    A boundary is a blank between certain letters, or the end of a sentence in scripts without blanks. It is rare (about
    one in 400 characters of prose), so after a change two texts meet at a common boundary again within a chunk or two.
    """
    return rf"(?s).{{{least},{greatest}}}?(?:[nrst.,][ \n](?=[aeio][nrst])|[。！？।])|.{{1,{greatest}}}"


def chunks_of(text: Column, least: int = LEAST, greatest: int = GREATEST) -> Column:
    return F.regexp_extract_all(text, F.lit(chunk_pattern(least, greatest)), F.lit(0))


def _identifier(chunk: Column, bits: int) -> Column:
    """The chunk's 64-bit hash; fewer bits only provoke collisions in tests."""
    return F.xxhash64(chunk) if bits == 64 else F.xxhash64(chunk).bitwiseAND((1 << bits) - 1)


def recipes(docs: DataFrame, id_col: str, text_col: str, bits: int = 64) -> DataFrame:
    """One row per document: its id, the recipe of its normalised text (array of bigint) and the text's SHA-256.

    A null text is the empty one, whose recipe is the empty array. Identifiers are verified: every distinct chunk is
    grouped by identifier, and where one identifier has several contents these get ranks, which become part of the
    recipes that hold them. With 64 bits that set is expected to be empty, and then the second path costs nothing.
    """
    text = ascii_lower(F.col(text_col))
    cut = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_chunks", chunks_of(F.col("_text")))
    plain = cut.select(
        "_id",
        F.transform("_chunks", lambda c: _identifier(c, bits)).alias("recipe"),
        F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"),
    )
    chunk = cut.select(F.explode("_chunks").alias("chunk")).select(_identifier(F.col("chunk"), bits).alias("h"), "chunk")
    distinct = chunk.groupBy("h", "chunk").agg(F.count(F.lit(1)).alias("_n"))
    clashing = materialize(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    if clashing.isEmpty():
        return plain
    # Every content of a clashing identifier gets its rank, which goes into the recipes after the identifier. Rows are
    # numbered for this, since ids may be null or repeat; the numbers are written, so that they stay.
    rows = materialize(cut.withColumn("_row", F.monotonically_increasing_id()))
    chunk = rows.select("_row", F.posexplode("_chunks").alias("pos", "chunk")).withColumn("h", _identifier(F.col("chunk"), bits))
    ranked = (
        chunk.join(clashing, "h", "left_semi").select("h", "chunk").distinct()
        .withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy("chunk")).cast("bigint"))
    )
    lists = chunk.join(ranked, ["h", "chunk"], "left").groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("pos", "h", F.coalesce("rank", F.lit(0)).alias("rank")))).alias("_list")
    )
    recipe = F.flatten(F.transform("_list", lambda x: F.array(x["h"], x["rank"])))
    return rows.join(lists, "_row", "left").select(
        "_id", F.coalesce(recipe, F.array().cast("array<bigint>")).alias("recipe"), F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256")
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest id stays. Null texts
    count as empty and so form one group. Rows that repeat an id each count and each come back; rows with a null id
    group like the others, stay when nothing in the group has an id, and an empty input gives an empty result. Other
    columns of docs, whatever their names, are ignored. Of rows alike in text and id one stays, the last one read.

    The groups are counted with map-side combine and written, so that both sides of the join back are plain exchanges
    whose overfull partitions adaptive execution splits: one text in a third of all rows is not one task.
    """
    parts = materialize(recipes(docs, id_col, text_col, bits).withColumn("_row", F.monotonically_increasing_id()))
    groups = materialize(
        parts.groupBy("recipe").agg(F.max(F.struct("_id", "_row")).alias("_keep"), F.count(F.lit(1)).alias("group_size"))
    )
    return parts.join(groups, "recipe").select(
        F.col("_id").alias(id_col),
        F.col("_keep._id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_keep._row")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that exact_groups() keeps; id and text together tell them.

    Of rows alike in both the one stays whose columns come first as JSON.
    """
    key, digest, alike, place = (fresh(docs, c) for c in ("_kept_id", "_kept_sha256", "_alike", "_place"))
    mine = F.sha2(ascii_lower(F.col(text_col)).cast("binary"), 256)
    found = exact_groups(docs, id_col, text_col).where(F.col(id_col).eqNullSafe(F.col("keep_id")))
    kept = materialize(found.groupBy(F.col(id_col).alias(key), F.col("text_sha256").alias(digest)).agg(F.count(F.lit(1)).alias(alike)))
    same = F.col(id_col).eqNullSafe(F.col(key)) & (mine == F.col(digest))
    if kept.where(F.col(alike) > 1).isEmpty():
        return docs.join(kept, same, "left_semi")
    one = docs.join(kept.where(F.col(alike) == 1), same, "left_semi")
    # the first of rows alike is a partial minimum, so however many there are they are no task of their own
    some = docs.join(kept.where(F.col(alike) > 1), same, "left_semi").groupBy(F.col(id_col).alias(key), mine.alias(digest))
    first = some.agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias(place)).select(f"{place}.*")
    return one.union(first)
