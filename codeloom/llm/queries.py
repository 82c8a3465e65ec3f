"""Queries of the text operators, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import grammar, packing, quality, tokenizer, topn
from codeloom.session import table

CAPACITY = 2048


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return grammar.parse_files(table(spark, d, "source_files"), F.col("file_id"), F.col("repo"), F.col("module_key.id"), F.col("source"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).filter(F.col("verdict").isin("wrong_extension", "corrupt")).select("file_id").distinct()


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    bad = F.col("verdict").isin("wrong_extension", "corrupt").cast("bigint")
    claimed = _parsed(spark, d).filter(F.col("claimed").isNotNull() & (F.col("verdict") != "no_source"))
    return claimed.groupBy("repo", F.col("claimed").alias("language")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(bad).alias("n_invalid"), (F.sum(bad) / F.count(F.lit(1))).alias("invalid_rate")
    )


def p3_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).select("file_id", "claimed", "verdict", "parses_as")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    entries, terms = table(spark, d, "symbol_entries"), table(spark, d, "trie_terms")
    m, zero = F.col("module_key"), F.lit(0)
    module = F.concat(m["module_source_type"].cast("string"), F.lit("|"), m["id"])
    e = topn.top_n(entries, module, F.col("entry_id"), [(F.coalesce("import_count", zero), True), (F.col("symbol_name"), False)], 3)
    score = F.greatest(F.coalesce("value", zero), F.coalesce("highest_child_value_at_or_beneath", zero))
    t = topn.top_n(terms, F.col("prefix"), F.col("term_id"), [(score, True), (F.length("term"), False), (F.col("term"), False)], 3)
    return e.select(F.lit("symbol_entries").alias("group_table"), "group_key", "item_id").unionByName(t.select(F.lit("trie_terms").alias("group_table"), "group_key", "item_id"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, d, "documents"), F.col("doc_id"), F.col("text"))


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose decoded ids are their text, and those that are not (none)."""
    docs = table(spark, d, "documents")
    back = tokenizer.decode_corpus(tokenizer.encode_corpus(docs, F.col("doc_id"), F.col("text"))).select("doc_id", F.xxhash64("text").alias("got"))
    want = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("want"))
    return want.join(back, "doc_id", "full_outer").groupBy((F.col("want").eqNullSafe(F.col("got"))).alias("equal")).agg(F.count(F.lit(1)).alias("n_documents"))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(tokenizer.count_tokens(table(spark, d, "documents"), F.col("doc_id"), F.col("text")), CAPACITY)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers by how full they are, in steps of a sixteenth; 16 is full."""
    fill = p7_pack(spark, d).groupBy("container_id").agg(F.sum("length").alias("tokens"))
    return fill.groupBy(F.floor(F.col("tokens") * 16 / CAPACITY).cast("int").alias("sixteenth")).agg(F.count(F.lit(1)).alias("n_containers"), F.sum("tokens").alias("n_tokens"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return quality.scored_documents(*(table(spark, d, t) for t in ("documents", "doc_labels", "common_words")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(_scored(spark, d)).select("doc_id").distinct()


def p8_stats(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


QUERIES = {"p3_found": p3_found, "p3_rates": p3_rates, "p3_verdicts": p3_verdicts, "p4_found": p4_found, "p6_ids": p6_ids, "p6_roundtrip": p6_roundtrip, "p7_pack": p7_pack, "p7_fill": p7_fill, "p8_found": p8_found, "p8_stats": p8_stats}
ORACLES = {
    "p4_found": """WITH e AS (SELECT DISTINCT entry_id, CAST(module_key.module_source_type AS VARCHAR) || '|' || module_key.id g, symbol_name, coalesce(import_count, 0) c FROM symbol_entries),
        t AS (SELECT DISTINCT term_id, prefix, term, greatest(coalesce(value, 0), coalesce(highest_child_value_at_or_beneath, 0)) c FROM trie_terms)
        SELECT 'symbol_entries' group_table, g group_key, entry_id item_id FROM e QUALIFY row_number() OVER (PARTITION BY g ORDER BY c DESC, symbol_name NULLS LAST, entry_id) <= 3
        UNION ALL
        SELECT 'trie_terms', prefix, term_id FROM t QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY c DESC, length(term) NULLS LAST, term NULLS LAST, term_id) <= 3""",
    "p6_roundtrip": "SELECT true AS equal, count(*) AS n_documents FROM documents",
}
