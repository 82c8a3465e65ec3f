"""Queries over terms and prefix trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import terms
from codeloom.session import table


def _names(spark: SparkSession, d: str) -> DataFrame:
    return terms.counted(terms.tokens(table(spark, d, "documents"), F.col("text")))


def _adds(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "trie_terms").dropDuplicates(["term_id"]).filter("term IS NOT NULL")
    return once.select("term_id", "seq", "term", F.coalesce("value", F.lit(0)).alias("value"), F.coalesce("end_point", F.lit(True)).alias("add_value"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return _adds(spark, d).groupBy("term").agg(F.sum("value").alias("value"))


def name_counts(spark, d):
    return _names(spark, d)


def name_counts_top(spark, d):
    return _names(spark, d).orderBy(F.desc("value"), "term").limit(100)


def prefix_top1(spark, d):
    return terms.best_under(_names(spark, d), "th")


def prefix_top1_all(spark, d):
    return terms.best_by_prefix(_names(spark, d))


def prefix_top1_terms(spark, d):
    return terms.best_by_prefix(_terms(spark, d))


def prefix_max_value(spark, d):
    wanted = table(spark, d, "common_words").select(F.col("word").alias("prefix"))
    return terms.max_under(_names(spark, d), wanted)


def prefix_prune(spark, d):
    return terms.pruned(_names(spark, d), 50)


def prefix_remove_subtree(spark, d):
    return terms.without_subtree(_terms(spark, d), "core.")


def prefix_remove_node(spark, d):
    return terms.without_term(_names(spark, d), "the")


def prefix_enumerate(spark, d):
    return terms.under(_terms(spark, d), "cfg.")


def trie_accumulate(spark, d):
    return terms.accumulated(_adds(spark, d).select(F.struct("seq", "term_id").alias("seq"), "term", "value", "add_value"))


def trie_tree(spark, d):
    return terms.tree(_terms(spark, d))


def dir_children(spark, d):
    return terms.children(table(spark, d, "file_listing"), "/srv/code/")


def subsequence_search(spark, d):
    return terms.subsequence_lines(table(spark, d, "documents"), F.col("text"), "thz")


QUERIES = {
    f.__name__: f
    for f in (name_counts, name_counts_top, prefix_top1, prefix_top1_all, prefix_top1_terms, prefix_max_value, prefix_prune, prefix_remove_subtree, prefix_remove_node, prefix_enumerate, trie_accumulate, trie_tree, dir_children, subsequence_search)
}

_TOKENS = "tokens AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) term FROM documents), names AS (SELECT term, count(*) AS value FROM tokens GROUP BY term)"
_ADDS = "adds AS (SELECT DISTINCT ON (term_id) term_id, seq, term, coalesce(value, 0) AS value, coalesce(end_point, true) AS add_value FROM trie_terms WHERE term IS NOT NULL)"
_TERMS = f"{_ADDS}, terms AS (SELECT term, CAST(sum(value) AS BIGINT) AS value FROM adds GROUP BY term)"

ORACLES = {
    "name_counts": f"WITH {_TOKENS} SELECT * FROM names",
    "name_counts_top": f"WITH {_TOKENS} SELECT * FROM names ORDER BY value DESC, term LIMIT 100",
    "prefix_top1": f"WITH {_TOKENS} SELECT * FROM names WHERE starts_with(term, 'th') ORDER BY value DESC, length(term), term LIMIT 1",
    "prefix_top1_all": f"WITH {_TOKENS}, p AS (SELECT term[1:n] AS prefix, term, value FROM (SELECT *, unnest(range(1, length(term) + 1)) AS n FROM names)) SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY value DESC, length(term), term) = 1",
    "prefix_top1_terms": f"WITH {_TERMS}, p AS (SELECT term[1:n] AS prefix, term, value FROM (SELECT *, unnest(range(1, length(term) + 1)) AS n FROM terms)) SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY value DESC, length(term), term) = 1",
    "prefix_max_value": f"WITH {_TOKENS}, wanted AS (SELECT DISTINCT word AS prefix FROM common_words) SELECT prefix, coalesce(max(value), 0) AS value FROM wanted LEFT JOIN names ON starts_with(term, prefix) GROUP BY prefix",
    "prefix_prune": f"WITH {_TOKENS} SELECT * FROM names WHERE value >= 50",
    "prefix_remove_subtree": f"WITH {_TERMS} SELECT * FROM terms WHERE NOT starts_with(term, 'core.')",
    "prefix_remove_node": f"WITH {_TOKENS} SELECT * FROM names WHERE term <> 'the'",
    "prefix_enumerate": f"WITH {_TERMS} SELECT * FROM terms WHERE starts_with(term, 'cfg.')",
    "trie_accumulate": f"""WITH {_ADDS}, n AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY seq, term_id) i FROM adds), r AS (SELECT term, max(i) FILTER (NOT add_value) reset FROM n GROUP BY term)
        SELECT term, CAST(sum(value) AS BIGINT) AS value FROM n JOIN r USING (term) WHERE reset IS NULL OR i >= reset GROUP BY term""",
    "trie_tree": f"""WITH {_TERMS}, p AS (SELECT term[1:n] AS prefix, term, value FROM (SELECT *, unnest(range(1, length(term) + 1)) AS n FROM terms)),
        best AS (SELECT prefix, term FROM p QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY value DESC, length(term), term) = 1)
        SELECT prefix, bool_or(p.term = prefix) AS end_point, max(CASE WHEN p.term = prefix THEN value END) AS value, max(value) AS highest, nullif(any_value(best.term)[length(prefix) + 1:length(prefix) + 1], '') AS child_char
        FROM p JOIN best USING (prefix) GROUP BY prefix""",
    "dir_children": "SELECT split_part(path[11:], '/', 1) AS name, bool_or(contains(path[11:], '/')) AS is_dir FROM file_listing WHERE starts_with(path, '/srv/code/') AND length(path) > 10 GROUP BY 1",
    "subsequence_search": "SELECT line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(line, '^[^t]*t[^h]*h[^z]*z')",
}
