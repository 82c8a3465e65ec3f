"""Terms with values, and the questions a prefix tree answers, asked of a flat table (term, value)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"


def tokens(rows: DataFrame, text: Column, pattern: str = IDENTIFIER) -> DataFrame:
    """term: one row for each match of the pattern in each text; null texts have none."""
    return rows.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("term"))


def counted(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("value"))


def accumulated(adds: DataFrame) -> DataFrame:
    """term, value of the rows seq, term, value, add_value: with add_value a value is added to what the term has, without it
    replaces it. The rows of a term are taken in the order of seq."""
    reset = adds.groupBy("term").agg(F.max(F.when(~F.col("add_value"), F.col("seq"))).alias("reset_seq"))
    return (
        adds.join(reset, "term").filter(F.col("reset_seq").isNull() | (F.col("seq") >= F.col("reset_seq"))).groupBy("term").agg(F.sum("value").alias("value"))
    )


def prefixes(terms: DataFrame) -> DataFrame:
    """prefix, rest, value for every way to cut each term in two, the prefix not empty. The empty term has none."""
    n = F.explode(F.when(F.length("term") > 0, F.sequence(F.lit(1), F.length("term"))).otherwise(F.array())).alias("n")
    return terms.select("term", "value", n).select(F.expr("substring(term, 1, n)").alias("prefix"), F.expr("substring(term, n + 1)").alias("rest"), "value")


def _best() -> Column:
    """The order in which terms under a prefix are better: value, then the shorter, then the smaller term. Under one prefix, rests
    compare as their terms do and are less to carry."""
    return F.struct((-F.col("value")).alias("v"), F.length("rest").alias("n"), "rest")


def best_by_prefix(terms: DataFrame) -> DataFrame:
    """prefix, term, value: the best term under every prefix there is. A minimum, so combined on the map side."""
    best = prefixes(terms).groupBy("prefix").agg(F.min(_best()).alias("b"))
    return best.select("prefix", F.concat("prefix", "b.rest").alias("term"), (-F.col("b.v")).alias("value"))


def best_under(terms: DataFrame, prefix: str) -> DataFrame:
    """The best term under one prefix; no row for an unknown prefix."""
    under = terms.filter(F.col("term").startswith(prefix))
    return under.orderBy(F.desc("value"), F.length("term"), "term").limit(1).select("term", "value")


def max_under(terms: DataFrame, wanted: DataFrame) -> DataFrame:
    """prefix, value: the largest value under each wanted prefix, 0 where nothing is under it. Terms are cut to the lengths that are
    wanted, of which there are at most as many as the longest wanted prefix has characters."""
    asked = wanted.select("prefix").filter("prefix IS NOT NULL").distinct()
    lengths = sorted(r["n"] for r in asked.select(F.length("prefix").alias("n")).distinct().collect())
    cut = terms.select("term", "value", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("n")).filter(F.col("n") <= F.length("term"))
    known = cut.groupBy(F.expr("substring(term, 1, n)").alias("prefix")).agg(F.max("value").alias("value"))
    return asked.join(known, "prefix", "left").select("prefix", F.coalesce("value", F.lit(0)).alias("value"))


def pruned(terms: DataFrame, least: int) -> DataFrame:
    return terms.filter(F.col("value") >= least)


def without_subtree(terms: DataFrame, prefix: str) -> DataFrame:
    return terms.filter(~F.col("term").startswith(prefix))


def without_term(terms: DataFrame, term: str) -> DataFrame:
    return terms.filter(F.col("term") != term)


def under(terms: DataFrame, prefix: str) -> DataFrame:
    return terms.filter(F.col("term").startswith(prefix))


def children(paths: DataFrame, directory: str) -> DataFrame:
    """name, is_dir of what lies directly in a directory (which ends in a slash)."""
    rest = F.expr(f"substring(path, {len(directory) + 1})")
    return (
        paths.filter(F.col("path").startswith(directory) & (F.length("path") > len(directory)))
        .select(F.substring_index(rest, "/", 1).alias("name"), (F.instr(rest, "/") > 0).alias("is_dir"))
        .groupBy("name").agg(F.max("is_dir").alias("is_dir"))
    )


def tree(terms: DataFrame) -> DataFrame:
    """The prefix tree as rows: prefix, end_point (a term ends here), value of that term, highest value at or beneath, and the
    next character towards it (null where the best term ends). Every term has its end in it."""
    at_end = F.col("rest") == ""
    nodes = prefixes(terms).groupBy("prefix").agg(
        F.max(at_end).alias("end_point"), F.max(F.when(at_end, F.col("value"))).alias("value"), F.max("value").alias("highest"), F.min(_best()).alias("b")
    )
    step = F.expr("substring(b.rest, 1, 1)")
    return nodes.select("prefix", "end_point", "value", "highest", F.when(step != "", step).alias("child_char"))


def subsequence_lines(rows: DataFrame, text: Column, letters: str) -> DataFrame:
    """line: the lines that hold the letters in this order with anything between. The pattern is linear in the line's length."""
    steps = "".join(f"[^{re.escape(c)}]*{re.escape(c)}" for c in letters)
    return rows.select(F.explode(F.split(text, "\n")).alias("line")).filter(F.col("line").rlike(f"^{steps}"))
