"""Per-document text statistics, and the documents that are not natural prose.

1. One pass computes the statistics of each document. One of them, the share of its lines that are running text, comes from
   a small line classifier: a plain rule on the marks of a line, which a model fitted on labelled documents replaces the
   more, the more labels there are.
2. Each statistic gets a mergeable quantile sketch per language, over the documents that are running text for the most part, and one
   over all languages. A language's quartiles are drawn towards those of all languages, the more, the fewer documents it has.
3. Values become robust z-scores: distance from the median of the language in spreads of the middle half. A document is flagged, and
   found, if its score for running lines lies in the lower tail, which begins where one half lies among the documents of
   all languages. Tails of the other statistics are named beside it.

As the sketches are over running text, how common lists, tables or junk are changes neither medians nor spreads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import textstats
from codeloom.session import ship, spread, written

#: Bounds of the labelled sample the classifier is fitted on: documents, characters of all, and of one.
MAX_LABELLED = 2000
MAX_LABELLED_CHARS = 16 << 20
MAX_LABELLED_TEXT = 1 << 18
#: The model counts as much as the plain rule where so many documents of the rarer kind, prose or other, are labelled; its weight to the
#: rule's is as the squares of their number and this.
TRUST = 30
#: Common words are a fixed table; a larger one is refused.
MAX_COMMON = 100_000
#: Texts are looked at in pieces of about so many characters, whole documents each.
CHUNK_CHARS = 1 << 20
#: Values so many spreads from the median are named as tails.
TAIL_Z = 3.0
#: Documents of which at least this share of the lines runs are what the sketches are over; where it lies, the tail begins.
HALF = 0.5
#: A language of so many documents weighs as much in its quartiles as all languages do.
SHRINK = 200
#: Relative error of the sketches' ranks is 1 over this.
ACCURACY = 1000

SKETCHED = ["mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "running_lines"]
SCHEMA = "doc_id bigint, lang_no int, n_lines bigint, n_words bigint, mean_word_length double, symbol_ratio double, punctuated_lines double, common_words double, running_lines double"


class LineModel:
    """Probability that a line is running text: standardised features, one hidden layer, fitted by Adam with a fixed seed."""

    def __init__(self, known: np.ndarray, mean: np.ndarray, spread: np.ndarray, weights: list[np.ndarray]):
        self.known, self.mean, self.spread, self.weights = known, mean, spread, weights

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = np.clip((features - self.mean) / self.spread, -5, 5)
        a, b, c, d = self.weights
        return 1 / (1 + np.exp(-(np.tanh(z @ a + b) @ c + d[0])))


class PlainRule:
    """A line is running text if it is mostly words, is no item or row of a table by its marks, goes over into the next line or comes from
    the one before, and its document uses common words. Lines that begin like a line beside them, or end in a number, are
    not running where many lines of the document do so."""

    #: Which share of a document's lines is many.
    MANY = 0.3

    def running(self, x: textstats.Lines) -> np.ndarray:
        if not len(x.words):
            return np.zeros(0, bool)
        w, props, n_lines = textstats.W, x.props[x.code], np.maximum(np.diff(x.doc_starts), 1)
        share = x.sum_words(props) / x.words[:, None]
        first, last = props[x.starts], props[x.ends - 1]
        words = (x.words >= 2) & (share[:, w["alpha"]] >= 0.6) & (share[:, w["leader"]] == 0) & (share[:, w["single"]] < 0.4) & (share[:, w["vowelless"]] < 0.3)
        marked = (share[:, w["repeated"]] > 0) | (first[:, w["bullet"]] > 0) | (first[:, w["punct"]] > 0)
        capitals = (x.sum_lines(share[:, w["upper"]]) / n_lines > 0.5)[x.doc]
        goes_on = np.append(np.where(capitals[:-1], first[1:, w["alpha"]], first[1:, w["lower"]]) > 0, False)
        same_doc = np.append(x.doc[1:] == x.doc[:-1], False)
        flows = same_doc & (last[:, w["terminal"]] == 0) & goes_on
        begin = x.hash[x.code][x.starts]
        alike = same_doc & np.append((begin[1:] == begin[:-1]) & (first[1:, w["alpha"]] > 0), False)
        for like in (alike | np.insert(alike[:-1], 0, False), last[:, w["numeric"]] > 0):
            marked |= like & (x.sum_lines(like.astype(np.float64)) / n_lines > self.MANY)[x.doc]
        out = words & ~marked & (flows | np.insert(flows[:-1], 0, False))
        if x.by_lang.shape[1]:
            of_lang = x.sum_lines(x.sum_words(x.by_lang[x.code]).max(axis=1)) / np.maximum(x.sum_lines(x.words.astype(np.float64)), 1)
            out &= (of_lang > 0.12)[x.doc]
        return out


class Lines:
    """Rule and model together. weight: how much the model counts, from 0 (no labels of one of the kinds) towards 1."""

    def __init__(self, model: LineModel | None, weight: float):
        self.rule, self.model, self.weight = PlainRule(), model, weight

    def running(self, x: textstats.Lines) -> np.ndarray:
        by_rule = self.rule.running(x)
        if self.model is None:
            return by_rule
        by_model = self.model.probability(textstats.line_features(x, self.model.known))
        return (1 - self.weight) * np.where(by_rule, 0.9, 0.1) + self.weight * by_model > 0.5


def fit_lines(texts: list[str], prose: list[bool], common: dict[str, frozenset[str]], hidden: int = 16, steps: int = 2000, batch: int = 256, rate: float = 3e-3, decay: float = 1e-3) -> Lines:
    """Every line of a labelled document counts as its document's kind; documents that are one kind mostly outweigh the mixed."""
    x, good = textstats.Lines(pa.array(texts, pa.string()), common), np.array(prose, bool)
    rarer = int(min(good.sum(), (~good).sum()))
    if not rarer or not len(x.words):
        return Lines(None, 0.0)
    pair, _ = textstats.pair_codes(x)
    doc = x.doc[x.line_of_word]
    of_prose = good[doc] & (pair >= 0)
    known = np.zeros(1 << textstats.HASH_BITS, np.int32)
    np.add.at(known, np.unique(np.column_stack([doc[of_prose], pair[of_prose]]), axis=0)[:, 1], 1)
    # a running text does not vouch for its own pairs
    features = np.where(good[x.doc][:, None], textstats.line_features(x, (known > 1).astype(np.int32)), textstats.line_features(x, known))
    target = good[x.doc].astype(np.float32)
    mean, spread = features.mean(axis=0), features.std(axis=0) + 1e-2
    z = np.clip((features - mean) / spread, -5, 5)
    weight = 1 / np.sqrt(np.diff(x.doc_starts)[x.doc])
    for kind in (0, 1):
        weight[target == kind] /= max(weight[target == kind].sum(), 1e-9)
    weight /= weight.mean()
    rng = np.random.default_rng(0)
    w = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(z), batch)
        h = np.tanh(z[pick] @ w[0] + w[1])
        off = (1 / (1 + np.exp(-(h @ w[2] + w[3][0]))) - target[pick]) * weight[pick] / batch
        back = np.outer(off, w[2]) * (1 - h * h)
        grad = [z[pick].T @ back + decay * w[0], back.sum(axis=0), h.T @ off + decay * w[2], np.array([off.sum()])]
        for k, g in enumerate(grad):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model = LineModel((known > 0).astype(np.int8), mean.astype(np.float32), spread.astype(np.float32), [p.astype(np.float32) for p in w])
    return Lines(model, rarer**2 / (rarer**2 + TRUST**2))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[bool]]:
    """Texts and whether they are prose, of up to MAX_LABELLED documents whose readers agree, chosen by the hash of their id."""
    agreed = (
        labels.filter(F.col("kind").isNotNull()).groupBy("doc_id").agg(F.min("kind").alias("kind"), F.max("kind").alias("other"))
        .filter("kind = other").select("doc_id", (F.col("kind") == "prose").alias("prose"))
    )
    chosen = agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)  # at most MAX_LABELLED rows
    of = docs.select("doc_id", "text", F.length("text").alias("n")).filter(F.col("n") <= MAX_LABELLED_TEXT)
    sizes = of.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("n").alias("n"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect()
    upto = np.cumsum([r["n"] for r in sizes])
    ids = [r["doc_id"] for r, end in zip(sizes, upto, strict=True) if end <= MAX_LABELLED_CHARS]
    few = chosen.filter(F.col("doc_id").isin(ids)) if ids else chosen.limit(0)
    texts = of.join(F.broadcast(few), "doc_id").groupBy("doc_id", "prose").agg(F.max("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = texts.collect()  # at most MAX_LABELLED_CHARS characters
    return [r["text"] for r in rows], [r["prose"] for r in rows]


def common_by_language(common: DataFrame) -> dict[str, frozenset[str]]:
    rows = common.filter("lang IS NOT NULL AND word IS NOT NULL").select("lang", "word").distinct().limit(MAX_COMMON + 1).collect()
    if len(rows) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} common words")
    out: dict[str, set[str]] = {}
    for r in sorted(rows):
        out.setdefault(r["lang"], set()).add(textstats.fold(r["word"]))
    return {k: frozenset(v) for k, v in sorted(out.items())}


def _stats(model: Lines, common: dict[str, frozenset[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = np.cumsum(b["n"].fill_null(0).to_numpy(zero_copy_only=False))
            at = 0
            while at < b.num_rows:
                upto = int(np.searchsorted(length, (length[at - 1] if at else 0) + CHUNK_CHARS, "right"))
                part = b.slice(at, max(upto - at, 1))
                at += part.num_rows
                x = textstats.Lines(part["text"], common)
                s = textstats.document_stats(x)
                running = x.sum_lines(model.running(x).astype(np.float64)) / np.maximum(s["n_lines"], 1)
                cols = [part["doc_id"], pa.array(s["lang_no"]), *(pa.array(s[c]) for c in textstats.STATS), pa.array(running)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_no", *textstats.STATS, "running_lines"])

    return run


def document_statistics(docs: DataFrame, labels: DataFrame, common: DataFrame) -> DataFrame:
    """The statistics of every row of docs (doc_id, text). Null, empty and blank texts have no lines and zeros. lang is the
    language whose common words the text has most of, null if it has none of any. Other columns are ignored."""
    ship(docs.sparkSession)
    words = common_by_language(common)
    model = fit_lines(*labelled_sample(docs, labels), words)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.length("text").cast("bigint").alias("n"))
    lang = F.lit(None).cast("string")
    for n, name in enumerate(words):
        lang = F.when(F.col("lang_no") == n, name).otherwise(lang)
    return spread(rows).mapInArrow(_stats(model, words), SCHEMA).withColumn("lang", lang).drop("lang_no")


def language_sketches(stats: DataFrame) -> DataFrame:
    """Quartiles of every statistic by lang, and over all languages in a row whose lang is '', of the documents that are running text for
    the most part. There is one row for each language of the common words."""
    quartiles = [F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(ACCURACY)).alias(c) for c in SKETCHED]
    natural = stats.filter((F.col("n_lines") > 0) & (F.col("running_lines") >= HALF))
    each = natural.filter("lang IS NOT NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), *quartiles)
    return each.unionByName(natural.agg(F.count(F.lit(1)).alias("n_docs"), *quartiles).select(F.lit("").alias("lang"), "n_docs", *SKETCHED))


def _centre(quartiles: list[float]) -> tuple[float, float]:
    """Median and spread; a spread of zero counts as one hundredth."""
    return quartiles[1], max((quartiles[2] - quartiles[0]) / 1.349, 0.01)


def robust_scores(stats: DataFrame) -> DataFrame:
    """stats with a z-score for each sketched statistic (z_...), tails: the statistics at least TAIL_Z spreads from the median, and
    flagged: running lines in the lower tail. stats must be cheap to read twice. Texts without lines have null scores and no flag. Where no
    document at all is running text, the median of running lines counts as 1, and the other scores are null."""
    rows = {r["lang"]: r for r in language_sketches(stats).collect()}  # as many rows as languages
    every = rows.pop("")
    of_all = {c: every[c] or ([1.0] * 3 if c == "running_lines" else None) for c in SKETCHED}

    def score(name: str) -> Column:
        if of_all[name] is None:
            return F.lit(None).cast("double")

        def z(quartiles: list[float]) -> Column:
            middle, spread = _centre(quartiles)
            return (F.col(name) - F.lit(middle)) / F.lit(spread)

        out = z(of_all[name])
        for lang, r in rows.items():
            own = r["n_docs"] / (r["n_docs"] + SHRINK)
            out = F.when(F.col("lang") == lang, z([own * a + (1 - own) * b for a, b in zip(r[name], of_all[name], strict=True)])).otherwise(out)
        return F.when(F.col("n_lines") > 0, out)

    scored = stats.withColumns({f"z_{c}": score(c) for c in SKETCHED})
    middle, spread = _centre(of_all["running_lines"])
    begins = (HALF - middle) / spread
    named = F.array_compact(F.array(*[F.when(F.abs(f"z_{c}") >= TAIL_Z, F.lit(c)) for c in SKETCHED]))
    # one half itself is not in the tail, whatever the last digits of a score are
    return scored.withColumns({"tails": named, "flagged": F.coalesce(F.col("z_running_lines") < begins - 1e-6 * max(abs(begins), 1.0), F.lit(False))})


def scored_documents(docs: DataFrame, labels: DataFrame, common: DataFrame) -> DataFrame:
    return robust_scores(written(document_statistics(docs, labels, common), "text-statistics"))


def not_prose(scored: DataFrame) -> DataFrame:
    """The documents whose running lines are in the lower tail of their language."""
    return scored.filter("flagged")
