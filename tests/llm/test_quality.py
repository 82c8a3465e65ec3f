import time

import numpy as np
import pyarrow as pa
import pytest

from codeloom.llm import quality, textstats

COMMON = {"de": frozenset(["der", "die"]), "en": frozenset(["the", "of", "and", "was"])}
PROSE = "The old pilot was asked about the state\nof the roof, and the baker wrote about\nthe price of gas. The clerk was seen to\nleave the station before the fair.\n"
TABLE = "Wheat ..... 12 44\nRye ..... 7 9\n------\nCoal ..... 3 1\n"


def _frames(spark, docs, labels):
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string, lang string, n_words string"),
        spark.createDataFrame(labels, "doc_id bigint, kind string, reader string"),
        spark.createDataFrame([(lang, w, 1) for lang, s in COMMON.items() for w in s] + [(None, None, 1)], "lang string, word string, freq_order int"),
    )


def test_statistics_by_hand():
    x = textstats.Lines(pa.array(["The cat, of 12.\n\n  And done!\n", None, " \n\t\n", "PellPell PellPell"]), COMMON)
    s = textstats.document_stats(x)
    assert s["n_lines"].tolist() == [2, 0, 0, 1]
    assert s["n_words"].tolist() == [6, 0, 0, 2]
    assert s["mean_word_length"][0] == pytest.approx((3 + 3 + 2 + 3 + 4) / 5)
    assert s["symbol_ratio"][0] == pytest.approx(3 / 20)
    assert s["common_words"][0] == pytest.approx(3 / 6)
    assert s["lang_no"].tolist() == [1, -1, -1, -1]


def test_lines_do_not_depend_on_their_batch():
    texts = [PROSE, TABLE, None, PROSE * 3, "", "x"]
    known = np.ones(1 << textstats.HASH_BITS, np.int8)
    whole = textstats.line_features(textstats.Lines(pa.array(texts), COMMON), known)
    each = [textstats.line_features(textstats.Lines(pa.array([t], pa.string()), COMMON), known) for t in texts]
    assert np.allclose(whole, np.vstack(each), atol=1e-4)
    assert whole.shape[1] == textstats.N_FEATURES


def test_found(spark, monkeypatch):
    monkeypatch.setattr(quality, "CHUNK_CHARS", 500)
    docs = [(n, TABLE * (1 + n % 3) if n % 5 == 0 else PROSE * (1 + n % 4), "en", "clash") for n in range(200)]
    docs += [(900, None, None, None), (901, "", "en", None), (902, " \n ", "de", None), (903, PROSE * 2000, "en", None), (5, TABLE, "en", None)]
    labels = [(n, "table" if n % 5 == 0 else "prose", "r") for n in range(100)] + [(1, None, "s"), (2, "junk", "s"), (0, "table", "t")]
    d, lab, com = _frames(spark, docs, labels)
    scored = quality.scored_documents(d, lab, com)
    assert scored.count() == len(docs)
    found = sorted({r["doc_id"] for r in quality.not_prose(scored).collect()})
    assert found == [n for n in range(200) if n % 5 == 0]
    assert all(r["z_running_lines"] is None and not r["flagged"] for r in scored.filter("doc_id in (900, 901, 902)").collect())


def test_found_where_most_is_not_prose(spark):
    docs = [(n, PROSE if n % 5 == 0 else TABLE, "en", "x") for n in range(200)]
    scored = quality.scored_documents(*_frames(spark, docs, [(n, "prose" if n % 5 == 0 else "table", "r") for n in range(100)]))
    assert sorted(r["doc_id"] for r in quality.not_prose(scored).collect()) == [n for n in range(200) if n % 5]
    assert scored.filter("flagged AND array_contains(tails, 'running_lines')").count() == 160


def test_nothing_is_prose(spark):
    docs = [(n, TABLE, "en", "x") for n in range(20)] + [(50, None, "en", "x")]
    scored = quality.scored_documents(*_frames(spark, docs, []))
    assert sorted(r["doc_id"] for r in quality.not_prose(scored).collect()) == list(range(20))
    assert all(r["z_common_words"] is None for r in scored.collect())


def test_one_half_is_not_in_the_tail_and_scores_are_by_language(spark):
    rows = [(n, lang, 10, 10, 4.0, 0.1, 0.5, 0.3, running) for n, (lang, running) in enumerate([("en", 1.0)] * 50 + [("en", 0.5), ("en", 0.4), ("de", 0.5), (None, 0.5), (None, 0.49)] + [("de", 0.6 + k / 100) for k in range(40)])]
    stats = spark.createDataFrame([(i, lang, *r) for i, lang, *r in rows], "doc_id bigint, lang string, n_lines bigint, n_words bigint, mean_word_length double, symbol_ratio double, punctuated_lines double, common_words double, running_lines double")
    scored = {r["doc_id"]: r for r in quality.robust_scores(stats).collect()}
    assert not scored[53]["flagged"] and scored[54]["flagged"] and scored[51]["flagged"]
    assert scored[50]["z_running_lines"] != scored[52]["z_running_lines"] != scored[53]["z_running_lines"]


@pytest.mark.parametrize("n", [0, 1, 2, 10, 40])
def test_few_labels_count_little(n):
    texts, kinds = [PROSE] * 60 + [TABLE] * n, [True] * 60 + [False] * n
    model = quality.fit_lines(texts, kinds, COMMON)
    assert model.weight == n**2 / (n**2 + quality.TRUST**2) and (model.model is None) == (n == 0)
    x = textstats.Lines(pa.array([PROSE, TABLE]), COMMON)
    assert (x.sum_lines(model.running(x).astype(float)) / np.diff(x.doc_starts) >= 0.5).tolist() == [True, False]


def test_no_labels_and_no_documents(spark):
    docs = [(n, TABLE if n % 5 == 0 else PROSE, "en", "x") for n in range(50)]
    d, lab, com = _frames(spark, docs, [])
    assert sorted(r["doc_id"] for r in quality.not_prose(quality.scored_documents(d, lab, com)).collect()) == list(range(0, 50, 5))
    assert quality.scored_documents(d.limit(0), lab, com).count() == 0
    assert quality.scored_documents(d, lab, com.limit(0)).count() == 50


def test_held_out_accuracy():
    rng = np.random.default_rng(0)
    nouns, verbs = ["baker", "clerk", "pilot", "roof", "fair", "gas"], ["asked about", "wrote about", "paid for", "was seen near"]

    def prose():
        words = " ".join(f"the {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)}{rng.choice(['.', ',', ''])}" for _ in range(30)).split()
        return "\n".join(" ".join(words[k : k + 6]) for k in range(0, len(words), 6))

    def listed():
        return "\n".join(f"{rng.choice(['* ', ''])}the {rng.choice(nouns)} of {rng.choice(nouns)}{rng.choice([';', ' 12', ''])}" for _ in range(20))

    kinds = [k % 3 > 0 for k in range(240)]
    texts = [prose() if k else listed() for k in kinds]
    model = quality.fit_lines(texts[:120], kinds[:120], COMMON)
    x = textstats.Lines(pa.array(texts[120:]), COMMON)
    share = x.sum_lines(model.running(x).astype(float)) / np.diff(x.doc_starts)
    assert np.mean((share >= 0.5) == np.array(kinds[120:])) > 0.97


@pytest.mark.parametrize("text", ["1" * 300_000 + "#", "ab" * 200_000, "x\n" * 50_000, "." * 300_000, "a b " * 100_000, "\u2028 \x85 \x1c"])
def test_hostile_texts_end_soon(text):
    began = time.monotonic()
    x = textstats.Lines(pa.array([text]), COMMON)
    textstats.document_stats(x)
    assert len(quality.PlainRule().running(x)) == len(textstats.line_features(x, np.zeros(1 << textstats.HASH_BITS, np.int8)))
    assert time.monotonic() - began < 20
