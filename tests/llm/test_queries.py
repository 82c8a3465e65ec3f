"""The registered text queries on the smallest test tables, against plain Python."""

import ast
import json
import os
import tomllib
from collections import defaultdict
from xml.parsers import expat

import pytest

import __spark_entry__
from codeloom.llm import queries, tokenizer

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA) or not os.path.exists(tokenizer.VOCABULARY), reason="no test tables here")


def _run(spark, name):
    return __spark_entry__.queries()[name](spark, DATA)


def _documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def test_all_are_registered():
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())


def test_p3(spark):
    def xml(s):
        expat.ParserCreate("utf-8").Parse(s.encode(), True)

    parsers = {"py": ast.parse, "pyi": ast.parse, "json": json.loads, "ipynb": json.loads, "toml": tomllib.loads, "xml": xml}
    bad, of = set(), defaultdict(set)
    for r in spark.read.parquet(f"{DATA}/source_files.parquet").select("file_id", "repo", "module_key.id", "source").collect():
        ext = r["id"].rpartition("/")[2].rpartition(".")[2].lower() if "." in r["id"].rpartition("/")[2] else ""
        if r["source"] is None or ext not in parsers:
            continue
        of[r["repo"]].add(r["file_id"])
        try:
            parsers[ext](r["source"])
        except (SyntaxError, ValueError, expat.ExpatError):
            bad.add(r["file_id"])
    assert {r["file_id"] for r in _run(spark, "p3_found").collect()} == bad
    n = defaultdict(lambda: [0, 0])
    for r in _run(spark, "p3_rates").collect():
        n[r["repo"]][0] += r["n_files"]
        n[r["repo"]][1] += r["n_invalid"]
    assert {k: tuple(v) for k, v in n.items()} == {k: (len(v), len(v & bad)) for k, v in of.items()}
    # the rates are those of the verdicts, language by language
    by_verdict = defaultdict(lambda: [0, 0])
    repo = {r["file_id"]: r["repo"] for r in spark.read.parquet(f"{DATA}/source_files.parquet").select("file_id", "repo").collect()}
    for r in _run(spark, "p3_verdicts").collect():
        if r["claimed"] and r["verdict"] != "no_source":
            by_verdict[repo[r["file_id"]], r["claimed"]][0] += 1
            by_verdict[repo[r["file_id"]], r["claimed"]][1] += r["verdict"] in ("wrong_extension", "corrupt")
    assert {(r["repo"], r["language"]): [r["n_files"], r["n_invalid"]] for r in _run(spark, "p3_rates").collect()} == dict(by_verdict)


def test_p6(spark):
    texts = _documents(spark)
    enc = tokenizer.encoder(tokenizer.VOCABULARY)
    got = {r["doc_id"]: r["ids"] for r in _run(spark, "p6_ids").collect()}
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in texts.items()}
    assert [tuple(r) for r in _run(spark, "p6_roundtrip").collect()] == [(True, len(texts))]


def test_p7(spark):
    enc = tokenizer.encoder(tokenizer.VOCABULARY)
    sizes = {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in _documents(spark).items()}
    fill, total = defaultdict(int), defaultdict(int)
    for r in _run(spark, "p7_pack").collect():
        fill[r["container_id"]] += r["length"]
        total[r["doc_id"]] += r["length"]
    assert total == sizes and max(fill.values()) <= queries.CAPACITY
    assert len(fill) <= 1.02 * sum(sizes.values()) / queries.CAPACITY + 1


def test_p8(spark):
    texts = _documents(spark)
    stats = {r["doc_id"]: r for r in _run(spark, "p8_stats").collect()}
    assert set(stats) == set(texts)
    for i, t in texts.items():
        assert stats[i]["n_words"] == len((t or "").split()), i
        assert stats[i]["n_lines"] == sum(bool(x.strip()) for x in (t or "").split("\n"))
    found = {r["doc_id"] for r in _run(spark, "p8_found").collect()}
    assert found <= {i for i, t in texts.items() if (t or "").strip()}
    assert 0 < len(found) < len(texts) / 2
