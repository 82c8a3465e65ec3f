import json
import time
import tomllib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.llm import grammar

CASES = [
    ("a.py", "x = 1\n", "valid"), ("a.PY", "def f(:\n", "corrupt"), ("a.pyi", "def f() -> int: ...\r\n", "valid"), ("a.py", "", "valid"), ("a.json", "", "wrong_extension"),
    ("a.json", '{"a": [1, null]}', "valid"), ("a.json", '{"a": NaN}', "wrong_extension"), ("a.json", "{'a': 1}", "wrong_extension"), ("n.ipynb", '{"cells": [', "corrupt"),
    ("a.toml", "[t]\na = 1\n", "valid"), ("a.toml", '{"a": 1}', "wrong_extension"), ("a.xml", "<a><b/></a>", "valid"), ("a.xml", "<a><b></a>", "corrupt"),
    ("a.xml", '<?xml version="1.0" encoding="ISO-8859-1"?><a>é</a>', "valid"), ("a.py", "<<<<<<< HEAD\nx = 1\n=======\n", "corrupt"), ("a.py", "x\x00", "corrupt"),
    ("a.rej", "x = 1", "unclaimed"), ("a", "x", "unclaimed"), (None, "x", "unclaimed"), ("a.py", None, "no_source"), ("d.py/a", "x", "unclaimed"), ("a.py", "x = " + "1 + " * 30000 + "1", "valid"),
    ("a.json", "[" * 50000 + "]" * 50000, "valid"), ("a.toml", "x = '" + "é" * 200000 + "'", "valid"), ("a.py", "<a/>", "wrong_extension"), ("a.py", "def f():\n\tif x:\n        y\n", "corrupt"),
]


def test_verdicts(spark):
    rows = [(n, "r", p, s, "clash") for n, (p, s, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows + rows[:3], "i bigint, r string, p string, s string, parses_as string")
    got = {x["file_id"]: x["verdict"] for x in grammar.parse_files(df, F.col("i"), F.col("r"), F.col("p"), F.col("s")).collect()}
    assert got == {n: v for n, (_, _, v) in enumerate(CASES)}
    assert grammar.parse_files(df, F.col("i"), F.col("r"), F.col("p"), F.col("s")).count() == len(CASES)
    assert grammar.parse_files(df.limit(0), F.col("i"), F.col("r"), F.col("p"), F.col("s")).count() == 0


@pytest.mark.parametrize(("source", "first"), [("def f(x):\n    return x\n", "python"), ('{\n  "a": true\n}', "json"), ('[tool.x]\nname = "y"\n', "toml"), ("<?xml version='1.0'?>\n<a><b/></a>", "xml")])
def test_ranking(source, first):
    assert grammar.rank_languages(source)[0] == first


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list('{}[],:" \n') + ["1", "-0.5e3", "01", "true", "nul", '"a"', '"\\u00e9"', '"\\x"'])).map("".join))
def test_deep_json_agrees(s):
    assert grammar.deep_json(s) == grammar.parses("json", s)


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x)))
def test_deep_json_takes_what_json_writes(x):
    assert grammar.deep_json(json.dumps(x))


def test_toml_version():
    assert not grammar.parses("toml", "a = {\n b = 1 }")  # 1.1 only
    assert tomllib.loads("a = 1979-05-27 07:32:00")


@pytest.mark.parametrize("source", ["]" + " " * 300_000 + "x", '"' * 200_000, "[" + "a " * 200_000, " " * 300_000 + "=", "(" * 300_000, "<" * 200_000, "{" * 100_000, "a." * 30_000])
def test_hostile_sources_end_soon(source):
    began = time.monotonic()
    grammar.rank_languages(source)
    for language in grammar.LANGUAGES:
        grammar.parses(language, source)
    assert time.monotonic() - began < 20
