"""Source files that do not parse.

Every file is parsed against all supported grammars, most likely first by its tokens. A file that fails in the language
its extension claims but parses in another has a wrong extension; one that parses in none is corrupt. As all grammars are tried,
the ranking orders what a file parses as and changes no verdict.

The grammars are those of the running CPython (3.13) for Python, RFC 8259 JSON, TOML 1.0 and well-formed XML 1.0. Limits of
CPython's own parser (nesting of brackets and blocks) count as its grammar; limits of recursion do not make a file invalid.
"""

from __future__ import annotations

import ast
import json
import re
import sys
import tomllib
import warnings
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import ship

LANGUAGES = ("python", "json", "toml", "xml")
#: Extension, in lower case, to language.
EXTENSIONS = {"py": "python", "pyi": "python", "json": "json", "ipynb": "json", "toml": "toml", "xml": "xml"}

#: Tokens that are common in one language and rare in the others; fixed values.
TOKENS = {
    "python": ("def ", "class ", "import ", "return ", "self", "lambda ", "elif ", "None", ":\n", ":\r\n"),
    "json": ('": ', '":', '",\n', "},", "],", "{\n", "null"),
    "toml": ("\n[", "]\n", ' = "', " = [", " = {", " = true", " = false"),
    "xml": ("</", "/>", "<?", "<!", ">\n"),
}


def rank_languages(source: str) -> list[str]:
    """The languages by how many of their tokens the source holds, ties in the order of LANGUAGES."""
    n = {x: sum(map(source.count, TOKENS[x])) for x in LANGUAGES}
    return sorted(LANGUAGES, key=lambda x: -n[x])


def _python(s: str) -> bool:
    try:
        ast.parse(s[1:] if s.startswith("﻿") else s)
    except RecursionError:  # the parser was through; only the conversion of its tree ran out of depth
        return True
    return True


def _no_constant(name: str) -> None:
    raise ValueError(name)


_JSON_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))')


def deep_json(s: str) -> bool:
    """Whether s is JSON, with a stack of its own instead of recursion."""
    stack, want, pos = [], "value", 0
    end = len(s.rstrip(" \t\n\r"))
    while pos < end:
        m = _JSON_TOKEN.match(s, pos)
        if not m:
            return False
        pos = m.end()
        mark, text = m[1], m[2] is not None
        if want in ("value", "value or ]"):
            if mark in ("{", "["):
                stack.append(mark)
                want = "key or }" if mark == "{" else "value or ]"
                continue
            if mark == "]" and want == "value or ]":
                stack.pop()
            elif mark:
                return False
        elif want in ("key", "key or }"):
            if text:
                want = ":"
                continue
            if mark != "}" or want == "key":
                return False
            stack.pop()
        elif want == ":":
            if mark != ":":
                return False
            want = "value"
            continue
        elif want == "more":
            if mark == ",":
                want = "key" if stack[-1] == "{" else "value"
                continue
            if mark != ("}" if stack[-1] == "{" else "]"):
                return False
            stack.pop()
        else:
            return False
        want = "more" if stack else "end"
    return want == "end"


def _json(s: str) -> bool:
    try:
        json.loads(s, parse_constant=_no_constant, parse_int=str, parse_float=str)
    except RecursionError:
        return deep_json(s)
    return True


def _toml(s: str) -> bool:
    try:
        tomllib.loads(s, parse_float=str)
    except RecursionError:
        old = sys.getrecursionlimit()
        sys.setrecursionlimit(20 * len(s) + 10_000)  # its frames are on the heap
        try:
            tomllib.loads(s, parse_float=str)
        finally:
            sys.setrecursionlimit(old)
    return True


def _xml(s: str) -> bool:
    # the text is decoded already, whatever encoding its declaration names
    expat.ParserCreate("utf-8").Parse((s[1:] if s.startswith("﻿") else s).encode(), True)
    return True


_PARSERS = {"python": _python, "json": _json, "toml": _toml, "xml": _xml}


def parses(language: str, source: str) -> bool:
    try:
        return _PARSERS[language](source)
    except (SyntaxError, ValueError, expat.ExpatError, MemoryError):
        return False


RESULT = "file_id bigint, repo string, claimed string, has_source boolean, ranked array<string>, parses_as array<string>"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sys.set_int_max_str_digits(0)
    warnings.simplefilter("ignore")
    for b in batches:
        ranked, good = [], []
        for s in b["source"]:
            s = s.as_py()
            ranked.append([] if s is None else rank_languages(s))
            good.append([x for x in ranked[-1] if parses(x, s)])
        lists = [pa.array(x, pa.list_(pa.string())) for x in (ranked, good)]
        yield pa.RecordBatch.from_arrays([b["file_id"], b["repo"], b["claimed"], b["source"].is_valid(), *lists], names=["file_id", "repo", "claimed", "has_source", "ranked", "parses_as"])


def claimed_language(path: Column) -> Column:
    """The language an id claims by its extension in any case; null for other files."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for e, language in EXTENSIONS.items():
        out = F.when(ext == e, language).otherwise(out)
    return out


def parse_files(files: DataFrame, file_id: Column, repo: Column, path: Column, source: Column) -> DataFrame:
    """file_id, repo, claimed, ranked, parses_as, verdict of every file, each once however often it was delivered.

    verdict: 'valid' (in the claimed language), 'wrong_extension' (in other languages only), 'corrupt' (in none), 'unclaimed'
    (the extension claims no language), 'no_source' (null source). An empty source is text: valid Python and TOML, but neither
    JSON nor XML. A null path claims nothing. Other columns of the input are ignored. Sources are
    shuffled once, as parsing them costs far more than moving them and files are of very unequal size; only verdicts go on from there."""
    ship(files.sparkSession)
    rows = files.select(file_id.alias("file_id"), repo.alias("repo"), claimed_language(path).alias("claimed"), source.alias("source"))
    verdict = (
        F.when(~F.col("has_source"), "no_source").when(F.col("claimed").isNull(), "unclaimed").when(F.array_contains("parses_as", F.col("claimed")), "valid")
        .when(F.size("parses_as") > 0, "wrong_extension").otherwise("corrupt")
    )
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks).mapInArrow(_run, RESULT).distinct().withColumn("verdict", verdict).drop("has_source")
