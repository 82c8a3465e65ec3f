import sys

import pytest

from codeloom import __main__ as cli


@pytest.mark.parametrize("command", ["index", "missing", "exports", "counts", "fix"])
def test_commands(spark, tmp_path, monkeypatch, command):
    root, out = tmp_path / "src", tmp_path / "out"
    root.mkdir()
    (root / "a.py").write_text("def helper():\n    return 1\n")
    (root / "b.py").write_text("import os\n\nhelper()\n")
    monkeypatch.setattr(sys, "argv", ["codeloom", command, str(root), str(out)])
    cli.main()
    rows = spark.read.parquet(str(out)).collect()
    if command == "index":
        assert {r["symbol_name"] for r in rows} == {"helper", "a", "b"}
    elif command == "missing":
        assert [r["symbol"] for r in rows] == ["helper"]
    elif command == "exports":
        assert {(r["path"].rpartition("/")[2], r["symbol"]) for r in rows} == {("a.py", "helper"), ("b.py", "os")}
    elif command == "counts":
        assert {r["term"]: r["value"] for r in rows}["helper"] == 2
    else:
        assert {r["path"].rpartition("/")[2]: r["new_source"] for r in rows}["b.py"] == "from a import helper\n\nhelper()\n"


def test_serve(spark, tmp_path, monkeypatch):
    (tmp_path / "src").mkdir()
    (tmp_path / "in").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "in" / "r.txt").write_text('{"request_id": 1, "command_id": "get_capabilities"}\n')
    monkeypatch.setattr(sys, "argv", ["codeloom", "serve", str(tmp_path / "src"), str(tmp_path / "in"), str(tmp_path / "out"), "--once"])
    cli.main()
    assert spark.read.text(f"{tmp_path}/out/responses/ok").count() == 1
