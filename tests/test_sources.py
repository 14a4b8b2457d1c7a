"""Scans, bundles and extraction from source texts."""

import json

import pytest

from graphlens.sources import extract as E
from graphlens.sources import scan as S


def names(text, path, part="symbol"):
    return [(r["qualified_name"], r["type"], r["visibility"]) for r in E.rows_of(text, path) if r["part"] == part]


def calls(text, path):
    return [(r["qualified_name"], r["target"]) for r in E.rows_of(text, path) if r["type"] == "calls"]


def test_python():
    text = 'import os\nfrom .a import b as c\nclass K(Base):\n    """Doc."""\n    def _m(self, x):\n        c(x); self.q.r()\n\ndef f():\n    return K()\n'
    assert names(text, "p/x.py") == [("K", "class", "public"), ("K._m", "method", "private"), ("f", "function", "public")]
    assert calls(text, "p/x.py") == [("K._m", "c"), ("K._m", "self.q.r"), ("f", "K")]
    assert {(r["name"], r["target"]) for r in E.rows_of(text, "p/x.py") if r["part"] == "alias"} == {("os", "os"), ("c", "p.a.b")}
    assert names("def broken(:\n  pass\ndef ok(a):\n    return 1\n", "x.py") == [("broken", "function", "public"), ("ok", "function", "public")]


def test_javascript():
    text = "import D, { a as b } from './m';\nexport class K extends Base {\n  run(x) { if (x) { go(x); } }\n}\nconst f = (y) => { K.run(y); };\nmodule.exports = f;\n// function no() {}\n"
    assert [x[:2] for x in names(text, "x.ts")] == [("K", "class"), ("K.run", "method"), ("f", "function")]
    assert calls(text, "x.ts") == [("K.run", "go"), ("f", "K.run")]
    assert any(r["target"] == "export:default" for r in E.rows_of(text, "x.js"))


def test_go_rust_java_cpp():
    go = 'package p\ntype T struct {\n}\nfunc (t *T) Run(a int) error {\n\tt.help("{")\n}\nfunc low() {\n}\n'
    assert names(go, "x.go") == [("T", "struct", "public"), ("T.Run", "method", "public"), ("low", "function", "private")]
    assert calls(go, "x.go") == [("T.Run", "t.help")]
    rust = "pub struct T {\n}\nimpl T {\n    pub fn run(&self) -> u8 {\n        help(1)\n    }\n}\nfn low() {\n}\n"
    assert names(rust, "x.rs") == [("T", "struct", "public"), ("T::run", "method", "public"), ("low", "function", "private")]
    java = "import a.B;\npublic class K extends L implements M {\n    private int x = 1;\n    public void run(int a) {\n        go(a);\n    }\n}\n"
    assert names(java, "K.java") == [("K", "class", "public"), ("K.x", "field", "private"), ("K.run", "method", "public")]
    assert {r["type"] for r in E.rows_of(java, "K.java") if r["part"] == "relation"} == {"inherits", "implements", "calls"}
    cpp = '#include "a.hpp"\nnamespace n {\nclass K {\n};\n}\nint K::run(int a) {\n    go(a);\n    go(a);\n}\n'
    assert [x[:2] for x in names(cpp, "x.cpp")] == [("n::K", "class"), ("K::run", "method")]
    assert calls(cpp, "x.cpp") == [("K::run", "go")]


@pytest.mark.parametrize("text,path", [(None, "x.py"), ("", "x.py"), ("x", None), ("x = 1", "x.unknown"), ("}{" * 50, "x.c"), ("\x00", "x.py"), ("(" * 3000, "x.py")])
def test_odd_texts(text, path):
    assert E.rows_of(text, path) == []


def test_extract_frame(spark):
    df = spark.createDataFrame([("r", "f", "x.py", "def f(): pass"), ("r", "g", "x.py", None)], "repo_id string, file_id string, path string, content string")
    assert [(r["name"], r["start_line"]) for r in E.extract(df).collect()] == [("f", 1)]
    assert E.extract(df.limit(0)).count() == 0


def test_scan_tree(spark, tmp_path):
    for name, data in {"a/x.py": b"x\ny\n", "node_modules/z.js": b"1", "b.min.js": b"1", "bin.py": b"\x00\x01", "t.txt": b"t"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = S.scan_tree(spark, str(tmp_path)).collect()
    assert [(r["path"], r["language"], r["n_lines"]) for r in got] == [("a/x.py", "python", 2)]
    with pytest.raises(ValueError):
        S.scan_tree(spark, str(tmp_path), max_files=0)


def test_bundle(spark, tmp_path):
    data = {"repo_meta": {"repo_id": "r", "branch": "main"}, "modules": [{"id": "M", "name": "m", "metadata": {"k": "v"}}], "files": [{"id": "F", "path": "p"}], "symbols": [], "relations": [], "spans": [{"file_path": "p", "line_start": 1, "line_end": 2}]}
    (tmp_path / "b.json").write_text(json.dumps(data, indent=1))
    t = S.read_bundle(spark, str(tmp_path / "b.json"))
    assert t["modules"].select("repo_id", "id", "metadata").first() == ("r", "M", {"k": "v"})
    assert t["symbols"].count() == 0 and t["spans"].first()["line_end"] == 2


def test_changed_paths(spark):
    s = spark.createDataFrame([("M", "a", None), ("D", "b", None), ("R100", "c", "d"), ("A", "c", None)], "code string, path string, new_path string")
    assert sorted(tuple(r) for r in S.changed_paths(s).collect()) == [("a", "changed"), ("b", "deleted"), ("c", "changed"), ("d", "changed")]


def test_snippets(spark):
    asked = spark.createDataFrame([("r", "f", 2, 3), ("r", "f", 9, 9), ("r", "f", None, 1)], "repo_id string, file_id string, line_start int, line_end int")
    src = spark.createDataFrame([("r", "f", "a\nb\nc"), ("r", "f", None)], "repo_id string, file_id string, content string")
    assert [r["snippet"] for r in S.snippets(asked, src).collect()] == ["b\nc"]


def test_store(spark, tmp_path):
    from pyspark.sql import functions as F

    from graphlens.functions import text as X
    from graphlens.sources import store
    from graphlens.tables import missing_tables

    d = spark.createDataFrame([("d1", "r", "2026-01-01"), ("d2", "r", "2026-01-02"), ("d3", "q", None)], "document_id string, repo_id string, generated_at string")
    at = str(tmp_path / "docs")
    store.append_documents(d.filter("document_id = 'd1'"), at)
    store.append_documents(d.filter("document_id <> 'd1'"), at)
    assert sorted(r["document_id"] for r in store.latest_documents(spark, at).collect()) == ["d2", "d3"]
    s = spark.createDataFrame([("d", 2, "b "), ("d", 1, "a"), ("d", 3, None)], "document_id string, position int, content string")
    assert store.markdown(s).first()["text"] == "a\n\nb\n\n\n"
    store.write_markdown(s, str(tmp_path / "md"))
    m = spark.createDataFrame([("r", "1", "old"), ("r", "2", None)], "repo_id string, id string, summary string")
    new = store.with_summaries(m, m.filter("id = '2'").withColumn("summary", F.lit("new")))
    assert sorted(tuple(r) for r in new.collect()) == [("r", "1", "old"), ("r", "2", "new")]
    with pytest.raises(ValueError):
        store.summaries({}, "thing")
    row = spark.range(1).select(X.state_key(F.lit(" a "), F.lit(""), F.lit("b")), X.backoff_seconds(F.lit(1)), X.backoff_seconds(F.lit(9)), X.under_roots(F.lit("/srv/a"), ["/srv/"]), X.under_roots(F.lit("/srvx"), ["/srv"])).first()
    assert tuple(row) == ("a:b", 2.0, 5.0, True, False)
    assert "no_such_table" in [r[0] for r in missing_tables(spark, ["no_such_table"]).collect()]


def test_stream_of_deliveries(spark, tmp_path):
    from graphlens.streaming.index import current_files, follow

    schema = "repo_id string, path string, content_hash string, loaded_at timestamp"
    a = spark.sql("select 'r' repo_id, './x' path, 'h1' content_hash, timestamp'2026-01-01' loaded_at union all select 'r', 'y', 'k', timestamp'2026-01-03'")
    b = spark.sql("select 'r' repo_id, 'x' path, 'SHA1:h2' content_hash, timestamp'2026-01-02' loaded_at union all select 'r', 'y', 'old', timestamp'2026-01-01'")
    src = str(tmp_path / "in")
    for df in (a, b):
        df.coalesce(1).write.mode("append").parquet(src)
    follow(spark, src, schema, str(tmp_path / "out"), str(tmp_path / "state"), files_per_batch=1)
    last = spark.read.parquet(str(tmp_path / "out" / "v=1"))
    want = sorted(tuple(r) for r in current_files(a.unionByName(b)).collect())
    assert sorted(tuple(r) for r in last.select("repo_id", "path", "content_hash", "loaded_at").collect()) == want and len(want) == 2
