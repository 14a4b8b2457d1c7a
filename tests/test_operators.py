"""Operators on small fixtures: expected values, nulls, ties, repeated rows, empty tables, extra columns."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graphlens import config as C
from graphlens.functions import text as X
from graphlens.functions import vector as VF
from graphlens.operators import anchors as A
from graphlens.operators import cdc, diagrams, docs, evidence, lookup, positions, rank, resolve, review, state, summarize, traverse, vectors
from graphlens.operators.snapshots import plain_path, snapshot_changes

T0 = datetime(2026, 1, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


# -- snapshots -----------------------------------------------------------------------------------------------------------

REPOS = "repo_id string, repo_path string, branch string, commit_hash string, scan_time timestamp, extra string"
FILES = "repo_id string, path string, content_hash string, commit_hash string, loaded_at timestamp, repo_path string"


def test_snapshot_changes(spark, rows):
    a, b = "aaaa" + "0" * 36, "bbbb" + "0" * 36
    repos = spark.createDataFrame([("r", "p", "main", a, T0, "x"), ("r", "p", "refs/heads/main", b, T0 + timedelta(1), None), ("r", "p", "main", a, T0 + timedelta(9), "late"), ("r", "p", "main", "c" * 40, T0, "no files")], REPOS)
    files = spark.createDataFrame(
        [
            ("r", "./src\\x.py", "H1", a.upper(), T0, "q"),
            ("r", "src/x.py", "sha1:h2", b[:12], T0, "q"),
            ("r", "src/x.py", "h9", b, T0 - timedelta(1), "an earlier row loses"),
            ("r", "gone.py", "h", a, T0, None),
            ("r", "new.py", None, b, T0, None),
            ("r", "blank.py", " ", a, T0, None),
            ("r", "blank.py", "h", b, T0, None),
            ("r", "same.py", "SHA1:Q", a, T0, None),
            ("r", "same.py", "q", b[:10], None, None),
            ("r", "lost.py", "h", "dddd11112222", T0, "unknown commit"),
            ("r", None, "h", b, T0, None),
            ("r", "  ", "h", b, T0, None),
            (None, "x", "h", b, T0, None),
        ],
        FILES,
    )
    want = [("r", b, "gone.py", "removed"), ("r", b, "new.py", "added"), ("r", b, "src/x.py", "changed")]
    assert rows(snapshot_changes(repos, files)) == want
    assert rows(snapshot_changes(repos, files.unionByName(files))) == want
    assert rows(snapshot_changes(repos, files, levels=(0, 2))) == want
    assert rows(snapshot_changes(repos.limit(0), files)) == []
    assert rows(snapshot_changes(repos, files.limit(0))) == []


@pytest.mark.parametrize("levels", [(0, 12), (0, 2, 4), (0, 4, 8, 12)])
def test_snapshots_by_shuffle_and_by_broadcast(spark, rows, monkeypatch, levels):
    import random

    from graphlens.operators import snapshots

    rng = random.Random(7)
    commits = [f"{i:02d}" * 20 for i in range(6)]
    repos = spark.createDataFrame([(f"r{k}", "p", "main", c, T0 + timedelta(i), "") for k in range(3) for i, c in enumerate(commits)], REPOS)
    data, want = [], []
    for k in range(3):
        old = None
        for c in commits:
            new = {f"d{i}/f.py": str(rng.randint(0, 1)) for i in range(60) if rng.random() < 0.8} if old is None or rng.random() < 0.7 else dict(old)
            data += [(f"r{k}", p, h, c[: rng.choice([10, 12, 40])], T0, None) for p, h in new.items()]
            if old is not None:
                want += [(f"r{k}", c, p, "removed" if p not in new else "added" if p not in old else "changed") for p in {*old, *new} if old.get(p) != new.get(p)]
            old = new
    files = spark.createDataFrame(data, FILES)
    for most in (0, 100):
        monkeypatch.setattr(snapshots, "MOST_BROADCAST", most)
        assert rows(snapshot_changes(repos, files, levels)) == sorted(want)


def test_ambiguous_beginning_is_ignored(spark, rows):
    a, b = "aaaa1" + "0" * 35, "aaaa2" + "0" * 35
    repos = spark.createDataFrame([("r", "p", "m", a, T0, ""), ("r", "p", "m", b, T0 + timedelta(1), "")], REPOS)
    files = spark.createDataFrame([("r", "x", "1", a, T0, ""), ("r", "x", "1", b, T0, ""), ("r", "y", "1", "aaaa", T0, "")], FILES)
    assert rows(snapshot_changes(repos, files)) == []


@pytest.mark.parametrize("raw,want", [("./a//b.py", "a/b.py"), ("\\a\\b", "a/b"), (" /x ", "x"), ("././x", "x"), ("", None), ("A/B", "A/B")])
def test_plain_path(spark, raw, want):
    assert one(spark, plain_path(F.lit(raw))) == want


# -- texts, vectors ------------------------------------------------------------------------------------------------------


def test_text_functions(spark):
    assert one(spark, X.identifiers(F.lit("Where is Foo.bar used? foo.bar, run函数 a x."))) == ["where", "is", "foo.bar", "used", "run函数"]
    assert one(spark, X.normalised(F.lit("  Héllo, wörld! 中文 "))) == "héllo wörld 中文"
    assert one(spark, X.line_count(F.lit(""))) == 1
    assert one(spark, X.line_count(F.lit("a\nb\n"))) == 2
    assert one(spark, X.line_count(F.lit("a\nb"))) == 2
    assert one(spark, X.parameters(F.lit("f(a, b: int = 2) -> str"))) == ["a", "b: int = 2"]
    assert one(spark, X.return_type(F.lit("f(a) -> dict[str, int]"))) == "dict[str, int]"
    assert one(spark, X.parameters(F.lit("func (s *T) F(a int) int {"))) == []
    assert one(spark, X.language_of_path(F.lit("a/b.TSX"))) == "javascript"
    assert one(spark, X.language_of_path(F.lit("a/readme"))) is None
    assert one(spark, X.first_match(F.lit("MyApiModel"), C.MODULE_RULES, F.lit("Module"))) == "API Layer"


def test_vector_functions(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, VF.cosine(v(0, 0), v(1, 0))) == 0.0
    assert one(spark, VF.dot(v(1, 2, 3), v(1, 1))) == 3.0
    assert one(spark, VF.normalised(v(3, 4))) == [0.6, 0.8]
    assert one(spark, VF.normalised(v(0, 0))) == [0.0, 0.0]
    assert one(spark, VF.from_text(VF.to_text(v(1, 0.5)))) == [1.0, 0.5]


def test_nearest(spark, rows):
    data = [(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [1.0, 0.1]), (4, "a", [0.0, 0.0]), (5, "a", None), (6, "a", [1.0]), (7, "a", [1.0, 0.0])]
    df = spark.createDataFrame(data, "id long, kind string, vector array<double>")
    q = df.filter("id = 1")
    assert rows(vectors.nearest(df, q, "cosine", 1, 0.5), "id", "kind", "rank") == [(3, "b", 1), (7, "a", 1)]
    assert rows(vectors.nearest(df, q, "cosine", {"a": 5}, 0.0), "id") == [(2,), (4,), (7,)]
    assert rows(vectors.nearest(df, q, "l2", {"a": 2}, None), "id") == [(4,), (7,)]
    assert vectors.nearest(df, df.limit(0), "ip").count() == 0
    with pytest.raises(ValueError):
        vectors.nearest(df, q, "hamming")


def test_upsert_and_delete(spark, rows):
    s = "repo_id string, object_id string, id long, created_at timestamp"
    old = spark.createDataFrame([("r", "a", 1, T0), ("r", "b", 2, T0)], s)
    new = spark.createDataFrame([("r", "a", 3, T0 + timedelta(1)), ("r", "b", 4, None)], s)
    assert rows(vectors.upserted(old, new), "object_id", "id") == [("a", 3), ("b", 2)]
    assert vectors.deleted(old, old.limit(0)).count() == 2
    assert rows(vectors.deleted(old, old.filter("object_id = 'a'")), "id") == [(2,)]


# -- lookups -------------------------------------------------------------------------------------------------------------


def test_name_search(spark, rows):
    o = spark.createDataFrame([("r", "1", "Core", "x/core"), ("r", "2", "core_util", "y"), ("r", "3", "z", "a/CORE/b"), ("r", "4", None, None)], "repo_id string, id string, name string, other string")
    t = spark.createDataFrame([(" core ",), ("core",), (None,), ("",)], "t string")
    assert rows(lookup.name_search(o, t), "id", "tier", "rank") == [("1", 0, 1), ("2", 2, 2), ("3", 2, 3)]
    assert rows(lookup.name_search(o, t, 1), "id") == [("1",)]
    assert lookup.name_search(o, t.limit(0)).count() == 0
    assert lookup.name_search(o.limit(0), t).count() == 0


def test_spans(spark, rows):
    spans = spark.createDataFrame([("r", "f", "file", "file", 1, 99), ("r", "f", "cls", "class", 5, 50), ("r", "f", "m", "method", 10, 20), ("r", "f", "m2", "method", 10, 20), ("r", "f", "none", "method", None, None)], "repo_id string, file_id string, span_id string, type string, a int, b int")
    asked = spark.createDataFrame([("r", "s1", "f", 12, 13), ("r", "s2", "f", 6, 9), ("r", "s3", "f", 99, 100), ("r", "s4", "g", 1, 1)], "repo_id string, sel_id string, file_id string, line_start int, line_end int")
    c = lookup.containing_spans(asked, spans)
    assert rows(lookup.best_span(c), "sel_id", "span_id") == [("s1", "m"), ("s2", "cls")]


# -- resolution ----------------------------------------------------------------------------------------------------------


def test_resolution(spark, rows):
    symbols = spark.createDataFrame([("r", "S1", "run", "Job.run", "f1"), ("r", "S2", "run", "Task.run", "f2"), ("r", "S3", "go", "m::go", "f3"), ("r", "S4", "x", "x", None)], "scope string, id string, name string, qualified_name string, file_id string")
    files = spark.createDataFrame([("r", "f1", "a/job.py"), ("r", "f2", "a/task.py"), ("r", "f3", "src/deep/mod.rs")], "scope string, id string, path string")
    keys = resolve.unique_keys(resolve.symbol_keys(symbols, files))
    known = {k: i for _, k, i in rows(keys, "scope", "key", "id")}
    assert "run" not in known and known["Job.run"] == "S1" and known["a.task.run"] == "S2" and known["deep::go"] == "S3"
    raw = spark.createDataFrame([("r", "Job.run", None), ("r", "run", None), ("r", "m.go", None), ("r", "j.run", "a.job.run"), ("q", "Job.run", None), ("r", " x ", None), ("r", "obj->go", None)], "scope string, raw_id string, imported string")
    got = {(s, n): o for s, n, o in rows(resolve.resolve(raw, keys), "scope", "raw_id", "object_id")}
    assert got == {("r", "Job.run"): "S1", ("r", "run"): "run", ("r", "m.go"): "S3", ("r", "j.run"): "S1", ("q", "Job.run"): "Job.run", ("r", " x "): "S4", ("r", "obj->go"): "S3"}
    aliases = F.create_map(F.lit("np"), F.lit("numpy"))
    assert one(spark, resolve.imported_name(F.lit("np.zeros"), aliases)) == "numpy.zeros"
    assert one(spark, resolve.imported_name(F.lit("np::z->y"), aliases)) == "numpy::z::y"
    assert one(spark, resolve.imported_name(F.lit("pd.x"), aliases)) is None


def test_valid_relations_and_numbers(spark, rows):
    o = spark.createDataFrame([("a", "symbol"), ("f", "file")], "id string, kind string")
    r = spark.createDataFrame([("a", "symbol", "f", "file"), ("a", "symbol", "f", "symbol"), ("a", "symbol", "ext", "external"), ("zz", "symbol", "a", "symbol")], "source_id string, source_type string, target_id string, target_type string")
    assert rows(resolve.valid_relations(r, o), "target_id", "target_type") == [("ext", "external"), ("f", "file")]
    n = resolve.renumbered(spark.range(100).select((99 - F.col("id")).alias("k")), ["k"])
    assert [(k, i) for k, i in sorted(rows(n, "k", "id"))] == [(k, f"R_{k + 1}") for k in range(100)]


# -- traversal, rank, evidence ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def chain(spark):
    r = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "calls"), ("d", "e", "calls"), ("x", "a", "references"), ("y", "a", "inherits"), ("a", "a", "calls")], "source_id string, target_id string, relation_type string")
    return r, spark.createDataFrame([("a",), (None,)], "seed string")


def test_expand(spark, rows, chain):
    r, seeds = chain
    assert rows(traverse.expand(seeds, r, 2)) == [("a", "b", 1), ("a", "c", 2), ("a", "x", 1)]
    calls = seeds.withColumn("modes", F.array(F.lit("callees")))
    assert rows(traverse.expand(calls, r, 2)) == [("a", "b", 1), ("a", "c", 2)]
    assert rows(traverse.expand(seeds.withColumn("modes", F.array(F.lit("callers"))), r, 2)) == []
    assert rows(traverse.expand(seeds, r, 2, spark.createDataFrame([("b",)], "id string"))) == [("a", "b", 1)]
    assert traverse.expand(seeds.limit(0), r).count() == 0
    assert rows(traverse.call_chain(spark.createDataFrame([("b",)], "seed string"), r, 3)) == [("b", "b", "c", 0), ("b", "c", "d", 1), ("b", "d", "e", 2)]


def test_gain_gate(spark, rows, chain):
    r, seeds = chain
    names = spark.createDataFrame([(x, x * 2, "q." + x) for x in "abcdex"], "id string, name string, qualified_name string")
    reached = traverse.expand(seeds, r, 2)
    ask = lambda t: spark.createDataFrame([("a", [t])], "seed string, terms array<string>")
    assert rows(traverse.expansion_gain(reached, ask("cc"), names)) == [("a", 1, 1, 1.0)]
    weak = traverse.expansion_gain(reached, ask("nothing"), names)
    assert rows(traverse.gated(reached, weak)) == [("a", "b", 1), ("a", "x", 1)]


def test_modes(spark):
    assert one(spark, traverse.expansion_modes(F.lit("谁依赖 it"))) == ["depends_on", "reverse_depends_on"]
    assert one(spark, traverse.expansion_modes(F.lit("Who are the CALLERS"))) == ["callers"]
    assert len(one(spark, traverse.expansion_modes(F.lit("hello")))) == 5


def test_fusion(spark):
    ints = [F.lit(x) for x in (10, 10, 10)]
    assert one(spark, rank.fused(*ints, F.lit(1.0), F.lit(10), F.lit(True))) == 1.0
    assert one(spark, rank.fused(F.lit(1), F.lit(0), F.lit(0), F.lit(-3.0), F.lit(0), F.lit(False))) == 0.03
    assert one(spark, rank.distance_score(F.lit(None).cast("int"))) == 0
    assert one(spark, rank.name_hit(F.lit("Run"), F.lit("Job.run"), F.array(F.lit("job.run")))) == 10
    assert one(spark, rank.type_match(F.lit("interface"), F.lit("which class"))) == 10
    assert one(spark, rank.baseline(F.lit("file"), F.lit(2))) == 0.55


def test_strategies(spark):
    cases = [(0.85, 0.8, 0.7, 0.5, 0.8, "S1"), (0.65, 0.5, 0.5, 0.5, 0.8, "S2"), (0.5, 0.6, 0.7, 0.5, 0.8, "S3"), (0.35, 0.7, 0.7, 0.5, 0.8, "S4")]
    df = spark.createDataFrame(cases, "a double, c double, e double, g double, r double, want string")
    assert df.filter(evidence.strategy() != F.col("want")).count() == 0


def test_metrics(spark, rows):
    data = [("q", 1, "S_main", "F_main", "core", 1.0), ("q", 2, "F_main", "F_main", "core", 0.8), ("q", 3, "M_core", None, "core", 0.7), ("q", 4, "S_h", "F_h", "utils", 0.85), ("q", 5, "F_h", "F_h", "utils", 0.2)]
    r = spark.createDataFrame(data, "seed string, rank int, id string, file_id string, module_id string, score double")
    assert rows(evidence.concentration(r.filter("rank < 5"))) == [("q", 0.75)]
    assert rows(evidence.evidence(r)) == [("q", 1.0)]
    assert rows(evidence.consistency(r)) == [("q", 0.029)]
    new = spark.createDataFrame([("q", "F_h"), ("q", "S_h"), ("q", "S_h")], "seed string, id string")
    assert rows(evidence.gain(new, r.limit(0), r)) == [("q", 0.5)]
    assert rows(evidence.evidence(r.withColumn("score", F.lit(0.1)))) == [("q", 0.0)]
    one_module = r.withColumn("module_id", F.lit("m"))
    assert rows(evidence.consistency(one_module)) == [("q", 1.0)]
    assert rows(evidence.inferred_anchor(r.filter("rank <= 3"))) == [("q", "file", "F_main", 0.6)]
    m = spark.createDataFrame([("q", 0.3, "module")], "seed string, c double, level string")
    assert rows(evidence.degraded_mode(r, m)) == [("q", "partial", "S_main,F_main,M_core,S_h", "F_h")]
    assert rows(evidence.degraded_mode(r.filter("rank <= 3"), m), "mode") == [("candidates",)]
    assert rows(evidence.degraded_mode(r.limit(0), m), "mode") == [("guided_module",)]
    assert rows(evidence.evidence_line(r.filter("rank <= 2"))) == [("q", "S_main:1.00, F_main:0.80")]


# -- anchors ---------------------------------------------------------------------------------------------------------------


def test_anchors(spark, rows):
    o = spark.createDataFrame([("r", "S1", "symbol", "run", "Service.run"), ("r", "S2", "symbol", "stop", "A.stop"), ("r", "S3", "symbol", "stop", "B.stop"), ("q", "S9", "symbol", "run", "Service.run")], "repo_id string, id string, kind string, name string, other string")
    q = spark.createDataFrame([(1, "r", "what does `Service.run` do"), (2, "r", "how does stop work"), (3, "r", "它的作用"), (4, "r", None)], "question_id int, repo_id string, question string")
    assert rows(A.by_name(q, o)) == [(1, "S1", "symbol", 0.85), (2, "S2", "symbol", 0.65)]
    assert one(spark, A.is_follow_up(F.lit("它 做什么"))) and not one(spark, A.is_follow_up(F.lit("")))
    assert one(spark, A.inherits(F.lit("它呢"), F.lit("")))
    assert not one(spark, A.inherits(F.lit("what about this method"), F.lit("")))
    spans = spark.createDataFrame([(1, "S1", 0.95)], "question_id int, id string, confidence double")
    kept = spark.createDataFrame([(3, "S7", 0.8, True), (2, "S7", 0.8, False)], "question_id int, id string, confidence double, takes boolean")
    got = rows(A.resolved(q, spans, A.by_name(q, o).drop("kind"), kept))
    assert got == [(1, "selection", "S1", 0.95), (2, "name_match", "S2", 0.65), (3, "memory_inherit", "S7", 0.72), (4, "none", None, 0.0)]
    assert one(spark, A.clamped(F.lit(0.2))) == 0.4


# -- state -----------------------------------------------------------------------------------------------------------------


def test_positions_and_percentiles(spark, rows):
    v = spark.createDataFrame([("a", x) for x in (20, 12)] + [("b", x) for x in (30, 10, 50, 20, 40)] + [("c", None)], "name string, value int")
    assert rows(positions.nearest_rank(v, "name", "value", {"p50": 0.5, "p99": 0.99})) == [("a", 12, 20), ("b", 30, 50)]
    assert rows(state.histogram_stats(v, "name", "value"), "name", "min", "max", "avg", "count") == [("a", 12, 20, 16.0, 2), ("b", 10, 50, 30.0, 5)]
    assert state.histogram_stats(v.limit(0), "name", "value").count() == 0


def test_rate_limit_matches_fold(spark, rows):
    import random

    rng = random.Random(4)
    data = [(u, T0 + timedelta(seconds=rng.randint(0, 5000)), i) for i, u in enumerate([1] * 300 + [2] * 20)] + [(3, None, 999)]
    df = spark.createDataFrame(data, "user_id long, ts timestamp, event_id long")
    want = []
    for u in (1, 2):
        begin, n, windows, accepted, rejected = None, 0, 0, 0, 0
        for t in sorted(t for k, t, _ in data if k == u):
            if begin is None or t >= begin + timedelta(seconds=60):
                begin, n, windows = t, 0, windows + 1
            n += 1
            accepted, rejected = accepted + (n <= 2), rejected + (n > 2)
        want.append((u, windows, accepted, rejected))
    assert rows(state.rate_limited(df, limit=2, window_s=60)) == want
    assert state.rate_limited(df.limit(0)).count() == 0


def test_sessions_across_buckets(spark, rows):
    data = [(1, T0 + timedelta(hours=h), h) for h in (0, 5, 23, 25, 60, 61)]
    df = spark.createDataFrame(data, "user_id long, ts timestamp, event_id long")
    assert rows(state.session_spans(df, ttl_s=12 * 3600), "session", "n") == [(1, 2), (2, 2), (3, 2)]


def test_anchor_and_focus_memory(spark, rows):
    t = spark.createDataFrame([("s", 1, "symbol", 0.9, "A"), ("s", 2, "none", 0.0, None), ("s", 3, "file", 0.5, "B"), ("s", 4, "none", 0.0, None)], "session string, n int, level string, confidence double, target string")
    assert rows(state.anchors_kept(t, "session", ["n"]), "n", "kept_target", "cleared") == [(1, "A", False), (2, "A", False), (3, "B", True), (4, None, False)]
    q = spark.createDataFrame([("s", 1, "How does login work?"), ("s", 2, "login again"), ("s", 3, ""), ("s", 4, "billing rules"), (None, 5, "x")], "session string, n long, q string")
    assert rows(state.focus_memory(q, "session", ["n"], "q", "n"), "n", "focus") == [(1, "how does login work"), (2, "how does login work"), (3, "how does login work"), (4, "billing rules")]


def test_tasks(spark, rows):
    now = datetime(2026, 4, 17)
    log = spark.createDataFrame([("a", "queued", now, 1), ("a", "success", now, 2), ("b", "running", now, 3), ("c", "failed", now + timedelta(seconds=11), 4), ("d", "success", now + timedelta(seconds=5), 5)], "task_id string, status string, at timestamp, seq long")
    tasks = state.latest_tasks(log)
    assert rows(tasks, "task_id", "status") == [("a", "success"), ("b", "running"), ("c", "failed"), ("d", "success")]
    at = F.lit(now + timedelta(seconds=11))
    assert rows(state.retained(tasks.drop("created_at"), at, 10, 99), "task_id") == [("b",), ("c",), ("d",)]
    assert rows(state.retained(tasks.drop("created_at"), at, 10, 2), "task_id") == [("b",), ("c",)]
    s = spark.createDataFrame([("t", "s1", "failed", now, i) for i in range(5)] + [("t", "s2", "done", now, 9), ("u", "s1", "done", now, 1)], "task_id string, section string, status string, at timestamp, seq long")
    assert rows(state.task_progress(s), "task_id", "status") == [("t", "failed"), ("u", "completed")]
    assert rows(state.retries_exhausted(s.filter("status = 'failed'")), "seq") == [(3,)]


def test_cdc(spark, rows):
    f = "path string, content_hash string"
    p = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("n", None)], f)
    c = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1"), ("n", None)], f)
    st = cdc.file_status(p, c, ["path"])
    assert rows(st) == [("a", "reused"), ("b", "parsed"), ("c", "deleted"), ("d", "parsed"), ("n", "parsed")]
    assert rows(cdc.build_stats(st.withColumn("r", F.lit(1)), ["r"])) == [(1, 3, 1, 1, 4)]
    assert rows(cdc.stale_ids(p, c, ["path"])) == [("c",)]
    assert rows(cdc.paths_to_build(p, c, c.filter("path = 'd'"))) == [("a",), ("b",), ("c",), ("n",)]


def test_replace_repo(spark, rows, tmp_path):
    at = str(tmp_path / "t")
    cdc.replace_repo(spark.createDataFrame([("r1", 1), ("r2", 2)], "repo_id string, x int"), at)
    cdc.replace_repo(spark.createDataFrame([("r1", 5)], "repo_id string, x int"), at)
    assert rows(spark.read.parquet(at), "repo_id", "x") == [("r1", 5), ("r2", 2)]


# -- documents -------------------------------------------------------------------------------------------------------------


def test_review(spark, rows):
    d = spark.createDataFrame([(1, "# A\n### B\n```\n## not\n```\n`Known` `strange` [x](#gone)"), (2, None), (3, "")], "doc_id int, text string")
    h = review.headings(d, "doc_id", "text")
    assert rows(review.level_jumps(h, "doc_id", "line"), "previous", "level") == [(1, 3)]
    names = spark.createDataFrame([("known",), (None,)], "name string")
    assert rows(review.unknown_terms(d, "doc_id", "text", names)) == [(1, "strange")]
    assert rows(review.bad_links(d, "doc_id", "text", spark.createDataFrame([("there",)], "target string"))) == [(1, "gone")]
    u = spark.createDataFrame([(1, "@startuml\ncomponent Foo\nA_B -> bar.baz\n@enduml"), (2, None)], "doc_id int, text string")
    assert rows(review.diagram_terms(u, "doc_id", "text")) == [(1, "Foo"), (1, "bar.baz")]
    p = spark.createDataFrame([("d", "s1"), ("d", "s2")], "doc string, section string")
    g = spark.createDataFrame([("d", "s1", ["a", "zz"]), ("d", "s3", [])], "doc string, section string, used array<string>")
    assert rows(review.missing_sections(p, g, ["doc", "section"])) == [("d", "s2", "error"), ("d", "s3", "warning")]
    assert rows(review.auto_fixed(p, g, ["doc", "section"], "used", spark.createDataFrame([("a",)], "id string")), "section", "regenerated", "used") == [("s1", False, ["a"]), ("s2", True, [])]


def test_sections(spark, rows):
    lines = spark.createDataFrame([("q", 0, 1, "x" * 10), ("q", 0, 2, "x" * 10), ("q", 1, 1, "x" * 10)], "seed string, part int, rank int, line string")
    assert rows(docs.budget_prefix(lines, 11), "part", "rank") == [(0, 1), (0, 2)]
    assert docs.budget_prefix(lines, 1).count() == 0
    assert one(spark, docs.with_heading(F.lit("body\r\nx"), F.lit("T"), F.lit(2))) == "## T\n\nbody\nx"
    assert one(spark, docs.with_heading(F.lit("# T\nx"), F.lit("T"), F.lit(3))) == "### T\nx"
    assert one(spark, docs.with_heading(F.lit(None).cast("string"), F.lit("T"), F.lit(1))) == "# T"
    assert one(spark, docs.with_banner(F.lit("x"), F.lit(0.31))) == "x"
    assert one(spark, docs.json_text(F.lit('{"name": "n", "summary": ""}'))) == "n"
    assert one(spark, docs.json_text(F.lit("plain"))) == "plain"


def test_diagrams(spark, rows):
    m = spark.createDataFrame([("r", "M_a", "alpha"), ("r", "M_b", "beta")], "repo string, id string, name string")
    e = spark.createDataFrame([("r", "M_a", "M_b", "calls"), ("r", "M_a", "M_b", "calls"), ("r", "M_a", "M_a", "calls")], "repo string, source_module string, target_module string, relation_type string")
    text = diagrams.component(m, e, "repo").first()["diagram"]
    assert text == '@startuml\nskinparam componentStyle rectangle\ncomponent "alpha" as node_M_a\ncomponent "beta" as node_M_b\nnode_M_a --> node_M_b : calls\n@enduml'


def test_summaries(spark, rows):
    f = spark.createDataFrame([("m", "f1", "b.py"), ("m", "f2", "a.py")], "module_id string, id string, path string")
    s = spark.createDataFrame([("f1",)], "file_id string")
    assert rows(summarize.core_files(f, s, ["module_id"]), "id", "n_symbols", "rank") == [("f1", 1, 1), ("f2", 0, 2)]
    assert rows(summarize.core_files(f, s.limit(0), ["module_id"]), "id") == [("f1",), ("f2",)]


# -- recall, embeddings, generation, entry points -----------------------------------------------------------------------------


def test_build_embeddings(spark, rows):
    from graphlens.operators import retrieve

    def encode(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [[3.0, 4.0] if t != "zero" else [0.0, 0.0] for t in texts]

    df = spark.createDataFrame([("r", "1", "module", "a"), ("r", "2", "file", " a "), ("r", "3", "file", "bad"), ("r", "4", "file", " "), ("r", "5", "file", None), ("r", "6", "file", "zero")], "repo_id string, id string, kind string, summary string")
    assert rows(retrieve.build_embeddings(df, encode), "object_id", "embedding") == [("1", [0.6, 0.8]), ("2", [0.6, 0.8]), ("6", [0.0, 0.0])]
    assert retrieve.build_embeddings(df.limit(0), encode).count() == 0


def test_generated_text_falls_back(spark, rows):
    from graphlens.operators import retrieve

    def generate(prompts):
        if any(p == "fail" for p in prompts):
            raise RuntimeError("no")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(1, "hi", "x"), (2, "fail", "sorry")], "id int, prompt string, other string")
    assert rows(retrieve.generated(df, "prompt", generate, "other"), "id", "answer", "failed") == [(1, "HI", False), (2, "sorry", True)]


def test_index_and_ask(spark, rows, tmp_path):
    from graphlens import api

    (tmp_path / "app").mkdir()
    (tmp_path / "app" / "util.py").write_text("def clean(x):\n    return x.strip()\n")
    (tmp_path / "app" / "main.py").write_text("from app.util import clean as c\n\nclass Service:\n    def run(self, x):\n        return c(x)\n")
    g = api.index(spark, str(tmp_path), "repo_1", spark.createDataFrame([("app/util.py", "old"), ("gone.py", "h")], "path string, content_hash string"))
    assert rows(g["symbols"], "qualified_name", "type") == [("Service", "class"), ("Service.run", "method"), ("clean", "function")]
    by = {q: i for q, i in rows(g["symbols"], "qualified_name", "id")}
    assert by["clean"].startswith("S_app.clean_")
    assert (by["Service.run"], by["clean"]) in rows(g["relations"], "source_id", "target_id")
    assert rows(g["status"]) == [("app/main.py", "parsed"), ("app/util.py", "parsed"), ("gone.py", "deleted")]
    assert g["spans"].count() == 5
    again = api.index(spark, str(tmp_path), "repo_1", g["files"].select("path", "content_hash"), g["rows"].withColumn("qualified_name", F.when(F.col("qualified_name") == "clean", "kept").otherwise(F.col("qualified_name"))))
    assert rows(again["status"], "status") == [("reused",), ("reused",)] and "kept" in {q for (q,) in rows(again["symbols"], "qualified_name")}
    anchors = spark.createDataFrame([("q1", "symbol", by["Service.run"], 0.9, "what does clean do"), ("q2", "none", None, 0.0, None)], "seed string, level string, id string, confidence double, question string")
    hits = spark.createDataFrame([("q1", by["clean"], "symbol", 0.8)], "seed string, id string, kind string, similarity double")
    got = {r[0]: r[1] for r in rows(api.ask(g, anchors, hits), "seed", "strategy")}
    assert set(got) == {"q1", "q2"} and got["q2"] == "S4"
    told = rows(api.answer(g, anchors, hits, hits.select("seed", "id")), "seed", "id")
    assert ("q1", by["clean"]) in told and ("q1", by["Service.run"]) not in told


def test_exported_names_and_modules_of_ends(spark, rows):
    from graphlens.operators import resolve

    s = spark.createDataFrame([("r", "S1", "run", "A.run", "F1", "M1"), ("r", "S2", "run", "B.run", "F2", "M2"), ("r", "S3", "go", "go", "F2", "M2")], "scope string, id string, name string, qualified_name string, file_id string, module_id string")
    f = spark.createDataFrame([("r", "F1", "a/one.js", "M1"), ("r", "F2", "b/two.js", "M2")], "scope string, id string, path string, module_id string")
    m = spark.createDataFrame([("r", "M1"), ("r", "M2")], "scope string, id string")
    lookup, local = resolve.unique_keys(resolve.symbol_keys(s, f)), resolve.local_keys(s)
    exports = spark.createDataFrame([("r", "F2", "b/two.js", "export:default", "run"), ("r", "F2", "b/two.js", "export:x", "nowhere")], "scope string, file_id string, path string, export string, raw_id string")
    exported = resolve.export_keys(exports, lookup, local, s)
    assert rows(exported, "key", "id") == [("two.default", "S2")]
    raw = spark.createDataFrame([("r", "F1", "run", "M1"), ("r", "F2", "run", "M2"), ("r", "F1", "two.default", "M1"), ("r", "F1", "gone", "M1"), ("r", "F1", "M2", "M1"), ("r", "F1", "F2", "M1")], "scope string, file_id string, raw_id string, module_id string")
    ends = resolve.end_modules(resolve.resolve(raw, resolve.with_exports(lookup, exported), local), m, f, s)
    assert rows(ends, "file_id", "raw_id", "object_id", "object_module") == [("F1", "F2", "F2", "M2"), ("F1", "M2", "M2", "M2"), ("F1", "gone", "gone", "M1"), ("F1", "run", "S1", "M1"), ("F1", "two.default", "S2", "M2"), ("F2", "run", "S2", "M2")]


# -- keys that hold most rows ----------------------------------------------------------------------------------------------


def _hot(spark):
    import random

    rng = random.Random(3)
    rows = [(1 if i % 10 else i, T0 + timedelta(seconds=rng.choice([0, 1, 30, 59, 60, 7200]) * (i // 7)), i, float(rng.choice([5, 5, 5, i])), None if i % 3 else i) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "k long, t timestamp, i long, v double, x long")


def test_positions_and_values_of_a_hot_key(spark):
    from graphlens.operators import positions

    data, df = _hot(spark)
    own = [r for r in sorted(data, key=lambda r: (r[1], r[2])) if r[0] == 1]
    got = {r["i"]: (r["position"], r["last"]) for r in positions.carried(positions.positioned(df, ["k"], ["t", "i"]), ["k"], ["position"], "x", "last").filter("k = 1").collect()}
    last = None
    for n, r in enumerate(own, 1):
        assert got[r[2]] == (n, last)
        last = r[4] if r[4] is not None else last
    ranks = positions.nearest_rank(df, "k", "v", {"p50": 0.5, "p99": 0.99}).filter("k = 1").first()
    values = sorted(r[3] for r in own)
    assert (ranks["p50"], ranks["p99"]) == tuple(values[round((len(values) - 1) * q)] for q in (0.5, 0.99))
    assert positions.positioned(df.limit(0), ["k"], ["t"]).count() == 0
    same = spark.createDataFrame([(1, 2)] * 50, "k int, t int")
    assert sorted(r["position"] for r in positions.positioned(same, ["k"], ["t"]).collect()) == list(range(1, 51))


@pytest.mark.parametrize("limit,window", [(2, 60), (1, 7200)])
def test_rate_limit_of_a_hot_key(spark, limit, window):
    data, df = _hot(spark)
    want = {}
    for k in {r[0] for r in data}:
        begin, n, windows, accepted, rejected = None, 0, 0, 0, 0
        for t in sorted(r[1] for r in data if r[0] == k):
            if begin is None or t >= begin + timedelta(seconds=window):
                begin, n, windows = t, 0, windows + 1
            n += 1
            accepted, rejected = accepted + (n <= limit), rejected + (n > limit)
        want[k] = (windows, accepted, rejected)
    got = state.rate_limited(df, "k", "t", "i", limit, window)
    assert {r["k"]: (r["windows"], r["accepted"], r["rejected"]) for r in got.collect()} == want


def test_upsert_of_repeated_keys_is_the_same_each_time(spark, rows):
    from graphlens.operators import cdc

    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("b", 9), ("c", None)], "k string, v int")
    assert rows(cdc.upserted(old, new, ["k"])) == [("a", 1), ("b", 9), ("c", None)]


def test_cuts_are_deleted_on_demand(spark):
    from graphlens import tables

    df = tables.cut(spark.range(5), "try")
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 5 and os.path.exists(path)
    assert tables.forget_cuts(spark) >= 1 and not os.path.exists(path) and tables.forget_cuts(spark) == 0


def test_no_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from graphlens import tables

    conf = SimpleNamespace(get=lambda *a: None)
    session = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            tables.shared_dir(session(master))


def test_expansion_from_several_starts(spark, rows):
    from graphlens.operators import traverse

    rel = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "CALLS"), ("a", "z", "inherits"), ("x", "a", "references")], "source_id string, target_id string, relation_type string")
    one_seed = spark.createDataFrame([("a",)], "seed string")
    assert rows(traverse.expand(one_seed, rel, 3)) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("a", "x", 1)]
    starts = spark.createDataFrame([("q", "a"), ("q", "c"), ("q", None)], "seed string, start string")
    assert rows(traverse.expand(starts, rel, 2)) == [("q", "b", 1), ("q", "d", 1), ("q", "x", 1)]
    held = spark.createDataFrame([("b", "F1", "M1"), ("c", "F1", None)], "id string, file_id string, module_id string")
    assert rows(traverse.with_containers(traverse.expand(one_seed, rel, 2), held)) == [("a", "F1", "file", 1), ("a", "M1", "module", 1), ("a", "b", "symbol", 1), ("a", "c", "symbol", 2)]


def test_names_within_names(spark, rows):
    from graphlens.operators import lookup

    o = spark.createDataFrame([("r", "1", "Run", "A.Run"), ("r", "2", "runner", "B.runner"), ("r", "3", "x", "run"), ("q", "4", "rerun", "C"), ("r", "5", None, None), ("r", "6", "ab", "a")], "repo_id string, id string, name string, other string")
    t = spark.createDataFrame([("run ",), ("a",), ("",), (None,), ("nowhere",)], "name string")
    assert rows(lookup.name_search(o, t), "term", "id", "tier") == [("a", "1", 2), ("a", "6", 1), ("run", "1", 0), ("run", "2", 2), ("run", "3", 1), ("run", "4", 2)]
