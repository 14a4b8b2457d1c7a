import numpy as np
import pytest

from graphlens.llm import similar as S

SCHEMA = "id long, repo_id string, object_id string, object_type string, embedding array<float>, created_at timestamp, kind string"


def brute(rows, k=10, least=0.9):
    last = {}
    for r in sorted(rows, key=lambda r: (r[5] is not None, r[5] or 0, r[0])):
        last[r[1], r[2]] = r
    ok = []
    for r in last.values():
        v = r[4]
        if v is not None and len(v) == 64 and not any(x is None or x != x or abs(x) == float("inf") for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            ok.append((r[0], (r[3] or "").strip().lower(), x / np.sqrt((x * x).sum())))
    pairs = set()
    for i, t, x in ok:
        near = sorted((-round(float(x @ y), 9), j) for j, u, y in ok if u == t and j != i)
        pairs |= {(min(i, j), max(i, j)) for s, j in near[:k] if -s >= least}
    return pairs


def found(spark, rows, **options):
    df = S.most_similar(spark.createDataFrame(rows, SCHEMA), **options)
    return {(min(a, b), max(a, b)) for a, b in df.select("id", "other_id").collect()}


def make(n, seed=1, groups=12, size=6):
    from datetime import datetime, timedelta

    rng = np.random.default_rng(seed)
    out = [(i, "r", f"o{i}", "symbol", rng.standard_normal(64).astype(float).tolist(), datetime(2025, 1, 1), "x") for i in range(n)]
    i = n
    for g in range(groups):
        c = rng.standard_normal(64)
        for _ in range(size):
            v = c + rng.standard_normal(64) * 0.2
            out.append((i, "r", f"o{i}", [" Symbol", "SYMBOL "][i % 2], (v * rng.uniform(0.3, 4)).tolist(), datetime(2025, 1, 1) + timedelta(i), "x"))
            i += 1
    return out


def test_matches_brute_force(spark):
    rows = make(400)
    want, got = brute(rows), found(spark, rows)
    assert len(want) > 100 and got <= want and len(got) >= 0.97 * len(want)


def test_invalid_replaced_and_repeated_rows(spark):
    from datetime import datetime

    t, v = datetime(2025, 1, 1), [1.0] + [0.0] * 63
    rows = [
        (1, "r", "a", "file", v, t, ""), (1, "r", "a", "file", v, t, ""), (2, "r", "b", "FILE ", v, t, ""), (3, "r", "c", "file", None, t, ""), (4, "r", "d", "file", [0.0] * 64, t, ""),
        (5, "r", "e", "file", [float("nan")] * 64, t, ""), (6, "r", "f", "file", v[:63], t, ""), (7, "r", "g", "module", v, t, ""), (8, "r", "h", "file", v, t, ""),
        (9, "r", "h", "file", [0.0, 1.0] + [0.0] * 62, datetime(2026, 1, 1), ""), (10, "r", "i", "file", [None] + v[1:], t, ""), (11, None, None, None, v, None, ""), (12, "r", "k", None, v, None, ""),
    ]
    assert found(spark, rows) == {(1, 2), (11, 12)}
    assert S.most_similar(spark.createDataFrame([], SCHEMA)).count() == 0
    assert S.most_similar(spark.createDataFrame(rows[2:6], SCHEMA)).count() == 0


def test_a_third_of_all_rows_are_copies(spark):
    from datetime import datetime

    rng = np.random.default_rng(3)
    hot = rng.standard_normal(64).tolist()
    rows = make(200) + [(10_000 + i, "q", f"h{i}", "symbol", hot, datetime(2025, 1, 1), "") for i in range(150)]
    near = (np.array(hot) + rng.standard_normal(64) * 0.1).tolist()
    rows.append((50_000, "q", "near", "symbol", near, datetime(2025, 1, 1), ""))
    assert found(spark, rows) == brute(rows)


def test_split_lists_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", 40)
    rows = make(150, seed=5)
    assert found(spark, rows, spread=1) <= brute(rows)
    assert len(found(spark, rows)) >= 0.97 * len(brute(rows))


def test_same_direction_of_another_length(spark):
    from datetime import datetime

    rng = np.random.default_rng(8)
    hot = rng.integers(-8, 9, 64).astype(float)
    rows = [(1000 + i, "q", f"h{i}", "symbol", hot.tolist(), datetime(2025, 1, 1), "") for i in range(150)]
    rows += [(500 + i, "q", f"s{i}", "symbol", (hot * 2.0**i).tolist(), datetime(2025, 1, 1), "") for i in range(1, 6)] + make(50)
    rows = [r[:2] + (f"{n}",) + r[3:] for n, r in enumerate(rows)]
    assert found(spark, rows) == brute(rows)


def test_large_lists_get_lists_of_their_own(spark, monkeypatch):
    rows = make(500, seed=6, groups=40)
    rows += [(10_000 + i, "q", f"r{i}", "rare", r[4], r[5], "") for i, r in enumerate(rows[:60])]
    want = brute(rows)
    monkeypatch.setattr(S, "LIST_ROWS", 64)
    monkeypatch.setattr(S, "OWN_SAMPLE", 48)
    monkeypatch.setattr(S, "BLOCK_ROWS", 16)
    monkeypatch.setattr(S, "SAMPLE_ROWS", 200)
    seen = []
    monkeypatch.setattr(S, "refined", lambda *a, f=S.refined: seen.append(1) or f(*a))
    got = found(spark, rows)
    assert seen and got <= want | got and len(got & want) >= 0.97 * len(want)


@pytest.mark.parametrize("least,recall", [(0.9, 0.99), (0.0, 0.99)])
def test_recall_on_given_vectors(spark, least, recall):
    df = spark.read.parquet("/root/testdata/sf0.01/object_embeddings.parquet")
    got = {(r["id"], r["other_id"]) for r in S.most_similar(df, least=least).collect()}
    rows = df.toPandas().sort_values(["created_at", "id"]).groupby(["repo_id", "object_id"]).tail(1)
    rows["embedding"] = [None if v is None else np.array(v, float) for v in rows["embedding"]]
    rows = rows[[v is not None and len(v) == 64 and bool(np.isfinite(v).all() and v.any()) for v in rows["embedding"]]]
    want, kinds = set(), rows["object_type"].str.strip().str.lower()
    for kind in set(kinds):
        own = rows[kinds == kind]
        x, ids = np.stack([v.astype(float) for v in own["embedding"]]), own["id"].to_numpy()
        x /= np.linalg.norm(x, axis=1)[:, None]
        s = x @ x.T
        np.fill_diagonal(s, -2)
        for i in range(len(ids)):
            near = np.lexsort((ids, -s[i]))[:10]
            want |= {(ids[i], ids[j]) for j in near if s[i, j] >= least}
    assert len(want & got) >= recall * len(want) and len(got) <= len(want) + 0.01 * len(want)


def test_bound_of_the_best_so_far(monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = rng.permutation(3000)
    a, b, _ = S.search_block(ids, x, S.rotation(64), 5, -1.0)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = {(ids[i], ids[j]) for i in range(3000) for j in np.argsort(-s[i])[:5]}
    assert len(a) == 15_000 and len(want & set(zip(a.tolist(), b.tolist()))) >= 0.99 * len(want)


@pytest.mark.parametrize("dim", [5, 64, 100])
def test_upper_bound_holds(dim):
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((300, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = S.Codes(x, S.rotation(dim))
    bound = c.upper(slice(0, 300), slice(0, 300))
    assert ((x @ x.T) <= bound + 1e-3).mean() > 0.985


def test_ties_go_to_smaller_ids():
    a, b, s = S.top_per_row(np.array([1, 1, 1]), np.array([9, 3, 5]), np.array([0.9, 0.9, 0.95]), 2)
    assert list(b) == [5, 3]
