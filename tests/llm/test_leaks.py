import numpy as np
import pytest

from graphlens.llm import leaks
from graphlens.tables import table

ITEM = "Trace the value of count_record through trimCursorDiagram and name the line where store_session overwrites it once more today"


def test_words():
    assert leaks.words("<b>Fo&amp;o_Bar</b>\u200b exam-\nple\n> ﬁrst  １２ 中文。") == ["fo", "o", "bar", "example", "first", "12", "中", "文"]
    assert leaks.words(None) == leaks.words("") == leaks.words("—…") == []


def test_longest_common():
    a, b = np.array([1, 2, 0, 3, 4]), np.array([9, 1, 2, 5, 3, 4])
    assert leaks.longest_run(a, b) == 2
    assert leaks.subsequence(np.array([[1, 2, 0, 3, 4, 0]]), np.array([[9, 1, 2, 5, 3, 4]])).tolist() == [4]


def test_signatures_leave_no_paraphrase_out():
    rng = np.random.default_rng(4)
    b = rng.integers(1, 60, (3000, 24))
    b[rng.random(b.shape) < 0.1] = -1
    a = np.where(rng.random(b.shape) < 0.2, rng.integers(0, 60, b.shape), np.maximum(b, 0))
    k, _ = leaks.paraphrased(a, b)
    ok = leaks.possible(leaks.signatures(a), leaks.signatures(b), (b >= 0).sum(1))
    assert len(k) > 500 and ok[k].all()
    assert not leaks.possible(leaks.signatures(a), leaks.signatures(b + 1000), (b >= 0).sum(1)).all()


def test_longest_run():
    rng = np.random.default_rng(0)
    for _ in range(300):
        x, y = rng.integers(0, 4, rng.integers(0, 30)), rng.integers(0, 4, rng.integers(1, 30))
        runs = [n for i in range(len(x)) for j in range(len(y)) for n in range(1, 30) if i + n <= len(x) and j + n <= len(y) and (x[i : i + n] == y[j : j + n]).all() and (x[i : i + n] > 0).all()]
        assert leaks.longest_run(x, y) == max(runs, default=0)


def brute(items, docs):
    want = set()
    for i, lang, t in items:
        w, n = leaks.words(t), 24 if lang == "zh" else 12
        own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for d, text in docs:
            x = leaks.words(text)
            if any(tuple(x[k : k + n]) in own for k in range(len(x) - n + 1)):
                want.add((d, i))
    return want


def test_given_tables_match_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs, items = table(spark, d, "documents"), table(spark, d, "eval_items")
    want = brute([tuple(r) for r in items.select("item_id", "lang", "text").collect()], [tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = {tuple(r) for r in leaks.leaked_items(docs, items).filter("kind = 'verbatim'").select("doc_id", "item_id").collect()}
    assert want and got == want


def test_edges(spark):
    w = ITEM.split()
    noise = "Every nightly job reads each source file once and rounds the score to four digits before the next stage begins. " * 3
    docs = [(1, noise + " ".join(w[:12])), (2, noise + " ".join(w[:9]) + " maybe " + " ".join(w[9:15])), (3, ITEM.upper()), (4, None), (5, ""), (6, " ".join(f"> {x}\n" for x in w)), (3, ITEM), (7, "word " * 50_000 + ITEM)]
    items = [(1, "en", ITEM), (2, "en", ITEM), (3, "en", "too short"), (4, "en", None), (5, None, "")]
    dd = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, item_id string")
    ii = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, lang string, text string, doc_id string")
    got = {tuple(r) for r in leaks.leaked_items(dd, ii).filter("kind = 'verbatim'").select("doc_id", "item_id").collect()}
    assert got == {(d, i) for d in (1, 3, 6, 7) for i in (1, 2)}
    assert leaks.leaked_items(dd, ii.limit(0)).count() == 0
    assert leaks.leaked_items(dd.limit(0), ii).count() == 0


@pytest.mark.parametrize("block", [20, 60])
def test_blocks_of_items(spark, monkeypatch, block):
    monkeypatch.setattr(leaks, "BLOCK_TERMS", block)
    dd = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    ii = spark.createDataFrame([(i, "en", ITEM) for i in range(3)], "item_id long, lang string, text string")
    assert leaks.leaked_items(dd, ii).count() == 3


def test_leaks_that_stand_in_a_third_of_the_documents(spark):
    run, rng = ITEM.split()[:12], np.random.default_rng(5)
    docs = []
    for n in range(600):
        w = [f"w{k}" for k in rng.integers(0, 50_000, 120)]
        if n % 3 == 0:
            at = int(rng.integers(0, len(w)))
            w[at:at] = run
        docs.append((n, " ".join(w)))
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    ii = spark.createDataFrame([(1, "en", ITEM), (2, "en", "Which of the adapters drops a relation that points nowhere, and in which order are the others resolved")], "item_id long, lang string, text string")
    got = leaks.leaked_items(dd, ii).filter("kind = 'verbatim'")
    assert {tuple(r) for r in got.select("doc_id", "item_id").collect()} == {(n, 1) for n in range(0, 600, 3)}
    assert got.filter(f"cosine < {leaks.LEAST_COSINE}").count() == 0


def test_paraphrases_of_all_passages():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 9, (4000, leaks.PASSAGE)), rng.integers(1, 9, (4000, leaks.PASSAGE))
    b[:2000] = np.where(rng.random((2000, leaks.PASSAGE)) < 0.8, a[:2000], b[:2000])
    b[np.arange(leaks.PASSAGE) >= rng.integers(8, 25, 4000)[:, None]] = -1
    size = (b >= 0).sum(1)
    share = leaks.subsequence(a, np.maximum(b, 0)) / size
    want = np.flatnonzero((size >= leaks.LEAK) & (share >= leaks.PARAPHRASE))
    at, got = leaks.paraphrased(a, b)
    assert 0 < len(want) < 4000 and at.tolist() == want.tolist() and np.allclose(got, share[want])


def test_paraphrase_in_a_passage_that_is_not_the_most_similar(spark):
    w = leaks.words(ITEM + " before the next stage begins to read it")
    part = [x if k % 4 != 3 else f"other{k}" for k, x in enumerate(w[:24])]  # 18 of 24 words, 3 in a row at most
    rare = " ".join(w[18:24] + w[12:18] + w[6:12] + w[:6])  # all words, but no order
    docs = [(1, rare + " " + " ".join(part)), (2, " ".join(part)), (3, rare)] + [(n, f"filler{n} words that stand nowhere else{n}") for n in range(4, 40)]
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    ii = spark.createDataFrame([(1, "en", " ".join(w))], "item_id long, lang string, text string")
    got = {r["doc_id"] for r in leaks.leaked_items(dd, ii).filter("kind = 'paraphrase'").collect()}
    assert got == {1, 2}
