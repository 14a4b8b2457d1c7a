"""Operators on texts: languages, documentation pairs, origins, tokens."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphlens.llm import byte_cnn, docpairs, handwritten, kneser_ney, langlabels, natural, prose, tokens
from graphlens.llm.peg import absent, choice, emit, many, parse, rule, seq, token
from graphlens.tables import table


@pytest.fixture(scope="module")
def labelled(spark):
    texts, labels, langs = prose.labelled_sentences(table(spark, "/root/testdata/sf0.01", "documents"))
    order = np.random.default_rng(1).permutation(len(texts))
    return [texts[i] for i in order], labels[order], langs


# -- prose ---------------------------------------------------------------------------------------------------------------


def test_lang_codes():
    assert prose.lang_codes("de-AT") == {"de"} and prose.lang_codes(" German ") == {"de"} and prose.lang_codes("zh_Hans") == {"zh"} and prose.lang_codes("deu") == {"de"}
    assert not any(prose.lang_codes(x) for x in (None, "", "und", "n/a", "-", "xx", "mul", "unknown"))


def test_document_sentences():
    text = "# Head line of this document here\n\nThe scanner reads every file once. Short one.\n```python\nx = 'this is all code and nothing else'\n```\n> 当前会话退回到原始名称，并丢弃没有终点的关系。\n"
    assert [s for s, _, _ in prose.document_sentences(text)] == ["The scanner reads every file once.", "当前会话退回到原始名称,并丢弃没有终点的关系。"]
    assert prose.document_sentences(None) == [] == prose.document_sentences(" \n ")
    assert prose.is_prose("for (int i = 0; i < n; i++) store(i);") is None


def test_kneser_ney_on_held_out_text(labelled):
    texts, labels, langs = labelled
    cut = len(texts) * 3 // 4
    m = kneser_ney.CharModels(texts[:cut], labels[:cut], len(langs))
    assert (m.scores(texts[cut:]).argmax(1) == labels[cut:]).mean() > 0.97
    assert m.scores([]).shape == (0, len(langs)) and np.isfinite(m.scores(["", "🚀", "x" * 10_000])).all()


def test_kneser_ney_shares_out_probability():
    m = kneser_ney.CharModels(["abab abba " * 50, "cdcd " * 50], np.array([0, 1]), 2)
    for keys, logp in zip(m.keys[1:], m.logp[1:]):
        context = keys.keys >> np.uint64(16)
        for c in np.unique(context):
            assert np.exp(logp[context == c]).sum(0).max() <= 1.0001
    assert m.scores(["abba", "cdcd"]).argmax(1).tolist() == [0, 1]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 2**63), min_size=1, max_size=200, unique=True))
def test_lookup(keys):
    k = np.array(sorted(keys), np.uint64)
    assert (kneser_ney.Lookup(k)(k) == np.arange(len(k))).all()
    assert (kneser_ney.Lookup(k[::2])(k[1::2]) == -1).all()


def test_byte_network_on_held_out_text(labelled):
    texts, labels, langs = labelled
    cut = len(texts) * 3 // 4
    net = byte_cnn.fit_texts(texts[:cut], labels[:cut], len(langs))
    x, of = byte_cnn.windows(texts[cut:])
    total = np.zeros((len(texts) - cut, len(langs)))
    np.add.at(total, of, net.log_probabilities(x))
    assert (total.argmax(1) == labels[cut:]).mean() > 0.97


def test_windows_hold_every_byte():
    x, of = byte_cnn.windows(["", "a" * 500])
    assert of[0] == 0 and (x[of == 1] == ord("a")).any(1).all() and (of == 1).sum() * byte_cnn.STRIDE + byte_cnn.WINDOW >= 500


def test_smoothing_follows_neighbours():
    s = np.log(np.array([[0.9, 0.1], [0.45, 0.55], [0.9, 0.1]]))
    assert list(langlabels.smoothed(s)) == [0, 0, 0]
    s = np.array([[0, -9.0], [-9.0, 0], [-9.0, 0]])
    assert list(langlabels.smoothed(s)) == [0, 1, 1]


# -- natural language in code --------------------------------------------------------------------------------------------


def _runs(text, language=""):
    return [r.strip(" \"'`/*") for _, r in natural.marked_runs([text], np.array([natural.FAMILY[language]]))]


@pytest.mark.parametrize(
    "language,text,want",
    [
        ("python", 'x = call(1)  # a comment of some words\ns = "a string \\"of\\" words"', ["x = call(1)", "# a comment of some words", '"a string \\"of\\" words"']),
        ("python", 'def f():\n    """One line of text.\n\n    Another \'line\' of text."""\n    return g(a, b)', ['"""One line of text.', "Another 'line' of text.\"\"\"", "return g(a, b)"]),
        ("java", "int a = b(); /* one comment of words\n that goes on */ int c = d();", ["int a = b();", "/* one comment of words", "that goes on */", "int c = d();"]),
        ("javascript", "throw new Error('the index could not be read from disk');", ["'the index could not be read from disk'"]), ("javascript", "log(`the index could not\nbe read from disk`);", ["`the index could not", "be read from disk`"]),
        ("rust", "fn f<'a>(x: &'a str) { log(\"words of a string\") }", ['"words of a string"']), ("c", "don't stop reading here, it's all plain", ["don't stop reading here, it's all plain"]),
        ("", 'Returns the "default" value of the key that is given.', ['Returns the "default" value of the key that is given.']), ("", "http://plain words stay here", ["http://plain words stay here"]),
        ("", '/**\n * >>> f(a, b)  # The loader skips large files.\n *     assert f() , "It skips \'small\' files, too."\n */', ["# The loader skips large files.", "\"It skips 'small' files, too.\""]),
    ],
)
def test_marked_runs(language, text, want):
    assert _runs(text, language) == [x.strip(" \"'`/*") for x in want]


def test_mask_of_long_texts(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "b ", '"', "'", "\n", "/", "*", "#", "\\", "`", "é"]) for _ in range(rng.choice([0, 3, 50, 700]))) for _ in range(40)]
    family = np.array([i % len(natural.FAMILY) for i in range(len(texts))])
    whole = natural.marked_runs(texts, family)
    mask = natural.part_mask(*natural._bytes(natural.pa.array(texts)), family)
    monkeypatch.setattr(natural, "CHUNK", 16)
    monkeypatch.setattr(natural, "TOGETHER", 1 << 10)
    assert natural.marked_runs(texts, family) == whole and (natural.part_mask(*natural._bytes(natural.pa.array(texts)), family) == mask).all()


def test_one_text_of_20_mb():
    line = 'call(a, b);  // The loader skips large files because nobody reads them.\n'
    which, words, sizes = natural.prose_of(["Reads every file of the folder once.", line * (20_000_000 // len(line)), "x" * 2_000_000, "- " * 500_000 + "a"])
    assert which.count(1) == 20_000_000 // len(line) and which.count(0) == 1 and len(set(words)) == 2


def test_json_values():
    assert sorted(natural.json_values('{"a": "x y", "b": ["z \\u00e9"], "c": {"d": "q"}}')) == ["q", "x y", "z é"]
    assert natural.json_values('{"a": "whole text", "b": "broken off he') == ["whole text", "broken off he"]
    assert natural.json_values("prose") == ["prose"]


def test_language_shares(spark, rows):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    s = "repo_id string, id string, file_id string, doc string, summary string, indexed_at timestamp, lang string"
    from datetime import datetime

    t, new = datetime(2025, 1, 1), datetime(2026, 1, 1)
    data = [
        ("r", "1", "f", "Every nightly job reads each source file once.", None, t, ""),
        ("r", "1", "f", "Ein leerer Lauf vergisst den alten Schwerpunkt und wartet auf die Freigabe.", '{"excerpt": "log(\\"Die Prüfung wartet auf die Freigabe der Sperre.\\")"}', new, ""),
        ("r", "1", "f", "Ein leerer Lauf vergisst den alten Schwerpunkt und wartet auf die Freigabe.", '{"excerpt": "log(\\"Die Prüfung wartet auf die Freigabe der Sperre.\\")"}', new, ""),
        ("r", "2", "g", None, "", t, ""), ("r", "3", "h", "TODO", "def f(a, b, c, d, e): return a", None, ""),
        ("r", "4", "k", "The scanner " + "keeps the resolved edges in memory and " * 2000 + "stops.", None, t, ""),
    ]
    df = spark.createDataFrame(data, s)
    assert rows(natural.language_shares(df, docs), "file_id", "lang", "share") == [("f", "de", 1.0), ("k", "en", 1.0)]
    assert natural.language_shares(df.limit(0), docs).count() == 0 == natural.language_shares(df, docs.limit(0)).count()


# -- documentation pairs ---------------------------------------------------------------------------------------------------


def test_packrat():
    calls = []

    def counted(text, at, memo):
        calls.append(at)
        return token("a")(text, at, memo)

    a = rule("a", counted)
    g = seq(many(choice(seq(a, token("x")), seq(a, emit("b", "b")))), absent(token(".")))
    assert parse(g, "abab") == (("b", 1, 2, "b"), ("b", 3, 4, "b")) and calls == [0, 2, 4] and parse(g, "abz") is None


@pytest.mark.parametrize(
    "doc,want",
    [
        ("/**\n * Reads every source file once.\n *\n * @param x the file\n */", "Reads every source file once."),
        ('"""Blocks until the queue has drained."""', "Blocks until the queue has drained."),
        ("// 当前会话退回到原始名称，并丢弃没有终点的关系。", "当前会话退回到原始名称，并丢弃没有终点的关系。"),
        ("Thread-safe; callers may share one instance.\n\n>>> f()  # The loader skips large files always.", "Thread-safe; callers may share one instance."),
        ("Licensed under the terms given in NOTICE. Redistribution must keep this paragraph.\n\nMutates its argument in place.", "Mutates its argument in place."),
        ("TODO: document this.", None), ("(non-Javadoc)", None), ("Siehe oben.", None), ("同上。", None), ("Auto-generated method stub", None), ("Sort span method.", None), ("SORT SPAN", None),
        ("sort_span: sort span", None), (":param a:\n:return:", None), ("Args:\n    self:", None), ("-----------", None), ("/** */", None), ("if (a != null) { b(a); }", None), ("return self.x(a, b)", None),
        ("Copyright the project authors. Use of this source is governed by the licence file.", None), ("```\nThe text in here is code after all.\n```", None), ("", None), ("#", None),
    ],
)
def test_description(doc, want):
    assert docpairs.description(doc, "sort_span") == want


@pytest.mark.parametrize(
    "doc,want",
    [
        ("/**\n * @brief Reads every source file once.\n * @param x tells which of the files is read first\n */", "Reads every source file once."),
        (":return: the largest number of open files so far", "the largest number of open files so far"), ("@return", None), ("@returns {string} sort span", None),
    ],
)
def test_tags_about_the_function(doc, want):
    assert docpairs.description(doc, "sort_span") == want


@pytest.mark.parametrize(
    "language,signature,name,parameters,returns",
    [
        ("go", "func (s *T) Run(a string, b func(int) error) (int, error) {", "Run", "a string, b func(int) error", "(int, error)"), ("go", "func Map[K any](x []K) []K {", "Map", "x []K", "[]K"), ("go", "func f()", "f", "", ""),
        ("rust", "pub fn f(x: &str) -> Vec<u8> {", "f", "x: &str", "Vec<u8>"), ("rust", "pub(crate) async unsafe fn g<'a, T: Into<U>>(&'a self, t: T) -> Result<(), E> where T: Copy {", "g", "&'a self, t: T", "Result<(), E>"),
        ("javascript", "export const f = (a, b = g(1)) => {", "f", "a, b = g(1)", ""), ("javascript", "async load(id) {", "load", "id", ""), ("javascript", "static get size(): number {", "size", "", "number"), ("javascript", "constructor(private readonly a: A) {", "constructor", "private readonly a: A", ""),
        ("javascript", "export default async function* walk<T>(x: T): AsyncIterable<T> {", "walk", "x: T", "AsyncIterable<T>"), ("javascript", "const one = x => x", "one", "x", ""), ("javascript", "get(key) {", "get", "key", ""), ("javascript", "public async save(x: Map<string, number>): Promise<void> {", "save", "x: Map<string, number>", "Promise<void>"),
        ("python", "async def f(a, b=(1, 2), *c) -> dict[str, int]:", "f", "a, b=(1, 2), *c", "dict[str, int]"), ("python", "f(a, b)", "f", "a, b", ""), ("python", "def g(x=')'):", "g", "x=')'", ""),
        ("java", "@Override public static <T extends A<T>> List<Map<String, T>> of(final T x, int... y) throws E, F {", "of", "final T x, int... y", "List<Map<String, T>>"), ("java", "private Cache(int size) {", "Cache", "int size", ""), ("java", "int[] sizes();", "sizes", "", "int[]"),
        ("cpp", "std::string A::go(int x) const noexcept {", "go", "int x", "std::string"), ("cpp", "template <typename T> inline const std::vector<T>& ns::Box<T>::all() const", "all", "", "const std::vector<T>&"), ("cpp", "Cache::Cache(int n) : n_(n) {", "Cache", "int n", ""), ("cpp", "~Cache() = default;", "~Cache", "", ""), ("cpp", "bool operator==(const A& b) const {", "operator==", "const A& b", "bool"), ("cpp", "auto f(int a) -> int {", "f", "int a", "int"),
        ("c", "static const char *name_of(struct item *x, int (*f)(int)) {", "name_of", "struct item *x, int (*f)(int)", "const char"), ("c", "unsigned long count(void);", "count", "void", "unsigned long"),
    ],
)
def test_signatures(language, signature, name, parameters, returns):
    parsed, n, p, r, begin, end = docpairs.signature_parts(signature, language)
    assert (parsed, n, p) == (True, name, parameters) and r.rstrip(" *") == returns and signature[begin:end] == name


def test_signatures_that_no_grammar_takes():
    assert docpairs.signature_parts("???", "java") is None and docpairs.signature_parts("f(a)", "") is None and docpairs.signature_parts("class A {", "java") is None
    assert docpairs.signature_parts("f(" * 50_000, "python") is None


def test_offsets_of_descriptions():
    doc = "/**\n * sort span\n * Reads every source file once. See above. Keeps the newest row of each key.\n */"
    text, begin, end = docpairs.described(doc, "sort_span")
    assert text == "Reads every source file once. Keeps the newest row of each key." and doc[begin:end].startswith("Reads every") and doc[begin:end].endswith("of each key.")


def test_function_pairs(spark, rows):
    s = "repo_id string, id string, file_id string, name string, type string, signature string, doc string, start_line int, end_line int, indexed_at timestamp, description string"
    from datetime import datetime

    t, good = datetime(2025, 1, 1), "Reads every source file once and again."
    data = [
        ("r", "1", "f", "a", " Function ", "a(x)", good, 1, 2, t, "clash"), ("r", "1", "f", "a", " Function ", "a(x)", good, 1, 2, t, "clash"), ("r", "2", "f", "b", "class", "b", good, 1, 2, t, ""),
        ("r", "3", "f", "c", "METHOD", " ", good, 1, 2, t, ""), ("r", "4", "f", "d", "method", "d()", None, 1, 2, t, ""), ("r", "5", "f", None, "method", "e()", good, None, None, None, ""),
        ("r", "6", "f", "g", "method", "g()", good, 1, 2, t, ""), ("r", "6", "f", "g", "method", "g()", "TODO", 1, 2, datetime(2026, 1, 1), ""), ("r", "7", "f", "h", None, "h()", good, 1, 2, t, ""),
    ]
    df = spark.createDataFrame(data, s)
    pairs = docpairs.function_pairs(df)
    assert rows(pairs, "symbol_id") == [("1",), ("5",)]
    src = spark.createDataFrame([("r", "f", "a/b.py", "\ufeffone\r\ntwo\r\nthree")], "repo_id string, file_id string, path string, content string")
    assert rows(docpairs.with_source(pairs, src, df), "symbol_id", "source") == [("1", "one\ntwo"), ("5", None)]
    assert rows(docpairs.function_pairs(df, src), "symbol_id", "language", "parsed", "name", "parameters") == [("1", "python", True, "a", "x"), ("5", "python", True, "e", "")]
    assert rows(pairs, "symbol_id", "language", "parsed", "name", "parameters") == [("1", "", False, "a", None), ("5", "", False, "", None)]
    assert docpairs.with_source(pairs.limit(0), src, df).count() == 0 == docpairs.function_pairs(df.limit(0), src.limit(0)).count()
    assert docpairs.function_pairs(df.limit(0)).count() == 0


def test_a_file_with_very_many_functions(spark, monkeypatch):
    monkeypatch.setattr(docpairs, "TOGETHER", 10)
    s = "repo_id string, id string, file_id string, name string, type string, signature string, doc string, start_line int, end_line int, indexed_at timestamp"
    df = spark.createDataFrame([("r", str(i), "f", "a", "function", "a(x)", "Reads every source file once and again.", i + 1, i + 1, None) for i in range(200)], s)
    src = spark.createDataFrame([("r", "f", "f.py", "\n".join(map(str, range(150))))], "repo_id string, file_id string, path string, content string")
    got = {r["symbol_id"]: r["source"] for r in docpairs.with_source(docpairs.function_pairs(df, src), src, df).collect()}
    assert got == {str(i): str(i) if i < 150 else None for i in range(200)}


def test_function_pairs_in_any_script(spark, rows):
    s = "repo_id string, id string, file_id string, name string, type string, signature string, doc string, start_line int, end_line int, indexed_at timestamp"
    docs = ["缓存层只要分支发生了移动，就会等待锁被释放。", "/**\n * Сканер читает каждый исходный файл только один раз.\n */", "キャッシュ層は分岐が動くとロックの解放を待つ。", "同上。", "// -----", "Позже."]
    df = spark.createDataFrame([("r", str(i), "f", "a", "function", "a(x)", d, 1, 2, None) for i, d in enumerate(docs)], s)
    assert rows(docpairs.function_pairs(df), "symbol_id") == [("0",), ("1",), ("2",)]


# -- files not written by hand ---------------------------------------------------------------------------------------------

_CODE = "import os\n\ndef f(a):\n    # The scanner reads every file once.\n    return a\n"


@pytest.mark.parametrize(
    "path,text,kind",
    [
        ("a/x.py", _CODE, "written"), ("a/__init__.py", "", "written"), ("a/x.py", None, "written"), ("a/x.py", _CODE * 500, "written"), ("domain.min_max.js", _CODE, "written"),
        ("a/x.py", "# Copyright the project authors. Use is governed by the licence file.\n" + _CODE, "written"), ("a/x.py", '"""Auto-generated method stub"""\n' + _CODE, "written"),
        ("gen/x.py", _CODE, "written"), ("gen/x.py", "import os\n\ndef f(a):\n    return a\n", "generated"), ("a/x.py", "import os\n# Code generated by tool. DO NOT EDIT.\n" + _CODE, "generated"),
        ("a/x.go", "// 本文件由工具自动生成，请勿手工修改。\npackage a\n", "generated"), ("a/x.js", "// libx v1.2.3 - upstream release, do not patch here\n" + _CODE, "vendored"), ("node_modules/x/y.js", _CODE, "vendored"),
        ("a/x.js", "!function(a){b.c=a()}(function(){return d});" * 60, "minified"), ("a/x.js", "const A = [\n" + "  12345, 67890, 13579, 24680,\n" * 40 + "];\n", "data"),
        ("a/x.py", "A = [\n" + '  "' + "0123456789abcdef" * 3 + '",\n' + ('  "' + "fedcba9876543210" * 3 + '",\n') * 30 + "]\n", "data"),
    ],
)
def test_file_origins(spark, path, text, kind):
    f = spark.createDataFrame([("r", path, None, None, "x")], "repo_id string, path string, language string, end_line int, kind string")
    s = spark.createDataFrame([("r", "./" + path, text)] * 2, "repo_id string, path string, content string")
    assert [tuple(r) for r in handwritten.file_origins(f, s).select("path", "kind").collect()] == [(path, kind)]


def test_layout_by_language(spark):
    sparse = "func f() {\n" + "    a.b(c, d, e, f, g)\n" * 30 + "}\n"
    wide = "x=" + "a.b(c)," * 7 + ";"
    texts = [("a.go", sparse, "machine"), ("b.go", "// " + "The scanner reads every file once. " * 8 + "\n" + sparse, "written"), ("c.js", (wide * 9 + "\n") * 3, "minified"), ("d.go", (wide * 9 + "\n") * 3, "written"), ("e.min.js", wide * 5, "minified"), ("f.js", wide * 5, "written"), ("g.c", None, "written"), ("h.c", "1, 2,\n" * 8, "data"), ("h2.c", "1, 2,\n" * 7, "machine")]
    f = spark.createDataFrame([("r", p, None, None) for p, _, _ in texts] + [("r", "i.py", None, 3)], "repo_id string, path string, language string, end_line int")
    s = spark.createDataFrame([("r", p, t) for p, t, _ in texts], "repo_id string, path string, content string")
    got = {r["path"]: r["layout"] for r in handwritten.file_origins(f, s).collect()}
    assert got == {p: k for p, _, k in texts} | {"i.py": None}
    assert set(handwritten.LIMITS) == set(prose.LANGUAGE_OF) | {""}


def test_markers_after_a_long_licence():
    licence = ["Use is governed by the licence file.", "It may be copied as a whole."] * 5
    tool = handwritten.STATS.split(", ").index("tool boolean")
    slashes = "".join(f"// {x}\n" for x in licence)
    block = "/*\n" + "\n".join(licence) + "\n"
    for text, want in [
        (slashes + "\n// Code generated by tool. DO NOT EDIT.\npackage a\n", True), (block + "Code generated by tool. DO NOT EDIT.\n*/\nint a;\n", True), (block + "*/\n// Code generated by tool. DO NOT EDIT.\nint a;\n", True),
        ("// " + "x " * 150 + "Code generated by tool. DO NOT EDIT.\npackage a\n", True), (slashes + "package a\n" + "// Code generated by tool. DO NOT EDIT.\n", True), (slashes + "package a\nvar x = \"// Code generated by tool. DO NOT EDIT.\"\n", False), (block + "*/\nint a;\n", False),
    ]:
        assert handwritten.statistics(text)[tool] is want
    assert handwritten.statistics(slashes + "// libx v1.2.3 - upstream release, do not patch here\nf();\n")[tool + 1]


def test_file_origins_of_empty_tables(spark):
    f = spark.createDataFrame([("r", "vendor/lib-1.2.0/x.js", "js", 3), ("r", None, "js", 3)], "repo_id string, path string, language string, end_line int")
    s = spark.createDataFrame([], "repo_id string, path string, content string")
    assert [r["kind"] for r in handwritten.file_origins(f, s).collect()] == ["vendored"]
    assert handwritten.file_origins(f.limit(0), s).count() == 0


# -- tokens ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.read_vocabulary())


@pytest.fixture(scope="module")
def cutter():
    return tokens.Cutter(tokens.narrowed(r"\p{L}"), tokens.narrowed(r"\p{N}"))


def _tree(encoder, cutter, text, size):
    leaves = cutter.leaves(text, size)
    assert leaves[0][0] == 0 and leaves[-1][1] == len(text) and all(a[1] == b[0] and 0 < a[1] - a[0] <= size for a, b in zip(leaves, leaves[1:]))
    return encoder.encode(text, leaves)[0]


def test_tree_concatenation_is_exact(encoder, cutter, monkeypatch):
    monkeypatch.setattr(tokens, "LOOK", 8)
    rng = random.Random(1)
    alphabets = ["a", "abcdeé中文 ", " ", "=-#'!", "0123 ab'\n", "'sltd ", "\n\r a", "\u088fa\u0558b1\U00011de1 "]
    for n in range(400):
        text = rng.choice(["", "don't "]) + "".join(rng.choice(alphabets[n % 8]) for _ in range(rng.randint(30, 700))) + rng.choice(["", "'ll", "'s x", "z"])
        assert _tree(encoder, cutter, text, rng.choice([7, 24, 40, 64])) == encoder.ids(text)


@pytest.mark.parametrize("marks,letters,times", [("'", "s", 4096), ("\n", "a", 4096), ("'", "re", 2048), (" ", "'ve", 2048), ("=", "1", 4096), (" ", "é", 3000)])
def test_runs_that_meet_at_a_cut(encoder, cutter, marks, letters, times):
    for size in (tokens.LEAF, 64):
        for off in range(-24, 25):
            text = marks * (tokens.LEAF + off) + letters * times
            assert _tree(encoder, cutter, text, size) == encoder.ids(text)


def test_runs_at_the_cuts_of_longer_parts(encoder, cutter):
    for text in ("'" * (32768 - 16) + "s" * 131072, "'" * (32768 - 15) + "s" * 131072, "\n" * (32768 - 16) + "a" * 131072, "'" * (32768 - 15) + "re" * 131072):
        assert _tree(encoder, cutter, text, 32768) == encoder.ids(text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=300), st.integers(3, 50))
def test_tree_of_any_text(encoder, cutter, text, size):
    if text:
        assert _tree(encoder, cutter, text, size) == encoder.ids(text)


def test_given_documents_by_their_trees(spark, encoder):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    want = {r["doc_id"]: encoder.ids(r["text"] or "") for r in docs.collect()}
    assert max(map(len, (r["text"] or "" for r in docs.collect()))) > tokens.LEAF
    for leaf, segment in ((tokens.LEAF, tokens.SEGMENT), (32, 64)):
        assert {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(docs, leaf=leaf, segment=segment).collect()} == want


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300))
def test_same_as_the_other_library(encoder, text):
    from tokenizers import Tokenizer

    global _other
    if "_other" not in globals():
        _other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
        _other.encode_special_tokens = True
    assert encoder.ids(text) == _other.encode(text, add_special_tokens=False).ids


def test_encode_corpus(spark, encoder):
    texts = [None, "", "<|endoftext|>", "x" * 500, "The scanner reads. " * 60, " " * 300 + "a"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(4, texts[4], "again"), (3, "y" * 400, "")], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in tokens.encode_corpus(df, leaf=16, segment=64).collect())
    assert got == sorted([(i, encoder.ids(t or "")) for i, t in enumerate(texts)] + [(4, encoder.ids(texts[4])), (3, encoder.ids("y" * 400))])
    assert tokens.encode_corpus(df.limit(0)).count() == 0


# -- labels ----------------------------------------------------------------------------------------------------------------


def test_document_languages(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang", "text")
    de = "Ein leerer Lauf vergisst den alten Schwerpunkt. Die Prüfung wartet auf die Freigabe der Sperre."
    en = "The scanner falls back to the raw name. Each parser adapter drops relations that point nowhere."
    extra = [(-1, "en", f"{en}\n\n{de}"), (-2, None, de), (-3, "German", de), (-4, "de", None), (-5, "de", "  "), (-6, "xx", "```\ncode only here, really\n```"), (-7, "fr", en.upper())]
    df = docs.unionByName(spark.createDataFrame(extra, "doc_id long, lang string, text string"))
    got = langlabels.document_languages(df).filter("doc_id < 0 and sentences >= 2").collect()
    assert sorted((r["doc_id"], r["lang"], r["named"]) for r in got) == [(-7, "en", False), (-3, "de", True), (-2, "de", False), (-1, "de", False), (-1, "en", True)]
    assert all(0 < r["confidence"] <= 1 for r in got)
    assert langlabels.document_languages(df.limit(0)).count() == 0
