"""Where a question points to: a selection, a name, what the session was about, or nowhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens import config as C
from graphlens.functions import text as X
from graphlens.operators.lookup import first_of, name_search

#: Words that are no names, parts of a question that goes on, and phrases of one.
STOPWORDS = "what why how when where which who does show explain tell about 实现 作用 为什么 怎么 如何 哪个 哪些".split()
FOLLOW_UP = "它 这个 该 这里 上面 上述 that this it they them method class file".split()
FOLLOW_UP_PHRASES = ("该方法", "这个类", "这个文件", "这个模块", "that method", "this class")
#: More objects than this that bear a question's names, and it points to none.
MOST_MATCHES = 3


def name_candidates(question: Column) -> Column:
    """Quoted names first, then identifiers, in lower case, without stop words; distinct, in order."""
    quoted = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit("[`'\"“”‘’]([A-Za-z_][\\p{L}\\p{N}_./:-]*)[`'\"“”‘’]"), F.lit(1))
    lower = F.transform(quoted, lambda t: F.lower(F.regexp_replace(t, r"^[.,:;()\[\]{}<>]+|[.,:;()\[\]{}<>]+$", "")))
    every = F.array_distinct(F.concat(F.filter(lower, lambda t: F.length(t) > 1), X.identifiers(question)))
    return F.array_except(every, F.array(*[F.lit(w) for w in STOPWORDS]))


def is_follow_up(question: Column) -> Column:
    """Few words with a hint in them, or a phrase that goes on."""
    plain = X.normalised(question)
    hint = F.exists(F.array(*[F.lit(h) for h in FOLLOW_UP]), lambda h: F.contains(plain, h))
    phrase = F.exists(F.array(*[F.lit(p) for p in FOLLOW_UP_PHRASES]), lambda p: F.contains(F.lower(question), p))
    return (plain != "") & (((F.size(F.split(plain, " ")) <= C.FOLLOW_UP_TOKENS) & hint) | phrase)


def inherits(question: Column, focus: Column) -> Column:
    """Whether a question without names takes over the session's anchor: it goes on, and shares a word with the focus, is very short,
    or there is no focus."""
    tokens = F.split(X.normalised(question), " ")
    shared = F.size(F.array_intersect(tokens, F.split(F.coalesce(focus, F.lit("")), " "))) > 0
    short = F.size(tokens) <= max(4, C.FOLLOW_UP_TOKENS // 2)
    return (F.size(name_candidates(question)) == 0) & is_follow_up(question) & (F.coalesce(focus == "", F.lit(True)) | shared | short)


#: Objects of each kind that a name finds.
FOUND_OF_A_KIND = 4


def by_name(questions: DataFrame, objects: DataFrame) -> DataFrame:
    """question_id, id, kind, confidence: the object that a question names; none where more than MOST_MATCHES bear a name in it.

    questions: question_id, repo_id, question; objects: repo_id, id, kind, name, other (as lookup.objects gives them). A name
    finds up to FOUND_OF_A_KIND objects of each kind in the repo: equal names first, then names that hold it, shorter ones
    first. An object counts with the first name that finds it. Its weight: 1 less .1 for each earlier name, plus 1 where the
    name is equal, .7 where it ends with it, .4 where it holds it; ties in the order of names, symbols before files before
    modules, as found. One object gives NAME_EXACT, more NAME_AMBIGUOUS."""
    asked = questions.select("question_id", "repo_id", F.posexplode(name_candidates(F.col("question"))).alias("i", "term"))
    kinds = F.array(*[F.lit(k) for k in ("symbol", "file", "module")])
    found = name_search(objects, asked.select("repo_id", F.explode(kinds).alias("kind"), "term"), FOUND_OF_A_KIND, ("repo_id", "kind"), F.col("kind") == "symbol")
    found = found.withColumn("_k", F.array_position(kinds, F.col("kind")))
    met = first_of(asked.join(found, ["repo_id", "term"]), ["question_id", "id"], ["i", "_k", "rank"])
    names = F.array("n", "o")
    how = F.when(F.array_contains(names, F.col("term")), 10).when(F.exists(names, lambda v: F.endswith(v, F.col("term"))), 7).otherwise(4)
    told = met.groupBy("question_id").agg(F.count("*").alias("n_met"))
    best = first_of(met.withColumn("_w", F.greatest(F.lit(0), 10 - F.col("i")) + how), ["question_id"], [F.col("_w").desc(), "i", "_k", "rank"])
    confidence = F.when(F.col("n_met") == 1, C.NAME_EXACT).otherwise(C.NAME_AMBIGUOUS)
    return best.join(told.filter(F.col("n_met") <= MOST_MATCHES), "question_id").select("question_id", "id", "kind", confidence.alias("confidence"))


def resolved(questions: DataFrame, spans: DataFrame, names: DataFrame, sessions: DataFrame) -> DataFrame:
    """question_id, source, id, confidence: the first of the selection's span, the name, and the session's anchor that is there
    (inherited ones lose INHERIT_DECAY of their confidence); else source none. spans, names: question_id, id, confidence;
    sessions: question_id, id, confidence, takes (whether the question takes it over)."""
    s = spans.select("question_id", F.struct(F.lit("selection").alias("source"), "id", "confidence").alias("_s"))
    n = names.select("question_id", F.struct(F.lit("name_match").alias("source"), "id", "confidence").alias("_n"))
    kept = F.round(F.col("confidence").cast("decimal(10,6)") * F.lit(C.INHERIT_DECAY).cast("decimal(10,6)"), 4).cast("double")
    m = sessions.filter("takes").select("question_id", F.struct(F.lit("memory_inherit").alias("source"), "id", kept.alias("confidence")).alias("_m"))
    none = F.struct(F.lit("none").alias("source"), F.lit(None).cast("string").alias("id"), F.lit(0.0).alias("confidence"))
    rows = questions.select("question_id").join(s, "question_id", "left").join(n, "question_id", "left").join(m, "question_id", "left")
    return rows.select("question_id", F.coalesce("_s", "_n", "_m", none).alias("a")).select("question_id", "a.*")


def clamped(confidence: Column) -> Column:
    """The confidence of an anchor that a second look gave."""
    return F.least(F.lit(C.ANCHOR_WEAK), F.greatest(confidence, F.lit(C.ANCHOR_DEGRADE)))
