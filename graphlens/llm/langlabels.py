"""Missing or wrong language labels: each stretch of a document gets a language from a byte convolutional network."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm.byte_cnn import fit_texts, windows
from graphlens.llm.prose import document_sentences, labelled_sentences, lang_codes
from graphlens.tables import shipped, table

#: What a change of language between two sentences costs, in log probability: a doubtful sentence follows its neighbours.
SWITCH = 2.5
OUT = "doc_id long, stretch int, lang string, sentences int, chars int, confidence double, first string, named boolean"


def smoothed(score: np.ndarray) -> np.ndarray:
    """The best language of each sentence of one document, changes of language at the price SWITCH (Viterbi)."""
    best = score.argmax(1)
    if (best == best[0]).all():
        return best
    total, back = score[0], []
    for row in score[1:]:
        stay = total >= total.max() - SWITCH
        back.append(np.where(stay, np.arange(len(total)), total.argmax()))
        total = np.maximum(total, total.max() - SWITCH) + row
    path = [int(total.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return np.array(path[::-1])


def stretches(texts: list[str | None], net, langs: list[str]) -> list[list[tuple[str, int, int, float, str]]]:
    """Of every text its stretches (language, full sentences, characters, mean probability, first sentence) in order."""
    told = [document_sentences(t) for t in texts]
    flat = [w for doc in told for _, w, _ in doc]
    if not flat:
        return [[] for _ in texts]
    # what several texts say in the same words is scored once
    number: dict[str, int] = {}
    own = np.array([number.setdefault(w, len(number)) for w in flat])
    x, of = windows(list(number))
    score = np.add.reduceat(net.log_probabilities(x).astype(np.float64), np.searchsorted(of, np.arange(len(number))), axis=0)[own]
    places = np.bincount(of)[own]
    ends = np.cumsum([len(doc) for doc in told])
    best = np.concatenate([smoothed(score[e - len(doc) : e]) for doc, e in zip(told, ends) if doc])
    sure = np.exp(score[np.arange(len(flat)), best] / places)
    out, n = [], 0
    for doc in told:
        own: list[list] = []
        for s, _, full in doc:
            lang = langs[best[n]]
            if not own or own[-1][0] != lang:
                own.append([lang, 0, 0, [], s])
            own[-1][1] += full
            own[-1][2] += len(s)
            own[-1][3].append(sure[n])
            n += 1
        out.append([(lang, k, chars, float(np.mean(p)), first) for lang, k, chars, p, first in own])
    return out


def document_languages(documents: DataFrame) -> DataFrame:
    """doc_id, stretch, lang, sentences, chars, confidence, first, named: every stretch of sentences in one language.

    A stretch is a run of sentences (code, headings, fragments under five words or ten Chinese or Japanese characters left
    out) that get the same language; `sentences` counts those that end like one, `confidence` is their mean probability,
    `named` says whether documents.lang names the language. Null, empty and prose-free texts have no row; a null or
    placeholder label names none. The network knows the languages that some label names; without any the result is
    empty. Texts are read whole. Rows with one doc_id are told apart only by their stretches. Other columns are ignored.
    """
    spark = documents.sparkSession
    texts, labels, langs = labelled_sentences(documents)
    if not texts:
        return spark.createDataFrame([], OUT)
    model = shipped(spark, fit_texts(texts, labels, len(langs)))

    def told(batches):
        net = model()
        for b in batches:
            rows = [
                (doc, i, lang, n, chars, sure, first, lang in lang_codes(label))
                for doc, label, own in zip(b["doc_id"], b["lang"], stretches(list(b["text"]), net, langs))
                for i, (lang, n, chars, sure, first) in enumerate(own)
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "stretch", "lang", "sentences", "chars", "confidence", "first", "named"])

    return documents.select("doc_id", "lang", "text").mapInPandas(told, OUT)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = document_languages(table(spark, sf_dir, "documents"))
    return found.filter("sentences >= 2 and not named").select("doc_id", "lang").distinct()
