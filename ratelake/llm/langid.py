"""Language identification by word-first backoff.

A word that the model knows scores its log frequency in every language. An unseen
word falls back to its character n-grams, longest order first: the first order of
which any n-gram is known decides. A text's score is the sum over its words; the
prediction is the best language, with its share of the exponentiated scores.

Fitting uses a bounded sample: at most about ``per_lang`` labelled rows of each of
the ``max_langs`` most frequent languages (by id hash). The model keeps the
``vocabulary`` most frequent words of a language and the ``grams`` most frequent
n-grams of each order, so its size is bounded whatever the corpus; every text is
scored whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text when nothing could be learned; ties go to the first language by
name; rows without a label are scored but not learned from; a null doc_id counts
as not held out; equal rows give equal results; an empty table an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelake.llm.common import saved, top_bits

WORD = re.compile(r"[^\W\d_]+")
ORDERS = (4, 3, 2, 1)
LONGEST = 64  # letters: a longer word is scored piece by piece
SMOOTH = 0.5
CACHE = 200_000


def words_of(text: str) -> list[str]:
    out = WORD.findall(text.lower())
    if any(len(w) > LONGEST for w in out):
        out = [w[i : i + LONGEST] for w in out for i in range(0, len(w), LONGEST)]
    return out


def grams_of(word: str, n: int) -> list[str]:
    """The word's n-grams, its ends marked (single letters: without marks)."""
    if n == 1:
        return list(word)
    marked = f"_{word}_"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Languages, and per known word or n-gram its row of log frequencies by language."""

    def __init__(self, rows: list[tuple[str, int, str, int]], totals: dict[tuple[str, int], int]):
        """rows: (lang, order, item, count), order 0 for words; totals by (lang, order)."""
        self.langs = sorted({lang for lang, _, _, _ in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        self.index: dict[int, dict[str, int]] = {n: {} for n in (0, *ORDERS)}
        for _, n, item, _ in rows:
            self.index[n].setdefault(item, len(self.index[n]))
        self.logs: dict[int, np.ndarray] = {}
        for n in self.index:
            counts = np.zeros((len(self.index[n]), len(self.langs)))
            for lang, order, item, c in rows:
                if order == n:
                    counts[self.index[n][item], at[lang]] = c
            all_of = np.array([totals.get((lang, n), 0) for lang in self.langs], float)
            self.logs[n] = np.log((counts + SMOOTH) / (all_of + SMOOTH * max(1, len(counts))))

    def unseen(self, word: str) -> np.ndarray:
        for n in ORDERS:
            index = self.index[n]
            known = [index[g] for g in grams_of(word, n) if g in index]
            if known:
                return self.logs[n][known].mean(axis=0)
        return np.zeros(len(self.langs))

    def predict(self, text: str | None, cache: dict[str, np.ndarray]) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not self.langs or not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        index = self.index[0]
        ids = [index.get(w, -1) for w in words]
        total = self.logs[0][[i for i in ids if i >= 0]].sum(axis=0) if len(index) else np.zeros(len(self.langs))
        for w, i in zip(words, ids, strict=True):
            if i < 0:
                v = cache.get(w)
                if v is None:
                    if len(cache) >= CACHE:
                        cache.clear()
                    v = cache[w] = self.unseen(w)
                total = total + v
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(
    docs: DataFrame, per_lang: int = 5_000, vocabulary: int = 30_000, grams: int = 20_000, max_langs: int = 1_000
) -> Model:
    """A model from a bounded, hash-chosen sample of the labelled rows."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", top_bits(F.xxhash64(F.lit("langid"), F.col("doc_id")), 30).alias("h")
    )
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    share = {r["lang"]: min(1.0, per_lang / r["count"]) for r in sizes}
    if not share:
        return Model([], {})
    cut = F.create_map(*[F.lit(x) for lang, s in share.items() for x in (lang, int(s * (1 << 30)))])
    sample = labelled.where(F.col("h") < F.coalesce(cut[F.col("lang")], F.lit(0))).select("lang", "text")

    def count_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got: Counter[tuple[str, str]] = Counter()
            for lang, t in zip(f["lang"], f["text"], strict=True):
                got.update((lang, w) for w in words_of(t))
            yield pd.DataFrame([(*k, 0, n) for k, n in got.items()], columns=["lang", "item", "n", "c"])

    def count_grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got: Counter[tuple[str, str, int]] = Counter()
            for lang, w, c in zip(f["lang"], f["item"], f["c"], strict=True):
                for n in ORDERS:
                    for g in grams_of(w, n):
                        got[lang, g, n] += c
            yield pd.DataFrame([(*k, c) for k, c in got.items()], columns=["lang", "item", "n", "c"])

    schema = "lang string, item string, n int, c long"
    total = lambda df: df.groupBy("lang", "item", "n").agg(F.sum("c").alias("c"))
    words = saved(total(sample.mapInPandas(count_words, schema)))
    items = saved(words.unionAll(total(words.mapInPandas(count_grams, schema))))
    sums = {(r["lang"], r["n"]): r["c"] for r in items.groupBy("lang", "n").agg(F.sum("c").alias("c")).collect()}
    rank = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("c"), "item"))
    most = F.when(F.col("n") == 0, vocabulary).otherwise(grams)
    kept = items.where("n <> 0 OR c > 1").withColumn("r", rank).where(F.col("r") <= most)
    rows = [(r["lang"], r["n"], r["item"], r["c"]) for r in kept.collect()]  # bounded by the model's size
    return Model(sorted(rows), sums)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain values, bounded by the model's parameters

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, np.ndarray] = {}
        own = Model.__new__(Model)
        vars(own).update(shared.value)
        for f in frames:
            got = [own.predict(t, cache) for t in f["text"]]
            yield pd.DataFrame(
                {"doc_id": f["doc_id"], "lang_pred": [g[0] for g in got], "score": np.array([g[1] for g in got], float)}
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


def language_report(docs: DataFrame, **fitting: int) -> DataFrame:
    """Learn from the rows that are not held out, predict every row."""
    model = fit(docs.where(~held_out(F.col("doc_id"))), **fitting)
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
