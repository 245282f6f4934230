"""Operator 1: language identification by words, backing off to character n-grams.

A text is judged word by word. A word that the model knows scores by its log
frequency in each language. An unknown word backs off to its character n-grams,
from ``MAX_N`` letters down to one: the longest length of which any n-gram is
known decides, by the mean over the word's n-grams. A language without the item
gets ``PENALTY``. The document takes the language of the best mean.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import giving_back, is_held_out, read, slices, staged

UNKNOWN = "und"
#: The model learns from about so many labelled documents of each language at most, chosen by a hash of the id; of a rare language from all.
MAX_TRAIN_DOCS = 3_000
#: Kept for each language: the most frequent words, and n-grams of each length; fewer if the table would have more numbers than ``MAX_TABLE``.
MAX_WORDS, MAX_GRAMS = 20_000, 8_000
MAX_TABLE = 50_000_000
MAX_N = 5
#: -log10 frequency of what a language lacks.
PENALTY = 7.0
#: Neighbouring words are not independent: the confidence grows as their number to this power.
EVIDENCE = 0.6
#: The pipeline rejects a document that is ``und`` or scores below this.
MIN_SCORE = 0.3

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return _WORD.findall(text.lower()) if text else []


def grams_of(word: str, n: int) -> list[str]:
    """The character n-grams of a word between blanks."""
    s = f" {word} "
    return [s[i : i + n] for i in range(len(s) - n + 1)]


def _counts(batches):
    """(lang, n, item, count) of a part of the training rows; n is 0 for words."""
    found: dict[str, Counter] = {}
    for batch in batches:
        for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
            found.setdefault(lang, Counter()).update(w for w in words_of(text) if w.isalpha())
    for lang, words in found.items():
        grams = Counter()
        for w, c in words.items():
            for n in range(1, MAX_N + 1):
                for g in grams_of(w, n):
                    grams[g] += c
        for items, rank in ((words, lambda _: 0), (grams, len)):
            pairs = list(items.items())
            for i in range(0, len(pairs), 50_000):
                some = pairs[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([rank(g) for g, _ in some], pa.int32()), pa.array([g for g, _ in some]), pa.array([c for _, c in some], pa.int64())], ["lang", "n", "item", "c"])


class Model:
    """Log-frequency tables. ``words`` and ``grams`` map an item to its row of ``table``."""

    def __init__(self, langs: list[str], rows: list[tuple[str, int, str, float]]):
        self.langs = langs
        at = {x: i for i, x in enumerate(langs)}
        self.words: dict[str, int] = {}
        self.grams: dict[str, int] = {}
        for _, n, item, _ in rows:
            d = self.grams if n else self.words
            d.setdefault(item, len(self.words) + len(self.grams))
        self.table = np.full((len(self.words) + len(self.grams), len(langs)), PENALTY, np.float32)
        for lang, n, item, score in rows:
            self.table[(self.grams if n else self.words)[item], at[lang]] = score

    def backoff(self, word: str) -> np.ndarray | None:
        for n in range(min(MAX_N, len(word) + 2), 0, -1):
            ids = [self.grams.get(g, -1) for g in grams_of(word, n)]
            if max(ids) >= 0:
                missing = sum(i < 0 for i in ids)
                return (self.table[[i for i in ids if i >= 0]].sum(0) + PENALTY * missing) / len(ids)
        return None

    def predict(self, text: str | None, memo: dict) -> tuple[str, float]:
        """The language and its posterior; ``memo`` keeps the scores of unknown words, within bounds."""
        if not text or not self.langs:
            return UNKNOWN, 0.0
        counts = Counter(words_of(text))
        known, weights, rest, total = [], [], np.zeros(len(self.langs)), 0
        for w, c in counts.items():
            if not w.isalpha():
                w = "".join(filter(str.isalpha, w))
                if not w:
                    continue
            total += c
            i = self.words.get(w, -1)
            if i >= 0:
                known.append(i)
                weights.append(c)
                continue
            s = memo.get(w)
            if s is None:
                s = self.backoff(w)
                if s is None:
                    s = np.full(len(self.langs), PENALTY, np.float32)
                if len(memo) >= 100_000:
                    memo.clear()
                memo[w] = s
            rest += s * c
        if not total:
            return UNKNOWN, 0.0
        if known:
            rest += np.asarray(weights, float) @ self.table[known]
        mean = rest / total
        p = np.exp(-(mean - mean.min()) * np.log(10) * total**EVIDENCE)
        best = int(np.argmin(mean))  # of equals the first by name
        return self.langs[best], float(p[best] / p.sum())


def table_sizes(languages: int) -> tuple[int, int]:
    """Words, and n-grams of each length, that are kept for each of so many languages."""
    share = min(1.0, MAX_TABLE / (languages * languages * (MAX_WORDS + MAX_N * MAX_GRAMS)))
    return max(20, int(MAX_WORDS * share)), max(20, int(MAX_GRAMS * share))


def train(docs: DataFrame) -> Model:
    """A model from ``text`` and non-null ``lang`` of the rows of ``docs`` that are not held out.

    Every value of ``lang`` is learned. The sample has about ``MAX_TRAIN_DOCS`` rows of each, whatever the size of
    the corpus; what comes to the driver and is broadcast is bounded by ``MAX_TABLE``. No labelled row: an empty
    model, which calls every text ``und``.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out()).select("doc_id", "text", "lang")
    # written, so that few labels are known to be few and texts needn't be dealt by label to meet them
    by_lang = staged(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "languages")
    languages = by_lang.count()
    if not languages:
        return Model([], [])
    words, grams = table_sizes(languages)
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    sample = labelled.join(by_lang, "lang").where(chance < F.lit(MAX_TRAIN_DOCS) / F.col("rows") * (1 << 20)).select("doc_id", "text", "lang")
    counts = sample.mapInArrow(giving_back(_counts), "lang string, n int, item string, c long").groupBy("lang", "n", "item").agg(F.sum("c").alias("c"))
    totals = Window.partitionBy("lang", "n")
    top = (
        counts.withColumn("total", F.sum("c").over(totals))
        .withColumn("k", F.row_number().over(totals.orderBy(F.desc("c"), "item")))
        .where(F.col("k") <= F.when(F.col("n") == 0, words).otherwise(grams))
        .select("lang", "n", "item", (-F.log10(F.col("c") / F.col("total"))).alias("s"))
    )
    rows = [tuple(r) for r in top.collect()]
    return Model(sorted({r[0] for r in rows}), sorted(rows))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) appended.

    Null text, empty text and text without a letter give ``und`` and 0. Whole texts are read. Repeated rows
    get equal results; of languages that score alike the first by name is taken. Columns of these two names that
    exist already are replaced. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*kept).schema

    def judge(batches):
        m, memo = held.value, {}
        for batch in slices(batches, text):
            got = [m.predict(t, memo) for t in batch[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return docs.select(*kept).mapInArrow(giving_back(judge), schema.add("lang_pred", "string").add("score", "double"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """Pipeline stage: drops the documents that language ID rejects; the rest keep their columns, whatever their names.

    Null and empty texts, and texts without a letter, are ``und`` and go. Repeated rows are judged alike. An empty
    table gives an empty one.
    """
    judged = identify(docs.select(F.struct("*").alias("row"), docs["text"].alias("text")), train(docs))
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)).select("row.*")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    out = identify(docs.select("doc_id", is_held_out().alias("held_out"), "text"), train(docs))
    return out.select("doc_id", "held_out", "lang_pred", "score")
