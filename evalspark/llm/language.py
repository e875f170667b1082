"""Language identification by word-first backoff, after HeLI (Jauhiainen, Linden and Jauhiainen, 2016).

A word that training knows scores by its relative frequency in each language, as a negative logarithm with a fixed
penalty where a language lacks it. An unseen word falls back to its character n-grams (with the word's borders),
from the longest to single characters, and takes the mean over the n-grams of the first length at which any is known.
The language with the lowest mean over all words of the text wins.

``fit`` learns from at most about ``per_lang`` rows of each language, taken by a hash of the id, and keeps a fixed number of words
and n-grams per language, so the model is small whatever the table holds; words have up to 64 letters, longer runs give their n-grams
only. A model of more than ``MODEL_BYTES`` is refused by name before it is sent out. ``predict`` sees only the text.

A null text or one without letters is ``und`` with score 0; so is every text if nothing was learned. A text whose letters were never seen gets the
language with most training rows and the score of a guess. Equal scores go to the language that comes first in the alphabet. Rows are
independent: repeated rows and ids give repeated rows, an empty table gives no rows, other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalspark.llm.arrow import map_batches
from evalspark.llm.vocab import LONGEST
from evalspark.scratch import materialize

PER_LANG = 4_000
WORDS, GRAMS, LENGTHS = 50_000, 6_000, 5
PENALTY = 7.0
UNKNOWN = "und"
MEMO = 250_000
MODEL_BYTES = 1 << 30
_RUN = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Lower-case runs of letters. Runs of other numeric signs, which the pattern also finds, are left out."""
    found = _RUN.findall(text.lower())
    return found if text.isascii() else [w for w in found if any(map(str.isalpha, w))]


@dataclass
class Model:
    """Rows of ``scores`` by word and by n-gram; one column per language, in the order of ``langs``."""

    langs: list[str]
    common: int = 0  # the language with most training rows
    known: dict[str, int] = field(default_factory=dict)
    grams: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))


def _counts(sample: DataFrame) -> DataFrame:
    def start():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            n = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                n.update((lang, w) for w in words(text))
            return {"lang": [k[0] for k in n], "word": [k[1] for k in n], "n": list(n.values())}
        return step

    parts = map_batches(sample, "lang string, word string, n bigint", start)
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, per_lang: int = PER_LANG, n_words: int = WORDS, n_grams: int = GRAMS, id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang", train: Column | None = None) -> Model:
    """``train``: a condition on the columns of ``docs``. Rows without a text or language are never learned from."""
    rows = docs if train is None else docs.filter(train)
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna(subset=["text", "lang"])
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return Model([])
    langs, whole = sorted(sizes), 1 << 30
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(whole, whole * per_lang // sizes[k]))])
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(whole)) < share[F.col("lang")]).select("lang", "text")
    counts = materialize(_counts(sample), "word-counts")
    edged = F.concat(F.lit(" "), "word", F.lit(" "))
    # A run of letters longer than a word gives n-grams only: its like is not met again.
    parts = [counts.filter(F.length("word") <= LONGEST).select("lang", F.lit(0).alias("size"), F.col("word").alias("piece"), "n")]
    for size in range(1, LENGTHS + 1):
        at = F.expr(f"filter(transform(sequence(1, length(edged)), i -> substring(edged, i, {size})), x -> length(x) = {size})")
        parts.append(counts.withColumn("edged", edged).select("lang", F.lit(size).alias("size"), F.explode(at).alias("piece"), "n")
                     .filter("trim(piece) <> ''"))
    pieces = parts[0]
    for p in parts[1:]:
        pieces = pieces.unionByName(p)
    pieces = pieces.groupBy("lang", "size", "piece").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang", "size").orderBy(F.desc("n"), "piece")
    total = F.sum("n").over(W.partitionBy("lang", "size"))
    kept = (pieces.withColumn("total", total).withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= F.when(F.col("size") == 0, n_words).otherwise(n_grams))
            .select("lang", "size", "piece", (-F.log10(F.col("n") / F.col("total"))).alias("score")).toArrow())
    model, at = Model(langs, max(range(len(langs)), key=lambda i: sizes[langs[i]])), {k: i for i, k in enumerate(langs)}
    rows_ = list(zip(*[kept.column(c).to_pylist() for c in ("lang", "size", "piece", "score")]))
    for _, size, piece, _ in rows_:
        table = model.grams if size else model.known
        table.setdefault(piece, len(model.known) + len(model.grams))
    size = 8 * (len(model.known) + len(model.grams)) * len(langs)
    if size > MODEL_BYTES:
        raise ValueError(f"a model of {size >> 20} MB for {len(langs)} languages; keep fewer words or n-grams")
    model.scores = np.full((len(model.known) + len(model.grams), len(langs)), PENALTY)
    for lang, size, piece, score in rows_:
        model.scores[(model.grams if size else model.known)[piece], at[lang]] = score
    return model


class Scorer:
    """Scores texts; remembers the vectors of words that it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.room = len(model.scores) + MEMO
        self.table = np.zeros((self.room, max(1, len(model.langs))))
        self.reset()

    def reset(self) -> None:
        self.at = dict(self.model.known)
        self.used = len(self.model.scores)
        if self.used:
            self.table[:self.used] = self.model.scores

    def learn(self, new: list[str]) -> None:
        """Vectors of unseen words, all at once: the mean over the n-grams of the first length at which any is known."""
        get, flat, sizes, words_ = self.model.grams.get, [], [], []
        for word in new:
            edged = f" {word} "
            for size in range(LENGTHS, 0, -1):
                found = [i for k in range(len(edged) - size + 1) if (i := get(edged[k:k + size])) is not None]
                if found:
                    flat += found
                    sizes.append(len(found))
                    words_.append(word)
                    break
            else:
                self.at[word] = -1
        if words_:
            n = np.array(sizes)
            sums = np.add.reduceat(self.model.scores[flat], np.cumsum(n) - n, axis=0)
            self.table[self.used:self.used + len(n)] = sums / n[:, None]
            self.at.update(zip(words_, range(self.used, self.used + len(n))))
            self.used += len(n)

    def __call__(self, text: str | None) -> tuple[str, float]:
        langs = self.model.langs
        found = words(text) if text else []
        if not found or not langs:
            return UNKNOWN, 0.0
        total, n = np.zeros(len(langs)), 0
        for k in range(0, len(found), MEMO):  # a text has any number of words, the memory a fixed number of places
            part = found[k:k + MEMO]
            new = set(part).difference(self.at)
            if new:
                if self.used + len(new) > self.room:
                    self.reset()
                    new = set(part).difference(self.at)
                self.learn(list(new))
            i = np.fromiter(map(self.at.__getitem__, part), np.int64, len(part))
            i = i[i >= 0]
            total, n = total + self.table[i].sum(axis=0), n + len(i)
        if not n:
            return langs[self.model.common], 1 / len(langs)
        best = int(total.argmin())
        return langs[best], float(1 / np.exp((total[best] - total) * np.log(10)).sum())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        scorer = Scorer(shared.value)

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            out = [scorer(t) for t in batch.column("text").to_pylist()]
            return {id_col: batch.column("id"), "lang_pred": [x[0] for x in out], "score": [x[1] for x in out]}
        return step

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, f"`{id_col}` {dict(docs.dtypes)[id_col]}, lang_pred string, score double", start)


def keep_known(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose text has a language with a score above ``least``."""
    shared, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            out = [scorer(t) for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and score > least for lang, score in out], pa.bool_()))
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """One row in four by a checksum of its id, never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
