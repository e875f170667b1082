"""BM25 scores of every candidate unit of a question's page.

    idf(t)      = ln(1 + (N - df + 0.5) / (df + 0.5))
    score(unit) = sum over the question's distinct terms, in sorted order,
                  of idf(t) * tf / (tf + k1 * (1 - b + b * dl / avgdl))

Shape of the job, for many pages at once:

1. Each text is tokenized once and becomes a map of its distinct words to their counts, before its unit meets the page's questions
   in one join. There the question's map of words to slots and the unit's map are matched, one hash lookup per distinct word, and only
   the counts of the question's own terms are kept: an int array aligned with the sorted term list. A small questions side is
   broadcast, so texts do not move at all. A unit that asks a question is no candidate of it: that pair is left out here, and so of all statistics.
2. Page statistics (N, average length, df) are partial aggregates over those counts.
3. One row per question and configuration holds its idf vector; scoring is arithmetic in the row, so
   the float sum has one order whatever the partitioning.

All configurations share steps 1 and 2. Stemming and stopword removal are variants of the term list. A stemmer is an
expression on a word (a function from Column to Column), applied in the row, or a table (term, stem), which is joined to the distinct words;
with a table, reference frequencies of stems that have several word forms shuffle one row per unit and form.

Exploded terms are joined with a merge hint: Spark takes them for as small as the questions were before, in compressed files, and would broadcast
many times its threshold through the driver.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.text import STOPWORDS, let, tokenize, tokens, without_stopwords
from evalspark.operators.ranking import OWN, with_own_unit
from evalspark.scratch import materialize

SCOPES = ("page", "corpus")


@dataclass(frozen=True)
class BM25Config:
    """``idf_scope='page'`` takes document frequencies from the candidates, ``'corpus'`` from a given corpus."""

    k1: float = 1.2
    b: float = 0.75
    stem: bool = False
    stopwords: bool = True
    idf_scope: str = "page"

    def __post_init__(self):
        if self.idf_scope not in SCOPES:
            raise ValueError(f"idf_scope must be one of {SCOPES}, got {self.idf_scope!r}")

    @property
    def variant(self) -> int:
        return 2 * int(self.stem) + int(self.stopwords)

    @property
    def params_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def bm25_grid(stem: Sequence[bool] = (False, True)) -> list[BM25Config]:
    """Every combination of stemming, stopword removal and idf scope."""
    return [BM25Config(stem=s, stopwords=w, idf_scope=scope)
            for s, w, scope in itertools.product(stem, (False, True), SCOPES)]


def idf(df: Column, n: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def corpus_term_df(units: DataFrame, stopwords: bool = True) -> DataFrame:
    """Number of units each term occurs in. Combined per task before the shuffle on the term."""
    return (
        units.select(F.explode(F.array_distinct(tokenize(F.col("text"), stopwords))).alias("term"))
        .groupBy("term").agg(F.count("*").alias("df"))
    )


def corpus_size(units: DataFrame) -> DataFrame:
    return units.agg(F.count("*").alias("n"))


# ---------- question terms ----------

Stemmer = Callable[[Column], Column]


def _variant_words(words: str, variant: int, stem: Stemmer | None) -> Column:
    """The words that count under a variant. Stopwords go before stemming."""
    kept = without_stopwords(F.col(words)) if variant & 1 else F.col(words)
    return F.transform(kept, stem) if variant & 2 else kept


def _terms_in_row(questions: DataFrame, variants: list[int], stem: Stemmer | None) -> DataFrame:
    """(question_id, doc_id, own_unit_id, variant, terms, forms) where every term stands for itself, stemmed words included."""
    def variant(v: int) -> Column:
        return F.struct(F.lit(v).alias("variant"), F.array_sort(F.array_distinct(_variant_words("words", v, stem))).alias("terms"))

    return (
        questions.select("question_id", "doc_id", OWN, tokens(F.col("question")).alias("words"))
        .select("question_id", "doc_id", OWN, F.inline(F.array(*map(variant, variants))))
        .select("*", F.transform("terms", lambda t: F.array(t)).alias("forms"))
    )


def _word_forms(words: DataFrame, stems: DataFrame) -> DataFrame:
    """(term, stem, forms) for each of the distinct ``words``: all word forms that share its stem.

    A word the stem table does not list is its own stem.
    """
    stemmed = words.join(stems, "term", "left").select("term", F.coalesce("stem", "term").alias("stem"))
    wanted = stemmed.select("stem").distinct()
    listed = stems.join(wanted, "stem", "left_semi").select("stem", F.col("term").alias("form"))
    own = wanted.join(stems.select(F.col("term").alias("stem")), "stem", "left_anti").select(
        "stem", F.col("stem").alias("form"))
    forms = listed.unionByName(own).groupBy("stem").agg(F.array_sort(F.collect_set("form")).alias("forms"))
    return stemmed.join(forms, "stem")


def _stemmed_terms(questions: DataFrame, variants: list[int], stems: DataFrame) -> DataFrame:
    """(question_id, variant, terms, forms) where terms are stems. One join serves all variants."""
    words = questions.select("question_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term"))
    found = (
        words.hint("merge").join(_word_forms(words.select("term").distinct(), stems), "term")
        .groupBy("question_id").agg(F.collect_list(F.struct("term", "stem", "forms")).alias("found"))
    )

    def variant(v: int) -> Column:
        # Stopwords go before stemming: neither the question's nor the units' count where they are removed.
        kept = F.filter("found", lambda f: ~f["term"].isin(*STOPWORDS)) if v & 1 else F.col("found")
        forms = (lambda f: without_stopwords(f["forms"])) if v & 1 else (lambda f: f["forms"])
        terms = F.array_sort(F.array_distinct(F.transform(
            kept, lambda f: F.struct(f["stem"].alias("stem"), forms(f).alias("forms")))))
        return F.struct(F.lit(v).alias("variant"), terms.alias("t"))

    return found.select("question_id", F.inline(F.array(*map(variant, variants)))).select(
        "question_id", "variant", F.col("t.stem").alias("terms"), F.col("t.forms").alias("forms"))


def question_terms(questions: DataFrame, variants: Sequence[int], stems: DataFrame | Stemmer | None = None) -> DataFrame:
    """(question_id, doc_id, own_unit_id, variant, terms, forms), one row per question and tokenizer variant.

    ``terms`` are distinct and sorted; ``forms[i]`` are the words that count as ``terms[i]``. ``own_unit_id`` is the unit that asks, if ``questions`` tells.
    """
    if stems is None and any(v & 2 for v in variants):
        raise ValueError("stem=True needs a stemmer: an expression or a table (term, stem)")
    questions = with_own_unit(questions)
    if not isinstance(stems, DataFrame):
        return _terms_in_row(questions, list(variants), stems)
    plain = [v for v in variants if not v & 2]
    stemmed = [v for v in variants if v & 2]
    parts = []
    if plain:
        parts.append(_terms_in_row(questions, plain, None))
    if stemmed:
        # A question with no words still ranks its page.
        parts.append(
            questions.select("question_id", "doc_id", OWN, F.explode(F.array(*map(F.lit, stemmed))).alias("variant"))
            .join(_stemmed_terms(questions, stemmed, stems), ["question_id", "variant"], "left")
            .select("question_id", "doc_id", OWN, "variant",
                    F.coalesce("terms", F.array().cast("array<string>")).alias("terms"),
                    F.coalesce("forms", F.array().cast("array<array<string>>")).alias("forms")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


# ---------- term counts per question and candidate ----------

def _run_starts(keys: Column) -> Column:
    """Places in a sorted array where a value differs from the one before."""
    return F.filter(F.transform(keys, lambda k, i: F.when((i == 0) | (F.get(keys, i - 1) != k), i)), lambda i: i.isNotNull())


def word_counts(words: Column) -> Column:
    """Map of each distinct word to its count: once sorted, equal words are runs."""
    def counted(w: Column) -> Column:
        return let(_run_starts(w), lambda starts: F.map_from_arrays(
            F.transform(starts, lambda i: F.get(w, i)),
            F.transform(starts, lambda i, j: F.coalesce(F.get(starts, j + 1), F.size(w)) - i)))

    return let(F.sort_array(words), counted)


def _run_sums(keys: Column, numbers: Column) -> tuple[Column, Column]:
    """Distinct values of sorted ``keys`` and the sums of ``numbers`` over their runs, as two arrays of one length."""
    starts = _run_starts(keys)
    total = lambda i, n: F.aggregate(F.slice(numbers, i + 1, n), F.lit(0), lambda t, x: t + x)
    sums = let(starts, lambda at: F.transform(at, lambda i, j: total(i, F.coalesce(F.get(at, j + 1), F.size(keys)) - i)))
    return F.transform(starts, lambda i: F.get(keys, i)), sums


def _stem_counts(counts: Column, stem: Stemmer, stopwords: bool) -> Column:
    """Counts of stems from counts of words: each distinct word is stemmed once, and equal stems are added up."""
    entries = F.map_entries(counts)
    if stopwords:
        entries = F.filter(entries, lambda e: ~e["key"].isin(*STOPWORDS))  # before stemming
    stemmed = F.sort_array(F.transform(entries, lambda e: F.struct(stem(e["key"]).alias("stem"), e["value"].alias("n"))))
    return let(stemmed, lambda s: F.map_from_arrays(*_run_sums(s["stem"], s["n"])))


def _list_of(variant: int, stem: Stemmer | None) -> int:
    """The word list a variant is matched in: the plain one (its terms tell stopwords apart), or that of its stems."""
    return variant if stem is not None and variant & 2 else 0


def coded_units(units: DataFrame, variants: Sequence[int], stem: Stemmer | None = None) -> DataFrame:
    """(doc_id, unit_id, n_words, n_kept, list_0, ...): each unit's lengths and its counts of words, and of stems for stemmed variants."""
    lists = sorted({_list_of(v, stem) for v in variants} | {0})
    cut = units.select("doc_id", "unit_id", tokens(F.col("text")).alias("words")).select(
        "doc_id", "unit_id", F.size("words").alias("n_words"), F.size(without_stopwords(F.col("words"))).alias("n_kept"),
        word_counts(F.col("words")).alias("list_0"))
    return cut.select("*", *[_stem_counts(F.col("list_0"), stem, bool(v & 1)).alias(f"list_{v}") for v in lists if v])


def _packed(counts: Column) -> Column:
    """A map of counts as one text, ``word:count word:count``: what is shuffled is a fraction of the map. Terms hold neither mark."""
    return F.array_join(F.transform(F.map_entries(counts), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), " ")


def match_counts(terms: DataFrame, coded: DataFrame) -> DataFrame:
    """(question_id, variant, unit_id, dl, tfs): one row per question, variant and candidate.

    ``coded`` are units with their word counts. ``dl`` is the unit's length in tokens and ``tfs`` the counts of the question's terms. The
    unit that asks is no candidate.
    """
    wanted = terms.groupBy("question_id", "doc_id", OWN).agg(
        F.collect_list(F.struct(
            "variant", F.size("terms").alias("n_terms"), F.map_from_arrays(
                F.flatten("forms"), F.flatten(F.transform("forms", lambda f, i: F.transform(f, lambda _: i)))).alias("slots"))).alias("variants"))
    lists = [c for c in coded.columns if c.startswith("list_")]
    packed = coded.select("doc_id", "unit_id", "n_words", "n_kept", *[_packed(F.col(c)).alias(c) for c in lists])
    met = packed.join(wanted, "doc_id").filter(~F.col("unit_id").eqNullSafe(F.col(OWN))).select(
        "question_id", "unit_id", "n_words", "n_kept", *[F.str_to_map(c, F.lit(" "), F.lit(":")).alias(c) for c in lists], "variants")
    row = met.select("question_id", "unit_id", "n_words", "n_kept", *lists, F.explode("variants").alias("v"))
    v, slots = F.col("v.variant"), F.col("v.slots")
    counts = F.coalesce(*[F.when(v == int(c.removeprefix("list_")), F.col(c)) for c in lists if c != "list_0"], F.col("list_0"))
    # Keys of the question come first and in their order; those the unit alone has follow.
    met = F.map_zip_with(slots, counts, lambda word, slot, n: F.when(slot.isNotNull(), F.struct(slot.alias("slot"), F.coalesce(n.cast("int"), F.lit(0)).alias("n"))))
    hits = F.slice(F.map_values(met), F.lit(1), F.size(slots))
    tfs = F.when(F.size(slots) == F.col("v.n_terms"), F.transform(hits, lambda h: h["n"])).otherwise(
        let(hits, lambda h: _run_sums(h["slot"], h["n"])[1]))  # several forms of a term
    length = F.when(v.bitwiseAND(F.lit(1)) == 1, F.col("n_kept")).otherwise(F.col("n_words"))
    return row.select("question_id", v.alias("variant"), "unit_id", length.alias("dl"), tfs.alias("tfs"))


def page_sizes(pairs: DataFrame) -> DataFrame:
    """(question_id, variant, n, avgdl) over the candidates; an all-empty page counts as length 1."""
    return pairs.groupBy("question_id", "variant").agg(
        F.count("*").alias("n"),
        F.when(F.sum("dl") > 0, F.sum("dl") / F.count("*")).otherwise(1.0).alias("avgdl"))


def page_term_df(pairs: DataFrame) -> DataFrame:
    """(question_id, variant, slot, df): in how many candidates each question term occurs."""
    return (
        pairs.select("question_id", "variant", F.posexplode("tfs").alias("slot", "tf")).filter("tf > 0")
        .groupBy("question_id", "variant", "slot").agg(F.count("*").alias("df"))
    )


def _reference_df_in_row(terms: DataFrame, coded: DataFrame, variants: list[int], stem: Stemmer | None) -> DataFrame:
    """(question_id, variant, slot, df) with frequencies from the reference corpus (coded units): the distinct
    terms of every variant are counted together. Stopword removal changes no count of a word that stays, but may change that of a stem."""
    lists = sorted({_list_of(v, stem) for v in variants})
    distinct = F.array(*[F.struct(F.lit(v).alias("list"), F.map_keys(f"list_{v}").alias("terms")) for v in lists])
    counted = (
        coded.select(F.inline(distinct)).select("list", F.explode("terms").alias("term"))
        .groupBy("list", "term").agg(F.count("*").alias("df"))
    )
    of = F.when(F.col("variant").bitwiseAND(F.lit(2)) == 2, F.col("variant")).otherwise(0) if stem is not None else F.lit(0)
    slots = terms.filter(F.col("variant").isin(variants)).select(
        "question_id", "variant", of.alias("list"), F.posexplode("terms").alias("slot", "term"))
    return slots.hint("merge").join(counted, ["list", "term"]).select("question_id", "variant", "slot", "df")


def _reference_df(terms: DataFrame, coded: DataFrame, variants: list[int]) -> DataFrame:
    """(question_id, variant, slot, df) with frequencies from the reference corpus (coded units), where terms may have several word forms.

    A term found as one word takes that word's count, which all variants share (removing stopwords
    changes no other count). Only stems with several word forms need units counted per set of forms.
    """
    held = coded.select("unit_id", F.explode(F.map_keys("list_0")).alias("term"))
    slots = terms.filter(F.col("variant").isin(variants)).select(
        "question_id", "variant", F.posexplode("forms").alias("slot", "forms"))
    single = slots.filter(F.size("forms") == 1).select("question_id", "variant", "slot", F.get("forms", F.lit(0)).alias("term"))
    counted = held.groupBy("term").agg(F.count("*").alias("df"))
    found = single.hint("merge").join(counted, "term").select("question_id", "variant", "slot", "df")
    if not any(v & 2 for v in variants):
        return found
    several = slots.filter(F.size("forms") > 1).withColumn("forms_key", F.array_join("forms", " "))
    members = several.select("forms_key", F.explode("forms").alias("term")).distinct()
    per_set = (
        held.join(members, "term").select("unit_id", "forms_key").distinct()
        .groupBy("forms_key").agg(F.count("*").alias("df"))
    )
    return found.unionByName(several.join(per_set, "forms_key").select("question_id", "variant", "slot", "df"))


def _df_map(df: DataFrame, name: str) -> DataFrame:
    """One map slot -> df per question and variant; as many entries as the question has terms."""
    return df.groupBy("question_id", "variant").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "df"))).alias(name))


def _idf_vector(name: str, n: Column) -> Column:
    return F.transform("terms", lambda t, i: idf(F.coalesce(F.try_element_at(F.col(name), i), F.lit(0)), n))


def scoring_plan(terms: DataFrame, pairs: DataFrame, configs: Sequence[BM25Config], corpus: DataFrame | None = None,
                 stems: DataFrame | Stemmer | None = None, coded: DataFrame | None = None) -> DataFrame:
    """(question_id, variant, config_id, k1, b, avgdl, idfs): everything a score needs but the counts. ``coded`` are the units of ``corpus``, where they are coded already."""
    keys = ["question_id", "variant"]
    plan = terms.select(*keys, "terms").join(page_sizes(pairs), keys)
    scopes = {c.idf_scope for c in configs}
    vectors = {}
    if "page" in scopes:
        plan = plan.join(_df_map(page_term_df(pairs), "page_df"), keys, "left")
        vectors["page"] = _idf_vector("page_df", F.col("n"))
    if "corpus" in scopes:
        if corpus is None:
            raise ValueError("a configuration takes frequencies from a corpus, but none is given")
        variants = sorted({c.variant for c in configs if c.idf_scope == "corpus"})
        stem = None if isinstance(stems, DataFrame) else stems
        counts = coded if coded is not None else coded_units(corpus, variants, stem)
        found = _reference_df(terms, counts, variants) if isinstance(stems, DataFrame) else _reference_df_in_row(terms, counts, variants, stem)
        plan = plan.join(_df_map(found, "corpus_df"), keys, "left")
        plan = plan.withColumn("corpus_n", corpus_size(corpus).scalar())
        vectors["corpus"] = _idf_vector("corpus_df", F.col("corpus_n"))
    plan = plan.select(*keys, "avgdl", *[v.alias(f"idf_{s}") for s, v in vectors.items()])
    settings = F.array(*[
        F.struct(F.lit(i).alias("config_id"), F.lit(c.variant).alias("for_variant"),
                 F.lit(float(c.k1)).alias("k1"), F.lit(float(c.b)).alias("b"), F.lit(c.idf_scope).alias("scope"))
        for i, c in enumerate(configs)
    ])
    idfs = F.coalesce(*[F.when(F.col("scope") == s, F.col(f"idf_{s}")) for s in vectors])
    return (
        plan.select("*", F.inline(settings)).filter(F.col("variant") == F.col("for_variant"))
        .select(*keys, "config_id", "k1", "b", "avgdl", idfs.alias("idfs"))
    )


def _score() -> Column:
    norm = F.col("k1") * (F.lit(1.0) - F.col("b") + F.col("b") * F.col("dl") / F.col("avgdl"))
    parts = F.zip_with("tfs", "idfs", lambda tf, w: F.when(tf > 0, w * tf / (tf + norm)).otherwise(0.0))
    return F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)


def bm25_scores(questions: DataFrame, units: DataFrame, configs: Sequence[BM25Config] = (BM25Config(),),
                corpus: DataFrame | None = None, stems: DataFrame | Stemmer | None = None) -> DataFrame:
    """(config_id, question_id, unit_id, score) for every candidate, those sharing no term at score 0.

    ``questions`` has question_id, doc_id, question and, where a unit of the page asks, own_unit_id; ``units`` and ``corpus`` have
    doc_id, unit_id, text; ``config_id`` is the position in ``configs``.
    """
    if corpus is None and any(c.idf_scope == "corpus" for c in configs):
        raise ValueError("a configuration takes frequencies from a corpus, but none is given")
    variants = sorted({c.variant for c in configs})
    terms = question_terms(questions, variants, stems)
    stem = None if isinstance(stems, DataFrame) else stems
    if isinstance(stems, DataFrame):
        terms = materialize(terms, "question-terms")  # read by the match and by the plan
    coded = coded_units(units, variants, stem)
    both = corpus is units and any(c.idf_scope == "corpus" for c in configs)
    if both:
        coded = materialize(coded, "coded-units")  # read by the match and for the frequencies
    pairs = materialize(match_counts(terms, coded), "term-counts")
    plan = scoring_plan(terms, pairs, configs, corpus, stems, coded if both else None)
    # Every pair has its plan rows. As a left join only the plan, one row per question, can be broadcast.
    return pairs.join(plan, ["question_id", "variant"], "left").select(
        "config_id", "question_id", "unit_id", _score().alias("score"))


def bm25_retriever(configs: Sequence[BM25Config] = (BM25Config(),), corpus: DataFrame | None = None,
                   stems: DataFrame | Stemmer | None = None):
    """The retriever interface: a function of (questions, units) that scores every candidate."""
    def score(questions: DataFrame, units: DataFrame) -> DataFrame:
        return bm25_scores(questions, units, configs, corpus, stems)

    return score

