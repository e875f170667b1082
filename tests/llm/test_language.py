import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from rows import clashing, documents

from evalspark.llm import language

PARTS = {"xx": ["ba", "bo", "bi", "tan", "tor"], "yy": ["ke", "ki", "ku", "zel", "zor"], "zz": ["mé", "mû", "ña", "lor", "lén"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(PARTS[lang], k=rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    langs = [rng.choice(list(PARTS)) for _ in range(400)]
    return documents(spark, [text(rng, x, rng.choice([3, 10, 60])) for x in langs], langs=langs)


@pytest.fixture(scope="module")
def model(docs):
    return language.fit(docs, train=~language.held_out())


def test_held_out_accuracy(docs, model):
    found = language.predict(clashing(docs), model).join(docs, "doc_id").filter(language.held_out()).collect()
    assert len(found) > 60 and sum(r["lang_pred"] == r["lang"] for r in found) >= 0.98 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_unseen_words_fall_back_to_shorter_grams(model):
    scorer = language.Scorer(model)
    assert scorer("kezorkukezelkuzor")[0] == "yy" and "kezorkukezelkuzor" not in model.known
    assert scorer("méxlor")[0] == "zz"
    best, score = scorer("中文")
    assert best in model.langs and score == pytest.approx(1 / 3)


def test_odd_texts(spark, docs, model):
    rng = random.Random(9)
    odd = [None, "", " \n", "123 ²½ !?", "_", text(rng, "yy", 30_000), text(rng, "xx", 5)]
    table = documents(spark, odd, ids=[0, 1, 2, 3, None, 5, 5])
    got = language.predict(table, model).collect()
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in got) == [
        ("0", "und"), ("1", "und"), ("2", "und"), ("3", "und"), ("5", "xx"), ("5", "yy"), ("None", "und")]
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert language.predict(docs.limit(0), model).count() == 0
    kept = language.keep_known(clashing(table), model)
    assert kept.columns == clashing(table).columns and sorted(r["doc_id"] for r in kept.collect()) == [5, 5]


def test_nothing_learned(spark, docs):
    none = language.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert none.langs == [] and {r["lang_pred"] for r in language.predict(docs.limit(5), none).collect()} == {"und"}
    assert language.fit(docs.limit(0)).langs == []


def test_the_model_has_a_size_bound(docs):
    small = language.fit(docs, per_lang=50, n_words=10, n_grams=5)
    assert len(small.known) <= 30 and len(small.grams) <= 5 * language.LENGTHS * 3


def test_memory_that_overflows_changes_nothing(model, monkeypatch):
    rng = random.Random(11)
    texts = [text(rng, lang, 200) for lang in PARTS for _ in range(5)] + ["ünbekännt " * 9]
    want = [language.Scorer(model)(t) for t in texts]
    monkeypatch.setattr(language, "MEMO", 7)
    got = language.Scorer(model)
    for t, (lang, score) in zip(texts, want):
        assert got(t)[0] == lang and got(t)[1] == pytest.approx(score)


def by_hand(counted, text):
    """The definition, one word and one language at a time. ``counted``: per language and size (0: words) the numbers of kept pieces and their total."""
    runs = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not runs:
        return "und"
    def cost(lang, size, piece):
        kept, total = counted[lang, size]
        return -math.log10(kept[piece] / total) if piece in kept else language.PENALTY
    langs = sorted({lang for lang, _ in counted})
    known = lambda size, piece: any(piece in counted[lang, size][0] for lang in langs)
    sums, n = dict.fromkeys(langs, 0.0), 0
    for w in runs:
        if known(0, w):
            vectors = [(0, w)]
        else:
            edged = f" {w} "
            vectors = next((v for size in range(language.LENGTHS, 0, -1)
                            if (v := [(size, g) for k in range(len(edged) - size + 1) if known(size, g := edged[k:k + size])])), [])
        if vectors:
            n += 1
            for lang in langs:
                sums[lang] += sum(cost(lang, *v) for v in vectors) / len(vectors)
    return min(langs, key=lambda x: (round(sums[x], 9), x)) if n else None


def test_predictions_equal_a_slow_scorer(spark):
    rng = random.Random(4)
    parts = {"en": ["th", "ing", "er", "ou"], "de": ["sch", "ei", "ung", "th"], "fr": ["eau", "ou", "é", "er"]}
    prose = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=rng.randrange(1, 4))) for _ in range(n))
    learned = [(lang, prose(lang, 60)) for lang in parts for _ in range(12)] + [("de", "langes" * 40 + "wort")]
    docs = documents(spark, [t for _, t in learned], langs=[x for x, _ in learned])
    model = language.fit(docs, n_words=40, n_grams=60)
    counted = {}
    for lang in parts:
        runs = Counter(w for x, t in learned if x == lang for w in re.findall(r"[^\W\d_]+", t.lower()))
        for size in range(language.LENGTHS + 1):
            pieces = Counter()
            for w, k in runs.items():
                for g in [w] if size == 0 else [f" {w} "[i:i + size] for i in range(len(w) + 3 - size)]:
                    if g.strip() and (size or len(g) <= 64):
                        pieces[g] += k
            kept = dict(sorted(pieces.items(), key=lambda x: (-x[1], x[0]))[:60 if size else 40])
            counted[lang, size] = kept, sum(pieces.values())
    asked = [prose(rng.choice(list(parts)), rng.choice([1, 2, 5])) for _ in range(150)] + ["langeslangesqq", "zzz th", "", None, "langes" * 40]
    got = [r["lang_pred"] for r in language.predict(documents(spark, asked), model).orderBy("doc_id").collect()]
    assert got == [by_hand(counted, t) for t in asked]


def test_large_models_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language, "MODEL_BYTES", 100)
    with pytest.raises(ValueError, match="keep fewer"):
        language.fit(documents(spark, ["some words of a language"]))
