import random
from pathlib import Path

import pytest
from compare import connect, difference
from rows import SCHEMA, documents

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from evalspark.llm import packing

SF = "/root/testdata/sf0.001"
PARTS = {"en": ["th", "ing", "er", "ou"], "de": ["sch", "ei", "ung", "ver"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(PARTS[lang], k=rng.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    langs = [rng.choice(list(PARTS)) for _ in range(80)]
    texts = [prose(rng, x, 250) for x in langs]
    passage = prose(rng, "en", 70)
    texts += [texts[3], "  ".join(texts[3].split(" ")), " ".join([*texts[5].split(" ")[:-1], "sching"])]  # copies of 3 and a near one of 5
    texts += [f"{prose(rng, 'en', 200)}\n{passage}", f"{passage}\n{prose(rng, 'en', 200)}", None, "", "12 34", "中文 字"]
    path = tmp_path_factory.mktemp("sf")
    documents(spark, texts, langs=[*langs, *["en"] * 9]).write.parquet(str(path / "documents.parquet"))
    return path, texts, passage


def test_stages_on_planted_cases(spark, folder, tmp_path):
    path, texts, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(path))
        if name != "packing":
            assert out.columns == [x.split()[0] for x in SCHEMA.split(", ")]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    every = set(range(len(texts)))
    assert set(seen["language_id"]) == every - {85, 86, 87, 88}
    assert set(seen["exact_dedup"]) == every - {80, 81, 85, 86, 87, 88}
    assert set(seen["near_dedup"]) == every - {80, 81, 82, 85, 86, 87, 88}
    assert set(seen["substring_dedup"]) == set(seen["near_dedup"])
    assert passage in seen["substring_dedup"][83]["text"] and passage not in seen["substring_dedup"][84]["text"]
    assert all(seen["substring_dedup"][i]["text"] == texts[i] for i in seen["substring_dedup"] if i != 84)
    whole = corpus_pipeline.run(spark, str(path)).collect()
    assert {r["doc_id"] for r in whole} == set(seen["packing"])
    kept = documents(spark, [seen["substring_dedup"][i]["text"] for i in sorted(seen["substring_dedup"])], ids=sorted(seen["substring_dedup"]))
    want = {(r["doc_id"], r["start"], r["ids_crc32"]) for r in packing.pieces(kept).collect()}
    assert {(r["doc_id"], r["start"], r["ids_crc32"]) for r in whole} == want


def test_empty_table(spark, folder, tmp_path):
    path, _, _ = folder
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="driver data is not here")
def test_registered_queries(spark):
    names = [n for n in queries() if n.startswith("op")]
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 14)) and "pipeline" in queries()
    for name in names:
        if name in oracle_sql():
            assert difference(queries()[name](spark, SF), connect(SF), oracle_sql()[name]) is None, name
