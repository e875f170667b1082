"""Rankings from scores: (config_id, question_id, unit_id, score).

Order: score rounded to 9 decimals, descending, then sha1 of the unit id. The rounding makes scores
that differ only in their last bits ties, and the hash keeps position on the page from earning credit.

No step gives all candidates of one question to one task, whatever its page holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalspark.scratch import materialize

SCORE_DECIMALS = 9
TOP = 10
PARTS = 32  # over which the candidates of a large question are counted
LARGE = 50_000  # candidates from which a question is large
KEYS = ["config_id", "question_id"]
OWN = "own_unit_id"  # of questions that a unit of the page asks


def with_own_unit(questions: DataFrame) -> DataFrame:
    """Questions with the unit that asks, which is no candidate of its own question; null where no unit of the page does."""
    return questions if OWN in questions.columns else questions.withColumn(OWN, F.lit(None).cast("string"))


def order_key() -> Column:
    """Sorts ascending: best unit first."""
    # the hash's bytes sort like its text and are half as long
    return F.struct((F.lit(0.0) - F.round("score", SCORE_DECIMALS)).alias("worse"), F.unhex(F.sha1("unit_id")).alias("tie"))


def rank_units(scored: DataFrame) -> DataFrame:
    """Full ranking: adds the 1-based ``rank`` within each configuration and question.

    A range-partitioned sort spreads even one question over many tasks. A unit's rank is its place in
    its own sorted run plus the sizes of the question's earlier runs, of which there are at most as
    many as partitions.
    """
    ordered = (
        scored.withColumn("_key", order_key()).orderBy(*KEYS, "_key", "unit_id")
        .withColumn("_at", F.monotonically_increasing_id()).drop("_key")
    )
    ordered = materialize(ordered, "ranking").withColumn("_run", F.shiftright("_at", 33))
    runs = ordered.groupBy(*KEYS, "_run").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*KEYS).orderBy("_run").rowsBetween(W.unboundedPreceding, -1))
    offsets = runs.select(*KEYS, "_run", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return (
        ordered.join(offsets, [*KEYS, "_run"], "left")
        .withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_run", "_shift")
    )


def top_units(scored: DataFrame, k: int = TOP) -> DataFrame:
    """(config_id, question_id, top_unit_ids): the best k, in order.

    The rank limit is applied per task before the shuffle, so each task sends at most k per question.
    """
    best = W.partitionBy(*KEYS).orderBy(order_key(), "unit_id")
    return (
        scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("rank", "unit_id"))).alias("top"))
        .select(*KEYS, F.col("top.unit_id").alias("top_unit_ids"))
    )


def gold_ranks(scored: DataFrame, questions: DataFrame) -> DataFrame:
    """(config_id, question_id, n_candidates, gold_ranks): sorted 1-based ranks of the distinct gold units.

    Ranks come from counting, not sorting. Each candidate falls into a slot between the question's
    sorted gold units; the counts per slot add up to the ranks. Arrays are as long as the gold list of one question record.

    Candidates of a question with more than ``LARGE`` are dealt over a fixed number of parts by a hash of the unit, and its marks are
    repeated for each part: they are counted by many tasks, and only counts meet on the question. All other questions are one part,
    so their marks are shuffled once. ``scored`` is read several times and should be a written table.
    """
    large = materialize(scored.groupBy(*KEYS).agg(F.count("*").alias("n")).filter(F.col("n") > LARGE).select(
        *KEYS, F.lit(PARTS).alias("parts")), "large-questions")
    parts = F.coalesce("parts", F.lit(1))
    # Not broadcast: Spark takes exploded ids for as small as the lists were in compressed files.
    gold = questions.select("question_id", F.explode("gold_unit_ids").alias("unit_id")).hint("merge")
    marks = (
        scored.join(gold, ["question_id", "unit_id"], "left_semi")
        .groupBy(*KEYS).agg(F.array_sort(F.collect_list(order_key())).alias("marks"))
        .join(large, KEYS, "left").select(*KEYS, "marks", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    )
    dealt = scored.join(large, KEYS, "left").select(
        *KEYS, order_key().alias("key"), F.pmod(F.xxhash64("unit_id"), parts).cast("int").alias("part"))
    # The outer side of a left join is never broadcast, so the candidates stay where they are.
    counted = (
        dealt.join(marks, [*KEYS, "part"], "left")
        .groupBy(*KEYS, "part", F.size(F.filter("marks", lambda m: m < F.col("key"))).alias("slot"), F.size("marks").alias("n_gold"))
        .agg(F.count("*").alias("n"))
    )
    slots = counted.groupBy(*KEYS, "slot", "n_gold").agg(F.sum("n").alias("n"))
    at_most = lambda i: F.aggregate(
        F.filter("slots", lambda s: s["slot"] <= i), F.lit(0).cast("long"), lambda total, s: total + s["n"])
    return (
        slots.groupBy(*KEYS, "n_gold")
        .agg(F.sum("n").alias("n_candidates"), F.collect_list(F.struct("slot", "n")).alias("slots"))
        .select(*KEYS, "n_candidates",
                F.when(F.col("n_gold") > 0, F.transform(F.sequence(F.lit(0), F.col("n_gold") - 1), at_most)).alias("gold_ranks"))
    )


def missing_gold(questions: DataFrame, units: DataFrame) -> DataFrame:
    """(question_id, unit_id): gold ids that are not candidates. Must be empty."""
    gold = with_own_unit(questions).select("question_id", "doc_id", OWN, F.explode(F.array_distinct("gold_unit_ids")).alias("unit_id"))
    # the unit that asks is looked for under no name
    wanted = gold.withColumn("_candidate", F.when(~F.col("unit_id").eqNullSafe(F.col(OWN)), F.col("unit_id")))
    there = units.select("doc_id", F.col("unit_id").alias("_candidate"))
    return wanted.join(there, ["doc_id", "_candidate"], "left_anti").select("question_id", "unit_id")


def expected_rankings(questions: DataFrame, config_ids: Sequence[int]) -> DataFrame:
    """(config_id, question_id, doc_id, own_unit_id): every configuration has to rank every question's page, but for the unit that asks."""
    configs = F.explode(F.array(*[F.lit(int(c)) for c in config_ids])).alias("config_id")
    return with_own_unit(questions).select("question_id", "doc_id", OWN, configs)


def ranking_gaps(scored: DataFrame, questions: DataFrame, units: DataFrame, config_ids: Sequence[int]) -> DataFrame:
    """(config_id, question_id, unit_id, scored, expected): where a retriever did not score exactly its candidates.

    Must be empty. Both sides are counted per unit, so neither a missing, a foreign nor a repeated unit passes, and
    the configurations are the caller's, so one that scored nothing shows.
    """
    candidates = (
        expected_rankings(questions, config_ids).join(units.select("doc_id", "unit_id"), "doc_id")
        .filter(~F.col("unit_id").eqNullSafe(F.col(OWN))).select(*KEYS, "unit_id", F.lit(0).alias("s"), F.lit(1).alias("e"))
    )
    given = scored.select(*KEYS, "unit_id", F.lit(1).alias("s"), F.lit(0).alias("e"))
    return (
        candidates.unionByName(given).groupBy(*KEYS, "unit_id")
        .agg(F.sum("s").alias("scored"), F.sum("e").alias("expected")).filter("scored != expected")
    )


def incomplete_rankings(scored: DataFrame, questions: DataFrame, units: DataFrame, config_ids: Sequence[int]) -> DataFrame:
    """(config_id, question_id): rankings that are not exactly the page's units, by counts and checksums of unit ids.

    Cheaper than ``ranking_gaps``: the page side is aggregated once per page and no candidate is joined. The unit that asks, where
    the page has it, is taken off its page's counts and checksums.
    """
    unit = [F.xxhash64("unit_id").cast("decimal(38,0)"), F.xxhash64("unit_id", F.lit(1)).cast("decimal(38,0)")]

    def summary(n: str) -> list[Column]:
        return [F.count("*").alias(n), F.sum(unit[0]).alias(f"{n}_sum"), F.sum(unit[1]).alias(f"{n}_sum2")]

    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,0)")
    pages = units.groupBy("doc_id").agg(*summary("page"))
    asked = with_own_unit(questions)
    wanted = expected_rankings(questions, config_ids).join(pages, "doc_id", "left")
    ends = ("", "_sum", "_sum2")
    if OWN in questions.columns:
        asking = asked.filter(F.col(OWN).isNotNull()).select("question_id", "doc_id", F.col(OWN).alias("unit_id"))
        own = asking.join(units.select("doc_id", "unit_id"), ["doc_id", "unit_id"], "left_semi").groupBy("question_id").agg(*summary("own"))
        wanted = wanted.join(own, "question_id", "left")
        wanted = wanted.withColumns({f"want{e}": zero(f"page{e}") - zero(f"own{e}") for e in ends})
    else:
        wanted = wanted.withColumns({f"want{e}": zero(f"page{e}") for e in ends})
    given = scored.groupBy(*KEYS).agg(*summary("got"))
    same = F.lit(True)
    for e in ends:
        same = same & (zero(f"want{e}") == zero(f"got{e}"))
    return wanted.join(given, KEYS, "full").filter(~same | F.col("doc_id").isNull()).select(*KEYS)
