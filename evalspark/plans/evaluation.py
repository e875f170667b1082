"""Retrieval evaluation: per-question results, run summaries, comparison of configurations."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.metrics import COMPARED, HEADLINE, METRICS, SELECTION, random_metrics, rank_metrics
from evalspark.operators import bootstrap, ranking
from evalspark.operators.bm25 import BM25Config, bm25_retriever
from evalspark.scratch import materialize, temporary
from evalspark.sinks import tables
from evalspark.sources.tables import read_split

Retriever = Callable[[DataFrame, DataFrame], DataFrame]
DIMENSIONS = ("evidence_type", "n_gold", "label_status")


def new_run_id() -> str:
    """Sorts by start time; the random part keeps runs of the same second apart."""
    started = datetime.now(UTC).replace(microsecond=0, tzinfo=None)
    return "-".join([started.isoformat().replace("-", "").replace(":", ""), uuid.uuid4().hex[:8]])


def evaluate(retriever: Retriever, questions: DataFrame, units: DataFrame, run_ids: Sequence[str] | None = None,
             config_ids: Sequence[int] | None = None) -> DataFrame:
    """One row per configuration and question: ranks of the gold units, top 10, metrics, random baseline.

    ``questions`` has question_id, doc_id, split, question, gold_unit_ids, evidence_type, label_status and, where a unit of the page
    asks, own_unit_id: that unit is no candidate of the question.
    ``retriever`` returns (config_id, question_id, unit_id, score) for the configurations ``config_ids`` (by default as many as
    ``run_ids``, else the first). Every one of them must score exactly the units of each question's page (but for the one that asks); anything else is
    an error, never a run with fewer questions or candidates.
    """
    config_ids = list(config_ids) if config_ids is not None else list(range(len(run_ids or [0])))
    scored = materialize(retriever(questions, units), "scores")
    if ranking.incomplete_rankings(scored, questions, units, config_ids).limit(1).collect():
        gaps = ranking.ranking_gaps(scored, questions, units, config_ids).limit(3).collect()
        raise ValueError(f"not a full ranking of the candidates: {[g.asDict() for g in gaps]}")
    asked = ranking.expected_rankings(questions, config_ids).drop("doc_id", ranking.OWN).join(questions.select(
        "question_id", "doc_id", "split", "evidence_type", "label_status",
        F.size(F.array_distinct("gold_unit_ids")).alias("_wanted")), "question_id")
    found = ranking.gold_ranks(scored, questions).join(ranking.top_units(scored), ranking.KEYS)
    # Every question must come out, with every gold unit among its candidates.
    complete = F.when(F.size("gold_ranks") == F.col("_wanted"), F.col("gold_ranks")).otherwise(
        F.raise_error(F.concat(F.lit("gold units not among candidates of "), "question_id")))
    run_id = F.get(F.array(*map(F.lit, run_ids)), F.col("config_id")) if run_ids else F.lit("run")
    ranked = asked.join(found, ranking.KEYS, "left").select(
        run_id.alias("run_id"), "config_id", "question_id", "doc_id", "split", "evidence_type", "label_status",
        "n_candidates", F.size("gold_ranks").alias("n_gold"), complete.alias("gold_ranks"), "top_unit_ids")
    system = rank_metrics(F.col("gold_ranks"))
    chance = random_metrics(F.col("n_candidates"), F.col("n_gold"))
    return ranked.select(
        "*", *[system[m].alias(m) for m in METRICS], *[chance[m].alias(f"random_{m}") for m in METRICS])


def gold_rows(results: DataFrame) -> DataFrame:
    """Results with the metrics as two maps (``recall@5`` style names), the shape stored per question."""
    return results.select(
        "run_id", "question_id", "doc_id", "split", "evidence_type", "label_status", "n_candidates", "n_gold",
        "gold_ranks", "top_unit_ids", _metric_map("").alias("metrics"), _metric_map("random_").alias("random_metrics"))


def _metric_map(prefix: str, names: Sequence[str] = METRICS) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(m.replace("_at_", "@")) for m in names]),
                             F.array(*[F.col(prefix + m) for m in names]))


def _means(names: Sequence[str]) -> list[Column]:
    return [F.avg(p + m).alias(p + m) for p in ("", "random_") for m in names]


def run(spark: SparkSession, split: str, configs: Sequence[BM25Config], prefix: str = "qa", stems: DataFrame | None = None,
        commit: str | None = None, dirty: bool = False, run_ids: Sequence[str] | None = None, **options) -> DataFrame:
    """One evaluation from the silver tables to the gold tables; returns the run rows.

    The questions of ``split`` are asked, document frequencies come from the units of the pages of the train split, and the runs carry
    the versions of the tables that were read. Only the files of these splits are opened. Choosing among several
    configurations is for the other splits: on ``test`` only one may run.

    Gold tables have a partition per run. Runs and per-question rows are both written before either is seen, results come first, and
    a run id that is there already (``run_ids``, one per configuration) is replaced: a run repeated, also after a crash between the two, equals one.
    """
    if split == "test" and len(configs) > 1:
        raise ValueError("a grid is not run on the test split")
    names = {n: f"silver.{prefix}_{n}" for n in ("documents", "evidence_units", "questions")}
    versions = tables.table_versions(spark, list(names.values()))
    units = ["doc_id", "unit_id", "text"]
    asked = ["question_id", "doc_id", "split", "question", "gold_unit_ids", "evidence_type", "label_status"]
    questions = read_split(spark, names["questions"], split, asked)
    candidates = read_split(spark, names["evidence_units"], split, units)
    corpus = read_split(spark, names["evidence_units"], "train", units)
    run_ids = list(run_ids) if run_ids else [new_run_id() for _ in configs]
    gold = [f"gold.{prefix}_retrieval_results", f"gold.{prefix}_retrieval_runs"]
    with temporary(spark):
        results = materialize(evaluate(bm25_retriever(configs, corpus=corpus, stems=stems), questions, candidates, run_ids), "results")
        runs = build_runs(results, [c.params_json for c in configs], split, "bm25", versions, commit, dirty, **options)
        tables.create_layers(spark)
        written = [tables.stage(df, table, ["run_id"]) for df, table in zip((gold_rows(results), runs), gold, strict=True)]
        for staged in written:
            tables.publish_partitions(staged)
    return spark.table(gold[1]).filter(F.col("run_id").isin(run_ids))


def run_means(results: DataFrame) -> DataFrame:
    """One row per configuration: number of questions and the mean of every metric, system and random."""
    return results.groupBy("config_id").agg(F.count("*").alias("n_questions"), *_means(METRICS))


def gold_bucket(n: Column) -> Column:
    return F.when(n < 3, n.cast("string")).otherwise("3+")


def breakdown(results: DataFrame, metrics: Sequence[str] = HEADLINE) -> DataFrame:
    """(config_id, dimension, value, n, <metrics>, <random metrics>): headline means per group.

    One pass for all three dimensions: grouping sets over columns that are combined before the shuffle.
    """
    dims = results.withColumn("n_gold", gold_bucket(F.col("n_gold")))
    config = F.col("config_id")
    grouped = dims.groupingSets(
        [[config, F.col(d)] for d in DIMENSIONS], config, *[F.col(d) for d in DIMENSIONS],
    ).agg(F.count("*").alias("n"), *_means(metrics),
          *[F.grouping(d).alias(f"_{d}") for d in DIMENSIONS])
    dimension = F.coalesce(*[F.when(F.col(f"_{d}") == 0, d) for d in DIMENSIONS])
    value = F.coalesce(*[F.when(F.col(f"_{d}") == 0, F.col(d)) for d in DIMENSIONS])
    return grouped.select("config_id", dimension.alias("dimension"), value.alias("value"), "n",
                          *[p + m for p in ("", "random_") for m in metrics])


def _config_ids(results: DataFrame) -> list[int]:
    """One row per configuration, of a written table of results."""
    return sorted(r["config_id"] for r in results.select("config_id").distinct().collect())


def _side_by_side(results: DataFrame, configs: Sequence[int], metrics: Sequence[str]) -> DataFrame:
    """One row per question, one column ``{config}:{metric}`` per configuration and metric."""
    return results.groupBy("question_id").agg(*[
        F.max(F.when(F.col("config_id") == c, F.col(m))).alias(f"{c}:{m}") for c in configs for m in metrics])


def _split_name(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "config_id": F.substring_index("metric", ":", 1).cast("int"),
        "metric": F.substring_index("metric", ":", -1),
    })


def overall_ci(results: DataFrame, metrics: Sequence[str] = HEADLINE, config_ids: Sequence[int] | None = None, **options) -> DataFrame:
    """(config_id, metric, mean, low, high); all configurations and metrics share the resamples.

    ``config_ids`` saves a pass that looks for them.
    """
    configs = list(config_ids) if config_ids is not None else _config_ids(results)
    wide = _side_by_side(results, configs, metrics)
    columns = [f"{c}:{m}" for c in configs for m in metrics]
    return _split_name(bootstrap.bootstrap_ci(wide, "question_id", columns, **options)).select(
        "config_id", "metric", "mean", "low", "high")


def report(results: DataFrame, metrics: Sequence[str] = HEADLINE, **options) -> DataFrame:
    """(config_id, metric, system, low, high, random): the table a run prints."""
    random = bootstrap.to_long(
        results.groupBy("config_id").agg(*[F.avg(f"random_{m}").alias(m) for m in metrics]), metrics, "config_id")
    return (
        overall_ci(results, metrics, **options)
        .join(random.withColumnRenamed("value", "random"), ["config_id", "metric"])
        .select("config_id", "metric", F.col("mean").alias("system"), "low", "high", "random")
    )


def best_config(results: DataFrame) -> int:
    """Highest mean of the selection metric; the first configuration wins a tie."""
    means = results.groupBy("config_id").agg(F.avg(SELECTION).alias("mean"))
    return means.orderBy(F.round("mean", 12).desc(), "config_id").first()["config_id"]


def compare_to_best(results: DataFrame, metrics: Sequence[str] = COMPARED, config_ids: Sequence[int] | None = None, **options) -> DataFrame:
    """(best_config_id, config_id, metric, diff, low, high): paired intervals of every other configuration.

    An interval that includes 0 means the data cannot tell the two apart.
    """
    configs = list(config_ids) if config_ids is not None else _config_ids(results)
    best = best_config(results)
    others = [c for c in configs if c != best]
    wide = _side_by_side(results, configs, metrics)
    columns = {f"{c}:{m}": F.col(f"{c}:{m}") - F.col(f"{best}:{m}") for c in others for m in metrics}
    diffs = wide.select("question_id", *[d.alias(name) for name, d in columns.items()])
    return _split_name(bootstrap.bootstrap_ci(diffs, "question_id", list(columns), **options)).select(
        F.lit(best).alias("best_config_id"), "config_id", "metric", F.col("mean").alias("diff"), "low", "high")


def build_runs(results: DataFrame, params_json: Sequence[str], split: str, retriever: str,
               silver_versions: dict[str, int], commit: str | None = None, dirty: bool = False, **options) -> DataFrame:
    """One row per configuration: identity, parameters, provenance, input versions, summaries, breakdown."""
    options = {"config_ids": range(len(params_json)), **options}
    intervals = overall_ci(results, **options).groupBy("config_id").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct(F.replace("metric", F.lit("_at_"), F.lit("@")), F.array("low", "high"))))).alias("overall_ci95"))
    group = F.struct("n", _metric_map("", HEADLINE).alias("system"), _metric_map("random_", HEADLINE).alias("random"))
    groups = (
        breakdown(results).groupBy("config_id", "dimension")
        .agg(F.map_from_entries(F.collect_list(F.struct("value", group))).alias("groups"))
        .groupBy("config_id").agg(*[
            F.first(F.when(F.col("dimension") == d, F.col("groups")), ignorenulls=True).alias(d) for d in DIMENSIONS])
    )
    versions = F.map_from_arrays(F.array(*map(F.lit, sorted(silver_versions))),
                                 F.array(*[F.lit(silver_versions[t]) for t in sorted(silver_versions)]))
    run_ids = results.groupBy("config_id").agg(F.first("run_id").alias("run_id"))
    return (
        run_means(results).join(run_ids, "config_id").join(intervals, "config_id").join(groups, "config_id")
        .select(
            "run_id", F.current_timestamp().cast("string").alias("created_at"), F.lit(split).alias("split"),
            F.lit(retriever).alias("retriever"),
            F.get(F.array(*map(F.lit, params_json)), F.col("config_id")).alias("params_json"), "n_questions",
            F.lit(commit).cast("string").alias("git_commit"), F.lit(dirty).alias("git_dirty"),
            F.to_json(versions).alias("silver_versions_json"),
            _metric_map("").alias("summary"), _metric_map("random_").alias("random_summary"),
            F.to_json(F.struct("overall_ci95", *DIMENSIONS)).alias("breakdown_json"))
    )
