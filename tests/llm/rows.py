"""Small document tables for the operator tests."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, ids=None, langs=None):
    ids = ids if ids is not None else range(len(texts))
    langs = langs or ["en"] * len(texts)
    rows = [(i, t, lang, "s", len(t) if t is not None else None) for i, t, lang in zip(ids, texts, langs)]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """The same rows with columns named like those that operators use inside."""
    from pyspark.sql import functions as F
    names = ["id", "fp", "digest", "key", "part", "start", "length", "group", "slot", "shard", "kept", "score", "size", "path", "host", "row", "bytes", "cut", "spans", "sha", "__id", "__sha", "__cut", "__spans", "__bytes"]
    return df.select("*", *[F.lit(f"x{i}").alias(n) for i, n in enumerate(names) if n not in df.columns])


def rows(df, *columns):
    df = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in df.collect()), key=str)
