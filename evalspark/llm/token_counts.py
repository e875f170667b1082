"""Token counts with a whole-token shortcut.

Most pre-tokens of a text are vocabulary entries. Which entries the tokenizer encodes alone as one token
is proven once per worker from the vocabulary (``vocab.WholeTokens``); a pre-token among them counts one
without any merging, and only the others are merged. Different parts are counted once per worker.

Null text counts as empty (0 bytes, 0 tokens). Rows are independent: repeated rows give repeated rows, an
empty table gives an empty table, other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from evalspark.llm.arrow import map_batches, texts
from evalspark.llm.vocab import default_path, whole_tokens


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row of ``docs``."""
    path = path or default_path("byte_bpe_50k.json")
    kind = dict(docs.dtypes)[id_col]

    def start():
        counter = whole_tokens(path)

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            found = batch.column("text").to_pylist()
            n = [counter.count(t) for t in found]
            return {id_col: batch.column("id"), "n_bytes": [len(t.encode()) for t in found], "n_tokens": n,
                    "over_limit": [x > limit for x in n]}
        return step

    return map_batches(texts(docs, id_col, text_col), f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean",
                       start)
