"""One registered query per operator, over its whole table and with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import (exact, language, licenses, negatives, packing, prefix_trie, sentencepieces, simhash, substrings,
                           token_counts, topk, urls, warc)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    model = language.fit(docs, train=~language.held_out())
    return language.predict(docs, model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op2_exact_dedup(spark, sf_dir):
    return exact.exact_groups(_read(spark, sf_dir, "documents"))


def op3_packing(spark, sf_dir):
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op4_sentencepiece(spark, sf_dir):
    return sentencepieces.verify(_read(spark, sf_dir, "documents"))


def op5_licenses(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    found = licenses.scan(docs, licenses.train(docs))
    return found.withColumns({c: F.round(c, 6) for c in ("probability", "similarity")})


def op6_simhash(spark, sf_dir):
    return simhash.near_groups(_read(spark, sf_dir, "documents"))


def op7_url_rules(spark, sf_dir):
    return urls.judge(_read(spark, sf_dir, "pages"), urls.rule_table(spark))


def op8_token_counts(spark, sf_dir):
    return token_counts.token_counts(_read(spark, sf_dir, "documents"))


def op9_substrings(spark, sf_dir):
    return substrings.repeats(_read(spark, sf_dir, "documents"))


def op10_search(spark, sf_dir):
    return topk.search(_read(spark, sf_dir, "documents"), F.col("id") % 20 == 0).withColumn("score", F.round("score", 6))


def op11_conversation_trie(spark, sf_dir):
    conv = F.col("conv")
    found = prefix_trie.paths(_read(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.rebuilt(found, conv - conv % 100, F.crc32(conv.cast("string")) % 6, 5))


def op12_warc(spark, sf_dir):
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op13_hard_negatives(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.select("vec_id", label.alias("label"), "embedding"), F.col("id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language, op2_exact_dedup, op3_packing, op4_sentencepiece, op5_licenses, op6_simhash,
                            op7_url_rules, op8_token_counts, op9_substrings, op10_search, op11_conversation_trie, op12_warc,
                            op13_hard_negatives)
}

ORACLE: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
                   FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op7_url_rules": r"""
        WITH p AS (SELECT page_id,
                 coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
                                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                 coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
               FROM pages),
             rules(h, p, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                             ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
             fits AS (SELECT page_id, arg_max(h || rules.p, length(h || rules.p)) AS rule,
                             arg_max(verdict, length(h || rules.p)) AS verdict
                      FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p)
                      GROUP BY page_id)
        SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM p LEFT JOIN fits ON p.page_id = fits.page_id""",
    "op11_conversation_trie": r"""
        WITH own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS i
               FROM conversations WHERE conv_id IS NOT NULL),
             c AS (SELECT conv_id, conv_id - conv_id % 100 AS base,
                 xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
                       lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
                     lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s // 2, 3988292384 * (s % 2)) END), 4294967295) % 6 AS h
               FROM (SELECT DISTINCT conv_id FROM own)),
             turns AS (SELECT c.conv_id, id, text, 0 AS part, i FROM c JOIN own ON own.conv_id = base AND i <= h
                       UNION ALL SELECT c.conv_id, id, text, 1, i FROM c JOIN own ON own.conv_id = c.conv_id AND i > h),
             prefixes AS (SELECT conv_id, row_number() OVER w AS depth, md5(string_agg(id, '') OVER w) AS node, length(text) AS size
                          FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)
                          UNION ALL SELECT conv_id, 0, '', 0 FROM c),
             nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(size) AS saved
                       FROM prefixes GROUP BY node, depth),
             ups AS (SELECT nodes.node, nodes.conv_id AS child, nodes.depth, saved, p.node AS above, p.depth AS above_depth
                     FROM nodes JOIN prefixes p ON p.conv_id = nodes.conv_id AND p.depth <= nodes.depth),
             kids AS (SELECT above AS node, count(*) AS n_children FROM ups WHERE above_depth = depth - 1 GROUP BY above),
             below AS (SELECT above AS node, sum(saved) AS saved_tokens, count(*) FILTER (node NOT IN (SELECT node FROM kids)) AS n_leaves
                       FROM ups GROUP BY above),
             ends AS (SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
                      FROM (SELECT * FROM prefixes QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) GROUP BY node)
        SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n AS BIGINT) AS n_convs,
               CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
               CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
        FROM nodes n JOIN below USING (node) LEFT JOIN kids USING (node) LEFT JOIN ends USING (node)
        LEFT JOIN ups u ON u.node = n.node AND u.above_depth = n.depth - 1 LEFT JOIN nodes p ON p.node = u.above""",
    "op12_warc": r"""
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
                   FROM pages),
             f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
        FROM f""",
    "op13_hard_negatives": r"""
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
               FROM embeddings
               WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS id, a.label = b.label AS same,
                          CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
                   FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
             p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, id, br) <= 5),
             n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                          row_number() OVER (PARTITION BY p.ar, p.br ORDER BY s.score DESC, s.id, s.br) AS rank
                   FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
