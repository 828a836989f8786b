"""The registered queries of this subpackage and the DuckDB statement of each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from shopspark.llm import (
    exact_dedup, grouped_packing, hard_negatives, jaccard, licenses, mixing, packing, prefix_trie, resampling, tool_calls, topk,
    toxicity, warc,
)
from shopspark.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    def prepared(spark: SparkSession, root: str) -> DataFrame:
        return run(configure(spark), root)

    QUERIES[run.__name__] = prepared
    return prepared


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


@query
def op1_exact_dedup(spark, root):
    return exact_dedup.exact_duplicates(table(spark, root, "documents"))


@query
def op2_warc(spark, root):
    return warc.page_records(table(spark, root, "pages"))


@query
def op3_toxicity(spark, root):
    return toxicity.toxicity_report(table(spark, root, "documents"), table(spark, root, "labels"))


@query
def op4_ngram_jaccard(spark, root):
    return jaccard.similar_groups(table(spark, root, "documents"))


@query
def op5_mixing(spark, root):
    return mixing.mix_report(table(spark, root, "documents"))


@query
def op6_packing(spark, root):
    return packing.pack_documents(
        table(spark, root, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN,
        encode_special_tokens=False,
    )


@query
def op7_chat_formatting(spark, root):
    return tool_calls.conversation_frames(table(spark, root, "conversations"))


@query
def op8_license_scan(spark, root):
    return licenses.license_report(table(spark, root, "documents"))


@query
def op9_exact_topk(spark, root):
    return topk.exact_top_k(table(spark, root, "embeddings"))


@query
def op10_quality_resampling(spark, root):
    return resampling.importance_sample(table(spark, root, "documents"), table(spark, root, "labels"))


@query
def op11_best_fit_packing(spark, root):
    return grouped_packing.pack_best_fit(table(spark, root, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op12_hard_negatives(spark, root):
    return hard_negatives.mined_report(table(spark, root, "embeddings"))


@query
def op13_prefix_trie(spark, root):
    return prefix_trie.conversation_trie(table(spark, root, "conversations"))


@query
def pipeline(spark, root):
    return corpus_pipeline.run(spark, root)


SQL: dict[str, str] = {
    "op7_chat_formatting": """
        WITH calls AS (
            SELECT conv_id, turn, conv_id || ':' || turn AS call_id,
                   CASE WHEN role = 'system' THEN 'instruct' ELSE 'ask' END AS tool,
                   json_object('text', text, 'turn', turn)::VARCHAR AS arguments,
                   turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island
            FROM conversations WHERE coalesce(role, '') <> 'assistant'
        ), ordered AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS level FROM calls
        ), answers AS (
            SELECT conv_id || ':' || (turn - 1) AS call_id, max(text) AS content, count(*) AS results
            FROM conversations WHERE role = 'assistant' GROUP BY 1
        )
        SELECT coalesce(o.call_id, a.call_id) AS call_id, tool, level,
               CASE WHEN o.call_id IS NULL THEN 'no call' ELSE '' END AS errors,
               CASE WHEN o.call_id IS NULL THEN 1 ELSE 0 END::INTEGER AS n_errors,
               o.call_id IS NOT NULL AS has_call, a.call_id IS NOT NULL AS has_result, coalesce(results, 0) AS results,
               CASE WHEN o.call_id IS NULL THEN json_object('result', content)
                    WHEN content IS NULL THEN json_object('call', json_object('arguments', arguments, 'id', o.call_id, 'name', tool),
                                                          'level', level)
                    ELSE json_object('call', json_object('arguments', arguments, 'id', o.call_id, 'name', tool),
                                     'level', level, 'result', content) END::VARCHAR AS json
        FROM ordered o FULL JOIN answers a ON o.call_id = a.call_id""",
    "op9_exact_topk": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS parts
            FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.parts, v.parts)::BIGINT AS score
            FROM whole q JOIN whole v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND len(q.parts) = len(v.parts)
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op1_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op2_warc": """
        WITH hashed AS (
            SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex,
                   max(page_id) OVER (PARTITION BY coalesce(html, '')) AS kept
            FROM pages
        )
        SELECT page_id,
               strlen(body)::BIGINT AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   ((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT >> (5 * (7 - i % 8))) & 31)::INT + 1, 1)),
                   'string_agg', '') AS payload_digest,
               CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> kept THEN kept END AS refers_to
        FROM hashed""",
    "op5_mixing": r"""
        WITH sizes AS (
            SELECT doc_id, source,
                   coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   sha256(coalesce(doc_id::VARCHAR, '')) AS hex
            FROM documents
        ), totals AS (
            SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
        ), weighted AS (
            SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight FROM totals
        ), prefixes AS (
            -- Sources reach their limit in the order of size by weight.
            SELECT *, sum(source_size) OVER ()::BIGINT
                      - (sum(3 * source_size) OVER before - 3 * source_size)::BIGINT AS rest,
                   sum(weight) OVER ()::BIGINT - (sum(weight) OVER before - weight)::BIGINT AS shares,
                   row_number() OVER before AS place
            FROM weighted
            WINDOW before AS (ORDER BY source_size / weight, source ROWS UNBOUNDED PRECEDING)
        ), level AS (
            SELECT rest, shares FROM prefixes
            WHERE 3::HUGEINT * source_size * shares > rest::HUGEINT * weight ORDER BY place LIMIT 1
        ), targets AS (
            SELECT source, source_size,
                   least(3.0::DOUBLE * source_size, coalesce((SELECT rest::DOUBLE FROM level) * weight
                         / (SELECT shares::DOUBLE FROM level), 3.0::DOUBLE * source_size)) AS target
            FROM weighted
        ), rates AS (
            SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets
        ), draws AS (
            SELECT d.source, k, abs(sum(CASE WHEN ('0x' || substr(hex, 8 * k + 1, 8))::BIGINT / 4294967296.0::DOUBLE
                                             < rate - floor(rate) THEN size ELSE 0 END)::DOUBLE
                                    - (any_value(rate) - floor(any_value(rate))) * any_value(source_size)) AS miss
            FROM sizes d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source, range(8) t(k)
            GROUP BY d.source, k
        ), best AS (
            SELECT source, k FROM draws QUALIFY row_number() OVER (PARTITION BY source ORDER BY miss, k) = 1
        )
        SELECT doc_id, size, source_size, target,
               (size * (floor(rate) + CASE WHEN ('0x' || substr(hex, 8 * k + 1, 8))::BIGINT / 4294967296.0::DOUBLE
                                                < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM sizes d
        JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
        JOIN best b ON d.source IS NOT DISTINCT FROM b.source""",
    "op12_hard_negatives": """
        WITH whole AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS parts
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.parts, v.parts)::BIGINT AS score
            FROM whole a JOIN whole v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id AND len(a.parts) = len(v.parts)
        ), positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT p.anchor_id, positive_id,
               row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
             AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
        QUALIFY rank <= 10""",
    "op13_prefix_trie": r"""
        WITH numbered AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                       sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
            FROM conversations WHERE conv_id IS NOT NULL
        ), convs AS (
            SELECT conv_id, list({'role': role, 'text': text} ORDER BY place) AS own,
                   -- crc32 of the decimal digits: eight shifts for each byte.
                   (xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
                       lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                       lambda acc, x: xor(xor(acc, x) >> 1, 3988292384::BIGINT * (xor(acc, x) & 1))), 4294967295::BIGINT) % 4)::INT AS h
            FROM numbered GROUP BY conv_id
        ), rebuilt AS (
            SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) AS turns
            FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20
        ), paths AS (
            SELECT conv_id, d AS depth, turns[1:d] AS node, CASE WHEN d > 0 THEN turns[1:d - 1] END AS parent,
                   d = len(turns) AS ends, turns[d].text AS last_text
            FROM rebuilt, unnest(range(len(turns) + 1)) AS t(d)
        ), nodes AS (
            SELECT node, any_value(parent) AS parent, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs,
                   (count(*) - 1) * coalesce(len(regexp_extract_all(any_value(last_text), '[^\x20\x09-\x0D]+')), 0) AS saved,
                   coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ended
            FROM paths GROUP BY node
        ), children AS (
            SELECT parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent
        ), valued AS (
            SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.node = c.node
        ), sums AS (
            -- A node's smallest member passes all nodes above it.
            SELECT p.node, sum((v.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(v.saved)::BIGINT AS saved_tokens
            FROM valued v JOIN paths p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY p.node
        )
        SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens,
               sha256(v.ended) AS ends_sha256
        FROM valued v JOIN sums s ON s.node = v.node LEFT JOIN nodes u ON u.node = v.parent""",
}
