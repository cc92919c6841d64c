"""The registered queries of this folder, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from promptloom.llm import (
    archives, bpe_trie, decontaminate, infill, licences, minmax, neighbours, pii, quality, shards, suffixes, token_counts, whitening,
)
from promptloom.plans.registry import table
from promptloom.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

VOCABULARY = "byte_bpe_50k.json"


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


@query
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY), limit=512)


@query
def op10_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_trie.round_trip(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


@query
def op9_sampled_splitters(spark: SparkSession, folder: str) -> DataFrame:
    return shards.shard(table(spark, folder, "documents"), 8)


@query
def op2_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("id") % 50 == 0, 5)


@query
def op3_minmax_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, folder, "documents"), width=4, threshold=80)


@query
def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_LEAK_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
#: All windows that hold a place with a shingle of the item, in documents with enough of them; the similarity of their
#: shingles, counted with their weights.  A document shorter than the item is one window.
CHECKS["op6_benchmark_decontamination"] = f"""
WITH items AS (SELECT item_id, words, len(words) AS n_item, least(5, len(words)) AS width
               FROM (SELECT DISTINCT item_id, {_LEAK_WORDS} AS words FROM benchmark) WHERE len(words) > 0),
places AS (SELECT item_id, n_item, width, unnest(range(0, n_item - width + 1)) AS item_at, words FROM items),
item_grams AS (SELECT item_id, n_item, width, array_to_string(words[item_at + 1 : item_at + width], ' ') AS g FROM places),
item_weights AS (SELECT item_id, n_item, width, g, count(*) AS weight FROM item_grams GROUP BY ALL),
docs AS (SELECT DISTINCT doc_id, {_LEAK_WORDS} AS words FROM documents),
doc_grams AS (SELECT doc_id, words, width, p, array_to_string(words[p + 1 : p + width], ' ') AS g
              FROM (SELECT doc_id, words, width, unnest(range(0, len(words) - width + 1)) AS p
                    FROM docs CROSS JOIN (SELECT DISTINCT width FROM items))),
hits AS (SELECT doc_id, words, item_id, n_item, d.width, p, least(n_item, len(words)) AS size
         FROM doc_grams d JOIN item_weights i ON d.g = i.g AND d.width = i.width),
enough AS (SELECT doc_id, words, item_id FROM hits GROUP BY doc_id, words, item_id, n_item, width HAVING count(*) * 100 >= (n_item - width + 1) * 80),
begins AS (SELECT h.doc_id, h.words, h.item_id, n_item, width, size,
                  unnest(range(greatest(p - size + width, 0), least(p, len(h.words) - size) + 1)) AS begin
           FROM hits h JOIN enough e ON h.doc_id IS NOT DISTINCT FROM e.doc_id AND h.words = e.words AND h.item_id = e.item_id),
windows AS (SELECT DISTINCT doc_id, item_id, n_item, width, size, begin, words[begin + 1 : begin + size] AS w FROM begins),
window_grams AS (SELECT doc_id, item_id, n_item, width, size, begin, g, count(*) AS weight
                 FROM (SELECT doc_id, item_id, n_item, width, size, begin, array_to_string(w[p + 1 : p + width], ' ') AS g
                       FROM (SELECT *, unnest(range(0, size - width + 1)) AS p FROM windows)) GROUP BY ALL),
shared AS (SELECT w.doc_id, w.item_id, w.n_item, w.width, size, begin, sum(least(w.weight, i.weight)) AS common
           FROM window_grams w JOIN item_weights i ON w.g = i.g AND w.item_id = i.item_id AND w.n_item = i.n_item GROUP BY ALL),
scored AS (SELECT doc_id, item_id, begin, size, common, size + n_item - 2 * width + 2 - common AS whole FROM shared)
SELECT doc_id, item_id, CAST(begin AS INTEGER) AS first_word, CAST(size AS INTEGER) AS n_words,
       CAST(common AS DOUBLE) / CAST(whole AS DOUBLE) AS similarity
FROM scored WHERE common * 100 >= whole * 80
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY CAST(common AS DOUBLE) / whole DESC, begin) = 1
"""


@query
def op5_licence_notices(spark: SparkSession, folder: str) -> DataFrame:
    return licences.notices(table(spark, folder, "documents"))


@query
def op8_quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op4_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


@query
def op1_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, folder, "documents"))


@query
def op11_warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    written = scratch_path(spark, "archives")
    archives.write_archives(table(spark, folder, "pages"), written, least=0)
    records = archives.read_archives(spark, written)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


CHECKS["op11_warc_archives"] = """
WITH digests AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM digests)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(1 + (CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) // CAST(pow(32, 3 - i % 4) AS BIGINT)) % 32 AS BIGINT), 1)), '')
           AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM firsts
"""


@query
def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"), components=8)


@query
def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return infill.digests(table(spark, folder, "documents"))


CHECKS["op13_fill_in_middle"] = """
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
units AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u,
                 CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
                 CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM hashed),
cuts AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
                CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                     WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
