"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from logweave.llm import (
    bpe,
    exact_dedup,
    filter_audit,
    html_extract,
    merkle,
    packing,
    pii,
    quality_conv,
    quality_rules,
    simhash,
    toxicity,
    url_filter,
    warc,
)
from logweave.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read_table(spark, folder, "documents"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    return toxicity.score(documents, toxicity.train(documents, read_table(spark, folder, "labels")))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(read_table(spark, folder, "pages"))


def op7_quality_conv(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    return quality_conv.score(documents, quality_conv.train(documents, read_table(spark, folder, "labels")))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    return quality_rules.judge(documents, quality_rules.train(documents, read_table(spark, folder, "labels")))


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(read_table(spark, folder, "documents"))


def op1_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract_pages(read_table(spark, folder, "pages"))


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, folder, "documents"))


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages")
    labelled = url_filter.labelled_urls(pages, read_table(spark, folder, "labels"))
    return url_filter.judge_urls(pages, url_filter.mine_rules(labelled))


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.dedup_documents(read_table(spark, folder, "documents"))


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(read_table(spark, folder, "documents"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op13_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(read_table(spark, folder, "documents"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Query] = {
    "op1_html": op1_html,
    "op2_simhash": op2_simhash,
    "op3_url_filter": op3_url_filter,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_warc": op6_warc,
    "op7_quality_conv": op7_quality_conv,
    "op8_quality_rules": op8_quality_rules,
    "op9_bpe": op9_bpe,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_merkle": op11_merkle,
    "op12_filter_audit": op12_filter_audit,
    "op13_pii": op13_pii,
    "pipeline": pipeline,
}


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ["doc_id", "source", "lang", "n_chars", text])) + ")"


#: crc32 of the decimal doc_id, bit by bit.
_CRC = """
    xor(4294967295::UBIGINT, list_reduce(
        list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
        lambda made, byte: list_reduce(
            list_prepend(xor(made, byte), [0::UBIGINT, 1, 2, 3, 4, 5, 6, 7]),
            lambda bits, n: xor(bits >> 1, 3988292384::UBIGINT * (bits & 1)))))
"""
_RUN = "OVER (PARTITION BY level, tree, idx // 16 ORDER BY idx ROWS BETWEEN"


def _levels(name: str, leaves: str) -> str:
    """Nodes of all levels, and the digests before and after each in its run."""
    return f"""
        {name}(level, tree, idx, n, digest) AS (
            {leaves}
            UNION ALL
            SELECT level + 1, tree, idx // 16, any_value((n + 15) // 16), sha256(string_agg(digest, '' ORDER BY idx))
            FROM {name} WHERE n > 1 GROUP BY level, tree, idx // 16
        ), {name}_steps AS (
            SELECT level, tree, idx,
                   coalesce(string_agg(digest, '') {_RUN} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
                   coalesce(string_agg(digest, '') {_RUN} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind
            FROM {name} WHERE n > 1
        )"""


SQL: dict[str, str] = {
    "op6_warc": """
        WITH payloads AS (
            SELECT page_id, sha256(coalesce(html, '')) AS payload_digest,
                   strlen(coalesce(html, ''))::BIGINT AS payload_bytes
            FROM pages
        ), firsts AS (
            SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id
            FROM payloads
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM firsts
    """,
    "op10_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
    "op11_merkle": f"""
        WITH RECURSIVE leaves AS (
            SELECT doc_id, source, {_leaf("text")} AS leaf,
                   CASE WHEN {_CRC} % 5 = 0
                        THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
                   END AS forged
            FROM documents
        ), placed AS (
            SELECT *, row_number() OVER () AS number,
                   dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
                   row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
                   count(*) OVER (PARTITION BY source) AS n
            FROM leaves
        ), {_levels("nodes", "SELECT 0, tree, idx, n, leaf FROM placed")},
        tops AS (SELECT tree, level, digest FROM nodes WHERE n = 1),
        {_levels("uppers", "SELECT 0, 0::BIGINT, tree, count(*) OVER (), digest FROM tops")},
        paths AS (
            SELECT number, level AS place, before, behind
            FROM placed JOIN nodes_steps s ON s.tree = placed.tree AND s.idx = placed.idx // (1::BIGINT << (4 * s.level))
            UNION ALL
            SELECT number, tops.level + s.level, before, behind
            FROM placed JOIN tops ON tops.tree = placed.tree
            JOIN uppers_steps s ON s.idx = placed.tree // (1::BIGINT << (4 * s.level))
        ), folded(number, place, digest) AS (
            SELECT number, 0, coalesce(forged, leaf) FROM placed
            UNION ALL
            SELECT f.number, f.place + 1, sha256(before || f.digest || behind)
            FROM folded f JOIN paths p ON p.number = f.number AND p.place = f.place
        ), ends AS (
            SELECT number, arg_max(digest, place) AS folded_root FROM folded GROUP BY number
        ), proofs AS (
            SELECT number, sha256(string_agg(before || behind, '' ORDER BY place)) AS proof FROM paths GROUP BY number
        )
        SELECT doc_id, leaf, tops.digest AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root,
               folded_root = root AS verified
        FROM placed JOIN tops ON tops.tree = placed.tree
        JOIN ends ON ends.number = placed.number
        LEFT JOIN proofs ON proofs.number = placed.number,
        (SELECT digest AS root FROM uppers WHERE n = 1)
    """,
    "op12_filter_audit": """
        WITH letters(name) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
        orders AS (
            SELECT a.name || b.name || c.name || d.name || e.name AS filter_order
            FROM letters a, letters b, letters c, letters d, letters e
            WHERE b.name <> a.name AND c.name NOT IN (a.name, b.name) AND d.name NOT IN (a.name, b.name, c.name)
              AND e.name NOT IN (a.name, b.name, c.name, d.name)
        ), texts AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
        ), words AS (
            SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts
        ), failed AS (
            SELECT doc_id, part,
                   CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
                || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
                || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) THEN 'C' ELSE '' END
                || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
                || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
            FROM words
        ), marked AS (
            SELECT part, fails, coalesce(good, false) AS good, coalesce(bad, false) AS bad
            FROM failed LEFT JOIN (
                SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS bad FROM labels GROUP BY doc_id
            ) USING (doc_id)
        ), counted AS (
            SELECT part, fails, good, bad, count(*) AS n FROM marked GROUP BY ALL
        ), steps AS (
            SELECT filter_order, step::INT AS step, filter_order[step] AS own, filter_order[1:step - 1] AS before
            FROM orders, range(1, 6) t(step)
        ), judged AS (
            SELECT *, contains(fails, own) AS hit, translate(fails, before, '') <> fails AS gone
            FROM counted, steps
        ), summed AS (
            SELECT part, filter_order, step, own,
                   coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept,
                   coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
                   coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant,
                   coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
                   coalesce(sum(n) FILTER (hit AND NOT gone AND good), 0)::BIGINT AS good_lost,
                   coalesce(sum(n) FILTER (hit AND NOT gone AND bad), 0)::BIGINT AS toxic_lost
            FROM judged GROUP BY ALL
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley
        FROM summed
    """,
}
