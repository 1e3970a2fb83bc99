"""The corpus operators as queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact_dedup, html_text, licenses, manifest, mixing, phrases, quality, simhash, token_files, toxicity, warc
from .common import table

#: Weights of the mix by path: the single-digit sources count double, and English a half more than other languages.
MIX_WEIGHTS = {("srcx",): 2.0, ("srcx", "en"): 1.5, ("src1x", "en"): 1.5}


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=MIX_WEIGHTS)
    return mixed.select("doc_id", mixing.domain_of(F.col("source")).alias("domain"), "lang", "source")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where("vec_id % 20 = 0"), id_col="vec_id", vec_col="embedding")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.best(table(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.check(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_html_text": op2_html_text,
    "op3_warc": op3_warc,
    "op4_simhash": op4_simhash,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_ann": op6_ann,
    "op7_token_files": op7_token_files,
    "op8_quality": op8_quality,
    "op9_mixing": op9_mixing,
    "op10_bpe": op10_bpe,
    "op11_phrases": op11_phrases,
    "op12_manifest": op12_manifest,
    "op13_toxicity": op13_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
        WITH t AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        f AS (SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest, min(page_id) OVER (PARTITION BY body) AS first FROM t)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes < 100 OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN payload_bytes < 100 OR page_id = first THEN NULL ELSE first END AS refers_to
        FROM f
    """,
    "op5_exact_dedup": """
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body FROM documents)
        SELECT doc_id,
               min(doc_id) OVER (PARTITION BY body) AS keep_id,
               count(*) OVER (PARTITION BY body) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY body) AS kept,
               sha256(body) AS text_sha256
        FROM t
    """,
    "op11_phrases": """
        WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
        w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
        n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
        k AS (SELECT unnest([1, 2, 3]) AS size),
        g AS (SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS gram FROM w, k),
        f AS MATERIALIZED (SELECT lang, size, gram, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
        c AS MATERIALIZED (SELECT lang, gram AS phrase, f AS a, size, string_split(gram, ' ') AS ws FROM f WHERE size > 1),
        parts AS MATERIALIZED (SELECT lang, phrase, a, k.size AS k, array_to_string(ws[:k.size], ' ') AS first, array_to_string(ws[k.size + 1:], ' ') AS rest FROM c JOIN k ON k.size < c.size),
        cuts AS (SELECT p.lang, phrase, a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
                 FROM parts p JOIN f x ON x.lang = p.lang AND x.gram = first JOIN f y ON y.lang = p.lang AND y.gram = rest),
        scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        around AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE size = 3) GROUP BY ALL),
        kept AS (SELECT s.* FROM scored s LEFT JOIN around USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
        ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang))
        SELECT * FROM ranked WHERE rank <= 2000
    """,
    "op12_manifest": """
        WITH RECURSIVE d AS (
            SELECT doc_id, source, lang, n_chars, text,
                   xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
                       lambda crc, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, b)), 4294967295::BIGINT), 4294967295) % 2 = 0 AS even
            FROM documents),
        e AS (SELECT doc_id, source, even,
                     concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
                     text, replace(text, chr(10), '') AS flat
              FROM d),
        leaves AS (SELECT doc_id, source, sha256(concat(head, coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
                          CASE WHEN even THEN sha256(concat(head, coalesce(strlen(flat) || ':' || flat, '-'))) END AS other
                   FROM e),
        placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
        tree AS (
            SELECT source, 0 AS level, list(leaf ORDER BY i) AS nodes FROM placed GROUP BY source
            UNION ALL
            SELECT source, level + 1, list_transform(range(0, len(nodes), 3), lambda j: sha256(array_to_string(nodes[j + 1:j + 3], ''))) FROM tree WHERE len(nodes) > 1),
        subroots AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s, level AS depth FROM tree WHERE len(nodes) = 1),
        above AS (
            SELECT 0 AS level, list(subroot ORDER BY s) AS nodes FROM subroots
            UNION ALL
            SELECT level + 1, list_transform(range(0, len(nodes), 3), lambda j: sha256(array_to_string(nodes[j + 1:j + 3], ''))) FROM above WHERE len(nodes) > 1),
        steps AS (
            SELECT p.doc_id, p.leaf, p.source, t.level, t.nodes, (p.i // (3 ** t.level)::BIGINT)::BIGINT AS pos FROM placed p JOIN tree t ON t.source IS NOT DISTINCT FROM p.source WHERE len(t.nodes) > 1
            UNION ALL
            SELECT p.doc_id, p.leaf, p.source, s.depth + a.level, a.nodes, (s.s // (3 ** a.level)::BIGINT)::BIGINT FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source CROSS JOIN above a WHERE len(a.nodes) > 1),
        sides AS (SELECT doc_id, source, leaf, level, array_to_string(nodes[pos - pos % 3 + 1:pos], '') AS before, array_to_string(nodes[pos + 2:pos - pos % 3 + 3], '') AS after FROM steps),
        proofs AS (SELECT doc_id, source, leaf, list(before ORDER BY level) AS b, list(after ORDER BY level) AS a FROM sides GROUP BY ALL),
        fold AS (
            SELECT p.doc_id, p.source, p.leaf, 0 AS level, coalesce(p.other, p.leaf) AS h, b, a FROM placed p JOIN proofs q ON q.doc_id IS NOT DISTINCT FROM p.doc_id AND q.source IS NOT DISTINCT FROM p.source AND q.leaf = p.leaf
            UNION ALL
            SELECT doc_id, source, leaf, level + 1, sha256(concat(b[level + 1], h, a[level + 1])), b, a FROM fold WHERE level < len(b)),
        root AS (SELECT nodes[1] AS root FROM above WHERE len(nodes) = 1)
        SELECT f.doc_id, f.leaf, s.subroot, root, sha256(array_to_string(list_transform(range(1, len(b) + 1), lambda j: b[j] || a[j]), '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
        FROM fold f JOIN subroots s ON s.source IS NOT DISTINCT FROM f.source CROSS JOIN root WHERE f.level = len(b)
    """,
}
