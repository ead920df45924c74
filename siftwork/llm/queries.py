"""The queries of the numbered operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm import additive_ann, bpe, chat, html_text, image_copies, language_id, lexical_search, near_dedup, packing, quality, source_audit, suffix_dedup, token_counts
from siftwork.llm.common import held_out, table

#: Where the tokenizer files are; callers may pass other paths to the operators.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", token_counts.by_lines(F.col("text")).alias("parts"))
    return token_counts.attribute(docs, BYTE_RANKS, rule="most")


def op2_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), WORD_BPE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_bagminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_dedup.near_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    values = ", ".join(f"({c}L, {t}L, '{r}', r'{x}')" for c, t, r, x in extra)
    given = spark.sql(f"SELECT * FROM VALUES {values} AS v(conv_id, turn, role, text)")
    return chat.digests(chat.read_back(chat.formatted(chat.conversations(rows.unionByName(given)))))


def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs.where(~held_out()), labels.where(~held_out()))
    scored = quality.score(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op8_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test tables hold no pictures; the media column is a preview drawn from each page's visible text."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("media_id"), image_copies.page_text(F.col("html")).alias("shown"))
    classes = image_copies.copy_classes(image_copies.previews(pages, "shown").select("media_id", "image"))
    return classes.select(F.col("media_id").alias("page_id"), "class_id", "n_corners")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out()))
    return language_id.identify(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op10_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(docs, WORD_BPE, bpe.compile_lexicon(docs, WORD_BPE))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(lexical_search.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_attribution, op2_additive_ann, op3_bm25_packing, op4_bagminhash_dedup, op5_chat_format, op6_pu_quality, op7_suffix_dedup, op8_image_copies, op9_language_id, op10_bpe_transducer, op11_source_audit, op12_lexical_search, op13_html_text)}

#: DuckDB SQL for those that SQL can express.
ORACLES: dict[str, str] = {
    "op5_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
        ), shown AS (
            SELECT *, coalesce(map {'system': 'System', 'user': 'User', 'assistant': 'Assistant'}[role], role) AS label FROM turns
        ), escaped AS (
            SELECT *, replace(replace(replace(text, '\', '\e'), '### ', '\o'), '</turn>', '\m') AS body,
                CASE WHEN role IN ('System', 'User', 'Assistant') THEN '\r' ELSE '' END
                || replace(replace(replace(replace(label, '\', '\e'), '### ', '\o'), '</turn>', '\m'), ': ', '\c') AS head
            FROM shown
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length('### ' || head || ': ' || body || chr(10) || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars,
            regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn NULLS FIRST, role, text), 's?(ua)+') AS valid
        FROM escaped GROUP BY conv_id
    """,
    "op11_source_audit": r"""
        WITH docs AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
        words AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
        kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 30),
        counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
        totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
        shares AS (SELECT k.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
            FROM kept k JOIN langs l USING (lang) JOIN totals g USING (lang) LEFT JOIN counts c USING (lang, source, term)),
        pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(s.p - t.p)), 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN shares s ON s.lang = a.lang AND s.source = a.source LEFT JOIN shares t ON t.lang = b.lang AND t.source = b.source AND t.term = s.term GROUP BY ALL)
        SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
        UNION ALL
        SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS INTEGER) AS rank FROM shares WHERE n > 0 AND p > q
        QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= 50
    """,
    "op12_lexical_search": r"""
        WITH docs AS (SELECT row_number() OVER () AS d, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        words AS (SELECT d, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
        sizes AS (SELECT d, count(*) AS n FROM words GROUP BY d), whole AS (SELECT count(*) AS n, sum(n)::BIGINT AS l FROM sizes),
        asked AS (SELECT DISTINCT i, item_id, term FROM (SELECT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS i, * FROM benchmark))),
        times AS (SELECT d, doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
        dfs AS (SELECT term, CAST(floor(1000 * ln((2 * w.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM times, whole w GROUP BY term, w.n),
        scores AS (SELECT i, item_id, d, doc_id, CAST(sum(f.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * s.n * w.n) // w.l)))) AS BIGINT) AS score
            FROM asked JOIN times USING (term) JOIN dfs f USING (term) JOIN sizes s USING (d), whole w GROUP BY ALL)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) <= 50
    """,
}
