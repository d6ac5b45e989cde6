"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpact.llm import bpe, chat, decontamination, html_text, language_model, licenses, simhash, toxicity, vector_search, warc
from sparkpact.llm.common import read_table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def license_sql() -> str:
    """Whole documents against whole templates, by their sets of shingles."""
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in sorted(licenses.TEMPLATES.items()))
    words = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"""
        WITH t AS (SELECT license, {words.format("text")} AS w FROM (VALUES {values}) v(license, text)),
        ts AS (SELECT DISTINCT license, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT license, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
        tn AS (SELECT license, count(*) AS n_shingles FROM ts GROUP BY license),
        d AS (SELECT row_number() OVER () AS r, doc_id, {words.format("coalesce(text, '')")} AS w FROM documents),
        ds AS (SELECT r, doc_id, i - 1 AS pos, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
        m AS (SELECT r, doc_id, license, count(DISTINCT s) AS n_found, min(pos)::BIGINT AS first_word, max(pos)::BIGINT + 4 AS last_word FROM ds JOIN ts USING (s) GROUP BY r, doc_id, license)
        SELECT doc_id, license, n_shingles, n_found, n_found / n_shingles AS containment, first_word, last_word
        FROM m JOIN tn USING (license) WHERE n_found / n_shingles >= 0.8
    """


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(read_table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(read_table(spark, sf_dir, "documents"))


def op6_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with an echo for its first reply; spans as text, start-end joined by commas."""
    chosen, rejected, long = chat.echo_rejections(read_table(spark, sf_dir, "conversations"))
    pairs = chat.preference_pairs(chosen, rejected, long=long)
    as_text = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return pairs.withColumns({c: as_text(c) for c in ("chosen_spans", "rejected_spans")})


def op7_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def decontamination_sql() -> str:
    """Every window of every length that items have, in every document."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, {words} AS w FROM documents),
        b AS (SELECT item_id::VARCHAR AS item, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
        bw AS (SELECT DISTINCT item, len(x) AS n, array_to_string(x, ' ') AS s FROM (SELECT item, w[i : i + 9] AS x FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0))),
        sizes AS (SELECT DISTINCT n FROM bw),
        dw AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
        h AS (SELECT r, i, n, item FROM dw JOIN bw USING (n, s)),
        p AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM h) GROUP BY r),
        m AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS names FROM h GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN p USING (r) LEFT JOIN m USING (r)
    """


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_warc": op2_warc,
    "op3_bpe": op3_bpe,
    "op4_simhash": op4_simhash,
    "op5_language_model": op5_language_model,
    "op6_preference_pairs": op6_preference_pairs,
    "op7_pivot_top_k": op7_pivot_top_k,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_html_text": op10_html_text,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": license_sql(),
    "op2_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ),
        r AS (
            SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM r
    """,
    "op6_preference_pairs": """
        WITH t AS (SELECT conv_id, turn, role, replace(text, '<|', '< |') AS text FROM conversations),
        f AS (SELECT conv_id, min(turn) AS first FROM t WHERE role = 'assistant' GROUP BY conv_id),
        e AS (
            SELECT conv_id, any_value(first) AS first, max(text) FILTER (turn = first) AS reply, coalesce(arg_max(text, turn) FILTER (turn < first), '') AS echo
            FROM t JOIN f USING (conv_id) GROUP BY conv_id
        ),
        k AS (
            SELECT t.*, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS whole, length(role) + 13 AS head,
                   coalesce(turn < first OR turn = first AND reply = echo, true) AS common
            FROM t LEFT JOIN e USING (conv_id)
        ),
        p AS (SELECT *, coalesce(sum(length(whole)) OVER (PARTITION BY conv_id, common ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM k),
        s AS (
            SELECT conv_id, (count(*) FILTER (common))::INTEGER AS prompt_turns, coalesce(string_agg(whole, '' ORDER BY turn) FILTER (common), '') AS prompt,
                   coalesce(string_agg(whole, '' ORDER BY turn) FILTER (NOT common), '') AS chosen,
                   coalesce(string_agg((place + head) || '-' || (place + length(whole) - 1), ',' ORDER BY turn) FILTER (NOT common AND role = 'assistant'), '') AS chosen_spans
            FROM p GROUP BY conv_id
        )
        SELECT conv_id, 0::BIGINT AS part, prompt_turns, prompt, chosen, chosen_spans,
               CASE WHEN coalesce(reply = echo, true) THEN '' ELSE '<|im_start|>assistant' || chr(10) || echo || '<|im_end|>' || chr(10) END AS rejected,
               CASE WHEN coalesce(reply = echo, true) THEN '' ELSE '22-' || (32 + length(echo)) END AS rejected_spans
        FROM s LEFT JOIN e USING (conv_id)
    """,
    "op8_decontamination": decontamination_sql(),
    "op7_pivot_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS x
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        ),
        s AS (
            SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id
        ),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
}
