"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import encode_decode
from .chat import digests, format_chats
from .common import held_out, table
from .embedding_dedup import near_vectors
from .exact_dedup import exact_dedup
from .html_text import extract_text
from .ngram_jaccard import jaccard_components
from .packing import pack
from .quality import fit_quality, score_quality
from .token_counts import count_tokens
from .toxicity import fit_toxicity, score_toxicity

#: Scores from which a document counts as toxic, and as good.
TOXIC_FROM, GOOD_FROM = 0.5, 0.3


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_decode(table(spark, sf_dir, "documents"), ranks, full=False)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = "</s>[INST] ok [/INST]"
    kinds = "conv_id long, turn long, role string, text string"
    extra = spark.createDataFrame([(-7, 0, "user", asked), (-7, 1, "assistant", asked)], kinds)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_chats(rows.unionByName(extra)))


def _judged(scores: DataFrame, threshold: float) -> DataFrame:
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return scores.select("doc_id", held_out().alias("held_out"), "score", predicted)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return _judged(score_toxicity(docs, model), TOXIC_FROM)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit_quality(docs, table(spark, sf_dir, "labels"))
    return _judged(score_quality(docs, net), GOOD_FROM)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op6_exact_dedup": op6_exact_dedup,
    "op2_html_text": op2_html_text,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_quality": op5_quality,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op10_chat_format": op10_chat_format,
    "op9_packing": op9_packing,
}

#: The characters and control strings that op10's template escapes, as a regular expression.
_RISKY = r"(\\|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|user\|>|<\|assistant\|>|<\|system\|>)"

#: What both recursive queries end in: the least id that is reachable by symmetric links.
_REACHED = """r(a, b) AS (SELECT id, id FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a AS id, min(b) AS component FROM r GROUP BY 1)"""

ORACLE_SQL = {
    "op1_ngram_jaccard": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id AS id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
        ),
        s AS (
            SELECT DISTINCT id, unnest(list_transform(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w
        ),
        n AS (SELECT w.id, count(s) AS n FROM w LEFT JOIN s ON w.id = s.id GROUP BY 1),
        both_ AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.id <> b.id GROUP BY 1, 2),
        l AS (SELECT a, b FROM both_ JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        {_REACHED}
        SELECT id AS doc_id, n AS n_shingles, component AS component_id FROM n JOIN c USING (id)
    """,
    "op7_embedding_dedup": f"""
        WITH RECURSIVE n AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
        u AS (
            SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM n
            WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
        ),
        l AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.95),
        {_REACHED},
        k AS (SELECT a AS id, count(*) AS n_links FROM l GROUP BY 1)
        SELECT id AS vec_id, coalesce(n_links, 0) AS n_links, component AS component_id, id = component AS kept FROM c LEFT JOIN k USING (id)
    """,
    "op10_chat_format": f"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        )
        SELECT conv_id,
               count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(24 + length(regexp_replace(role, '{_RISKY}', '\\\\\\1', 'g'))
                   + length(role) - length(replace(role, chr(10), ''))
                   + length(regexp_replace(text, '{_RISKY}', '\\\\\\1', 'g')))::BIGINT AS formatted_chars,
               false AS rewrites_history
        FROM rows GROUP BY conv_id
    """,
    "op6_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
