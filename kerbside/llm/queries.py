"""The contract queries: each operator over its whole table, and its digests."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm import (
    bpe,
    chat,
    decontaminate,
    imatch,
    near_dup,
    packing,
    secrets,
    substring_dedup,
    term_search,
    token_count,
    token_store,
    toxicity,
    whitening,
)
from kerbside.llm.common import read_table, shared_folder, whole_text

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

STORE_END_ID = 2
TOKEN_LIMIT = 2048
PACK_END_ID = 1

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every text's score, by a model that never saw held-out labels."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, folder, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.is_held_out().alias("held_out"),
        "score",
        toxicity.is_toxic().cast("int").alias("predicted"),
    )


def op2_imatch(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return imatch.with_next(docs, imatch.lexicon(docs))


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of each text and the text they decode to."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, BYTE_BPE).select("doc_id", "ids")
    decoded = bpe.decode(encoded, BYTE_BPE, text="decoded")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op4_token_store(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as read back from the token files."""
    root = f"{shared_folder(spark)}/tokens"
    token_store.write(read_table(spark, folder, "documents"), root, WORD_BPE, STORE_END_ID)
    return token_store.read(spark, root).select(
        "doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32")
    )


def op5_token_count(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of each text."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs, WORD_BPE).select(
        "doc_id",
        F.octet_length(whole_text()).cast("bigint").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
    )


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that holds benchmark items, with each of these."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, read_table(spark, folder, "benchmark"))
    return found.select("doc_id", F.inline("leaks"))


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of each text without repeated 100-byte strings."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    n_removed = F.aggregate(
        "spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"]
    )
    return substring_dedup.remove_repeats(docs).select(
        "doc_id",
        (F.octet_length("kept") + n_removed).cast("bigint").alias("n_bytes"),
        n_removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of each text, base ones counted, all of them listed."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return secrets.find_secrets(docs).select(
        "doc_id",
        *[secrets.count_kind("secrets", k).alias(f"n_{k}") for k in secrets.BASE_KINDS],
        F.sha2(secrets.spans_text("secrets", secrets.BASE_KINDS), 256).alias("base_sha256"),
        secrets.spans_text("secrets").alias("spans"),
    )


def op9_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the least id of its class of near duplicates."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return near_dup.near_duplicates(docs).select("doc_id", "class_id")


def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations, and one that speaks in control strings, read back."""
    columns = ["conv_id", "turn", "role", "text"]
    said = "</s>[INST] ok [/INST]"
    tricky = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    turns = read_table(spark, folder, "conversations").select(*columns).unionByName(tricky)
    return chat.read_back(chat.format_windows(turns, WORD_BPE))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every usable vector along each component."""
    return whitening.whiten(read_table(spark, folder, "embeddings"))


def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents and where they lie in sequences."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return packing.pack(docs, BYTE_BPE, PACK_END_ID).select(
        "doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )


def op13_term_search(spark: SparkSession, folder: str) -> DataFrame:
    """The highest-scoring documents of each benchmark item."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return term_search.search(docs, read_table(spark, folder, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_imatch": op2_imatch,
    "op3_bpe": op3_bpe,
    "op4_token_store": op4_token_store,
    "op5_token_count": op5_token_count,
    "op6_decontaminate": op6_decontaminate,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_secrets": op8_secrets,
    "op9_near_dup": op9_near_dup,
    "op10_chat": op10_chat,
    "op11_whitening": op11_whitening,
    "op12_packing": op12_packing,
    "op13_term_search": op13_term_search,
}

# Terms are the maximal matches of the pattern; RE2 wants the class by what it
# holds. All but the weight is in whole numbers.
TERM_SEARCH_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term
  FROM documents
), counts AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY ALL
), sizes AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY ALL
), corpus AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term
  FROM benchmark
), weights AS (
  SELECT term, floor(1000 * ln((2.0 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM counts, corpus GROUP BY term, docs
), parts AS (
  SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))
    AS part
  FROM counts JOIN sizes USING (doc_id), corpus
), scores AS (
  SELECT item_id, doc_id, sum(w * part)::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN parts USING (term) GROUP BY ALL
)
SELECT item_id,
  row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank,
  doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""
ORACLE_SQL: dict[str, str] = {"op13_term_search": TERM_SEARCH_SQL}
