"""From raw documents to token ids, in stages over Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm import bpe, decontaminate, near_dup, secrets, toxicity
from kerbside.llm.common import free_name, read_table, shared_folder, stored

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
ROW_GROUP = 1 << 20  # bytes; rows of whole texts with all their ids are large

# No SQL states compression lengths, sampling or merges; tests/llm compares the
# stages with brute-force versions.
ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the threshold. NULL and empty texts are
    scored as well; other columns may have any names."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    score = free_name(docs, "_score")
    scored = toxicity.score(docs, model, out=score)
    return scored.filter(~toxicity.is_toxic(score)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates."""
    return near_dup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; NULL and empty texts hold none. Other
    columns may have any names."""
    benchmark = read_table(spark, sf_dir, "benchmark")
    leaks = free_name(docs, "_leaks")
    found = decontaminate.find_leaks(docs, benchmark, leaks=leaks)
    return found.filter(F.size(leaks) == 0).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind; ``n_chars`` follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether decoding gives the text back.

    The ids are stored before they are decoded: in one stage, each running task would
    keep a Python worker for either step, and every worker that once ran keeps the
    tables of all stages.
    """
    kept = docs.select("doc_id", "lang", "source", "n_chars", "text")
    encoded = bpe.encode(kept, TOKENIZER, ids="ids")
    encoded = stored(encoded, shared_folder(spark), "encoded", row_group=ROW_GROUP)
    checked = bpe.decode(encoded, TOKENIZER, ids="ids", text="_decoded")
    return checked.select(
        "doc_id", "lang", "source", "n_chars",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
        (F.col("_decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    folder = shared_folder(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), folder, name)
    return docs
