"""Document fingerprints by I-Match over randomised lexicons.

The lexicon is every word whose inverse document frequency lies in a band. A
text's terms are its distinct lexicon words, sorted. They are hashed once as a
whole and once for each of several random subsets of the lexicon. Subsets come
in levels, each a quarter of the level before, so that texts of any length have
a level at which about one of their terms is in a subset; there, the share of
equal hashes tells the share of terms two texts have in common.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from kerbside.llm.common import prepare_workers, whole_text
from kerbside.llm.hashing import mix
from kerbside.llm.words import document_frequencies, words_of_texts

# The band, as shares of all documents. There are at most 2,000 words per
# distinct word of an average document with at least the lower share, whatever
# the size of the corpus: the lexicon can be sent to every task.
LEAST_SHARE, MOST_SHARE = 1 / 2_000, 1 / 5
LEVELS, REPEATS = 6, 16
SEED = 20_240_611


def lexicon(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Sorted hashes of the words inside the band, counted over all documents."""
    total = docs.count()
    in_band = (F.col("df") >= max(2.0, LEAST_SHARE * total)) & (F.col("df") <= MOST_SHARE * total)
    found = document_frequencies(docs, text).filter(in_band).select("word").toArrow()
    return np.sort(np.asarray(found.column(0).combine_chunks()).astype(np.int64).view(np.uint64))


SEEDS = mix(np.arange(1, REPEATS + 1, dtype=np.uint64) * np.uint64(SEED))


def fingerprint(text: str, hashes: np.ndarray, words: np.ndarray) -> str:
    """Number of terms, hash of all terms, and 16 bits for each random subset, of
    a text with these word hashes.

    A text without any term gets the hash of the text itself.
    """
    terms = np.unique(hashes)
    if len(words):
        at = np.minimum(np.searchsorted(words, terms), len(words) - 1)
        terms = terms[words[at] == terms]
    else:
        terms = terms[:0]
    if not len(terms):
        return f"0:{xxhash.xxh3_64_hexdigest(text)}:"
    whole = xxhash.xxh3_64_hexdigest(terms.tobytes())
    drawn = mix(terms[:, None] ^ SEEDS)
    zeros = drawn & (~drawn + np.uint64(1))  # lowest set bit
    marks = mix(drawn + np.uint64(1))
    parts = []
    for level in range(1, LEVELS + 1):
        kept = zeros >= np.uint64(1 << (2 * level))
        sums = np.where(kept, marks, np.uint64(0)).sum(axis=0, dtype=np.uint64)
        # No term in a subset reads 0000, and nothing else does.
        parts.append(np.where(kept.any(axis=0), 1 + sums % np.uint64(0xFFFF), 0))
    body = np.concatenate(parts).astype(">u2").tobytes().hex()
    return f"{len(terms)}:{whole}:{body}"


def fingerprints_of(texts: list[str], words: np.ndarray) -> list[str]:
    return [fingerprint(t, h, words) for t, h in zip(texts, words_of_texts(texts))]


def likeness(one: str, other: str) -> float:
    """Share of common terms that two fingerprints suggest, 0 to 1.

    Read at the two levels where the longer text has about one term in a subset:
    of the subsets not empty in both, the share that agrees, corrected for
    subsets of several terms. Equal fingerprints are 1; without terms nothing else is
    above 0.
    """
    if one == other:
        return 1.0
    n, whole, a = one.split(":")
    m, other_whole, b = other.split(":")
    if n == "0" or m == "0":
        return 0.0
    if whole == other_whole:
        return 1.0
    larger = max(int(n), int(m))
    near = math.log(larger, 4)
    estimates = []
    for level in {min(LEVELS, max(1, k)) for k in (math.floor(near), math.ceil(near))}:
        size = 4 * REPEATS
        left = np.frombuffer(bytes.fromhex(a[(level - 1) * size : level * size]), ">u2")
        right = np.frombuffer(bytes.fromhex(b[(level - 1) * size : level * size]), ">u2")
        used = np.count_nonzero((left > 0) | (right > 0))
        if not used:
            continue
        agree = np.count_nonzero((left > 0) & (left == right)) / used
        mean = larger / 4**level
        empty = math.exp(-mean)
        estimates.append(1 + math.log(agree * (1 - empty) + empty) / mean)
    return min(1.0, max(0.0, sum(estimates) / len(estimates))) if estimates else 0.0


def edited(text: str, following: str) -> str:
    """The last third replaced by as much of the beginning of the text after it."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


LEAST_ID = -(2**63)


def in_buckets(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (id, body, bucket, ahead) in descending order of id: bucket after
    bucket, and each bucket ended by the first row of the next (``ahead``).

    Buckets are cut at approximate quantiles of the ids; where one id spans
    several of them, its rows are split by their text's hash, which also orders
    them. Only one row per bucket is seen by the driver.
    """
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("id"),
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(LEAST_ID)).alias("key"),
        whole_text(text).alias("body"),
    ).withColumn("mark", F.xxhash64("body"))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    quantiles = docs.agg(
        F.percentile_approx(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(LEAST_ID)), shares)
    ).first()[0]
    bounds = np.sort(np.array(quantiles or [], np.int64))

    @arrow_udf("int")
    def bucket_of(keys: pa.Array, marks: pa.Array) -> pa.Array:
        keys = np.asarray(keys)
        above = len(bounds) - np.searchsorted(bounds, keys, side="right")
        equal = len(bounds) - np.searchsorted(bounds, keys, side="left") - above
        share = (np.asarray(marks).astype(np.float64) + 2.0**63) / 2.0**64
        inner = np.minimum((share * (equal + 1)).astype(np.int64), equal)
        return pa.array(above + inner, pa.int32())

    rows = rows.withColumn("bucket", bucket_of("key", "mark"))
    first = F.struct(F.bitwise_not("key").alias("rest"), F.col("mark"))
    heads = sorted(
        (r.bucket, -r.head.rest - 1, r.head.mark)
        for r in rows.groupBy("bucket").agg(F.min(first).alias("head")).collect()
    )
    before = [
        (key, mark, heads[i - 1][0]) for i, (_, key, mark) in enumerate(heads)
    ]  # the first row of all follows the last
    ends = spark.createDataFrame(before, "key bigint, mark bigint, behind int")
    # One row per bucket, a number that does not grow with the documents.
    marked = rows.join(F.broadcast(ends), ["key", "mark"], "left")
    own = F.struct(F.col("bucket"), F.lit(False).alias("ahead"))
    copy = F.struct(F.col("behind").alias("bucket"), F.lit(True).alias("ahead"))
    places = F.when(F.col("behind").isNull(), F.array(own)).otherwise(F.array(own, copy))
    return (
        marked.withColumn("place", F.explode(places))
        .select("id", "key", "mark", "body", "place.*")
        .repartition(parts // 2, "bucket")
        .sortWithinPartitions("bucket", "ahead", F.col("key").desc(), "mark")
        .select("id", "body", "bucket", "ahead")
    )


FINGERPRINTS = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)
FINGERPRINTS_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def with_next(docs: DataFrame, words: np.ndarray, doc_id: str = "doc_id", text: str = "text"):
    """Fingerprints of each text, of the text edited with its neighbour's
    beginning, and how alike they are.

    The neighbour is the next row in descending order of id; NULL ids come last,
    rows of one id are ordered by the hash of their text, and after the last row
    comes the first. NULL texts are empty. Equal texts get equal fingerprints,
    a single row is its own neighbour, an empty table gives an empty result;
    other columns are not looked at.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    held = spark.sparkContext.broadcast(words)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None
        for batch in batches:
            couples = []
            columns = (batch.column(n).to_pylist() for n in ("id", "body", "bucket", "ahead"))
            rows = list(zip(*columns))
            prints = fingerprints_of([r[1] for r in rows], held.value)
            for (key, body, _, ahead), own in zip(rows, prints):
                if waiting is None and ahead:
                    continue  # more rows equal to the first of the next bucket
                if waiting is not None:
                    couples.append((*waiting, body, own))
                waiting = None if ahead else (key, body, own)
            changed = [edited(said, body) for _, said, _, body, _ in couples]
            changed_prints = fingerprints_of(changed, held.value)
            out = [
                (key, len(said), hashlib.sha256(new.encode()).hexdigest(), own, new_print,
                 likeness(own, new_print), likeness(own, following))
                for (key, said, own, _, following), new, new_print
                in zip(couples, changed, changed_prints)
            ]
            columns = list(zip(*out)) or [[] for _ in FINGERPRINTS_ARROW]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, FINGERPRINTS_ARROW)],
                schema=FINGERPRINTS_ARROW,
            )

    return in_buckets(docs, doc_id, text).mapInArrow(pairs, FINGERPRINTS)


def fingerprints(
    docs: DataFrame, words: np.ndarray, text: str = "text", out: str = "fingerprint"
) -> DataFrame:
    """Adds the fingerprint of each whole text; other columns stay."""
    prepare_workers(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(words)

    @arrow_udf("string")
    def printed(texts: pa.Array) -> pa.Array:
        return pa.array(fingerprints_of(texts.to_pylist(), held.value), pa.string())

    return docs.withColumn(out, printed(whole_text(text)))
