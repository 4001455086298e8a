"""Near duplicates by consistent weighted sampling of TF-IDF word shingles.

A shingle's weight is how often the text has it times the mean inverse document
frequency of its five words. Improved consistent weighted sampling draws a few
(shingle, level) samples per text, equal between two texts with a probability of
their weighted Jaccard similarity. Two samples make a band; texts that share a
band are candidates, and exact weighted Jaccard similarity decides.

Exact copies are one node. Nodes that share a band form a bucket, and buckets of
any size are resolved in three turns. A small bucket is compared pair by pair; in
a larger one every node is compared with one pivot, the node that is in most of
the crowd's buckets. Pairs that are joined by then, through whatever chain, need
no look. Second, the nodes of larger buckets that still hold several classes meet
by the shingles of a prefix: in an order common to all, rarest first, a node's
first shingles up to a fifth of its weight, one of which two texts of similarity
0.8 must share. These buckets are treated as the first were. Last, what shares a
key in a bucket that still holds several classes is compared across its classes,
in salted blocks, where what both texts weigh from that key on allows a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import (
    SIMILARITY,
    WORDS_PER_SHINGLE,
    free_name,
    prepare_workers,
    shared_folder,
    stored,
    whole_text,
)
from kerbside.llm.components import connected_components
from kerbside.llm.hashing import mix
from kerbside.llm.shingles import shingles_of
from kerbside.llm.words import document_frequencies, words_of_texts

# Two samples a band: at similarity 0.8 a pair misses all bands once in 3,500.
BANDS, ROWS_PER_BAND = 8, 2
SAMPLES = BANDS * ROWS_PER_BAND
# Words in fewer than one of so many documents share one greatest weight. So at
# most this many words per distinct word of an average document are tabulated,
# however large the corpus is.
RAREST = 2_000
PAIRWISE = 16  # nodes of a bucket that is compared pair by pair
PAIRS_PER_TASK = 500  # nodes compared with one copy of a pivot
SLICE = 2_048
PLACES = 1 << 18  # of the counts that order keys
MASK = np.uint64(PLACES - 1)


class WordWeights:
    """Inverse document frequency of words, by hash."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, rarest: float):
        self.words, self.weights, self.rarest = words, weights, rarest

    def of(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(words), self.rarest, np.float32)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.weights[at], self.rarest)


def word_weights(docs: DataFrame, text: str = "text") -> WordWeights:
    """log(1 + N / df) of all words over all documents, bounded from above."""
    total = docs.count()
    common = document_frequencies(docs, text).filter(F.col("df") * RAREST > total).toArrow()
    words = np.asarray(common.column("word").combine_chunks()).astype(np.int64).view(np.uint64)
    counts = np.asarray(common.column("df").combine_chunks()).astype(np.float64)
    order = np.argsort(words)
    weights = np.log1p(total / np.maximum(counts[order], 1)).astype(np.float32)
    return WordWeights(words[order], weights, float(np.float32(np.log1p(RAREST))))


def weighted_shingles(words: np.ndarray, idf: WordWeights) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text's words, ascending, with TF-IDF weights."""
    shingles = shingles_of(words)
    if not len(shingles):
        return shingles, np.zeros(0, np.float32)
    size = min(WORDS_PER_SHINGLE, len(words))
    sums = np.concatenate([[0.0], np.cumsum(idf.of(words), dtype=np.float64)])
    means = (sums[size:] - sums[:-size]) / size
    distinct, first, counts = np.unique(shingles, return_index=True, return_counts=True)
    # Rounded, so that a shingle's weight does not depend on what stands before it.
    return distinct, np.round(counts * means[first], 3).astype(np.float32)


def shingles_of_texts(texts: list[str], idf: WordWeights) -> list[tuple[np.ndarray, np.ndarray]]:
    return [weighted_shingles(words, idf) for words in words_of_texts(texts)]


class Variates:
    """Tables of the gamma variates r and c and the uniform b. A shingle's three
    places for a draw are parts of one product with the draw's odd factor."""

    SIZE = 1 << 16

    def __init__(self):
        random = np.random.default_rng(20_240_612)
        self.r = random.gamma(2.0, 1.0, self.SIZE).astype(np.float32)
        self.log_c = np.log(random.gamma(2.0, 1.0, self.SIZE)).astype(np.float32)
        self.b = random.random(self.SIZE, dtype=np.float32)
        self.factors = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(977))
        self.factors |= np.uint64(1)


VARIATES: list[Variates] = []
LOW = np.uint64(0xFFFF)


def samples(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Consistent weighted samples: for each of ``SAMPLES`` draws, a hash of the
    drawn shingle and its level.

    With the variates of each shingle and draw, its level is
    t = floor(ln w / r + b), and the shingle of least ln c - r (t - b + 1) is
    drawn.
    """
    if not VARIATES:
        VARIATES.append(Variates())
    tables = VARIATES[0]
    logs = np.log(weights)
    best = np.full(SAMPLES, np.inf, np.float32)
    drawn = np.zeros(SAMPLES, np.uint64)
    column = np.arange(SAMPLES)
    for at in range(0, len(shingles), SLICE):
        part = shingles[at : at + SLICE]
        bits = part[:, None] * tables.factors
        r = tables.r[(bits >> np.uint64(48)).astype(np.intp)]
        b = tables.b[((bits >> np.uint64(16)) & LOW).astype(np.intp)]
        t = np.floor(logs[at : at + SLICE, None] / r + b)
        cost = tables.log_c[((bits >> np.uint64(32)) & LOW).astype(np.intp)] - r * (t - b + 1)
        least = cost.argmin(axis=0)
        lower = cost[least, column] < best
        best = np.where(lower, cost[least, column], best)
        level = t[least, column].astype(np.int64).view(np.uint64)
        drawn = np.where(lower, mix(part[least] ^ mix(level + np.uint64(7))), drawn)
    return drawn


def bands(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One key per band; the band's number is part of it."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    rows = samples(shingles, weights).reshape(BANDS, ROWS_PER_BAND)
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS_PER_BAND):
        keys = mix(keys ^ rows[:, k])
    return keys.view(np.int64)


def similarity(one, other) -> float:
    """Weighted Jaccard similarity of two sets of weighted shingles."""
    _, left, right = np.intersect1d(one[0], other[0], assume_unique=True, return_indices=True)
    least = float(np.minimum(one[1][left], other[1][right]).sum(dtype=np.float64))
    total = float(one[1].sum(dtype=np.float64) + other[1].sum(dtype=np.float64))
    return least / (total - least) if total > least else 1.0


def pack(shingles: np.ndarray, weights: np.ndarray) -> bytes:
    return shingles.tobytes() + weights.tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    return np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.float32, n, 8 * n)


def with_node(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``node``, which equal texts share; NULL is the empty text."""
    return docs.withColumn("node", F.unhex(F.md5(whole_text(text))))


def signatures(docs: DataFrame, idf: WordWeights, text: str) -> DataFrame:
    """(node, bands) of every distinct text, computed where the rows lie."""
    held = docs.sparkSession.sparkContext.broadcast(idf)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingles_of_texts(batch.column("body").to_pylist(), held.value)
            keys = [bands(*one) for one in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(keys, pa.list_(pa.int64()))],
                names=["node", "bands"],
            )

    rows = with_node(docs, text).select("node", whole_text(text).alias("body"))
    signed = rows.mapInArrow(sign, "node binary, bands array<bigint>")
    return signed.groupBy("node").agg(F.first("bands").alias("bands"))


def shingle_sets(docs: DataFrame, nodes: DataFrame, idf: WordWeights, text: str) -> DataFrame:
    """(node, shingles) of the nodes asked for, packed. A task first keeps one
    row per text, so texts with very many copies do not meet in one."""
    held = docs.sparkSession.sparkContext.broadcast(idf)
    once = with_node(docs, text).groupBy("node").agg(F.first(whole_text(text)).alias("body"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("body").to_pylist()
            sets = [pack(*one) for one in shingles_of_texts(texts, held.value)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"]
            )

    wanted = once.join(nodes, "node", "left_semi")
    return wanted.mapInArrow(gather, "node binary, shingles binary")


def prefix(masses: np.ndarray, share: float) -> int:
    """How many of the masses it takes to exceed a share of them."""
    sums = np.cumsum(masses, dtype=np.float64)
    return int(np.searchsorted(sums, share * (1 + 1e-6) + 1e-6, side="right")) + 1


def popularity(sets: DataFrame) -> np.ndarray:
    """Roughly how many sets hold each shingle, by ``PLACES`` parts of its hash.
    Only the order of keys depends on it, not what is found."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(PLACES, np.int64)
        for batch in batches:
            for data in batch.column("shingles").to_pylist():
                held += np.bincount(unpack(data)[0] & MASK, minlength=PLACES)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["at", "n"])

    counted = sets.select("shingles").mapInArrow(count, "at bigint, n bigint")
    table = counted.groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(PLACES, np.int64)
    out[np.asarray(table.column("at").combine_chunks()).astype(np.int64)] = np.asarray(
        table.column("n").combine_chunks()
    )
    return out


def placed_keys(node, threshold: float, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First shingles of a node in one order for all nodes, rarest first, and the
    weight of the node that stands before each. A link shares at least the
    threshold of the heavier node's weight, and what follows a node's keys is
    lighter than that; so the first shingle that two linked nodes share is a key
    of both."""
    order = np.lexsort((node[0], held[node[0] & MASK]))
    weights = node[1][order].astype(np.float64)
    sums = np.cumsum(weights)
    n = prefix(weights, (1 - threshold) * float(weights.sum()))
    return node[0][order[:n]], (sums - weights)[:n]


def prefix_keys(node, threshold: float, held: np.ndarray) -> np.ndarray:
    return placed_keys(node, threshold, held)[0]


def band_buckets(signed: DataFrame) -> DataFrame:
    """(bucket, node, label, n) of texts that share a band; n is the bucket's size."""
    keys = signed.select(F.explode("bands").alias("bucket"), "node")
    sizes = keys.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    return keys.join(sizes, "bucket").select(
        "bucket", "node", F.xxhash64("node").alias("label"), "n"
    )


def stars_of(sized: DataFrame) -> DataFrame:
    """Distinct (a, b, joined): pivot and node of the buckets too large for pairs."""
    large = sized.filter(F.col("n") > PAIRWISE)
    # The node that most of the crowd is like is in most of the large buckets.
    crowd = large.groupBy("node").agg(F.sum("n").alias("crowd"))
    pivots = (
        large.join(crowd, "node")
        .groupBy("bucket")
        .agg(F.max(F.struct("crowd", "node", "label")).alias("pivot"))
        .select("bucket", F.col("pivot.node").alias("a"), F.col("pivot.label").alias("of"))
    )
    return (
        large.join(pivots, "bucket")
        .filter(F.col("a") != F.col("node"))
        .select("a", F.col("node").alias("b"), (F.col("of") == F.col("label")).alias("joined"))
        .distinct()
    )


def bucket_pairs(sized: DataFrame, stars: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) that are not joined yet: all of a small bucket, pivot
    and node of a larger."""
    small = sized.filter(F.col("n") <= PAIRWISE).groupBy("bucket").agg(
        F.array_sort(F.collect_set(F.struct("node", "label"))).alias("nodes")
    )
    pairs = small.select("nodes", F.posexplode("nodes").alias("i", "a")).select(
        "a", F.explode(F.slice("nodes", F.col("i") + 2, F.lit(PAIRWISE))).alias("b")
    ).filter(F.col("a.label") != F.col("b.label")).select("a.node", F.col("b.node").alias("b"))
    return pairs.toDF("a", "b").unionByName(
        stars.filter("NOT joined").select("a", "b")
    ).distinct()


COMPARED = "a binary, b binary, similarity double"
KEYED = "bucket bigint, node binary, mass double, before double"


def meet(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, near, shingles) of pairs (a, b, near), for tasks that take them one by one.

    The sets of b travel to a's; a's are sent once for every
    ``PAIRS_PER_TASK`` partners, before them and without b.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_PER_TASK).alias("parts"))
    spread = pairs.join(counts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    partners = spread.join(sets.withColumnRenamed("node", "b"), "b").select(
        "a", "part", "b", "near", "shingles"
    )
    own = (
        counts.join(sets.withColumnRenamed("node", "a"), "a")
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        .select("a", "part", F.lit(None).cast("binary").alias("b"),
                F.lit(0.0).alias("near"), "shingles")
    )
    return (
        partners.unionByName(own)
        .repartition("a", "part")
        .sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    )


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Per batch of ``meet``, its (a, b, near, set of a, set of b)."""
    key, pivot = None, None
    for batch in batches:
        out = []
        columns = (batch.column(n).to_pylist() for n in ("a", "b", "near", "shingles"))
        for a, b, near, data in zip(*columns):
            if b is None:
                key, pivot = a, unpack(data)
                continue
            if a != key:
                raise ValueError("a pair came without its first set")
            out.append((a, b, near, pivot, unpack(data)))
        yield out


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact similarity of pairs (a, b)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in met(batches):
            rows = [(a, b, similarity(one, other)) for a, b, _, one, other in found]
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in
                 zip(columns, (pa.binary(), pa.binary(), pa.float64()))],
                names=["a", "b", "similarity"],
            )

    return meet(pairs.withColumn("near", F.lit(0.0)), sets).mapInArrow(measure, COMPARED)


def prefix_buckets(sets: DataFrame, threshold: float) -> DataFrame:
    """(bucket, node, mass, before): a row per key of each node, the node's weight,
    and what of it stands before the key."""
    held = sets.sparkSession.sparkContext.broadcast(popularity(sets))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [unpack(data) for data in batch.column("shingles").to_pylist()]
            placed = [placed_keys(one, threshold, held.value) for one in found]
            keys = [k for k, _ in placed]
            counts = np.array([len(k) for k in keys], np.int64)
            masses = [float(one[1].sum(dtype=np.float64)) for one in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)),
                    batch.column("node").take(pa.array(np.repeat(np.arange(len(keys)), counts))),
                    pa.array(np.repeat(np.array(masses), counts)),
                    pa.array(np.concatenate([np.zeros(0), *(before for _, before in placed)])),
                ],
                names=["bucket", "node", "mass", "before"],
            )

    return sets.select("node", "shingles").mapInArrow(keyed, KEYED)


def of_several_classes(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (bucket, node, ...) of buckets whose nodes are not of one class, with
    the ``label`` of the class and the size ``n`` of the bucket."""
    told = labels.select("node", F.xxhash64("label").alias("told"))
    every = rows.drop("label", "n").join(told, "node", "left").withColumn(
        "label", F.coalesce("told", F.xxhash64("node"))
    ).drop("told")
    mixed = every.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most")
    ).filter("least != most").select("bucket", "n")
    return every.join(mixed, "bucket")


def pairs_across(sized: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b) of a bucket's nodes of different classes that may be
    linked. A bucket is dealt out in parts of some ``PAIRS_PER_TASK`` nodes.

    A link shares at least t / (1 + t) of both nodes' weight together. If the key is
    the first that both have, all of it lies from the key on, in either node. So
    every link passes in the bucket of its first key, and nodes that have in common
    only what is frequent, behind much of their own, pass in none.
    """
    parts = F.ceil(F.col("n") / PAIRS_PER_TASK)
    one = sized.select(
        "bucket", F.pmod(F.xxhash64("node"), parts).alias("part"),
        F.col("node").alias("a"), F.col("label").alias("of_a"), F.col("mass").alias("mass_a"),
        (F.col("mass") - F.col("before")).alias("rest_a"),
    )
    other = sized.select(
        "bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"),
        F.col("node").alias("b"), F.col("label").alias("of_b"), F.col("mass").alias("mass_b"),
        (F.col("mass") - F.col("before")).alias("rest_b"),
    )
    shared = (threshold / (1 + threshold) - 1e-6) * (F.col("mass_a") + F.col("mass_b"))
    return (
        one.join(other, ["bucket", "part"])
        .filter((F.col("of_a") < F.col("of_b")) & (F.least("rest_a", "rest_b") >= shared))
        .select("a", "b").distinct()
    )


def further_labels(labels: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """(node, label) of components, after more links between their nodes."""
    ends = links
    for end in ("a", "b"):
        told = labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
        ends = ends.join(told, end, "left")
    lone = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(
        labels, "node", "left_anti"
    )
    every = labels.unionByName(lone.select("node", F.col("node").alias("label")))
    apart = ends.select(
        F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")
    )
    merged = connected_components(apart, folder).select(
        F.col("node").alias("label"), F.col("label").alias("to")
    )
    joined = every.join(merged, "label", "left").select(
        "node", F.coalesce("to", "label").alias("label")
    )
    return stored(joined, folder, "labels")


def labels_of(
    docs: DataFrame, idf: WordWeights, folder: str, text: str, threshold: float
) -> DataFrame:
    """(node, label) of the nodes with links: candidates of at least the given
    similarity, joined by chains."""
    signed = stored(signatures(docs, idf, text), folder, "signatures")
    buckets = stored(band_buckets(signed), folder, "buckets")
    sets = stored(
        shingle_sets(docs, buckets.select("node").distinct(), idf, text), folder, "sets"
    )
    labels = None
    for turn in ("bands", "keys"):
        here = f"{folder}/{turn}"
        stars = stored(stars_of(buckets), here, "pivots")
        pairs = bucket_pairs(buckets, stars)
        labels = joined_by(pairs, sets, labels, here, threshold)
        open_ = of_several_classes(buckets.filter(F.col("n") > PAIRWISE), labels)
        if turn == "bands":
            nodes = stored(open_.select("node").distinct(), here, "open")
            if nodes.isEmpty():
                return labels
            open_sets = stored(sets.join(nodes, "node", "left_semi"), here, "sets")
            keys = stored(prefix_buckets(open_sets, threshold), here, "keys")
            open_ = of_several_classes(keys, labels)
        buckets = stored(open_, here, "buckets")
    return joined_by(pairs_across(buckets, threshold), sets, labels, f"{folder}/rest", threshold)


def joined_by(
    pairs: DataFrame, sets: DataFrame, labels: DataFrame | None, folder: str, threshold: float
) -> DataFrame:
    """(node, label) after the links among the pairs, if any, are added."""
    measured = stored(compare(stored(pairs, folder, "pairs"), sets), folder, "measured")
    links = measured.filter(F.col("similarity") >= threshold).select("a", "b")
    if labels is None:
        return connected_components(links, f"{folder}/components")
    if links.isEmpty():
        return labels
    return further_labels(labels, links, f"{folder}/components")


def classes_of(docs: DataFrame, folder: str, doc_id: str, text: str, threshold: float) -> DataFrame:
    """(node, least, class_id) of every distinct text: its rows' least id, and
    that of its class."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    prepare_workers(docs.sparkSession)
    idf = word_weights(rows)
    labels = labels_of(rows, idf, folder, "text", threshold)
    ids = with_node(rows, "text").groupBy("node").agg(F.min("doc_id").alias("least"))
    joined = stored(
        ids.join(labels, "node", "left").select(
            "node", "least", F.coalesce("label", "node").alias("label")
        ),
        folder, "classes",
    )
    least = joined.groupBy("label").agg(
        F.min("least").alias("class_id"),
        F.min(F.struct(F.col("least").isNull().alias("n"), "least", "node"))["node"].alias("head"),
    )
    return stored(
        joined.join(least, "label").select(
            "node", "least", "class_id", (F.col("node") == F.col("head")).alias("is_head")
        ),
        folder, "least",
    )


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = SIMILARITY,
) -> DataFrame:
    """(doc_id, class_id) of every row: rows of a class are joined by chains of
    texts of at least the given weighted similarity.

    ``class_id`` is the class's least id. Equal texts are of one class, empty
    and NULL texts among them; a text without words is like its exact copies
    alone. Rows with NULL id take part; a class without any id has NULL.
    Repeated rows are repeated in the result; an empty table gives an empty one;
    other columns are not looked at.
    """
    classes = classes_of(docs, shared_folder(docs.sparkSession), doc_id, text, threshold)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return (
        with_node(rows, "text")
        .select("doc_id", "node")
        .join(classes.select("node", "class_id"), "node")
        .select("doc_id", "class_id")
    )


NO_ID = -(2**63)


def keep_first(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = SIMILARITY,
) -> DataFrame:
    """One row of each class, with all its columns: the row of the least id, or,
    if no row of a class has an id, one of its rows. NULL and empty texts are one
    class; columns may have any names."""
    classes = classes_of(docs, shared_folder(docs.sparkSession), doc_id, text, threshold)
    node, number = free_name(docs, "_node"), free_name(docs, "_id")
    heads = classes.filter("is_head").select(
        F.col("node").alias(node), F.coalesce("least", F.lit(NO_ID)).alias(number)
    )
    keyed = docs.select(
        "*",
        F.unhex(F.md5(whole_text(text))).alias(node),
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias(number),
    )
    # The id is part of the key, so that the copies of one text are dealt out evenly.
    return keyed.join(heads, [node, number]).dropDuplicates([node, number]).select(*docs.columns)
