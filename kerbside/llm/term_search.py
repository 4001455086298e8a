"""Ranked lexical search by pipelined term partitioning.

The terms of the items are dealt to owners by falling weight. Items travel in
bundles: a bundle visits the owners one after another, and at each one is met by
that owner's postings, adds their whole-number contributions to its accumulators
(one for each item and document touched so far) and takes these along. Bundles
and postings meet by ``cogroup`` on the bundle and a shard of documents, so no
owner, however common its terms, is one task.

An accumulator is left behind where the bounds of the terms still to come cannot
lift it to the ``top`` highest of its item in that shard: heavy terms come first,
so few go far. Results stay exact: what is left behind is beaten for certain.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import prepare_workers, shared_folder, stored, whole_text

TOP = 20
OWNERS = 4
# An item bundle's accumulators on a shard take at most 64 MB.
BUNDLE_ITEMS = 512
BUNDLE_ENTRIES = 100_000
SHARD_BITS = 14
FILTER_BITS = 1 << 23  # of the filter that the scan gets, whatever the items
KNOWN_WORDS = 500_000

SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The same for UTF-8 bytes: separators become spaces, letters lower case.
TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)

# What a bundle carries: the terms of its items, and accumulators.
ASKED = [f"ask_{name}" for name in ("item", "term", "owner", "weight", "bound")]
CARRIED = [f"acc_{name}" for name in ("item", "row", "doc", "score")]
STATE = "bundle int, shard bigint" + "".join(f", {n} array<bigint>" for n in ASKED + CARRIED)


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, term, times): rows of one id are one item, repeats count once."""
    lower = F.translate(whole_text(text), UPPER, LOWER)
    words = F.regexp_extract_all(lower, F.lit(f"[^{SEPARATORS}]+"), F.lit(0))
    return (
        items.select(F.col(item_id).cast("bigint").alias("item_id"), text)
        .distinct()
        .select("item_id", F.explode(words).alias("term"))
        .groupBy("item_id", "term")
        .agg(F.count("*").alias("times"))
    )


def term_filter(terms: DataFrame) -> np.ndarray:
    """Bits that are set for every term of the items, and for few others.

    Its size is fixed, and so is what the driver sees of it.
    """
    bit = (F.crc32("term") % FILTER_BITS).alias("bit")
    words = (
        terms.select(bit)
        .groupBy(F.shiftright("bit", 6).alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
        .collect()
    )
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for at, value in words:
        bits[at] = value
    return np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool)


def document_terms(docs: DataFrame, bits: np.ndarray, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of documents with a term; listed are the terms
    that pass the filter, ``n`` counts all."""
    prepare_workers(docs.sparkSession)
    packed = np.packbits(bits, bitorder="little").tobytes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bool] = {}

        def passes(word: bytes) -> bool:
            found = known.get(word)
            if found is None:
                bit = crc32(word) % FILTER_BITS
                found = known[word] = bool(packed[bit >> 3] >> (bit & 7) & 1)
            return found

        for batch in batches:
            ids, sizes, kept, tfs, ends = [], [], [], [], [0]
            if len(known) > KNOWN_WORDS:
                known.clear()
            for key, body in zip(*(batch.column(k).to_pylist() for k in ("id", "body"))):
                words = body.encode().translate(TABLE).split()
                if words:
                    found = [(w, c) for w, c in Counter(words).items() if passes(w)]
                    ids.append(key)
                    sizes.append(len(words))
                    kept.extend(w for w, _ in found)
                    tfs.extend(c for _, c in found)
                    ends.append(len(kept))
            ends = pa.array(ends, pa.int32())
            strings = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(ends, strings),
                 pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return docs.select(
        F.col(doc_id).cast("bigint").alias("id"), whole_text(text).alias("body")
    ).mapInArrow(count, "doc_id bigint, n bigint, terms array<string>, tfs array<bigint>")


def owner_limits(weights: DataFrame, owners: int) -> list[int]:
    """Weights at which an owner ends, so that each has a like share of postings.

    Postings are added up by weight; there are fewer weights than 1000 times the
    logarithm of all documents.
    """
    shares = sorted(map(tuple, weights.groupBy("w").agg(F.sum("df")).collect()), reverse=True)
    total, so_far, limits = sum(n for _, n in shares), 0, []
    for w, n in shares:
        so_far += n
        if len(limits) < owners - 1 and so_far * owners >= total * (len(limits) + 1):
            limits.append(w)
    return limits


def _longs(column) -> np.ndarray:
    """A long column or list of them as an array; NULL is 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_list(column.type):
        column = column.flatten()
    return np.asarray(column.fill_null(0)).astype(np.int64)


class Board:
    """A bundle's accumulators on one shard: a row an item, a column a document."""

    def __init__(self, left: pa.Table, right: pa.Table, owner: int):
        item, term, owners, weight, bound = (_longs(left.column(n)) for n in ASKED)
        self.items, at = np.unique(item, return_inverse=True)
        self.to_come = np.zeros(len(self.items), np.int64)
        later = owners > owner
        np.add.at(self.to_come, at[later], bound[later])

        acc = {n: _longs(left.column(f"acc_{n}")) for n in ("item", "row", "score")}
        docs = [left.column("acc_doc").combine_chunks().flatten(),
                right.column("doc_id").combine_chunks()]
        rows = np.concatenate([acc["row"], _longs(right.column("row"))])
        self.rows, first, place = np.unique(rows, return_index=True, return_inverse=True)
        self.docs = pa.concat_arrays([d.cast(pa.int64()) for d in docs]).take(pa.array(first))
        self.scores = np.zeros((len(self.items), len(self.rows)), np.int64)
        carried = len(acc["row"])
        self.scores[np.searchsorted(self.items, acc["item"]), place[:carried]] = acc["score"]
        mine = owners == owner
        self._add(term[mine], at[mine], weight[mine], _longs(right.column("term")),
                  place[carried:], _longs(right.column("part")))

    def _add(self, terms, items, weights, posted, places, parts) -> None:
        """Each posting's part times the term's weight, for each item with the term."""
        by_term, by_post = np.argsort(terms, kind="stable"), np.argsort(posted, kind="stable")
        terms, posted = terms[by_term], posted[by_post]
        for term in np.intersect1d(terms, posted).tolist():
            e = by_term[slice(*np.searchsorted(terms, [term, term + 1]))]
            p = by_post[slice(*np.searchsorted(posted, [term, term + 1]))]
            self.scores[np.ix_(items[e], places[p])] += np.outer(weights[e], parts[p])

    def _least(self, top: int) -> np.ndarray:
        """The ``top``-th highest score of each item, 0 if there are fewer."""
        if self.scores.shape[1] < top:
            return np.zeros(len(self.items), np.int64)
        return np.partition(self.scores, -top, axis=1)[:, -top]

    def carried(self, top: int) -> dict[str, pa.Array]:
        """Accumulators that may still be among the highest of their item."""
        reach = self.scores + self.to_come[:, None] >= self._least(top)[:, None]
        item, place = np.nonzero((self.scores > 0) & reach)
        found = {"item": pa.array(self.items[item]), "row": pa.array(self.rows[place]),
                 "doc": self.docs.take(pa.array(place)),
                 "score": pa.array(self.scores[item, place])}
        ends = pa.array([0, len(item)], pa.int32())
        return {f"acc_{n}": pa.ListArray.from_arrays(ends, v) for n, v in found.items()}

    def highest(self, top: int) -> pa.Table:
        """The ``top`` of each item, equal scores by ascending document id."""
        high = self.scores >= self._least(top)[:, None]
        item, place = np.nonzero((self.scores > 0) & high)
        docs = self.docs.take(pa.array(place))
        scores = self.scores[item, place]
        order = np.lexsort((_longs(docs), np.asarray(docs.is_null()), -scores, item))
        starts = np.searchsorted(item[order], np.arange(len(self.items)))
        order = order[np.arange(len(order)) - starts[item[order]] < top]
        return pa.table({"item": self.items[item[order]], "doc_id": docs.take(pa.array(order)),
                         "score": scores[order]})


def search(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    owners: int = OWNERS,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The ``top`` highest-scoring documents of each item, all of them searched.

    Returns ``item_id``, ``rank`` (from 1), ``doc_id``, ``score``; equal scores
    rank by ascending document id, NULL ids last. A term counts with its weight
    ``floor(1000 ln((2N+2)/(2df+1)))``, damped by its times in the document and
    by the document's length, all in whole numbers.

    NULL and empty texts have no terms; documents without any are not counted.
    Rows of documents are scored each for itself, repeated ones and those with
    NULL ids too. Rows of items with one id are one item, exact repeats once; a
    NULL item id is an id. Items without a match and empty tables give no rows.
    Other columns are not looked at.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    terms = stored(item_terms(items, item_id, item_text), folder, "terms")
    named = terms.select("item_id").distinct()
    named = stored(named.withColumn("item", F.monotonically_increasing_id()), folder, "items")
    size = terms.agg(F.count("*"), F.countDistinct("term")).first()
    bundles = max(1, -(-named.count() // BUNDLE_ITEMS), -(-size[0] // BUNDLE_ENTRIES))

    found = document_terms(docs, term_filter(terms), doc_id, text)
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), folder, "documents")
    n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs or not size[0]:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")

    # Numbers of the terms, and their parts in each document.
    length = F.expr(f"75L + (25L * n * {n_docs}L) div {n_terms}L")
    posted = found.withColumn("m", length).select(
        "row", "doc_id", "m", F.explode(F.arrays_zip("terms", "tfs")).alias("t")
    ).select(
        "row", "doc_id", F.col("t.terms").alias("word"),
        F.expr("(1000000000L * t.tfs) div (1000L * t.tfs + 12L * m)").alias("part"),
    )
    vocabulary = terms.select("term").distinct()
    vocabulary = stored(
        vocabulary.withColumn("number", F.monotonically_increasing_id()), folder, "vocabulary"
    )
    posted = posted.join(vocabulary, posted["word"] == vocabulary["term"]).select(
        "row", "doc_id", F.col("number").alias("term"), "part"
    )
    posted = stored(posted, folder, "postings")
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weights = posted.groupBy("term").agg(
        F.count("*").alias("df"), F.max("part").alias("most")
    ).withColumn("w", weight)
    weights = stored(weights, folder, "weights")
    owner = F.lit(0)
    for limit in owner_limits(weights, owners):
        owner = owner + (F.col("w") < limit).cast("int")

    # What each bundle asks, and which owner answers.
    numbered = vocabulary.select("term", "number")
    same = named.withColumnRenamed("item_id", "same_id")
    asked = terms.join(same, terms["item_id"].eqNullSafe(same["same_id"]))
    asked = (
        asked.join(numbered, "term")
        .join(weights.withColumnRenamed("term", "number"), "number")
        .select(
            F.pmod(F.xxhash64("item"), F.lit(bundles)).cast("int").alias("bundle"),
            "item",
            F.col("number").alias("term"),
            owner.cast("bigint").alias("owner"),
            (F.col("times") * F.col("w")).alias("weight"),
            (F.col("times") * F.col("w") * F.col("most")).alias("bound"),
        )
    )
    asked = stored(asked, folder, "asked")
    wanted = asked.select("bundle", "term", "owner").distinct()
    met = stored(
        posted.join(wanted, "term").withColumn("shard", F.shiftright("row", SHARD_BITS)),
        folder,
        "met",
    )
    entries = asked.groupBy("bundle").agg(
        F.collect_list(F.struct(*[n[4:] for n in ASKED])).alias("entries")
    )
    none = F.array().cast("array<bigint>")
    # Read anew: cogroup would take the columns of both sides for the same.
    pairs = spark.read.schema(met.schema).parquet(f"{folder}/met").select("bundle", "shard")
    state = pairs.distinct().join(entries, "bundle").select(
        "bundle", "shard", *[F.col(f"entries.{n[4:]}").alias(n) for n in ASKED],
        *[none.alias(n) for n in CARRIED],
    )
    for k in range(owners):
        postings = met.filter(F.col("owner") == k).select(
            "bundle", "shard", "row", "doc_id", "term", "part"
        )
        state = visit(state, postings, k, top, last=k + 1 == owners)
    highest = Window.partitionBy("item").orderBy(
        F.col("score").desc(), F.col("doc_id").asc_nulls_last()
    )
    ranked = state.withColumn("rank", F.row_number().over(highest)).filter(F.col("rank") <= top)
    return ranked.join(named, "item").select("item_id", "rank", "doc_id", "score")


def visit(state: DataFrame, postings: DataFrame, owner: int, top: int, last: bool) -> DataFrame:
    """One owner adds to the bundles that come by; the last one selects."""

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        board = Board(left, right, owner)
        if last:
            return board.highest(top)
        asked = {n: left.column(n).cast(pa.list_(pa.int64())) for n in ASKED}
        same = {n: left.column(n) for n in key}
        return pa.table({**same, **asked, **board.carried(top)})

    key = ["bundle", "shard"]
    schema = "item bigint, doc_id bigint, score bigint" if last else STATE
    return state.groupBy(*key).cogroup(postings.groupBy(*key)).applyInArrow(add, schema)
