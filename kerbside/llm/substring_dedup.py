"""Exact removal of repeated 100-byte strings by bucket-pointer refinement.

Every 100-byte string belongs to an anchor, the least of its q-gram hashes, and
a run of strings that share an anchor is the unit that travels. Equal strings
have equal anchors at equal places, so q-gram buckets hold all that can be equal:

1. Runs of equal content are equal string by string; all but the first of them
   are repeats. Each task settles its own first, and sends one row per content.
2. A bucket with different contents holds runs that may agree in part, at the
   edges of repeated passages. One run of each content is fetched, and buckets
   are refined: strings are ranked by their first eight bytes, then by pairs of
   ranks, the second taken further on in the text, so that 8, 16, 32, 64 and at
   last 100 bytes are ranked, each step reusing the ranks of the one before.
   A string is a repeat if its rank occurs earlier.
3. Repeats go back to their documents, whose covered bytes are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import prepare_workers, runs, shared_folder, stored
from kerbside.llm.hashing import BASE, mix, prefix_sums, run_hashes

LENGTH = 100
GRAM = 20
SPAN = LENGTH - GRAM + 1  # q-grams of a string
PIECE = 600_000  # bytes hashed at once
PLACE = np.uint64((1 << 24) - 1)
SETTLE = 600_000  # runs a task compares among themselves before it sends them
REFINE = 2_000_000  # bytes refined at once
# Strings of buckets with more runs than this, or than this share of all runs to
# refine, are spread.
LARGE_RUNS = 10_000
LARGE_SHARE = 1 / 2_000
LAST_ID = 2**63 - 1

BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64))

def _grams(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all q-grams, from those of half the length."""
    step = lambda h, n: h[:-n] * np.uint64(pow(BASE, n, 1 << 64)) + h[n:]
    four = step(step(codes, 1), 2)
    sixteen = step(step(four, 4), 8)
    return mix(sixteen[:-4] * np.uint64(pow(BASE, 4, 1 << 64)) + four[16:])


def _least(values: np.ndarray) -> np.ndarray:
    """The least of every ``SPAN`` values in a row."""
    width = 1
    while 2 * width <= SPAN:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = SPAN - width
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def runs_in(data: np.ndarray, begins: np.ndarray, lengths: np.ndarray):
    """Runs of strings with one anchor in a row of documents: document, first
    and last start, anchor, its hash, and a hash of all bytes of the run."""
    counts = np.maximum(0, lengths - LENGTH + 1)
    if not counts.sum():
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    codes = BYTE_CODES[data]
    grams = _grams(codes)
    placed = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    anchors = (_least(placed) & PLACE).astype(np.int64)
    starts = runs(begins, counts)
    document = np.repeat(np.arange(len(begins)), counts)
    anchor = anchors[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (document[1:] != document[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    low, high = starts[first], starts[last]
    content = run_hashes(prefix_sums(codes), low, high + LENGTH)
    content = mix(content ^ (high - low).astype(np.uint64))
    return document[first], low, high, anchor[first], grams[anchor[first]], content


def pieces(bodies: list[bytes]) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, np.ndarray]]:
    """Documents in rows of at most about ``PIECE`` bytes; longer ones are cut so
    that each string lies in one part. Yields (document, shift) of each part."""
    parts, chunks, size = [], [], 0
    for k, body in enumerate(bodies):
        for at in range(0, max(1, len(body) - LENGTH + 1), PIECE):
            chunk = body[at : at + PIECE + LENGTH - 1]
            parts.append((k, at))
            chunks.append(chunk)
            size += len(chunk)
            if size >= PIECE:
                yield parts, np.frombuffer(b"".join(chunks), np.uint8), np.array(
                    [len(c) for c in chunks])
                parts, chunks, size = [], [], 0
    if parts:
        yield parts, np.frombuffer(b"".join(chunks), np.uint8), np.array([len(c) for c in chunks])


def all_runs(bodies: list[bytes]):
    """Runs of a list of documents: document, first and last start in it,
    anchor's place in it, anchor hash, content hash."""
    found = []
    for parts, data, lengths in pieces(bodies):
        begins = np.cumsum(lengths) - lengths
        part, low, high, anchor, gram, content = runs_in(data, begins, lengths)
        owners = np.array([p[0] for p in parts])
        shift = np.array([p[1] for p in parts])[part] - begins[part]
        found.append((owners[part], low + shift, high + shift, anchor + shift, gram, content))
    return tuple(np.concatenate(c) for c in zip(*found))


RUNS = "gram bigint, content bigint, doc bigint, row bigint, at bigint, repeat boolean"


def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per content met, its first run in this task; the other runs of
    that content are repeats for certain."""
    waiting, size = [], 0

    def settle() -> pa.RecordBatch:
        gram, content, doc, row, at = (np.concatenate(c) for c in zip(*waiting))
        order = np.lexsort((at, row, doc, content, gram))
        gram, content, doc, row, at = (c[order] for c in (gram, content, doc, row, at))
        same = np.zeros(len(gram), bool)
        same[1:] = (gram[1:] == gram[:-1]) & (content[1:] == content[:-1])
        # The same run of a row that is there twice is no repeat of itself.
        twice = np.zeros(len(gram), bool)
        twice[1:] = (
            same[1:] & (doc[1:] == doc[:-1]) & (row[1:] == row[:-1]) & (at[1:] == at[:-1])
        )
        kept = ~twice
        repeat = same.copy()
        heads = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
        repeat &= (doc != doc[heads]) | (row != row[heads]) | (at != at[heads])
        columns = [gram.view(np.int64), content.view(np.int64), doc, row, at, repeat]
        return pa.RecordBatch.from_arrays(
            [pa.array(c[kept]) for c in columns],
            names=["gram", "content", "doc", "row", "at", "repeat"],
        )

    for batch in batches:
        bodies = [b.encode() for b in batch.column("body").to_pylist()]
        owner, low, _, _, gram, content = all_runs(bodies) if bodies else ([], [], [], [], [], [])
        if len(owner):
            doc = np.asarray(batch.column("doc"))[owner]
            row = np.asarray(batch.column("row"))[owner]
            mark = np.asarray(batch.column("mark")).astype(np.int64)[owner]
            waiting.append((gram, content, doc, row, (mark << 32) | low))
            size += len(owner)
        if size >= SETTLE:
            yield settle()
            waiting, size = [], 0
    if waiting:
        yield settle()


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, row, mark, body). Ids with NULL last: ``row`` is below zero where
    there is an id. The other 63 bits of it and the 31 of ``mark`` are hashes of
    the text, which tell rows of one id apart."""
    body = F.coalesce(F.col(text), F.lit(""))
    number = F.col(doc_id).cast("bigint")
    top = F.lit(-LAST_ID - 1)
    told = F.xxhash64(body)
    return docs.select(
        F.coalesce(number, F.lit(LAST_ID)).alias("doc"),
        F.when(number.isNull(), told.bitwiseAND(F.lit(LAST_ID)))
        .otherwise(told.bitwiseOR(top)).alias("row"),
        F.pmod(F.xxhash64(F.lit(1), body), F.lit(1 << 31)).cast("int").alias("mark"),
        body.alias("body"),
    )


KEY = ["doc", "row", "mark"]


def packed(docs: DataFrame) -> DataFrame:
    """The same with bodies compressed, for texts that have to be shuffled."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data = [packer.compress(b.encode()) for b in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in KEY), pa.array(data, pa.binary())],
                names=[*KEY, "data"],
            )

    return docs.mapInArrow(pack, "doc bigint, row bigint, mark int, data binary")


def per_document(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows gathered by document: never more than a document has runs."""
    return rows.groupBy(
        "doc", "row", F.shiftright("at", 32).cast("int").alias("mark")
    ).agg(F.collect_list(F.struct(F.col("at").bitwiseAND((1 << 32) - 1).alias("low"), *columns))
          .alias("found"))


def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs asked for."""
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        bodies = [unpacker.decompress(d) for d in batch.column("data").to_pylist()]
        owner, low, high, anchor, _, _ = all_runs(bodies) if bodies else ([], [], [], [], [], [])
        ends = np.searchsorted(owner, np.arange(len(bodies) + 1))
        asked = batch.column("found").to_pylist()
        docs, rows, marks = (batch.column(n).to_pylist() for n in KEY)
        for k, body in enumerate(bodies):
            own = slice(ends[k], ends[k + 1])
            place = dict(zip(low[own].tolist(), zip(high[own].tolist(), anchor[own].tolist())))
            for one in asked[k]:
                start = one["low"]
                last, at = place[start]
                out.append((one["gram"], one["n"], docs[k], rows[k], (marks[k] << 32) | start,
                            at - start, body[start : last + LENGTH]))
        columns = list(zip(*out)) or [[] for _ in CONTEXT_ARROW]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, CONTEXT_ARROW)], schema=CONTEXT_ARROW
        )


CONTEXT = (
    "gram bigint, n bigint, doc bigint, row bigint, at bigint, anchor int, body binary"
)
CONTEXT_ARROW = pa.schema([
    ("gram", pa.int64()), ("n", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()),
    ("at", pa.int64()), ("anchor", pa.int32()), ("body", pa.binary()),
])


def rank_strings(data: np.ndarray) -> np.ndarray:
    """Equal numbers for equal 100-byte strings, at every start in ``data``.

    Buckets of eight bytes are refined by the bucket identifiers of later
    offsets: ranks of n bytes here and n bytes further on rank 2n bytes, and two
    overlapping ranks of 64 bytes rank all hundred.
    """
    wide = np.lib.stride_tricks.sliding_window_view(data, 8)
    ranks = np.unique(np.ascontiguousarray(wide).view(np.uint64).ravel(), return_inverse=True)[1]
    length = 8
    while 2 * length <= LENGTH:
        ranks = _refine(ranks, length)
        length *= 2
    return _refine(ranks, LENGTH - length)


def _refine(ranks: np.ndarray, offset: int) -> np.ndarray:
    """Ranks of pairs (rank here, rank ``offset`` further on)."""
    return np.unique((ranks[:-offset] << 32) | ranks[offset:], return_inverse=True)[1]


SPANS = "doc bigint, row bigint, at bigint, first int, stop int"
SPANS_ARROW = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("at", pa.int64()),
                         ("first", pa.int32()), ("stop", pa.int32())])


def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered parts of runs, from whole buckets in order of (gram, doc, row, at)."""
    waiting: list[tuple] = []
    size = 0
    for batch in batches:
        columns = (batch.column(n).to_pylist() for n in ("gram", "doc", "row", "at", "body"))
        for run in zip(*columns):
            if waiting and run[:4] == waiting[-1][:4]:
                continue  # the same run of a row that is there twice
            if size >= REFINE and run[0] != waiting[-1][0]:
                yield _repeats(waiting)
                waiting, size = [], 0
            waiting.append(run)
            size += len(run[4])
    if waiting:
        yield _repeats(waiting)


def _repeats(rows: list[tuple]) -> pa.RecordBatch:
    data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
    lengths = np.array([len(r[4]) for r in rows])
    begins = np.cumsum(lengths) - lengths
    counts = lengths - LENGTH + 1
    ranks = rank_strings(data)[runs(begins, counts)]
    owner = np.repeat(np.arange(len(rows)), counts)
    # Earliest first: rows are ordered by document and place within a bucket, and
    # equal strings lie in one bucket.
    _, first = np.unique(ranks, return_index=True)
    repeat = np.ones(len(ranks), bool)
    repeat[first] = False
    inner = np.arange(len(ranks)) - np.repeat(np.cumsum(counts) - counts, counts)
    hit = np.flatnonzero(repeat)
    owners, low = np.unique(owner[hit], return_index=True)
    last = np.append(low[1:], len(hit)) - 1
    # All strings of a run hold its anchor, so that what they cover is one piece.
    return pa.RecordBatch.from_arrays([
        pa.array([rows[i][1] for i in owners.tolist()], pa.int64()),
        pa.array([rows[i][2] for i in owners.tolist()], pa.int64()),
        pa.array([rows[i][3] for i in owners.tolist()], pa.int64()),
        pa.array(inner[hit][low].astype(np.int32)),
        pa.array((inner[hit][last] + LENGTH).astype(np.int32)),
    ], schema=SPANS_ARROW)


def spread_strings(contexts: DataFrame) -> DataFrame:
    """Covered parts of the runs of very large buckets: their strings are dealt
    out by content, so that no task gets the bucket."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = (batch.column(n).to_pylist() for n in ("doc", "row", "at", "body"))
            for doc, row, at, body in zip(*columns):
                for k in range(len(body) - LENGTH + 1):
                    out.append((xxhash.xxh3_128_digest(body[k : k + LENGTH]), doc, row, at, k))
            columns = list(zip(*out)) or [[] for _ in range(5)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in
                 zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))],
                names=["string", "doc", "row", "at", "k"],
            )

    rows = contexts.select("doc", "row", "at", "body").mapInArrow(
        strings, "string binary, doc bigint, row bigint, at bigint, k int"
    )
    firsts = rows.groupBy("string").agg(F.min(F.struct("doc", "row", "at", "k")).alias("head"))
    # No run has more strings than its anchor has places in one.
    fresh = firsts.select("head.*").groupBy("doc", "row", "at").agg(
        F.collect_list("k").alias("fresh")
    )
    every = F.sequence(F.lit(0), F.octet_length("body") - F.lit(LENGTH))
    again = F.array_except("every", F.coalesce("fresh", F.array().cast("array<int>")))
    return (
        contexts.select("doc", "row", "at", every.alias("every"))
        .join(fresh, ["doc", "row", "at"], "left")
        .withColumn("again", again)
        .filter(F.size("again") > 0)
        .select("doc", "row", "at", F.array_min("again").alias("first"),
                (F.array_max("again") + LENGTH).cast("int").alias("stop"))
    )


RESULT = "doc bigint, row bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary"
RESULT_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents without the bytes that repeats cover."""
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        bodies = [unpacker.decompress(d) for d in batch.column("data").to_pylist()]
        found = batch.column("found").to_pylist()
        touched = [k for k, f in enumerate(found) if f]
        owner, low, high, *_ = (
            all_runs([bodies[k] for k in touched]) if touched else ([], [], [])
        )
        ends = np.searchsorted(owner, np.arange(len(touched) + 1))
        spans: list[list[dict]] = [[] for _ in bodies]
        kept = list(bodies)
        for n, k in enumerate(touched):
            own = slice(ends[n], ends[n + 1])
            last = dict(zip(low[own].tolist(), high[own].tolist()))
            steps = np.zeros(len(bodies[k]) + 1, np.int32)
            for one in found[k]:
                start = one["low"]
                if one["first"] is None:
                    a, b = start, last[start] + LENGTH
                else:
                    a, b = start + one["first"], start + one["stop"]
                steps[a] += 1
                steps[b] -= 1
            gone = np.cumsum(steps[:-1]) > 0
            edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
            spans[k] = [{"start": a, "stop": b} for a, b in edges.reshape(-1, 2).tolist()]
            kept[k] = np.frombuffer(bodies[k], np.uint8)[~gone].tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("row"), pa.array(spans, RESULT_SPANS),
             pa.array(kept, pa.binary())],
            names=["doc", "row", "spans", "kept"],
        )


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans, kept) of every row: the byte spans removed, in order, and
    the bytes left, which may begin or end inside a character.

    A byte goes if a string of ``LENGTH`` bytes that covers it also starts
    earlier: in a document of smaller id, or earlier in the same one. NULL and
    empty texts have nothing to remove, nor have shorter ones. NULL ids come
    last; rows of one id with different texts are documents in the order of the
    texts' hash; rows equal in id and text are one document, and each gets its
    result. An empty table gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    folder = shared_folder(spark)
    rows = keyed(docs, doc_id, text)
    found = rows.mapInArrow(find_runs, RUNS)
    # Per bucket at most one row of each content and task; what a task has settled
    # is past judging, and is dealt out by place.
    dealt = F.when(F.col("repeat"), F.xxhash64("doc", "row", "at")).otherwise(F.col("gram"))
    sent = found.withColumn("deal", dealt).repartition("repeat", "deal")
    in_bucket = Window.partitionBy("repeat", "deal")
    of_content = Window.partitionBy("repeat", "deal", "content")
    here = F.struct("doc", "row", "at")
    judged = stored(
        sent.withColumn("head", F.min(here).over(of_content))
        .withColumn("least", F.min("content").over(in_bucket))
        .withColumn("most", F.max("content").over(in_bucket))
        .withColumn("n", F.count("*").over(in_bucket))
        .withColumn("again", F.col("repeat") | (here != F.col("head")))
        .filter(F.col("again") | (F.col("least") != F.col("most")))
        .select("gram", "doc", "row", "at", "again", "n"),
        folder, "runs",
    )
    whole = judged.filter("again").select(
        "doc", "row", "at",
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("stop")
    )
    asked = per_document(judged.filter("NOT again"), "gram", "n")
    contexts = stored(
        packed(rows).join(asked, KEY).mapInArrow(fetch, CONTEXT), folder, "contexts"
    )
    share = LARGE_SHARE * judged.filter("NOT again").count()
    large = F.col("n") > min(LARGE_RUNS, share)
    small = (
        contexts.filter(~large)
        .repartition("gram")
        .sortWithinPartitions("gram", "doc", "row", "at")
        .select("gram", "doc", "row", "at", "body")
        .mapInArrow(refine, SPANS)
    )
    parts = small.unionByName(spread_strings(contexts.filter(large)))
    covered = per_document(whole.unionByName(parts), "first", "stop")
    result = packed(rows).join(covered, KEY, "left").mapInArrow(cut, RESULT)
    return result.select(
        F.when(F.col("row") < 0, F.col("doc")).alias("doc_id"), "spans", "kept"
    )
