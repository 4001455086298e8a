"""Harmonic packing of tokenized documents into sequences of one length.

Lengths are parted into classes by reciprocals of the capacity: class k holds
the lengths over capacity/(k+1) and up to capacity/k, and a bin of class k takes
exactly k pieces of it. A bin therefore never needs to be searched for, and every
task fills bins of its own: packing is one pass without a shuffle.

A piece much shorter than its class allows would leave a gap k times in a bin, so
a document is cut where that happens: the largest reciprocal share is taken off,
and what is left goes to a higher class. What remains in the open bins of a task,
under one bin a class, is laid end to end into full sequences, and the last of
these into sequences whose lengths are powers of two.
"""

from __future__ import annotations

import json
import os
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.bpe import byte_symbols
from kerbside.llm.common import prepare_workers, whole_text

CAPACITY = 2048
LEAST_PIECE = 32  # tokens left, at least, when a document is cut
GAP = 32  # a piece may fall short of its class by one in so many tokens
BATCH_BYTES = 4 << 20
TEXTS_AT_ONCE = 50

# Fixed value: the pattern by which byte-level BPE cuts text into pieces.
PIECES = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
)

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, tokens binary"
)
ARROW = pa.schema([
    *[(name, pa.int64()) for name in
      ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")],
    ("tokens", pa.binary()),
])


class LibraryTokens:
    """Ids of texts as the tokenizers library gives them.

    Plain byte-level vocabularies whose ids are in the order of their merges, the
    usual public form, are run by tiktoken: the same merges and so the same ids
    in a fraction of the time. Files of any other form go to the library itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if self._is_plain(spec):
            bytes_of = {s: bytes([b]) for b, s in enumerate(byte_symbols())}
            vocab = spec["model"]["vocab"]
            ranks = {
                b"".join(map(bytes_of.__getitem__, token)): i
                for token, i in vocab.items()
                if token not in self.special
            }
            self.merges = tiktoken.Encoding(
                path, pat_str=PIECES, mergeable_ranks=ranks, special_tokens=self.special
            )
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.merges = None
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def _is_plain(self, spec: dict) -> bool:
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        by_words = pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
        odd = [
            pre.get("add_prefix_space"), spec["normalizer"], model["type"] != "BPE",
            model.get("dropout"), model.get("ignore_merges"), model.get("end_of_word_suffix"),
            model.get("continuing_subword_prefix"),
            *(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")),
        ]
        if not by_words or any(odd):
            return False
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merged = [vocab[a + b] for a, b in pairs]
        letters = byte_symbols()
        return (
            all(s in vocab for s in letters)
            and len(vocab) == len(merged) + len(letters) + sum(s in vocab for s in self.special)
            and all(a < b for a, b in zip(merged, merged[1:]))
            and max(vocab[s] for s in letters) < merged[0]
        )

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.merges is not None:
            return [self.merges.encode_to_numpy(t, allowed_special="all") for t in texts]
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> LibraryTokens:
    """One per Python worker and file; workers serve many tasks."""
    return LibraryTokens(path)


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """The lengths a document of ``n`` tokens is cut into."""
    full, rest = divmod(n, capacity)
    lengths = [capacity] * full
    while rest:
        share = capacity // (capacity // rest)
        if rest <= 2 * LEAST_PIECE or (share - rest) * GAP <= share:
            lengths.append(rest)
            break
        piece = capacity // (capacity // (rest - LEAST_PIECE + 1) + 1)
        lengths.append(piece)
        rest -= piece
    return lengths


class Packer:
    """Fills the bins of one task and hands out complete sequences as rows."""

    def __init__(self, first_id: int, capacity: int = CAPACITY):
        self.next_id, self.capacity = first_id, capacity
        self.open: dict[int, list[tuple]] = defaultdict(list)
        self.rows: list[tuple] = []
        self.held = 0

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, total, ids in pieces:
            self.rows.append(
                (doc_id, start, len(ids), total, self.next_id, offset, ids.tobytes())
            )
            offset += len(ids)
        self.held += 4 * offset + 64 * len(pieces)
        self.next_id += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        start = 0
        for length in cut_lengths(len(ids), self.capacity):
            per_bin = self.capacity // length
            pieces = self.open[per_bin]
            pieces.append((doc_id, start, len(ids), ids[start : start + length].copy()))
            start += length
            if len(pieces) == per_bin:
                self._close(self.open.pop(per_bin))

    def finish(self) -> None:
        """What is left in open bins, end to end: full sequences, then powers of two."""
        left = [piece for k in sorted(self.open) for piece in self.open[k]]
        self.open.clear()
        remaining = sum(len(ids) for *_, ids in left)
        room, pieces = self._room(remaining), []
        for doc_id, start, total, ids in left:
            while len(ids):
                taken = ids[:room]
                pieces.append((doc_id, start, total, taken))
                start, ids = start + len(taken), ids[len(taken) :]
                room -= len(taken)
                remaining -= len(taken)
                if room == 0:
                    self._close(pieces)
                    room, pieces = self._room(remaining), []

    def _room(self, remaining: int) -> int:
        if remaining >= self.capacity:
            return self.capacity
        return 1 << (remaining.bit_length() - 1) if remaining else 0

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(ARROW)
        self.rows, self.held = [], 0
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW
        )


def pack(
    docs: DataFrame,
    path: str,
    end_id: int,
    capacity: int = CAPACITY,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of all documents and their places in sequences.

    A document is the library's ids of its whole text, without special tokens
    added, and ``end_id``. A row is one piece: ``doc_id``, ``start`` (ids of the
    document before it), ``length``, ``doc_tokens`` (of the whole document),
    ``sequence_id``, ``offset`` in the sequence, and ``tokens``, its ids as
    little-endian 32-bit integers. Offsets of a sequence are gapless from 0. A
    sequence is of ``capacity`` ids, or of a power of two, or to be padded.

    NULL and empty texts are the end id alone, NULL ids stay NULL, each of
    several equal rows is packed, an empty table gives no rows, other columns are
    not looked at. Memory holds one batch and one open bin a class, whatever a
    task reads; a very long document leaves in full sequences at once. Sequence
    ids name the task, so a task done again yields the same ids or replaces its
    own. Sequences are never shared between tasks.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    wanted = docs.select(F.col(doc_id).cast("bigint").alias("id"), whole_text(text).alias("body"))

    def pack_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = tokenizer(path)
        packer = Packer(TaskContext.get().partitionId() << 33, capacity)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            keys, texts = batch.column("id").to_pylist(), batch.column("body").to_pylist()
            for at in range(0, len(texts), TEXTS_AT_ONCE):
                some = slice(at, at + TEXTS_AT_ONCE)
                for key, ids in zip(keys[some], library.encode(texts[some])):
                    packer.add(key, np.concatenate([ids, end]).astype("<u4"))
                    if packer.held > BATCH_BYTES:
                        yield packer.batch()
        packer.finish()
        yield packer.batch()

    return wanted.mapInArrow(pack_task, SCHEMA)


def sequences(pieces: DataFrame, pad_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Sequences as training reads them: ``sequence_id``, ``ids``, ``n_pad``.

    Pieces are put together by offset, ``capacity`` of them at most, and padded
    to the capacity unless the length is a power of two.
    """
    spark = pieces.sparkSession
    prepare_workers(spark)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pads = [], []
            for parts in batch.column("parts").to_pylist():
                ids = np.frombuffer(b"".join(p["tokens"] for p in parts), "<u4")
                n = 0 if len(ids) & (len(ids) - 1) == 0 else capacity - len(ids)
                rows.append(np.append(ids, np.full(n, pad_id, "<u4")).astype(np.int64))
                pads.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("sequence_id"), pa.array(rows, pa.list_(pa.int64())),
                 pa.array(pads, pa.int64())],
                names=["sequence_id", "ids", "n_pad"],
            )

    parts = F.sort_array(F.collect_list(F.struct("offset", "tokens"))).alias("parts")
    return pieces.groupBy("sequence_id").agg(parts).mapInArrow(
        join, "sequence_id bigint, ids array<bigint>, n_pad bigint"
    )
