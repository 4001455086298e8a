"""Token ids in files of independent zstandard frames with a seek table.

A file holds one frame per document (more, of ``FRAME_TOKENS`` ids each, for a
very long one), then a frame with the documents' ids and token counts, then a
skippable frame with the seek table: compressed size, plain size and checksum
(low half of XXH64 of the plain bytes) of every frame. That is the public
seekable form of zstandard: any zstandard reader can read the file from the
front, and one that knows the table reads only the frames it wants.

Ids are little-endian, 16 bits wide where the vocabulary allows it, else 32.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm.bpe import byte_symbols
from kerbside.llm.common import PieceMemo, prepare_workers, whole_text

FRAME_TOKENS = 1 << 20
MEMO_WORDS = 700_000
# Fixed values of the public seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80
ENTRY = struct.Struct("<III")
FOOTER = struct.Struct("<IBI")

# Control characters that str.split takes for white space and the tokenizer does not.
ODD_SEPARATORS = regex.compile("[\x1c-\x1f]")
WHITE_SPACE = regex.compile(r"\p{White_Space}+")
# Letters below U+0250 and ASCII signs after them: two pieces, whose normal form
# is the lower case (that of the dotted capital I has a mark, and is left out).
LATIN = regex.compile(
    r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-/:-@\[-`{-~]*)"
)


class WordTokenizer:
    """A tokenizer of the library whose pieces never span white space.

    What the library makes of a text is then the sequence of what it makes of
    the text's words, so each distinct word is given to it once and remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.separator = self.special[0]
        self.separator_id = self.library.token_to_id(self.separator)
        vocab = self.library.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.wide = max(vocab.values()) >= 1 << 16
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.lowers = steps == ["NFC", "Replace", "Lowercase"]
        self.symbols = dict(enumerate(byte_symbols()))
        self.tokenize = self.library.model.tokenize
        self.memo = PieceMemo(self._encode_words, MEMO_WORDS)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        batch = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [e.ids for e in batch]

    def _piece(self, text: str) -> list[int]:
        """Ids of a normalized piece, straight from the library's model."""
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.symbols)
        return [token.id for token in self.tokenize(text)]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Latin words are given to the model as they are. Other words of letters
        alone are one piece each and end where an id ends a word; the rest are set
        apart by a special token."""
        latin, plain, other, alone = [], [], [], []
        pieces, sizes = [], []
        for i, word in enumerate(words):
            parts = self.lowers and LATIN.fullmatch(word)
            if parts:
                before = len(pieces)
                pieces += self._piece(parts[1].lower())
                if parts[2]:
                    pieces += self._piece(parts[2])
                latin.append(i)
                sizes.append(len(pieces) - before)
            elif word.isalpha() and (word.isascii() or self._stays_letters(word)):
                plain.append(i)
            elif any(s in word for s in self.special):
                alone.append(i)
            else:
                other.append(i)
        found: list[tuple[list[int], np.ndarray, np.ndarray]] = [
            (latin, np.array(pieces, np.int64), np.array(sizes, np.int64))
        ]
        for places, glue in ((plain, " "), (other, self.separator)):
            for at in range(0, len(places), 20_000):
                some = places[at : at + 20_000]
                groups = [some[k : k + 250] for k in range(0, len(some), 250)]
                joined = [glue.join(words[i] for i in g) + glue for g in groups]
                ids = np.array([x for run in self._encode(joined) for x in run], np.int64)
                last = self.ends_word[ids] if glue == " " else ids == self.separator_id
                ends = np.flatnonzero(last) + 1
                counts = np.diff(ends, prepend=0)
                if glue != " ":
                    ids, counts = ids[~last], counts - 1
                found.append((some, ids, counts))
        for i in alone:
            ids = np.array(self._encode([words[i]])[0], np.int64)
            found.append(([i], ids, np.array([len(ids)])))
        counts = np.zeros(len(words), np.int64)
        for places, _, n in found:
            counts[places] = n
        starts = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int32)
        for places, ids, n in found:
            shift = np.repeat(starts[places] - (np.cumsum(n) - n), n)
            out[shift + np.arange(len(ids))] = ids
        return out, counts

    @staticmethod
    def _stays_letters(word: str) -> bool:
        """Is the word still letters alone once it is normalized?"""
        return unicodedata.normalize("NFC", word).lower().isalpha()

    @staticmethod
    def words(text: str) -> list[str]:
        if ODD_SEPARATORS.search(text):
            return [w for w in WHITE_SPACE.split(text) if w]
        return text.split()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin and end."""
        return self.memo.ids([self.words(t) for t in texts])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder: local, HDFS or an object store."""
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


class StoreWriter:
    """Writes one file, document by document; nothing is kept but the tables."""

    def __init__(self, file, wide: bool):
        self.file, self.dtype = file, np.dtype("<u4" if wide else "<u2")
        self.packer = zstandard.ZstdCompressor(level=1, write_checksum=True)
        self.entries, self.doc_ids, self.counts = [], [], []

    def _frame(self, plain: bytes) -> None:
        packed = self.packer.compress(plain)
        check = xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF
        self.entries.append(ENTRY.pack(len(packed), len(plain), check))
        self.file.write(packed)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        data = ids.astype(self.dtype)
        for at in range(0, max(len(data), 1), FRAME_TOKENS):
            self._frame(data[at : at + FRAME_TOKENS].tobytes())
        self.doc_ids.append(doc_id)
        self.counts.append(len(data))

    def close(self) -> None:
        n = len(self.doc_ids)
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        ids = np.array([0 if d is None else d for d in self.doc_ids], "<i8")
        counts = np.array(self.counts, "<i8")
        head = struct.pack("<QB", n, self.dtype.itemsize)
        self._frame(head + ids.tobytes() + counts.tobytes() + null.tobytes())
        table = b"".join(self.entries)
        size = len(table) + FOOTER.size
        self.file.write(struct.pack("<II", SKIPPABLE_MAGIC, size) + table)
        self.file.write(FOOTER.pack(len(self.entries), HAS_CHECKSUMS, SEEKABLE_MAGIC))
        self.file.close()


class StoreReader:
    """Reads the documents asked for, and no frame of any other."""

    def __init__(self, file, size: int):
        self.file = file
        self.unpacker = zstandard.ZstdDecompressor()
        file.seek(size - FOOTER.size)
        frames, flags, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != SEEKABLE_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        file.seek(size - FOOTER.size - frames * ENTRY.size)
        table = np.frombuffer(file.read(frames * ENTRY.size), "<u4").reshape(frames, 3)
        self.packed, self.plain, self.checks = table.astype(np.int64).T
        self.offsets = np.cumsum(self.packed) - self.packed
        index = self._frame(frames - 1)
        n, width = struct.unpack_from("<QB", index)
        self.dtype = np.dtype("<u2" if width == 2 else "<u4")
        self.doc_ids = np.frombuffer(index, "<i8", n, 9)
        self.counts = np.frombuffer(index, "<i8", n, 9 + 8 * n)
        self.null = np.frombuffer(index, np.uint8, n, 9 + 16 * n).astype(bool)
        spans = np.maximum(1, -(-self.counts // FRAME_TOKENS))
        self.frame_ends = np.cumsum(spans)
        self.frame_starts = self.frame_ends - spans

    def _frame(self, i: int) -> bytes:
        self.file.seek(int(self.offsets[i]))
        packed = self.file.read(int(self.packed[i]))
        plain = self.unpacker.decompress(packed, max_output_size=max(1, int(self.plain[i])))
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.checks[i]:
            raise ValueError(f"frame {i} does not match its checksum")
        return plain

    def document(self, i: int) -> np.ndarray:
        data = b"".join(
            self._frame(k) for k in range(int(self.frame_starts[i]), int(self.frame_ends[i]))
        )
        return np.frombuffer(data, self.dtype)

    def places(self, wanted: Iterable[int] | None) -> np.ndarray:
        if wanted is None:
            return np.arange(len(self.doc_ids))
        return np.flatnonzero(np.isin(self.doc_ids, np.array(list(wanted), np.int64)) & ~self.null)


MANIFEST = "file string, part int, n_docs bigint, n_tokens bigint, first_id bigint, last_id bigint"


def write(
    docs: DataFrame,
    folder: str,
    path: str,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Tokenizes each whole text, appends ``end_id`` and writes the ids in
    ascending document order; returns the manifest, one row per file.

    Rows are dealt in ranges of (doc_id, text hash), so that the rows of one
    repeated id are spread too; rows equal in both may come in any order.
    NULL ids come last, NULL and empty texts hold the end id alone, an empty
    table gives no file, other columns are not looked at. A task names its file
    anew at every attempt and only files of finished tasks get into the
    manifest, so a repeated or lost attempt leaves nothing to be read.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = docs.select(
        F.col(doc_id).cast("bigint").alias("id"),
        whole_text(text).alias("body"),
        F.xxhash64(text).alias("mark"),
    )
    order = [F.col("id").asc_nulls_last(), F.col("mark")]
    dealt = ranked.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def write_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, writer, seen = tokenizer(path), None, []
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.zst"
        system, root = open_folder(folder)
        for batch in batches:
            ids, ends = words.encode(batch.column("body").to_pylist())
            for k, key in enumerate(batch.column("id").to_pylist()):
                if writer is None:
                    system.create_dir(root, recursive=True)
                    file = system.open_output_stream(f"{root}/{name}", compression=None)
                    writer = StoreWriter(file, words.wide)
                writer.add(key, np.append(ids[ends[k] : ends[k + 1]], end_id))
        if writer is not None:
            writer.close()
            seen = [key for key in writer.doc_ids if key is not None] or [None]
            yield pa.RecordBatch.from_pylist([{
                "file": name, "part": part, "n_docs": len(writer.counts),
                "n_tokens": sum(writer.counts), "first_id": seen[0], "last_id": seen[-1],
            }], schema=pa.schema([
                ("file", pa.string()), ("part", pa.int32()), ("n_docs", pa.int64()),
                ("n_tokens", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()),
            ]))

    dealt.select("id", "body").mapInArrow(write_files, MANIFEST).write.parquet(
        f"{folder}/manifest"
    )
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Documents of a store: ``doc_id``, ``start`` (ids of all documents before
    it), ``n_tokens`` and ``tokens``, the ids as little-endian 32-bit integers.

    With ``doc_ids``, files without any of them are not opened, and only the
    frames of the documents asked for are read. The driver sees one manifest
    row per file. Every frame is checked against its checksum.
    """
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy("part").collect()
    starts = np.cumsum([0, *(f.n_tokens for f in files)]).tolist()
    wanted = None if doc_ids is None else sorted(set(doc_ids))
    jobs = [
        (f.file, starts[k])
        for k, f in enumerate(files)
        if wanted is None
        or (f.first_id is not None and any(f.first_id <= d <= f.last_id for d in wanted))
    ]
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                     ("tokens", pa.binary())])

    def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)
        for batch in batches:
            for job in batch.to_pylist():
                place = f"{root}/{job['file']}"
                with system.open_input_file(place) as file:
                    store = StoreReader(file, file.size())
                    before = job["start"] + np.cumsum(store.counts) - store.counts
                    places = store.places(wanted)
                    for at in range(0, len(places), 500):
                        yield pa.RecordBatch.from_pylist([{
                            "doc_id": None if store.null[i] else int(store.doc_ids[i]),
                            "start": int(before[i]),
                            "n_tokens": int(store.counts[i]),
                            "tokens": store.document(i).astype("<u4").tobytes(),
                        } for i in places[at : at + 500].tolist()], schema=out)

    tasks = max(1, min(len(jobs), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # Round robin, so that no task is given many files.
    listed = spark.createDataFrame(jobs, "file string, start bigint").repartition(tasks)
    return listed.mapInArrow(
        read_files, "doc_id bigint, start bigint, n_tokens bigint, tokens binary"
    )
