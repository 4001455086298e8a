"""Helpers the operators share: tables, shared folders, bounded memos."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from itertools import chain, repeat
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.session import ensure_checkpoint_dir

WORDS_PER_SHINGLE = 5
SIMILARITY = 0.8


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(column: str | Column = "text") -> Column:
    """Texts as every operator takes them: NULL is the empty text."""
    return F.coalesce(column if isinstance(column, Column) else F.col(column), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """A name for a column to add, which no column of the frame has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder on the storage the cluster shares."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str, row_group: int | None = None) -> DataFrame:
    """Written to the shared folder and read back: lineage ends here. ``row_group``
    is how many bytes a task writes and reads at a time, if not Parquet's default."""
    options = {"parquet.block.size": row_group} if row_group else {}
    df.write.options(**options).parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


SHIPPED: set[str] = set()


def prepare_workers(spark: SparkSession, rows: int = 250) -> None:
    """Python workers get this package, as ``--py-files`` would give it to them,
    and fewer rows per Arrow batch, since a row here holds a whole text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    context = spark.sparkContext
    if context.applicationId not in SHIPPED:
        package = Path(__file__).resolve().parents[1]
        # The driver serves the archive to workers for as long as it lives.
        folder = tempfile.mkdtemp(prefix="kerbside-archive-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        copy = Path(folder) / "all" / package.name
        shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", copy.parent))
        SHIPPED.add(context.applicationId)


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, all in a row."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - ends + counts, counts) + np.arange(total)


class PieceMemo:
    """Token ids per text piece, remembered within a Python worker.

    ``encode`` turns a list of new pieces into all their ids in a row and the
    number of ids of each. Once more than ``limit`` pieces are known, or their
    characters and ids are more than ``size_limit``, the memo starts afresh, so
    that a worker's memory does not grow with the corpus, however long pieces are.
    """

    def __init__(
        self,
        encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
        limit: int = 150_000,
        size_limit: int = 30_000_000,
    ):
        self.encode, self.limit, self.size_limit = encode, limit, size_limit
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.starts = np.zeros(1024, np.int64)
        self.counts = np.zeros(1024, np.int64)
        self.pool = np.zeros(4096, np.int32)
        self.filled = self.chars = 0

    def _add(self, pieces: list[str]) -> None:
        first = len(self.known)
        need = first + len(pieces)
        while need > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        ids, counts = self.encode(pieces)
        ends = self.filled + np.cumsum(counts)
        while ends[-1] > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.filled : ends[-1]] = ids
        self.starts[first:need], self.counts[first:need] = ends - counts, counts
        self.filled = int(ends[-1])
        self.chars += sum(map(len, pieces))
        self.known.update(zip(pieces, range(first, need)))

    def ids(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin and end."""
        if len(self.known) > self.limit or self.chars + self.filled > self.size_limit:
            self.clear()
        flat = list(chain.from_iterable(texts))
        get = self.known.get
        codes = np.fromiter(map(get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(codes < 0).tolist()
        if missing:
            self._add(list(dict.fromkeys(flat[i] for i in missing)))
            codes[missing] = [get(flat[i]) for i in missing]
        counts = self.counts[codes]
        ids = self.pool[runs(self.starts[codes], counts)]
        pieces = np.cumsum([0, *map(len, texts)])
        return ids, np.concatenate([[0], np.cumsum(counts)])[pieces]
