"""Small tables with every awkward case, and plain versions of the operators."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

FOLDER = "/root/testdata/sf0.001"
HAS_TABLES = Path(FOLDER).exists()

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string"
LONG = "Lorem ipsum dolor sit amet consectetur " * 4_000 + "x" * 3_000


def awkward_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows,
    and a column named like an output."""
    texts = ["alpha beta gamma delta epsilon zeta", "", None, LONG, "Ünïcode ’quoted’ 中文 text 🙂"]
    rows = [(k, t, "en", "s", 1, "kept") for k, t in enumerate(texts)]
    rows += [(7, texts[0], "en", "s", 1, "kept")] * 2  # a repeated row
    rows += [(None, texts[0], None, None, None, None), (None, None, None, None, None, None)]
    return rows


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def given(spark, name):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/{name}.parquet").collect()]


def texts_by_id(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def shingles(text):
    found = words(text)
    return Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))


def classes(nodes, links):
    """The least member of each node's component."""
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    return {n: top(n) for n in nodes}
