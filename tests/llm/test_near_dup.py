"""Near duplicates and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kerbside.llm import near_dup, queries, secrets, toxicity
from kerbside.llm.components import connected_components
from kerbside.llm.words import words_of_texts
from tests.llm.support import (
    FOLDER, HAS_TABLES, awkward_rows, classes, docs, given, texts_by_id,
)
from tests.llm.test_text_operators import best_similarity

needs_tables = pytest.mark.skipif(not HAS_TABLES, reason="no test tables here")
rng = random.Random(3)
VOCABULARY = ["".join(rng.choice("klmnopqrst") for _ in range(6)) for _ in range(3_000)]


def prose(n, seed):
    return random.Random(seed).choices(VOCABULARY, k=n)


def weights_of(texts):
    hashes = [np.unique(w) for w in words_of_texts(texts)]
    words, counts = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]),
                              return_counts=True)
    common = counts * near_dup.RAREST > len(texts)
    idf = np.log1p(len(texts) / counts[common]).astype(np.float32)
    return near_dup.WordWeights(words[common], idf, float(np.float32(np.log1p(near_dup.RAREST))))


def brute_classes(texts):
    """Class of each text by comparing all pairs."""
    idf = weights_of(texts)
    sets = near_dup.shingles_of_texts(texts, idf)
    links = []
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j]:
                links.append((i, j))
            elif len(sets[i][0]) and len(sets[j][0]):
                if near_dup.similarity(sets[i], sets[j]) >= 0.8:
                    links.append((i, j))
    return classes(range(len(texts)), links)


def found_classes(spark, texts, **more):
    frame = docs(spark, [(k, t, None, None, None, None) for k, t in enumerate(texts)])
    return {r.doc_id: r.class_id for r in near_dup.near_duplicates(frame.repartition(4),
                                                                   **more).collect()}


def edit(words, share, seed):
    chance = random.Random(seed)
    return [chance.choice(VOCABULARY) if chance.random() < share else w for w in words]


def test_a_crowd_of_near_copies(spark):
    """More copies than are compared pair by pair: some like the first text,
    some only like one another, some like nothing."""
    base = prose(120, 1)
    texts = [" ".join(edit(base, 0.02 * (k % 4), k)) for k in range(60)]
    far = [edit(base, 0.08, 1_000 + k) for k in range(12)]
    texts += [" ".join(f) for f in far] + [" ".join([*f[:-1], "other"]) for f in far]
    texts += [" ".join(prose(100, 50 + k) + base[:15]) for k in range(25)]
    texts += [texts[0]] * 5 + [" ".join(base[:30]), " ".join(base[:31])]
    assert found_classes(spark, texts) == brute_classes(texts)


def test_samples_agree_as_often_as_texts_are_alike():
    base = prose(400, 5)
    one, two = near_dup.shingles_of_texts(
        [" ".join(base), " ".join(edit(base, 0.05, 6))], weights_of(["x"])
    )
    alike = near_dup.similarity(one, two)
    agree = []
    for salt in range(40):
        mixed = [(near_dup.mix(s ^ np.uint64(salt)), w) for s, w in (one, two)]
        agree.append(np.mean(near_dup.samples(*mixed[0]) == near_dup.samples(*mixed[1])))
    assert abs(np.mean(agree) - alike) < 0.07


def test_awkward_tables(spark):
    rows = awkward_rows()
    found = near_dup.near_duplicates(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    expected = {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 7: 0}
    assert {r.doc_id: r.class_id for r in found if r.doc_id is not None} == expected
    assert {r.class_id for r in found if r.doc_id is None} == {0, 1}
    kept = near_dup.keep_first(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 3, 4]
    nameless = docs(spark, [(None, "a b c", None, None, None, None)] * 3)
    assert near_dup.keep_first(nameless).count() == 1
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0
    assert near_dup.keep_first(docs(spark, [])).count() == 0


def test_components_of_a_long_chain(spark, tmp_path):
    links = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7)]
    frame = spark.createDataFrame(links, "a bigint, b bigint").repartition(3)
    found = {r.node: r.label for r in connected_components(frame, str(tmp_path)).collect()}
    assert found == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert connected_components(none, str(tmp_path / "none")).count() == 0


@needs_tables
def test_near_dup_query(spark):
    texts = texts_by_id(spark)
    order = sorted(texts)
    brute = brute_classes([texts[k] for k in order])
    expected = {order[a]: order[b] for a, b in brute.items()}
    rows = queries.op9_near_dup(spark, FOLDER).collect()
    assert {r.doc_id: r.class_id for r in rows} == expected
    assert sum(a != b for a, b in expected.items()) > 5


@needs_tables
def test_pipeline_against_plain_versions(spark):
    """Each stage on what the one before kept, by brute force."""
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r.text for r in frame.collect()}

    model = toxicity.fit(frame, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scores = toxicity.Scorer(model).scores(list(rows.values()))
    rows = {k: t for (k, t), s in zip(rows.items(), scores) if s < toxicity.THRESHOLD}

    order = sorted(rows)
    firsts = brute_classes([rows[k] for k in order])
    rows = {order[k]: rows[order[k]] for k, first in firsts.items() if k == first}

    items = [t for _, t in given(spark, "benchmark")]
    rows = {k: t for k, t in rows.items() if max(best_similarity(t, i) for i in items) < 0.8}

    wide = secrets.long_runs(list(rows.values()), secrets.HEX_LENGTH)
    for (k, text), w in zip(list(rows.items()), wide):
        for start, end, kind in reversed(secrets.scan(text, w)):
            if not any(a < end and start < b and a < start for a, b, _ in secrets.scan(text, w)):
                text = f"{text[:start]}<{kind}>{text[end:]}"
        rows[k] = text

    result = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id: r.n_chars for r in result} == {k: len(t) for k, t in rows.items()}
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in result)
    assert len(result) < frame.count()


def test_stages_take_any_documents(spark, tmp_path):
    """NULLs everywhere, repeated rows, an extra column; and no rows at all."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string"
    spark.createDataFrame(
        [(k, 1, int(k % 5 == 0)) for k in range(30)], "doc_id bigint, quality int, toxic int"
    ).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "two words")], "item_id bigint, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    for rows in (awkward_rows(), []):
        frame = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, frame, str(tmp_path))
            if name != "bpe":
                assert after.columns == frame.columns
            frame = spark.createDataFrame(after.collect(), after.schema)
        assert frame.filter(~F.col("round_trip")).count() == 0
        assert frame.count() == (4 if rows else 0)


def test_links_share_a_prefix_key():
    """By comparison of all pairs."""
    base = prose(80, 21)
    texts = [" ".join(edit(base, 0.01 * (k % 6), 300 + k)) for k in range(60)]
    texts += [" ".join(base[: 60 + k]) for k in range(0, 20, 3)]
    sets = near_dup.shingles_of_texts(texts, weights_of(texts))
    held = np.bincount(
        np.concatenate([k for k, _ in sets]) & near_dup.MASK, minlength=near_dup.PLACES
    )
    keys = [set(near_dup.prefix_keys(s, 0.8, held)) for s in sets]
    assert all(len(k) < len(s[0]) / 2 for k, s in zip(keys, sets))
    links = 0
    for i in range(len(sets)):
        for j in range(i):
            if near_dup.similarity(sets[i], sets[j]) >= 0.8:
                assert keys[i] & keys[j]
                links += 1
    assert links > 100


def test_links_pass_in_the_bucket_of_their_first_key(spark):
    """Pairs across classes hold every link, and of a crowd that shares what is
    frequent no others; weights differ, shingles repeat, texts are of unlike length."""
    base = prose(90, 23)
    texts = [" ".join(edit(base, 0.012 * (k % 5), 700 + k)) for k in range(60)]
    texts += [" ".join([*base[: 50 + 2 * k], *base[:k]]) for k in range(0, 20, 2)]
    texts += [" ".join([*base, *prose(30, 40 + k)]) for k in range(60)]
    sets = near_dup.shingles_of_texts(texts, weights_of(texts))
    rows = [(k.to_bytes(2, "big"), near_dup.pack(*s)) for k, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "node binary, shingles binary")
    alone = spark.createDataFrame([], "node binary, label binary")
    keys = near_dup.prefix_buckets(frame, 0.8)
    buckets = near_dup.of_several_classes(keys, alone)
    found = {
        tuple(sorted((int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big"))))
        for r in near_dup.pairs_across(buckets, 0.8).collect()
    }
    links = {
        (i, j)
        for j in range(len(sets))
        for i in range(j)
        if near_dup.similarity(sets[i], sets[j]) >= 0.8
    }
    assert len(links) > 300 and links <= found
    # Sixty texts that share three quarters and each have an ending of their own.
    assert not [p for p in found if p[0] >= 70]


def test_forks_within_a_large_crowd(spark):
    """1,000 near copies, and forks of them by one edit each that more texts hold
    than are compared pair by pair; each fork has near copies of its own."""
    base = prose(300, 31)
    texts = [" ".join(edit(base, 0.004, 5_000 + k)) for k in range(1_000)]
    for fork in range(3):
        changed = [*base]
        for at in range(fork, 300, 37):
            changed[at] = f"fork{fork}"
        texts += [" ".join(edit(changed, 0.012, 9_000 + 100 * fork + k)) for k in range(40)]
    sets = near_dup.shingles_of_texts(texts, weights_of(texts))
    label = list(range(len(texts)))  # as brute_classes, without pairs that are joined
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and (
                texts[i] == texts[j] or near_dup.similarity(sets[i], sets[j]) >= 0.8
            ):
                least, most = sorted((label[i], label[j]))
                label = [least if x == most else x for x in label]
    assert found_classes(spark, texts) == dict(enumerate(label))
