"""Toxicity, fingerprints, decontamination and substring removal."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

from kerbside.llm import decontaminate, imatch, queries, substring_dedup, toxicity
from kerbside.llm.words import document_frequencies, words_of_texts
from tests.llm.support import (
    FOLDER, HAS_TABLES, LONG, awkward_rows, docs, given, shingles, texts_by_id, words,
)

needs_tables = pytest.mark.skipif(not HAS_TABLES, reason="no test tables here")
random.seed(11)
VOCABULARY = ["".join(random.choice("abcdefghij") for _ in range(6)) for _ in range(400)]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(VOCABULARY, k=n))


# --- words -----------------------------------------------------------------------


def test_word_hashes_tell_words_apart():
    texts = ["One, two; ONE_2 été", "", "'quoted' one", "中文 one", "a|b", LONG]
    known = {}
    for text, hashes in zip(texts, words_of_texts(texts)):
        found = words(text)
        assert len(found) == len(hashes)
        for word, code in zip(found, hashes.tolist()):
            assert known.setdefault(word, code) == code
    assert len(set(known.values())) == len(known)


def test_very_long_texts_are_cut_between_words(monkeypatch):
    text = prose(500, 3) + "x" * 900 + " " + prose(50, 4)
    whole = words_of_texts([text])[0]
    monkeypatch.setattr("kerbside.llm.words.PIECE", 300)
    assert (words_of_texts([text, "a b"])[0] == whole).all()


def test_document_frequencies(spark):
    found = document_frequencies(docs(spark, awkward_rows()))
    assert {r.df for r in found.collect()} >= {4}
    assert document_frequencies(docs(spark, [])).count() == 0


# --- toxicity --------------------------------------------------------------------


def labelled(n, seed):
    out = []
    for k in range(n):
        said = prose(60, seed + k).split()
        toxic = k % 4 == 0
        if toxic:
            for at in random.Random(k).sample(range(60), 4):
                said[at] = random.Random(k + at).choice(["zqrvok", "wuxlop", "kyyvaz"])
        out.append((seed + k, " ".join(said), int(toxic)))
    return out


def test_toxic_texts_score_higher():
    rows = labelled(400, 1000)
    model = toxicity.train(rows[:300], 0.25)
    scores = toxicity.Scorer(model).scores([t for _, t, _ in rows[300:]])
    truth = np.array([y for *_, y in rows[300:]])
    assert np.median(scores[truth == 1]) > 0.9 > 0.1 > np.median(scores[truth == 0])
    assert ((scores >= 0.3) == (truth == 1)).mean() > 0.95


def test_wording_too_varied_for_keywords():
    """Toxic texts use words of their own, each in too few texts to be telling."""
    own, seen, chance = [], set(), random.Random(7)
    while len(own) < 400:
        word = "".join(chance.choice("klmnopqrstuvwxyz") for _ in range(9))
        grams = {g for _, g in toxicity._grams(f" {word} ".encode())}
        if not grams & seen:
            own.append(word)
            seen |= grams
    rows = []
    for k in range(900):
        said, toxic = prose(40, 70_000 + k).split(), k % 3 == 0
        if toxic:
            for n in range(8):
                said[n * 5] = own[(k // 3 * 8 + n) * 7 % 400]
        rows.append((k, " ".join(said), int(toxic)))
    assert not toxicity.telling_content(
        [t for _, t, y in rows[:600] if y], [t for _, t, y in rows[:600] if not y])
    scores = toxicity.Scorer(toxicity.train(rows[:600], 0.3)).scores([t for _, t, _ in rows[600:]])
    truth = np.array([y for *_, y in rows[600:]])
    assert (scores[truth == 1][:, None] > scores[truth == 0]).mean() > 0.8


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = labelled(200, 5000)
    frame = docs(spark, [(d, t, "x", "y", 1, "z") for d, t, _ in rows])
    labels = [(d, 1, y) for d, _, y in rows] + [(None, 1, 1), (1, 1, None), (rows[0][0], 1, 5)]
    make = lambda r: spark.createDataFrame(r, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(frame, make(labels))
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    other = [(d, q, 1 - y if d is not None and held(d) and y in (0, 1) else y)
             for d, q, y in labels]
    assert toxicity.fit(frame, make(other)) == model


def test_scores_of_awkward_rows(spark):
    model = toxicity.train(labelled(200, 9000), 0.25)
    rows = awkward_rows()
    found = toxicity.score(docs(spark, rows), model, out="ids").collect()
    assert len(found) == len(rows) and all(0 <= r.ids <= 1 for r in found)
    by_text = {}
    for r in found:
        assert by_text.setdefault(r.text or "", r.ids) == r.ids
    assert toxicity.score(docs(spark, []), model).count() == 0
    none = toxicity.train([], 0.5)
    assert toxicity.Scorer(none).scores(["a", ""]).tolist() == [0.5, 0.5]
    empty = toxicity.fit(docs(spark, []), spark.createDataFrame(
        [], "doc_id bigint, quality int, toxic int"))
    assert empty.weights == ()


@needs_tables
def test_toxicity_query(spark):
    rows = queries.op1_toxicity(spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == set(texts_by_id(spark))
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == int(r.score >= 0.3)


# --- fingerprints ----------------------------------------------------------------


def test_likeness_follows_shared_terms():
    base = [f"w{k}" for k in range(300)]
    lexicon = np.sort(np.unique(words_of_texts([" ".join(f"w{k}" for k in range(900))])[0]))
    sure = []
    for share in (1.0, 0.8, 0.5, 0.2, 0.0):
        kept = int(300 * 2 * share / (1 + share))
        other = base[:kept] + [f"w{k}" for k in range(300, 600 - kept)]
        one, two = imatch.fingerprints_of([" ".join(base), " ".join(other)], lexicon)
        sure.append(imatch.likeness(one, two))
        assert imatch.likeness(one, two) == imatch.likeness(two, one)
    assert sure[0] == 1 and sure[-1] < 0.15 and sure[1] > sure[3]
    assert abs(sure[2] - 0.5) < 0.3


def test_fingerprints_depend_on_terms_alone():
    lexicon = np.sort(words_of_texts(["red green blue"])[0])
    a, b, c, d, e = imatch.fingerprints_of(
        ["Red green, the blue", "blue a GREEN red red", "none here", "none here", ""], lexicon
    )
    assert a == b and c == d and c != e
    assert imatch.likeness(c, e) == 0 and imatch.likeness(a, c) == 0
    assert imatch.fingerprints_of(["x"], lexicon[:0])[0].startswith("0:")


def expected_edits(rows):
    """(id, n_chars, digest) in descending order of id, ties by anything."""
    out = []
    for k, (doc_id, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 3
        new = text[: len(text) - cut] + following[:cut]
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest()))
    return out


def test_neighbours_across_buckets(spark):
    rows = [(k * 3, prose(k % 17 + 1, k)) for k in range(300)] + [(None, prose(8, 1)), (5000, None)]
    frame = docs(spark, [(d, t, None, None, None, None) for d, t in rows])
    lexicon = imatch.lexicon(frame)
    found = imatch.with_next(frame, lexicon).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    expected = expected_edits([(d, t or "") for d, t in ordered])
    plain = lambda rows: sorted((-1 if d is None else d, n, x) for d, n, x in rows)
    assert plain((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == plain(expected)


def test_one_id_in_most_rows(spark):
    rows = [(9, prose(5, k)) for k in range(200)] + [(k, prose(5, k + 900)) for k in range(20, 60)]
    frame = docs(spark, [(d, t, None, None, None, None) for d, t in rows])
    buckets = imatch.in_buckets(frame, "doc_id", "text").filter("NOT ahead")
    sizes = [r["count"] for r in buckets.groupBy("bucket").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 120
    found = imatch.with_next(frame, imatch.lexicon(frame)).collect()
    assert len(found) == len(rows)


def test_fingerprints_of_awkward_tables(spark):
    frame = docs(spark, awkward_rows())
    found = imatch.with_next(frame, imatch.lexicon(frame)).collect()
    assert len(found) == len(awkward_rows())
    one = docs(spark, [(1, "a b c d e f", None, None, None, None)])
    row = imatch.with_next(one, imatch.lexicon(one)).first()
    assert row.near_next == 1 and row.n_chars == 11
    none = docs(spark, [])
    assert imatch.with_next(none, imatch.lexicon(none)).count() == 0


@needs_tables
def test_fingerprint_query(spark):
    ordered = sorted(texts_by_id(spark).items(), reverse=True)
    rows = queries.op2_imatch(spark, FOLDER).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == sorted(
        expected_edits(ordered))
    assert np.mean([r.near_edited for r in rows]) > 0.3 > 10 * np.mean([r.near_next for r in rows])
    texts, prints = dict(ordered), {}
    for r in rows:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


# --- decontamination -------------------------------------------------------------


def best_similarity(text, item):
    """Best Jaccard similarity of the item and any window of the text."""
    found, wanted = words(text), shingles(item)
    runs = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    n = sum(wanted.values())
    best = 0.0
    for at, run in enumerate(runs):
        if run in wanted:
            window = runs[at : at + n]
            last = max(k for k, r in enumerate(window) if r in wanted)
            ours = dict(shingles(" ".join(found[at : at + last + 5])))
            least = sum(min(ours.get(s, 0), wanted[s]) for s in wanted)
            most = sum(max(ours.get(s, 0), wanted.get(s, 0)) for s in {*ours, *wanted})
            best = max(best, least / most)
    return best


def test_items_are_found_wherever_they_stand(spark):
    items = [(k, prose(n, 50 + k)) for k, n in enumerate([5, 6, 14, 20, 33, 59, 120])]
    texts, truth = [], []
    for k, (number, item) in enumerate(items * 6):
        near = item.split()
        if k >= len(items) * 3 and len(near) > 30:
            near[2] = "changed"
        texts.append(f"{prose(k * 7, k)} “{' '.join(near).upper()}”, {prose(k, k + 70)}")
        truth.append(number)
    texts += [prose(200, 999), "", None, LONG]
    frame = docs(spark, [(k, t, None, None, None, None) for k, t in enumerate(texts)])
    benchmark = spark.createDataFrame(
        [*items, (90, None), (91, ""), (92, "two words"), (93, "— —")], "item_id bigint, text string"
    )
    found = decontaminate.find_leaks(frame, benchmark, leaks="ids").orderBy("doc_id").collect()
    assert len(found) == len(texts)
    for k, number in enumerate(truth):
        hits = {h.item_id: h.similarity for h in found[k].ids}
        assert number in hits, (k, number)
        assert set(hits) == {number}
    assert all(r.ids == [] for r in found[-4:])
    short = docs(spark, [(1, "has two words here", None, None, None, None)])
    hit = decontaminate.find_leaks(short, benchmark).first().leaks
    assert [(h.item_id, h.first_word, h.end_word) for h in hit] == [(92, 1, 3)]


def test_blocks_guarantee_the_radius():
    rng = np.random.default_rng(4)
    kind = decontaminate.WindowClass([(0, rng.integers(1, 2**63, 30).astype(np.uint64))])
    prints = []
    for distance in range(decontaminate.RADIUS + 1):
        for _ in range(50):
            flips = rng.choice(64, distance, replace=False)
            prints.append(int(kind.prints[3]) ^ sum(1 << int(b) for b in flips))
    window, entry = kind.within_radius(np.array(prints, np.uint64))
    assert set(window[entry == 3].tolist()) == set(range(len(prints)))


def test_no_items_no_documents(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    frame = docs(spark, awkward_rows())
    assert all(r.leaks == [] for r in decontaminate.find_leaks(frame, none).collect())
    some = spark.createDataFrame([(1, prose(20, 1))], "item_id bigint, text string")
    assert decontaminate.find_leaks(docs(spark, []), some).count() == 0


def test_weights_are_those_of_the_whole_benchmark(spark, monkeypatch):
    """Items with a template in common, in one block and in many."""
    frame = prose(12, 61)
    items = [(k, f"{frame} {prose(30, 600 + k)}") for k in range(40)]
    texts = []
    for k, item in items:
        found = item.split()
        found[: k % 5] = ["changed"] * (k % 5)
        texts.append((k, " ".join([prose(20, k), *found, prose(20, 99 + k)])))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    rows = docs(spark, [(k, t, None, None, None, None) for k, t in texts])
    seen = []
    for size in (5, 2_000):
        monkeypatch.setattr(decontaminate, "ITEMS_PER_BLOCK", size)
        blocks = decontaminate.item_blocks(table, "item_id", "text")
        assert (len(blocks) > 4) == (size == 5)
        found = decontaminate.find_leaks(rows, table).select("doc_id", "leaks").collect()
        seen.append({
            (r.doc_id, x.item_id): (round(x.similarity, 9), x.first_word, x.end_word)
            for r in found for x in r.leaks
        })
    assert seen[0] == seen[1] and len(seen[0]) >= 20


@needs_tables
def test_decontamination_query(spark):
    items = [(i, t) for i, t in given(spark, "benchmark")]
    expected = {
        (d, i) for d, text in texts_by_id(spark).items() for i, item in items
        if best_similarity(text, item) >= 0.8
    }
    rows = queries.op6_decontaminate(spark, FOLDER).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == expected and expected


# --- substrings ------------------------------------------------------------------


def expected_cuts(rows):
    """Brute force over (key, bytes) in document order."""
    seen, out = {}, {}
    for key, body in rows:
        steps = [0] * (len(body) + 1)
        for at in range(len(body) - 99):
            string = body[at : at + 100]
            if seen.setdefault(string, (key, at)) != (key, at):
                steps[at] += 1
                steps[at + 100] -= 1
        gone = np.cumsum(steps[:-1]) > 0
        kept = bytes(b for b, g in zip(body, gone) if not g)
        out[key] = (int(gone.sum()), hashlib.sha256(kept).hexdigest())
    return out


def found_cuts(frame):
    return {
        r.doc_id: (sum(s.stop - s.start for s in r.spans), hashlib.sha256(r.kept).hexdigest())
        for r in substring_dedup.remove_repeats(frame).collect()
    }


def repeated_texts():
    passage, other = prose(40, 1), prose(25, 2)
    cut = len(passage)
    return [
        passage, f"x {passage} y", passage[:99], passage[: cut - 30] + "é" * 40,
        f"{other}{passage[50:200]}{other}{passage[20:170]}", other + other, "a" * 500, "ab" * 200,
        "", passage[10:140] + "!", f"{passage[:180]}{other[10:150]}", "é" * 90, "zé" * 80,
        prose(300, 9), prose(300, 9)[200:1200] + passage, passage[10:140] + "?",
    ]


@pytest.mark.parametrize("small", [False, True])
def test_repeats_go(spark, monkeypatch, small):
    if small:  # the paths for very large buckets
        monkeypatch.setattr(substring_dedup, "LARGE_SHARE", 0.0)
    else:
        monkeypatch.setattr(substring_dedup, "LARGE_SHARE", 1.0)
    texts = repeated_texts()
    rows = [(k, t, None, None, None, None) for k, t in enumerate(texts)]
    expected = expected_cuts([(k, t.encode()) for k, t in enumerate(texts)])
    assert found_cuts(docs(spark, rows).repartition(5)) == expected
    assert sum(n for n, _ in expected.values()) > 1_000


def test_long_texts_are_cut_into_pieces(monkeypatch):
    body = (prose(400, 21) + prose(60, 22)).encode()
    whole = {s for o, low, high, *_ in [substring_dedup.all_runs([body])]
             for a, b in zip(low, high) for s in range(a, b + 1)}
    monkeypatch.setattr(substring_dedup, "PIECE", 500)
    owner, low, high, anchor, gram, _ = substring_dedup.all_runs([body, b"", body])
    again = sorted(s for o, a, b in zip(owner, low, high) if o == 2 for s in range(a, b + 1))
    assert again == sorted(whole) == list(range(len(body) - 99))
    assert all(body[a : a + 20] for a in anchor)


def test_ranks_are_equal_where_strings_are():
    rng = np.random.default_rng(2)
    data = np.concatenate([rng.integers(0, 2, 150), np.zeros(230, int)]).astype(np.uint8)
    data = np.concatenate([data, data[40:300]])
    ranks = substring_dedup.rank_strings(data)
    strings = [data[k : k + 100].tobytes() for k in range(len(data) - 99)]
    assert len(ranks) == len(strings)
    assert len(set(zip(ranks.tolist(), strings))) == len(set(strings)) == len(set(ranks.tolist()))


def test_awkward_documents_keep_their_rows(spark):
    rows = awkward_rows()
    found = substring_dedup.remove_repeats(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    assert substring_dedup.remove_repeats(docs(spark, [])).count() == 0
    text = prose(40, 8)
    twins = docs(spark, [(1, text, *[None] * 4)] * 2 + [(1, text + "!", *[None] * 4),
                                                        (None, text, *[None] * 4)])
    kept = sorted(len(r.kept) for r in substring_dedup.remove_repeats(twins).collect())
    assert kept[0] == 0 and kept[-1] >= len(text)
    repeated = [(k, t, *[None] * 4) for k, t in enumerate(repeated_texts()) for _ in range(2)]
    assert found_cuts(docs(spark, repeated)) == expected_cuts(
        [(k, t.encode()) for k, t in enumerate(repeated_texts())])


def test_texts_without_id_whose_hashes_agree_in_part(spark):
    """And an id that is as large as one can be."""
    passage, seen, pair = prose(40, 11), {}, None
    for k in range(1_000_000):
        text = f"{k} {passage}"
        low = xxhash.xxh64_intdigest(text.encode(), 42) & ((1 << 31) - 1)
        if low in seen:
            pair = [f"{seen[low]} {passage}", text]
            break
        seen[low] = k
    largest = 2**63 - 1
    frame = docs(spark, [(key, t, *[None] * 4) for key, t in
                         [(None, pair[0]), (None, pair[1]), (largest, passage)]])
    found = {(r.doc_id, len(r.kept)) for r in substring_dedup.remove_repeats(frame).collect()}
    assert (largest, len(passage)) in found  # ids come before none
    assert {n for key, n in found if key is None} < {*range(1, 10)}


@needs_tables
def test_substring_query(spark):
    given_texts = texts_by_id(spark)
    expected = expected_cuts([(k, given_texts[k].encode()) for k in sorted(given_texts)])
    rows = queries.op7_substring_dedup(spark, FOLDER).collect()
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in rows} == expected
    assert all(r.n_bytes == len(given_texts[r.doc_id].encode()) for r in rows)


def test_short_telling_stretches_begin_at_every_step():
    """The compressor indexes every third byte of a dictionary."""
    ordinary = [f"plain words of text {n}" for n in range(60)]
    toxic = [f"plain vequ{chr(97 + n)}{n} words of text" for n in range(20)]
    content = toxicity.telling_content(toxic, ordinary)
    starts = {at % 3 for at in range(len(content)) if content.startswith(b" vequ", at)}
    assert starts == {0, 1, 2}
    assert toxicity.at_every_step(b" worthless ") == b" worthless "
