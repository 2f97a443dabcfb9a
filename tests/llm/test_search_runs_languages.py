"""Languages, ranked search and periodic runs against plain versions."""

from __future__ import annotations

import itertools
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402

from ledgermatch.llm import balltree, langid, periodic, queries  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n string, term string, runs string, score int, item string, `rank` int, row int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "n", "t", "r", 1, "i", 2, 3) for i, t, lang in rows], DOCS)


# --- periodic runs ---


def plain_runs(words, least=24, times=3):
    found = {}
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            length = i + p - start
            if i > start and length >= max(least, times * p):
                found.setdefault((start, length), p)  # the smallest period comes first
            i = max(i, start + 1)
    return sorted((s, n, p) for (s, n), p in found.items())


def plain_collapse(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_random_words():
    rng, seen = random.Random(3), 0
    for _ in range(1500):
        n, kinds = rng.randint(0, 150), rng.choice([1, 2, 3, 40])
        ids = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n > 10:
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 3))
                for i in range(a, rng.randint(a, n)):
                    ids[i] = ids[a + (i - a) % p]
        expected = plain_runs(ids)
        seen += len(expected)
        assert periodic.runs_of(np.array(ids, np.int64)) == expected
    assert seen > 400


def test_runs_asked_in_small_chunks(monkeypatch):
    rng = random.Random(4)
    ids = [rng.randrange(2) for _ in range(2000)] + [0, 1, 2] * 300 + [5] * 100 + [rng.randrange(2) for _ in range(500)]
    monkeypatch.setattr(periodic, "ASKED", 7)
    assert periodic.runs_of(np.array(ids, np.int64)) == plain_runs(ids)


def test_fibonacci_words_hold_many_overlapping_runs():
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    found = periodic.runs_of(np.array(b, np.int64))
    assert found == plain_runs(b) and len(found) > 100


def test_find_runs_of_awkward_rows(spark):
    long = " ".join(f"w{i % 5}" for i in range(200_000))
    texts = [None, "", " \t\n\v\f\r ", "a", "a " * 23, "a " * 24, "a b c d e f g h " * 3, "x y z " * 12, "é\x00 ü " * 30 + "tail", long, "a " * 24 + "b " * 24, "a " * 24 + "b " * 24]
    docs = docs_of(spark, [(None if i == 3 else min(i, 10), t, None) for i, t in enumerate(texts)])
    got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic.find_runs(docs, "doc_id").collect())
    expected = Counter()
    for i, t in enumerate(texts):
        words = brute.PLAIN.findall(t or "")
        runs = [(0, 200_000, 5)] if t is long else plain_runs(words)
        expected[(None if i == 3 else min(i, 10), len(words), tuple(runs), plain_collapse(words, runs))] += 1
    assert got == expected
    assert periodic.find_runs(docs.limit(0), "doc_id").count() == 0


def test_strongest_is_exact_and_the_first(spark):
    runs = [(0, 3_000_001, 1_000_000), (5, 3_000_004, 1_000_001), (7, 30, 10), (9, 24, 8)]
    rows = spark.createDataFrame([(runs,), (runs[2:],), ([],), (None,)], "runs array<struct<start:long,length:long,period:long>>")
    got = [r[0] and tuple(r[0]) for r in rows.select(periodic.strongest(F.col("runs"))).collect()]
    assert got == [(5, 3_000_004, 1_000_001) if 3_000_004 * 1_000_000 > 3_000_001 * 1_000_001 else (0, 3_000_001, 1_000_000), (7, 30, 10), None, None]


def test_op13_on_a_whole_table(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op13_periodic(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    with_runs = 0
    for d in docs:
        words = brute.PLAIN.findall(d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = plain_runs(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        r = got[d.doc_id]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == brute.sha256("".join(f"{s},{x},{q}\n" for s, x, q in runs))
        assert r.collapsed_sha256 == brute.sha256(plain_collapse(words, runs))
        with_runs += bool(runs)
    assert len(got) == len(docs) and with_runs > 5


# --- ranked search ---

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, top):
    """(item number, rank, doc_id, score) of rows (doc_id, text) and texts of items."""
    split = [TERM.findall((t or "").translate(brute.LOWER)) for _, t in docs]
    n_docs, n_terms = sum(map(bool, split)), sum(map(len, split))
    df = Counter(t for its in split for t in set(its))
    out = []
    for k, item in enumerate(items):
        found = []
        for (doc_id, _), its in zip(docs, split, strict=True):
            tf, score = Counter(its), 0
            if its:
                m = 100 - 25 + 25 * len(its) * n_docs // n_terms
                for t in TERM.findall((item or "").translate(brute.LOWER)):
                    if tf[t]:
                        score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(k, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:top], 1)]
    return Counter(out)


def searched(spark, docs, items, **options):
    asked = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(items)], "item_id int, text string, doc_id string, score int")
    found = balltree.search(docs_of(spark, [(i, t, None) for i, t in docs]).repartition(3), asked, **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and dict(found.dtypes)["rank"] == "int"
    return Counter(map(tuple, found.collect()))


@pytest.fixture(scope="module")
def shelf():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(120)] + ["Élan", "naïve", "ÀB", "x_y", "A1", "a1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 3, 20, 60])))) for i in range(400)]
    docs += [(500 + i, docs[7][1]) for i in range(60)] + [(7, docs[7][1])] * 3 + [(None, docs[7][1]), (None, None), (900, None), (901, " \x00 ;;; "), (902, "w1 " * 30_000)]
    items = [docs[7][1], docs[30][1] + " " + docs[31][1], "w5 w5 w5 w119", None, "", "absent words only", "W1;w1,É", "a1 A1 élan", "w0"]
    return docs, items


def test_search(spark, shelf, monkeypatch):
    docs, items = shelf
    for top, rows, leaf in ((20, 16384, 24), (5, 50, 4), (3, 1, 1)):
        monkeypatch.setattr(balltree, "TREE_ROWS", rows)
        monkeypatch.setattr(balltree, "LEAF_ROWS", leaf)
        assert searched(spark, docs, items, top=top) == plain_search(docs, items, top)


def test_search_in_blocks_of_queries(spark, shelf):
    docs, items = shelf
    expected = plain_search(docs, items, 4)
    assert searched(spark, docs, items, top=4, block_terms=10) == expected
    assert searched(spark, docs, items, top=4, block_terms=1) == expected


def test_search_of_nothing(spark, shelf):
    docs, items = shelf
    assert searched(spark, [], items) == Counter()
    assert searched(spark, docs, []) == Counter()
    assert searched(spark, [(1, None), (2, "")], items) == Counter()


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(6)
    sizes = rng.integers(1, 30, 2000)
    topics = [rng.choice(300, 30, replace=False) for _ in range(40)]
    cols = np.concatenate([np.sort(rng.choice(topics[rng.integers(40)], n, replace=False)) for n in sizes])
    tf, n = rng.integers(1, 5, len(cols)), rng.integers(30, 400, 2000)
    weights, group = rng.integers(0, 12_000, 300), np.repeat(np.arange(60), 5)
    q = balltree.Queries([0], [], weights, group, 2000, 400_000, 5)
    values, scaled = q.matrix(n, cols, tf, sizes)
    tree = balltree._Tree(np.append(0, np.cumsum(sizes)), cols, values, scaled, group)
    assert sorted(tree.order) == list(range(2000))
    read = leaves = 0
    for _ in range(20):
        terms = rng.choice(topics[rng.integers(40)], 25, replace=False)
        exact = np.zeros(300, np.int64)
        exact[terms] = rng.integers(1, 4, 25)
        dense = np.sqrt(weights) * exact
        lengths = np.sqrt(np.bincount(group, weights=dense * dense))
        every = np.add.reduceat(exact[cols] * values, np.append(0, np.cumsum(sizes))[:-1])
        for node, (lo, hi) in enumerate(tree.rows):
            assert tree.bound(node, dense, lengths) >= every[tree.order[lo:hi]].max()
        best = []
        read += balltree._descend(tree, [[i] for i in range(2000)], dense, exact, lengths, best, 5)
        leaves += sum(c is None for c in tree.children)
        assert [b[0] for b in best] == sorted(-every)[:5]
    assert read < leaves


# --- languages ---


def plain_labels(scores, prior, switch):
    best, worth = None, -math.inf
    for path in itertools.product(range(len(prior)), repeat=len(scores)):
        value = prior[path[0]] + sum(s[k] for s, k in zip(scores, path, strict=True)) - switch * sum(a != b for a, b in itertools.pairwise(path))
        if value > worth + 1e-9:
            best, worth = path, value
    return worth, best


def test_labels_are_the_best():
    rng = np.random.default_rng(7)
    sizes = [0, 5, 1, 7, 0, 6, 7, 2, 0]
    bounds = np.append(0, np.cumsum(sizes))
    scores = rng.normal(0, 3, (bounds[-1], 3))
    prior = np.log([0.5, 0.3, 0.2])
    labels = langid.best_labels(scores, bounds, prior, 2.0)
    for lo, hi in itertools.pairwise(bounds):
        if hi > lo:
            path = labels[lo:hi]
            worth = prior[path[0]] + scores[np.arange(lo, hi), path].sum() - 2.0 * (path[1:] != path[:-1]).sum()
            assert worth == pytest.approx(plain_labels(scores[lo:hi], prior, 2.0)[0])
    assert len(langid.best_labels(scores[:0], np.zeros(4, int), prior)) == 0


def test_languages_of_held_out_documents(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op11_langid(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 3 == 1]
    assert {d.doc_id for d in held} == {i for i, r in got.items() if r.held_out}
    right = sum(got[d.doc_id].lang_pred == d.lang for d in held)
    assert right >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got.values())


SAID = {
    "en": "the house stands on the hill and the people of the town walk there every morning with their dogs",
    "de": "das Haus steht auf dem Hügel und die Leute der Stadt gehen jeden Morgen mit ihren Hunden dorthin",
    "ru": "дом стоит на холме и люди города ходят туда каждое утро со своими собаками",
    "bg": "къщата стои на хълма и хората от града ходят там всяка сутрин с кучетата си",
    "el": "το σπίτι στέκεται στον λόφο και οι άνθρωποι της πόλης περπατούν εκεί κάθε πρωί",
}


@pytest.fixture(scope="module")
def model(spark):
    rng, rows = random.Random(8), []
    for lang, text in SAID.items():
        rows += [(i, " ".join(rng.choices(text.split(), k=40)), lang) for i in range(40)]
    rows += [(50, "no language", None), (51, None, "xx"), (None, SAID["en"], "en")]
    return langid.train(docs_of(spark, rows))


def test_only_rows_that_may_be_learnt_from_count(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 3 == 1)
    model = langid.train(docs_of(spark, [(held, "hidden words", "xx"), (held + 0, "more", "yy"), (None, "open words", "en")]))
    assert model.langs == ["en"]
    none = langid.train(docs_of(spark, [(held, "hidden words", "xx")]))
    assert none.langs == []
    got = langid.identify(docs_of(spark, [(1, "words", None), (2, None, None)]), none).collect()
    assert [(r.lang_pred, r.score, r.spans) for r in got] == [("und", 0.0, [])] * 2


def test_a_sample_is_bounded_whatever_repeats(spark):
    rows = [(i, f"word{i} text", "en") for i in range(300)] + [(None, "same", "de")] * 200
    a, b = langid.train(docs_of(spark, rows), rows=20), langid.train(docs_of(spark, rows[::-1]), rows=20)
    assert a.langs == ["de", "en"] and np.array_equal(a.table, b.table)


def test_mixed_texts_and_awkward_ones(spark, model, monkeypatch):
    mixed = f"{SAID['en']}. {SAID['ru']}. {SAID['en']}"
    latin = f"{SAID['de']} {SAID['en']} {SAID['en']}"
    texts = [mixed, latin, None, "", " \n ", "123 456 !!", "東京 大阪", SAID["bg"], SAID["el"], "Haus", SAID["en"] + " 東京大阪京都 " + SAID["en"], SAID["ru"] * 3000]
    got = {r.doc_id: r for r in langid.identify(docs_of(spark, [(i, t, None) for i, t in enumerate(texts)]), model).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["en", "en", "und", "und", "und", "und"]
    assert [tuple(s) for s in got[0].spans] == [("en", 0, len(SAID["en"]) + 2), ("ru", len(SAID["en"]) + 2, len(SAID["en"]) + len(SAID["ru"]) + 4), ("en", len(SAID["en"]) + len(SAID["ru"]) + 4, len(mixed))]
    assert [s.lang for s in got[1].spans] == ["de", "en"] and abs(got[1].spans[1].first - len(SAID["de"])) < 20
    assert got[6].lang_pred in SAID  # letters of no learnt script: by frequency
    assert [got[i].lang_pred for i in (7, 8, 9, 10, 11)] == ["bg", "el", "de", "en", "ru"]
    assert [s.lang for s in got[10].spans] == ["en"]
    assert langid.identify(docs_of(spark, []), model).count() == 0
    expected = [(r.lang_pred, r.score, r.spans) for _, r in sorted(got.items())]
    monkeypatch.setattr(langid, "SCORE_CELLS", 1)
    monkeypatch.setattr(langid, "STEP_CELLS", 1)
    again = langid.identify(docs_of(spark, [(i, t, None) for i, t in enumerate(texts)]).coalesce(1), model).orderBy("doc_id").collect()
    assert [(r.lang_pred, r.score, r.spans) for r in again] == expected


def test_words_and_their_grams():
    texts = [" Don't  x1\n42", None, "", "日本 ab-日本語 \u2028 ß"]
    words = langid.Words(texts)
    assert words.bounds.tolist() == [0, 3, 3, 3, 6]
    assert words.letters.tolist() == [4, 1, 0, 2, 5, 1]
    assert [list(langid.SCRIPTS)[s] for s in words.script] == ["Latin", "Latin", "Han", "Han", "Latin"]
    used = [[int((b[h : h + n] < langid.BUCKETS).sum()) for h, n in zip(heads, words.sizes if len(b) == len(words.flat) else [1] * len(heads), strict=True)] for b, heads in words.buckets()]
    assert used == [[5, 2, 3, 6, 2], [4, 1, 2, 5, 1], [3, 0, 1, 4, 0], [1, 0, 0, 1, 0]]
    same = list(langid.Words(["dont"]).buckets())
    for (a, _), (b, _) in zip(words.buckets(), same, strict=True):
        assert a[: len(b)].tolist() == b.tolist()
    assert list(langid.Words([None, "12"]).buckets()) == []


def test_scripts_of_letters():
    assert [langid.script_of(c) for c in "aßαжא東ア한"] == [list(langid.SCRIPTS).index(s) for s in ("Latin", "Latin", "Greek", "Cyrillic", "Hebrew", "Han", "Kana", "Hangul")]
    assert langid.script_of("\U00010900") == langid.OTHER
