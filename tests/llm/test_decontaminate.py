"""Op 7 against a scan of all windows."""
import random
import re

import numpy as np
import pytest

from quire.llm import decontaminate as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items):
    w = words(text)
    hit, named = [False] * len(w), set()
    for item, t in items:
        v = words(t)
        k = min(13, len(v))
        wins = {tuple(v[i:i + k]) for i in range(len(v) - k + 1)} if v else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i:i + k]) in wins:
                hit[i:i + k] = [True] * k
                named.add(item)
    return len(w), sum(hit), sorted(x for x in named if x is not None)


def cases(seed, n):
    rnd, word = random.Random(seed), lambda: rnd.choice(["the", "Of", "é", "a1", "x", "zz", "On", "in", "b2", "Ön"])
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 2, 5, 12, 13, 14, 30]) if i > 2 else 20))) for i in range(8)]
    items += [(None, "alpha beta gamma"), (20, None), (21, " .. "), (3, "second text of three")]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randrange(0, 5)):
            v = rnd.choice(items)[1] or ""
            if rnd.random() < 0.5:
                ws = v.split(" ")
                v = " ".join(ws[rnd.randrange(len(ws)):])
            parts += [v.upper() if rnd.random() < 0.2 else v, " ".join(f"q{rnd.randrange(99)}" for _ in range(rnd.randrange(60)))]
        docs.append((i, ", ".join(parts)))
    return docs + [(900, None), (901, ""), (902, "alpha-beta... GAMMA"), (903, docs[0][1]), (903, docs[0][1]), (None, items[0][1])], items


@pytest.mark.parametrize("phrase_words,shard", [(1_000_000, 4 << 20), (40, 500)])
def test_against_brute_force(spark, phrase_words, shard):
    docs, items = cases(phrase_words, 120)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as words", "3 as n_hit").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as words")
    rows = D.search(df, bench, phrase_words=phrase_words, shard_bytes=shard).collect()
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in rows), key=key) == sorted(((i, *brute(t, items)) for i, t in docs), key=key)
    for r in rows:
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False)) and sum(s.end - s.start for s in r.spans) == r.n_hit


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text here")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in D.search(docs, none).collect()] == [(3, 0)]
    assert D.search(docs.limit(0), none).collect() == []


def test_index_finds_and_locates_every_phrase():
    rnd = random.Random(4)
    for _ in range(30):
        lens = [rnd.randrange(1, 30) for _ in range(rnd.randrange(1, 6))]
        seq = np.array([rnd.randrange(1, 4) for _ in range(sum(lens))], np.int64)
        starts = np.cumsum([0, *lens[:-1]])
        index = D.FMIndex(seq, starts)
        for k in (1, 2, 4):
            phrases = np.array([[rnd.randrange(1, 5) for _ in range(k)] for _ in range(20)])
            lo, hi = index.ranges(phrases)
            for p, a, b in zip(phrases, lo, hi, strict=True):
                want = [i for s, n in zip(starts, lens, strict=True) for i in range(s, s + n - k + 1) if (seq[i:i + k] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_words_are_hashed_in_parts(monkeypatch):
    """A shard's words don't depend on the parts, and a task keeps no powers for long texts."""
    from quire.llm import tokens as T
    from quire.llm.common import trimmed

    texts = ["One two", "", "three", "a b c " * 20, "", "End"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    whole = T.word_hashes(data, off, T.ALNUM, True)
    for limit in (1, 8, 30, 1000):
        words, bounds = T.word_hashes_in_parts(data, off, T.ALNUM, True, limit)
        assert words.tolist() == whole[0].tolist() and bounds.tolist() == whole[1].tolist()
    assert [len(x) for x in T.word_hashes_in_parts(data[:0], np.zeros(1, np.int64), T.ALNUM, True)] == [0, 1]
    monkeypatch.setattr(T, "SHORT_TABLE", 16)
    monkeypatch.setattr(T, "_POWERS", {})
    step = trimmed(lambda batches: (T.word_hashes(data, off, T.ALNUM, True) for _ in batches))
    assert len(list(step(iter([1])))) == 1 and not T._POWERS
