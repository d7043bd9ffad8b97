"""Op 8: base columns against brute force, the filter and the model against exact counts."""
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import lm_scoring as S
from quire.llm import tokens as T

from ..conftest import SF_MID, SF_SMALL


def brute(rows):
    toks = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    c = Counter(w for ws, h in zip(toks, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
            for (i, _), ws, h in zip(rows, toks, held, strict=True)]


def check(df, rows):
    key = lambda r: (str(r[0]), r[2], r[5])
    got = sorted((tuple(r)[:6] for r in df.collect()), key=key)
    for a, b in zip(got, sorted(brute(rows), key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5]))


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    check(S.op8_lm_scores(spark, SF_SMALL), rows)


@pytest.mark.parametrize("head,filter_bytes,shard", [(1 << 20, 1 << 20, 1 << 20), (30, 40_000, 4000), (0, 1, 2000)])
def test_tail_and_passes(spark, head, filter_bytes, shard):
    rnd = random.Random(head)
    rows = [(i, " ".join(f"W{int(rnd.paretovariate(0.7)) % 5000}" for _ in range(rnd.randrange(0, 80)))) for i in range(300)]
    rows += [(900, None), (901, ""), (None, "no id"), (11, "same row"), (11, "same row"), (902, "é " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "2 as held_out", "3 as n", "4 as word").repartition(3)
    out = S.score_documents(df, head, filter_bytes, shard)
    check(out, rows)
    assert all(r.score < 0 for r in out.collect())


def test_passes_agree_with_one_pass(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(60)
    one = {r.doc_id: r.score for r in S.score_documents(df, shard_size=4000).collect()}
    many = {r.doc_id: r.score for r in S.score_documents(df, filter_bytes=20_000, shard_size=4000).collect()}
    assert len(one) == 60 and all(abs(one[i] - many[i]) < 1e-9 * abs(one[i]) for i in one)


def test_empty_and_no_training(spark):
    schema = "doc_id long, text string"
    assert S.score_documents(spark.createDataFrame([], schema)).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = S.score_documents(spark.createDataFrame([(held, "a b")], schema)).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0)


def test_held_out_texts_of_the_corpus_are_likelier_than_shuffled_ones(spark):
    """The bigram model beats the unigram base on held-out text."""
    rows = S.op8_lm_scores(spark, SF_MID).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert rows.s > rows.b


def test_filter_levels():
    rnd = np.random.default_rng(1)
    key = np.unique(rnd.integers(0, 1 << S.KEY_BITS, 20_000, dtype=np.uint64))
    n = (rnd.pareto(0.8, len(key)) + 1).astype(np.int64) % 100_000 + 1
    q = S.levels(n)
    bits = -(-int(q.sum() * 6 / math.log(2)) // 64) * 64
    f = S.Filter(0, bits, S.fill(key, n, bits))
    got = f.level(key)
    assert (got >= q).all() and (got > q).mean() < 0.04
    absent = np.setdiff1d(rnd.integers(0, 1 << S.KEY_BITS, 50_000, dtype=np.uint64), key)
    assert (f.level(absent) > 0).mean() < 0.03


def test_blobs_keep_keys_and_counts(spark):
    rows = [(1, "a b a b a c"), (2, "a b")]
    head = spark.sparkContext.broadcast(S.Head(np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0, 0.0))
    got = Counter()
    for r in S.shard_grams(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), head, 3).collect():
        for k, n in zip(*S.read_blob(r.blob), strict=True):
            got[(r.shard << S.KEY_BITS) | int(k)] += int(n)
    want = Counter()
    for _, t in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        w, b = S.token_hashes(data, np.array([0, len(data)]))
        v = S.contexts(w, b)
        want.update(S.shard_keys(v, w, 3).tolist())
        want.update(S.shard_keys(v, np.full(len(v), S.ALONE), 3).tolist())
    assert got == want and T.U64 is np.uint64
