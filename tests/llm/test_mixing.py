"""Op 10 against a sequential version."""
import random
import re

import pytest

from quire.llm import mixing as M


def targets(sizes):
    """Shares by weight, excess above the bound reshared until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in free))
        above = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not above:
            return {**fixed, **{s: level * weight[s] for s in free}}
        fixed |= {s: 3.0 * sizes[s] for s in above}


@pytest.mark.parametrize("bucket", [3, 20_000])
def test_against_sequential(spark, bucket):
    rnd = random.Random(bucket)
    rows = []
    for i in range(400):
        src = rnd.choice(["a"] * 40 + ["b", "é", "Z", "𝒳", "", None, "tiny"])
        rows.append((i, None if rnd.random() < 0.05 else " ".join("w" * rnd.randrange(1, 3) for _ in range(rnd.randrange(0, 30))), src))
    rows += [(7, "again  and\tagain", "a")] * 2 + [(None, "no id", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as rank", "3 as bucket", "4 as key")
    out = M.mix_sources(df, bucket_rows=bucket).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, M.mix_sources(df.repartition(5), bucket_rows=bucket).collect()), key=str)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id, r.size) for r in out if r.doc_id is not None) == sorted((i, count(t)) for i, t, _ in rows if i is not None)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    want = targets(sizes)
    for s in sizes:
        of = [r for r in out if r.source == s]
        assert {r.source_size for r in of} == {sizes[s]} and len({r.target for r in of}) == 1
        assert abs(of[0].target - want[s]) < 1e-6 * max(1, want[s])
        assert abs(sum(r.taken for r in of) - want[s]) <= 0.5 + 1e-6
        assert all(0 <= r.taken <= 3 * r.size for r in of)
        full = of[0].source_size and round(want[s]) // of[0].source_size
        assert sum(full * r.size < r.taken < (full + 1) * r.size for r in of) <= 1  # one document in part
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6


def test_empty_and_wordless(spark):
    schema = "doc_id long, text string, source string"
    assert M.mix_sources(spark.createDataFrame([], schema)).collect() == []
    out = M.mix_sources(spark.createDataFrame([(1, None, "a"), (2, " ", None)], schema)).collect()
    assert [(r.size, r.target, r.taken) for r in out] == [(0, 0.0, 0)] * 2
