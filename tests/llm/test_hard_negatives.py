"""Hard negatives against all pairs."""
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import hard_negatives as H
from tests.conftest import SF_SMALL


def plain(rows, scale=256):
    """All pairs in Python integers; anchors are the ids that 4 divides."""
    kept = [(i, int(label), [int(np.floor(scale * float(x))) for x in v]) for i, label, v in rows
            if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for a, label, v in kept:
        if a is None or a % 4:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=False)), i, other == label) for i, other, w in kept]
        for p, p_id in sorted([(s, i) for s, i, same in scored if same and i != a], key=key)[:5]:
            hard = sorted([(s, i) for s, i, same in scored if not same and 80 * p <= 100 * s <= 100 * p], key=key)[:5]
            out += [(a, p_id, rank + 1, i, p, s) for rank, (s, i) in enumerate(hard)]
    return sorted(out, key=str)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(4)
    return sorted(map(tuple, H.hard_negatives(df, F.col("vec_id") % 4 == 0, **options).collect()), key=str)


@pytest.mark.parametrize(("grid", "tile"), [(3, 4096), (3, 7), (100, 7)])
def test_against_all_pairs(spark, monkeypatch, grid, tile):
    """A coarse grid makes ties, equal vectors and zero vectors; small tiles, blocks and many seeds."""
    monkeypatch.setattr(H, "TILE", tile)
    monkeypatch.setattr(H, "SEEDS", 3)
    monkeypatch.setattr(H, "BLOCK", 64)
    monkeypatch.setattr(H, "PAIRS", 10)
    rng = np.random.default_rng(grid)
    rows = [(i % 100, int(rng.integers(0, 3)), (rng.integers(-grid, grid + 1, 4) / grid).tolist()) for i in range(108)]
    rows += [(200, 1, []), (204, 1, [1.0]), (208, 2, [0.0, 0.0, 0.0, 0.0]), (None, 0, [1.0, 0.5, 0.0, 0.0]), (212, None, [1.0]), (216, 1, None),
             (220, 1, [float("nan")]), (224, 1, [None, 1.0]), (228, 0, [float("inf")])]
    want = plain(rows)
    assert mined(spark, rows) == want and len(want) > 50


def test_bounds_hold():
    """The bounds are never crossed, close to equal and opposite directions too."""
    rng = np.random.default_rng(2)
    for scale in (3, 256, H.LIMIT):
        v = rng.integers(-scale, scale + 1, (60, 8))
        v = np.concatenate([v, -v[:10], v[:10] * 0, np.clip(v[:20] + 1, -scale, scale)])
        refs = v[:5].astype(float)
        norm = np.sqrt((v.astype(float) ** 2).sum(1))
        angle = np.arccos(np.clip(v @ (refs / np.sqrt((refs ** 2).sum(1))[:, None]).T / np.maximum(norm, 1e-300)[:, None], -1, 1))
        low, high = H.bounds(angle, norm, angle, norm)
        exact = np.array([[sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for b in v] for a in v], object)
        assert (low <= exact).all() and (exact <= high).all()


def test_filter_saves_scores(spark, monkeypatch):
    """On parted clusters most rows are never scored."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    v = np.repeat(centres, 30, 0) + rng.normal(size=(600, 16)) * 0.05
    block = H.Block(H.with_angles(spark.createDataFrame([(i, 0, [int(x) for x in np.floor(256 * w)]) for i, w in enumerate(v)],
                                                        "vec_id long, label long, v array<int>"), np.floor(256 * centres[:8]).astype(np.int64)).toArrow().columns)
    low, high = H.bounds(block.angles[:1], block.norm[:1], block.angles, block.norm)
    exact = block.v[:1] @ block.v.T
    floor = np.sort(exact[0])[-6]
    assert (high[0] >= floor).mean() < 0.3


def test_empty_and_extra_columns(spark):
    rows = spark.createDataFrame([(0, 1, [1.0], 5)], "vec_id long, label int, embedding array<float>, score int")
    rows = rows.withColumns({"v": F.lit(1), "norm": F.lit(2), "at": F.lit(3), "slot": F.lit(4)})
    assert H.hard_negatives(rows, F.col("vec_id") % 4 == 0).count() == 0
    assert H.hard_negatives(rows.limit(0), F.col("vec_id") % 4 == 0).count() == 0


def test_query_and_oracle(spark):
    got = sorted(map(tuple, H.op13_hard_negatives(spark, SF_SMALL).collect()))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF_SMALL}/embeddings.parquet'")
    assert got == sorted(con.sql(H.ORACLE).fetchall())
