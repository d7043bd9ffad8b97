"""Centroid clustering against plain distances to all centroids."""
import hashlib

import duckdb
import numpy as np
import pytest

from quire.llm import centroids as C
from tests.conftest import SF_SMALL


def plain(rows, k, rounds, seed, components, scale):
    """(vec_id, cluster, distance) by all distances in Python integers."""
    kept = []
    for vec_id, vector in rows:
        if vector is not None and len(vector) == components and all(x is not None and np.isfinite(x) for x in vector):
            kept.append((vec_id, [int(np.floor(scale * float(x))) for x in vector]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def find(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        found = [find(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            mine = [v for (_, v), f in zip(kept, found, strict=True) if f == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((i is None, i or 0, *reversed(find(v))) for i, v in kept)), centroids


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("grid", [4, 1000])
def test_against_all_distances(spark, grid):
    """A coarse grid makes many ties of distance and equal vectors."""
    rng = np.random.default_rng(grid)
    rows = [(i % 150, (rng.integers(-grid, grid, 3) / 8).tolist()) for i in range(170)]
    rows += [(None, [0.5, 0.5, 0.5]), (900, None), (901, [1.0]), (902, [1.0, None, 2.0]), (903, [float("nan"), 1.0, 1.0]), (904, [float("inf"), 1.0, 1.0])]
    found, centroids = C.cluster(frame(spark, rows).repartition(5), k=6, rounds=4, seed=3, components=3, scale=8)
    want, means = plain(rows, 6, 4, 3, 3, 8)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in found.collect()) == want
    assert centroids.tolist() == means


def test_orchard_skips_and_is_exact():
    """Well parted centroids: the search measures few, and finds the nearest of all."""
    rng = np.random.default_rng(1)
    centroids = rng.integers(-10000, 10000, (40, 6))
    v = np.concatenate([c + rng.integers(-60, 60, (50, 6)) for c in centroids])
    cluster, distance, measured = C.orchard(v, centroids, C.neighbour_lists(centroids))
    full = ((v[:, None, :] - centroids[None]) ** 2).sum(2)
    assert (cluster == full.argmin(1)).all() and (distance == full.min(1)).all()
    assert measured < 0.7 * full.size


def test_orchard_stops_strictly_beyond():
    """A centroid at exactly twice the distance can tie and has the smaller number."""
    centroids = np.array([[9, 9], [4, 0], [0, 0]])  # the vector (2, 0) is as far from 1 as from 2
    lists = C.neighbour_lists(centroids)
    cluster, distance, _ = C.orchard(np.array([[2, 0]]), centroids, lists)
    assert (cluster[0], distance[0]) == (1, 4)


def test_few_and_none(spark):
    two = frame(spark, [(1, [0.0, 0.0]), (2, [1.0, 1.0])])
    found, centroids = C.cluster(two, k=8, rounds=3, components=2)
    assert len(centroids) == 2 and sorted(r.distance for r in found.collect()) == [0, 0]
    found, centroids = C.cluster(two.limit(0), components=2)
    assert found.count() == 0 and centroids.shape == (0, 2)
    found, _ = C.cluster(frame(spark, [(1, [3e38, -3e38])]), components=2)
    assert found.collect()[0].distance == 0


def test_extra_columns(spark):
    rows = frame(spark, [(1, [0.0, 0.0]), (2, [1.0, 1.0])]).selectExpr("*", "1 as v", "2 as cluster", "3 as distance")
    found, _ = C.cluster(rows, k=1, components=2)
    assert found.columns == ["vec_id", "cluster", "distance"] and found.count() == 2


def test_query_and_oracle(spark):
    got = sorted(map(tuple, C.op12_centroid_clusters(spark, SF_SMALL).collect()))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF_SMALL}/embeddings.parquet'")
    assert got == sorted(con.sql(C.ORACLE).fetchall()) and len(got) > 10
