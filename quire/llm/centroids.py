"""Centroid clustering with Orchard's search, in exact integers.

Vectors become integers once and are written to the shared folder; every round
reads them, assigns each to its nearest centroid and adds up counts and
components by centroid.  The sums leave a task as at most (components + 1) rows
a centroid and are added by Spark; the driver holds the centroids only, which
the parameters bound.

The search: each centroid has the list of the others, nearest first.  A vector
starts at centroid 0 and walks the list of its present centroid; when one is
closer (or as close with a smaller number) it jumps to that one's list and
starts over there.  Centroids it has measured are marked and not measured again.
It stops when the list is done, or at a centroid strictly beyond twice the
vector's distance to its present centroid: by the triangle inequality that one
and all behind it are farther.  Squared distances are compared (4 times the
square), and a centroid at exactly twice the distance is still measured, so that
ties go to the smaller number.  The vectors of a batch walk at the same time.

Vectors with another number of components, a null, a NaN or an infinity take no
part.  Scaled components beyond +-2**27 are that bound, so that a squared
distance fits a long.  Vectors of equal hash (repeated rows, one id used twice)
start as centroids in the order of their components; null ids come last there
and are clustered and returned like others.  Of equal centroids the first gets
the vectors, an empty one stays where it is.  With fewer vectors than centroids
each starts one; an empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table

COMPONENTS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, 3
LIMIT = 1 << 27


def integers(vectors: DataFrame, id_col: str, vec_col: str, components: int, scale: int) -> DataFrame:
    """(vec_id, v array<int>) of the vectors that take part."""
    v = F.col(vec_col)
    usable = (F.size(v) == components) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(v, lambda x: F.floor(F.greatest(F.least(x.cast("double") * float(scale), F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.coalesce(usable, F.lit(False)), scaled).alias("v")).where("v is not null")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(key.asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def neighbour_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By centroid: the others, nearest first, and their squared distances."""
    k = len(centroids)
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    order = np.array([[j for j in np.argsort(apart[i], kind="stable") if j != i] for i in range(k)], np.int64).reshape(k, k - 1)
    return order, np.take_along_axis(apart, order, 1)


def orchard(vectors: np.ndarray, centroids: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance) of each row, and how many distances
    were computed."""
    order, apart = lists
    n, k = len(vectors), len(centroids)
    present = np.zeros(n, np.int64)
    distance = ((vectors - centroids[0]) ** 2).sum(1)
    at = np.zeros(n, np.int64)
    seen = np.zeros((n, k), bool)
    seen[:, 0] = True
    measured = n
    walking = np.arange(n if k > 1 else 0)
    while len(walking):
        here, place = present[walking], at[walking]
        inside = apart[here, place] <= 4 * distance[walking]
        walking, here, place = walking[inside], here[inside], place[inside]
        other = order[here, place]
        at[walking] += 1
        fresh = ~seen[walking, other]
        rows, other = walking[fresh], other[fresh]
        seen[rows, other] = True
        own = ((vectors[rows] - centroids[other]) ** 2).sum(1)
        measured += len(rows)
        closer = (own < distance[rows]) | (own == distance[rows]) & (other < present[rows])
        rows, other, own = rows[closer], other[closer], own[closer]
        present[rows], distance[rows], at[rows] = other, own, 0
        walking = walking[at[walking] < k - 1]
    return present, distance, measured


def _matrix(batch: pa.RecordBatch, components: int) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index("v")).flatten()).reshape(-1, components).astype(np.int64)


def sums(vectors: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By centroid: how many vectors are nearest to it, and their sums."""
    k, components = centroids.shape
    lists = neighbour_lists(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        total = np.zeros((k, components + 1), np.int64)
        for batch in batches:
            v = _matrix(batch, components)
            cluster, _, _ = orchard(v, centroids, lists)
            for c in np.unique(cluster):
                mine = v[cluster == c]
                total[c, :components] += mine.sum(0)
                total[c, components] += len(mine)
        used = np.flatnonzero(total[:, components])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(used, components + 1).astype(np.int32)), pa.array(np.tile(np.arange(components + 1, dtype=np.int32), len(used))),
            pa.array(total[used].ravel())], ["cluster", "component", "value"])

    rows = vectors.mapInArrow(run, "cluster int, component int, value long").groupBy("cluster", "component").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((k, components + 1), np.int64)
    for r in rows:
        total[r["cluster"], r["component"]] = r["value"]
    return total[:, components], total[:, :components]


def nearest(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance)."""
    lists, components = neighbour_lists(centroids), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            cluster, distance, _ = orchard(_matrix(batch, components), centroids, lists)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("vec_id")), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                                             ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, components: int = COMPONENTS, scale: int = SCALE,
            id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every vector that takes part, centroids)."""
    v = materialize(integers(vectors, id_col, vec_col, components, scale), "vectors")
    centroids = first_centroids(v, k, seed)
    if not len(centroids):
        return v.selectExpr("vec_id", "cast(null as int) as cluster", "cast(null as long) as distance"), centroids.reshape(0, components)
    for _ in range(rounds):
        count, total = sums(v, centroids)
        moved = np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], centroids)
        if (moved == centroids).all():  # all later rounds give the same
            break
        centroids = moved
    return nearest(v, centroids), centroids


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    found = materialize(found, "clusters")
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The rounds written out, each with plain distances to all centroids."""
    kept = (f"select vec_id, row_number() over () as r, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v from embeddings "
            f"where len(embedding) = {COMPONENTS} and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0")
    parts = [f"kept as materialized ({kept})",
             f"c0 as materialized (select cast(row_number() over (order by sha256('{SEED}:' || vec_id), v) - 1 as int) as c, v from kept "
             f"qualify c < {CENTROIDS})"]
    near = ("select r, arg_min(c, (d, c)) as c, min(d) as d from (select r, c, list_sum(list_transform(list_zip(kept.v, {0}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d "
            "from kept cross join {0}) group by r")
    for i in range(ROUNDS):
        parts.append(f"a{i} as materialized ({near.format(f'c{i}')})")
        parts.append(f"s{i} as materialized (select c, list(cast(case when s % n < 0 then (s - (s % n)) // n - 1 else (s - s % n) // n end as bigint) order by i) as v from "
                     f"(select c, i, sum(x) as s, count(*) as n from (select c, unnest(v) as x, unnest(range({COMPONENTS})) as i from a{i} join kept using (r)) group by c, i) group by c)")
        parts.append(f"c{i + 1} as materialized (select c, coalesce(s{i}.v, c{i}.v) as v from c{i} left join s{i} using (c))")
    parts.append(f"final as materialized ({near.format(f'c{ROUNDS}')})")
    return (f"with {', '.join(parts)} select vec_id, cast(final.c as int) as cluster, cast(d as bigint) as distance, "
            "cast(sum(d) over (partition by final.c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, "
            f"sha256(array_to_string(c{ROUNDS}.v, ',')) as centroid_sha256 from final join kept using (r) join c{ROUNDS} on final.c = c{ROUNDS}.c")


ORACLE = _oracle()
