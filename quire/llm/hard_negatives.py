"""Hard-negative mining with angular triangle filtering, in exact integer scores.

Every row that takes part is written once with its integer components, its norm
and its angles to ``REFERENCES`` reference directions (rows with the smallest
hashes).  For an anchor and a row with angles s and t to one direction, the angle
between the two lies in [|s - t|, min(s + t, 2 pi - s - t)]; the narrowest
interval over all directions, its cosines times both norms, widened for rounding,
bounds the integer score from both sides.  Only rows whose bounds overlap a
window that the anchor still looks for get the integer score:

* positives: same label, at least the anchor's fifth best score so far;
* negatives: another label, for each positive a window from 80 % of its score
  (or the fifth best so far, if that is higher) up to its score.

The anchors are worked off in tiles of at most ``TILE`` rows, which alone are
sent to the tasks; each tile meets all rows in blocks, where they lie, without a
shuffle.  A pass over one row of ``SEEDS`` by hash goes before each whole pass:
its fifth best scores are lower bounds for the whole table, so that a task of
the whole pass returns few rows, and the filter starts with narrow windows.  The
bounds only save time: the result is that of all pairs.  The work is rows times
anchors and so grows with the square of the table, as the task states it; the
number of passes over the table is the number of tiles.

Rows with a null label or vector, or with any null or non-finite component, take
no part.  A null id is no anchor, comes last among ties and may be returned.
Rows with one id are never each other's positives; repeated rows count each, and
a repeated anchor is answered each time.  Missing components of a shorter vector
count as 0; an empty vector scores 0.  Scaled components beyond +-2**26 are that
bound, so that a score fits a long.  Anchors without a positive, and positives
without a negative, give no rows; an empty table gives none.  Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import scratch_path

from .common import materialize, read_table

SCALE, TOP = 256, 5
REFERENCES = 16
#: anchors that are sent to the tasks at a time
TILE = 4096
#: of so many rows one is looked at first
SEEDS = 32
#: pairs whose bounds, and pairs whose integer scores, are computed at a time
BLOCK, PAIRS = 1 << 19, 1 << 15
LIMIT = 1 << 26
NO_ID = (1 << 63) - 1
LEAST = -(1 << 62)
#: widening of an angle, and of a score as a share of both norms
ANGLE, SHARE = 1e-6, 1e-9


def participants(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int, label: Column) -> DataFrame:
    """(vec_id, label, v array<int>) of the rows that take part."""
    v = F.col(vec_col)
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(v, lambda x: F.floor(F.greatest(F.least(x.cast("double") * float(scale), F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))
    return vectors.where(F.col(label_col).isNotNull() & F.coalesce(usable, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), scaled.alias("v"))


def matrix(vectors: pa.Array) -> np.ndarray:
    """A list column as a matrix; missing components are 0."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = np.diff(np.asarray(vectors.offsets))
    out = np.zeros((len(vectors), max(int(size.max(initial=0)), 1)), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = np.asarray(vectors.flatten())
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def with_angles(rows: DataFrame, references: np.ndarray) -> DataFrame:
    """The rows with their norm and their angles to the reference directions."""
    unit = references / np.maximum(np.sqrt((references.astype(float) ** 2).sum(1)), 1e-300)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            v, u = same_width(matrix(batch.column(2)).astype(float), unit)
            norm = np.sqrt((v ** 2).sum(1))
            angle = np.arccos(np.clip((v @ u.T) / np.maximum(norm, 1e-300)[:, None], -1, 1))
            ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * len(u))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(norm), pa.ListArray.from_arrays(ends, pa.array(angle.ravel()))],
                                             ["vec_id", "label", "v", "norm", "angles"])

    return rows.select("vec_id", "label", "v").mapInArrow(run, "vec_id long, label long, v array<int>, norm double, angles array<double>")


class Block:
    """Rows of a batch, or the anchors of a tile, as arrays."""

    def __init__(self, columns):
        ids, labels, vectors, norms, angles = columns
        self.vec_id = np.asarray(ids.fill_null(NO_ID)).astype(np.int64)
        self.label = np.asarray(labels).astype(np.int64)
        self.v = matrix(vectors)
        self.norm = np.asarray(norms)
        self.angles = np.asarray((angles.combine_chunks() if isinstance(angles, pa.ChunkedArray) else angles).flatten()).reshape(len(self.norm), -1)

    def __len__(self) -> int:
        return len(self.norm)


def bounds(a_angles: np.ndarray, a_norm: np.ndarray, r_angles: np.ndarray, r_norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest integer score of each anchor and row, by the triangle
    inequality of angles, safe against rounding."""
    low = np.zeros((len(a_norm), len(r_norm)))
    high = np.full_like(low, np.pi)
    for j in range(a_angles.shape[1]):
        s, t = a_angles[:, j, None], r_angles[None, :, j]
        np.maximum(low, np.abs(s - t), out=low)
        both = s + t
        np.minimum(high, np.minimum(both, 2 * np.pi - both), out=high)
    product = a_norm[:, None] * r_norm
    spare = product * SHARE + 1
    return (product * np.cos(np.minimum(high + ANGLE, np.pi)) - spare, product * np.cos(np.maximum(low - ANGLE, 0)) + spare)


def scores(a: np.ndarray, r: np.ndarray, ai: np.ndarray, ri: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs."""
    out = np.empty(len(ai), np.int64)
    for lo in range(0, len(ai), PAIRS):
        out[lo:lo + PAIRS] = np.einsum("ij,ij->i", a[ai[lo:lo + PAIRS]], r[ri[lo:lo + PAIRS]])
    return out


class Best:
    """The first ``TOP`` (score, id) of each slot."""

    def __init__(self, slots: int):
        self.score = np.full((slots, TOP), LEAST, np.int64)
        self.vec_id = np.full((slots, TOP), NO_ID, np.int64)
        self.full = np.zeros((slots, TOP), bool)

    def add(self, slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        used = np.unique(slot)
        old = np.repeat(used, TOP)[self.full[used].ravel()]
        slot = np.concatenate([old, slot])
        score = np.concatenate([self.score[used][self.full[used]], score])
        vec_id = np.concatenate([self.vec_id[used][self.full[used]], vec_id])
        order = np.lexsort((vec_id, -score, slot))
        slot, score, vec_id = slot[order], score[order], vec_id[order]
        first = np.concatenate([[True], slot[1:] != slot[:-1]])
        rank = np.arange(len(slot)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        keep = rank < TOP
        slot, rank = slot[keep], rank[keep]
        self.score[slot, rank], self.vec_id[slot, rank], self.full[slot, rank] = score[keep], vec_id[keep], True

    def floor(self) -> np.ndarray:
        """A row below this score can't be among the first."""
        return np.where(self.full[:, -1], self.score[:, -1], LEAST)


def search(rows: DataFrame, tile, low: np.ndarray, high: np.ndarray, same: bool) -> DataFrame:
    """(slot, score, vec_id): by task the first ``TOP`` rows of each slot.

    ``low`` and ``high`` are the windows, (anchors, slots of an anchor); ``same``
    says whether a row must have the anchor's label (and another id) or another."""
    sent = rows.sparkSession.sparkContext.broadcast((*tile, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        vec_id, label, v, norm, angles, low, high = sent.value
        slots = low.shape[1]
        best = Best(low.size)
        for batch in batches:
            if not batch.num_rows:
                continue
            r = Block(batch.columns)
            a_v, r_v = same_width(v, r.v)
            step = max(1, BLOCK // len(r))
            for lo in range(0, len(norm), step):
                part = slice(lo, lo + step)
                least, most = bounds(angles[part], norm[part], r.angles, r.norm)
                alike = label[part, None] == r.label
                wanted = alike & (vec_id[part, None] != r.vec_id) if same else ~alike
                floor = np.maximum(low[part], best.floor().reshape(-1, slots)[part])
                hit = np.zeros_like(wanted)
                for j in range(slots):
                    hit |= (most >= floor[:, j, None]) & (least <= high[part, j, None])
                ai, ri = np.nonzero(wanted & hit)
                if not len(ai):
                    continue
                score = scores(a_v, r_v, ai + lo, ri)
                for j in range(slots):
                    inside = (score >= floor[ai, j]) & (score <= high[ai + lo, j])
                    if inside.any():
                        best.add((ai[inside] + lo) * slots + j, score[inside], r.vec_id[ri[inside]])
        slot, rank = np.nonzero(best.full)
        found = best.vec_id[slot, rank]
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(best.score[slot, rank]), pa.array(found, mask=found == NO_ID)],
                                         ["slot", "score", "vec_id"])

    return rows.mapInArrow(run, "slot int, score long, vec_id long")


def first_of(found: DataFrame) -> DataFrame:
    """The first ``TOP`` rows of each slot over all tasks, with their rank."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def raised(found: DataFrame, low: np.ndarray) -> np.ndarray:
    """Windows from the ``TOP``-th best score that some rows have shown."""
    low = low.copy()
    for r in first_of(found).where(F.col("rank") == TOP).select("slot", "score").collect():
        at = divmod(r["slot"], low.shape[1])
        low[at] = max(low[at], r["score"])
    return low


def tiles(anchors: DataFrame, size: int) -> list[tuple[int, int]]:
    """Ranges [from, to) of the column ``at`` with at most ``size`` anchors each."""
    counts = sorted((r["p"], r["count"]) for r in anchors.groupBy(F.shiftright("at", 33).alias("p")).count().collect())
    out, start, room = [], None, size
    for p, n in counts:
        done = 0
        while done < n:
            start = (p << 33) + done if start is None else start
            take = min(room, n - done)
            done, room = done + take, room - take
            if not room:
                out.append((start, (p << 33) + done))
                start, room = None, size
    if start is not None:
        out.append((start, 1 << 62))
    return out


def hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                   label: Column | None = None, scale: int = SCALE, percent: tuple[int, int] = (80, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor``: a condition on ``vec_id``; ``label``: what counts as the label, if
    not the column itself; ``percent``: a negative's score as shares of the
    positive's."""
    spark = vectors.sparkSession
    own = F.col(label_col) if label is None else label
    some = materialize(participants(vectors, id_col, vec_col, label_col, scale, own), "participants")
    sample = some.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(REFERENCES).select("v").toArrow()
    references = matrix(sample.column(0)) if sample.num_rows else np.zeros((1, 1), np.int64)
    rows = materialize(with_angles(some, references), "angles")
    seeds = rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(SEEDS)) == 0)
    anchors = materialize(rows.where(anchor).withColumn("at", F.monotonically_increasing_id()), "anchors")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    paths = []
    for lo, hi in tiles(anchors, TILE):
        block = Block(anchors.where((F.col("at") >= lo) & (F.col("at") < hi)).orderBy("at").drop("at").toArrow().columns)
        tile = (block.vec_id, block.label, block.v, block.norm, block.angles)
        low, high = np.full((len(block), 1), LEAST), np.full((len(block), 1), -LEAST)
        low = raised(search(seeds, tile, low, high, same=True), low)
        positives = first_of(search(rows, tile, low, high, same=True)).select("slot", "rank", "score", "vec_id").collect()
        low, high = np.full((len(block), TOP), -LEAST), np.full((len(block), TOP), LEAST)  # no window
        about = []
        for slot, rank, score, vec_id in positives:
            low[slot, rank - 1], high[slot, rank - 1] = -(-percent[0] * score // 100), percent[1] * score // 100
            about.append((slot * TOP + rank - 1, int(block.vec_id[slot]), vec_id, score))
        if not about:
            continue
        low = raised(search(seeds, tile, low, high, same=False), low)
        about = spark.createDataFrame(about, "slot int, anchor_id long, positive_id long, positive_score long")
        found = first_of(search(rows, tile, low, high, same=False)).select("slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        paths.append(scratch_path(spark, "negatives"))
        found.join(F.broadcast(about), "slot").select(*[c.split(" ")[0] for c in schema.split(", ")]).write.parquet(paths[-1])
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table, F.col("vec_id") % 100 == 0, label=label)


ORACLE = f"""
with r as materialized (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as double)) as v
  from embeddings where label is not null and embedding is not null
   and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as materialized (
  select a.vec_id as anchor_id, b.vec_id as vec_id, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score
  from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {TOP})
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as int) as rank,
       vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify rank <= {TOP}
"""
