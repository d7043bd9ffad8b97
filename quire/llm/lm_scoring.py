"""Language-model scores from a log-frequency Bloom filter.

Training texts are those whose ``crc32(doc_id as text) mod 10`` is not 0.  The
filter holds the quantised count of every training bigram: a gram with
count n is inserted once for each level 1 .. 1 + floor(log2 n), and its level is
read back by probing levels upwards until one is absent.  A level read is never
too low; it is too high with probability ``ERROR`` a step.

1. Words are counted exactly (partial counts in the tasks, one shuffle).  The
   most frequent ones, at most ``HEAD_WORDS``, form the head table that goes to
   all tasks (a fixed bound); all other words are counted by a shuffle join.
2. Bigrams are counted by shard; the shard follows from the context word.  Each
   shard's task adds up its grams and fills its own piece of the filter.  A
   piece's size comes from a sample by hash of the grams.
3. The pieces go to the tasks, as many at a time as ``FILTER_BYTES`` allow; a
   larger filter is probed in several passes whose partial sums are added.

``P(w | v) = (q(v, w) + BETA * P(w)) / (max(c(v), q(v, w)) + BETA)`` with the
quantised count q, the context count c (exact in the head, else quantised) and
add-0.1 smoothed word probabilities P(w) (a word outside the head has the
average count of those).  A text begins after a start symbol and ends with an
end token.

Nulls: a null text is empty (one end token); a null id counts as empty text in
the split.  Repeated rows are scored, and counted in training, each for itself.
An empty table gives no rows; without training texts N and V are 0, every word
is unknown and the base probability is defined as 1/(V+1).  Extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens as T
from .common import materialize, read_table, text_blocks

HEAD_WORDS = 1 << 20
#: filter bytes that are sent to the tasks at a time
FILTER_BYTES = 256 << 20
#: chance that a level is read one too high
ERROR = 1 / 64
PROBES = 6
BETA = 2.0
#: grams gathered by a task before it sends them
CHUNK = 1 << 22
#: one gram in so many, by its hash, is counted to size the filter
SAMPLE = 1024
SHARD_GRAMS = 1 << 20
START, END, ALONE = (T.U64(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x9B05688C2B3E6C1F))
KEY_BITS = 40


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def token_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (words, then END) and bounds by row."""
    words, bounds = T.word_hashes(data, off, T.NONSPACE, lower=True)
    at = bounds[1:]
    return np.insert(words, at, END), bounds + np.arange(len(bounds))


def contexts(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The token before each token, START at the start of a row."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[bounds[:-1]] = START
    return out


def gram_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return T.mix(v * T.U64(T.MULT) + w)


def shard_keys(v: np.ndarray, w: np.ndarray, bits: int) -> np.ndarray:
    """Shard (by the context, ``bits`` wide) and key of each gram in one number."""
    shard = (T.mix(v ^ T.U64(0x6A09E667F3BCC908)) >> T.U64(64 - bits)) if bits else np.zeros(len(v), T.U64)
    return (shard << T.U64(KEY_BITS)) | (gram_hash(v, w) >> T.U64(64 - KEY_BITS))


def levels(n: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)


def level_value(q: np.ndarray) -> np.ndarray:
    """The middle of the counts with level q; 0 at level 0."""
    return np.where(q > 0, 1.5 * 2.0 ** (q - 1) - 0.5, 0.0)


def _positions(key: np.ndarray, level: int, probe: int, bits: int) -> np.ndarray:
    h = T.mix(key + T.U64(((level << 8) + 1) * T.MULT & T.MASK))
    step = (h >> T.U64(32)) | T.U64(1)
    return ((h & T.U64(0xFFFFFFFF)) + T.U64(probe) * step) % T.U64(bits)


def fill(key: np.ndarray, n: np.ndarray, bits: int) -> np.ndarray:
    """Filter bytes of one shard."""
    flags, q = np.zeros(bits, np.uint8), levels(n)
    for level in range(1, int(q.max(initial=0)) + 1):
        key = key[q >= level]
        q = q[q >= level]
        for probe in range(PROBES):
            flags[_positions(key, level, probe, bits)] = 1
    return np.packbits(flags, bitorder="little")


@dataclass
class Filter:
    """Pieces of the shards low .. low + len - 1, one after the other."""

    low: int
    bits: int  # of each piece
    data: np.ndarray

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Level of grams (all of shards that are here); 0: absent."""
        out = np.zeros(len(keys), np.int64)
        base = (keys >> T.U64(KEY_BITS)).astype(np.int64) - self.low
        key = keys & T.U64((1 << KEY_BITS) - 1)
        live, level = np.arange(len(keys)), 1
        while len(live):
            for probe in range(PROBES):
                pos = _positions(key[live], level, probe, self.bits).astype(np.int64) + base[live] * self.bits
                live = live[(self.data[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1 == 1]
            out[live] = level
            level += 1
        return out


@dataclass
class Head:
    """Exact counts of the most frequent words, and what holds for the others."""

    words: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int
    rest: float  # average count of a word outside

    def lookup(self, w: np.ndarray) -> np.ndarray:
        """Count of each word, 0 outside the head."""
        if not len(self.words):
            return np.zeros(len(w), np.int64)
        pos = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
        return np.where(self.words[pos] == w, self.counts[pos], 0)

    def log_prob(self, count):
        return np.log10((count + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


# --- counting ---------------------------------------------------------------

def count_words(train: DataFrame) -> DataFrame:
    """(kind, key, n): kind 0 words, kind 1 the sampled bigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        held: list[list[np.ndarray]] = [[], []]

        def flush():
            for kind in (0, 1):
                key, n = np.unique(np.concatenate(held[kind]), return_counts=True)
                held[kind] = []
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind)), pa.array(key.view(np.int64)), pa.array(n)], ["kind", "key", "n"])

        size = 0
        for batch in batches:
            for _, _, data, off in text_blocks(batch, "text"):
                w, bounds = token_hashes(data, off)
                g = gram_hash(contexts(w, bounds), w)
                held[0].append(w)
                held[1].append(g[g < T.U64((1 << 64) // SAMPLE)])
                size += len(w)
                if size >= CHUNK:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    return train.select("text").mapInArrow(run, "kind long, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def learn_head(counts: DataFrame, head_words: int) -> Head:
    """The head: whole classes of counts, from the most frequent downwards."""
    words = counts.where("kind = 0").withColumn("bin", F.floor(F.log2("n") * 8))
    bins = words.groupBy("bin").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).orderBy(F.desc("bin")).collect()
    total, distinct = sum(b.n for b in bins), sum(b.v for b in bins)
    size, tokens, least = 0, 0, None
    for b in bins:
        if size + b.v > head_words:
            break
        size, tokens, least = size + b.v, tokens + b.n, b.bin
    if least is None:
        key, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    else:
        t = words.where(F.col("bin") >= least).select("key", "n").toArrow()
        key, n = np.asarray(t["key"]).view(np.uint64), np.asarray(t["n"])
    order = np.argsort(key)
    rest = (total - tokens) / (distinct - size) if distinct > size else 0.0
    return Head(key[order], n[order], int(total), int(distinct), rest)


def filter_shape(counts: DataFrame, shard_grams: int) -> tuple[int, int]:
    """(width of the shard number, filter bits a shard) from the sampled grams."""
    r = counts.where("kind = 1").agg(F.count(F.lit(1)), F.sum(F.floor(F.log2("n")) + 1)).first()
    grams, inserted = (r[0] + 16) * SAMPLE, ((r[1] or 0) + 16) * SAMPLE
    bits = max(0, math.ceil(math.log2(grams / shard_grams)))
    per = 1.25 * inserted * math.log2(1 / ERROR) / math.log(2) / 2 ** bits  # a quarter more for uneven shards and rare contexts
    return bits, max(4096, -(-int(per) // 64) * 64)


def shard_grams(train: DataFrame, head, bits: int) -> DataFrame:
    """(shard, blob): the grams of a chunk that fall into a shard, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        held, size = [], 0

        def flush():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            shard = (key >> T.U64(KEY_BITS)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            low = key.view(np.uint8).reshape(-1, 8)[:, :KEY_BITS // 8]
            n4 = n.astype("<u4")
            blobs = []
            for a, b in zip(first, np.append(first[1:], len(key)), strict=True):
                many = np.flatnonzero(n[a:b] > 1).astype("<u4")  # most grams occur once
                blobs.append(np.uint32(b - a).tobytes() + low[a:b].tobytes() + many.tobytes() + n4[a:b][many].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(shard[first]), pa.array(blobs, pa.binary())], ["shard", "blob"])

        for batch in batches:
            for _, _, data, off in text_blocks(batch, "text"):
                w, bounds = token_hashes(data, off)
                v = contexts(w, bounds)
                held.append(shard_keys(v, w, bits))
                rare = v[head.value.lookup(v) == 0]
                held.append(shard_keys(rare, np.full(len(rare), ALONE), bits))
                size += len(w) + len(rare)
                if size >= CHUNK:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return train.select("text").mapInArrow(run, "shard long, blob binary")


def read_blob(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, width = int(np.frombuffer(blob, "<u4", 1)[0]), KEY_BITS // 8
    key = np.zeros((size, 8), np.uint8)
    key[:, :width] = np.frombuffer(blob, np.uint8, size * width, 4).reshape(size, width)
    rest = np.frombuffer(blob, np.uint8, -1, 4 + size * width).view("<u4") if len(blob) > 4 + size * width else np.zeros(0, "<u4")
    n = np.ones(size, np.int64)
    n[rest[:len(rest) // 2]] = rest[len(rest) // 2:]
    return key.reshape(-1).view(np.uint64), n


def build_filter(grams: DataFrame, shard_bits: int) -> DataFrame:
    """(shard, piece): the filter bytes of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        now, held = None, []

        def flush():
            key, n = (np.concatenate(x) for x in zip(*held, strict=True))
            key, inverse = np.unique(key, return_inverse=True)
            n = np.bincount(inverse, n).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([fill(key, n, shard_bits).tobytes()], pa.binary())], ["shard", "piece"])

        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard != now and held:
                    yield flush()
                    held = []
                now = shard
                held.append(read_blob(blob.as_py()))
        if held:
            yield flush()

    return grams.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "shard long, piece binary")


# --- scoring ----------------------------------------------------------------

def _log_probs(w: np.ndarray, v: np.ndarray, head: Head, part: Filter, bits: int) -> np.ndarray:
    """log10 P(w | v) of tokens whose shard is in ``part``."""
    q = level_value(part.level(shard_keys(v, w, bits)))
    c = head.lookup(v).astype(float)
    rare = np.flatnonzero(c == 0)
    c[rare] = level_value(part.level(shard_keys(v[rare], np.full(len(rare), ALONE), bits)))
    n = head.lookup(w)
    lower = 10.0 ** head.log_prob(np.where(n > 0, n, head.rest)) if head.total else np.full(len(w), 1.0)
    return np.log10((q + BETA * lower) / (np.maximum(c, q) + BETA))


def _score(docs: DataFrame, head, part, bits: int) -> DataFrame:
    """Per row: ids, token counts, the base sums of the head words, the other
    words with their counts, and the score of the shards in ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        from pyspark import TaskContext

        h, p = head.value, part.value
        high = p.low + len(p.data) * 8 // p.bits
        row = TaskContext.get().partitionId() << 36
        word_type = pa.list_(pa.struct([("word", pa.int64()), ("tf", pa.int64())]))
        for batch in batches:
            for lo, hi, data, off in text_blocks(batch, "text"):
                w, bounds = token_hashes(data, off)
                v = contexts(w, bounds)
                of = np.repeat(np.arange(hi - lo), np.diff(bounds))
                n = h.lookup(w)
                known = n > 0
                add = lambda x: np.bincount(of, x, minlength=hi - lo)  # noqa: E731, B023
                base = add(np.where(known, h.log_prob(np.maximum(n, 1)) if h.total else 0.0, 0.0))
                shard = (shard_keys(v, w, bits) >> T.U64(KEY_BITS)).astype(np.int64)
                here = np.flatnonzero((shard >= p.low) & (shard < high))
                logp = np.zeros(len(w))
                logp[here] = _log_probs(w[here], v[here], h, p, bits)
                out = np.flatnonzero(~known)
                starts = np.searchsorted(out, bounds)
                rest = []
                for a, b in zip(starts[:-1], starts[1:], strict=True):
                    word, tf = np.unique(w[out[a:b]], return_counts=True)
                    rest.append((word.view(np.int64), tf))
                sizes = np.cumsum([0] + [len(x) for x, _ in rest])
                flat = pa.StructArray.from_arrays([pa.array(np.concatenate([x for x, _ in rest]).astype(np.int64)),
                                                   pa.array(np.concatenate([x for _, x in rest]).astype(np.int64))], ["word", "tf"])
                total = np.concatenate([np.zeros(1, T.U64), np.cumsum(gram_hash(v, w), dtype=T.U64)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + lo + np.arange(hi - lo)), batch.column(batch.schema.get_field_index("doc_id")).slice(lo, hi - lo),
                     batch.column(batch.schema.get_field_index("held_out")).slice(lo, hi - lo),
                     pa.array((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)), pa.array(np.diff(bounds)), pa.array(add(known).astype(np.int64)),
                     pa.array(base), pa.array(add(logp)), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat).cast(word_type)],
                    ["row", "doc_id", "held_out", "digest", "n_tokens", "known", "base", "score", "rest"])
            row += batch.num_rows

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        run, "row long, doc_id long, held_out boolean, digest long, n_tokens long, known long, base double, score double, "
             "rest array<struct<word:long,tf:long>>")


def score_documents(docs: DataFrame, head_words: int = HEAD_WORDS, filter_bytes: int = FILTER_BYTES, shard_size: int = SHARD_GRAMS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    sc = docs.sparkSession.sparkContext
    train = docs.select("doc_id", "text").where(~held_out(F.col("doc_id")))
    counts = materialize(count_words(train), "counts")
    head_table = learn_head(counts, head_words)
    head = sc.broadcast(head_table)
    bits, shard_bits = filter_shape(counts, shard_size)
    pieces = materialize(build_filter(shard_grams(train, head, bits), shard_bits), "filter")
    at_once = max(1, filter_bytes * 8 // shard_bits)
    scored, partial = None, []
    for low in range(0, 1 << bits, at_once):
        n = min(at_once, (1 << bits) - low)
        data = np.zeros(n * shard_bits // 8, np.uint8)
        for r in pieces.where(F.col("shard").between(low, low + n - 1)).toLocalIterator():
            a = (r.shard - low) * shard_bits // 8
            data[a:a + shard_bits // 8] = np.frombuffer(r.piece, np.uint8)
        rows = _score(docs, head, sc.broadcast(Filter(low, shard_bits, data)), bits)
        if scored is None:
            scored = materialize(rows, "scores")
        else:  # equal rows have equal sums, so one of each is enough
            partial.append(materialize(rows.groupBy("doc_id", "digest").agg(F.min("score").alias("more")), "scores"))
    slim = scored.drop("rest")
    for p in partial:
        p = p.select(F.col("doc_id").alias("_d"), F.col("digest").alias("_g"), "more")
        slim = (slim.join(p, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("digest") == F.col("_g")))
                .withColumn("score", F.col("score") + F.col("more")).drop("_d", "_g", "more"))
    # words outside the head: their exact counts by a join
    norm = head_table.total + 0.1 * (head_table.distinct + 1)
    tail = (scored.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.tf")
            .join(counts.where("kind = 0").select(F.col("key").alias("word"), "n"), "word", "left")
            .groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("tail_known"),
                                F.sum(F.col("tf") * F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(norm))).alias("tail_base")))
    return slim.join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(head_table.total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"), "score")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents", "doc_id", "text"))
