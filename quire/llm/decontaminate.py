"""Benchmark decontamination with an FM-index per training shard.

The windows of the benchmark items (13 consecutive words, or a whole shorter
item) are the phrases.  Every task cuts its documents into shards of about
``SHARD_BYTES`` and indexes each: the shard's words become symbols, a suffix
array gives the Burrows-Wheeler transform, and a wavelet matrix over it
answers rank queries.  All phrases are searched backwards at once; occurrences
are located by walking to sampled suffix positions, and the words that they
cover are merged to removal spans.

Only runs of words in which every neighbouring pair is also a pair of the
benchmark are put into the index: no phrase can occur elsewhere.  No shuffle
is needed.  The phrases of ``PHRASE_WORDS`` benchmark words at most are sent
to the tasks at a time; a larger benchmark is searched in several passes whose
spans are merged per document.

Nulls: a null text has no words; the windows of an item with a null id count
as hits but name no item.  Items with the same id are one item.  Empty tables
give no rows, or rows without hits.  Repeated rows are returned repeatedly.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens as T
from .common import read_table, text_blocks, trimmed

WINDOW = 13
SHARD_BYTES = 2 << 20
#: benchmark words whose phrases are sent to the tasks at a time (about 150 MB)
PHRASE_WORDS = 1_000_000
#: distance of sampled suffix positions
SAMPLE = 8


# --- the index --------------------------------------------------------------

class WaveletMatrix:
    """Rank queries over a sequence of symbols, for many queries at once."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.zeros, self.n_zero = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            cum = np.zeros(len(seq) + 1, np.int64)
            np.cumsum(bit == 0, out=cum[1:])
            self.zeros.append(cum)
            self.n_zero.append(int(cum[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        lo, hi = np.zeros_like(pos), pos
        for i, cum in enumerate(self.zeros):
            one = (symbol >> (self.bits - 1 - i)) & 1 == 1
            lo0, hi0 = cum[lo], cum[hi]
            lo = np.where(one, self.n_zero[i] + lo - lo0, lo0)
            hi = np.where(one, self.n_zero[i] + hi - hi0, hi0)
        return hi - lo


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Prefix doubling; ``seq`` ends in a unique least value."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    k = 1
    order = np.argsort(rank, kind="stable")
    while True:
        second = np.zeros(n, np.int64)
        second[:n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        rank = new
        if rank.max() == n - 1 or k >= n:
            return order
        k *= 2


class FMIndex:
    """Index of runs of symbols (1 and above); matches stay inside a run."""

    def __init__(self, runs: np.ndarray, starts: np.ndarray):
        """``runs``: all runs one after the other; ``starts``: where each begins."""
        n_runs, n = len(starts), len(runs)
        at = np.arange(n) + np.repeat(np.arange(n_runs), np.diff(np.append(starts, n)))
        text = np.zeros(n + n_runs, np.int64)
        text[at] = runs
        seps = np.setdiff1d(np.arange(n + n_runs), at, assume_unique=True)
        distinct = text + n_runs  # each separator its own least value, the last one the least
        distinct[seps] = np.arange(n_runs)[::-1]
        sa = suffix_array(distinct)
        self.bwt = text[sa - 1]
        self.n_symbols = int(text.max()) + 1
        self.tree = WaveletMatrix(self.bwt, self.n_symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.n_symbols))])
        first = np.append([0], seps[:-1] + 1)
        sampled = (sa % SAMPLE == 0) | np.isin(sa, first)
        self.sampled, self.sample_rank = sampled, np.cumsum(sampled) - 1
        self.positions = sa[sampled]
        self.origin = np.full(len(text), -1, np.int64)  # place in ``runs`` of a text position
        self.origin[at] = np.arange(n)

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffix order that begin with each phrase (one per line;
        symbols below 1 or unknown do not occur)."""
        n, width = phrases.shape
        lo, hi = np.zeros(n, np.int64), np.full(n, len(self.bwt), np.int64)
        known = ((phrases >= 1) & (phrases < self.n_symbols)).all(axis=1)
        hi[~known] = 0
        live = np.flatnonzero(known)
        for j in range(width - 1, -1, -1):
            c = phrases[live, j]
            lo[live] = self.before[c] + self.tree.rank(c, lo[live])
            hi[live] = self.before[c] + self.tree.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        dead = lo >= hi
        lo[dead] = hi[dead] = 0
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in ``runs`` of rows of the suffix order."""
        rows, steps, out = rows.copy(), 0, np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            hit = self.sampled[rows[todo]]
            done = todo[hit]
            out[done] = self.positions[self.sample_rank[rows[done]]] + steps
            todo = todo[~hit]
            c = self.bwt[rows[todo]]
            rows[todo] = self.before[c] + self.tree.rank(c, rows[todo])
            steps += 1
        return self.origin[out]


# --- the phrases ------------------------------------------------------------

@dataclass
class Phrases:
    """Windows of the benchmark items, as ids into ``vocab`` (from 1)."""

    vocab: np.ndarray  # sorted word hashes
    pairs: np.ndarray  # sorted codes of neighbouring words
    by_length: list[tuple[int, np.ndarray, np.ndarray]]  # (length, windows, item of each)
    items: list[int | None]
    shortest: int


def build_phrases(items: list[tuple[int | None, np.ndarray]], window: int = WINDOW) -> Phrases | None:
    items = [x for x in items if len(x[1])]
    if not items:
        return None
    vocab = np.unique(np.concatenate([w for _, w in items]))
    ids = list(dict.fromkeys(i for i, _ in items))
    place, by_length, pairs = {x: n for n, x in enumerate(ids)}, {}, []
    for item, words in items:
        w = np.searchsorted(vocab, words) + 1
        k = min(window, len(w))
        rows = np.lib.stride_tricks.sliding_window_view(w, k)
        by_length.setdefault(k, []).append((rows, np.full(len(rows), place[item])))
        pairs.append(w[:-1] * (len(vocab) + 1) + w[1:])
    lengths = [(k, np.concatenate([r for r, _ in x]), np.concatenate([i for _, i in x])) for k, x in sorted(by_length.items())]
    return Phrases(vocab, np.unique(np.concatenate(pairs)), lengths, ids, lengths[0][0])


def _member(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pos = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return pos, sorted_values[pos] == x


def search_shard(words: np.ndarray, bounds: np.ndarray, ph: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, item) of each occurrence in the words of a shard."""
    none = np.zeros(0, np.int64)
    if not len(words):
        return none, none, none
    pos, known = _member(ph.vocab, words)
    sym = np.where(known, pos + 1, 0)
    follows = np.zeros(len(words), bool)  # word i continues the run of word i - 1
    if len(words) > 1 and len(ph.pairs):
        both = np.flatnonzero(known[1:] & known[:-1]) + 1
        follows[both] = _member(ph.pairs, sym[both - 1] * (len(ph.vocab) + 1) + sym[both])[1]
        follows[bounds[:-1][bounds[:-1] < len(words)]] = False
    begin = np.flatnonzero(known & ~follows)
    if not len(begin):
        return none, none, none
    at = np.flatnonzero(known)
    run_of = np.cumsum(~follows[at]) - 1
    length = np.bincount(run_of)
    keep = (length >= ph.shortest)[run_of]
    at = at[keep]
    if not len(at):
        return none, none, none
    # symbols of this shard, numbered densely
    used, dense = np.unique(sym[at], return_inverse=True)
    starts = np.flatnonzero(~follows[at])
    index = FMIndex(dense.astype(np.int64) + 1, starts)
    out = []
    for k, windows, item in ph.by_length:
        place, there = _member(used, windows)
        lo, hi = index.ranges(np.where(there, place + 1, 0))
        n = hi - lo
        if n.any():
            which = np.repeat(np.arange(len(n)), n)
            rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[which]
            out.append((at[index.locate(rows)], np.full(len(rows), k), item[which]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none)


# --- the jobs ---------------------------------------------------------------

def item_words(benchmark: DataFrame) -> DataFrame:
    """(item_id, words): the hashes of an item's words, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            words = []
            for _, _, data, off in text_blocks(batch, "text"):
                h, b = T.word_hashes(data, off, T.ALNUM, lower=True)
                words += [h[i:j].tobytes() for i, j in zip(b[:-1], b[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("item_id")), pa.array(words, pa.binary())],
                                             ["item_id", "words"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(trimmed(run), "item_id long, words binary")


OUT = "doc_id long, digest long, n_words long, items array<long>, spans array<struct<start:long,end:long>>"


def _search(docs: DataFrame, phrases, shard_bytes: int) -> DataFrame:
    """``phrases``: broadcast Phrases or None.  One row per document; spans in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        ph = phrases.value
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for lo, hi, data, off in text_blocks(batch, "text", shard_bytes):
                words, bounds = T.word_hashes_in_parts(data, off, T.ALNUM, lower=True)
                n = hi - lo
                items, spans = [[] for _ in range(n)], [[] for _ in range(n)]
                if ph is not None:
                    start, length, item = search_shard(words, bounds, ph)
                    if len(start):
                        doc = np.searchsorted(bounds, start, "right") - 1
                        cover = np.zeros(len(words) + 1, np.int64)
                        np.add.at(cover, start, 1)
                        np.add.at(cover, start + length, -1)
                        hit = np.cumsum(cover[:-1]) > 0
                        first = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]))
                        cut = np.unique(np.concatenate([first, bounds[:-1][(bounds[:-1] < len(words))]]))
                        cut = cut[hit[cut]]
                        end = np.flatnonzero(hit & ~np.concatenate([hit[1:], [False]])) + 1
                        end = np.unique(np.concatenate([end, bounds[1:][bounds[1:] > 0]]))
                        end = end[hit[end - 1]]
                        for a, b in zip(cut.tolist(), end.tolist(), strict=True):
                            d = int(np.searchsorted(bounds, a, "right")) - 1
                            base = int(bounds[d])
                            spans[d].append({"start": a - base, "end": b - base})
                        for d, i in np.unique(np.stack([doc, item], 1), axis=0).tolist():
                            if ph.items[i] is not None:
                                items[d].append(ph.items[i])
                counts = np.diff(bounds)
                inside = np.arange(len(words)) - np.repeat(bounds[:-1], counts)
                total = np.concatenate([np.zeros(1, T.U64), np.cumsum(T.mix(words + inside.astype(T.U64)), dtype=T.U64)])
                digest = (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index("doc_id")).slice(lo, n), pa.array(digest), pa.array(counts),
                     pa.array(items, pa.list_(pa.int64())), pa.array(spans, span_type)],
                    ["doc_id", "digest", "n_words", "items", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), OUT)


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES,
           phrase_words: int = PHRASE_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) of every document: ``spans`` are
    the merged removal spans in words, ``items`` the ids found, ascending."""
    if window != WINDOW:
        raise ValueError("windows have 13 words")
    spark = docs.sparkSession
    words = item_words(benchmark)
    total = words.agg(F.coalesce(F.sum(F.length("words")) / 8, F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // phrase_words))
    found = []
    for part in range(parts):
        rows = words.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()
        phrases = build_phrases([(r.item_id, np.frombuffer(r.words, np.uint64)) for r in rows])
        found.append(_search(docs, spark.sparkContext.broadcast(phrases), shard_bytes))
    if parts == 1:
        out = found[0]
    else:
        key = ["doc_id", "digest", "n_words"]
        out = found[0].withColumn("copies", F.lit(1))  # equal rows are merged with the spans, and repeated afterwards
        for f in found[1:]:
            out = out.unionByName(f.withColumn("copies", F.lit(0)))
        out = (out.groupBy(*key).agg(F.sum("copies").alias("copies"),
                                     F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
                                     F.flatten(F.collect_set("spans")).alias("spans"))
               .withColumn("spans", merge_spans(F.col("spans")))
               .withColumn("_copy", F.explode(F.expr("sequence(1, int(copies))"))))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.array_sort("items").alias("items"), "spans")


def merge_spans(spans: Column) -> Column:
    """Overlapping (start, end) spans joined, in order."""

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (last["end"] >= s["start"]),
                      F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), joined)).otherwise(F.array_append(acc, s))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:bigint,end:bigint>>"), step)


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones (by id; a null id stays)."""
    bad = search(docs, benchmark).where(contaminated()).select(F.col("doc_id").alias("_bad")).where("_bad is not null").distinct()
    return docs.join(bad, F.col("doc_id") == F.col("_bad"), "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "benchmark", "item_id", "text"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(names, 256).alias("items_sha256"), contaminated().alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, list_aggregate(w[i + 1:i + least(13, len(w))], 'string_agg', ' ') AS phrase
  FROM (SELECT *, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (
  SELECT row_id, k, i, list_aggregate(w[i + 1:i + k], 'string_agg', ' ') AS phrase
  FROM (SELECT row_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM windows))),
hits AS (SELECT p.row_id, p.i, p.k, x.item_id FROM places p JOIN windows x USING (k, phrase)),
covered AS (SELECT row_id, count(DISTINCT i + j) AS n_hit FROM (SELECT row_id, i, unnest(range(0, k)) AS j FROM hits) GROUP BY row_id),
named AS (SELECT row_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
          FROM (SELECT DISTINCT row_id, item_id::VARCHAR AS name FROM hits WHERE item_id IS NOT NULL) GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (row_id) LEFT JOIN named USING (row_id)
"""
