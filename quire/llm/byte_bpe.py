"""Byte-level BPE: texts to token ids and back.

A small Arrow step replaces the texts of a group (about ``GROUP_CHARS``
characters, whole texts) by its distinct words and, for each text, the numbers
of its words in order.  The merging itself is Spark's: higher-order functions
fold the ranked merges over the byte array of each distinct word, with the
ranks as one literal (an array of short strings, found by the CRC-32 of a pair, so
that a look-up doesn't scan all ranks).  The texts' ids are then put together by
position from those of the words of the same row, in a second Arrow step; no text
is shuffled, and no row holds more than one group or one text.  Decoding takes the
pieces of the ids from a literal array and joins them to one binary; the query
takes them by distinct word, in that second step.

The words that most groups share are merged once: the words counted in one
document of ``SAMPLE`` by the hash of its text, at most ``KNOWN_WORDS`` of them
and the most frequent, are folded first and sent to the tasks.  They save time
only; any other word is folded in its group.

A word's parts are written as a string with one character a part: the character
of the part's id, which is its rank (past U+D7FF, moved over the surrogates).
So the array of a word's bytes, its merged parts and the ranks of its pairs are
short strings, and the least rank is the least character.

Merges: the pair with the least rank first, the leftmost of equals, as in the
usual tokenizer.  A word of more than ``LONG_WORD`` bytes (a very long run of
letters, say) is cut between bytes that stand side by side in no token at all;
what is still long merges all pairs of the least rank at once, where no merge can
make a pair of a lower rank, and one at a time elsewhere.  Such a word costs its
length times the number of distinct ranks that it merges.

Null texts are empty, and an empty text has no ids.  Null ids and repeated rows
are returned as they are; an empty table gives no rows.  Very long texts are a
group of their own, whole.  Ties of ranks can't occur: a rank is a token's id.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, trimmed

#: of a group of texts that share their distinct words
GROUP_CHARS = 1 << 25
#: of groups that go to a Python task at a time; at least one
GROUP_BYTES = 1 << 24
#: words merged once for all groups, and the share of documents in which they are counted
KNOWN_WORDS, SAMPLE = 1 << 18, 16
#: words of whole texts that are put together at a time
TEXT_WORDS = 1 << 18
MAX_KNOWN_BYTES = 64
LONG_WORD = 64
BUCKETS = 1 << 17
SURROGATES = 0xD800
#: ends of a word, no rank, and between the strings of a literal; beyond all ids
END, NONE, BETWEEN = "\U0010FFFE", "\U0010FFFD", "\U0010FFFC"
MAX_VOCABULARY_BYTES = 16 << 20
NAME = "byte_bpe_50k.tiktoken"


@dataclass(frozen=True)
class Vocabulary:
    """Ranks by bytes, and what follows from them."""

    ranks: dict[bytes, int]
    pattern: str

    @cached_property
    def split(self) -> list[tuple[int, int, int]]:
        """(left, right, token) for all ways in which two tokens make a third."""
        of = self.ranks.get
        return [(a, b, rank) for token, rank in self.ranks.items() for i in range(1, len(token))
                if (a := of(token[:i])) is not None and (b := of(token[i:])) is not None]

    @cached_property
    def odd(self) -> frozenset[bytes]:
        """Tokens that merging their bytes doesn't give; as a whole word they are found all the same."""
        return frozenset(token for token in self.ranks if len(merged(token, self.ranks)) > 1)

    @cached_property
    def neighbours(self) -> frozenset[bytes] | None:
        """Byte pairs within tokens, as no merge joins any other; None if words can't be cut there."""
        return None if self.odd else frozenset(token[i:i + 2] for token in self.ranks for i in range(len(token) - 1))

    @cached_property
    def early(self) -> str:
        """The tokens that are the first or last part of a token of lower rank."""
        return "".join(sorted({char(part) for a, b, rank in self.split for part in (a, b) if part > rank}))


def char(rank: int) -> str:
    return chr(rank if rank < SURROGATES else rank + 0x800)


def merged(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """One token's bytes merged; tokens are short."""
    parts = [word[i:i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, k = min((ranks.get(parts[i] + parts[i + 1], len(ranks) << 8), i) for i in range(len(parts) - 1))
        if rank == len(ranks) << 8:
            break
        parts[k:k + 2] = [parts[k] + parts[k + 1]]
    return parts


def read_vocabulary(path: str, pattern: str) -> Vocabulary:
    """A rank file, base64 piece and rank a line; read once, on the driver."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is no vocabulary: over {MAX_VOCABULARY_BYTES} bytes")
    return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}, pattern)


def public_vocabulary(name: str = NAME) -> Vocabulary:
    import public_tokenizers

    return read_vocabulary(public_tokenizers.path(name), public_tokenizers.PATTERN)


# --- literals ----------------------------------------------------------------

def rank_literal(vocabulary: Vocabulary) -> Column:
    """array<string>, by CRC-32 of a pair of parts: NONE, and for each pair END, the
    pair and the part that it makes."""
    table = [NONE] * BUCKETS
    for a, b, rank in vocabulary.split:
        pair = char(a) + char(b)
        table[zlib.crc32(pair.encode()) % BUCKETS] += END + pair + char(rank)
    return F.split(F.lit(BETWEEN.join(table)), BETWEEN)


def strings_literal(values: list[str]) -> Column:
    return F.from_json(F.lit(json.dumps(values, ensure_ascii=False, separators=(",", ":"))), "array<string>")


# --- the merges, as expressions ------------------------------------------------

def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def rank_of(ranks: Column, pair: Column) -> Column:
    """The part that two neighbours make, NONE if none: the character after the pair,
    or the first one of a string without it."""
    bucket = F.get(ranks, (F.crc32(pair) % BUCKETS).cast("int"))
    return F.left(F.call_function("substring_index", bucket, F.concat(F.lit(END), pair), F.lit(-1)), F.lit(1))


def tail(text: Column, at: Column) -> Column:
    return F.substring(text, at, F.lit(1 << 30))


def pair_ranks(ranks: Column, parts: Column) -> Column:
    """The ranks of all neighbours, one character each."""
    return let(F.split(parts, ""), lambda part: F.array_join(F.zip_with(
        part, tail_of(part), lambda a, b: F.when(b.isNotNull(), rank_of(ranks, F.concat(a, b)))), ""))


def tail_of(array: Column) -> Column:
    return F.slice(array, 2, F.size(array))


def merge_first(ranks: Column, state: Column, least: Column) -> Column:
    """The leftmost pair of the least rank becomes one part; only the ranks of
    its new neighbours are looked up."""
    parts, pairs = state["parts"], state["pairs"]
    return let(F.instr(pairs, least), lambda k: F.struct(
        F.concat(F.substring(parts, F.lit(1), k - 1), least, tail(parts, k + 2)).alias("parts"),
        F.concat(F.substring(pairs, F.lit(1), k - 2), rank_of(ranks, F.concat(F.substring(parts, k - 1, F.lit(1)), least)),
                 rank_of(ranks, F.concat(least, F.substring(parts, k + 2, F.lit(1)))), tail(pairs, k + 2)).alias("pairs")))


def merge_all(ranks: Column, state: Column, least: Column) -> Column:
    """All pairs of the least rank, from the left and without overlap, become one
    part each."""
    def joined(picked: Column) -> Column:
        new = F.transform(F.split(state["parts"], ""), lambda p, i: F.when(F.get(picked, i) == least, least).when(
            (i == 0) | (F.get(picked, i - 1) != least), p))
        return let(F.array_join(new, ""), lambda parts: F.struct(parts.alias("parts"), pair_ranks(ranks, parts).alias("pairs")))

    return let(F.split(F.replace(state["pairs"], F.concat(least, least), F.concat(least, F.lit(NONE))), ""), joined)


def merged_parts(ranks: Column, early: Column, word: Column) -> Column:
    """A word, given as its bytes (a string of parts), after all merges."""
    def step(state: Column) -> Column:
        def merge(least: Column) -> Column:
            at_once = (F.length(state["parts"]) > LONG_WORD) & (F.instr(early, least) == 0)
            return F.when(least == NONE, state).when(at_once, merge_all(ranks, state, least)).otherwise(merge_first(ranks, state, least))

        return let(F.array_min(F.split(state["pairs"], "")), merge)

    start = let(F.concat(F.lit(END), word, F.lit(END)), lambda parts: F.struct(parts.alias("parts"), pair_ranks(ranks, parts).alias("pairs")))
    return F.aggregate(F.sequence(F.lit(1), F.length(word)), start, lambda state, _: step(state),
                       lambda state: F.substring(state["parts"], F.lit(2), F.length(state["parts"]) - 2))


# --- texts ---------------------------------------------------------------------

@lru_cache(maxsize=2)
def splitter(pattern: str):
    """The word split; \\s as in the tokenizer's own engine, which is the property
    White_Space and holds no control characters.  Texts without characters past
    U+FFFF are split by Python's own engine with the properties spelt out, which
    takes half the time; patterns with other escapes or groups don't have it."""
    import regex

    pattern = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
    wide = regex.compile(pattern).findall
    if re.search(r"\\[^pP]|\(\?[^!=:]|\[\[", pattern):
        return wide
    chars = "".join(map(chr, [*range(SURROGATES), *range(0xE000, 0x10000)]))
    out, inside = [], False
    for item in re.findall(r"\\[pP]\{\w+\}|.", pattern, re.DOTALL):
        if item[0] == "\\":
            spelt = "".join(f"\\u{ord(run[0]):04x}-\\u{ord(run[-1]):04x}" for run in regex.findall(f"{item}+", chars))
            out.append(spelt if inside else f"[{spelt}]")
        else:
            inside = item == "[" or inside and item != "]"
            out.append(item)
    narrow, past = re.compile("".join(out)).findall, re.compile("[\U00010000-\U0010FFFF]").search
    return lambda text: wide(text) if past(text) else narrow(text)


def count_words(pattern: str):
    """An Arrow step: words and how often they occur, some rows for each word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        import pyarrow as pa

        split, counts = splitter(pattern), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                counts.update(w for w in split(text.as_py() or "") if len(w) <= MAX_KNOWN_BYTES)
                if len(counts) > 1 << 19:
                    yield flush()
        yield flush()

    return run


@dataclass(frozen=True)
class Known:
    """The merged parts of words, as an Arrow stream; a table only where it is asked for."""

    stream: bytes
    odd: dict[str, str]

    @cached_property
    def words(self) -> dict[str, str]:
        import pyarrow as pa

        batches = pa.ipc.open_stream(self.stream) if self.stream else []
        return {word: self.odd.get(word, parts) for batch in batches for word, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True)}


def known_words(docs: DataFrame, vocabulary: Vocabulary, text_col: str) -> dict[str, str]:
    """The merged parts of the most frequent words, at most ``KNOWN_WORDS`` of them."""
    return known_stream(docs, vocabulary, text_col).words


def known_stream(docs: DataFrame, vocabulary: Vocabulary, text_col: str) -> Known:
    """``known_words`` as they are sent to the tasks."""
    sample = docs.select(F.col(text_col).cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counts = materialize(sample.mapInArrow(count_words(vocabulary.pattern), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
                         .where("n > 1"), "words")
    # by classes of frequency: the last class that does not fit is left out whole
    classes = counts.groupBy(F.floor(F.log2("n") * 4).alias("class")).count().orderBy(F.desc("class")).collect()
    least, total = None, 0
    for row in classes:
        total += row["count"]
        if total > KNOWN_WORDS:
            break
        least = row["class"]
    if least is None:
        return Known(b"", {})
    to_parts = strings_literal([char(vocabulary.ranks[bytes([i])]) for i in range(256)])
    spelt = let(to_parts, lambda part: F.array_join(F.transform(F.sequence(F.lit(1), F.length(F.encode("word", "UTF-8"))), lambda i: F.get(
        part, F.conv(F.hex(F.substring(F.encode("word", "UTF-8"), i, F.lit(1))), 16, 10).cast("int"))), ""))
    frequent = counts.where(F.floor(F.log2("n") * 4) >= least).select("word", spelt.alias("bytes"))
    folded = frequent.select("word", let(rank_literal(vocabulary), lambda ranks: merged_parts(ranks, F.lit(vocabulary.early), F.col("bytes"))).alias("parts"))
    odd = {t.decode("utf-8", "ignore"): char(vocabulary.ranks[t]) for t in vocabulary.odd}
    table, sink = folded.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    return Known(sink.getvalue().to_pybytes(), odd)


def distinct_words(vocabulary: Vocabulary, known, limit: int):
    """An Arrow step: groups of whole texts as (ids, ends, places, words): the texts'
    words by number, one after the other, where each text ends there, and the words as
    strings of parts, merged already or not."""
    pattern, pairs, odd = vocabulary.pattern, vocabulary.neighbours, vocabulary.odd
    tokens = {t: char(r) for t, r in vocabulary.ranks.items() if len(t) == 1 or len(t) > LONG_WORD or t in odd}
    byte = {i: tokens[bytes([i])] for i in range(256)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from array import array

        import pyarrow as pa

        split, ready = splitter(pattern), known.value.words
        words: list[str] = []
        done: list[bool] = []
        cut: list[list[int]] = []

        def put(raw: bytes) -> int:
            words.append(tokens.get(raw) or raw.decode("latin-1").translate(byte))
            done.append(raw in tokens)
            return len(words) - 1

        class Numbers(dict):
            def __missing__(self, word: str) -> int:
                """A new word's number; of a word cut into several, -1 less the place in ``cut``."""
                if word in ready:
                    words.append(ready[word])
                    done.append(True)
                    self[word] = len(words) - 1
                    return self[word]
                raw = word.encode()
                if pairs is None or len(raw) <= LONG_WORD or raw in tokens:
                    self[word] = put(raw)
                    return self[word]
                ends = [0, *(i for i in range(1, len(raw)) if raw[i - 1:i + 1] not in pairs), len(raw)]
                pieces = [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
                own = {piece: put(piece) for piece in dict.fromkeys(pieces)}
                cut.append([own[piece] for piece in pieces])
                self[word] = -len(cut)
                return self[word]

        numbers = Numbers()
        ids: list[int | None] = []
        places, ends, size = array("i"), [], 0

        def flush() -> pa.RecordBatch:
            found = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(done, pa.bool_())], ["parts", "done"])
            out = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, pa.int64())),
                                              one_binary(np.array(ends, "<i8")), one_binary(np.array(places, "<i4", copy=None)),
                                              pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), found)], ["ids", "ends", "places", "words"])
            numbers.clear(), words.clear(), done.clear(), cut.clear(), ids.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                if ids and size + len(text) > limit:
                    yield flush()
                    places, ends, size = array("i"), [], 0
                at = array("i", map(numbers.__getitem__, split(text)))
                if cut and at and min(at) < 0:
                    at = array("i", (n for a in at for n in (cut[-1 - a] if a < 0 else (a,))))
                places.extend(at)
                ends.append(len(places))
                ids.append(doc_id)
                size += len(text)
        if ids:
            yield flush()

    return run


def part_bytes(parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all strings of parts, and where each string ends among them."""
    import pyarrow.compute as pc

    ends = np.cumsum(np.asarray(pc.utf8_length(parts)), dtype=np.int64)
    codes = np.frombuffer("".join(parts.to_pylist()).encode("utf-32-le"), "<u4")
    return np.where(codes < SURROGATES, codes, codes - np.uint32(0x800)), ends


def binaries(data, ends: np.ndarray) -> pa.Array:
    """Binaries that end at ``ends`` of ``data``, one after the other."""
    import pyarrow as pa

    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(data)])


def one_binary(data: np.ndarray) -> pa.Array:
    """The numbers as one binary, not copied."""
    import pyarrow as pa

    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, data.nbytes], np.int32)), pa.py_buffer(data)])


def taken(values: pa.Array, at) -> tuple[memoryview, np.ndarray]:
    """The binaries at these places, joined, and where each one starts; the last start is the end."""
    found = values.take(at)
    _, starts, data = found.buffers()
    starts = np.frombuffer(starts, np.int64)[found.offset:found.offset + len(found) + 1] if len(found) else np.zeros(1, np.int64)
    return memoryview(data if data is not None else b""), starts


def text_rows(of_words, names: list[str]):
    """An Arrow step: groups of texts, with the merged parts of their words, to one
    row a text.  ``of_words`` gets the ids of a group's words and where each word
    ends there; it makes a function of the places of some texts' words, and where
    each text starts, to the columns of these texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                ids, parts = batch.column(0)[row].values, batch.column(3)[row].values
                ends, places = (np.frombuffer(batch.column(c)[row].as_buffer(), kind) for c, kind in ((1, "<i8"), (2, "<i4")))
                columns = of_words(*part_bytes(parts))
                starts, lo = np.concatenate([[0], ends]), 0
                while lo < len(ids):
                    hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + TEXT_WORDS, "right")))
                    own = columns(pa.array(places[starts[lo]:starts[hi]]), starts[lo:hi + 1] - starts[lo])
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *own], names)
                    lo = hi

    return trimmed(run)


def per_text(docs: DataFrame, vocabulary: Vocabulary, of_words, columns: str, id_col: str, text_col: str) -> DataFrame:
    """(id, columns), which ``of_words`` makes of the ids of the distinct words of
    a group and of the texts' words by number (see ``text_rows``)."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 20))  # the literals would fill the plans that the driver keeps as text
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(GROUP_BYTES))  # rows are groups
    known = spark.sparkContext.broadcast(known_stream(docs, vocabulary, text_col))
    early = F.lit(vocabulary.early)
    groups = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        trimmed(distinct_words(vocabulary, known, GROUP_CHARS)), "ids array<long>, ends binary, places binary, words array<struct<parts:string,done:boolean>>")
    found = let(rank_literal(vocabulary), lambda ranks: F.transform("words", lambda w: F.when(w["done"], w["parts"]).otherwise(
        merged_parts(ranks, early, w["parts"]))))
    names = [column.split()[0] for column in columns.split(", ")]
    return groups.select("ids", "ends", "places", found.alias("parts")).mapInArrow(
        text_rows(of_words, ["_id", *names]), f"_id long, {columns}").select(F.col("_id").alias(id_col), *names)


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row's whole text."""
    def of_words(ids: np.ndarray, ends: np.ndarray):
        import pyarrow as pa

        packed = binaries(ids.astype("<u4"), 4 * ends)

        def columns(places: pa.Array, starts: np.ndarray) -> list[pa.Array]:
            data, at = taken(packed, places)
            return [pa.ListArray.from_arrays(pa.array(at[starts] >> 2, pa.int32()), pa.array(np.frombuffer(data, "<i4")[:at[-1] >> 2]))]

        return columns

    return per_text(docs, vocabulary, of_words, "ids array<int>", id_col, text_col)


def piece_list(vocabulary: Vocabulary) -> list[bytes]:
    """The pieces by id, empty where there is none."""
    pieces = [b""] * (max(vocabulary.ranks.values(), default=-1) + 1)
    for token, rank in vocabulary.ranks.items():
        pieces[rank] = token
    return pieces


def packed_list(vocabulary: Vocabulary) -> list[bytes]:
    """The ids as unsigned 32-bit integers, lowest byte first."""
    return [i.to_bytes(4, "little") for i in range(max(vocabulary.ranks.values(), default=-1) + 1)]


def joined(pieces: list[bytes], ids: Column) -> Column:
    """The pieces of the ids, joined; a byte is a Latin-1 character."""
    literal = strings_literal([p.decode("latin-1") for p in pieces])
    return let(literal, lambda piece: F.array_join(F.transform(ids, lambda i: F.get(piece, i)), ""))


def to_bytes(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def decode(vocabulary: Vocabulary, ids: Column) -> Column:
    """The bytes of an array of ids: their pieces, joined to one binary."""
    return to_bytes(joined(piece_list(vocabulary), ids))


def little_endian(vocabulary: Vocabulary, ids: Column) -> Column:
    """The ids as unsigned 32-bit integers, lowest byte first."""
    return to_bytes(joined(packed_list(vocabulary), ids))


def digests(vocabulary: Vocabulary):
    """Token counts, and the digests of the packed ids and of the decoded bytes; the
    ids of each distinct word are packed and decoded once."""
    pieces = piece_list(vocabulary)

    def of_words(ids: np.ndarray, ends: np.ndarray):
        import hashlib

        import pyarrow as pa

        packed = binaries(ids.astype("<u4"), 4 * ends)
        spelt, at = taken(pa.array(pieces, pa.large_binary()), pa.array(ids))
        decoded = binaries(spelt, at[ends])

        def columns(places: pa.Array, starts: np.ndarray) -> list[pa.Array]:
            def digest(data: memoryview, cuts: list[int]) -> pa.Array:
                return pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:], strict=False)], pa.string())

            (data, at), (text, text_at) = taken(packed, places), taken(decoded, places)
            return [pa.array(np.diff(at[starts]) >> 2), digest(data, at[starts].tolist()), digest(text, text_at[starts].tolist())]

        return columns

    return of_words


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_vocabulary()
    return per_text(read_table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary, digests(vocabulary),
                    "n_tokens long, ids_sha256 string, decoded_sha256 string", "doc_id", "text")
