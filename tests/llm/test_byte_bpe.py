"""Byte-level BPE against the tokenizer library, and the exact round trip."""
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quire.llm import byte_bpe as B
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def vocabulary():
    return B.public_vocabulary()


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def hard_texts():
    rng = random.Random(5)
    ranges = [(32, 127), (0x80, 0x3000), (0x4E00, 0x9FFF), (0x1F300, 0x1F6FF), (9, 14)]
    mixed = ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2000))
    return ["", None, " ", "a" * 5000, "thethethe" * 500, "語" * 3000, letters, "x\x1c\x1d \x85  y  z\0", "<|endoftext|> it's",
            " " * 300 + "a", "\n\n \t", "=-" * 200, "0123456789" * 50, "the the the"] + mixed


@pytest.mark.parametrize("group", [B.GROUP_CHARS, 100])
def test_as_the_library(spark, vocabulary, library, monkeypatch, group):
    monkeypatch.setattr(B, "GROUP_CHARS", group)
    texts = hard_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    coded = B.encode(docs, vocabulary)
    got = coded.select("doc_id", "ids", B.decode(vocabulary, F.col("ids")), B.little_endian(vocabulary, F.col("ids"))).collect()
    assert len(got) == len(texts)
    for doc_id, ids, back, packed in got:
        want = library.encode_ordinary(texts[doc_id] or "")
        assert ids == want
        assert bytes(back) == (texts[doc_id] or "").encode()
        assert bytes(packed) == struct.pack(f"<{len(want)}I", *want)


def test_known_words_change_nothing(spark, vocabulary, library, monkeypatch):
    monkeypatch.setattr(B, "SAMPLE", 1)
    docs = spark.createDataFrame([(1, "the quick qwzrt the qwzrt"), (2, "qwzrt the é é")], "doc_id long, text string")
    known = B.known_words(docs, vocabulary, "text")
    assert set(known) == {" qwzrt", " é", " the"}
    monkeypatch.setattr(B, "KNOWN_WORDS", 0)
    assert B.known_words(docs, vocabulary, "text") == {}
    assert {r.doc_id: r.ids for r in B.encode(docs, vocabulary).collect()} == {
        1: library.encode_ordinary("the quick qwzrt the qwzrt"), 2: library.encode_ordinary("qwzrt the é é")}


def test_nulls_repeats_and_empty_table(spark, vocabulary):
    docs = spark.createDataFrame([(None, "ab"), (1, None), (1, "ab"), (1, "ab")], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.ids) for r in B.encode(docs, vocabulary).collect()))
    ab = [vocabulary.ranks[b"ab"]]
    assert got == [(False, 1, []), (False, 1, ab), (False, 1, ab), (True, 0, ab)]
    assert B.encode(docs.limit(0), vocabulary).count() == 0


def test_odd_tokens_and_high_ids(spark):
    """A token that merging doesn't give is found as a whole word; ids past the surrogates."""
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 60000, b"cab": 60001, b"xyz": 57343}
    vocabulary = B.Vocabulary(ranks, public_tokenizers.PATTERN)
    assert vocabulary.odd == {b"xyz"} and vocabulary.neighbours is None
    library = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["ab", "cab", "xyz", "xyzxyz", " xyz", "abcab", "xyz xyz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.ids for r in B.encode(docs, vocabulary).collect()} == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}


def test_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = B.op11_byte_bpe(spark, SF_SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_texts_are_put_together_in_parts(spark, vocabulary, library, monkeypatch):
    """A group's texts in blocks of a few words give the same digests, rows and counts."""
    monkeypatch.setattr(B, "TEXT_WORDS", 3)
    texts = hard_texts() + ["a b c d e f", "", "a b c d e f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = B.per_text(docs, vocabulary, B.digests(vocabulary), "n_tokens long, ids_sha256 string, decoded_sha256 string", "doc_id", "text").collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_known_words_travel_packed(spark, vocabulary, monkeypatch):
    """The driver keeps and sends one binary, no Python string for a word; ranks are short strings."""
    monkeypatch.setattr(B, "SAMPLE", 1)
    docs = spark.createDataFrame([(1, "the quick qwzrt the qwzrt")], "doc_id long, text string")
    known = B.known_stream(docs, vocabulary, "text")
    assert isinstance(known.stream, bytes) and "words" not in vars(known)
    assert set(known.words) == {" qwzrt"}
    assert spark.range(1).select(B.rank_literal(vocabulary).alias("r")).schema["r"].dataType.simpleString() == "array<string>"


def test_split_with_the_properties_spelt_out(vocabulary):
    """Both engines split alike, and texts past U+FFFF take the one that knows the properties."""
    import regex

    white = vocabulary.pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
    split, wide = B.splitter(vocabulary.pattern), regex.compile(white).findall
    assert getattr(split, "__name__", "") == "<lambda>"
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    texts = [t for t in hard_texts() if t] + [every, " ".join(every), "  ".join(every), "a𝒜b 𐒠 ١𝟏 x", "a\u3000\u2028 b\x1c\x85 "]
    for text in texts:
        assert split(text) == wide(text)
    assert B.splitter(r"(?i:a)|\w").__name__ == "findall"
