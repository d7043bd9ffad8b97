"""Secret scans: patterns, and a token-efficiency test for random strings.

The base kinds are patterns with a least length.  The method adds ``random``
spans: a run of at least ``MIN_RUN`` key characters that needs so many tokens
of a public byte-pair vocabulary that it has fewer than ``MAX_RATIO`` characters
a token.  Ordinary words and names get three and more.  A run that passes as a
whole is measured again by its parts between separators: neighbouring parts that
are no words together, and long parts in windows of ``MIN_RUN`` characters.  Known digests (a hexadecimal string of a digest's length after
a word like ``sha256``) and identifiers (UUIDs, names joined from words) are
excluded, and what a base span covers is cut out of a run.

Only documents in which a byte scan finds a keyword, ``AKIA``, a long
hexadecimal run or a long run of key characters are searched further; no other
document can have a span.  No shuffle is needed.  The vocabulary's path is a
parameter; its file (about 1 MB, checked) is read once and sent to the tasks.

Nulls: a null text is empty.  A null id and repeated rows are returned as they
are.  Spans of different kinds may overlap.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read_table, text_blocks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 16 << 20
MIN_RUN = 20
MAX_RATIO = 2.1
#: a longer run is measured in pieces of this many characters
PIECE = 512

# The word split of the vocabulary, and the base kinds.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile("(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in KEYWORDS[:4])
                    + r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
DIGEST_WORD = re.compile(r"(?i)(?:md5|sha-?(?:1|224|256|384|512)|digest|checksum|integrity|fingerprint|commit|etag)\W{0,3}$")

RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
PART = re.compile(r"[^+/_=-]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
WORD_PART = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{2,8}|[0-9]{1,4}")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def is_identifier(run: str) -> bool:
    """UUIDs, and names whose parts are words, abbreviations or short numbers."""
    if UUID.fullmatch(run):
        return True
    parts = [p for p in re.split(r"[+/_=-]", run) if p]
    return all("".join(WORD_PART.findall(p)) == p and sum(map(len, re.findall("[a-z]{4,}", p))) * 2 >= len(p) or p.isdigit() and len(p) <= 4
               for p in parts)


def is_known_digest(text: str, start: int, run: str) -> bool:
    return len(run) in DIGEST_LENGTHS and re.fullmatch("[0-9a-fA-F]+", run) is not None and DIGEST_WORD.search(text[max(0, start - 20):start]) is not None


def token_ratio(run: str, encoding) -> float:
    """Characters a token."""
    n = sum(len(encoding.encode_ordinary(run[i:i + PIECE])) for i in range(0, len(run), PIECE))
    return len(run) / n


def random_parts(text: str, start: int, end: int, encoding) -> list[tuple[int, int]]:
    """Random strings in a piece of a run: the whole piece, or some of its parts."""
    run = text[start:end]
    if is_known_digest(text, start, run):
        return []
    if re.search("[A-Za-z]", run) and re.search("[0-9]", run) and not is_identifier(run) and token_ratio(run, encoding) < MAX_RATIO:
        return [(start, end)]
    out, joined = [], []
    parts = [(start + p.start(), start + p.end()) for p in PART.finditer(run)]
    for a, b in [*parts, (end, end)]:
        part = text[a:b]
        if part and not is_identifier(part) and not is_known_digest(text, a, part) and token_ratio(part, encoding) < MAX_RATIO:
            joined.append((a, b))
            continue
        if joined:
            lo, hi = joined[0][0], joined[-1][1]
            joined, key = [], text[lo:hi]
            if hi - lo >= MIN_RUN and re.search("[A-Za-z]", key) and re.search("[0-9]", key) and token_ratio(key, encoding) < MAX_RATIO:
                out.append((lo, hi))
    whole = set()
    for lo, hi in out:
        whole.update(a for a, _ in parts if lo <= a < hi)
    for a, b in parts:
        if b - a < MIN_RUN or a in whole or is_known_digest(text, a, text[a:b]):
            continue
        last = None
        for at in [*range(a, b - MIN_RUN, MIN_RUN // 2), b - MIN_RUN]:
            if token_ratio(text[at:at + MIN_RUN], encoding) < MAX_RATIO:
                if last is not None and at <= last[1]:
                    last = (last[0], at + MIN_RUN)
                    out[-1] = last
                else:
                    last = (at, at + MIN_RUN)
                    out.append(last)
    return sorted(out)


def random_spans(text: str, covered: list[tuple[str, int, int]], encoding) -> list[tuple[str, int, int]]:
    out, at = [], 0
    for m in RUN.finditer(text):
        ids = [("uuid", u.start(), u.end()) for u in UUID.finditer(text, m.start(), m.end())]
        while at < len(covered) and covered[at][2] <= m.start():
            at += 1
        k = at
        while k < len(covered) and covered[k][1] < m.end():
            ids.append(covered[k])
            k += 1
        lo = m.start()
        for _, a, b in [*sorted(ids, key=lambda s: s[1]), ("end", m.end(), m.end())]:
            if a - lo >= MIN_RUN:
                out += [("random", x, y) for x, y in random_parts(text, lo, a, encoding)]
            lo = max(lo, b)
    return out


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is no vocabulary: over {MAX_VOCABULARY_BYTES} bytes")
    return data


def load_encoding(data: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
    return tiktoken.Encoding("secrets", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def _byte_class(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
HEX_BYTES = _byte_class("0123456789abcdef")
RUN_BYTES = _byte_class("0123456789+/_=-" + _LETTERS + _LETTERS.upper())


def rows_with_runs(data: np.ndarray, off: np.ndarray, cls: np.ndarray, least: int) -> np.ndarray:
    """Rows with a run of at least ``least`` bytes of the class (runs across
    rows count for both, which is checked later)."""
    m = np.concatenate([[False], cls[data], [False]])
    edge = np.flatnonzero(m[1:] != m[:-1])
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    out = np.zeros(len(off), np.int64)
    np.add.at(out, np.searchsorted(off, start[long], "right") - 1, 1)
    np.add.at(out, np.searchsorted(off, end[long], "left"), -1)
    return np.flatnonzero(np.cumsum(out[:-1]) > 0)


def scan(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, base, spans): lists of (kind, start, end) in code points."""
    vocab = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        encoding = load_encoding(vocab.value)
        span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        of = lambda spans: [dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans]
        for batch in batches:
            for lo, hi, data, off in text_blocks(batch, "text"):
                base, spans = [[] for _ in range(hi - lo)], [[] for _ in range(hi - lo)]
                rows = set(rows_with_runs(data, off, HEX_BYTES, 16).tolist()) | set(rows_with_runs(data, off, RUN_BYTES, MIN_RUN).tolist())
                raw = data.tobytes()
                low = raw.lower()
                for block, words in ((low, KEYWORDS), (raw, ("AKIA",))):
                    for word in words:
                        at = block.find(word.encode())
                        while at >= 0:
                            row = int(np.searchsorted(off, at, "right")) - 1
                            rows.add(row)
                            at = block.find(word.encode(), int(off[row + 1]))
                for r in rows:
                    text = raw[off[r]:off[r + 1]].decode("utf-8", "replace")
                    found = base_spans(text)
                    base[r] = of(found)
                    spans[r] = of(sorted(found + random_spans(text, found, encoding), key=lambda s: (s[1], (*KINDS, "random").index(s[0]))))
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")).slice(lo, hi - lo),
                                                  pa.array(base, span_type), pa.array(spans, span_type)], ["doc_id", "base", "spans"])

    span = "array<struct<kind:string,start:long,end:long>>"
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, f"doc_id long, base {span}, spans {span}")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    count = "cast(size(filter(base, s -> s.kind = '{0}')) as long) as n_{0}"
    return scan(read_table(spark, sf_dir, "documents", "doc_id", "text")).selectExpr(
        "doc_id", *[count.format(k) for k in KINDS], f"sha2({joined.format('base')}, 256) as base_sha256", f"{joined.format('spans')} as spans")
