"""Op 2: an exact round trip, and the choice of responses."""
import base64
import hashlib

import pytest

from quire.llm import warc as W
from quire.session import scratch_path


def brute(rows):
    body = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, b in body:
        same = [j for j, c in body if c == b and j is not None]
        top = max(same, default=None)
        d = base64.b32encode(hashlib.sha1(b).digest()).decode()
        out.append((i, len(b), d, "response" if i == top else "revisit", None if i == top else top))
    return sorted(out, key=str)


ROWS = [(1, "http://a/1", "same"), (5, "http://a/5", "same"), (3, None, "same"), (2, "http://b c", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (4, "u", None), (6, "", ""),
        (7, "x", "é\r\n\r\n𝒳" * 10), (8, "x", "\r\n\r\n"), (9, "big", "y" * 300_000), (10, "big", "y" * 300_000), (None, "n", "same"), (11, "x", "twice"), (11, "x", "twice")]


@pytest.mark.parametrize("archive_bytes", [1, 500, 16 << 20])
def test_round_trip(spark, archive_bytes):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 as payload", "2 as record", "3 as digest").repartition(3)
    first, final = scratch_path(spark, "t"), scratch_path(spark, "t")
    W.pages_to_archives(df, first, archive_bytes=archive_bytes)
    back = sorted(((r.page_id, r.url, bytes(r.payload).decode()) for r in W.read_archives(spark, first).collect()), key=str)
    assert back == sorted(((i, u and u.replace(" ", "%20"), h or "") for i, u, h in ROWS), key=str)
    W.resolve_revisits(spark, first, final, archive_bytes=archive_bytes)
    out = W.read_archives(spark, final).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.digest, r.type, r.refers_to) for r in out), key=str) == brute(ROWS)
    assert all(r.type == "response" or bytes(r.payload) == b"" for r in out)


def test_least_bytes_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    for rows, want in ((df, {1: "response", 2: "response", 3: "revisit", 4: "response"}), (df.limit(0), {})):
        first, final = scratch_path(spark, "t"), scratch_path(spark, "t")
        W.pages_to_archives(rows, first)
        W.resolve_revisits(spark, first, final, least_bytes=3)
        assert {r.page_id: r.type for r in W.read_archives(spark, final).collect()} == want


def test_broken_archives_are_noticed():
    good = W.build_record("1", "u", b"abc", W.DATE) + b"\r\n\r\n"
    assert [(h["warc-type"], p) for h, p in W.read_records(good * 2)] == [("response", b"abc")] * 2
    for bad in (good[:-5], good[3:], good.replace(b"Content-Length: 3", b"Content-Length: 2")):
        with pytest.raises(ValueError):
            list(W.read_records(bad))
