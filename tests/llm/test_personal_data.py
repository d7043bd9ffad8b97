"""Op 3 against plain regular expressions."""
import hashlib
import random
import re

import pytest

from quire.llm import personal_data as P

from ..conftest import SF_SMALL

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else 0,
            "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if ok(k, m[0])]


def check(df, rows):
    out = {r.doc_id: r for r in df.collect()}
    assert len(out) == len(rows)
    for i, text in rows:
        base, r = brute(text), out[i]
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(b[0] == k for b in base) for k in PLAIN], (i, text)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (i, text)
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if s.split(":")[0] in PLAIN] == joined.split(",") * bool(joined)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    check(P.op3_personal_data(spark, SF_SMALL), rows)


@pytest.fixture
def query(spark, monkeypatch):
    def run(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kind", "'x' as pii", "2 as _kept")
        monkeypatch.setattr(P, "read_table", lambda *a: df)
        return P.op3_personal_data(spark, "")
    return run


def test_random_texts(query):
    rnd = random.Random(3)
    parts = ["a@b.c", "x.y@mail-1.example.org", "_d@e.f", "@", ".", "1.2.3.4", "256.1.1.1", "0001.2.3.255", "4539 1488 0343 6467", "4111-1111-1111-1111",
             "4111111111111112", "+1 (555) 123-4567", "+49 30 1234567", "+", "7", " ", "-", "é", "\n", "𝒳", "(", ")", "%", "word", "1 2 3 4 5 6 7 8 9 0 1 2 3 4"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 14)))) for i in range(600)]
    check(query(rows), rows)


def edge_rows(n):
    return [(1, None), (2, ""), (3, "7" * n), (4, "1 " * n), (5, "a" * n + "@"), (6, "1.2.3.4 " * (n // 20)), (7, "a.b@c" + ".d" * n),
            (8, "+1" + " " * n), (9, "." * n)]


def test_edges(query):
    rows = edge_rows(2000)  # the plain patterns are quadratic on these
    check(query(rows), rows)


def test_very_long_texts(query):
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in query(edge_rows(100_000)).collect()}
    none = (0, 0, 0, 0)
    assert got == {1: none, 2: none, 3: none, 4: none, 5: none, 6: (0, 5000, 0, 0), 7: (1, 0, 0, 0), 8: none, 9: none}


def test_checksums_and_context(query):
    out = {r.doc_id: r.spans for r in query([
        (1, "pay to GB82 WEST 1234 5698 7654 32 now"), (2, "pay to GB82 WEST 1234 5698 7654 33 now"),
        (3, "my SSN is 078-05-1120."), (4, "part 078-05-1120."), (5, "")]).collect()}
    assert out[1].endswith("iban:7:34") and "iban" not in out[2]
    assert out[3] == "ssn:10:21" and out[4] == "" and out[5] == ""


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é a@b.c, +1 1.2.3.4 555 1234!"), (2, None), (3, "clean")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in P.redact(P.find_personal_data(df)).collect()}
    assert got == {1: "é <EMAIL>, <PHONE>!", 2: None, 3: "clean"}
