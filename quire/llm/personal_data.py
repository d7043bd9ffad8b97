"""Personal data, with DataFrame functions only.

Regular expressions propose spans, checksums (Luhn for cards, mod 97 for
IBANs) and part limits confirm them, and words near a span adjust its score.
Base kinds (email, ip, card, phone) are always kept; ``iban`` needs its
checksum, ``ssn`` (``ddd-dd-dddd``) needs a context word to reach
``MIN_SCORE``.

Positions are code points.  They come from the pieces between the matches: a
match starts after all earlier pieces and matches, so no text is searched
twice from its start.  All repetitions are possessive (no backtracking, no
recursion) and start only where a run starts, which keeps long digit runs
linear; they find what the plain patterns find.

Nulls: a null text is empty.  A null id and repeated rows are returned as they
are.  Ties (one span of two kinds) are kept for both kinds.  Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

# What the kinds look like.  "(?:(?<!x)|\G)" starts a match at the
# start of a run of x or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: score of a confirmed span, before context
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": "mail|contact|write to",
    "ip": "address|host|server|login|client",
    "card": "card|visa|payment|credit|debit",
    "phone": "phone|call|mobile|tel|fax|contact",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social security|taxpayer",
}
CONTEXT_BONUS = 0.3
CONTEXT_CHARS = 40
MIN_SCORE = 0.5
#: a text without this cannot have a match of the kind
NEEDS = {"email": "@", "phone": "+"}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True for digit strings with a right check digit."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + value(i))
    return F.when(n > 0, total % 10 == 0).otherwise(F.lit(False))


def iban_ok(m: Column) -> Column:
    """Mod 97 of the rearranged number (letters count from 10) is 1."""
    bare = F.replace(m, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(bare, 5, 34), F.substring(bare, 1, 4))

    def step(acc: Column, ch: Column) -> Column:
        code = F.ascii(ch)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return ~F.exists(F.split(m, r"\."), lambda p: ~p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"))
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return iban_ok(m)
    return F.lit(True)


def _spans(kind: str, text: Column, found: Column) -> Column:
    """array<struct<kind, start, end, score>> of the valid matches in ``found``."""
    pieces = F.slice(F.split(text, PATTERNS[kind], -1), F.lit(1), F.size(found))
    steps = F.zip_with(pieces, found, lambda p, m: F.length(p).cast("long") + F.length(m).cast("long"))
    ends = F.aggregate(steps, F.array().cast("array<long>"),
                       lambda acc, n: F.array_append(acc, n + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long"))))

    def span(m: Column, end: Column) -> Column:
        start = end - F.length(m)
        lead = F.greatest(start - CONTEXT_CHARS, F.lit(0).cast("long"))
        near = F.lower(F.concat(F.substring(text, (lead + 1).cast("int"), (start - lead).cast("int")), F.lit(" "),
                                F.substring(text, (end + 1).cast("int"), F.lit(CONTEXT_CHARS))))
        score = F.lit(SCORES[kind]) + F.when(near.rlike(CONTEXT[kind]), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
        return F.when(valid(kind, m), F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"),
                                               F.least(score, F.lit(1.0)).alias("score")))

    spans = F.filter(F.zip_with(found, ends, span), lambda s: s.isNotNull())
    return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= MIN_SCORE)


NO_SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii_spans``: all spans, by kind as listed, then start."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = {}
    for kind, pattern in PATTERNS.items():
        all_ = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
        if kind in NEEDS:
            all_ = F.when(F.contains(body, F.lit(NEEDS[kind])), all_).otherwise(F.array().cast("array<string>"))
        found[f"_m_{kind}"] = all_
    df = docs.withColumns(found)

    def spans_of(kind: str) -> Column:
        matches = F.col(f"_m_{kind}")
        return F.when(F.exists(matches, lambda m: valid(kind, m)), _spans(kind, body, matches).cast(NO_SPANS)).otherwise(F.array().cast(NO_SPANS))

    spans = [spans_of(k) for k in PATTERNS]
    return df.withColumn("pii_spans", F.concat(*spans)).drop(*found)


def span_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span, overlapping ones merged, replaced by ``<KIND>``."""
    body, spans = F.col(text), F.array_sort(F.transform("pii_spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def merge(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when((F.size(acc) > 0) & (last["end"] > s["start"]),
                      F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), joined)).otherwise(F.array_append(acc, s))

    kept = F.aggregate(spans, F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>"), merge)
    df = docs.withColumn("_kept", F.when(F.size("pii_spans") > 0, kept))

    def piece(s: Column, i: Column) -> Column:
        begin = F.when(i > 0, F.element_at("_kept", F.when(i > 0, i).otherwise(F.lit(1)))["end"]).otherwise(F.lit(0).cast("long"))
        return F.concat(F.substring(body, (begin + 1).cast("int"), (s["start"] - begin).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">"))

    tail = F.substring(body, (F.element_at("_kept", -1)["end"] + 1).cast("int"), F.length(body))
    new = F.when(F.col("_kept").isNotNull(), F.concat(F.array_join(F.transform("_kept", piece), ""), tail)).otherwise(body)
    return df.withColumn(text, new).drop("_kept")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = find_personal_data(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    of = lambda k: F.size(F.filter("pii_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*BASE))
    return df.select("doc_id", *[of(k) for k in BASE], F.sha2(span_string(base), 256).alias("base_sha256"),
                     span_string(F.col("pii_spans")).alias("spans"))
