"""Keyword resolution tiers and reverse doc_type lookup."""
import pytest

from quire.operators.resolve import infer_doc_type, resolve_keywords

REG = [(0, "Board Docs", "Board Docs", "https://docs.board.example/", None),
       (1, "Kit Docs", "Kit Docs", "https://docs.kit.example/ja/start", None)]
DDL = "pos int, keyword string, name string, url string, description string"


def resolve(spark, reg, kws):
    req = spark.createDataFrame(list(enumerate(kws)), "req_id int, keyword_or_url string")
    out = resolve_keywords(req, spark.createDataFrame(reg, DDL)).collect()
    return {r.keyword_or_url: r for r in out}


def test_tiers(spark):
    got = resolve(spark, REG, ["Board Docs", "BOARD DOCS", "kit docs", "board", "https://example.com/docs",
                               "nonexistent", ""])
    assert (got["Board Docs"].tier, got["Board Docs"].url) == ("exact", "https://docs.board.example/")
    assert (got["BOARD DOCS"].tier, got["BOARD DOCS"].url) == ("case_insensitive", "https://docs.board.example/")
    assert got["kit docs"].url == "https://docs.kit.example/ja/start"
    assert (got["board"].tier, got["board"].url) == ("substring", "https://docs.board.example/")
    assert (got["https://example.com/docs"].tier, got["https://example.com/docs"].url) == (
        "url", "https://example.com/docs")
    nf = got["nonexistent"]
    assert nf.tier == "not_found" and nf.url is None
    assert "not found in URL config" in nf.error and "Available keywords: Board Docs, Kit Docs" in nf.error
    assert got[""].error == "keyword_or_url cannot be empty"


def test_ambiguous(spark):
    reg = [(0, "test-api-1", "a", "https://a/", None), (1, "test-api-2", "b", "https://b/", None)]
    r = resolve(spark, reg, ["test"])["test"]
    assert r.tier == "ambiguous" and r.url is None
    assert "matches multiple APIs: test-api-1, test-api-2" in r.error


def test_case_insensitive_takes_first_in_registry_order(spark):
    reg = [(5, "abc", "x", "https://second/", None), (2, "ABC", "y", "https://first/", None)]
    assert resolve(spark, reg, ["aBc"])["aBc"].url == "https://first/"


def test_short_and_long_keywords_use_exact_gram_join(spark):
    reg = [(i, f"service-{i:03d}.example.org", "n", f"https://s{i}/", None) for i in range(30)]
    got = resolve(spark, reg, ["e", "service-007", "007.example", "zzz", "SERVICE-012.EXAMPLE.ORG"])
    assert got["e"].tier == "ambiguous"
    every = ", ".join(r[1] for r in reg)
    assert got["e"].error == f"Keyword 'e' matches multiple APIs: {every}. Please be more specific."
    assert got["service-007"].url == "https://s7/"
    assert got["007.example"].url == "https://s7/"
    assert got["zzz"].tier == "not_found"
    assert got["zzz"].error == f"Keyword 'zzz' not found in URL config. Available keywords: {every}"
    assert got["SERVICE-012.EXAMPLE.ORG"].tier == "case_insensitive"


def test_infer_doc_type_first_match_and_slug(spark):
    reg = [(0, "Fast Docs", "n", "https://fastdocs.example.org/", None),
           (1, "Fast Docs SDK", "n", "https://fastdocs.example.org/python-sdk/", None)]
    seeds = spark.createDataFrame([(1, "https://fastdocs.example.org/python-sdk/"), (2, "https://docs.kit.example/en/x"),
                                   (3, "https://fastdocs.example.org")], "seed_id int, start_url string")
    out = {r.seed_id: r.doc_type for r in infer_doc_type(seeds, spark.createDataFrame(reg, DDL)).collect()}
    assert out == {1: "Fast Docs", 2: "docs_kit_example", 3: "Fast Docs"}


def test_infer_doc_type_of_empty_urls(spark):
    """Against the plain rule: an empty string is in every string."""
    reg = [(0, "A", "n", "https://a.example/", None), (3, "Blank", "n", "", None), (5, "B", "n", "https://b.example/", None), (6, "Blank2", "n", "", None)]
    starts = ["https://a.example/x", "https://b.example/x", "https://c.example/", "", "https://a"]
    seeds = spark.createDataFrame(list(enumerate(starts)), "seed_id int, start_url string")
    for entries in (reg, reg[::2], reg[2:], []):
        want = [next((k for _, k, _, u, _ in entries if u in s or s in u), None) for s in starts]
        got = [(r.doc_type, r.source) for r in infer_doc_type(seeds, spark.createDataFrame(entries, DDL)).orderBy("seed_id").collect()]
        assert [d if source == "registry" else None for d, source in got] == want
