"""Committed loads, and file scans without a driver loop."""
import pytest

from quire.operators import loads as C
from quire.operators.stores import latest_store
from quire.sources import files as FS

from .conftest import formatted, rows

STORES = "doc_type string, store_id string, description string"
DOCS = "store_id string, batch_id long, pos long, file_path string"


def load(spark, base, load_id, stores, docs, now="2024/05/01 08:00:00"):
    return C.commit_load(base, load_id, spark.createDataFrame(stores, STORES), spark.createDataFrame(docs, DOCS), now)


def test_both_or_nothing(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "reg")
    assert C.read_registry(spark, base).count() == C.read_documents(spark, base).count() == 0
    assert load(spark, base, "one", [("servo", "s1", ""), ("", "s9", "x"), (None, "s8", "x"), ("servo", None, "x")], [("s1", 1, 0, "/a.txt")])
    assert rows(C.read_registry(spark, base), "doc_type", "rag_id", "description", "load") == [("servo", "s1", None, "one")]
    broken = spark.createDataFrame([("s2", 2, 0, "/b.txt")], DOCS).selectExpr("store_id", "batch_id", "pos", "raise_error('disk') as file_path")
    with pytest.raises(Exception, match="disk"):  # fails when the registry rows are written already
        C.commit_load(base, "two", spark.createDataFrame([("servo", "s2", "d")], STORES), broken.selectExpr("*").withColumn("file_path", broken.file_path.cast("string")),
                      "2024/05/02 08:00:00")
    assert C.read_registry(spark, base).count() == C.read_documents(spark, base).count() == 1
    assert load(spark, base, "two", [("servo", "s2", "d")], [("s2", 2, 0, "/b.txt"), ("s2", 2, 1, "/c.txt")], "2024/05/02 08:00:00")
    newest = latest_store(C.read_registry(spark, base)).first()
    assert (newest.rag_id, newest.created_at) == ("s2", "2024/05/02 08:00:00")
    assert rows(C.read_documents(spark, base).where("store_id = 's2'"), "file_path", "load") == [("/b.txt", "two"), ("/c.txt", "two")]


def test_repeated_load(spark, tmp_path):
    base = str(tmp_path / "reg")
    for want in (True, False, False):
        assert load(spark, base, "same", [("t", "s1", "d"), ("t", "s0", "d")], [("s1", 1, 0, "/a.txt")]) is want
    assert C.read_registry(spark, base).count() == 2 and C.read_documents(spark, base).count() == 1
    assert latest_store(C.read_registry(spark, base)).first().rag_id == "s0"  # of one time the first


def corpus(tmp_path):
    for name in ("solo.txt", "kit/a.txt", "kit/deep/b.txt", "kit/no.pdf", "odd {x},[y]/c.txt", "odd {x},[y]/d.md"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"\xff" if name.endswith("b.txt") else name.encode())
    return str(tmp_path)


def test_inputs_of_many_types(spark, tmp_path):
    root = corpus(tmp_path)
    asked = spark.createDataFrame([("kit",), ("solo",), ("none",), ("kit",)], "doc_type string")
    got = FS.gather_upload_inputs(spark, root, asked).collect()
    assert sorted((r.doc_type, (r.file_path or "").replace(root, "")) for r in got) == [("kit", "/kit/a.txt"), ("kit", "/kit/deep/b.txt"), ("none", ""), ("solo", "/solo.txt")]
    assert [r.error for r in got if r.doc_type == "none"] == ["No crawled files found for doc_type 'none'. Crawl first."]
    kit = sorted((r.pos, r.file_path) for r in got if r.doc_type == "kit")
    assert kit[0][0] < kit[1][0] and kit[0][1] < kit[1][1]
    alone = FS.gather_upload_inputs(spark, root, "kit").collect()
    assert sorted(r.file_path for r in alone) == [p for _, p in kit]


@pytest.mark.parametrize("with_root", [True, False])
def test_local_files(spark, tmp_path, with_root):
    """Missing folders, names that a pattern would read otherwise, pushed length filter."""
    root = corpus(tmp_path)
    names = ["kit/a.txt", "kit/deep/b.txt", "kit/no.pdf", "odd {x},[y]/c.txt", "gone/e.txt", "kit/gone.txt"]
    asked = spark.createDataFrame([(f"{root}/{n}",) for n in names] + [(None,)], "file_path string")
    listing, probe = FS.scan_local_files(spark, asked, root=root if with_root else None)
    assert sorted(r.path.replace(root + "/", "") for r in listing.collect()) == sorted(names[:4])
    assert {r.path.replace(root + "/", ""): r.utf8_ok for r in probe.collect()} == {"kit/a.txt": True, "kit/deep/b.txt": False, "odd {x},[y]/c.txt": True}
    assert "LessThanOrEqual(length" in formatted(probe)
    assert "content" not in formatted(listing)
    none = FS.scan_local_files(spark, asked.limit(0), root=f"{root}/gone" if with_root else None)
    assert [df.count() for df in none] == [0, 0]
