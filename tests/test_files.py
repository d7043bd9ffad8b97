"""F8 validation with real files; SNK5/SNK7 load outcomes."""
import os

import pytest
from pyspark.sql import functions as F

from quire.operators import files as V
from quire.sources import files as FS
from quire.sources.files import gather_upload_inputs, scan_corpus_files, scan_corpus_files_of_type, scan_local_files, write_text_files

from .conftest import formatted


def make_files(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "good.txt").write_text("hello world " * 10, encoding="utf-8")
    (d / "notes.md").write_text("# title", encoding="utf-8")
    (d / "bad.txt").write_bytes(b"ok\xff\xfe\xfdbad")
    (d / "tool.exe").write_bytes(b"MZ")
    (d / "pic.PNG").write_bytes(b"\x89PNG")
    big = d / "big.pdf"
    with open(big, "wb") as f:
        f.truncate(51 * 1024 * 1024)
    return d


def validate(spark, tmp_path, names):
    d = make_files(tmp_path)
    req = spark.createDataFrame([("b1", i, str(d / n)) for i, n in enumerate(names)],
                                "batch_id string, pos int, file_path string")
    listing, probe = scan_local_files(spark, req)
    return {os.path.basename(r.file_path): r for r in V.validate(req, listing, probe).collect()}, req, listing, probe


def test_validation_chain(spark, tmp_path):
    got, *_ = validate(spark, tmp_path, ["good.txt", "notes.md", "bad.txt", "tool.exe", "pic.PNG", "big.pdf",
                                         "missing.txt"])
    assert got["good.txt"].valid and got["good.txt"].size == 120 and got["good.txt"].extension == ".txt"
    assert got["notes.md"].valid
    assert got["bad.txt"].error.startswith("Failed to read file encoding:")
    assert got["tool.exe"].error.startswith("Unsupported file extension: .exe. Supported: .txt, .md, .pdf")
    assert (got["tool.exe"].size, got["tool.exe"].extension) == (0, ".exe")
    assert got["pic.PNG"].valid and got["pic.PNG"].extension == ".png"
    assert got["big.pdf"].error == "File too large: 51.00MB. Maximum: 50MB"
    assert got["big.pdf"].size == 51 * 1024 * 1024
    m = got["missing.txt"]
    assert m.error.startswith("File not found:") and (m.size, m.extension, m.valid) == (0, "", False)


# every supported suffix, changed in one way, and shapes of its own
OTHER_SUFFIXES = sorted({e + "x" for e in V.SUPPORTED_EXTENSIONS} | {e[:-1] for e in V.SUPPORTED_EXTENSIONS} | {".m", ".page", ".123", ".é"}
                        - set(V.SUPPORTED_EXTENSIONS) - {"."})


@pytest.mark.parametrize("ext", OTHER_SUFFIXES)
def test_unsupported_extensions(spark, ext):
    req = spark.createDataFrame([("b", 0, f"/x/f{ext}")], "batch_id string, pos int, file_path string")
    lst = spark.createDataFrame([(f"/x/f{ext}", 10)], "path string, length bigint")
    r = V.validate(req, lst).first()
    assert not r.valid and ext in r.error and r.extension == ext


def test_load_outcome_partial_and_defaults(spark):
    val = spark.createDataFrame([
        ("b1", 0, "/d/myfile.txt", True, None, 10, ".txt"), ("b1", 1, "/d/two.md", True, None, 5, ".md"),
        ("b1", 2, "/d/x.exe", False, "Unsupported file extension: .exe", 0, ".exe"),
        ("b2", 0, "/d/a.txt", True, None, 1, ".txt"),
        ("b3", 0, "/d/z.exe", False, "Unsupported file extension: .exe", 0, ".exe")],
        "batch_id string, pos int, file_path string, valid boolean, error string, size bigint, extension string")
    errs = spark.createDataFrame([("b1", "/d/two.md", "boom"), ("b2", "/d/a.txt", "boom")],
                                 "batch_id string, file_path string, error string")
    got = {r.batch_id: r for r in V.load_outcome(val, errs).collect()}
    b1 = got["b1"]
    assert (b1.n_loaded, b1.n_load_failed, b1.n_invalid, b1.success, b1.doc_type) == (1, 1, 1, True, "myfile")
    assert b1.description == "Multiple files upload: 1 files" and b1.store_id.startswith("stores/")
    assert got["b2"].success is False and got["b2"].error == "All file uploads failed:\n/d/a.txt: boom" and got["b2"].store_id is None
    assert got["b3"].error.startswith("No valid files to upload:")


def test_load_store_all_or_nothing(spark):
    req = spark.createDataFrame([("b1", "api", 0, "/d/a.txt"), ("b1", "api", 1, "/d/b.txt"),
                                 ("b2", "api2", 0, "/d/a.txt"), ("b2", "api2", 1, "/d/missing.txt")],
                                "batch_id string, doc_type string, pos int, file_path string")
    lst = spark.createDataFrame([("/d/a.txt",), ("/d/b.txt",)], "path string")
    got = {r.batch_id: r for r in V.load_store(req, lst).collect()}
    assert got["b1"].success and got["b1"].description == "api API Documentation"
    assert not got["b2"].success and got["b2"].error == "File not found: /d/missing.txt"


def test_corpus_listing(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "alpha").mkdir(parents=True)
    (root / "alpha" / "sub").mkdir()
    (root / "beta.txt").write_text("x")
    (root / "alpha" / "a.txt").write_text("xx")
    (root / "alpha" / "sub" / "b.txt").write_text("xxx")
    (root / "alpha" / "skip.md").write_text("no")
    got = sorted((r.name, r.size, r.doc_type) for r in scan_corpus_files(spark, str(root)).collect())
    assert got == [("a.txt", 2, "alpha"), ("b.txt", 3, "sub"), ("beta.txt", 1, "beta")]
    typed = sorted((r.name, r.doc_type) for r in scan_corpus_files_of_type(spark, str(root), "alpha").collect())
    assert typed == [("a.txt", "alpha"), ("b.txt", "alpha")]
    assert scan_corpus_files(spark, str(tmp_path / "none")).count() == 0
    g = gather_upload_inputs(spark, str(root), "nothing").collect()
    assert len(g) == 1 and "Crawl first" in g[0].error


def test_load_file_defaults(spark, tmp_path):
    got, req, listing, probe = validate(spark, tmp_path, ["good.txt", "tool.exe"])
    val = V.validate(req, listing, probe)
    out = {os.path.basename(r.file_path): r for r in V.load_file(val).collect()}
    g = out["good.txt"]
    assert g.success and g.doc_type == "good" and g.description == "Direct upload: good.txt"
    assert g.store_id.startswith("stores/")
    t = out["tool.exe"]
    assert not t.success and t.store_id is None and t.error.startswith("Unsupported file extension")


def test_file_counts(spark):
    lst = spark.createDataFrame([("/a/x.txt", "x.txt", 3, "a"), ("/a/y.txt", "y.txt", 4, "a"), ("/b.txt", "b.txt", 1, "b")],
                                "path string, name string, size bigint, doc_type string")
    assert {r.doc_type: (r.file_count, r.total_size) for r in V.file_counts(lst).collect()} == {"a": (2, 7), "b": (1, 1)}
    assert tuple(V.file_counts(lst, by=None).first()) == (3, 8)


def test_outcomes_per_file(spark):
    val = spark.createDataFrame([("b", i, f"/d/{i}.txt", i % 3 > 0, None if i % 3 else f"bad {i}", 1, ".txt") for i in range(40)],
                                "batch_id string, pos int, file_path string, valid boolean, error string, size bigint, extension string")
    errs = spark.createDataFrame([("b", f"/d/{i}.txt", "boom") for i in range(1, 40, 3)], "batch_id string, file_path string, error string")
    out = {r.pos: (r.outcome, r.error) for r in V.file_outcomes(val, errs).collect()}
    assert out == {i: [("invalid", f"bad {i}"), ("failed", "boom"), ("uploaded", None)][i % 3] for i in range(40)}
    assert {r.pos for r in V.store_documents(V.file_outcomes(val, errs)).collect()} == set(range(2, 40, 3))
    none_valid = V.load_outcome(val.where("not valid")).first()
    assert none_valid.error == "No valid files to upload:\n" + "\n".join(f"bad {i}" for i in range(0, 40, 3))


def test_path_is_required(spark):
    req = spark.createDataFrame([("b", 0, ""), ("b", 1, None)], "batch_id string, pos int, file_path string")
    got = V.load_file(V.validate(req, spark.createDataFrame([("/x", 1)], "path string, length bigint"))).collect()
    assert [(r.success, r.error, r.store_id) for r in got] == [(False, "file_path is required", None)] * 2


def test_text_files_are_those_of_the_text_writer(spark, tmp_path):
    """Same folders and bytes as Spark's writer, with no second file for each."""
    own = [("a", "one"), ("a", "one"), ("b/c d=1%", ""), ("", "é\nx"), ("ü", "two"), ("q'[x]{y}^?#", "three")]
    df = spark.createDataFrame(own, "doc_type string, value string").repartition(2)
    df = df.unionByName(spark.sql("select 'a' doc_type, cast(unhex('C328') as string) value"))
    write_text_files(df, str(tmp_path / "own"))
    df.write.option("maxRecordsPerFile", 1).partitionBy("doc_type").text(str(tmp_path / "spark"))

    def found(root):
        return sorted((str(p.parent.relative_to(root)), p.read_bytes()) for p in root.rglob("part-*.txt"))

    assert found(tmp_path / "own") == found(tmp_path / "spark") and len(found(tmp_path / "own")) == 7
    assert sum(p.is_file() for p in (tmp_path / "own").rglob("*")) == 7
    write_text_files(df.limit(0), "file:" + str(tmp_path / "none"))
    assert scan_corpus_files(spark, str(tmp_path / "none")).count() == 0


def test_tasks_list_and_read_a_mounted_tree(spark, tmp_path):
    """Same files, sizes and bytes as ``binaryFile``, whose index of the files would be in the driver."""
    root = tmp_path / "a b%20é"
    for name in ("x.txt", "doc_type=a/y.txt", "doc_type=a/deep/er/z.txt", "_k=1/in.txt", "_k=1.txt", "_no/n.txt", "_no.txt", ".h/n.txt", ".h.txt", "d/.part.txt", "d/e.txt",
                 "d/m.TXT", "d/m.Md", "d/m.md.bak", "d/c.txt._COPYING_", "_metadata/f.txt", "d/_metadata.txt", "d/(1)+[2]{3},4.txt", "d.txt/f.txt", "empty.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"" if name == "empty.txt" else name.encode() * 3)
    (root / "link.txt").symlink_to(root / "x.txt")
    (root / "gone.txt").symlink_to(root / "nothing")
    for at in (str(root), f"file:{root}/", f"file://{root}"):
        for glob in ("*.txt", "*.{[tT][xX][tT],[mM][dD]}", None):
            r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            want = (r.option("pathGlobFilter", glob) if glob else r).load(at).collect()
            want = sorted((x.path.removeprefix("file:"), x.length, bytes(x.content)) for x in want)
            listing, bodies = FS._scan(spark, at, glob, True), FS.read_bodies(spark, at, 1 << 20, glob, True)
            assert "binaryFile" not in formatted(listing) and "binaryFile" not in formatted(bodies)
            assert sorted(tuple(x) for x in listing.collect()) == [x[:2] for x in want]
            assert sorted((x.path, bytes(x.content)) for x in bodies.collect()) == [(p, c) for p, _, c in want]
    assert {x.path for x in FS.read_bodies(spark, str(root), 20, "*.txt", True).collect()} == {f"{root}/{n}" for n in ("x.txt", "link.txt")}
    assert FS._mounted(spark, "hdfs://h/x") is None and FS._mounted(spark, str(root / "*")) is None and FS._scan(spark, str(tmp_path / "none"), None, True) is None
