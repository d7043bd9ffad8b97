"""SRC1, SRC3, SNK3: JSON registries."""
import json

import pytest

from quire.sources import registry as R


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_url_registry_keeps_order(spark, tmp_path):
    doc = {"apis": {"Board Docs": {"name": "Board Docs", "url": "https://docs.board.example/", "description": "d"},
                    "Kit Docs": {"name": "Kit Docs", "url": "https://docs.kit.example/ja/start"}}}
    df = R.scan_url_registry(spark, write(tmp_path, "u.json", json.dumps(doc)))
    rows = [tuple(r) for r in df.orderBy("pos").collect()]
    assert rows == [(0, "Board Docs", "Board Docs", "https://docs.board.example/", "d"),
                    (1, "Kit Docs", "Kit Docs", "https://docs.kit.example/ja/start", None)]
    entries, count = R.list_registry(df)
    assert count.first()["count"] == 2


@pytest.mark.parametrize("text", ["{not json", '{"other": {}}'])
def test_url_registry_errors(spark, tmp_path, text):
    with pytest.raises(R.RegistryError):
        R.scan_url_registry(spark, write(tmp_path, "u.json", text))


def test_url_registry_missing_file(spark, tmp_path):
    with pytest.raises(R.RegistryError):
        R.scan_url_registry(spark, str(tmp_path / "nope.json"))


def test_store_registry_legacy_and_array(spark, tmp_path):
    doc = {"rags": {"alpha": {"rag_id": "g1", "created_at": "2024/03/09 21:14:05", "doc_type": "alpha"},
                    "beta": [{"rag_id": "a1", "created_at": "2023/12/31 06:30:59"}, {"rag_id": "a2"}]}}
    df = R.scan_store_registry(spark, write(tmp_path, "r.json", json.dumps(doc)))
    got = sorted((r.doc_type, r.pos, r.rag_id, r.created_at) for r in df.collect())
    assert got == [("alpha", 0, "g1", "2024/03/09 21:14:05"), ("beta", 0, "a1", "2023/12/31 06:30:59"),
                   ("beta", 1, "a2", None)]


def test_store_registry_empty_cases(spark, tmp_path):
    assert R.scan_store_registry(spark, str(tmp_path / "missing.json")).count() == 0
    assert R.scan_store_registry(spark, write(tmp_path, "n.json", '{"x": 1}')).count() == 0


@pytest.mark.parametrize("text", ["{bad", "[1, 2]", '{"rags": [1]}'])
def test_store_registry_errors(spark, tmp_path, text):
    with pytest.raises(R.RegistryError):
        R.scan_store_registry(spark, write(tmp_path, "r.json", text))


def test_export_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, "r1", "2025/11/15 12:00:00", None), ("a", 1, "r2", None, "d")],
                               R.STORES_DDL)
    out = str(tmp_path / "export")
    R.export_store_registry(df, out)
    back = R.scan_store_registry_lines(spark, out)
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def test_multiline_json_document(spark, tmp_path):
    doc = {"apis": {"A": {"name": "A", "url": "https://a/"}, "B": {"name": "B", "url": "https://b/"}}}
    df = R.scan_url_registry(spark, write(tmp_path, "u.json", json.dumps(doc, indent=2)))
    assert [r.keyword for r in df.orderBy("pos").collect()] == ["A", "B"]
