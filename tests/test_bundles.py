"""A8/W2/SNK1/SRC10 bundle round trip, A10 counts, P13 markdown properties."""
import os

from quire.operators import bundles as B
from quire.operators.markdown import html_to_markdown, html_to_markdown_text

SEP = "=" * 80


def test_block_layout_and_roundtrip(spark, tmp_path):
    pages = spark.createDataFrame([("api", 2, "https://x/b", "second"), ("api", 1, "https://x/a", "first"),
                                   ("api", 3, "https://x/c", ""), ("other", 7, "https://y/", "solo")],
                                  "doc_type string, ord int, url string, text string")
    blocks = B.bundle_blocks(pages, "2025/11/20 12:00:00")
    first = blocks.where("doc_type = 'api' AND is_first").first()
    assert first.block == ("---\ndoc_type: api\ncrawled_at: 2025/11/20 12:00:00\nfirst_url: https://x/a\n---\n\n"
                           f"# Page: https://x/a\n\nfirst\n\n{SEP}\n\n")
    out = str(tmp_path / "bundles")
    B.write_bundles(blocks, out, num_partitions=3)
    files = sorted(os.listdir(os.path.join(out, "doc_type=api")))
    text = "".join(open(os.path.join(out, "doc_type=api", f), encoding="utf-8").read()
                   for f in files if f.endswith(".txt"))
    expected = "".join(r.block for r in blocks.where("doc_type = 'api'").orderBy("ord").collect())
    assert text == expected
    back = B.read_bundles(spark, out)
    got = sorted((r.doc_type, r.url, r.text) for r in back.collect())
    assert got == [("api", "https://x/a", "first"), ("api", "https://x/b", "second"), ("api", "https://x/c", ""),
                   ("other", "https://y/", "solo")]
    counts = {r.doc_type: (r.page_count, r.empty_pages) for r in B.pages_per_doc_type(pages).collect()}
    assert counts == {"api": (3, 1), "other": (1, 0)}


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    """Splits that cut blocks and separators anywhere; order and numbers stay."""
    pages = [(f"https://h/{i}", f"text {i} é " * (i % 9) + "=" * (i % 3 * 40)) for i in range(120)]
    (tmp_path / "big.txt").write_text("---\ndoc_type: Big\ncrawled_at: 2024/07/01 10:00:00\nfirst_url: https://h/0\n---\n\n"
                                      + "".join(f"# Page: {u}\n\n{t}\n\n{SEP}\n\n" for u, t in pages), encoding="utf-8")
    (tmp_path / "none.txt").write_text("", encoding="utf-8")
    before = {key: spark.conf.get(key) for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "501")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        back = B.read_bundles(spark, str(tmp_path))
        assert back.rdd.getNumPartitions() > 5
        got = sorted((r.block_no, r.url, r.text) for r in back.collect())
        assert got == [(i, u, t) for i, (u, t) in enumerate(pages)]
        assert {(r.doc_type, r.crawled_at, r.first_url) for r in back.collect()} == {("Big", "2024/07/01 10:00:00", "https://h/0")}
        assert back.where("block_no <> page_no").count() == 0
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_read_plain_bundle_files(spark, tmp_path):
    d = tmp_path / "docs"
    d.mkdir()
    (d / "Servo Lib.txt").write_text(
        "---\ndoc_type: Servo Lib\ncrawled_at: 2025/11/17 19:10:09\nfirst_url: https://a/\n---\n\n"
        f"# Page: https://a/\n\nText A\n\n{SEP}\n\n# Page: https://a/b\n\n\n\n{SEP}\n\n", encoding="utf-8")
    (d / "plain.txt").write_text(f"# Page: https://p/\n\nNo front matter\n\n{SEP}\n\n", encoding="utf-8")
    got = sorted((r.doc_type, r.block_no, r.url, r.text, r.crawled_at) for r in B.read_bundles(spark, str(d)).collect())
    assert got == [("Servo Lib", 0, "https://a/", "Text A", "2025/11/17 19:10:09"),
                   ("Servo Lib", 1, "https://a/b", "", "2025/11/17 19:10:09"),
                   ("plain", 0, "https://p/", "No front matter", None)]


def test_markdown_properties(spark):
    cases = {
        "<h2>Wiring the board</h2><div>Seven pins, two of them ground.</div>": ["Wiring the board", "Seven pins, two of them ground."],
        "<body><style>main {margin: 0}</style><main>Solder first<script>let hidden = [];</script> then test</main></body>":
            ["Solder first", "then test"],
        'see <a class=ext href="https://parts.test/list?p=2">the parts list</a>': ["the parts list", "https://parts.test/list?p=2"],
        "<ol><li>cut <em>twice</em></li><li><strong>measure</strong></li></ol><pre><code>pin = 13</code></pre>": ["cut", "twice", "measure", "pin = 13"],
    }
    for html, needles in cases.items():
        md = html_to_markdown_text(html)
        for n in needles:
            assert n in md, (html, md)
        assert "hidden" not in md and "margin" not in md
    assert html_to_markdown_text("<html><body></body></html>") == ""
    assert html_to_markdown_text('<p><img src="a.png" alt="pic">x</p>') == "x"
    df = spark.createDataFrame([(1, "<h1>T</h1>")], "page_id int, html string")
    assert html_to_markdown(df).first().markdown == "# T"


def test_markdown_keeps_all_visible_text():
    assert html_to_markdown_text("<table><tr><td>alpha</td><td>beta</td></tr></table>").split() == ["alpha", "beta"]
    assert html_to_markdown_text("<head><title>no</title></head><noscript>seen</noscript><p>a<template>b<p>c") .split() == ["seen", "ab", "c"]
