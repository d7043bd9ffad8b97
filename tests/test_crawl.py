"""G2/G3 breadth-first crawl: fixture graphs and minimum-depth property."""
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from quire.operators.crawl import LinkTable, Visited, bfs, crawl_registry, crawl_run_stats, crawl_runs, next_level
from .conftest import exchange_children

SEED = "https://example.com/docs"


def run(spark, edges, max_depth, leaves=None):
    e = spark.createDataFrame(edges or [("x", "y")], "src string, dst string")
    if not edges:
        e = e.limit(0)
    s = spark.createDataFrame([("d", SEED)], "seed string, url string")
    lv = spark.createDataFrame([(u,) for u in leaves], "url string") if leaves else None
    return {r.url: r.depth for r in bfs(e, s, max_depth, leaves=lv).collect()}


def test_single_page(spark):
    assert run(spark, [], 0) == {SEED: 0}


def test_one_hop(spark):
    assert run(spark, [(SEED, SEED + "/page2")], 1) == {SEED: 0, SEED + "/page2": 1}


def test_depth_limit(spark):
    edges = [(SEED, SEED + "/page2"), (SEED + "/page2", SEED + "/page3")]
    assert run(spark, edges, 1) == {SEED: 0, SEED + "/page2": 1}


def test_cycle_visited_once(spark):
    p2, p3 = SEED + "/page2", SEED + "/page3"
    edges = [(SEED, p2), (SEED, p3), (p2, p3), (p3, SEED)]
    assert run(spark, edges, 2) == {SEED: 0, p2: 1, p3: 1}


def test_failed_page_is_leaf(spark):
    p2, p3, p4 = SEED + "/page2", SEED + "/page3", SEED + "/page2/x"
    edges = [(SEED, p2), (SEED, p3), (p2, p4)]
    assert run(spark, edges, 2, leaves=[p2]) == {SEED: 0, p2: 1, p3: 1}


def test_min_depth_matches_python_bfs(spark):
    rnd = random.Random(7)
    nodes = list(range(60))
    edges = sorted({(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(150)})
    e = spark.createDataFrame(edges, "src long, dst long")
    seeds = spark.createDataFrame([("a", 0), ("b", 1)], "seed string, url long")
    got = {(r.seed, r.url): r.depth for r in bfs(e, seeds, 3).collect()}
    adj = {}
    for a, b in edges:
        adj.setdefault(a, []).append(b)
    want = {}
    for name, start in (("a", 0), ("b", 1)):
        dist, dq = {start: 0}, deque([start])
        while dq:
            u = dq.popleft()
            if dist[u] == 3:
                continue
            for v in adj.get(u, []):
                if v not in dist:
                    dist[v] = dist[u] + 1
                    dq.append(v)
        want.update({(name, k): v for k, v in dist.items()})
    assert got == want


def test_registry_runs_and_stats(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    reg = spark.createDataFrame([("A", 1), ("B", 9)], "keyword string, url long")
    reached = crawl_registry(edges, reg, 3)
    runs = {r.doc_type: r for r in crawl_runs(reg, reached).collect()}
    assert runs["A"].page_count == 3 and runs["A"].success
    assert runs["B"].page_count == 1
    stats = crawl_run_stats(crawl_runs(reg, reached)).first()
    assert (stats.total_apis, stats.successful_apis, stats.failed_apis, stats.total_pages) == (2, 2, 0, 4)


def python_bfs(edges, starts, depth, keep=lambda seed, url: True):
    adj = {}
    for a, b in edges:
        adj.setdefault(a, []).append(b)
    out = {}
    for seed, start in starts:
        dist, dq = {start: 0}, deque([start])
        while dq:
            u = dq.popleft()
            for v in adj.get(u, []) if dist[u] < depth else []:
                if v not in dist and keep(seed, v):
                    dist[v] = dist[u] + 1
                    dq.append(v)
        out.update({(seed, k): v for k, v in dist.items()})
    return out


@pytest.mark.parametrize("hub_degree", [1, 3, 100_000])
def test_hub_pieces_change_nothing(spark, hub_degree):
    rnd = random.Random(hub_degree)
    edges = [(0, n) for n in range(1, 50)] + [(n, 0) for n in range(1, 50)] + [(rnd.randrange(90), rnd.randrange(90)) for _ in range(120)]
    e = spark.createDataFrame(edges + edges[:20] + [(None, 1), (0, None)], "src long, dst long")
    starts = [("a", 60), ("b", 0), ("c", 3)]
    got = bfs(e, spark.createDataFrame(starts, "seed string, url long"), 4, hub_degree=hub_degree).collect()
    assert {(r.seed, r.url): r.depth for r in got} == python_bfs(edges, starts, 4) and len(got) == len({(r.seed, r.url) for r in got})


def test_hub_is_split_and_visited_stays_put(spark):
    """A hub's links lie in several buckets; a level shuffles neither the links nor the visited rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    names = []
    try:
        edges = spark.range(400).selectExpr("0L as src", "id + 1 as dst").unionByName(spark.range(20).selectExpr("id + 1 as src", "0L as dst"))
        links = LinkTable.write(edges, hub_degree=50)
        visited = Visited.start(spark.createDataFrame([("a", 0)], "seed string, url long"))
        names = [links.name, visited.name]
        files = spark.table(links.name).where("src = 0").groupBy(F.input_file_name()).count().collect()
        assert len(files) > 3 and max(r["count"] for r in files) < 250
        assert [r.pieces for r in links.hubs.collect()] == [8]
        level = next_level(visited, links, visited.level(0))
        level.collect()
        inputs = exchange_children(spark, level)
        assert inputs and not any("quire_edges" in scan for scan in inputs), inputs
        assert all("(depth" in scan for scan in inputs if "quire_visited" in scan), inputs  # the frontier only
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_scope_of_the_seed(spark):
    """Two seeds walk one graph, each within its own part of it."""
    edges = [("/a", "/a/1"), ("/a/1", "/b"), ("/b", "/b/1"), ("/b/1", "/a/2"), ("/a/1", "/a/2"), ("/a/2", "/a/3")]
    e = spark.createDataFrame(edges, "src string, dst string")
    starts = [("A", "/a"), ("B", "/b"), ("C", "/a"), ("D", "/b")]
    scope = {"A": "/a", "B": "/b", "C": None}
    got = bfs(e, spark.createDataFrame(starts, "seed string, url string"), 5,
              scopes=spark.createDataFrame(list(scope.items()), "seed string, scope string"))
    want = python_bfs(edges, starts, 5, lambda seed, url: url.startswith(scope.get(seed) or ""))
    assert {(r.seed, r.url): r.depth for r in got.collect()} == want


def test_no_tables_left(spark):
    """The catalog is clean after a crawl, and after one that fails."""
    before = {t.name for t in spark.catalog.listTables()}
    run(spark, [(SEED, SEED + "/p")], 2)
    with pytest.raises(Exception):
        bfs(spark.createDataFrame([("x", "y")], "src string, dst string"), spark.createDataFrame([("d", "x")], "seed string, url string"), 2,
            leaves=spark.createDataFrame([(1,)], "no_url int"))
    assert {t.name for t in spark.catalog.listTables()} == before
