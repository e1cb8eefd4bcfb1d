import random

import pytest
from pyspark.sql import functions as F

from opsframe.operators import graph as G
from opsframe.operators import joins
from opsframe.operators import sessions as S

EDGES = [("a", "b", 1), ("a", "c", 2), ("b", "a", 7), ("b", "c", 1), ("b", "d", 3), ("c", "a", 10), ("c", "b", 1), ("c", "d", 2),
         ("d", "c", 6), ("d", "b", 7)]


def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, weight long")


def test_paths_from_every_source(spark):
    got = G.shortest_paths(edges(spark), spark.createDataFrame([(n,) for n in "abcd"], "source string")).collect()
    want = {"a": {"a": (0, None), "b": (1, "a"), "c": (2, "a"), "d": (4, "b")}, "b": {"a": (7, "b"), "b": (0, None), "c": (1, "b"), "d": (3, "b")},
            "c": {"a": (8, "b"), "b": (1, "c"), "c": (0, None), "d": (2, "c")}, "d": {"a": (14, "b"), "b": (7, "d"), "c": (6, "d"), "d": (0, None)}}
    found = {s: {} for s in "abcd"}
    for r in got:
        found[r.source][r.node] = (r.dist, r.pred)
    assert found == want


def test_route(spark):
    metric, path, hops = G.routes(edges(spark), spark.createDataFrame([("a", "d")], "source string, target string"))
    assert metric.first().dist == 4
    assert [r.node for r in path.orderBy("step").collect()] == ["d", "c", "b"]
    assert {(r.node, r.pred): r.paths for r in hops.collect()} == {("d", "b"): 1, ("b", "a"): 2, ("d", "c"): 1, ("c", "a"): 1, ("c", "b"): 1}


def test_unreachable(spark):
    nodes = spark.createDataFrame([("a",), ("z",)], "node string")
    paths = G.shortest_paths(edges(spark), spark.createDataFrame([("a",)], "source string"))
    assert {r.node: r.dist for r in G.with_unreachable(paths, nodes, "a").collect()} == {"a": 0, "z": 16000000}


def test_random_graph_against_bellman_ford(spark):
    rnd = random.Random(3)
    raw = [(rnd.randrange(40), rnd.randrange(40), rnd.randint(1, 9)) for _ in range(120)] + [(0, n, 90) for n in range(20)]  # 0 is a hub
    dist = {0: 0}
    for _ in range(60):
        for a, b, w in raw:
            if a in dist and dist[a] + w < dist.get(b, 10**9):
                dist[b] = dist[a] + w
    df = spark.createDataFrame(raw, "src long, dst long, weight long")
    got = G.distances(df, spark.createDataFrame([(0,)], "source long")).collect()
    assert {r.node: r.dist for r in got} == dist


SWITCH = "\x1b[?1049h"


def editor_model(rows):
    out, editing = [], False
    for seq, marks, typed in rows:
        if marks:
            editing = not (editing or marks == 2)
        elif not editing:
            out.append((seq, typed))
    return out


def test_commands_equal_the_model(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([0, 0, 0, 1, 2, 3, 4]), f"cmd{i}") for i in range(300)]
    df = spark.createDataFrame([("s", i, "out " + SWITCH * m, "[u@h ~]$ " + t) for i, m, t in rows], "s string, seq long, output string, typed string")
    for limit in (20, 10**6):
        got = S.extract_commands(df, ["s"], ["seq"], "output", "typed", rows_per_task=limit).orderBy("seq").collect()
        assert [(r.seq, r.cmd) for r in got] == editor_model(rows)


def test_prompts(spark):
    cases = {"[u@h ~]$ ls": "ls", "root@h:~# id": "id", "mysql> show tables": "show tables", "plain": "plain",
             "[u@h ~]$ old\n[u@h ~]$ new ": "new", "[u@h ~]$ " + "x" * 250: "x" * 200}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert dict(df.select("t", S.typed_command(F.col("t"), 200)).collect()) == cases


def test_comma_join_needs_an_equality(spark):
    left, right = spark.range(5).toDF("a"), spark.range(5).toDF("b")
    assert joins.comma_join(left, right, (F.col("a") == F.col("b")) & (F.col("a") > 1)).count() == 3
    with pytest.raises(ValueError, match="equality"):
        joins.comma_join(left, right, F.col("a") < F.col("b"))


def test_masks_must_be_contiguous(spark):
    addresses = spark.createDataFrame([("10.1.2.3",), ("x",)], "ip string")
    good = spark.createDataFrame([("10.1.0.0", "255.255.0.0"), ("0.0.0.0", "0.0.0.0"), ("1.1.1.1", None)], "net string, mask string")
    assert {r.ip: r.mask for r in joins.segment_of(addresses, "ip", good, "net", "mask").collect()} == {"10.1.2.3": "255.255.0.0", "x": None}
    bad = spark.createDataFrame([("10.1.0.0", "255.0.255.0")], "net string, mask string")
    with pytest.raises(Exception, match="contiguous"):
        joins.segment_of(addresses, "ip", bad, "net", "mask").collect()


def test_pages_around_choices(spark):
    names = spark.range(31).select(F.format_string("n%02d", "id").alias("name"))
    around = lambda *a: tuple(joins.choices_around(names, "name", *a).first())
    assert [around(None, p) for p in (0, 1, 2, 3, 4)] == [(0, 2), (0, 2), (1, 3), (2, 0), (3, 0)]
    assert around("N0", 1) == (0, 0) and around("zz", 2) == (1, 0)


def test_search_from_both_ends_gives_the_same_routes(spark):
    for seed in (1, 2):
        r = random.Random(seed)
        links = [(r.randrange(14), r.randrange(14), r.choice([1, 1, 2, 3])) for _ in range(34)]
        frame = spark.createDataFrame([x for x in links if x[0] != x[1]] + [(20, 21, 1)], "src long, dst long, weight long")
        pairs = spark.createDataFrame([(r.randrange(14), r.randrange(14)) for _ in range(8)] + [(20, 21), (0, 21), (5, 5), (99, 1)], "source long, target long")
        for mine, want in zip(G.pair_routes(frame, pairs), G.routes(frame, pairs)):
            assert sorted(map(tuple, mine.select(*want.columns).collect())) == sorted(map(tuple, want.collect())), (seed, want.columns)


def test_search_from_both_ends_visits_less(spark):
    n = 24  # a grid: a ball around one end holds far more nodes than two balls of half its radius
    cells = [(x, y) for x in range(n) for y in range(n)]
    rows = [(x * n + y, a * n + b, 1) for x, y in cells for a, b in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)) if 0 <= a < n and 0 <= b < n]
    links = G.simple_edges(spark.createDataFrame(rows, "src long, dst long, weight long"))
    mid = (n // 2) * n + n // 2
    best, labels = G.meetings(links, spark.createDataFrame([(mid, mid + 6)], "source long, target long"))
    assert best.first().dist == 6 and labels.count() <= 90 < n * n
