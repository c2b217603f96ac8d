"""Graphs, swarms, alerts and buffers."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meander.operators import alerts, buffer, telemetry
from meander.operators import graph as gr
from meander.operators import swarm as sw


def graphs(spark, wins):
    nodes = [(w, f"n{i}") for w, (n, _) in wins.items() for i in range(n)]
    edges = [(w, f"n{a}", f"n{b}") for w, (_, es) in wins.items() for a, b in es]
    return (
        spark.createDataFrame(nodes, "win int, node string"),
        spark.createDataFrame(edges, "win int, source string, target string"),
    )


def pair(spark):
    return spark.createDataFrame([(0, 1)], "baseline int, current int")


CYCLE, PATH = (4, [(0, 1), (1, 2), (2, 3), (3, 0)]), (4, [(0, 1), (1, 2), (2, 3)])


def test_cycle_against_path(spark):
    r = gr.graph_drift(*graphs(spark, {0: CYCLE, 1: PATH}), pair(spark), "win").first()
    assert r.spectral_distance == pytest.approx(np.sqrt(0.5), abs=1e-6)
    assert r.density_delta == pytest.approx(-1 / 12) and r.is_graph_drifted and r.node_count_delta == 0


def test_density_shift(spark):
    dense = [(a, b) for a in range(5) for b in range(a + 1, 5)]
    r = gr.graph_drift(*graphs(spark, {0: (5, [(0, 1)]), 1: (5, dense)}), pair(spark), "win").first()
    assert r.density_delta == pytest.approx(0.45) and r.is_graph_drifted


def test_empty_side_and_lone_node(spark):
    nodes, edges = graphs(spark, {0: (1, []), 2: PATH})
    one = gr.spectra(nodes, edges, ["win"]).filter("win = 0").first()
    assert (one.n, one.top) == (1, [0.0])
    r = gr.graph_drift(nodes, edges, pair(spark), "win").first()
    assert r.spectral_distance == 0.0


def dense_top(n, edges, k=5):
    a = np.zeros((n, n))
    for s, t in edges:
        if s != t:
            a[s, t] = a[t, s] = 1
    d = a.sum(1)
    inv = np.where(d > 0, 1 / np.sqrt(np.maximum(d, 1)), 0)
    return np.sort(np.linalg.eigvalsh(np.eye(n) - inv[:, None] * a * inv[None]))[::-1][:k]


def test_edge_join_iteration_matches_dense(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 40, (70, 2))] + [(0, i) for i in range(1, 15)]
    nodes, es = graphs(spark, {3: (42, edges), 4: CYCLE})
    out = {r.win: r.top for r in gr.spectra(nodes, es, ["win"], dense_nodes=10).collect()}
    assert np.allclose(out[3], dense_top(42, edges), atol=1e-6)
    assert np.allclose(out[4], dense_top(*CYCLE), atol=1e-9)


def test_large_windows_are_iterated_together(spark, monkeypatch):
    """Windows of different size and structure leave one by one; the steps are those of the slowest one."""
    rng = np.random.default_rng(5)
    ring = [(i, (i + 1) % 30) for i in range(30)]
    clique = [(i, j) for i in range(25) for j in range(i)]
    windows = {0: (30, ring), 1: (25, clique), 2: (40, []), 3: (21, [(0, 1)]), 4: CYCLE}
    for w in range(5, 9):
        windows[w] = (50 + w, [(int(a), int(b)) for a, b in rng.integers(0, 50 + w, (90 + 20 * w, 2))])
    steps = []
    plain = gr._multiply
    monkeypatch.setattr(gr, "_multiply", lambda *a: steps.append(1) or plain(*a))
    nodes, es = graphs(spark, windows)
    out = {r.win: r.top for r in gr.spectra(nodes, es, ["win"], dense_nodes=10).collect()}
    together = len(steps)
    for w, (n, edges) in windows.items():
        assert np.allclose(out[w], dense_top(n, edges), atol=1e-6), w
    steps.clear()
    gr.spectra(*graphs(spark, {8: windows[8]}), ["win"], dense_nodes=10).collect()
    assert 0 < together <= len(steps) + 3


def test_invariants_match_eigenvalues(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 12, (20, 2))]
    r = gr.laplacian_invariants(*graphs(spark, {0: (12, edges)}), ["win"]).first()
    values = dense_top(12, edges, 12)
    assert r.eigen_sum == pytest.approx(values.sum()) and r.eigen_square_sum == pytest.approx((values**2).sum())


def test_payloads_accept_both_endpoint_names(spark):
    df = spark.sql(
        """SELECT 1 AS win, from_json('{"nodes":[{"id":"a"},{"id":"b"}],"edges":[{"source":"a","target":"b"},{"from":"b","to":"a"},{"source":"a","target":"a"}]}',
        'nodes array<struct<id:string>>, edges array<struct<source:string,target:string,`from`:string,`to`:string>>') AS graph_topology"""
    )
    r = gr.pooled_graph(*gr.from_payloads(df, ["win"]), ["win"]).first()
    assert (r.nodes, r.edges, r.density) == (2, 2, 1.0)


def swarm(spark, base, cur):
    rows, traces = [], []
    for w, group in ((0, base), (1, cur)):
        for t, (hops, refl) in enumerate(group):
            traces.append((w, f"{w}-{t}", refl))
            rows += [(w, f"{w}-{t}", i, a) for i, a in enumerate(hops)]
    return (
        spark.createDataFrame(traces, "win int, trace_id string, reflections int"),
        spark.createDataFrame(rows, "win int, trace_id string, pos int, agent string"),
    )


@pytest.mark.parametrize("limit", [0, 10**6])
def test_swarm_entropy(spark, limit):
    args = swarm(spark, [("abab", 1), ("abab", 1)], [("abcacb", 1)])
    r = sw.swarm_drift(*args, pair(spark), "win", group_limit=limit).first()
    assert r.transition_entropy_delta == pytest.approx(2 * np.log(2)) and r.is_swarm_drifted


def test_swarm_reflections_and_idle_traces(spark):
    args = swarm(spark, [("ab", 1), ("", 0)], [("ab", 5), ("", 0)])
    r = sw.swarm_drift(*args, pair(spark), "win").first()
    assert r.avg_reflection_iterations_delta == 4.0 and r.is_swarm_drifted and r.transition_entropy_delta == 0.0


def brute_sent(times, cool):
    out, last = [], None
    for t in times:
        ok = last is None or t >= last + cool
        last = t if ok else last
        out.append(ok)
    return out


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 120), min_size=1, max_size=60))
def test_cooldown_walk_and_links(spark, times):
    times = sorted(times)
    df = spark.createDataFrame([("k", float(t), i) for i, t in enumerate(times)], "key string, ts double, seq long")
    want = brute_sent(times, 10)
    for island in (10**6, 0):
        got = alerts.alert_suppress(df, ["key"], cooldown_s=10.0, island_limit=island).orderBy("seq").collect()
        assert [r.is_sent for r in got] == want


def test_severity(spark):
    df = spark.createDataFrame([(0.3, None), (0.2, None), (0.2, 0.005), (0.2, 0.05)], "js double, p double")
    got = [r[0] for r in df.select(alerts.alert_severity(F.col("js"), F.lit(0.15), F.col("p"))).collect()]
    assert got == ["critical", "warning", "critical", "warning"]


def test_buffers(spark):
    rows = spark.createDataFrame([(i, "retrieval" if i % 3 else "generation") for i in range(60)], "seq long, track string")
    fifo = buffer.vector_fifo(rows, capacity=10)
    assert sorted(r.seq for r in fifo.filter("track = 'retrieval'").collect()) == [53, 55, 56, 58, 59]
    res = buffer.vector_reservoir(rows, capacity=10)
    assert {r.track: r["count"] for r in res.groupBy("track").count().collect()} == {"retrieval": 5, "generation": 5}
    # cutting the stream differently keeps the same sample
    early = buffer.vector_reservoir(rows.filter("seq < 31"), capacity=10)
    merged = buffer.vector_reservoir(early.unionByName(rows.filter("seq >= 31")), capacity=10)
    assert sorted(r.seq for r in merged.collect()) == sorted(r.seq for r in res.collect())
    ready = {r.track: (r.size, r.is_ready) for r in buffer.buffer_ready(res, min_samples=6).collect()}
    assert ready == {"retrieval": (5, False), "generation": (5, False), "total": (10, True)}
    assert buffer.buffer_flush(res, "retrieval").count() == 5 and buffer.buffer_clear(res).count() == 0


@pytest.mark.parametrize("limit", [0, 10**6])
def test_rate(spark, limit):
    rows = spark.createDataFrame([("k", float(t), i) for i, t in enumerate([0, 0, 100, 300, 301, 900])], "key string, ts double, seq long")
    got = telemetry.rate(rows, ["key"], group_limit=limit).orderBy("seq").collect()
    times = [0, 0, 100, 300, 301, 900]
    want = [sum(1 for j, s in enumerate(times) if j <= i and t - 300 <= s) / 300 for i, t in enumerate(times)]
    assert [r.rate for r in got] == pytest.approx(want)


def test_windows_with_few_hubs_are_solved_through_them(spark, monkeypatch):
    """However many nodes hang on the hubs, no step of the iteration is taken; links among hubs and lone nodes count too."""
    rng = np.random.default_rng(8)
    star = [(0, i) for i in range(1, 40)]
    hubs = [(int(a), int(b)) for a, b in zip(rng.integers(0, 5, 150), rng.integers(0, 70, 150), strict=True)]
    windows = {0: (45, star), 1: (80, hubs), 2: (72, [(a, b + 5) for a, b in hubs if b < 60]), 3: (3, [(0, 1)])}
    monkeypatch.setattr(gr, "_multiply", lambda *a: pytest.fail("iterated"))
    monkeypatch.setattr(gr.covered_spectra, "__defaults__", (25,))  # many parts
    out = {r.win: r.top for r in gr.spectra(*graphs(spark, windows), ["win"], dense_nodes=32).collect()}
    for w, (n, edges) in windows.items():
        assert np.allclose(out[w], dense_top(n, edges), atol=1e-9), w


def test_payloads_split_distinct_nodes(spark, monkeypatch):
    """A payload that names a node once per link is split by its distinct nodes."""
    from meander.operators import calibration

    seen = []
    plain = gr.spectra
    monkeypatch.setattr(gr, "spectra", lambda n, e, by: seen.append((n.count(), n.distinct().count())) or plain(n, e, by))
    nodes, edges = graphs(spark, {w: CYCLE for w in range(4)})
    once = calibration.split_half_graph(nodes, edges, "win", iterations=3).first()
    more = calibration.split_half_graph(nodes.union(nodes), edges, "win", iterations=3).first()
    assert once == more and all(rows == distinct for rows, distinct in seen)


def test_links_are_not_stored_or_compared_again(spark, monkeypatch):
    """Edges from one kind of node to another, given once, go to the parts as they are; those of hubs meet no table of degrees."""
    rng = np.random.default_rng(3)
    edges = {(int(a), int(b)) for a, b in zip(rng.integers(0, 4, 200), rng.integers(4, 90, 200), strict=True)}
    nodes, es = graphs(spark, {0: (90, sorted(edges)), 1: (3, [(0, 1)])})
    monkeypatch.setattr(gr, "undirected_links", lambda *a: pytest.fail("compared"))
    links, degrees = gr.links_and_degrees(nodes, es, ["win"], edges_once=True)
    assert links.count() == len(edges) + 1 and degrees.count() == 93
    want = {n: sum(n in e for e in edges) for n in range(90)}
    assert sorted(want.values()) == sorted(r.d for r in degrees.filter("win = 0").collect())
    plans = []
    plain = gr.cut_lineage
    monkeypatch.setattr(gr, "cut_lineage", lambda df: plans.append(df.columns) or plain(df))
    out = gr.oriented_links(links.filter("win = 0"), degrees.filter("win = 0"), ["win"])
    assert plans == [] and out.count() == len(edges)
    top = gr.spectra(nodes, es, ["win"], dense_nodes=32, edges_once=True).filter("win = 0").first().top
    assert np.allclose(top, dense_top(90, sorted(edges)), atol=1e-9)


def test_repeated_edges_without_hubs(spark, monkeypatch):
    """Without ``edges_once`` repeated, turned and unlisted edges count as before; with few hubs sent the rest meets all degrees."""
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 30, (60, 2)) if a != b]
    nodes, es = graphs(spark, {0: (30, pairs), 1: (30, [(a, b) for a, b in pairs if a < 20])})
    want = {r.win: r.top for r in gr.spectra(nodes, es, ["win"]).collect()}
    twice = es.union(es).union(es.select("win", F.col("target").alias("source"), F.col("source").alias("target")))
    twice = twice.union(es.select("win", "source", F.lit("nowhere").alias("target")))
    monkeypatch.setattr(gr, "HUB_ROWS", 2)
    for dense in (2000, 100):
        got = {r.win: r.top for r in gr.spectra(nodes, twice, ["win"], dense_nodes=dense).collect()}
        for w in want:
            assert np.allclose(got[w], want[w], atol=1e-9) and np.allclose(want[w], dense_top(30, pairs if w == 0 else [p for p in pairs if p[0] < 20]), atol=1e-9)


@pytest.mark.parametrize("most, bits", [(2000, 3), (2000, 60), (12, 60)])
def test_pooled_graphs_are_solved_from_one_row_per_link(spark, monkeypatch, most, bits):
    """Graphs of several payloads have the spectra of their unions: hubs, links among them, turned, unlisted and repeated ones."""
    rng = np.random.default_rng(5)
    draw = lambda n: [(int(a), int(b)) for a, b in zip(rng.integers(0, 4, n), rng.integers(0, 40, n), strict=True)]
    payloads = {p: (50, draw(25)) for p in range(6)} | {6: (1, []), 7: (3, [(0, 1), (1, 0), (1, 2)])}
    nodes, edges = graphs(spark, payloads)
    nodes = nodes.filter("win <> 5 OR node NOT IN ('n1', 'n7', '1', '7')").unionByName(nodes.filter("win = 2"))
    of = {g: [int(p) for p in range(6) if rng.integers(0, 2)] for g in range(6)} | {6: [6], 7: [7], 8: [6, 7]}
    members = spark.createDataFrame([(p, g) for g, ps in of.items() for p in ps], "win int, graph int")
    joined = lambda df: df.join(members, "win").drop("win").distinct()
    want = {r.graph: (r.n, r.top) for r in gr.spectra(joined(nodes), joined(edges), ["graph"]).collect()}
    monkeypatch.setattr(gr, "WORD", bits)
    calls, plain = [], gr.spectra
    monkeypatch.setattr(gr, "spectra", lambda *a: calls.append(a) or plain(*a))
    got = {r.graph: (r.n, r.top) for r in gr.pooled_spectra(nodes, edges, members, "win", 9, dense_nodes=most, part_links=20).collect()}
    assert set(got) == set(want) and len(calls) == (most < 100)
    for g, (n, top) in want.items():
        assert got[g][0] == n and np.allclose(got[g][1], top, atol=1e-9), g


def test_half_splits_of_graphs_are_not_one_graph_after_the_other(spark, monkeypatch):
    """No half is made of rows of its own: the links of all are counted once."""
    from meander.operators import calibration

    rng = np.random.default_rng(9)
    windows = {w: (40, [(int(a), int(b)) for a, b in rng.integers(0, 40, (50, 2)) if a != b]) for w in range(6)}
    nodes, edges = graphs(spark, windows)
    splits = calibration.half_splits(nodes.select(F.lit(1).alias("_one"), "win").distinct(), ["_one"], "win", 4).collect()
    gaps = []
    for rep in range(1, 5):
        tops = [dense_top(40, [e for s in splits if s.rep == rep and s.is_current == side for e in windows[s.win][1]]) for side in (False, True)]
        gaps.append(np.sqrt(((np.array(tops[0]) - tops[1]) ** 2).sum()))
    monkeypatch.setattr(gr, "spectra", lambda *a, **k: pytest.fail("graph after graph"))
    row = calibration.split_half_graph(nodes, edges, "win", iterations=4).first()
    assert row.replicates == 4 and row.threshold == pytest.approx(np.mean(gaps) + 2 * np.std(gaps), abs=1e-9)
