"""Topology drift of retrieved sub-graphs.

Graphs come as long tables: ``nodes(by..., node)`` and
``edges(by..., source, target)``; :func:`from_payloads` makes them from frames.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meander.functions.runtime import cut_lineage

DENSE_NODES = 2000
COVER_SHARE = 4  # a window is solved through a cover of up to ``dense_nodes / COVER_SHARE`` nodes
PART_LINKS = 250_000  # links one task multiplies
HUB_ROWS = 50_000  # of the nodes with the most links, sent to all tasks
SPECTRAL_K = 5
WORD = 60  # graphs of a number of bits


def from_payloads(frames: DataFrame, by: list[str], graph: str = "graph_topology") -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of frames that carry a graph; endpoints fall back to ``from``/``to``."""
    g = F.col(graph)
    nodes = frames.select(*by, F.explode(g["nodes"]["id"]).alias("node")).filter(F.col("node").isNotNull())
    end = lambda a, b: F.coalesce(F.col(f"e.{a}"), F.col(f"e.{b}"), F.lit("None"))
    edges = frames.select(*by, F.explode(g["edges"]).alias("e")).select(
        *by, end("source", "from").alias("source"), end("target", "to").alias("target")
    )
    return nodes, edges


def distinct_edges(edges: DataFrame, by: list[str], edges_once: bool = False) -> DataFrame:
    """Distinct directed edges without self loops or blank ends; ``edges_once``: the given rows do not repeat."""
    real = (F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target"))
    real = edges.filter(real).select(*by, "source", "target")
    return real if edges_once else real.distinct()


def edge_union(*edge_tables: DataFrame, by: list[str]) -> DataFrame:
    """Distinct edges over several payload tables."""
    out = edge_tables[0]
    for t in edge_tables[1:]:
        out = out.unionByName(t)
    return distinct_edges(out, by)


def pooled_graph(nodes: DataFrame, edges: DataFrame, by: list[str], edges_once: bool = False) -> DataFrame:
    """Distinct node and edge counts of each window, with the directed density."""
    v = nodes.select(*by, "node").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("nodes"))
    e = distinct_edges(edges, by, edges_once).groupBy(*by).agg(F.count(F.lit(1)).alias("edges"))
    both = v.join(e, by, "full").na.fill(0, ["nodes", "edges"])
    possible = F.col("nodes").cast("double") * (F.col("nodes") - 1)
    return both.withColumn(
        "density", F.when(F.col("nodes") < 2, F.lit(0.0)).otherwise(F.col("edges") / possible)
    )


def undirected_links(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Each link among listed nodes once, as ``by, u, v``."""
    listed = nodes.select(*by, "node").distinct()
    real = (F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target"))
    pairs = edges.filter(real).select(
        *by, F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")
    ).distinct()
    return pairs.join(listed.withColumnRenamed("node", "u"), [*by, "u"], "left_semi").join(
        listed.withColumnRenamed("node", "v"), [*by, "v"], "left_semi"
    )


def both_ways(links: DataFrame, by: list[str]) -> DataFrame:
    """Links ``by, u, v`` from either end."""
    both = F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return links.select(*by, F.inline(both))


def neighbours(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Undirected adjacency ``by, u, v`` (both directions) among listed nodes."""
    return both_ways(undirected_links(nodes, edges, by), by)


def links_and_degrees(
    nodes: DataFrame, edges: DataFrame, by: list[str], edges_once: bool = False
) -> tuple[DataFrame, DataFrame]:
    """:func:`undirected_links`, and ``by, node, d`` of all listed nodes (stored).

    Where no node has links both as source and as target, and all ends are listed, the distinct edges already are the
    links: they are counted in one pass, and neither compared with the nodes nor stored again.
    """
    real = distinct_edges(edges, by, edges_once)
    if not edges_once:
        real = cut_lineage(real)
    end = lambda name, o, i: F.struct(F.col(name).alias("node"), F.lit(o).alias("o"), F.lit(i).alias("i"), F.lit(False).alias("own"))
    ends = real.select(*by, F.inline(F.array(end("source", 1, 0), end("target", 0, 1))))
    listed = nodes.select(*by, "node", F.lit(0).alias("o"), F.lit(0).alias("i"), F.lit(True).alias("own"))
    count = ends.unionByName(listed).groupBy(*by, "node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.max("own").alias("own"))
    count = cut_lineage(count)
    if count.filter(((F.col("o") > 0) & (F.col("i") > 0)) | ~F.col("own")).isEmpty():
        return real.select(*by, F.col("source").alias("u"), F.col("target").alias("v")), count.select(
            *by, "node", (F.col("o") + F.col("i")).alias("d")
        )
    links = cut_lineage(undirected_links(nodes, real, by))
    marked = both_ways(links, by).select(*by, F.col("u").alias("node"), F.lit(1).alias("o"))
    d = marked.unionByName(listed.select(*by, "node", "o")).groupBy(*by, "node").agg(F.sum("o").alias("d"))
    return links, cut_lineage(d)


def laplacian_invariants(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Sum and sum of squares of the normalized Laplacian's eigenvalues, from degrees alone."""
    adj = neighbours(nodes, edges, by)
    deg = adj.groupBy(*by, "u").agg(F.count(F.lit(1)).alias("d"))
    weighted = adj.join(deg.withColumnRenamed("d", "du"), [*by, "u"]).join(
        deg.select(*by, F.col("u").alias("v"), F.col("d").alias("dv")), [*by, "v"]
    )
    cross = weighted.groupBy(*by).agg(F.sum(F.lit(1.0) / (F.col("du") * F.col("dv"))).alias("s"))
    v = nodes.select(*by, "node").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    single = F.col("n") == 1
    return v.join(cross, by, "left").select(
        *by, F.col("n").alias("nodes"),
        F.when(single, F.lit(0.0)).otherwise(F.col("n").cast("double")).alias("eigen_sum"),
        F.when(single, F.lit(0.0)).otherwise(F.col("n") + F.coalesce("s", F.lit(0.0))).alias("eigen_square_sum"),
    )


def spectra(
    nodes: DataFrame, edges: DataFrame, by: list[str], k: int = SPECTRAL_K, dense_nodes: int = DENSE_NODES,
    edges_once: bool = False,
) -> DataFrame:
    """The ``k`` largest eigenvalues of each window's normalized Laplacian, descending.

    A window all whose links have an end among few nodes is solved through these, whatever its size, see
    :func:`covered_spectra`.  Another window up to ``dense_nodes`` nodes is solved in one task.  Larger ones are
    iterated together with edge joins, see :func:`largest_eigenvalues`.  With ``edges_once`` no edge repeats
    within a window: they are read several times as they stand; without, their distinct ones are stored first.
    """
    spark = nodes.sparkSession
    links, degrees = links_and_degrees(nodes, edges, by, edges_once)
    sizes, adj, covered = covered_spectra(links, degrees, by, k, dense_nodes // COVER_SHARE)
    fields = [f"{b} {nodes.schema[b].dataType.simpleString()}" for b in by]
    schema = ", ".join([*fields, "n long, top array<double>"])

    def dense(pdf):
        n = int(pdf["n"].iloc[0])
        links = pdf.dropna(subset=["u"])
        names = pd.unique(links["u"])
        index = {name: i for i, name in enumerate(names)}
        a = np.zeros((len(names), len(names)))
        a[links["u"].map(index).to_numpy(dtype=int), links["v"].map(index).to_numpy(dtype=int)] = 1.0
        scale = 1.0 / np.sqrt(a.sum(1)) if len(names) else np.zeros(0)
        values = np.linalg.eigvalsh(np.eye(len(names)) - scale[:, None] * a * scale[None, :]) if len(names) else []
        # nodes without links have eigenvalue 1; a lone node has 0
        rest = [0.0] if n == 1 else [1.0] * (n - len(names))
        top = sorted([*values, *rest], reverse=True)[:k]
        return pd.DataFrame({**{b: [pdf[b].iloc[0]] for b in by}, "n": [n], "top": [[float(x) for x in top]]})

    small = sizes.filter(F.col("n") <= dense_nodes)
    if sizes.isEmpty():
        return covered
    out = small.join(adj, by, "left").select(*by, "n", "u", "v").groupBy(*by).applyInPandas(dense, schema)
    out = out.unionByName(covered)
    large = sizes.filter(F.col("n") > dense_nodes).collect()  # one row per large window
    if not large:
        return out
    keys = [(*[row[b] for b in by], i) for i, row in enumerate(large)]
    numbers = F.broadcast(spark.createDataFrame(keys, ", ".join([*fields, "g int"])))
    on = F.expr(" AND ".join(f"l.`{b}` <=> r.`{b}`" for b in by))
    own = lambda df, names: df.alias("l").join(numbers.alias("r"), on).select("r.g", *[f"l.{n}" for n in names])
    top = largest_eigenvalues(own(nodes.select(*by, "node").distinct(), ["node"]), own(adj, ["u", "v"]), k)
    return out.unionByName(
        spark.createDataFrame([(*[row[b] for b in by], row["n"], top[i]) for i, row in enumerate(large)], schema)
    )


def oriented_links(links: DataFrame, degrees: DataFrame, by: list[str]) -> DataFrame:
    """``by, u, v, d``: each link from its end with more links (the later name if equal), which has ``d`` of them.

    The few nodes with the most links are broadcast, and settle every link that has one of them.  Only links without
    meet the degrees of all nodes.
    """
    total = degrees.agg(F.sum("d")).first()[0] or 0
    hubs = degrees.filter(F.col("d") >= max(1, -(-total // HUB_ROWS)))  # at most HUB_ROWS of them
    of = lambda df, end: df.select(*by, F.col("node").alias(end), F.col("d").alias(f"d{end}"))
    near = links.join(F.broadcast(of(hubs, "u")), [*by, "u"], "left").join(F.broadcast(of(hubs, "v")), [*by, "v"], "left")
    far = near.filter("du IS NULL AND dv IS NULL").select(*by, "u", "v")
    near = near.filter("du IS NOT NULL OR dv IS NOT NULL").na.fill(0, ["du", "dv"])
    if not far.isEmpty():
        far = far.join(of(degrees, "u"), [*by, "u"]).join(of(degrees, "v"), [*by, "v"])
        near = near.unionByName(cut_lineage(far))
    heavier = (F.col("du") > F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") > F.col("v")))
    pick = lambda a, b: F.when(heavier, F.col(a)).otherwise(F.col(b))
    return near.select(*by, pick("u", "v").alias("u"), pick("v", "u").alias("v"), pick("du", "dv").alias("d"))


def covered_spectra(
    links: DataFrame, degrees: DataFrame, by: list[str], k: int, cover_nodes: int, part_links: int = PART_LINKS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes and links of the other windows, and the leading eigenvalues of those covered by up to ``cover_nodes`` nodes.

    The end of a link with more links covers it (the later name if equal), so links between the remaining nodes do not
    exist.  With ``C`` the normalized links inside the cover, ``B`` those to the rest and ``L L' = B B'``, the matrix
    ``[[C, L], [L', 0]]`` has the eigenvalues of the whole but for zeros.  ``B B'`` is a sum over the rest: tasks add up parts
    of it, one pass over the links, and a window's matrix has twice as many rows as its cover.  A node of the rest has all
    its links in one part, so the links travel without degrees; those of the cover come in at the end.
    """
    fields = [f"{b} {degrees.schema[b].dataType.simpleString()}" for b in by]
    links_from = oriented_links(links, degrees, by)
    cover = links_from.groupBy(*by, "u").agg(F.max("d").alias("d"))
    sizes = degrees.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.sum("d") / 2).alias("_links"))
    known = sizes.join(cover.groupBy(*by).agg(F.count(F.lit(1)).alias("_cover")), by, "left")
    known = cut_lineage(known.withColumn("_cover", F.when(F.col("_cover") <= cover_nodes, F.col("_cover"))))  # one row per window
    few, others = known.filter("_cover IS NOT NULL"), known.filter("_cover IS NULL").select(*by, "n")
    light = F.broadcast if known.count() <= HUB_ROWS else lambda df: df
    cover = cut_lineage(cover.join(light(few.select(*by, "n", "_links")), by))
    spread = lambda name: F.pmod(F.xxhash64(name), F.ceil(F.col("_links") / part_links)).alias("_part")
    # a node of the cover goes without ``u`` to the part of its own links
    placed = links_from.join(light(few.select(*by, "_links")), by).select(*by, "u", "v", spread("v")).unionByName(
        cover.select(*by, F.lit(None).cast(degrees.schema["node"].dataType).alias("u"), F.col("u").alias("v"), spread("u"))
    )

    def part(pdf):
        """Links inside the cover as they are; of the others the products of those that share an end, added up."""
        inner = pdf["v"].isin(pdf.loc[pdf["u"].isna(), "v"]).to_numpy()
        linked = pdf["u"].notna().to_numpy()
        own, rest = pdf[linked & inner], pdf[linked & ~inner]
        at, names = pd.factorize(rest["u"].to_numpy(), sort=True)
        to, shared = pd.factorize(rest["v"].to_numpy())
        gram = np.zeros((len(names), len(names)))
        order = np.argsort(to, kind="stable")
        at, to = at[order], to[order]
        w = 1.0 / np.sqrt(np.bincount(to))[to] if len(to) else np.zeros(0)
        for i in range(0, len(shared), 1024):
            lo, hi = np.searchsorted(to, [i, i + 1024])
            b = np.zeros((len(names), min(1024, len(shared) - i)))
            b[at[lo:hi], to[lo:hi] - i] = w[lo:hi]
            gram += b @ b.T
        i, j = np.nonzero(np.triu(gram))
        out = pd.DataFrame({
            "inside": np.repeat([True, False], [len(own), len(i)]), "u": [*own["u"], *names[i]], "v": [*own["v"], *names[j]],
            "w": np.concatenate([np.ones(len(own)), gram[i, j]]),
        })
        for number, b in enumerate(by):
            out.insert(number, b, pdf[b].iloc[0])
        return out

    name = degrees.schema["node"].dataType.simpleString()
    sums = placed.groupBy(*by, "_part").applyInPandas(part, ", ".join([*fields, f"inside boolean, u {name}, v {name}, w double"]))
    sums = sums.groupBy(*by, "inside", "u", "v").agg(F.sum("w").alias("w"))

    def solved(nodes, pdf):
        n, parts = int(nodes["n"].iloc[0]), []
        index = {x: i for i, x in enumerate(nodes["u"])}
        scale = 1.0 / np.sqrt(nodes["d"].to_numpy(dtype=float))
        for inside in (True, False):
            rows = pdf[pdf["inside"] == inside]
            i, j = rows["u"].map(index).to_numpy(dtype=int), rows["v"].map(index).to_numpy(dtype=int)
            m = np.zeros((len(nodes), len(nodes)))
            m[i, j] = m[j, i] = rows["w"].to_numpy(dtype=float) * scale[i] * scale[j]
            parts.append(m)
        values, vectors = np.linalg.eigh(parts[1])
        root = vectors * np.sqrt(np.where(values > 1e-14 * values[-1], values, 0.0))
        values = np.linalg.eigvalsh(np.block([[parts[0], root], [root.T, np.zeros_like(root)]]))
        low, high = values[values < -1e-9], values[values > 1e-9]
        top = [*(1.0 - low), *[1.0] * (n - len(low) - len(high)), *(1.0 - high)][:k]
        return pd.DataFrame({**{b: [nodes[b].iloc[0]] for b in by}, "n": [n], "top": [[float(x) for x in top]]})

    out = cover.groupBy(*by).cogroup(sums.groupBy(*by)).applyInPandas(solved, ", ".join([*fields, "n long, top array<double>"]))
    left = both_ways(links.join(light(others.select(*by)), by, "left_semi"), by)
    unnamed = links.filter(reduce(or_, [F.col(b).isNull() for b in by]))  # no join above keeps them
    return others, left.unionByName(both_ways(unnamed, by)), out


def graph_bits(members: DataFrame, payload_id: str, graphs: int) -> DataFrame:
    """``payload_id, m0, ...`` of ``payload_id, graph`` rows: the graphs a payload belongs to (from 0) as bits of a few numbers."""
    bit = F.expr(f"shiftleft(1L, CAST(graph % {WORD} AS INT))")
    return members.groupBy(payload_id).agg(*[
        F.bit_or(F.when(F.floor(F.col("graph") / WORD) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{w}")
        for w in range(-(-graphs // WORD))
    ])


def pooled_spectra(
    nodes: DataFrame, edges: DataFrame, members: DataFrame, payload_id: str, graphs: int, k: int = SPECTRAL_K,
    dense_nodes: int = DENSE_NODES, part_links: int = PART_LINKS,
) -> DataFrame:
    """``graph, n, top``: leading eigenvalues of graphs that are unions of the payloads which ``members`` names.

    A node or link is one row with the graphs it is in as bits (:func:`graph_bits`), however many graphs and payloads share
    it.  If at most ``dense_nodes / COVER_SHARE`` nodes have an end of every link of all graphs, each graph is solved through
    those that it links, as in :func:`covered_spectra`: one pass over the links adds up the parts of all graphs.  Others are
    given to :func:`spectra` graph by graph.
    """
    spark, words = nodes.sparkSession, [f"m{w}" for w in range(-(-graphs // WORD))]
    bits = graph_bits(members, payload_id, graphs)
    both = [F.bit_or(w).alias(w) for w in words]
    listed = nodes.join(bits, payload_id).groupBy("node").agg(*both)
    real = (F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target"))
    pairs = edges.filter(real).select(payload_id, F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v"))
    links = cut_lineage(pairs.join(bits, payload_id).groupBy("u", "v").agg(*both))

    def ends(links):
        """``node``, the number of its links, and the graphs of these (``l0``, ...) and of the node."""
        none = [F.lit(0).cast("long").alias(w) for w in words]
        linked = [F.col(w).alias("l" + w[1:]) for w in words]
        rows = links.select(F.inline(F.array(F.struct(F.col("u").alias("node")), F.struct(F.col("v").alias("node")))), F.lit(1).alias("d"), *linked, *none)
        own = listed.select("node", F.lit(0).alias("d"), *[F.lit(0).cast("long").alias("l" + w[1:]) for w in words], *words)
        return cut_lineage(rows.unionByName(own).groupBy("node").agg(
            F.sum("d").alias("d"), *[F.bit_or(c).alias(c) for c in ("l" + w[1:] for w in words)], *both
        ))

    count = ends(links)
    unlisted = reduce(or_, [F.col("l" + w[1:]).bitwiseAND(F.bitwise_not(F.col(w))) != 0 for w in words])
    if not count.filter(unlisted).isEmpty():  # a link is one where both its ends are listed
        for end in ("u", "v"):
            own = count.select(F.col("node").alias(end), *[F.col(w).alias("l" + w[1:]) for w in words])
            links = links.join(own, end).select("u", "v", *[F.col(w).bitwiseAND(F.col("l" + w[1:])).alias(w) for w in words])
        links = cut_lineage(links.filter(reduce(or_, [F.col(w) != 0 for w in words])))
        count = ends(links)
    has = lambda g: F.shiftright(F.col(words[g // WORD]), g % WORD).bitwiseAND(F.lit(1))
    total = count.agg(F.sum("d"), *[F.sum(has(g)) for g in range(graphs)]).first()
    sizes = {g: n for g, n in enumerate(total[1:]) if n}

    hubs = count.filter("d > 0").orderBy(F.desc("d"), F.desc("node")).limit(dense_nodes // COVER_SHARE).select("node").collect()
    ranks = spark.createDataFrame([(r.node, i) for i, r in enumerate(hubs)], f"node {count.schema['node'].dataType.simpleString()}, i int")
    of = lambda end, name: F.broadcast(ranks.select(F.col("node").alias(end), F.col("i").alias(name)))
    near = links.join(of("u", "ru"), "u", "left").join(of("v", "rv"), "v", "left")
    if not near.filter("ru IS NULL AND rv IS NULL").isEmpty():
        each = F.explode(F.filter(F.array(*[F.when(has(g) == 1, F.lit(g)) for g in range(graphs)]), lambda g: g.isNotNull())).alias("graph")
        found = spectra(
            cut_lineage(count.select(each, "node")), links.select(each, F.col("u").alias("source"), F.col("v").alias("target")), ["graph"], k
        )
        return found.select("graph", "n", "top")

    first = F.col("rv").isNull() | (F.col("ru") < F.col("rv"))  # the end with more links
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    placed = near.select(pick("ru", "rv").alias("i"), F.coalesce(pick("rv", "ru"), F.lit(-1)).alias("j"), pick("v", "u").alias("v"), *words)
    cover = sorted(r.i for r in placed.select("i").distinct().collect())
    index = np.full(len(hubs) + 1, -1)
    index[cover] = np.arange(len(cover))
    size = len(cover)
    parts = max(1, -(-(total[0] or 0) // 2 // part_links))

    def part(pdf):
        """Per graph of a part: links inside the cover, products of the others, and how many each node of the cover has."""
        at, to = index[pdf["i"].to_numpy()], index[pdf["j"].to_numpy()]
        inner = to >= 0
        to = np.where(inner, to, pd.factorize(pdf["v"])[0])
        order = np.argsort(to, kind="stable")
        at, to, inner = at[order], to[order], inner[order]
        marks, step, out = [pdf[w].to_numpy()[order] for w in words], max(1024, (1 << 20) // size), []
        for g in range(graphs):
            on = (marks[g // WORD] >> (g % WORD)) & 1 == 1
            if not on.any():
                continue
            inside, gram = np.zeros((size, size)), np.zeros((size, size))
            a, b = at[on & inner], to[on & inner]
            inside[a, b] = inside[b, a] = 1.0
            a, b = at[on & ~inner], to[on & ~inner]
            d = inside.sum(1) + np.bincount(a, minlength=size)
            b = np.cumsum(np.append(False, b[1:] != b[:-1])) if len(b) else b
            w = 1.0 / np.sqrt(np.bincount(b))[b] if len(b) else np.zeros(0)
            for lo in range(0, int(b[-1]) + 1 if len(b) else 0, step):
                i, j = np.searchsorted(b, [lo, lo + step])
                m = np.zeros((size, int(b[j - 1]) - lo + 1))
                m[a[i:j], b[i:j] - lo] = w[i:j]
                gram += m @ m.T
            out.append((g, int(pdf["_part"].iloc[0]), inside.tobytes(), gram.tobytes(), d.tobytes()))
        return pd.DataFrame(out, columns=["graph", "part", "inside", "gram", "d"])

    part_of = F.pmod(F.xxhash64("v"), F.lit(parts)).alias("_part")
    sums = placed.select("*", part_of).groupBy("_part").applyInPandas(part, "graph int, part long, inside binary, gram binary, d binary")

    def solved(own, pdf):
        g, n = int(own["graph"].iloc[0]), int(own["n"].iloc[0])
        rows = pdf.sort_values("part")
        add = lambda name: sum((np.frombuffer(x) for x in rows[name]), np.zeros(1))
        d = add("d")
        top = [0.0] if n == 1 else [1.0] * min(n, k)  # without links
        if len(rows):
            some = np.flatnonzero(d > 0)
            scale = 1.0 / np.sqrt(d[some])
            inside, gram = (add(c).reshape(size, size)[np.ix_(some, some)] * scale[:, None] * scale for c in ("inside", "gram"))
            values, vectors = np.linalg.eigh(gram)
            root = vectors * np.sqrt(np.where(values > 1e-14 * max(values[-1], 0.0), values, 0.0))
            values = np.linalg.eigvalsh(np.block([[inside, root], [root.T, np.zeros_like(root)]]))
            low, high = values[values < -1e-9], values[values > 1e-9]
            top = [*(1.0 - low), *[1.0] * (n - len(low) - len(high)), *(1.0 - high)][:k]
        return pd.DataFrame({"graph": [g], "n": [n], "top": [[float(x) for x in top]]})

    whole = spark.createDataFrame(list(sizes.items()), "graph int, n long")
    return whole.groupBy("graph").cogroup(sums.groupBy("graph")).applyInPandas(solved, "graph int, n long, top array<double>")


def largest_eigenvalues(nodes: DataFrame, adj: DataFrame, k: int, tol: float = 1e-7) -> dict[int, list[float]]:
    """Block Lanczos for all large graphs ``g`` at once: edge joins multiply, small Gram matrices per graph steer.

    The basis is a table with one row per node.  A step joins it with the edges, sums per node, and orthogonalizes with
    inner products of at most a few hundred columns; every step is the same few jobs however many graphs there are.  A graph
    leaves when the residuals of its ``k`` leading pairs are at most ``tol`` (a bound of the values' errors) or its space
    is exhausted.
    """
    width = k + 3
    deg = adj.groupBy("g", "u").agg(F.count(F.lit(1)).cast("double").alias("d"))
    links = adj.join(deg.withColumnRenamed("d", "du"), ["g", "u"]).join(
        deg.select("g", F.col("u").alias("v"), F.col("d").alias("dv")), ["g", "v"]
    ).select("g", "u", "v", (F.lit(1.0) / F.sqrt(F.col("du") * F.col("dv"))).alias("w"))
    links = cut_lineage(links)
    start = F.array(*[
        (F.pmod(F.xxhash64("node", F.lit(c)), F.lit(1 << 20)) / F.lit(float(1 << 20)) - 0.5) for c in range(width)
    ])
    state = cut_lineage(nodes.select("g", "node", F.array().cast("array<double>").alias("q"), start.alias("w")))
    basis: dict[int, np.ndarray] = {}  # the Laplacian in each graph's basis
    done: dict[int, list[float]] = {}
    inner = _inner(state)
    while inner:
        state, inner = _orthonormal(state, inner)
        for g in set(basis) - set(inner) - set(done):  # nothing left outside the span
            done[g] = _leading(basis[g], k)
        if not inner:
            break
        state = _multiply(state, links, width)
        inner = _inner(state)
        settled = []
        for g, (s, gram) in inner.items():
            m, added = s.shape
            grown = np.zeros((m, m))
            if g in basis:
                grown[: m - added, : m - added] = basis[g]
            grown[:, m - added:] = s
            grown[m - added:, :] = s.T
            basis[g] = grown
            # only what the newest columns are mapped to can lie outside the span
            _, vectors = np.linalg.eigh(grown)
            newest = vectors[m - added:, ::-1][:, :k]
            residual = ((gram - s.T @ s) @ newest * newest).sum(axis=0)
            if m >= k and np.sqrt(np.maximum(residual, 0.0)).max() <= tol:
                done[g] = _leading(grown, k)
                settled.append(g)
        if settled:
            inner = {g: v for g, v in inner.items() if g not in done}
            state = state.where(~F.col("g").isin(settled))
    return done


def _leading(matrix: np.ndarray, k: int) -> list[float]:
    return [float(x) for x in np.linalg.eigvalsh(matrix)[::-1][:k]]


def _multiply(state: DataFrame, links: DataFrame, width: int) -> DataFrame:
    """Set ``w`` to the Laplacian times the newest basis columns, of which there are as many as ``w`` holds."""
    size = F.size("w")
    newest = state.select("g", F.col("node").alias("v"), F.slice("q", -size, size).alias("x"))
    sums = links.join(newest, ["g", "v"]).groupBy("g", "u").agg(
        *[F.sum(F.col("w") * F.get("x", F.lit(i))).alias(f"s{i}") for i in range(width)]
    )
    parts = F.slice(F.array(*[F.coalesce(F.col(f"s{i}"), F.lit(0.0)) for i in range(width)]), F.lit(1), size)
    out = state.join(sums.withColumnRenamed("u", "node"), ["g", "node"], "left").select(
        "g", "node", "q", F.zip_with(F.slice("q", -size, size), parts, lambda a, b: a - b).alias("w")
    )
    return cut_lineage(out)


def _inner(state: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """``Q' W`` and ``W' W`` of each graph (summed per task first)."""

    def run(batches):
        totals: dict = {}
        for pdf in batches:
            for g, part in pdf.groupby("g", sort=False):
                w = np.vstack(part["w"].to_numpy())
                qw = np.hstack([np.vstack(part["q"].to_numpy()), w])
                totals[g] = totals.get(g, 0.0) + qw.T @ w
        for g, total in totals.items():
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"g": g, "i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    rows = state.select("g", "q", "w").mapInPandas(run, "g int, i int, j int, s double")
    sums = rows.groupBy("g", "i", "j").agg(F.sum("s").alias("s")).toPandas()
    out = {}
    for g, part in sums.groupby("g"):
        total = np.zeros((part["i"].max() + 1, part["j"].max() + 1))
        total[part["i"], part["j"]] = part["s"]
        m = len(total) - total.shape[1]
        out[int(g)] = (total[:m], total[m:])
    return out


def _orthonormal(state: DataFrame, inner: dict) -> tuple[DataFrame, dict]:
    """Append to ``q`` the part of ``w`` outside its span, orthonormal; twice for accuracy.

    Graphs without such a part leave.  ``inner`` is that of ``state``; the graphs that stay are returned with theirs.
    """
    for attempt in range(2):
        steps = {}
        for g, (s, gram) in inner.items():
            rest = gram - s.T @ s
            values, vectors = np.linalg.eigh((rest + rest.T) / 2)
            keep = values > 1e-12 * max(float(np.trace(gram)), 1e-300) if attempt == 0 else values > 0.25
            if keep.any():
                steps[g] = (s, vectors[:, keep] / np.sqrt(values[keep]))

        def run(batches, steps=steps):
            for pdf in batches:
                for g, part in pdf.groupby("g", sort=False):
                    if g not in steps:
                        continue
                    s, into = steps[g]
                    w, q = np.vstack(part["w"].to_numpy()), np.vstack(part["q"].to_numpy())
                    yield part.assign(w=list((w - q @ s) @ into))[["g", "node", "q", "w"]]

        state = cut_lineage(state.mapInPandas(run, state.schema))
        inner = {g: v for g, v in inner.items() if g in steps}
        if not inner:
            return state, {}
        if attempt == 0:
            inner = _inner(state)
    return cut_lineage(state.select("g", "node", F.concat("q", "w").alias("q"), "w")), inner


def window_pairs(summary: DataFrame, pairs: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Baseline (``b_``) and current (``c_``) columns of each window pair."""
    side = lambda tag, key: summary.select(
        F.col(by).alias(key), *[F.col(c).alias(f"{tag}_{c}") for c in columns]
    )
    return pairs.join(side("b", "baseline"), "baseline", "left").join(side("c", "current"), "current", "left")


def graph_density_delta(pooled: DataFrame, pairs: DataFrame, by: str) -> DataFrame:
    """Density and node-count differences; a window without graphs counts as empty."""
    both = window_pairs(pooled, pairs, by, ["nodes", "density"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select(
        "baseline", "current",
        (zero("c_density") - zero("b_density")).cast("double").alias("density_delta"),
        (zero("c_nodes") - zero("b_nodes")).alias("node_count_delta"),
    )


def graph_spectral_distance(spectrum: DataFrame, pairs: DataFrame, by: str) -> DataFrame:
    """L2 distance of the leading eigenvalues both windows have; 0 if either is empty."""
    both = window_pairs(spectrum, pairs, by, ["top"])
    shared = F.least(F.size("b_top"), F.size("c_top"))
    gaps = F.zip_with(F.slice("b_top", 1, shared), F.slice("c_top", 1, shared), lambda a, b: (a - b) * (a - b))
    dist = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x))
    ok = F.col("b_top").isNotNull() & F.col("c_top").isNotNull()
    return both.select("baseline", "current", F.when(ok, dist).otherwise(F.lit(0.0)).alias("spectral_distance"))


def graph_drift(
    nodes: DataFrame, edges: DataFrame, pairs: DataFrame, by: str,
    spectral_threshold: float = 0.5, density_threshold: float = 0.1, k: int = SPECTRAL_K, edges_once: bool = False,
) -> DataFrame:
    """Spectral distance, density and node-count deltas of window pairs, with the verdict.

    ``edges_once``: no edge repeats within a window, so that they need not be made distinct.
    """
    if not edges_once:
        edges = cut_lineage(distinct_edges(edges, [by]))
    density = graph_density_delta(pooled_graph(nodes, edges, [by], True), pairs, by)
    spectral = graph_spectral_distance(spectra(nodes, edges, [by], k, edges_once=True), pairs, by)
    verdict = (F.col("spectral_distance") > F.lit(float(spectral_threshold))) | (
        F.abs("density_delta") > F.lit(float(density_threshold))
    )
    return density.join(spectral, ["baseline", "current"]).withColumn("is_graph_drifted", verdict)
