"""Ranked lexical search with a document FP-tree, branch and bound per item.

Only terms of the items count, so each document shrinks to its restricted vector: ``(term, tf)`` in order of falling
document frequency.  Documents are dealt to tasks by ranges of these vectors (and ids, so copies can be split); a task
reads them in order and builds a tree for each shard of bounded size.  Documents with a common beginning share a path;
paths without branches are one node, and neighbouring small branches end in one leaf.  Every node knows the greatest tf of
each term below it, the least m and the least id.

An item's score of a document rises with tf and falls with m, so those extremes bound the scores of a subtree.  The
search goes depth first into the best bound, scores the documents of a leaf exactly, and leaves out a subtree that can't
reach the item's last place (nor tie with a smaller id).  Places carry over from shard to shard of a task; a task gives at
most ``top`` rows per item, which are merged in two steps.

Items go through the tasks in blocks of about ``block_bytes`` of text, whose terms and weights ship to the tasks; more
items mean more passes, not larger ones.  Statistics cover all documents.

Null texts and texts without terms take no part.  Rows are documents of their own, also if they share an id; a null id
comes after all others among equal scores.  Repeated items (equal id and text) count once; items that share an id but not
the text are ranked each, under that id.  Items without a scoring document have no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meander.llm.common import materialised, pieces, sliced

#: A term, of the UTF-8 bytes of a text with A-Z lower-cased (fixed value).
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
NOT_TERM = rb"[^0-9A-Za-z\x80-\xff]"
LEAF = 32  # documents of a leaf
SHARD_DOCS, SHARD_ENTRIES = 16_384, 1 << 20
LAST = np.iinfo(np.int64).max  # stands for a null id in comparisons
HEAD = 8  # terms of a vector that deal it to a task


def term_counts(text: str | None) -> Counter:
    found = Counter()
    if text:
        for piece in pieces(text.encode(), NOT_TERM):
            found.update(TERM.findall(piece.lower()))  # bytes.lower folds A-Z only
    return found


def _lists(offsets, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def restricted(docs: DataFrame, vocabulary: dict[bytes, int], *, doc_id: str, text: str) -> DataFrame:
    """``doc_id, n`` (terms with repeats), ``ids, tfs`` (those of the vocabulary) of documents with a term."""

    def run(batches):
        for batch in sliced(batches):
            keep, sizes, ids, tfs, offsets = [], [], [], [], [0]
            for row, body in enumerate(batch.column(1).to_pylist()):
                counts = term_counts(body)
                if not counts:
                    continue
                keep.append(row)
                sizes.append(sum(counts.values()))
                for term in counts.keys() & vocabulary.keys():
                    ids.append(vocabulary[term])
                    tfs.append(counts[term])
                offsets.append(len(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()),
                 _lists(offsets, ids), _lists(offsets, tfs)], names=["doc_id", "n", "ids", "tfs"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(
        run, "doc_id long, n long, ids array<int>, tfs array<int>")


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and values of a list column."""
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    return sizes, column.flatten().to_numpy(zero_copy_only=False)


def _ordered(vectors: DataFrame, rank: np.ndarray, n_docs: int, length: int) -> DataFrame:
    """``doc_id, m, head, path, tfs``: vectors in rank order of their terms."""

    def run(batches):
        for batch in batches:
            sizes, ids = _flat(batch.column(2))
            tfs = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            path = rank[ids]
            order = np.lexsort((path, row))
            path = path[order]
            offsets = np.append(0, np.cumsum(sizes))
            first = np.minimum(sizes, HEAD)
            head_offsets = np.append(0, np.cumsum(first))
            at = np.repeat(offsets[:-1] - head_offsets[:-1], first) + np.arange(head_offsets[-1])
            m = [75 + 25 * n * n_docs // length for n in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(m, pa.int64()), _lists(head_offsets, path[at]), _lists(offsets, path),
                 _lists(offsets, tfs[order])], names=["doc_id", "m", "head", "path", "tfs"])

    return vectors.mapInArrow(run, "doc_id long, m long, head array<int>, path array<int>, tfs array<int>")


def _saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _greatest(key: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the greatest tf of each."""
    order = np.argsort(key, kind="stable")
    key, tf = key[order], tf[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    return key[first], np.maximum.reduceat(tf, first) if len(first) else tf


class Tree:
    """The FP-tree of documents in path order: ``ids, m, sizes`` per document, ``terms, tfs`` of all in a row."""

    def __init__(self, ids, m, sizes, terms, tfs, n_terms: int):
        self.ids, self.off, self.terms = ids, np.append(0, np.cumsum(sizes)), terms
        self.factor = _saturated(tfs, np.repeat(m, sizes))
        self.begin, self.end, self.children, parent = [], [], [], []
        level = []
        stack = [(0, len(ids), 0, -1, 0)]
        while stack:
            a, b, depth, above, deep = stack.pop()
            node = len(self.begin)
            self.begin.append(a)
            self.end.append(b)
            self.children.append([])
            parent.append(above)
            level.append(deep)
            if above >= 0:
                self.children[above].append(node)
            stack += [(*part, node, deep + 1) for part in self._parts(a, b, depth)]
        self._summarise(np.array(parent), np.array(level), m, tfs, n_terms)

    def _parts(self, a: int, b: int, depth: int) -> list[tuple[int, int, int]]:
        """``(a, b, depth)`` of the branches below a node; none for a leaf."""
        if b - a <= LEAF:
            return []
        off, terms = self.off, self.terms
        first, final = terms[off[a] + depth : off[a + 1]], terms[off[b - 1] + depth : off[b]]
        n = min(len(first), len(final))
        differ = np.flatnonzero(first[:n] != final[:n])
        depth += int(differ[0]) if len(differ) else n  # what all of them share
        at = off[a:b] + depth
        ended = at == off[a + 1 : b + 1]
        step = np.where(ended, -1, terms[np.minimum(at, len(terms) - 1)])
        edges = (np.flatnonzero(step[1:] != step[:-1]) + a + 1).tolist()
        out, start = [], a
        for x, y in zip([a, *edges], [*edges, b], strict=True):
            if y - x <= LEAF:  # small neighbours end in one leaf
                if y - start > LEAF:
                    out.append((start, x, depth))
                    start = x
                continue
            if start < x:
                out.append((start, x, depth))
            if step[x - a] < 0:  # equal vectors: cut by number
                out += [(i, min(i + LEAF, y), depth) for i in range(x, y, LEAF)]
            else:
                out.append((x, y, depth + 1))
            start = y
        if start < b:
            out.append((start, b, depth))
        return out

    def _summarise(self, parent, level, m, tfs, n_terms):
        """Greatest tf per node and term, least m and id per node; bottom up."""
        nodes = len(self.begin)
        least_m, least_id = np.full(nodes, LAST), np.full(nodes, LAST)
        leaves = np.array([i for i in range(nodes) if not self.children[i]])
        begin = np.array(self.begin)
        order = leaves[np.argsort(begin[leaves], kind="stable")]
        least_m[order] = np.minimum.reduceat(m, begin[order])
        least_id[order] = np.minimum.reduceat(self.ids, begin[order])
        docs = np.diff(np.append(begin[order], len(self.ids)))
        owner = np.repeat(np.repeat(order, docs), np.diff(self.off))
        found = {}
        key, tf = _greatest(owner * n_terms + self.terms, tfs)
        at_leaf = level[key // n_terms]
        for deep in range(int(level.max()), -1, -1):
            own = [(key[at_leaf == deep], tf[at_leaf == deep])]
            if deep + 1 in found:
                k, t = found[deep + 1]
                own.append((parent[k // n_terms] * n_terms + k % n_terms, t))
                kids = np.flatnonzero(level == deep + 1)
                np.minimum.at(least_m, parent[kids], least_m[kids])
                np.minimum.at(least_id, parent[kids], least_id[kids])
            found[deep] = _greatest(np.concatenate([x for x, _ in own]), np.concatenate([x for _, x in own]))
        key, tf = (np.concatenate([f[i] for f in found.values()]) for i in (0, 1))
        by_term = np.argsort(key % n_terms, kind="stable")
        key, tf = key[by_term], tf[by_term]
        self.node = key // n_terms
        self.node_factor = _saturated(tf, least_m[self.node])
        self.slot = np.searchsorted(key % n_terms, np.arange(n_terms + 1))
        self.least_id = least_id

    def search(self, weights: dict[int, int], dense: np.ndarray, places: list, top: int, mark: int) -> None:
        """Put the documents that reach a place into ``places``, a heap of ``(score, -id, mark, row)``.

        ``weights``: of the item's terms, repeats counted; ``dense``: zeros, one per term; ``mark``: number of the tree.
        """
        bound = np.zeros(len(self.begin), np.int64)
        for term, weight in weights.items():
            part = slice(self.slot[term], self.slot[term + 1])
            bound[self.node[part]] += weight * self.node_factor[part]
            dense[term] = weight
        low, low_id = (places[0][0], -places[0][1]) if len(places) == top else (0, LAST)
        stack = [0]
        while stack:
            node = stack.pop()
            reach = bound[node]
            if reach < low or reach <= 0 or (reach == low and self.least_id[node] >= low_id):
                continue
            if self.children[node]:
                stack += sorted(self.children[node], key=bound.__getitem__)  # the best bound is taken first
                continue
            a, b = self.begin[node], self.end[node]
            part = slice(self.off[a], self.off[b])
            score = np.add.reduceat(dense[self.terms[part]] * self.factor[part], self.off[a:b] - self.off[a])
            for row in np.flatnonzero((score > low) | ((score == low) & (score > 0))).tolist():
                entry = (int(score[row]), -int(self.ids[a + row]), mark, a + row)
                if len(places) < top:
                    heapq.heappush(places, entry)
                elif entry[:2] > places[0][:2]:
                    heapq.heapreplace(places, entry)
            if len(places) == top:
                low, low_id = places[0][0], -places[0][1]
        for term in weights:
            dense[term] = 0


def _found(ordered: DataFrame, items: list[tuple[int, dict[int, int]]], n_terms: int, top: int) -> DataFrame:
    """``item, doc_id, score``: the best ``top`` of every task for every item (by number)."""

    def run(batches):
        places = [[] for _ in items]
        dense = np.zeros(n_terms, np.int64)
        held, docs, entries = [], 0, 0

        def searched():
            ids, m, sizes, terms, tfs = (np.concatenate([h[i] for h in held]) for i in range(5))
            tree = Tree(ids, m, sizes, terms, tfs, n_terms)
            for (_, weights), heap in zip(items, places, strict=True):
                tree.search(weights, dense, heap, top, 0)

        for batch in sliced(batches, 512):
            sizes, terms = _flat(batch.column(2))
            ids = batch.column(0).fill_null(LAST).to_numpy()
            held.append((ids, batch.column(1).to_numpy(), sizes, terms, _flat(batch.column(3))[1]))
            docs, entries = docs + len(ids), entries + len(terms)
            if docs >= SHARD_DOCS or entries >= SHARD_ENTRIES:
                searched()
                held, docs, entries = [], 0, 0
        if docs:
            searched()
        rows = [(number, None if -i == LAST else -i, score)
                for (number, _), heap in zip(items, places, strict=True) for score, i, *_ in heap]
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    return ordered.select("doc_id", "m", "path", "tfs").mapInArrow(run, "item long, doc_id long, score long")


def _best(rows: DataFrame, by: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(
    docs: DataFrame, items: DataFrame, *, top: int = 20, block_bytes: int = 4 << 20, doc_id: str = "doc_id",
    text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of every item with a score above 0."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    asked = asked.where(F.col("text").isNotNull()).distinct()
    size = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    threads = spark.sparkContext.defaultParallelism
    found = []
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else asked
        own = [(r.item_id, term_counts(r.text)) for r in own.collect()]  # about block_bytes
        vocabulary = {term: i for i, term in enumerate(sorted(set().union(*(c for _, c in own))))}
        if not vocabulary:
            continue
        vectors = materialised(restricted(docs, vocabulary, doc_id=doc_id, text=text), "vectors")
        n_docs, length, entries = vectors.agg(
            F.count(F.lit(1)), F.sum("n"), F.sum(F.size("ids").cast("long"))
        ).first()
        if not entries:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for r in vectors.select(F.explode("ids").alias("id")).groupBy("id").count().collect():
            df[r.id] = r["count"]
        rank = np.empty(len(df), np.int32)
        rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
        weight = [math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * d + 1))) for d in df.tolist()]
        wanted = []
        for number, (_, counts) in enumerate(own):
            terms = ((vocabulary[t], c) for t, c in counts.items())
            wanted.append((number, {int(rank[i]): c * weight[i] for i, c in terms if df[i] and weight[i]}))
        parts = max(math.ceil(entries / (1 << 24)), min(3 * threads, math.ceil(entries / (1 << 18))))
        ordered = _ordered(vectors.where(F.size("ids") > 0), rank, int(n_docs), int(length))
        ordered = ordered.repartitionByRange(parts, "head", "doc_id").sortWithinPartitions("path", "doc_id")
        best = _found(ordered, wanted, len(df), top).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
        best = _best(_best(best, ["item", "part"], top).drop("rank"), ["item"], top)
        names = spark.createDataFrame(
            [(number, key) for number, (key, _) in enumerate(own)], f"item long, item_id {asked.schema['item_id'].dataType.simpleString()}"
        )
        found.append(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"),
                            F.lit(0).cast("long").alias("score")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def sql(top: int = 20) -> str:
    """The same in DuckDB SQL."""
    terms = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {terms} AS terms FROM documents),
q AS (SELECT row_number() OVER () AS qid, item_id, {terms} AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark)),
qt AS MATERIALIZED (SELECT qid, item_id, t, count(*) AS qtf FROM (SELECT qid, item_id, unnest(terms) AS t FROM q)
  GROUP BY qid, item_id, t),
tf AS MATERIALIZED (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(terms) AS t FROM d)
  WHERE t IN (SELECT t FROM qt) GROUP BY rid, t),
st AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS length FROM d WHERE len(terms) > 0),
w AS (SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
  FROM tf, st GROUP BY t, n_docs),
m AS (SELECT rid, doc_id, 100 - 25 + (25 * len(terms) * n_docs) // length AS m FROM d, st WHERE len(terms) > 0),
s AS (SELECT qt.qid, qt.item_id, m.doc_id,
    CAST(sum(qt.qtf * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * m.m))) AS BIGINT) AS score
  FROM qt JOIN tf ON qt.t = tf.t JOIN w ON w.t = qt.t JOIN m ON m.rid = tf.rid GROUP BY qt.qid, qt.item_id, m.rid, m.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= {top}"""
