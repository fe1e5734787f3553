"""Exact ranked lexical search by dual trees.

Items (the queries) and documents are vectors over the items' terms: an item's coordinate is its terms' weight times their repeats, a document's the
saturated frequency. Both are put into trees by halving on the coordinate that varies most; a node holds, for each coordinate, the largest of its
vectors. The product of two nodes' maxima bounds every score between them, so a pair of nodes is dropped as a whole when its bound
is below the weakest kth score of the node's items; else the larger node is opened, the best bound first. No score is estimated: what is
not dropped is computed in whole numbers.

Statistics of the corpus come from one pass over the documents, which keeps their vectors alone. Each task searches its documents, a tree a batch,
starting from the kth scores that a first part of them gave, and sends the k best of each item to the final ranking.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costfield.shared import materialise

TOP = 20
#: Items searched for in one pass, about; their vectors and tree are sent to all tasks.
ITEMS = 512
#: Vectors in a leaf.
DOC_LEAF, ITEM_LEAF = 32, 8
#: So many of the first tables' partitions are searched ahead, for first kth scores.
AHEAD = 1
#: Tasks whose rankings of an item are put together before the last ranking, in so many parts.
PARTS = 64
_KEPT = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(k + 32 if 65 <= k <= 90 else k if k >= 128 or k in _KEPT else 32 for k in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode(errors="surrogatepass").translate(_TABLE).split()


class Vectors:
    """Sparse rows: row k has the coordinates ``at[start[k]:start[k + 1]]``, with ``value``."""

    def __init__(self, start: np.ndarray, at: np.ndarray, value: np.ndarray, width: int):
        self.start, self.at, self.value, self.width = start, at, value, width

    def places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the rows' coordinates, and the number (in ``rows``) of the row of each."""
        sizes = self.start[rows + 1] - self.start[rows]
        own = np.repeat(np.arange(len(rows)), sizes)
        return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.start[rows], sizes), own


class Tree:
    """Nodes in order of their making: ``rows`` of each, its two ``children`` (none: a leaf), and its coordinates' maxima, sparse."""

    def __init__(self, vectors: Vectors, leaf: int, scale: np.ndarray | None = None):
        self.rows, self.children, self.at, self.most = [np.arange(len(vectors.start) - 1)], [None], [], []
        k = 0
        while k < len(self.rows):
            rows = self.rows[k]
            places, own = vectors.places(rows)
            at, value = vectors.at[places], vectors.value[places]
            most = np.zeros(vectors.width, np.int64)
            np.maximum.at(most, at, value)
            held = np.flatnonzero(most)
            self.at.append(held)
            self.most.append(most[held])
            if len(rows) > leaf:
                scaled = value * (1.0 if scale is None else scale[at])
                mean = np.bincount(at, scaled, vectors.width) / len(rows)
                spread = np.bincount(at, scaled * scaled, vectors.width) / len(rows) - mean * mean
                here = at == int(spread.argmax())
                along = np.zeros(len(rows), np.int64)
                along[own[here]] = value[here]
                order = np.argsort(-along, kind="stable")
                half = len(rows) // 2
                self.children[k] = (len(self.rows), len(self.rows) + 1)
                self.rows += [rows[np.sort(order[:half])], rows[np.sort(order[half:])]]
                self.children += [None, None]
            k += 1


class Items:
    """The items of a pass: their vectors over their own terms, and their tree."""

    def __init__(self, items: list[tuple], documents: int, length: int, frequency: dict[int, int], terms: dict[bytes, int]):
        self.ids, self.documents, self.length = [i for i, _ in items], documents, length
        weight = [floor(1000 * log((2 * documents + 2) / (2 * frequency.get(k, 0) + 1))) for k in range(len(terms))]
        start, at, value = [0], [], []
        for _, text in items:
            for term, n in Counter(terms_of(text)).items():
                at.append(terms[term])
                value.append(n * weight[terms[term]])
            start.append(len(at))
        self.vectors = Vectors(np.array(start), np.array(at, np.int64), np.array(value, np.int64), len(terms))
        self.weight = np.array(weight, float)
        self.tree = Tree(self.vectors, ITEM_LEAF)


class Search:
    """The k best documents of each item so far, over any number of batches; ``known`` are scores that each item's kth has at least."""

    def __init__(self, items: Items, top: int, known: dict[int, int]):
        self.items, self.top = items, top
        self.best: list[list[tuple]] = [[] for _ in items.ids]
        self.floor = [known.get(k, 1) for k in range(len(items.ids))]
        self.pairs = self.scored = 0

    def weakest(self, node: int) -> tuple[int, tuple]:
        """Of the node's items, the least kth score; and the last document that holds such a place."""
        least, last = None, (False, 0)
        for i in self.items.tree.rows[node].tolist():
            full = len(self.best[i]) == self.top
            kth = max(self.floor[i], -self.best[i][-1][0]) if full else self.floor[i]
            held = self.best[i][-1][1:] if full and -self.best[i][-1][0] == kth else (True, 1 << 63)
            if least is None or kth < least:
                least, last = kth, held
            elif kth == least:
                last = max(last, held)
        return least, last

    def batch(self, ids: list, n: np.ndarray, start: np.ndarray, at: np.ndarray, tf: np.ndarray) -> None:
        """Search a batch of documents: their ids, lengths, and terms with frequencies."""
        items = self.items
        if not len(items.ids) or not len(at):
            return
        m = 75 + np.array([25 * k * items.documents // items.length for k in n.tolist()], np.int64)
        value = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, np.diff(start)))
        docs = Vectors(start, at, value, items.vectors.width)
        tree = Tree(docs, DOC_LEAF, items.weight)
        keys = [(k is None, k or 0) for k in ids]
        first = [min(keys[r] for r in rows.tolist()) for rows in tree.rows]
        dense = np.zeros(items.vectors.width, np.int64)

        def bounds(some: list[int], nodes: list[int]) -> list[int]:
            out = []
            for d in nodes:
                dense[tree.at[d]] = tree.most[d]
                out += [int(dense[items.tree.at[i]] @ items.tree.most[i]) for i in some]
                dense[tree.at[d]] = 0
            return out

        heap: list[tuple] = []

        def push(some: list[int], nodes: list[int]) -> None:
            pairs = [(i, d) for d in nodes for i in some]
            for (i, d), bound in zip(pairs, bounds(some, nodes), strict=True):
                self.pairs += 1
                least, last = self.weakest(i)
                if bound > least or bound == least and first[d] < last:
                    heapq.heappush(heap, (-bound, first[d], i, d))

        push([0], [0])
        while heap:
            bound, _, i, d = heapq.heappop(heap)
            least, last = self.weakest(i)
            if -bound < least or -bound == least and first[d] >= last:
                continue
            i_children, d_children = items.tree.children[i], tree.children[d]
            if i_children is None and d_children is None:
                self.leaves(docs, keys, items.tree.rows[i], items.tree.at[i], tree.rows[d])
            elif d_children is None or i_children is not None and len(items.tree.rows[i]) * DOC_LEAF > len(tree.rows[d]) * ITEM_LEAF:
                push(list(i_children), [d])
            else:
                push([i], list(d_children))

    def leaves(self, docs: Vectors, keys: list[tuple], some: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
        """All scores between two leaves."""
        vectors = self.items.vectors
        column = np.full(vectors.width, -1)
        column[at] = np.arange(len(at))
        places, own = vectors.places(some)
        asked = np.zeros((len(some), len(at)), np.int64)
        seen = vectors.value[places] > 0  # a term that all documents have weighs nothing
        asked[own[seen], column[vectors.at[places][seen]]] = vectors.value[places][seen]
        places, own = docs.places(rows)
        kept = column[docs.at[places]] >= 0
        held = np.zeros((len(rows), len(at)), np.int64)
        held[own[kept], column[docs.at[places][kept]]] = docs.value[places[kept]]
        scores = asked @ held.T
        self.scored += scores.size
        for i, row in zip(some.tolist(), scores, strict=True):
            best = self.best[i]
            least = -best[-1][0] if len(best) == self.top else 1
            good = np.flatnonzero(row >= max(least, self.floor[i], 1))
            if len(good):
                best += [(-int(row[j]), *keys[rows[j]]) for j in good.tolist()]
                best.sort()
                del best[self.top :]


_VECTORS = "part int, doc_id long, n long, terms array<int>, tf array<int>"
_FOUND = "item int, item_id long, doc_id long, score long, part int"


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _vectors(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = sent.value.get, TaskContext.get().partitionId()
        for batch in batches:
            n, at, tf = [], [], []
            for text in batch.column("text"):
                words = terms_of(text.as_py())
                found = Counter(map(known, words))
                found.pop(None, None)
                n.append(len(words))
                at.append(list(found))
                tf.append(list(found.values()))
            kinds = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(at, kinds), pa.array(tf, kinds)], names=["part", "doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _VECTORS)


def _frequencies(vectors: DataFrame, width: int) -> DataFrame:
    """(term, df): summed within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=width)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["term", "df"])

    return vectors.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _search(vectors: DataFrame, items: Items, top: int, known: dict[int, int]) -> DataFrame:
    sent = vectors.sparkSession.sparkContext.broadcast((items, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, known = sent.value
        search = Search(items, top, known)
        for batch in batches:
            start, at = _lists(batch.column("terms"))
            search.batch(batch.column("doc_id").to_pylist(), batch.column("n").to_numpy(), start, at, _lists(batch.column("tf"))[1])
        rows = [(i, items.ids[i], None if null else doc, -score) for i, best in enumerate(search.best) for score, null, doc in best]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        part = pa.array([TaskContext.get().partitionId()] * len(rows), pa.int32())
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), part], names=["item", "item_id", "doc_id", "score", "part"])

    return vectors.filter(F.size("terms") > 0).mapInArrow(run, _FOUND)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    by = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = F.row_number().over(Window.partitionBy("item", F.pmod("part", F.lit(PARTS))).orderBy(*by))
    found = found.withColumn("rank", some).filter(F.col("rank") <= top)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).filter(F.col("rank") <= top)


def lexical_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` documents (doc_id, text, ...) of each item (item_id, text, ...): item_id, rank (from 1), doc_id, score.

    With N documents of a term or more and L terms in all, a term's weight is w = floor(1000 ln((2N + 2) / (2 df + 1))); a document of n terms has
    m = 75 + 25 n N div L, and scores the sum of w (10^9 tf div (1000 tf + 12 m)) over the item's terms with repeats. Equal scores go by ascending doc_id.

    Defined cases: a null or empty text has no terms, so such a document never ranks, and such an item has no rows; rows of ``docs`` that repeat
    are documents each; rows of ``items`` that repeat wholly are one item, those that share an item_id alone are ranked each; null ids rank last and stay null;
    empty tables give no rows; whole texts are read. Other columns are ignored.
    """
    asked = materialise(items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct(), "items")
    passes = max(1, -(-asked.count() // ITEMS))
    out = []
    for k in range(passes):
        block = [tuple(r) for r in asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()]
        block.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        terms = {t: i for i, t in enumerate(sorted({t for _, text in block for t in terms_of(text)}))}
        vectors = materialise(_vectors(docs, terms), "vectors")
        total = vectors.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length")).first()
        frequency = {r.term: r.df for r in _frequencies(vectors, len(terms)).collect()}
        prepared = Items(block, total.documents, total.length or 1, frequency, terms)
        ahead = _ranked(_search(vectors.filter(F.col("part") < AHEAD), prepared, top, {}), top)
        known = {r.item: r.score for r in ahead.filter(F.col("rank") == top).select("item", "score").collect()}
        out.append(_ranked(_search(vectors, prepared, top, known), top).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return reduce(DataFrame.unionByName, out)
