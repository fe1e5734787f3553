"""Near duplicates by one-permutation MinHash, with every candidate link confirmed on the full shingle sets.

One hash of each shingle serves all of a text's ``BINS`` minima: its first bits choose a bin, the least value in a bin is
the bin's minimum, and an empty bin takes the minimum of a non-empty one that a fixed random order of the bins chooses
(optimal densification). ``BANDS`` bands of ``ROWS`` bins give bucket keys; texts of similarity 0.75 share no bucket
with a probability of (1 - 0.75**5)**51, about one in a million.

Buckets don't emit all their pairs: a bucket's centre, the member that most other buckets hold many texts with, is
compared with the others (a star). A star with a member that isn't linked with its centre is drawn a second time, in smaller
groups. If x and y, both compared with c, are linked, then either they share a shingle that c lacks, or their common shingles are
all in c, so that 7 |x & c| - 3 |x| >= 3 |y|. So the members that share a shingle which c lacks form a group, and
those that the second condition can hold for another; each group draws a star. Of x's shingles that c lacks, as many
are taken as a linked text can't all miss: |x| / 4 + 1 at most. The work is linear: a text has ``BANDS`` buckets, and a
member of a star has at most |x| / 4 + 2 groups.

What is lost: linked texts that share no bucket (above), and those that neither star joins, directly or over other texts. The
tests and the README say how often that was so where all pairs were compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costfield.llm.components import components
from costfield.llm.wordhash import groups, mix, shingle_sets
from costfield.shared import materialise, release

BINS, BANDS, ROWS = 256, 51, 5
SHARE = 75
#: For each bin, the rank of every bin in the order in which an empty one looks for a value.
_ORDER = np.random.default_rng(7).permuted(np.tile(np.arange(BINS, dtype=np.int32), (BINS, 1)), axis=1)
_WEIGHTS = np.random.default_rng(8).integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: For each bin, the bins in that order, of which so many are looked at for all texts at once.
_NEXT = np.argsort(_ORDER, axis=1).astype(np.uint8)
_SOON = 16
#: So many texts' minima are found at once: a text has ``BINS`` of them, however short it is.
_TEXTS = 1024


def signatures(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The minima of all bins, a row a text, from the texts' sorted distinct shingles (at least one each) and their bounds."""
    n = len(bounds) - 1
    slot = np.repeat(np.arange(n) * BINS, np.diff(bounds)) + (shingles >> np.uint64(56)).astype(np.intp)
    first = np.flatnonzero(np.diff(slot, prepend=-1))
    out, full = np.zeros(n * BINS, np.uint64), np.zeros(n * BINS, bool)
    out[slot[first]] = shingles[first]
    full[slot[first]] = True
    left = np.flatnonzero(~full)
    for k in range(_SOON):
        taken = left // BINS * BINS + _NEXT[left % BINS, k]
        found = full[taken]
        out[left[found]] = out[taken[found]]
        left = left[~found]
    if len(left):
        # Texts of few shingles: the least rank of the full bins.
        texts, at = np.unique(left // BINS, return_inverse=True)
        ends = np.searchsorted(at, np.arange(len(texts) + 1))
        for k, text in enumerate(texts.tolist()):
            own, held = left[ends[k] : ends[k + 1]], np.flatnonzero(full[text * BINS : (text + 1) * BINS])
            out[own] = out[text * BINS + held[_ORDER[np.ix_(own % BINS, held)].argmin(axis=1)]]
    return out.reshape(n, BINS)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, keys, bands = [], [], []
        for group in groups(batch.column("text")):
            shingles, bounds = shingle_sets(group)
            n += np.diff(bounds).tolist()
            keys += [blake2b(shingles[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in pairwise(bounds.tolist())]
            for k in range(0, len(group), _TEXTS):
                own = bounds[k : k + _TEXTS + 1]
                some = np.diff(own) > 0
                rows = signatures(shingles[own[0] : own[-1]], np.append(own[:-1][some], own[-1]) - own[0])[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
                found = iter(mix(np.sum(rows * _WEIGHTS, axis=2, dtype=np.uint64)).view(np.int64))
                bands += [next(found) if x else None for x in some]
        columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_key", "bands"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = []
        for group in groups(batch.column("text")):
            shingles, bounds = shingle_sets(group)
            held += [shingles[a:b].tobytes() for a, b in pairwise(bounds.tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held, pa.binary())], names=["doc_id", "shingles"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (x, c, x_set, c_set): x's size, whether they are linked, the greatest size that the second condition allows, and 32 bits of the shingles that c lacks.

    A text that is linked with x and lacks none of c's share of x has 0.75 |x| - |x & c| of the shingles that c lacks at
    least; so all but the last so many, less one, are enough to meet at.
    """
    for batch in batches:
        sizes, links, reach, lacks = [], [], [], []
        for x, c in zip(batch.column("x_set"), batch.column("c_set"), strict=True):
            mine, centre = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.uint64)
            there = np.isin(mine, centre, assume_unique=True)
            n, common = len(mine), int(there.sum())
            spare = max(0, -(-3 * n // 4) - common - 1)
            sizes.append(n)
            links.append(common > 0 and 100 * common >= SHARE * (n + len(centre) - common))
            reach.append((7 * common - 3 * n) // 3)
            lacks.append((mine[~there][: max(0, n - common - spare)] >> np.uint64(32)).astype(np.uint32).view(np.int32))
        columns = [batch.column("x"), batch.column("c"), pa.array(sizes, pa.int64()), pa.array(links, pa.bool_()), pa.array(reach, pa.int64()), pa.array(lacks, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names=["x", "c", "n", "linked", "reach", "lacks"])


def _stars(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs (x, c) of the stars in the buckets of ``sizes`` (bucket, size), from rows (bucket, doc_id)."""
    shared = materialise(members.join(sizes, "bucket"), "members")
    weighed = shared.join(shared.groupBy("doc_id").agg(F.sum("size").alias("weight")), "doc_id").select("bucket", "doc_id", "weight")
    centre = F.max(F.struct("weight", (-F.col("doc_id")).alias("id")))["id"]
    pairs = weighed.join(weighed.groupBy("bucket").agg((-centre).alias("c")), "bucket").filter("doc_id <> c")
    return pairs.select(F.col("doc_id").alias("x"), "c").distinct()


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``_compare`` for ``pairs`` (x, c); ``sets`` has the shingles of each document."""
    end = lambda k: sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(f"{k}_set"))
    both = pairs.join(end("x"), "x").join(end("c"), "c").select("x", "c", "x_set", "c_set")
    return both.mapInArrow(_compare, "x long, c long, n long, linked boolean, reach long, lacks array<int>")


def _groups_of_stars(stars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (bucket, doc_id) and sizes (bucket, size) of the groups in which the stars with unlinked members are drawn again."""
    held = stars.groupBy("c").agg(F.max(F.when(~F.col("linked"), F.col("reach"))).alias("most"), F.min("n").alias("least")).filter("most is not null")
    second = (~F.col("linked") & (F.col("reach") >= F.col("least"))) | (F.col("n") <= F.col("most"))
    keys = F.when(second, F.array_append(F.transform("lacks", lambda s: s.cast("long")), F.lit(1 << 40))).otherwise(F.transform("lacks", lambda s: s.cast("long")))
    rows = stars.join(held, "c").select("c", F.col("x").alias("doc_id"), "linked", F.explode(keys).alias("key"))
    rows = rows.select(F.xxhash64("c", "key").alias("bucket"), "doc_id", "linked").distinct()
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.bool_and("linked").alias("joined")).filter("size > 1 and not joined")
    return rows.select("bucket", "doc_id"), sizes.select("bucket", "size")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The near-duplicate component of every row of ``docs`` (doc_id, text, ...).

    A text's set holds the distinct runs of five words, A-Z lower-cased; of a text of one to four words, the whole
    sequence. Documents with at least 75 % of their sets' union in common are linked. Returns doc_id, n_shingles,
    component_id (the smallest doc_id reachable) and kept (it is the document's own).

    Defined cases: a null, empty or blank text has an empty set and links with nothing. Rows that repeat a doc_id are one
    document: links of any of its texts count, and all its rows are returned with one component_id. A row without doc_id
    is linked with nothing: its component_id is null and kept is true. An empty table gives no rows. Other columns
    of ``docs`` are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    sketch = materialise(texts.mapInArrow(_sketch, "doc_id long, n_shingles long, set_key binary, bands array<bigint>"), "sketch")
    known = sketch.filter("set_key is not null and doc_id is not null")
    firsts = materialise(known.groupBy("set_key").agg(F.min(F.struct("doc_id", "bands")).alias("least")).select("set_key", "least.*"), "firsts")

    members = firsts.select(F.explode("bands").alias("bucket"), "doc_id")
    pairs = materialise(_stars(members, members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")), "pairs")
    ends = pairs.select(F.explode(F.array("x", "c")).alias("doc_id")).distinct()
    # A merge join at every size: the ids, which grow with the documents, are never sent to all tasks.
    some = texts.join(ends.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    sets = materialise(some.mapInArrow(_shingles, "doc_id long, shingles binary"), "sets")

    first = materialise(_compared(pairs, sets), "compared")
    again = materialise(_compared(_stars(*_groups_of_stars(first)), sets).filter("linked").select("x", "c"), "compared")
    links = first.filter("linked").select("x", "c").union(again)
    # A document of several rows with different sets is one node, linked with its sets' first documents.
    several = known.groupBy("doc_id").agg(F.min("set_key").alias("a"), F.max("set_key").alias("z")).filter("a <> z").select("doc_id")
    links = links.union(known.select("doc_id", "set_key").join(several, "doc_id").join(firsts.select("set_key", F.col("doc_id").alias("first")), "set_key").select("doc_id", "first"))
    labels = components(links.toDF("u", "v"))
    release(pairs, sets, first, again)
    of_set = firsts.select("set_key", "doc_id").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    of_set = of_set.select("set_key", F.coalesce("component", "doc_id").alias("found"))
    out = sketch.join(of_set, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without near duplicates: of each component the document with the smallest doc_id stays, as one row.

    Of rows that repeat that doc_id the first by text stays; rows without doc_id all stay.
    """
    kept = near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("row.text"))
    one = rows.join(kept, "doc_id", "left_semi").withColumn("first", first).filter("first = 1").select("row.*")
    return one.union(docs.filter("doc_id is null"))
