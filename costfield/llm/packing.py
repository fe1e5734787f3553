"""Best-fit packing under conflicts: a bin holds a source and a duplicate cluster once at most.

Texts are measured in words; a text longer than a bin is cut into full bins and a rest, so nothing is lost. The rows are
dealt by a hash of doc_id, text and the row's number among those that repeat it, into groups of about ``GROUP_ROWS``, and every group packs its own bins, longest pieces first. A bin
carries its sources and clusters as bitmaps. Bins are kept by residual; the search begins at the smallest residual that holds
the piece and goes on to its successors until a bin has neither the source nor the cluster; then that is the tightest compatible bin.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costfield.llm.near_duplicates import near_duplicates
from costfield.llm.plain import count_words, with_single_spaces

CAPACITY = 2048
#: Rows that are packed together, about. A group leaves a few bins that more rows would fill better.
GROUP_ROWS = 2048

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("bin", pa.string()), ("place", pa.int64())])


class Bins:
    """The open bins of a group, by residual."""

    def __init__(self, capacity: int):
        self.capacity, self.some, self.by_residual = capacity, 0, {}
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Put a piece into the tightest bin without its source and cluster bits, or a new one; the bin and the place in it."""
        later = self.some >> size << size
        while later:
            residual = (later & -later).bit_length() - 1
            held = self.by_residual[residual]
            for k, found in enumerate(held):
                if not (self.sources[found] & source or self.clusters[found] & cluster):
                    held.pop(k)
                    if not held:
                        self.some ^= 1 << residual
                    return self._put(found, residual, size, source, cluster)
            later &= later - 1  # the successor
        self.sources.append(0)
        self.clusters.append(0)
        return self._put(len(self.sources) - 1, self.capacity, size, source, cluster)

    def _put(self, found: int, residual: int, size: int, source: int, cluster: int) -> tuple[int, int]:
        self.sources[found] |= source
        self.clusters[found] |= cluster
        left = residual - size
        self.by_residual.setdefault(left, []).append(found)
        self.some |= 1 << left
        return found, self.capacity - residual


def _bit(codes: dict, value) -> int:
    """A bit of the group's own for a value; none for a null, which conflicts with nothing."""
    return 0 if value is None else 1 << codes.setdefault(value, len(codes))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, cluster: Column | None = None, group_rows: int = GROUP_ROWS, near: bool = False) -> DataFrame:
    """Pack the texts of ``docs`` (doc_id, text, source, ...) into bins of ``capacity`` words.

    ``cluster`` tells a row's duplicate cluster; by default, rows with the same words in the same order are one, and with ``near`` all rows of a near-duplicate component. Returns
    a row for each piece: doc_id, piece (from 0), first_word (in its text), n_words, bin (group:number), place (its first word in the bin).

    Defined cases: a null, empty or blank text has no words and gives no piece; a null source or cluster conflicts with nothing, and with
    ``near`` a row without doc_id has no cluster; rows that repeat are packed each, in different bins, being of one cluster; a null doc_id is dealt as a value; an empty table gives
    no rows. Other columns of ``docs`` are ignored.
    """
    held = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text", (F.lit(None) if cluster is None else cluster).cast("string").alias("given"))
    held = with_single_spaces(held, F.lower("text"), "flat")
    copy = F.xxhash64("flat").cast("string")
    rows = held.select("doc_id", "source", count_words(F.col("flat")).alias("n_words"), (copy if cluster is None else F.col("given")).alias("cluster"), copy.alias("copy"))
    # Counted before it is filtered, or else Spark would move the filter down and read each text twice.
    rows = rows.groupBy("doc_id", "source", "cluster", "copy").agg(F.max("n_words").alias("n_words"), F.count("*").alias("times")).filter("n_words > 0")
    groups = max(1, -(-docs.count() // group_rows))
    rows = rows.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).withColumn("group", F.pmod(F.xxhash64("doc_id", "copy", "time"), F.lit(groups)))

    if near:
        found = near_duplicates(docs).filter("doc_id is not null").select("doc_id", F.col("component_id").cast("string").alias("component")).distinct()
        rows = rows.join(found.hint("merge"), "doc_id", "left").withColumn("cluster", F.col("component"))

    def packed(group: pa.Table) -> pa.Table:
        pieces = []
        for row in group.to_pylist():
            full, rest = divmod(row["n_words"], capacity)
            pieces += [(capacity, row, k) for k in range(full)] + [(rest, row, full)] * (rest > 0)
        order = lambda p: (-p[0], p[1]["doc_id"] is None, p[1]["doc_id"] or 0, p[1]["copy"] or "", p[2])
        bins, sources, clusters, out = Bins(capacity), {}, {}, []
        for size, row, k in sorted(pieces, key=order):
            found, place = bins.place(size, _bit(sources, row["source"]), _bit(clusters, row["cluster"]))
            out.append({"doc_id": row["doc_id"], "piece": k, "first_word": k * capacity, "n_words": size, "bin": f"{row['group']}:{found}", "place": place})
        return pa.Table.from_pylist(out, _PIECES)

    schema = "doc_id long, piece long, first_word long, n_words long, bin string, place long"
    return rows.select("doc_id", "source", "n_words", "cluster", "copy", "group").groupBy("group").applyInArrow(packed, schema)
