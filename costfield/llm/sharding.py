"""Sharding by histogram sort: shards of near-equal bytes, their borders found by counting, one exchange of rows.

Rows are ordered by a 63-bit key, the CRC-32 of the text and then 31 bits of a hash of doc_id, and by a row number where keys
tie. Equal texts thus stand together, and a border can still fall between them or between rows that repeat. A
round counts the bytes of all rows in the cells of the active intervals (each interval holds at least one wanted border), by
partial sums in every partition; a cell with little enough in it, or with an end near enough, gives its border, and the
others are the next round's intervals. Only such counts come to the driver: at most ``CELLS`` of them a round, however many rows there are.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from costfield.shared import materialise

SHARDS = 16
#: A border may be off by this part of a shard's bytes.
TOLERANCE = 0.001
#: Rows of a run within a shard that is sorted and numbered as a whole, about.
RUN_ROWS = 1 << 18
MAX_RUNS = 1 << 12
CELLS = 1 << 18
KEY_BITS, TIE_BITS = 63, 42


def _key() -> list[Column]:
    text_crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    key = F.shiftleft(text_crc, 31).bitwiseOR(F.xxhash64("doc_id").bitwiseAND((1 << 31) - 1))
    return [(F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1).cast("long").alias("size"), text_crc.alias("text_crc32"), key.alias("key")]


def _borders(keyed: DataFrame, wanted: list[int], slack: float) -> list[tuple[int, int]]:
    """For each wanted count of bytes, a (key, tie) with about that many bytes below it."""
    found: dict[int, tuple[int, int]] = {}
    bits = max(6, min(14, CELLS.bit_length() - 1 - len(wanted).bit_length()))
    # Active intervals of the ties' part: the key is settled, the prefix is the tie's.
    active: dict[tuple[int, int], tuple[int, list[int]]] = {(0, 0): (0, list(range(len(wanted))))}
    for column, width in (("key", KEY_BITS), ("tie", TIE_BITS)):
        left = width
        while left and active:
            was, left = left, max(0, left - bits)
            cell = F.shiftright(column, left).alias("cell")
            fixed = F.lit(0).cast("long").alias("fixed") if column == "key" else F.col("key").alias("fixed")
            rows = keyed
            if was < width:
                if column == "key":
                    rows = rows.filter(F.shiftright("key", was).isin([p for _, p in active]))
                else:
                    rows = rows.filter(F.struct("key", F.shiftright("tie", was)).isin([F.struct(F.lit(k).cast("long"), F.lit(p).cast("long")) for k, p in active]))
            elif column == "tie":
                rows = rows.filter(F.col("key").isin([k for k, _ in active]))
            counts: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for k, c, n in rows.groupBy(fixed, cell).agg(F.sum("size")).collect():
                counts.setdefault((k, c >> (was - left)), []).append((c, n))
            following: dict[tuple[int, int], tuple[int, list[int]]] = {}
            for at, (below, targets) in active.items():
                cells = sorted(counts.get(at, []))
                ends = []
                for _, n in cells:
                    ends.append((ends[-1] if ends else below) + n)
                for t in targets:
                    if not cells:
                        found[t] = _border(column, at[0], at[1] << was)
                        continue
                    i = min(bisect_left(ends, wanted[t]), len(cells) - 1)
                    c, start = cells[i][0], ends[i] - cells[i][1]
                    if wanted[t] - start <= slack:
                        found[t] = _border(column, at[0], c << left)
                    elif abs(ends[i] - wanted[t]) <= slack:
                        found[t] = _border(column, at[0], (c + 1) << left)
                    elif left == 0 and column == "tie":
                        found[t] = _border(column, at[0], c)
                    else:
                        following.setdefault((at[0], c), (start, []))[1].append(t)
            active = following
        active = {(c, 0): x for (_, c), x in active.items()}
    return [found[t] for t in range(len(wanted))]


def _border(column: str, key: int, value: int) -> tuple[int, int]:
    if column == "key":
        return (value, 0) if value < 1 << KEY_BITS else ((1 << KEY_BITS) - 1, 1 << TIE_BITS)
    return key, value


def _index(borders: list[tuple[int, int]]) -> Column:
    """How many borders are at or below the row's (key, tie), by binary search in the sorted borders."""
    if not borders:
        return F.lit(0)
    table = F.array(*(F.struct(F.lit(k).cast("long").alias("key"), F.lit(t).cast("long").alias("tie")) for k, t in borders))
    here = F.struct(F.col("key").alias("key"), F.col("tie").alias("tie"))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(borders).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda low, step: low + F.when(F.get(table, low + step - 1) <= here, step).otherwise(0))


def shard_documents(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, carry: list[str] | None = None) -> DataFrame:
    """Put every row of ``docs`` (doc_id, text, ...) into one of ``shards`` shards of near-equal bytes.

    A row's size is the UTF-8 bytes of its text and 1. A shard's bytes differ from the others' by ``tolerance`` of a
    shard, and by the row that a border falls in. Returns the struct ``row`` with the columns ``carry`` of ``docs`` (all, if none
    are named; only these are written and exchanged), and size, text_crc32, shard and slot: the row's place in the shard, from 0 and without gaps, by the order of the key.

    Defined cases: a null or empty text has size 1; a null doc_id is a value as any other; rows that repeat count and are placed each
    for itself; an empty table gives no rows; the columns of ``docs`` may have any names, since they stay in ``row``.
    """
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry or docs.columns)).alias("row"), F.col("doc_id"), F.col("text")).select("row", *_key(), F.monotonically_increasing_id().alias("tie_id"))
    # 2**33 rows a partition are numbered by Spark; the hash spreads them over the tie's bits.
    keyed = keyed.withColumn("tie", F.xxhash64("tie_id").bitwiseAND((1 << TIE_BITS) - 1)).drop("tie_id")
    keyed = materialise(keyed, "keyed")
    rows, total = keyed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    runs = min(MAX_RUNS // shards * shards, shards * max(1, -(-rows // (RUN_ROWS * shards))))
    borders = sorted(_borders(keyed, [total * k // runs for k in range(1, runs)], tolerance * total / shards / 2)) if rows else []
    placed = keyed.withColumn("run", _index(borders))
    before, held = {}, dict(map(tuple, placed.groupBy("run").count().collect()))
    for run in range(runs):
        before[run] = 0 if run % (runs // shards) == 0 else before[run - 1] + held.get(run - 1, 0)
    offsets = F.array(*(F.lit(before[run]).cast("long") for run in range(runs)))
    number = F.row_number().over(Window.partitionBy("run").orderBy("key", "tie"))
    slot = (F.get(offsets, F.col("run")) + number - 1).cast("long")
    return placed.select("row", "size", "text_crc32", (F.col("run") / (runs // shards)).cast("int").alias("shard"), slot.alias("slot"))
