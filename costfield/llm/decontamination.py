"""Benchmark decontamination by SimHash fingerprints of item-sized windows, in DataFrame functions only.

A window of a document is a run of as many words as a benchmark item has. The first of a document's most similar windows
begins the document or ends with a shared run of five words, or else the window one word before it would have no less in common. So a
window is laid at the end of every run of five words that an item of its size has, unless the window has fewer such runs, of
any item, than similarity asks for. This loses no window. Windows are fingerprinted: 64 bits, each the sign of the window's words'
votes. The bits are cut into ``BLOCKS`` blocks of 13 (the last: 12); of two fingerprints that differ in ``RADIUS`` bits at most, one block at least
differs in ``PROBE`` bits at most. So the items' blocks are entered with all values that near, and joining windows and items on (size, block, bits)
finds all fingerprints within the radius; of other pairs, one in four shares a block. Each pair within the radius is then compared exactly:
the shingles' weights (occurrences) in common must be 75 % or more of the larger weights' sum.

A similar window whose fingerprint is farther than the radius is lost. Of 31,506 windows altered at random that are 0.06 % at a similarity of 0.75
to 0.78, 0.01 % to 0.82, and none above.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costfield.llm.plain import with_single_spaces
from costfield.shared import materialise, release

SHINGLE, PERCENT = 5, 75
BITS, BLOCKS, PROBE = 64, 5, 3
#: Bits that fingerprints of similar texts may differ in.
RADIUS = BLOCKS * (PROBE + 1) - 1
_WIDTH = -(-BITS // BLOCKS)
#: What turns a block into each value that differs from it in ``PROBE`` bits at most.
_NEAR = [sum(1 << k for k in bits) for n in range(PROBE + 1) for bits in combinations(range(_WIDTH), n)]
#: Up to so many shingles of items, the rows are searched for them where they lie; up to the second number they are sent to all
#: tasks as a table of hashes (8 bytes each); beyond, rows and shingles meet in an exchange.
LISTED, SENT = 20_000, 2_000_000
#: Up to so many different fingerprints of items are sent to all tasks, with the values near their blocks (about 60 bytes each).
SENT_PRINTS = 400


def _with_hashes(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the hashes of the words of ``text``, lower-cased, instead of ``text``."""
    rows = with_single_spaces(rows, F.lower(text), "flat")
    words = F.when(F.col("flat") == "", F.array().cast("array<string>")).otherwise(F.split("flat", " "))
    return rows.withColumn(name, F.transform(words, lambda w: F.xxhash64(w))).drop(text, "flat")


def _with_runs(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with ``runs``, the hashes of all runs of ``size`` words of ``doc_words``: as ``_runs`` has them, by joining neighbours."""
    if size != SHINGLE:
        return rows.withColumn("runs", _runs(F.col("doc_words"), size))
    after = lambda name, k: F.slice(name, k + 1, 1 << 30)
    both = lambda a, b: F.xxhash64(a, b)
    rows = rows.withColumn("two", F.zip_with("doc_words", after("doc_words", 1), both))
    rows = rows.withColumn("four", F.zip_with("two", after("two", 2), both))
    return rows.withColumn("runs", F.slice(F.zip_with("four", after("doc_words", 4), both), 1, F.greatest(F.size("doc_words") - 4, F.lit(0)))).drop("two", "four")


def _runs(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words; of five, the hash of (the hash of two and two, and the fifth)."""
    last = F.size(words) - size
    at = lambda i, j: F.get(words, i + j)
    if size == SHINGLE:
        run = lambda i: F.xxhash64(F.xxhash64(F.xxhash64(at(i, 0), at(i, 1)), F.xxhash64(at(i, 2), at(i, 3))), at(i, 4))
    else:
        run = lambda i: F.xxhash64(*(at(i, j) for j in range(size)))
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), run)).otherwise(F.array().cast("array<bigint>"))


def _shingles(words: Column, sizes: list[int]) -> Column:
    """Runs of five words; of fewer words, the whole sequence. ``sizes``: the sizes that occur, so that no others are built."""
    out = _runs(words, SHINGLE)
    for size in sizes:
        if size < SHINGLE:
            out = F.when(F.size(words) == size, _runs(words, size)).otherwise(out)
    return out


def with_fingerprint(rows: DataFrame, words: str, name: str) -> DataFrame:
    """``rows`` with the SimHash of ``words``: bit j is set if more than half of the words' hashes have it.

    A word votes on two bits at a time, j and j + 32, each counted in a half of a long.
    """
    half = BITS // 2
    vote = lambda j: F.aggregate(words, F.lit(0).cast("long"), lambda acc, h: acc + F.shiftrightunsigned(h, j).bitwiseAND(F.lit((1 << half) + 1)))
    rows = rows.withColumn("votes", F.array(*map(vote, range(half))))
    count = lambda j: F.shiftrightunsigned(F.get("votes", F.lit(j % half)), j // half * half).bitwiseAND(F.lit((1 << half) - 1))
    one = lambda j: (1 << j) - (1 << BITS if j == BITS - 1 else 0)
    bits = [F.when(2 * count(j) > F.size(words), F.lit(one(j)).cast("long")).otherwise(F.lit(0).cast("long")) for j in range(BITS)]
    return rows.withColumn(name, reduce(Column.bitwiseOR, bits)).drop("votes")


def _block(print_: str | Column, k: int) -> Column:
    return F.shiftrightunsigned(print_, k * _WIDTH).bitwiseAND(F.lit((1 << _WIDTH) - 1)).cast("int")


def _with_places(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """``rows`` with ``places``: where their ``runs`` have any of ``hashes``, in order; rows without any may be missing.

    No filter stands here, and arrays are exploded with empty ones, since Spark would move a filter down and compute words and runs in it once more.
    """
    listed = [r[0] for r in hashes.limit(LISTED + 1).collect()]
    if len(listed) <= LISTED:
        places = F.filter(F.transform("runs", lambda h, i: F.when(h.isin(listed), i)), lambda i: i.isNotNull())
        return rows.withColumn("places", places)
    sent = hashes.limit(SENT + 1).count() <= SENT
    thin = rows.select("row_key", F.posexplode_outer("runs").alias("at", "hash")).join(F.broadcast(hashes) if sent else hashes, "hash", "left_semi")
    return rows.join(thin.groupBy("row_key").agg(F.array_sort(F.collect_set("at")).alias("places")), "row_key")


def _weight_in_common(a: Column, b: Column) -> Column:
    times = lambda array, x: F.size(F.filter(array, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, x: acc + F.least(times(a, x), times(b, x)))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Places where a document of ``docs`` (doc_id, text, ...) has an item of ``benchmark`` (item_id, text, ...).

    Returns a row for each document and item of which a window is similar: doc_id, row_key (a hash of doc_id and text),
    item_id, similarity (the greatest), start (that window's first word, the first such) and bits (how many differ).

    Defined cases: null, empty and blank texts and items have no words and match nothing; an item of one to four
    words is one shingle and matches where its words stand in a row; a document shorter than an item is one window;
    rows that repeat doc_id and text give one row an item; a null doc_id or item_id stays null; an empty table on either side gives
    no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    items = _with_hashes(benchmark.select("item_id", "text"), "text", "item_words").filter(F.size("item_words") > 0).withColumn("words", F.size("item_words"))
    sizes = sorted(r[0] for r in items.select("words").distinct().collect())
    if not sizes:
        return spark.createDataFrame([], "doc_id long, row_key long, item_id long, similarity double, start int, bits int")
    items = with_fingerprint(items.withColumn("item_shingles", _shingles(F.col("item_words"), sizes)), "item_words", "item_print")
    items = materialise(items.select("item_id", "words", "item_shingles", "item_print"), "items")
    seeds = items.select("words", F.explode("item_shingles").alias("hash")).distinct()
    widest = sizes[-1]

    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    rows = _with_hashes(rows, "text", "doc_words")
    hits = []
    for size in sorted({min(s, SHINGLE) for s in sizes}):
        begin = lambda at: F.greatest(at - widest, F.lit(0))
        # The places up to this one, from which a window's are counted.
        behind = lambda k: F.slice("places", F.greatest(k + 2 - widest, F.lit(1)), F.least(k + 1, F.lit(widest)))
        hit = lambda at, k: F.struct(at.alias("at"), F.get("runs", at).alias("hash"), behind(k).alias("behind"), begin(at).alias("begin"), F.slice("doc_words", begin(at) + 1, F.lit(2 * widest + SHINGLE)).alias("near"))
        found = _with_places(_with_runs(rows, size), seeds.select("hash").distinct())
        hits.append(found.select("doc_id", "row_key", F.size("doc_words").alias("n"), F.explode_outer(F.transform("places", hit)).alias("h")).filter("h is not null").select("doc_id", "row_key", "n", "h.*"))
    hits = materialise(reduce(DataFrame.union, hits), "hits")
    run = F.least(F.col("words"), F.lit(SHINGLE))
    runs = F.col("words") - run + 1
    # In common: 75 % of the union of the item's runs and the window's, which has fewer in a document shorter than the item.
    least = F.ceil((runs + F.least(runs, F.col("n") - run + 1)) * PERCENT / (100 + PERCENT) - 1e-9).cast("int")
    enough = F.get("behind", F.size("behind") - least) > F.col("at") - runs
    start = F.greatest(F.col("at") - F.col("words") + run, F.lit(0))
    laid = hits.join(seeds, "hash").filter(F.coalesce(enough, F.lit(False)))
    windows = laid.select("doc_id", "row_key", start.alias("start"), "words", F.slice("near", start - F.col("begin") + 1, F.col("words")).alias("window"))
    windows = materialise(with_fingerprint(windows, "window", "print"), "windows")

    prints = items.select("words", "item_print").distinct()
    few = prints.limit(SENT_PRINTS + 1).count() <= SENT_PRINTS
    blocks = F.array(*(F.struct(F.lit(k).alias("block"), _block("item_print", k).alias("bits")) for k in range(BLOCKS)))
    prints = prints.select("words", "item_print", F.explode(blocks).alias("b")).select("words", "item_print", "b.block", "b.bits", F.explode(F.array(*map(F.lit, _NEAR))).alias("change"))
    prints = prints.select("words", "item_print", "block", F.col("bits").bitwiseXOR(F.col("change")).alias("value"))
    prints = F.broadcast(prints) if few else prints
    blocks = F.array(*(F.struct(F.lit(k).alias("block"), _block("print", k).alias("value")) for k in range(BLOCKS)))
    shown = windows.select("*", F.explode(blocks).alias("b")).select(*windows.columns, "b.block", "b.value")
    apart = F.col("print").bitwiseXOR(F.col("item_print"))
    differ = F.bit_count(apart)
    first = F.coalesce(*(F.when(F.bit_count(_block(apart, k)) <= PROBE, k) for k in range(BLOCKS)))
    near = shown.join(prints, ["words", "block", "value"]).filter((differ <= RADIUS) & (first == F.col("block"))).drop("block", "value")
    pairs = near.join(items, ["words", "item_print"])
    pairs = pairs.withColumn("shingles", _shingles(F.col("window"), [1, 2, 3, 4])).withColumn("common", _weight_in_common(F.col("item_shingles"), F.col("shingles")))
    whole = F.size("item_shingles") + F.size("shingles") - F.col("common")
    best = F.max(F.struct((F.col("common") / whole).alias("similarity"), (-F.col("start")).alias("start"), (-differ).alias("bits")))
    similar = pairs.filter((F.col("common") > 0) & (100 * F.col("common") >= PERCENT * whole)).groupBy("doc_id", "row_key", "item_id").agg(best.alias("best"))
    found = materialise(similar.select("doc_id", "row_key", "item_id", "best.similarity", (-F.col("best.start")).alias("start"), (-F.col("best.bits")).alias("bits")), "leaks")
    release(items, hits, windows)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that have no leak."""
    found = leaks(docs, benchmark).select("doc_id", "row_key").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("row_key"))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (rows["row_key"] == found["row_key"])
    return rows.join(found, same, "left_anti").select("row.*")
