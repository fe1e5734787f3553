"""Line dedup by a log-template tree, in DataFrame functions only.

A line's leaf is its number of tokens and its first ``DEPTH`` tokens, where a token with a digit stands for any (``<*>``). In the
leaves that enough documents reach, a template is drawn: at each place the token that at least half of the leaf's lines
have, or else a variable field. A line follows the template if it agrees with four fifths of the fixed places. Lines of
recurring templates are dropped, everywhere.

A leaf may hold several templates. Lines that don't follow the one that is drawn go on: while enough of a leaf's places have tokens that
are common in it, its other lines are split by their token at the place where common tokens cover most, and each group is a leaf of the next round. A round uses a
place up, and most leaves of prose have too few such places for a first one.

Copies of one document are no recurrence. Rows of one text count once; and a text of whose bytes more than ``COPIED`` percent are in
lines of templates that recur is a copy, line by line: it loses lines as any other, but is no witness. A template recurs if its lines are in
``MIN_DOCUMENTS`` texts that are witnesses, however many copies have them too. So altered copies keep what only they share, and a
notice in unrelated documents goes everywhere, however large a group of copies has it. A text of such lines alone becomes empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costfield.shared import materialise, release

DEPTH = 3
MIN_DOCUMENTS = 10
#: The similarity of near duplicates, in percent.
COPIED = 75
#: Of a template's places, so many in a hundred must be fixed; of the fixed ones, a line must agree with so many in a hundred.
MIN_FIXED, MIN_AGREE = 60, 80
ANY = "<*>"
#: Up to this many recurring leaves are sent to all tasks; beyond, lines and leaves meet in an exchange.
MAX_SENT = 500_000


#: The leaf of a line without a token.
_BLANK = (1, "")


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each line: text_key, text_crc, text_bytes, place, flat (the line with single spaces), leaf.

    Blank lines have the leaf ``_BLANK``; a filter here would be moved down, and every line read twice.
    """
    text = F.col("text")
    each = docs.filter("text is not null").select(*_key(text), F.octet_length(text).alias("text_bytes"), F.posexplode(F.split(text, "\n", -1)).alias("place", "line"))
    other = [F.contains("line", F.lit(c)) for c in "\t\v\f\r"]  # most lines have plain single spaces only, and are left as they are
    spaced = F.when(other[0] | other[1] | other[2] | other[3], F.regexp_replace("line", r"[\t\v\f\r]", " ")).otherwise(F.col("line"))
    each = each.withColumn("spaced", spaced)
    single = F.when(F.contains("spaced", F.lit("  ")), F.regexp_replace("spaced", " +", " ")).otherwise(F.col("spaced"))
    each = each.withColumn("flat", F.trim(single))
    tokens = F.octet_length("flat") - F.octet_length(F.replace("flat", F.lit(" "))) + 1
    leaf = F.xxhash64(tokens, _masked(F.substring_index("flat", " ", DEPTH)))
    return each.select("text_key", "text_crc", "text_bytes", "place", "flat", leaf.alias("leaf"))


def _masked(words: Column) -> Column:
    """Space-separated words, those with a digit as ``ANY``."""
    return F.when(words.rlike("[0-9]"), F.regexp_replace(words, r"[^ ]*[0-9][^ ]*", F.lit(ANY))).otherwise(words)


def _key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("text_key"), F.crc32(text.cast("binary")).alias("text_crc")]


def _in_enough_texts(lines: DataFrame, min_documents: int) -> DataFrame:
    """The leaves of rows (leaf, text_key) that so many texts have. Partial sums go first in both steps."""
    texts = lines.groupBy("leaf", "text_key").agg(F.lit(1).alias("one"))
    return texts.groupBy("leaf").agg(F.sum("one").alias("texts")).filter(F.col("texts") >= min_documents).select("leaf")


def _votes(lines: DataFrame) -> DataFrame:
    """(leaf, at, token, n): how many of a leaf's lines have a token at a place. Equal lines are counted before they are taken apart."""
    kinds = lines.groupBy("leaf", F.xxhash64("tokens").alias("kind")).agg(F.min("tokens").alias("tokens"), F.count("*").alias("n"))
    return kinds.select("leaf", "n", F.posexplode("tokens").alias("at", "token")).groupBy("leaf", "at", "token").agg(F.sum("n").alias("n"))


def _templates(lines: DataFrame, min_documents: int) -> DataFrame:
    """(leaf, fixed, split) for each leaf of ``lines`` that has either: its template, by place a token's hash or null; and the place to split the other lines at.

    Another template needs so many places at which a token is in ``min_documents`` lines; lines are split where such tokens cover most, but not where all have one.
    """
    best = _votes(lines).groupBy("leaf", "at").agg(F.max(F.struct("n", "token")).alias("most"), F.sum("n").alias("all"), F.sum(F.when(F.col("n") >= min_documents, F.col("n"))).alias("common"))
    token = F.when(2 * F.col("most.n") >= F.col("all"), F.col("most.token"))
    apart = F.when(F.col("most.n") < F.col("all"), F.coalesce("common", F.lit(0)))
    place = F.struct("at", token.alias("token"), (F.col("most.n") >= min_documents).alias("shared"))
    drawn = best.groupBy("leaf").agg(F.array_sort(F.collect_list(place)).alias("places"), F.max(F.struct(apart.alias("common"), (-F.col("at")).alias("at"))).alias("cut"))
    fixed, size = F.transform("places", lambda p: p["token"]), F.size("places")
    enough = lambda n: 100 * n >= MIN_FIXED * size
    drawn = drawn.select("leaf", F.when(enough(F.size(F.array_compact(fixed))), fixed).alias("fixed"), F.when(enough(F.size(F.filter("places", lambda p: p["shared"]))) & (F.col("cut.common") > 0), -F.col("cut.at")).alias("split"))
    return drawn.filter("fixed is not null or split is not null")


def _split(rest: DataFrame, min_documents: int) -> DataFrame:
    """Lines of (leaf, tokens, split, ...), regrouped by their token at the split; those with a rarer token are a group of their own."""
    own = rest.withColumn("token", F.get("tokens", F.col("split")))
    common = own.groupBy("leaf", "token").agg(F.count("*").alias("n")).filter(F.col("n") >= min_documents).select("leaf", "token", F.lit(True).alias("common"))
    grouped = own.join(common, ["leaf", "token"], "left")
    return grouped.withColumn("leaf", F.xxhash64("leaf", "split", F.when(F.col("common"), F.col("token")))).drop("token", "common", "split", "fixed")


def _follows(tokens: Column, fixed: Column) -> Column:
    agree = F.size(F.filter(F.zip_with(tokens, fixed, lambda t, f: t == f), lambda same: same))
    return 100 * agree >= MIN_AGREE * F.size(F.array_compact(fixed))


def drop_recurring_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``docs`` (doc_id, text, ...) without the lines of recurring templates.

    Returns the struct ``row`` with all columns of ``docs``, where text and n_chars (if there) are the new ones, and
    n_lines (lines of the old text) and n_dropped. Order and line breaks of what stays are as they were.

    Defined cases: a null text stays null, with no lines; an empty or blank line has no template and stays; a text all of
    whose lines recur becomes empty; rows that repeat a text count once and are treated alike; an
    empty table gives no rows; the columns of ``docs`` may have any names, since they stay in ``row``.
    """
    source, one = docs.select("text"), ["text_key", "text_crc", "place"]
    leaves = materialise(_in_enough_texts(_lines(source).select("leaf", "text_key"), min_documents).filter(F.col("leaf") != F.xxhash64(*map(F.lit, _BLANK))), "leaves")
    few = leaves.limit(MAX_SENT + 1).count() <= MAX_SENT
    held = _lines(source).join(F.broadcast(leaves) if few else leaves, "leaf", "left_semi")
    tokens = F.transform(F.split(_masked(F.col("flat")), " "), lambda w: F.xxhash64(w))
    lines = held.select(*one, "leaf", "text_bytes", F.octet_length("flat").alias("bytes"), tokens.alias("tokens"))
    lines = materialise(lines.groupBy(*one).agg(F.min("leaf").alias("leaf"), F.min("text_bytes").alias("text_bytes"), F.min("bytes").alias("bytes"), F.min("tokens").alias("tokens")), "lines")
    rest, rounds, used = lines, [], []
    while True:
        drawn = materialise(_templates(rest, min_documents), "templates")
        used.append(drawn)
        judged = rest.join(drawn, "leaf").withColumn("follows", F.col("fixed").isNotNull() & F.coalesce(_follows(F.col("tokens"), F.col("fixed")), F.lit(False)))
        rounds.append(judged.filter("follows").select(*one, "leaf", "text_bytes", "bytes"))
        if drawn.filter("split is not null").isEmpty():
            break
        rest = materialise(_split(judged.filter("not follows and split is not null").drop("follows"), min_documents), "rest")
        used.append(rest)
    followed = materialise(reduce(DataFrame.unionByName, rounds), "followed")
    release(*used)
    shared = followed.join(_in_enough_texts(followed, min_documents), "leaf", "left_semi")
    copies = shared.groupBy("text_key", "text_crc").agg(F.sum("bytes").alias("bytes"), F.min("text_bytes").alias("text_bytes")).filter(100 * F.col("bytes") > COPIED * F.col("text_bytes"))
    witnesses = shared.join(copies.select("text_key", "text_crc"), ["text_key", "text_crc"], "left_anti")
    recurring = materialise(_in_enough_texts(witnesses, min_documents), "recurring")
    release(leaves, lines)
    drops = followed.join(recurring, "leaf", "left_semi").groupBy("text_key", "text_crc").agg(F.collect_set("place").alias("places"))
    whole = docs.select(F.struct("*").alias("row"), *_key(F.col("text")))
    whole = whole.join(drops, ["text_key", "text_crc"], "left")
    old = F.split(F.col("row.text"), "\n", -1)
    kept = F.filter(F.transform(old, lambda line, k: F.struct(line.alias("line"), k.alias("k"))), lambda x: ~F.array_contains("places", x["k"]))
    whole = whole.withColumn("kept", F.transform(kept, lambda x: x["line"]))
    text = F.when(F.col("places").isNotNull(), F.array_join("kept", "\n")).otherwise(F.col("row.text"))
    columns = [text.alias(c) if c == "text" else F.char_length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    n_lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(old)).cast("long")
    return whole.select(F.struct(*columns).alias("row"), n_lines.alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"))
