"""Secrets in whole texts, told from copied examples by how many owners have them.

Each text is searched once; the hash of every candidate then goes, with the owner (the source) and the repository
(the document) that has it, into a corpus-wide count of distinct owners and repositories. A candidate of one owner
that looks random is taken for a live secret; one that many owners or repositories have is a copied example.
The base rules' spans always stay; to them come the live ones among opaque strings of 20 characters or more, which no
base rule names and which only rarity tells from ordinary identifiers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costfield.llm.spans import Span, digest, joined
from costfield.shared import materialise

KINDS = ("assign", "access", "hex", "opaque")
#: From this many distinct owners or repositories on, a candidate is a copied example.
MANY_OWNERS, MANY_REPOSITORIES = 3, 10
#: Bits of entropy a character, at least, of a live-looking secret.
MIN_BITS = 2.5
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_CLASSES = (re.compile(r"[a-z]"), re.compile(r"[A-Z]"), re.compile(r"[0-9]"))


def base_spans(text: str) -> list[tuple[Span, str]]:
    """The base rules' spans, each with its secret."""
    found = []
    low = text.encode(errors="surrogatepass").lower()
    if any(h in low for h in _HINTS):
        found += [(("assign", *m.span()), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(("access", *m.span()), m[0]) for m in _ACCESS.finditer(text)]
    return found + [(("hex", *m.span()), m[0]) for m in _HEX.finditer(text)]


def opaque_spans(text: str, base: list[tuple[Span, str]]) -> list[tuple[Span, str]]:
    """Strings of capitals, small letters and digits, apart from the base spans. Both come by start, so one pass over each tells."""
    found, taken, k, covered = [], sorted((a, b) for (_, a, b), _ in base), 0, 0
    for m in _OPAQUE.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            covered = max(covered, taken[k][1])  # the farthest end of the base spans that begin before this string's end
            k += 1
        if covered <= m.start() and all(c.search(m[0]) for c in _CLASSES):
            found.append((("opaque", *m.span()), m[0]))
    return found


def bits(secret: str) -> float:
    """Entropy of the characters, in bits a character."""
    return -sum(n / len(secret) * log2(n / len(secret)) for n in Counter(secret).values())


_CANDIDATE = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("hash", pa.binary()), ("bits", pa.float64())])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            text = text.as_py() or ""
            base = base_spans(text)
            spans = [s for s, _ in base]
            found = [{"kind": s[0], "start": s[1], "stop": s[2], "hash": blake2b(x.encode(), digest_size=16).digest(), "bits": bits(x)} for s, x in base + opaque_spans(text, base)]
            rows.append((*(sum(s[0] == k for s in spans) for k in KINDS[:3]), digest(spans, KINDS), joined(spans, KINDS), found))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.list_(_CANDIDATE)]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "owner", "repository")), *columns], names=["row", "doc_id", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "base", "found"])


_SEARCHED = "row long, doc_id long, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, base string, found array<struct<kind: string, start: long, stop: long, hash: binary, bits: double>>"


def ownership(found: DataFrame) -> DataFrame:
    """Distinct owners and repositories of each hash, from rows (hash, owner, repository); sums are partial before each exchange."""
    once = found.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = once.groupBy("hash", "owner").agg(F.sum("one").alias("repositories"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"))


def secrets(docs: DataFrame, owner: str | Column = "source", repository: str | Column = "doc_id") -> DataFrame:
    """Secrets in every row's text (doc_id, text, owner and repository columns, ...).

    Returns doc_id; n_assign, n_access and n_hex, the base rules' counts; base_sha256 of their spans; spans, with the live opaque
    strings; n_live, n_shared and n_example, how many candidates are live (one owner, fewer than ten repositories, at least 2.5
    bits a character), copied examples (three owners or ten repositories, or more), or neither; live_spans, the live ones.

    Defined cases: a null or empty text has no spans; a null owner or repository counts as one of its own name, the empty
    string; repeated rows are searched each, and count as one repository; a null doc_id stays null; an empty table
    gives no rows. Other columns of ``docs`` are ignored.
    """
    as_column = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), as_column(owner).alias("owner"), as_column(repository).alias("repository"), "text")
    searched = materialise(rows.mapInArrow(_search, _SEARCHED), "secrets")
    each = searched.select("row", "owner", "repository", F.explode("found").alias("f")).select("row", "owner", "repository", "f.*")
    judged = each.select("row", "kind", "start", "stop", "hash", "bits").join(ownership(each.select("hash", "owner", "repository")), "hash")
    example = (F.col("n_owners") >= MANY_OWNERS) | (F.col("n_repositories") >= MANY_REPOSITORIES)
    live = ~example & (F.col("n_owners") == 1) & (F.col("bits") >= MIN_BITS)
    text = F.concat_ws(":", "kind", "start", "stop")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("start", rank.alias("rank"), "stop", text.alias("text"))
    per_row = judged.groupBy("row").agg(
        F.count_if(live).alias("n_live"), F.count_if(example).alias("n_example"), F.count_if(~live & ~example).alias("n_shared"),
        F.array_join(F.array_sort(F.collect_list(F.when(live, span))).getField("text"), ",").alias("live_spans"),
        F.array_join(F.array_sort(F.collect_list(F.when((F.col("kind") != "opaque") | live, span))).getField("text"), ",").alias("spans"),
    )
    out = searched.select("row", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256").join(per_row, "row", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_shared", "n_example")]
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"), *counts, F.coalesce("live_spans", F.lit("")).alias("live_spans"))
