"""Token counts of whole texts for a byte-level BPE vocabulary, by a whole-token shortcut.

Merges never cross pre-tokens, so a text's count is the sum over its pre-tokens. Offline, ``whole_tokens`` proves
with the library which vocabulary strings are one pre-token and encode alone as one token; in a text such
pre-tokens count one each without merging. The library merges the rest, each different pre-token once in a while (a bounded
memory of counts). Texts with characters of ``_OTHER`` (which two Unicode tables could class differently) or with
special strings are encoded by the library as a whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1024
#: Counts of merged pre-tokens that a worker remembers, at most; then it starts anew.
MEMORY = 1_000_000
#: Texts whose new pre-tokens are merged in one call.
TOGETHER = 64
#: Other characters than these are left to the library: ASCII without separators 1C-1F, Latin letters, some punctuation. Every
#: Unicode version classes these alike, and of them only 0-9 are numbers.
_OTHER = re.compile(r"[^\x00-\x1b\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-\u017f\u2010-\u2027]")
#: The vocabulary's pre-token pattern (a fixed value of its format), for texts without such characters.
_PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings that are a single pre-token and that the library encodes alone as a single token."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    strings = [library.decode([i], skip_special_tokens=False) for i in range(library.get_vocab_size())]
    strings = [s for s in strings if s and not _OTHER.search(s) and _PRE_TOKEN.fullmatch(s) and _PRE_TOKEN.findall(s) == [s]]
    codes = library.encode_batch_fast(strings, add_special_tokens=False)
    return frozenset(s for s, code in zip(strings, codes, strict=True) if len(code) == 1)


class Counter:
    """Counts the tokens of texts; ``whole`` are the pre-tokens that need no merging."""

    def __init__(self, path: str, whole: frozenset[str]):
        from tokenizers import Tokenizer

        self.library, self.whole = Tokenizer.from_file(path), dict.fromkeys(whole, 1)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known = dict(self.whole)

    def count(self, texts: list[str]) -> list[int]:
        words = [None if _OTHER.search(t) or any(s in t for s in self.special) else _PRE_TOKEN.findall(t) for t in texts]
        rest = [t for t, found in zip(texts, words, strict=True) if found is None]
        coded = map(len, self.library.encode_batch_fast(rest, add_special_tokens=False)) if rest else iter(())
        if len(self.known) > MEMORY:
            self.known = dict(self.whole)
        new = list(set(chain.from_iterable(filter(None, words))).difference(self.known))
        self.known.update(zip(new, map(len, self.library.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        return [next(coded) if found is None else sum(map(self.known.__getitem__, found)) for found in words]


#: A worker's counters by path; they outlive its tasks.
_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Bytes and tokens of every row's text (doc_id, text, ...) for the vocabulary file ``path``.

    ``path`` names the file on the driver and the executors alike. No begin, end or padding tokens are added; special strings in a text
    count as the library's default has it. Returns doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens).

    Defined cases: a null or empty text has 0 bytes and 0 tokens; texts are never cut; repeated rows count each; a null
    doc_id stays null; an empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path, whole.value)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            n = [x for k in range(0, len(texts), TOGETHER) for x in _COUNTERS[path].count(texts[k : k + TOGETHER])]
            columns = [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
