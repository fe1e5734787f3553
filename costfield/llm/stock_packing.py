"""Documents packed into token sequences by the cutting-stock patterns of their lengths.

One pass tokenises every text, adds the end id and cuts full sequences off long documents; what is left of each document has a
length below the capacity. The histogram of these lengths (its size depends on the capacity alone) goes to the driver, which finds patterns
by column generation (``cutting_stock``). The documents of a length are ranked, and ranks are dealt to the uses of the patterns
by arithmetic, in parallel: no two documents have to meet in a task. What no full pattern takes is laid end to end and
cut where a sequence is full; the last, incomplete one is cut into powers of two, which are not padded.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costfield.llm.cutting_stock import Plan, solve
from costfield.llm.token_counts import _OTHER
from costfield.shared import materialise

CAPACITY, END = 2048, 1
#: Chunks of text whose ids a worker remembers, at most; then it starts anew.
MEMORY = 1_000_000
#: Pieces that are cut, at most, whose places are sent to all tasks; more meet their ids in an exchange.
SENT = 10_000
#: The vocabulary's pre-token pattern (a fixed value of its format).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Coder:
    """Ids of texts as little-endian unsigned 32-bit numbers.

    Pre-tokens never reach over a single space that follows a word, so each chunk between single spaces is coded on its own, and remembered. Texts with runs of
    white space are coded as a whole; those with characters that two Unicode tables could class differently, or with special strings, by the
    library of ``path`` itself. ``ranks`` names the same vocabulary as ranks.
    """

    def __init__(self, path: str, ranks: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coding = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=pairs, special_tokens={})
        self.known: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if _OTHER.search(text) or any(s in text for s in self.special):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        if "  " in text or not text:
            return self.coding.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        if len(self.known) > MEMORY:
            self.known.clear()
        known, code = self.known, self.coding.encode_ordinary
        first, *rest = text.split(" ")
        out = [array("I", code(first)).tobytes()]
        for chunk in rest:
            ids = known.get(chunk)
            if ids is None:
                ids = known[chunk] = array("I", code(" " + chunk)).tobytes()
            out.append(ids)
        return b"".join(out)


#: A worker's coders by path; they outlive its tasks.
_CODERS: dict[str, Coder] = {}
_PIECES = "part int, no long, doc_id long, start long, length int, doc_tokens long, ids_crc32 long, nth long, ids binary"


def tokenised(docs: DataFrame, path: str, ranks: str, capacity: int = CAPACITY) -> DataFrame:
    """The full sequences and the rest of every document: part, no (which tell the piece), doc_id, start, length, doc_tokens, ids_crc32, nth (its number among the part's pieces of that length), ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        coder = _CODERS.get(path) or _CODERS.setdefault(path, Coder(path, ranks))
        part, no, seen, end = TaskContext.get().partitionId(), 0, [0] * (capacity + 1), array("I", [END]).tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = coder(text.as_py() or "") + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    length = len(piece) // 4
                    rows.append((part, no, doc_id, start, length, n, crc32(piece), seen[length], piece))
                    seen[length] += 1
                    no += 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = [x.split()[0] for x in _PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES)


class Places:
    """Where the piece of a length and rank goes: sequence and offset, or a place in what is laid end to end."""

    def __init__(self, plan: Plan, histogram: dict[int, int], capacity: int):
        taken, rows, sequence = dict.fromkeys(histogram, 0), [], 0
        for pattern, times in plan.uses:
            offset = 0
            for length, n in sorted(pattern.items(), reverse=True):
                rows.append((length, taken[length], times, sequence, offset, 0))
                taken[length] += n * times
                offset += n * length
            sequence += times
        self.first, self.total = sequence, 0
        for length, n in sorted(plan.left.items(), reverse=True):
            rows.append((length, taken[length], 1, 0, self.total, 1))
            self.total += n * length
        rows.sort()
        self.capacity, self.rows = capacity, np.array(rows, np.int64).reshape(-1, 6)
        self.keys = self.rows[:, 0] << 44 | self.rows[:, 1]
        # The ends of the sequences of what is laid end to end: full ones, then powers of two.
        whole, rest = divmod(self.total, capacity)
        self.whole, self.tail = whole, [1 << k for k in range(capacity.bit_length() - 1, -1, -1) if rest >> k & 1]

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """sequence, offset, and the place in what is laid end to end (-1: none)."""
        row = self.rows[np.searchsorted(self.keys, length << 44 | rank, side="right") - 1]
        slot, instance = np.divmod(rank - row[:, 1], row[:, 2])
        at = row[:, 4] + slot * length
        loose = row[:, 5] == 1
        return row[:, 3] + instance, at, np.where(loose, at, -1)

    def sequence(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of places laid end to end: sequence, offset, and the tokens up to its end."""
        ends = self.whole * self.capacity + np.cumsum([0, *self.tail])
        k = np.searchsorted(ends, place, side="right")
        full = k == 0
        begin = np.where(full, place // self.capacity * self.capacity, ends[np.maximum(k - 1, 0)])
        stop = np.where(full, begin + self.capacity, ends[np.minimum(k, len(ends) - 1)])
        return self.first + np.where(full, place // self.capacity, self.whole + k - 1), place - begin, stop - place

    def cuts(self) -> int:
        """Pieces that end beyond their sequence, at most."""
        return self.whole + len(self.tail)


_PLACED = "part int, no long, doc_id long, start long, length int, ids_crc32 long, doc_tokens long, sequence_id long, offset long, place long"


def pack_sequences(docs: DataFrame, path: str, ranks: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pack the token ids of ``docs`` (doc_id, text, ...), each document's with the id 1 after them, into sequences of ``capacity`` tokens.

    ``path`` (tokenizers) and ``ranks`` (tiktoken) name the files of one vocabulary on the driver and the executors alike. Returns a row for each piece:
    doc_id, start, length, ids_crc32 (of its ids as little-endian unsigned 32-bit numbers), doc_tokens, sequence_id, offset, and
    with ``with_ids`` its ids, as such numbers.

    Every sequence is full, but for the last ones, whose lengths are different powers of two. A document is cut at multiples of the capacity, and
    once or more if its rest is among what no pattern takes.

    Defined cases: a null or empty text has the end id alone; repeated rows are packed each; a null doc_id stays null; an
    empty table gives no rows. Which of the documents of a length goes where depends on the input's layout. Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    pieces = materialise(tokenised(docs, path, ranks, capacity), "tokens")
    light = pieces.drop("ids")
    each = light.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    each = materialise(each.select("length", "part", "n", F.coalesce(before, F.lit(0)).alias("before")), "ranks")
    histogram = {r.length: r.n for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(solve(histogram, capacity), histogram, capacity)
    sent = spark.sparkContext.broadcast(places)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            sequence, offset, at = sent.value.find(length, batch.column("nth").to_numpy() + batch.column("before").to_numpy())
            loose = np.flatnonzero(at >= 0)
            sequence[loose], offset[loose], room = sent.value.sequence(at[loose])
            at[loose[room >= length[loose]]] = -1  # whole in its sequence
            columns = [*(batch.column(c) for c in ("part", "no", "doc_id", "start", "length", "ids_crc32", "doc_tokens")), *map(pa.array, (sequence, offset, at))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _PLACED.split(", ")])

    placed = light.join(each.select("length", "part", "before"), ["length", "part"]).mapInArrow(place, _PLACED)
    if places.cuts():
        placed = materialise(placed, "placed")
    whole = placed.filter("place < 0").drop("place")
    if with_ids:
        whole = whole.join(pieces.select("part", "no", "ids"), ["part", "no"])
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                done = 0
                while done < r["length"]:
                    (sequence,), (offset,), (room,) = (x.tolist() for x in sent.value.sequence(np.array([r["place"] + done])))
                    n = min(room, r["length"] - done)
                    ids = r["ids"][4 * done : 4 * (done + n)]
                    rows.append({"doc_id": r["doc_id"], "start": r["start"] + done, "length": n, "ids_crc32": crc32(ids), "doc_tokens": r["doc_tokens"], "sequence_id": sequence, "offset": offset, "ids": ids})
                    done += n
            kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    whole = whole.select(*out)
    if places.cuts():
        over = placed.filter("place >= 0").select("part", "no", "doc_id", "start", "length", "doc_tokens", "place")
        if places.cuts() <= SENT:
            over = F.broadcast(over)
        crossing = pieces.select("part", "no", "ids").join(over, ["part", "no"])
        whole = whole.unionByName(crossing.mapInArrow(cut, "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary").select(*out))
    return whole.withColumn("length", F.col("length").cast("long"))
