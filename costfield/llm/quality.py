"""Quality rules: a linear-chain conditional random field marks a text's lines, and the share of content decides.

A text is the sequence of its lines that have a word; the two labels are content and boilerplate. Scores of a line come
from the shares of its characters and words that are symbols, capitals, repeats and so on; scores of neighbouring labels
are the chain's. The weights are fitted by conditional likelihood on at most ``per_class`` labelled documents of
each class, taken by the order of a hash of doc_id, and at most ``RUNS`` runs of ``RUN_LINES`` lines of each; a line's label in training is its document's. Viterbi decoding then
labels each text of the corpus, whole, and a document is kept if at least half of its words are in content lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costfield.llm.wordhash import Group, groups, windows

#: Labelled documents of each class that the weights are fitted on, at most.
PER_CLASS = 400
#: Of each of these, at most so many runs of so many lines, evenly spaced; a run is a chain of its own in training.
RUNS, RUN_LINES = 8, 32
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_CONTENT = 20, 30, 0.5
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_CAPITAL = np.isin(np.arange(256), np.arange(ord("A"), ord("Z") + 1))
_DIGIT = np.isin(np.arange(256), np.arange(ord("0"), ord("9") + 1))
_SHOUT = np.isin(np.arange(256), list(b"!?"))
_BAR = np.isin(np.arange(256), list(b"|<>{}[]="))
_STOP = np.isin(np.arange(256), list(b".,;:"))
_FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80
N_FEATURES = 11


@dataclass
class Model:
    """``unary`` by feature and label, ``chain`` by label and next label; label 1 is content."""

    unary: np.ndarray
    chain: np.ndarray


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(flags)))


def line_features(group: Group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features and word counts of all lines that have a word, and the bounds of each text's lines."""
    breaks = np.flatnonzero(group.data == 10)
    starts = np.union1d(group.bounds[:-1], breaks + 1)
    starts = starts[starts <= len(group.data)]
    ends = np.append(starts[1:], len(group.data))
    first, last = np.searchsorted(group.start, starts), np.searchsorted(group.start, ends)
    some = last > first
    starts, ends, first, last = starts[some], ends[some], first[some], last[some]
    n = (last - first).astype(float)
    size = np.maximum(ends - starts, 1).astype(float)
    shares = []
    for table in (_SYMBOLS, _CAPITAL, _DIGIT, _SHOUT, _BAR, _STOP):
        total = _sums(table[group.data])
        shares.append((total[ends] - total[starts]) / size)
    order = np.argsort(group.hash, kind="stable")
    line = np.repeat(np.arange(len(n)), last - first)[order] if len(n) else np.empty(0, int)
    by_line = np.lexsort((group.hash[order], line))
    words, line = group.hash[order][by_line], line[by_line]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (line[1:] != line[:-1])
    distinct = np.bincount(line[new], minlength=len(n)) if len(n) else np.empty(0)
    same = np.zeros(len(group.hash), bool)
    same[1:] = group.hash[1:] == group.hash[:-1]
    twice = _sums(same)
    features = np.stack([np.ones(len(n)), *shares, 1 - distinct / n, (twice[last] - twice[first]) / n, np.minimum(n, 50) / 50, np.minimum(size / n, 20) / 20], axis=1)
    return features, n, np.searchsorted(starts, group.bounds)


def content_share(model: Model, features: np.ndarray, n: np.ndarray) -> float:
    """The share of words in lines that Viterbi decoding labels as content."""
    scores = features @ model.unary
    (stay0, to1), (to0, stay1) = model.chain.tolist()
    a = b = 0.0
    back = []
    for k, (s0, s1) in enumerate(scores.tolist()):
        if k:
            x, y = a + stay0, b + to0
            u, v = a + to1, b + stay1
            back.append((y > x, v >= u))
            a, b = max(x, y), max(u, v)
        a, b = a + s0, b + s1
    label = b >= a
    content = 0.0
    for k in range(len(n) - 1, -1, -1):
        content += n[k] if label else 0
        if k:
            label = back[k - 1][label]
    return content / n.sum()


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, steps: int = 80) -> Model:
    """Weights from at most ``per_class`` documents of each class of ``labels`` (doc_id, quality); of rows that share a doc_id, the least text.

    Without documents of both classes, all lines are content.
    """
    chosen = [labels.filter((F.col("quality") == q) & F.col("doc_id").isNotNull()).select("doc_id", F.lit(q).alias("quality")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, row = [], 0
            for group in groups(batch.column("text"), lower=False):
                features, _, bounds = line_features(group)
                for k in range(len(group)):
                    starts = np.arange(bounds[k], bounds[k + 1], RUN_LINES)
                    starts = starts if len(starts) <= RUNS else starts[np.arange(RUNS) * len(starts) // RUNS]
                    runs = [features[s : min(s + RUN_LINES, bounds[k + 1])] for s in starts]
                    out += [(batch.column("doc_id")[row].as_py(), batch.column("quality")[row].as_py(), sum(map(len, runs)), run.ravel()) for run in runs]
                    row += 1
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["doc_id", "quality", "n_lines", "features"])

    rows = sorted(map(tuple, sample.mapInArrow(measured, "doc_id long, quality int, n_lines int, features array<double>").collect()))
    if len({r[1] for r in rows}) < 2:
        return Model(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))
    return _climb([np.reshape(r[3], (-1, N_FEATURES)) for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), steps)


def _climb(lines: list[np.ndarray], y: np.ndarray, n_lines: np.ndarray, steps: int) -> Model:
    """Conditional likelihood by Adam over runs of lines; all documents (of ``n_lines`` each) weigh the same within a class, and both classes."""
    length = np.array([len(x) for x in lines])
    longest = length.max()
    x = np.zeros((len(lines), longest, N_FEATURES))
    for k, rows in enumerate(lines):
        x[k, : len(rows)] = rows
    there = np.arange(longest) < length[:, None]
    documents = [(length / n_lines)[y == label].sum() for label in (0, 1)]
    weight = (0.5 / np.where(y == 1, documents[1], documents[0]) / n_lines)[:, None]
    gold = np.stack([1 - y, y], axis=1).astype(float)
    theta = np.zeros((N_FEATURES + 2, 2))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        unary, chain = theta[:N_FEATURES], theta[N_FEATURES:]
        score = x @ unary
        fore, aft = np.zeros_like(score), np.zeros_like(score)
        fore[:, 0] = score[:, 0]
        for t in range(1, longest):
            fore[:, t] = np.where(there[:, t, None], score[:, t] + np.logaddexp.reduce(fore[:, t - 1, :, None] + chain, axis=1), fore[:, t - 1])
        for t in range(longest - 2, -1, -1):
            aft[:, t] = np.where(there[:, t + 1, None], np.logaddexp.reduce(chain + (score[:, t + 1] + aft[:, t + 1])[:, None, :], axis=2), 0)
        whole = np.logaddexp.reduce(fore[:, -1], axis=1)
        single = np.exp(fore + aft - whole[:, None, None]) * (there * weight)[..., None]
        pair = np.exp(fore[:, :-1, :, None] + chain + (score + aft)[:, 1:, None, :] - whole[:, None, None, None]) * (there[:, 1:] * weight)[..., None, None]
        wanted = gold[:, None, :] * (there * weight)[..., None]
        same = (gold[:, None, :] * (there[:, 1:] * weight)[..., None]).sum(axis=(0, 1))
        slope = np.concatenate([np.einsum("dtf,dtl->fl", x, wanted - single), np.diag(same) - pair.sum(axis=(0, 1))]) - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta + 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Model(theta[:N_FEATURES], theta[N_FEATURES:])


def measures(column: pa.Array, model: Model) -> list[tuple]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content share) of each text."""
    out = []
    for group in groups(column, lower=False):
        inside = np.zeros(len(group.data) + 1, np.int8)
        inside[group.start] = 1
        np.subtract.at(inside, group.end, 1)
        chars = _sums((np.cumsum(inside[:-1]) > 0) & _FIRST_BYTE[group.data])[group.bounds]
        symbols = _sums(_SYMBOLS[group.data])[group.bounds]
        repeats = _sums(_repeated(group))[group.words]
        features, n, bounds = line_features(group)
        for k in range(len(group)):
            words = int(group.words[k + 1] - group.words[k])
            repeated = int(repeats[k + 1] - repeats[k])
            failed = words < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * words
            part = slice(bounds[k], bounds[k + 1])
            share = content_share(model, features[part], n[part]) if words else 0.0
            lines = [x for x in group.data[group.bounds[k] : group.bounds[k + 1]].tobytes().split(b"\n") if x.strip(b" \t\n\v\f\r")] if bounds[k + 1] - bounds[k] > 1 else []
            out.append((words, int(chars[k + 1] - chars[k]), int(symbols[k + 1] - symbols[k]), len(lines) - len(set(lines)), repeated, failed, not failed and share >= MIN_CONTENT, share))
    return out


def _repeated(group: Group, size: int = 8) -> np.ndarray:
    """Of each word, whether it is in a window of ``size`` words that its text has twice or more."""
    runs, bounds = windows(group, size)
    text = np.repeat(np.arange(len(group)), np.diff(bounds))
    word = np.arange(len(runs)) - bounds[text] + group.words[text]
    order = np.lexsort((runs, text))
    same = (runs[order][1:] == runs[order][:-1]) & (text[order][1:] == text[order][:-1])
    twice = np.zeros(len(runs), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(group.hash) + 1, np.int64)
    np.add.at(cover, word[twice], 1)
    np.subtract.at(cover, word[twice] + size, 1)
    return np.cumsum(cover)[: len(group.hash)] > 0


def quality_report(docs: DataFrame, model: Model) -> DataFrame:
    """The rules' figures and verdict for every row of ``docs`` (doc_id, text, ...), over whole texts.

    Returns doc_id, n_words, word_chars (code points in words), n_symbols, n_dup_lines, n_repeat_words, base_failed (under 20
    words, or over 30 % of words in windows of eight words that the text repeats), kept and content_share.

    Defined cases: a null, empty or blank text has no words, fails the base rule and isn't kept. Repeated rows are judged
    each for itself; a null doc_id stays null; an empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    kinds = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64())]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = measures(batch.column("text"), model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds))], names=["doc_id", *(name for name, _ in kinds)])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judged, schema)


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep."""

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([r[6] for r in measures(batch.column("text"), model)], pa.bool_()))

    return docs.mapInArrow(good, docs.schema)
