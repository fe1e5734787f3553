"""Cutting-stock packing, dual-tree search and conversation repair against brute force, and their defined cases."""

import random
import re
import time
from collections import Counter, defaultdict
from functools import cache
from hashlib import sha256
from itertools import product
from math import floor, log
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from costfield.llm import conversations, cutting_stock, lexical_search, main_text, quality, secrets, stock_packing

PATH, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, part int, no long, n long, length long, ids string, terms string, score long"


def make_docs(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, "x", "y", 5) for i, t in rows], DOCS)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) + r.choice(["", "", ".", ",\n"]) for _ in range(n))


# --- cutting stock


def fewest(histogram, capacity):
    """The fewest pieces of stock, by brute force over all ways to fill one after the other."""
    items = tuple(sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True))

    @cache
    def best(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        fills = {()}
        for k in range(len(rest)):
            fills |= {(*f, k) for f in fills if sum(rest[j] for j in f) + rest[k] + first <= capacity}
        return 1 + min(best(tuple(x for k, x in enumerate(rest) if k not in f)) for f in fills)

    return best(items)


@pytest.mark.parametrize("seed", range(12))
def test_column_generation_bounds_and_meets_the_demand(seed):
    r = random.Random(seed)
    capacity = 10
    histogram = Counter(r.randint(2, 9) for _ in range(8))
    lengths = np.array(sorted(histogram))
    found = cutting_stock.fractional(lengths, np.array([histogram[k] for k in lengths.tolist()], float), capacity)
    value = sum(x for _, x in found)
    assert sum(k * n for k, n in histogram.items()) / capacity <= value + 1e-6
    assert value <= fewest(histogram, capacity) * (1 + cutting_stock.GAP) + 1e-6
    met = Counter()
    for pattern, x in found:
        assert sum(int(lengths[i]) * n for i, n in pattern.items()) <= capacity
        for i, n in pattern.items():
            met[int(lengths[i])] += n * x
    assert all(abs(met[k] - n) < 1e-6 for k, n in histogram.items())


SHORT = dict(Counter((20 + np.random.default_rng(1).lognormal(5.5, 0.9, 3000)).astype(int).clip(0, 2047).tolist()))


@pytest.mark.parametrize("histogram", [{}, {5: 3}, {2048: 7}, {1500: 100_000, 548: 20, 600: 5}, {1024: 3, 512: 2, 256: 4}, dict(Counter(np.random.default_rng(1).integers(1, 2048, 3000).tolist())), SHORT])
def test_patterns_are_full_and_use_what_there_is(histogram):
    plan = cutting_stock.solve(histogram, 2048)
    got = Counter(plan.left)
    for pattern, times in plan.uses:
        assert times > 0 and sum(k * n for k, n in pattern.items()) == 2048
        for k, n in pattern.items():
            got[k] += n * times
    assert +got == +Counter(histogram)
    if histogram is SHORT:
        assert sum(plan.left.values()) < 0.1 * sum(histogram.values())


def checked(rows, texts, capacity=2048):
    """The rows against the library's ids; the padding and the documents cut elsewhere than at multiples of the capacity."""
    library = Tokenizer.from_file(PATH)
    want = Counter(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for t in texts)
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        assert crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    padding = 0
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += capacity - at if at & (at - 1) else 0
    return by_doc, want, padding


def test_sequences_hold_every_id_once(spark):
    texts = [None, "", " ", "a", "a  b   c \n\n d\t e ", "Ünï <|endoftext|> x", "日本語 テキスト", prose(0, 9000), *(prose(k, 20 * k) for k in range(1, 40)), "don't can't 123 4567 !!! ...", "x" * 5000]
    got = stock_packing.pack_sequences(make_docs(spark, list(enumerate(texts))).repartition(3), PATH, RANKS, with_ids=True).collect()
    by_doc, want, padding = checked(got, texts)
    ids = {k: b"".join(r.ids for r in sorted(v, key=lambda r: r.start)) for k, v in by_doc.items()}
    assert Counter(ids.values()) == want and padding == 0
    for k, v in by_doc.items():
        at = 0
        for r in sorted(v, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[k]) // 4
            at += r.length


def test_a_hot_length_is_cut_in_any_number_of_tasks(spark, monkeypatch):
    docs = make_docs(spark, [(7, "a b c d e")] * 500 + [(None, "a b")] * 3).repartition(5)
    for sent in (10_000, 0):  # both ways to the ids of what is cut
        monkeypatch.setattr(stock_packing, "SENT", sent)
        got = stock_packing.pack_sequences(docs, PATH, RANKS, capacity=16, with_ids=True).collect()
        _, _, padding = checked(got, [], 16)
        assert padding == 0 and sum(r.length for r in got) == 500 * 6 + 3 * 3
    assert stock_packing.pack_sequences(make_docs(spark, []), PATH, RANKS).collect() == []


# --- lexical search


def scored(docs, items, top):
    words = [re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in docs]
    n, length = sum(bool(w) for w in words), sum(map(len, words))
    df = Counter(t for w in words for t in set(w))
    out = []
    for item, text in dict.fromkeys((i, t or "") for i, t in items):
        asked = Counter(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))
        found = []
        for (doc, _), w in zip(docs, words, strict=True):
            tf, m = Counter(w), 75 + 25 * len(w) * n // length if length else 0
            score = sum(q * floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m)) for t, q in asked.items() if tf[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, k, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [512, 3])
def test_search_ranks_as_all_scores_do(spark, monkeypatch, block):
    monkeypatch.setattr(lexical_search, "ITEMS", block)
    r = random.Random(4)
    word = lambda: f"w{min(r.randint(0, 60), r.randint(0, 60))}"
    docs = [(k, " ".join(word() for _ in range(r.randint(0, 40)))) for k in range(400)]
    docs += [(k, "w1 w2 W3 É w59") for k in range(900, 400, -1)] + [(5, "w1 w1"), (5, "w1 w1"), (None, "w1 w2 W3 É w59 w58"), (901, None), (902, " .,"), (903, "w7 " * 5000)]
    items = [(k, " ".join(word() for _ in range(r.randint(1, 12)))) for k in range(10)] + [(3, "É w3 w3"), (3, "É w3 w3"), (11, None), (12, "absent"), (None, "w59 w58")]
    table = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, score int")
    got = lexical_search.lexical_search(make_docs(spark, docs).repartition(4), table, top=7).collect()
    assert sorted(map(tuple, got), key=str) == scored(docs, items, 7)


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.lexical_search(make_docs(spark, []), items).collect() == []
    assert lexical_search.lexical_search(make_docs(spark, [(1, "a b")]), items.limit(0)).collect() == []


def test_trees_drop_most_pairs():
    r = np.random.default_rng(3)
    texts = [" ".join(f"t{group}x{r.integers(0, 30)}" for _ in range(30)) for group in range(40) for _ in range(50)]
    asked = [(g, f"t{g}x1 t{g}x2 t{g}x3") for g in range(40)]
    terms = {t: i for i, t in enumerate(sorted({t for _, x in asked for t in lexical_search.terms_of(x)}))}
    found = [Counter(map(terms.get, lexical_search.terms_of(t))) for t in texts]
    for f in found:
        f.pop(None, None)
    prepared = lexical_search.Items(asked, len(texts), 30 * len(texts), Counter(t for f in found for t in f), terms)
    search = lexical_search.Search(prepared, 5, {})
    start = np.cumsum([0, *map(len, found)])
    search.batch(list(range(len(texts))), np.full(len(texts), 30), start, np.array([t for f in found for t in f]), np.array([n for f in found for n in f.values()]))
    assert all(len(b) == 5 for b in search.best)
    assert search.scored < 0.25 * len(texts) * len(asked)


# --- conversations


def cheapest(rows):
    """(cost, audit, repaired) of (role, text, fault) rows, over all edits with two insertions at most before each row and at the end."""
    found = {(None, 0, "", ())}  # initial of the last role, cost, letters, turns
    after = {None: "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def inserted(some):
        out = set(some)
        for _ in range(2):
            some = {(after[s], c + 2, x + "I", (*t, f"{name[after[s]]}:")) for s, c, x, t in some}
            out |= some
        return out

    for role, text, fault in rows:
        step = set()
        for s, c, x, t in inserted(found):
            step.add((s, c + 3, x + "D", t))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] == "s" and s is None and not t or role[:1] in ("u", "a") and after[s] == role[:1]:
                    step.add((role[:1], c + more, x + "K", (*t, f"{role}:{text}")))
                step.add((after[s], c + 2 + more, x + "R", (*t, f"{name[after[s]]}:{text}")))
        best = {}
        for p in step:
            best[p[0]] = min(best.get(p[0], p), p, key=lambda p: p[1:3])
        found = set(best.values())
    s, c, x, t = min((p for p in inserted(found) if p[0] in (None, "a")), key=lambda p: p[1:3])
    return c, x, "\n".join(t)


def every_path(rows):
    """The same without any choice on the way: all sequences of edits."""
    after, out = {None: "u", "s": "u", "u": "a", "a": "u"}, []
    for edits in product(*([[i + e for i in ("", "I", "II") for e in "DKR"]] * len(rows)), ["", "I", "II"]):
        state, cost, good = None, 0, True
        for k, letters in enumerate(edits):
            for e in letters:
                role, _, fault = rows[k] if e != "I" else ("", "", "")
                must = fault in ("blank", "duplicate")
                if e == "D":
                    cost += 3
                    continue
                cost += 2 * (e != "K") + (fault == "truncated")
                to = role[:1] if e == "K" else after.get(state)
                good = good and not must and (to == after.get(state) or to == "s" and state is None)
                state = to
        if good and state in (None, "a"):
            out.append((cost, "".join(edits)))
    return min(out)


def repaired(rows):
    edits, turns = [], []

    def emit(letter, role, text, turn):
        edits.append(letter)
        if role is not None:
            turns.append(f"{role}:{text}")

    search = conversations.Repair(emit)
    held = 0
    for k, (role, text, fault) in enumerate(rows):
        search.row(k, role, text, fault)
        held = max(held, search.held)
    return (search.finish(), "".join(edits), "\n".join(turns)), held


@pytest.mark.parametrize("seed", range(60))
def test_repair_is_the_cheapest_and_ascii_least(seed):
    r = random.Random(seed)
    rows = [(r.choice(["system", "user", "assistant", "tool", " "]), f"t{k}", r.choice(["", "", "blank", "duplicate", "truncated"])) for k in range(r.randint(0, 4))]
    got, _ = repaired(rows)
    assert got == cheapest(rows) and got[:2] == every_path(rows)
    longer = [(r.choice(["system", "user", "assistant", "x"]), f"t{k}", r.choice(["", "", "truncated", "duplicate"])) for k in range(60)]
    assert repaired(longer)[0] == cheapest(longer)


def test_memory_is_bounded_while_survivors_coalesce():
    r = random.Random(1)
    rows = [(r.choice(["user", "assistant", "system"]), "t.", r.choice(["", "truncated"])) for _ in range(30_000)]
    began = time.time()
    got, held = repaired(rows)
    assert held < 200 and len(got[1]) >= 30_000 and time.time() - began < 20


CONV = "conv_id long, turn long, role string, text string, fault string, dropped string, h long"


def test_conversations_against_rows_one_by_one(spark):
    r = random.Random(9)
    rows = [(c, t, r.choice(["user", "assistant", "system", None]), r.choice([None, "", " \t", "Yes.", "No", "Why? so", "Ok!\n", f"x{t}."])) for c in [*range(40), None] for t in [None, *range(r.randint(0, 9))]]
    rows += rows[::7]
    table = spark.createDataFrame([(*x, "a", "b", 1) for x in rows], CONV).repartition(5).drop("dropped")
    got = {x.conv_id: x for x in conversations.repair(conversations.damaged(table)).collect()}
    turns = defaultdict(list)
    for x in conversations.repair(conversations.damaged(table), turns=True).collect():
        turns[x.conv_id].append((x.place, f"{x.role}:{x.text}"))
    assert got.keys() == {c for c, *_ in rows}
    for conv in got:
        after = []
        for c, t, role, text in rows:
            if c != conv:
                continue
            what = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            role, text = "user" if what == 4 else " " if role is None else role, " " if text is None else text
            text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
            after += [(t, role, text)] * {0: 0, 3: 2}.get(what, 1)
        after.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        faulty = []
        for k, (_, role, text) in enumerate(after):
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in [x[1:] for x in after[:k]] else "" if bare[-1] in ".!?" else "truncated"
            faulty.append((role, text, fault))
        cost, audit, text = cheapest(faulty)
        numbers = [t for t, *_ in after if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:], strict=False))
        count = Counter(f for *_, f in faulty)
        assert tuple(got[conv]) == (conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha256(text.encode()).hexdigest())
        assert "\n".join(x for _, x in sorted(turns[conv])) == text


def test_conversations_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    assert conversations.repair(conversations.damaged(empty)).collect() == []
    alone = spark.createDataFrame([("7", k, "user", "a.") for k in range(200) if crc32(f"7:{k}".encode()) % 20 == 0], "conv_id string, turn long, role string, text string")
    assert [tuple(r) for r in conversations.repair(conversations.damaged(alone)).collect()] == [("7", 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())]


# --- mended operators


@pytest.mark.parametrize("seed", range(25))
def test_page_labels_cost_least_of_all(seed):
    """The blocks of small random pages, against every labelling."""
    r = random.Random(seed)

    def inner(depth):
        kind = r.choice(["<p>{}</p>", "<div>{}</div>", "<ul><li><a href=x>{}</a></li></ul>", "<nav>{}</nav>", "<article>{}</article>", "<div class='ad'>{}</div>", "<section><p>{}</p></section>"])
        return kind.format(prose(r.random(), r.choice([1, 3, 12, 60])) if depth == 0 or r.random() < 0.6 else "".join(inner(depth - 1) for _ in range(2)))

    html = "".join(inner(2) for _ in range(5))
    weights = main_text.PLAIN * np.array([r.uniform(0.3, 1.5) for _ in main_text.PLAIN])
    blocks = main_text.blocks_of(html)[:11]
    if blocks:
        content, boilerplate = main_text.terminals(blocks, weights)
        edges = main_text.edges_of(blocks)
        cost = lambda label: sum(content[k] if x else boilerplate[k] for k, x in enumerate(label)) + sum(weights[main_text.N_FEATURES + kind] for a, b, kind in edges if label[a] != label[b])
        found = main_text.minimum_cut(content, boilerplate, [(a, b, float(weights[main_text.N_FEATURES + kind])) for a, b, kind in edges])
        assert cost(found) == pytest.approx(min(map(cost, product([False, True], repeat=len(blocks)))))
        if len(main_text.blocks_of(html)) == len(blocks):
            assert main_text.main_text(html, weights) == "\n".join(b.text for b, inside in zip(blocks, found, strict=True) if inside)


def test_the_cut_beats_the_threshold_where_tags_and_names_tell_nothing():
    """Pages of nothing but divs: weights and capacities are fitted on tagged pages, and judged by blocks."""
    r = random.Random(8)

    def page(k, bare):
        body = [("p", prose(r.random(), r.choice([2, 8, 30, 60]))) for _ in range(r.randint(4, 8))]
        rest = [("li", r.choice(["<a href=x>{}</a>", "{}"]).format(prose(r.random(), r.choice([1, 2, 8, 12])))) for _ in range(r.randint(6, 9))]
        tag = lambda t: "div" if bare else t
        part = lambda name, rows: f"<{tag(name)}>{''.join(f'<{tag(t)}>{x}</{tag(t)}>' for t, x in rows)}</{tag(name)}>"
        html = part("nav", rest[:3]) + part("article", body) + part("footer", rest[3:])
        return html, {b.text for t, x in body for b in main_text.blocks_of(f"<p>{x}</p>")}

    told = sorted(x for k in range(80) for x in main_text._told(main_text.blocks_of(page(k, False)[0])))
    fitted = main_text._climb(told, 300)
    plain = np.concatenate([fitted[: main_text.N_FEATURES], np.zeros(main_text.N_EDGES)])
    right = Counter()
    for k in range(150):
        html, body = page(k, True)
        for name, weights in (("cut", fitted), ("threshold", plain)):
            found = set(main_text.main_text(html, weights).split("\n"))
            right[name] += sum((b.text in found) == (b.text in body) for b in main_text.blocks_of(html))
    assert fitted[main_text.N_FEATURES :].min() >= 0 and right["cut"] > 1.02 * right["threshold"]


def test_opaque_strings_beside_many_hashes_in_linear_time():
    r = random.Random(2)
    text = "\n".join(f"{r.getrandbits(128):032x} Ab{r.getrandbits(120):030x}Z9 token={'Qx7' * 6}{k}" for k in range(50_000))
    began = time.time()
    base = secrets.base_spans(text)
    found = secrets.opaque_spans(text, base)
    assert time.time() - began < 20
    taken = sorted(s[1:] for s, _ in base)[:300]
    limit = taken[-1][0]
    slow = [m.span() for m in secrets._OPAQUE.finditer(text[:limit]) if all(c.search(m[0]) for c in secrets._CLASSES) and not any(a < m.end() and m.start() < b for a, b in taken)]
    assert [s[1:] for s, _ in found if s[2] < limit - 100] == [s for s in slow if s[1] < limit - 100]


def test_fits_take_a_row_of_each_id(spark):
    schema = "doc_id long, text string"
    rows = [(k, prose(k, 60)) for k in range(12)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, quality int")
    once = quality.fit(spark.createDataFrame(rows, schema), labels, steps=5)
    many = quality.fit(spark.createDataFrame(rows + rows[:1] * 300, schema).repartition(4), labels, steps=5)
    assert np.array_equal(once.unary, many.unary) and np.array_equal(once.chain, many.chain)
    pages = [(k, f"<html><nav>menu {k}</nav><article><p>{prose(k, 50)}</p></article></html>") for k in range(8)]
    one = main_text.fit(spark.createDataFrame(pages, "page_id long, html string"))
    assert np.array_equal(one, main_text.fit(spark.createDataFrame(pages * 20, "page_id long, html string").repartition(3).withColumn("extra", F.lit(1))))
