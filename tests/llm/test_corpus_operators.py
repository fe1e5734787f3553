"""The operators against brute force on small fixtures, and their defined cases."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from costfield.llm import decontamination, line_templates, main_text, near_duplicates, packing, personal_data, quality, secrets, sharding, token_counts
from costfield.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, bucket string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def make_docs(spark, texts, ids=None, sources=None):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", s, None if t is None else len(t), "r", "k", "b") for i, t, s in zip(ids or range(len(texts)), texts, sources or ["a"] * len(texts))]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


def shingles(text):
    w = WORD.findall((text or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def texts():
    out = [None, "", " \n\t", "one two", "One TWO", "a b c d e", "word " * 400]
    for k in range(8):
        base = prose(k, 120).split()
        out.append(" ".join(base))
        for j in range(4):
            near = list(base)
            for at in random.Random(100 * k + j).sample(range(120), j):
                near[at] = f"changed{j}{at}"
            out.append(" ".join(near))
    return out + out[7:12]


def test_near_duplicates_are_those_of_brute_force(spark, texts):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(make_docs(spark, texts)).collect()}
    assert {i: (got[i].n_shingles, got[i].component_id, got[i].kept) for i in got} == {i: (len(s), label[i], label[i] == i) for i, s in enumerate(sets)}
    kept = near_duplicates.keep_first(make_docs(spark, texts))
    assert kept.columns == make_docs(spark, texts).columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(texts)) if label[i] == i]


def test_near_duplicates_defined_cases(spark):
    assert near_duplicates.near_duplicates(make_docs(spark, [])).count() == 0
    docs = make_docs(spark, [prose(1, 30), prose(1, 30), prose(1, 30), prose(2, 30)], [4, 4, None, 9])
    got = sorted(map(tuple, near_duplicates.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(4, 26, 4, True), (4, 26, 4, True), (None, 26, None, True), (9, 26, 9, True)], key=str)
    assert near_duplicates.keep_first(docs).count() == 3


def test_a_hub_joins_texts_that_differ(spark):
    base = prose(3, 200).split()
    spokes = []
    for k in range(20):
        text = list(base)
        for at in range(k, 200, 60):
            text[at] = f"x{k}"
        spokes.append(" ".join(text))
    got = near_duplicates.near_duplicates(make_docs(spark, [" ".join(base), *spokes]))
    assert got.select("component_id").distinct().count() == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("hot", [0, 200])
def test_sharding(spark, texts, hot):
    all_texts = texts * 3 + ["the same text"] * hot
    docs = make_docs(spark, all_texts, [k % 50 for k in range(len(all_texts))])
    got = sharding.shard_documents(docs, shards=4).select("row.doc_id", "row.text", "size", "text_crc32", "shard", "slot").collect()
    assert len(got) == len(all_texts)
    load = Counter()
    for r in got:
        assert r["size"] == len((r.text or "").encode()) + 1
        load[r.shard] += r["size"]
    largest = max(r["size"] for r in got)
    assert max(load.values()) - min(load[k] for k in range(4)) <= 2 * largest
    for k in range(4):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert sharding.shard_documents(make_docs(spark, [])).count() == 0


def test_one_row_repeated_is_split(spark):
    docs = make_docs(spark, ["same"] * 400, [1] * 400)
    got = sharding.shard_documents(docs, shards=4).groupBy("shard").count().collect()
    assert len(got) == 4 and max(r["count"] for r in got) <= 110


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def test_secrets(spark):
    odd = "key: passwordPASSWD = 'abcdefghijkl' ſecret=abcdefghijklmn token=short AKIAABCDEFGHIJKLMN0 é deadbeefdeadbeef0 API_KEY:\"Zx9Qw8Er7Ty6Ui5Op4\""
    example = "token=EXAMPLEEXAMPLE0123"
    rows = [odd, None, "", example, example, example, "Aa0Bb1Cc2Dd3Ee4Ff5Gg6Hh7 here"]
    got = {r.doc_id: r for r in secrets.secrets(make_docs(spark, rows, sources=["a", "a", "b", "a", "b", "c", None])).collect()}
    for i, text in enumerate(rows):
        base = []
        for k, (name, p, fits) in enumerate([("assign", ASSIGN, lambda m: len(m[2]) >= 12), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16)]):
            base += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in p.finditer(text or "") if fits(m)]
        joined = [x[2] for x in sorted(base)]
        assert got[i].base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(got[i].spans.split(",")) | {""}
    assert got[3].n_example == 1 and got[3].n_live == 0
    assert got[0].n_live == 3 and got[0].n_shared == 1
    assert got[6].spans == "opaque:0:24"
    assert secrets.secrets(make_docs(spark, [])).count() == 0


RULES = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= sum(c.isdigit() for c in m[0]) <= 19 and personal_data._passes_luhn(re.sub(r"\D", "", m[0]))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= sum(c.isdigit() for c in m[0]) <= 15),
]


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(5)
    for _ in range(20000):
        text = "".join(r.choice("a1.@+- 0(25%4b") for _ in range(r.randint(0, 40)))
        expected = [(k, *m.span()) for k, p, fits in RULES for m in p.finditer(text) if fits(m)]
        assert sorted(expected) == sorted(personal_data.base_spans(text)), text


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("mail john at example dot com", "email", "john at example dot com"),
        ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("call plus one five five five one two three four five six seven now", "phone", "plus one five five five one two three four five six seven"),
        ("192[.]168[.]1[.]1", "ip", "192[.]168[.]1[.]1"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    spans = [(k, text[a:b]) for part in personal_data.all_spans(text) for k, a, b in part]
    assert (kind, found) in spans


@pytest.mark.parametrize("text", ["look at the dot product", "she is at the end. dot com is at x", prose(4, 200), "one two three", "un dos tres cuatro"])
def test_clean_texts_have_no_personal_data(text):
    assert personal_data.all_spans(text) == ([], [])


@pytest.mark.parametrize("text", ["see www." + "a." * 5000 + "x for [at] the list", "x" + "-a" * 5000 + " at y", "x" + "-at" * 5000 + "-", "@a" + "_" * 10000 + "x", "one two " * 5000, "a at " * 5000, "a@" * 5000, "a dot " * 4000 + "at b", "a [at] b [dot] " * 2000 + "c", "a at " + "b-" * 5000 + ".c dot com", "+1" + "(" * 10000, "six-" * 5000])
def test_disguises_take_linear_time(text):
    began = time.perf_counter()
    personal_data.all_spans(text)
    assert time.perf_counter() - began < 1


_HIDES = {
    "brackets": lambda a, b, top: f"{a} [at] {b} [dot] {top}",
    "parentheses": lambda a, b, top: f"{a}(at){b}(dot){top}",
    "words": lambda a, b, top: f"{a} at {b} dot {top}",
    "underscores": lambda a, b, top: f"{a}_at_{b}_dot_{top}",
    "homoglyph": lambda a, b, top: f"{a}@{b}.{top}".replace("o", "\u043e").replace("a", "\u0430").replace("e", "\u0435"),
    "full width": lambda a, b, top: "".join(chr(ord(c) + 0xFEE0) for c in f"{a}@{b}.{top}"),
}


@pytest.mark.parametrize("kind", _HIDES)
def test_generated_disguises_are_caught_and_mapped(kind):
    """Of a hundred generated addresses of each kind, nine in ten at least are found whole, in their place, and the text without them is clean."""
    r, caught = random.Random(len(kind)), 0
    word = lambda k: "".join(r.choice("abcdeghilmnorstuz") for _ in range(k))
    for _ in range(100):
        before, after = (" ".join(word(r.randint(2, 8)) for _ in range(12)) for _ in range(2))
        hidden = _HIDES[kind](f"{word(5)}.{word(4)}" if r.random() < 0.5 else word(6), word(7), r.choice(["com", "org", "net", "de"]))
        text = f"{before}, {hidden}; {after}."
        caught += ("email", text.index(hidden), text.index(hidden) + len(hidden)) in personal_data.all_spans(text)[1]
        assert personal_data.all_spans(f"{before}, ; {after}.") == ([], [])
    assert caught >= 90, caught


@pytest.mark.parametrize("base", ["four one five five five five two six seven one", "zwei drei vier fünf sechs sieben acht neun eins zwei"])
def test_spelled_numbers_are_caught(base):
    assert ("phone", 5, 5 + len(base)) in personal_data.all_spans(f"call {base}, please")[1]


def test_personal_data_rows(spark):
    got = {r.doc_id: r for r in personal_data.personal_data(make_docs(spark, [None, "", "a@b.cd 1.2.3.4"])).collect()}
    assert got[0].spans == got[1].spans == "" and got[2].spans == "email:0:6,ip:7:14"
    assert got[0].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_token_counts(spark):
    tokenizers, P = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    r = random.Random(3)
    rows = [None, "", "<|endoftext|>a<|endoftext|>", "x" * 5000] + ["".join(r.choice("abcA' \n\t.,!éß½²9٣0'sll  \x1c　字ñ-_<|>\x85") for _ in range(r.randint(0, 60))) for _ in range(500)]
    got = {x.doc_id: x for x in token_counts.token_counts(make_docs(spark, rows), path).collect()}
    for i, text in enumerate(rows):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 1024)


def test_quality_figures(spark, texts):
    junk = ["HELLO!! THERE!! YOU!! ALL!! " * 20, "a### b$$$ c%%% d&&& " * 20, "same line of words\nsame line of words\n\n \n" * 3]
    rows = texts + junk
    model = quality.Model(np.zeros((quality.N_FEATURES, 2)), np.zeros((2, 2)))
    got = {r.doc_id: r for r in quality.quality_report(make_docs(spark, rows), model).collect()}
    for i, text in enumerate(t or "" for t in rows):
        w = WORD.findall(text)
        runs = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        often, cover, seen, repeated = Counter(runs), set(), set(), 0
        for k, x in enumerate(runs):
            cover |= set(range(k, k + 8)) if often[x] > 1 else set()
        for line in text.split("\n"):
            if WORD.search(line):
                repeated += line in seen
                seen.add(line)
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        assert tuple(got[i])[1:8] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(cover), failed, not failed), i


def test_the_field_learns_lines(spark):
    good = [prose(k, 60).capitalize() + ".\n" + prose(k + 500, 40).capitalize() + "." for k in range(40)]
    bad = [" ".join(x.upper() + "!!" for x in prose(k + 1000, 60).split()) for k in range(40)]
    docs = make_docs(spark, good + bad)
    labels = spark.createDataFrame([(k, int(k < 40), 0) for k in range(0, 80, 2)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.kept for r in quality.quality_report(docs, model).collect()}
    assert [got[k] for k in range(80)] == [True] * 40 + [False] * 40
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.keep_good(docs, quality.fit(docs, labels.limit(0))).count() == 80


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(0)
    for _ in range(50):
        model = quality.Model(r.normal(size=(quality.N_FEATURES, 2)), r.normal(size=(2, 2)))
        x = r.normal(size=(6, quality.N_FEATURES))
        scores = x @ model.unary
        paths = [[(k >> j) & 1 for j in range(6)] for k in range(64)]
        best = max(paths, key=lambda p: sum(scores[j, p[j]] for j in range(6)) + sum(model.chain[a, b] for a, b in zip(p, p[1:])))
        assert quality.content_share(model, x, np.ones(6)) == pytest.approx(sum(best) / 6)


def test_rows_that_repeat_are_dealt_to_many_groups(spark):
    docs = make_docs(spark, ["one two three", None]).filter("doc_id = 0").join(spark.range(600).select(), how="cross")
    got = packing.pack_documents(docs, group_rows=50).collect()
    groups = Counter(r.bin.split(":")[0] for r in got)
    assert len(got) == 600 and len({r.bin for r in got}) == 600 and max(groups.values()) < 120


def test_a_very_long_labelled_document_does_not_slow_the_fit(spark):
    long = "\n".join(f"this line {k} is one of very many" for k in range(60_000))
    docs = make_docs(spark, [long, "SHORT!! LOUD!! WORDS!!", None, ""])
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 0), (3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    began = time.perf_counter()
    model = quality.fit(docs, labels)
    assert time.perf_counter() - began < 20
    assert quality.quality_report(docs, model).filter("doc_id = 0").first().content_share > 0.5


def test_the_cut_decides_where_the_classifier_alone_is_wrong():
    """Names stripped: a short block among long siblings is content, a longer one among links is not; without edges both are labelled the other way."""
    long = "<p>" + "These are the words of an article, and they go on. " * 4 + "</p>"
    links = "".join(f"<div><a href=x>Link number {k} here</a></div>" for k in range(3))
    html = f"<div>{links}<div>Ten words of a plain kind that nobody has linked.</div>{links}</div><div>{long}<div>Yes</div>{long}</div>"
    text = main_text.main_text(html, main_text.PLAIN)
    assert "Yes" in text and "Link" not in text and "Ten words" not in text
    alone = main_text.main_text(html, np.concatenate([main_text.PLAIN[: main_text.N_FEATURES], np.zeros(main_text.N_EDGES)]))
    assert "Yes" not in alone and "Ten words" in alone


@pytest.mark.parametrize("html", ["".join(f"<p>{'word ' * (1 if k % 2 else 40)}.</p>" for k in range(50_000)), "<b>" * 8000 + "".join(f"<p>some text {k}</p>" for k in range(8000)), "<div class=ad>x" * 5000, "<div class=ad>" * 3000 + "x" + "</div>" * 3000, "<p>x" * 20_000 + "</i>" * 20_000])
def test_long_pages_take_linear_time(html):
    began = time.perf_counter()
    main_text.main_text(html, main_text.PLAIN)
    assert time.perf_counter() - began < 15


def test_ownership_against_brute_force(spark):
    """Live, shared and example candidates by owners and repositories, counted in plain Python; only live opaque strings are added."""
    r = random.Random(9)
    strings = ["".join(r.choice("abcdefghkmnpqrstuvwxyzABCDEFGHKMNP23456789") for _ in range(24)) + "aB3" for _ in range(30)] + ["token=" + "q" * 14 + f"{k:02d}" for k in range(4)]
    rows = []
    for k in range(300):
        mine = r.sample(strings[:12], r.randint(0, 2)) + [strings[12 + k % 18]] * (k % 7 == 0) + [strings[30 + k % 4]] * (k % 50 == 0)
        rows.append((None if k % 97 == 5 else f"s{r.randint(0, 5)}", " and ".join([f"text {k}", *mine, "end"])))
    rows.append(("s0", rows[0][1]))
    docs = make_docs(spark, [t for _, t in rows] + [None, ""], ids=[*range(300), 0, 301, 302], sources=[s for s, _ in rows] + ["s1", None])
    got = secrets.secrets(docs).collect()
    held = {}
    for (source, text), i in zip(rows, [*range(300), 0], strict=True):
        for s in strings:
            if f" {s} " in text:
                held.setdefault(s, set()).add((source or "", i))
    kind = {}
    for s, having in held.items():
        owners, repositories = {o for o, _ in having}, len(having)
        example = len(owners) >= 3 or repositories >= 10
        kind[s] = "example" if example else "live" if len(owners) == 1 and secrets.bits(s.removeprefix("token=")) >= 2.5 else "shared"
    assert set(kind.values()) == {"live", "shared", "example"}
    expected = Counter()
    for (_, text), i in zip(rows, [*range(300), 0], strict=True):
        mine = [s for s in strings if f" {s} " in text]
        spans = [(text.index(s), f"{'assign' if '=' in s else 'opaque'}:{text.index(s)}:{text.index(s) + len(s)}") for s in mine if "=" in s or kind[s] == "live"]
        expected[i, ",".join(x for _, x in sorted(spans)), *(sum(kind[s] == k for s in mine) for k in ("live", "shared", "example"))] += 1
    assert Counter((x.doc_id, x.spans, x.n_live, x.n_shared, x.n_example) for x in got if x.doc_id <= 300) == expected
    assert [(x.spans, x.n_live) for x in got if x.doc_id > 300] == [("", 0)] * 2


def test_line_templates(spark):
    rows = [f"{prose(k, 40)}\nPage {k} of the printed edition of this book\n{prose(k + 900, 40)}" for k in range(15)]
    copies = [f"{prose(77, 30)}\n{prose(78, 30)}\n{prose(79, 30)}"] * 20
    odd = [None, "", "\n\n"]
    docs = make_docs(spark, rows + copies + odd)
    got = {r.row.doc_id: r for r in line_templates.drop_recurring_lines(docs).collect()}
    for k, text in enumerate(rows):
        assert got[k].n_dropped == 1 and got[k].row.text == "\n".join(text.split("\n")[::2])
        assert got[k].row.n_chars == len(got[k].row.text)
    for k, text in enumerate(copies + odd, len(rows)):
        assert got[k].row.text == text and got[k].n_dropped == 0
    assert [c for c in got[0].row.asDict()] == docs.columns
    alone = line_templates.drop_recurring_lines(make_docs(spark, [*rows, "Page 3 of the printed edition of this book"])).filter("row.doc_id = 15").first()
    assert (alone.row.text, alone.row.n_chars, alone.n_lines, alone.n_dropped) == ("", 0, 1, 1)


def brute_line_dedup(texts, least=10):
    """The rules in plain Python: leaves, votes, templates, witnesses."""
    lines = {}
    for text in set(t for t in texts if t is not None):
        for place, line in enumerate(text.split("\n")):
            words = [line_templates.ANY if re.search("[0-9]", w) else w for w in WORD.findall(line)]
            if words:
                lines[text, place] = words
    leaf = lambda words: (len(words), *words[:3])
    leaves = {}
    for (text, place), words in lines.items():
        leaves.setdefault(leaf(words), []).append((text, place, words))
    followed = {}
    for key, held in leaves.items():
        if len({t for t, _, _ in held}) < least:
            continue
        fixed = []
        for at in range(key[0]):
            word, n = Counter(w[at] for _, _, w in held).most_common(1)[0]
            fixed.append(word if 2 * n >= len(held) else None)
        sure = sum(f is not None for f in fixed)
        if 100 * sure >= 60 * len(fixed):
            followed[key] = [(t, p) for t, p, w in held if 100 * sum(a == b for a, b in zip(w, fixed, strict=True)) >= 80 * sure]
    shared = {k: v for k, v in followed.items() if len({t for t, _ in v}) >= least}
    covered = Counter()
    for v in shared.values():
        for t, p in v:
            covered[t] += len(" ".join(WORD.findall(t.split("\n")[p])).encode())
    copies = {t for t, n in covered.items() if 100 * n > 75 * len(t.encode())}
    gone = {(t, p) for v in shared.values() if len({t for t, _ in v} - copies) >= least for t, p in v}
    return [None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (t, p) not in gone) for t in texts]


def test_line_templates_against_brute_force(spark):
    r = random.Random(5)
    notices = [prose(100 + k, r.randint(4, 30)).split() for k in range(6)]
    out = [None, "", "   ", "\t\v\n \r"]
    for k in range(120):
        body = [prose(1000 + 7 * k + j, r.randint(1, 40)) for j in range(r.randint(0, 3))]
        for notice in notices:
            if r.random() < 0.3:
                words = list(notice)
                words[-1] = str(r.randint(0, 10**6))
                if r.random() < 0.2:
                    words[r.randrange(len(words))] = "changed"
                body.insert(r.randint(0, len(body)), r.choice([" ", "  ", "\t"]).join(words))
        out.append("\n".join(body))
    base = [prose(77 + k, 40) for k in range(4)]
    out += ["\n".join(" ".join("altered" if r.random() < 0.02 else w for w in x.split()) for x in base) for _ in range(40)] + ["\n".join(base)] * 30
    out += [("x" * 50 + " ") * 20_000 + "\n" + " ".join(notices[0])]
    got = {x.row.doc_id: x.row.text for x in line_templates.drop_recurring_lines(make_docs(spark, out)).collect()}
    assert [got[k] for k in range(len(out))] == brute_line_dedup(out)


def test_many_leaves_meet_the_lines_in_an_exchange(spark, monkeypatch):
    rows = [f"{prose(k, 40)}\nPage {k} of the printed edition of this book" for k in range(15)]
    monkeypatch.setattr(line_templates, "MAX_SENT", 0)
    assert sorted(r.row.text for r in line_templates.drop_recurring_lines(make_docs(spark, rows)).collect()) == sorted(prose(k, 40) for k in range(15))


def test_leaks(spark):
    items = [prose(k, 30) for k in range(6)] + ["only three words", "", None, prose(3, 30)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [None, "", prose(50, 200), f"{prose(51, 50)}\n{items[2].upper()} {prose(52, 20)}", f"{prose(53, 9)} {' '.join(items[3].split()[1:])}", f"x only three words y", prose(54, 60) + " " + items[0] + " " + items[1]]
    changed = items[4].split()
    changed[15] = "other"
    rows += [" ".join(changed), " ".join(changed[:12])]
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(make_docs(spark, rows), benchmark).collect()}
    expected = set()
    for d, text in enumerate(rows):
        w = (text or "").lower().split()
        for i, item in enumerate(items):
            v = (item or "").lower().split()
            run = lambda x: Counter(tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4)))
            for k in range(max(1, len(w) - len(v) + 1)) if v else ():
                a, b = run(w[k : k + len(v)]), run(v)
                if w and 100 * sum((a & b).values()) >= 75 * sum((a | b).values()):
                    expected.add((d, i))
    assert got == expected
    kept = decontamination.without_leaks(make_docs(spark, rows), benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(range(len(rows))) - {d for d, _ in expected})
    assert decontamination.leaks(make_docs(spark, rows), benchmark.limit(0)).count() == 0


def test_packing(spark, texts):
    rows = texts * 4 + [prose(9, 5000)]
    sources = [None if k % 7 == 0 else f"s{k % 3}" for k in range(len(rows))]
    docs = make_docs(spark, rows, sources=sources)
    got = packing.pack_documents(docs, capacity=500, group_rows=64).collect()
    words = {k: len(WORD.findall(t or "")) for k, t in enumerate(rows)}
    held = Counter()
    for r in got:
        held[r.doc_id] += r.n_words
        assert r.first_word == r.piece * 500
    assert held == Counter({k: n for k, n in words.items() if n})
    bins = {}
    for r in sorted(got, key=lambda r: r.place):
        bins.setdefault(r.bin, []).append(r)
    for pieces in bins.values():
        place = 0
        for r in pieces:
            assert r.place == place
            place += r.n_words
        assert place <= 500
        own = [sources[r.doc_id] for r in pieces if sources[r.doc_id] is not None]
        same = [" ".join(WORD.findall(rows[r.doc_id])).lower() for r in pieces]
        assert len(set(own)) == len(own) and len(set(same)) == len(same)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    r = random.Random(1)
    bins, model = packing.Bins(100), []
    for _ in range(2000):
        size, source, cluster = r.randint(1, 60), 1 << r.randint(0, 5), 1 << r.randint(0, 40)
        open_ = [(100 - sum(s for s, _, _ in b), k) for k, b in enumerate(model) if sum(s for s, _, _ in b) + size <= 100 and not any(x & source or y & cluster for _, x, y in b)]
        found, _ = bins.place(size, source, cluster)
        assert found == len(model) if not open_ else 100 - sum(s for s, _, _ in model[found]) == min(open_)[0]
        if found == len(model):
            model.append([])
        model[found].append((size, source, cluster))


def test_minimum_cut_is_that_of_brute_force():
    r = random.Random(2)
    for _ in range(200):
        n = r.randint(1, 7)
        content, other = [r.randint(0, 9) for _ in range(n)], [r.randint(0, 9) for _ in range(n)]
        edges = [(r.randrange(n), r.randrange(n), r.randint(0, 4)) for _ in range(r.randint(0, 9))]
        edges = [e for e in edges if e[0] != e[1]]
        value = lambda labels: sum(content[k] if x else other[k] for k, x in enumerate(labels)) + sum(c for a, b, c in edges if labels[a] != labels[b])
        best = min(value([bool((k >> j) & 1) for j in range(n)]) for k in range(1 << n))
        assert value(main_text.minimum_cut(content, other, edges)) == pytest.approx(best)


def test_main_text(spark):
    page = """<html><head><title>T</title></head><body><header class="site-header"><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies.</div>
    <main><article><h1>Title &amp; more</h1><p>First   paragraph of text, with <b>bold</b> words.<p>Second one.<div class="ad">Buy now</div><ul><li>Item one<li>Item two</ul>
    <aside>See also</aside><form><input><button>Send</button>Name</form><script>var t="</p>";</script></article><section id="comments"><h2>Comments</h2><p>Great article, I liked it.</p></section></main>
    <div class="sidebar"><p>Related stories, many of them.</p></div><footer>(c) 2020</footer></body>"""
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<nav><a href=a>x</a></nav>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in main_text.extract_main_text(pages, main_text.fit(pages)).collect()}
    assert got[1].text.split("\n") == ["Title & more", "First paragraph of text, with bold words.", "Second one.", "Item one", "Item two"]
    assert got[1].n_chars == len(got[1].text) and got[2].text == got[3].text == got[4].text == ""
    assert main_text.extract_main_text(pages.limit(0), main_text.PLAIN).count() == 0


def test_two_recurring_lines_that_are_most_of_their_texts(spark):
    licence, footer = prose(2000, 50), prose(2001, 50)
    bodies = [prose(k, 80) for k in range(30)]
    copies = [" ".join(w if at != 7 * k else f"altered{k}" for at, w in enumerate(prose(77, 300).split())) + "\n" + prose(78, 30) for k in range(20)]
    got = {r.row.doc_id: r for r in line_templates.drop_recurring_lines(make_docs(spark, [f"{licence}\n{b}\n{footer}" for b in bodies] + copies)).collect()}
    assert [got[k].row.text for k in range(len(bodies))] == bodies
    assert [got[k].row.text for k in range(len(bodies), len(got))] == copies


def test_a_hot_group_of_copies_does_not_hide_a_recurring_line(spark):
    notice = "Printed from the archive of this house for its readers"
    bodies = [prose(k, 80) for k in range(12)]
    base = prose(77, 300).split()
    copies = [" ".join([*base[:k], f"altered{k}", *base[k + 1 :]]) for k in range(60)]
    got = {r.row.doc_id: r for r in line_templates.drop_recurring_lines(make_docs(spark, [f"{b}\n{notice}" for b in bodies + copies])).collect()}
    assert [got[k].row.text for k in range(len(got))] == bodies + copies


def test_leaks_are_the_same_when_items_are_too_many_to_send(spark, monkeypatch):
    items = [prose(k, 20 + k) for k in range(8)] + ["only three words", prose(3, 23)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [None, "", f"{prose(51, 50)}\n{items[2].upper()} {prose(52, 20)}", "x only three words y", items[0] + " " + items[1], items[0] + " " + items[1], prose(5, 24), "w " * 30_000 + items[4]]
    docs = make_docs(spark, rows, ids=[None, 1, 2, 3, 4, 4, 6, 7])
    of = lambda: sorted(map(tuple, decontamination.leaks(docs, benchmark).collect()), key=str)
    listed = of()
    assert {(r[0], r[2]) for r in listed} == {(2, 2), (3, 8), (4, 0), (4, 1), (6, 5), (7, 4)} | {(d, 9) for d, i in [(d, i) for d, _, i, *_ in listed] if i == 3}
    monkeypatch.setattr(decontamination, "LISTED", 3)
    assert of() == listed
    monkeypatch.setattr(decontamination, "SENT", 3)
    monkeypatch.setattr(decontamination, "SENT_PRINTS", 3)
    assert of() == listed


def test_fingerprints_count_votes(spark):
    r = random.Random(2)
    rows = [[r.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 5, 300, 70_000)]
    got = decontamination.with_fingerprint(spark.createDataFrame([(x,) for x in rows], "h array<long>"), "h", "print").collect()
    for x in got:
        bits = sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in x.h) > len(x.h))
        assert x.print % (1 << 64) == bits


@pytest.mark.parametrize(
    ("text", "kind", "fragment", "whole"),
    [
        ("mail jоhn@example.com now", "email", "hn@example.com", "jоhn@example.com"),
        ("mail john@example.cоm now", "email", "john@example.c", "john@example.cоm"),
        ("call +49 1512 345678９ now", "phone", "+49 1512 345678", "+49 1512 345678９"),
        ("mail: john dot doe@example.com", "email", "doe@example.com", "john dot doe@example.com"),
    ],
)
def test_a_base_span_does_not_hide_the_whole_disguise(text, kind, fragment, whole):
    base, added = ([(k, text[a:b]) for k, a, b in part] for part in personal_data.all_spans(text))
    assert base == [(kind, fragment)] and added == [(kind, whole)]


def test_a_span_found_as_written_is_not_added_again():
    assert personal_data.all_spans("jane@example.com, +49 1512 3456789 and 1.2.3.4 … ＊")[1] == []


def test_the_best_window_lies_between_two_alignments(spark):
    rows, items = [], []
    for size in (60, 66, 73, 90):
        item = [f"w{size}x{k}" for k in range(size)]
        items.append(" ".join(item))
        half = size // 2
        altered = ["head1", "head2", *item[2:half], "in1", "in2", "in3", "in4", *item[half:-2], "tail1", "tail2"]
        rows.append(" ".join([prose(size, 40), *altered, prose(size + 1, 40)]))
        rows.append(" ".join(altered))
        rows.append(" ".join(item[3:]))
        rows.append(" ".join([*item[: half - 2], "other", *item[half - 1 :], *item[:9]]))
    items += ["one two three four five " * 6, "a b a b a b a b a b a b a b a b c d e f g h"]
    rows += ["x one two three four five " + "one two three four five " * 9, "b a b a b a b a b a b a b a b a b c d e f g h b a b a"]
    expected = {}
    for d, text in enumerate(rows):
        w = text.split()
        for i, item in enumerate(items):
            v = item.split()
            run = lambda x: Counter(tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4)))
            for k in range(max(1, len(w) - len(v) + 1)):
                a, b = run(w[k : k + len(v)]), run(v)
                share = sum((a & b).values()) / sum((a | b).values())
                if share >= 0.75 and share > expected.get((d, i), (0, 0))[0]:
                    expected[d, i] = share, k
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontamination.leaks(make_docs(spark, rows), benchmark).collect()}
    assert got == {k: (pytest.approx(share), start) for k, (share, start) in expected.items()}
    assert {(0, 0), (4, 1), (8, 2)} <= set(got)


@pytest.mark.parametrize("wrapper", ["<form>", "<div class='wrapper has-sidebar'>", "<div class='no-sidebar'>", "<div class='right-sidebar'>", "<div class='with-nav'>"])
def test_a_wrapper_named_like_boilerplate_keeps_the_article(wrapper):
    first, second, aside = (prose(k, 40) + "." for k in range(3))
    around = "<body><nav><a href=x>Home</a></nav>" + wrapper + "{}<div class='sidebar'><p>See also</p></div></body>"
    plain = f"<p>{first}</p><p>{second}</p>"
    for page in (around.format(plain), around.format(f"<article>{plain}</article>"), around.format(f"<main>{plain}</main>")):
        assert main_text.main_text(page, main_text.PLAIN).split("\n") == [first, second]
    beside = f"<article><p>{first}</p><div class='side-by-side'><p>{second}</p></div><div class='widget'><p>{aside}</p></div><p>{first}</p></article>"
    assert main_text.main_text(beside, main_text.PLAIN).split("\n") == [first, second, aside, first]


def test_near_copies_share_no_bin(spark):
    base = prose(5, 60).split()
    rows = [" ".join([*base[:k], f"altered{k}", *base[k + 1 :]]) for k in range(0, 60, 4)] + [prose(k, 60) for k in range(100, 115)] + [None, " "]
    docs = make_docs(spark, rows, ids=[*range(1, 30), None, 31, 32], sources=[f"s{k}" for k in range(len(rows))])
    got = packing.pack_documents(docs, capacity=500, near=True).collect()
    assert Counter(r.doc_id for r in got) == Counter([*range(1, 30), None])
    bins = Counter(r.bin for r in got if r.doc_id is not None and r.doc_id <= 15)
    assert len(bins) == 15 and max(bins.values()) == 1 and len({r.bin for r in got}) == 15


@pytest.mark.parametrize("found", ["anna at firma dot pl", "kim at firm dot se", "lee at shop dot cloud", "jane at example.com", "jane_at_example.com"])
def test_bare_words_end_in_any_top_level_domain(found):
    text = f"mail {found}, please"
    assert [text[a:b] for k, a, b in personal_data.all_spans(text)[1] if k == "email"] == [found]
    assert personal_data.all_spans(f"hello {found}")[1] or "dot" not in found
    assert personal_data.all_spans("he wrote to john.doe at example.com")[1] == [("email", 12, 35)]


@pytest.mark.parametrize("text", ["we bought it at amazon.com", "contact us at example.com", "look at the dot so small", "we met at noon.then left", "write to me at home.she"])
def test_at_in_prose_is_no_address(text):
    assert personal_data.all_spans(text)[1] == []


def test_several_templates_in_a_leaf(spark):
    """Two or three templates that share the leading tokens and the length, none with half of the lines."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(7))
    forms = ["the page was printed by our old press in town for {} only", "the page was closed after many years of hard work on {} alone", "the page was written during cold and long winter nights with {} again"]
    rows = [f"{prose(300 + k, 60)}\n{forms[k % 3].format(word())}" for k in range(45)]
    rows += [f"{prose(400 + k, 60)}\nthe page was {' '.join(word() for _ in range(9))}" for k in range(20)]
    docs = make_docs(spark, rows)
    got = {x.row.doc_id: (x.row.text, x.n_dropped) for x in line_templates.drop_recurring_lines(docs).collect()}
    assert len({len(f.split()) for f in forms}) == 1
    assert all(got[k] == (rows[k].split("\n")[0], 1) for k in range(45))
    assert all(got[k] == (rows[k], 0) for k in range(45, 65))


def test_sketches_are_those_of_each_text_and_take_little_more_than_its_words():
    r = random.Random(11)
    some = [None, "", " \n", "a", "A b", "a b c d", "a b c d e", "b c d e a b c d e", *(prose(k, r.choice([3, 9, 60, 700])) for k in range(60))]
    for texts in ([], [None], ["", " "], ["x"] * 1500 + some, some):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
        (found,), (sets,) = near_duplicates._sketch(iter([batch])), near_duplicates._shingles(iter([batch]))
        for text, n, key, bands, held in zip(texts, *(found.column(k).to_pylist() for k in ("n_shingles", "set_key", "bands")), sets.column("shingles").to_pylist(), strict=True):
            values = np.frombuffer(held, np.uint64)
            assert n == len(shingles(text)) == len(values) and (values[1:] > values[:-1]).all()
            assert key == (hashlib.blake2b(held, digest_size=16).digest() if n else None)
            if not n:
                assert bands is None
                continue
            least = {}
            for v in values.tolist():
                least.setdefault(v >> 56, v)
            rows = np.array([least[min(least, key=near_duplicates._ORDER[k].__getitem__) if k not in least else k] for k in range(near_duplicates.BANDS * near_duplicates.ROWS)], np.uint64)
            rows = rows.reshape(near_duplicates.BANDS, near_duplicates.ROWS)
            assert bands == near_duplicates.mix(np.sum(rows * near_duplicates._WEIGHTS, axis=1, dtype=np.uint64)).view(np.int64).tolist()
    many = [prose(k, 250) for k in range(20)] * 100
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(many)), pa.int64()), pa.array(many, pa.string())], names=["doc_id", "text"])

    def seconds(work):
        took = []
        for _ in range(3):
            start = time.process_time()
            work()
            took.append(time.process_time() - start)
        return min(took)

    words = seconds(lambda: list(near_duplicates.groups(batch.column("text"))))
    assert seconds(lambda: list(near_duplicates._sketch(iter([batch])))) < 5 * words
