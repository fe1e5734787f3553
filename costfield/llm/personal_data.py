"""Personal data in whole texts, disguised or not, with spans in the source.

The base rules find e-mail addresses, IP addresses, card and telephone numbers as written. A text with signs of a
disguise also goes through a chain of transducers, each of which rewrites some characters and keeps, for each character
that it writes, the source characters that it stands for: (1) homoglyphs, full-width forms, other scripts' digits
and invisible characters; (2) digits spelled in words; (3) "at" and "dot" in words or brackets. The same rules run on what
comes out, and what they find there is mapped back to source spans and added, unless a span of its kind contains it wholly: a base
span that is a fragment of a disguised one stays beside it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costfield.llm.spans import Span, digest, joined
from costfield.llm.top_level_domains import TOP_LEVEL_DOMAINS

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[Span]:
    """As the pattern finds them from left to right, in linear time: by the @, and the run of characters before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            free = domain.end()
            yield "email", start, free
        at = text.find("@", max(at + 1, free))


def _addresses(text: str) -> Iterator[Span]:
    for run in _DOTTED.finditer(text):
        parts, start = run[0].split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield "ip", start, end
            start = end + 1


def _passes_luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def _cards(text: str) -> Iterator[Span]:
    for run in _DIGITS.finditer(text):
        digits = run[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _passes_luhn(digits):
            yield "card", *run.span()


def _phones(text: str) -> Iterator[Span]:
    for run in _PHONE.finditer(text):
        if 10 <= sum(c in "0123456789" for c in run[0]) <= 15:
            yield "phone", *run.span()


def base_spans(text: str) -> list[Span]:
    return [*_emails(text), *_addresses(text), *_cards(text), *_phones(text)]


# Letters of other scripts that look like Latin ones, in their order there.
_LOOKALIKES = dict(zip("АВЕЅІЈКМНОРСТХУаеѕіјорсхуԁԛԝҺһӏ", "ABESIJKMHOPCTXYaesijopcxydqwhhl", strict=True))
_LOOKALIKES |= dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρυχα", "ABEZHIKMNOPTYXovpuxa", strict=True))
# Signs that stand for at, dot, hyphen and plus.
_SIGNS = {"。": ".", "․": ".", "‧": ".", "∙": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "\xa0": " ", " ": " ", " ": " "}
_INVISIBLE = "\xad͏؜᠎​‌‍‎‏⁠⁡⁢⁣⁤︎️﻿"
# The digits in English, French, Spanish and German.
_SPELLED = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
}
_WORD = "|".join(sorted(_SPELLED, key=len, reverse=True))
_GAP = r"[\x20.,-]{1,3}"
_SPELLED_RUN = re.compile(rf"(?<!\w)(?:(?:plus|más|mas){_GAP}|\+\x20?)?(?:(?:{_WORD}|oh|[0-9]+){_GAP}){{2,}}(?:{_WORD}|oh|[0-9]+)(?!\w)", re.I)
_ONE = re.compile(rf"(?P<plus>plus|más|mas|\+)|(?P<word>{_WORD}|oh)|(?P<digits>[0-9]+)|(?P<gap>[\x20.,-]+)", re.I)
_TWO_SPELLED = re.compile(rf"\b(?:{_WORD}){_GAP}(?:{_WORD})\b")
#: Substrings of lower-cased text without one of which the later transducers have nothing to do.
_HINTS_OF_DOT = ("dot", "punto", "point", "punkt", "[.]", "(.)", "{.}")
_HINTS_OF_AT = tuple(f"{b}{gap}{at}" for b in "[({<" for gap in ("", " ") for at in ("at", "arroba", "arobase"))
_HINTS_OF_DIGITS = tuple(w for w in _SPELLED if len(w) > 2)
_AT, _DOT = r"(?:at|arroba|arobase)", r"(?:dot|punto|point|punkt)"
_IN_BRACKETS = r"[\[({{<]\x20?{}\x20?[\])}}>]"
_AT_SIGN = rf"(?:\x20?{_IN_BRACKETS.format(_AT)}\x20?|[_\x20-]{{1,2}}{_AT}[_\x20-]{{1,2}}|\x20?@\x20?)"
_DOT_SIGN = rf"(?:\x20?{_IN_BRACKETS.format(_DOT)}\x20?|[_\x20-]{{1,2}}{_DOT}[_\x20-]{{1,2}}|\x20?{_IN_BRACKETS.format(r'[.]')}\x20?|\.)"
_AT_SIGNS, _DOT_SIGNS = re.compile(_AT_SIGN, re.I), re.compile(_DOT_SIGN, re.I)
# A hyphen before a dot word belongs to the sign, so that a part can be read in one way only.
_PART = re.compile(rf"[A-Za-z0-9]+(?:-+(?!{_DOT}[_\x20-])[A-Za-z0-9]+)*", re.I)
_SPACED_OUT = re.compile(rf"(?P<at>{_AT_SIGN})|(?P<dot>{_DOT_SIGN})", re.I)
_END = re.compile(r"[.\])}>_\x20-](xn--[a-z0-9-]+|[a-z0-9]+)$", re.I)
# Top-level domains of documentation, which are not registered.
_TOP = TOP_LEVEL_DOMAINS | {"example", "test", "invalid"}
# Endings that a host has even after a determiner ("at the dot com").
_USUAL = frozenset("com net org edu gov info io co biz dev app ai example test invalid de fr es uk us eu ch at it nl be pt mx ar ca au in jp cn br ru".split())
_DETERMINERS = frozenset("the a an this that each every any one some no its his her their our your my der die das den dem ein eine le la les un une el los las".split())
# Words that an address follows, and what may stand between; and words that are no mailbox.
_MAIL_BEFORE = re.compile(r"(?:\b(?:e-?mails?|mails?|mailto|courriel|correo|adresse|address|contact|reach|write|schreib\w*|escrib\w*|[ée]criv\w*)\b)(?:\x20(?:address|adresse|me|us|is|to|an|à|a|ist|est|es|him|her|them)|[\x20:=(<\"'])*$", re.I)
_NO_MAILBOX = re.compile(r"(?:me|us|him|her|them|it|you|is|was|are|be|and|or|to|from|in|on|address|mail|e-?mail)$", re.I)
_ADDRESS = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:{_DOT_SIGN}[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_AT_IN_BRACKETS = re.compile(_IN_BRACKETS.format(_AT), re.I)
_BARE_AT = re.compile(rf"[_\x20-]{{1,2}}{_AT}[_\x20-]{{1,2}}", re.I)
_PLAIN_HOST = re.compile(rf"[_\x20-]{_AT}[_\x20-]{{1,2}}[a-z0-9]+(?:-+(?!{_AT}[_\x20-])[a-z0-9]+)*\.[a-z]")
_OWN_NAME = re.compile(r"[A-Za-z][._][A-Za-z]|[A-Za-z][0-9]+$")
_DOT_IN_DISGUISE = re.compile(rf"{_IN_BRACKETS.format(_DOT)}|[_\x20-]{_DOT}[_\x20-]|{_IN_BRACKETS.format(r'[.]')}", re.I)
#: Characters that the first transducer may rewrite.
_FOREIGN = re.compile(r"[\xa0\xad͏Ͱ-ӿԀ-ԯ؜٠-٩۰-۹०-९᠎ -⁯−∙。﹒﹫︎️﻿！-～\U0001d400-\U0001d7ff]")


class Traced:
    """A text and, for each of its characters, the source characters [start, end) that it stands for."""

    def __init__(self, text: str, start: Sequence[int] | None = None, end: Sequence[int] | None = None):
        self.text = text
        self.start = range(len(text)) if start is None else start
        self.end = range(1, len(text) + 1) if end is None else end

    def rewrite(self, pattern: re.Pattern, by: Callable[[re.Match], str]) -> Traced:
        """Each match becomes ``by(match)``, every character of which stands for the whole match."""
        text, start, end, done = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = by(m)
            if new == m[0]:
                continue
            a, b = m.span()
            text += [self.text[done:a], new]
            start += [*self.start[done:a], *[self.start[a]] * len(new)]
            end += [*self.end[done:a], *[self.end[b - 1]] * len(new)]
            done = b
        return Traced("".join([*text, self.text[done:]]), [*start, *self.start[done:]], [*end, *self.end[done:]]) if done else self

    def within(self, spans: Iterable[tuple[int, int]], inner: re.Pattern, by: Callable[[str, int, int, re.Match], str]) -> Traced:
        """Inside each of ``spans``, each match of ``inner`` becomes ``by(text, start, end, match)``."""
        places = {x.span(): by(self.text, a, b, x) for a, b in spans for x in inner.finditer(self.text, a, b)}
        return self.rewrite(inner, lambda x: places.get(x.span(), x[0])) if places else self

    def source(self, span: Span) -> Span:
        kind, a, b = span
        return kind, self.start[a], self.end[b - 1]


def _plain_character(m: re.Match) -> str:
    c = m[0]
    if c in _INVISIBLE:
        return ""
    if c in _SIGNS or c in _LOOKALIKES:
        return _SIGNS.get(c) or _LOOKALIKES[c]
    digit = unicodedata.decimal(c, None)
    folded = str(digit) if digit is not None else unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded.isascii() else c


def _plain_digit(text: str, a: int, b: int, one: re.Match) -> str:
    if not _TWO_SPELLED.search(text, a, b):
        return one[0]
    if one["word"]:
        return str(_SPELLED.get(one["word"].lower(), 0))
    return "+" if one["plus"] else one["digits"] or ""


def _addresses_in_disguise(text: str) -> Iterator[tuple[int, int]]:
    """Where text reads as mailbox, at sign, host: from each at sign to the left and to the right, as far as the ones beside it.

    Every character is read once in each direction, however long the names are.
    """
    signs = [m.span() for m in _AT_SIGNS.finditer(text)]
    dots = {m.end(): m.start() for m in _DOT_SIGNS.finditer(text) if m[0] != "."} if signs else {}
    for k, (left, right) in enumerate(signs):
        floor, ceiling = signs[k - 1][1] if k else 0, signs[k + 1][0] if k + 1 < len(signs) else len(text)
        start = at = left
        while True:
            while at > floor and text[at - 1] in _LOCAL:
                at -= 1
            if at == start:
                break
            start = at
            if at not in dots or dots[at] <= floor or text[dots[at] - 1] not in _LOCAL:
                break
            at = dots[at]
        while start < left and text[start] in "._-":
            start += 1
        end, part = 0, _PART.match(text, right, ceiling) if start < left else None
        while part and (dot := _DOT_SIGNS.match(text, part.end(), ceiling)) and (part := _PART.match(text, dot.end(), ceiling)):
            end = part.end()
        if end:
            yield start, end


def _ends_as_host(address: str) -> bool:
    end = _END.search(address)
    if not end or end[1].lower() not in _TOP:
        return False
    words = re.split(r"[\x20_-]+", address)
    return end[1].lower() in _USUAL or len(words) < 3 or re.split("[@.]", words[-3])[-1].lower() not in _DETERMINERS


def _is_named_mailbox(text: str, a: int, b: int) -> bool:
    """A bare "at" with plain dots is an address where the words before it, or the mailbox's own dot or digit, say so."""
    at = _BARE_AT.search(text, a, b)
    if not at or _NO_MAILBOX.match(text[a : at.start()]):
        return False
    return bool(_OWN_NAME.search(text[a : at.start()]) or _MAIL_BEFORE.search(text[max(0, a - 60) : a]))


def _plain_address(text: str, a: int, b: int, sign: re.Match) -> str:
    """Bare words and spaces at an @ are rewritten only where the at sign, a dot or the context is plain to see and a top-level domain ends them."""
    address = text[a:b]
    shown = "@" in address or _DOT_IN_DISGUISE.search(address)
    if not (_AT_IN_BRACKETS.search(address) or _ends_as_host(address) and (shown or _is_named_mailbox(text, a, b))):
        return sign[0]
    return "@" if sign["at"] else "."


def disguised_spans(text: str) -> list[Span]:
    """What the rules find after the transducers, as source spans; also spelled runs of 10 to 15 digits, as telephone numbers."""
    now, found = Traced(text), []
    if not text.isascii() and _FOREIGN.search(text):
        now = now.rewrite(_FOREIGN, _plain_character)
    low = now.text.lower()
    if any(w in low for w in _HINTS_OF_DIGITS) and _TWO_SPELLED.search(low):
        for run in _SPELLED_RUN.finditer(now.text):
            digits = "".join(_plain_digit(now.text, *run.span(), x) for x in _ONE.finditer(run[0])).lstrip("+")
            spelled = sum(bool(x["word"]) for x in _ONE.finditer(run[0]))
            if 10 <= len(digits) <= 15 and digits.isdigit() and spelled >= 7 and not (len(digits) >= 14 and _passes_luhn(digits)):
                found.append(now.source(("phone", *run.span())))
        now = now.within([m.span() for m in _SPELLED_RUN.finditer(now.text)], _ONE, _plain_digit)
    if any(x in low for x in _HINTS_OF_AT) or " @" in low or "@ " in low or _PLAIN_HOST.search(low) or any(x in low for x in _HINTS_OF_DOT) and _DOT_IN_DISGUISE.search(now.text):
        now = now.within([m.span() for m in _ADDRESS.finditer(now.text)], _SPACED_OUT, lambda text, a, b, sign: sign[0] if sign["at"] else ".")
        now = now.within(_addresses_in_disguise(now.text), _SPACED_OUT, _plain_address)
    if now.text == text:
        return found
    return [*found, *(now.source(s) for s in base_spans(now.text))]


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans, and those that the transducers add."""
    base, added, ends = base_spans(text), [], {}
    # By start, longer ones first: a span is within an earlier one of its kind if that reaches as far.
    for start, back, new, kind in sorted([(a, -b, False, k) for k, a, b in base] + [(a, -b, True, k) for k, a, b in set(disguised_spans(text))]):
        if new and ends.get(kind, -1) < -back:
            added.append((kind, start, -back))
        ends[kind] = max(ends.get(kind, -1), -back)
    return base, added


def personal_data(docs: DataFrame) -> DataFrame:
    """Personal data in every row's text (doc_id, text, ...).

    Returns doc_id; n_email, n_ip, n_card and n_phone, the base rules' counts; base_sha256 of their spans; spans, with the ones that
    the transducers add; n_disguised, how many those are; n_spans, how many there are of all kinds.

    Defined cases: a null or empty text has no spans; repeated rows are searched each; a null doc_id stays null; an empty
    table gives no rows. Other columns of ``docs`` are ignored.
    """

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                base, added = all_spans(text.as_py() or "")
                counts = [sum(s[0] == kind for s in base) for kind in KINDS]
                rows.append((*counts, digest(base, KINDS), joined([*base, *added], KINDS), len(added), len(base) + len(added)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised", "n_spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long, n_spans long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(searched, schema)
