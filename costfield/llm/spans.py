"""Spans of a text: (kind, start, end) in code points, the end exclusive."""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import sha256

Span = tuple[str, int, int]


def joined(spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then by the order of ``kinds``, then by end; comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2])))


def digest(spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    return sha256(joined(spans, kinds).encode()).hexdigest()
