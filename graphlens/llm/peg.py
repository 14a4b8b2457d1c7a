"""Parsing expression grammars with memoised (packrat) rules over a text, keeping source offsets.

An expression is a function (text, position, memo) -> (end, values) or None. Values are what semantic actions emit.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

Result = tuple[int, tuple] | None
Expr = Callable[[str, int, dict], Result]


def token(pattern: str, flags: int = 0) -> Expr:
    """A terminal."""
    match = re.compile(pattern, flags).match

    def run(text: str, at: int, memo: dict) -> Result:
        m = match(text, at)
        return (m.end(), ()) if m else None

    return run


def emit(kind: str, pattern: str, flags: int = 0) -> Expr:
    """A terminal whose first group (or the whole match) becomes the value (kind, begin, end, text)."""
    match = re.compile(pattern, flags).match

    def run(text: str, at: int, memo: dict) -> Result:
        m = match(text, at)
        if not m:
            return None
        g = 1 if m.re.groups else 0
        return m.end(), ((kind, m.start(g), m.end(g), m.group(g)),)

    return run


def seq(*parts: Expr) -> Expr:
    def run(text: str, at: int, memo: dict) -> Result:
        out: tuple = ()
        for p in parts:
            r = p(text, at, memo)
            if r is None:
                return None
            at = r[0]
            if r[1]:
                out += r[1]
        return at, out

    return run


def choice(*parts: Expr) -> Expr:
    def run(text: str, at: int, memo: dict) -> Result:
        for p in parts:
            r = p(text, at, memo)
            if r is not None:
                return r
        return None

    return run


def many(part: Expr) -> Expr:
    """Zero or more, greedy; stops at a match that consumes nothing."""

    def run(text: str, at: int, memo: dict) -> Result:
        out: list = []
        while (r := part(text, at, memo)) is not None and r[0] > at:
            at = r[0]
            out += r[1]
        return at, tuple(out)

    return run


def maybe(part: Expr) -> Expr:
    return lambda text, at, memo: part(text, at, memo) or (at, ())


def absent(part: Expr) -> Expr:
    """Succeeds, consuming nothing, where `part` does not match."""
    return lambda text, at, memo: None if part(text, at, memo) else (at, ())


def rule(name: str, part: Expr) -> Expr:
    """A named rule; its result at a position is computed once per text."""

    def run(text: str, at: int, memo: dict) -> Result:
        key = name, at
        if key not in memo:
            memo[key] = part(text, at, memo)
        return memo[key]

    return run


def parse(grammar: Expr, text: str) -> tuple[Any, ...] | None:
    """The values of a parse of the whole text, or None."""
    r = grammar(text, 0, {})
    return r[1] if r is not None and r[0] == len(text) else None
