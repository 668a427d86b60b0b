"""A small boolean language over a scored pool: ``top_pct(35) AND NOT source:maps``.

Precedence from low to high: OR, AND, NOT, then calls, names and parentheses.
Keywords are case-insensitive; names hold letters, digits, ``_`` and ``:``, or
anything but quotes between double quotes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class QueryError(ValueError):
    """The text is no expression of the language."""


@dataclass(frozen=True)
class Node:
    """``kind`` is or, and, not, call or name; ``name`` and ``args`` are for the last two."""

    kind: str
    children: tuple[Node, ...] = ()
    name: str = ""
    args: tuple[float | str, ...] = ()


TOKEN = re.compile(r"\s*(?:(?P<mark>[(),])|(?P<number>-?(?:\d+\.?\d*|\.\d+))(?![\w:])|\"(?P<quoted>[^\"]+)\"|(?P<word>[A-Za-z_][\w:]*))")


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m or m.end() == at:
            raise QueryError(f"unexpected {text[at:at + 10]!r} at {at}")
        kind = m.lastgroup or ""
        value = m[kind]
        if kind == "word" and value.upper() in ("AND", "OR", "NOT"):
            kind, value = "keyword", value.upper()
        out.append((kind, value))
        at = m.end()
    return out


def parse(text: str) -> Node:
    """The tree of an expression; raises QueryError."""
    tokens = tokenize(text)
    at = 0

    def ahead(*wanted: str) -> bool:
        return at < len(tokens) and tokens[at][0] != "quoted" and tokens[at][1] in wanted

    def chain(keyword: str, operand) -> Node:
        nonlocal at
        parts = [operand()]
        while ahead(keyword):
            at += 1
            parts.append(operand())
        return parts[0] if len(parts) == 1 else Node(keyword.lower(), tuple(parts))

    def negation() -> Node:
        nonlocal at
        if ahead("NOT"):
            at += 1
            return Node("not", (negation(),))
        return atom()

    def atom() -> Node:
        nonlocal at
        if at >= len(tokens):
            raise QueryError("the expression ends too early")
        kind, value = tokens[at]
        at += 1
        if kind == "mark" and value == "(":
            inner = disjunction()
            close()
            return inner
        if kind not in ("word", "quoted"):
            raise QueryError(f"unexpected {value!r}")
        if kind == "word" and ahead("("):
            at += 1
            args: list[float | str] = []
            while not ahead(")"):
                if at >= len(tokens) or tokens[at][0] in ("mark", "keyword"):
                    raise QueryError(f"bad arguments of {value}")
                args.append(float(tokens[at][1]) if tokens[at][0] == "number" else tokens[at][1])
                at += 1
                if ahead(","):
                    at += 1
                    if ahead(")"):
                        raise QueryError(f"bad arguments of {value}")
                elif not ahead(")"):
                    raise QueryError(f"bad arguments of {value}")
            at += 1
            return Node("call", name=value, args=tuple(args))
        return Node("name", name=value)

    def close() -> None:
        nonlocal at
        if not ahead(")"):
            raise QueryError("a parenthesis is not closed")
        at += 1

    def disjunction() -> Node:
        return chain("OR", lambda: chain("AND", negation))

    tree = disjunction()
    if at < len(tokens):
        raise QueryError(f"unexpected {tokens[at][1]!r} after the end")
    return tree
