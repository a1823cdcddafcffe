"""Tokens of the command language."""

from __future__ import annotations

import re
from typing import NamedTuple

KEYWORDS = frozenset("TABLE NEW UPDATE QUERY DELETE PRIMARY KEY CHAINS COUNT RANGE IN HELP BULK COMPACT STATS".split())
_TOKEN = re.compile(r"[ \t\n\r\v\f]+|(?P<mark>[(),])|'(?P<string>[^']*)'|(?P<number>[0-9]+)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)")


class CommandError(Exception):
    """What a command is refused for; its text is the reply."""


class Token(NamedTuple):
    kind: str  # mark, string, number, ident, keyword, end
    value: str


def lex(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise CommandError("unterminated string literal" if text[at] == "'" else f"unexpected character: {text[at]}")
        at = m.end()
        if m["mark"]:
            out.append(Token("mark", m["mark"]))
        elif m["string"] is not None:
            out.append(Token("string", m["string"]))
        elif m["number"]:
            out.append(Token("number", m["number"]))
        elif m["word"]:
            keyword = m["word"].upper() in KEYWORDS
            out.append(Token("keyword" if keyword else "ident", m["word"].upper() if keyword else m["word"]))
    return [*out, Token("end", "")]
