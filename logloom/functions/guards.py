"""Texts that any match of a pattern must hold: a cheap test before an expensive one.

Reads the part of the pattern language that the rule tables use: literals, classes, groups, alternatives, quantifiers."""

from __future__ import annotations

import re

TOKEN = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?:|\(\?[^)]*|[()|.^$]|[*+?]\??|\{\d+(?:,\d*)?\}\??|.", re.S)


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """The one with longer texts, then the one with fewer."""
    fit = [x for x in (a, b) if x and min(map(len, x)) >= 2]
    return max(fit, key=lambda x: (min(map(len, x)), -len(x)), default=None)


def _alternatives(tokens: list[str], at: int) -> tuple[frozenset[str] | None, int]:
    """What the alternatives from tokens[at] on need, up to a closing bracket or the end, and where they end."""
    parts, best, run, last = [], None, "", None
    while at < len(tokens) and tokens[at] != ")":
        t = tokens[at]
        if t == "|":
            parts.append(_better(_better(best, last), frozenset([run])))
            best, run, last = None, "", None
        elif t[0] in "*?" or t.startswith("{0"):
            if last is None:
                run = run[:-1]  # the literal before may be absent
            best, run, last = _better(best, frozenset([run])), "", None
        elif t[0] in "+{":
            best, run = _better(_better(best, frozenset([run])), last), ""
            last = None
        else:
            best, last = _better(best, last), None
            if t == "(?:" or t == "(":
                best, run = _better(best, frozenset([run])), ""
                last, at = _alternatives(tokens, at + 1)
                last = last or frozenset()
            elif len(t) == 1 and t not in ".^$" or len(t) == 2 and not t[1].isalnum() and t[0] == "\\":
                run += t[-1]
            else:
                best, run, last = _better(best, frozenset([run])), "", frozenset()
        at += 1
    parts.append(_better(_better(best, last), frozenset([run])))
    return (frozenset().union(*parts) if all(parts) else None), at


def needed(pattern: str) -> list[str]:
    """Texts of which every match holds at least one; none where that can't be told (flags, look-around, classes only)."""
    tokens = TOKEN.findall(pattern)
    if any(t.startswith("(?") and t != "(?:" for t in tokens):
        return []
    return sorted(_alternatives(tokens, 0)[0] or ())
