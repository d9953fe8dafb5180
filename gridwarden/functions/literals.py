"""Literals that a text must have for a pattern to be found in it.

A pattern of the rule tables costs a microsecond or more on a text, and most texts have none of the words that it is about. Looking for a plain word is some twenty times cheaper.
So a text is tried only against patterns whose words it has. What is required is read off the parsed pattern: of a sequence the most telling part, of alternatives one word each.
Where nothing is required, or a pattern is not understood, there is no test before it.
"""

from __future__ import annotations

import re
from functools import lru_cache

try:
    from re import _constants as sre
    from re import _parser
except ImportError:  # another Python keeps its parser elsewhere: no tests before patterns then
    sre = _parser = None

#: Words of so many letters at least tell something; more alternatives than this cost more than they save.
LEAST, MOST = 2, 8


@lru_cache(maxsize=4096)
def required(pattern: str, flags: str = "") -> tuple[tuple[str, ...], bool] | None:
    """Words of which a text must have at least one, and whether case does not count, when they are in lower case; None if nothing is known. Only ASCII words, which lower() treats alike everywhere."""
    if _parser is None:
        return None
    try:
        tree = _parser.parse(pattern.replace(r"\z", r"\Z"), sum({"i": re.I, "s": re.S, "m": re.M}[f] for f in flags))
    except (re.error, KeyError, OverflowError, RecursionError):
        return None
    words = _of(tree)
    if words is None:
        return None
    lower = bool(tree.state.flags & re.I)
    if lower:
        words = {w.lower() for w in words}
    words = {w for w in words if not any(o != w and o in w for o in words)}  # one within another says as much
    if len(words) > MOST or not all(w.isascii() and len(w) >= LEAST for w in words):
        return None
    return tuple(sorted(words)), lower


def _telling(words: set[str] | None) -> tuple[int, int]:
    """How much a set of alternatives tells: the shortest one first, then how few they are."""
    return (0, 0) if not words else (min(map(len, words)), -len(words))


def _of(tree) -> set[str] | None:
    """The most telling set of words that one part of a sequence requires."""
    best, run = None, ""
    for op, value in [*tree, (None, None)]:
        if op is sre.LITERAL:
            run += chr(value)
            continue
        found = [{run}] if run else []
        run = ""
        if op is sre.SUBPATTERN:
            add, drop = value[1], value[2]
            found.append(None if add or drop else _of(value[3]))  # flags of a part are left alone
        elif op is sre.BRANCH:
            each = [_of(x) for x in value[1]]
            found.append(None if any(x is None for x in each) else set().union(*each))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] > 0:
            found.append(_of(value[2]))
        elif op is sre.ATOMIC_GROUP:
            found.append(_of(value))
        for words in found:
            if words and _telling(words) > _telling(best):
                best = words
    return best
