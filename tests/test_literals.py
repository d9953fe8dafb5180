"""Words that patterns require: never more than what every match has."""

import random
import re

import pytest

from gridwarden.functions import code_values, flow_values, rule_values, values, verify_values
from gridwarden.functions.dialect import SPARK
from gridwarden.functions.literals import required
from gridwarden.sources import fixtures as T


@pytest.mark.parametrize(
    ("pattern", "flags", "want"),
    [
        ("abc", "", (("abc",), False)), ("aBc", "i", (("abc",), True)), ("(?i)aBc", "", (("abc",), True)), ("(?is)aBc.x", "", (("abc",), True)), ("a.bcd", "", (("bcd",), False)), ("ab|cd", "", (("ab", "cd"), False)), ("ab|.", "", None), ("(?:ab)?cde", "", (("cde",), False)),
        ("(?:ab)+", "", (("ab",), False)), ("(?:ab)*", "", None), (r"x\s+=\s*yy", "", (("yy",), False)), ("[ab]c", "", None), (r"eval\s*\(|Function\z", "", (("Function", "eval"), False)), ("(a|b)(query|run)", "", (("query", "run"), False)), ("abcd|bc", "", (("bc",), False)),
        ("é+t", "", None), ("(?!abc)x", "", None), (r"\d{3}", "", None), ("|".join(f"w{i}x" for i in range(9)), "", None), ("((", "", None), (r"\p{L}abc", "", None), ("a\nb", "", (("a\nb",), False)),
    ],
)
def test_examples(pattern, flags, want):
    assert required(pattern, flags) == want


def patterns():
    """All strings of the value tables that are patterns, plain and without regard to case."""
    seen = []

    def walk(x):
        if isinstance(x, str):
            seen.append(x)
        elif isinstance(x, dict):
            walk([*x.keys(), *x.values()])
        elif isinstance(x, (list, tuple, set)):
            for y in x:
                walk(y)

    for module in (code_values, flow_values, rule_values, values, verify_values):
        walk([v for k, v in vars(module).items() if k[0] != "_"])
    return sorted(set(seen))


def test_every_match_has_a_required_word():
    rng = random.Random(8)
    texts = [c for row in T.CODE for c in (row[-1], *row[-1].split("\n"))] + [x for row in T.FINDINGS for x in row if x] + [r[2] for r in T.REPO_FILES]
    texts += [p.replace("\\", "") for p in patterns()] + [re.sub(r"\\[swbd][*+?]?|[()?:|\[\]^$*+\\]", lambda m: rng.choice(["", " ", "a", "("]), p) for p in patterns() for _ in range(3)]
    texts += [t.upper() for t in texts] + [t.replace("s", "ſ").replace("k", "\u212a") for t in texts]
    texts = rng.sample(sorted(set(texts)), 700)
    told = found = 0
    for p in patterns():
        for flags in ("", "i"):
            known = required(p, flags)
            if not known:
                continue
            told += 1
            # as Java looks at case: ASCII letters alone
            rx = re.compile(p.replace(r"\z", r"\Z"), re.I | re.A if flags else re.A)
            words, lower = known
            for t in texts:
                if not any(w in (t.lower() if lower else t) for w in words):
                    assert not rx.search(t), (p, flags, t)
                else:
                    found += 1
    assert told > 500 and found > 10_000


def test_where_it_is_put(spark):
    assert SPARK.match("raw", "abc") == "((contains(raw, 'abc')) AND raw RLIKE 'abc')"
    assert SPARK.match("t.raw", "ABC", "i").startswith("((contains(lower(t.raw), 'abc')) AND ")
    assert SPARK.match("concat(a, b)", "abc") == "concat(a, b) RLIKE 'abc'"
    rows = spark.sql(f"SELECT x, {SPARK.match('x', 'ab|cd', 'i')} AS hit, NOT {SPARK.match('x', 'ab')} AS miss FROM VALUES ('xABx'), ('cd'), ('e'), (NULL) t(x)").collect()
    assert [tuple(r) for r in rows] == [("xABx", True, True), ("cd", True, True), ("e", False, True), (None, None, None)]
