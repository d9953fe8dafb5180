"""SQL expressions in the words of one engine.

Operators are written once as relational SQL over named inputs. The SPARK dialect runs them on DataFrames through Catalyst; the
DUCK dialect is the same plan for the engine that results are checked with.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from .literals import required

WORD, WORD_PAIR = r"\w+", r"\w+\.\w+"


class Dialect:
    name = ""

    def table(self, name: str) -> str:
        """An input relation."""
        raise NotImplementedError

    def text(self, value: str) -> str:
        """A string literal."""
        raise NotImplementedError

    def num(self, value: float) -> str:
        """A double literal."""
        return f"CAST({value!r} AS DOUBLE)"

    def match(self, x: str, pattern: str, flags: str = "") -> str:
        """True if the pattern is found; flags i, s and m as in most regex dialects."""
        raise NotImplementedError

    # forms of several engines, from the ones above

    def any(self, x: str, patterns: Iterable[tuple[str, str] | str]) -> str:
        """True if one of the patterns is found; each a string, or (string, flags)."""
        return "(" + " OR ".join(self.match(x, *((p,) if isinstance(p, str) else p)) for p in patterns) + ")"

    def count_of(self, conditions: Iterable[str]) -> str:
        return "(" + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in conditions) + ")"

    def first(self, x: str, rows: Iterable[tuple], default: str | None, flags: str = "i") -> str:
        """The label of the first pattern that is found: rows of (pattern, label[, flags])."""
        cases = " ".join(f"WHEN {self.match(x, r[0], r[2] if len(r) > 2 else flags)} THEN {self.text(r[1])}" for r in rows)
        return f"CASE {cases} ELSE {'NULL' if default is None else self.text(default)} END"

    def labels(self, pairs: Iterable[tuple[str, str]], sep: str = ",") -> str:
        """Labels of the conditions that hold, in order, joined: pairs of (condition, label)."""
        return self.join([f"CASE WHEN {c} THEN {self.text(label)} END" for c, label in pairs], sep)

    def lookup(self, x: str, values: dict, default=None) -> str:
        """A value by key."""
        say = lambda v: "NULL" if v is None else self.text(v) if isinstance(v, str) else self.num(v) if isinstance(v, float) else str(v)
        return f"CASE {x} " + " ".join(f"WHEN {self.text(k)} THEN {say(v)}" for k, v in values.items()) + f" ELSE {say(default)} END"

    def product(self, factors: Iterable[tuple[str, float]]) -> str:
        """The factors whose conditions hold, multiplied from left to right."""
        return "(" + " * ".join([self.num(1.0), *(f"CASE WHEN {c} THEN {self.num(f)} ELSE {self.num(1.0)} END" for c, f in factors)]) + ")"

    def any_word(self, x: str) -> str:
        """Words of x and pairs of words with a dot between, as an array."""
        return f"flatten({self.array([self.extract_all(x, WORD_PAIR), self.extract_all(x, WORD)])})"

    def strip(self, x: str) -> str:
        """Without white space of any kind at both ends."""
        return self.replace(x, r"^\s+|\s+\z", "")

    def half_up(self, x: str) -> str:
        """Rounded to a whole number, halves upwards."""
        return f"CAST(FLOOR({x} + {self.num(0.5)}) AS BIGINT)"

    def values(self, names: Sequence[str], rows: Iterable[Sequence]) -> str:
        """A small relation of literals."""
        body = ", ".join("(" + ", ".join(self._literal(v) for v in r) + ")" for r in rows)
        return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(names)}))"

    def _literal(self, v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, float):
            return self.num(v)
        return self.text(v) if isinstance(v, str) else str(v)


class Spark(Dialect):
    name = "spark"

    def table(self, name):
        return f"\x01{name}\x02"

    def text(self, value):
        body = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
        return "'" + body.replace("${", "\\u0024{") + "'"  # else Spark takes it for a variable

    def match(self, x, pattern, flags=""):
        found = f"{x} RLIKE {self.text(self.pattern(pattern, flags))}"
        # a column is looked through for the words that the pattern requires; an expression would be made once more for it
        known = required(pattern, flags) if re.match(r"[A-Za-z_][\w.]*\Z", x) else None
        if not known:
            return found
        words, lower = known
        text = f"lower({x})" if lower else x
        return f"(({' OR '.join(f'contains({text}, {self.text(w)})' for w in words)}) AND {found})"

    def pattern(self, pattern, flags=""):
        return (f"(?{flags})" if flags else "") + pattern

    def extract(self, x, pattern, group=0, flags=""):
        """A group of the first match; empty if there is none."""
        return f"regexp_extract({x}, {self.text(self.pattern(pattern, flags))}, {group})"

    def extract_all(self, x, pattern, group=0, flags=""):
        return f"regexp_extract_all({x}, {self.text(self.pattern(pattern, flags))}, {group})"

    def replace(self, x, pattern, new, flags=""):
        return f"regexp_replace({x}, {self.text(self.pattern(pattern, flags))}, {self.text(new)})"

    def lines(self, x):
        return f"split({x}, '\\n', -1)"

    def window(self, code, low, high):
        """Lines low to high, counted from 1, both included, as one text; parts outside are left out."""
        start = f"CAST(GREATEST(1, {low}) AS INT)"
        return f"array_join(slice({self.lines(code)}, {start}, GREATEST(0, CAST({high} AS INT) - {start} + 1)), '\\n')"

    def join(self, parts, sep=","):
        return f"concat_ws({self.text(sep)}, {', '.join(parts)})"

    def size(self, x):
        return f"size({x})"

    def array(self, items):
        return f"array({', '.join(items)})" if items else "CAST(array() AS ARRAY<STRING>)"

    def each(self, x, item, body):
        """The array with the body in place of each item."""
        return f"transform({x}, {item} -> {body})"

    def matches(self, x, y):
        """True if the pattern that y holds is found."""
        return f"{x} RLIKE {y}"

    def compiles(self, y):
        """True if y holds a pattern that can be used."""
        return f"(try_reflect('java.util.regex.Pattern', 'compile', {y}) IS NOT NULL)"

    def first_joined(self, x, n, sep):
        """The first n strings of an array, joined."""
        return f"array_join(slice({x}, 1, {n}), {self.text(sep)})"

    def fnv(self, x):
        """Eight hexadecimal digits: characters folded into 32 bits, each product rounded as a double."""
        xored = "(h ^ CAST(ascii(c) AS BIGINT))"
        step = f"pmod(CAST(CAST(CASE WHEN {xored} >= 2147483648 THEN {xored} - 4294967296 ELSE {xored} END AS DOUBLE) * 16777619D AS BIGINT), 4294967296)"
        return f"lower(lpad(hex(aggregate(filter(split({x}, ''), c -> c <> ''), 2166136261L, (h, c) -> {step})), 8, '0'))"

    def has(self, x, y):
        return f"array_contains({x}, {y})"

    def contains(self, x, y):
        return f"contains({x}, {y})"

    def explode(self, source, array, item, pos, keep="*"):
        """Each element with its number from 1."""
        return f"(SELECT {keep}, {pos}0 + 1 AS {pos}, {item} FROM {source} LATERAL VIEW posexplode({array}) AS {pos}0, {item})"

    def collect(self, x, order, sep=","):
        """Strings of a group, joined in order."""
        keys = [order] if isinstance(order, str) else list(order)
        named = ", ".join(f"{k} AS k{i}" for i, k in enumerate(keys))
        return f"array_join(transform(array_sort(collect_list(CASE WHEN {x} IS NOT NULL THEN struct({named}, {x} AS x) END)), e -> e.x), {self.text(sep)})"

    def sha256(self, x):
        return f"sha2({x}, 256)"

    def json(self, x, key):
        """A text field of a JSON object; null unless the whole is valid."""
        return f"get_json_object({x}, '$.{key}')"

    def seconds(self, ts):
        return f"CAST(unix_timestamp({ts}) AS BIGINT)"

    def find(self, x, y):
        """Place of y in x, from 1; 0 if absent."""
        return f"instr({x}, {y})"

    def left(self, x, n):
        return f"substr({x}, 1, {n})"

    def last_known(self, x, partition, order):
        """The last value up to the row that is not null."""
        return f"LAST({x}, TRUE) OVER (PARTITION BY {partition} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    def next_known(self, x, partition, order):
        """The first value after the row that is not null."""
        return f"FIRST({x}, TRUE) OVER (PARTITION BY {partition} ORDER BY {order} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"

    def near(self, x, partition, order, before, after):
        """Texts of the rows around, from so many before to so many after, one per line."""
        return f"array_join(collect_list({x}) OVER (PARTITION BY {partition} ORDER BY {order} ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING), '\\n')"


class Duck(Dialect):
    name = "duck"

    def table(self, name):
        return name

    def text(self, value):
        parts = ["'" + p.replace("'", "''") + "'" for p in value.split("\n")]
        return parts[0] if len(parts) == 1 else "(" + " || chr(10) || ".join(parts) + ")"

    def match(self, x, pattern, flags=""):
        return f"regexp_matches({x}, {self.text(self.pattern(pattern, flags))})"

    def pattern(self, pattern, flags=""):
        return (f"(?{flags})" if flags else "") + pattern

    def extract(self, x, pattern, group=0, flags=""):
        return f"regexp_extract({x}, {self.text(self.pattern(pattern, flags))}, {group})"

    def extract_all(self, x, pattern, group=0, flags=""):
        return f"regexp_extract_all({x}, {self.text(self.pattern(pattern, flags))}, {group})"

    def replace(self, x, pattern, new, flags=""):
        return f"regexp_replace({x}, {self.text(self.pattern(pattern, flags))}, {self.text(new)}, 'g')"

    def lines(self, x):
        return f"string_split({x}, chr(10))"

    def window(self, code, low, high):
        return f"array_to_string(list_slice({self.lines(code)}, GREATEST(1, {low}), GREATEST(0, {high})), chr(10))"

    def join(self, parts, sep=","):
        return f"concat_ws({self.text(sep)}, {', '.join(parts)})"

    def size(self, x):
        return f"CAST(len({x}) AS INT)"

    def array(self, items):
        return f"[{', '.join(items)}]" if items else "CAST([] AS VARCHAR[])"

    def each(self, x, item, body):
        return f"list_transform({x}, lambda {item}: {body})"

    def matches(self, x, y):
        return f"regexp_matches({x}, {y})"

    def compiles(self, y):
        return f"(TRY(regexp_matches('', {y})) IS NOT NULL)"

    def first_joined(self, x, n, sep):
        return f"array_to_string(list_slice({x}, 1, {n}), {self.text(sep)})"

    def fnv(self, x):
        xored = "xor(h, c)"
        signed = f"(CASE WHEN {xored} >= 2147483648 THEN {xored} - 4294967296 ELSE {xored} END)"
        step = f"((CAST(CAST({signed} AS DOUBLE) * CAST(16777619 AS DOUBLE) AS BIGINT) % 4294967296 + 4294967296) % 4294967296)"
        codes = f"list_transform(list_filter(string_split({x}, ''), lambda c: c <> ''), lambda c: CAST(unicode(c) AS BIGINT))"
        return f"printf('%08x', list_reduce(list_prepend(CAST(2166136261 AS BIGINT), {codes}), lambda h, c: {step}))"

    def has(self, x, y):
        return f"list_contains({x}, {y})"

    def contains(self, x, y):
        return f"contains({x}, {y})"

    def explode(self, source, array, item, pos, keep="*"):
        return f"(SELECT {keep}, CAST(generate_subscripts({array}, 1) AS INT) AS {pos}, unnest({array}) AS {item} FROM {source})"

    def collect(self, x, order, sep=","):
        keys = [order] if isinstance(order, str) else list(order)
        return f"COALESCE(string_agg({x}, {self.text(sep)} ORDER BY {', '.join(keys)}), '')"

    def sha256(self, x):
        return f"sha256({x})"

    def json(self, x, key):
        return f"CASE WHEN json_valid({x}) THEN json_extract_string({x}, '$.{key}') END"

    def seconds(self, ts):
        return f"CAST(floor(epoch({ts})) AS BIGINT)"

    def find(self, x, y):
        return f"instr({x}, {y})"

    def left(self, x, n):
        return f"left({x}, {n})"

    def last_known(self, x, partition, order):
        return f"LAST_VALUE({x} IGNORE NULLS) OVER (PARTITION BY {partition} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    def next_known(self, x, partition, order):
        return f"FIRST_VALUE({x} IGNORE NULLS) OVER (PARTITION BY {partition} ORDER BY {order} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"

    def near(self, x, partition, order, before, after):
        return f"string_agg({x}, chr(10)) OVER (PARTITION BY {partition} ORDER BY {order} ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"


SPARK, DUCK = Spark(), Duck()


def not_starting(words: Sequence[str]) -> str:
    """A pattern for a place where none of the words starts: what a negative look-ahead says, for engines without one.

    It takes the shortest text that tells: a first letter that differs, or the end of the text.
    """
    def rest(options: list[str]) -> str:
        heads: dict[str, list[str]] = {}
        for o in options:
            heads.setdefault(o[0], []).append(o[1:])
        parts = ["[^" + "".join(heads) + "]", r"\z"]
        for h, tails in heads.items():
            if all(tails):
                parts.append(h + rest(tails))
        return "(?:" + "|".join(parts) + ")"

    return rest(list(words))
