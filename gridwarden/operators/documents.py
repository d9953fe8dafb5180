"""Operators that need a program within a document: a stack, an order in which each step depends on the last, or a rewriting of text.

Each is a narrow pass over a document's own data; documents are independent.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import code_values as K
from ..functions.run import apply
from . import suppress


def _string_udf(f):
    @F.pandas_udf(T.StringType())
    def over(x):
        import pandas as pd

        return pd.Series([None if v is None else f(v) for v in x], dtype=object)

    return over


# -- model answers -----------------------------------------------------------------------------------------------------


_DECODER = json.JSONDecoder()
_ENCODE = json.JSONEncoder(sort_keys=True).encode

#: A string that is not closed reaches to the end.
_BRACES_AND_STRINGS = re.compile(r'[{}]|"(?:[^"\\]++|\\.)*+(?:"|\\?\Z)', re.S)


def outermost_object(text: str) -> str | None:
    """The first {...} that closes, with braces in strings left out of the count."""
    depth, start = 0, -1
    for m in _BRACES_AND_STRINGS.finditer(text):
        c = m.group()
        if c == "{":
            start = m.start() if depth == 0 else start
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0 and start >= 0:
                return text[start : m.end()]
    return None


def _parsed(text: str | None):
    if not text or not text.lstrip(" \t\n\r").startswith("{"):  # which costs less than an exception
        return None
    try:
        value = json.loads(text)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _first_parsed(text: str):
    """_parsed(outermost_object(text)); read in one go where nothing before the first brace changes how braces are counted."""
    at = text.find("{")
    if at >= 0 and '"' not in text[:at] and "}" not in text[:at]:
        try:
            return _DECODER.raw_decode(text, at)[0]
        except ValueError:
            pass
    return _parsed(outermost_object(text))


def rescue(text: str) -> dict | None:
    """A cut-off answer: without its unfinished last field, or with its list of findings closed after the last whole one."""
    short = re.sub(r',?\s*"optimized_code"\s*:\s*"(?:[^"\\]|\\.)*\Z', "", text, flags=re.S).rstrip()
    if found := _parsed(short if short.endswith("}") else short + "}"):
        return found
    m = re.match(r'([\s\S]*?"issues"\s*:\s*\[)([\s\S]*)\Z', text)
    if m and "}" in m[2]:
        return _parsed(m[1] + m[2][: m[2].rindex("}") + 1] + '],"summary":"incomplete","score":0}')
    return None


def read_answer(text: str) -> str | None:
    """A model's answer as a JSON object in text: as it is, without fences, its first object, without stray commas, or rescued."""
    bare = re.sub(r"```(?:json)?\s*", "", text).strip()
    sliced = bare[bare.find("{") : bare.rfind("}") + 1] if "{" in bare else None
    # each is made only if those before it are no object
    found = _parsed(text.strip()) or _parsed(bare) or _first_parsed(text) or _first_parsed(bare) or (_parsed(re.sub(r",\s*([}\]])", r"\1", sliced)) if sliced else None) or rescue(bare)
    return _ENCODE(found) if found else None


def read_answers(answers: DataFrame, text_col: str = "text", out_col: str = "answer") -> DataFrame:
    """Adds the object, or null; and whether the answer is prose, which is what an injected prompt makes of it."""
    read = answers.withColumn(out_col, _string_udf(read_answer)(F.col(text_col)))
    return read.withColumn("is_prose", F.col(out_col).isNull() & (F.length(text_col) > 10) & ~F.col(text_col).contains("{"))


# -- order-dependent deduplication --------------------------------------------------------------------------------------


def banded(rows: list[tuple[str, int, int]], width: int = 3) -> set[int]:
    """seq of rows (title, line, seq) that an earlier kept row of the title stands for, at most `width` lines away. Kept rows alone stand for others."""
    kept: dict[str, dict[int, list[int]]] = {}
    gone = set()
    for title, line, seq in sorted(rows, key=lambda r: r[2]):
        cells = kept.setdefault(title, {})
        cell = line // (width + 1)
        if any(abs(k - line) <= width for c in (cell - 1, cell, cell + 1) for k in cells.get(c, ())):
            gone.add(seq)
        else:
            cells.setdefault(cell, []).append(line)
    return gone


_TAIL = re.compile(r"\s*(?:via|using|in|at|through|with)\s+.*")


def short_title(title: str) -> str:
    return re.sub(r"\s+", " ", _TAIL.sub("", title.lower())).strip()


def band_duplicates(issues: DataFrame) -> DataFrame:
    """(doc_id, seq) of findings that an earlier one of the same title, without where and how, stands for."""
    per_doc = issues.groupBy("doc_id").agg(F.collect_list(F.struct("title", F.coalesce("line", F.lit(-1)).alias("line"), "seq")).alias("rows"))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def gone(lists):
        import pandas as pd

        return pd.Series([sorted(banded([(short_title(r["title"]), r["line"], r["seq"]) for r in rows])) for rows in lists])

    return per_doc.select("doc_id", F.explode(gone("rows")).alias("seq"))


def firewall(issues: DataFrame) -> DataFrame:
    """What is left of findings by (doc_id, seq): not those that an earlier one stands for or that a safe one beside them contradicts; severe ones without evidence become medium risks, with the reason."""
    gone = band_duplicates(issues).unionByName(apply(suppress.contradictions, issues=issues).selectExpr("doc_id", "CAST(b AS BIGINT) AS seq")).distinct()
    held = apply(suppress.mandatory_evidence, issues=issues)
    return held.join(gone, ["doc_id", "seq"], "left_anti").select("doc_id", "seq", "passed", "reason", "severity", "type")


# -- blocks and context ------------------------------------------------------------------------------------------------

_OPENS = re.compile(r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(?[^)]*\)?\s*=>")
_CRITICAL = [(re.compile(p, re.I if "i" in f else 0), w) for p, f, w, _ in K.CRITICAL]
_PLAIN = [re.compile(p.replace(r"\z", r"\Z")) for p in K.BOILERPLATE]
_ASSIGN = re.compile(r"(?:const|let|var)\s+\w+\s*=.*req\.")
_IMPORT = re.compile(r"^\s*(?:import\s|from\s+\S+\s+import\s|(?:const|let|var)\s+.*=\s*require\s*\()")


def line_score(line: str) -> int:
    score = sum(w for p, w in _CRITICAL if p.search(line))
    return score - 3 * any(p.search(line) for p in _PLAIN) + 4 * bool(_ASSIGN.search(line))


def function_blocks(code: str) -> list[tuple[str, int, int, int]]:
    """(name, first line, last line, highest line score), in the order in which they close. Braces in strings count too."""
    lines = code.split("\n")
    scores, stack, out = [line_score(x) for x in lines], [], []
    for i, line in enumerate(lines):
        if m := _OPENS.search(line):
            stack.append((i, m[1] or m[2] or "anonymous"))
        opens, closes = line.count("{"), line.count("}")
        for _ in range(max(0, closes - opens) if closes else 0):
            if stack:
                first, name = stack.pop()
                out.append((name, first + 1, i + 1, max([0, *scores[first : i + 1]])))
    return out


def context(code: str, budget: int = 6000) -> str:
    """What a reader needs of a file that is too long: imports, the lines around telling ones, whole telling functions; gaps are marked."""
    if len(code) <= budget:
        return code
    lines = code.split("\n")
    scores = [line_score(x) for x in lines]
    keep = set([i for i, x in enumerate(lines) if _IMPORT.search(x)][:30])
    for i, s in enumerate(scores):
        if s >= 5:
            keep.update(range(max(0, i - 5), min(len(lines), i + 6)))
    for _, first, last, top in function_blocks(code):
        if top >= 7 and last - first <= 60:
            keep.update(range(first - 1, last))
    out, size, before = [], 0, -1
    for i in sorted(keep):
        part = ([f"// ... {i - before - 1} lines left out"] if i > before + 1 else []) + [f"{i + 1}: {lines[i]}"]
        more = sum(len(x) + 1 for x in part)
        if size + more > 0.95 * budget:
            break
        out += part
        size += more
        before = i
    return "\n".join(out)


_BLOCK = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("score", T.IntegerType())]))


def blocks(files: DataFrame) -> DataFrame:
    """(doc_id, name, first, last, score) of each function."""

    @F.pandas_udf(_BLOCK)
    def found(codes):
        import pandas as pd

        return pd.Series([[dict(zip(("name", "first", "last", "score"), b, strict=True)) for b in function_blocks(c or "")] for c in codes])

    return files.select("doc_id", F.explode(found("code")).alias("b")).select("doc_id", "b.*")


def contexts(files: DataFrame, budget: int = 6000) -> DataFrame:
    return files.select("doc_id", _string_udf(lambda c: context(c, budget))("code").alias("context"))


# -- patches -----------------------------------------------------------------------------------------------------------


def _quote(code: str) -> str:
    return '"' if code.count('"') >= code.count("'") else "'"


def patch_line(rule: str, line: str, quote: str = "'") -> str | None:
    """A line as its rule would have it; null if the rule has no rewriting or the line no place for it."""
    if rule.startswith("sqli"):
        if m := re.search(r'db\.(?:query|execute|run)\s*\(\s*"([^"]+)"\s*\+\s*(\w+)\s*\)', line):
            return line.replace(m[0], f"db.query({quote}{m[1]}?{quote}, [{m[2]}])")
        if m := re.search(r"db\.(?:query|execute|run)\s*\(`([^`]*)\$\{(\w+)\}([^`]*)`\)", line):
            return line.replace(m[0], f"db.query({quote}{m[1]}?{m[3]}{quote}, [{m[2]}])")
    elif rule.startswith("xss"):
        if (m := re.search(r"\.innerHTML\s*=\s*([\w.]+)", line)) and "DOMPurify" not in line:
            return line.replace(m[1], f"DOMPurify.sanitize({m[1]})") if m[1] != "innerHTML" else None
    elif rule.startswith("cmd"):
        if m := re.search(r"exec(?:Sync)?\s*\(`([^`$]+)\$\{(\w+)\}`", line):
            indent = line[: len(line) - len(line.lstrip())]
            return f"{indent}spawn({quote}{m[1].strip()}{quote}, [{m[2]}], {{ shell: false }})"
    elif rule.startswith("timing"):
        if m := re.search(r"(\w+)\s*===\s*(\w+)", line):
            return line.replace(m[0], f"crypto.timingSafeEqual(Buffer.from({m[1]}), Buffer.from({m[2]}))")
    elif rule.startswith("jwt"):
        if m := re.search(r"jwt\.decode\s*\(([^)]+)\)", line):
            return line.replace(m[0], f"jwt.verify({m[1]}, process.env.JWT_SECRET, {{ algorithms: [{quote}HS256{quote}] }})")
    elif rule.startswith("mass"):
        if m := re.search(r"Object\.assign\s*\(\s*(\w+)\s*,\s*req\.body\s*\)", line):
            return line.replace(m[0], f"Object.assign({m[1]}, pick(req.body, ALLOWED_FIELDS))")
    elif rule.startswith("path"):
        if m := re.search(r"path\.join\s*\(\s*__dirname\s*,\s*([\w.]+)\s*\)", line):
            indent = line[: len(line) - len(line.lstrip())]
            return f"{line}\n{indent}if (!path.resolve(__dirname, {m[1]}).startsWith(path.resolve(__dirname))) throw new Error({quote}Forbidden{quote});"
    return None


#: What a rewriting needs: (start of the rule, word in the code, import).
IMPORTS = [("xss", "DOMPurify", "import DOMPurify from 'dompurify';"), ("cmd", "spawn", "import { spawn } from 'child_process';"), ("timing", "crypto.", "import crypto from 'crypto';")]


def patch(code: str, requests: list[tuple[str, int]]) -> tuple[str, int]:
    """The code with each request (rule, line) carried out, from the last line up, and imports that it needs after those it has."""
    lines, quote, done, needs = code.split("\n"), _quote(code), 0, []
    for rule, n in sorted(set(requests), key=lambda r: (-r[1], r[0])):
        if 1 <= n <= len(lines) and (new := patch_line(rule, lines[n - 1], quote)) not in (None, lines[n - 1]):
            lines[n - 1] = new
            done += 1
            needs += [x for start, _, x in IMPORTS if rule.startswith(start) and x not in lines and x not in needs]
    if needs:
        at = max([i + 1 for i, x in enumerate(lines[:30]) if _IMPORT.search(x)], default=0)
        lines[at:at] = needs
    return "\n".join(lines), done


def patches(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, patched, n_patches) of the files that have findings: (doc_id, rule_id, line_no)."""
    wanted = findings.groupBy("doc_id").agg(F.collect_list(F.struct("rule_id", "line_no")).alias("wanted"))

    @F.pandas_udf(T.StructType([T.StructField("patched", T.StringType()), T.StructField("n_patches", T.IntegerType())]))
    def carried(codes, lists):
        import pandas as pd

        return pd.DataFrame([patch(c or "", [(r["rule_id"], r["line_no"]) for r in rows]) for c, rows in zip(codes, lists, strict=True)], columns=["patched", "n_patches"])

    return files.join(wanted, "doc_id").select("doc_id", carried("code", "wanted").alias("p")).select("doc_id", "p.*")
