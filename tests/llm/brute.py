"""Plain forms of the contracts, a document at a time, written from their wording."""

import hashlib
import re
from collections import Counter

import xxhash

SPACES = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def told(spans, kinds):
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))


def secrets(text):
    text = text or ""
    kinds = ["assign", "access", "hex"]
    spans = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    n = Counter(k for _, k, _ in spans)
    return n[0], n[1], n[2], sha(told(spans, kinds))


def fingerprint(text, width=3):
    words = re.findall(SPACES, lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows, bits=3):
    """rows: (id, fingerprint); the smallest id reachable, by comparing all."""
    out = {}
    for i, (a, _) in enumerate(rows):
        out[i] = i
    find = lambda i: i if out[i] == i else find(out[i])
    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= bits:
                out[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), k) if x is not None), default=None)
    return [least[find(i)] for i in range(len(rows))]


def licenses(text):
    words = re.findall(ALNUM, lower(text))
    base = []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        base += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in base]
    return len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base}))


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(digits[::-1])) % 10 == 0


def personal(text):
    text = text or ""
    kinds = ["email", "ip", "card", "phone"]
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    spans += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    n = Counter(k for _, k, _ in spans)
    return n[0], n[1], n[2], n[3], sha(told(spans, kinds))


def contamination(text, items, window=13):
    """items: (id, text)."""
    words = re.findall(ALNUM, lower(text))
    hit, owners = set(), set()
    for key, item in items:
        w = re.findall(ALNUM, lower(item))
        size = min(window, len(w))
        for i in range(len(w) - size + 1) if w else ():
            for j in range(len(words) - size + 1):
                if words[j : j + size] == w[i : i + size]:
                    hit.update(range(j, j + size))
                    owners.add(str(key))
    return len(words), len(hit), len(owners), sha(",".join(sorted(owners))), bool(hit) and 20 * len(hit) >= len(words)


def contamination_index(items, window=13):
    """The same with a table of windows, for larger inputs."""
    table = {}
    for key, item in items:
        w = tuple(re.findall(ALNUM, lower(item)))
        size = min(window, len(w))
        for i in range(len(w) - size + 1) if w else ():
            table.setdefault(w[i : i + size], set()).add(str(key))
    sizes = {len(k) for k in table}

    def one(text):
        words = tuple(re.findall(ALNUM, lower(text)))
        hit, owners = set(), set()
        for size in sizes:
            for j in range(len(words) - size + 1):
                if found := table.get(words[j : j + size]):
                    hit.update(range(j, j + size))
                    owners |= found
        return len(words), len(hit), len(owners), sha(",".join(sorted(owners))), bool(hit) and 20 * len(hit) >= len(words)

    return one


def rules(text):
    text = text or ""
    words = re.findall(SPACES, text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(SPACES, line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    again = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), n < 20 or 100 * len(again) > 30 * n


def edits(a, b):
    """Letters put in, left out or changed to make b of a."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def notices(text, known):
    """Every window of a text against every notice; fewest errors first, then by start and end, and nothing that overlaps an earlier one of its notice."""
    out = []
    for notice, label, k in known:
        near = [(e, s, t) for s in range(len(text)) for t in range(s + len(notice) - k, min(len(text), s + len(notice) + k) + 1) if (e := edits(notice, text[s:t])) <= k]
        taken = []
        for e, s, t in sorted(near):
            if all(t <= a or b <= s for a, b in taken):
                taken.append((s, t))
                out.append((s, t, label, 1.0 - e / len(notice)))
    return sorted(out)


def linked_secrets(text, scope):
    """All spans of the secret scan, by looking at every pair of parts."""
    from gridwarden.llm import secret_scan as S

    look = lambda p: [m.span() for m in re.finditer(p, text)]
    parts = [(s, e, 0) for s, e in ((m.start(), m.end()) for m in re.finditer(S.ASSIGN, text) if len(m.group(2)) >= S.MIN_VALUE)]
    parts += [(s, e, k) for k, p in ((1, S.ACCESS), (2, S.HEX), (3, S.IDENTIFIER), (4, S.MIXED), (5, S.ENDPOINT)) for s, e in look(p)]
    ids = [(s, e) for s, e, k in parts if k == 3]
    over = lambda p: p[2] != 3 and any(p[0] < e and s < p[1] for s, e in ids)
    gap = lambda a, b: max(a[0], b[0]) - min(a[1], b[1])
    has = lambda p, kinds: any(q[2] in kinds and not over(q) and 0 <= gap(p, q) <= scope for q in parts)
    by_id, by_secret = (lambda p: has(p, (1, 3))), (lambda p: has(p, (0, 2, 4)))
    told = {0: lambda p: True, 1: lambda p: True, 2: lambda p: True, 3: by_secret, 4: lambda p: by_id(p) and not over(p), 5: lambda p: by_id(p) and by_secret(p)}
    return ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in sorted((s, k, e) for s, e, k in parts if told[k]((s, e, k))))


def similar_groups(rows, width=5, similarity=0.8):
    """{row number: smallest row number that links reach}: every pair of texts that share a shingle is compared, and copies without words are one group."""
    sets = []
    for t in rows:
        words = re.findall(SPACES, lower(t or ""))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or {tuple(words)})
    having = {}
    for i, s in enumerate(sets):
        for x in s:
            having.setdefault(x, []).append(i)
    least = list(range(len(rows)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, s in enumerate(sets):
        near = Counter(j for x in s for j in having[x] if j < i)
        for j, n in near.items():
            if n >= similarity * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                least[b] = a
    return {i: root(i) for i in range(len(rows))}
