"""Plain single-process versions of the operators, to test against."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(UPPER))


def contamination(documents, items, window=10):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document."""
    where = defaultdict(set)
    for item, text in items:
        found = words(text)
        size = min(window, len(found))
        for i in range(len(found) - size + 1 if found else 0):
            where[tuple(found[i:i + size])].add("null" if item is None else str(item))
    sizes = {len(w) for w in where}
    rows = []
    for doc_id, text in documents:
        found, hit, names = words(text), set(), set()
        for size in sizes:
            for i in range(len(found) - size + 1):
                if (key := tuple(found[i:i + size])) in where:
                    names |= where[key]
                    hit.update(range(i, i + size))
        rows.append((doc_id, len(found), len(hit), len(names), sha(",".join(sorted(names))),
                     bool(hit)))
    return rows


SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text: str | None, size: int = 5) -> frozenset:
    found = SPACES.findall((text or "").translate(UPPER))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i:i + size]) for i in range(max(1, len(found) - size + 1)))


def jaccard(documents):
    """(doc_id, n_shingles, component_id): all pairs that share a shingle are compared."""
    sets = [shingle_set(text) for _, text in documents]
    where, parent = defaultdict(list), list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = {}
    for i, own in enumerate(sets):
        if own and (same := first.setdefault(own, i)) != i:
            parent[root(i)] = root(same)
            continue
        met = {j for s in own for j in where[s]}
        for j in met:
            if root(i) != root(j):
                common = len(own & sets[j])
                if 5 * common >= 4 * (len(own) + len(sets[j]) - common):
                    parent[root(i)] = root(j)
        for s in own:
            where[s].append(i)
    least = {}
    for i, (doc_id, _) in enumerate(documents):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [(doc_id, len(sets[i]), least.get(root(i)) if sets[i] else doc_id)
            for i, (doc_id, _) in enumerate(documents)]


IDENTIFIERS = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def identifiers(text: str | None):
    """(start, kind number, end) of the plain identifiers."""
    out = []
    for number, (kind, pattern) in enumerate(IDENTIFIERS):
        for m in pattern.finditer(text or ""):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            if kind == "card":
                total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4)
                            for i, d in enumerate(reversed(digits)))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            out.append((m.start(), number, m.end()))
    return sorted(out)


def boilerplate(documents, min_sites, min_contexts):
    """Bare lines (text, source rows) that are on enough sites and in enough contexts."""
    sites, contexts = defaultdict(set), defaultdict(set)
    texts = {text: {line.strip(" \t\r") for line in text.split("\n")} - {""}
             for text, _ in documents if text is not None}
    for text, source in documents:
        for line in texts.get(text, ()):
            sites[line].add(source)
    spread = {line for line in sites if len(sites[line]) >= min_sites}
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    held = defaultdict(int)
    for text, lines in texts.items():
        wide = sorted(lines & spread, key=md5)
        pairs = []
        for line in lines - spread:
            words = re.findall(r"[^ \t\r]+", line)
            pairs += [md5(" ".join(words[i:i + 2])) for i in range(max(1, len(words) - 1))]
        alike = 9 * len(wide) >= 8 * len(lines)
        for line in wide:
            held[line] += 1
            for at in (1, 6, 11, 16):
                contexts[line, at].add((wide[0], wide[-1]) if alike else min(p[at - 1:at + 15] for p in pairs))
    most = {line: max(len(contexts[line, at]) for at in (1, 6, 11, 16)) for line in held}
    return {line for line, n in most.items() if n >= min_contexts and 2 * n >= held[line]}


def without_lines(text, lines):
    if text is None:
        return None
    return "\n".join(x for x in text.split("\n") if x.strip(" \t\r") not in lines)
