"""Plain restatements of the contracts, for small tables only."""

import hashlib
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def lower_words(text):
    return WORD.findall((text or "").translate(LOWER))


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def decontaminate(docs, items):
    """docs, items: lists of (id, text) -> rows of op2."""
    by_length = {}
    for item, text in items:
        words = lower_words(text)
        n = min(10, len(words))
        for i in range(len(words) - n + 1) if n else ():
            by_length.setdefault(n, {}).setdefault(tuple(words[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        words = lower_words(text)
        hit, found = set(), set()
        for n, windows in by_length.items():
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[w]
        out.append((doc, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def repeats(docs, window=50):
    """docs: list of (id, text) -> rows (id, n_words, n_removed, kept) of op10."""
    least = {}
    for doc, text in docs:
        words = space_words(text)
        for i in range(len(words) - window + 1) if doc is not None else ():
            key = tuple(words[i : i + window])
            least[key] = min(doc, least.get(key, doc))
    out = []
    for doc, text in docs:
        words = space_words(text)
        gone = set()
        for i in range(len(words) - window + 1) if doc is not None else ():
            if least[tuple(words[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((doc, len(words), len(gone), " ".join(kept)))
    return out


def shingle_set(text, k=5):
    words = space_words(text)
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def links(texts, threshold=0.8):
    """Pairs of different texts of Jaccard similarity >= threshold."""
    sets = [(t, shingle_set(t)) for t in dict.fromkeys(texts)]
    out = set()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
                out.add(frozenset((a, b)))
    return out


ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def quality_counts(text):
    from collections import Counter

    text = text or ""
    words = space_words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if space_words(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            cover.update(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), len(words) < 20 or 100 * len(cover) > 30 * len(words)


def license_places(text):
    words = lower_words(text)
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    found = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in found}))
