"""Plain-Python versions of the operators, by their definitions."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def repeat_words(ws, window=8):
    seen = {}
    for i in range(len(ws) - window + 1):
        seen.setdefault(tuple(ws[i : i + window]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(window)})


def removed(docs, window=13):
    """`{position in docs: places of removed words}` for (id, text) rows; rows of a null id are left alone."""
    owner = {}
    for doc, text in docs:
        ws = words(text)
        for i in range(len(ws) - window + 1):
            if doc is not None:
                key = tuple(ws[i : i + window])
                owner[key] = min(doc, owner.get(key, doc))
    out = {}
    for at, (doc, text) in enumerate(docs):
        ws = words(text)
        out[at] = {
            i + k
            for i in range(len(ws) - window + 1)
            if doc is not None and owner[tuple(ws[i : i + window])] < doc
            for k in range(window)
        }
    return out


def shingles(text, size):
    ws = words((text or "").translate(UPPER))
    if not ws:
        return set()
    return {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))}


def jaccard_components(docs, size, percent):
    """`{id: component}` of (id, text) rows."""
    sets = [(doc, shingles(text, size)) for doc, text in docs if doc is not None]
    parent = {doc: doc for doc, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[i + 1 :]:
            common = len(s & t)
            if s and t and 100 * common >= percent * (len(s) + len(t) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {doc: find(doc) for doc in parent}


def item_words(text):
    return ITEM_WORD.findall((text or "").translate(UPPER))


def phrase_hits(text, items, window=13):
    """`(n_words, hit places, items)` of a text."""
    ws, hit, found = item_words(text), set(), set()
    for item, phrase in items:
        terms = item_words(phrase)
        size = min(window, len(terms))
        if not size or item is None:
            continue
        wanted = {tuple(terms[i : i + size]) for i in range(len(terms) - size + 1)}
        for i in range(len(ws) - size + 1):
            if tuple(ws[i : i + size]) in wanted:
                hit |= set(range(i, i + size))
                found.add(str(item))
    return len(ws), hit, sorted(found)
