"""Small documents with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, n: int) -> list[str]:
    """n words that no other seed has."""
    return [f"w{seed}x{k * k % 9973}" for k in range(n)]


def awkward() -> list[tuple[int, str | None, str]]:
    """(doc_id, text, lang): copies, near copies, shared passages, nulls, empty and long texts, odd bytes, ties, repeated rows."""
    base = prose(1, 300)
    passage = " ".join(prose(2, 70))
    near = [*base[:150], "changed", *base[151:]]
    far = [w if k % 3 else f"z{k}" for k, w in enumerate(base)]
    rows = [
        (1, " ".join(base)), (2, " ".join(near)), (3, "\n\t" + "  ".join(base).upper()), (4, " ".join(far)), (5, " ".join(base)),
        (6, None), (7, ""), (8, " \t\n "), (9, "one"), (10, "ONE"), (11, "one two three"), (12, "One two three"), (13, "one two three four five"),
        (14, " ".join(prose(3, 40)) + " " + passage + " " + " ".join(prose(4, 50))), (15, " ".join(prose(5, 90)) + "\n" + passage), (16, passage + passage),
        (17, "a" * 300), (18, "a" * 120), (19, "na " * 200), (20, "é" * 90 + " “quoted” 中文 " + passage), (21, " ".join(prose(6, 6000))), (22, " ".join(prose(6, 6000)[100:])),
        (-3, " ".join(near[:200])), (40, " ".join(prose(7, 19))), (41, " ".join(prose(7, 20))), (42, " ".join(prose(7, 21))),
        (30, " ".join(prose(8, 30))), (30, " ".join(prose(8, 30))),
    ]
    rows += [(100 + k, " ".join([*base[: 20 * k], f"v{k}", *base[20 * k :]])) for k in range(12)]
    rows += [(200 + k, " ".join(w if (j * 7 + k) % 11 else f"y{k}" for j, w in enumerate(prose(9, 120)))) for k in range(25)]
    return [(i, t, "en") for i, t in rows]


def shingles(text: str | None, k: int = 5) -> set:
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def components(ids, links) -> dict:
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard(rows) -> list[tuple]:
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    found = components({i for i, _ in sets}, links)
    return sorted((i, len(s), found[i]) for i, s in sets)


def word_repeats(rows, n: int = 20) -> list[tuple]:
    first: dict = {}
    texts = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    for i, w in texts:
        for k in range(len(w) - n + 1):
            first[tuple(w[k : k + n])] = min(first.get(tuple(w[k : k + n]), (i, k)), (i, k))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < (i, k):
                gone[k : k + n] = [True] * n
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out)


def byte_repeats(rows, n: int = 50) -> list[tuple]:
    first: dict = {}
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    for i, b in texts:
        for k in range(len(b) - n + 1):
            first[b[k : k + n]] = min(first.get(b[k : k + n], i), i)
    out = []
    for i, b in texts:
        gone, reach = bytearray(len(b)), 0
        for k in range(len(b) - n + 1):
            if first[b[k : k + n]] < i:
                for z in range(max(k, reach), k + n):
                    gone[z] = 1
                reach = k + n
        spans = sum(1 for z in range(len(b)) if gone[z] and (z == 0 or not gone[z - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)
