"""Plain Python forms of the contracts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    v = [int(c) for c in reversed(d)]
    return sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(v)) % 10 == 0


def base_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda d=d: 13 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=d: 9 <= len(d) <= 15,
            }[kind]()
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def near_components(docs, k, percent):
    sets = {i: shingle_set(t, k) for i, t in docs}
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            index[g].append(i)
    both = Counter()
    for ids in index.values():
        for x in range(len(ids)):
            for y in range(x):
                both[ids[y], ids[x]] += 1
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def repeats(docs, window):
    """(n_bytes, n_removed, n_spans, digest) by position in docs."""
    raw = [(t or "").encode() for _, t in docs]
    count = Counter(r[i : i + window] for r in raw for i in range(len(r) - window + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        last = -1
        for i in range(len(r) - window + 1):
            if count[r[i : i + window]] > 1:
                gone[max(i, last) : i + window] = True
                last = i + window
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        out.append((len(r), int(gone[: len(r)].sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def pieces_ok(rows, docs, path, size=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in docs}
    seen, room = defaultdict(int), defaultdict(list)
    for r in rows:
        whole = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(whole)
        assert zlib.crc32(whole[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        seen[r["doc_id"]] += r["length"]
        room[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {i: len(x) for i, x in ids.items()} == dict(seen)
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return sum(seen.values()), len(room)
