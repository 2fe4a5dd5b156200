"""Plain versions of the operators over lists of rows, one row at a time."""

import hashlib
import re
import zlib

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RUN = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode())


def words(text):
    return WORD.findall(low(text))


def dedup(rows, n=50):
    first = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for i in range(len(b) - n + 1):
            w = b[i : i + n]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if first[b[i : i + n]] < d:
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def contamination(rows, items, n=10):
    wins = set()
    for item, text in items:
        ws = words(text)
        for i in range(max(1, len(ws) - n + 1) if ws else 0):
            wins.add((item, tuple(ws[i : i + n])))
    by = {}
    for item, w in wins:
        by.setdefault(w, set()).add(str(item))
    sizes, out = {len(w) for w in by}, []
    for d, text in rows:
        ws, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(ws) - size + 1):
                items_ = by.get(tuple(ws[i : i + size]))
                if items_:
                    hit |= set(range(i, i + size))
                    found |= items_
        out.append((d, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def simhash(rows, n=3, radius=2):
    import xxhash

    fps = []
    for d, text in rows:
        ws = [w.encode() for w in RUN.findall(low(text).decode())]
        sh = [b" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)] or ([b" ".join(ws)] if ws else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps.append((d, sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))))
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b, key=lambda k: fps[k][0])] = min(a, b, key=lambda k: fps[k][0])
    return sorted((d, f"{f:016x}", fps[find(i)][0]) for i, (d, f) in enumerate(fps))


def licenses(rows, phrases):
    out = []
    for d, text in rows:
        ws, places, labels = [w.decode() for w in words(text)], [], set()
        for p, label in phrases.items():
            p = p.split()
            at = [i for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        out.append((d, len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    return sorted(out)


def tokens(rows, path):
    import numpy as np
    from tokenizers import Tokenizer

    tok, at, out = Tokenizer.from_file(path), 0, []
    for d, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out
