"""Plain single-process versions of the operators, for comparison."""

import hashlib
import re
from collections import Counter


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def substring_rows(docs, width=200):
    seen = Counter()
    for _, text in docs:
        b = (text or "").encode()
        seen.update(b[i : i + width] for i in range(len(b) - width + 1))
    out = []
    for key, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((key, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g))))
    return sorted(out, key=str)


def passage_rows(docs, length=35):
    words = [(key, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for key, text in docs]
    seen = Counter()
    for _, w in words:
        seen.update(tuple(w[i : i + length]) for i in range(len(w) - length + 1))
    out = []
    for key, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append((key, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out, key=str)


def words13(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination_rows(docs, items, width=13):
    windows = []
    for name, text in items:
        w = words13(text)
        if w:
            windows += [(name or "", tuple(w[i : i + width])) for i in range(max(1, len(w) - width + 1))]
    out = []
    for key, text in docs:
        w = words13(text)
        hit, found = [False] * len(w), []
        for item in {x for x, _ in enumerate(items)}:
            any_hit = False
            iw = words13(items[item][1])
            for i in range(max(1, len(iw) - width + 1) if iw else 0):
                window = iw[i : i + width]
                for at in range(len(w) - len(window) + 1):
                    if w[at : at + len(window)] == window:
                        hit[at : at + len(window)] = [True] * len(window)
                        any_hit = True
            if any_hit:
                found.append(str(items[item][0]) if items[item][0] is not None else "")
        out.append((key, len(w), sum(hit), len(found), sha(",".join(sorted(found))), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out, key=str)
