import base64
import random
import re
import struct
from collections import Counter

import pytest
import xxhash
from brute import sha

from lexaloom.llm import fingerprints as P


def text(rng, n):
    return "".join(rng.choice(["word ", "é中. ", "\n", "x" * rng.randint(1, 90), "! ", "same line\n"]) for _ in range(n))


M = (1 << 64) - 1


def parts(text):
    """Lines; a long one is cut behind sentence ends, or at 320 characters."""
    for line in text.split("\n"):
        if len(line) <= 320:
            yield from [line] * bool(line)
            continue
        held = ""
        for sentence in re.findall(r"[^.!?]*[.!?]+\s*|[^.!?]+", line, re.S):
            held += sentence
            while len(held) > 320:
                yield held[:320]
                held = held[320:]
            if len(held) >= 160:
                yield held
                held = ""
        yield from [held] * bool(held)


def keys(text):
    seen, out = Counter(), []
    for p in parts(text):
        d = xxhash.xxh64_intdigest(p)
        out.append(xxhash.xxh64_intdigest(p, seen[d]) if seen[d] else d)
        seen[d] += 1
    return out


def scramble(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def places(key, size):
    return [row * size + ((scramble(key ^ seed) >> 32) & (size - 1)) for row, seed in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))]


def printed(text):
    """The table of a text, cell by cell: the smallest size at which taking out pure cells empties it."""
    own, check = keys(text), lambda k: scramble(k ^ 0x5851F42D4C957F2D) >> 32
    size = 4
    while 3 * size < 2 * len(own):
        size *= 2
    while True:
        cells = [[0, 0, 0] for _ in range(3 * size)]
        for k in own:
            for at in places(k, size):
                cells[at][0] += 1
                cells[at][1] ^= check(k)
                cells[at][2] ^= k
        raw = struct.pack("<II", len(own), size) + b"".join(struct.pack("<hIQ", *c) for c in cells)
        left, moved = set(own), True
        while moved:
            moved = False
            for k in list(left):
                if any(cells[at][0] == 1 for at in places(k, size)):
                    for at in places(k, size):
                        cells[at][0] -= 1
                    left.remove(k)
                    moved = True
        if not left:
            return base64.b64encode(raw).decode()
        size *= 2


def exact(a, b):
    x, y = Counter(parts(a)), Counter(parts(b))
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 1.0


def test_tables_recover_differences():
    rng = random.Random(1)
    texts = [text(rng, rng.randint(0, 400)) for _ in range(60)] + ["", "same line\n" * 500, "y" * 10_000]
    prints = P.fingerprints(texts)
    assert prints == [P.fingerprints([t])[0] for t in texts]
    for t, p in zip(texts, prints):
        assert p == printed(t) and P.recovered(p) == set(keys(t))
    pairs = [(rng.randrange(len(texts)), rng.randrange(len(texts))) for _ in range(200)]
    got = P.likeness([(prints[a], prints[b]) for a, b in pairs])
    for (a, b), value in zip(pairs, got):
        assert abs(value - exact(texts[a], texts[b])) < 1e-12
        x, y = set(keys(texts[a])), set(keys(texts[b]))
        assert P.differing(prints[a], prints[b]) == (x - y, y - x)


@pytest.mark.parametrize("block_bytes,slice_bytes", [(8 << 20, 2 << 20), (900, 200)])
def test_versions(spark, block_bytes, slice_bytes, monkeypatch):
    inner = P.versions
    monkeypatch.setattr(P, "versions", lambda d: inner(d, block_bytes=block_bytes, slice_bytes=slice_bytes))
    rng = random.Random(8)
    docs = [(i * 3, text(rng, rng.randint(0, 60))) for i in range(80)] + [(1, None), (2, ""), (5, "ab\ncd"), (5, "ab\ncd"), (None, "null id\n" * 9), (400, "z" * 50_000), (401, "é" * 9)]
    df = spark.createDataFrame([(k, t, 1, "b") for k, t in docs], "doc_id long, text string, n_chars int, block string").repartition(4)
    order = sorted(((k, t or "") for k, t in docs), key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    want = []
    for (k, t), (_, after) in zip(order, order[1:] + order[:1]):
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        want.append((k, len(t), sha(edited), printed(t), printed(edited), round(exact(t, edited), 9), round(exact(t, after), 9)))
    got = [(*tuple(r)[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in P.query(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_one_id_in_most_rows(spark):
    docs = [(5, f"line {i}\nand more") for i in range(3000)] + [(1, "first"), (9, "last")]
    got = P.query(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    order = sorted(docs)
    want = Counter((k, sha(t[: len(t) - len(t) // 4] + b[: len(t) // 4])) for (k, t), (_, b) in zip(order, order[1:] + order[:1]))
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == want


def test_few_rows(spark):
    one = spark.createDataFrame([(3, "abcd")], "doc_id long, text string")
    assert P.query(one).first().edited_sha256 == sha("abca")
    assert P.query(one.limit(0)).collect() == []
