"""What the operators compute, by plain loops."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import zstandard
from tokenizers import Tokenizer

BPE = P.path("word_bpe_49k.json")


def components_brute(texts, k, percent):
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}, {d: len(s) for d, s in sets.items()}


def check_pieces(rows, texts, size=2048):
    t = Tokenizer.from_file(BPE)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(texts)
    for d, pieces in by.items():
        ids = np.array([*t.encode(texts[d] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size
    return seqs


def bands_brute(data):
    """The bands from their table: the whole text, and chunks of which the last ends with the text."""
    pack = lambda x: len(x) / len(zstandard.ZstdCompressor(level=3).compress(x))
    if not data:
        return False
    limits = {0: (0.4, 2.6), 128: (0.8, 2.6), 256: (1.1, 3.0), 512: (1.32, 3.2), 1024: (1.5, 3.4), 2048: (1.5, 3.6), 4096: (1.5, 4.0), 16384: (1.5, 4.5)}
    lo, hi = limits[max(k for k in limits if k <= len(data))]
    if not lo <= pack(data) <= hi:
        return False
    if len(data) < 512:
        return True
    size, lo, hi = (4096, 1.5, 4.0) if len(data) >= 4096 else (512, 1.32, 3.0)
    ends = sorted({*range(size, len(data) + 1, size), len(data)})
    return sum(not lo <= pack(data[e - size : e]) <= hi for e in ends) * 2 <= len(ends)


def rules_brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(cover), failed, bands_brute(text.encode()) and not failed)


def contaminated_brute(text, items):
    """Whether a text holds an item word for word."""
    norm = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    own = norm(text)
    return any(norm(i).strip() and norm(i) in own for i in items)
