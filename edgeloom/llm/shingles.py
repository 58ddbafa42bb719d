"""Word shingles of many texts at once, as 64-bit hashes, with numpy."""

from __future__ import annotations

import numpy as np

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_R = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[0, 9, 10, 11, 12, 13, 32]] = False
_POW: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    if not len(_POW) or len(_POW["up"]) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _R, dtype=np.uint64), np.full(size, pow(_R, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _POW["up"], _POW["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POW["up"], _POW["down"]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums: (sums[j] - sums[i]) * down[i] is a hash of the bytes from i to j."""
    up, _ = powers(len(buf) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:len(buf)])])


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A-Z lowered UTF-8 bytes of all texts, a zero byte after each, and where each begins.

    A zero byte inside a text would end a word, which the word pattern does not; it is read as byte 1.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass").replace(b"\0", b"\1") for t in texts]
    size = np.array([len(p) + 1 for p in parts], dtype=np.int64)
    return _LOWER[np.frombuffer(b"\0".join(parts) + b"\0", dtype=np.uint8)], np.cumsum(size) - size


def word_hashes(buf: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, start, end) of every word `[^\\x20\\x09-\\x0D]+`, in order."""
    solid = _WORD[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    _, down = powers(len(buf) + 1)
    total = prefix_sums(buf)
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(begin, start, "right") - 1, start, end


def shingle_hashes(h: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, first word) of every k-word shingle; a text of fewer words is one shingle of all its words."""
    n = len(h)
    if not n:
        return h, text, text
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc[:max(0, n - j)] = mix(acc[:max(0, n - j)] * M1 + h[j:])
    whole = np.zeros(n, dtype=bool)
    if n >= k:
        whole[:n - k + 1] = text[:n - k + 1] == text[k - 1:]
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    size = np.diff(np.concatenate([first, [n]]))
    for f, s in zip(first[size < k].tolist(), size[size < k].tolist()):
        x = np.full(1, s, np.uint64)
        for j in range(s):
            x = mix(x * M1 + h[f + j:f + j + 1])
        acc[f], whole[f] = x[0], True
    at = np.flatnonzero(whole)
    return acc[at], text[at], at


def distinct(sh: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every shingle once per text, in order of (text, hash)."""
    order = np.lexsort((sh, text))
    sh, text = sh[order], text[order]
    keep = np.ones(len(sh), dtype=bool)
    keep[1:] = (sh[1:] != sh[:-1]) | (text[1:] != text[:-1])
    return sh[keep], text[keep]


def chunks(texts: list, limit: int = 1 << 20):
    """Slices of a batch that hold about ``limit`` characters each (a longer text is a slice of its own)."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit or i == len(texts) - 1:
            yield at, i + 1
            at, size = i + 1, 0
