"""Sets of hashed word shingles, computed on whole arrays of bytes."""

from __future__ import annotations

from functools import cache

import numpy as np

WORDS = 5
#: Texts are hashed in slices of about so many bytes, cut at white space, to bound memory.
SLICE = 1 << 18
_R = 0x9E3779B97F4A7C15
_C = np.uint64(0xC2B2AE3D27D4EB4F)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of A-Z, other bytes as they are; and whether a byte is white space."""
    low = np.arange(256, dtype="u1")
    low[65:91] += 32
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return low, space


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    r, inverse = np.full(n, _R, "u8"), np.full(n, pow(_R, -1, 1 << 64), "u8")
    r[0] = inverse[0] = 1
    return np.cumprod(r, dtype="u8"), np.cumprod(inverse, dtype="u8")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words of data, A-Z in lower case: a polynomial of the word's bytes, mixed."""
    low, space = _tables()
    b = low[np.frombuffer(data, "u1")]
    s = np.concatenate([[True], space[b], [True]])
    edge = np.flatnonzero(s[1:] != s[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(1 << max(10, (len(b) + 1).bit_length()))
    total = np.concatenate([np.zeros(1, "u8"), np.cumsum((b.astype("u8") + np.uint64(1)) * up[: len(b)], dtype="u8")])
    return _mix((total[ends] - total[starts]) * down[starts]), starts


def _words(text: str) -> np.ndarray:
    """Word hashes of one long text."""
    data, out, a = text.encode("utf-8", "surrogatepass"), [], 0
    while a < len(data):
        z = min(a + SLICE, len(data))
        while z < len(data) and data[z] not in b" \t\n\x0b\x0c\r":
            z += 1
        out.append(word_hashes(data[a:z])[0])
        a = z
    return np.concatenate(out) if out else np.zeros(0, "u8")


def _shingled(w: np.ndarray) -> np.ndarray:
    x = np.zeros(len(w) - WORDS + 1, "u8")
    for j in range(WORDS):
        x = x * _C + w[j : j + len(x)]
    return _mix(x)


def _short(w: np.ndarray) -> np.ndarray:
    x = np.uint64(len(w))
    with np.errstate(over="ignore"):
        for y in w:
            x = x * _C + y
    return _mix(np.array([x], "u8") ^ np.uint64(0xA5A5A5A5A5A5A5A5))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Of each text: its distinct 5-word shingles as sorted 64-bit hashes; fewer words: the whole sequence as one; none: empty."""
    out: list[np.ndarray] = [np.zeros(0, "u8")] * len(texts)
    group: list[int] = []
    parts: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal group, parts, size
        if group:
            edge = np.cumsum([0] + [len(p) + 1 for p in parts])
            w, starts = word_hashes(b"\n".join(parts))
            at = np.searchsorted(starts, edge)
            all_ = _shingled(w) if len(w) >= WORDS else None
            for i, a, z in zip(group, at[:-1], at[1:], strict=True):
                if z - a >= WORDS:
                    out[i] = np.unique(all_[a : z - WORDS + 1])
                elif z > a:
                    out[i] = _short(w[a:z])
        group, parts, size = [], [], 0

    for i, text in enumerate(texts):
        if not text:
            continue
        data = text.encode("utf-8", "surrogatepass")
        if len(data) > SLICE:
            w = _words(text)
            if len(w):
                out[i] = np.unique(_shingled(w)) if len(w) >= WORDS else _short(w)
            continue
        if size + len(data) > SLICE:
            flush()
        group.append(i)
        parts.append(data)
        size += len(data) + 1
    flush()
    return out
