"""Words and word shingles of texts as 64-bit hashes, in numpy.

Words are `[^\\x20\\x09-\\x0D]+` of the UTF-8 text. A word's hash is a polynomial of its bytes modulo 2^64,
mixed; a shingle's that of its words' hashes. Texts are worked through in stretches that end at white
space, so a long text needs no more memory than a few times a stretch besides its own hashes.
"""

from __future__ import annotations

import numpy as np

STRETCH = 2 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower case for A-Z alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            factors = np.full(max(n, 256), _BASE, dtype=np.uint64)
            factors[0] = 1
            _POWERS = np.multiply.accumulate(factors)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _stretch(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(data, dtype=np.uint8)
    word = np.flatnonzero(~_SPACE[a])
    if not len(word):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    first = np.flatnonzero(np.diff(word, prepend=-2) != 1)
    length = np.diff(first, append=len(word))
    place = np.arange(len(word)) - np.repeat(first, length)
    value = (a[word].astype(np.uint64) + np.uint64(1)) * _powers(int(length.max()))[place]
    return mix(np.add.reduceat(value, first) + length.astype(np.uint64)), word[first]


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The hashes of each text's words, in order."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    pending, size = [], 0

    def run() -> None:
        nonlocal pending, size
        if not pending:
            return
        h, at = _stretch(b"\n".join(p for _, p in pending))
        ends = np.cumsum([len(p) + 1 for _, p in pending])
        cut = np.searchsorted(at, ends)
        for (k, _), lo, hi in zip(pending, [0, *cut[:-1].tolist()], cut.tolist(), strict=True):
            out[k].append(h[lo:hi])
        pending, size = [], 0

    for k, t in enumerate(texts):
        start = 0
        while len(t) - start > STRETCH:
            stop = start + STRETCH
            view = t[start:stop]
            space = max(view.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if space < 0:  # one word: up to its end
                behind = np.flatnonzero(_SPACE[np.frombuffer(t, dtype=np.uint8, offset=stop)])
                stop = stop + int(behind[0]) if len(behind) else len(t)
            else:
                stop = start + space + 1
            run()
            pending, size = [(k, t[start:stop])], stop - start
            run()
            start = stop
        pending.append((k, t[start:]))
        size += len(t) - start
        if size > STRETCH:
            run()
    run()
    return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words, in order; of fewer words the whole sequence as one, of none none."""
    n = len(words)
    if not n:
        return words
    m = max(1, n - k + 1)
    h = np.full(m, n if n < k else k, dtype=np.uint64)
    for i in range(min(k, n)):
        h = h * np.uint64(_BASE) + words[i : i + m]
    return mix(h)
