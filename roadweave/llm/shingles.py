"""Hashed sets of word shingles of whole texts, vectorised over a batch of texts."""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 18  # bytes hashed at a time, each of which takes several 64-bit numbers
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FOLDED = np.arange(256, dtype=np.uint64)
_FOLDED[65:91] += np.uint64(32)
_BYTES = mixed(_FOLDED * np.uint64(0x5851F42D4C957F2D) + np.uint64(0x14057B7EF767814F))
_PLACES = mixed(np.arange(1, 64, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up, self.down


_powers = _Powers()


def word_hashes(data: bytes, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A hash, folding A-Z, and the first byte's place of each run between bytes of `space`; worked in pieces of about _PIECE bytes cut there."""
    raw = np.frombuffer(data, np.uint8)
    hashes, places, at = [], [], 0
    while at < len(raw):
        end = min(at + _PIECE, len(raw))
        if end < len(raw):
            ahead = space[raw[end : end + 4096]]
            if not ahead.any():
                ahead = space[raw[end:]]
            end = end + int(ahead.argmax()) if ahead.any() else len(raw)
        b = raw[at:end]
        edge = np.diff(np.concatenate([[0], (~space[b]).astype(np.int8), [0]]))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(s):
            up, down = _powers.get(len(b) + 1)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[b] * up[: len(b)])])
            hashes.append(mixed((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
            places.append(s + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(places)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def shingle_sets(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles of `size` words; with fewer words the whole sequence is one, without words there is none."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    hashes, places = word_hashes(b"\n".join(raw))
    bounds = np.searchsorted(places, np.cumsum([0] + [len(r) + 1 for r in raw])).tolist()
    n = len(hashes) - size + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        rolled += hashes[k : k + n] * _PLACES[k]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            out.append(mixed((hashes[a:b] * _PLACES[: b - a]).sum(keepdims=True) + np.uint64((0xD6E8FEB86659FD93 * (b - a)) & _MASK)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
