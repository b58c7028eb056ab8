"""Signature trees over small token bitmaps, and their dual traversal."""

from __future__ import annotations

import numpy as np

FAN = (2, 8, 8, 8)  # documents in a leaf node, then nodes in a node


class SignatureTree:
    """Levels of nodes over documents sorted by component and size. A node holds the OR of its documents' bitmaps, their least and largest size,
    the most tokens that any of them lost to collisions in its bitmap, and their component where all share one (else -1)."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> None:
        # By component first, since nodes of one component are left as a whole.
        self.order = np.lexsort((sizes, labels))
        bits, sizes, labels = bits[self.order], sizes[self.order], labels[self.order]
        lost = sizes - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, lost, labels)]
        self.fans: list[int] = []
        for fan in FAN:
            b, low, high, lost, own = self.levels[-1]
            if len(b) <= fan:
                break
            at = np.arange(0, len(b), fan)
            least, most = np.minimum.reduceat(own, at), np.maximum.reduceat(own, at)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(lost, at), np.where(least == most, least, -1)))
            self.fans.append(fan)

    def like(self, bits: np.ndarray, size: int, jaccard: float) -> np.ndarray:
        """Indices of all documents whose overlap with one more document could reach the Jaccard similarity: the traversal of this tree and that of a single leaf."""
        share, lost = jaccard / (1 + jaccard), size - int(np.bitwise_count(bits).sum(dtype=np.int64))
        at = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            b, low, high, gone, _ = self.levels[level]
            need = share * (low[at] + size) - 1e-9
            most = np.bitwise_count(b[at] & bits).sum(1, dtype=np.int64) + np.minimum(gone[at], lost)
            at = at[(np.minimum(high[at], size) >= need) & (most >= need)]
            if level:
                fan = self.fans[level - 1]
                at = (at[:, None] * fan + np.arange(fan)).ravel()
                at = at[at < len(self.levels[level - 1][0])]
        return self.order[at]

    def pairs(self, jaccard: float) -> tuple[np.ndarray, np.ndarray]:
        """Indices (i, j) of all documents of different components whose overlap could reach the Jaccard similarity."""
        return self.near(jaccard)[:2]

    def near(self, jaccard: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices (i, j) of all documents of different components whose overlap could reach the Jaccard similarity, and the largest that their overlap can be.

        Two nodes' documents share at most as many tokens as their bitmaps share bits, and those lost to
        collisions on one side; and no more than the smaller size. A pair of nodes below the overlap that their
        least sizes need, or within one component, is left with all below it.
        """
        share = jaccard / (1 + jaccard)
        top = len(self.levels) - 1
        i, j = np.triu_indices(len(self.levels[top][0]), k=0 if top else 1)
        for level in range(top, -1, -1):
            keep_i, keep_j, keep_most = [], [], []
            b, low, high, lost, own = self.levels[level]
            for at in range(0, len(i), 1 << 16):
                x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                need = share * (low[x] + low[y]) - 1e-9
                ok = (np.minimum(high[x], high[y]) >= need) & ~((own[x] == own[y]) & (own[x] >= 0))
                x, y, need = x[ok], y[ok], need[ok]
                most = np.bitwise_count(b[x] & b[y]).sum(1, dtype=np.int64) + np.minimum(lost[x], lost[y])
                ok = most >= need
                keep_i.append(x[ok])
                keep_j.append(y[ok])
                keep_most.append(most[ok])
            i, j, overlap = (np.concatenate(keep_i), np.concatenate(keep_j), np.concatenate(keep_most)) if keep_i else (i, j, np.zeros(0, np.int64))
            if level:
                fan, n = self.fans[level - 1], len(self.levels[level - 1][0])
                di, dj = (d.ravel() for d in np.meshgrid(np.arange(fan), np.arange(fan), indexing="ij"))
                ci, cj = (i[:, None] * fan + di).ravel(), (j[:, None] * fan + dj).ravel()
                ok = (ci < n) & (cj < n) & ((ci < cj) if level == 1 else (ci <= cj))
                i, j = ci[ok], cj[ok]
        return self.order[i], self.order[j], overlap
