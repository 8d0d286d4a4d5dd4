"""Word-shingle sets of whole texts as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

from tessera.llm.words import mix, scan

_C = np.uint64(0xD6E8FEB86659FD93)


def shingles(texts: list, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each distinct k-word shingle, by row and hash.

    Words are runs without ASCII white space, A-Z lower-cased; a text of 1 to k-1 words is one
    shingle of all its words; one without words has none.
    """
    s = scan(texts)
    word = s.hash(s.start, s.end)
    n = len(word)
    rows, out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if n >= k:
        h = word[: n - k + 1].copy()
        for j in range(1, k):
            h = h * _C + word[j : n - k + 1 + j]
        whole = s.doc[: n - k + 1] == s.doc[k - 1 :]
        rows.append(s.doc[: n - k + 1][whole])
        out.append(mix(h[whole]))
    count = np.bincount(s.doc, minlength=len(texts))
    first = np.cumsum(count) - count
    for d in np.flatnonzero((count > 0) & (count < k)):
        h = np.uint64(int(count[d]))
        with np.errstate(over="ignore"):
            for w in word[first[d] : first[d] + count[d]]:
                h = h * _C + w
        rows.append(np.array([d], np.int64))
        out.append(mix(np.array([h], np.uint64) + np.uint64(1)))
    row, h = np.concatenate(rows), np.concatenate(out)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[keep], h[keep]
