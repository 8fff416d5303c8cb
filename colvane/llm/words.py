"""Words and shingles of texts as 64-bit hashes: words are [^\\x20\\x09-\\x0D]+, A-Z lower-cased."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from colvane.llm.common import CACHES, mixed, only
from colvane.llm.tokens import CACHE


class Hashes(dict):
    """Word -> hash, with a bound on what is held."""

    def __missing__(self, w: str) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


HASHES = Hashes()
CACHES["words"] = HASHES


def word_hashes(docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, document of each word)."""
    only("words")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(docs, pa.large_string())))
    coded = pc.dictionary_encode(lists.values)
    codes, words = np.asarray(coded.indices, dtype=np.int64), coded.dictionary.to_pylist()
    doc = np.repeat(np.arange(len(docs)), np.diff(np.asarray(lists.offsets, dtype=np.int64)))
    if "" in words:
        kept = codes != words.index("")
        codes, doc = codes[kept], doc[kept]
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))[codes], doc


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by its first word's place; the last k - 1 places have none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = mixed(h[:n], k)
    with np.errstate(over="ignore"):
        for i in range(1, k):
            g = mixed(g * np.uint64(3) ^ h[i : i + n], k)
    return g


def shingle_sets(docs: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each document, offsets). With fewer than k words the whole sequence is the one shingle."""
    h, doc = word_hashes(docs)
    g = gram_hashes(h, k)
    inside = doc[: len(g)] == doc[k - 1 :] if len(g) else np.zeros(0, bool)
    g, own = g[inside], doc[: len(inside)][inside]
    n = np.bincount(doc, minlength=len(docs))
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        starts = np.cumsum(n) - n
        whole = np.array([np.bitwise_xor.reduce(mixed(h[starts[i] : starts[i] + n[i]] + np.arange(n[i], dtype=np.uint64), 77)) for i in short], np.uint64)
        g, own = np.concatenate([g, mixed(whole, 78)]), np.concatenate([own, short])
    order = np.lexsort((g, own))
    g, own = g[order], own[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (own[1:] != own[:-1])
    g, own = g[first], own[first]
    return g, np.searchsorted(own, np.arange(len(docs) + 1))
