"""BPE encoding with a pair occurrence index, and decoding.

The distinct pre-tokens of a batch lie in one array of symbols. An index maps each pair that has a merge to all its
positions there. Active ranks are applied in ascending order; a merge links its neighbours anew and adds the pairs that
arise to their lists.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from colvane.llm.common import rebatched, small_batches, texts
from colvane.llm.tokens import BYTE_CHARS, BYTE_PATTERN, CACHE, TextEncoder, TokenizerFile, simple

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PairIndexBpe:
    """Ids of chunks by byte-level BPE, written here; the library serves tests only."""

    def __init__(self, file: TokenizerFile):
        vocab = file.vocab
        merges = [x.split(" ") if isinstance(x, str) else x for x in file.merges]
        self.specials = file.specials
        self.pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.rank = {a << 20 | b: r for r, (a, b, _) in reversed(list(enumerate(self.pairs)))}
        self.byte_ids = [vocab[c] for c in BYTE_CHARS]
        back = {c: b for b, c in enumerate(BYTE_CHARS)}
        self.words: dict[str, bytes] = {}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for s, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
        for s, i in self.specials.items():
            self.bytes_of[i] = s.encode()

    def __call__(self, chunks: list[str]) -> list[bytes]:
        words = self.words
        if len(words) > CACHE:
            words.clear()
        cut = [[c] if c in self.specials else simple(c) or BYTE_PATTERN.findall(c) for c in chunks]
        new = sorted({w for ws in cut for w in ws if w not in words})
        for w in new:
            if w in self.specials:
                words[w] = np.array([self.specials[w]], "<u4").tobytes()
        new = [w for w in new if w not in words]
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            words.update(zip(part, self.encode(part), strict=True))
        get = words.__getitem__
        return [b"".join(map(get, ws)) for ws in cut]

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word, by one index over all of them."""
        raws = [w.encode() for w in words]
        byte_ids, rank, pairs = self.byte_ids, self.rank, self.pairs
        sym = [byte_ids[b] for b in b"".join(raws)]
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        ends, at = [], 0
        for r in raws:
            prv[at] = -1
            at += len(r)
            ends.append(at)
            nxt[at - 1] = -1
        index: dict[int, list[int]] = {}
        for i in range(n - 1):
            if nxt[i] >= 0 and (r := rank.get(sym[i] << 20 | sym[i + 1])) is not None:
                index.setdefault(r, []).append(i)
        active = list(index)
        heapify(active)
        while active:
            r = heappop(active)
            a, b, made = pairs[r]
            places = index.pop(r)
            if a == b:
                places.sort()
            for i in places:
                if sym[i] != a or (j := nxt[i]) < 0 or sym[j] != b:
                    continue
                sym[i], sym[j] = made, -1
                k = nxt[i] = nxt[j]
                if k >= 0:
                    prv[k] = i
                    if (s := rank.get(made << 20 | sym[k])) is not None:
                        if s in index:
                            index[s].append(i)
                        else:
                            index[s] = [i]
                            heappush(active, s)
                if (k := prv[i]) >= 0 and (s := rank.get(sym[k] << 20 | made)) is not None:
                    if s in index:
                        index[s].append(k)
                    else:
                        index[s] = [k]
                        heappush(active, s)
        out, first = [], 0
        all_ids = np.array(sym, np.int64)
        for e in ends:
            own = all_ids[first:e]
            out.append(own[own >= 0].astype("<u4").tobytes())
            first = e
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_MADE: dict[str, tuple[PairIndexBpe, TextEncoder]] = {}


def pair_index(path: str) -> tuple[PairIndexBpe, TextEncoder]:
    if path not in _MADE:
        file = TokenizerFile(path)
        if not file.keeps_space:
            raise ValueError("a byte-level file is needed")
        bpe = PairIndexBpe(file)
        _MADE[path] = bpe, TextEncoder(file, bpe)
    return _MADE[path]


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encodes and decodes every text: doc_id, n_tokens, and sha256 of the ids and of the decoded text.

    A null text is empty (no ids); null doc_ids and repeated rows stay; an empty table gives no rows; other columns are
    not read. One pass with no shuffle.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = pair_index(tokenizer_path)
        for t in rebatched(batches):
            flat, offsets = encoder.encode(texts(t))
            n, ids_sha, text_sha = [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                ids = flat[a:b]
                n.append(b - a)
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
