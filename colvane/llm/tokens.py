"""Exact ids of a tokenizer file, made from each distinct chunk of a batch once.

A text falls into chunks at places where no token can cross: before a space that follows or precedes a character
that isn't white space (byte-level files), or at all white space (files that drop it). Each distinct chunk of a
batch is encoded once and the ids of all texts are then gathered with numpy.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from colvane.llm.common import CACHES, only, ragged

#: White space as the files' patterns mean it.
WS = "\t-\r \x85\xa0  -     　"
#: Entries of a cache before it is emptied.
CACHE = 250_000
#: Chunks of these characters are cut here; any other goes to the library whole.
PLAIN = re.compile("[\t-\r\x20-\x7e\xa1-įı-ɏ]*")
#: Marks that are a pre-token of their own behind a word.
MARKS = ".,;:!?"
#: The pre-token patterns of the two public files.
BYTE_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level files."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


BYTE_CHARS = byte_characters()
SPACE = BYTE_CHARS[32]


def as_byte_characters(s: str) -> str:
    if s.isascii() and s[0] == " " and s[1:].isalnum():
        return SPACE + s[1:]
    return s if s.isascii() and s.isalnum() else "".join([BYTE_CHARS[b] for b in s.encode()])


def simple(chunk: str) -> list[str] | None:
    """Pre-tokens of an ASCII word, with or without a space before it and a mark behind; None for any other chunk."""
    if chunk.isascii():
        word = chunk[1:] if chunk[:1] == " " else chunk
        if word.isalpha():
            return [chunk]
        if word[-1:] in MARKS and word[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
    return None


class TokenizerFile:
    """What the two kinds of tokenizer file need; `keeps_space` tells them apart."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.keeps_space = spec["pre_tokenizer"]["type"] == "ByteLevel"
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.vocab, self.merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()


class LibraryChunks:
    """Ids of chunks by the tokenizers library: its BPE model on pre-tokens of plain chunks, its whole encoder on others."""

    def __init__(self, file: TokenizerFile):
        self.file, self.model, self.cache, self.pre = file, file.library.model, {}, {}

    def __call__(self, chunks: list[str]) -> list[bytes]:
        cache = self.cache
        if len(cache) > 2 * CACHE:
            cache.clear()
            self.pre.clear()
        out = list(map(cache.get, chunks))
        for i in [i for i, x in enumerate(out) if x is None]:
            out[i] = cache[chunks[i]] = self.encode(chunks[i])
        return out

    def encode(self, chunk: str) -> bytes:
        file = self.file
        if chunk in file.specials:
            return np.array([file.specials[chunk]], "<u4").tobytes()
        words = simple(chunk)
        if words is not None:
            words = words if file.keeps_space else [w.lower() for w in words]
        else:
            if not PLAIN.fullmatch(chunk):
                return np.array(file.library.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
            words = BYTE_PATTERN.findall(chunk) if file.keeps_space else WORD_PATTERN.findall(chunk.lower())
        out = []
        for w in words:
            got = self.pre.get(w)
            if got is None:
                got = self.pre[w] = array("I", [t.id for t in self.model.tokenize(as_byte_characters(w))]).tobytes()
            out.append(got)
        return b"".join(out)


class TextEncoder:
    """encode(texts) -> (ids of all texts, offsets); `chunk_ids` makes the ids of distinct chunks."""

    def __init__(self, file: TokenizerFile, chunk_ids: Callable[[list[str]], list[bytes]]):
        self.file, self.chunk_ids = file, chunk_ids
        self.special = re.compile("(" + "|".join(map(re.escape, file.specials)) + ")") if file.specials else None
        odd = f"[{WS}] ([{WS}]|$)" if file.keeps_space else "[\x1c-\x1f\x85\xa0  -     　]"
        self.odd = re.compile(odd)
        self.units = re.compile(f"[{WS}]*[^{WS}]+|[{WS}]+" if file.keeps_space else f"[^{WS}]+")

    def cut(self, text: str) -> list[str]:
        """Chunks of any text, with their own white space."""
        if self.special is None or "<|" not in text:
            return self.units.findall(text)
        out = []
        for part in self.special.split(text):
            out += [part] if part in self.file.specials else self.units.findall(part)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = self.odd.search
        slow = [i for i, t in enumerate(texts) if "<|" in t or odd(t)]
        fast = texts
        if slow:
            fast = list(texts)
            for i in slow:
                fast[i] = ""
        arr = pa.array(fast, pa.large_string())
        lists = pc.split_pattern(arr, " ") if self.file.keeps_space else pc.ascii_split_whitespace(arr)
        offsets = np.asarray(lists.offsets, dtype=np.int64)
        coded = pc.dictionary_encode(lists.values)
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        codes = np.asarray(coded.indices, dtype=np.int64)
        distinct = coded.dictionary.to_pylist()
        offsets, codes = offsets - offsets[0], codes[offsets[0] : offsets[-1]]
        if self.file.keeps_space:
            distinct = [" " + x for x in distinct]
            extra: dict[str, int] = {}
            for i, t in enumerate(fast):  # a text's first chunk has no space before it
                codes[offsets[i]] = len(distinct) + extra.setdefault(t.partition(" ")[0], len(extra))
            distinct += list(extra)
        n = np.diff(offsets)
        if slow:
            extra, own = {}, {}
            for i in slow:
                own[i] = np.array([extra.setdefault(u, len(extra)) for u in self.cut(texts[i])], np.int64) + len(distinct)
            parts, at = [], 0
            for i in slow:
                parts += [codes[at : offsets[i]], own[i]]
                at, n[i] = offsets[i + 1], len(own[i])
            codes = np.concatenate([*parts, codes[at:]])
            distinct += list(extra)
        made = self.chunk_ids(distinct)
        size = np.fromiter(map(len, made), np.int64, len(made)) // 4
        ids = np.frombuffer(b"".join(made), "<u4")
        starts = np.cumsum(size) - size
        lengths = size[codes]
        flat = ids[ragged(starts[codes], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return flat, ends[np.concatenate([[0], np.cumsum(n)])]


_ENCODERS: dict[str, TextEncoder] = {}
CACHES["encoders"] = _ENCODERS


def library_encoder(path: str) -> TextEncoder:
    """One encoder, with its cache, per worker process."""
    only("encoders")
    if path not in _ENCODERS:
        file = TokenizerFile(path)
        _ENCODERS[path] = TextEncoder(file, LibraryChunks(file))
    return _ENCODERS[path]


def with_end(flat: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends end_id to each text's ids."""
    n = len(offsets) - 1
    out = np.empty(len(flat) + n, np.dtype("<u4"))
    ends = offsets[1:] + np.arange(n)
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[ends] = end_id
    out[mask] = flat
    return out, offsets + np.arange(n + 1)
