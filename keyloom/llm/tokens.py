"""Tokenizer files applied to whole texts inside Arrow batches.

Pre-tokenization never joins what stands on both sides of certain white space, so texts are cut there and each distinct
chunk is encoded once per worker; the ids of a text are the ids of its chunks in order."""

from __future__ import annotations

import os
import re
from array import array
from codecs import charmap_decode
from collections import defaultdict
from itertools import count, islice

import numpy as np
import regex

from ._shared import claim, ragged

CACHE = 800_000  # most chunks a worker remembers
PIECES = 250_000  # most pieces of chunks

# The pre-tokenization patterns of the two kinds of files.
_PIECES = {
    "byte": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "word": r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+",
}
# Characters for which lower case and normal forms are the same in all libraries.
_LATIN = re.compile("[\n\x20-\x7e\xa1-\u012f\u0131-\u017f]*")


def _spelling() -> str:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 up."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in shown]
    return "".join(chr(b if b in shown else 256 + others.index(b)) for b in range(256))


_SPELLING = _spelling()
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
# White space other than the blank and the line end.
_RARE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BESIDE = re.compile(r"(?:^|\s) | (?:\s|$)")


class Encoder:
    """Encodes texts with a tokenizers file. `style` says where chunks end:

    - "byte": before a single space between two non-space characters (byte-level files that keep white space);
    - "word": at spaces and line ends (files whose normalizer drops white space)."""

    def __init__(self, path: str, style: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # special tokens' strings in a text are ordinary text
        self.merge = self.tokenizer.model.tokenize
        self.pieces = regex.compile(_PIECES[style]).findall
        self.known: dict[str, bytes] = {}
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # chunks and pieces are remembered here
        self.kind = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.style = style
        self.forget()

    def forget(self):
        self.known.clear()
        self.index: dict = defaultdict(count().__next__)  # a chunk that is met for the first time takes the next number
        self.starts, self.sizes, self.ids, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, self.kind), 0

    def _split(self, chunk: str) -> list[str] | None:
        """The pre-tokenizer's pieces of a Latin chunk; None for others, which go through the whole tokenizer."""
        body = chunk[1:] if chunk[:1] == " " else chunk
        if not body.isascii():
            if not _LATIN.fullmatch(body) or "<|" in body:
                return None
        elif not body.isalpha() and (not (body.isprintable() or body.replace("\n", "").isprintable()) or "<|" in body):
            return None
        if self.style == "word":
            chunk = body = body.lower()
        if body.isalpha():
            return [chunk]
        return [chunk[:-1], chunk[-1]] if body[:-1].isalpha() else self.pieces(chunk)  # a word and one sign or digit

    def _merge(self, piece: str) -> bytes:
        """The ids of a new piece, from the file's merge model alone."""
        spelled = charmap_decode(piece.encode(), "strict", _SPELLING)[0]
        ids = self.known[piece] = array(self.kind.char, [t.id for t in self.merge(spelled)]).tobytes()
        return ids

    def _learn(self, keys: list):
        """Encodes chunks that have just been numbered, in order of their numbers."""
        if len(self.known) > PIECES:
            self.known.clear()
        blank = " " if self.style == "byte" else ""
        known, merge, split, whole = self.known, self._merge, self._split, self.tokenizer.encode
        found = []
        for k in keys:
            chunk = k[0] if k.__class__ is tuple else blank + k
            pieces = split(chunk)
            if pieces is None:
                found.append(np.array(whole(chunk, add_special_tokens=False).ids, self.kind).tobytes())
            elif len(pieces) == 1:
                found.append(known.get(pieces[0]) or merge(pieces[0]))
            else:
                found.append(b"".join([known.get(p) or merge(p) for p in pieces]))
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // self.kind.itemsize
        flat = np.frombuffer(b"".join(found), self.kind)
        n = len(self.index)
        while n > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.sizes[n - len(keys) : n] = sizes
        self.starts[n - len(keys) : n] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def _keys(self, text: str) -> list:
        """A text's chunks; those of "byte" files are kept without their leading space, and the first as a tuple."""
        if self.style == "word":
            return text.replace("\n", " ").split(" ")
        if not text:
            return []
        odd = text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or (_RARE.search(text) and _BESIDE.search(text))
        parts = _BETWEEN.split(text) if odd else text.split(" ")
        parts[0] = (parts[0],)
        return parts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other (unsigned 16 or 32 bits), and each text's number of ids."""
        if len(self.index) > CACHE:
            self.forget()
        every: list = []
        counts = []
        for t in texts:
            keys = self._keys(t)
            counts.append(len(keys))
            every += keys
        before = len(self.index)
        at = np.fromiter(map(self.index.__getitem__, every), np.int64, len(every))
        if new := len(self.index) - before:
            self._learn(list(islice(reversed(self.index), new))[::-1])
        sizes = self.sizes[at].astype(np.int64)
        ids = self.ids[ragged(self.starts[at], sizes)]
        edges = np.concatenate(([0], np.cumsum(sizes)))
        ends = edges[np.cumsum(np.array(counts, np.int64))] if counts else np.empty(0, np.int64)
        return ids, np.diff(ends, prepend=0)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, style: str) -> Encoder:
    """One encoder per worker process and file."""
    if (path, style) not in _encoders:
        _encoders[path, style] = Encoder(path, style)
    found = _encoders[path, style]
    claim(f"tokens {path}", found.forget)
    return found


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
