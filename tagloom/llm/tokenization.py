"""Token ids of whole texts, by a public tokenizer file and the tokenizers library.

The library encodes a text piece by piece: a pattern cuts the text, and each
piece's ids depend on the piece alone.  So pieces are encoded by the library once
per worker and kept in a table of bounded size, and a text's ids are the pieces'
ids in order.  As no piece goes on after white space, whole stretches between
blanks are kept too, so that the pattern is only run on new ones.  Texts with code
points for which the pattern could be read in another way here than in the
library, with white space that a piece may share, or with a special token's
string, are cut whole or go to the library.  Stretches are known by their bytes, not
by a hash of them alone.  Either way the ids are the library's.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import regex

from .common import utf8
from .textstats import LONGS, SHORT, Words, folded, packed

#: The two patterns as the tokenizer files state them (fixed values).
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Code points on whose classes all agree.
_ODD = re.compile("[^\t\n\r -~\u00a1-\u024f\u0370-\u03ff\u0400-\u052f\u2010-\u2027\u20a0-\u20bf]")
#: White space that holds two blanks, which byte-level pieces may share.
_WIDE = re.compile(r" [\t\n\r]+ |  | $")


_SHARED: dict[tuple[str, int], PieceEncoder] = {}


def shared(path: str, most: int) -> PieceEncoder:
    """One encoder for all tasks of a worker, so that its tables serve them all."""
    return _SHARED.setdefault((path, most), PieceEncoder(path, most))


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ",.!?;:"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 13]] = True


class Segments(Words):
    """Stretches of texts that no piece crosses, packed.

    White space (byte level: blanks) bounds them; so does a sign after a letter at
    their end; and, at byte level, a line end between two other characters, which
    is a stretch of its own.  bare: no blank stands before the stretch.
    """

    def __init__(self, texts: list[str], byte_level: bool):
        self.raw, self.offsets = utf8(pa.array(texts, pa.large_string()))
        raw, n = self.raw, len(self.raw)
        head = np.zeros(n + 1, bool)
        head[self.offsets] = True
        blank = _BLANK[raw]
        solid = raw != 32 if byte_level else ~blank
        # a sign that ends its stretch and follows a letter
        last = np.ones(n, bool)
        last[:-1] = blank[1:] | head[1:n]
        sign = np.zeros(n, bool)
        sign[1:] = _MARK[raw[1:]] & _LETTER[raw[:-1]] & last[1:] & ~head[1:n]
        cut = head.copy()
        cut[:n] |= sign
        if byte_level:
            line = np.zeros(n, bool)
            line[1:-1] = (raw[1:-1] == 10) & ~blank[:-2] & ~blank[2:] & ~head[1 : n - 1] & ~head[2:n]
            cut[:n] |= line
            cut[1:] |= line
        self._bounded(solid, cut)
        self.bare = np.ones(len(self.start), bool)
        inner = self.start > 0
        self.bare[inner] = (raw[self.start[inner] - 1] != 32) | head[self.start[inner]]
        self.longs = packed(raw, self.start, self.end)
        if byte_level:
            self.longs[-1] |= self.bare.astype(np.uint64) << np.uint64(63)

    def bytes_of(self, which: np.ndarray) -> list[bytes]:
        raw = self.raw.tobytes()
        return [raw[a:b] for a, b in zip(self.start[which].tolist(), self.end[which].tolist(), strict=True)]


class Stretches:
    """ids of stretches of text: short ones by their packed bytes in sorted arrays, some forty bytes for each; longer ones by their bytes."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.hash, self.longs = np.zeros(0, np.uint64), [np.zeros(0, np.uint64)] * LONGS
        self.start, self.size, self.pool = np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, "<u2")
        self.long: dict[bytes, tuple[int, int]] = {}

    def __len__(self) -> int:
        return len(self.hash) + len(self.long)

    def find(self, h: np.ndarray, longs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places of sorted hashes, and whether those very stretches are there."""
        at = np.minimum(np.searchsorted(self.hash, h), max(len(self.hash) - 1, 0))
        if not len(self.hash):
            return at, np.zeros(len(h), bool)
        known = self.hash[at] == h
        for mine, x in zip(self.longs, longs, strict=True):
            known &= mine[at] == x
        return at, known

    def _pooled(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        start = len(self.pool) + np.concatenate([[0], np.cumsum(size)[:-1]])
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), "<u2")])
        return start, size

    def add(self, h: np.ndarray, longs: list[np.ndarray], ids: list[bytes]) -> None:
        """New short entries by sorted hashes; one whose hash another stretch has takes its place."""
        start, size = self._pooled(ids)
        at = np.searchsorted(self.hash, h)
        taken = np.zeros(len(h), bool)
        if len(self.hash):
            taken = self.hash[np.minimum(at, len(self.hash) - 1)] == h
        for name, fresh in (("start", start), ("size", size)):
            held = getattr(self, name)
            held[at[taken]] = fresh[taken]
            setattr(self, name, np.insert(held, at[~taken], fresh[~taken].astype(np.uint32)))
        for k, x in enumerate(longs):
            self.longs[k][at[taken]] = x[taken]
            self.longs[k] = np.insert(self.longs[k], at[~taken], x[~taken])
        self.hash = np.insert(self.hash, at[~taken], h[~taken])

    def add_long(self, names: list[bytes], ids: list[bytes]) -> None:
        self.long.update(zip(names, zip(*(x.tolist() for x in self._pooled(ids)), strict=True), strict=True))


class PieceEncoder:
    """ids of texts as little-endian unsigned 16-bit integers.

    path: a tokenizer file with at most 65536 ids.  most: entries of the table of
    pieces; that of stretches, which are smaller, has ten times as many.
    """

    def __init__(self, path: str, most: int = 150_000):
        self.path, self.most = path, most
        self._tokenizer = None

    def __reduce__(self):
        return shared, (self.path, self.most)

    @property
    def tokenizer(self):
        if self._tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
            if self._tokenizer.get_vocab_size() > 1 << 16:
                raise ValueError("ids don't fit into 16 bits")
            self._normalizer = self._tokenizer.normalizer
            self._bytes = self._normalizer is None
            self._find = regex.compile(BYTE_LEVEL if self._bytes else WORD_LEVEL).findall
            self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
            self._pieces: dict[str, bytes] = {}
            self._stretches = Stretches(10 * self.most)
        return self._tokenizer

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u2").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces_of(self, text: str) -> list[str]:
        """The pattern's pieces; letters with at most one other code point at the end need no pattern."""
        blank = self._bytes and text[:1] == " "
        body = text[1:] if blank else text
        if body.isalpha():
            return [text]
        if body[:-1].isalpha():
            return [text[:-1], text[-1]]
        return self._find(text)

    def _cut(self, texts: list[str]) -> list[bytes]:
        """ids of texts by their pieces; pieces not seen before are encoded in one call."""
        cut = list(map(self._pieces_of, texts))
        every = set().union(*cut)
        fresh = list(every.difference(self._pieces))
        if len(self._pieces) + len(fresh) > self.most:
            self._pieces = {p: self._pieces[p] for p in every if p in self._pieces}  # keeps what is frequent
        if fresh:
            found = self.tokenizer.encode(fresh, is_pretokenized=True, add_special_tokens=False)
            raw = np.array(found.ids, dtype="<u2").tobytes()
            ends = (2 * np.searchsorted(np.array(found.word_ids, dtype=np.int64), np.arange(len(fresh) + 1))).tolist()
            self._pieces.update(zip(fresh, (raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)), strict=True))
        known = self._pieces.__getitem__
        return [b"".join(map(known, pieces)) for pieces in cut]

    def _named(self, raw: list[bytes], bare: list[bool]) -> list[str]:
        return [x.decode() if b else " " + x.decode() for x, b in zip(raw, bare, strict=True)] if self._bytes else [x.decode() for x in raw]

    def _cut_all(self, names: list[str]) -> list[bytes]:
        return [ids for i in range(0, len(names), 20_000) for ids in self._cut(names[i : i + 20_000])]

    def _by_stretches(self, texts: list[str]) -> list[bytes]:
        """ids of texts whose stretches between blanks (byte level) or white space can be encoded one by one."""
        w = Segments(texts, self._bytes)
        table = self._stretches
        long = w.end - w.start > SHORT
        short = np.flatnonzero(~long)
        key, first, back = np.unique(folded([x[short] for x in w.longs]), return_index=True, return_inverse=True)
        first = short[first]
        longs = [x[first] for x in w.longs]
        same = np.ones(len(short), bool)  # two stretches with one hash: only the first is looked up by it
        for x, mine in zip(w.longs, longs, strict=True):
            same &= x[short] == mine[back]
        at, known = table.find(key, longs)
        far, other = np.flatnonzero(long), short[~same]
        spelt = np.concatenate([far, other])
        names = [x + (b"\x01" if b else b"\x00") for x, b in zip(w.bytes_of(spelt), w.bare[spelt].tolist(), strict=True)] if len(spelt) else []
        fresh = list(set(names).difference(table.long))
        if len(table) + np.count_nonzero(~known) + len(fresh) > table.most:
            table.clear()
            known[:], fresh = False, list(set(names))
        if not known.all():
            new = first[~known]
            table.add(key[~known], [x[~known] for x in longs], self._cut_all(self._named(w.bytes_of(new), w.bare[new].tolist())))
            at, known = table.find(key, longs)
        if fresh:
            table.add_long(fresh, self._cut_all(self._named([x[:-1] for x in fresh], [x[-1:] == b"\x01" for x in fresh])))
        begin, many = np.zeros(len(w.start), np.int64), np.zeros(len(w.start), np.int64)
        begin[short], many[short] = table.start[at].astype(np.int64)[back], table.size[at].astype(np.int64)[back]
        for i, name in zip(spelt.tolist(), names, strict=True):
            begin[i], many[i] = table.long[name]
        upto = np.cumsum(many)
        total = int(upto[-1]) if len(upto) else 0
        flat = table.pool[np.repeat(begin - (upto - many), many) + np.arange(total)].tobytes()
        stop = (2 * np.concatenate([[0], upto])[w.first]).tolist()
        return [flat[a:b] for a, b in zip(stop[:-1], stop[1:], strict=True)]

    def _lower(self, text: str) -> str:
        """As the tokenizer's normalizer does it, but for runs of white space."""
        if text.isascii():
            return text.lower()
        if "\u03a3" in text or not unicodedata.is_normalized("NFC", text):
            return self._normalizer.normalize_str(text)
        return text.lower()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        _ = self.tokenizer  # loads what is used below
        out: list[bytes | None] = [None] * len(texts)
        odd, cut, plain = [], [], []
        for i, text in enumerate(texts):
            text = text or ""
            if _ODD.search(text) or any(s in text for s in self._special):
                odd.append((i, text))
            elif not self._bytes:
                plain.append((i, self._lower(text)))
            elif _WIDE.search(text):
                cut.append((i, text))
            else:
                plain.append((i, text))
        for rows, how in ((plain, self._by_stretches), (cut, self._cut), (odd, self._whole)):
            if rows:
                for (i, _), ids in zip(rows, how([t for _, t in rows]), strict=True):
                    out[i] = ids
        return out


def crc_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
