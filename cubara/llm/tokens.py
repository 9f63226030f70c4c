"""Whole texts to token ids with a public tokenizer, through a cache of words.

The vocabularies' pre-tokenizers cut a text into words, numbers, marks and white
space before the merges of byte pairs, which then see one such part at a time.
No part spans the start of white space, so a text is split there. A piece that is
one part has its ids in the cache or gets them from the tokenizer's own model;
another one is cut into parts here if its characters are of known classes (ASCII
and Latin letters). Pieces with other characters go through the whole tokenizer,
as does a text that holds the string of an added token.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts that a worker remembers, about 200 bytes each.
PARTS_KEPT = 300_000
#: Longer ones aren't kept.
_LONG = 48
_LETTER, _SPACE = "a-zA-ZÀ-ÖØ-öø-įı-ɏ", " \t-\r"
_OTHER = re.compile(f"[^\x00-\x7f{_LETTER}]")
#: White space in Python's eyes only.
_ODD = "\x1c\x1d\x1e\x1f"
_PIECES = re.compile(r"\s*\S+|\s+\Z")
_CUTS = "'s|'t|'re|'ve|'m|'ll|'d"
#: The two public pre-tokenizers' patterns, over the known classes.
_DROP_SPACE = re.compile(f"{_CUTS}|[{_LETTER}]+|[0-9]|[^{_SPACE}{_LETTER}0-9]+")
_KEEP_SPACE = re.compile(f"{_CUTS}| ?[{_LETTER}]+| ?[0-9]+| ?[^{_SPACE}{_LETTER}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: A word, which is one part by either pattern.
_WORD = re.compile(f" ?[{_LETTER}]+").fullmatch
_PLAIN = re.compile("[!-~]+").fullmatch


def _byte_letters() -> list[str]:
    """How byte-level vocabularies write each byte: printable Latin-1 as itself, the others in order from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256))
    return [chr(b) if b in shown else chr(256 + next(hidden)) for b in range(256)]


class Encoder(dict):
    """A tokenizer with the ids of the parts seen so far; ids are little-endian unsigned 32-bit bytes (array's own order: every platform of Spark's is little-endian).

    As by the library's default, the strings of added tokens in a text become
    these tokens; with plain=True they are ordinary text.
    """

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.model, self.letters = self.tokenizer.model, dict(enumerate(_byte_letters()))
        # The steps alone are asked for: the whole tokenizer as JSON would take more memory than the cache.
        steps, norm = (json.loads(x.__getstate__()) if x else None for x in (self.tokenizer.pre_tokenizer, self.tokenizer.normalizer))
        kinds = [x["type"] for x in (steps or {}).get("pretokenizers", [steps] if steps else [])]
        norms = [x["type"] for x in (norm or {}).get("normalizers", [norm] if norm else [])]
        self.kind = {(("ByteLevel",), ()): "keep", (("Split", "ByteLevel"), ("NFC", "Replace", "Lowercase")): "drop"}.get((tuple(kinds), tuple(norms)))
        # A token of ASCII marks can't come about by normalisation but for its case.
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values() if not (plain and x.special)]
        self.added = re.compile("|".join(map(re.escape, added)), re.I).search if added else lambda text: None
        if not all(x.isascii() for x in added):
            self.kind = None
        gc.set_threshold(500_000, 50, 50)  # texts and tokens make no cycles; the cache needn't be walked again and again

    def __missing__(self, piece: str) -> bytes:
        """A part's ids are kept; those of a piece of several parts are put together each time."""
        if not piece:
            return b""
        if piece[-1] in ".,;:!?" and piece[-2:-1].isalnum():  # a mark alone behind a letter or digit is a part of its own
            return self[piece[:-1]] + self[piece[-1]]
        if not _WORD(piece):
            if _OTHER.search(piece):
                return self.whole(piece)
            parts = _DROP_SPACE.findall(piece.lower()) if self.kind == "drop" else _KEEP_SPACE.findall(piece)
            if len(parts) != 1:
                return b"".join([self[p] for p in parts])
        if self.kind == "drop" and (low := piece.lower()) != piece:
            return self[low]
        if _PLAIN(piece):
            letters = piece
        elif piece[0] == " " and _PLAIN(piece[1:]):
            letters = "Ġ" + piece[1:]  # how a space is written
        else:
            letters = piece.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        if len(piece) <= _LONG:
            if len(self) >= PARTS_KEPT:
                self.clear()
            self[piece] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _odd(self, text: str) -> bool:
        """Whether pieces that begin with at most one space don't say it all."""
        if self.kind is None or any(c in text for c in _ODD) or self.added(text):
            return True
        if self.kind == "drop":
            return False
        # A space beside other white space isn't simply the start of what follows.
        beside = "  " in text or any(c in text and (c + " " in text or " " + c in text) for c in "\n\t\r\v\f")
        return beside or "\0" in text or text[0].isspace() or text[-1].isspace()

    def encode(self, text: str | None) -> bytes:
        """The text's ids as bytes; null and empty texts have none."""
        if not text:
            return b""
        if self.kind is None or any(c in text for c in _ODD) or self.added(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split() if self.kind == "drop" else _PIECES.findall(text)))

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """encode() of each text of a string array: most are cut into pieces together, and each different piece is looked up once."""
        found = [x or "" for x in texts.to_pylist()]
        alone = [not x or self._odd(x) for x in found]
        out = [self.encode(x) if a else b"" for x, a in zip(found, alone)]
        others = texts.filter(pa.array([not a for a in alone]))
        if not len(others):
            return out
        cut = pc.utf8_split_whitespace(others) if self.kind == "drop" else pc.split_pattern(pc.replace_substring(others, " ", "\0 "), "\0")
        pieces = cut.flatten().dictionary_encode()
        known = list(map(self.__getitem__, pieces.dictionary.to_numpy(zero_copy_only=False)))
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(known), "<u4")
        at = pieces.indices.to_numpy()
        n = sizes[at]
        ends = np.cumsum(n)
        ids = flat[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        places = np.concatenate(([0], ends))[np.asarray(cut.offsets) - cut.offsets[0].as_py()].tolist()
        each = (ids[a:z].tobytes() for a, z in zip(places, places[1:]))
        return [x if a else next(each) for x, a in zip(out, alone)]


@lru_cache(1)
def encoder(path: str, plain: bool = False) -> Encoder:
    """The worker's own encoder: what one task has learnt serves the next."""
    return Encoder(path, plain)
