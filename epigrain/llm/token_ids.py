"""Token ids of whole texts by a public tokenizer, one distinct piece of text at a time.

A tokenizer of the byte-pair kind treats the pieces between its word boundaries independently, so a text's ids are the ids of
its pieces in order. Texts are cut only where a boundary is certain: at a single space or line feed between two characters
that are not white space. Each distinct piece is encoded once per worker and kept in a bounded table; a word with marks after it is the
ids of the word and those of the marks, which byte-pair tokenizers always part.
"""

from __future__ import annotations

import json
import re
from itertools import accumulate, chain, pairwise

import numpy as np

from .shared import worker_cache

#: Pieces kept per worker, and the longest piece that is kept.
KEPT_PIECES = 800_000
LONGEST_KEPT = 48

#: White space other than the space and the line feed.
_RARE_SPACES = "\t\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RUNS = ("  ", "\n\n", " \n", "\n ")
_PLAIN = re.compile(r"[^\s|\0]+")
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Letters and marks that a tokenizer's word pattern parts; an apostrophe is none of them.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_MARKED = re.compile(f"([{_LETTERS}]+)([,.;:!?%$#&*]*)")
_CASES = " ".join(chr(c) for c in [*range(0x41, 0x5B), *range(0xC0, 0xDF)] if c != 0xD7)

#: The letters that stand for bytes in byte-level tokenizers: printable Latin-1 for itself, the others from U+0100 on in order. Fixed values.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE) if b != 0x0A}


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids. ``keeps_space``: whether the tokenizer sees the space before a word."""

    def __init__(self, path: str, keeps_space: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_space = keeps_space
        upper, lower = self.tokenizer.encode_batch_fast([_CASES, _CASES.lower()], add_special_tokens=False)
        self.folds_case = upper.ids == lower.ids
        stated = json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}
        steps = stated.get("pretokenizers", [stated])
        self.byte_level = bool(steps) and steps[-1].get("type") == "ByteLevel" and not steps[-1].get("add_prefix_space")
        self.kept: dict[str, bytes] = {}

    def _pieces(self, text: str) -> list[str]:
        """A text's pieces. With ``keeps_space``, those after the first lack their space; one that begins with a line feed keeps it.

        The first one gets a space, with which no other begins, so it is told from the same word after a space.
        """
        if not self.keeps_space:
            return text.replace("\n", " ").split(" ")
        pieces = text.replace("\n", " \n").split(" ")
        if not pieces[0] or not pieces[-1] or any(r in text for r in _RUNS) or any(c in text for c in _RARE_SPACES):
            first, *rest = _CUT.split(text)
            pieces = [first, *[p[1:] if p[0] == " " else p for p in rest]]
        if pieces[0]:
            pieces[0] = " " + pieces[0]
        return pieces

    def _singly(self, pieces: list[str]) -> dict[str, bytes]:
        asked = pieces
        if self.keeps_space:
            asked = [p[1:] if p[:1] == " " else p if p[:1] == "\n" else " " + p for p in pieces]
        made = self.tokenizer.encode_batch_fast(asked, add_special_tokens=False)
        return {p: np.array(e.ids, "<u4").tobytes() for p, e in zip(pieces, made, strict=True)}

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Words of letters alone go straight to the tokenizer's model, as it would see them: in its letters for bytes, with their space."""
        if not (self.byte_level and words):
            return self._together(words)
        space, tokenize = " " * self.keeps_space, self.tokenizer.model.tokenize
        seen = "\n".join([space + w for w in words]).encode().decode("latin-1").translate(_BYTE_LETTERS).split("\n")
        return {w: np.array([t.id for t in tokenize(x)], "<u4").tobytes() for w, x in zip(words, seen, strict=True)}

    def _together(self, pieces: list[str]) -> dict[str, bytes]:
        """Plain words are encoded as one text, parted by a token that none of them holds."""
        part = "\n " if self.keeps_space else " | "
        plain = [p for p in pieces if _PLAIN.fullmatch(p)]
        if not plain:
            return self._singly(pieces)
        text = part.join(plain)
        (mark,) = self.tokenizer.encode(part.strip(" "), add_special_tokens=False).ids
        ids = np.array(self.tokenizer.encode_batch_fast([" " * self.keeps_space + text], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(ids == mark)
        if len(at) != len(plain) - 1:
            return self._singly(pieces)
        raw = ids.tobytes()
        begins = [0, *(4 * at + 4).tolist()]
        ends = [*(4 * at).tolist(), len(raw)]
        out = {p: raw[a:b] for p, a, b in zip(plain, begins, ends, strict=True)}
        return out | self._singly([p for p in pieces if p not in out])

    def _new(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces that are not kept, and of the words and marks they are made of."""
        kept, apart, ask, words = self.kept, [], set(), set()
        for piece in pieces:
            word = _MARKED.fullmatch(piece)
            if not word:
                ask.add(piece)
                continue
            letters, marks = word.groups()
            if self.folds_case:
                letters = letters.lower()
            if letters not in kept:
                words.add(letters)
            if marks:
                marks = " " * self.keeps_space + marks
                if marks not in kept:
                    ask.add(marks)
            if marks or letters != piece:
                apart.append((piece, letters, marks))
        new = self._together(list(ask)) | self._words(list(words))
        for piece, letters, marks in apart:
            ids = kept[letters] if letters in kept else new[letters]
            new[piece] = ids + (kept[marks] if marks in kept else new[marks]) if marks else ids
        return new

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as bytes; a null or empty text has none."""
        kept = self.kept
        pieces = [self._pieces(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(pieces))
        found = list(map(kept.get, flat))
        absent = [i for i, ids in enumerate(found) if ids is None]
        if absent:
            new = self._new({flat[i] for i in absent})
            for i in absent:
                found[i] = new[flat[i]]
            kept.update(new if max(map(len, new)) <= LONGEST_KEPT else {p: x for p, x in new.items() if len(p) <= LONGEST_KEPT})
            if len(kept) > KEPT_PIECES:
                kept.clear()
        ends = list(accumulate(map(len, pieces), initial=0))
        return [b"".join(found[a:b]) for a, b in pairwise(ends)]


#: Tokens kept by a worker are dropped when it serves tasks of another kind.
CACHE = "token ids"


def encoder(path: str, keeps_space: bool) -> PieceEncoder:
    """This worker's encoder for a tokenizer file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    made = worker_cache(CACHE)
    if (path, keeps_space) not in made:
        made[path, keeps_space] = PieceEncoder(path, keeps_space)
    return made[path, keeps_space]


def slices(texts: list[str | None], most: int = 400_000):
    """Ranges of texts of about ``most`` characters together."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
