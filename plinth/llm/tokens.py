"""Tokenizers of the installed vocabulary files, one for each worker process."""

from __future__ import annotations

import base64
import codecs
import re
from array import array
from collections.abc import Callable

import numpy as np

#: Words whose ids a worker remembers, besides those of the texts in hand.
REMEMBERED = 400_000

#: Letters that lower case, normal form and the splitter leave in one piece, and marks that are another.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)[.,;:!?#*$%&|]*")
_MARKS = b".,;:!?#*$%&|"
#: Byte-level vocabularies show bytes as characters: these as themselves, all others in order from 256 on.
_THEMSELVES = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = [b for b in range(256) if b not in _THEMSELVES]
_SHOWN = "".join(chr(b if b in _THEMSELVES else 256 + _OTHERS.index(b)) for b in range(256))

_MADE: dict[tuple[str, str], object] = {}


def word_bpe(path: str) -> WordBpe:
    """The tokenizer of a file in the format of the `tokenizers` library."""
    if ("word", path) not in _MADE:
        _MADE["word", path] = WordBpe(path)
    return _MADE["word", path]


def byte_bpe(path: str, pattern: str):
    """The tokenizer of a file of ranks in the format of `tiktoken`."""
    if (pattern, path) not in _MADE:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _MADE[pattern, path] = tiktoken.Encoding("from-file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _MADE[pattern, path]


def forget() -> None:
    """Drops a worker's tokenizers and what they remember (about 100 MB), for operators that have none and are next in a worker."""
    _MADE.clear()


class _Pieces:
    """What of the library cuts words. It refers to no words, so a tokenizer is free as soon as it is dropped."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.merges, self.marks = self.library.model, {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind)

    def simple(self, word: bytes, known: _Known) -> bytes | None:
        """Ids of letters of Latin-1 and marks after them: one piece each for the merges, without the library's other steps."""
        letters = word.rstrip(_MARKS)
        if letters.isalpha():  # for bytes: of ASCII
            piece = letters.lower().decode()
        elif (found := _SIMPLE.fullmatch(word.decode())) is not None:
            piece = codecs.charmap_decode(found[1].lower().encode(), "strict", _SHOWN)[0]
        else:
            return None
        marks = word[len(letters) :]
        ids = (known.get(letters) or known.older.get(letters)) if marks else None
        if ids is None:
            ids = array(self.kind.char, [x.id for x in self.merges.tokenize(piece)]).tobytes()
        if marks and marks not in self.marks:
            self.marks[marks] = self.ids(marks.decode()).tobytes()
        return ids + self.marks[marks] if marks else ids


class _Known(dict):
    """Ids of words. One that is missing comes from the generation before or is simple; else it is put into `rest` and None for now."""

    def __init__(self, older: dict[bytes, bytes], pieces: _Pieces):
        self.older, self.pieces, self.rest = older, pieces, set()

    def __missing__(self, word: bytes) -> bytes | None:
        ids = self.older.get(word)
        if ids is None:
            ids = self.pieces.simple(word, self)
            if ids is None:
                self.rest.add(word)
                return None
        self[word] = ids
        return ids


class WordBpe:
    """Ids of whole texts as the library gives them, with the ids of words remembered.

    This vocabulary's normaliser, splitter and merges never look across white
    space, so a text's ids are those of its words in turn.  Letters A-Z are
    lower-cased first, unless the text has the start of a special token.
    """

    def __init__(self, path: str):
        self.pieces = _Pieces(path)
        self.library, self.kind = self.pieces.library, self.pieces.kind
        # Words of late, and those of the generation before.
        self.known = _Known({}, self.pieces)
        self.mark = "<|endoftext|>"
        self.end = self.library.token_to_id(self.mark)

    def _learn(self, words: list[bytes], into: dict[bytes, bytes]) -> None:
        easy = [w for w in words if b"<|" not in w]
        for first in range(0, len(easy), 4096):
            part = easy[first : first + 4096]
            # The end token between words shows where each one's ids end.
            ids = self.pieces.ids(self.mark.join(w.decode() for w in part))
            raw, size = ids.tobytes(), self.kind.itemsize
            begin = 0
            for w, stop in zip(part, [*np.flatnonzero(ids == self.end).tolist(), len(ids)], strict=True):
                into[w] = raw[begin * size : stop * size]
                begin = stop + 1
        for w in words:
            if b"<|" in w:
                into[w] = self.pieces.ids(w.decode()).tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text (null: none)."""
        if len(self.known) > REMEMBERED // 2:
            self.known.older = {}
            self.known = _Known(self.known, self.pieces)
        known, out = self.known, []
        for text in texts:
            raw = (text or "").encode()
            words = (raw if b"<|" in raw else raw.lower()).split()
            ids = list(map(known.__getitem__, words))
            if known.rest:
                self._learn(list(known.rest), known)
                known.rest.clear()
                ids = [known[w] if x is None else x for w, x in zip(words, ids, strict=True)]
            out.append(np.frombuffer(b"".join(ids), self.kind))
        return out
