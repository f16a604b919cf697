"""Token ids of texts, by tokenizers whose files are given by path."""

from __future__ import annotations

import os
import re
from array import array

#: Distinct pieces whose ids a worker keeps in one generation, about 150 bytes each. A full generation becomes the
#: old one, so what is used again stays.
CACHE_PIECES = 400_000

# Plain characters: ASCII without control characters, and letters of two Latin blocks. Normalisation only lower-cases them.
_LETTERS, _SPACES, _WHITE = "ß-öø-įĳ-ſ", r" \t-\r", " \t\n\v\f\r"
_NOT_PLAIN = re.compile(f"[^{_SPACES}!-~À-ÖØ-öø-įĲ-ſ–—‘’“”…]")
_SPACE = re.compile(f"[{_SPACES}]")
#: Fixed value: how the tokenizer with word ends splits text, for plain characters after lower-casing.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LETTERS}]+|[0-9]|[^{_SPACES}a-z0-9{_LETTERS}]+")


def byte_characters() -> list[str]:
    """The printable character for each byte in byte-level vocabularies.

    Printable bytes of Latin-1 stand for themselves, the others in order for the code points from 256 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(0x100)]


class Generations:
    """A dictionary of bounded size that forgets what was not used lately."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.limit:
            self.new, self.old = {}, self.new
        self.new[key] = value


class ChunkedTokenizer:
    """``encode(text, add_special_tokens=False)`` of the tokenizer with word ends, with ids kept per piece.

    Plain text is lower-cased and split here, and only pieces that are not known yet are encoded. Around any other
    character the run without ASCII white space is encoded as it is; the tokenizer drops white space, so that
    gives the same ids. Texts with the string of a special token are encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.characters = self.tokenizer.model, byte_characters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces, self.runs = Generations(CACHE_PIECES), Generations(CACHE_PIECES // 4)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, run: str) -> bytes:
        found = self.runs.get(run)
        if found is None:
            found = self._whole(run)
            self.runs.put(run, found)
        return found

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            shown = piece if piece.isascii() else "".join(map(self.characters.__getitem__, piece.encode()))
            found = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            self.pieces.put(piece, found)
        return found

    def _plain(self, text: str) -> bytes:
        pieces = _PIECES.findall(text.lower())
        ids = list(map(self.pieces.new.get, pieces))
        if None in ids:
            ids = [self._piece(p) if i is None else i for p, i in zip(pieces, ids)]
        return b"".join(ids)

    def encode(self, raw: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of UTF-8 text."""
        text = raw.decode()
        if any(s in text for s in self.special):
            return self._whole(text)
        out, at = [], 0
        while odd := _NOT_PLAIN.search(text, at):
            start = max(at, *(text.rfind(c, at, odd.start()) + 1 for c in _WHITE))
            space = _SPACE.search(text, odd.end())
            end = space.start() if space else len(text)
            out += [self._plain(text[at:start]), self._run(text[start:end])]
            at = end
        out.append(self._plain(text[at:]))
        return b"".join(out)


_LOADED: dict[str, ChunkedTokenizer] = {}


def chunked_tokenizer(path: str) -> ChunkedTokenizer:
    """The tokenizer of this worker process, which later tasks use again until one of another kind runs here."""
    if path not in _LOADED:
        _LOADED[path] = ChunkedTokenizer(path)
    return _LOADED[path]


def release() -> None:
    """Lets the tokenizers of this worker process go: some 200 MB that would stay beside what other operators hold."""
    _LOADED.clear()
