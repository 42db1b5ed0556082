"""Token ids of many texts, with the ids of recurring words kept per worker."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import public_tokenizers
from tokenizers import Tokenizer

from plumbline.llm.shared import one_thread

# Entries a worker keeps at most; further words are encoded again each time they come.
CACHE_ENTRIES = 800_000

# Classes of the characters up to U+00FF, as the vocabularies' patterns see them.
_LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACES = "\t-\r \x85\xa0"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"

# The pieces that are merged by themselves, for texts of characters up to U+00FF.
_KEPT_PIECES = re.compile(
    f"{_ENDINGS}| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+"
    f"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
).findall
_DROPPED_PIECES = re.compile(
    f"{_ENDINGS}|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+"
).findall

_OTHER_SPACE = re.compile(r"[^\S \n]")
_SPACED = re.compile(r"[ \n]*[^ \n]+|[ \n]+").findall
_WORDS = re.compile(r"[^ \t-\r]+").findall


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Visible characters up to U+00FF stand for themselves, the other bytes for U+0100 onwards.
    """
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Known(dict):
    """Ids by chunk; chunks of the current batch that found no room are in `more`."""

    more: dict[object, bytes] = {}

    def __missing__(self, chunk: object) -> bytes:
        return self.more[chunk]


class Encoder:
    """Encode texts as little-endian unsigned 32-bit ids, as the tokenizer does by default.

    Texts of characters up to U+00FF are cut into the pieces that the tokenizer merges by themselves,
    and each different piece goes through its model once. Other texts are cut only where it cuts in
    any case: between words for `spaces="dropped"` (white space makes no token, case is ignored), and
    before the white space that follows a word for `spaces="kept"`. A text that holds the string
    of an added token, or unusual white space beside characters above U+00FF, is encoded whole. So
    ids never differ from those of the whole text.
    """

    def __init__(self, file: str, spaces: str) -> None:
        one_thread()
        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.drop = spaces == "dropped"
        self.pieces: Callable[[str], list[str]] = _DROPPED_PIECES if self.drop else _KEPT_PIECES
        self.letters = byte_letters()
        # Pieces are text; chunks for the whole tokenizer are 1-tuples.
        self.known = _Known()

    def _chunks(self, text: str) -> list:
        if any(a in text for a in self.added):
            return [(text,)]
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.drop:
                return [(w,) for w in _WORDS(text)]
            return [(text,)] if _OTHER_SPACE.search(text) else [(c,) for c in _SPACED(text)]
        return self.pieces(text.lower() if self.drop else text)

    def _piece(self, piece: str) -> bytes:
        spelled = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in done]

    def __call__(self, texts: list[str]) -> list[bytes]:
        chunks = [self._chunks(t) for t in texts]
        known = self.known
        # Not a difference with keys(), which would go through all that is known.
        new = [c for c in set().union(*chunks) if c not in known]
        whole = [c[0] for c in new if type(c) is tuple]
        ids: dict[object, bytes] = {c: self._piece(c) for c in new if type(c) is str}
        ids.update(((t,), i) for t, i in zip(whole, self._whole(whole), strict=True))
        room = CACHE_ENTRIES - len(known)
        if room > 0:
            known.update((c, ids[c]) for c in new[:room] if len(c[0]) < 50 and len(c) < 50)
        known.more = ids
        get = known.__getitem__
        return [b"".join(map(get, c)) for c in chunks]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(file: str, spaces: str) -> Encoder:
    """The worker's encoder for a vocabulary file, a path or a name of `public_tokenizers`."""
    if (file, spaces) not in _ENCODERS:
        path = file if "/" in file else public_tokenizers.path(file)
        _ENCODERS[file, spaces] = Encoder(str(path), spaces)
    return _ENCODERS[file, spaces]
