"""Token ids of public tokenizers, as little-endian 32-bit integers.

Both vocabularies split a text into pieces and merge bytes within each piece alone, so
the ids of a piece can be kept: texts repeat their words far more often than they
bring new ones.  The pieces are found here, with the pattern of the vocabulary, and
merged by the model of the tokenizers library.  Texts with letters beyond the Latin
blocks, or with white space on which pattern engines differ, go to the library as a
whole, as do those that may hold an added token of the vocabulary.  So ids are those of
the library's ``encode(text, add_special_tokens=False)``.  A vocabulary file that splits
texts in another way than the two known ones is left to the library altogether.

Defined cases: a null or empty text has no ids.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

#: The patterns of the two vocabularies, for texts of the Latin blocks.
_WORD_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_BYTE_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: How the files of the two vocabularies say that they split a text.
_BYTE_FILE = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "end_of_word_suffix": None}
_WORD_FILE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "end_of_word_suffix": "</w>",
}
#: Letters beyond these blocks, numbers that aren't digits, odd white space.
_UNSURE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]")
#: Pieces that an encoder keeps before it starts over; about 200 bytes each.
KEPT_WORDS, KEPT_BYTES = 300_000, 600_000


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte: itself if it is printable in Latin-1,
    else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_CHARACTERS = _byte_characters()


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Kept(dict):
    """Ids of pieces; a new piece is merged when it is asked for."""

    def __init__(self, model):
        self.tokenize = model.tokenize

    def __missing__(self, piece: str) -> bytes:
        plain = piece.replace(" ", _CHARACTERS[32]) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_CHARACTERS)
        ids = self[piece] = array("I", [t.id for t in self.tokenize(plain)]).tobytes()
        return ids


class Encoder:
    """ids(text) of one vocabulary file; ``cut`` splits a text into the pieces that are
    merged on their own, or gives None if it isn't sure of them.  It is used if the file
    splits texts as ``known`` says."""

    def __init__(self, path: str, cut: Callable[[str], list[str] | None], known: dict, most: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            says = json.load(file)
        model = says["model"]
        plain = not (model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"))
        as_known = plain and known == {"normalizer": says["normalizer"], "pre_tokenizer": says["pre_tokenizer"], "end_of_word_suffix": model.get("end_of_word_suffix")}
        # What added tokens begin with, up to their first letter: texts without that hold none.
        self.marks = {re.match(r"[\W_]*", t["content"])[0] for t in says["added_tokens"]}
        self.cut = cut if as_known and "" not in self.marks else lambda text: None
        self.kept, self.most = _Kept(self.tokenizer.model), most

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        pieces = None if any(m in text for m in self.marks) else self.cut(text)
        if pieces is None:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.kept) > self.most:
            self.kept.clear()
        return b"".join(map(self.kept.__getitem__, pieces))

    def ids_of(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        return map(self.ids, texts)


def _words(text: str) -> list[str] | None:
    if _UNSURE.search(text) or not unicodedata.is_normalized("NFC", text):
        return None
    return _WORD_PIECE.findall(text.lower())


def _pieces(text: str) -> list[str] | None:
    return None if _UNSURE.search(text) else _BYTE_PIECE.findall(text)


@lru_cache(None)
def word_bpe(path: str | None = None) -> Encoder:
    """Lower-cased words without white space between them; one encoder a process, so that
    the tasks of a Python worker share its pieces."""
    return Encoder(path or vocabulary("word_bpe_49k.json"), _words, _WORD_FILE, KEPT_WORDS)


@lru_cache(None)
def byte_bpe(path: str | None = None) -> Encoder:
    """Byte-level ids; a blank belongs to the word after it.  One encoder a process."""
    return Encoder(path or vocabulary("byte_bpe_50k.json"), _pieces, _BYTE_FILE, KEPT_BYTES)
