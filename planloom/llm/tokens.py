"""Token ids by the tokenizers library, with a bounded cache of text pieces.

A tokenizer that never joins characters across white space gives a text the ids of its
pieces, one after the other. ``Encoder`` cuts texts only where that holds for the two
kinds of tokenizer it knows (by their own description), asks the library for each
piece that its cache doesn't hold, and gives whole texts to the library otherwise.
Texts of Latin-1 are cut further for tokenizers that drop white space: into pre-tokens.
``encode_each`` looks up each different word of many such texts once.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Pieces held by one cache; it is emptied when full.
MOST_PIECES = 250_000
#: Characters of texts whose words are looked up together.
MOST_CHARS = 8_000_000

#: The splitting pattern of word tokenizers, and the byte-to-letter rule
#: of byte-level models (printable bytes stand for themselves, others follow from 256).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHER = [b for b in range(256) if b not in _PRINTABLE]
_LETTER = [chr(b) if b in _PRINTABLE else chr(256 + _OTHER.index(b)) for b in range(256)]

#: Separators of ASCII that Python counts as white space and patterns do not.
_UNSURE = ("\x1c", "\x1d", "\x1e", "\x1f")
#: What both count as white space, besides space and line end.
_RARE = ("\t", "\r", "\x0b", "\x0c", "\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)),
         "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")
#: Blanks that do not stand alone between two runs of other characters.
_DOUBLE = ("  ", "\n\n", "\n ", " \n")
_RUN = re.compile(r"\s*\S+|\s+")
#: Letters that are one pre-token, and marks that are the next; no apostrophe, which may belong to letters.
_WORD = re.compile(r"( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%&$#*()\"-]*)")
#: What WORD_PATTERN finds in lower-case texts of Latin-1, whose letters and numbers are these.
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
_TOKEN = re.compile(rf"[{_LETTERS}]+|[{_NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^\s{_LETTERS}{_NUMBERS}]+")


def ids_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def _is_latin(text: str) -> bool:
    """Whether all characters are below 256: lower-casing keeps them so, and NFC leaves them alone."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _kind(tokenizer: Tokenizer) -> str | None:
    """How texts may be cut: "words" (white space is dropped), "bytes" (it opens a piece) or None."""
    described = json.loads(tokenizer.to_str())
    if any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in described["added_tokens"]):
        return None
    before, after = described["pre_tokenizer"] or {}, described["normalizer"]
    if before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and after is None:
        return "bytes"
    steps = before.get("pretokenizers", [])
    words = [x.get("pattern", {}).get("Regex") == WORD_PATTERN and x["invert"] for x in steps[:1]] == [True]
    plain = [x.get("type") for x in (after or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    if words and plain and len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1]["use_regex"]:
        return "words"
    return None


class _Pieces(dict):
    """Piece to ids; ``text_of`` gives the text that a key stands for."""

    def __init__(self, encoder: Encoder, text_of):
        self.encoder, self.text_of = encoder, text_of

    def __missing__(self, key):
        found = self.encoder.piece(self.text_of(key))
        if len(self) >= MOST_PIECES:
            self.clear()
        self[key] = found
        return found


class Encoder:
    """Ids of texts, as bytes of unsigned 32-bit integers, as the tokenizer file at ``path`` gives them."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = _kind(self.tokenizer)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.cached = _Pieces(self, str)
        self.spaced = _Pieces(self, lambda key: " " + key)

    def whole(self, text: str) -> bytes:
        return ids_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, letters: str) -> bytes:
        return ids_bytes([token.id for token in self.model.tokenize(letters)])

    def piece(self, text: str) -> bytes:
        if text.isascii() and text.isalpha() and (text.islower() or self.kind == "bytes"):
            return self.word(text)
        match = _WORD.fullmatch(text)
        if not match:
            return self.whole(text)
        space, word, marks = match.groups()
        lower = word.lower() if self.kind == "words" else word
        if marks or lower != word:
            return (self.spaced if space else self.cached)[lower] + (self.cached[marks] if marks else b"")
        return self.word("".join([_LETTER[b] for b in (space + word).encode()]))

    def _plain(self, text: str) -> bool:
        """Whether _TOKEN finds the pre-tokens of ``text`` in lower case (words only)."""
        return _is_latin(text) and not any(x in text for x in self.added) and not any(x in text for x in _UNSURE)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.kind is None or any(x in text for x in _UNSURE):
            return self.whole(text)
        if self.kind == "words":
            # words apart from case and marks, so that the cache meets fewer different pieces
            pieces = _TOKEN.findall(text.lower()) if self._plain(text) else text.split()
            return b"".join(map(self.cached.__getitem__, pieces))
        if any(x in text for x in _DOUBLE) or any(x in text for x in _RARE) or text[0] in " \n" or text[-1] in " \n":
            return b"".join(map(self.cached.__getitem__, _RUN.findall(text)))
        # single spaces, which open the next piece, and single line ends, which are pieces of their own
        lines = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            lines.append(self.cached[first] + b"".join(map(self.spaced.__getitem__, rest)))
        return self.cached["\n"].join(lines)

    def encode_each(self, texts: Iterable[str]) -> Iterator[bytes]:
        """``encode`` of each text, in order, at most MOST_CHARS characters (or one longer text) ahead."""
        group, chars = [], 0
        for text in texts:
            if group and chars + len(text) > MOST_CHARS:
                yield from self._encode_group(group)
                group, chars = [], 0
            group.append(text)
            chars += len(text)
        yield from self._encode_group(group)

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        if self.kind != "words":
            return [self.encode(text) for text in texts]
        together = [len(text) <= MOST_CHARS and self._plain(text) for text in texts]
        found = iter(self._encode_words([text.lower() for text, plain in zip(texts, together) if plain]))
        return [next(found) if plain else self.encode(text) for text, plain in zip(texts, together)]

    def _encode_words(self, lower: list[str]) -> list[bytes]:
        words_of = pc.ascii_split_whitespace(pa.array(lower, pa.large_string()))
        words = words_of.flatten().dictionary_encode()
        get = self.cached.__getitem__
        ids_of = [get(word) if word.isalpha() else b"".join(map(get, _TOKEN.findall(word)))
                  for word in words.dictionary.to_numpy(zero_copy_only=False)]
        sizes = np.fromiter(map(len, ids_of), np.int32, len(ids_of)) // 4
        first = np.cumsum(sizes, dtype=np.int32) - sizes
        at = words.indices.to_numpy()
        n = sizes[at]
        ends = np.cumsum(n, dtype=np.int32)
        where = np.repeat(first[at] - ends + n, n)
        where += np.arange(len(where), dtype=np.int32)
        ids = np.frombuffer(b"".join(ids_of), "<u4")[where].tobytes()
        bounds = (4 * np.concatenate(([0], ends))[words_of.offsets.to_numpy()]).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path)
