"""Token ids of texts, by the public tokenizers of the `tokenizers` library.

A tokenizer whose pre-tokenizer drops white space gives the ids of a text as the ids of its space-separated
chunks, one after another. For these, ids of chunks are remembered, so that each worker encodes a chunk once.
If the file also names a splitting pattern with byte-level symbols and plain lower-casing, new chunks of Latin
letters are split here and the model is asked for each new piece only. Other tokenizers encode each text as a whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Callable

_PROBES = ("it's a Test, of 12 words", "é ü\n\nß\t x", "<|endoftext|> a <|x|>", "a\r\nb  c   ")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Chunks in which composed forms and lower-casing need no context: printable Latin, without soft hyphens.
_PLAIN = re.compile(r"[\x21-\x7e\xa1-\xac\xae-\u024f]+").fullmatch


def byte_symbols() -> dict[int, str]:
    """Byte-level symbols: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def split_pattern(path: str) -> str | None:
    """The splitting pattern of a tokenizer file whose steps are NFC, white space to spaces, lower case, split, byte level."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if norm != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in pre] != ["Split", "ByteLevel"]:
        return None
    split, level = pre
    if not (split["invert"] and split["behavior"] == "Removed") or level["add_prefix_space"] or level["use_regex"]:
        return None
    return split["pattern"].get("Regex")


def chunks_of(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


#: The splitting pattern whose pieces of a word, alone or before one other mark, are known without it.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Memory(dict):
    """What make gives for a key. At most about `most` keys are remembered: when half as many are new, they take the place of those before them, which are looked up second."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self._make, self._half, self._before = make, max(1, most // 2), {}

    def __missing__(self, key: str) -> bytes:
        value = self._before.get(key)
        if value is None:
            value = self._make(key)
        if len(self) >= self._half:
            self._before = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Ids of texts as little-endian bytes. ordinary: special tokens' strings in a text are ordinary text."""

    def __init__(self, path: str, ordinary: bool = False, width: int = 4, remember: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        if ordinary:
            self.tok.encode_special_tokens = True
        self._code = {2: "H", 4: "I"}[width]
        self.width = width
        self._batch = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        self._known, self._pieces = Memory(self._of_chunk, remember), Memory(self._of_piece, 2 * remember)
        pattern = split_pattern(path)
        self._split = None
        if pattern:
            import regex

            self._split, self._symbols, self._words = regex.compile(pattern).findall, byte_symbols(), pattern == _WORDS
        self.by_chunk = all(self._ids(p) == [i for c in chunks_of(p) for i in self._ids(c)] for p in _PROBES)

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self._code, ids).tobytes() if sys.byteorder == "little" else b"".join(i.to_bytes(self.width, "little") for i in ids)

    def _of_piece(self, piece: str) -> bytes:
        symbols = piece if piece.isascii() else "".join(map(self._symbols.__getitem__, piece.encode()))
        return self._bytes([t.id for t in self.tok.model.tokenize(symbols)])

    def _of_chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if self._split and "<|" not in chunk and _PLAIN(chunk):
            low = chunk.lower()
            if self._words:
                if low.isalpha():
                    return self._pieces[low]
                if low[:-1].isalpha() and low[-1] in ".,:;!?":
                    return self._pieces[low[:-1]] + self._pieces[low[-1]]
            return b"".join(map(self._pieces.__getitem__, self._split(low)))
        return self._bytes(self._batch([chunk], add_special_tokens=False)[0].ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """One bytes object per text; a null text has no ids."""
        if not self.by_chunk:
            return [self._bytes(self._ids(t)) if t else b"" for t in texts]
        known = self._known.__getitem__
        return [b"".join(map(known, chunks_of(t))) if t else b"" for t in texts]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, ordinary: bool = False, width: int = 4) -> Encoder:
    """One encoder for each worker process and setting."""
    key = (path, ordinary, width)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, ordinary, width)
    return _ENCODERS[key]
