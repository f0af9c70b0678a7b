"""Token ids of texts through the tokenizers library, with a bounded memory of what was encoded already."""

from __future__ import annotations

import os
import re
import struct

# Within these characters (Latin-1 without controls and odd blanks), normalising is lower-casing alone, and the
# vocabulary's pre-tokenizer cuts a chunk as _PIECE does.
_LETTER, _NUMBER = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
_PLAIN = re.compile("[!-~¡-ÿ]+")
_PIECE = re.compile(rf"[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if visible, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Pieces(dict):
    """Piece (word, number, marks) to packed ids, from the vocabulary's merges."""

    def __init__(self, tokenizer, most: int):
        super().__init__()
        self.model, self.most, self.of_byte = tokenizer.model, most, byte_characters()

    def __missing__(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join(map(self.of_byte.__getitem__, piece.encode()))
        value = _packed([t.id for t in self.model.tokenize(shown)])
        if len(self) < self.most:
            self[piece] = value
        return value


class ChunkEncoder(dict):
    """Encodes texts as packed little-endian 32-bit ids.

    No token of the vocabulary spans a blank or a line end, and its normaliser works chunk by chunk, so a text's
    ids are those of its blank-separated chunks in order. Chunks of plain characters are cut into pieces that the
    library's model encodes; others go through the whole tokenizer. At most `most` chunks and as many pieces are
    remembered.
    """

    def __init__(self, path: str, most: int = 270_000):
        super().__init__({"": b""})
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, special))) if special else re.compile(r"(?!)")
        self.pieces = _Pieces(self.tokenizer, most)

    def __missing__(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk) and not self.special.search(chunk):
            value = b"".join(map(self.pieces.__getitem__, _PIECE.findall(chunk.lower())))
        else:
            value = _packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        if len(self) < self.most:
            self[chunk] = value
        return value

    def encode(self, texts: list[str | None]) -> list[bytes]:
        get = self.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").split(" "))) if t else b"" for t in texts]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The process's encoder of a vocabulary file: workers are reused, so what they learnt stays."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    """The vocabulary file of the installed public tokenizers whose pre-tokenizer the pieces follow."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
