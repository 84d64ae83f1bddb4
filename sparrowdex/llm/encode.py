"""Encoding of a corpus with a public byte-level BPE vocabulary, by a sentencepiece model made from it."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Pre-tokens are kept with their ids up to this many, then the memory is emptied.
MEMORY = 1 << 18


def byte_letters() -> list[str]:
    """A printable letter for each byte: the printable Latin-1 ones stand for themselves, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer message."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def piece_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model with the vocabulary's tokens as byte-mapped pieces.

    Piece i is the token of rank i with score -i, so that the model merges what the vocabulary merges first; the
    normaliser is the identity and adds no prefix. The unknown piece, never used as every byte is a piece, comes last.
    """
    letters = byte_letters()
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    pieces = [_field(1, "".join(letters[b] for b in t).encode()) + _field(2, float(-i)) for i, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(40, len(tokens)) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43)) + _field(24, 0)
    normalizer = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PieceEncoder:
    """Text to ids and back with the vocabulary of `path`; `pattern` cuts a text into pre-tokens."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=piece_model(read_ranks(path)))
        self.cut = regex.compile(pattern).findall
        self.letters = dict(enumerate(byte_letters()))
        self.bytes = {c: b for b, c in self.letters.items()}
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; none for null and empty texts."""
        cut = [self.cut(t) if t else [] for t in texts]
        if len(self.known) > MEMORY:
            self.known.clear()
        new = list({w for words in cut for w in words if w not in self.known})
        mapped = [w.encode().decode("latin-1").translate(self.letters) for w in new]
        self.known.update(zip(new, self.model.encode(mapped, out_type=int, num_threads=1)))
        known = self.known
        return [[i for w in words for i in known[w]] for words in cut]

    def decode(self, ids: list[int]) -> str:
        """The text that has these ids."""
        return bytes(self.bytes[c] for i in ids for c in self.model.id_to_piece(int(i))).decode("utf-8", "replace")


@lru_cache(1)
def encoder(path: str, pattern: str) -> PieceEncoder:
    """One encoder per Python worker."""
    return PieceEncoder(path, pattern)


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and pattern of a public vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encode_corpus(documents: DataFrame, path: str | None = None, pattern: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every document, without special tokens; null and empty texts have the empty list.

    One pass without a shuffle; strings of special tokens are ordinary text; blank texts are encoded as they are. The
    vocabulary is read on each worker from `path`, which must exist there (default: the installed public one).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(*((path, pattern) if path else public_vocabulary()))
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for at in range(0, len(texts), 512):
                ids = pa.array(e.encode(texts[at : at + 512]), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([keys[at : at + 512], ids], [key, "ids"])

    return documents.select(key, text).mapInArrow(run, f"{key} {dict(documents.dtypes)[key]}, ids array<int>")
