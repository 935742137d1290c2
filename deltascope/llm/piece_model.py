"""What a SentencePiece model file says, read from its protobuf.

Only the wire format of protocol buffers is assumed: numbered fields holding variable-length
integers, fixed 32 or 64 bits, or bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

MARKER = "▁"

# fixed values of the format: kinds of pieces and of models
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        field, kind = divmod(number(), 8)
        if kind == 0:
            yield field, number()
            continue
        if kind not in (1, 2, 5):
            raise ValueError(f"wire type {kind} is not part of the format")
        size = number() if kind == 2 else 8 if kind == 1 else 4
        yield field, data[at:at + size]
        at += size


@dataclass(frozen=True)
class PieceModel:
    pieces: tuple[tuple[str, float, int], ...]  # text, score, kind; the position is the id
    kind: int
    byte_fallback: bool
    charsmap: bytes
    add_dummy_prefix: bool
    remove_extra_whitespaces: bool

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    @property
    def bytes_complete(self) -> bool:
        return self.byte_fallback and sum(p[2] == BYTE for p in self.pieces) == 256


def parse(data: bytes) -> PieceModel:
    pieces: list[tuple[str, float, int]] = []
    trainer: dict[int, int | bytes] = {}
    normalizer: dict[int, int | bytes] = {}
    for field, value in _fields(data):
        if field == 1:
            piece = dict(_fields(value))
            pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            normalizer = dict(_fields(value))
    if trainer.get(24, 0):
        raise ValueError("models with the white space marker behind the word are not supported")
    return PieceModel(
        tuple(pieces), int(trainer.get(3, UNIGRAM)), bool(trainer.get(35, 0)), normalizer.get(2, b""),
        bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)),
    )


def load(path: str) -> PieceModel:
    return parse(Path(path).read_bytes())
