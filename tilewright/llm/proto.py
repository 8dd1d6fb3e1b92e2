"""The few fields of a SentencePiece model file (a protocol buffer) that the tokenizer operators read and write."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

#: Fixed values of the public model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) in the order of the ids."""
    with open(path, "rb") as f:
        data = f.read()
    out = []
    for field, value in _fields(data):
        if field == 1:
            own = dict(_fields(value))
            out.append((own[1].decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
    return out


def model(pieces: Iterable[tuple[str, float, int]], kind: int, unknown: int, byte_fallback: bool, dummy_prefix: bool,
          escape: bool) -> bytes:
    """A model with identity normalisation that keeps every blank."""
    body, n = [], 0
    for piece, score, type_ in pieces:
        body.append(_block(1, _block(1, piece.encode()) + b"\x15" + struct.pack("<f", score) + _number(3, type_)))
        n += 1
    trainer = _number(3, kind) + _number(4, n) + _number(35, byte_fallback) + _number(40, unknown)
    trainer += _number(41, -1) + _number(42, -1) + _number(43, -1)
    normalizer = _block(1, b"identity") + _number(3, dummy_prefix) + _number(4, 0) + _number(5, escape)
    return b"".join(body) + _block(2, trainer) + _block(3, normalizer)
