"""Reader of a SentencePiece model file: pieces, scores, kinds and the normaliser's flags.

The file is a protocol buffer; only the few fields used here are decoded.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

#: Fixed values of the public format: piece kinds and the space mark.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"
UNIGRAM, BPE = 1, 2


@dataclass
class SpmModel:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    charsmap: bytes = b""

    def normal(self) -> dict[str, int]:
        return {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}

    def byte_ids(self) -> list[int]:
        by = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        return [by.get(f"<0x{b:02X}>", -1) for b in range(256)]

    def check_plain(self) -> None:
        """The compilers here need an identity normaliser and no user-defined pieces."""
        if self.charsmap or self.remove_extra_whitespaces or not self.escape_whitespaces or USER_DEFINED in self.kinds:
            raise ValueError("this model's normaliser or user-defined pieces aren't supported")


def _fields(buf: bytes):
    at, end = 0, len(buf)

    def varint(at):
        value = shift = 0
        while True:
            b = buf[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value, at
            shift += 7

    while at < end:
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = buf[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = buf[at : at + n], at + n
        yield key >> 3, value


def read_model(path: str) -> SpmModel:
    m = SpmModel()
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    piece = v.decode("utf-8")
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            m.pieces.append(piece)
            m.scores.append(score)
            m.kinds.append(kind)
        elif number == 2:
            for k, v in _fields(value):
                if k == 3:
                    m.model_type = v
        elif number == 3:
            for k, v in _fields(value):
                if k == 2:
                    m.charsmap = v
                elif k == 3:
                    m.add_dummy_prefix = bool(v)
                elif k == 4:
                    m.remove_extra_whitespaces = bool(v)
                elif k == 5:
                    m.escape_whitespaces = bool(v)
    return m
