"""Reading a SentencePiece model file: the inventory, scores and text rules, without the library."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field
from functools import cached_property

SPACE = "▁"
#: Fixed values of the model format: piece types and model kinds.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(buf: bytes):
    """(field number, value) pairs of one protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = buf[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(buf):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
            continue
        n = varint() if wire == 2 else 4 if wire == 5 else 8
        yield key >> 3, buf[i : i + n]
        i += n


@dataclass
class PieceModel:
    pieces: list[str]
    scores: list[float]
    types: list[int]
    kind: int = BPE
    byte_fallback: bool = True
    dummy_prefix: bool = True
    unk_id: int = 0
    ids: dict[str, int] = field(init=False)

    def __post_init__(self):
        usable = (NORMAL, USER_DEFINED, UNUSED)
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] in usable}
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        self.max_len = max(map(len, self.ids), default=1)
        self.chars = frozenset(p for p in self.ids if len(p) == 1)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        """Models with an identity normaliser, no white-space trimming and no user-defined symbols;
        another model is refused with ValueError, so that it never gives wrong ids."""
        pieces, scores, types, opts, norm = [], [], [], {}, {}
        with open(path, "rb") as f:
            blob = f.read()
        for number, value in _fields(blob):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                types.append(piece.get(3, NORMAL))
            elif number == 2:
                opts = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        kind = opts.get(3, UNIGRAM)
        if kind not in (UNIGRAM, BPE) or norm.get(2) or norm.get(4, 1) or not norm.get(5, 1) or opts.get(24) or USER_DEFINED in types:
            raise ValueError(f"unsupported model rules in {path}")
        return cls(pieces, scores, types, kind, bool(opts.get(35, 0)), bool(norm.get(3, 1)), types.index(UNKNOWN))

    def normalised(self, text: str) -> str:
        return (SPACE + text if self.dummy_prefix else text).replace(" ", SPACE) if text else ""

    @cached_property
    def chunk_pattern(self) -> re.Pattern:
        """Cuts a normalised text where no piece of two or more characters can cross: before a
        space mark that follows another character, and around line and tab characters, each only
        if the inventory has no such piece."""
        long = [p for p in self.ids if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in long):
            return re.compile(r"(?s).+")
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in long))
        cut = re.escape(alone)
        return re.compile(f"{SPACE}*[^{SPACE}{cut}]+|{SPACE}+" + (f"|[{cut}]" if alone else ""))

    @cached_property
    def bigrams(self) -> frozenset[str]:
        """Every two characters that are neighbours inside some piece."""
        return frozenset(p[i : i + 2] for p in self.ids for i in range(len(p) - 1))

    def parts(self, chunk: str) -> list[str]:
        """The chunk cut wherever two neighbours never meet inside a piece."""
        bigrams = self.bigrams
        cuts = [i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in bigrams]
        return [chunk[a:b] for a, b in zip([0, *cuts], [*cuts, len(chunk)], strict=True)] if cuts else [chunk]

    def rank(self) -> dict[str, float]:
        """Merge priority of a piece: the lowest comes first."""
        return {p: -self.scores[i] for p, i in self.ids.items() if len(p) > 1}
