"""Token ids of whole texts with the tokenizers library, one tokenizer per Python worker.

The library spends most of its time on keeping track of positions while it cuts a text into
pieces. A piece's ids depend on the piece alone, so texts made of plain characters are cut with
the tokenizer's own pattern here, and every new piece goes to the library's model once; known
pieces come from a table. All other texts go through the library as a whole. Both ways give the
same ids (tests compare them).
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

from meritlake.llm.frames import remember_only

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

def closed_under_lower(characters: set[int]) -> list[int]:
    """The characters whose small letter is one character of the set too."""
    while gone := {c for c in characters if len(chr(c).lower()) != 1 or ord(chr(c).lower()) not in characters}:
        characters = characters - gone
    return sorted(characters)


# Characters on which every Unicode version and every pattern library agree. A text of them is
# put in lower case after it was found to be plain, so it has to stay plain.
PLAIN = closed_under_lower({*range(9, 14), *range(32, 127), *range(0xA0, 0x250), *range(0x2010, 0x2028)})
_NOT_PLAIN = re.compile("[^" + "".join(re.escape(chr(c)) for c in PLAIN) + "]")
# Pieces a worker remembers; the table starts afresh when it is full.
MOST_PIECES = 200_000


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies.

    Visible Latin-1 characters stand for themselves, the other bytes, in order, for the
    characters from U+0100 on.
    """
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + place) for place, b in enumerate(hidden)}


def _class_of(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in PLAIN if unicodedata.category(chr(c))[0] == kind)


def plain_pattern(pattern: str) -> re.Pattern:
    """A pattern with Unicode classes, for texts of plain characters only."""
    for name, kind in ((r"\p{L}", "L"), (r"\p{N}", "N")):
        members = _class_of(kind)
        pattern = re.sub(r"(\[[^\]]*)" + re.escape(name), lambda m: m[1] + members, pattern)
        pattern = pattern.replace(name, f"[{members}]")
    return re.compile(pattern)


class PieceTable(dict):
    """Ids of a piece as little-endian 32-bit integers; unknown pieces are asked of the model."""

    def __init__(self, model):
        super().__init__()
        characters = byte_characters()
        self.model = model
        self.spelling = {c: "".join(characters[b] for b in chr(c).encode()) for c in PLAIN}

    def __missing__(self, piece: str) -> bytes:
        tokens = self.model.tokenize(piece.translate(self.spelling))
        found = b"".join([t.id.to_bytes(4, "little") for t in tokens])
        if len(piece) <= 64:
            self[piece] = found
        return found


class Encoder:
    """Ids of texts as bytes: 32-bit little-endian integers, without special tokens.

    ``pattern`` is the tokenizer's own pattern for pieces; ``lower`` says that it lower-cases.
    """

    def __init__(self, definition: str, pattern: str, lower: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.lower = lower
        self.pieces = plain_pattern(pattern).findall
        self.table = PieceTable(self.tokenizer.model)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _NOT_PLAIN.search(text):
            import numpy as np

            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.table) > MOST_PIECES:
            self.table.clear()
        return b"".join(map(self.table.__getitem__, self.pieces(text.lower() if self.lower else text)))


def read_definition(path: str) -> str:
    """The tokenizer's file, read once by the driver and sent to the workers; a fixed few MB."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def pattern_of(definition: str) -> str:
    """The pattern by which a tokenizer that has a step of its own for it cuts texts into pieces."""
    steps = json.loads(definition)["pre_tokenizer"]["pretokenizers"]
    return next(step["pattern"]["Regex"] for step in steps if step["type"] == "Split")


_encoders: dict[int, Encoder] = {}


def encoder_of(definition: str, pattern: str, lower: bool = False) -> Encoder:
    """The worker's encoder, made once; a task of another step lets it go."""
    remember_only("tokens", _encoders.clear)
    key = hash((definition, pattern, lower))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition, pattern, lower)
    return _encoders[key]
