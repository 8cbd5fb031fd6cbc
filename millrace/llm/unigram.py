"""A unigram model over the pieces of a public SentencePiece vocabulary."""

from __future__ import annotations

import math
from array import array
from dataclasses import dataclass

MARK = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with ids and scores; a leading blank stands for the word mark. ``byte_ids`` has the ids of the 256 byte pieces."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: tuple[int, ...]
    byte_score: float
    tails: dict[str, float | None]  # every ending of a piece, with its score where it is a piece itself
    packed: dict[str, bytes]  # each piece's id as four bytes
    raw: tuple[bytes, ...]  # what each id stands for

    def fallback(self, char: str) -> tuple[float, list[int]]:
        got = [self.byte_ids[b] for b in char.encode()]
        return self.byte_score * len(got), got


def load(model: str) -> Vocabulary:
    """Read a model file on the driver. Its merge ranks give the scores: by Zipf's law, minus the logarithm of the rank. Pieces with a word mark
    anywhere but in front are left out, as a word has one mark, and a mark that a text contains itself is spelled in bytes."""
    from sentencepiece import SentencePieceProcessor

    processor = SentencePieceProcessor(model_file=model)
    ids, raw, byte_ids = {}, [], [0] * 256
    for k in range(processor.get_piece_size()):
        piece = processor.id_to_piece(k)
        if processor.is_byte(k):
            value = int(piece[3:-1], 16)
            byte_ids[value] = k
            raw.append(bytes([value]))
        elif processor.is_control(k) or processor.is_unknown(k) or processor.is_unused(k):
            raw.append(b"")
        else:
            plain = piece.replace(MARK, " ")
            raw.append(plain.encode())
            if " " not in plain[1:]:
                ids[plain] = k
    if " " not in ids:
        raise ValueError("the model has no piece for a word mark alone")
    scores = {piece: -math.log(2 + k) for piece, k in ids.items()}
    tails = {piece[i:]: None for piece in ids for i in range(1, len(piece))} | scores
    return Vocabulary(ids, scores, tuple(byte_ids), -2 * math.log(2 + len(raw)), tails, {piece: array("i", [k]).tobytes() for piece, k in ids.items()}, tuple(raw))
