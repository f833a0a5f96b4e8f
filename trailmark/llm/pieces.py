"""A public piece vocabulary read as a unigram model: pieces, scores, and the cuts at which texts fall into independent units."""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass

import ahocorasick
import numpy as np
import public_tokenizers

#: Stands for a space.
SPACE = "▁"
_UNITS = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Penalty of the tokenizers library for a character that no piece covers.
UNKNOWN_PENALTY = 10.0


def default_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Pieces:
    """texts[i] and scores[i] of piece i; byte_ids[b]: the piece of byte b; matched: ids found in text."""

    texts: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray
    matched: np.ndarray
    #: No piece has a space mark after another character, so a text falls apart before each run of marks.
    cuts: bool


@functools.cache
def load(path: str) -> Pieces:
    """The vocabulary of a SentencePiece model file with byte pieces."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    texts = [sp.id_to_piece(i) for i in range(n)]
    special = np.array([sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)])
    byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
    matched = np.flatnonzero(~special)
    cuts = not any(SPACE in texts[i].lstrip(SPACE) or "\n" in texts[i] for i in matched)
    return Pieces(texts, np.array([sp.get_score(i) for i in range(n)], dtype=np.float64), byte_ids, matched, cuts)


@functools.cache
def automaton(path: str):
    """Aho-Corasick over the pieces that occur in text; a match gives id * 64 + length. Matches of one end come longest first."""
    v = load(path)
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i in v.matched.tolist():
        assert len(v.texts[i]) < 64
        found.add_word(v.texts[i], i * 64 + len(v.texts[i]))
    found.make_automaton()
    return found


def marked(text: str) -> str:
    """The text as the model sees it: a mark in front, and marks for spaces; nothing for an empty text."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def units(text: str) -> list[str]:
    """The units of marked(text), each without the mark it starts with where it has only one."""
    parts = marked(text).split(SPACE)[1:]
    return [u[1:] for u in _UNITS.findall(marked(text))] if "" in parts else parts


def rank_log_probs(path: str, alpha: float) -> tuple[np.ndarray, float]:
    """Log-probabilities of pieces from their place in the vocabulary, (place + 1) ** -alpha normalised, and that of a single byte."""
    v = load(path)
    place = np.full(len(v.texts), len(v.matched), dtype=np.float64)
    place[v.matched[np.argsort(-v.scores[v.matched], kind="stable")]] = np.arange(len(v.matched))
    weight = (place + 1) ** -alpha
    total = math.log(weight[v.matched].sum() + 256 * weight[v.byte_ids[0]])
    return np.log(weight) - total, float(np.log(weight[v.byte_ids[0]]) - total)
