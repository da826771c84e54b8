"""Oversized texts cut into overlapping pieces at natural boundaries, by pointer doubling.

Every token position of a text is a possible cut. Each cut is joined to its farthest legal
successor (the overlap counted in); squaring that successor table doubles the reach, so all
greedy cuts of a text come out in log2(pieces) vectorised rounds. A text lies in one row, so
the tables are local arrays and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schedlake.llm import tokens
from schedlake.session import spread

LIMIT, OVERLAP = 1024, 64
#: Tokens that a piece must be able to advance: both its ends may move back to keep a character of four bytes whole.
LEAST_STEP = 8

_WORD = re.compile(r"\s+")
_SENTENCE = re.compile(r"(?:[.!?…]+[\"'”’»)\]]*(?=\s|\Z)|[。！？]+[」』”]*)\s*")
_LINE = re.compile(r"[^\S\n]*\n\s*")


def boundary_classes(text: str) -> np.ndarray:
    """Per character position: 2 where a sentence or line ends, 1 where a word ends, else 0."""
    kind = np.zeros(len(text) + 1, dtype=np.int8)
    for m in _WORD.finditer(text):
        kind[m.start() : m.end() + 1] = 1
    for m in _SENTENCE.finditer(text):
        body = len(m[0].rstrip())
        kind[m.start() + body : m.end() + 1] = 2
    for m in _LINE.finditer(text):
        kind[m.start() : m.end() + 1] = 2
    return kind


def _last_at(flags: np.ndarray) -> np.ndarray:
    """For each position the last flagged position at or before it, -1 before the first."""
    return np.maximum.accumulate(np.where(flags, np.arange(len(flags)), -1))


def _char_at(starts: np.ndarray, end: int) -> np.ndarray:
    """Character of every token position; one inside a character stands at that character's token."""
    return np.concatenate([np.maximum.accumulate(starts), [end]]) if len(starts) else np.array([end])


def successors(starts: np.ndarray, kind: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """``(next cut, piece start)`` for every token position as a cut.

    The piece after a cut starts ``overlap`` tokens before it and ends at the farthest position
    within ``limit`` tokens of its start: at a sentence or line end if one lies past the cut and
    the overlap, else a word end, else any position that splits no character.
    """
    n = len(starts)
    whole = np.concatenate([starts >= 0, [True]])
    cls = np.where(whole, kind[_char_at(starts, len(kind) - 1)], -1)
    any_, word, sentence = _last_at(whole), _last_at(cls >= 1), _last_at(cls >= 2)
    cut = np.arange(n + 1)
    begin = np.where(cut == 0, 0, np.maximum(any_[np.maximum(cut - overlap, 0)], 0))
    end = np.minimum(begin + limit, n)
    past = np.maximum(cut, begin + overlap)  # else the piece could not share its overlap with the next
    nxt = np.where(sentence[end] > past, sentence[end], np.where(word[end] > past, word[end], np.where(any_[end] > past, any_[end], end)))
    nxt = np.where(end == n, n, nxt)
    return nxt, begin


def greedy_cuts(nxt: np.ndarray) -> np.ndarray:
    """All positions reached from 0 through ``nxt``, by squaring the successor table."""
    n = len(nxt) - 1
    reached = np.zeros(n + 1, dtype=bool)
    reached[0] = True
    jump, count = nxt, 1
    while True:
        reached[jump[reached]] = True
        now = int(reached.sum())
        if now == count:
            return np.flatnonzero(reached)
        jump, count = jump[jump], now


def split_text(text: str, starts: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """``(first token, token after the last, first char, char after the last)`` of each piece."""
    n = len(starts)
    at = _char_at(starts, len(text))
    nxt, begin = successors(starts, boundary_classes(text), limit, overlap)
    cuts = greedy_cuts(nxt)
    return [(int(begin[c]), int(nxt[c]), int(at[begin[c]]), int(at[nxt[c]])) for c in cuts if c < n]


def split_documents(
    documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, tokenizer: str = tokens.TOKENIZER
) -> DataFrame:
    """Pieces of every text above ``limit`` tokens: doc_id, piece_no, first_token, n_tokens, n_pieces, text.

    Consecutive pieces share ``overlap`` tokens (more where that would split a character).
    Tokens are those of the whole text. Texts of at most ``limit`` tokens, null and empty ones
    give no rows, nor do rows without a doc_id. Where a token is known to hold a byte or more, texts of at most ``limit``
    bytes never reach Python.
    """
    if not 0 <= overlap <= limit - LEAST_STEP:
        raise ValueError(f"the overlap must be at least {LEAST_STEP} tokens shorter than the limit")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                starts = tokens.load(tokenizer).starts(text)
                if len(starts) <= limit:
                    continue
                pieces = split_text(text, starts, limit, overlap)
                out += [(doc, i, a, b - a, len(pieces), text[c:d]) for i, (a, b, c, d) in enumerate(pieces)]
            yield pd.DataFrame(out, columns=["doc_id", "piece_no", "first_token", "n_tokens", "n_pieces", "text"])

    least = limit if tokens.bytewise(tokenizer) else 0
    long = documents.where((F.octet_length("text") > least) & F.col("doc_id").isNotNull()).select("doc_id", "text")
    return spread(long).mapInPandas(run, "doc_id bigint, piece_no int, first_token int, n_tokens int, n_pieces int, text string")
