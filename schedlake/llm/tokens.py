"""Token counts and token starts of a public tokenizer, named by a path parameter."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np

#: Default vocabulary file; every operator takes another path.
TOKENIZER = os.environ.get("SCHEDLAKE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the published pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class RankTokenizer:
    """Byte-level pairs from a file of ranks. Every byte is in one token, so starts follow from lengths."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for piece, i in ranks.items():
            self.length[i] = len(piece)

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def starts(self, text: str) -> np.ndarray:
        size = self.length[np.array(self.encoding.encode_ordinary(text), dtype=np.int64)]
        at = np.cumsum(size) - size
        if text.isascii():
            return at
        lead = (np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80
        return np.where(lead[at], np.cumsum(lead)[at] - 1, -1)


class FileTokenizer:
    """A tokenizer file with its own rules; special strings in a text are ordinary text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.tok.no_padding()
        self.tok.no_truncation()

    def count(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False))

    def starts(self, text: str) -> np.ndarray:
        at = np.array([a for a, _ in self.tok.encode(text, add_special_tokens=False).offsets], dtype=np.int64)
        at[1:][at[1:] == at[:-1]] = -1
        return at


def bytewise(path: str) -> bool:
    """Whether every token of the tokenizer holds a byte or more of the text, so a text has at most as many tokens as bytes."""
    return not path.endswith(".json")


@lru_cache(maxsize=4)
def load(path: str) -> RankTokenizer | FileTokenizer:
    """The tokenizer of a file: ``.tiktoken`` holds ranks, ``.json`` a whole tokenizer.

    ``count(text)`` is its number of tokens; ``starts(text)`` the character each token starts
    at, -1 for a token that starts inside a character. An empty text has no tokens.
    """
    return FileTokenizer(path) if path.endswith(".json") else RankTokenizer(path)
