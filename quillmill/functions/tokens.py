"""Token counters of the chunker: words, or a public byte-level BPE whose rank file is named by its path."""

from __future__ import annotations

import base64
from functools import lru_cache

#: The published pre-tokenisation pattern of the 50k byte-level vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class WordCounter:
    """Runs without white space; a text of white space only counts as one token, an empty one as none."""

    def size(self, text: str) -> int:
        return max(1, len(text.split())) if text else 0

    def joined(self, sizes: list[int], texts: list[str], between: str) -> int:
        """Size of the texts joined by white space: counts of words add up."""
        return sum(sizes)

    def windows(self, text: str, size: int, overlap: int) -> list[str]:
        """Windows of `size` tokens every max(1, size - overlap); the last may lie inside the one before."""
        words = text.split()
        return [" ".join(words[i : i + size]) for i in range(0, len(words), max(1, size - overlap))]


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str = PATTERN):
    """The encoder of a rank file, made once in each process."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class BpeCounter:
    """Tokens of a byte-level BPE; joined texts are encoded anew, as counts of parts do not add up."""

    def __init__(self, path: str, pattern: str = PATTERN):
        self.path, self.pattern = path, pattern

    def size(self, text: str) -> int:
        return len(encoding(self.path, self.pattern).encode_ordinary(text)) if text else 0

    def joined(self, sizes: list[int], texts: list[str], between: str) -> int:
        return self.size(between.join(texts))

    def windows(self, text: str, size: int, overlap: int) -> list[str]:
        encoder = encoding(self.path, self.pattern)
        tokens = encoder.encode_ordinary(text)
        return [encoder.decode(tokens[i : i + size]).strip() for i in range(0, len(tokens), max(1, size - overlap))]


Counter = WordCounter | BpeCounter
