"""Tokens of a byte-level rank file by its own library, for operators that need the ids and no merging of their own."""

from __future__ import annotations

import re
from functools import lru_cache

import tiktoken

from .byte_bpe import codec, read_ranks


class RankTokens:
    """The ids of whole texts, each match of the pattern separately."""

    #: The library's search for matches overflows its stack in very long white space; such texts go another way.
    BLANK = re.compile(r"\s{1000}")

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern
        ranks = {token: rank for rank, token in enumerate(read_ranks(path))}
        self.size = len(ranks)
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> list[int]:
        # a run that long holds the eight characters after some multiple of 500; few texts have to be searched
        if any(text[i : i + 8].isspace() for i in range(0, len(text), 500)) and self.BLANK.search(text):
            return memoryview(codec(self.path, self.pattern).encode([text])[0]).cast("I").tolist()
        return self.encode(text)


@lru_cache(2)
def rank_tokens(path: str, pattern: str) -> RankTokens:
    return RankTokens(path, pattern)
