"""A bounded memory of what was made of recently seen words, for tokenizers in Python workers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

#: Fixed value: ASCII marks that end a word and, alone, are one match of the usual split patterns (no apostrophe).
MARKS = frozenset(".,;:!?")


class Recent:
    """make(words) gives bytes for each word. The younger of two generations turns old at `entries` words or `chars`
    characters, and the old one goes: at most about twice that is kept, and frequent words stay."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], entries: int = 400_000, chars: int = 16_000_000):
        self.make, self.entries, self.chars = make, entries, chars
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def joined(self, texts: list[list[str]]) -> list[bytes]:
        """For each list of words, the bytes of all its words in a row."""
        young, old, ask = self.young, self.old, []
        for word in set().union(*texts).difference(young):
            got = old.get(word)
            if got is None:
                ask.append(word)
            else:
                young[word] = got
            self.size += len(word)
        young.update(zip(ask, self.make(ask)))
        out = [b"".join(map(young.__getitem__, words)) for words in texts]
        if len(young) > self.entries or self.size > self.chars:
            self.old, self.young, self.size = young, {}, 0
        return out


def groups(texts: Iterable, chars: int = 250_000) -> Iterator[list]:
    """The texts (or bytes), whole and in order, in lists of about so many characters; a null text is an empty one."""
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held
