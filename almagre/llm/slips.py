"""Hashes of a token's parts in time linear in its length, so that words of any length are indexed whole."""

from __future__ import annotations

MODULUS, BASE = (1 << 61) - 1, 911_382_323


class Hashed:
    """A token with the rolling hashes of its prefixes; the hash of any part, or of the token without a letter, is one step."""

    def __init__(self, token: str) -> None:
        self.n = len(token)
        self.heads, self.powers = [0], [1]
        for c in token:
            self.heads.append((self.heads[-1] * BASE + ord(c) + 1) % MODULUS)
            self.powers.append(self.powers[-1] * BASE % MODULUS)

    def part(self, begin: int, end: int) -> int:
        """The hash of ``token[begin:end]``."""
        return (self.heads[end] - self.heads[begin] * self.powers[end - begin]) % MODULUS

    def whole(self) -> int:
        return self.heads[self.n]

    def suffixes(self, least: int) -> set[int]:
        """The suffixes of at least so many letters; a shorter token's only one is itself."""
        return {self.part(i, self.n) for i in range(max(1, self.n - least + 1))}

    def prefixes(self, most: int) -> set[int]:
        """The prefixes of one to ``most`` letters."""
        return set(self.heads[1 : most + 1])

    def less_one(self) -> set[int]:
        """The token and all it becomes without one letter: tokens that lost at most one letter to each other share one of these."""
        if self.n < 3:
            return {self.whole()}
        return {self.whole()} | {(self.heads[i] * self.powers[self.n - 1 - i] + self.part(i + 1, self.n)) % MODULUS for i in range(self.n)}


def lost(a: str, b: str) -> int:
    """Letters of the longer token outside the longest common subsequence: 0, 1, or 2 for two and more."""
    if a == b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return 2
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    if len(a) < len(b):
        return 1 if a[i:] == b[i + 1 :] else 2
    # one letter goes from each, one of them at the first difference
    return 1 if _without_one(a[i + 1 :], b[i:]) or _without_one(b[i + 1 :], a[i:]) else 2


def _without_one(short: str, long: str) -> bool:
    """Whether a text is another one without one letter."""
    i = next((k for k, (x, y) in enumerate(zip(short, long, strict=False)) if x != y), len(short))
    return short[i:] == long[i + 1 :]
