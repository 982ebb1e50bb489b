"""Made-up texts for tests."""

from __future__ import annotations


def prose(seed: int, words: int = 60) -> str:
    """Words that no other seed shares, so that texts are not near copies."""
    return " ".join(f"w{(seed * 7919 + i * 104729) % 1000003}x{i}" for i in range(words))
