"""The first split of a byte-level tokenizer, and its alphabet."""

from __future__ import annotations

import re

import regex

# The pattern that cuts text into words before byte-level merges.
GENERAL = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

#: The same split for texts without UNCOMMON characters, whose letters can be listed; re is faster then.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-į"
QUICK = re.compile(rf"""'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+""")
UNCOMMON = re.compile("[^\t\n\r\x20-\x7e¡-±´-¸º»¿-į–—‘-”…]")


def split(text: str) -> list[str]:
    """The words of text, in order; joined they give text again."""
    return (GENERAL if UNCOMMON.search(text) else QUICK).findall(text)


def alphabet() -> list[str]:
    """The printable character that stands for each byte value."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(kept) else chr(next(spare)) for b in range(256)]


ALPHABET = alphabet()
BYTE_OF = {c: b for b, c in enumerate(ALPHABET)}
_FROM_LATIN = {b: c for b, c in enumerate(ALPHABET) if chr(b) != c}
_SPACE = ALPHABET[0x20]
_PLAIN = re.compile(r"[\x20-\x7e]*").fullmatch


def spelled(word: str) -> str:
    """word in the alphabet of bytes."""
    if _PLAIN(word):
        return word.replace(" ", _SPACE)
    return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(_FROM_LATIN)
