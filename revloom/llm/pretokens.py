"""Pre-tokens of byte-level BPE: the pattern that cuts a text before any merge.

The public pattern needs Unicode classes. Texts that hold only ASCII, Latin letters up to U+024F
and common punctuation take an equal pattern with those classes spelt out for the ``re`` module,
which is several times faster; all other texts take the public pattern itself.
"""

from __future__ import annotations

import re
from functools import lru_cache

import regex

# The public pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Letters, numbers and white space below U+0250.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = "\t-\r \u0085 "

# Controls are left to the public pattern, as are all characters above, but for dashes and quotes.
_ELSEWHERE = re.compile("[^\t-\r -~ -ɏ‐-‧€]")
_NEAR = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+"
    f"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)


@lru_cache(maxsize=4)
def _public(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def is_near(text: str) -> bool:
    """Whether the fast pattern gives the same as the public one."""
    return _ELSEWHERE.search(text) is None


def split(text: str, pattern: str = PATTERN) -> list[str]:
    """The matches of ``pattern`` in order; together they are the text."""
    if pattern == PATTERN and is_near(text):
        return _NEAR.findall(text)
    return _public(pattern).findall(text)
