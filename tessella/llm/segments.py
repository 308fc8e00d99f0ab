"""Texts in segments that tokenizers treat one by one, and a bounded memo of what segments give.

A segment ends before a single blank or line feed that stands between two characters that are
no white space. Vocabularies whose pieces never reach from a character into a blank or line
feed behind it have a border there, whatever stands around, so a text's tokens are those of
its segments one after another. Longer runs of white space stay inside a segment.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import Any

# U+180E counts as white space in some Unicode versions only, so nothing is cut beside it.
_CUT = re.compile(r"(?:\A[\s᠎]+|[ \n])?[^\s᠎]+(?:(?:[\s᠎]{2,}|[^\S \n]|᠎)[^\s᠎]+)*(?:[\s᠎]+\Z)?")


def segments(text: str) -> list[str]:
    """The segments of a text; joined they are the text. An empty text has none."""
    return _CUT.findall(text) or [text][: len(text)]


class Memo:
    """What solve() gives for segments, for the last segments met: two generations of at most limit each.

    Segments of over longest characters are forgotten at once.
    """

    def __init__(self, solve: Callable[[list[str]], Iterable[Any]], limit: int, longest: int = 64) -> None:
        self._solve, self._limit, self._longest = solve, limit, longest
        self._young: dict[str, Any] = {}
        self._old: dict[str, Any] = {}
        self._passing: list[str] = []

    def of(self, words: set[str]) -> dict[str, Any]:
        """A dictionary that holds all these words, good until the next call."""
        for w in self._passing:
            del self._young[w]
        if len(self._young) > self._limit:
            self._old, self._young = self._young, {}
        young, old, unknown = self._young, self._old, []
        for w in words.difference(young):
            if w in old:
                young[w] = old[w]
            else:
                unknown.append(w)
        if unknown:
            young.update(zip(unknown, self._solve(unknown), strict=True))
        self._passing = [w for w in unknown if len(w) > self._longest]
        return young
