"""Many patterns over one text in one pass: an Aho-Corasick automaton of all literals that the patterns stand for.

The patterns of this library are words and phrases with word boundaries, a few alternatives, and gaps. ``expand``
writes such a pattern as its literals: those that it begins with and, after a gap, those that it ends with. All
literals of all patterns are one automaton, built once in each worker; boundaries, gaps, spaces and negation are
checked where it stops. Cost is one step a character, whatever the number of patterns.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable
from functools import lru_cache
from itertools import product

import ahocorasick

from . import vocabulary as V

TOKEN = re.compile(r"[a-z]+(?:'[a-z]+)?")
_PART = re.compile(r"\\b|\(\?:([^()]*)\)(\??)|\[([^\]]*)\](\??)|\.\{0,(\d+)\}|\\s\+|\\(.)(\??)|(.)(\??)")


def expand(pattern: str) -> tuple[list[str], int | None, list[str]]:
    """A pattern's literals, the longest gap after them or None, and the literals after the gap.

    It may hold literal characters, ``\\b`` at the ends of words, ``(?:a|b)``, ``[ab]``, ``?`` after these or a
    character, ``\\s+`` (here one space) and at most one ``.{0,n}``.
    """
    sides: list[list[list[str]]] = [[]]
    gap = None
    at = 0
    while at < len(pattern):
        found = _PART.match(pattern, at)
        group, group_opt, chars, chars_opt, most, escaped, escaped_opt, plain, plain_opt = found.groups()
        at = found.end()
        if found[0] == r"\b":
            continue
        if most is not None:
            if gap is not None:
                raise ValueError(f"more than one gap: {pattern}")
            gap = int(most)
            sides.append([])
            continue
        if group is not None:
            choices, optional = group.split("|"), group_opt
        elif chars is not None:
            choices, optional = list(chars), chars_opt
        elif found[0] == r"\s+":
            choices, optional = [" "], ""
        else:
            choices, optional = [escaped or plain], escaped_opt or plain_opt
            if escaped is None and plain in "*+.|()[]{}^$":
                raise ValueError(f"not a pattern of words: {pattern}")
        sides[-1].append([*choices, ""] if optional else choices)
    words = [["".join(p) for p in product(*side)] for side in sides]
    return words[0], gap, words[1] if gap is not None else []


def _is_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


def negated(words: list[str], window: int = 6) -> bool:
    """Whether a negation is among the last words before a match; ``no only`` and ``not only`` are none."""
    last = words[-window:]
    for k, word in enumerate(last):
        after = last[k + 1] if k + 1 < len(last) else None
        if word in V.NEGATIONS and not (word in ("no", "not") and after == "only"):
            return True
        if after is not None and f"{word} {after}" in V.NEGATION_PAIRS:
            return True
    return False


class Matcher:
    """Patterns by number, and plain phrases, over lower-case texts."""

    def __init__(self, patterns: Iterable[str], phrases: Iterable[str] = ()):
        self.patterns, literals = list(patterns), {}
        self.gaps: dict[int, int] = {}
        #: pattern numbers for which a run of white space counts as one space
        self.loose = {k for k, p in enumerate(self.patterns) if r"\s+" in p}
        for k, pattern in enumerate(self.patterns):
            heads, gap, tails = expand(pattern)
            for word in heads:
                literals.setdefault(word, []).append((k, "head"))
            for word in tails:
                literals.setdefault(word, []).append((k, "tail"))
            if gap is not None:
                self.gaps[k] = gap
        for phrase in phrases:
            literals.setdefault(phrase, []).append((phrase, "phrase"))
        self.automaton = ahocorasick.Automaton()
        for word, uses in literals.items():
            self.automaton.add_word(word, (len(word), uses))
        if literals:
            self.automaton.make_automaton()

    def _spans(self, text: str, plain: bool) -> tuple[dict, dict, set]:
        heads: dict[int, list] = {}
        tails: dict[int, list] = {}
        phrases: set = set()
        for last, (size, uses) in self.automaton.iter(text) if len(self.automaton) else ():
            begin, end = last + 1 - size, last + 1
            bounded = not _is_word(text, begin - 1) and not _is_word(text, end)
            for k, use in uses:
                if use == "phrase":
                    phrases.add(k)
                elif bounded and plain != (k in self.loose):
                    (heads if use == "head" else tails).setdefault(k, []).append((begin, end))
        return heads, tails, phrases

    def find(self, text: str) -> tuple[dict[int, bool], set[str]]:
        """Patterns that match, each with whether a match of it is not negated, and phrases that occur."""
        heads, tails, phrases = self._spans(text, True)
        out = self._judged(text, heads, tails)
        if self.loose:
            even = re.sub(r"\s+", " ", text)
            more, *_ = self._spans(even, False)
            out |= self._judged(even, more, {})
        return out, phrases

    def _judged(self, text: str, heads: dict[int, list], tails: dict[int, list]) -> dict[int, bool]:
        out: dict[int, bool] = {}
        if not heads:
            return out
        tokens = list(TOKEN.finditer(text))
        ends, names = [t.end() for t in tokens], [t[0] for t in tokens]
        for k, spans in heads.items():
            upto = -1
            for begin, end in sorted(spans):
                if begin < upto:
                    continue
                if k in self.gaps:
                    # the furthest end within the gap, on one line
                    line = text.find("\n", end)
                    reach = [t for t in tails.get(k, []) if end <= t[0] <= end + self.gaps[k] and (line < 0 or t[0] <= line)]
                    if not reach:
                        continue
                    end = max(e for _, e in reach)
                upto = end
                if not out.get(k):
                    known = bisect_left(ends, begin + 1)
                    before = names[:known]
                    # a word that the match begins within is cut at the match
                    if known < len(tokens) and tokens[known].start() < begin:
                        before = [*before, *TOKEN.findall(text[tokens[known].start() : begin])]
                    out[k] = not negated(before)
        return out


@lru_cache(4)
def matcher(patterns: tuple[str, ...], phrases: tuple[str, ...] = ()) -> Matcher:
    """The automaton of these patterns, built once in each process."""
    return Matcher(patterns, phrases)
