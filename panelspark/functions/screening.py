"""One scan of a text for the literals of many patterns and phrase lists: which of them can match at all.

The scan only rules tests out, so a literal may be found too often but never too rarely; the test itself has the last word.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, functions as F

# characters beyond ASCII that a pattern's letters match when case is ignored
_FOLDED = str.maketrans({"ſ": "s", "ı": "i", "İ": "i", "K": "k"})


def fold(text: str) -> str:
    return text.translate(_FOLDED).lower()


def required(pattern: str, most: int = 2) -> list[frozenset[str]]:
    """Up to ``most`` sets of literals in lower case: every match of the pattern contains one of each set."""
    return sorted(_of_sequence(re._parser.parse(pattern, re.IGNORECASE)), key=lambda s: -min(map(len, s)))[:most]


def _of_sequence(items) -> list[frozenset[str]]:
    """The sets that the parts of a sequence, all of which must match, name."""
    found: list[frozenset[str]] = []
    run = ""
    for op, arg in [*items, (None, None)]:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg)
            continue
        if run:
            found.append(frozenset([fold(run)]))
            run = ""
        if name == "SUBPATTERN":
            found += _of_sequence(arg[-1])
        elif name == "MAX_REPEAT" and arg[0] > 0:
            found += _of_sequence(arg[2])
        elif name == "BRANCH":
            each = [max(_of_sequence(branch), key=lambda s: min(map(len, s)), default=None) for branch in arg[1]]
            found += [] if None in each else [frozenset().union(*each)]
    return found


@lru_cache(maxsize=4)
def _automaton(masks: tuple[tuple[str, int], ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for literal, mask in masks:
        found.add_word(literal, mask)
    found.make_automaton()
    return found


class Screen:
    """A number per text with the bits of each pattern (a string) and phrase list; at most 63 bits in all.

    Patterns ignore case, and phrases are compared with the lower-cased text.
    """

    def __init__(self, patterns: list[str], phrases: list[list[str]]):
        tests: dict[object, list[frozenset[str]]] = {p: required(p) for p in patterns}
        tests |= {tuple(p): [frozenset(map(fold, p))] for p in phrases}
        self.bits: dict[object, int] = {}
        masks: dict[str, int] = {}
        used = 0
        for key, sets in tests.items():
            self.bits[key] = 0
            for literals in sets:
                self.bits[key] |= 1 << used
                for x in literals:
                    masks[x] = masks.get(x, 0) | 1 << used
                used += 1
        if used > 63:
            raise ValueError("a screen has at most 63 bits")
        self.masks = tuple(sorted(masks.items()))

    def scan(self, text: str | None) -> int:
        found = 0
        for _, mask in _automaton(self.masks).iter(fold(text or "")):
            found |= mask
        return found

    def of(self, text: Column) -> Column:
        """The number of a text, by one scan in Arrow batches."""

        @F.pandas_udf("long")
        def scanned(texts):
            return texts.map(self.scan).astype("int64")

        return scanned.asNondeterministic()(text)  # else each use of the number scans again

    def may(self, seen: Column, test: str | list[str]) -> Column:
        """Every set of the test's literals was seen; true for a test that names none."""
        mask = F.lit(self.bits[test if isinstance(test, str) else tuple(test)]).cast("long")
        return seen.bitwiseAND(mask) == mask
