"""Phrases of a dictionary in texts, by one automaton over all of them.

A text is read once, whatever the number of phrases; retrieval.matched_words asks for each phrase in turn.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases from which on one automaton is used instead of a test for each.
MANY = 64


@functools.lru_cache(maxsize=8)
def automaton(phrases: tuple[str, ...]):
    """Finds the numbers of phrases; built once in each worker."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, phrase in enumerate(phrases):
        if phrase:
            found.add_word(phrase, (*found.get(phrase, ()), i))
    found.make_automaton()
    return found


def held(phrases: tuple[str, ...], text: str | None) -> set[int]:
    """Numbers of the phrases that occur anywhere in a text; the empty one occurs in every text but null."""
    if text is None:
        return set()
    found, out = automaton(phrases), {i for i, p in enumerate(phrases) if not p}
    if len(found):
        for _, numbers in found.iter(text):
            out.update(numbers)
    return out


def phrases_in(text: Column, phrases: tuple[str, ...]) -> Column:
    """Array of the phrases in a text, in the dictionary's order."""

    @F.pandas_udf("array<string>")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [phrases[i] for i in sorted(held(phrases, t))])

    return find(text)


def matched(text: Column, words: dict[str, tuple[str, ...]]) -> Column:
    """Array of (name, count, pos) of the names whose words occur in the lower-case text, as
    retrieval.matched_words gives it."""
    names, owner = list(words), [i for i, ws in enumerate(words.values()) for _ in ws]
    phrases = tuple(w for ws in words.values() for w in ws)

    @F.pandas_udf("array<struct<name: string, count: int, pos: int>>")
    def find(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[dict]:
            count: dict[int, int] = {}
            for i in held(phrases, text):
                count[owner[i]] = count.get(owner[i], 0) + 1
            return [{"name": names[i], "count": count[i], "pos": i} for i in sorted(count)]

        return texts.map(one)

    return find(F.lower(text))
