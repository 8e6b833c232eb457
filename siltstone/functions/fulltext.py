"""Keyword search over texts: analysers, search boxes, ranks and headlines.

The ``simple`` analyser takes lower-case words as they are. ``english`` and
``french`` leave out stop words and take the others' stems (see ``stemmers``).
``operators.postings`` answers the same searches from a stored index.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.stemmers import STEMMERS


def lexemes(text: Column | str) -> Column:
    """The words of a text in order, lower case: runs of letters and digits."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


class Phrase(NamedTuple):
    """Terms with their distances from the first one, and whether a text must not have them so."""

    minus: bool
    terms: tuple[tuple[str, int], ...]


def parsed(search: str, analyser: str = "simple") -> list[list[Phrase]]:
    """A search box's text as alternatives, each a list of what must hold together.

    All words, ``"a phrase"``, ``-without`` and ``or``. Words are analysed like a
    text's, and those that an analyser leaves out ask for nothing; in a phrase
    they keep their place.
    """
    stop, stem = STOP_WORDS[analyser], STEMMERS[analyser] or (lambda w: w)
    groups: list[list[Phrase]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', search):
        if word.lower() == "or" and not minus:
            groups.append([])
            continue
        found = [(stem(w), k) for k, w in enumerate(_words(phrase or word)) if w not in stop]
        if found:
            groups[-1].append(Phrase(bool(minus), tuple((t, k - found[0][1]) for t, k in found)))
    return [g for g in groups if g]


def _has_phrase(words: Column, phrase: Phrase) -> Column:
    if len(phrase.terms) == 1:
        return F.array_contains(words, phrase.terms[0][0])
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return F.contains(joined, F.lit(f" {' '.join(t for t, _ in phrase.terms)} "))


def matches(words: Column, search: str) -> Column:
    """Whether a text's words answer a search (see ``parsed``; the simple analyser).

    Nothing to look for matches nothing. The words are worked out once for all
    conditions.
    """
    groups = parsed(search)
    if not groups:
        return F.lit(False)
    holds = lambda w, p: ~_has_phrase(w, p) if p.minus else _has_phrase(w, p)
    return F.exists(F.array(words), lambda w: reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [holds(w, p) for p in g]) for g in groups]))


def says(text: Column, search: str) -> Column:
    """What ``matches`` says of a text's words, found in the text itself.

    A word or phrase is one pattern over the lower-case text, so no list of words
    is made of it.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda term: F.contains(low, F.lit(max(term, key=len))) & low.rlike(r"(?<![\p{L}\p{N}])" + r"[^\p{L}\p{N}]+".join(map(re.escape, term)) + r"(?![\p{L}\p{N}])")
    holds = lambda p: ~has([t for t, _ in p.terms]) if p.minus else has([t for t, _ in p.terms])
    filled = [reduce(lambda a, b: a & b, [holds(p) for p in g]) for g in parsed(search)]
    return reduce(lambda a, b: a | b, filled) if filled else F.lit(False)


#: Words that say nothing of a text.
STOP_WORDS = {
    "simple": (),
    "english": tuple("a an and are as at be been but by for from had has have he her his i if in into is it its me my no not of on or our she so than that the their them then there these they this to was we were what when which who will with would you your".split()),
    "french": tuple("à au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui ma mais me mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sont sur ta te tes toi ton tu un une vos votre vous d l c j m n s t y".split()),
}


def stems(words: Column, analyser: str) -> Column:
    """The stems of a list of words: an Arrow function that stems each distinct word of a batch once."""
    stem = STEMMERS[analyser]
    if stem is None:
        return words

    @F.arrow_udf("array<string>")
    def run(batch: pa.Array) -> pa.Array:
        coded = batch.flatten().dictionary_encode()
        made = pa.array([None if w is None else stem(w) for w in coded.dictionary.to_pylist()], pa.string())
        bounds = np.concatenate([[0], np.cumsum(batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), made.take(coded.indices), mask=batch.is_null())

    return run(words)


def analysed(text: Column | str, analyser: str = "simple") -> Column:
    """The terms of a text in order, by an analyser; a null text has none."""
    words = lexemes(text)
    if stop := STOP_WORDS[analyser]:
        words = F.filter(words, lambda w: ~w.isin(*stop))
    return stems(words, analyser)


def term_rank(terms: Column, asked: list[str]) -> Column:
    """How well a text answers any of several terms, from 0 to 0.1.

    Each term's n occurrences give 1 + 1/4 + ... + 1/n^2, as a share of all such a
    sum can be; the mean over the terms asked for, weighed as a database weighs
    plain text.
    """
    limit, weight = 1.64493406685, 0.1  # fixed values: the sum without end, and the weight
    n = lambda term: F.size(F.filter(terms, lambda w: w == term))
    sums = [F.when(n(t) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n(t), F.lit(1))), F.lit(0.0), lambda s, k: s + F.lit(1.0) / (k * k))).otherwise(F.lit(0.0)) for t in asked]
    return reduce(lambda a, b: a + b, sums) * (weight / limit / len(asked))


def rank(words: Column, terms: list[str]) -> Column:
    """The share of a text's words that are search terms, damped by its length."""
    hits = F.size(F.filter(words, lambda w: w.isin(terms)))
    return hits / (1.0 + F.log(F.greatest(F.size(words), F.lit(1)).cast("double")))


def headline(text: Column, terms: list[str], words: int = 35, before: int = 10, fragments: int = 2, least: int = 15, between: str = " … ") -> Column:
    """Up to ``fragments`` runs of ``words`` words around hits, hits in bold.

    A run begins ``before`` words ahead of its first hit, and the next one with
    the first hit behind it. Without a hit, the first ``least`` words.
    """
    shown = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    is_hit = lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", "").isin(terms)
    bold = F.transform(shown, lambda w: F.when(is_hit(w), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w))
    hits = F.filter(F.transform(shown, lambda w, i: F.when(is_hit(w), i)), lambda i: i.isNotNull())

    def add(starts: Column, hit: Column) -> Column:
        end = F.coalesce(F.try_element_at(starts, F.lit(-1)) + words, F.lit(0))
        fits = (F.size(starts) < fragments) & (hit >= end)
        return F.when(fits, F.concat(starts, F.array(F.greatest(hit - before, end)))).otherwise(starts)

    starts = F.aggregate(hits, F.array().cast("array<int>"), add)
    parts = F.transform(starts, lambda s: F.array_join(F.slice(bold, s + 1, F.lit(words)), " "))
    return F.when(F.size(hits) == 0, F.array_join(F.slice(shown, 1, least), " ")).otherwise(F.array_join(parts, between))


def covers(marks: list[int | None], most: int) -> list[tuple[int, int, int]]:
    """The covers of a text's words: ``(distinct terms, first, last)`` of runs of at most ``most`` words.

    ``marks`` has each word's term number, or None. A cover is a run that no
    shorter run inside it equals in distinct terms: those of its first and its last
    word are there once.
    """
    hits = [k for k, m in enumerate(marks) if m is not None]
    found = []
    for place, first in enumerate(hits):
        seen = {marks[first]}
        found.append((1, first, first))
        for k in hits[place + 1 :]:
            if k - first >= most or marks[k] == marks[first]:
                break
            if marks[k] not in seen:
                seen.add(marks[k])
                found.append((len(seen), first, k))
    return found


def _fragments(shown: list[str], marks: list[int | None], words: int, least: int, fragments: int, between: str) -> str:
    """The best covers that don't overlap, stretched to ``least`` words and joined in order."""
    taken: list[tuple[int, int]] = []
    for _, first, last in sorted(covers(marks, words), key=lambda c: (-c[0], c[2] - c[1], c[1])):
        if len(taken) == fragments:
            break
        # Stretch evenly, inside the text and clear of the runs taken before.
        low = max((b + 1 for a, b in taken if b < first), default=0)
        high = min((a - 1 for a, _ in taken if a > last), default=len(shown) - 1)
        if any(a <= last and first <= b for a, b in taken):
            continue
        room = max(0, least - (last - first + 1))
        begin = max(low, first - room // 2)
        end = min(high, max(last, begin + least - 1))
        begin = max(low, min(begin, end - least + 1))
        taken.append((min(begin, first), max(end, last)))
    if not taken:
        return " ".join(shown[:least])
    bold = lambda k: f"<b>{shown[k]}</b>" if marks[k] is not None else shown[k]
    return between.join(" ".join(bold(k) for k in range(a, b + 1)) for a, b in sorted(taken))


def best_fragments(text: Column, search: str, analyser: str = "simple", words: int = 35, least: int = 15, fragments: int = 2, between: str = " … ") -> Column:
    """Up to ``fragments`` runs of a text that answer a search best, hits in bold.

    A run is a cover, the shortest run with the most of the asked terms, of at
    most ``words`` words and stretched to ``least``; runs don't overlap, those of
    more terms come before shorter ones, and these before earlier ones. Terms are
    matched by their stems. A text without a hit gives its first ``least`` words.
    Meant for the few rows that a page of results shows: each is worked out by itself.
    """
    terms = {t: k for k, t in enumerate(sorted({t for g in parsed(search, analyser) for p in g if not p.minus for t, _ in p.terms}))}
    stem = STEMMERS[analyser] or str

    def mark(word: str) -> int | None:
        return next((terms[t] for w in _words(word) if (t := stem(w)) in terms), None)

    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        split = [None if t is None else t.split() for t in batch.to_pylist()]
        return pa.array([None if w is None else _fragments(w, [mark(x) for x in w], words, least, fragments, between) for w in split], pa.string())

    return run(text)
