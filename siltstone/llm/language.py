"""Language identification by cross-parsing (operator 7).

For each language a suffix automaton is built over labelled text. A text is
parsed against it: each phrase is the longest run of the remaining text that
occurs in the labelled text. A text of the automaton's language needs few, long
phrases. A phrase costs the bits that say where in the labelled text it lies, or
which symbol it is, so that a short labelled text, which gives shorter phrases,
is held against long ones; the language of the least cost wins.

The automata are one hash table from (state, symbol) to the next state, and a
phrase that finds no next state ends there, whatever follows. All texts of a slice
are parsed at once, in all languages, a symbol at a time. Long texts are cut into
blocks for that, each first parsed as if a phrase began with it; then the true
state at a block's begin is carried in from the block before it, and the two
parses are followed until they meet, which changes the count by what they differ.
So the counts are those of the whole text, whatever the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from siltstone.llm import arrays
from siltstone.llm.columns import map_arrow, quoted, without

SLICE_BYTES = 2 << 20
BLOCK_CHARS = 512
#: The labelled sample of each language: so many documents, and so many characters of all of them together.
SAMPLE_DOCS = 200
SAMPLE_CHARS = 30_000
MOST_LABELS = 1000
#: Characters of all languages' samples together: their automata have twice as many states at most and
#: three times as many transitions, of which one of each state isn't hashed, so they hold fewer than 150 MB.
TOTAL_CHARS = 1 << 20
#: A text that gives only a part of itself gives passages of about so many characters, spread over all of it.
PASSAGE_CHARS = 300
UNDETERMINED = "und"


_MIX = np.uint64(0x9E3779B97F4A7C15)


class Parser(NamedTuple):
    """The automata of all languages, with states numbered through.

    Most states go on by one symbol, or by one above all: that one is looked up by
    the state alone, and only the others of a state that branches are hashed.
    """

    languages: list[str]
    symbols: np.ndarray  # of each code point; 0: met in no sample
    width: int  # symbols, and 0
    main: np.ndarray  # of each state the symbol it goes on by most often; -1: none
    to: np.ndarray  # and where to
    branches: np.ndarray  # whether there are others
    keys: np.ndarray  # hash table of state * width + symbol + 1 of these; 0: free
    following: np.ndarray  # the next state
    begun: np.ndarray  # (languages, symbols): the state after a phrase's first symbol
    lengths: np.ndarray  # of each language's sample, in symbols

    def after(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next states, or -1 where a phrase ends before ``symbol``."""
        flat = state.ravel()
        now = np.broadcast_to(symbol, state.shape).ravel()
        same = self.main[flat] == now
        out = np.where(same, self.to[flat], -1)
        rest = np.flatnonzero(self.branches[flat] & ~same)
        if len(rest):
            key = flat[rest].astype(np.int64) * self.width + now[rest] + 1
            slot = _slots(key, len(self.keys))
            met = self.keys[slot]
            out[rest] = np.where(met == key, self.following[slot], -1)
            on = np.flatnonzero((met != key) & (met != 0))
            while len(on):
                slot[on] = (slot[on] + 1) & (len(self.keys) - 1)
                met = self.keys[slot[on]]
                hit = met == key[on]
                out[rest[on[hit]]] = self.following[slot[on[hit]]]
                on = on[~hit & (met != 0)]
        return out.reshape(state.shape)


def _slots(key: np.ndarray, size: int) -> np.ndarray:
    return ((key.astype(np.uint64) * _MIX) >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)


def _hash_table(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Open addressing, at most a quarter full."""
    size = 1 << max(4, (4 * len(key)).bit_length())
    keys, values = np.zeros(size, np.int64), np.zeros(size, np.int32)
    slot, left = _slots(key, size), np.arange(len(key))
    while len(left):
        free = keys[slot[left]] == 0
        _, first = np.unique(slot[left][free], return_index=True)
        won = left[free][first]
        keys[slot[won]], values[slot[won]] = key[won], value[won]
        left = np.setdiff1d(left, won)
        slot[left] = (slot[left] + 1) & (size - 1)
    return keys, values


def suffix_automaton(symbols: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """The transitions of the least automaton of all substrings, and how often each state's substrings occur.

    State 0 is the root.
    """
    following: list[dict[int, int]] = [{}]
    link, length, times, last = [-1], [0], [0], 0
    for c in symbols:
        current, p = len(following), last
        following.append({}), length.append(length[last] + 1), link.append(0), times.append(1)
        while p >= 0 and c not in following[p]:
            following[p][c] = current
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[p] + 1 == length[q]:
                link[current] = q
            else:
                copy = len(following)
                following.append(dict(following[q])), length.append(length[p] + 1), link.append(link[q]), times.append(0)
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = copy
                    p = link[p]
                link[q] = link[current] = copy
        last = current
    for state in sorted(range(1, len(link)), key=length.__getitem__, reverse=True):
        times[link[state]] += times[state]
    return following, times


def _folded(text: str) -> str:
    """Lower case, and one blank for each run of what is no letter."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def build_parser(samples: dict[str, str]) -> Parser:
    """Automata over one sample text for each language."""
    languages = sorted(samples)
    texts = [" " + _folded(samples[name]) + " " for name in languages]
    alphabet = sorted(set("".join(texts)) - {" "})
    symbol = {" ": 1} | {c: k for k, c in enumerate(alphabet, 2)}
    points = np.zeros(0x110000, np.uint16)
    for c in range(0x110000):
        if not chr(c).isalpha():
            points[c] = 1
    for c, k in symbol.items():
        points[ord(c)] = k
        if len(c.upper()) == 1:
            points[ord(c.upper())] = k
    width, at = len(symbol) + 1, 0
    keys, following, begun = [], [], np.zeros((len(languages), width), np.int32)
    main, to, branches = [], [], []
    for k, text in enumerate(texts):
        states, times = suffix_automaton([symbol[c] for c in text])
        stray = at + len(states)  # after a symbol that the sample lacks, which is a phrase by itself
        begun[k] = stray
        begun[k, list(states[0])] = np.array(list(states[0].values())) + at
        for n, out in enumerate([*states, {}]):
            often = max(out, key=lambda c: (times[out[c]], c)) if out else -1
            main.append(often)
            to.append(at + out.pop(often) if out else -1)
            branches.append(bool(out))
            keys += [(at + n) * width + c + 1 for c in out]
            following += [at + x for x in out.values()]
        at = stray + 1
    table = _hash_table(np.array(keys, np.int64), np.array(following, np.int32))
    return Parser(languages, points, width, np.array(main, np.int32), np.array(to, np.int32), np.array(branches, bool), *table, begun, np.array([len(t) for t in texts]))


def _parse(parser: Parser, column: pa.Array, block_chars: int = BLOCK_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Phrases (rows by languages) and letters of each row of a slice."""
    data, offsets = arrays.utf8(column)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)])[offsets]
    symbol = parser.symbols[points]
    row = np.repeat(np.arange(len(column)), np.diff(bounds))
    blank = symbol == 1
    again = np.zeros(len(symbol), bool)
    again[1:] = blank[1:] & blank[:-1] & (row[1:] == row[:-1])
    letters = np.bincount(row[~blank], minlength=len(column))
    symbol, row = symbol[~again].astype(np.int64), row[~again]
    rows = np.searchsorted(row, np.arange(len(column) + 1))
    blocks = -(-np.diff(rows) // block_chars)
    owner = np.repeat(np.arange(len(column)), blocks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = rows[owner] + block_chars * number
    size = np.minimum(rows[owner + 1] - start, block_chars)
    phrases, end = _from_the_root(parser, symbol, start, size)
    # True states are carried from block to block until none changes.
    base, base_end = phrases.copy(), end.copy()
    changed = np.broadcast_to(number > 0, phrases.shape)
    while changed.any():
        lang, block = np.nonzero(changed)
        more, last = _carried(parser, symbol, start[block], size[block], lang, end[lang, block - 1])
        phrases[lang, block] = base[lang, block] + more
        last = np.where(last < 0, base_end[lang, block], last)
        moved = last != end[lang, block]
        end[lang, block] = last
        changed = np.zeros(phrases.shape, bool)
        lang, block = lang[moved], block[moved]
        on = np.flatnonzero(block + 1 < len(owner))
        on = on[number[block[on] + 1] > 0]
        changed[lang[on], block[on] + 1] = True
    counts = np.zeros((len(column), len(parser.languages)), np.int64)
    np.add.at(counts, owner, phrases.T)
    return counts, letters


def _from_the_root(parser: Parser, symbol: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases and last states of all blocks (languages by blocks), as if each began a phrase."""
    order = np.argsort(-size, kind="stable")
    first, length = start[order], size[order]
    lang = np.arange(len(parser.languages))[:, None]
    state = parser.begun[lang, symbol[first]]
    phrases = np.ones(state.shape, np.int64)
    live = np.searchsorted(-length, -np.arange(2, length.max(initial=0) + 1), "right")  # blocks that have each symbol
    for k, n in enumerate(live.tolist(), 1):
        now = symbol[first[:n] + k]
        to = parser.after(state[:, :n], now)
        ended = to < 0
        phrases[:, :n] += ended
        state[:, :n] = np.where(ended, parser.begun[lang, now], to)
    out, end = np.empty_like(phrases), np.empty_like(state)
    out[:, order], end[:, order] = phrases, state
    return out, end


def _carried(parser: Parser, symbol: np.ndarray, start: np.ndarray, size: np.ndarray, lang: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What parsing each block on from ``state`` adds to the phrases of parsing it from the root.

    And the last states, -1 if they are those of the parse from the root.
    """
    more, last = np.zeros(len(start), np.int64), np.full(len(start), -1, np.int64)
    live, root, k = np.arange(len(start)), state, 0
    while len(live):
        now, own, n = symbol[start[live] + k], lang[live], len(live)
        anew = parser.begun[own, now]
        # Both parses in one look-up; at the first symbol a phrase of the parse from the root begins.
        both = parser.after(np.concatenate([state, root]), np.concatenate([now, now])) if k else np.append(parser.after(state, now), np.full(n, -1))
        to, plain = both[:n], both[n:]
        more[live] += (to < 0).astype(np.int64) - (plain < 0)
        state, root = np.where(to < 0, anew, to), np.where(plain < 0, anew, plain)
        k += 1
        apart = state != root
        at_end = apart & (size[live] == k)
        last[live[at_end]] = state[at_end]
        on = apart & ~at_end
        live, state, root = live[on], state[on], root[on]
    return more, last


def learn(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Parser:
    """Build a parser from rows that are ``usable`` and have a label.

    The sample is the ``sample_docs`` rows of each label whose ids hash lowest;
    ``sample_chars`` characters are taken of each label, in shares as equal as
    the texts' lengths allow: few texts give more of each. A text gives all of
    itself or, if that is more than its share, passages from all over it. More
    than MOST_LABELS different labels raise; with more than TOTAL_CHARS / ``sample_chars`` of them
    each one's sample is smaller, so that the automata keep their size. Null
    labels, and texts of repeated rows beyond the first, are not used; null texts
    are empty. A table without labels gives a parser without languages.
    """
    rows = docs.where(usable).select(F.col(quoted(id_col)).alias("id"), F.col(quoted(lang_col)).alias("label"), F.coalesce(quoted(text_col), F.lit("")).alias("text")).where("label IS NOT NULL")
    if rows.select("label").distinct().limit(MOST_LABELS + 1).count() > MOST_LABELS:
        raise ValueError(f"at most {MOST_LABELS} languages can be learned")
    rows = rows.withColumn("tie", F.xxhash64("text"))
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id", "tie")
    # Lengths first: Spark cuts every task's rows down to sample_docs a label before they are shuffled.
    lengths = rows.select("label", "id", "tie", F.length("text").alias("n"))
    chosen = lengths.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample_docs).orderBy("label", "rank").collect()
    by_label: dict[str, dict[tuple, int]] = {}
    for r in chosen:
        by_label.setdefault(r["label"], {})[r["label"], r["id"], r["tie"]] = r["n"]  # repeated rows have one key
    if not by_label:
        return build_parser({})
    chars = min(sample_chars, TOTAL_CHARS // len(by_label))
    take = {key: n for found in by_label.values() for key, n in zip(found, _shares(list(found.values()), chars), strict=True)}
    wanted = docs.sparkSession.createDataFrame([(*key, n) for key, n in take.items()], StructType([*lengths.select(F.col("label").alias("l"), F.col("id").alias("i"), F.col("tie").alias("t")).schema.fields, StructField("take", IntegerType())]))
    held = rows.join(F.broadcast(wanted), (F.col("label") == F.col("l")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t")))
    parts = F.ceil(F.col("take") / PASSAGE_CHARS)
    passage = lambda k: F.substring("text", (F.floor(k.cast("long") * F.length("text") / parts) + 1).cast("int"), F.floor(F.col("take") / parts).cast("int"))
    spread = F.array_join(F.transform(F.sequence(F.lit(0), (parts - 1).cast("int")), passage), "\n")
    given = F.when(F.length("text") <= F.col("take"), F.col("text")).when(F.col("take") > 0, spread).otherwise("")
    texts = {(r["label"], r["id"], r["tie"]): r["text"] for r in held.select("label", "id", "tie", given.alias("text")).distinct().collect()}
    return build_parser({label: "\n".join(texts[key] for key in found) for label, found in by_label.items()})


def _shares(lengths: list[int], chars: int) -> list[int]:
    """How much of each text to take, as equally as their lengths allow, for ``chars`` in all."""
    out, left = [0] * len(lengths), chars
    for done, k in enumerate(sorted(range(len(lengths)), key=lambda k: lengths[k])):
        out[k] = min(lengths[k], left // (len(lengths) - done))
        left -= out[k]
    return out


def phrase_costs(parser: Parser) -> np.ndarray:
    """Bits of a phrase in each language: a place in its sample, or one of the symbols."""
    return np.log2(parser.lengths + parser.width)


def identify(docs: DataFrame, parser: Parser, text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """Add the language of every text and a score from 0 to 1.

    The score is the share of the second-best language's cost that the best
    one saves; texts that parse alike in two languages score near 0. A text that
    is null or has no letter is ``und`` with score 0; ties go to the language that
    sorts first. Whole texts of any length are read; repeated rows stay repeated,
    an empty table stays empty and other columns pass through, but for those with
    the names of the added ones, which these replace. A parser without languages
    finds ``und`` only.
    """
    docs = without(docs, lang_as, score_as)
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        names = pa.array([*tables.languages, UNDETERMINED])
        for part in arrays.slices(batches, text_col, SLICE_BYTES):
            best, score = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows)
            if tables.languages:
                counts, letters = _parse(tables, part.column(part.schema.get_field_index(text_col)))
                costs = counts * phrase_costs(tables)
                best = costs.argmin(1)
                ranked = np.sort(costs, 1)
                if ranked.shape[1] > 1:
                    score = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1)
                else:
                    score = np.ones(part.num_rows)
                best[letters == 0], score[letters == 0] = len(tables.languages), 0.0
            columns = dict(zip(part.schema.names, part.columns, strict=True))
            yield pa.RecordBatch.from_pydict(columns | {lang_as: names.take(pa.array(best)), score_as: pa.array(score)})

    return map_arrow(docs, run, docs.select("*").schema.add(lang_as, "string").add(score_as, "double"))
