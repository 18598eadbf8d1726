"""Oversized texts into overlapping pieces at natural boundaries, by pointer doubling."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.tokens import PATTERN, VOCABULARY, TokenCounter, units

WORD, SENTENCE, PARAGRAPH, CLAIM = 0, 1, 2, 3
SURE = 0.9  # of a run taken apart by characters, the share of its tokens that its parts surely make
FINE = 32  # tokens of the largest unit: how closely an overlap is met
NUMBERED = r"\s*(\d{1,4}\s?[.)．、]|\[\d+\]|[【请]?\s?請?求項)"  # how a claim or numbered paragraph begins
_ENDS = ".!?;。！？；"

PIECES = "piece_no int, start_char int, end_char int, n_tokens int, piece string"


class Units(NamedTuple):
    """A text in units before which it may be cut."""

    parts: list[str]
    most: np.ndarray  # tokens that a unit makes in a piece, from above
    least: np.ndarray  # and from below
    exact: np.ndarray  # tokens, right for sums over whole runs
    inside: np.ndarray  # whether the place before the unit lies inside a run
    total: int  # tokens of the text


def legal_units(text: str, counter: TokenCounter, fine: int) -> Units:
    """Units of at most ``fine`` tokens.

    Larger units are taken apart where the tokenizer's pattern cuts them, which leaves the counts exact, and a single run
    of letters or marks that is still too large by characters, at most four bytes each. Its parts make hardly ever more than the
    tokens they have apart, and at least about their share of the run; what a piece that begins or ends inside a run really has
    must be counted once it is known.
    """
    parts = units(text)
    counts = counter.counts(parts)
    total = int(counts.sum())
    if not len(counts) or counts.max() <= fine:
        return Units(parts, counts, counts.astype(float), counts, np.zeros(len(parts), dtype=bool), total)
    cut, most, least, exact, inside = [], [], [], [], []
    step = max(1, fine // 4)
    for part, n in zip(parts, counts.tolist(), strict=True):
        for run in (part,) if n <= fine else _pattern().findall(part):
            whole = counter[run]
            own = [run] if whole <= fine else [run[i : i + step] for i in range(0, len(run), step)]
            apart = [counter[x] for x in own]
            least += [x * SURE * whole / sum(apart) for x in apart] if len(own) > 1 else apart
            apart[-1] += max(0, whole - sum(apart))
            cut += own
            most += apart
            exact += [0] * (len(own) - 1) + [whole]
            inside += [False] + [True] * (len(own) - 1)
    return Units(cut, np.array(most), np.array(least, dtype=float), np.array(exact), np.array(inside, dtype=bool), total)


@cache
def _pattern():
    import regex

    return regex.compile(PATTERN)


def boundary_levels(parts: list[str], numbered: re.Pattern) -> np.ndarray:
    """For the place before each unit: before a claim or numbered paragraph, a line break, after a sentence, or a word."""
    out = np.zeros(len(parts), dtype=np.int8)
    previous = ""
    for i, part in enumerate(parts):
        if "\n" in part[:3]:
            out[i] = CLAIM if numbered.match(part) else PARAGRAPH
        elif previous and previous[-1] in _ENDS:
            out[i] = SENTENCE
        previous = part
    return out


def greedy_pieces(cum: np.ndarray, least: np.ndarray, level: np.ndarray, first: np.ndarray, end: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end place of every piece, for many texts at once.

    Places are numbered through all texts; ``cum`` has the most and ``least`` the least tokens before each, ``first`` and ``end`` the first
    and last place of each text. Every place is joined to its farthest legal end within ``limit``, at the
    highest level that leaves the piece at least half full, and from there to its successor, the last place that
    repeats at least ``overlap`` tokens. The successor table is then squared until the cuts reached from
    the first places no longer grow: after k rounds they hold the first 2^k cuts of every text.
    """
    n = len(cum)
    place = np.arange(n)
    text = np.searchsorted(end, place)
    last = end[text]
    far = np.minimum(np.searchsorted(cum, cum + limit, side="right") - 1, last)
    far = np.maximum(far, np.minimum(place + 1, last))
    stop = far.copy()
    undecided = far < last
    for want in (CLAIM, PARAGRAPH, SENTENCE):
        seen = np.maximum.accumulate(np.where(level >= want, place, -1))[far]
        take = undecided & (seen > place) & (cum[np.maximum(seen, 0)] - cum[place] >= limit / 2)
        stop[take] = seen[take]
        undecided &= ~take
    back = np.searchsorted(least, least[stop] - overlap, side="right") - 1
    succ = np.where(stop == last, place, np.maximum(back, place + 1))
    reached = np.zeros(n, dtype=bool)
    reached[first] = True
    while True:
        more = reached.copy()
        more[succ[reached]] = True
        if (more == reached).all():
            break
        reached, succ = more, succ[succ]
    starts = np.flatnonzero(reached)
    return starts, stop[starts]


def split_oversized(docs: DataFrame, key: str, limit: int, overlap: int, text: str = "text", vocabulary: str = VOCABULARY, rows: int = 64, numbered: str = NUMBERED) -> DataFrame:
    """Pieces of every text with more than ``limit`` tokens: ``key, piece_no, start_char, end_char, n_tokens, piece``.

    Each piece has at most ``limit`` tokens, counted with the tokenizer of ``vocabulary``. It ends before a
    claim or numbered paragraph if that leaves it at least half full, else at a line break, else after a
    sentence, else before a word. Each next piece begins so that it repeats the last ``overlap`` tokens of the
    one before, or the little more up to a word. ``n_tokens`` is exact: pieces that begin or end inside a run of letters
    (text without spaces) are counted again, and should one be over the limit, its text is cut anew with a limit lower by that much. Pieces are verbatim: ``piece`` is ``text`` from ``start_char``
    to ``end_char``, and together they cover it. A text within the limit, NULL or empty has no pieces. Texts of
    no more bytes than ``limit`` are left out before tokenizing, as a token has at least one byte. A text is a
    row of its own task's batch; nothing is shuffled. ``numbered`` is the pattern of what begins a claim or numbered paragraph.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("overlap must be at least 0 and less than half of the limit")
    fine = max(1, min(FINE, (limit // 2 - overlap) // 2))
    kind = docs.schema[key].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, begins = TokenCounter.of(vocabulary), re.compile(numbered)
        for whole in batches:
            for batch in (whole.slice(i, rows) for i in range(0, whole.num_rows, rows)):
                found = [(i, body, legal_units(body, counter, fine)) for i, body in enumerate(batch.column("_text").to_pylist())]
                yield from _emit(batch.column(key), [x for x in found if x[2].total > limit], counter, begins, limit)

    def _emit(ids, found, counter, begins, most_tokens) -> Iterator[pa.RecordBatch]:
        if not found:
            return
        lengths = np.array([len(u.parts) + 1 for _, _, u in found])
        end = np.cumsum(lengths) - 1
        first = end - lengths + 1
        # The place after the last unit closes a text; a gap of limit + 1 keeps the next text out of reach.
        cum, low, exact = (np.concatenate(([0], np.cumsum(np.concatenate([np.append(c, limit + 1) for c in counts]))[:-1])) for counts in zip(*[(u.most, u.least, u.exact) for _, _, u in found], strict=True))
        level = np.concatenate([np.append(boundary_levels(u.parts, begins), np.int8(CLAIM)) for _, _, u in found])
        inside = np.concatenate([np.append(u.inside, False) for _, _, u in found])
        chars = np.concatenate([np.concatenate(([0], np.cumsum(np.fromiter(map(len, u.parts), np.int64, len(u.parts))))) for _, _, u in found])
        a, b = greedy_pieces(cum, low, level, first, end, most_tokens, overlap)
        owner = np.searchsorted(end, a)
        number = np.arange(len(a)) - np.searchsorted(owner, owner)
        pieces = [found[o][1][s:e] for o, s, e in zip(owner, chars[a], chars[b], strict=True)]
        tokens = exact[b] - exact[a]
        for i in np.flatnonzero(inside[a] | inside[b]):
            tokens[i] = counter.count(pieces[i])
        over = np.zeros(len(found), dtype=np.int64)
        np.maximum.at(over, owner, tokens - limit)
        good = np.flatnonzero(over[owner] <= 0)
        rows = np.array([i for i, _, _ in found])[owner[good]]
        columns = [ids.take(pa.array(rows)), *(pa.array(c[good], pa.int32()) for c in (number, chars[a], chars[b], tokens)), pa.array([pieces[i] for i in good], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [key, "piece_no", "start_char", "end_char", "n_tokens", "piece"])
        for o in np.flatnonzero(over > 0):
            yield from _emit(ids, [found[o]], counter, begins, max(most_tokens - int(over[o]), 2 * overlap + 1))

    long = docs.select(key, F.col(text).alias("_text")).where(F.octet_length("_text") > limit)
    return long.mapInArrow(split, f"`{key}` {kind}, {PIECES}")
