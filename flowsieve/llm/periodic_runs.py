"""Periodic runs of words, found in a Re-Pair grammar of each text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.hashing import SPACE, slices
from flowsieve.llm.shipping import ready

#: A run has at least this many words, and at least two periods.
LEAST = 12
#: Pairs of places compared at once, so that a very regular text doesn't need memory for all of its pairs.
PAIRS = 1 << 20

RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte of every word, byte behind it, number of words before each text and in all)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~cut[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~cut[1:]
    first = np.flatnonzero(inside & ~before)
    return first, np.flatnonzero(inside & ~after) + 1, np.searchsorted(first, offsets, side="left")


def word_ids(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The same number for the same word, by its bytes."""
    if not len(first):
        return np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(end - first)])
    column = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(first), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[~SPACE[data]].tobytes())]
    )
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _numbered(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each distinct row of two columns, how often the row's value occurs)."""
    major, minor = columns
    _, number, counts = np.unique(major * (int(minor.max(initial=0)) + 1) + minor, return_inverse=True, return_counts=True)
    return number, counts[number]


def stretches(doc: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, stretch of each) of the stretches of at least LEAST words in which a run can lie.

    Each word of a run occurs in it twice, so a word that its stretch holds only once is in none. Such words
    are cut out until there are none; what is left holds all runs, each inside one stretch.
    """
    place, stretch = np.arange(len(word)), doc
    while len(place):
        kept = _numbered(stretch, word[place])[1] > 1
        if kept.all():
            break
        place, stretch = place[kept], stretch[kept]
        if not len(place):
            break
        starts = np.concatenate([[True], (np.diff(place) > 1) | (np.diff(stretch) != 0)])
        stretch = np.cumsum(starts) - 1
        kept = np.bincount(stretch)[stretch] >= LEAST
        place, stretch = place[kept], stretch[kept]
    return place, stretch


class _Nodes:
    """Nodes of the derivation trees: nonterminal, first place, place of the boundary, end."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []

    def add(self, symbol, first, boundary, end) -> None:
        long = end - first >= LEAST  # a run of LEAST words lies in no shorter node
        self.parts.append((symbol[long], first[long], boundary[long], end[long]))

    def columns(self) -> list[np.ndarray]:
        return [np.concatenate([p[k] for p in self.parts] or [np.zeros(0, np.int64)]) for k in range(4)]


def _alternate(same: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Of neighbouring chosen pairs that are the same pair (``same`` as the one before) every second is dropped."""
    begin = chosen & ~(same & np.concatenate([[False], chosen[:-1]]))
    at = np.flatnonzero(chosen)
    if not len(at):
        return chosen
    start = np.maximum.accumulate(np.where(begin, np.arange(len(chosen)), 0))
    out = np.zeros_like(chosen)
    out[at] = (at - start[at]) % 2 == 0
    return out


def grammar(symbol: np.ndarray, stretch: np.ndarray) -> _Nodes:
    """Re-Pair of all stretches at once; the rest of each stretch is joined to one tree.

    A round replaces, in every text, each pair that occurs at least twice and more often than the pairs it
    overlaps (ties: by the pair), thus always the most frequent one, so the number of rounds does not follow
    the number of rules. ``symbol`` has different numbers for different texts.
    """
    nodes = _Nodes()
    first = np.arange(len(symbol))
    end = first + 1
    fresh = int(symbol.max(initial=0)) + 1
    paired = True
    while len(symbol) > 1:
        joined = stretch[1:] == stretch[:-1]
        if not joined.any():
            break
        if paired:
            number, often = _numbered(symbol[:-1], symbol[1:])
            rank = np.where(joined & (often > 1), often * (int(number.max()) + 2) + number + 1, 0)
            left, right = np.concatenate([[0], rank[:-1]]), np.concatenate([rank[1:], [0]])
            chosen = (rank > 0) & (rank >= left) & (rank >= right)
            chosen = _alternate(np.concatenate([[False], rank[1:] == rank[:-1]]), chosen)
            if not chosen.any():
                paired = False
                continue
            at = np.flatnonzero(chosen)
            _, names = np.unique(number[at], return_inverse=True)
        else:
            start = np.concatenate([[True], ~joined])
            place = np.arange(len(symbol)) - np.maximum.accumulate(np.where(start, np.arange(len(symbol)), 0))
            at = np.flatnonzero(joined & (place[:-1] % 2 == 0))
            names = np.arange(len(at))
        names = names + fresh
        fresh = int(names.max()) + 1
        nodes.add(names, first[at], first[at + 1], end[at + 1])
        symbol, end = symbol.copy(), end.copy()
        symbol[at], end[at] = names, end[at + 1]
        keep = np.ones(len(symbol), dtype=bool)
        keep[at + 1] = False
        symbol, stretch, first, end = symbol[keep], stretch[keep], first[keep], end[keep]
    return nodes


class _Common:
    """Lengths of common extensions, exact: names of all blocks of 1, 2, 4, ... words by pairs of names."""

    def __init__(self, symbol: np.ndarray, stretch: np.ndarray) -> None:
        n = len(symbol)
        longest = int(np.bincount(stretch).max(initial=0))
        self.names = [symbol]
        width = 1
        while 2 * width <= longest:
            now = self.names[-1]
            inside = np.flatnonzero(stretch[: n - 2 * width + 1] == stretch[2 * width - 1 :])
            name = np.full(n, -1, dtype=np.int64)
            name[inside] = _numbered(now[inside], now[inside + width])[0]
            self.names.append(name)
            width *= 2

    def forward(self, i: np.ndarray, j: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Words that agree from places ``i`` < ``j`` on, up to ``stop`` (behind j)."""
        total = np.zeros(len(i), dtype=np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            width, name = 1 << level, self.names[level]
            fits = np.flatnonzero(j + total + width <= stop)
            a = name[i[fits] + total[fits]]
            total[fits[(a >= 0) & (a == name[j[fits] + total[fits]])]] += width
        return total

    def backward(self, i: np.ndarray, j: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Words that agree before places ``i`` < ``j``, down to ``stop`` (before i)."""
        total = np.zeros(len(i), dtype=np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            width, name = 1 << level, self.names[level]
            fits = np.flatnonzero(i - total - width >= stop)
            a = name[i[fits] - total[fits] - width]
            total[fits[(a >= 0) & (a == name[j[fits] - total[fits] - width])]] += width
        return total


def _ranges(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of the values first, first + 1, ... of each owner."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + first[owner]


def crossing_runs(symbol: np.ndarray, stretch: np.ndarray, first: np.ndarray, boundary: np.ndarray, end: np.ndarray) -> tuple:
    """(node, start, end, period) of the runs that lie in a node and cross its boundary.

    A run of period q has, q words before or behind the boundary, the word that follows the boundary. So
    only the places of that word inside the node are looked at, each with its common extensions.
    """
    common = _Common(symbol, stretch)
    n = len(symbol)
    order = np.argsort(symbol, kind="stable")
    keys = symbol[order] * (n + 1) + order
    word = symbol[boundary]
    low = np.searchsorted(keys, word * (n + 1) + np.maximum(first, boundary - (end - first) // 2))
    high = np.searchsorted(keys, word * (n + 1) + np.minimum(end, boundary + (end - first) // 2 + 1))
    out = []
    limits = np.searchsorted(np.cumsum(high - low), np.arange(PAIRS, int((high - low).sum()) + PAIRS, PAIRS), side="left") + 1
    row = 0
    for limit in np.unique(np.minimum(limits, len(first))):
        owner, slot = _ranges(low[row:limit], (high - low)[row:limit])
        owner, other = owner + row, order[slot]
        row = limit
        owner, other = owner[other != boundary[owner]], other[other != boundary[owner]]
        i, j = np.minimum(other, boundary[owner]), np.maximum(other, boundary[owner])
        ahead = common.forward(i, j, end[owner])
        back = common.backward(i, j, first[owner])
        period, length = j - i, j - i + ahead + back
        good = (length >= np.maximum(LEAST, 2 * period)) & (i - back < boundary[owner])
        out.append((owner[good], (i - back)[good], (j + ahead)[good], period[good]))
    owner, start, stop, period = (np.concatenate([p[k] for p in out] or [np.zeros(0, np.int64)]) for k in range(4))
    # a run has also the multiples of its period: the same words are one run, of the smallest
    by = np.lexsort((period, stop, start, owner))
    owner, start, stop, period = owner[by], start[by], stop[by], period[by]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    return owner[new], start[new], stop[new], period[new]


def find_runs(doc: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end, period) of all maximal runs, by document, start and period.

    ``doc`` numbers the texts in a row, ``word`` their words; places count over all texts.
    """
    place, stretch = stretches(doc, word)
    nothing = np.zeros(0, dtype=np.int64)
    if not len(place):
        return nothing, nothing, nothing, nothing
    symbol, _ = _numbered(doc[place], word[place])
    _, stretch = np.unique(stretch, return_inverse=True)
    name, first, boundary, end = grammar(symbol, stretch).columns()
    # each nonterminal once, at its first node, then at all its places in the derivation
    kinds, where, kind = np.unique(name, return_index=True, return_inverse=True)
    owner, start, stop, period = crossing_runs(symbol, stretch, first[where], boundary[where], end[where])
    by = np.argsort(kind, kind="stable")
    often = np.bincount(kind, minlength=len(kinds))
    run, slot = _ranges((np.cumsum(often) - often)[owner], often[owner])
    shift = first[by[slot]] - first[where][owner[run]]
    start, stop, period = start[run] + shift, stop[run] + shift, period[run]
    # a node cuts off a run that goes on beyond it: only what no run of the same period holds is maximal
    by = np.lexsort((-stop, start, period, stretch[start]))
    start, stop, period = start[by], stop[by], period[by]
    group = np.concatenate([[0], np.cumsum((np.diff(period) != 0) | (np.diff(stretch[start]) != 0))]) if len(start) else nothing
    far = np.maximum.accumulate(stop + group * (len(symbol) + 1)) if len(start) else nothing
    maximal = np.ones(len(start), dtype=bool)
    maximal[1:] = stop[1:] + group[1:] * (len(symbol) + 1) > far[:-1]
    start, stop, period = start[maximal], stop[maximal], period[maximal]
    # and the smallest period of the same words
    by = np.lexsort((period, stop, start))
    start, stop, period = start[by], stop[by], period[by]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, period = start[new], stop[new], period[new]
    by = np.lexsort((period, start))
    start, stop, period = start[by], stop[by], period[by]
    return doc[place[start]], place[start], place[stop - 1] + 1, period


def _marked(n: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the intervals."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, stop, -1)
    return np.cumsum(change)[:n] > 0


def _texts(data: np.ndarray, first: np.ndarray, end: np.ndarray, kept: np.ndarray, doc: np.ndarray, docs: int) -> pa.Array:
    """The kept words of every text, joined by one space."""
    first, sizes, owner = first[kept], (end - first)[kept], doc[kept]
    per_doc = np.bincount(owner, minlength=docs)
    last = np.zeros(len(owner), dtype=bool)
    last[np.cumsum(per_doc)[per_doc > 0] - 1] = True
    step = sizes + ~last
    begin = np.cumsum(step) - step
    total = int(step.sum())
    source = np.arange(total) + np.repeat(first - begin, step)
    joined = np.append(data, np.uint8(32))[np.minimum(source, len(data))]
    joined[(begin + sizes)[~last]] = 32
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, weights=step, minlength=docs).astype(np.int64))])
    return pa.LargeStringArray.from_buffers(docs, pa.py_buffer(offsets), pa.py_buffer(joined.tobytes()))


def collapse(texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(words of each text, its runs, the text without the words behind the first period of a run)."""
    counts, runs, kept_texts = [np.zeros(0, np.int64)], [], []
    for row, last, data, offsets in slices(texts):
        first, end, before = word_places(data, offsets)
        doc = np.repeat(np.arange(last - row), np.diff(before))
        owner, start, stop, period = find_runs(doc, word_ids(data, first, end))
        kept = ~_marked(len(first), start + period, stop)
        kept_texts.append(_texts(data, first, end, kept, doc, last - row))
        counts.append(np.diff(before))
        fields = [pa.array(v, pa.int64()) for v in (start - before[owner], stop - start, period)]
        found = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=last - row))]).astype(np.int32)
        runs.append(pa.ListArray.from_arrays(pa.array(ends), found))
    empty = pa.array([], pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])))
    return np.concatenate(counts), pa.concat_arrays([empty, *runs]), pa.concat_arrays([pa.array([], pa.large_string()), *kept_texts])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count, runs, texts = collapse(batch.column(batch.num_columns - 1))
        found = pa.StructArray.from_arrays(
            [pa.array(count, pa.int64()), runs, texts.cast(pa.string())], ["n_words", "runs", "collapsed"]
        )
        names = batch.schema.names[:-1]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*names, "periodic"])


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without the text, with the column ``periodic`` (n_words, runs, collapsed).

    A run is a stretch of words with smallest period q, of at least LEAST and 2 q words, that no neighbouring
    word extends; ``runs`` lists all of them by start (word number from 0), then period; ``collapsed`` has the
    words that are in no run behind the run's first period, joined by one space. Words are separated by the six ASCII
    white spaces; they are the same if their bytes are. Each text is turned into a Re-Pair grammar; a nonterminal's boundary is
    examined once, and what crosses it is moved to all places that the nonterminal derives.

    Null and empty texts have no words, no runs and an empty text. A text is worked on by one task, in memory that
    follows its length, whatever its regularity. Repeated rows get a result each; an empty table gives no rows. Other
    columns pass through; a column that is called ``periodic`` already is replaced.
    """
    others = [c for c in docs.columns if c not in (text_col, "periodic")]
    ready(docs.sparkSession)
    rows = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text_col}`").cast("string").alias(text_col))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_run, f"{fields}periodic struct<n_words: bigint, runs: {RUN}, collapsed: string>")
