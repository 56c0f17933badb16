"""Walks and their states followed inside tasks, where the links of their unit are.

A state is a block, what was asked on the way to it, and whether a condition of the way could not be read. What a task knows
of conditions it gets as JSON texts; each distinct one is read once. A part of a unit is followed as far as the
budget goes, and what is left over is handed back as open.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from flowsieve.operators.inside import FACT, LINK, Inside, _codes, _codes_of

#: Walks of one length that a task lengthens at once.
FRONT_ROWS = 100_000
BATCH_ROWS = 50_000
STATE, EDGE, OPEN = range(3)
LEAST, MOST = -(2**63), 2**63 - 1
KNOWN = ["=", "!=", "<", "<=", ">", ">="]


@lru_cache(maxsize=1 << 16)
def read_conditions(text: str) -> tuple:
    """(var, cmp, const) of the conditions that can be read."""
    rows = [(c.get("var"), c.get("cmp"), c.get("const")) for c in json.loads(text)]
    return tuple(r for r in rows if r[0] is not None and r[1] in KNOWN and r[2] is not None)


@lru_cache(maxsize=1 << 16)
def read_asked(text: str) -> tuple:
    return tuple((a["var"], a.get("lo"), a.get("hi"), tuple(a["holes"])) for a in json.loads(text))


@lru_cache(maxsize=1 << 16)
def asked_text(asked: tuple) -> str:
    return json.dumps([{"var": var, "lo": low, "hi": high, "holes": list(holes)} for var, low, high, holes in asked])


def meet(low: int | None, high: int | None, holes: tuple, cmp: str, const: int) -> tuple | None:
    """Interval and holes after one more condition, None if nothing is left; holes at the ends are cut off."""
    least = {"=": const, ">=": const, ">": const + 1}.get(cmp)
    most = {"=": const, "<=": const, "<": const - 1}.get(cmp)
    low = max((x for x in (low, least) if x is not None), default=None)
    high = min((x for x in (high, most) if x is not None), default=None)
    if cmp == "!=" and const not in holes:
        holes = tuple(sorted((*holes, const)))
    for hole in holes:
        low = low + 1 if hole == low else low
    for hole in reversed(holes):
        high = high - 1 if hole == high else high
    if (low is not None and (low > MOST or (high is not None and low > high))) or (high is not None and high < LEAST):
        return None
    return low, high, tuple(h for h in holes if (low is None or h > low) and (high is None or h < high))


@lru_cache(maxsize=1 << 18)
def after(asked: tuple, conditions: str, forgotten: str) -> tuple | None:
    """What is asked behind an edge and the block it leads to; None if the conditions contradict each other."""
    mine = {a[0]: a[1:] for a in asked}
    for var, cmp, const in read_conditions(conditions):
        met = meet(*mine.get(var, (None, None, ())), cmp, const)
        if met is None:
            return None
        mine[var] = met
    gone = json.loads(forgotten)
    return tuple((var, *mine[var]) for var in sorted(mine) if var not in gone)


class States:
    """The states of a chunk, numbered; where one leads is found when it is first asked for."""

    def __init__(self, links: dict[int, list]):
        self.links, self.numbers, self.rows, self.onward = links, {}, [], []

    def number(self, state: tuple) -> int:
        found = self.numbers.setdefault(state, len(self.rows))
        if found == len(self.rows):
            self.rows.append(state)
            self.onward.append(None)
        return found

    def next_of(self, number: int) -> list[int]:
        if self.onward[number] is None:
            node, asked, imprecise = self.rows[number]
            met = [(to, after(asked, conditions, forgotten), imprecise or unread) for to, conditions, forgotten, unread in self.links.get(node, ())]
            self.onward[number] = [self.number(state) for state in met if state[1] is not None]
        return self.onward[number]


class Roam(Inside):
    """What the two ways to follow have in common; rows come sorted by unit and part."""

    def __init__(self, budget: int):
        self.budget = budget

    def read(self, table: pa.Table) -> tuple[States, np.ndarray]:
        """The states that the links of a chunk make, and the numbers of those it starts with, in the order of its facts."""
        kind, part = (table[c].to_numpy() for c in ("_kind", "_part"))
        unit, _, _ = _codes(table["unit"])
        self.units = table["unit"]
        scope, self.first, scopes = np.unique(unit * (1 << 32) + part, return_index=True, return_inverse=True)
        self.paths = [p if p is not None else [] for p in table["path"].combine_chunks().filter(pa.array(kind == FACT)).to_pylist()] if "path" in table.column_names else None
        columns = [table["block"], table["_to"]]
        if self.paths is not None:
            columns.append(pa.chunked_array([pa.array([b for p in self.paths for b in p], table["block"].type)]))
        (block, to, *path), self.names, _ = _codes_of(columns)
        self.path = path[0] if path else None
        self.blocks = len(self.names)
        node, target = scopes * self.blocks + block, scopes * self.blocks + to
        texts = {c: table[c].to_pylist() for c in ("_conditions", "_forgotten", "asked")}
        unread = table["imprecise"].to_pylist()
        links: dict[int, list] = {}
        for i in np.flatnonzero(kind == LINK):
            links.setdefault(int(node[i]), []).append((int(target[i]), texts["_conditions"][i], texts["_forgotten"][i], unread[i]))
        states = States(links)
        facts = np.flatnonzero(kind == FACT)
        return states, np.array([states.number((int(node[i]), read_asked(texts["asked"][i]), unread[i])) for i in facts], np.int64)

    def units_of(self, scope: np.ndarray) -> pa.ChunkedArray:
        return self.units.take(pa.array(self.first[scope]))


class RoamStates(Roam):
    """All states of a part with the edges that they take; those beyond the budget are open."""

    def followed(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        states, starts = self.read(table)
        taken, fronts = {}, {}
        for number in dict.fromkeys(starts.tolist()):
            fronts.setdefault(states.rows[number][0] // self.blocks, []).append(number)
        kinds, nodes, targets, asked, marks = [], [], [], [], []
        for front in fronts.values():
            seen, at = set(front), 0
            reached: dict[tuple, bool] = {}
            while at < len(front) and at < self.budget:
                node, asks, imprecise = states.rows[front[at]]
                reached[node, asks] = reached.get((node, asks), False) or imprecise
                for number in states.next_of(front[at]):
                    taken[node, states.rows[number][0]] = True
                    if number not in seen:
                        seen.add(number)
                        front.append(number)
                at += 1
            rows = [(STATE, node, asks, imprecise) for (node, asks), imprecise in reached.items()]
            rows += [(OPEN, *states.rows[number]) for number in front[at:]]
            for kind, node, asks, imprecise in rows:
                kinds.append(kind)
                nodes.append(node)
                asked.append(asked_text(asks))
                marks.append(imprecise)
            targets += [node for _, node, _, _ in rows]
        kinds += [EDGE] * len(taken)
        nodes += [src for src, _ in taken]
        targets += [dst for _, dst in taken]
        asked += [None] * len(taken)
        marks += [None] * len(taken)
        scope, block = np.divmod(np.array(nodes, np.int64), self.blocks)
        names = [self.names.take(pa.array(b)) for b in (block, np.array(targets, np.int64) % self.blocks)]
        columns = [self.units_of(scope), pa.array(kinds, pa.int8()), *names, pa.array(asked, pa.string()), pa.array(marks, pa.bool_())]
        yield from pa.table(columns, names=["unit", "_kind", "block", "_to", "asked", "imprecise"]).to_batches(max_chunksize=BATCH_ROWS)


class RoamWalks(Roam):
    """All walks that go on from those of a part and enter a block at most ``max_loop`` times; those beyond the budget, or ``steps`` long, are open."""

    def __init__(self, budget: int, max_loop: int, steps: int | None, separator: str | None):
        super().__init__(budget)
        self.max_loop, self.steps, self.separator = max_loop, steps, separator

    def followed(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        states, starts = self.read(table)
        lengths = np.array([len(p) for p in self.paths], np.int64)
        ends = np.cumsum(lengths)
        spent = np.zeros(len(self.first), np.int64)
        stack = []
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            stack.append((0, starts[rows], self.path[(ends[rows] - length)[:, None] + np.arange(length)]))
        while stack:
            step, at, path = stack.pop()
            if len(at) > FRONT_ROWS:
                stack.append((step, at[FRONT_ROWS:], path[FRONT_ROWS:]))
                at, path = at[:FRONT_ROWS], path[:FRONT_ROWS]
            distinct, inverse = np.unique(at, return_inverse=True)
            scope = np.array([states.rows[n][0] // self.blocks for n in distinct], np.int64)[inverse]
            late = spent[scope] >= self.budget if self.steps is None else np.full(len(at), step >= self.steps)
            if late.any():
                yield from self.shown(states, at[late], path[late], scope[late], np.zeros(late.sum(), bool), True)
                at, path, scope = at[~late], path[~late], scope[~late]
            if not len(at):
                continue
            spent += np.bincount(scope, minlength=len(spent))
            distinct, inverse = np.unique(at, return_inverse=True)
            onward = [states.next_of(n) for n in distinct.tolist()]
            flat = np.array([n for numbers in onward for n in numbers], np.int64)
            to = np.array([states.rows[n][0] % self.blocks for n in flat.tolist()], np.int64)
            many = np.array([len(numbers) for numbers in onward], np.int64)
            begin = (np.cumsum(many) - many)[inverse]
            many = many[inverse]
            row = np.repeat(np.arange(len(at)), many)
            place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + begin[row]
            block = to[place]
            fits = (path[row] == block[:, None]).sum(axis=1) < self.max_loop
            stopped = np.zeros(len(at), bool)
            stopped[row[~fits]] = True
            yield from self.shown(states, at, path, scope, stopped, False)
            if fits.any():
                stack.append((step + 1, flat[place[fits]], np.column_stack([path[row[fits]], block[fits]])))

    def shown(self, states: States, at: np.ndarray, path: np.ndarray, scope: np.ndarray, stopped: np.ndarray, is_open: bool) -> Iterator[pa.RecordBatch]:
        distinct, inverse = np.unique(at, return_inverse=True)
        rows = [states.rows[n] for n in distinct.tolist()]
        asked = pa.array([asked_text(asks) for _, asks, _ in rows], pa.string()).take(pa.array(inverse))
        marks = pa.array([imprecise for *_, imprecise in rows], pa.bool_()).take(pa.array(inverse))
        blocks = self.names.take(pa.array(path.ravel()))
        walks = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * path.shape[1], pa.int32()), blocks)
        text = pa.nulls(len(at), pa.string())
        if self.separator is not None and not is_open:
            text = self.joined(path)
            walks = pa.nulls(len(at), walks.type)
        columns = [self.units_of(scope), walks, text, pa.array(np.full(len(at), path.shape[1] - 1), pa.int32()), self.names.take(pa.array(path[:, -1])), asked, marks]
        columns += [pa.array(stopped), pa.array(np.full(len(at), is_open))]
        yield from pa.table(columns, names=["unit", "path", "_text", "step", "block", "asked", "imprecise", "stopped", "_open"]).to_batches(max_chunksize=BATCH_ROWS)

    def joined(self, path: np.ndarray) -> pa.Array:
        """The names of the blocks as one text, without those that are null, as ``array_join`` does."""
        names = self.names.cast(pa.string())
        if names.null_count:
            shown = names.to_pylist()
            return pa.array([self.separator.join(shown[b] for b in blocks if shown[b] is not None) for blocks in path.tolist()], pa.string())
        parts = [names.take(pa.array(path[:, i])) for i in range(path.shape[1])]
        return pc.binary_join_element_wise(*parts, self.separator)
