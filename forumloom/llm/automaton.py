"""Regular expressions compiled into one minimal deterministic automaton over bytes."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

try:
    from re import _constants as C
    from re import _parser as P
except ImportError:  # before Python 3.11
    import sre_constants as C
    import sre_parse as P


@dataclass
class Automaton:
    """``table[state * classes + byte_class[byte]]`` is the next state, already times ``classes``.

    Accepting states come last, from ``accepting`` on; ``rules[state // classes]`` has a bit for each rule
    that ends there. State 0 is the start. Searching is unanchored: the start state loops.
    """

    table: np.ndarray
    byte_class: bytes
    classes: int
    accepting: int
    rules: np.ndarray


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def build(self, tree, start: int, fold: bool) -> int:
        for op, value in tree:
            if op is C.LITERAL or op is C.NOT_LITERAL or op is C.IN:
                end = self.state()
                self.moves[start].append((_bytes(op, value, fold), end))
                start = end
            elif op is C.SUBPATTERN:
                start = self.build(value[3], start, (fold or bool(value[1] & re.I)) and not value[2] & re.I)
            elif op is C.BRANCH:
                end = self.state()
                for branch in value[1]:
                    self.empty[self.build(branch, start, fold)].append(end)
                start = end
            elif op is C.MAX_REPEAT:
                low, high, body = value
                for _ in range(low):
                    start = self.build(body, start, fold)
                if high is C.MAXREPEAT:
                    loop = self.state()
                    self.empty[start].append(loop)
                    self.empty[self.build(body, loop, fold)].append(loop)
                    start = loop
                else:
                    end = self.state()
                    for _ in range(high - low):
                        self.empty[start].append(end)
                        start = self.build(body, start, fold)
                    self.empty[start].append(end)
                    start = end
            else:
                raise ValueError(f"a scanned rule can't use {op}")
        return start


def _bytes(op, value, fold: bool) -> frozenset:
    if op is C.LITERAL:
        found = {value}
    elif op is C.NOT_LITERAL:
        found = set(range(256)) - {value}
    else:
        found = set()
        for kind, x in value:
            if kind is C.LITERAL:
                found.add(x)
            elif kind is C.RANGE:
                found.update(range(x[0], x[1] + 1))
            elif kind is not C.NEGATE:
                raise ValueError(f"a scanned rule can't use {kind} in a class")
        if value[0][0] is C.NEGATE:
            found = set(range(256)) - found
    if fold:
        found |= {ord(c) for b in found if b < 128 for c in chr(b).swapcase() if ord(c) < 128}
    return frozenset(found)


@lru_cache(maxsize=8)
def compile_rules(patterns: tuple[str, ...]) -> Automaton:
    """The minimal automaton that finds where a match of any of the patterns ends.

    Subset construction over byte classes (bytes that no rule tells apart), then partition refinement, then
    unreachable differences are gone and accepting states are numbered last. No rule may match a line feed,
    so a line feed leads every state back to the start.
    """
    nfa = _Nfa()
    root = nfa.state()
    ends = {}
    for i, pattern in enumerate(patterns):
        first = nfa.state()
        nfa.empty[root].append(first)
        ends[nfa.build(P.parse(pattern), first, False)] = i
    sets = {bytes_ for moves in nfa.moves for bytes_, _ in moves}
    if any(10 in s for s in sets):
        raise ValueError("a rule may not match a line feed")
    kinds: dict[tuple, int] = {}
    ordered = list(sets)
    byte_class = bytes(kinds.setdefault(tuple(b in s for s in ordered), len(kinds)) for b in range(256))
    classes = len(kinds)
    sample = [byte_class.index(c) for c in range(classes)]

    def closure(states) -> int:
        """The states reachable without a byte, as bits of a number."""
        seen, stack = set(states), list(states)
        while stack:
            for t in nfa.empty[stack.pop()]:
                if t not in seen:
                    seen.add(t)
                    stack.append(t)
        return sum(1 << s for s in seen)

    begin = closure([root])
    steps_of = [
        [(c, closure([t])) for c in range(classes) for chars, t in moves if sample[c] in chars] for moves in nfa.moves
    ]
    numbers, subsets, steps = {begin: 0}, [begin], []
    for subset in subsets:  # grows while it is read
        row = [begin] * classes
        while subset:
            low = subset & -subset
            for c, target in steps_of[low.bit_length() - 1]:
                row[c] |= target
            subset ^= low
        for target in row:
            if target not in numbers:
                numbers[target] = len(subsets)
                subsets.append(target)
        steps.append([numbers[t] for t in row])
    moves = np.array(steps)
    accepts = np.array([sum(1 << i for s, i in ends.items() if subset >> s & 1) for subset in subsets])
    groups = np.unique(accepts, return_inverse=True)[1]
    factors = np.random.default_rng(1).integers(1, 1 << 63, classes + 1, dtype=np.uint64) | np.uint64(1)
    while True:  # states stay together if their groups and those of their successors agree, told by a 64-bit sum
        names = np.column_stack([groups, groups[moves]]).astype(np.uint64) * factors
        finer = np.unique(names.sum(1, dtype=np.uint64), return_inverse=True)[1].ravel()
        if finer.max() == groups.max():
            break
        groups = finer
    one = np.unique(groups, return_index=True)[1]  # a state of each group
    order = sorted(range(len(one)), key=lambda g: (accepts[one[g]] != 0, g != groups[0]))
    place = np.empty(len(one), int)
    place[order] = np.arange(len(one))
    table = place[groups[moves[one[order]]]] * classes
    rules = accepts[one[order]]
    accepting = int((rules == 0).sum()) * classes
    return Automaton(table.ravel().astype(np.int32), byte_class, classes, accepting, rules)


def scan(automaton: Automaton, data: bytes, lanes: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a match ends (last byte) and the rules that match there, from one pass over ``data``.

    ``data`` is cut into lanes that advance together, each from the start state. A lane whose predecessor
    ended in another state is walked again from that state until both walks meet, which adds the matches
    that cross the cut; walking from the start state never finds a false one.
    """
    steps = max(1, -(-len(data) // lanes))
    lanes = max(1, -(-len(data) // steps))
    code = np.frombuffer(data.translate(automaton.byte_class), np.uint8)
    filled = np.full(lanes * steps, automaton.byte_class[10], np.uint8)
    filled[: len(code)] = code
    by_step = np.ascontiguousarray(filled.reshape(lanes, steps).T)
    table, accepting = automaton.table, automaton.accepting
    places, found = [], []

    def note(step: int, lane: np.ndarray, state: np.ndarray):
        places.append(lane * steps + step)
        found.append(automaton.rules[state // automaton.classes])

    state = np.zeros(lanes, np.int32)
    index = np.empty(lanes, np.int32)
    for step in range(steps):
        np.add(state, by_step[step], out=index)
        np.take(table, index, out=state)
        if state.max() >= accepting:
            lane = np.flatnonzero(state >= accepting)
            note(step, lane, state[lane])
    entry = np.zeros(lanes, np.int32)
    while True:
        true = np.concatenate([np.zeros(1, np.int32), state[:-1]])
        again = np.flatnonzero(true != entry)
        if not len(again):
            break
        new, old = true[again].copy(), entry[again].copy()
        entry[again] = new
        open_ = np.arange(len(again))
        for step in range(steps):
            symbol = by_step[step, again[open_]]
            new[open_] = table[new[open_] + symbol]
            old[open_] = table[old[open_] + symbol]
            hit = open_[new[open_] >= accepting]
            if len(hit):
                note(step, again[hit], new[hit])
            open_ = open_[new[open_] != old[open_]]
            if not len(open_):
                break
        state[again[open_]] = new[open_]
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, rule = np.concatenate(places), np.concatenate(found)
    where, inverse = np.unique(place, return_inverse=True)
    joined = np.zeros(len(where), np.int64)
    np.bitwise_or.at(joined, inverse, rule)
    return where, joined
