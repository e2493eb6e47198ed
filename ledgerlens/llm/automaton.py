"""Regular expressions to one deterministic automaton.

Rules are compiled to position automata, determinised together by subset construction (the state of
the combined automaton is one subset per rule), minimised by partition refinement, and stored as
transition arrays over byte classes. A scan reads every byte once for all rules and reports where a
match of a rule has ended; its start is found by walking the reversed rule back from that end, which
touches only the bytes of the match.

Matches are the leftmost, longest, non-overlapping ones of each rule. One pass is exact for rules
where (a) a match once found stays a match until it ends and (b) an unfinished match cannot hold a
finished later one. ``compile_rules`` checks both and refuses other rules.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ALL = frozenset(range(256))


# -- parsing ------------------------------------------------------------------------------------


class _Nfa:
    """A position automaton over bytes: edges and empty moves."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def node(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1


class _Parser:
    """Literals, classes, groups, ``|``, ``?``, ``*``, ``+``, ``{m}`` and ``{m,}`` over single bytes."""

    def __init__(self, pattern: str) -> None:
        self.text, self.at = pattern, 0

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return ("alt", parts) if len(parts) > 1 else parts[0]

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("seq", parts)

    def repeated(self):
        item = self.single()
        while self.peek() and self.peek() in "?*+{":
            mark = self.take()
            if mark == "{":
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at : end].partition(",")
                self.at = end + 1
                if high:
                    raise ValueError("an upper bound of repetitions is not supported")
                item = ("seq", [item] * int(low) + ([("star", item)] if comma else []))
            else:
                item = {"?": ("alt", [item, ("seq", [])]), "*": ("star", item), "+": ("seq", [item, ("star", item)])}[mark]
        return item

    def single(self):
        c = self.take()
        if c == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            inner = self.alternatives()
            if self.peek() != ")":
                raise ValueError("unclosed group")
            self.take()
            return inner
        if c == "[":
            return ("set", self.members())
        if c == ".":
            return ("set", ALL - {10})
        return ("set", frozenset([self.escaped() if c == "\\" else self.byte(c)]))

    def byte(self, c: str) -> int:
        if ord(c) > 127:
            raise ValueError("rules are written in ASCII")
        return ord(c)

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, self.byte(c))

    def members(self) -> frozenset[int]:
        negated = self.peek() == "^"
        if negated:
            self.take()
        found: set[int] = set()
        while (c := self.take()) != "]":
            low = self.escaped() if c == "\\" else self.byte(c)
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.take()
                c = self.take()
                found.update(range(low, (self.escaped() if c == "\\" else self.byte(c)) + 1))
            else:
                found.add(low)
        return ALL - found if negated else frozenset(found)


def _fold(chars: frozenset[int]) -> frozenset[int]:
    """Both cases of every ASCII letter."""
    both = set(chars)
    for c in chars:
        if 65 <= c <= 90:
            both.add(c + 32)
        elif 97 <= c <= 122:
            both.add(c - 32)
    return frozenset(both)


def _build(nfa: _Nfa, tree, ignore_case: bool) -> tuple[int, int]:
    kind, body = tree
    start, end = nfa.node(), nfa.node()
    if kind == "set":
        nfa.edges[start].append((_fold(body) if ignore_case else body, end))
    elif kind == "seq":
        at = start
        for part in body:
            a, b = _build(nfa, part, ignore_case)
            nfa.empty[at].append(a)
            at = b
        nfa.empty[at].append(end)
    elif kind == "alt":
        for part in body:
            a, b = _build(nfa, part, ignore_case)
            nfa.empty[start].append(a)
            nfa.empty[b].append(end)
    else:
        a, b = _build(nfa, body, ignore_case)
        nfa.empty[start] += [a, end]
        nfa.empty[b] += [a, end]
    return start, end


class _Rule:
    """One anchored automaton with memoised steps on sets of positions."""

    def __init__(self, pattern: str, ignore_case: bool, reverse: bool = False) -> None:
        parser = _Parser(pattern)
        tree = parser.alternatives()
        if parser.peek():
            raise ValueError(f"cannot read {pattern!r} beyond character {parser.at}")
        nfa = _Nfa()
        start, end = _build(nfa, tree, ignore_case)
        if reverse:
            turned = _Nfa()
            for _ in nfa.edges:
                turned.node()
            for a, edges in enumerate(nfa.edges):
                for chars, b in edges:
                    turned.edges[b].append((chars, a))
            for a, ends in enumerate(nfa.empty):
                for b in ends:
                    turned.empty[b].append(a)
            nfa, start, end = turned, end, start
        self.nfa, self.end = nfa, end
        self.first = self.closure({start})
        if end in self.first:
            raise ValueError("a rule must not match the empty text")

    def closure(self, nodes: set[int]) -> frozenset[int]:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for b in self.nfa.empty[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return frozenset(x for x in seen if self.nfa.edges[x] or x == self.end)

    def step(self, nodes: frozenset[int], byte: int) -> frozenset[int]:
        return self.closure({b for a in nodes for chars, b in self.nfa.edges[a] if byte in chars})

    def char_sets(self) -> set[frozenset[int]]:
        return {chars for edges in self.nfa.edges for chars, _ in edges}


def _byte_classes(sets: set[frozenset[int]]) -> tuple[np.ndarray, list[int]]:
    """Bytes that no rule tells apart get one class; also one byte of each class."""
    ordered = sorted(sets, key=sorted)
    marks = [tuple(b in s for s in ordered) for b in range(256)]
    number = {mark: i for i, mark in enumerate(dict.fromkeys(marks))}
    example = {number[mark]: b for b, mark in enumerate(marks)}
    return np.array([number[m] for m in marks], dtype=np.uint8), [example[i] for i in range(len(number))]


def _search_step(rule: _Rule, threads: tuple[frozenset[int], ...], matched: bool, byte: int):
    """Threads by age of their start. Returns the new threads, whether the oldest has matched, and whether a match ended before this byte."""
    moved = []
    seen: set[int] = set()
    for group in threads:
        nodes = rule.step(group, byte) - seen
        if nodes:
            seen |= nodes
            moved.append(nodes)
    if matched:
        if not moved:
            fresh = rule.step(rule.first, byte)
            return ((fresh,) if fresh else ()), rule.end in fresh, True
        if rule.end not in moved[0]:
            raise ValueError("a rule whose match can be broken off by later bytes is not supported")
        return (moved[0],), True, False
    fresh = rule.step(rule.first, byte) - seen
    if fresh:
        moved.append(fresh)
    for age, nodes in enumerate(moved):
        if rule.end in nodes:
            if age:
                raise ValueError("a rule whose unfinished match holds a finished one is not supported")
            return (nodes,), True, False
    return tuple(moved), False, False


@dataclass(frozen=True)
class Automaton:
    """Minimal combined automaton. ``rows[state, class]`` is the next state; ``ended[state]`` has a bit for each rule whose
    match ended before the byte that led here; ``open_[state]`` those whose match would end with the text."""

    names: tuple[str, ...]
    classes: np.ndarray
    rows: np.ndarray
    ended: np.ndarray
    open_: np.ndarray
    back: tuple["Walker", ...]


@dataclass(frozen=True)
class Walker:
    """An anchored automaton of one rule (forwards, or backwards for finding starts); state -1 is dead."""

    classes: np.ndarray
    rows: list[list[int]]
    final: list[bool]

    def longest(self, data: bytes, at: int, stop: int, step: int) -> int:
        """The furthest end of a match from ``at`` towards ``stop``, or -1."""
        rows, final, classes = self.rows, self.final, self.classes
        state, best = 0, -1
        while at != stop:
            state = rows[state][classes[data[at if step > 0 else at - 1]]]
            if state < 0:
                break
            at += step
            if final[state]:
                best = at
        return best


def walker(pattern: str, ignore_case: bool = False, reverse: bool = False) -> Walker:
    rule = _Rule(pattern, ignore_case, reverse)
    classes, examples = _byte_classes(rule.char_sets())
    states, rows, at = {rule.first: 0}, [], 0
    order = [rule.first]
    while at < len(order):
        row = []
        for byte in examples:
            nodes = rule.step(order[at], byte)
            if not nodes:
                row.append(-1)
                continue
            if nodes not in states:
                states[nodes] = len(order)
                order.append(nodes)
            row.append(states[nodes])
        rows.append(row)
        at += 1
    return Walker(classes, rows, [rule.end in nodes for nodes in order])


def _minimised(rows: np.ndarray, *marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coarsest partition that keeps the marks and the steps; also one state of each part."""
    _, part = np.unique(np.stack(marks, axis=1), axis=0, return_inverse=True)
    part = part.reshape(-1)
    count = part.max() + 1
    while True:
        _, finer = np.unique(np.column_stack([part, part[rows]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() + 1 == count:
            break
        part, count = finer, finer.max() + 1
    _, first = np.unique(part, return_index=True)
    return part, first


def _determinise(rule: _Rule, examples: list[int]) -> tuple[list[list[tuple[int, bool]]], list[bool]]:
    """Subset construction of one searching rule: steps by state and byte class, and whether a state has matched."""
    states, order, steps, at = {((), False): 0}, [((), False)], [], 0
    while at < len(order):
        threads, matched = order[at]
        row = []
        for byte in examples:
            moved, now, over = _search_step(rule, threads, matched, byte)
            if (moved, now) not in states:
                states[moved, now] = len(order)
                order.append((moved, now))
            row.append((states[moved, now], over))
        steps.append(row)
        at += 1
    return steps, [matched for _, matched in order]


def compile_rules(rules: dict[str, tuple[str, bool]]) -> Automaton:
    """``rules``: name -> (pattern, whether letters match in either case)."""
    built = [_Rule(pattern, fold) for pattern, fold in rules.values()]
    classes, examples = _byte_classes(set().union(*[r.char_sets() for r in built]))
    single = [_determinise(rule, examples) for rule in built]
    first = ((0,) * len(built), 0)
    states, order, rows, at = {first: 0}, [first], [], 0
    while at < len(order):
        parts, _ = order[at]
        row = []
        for c in range(len(examples)):
            moves = [steps[x][c] for (steps, _), x in zip(single, parts)]
            state = (tuple(m for m, _ in moves), sum(1 << i for i, (_, over) in enumerate(moves) if over))
            if state not in states:
                states[state] = len(order)
                order.append(state)
            row.append(states[state])
        rows.append(row)
        at += 1
    table = np.array(rows, dtype=np.int32)
    ended = np.array([e for _, e in order], dtype=np.int64)
    open_ = np.array([sum(1 << i for i, x in enumerate(parts) if single[i][1][x]) for parts, _ in order], dtype=np.int64)
    part, kept = _minimised(table, ended, open_)
    start = part[0]
    swap = np.arange(len(kept))
    swap[[0, start]] = swap[[start, 0]]  # the first state keeps number 0
    number = np.argsort(swap)
    slim = number[part[table[kept]]][swap]
    back = tuple(walker(pattern, fold, reverse=True) for pattern, fold in rules.values())
    return Automaton(tuple(rules), classes, slim, ended[kept][swap], open_[kept][swap], back)


class Scanner:
    """Runs a compiled automaton over texts. Made once in each worker."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton
        self.translation = automaton.classes.tobytes()
        width = automaton.rows.shape[1]
        # a state is its row: the next rows by class, then the mark of ended rules and of open ones
        self.states: list[list] = [[None] * (width + 2) for _ in range(len(automaton.rows))]
        for state, row in zip(self.states, automaton.rows.tolist()):
            state[:width] = [self.states[x] for x in row]
        for state, e, o in zip(self.states, automaton.ended.tolist(), automaton.open_.tolist()):
            state[width], state[width + 1] = e, o
        self.width = width

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule number, start, end) in bytes, in order of end."""
        width, state = self.width, self.states[0]
        hits: list[tuple[int, int, int]] = []
        floor = [0] * len(self.automaton.names)
        at = 0
        for c in data.translate(self.translation):
            state = state[c]
            if state[width]:
                self._close(data, state[width], at, floor, hits)
            at += 1
        if state[width + 1]:
            self._close(data, state[width + 1], at, floor, hits)
        return hits

    def _close(self, data: bytes, mask: int, end: int, floor: list[int], hits: list) -> None:
        for i in range(len(floor)):
            if mask >> i & 1:
                hits.append((i, self.automaton.back[i].longest(data, end, floor[i], -1), end))
                floor[i] = end
