"""Minimum-cost error parses of damaged lines, by dynamic programming over whole batches.

A grammar is an automaton over the tokens of a line. A parse may also insert or delete a quote or a delimiter, at a cost. The least cost from each
token and state to the end of the line is computed backwards, one token of all lines at once. For CSV, whose automaton is finite, a walk along
these costs is a cheapest parse. The brackets of JSON need a stack: there the backward costs forget which bracket is open, are a lower bound, and guide a
best-first search over a graph of open brackets, which is exact. Nothing bounds the number of edits or states.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np

#: Fields of a record.
FIELDS = 4
#: The cost of an edit of CSV quoting, above any number of missing or surplus delimiters.
QUOTING = 1 << 40
#: The cost of dropping a word that no quotes and delimiters can mend.
DROP = 3
#: Cells of the table of a block of lines.
CELLS = 4_000_000
#: Beyond any cost, for CSV and for JSON.
FAR, NEAR = np.int64(1 << 60), np.int32(1 << 28)

CSV_TOKEN = re.compile(r'"|,|[^",]+')
JSON_TOKEN = re.compile(r'[{}\[\]:,"]|[ \t\r\n]+|(?:\\.|[^{}\[\]:,"\s\\]|[^\S \t\r\n]|\\\Z)+', re.S)
SCALAR = re.compile(r"true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
STRING_PART = re.compile(r'(?:[^\x00-\x1f\\"]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*')


class Edit(NamedTuple):
    what: str  # insert, delete or drop
    text: str
    token: int
    quoting: bool  # mends the syntax; else the number of fields

    def say(self, at: list[int]) -> str:
        return f"{self.what} {self.text} at {at[self.token]}"


class Machine:
    """An automaton as arrays. steps[kind][state] and inserts[state] are lists of (state, cost, what, text)."""

    def __init__(self, states: int, accept: int, steps: list[list[list[tuple]]], inserts: list[list[tuple]], far: np.integer):
        self.states, self.accept, self.steps, self.inserts, self.far = states, accept, steps, inserts, far
        pad = [[[(s, 0, "", "")] for s in range(states)]]  # the last kind fills shorter lines at their beginning
        self.step_to, self.step_cost = self._arrays(steps + pad)
        to, cost = self._arrays([inserts])
        self.insert_to, self.insert_cost = to[:, 0], cost[:, 0]

    def _arrays(self, tables: list[list[list[tuple]]]) -> tuple[np.ndarray, np.ndarray]:
        width = max(1, *(len(edges) for t in tables for edges in t))
        to = np.full((width, len(tables), self.states), self.states, np.int64)  # the state behind the last is out of reach
        cost = np.zeros(to.shape, self.far.dtype)
        for k, t in enumerate(tables):
            for s, edges in enumerate(t):
                for i, e in enumerate(edges):
                    to[i, k, s], cost[i, k, s] = e[0], e[1]
        return to, cost

    def costs(self, kinds: list[np.ndarray]) -> np.ndarray:
        """The least cost to the end, by token, line and state; lines are aligned at their ends."""
        rows, longest = len(kinds), max(map(len, kinds))
        filled = np.full((longest, rows), len(self.steps), np.int64)
        for i, k in enumerate(kinds):
            filled[longest - len(k) :, i] = k
        out = np.full((longest + 1, rows, self.states + 1), self.far)
        out[longest, :, self.accept] = 0
        base = (np.arange(rows) * (self.states + 1))[:, None]
        for p in range(longest - 1, -1, -1):
            k, after, now = filled[p], out[p + 1].ravel(), out[p, :, : self.states]
            for to, cost in zip(self.step_to, self.step_cost):
                np.minimum(now, after[base + to[k]] + cost[k], out=now)
            while True:
                before = now.copy()
                for to, cost in zip(self.insert_to, self.insert_cost):
                    np.minimum(now, out[p].take(to, axis=1) + cost, out=now)
                if np.array_equal(before, now):
                    break
        return out


def _blocks(sizes: list[int], states: int) -> Iterator[list[int]]:
    """The lines by length, in blocks of at most so many cells, at least one line each."""
    block: list[int] = []
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        if block and (len(block) + 1) * (sizes[i] + 1) * states > CELLS:
            yield block
            block = []
        block.append(i)
    if block:
        yield block


# --- CSV

_QUOTE, _COMMA, _TEXT, _END = range(4)


@lru_cache(maxsize=1)
def csv_machine() -> Machine:
    """States: where in a field (s start, u bare, q quoted, e after the closing quote) times the number of delimiters so far.

    Missing delimiters are inserted at the end and surplus ones deleted between fields, at a cost of one each. Every other edit mends the quoting.
    """
    at = "suqe"
    number = lambda a, k: at.index(a) * FIELDS + k
    accept = len(at) * FIELDS
    steps = [[[] for _ in range(accept + 1)] for _ in range(4)]
    inserts: list[list[tuple]] = [[] for _ in range(accept + 1)]
    for k in range(FIELDS):
        for a, to in (("s", "q"), ("q", "e"), ("e", "q")):
            steps[_QUOTE][number(a, k)].append((number(to, k), 0, "", ""))
            inserts[number(a, k)].append((number(to, k), QUOTING, "insert", '"'))
        for a, to in (("s", "u"), ("u", "u"), ("q", "q")):
            steps[_TEXT][number(a, k)].append((number(to, k), 0, "", ""))
        for a in at:
            s = number(a, k)
            steps[_QUOTE][s].append((s, QUOTING, "delete", '"'))
            if a == "q":
                steps[_COMMA][s].append((s, 0, "", ""))
                continue
            if k + 1 < FIELDS:
                steps[_COMMA][s].append((number("s", k + 1), 0, "", ""))
                inserts[s].append((number("s", k + 1), QUOTING, "insert", ","))
            steps[_COMMA][s] += [(number("s", k), 1, "delete", ","), (s, QUOTING, "delete", ",")]
            steps[_END][s].append((accept, FIELDS - 1 - k, "insert", "," * (FIELDS - 1 - k)))
    return Machine(accept + 1, accept, steps, inserts, FAR)


def csv_tokens(line: str) -> tuple[list[str], np.ndarray]:
    tokens = CSV_TOKEN.findall(line)
    return tokens, np.array([*(_QUOTE if t == '"' else _COMMA if t == "," else _TEXT for t in tokens), _END])


def _walk(m: Machine, tokens: list[str], kinds: list[int], costs: list[list[int]]) -> list[Edit]:
    s, p, edits = 0, 0, []
    while p < len(kinds):
        for to, cost, what, text in m.steps[kinds[p]][s]:
            if cost + costs[p + 1][to] == costs[p][s]:
                p += 1
                break
        else:
            to, cost, what, text = next(e for e in m.inserts[s] if e[1] + costs[p][e[0]] == costs[p][s])
        if cost:
            edits.append(Edit(what, text, p - (what == "delete" or p == len(kinds)), cost >= QUOTING))
        s = to
    return edits


def csv_edits(tokenized: list[tuple[list[str], np.ndarray]]) -> list[list[Edit]]:
    """The edits of a cheapest parse of each line as a record."""
    m, out = csv_machine(), [[] for _ in tokenized]
    for block in _blocks([len(t) for t, _ in tokenized], m.states):
        costs = m.costs([tokenized[i][1] for i in block])
        for row, i in enumerate(block):
            tokens, kinds = tokenized[i]
            out[i] = _walk(m, tokens, kinds.tolist(), costs[len(costs) - 1 - len(kinds) :, row].tolist())
    return out


# --- JSON

DELIMITERS = '"{}[]:,'
#: Kinds of tokens besides the delimiters: blanks, other white space, a scalar, a word that fits in a string, any other word, the end.
_BLANK, _SPACE, _SCALAR, _WORD, _BAD, _STOP = range(len(DELIMITERS), len(DELIMITERS) + 6)
#: Modes: r at the root, o in an object, a in an array. v value expected, d done, K first key or end, k key, S in a key, c colon, s in a string, n after a value, f first element or end.
MODES = ("rv", "rd", "oK", "ok", "oS", "oc", "ov", "os", "on", "af", "av", "as", "an")
_VALUE = {'"': "s", "{": "push", "[": "push"}
#: What a delimiter leads to: a mode, a bracket that opens, or one that closes.
MOVES: dict[str, dict[str, str]] = {
    "rv": {"{": "push"},
    "rd": {},
    "oK": {'"': "oS", "}": "pop"},
    "ok": {'"': "oS"},
    "oS": {'"': "oc"},
    "oc": {":": "ov"},
    "ov": {"{": "push", "[": "push", '"': "os"},
    "os": {'"': "on"},
    "on": {",": "ok", "}": "pop"},
    "af": {"{": "push", "[": "push", '"': "as", "]": "pop"},
    "av": {"{": "push", "[": "push", '"': "as"},
    "as": {'"': "an"},
    "an": {",": "av", "]": "pop"},
}
_OPENED = {"{": "oK", "[": "af"}
_AFTER_SCALAR = {"ov": "on", "af": "an", "av": "an"}


def json_tokens(text: str) -> tuple[list[str], np.ndarray]:
    tokens = JSON_TOKEN.findall(text)
    kinds = []
    for t in tokens:
        if len(t) == 1 and (d := DELIMITERS.find(t)) >= 0:
            kinds.append(d)
        elif t[0] in " \t\r\n":
            kinds.append(_SPACE if t.strip(" ") else _BLANK)
        elif STRING_PART.fullmatch(t):
            kinds.append(_SCALAR if SCALAR.fullmatch(t) else _WORD)
        else:
            kinds.append(_BAD)
    return tokens, np.array([*kinds, _STOP])


def _json_step(mode: str, kind: int) -> list[tuple[str, int]]:
    """(mode, push or pop; cost) after a token; ``stay`` leaves all as it is."""
    out = []
    if kind == _STOP:
        return [("accept", 0)] if mode == "rd" else []
    if kind < len(DELIMITERS):
        if to := MOVES[mode].get(DELIMITERS[kind]):
            out.append((to, 0))
        elif mode in ("oS", "os", "as"):
            return [("stay", 0)]
        return [*out, ("stay", 1)]
    if mode in ("oS", "os", "as"):
        return [("stay", 0 if kind in (_BLANK, _SCALAR, _WORD) else DROP)]
    if kind in (_BLANK, _SPACE):
        return [("stay", 0)]
    if kind == _SCALAR and mode in _AFTER_SCALAR:
        out.append((_AFTER_SCALAR[mode], 0))
    return [*out, ("stay", DROP)]


STEPS = {(m, k): _json_step(m, k) for m in MODES for k in range(_STOP + 1)}


@lru_cache(maxsize=16)
def json_machine(deepest: int) -> Machine:
    """States: mode times the number of open brackets, whose kinds are forgotten; ``deepest`` stands for that number or more."""
    accept = len(MODES) * (deepest + 1)
    number = lambda mode, d: MODES.index(mode) * (deepest + 1) + d

    def targets(mode: str, d: int, to: str, bracket: str) -> list[int]:
        if to == "stay":
            return [number(mode, d)]
        if to == "accept":
            return [accept]
        if to == "push":
            return [number(_OPENED[bracket], min(d + 1, deepest))]
        if to == "pop":
            below = {d - 1} | ({d} if d == deepest else set())
            return [number(x, b) for b in sorted(below) for x in (("rd",) if b == 0 else ("on", "an"))]
        return [number(to, d)]

    steps = [[[] for _ in range(accept + 1)] for _ in range(_STOP + 1)]
    inserts: list[list[tuple]] = [[] for _ in range(accept + 1)]
    for mode in MODES:
        for d in range(deepest + 1):
            if (mode[0] == "r") != (d == 0):
                continue
            s = number(mode, d)
            for kind in range(_STOP + 1):
                for to, cost in STEPS[mode, kind]:
                    steps[kind][s] += [(t, cost) for t in targets(mode, d, to, DELIMITERS[kind] if kind < len(DELIMITERS) else "")]
            for bracket, to in MOVES[mode].items():
                inserts[s] += [(t, 1) for t in targets(mode, d, to, bracket)]
    return Machine(accept + 1, accept, steps, inserts, NEAR)


def _search(tokens: list[str], kinds: list[int], bound: list[list[int]] | np.ndarray, deepest: int) -> list[Edit]:
    """The edits of a cheapest parse: states beyond a limit of cost are not kept, and the limit rises until there is a parse."""
    least = limit = int(bound[0][MODES.index("rv") * (deepest + 1)])
    while True:
        found, over = _search_within(limit, tokens, kinds, bound, deepest)
        if found is not None:
            return found
        limit = over + (limit - least)  # the step doubles, so the passes are few


def _search_within(limit: int, tokens: list[str], kinds: list[int], bound: list[list[int]] | np.ndarray, deepest: int) -> tuple[list[Edit] | None, int]:
    """The edits of a cheapest parse that costs at most the limit, or None and the least cost beyond it. Best first by the cost so far and the bound of the rest.

    A bracket that opens at one place and depth is one frame for all parses that open it there: its inside is searched once, and each of its
    ends is handed to all who opened it. So the states are (token, mode, frame), at most of the order of the tokens squared.
    """
    column = {m: i * (deepest + 1) for i, m in enumerate(MODES)}
    n = len(kinds)
    over = int(NEAR)
    depth, bracket, base = [0], [""], [0]
    frames: dict[tuple, int] = {}
    callers: list[list[tuple]] = [[]]
    ends: list[list[tuple]] = [[]]
    best: dict[tuple, int] = {}
    came: dict[tuple, tuple] = {}
    queue: dict[int, list] = {}

    def rest(p: int, mode: str, d: int) -> int:
        return int(bound[p][column[mode] + min(d, deepest)])

    def push(p: int, mode: str, frame: int, g: int, origin: tuple) -> None:
        nonlocal over
        state = (p, mode, frame)
        if best.get(state, NEAR) <= g:
            return
        d = depth[frame]
        if mode == "accept":
            h = 0
        elif mode == "closed":
            h = rest(p, "rd", 0) if d == 1 else min(rest(p, "on", d - 1), rest(p, "an", d - 1)) if d <= deepest else 0
        else:
            h = rest(p, mode, d)
        if g + h > limit:
            over = min(over, g + h)
        else:
            best[state], came[state] = g, origin
            queue.setdefault(g + h, []).append((g, state))

    def back(frame: int) -> str:
        return "rd" if not frame else "on" if bracket[frame] == "{" else "an"

    push(0, "rv", 0, 0, ())
    while queue:
        f = min(queue)
        layer = queue[f]
        while layer:
            g, state = layer.pop()
            if best[state] < g:
                continue
            p, mode, frame = state
            if mode == "accept":
                return _trace(came, state), over
            if mode == "closed":
                inner = g - base[frame]
                ends[frame].append((p, inner, state))
                for at, caller, edit in callers[frame]:
                    push(p, back(caller[2]), caller[2], at + inner, (caller, edit, state))
                continue
            if frame and came[state] == ():  # the inside of a frame begins, at the least cost of those who opened it
                base[frame] = g
            kind = kinds[p]
            token = tokens[p] if p < n - 1 else ""
            moves = [(p, to, 1, "insert", c) for c, to in MOVES[mode].items()]
            moves += [(p + 1, to, cost, "delete" if cost == 1 else "drop", token) for to, cost in reversed(STEPS[mode, kind])]
            for p2, to, cost, what, text in moves:
                edit = Edit(what, text, p, True) if cost else None
                if to == "push":
                    if (f2 := g + cost + rest(p2, _OPENED[text], depth[frame] + 1)) > limit:
                        over = min(over, f2)
                        continue
                    key = (p2, text, depth[frame] + 1)
                    inside = frames.setdefault(key, len(depth))
                    if inside == len(depth):
                        depth.append(key[2])
                        bracket.append(text)
                        base.append(0)
                        callers.append([])
                        ends.append([])
                    callers[inside].append((g + cost, state, edit))
                    push(p2, _OPENED[text], inside, g + cost, ())
                    for q, inner, end in ends[inside]:
                        push(q, back(frame), frame, g + cost + inner, (state, edit, end))
                else:
                    push(p2, "closed" if to == "pop" else mode if to == "stay" else to, frame, g + cost, (state, edit))
        del queue[f]
    return None, over


def _trace(came: dict[tuple, tuple], state: tuple) -> list[Edit]:
    """The edits on the way to a state, in order."""
    out, todo = [], [state]
    while todo:
        x = todo.pop()
        if isinstance(x, Edit):
            out.append(x)
        elif x is not None:
            todo += came[x]  # the way before it, the edit, and the inside of a closed frame, which is the latest
    return out[::-1]


def json_edits(tokenized: list[tuple[list[str], np.ndarray]]) -> list[list[Edit]]:
    """The edits of a cheapest parse of each line as one JSON object; none if it is one."""
    out: list[list[Edit]] = [[] for _ in tokenized]
    by_depth: dict[int, list[int]] = {}
    opening, closing = [DELIMITERS.index(c) for c in "{["], [DELIMITERS.index(c) for c in "}]"]
    for i, (_, kinds) in enumerate(tokenized):
        level = int(np.cumsum(np.isin(kinds, opening).astype(int) - np.isin(kinds, closing)).max(initial=0))
        room = CELLS // (len(MODES) * len(kinds))  # with fewer depths told apart the bound is weaker, and the result the same
        by_depth.setdefault(max(4, min(4 << (level // 4).bit_length(), 1 << room.bit_length() >> 1)), []).append(i)
    for deepest, lines in by_depth.items():
        m = json_machine(deepest)
        for block in _blocks([len(tokenized[i][0]) for i in lines], m.states):
            costs = m.costs([tokenized[lines[b]][1] for b in block])
            for row, b in enumerate(block):
                tokens, kinds = tokenized[lines[b]]
                mine = costs[len(costs) - 1 - len(kinds) :, row]
                out[lines[b]] = _search(tokens, kinds.tolist(), mine.tolist() if mine.size < CELLS else mine, deepest)
    return out


def say(edits: list[Edit], tokens: list[str]) -> str:
    """The edits in words, with the position of each."""
    at = [0]
    for t in tokens:
        at.append(at[-1] + len(t))
    return "; ".join(e.say(at) for e in edits)
