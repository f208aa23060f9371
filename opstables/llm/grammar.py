"""Sequences of turns as grammars, and the cheapest repair of each rule as a min-plus matrix with audits.

A turn is a symbol: its role's initial (s, u, a, or o for any other), upper case if its text is truncated, or x if it must go.
A repaired conversation is (s?(ua)+)?, an automaton of four states; a symbol's matrix has, for each pair of states, the least cost
of the edits that lead from one to the other over it, and the ASCII-least audit of that cost.  Matrices multiply: sums for costs,
concatenation for audits, minima over the state between.  Two audits of like cost over the same turns are never prefixes of each other
(the longer one would have further inserts, which cost), so the least of two parts is the least of the whole.

Re-Pair replaces the most frequent pair of symbols by a rule again and again; a rule's matrix is the product of its parts', made
once for all conversations that hold it.  Audits are ropes: a rule's audit joins those of its parts, and hashes tell equal ropes.
"""

from __future__ import annotations

from collections import defaultdict
from heapq import heapify, heappop, heappush
from typing import Any

#: (length, hash, text) of a leaf, (length, hash, left, right) of two joined.
Rope = tuple[Any, ...]
#: Row by row: (cost, audit) from each state to each, None where no edits lead.
Matrix = list[tuple[int, Rope] | None]

#: States: nothing yet, after s, after u, after a.
NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SYMBOLS = "xsuaoSUAO"
#: Rules after which a new grammar begins.
MOST_RULES = 20_000
#: The hash of ropes: a polynomial modulo a prime.
_PRIME, _BASE = 2**61 - 1, 0x1F3D5B79ACE13579


def leaf(text: str) -> Rope:
    h = 0
    for c in text:
        h = (h * _BASE + ord(c)) % _PRIME
    return len(text), h, text


def joined(a: Rope, b: Rope) -> Rope:
    if not a[0] or not b[0]:
        return a if a[0] else b
    return a[0] + b[0], (a[1] * pow(_BASE, b[0], _PRIME) + b[1]) % _PRIME, a, b


def before(a: Rope, b: Rope) -> bool:
    """Whether a stands before b in ASCII order; parts of equal length and hash are passed over whole."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x[:2] == y[:2]:
            continue
        if len(x) == len(y) == 3:
            n = min(x[0], y[0])
            if x[2][:n] != y[2][:n]:
                return x[2] < y[2]
            left += [leaf(x[2][n:])] if x[0] > n else []
            right += [leaf(y[2][n:])] if y[0] > n else []
        elif len(y) == 3 or (len(x) == 4 and x[0] >= y[0]):
            left += [x[3], x[2]]
            right.append(y)
        else:
            left.append(x)
            right += [y[3], y[2]]
    return not left and bool(right)


def text_of(rope: Rope) -> str:
    parts, rest = [], [rope]
    while rest:
        x = rest.pop()
        if len(x) == 3:
            parts.append(x[2])
        else:
            rest += [x[3], x[2]]
    return "".join(parts)


def times(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = []
    for i in STATES:
        for j in STATES:
            ways = [(x[0] + y[0], x[1], y[1]) for x, y in ((a[4 * i + k], b[4 * k + j]) for k in STATES) if x and y]
            least = min((w[0] for w in ways), default=None)
            best: Rope | None = None
            for cost, x, y in ways:
                if cost == least:
                    rope = joined(x, y)
                    best = rope if best is None or before(rope, best) else best
            out.append(None if best is None else (least, best))
    return out


def _least(ways: list[tuple[int, int, int, str]]) -> Matrix:
    """The matrix of (from, to, cost, audit)."""
    out: Matrix = [None] * 16
    for i, j, cost, audit in sorted(ways, key=lambda w: (w[2], w[3]), reverse=True):
        out[4 * i + j] = cost, leaf(audit)
    return out


UNCHANGED = _least([(i, i, 0, "") for i in STATES])
_TO_USER, _TO_ASSISTANT = [(NOTHING, USER), (SYSTEM, USER), (ASSISTANT, USER)], [(USER, ASSISTANT)]
_ONE = _least([(i, i, 0, "") for i in STATES] + [(i, j, INSERT, "I") for i, j in _TO_USER + _TO_ASSISTANT])
#: Any inserts, or none.
INSERTS = times(times(_ONE, _ONE), _ONE)


def _symbol(symbol: str) -> Matrix:
    ways = [(i, i, DELETE, "D") for i in STATES]
    if symbol != "x":
        more = TRUNCATED if symbol.isupper() else 0
        kept = {"s": [(NOTHING, SYSTEM)], "u": _TO_USER, "a": _TO_ASSISTANT, "o": []}[symbol.lower()]
        ways += [(i, j, more, "K") for i, j in kept] + [(i, j, REROLE + more, "R") for i, j in _TO_USER + _TO_ASSISTANT]
    return times(INSERTS, _least(ways))


_OF_SYMBOLS = [_symbol(s) for s in SYMBOLS]


def finish(costs: list[tuple[int, Rope] | None]) -> tuple[int, str]:
    """Cost and audit, from the cheapest way to each state after the last turn."""
    last = times(costs + [None] * 12, INSERTS)
    return min((x[0], text_of(x[1])) for x in (last[NOTHING], last[ASSISTANT]) if x)


class Grammar:
    """Rules shared by all sequences that are given to it; each has its matrix."""

    def __init__(self) -> None:
        self._rules: dict[tuple[int, int], int] = {}
        self._matrices: list[Matrix] = list(_OF_SYMBOLS)

    def __len__(self) -> int:
        return len(self._rules)

    def _rule(self, a: int, b: int) -> int:
        if (a, b) not in self._rules:
            self._rules[a, b] = len(self._matrices)
            self._matrices.append(times(self._matrices[a], self._matrices[b]))
        return self._rules[a, b]

    def compressed(self, sequences: list[str]) -> list[list[int]]:
        """Re-Pair: while a pair of symbols stands in two places, the most frequent one becomes a rule."""
        s: list[int] = []
        starts = []
        for q in sequences:
            starts.append(len(s))
            s += [SYMBOLS.index(c) for c in q]
            s.append(-1)
        after, prior = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        where: dict[tuple[int, int], set[int]] = defaultdict(set)
        for i in range(len(s) - 1):
            if s[i] >= 0 and s[i + 1] >= 0:
                where[s[i], s[i + 1]].add(i)
        queue = [(-len(places), pair) for pair, places in where.items() if len(places) > 1]
        heapify(queue)
        while queue:
            n, pair = heappop(queue)
            places = where.get(pair, ())
            if len(places) != -n:  # counted before others changed
                if len(places) > 1:
                    heappush(queue, (-len(places), pair))
                continue
            rule, changed = self._rule(*pair), set()
            for i in sorted(places):
                j = after[i]
                if s[i] != pair[0] or s[j] != pair[1]:
                    continue  # overlapped the place before
                h, k = prior[i], after[j]
                if s[h] >= 0:
                    where[s[h], s[i]].discard(h)
                    where[s[h], rule].add(h)
                    changed.add((s[h], rule))
                if s[k] >= 0:
                    where[s[j], s[k]].discard(j)
                    where[rule, s[k]].add(i)
                    changed.add((rule, s[k]))
                s[i], s[j] = rule, -2
                after[i], prior[k] = k, i
            del where[pair]
            for p in changed:
                if len(where[p]) > 1:
                    heappush(queue, (-len(where[p]), p))
        out = []
        for i in starts:
            out.append([])
            while s[i] >= 0:
                out[-1].append(s[i])
                i = after[i]
        return out

    def matrices(self, sequences: list[str]) -> list[Matrix]:
        out = []
        for symbols in self.compressed(sequences):
            m = UNCHANGED
            for x in symbols:
                m = times(m, self._matrices[x])
            out.append(m)
        return out
