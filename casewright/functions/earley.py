"""A weighted Earley parser whose terminals are regular expressions.

The chart is kept by character position, so tokens are whatever the grammar
predicts there (no separate lexer): ambiguous spellings stay open until the
rest of the line settles them by weight. Only reachable positions are visited,
and there only what can begin with the character at hand, which is worked out
once per place in the rules and character. Rules of one symbol that begin alike
are followed together, and a terminal is matched once per position.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import product

import regex


@dataclass
class Grammar:
    """Rules by symbol: (weight, right-hand side). A side is a string of symbols parted by blanks; a symbol ending in ? may be missing.

    Symbols that name no rule are terminals and must be in ``terminals``
    (regular expressions, matched at the current position, never empty).
    Symbols of the form name:SYMBOL store the text of a terminal under name.
    A missing optional symbol costs the factor ``absent``.
    """

    start: str
    rules: Mapping[str, Sequence[tuple[float, str]]]
    terminals: Mapping[str, str]
    absent: float = 0.5

    #: Rules of a symbol share their beginnings: nodes of one tree per symbol take the place of dotted rules.
    _root: dict[str, int] = field(init=False)
    _edges: list[list[tuple[str, object, int]]] = field(init=False)  # (symbol, its matcher or None for a rule symbol, node after it)
    _weight: list[float | None] = field(init=False)  # log weight of the rule that ends at the node
    _name: list[str | None] = field(init=False)  # name under which the symbol before the node is stored
    _lhs: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self._root, self._edges, self._weight, self._name, self._lhs = {}, [], [], [], []
        matchers = {k: re.compile(v, re.S).match for k, v in self.terminals.items()}
        self._partial = {k: regex.compile(v, regex.S) for k, v in self.terminals.items()}
        self._can_begin: dict[tuple[str, str], bool] = {}
        self._live: dict[tuple[int, str], tuple] = {}
        children: dict[tuple[int, str, str], int] = {}
        for lhs, sides in self.rules.items():
            self._root[lhs] = self._add(lhs, None)
            for weight, side in sides:
                options = [(s[:-1], "") if s.endswith("?") else (s,) for s in side.split()]
                for chosen in product(*options):
                    kept = [s for s in chosen if s]
                    total = math.log(weight) + (len(chosen) - len(kept)) * math.log(self.absent)
                    node = self._root[lhs]
                    for s in kept:
                        name, _, sym = s.rpartition(":")
                        if (node, name, sym) not in children:
                            children[node, name, sym] = self._add(lhs, name or None)
                            self._edges[node].append((sym, None if sym in self.rules else matchers[sym], children[node, name, sym]))
                        node = children[node, name, sym]
                    if self._weight[node] is None or self._weight[node] < total:
                        self._weight[node] = total

    def _add(self, lhs: str, name: str | None) -> int:
        self._edges.append([])
        self._weight.append(None)
        self._name.append(name)
        self._lhs.append(lhs)
        return len(self._lhs) - 1

    def can_begin(self, sym: str, ch: str) -> bool:
        """Whether a text of ``sym`` can begin with ``ch`` (no symbol is ever empty)."""
        known = self._can_begin.get((sym, ch))
        if known is None:
            if sym in self.terminals:
                known = self._partial[sym].match(ch, partial=True) is not None
            else:
                self._can_begin[sym, ch] = False  # left recursion adds nothing
                known = any(self.can_begin(s, ch) for s, *_ in self._edges[self._root[sym]])
            self._can_begin[sym, ch] = known
        return known

    def _ways(self, node: int, ch: str) -> tuple:
        """Edges of a node whose symbol can begin with ``ch`` (at the end of the text, '', none)."""
        known = self._live.get((node, ch))
        if known is None:
            known = self._live[node, ch] = tuple(e for e in self._edges[node] if ch and self.can_begin(e[0], ch))
        return known

    def parse(self, text: str) -> tuple[float, list[tuple[str, int, int]]] | None:
        """The highest-scoring parse of the whole text: its log weight and the named spans (name, start, end), or None."""
        weights, lhs_of, roots, live = self._weight, self._lhs, self._root, self._live
        end = len(text)
        # per position: (node, origin) -> (score, back pointer)
        chart: dict[int, dict] = {0: {(roots[self.start], 0): (0.0, None)}}
        waiting: dict[int, dict[str, list]] = {}
        heap = [0]
        while heap:
            pos = heapq.heappop(heap)
            column = chart[pos]
            ch = text[pos] if pos < end else ""
            wait: dict[str, list] = {}
            waiting[pos] = wait
            matched: dict[str, int] = {}
            agenda = list(column)
            while agenda:
                state = agenda.pop()
                node, origin = state
                score = column[state][0]
                if weights[node] is not None and origin != pos:
                    total = score + weights[node]
                    old = chart[origin]
                    for parent, child in waiting[origin].get(lhs_of[node], ()):
                        ways = live.get((child, ch))
                        if not (self._ways(child, ch) if ways is None else ways) and weights[child] is None:
                            continue
                        to = (child, parent[1])
                        sum_ = old[parent][0] + total
                        if to not in column or column[to][0] < sum_:
                            column[to] = (sum_, (parent, origin, state))
                            agenda.append(to)
                ways = live.get((node, ch))
                for sym, match, child in self._ways(node, ch) if ways is None else ways:
                    if match is None:
                        asked = wait.get(sym)
                        if asked is None:
                            wait[sym] = [(state, child)]
                            opening = (roots[sym], pos)
                            column[opening] = (0.0, None)
                            agenda.append(opening)
                        elif (state, child) not in asked:
                            asked.append((state, child))
                        continue
                    at = matched.get(sym)
                    if at is None:
                        m = match(text, pos)
                        at = matched[sym] = pos if m is None else m.end()
                    if at == pos:
                        continue
                    next_ch = text[at] if at < end else ""
                    ways = live.get((child, next_ch))
                    if not (self._ways(child, next_ch) if ways is None else ways) and weights[child] is None:
                        continue
                    to = (child, origin)
                    into = chart.get(at)
                    if into is None:
                        into = chart[at] = {}
                        heapq.heappush(heap, at)
                    if to not in into or into[to][0] < score:
                        into[to] = (score, (state, pos, None))
        best = None
        for state, (score, _) in chart.get(end, {}).items():
            weight = weights[state[0]]
            if weight is not None and state[1] == 0 and lhs_of[state[0]] == self.start and (best is None or score + weight > best[0]):
                best = (score + weight, state)
        if best is None:
            return None
        spans: list[tuple[str, int, int]] = []
        stack = [(best[1], end)]
        while stack:
            state, pos = stack.pop()
            back = chart[pos][state][1]
            if back is None:
                continue
            previous, at, child = back
            if name := self._name[state[0]]:
                spans.append((name, at, pos))
            stack.append((previous, at))
            if child is not None:
                stack.append((child, pos))
        spans.sort(key=lambda s: (s[1], s[2]))
        return best[0], spans
