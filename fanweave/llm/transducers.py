"""Weighted finite-state transducers over symbols, in the tropical semiring (min, +)."""

from __future__ import annotations

from collections.abc import Callable, Hashable

EPSILON = ""
Symbol = Hashable
Arc = tuple[Symbol, float, int]          # output, weight, next state


class Machine:
    """States are numbered from 0, the start. ``table[state][symbol]`` are the arcs that read a
    symbol, ``EPSILON`` those that read nothing. ``rest`` gives the arcs of symbols that a state has
    no arc for; they are made on first use and kept."""

    def __init__(self) -> None:
        self.table: list[dict[Symbol, list[Arc]]] = []
        self.finals: set[int] = set()
        self.rest: dict[int, Callable[[Symbol], list[Arc]]] = {}
        self.made: dict[tuple[int, Symbol], list[Arc]] = {}

    def state(self, final: bool = False) -> int:
        self.table.append({})
        if final:
            self.finals.add(len(self.table) - 1)
        return len(self.table) - 1

    def add(self, state: int, symbol: Symbol, output: Symbol, weight: float, target: int) -> None:
        self.table[state].setdefault(symbol, []).append((output, weight, target))

    def arcs(self, state: int, symbol: Symbol) -> list[Arc]:
        found = self.table[state].get(symbol)
        if found is not None:
            return found
        if symbol == EPSILON or state not in self.rest:
            return []
        found = self.made.get((state, symbol))
        if found is None:
            found = self.made[state, symbol] = self.rest[state](symbol)
        return found


def compose(a: Machine, b: Machine) -> Machine:
    """The transducer that reads what ``a`` reads and writes what ``b`` makes of its output.

    States are the reachable pairs of states. Arcs over symbols that the two name are made here, those
    over other symbols when they are asked for. Where ``a`` writes and ``b`` reads nothing, each moves by
    itself, so a path may come once for each order of these moves: no matter to a minimum."""
    out = Machine()
    number: dict[tuple[int, int], int] = {}
    todo: list[tuple[int, int]] = []

    def of(p: int, q: int) -> int:
        known = number.get((p, q))
        if known is None:
            known = number[p, q] = out.state(p in a.finals and q in b.finals)
            todo.append((p, q))
        return known

    def through(q: int, arcs: list[Arc]) -> list[Arc]:
        made: list[Arc] = []
        for middle, w, p2 in arcs:
            if middle == EPSILON:
                made.append((EPSILON, w, of(p2, q)))
            else:
                made += [(o, w + v, of(p2, q2)) for o, v, q2 in b.arcs(q, middle)]
        return made

    def fill() -> None:
        while todo:
            p, q = todo.pop()
            state = number[p, q]
            read = set(a.table[p])
            if p in a.rest:
                read |= set(b.table[q])
            read.discard(EPSILON)
            for symbol in read:
                if made := through(q, a.arcs(p, symbol)):
                    out.table[state][symbol] = made
            alone = through(q, a.arcs(p, EPSILON))
            alone += [(o, w, of(p, q2)) for o, w, q2 in b.arcs(q, EPSILON)]
            if alone:
                out.table[state][EPSILON] = alone
            if p in a.rest and q in b.rest:
                out.rest[state] = lambda symbol, p=p, q=q: later(p, q, symbol)

    def later(p: int, q: int, symbol: Symbol) -> list[Arc]:
        made = through(q, a.arcs(p, symbol))
        fill()
        return made

    of(0, 0)
    fill()
    return out


def shortest(machine: Machine, symbols: list[Symbol]) -> tuple[float, list[Symbol]] | None:
    """Weight and output of the shortest path that reads ``symbols``, None where there is none.
    Of paths of one weight the first found stays. Weights are not negative."""
    front: dict[int, tuple[float, list[Symbol]]] = {0: (0.0, [])}

    def better(into: dict, state: int, weight: float, output: list[Symbol]) -> bool:
        if state in into and into[state][0] <= weight:
            return False
        into[state] = (weight, output)
        return True

    def close(into: dict) -> dict:
        todo = list(into)
        while todo:
            state = todo.pop()
            weight, output = into[state]
            for o, w, target in machine.arcs(state, EPSILON):
                if better(into, target, weight + w, output if o == EPSILON else [*output, o]):
                    todo.append(target)
        return into

    front = close(front)
    for symbol in symbols:
        ahead: dict[int, tuple[float, list[Symbol]]] = {}
        for state, (weight, output) in front.items():
            for o, w, target in machine.arcs(state, symbol):
                better(ahead, target, weight + w, output if o == EPSILON else [*output, o])
        front = close(ahead)
    ends = [front[s] for s in front if s in machine.finals]
    return min(ends, key=lambda x: x[0]) if ends else None
