"""Cheapest edits that make a run of turns a well-formed conversation: an auction over an integer-cost lattice.

Nodes are (turns read, state); states are where a conversation may stand: nothing yet, behind a system turn,
behind a user turn, behind an assistant turn. Edits are arcs. Prices start at what the turns left cost at
the least; a path grows from the origin along arcs that are tight at the present prices (extension) and, where
none is, the price of its last node rises to the best arc's and the path gives that node up (contraction). Once
the path arrives, prices are dual optimal: exactly the arcs that are tight and lead on to the end by tight
arcs lie on cheapest paths, and the least letter among them at each node spells the least audit.

Longer runs are a tree: every span of ``SPAN`` turns tells its cost between any two states, ``SPAN`` spans are
a lattice of such costs, and prices come back down the tree. So no auction sees more than some hundred
arcs, and runs of one conversation can lie in different tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

FAR = 1 << 60
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: A turn's code: the class of its role's initial, whether it is cut short, whether it has to go.
INITIALS = {"s": 0, "u": 1, "a": 2}
OTHER, CUT_SHORT, HAS_TO_GO = 3, 4, 8
REROLE, DELETE, INSERT, MEND = 3, 4, 3, 3
#: Where a turn of an initial leads from each state, and the states a user or assistant turn leads to.
LEADS = {START: {0: SYSTEM, 1: USER}, SYSTEM: {1: USER}, USER: {2: ASSISTANT}, ASSISTANT: {1: USER}}
TALK = {state: [to for role, to in leads.items() if role in (1, 2)] for state, leads in LEADS.items()}
#: Letters as the lattice spells them: who an edit leads to decides which one, and as a state has one way only,
#: they sort as the audit's letters do.
INSERTS, REROLES = {USER: "I", ASSISTANT: "J"}, {USER: "R", ASSISTANT: "S"}
#: What each state still has to insert behind the last turn, and what that costs.
TAIL = ("", "IJ", "J", "")
AT_END = tuple(INSERT * len(letters) for letters in TAIL)
SPAN = 16

Arc = tuple[int, int, str]
Costs = tuple[int, ...]
#: Per entry state the letters and the state behind the run; None where no cheapest path enters.
Moves = tuple[tuple[str, int] | None, ...]


@lru_cache
def turn_arcs(code: int) -> tuple[list[Arc], ...]:
    """From each state before a turn: ``(cost, state behind it, letter)``."""
    out = []
    for state in STATES:
        arcs = [(DELETE, state, "D")]
        if not code & HAS_TO_GO:
            more = MEND if code & CUT_SHORT else 0
            kept = LEADS[state].get(code & 3)
            if kept is not None:
                arcs.append((more, kept, "K"))
            arcs += [(REROLE + more, to, REROLES[to]) for to in TALK[state]]
        out.append(arcs)
    return tuple(out)


def span_arcs(costs: Costs) -> list[list[Arc]]:
    """The same for a span, from its costs between states (place ``entry * 4 + exit``)."""
    return [[(costs[4 * a + b], b, "") for b in STATES if costs[4 * a + b] < FAR] for a in STATES]


class Lattice:
    """Layers of four nodes and one end node; inserts are arcs within every layer but the last."""

    def __init__(self, steps: Sequence[Sequence[list[Arc]]], exits: Costs, inserts: bool):
        self.end = 4 * (len(steps) + 1)
        arcs: list[list[Arc]] = []
        for i, step in enumerate(steps):
            for state in STATES:
                out = [(cost, 4 * i + 4 + to, letter) for cost, to, letter in step[state]]
                arcs.append(out + [(INSERT, 4 * i + to, INSERTS[to]) for to in TALK[state]] if inserts else out)
        self.arcs = [*arcs, *([(exits[s], self.end, "")] if exits[s] < FAR else [] for s in STATES), []]
        alive = self.leading_to_end(lambda cost, a, b: True)
        self.arcs = [[arc for arc in out if arc[1] in alive] for out in self.arcs]
        self.price, left = [0] * (self.end + 1), 0
        for first in range(self.end - 4, -1, -4):  # feasible: leaving a layer costs its cheapest way out at the least
            left += min((cost for out in self.arcs[first : first + 4] for cost, b, _ in out if b >= first + 4), default=0)
            self.price[first : first + 4] = [left] * 4

    def leading_to_end(self, counts: Callable[[int, int, int], bool]) -> set[int]:
        """Nodes from which arcs that count lead to the end."""
        back: list[list[int]] = [[] for _ in self.arcs]
        for a, out in enumerate(self.arcs):
            for cost, b, _ in out:
                if counts(cost, a, b):
                    back[b].append(a)
        seen, todo = {self.end}, [self.end]
        while todo:
            for a in back[todo.pop()]:
                if a not in seen:
                    seen.add(a)
                    todo.append(a)
        return seen

    def auction(self, origin: int) -> int:
        """Distance from a node to the end. The prices it leaves are feasible, so another origin can go on with them."""
        price, arcs = self.price, self.arcs
        if not arcs[origin]:
            return FAR
        path = [origin]
        while (here := path[-1]) != self.end:
            best, to = min((cost + price[b], b) for cost, b, _ in arcs[here])
            if price[here] == best:  # extension
                path.append(to)
            else:  # contraction
                price[here] = best
                if len(path) > 1:
                    path.pop()
        return price[origin]

    def tight(self) -> set[int]:
        """Auction from every entry; then the nodes from which tight arcs lead to the end."""
        for origin in STATES:
            self.auction(origin)
        return self.leading_to_end(lambda cost, a, b: self.price[a] == cost + self.price[b])

    def trace(self, origin: int, good: set[int]) -> tuple[str, int]:
        """Least letters among the cheapest paths from a node, and the state they lead to."""
        letters, here, before = [], origin, origin
        while here != self.end:
            before = here
            letter, here = min((letter, b) for cost, b, letter in self.arcs[here] if b in good and self.price[before] == cost + self.price[b])
            letters.append(letter)
        return "".join(letters), before % 4


def between(steps: Sequence[Sequence[list[Arc]]], inserts: bool) -> Costs:
    """Cost from each entry state to each exit state."""
    costs = [FAR] * 16
    for out in STATES:
        lattice = Lattice(steps, tuple(0 if s == out else FAR for s in STATES), inserts)
        costs[out::4] = [lattice.auction(entry) for entry in STATES]
    return tuple(costs)


@lru_cache(1 << 15)
def turn_costs(codes: bytes) -> Costs:
    return between([turn_arcs(code) for code in codes], True)


@lru_cache(1 << 12)
def joined_costs(spans: tuple[Costs, ...]) -> Costs:
    return between([span_arcs(costs) for costs in spans], False)


@lru_cache(1 << 15)
def turn_moves(codes: bytes, exits: Costs) -> Moves:
    lattice = Lattice([turn_arcs(code) for code in codes], exits, True)
    good = lattice.tight()
    return tuple(lattice.trace(entry, good) if entry in good else None for entry in STATES)


def tree(costs: Sequence[Costs]) -> list[list[Costs]]:
    """Costs of spans, of spans of spans, and so on up to one for all."""
    levels = [list(costs)]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([joined_costs(tuple(below[i : i + SPAN])) for i in range(0, len(below), SPAN)])
    return levels


def relative(exits: Sequence[int]) -> Costs:
    """Prices from their least one on, which decide as well and recur more often."""
    least = min(exits)
    return tuple(e - least if e < FAR else FAR for e in exits) if least < FAR else tuple(exits)


def exit_prices(costs: Sequence[Costs], exits: Costs) -> list[Costs]:
    """Prices behind each span of a run, given those behind the run; ``FAR`` where no cheapest path passes."""
    levels = tree(costs)
    prices = [relative(exits)]
    for level in reversed(levels[:-1]):
        below = []
        for i, behind in enumerate(prices):
            spans = level[i * SPAN : (i + 1) * SPAN]
            lattice = Lattice([span_arcs(c) for c in spans], behind, False)
            good = lattice.tight()
            below += [relative([lattice.price[n] if n in good else FAR for n in range(4 * k, 4 * k + 4)]) for k in range(1, len(spans))]
            below.append(behind)
        prices = below
    return prices


def spans_of(codes: bytes) -> list[bytes]:
    return [codes[i : i + SPAN] for i in range(0, len(codes), SPAN)]


def run_costs(codes: bytes) -> Costs:
    """Costs of a run of at least one turn between any two states."""
    return tree([turn_costs(span) for span in spans_of(codes)])[-1][0]


def run_moves(codes: bytes, exits: Costs) -> Moves:
    """Least letters and exit state of a run for each entry state, given the prices behind it."""
    spans = spans_of(codes)
    steps = [turn_moves(span, behind) for span, behind in zip(spans, exit_prices([turn_costs(s) for s in spans], exits))]
    out: list[tuple[str, int] | None] = []
    for entry in STATES:
        letters, here = [], entry
        for moves in steps:
            if moves[here] is None:
                break
            more, here = moves[here]
            letters.append(more)
        out.append(("".join(letters), here) if len(letters) == len(steps) else None)
    return tuple(out)


def cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and least letters of a whole conversation that lies in one place."""
    if not codes:
        return 0, ""
    costs = run_costs(codes)
    letters, state = run_moves(codes, AT_END)[START]
    return min(costs[b] + AT_END[b] for b in STATES), letters + TAIL[state]
