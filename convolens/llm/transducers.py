"""Weighted finite-state transducers over word classes, and the grammar of toxic clauses made of them.

A transducer reads a symbol, puts one out and multiplies a weight; ``compose`` feeds one's output to the
next. ``GRAMMAR`` is the composition negation > reported speech > target > threat > insult:

* negation lessens an insult in its reach and takes a threat back;
* reported speech lessens insults behind a verb of saying, up to the clause's end, and takes threats back;
* a target (you, your, ...) makes insults weigh more behind it;
* a threat counts with a target on either side, close by;
* insults and threats that arrive become HIT, with the weight of their path.

The end of a clause brings every machine back to its start.
"""

from __future__ import annotations

from dataclasses import dataclass

WORD, INSULT, THREAT, TARGET, NEGATION, REPORT, END, HIT = range(8)
SYMBOLS = range(8)
#: Words that a negation reaches, and words between a threat and its target.
REACH = 3
NEGATED, REPORTED, AIMED = 0.2, 0.4, 1.5


@dataclass(frozen=True)
class Transducer:
    """Moves (state, symbol) -> (state, symbol put out, weight); state 0 is the start."""

    moves: dict[tuple[int, int], tuple[int, int, float]]
    states: int

    def compose(self, then: Transducer) -> Transducer:
        """Both machines in turn, over the states that can be reached."""
        numbers, moves, open_ = {(0, 0): 0}, {}, [(0, 0)]
        while open_:
            a, b = open_.pop()
            for symbol in SYMBOLS:
                next_a, middle, first = self.moves[a, symbol]
                next_b, out, second = then.moves[b, middle]
                if (next_a, next_b) not in numbers:
                    numbers[next_a, next_b] = len(numbers)
                    open_.append((next_a, next_b))
                moves[numbers[a, b], symbol] = numbers[next_a, next_b], out, first * second
        return Transducer(moves, len(numbers))


def machine(states: int, **own: tuple) -> Transducer:
    """All symbols pass unchanged at weight 1 and END returns to the start, but for the moves that ``own`` lists."""
    moves = {(s, x): (0 if x == END else s, x, 1.0) for s in range(states) for x in SYMBOLS}
    for listed in own.values():
        moves.update(listed)
    return Transducer(moves, states)


def negation() -> Transducer:
    """State k: so many words are still in reach."""
    passing = {(s, x): (max(0, s - 1), x, 1.0) for s in range(REACH + 1) for x in (WORD, TARGET, REPORT, INSULT, THREAT)}
    begins = {(s, NEGATION): (REACH, NEGATION, 1.0) for s in range(REACH + 1)}
    lessened = {(s, INSULT): (s - 1, INSULT, NEGATED) for s in range(1, REACH + 1)}
    undone = {(s, THREAT): (s - 1, WORD, 1.0) for s in range(1, REACH + 1)}
    return machine(REACH + 1, passing=passing, begins=begins, lessened=lessened, undone=undone)


def reported() -> Transducer:
    """State 1: behind a verb of saying."""
    return machine(2, begins={(s, REPORT): (1, WORD, 1.0) for s in (0, 1)}, lessened={(1, INSULT): (1, INSULT, REPORTED)}, undone={(1, THREAT): (1, WORD, 1.0)})


def target() -> Transducer:
    """State 1: a target has been named."""
    return machine(2, begins={(s, TARGET): (1, TARGET, 1.0) for s in (0, 1)}, aimed={(1, INSULT): (1, INSULT, AIMED)})


def threat() -> Transducer:
    """States 1 to REACH: words left for a target after a threat; beyond: words left for a threat after a target."""
    after = REACH  # states after + 1 .. after + REACH follow a target
    passing = {(s, x): ((s - 1 if s not in (0, after + 1) else 0), x, 1.0) for s in range(2 * REACH + 1) for x in (WORD, NEGATION, INSULT)}
    waits = {(s, THREAT): (REACH, THREAT, 1.0) for s in range(after + 1)}
    aimed = {(s, THREAT): (0, HIT, 1.0) for s in range(after + 1, 2 * REACH + 1)}
    named = {(s, TARGET): (after + REACH, WORD, 1.0) for s in (0, *range(after + 1, 2 * REACH + 1))}
    meets = {(s, TARGET): (0, HIT, 1.0) for s in range(1, after + 1)}
    return machine(2 * REACH + 1, passing=passing, waits=waits, aimed=aimed, named=named, meets=meets)


def insult() -> Transducer:
    """Insults become hits."""
    return machine(1, hits={(0, INSULT): (0, HIT, 1.0)})


GRAMMAR = negation().compose(reported()).compose(target()).compose(threat()).compose(insult())


def weigh(clause: list[tuple[int, float]], grammar: Transducer = GRAMMAR) -> float:
    """The sum of the hits of one clause of (symbol, lexical weight); a target that completes a threat weighs as the threat."""
    state, total, pending = 0, 0.0, 0.0
    for symbol, weight in clause:
        state, out, factor = grammar.moves[state, symbol]
        if symbol == THREAT and out != WORD:
            pending = weight
        if out == HIT:
            total += factor * (weight if symbol == INSULT else pending)
    return total
