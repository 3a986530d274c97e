"""What a line must have for a pattern to match anywhere in it: read off the pattern, so that most patterns are passed
over without a search."""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as K
from re import _parser as P


@dataclass(frozen=True)
class Needs:
    chars: frozenset[str] = frozenset()  # each of these characters
    digits: int = 0  # as many ASCII digits
    run: int = 0  # as many of them in a row
    head: int = 0  # digits at the start and the end of every match
    tail: int = 0
    solid: bool = False  # a match consists of digits alone

    def then(self, b: Needs) -> Needs:
        return Needs(self.chars | b.chars, self.digits + b.digits, max(self.run, b.run, self.tail + b.head), self.digits + b.head if self.solid else self.head, b.digits + self.tail if b.solid else b.tail, self.solid and b.solid)


_NOTHING, _EMPTY, _DIGIT = Needs(), Needs(solid=True), Needs(frozenset(), 1, 1, 1, 1, True)


def _either(parts: list[Needs]) -> Needs:
    least = lambda f: min(getattr(x, f) for x in parts)
    return Needs(frozenset.intersection(*(x.chars for x in parts)), least("digits"), least("run"), least("head"), least("tail"), all(x.solid for x in parts))


def _ascii_digits(items) -> bool:
    return all((op is K.LITERAL and 48 <= x <= 57) or (op is K.RANGE and 48 <= x[0] and x[1] <= 57) for op, x in items)


def _sequence(items, flags: int) -> Needs:
    out = _EMPTY
    for op, x in items:
        out = out.then(_one(op, x, flags))
    return out


def _one(op, x, flags: int) -> Needs:
    if op is K.LITERAL:
        c = chr(x)
        return _DIGIT if "0" <= c <= "9" else _NOTHING if flags & re.IGNORECASE and c.lower() != c.upper() else Needs(frozenset(c))
    if op is K.IN:
        return _DIGIT if _ascii_digits(x) else _NOTHING
    if op is K.BRANCH:
        return _either([_sequence(p, flags) for p in x[1]])
    if op is K.SUBPATTERN:
        return _sequence(x[3], (flags | x[1]) & ~x[2])
    if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
        least, one = x[0], _sequence(x[2], flags)
        if least == 0:
            return Needs(solid=one.solid)
        if one.solid:
            n = min(least * one.digits, 1000)
            return Needs(one.chars, n, n, n, n, True)
        return Needs(one.chars, min(least * one.digits, 1000), max(one.run, one.tail + one.head if least > 1 else 0), one.head, one.tail)
    if op is K.ATOMIC_GROUP:
        return _sequence(x, flags)
    if op in (K.AT, K.ASSERT, K.ASSERT_NOT):
        return _EMPTY
    return _NOTHING


def _no_digit(op, x) -> bool:
    """Whether an item is one character, and never an ASCII digit."""
    if op is K.LITERAL:
        return not 48 <= x <= 57
    if op is not K.IN:
        return False
    if x[0][0] is K.NEGATE:
        return any(o is K.RANGE and y[0] <= 48 and y[1] >= 57 for o, y in x)
    return all((o is K.LITERAL and not 48 <= y <= 57) or (o is K.RANGE and (y[1] < 48 or y[0] > 57)) for o, y in x)


def _flat(items):
    for op, x in items:
        if op is K.SUBPATTERN and not x[1] and not x[2]:
            yield from _flat(x[3])
        else:
            yield op, x


def _whole_runs(items) -> tuple[tuple[int, int], ...]:
    """The least and most digits of each run that a match holds whole, with something else or an end on either side."""
    out, now = [], None
    for op, x in _flat(items):
        edge = op is K.BRANCH and all(len(p) == 1 and (p[0] in _ENDS or _no_digit(*p[0])) for p in x[1])
        repeat = op in (K.MAX_REPEAT, K.MIN_REPEAT) and len(x[2]) == 1
        one, least, most = (x[2][0], x[0], x[1]) if repeat else ((op, x), 1, 1)
        if edge or (least and _no_digit(*one)):
            if now and now[0]:
                out.append(now)
            now = (0, 0)
        elif now and ((one[0] is K.IN and _ascii_digits(one[1])) or (one[0] is K.LITERAL and 48 <= one[1] <= 57)):
            now = (now[0] + least, now[1] + int(most))
        else:
            now = None
    return tuple(out)


_ENDS = ((K.AT, K.AT_BEGINNING), (K.AT, K.AT_BEGINNING_STRING), (K.AT, K.AT_END_STRING))


def needs(pattern) -> tuple[Needs, tuple[tuple[int, int], ...]]:
    """Of a pattern of ``re``: what it needs, and the bounds of runs of digits of which a line must have one each. Of
    any other kind, nothing."""
    if not isinstance(pattern, re.Pattern) or not isinstance(pattern.pattern, str):
        return _NOTHING, ()
    parsed = P.parse(pattern.pattern, pattern.flags)
    flags = parsed.state.flags
    return _sequence(parsed, flags), () if flags & re.MULTILINE else _whole_runs(parsed)
