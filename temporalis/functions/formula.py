"""Signal temporal logic formulas: immutable trees, text form, rewrites, and a random sampler.

Windows are closed and in whole steps. Until's left side holds on [t, t'), an empty stretch
counting as +inf. ``horizon`` is the last step that the value at step 0 looks at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Atom:
    var: int
    threshold: float
    lte: bool = False

    def __str__(self) -> str:
        return f"x{self.var} {'<=' if self.lte else '>='} {repr(float(self.threshold)).removesuffix('.0')}"


@dataclass(frozen=True)
class Not:
    child: Formula

    def __str__(self) -> str:
        return f"!({self.child})"


@dataclass(frozen=True)
class And:
    left: Formula
    right: Formula

    def __str__(self) -> str:
        return f"({self.left} & {self.right})"


@dataclass(frozen=True)
class Or:
    left: Formula
    right: Formula

    def __str__(self) -> str:
        return f"({self.left} | {self.right})"


@dataclass(frozen=True)
class Globally:
    child: Formula
    lo: int
    hi: int

    def __str__(self) -> str:
        return f"G[{self.lo},{self.hi}]({self.child})"


@dataclass(frozen=True)
class Eventually:
    child: Formula
    lo: int
    hi: int

    def __str__(self) -> str:
        return f"F[{self.lo},{self.hi}]({self.child})"


@dataclass(frozen=True)
class Until:
    left: Formula
    right: Formula
    lo: int
    hi: int

    def __str__(self) -> str:
        return f"({self.left} U[{self.lo},{self.hi}] {self.right})"


Formula = Atom | Not | And | Or | Globally | Eventually | Until


def children(phi: Formula) -> tuple[Formula, ...]:
    match phi:
        case Atom():
            return ()
        case Not(c) | Globally(c, _, _) | Eventually(c, _, _):
            return (c,)
        case And(a, b) | Or(a, b) | Until(a, b, _, _):
            return (a, b)
    raise TypeError(f"not a formula: {phi!r}")


def horizon(phi: Formula) -> int:
    return getattr(phi, "hi", 0) + max((horizon(c) for c in children(phi)), default=0)


def depth(phi: Formula) -> int:
    return 1 + max(map(depth, children(phi))) if children(phi) else 0


def variables(phi: Formula) -> set[int]:
    return {phi.var} if isinstance(phi, Atom) else set().union(*map(variables, children(phi)))


def shifted(phi: Formula, delta: float) -> Formula:
    """The formula whose robustness is delta more everywhere."""
    match phi:
        case Atom(v, c, lte):
            return Atom(v, c + delta if lte else c - delta, lte)
        case Not(c):
            return Not(shifted(c, -delta))
        case And(a, b) | Or(a, b):
            return type(phi)(shifted(a, delta), shifted(b, delta))
        case Globally(c, lo, hi) | Eventually(c, lo, hi):
            return type(phi)(shifted(c, delta), lo, hi)
        case Until(a, b, lo, hi):
            return Until(shifted(a, delta), shifted(b, delta), lo, hi)
    raise TypeError(f"not a formula: {phi!r}")


def _parts(phi: Formula, kind: type) -> list[Formula]:
    return [*_parts(phi.left, kind), *_parts(phi.right, kind)] if isinstance(phi, kind) else [phi]


def fold(parts: list[Formula], kind: type = And) -> Formula:
    """Conjunction or disjunction of one or more formulas, from the left."""
    if not parts:
        raise ValueError("no formulas")
    out = parts[0]
    for p in parts[1:]:
        out = kind(out, p)
    return out


def simplify(phi: Formula) -> Formula:
    """The same robustness, written shorter: repeats, double negation, nested windows, like atoms."""
    match phi:
        case Not(Not(c)):
            return simplify(c)
        case Not(Atom(v, c, lte)):
            return Atom(v, c, not lte)
        case Not(c):
            return Not(simplify(c))
        case Globally(c, a, b) | Eventually(c, a, b):
            c = simplify(c)
            if type(c) is type(phi):
                return type(phi)(c.child, a + c.lo, b + c.hi)
            return type(phi)(c, a, b)
        case And() | Or():
            kind, kept = type(phi), {}
            for p in map(simplify, [*_parts(phi.left, type(phi)), *_parts(phi.right, type(phi))]):
                key = (p.var, p.lte) if isinstance(p, Atom) else p
                if key in kept and isinstance(p, Atom):
                    # And takes the harder of two like atoms, Or the easier
                    hard = min if p.lte == (kind is And) else max
                    p = Atom(p.var, hard(p.threshold, kept[key].threshold), p.lte)
                kept[key] = p
            return fold(list(kept.values()), kind)
        case Until(a, b, lo, hi):
            return Until(simplify(a), simplify(b), lo, hi)
    return phi


_TOKEN = re.compile(r"\s*(?:(x)(\d+)\s*(>=|<=)\s*([-+]?(?:\d+\.?\d*(?:e[-+]?\d+)?|inf))|([GFU])\[(\d+),(\d+)\]|([!&|()]))")


def parse(text: str) -> Formula:
    """Read a formula as ``str`` writes it. Without brackets, ! and windows bind most, then U, &, and |; like ones from the left."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        found = _TOKEN.match(text, at)
        if not found:
            raise ValueError(f"no formula at place {at}: {text}")
        tokens.append(found.groups())
        at = found.end()
    place = 0

    def sign() -> str | None:
        """The mark or window letter at this place."""
        return tokens[place][7] or tokens[place][4] if place < len(tokens) else None

    def take(wanted: str | None = None) -> tuple:
        nonlocal place
        if place == len(tokens) or (wanted and sign() != wanted):
            raise ValueError(f"{wanted or 'a formula'} is missing: {text}")
        place += 1
        return tokens[place - 1]

    def single() -> Formula:
        t = take()
        if t[0]:
            return Atom(int(t[1]), float(t[3]), t[2] == "<=")
        if t[7] == "!":
            return Not(single())
        if t[7] == "(":
            inner = joined(0)
            take(")")
            return inner
        if t[4] in ("G", "F"):
            return (Globally if t[4] == "G" else Eventually)(single(), int(t[5]), int(t[6]))
        raise ValueError(f"a formula is missing: {text}")

    def joined(level: int) -> Formula:
        if level == 3:
            return single()
        out = joined(level + 1)
        while sign() == "|&U"[level]:
            t = take()
            right = joined(level + 1)
            out = Until(out, right, int(t[5]), int(t[6])) if level == 2 else (Or, And)[level](out, right)
        return out

    whole = joined(0)
    if place < len(tokens):
        raise ValueError(f"more than a formula: {text}")
    return whole


class Sampler:
    """Random formulas; thresholds lie within each variable's bounds, horizons within t_max."""

    def __init__(self, low, high, t_max: int, depth_max: int = 3, seed: int = 0, only_temporal: bool = True, until_weight: float = 0.0):
        self.low, self.high = np.asarray(low, dtype=float), np.asarray(high, dtype=float)
        self.t_max, self.depth, self.only_temporal = t_max, depth_max, only_temporal
        self.until = until_weight
        self.random = np.random.default_rng(seed)

    def sample(self, n: int) -> list[Formula]:
        return [self._draw(self.depth, self.t_max, self.only_temporal) for _ in range(n)]

    def _atom(self) -> Atom:
        v = int(self.random.integers(len(self.low)))
        return Atom(v, float(self.random.uniform(self.low[v], self.high[v])), bool(self.random.integers(2)))

    def _draw(self, depth: int, steps: int, temporal: bool) -> Formula:
        if depth <= 0:
            return self._atom()
        weights = np.array([0.0 if temporal else 1.0, *[0.0 if temporal else 1.0] * 3, 2.0, 2.0, self.until])
        kind = int(self.random.choice(7, p=weights / weights.sum()))
        if kind == 0:
            return self._atom()
        if kind == 1:
            return Not(self._draw(depth - 1, steps, False))
        if kind in (2, 3):
            return (And, Or)[kind - 2](self._draw(depth - 1, steps, False), self._draw(depth - 1, steps, False))
        hi = int(self.random.integers(0, steps + 1))
        lo = int(self.random.integers(0, hi + 1))
        inner = [self._draw(depth - 1, steps - hi, False) for _ in range(1 + (kind == 6))]
        return Until(*inner, lo, hi) if kind == 6 else (Globally, Eventually)[kind - 4](*inner, lo, hi)
