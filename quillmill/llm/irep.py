"""Ordered rule lists by incremental reduced-error pruning (Fürnkranz and Widmer, ICML 1994)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Condition = tuple[str, str, float]  # feature, "<=" or ">=", threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered: float  # weight of the training rows that the rule took
    right: float  # weight of those among them that are positive

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(table.values()))), dtype=bool)
        for name, sign, at in self.conditions:
            out &= table[name] <= at if sign == "<=" else table[name] >= at
        return out

    def sql(self) -> str:
        return " AND ".join(f"{name} {sign} {at!r}" for name, sign, at in self.conditions) or "TRUE"


def _cuts(values: np.ndarray, most: int) -> np.ndarray:
    """Midpoints between neighbouring values, thinned to `most` by rank."""
    known = np.unique(values)
    if len(known) < 2:
        return np.zeros(0)
    middle = (known[1:] + known[:-1]) / 2
    return middle if len(middle) <= most else middle[np.linspace(0, len(middle) - 1, most).astype(int)]


def _grow(places: dict[str, np.ndarray], label: np.ndarray, weight: np.ndarray, cuts: dict[str, np.ndarray], longest: int) -> list[Condition]:
    """A rule grown by information gain; `places` holds, by feature, the number of the first cut that is not less than the value."""
    inside = np.ones(len(label), dtype=bool)
    rule: list[Condition] = []
    while len(rule) < longest:
        own, mine = label[inside], weight[inside]
        p0, n0 = mine[own].sum(), mine[~own].sum()
        if n0 <= 0 or p0 <= 0:
            break
        base, best, chosen, at = np.log2(p0 / (p0 + n0)), 1e-9, None, 0
        for name, points in cuts.items():
            if not len(points):
                continue
            place = places[name][inside]
            low_p, low_n = (np.cumsum(np.bincount(place, w, len(points) + 1))[:-1] for w in (mine * own, mine * ~own))
            for sign, p, n in (("<=", low_p, low_n), (">=", p0 - low_p, n0 - low_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 1e-9, p * (np.log2(p / (p + n)) - base), 0)
                if gain[k := int(np.argmax(gain))] > best:
                    best, chosen, at = gain[k], (name, sign, float(points[k])), k
        if chosen is None:
            break
        rule.append(chosen)
        inside &= places[chosen[0]] <= at if chosen[1] == "<=" else places[chosen[0]] > at
    return rule


def _prune(rule: list[Condition], table: dict[str, np.ndarray], label: np.ndarray, weight: np.ndarray) -> list[Condition]:
    best, kept = -np.inf, rule
    for size in range(len(rule), 0, -1):
        held = Rule(tuple(rule[:size]), 0, 0).holds(table)
        p, n = weight[held & label].sum(), weight[held & ~label].sum()
        worth = (p - n) / (p + n) if p + n > 0 else -1.0
        if worth >= best:
            best, kept = worth, rule[:size]
    return kept


def induce(table: dict[str, np.ndarray], label: np.ndarray, weight: np.ndarray | None = None, *, seed: int = 7, most_rules: int = 40, longest: int = 6, points: int = 64, worst_error: float = 0.3) -> list[Rule]:
    """Rules for the positive rows, in order; rows that none takes are negative.

    Each rule is grown on two thirds of the rows left, pruned on the other third, and kept if its error there is at most
    `worst_error`; the rows it takes then leave.  No rows, or no positive ones, give no rules.
    """
    label = np.asarray(label, dtype=bool)
    weight = np.ones(len(label)) if weight is None else np.asarray(weight, dtype=float)
    table = {k: np.asarray(v, dtype=float) for k, v in table.items()}
    cuts = {k: np.unique(np.round(_cuts(v, points), 6)) for k, v in table.items()}
    places = {k: np.searchsorted(cuts[k], v) for k, v in table.items()}
    rng, left, rules, failed = np.random.default_rng(seed), np.arange(len(label)), [], 0
    while len(rules) < most_rules and failed < 5 and label[left].any():
        mixed = rng.permutation(left)
        grow, prune = mixed[: -(-2 * len(mixed) // 3)], mixed[-(-2 * len(mixed) // 3) :]
        part = lambda rows: ({k: v[rows] for k, v in table.items()}, label[rows], weight[rows])
        found = _grow({k: v[grow] for k, v in places.items()}, label[grow], weight[grow], cuts, longest)
        if not found:
            failed += 1
            continue
        found = _prune(found, *part(prune))
        check = Rule(tuple(found), 0, 0).holds(part(prune)[0])
        p, n = weight[prune][check & label[prune]].sum(), weight[prune][check & ~label[prune]].sum()
        if p + n == 0 or n / (p + n) > worst_error:
            failed += 1  # another split may do better
            continue
        failed = 0
        taken = Rule(tuple(found), 0, 0).holds(part(left)[0])
        rules.append(Rule(tuple(found), float(weight[left][taken].sum()), float(weight[left][taken & label[left]].sum())))
        left = left[~taken]
    return rules


def to_case(rules: list[Rule], yes: str = "TRUE", no: str = "FALSE") -> str:
    """The rule list as one SQL CASE expression over columns named like the features."""
    if not rules:
        return no
    return "CASE " + " ".join(f"WHEN {r.sql()} THEN {yes}" for r in rules) + f" ELSE {no} END"
