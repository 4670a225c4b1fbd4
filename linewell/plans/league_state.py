"""The state of a league as affine maps: one small matrix per game, on numbers or on whole maps.

Every update of a rating is affine in the league's state, which has two systems that don't mix:

    form     for each opponent-adjusted measure: what a team produces, what it allows, and the league's level
    levels   a team's margin, plays, points for, points against and pace, and the league's plays and points

A game moves five coordinates of each measure and twelve levels, by a matrix that only depends on which of its facts are known,
and a vector of its facts. A system is an array (measures, coordinates, width): with width 1 it holds values; with one column per
coordinate and a last one for constants it holds an affine map of the state ahead of a run of games, which the same steps compose.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Rating hyperparameters.
PARAMS = {"k_margin": 0.07, "margin_cap": 24.0, "hfa_update": 1.7, "a_eff": 0.10, "a_pace": 0.10, "carry": 0.60,
          "qb_decay": 0.97, "qb_shrink": 150.0, "qb_new": 150.0}
# League starting points, league step, passer prior before enough evidence.
LEAGUE_START = {"epa": 0.0, "sr": 0.44, "pass_epa": 0.05, "rush_epa": -0.08, "plays": 62.0, "points": 22.0}
NEUTRAL_PACE_START = 32.5
LEAGUE_STEP = 0.01
EARLY_PRIOR, PRIOR_EVIDENCE = -0.05, 300.0

ADJUSTED = ("epa", "sr", "pass_epa", "rush_epa")      # opponent-adjusted measures
LEVELS = (*ADJUSTED, "plays", "points")               # what a league keeps
TEAM_VALUES = ("margin", *[f"off_{m}" for m in ADJUSTED], *[f"dfn_{m}" for m in ADJUSTED], "plays", "points_for", "points_against", "pace")
STARTS = np.array([LEAGUE_START[n] for n in LEVELS])
SIDES = [f"{s}_{c}" for c in (*ADJUSTED, "plays", "neutral_spp") for s in ("home", "away")]
GAME_COLUMNS = ["result", "neutral_site", "home_score", "away_score", "both_sides", *SIDES]
SAME, NEW_SEASON, DEBUT = 0, 1, 2


TEAM_LEVELS = ("margin", "plays", "points_for", "points_against", "pace")


def shapes(t: int) -> list[tuple[int, int]]:
    return [(len(ADJUSTED), 2 * t + 1), (1, len(TEAM_LEVELS) * t + 2)]


def identity(t: int) -> list[np.ndarray]:
    """The map of no game at all."""
    return [np.repeat(np.eye(n, n + 1)[None], k, 0) for k, n in shapes(t)]


_M = len(ADJUSTED)
_LEVEL_AT = [TEAM_VALUES.index(n) for n in TEAM_LEVELS]


def gather(teams: np.ndarray, levels: np.ndarray) -> list[np.ndarray]:
    """Systems of width 1 from a row of TEAM_VALUES per team and the LEVELS."""
    form = np.concatenate([teams[:, 1:1 + _M].T, teams[:, 1 + _M:1 + 2 * _M].T, levels[:_M, None]], 1)
    return [form[..., None], np.concatenate([teams[:, _LEVEL_AT].T.ravel(), levels[_M:]])[None, :, None]]


def scatter(systems: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The reverse of ``gather``."""
    form, rest = systems[0][..., -1], systems[1][0, :, -1]
    t = form.shape[1] // 2
    teams = np.empty((t, len(TEAM_VALUES)))
    teams[:, 1:1 + _M], teams[:, 1 + _M:1 + 2 * _M] = form[:, :t].T, form[:, t:2 * t].T
    teams[:, _LEVEL_AT] = rest[:-2].reshape(-1, t).T
    return teams, np.concatenate([form[:, 2 * t], rest[-2:]])


def apply_map(maps: list[np.ndarray], state: list[np.ndarray]) -> list[np.ndarray]:
    return [m[..., :-1] @ s + m[..., -1:] for m, s in zip(maps, state)]


def pack(maps: list[np.ndarray]) -> tuple[bytes, bytes]:
    """Places and values of the entries of a map that aren't zero: teams that never meet, directly or not, don't mix."""
    flat = np.concatenate([m.ravel() for m in maps])
    at = np.flatnonzero(flat)
    return at.astype(np.int64).tobytes(), flat[at].tobytes()


def unpack(t: int, at: bytes, values: bytes) -> list[np.ndarray]:
    sizes = [k * n * (n + 1) for k, n in shapes(t)]
    flat = np.zeros(sum(sizes))
    flat[np.frombuffer(at, np.int64)] = np.frombuffer(values)
    return [part.reshape(k, n, n + 1) for part, (k, n) in zip(np.split(flat, np.cumsum(sizes)[:-1]), shapes(t))]


# coordinates of a measure that a game moves, then of the levels
OFF_H, OFF_A, DFN_H, DFN_A, LEAGUE = range(5)
MARGIN, PLAYS, FOR, AGAINST, PACE = range(0, 10, 2)   # home; away is next
ALL_PLAYS, ALL_POINTS = 10, 11


def form_matrices(p: dict) -> np.ndarray:
    """By [home known][away known]: the move of (off, off, dfn, dfn, league) of one measure."""
    out = np.repeat(np.eye(5)[None], 4, 0).reshape(2, 2, 5, 5)
    for side, off, dfn in ((0, OFF_H, DFN_A), (1, OFF_A, DFN_H)):
        known = out[1] if side == 0 else out[:, 1]
        for row in (off, dfn):
            known[:, row, [off, dfn, LEAGUE]] -= p["a_eff"]
    out[1, 1, LEAGUE, LEAGUE] = 1 - LEAGUE_STEP
    return out


def level_matrices(p: dict) -> np.ndarray:
    """By [both sides][home pace known][away pace known]: the move of the twelve levels."""
    out = np.repeat(np.eye(12)[None], 8, 0).reshape(2, 2, 2, 12, 12)
    swing = p["k_margin"] * np.array([[1, -1], [-1, 1]])
    out[..., MARGIN:MARGIN + 2, MARGIN:MARGIN + 2] -= swing
    stay = 1 - p["a_pace"]
    for k in range(FOR, AGAINST + 2):
        out[..., k, k] = stay
    out[..., ALL_POINTS, ALL_POINTS] = 1 - LEAGUE_STEP
    out[1, ..., PLAYS, PLAYS] = out[1, ..., PLAYS + 1, PLAYS + 1] = stay
    out[1, ..., ALL_PLAYS, ALL_PLAYS] = 1 - LEAGUE_STEP
    out[1, 1, :, PACE, PACE] = out[1, :, 1, PACE + 1, PACE + 1] = stay
    return out


@dataclass
class Run:
    """A run of games of one league in order, in local numbers of its teams."""
    t: int
    home: np.ndarray
    away: np.ndarray
    opening: np.ndarray   # (games, 2): SAME, NEW_SEASON or DEBUT of either team
    facts: np.ndarray     # (games, GAME_COLUMNS), NaN for nulls

    def __len__(self) -> int:
        return len(self.home)

    def moves(self, p: dict) -> tuple[np.ndarray, ...]:
        """Of all games at once: whether they are played, the form coordinates, their matrix and vector, and the same of the levels."""
        n, t, w, c = len(self), self.t, p["a_pace"], LEAGUE_STEP
        result, at_neutral, home_score, away_score, both, *sides = self.facts.T
        played, both = ~np.isnan(result), (both > 0) & ~np.isnan(result)
        x, (plays, pace) = np.array(sides[:2 * _M]).reshape(_M, 2, n), np.array(sides[2 * _M:]).reshape(2, 2, n)
        known = ~np.isnan(x) & both
        x, paced = np.where(known, x, 0.0), ~np.isnan(pace) & both
        form_v = np.empty((n, _M, 5))
        for side, rows in ((0, (OFF_H, DFN_A)), (1, (OFF_A, DFN_H))):
            form_v[..., rows] = p["a_eff"] * x[:, side].T[..., None]
        form_v[..., LEAGUE] = np.where(known.all(1), c * x.mean(1), 0.0).T
        form_m = form_matrices(p)[known[:, 0].T.astype(int), known[:, 1].T.astype(int)]
        level_v = np.zeros((n, 12))
        surprise = p["k_margin"] * (np.clip(result, -p["margin_cap"], p["margin_cap"]) - np.where(at_neutral > 0, 0.0, p["hfa_update"]))
        level_v[:, MARGIN], level_v[:, MARGIN + 1] = surprise, -surprise
        for k, v in ((FOR, home_score), (FOR + 1, away_score), (AGAINST, away_score), (AGAINST + 1, home_score)):
            level_v[:, k] = w * v
        level_v[:, ALL_POINTS] = c * (home_score + away_score) / 2
        for side in (0, 1):
            level_v[:, PLAYS + side] = np.where(both, w * plays[side], 0.0)
            level_v[:, PACE + side] = np.where(paced[side], w * pace[side], 0.0)
        level_v[:, ALL_PLAYS] = np.where(both, c * plays.mean(0), 0.0)
        level_m = level_matrices(p)[both.astype(int), paced[0].astype(int), paced[1].astype(int)]
        h, a = self.home, self.away
        form_at = np.column_stack([h, a, t + h, t + a, np.full(n, 2 * t)])
        level_at = np.column_stack([k * t + side for k in range(len(TEAM_LEVELS)) for side in (h, a)] + [np.full(n, 5 * t), np.full(n, 5 * t + 1)])
        return played, form_at, form_m, form_v, level_at, level_m, level_v

    def open_seasons(self, i: int, form: np.ndarray, rest: np.ndarray, p: dict) -> None:
        """Ratings shrink towards nothing and levels towards the league's where a team's season begins; all of them at its first game."""
        t, s = self.t, len(TEAM_LEVELS)
        for k, kind in zip((self.home[i], self.away[i]), self.opening[i]):
            if kind == SAME:
                continue
            keep = p["carry"] if kind == NEW_SEASON else 0.0
            form[:, [k, t + k]] *= keep
            rest[k] *= keep
            for level, league in ((1, s * t), (2, s * t + 1), (3, s * t + 1)):
                rest[level * t + k] = keep * rest[level * t + k] + (1 - keep) * rest[league]
            if kind == DEBUT:
                rest[4 * t + k] = 0.0
                rest[4 * t + k, -1] = NEUTRAL_PACE_START

    def compose(self, p: dict) -> list[np.ndarray]:
        """The affine map of the whole run."""
        maps = identity(self.t)
        self.walk(maps, p)
        return maps

    def walk(self, systems: list[np.ndarray], p: dict, record=None) -> None:
        """Moves the systems over the run, in place; ``record`` is called with a game's coordinates ahead of its result and after it."""
        form, rest = systems[0], systems[1][0]
        starts = self.opening.any(1)
        played, form_at, form_m, form_v, level_at, level_m, level_v = self.moves(p)
        for i in range(len(self)):
            if starts[i]:
                self.open_seasons(i, form, rest, p)
            f, r = form[:, form_at[i]], rest[level_at[i]]
            moved = f
            if played[i]:
                moved = form_m[i] @ f
                moved[..., -1] += form_v[i]
                form[:, form_at[i]] = moved
                new = level_m[i] @ r
                new[:, -1] += level_v[i]
                rest[level_at[i]] = new
            if record is not None:
                record(i, f, r, moved)

    def replay(self, state: list[np.ndarray], p: dict) -> tuple[np.ndarray, np.ndarray]:
        """From the state ahead of the run (moved in place): TEAM_VALUES of both teams ahead of each game (games, 2, values), and after each game the
        league's pass level with what either defence allows by passing (games, 3)."""
        n = len(self)
        form, level, after = np.empty((n, _M, 5)), np.empty((n, 12)), np.empty((n, 3))
        by_pass = ADJUSTED.index("pass_epa")

        def record(i: int, f: np.ndarray, r: np.ndarray, moved: np.ndarray) -> None:
            form[i], level[i], after[i] = f[..., 0], r[:, 0], moved[by_pass, [LEAGUE, DFN_H, DFN_A], 0]

        self.walk(state, p, record)
        ahead = np.empty((n, 2, len(TEAM_VALUES)))
        ahead[:, :, 1:1 + _M], ahead[:, :, 1 + _M:1 + 2 * _M] = form[:, :, [OFF_H, OFF_A]].transpose(0, 2, 1), form[:, :, [DFN_H, DFN_A]].transpose(0, 2, 1)
        ahead[:, :, _LEVEL_AT] = level[:, :10].reshape(n, 5, 2).transpose(0, 2, 1)
        return ahead, after
