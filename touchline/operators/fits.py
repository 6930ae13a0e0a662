"""Fits of goals and counts: penalised likelihoods maximised by damped Newton steps, one group a task.

A group is one league's matches before a date, some thousand rows, so a fit is grouped-map pandas; groups are
independent and as many run at once as there are cores.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config

GOAL_ETA, COUNT_ETA = (-8.0, 3.0), (-6.0, 5.0)
K_BOUNDS = (np.log(0.5), np.log(500.0))
SHARE_BOUND = 2.0
RIDGE_BOUNDS = (0.05, 200.0)
SPLIT_RATIO = 4.0
TAU_FLOOR = 1e-8


class TooFewMatches(ValueError):
    pass


class NoChances(ValueError):
    """A named target needs chances that the matches don't have."""


@dataclass
class Sides:
    """Both sides' linear predictors of matches as rows of one design: intercept, home, attack, defence, more."""

    home: np.ndarray
    away: np.ndarray
    teams: int
    group: np.ndarray | None = None  # a further effect shared by both sides, such as the referee's
    groups: int = 0

    def matrix(self) -> np.ndarray:
        n, t = len(self.home), self.teams
        x = np.zeros((2 * n, 2 + 2 * t + self.groups))
        up, low = np.arange(n), n + np.arange(n)
        x[:, 0], x[up, 1] = 1, 1
        x[up, 2 + self.home], x[low, 2 + self.away] = 1, 1
        x[up, 2 + t + self.away], x[low, 2 + t + self.home] = -1, -1
        if self.groups:
            x[up, 2 + 2 * t + self.group] = 1
            x[low, 2 + 2 * t + self.group] = 1
        return x


def golden(f, low: float, high: float, steps: int = 60) -> float:
    """The minimum of a function with one on an interval."""
    g = (5**0.5 - 1) / 2
    a, b = low, high
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    for _ in range(steps):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return (a + b) / 2


def newton(value, slope_and_curve, start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 60, tolerance: float = 1e-7) -> tuple[np.ndarray, bool]:
    """The minimum of value within bounds: Newton steps, halved until value falls, on what isn't at a bound."""
    x, now = start.copy(), value(start)
    for _ in range(rounds):
        g, h = slope_and_curve(x)
        free = ~(((x <= low) & (g > 0)) | ((x >= high) & (g < 0)))
        if not free.any() or np.abs(g[free]).max() < tolerance:
            return x, True
        step = np.zeros_like(x)
        step[free] = np.linalg.lstsq(h[np.ix_(free, free)], -g[free], rcond=None)[0]
        scale = 1.0
        while scale > 1e-8:
            y = np.clip(x + scale * step, low, high)
            then = value(y)
            if then < now:
                break
            scale /= 2
        else:
            return x, bool(np.abs(g[free]).max() < 1e-3)
        small = now - then < 1e-12 * max(1.0, abs(now))
        x, now = y, then
        if small:
            return x, True
    return x, False


def low_scores(x: np.ndarray, y: np.ndarray, lam: np.ndarray, mu: np.ndarray, rho: float):
    """The correction of each match's likelihood and its slopes in the logarithms of both rates."""
    t, dh, da = np.ones_like(lam), np.zeros_like(lam), np.zeros_like(lam)
    for h, a, change, up, low in ((0, 0, -lam * mu * rho, 1, 1), (0, 1, lam * rho, 1, 0), (1, 0, mu * rho, 0, 1), (1, 1, np.full_like(lam, -rho), 0, 0)):
        at = (x == h) & (y == a)
        t[at] += change[at]
        dh[at], da[at] = up * change[at], low * change[at]
    return np.maximum(t, TAU_FLOOR), dh, da


@dataclass
class Ridge:
    attack: float
    defence: float
    tau_attack: float | None = None
    tau_defence: float | None = None
    dispersion: float | None = None
    rounds: int = 0
    converged: bool = True


@dataclass
class Goals:
    teams: list[str]
    attack: list[float]
    defence: list[float]
    matches: list[int]
    intercept: float = 0.0
    home_advantage: float = 0.0
    rho: float = 0.0
    target: str = "goals"
    ridge_attack: float = 0.0
    ridge_defence: float = 0.0
    n_matches: int = 0
    effective_n: float = 0.0
    own_share: float = 0.0
    other_share: float = 0.0
    converged: bool = True
    notes: list[str] = field(default_factory=list)
    estimate: Ridge | None = None


def _codes(rows: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    teams = sorted(set(rows["home_team"]) | set(rows["away_team"]))
    at = {t: k for k, t in enumerate(teams)}
    return teams, rows["home_team"].map(at).to_numpy(), rows["away_team"].map(at).to_numpy()


def _prior(n: np.ndarray) -> np.ndarray:
    new = n < config.PROMOTED_MATCHES
    return np.concatenate([[0, 0], np.where(new, config.PROMOTED_ATTACK, 0.0), np.where(new, config.PROMOTED_DEFENCE, 0.0)])


class Pairs:
    """What a fit needs to know of matches: for each pair of home and away side, sums of weights, of goals and of their
    squares, and the weights of the four low scores. A rate depends on the pair only, so the likelihood of all
    matches is that of these sums, and a step costs as much for any number of matches."""

    def __init__(self, sides: Sides, x, y, w):
        t, groups = sides.teams, max(sides.groups, 1)
        code = (sides.home.astype(np.int64) * t + sides.away) * groups + (0 if sides.group is None else sides.group)
        held, at = np.unique(code, return_inverse=True)
        one = lambda v: np.bincount(at, v, len(held))
        self.sides = Sides(held // groups // t, held // groups % t, t, None if sides.group is None else held % groups, sides.groups)
        self.w, self.x, self.y, self.squares = one(w), one(w * x), one(w * y), np.r_[one(w * x * x), one(w * y * y)]
        self.low = [one(w * ((x == h) & (y == a))) for h, a in ((0, 0), (0, 1), (1, 0), (1, 1))]
        self.z, self.ww = np.r_[self.x, self.y], np.r_[self.w, self.w]

    def mean(self) -> float:
        return self.z.sum() / self.ww.sum()

    def corrections(self, rate: np.ndarray, rho: float):
        """For each low score its weights, its correction and the slopes in the logarithms of both rates."""
        n = len(self.w)
        lam, mu = rate[:n], rate[n:]
        zero = np.zeros(n)
        for held, change, up, low in zip(self.low, (-lam * mu * rho, lam * rho, mu * rho, zero - rho), (1, 1, 0, 0), (1, 0, 1, 0)):
            yield held, np.maximum(1 + change, TAU_FLOOR), up * change, low * change

    def value(self, eta: np.ndarray, rho: float, corrected: bool) -> float:
        rate = np.exp(eta)
        out = -(self.z * eta - self.ww * rate).sum()
        return out - sum((held * np.log(t)).sum() for held, t, _, _ in self.corrections(rate, rho)) if corrected else out

    def residual(self, rate: np.ndarray, rho: float, corrected: bool) -> np.ndarray:
        out = self.z - self.ww * rate
        if corrected:
            for held, t, dh, da in self.corrections(rate, rho):
                out = out + np.r_[held * dh / t, held * da / t]
        return out


def _poisson_stage(sides: Sides, x, y, w, penalty: tuple[float, float], prior: np.ndarray, corrected: bool, pairs: Pairs | None = None):
    """(theta, rho, converged) of the penalised Poisson likelihood with the low-score correction."""
    t, sums = sides.teams, pairs or Pairs(sides, x, y, w)
    matrix = sums.sides.matrix()
    ridge = np.concatenate([[0, 0], np.full(t, penalty[0]), np.full(t, penalty[1])])
    rho = -0.05 if corrected else 0.0

    def value(theta, rho):
        return sums.value(np.clip(matrix @ theta, *GOAL_ETA), rho, corrected) + (ridge * (theta - prior) ** 2).sum()

    def curve(theta, rho):
        rate = np.exp(np.clip(matrix @ theta, *GOAL_ETA))
        return -matrix.T @ sums.residual(rate, rho, corrected) + 2 * ridge * (theta - prior), (matrix * (sums.ww * rate)[:, None]).T @ matrix + np.diag(2 * ridge + 1e-9)

    theta = np.zeros(matrix.shape[1])
    theta[0], theta[1] = np.log(max(sums.mean(), 0.2)), 0.2
    high = np.concatenate([[5, 2], np.full(2 * t, 3.0)])
    done = False
    for _ in range(12):
        before = (theta.copy(), rho)
        theta, done = newton(lambda v: value(v, rho), lambda v: curve(v, rho), theta, -high, high)
        if not corrected:
            break
        eta, held = np.clip(matrix @ theta, *GOAL_ETA), (ridge * (theta - prior) ** 2).sum()
        rho = golden(lambda r: sums.value(eta, r, True) + held, -config.RHO_BOUND, config.RHO_BOUND)
        if abs(rho - before[1]) < 1e-7 and np.abs(theta - before[0]).max() < 1e-6:
            break
    return theta, rho, done


def _level_stage(sides: Sides, strengths: np.ndarray, x, y, w, corrected: bool):
    """(intercept, home advantage, rho) on goals, with the strengths held."""
    sums = Pairs(sides, x, y, w)
    n = len(sums.w)
    fixed = sums.sides.matrix()[:, 2:] @ strengths
    design = np.column_stack([np.ones(2 * n), np.r_[np.ones(n), np.zeros(n)]])
    rho = -0.05 if corrected else 0.0

    def value(v, rho):
        return sums.value(np.clip(fixed + design @ v, *GOAL_ETA), rho, corrected)

    def curve(v, rho):
        rate = np.exp(np.clip(fixed + design @ v, *GOAL_ETA))
        return -design.T @ sums.residual(rate, rho, corrected), (design * (sums.ww * rate)[:, None]).T @ design + 1e-9 * np.eye(2)

    v, high = np.array([np.log(max(sums.mean(), 0.2)), 0.2]), np.array([5.0, 2.0])
    for _ in range(12):
        v, _ = newton(lambda u: value(u, rho), lambda u: curve(u, rho), v, -high, high)
        if not corrected:
            break
        last, rho = rho, golden(lambda r: value(v, r), -config.RHO_BOUND, config.RHO_BOUND)
        if abs(rho - last) < 1e-7:
            break
    return float(v[0]), float(v[1]), rho


def _matches(rows: pd.DataFrame) -> np.ndarray:
    """How many matches each row stands for: alike ones may be one row with their number and the sum of their weights."""
    return rows["alike"].to_numpy(float) if "alike" in rows else np.ones(len(rows))


def _share_stage(sides: Sides, theta: np.ndarray, rho: float, rows: pd.DataFrame, w) -> tuple[float, float]:
    """How much a side's own and the other's missing share shift its rate; zero on fewer than 50 matches."""
    known = (rows["missing_home"].notna() & rows["missing_away"].notna()).to_numpy()
    if _matches(rows)[known].sum() < 50:
        return 0.0, 0.0
    n = int(known.sum())
    x, y = rows["home_goals"].to_numpy(float)[known], rows["away_goals"].to_numpy(float)[known]
    mh, ma = rows["missing_home"].to_numpy(float)[known], rows["missing_away"].to_numpy(float)[known]
    fixed = (sides.matrix() @ theta)[np.r_[known, known]]
    design, z, w = np.column_stack([np.r_[mh, ma], np.r_[ma, mh]]), np.r_[x, y], w[known]
    ww = np.r_[w, w]

    def value(v):
        eta = np.clip(fixed + design @ v, *GOAL_ETA)
        rate = np.exp(eta)
        return -(ww * (z * eta - rate)).sum() - (w * np.log(low_scores(x, y, rate[:n], rate[n:], rho)[0])).sum()

    def curve(v):
        rate = np.exp(np.clip(fixed + design @ v, *GOAL_ETA))
        t, dh, da = low_scores(x, y, rate[:n], rate[n:], rho)
        residual = ww * (z - rate) + np.r_[w * dh / t, w * da / t]
        return -design.T @ residual, (design * (ww * rate)[:, None]).T @ design + 1e-9 * np.eye(2)

    v, _ = newton(value, curve, np.zeros(2), np.full(2, -SHARE_BOUND), np.full(2, SHARE_BOUND))
    return float(v[0]), float(v[1])


def posterior(sides: Sides, theta: np.ndarray, x, y, w, penalty: tuple[float, float], prior: np.ndarray) -> tuple[float, float, float]:
    """(variance of attack, of defence, dispersion): squared gaps to the prior and Laplace posterior variances."""
    sums = Pairs(sides, x, y, w)
    t, matrix, ww = sides.teams, sums.sides.matrix(), sums.ww
    rate = np.exp(np.clip(matrix @ theta, *GOAL_ETA))
    info = (matrix * (ww * rate)[:, None]).T @ matrix
    ridge = np.diag(np.concatenate([[0, 0], np.full(t, 2 * penalty[0]), np.full(t, 2 * penalty[1])]))
    spent = float(np.trace(np.linalg.pinv(info + ridge) @ info))
    left = ww.sum() - spent
    spread = max(float(((sums.squares - 2 * rate * sums.z + ww * rate**2) / np.maximum(rate, 1e-8)).sum() / left), 1e-3) if left > 1 else 1.0
    variance = np.clip(np.diag(np.linalg.pinv(info / spread + ridge)), 0, None)
    gap = (theta - prior) ** 2
    part = lambda a: max(float(gap[a].mean() + variance[a].mean()), 1e-4)
    return part(slice(2, 2 + t)), part(slice(2 + t, 2 + 2 * t)), spread


def auto_ridge(step, start: float = 5.0, rounds: int = 5, tolerance: float = 0.02) -> Ridge:
    """Penalties that agree with the variances they lead to. step maps a pair to (variance, variance, dispersion)."""
    now, done, k, v = (start, start), False, 0, (np.nan, np.nan, 1.0)
    for k in range(1, rounds + 1):
        v = step(now)
        if not np.isfinite(v[:2]).all():
            raise ValueError(f"no finite variance at ridge {now}")
        then = tuple(float(np.clip(1 / (2 * s), *RIDGE_BOUNDS)) for s in v[:2])
        moved = max(abs(b - a) / max(a, 1e-9) for a, b in zip(now, then))
        now = then
        if moved < tolerance:
            done = True
            break
    return Ridge(now[0], now[1], float(np.sqrt(v[0])), float(np.sqrt(v[1])), v[2], k, done)


def split_ridge(attack_variance: float, defence_variance: float, level: float, most: float = SPLIT_RATIO) -> tuple[float, float]:
    """A pair with the given level and the variances' ratio, within bounds."""
    if attack_variance <= 0 or defence_variance <= 0:
        return level, level
    root = float(np.sqrt(np.clip(attack_variance / defence_variance, 1 / most, most)))
    return level / root, level * root


def pooled_variances(each: dict[str, float], share: float = 0.5) -> dict[str, float]:
    """Each league's variance drawn to the geometric mean of all."""
    if not each:
        return {}
    logs = {k: np.log(max(v, 1e-8)) for k, v in each.items()}
    mean, s = float(np.mean(list(logs.values()))), float(np.clip(share, 0, 1))
    return {k: float(np.exp((1 - s) * v + s * mean)) for k, v in logs.items()}


def goals(rows: pd.DataFrame, target: str | None = None, ridge=None, blend: float = 0.5, corrected: bool = True, shares: bool = False) -> Goals:
    """The goals model of weighted matches. A named target is kept or refused; without a name it is the blend
    where there are chances and goals where there aren't. ridge is a number, a pair, "auto" or "auto-split"."""
    notes: list[str] = []
    have = "home_xg" in rows and rows["home_xg"].notna().any() and rows["away_xg"].notna().any()
    if target not in (None, "goals", "xg", "blend"):
        raise ValueError(f"no target {target}")
    if target in ("xg", "blend") and not have:
        raise NoChances("no chances before this date")
    if target is None:
        target = "blend" if have else "goals"
        if not have:
            notes.append("no chances; fitted on goals")
    mode = ridge if isinstance(ridge, str) else None
    if mode not in (None, "auto", "auto-split"):
        raise ValueError(f"no ridge {ridge}")
    level = config.RIDGE[target]
    pair = (level, level) if ridge is None or mode else (float(ridge), float(ridge)) if np.isscalar(ridge) else tuple(map(float, ridge))
    need = ["home_goals", "away_goals"] + (["home_xg", "away_xg"] if target != "goals" else [])
    rows = rows.dropna(subset=need)
    alike = _matches(rows)
    if alike.sum() < config.MIN_FIT_MATCHES:
        raise TooFewMatches(f"{int(alike.sum())} usable matches are too few")
    teams, home, away = _codes(rows)
    w = rows["weight"].to_numpy(float)
    g = rows["home_goals"].to_numpy(float), rows["away_goals"].to_numpy(float)
    s = blend if target == "blend" else 1.0
    x, y = g if target == "goals" else tuple(s * rows[c].to_numpy(float) + (1 - s) * v for c, v in zip(("home_xg", "away_xg"), g))
    n = (np.bincount(home, alike, len(teams)) + np.bincount(away, alike, len(teams))).astype(int)
    sides, prior = Sides(home, away, len(teams)), _prior(n)
    sums = Pairs(sides, x, y, w)
    first = corrected and target == "goals"
    stage = lambda p: _poisson_stage(sides, x, y, w, p, prior, first, sums)
    found = None
    if mode:
        step = lambda p: posterior(sides, stage(p)[0], x, y, w, p, prior)
        if mode == "auto":
            found = auto_ridge(step)
        else:
            va, vd, spread = step((level, level))
            found = Ridge(*split_ridge(va, vd, level), float(np.sqrt(va)), float(np.sqrt(vd)), spread, 1)
        pair = found.attack, found.defence
    theta, rho, done = stage(pair)
    intercept, hfa = float(theta[0]), float(theta[1])
    if target != "goals":
        intercept, hfa, rho = _level_stage(sides, theta[2:], *g, w, corrected)
        theta = np.concatenate([[intercept, hfa], theta[2:]])
    own, other = _share_stage(sides, theta, rho, rows, w) if shares and "missing_home" in rows else (0.0, 0.0)
    t = len(teams)
    return Goals(teams, theta[2 : 2 + t].tolist(), theta[2 + t :].tolist(), n.tolist(), intercept, hfa, float(rho), target, pair[0], pair[1], int(alike.sum()), float(w.sum()), own, other, done, notes, found)


@dataclass
class Counts:
    teams: list[str]
    attack: list[float]
    defence: list[float]
    matches: list[int]
    intercept: float
    home_advantage: float
    dispersion: float
    total_dispersion: float
    referees: dict[str, float]
    n_matches: int
    converged: bool


def nb_whole(totals: np.ndarray, weights: np.ndarray, z: np.ndarray, ww: np.ndarray, mu: np.ndarray, k: float) -> float:
    """The sum of nb_log over matches: of totals, the numbers counted, with their weights, and by fixture z and ww, the
    sums of counts and of weights."""
    ratio = np.concatenate([[0.0], np.cumsum(np.log(k + np.arange(int(totals.max()) if len(totals) else 0)))])
    return float((weights * ratio[totals]).sum() + (ww * k * np.log(k / (k + mu)) + z * np.log(mu / (k + mu))).sum())


def nb_log(y: np.ndarray, mu: np.ndarray, k: float) -> np.ndarray:
    """Negative binomial log-likelihood of whole numbers, without what depends on y alone: the gamma ratio is a
    sum over the numbers below y."""
    top = int(y.max()) if len(y) else 0
    ratio = np.concatenate([[0.0], np.cumsum(np.log(k + np.arange(top)))])
    return ratio[y.astype(int)] + k * np.log(k / (k + mu)) + y * np.log(mu / (k + mu))


def counts(rows: pd.DataFrame, kind: str, ridge: float = 5.0, referees: bool | None = None) -> Counts:
    """The model of corners or cards of weighted matches, with the dispersion of a side's and of both sides' count."""
    if kind not in ("corners", "cards"):
        raise ValueError(f"no counts of {kind}")
    h, a = f"home_{kind}", f"away_{kind}"
    rows = rows.dropna(subset=[h, a])
    alike = _matches(rows)
    if alike.sum() < config.MIN_FIT_MATCHES:
        raise TooFewMatches(f"{int(alike.sum())} matches with {kind} are too few")
    teams, home, away = _codes(rows)
    n = (np.bincount(home, alike, len(teams)) + np.bincount(away, alike, len(teams))).astype(int)
    w = rows["weight"].to_numpy(float)
    names: list[str] = []
    group = None
    if (kind == "cards" if referees is None else referees) and "referee" in rows:
        freq = pd.Series(alike).groupby(rows["referee"].to_numpy()).sum()
        eligible = sorted(freq[freq >= config.REFEREE_MIN_MATCHES].index)
        if eligible:
            names = ["(other)", *eligible]
            group = rows["referee"].map({r: k for k, r in enumerate(names)}).fillna(0).astype(int).to_numpy()
    x, y = rows[h].to_numpy(float), rows[a].to_numpy(float)
    sums = Pairs(Sides(home, away, len(teams), group, len(names)), x, y, w)
    matrix, z, ww = sums.sides.matrix(), sums.z, sums.ww
    each, both = np.bincount(np.r_[x, y].astype(int), np.r_[w, w]), np.bincount((x + y).astype(int), w)
    t, m = len(teams), len(sums.w)
    prior = np.concatenate([_prior(n), np.zeros(len(names))])
    weight = np.concatenate([[0, 0], np.full(2 * t, ridge), np.full(len(names), ridge * config.REFEREE_RIDGE_FACTOR)])
    mean = lambda v: np.exp(np.clip(matrix @ v, *COUNT_ETA))
    theta, log_k, done = np.zeros(matrix.shape[1]), np.log(8.0), False
    theta[0] = np.log(max(sums.mean(), 0.2))
    high = np.concatenate([[5, 2], np.full(2 * t, 2.0), np.ones(len(names))])
    for _ in range(20):
        k = np.exp(log_k)

        def value(v, k=k):
            return -nb_whole(np.arange(len(each)), each, z, ww, mean(v), k) + (weight * (v - prior) ** 2).sum()

        def curve(v, k=k):
            mu = mean(v)
            return -matrix.T @ ((z - ww * mu) * k / (k + mu)) + 2 * weight * (v - prior), (matrix * (ww * mu * k / (k + mu))[:, None]).T @ matrix + np.diag(2 * weight + 1e-9)

        theta, done = newton(value, curve, theta, -high, high)
        mu = mean(theta)
        last, log_k = log_k, golden(lambda v: -nb_whole(np.arange(len(each)), each, z, ww, mu, np.exp(v)), *K_BOUNDS)
        if abs(log_k - last) < 1e-7:
            break
    total = golden(lambda v: -nb_whole(np.arange(len(both)), both, z[:m] + z[m:], sums.w, mu[:m] + mu[m:], np.exp(v)), *K_BOUNDS)
    effects = {r: float(e) for r, e in zip(names, theta[2 + 2 * t :]) if r != "(other)"}
    return Counts(teams, theta[2 : 2 + t].tolist(), theta[2 + t : 2 + 2 * t].tolist(), n.tolist(), float(theta[0]), float(theta[1]), float(np.exp(log_k)), float(np.exp(total)), effects, int(alike.sum()), done)


GOALS_SCHEMA = "intercept double, home_advantage double, rho double, target string, ridge_attack double, ridge_defence double, n_matches bigint, effective_n double, own_share double, other_share double, converged boolean, status string, ratings array<struct<team:string,attack:double,defence:double,matches:bigint>>"
COUNTS_SCHEMA = "intercept double, home_advantage double, dispersion double, total_dispersion double, n_matches bigint, converged boolean, status string, ratings array<struct<team:string,attack:double,defence:double,matches:bigint>>, referees map<string,double>"


def _empty(schema: str) -> dict:
    """A row of nulls. A column that is missing would come back as numbers, which no text column takes."""
    return dict.fromkeys(f.split()[0] for f in schema.split(", "))


def _ratings(m) -> list[dict]:
    return [{"team": t, "attack": a, "defence": d, "matches": int(n)} for t, a, d, n in zip(m.teams, m.attack, m.defence, m.matches)]


def fit_goals(training: DataFrame, keys: list[str], by: dict[str, dict] | None = None, **options) -> DataFrame:
    """(keys, parameters, status, ratings): one goals model for each group of weighted matches. A group that
    can't be fitted has its reason as status and null parameters. by gives further options for values of a key."""
    kinds = ", ".join(f"`{k}` {training.schema[k].dataType.simpleString()}" for k in keys)

    def run(key, rows):
        row = dict(zip(keys, key))
        own = {o: v for name, values in (by or {}).items() for o, v in values.get(row[name], {}).items()}
        return pd.DataFrame([row | goals_row(rows, **(options | own))])[[*keys, *_empty(GOALS_SCHEMA)]]

    return training.groupBy(*keys).applyInPandas(run, f"{kinds}, {GOALS_SCHEMA}")


def goals_row(rows: pd.DataFrame, **options) -> dict:
    """goals() as a row of GOALS_SCHEMA, a refusal too."""
    row = _empty(GOALS_SCHEMA)
    try:
        m = goals(rows, **options)
        return row | {k: v for k, v in asdict(m).items() if k not in ("teams", "attack", "defence", "matches", "notes", "estimate")} | {"status": "; ".join(m.notes) or "ok", "ratings": _ratings(m)}
    except (TooFewMatches, NoChances) as e:
        return row | {"status": str(e), "converged": False, "n_matches": int(_matches(rows).sum()), "ratings": []}


def counts_row(rows: pd.DataFrame, kind: str, **options) -> dict:
    """counts() as a row of COUNTS_SCHEMA, a refusal too."""
    row = _empty(COUNTS_SCHEMA)
    try:
        m = counts(rows, kind, **options)
        return row | {k: v for k, v in asdict(m).items() if k not in ("teams", "attack", "defence", "matches", "referees")} | {"status": "ok", "ratings": _ratings(m), "referees": m.referees}
    except TooFewMatches as e:
        return row | {"status": str(e), "converged": False, "n_matches": int(_matches(rows).sum()), "ratings": [], "referees": {}}


def fit_counts(training: DataFrame, keys: list[str], kind: str, **options) -> DataFrame:
    """(keys, parameters, status, ratings, referees) of corners or cards, as fit_goals."""
    kinds = ", ".join(f"`{k}` {training.schema[k].dataType.simpleString()}" for k in keys)

    def run(key, rows):
        return pd.DataFrame([dict(zip(keys, key)) | counts_row(rows, kind, **options)])[[*keys, *_empty(COUNTS_SCHEMA)]]

    return training.groupBy(*keys).applyInPandas(run, f"{kinds}, {COUNTS_SCHEMA}")


#: Dates of a league whose fits are one task.
BLOCK = 32


def fit_running(history: DataFrame, key: str, as_ofs: dict, columns: list[str], half_life: float, fit, schema: str) -> DataFrame:
    """(key, as_of, parameters …): a fit (of a frame, giving a row of schema) at each of a key's dates as_ofs, on all
    history (key, date, columns) before it, weighted by age.

    A match is sent to a key's first date after it, not to all of them: there alike ones become one row with their
    number and the sum of their weights, and a date's rows are those of the date before, aged, and what is new. A task
    has a key's BLOCK dates and holds kinds of matches.
    """
    spark, epoch = history.sparkSession, pd.Timestamp("1970-01-01")
    number = {k: [(pd.Timestamp(d) - epoch).days for d in sorted(v)] for k, v in as_ofs.items()}
    kind = history.schema[key].dataType.simpleString()
    dates = spark.createDataFrame([(k, d, at // BLOCK, (len(v) - 1) // BLOCK) for k, v in number.items() for at, d in enumerate(v)], f"`{key}` {kind}, _since int, _block int, _last int")
    aged = history.withColumn("_day", F.datediff("date", F.lit("1970-01-01").cast("date")))
    days = aged.select(key, "_day").distinct().join(F.broadcast(dates), key).where("_since > _day")  # a key by days
    first = days.groupBy(key, "_day").agg(F.min(F.struct("_since", "_block", "_last")).alias("_f")).select(key, "_day", "_f.*")
    cells = aged.join(F.broadcast(first), [key, "_day"]).groupBy(key, "_since", "_block", "_last", *columns).agg(F.sum(F.pow(F.lit(0.5), (F.col("_since") - F.col("_day")) / half_life)).alias("weight"), F.count("*").alias("alike"))
    blocks = cells.select(key, "_since", *columns, "weight", "alike", F.explode(F.sequence("_block", "_last")).alias("_block"))

    def run(group, rows):
        mine = number[group[0]][group[1] * BLOCK : (group[1] + 1) * BLOCK]
        rows = rows.sort_values(["_since", *columns], ignore_index=True)
        code = rows.groupby(columns, dropna=False, sort=True).ngroup().to_numpy()
        _, at = np.unique(code, return_index=True)
        base, since = rows[columns].iloc[at].reset_index(drop=True), rows["_since"].to_numpy()
        when = np.maximum(since, mine[0])
        part, count = rows["weight"].to_numpy() * 0.5 ** ((when - since) / half_life), rows["alike"].to_numpy()
        weight, alike, last, out = np.zeros(len(base)), np.zeros(len(base)), mine[0], []
        for day in mine:
            new = when == day
            weight = weight * 0.5 ** ((day - last) / half_life) + np.bincount(code[new], part[new], len(base))
            alike, last = alike + np.bincount(code[new], count[new], len(base)), day
            if (some := alike > 0).any():
                out.append({key: group[0], "as_of": (epoch + pd.Timedelta(days=day)).date()} | fit(base[some].assign(weight=weight[some], alike=alike[some])))
        return pd.DataFrame(out, columns=[key, "as_of", *_empty(schema)])

    return blocks.groupBy(key, "_block").applyInPandas(run, f"`{key}` {kind}, as_of date, {schema}")


SHRINKAGE_SCHEMA = "matches bigint, effective_n double, teams bigint, dispersion double, tau_attack double, tau_defence double, split_attack double, split_defence double, em_attack double, em_defence double, em_rounds bigint, em_settled boolean"


def shrinkage(training: DataFrame, keys: list[str], **options) -> DataFrame:
    """(keys, matches, …): what the data say of each group's penalties, with the level held and without. A group that
    can't be fitted has no row."""
    kinds = ", ".join(f"`{k}` {training.schema[k].dataType.simpleString()}" for k in keys)

    def run(key, rows):
        try:
            held, free = (goals(rows, ridge=mode, **options) for mode in ("auto-split", "auto"))
        except (TooFewMatches, NoChances):
            return pd.DataFrame(columns=[*keys, *_empty(SHRINKAGE_SCHEMA)])
        s, e = held.estimate, free.estimate
        row = dict(zip(keys, key)) | {"matches": held.n_matches, "effective_n": held.effective_n, "teams": len(held.teams), "dispersion": s.dispersion, "tau_attack": s.tau_attack, "tau_defence": s.tau_defence, "split_attack": s.attack, "split_defence": s.defence}
        return pd.DataFrame([row | {"em_attack": e.attack, "em_defence": e.defence, "em_rounds": e.rounds, "em_settled": e.converged}])

    return training.groupBy(*keys).applyInPandas(run, f"{kinds}, {SHRINKAGE_SCHEMA}")


def fit_goals_pooled(training: DataFrame, key: str = "league", share: float = 0.5, target: str | None = None, **options) -> DataFrame:
    """fit_goals by key with each key's split of the penalty taken from its variances, drawn to those of all keys.

    The driver holds two numbers a key. A key without an estimate is fitted with the level alone.
    """
    found = {r[key]: r for r in shrinkage(training, [key], target=target).select(key, "tau_attack", "tau_defence", "split_attack", "split_defence").collect()}  # leagues
    of = lambda c: pooled_variances({k: r[c] ** 2 for k, r in found.items()}, share)
    attack, defence = of("tau_attack"), of("tau_defence")
    level = lambda r: float(np.sqrt(r["split_attack"] * r["split_defence"]))  # noqa: E731  what split_ridge kept
    pairs = {k: {"ridge": split_ridge(attack[k], defence[k], level(r))} for k, r in found.items()}
    return fit_goals(training, [key], by={key: pairs}, target=target, **options)


def referee_table(fits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, referee, effect, multiplier), the strictest first."""
    one = fits.select(*keys, F.explode("referees").alias("referee", "effect"))
    return one.withColumn("multiplier", F.exp("effect")).orderBy(*keys, F.desc("multiplier"), "referee")


def ratings(fits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, team, attack, defence, overall, matches) of fitted models."""
    one = fits.select(*keys, F.inline("ratings"))
    return one.withColumn("overall", F.col("attack") + F.col("defence"))


def rates(fixtures: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """fixtures (keys, home_team, away_team) with lam, mu, rho and whether both clubs are known.

    A club the model doesn't know has the promoted clubs' strengths. Missing shares, where the fixtures have
    them, shift both rates; an unknown share shifts none.
    """
    r = ratings(fits, keys)
    out = fixtures.join(fits.select(*keys, "intercept", "home_advantage", "rho", "own_share", "other_share"), keys)
    for side in ("home", "away"):
        own = r.select(*keys, F.col("team").alias(f"{side}_team"), F.col("attack").alias(f"_{side}_a"), F.col("defence").alias(f"_{side}_d"), F.col("matches").alias(f"{side}_matches"))
        out = out.join(own, [*keys, f"{side}_team"], "left")
    c = lambda s, k: F.coalesce(F.col(f"_{s}_{k}"), F.lit(config.PROMOTED_ATTACK if k == "a" else config.PROMOTED_DEFENCE))
    share = lambda s: F.coalesce(F.col(f"missing_{s}"), F.lit(0.0)) if f"missing_{s}" in fixtures.columns else F.lit(0.0)
    shift = lambda us, them: F.col("own_share") * share(us) + F.col("other_share") * share(them)
    lam = F.col("intercept") + F.col("home_advantage") + c("home", "a") - c("away", "d") + shift("home", "away")
    mu = F.col("intercept") + c("away", "a") - c("home", "d") + shift("away", "home")
    bound = lambda e: F.exp(F.least(F.greatest(e, F.lit(GOAL_ETA[0])), F.lit(GOAL_ETA[1])))
    out = out.withColumns({"lam": bound(lam), "mu": bound(mu), "known": F.col("home_matches").isNotNull() & F.col("away_matches").isNotNull()})
    return out.select(*fixtures.columns, "lam", "mu", "rho", "known", F.coalesce("home_matches", F.lit(0)).alias("home_matches"), F.coalesce("away_matches", F.lit(0)).alias("away_matches"))


def count_rates(fixtures: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """fixtures with home_mean, away_mean, dispersion and total_dispersion; an unknown club or referee shifts nothing."""
    r = fits.select(*keys, F.inline("ratings"))
    out = fixtures.join(fits.select(*keys, "intercept", "home_advantage", "dispersion", "total_dispersion", "referees"), keys)
    for side in ("home", "away"):
        out = out.join(r.select(*keys, F.col("team").alias(f"{side}_team"), F.col("attack").alias(f"_{side}_a"), F.col("defence").alias(f"_{side}_d")), [*keys, f"{side}_team"], "left")
    c = lambda s, k: F.coalesce(F.col(f"_{s}_{k}"), F.lit(0.0))
    whistle = F.coalesce(F.col("referees")[F.col("referee")], F.lit(0.0)) if "referee" in fixtures.columns else F.lit(0.0)
    bound = lambda e: F.exp(F.least(F.greatest(e + whistle, F.lit(COUNT_ETA[0])), F.lit(COUNT_ETA[1])))
    out = out.withColumns({"home_mean": bound(F.col("intercept") + F.col("home_advantage") + c("home", "a") - c("away", "d")), "away_mean": bound(F.col("intercept") + c("away", "a") - c("home", "d"))})
    return out.select(*fixtures.columns, "home_mean", "away_mean", "dispersion", "total_dispersion")
