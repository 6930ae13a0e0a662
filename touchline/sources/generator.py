"""Seeded seasons with planted strengths, as wide files have them, dirt included."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd

HOME, LEVEL = 0.22, math.log(1.35)


def strengths(teams: int, seed: int, spread: float = 0.25) -> pd.DataFrame:
    r = np.random.default_rng(seed)
    a, d = r.normal(0, spread, teams), r.normal(0, spread, teams)
    return pd.DataFrame({"team": [f"Club {k:02d}" for k in range(teams)], "attack": a - a.mean(), "defence": d - d.mean()})


def season(teams: int = 12, start: dt.date = dt.date(2023, 8, 5), rounds: int | None = None, seed: int = 1) -> pd.DataFrame:
    """Canonical matches of a round-robin, home and away, with goals, chances, corners and cards."""
    r = np.random.default_rng(seed)
    power = strengths(teams, 1000 + seed % 7)
    order, out = list(range(teams)), []
    rounds = rounds or 2 * (teams - 1)
    for k in range(rounds):
        for i in range(teams // 2):
            h, a = order[i], order[-1 - i]
            if (k + i) % 2:
                h, a = a, h
            lam = math.exp(LEVEL + HOME + power.attack[h] + power.defence[a])
            mu = math.exp(LEVEL + power.attack[a] + power.defence[h])
            out.append({"match_id": f"g{seed}-{k:03d}-{i:02d}", "league": "E0", "date": start + dt.timedelta(days=7 * k + i % 2), "home_team": power.team[h], "away_team": power.team[a], "home_goals": int(r.poisson(lam)), "away_goals": int(r.poisson(mu)), "home_xg": lam * r.lognormal(0, 0.15), "away_xg": mu * r.lognormal(0, 0.15), "home_corners": int(r.negative_binomial(8, 8 / (8 + 5.5))), "away_corners": int(r.negative_binomial(8, 8 / (8 + 4.5))), "referee": f"R{int(r.integers(0, 6))}"})
        order = [order[0], order[-1], *order[1:-1]]
    return pd.DataFrame(out)


def season_csv(matches: pd.DataFrame, old_names: bool = False, seed: int = 1) -> str:
    """A season file of the matches: prices with margins, a nameless column and two blank rows."""
    r = np.random.default_rng(seed)
    pinnacle = "P" if old_names else "PS"
    rows = []
    for m in matches.itertuples():
        p = r.dirichlet((9, 6, 7))
        row = {"Div": m.league, "Date": m.date.strftime("%d/%m/%y" if old_names else "%d/%m/%Y"), "Time": "15:00", "HomeTeam": m.home_team, "AwayTeam": m.away_team, "FTHG": m.home_goals, "FTAG": m.away_goals, "FTR": "H" if m.home_goals > m.away_goals else "A" if m.home_goals < m.away_goals else "D", "HC": m.home_corners, "AC": m.away_corners, "Referee": m.referee}
        for prefix, margin in (("B365", 1.06), (pinnacle, 1.025)):
            row |= {f"{prefix}{c}": round(1 / (x * margin), 2) for c, x in zip("HDA", p)}
            row |= {f"{prefix}C{c}": round(1 / (x * margin) + 0.01, 2) for c, x in zip("HDA", p)}
        row |= {"B365>2.5": 1.9, "B365<2.5": 1.95, "AHh": float(r.choice([-0.75, -0.5, 0.0, 0.25])), "B365AHH": 1.92, "B365AHA": 1.98}
        rows.append(row)
    frame = pd.DataFrame(rows)
    frame["Unnamed: 99"] = ""
    return frame.to_csv(index=False) + "," * (len(frame.columns) - 1) + "\n" + "," * (len(frame.columns) - 1) + "\n"
