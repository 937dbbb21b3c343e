"""One table of box-score measures.

A *line* is a set of counters: one player's game, one team's game, or sums of
many. :class:`Line` reads counters through a naming rule and derives every
rate from them, so per-game rows, season profiles, sheets and exploration
tables share one definition. Aggregates are stated per table as
``{output: (aggregate, counter)}`` built by rules from ``COUNTERS``.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import expr as X

# FIXED VALUES: column names the answers must carry.
# counter -> name in totals
COUNTERS = {
    "ast": "assists", "blk": "blocks", "fga": "fga", "fgm": "fgm", "fta": "fta", "ftm": "ftm",
    "minutes": "minutes", "pf": "fouls", "points": "points", "reb": "rebounds", "stl": "steals",
    "t2a": "2pa", "t2m": "2pm", "t3a": "3pa", "t3m": "3pm", "tov": "turnovers", "val": "val",
}
# rate -> column name, per naming style
STYLES = {
    "game": {"efg": "effective_fg_pct", "field": "field_goal_pct", "free": "free_throw_pct",
             "three": "three_point_pct", "ts": "true_shooting_pct", "two": "two_point_pct"},
    "team": {"efg": "effective_fg_pct", "field": "fg_pct", "free": "ft_pct", "three": "t3_pct", "two": "t2_pct"},
    "sheet": {"efg": "efg_pct", "field": "fg_pct", "free": "ft_pct", "three": "t3_pct", "ts": "ts_pct", "two": "t2_pct"},
}
DOUBLES = ("points", "reb", "ast", "stl", "blk")

# kind of shot -> (made, attempted)
SHOTS = {"field": ("fgm", "fga"), "free": ("ftm", "fta"), "three": ("t3m", "t3a"), "two": ("t2m", "t2a")}
AGGREGATES = {"sum": F.sum, "mean": F.avg, "best": F.max, "true": lambda c: F.sum(F.col(c).cast("int")),
              "different": F.count_distinct}


class Line:
    """Counters by name; ``read`` turns a counter into its column."""

    def __init__(self, read: Callable[[str], str] = str, made_of: bool = False):
        """``made_of``: field goals are the sum of twos and threes, not columns of their own."""
        self._read, self._made_of = read, made_of

    def __getitem__(self, counter: str) -> Column:
        if self._made_of and counter in ("fgm", "fga"):
            return X.field_goals(self["t2" + counter[-1]], self["t3" + counter[-1]])
        return F.col(self._read(counter))

    def rate(self, key: str) -> Column:
        if key == "efg":
            return X.efg(self["fgm"], self["t3m"], self["fga"])
        if key == "ts":
            return X.ts(self["points"], self["fga"], self["fta"])
        made, attempted = SHOTS[key]
        return X.ratio(self[made], self[attempted])

    def rates(self, style: str) -> dict[str, Column]:
        return {name: self.rate(key) for key, name in STYLES[style].items()}

    def per(self, counter: str, minutes: int) -> Column:
        return X.per_minutes(self[counter], self["minutes"], minutes)

    def possessions(self, rebounds: str) -> Column:
        return X.possessions(self["fga"], self[rebounds], self["tov"], self["fta"])


Measures = dict[str, tuple[str, str]]


def measures(how: str, counters: Iterable[str], name: Callable[[str], str]) -> Measures:
    """One measure per counter, named by a rule."""
    return {name(c): (how, c) for c in counters}


def aggregates(spec: Measures) -> list[Column]:
    return [AGGREGATES[how](c).alias(out) for out, (how, c) in spec.items()]
