"""Fixed values that must equal the source data's conventions.

FIXED VALUES (they describe the data, not our logic; change only if the
source changes its templates):

* play text, made shot:            "ANOTADO"
* play text, missed shot:          "FALLADO"
* play text, shot value pattern:   "TIRO DE (\\d)"
* play text, disqualifying foul:   "Descalificante"
* play text, technical foul:       "cnica"   (matches with or without accent)
* play text, substitution in:      "Entra"
* play text, player label:         between ")" and ":", e.g. "D. NAME SURNAME"
* actions: shoot, fthrow, assist, foul, subst, lose, recovery, blockshot
* play side:  team = 1 is home, anything else away
* shot side:  team = 0 is home, 1 away
* court: 28 x 15 m, hoop at 5 % of the length from each end,
  three-point line 6.6 m, restricted area 1.25 m, period 600 s
* clutch: last 300 s of the 4th period or any overtime, margin <= 5
* thresholds: leaders >= 6 games and >= 15 min average; clutch >= 2
  games; fouls >= 3 games; fouled out at 5 personal fouls
* team-name link words kept lower case: de, del, y, i, da, do
* vowels for the acronym test: a e i o u y and their accented forms
* group label: quoted part of the name, else the name without
  "Liga Regular"; empty -> "ungrouped"
"""
from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TextRules:
    made: str = "ANOTADO"
    missed: str = "FALLADO"
    shot_value: str = r"TIRO DE (\d)"
    disqualifying: str = "Descalificante"
    technical: str = "cnica"
    sub_in: str = "Entra"
    label: str = r"\)\s*([^:]+):"


@dataclass(frozen=True)
class Court:
    length_m: float = 28.0
    width_m: float = 15.0
    hoop_pct: float = 5.0
    three_m: float = 6.6
    rim_m: float = 1.25
    period_s: int = 600


@dataclass(frozen=True)
class Thresholds:
    leader_games: int = 6
    leader_minutes: int = 15
    clutch_seconds: int = 300
    clutch_margin: int = 5
    clutch_games: int = 2
    foul_games: int = 3
    foul_out: int = 5
    per_minutes: int = 36
    page_default: int = 50
    page_max: int = 500


LINK_WORDS = ("de", "del", "y", "i", "da", "do")
VOWELS = "aeiouyáéíóúàèìòùäëïöü"
REGULAR_SEASON = "Liga Regular"
UNGROUPED = "ungrouped"

RULES = TextRules()
COURT = Court()
LIMITS = Thresholds()

# Zone and winner labels (ours, English).
ZONES = ("rim", "mid", "three")
FOUL_TYPES = ("personal", "technical", "disqualifying")


@dataclass(frozen=True)
class Context:
    """Optional scope of a question: competition, season, group."""
    competition: str | None = None
    season: int | None = None
    group: str | None = None


@dataclass(frozen=True)
class Scope:
    """Part of the lake a run works on: lists of competitions and seasons,
    empty for all of them; ``partitions`` names exact (competition, season)
    pairs, None for all and empty for none."""
    competitions: tuple[str, ...] = ()
    seasons: tuple[int, ...] = ()
    partitions: tuple[tuple[str, int], ...] | None = None
