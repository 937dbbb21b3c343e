"""Column -> Column expressions (F01-F32). All built-in, all JVM side.

Spark 4 runs with ANSI on, so every text -> number step is a ``try_``
form and every division is guarded.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import COURT, LIMITS, RULES, Court, TextRules


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- F13-F20: rates -------------------------------------------------------

def ratio(num, den) -> Column:
    """num/den, NULL when there were no attempts (0/0 is not 0 %)."""
    num, den = _c(num), _c(den)
    return F.when(den > 0, num / den)


def field_goals(two, three) -> Column:
    """F16: field goals = twos + threes (made or attempted)."""
    return _c(two) + _c(three)


def efg(fgm, t3m, fga) -> Column:
    """effective field-goal percentage."""
    fga = _c(fga)
    return F.when(fga > 0, (_c(fgm) + F.lit(0.5) * _c(t3m)) / fga)


def ts(points, fga, fta) -> Column:
    """true shooting percentage."""
    fga, fta = _c(fga), _c(fta)
    return F.when((fga + fta) > 0, _c(points) / (F.lit(2) * (fga + F.lit(0.44) * fta)))


def per_minutes(x, minutes, per: int = LIMITS.per_minutes) -> Column:
    """rate per ``per`` minutes, NULL if the player did not play."""
    minutes = _c(minutes)
    return F.when(minutes > 0, _c(x) / minutes * F.lit(per)).cast("double")


def double_digits(*cols) -> Column:
    """number of categories with 10 or more."""
    out = None
    for c in cols:
        term = (_c(c) >= 10).cast("int")
        out = term if out is None else out + term
    return out


def possessions(fga, orb, tov, fta, strict: bool = True) -> Column:
    """FGA - ORB + TO + 0.44 FTA.

    ``strict`` follows the gold table (any NULL gives NULL); otherwise a
    NULL FGA gives NULL and other NULLs count as 0, as in the answers.
    """
    fga = _c(fga)
    if strict:
        return fga - _c(orb) + _c(tov) + F.lit(0.44) * _c(fta)
    z = F.lit(0)
    return F.when(fga.isNotNull(),
                  fga - F.coalesce(_c(orb), z) + F.coalesce(_c(tov), z)
                  + F.lit(0.44) * F.coalesce(_c(fta), z))


def rating(points, poss) -> Column:
    """points per 100 possessions; zero possessions count as missing."""
    poss = _c(poss)
    return F.when(poss > 0, _c(points) / poss * F.lit(100))


# --- F21, F31, F32: sides and results ------------------------------------

def winner(home, away) -> Column:
    """home / away / draw."""
    home, away = _c(home), _c(away)
    return (F.when(home > away, F.lit("home"))
            .when(home < away, F.lit("away"))
            .otherwise(F.lit("draw")))


def margin(home, away) -> Column:
    return F.abs(_c(home) - _c(away))


def play_team(side, home_team, away_team) -> Column:
    """F32: team of a play: side 1 is home, anything else away."""
    return F.when(_c(side) == 1, _c(home_team)).otherwise(_c(away_team))


def shot_side(is_home) -> Column:
    """In the shot table 0 is home and 1 away."""
    return F.when(_c(is_home), F.lit(0)).otherwise(F.lit(1))


# --- F08-F12: dates, seasons, clocks -------------------------------------

def parse_date(text) -> Column:
    """dd/MM/yyyy -> date, NULL when it does not parse."""
    return F.try_to_date(_c(text), "dd/MM/yyyy")


def format_date(d) -> Column:
    return F.date_format(_c(d), "dd/MM/yyyy")


def calendar_year(text) -> Column:
    """characters 7-10 of dd/MM/yyyy."""
    return F.substring(_c(text), 7, 4)


def season_of(d) -> Column:
    """a season starts in September: month >= 9 -> same year."""
    d = _c(d)
    return (F.year(d) - F.when(F.month(d) < 9, 1).otherwise(0)).cast("int")


def season_label(season) -> Column:
    """2025 -> '2025/2026'."""
    s = _c(season).cast("int")
    return F.concat_ws("/", s.cast("string"), (s + 1).cast("string"))


def clock_seconds(text) -> Column:
    """'mm:ss' -> seconds left; text that does not parse counts 0."""
    parts = F.split(F.coalesce(_c(text), F.lit("")), ":")
    mm = F.coalesce(F.get(parts, 0).try_cast("int"), F.lit(0))
    ss = F.coalesce(F.get(parts, 1).try_cast("int"), F.lit(0))
    return mm * 60 + ss


def elapsed_seconds(text, period: int = COURT.period_s) -> Column:
    return F.lit(period) - clock_seconds(text)


def clock_text(seconds_left) -> Column:
    s = _c(seconds_left)
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("int"), (s % 60).cast("int"))


# --- F22-F24: court geometry ---------------------------------------------

def shot_distance(x, y, court: Court = COURT) -> Column:
    """metres to the hoop of the shot's half (x < 50 is the left half)."""
    x, y = _c(x), _c(y)
    hoop = F.when(x < 50, F.lit(court.hoop_pct)).otherwise(F.lit(100 - court.hoop_pct))
    dx = (x - hoop) * F.lit(court.length_m / 100)
    dy = (y - F.lit(50)) * F.lit(court.width_m / 100)
    return F.sqrt(dx * dx + dy * dy)


def shot_zone(distance, court: Court = COURT) -> Column:
    """rim (<= 1.25 m), mid (<= 6.6 m), three."""
    d = _c(distance)
    return (F.when(d <= court.rim_m, F.lit("rim"))
            .when(d <= court.three_m, F.lit("mid"))
            .otherwise(F.lit("three")))


def shot_points(made, distance, court: Court = COURT) -> Column:
    return F.when(_c(made) == 1, F.when(_c(distance) > court.three_m, 3).otherwise(2)).otherwise(0)


def half_court(x, y, court: Court = COURT) -> Column:
    """fold both halves onto one, canvas in centimetres (cx, cy)."""
    x, y = _c(x), _c(y)
    length_pct = F.when(x < 50, x).otherwise(F.lit(100) - x)
    view_h = court.length_m / 2 * 100
    return F.struct(
        (y * F.lit(court.width_m / 100) * F.lit(100)).alias("cx"),
        (F.lit(view_h) - length_pct * F.lit(court.length_m / 100) * F.lit(100)).alias("cy"),
    )


# --- F25-F28: play text ----------------------------------------------------

def made_from_text(action, text, rules: TextRules = RULES) -> Column:
    """1 made / 0 missed for shots and free throws, else NULL."""
    a, t = _c(action), _c(text)
    return (F.when(~a.isin("shoot", "fthrow"), F.lit(None))
            .when(t.contains(rules.made), F.lit(1))
            .when(t.contains(rules.missed), F.lit(0))
            .cast("int"))


def shot_value_from_text(action, text, rules: TextRules = RULES) -> Column:
    """n of 'TIRO DE n'; NULL when the pattern is missing."""
    a, t = _c(action), _c(text)
    raw = F.regexp_extract(t, rules.shot_value, 1)
    return F.when(a.isin("shoot", "fthrow"), F.nullif(raw, F.lit("")).try_cast("int")).cast("int")


def foul_type(action, text, rules: TextRules = RULES) -> Column:
    """disqualifying / technical / personal; NULL when not a foul.

    A NULL action gives NULL (the source would fall through to personal).
    """
    a, t = _c(action), _c(text)
    return (F.when(a.isNull() | (a != "foul"), F.lit(None))
            .when(t.contains(rules.disqualifying), F.lit("disqualifying"))
            .when(t.contains(rules.technical), F.lit("technical"))
            .otherwise(F.lit("personal")))


def sub_direction(action, text, rules: TextRules = RULES) -> Column:
    """in / out for substitutions."""
    a, t = _c(action), _c(text)
    return (F.when(a.isNull() | (a != "subst"), F.lit(None))
            .when(t.contains(rules.sub_in), F.lit("in"))
            .otherwise(F.lit("out")))


def play_label(text, rules: TextRules = RULES) -> Column:
    """'D. NAME SURNAME' between ')' and ':'; '' when absent."""
    return F.regexp_extract(_c(text), rules.label, 1)


def label_initial(label) -> Column:
    return F.upper(F.substring(_c(label), 1, 1))


def label_surnames(label) -> Column:
    return F.upper(F.trim(F.regexp_replace(_c(label), r"^\S+\.\s*", "")))


def name_surnames(player_name) -> Column:
    """Part before the first comma of 'SURNAMES, GIVEN'."""
    return F.upper(F.trim(F.get(F.split(_c(player_name), ","), 0)))


def name_initial(player_name) -> Column:
    """First letter of the part after the first comma (NULL if no comma)."""
    given = F.get(F.split(_c(player_name), ","), 1)
    return F.upper(F.substring(F.trim(given), 1, 1))


# --- F29: rounding ---------------------------------------------------------

def rounded(x, digits: int) -> Column:
    return F.round(_c(x), digits)


def to_number(text, kind: str = "double") -> Column:
    return _c(text).try_cast(kind)
