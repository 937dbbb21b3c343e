"""The public questions: one function per question of the
reference's service, each returning lazy DataFrames.

A context without season or competition is resolved *inside* the plan
(``resolve_context`` is a one-row DataFrame joined to the data), so no
value goes through the driver. An empty context gives empty answers; the
caller turns that into "no data" (``has_data``).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import LIMITS, Context
from . import compare as C
from . import context as CX
from . import explore as E
from . import league as L
from . import nested as N
from . import playbyplay as P
from . import sheets as S


def _scoped(df: DataFrame, games: DataFrame, ctx: Context | None) -> DataFrame:
    """Rows of the resolved context (group filter applied when given)."""
    ctx = ctx or Context()
    key = CX.resolve_context(games, ctx)
    d = df.join(key, CX.CTX, "left_semi")
    if ctx.group is not None and "grp" in d.columns:
        d = d.filter(F.col("grp") == ctx.group)
    return d


def _games(t, ctx):
    return _scoped(t.games, t.games, ctx)


def _players(t, ctx):
    return _scoped(t.players, t.games, ctx)


class NotFound(LookupError):
    """The context holds no such player or team."""


def _named(lookup: DataFrame, slug: str | None, anywhere: DataFrame | None = None) -> None:
    """A slug, or the name it is made of, must name somebody of the context (driver-side check).
    With ``anywhere``, where the caller chose no context, a name of another context is known too: it
    has no rows in the default one."""
    if slug is None:
        return
    for names in (lookup, anywhere):
        if names is not None and names.where(F.col("slug") == T.slug(F.lit(slug))).limit(1).count():
            return
    raise NotFound(slug)


def has_data(t, ctx: Context | None = None) -> bool:
    """The one driver-side check: does the context hold any game?"""
    return _games(t, ctx).limit(1).count() > 0


def catalogue(t) -> DataFrame:
    return CX.catalogue(t.games)


def dashboard(t, ctx: Context | None = None, limit: int = LIMITS.page_default, offset: int = 0) -> dict:
    g, p = _games(t, ctx), _players(t, ctx)
    return {"meta": CX.describe_context(g), "summary": L.summary(g, p, t.shots),
            "leaders": L.leaders(p, limit=limit, offset=offset), "leaders_total": L.leaders_total(p),
            "recent": L.recent_games(g)}


def games(t, ctx: Context | None = None) -> DataFrame:
    return L.game_list(_games(t, ctx))


def standings(t, ctx: Context | None = None) -> DataFrame:
    return L.standings(_games(t, ctx))


def player_sheet(t, ctx: Context | None = None, slug: str | None = None) -> dict:
    p = _players(t, ctx)
    _named(S.player_lookup(p), slug, S.player_lookup(t.players) if ctx is None else None)
    if slug is not None:
        p = p.filter(T.slug(F.col("player_name")) == T.slug(F.lit(slug)))
    return {"sheet": S.player_sheet(p), "game_log": S.game_log(p, t.games),
            "zones": S.zone_map(p, t.shots), "shots": S.player_shots(p, t.shots)}


def player_answer(t, ctx: Context | None = None, slug: str | None = None) -> DataFrame:
    """One nested row (or part) per player of the context, or of the player ``slug`` names."""
    from dataclasses import replace
    p = _players(t, ctx)
    _named(S.player_lookup(p), slug, S.player_lookup(t.players) if ctx is None else None)
    if slug is not None:
        p = p.filter(T.slug(F.col("player_name")) == T.slug(F.lit(slug)))
    return N.player_answers(replace(t, players=p))


def team_answer(t, ctx: Context | None = None, slug: str | None = None) -> DataFrame:
    """One nested row (or part) per team of the context, or of the team ``slug`` names."""
    from dataclasses import replace
    scoped = replace(t, games=_games(t, ctx), players=_players(t, ctx))
    _named(S.team_lookup(scoped.players), slug)
    d = N.team_answers(scoped)
    return d if slug is None else d.filter(F.col("team_key") == slug)


def team_sheet(t, ctx: Context | None = None, slug: str | None = None) -> dict:
    from .tables import Tables
    scoped = Tables(games=_games(t, ctx), players=_players(t, ctx), plays=t.plays, shots=t.shots,
                    teams=t.teams)
    _named(S.team_lookup(scoped.players), slug)
    return S.team_sheet(scoped, None, slug)


def clutch(t, ctx: Context | None = None, limit: int = LIMITS.page_default, offset: int = 0) -> dict:
    table = P.clutch(t.plays, _games(t, ctx))
    return {"players": CX.page(table, ["position"], limit, offset, partition=CX.CTX),
            "total": table.groupBy(*CX.CTX).agg(F.count(F.lit(1)).alias("players_total"))}


def assist_network(t, ctx: Context | None = None, team: str | None = None) -> dict:
    """Edges (top 300) and nodes; ``team`` is a team slug."""
    g = _games(t, ctx)
    edges = P.assist_edges(t.plays, g, team_slug=team)
    return {"edges": edges, "nodes": P.assist_nodes(edges)}


def fouls(t, ctx: Context | None = None, limit: int = LIMITS.page_default, offset: int = 0) -> dict:
    g, p = _games(t, ctx), _players(t, ctx)
    pf = P.player_fouls(t.plays, g, p)
    return {"players": CX.page(pf, ["position"], limit, offset, partition=CX.CTX),
            "players_total": pf.groupBy(*CX.CTX).agg(F.count(F.lit(1)).alias("players_total")),
            "teams": P.team_fouls(t.plays, g, p)}


def compare(t, ctx: Context | None = None, slugs: list[str] = ()) -> dict:
    """Up to 4 players; percentiles against the eligible pool for the
    first 3 (radar); best value per metric when more than one."""
    p = _players(t, ctx)
    pool = C.leader_pool(p)
    chosen = L.player_lines(p).filter(F.col("slug").isin(list(slugs)[:4]))
    radar = chosen.filter(F.col("slug").isin(list(slugs)[:3]))
    return {"players": chosen, "percentiles": C.percentiles(pool, radar), "best": C.best_of(chosen)}


def search(t, ctx: Context | None = None, text: str = "", exclude: list[str] | None = None) -> DataFrame:
    return C.search(C.leader_pool(_players(t, ctx)), text, exclude)


def team_day(t) -> DataFrame:
    return E.team_day(t.players)


def career(t) -> DataFrame:
    return E.career(t.players)


def top_scorers(t, n: int = 10) -> DataFrame:
    return E.top_scorers(t.players, n)
