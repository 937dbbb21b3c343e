"""Raw documents and layer tables on any Hadoop path.

Raw layout: ``<root>/competition=<key>/year=<season>/group=<slug>/game_id=<id>.json``,
one JSON document per game or line, plain or gzipped, read with the declared schema.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X
from ..functions.rules import Context, Scope
from ..session import checkpoint_dir
from . import staged
from .schema import GAME, GAME_WITH_PATH, SERVING

FILE_GLOB = "*.{json,json.gz}"
RAW_GLOB = f"competition=*/year=*/group=*/{FILE_GLOB}"


# --- S01/S02/S14: scans ----------------------------------------------------

def narrow(df: DataFrame, scope: Scope | Context | None, season: str = "season", group: str = "grp") -> DataFrame:
    """The scope's rows; lists or single values, each only when given."""
    if scope is None:
        return df
    if isinstance(scope, Context):
        one = {"competition": scope.competition, season: scope.season, group: scope.group}
        wanted = {c: [v] for c, v in one.items() if v is not None and c in df.columns}
    else:
        wanted = {c: list(v) for c, v in (("competition", scope.competitions), (season, scope.seasons)) if v}
        if scope.partitions is not None:
            # One value per partition, computed from partition columns only: folders are pruned by it.
            pair = F.concat_ws("/", "competition", F.col(season).cast("string"))
            df = df.filter(pair.isin([f"{c}/{y}" for c, y in scope.partitions]))
    for c, values in wanted.items():
        df = df.filter(F.col(c).isin([int(v) for v in values] if c == season else values))
    return df


def read_games(spark: SparkSession, root: str, scope: Scope | Context | None = None) -> DataFrame:
    """Partitioned JSON scan with a declared schema; stray files
    outside the pattern are ignored by the glob; scope filters sit on the
    partition columns, so unscoped folders are never read; a store without
    documents has no rows."""
    if not staged.Files(spark, root).matches(f"{root}/{RAW_GLOB}"):
        df = spark.createDataFrame([], GAME_WITH_PATH)
    else:
        df = (spark.read.schema(GAME).option("basePath", root).option("mode", "PERMISSIVE")
              .json(f"{root}/{RAW_GLOB}"))
    return narrow(df.withColumn("year", F.col("year").cast("int")), scope, "year", "group")


class SchemaChanged(TypeError):
    """A write whose columns have other types than the stored table's."""


def table_path(root: str, layer: str, name: str) -> str:
    return "/".join(filter(None, (root, layer, name)))


def read_table(spark: SparkSession, root: str, layer: str, name: str, scope: Scope | Context | None = None,
               fmt: str = "parquet", merge_schema: bool = False, declared: T.StructType | None = None) -> DataFrame:
    """A layer table in a configurable file format, read with its
    declared schema or the one stored with it, so an empty table has its columns
    too; ``merge_schema`` reads files written before an additive column change.
    A write that died while its partitions were moved in is carried on first."""
    path = table_path(root, layer, name)
    staged.recover(spark, path)
    schema = declared or staged.stored_schema(spark, path)
    reader = spark.read.format(fmt)
    if schema is None:  # not written here
        return narrow((reader.option("mergeSchema", "true") if merge_schema else reader).load(path), scope)
    return narrow(reader.schema(schema).load(path).select(*schema.names), scope)


# --- S04/S05/S08: writes ------------------------------------------------------

def contract(df: DataFrame, partition_by, before: T.StructType | None) -> T.StructType:
    """Schema of the table after the write: nullable, partition columns last, columns that
    only earlier files have kept; a column of another type is refused."""
    now = {f.name: f.dataType for f in df.schema.fields}
    old = {f.name: f.dataType for f in before.fields} if before else {}
    changed = [f"{c}: {old[c].simpleString()} -> {t.simpleString()}" for c, t in now.items() if c in old and _nullable(old[c]) != _nullable(t)]
    if changed:
        raise SchemaChanged(", ".join(changed))
    columns = old | now
    names = [c for c in columns if c not in partition_by] + [c for c in partition_by]
    return T.StructType([T.StructField(c, _nullable(columns[c])) for c in names])


def _nullable(kind: T.DataType) -> T.DataType:
    """The type as a file gives it back: everything may be NULL."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_nullable(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(_nullable(kind.keyType), _nullable(kind.valueType), True)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in kind.fields])
    return kind


def write_table(df: DataFrame, root: str, layer: str, name: str, partition_by=("competition", "season"),
                rebuild: bool = False, fmt: str = "parquet", sort_by: tuple[str, ...] = (),
                replaced: Iterable[tuple] = (), counters: dict[str, Column] | None = None,
                options: dict[str, str] | None = None,
                made: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, int]:
    """Partition overwrite (the partitions present in ``df`` are replaced, and
    those ``replaced`` lists, which go if ``df`` has no row of them); S05:
    ``rebuild`` replaces the whole table; S08: rows sorted inside each file by
    ``sort_by`` for min/max skipping. Staged, so a failed run leaves the old table
    (see ``staged``); an empty table keeps its schema.

    With ``sort_by`` rows are first dealt by ranges of (partition, keys): a
    partition gets a few files whatever the number of tasks, and a hot
    partition is cut into several. ``made`` adds columns behind that, made of their row alone.

    Returns ``rows`` and the ``counters`` (aggregates over ``df``; helper columns that begin
    with ``_`` are not written), observed by the write itself.
    """
    spark, path = df.sparkSession, table_path(root, layer, name)
    staged.recover(spark, path)
    whole = made(df) if made else df
    kept = [c for c in whole.columns if not (counters and c.startswith("_"))]
    schema = contract(whole.select(*kept), partition_by, None if rebuild else staged.stored_schema(spark, path))
    if sort_by:
        keys = [*partition_by, *sort_by]
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        whole = made(df) if made else df
    # Observed behind the sort: the sampling of the ranges is not counted.
    seen = Observation()
    df = whole.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in (counters or {}).items()])
    w = df.select(*kept).write.format(fmt).options(**{**({"compression": "zstd"} if fmt == "parquet" else {}), **(options or {})})
    folder = staged.staging(path)
    (w.partitionBy(*partition_by) if partition_by else w).save(folder)
    staged.publish(spark, folder, path, schema, len(partition_by), rebuild,
                   [staged.partition_folder(spark, partition_by, v) for v in replaced], fmt)
    return {n: int(v or 0) for n, v in seen.get.items()}


def write_documents(docs: DataFrame, root: str, more: bool = False) -> None:
    """One folder per (competition, year, group); documents as gzipped JSON
    lines (a file holds the documents of one task and partition). ``more`` adds to a folder's documents."""
    (docs.write.mode("append" if more else "overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip")
     .partitionBy("competition", "year", "group").json(root))


def stored_documents(spark: SparkSession, root: str) -> DataFrame:
    """Every stored document with where it lies: ``path, competition, year,
    group, game_id`` and both rosters. A file may hold many documents, so the
    id comes from the document; other columns of it are not parsed unless used."""
    df = spark.read.schema(GAME).option("basePath", root).json(f"{root}/competition=*/year=*/group=*")
    # The metadata column holds the path as a URI: %20 stands for a space.
    path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    return df.select(path.alias("path"), "competition", F.col("year").cast("int").alias("year"),
                     "group", F.col("meta.game_id").alias("game_id"), "players_home", "players_away")


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """What is stored per competition, season and group: ``games``
    (different ids) and ``documents``."""
    return stored_documents(spark, root).groupBy("competition", "year", "group").agg(
        F.count_distinct("game_id").alias("games"), F.count(F.lit(1)).alias("documents"))


# --- B01-B05: bronze from documents -----------------------------------------

def bronze_games(docs: DataFrame) -> DataFrame:
    """Header columns, one row per game id."""
    m = "meta."
    d = docs.select(F.col(m + "game_id").alias("game_id"), "competition", F.col("year").alias("season"),
                    F.col("group").alias("grp"), F.col(m + "date").alias("date"), F.col(m + "time").alias("time"),
                    F.col(m + "venue").alias("venue"), F.col(m + "home_team").alias("home_team"),
                    F.col(m + "away_team").alias("away_team"), F.col(m + "home_score").alias("home_score"),
                    F.col(m + "away_score").alias("away_score"),
                    X.calendar_year(F.col(m + "date")).alias("calendar_year"))
    from ..operators.dedupe import first_by
    return first_by(d, ["game_id"], [c for c in d.columns if c != "game_id"])


def bronze_players(docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Both sides exploded from one scan (empty arrays
    vanish), side flag and side team name; ``more`` header fields repeated."""
    header = [F.col("meta.game_id").alias("game_id"), "competition", F.col("year").alias("season"),
              F.col("group").alias("grp"), F.col("meta.date").alias("date"),
              F.col("meta.home_team").alias("home_team"), F.col("meta.away_team").alias("away_team"),
              *[F.col(f"meta.{c}").alias(c) for c in more]]
    sides = F.array(
        F.struct(F.lit(True).alias("is_home"), F.col("players_home").alias("rows")),
        F.struct(F.lit(False).alias("is_home"), F.col("players_away").alias("rows")))
    d = docs.select(*header, F.explode(sides).alias("side"))
    d = d.select("*", F.col("side.is_home").alias("is_home"), F.explode("side.rows").alias("p")).drop("side")
    p = "p."
    return d.select(
        "game_id", "competition", "season", "grp", "date", "home_team", "away_team", *more, "is_home",
        F.when(F.col("is_home"), F.col("home_team")).otherwise(F.col("away_team")).alias("team"),
        F.col(p + "jersey").alias("jersey"), F.col(p + "name").alias("player_name"),
        F.col(p + "minutes").alias("minutes"), F.col(p + "points").alias("points"),
        F.col(p + "two_points_made").alias("t2m"), F.col(p + "two_points_attempted").alias("t2a"),
        F.col(p + "three_points_made").alias("t3m"), F.col(p + "three_points_attempted").alias("t3a"),
        F.col(p + "free_throws_made").alias("ftm"), F.col(p + "free_throws_attempted").alias("fta"),
        F.col(p + "offensive_rebounds").alias("orb"), F.col(p + "defensive_rebounds").alias("drb"),
        F.col(p + "total_rebounds").alias("reb"), F.col(p + "assists").alias("ast"),
        F.col(p + "steals").alias("stl"), F.col(p + "blocks").alias("blk"),
        F.col(p + "turnovers").alias("tov"), F.col(p + "fouls").alias("pf"),
        F.col(p + "plus_minus").alias("plus_minus"), F.col(p + "efficiency").alias("val"))


def bronze_plays(docs: DataFrame) -> DataFrame:
    """Play lines as text, one row per line."""
    d = docs.select(F.col("meta.game_id").alias("game_id"), "competition", F.col("year").alias("season"),
                    F.explode("play_by_play").alias("l"))
    return d.select("game_id", "competition", "season", F.col("l.num").alias("num"),
                    F.col("l.quarter").alias("quarter"), F.col("l.time").alias("time"), F.col("l.text").alias("text"),
                    F.col("l.team").alias("team"), F.col("l.action").alias("action"),
                    F.col("l.scoreA").alias("scoreA"), F.col("l.scoreB").alias("scoreB"),
                    F.col("l.idPlayer").alias("player_id"), F.col("l.idTeam").alias("team_id"))


def bronze_shots(docs: DataFrame) -> DataFrame:
    """Shot chart rows."""
    d = docs.select(F.col("meta.game_id").alias("game_id"), "competition", F.col("year").alias("season"),
                    F.explode("shots").alias("s"))
    return d.select("game_id", "competition", "season", F.col("s.quarter").alias("quarter"),
                    F.col("s.t").alias("time"), F.col("s.player").alias("player"), F.col("s.team").alias("team"),
                    F.col("s.m").alias("made"), F.col("s.x").alias("x"), F.col("s.y").alias("y"))


def bronze_teams(docs: DataFrame) -> DataFrame:
    """``team_stats.TEAM`` exploded; a document without it has no rows."""
    d = docs.select(F.col("meta.game_id").alias("game_id"), "competition", F.col("year").alias("season"),
                    F.col("meta.home_team").alias("home_team"),
                    F.explode(F.col("team_stats.TEAM")).alias("t"))
    cols = {"team_id": "id", "team_name": "name", "points": "pts", "t2m": "p2m", "t2a": "p2a", "t3m": "p3m",
            "t3a": "p3a", "ftm": "p1m", "fta": "p1a", "off_reb": "ro", "def_reb": "rd", "tot_reb": "rt",
            "ast": "assist", "stl": "st", "tov": "to", "blk": "bs", "pf": "pf"}
    return d.select("game_id", "competition", "season",
                    (F.trim(F.col("t.name")) == F.trim(F.col("home_team"))).alias("is_home"),
                    *[F.col(f"t.{src}").alias(dst) for dst, src in cols.items()])


# --- S06/S07/S10/S11: exports ---------------------------------------------------

# Helper columns of a serving row: values that did not fit their type, NULLs made 0.
SERVING_COUNTERS = {"casts_failed": F.sum, "nulls_replaced": F.sum}


def to_serving(df: DataFrame, name: str, counted: bool = False) -> DataFrame:
    """Exactly the serving table's columns and types; a value that
    does not fit its type is NULL, the contract's NULLs become 0. ``counted``
    adds how often that happened in the row (``_casts_failed``, ``_nulls_replaced``)."""
    columns, zero, _ = SERVING[name]
    cast = {c: F.col(c).try_cast(t) for c, t in columns.items()}
    out = [(F.coalesce(x, F.lit(0).cast(columns[c])) if c in zero else x).alias(c) for c, x in cast.items()]
    if counted:
        times = lambda marks: sum((m.cast("long") for m in marks), F.lit(0).cast("long"))
        out += [times(F.col(c).isNotNull() & x.isNull() for c, x in cast.items()).alias("_casts_failed"),
                times(cast[c].isNull() for c in zero).alias("_nulls_replaced")]
    return df.select(*out)


def write_serving(df: DataFrame, root: str, layer: str, name: str, **how) -> dict[str, int]:
    """A serving table with its counts: rows, failed casts, NULLs made 0."""
    return write_table(to_serving(df, name, counted=True), root, layer, name, sort_by=SERVING[name][2],
                       counters={n: agg(f"_{n}") for n, agg in SERVING_COUNTERS.items()}, **how)


def export_flat(tables, root: str) -> dict[str, dict[str, int]]:
    """The five serving tables as Parquet under ``root`` (full
    overwrite), partitioned by season and sorted by their keys; returns each table's counts."""
    counts = {}
    for name in SERVING:
        df = getattr(tables, name)
        for c in ("competition", "season"):
            if c not in df.columns:  # plays and shots of flat sources: from their game
                df = df.join(tables.games.select("game_id", c), "game_id", "left")
        counts[name] = write_serving(df, root, "", name, partition_by=("season",), rebuild=True)
    return counts


def wide_box_score(docs: DataFrame) -> DataFrame:
    """One row per player and game with the game header repeated (taken
    along in the same explode, whatever number of documents a game has);
    the text date parsed with its known format (never guessed)."""
    return bronze_players(docs, ("time", "venue", "home_score", "away_score")).withColumn(
        "game_date", X.parse_date(F.col("date")))


LINES = {"plays": "play_by_play", "shots": "shots", "teams": "team_stats.TEAM"}


def wide_lines(docs: DataFrame, kind: str) -> DataFrame:
    """Play-by-play / shots / team lines with the header repeated and
    every line key kept (a key the header has too gets the prefix ``line_``)."""
    d = docs.select("meta.*", "competition", "year", docs["group"].alias("grp"), F.explode(F.col(LINES[kind])).alias("line"))
    line = [f.name for f in d.schema["line"].dataType.fields]
    head = [c for c in d.columns if c != "line"]
    return d.drop("group").select(*[c for c in head if c != "group"],
                                  *[F.col(f"line.{c}").alias(f"line_{c}" if c in head else c) for c in line])


# --- documents from flat tables ------------------------------------------------

def game_headers(players: DataFrame) -> DataFrame:
    """Header per game from its player rows; a game with one side keeps a
    NULL score on the other."""
    side = lambda c: F.sum(F.when(c, F.col("points"))).cast("int")
    return players.groupBy("game_id", "competition", "season", "grp", "date", "home_team", "away_team").agg(
        side(F.col("is_home")).alias("home_score"), side(~F.col("is_home")).alias("away_score"))


# Field of the document -> column it is taken from.
PLAYER_FIELDS = {"jersey": "jersey", "name": "player_name", "player_id": None, "minutes": "minutes", "points": "points",
                 "two_points_made": "t2m", "two_points_attempted": "t2a", "three_points_made": "t3m",
                 "three_points_attempted": "t3a", "free_throws_made": "ftm", "free_throws_attempted": "fta",
                 "offensive_rebounds": "orb", "defensive_rebounds": "drb", "total_rebounds": "reb", "assists": "ast",
                 "steals": "stl", "blocks": "blk", "turnovers": "tov", "fouls": "pf", "plus_minus": "plus_minus",
                 "efficiency": "val"}
PLAY_FIELDS = {"num": "num", "quarter": "quarter", "time": "time", "text": "text", "team": "team", "action": "action",
               "scoreA": "scoreA", "scoreB": "scoreB", "idPlayer": "player_id", "idTeam": "team_id"}
SHOT_FIELDS = {"quarter": "quarter", "t": "time", "player": "player", "team": "team", "m": "made", "x": "x", "y": "y"}
TEAM_FIELDS = {"id": "team_id", "name": "team_name", "pts": "points", "p2m": "t2m", "p2a": "t2a", "p3m": "t3m",
               "p3a": "t3a", "p1m": "ftm", "p1a": "fta", "ro": "off_reb", "rd": "def_reb", "rt": "tot_reb",
               "assist": "ast", "st": "stl", "to": "tov", "bs": "blk", "pf": "pf"}


def _rows(df: DataFrame, fields: dict, out: str, schema, *kept: str) -> DataFrame:
    """``game_id, _h, out`` (and ``kept``): one struct per row and the hash its game's rows are ordered by first."""
    value = F.struct(*[(F.lit("") if src is None else F.col(src)).cast(schema[f].dataType).alias(f)
                       for f, src in fields.items()])
    return df.where("game_id IS NOT NULL").select("game_id", *kept, value.alias(out)).withColumn("_h", F.pmod(F.xxhash64(out), F.lit(1024)))


def _parts(rows: DataFrame, out: str, max_rows: int, large: DataFrame | None) -> DataFrame:
    """Rows with the ``part`` of their game. A game of ``large`` has its rows numbered (by hash,
    then all values, so a game of any size is dealt to many tasks) and cut into parts of
    ``max_rows``; the rows of any other fit one part and need no number."""
    from ..operators import ordered

    if large is None:
        return rows.withColumn("part", F.lit(0).cast("long"))
    d = ordered.sequence(rows.join(large, "game_id", "left_semi"), ["game_id"], ["_h", out], F.col("_h"), "_pos")
    cut = d.withColumn("part", F.floor((F.col("_pos") - 1) / max_rows)).drop("_pos")
    return rows.join(large, "game_id", "left_anti").withColumn("part", F.lit(0).cast("long")).unionByName(cut)


GATHER_ROWS = 600_000  # rows a task gathers into documents


def large_games(tables: list[DataFrame], max_rows: int) -> tuple[int, DataFrame | None]:
    """Rows of all tables, and the games with more than ``max_rows`` in one (None without such):
    one job over the game ids."""
    spark = tables[0].sparkSession
    per = None
    for df in tables:
        d = df.where("game_id IS NOT NULL").groupBy("game_id").agg(F.count(F.lit(1)).alias("n"))
        per = d if per is None else per.unionByName(d)
    found = per.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    if (found.most or 0) <= max_rows:
        return found.rows or 0, None
    path = f"{checkpoint_dir(spark)}/courtside-large-games/{uuid.uuid4().hex[:12]}"
    per.where(F.col("n") > max_rows).select("game_id").distinct().write.parquet(path)
    return found.rows, spark.read.parquet(path)


def _field(name: str):
    return lambda x: x[name]


def docs_from_tables(players: DataFrame, plays: DataFrame | None = None, shots: DataFrame | None = None,
                     teams: DataFrame | None = None, max_rows: int = 4096, dealt: int | None = None) -> DataFrame:
    """Nested documents from flat tables, for writing a raw store of known content.

    A document holds at most ``max_rows`` rows of each list; a larger game
    has several documents with the same header. Readers make no difference
    between one document and many. Where ``players`` and ``teams`` lie bucketed by game
    (``dealt``: to so many tasks), their lists are gathered where they lie.
    """
    player, line = GAME["players_home"].dataType.elementType, GAME["play_by_play"].dataType.elementType
    shot, team = GAME["shots"].dataType.elementType, GAME["team_stats"].dataType["TEAM"].dataType.elementType
    lists = {"players_home": (players.where("is_home"), PLAYER_FIELDS, player),
             "players_away": (players.where("NOT is_home"), PLAYER_FIELDS, player),
             "play_by_play": (plays, PLAY_FIELDS, line), "shots": (shots, SHOT_FIELDS, shot),
             "team": (teams, TEAM_FIELDS, team)}
    rows, large = large_games([df for df in (players, plays, shots, teams) if df is not None], max_rows)
    here = ("players_home", "players_away", "team") if dealt and large is None else ()
    tasks = dealt if here else rows // GATHER_ROWS + 1
    stacked = None
    for name, (df, fields, schema) in lists.items():
        if df is not None and name not in here:
            p = _parts(_rows(df, fields, name, schema), name, max_rows, large)
            stacked = p if stacked is None else stacked.unionByName(p, allowMissingColumns=True)
    gathered = {}
    for name, (df, _, schema) in lists.items():
        kept = F.collect_list(F.when(F.col(name).isNotNull(), F.struct("_h", name))) if df is not None else None
        empty = F.array().cast(f"array<{schema.simpleString()}>")
        gathered[name] = empty if kept is None else F.transform(F.array_sort(kept), _field(name))
    # Dealt as they are: the lists are gathered behind the shuffle only, in tasks of bounded size,
    # and meet their headers there (with games of many parts: by part first).
    deal = ["game_id"] if large is None else ["game_id", "part"]
    d = None
    if stacked is not None:
        d = stacked.repartition(tasks, *deal).groupBy(*deal).agg(
            *[c.alias(n) for n, c in gathered.items() if lists[n][0] is not None and n not in here])
        d = d.withColumns({n: c for n, c in gathered.items() if lists[n][0] is None and not here})
    meta = F.struct("game_id", "date", F.lit("").alias("time"), F.lit("").alias("venue"), "home_team", "away_team",
                    "home_score", "away_score", F.lit("").alias("scraped_at"), F.lit("driver").alias("source"),
                    F.col("grp").alias("group"))
    # One row per game, dealt behind the sums: players that lie by game are not dealt for them.
    h = game_headers(players)
    h = (h if here or large is not None else h.repartition(tasks, "game_id")).select(
        "game_id", meta.alias("meta"), "competition", F.col("season").alias("year"), F.col("grp").alias("group"))
    d = h.join(d, "game_id") if not here else _beside(h, players, teams, d, lists, gathered)
    return d.select("meta", "players_home", "players_away", "play_by_play", "shots",
                    F.struct(F.col("team").alias("TEAM")).alias("team_stats"),
                    "competition", "year", "group")


def _beside(headers: DataFrame, players: DataFrame, teams: DataFrame | None, rest: DataFrame | None,
            lists: dict, gathered: dict[str, Column]) -> DataFrame:
    """Headers with the lists of players and teams that lie by game as they do, and with the
    other lists, which were dealt to the same tasks: no row of players or teams is dealt again."""
    sides = {"players_home": F.col("is_home"), "players_away": ~F.col("is_home")}
    p = _rows(players, PLAYER_FIELDS, "_p", lists["players_home"][2], "is_home").select(
        "game_id", "_h", *[F.when(c, F.col("_p")).alias(n) for n, c in sides.items()])
    found = [p.groupBy("game_id").agg(*[gathered[n].alias(n) for n in sides])]
    if teams is not None:
        t = _rows(teams, TEAM_FIELDS, "team", lists["team"][2])
        found.append(t.groupBy("game_id").agg(gathered["team"].alias("team")))
    found += [rest] if rest is not None else []
    d = headers
    for x in found:  # left: a list that is not read is not gathered
        d = d.join(x, "game_id", "left")
    none = {n: F.array().cast(f"array<{schema.simpleString()}>") for n, (_, _, schema) in lists.items()}
    return d.withColumns({n: F.coalesce(n, e) if n in d.columns else e for n, e in none.items()})
