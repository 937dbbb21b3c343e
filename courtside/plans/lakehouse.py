"""Raw documents -> bronze -> silver -> gold -> serving, on any Hadoop path.

Every table is partitioned by (competition, season), written staged and read
with its declared schema (:func:`contracts`). A run over a scope replaces that
scope's partitions and nothing else; ``rebuild`` replaces the tables;
``update_lake`` builds just the partitions whose raw files changed. Each step
reads the tables the previous one wrote (a lost executor never forces a
rebuild from the raw documents), through the same scope, so unscoped folders are
not read.
"""
from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import Scope
from ..operators import clean, model
from ..sources import lake, ledger
from ..sources.schema import GAME_WITH_PATH, SERVING
from .tables import Tables

BRONZE = {"games": lake.bronze_games, "players": lake.bronze_players, "plays": lake.bronze_plays,
          "shots": lake.bronze_shots, "teams": lake.bronze_teams}
Load = Callable[[str, str], DataFrame]
# The steps behind the documents: layer, table, how it is made of tables before it (``load.written``: by
# a build, which may count their rows; not by the plans of :func:`contracts`).
STEPS: list[tuple[str, str, Callable[[Load], DataFrame]]] = [
    *[("bronze", name, lambda load, make=make: make(load("bronze", "documents").withColumn("year", F.col("season"))))
      for name, make in BRONZE.items()],
    ("silver", "games", lambda load: clean.clean_games(load("bronze", "games"), load.written)),
    ("silver", "players", lambda load: clean.typed(load("bronze", "players"), "players", written=load.written)),
    ("silver", "plays", lambda load: clean.clean_plays(load("bronze", "plays"), load("silver", "players"), written=load.written)),
    ("silver", "shots", lambda load: clean.clean_shots(load("bronze", "shots"), load.written)),
    ("silver", "teams", lambda load: clean.clean_teams(load("bronze", "teams"), written=load.written)),
    ("gold", "fact_games", lambda load: model.fact_games(load("silver", "players"))),
    ("gold", "fact_shots", lambda load: model.fact_shots(load("silver", "shots"))),
    ("gold", "fact_team_games", lambda load: model.fact_team_games(load("silver", "teams"))),
    ("gold", "dim_players", lambda load: model.dim_players(load("silver", "players"))),
    ("gold", "dim_teams", lambda load: model.dim_teams(load("silver", "teams"))),
]
# Where the questions, and so the serving tables, read from.
SOURCES = {"games": ("gold", "fact_games"), "players": ("silver", "players"), "plays": ("silver", "plays"),
           "shots": ("gold", "fact_shots"), "teams": ("silver", "teams")}
# Keys a table's files are sorted by; bronze and silver rows are looked up by game.
SORT = {"dim_players": ("player_name",), "dim_teams": ("team_id",)}
BY_GAME = ("game_id",)
PARTITION = ("competition", "season")

# Columns that are made of a row alone, behind the write's dealing of the rows: they are not dealt.
MADE = {("silver", "players"): clean.player_rates}

Table = tuple[str, str]
_CONTRACTS: dict[str, dict[Table, T.StructType]] = {}
_READS: dict[Table, set[Table]] = {}  # what a table's step reads


def contracts(spark: SparkSession) -> dict[Table, T.StructType]:
    """The declared schema of every layer table: what the steps make of the
    declared raw document (plans of empty tables, nothing is run)."""
    key = spark.sparkContext.applicationId
    if key not in _CONTRACTS:
        empty = spark.createDataFrame([], GAME_WITH_PATH)
        frames = {("bronze", "documents"): empty.withColumn("season", F.col("year"))}
        for layer, name, make in STEPS:
            read = _READS.setdefault((layer, name), set())
            load = lambda x, y, read=read: read.add((x, y)) or frames[x, y]
            load.written = False
            d = make(load)
            frames[layer, name] = MADE[layer, name](d) if (layer, name) in MADE else d
        for name, source in SOURCES.items():
            frames["serving", name] = lake.to_serving(frames[source], name)
            _READS["serving", name] = {source}
        _CONTRACTS[key] = {k: lake.contract(df, PARTITION, None) for k, df in frames.items()}
    return _CONTRACTS[key]


def made_of(spark: SparkSession, *wanted: Table) -> set[Table]:
    """The tables of a lake that are written for ``wanted`` ones: these and all they are made of."""
    contracts(spark)
    found, todo = set(), list(wanted)
    while todo:
        table = todo.pop()
        if table not in found:
            found.add(table)
            todo += _READS.get(table, ())
    return found


def build_lake(spark: SparkSession, raw_root: str, lake_root: str, scope: Scope | None = None, rebuild: bool = False,
               report: dict | None = None, only: set[Table] | None = None) -> Tables | None:
    """Build every layer for ``scope`` (all of it by default) and return the
    tables the questions read. ``report`` receives each table's counts.
    ``only``: just these tables, from what is there (see :func:`made_of`); nothing is returned."""
    declared = contracts(spark)
    asked = lambda layer, name: only is None or (layer, name) in only
    # Exact partitions are replaced even where the store has no document of them any more.
    replaced = scope.partitions or () if scope else ()

    def save(df: DataFrame, layer: str, name: str) -> None:
        how = dict(rebuild=rebuild, replaced=replaced)
        if layer == "serving":
            counts = lake.write_serving(df, lake_root, layer, name, **how)
        else:
            keys = SORT.get(name, BY_GAME) if name != "documents" else ()
            counts = lake.write_table(df, lake_root, layer, name, sort_by=keys, made=MADE.get((layer, name)), **how)
        if report is not None:
            report[f"{layer}.{name}"] = counts

    def load(layer: str, name: str) -> DataFrame:
        return lake.read_table(spark, lake_root, layer, name, scope, declared=declared[layer, name])

    load.written = True

    def together(jobs: list) -> None:
        """Tables that do not need each other share the executors."""
        if not jobs:
            return
        with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
            for done in [pool.submit(job) for job in jobs]:
                done.result()

    # The documents are parsed once; the five bronze tables read their columns from there.
    if asked("bronze", "documents"):
        save(lake.read_games(spark, raw_root, scope).withColumn("season", F.col("year")), "bronze", "documents")
    # Silver plays need silver players; all else needs the layer before it only.
    wave = lambda layer, plays=None: [
        lambda s=s: save(s[2](load), s[0], s[1]) for s in STEPS
        if s[0] == layer and plays in (None, s[1] == "plays") and asked(s[0], s[1])]
    for jobs in (wave("bronze"), wave("silver", False), wave("silver", True), wave("gold")):
        together(jobs)
    together([lambda n=n, s=s: save(load(*s), "serving", n) for n, s in SOURCES.items() if asked("serving", n)])
    return open_lake(spark, lake_root, scope) if only is None else None


def open_lake(spark: SparkSession, lake_root: str, scope: Scope | None = None, only: tuple[str, ...] = tuple(SOURCES)) -> Tables:
    """The tables of a lake that the questions read; ``only``: just these, None for the others."""
    declared = contracts(spark)
    return Tables(**{name: lake.read_table(spark, lake_root, *source, scope, declared=declared[source]) if name in only else None
                     for name, source in SOURCES.items()})


def update_lake(spark: SparkSession, raw_root: str, lake_root: str, report: dict | None = None) -> tuple[tuple[str, int], ...]:
    """Build the partitions whose raw files are new, changed or gone since the
    last update, and return them. The ledger takes a partition's files after its
    tables are there: a run that dies builds the same partitions again."""
    now = ledger.raw_files(spark, raw_root)
    stale = ledger.stale_partitions(ledger.compare(now, ledger.known_files(spark, lake_root, now)))
    if not stale:
        return ()
    # Taken before the build, so a file that changes meanwhile is found the next time.
    scope = Scope(partitions=stale)
    seen = f"{lake_root}/{ledger.LAYER}/_pending"
    lake.narrow(now, scope).write.mode("overwrite").parquet(seen)
    build_lake(spark, raw_root, lake_root, scope, report=report)
    ledger.record(spark.read.schema(now.schema).parquet(seen), lake_root, stale)
    return stale
