"""Registered queries: one per operator id of the inventory, each with a
Spark form ``(spark, sf_dir) -> DataFrame`` and, where SQL can state it,
an oracle SQL string over the driver tables.

Every query runs over the whole driver tables (through the adapters); none
takes a subset, a prefix or a row cap unless the cap is the feature
(a top-k or a page).
"""
from __future__ import annotations

from collections.abc import Callable
import functools
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import nameindex
from .plans.colocated import Colocated, write_colocated
from .plans.lakehouse import SOURCES, build_lake, made_of, open_lake, update_lake
from .plans.migrate import migrate
from .plans.nested import ANSWERS, write_snapshot
from .plans.tables import Tables, build_layers
from .session import checkpoint_dir
from .sources import ledger
from .sources.lake import docs_from_tables, read_games, read_table, stored_documents, write_documents
from .sources.staged import Files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


_BUILT: dict[tuple[str, str], Tables] = {}
LAYERS = ("games", "players", "plays", "shots", "teams")


def _fs_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


@functools.cache
def _code_version() -> str:
    """Hash of the modules that define the layer tables: a code change
    gives new layer folders instead of reusing stale ones."""
    import pathlib
    here = pathlib.Path(__file__).parent
    files = ["sources/driver.py", "operators/clean.py", "operators/model.py", "operators/dedupe.py",
             "operators/ordered.py", "plans/tables.py", "functions/expr.py", "functions/text.py",
             "functions/rules.py", "functions/metrics.py", "sources/lake.py", "sources/schema.py"]
    h = hashlib.sha1()
    for f in files:
        h.update((here / f).read_bytes())
    return h.hexdigest()[:8]


def _fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Identity of the inputs (path, size and change time of each table)
    and of the code that builds the layers."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    parts = [sf_dir, _code_version()]
    for name in ("orders", "lineitem", "events"):
        p = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        # every file of the table: a folder's own size and time do not follow its files
        files = p.getFileSystem(conf).listFiles(p, True)
        found = []
        while files.hasNext():
            st = files.next()
            found.append(f"{st.getPath().getName()}:{st.getLen()}:{st.getModificationTime()}")
        parts.append(f"{name}:" + ",".join(sorted(found)))
    return hashlib.sha1("|".join(parts).encode()).hexdigest()[:16]


def tables(spark: SparkSession, sf_dir: str, fresh: bool = False) -> Tables:
    """The five layer tables for a driver folder, built once and written.

    Like the reference's lakehouse, the silver/gold layers are written
    tables that every question reads; they live under the shared folder
    named by ``spark.checkpoint.dir`` (a written table, so an executor
    loss never forces a rebuild from the raw tables). Only a local session
    without that setting gets a scratch folder of its own.
    """
    # By the files' identity: an input that changes during a session is built again.
    identity = _fingerprint(spark, sf_dir)
    key = (spark.sparkContext.applicationId, identity)
    if key in _BUILT and not fresh:
        return _BUILT[key]
    root = f"{checkpoint_dir(spark)}/courtside-layers/{identity}"
    if fresh:  # a new folder: measure (or redo) the whole build
        root += "-" + uuid.uuid4().hex[:8]
    _BUILT[key] = build_layers(spark, sf_dir, root, lambda p: _fs_exists(spark, p))
    return _BUILT[key]


_COLOCATED: dict[tuple[str, str], Colocated] = {}


def colocated(spark: SparkSession, sf_dir: str) -> Colocated:
    """Plays, players and games of a driver folder, bucketed by game; written once a session."""
    identity = _fingerprint(spark, sf_dir)
    key = (spark.sparkContext.applicationId, identity)
    if key not in _COLOCATED:
        t = tables(spark, sf_dir)
        root = f"{checkpoint_dir(spark)}/courtside-colocated/{identity}-{uuid.uuid4().hex[:8]}"
        _COLOCATED[key] = write_colocated(t.plays, t.players, t.games, root)
    return _COLOCATED[key]


_NAMES: dict[tuple[str, str], str] = {}


def name_index(spark: SparkSession, sf_dir: str) -> str:
    """Root of the name index of a driver folder, written once a session."""
    identity = _fingerprint(spark, sf_dir)
    key = (spark.sparkContext.applicationId, identity)
    if key not in _NAMES:
        root = f"{checkpoint_dir(spark)}/courtside-names/{identity}-{uuid.uuid4().hex[:8]}"
        nameindex.build(tables(spark, sf_dir).players, root)
        _NAMES[key] = root
    return _NAMES[key]


_LAKES: dict[tuple[str, str], dict[str, str]] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Game documents (rosters, plays, shots, team rows) of a driver folder."""
    t = tables(spark, sf_dir)
    return docs_from_tables(t.players, t.plays, t.shots, t.teams, dealt=t.dealt)


def _store(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Root of one of a driver folder's stores, written once per session when it is first
    asked for: the ``raw`` documents, an ``audited`` store of them."""
    identity = _fingerprint(spark, sf_dir)
    stores = _LAKES.setdefault((spark.sparkContext.applicationId, identity), {})
    if name not in stores:
        root = f"{checkpoint_dir(spark)}/courtside-lake/{identity}-{uuid.uuid4().hex[:8]}/{name}"
        if name == "raw":
            write_documents(documents(spark, sf_dir), root)
        elif name == "audited":
            write_documents(documents(spark, sf_dir), root)
            # A move begun earlier: some documents also lie under a new key.
            moved = read_games(spark, root).where("competition = '5-LOW' AND group = 'F'").withColumn("competition", F.lit("LOW"))
            write_documents(moved, root, more=True)
        stores[name] = root
    return stores[name]


def raw_root(spark: SparkSession, sf_dir: str) -> str:
    return _store(spark, sf_dir, "raw")


def raw_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents of the raw store that is to be audited."""
    return stored_documents(spark, _store(spark, sf_dir, "audited"))


_LAKE_TABLES: dict[tuple[str, str], tuple[str, set[tuple[str, str]]]] = {}


def _lake_root(spark: SparkSession, sf_dir: str, *wanted: tuple[str, str]) -> str:
    """Root of the lake built from the raw store; its tables (and all they are made of) are
    written once per session, when first asked for."""
    identity = _fingerprint(spark, sf_dir)
    root, there = _LAKE_TABLES.setdefault((spark.sparkContext.applicationId, identity), (
        f"{checkpoint_dir(spark)}/courtside-lake/{identity}-{uuid.uuid4().hex[:8]}/lake", set()))
    missing = made_of(spark, *wanted) - there
    if missing:
        build_lake(spark, raw_root(spark, sf_dir), root, only=missing)
        there |= missing
    return root


def lake(spark: SparkSession, sf_dir: str, layer: str, name: str) -> DataFrame:
    """A table of the lake built from the raw store."""
    return read_table(spark, _lake_root(spark, sf_dir, (layer, name)), layer, name)


def lake_tables(spark: SparkSession, sf_dir: str, *names: str) -> Tables:
    """The tables of the lake that a question reads, as ``names`` says."""
    return open_lake(spark, _lake_root(spark, sf_dir, *[SOURCES[n] for n in names]), only=names)


_UPDATED: dict[tuple[str, str], str] = {}


def updated_lake(spark: SparkSession, sf_dir: str) -> str:
    """Root of a lake that was brought up to date by its ledger: built from a
    store that lacks one competition and has an outdated one, then updated
    after the store was put right. ``changes`` holds the ledger's comparison."""
    identity = _fingerprint(spark, sf_dir)
    key = (spark.sparkContext.applicationId, identity)
    if key not in _UPDATED:
        root = f"{checkpoint_dir(spark)}/courtside-updated/{identity}-{uuid.uuid4().hex[:8]}"
        docs = read_games(spark, raw_root(spark, sf_dir))  # gathered once, not per store
        late = docs.where("competition = '5-LOW'")
        write_documents(docs.where("competition <> '5-LOW'").unionByName(
            late.withColumn("competition", F.lit("9-OLD"))), f"{root}/raw")
        update_lake(spark, f"{root}/raw", f"{root}/lake")
        write_documents(late, f"{root}/raw")
        Files(spark, root).delete(f"{root}/raw/competition=9-OLD")
        now = ledger.raw_files(spark, f"{root}/raw")
        ledger.summary(ledger.compare(now, ledger.known_files(spark, f"{root}/lake", now))).write.parquet(f"{root}/changes")
        update_lake(spark, f"{root}/raw", f"{root}/lake")
        _UPDATED[key] = root
    return _UPDATED[key]


_MIGRATED: dict[tuple[str, str], dict[str, str]] = {}


def migrated(spark: SparkSession, sf_dir: str, renames: dict[str, str], invalid: list[str], bad_groups: list[str]) -> dict[str, str]:
    """A migration carried out on a copy of a driver folder's documents: ``raw``
    is the store afterwards, ``backup`` the store of what was dropped."""
    identity = _fingerprint(spark, sf_dir)
    key = (spark.sparkContext.applicationId, identity)
    if key not in _MIGRATED:
        root = f"{checkpoint_dir(spark)}/courtside-migrated/{identity}-{uuid.uuid4().hex[:8]}"
        write_documents(documents(spark, sf_dir), f"{root}/raw")
        done = migrate(spark, f"{root}/raw", f"{root}/backup", renames, invalid, bad_groups)
        _MIGRATED[key] = {"raw": f"{root}/raw", "backup": done["backup"]}
    return _MIGRATED[key]


_ANSWERS: dict[tuple[str, str], dict[str, str]] = {}


def answers(spark: SparkSession, sf_dir: str, name: str, published: bool = False) -> DataFrame:
    """Whole player or team answers of a driver folder, written once a session when first asked
    for; ``published``: as the JSON of the snapshot of both holds them."""
    identity = _fingerprint(spark, sf_dir)
    done = _ANSWERS.setdefault((spark.sparkContext.applicationId, identity), {})

    def table(kind: str) -> DataFrame:
        if kind not in done:
            root = f"{checkpoint_dir(spark)}/courtside-answers/{identity}-{uuid.uuid4().hex[:8]}/{kind}"
            ANSWERS[kind](tables(spark, sf_dir)).write.option("compression", "zstd").parquet(root)
            done[kind] = root
        return spark.read.parquet(done[kind])

    d = table(name)
    if not published:
        return d
    if "snapshot" not in done:
        root = f"{checkpoint_dir(spark)}/courtside-answers/{identity}-{uuid.uuid4().hex[:8]}/snapshot"
        write_snapshot(spark, {kind: table(kind) for kind in ANSWERS}, root)
        done["snapshot"] = root
    return spark.read.schema(d.schema).json(f"{done['snapshot']}/{name}")


def load_all() -> None:
    """Import the modules that register queries."""
    from . import queries  # noqa: F401
