"""Layer tables that are always readable, and lakes brought up to date from
the changes of their raw files."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from courtside.functions.rules import Scope
from courtside.plans.lakehouse import SOURCES, STEPS, build_lake, contracts, open_lake, update_lake
from courtside.sources import lake, ledger, staged


def _docs(t):
    return lake.docs_from_tables(t.players, t.plays, t.shots, t.teams)


def _root():
    return tempfile.mkdtemp(prefix="cs-lakehouse-")


def _table(spark):
    return spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 30)], "competition string, season int, n int")


def _rows(spark, root):
    return sorted(tuple(r) for r in lake.read_table(spark, root, "silver", "x").select("competition", "season", "n").collect())


def test_empty_tables_keep_their_schema(spark):
    root = _root()
    df = _table(spark)
    assert lake.write_table(df.limit(0), root, "silver", "x", rebuild=True, sort_by=("n",)) == {"rows": 0}
    assert _rows(spark, root) == []
    assert lake.read_table(spark, root, "silver", "x").dtypes == [("n", "int"), ("competition", "string"), ("season", "int")]
    assert lake.write_table(df, root, "silver", "x")["rows"] == 3
    lake.write_table(df.limit(0), root, "silver", "x")        # nothing to replace
    assert len(_rows(spark, root)) == 3
    lake.write_table(df.limit(0), root, "silver", "x", replaced=[("a", 1), ("c d:e", 7)])
    assert _rows(spark, root) == [("a", 2, 20), ("b", 1, 30)]
    lake.write_table(df.limit(0), root, "silver", "x", rebuild=True)
    assert _rows(spark, root) == [] and spark.read.parquet(f"{root}/silver/x").count() == 0  # a reader without our schema
    lake.write_table(df, root, "silver", "x")
    assert len(_rows(spark, root)) == spark.read.parquet(f"{root}/silver/x").count() == 3


def test_partition_names_with_special_characters(spark):
    root = _root()
    df = spark.createDataFrame([("a b:c/d%", 1, 1), ("é+", 1, 2)], "competition string, season int, n int")
    lake.write_table(df, root, "silver", "x")
    assert _rows(spark, root) == [("a b:c/d%", 1, 1), ("é+", 1, 2)]
    lake.write_table(df.limit(0), root, "silver", "x", replaced=[("a b:c/d%", 1)])
    assert _rows(spark, root) == [("é+", 1, 2)]


def test_changed_type_is_refused(spark):
    root = _root()
    lake.write_table(_table(spark), root, "silver", "x")
    other = _table(spark).withColumn("n", F.col("n").cast("string"))
    with pytest.raises(lake.SchemaChanged, match="n: int -> string"):
        lake.write_table(other, root, "silver", "x")
    assert len(_rows(spark, root)) == 3
    lake.write_table(_table(spark).where("season = 2").withColumn("more", F.lit("m")), root, "silver", "x")
    got = lake.read_table(spark, root, "silver", "x")
    assert got.where("more IS NULL").count() == 2 and got.where("more = 'm'").count() == 1
    lake.write_table(other, root, "silver", "x", rebuild=True)
    assert dict(lake.read_table(spark, root, "silver", "x").dtypes)["n"] == "string"


def test_a_failed_run_leaves_the_old_table(spark):
    root = _root()
    lake.write_table(_table(spark), root, "silver", "x")
    bad = _table(spark).withColumn("n", F.when(F.col("n") > 20, F.raise_error(F.lit("lost"))).otherwise(F.col("n")).cast("int"))
    for rebuild in (False, True):
        with pytest.raises(Exception, match="lost"):
            lake.write_table(bad, root, "silver", "x", rebuild=rebuild)
        assert _rows(spark, root) == [("a", 1, 10), ("a", 2, 20), ("b", 1, 30)]


@pytest.mark.parametrize("rebuild", [False, True])
@pytest.mark.parametrize("after", range(4))
def test_a_run_killed_while_moving_is_carried_on(spark, monkeypatch, rebuild, after):
    """Killed after so many of its renames (journal and schema count too)."""
    root = _root()
    lake.write_table(_table(spark), root, "silver", "x")
    move, done = staged.Files.move, []

    def dying(self, source, target):
        if len(done) > after:
            raise KeyboardInterrupt
        done.append(target)
        move(self, source, target)

    monkeypatch.setattr(staged.Files, "move", dying)
    new = _table(spark).where("season = 1").withColumn("n", F.col("n") + 1)
    with pytest.raises(KeyboardInterrupt):
        lake.write_table(new.unionByName(new.withColumn("season", F.lit(3))), root, "silver", "x", rebuild=rebuild)
    monkeypatch.setattr(staged.Files, "move", move)
    want = [("a", 1, 11), ("a", 3, 11), ("b", 1, 31), ("b", 3, 31)] + ([] if rebuild else [("a", 2, 20)])
    assert _rows(spark, root) == sorted(want)
    assert not os.listdir(f"{root}/silver/_journal") and not os.listdir(f"{root}/silver/_staging")


def test_counts_come_with_the_write(spark):
    rows = [(7, 1, 1, "q", None), (8, 1, 70_000, "r", 5)]
    src = spark.createDataFrame(rows, "game_id long, season int, quarter int, time string, scoreA int")
    full = src.select("game_id", F.lit("c").alias("competition"), "season", "quarter", "time", *[
        F.lit(None).cast("string").alias(c) for c in lake.SERVING["plays"][0]
        if c not in ("game_id", "competition", "season", "quarter", "time", "scoreA")], "scoreA")
    root = _root()
    # quarter 70000 does not fit; team and scoreB are NULL twice, scoreA once.
    assert lake.write_serving(full, root, "serving", "plays") == {"rows": 2, "casts_failed": 1, "nulls_replaced": 5}
    got = {r.game_id: (r.quarter, r.scoreA) for r in lake.read_table(spark, root, "serving", "plays").collect()}
    assert got == {7: (1, 0), 8: (None, 5)}


def test_declared_schemas_are_those_of_the_tables(spark, t):
    raw, root, report = _root(), _root(), {}
    lake.write_documents(_docs(t), raw)
    build_lake(spark, raw, root, report=report)
    for (layer, name), schema in contracts(spark).items():
        assert spark.read.parquet(f"{root}/{layer}/{name}").schema.simpleString() == schema.simpleString(), (layer, name)
        assert report[f"{layer}.{name}"]["rows"] == lake.read_table(spark, root, layer, name).count()
    # a scope without any document gives empty, readable tables
    none = open_lake(spark, root, Scope(partitions=()))
    assert none.players.count() == 0
    build_lake(spark, raw, root, Scope(("nope",)), rebuild=True)
    assert open_lake(spark, root).plays.count() == 0
    assert open_lake(spark, root).plays.schema == contracts(spark)[SOURCES["plays"]]


def _same_lakes(spark, a, b):
    for layer, name in [("bronze", "documents"), *[(layer, name) for layer, name, _ in STEPS], *[("serving", n) for n in SOURCES]]:
        x, y = (lake.read_table(spark, r, layer, name) for r in (a, b))
        x, y = (d.select(*[F.round(c, 9).alias(c) if k == "double" else c for c, k in d.dtypes]) for d in (x, y))
        assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0, (layer, name)


def test_update_builds_the_changed_partitions_only(spark, t):
    raw, root = _root(), _root()
    docs = _docs(t)
    parts = sorted((r.competition, r.season) for r in t.players.select("competition", "season").distinct().collect())
    (c0, s0), (c1, s1) = parts[0], parts[-1]
    first = docs.where(~((F.col("competition") == c0) & (F.col("year") == s0)))
    lake.write_documents(first, raw)
    assert set(update_lake(spark, raw, root)) == set(parts[1:])
    assert update_lake(spark, raw, root) == ()
    # a new partition, and a changed document: one game of the last partition is gone from its file
    gid = docs.where((F.col("competition") == c1) & (F.col("year") == s1)).agg(F.min("meta.game_id")).first()[0]
    lake.write_documents(docs.where((F.col("competition") == c0) & (F.col("year") == s0)), raw)
    lake.write_documents(docs.where((F.col("competition") == c1) & (F.col("year") == s1) & (F.col("meta.game_id") != gid)), raw)
    assert update_lake(spark, raw, root) == tuple(sorted({(c0, s0), (c1, s1)}))
    whole = _root()
    build_lake(spark, raw, whole)
    _same_lakes(spark, root, whole)
    # a partition whose documents are all deleted
    staged.Files(spark, raw).delete(f"{raw}/competition={c0}/year={s0}")
    assert update_lake(spark, raw, root) == ((c0, s0),)
    assert open_lake(spark, root).players.where((F.col("competition") == c0) & (F.col("season") == s0)).count() == 0
    now = ledger.raw_files(spark, raw)
    assert ledger.compare(now, ledger.known_files(spark, root, now)).where("status <> 'same'").count() == 0
