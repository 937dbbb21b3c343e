"""Skew-safe ordered operators equal the plain window; dedupe is total."""
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from courtside.operators import ordered
from courtside.operators.dedupe import first_by


def _data(spark, n=3000):
    rnd = random.Random(7)
    # one hot key with most rows, as a skewed game would be
    rows = [(0 if rnd.random() < 0.6 else rnd.randint(1, 20), rnd.randint(0, 500), i, rnd.randint(-5, 9))
            for i in range(n)]
    return spark.createDataFrame(rows, "k long, t long, id long, v int")


def test_sequence_matches_row_number(spark):
    d = _data(spark)
    got = ordered.sequence(d, ["k"], ["t", "id"], F.floor(F.col("t") / 37), "seq")
    want = d.withColumn("seq", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")).cast("long"))
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())


def test_running_matches_window(spark):
    d = _data(spark)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    for how, fn in (("max", F.max), ("sum", F.sum)):
        got = ordered.running(d, ["k"], ["t", "id"], F.floor(F.col("t") / 50), {"r": F.col("v")}, how=how)
        want = d.withColumn("r", fn("v").over(w))
        assert sorted(got.select("id", "r").collect()) == sorted(want.select("id", "r").collect())


def test_with_next_matches_lead(spark):
    d = ordered.sequence(_data(spark), ["k"], ["t", "id"], F.floor(F.col("t") / 37), "seq")
    got = ordered.with_next(d, ["k"], "seq", {"nv": "v"})
    want = d.withColumn("nv", F.lead("v").over(Window.partitionBy("k").orderBy("seq")))
    assert sorted(got.select("id", "nv").collect()) == sorted(want.select("id", "nv").collect())


def test_first_by_is_total(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (1, 1, "a"), (2, 5, None), (2, 4, "z")],
                               "k int, o int, x string")
    got = {r.k: (r.o, r.x) for r in first_by(df, ["k"], ["o"]).collect()}
    assert got == {1: (1, "a"), 2: (4, "z")}
    # same answer on 1 and many partitions
    again = {r.k: (r.o, r.x) for r in first_by(df.repartition(5), ["k"], ["o"]).collect()}
    assert again == got


def test_null_keys_and_values_stay(spark):
    from pyspark.sql import functions as F

    from courtside.operators import ordered
    df = spark.createDataFrame([(1, None, 5), (1, 2, 7), (None, 1, 3), (None, None, 4), (1, 9000, 6)], "g int, num int, v int")
    out = ordered.sequence(df, ["g"], [F.col("num").asc_nulls_first()], ordered.bucket_of(F.col("num")), "pos")
    assert sorted((r.g or 0, r.pos, r.v) for r in out.collect()) == [(0, 1, 4), (0, 2, 3), (1, 1, 5), (1, 2, 7), (1, 3, 6)]
    run = ordered.running(df, ["g"], [F.col("num").asc_nulls_first()], ordered.bucket_of(F.col("num")), {"s": F.col("v")}, how="sum")
    assert sorted((r.g or 0, r.s) for r in run.collect()) == [(0, 4), (0, 7), (1, 5), (1, 12), (1, 18)]


def test_carry_over_many_blocks(spark):
    """Buckets far beyond one carry block, against the plain window."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from courtside.operators import ordered
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 100003).alias("t"), "id")
    out = ordered.sequence(df, ["g"], ["t", "id"], F.col("t") * 1000, "pos")
    want = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("t", "id")).cast("long"))
    assert out.exceptAll(want).count() == 0 and out.count() == 3000


def test_hot_game_is_spread(spark, monkeypatch):
    """A third of all plays in one game: its plays end in many tasks, a few buckets each."""
    from pyspark.sql import functions as F

    from courtside.plans import playbyplay
    n = 30000
    plays = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("game_id"), F.col("id").cast("int").alias("num"),
        (1 + F.col("id") % 4).cast("int").alias("quarter"), F.format_string("%02d:%02d", F.col("id") % 10, F.col("id") % 60).alias("time"),
        (F.col("id") % 50).cast("int").alias("scoreA"), F.lit(0).alias("scoreB"))
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "64",
            "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    monkeypatch.setattr(playbyplay, "POSITIONS", 256)
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        parts = playbyplay.running_score(plays).groupBy(F.spark_partition_id().alias("p")).agg(
            F.count_if(F.col("game_id") == 0).alias("hot")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(r.hot for r in parts) <= n // 3 // 4 and sum(r.hot for r in parts) == n // 3


def test_running_score_with_missing_order_values(spark):
    """Missing periods, clocks and numbers come first in their level; bad clocks and large numbers keep the order."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from courtside.functions import expr as X
    from courtside.plans import playbyplay
    rows = [(q, t, n, (7 * i) % 90, (11 * i) % 80) for i, (q, t, n) in enumerate(
        (q, t, n) for q in (None, 1, 2, 5) for t in (None, "bad", "10:00", "09:59", "00:00", "25:00")
        for n in (None, -5000, 1, 4095, 4096, 2_000_000_000))]
    plays = spark.createDataFrame([(1, *r) for r in rows],
                                  "game_id long, quarter int, time string, num int, scoreA int, scoreB int").distinct()
    d = playbyplay.running_score(plays).withColumn("e", F.lit(X.COURT.period_s) - X.clock_seconds("time"))
    # Rows equal in the order may come in any order: compare what is fixed, the maximum up to their last.
    keys = ["quarter", "e", "num"]
    w = Window.partitionBy("game_id").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    got = d.withColumn("want", F.max("scoreA").over(w)).groupBy(*keys).agg(F.max("score_home").alias("got"), F.max("want").alias("want"))
    assert got.where("NOT got <=> want").count() == 0 and got.count() == 4 * 4 * 6  # NULL and unreadable clocks are one


def test_next_row_over_buckets_and_blocks(spark):
    """The next row is the plain window's, across empty buckets, blocks of buckets, NULL keys and a NULL order."""
    rows = [(g, n, f"{g}-{n}") for g in (1, 2, None) for n in (None, 1, 2, 9, 10, 11, 40, 41, 1000, 5000)] + [(3, 7, "3-7")]
    df = spark.createDataFrame(rows, "g int, n int, v string")
    d = ordered.next_row(df, ["g"], ["n"], ordered.bucket_of(F.col("n"), 5), ["v"], carry=4)
    want = df.withColumn("w", F.lead("v").over(Window.partitionBy("g").orderBy("n")))
    assert sorted(map(str, d.select("g", "n", "v", "_next.v").collect())) == sorted(
        map(str, want.select("g", "n", "v", F.col("w").alias("v")).collect()))


def test_rows_are_dealt_once(spark):
    """Numbering and running sums deal the rows by (key, bucket) once: a bucket's carry comes as a row of it."""
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").alias("n"), F.lit("x").alias("wide"))
    for d in (ordered.sequence(df, ["g"], ["n"], ordered.bucket_of(F.col("n"), 8), total="all"),
              ordered.running(df, ["g"], ["n"], ordered.bucket_of(F.col("n"), 8), {"s": F.col("n")}, how="sum"),
              ordered.next_row(df, ["g"], ["n"], ordered.bucket_of(F.col("n"), 8), ["n"])):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        above = plan.split("Union")[0]
        assert plan.count("Union") == 1 and "Join" not in above and d.count() == 100, plan


def test_first_of_few_is_first_by(spark, monkeypatch):
    """Only rows whose key has several are compared; NULL keys are one key."""
    from courtside.operators import dedupe

    rows = [(1, "a", 3), (1, "a", 2), (2, None, 5), (2, None, 4), (None, None, 1), (None, None, 0), (3, "c", 9), (4, "c", 9)]
    d = spark.createDataFrame(rows, "g long, k string, v int")
    wanted = sorted(map(str, dedupe.first_by(d, ["g", "k"], ["v"]).collect()))
    got = dedupe.first_of_few(d, ["g", "k"], ["v"])
    assert got.columns == d.columns and sorted(map(str, got.collect())) == wanted and len(wanted) == 5
    once = dedupe.first_of_few(d.where("v IN (3, 9)"), ["g", "k"], ["v"])
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString() and once.count() == 3
    monkeypatch.setattr(dedupe, "FEW_KEYS", 1)
    assert sorted(map(str, dedupe.first_of_few(d, ["g", "k"], ["v"]).collect())) == wanted
