"""What is shuffled and written once: documents, box-score lines, names, stores and answers."""
import os
import re
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from courtside import catalog
from courtside.operators import clean
from courtside.plans.migrate import migrate
from courtside.sources import driver, lake

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return catalog.tables(spark, SF)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_are_gathered_without_numbering(t):
    """Games that fit one document are dealt once: no window, no count per hash of a game's rows."""
    docs = lake.docs_from_tables(t.players, t.plays, t.shots, t.teams)
    plan = _plan(docs)
    assert "Window" not in plan and "Expand" not in plan
    cut = lake.docs_from_tables(t.players, t.plays, t.shots, t.teams, max_rows=3)
    assert "Window" in _plan(cut) and cut.count() > docs.count()
    one = lake.bronze_plays(docs)
    assert one.exceptAll(lake.bronze_plays(cut)).count() == 0 and one.count() == lake.bronze_plays(cut).count()
    # a document's rows are in the same order either way
    first = lambda d: {r.g: r.p for r in d.select(F.col("meta.game_id").alias("g"), "players_home.name").select(
        "g", F.col("name").alias("p")).where("size(p) BETWEEN 1 AND 3").collect()}
    a, b = first(docs), first(cut)
    assert a and all(b[g] == p for g, p in a.items() if Counter(b.get(g, [])) == Counter(p))


def test_documents_of_rows_without_game(spark, t):
    odd = t.players.withColumn("game_id", F.when(F.col("game_id") % 2 == 0, F.col("game_id")))
    docs = lake.docs_from_tables(odd, t.plays, t.shots, t.teams)
    assert docs.where("meta.game_id IS NULL").count() == 0 and docs.count() == odd.where("game_id IS NOT NULL").select("game_id").distinct().count()


def test_stores_are_packed_and_readable(spark, t):
    root = tempfile.mkdtemp(prefix="cs-packed-") + "/raw"
    docs = lake.docs_from_tables(t.players)
    lake.write_documents(docs, root)
    names = [n for _, _, found in os.walk(root) for n in found if n[0] not in "._"]
    assert names and all(n.endswith(".json.gz") for n in names)
    assert lake.read_games(spark, root).count() == docs.count() == lake.stored_documents(spark, root).count()
    done = migrate(spark, root, root + "-backup", {"5-LOW": "LOW"}, ["3-MEDIUM"], ["P"])
    kept = docs.where("competition <> '3-MEDIUM' AND group <> 'P'")
    after = lake.read_games(spark, root)
    assert done["finished"] == {"left": 0} and after.count() == kept.count()
    assert after.where("competition = 'LOW'").count() == kept.where("competition = '5-LOW'").count() > 0
    assert lake.read_games(spark, done["backup"]).count() == docs.count() - kept.count()
    names = [n for _, _, found in os.walk(f"{root}/competition=LOW") for n in found if n[0] not in "._"]
    assert names and all(n.endswith(".json.gz") for n in names)


def test_only_the_store_that_is_asked_for(spark, t):
    catalog._LAKES.clear()
    catalog.raw_store(spark, SF)
    assert {k for stores in catalog._LAKES.values() for k in stores} == {"audited"}
    moved = lake.read_games(spark, next(iter(catalog._LAKES.values()))["audited"]).where("competition = 'LOW'")
    assert moved.count() == t.players.where("competition = '5-LOW' AND grp = 'F'").select("game_id").distinct().count() > 0


def test_answers_write_what_is_asked_for(spark, t):
    catalog._ANSWERS.clear()
    d = catalog.answers(spark, SF, "players")
    done = next(iter(catalog._ANSWERS.values()))
    assert set(done) == {"players"}
    again = catalog.answers(spark, SF, "players", published=True)
    assert set(done) == {"players", "teams", "snapshot"} and again.count() == d.count()


def test_lines_dealt_by_order(spark):
    """Dealt by order the lines are the same rows, and players are made of them without a further shuffle."""
    plain = driver.lines(spark, SF)
    dealt = driver.lines(spark, SF, 3)
    assert plain.exceptAll(dealt).count() == 0 and plain.count() == dealt.count()
    players = clean.clean_players(dealt.drop("_surnames", "_given", "player_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(players).split("== Initial Plan ==")[-1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2, plan


def test_shared_label_names_nobody(spark):
    players = spark.createDataFrame([(1, True, "RUIZ, ANA"), (1, True, "RUIZ, ALBA"), (1, True, "SANZ, EVA"), (2, True, None)],
                                    "game_id long, is_home boolean, player_name string")
    plays = spark.createDataFrame([(1, 7, 1, 1, "(10:00) A. RUIZ: TAPÓN"), (1, 8, 2, 1, "(10:00) E. SANZ: TAPÓN"),
                                   (1, 9, 3, 2, "(10:00) E. SANZ: TAPÓN"), (2, 7, 1, 1, "(10:00) E. SANZ: TAPÓN")],
                                  "game_id long, player_id int, num int, team int, text string")
    d = clean.name_directory(plays, players)
    assert [tuple(r) for r in d.collect()] == [(1, 8, "SANZ, EVA")]
    # the sheet's rows are not sorted and reduced before they meet a play
    assert not re.search(r"Aggregate\(key=\[game_id#\d+L?, is_home", _plan(d))


def test_documents_gathered_where_rows_lie(spark, t):
    """Players and teams that are bucketed by game make the same documents, and none of their rows is dealt again."""
    assert t.dealt and t.players.count() > 0
    plain = lake.docs_from_tables(t.players, t.plays, t.shots, t.teams)
    here = lake.docs_from_tables(t.players, t.plays, t.shots, t.teams, dealt=t.dealt)
    text = lambda d: sorted(r[0] for r in d.select(F.to_json(F.struct("*"))).collect())
    assert text(here) == text(plain)
    assert text(lake.docs_from_tables(t.players, dealt=t.dealt)) == text(lake.docs_from_tables(t.players))
    cut = [lake.docs_from_tables(t.players, t.plays, t.shots, t.teams, max_rows=3, dealt=n) for n in (None, t.dealt)]
    assert text(cut[0]) == text(cut[1])  # large games go the other way
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(lake.wide_box_score(here)).split("== Initial Plan ==")[-1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan, plan


def test_lake_tables_are_made_when_asked_for(spark, t):
    """A table of the lake is written with what it is made of, the others when they are asked for; rows as in a whole lake."""
    catalog._LAKE_TABLES.clear()
    games = catalog.lake(spark, SF, "bronze", "games")
    root, there = next(iter(catalog._LAKE_TABLES.values()))
    assert there == {("bronze", "documents"), ("bronze", "games")}
    players = catalog.lake(spark, SF, "silver", "players")
    assert there == {("bronze", "documents"), ("bronze", "games"), ("bronze", "players"), ("silver", "players")}
    whole = tempfile.mkdtemp(prefix="cs-lake-")
    from courtside.plans.lakehouse import build_lake
    build_lake(spark, catalog.raw_root(spark, SF), whole)
    for layer, name, d in (("bronze", "games", games), ("silver", "players", players)):
        other = lake.read_table(spark, whole, layer, name)
        assert d.schema == other.schema and d.count() == other.count() > 0 and d.exceptAll(other).count() == 0


def test_game_pages_are_written_where_players_lie(t):
    """Only the games' headers are dealt; the pages are those of the way by numbers."""
    from courtside.sources import pages, site

    assert t.dealt
    here = site.game_pages(t.players, t.games, dealt=t.dealt)
    plan = _plan(here)
    assert plan.count("Exchange ") == 1 and "Broadcast" not in plan and "Window" not in plan
    dealt = site.game_pages(t.players, t.games)
    assert here.schema.names == dealt.schema.names and here.exceptAll(dealt).count() == 0 and here.count() == dealt.count() > 0
    cut = site.game_pages(t.players, t.games, 2, dealt=t.dealt)  # games that fill several pages are numbered
    assert "Window" in _plan(cut) and pages.page_box_scores(cut).exceptAll(pages.page_box_scores(here)).count() == 0


def test_lake_tables_of_a_question_only(spark):
    catalog._LAKE_TABLES.clear()
    t = catalog.lake_tables(spark, SF, "games")
    there = next(iter(catalog._LAKE_TABLES.values()))[1]
    assert t.plays is None and t.games.count() > 0 and ("gold", "fact_games") in there
    assert not {("silver", "plays"), ("silver", "teams"), ("gold", "fact_shots")} & there
