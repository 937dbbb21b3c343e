"""Rules that a planted fault breaks."""
from dataclasses import replace

from pyspark.sql import functions as F

from courtside.plans import quality


def test_zone_and_group_rules_can_fail(t):
    seen = lambda x: {r.rule: r.violations for r in quality.check(x).collect()}
    # Every third shot lies in no zone; one competition's games all lie in group A, one of them in B too.
    shots = t.shots.withColumn("zone", F.when(F.col("x") % 3 != 0, F.col("zone")))
    comp, season, game = t.games.orderBy("game_id").select("competition", "season", "game_id").first()
    here = (F.col("competition") == comp) & (F.col("season") == season)
    games = t.games.withColumn("grp", F.when(here, "A").otherwise(F.col("grp")))
    games = games.unionByName(games.where(F.col("game_id") == game).withColumn("grp", F.lit("B")))
    got = seen(replace(t, shots=shots, games=games))
    assert got["q07_zone_attempts_vs_shots"] > 0 and got["q09_group_does_not_shrink"] == 1
    clean = seen(t)
    assert len(clean) == 21 and clean["q07_zone_attempts_vs_shots"] == clean["q09_group_does_not_shrink"] == 0
