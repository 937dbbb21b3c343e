"""Name search over the inverted index: the rows of the plain search."""
import tempfile

import pytest

from courtside.plans import compare as C
from courtside.plans import nameindex as N

NAMES = [("IBÁÑEZ, LEÓN", "Ñandú Club"), ("Ibanez, Leo", "Real"), ("O'Neil, Zoë", "IBA Team"), (None, "Real"), ("", None),
         ("aaa", "AAAA"), ("日本", "Real"), ("Straße, Jürgen", "C. B. Ñ"), ("ibaibañez", "x"), ("zez bañ ibá", "y")]


@pytest.fixture(scope="module")
def pool(spark):
    rows = [("L", 2020 + i % 2, n, t, f"s{i % 7}", float(i * 7 % 5)) for i, (n, t) in enumerate(NAMES * 2)]
    return spark.createDataFrame(rows, "competition string, season int, player_name string, team string, slug string, avg_val double")


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def root(pool):
    path = tempfile.mkdtemp(prefix="cs-names-")
    counts = N.build(pool, path)
    assert counts["names"] == len({x or "" for pair in NAMES for x in pair}) and counts["grams"] > 50
    return path


@pytest.mark.parametrize("text", ["ibañez", " IBA ", "ib", "日本", "a日", "aaaa", "zoe", "zz", "x", "", "c. b.", "bañez ", "strae", "o'n"])
def test_same_rows_as_the_plain_search(pool, root, text):
    assert _rows(N.search(pool, root, text, limit=50)) == _rows(C.search(pool, text, limit=50))


def test_excluded_and_limited(pool, root):
    got = N.search(pool, root, "real", exclude=["s1"], limit=2)
    assert _rows(got) == _rows(C.search(pool, "real", exclude=["s1"], limit=2)) and 0 < got.count() <= 4


def test_pool_is_not_folded_and_grams_are_pushed_down(spark, pool, root):
    plan = N.search(pool, root, "ibañez")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [" in plan and "translate(" not in plan


def test_empty(spark, pool):
    path = tempfile.mkdtemp(prefix="cs-names-")
    assert N.build(pool.limit(0), path) == {"names": 0, "grams": 0}
    assert N.search(pool.limit(0), path, "abc").count() == 0
