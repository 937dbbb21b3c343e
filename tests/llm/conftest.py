import pytest


@pytest.fixture(scope="session")
def llm_spark():
    from courtside.session import get_session
    s = get_session("local[4]", shuffle_partitions=4)
    yield s


@pytest.fixture
def oracle():
    """Run DuckDB SQL over Arrow/pandas tables given by name; sorted rows by column name."""
    import duckdb

    def run(sql, **tables):
        c = duckdb.connect()
        for name, t in tables.items():
            c.register(name, t)
        cur = c.execute(sql)
        names = [d[0] for d in cur.description]
        order = sorted(range(len(names)), key=lambda i: names[i])
        return sorted(repr(tuple(r[i] for i in order)) for r in cur.fetchall())
    return run


def rows_of(df):
    """Collected rows, columns by name, as sorted strings."""
    cols = sorted(df.columns)
    return sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
