import duckdb
import pytest


@pytest.fixture
def oracle():
    """Rows of DuckDB SQL over pandas tables, as sorted tuples in the order of the sorted column names."""

    def run(sql, **tables):
        con = duckdb.connect()
        for name, df in tables.items():
            con.register(name, df)
        return rows(con.sql(sql).df())

    return run


def rows(df):
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return sorted((tuple(None if v is None else int(v) if hasattr(v, "is_integer") and v == int(v) else v for v in r)
                   for r in df.itertuples(index=False)), key=str)
