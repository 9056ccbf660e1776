"""Plain functions for the tests; fixtures stand in conftest.py."""


def rows(df, *cols):
    """Result rows as a sorted list of tuples."""
    df = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in df.collect()), key=repr)
