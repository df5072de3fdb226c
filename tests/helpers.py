"""Comparison of results with plain Python ones."""


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def same_rows(df, expected, *columns):
    assert rows(df, *columns) == sorted((tuple(r) for r in expected), key=repr)
