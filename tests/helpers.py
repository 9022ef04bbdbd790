"""Helpers that several test modules import."""


def rows(df, *columns):
    """Rows as a sorted list of tuples of the named columns."""
    out = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(out, key=str)
