"""Results as plain rows, for comparisons in tests."""


def rows(df, *columns):
    """Rows as plain tuples, dates as text, sorted."""
    picked = df.select(*columns) if columns else df
    out = [tuple(str(v) if hasattr(v, "isoformat") else v for v in r) for r in picked.collect()]
    return sorted(out, key=repr)
