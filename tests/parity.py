"""Comparing a query with its SQL."""


def plain(v):
    """A value as it is compared."""
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    return v if v is None or isinstance(v, (str, int, bool)) else None if str(v) in ("<NA>", "NaT") else v


def rows_of(frame):
    cols = sorted(frame.columns)
    return sorted((tuple(map(plain, r)) for r in frame[cols].itertuples(index=False, name=None)), key=repr)


def agree(name, module, spark, folder, con):
    """Asserts that a query and its SQL give the same rows."""
    ours = module.queries()[name](spark, folder).toPandas()
    theirs = con.execute(module.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)
