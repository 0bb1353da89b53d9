"""Test input and the comparison of both engines' rows."""

import os
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def rows_of(columns, rows):
    """Rows as sorted tuples with columns in name order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same(spark_df, duck_rel):
    """The row count, after it is asserted that both sides have the same columns and rows."""
    a = rows_of(spark_df.columns, map(tuple, spark_df.collect()))
    b = rows_of([x[0] for x in duck_rel.description], duck_rel.fetchall())
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    assert a[1] == b[1]
    return len(a[1])
