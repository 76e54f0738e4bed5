"""A fence for costly columns."""

from pyspark.sql import functions as F


def fenced(rows, keep, columns):
    """`rows` with the columns `keep` and new `columns` (name to expression), worked out once a row.

    A filter on a plain projection is pushed below it and holds the whole expression again, in lambdas even once an
    element; a generated row stops that.
    """
    return rows.select(*keep, F.inline(F.array(F.struct(*[column.alias(name) for name, column in columns.items()]))))
