"""Text expressions for dimension values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """The value without leading and trailing Unicode whitespace."""
    return F.btrim(col, F.lit(WHITESPACE))


def is_option(col: Column) -> Column:
    """True where the raw value is one of the options offered for its column.

    Options are the trimmed values and rows are matched by their raw value, so
    "All" keeps exactly the rows whose value is present and already trimmed. The
    test looks at the row alone: no option list is built.
    """
    return col == strip(col)
