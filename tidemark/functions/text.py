"""Token lists, parsed vectors and the buckets of hashed term frequencies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Buckets of hashed term frequencies: the first two hexadecimal digits of a token's MD5.
BUCKETS = 256


def tokens(text: Column) -> Column:
    """The runs of a text between white space."""
    return F.filter(F.split(text, "[ \\t\\n\\r\\x0B\\f]+"), lambda x: x != "")


def parse_floats(line: Column) -> Column:
    """The numbers of a comma-separated line; cells that are none are dropped."""
    return F.filter(F.transform(F.split(line, ","), lambda x: x.try_cast("float")), lambda x: x.isNotNull())


def bucket(token: Column) -> Column:
    return F.conv(F.substring(F.md5(token), 1, 2), 16, 10).cast("int")
