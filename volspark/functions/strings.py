"""Text, path and time helpers as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokenize(s: Column, delimiters: str) -> Column:
    """Non-empty parts between any of the delimiter characters."""
    return F.filter(F.split(s, "[" + re.escape(delimiters) + "]"), lambda t: t != "")


def path_extension(s: Column) -> Column:
    """What follows the last dot of the last path component, or an empty string."""
    name = F.substring_index(s, "/", -1)
    return F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise("")


def strip_extension(s: Column) -> Column:
    e = path_extension(s)
    return F.when(e == "", s).otherwise(F.left(s, F.length(s) - F.length(e) - 1))


def force_extension(s: Column, extension: str) -> Column:
    return F.when(path_extension(s) == extension, s).otherwise(F.concat(s, F.lit("." + extension)))


def split_name(s: Column) -> Column:
    """struct(path, base, ext); the path ends with its slash."""
    name = F.substring_index(s, "/", -1)
    ext = path_extension(s)
    base = F.when(ext == "", name).otherwise(F.left(name, F.length(name) - F.length(ext) - 1))
    return F.struct(F.left(s, F.length(s) - F.length(name)).alias("path"), base.alias("base"), ext.alias("ext"))
