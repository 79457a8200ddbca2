"""Numbers by picture: grouping, optional and required digits, percent and per mille, prefix and suffix."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_number(value: Column, picture: str) -> Column:
    """The picture is read once, when the plan is made; what is left is plain column functions.

    ``#`` is an optional digit, ``0`` a required one, ``,`` groups, ``.`` is the point, ``;`` parts the pictures of
    positive and negative numbers, ``%`` and ``‰`` scale.
    """
    positive, _, negative = picture.partition(";")
    shown = _part(F.abs(value.cast("double")), positive)
    minus = _part(F.abs(value.cast("double")), negative) if negative else F.concat(F.lit("-"), shown)
    return F.when(value < 0, minus).otherwise(shown)


def _part(value: Column, picture: str) -> Column:
    m = re.fullmatch(r"([^#0.,]*)([#0,]*)(?:\.([#0]*))?([^#0.,]*)", picture)
    if not m or not (m[2] or m[3]):
        raise ValueError(f"not a number picture: {picture!r}")
    prefix, whole, part, suffix = m[1], m[2], m[3] or "", m[4]
    scale = 100 if "%" in prefix + suffix else 1000 if "‰" in prefix + suffix else 1
    digits, least = len(part), part.count("0")
    rounded = F.bround((value * scale).cast("decimal(38,10)"), digits).cast(f"decimal(38,{digits})").cast("string")
    left = F.regexp_replace(F.split_part(rounded, F.lit("."), F.lit(1)), "^0+", "")
    required = whole.replace(",", "").count("0")
    left = F.when(F.length(left) < required, F.lpad(left, required, "0")).otherwise(left)
    if "," in whole:
        size = len(whole) - whole.rindex(",") - 1
        left = F.regexp_replace(left, rf"(?<=\d)(?=(\d{{{size}}})+$)", ",")
    right = F.split_part(rounded, F.lit("."), F.lit(2)) if digits else F.lit("")
    if digits > least:
        right = F.regexp_replace(right, f"0{{1,{digits - least}}}$", "")
    return F.concat(F.lit(prefix), left, F.when(right == "", F.lit("")).otherwise(F.concat(F.lit("."), right)), F.lit(suffix))
