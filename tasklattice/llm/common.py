"""What the operators of this package share."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklattice.sources.tables import table


def ads(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The ads with the asked columns; rows of an ad delivered again included."""
    return table(spark, folder, "job_postings_unified").select("uid", *columns)


def filled(column: str) -> Column:
    """Not null and not only white space (of any script)."""
    return F.col(column).rlike(r"(?U)\S")


def bounded_sample(rows: DataFrame, n: int, key: str, total: int) -> list:
    """At most ``n`` rows, by the least hash of ``key``, on the driver. ``total``
    is about how many rows there are: all but some 1.5 n of them are filtered out
    by their hash where they lie, so that what is sent does not grow with the
    number of partitions."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    share = min(1.0, 1.5 * n / max(1, total))
    return rows.filter(place < F.lit(int(share * (1 << 30)) + 1)).orderBy(place, key).limit(n).collect()


def fold(text: str) -> str:
    """Lower case without accents and invisible characters."""
    t = unicodedata.normalize("NFKD", text).casefold()
    return "".join(ch for ch in t if unicodedata.category(ch) not in ("Mn", "Cf"))


INVISIBLE = re.compile("[­​-‏⁠﻿]")
