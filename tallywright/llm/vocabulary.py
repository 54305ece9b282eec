"""Frequent-first vocabularies: the bounded head of a counted table of strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many of the most frequent strings are sent to every worker; all others meet
#: their documents in a shuffled join.
HEAD = 1 << 17
#: Longer strings are not sent, however frequent: so the head has at most 32 MB.
HEAD_BYTES = 256


def head_cutoff(counted: DataFrame, head: int = HEAD) -> int:
    """The least frequency (column n) that at most ``head`` rows of ``counted`` reach.

    Frequencies are binned exactly below 1,024 and by 64ths of an octave above, so what
    reaches the driver is at most some 4,500 rows whatever the table holds.
    """
    n = F.col("n")
    octave = F.floor(F.log2(n.cast("double")))
    width = F.pow(F.lit(2.0), octave - 6)
    low = F.when(n < 1024, n).otherwise((F.floor(n / width) * width).cast("long"))
    bins = sorted(((r["low"], r["rows"]) for r in counted.groupBy(low.alias("low")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    taken, cutoff = 0, (bins[0][0] * 2 + 1 if bins else 1)
    for least, rows in bins:
        if taken + rows > head:
            break
        taken, cutoff = taken + rows, least
    return cutoff
