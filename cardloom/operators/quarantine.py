"""Quarantine: good rows and rejected rows of a table, told apart in one pass, with counters."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.scratch import cut

#: Counter of all rows; those of the rules have their names.
SEEN = "seen"


@dataclass
class Split:
    """``good`` has the columns of the table, ``rejected`` those and ``reason``; ``counts`` has the rows of each rule and of all."""

    good: DataFrame
    rejected: DataFrame
    counts: dict[str, int]


def reason(rules: Mapping[str, Column]) -> Column:
    """The name of the first rule that a row breaks, in their order, or NULL. A rule that is NULL counts as broken."""
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return F.coalesce(*broken) if broken else F.lit(None).cast("string")


def split(rows: DataFrame, rules: Mapping[str, Column], name: str = "quarantine") -> Split:
    """Write ``rows`` once, good and rejected ones apart, and count them on the way.

    The counters are taken while the rows are written (``observe``), so nothing is read twice; each side is then read
    from its own folder. Rows may have any columns but ``cardloom_reason``; an empty table has counters of 0.
    """
    if SEEN in rules:
        raise ValueError(f"no rule may be called {SEEN!r}")
    mark, apart = "cardloom_reason", "cardloom_rejected"
    seen = Observation(name)
    counters = [F.count("*").alias(SEEN), *[F.count(F.when(F.col(mark) == r, 1)).alias(r) for r in rules]]
    marked = rows.withColumn(mark, reason(rules)).observe(seen, *counters)
    table = cut(marked.withColumn(apart, F.col(mark).isNotNull().cast("int")), name, partition_by=[apart])
    own = [f"`{c}`" for c in rows.columns]
    counts = {k: int(v) for k, v in seen.get.items()}
    return Split(table.where(f"{apart} = 0").select(*own), table.where(f"{apart} = 1").select(*own, F.col(mark).alias("reason")), counts)
