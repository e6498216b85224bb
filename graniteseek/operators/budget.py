"""Token budgets and quotas over ranked rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fresh
from ..functions.tokenizers import resolved, tokenizer_for, truncate


def within_budget(rows: DataFrame, pool: list[str], rank: str, budget: int, text: str = "text", tokens: str = "tokens", tokenizer: str | None = None) -> DataFrame:
    """The ranked prefix whose tokens fit the budget, with `truncated`.

    The first row that overflows ends it, whatever follows.  If even the first overflows, it is kept cut to the
    budget.  tokenizer: a vocabulary file that executors have; characters without one.
    """
    vocabulary = resolved(tokenizer)

    @F.pandas_udf("string")
    def cut_by_tokens(texts: pd.Series) -> pd.Series:
        coder = tokenizer_for(vocabulary)
        return texts.map(lambda t: truncate(t, budget, coder))

    running, place = fresh(rows, "running", "place")
    w = Window.partitionBy(*pool).orderBy(rank)
    marked = rows.withColumns({running: F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0)), place: F.row_number().over(w)})
    marked = marked.filter((F.col(running) <= budget) | (F.col(place) == 1))
    over = F.col(running) > budget
    short = cut_by_tokens(F.col(text)) if vocabulary else F.substring(F.col(text), 1, budget)
    out = marked.withColumns({text: F.when(over, short).otherwise(F.col(text)), tokens: F.when(over, F.lit(budget)).otherwise(F.col(tokens)), "truncated": over})
    return out.drop(running, place)


def first_per_source(rows: DataFrame, pool: list[str], source: str, rank: str, most: int) -> DataFrame:
    """The first `most` rows of each source in a pool: the quota pass when nothing is dropped as similar."""
    name, = fresh(rows, "place")
    place = F.row_number().over(Window.partitionBy(*pool, source).orderBy(rank))
    return rows.withColumn(name, place).filter(F.col(name) <= most).drop(name)
