"""Functions that need Python, as Arrow-batched UDFs."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from permitflow.functions.bidi import turned


def _turned_text(x: str) -> str:
    return "\n".join(map(turned, x.split("\n")))


@F.pandas_udf(StringType())
def fix_bidi(s: pd.Series) -> pd.Series:
    """Visual to reading order, each line a paragraph of its own."""
    return s.map(_turned_text, na_action="ignore")


def _in_lists(f: Callable[[str], str]) -> Callable[[Column], Column]:
    """``f`` on the texts of a JSON list, as an Arrow function; nulls stay."""

    @F.pandas_udf(StringType())
    def over(s: pd.Series) -> pd.Series:
        return s.map(lambda x: json.dumps([v if v is None else f(v) for v in json.loads(x)]), na_action="ignore")

    return over


def _where(df: DataFrame, f: Callable[[str], str], odd: Callable[[Column], Column], columns: tuple[str, ...]) -> DataFrame:
    """``df`` with ``f`` applied to the values of the named text columns that are ``odd``.

    They go through Python as one list a row, which is null for the rows without any: a row that stays as it is costs its
    tests and one null, however many columns there are. The list travels as text, since the Arrow writer passes over all
    the nulls of a batch again for each null of a list column.
    """
    cols = [F.col(c) for c in columns]
    found = F.when(reduce(or_, map(odd, cols)), F.to_json(F.array(*(F.when(odd(c), c) for c in cols))))
    d = df.withColumn("_changed", F.from_json(_in_lists(f)(found), "array<string>", {"mode": "FAILFAST"}))
    return d.withColumns({c: F.coalesce(F.get("_changed", F.lit(i)), F.col(c)) for i, c in enumerate(columns)}).drop("_changed")


def _beyond_ascii(c: Column) -> Column:
    return F.octet_length(c) > F.length(c)


def reading_order(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the named text columns brought from visual to reading order; ASCII stays as it is."""
    return _where(df, _turned_text, _beyond_ascii, columns)


def compose(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the named text columns in compatibility composition (NFKC). It leaves ASCII and Hebrew letters alone; points
    are put in order where a letter has several."""
    return _where(df, lambda x: unicodedata.normalize("NFKC", x), lambda c: _beyond_ascii(c) & c.rlike(r"[^\x00-\x7Fא-״]"), columns)


def direction_runs(text: str) -> str:
    """Run lengths of writing directions, e.g. ``R*4 N*3``: R right-to-left, L left-to-right, N number, S space, O other."""
    from itertools import groupby

    name = {"R": "R", "AL": "R", "L": "L", "EN": "N", "AN": "N", "WS": "S", "B": "S", "S": "S"}
    return " ".join(f"{k}*{len(list(g))}" for k, g in groupby(name.get(unicodedata.bidirectional(c), "O") for c in text))


@F.pandas_udf(StringType())
def bidi_runs(s: pd.Series) -> pd.Series:
    return s.map(direction_runs, na_action="ignore")
