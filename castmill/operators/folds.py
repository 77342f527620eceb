"""Folds over the ordered rows of one run, where each break depends on the one before it: linear passes over arrays in tasks."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(one):
    """A column function that applies one(array, ...) to each row's arrays."""

    @F.pandas_udf("array<int>")
    def fold(*columns: pd.Series) -> pd.Series:
        return pd.Series([one(*row) for row in zip(*columns)])

    return fold


def window_numbers(starts: Column, seconds: float = 1.0) -> Column:
    """For starts in order the number of the window each falls in: a window begins at the first start outside the one before, and lasts `seconds`."""

    def one(starts):
        out, number, anchor = [], -1, None
        for s in starts.tolist():
            if anchor is None or s >= anchor + seconds:
                number, anchor = number + 1, s
            out.append(number)
        return out

    return _fold(one)(starts)


def cue_numbers(sizes: Column, starts: Column, ends: Column, max_chars: int, max_seconds: float) -> Column:
    """For words in order the number of the cue each falls in: a new one before a word that makes it too wide or too long."""

    def one(sizes, starts, ends):
        out, cue, chars, began = [], 0, 0, None
        for n, s, e in zip(sizes.tolist(), starts.tolist(), ends.tolist()):
            if began is None:
                chars, began = n, s
            elif chars + 1 + n > max_chars or e - began > max_seconds:
                cue, chars, began = cue + 1, n, s
            else:
                chars += 1 + n
            out.append(cue)
        return out

    return _fold(one)(sizes, starts, ends)
