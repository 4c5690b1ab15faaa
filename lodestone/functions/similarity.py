"""Similarity of short texts: word overlap, containment, and the matching-blocks ratio.

The ratio is asymmetric and treats very frequent characters of long second texts apart, as Python's
difflib defines it; the order of arguments matters. It is the only part that has no native form, and it is asked for only
where bounds say that it may decide: ratio <= 2 * min(la, lb) / (la + lb).
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import either_contains, word_overlap, words

CONTAINED = 0.8


@F.pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """SequenceMatcher(None, a, b).ratio(); null where either is null."""
    matcher, last, out = SequenceMatcher(None), None, []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        if y != last:
            matcher.set_seq2(y)  # the second text is the one that is analysed once and kept
            last = y
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def native_score(a: Column, b: Column, containment: bool) -> Column:
    """The similarity of normal() texts without the ratio."""
    score = word_overlap(words(a), words(b))
    if containment:
        score = F.greatest(score, F.when(either_contains(a, b), F.lit(CONTAINED)).otherwise(F.lit(0.0)))
    return F.when(a == b, F.lit(1.0)).otherwise(score)
