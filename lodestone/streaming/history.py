"""Stable texts of a stream of runs: the last runs of each domain are kept as state.

An exact-key form of operators.reconcile.stable; state is bounded by the kept runs of a domain.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import normal
from ..params import Reconcile

OUTPUT = "domain string, run_seq long, norm string, appearances int, total_runs int, stability double"
STATE = "runs array<struct<run_seq:long,norms:array<string>>>"


def stable_stream(runs: DataFrame, params: Reconcile = Reconcile()) -> DataFrame:
    """After each batch, the stable texts of the domains that it touched. runs: domain, run_seq, text."""
    kept = params.recent_runs

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {r[0]: list(r[1]) for r in (state.get[0] if state.exists else [])}
        for frame in frames:
            for seq, norm in zip(frame.run_seq, frame.norm, strict=True):
                held.setdefault(int(seq), []).append(norm)
        last = sorted(held)[-kept:]
        state.update(([(s, held[s]) for s in last],))
        counts = pd.Series([n for s in last for n in held[s]], dtype="object").value_counts()
        least = max(2, int(0.6 * len(last)))
        good = counts[counts >= least] if len(last) > 1 else counts[:0]
        yield pd.DataFrame({"domain": key[0], "run_seq": last[-1], "norm": list(good.index), "appearances": good.to_numpy(), "total_runs": len(last), "stability": good.to_numpy() / len(last)})

    keyed = runs.select("domain", "run_seq", normal(F.col("text")).alias("norm"))
    return keyed.groupBy("domain").applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
