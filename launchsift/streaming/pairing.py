"""Continuous pairing of the social and chain signals."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from launchsift.functions.constants import PAIR_TIMEOUT_S

PAIRS = "token_address string, social_id string, chain_id string, missing string"
WAITING = "side string, msg_id string, at bigint"


def pair_exact(signals: DataFrame, timeout_s: int = PAIR_TIMEOUT_S, idle_s: float | None = None) -> DataFrame:
    """Consuming pairing in arrival order: at most one waiting signal per token.

    No row is too late.  Two halves pair if their times lie within the timeout, whichever
    arrives first; otherwise the older of them becomes a partial result.  Of two halves of
    the same side the newer one waits on.  A half that meets no partner for ``idle_s``
    seconds by the clock (the timeout, unless given) becomes partial too.  Where rows arrive
    in order this equals the batch form.  A half without token or time can meet no partner and
    becomes partial at once; rows of neither side are left out.
    """
    limit = timeout_s * 1_000_000
    idle_ms = int(1000 * (timeout_s if idle_s is None else idle_s))

    def half(token: str, side: str, msg_id: str) -> tuple:
        if side == "social":
            return token, msg_id, None, "chain"
        return token, None, msg_id, "social"

    def step(
        key: Any, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        token, out = key[0], []
        waiting = state.get if state.exists else None
        if key[1] is not None:
            out = [half(token, *row) for part in batches for row in zip(part["side"], part["msg_id"])]
        elif state.hasTimedOut:
            out.append(half(token, waiting[0], waiting[1]))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["at", "msg_id"])
            for new in zip(rows["side"], rows["msg_id"], rows["at"].astype(int)):
                if waiting is None:
                    waiting = new
                elif abs(new[2] - waiting[2]) > limit:
                    older, waiting = sorted((waiting, new), key=lambda s: s[2])
                    out.append(half(token, older[0], older[1]))
                elif waiting[0] == new[0]:
                    waiting = max(waiting, new, key=lambda s: (s[2], s[1]))
                else:
                    named = dict([waiting[:2], new[:2]])
                    out.append((token, named["social"], named["chain"], None))
                    waiting = None
            if waiting is not None:
                state.update((waiting[0], waiting[1], int(waiting[2])))
                state.setTimeoutDuration(idle_ms)
            elif state.exists:
                state.remove()
        yield pd.DataFrame(
            out, columns=["token_address", "social_id", "chain_id", "missing"], dtype="object"
        )

    return (
        signals.filter(F.col("side").isin("social", "chain"))
        .select(
            "token_address", "side", "msg_id",
            F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("at"),
            # Alone under its own id: no state is kept for it.
            F.when(F.col("token_address").isNull() | F.col("ts").isNull(), F.coalesce("msg_id", F.lit(""))).alias("alone"),
        )
        .groupBy("token_address", "alone")
        .applyInPandasWithState(
            step, PAIRS, WAITING, "append", GroupStateTimeout.ProcessingTimeTimeout
        )
    )
