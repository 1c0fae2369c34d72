"""Job states kept over a stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from weftarc.operators.jobs import next_state

OUT = "job_id long, seq long, wanted string, accepted boolean, status string"
STATE = "status string, resume_status string"


def _advance(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    status, resume = state.get if state.exists else ("idle", None)
    rows = pd.concat(batches).sort_values("seq")
    out = []
    for seq, wanted in zip(rows["seq"], rows["wanted"], strict=True):
        new = next_state(status, resume, wanted)
        status, resume = new or (status, resume)
        out.append((key[0], seq, wanted, new is not None, status))
    state.update((status, resume))
    yield pd.DataFrame(out, columns=["job_id", "seq", "wanted", "accepted", "status"])


def job_states(events: DataFrame) -> DataFrame:
    """A row for each event of a stream (job_id, seq, wanted): whether it was allowed and the job's state after it.

    Events of a job are taken in the order of seq inside a trigger; triggers come in order.
    """
    return events.groupBy("job_id").applyInPandasWithState(_advance, OUT, STATE, "append", "NoTimeout")
