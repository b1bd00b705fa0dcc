"""A streaming form of the event log (an addition: the batch operators are what evaluation needs).

Sequence numbers continue for each case over micro-batches, and steps that the state machine doesn't
have are marked; the state of a case is its last number and state.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import can_transition
from ..session import importable_by_workers

OUT = "case_id string, event_id string, seq long, state string, legal boolean"


def _step(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
    seq, last = kept.get if kept.exists else (-1, None)
    rows = []
    for event in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
        seq += 1
        rows.append((key[0], event.event_id, seq, event.state, last is None or can_transition(last, event.state)))
        last = event.state
    kept.update((seq, last))
    yield pd.DataFrame(rows, columns=["case_id", "event_id", "seq", "state", "legal"])


def sequenced(events: DataFrame) -> DataFrame:
    """events (case_id, event_id, ts, state), a stream, with seq and whether the step is legal."""
    importable_by_workers(events.sparkSession)
    return events.groupBy("case_id").applyInPandasWithState(_step, OUT, "seq long, last string", "append", GroupStateTimeout.NoTimeout)
