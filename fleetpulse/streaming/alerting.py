"""Live alerting: confirmation, recovery and suppression with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetpulse.operators.alerts import evaluate_alerts

_STATE = T.StructType(
    [
        T.StructField("last_step", T.LongType()),
        T.StructField("breached_run", T.LongType()),
        T.StructField("calm_run", T.LongType()),
        T.StructField("alerting", T.LongType()),
        T.StructField("last_fired", T.LongType()),
    ]
)
_NEVER = -(2**62)
_EMITTED = T.StructType(
    [
        T.StructField("machine_id", T.StringType()),
        T.StructField("eval_us", T.LongType()),
        T.StructField("max_score", T.DoubleType()),
        T.StructField("confirmed", T.BooleanType()),
        T.StructField("recovered", T.BooleanType()),
        T.StructField("fired", T.BooleanType()),
    ]
)


class AlertProcessor(StatefulProcessor):
    """Five numbers per machine: the last evaluation, two run lengths, whether an alert
    is open, and when one last fired."""

    def __init__(self, slide_us: int, quiet_us: int, confirm_n: int, recover_n: int):
        self._slide, self._quiet = slide_us, quiet_us
        self._confirm_n, self._recover_n = confirm_n, recover_n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("alert", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self._state.get() if self._state.exists() else (_NEVER, 0, 0, 0, _NEVER)
        step, breached_run, calm_run, alerting, last_fired = stored
        emitted = []
        for at, score, breached in (
            pd.concat(list(rows))
            .sort_values("eval_us")[["eval_us", "max_score", "breached"]]
            .itertuples(index=False)
        ):
            adjacent = at // self._slide == step + 1
            breached_run = (breached_run if adjacent else 0) + 1 if breached else 0
            calm_run = 0 if breached else (calm_run if adjacent else 0) + 1
            confirmed = breached_run >= self._confirm_n
            recovered = bool(alerting) and calm_run >= self._recover_n
            fired = confirmed and at >= last_fired + self._quiet
            alerting = 1 if confirmed else 0 if recovered else alerting
            last_fired = at if fired else last_fired
            step = at // self._slide
            emitted.append((key[0], at, score, confirmed, recovered, fired))
        self._state.update((step, breached_run, calm_run, alerting, last_fired))
        yield pd.DataFrame(emitted, columns=_EMITTED.fieldNames())

    def close(self) -> None:
        pass


def alert_stream(
    predictions: DataFrame,
    window: str = "2 minutes",
    slide: str = "1 minute",
    slide_seconds: int = 60,
    level: float = 0.8,
    quiet_minutes: float = 10,
    confirm_n: int = 2,
    recover_n: int = 3,
    watermark: str = "2 minutes",
) -> DataFrame:
    """Final evaluations of a prediction stream with ``confirmed``, ``recovered``, ``fired``."""
    evaluated = evaluate_alerts(
        predictions.withWatermark("window_end", watermark), window, slide, level
    )
    processor = AlertProcessor(
        slide_seconds * 1_000_000, round(quiet_minutes * 60_000_000), confirm_n, recover_n
    )
    return (
        evaluated.withColumn("eval_us", F.unix_micros("eval_at"))
        .groupBy("machine_id")
        .transformWithStateInPandas(
            statefulProcessor=processor,
            outputStructType=_EMITTED,
            outputMode="Append",
            timeMode="None",
        )
        .withColumn("eval_at", F.timestamp_micros("eval_us"))
        .drop("eval_us")
    )
