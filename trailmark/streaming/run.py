"""Runs a machine over sessions: sorted groups in batch, keyed state in a stream. Both give the same rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .machines import Machine


def _schema(rows: DataFrame, key: str, machine: Machine) -> str:
    return f"{key} {dict(rows.dtypes)[key]}, {machine.schema}"


def _names(machine: Machine) -> list[str]:
    return [c.split()[0] for c in machine.schema.split(", ")]


def run_batch(rows: DataFrame, key: str, machine: Machine, order: str = "t") -> DataFrame:
    """Rows of every session of a finished table. Sessions are spread by key; one session is sequential by nature and fits a task by length."""

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        state = machine.start()
        out = [o for r in group.sort_values(order, kind="stable").itertuples(index=False) for o in machine.step(state, r)]
        frame = pd.DataFrame(out, columns=_names(machine))
        frame.insert(0, key, group[key].iloc[0])
        return frame

    return rows.select(key, *machine.columns).groupBy(key).applyInPandas(whole, _schema(rows, key, machine))


def run_stream(rows: DataFrame, key: str, machine: Machine, order: str = "t") -> DataFrame:
    """The same over a stream: readings of a micro-batch are sorted within their session, state goes on from batch to batch."""

    def some(name: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else machine.start()
        group = pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable")
        out = [o for r in group.itertuples(index=False) for o in machine.step(held, r)]
        state.update((json.dumps(held),))
        frame = pd.DataFrame(out, columns=_names(machine))
        frame.insert(0, key, name[0])
        yield frame

    return rows.select(key, *machine.columns).groupBy(key).applyInPandasWithState(some, _schema(rows, key, machine), "held string", "append", "NoTimeout")


def latest_fixes(rows: DataFrame, key: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Readings counted by key and event-time window, with a watermark for late ones: the engine's own windows where no machine is needed."""
    return rows.withWatermark("ts", late).groupBy(key, F.window("ts", width)).agg(F.count("*").alias("n"), F.max("value").alias("most"))
