"""Plug-in surfaces: model sources, agents, simulators, judges."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.functions.text import simulated_reply


class ModelSource(Protocol):
    """Prompts in, raw outputs out (sources.readers.MODEL_OUTPUTS). The engine has none that uses a network."""

    def complete(self, prompts: DataFrame) -> DataFrame: ...


class RecordedSource:
    """Answers from a table of recorded outputs."""

    def __init__(self, outputs: DataFrame):
        self.outputs = outputs

    def complete(self, prompts: DataFrame) -> DataFrame:
        return prompts.select("instance_id", "attempt_id", "step").join(self.outputs, ["instance_id", "attempt_id", "step"], "left")


AGENT_RESULT = "task_id string, patch string, trace array<struct<event_id: int, actor: string, event_type: string, content: string>>"


def run_agent(tasks: DataFrame, run: Callable[[str, str], tuple[str, list[tuple[int, str, str, str]]]]) -> DataFrame:
    """An agent as run(task_id, repo) -> (patch, events), over batches of tasks."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(t, *run(t, r)) for t, r in zip(frame["task_id"], frame["repo"])]
            yield pd.DataFrame(rows, columns=["task_id", "patch", "trace"])

    return tasks.select("task_id", "repo").mapInPandas(batches, AGENT_RESULT)


def stub_agent(task_id: str, repo: str) -> tuple[str, list[tuple[int, str, str, str]]]:
    """An agent that changes nothing."""
    return "", [(1, "agent", "message", f"No changes for {task_id}.")]


def simulated_user(turns: DataFrame, problem: str = "hidden_problem_statement", message: str = "agent_message") -> DataFrame:
    return turns.withColumn("reply", simulated_reply(F.col(problem), F.col(message)))


def judged(df: DataFrame, judges: Mapping[str, Callable[[DataFrame], Column] | None]) -> DataFrame:
    """Adds a score for each judge; null where none is set."""
    return df.withColumns({name: F.lit(None).cast("double") if judge is None else judge(df) for name, judge in judges.items()})
