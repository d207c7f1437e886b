"""User code over jobs (D1 to D7): processors for single jobs and for batches, with what wraps them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

Processor = Callable[[dict], Any]
Middleware = Callable[[dict, Callable[[dict], Any]], Any]


def wrapped(process: Processor, layers: list[Middleware]) -> Processor:
    """The first layer is outermost; each calls the next or not."""
    return reduce(lambda inner, layer: lambda job: layer(job, inner), reversed(layers), process)


def process_each(
    jobs: DataFrame, process: Processor, tries: int = 1, retry_if: Callable[[Exception], bool] | None = None
) -> DataFrame:
    """Id, result and error of each job; user code runs in Spark's Python workers, a job at a time.

    A failing job is tried again so many times in all, if retry_if says so; its last error is reported, not raised.
    """

    def one(job: dict) -> tuple[str | None, str | None]:
        error = None
        for _ in range(tries):
            try:
                return str(process(job)), None
            except Exception as e:  # noqa: BLE001  user code may raise anything
                error = str(e)
                if retry_if is not None and not retry_if(e):
                    break
        return None, error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [one(job) for job in frame.to_dict("records")]
            yield pd.DataFrame({"id": frame["id"], "result": [r for r, _ in done], "error": [e for _, e in done]})

    return jobs.mapInPandas(run, "id string, result string, error string")


def process_batches(jobs: DataFrame, process: Callable[[list[dict]], list], size: int) -> DataFrame:
    """Id and result; user code sees batches of at most so many jobs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size]
                yield pd.DataFrame({"id": part["id"], "result": [str(r) for r in process(part.to_dict("records"))]})

    return jobs.mapInPandas(run, "id string, result string")
