"""Interfaces to what lies outside: model calls, recognition, rendering, embedding.

A provider is a function from a value to a value. It runs on the executors through ``apply``, made
once a Python worker by its factory, and an error is a value in a column rather than a lost row. The
stand-ins below are deterministic and for tests; nothing they return says anything about quality.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Factory = Callable[[], Callable[[object], object]]

_MADE: dict[int, Callable] = {}


def apply(rows: DataFrame, column: str, factory: Factory, result: str, kind: str) -> DataFrame:
    """``rows`` with ``result`` (of a Spark type) and ``error``: null where the provider gave a result.

    A null or blank value is not sent, and has neither.
    """

    @F.pandas_udf(f"result {kind}, error string")
    def call(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        provider = factory()
        for part in values:
            out: list[tuple[object, str | None]] = []
            for value in part:
                try:
                    blank = value is None or isinstance(value, str) and not value.strip()
                    out.append((None if blank else provider(value), None))
                except Exception as error:  # noqa: BLE001  a row's error is its result
                    out.append((None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["result", "error"])

    called = rows.withColumn("__call", call(F.col(column)))
    return called.withColumns({result: F.col("__call.result"), "error": F.col("__call.error")}).drop("__call")


def patient(factory: Factory, tries: int = 3, seconds: float = 180.0, pause: float = 0.0) -> Factory:
    """``factory``, whose provider is asked up to ``tries`` times, each time for at most ``seconds``; the last error counts.

    A call that takes longer is given up; its thread ends when the call does.
    """

    def patient_factory():
        provider = factory()

        def ask(value: object) -> object:
            for left in reversed(range(tries)):
                pool = ThreadPoolExecutor(1)
                try:
                    return pool.submit(provider, value).result(timeout=seconds)
                except Exception:  # noqa: BLE001  asked again, whatever went wrong
                    if not left:
                        raise
                    time.sleep(pause)
                finally:
                    pool.shutdown(wait=False)
            raise ValueError("tries is at least 1")

        return ask

    return patient_factory


def timed(action: Callable[[], object]) -> tuple[object, float]:
    """The result of an action on the driver, and the seconds it took, to 2 digits."""
    began = time.perf_counter()
    result = action()
    return result, round(time.perf_counter() - began, 2)


def normal_vector(vector: Column) -> Column:
    """A vector divided by its length; null for null, and as it is if its length is 0."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x))
    return F.when(length > 0, F.transform(vector, lambda x: x / length)).otherwise(vector)


def stand_in_embedder(dims: int = 16) -> Factory:
    """Unit vectors made from a hash of the text."""

    def factory():
        def embed(value: object) -> list[float]:
            seed = int.from_bytes(hashlib.sha256(str(value).encode()).digest()[:8], "big")
            vector = np.random.default_rng(seed).normal(size=dims)
            return (vector / np.linalg.norm(vector)).tolist()

        return embed

    return factory


def stand_in_model(answer: str = "described: {}") -> Factory:
    def factory():
        def describe(value: object) -> str:
            if str(value).startswith("fail"):
                raise ValueError("the stand-in was told to fail")
            return answer.format(str(value)[:40])

        return describe

    return factory


def ask_agents(rows: DataFrame, key: str, column: str, agents: dict[str, Factory]) -> DataFrame:
    """One answer of every agent on each row, as a map from agent to answer; agents are few and stated."""
    out = rows.select(key, column)
    for i, factory in enumerate(agents.values()):
        out = apply(out, column, factory, f"__a{i}", "string").drop("error")
    pairs = [x for i, name in enumerate(agents) for x in (F.lit(name), F.col(f"__a{i}"))]
    return out.select(key, F.create_map(*pairs).alias("answers"))
