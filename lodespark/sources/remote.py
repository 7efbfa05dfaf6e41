"""Calls to a model, local or remote, behind one injected function, on Arrow batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class RateLimited(Exception):
    """Raised by a client when it has to wait."""


def with_retries(call: Callable, clients: list, waits: tuple[float, ...] = (0.2, 0.5, 1.2)) -> Callable:
    """call(client, row) with clients in turn; after RateLimited the next one, after a pause."""
    turn = iter(range(10**12))

    def run(row):
        for wait in (*waits, None):
            try:
                return call(clients[next(turn) % len(clients)], row)
            except RateLimited:
                if wait is None:
                    raise
                time.sleep(wait)

    return run


def call_model(df: DataFrame, make: Callable[[], Callable[[dict], dict]], columns: str, threads: int = 30, partitions: int | None = None) -> DataFrame:
    """df with the columns that the model gives for each row, and error: its exception's text, with NULL columns.

    make builds the row function once for each task, so clients and models needn't be pickled. Rows of a batch are
    called by threads at a time. The order of rows is kept within a task."""
    names = T.StructType.fromDDL(columns).names
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()

        def one(row: dict) -> dict:
            try:
                return {**dict.fromkeys(names), **model(row), "error": None}
            except Exception as e:  # noqa: BLE001 - a failed row is a result
                return {**dict.fromkeys(names), "error": f"{type(e).__name__}: {e}"}

        with ThreadPoolExecutor(threads) as pool:
            for b in batches:
                out = pd.DataFrame(list(pool.map(one, b.to_dict("records"))), columns=[*names, "error"], index=b.index, dtype=object)
                yield pd.concat([b, out], axis=1)

    source = df.repartition(partitions) if partitions else df
    return source.mapInPandas(run, f"{fields}, {columns}, error string")


def offline_model(vocabulary: int = 16) -> Callable[[], Callable[[dict], dict]]:
    """A deterministic stand-in for a model: logits, a marked answer and thinking from a hash of the prompt."""

    def make():
        import hashlib

        def model(row: dict) -> dict:
            h = hashlib.sha256(str(row["prompt"]).encode()).digest()
            logits = [b / 32 for b in h[:vocabulary]]
            letter = chr(97 + h[16] % 5)
            return {"logits": logits, "response": f"Reasoned {h[17]}. [[{letter}]]", "thinking": f"t{h[18]}"}

        return model

    return make
