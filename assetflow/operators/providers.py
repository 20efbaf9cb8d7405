"""Models behind a name, run over a DataFrame with retries and a fallback."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: A factory takes options and gives what maps one input text to its result, raising where it fails.
Model = Callable[[str], object]
FACTORIES: dict[str, Callable[..., Model]] = {}

# The waits in front of a retry after too many requests.
WAIT_SECONDS, RATE_ATTEMPTS = 3, 6


def register(name: str) -> Callable:
    def add(factory: Callable[..., Model]) -> Callable[..., Model]:
        FACTORIES[name] = factory
        return factory

    return add


def factory(name: str) -> Callable[..., Model]:
    if name not in FACTORIES:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(FACTORIES))}")
    return FACTORIES[name]


def run(rows: DataFrame, column: str, names: list[str], kind: str = "string", options: dict | None = None, check: Callable[[object], str | None] | None = None, retries: int = 2) -> DataFrame:
    """rows with result, status (ok or failed), error and attempts of the named providers.

    Each row goes to the first provider, up to retries more times where it raises or check names an
    error, then to the next.  A provider is made once a partition; the number of partitions bounds how
    many run at a time.  A row that no provider serves keeps the last error and a null result.  The
    error of a row never ends the batch.
    """
    makers = [factory(n) for n in names]
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(f"result {kind}, status string, error string, attempts int").fields])

    def attempt(models: list[Model], text: str | None) -> tuple:
        error, n = "", 0
        for model in models:
            for _ in range(retries + 1):
                n += 1
                try:
                    result = model(text)
                    error = (check(result) if check else None) or ""
                except Exception as e:  # noqa: BLE001 - whatever a provider raises is the row's error
                    error = str(e) or type(e).__name__
                if not error:
                    return result, "ok", None, n
        return None, "failed", error, n

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = [make(**(options or {})) for make in makers]
        for batch in batches:
            got = [attempt(models, t) for t in batch[column]]
            yield batch.assign(**{n: pd.Series([g[i] for g in got], index=batch.index, dtype=object if i < 3 else "int32") for i, n in enumerate(("result", "status", "error", "attempts"))})

    return rows.mapInPandas(each, schema)


def patient(model: Model, wait: float = WAIT_SECONDS) -> Model:
    """The model, waiting and trying again only where it reports too many requests."""
    def call(text: str) -> object:
        for n in range(1, RATE_ATTEMPTS + 1):
            try:
                return model(text)
            except Exception as e:  # noqa: BLE001
                if n == RATE_ATTEMPTS or not any(s in str(e).lower() for s in ("429", "rate limit", "too many requests")):
                    raise
                time.sleep(wait * 2 ** (n - 1) + random.random() * wait / 3)
        raise AssertionError

    return call


@register("template")
def template(prefix: str = "") -> Model:
    """Puts a prefix in front of a text; blank texts are an error."""
    def call(text: str) -> str:
        if not text or not text.strip():
            raise ValueError("blank input")
        return prefix + text

    return call


@register("short_only")
def short_only(prefix: str = "", most: int = 20) -> Model:
    """As template, for texts of up to so many characters."""
    inner = template(prefix)

    def call(text: str) -> str:
        if text and len(text) > most:
            raise ValueError("input too long")
        return inner(text)

    return call


@register("busy")
def busy(prefix: str = "", wait: float = WAIT_SECONDS) -> Model:
    """As template behind patient(), for a service that refuses a text's first calls, as many as its length modulo 8."""
    inner = template(prefix)

    def call(text: str) -> str:
        refused = [True] * (len(text or "") % 8)

        def once(t: str) -> str:
            if refused:
                refused.pop()
                raise RuntimeError("HTTP 429: too many requests")
            return inner(t)

        return patient(once, wait)(text)

    return call


@register("echo")
def echo() -> Model:
    """The text itself."""
    return lambda text: text


@register("two_lines")
def two_lines() -> Model:
    """A description of the right form, whatever the text; a text whose length 5 divides comes back as it is."""
    return lambda text: text if len(text or "") % 5 == 0 else "主体：字体" + "体" * 60 + "\n细节：" + "节" * 60


@register("hash_vector")
def hash_vector(dim: int = 64) -> Model:
    """A deterministic vector of a text by its MD5, as a stand-in for a model; blank texts are an error."""
    from hashlib import md5

    def call(text: str) -> list[float]:
        if not text or not text.strip():
            raise ValueError("blank input")
        h = int(md5(text.encode()).hexdigest()[:8], 16)
        return [((h + i) % 1000) / 1000 for i in range(dim)]

    return call


@register("short_vector")
def short_vector(dim: int = 64, most: int = 20) -> Model:
    """As hash_vector, for texts of up to so many characters."""
    inner = hash_vector(dim)

    def call(text: str) -> list[float]:
        if text and len(text) > most:
            raise ValueError("input too long")
        return inner(text)

    return call


@F.pandas_udf(StringType())
def vector_checksum(vectors: pd.Series) -> pd.Series:
    """MD5 of a vector's packed little-endian 32-bit floats."""
    from hashlib import md5

    return vectors.map(lambda v: None if v is None else md5(np.asarray(v, "<f4").tobytes()).hexdigest())
