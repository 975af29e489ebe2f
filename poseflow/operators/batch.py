"""User code over complexes and candidates."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .ranks import best_row


def map_complexes(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn on the rows of each key, with an error column: a key on which fn fails is one row with the keys and the error (J1, J2, J5). The rows of a key
    meet in one task, so keys must be of bounded size, as complexes are. schema must begin with the keys."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        try:
            return fn(frame).assign(error=None)[[*names, "error"]]
        except Exception:
            row = {k: frame[k].iloc[0] for k in keys} | {"error": traceback.format_exc(limit=-1)}
            return pd.DataFrame([row]).reindex(columns=[*names, "error"])

    return df.groupBy(*keys).applyInPandas(run, f"{schema}, error string")


def stream_complexes(df: DataFrame, keys: list[str], fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """fn on the rows of each key as Arrow batches, one after the other, with an error column: for keys of any size, of which a task holds a batch
    (J1, J2, J5). schema must begin with the keys. If fn fails, the batches that it gave before stay, and a row with the keys and the error
    follows; `settled` takes the former away."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        error = None
        try:
            for out in fn(batches):
                yield pa.RecordBatch.from_arrays([*(out.column(c) for c in names), pa.nulls(out.num_rows, pa.string())], names=[*names, "error"])
        except Exception:
            error = traceback.format_exc(limit=-1)
        if error is not None:
            for _ in batches:  # what fn has not read
                pass
            given = dict(zip(keys, key))
            row = [pa.array([given[c].as_py() if c in given else None], kinds[c]) for c in names]
            yield pa.RecordBatch.from_arrays([*row, pa.array([error])], names=[*names, "error"])

    kinds = {f.name: f.type for f in to_arrow_schema(StructType.fromDDL(schema))}
    return df.groupBy(*keys).applyInArrow(run, f"{schema}, error string")


def settled(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the keys without an error, and the errors: what `stream_complexes` gave of a failed key goes too."""
    failed = df.where("error is not null")
    return df.where("error is null").drop("error").join(failed.select(*keys).distinct(), keys, "left_anti"), failed


def observed(df: DataFrame, name: str = "complexes") -> tuple[DataFrame, Observation]:
    """df, and what an action on it will have counted on its way: rows and failures, without a second pass."""
    observation = Observation(name)
    return df.observe(observation, F.count("*").alias("rows"), F.count_if(F.col("error").isNotNull()).alias("failures")), observation


def compose(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Applies pluggable steps in turn."""
    for step in steps:
        df = df.transform(step)
    return df


def batch_score(df: DataFrame, open_model: Callable[[], Callable[[pd.DataFrame], pd.Series]], column: str = "affinity", batch: int = 256) -> DataFrame:
    """df with the model's value of each row and an error (J4, J5). open_model runs once per task; the model gets frames of at most `batch` rows. A batch that
    fails is tried row by row; rows that fail have a null value and the error, and no stand-in is scored."""
    names = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = open_model()
        for frame in frames:
            for at in range(0, len(frame), batch):
                some = frame.iloc[at : at + batch].reset_index(drop=True)
                try:
                    yield some.assign(**{column: pd.Series(predict(some), dtype=float).to_numpy(), "error": None})
                except Exception:
                    values, errors = [], []
                    for k in range(len(some)):
                        try:
                            values.append(float(pd.Series(predict(some.iloc[k : k + 1].reset_index(drop=True))).iloc[0]))
                            errors.append(None)
                        except Exception as e:
                            values.append(None)
                            errors.append(f"{type(e).__name__}: {e}")
                    yield some.assign(**{column: values, "error": errors})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {column} double, error string"
    return df.select(*names).mapInPandas(run, schema)


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows without the error column, and the failed ones."""
    return df.where("error is null").drop("error"), df.where("error is not null")


def best_pockets(scored: DataFrame) -> DataFrame:
    """The best pocket of each protein and compound."""
    return best_row(scored.where(F.col("affinity").isNotNull()), ["protein_name", "compound_name"], "affinity", "pocket_name")
