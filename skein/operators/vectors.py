"""A store of node vectors: rows by id with the hash of the text they stand for, under the model that made them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.find import reindex_plan, text_hash

DEFAULT_MODEL = "bge-m3"
STORED = "id string, type string, hash string, model string, vector array<double>"
#: Node types whose text says too little to be found by.
SKIPPED = ("database", "api")


def normalised(vector: Column) -> Column:
    """A vector of length one; zeros stay."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))


def model_of(stored: DataFrame, flag: str | None = None) -> str:
    """The model to use: the one asked for, else that of the stored vectors, else the default."""
    if flag:
        return flag
    row = stored.select("model").limit(1).first()
    return row.model if row else DEFAULT_MODEL


def upsert(stored: DataFrame, fresh: DataFrame, model: str) -> DataFrame:
    """Stored vectors with fresh ones (id, type, hash, vector) in the place of those of the same id; another model's go."""
    own = fresh.select("id", "type", "hash", F.lit(model).alias("model"), normalised(F.col("vector")).alias("vector"))
    return stored.where(F.col("model") == model).join(own.select("id"), "id", "left_anti").unionByName(own)


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """(id, type, hash, vector) of (id, type, text), embedded in the tasks, batch texts at a time."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in it:
            for at in range(0, part.num_rows, batch):
                some = part.slice(at, batch)
                vectors = embed(some.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("type"), some.column("hash"), pa.array(vectors, pa.list_(pa.float64()))], names=["id", "type", "hash", "vector"])

    return texts.select("id", "type", text_hash(F.col("text")).alias("hash"), "text").mapInArrow(run, "id string, type string, hash string, vector array<double>")


def reindex(texts: DataFrame, stored: DataFrame, embed: Callable[[list[str]], list[list[float]]], model: str | None = None, only: DataFrame | None = None) -> DataFrame:
    """The stored vectors after texts (id, type, text) that are new or changed, or of another model, are embedded; only: ids to look at."""
    name = model_of(stored, model)
    live = texts.where(~F.col("type").isin(*SKIPPED))
    live = live if only is None else live.join(only.select("id").distinct(), "id", "left_semi")
    todo = reindex_plan(live, stored.where(F.col("model") == name)).where("action = 'embedded'").select("id")
    return upsert(stored, embedded(live.join(todo, "id", "left_semi"), embed), name)
