"""What the operators share: durable intermediate tables, Arrow slicing and bounded word tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.session import durable, release, removed_at_exit
from lexigraph.session import shared_folder as shared_dir

#: Rows that one numpy step works on; an Arrow batch may hold more.
SLICE_ROWS = 256
#: Characters after which a slice ends early, so very long texts do not pile up.
SLICE_CHARS = 4_000_000


def unused(name: str, *taken: str) -> str:
    """The name, with underscores before it until no column has it, whatever its case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches where either SLICE_ROWS rows or SLICE_CHARS bytes are reached."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(text))).to_pylist()
        start = held = 0
        for at, size in enumerate(sizes):
            if at > start and (at - start >= SLICE_ROWS or held + (size or 0) > SLICE_CHARS):
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += size or 0
        if start < len(sizes):
            yield batch.slice(start)


class Table(dict):
    """A memo of ``make(key)`` that holds two generations of values weighing ``limit`` at most each, a value more or less.

    Each distinct key is made once while it stays in use; memory is bounded whatever the vocabulary.
    """

    def __init__(self, make: Callable, limit: int = 250_000, weigh: Callable = lambda value: 1):
        super().__init__()
        self.make, self.limit, self.weigh, self.old, self.held = make, limit, weigh, {}, 0

    def __missing__(self, key):
        old = self.old
        value = old[key] if key in old else self.make(key)
        if self.held >= self.limit:
            self.old, self.held = dict(self), 0
            self.clear()
        self.held += self.weigh(value)
        self[key] = value
        return value


def bounded_labels(labels: DataFrame, target: str, most: int, seed: int) -> DataFrame:
    """(doc_id, y) of labels that are 0 or 1, one a doc_id (the greater), about ``most`` of them at most, chosen by hash."""
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(target).cast("double").alias("y")).where("y IN (0.0, 1.0) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("y").alias("y"))
    there = usable.count()
    if there > most:
        usable = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * most / there))
    return usable
