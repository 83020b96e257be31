"""Helpers shared by the operators: tables, bounded Arrow slices, row keys, stage tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cohortry.session import materialise

SLICE_CHARS = 4_000_000  # text a task holds as Python objects at a time; a longer single text is a slice alone


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(name: str) -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def sized_slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``limit`` bytes together."""
    start, held = 0, 0
    lengths = pc.binary_length(batch.column(column)).to_pylist()
    for i, n in enumerate(lengths):
        if held and held + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def per_slice(df: DataFrame, text: str, out: T.StructType, make: Callable[[], Callable[[pa.RecordBatch, list[str]], list]]) -> DataFrame:
    """Run ``make()(slice, texts) -> columns`` over bounded slices. ``make`` is called once per task, so it
    may load a model or a vocabulary. ``texts`` has "" for null."""
    at = df.columns.index(text)
    schema = _arrow(out)

    def run(batches):
        work = make()
        for batch in batches:
            for part in sized_slices(batch, at):
                texts = [t or "" for t in part.column(at).to_pylist()]
                columns = work(part, texts)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    return df.mapInArrow(run, out)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def plain(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone: operators carry only what they need, so further columns, whatever their
    names, cannot clash with theirs."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def row_key() -> Column:
    """Key of a row by content. Rows that repeat an id and its text are the same document; rows that
    repeat an id with another text are not."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def hash_sample(df: DataFrame, by: list[str], most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hash of ``by``. The rows are counted first and cut to
    little more than that many by their hash, so what the tasks send together is bounded as well."""
    space = 1 << 40
    share = min(1.0, 1.2 * most / max(1, df.count()))
    at = F.pmod(F.xxhash64(F.lit("sample"), *by), F.lit(space))
    return df.where(at < F.lit(round(share * space))).orderBy(at, *by).limit(most)


MARK_BITS = 26


class Marks:
    """A bit map of 2 ** 26 places (8 MB, whatever the input). A marked value is always found; another may
    be found by chance, so a join decides behind it."""

    def __init__(self, pages: dict[int, bytes]):
        self.bits = np.zeros(1 << (MARK_BITS - 3), np.uint8)
        for page, held in pages.items():
            self.bits[page * 4096:(page + 1) * 4096] = np.frombuffer(held, np.uint8)

    def has(self, value: int) -> bool:
        return bool(self.bits[(value & ((1 << MARK_BITS) - 1)) >> 3] >> (value & 7) & 1)

    def have(self, values: np.ndarray) -> np.ndarray:
        low = values.astype(np.int64) & ((1 << MARK_BITS) - 1)
        return (self.bits[low >> 3] >> (low & 7).astype(np.uint8) & 1).astype(bool)


def bit_map(df: DataFrame, value: Column) -> Marks:
    """Marks of the low bits of a long column, built as bit map pages on the executors."""
    low = value.bitwiseAND(F.lit((1 << MARK_BITS) - 1).cast("long"))
    rows = (df.select(F.shiftright(low, 15).alias("page"), low.bitwiseAND(F.lit(32767).cast("long")).alias("bit"))
            .groupBy("page").agg(F.bitmap_construct_agg("bit").alias("map")).collect())  # at most 2 ** 11 pages of 4 kB
    return Marks({r["page"]: bytes(r["map"]) for r in rows})


__all__ = ["Marks", "hash_sample", "bit_map", "F", "T", "DataFrame", "SparkSession", "materialise", "table", "whole", "per_slice", "sized_slices", "plain", "row_key", "SLICE_CHARS"]
