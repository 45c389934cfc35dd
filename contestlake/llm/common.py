"""What the operators of this subpackage share: reading, row-wise Arrow passes, text statistics."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# executors get the functions themselves, whether or not they can import this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed value: white space as the digests define it.
SPACE = r"\x20\x09-\x0D"
#: Rows that a task handles at once; bounds what Python holds of long texts.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text modulo the divisor; a missing id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % divisor


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def append(df: DataFrame, columns: list[str], schema: str, make: Callable[[pa.RecordBatch], list[pa.Array]], keep: list[str] | None = None) -> DataFrame:
    """Each row with new columns made from ``columns`` by Arrow batch; no shuffle.

    ``make`` gets a batch of ``columns`` renamed c0, c1, ... and returns one array per field of ``schema``.
    ``keep`` names the columns that stay (all by default).  The new names must differ from the kept ones.
    """
    keep = df.columns if keep is None else keep
    source = df.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(columns)])
    fields = T._parse_datatype_string(schema).fields if isinstance(schema, str) else schema
    out = T.StructType([*source.schema.fields[:len(keep)], *fields])
    n, names = len(keep), [f.name for f in out.fields]

    def run(batches):
        for batch in slices(batches):
            inputs = pa.RecordBatch.from_arrays(batch.columns[n:], [f"c{i}" for i in range(len(columns))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *make(inputs)], names)

    return source.mapInArrow(run, out)


GRAM_PIECE = 1 << 20


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_counts(codes: np.ndarray, bits: int, orders: tuple[int, ...]) -> np.ndarray:
    """Counts of hashed runs of code points, one bin per hash; long texts go in overlapping pieces."""
    size, shift = 1 << bits, np.uint32(32 - bits)
    total = np.zeros(size, np.int64)
    longest = max(orders)
    for start in range(0, max(len(codes), 1), GRAM_PIECE):
        piece = codes[start:start + GRAM_PIECE + longest - 1]
        fresh = min(GRAM_PIECE, len(codes) - start)
        h = np.zeros(len(piece), np.uint32)
        for order in range(1, longest + 1):
            if len(piece) < order:
                break
            h = (h[:len(piece) - order + 1] * np.uint32(0x9E3779B1)) ^ piece[order - 1:]
            if order in orders:
                mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(order * 0x27D4EB2F & 0xFFFFFFFF)
                mixed ^= mixed >> np.uint32(13)
                mixed *= np.uint32(0xC2B2AE35)
                total += np.bincount(mixed[:fresh] >> shift, minlength=size)
    return total
