"""Helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.session import cut, scratch_path

__all__ = ["cut", "scratch_path", "table", "remainder", "word_count", "pick", "slices", "parted", "WORD"]

#: A word: a run of anything but the six ASCII space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits that `parted` sends to all tasks, at most (4 MB), and those of one bitmap of Spark's.
BITS, BITMAP = 1 << 25, 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, so that other columns of the input cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key written as text, modulo `modulus`; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that `column` holds about `most_bytes` in each, one row at least."""
    for batch in batches:
        width = batch.column(column).nbytes / max(1, batch.num_rows)
        step = max(1, int(most_bytes / max(1.0, width)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def parted(rows: DataFrame, key: Column, keys: DataFrame, most: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be among `keys` (one column, a table), and rows whose key is not.

    Keys and rows are compared by one bit of a hash, so the first part holds some rows too
    many (one in 16 up to two million keys, more beyond) and wants a join; the second can do without.
    """
    n = max(1, min(most // BITMAP, 1 << (16 * keys.count() // BITMAP).bit_length()))
    at = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(n * BITMAP))
    page, bit = (lambda c: F.shiftright(at(c), 15)), (lambda c: at(c).bitwiseAND(F.lit(BITMAP - 1)))
    own = F.col(keys.columns[0])
    # Dealt before they are put together, so that no task hands on bitmaps of its own.
    bits = keys.select(page(own).alias("_page"), bit(own).alias("_bit")).repartition("_page").groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    marked = rows.withColumns({"_page": page(key), "_bit": bit(key)}).join(F.broadcast(cut(bits, "bits")), "_page", "left")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright("_bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.col("_bit").bitwiseAND(F.lit(7)).cast("int")), F.lit(0)) == 1
    return marked.where(hit).select(*rows.columns), marked.where(~hit).select(*rows.columns)
