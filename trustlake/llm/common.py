"""What the corpus operators share: scratch tables, slices of texts, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text that one step inside a task holds in arrays.
SLICE_BYTES = 1 << 20
# Pieces into which the rows of every key are dealt before they meet.
SALTS = 64


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.

    A session without that setting gets one inside its warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/corpus/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the shared folder and read back.

    The lineage ends there, so a lost executor costs its own tasks only.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salt(*columns: str | Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def place(rows: DataFrame, table: DataFrame, keys: str | list[str], by: str) -> DataFrame:
    """Join ``rows`` to a narrow ``table`` with few rows for each key.

    The rows of a key are dealt by a hash of ``by`` into ``SALTS`` cells, and each
    cell gets its table rows first, so a key with a third of all rows is spread.
    ``rows`` is read twice; pass a scan or a ``cut`` result.
    """
    keys = [keys] if isinstance(keys, str) else keys
    rows = rows.withColumn("_salt", salt(by))
    cells = rows.select(*keys, "_salt").distinct().join(table, keys)
    return rows.join(cells, [*keys, "_salt"]).drop("_salt")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each text begins and the last ends.

    Null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(
    batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The rows in order, in slices of about ``size`` bytes of text, one row at least."""
    for batch in batches:
        at = utf8(batch.column(column))[1]
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(at, at[start] + size, "right")) - 1
            end = max(start + 1, end)
            yield batch.slice(start, end - start)
            start = end


def groups(
    batches: Iterator[pa.RecordBatch], key: str
) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``key``, as one batch for each run of equal keys.

    Holds one group and one incoming batch; callers bound their groups.
    """
    held: list[pa.RecordBatch] = []

    def together() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key)
        if held and held[-1].column(key)[-1] != values[0]:
            yield together()
            held = []
        same = pc.equal(values.slice(1), values.slice(0, len(values) - 1))
        bounds = np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1
        start = 0
        for end in bounds.tolist():
            held.append(batch.slice(start, end - start))
            yield together()
            held, start = [], end
        held.append(batch.slice(start))
    if held:
        yield together()


_RANDOM = np.random.default_rng(20240607)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = _RANDOM.integers(1, 1 << 64, 256, np.uint64, endpoint=False)
_VALUE[65:91] = _VALUE[97:123]  # A-Z as a-z


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_TABLES = [_powers(_BASE, 1 << 12), _powers(_INVERSE, 1 << 12)]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and the number of words before each text.

    Words are runs of bytes other than space and 0x09 to 0x0D; A-Z count as a-z.
    A word's hash is a polynomial over random values of its bytes, taken as a
    difference of running sums, so no word is handled on its own.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    starts = np.flatnonzero(start)
    end = inside
    end[:-1] &= ~inside[1:] | first[1:-1]
    ends = np.flatnonzero(end) + 1
    before = np.searchsorted(starts, offsets)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, "right")))
        low, n = starts[i], int(ends[j - 1] - starts[i])
        if n > len(_TABLES[0]):
            _TABLES[:] = _powers(_BASE, n + n // 4), _powers(_INVERSE, n + n // 4)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[data[low : low + n]] * _TABLES[0][:n], out=sums[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[b] - sums[a]) * _TABLES[1][a]
        i = j
    return mix(out), before


def shingles(words: np.ndarray, before: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``size`` words.

    A text with fewer words has its whole sequence as one; without words, none.
    """
    step = np.uint64(0x2545F4914F6CDD1D)

    def chain(parts: list[np.ndarray]) -> np.ndarray:
        x = parts[0]
        for y in parts[1:]:
            x = (x ^ (x >> np.uint64(29))) * step + y
        return mix(x + np.uint64(len(parts)))

    n = len(words) - size + 1
    runs = chain([words[k : k + n] for k in range(size)]) if n > 0 else words[:0]
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(runs[a : b - size + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(chain([words[k : k + 1] for k in range(a, b)]))
        else:
            out.append(words[:0])
    return out
