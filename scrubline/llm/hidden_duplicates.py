"""Records that are equal but for formatting and the order of two fields.

Every value goes code point by code point through one lookup table that skips
what is no letter or digit and folds letter case; the folded codes enter a
polynomial hash, so the canonical text itself is never built. Rows with the
same unordered pair of hashes meet, and a two-pointer comparison that skips the
same characters confirms them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.session import only

SKIP, COMPOSE = 0, 1
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Members of a group that one task compares; larger groups are spread over several.
ROWS_PER_SALT = 200_000


def _folded(char: str) -> int:
    if unicodedata.category(char)[0] not in "LN":
        # A combining mark may complete a letter, so such a value is composed first.
        return COMPOSE if unicodedata.category(char)[0] == "M" else SKIP
    fold = char.casefold()
    if len(fold) > 1 or unicodedata.normalize("NFC", char) != char or "ᅠ" <= char <= "ᇿ":
        return COMPOSE
    return ord(fold)


@lru_cache(1)
def fold_table() -> np.ndarray:
    """By code point: SKIP, COMPOSE (the value needs composing) or the folded code point."""
    table = np.zeros(0x110000, np.uint32)
    table[:0x32400] = [SKIP if 0xD800 <= i < 0xE000 else _folded(chr(i)) for i in range(0x32400)]
    return table


@lru_cache(1)
def _mixed() -> np.ndarray:
    """Each folded code point as a number of 64 bits without pattern."""
    codes = np.arange(0x110000, dtype=np.uint64) * MIX
    return codes ^ (codes >> np.uint64(29))


_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    """The powers of the base, at least n of them; longer texts extend what is there."""
    if len(_POWERS[0]) < n:
        _POWERS[0] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 256), BASE), dtype=np.uint64)])
    return _POWERS[0]


def composed(value: str) -> str:
    """The few values with marks or letters of several parts, in composed form."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", value).casefold())


def _codes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all values in a row, and the number of each value's."""
    joined = "".join(values.to_pylist())
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), pc.utf8_length(values).to_numpy(zero_copy_only=False).astype(np.int64)


def hashes(values: pa.Array, settled: bool = False) -> np.ndarray:
    """The polynomial hash of the letters and digits of each value, case folded; settled values are composed already."""
    table = fold_table()
    codes, lengths = _codes(values)
    kept = table[codes]
    ends = np.cumsum(lengths)
    odd = np.flatnonzero(kept == COMPOSE)
    kept[odd] = SKIP
    letters = np.flatnonzero(kept)
    # How many letters come before the beginning and the end of each value.
    edges = np.searchsorted(letters, np.concatenate([[0], ends]))
    counts = np.diff(edges)
    place = np.arange(len(letters), dtype=np.int32) - np.repeat(edges[:-1].astype(np.int32), counts)
    sums = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(_mixed()[kept[letters]] * _powers(int(counts.max(initial=0)))[place], out=sums[1:])
    result = (sums[edges[1:]] - sums[edges[:-1]]) * MIX + counts.astype(np.uint64)
    result = (result ^ (result >> np.uint64(31))).view(np.int64)
    if len(odd) and not settled:
        # Only values whose marks may complete a letter are hashed again; marks that complete none are skipped.
        rows = np.unique(np.searchsorted(ends, odd, side="right"))
        result[rows] = hashes(pa.array([composed(values[int(i)].as_py()) for i in rows], pa.string()), True)
    return result


def same(a: str, b: str) -> bool:
    """Whether two values hold the same letters and digits, by two pointers that skip all else."""
    if a == b:
        return True
    table = fold_table()
    if any(table[ord(c)] == COMPOSE for c in a + b):
        a, b = composed(a), composed(b)
    i = j = 0
    while True:
        while i < len(a) and table[ord(a[i])] <= COMPOSE:
            i += 1
        while j < len(b) and table[ord(b[j])] <= COMPOSE:
            j += 1
        if i == len(a) or j == len(b):
            return i == len(a) and j == len(b)
        if table[ord(a[i])] != table[ord(b[j])]:
            return False
        i, j = i + 1, j + 1


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            one, two = hashes(batch.column(1)), hashes(batch.column(2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], names=["id", "a", "b", "lo", "hi"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by hashes and id, so the first of equal rows has the smallest id."""
    key, kept = None, []
    for batch in batches:
        keep, copy = [], []
        for i, a, b, *now in zip(*(c.to_pylist() for c in batch.columns)):
            if now != key:
                key, kept = now, []
            for k, x, y in kept:
                if (same(a, x) and same(b, y)) or (same(a, y) and same(b, x)):
                    if i != k:
                        keep.append(k)
                        copy.append(i)
                    break
            else:
                kept.append((i, a, b))
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(copy, pa.int64())], names=["keep_id", "copy_id"])


def formatting_copies(df: DataFrame, key: str = "record_id", first: str = "customer_name", second: str = "email") -> DataFrame:
    """(keep_id, copy_id) for every row of df that repeats another but for formatting.

    Two rows are equal if the values of first and second hold the same letters
    and digits, whatever the letter case, other characters, canonical Unicode
    form and order of the two values. keep_id is the smallest key of the group.
    Rows with a null in key, first or second, and rows without an @ in either
    value, are never copies. Values without any letter or digit are equal to each
    other; rows with the same key are one row. An empty table gives an empty
    result, and further columns of df don't matter.
    """
    rows = only(df, {key: "bigint", first: "string", second: "string"}).toDF("id", "a", "b").dropna()
    rows = rows.filter(F.contains("a", F.lit("@")) | F.contains("b", F.lit("@"))).mapInArrow(_hashed, "id long, a string, b string, lo long, hi long")
    groups = rows.groupBy("lo", "hi").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    salts = (F.floor(F.col("n") / ROWS_PER_SALT) + 1).cast("int")
    # The row that is kept goes to each part of its group, any other row to one.
    salt = F.explode(F.when(F.col("id") == F.col("keep"), F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.pmod(F.hash("id"), salts))))
    members = rows.join(groups, ["lo", "hi"]).select("id", "a", "b", "lo", "hi", salt.alias("salt"))
    return members.repartition("lo", "hi", "salt").sortWithinPartitions("lo", "hi", "salt", "id").mapInArrow(_confirmed, "keep_id long, copy_id long").dropDuplicates(["copy_id"])


def collapse(df: DataFrame, key: str = "record_id", first: str = "customer_name", second: str = "email") -> DataFrame:
    """One row of df for each group of formatting copies, with copies, the number of rows it stands for.

    Rows that have no copies, among them those with nulls, stay with copies = 1.
    """
    found = formatting_copies(df, key, first, second)
    rows = only(df, {key: "bigint", first: "string", second: "string"})
    kept = rows.join(found.select(F.col("copy_id").alias(key)), key, "left_anti")
    counts = found.groupBy(F.col("keep_id").alias(key)).agg((F.count(F.lit(1)) + 1).alias("copies"))
    return kept.join(counts, key, "left").select(key, first, second, F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"))
