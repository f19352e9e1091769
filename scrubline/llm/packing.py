"""Texts of varying length packed into containers of fixed capacity.

The lengths of all texts, in tokens, make a histogram of at most capacity bins.
Over it a configuration linear program is solved on the driver by
multiplicative weights, priced by a knapsack dynamic program, and rounded to
exact configurations with repeat counts. The texts take their places in
parallel, by their rank among those of the same length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrubline.session import cut, only

#: Fixed value: the pattern that splits a text before the merges of the rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Size classes of the linear program and its rounds; items of one length that one task ranks; limits and capacities taken.
CLASSES, ROUNDS, STEP = 192, 1200, 0.25
ROWS_PER_SALT, MOST_LIMITS, MOST_CAPACITY = 200_000, 100, 1_000_000


@lru_cache(2)
def encoding(path: str):
    """The tokenizer whose ranks are in the file at path."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every document; null and empty texts have none. Every executor must have the file."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoding(tokenizer)
        for batch in batches:
            sizes = [len(made.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return only(documents, {"doc_id": "bigint", "text": "string"}).mapInArrow(count, "doc_id long, n_tokens long")


def _priced(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of highest price that fits, as the number of items of each class: a knapsack dynamic program."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if n := np.searchsorted(sizes, room, side="right"):
            worth = best[room - sizes[:n]] + prices[:n]
            k = int(worth.argmax())
            if worth[k] > best[room]:
                best[room], last[room] = worth[k], k
    config, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            config[last[room]] += 1
            room -= sizes[last[room]]
    return config


def fractional_plan(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = STEP) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used, so that every class is covered: the linear program by multiplicative weights."""
    covered, used = np.zeros(len(sizes)), {}
    for _ in range(rounds):
        weights = np.exp(-(covered - covered.min()) / step)
        config = _priced(weights / counts, sizes, capacity)
        gain = config / counts
        amount = step / gain.max()
        covered += amount * gain
        key = config.tobytes()
        used[key] = (config, used.get(key, (config, 0.0))[1] + amount)
    return [(c, x / covered.min()) for c, x in used.values()]


class _Stock:
    """The lengths that are left, for finding the largest one that fits."""

    def __init__(self, histogram: dict[int, int]):
        self.left = np.zeros(max(histogram, default=0) + 1, np.int64)
        for size, n in histogram.items():
            self.left[size] = n

    def largest(self, room: int, taken: dict[int, int], above: int = 0) -> int:
        """The largest length in (above, room] of which more is left than taken, or 0."""
        for size in np.flatnonzero(self.left[above + 1 : room + 1])[::-1] + above + 1 if room > above else ():
            if self.left[size] > taken.get(int(size), 0):
                return int(size)
        return 0

    def use(self, taken: dict[int, int], most: int) -> int:
        times = min(most, *(int(self.left[s]) // m for s, m in taken.items()))
        for s, m in taken.items():
            self.left[s] -= times * m
        return times


def pack(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations (items by length) with their repeat counts, which together use the whole histogram of lengths 1 to capacity.

    Each step uses up one length or one planned configuration, so there are no more
    of them than lengths and configurations, whatever the counts are.
    """
    if not histogram:
        return []
    grain = -(-capacity // CLASSES)
    by_class: dict[int, int] = {}
    for size, n in histogram.items():
        by_class[-(-size // grain)] = by_class.get(-(-size // grain), 0) + n
    sizes = np.array(sorted(by_class))
    counts = np.array([by_class[s] for s in sizes], float)
    stock, result = _Stock(histogram), []

    def fill(taken: dict[int, int]) -> dict[int, int]:
        room = capacity - sum(s * m for s, m in taken.items())
        while room > 0 and (size := stock.largest(room, taken)):
            many = min(room // size, int(stock.left[size]) - taken.get(size, 0))
            taken[size] = taken.get(size, 0) + many
            room -= many * size
        return taken

    plan = fractional_plan(sizes, counts, max(capacity // grain, int(sizes[-1])), ROUNDS if len(sizes) > 1 else 1)
    for config, amount in sorted(plan, key=lambda x: -float((x[0] * sizes**2).sum())):
        times = int(amount)
        while times > 0:
            taken: dict[int, int] = {}
            room = capacity
            for k in np.flatnonzero(config)[::-1]:
                for _ in range(config[k]):
                    if size := stock.largest(min(int(sizes[k]) * grain, room), taken, int(sizes[k] - 1) * grain):
                        taken[size] = taken.get(size, 0) + 1
                        room -= size
            if not taken or not (done := stock.use(fill(taken), times)):
                break
            result.append((taken, done))
            times -= done
    while size := stock.largest(len(stock.left) - 1, {}):
        taken = fill({size: 1})
        result.append((taken, stock.use(taken, int(stock.left[size]))))
    return result


def _places(configs: list[tuple[dict[int, int], int]], blanks: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """By length: from which rank on (start) its items go to containers from base on, m in each, at places from place on."""
    ranges: dict[int, list[tuple[int, int, int, int]]] = {}
    given: dict[int, int] = {}
    base, first = 0, 0
    for config, times in configs:
        place = 0
        for size, m in sorted(config.items(), reverse=True):
            start = given.get(size, 0)
            ranges.setdefault(size, []).append((start, base, m, place))
            given[size] = start + m * times
            place += m
        first = first or place
        base += times
    if blanks:
        ranges[0] = [(0, 0, blanks, first)]
    return ranges


def packed(documents: DataFrame, limits: DataFrame, tokenizer: str = TOKENIZER, sizes: DataFrame | None = None) -> DataFrame:
    """(limit_name, container_id, place, doc_id, piece, begin_token, n_tokens): where each document goes, for each limit.

    No container holds more than its limit's capacity. Only a document that alone
    exceeds it is split: into full pieces, each a container of its own, and a rest
    that is packed like any other item. Documents without tokens take no room and
    go to container 0 behind its items. Repeated rows are items of their own; limits
    that are null or not positive are left out; no documents give no containers.

    sizes (doc_id, n_tokens) may be given instead of counting tokens.
    """
    kept = only(limits, {"limit_name": "string", "capacity_tokens": "bigint"}).dropna().filter("capacity_tokens > 0").distinct()
    known = kept.orderBy("limit_name", "capacity_tokens").limit(MOST_LIMITS + 1).collect()
    if len(known) > MOST_LIMITS or any(x.capacity_tokens > MOST_CAPACITY for x in known):
        raise ValueError(f"at most {MOST_LIMITS} limits of at most {MOST_CAPACITY} tokens can be packed at once")
    sizes = cut(sizes if sizes is not None else token_counts(documents, tokenizer)).filter("doc_id is not null")
    offered = F.array(*(F.struct(F.lit(x.limit_name).alias("limit_name"), F.lit(x.capacity_tokens).alias("capacity")) for x in known)) if known else F.expr("cast(array() as array<struct<limit_name:string,capacity:bigint>>)")
    items = sizes.select("doc_id", "n_tokens", F.explode(offered).alias("l")).select("doc_id", "n_tokens", "l.limit_name", "l.capacity")
    last = F.when(F.col("n_tokens") > 0, F.ceil(F.col("n_tokens") / F.col("capacity")) - 1).otherwise(0)
    items = items.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("piece"))
    begin = F.col("piece") * F.col("capacity")
    items = items.select("limit_name", "capacity", "doc_id", "piece", begin.alias("begin_token"), F.least(F.col("capacity"), F.col("n_tokens") - begin).alias("size"))
    # At most capacity rows for each limit, however many documents there are.
    bins = items.groupBy("limit_name", "capacity", "size").agg(F.count(F.lit(1)).alias("n")).collect()
    places, most = {}, 0
    for x in known:
        histogram = {int(b["size"]): int(b.n) for b in bins if (b.limit_name, b.capacity) == (x.limit_name, x.capacity_tokens)}
        blanks = histogram.pop(0, 0)
        most = max([most, blanks, *histogram.values()])
        places[x.limit_name, x.capacity_tokens] = {s: tuple(np.array(c) for c in zip(*r)) for s, r in _places(pack(histogram, x.capacity_tokens), blanks).items()}
    # The rank among items of one length, counted in parts so that no length goes to one task.
    key = ["limit_name", "capacity", "size"]
    items = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(most // ROWS_PER_SALT + 1)))
    parts = items.groupBy(*key, "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*key, "salt", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy(*key, "salt").orderBy("doc_id", "piece")) - 1
    ranked = items.withColumn("rank", rank).join(parts, [*key, "salt"]).withColumn("rank", F.col("rank") + F.col("before")).drop("salt", "before")
    shared = documents.sparkSession.sparkContext.broadcast(places)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (name, capacity, size), rows in frame.groupby(["limit_name", "capacity", "size"], sort=False):
                start, base, many, at = shared.value[name, capacity][size]
                k = np.searchsorted(start, rows["rank"].to_numpy(), side="right") - 1
                inside = rows["rank"].to_numpy() - start[k]
                yield pd.DataFrame({"limit_name": name, "container_id": base[k] + inside // many[k], "place": at[k] + inside % many[k], "doc_id": rows["doc_id"], "piece": rows["piece"], "begin_token": rows["begin_token"], "n_tokens": size})

    return ranked.mapInPandas(place, "limit_name string, container_id long, place long, doc_id long, piece long, begin_token long, n_tokens long")


def usage(placed: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_name, n_containers, n_items, filled): how full the containers of each limit are."""
    sums = placed.groupBy("limit_name").agg((F.max("container_id") + 1).alias("n_containers"), F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("n_tokens"))
    return sums.join(only(limits, {"limit_name": "string", "capacity_tokens": "bigint"}).distinct(), "limit_name").select("limit_name", "n_containers", "n_items", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("filled"))
