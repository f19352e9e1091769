"""Freely typed values mapped to the entries of a reference list.

Each distinct word of the distinct values joins the words of the reference list
by edit distance (over shared deletion neighbours) or as an abbreviation. The
repaired words of a value are combined by soft TF-IDF to rank whole entries.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrubline.session import only

WORD = re.compile(r"[^\W_]+")
#: Least share of an entry's weight that the repaired words of a value must cover.
THRESHOLD = 0.6
ABBREVIATION_SIMILARITY = 0.7
ABBREVIATION_LETTERS = 3


def normal(value: str) -> list[str]:
    """The words of value without letter case and accents."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", value.casefold()) if not unicodedata.combining(c))
    return WORD.findall(plain)


def most_edits(word: str) -> int:
    """Edits that a word of this length may take: none up to 3 letters, 1 up to 7, else 2."""
    return 0 if len(word) <= 3 else 1 if len(word) <= 7 else 2


def units(words: list[str]) -> list[str]:
    """The words without numbers, and neighbours written together; all of them together last."""
    words = [w for w in words if not w.isdigit()]
    joined = [a + b for a, b in zip(words, words[1:])]
    return list(dict.fromkeys([*words, *joined, "".join(words)])) if words else []


def neighbours(word: str) -> set[str]:
    """word with up to as many letters deleted as it may take edits, and its form as an abbreviation."""
    found = {word}
    last = {word}
    for _ in range(most_edits(word)):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        found |= last
    if len(word) <= ABBREVIATION_LETTERS:
        found.add("~" + word)
    return found


def abbreviations(word: str) -> set[str]:
    """Shortenings of word: its first letter and up to two later ones, in order."""
    return {"~" + word[0] + "".join(c) for n in range(min(ABBREVIATION_LETTERS, len(word))) for c in combinations(word[1:], n)} if word else set()


def edits(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap neighbours) from a to b, or most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    # Equal beginnings and ends cost nothing, so only what lies between is compared.
    least, i, j = min(len(a), len(b)), 0, 0
    while i < least and a[i] == b[i]:
        i += 1
    while j < least - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    # A letter that the other part lacks costs an edit each.
    if len(one := {*a}) > most or len(b) > most:
        two = {*b}
        if len(one - two) > most or len(two - one) > most:
            return most + 1
    # Hyyrö's bit vectors: bit i tells how the distances of a's first i + 1 letters differ from those next to them.
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every, last, found = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    rising, falling, same, before = every, 0, 0, 0
    for left, y in enumerate(b, 1 - len(b)):
        now = places.get(y, 0)
        same = ((((now & rising) + rising) ^ rising) | now | falling | ((~same & now) << 1 & before)) & every
        up, down = falling | every & ~(same | rising), same & rising
        if up & last:
            found += 1
        elif down & last:
            found -= 1
        if found + left > most:
            return most + 1
        up, down = up << 1 | 1, down << 1
        rising, falling, before = (down | ~(same | up)) & every, up & same & every, now
    return min(found, most + 1)


def _value_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(v, u) for v in batch.column(0).to_pylist() for u in units(normal(v))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["value", "unit"])


def _unit_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(u, n) for u in batch.column(0).to_pylist() for n in neighbours(u)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["unit", "near"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for unit, word, short in zip(*(c.to_pylist() for c in batch.columns)):
            most = max(most_edits(unit), most_edits(word))
            if short and unit != word:
                rows.append((unit, word, ABBREVIATION_SIMILARITY))
            elif (d := edits(unit, word, most)) <= most:
                rows.append((unit, word, 1 - d / max(len(unit), len(word))))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], names=["unit", "word", "sim"])


def _forms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each way to write an entry: its words, and all of them together as one."""
    for frame in frames:
        rows = []
        for entry, names in zip(frame["entry"], frame["names"]):
            for k, name in enumerate(x for x in names if x):
                words = normal(name)
                rows += [(entry, 2 * k, w, len(words) > 1 and i < len(words) - 1) for i, w in enumerate(dict.fromkeys(words))]
                if len(words) > 1:
                    rows.append((entry, 2 * k + 1, "".join(words), False))
        yield pd.DataFrame(rows, columns=["entry", "form", "word", "leads"])


def map_values(values: DataFrame, reference: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(value, entry, score) for each distinct value of the one column of values.

    reference has the columns entry (bigint), names (array of strings: all names of
    the entry) and code (string). entry is null where no entry reaches the
    threshold, or where two entries are equally good. A code counts only as a whole
    value. Nulls are skipped; empty values and values without letters map to none;
    an empty reference list maps all values to none.
    """
    values = values.toDF("value").dropna().distinct()
    found = values.mapInArrow(_value_units, "value string, unit string")
    form_words = reference.select("entry", "names").mapInPandas(_forms, "entry long, form int, word string, leads boolean")
    n_forms = reference.count()
    # The weight of a word falls with the number of entries that share it.
    weights = form_words.groupBy("word").agg(F.log1p(F.lit(float(max(n_forms, 1))) / F.count_distinct("entry")).alias("weight"), F.max("leads").alias("leads"))
    near_words = weights.select("word", "leads").mapInArrow(_word_neighbours, "word string, near string, short boolean")
    near_units = found.select("unit").distinct().mapInArrow(_unit_neighbours, "unit string, near string")
    repaired = near_units.join(near_words, "near").groupBy("unit", "word").agg(F.min("short").alias("short")).mapInArrow(_similar, "unit string, word string, sim double")
    terms = form_words.join(weights.select("word", "weight"), "word").select("entry", "form", "word", (F.col("weight") ** 2).alias("w"))
    totals = terms.groupBy("entry", "form").agg(F.sum("w").alias("total"))
    # The rarest words of a form, without which the others can't reach the threshold: a value must have one of them,
    # so common words meet no value by themselves.
    heavier = Window.partitionBy("entry", "form").orderBy(F.desc("w"), "word").rowsBetween(Window.unboundedPreceding, -1)
    telling = terms.withColumn("before", F.coalesce(F.sum("w").over(heavier), F.lit(0.0))).join(totals, ["entry", "form"]).filter(F.col("total") - F.col("before") >= threshold * F.col("total") - 1e-9)
    words = found.join(repaired, "unit").groupBy("value", "word").agg(F.max("sim").alias("sim"))
    candidates = words.join(telling.select("word", "entry", "form", "total"), "word").select("value", "entry", "form", "total").distinct()
    scored = (
        candidates.join(terms, ["entry", "form"]).join(words, ["value", "word"]).groupBy("value", "entry", "form").agg(F.sum(F.col("w") * F.col("sim")).alias("got"), F.max("total").alias("total"))
        .groupBy("value", "entry").agg(F.max(F.struct((F.col("got") / F.col("total")).alias("score"), F.col("got"))).alias("best"))
        .filter(F.col("best.score") >= threshold)
    )
    # Of entries above the threshold the one that explains most of the value is meant; a tie decides nothing. What of the
    # value no entry explains weighs the same for all of them, so it changes no rank.
    first = Window.partitionBy("value").orderBy(F.desc("best.got"), F.desc("entry"))
    two = scored.withColumn("rank", F.row_number().over(first)).filter("rank <= 2")
    ranked = two.groupBy("value").agg(F.max("best.got").alias("got"), F.min(F.when(F.col("rank") == 2, F.col("best.got"))).alias("next"), F.max(F.when(F.col("rank") == 1, F.col("entry"))).alias("entry"), F.max(F.when(F.col("rank") == 1, F.col("best.score"))).alias("score"))
    tie = F.coalesce(F.col("next") >= F.col("got") - 1e-9, F.lit(False))
    ranked = ranked.select("value", F.when(~tie, F.col("entry")).alias("entry"), F.when(~tie, F.col("score")).alias("score"))
    codes = reference.filter("code is not null").select(F.lower("code").alias("code"), F.col("entry").alias("coded")).groupBy("code").agg(F.min("coded").alias("coded"))
    code = F.lower(F.regexp_replace("value", r"[^\p{L}\p{N}]", ""))
    return (
        values.join(ranked, "value", "left").withColumn("code", code).join(codes, "code", "left")
        .select("value", F.coalesce("coded", "entry").alias("entry"), F.when(F.col("coded").isNotNull(), 1.0).otherwise(F.col("score")).alias("score"))
    )


class Entries:
    """map_values for one value at a time, over a reference list that every task holds."""

    def __init__(self, reference: Iterable[tuple[int, list[str], str | None]], threshold: float = THRESHOLD):
        reference = list(reference)
        self.threshold, self.codes = threshold, {}
        for entry, _, code in reference:
            if code is not None:
                self.codes[code.lower()] = min(entry, self.codes.get(code.lower(), entry))
        forms = next(_forms(iter([pd.DataFrame([(e, n) for e, n, _ in reference], columns=["entry", "names"])])))
        having: dict[str, set[int]] = {}
        leads: dict[str, bool] = {}
        for entry, _, word, lead in forms.itertuples(index=False):
            having.setdefault(word, set()).add(entry)
            leads[word] = leads.get(word, False) or lead
        self.terms: dict[str, list[tuple[int, int, float]]] = {}
        self.totals: dict[tuple[int, int], float] = {}
        for entry, form, word, _ in forms.itertuples(index=False):
            w = math.log1p(len(reference) / len(having[word])) ** 2
            self.terms.setdefault(word, []).append((entry, form, w))
            self.totals[entry, form] = self.totals.get((entry, form), 0.0) + w
        self.near: dict[str, dict[str, bool]] = {}
        for word in having:
            for n in neighbours(word):
                if n[0] != "~":
                    self.near.setdefault(n, {})[word] = False
            for n in abbreviations(word) if leads[word] else ():
                self.near.setdefault(n, {}).setdefault(word, True)
        self.longest = max(map(len, having), default=0)

    def meant(self, value: str) -> int | None:
        """The entry that value means, or None."""
        if (coded := self.codes.get("".join(c for c in value if unicodedata.category(c)[0] in "LN").lower())) is not None:
            return coded
        sims: dict[str, float] = {}
        for unit in units(normal(value)):
            # A longer word has too many letters for any word of the list.
            found: dict[str, bool] = {}
            for n in neighbours(unit) if len(unit) <= self.longest + 2 else ():
                for word, short in self.near.get(n, {}).items():
                    found[word] = found.get(word, True) and short
            for word, short in found.items():
                most = max(most_edits(unit), most_edits(word))
                sim = ABBREVIATION_SIMILARITY if short and unit != word else 1 - d / max(len(unit), len(word)) if (d := edits(unit, word, most)) <= most else 0.0
                sims[word] = max(sim, sims.get(word, 0.0))
        got: dict[tuple[int, int], float] = {}
        for word, sim in sims.items():
            for entry, form, w in self.terms[word]:
                got[entry, form] = got.get((entry, form), 0.0) + w * sim
        best: dict[int, tuple[float, float]] = {}
        for (entry, form), g in got.items():
            best[entry] = max((g / self.totals[entry, form], g), best.get(entry, (0.0, 0.0)))
        ranked = sorted(((g, entry) for entry, (score, g) in best.items() if score >= self.threshold), reverse=True)
        return None if not ranked or len(ranked) > 1 and ranked[1][0] >= ranked[0][0] - 1e-9 else ranked[0][1]


def _word_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for word, leads in zip(*(c.to_pylist() for c in batch.columns)):
            rows += [(word, n, False) for n in neighbours(word) if n[0] != "~"]
            rows += [(word, n, True) for n in abbreviations(word)] if leads else []
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.bool_())], names=["word", "near", "short"])


def city_reference(cities: DataFrame) -> DataFrame:
    """The list of ref_cities in the form that map_values takes."""
    rows = only(cities, {"city_id": "bigint", "city_name": "string", "alt_name": "string", "short_code": "string"}).dropna(subset=["city_id", "city_name"])
    return rows.select(F.col("city_id").alias("entry"), F.array_compact(F.array("city_name", "alt_name")).alias("names"), F.col("short_code").alias("code"))


def mapped_cities(customers: DataFrame, cities: DataFrame) -> DataFrame:
    """(record_id, city_id) of each row whose city is no literal city_name; city_id is 0 where no entry is meant.

    Rows with a null city or literally a city_name are left out; blank values mean
    none. Each distinct value is mapped once, so repeated values cost nothing.
    """
    rows = only(customers, {"record_id": "bigint", "city": "string"}).dropna(subset=["city"])
    names = only(cities, {"city_name": "string"}).dropna().distinct()
    rows = rows.join(names, rows["city"] == names["city_name"], "left_anti")
    mapping = map_values(rows.select("city"), city_reference(cities))
    return rows.join(mapping, rows["city"] == mapping["value"], "left").select("record_id", F.coalesce("entry", F.lit(0)).cast("bigint").alias("city_id"))


def unmatched_cities(customers: DataFrame, cities: DataFrame) -> DataFrame:
    """(city, n_rows) of the values that mean no entry of the list."""
    rows = only(customers, {"city": "string"}).dropna()
    counts = rows.groupBy("city").agg(F.count(F.lit(1)).alias("n_rows"))
    mapping = map_values(counts.select("city"), city_reference(cities))
    return counts.join(mapping.filter("entry is null"), counts["city"] == mapping["value"]).select("city", "n_rows")
