"""Passages of held-out test items inside documents.

Blocks of consecutive words of all items form one Aho-Corasick automaton over
word numbers. Each text is scanned once; every match is extended to the passage
and mapped back to offsets in the original text.
"""

from __future__ import annotations

import html
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.session import only

WORD = re.compile(r"[^\W_]+")
TAG = re.compile(r"<[/!?]?[a-zA-Z][^<>]*>|<!--.*?-->|\[/?[a-zA-Z][^\[\]]*\]|\[/?\*\]", re.S)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});")
#: Consecutive words of an item that make a leak.
PASSAGE_WORDS = 12
#: Words of items in one automaton, about 100 bytes each; more items than that are searched in several blocks.
AUTOMATON_WORDS = 10_000_000


def words(text: str) -> tuple[list[str], list[int], list[int]]:
    """The lower-cased words of text, and where each begins and ends in the original.

    Tags become as many blanks, so offsets stay; entities are decoded, and the
    offsets behind them are moved back.
    """
    bare = TAG.sub(lambda m: " " * len(m[0]), text)
    moved: list[tuple[int, int]] = []  # from this offset of the decoded text on, add that much
    if "&" in bare:
        parts, at, shift, size = [], 0, 0, 0
        for m in ENTITY.finditer(bare):
            decoded = html.unescape(m[0])
            parts += [bare[at : m.start()], decoded]
            size += m.start() - at + len(decoded)
            shift += len(m[0]) - len(decoded)
            moved.append((size, shift))
            at = m.end()
        bare = "".join([*parts, bare[at:]])
    found, starts, ends = [], [], []
    k = shift = 0
    for m in WORD.finditer(bare):
        while k < len(moved) and moved[k][0] <= m.start():
            shift = moved[k][1]
            k += 1
        found.append(m[0].lower())
        starts.append(m.start() + shift)
        inner = shift
        for place, by in moved[k:]:
            if place > m.end():
                break
            inner = by
        ends.append(m.end() + inner)
    return found, starts, ends


class Passages:
    """One Aho-Corasick automaton over the words of items, given as numbers.

    Any passage of n words holds one of the item's blocks of n // 2 words that begin
    every n - n // 2 + 1 words, so only those are in the automaton: a sixth of all
    words rather than all windows. A block that is found is extended to the whole
    passage, word by word.
    """

    def __init__(self, items: Iterable[tuple[int, str]], passage: int):
        self.passage, self.block = passage, max(1, passage // 2)
        self.numbers: dict[str, int] = {}
        self.items: list[int] = []
        self.texts: list[array] = []
        blocks: dict[tuple[int, ...], list[int]] = {}
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)[0]]
            if len(ids) < passage:
                continue
            for i in range(0, len(ids) - self.block + 1, passage - self.block + 1):
                blocks.setdefault(tuple(ids[i : i + self.block]), []).extend((len(self.items), i))
            self.items.append(item)
            self.texts.append(array("I", ids))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for block, places in blocks.items():
            self.automaton.add_word(block, tuple(places))
        if blocks:
            self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, begin, end, words) of the longest passages of each item in text, by its original offsets."""
        if not self.texts:
            return []
        found, starts, ends = words(text)
        if len(found) < self.passage:
            return []
        number = self.numbers.get
        ids = tuple(number(w, 0) for w in found)
        runs: dict[int, list[list[int]]] = {}
        reached: dict[tuple[int, int], int] = {}
        for last, places in self.automaton.iter(ids):
            first = last - self.block + 1
            for k in range(0, len(places), 2):
                item, at = places[k], places[k + 1]
                # Further blocks of a passage that was extended already.
                if reached.get((item, first - at), -1) >= last:
                    continue
                own, begin, end = self.texts[item], first, last + 1
                while begin > 0 and at > 0 and ids[begin - 1] == own[at - 1]:
                    begin, at = begin - 1, at - 1
                shift = end - begin
                while end < len(ids) and at + shift < len(own) and ids[end] == own[at + shift]:
                    end, shift = end + 1, shift + 1
                reached[item, begin - at] = end - 1
                if end - begin >= self.passage:
                    runs.setdefault(item, []).append([begin, end - 1])
        return [(self.items[item], starts[a], ends[b], b - a + 1) for item, own in runs.items() for a, b in self._joined(own)]

    def _joined(self, runs: list[list[int]]) -> list[list[int]]:
        """Runs of which one begins before the other could hold a passage more, as one."""
        made: list[list[int]] = []
        for a, b in sorted(runs):
            if made and a + self.passage - 2 <= made[-1][1]:
                made[-1][1] = max(made[-1][1], b)
            else:
                made.append([a, b])
        return made


def _blocks(sized: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most that many words, or of one item."""
    block: list[tuple[int, str]] = []
    size = 0
    for item, text, n in sized.orderBy("item_id", "item_text").toLocalIterator():
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += n
    if block:
        yield block


def leaked_passages(documents: DataFrame, items: DataFrame, passage_words: int = PASSAGE_WORDS, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """(doc_id, item_id, begin, end, n_words): each passage of at least passage_words words of an item in a document.

    begin and end are offsets in code points of the original text. Words are runs
    of letters or digits, lower-cased, after tags are blanked and entities
    decoded. Documents or items with null id or text, empty ones and ones of fewer
    words have no passages. The automaton is built once and sent to all tasks; items
    of more than automaton_words words need several, one scan of the documents
    each. Repeated items or documents give the same rows once.
    """
    items = only(items, {"item_id": "bigint", "item_text": "string"}).dropna().distinct()
    sized = items.select("item_id", "item_text", F.size(F.split("item_text", r"[^\p{L}\p{N}]+")).cast("bigint").alias("n"))
    docs = only(documents, {"doc_id": "bigint", "text": "string"}).dropna()
    kind = "doc_id long, item_id long, begin long, end long, n_words long"
    parts = []
    # One block after the other, so the driver holds no more than one.
    for block in _blocks(sized, automaton_words):
        shared = docs.sparkSession.sparkContext.broadcast(Passages(block, passage_words))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            spans = shared.value.spans
            for batch in batches:
                rows = [(doc, *x) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in spans(text)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 5, names=["doc_id", "item_id", "begin", "end", "n_words"])

        parts.append(docs.mapInArrow(scan, kind))
    if not parts:
        return docs.sparkSession.createDataFrame([], kind)
    result = reduce(DataFrame.union, parts)
    return result.distinct()


def leaked_items(documents: DataFrame, items: DataFrame, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """(doc_id, item_id) for each document that holds a passage of an item."""
    return leaked_passages(documents, items, passage_words).select("doc_id", "item_id").distinct()
