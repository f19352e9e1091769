"""Spellings of one person's or organisation's name, linked by a noisy channel.

Rows that share a mailbox or a phone form a block; a row without mailbox also
one with those of its branch and town that share a name's longest word. In a block the frequent full
spellings are candidate names. Every other spelling goes to the candidate of
highest posterior: its frequency times the likelihood of the typos, initials,
nicknames, abbreviations and reorderings that would turn it into the spelling.
A spelling that no candidate explains is a name of its own, so people who only
share a phone or a mailbox stay apart. Blocks that share rows are then joined.
"""

from __future__ import annotations

import math
import re
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.functions.columns import NA_TOKENS
from scrubline.llm.canonical_values import Entries, city_reference, edits, normal
from scrubline.llm.hidden_duplicates import hashes
from scrubline.session import cut, only

#: Least log likelihood of a spelling under a name, and spellings of a block from which it has a task of its own; it is judged
#: as a whole at any size.
LEAST_LIKELIHOOD, BLOCK_SPELLINGS = -12.5, 2_000
#: Spellings of a block from which fitting names are looked up rather than all tried; the result is the same.
INDEXED_SPELLINGS = 40
#: Spellings sought in a place up to which all its names are tried, as that is less work than to index them; the result is the same.
SOUGHT_SPELLINGS = 8
#: A word is a common name if at least this share of all rows has it; so there are at most words per row over it.
COMMON_SHARE = 0.001
#: Size of the filter of places where a row without mailbox is sought; a full filter only sends more rows.
SOUGHT_BITS = 1 << 23
#: Crowded blocks up to which their keys are broadcast, and most tasks for them.
BROADCAST_BLOCKS, CROWDED_TASKS = 100_000, 1_000
#: Letters from which the consonants of a word tell it; a shorter one counts as spelled.
SHORT = 5
# Words that surround the name of a town, and words that stand for no town.
AFFIXES = frozenset("town city of district municipality rural central greater near nr bus stand eastern western northern southern province ward the".split())
NO_TOWNS = frozenset("unknown nowhere abroad office string asdfgh notes house above given".split())
NO_WORDS = frozenset("".join(normal(t)) for t in NA_TOKENS)

# Words that are no part of a name, legal forms with their short forms, and nicknames by full name.
TITLES = frozenset("mr mrs ms miss dr prof sir madam herr frau sri smt esq jr sr phd md".split())
FORMS = {
    "limited": "ltd", "private": "pvt", "company": "co", "corporation": "corp", "incorporated": "inc", "gesellschaft": "ges gmbh", "cooperative": "coop", "international": "intl", "brothers": "bros", "associates": "assoc", "manufacturing": "mfg",
    "industries": "ind inds", "services": "svc svcs", "holdings": "hldgs", "trading": "trdg", "enterprises": "ent", "and": "", "sons": "", "group": "grp", "partners": "ptnrs", "works": "wks", "the": "",
}
NICKNAMES = {
    "abigail": "abby abbie gail", "agnes": "aggie nessa", "aleksandra": "alex ola sasha sandra aleks", "alexander": "alex sasha sandy xander", "amara": "mara", "andrew": "andy drew", "anil": "", "anthony": "tony ant", "arjun": "", "bartholomew": "bart barry mew", "benjamin": "ben benny benji",
    "catherine": "kate katie cathy kitty", "charles": "charlie chuck chas charley", "christopher": "chris kit topher", "daniel": "dan danny", "deborah": "deb debbie debby", "dolores": "lola lolita", "edward": "ed eddie ted ned teddy", "elena": "lena", "elizabeth": "liz beth betty eliza lisa libby bess lizzie",
    "emmanuel": "manny manu", "francisco": "paco pancho cisco kiko", "frederick": "fred freddy freddie", "friedrich": "fritz fred", "gabriela": "gabi gaby", "gregory": "greg", "henrietta": "hattie etta hettie", "isabella": "bella izzy isa belle", "jacqueline": "jackie jacqui", "james": "jim jimmy jamie",
    "jennifer": "jen jenny jenn", "johannes": "hans jo", "jonathan": "jon jonny nathan", "jose": "pepe", "joseph": "joe joey jos", "katarzyna": "kasia", "katherine": "kate katie kathy kat kitty kath", "lawrence": "larry laurie lou", "leonard": "len lenny leo", "margaret": "peggy maggie meg greta marge",
    "matthew": "matt matty", "michael": "mike mick mikey", "nicholas": "nick nicky", "patricia": "pat patty tricia trish patti", "penelope": "penny", "philip": "phil pip", "ravindra": "ravi", "rebecca": "becca becky", "richard": "rick dick rich richie ricky", "robert": "bob rob bobby bert robbie",
    "samuel": "sam sammy", "stephen": "steve stevie", "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim timmy", "victoria": "vicky tori vic vicki", "vikram": "vik vicky", "wilhelmina": "mina willa minnie wilma billie", "william": "bill will billy willy liam", "nathaniel": "nat nate",
    "susan": "sue susie", "dorothy": "dot dotty", "ronald": "ron ronnie", "kenneth": "ken kenny", "donald": "don donny", "pamela": "pam", "cynthia": "cindy", "barbara": "barb babs",
}
#: Short forms of words of trade, which unlike legal forms are part of a name.
TRADES = {
    "packaging": "pkg pkgs", "engineering": "engg engr", "logistics": "lgs", "textiles": "txt", "printers": "prtrs", "motors": "mtrs", "timber": "tmbr", "foods": "fds", "electricals": "elctr",
}
FULL_NAMES: dict[str, frozenset[str]] = {}
for _full, _short in NICKNAMES.items():
    for _nick in _short.split():
        FULL_NAMES[_nick] = FULL_NAMES.get(_nick, frozenset()) | {_full}
SHORT_FORMS = {s: k for k, v in (FORMS | TRADES).items() for s in v.split()}
_NOT_NAME = re.compile(r"\bc/o\b.*$|[\W_]+(?:accounts?|billing|office|personal|home|work|private account)\W*$|^\W*m/s\b|\battn\b.*$", re.I)
#: What each match of _NOT_NAME in an ASCII name holds.
_HINT = re.compile("c/o|m/s|attn|account|billing|office|personal|home|work")
_WORD = re.compile(r"[^\W\d_]+")


def name_words(name: str) -> list[str]:
    """The words of a name without accents, titles and what is added to it."""
    plain = name.casefold()
    if not name.isascii() or _HINT.search(plain):
        plain = _NOT_NAME.sub(" ", name).casefold()
    if not plain.isascii():
        plain = "".join(c for c in unicodedata.normalize("NFKD", plain.replace("ø", "o").replace("ł", "l").replace("’", "")) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    words = [w for w in _WORD.findall(plain.replace("'", "")) if w not in TITLES]
    return [SHORT_FORMS.get(w, w) if len(words) > 1 else w for w in words]


@lru_cache(1 << 16)
def _sound(word: str) -> str:
    """word with letters that sound alike made equal."""
    for a, b in (("ph", "f"), ("ck", "k"), ("sch", "sh"), ("w", "v"), ("c", "k"), ("q", "k"), ("z", "s"), ("y", "i"), ("th", "t"), ("dt", "t"), ("h", "")):
        word = word.replace(a, b)
    return re.sub(r"(.)\1", r"\1", word)


@lru_cache(1 << 17)
def word_likelihood(said: str, meant: str, both_common: bool) -> float:
    """Log likelihood that the word meant is typed as said."""
    if said == meant:
        return 0.0
    if meant in FULL_NAMES.get(said, ()) or said in FULL_NAMES.get(meant, ()):
        return -1.0
    if FULL_NAMES.get(said, frozenset()) & FULL_NAMES.get(meant, frozenset()):
        return -1.5
    if len(said) == 1 or len(meant) == 1:
        initial, word = sorted((said, meant), key=len)
        return -2.0 if initial == word[0] else -4.0 if any(n[0] == initial for n in (*NICKNAMES.get(word, "").split(), *FULL_NAMES.get(word, ()))) else -20.0
    if both_common:
        return -20.0
    if len(said) >= 2 and meant.startswith(said) or len(meant) >= 3 and said.startswith(meant) and len(said) > len(meant) + 1:
        return -2.5
    longest = max(len(said), len(meant))
    most = 1 if longest <= 4 else 2 if longest <= 7 else 3
    found = edits(said, meant, most)
    if found <= most:
        return -1.0 - 2.2 * found
    if _sound(said) == _sound(meant):
        return -3.0
    # A nickname may be misspelled too.
    if any(len(n) > 3 and edits(said, n, 1) <= 1 for n in NICKNAMES.get(meant, "").split()):
        return -5.0
    return -5.0 if any(edits(full, other, 2) <= 2 for nick, other in ((said, meant), (meant, said)) for full in FULL_NAMES.get(nick, ())) else -20.0


def likelihood(said: list[str], meant: list[str], common: frozenset[str]) -> float:
    """Log likelihood that somebody of the name meant is written as said."""
    if not said or not meant:
        return -math.inf
    if len(said) == len(meant) == 2:
        # Most often one word agrees; then the other decides, and seldom needs more than its letters.
        shared = [w for w in said if w in meant]
        if len(shared) == 1:
            a, b = (said[1 - said.index(shared[0])], meant[1 - meant.index(shared[0])])
            return word_likelihood(a, b, a in common and b in common)
    total, left = 0.0, list(meant)
    rest = []
    for word in sorted(said, key=len, reverse=True):
        if word in left:
            left.remove(word)
            continue
        options = [(word_likelihood(word, m, word in common and m in common and word != m), -i) for i, m in enumerate(left)]
        best = max(options, default=(-20.0, 0))
        if best[0] > -10:
            total += best[0]
            left.pop(-best[1])
        else:
            rest.append(word)
    # Names of which no word agrees have nothing in common, however little their words cost.
    if len(rest) == len(said):
        total = -20.0
    for word in rest + left:
        total -= 1.5 if len(word) == 1 or word in FORMS else 8.0
    if total < LEAST_LIKELIHOOD:
        # Words may have been run together or torn apart, or only initials be left.
        one, two = "".join(said), "".join(meant)
        for other in (two, "".join(meant[1:] + meant[:1]), "".join(meant[-1:] + meant[:-1])):
            if min(len(one), len(other)) > 5 and (d := edits(one, other, 2)) <= 2:
                total = max(total, -2.0 - 2.2 * d)
        if len(said) > 1 and len(said) == len(meant) and all(len(w) == 1 for w in said) and [w[0] for w in meant] == said:
            total = max(total, -6.0)
        if len(said) == 1 and len(meant) > 2 and sorted(one) in (sorted(w[0] for w in meant), sorted(w[0] for w in meant if w not in ("and", "the"))):
            total = max(total, -6.0)
        if total < LEAST_LIKELIHOOD:
            return total
    # Something whole must agree, not just initials.
    whole = [w for w in said if len(w) > 2]
    if whole and len(said) > 1 and not any(w[0] == m[0] or _sound(w)[:1] == _sound(m)[:1] for w in whole for m in meant if len(m) > 2):
        return -20.0
    return total


def _shortened(word: str, most: int) -> set[str]:
    """word with up to most letters deleted."""
    found = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        found = found | last
    return found


def _pieces(text: str, n: int) -> list[tuple[int, int]]:
    """Where the n pieces of a text of that length begin and end."""
    return [(i * len(text) // n, (i + 1) * len(text) // n) for i in range(n)]


@lru_cache(1 << 16)
def _relatives(word: str) -> frozenset[str]:
    """What a word shares with each one that a nickname leads to: full names it is near or short for, nicknames it is near or has."""
    less = _shortened(word, 2) if len(word) < 24 else set()
    fulls = {f for x in less for f in _FULL_FORMS.get(x, ()) if edits(word, f, 2) <= 2} | set(FULL_NAMES.get(word, ()))
    nicks = {n for x in less for n in _NICK_FORMS.get(x, ()) if edits(word, n, 1) <= 1} | set(NICKNAMES.get(word, "").split())
    return frozenset({"f" + f for f in fulls} | {"k" + n for n in nicks})


_FULL_FORMS: dict[str, list[str]] = {}
for _full in NICKNAMES:
    for _form in _shortened(_full, 2):
        _FULL_FORMS.setdefault(_form, []).append(_full)
_NICK_FORMS: dict[str, list[str]] = {}
for _nick in FULL_NAMES:
    for _form in _shortened(_nick, 1) if len(_nick) > 3 else ():
        _NICK_FORMS.setdefault(_form, []).append(_nick)


def _word_forms(word: str, long: int) -> set[str]:
    """What a word shares with each one it may be typed for, but for their first letters; slips are left out from that length on.

    The longer of two words says how many slips there may be; the shorter one then has less letters to lose.
    """
    found, n = {"~" + _sound(word), *_relatives(word)}, len(word)
    for least, slips in ((1, 1), (5, 2), (8, 3)):
        if n < long and n >= least - slips and n <= {1: 4, 2: 7, 3: long}[slips]:
            found.update(f"{slips}{f}" for f in _shortened(word, min(slips, slips - least + n) if slips > 1 else 1))
    return found


@lru_cache(1 << 13)
def _form_hashes(word: str) -> np.ndarray:
    """The forms of a word by which a block is searched; trades, legal forms and given names stand in many blocks."""
    return np.fromiter(map(hash, _word_forms(word, _Words.LONG + 3)), np.int64)


def _letters(word: str) -> set[str]:
    """The initials that may stand for a word."""
    return {word[0], *(n[0] for n in (*NICKNAMES.get(word, "").split(), *FULL_NAMES.get(word, ())))}


class _Words:
    """The words of a block, and for each word those that may be typed for it or for which it may be typed.

    Two texts within k edits share a form with at most k letters deleted each; of
    2k + 1 pieces of the one at least one also stands in the other, moved by k at most.
    Forms are kept by their hashes; the likelihoods decide.
    """

    LONG = 12

    def __init__(self, known: set[str], common: frozenset[str]):
        self.common, self.cut = common, {}
        self.known, self.sorted, self.lengths = known, sorted(known), {len(w) for w in known}
        made = [_form_hashes(w) for w in self.sorted]
        for w in self.sorted:
            if len(w) >= self.LONG:
                for k, (i, j) in enumerate(_pieces(w, 7)):
                    self.cut.setdefault((len(w), k, w[i:j]), []).append(w)
        forms = np.concatenate([np.zeros(0, np.int64), *made])
        order = np.argsort(forms)
        self.forms, self.owners = forms[order], np.repeat(np.arange(len(made), dtype=np.int32), [*map(len, made)])[order]
        self.matches = lru_cache(None)(self._matches)

    def _matches(self, word: str) -> tuple[str, ...]:
        forms = _form_hashes(word)
        first, last = self.forms.searchsorted(forms), self.forms.searchsorted(forms, "right")
        near = {self.sorted[k] for i, j in zip(first.tolist(), last.tolist()) if i < j for k in self.owners[i:j].tolist()}
        near |= {word[:n] for n in self.lengths if 1 < n < len(word)} & self.known
        near.update(takewhile(lambda w: w.startswith(word), islice(self.sorted, bisect_left(self.sorted, word), None)))
        for n in range(len(word) - 3, len(word) + 4) if len(word) >= self.LONG else ():
            if n in self.lengths and n >= self.LONG:
                for k in range(7):
                    i, j = k * n // 7, (k + 1) * n // 7
                    for d in range(-3, 4):
                        near.update(self.cut.get((n, k, word[i + d : j + d]), ()) if i + d >= 0 else ())
        single = lambda w: len(w) == 1
        return tuple(w for w in near if not single(w) and max(word_likelihood(word, w, both := word in self.common and w in self.common and w != word), word_likelihood(w, word, both)) > -10)


class _Kind:
    """Names with as many words that cost much alone, and as many initials: by their words, their initials, and initials that may stand for their words."""

    def __init__(self):
        self.having: dict[str, list[str]] = {}
        self.initial: dict[str, list[str]] = {}
        self.lettered: dict[str, list[str]] = {}

    def add(self, name: str, meant: list[str]) -> None:
        for w in set(meant):
            (self.having if len(w) > 1 else self.initial).setdefault(w, []).append(name)
        for x in {x for w in meant if len(w) > 1 for x in _letters(w)}:
            self.lettered.setdefault(x, []).append(name)


class _Names:
    """Names of a block, and for each spelling those whose likelihood may reach the least one; none that does is left out."""

    def __init__(self, words: _Words):
        self.words, self.kinds, self.joined, self.initials = words, {}, {}, {}

    @staticmethod
    def _kind(said: list[str]) -> tuple[int, int]:
        """How many words cost much if they stay alone, and how many are initials."""
        return sum(len(w) > 1 and w not in FORMS for w in said), sum(len(w) == 1 for w in said)

    @staticmethod
    def _firsts(meant: list[str]) -> set[str]:
        return {"".join(w[0] for w in meant), "+".join(sorted(w[0] for w in meant)), "+".join(sorted(w[0] for w in meant if w not in ("and", "the")))}

    @staticmethod
    def _counts(one: str) -> array:
        """How often each letter stands in a text; letters of other alphabets share a place with these."""
        found = array("i", bytes(128))
        for c in one:
            found[ord(c) & 31] += 1
        return found

    def add(self, name: str) -> None:
        meant = name.split()
        if not meant:
            return
        self.kinds.setdefault(self._kind(meant), _Kind()).add(name, meant)
        one = "".join(meant)
        names, letters = self.joined.setdefault(len(one), ([], array("i")))
        names.append(name)
        letters.extend(self._counts(one))
        for f in self._firsts(meant):
            self.initials.setdefault(f, []).append(name)

    def near(self, said: list[str]) -> set[str]:
        heavy, single = self._kind(said)
        long, short = [w for w in said if len(w) > 1], {w for w in said if len(w) == 1}
        letters = {x for w in long for x in _letters(w)}
        found: set[str] = set()
        for (h, s), names in self.kinds.items():
            # At most one word of both may stay alone, so that many must agree, with and without words that meet an initial.
            least, plain = (next(n for n in range(heavy + h + 1) if max(0, heavy - n - i) + max(0, h - n - j) <= 1) for i, j in ((s, single), (0, 0)))
            if least > len(long):
                continue
            # Two legal forms that agree leave the other words as they are.
            lists = [[names.having[m] for m in self.words.matches(w) if m in names.having and not (plain and w in FORMS and m in FORMS)] for w in long]
            lists.sort(key=lambda x: sum(map(len, x)))
            # Of the rarest words, as many as may not agree and one more, one does.
            rarest = lambda n: (names for some in lists[: len(long) - n + 1] for names in some)
            met = lambda: [names.initial[x] for x in letters if x in names.initial] + [names.lettered[x] for x in short if x in names.lettered]  # noqa: B023, E731
            if not plain:
                # Something agrees anyway.
                found.update(*rarest(1), *met(), *(names.initial.get(x, ()) for x in short))
            elif plain <= len(long):
                found.update(*rarest(plain))
            if least < plain:
                # An initial of the one stands for a word of the other.
                found.update(set().union(*met()).intersection(set().union(*rarest(least))) if least else set().union(*met()))
        one = "".join(said)
        # Two slips change four letters at most, however the words are written together.
        counts = np.frombuffer(self._counts(one), np.int32)
        for n in range(len(one) - 2, len(one) + 3) if len(one) > 5 else ():
            if n in self.joined:
                names, held = self.joined[n]
                far = np.abs(np.frombuffer(held, np.int32).reshape(-1, 32) - counts).sum(axis=1)
                found.update(names[k] for k in np.flatnonzero(far <= 4).tolist())
        if all(len(w) == 1 for w in said):
            found.update(self.initials.get(one, ()))
        if len(said) == 1:
            found.update(self.initials.get("+".join(sorted(one)), ()))
        return found


class _All:
    """The same for a few names, where looking at all is faster; the likelihoods decide alike."""

    def __init__(self):
        self.names: list[str] = []

    def add(self, name: str) -> None:
        self.names.append(name)

    def near(self, said: list[str]) -> list[str]:
        return self.names


def attribute(spellings: list[tuple[str, int]], common: frozenset[str] = frozenset()) -> dict[str, str]:
    """The name that each spelling of a block stands for, by maximum posterior."""
    return {s: name for s, (name, _) in posteriors(spellings, common).items()}


def posteriors(spellings: list[tuple[str, int]], common: frozenset[str] = frozenset()) -> dict[str, tuple[str, float]]:
    """The same with the logarithm of the posterior; for a spelling that is a name itself that of its frequency."""
    words = {s: s.split() for s, _ in spellings}
    counts = dict(spellings)
    indexed = _Words({w for ws in words.values() for w in ws if len(w) > 1}, common) if len(counts) > INDEXED_SPELLINGS else None
    made = lambda: _Names(indexed) if indexed else _All()
    # Full spellings before those with initials or nicknames; of these the one that explains most rows.
    initials = {s: [*map(len, words[s])].count(1) for s in counts}
    kind = {s: (initials[s] >= max(1, len(words[s]) - 1), not FULL_NAMES.keys().isdisjoint(words[s]), initials[s] > 0, len(words[s]) == 1) for s in counts}
    explained = {s: float(n) for s, n in spellings}
    full = sorted(s for s in counts if kind[s] == (False,) * 4)
    if len(full) > 2:
        known = made()
        for s in full:
            known.add(s)
        for o in full:
            for s in known.near(words[o]):
                if s != o and (fit := likelihood(words[o], words[s], common)) >= LEAST_LIKELIHOOD:
                    explained[s] += counts[o] * math.exp(fit / 4)
    order = sorted(counts, key=lambda s: (kind[s], -round(explained[s], 9), -len(s), s))
    names: dict[str, float] = {}
    known = made()
    result = {}
    for spelling in order:
        scored = [(math.log(names[name]) + fit, name) for name in known.near(words[spelling]) if (fit := likelihood(words[spelling], words[name], common)) >= LEAST_LIKELIHOOD]
        score, name = max(scored) if scored else (math.log(counts[spelling]), spelling)
        if name not in names:
            known.add(name)
        names[name] = names.get(name, 0.0) + counts[spelling]
        result[spelling] = (name, score)
    return result


def _shared_forms(words: list[str]) -> dict[str, set[int]]:
    """What a spelling shares with every one that may mean the same, and of which of its words that is (-1: of all).

    Two such spellings have a word in common but for slips, or an initial and a word, or
    are alike with all words written together, or have the same initials; see likelihood.
    Blocks are searched by the same forms of words.
    """
    found: dict[str, set[int]] = {}
    for i, w in enumerate(words):
        forms = {"!" + x for x in _letters(w)}
        if len(w) > 1:
            forms |= _word_forms(w, 40) | {"^" + w[:n] for n in range(2, len(w) + 1)} | ({"3" + w[k : k + 8] for k in range(len(w) - 7)} if len(w) >= 37 else set())
        for f in forms:
            found.setdefault(f, set()).add(i)
    for whole in {"".join(words), "".join(words[1:] + words[:1]), "".join(words[-1:] + words[:-1])}:
        for f in (_shortened(whole, 2) if len(whole) < 42 else set()) | ({whole[k : k + 8] for k in range(len(whole) - 7)} if len(whole) >= 38 else set()) if len(whole) > 5 else ():
            found.setdefault("=" + f, set()).add(-1)
    for f in {"".join(sorted(w[0] for w in words)), "".join(sorted(w[0] for w in words if w not in ("and", "the"))), "".join(sorted("".join(words))) if len(words) == 1 else ""} - {""}:
        found.setdefault("!!" + f, set()).add(-1)
    return found


def _number(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("|".join(map(str, parts))) - (1 << 63)


_VOWELS = frozenset("aeiouy")


def _skeleton(word: str) -> str:
    """A word by its first letter and its consonants, none twice in a row."""
    kept = last = word[0]
    for c in word[1:]:
        if c != last and c not in _VOWELS:
            kept += c
            last = c
    return kept


def _key_word(words: list[str]) -> str:
    """The skeleton of the longest of words, of all together if it is short, and their whole spelling if that is short too."""
    longest = max(sorted(words, reverse=True), key=len, default="")
    joined = longest if len(longest) >= SHORT else "".join(words)
    return _skeleton(joined) if len(joined) >= SHORT else joined


def _town(city: str) -> str:
    """The key of a town as it is spelled, or nothing."""
    words = [w for w in normal(city) if w not in AFFIXES and not w.isdigit()]
    whole = "".join(words)
    return "" if whole in NO_TOWNS or whole in NO_WORDS or max(words, key=len, default="") in NO_TOWNS else _key_word(words)


class Towns:
    """Keys of towns: that of the first name of the entry that is meant, however it is named, else that of the spelling."""

    def __init__(self, reference: list[tuple[int, list[str], str | None]] = ()):
        self.entries = Entries(reference) if reference else None
        self.first = {entry: _town(names[0]) for entry, names, _ in reference}
        spelled: dict[str, set[str]] = {}
        for entry, names, _ in reference:
            for name in names:
                spelled.setdefault(_town(name), set()).add(self.first[entry])
        # Spellings whose consonants are those of a name of the list need no search.
        self.known = {k: next(iter(v)) for k, v in spelled.items() if k and len(v) == 1}
        self.key = lru_cache(1 << 16)(self._key)

    def _key(self, city: str) -> str:
        town = _town(city)
        if town in self.known or self.entries is None:
            return self.known.get(town, town)
        return self.first.get(self.entries.meant(city)) or town


def place_key(branch: str | None, city: str | None, words: list[str], towns: Towns | None = None) -> int | None:
    """A key of the branch, the town and the longest word of a name, whatever their vowels; None if one of them is missing or says nothing.

    Short words count with their whole spelling, and a name of short words with all of them in any order.
    """
    town = (towns.key(city) if towns else _town(city)) if branch and city else ""
    name = _key_word(sorted(words)) if town else ""
    if not name:
        return None
    return _number(branch, town, name)


@lru_cache(2)
def _towns(reference: tuple) -> Towns:
    return Towns([(entry, list(names), code) for entry, names, code in reference])


def _keyed(worded: bool, sought=None, reference: tuple = ()) -> callable:
    """Hashes of the letters and digits of both columns; if worded, the words of each name too, and its place if a row without mailbox is sought there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        towns = _towns(reference)
        for batch in batches:
            name, mail = batch.column(0), batch.column(1)
            made = [*batch.columns[2:7], pa.array(hashes(name)), pa.array(hashes(mail))]
            if worded:
                words, places = [], []
                for a, b, swapped, branch, city in zip(name.to_pylist(), mail.to_pylist(), batch.column(2).to_pylist(), batch.column(7).to_pylist(), batch.column(8).to_pylist()):
                    found = name_words(b if swapped else a)
                    key = place_key(branch, city, found, towns)
                    words.append(" ".join(found))
                    places.append(key if key is None or sought is None or sought.value[key % SOUGHT_BITS >> 3] >> (key % SOUGHT_BITS & 7) & 1 else None)
                made += [pa.array(words, pa.string()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays(made, names=["swapped", "mailed", "phone", "home", "id", "n", "m", *(["words", "place"] if worded else [])])

    return run


def _attributed(common) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, spellings in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(key, s, name) for s, name in attribute([(x["words"], x["n"]) for x in spellings], common.value).items() if s != name]
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["key", "words", "name"])

    return run


def homes(names: list[tuple[str, int, int | None, int]], common: frozenset[str] = frozenset()) -> dict[str, tuple[int | str, float]]:
    """Where the rows without mailbox of one place belong, by their words, and how sure that is.

    names are (words, rows of the best host of that name, that host, rows without
    mailbox). Rows without mailbox go to the host that explains them best, or else
    to a name that others of their kind mean. Hosts are never linked here, whatever
    their names.
    """
    hosts = {w: (n, host) for w, n, host, _ in names if host is not None}
    lost = {w: n for w, _, _, n in names if n}
    known = _Names(_Words({w for x in (*hosts, *lost) for w in x.split() if len(w) > 1}, common)) if len(hosts) > INDEXED_SPELLINGS and len(lost) > SOUGHT_SPELLINGS else _All()
    for w in hosts:
        known.add(w)
    result: dict[str, tuple[int | str, float]] = {}
    rest = {}
    for said in lost:
        scored = [(math.log(hosts[m][0]) + fit, hosts[m][0], -hosts[m][1], hosts[m][1]) for m in known.near(said.split()) if (fit := likelihood(said.split(), m.split(), common)) >= LEAST_LIKELIHOOD]
        if scored:
            best = max(scored)
            # A host goes before a name without one.
            result[said] = (best[3], best[0] + 1_000.0)
        else:
            rest[said] = lost[said]
    for said, (name, score) in posteriors(sorted(rest.items()), common).items() if rest else ():
        if sum(rest.values()) > 1:
            result[said] = (name, score)
    return result


def _placed(common) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for key, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for words, (home, _) in homes([(r["words"], r["n"], r["host"], r["n_lost"]) for r in rows], common.value).items():
                    made.append((key, words, _number(key, home) if isinstance(home, str) else home))
            kinds = (pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], k) for i, k in enumerate(kinds)], names=["key", "words", "cluster"])

    return run


def _several(rows: DataFrame, *key: str) -> DataFrame:
    """The rows whose key other rows have too; counts are added up before they meet the rows, so a key that many have is not counted in one place.

    The counts look at every column, so that both sides come from one exchange of the rows.
    """
    every = F.max(F.xxhash64(*rows.columns)).alias("every")
    shared = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("members"), every).filter("members > 1 and every is not null").select(*key)
    return rows.join(shared, list(key), "left_semi")


def _blocks(rows: DataFrame, most: int, least: int = 2) -> DataFrame:
    """(key, rows): the rows (key, words, ...) of each key together, those of more than that many in tasks of their own.

    Blocks of fewer than least rows are left out.
    """
    held = [c for c in rows.columns if c != "key"]
    rows = cut(rows)
    together = lambda d: d.groupBy("key").agg(F.collect_list(F.struct(*held)).alias("rows")).select("key", "rows")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    small = together(rows.join(sizes.filter(F.col("size").between(least, most)).select("key"), "key", "left_semi"))
    crowded = cut(sizes.filter(F.col("size") > most).select("key"))
    n = crowded.count()
    if not n:
        return small
    wide = rows.join(F.broadcast(crowded) if n <= BROADCAST_BLOCKS else crowded, "key")
    return small.unionByName(together(wide).repartition(min(n, CROWDED_TASKS), "key"))


def _has_mail(c: Column) -> Column:
    return c.rlike(r"[^@\s]\s*@\s*[^@\s]")


def _rows(customers: DataFrame, worded: bool = False, homeless: bool = False, sought=None, reference: tuple = ()) -> DataFrame:
    """id, mail and phone (keys or null), nk (hash of customer_name), pair (hash of the two values), same (hash of all these); if worded, words and place too.

    homeless keeps only rows without mailbox. Texts go to Python once and don't come back.
    """
    rows = only(customers, {"record_id": "bigint", "customer_name": "string", "email": "string", "phone": "string", "branch_code": "string", "city": "string"}).filter("record_id is not null and customer_name is not null")
    rows = rows.withColumn("email", F.coalesce("email", F.lit("")))
    swapped = F.contains("customer_name", F.lit("@")) & ~F.contains("email", F.lit("@"))
    number = F.substring(F.regexp_replace("phone", "[^0-9]", ""), -9, 9)
    mailed = _has_mail(F.when(swapped, F.col("customer_name")).otherwise(F.col("email")))
    rows = rows.select(
        "customer_name", "email", swapped.alias("swapped"), mailed.alias("mailed"), F.when((F.length(number) >= 7) & ~number.rlike(r"^([0-9])\1*$"), F.xxhash64(F.lit("phone"), number)).alias("phone"),
        F.when(~mailed, F.xxhash64("branch_code", "city")).alias("home"), F.col("record_id").alias("id"), *(["branch_code", "city"] if worded else []),
    )
    rows = rows.filter("not mailed") if homeless else rows
    more = ", words string, place long" if worded else ""
    rows = rows.mapInArrow(_keyed(worded, sought, reference), "swapped boolean, mailed boolean, phone long, home long, id long, n long, m long" + more)
    rows = rows.select(
        "id", "phone", "home", F.col("n").alias("nk"), F.when(F.col("swapped"), F.col("m")).otherwise(F.col("n")).alias("who"), F.xxhash64(F.least("n", "m"), F.greatest("n", "m")).alias("pair"),
        F.when(F.col("mailed"), F.xxhash64(F.lit("mail"), F.when(F.col("swapped"), F.col("n")).otherwise(F.col("m")))).alias("mail"), *(["words", "place"] if worded else []),
    )
    return rows.select("id", "mail", "phone", "nk", "pair", F.xxhash64("mail", "phone", "who", "nk", "home").alias("same"), *(["words", "place"] if worded else []))


def _sought_places(customers: DataFrame, reference: tuple = ()):
    """A filter of the places of rows without mailbox, of fixed size."""
    lost = _rows(customers, worded=True, homeless=True, reference=reference)
    bit = F.pmod("place", F.lit(SOUGHT_BITS))
    filled = lost.filter("place is not null").groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(place, {SOUGHT_BITS}) % 64 as int))")).alias("bits"))
    bits = np.zeros(SOUGHT_BITS // 64, np.int64)
    for r in filled.collect():  # one row for 64 places, so no more than the filter has
        bits[r["at"]] = r.bits
    bits = bits.tobytes()
    return customers.sparkSession.sparkContext.broadcast(bits)


def _common_words(customers: DataFrame) -> frozenset[str]:
    """The words that many rows have; their number is bounded by words per row over COMMON_SHARE."""
    names = only(customers, {"customer_name": "string"}).dropna()
    total = names.count()
    words = names.select(F.explode(F.array_distinct(F.split(F.lower("customer_name"), r"[^\p{L}]+"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    common = words.filter((F.col("n") >= max(20, COMMON_SHARE * total)) & (F.length("word") > 2)).select("word")
    return frozenset(w for r in common.toLocalIterator() for w in name_words(r.word))


def _linking(links: DataFrame) -> DataFrame:
    """The distinct links (same, cluster) of the clusters that several have; the others connect nothing."""
    several = links.groupBy("cluster").agg(F.min("same").alias("least"), F.max("same").alias("most")).filter("least <> most").select("cluster")
    return links.join(several, "cluster", "left_semi").select("same", "cluster").distinct()


def _connected(links: DataFrame) -> DataFrame:
    """(same, entity): the part of the links (same, cluster) that each one is connected to; those connected to none are left out.

    Each first goes to its smallest cluster. Most parts are whole then, so only
    clusters whose members went to different ones are followed further.
    """
    links = cut(_linking(links))
    first = cut(links.groupBy("same").agg(F.min("cluster").alias("entity")))
    left = cut(_linking(links.join(first, "same").select(F.col("entity").alias("same"), "cluster")))
    # The smallest cluster that a chain reaches becomes the entity; labels also skip along chains, so few rounds are needed.
    live = cut(left.groupBy("same").agg(F.min("cluster").alias("entity")))
    while True:
        reached = cut(left.join(live, "same").groupBy("cluster").agg(F.min("entity").alias("entity"), F.max("entity").alias("other")))
        if reached.filter("entity <> other").isEmpty():
            break
        further = reached.select(F.col("cluster").alias("entity"), F.col("entity").alias("further"))
        skipped = reached.join(further, "entity", "left").select("cluster", F.coalesce(F.least("entity", "further"), "entity").alias("entity"))
        live = cut(left.join(skipped, "cluster").groupBy("same").agg(F.min("entity").alias("entity")))
    further = live.select(F.col("same").alias("entity"), F.col("entity").alias("further"))
    return first.join(further, "entity", "left").select("same", F.coalesce("further", "entity").alias("entity"))


def entities(customers: DataFrame, cities: DataFrame | None = None, block_spellings: int | None = None) -> DataFrame:
    """(id, nk, pair, entity): the entity of each row whose entity is written in several ways.

    Rows are of one entity if a chain of shared mailboxes or phones with the same
    attributed name connects them. Equal rows are counted before anything is
    shuffled by mailbox or phone, so a key that many copies share stays small. cities
    has the towns with their other names and codes; without it towns go by spelling.
    """
    # The list of towns goes to all tasks; it grows with the towns there are, not with the rows.
    reference = tuple((r.entry, tuple(r.names), r.code) for r in city_reference(cities).orderBy("entry").toLocalIterator()) if cities is not None else ()
    worded = _rows(customers, worded=True, sought=_sought_places(customers, reference), reference=reference)
    groups = worded.filter("mail is not null or phone is not null or place is not null").groupBy("mail", "phone", "place", "same", "words").agg(F.count(F.lit(1)).alias("n"))
    common = customers.sparkSession.sparkContext.broadcast(_common_words(customers))
    keys = F.filter(F.array(*(F.struct(F.col(k).alias("key"), F.lit(k == "place").alias("placed")) for k in ("mail", "phone", "place"))), lambda x: x["key"].isNotNull())
    held = groups.select(F.explode(keys).alias("k"), F.col("mail").isNull().alias("lost"), "same", "words", "n").select("k.key", "k.placed", "lost", "same", "words", "n")
    # Keys of a single group link nothing; the others are a fraction of all.
    held = cut(_several(held, "key"))
    spelled = held.filter("words <> '' and not placed").groupBy("key", "words").agg(F.sum("n").alias("n"))
    named = cut(_blocks(spelled, block_spellings or BLOCK_SPELLINGS).mapInArrow(_attributed(common), "key long, words string, name string"))
    links = held.filter("not placed").join(named, ["key", "words"], "left").select("same", F.xxhash64("key", F.coalesce("name", "words")).alias("cluster"))
    at_place = held.filter("placed and words <> ''")
    best = F.max(F.when(~F.col("lost"), F.struct("n", (-F.col("same")).alias("least"))))
    places = at_place.groupBy("key", "words").agg(best.alias("best"), F.coalesce(F.sum(F.when(F.col("lost"), F.col("n"))), F.lit(0)).alias("n_lost"))
    places = places.select("key", "words", F.coalesce("best.n", F.lit(0)).cast("long").alias("n"), (-F.col("best.least")).alias("host"), "n_lost")
    seeking = places.groupBy("key").agg(F.max("n_lost").alias("n")).filter("n > 0").select("key")
    blocks = _blocks(places.join(seeking, "key", "left_semi"), block_spellings or BLOCK_SPELLINGS, least=1)
    placed = cut(blocks.mapInArrow(_placed(common), "key long, words string, cluster long"))
    links = links.unionByName(at_place.filter("lost").join(placed, ["key", "words"]).select("same", "cluster")).unionByName(placed.select(F.col("cluster").alias("same"), "cluster"))
    live = _connected(links)
    linked = cut(_rows(customers).select("id", "nk", "pair", "same").join(live, "same").select("id", "nk", "pair", "entity"))
    # Entities of a single spelling are no variants.
    several = linked.groupBy("entity").agg(F.min("nk").alias("least"), F.max("nk").alias("most")).filter("least <> most").select("entity")
    return linked.join(several, "entity", "left_semi")


def variant_pairs(customers: DataFrame, cities: DataFrame | None = None) -> DataFrame:
    """(record_id_a, record_id_b), a < b: rows of one entity whose names differ in letters and digits.

    Rows that hold the same letters and digits in name and mailbox, in either order,
    are copies and no pair. Rows without name, or with neither mailbox nor phone,
    have no pairs; blank names are no spelling. Rows are distinct.
    """
    rows = entities(customers, cities)
    # Pairs of spellings first: rows of one spelling, however many, never meet each other.
    spellings = rows.select("entity", "nk").distinct()
    different = spellings.toDF("entity", "nk_a").join(spellings.toDF("entity", "nk_b"), "entity").filter("nk_a < nk_b")
    one = rows.select("entity", F.col("nk").alias("nk_a"), F.col("id").alias("id_a"), F.col("pair").alias("pair_a"))
    two = rows.select("entity", F.col("nk").alias("nk_b"), F.col("id").alias("id_b"), F.col("pair").alias("pair_b"))
    pairs = one.join(different, ["entity", "nk_a"]).join(two, ["entity", "nk_b"]).filter("pair_a <> pair_b and id_a <> id_b")
    return pairs.select(F.least("id_a", "id_b").alias("record_id_a"), F.greatest("id_a", "id_b").alias("record_id_b")).distinct()


def entity_rows(customers: DataFrame, cities: DataFrame | None = None) -> DataFrame:
    """(record_id, entity_id) of the rows of entities that are written in several ways; entity_id is the smallest record_id."""
    rows = entities(customers, cities).select("id", "entity").distinct()
    first = rows.groupBy("entity").agg(F.min("id").alias("entity_id"))
    return rows.join(first, "entity").select(F.col("id").alias("record_id"), "entity_id")
