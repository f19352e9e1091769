"""Scores of abusive, hateful and sexually explicit language.

Misspelled and disguised terms are found by walking a lexicon trie together
with the Levenshtein automaton of each word. A term by itself decides little: in
the window around it, its sentence, the operator looks for somebody it is aimed
at, for a people, for bodies, threats and wishes, and for what turns use into
mention: talk about words, about oneself, about things, health or art. Each of
these is a feature with a weight; the weights are fitted to human labels, and
stay near their given values where there are few labels.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.leakage import TAG
from scrubline.session import cut, only

CATEGORIES = ("abuse", "hate", "sexual")
#: Score from which a document has a category, and most words of a window.
THRESHOLD, WINDOW = 3.0, 40
#: Words before an insult within which it is said of oneself, and words around a term within which it is mentioned or means something else.
NEAR, AROUND = 5, 6
#: Labelled documents to which weights are fitted at most (those of the smallest hashes), and how strongly given weights hold.
FIT_DOCUMENTS, HOLD = 20_000, 100.0
#: Vocabulary of a public tokenizer; its whole words are words of their own and no misspellings.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
#: Rank in that vocabulary up to which a word is so frequent that a slip in it is likelier than one in a term.
FREQUENT = 2_500

# Terms by what they say. Words of typed-over classes are also found misspelled; the others as written.
TERMS = {
    "insult": (
        "idiot idiots moron morons imbecile imbeciles cretin cretins halfwit halfwits dimwit dimwits nitwit numbskull dumbass dipshit jackass scumbag scumbags lowlife degenerate bastard bastards asshole assholes arsehole"
        " bitch bitches cunt dickhead douchebag retard retards twat wanker prick motherfucker loser losers vollidiot idioten arschloch wichser hurensohn trottel dummkopf versager missgeburt idiota idiotas imbecil gilipollas cabron pendejo"
        " connard salaud encule abruti slut whore hure puta puto"
    ).split()
    + ["waste of oxygen", "waste of space", "waste of air", "waste of skin", "piece of trash", "piece of shit", "piece of garbage", "piece of filth", "stück dreck", "hijo de puta"],
    "creature": "pig pigs swine worm worms maggot maggots rat rats toad ape parasite parasites leech cockroach vermin clown clowns fool fools buffoon scum parasito cerdo schwein ratte".split(),
    "contempt": (
        "useless worthless pathetic filthy disgusting miserable stupid braindead brainless spineless gutless repulsive revolting ignorant lying vile nasty loathsome despicable dumb ugly hideous clueless moronic idiotic damlich damliches damlicher maldito maldita verdammter verfluchter inutil asqueroso estupido dreckig widerlich erbarmlich"
    ).split(),
    "curse": ["go to hell", "rot in hell", "burn in hell", "shut your mouth", "shut up", "get lost", "fuck off", "fuck you", "screw you", "piss off", "crawl back", "halt die fresse", "die fresse", "halt endlich", "verpiss dich", "vete a la mierda", "ta gueule", "va te faire"],
    "deathwish": ["drop dead", "stop breathing", "stop living", "kill yourself", "hang yourself", "shoot yourself", "hope you die", "hope you choke", "hope you rot", "deserve to die", "should be dead", "kill you", "cut your throat", "on your grave", "end your life"],
    "gone": "die dies died dead death vanish vanished vanishes disappear disappeared gone muere sterben".split(),
    "harm": "break breaks slash smash beat punch stab burn crush strangle choke cut hurt kick kill slap".split(),
    "body": "face faces head neck throat fingers finger leg legs teeth jaw skull bones knees ribs nose eyes fat body kopf gesicht cara".split(),
    "threat": ["regret", "revenge", "watch your back", "where you live", "find you", "come for you", "hunt you", "pay for this", "meet you in person"],
    "injury": "ambulance hospital coffin morgue grave wheelchair stretcher".split(),
    "sick": ["throw up", "vomit", "puke", "makes me sick", "make me sick", "insult", "asco"],
    "mock": ["laugh at", "laughs at", "hates you", "hate you", "despise you", "miss you"],
    "kin": "mother father mom mum dad parents madre padre mutter vater".split(),
    "brain": "brain brains iq".split(),
    "wish": "hope wish ought favour favor".split(),
    "expel": (
        ["locked up", "kept away", "keep away", "thrown out", "throw out", "kick out", "kicked out", "out of our", "send back", "send them back", "sent back", "go back", "away from", "get rid", "rid of", "done with them", "moved in", "gehören raus", "raus hier"]
        + "deport deported expel expelled exterminate exterminated gas gassed eradicate cleanse ban banned sterilise rausgeworfen fuera ausweisen verschwinden".split()
    ),
    "deny": ["not be allowed", "should be allowed", "be allowed to", "not a real", "not real", "never trust", "do not trust", "no right", "not human", "less than human", "only good", "treat them like", "not welcome"],
    "beast": "animals animal rats vermin cockroaches cattle swine pigs parasites savages beasts subhuman subhumans untermenschen barbarians plague disease cancer ungeziefer ratas plaga escoria vermine invaders".split(),
    "dirt": "filth filthy dirty stink stinks stinking smell smells smelly wash scum diseased dirt dreckig sucios".split(),
    "crime": "thief thieves criminals criminal liars rapists terrorists murderers crooks ladrones diebe verbrecher".split(),
    "inferior": ["primitive", "inferior", "backward", "uncivilised", "uncivilized", "breed", "breeding", "breeds", "in their blood", "their kind", "swamp", "born to"],
    "every": ["they are all", "they all", "every last", "all of them", "all those", "each and every", "alle", "todos"],
    "people": "people immigrants immigrant foreigners foreigner migrants refugees jews muslims gypsies gays women race kind tribe men country religion quarter hands auslander extranjeros inmigrantes personas".split(),
    "explicit": (
        "xxx porn porno pornographic nudes blowjob pussy cumshot gangbang masturbate orgasm sexcam camgirls dildo cock fuck fucked hardcore nackte desnudas calientes escorts"
    ).split()
    + ["fuck me", "suck my", "so wet for", "get so hard", "dirty sex", "had sex", "both came", "adult room", "sex chat", "erotic massage", "nackt vor der kamera"],
    "undress": "naked nude bare panties underwear bra stockings lingerie topless undressed nackt desnuda".split() + ["nothing on", "nothing but", "wearing nothing"],
    "flesh": "breasts breast tits thighs butt ass lips belly nipples crotch skin".split(),
    "act": "sex lick licked moan moaned moans kissed touch touched horny sweaty wet ride rides thrust begged pulled slid cam".split(),
    "offer": ["uncensored", "singles", "lonely wives", "no strings", "on cam", "no limits", "watch them", "private video", "everything shown", "join the", "waiting on", "live for free"],
    # What turns a term into a mention, or into another meaning.
    "self": ["i am", "i was", "i feel", "i felt", "feel like", "felt like", "myself", "call me", "my own", "i must be", "me siento"],
    "mention": "word words filter flagged lyrics phrase term quoting spelling title titled quote moderator report reports reported reporting glossary dictionary song named called calls slur translation translates definition".split(),
    "health": "cancer screening clinic health contraception medical vaccine treatment infection vet patient symptoms veterinary nurse checkup hormone".split(),
    "art": "marble statue figure painting museum exhibition sculpture eye novel chapter film recipe festival cuisine history".split(),
    "thing": "file phone proof fish guinea chicks machine tool cable printer switch code script engine error proofing button mode farm barn feed filament gear".split(),
    "you": "you your youre yours yourself u ur du dich dir dein deine deiner euch tu tus te vous usted ti eres bist".split(),
    "nobody": "nobody everyone everybody niemand nadie".split(),
}
#: Classes whose words are also found misspelled.
TYPED_OVER = ("insult", "creature", "contempt", "beast", "dirt", "crime", "explicit", "undress", "flesh", "inferior")
#: Words that may stand between a target and an insult, and words that may follow an insult.
BEFORE = frozenset("a an the such what you are is am was like of total complete little old fucking bloody kompletter ein eine un una eres bist sind only".split())
AFTER = frozenset("and or but who that would will is are was has you your like of in on at to for from with so as if not just again always never could should did does knows und der die wie y o que como".split())
#: Endings of names of peoples.
PEOPLE_NAME = re.compile(r"[A-Z][a-z]{2,}(?:ish|ese|ites?|ians?|ari|vani|tani|ards?)$|[A-Z]{2,}(?:ISH|ESE|ITES?|IANS?|ARI|VANI|TANI)$")
PLAIN_PEOPLE_NAME = re.compile(r"[a-z]{3,}(?:ese|ites?|ians?|ish|vani|tari)$")
#: Letters that stand for others in disguised words.
HOMOGLYPHS = str.maketrans("аеорсухіјѕԁһкмтвнгαεορτικνυ‘’", "aeopcyxijsdhkmtbhraeoptiknu''")
DISGUISES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "il", "|": "il", "€": "e", "+": "t"}
TOKEN = re.compile(r"[\w*@$|€+#%][\w*@$!|€+#%]*(?:[-_.'’][\w*@$|€+#%][\w*@$!|€+#%]*)*|[.!?]+(?=\s|$)|[,:;]")
SPELLED = re.compile(r"(?<![\w])\w([ .\-_*])(?:\w\1)+\w(?![\w])")
FORMAT = re.compile("[­؜᠎​-‏‪-‮⁠-⁤⁦-⁯﻿]")
USER = "@user"

# The features of each category and the weights they start from. a&b: both stand in the window.
FEATURES = {
    "abuse": {
        "insult": 2.5, "insult2": 0.5, "aimed": 1.0, "aimed_creature": 2.5, "foul_creature": 2.0, "contempt": 1.0, "contempt2": 0.5, "target": 0.5, "target&curse": 2.0, "deathwish": 1.25, "target&deathwish": 1.5, "wish&deathwish": 1.75, "target&gone": 0.5, "your&harm": 0.75, "your&harm&body": 2.25,
        "target&threat": 2.0, "target&threat2": 1.0, "target&injury": 2.5, "target&sick": 1.5, "target&sick2": 1.5, "target&mock": 1.5, "your&kin&body": 2.5, "your&brain": 1.0, "target&expel": 2.5, "target&expel2": 0.25, "your&wish&body": 1.25, "nobody&target": 0.5,
        "said_of_self": -3.0, "mention": -2.0, "compound": -2.5, "health": -1.5, "art": -0.5, "thing": -0.5, "group": -0.5,
    },
    "hate": {
        "group": 1.25, "group2": 0.25, "group&expel": 1.75, "group&deny": 2.0, "group&beast": 2.25, "group&dirt": 1.25, "group&crime": 1.25, "group&inferior": 2.0, "group&every": 0.75, "group&harm": 1.0, "group&gone": 0.75,
        "people&beast": 1.5, "people&expel": 1.0, "people&deny": 0.75, "people&inferior": 1.5, "people&crime": 0.5, "people": 0.25, "beast": 0.5, "every&beast": 0.75, "insult": -0.5, "mention": -2.0, "health": -1.0, "art": -1.5, "thing": -0.25, "target": -0.25,
    },
    "sexual": {
        "explicit": 2.5, "explicit2": 0.75, "undress": 1.0, "undress2": 0.5, "flesh": 1.0, "flesh2": 0.5, "act": 0.75, "act2": 0.75, "offer": 0.75, "offer2": 0.75, "undress&flesh": 0.5, "undress&act": 0.75, "flesh&act": 1.0, "act&offer": 0.75, "undress&offer": 1.0, "target&flesh": 0.25, "target&undress": 0.75,
        "mention": -2.0, "health": -2.5, "art": -2.0, "thing": -1.0,
    },
}
NAMES = {c: list(w) for c, w in FEATURES.items()}
_TERMS = ("insult", "creature", "contempt", "beast", "group", "explicit", "undress", "flesh")
_TURNING = ("mention", "health", "art", "thing")
_TRIGGERS = {"abuse": {"insult", "creature", "contempt", "curse", "deathwish", "harm", "threat", "injury", "sick", "mock", "kin", "brain", "expel", "gone"}, "hate": {"group", "people", "beast"}, "sexual": {"explicit", "undress", "flesh", "act", "offer"}}


def _plain(word: str) -> str:
    if word.isascii():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


class Trie:
    """Words; walked with the Levenshtein automaton of a word."""

    def __init__(self, words: set[str]):
        self.root: dict = {}
        for word in words:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = word

    def find(self, letters: list[str], most: int) -> list[tuple[int, str]]:
        """(edits, word) for the words within most edits of a word, given as the letters each place may be ('*': any)."""
        found: list[tuple[int, str]] = []
        stack = [(self.root, list(range(len(letters) + 1)), None, "")]
        while stack:
            node, row, above, last = stack.pop()
            for c, below in node.items():
                if c == "":
                    if row[-1] <= most:
                        found.append((row[-1], below))
                    continue
                now = [row[0] + 1]
                for j, options in enumerate(letters, 1):
                    d = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (c not in options and options != "*"))
                    # Two neighbours in the wrong order are one slip.
                    if above is not None and j > 1 and c in letters[j - 2] and last in options:
                        d = min(d, above[j - 2] + 1)
                    now.append(d)
                if min(now) <= most:
                    stack.append((below, now, row, c))
        return sorted(found)


def edits_allowed(word: str) -> int:
    """Slips that a term may hold: none under 5 letters, one up to 8, two beyond."""
    return 0 if len(word) < 5 else 1 if len(word) < 9 else 2


def _shorter(word: str) -> set[str]:
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


class Lexicon:
    """The terms, and the words that stand for them.

    common maps words that are none of them, whatever they resemble, to their rank in frequency.
    """

    def __init__(self, common: dict[str, int] | None = None):
        self.common = common or {}
        self.frequent = {f for w, rank in self.common.items() if rank < FREQUENT and len(w) > 4 for f in _shorter(w)}
        self.classes: dict[str, set[str]] = {}
        self.phrases: dict[str, list[tuple[tuple[str, ...], str]]] = {}
        loose, joined = set(), {}
        for kind, texts in TERMS.items():
            for text in texts:
                parts = tuple(_plain(text).split())
                if len(parts) == 1:
                    self.classes.setdefault(parts[0], set()).add(kind)
                else:
                    self.phrases.setdefault(parts[0], []).append((parts, kind))
                    joined["".join(parts)] = parts
                    loose.update(p for p in parts if kind in TYPED_OVER and len(p) > 4)
                if kind in TYPED_OVER and len(parts) == 1:
                    loose.add(parts[0])
        self.joined = joined
        self.known = set(self.classes) | set(self.phrases) | {p for ps in self.phrases.values() for parts, _ in ps for p in parts}
        self.trie, self.exact = Trie(loose), Trie(self.known | set(joined))
        kinds = set().union(*_TRIGGERS.values())
        self.starts = {w for w, k in self.classes.items() if k & kinds} | {w for w, ps in self.phrases.items() if any(k in kinds for _, k in ps)}
        self.read = lru_cache(1 << 18)(self._read)

    def _read(self, token: str) -> tuple[str, bool]:
        """The term that a token stands for, and whether a window with it needs a look."""
        word = self._word(token)
        return word, word in self.starts or word.isalpha() and word not in self.known and _names_people(token, word in self.common)

    def _slip_of_frequent(self, word: str) -> bool:
        """Whether a word may be one of the commonest words with one slip."""
        return not self.frequent.isdisjoint(_shorter(word))

    def _word(self, token: str) -> str:
        """The term that token stands for, or token itself in lower case."""
        word = re.sub(r"['’]s$", "", _plain(token.translate(HOMOGLYPHS)))
        word = word.replace("'", "").replace("’", "")
        if word in self.known or word in self.joined:
            return word
        bare = word.strip("*!|+.#%")
        if not bare or sum(c.isalpha() for c in word) == 0:
            return bare
        if word.isalpha() and word in self.common:
            return word
        short = re.sub(r"(.)\1{2,}", r"\1", word)
        if short != word and (short in self.known or short in self.joined):
            return short
        if len(short) == 2 and not short.isalpha():
            found = self.exact.find([DISGUISES.get(c, "") + c for c in short], 0)
            return found[0][1] if found else bare
        if len(short) < 3 or re.search(r"[-_.]", short) and short.replace("-", "").replace("_", "").replace(".", "").isalpha() and not re.fullmatch(r"(?:\w[-_.])+\w", short):
            return bare
        plain = re.sub(r"[-_.]", "", short)
        letters = ["*" if c in "*#%" else DISGUISES.get(c, "") + c for c in plain]
        disguised = sum(len(x) > 1 or x == "*" for x in letters)
        if disguised:
            if disguised * 2 > len(letters) + 2:
                return bare
            if found := self.exact.find(letters, 0):
                return found[0][1]
        if plain.isalpha() or disguised:
            # The first letter must be right, or stand behind one too many.
            most = 0 if self._slip_of_frequent(plain) else edits_allowed(plain)
            found = [(d, w) for d, w in self.trie.find(letters, most) if d <= edits_allowed(w) and (w[0] in letters[0] or letters[0] == "*" or len(letters) > len(w) and w[0] in letters[1]) and len(w) > 4] if most else []
            if found:
                return found[0][1]
        return bare


@lru_cache(4)
def common_words(path: str) -> dict[str, int]:
    """The whole words in the vocabulary of a tokenizer with their ranks; frequent words were merged first."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    return {w[:-4]: rank for w, rank in vocabulary.items() if w.endswith("</w>") and w[:-4].isalpha() and len(w) > 7}


def windows(text: str, lexicon: Lexicon) -> Iterator[list[tuple[str, str]]]:
    """The sentences of a text that hold some term, as (term or word, token), long ones in overlapping parts; disguises undone, users named @user."""
    text = TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = FORMAT.sub("", unicodedata.normalize("NFKC", text))
    text = SPELLED.sub(lambda m: re.sub(r"[^\w]|_", "", m[0]), text)
    sentence: list[tuple[str, str]] = []
    hot = False
    for m in TOKEN.finditer(text):
        token = m[0]
        if token[0] in ".!?":
            if hot:
                yield from _parts(sentence)
            sentence, hot = [], False
            continue
        if token in ",:;":
            sentence.append((token, token))
            continue
        word, tells = lexicon.read(token)
        hot = hot or tells
        if word in lexicon.joined:
            sentence += [(p, token) for p in lexicon.joined[word]]
            hot = True
        elif word in lexicon.known or word.isalpha():
            sentence.append((word, token))
        elif _is_user(word, token):
            sentence.append((USER, token))
        else:
            for part in re.split(r"[-_.]", word):
                if part:
                    inner, tells = lexicon.read(part)
                    sentence.append((inner, part))
                    hot = hot or tells
    if hot:
        yield from _parts(sentence)


def _is_user(word: str, token: str) -> bool:
    """Whether a word is the name of a user: names carry digits or marks; other compounds are words."""
    if re.fullmatch(r"[a-z]{4,}\d+", word):
        return True
    parts = re.split(r"[-_.]", word)
    return len(parts) > 1 and all(parts) and bool(re.search(r"\d|_", token) or len(parts) == 2 and "'" not in token and all(len(p) > 2 for p in parts))


def _parts(sentence: list[tuple[str, str]]) -> Iterator[list[tuple[str, str]]]:
    for i in range(0, max(1, len(sentence) - WINDOW // 2), WINDOW // 2):
        yield sentence[i : i + WINDOW]


@lru_cache(1 << 16)
def _names_people(token: str, common: bool) -> bool:
    """Whether a word has the form of a people's name; common words only where they are capitalised."""
    return bool(PEOPLE_NAME.match(token) or not common and PLAIN_PEOPLE_NAME.match(token))


def _aimed(words: list[str], i: int, classes: dict[str, set[str]]) -> bool:
    """Whether the insult at i is said to somebody: behind you, or a name and is, before like you, or called out between marks."""
    following = words[i + 1] if i + 1 < len(words) else ","
    j = i - 1
    while j >= 0 and ("contempt" in classes.get(words[j], ()) or words[j] == "," and j + 1 < i and "contempt" in classes.get(words[j - 1], ()) or "insult" in classes.get(words[j], ()) and j > i - 4):
        j -= 1
    if j >= 0 and words[j] in ("you", "du"):
        return True
    if following == "like" and i + 2 < len(words) and (words[i + 2] == USER or "you" in classes.get(words[i + 2], ())):
        return True
    if following not in ",:;" and following != USER and following not in AFTER and "contempt" not in classes.get(following, ()):
        return False
    if j < 0 or words[j] in ",:;":
        return True
    if words[j] not in BEFORE:
        return False
    before = words[max(0, j - 3) : j + 1]
    # What stands before a mark is another clause.
    marks = [k for k, w in enumerate(before) if w in ",:;"]
    before = before[marks[-1] + 1 :] if marks else before
    if any(w == USER or w in ("you", "du", "such", "what") for w in before):
        return True
    return before[-1:] == ["a"] and len(before) > 1 and before[-2] == "is" and following in ",:;"


def features(window: list[tuple[str, str]], lexicon: Lexicon) -> dict[str, float]:
    """What a window holds: classes of terms by name, 2 behind it from two terms on, and what they are to each other."""
    words = [w for w, _ in window]
    found: dict[str, set] = {}
    places: dict[str, list[int]] = {}
    compound = True
    for i, word in enumerate(words):
        hits: list[tuple[str, object, int]] = [(kind, word, 1) for kind in lexicon.classes.get(word, ())]
        hits += [(kind, parts, len(parts)) for parts, kind in lexicon.phrases.get(word, ()) if tuple(words[i : i + len(parts)]) == parts]
        if word == USER:
            hits.append(("you", word, 1))
        elif word.isalpha() and word not in lexicon.known and _names_people(window[i][1], word in lexicon.common):
            hits.append(("group", word, 1))
        for kind, term, n in hits:
            found.setdefault(kind, set()).add(term)
            places.setdefault(kind, []).append(i)
            if kind in ("insult", "creature"):
                aimed = n == 1 and _aimed(words, i, lexicon.classes) or n > 1 and _aimed([*words[: i + 1], *words[i + n :]], i, lexicon.classes)
                if aimed:
                    found.setdefault("aimed" if kind == "insult" else "aimed_creature", set()).add(term)
                if kind == "insult":
                    following = words[i + n] if i + n < len(words) else ","
                    compound = compound and n == 1 and not aimed and following not in ",:;" and following != USER and following not in AFTER and "contempt" not in lexicon.classes.get(following, ())
    made = {k: 1.0 for k in found if k not in _TURNING} | {k + "2": 1.0 for k, v in found.items() if len(v) > 1}
    if "you" in made:
        made["target"] = 1.0
        if any(w in ("your", "youre", "yours", "dein", "deine", "tu", "tus") for w in words):
            made["your"] = 1.0
    if "insult" in made and compound:
        made["compound"] = 1.0
    terms = [i for k in _TERMS for i in places.get(k, ())]
    if any(0 < i - j <= NEAR for j in places.get("self", ()) for k in ("insult", "creature") for i in places.get(k, ())):
        made["said_of_self"] = 1.0
    if any(abs(i - j) <= AROUND for i in places.get("creature", ()) for j in places.get("contempt", ())):
        made["foul_creature"] = 1.0
    if any(k in places for k in _TURNING):
        clauses = np.cumsum([w in ",:;" for w in words]).tolist()
        for kind in _TURNING:
            if any(abs(i - j) <= AROUND and clauses[i] == clauses[j] for j in places.get(kind, ()) for i in terms):
                made[kind] = 1.0
    return made


def _vector(made: dict[str, float], category: str) -> list[float]:
    return [float(all(p in made for p in name.split("&"))) for name in NAMES[category]]


def best_windows(text: str, lexicon: Lexicon, weights: dict[str, list[float]]) -> dict[str, tuple[float, list[float]]]:
    """For each category the score of the window that has it most, and the features of that window."""
    best = {c: (0.0, [0.0] * len(NAMES[c])) for c in CATEGORIES}
    for window in windows(text, lexicon):
        made = features(window, lexicon)
        for c in CATEGORIES:
            if not made.keys().isdisjoint(_TRIGGERS[c]):
                vector = _vector(made, c)
                score = sum(w for w, x in zip(weights[c], vector) if x)
                if score > best[c][0]:
                    best[c] = (score, vector)
    return best


def given_weights() -> dict[str, list[float]]:
    return {c: list(w.values()) for c, w in FEATURES.items()}


def scores(text: str, lexicon: Lexicon | None = None, weights: dict[str, list[float]] | None = None) -> dict[str, float]:
    """The score of each category: the highest of any window."""
    found = best_windows(text, lexicon or Lexicon(), weights or given_weights())
    return {c: s for c, (s, _) in found.items()}


def fit(vectors: np.ndarray, labels: np.ndarray, given: np.ndarray, hold: float = HOLD, rounds: int = 200) -> np.ndarray:
    """Weights of a logistic regression with a fixed threshold, held to given ones by a normal prior, and no further from 0 than to keep their sign."""
    weights = given.astype(float).copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-2 * (vectors @ weights - THRESHOLD)))
        slope = 2 * vectors.T @ (p - labels) + hold * (weights - given)
        curve = 4 * (vectors * (p * (1 - p))[:, None]).T @ vectors + hold * np.eye(len(given))
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return np.where(given > 0, np.maximum(weights, 0.0), np.minimum(weights, 0.0))


def _lexicon(vocabulary: str) -> Lexicon:
    return _cached(vocabulary)


@lru_cache(2)
def _cached(vocabulary: str) -> Lexicon:
    return Lexicon(common_words(vocabulary))


def fitted_weights(documents: DataFrame, labels: DataFrame, vocabulary: str = VOCABULARY, most: int = FIT_DOCUMENTS) -> dict[str, list[float]]:
    """Weights fitted to labels (doc_id, is_abusive, category) of at most that many documents.

    A document has a category if most of its raters found it abusive and one of them
    said which; documents that most found harmless have none. The others, and
    documents without text, have no say. Few or no labels leave the given weights.
    """
    said = only(labels, {"doc_id": "bigint", "is_abusive": "int", "category": "string"}).filter("doc_id is not null and is_abusive is not null")
    votes = said.groupBy("doc_id").agg(F.avg("is_abusive").alias("share"), F.collect_set(F.lower("category")).alias("kinds"))
    votes = votes.filter("share <> 0.5").orderBy(F.xxhash64("doc_id")).limit(most)  # the bound of the sample
    texts = only(documents, {"doc_id": "bigint", "text": "string"}).dropna().join(F.broadcast(votes), "doc_id").select("text", "share", "kinds")
    given = given_weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [best_windows(t, _lexicon(vocabulary), given) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *(pa.array([f[c][1] for f in found], pa.list_(pa.float64())) for c in CATEGORIES)], names=["share", "kinds", *CATEGORIES])

    rows = texts.mapInArrow(run, "share double, kinds array<string>, " + ", ".join(f"{c} array<double>" for c in CATEGORIES)).collect()
    made = {}
    for c in CATEGORIES:
        used = [(r[c], float(r.share > 0.5)) for r in rows if r.share < 0.5 or c in r.kinds]
        # Windows without any feature say nothing; labels on them are slips.
        used = [(v, y) for v, y in used if any(v)]
        made[c] = fit(np.array([v for v, _ in used]), np.array([y for _, y in used]), np.array(given[c])).tolist() if used else given[c]
    return made


def document_scores(documents: DataFrame, labels: DataFrame | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, abuse, hate, sexual): the scores of every document.

    Whole texts are read, quotes and spam included. labels, if given, are what the
    weights are fitted to. Null and empty texts score 0; repeated rows are scored
    each, further columns don't matter.
    """
    rows = only(documents, {"doc_id": "bigint", "source": "string", "text": "string"})
    weights = fitted_weights(documents, labels, vocabulary) if labels is not None else given_weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(vocabulary)
        none = dict.fromkeys(CATEGORIES, 0.0)
        for batch in batches:
            made = [scores(t, lexicon, weights) if t else none for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([round(m[c], 6) for m in made], pa.float64()) for c in CATEGORIES)], names=["doc_id", "source", *CATEGORIES])

    return rows.mapInArrow(run, "doc_id long, source string, " + ", ".join(f"{c} double" for c in CATEGORIES))


def abusive_documents(documents: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, category) for each category whose score reaches threshold; rows are distinct."""
    categories = F.array_compact(F.array(*(F.when(F.col(c) >= threshold, c) for c in CATEGORIES)))
    return document_scores(documents, labels, vocabulary).filter("doc_id is not null").select("doc_id", F.explode(categories).alias("category")).distinct()


def source_rates(documents: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD, vocabulary: str = VOCABULARY) -> DataFrame:
    """(source, n_docs, and for each category the share of documents that have it) for each source, null included."""
    shares = [F.avg((F.col(c) >= threshold).cast("double")).alias(f"{c}_rate") for c in CATEGORIES]
    return document_scores(documents, labels, vocabulary).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), *shares)
