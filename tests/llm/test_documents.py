"""Packing, leaked passages and abusive content against brute force and hard inputs."""

import random
import re

import pytest

from scrubline.llm import abusive_content, leakage, packing

DOCUMENT = "doc_id long, text string, source string, item_id long, n_tokens long, score double"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 1, 0.5) for i, t, s in rows], DOCUMENT)


# Packing


def sizes_of(spark, sizes):
    return spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long")


def packed(spark, sizes, *limits):
    names = spark.createDataFrame([(f"l{c}", c, "clash") for c in limits], "limit_name string, capacity_tokens int, doc_id string")
    return packing.packed(documents(spark, []), names, sizes=sizes_of(spark, sizes)).collect()


@pytest.mark.parametrize("sizes", [[], [0, 0], [5], [10, 10, 10], [25], [3, 7, 3, 7, 1], [0, 10, 4, 0, 31, 6], [1] * 57, [6] * 9])
def test_packing_is_whole_and_fits(spark, sizes):
    rows = packed(spark, sizes, 10)
    held, pieces, places = {}, {}, set()
    for r in rows:
        held[r.container_id] = held.get(r.container_id, 0) + r.n_tokens
        pieces.setdefault(r.doc_id, []).append((r.piece, r.begin_token, r.n_tokens))
        places.add((r.container_id, r.place))
    assert all(x <= 10 for x in held.values()) and len(places) == len(rows)
    assert set(pieces) == set(range(len(sizes)))
    for doc, n in enumerate(sizes):
        want = [(k, 10 * k, min(10, n - 10 * k)) for k in range(max(1, -(-n // 10)))]
        assert sorted(pieces[doc]) == want
    assert sorted(held) == list(range(len(held)))


def test_packing_is_tight(spark):
    rng = random.Random(1)
    sizes = [rng.choice([rng.randint(1, 60), rng.randint(40, 130)]) for _ in range(3000)]
    rows = packed(spark, sizes, 128, 64)
    for capacity in (128, 64):
        own = [r for r in rows if r.limit_name == f"l{capacity}"]
        least = -(-sum(sizes) // capacity)
        assert max(r.container_id for r in own) + 1 <= 1.03 * least + 2


def test_configurations_use_the_whole_histogram():
    rng = random.Random(2)
    for _ in range(20):
        capacity = rng.randint(1, 300)
        histogram = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(rng.randint(1, 30))}
        configs = packing.pack(dict(histogram), capacity)
        used = {}
        for config, times in configs:
            assert times > 0 and sum(s * m for s, m in config.items()) <= capacity
            for s, m in config.items():
                used[s] = used.get(s, 0) + m * times
        assert used == histogram


def test_pricing_finds_the_best_configuration():
    import itertools

    import numpy as np

    rng = random.Random(3)
    for _ in range(30):
        sizes = np.array(sorted(rng.sample(range(1, 12), 3)))
        prices = np.array([rng.random() for _ in sizes])
        best = max(sum(p * k for p, k in zip(prices, ks)) for ks in itertools.product(range(13), repeat=3) if sum(s * k for s, k in zip(sizes, ks)) <= 12)
        config = packing._priced(prices, sizes, 12)
        assert (config * sizes).sum() <= 12 and (config * prices).sum() == pytest.approx(best)


def test_tokens_and_texts(spark):
    docs = documents(spark, [(1, "Hello world, hello tokens!", "s"), (2, None, "s"), (3, "", "s"), (4, "word " * 30_000, "s"), (None, "lost", "s")])
    limits = spark.createDataFrame([("a", 100), ("bad", 0), (None, 5), ("none", None)], "limit_name string, capacity_tokens int")
    counts = {r.doc_id: r.n_tokens for r in packing.token_counts(docs).collect()}
    assert counts[1] == len(packing.encoding(packing.TOKENIZER).encode_ordinary("Hello world, hello tokens!")) and counts[2] == counts[3] == 0
    rows = packing.packed(docs, limits).collect()
    assert {r.limit_name for r in rows} == {"a"} and {r.doc_id for r in rows} == {1, 2, 3, 4}
    assert sum(r.n_tokens for r in rows if r.doc_id == 4) == counts[4]


def test_hot_lengths_are_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_SALT", 20)
    rows = packed(spark, [3] * 300, 10)
    assert len({(r.container_id, r.place) for r in rows}) == 300 and max(r.container_id for r in rows) == 99


# Leaks

WORDS = [f"w{i}" for i in range(40)]


def brute(documents_, items, n):
    words = lambda t: re.findall(r"[^\W_]+", re.sub(r"<[^<>]*>|\[[^\[\]]*\]", " ", t).lower())
    found = set()
    for d, text in documents_:
        have = {tuple(words(text)[i : i + n]) for i in range(len(words(text)) - n + 1)}
        found |= {(d, i) for i, t in items if any(tuple(words(t)[k : k + n]) in have for k in range(len(words(t)) - n + 1))}
    return found


def items_of(spark, rows):
    return spark.createDataFrame([(i, "b", t, 7) for i, t in rows], "item_id long, bench_name string, item_text string, doc_id long")


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 30)))) for i in range(30)]
    items += [(30, items[0][1]), (31, ""), (30, items[0][1])]
    docs = []
    for d in range(120):
        text = [rng.choice(WORDS) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            part = rng.choice(items)[1].split()
            at = rng.randint(0, len(text))
            text[at:at] = part[rng.randint(0, 3) : rng.randint(8, 30)]
        docs.append((d, rng.choice([" ", ", ", "\n> ", " <b>"]).join(text).upper()))
    found = {tuple(r) for r in leakage.leaked_items(documents(spark, [(d, t, "s") for d, t in docs]), items_of(spark, items), 12).collect()}
    assert found == brute(docs, items, 12)
    assert {tuple(r) for r in leakage.leaked_passages(documents(spark, [(d, t, "s") for d, t in docs]), items_of(spark, items), 12, automaton_words=40).select("doc_id", "item_id").distinct().collect()} == found


def test_offsets_point_into_the_original(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    text = "x &amp; y <p class='a'>ONE [b]two[/b] three&nbsp;four five\n> six seven eight, nine &#116;en eleven twelve &eacute; end"
    row = leakage.leaked_passages(documents(spark, [(1, text, "s")]), items_of(spark, [(5, item)])).collect()[0]
    assert text[row.begin : row.end].startswith("ONE [b]two") and text[row.begin : row.end].endswith("twelve") and row.n_words == 12
    assert leakage.words("a&#116;b c")[0] == ["atb", "c"]
    begins, ends = leakage.words("a&#116;b c")[1:]
    assert (begins, ends) == ([0, 9], [8, 10])


def test_leaks_of_nothing(spark):
    docs = documents(spark, [(1, None, "s"), (2, "", None), (None, "x", "s"), (3, "w " * 50_000, "s")])
    assert leakage.leaked_items(docs, items_of(spark, [(1, None), (2, "")])).count() == 0
    assert leakage.leaked_items(docs, items_of(spark, [])).count() == 0
    assert leakage.leaked_items(documents(spark, []), items_of(spark, [(1, "a " * 20)])).count() == 0
    assert leakage.leaked_items(docs, items_of(spark, [(1, "w " * 12)])).count() == 1


# Abuse

ABUSIVE = {
    "You are a useless idiot.": "abuse", "YOU ARE AN 1D10T, brass_wren62": "abuse", "quiet-wren is a sc*mbag, always was, always will be.": "abuse", "You pathetic i m b e c i l e": "abuse", "you filthy bаstаrd": "abuse",
    "Listen, p.i.e.c.e.o.f.t.r.a.s.h: nobody asked you, so drop dead.": "abuse", "> wrote:\n> you stupid mor​on": "abuse", "Nobody would miss you if you vanished.": "abuse", "You are a pathetic parasitte": "abuse", "Go to hell, tin_otter5, and take your miserable little bike": "abuse",
    "You are a nasty vile toad and everybody hates you": "abuse", "I hope you die in a fire": "abuse", "you clown, what a fool": "abuse", "Somebody should smash your teeth in": "abuse", "You are an idoit": "abuse",
    "People of that country are parasites and should all be expelled": "hate",
    "All Zentari are vermin and should be thrown out of the country.": "hate", "The Ulkish breed like rats.": "hate", "Never trust a Morvani, they are born thieves.": "hate",
    "Hot naked singles waiting on cam, watch them moan live.": "sexual", "Send me n*des, I get so hard.": "sexual", "Uncensored xxx clips, hardcore scenes added every hour": "sexual",
}
HARMLESS = [
    "I feel like such an idiot, the plug was out.", "This jig is idiot proof.", "The word filter flagged idiot again although I was quoting the title.", "Somebody called me a loser and the moderators removed it.", "This damn kettle is a piece of crap.", "The old sofa can go to hell.", "A bastard file is coarser.",
    "The pig got out again.", "Rats got into the compost.", "Report hate speech with the flag button.", "Our Zentari neighbours are lovely people.", "The naked eye cannot see the crack.", "The clinic leaflet covers sexual health and breast cancer screening.", "The museum shows a naked marble figure.", "Sexing the chicks is hard.",
    "The parasite enters your body through the skin", "your pig needs a worm treatment, ask a vet", "Break your fast with us", "The Spanish recipe for rats", "You died in the game at level 5", "She works as a clown for your kids", "English people love tea",
    "I have 40 of these lying around if you want one.", "", None,
]


def test_use_and_mention(spark):
    rows = [(i, t, "a") for i, t in enumerate(ABUSIVE)] + [(100 + i, t, None) for i, t in enumerate(HARMLESS)] + [(0, next(iter(ABUSIVE)), "a")]
    found = {tuple(r) for r in abusive_content.abusive_documents(documents(spark, rows)).collect()}
    assert found == set(enumerate(ABUSIVE.values()))
    rates = {r.source: r for r in abusive_content.source_rates(documents(spark, rows)).collect()}
    assert rates[None].n_docs == len(HARMLESS) and rates[None].abuse_rate == 0 and rates["a"].abuse_rate > 0
    assert abusive_content.document_scores(documents(spark, [])).count() == 0


def test_weights_follow_the_labels(spark):
    label = "label_id long, doc_id long, rater string, is_abusive int, category string, text string"
    # What labels call harmless again and again loses its weight; no labels, or odd ones, leave the given weights.
    rows = [(i, f"You total lemon, thing {i} is a loser", "a") for i in range(400)]
    said = spark.createDataFrame([(i, i, "r", 0, None, "x") for i in range(400)], label)
    given = abusive_content.given_weights()
    made = abusive_content.fitted_weights(documents(spark, rows), said)
    place = abusive_content.NAMES["abuse"].index("insult")
    assert made["abuse"][place] < given["abuse"][place] - 0.5 and made["sexual"] == given["sexual"]
    assert abusive_content.fitted_weights(documents(spark, rows), spark.createDataFrame([(1, None, "r", 1, "abuse", "x"), (2, 3, "r", None, None, "x"), (3, 9_999, "r", 1, "odd", "x")], label)) == given
    assert {r.category for r in abusive_content.abusive_documents(documents(spark, rows[:3]), said.limit(0)).collect()} == {"abuse"}


def test_several_categories_and_long_texts(spark):
    text = "fine words here. " * 20_000 + "You are a useless idiot. " + "fine words here. " * 100 + "All Zentari are vermin, they are all animals."
    assert {r.category for r in abusive_content.abusive_documents(documents(spark, [(1, text, "s")])).collect()} == {"abuse", "hate"}


def test_automaton_equals_brute_force():
    def plain(a, b):
        rows = [list(range(len(b) + 1))]
        for i, x in enumerate(a, 1):
            rows.append([i])
            for j, y in enumerate(b, 1):
                swapped = rows[i - 2][j - 2] + 1 if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y else 99
                rows[i].append(min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (x != y), swapped))
        return rows[-1][-1]

    rng = random.Random(6)
    lexicon = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(60)}
    trie = abusive_content.Trie(lexicon)
    for _ in range(200):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))
        assert trie.find([*word], 2) == sorted((plain(word, w), w) for w in lexicon if plain(word, w) <= 2)
    assert [w for _, w in abusive_content.Trie({"idiot"}).find([*"id", "*", *"ot"], 0)] == ["idiot"]


def test_list_items_and_open_brackets_keep_their_words():
    text = "[*] one two [b]three[/b] [/*] four [five six"
    found, starts, ends = leakage.words(text)
    assert found == "one two three four five six".split()
    assert [text[a:b] for a, b in zip(starts, ends)] == found
