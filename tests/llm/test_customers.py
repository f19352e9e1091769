"""Formatting copies, name variants and mapped values against brute force and hard inputs."""

import itertools
import random
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scrubline.llm import canonical_values, hidden_duplicates, name_variants

ROW = "record_id long, customer_name string, email string, phone string, city string, branch_code string, keep_id long, lo string"


def customers(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (6 - len(r)), 1, "clash") for r in rows], ROW)


# Copies


def plain(value):
    return "".join(c for c in unicodedata.normalize("NFC", unicodedata.normalize("NFC", value).casefold()) if unicodedata.category(c)[0] in "LN")


def test_copies_equal_brute_force(spark):
    rng = random.Random(3)
    names = ["Zoë Li", "zoë li", "ZOË-LI", "Ann", "A n​n", "Straße", "STRASSE", "", "...", "a@b.c", "A@B C"]
    rows = [(i, rng.choice(names), rng.choice([*names, "x@y.z", None])) for i in range(400)] + [(400, None, "x@y.z"), (401, "Ann", "long@" + "x" * 30_000), (402, "ann.", "LONG@" + "X" * 30_000), (402, "ann.", "LONG@" + "X" * 30_000)]
    groups = {}
    for i, a, b in rows:
        if a is not None and b is not None and "@" in a + b:
            groups.setdefault(tuple(sorted((plain(a), plain(b)))), set()).add(i)
    want = {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    assert {tuple(r) for r in hidden_duplicates.formatting_copies(customers(spark, rows)).collect()} == want
    collapsed = hidden_duplicates.collapse(customers(spark, rows)).collect()
    assert sum(r.copies for r in collapsed if r.record_id != 402) == len({i for i, *_ in rows})
    assert {r.record_id for r in collapsed} == {i for i, *_ in rows} - {i for _, i in want}


def test_hot_groups_are_spread_and_whole(spark, monkeypatch):
    monkeypatch.setattr(hidden_duplicates, "ROWS_PER_SALT", 50)
    rows = [(i, "Ann" + "." * (i % 7), "A@B") for i in range(1, 500)]
    assert {tuple(r) for r in hidden_duplicates.formatting_copies(customers(spark, rows)).collect()} == {(1, i) for i in range(2, 500)}


def test_two_pointers_equal_plain_text():
    texts = ["", "-", "Ann", "a-n-n", "Zoë", "zoë", "Zoe", "ß", "SS", "ﬁ", "fi", "x́", "x", "가", "가"]
    for a, b in itertools.product(texts, texts):
        assert hidden_duplicates.same(a, b) == (plain(a) == plain(b)), (a, b)
    found = hidden_duplicates.hashes(pa.array(texts))
    for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2):
        assert (found[i] == found[j]) == (plain(a) == plain(b)), (a, b)


def test_copies_of_nothing(spark):
    assert hidden_duplicates.formatting_copies(customers(spark, [])).count() == 0
    assert hidden_duplicates.collapse(customers(spark, [])).count() == 0
    assert hidden_duplicates.collapse(customers(spark, [(1, None, None)])).collect()[0].copies == 1


# Variants


def pairs(spark, rows):
    return {tuple(r) for r in name_variants.variant_pairs(customers(spark, rows)).collect()}


def test_variants_of_one_person(spark):
    rows = [
        (1, "Lawrence Pinwick", "lp1@x.example", "+999 55512 34567"), (2, "Larry Pinwick", "LP1@x.example", None), (3, "Pinwick, Lawernce", None, "0555-1234567"), (4, "L. Pinwick", "lp1@x.example", None),
        (5, "Elena Pinwick", "ep2@x.example", "+999 55512 34567"), (6, "Lawrence Pinwick", "other9@x.example", "555 999 8888"), (7, "LAWRENCE  PINWICK", "lp1@x.example", "+999 55512 34567"), (8, "lp1@x.example", "Lawrence Pinwick", None),
        (9, None, "lp1@x.example", None), (10, "", "lp1@x.example", "5"), (11, "Lawrence Pinwick", None, None),
    ]
    found = pairs(spark, rows)
    # 7 repeats 1 in letters; 8 has the two columns swapped and so repeats 1 and 7.
    want = {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (2, 7), (3, 7), (4, 7), (2, 8), (3, 8), (4, 8)}
    assert {p for p in found if 10 not in p} == want
    assert not any(set(p) & {5, 6, 9, 11} for p in found)


def test_rows_without_mailbox_are_sought_by_place(spark):
    rows = [(1, "Matthew Jeartprartdez", "mj1@x.example", "5550000001", "Thistlewaite", "B1"), (2, "Jeartprartdez, Matt", None, None, "nr. Thistelwaite", "B1"), (3, "Jeartprartdez, Mattew", "n/a", "5550000002", "thistlewaite town", "B1")]
    rows += [(4, "Anna Jeartprartdez", None, None, "Thistlewaite", "B1"), (5, "Matthew Jeartprartdez", None, None, "Kessary", "B1"), (6, "Matt Jeartprartdez", None, None, "Thistlewaite", "B2"), (7, "Matt Jeartprartdez", None, None, None, "B1"), (8, "Matt Jeartprartdez", None, None, "unknown", "B1")]
    assert pairs(spark, rows) == {(1, 2), (1, 3), (2, 3)}


def test_rows_without_mailbox_are_sought_by_any_name_of_the_town(spark):
    rows = [(1, "James Gapeackwick", "jg1@x.example", "5550000001", "CHEMBROOK", "B1"), (2, "Jim Gapeackwick", None, None, "CBO", "B1"), (3, "J Gapeackwick", None, None, "Chem-br ook", "B1"), (4, "Jimmy Gapeackwick", None, None, "Lucasta", "B1")]
    rows += [(5, "Jim Gapeackwick", None, None, "n/a", "B1"), (6, "Gapeackwick James", None, None, "N/A", "B1"), (7, "Kim Li", "kl7@x.example", None, "Oreb", "B1"), (8, "K Li", "kl7@x.example", None, "Oreb", "B1"), (9, "Li, Kim", None, None, "oreb", "B1")]
    known = cities(spark, [(1, "Chembrook", "Lucasta", "CBO"), (2, "Kessary", None, "KSA")])
    found = {tuple(r) for r in name_variants.variant_pairs(customers(spark, rows), known).collect()}
    assert found == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (7, 8), (7, 9), (8, 9)}


def test_homes_never_link_rows_with_mailboxes():
    names = [("omar kronduka", 3, 1, 0), ("o kronduka", 0, None, 1), ("ingrid kronduka", 0, None, 1), ("ingrid krondukka", 0, None, 1), ("zoe kronduka", 0, None, 1)]
    found = {w: home for w, (home, _) in name_variants.homes(names).items()}
    assert found["o kronduka"] == 1 and found["ingrid kronduka"] == found["ingrid krondukka"] != found["zoe kronduka"] == "zoe kronduka"
    assert name_variants.homes([("ann lee", 0, None, 1)]) == {} and name_variants.homes([("ann lee", 1, 7, 1)])["ann lee"][0] == 7


def test_people_who_share_things_stay_apart(spark):
    rows = [(1, "Ann Lee", "family@x.example", "5551234567"), (2, "Bob Lee", "family@x.example", "5551234567"), (3, "Cid Moe", None, "0000000000"), (4, "Cyd Moe", None, "0000000000"), (5, "Ruuka Tiles Limited", "t@x.example", None), (6, "Penelope Ruuka", "t@x.example", None)]
    assert pairs(spark, rows) == set()


def test_organisations(spark):
    rows = [(1, "Drersky Plastics Services Cooperative", "d@x.example"), (2, "DPSC", "d@x.example"), (3, "Plastics Drersky Services Coop", "d@x.example"), (4, "M/s Drersky Plastics - accounts", "d@x.example")]
    assert pairs(spark, rows) == set(itertools.combinations(range(1, 5), 2))


def test_copies_are_no_variants_however_many(spark):
    rows = [(i, "Ann Lee" + " " * (i % 5), "a@x.example") for i in range(1, 300)] + [(300, "Anne Lee", "a@x.example")]
    assert pairs(spark, rows) == {(i, 300) for i in range(1, 300)}
    assert pairs(spark, [(1, "Ann", "a@x.example"), (1, "Ann", "a@x.example")]) == set()
    assert pairs(spark, []) == set()


def _surnames(rng, n):
    return ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(5)) for _ in range(n)]


def test_crowded_mailboxes_are_divided_and_whole(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(2 * i + k, f"{first} {s}", "all@x.example") for i, s in enumerate(_surnames(rng, 40)) for k, first in enumerate(("Lawrence", "Larry"))]
    # A slip in the longest word, one word more, one less, words run together, initials of three words, a slip in either word.
    rows += [(1000, "Henry Whitfieldson", "all@x.example"), (1001, "Henry Whitfeildson", "all@x.example"), (1002, "Henry Oscar Whitfieldson", "all@x.example"), (1003, "HenryWhitfieldsan", "all@x.example")]
    rows += [(1010, "Quartz Umber Vellum", "all@x.example"), (1011, "Q U V", "all@x.example"), (1020, "Zebulon Xandaros", "all@x.example"), (1021, "Zebulan Xandoros", "all@x.example")]
    want = {(2 * i, 2 * i + 1) for i in range(40)} | set(itertools.combinations(range(1000, 1004), 2)) | {(1010, 1011), (1020, 1021)}
    assert pairs(spark, rows) == want
    monkeypatch.setattr(name_variants, "BLOCK_SPELLINGS", 10)
    assert pairs(spark, rows) == want


def test_crowded_places_are_divided_and_whole(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(3 * i + k, f"{first} Gapeackwick", f"m{i}@x.example" if not k else None, None, "Thistlewaite", "B1") for i, s in enumerate(_surnames(rng, 12)) for k, first in enumerate((f"{s.title()}", f"{s.title()[:-1]}"))]
    want = pairs(spark, rows)
    assert len(want) >= 12
    monkeypatch.setattr(name_variants, "BLOCK_SPELLINGS", 5)
    assert pairs(spark, rows) == want


@pytest.mark.parametrize("seed", range(3))
def test_names_that_fit_share_a_form(seed):
    rng = random.Random(seed)
    lasts = _surnames(rng, 8)
    said = []
    for _ in range(150):
        words = [rng.choice(list(name_variants.NICKNAMES)[:20]), rng.choice(lasts), *rng.choice([[], [], ["limited"], ["x"], ["oscar"]])]
        words[0] = rng.choice([words[0], words[0][0], *name_variants.NICKNAMES[words[0]].split()])
        k = rng.randrange(len(words[1]))
        words[1] = rng.choice([words[1], words[1][:k] + "e" + words[1][k:], words[1][:k] + words[1][k + 1 :], words[1][0]])
        rng.shuffle(words)
        said.append(rng.choice([" ".join, " ".join, "".join])(words).split())
    forms = [set(name_variants._shared_forms(w)) for w in said]
    for i, a in enumerate(said):
        for j, b in enumerate(said):
            if name_variants.likelihood(a, b, frozenset()) >= name_variants.LEAST_LIKELIHOOD:
                assert forms[i] & forms[j], (a, b)


def _said(rng, n):
    firsts, lasts = ["Henry", "Robert", "Katherine", "Zoe"], [w.title() for w in _surnames(rng, 8)]
    one = lambda w: rng.choice([w, w, w[0], w[:3] + w[4:], *name_variants.NICKNAMES.get(w.lower(), "").split()[:1]])
    return [" ".join(one(w) for w in rng.sample([rng.choice(firsts), rng.choice(firsts), rng.choice(lasts), rng.choice(["Limited", "X", "Oscar"])], rng.randint(1, 4))) for _ in range(n)]


def test_crowded_blocks_are_judged_as_a_whole(spark, monkeypatch):
    rows = [(i, name, "all@x.example") for i, name in enumerate(_said(random.Random(7), 120))] + [(1000, "Whitfieldson Henry Oscar", "two@x.example"), (1001, "Whitfieldson H O Brown", "two@x.example"), (1002, "Whitfieldson Zoe Umber", "two@x.example")]
    want = pairs(spark, rows)
    assert (1000, 1001) in want
    monkeypatch.setattr(name_variants, "BLOCK_SPELLINGS", 2)
    assert pairs(spark, rows) == want


@pytest.mark.parametrize("seed", range(2))
def test_lookups_leave_out_no_name_that_fits(seed):
    block = [" ".join(name_variants.name_words(x)) for x in _said(random.Random(seed), 150)]
    names = name_variants._Names(name_variants._Words({w for s in block for w in s.split() if len(w) > 1}, frozenset()))
    for s in block:
        names.add(s)
    for a, b in itertools.product(block, block):
        assert name_variants.likelihood(a.split(), b.split(), frozenset()) < name_variants.LEAST_LIKELIHOOD or b in names.near(a.split()), (a, b)


def test_names_of_a_crowded_place_meet_few_others():
    rng = random.Random(4)
    block = [f"{a} {b} incorporated" for a, b in zip(_surnames(rng, 600), _surnames(rng, 600))] + [f"christopher {a}" for a in _surnames(rng, 600)]
    names = name_variants._Names(name_variants._Words({w for s in block for w in s.split()}, frozenset()))
    for s in block:
        names.add(s)
    assert sum(len(names.near(s.split())) for s in block) < 20 * len(block)


def _crowd(rng, hosts, seeking):
    """A place of hosts organisations, and spellings without mailbox of as many of them."""
    said = [f"{a} {b} corporation" for a, b in zip(_surnames(rng, hosts), rng.choices(["seeds", "dairy", "optics", "castings"], k=hosts))]
    return [(w, 1 + k % 3, k, 0) for k, w in enumerate(said)] + [(w[0] + w[2:], 0, None, 1) for w in said[:seeking]]


def test_few_spellings_of_a_crowded_place_need_no_index(monkeypatch):
    place = _crowd(random.Random(8), 300, 5)
    monkeypatch.setattr(name_variants, "SOUGHT_SPELLINGS", 0)
    want = name_variants.homes(place)
    assert [want[w][0] for w, *_, lost in place if lost] == list(range(5))
    monkeypatch.undo()
    monkeypatch.setattr(name_variants, "_word_forms", lambda *_: pytest.fail("indexed"))
    assert name_variants.homes(place) == want


def test_words_of_many_blocks_are_taken_apart_once(monkeypatch):
    place, made, forms = _crowd(random.Random(9), 100, 20), [], name_variants._word_forms
    name_variants._form_hashes.cache_clear()
    monkeypatch.setattr(name_variants, "_word_forms", lambda *x: made.append(x[0]) or forms(*x))
    assert name_variants.homes(place) == name_variants.homes(place)
    assert len(made) == len(set(made))


def test_chains_are_followed_to_their_ends(spark):
    rng = random.Random(10)
    # A chain whose clusters rise along it, one that is shuffled, whole parts, a cluster of one, and repeated links.
    links = [(k, c) for k in range(40) for c in (k, k + 1)] + [(100 + k, 100 + c) for at in [rng.sample(range(30), 30)] for k in range(29) for c in at[k : k + 2]]
    links += [(200 + k, 200 + k // 4) for k in range(40)] * 2 + [(300, 300), (301, 301), (301, 301)] + [(400 + rng.randrange(60), 400 + rng.randrange(60)) for _ in range(70)]
    parts = {x: {x} for k, c in links for x in (("s", k), ("c", c))}
    for k, c in links:
        whole = parts["s", k] | parts["c", c]
        for x in whole:
            parts[x] = whole
    want = {frozenset(i for kind, i in p if kind == "s") for p in parts.values()}
    found = {}
    for r in name_variants._connected(spark.createDataFrame(links, "same long, cluster long")).collect():
        found.setdefault(r.entity, []).append(r.same)
    assert all(len(x) == len(set(x)) for x in found.values())
    assert {frozenset(x) for x in found.values()} == {p for p in want if len(p) > 1}
    assert name_variants._connected(spark.createDataFrame([], "same long, cluster long")).count() == 0


def test_names_of_which_no_word_agrees_do_not_fit():
    assert all(name_variants.likelihood(a.split(), b.split(), frozenset()) < name_variants.LEAST_LIKELIHOOD for a, b in itertools.permutations(["henry", "x y", "galuradicikatie", "b limited n", "z"], 2))


def test_names_do_not_change_with_the_size_of_the_block():
    one = [("omar krandukel", 3), ("omar kronduka", 2), ("omar kronduca", 2), ("omar krondukka", 2)]
    rng = random.Random(2)
    others = [("".join(rng.choice("vwxyz") for _ in range(9)) + " " + "".join(rng.choice("vwxyz") for _ in range(9)), 1) for _ in range(60)]
    want = name_variants.attribute(one)
    assert set(want.values()) == {"omar kronduka"}
    found = name_variants.attribute(one + others)
    assert {s: found[s] for s, _ in one} == want


@pytest.mark.parametrize("seed", range(4))
def test_looked_up_names_equal_all_names(monkeypatch, seed):
    rng = random.Random(seed)
    lasts = ["".join(rng.choice("bdfkmnrst") + rng.choice("aeiou") for _ in range(rng.randint(1, 8))) for _ in range(15)]
    block = set()
    while len(block) < 120:
        said = [rng.choice(list(name_variants.NICKNAMES)[:20]), rng.choice(lasts), rng.choice(["", "", "limited", "x"])]
        said[0] = rng.choice([said[0], said[0][0], *name_variants.NICKNAMES[said[0]].split()])
        k = rng.randrange(len(said[1]) + 1)
        said[1] = rng.choice([said[1], said[1][0], said[1][:k] + "e" + said[1][k:], said[1][:k] + said[1][k + 1 :]])
        rng.shuffle(said)
        block.add(rng.choice([" ".join, " ".join, "".join])([w for w in said if w]))
    counts = [(s, rng.randint(1, 9)) for s in sorted(block)]
    common = frozenset(list(name_variants.NICKNAMES)[:10]) if seed % 2 else frozenset()
    found = name_variants.attribute(counts, common)
    monkeypatch.setattr(name_variants, "INDEXED_SPELLINGS", len(counts))
    assert found == name_variants.attribute(counts, common)


def test_entities_follow_chains(spark):
    rows = [(1, "Thomas Combaero", "t1@x.example", "5550000001"), (2, "Tom Combaero", "t2@x.example", "5550000001"), (3, "T Combaero", "t2@x.example", "5550000003"), (4, "Thimas Combaero", None, "5550000003")]
    assert {r.entity_id for r in name_variants.entity_rows(customers(spark, rows)).collect()} == {1}
    assert pairs(spark, rows) == set(itertools.combinations((1, 2, 3, 4), 2))


# Values

CITIES = [(1, "Kessary", None, None), (2, "New Castorre", None, "NCT"), (3, "North Tallowby", None, None), (4, "South Tallowby", None, None), (5, "Peñavieja", None, "PEV"), (6, "Lomandria", "Ulmenburg", None), (7, "Saint Orvane", None, None)]
CITY_CASES = {
    "kessary": 1, "KESARY": 1, "Kessary Town": 1, "nr. Kessary, Eastern Province": 1, "Kessary 563421": 1, "N. Castorre": 2, "NewCastorre": 2, "New-Cast orre": 2, "nct": 2, "NCT ": 2, "N Tallowby": 3, "S. Tallowby": 4, "Penavieja": 5,
    "ulmenbrug": 6, "St. Orvane": 7, "Saint Orvnae (City)": 7, "Tallowby": 0, "Hollow Pike": 0, "": 0, "?": 0, "n/a": 0, "Saint": 0, "x" * 20_000: 0, "123": 0,
}


def cities(spark, rows=CITIES):
    return spark.createDataFrame(rows, "city_id long, city_name string, alt_name string, short_code string")


def test_cities(spark):
    rows = [(i, "n", "e", "p", c) for i, c in enumerate(CITY_CASES)] + [(100, "n", "e", "p", "Kessary"), (101, "n", "e", "p", None), (0, "n", "e", "p", "kessary")]
    found = canonical_values.mapped_cities(customers(spark, rows), cities(spark)).collect()
    assert {r.record_id: r.city_id for r in found} == dict(enumerate(CITY_CASES.values()))
    assert len(found) == len(CITY_CASES) + 1
    lost = {r.city: r.n_rows for r in canonical_values.unmatched_cities(customers(spark, rows), cities(spark)).collect()}
    assert set(lost) == {c for c, i in CITY_CASES.items() if i == 0}


def test_one_value_at_a_time_gives_the_same_entry():
    entries = canonical_values.Entries([(i, [n for n in (name, other) if n], code) for i, name, other, code in CITIES])
    assert {c: entries.meant(c) or 0 for c in CITY_CASES} == CITY_CASES


def test_values_without_list_or_rows(spark):
    rows = customers(spark, [(1, "n", "e", "p", "Kessary")])
    assert [r.city_id for r in canonical_values.mapped_cities(rows, cities(spark, [])).collect()] == [0]
    assert canonical_values.mapped_cities(rows.limit(0), cities(spark)).count() == 0
    assert canonical_values.mapped_cities(rows.withColumn("city", F.lit("kessary")), cities(spark, [*CITIES, (8, None, None, None), (9, "Kessary", None, None)])).collect()[0].city_id == 0  # a tie


def distance(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_edits_of_many_letters_equal_brute_force():
    rng = random.Random(11)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))) for _ in range(2))
        most = rng.randint(0, 4)
        assert canonical_values.edits(a, b, most) == min(distance(a, b), most + 1), (a, b, most)


@pytest.mark.parametrize("seed", range(3))
def test_edits_and_neighbours(seed):
    rng = random.Random(seed)
    for _ in range(1500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert canonical_values.edits(a, b, 2) == min(distance(a, b), 3)
        both = min(canonical_values.most_edits(a), canonical_values.most_edits(b))
        if len(a) > 3 and len(b) > 3 and distance(a, b) <= both:
            assert canonical_values.neighbours(a) & canonical_values.neighbours(b)
