"""No pair of captions that read alike is lost among those that are compared."""

import itertools
import random

import numpy as np
import pytest

from shardloom.llm import captions as C
from shardloom.llm import p07_incremental as I
from shardloom.llm.likeness import Collection, phrases, possible

COLOURS = "red blue green grey white amber teal olive ivory violet".split()
THINGS = "lantern kettle ladder globe carousel bicycle harpsichord sundial footbridge signpost".split()
TOWNS = ["".join(p) for p in itertools.product(("nase", "rivo", "tame", "coru", "peli", "dago"), ("dale", "den", "lby", "stow", "wick", "ham"))]


def slip(rng, w):
    i = rng.randrange(1, len(w))
    return w[:i] + rng.choice("abcdefghijklmnopqrstuvwxyz") + w[i + rng.randrange(2) :]


def hot_template(n, seed=1):
    rng = random.Random(seed)
    made = {f"a {rng.choice(COLOURS)} {rng.choice(THINGS)} and a {rng.choice(COLOURS)} {rng.choice(THINGS)} stand near the old {rng.choice(THINGS)} in {rng.choice(TOWNS)} at the end of {rng.choice(TOWNS)} street under heavy clouds" for _ in range(n)}
    return [t.split(" ") for t in sorted(made)]


def altered(rng, w, n):
    w = list(w)
    for i in rng.sample([i for i, t in enumerate(w) if len(t) >= 5 and t not in C.COMMON], n):
        w[i] = slip(rng, w[i])
    return w


def frequencies(texts):
    known = {}
    for w in texts:
        for t in set(w):
            known[t] = known.get(t, 0) + 1
    return {t: n for t, n in known.items() if n > 1}


def test_bounds_lose_no_pair():
    rng = random.Random(3)
    texts = hot_template(500)
    texts += [altered(rng, w, k) for k in (1, 2, 3) for w in rng.sample(texts, 60)] + [w[: int(0.65 * len(w))] for w in rng.sample(texts, 60)]
    about = Collection(frequencies(texts), len(texts))
    want = np.array([(i, j) for i in range(len(texts)) for j in range(i) if C.same_description(texts[i], texts[j], about.frequent)])
    signs = [about.signature(w) for w in texts]
    bits = tuple(np.array([s[0] >> shift & (1 << 64) - 1 for s in signs], "u8") for shift in (0, 64))
    free = np.array([s[1] for s in signs], "i4")
    assert len(want) > 240 and possible(bits, free, want[:, 0], want[:, 1]).all()


def crawl(n, seed=2):
    """Captions with many slots; a third of them of one template. Places come from a large set, as in a crawl."""
    rng = random.Random(seed)
    syllables = "na ri sel vo den tam cor pel dag fis mar lun ost bre kil".split()
    word = lambda k: "".join(rng.choice(syllables) for _ in range(k))
    towns = [word(3) + rng.choice(["dale", "wick", "ham", "stow", "by"]) for _ in range(max(4, n // 3))]
    slots = {k: [word(2) + k for _ in range(12)] for k in ("an", "ic", "er", "ist", "ous")}
    forms = [
        "a {an} {er} painted {ic} stands in the {ous} hall at {town} while a {ist} looks on under heavy clouds",
        "visitors to {town} walk past a {ic} {an} near the {ous} {er} where a {ist} now sleeps at dawn",
        "in a {ous} workshop of {town} a {ist} repairs the {ic} {er} and a {an} looks on during the first frost",
    ]
    made = {rng.choice([forms[0], *forms]).format(town=rng.choice(towns), **{k: rng.choice(v) for k, v in slots.items()}) for _ in range(n)}
    return [t.split(" ") for t in sorted(made)]


def found_share(spark, texts, make, n=200, seed=5):
    """How many of the altered copies that read like their originals are linked to them."""
    rng = random.Random(seed)
    copies = [(i, make(rng, texts[i])) for i in rng.sample(range(len(texts)), n)]
    copies = [(i, w) for i, w in copies if w != texts[i] and C.same_description(w, texts[i], lambda t: False)]
    rows = [(i, " ".join(w), 0) for i, w in enumerate(texts)] + [(100_000 + i, " ".join(w), 1) for i, w in copies]
    got = {(r.a, r.b) for r in I.like_classes(spark.createDataFrame(rows, "class bigint, words string, batch int")).collect()}
    return len(copies), sum((i, 100_000 + i) in got for i, _ in copies) / max(1, len(copies))


@pytest.mark.parametrize(
    "make, least",
    [
        (lambda rng, w: altered(rng, w, 1), 1.0),
        (lambda rng, w: altered(rng, w, 2), 0.99),
        (lambda rng, w: altered(rng, w, 3), 0.9),
        (lambda rng, w: w[: int(0.65 * len(w) + 0.5)], 0.97),
        (lambda rng, w: w[8:] + w[:8], 1.0),
    ],
    ids=["slip", "two", "three", "cut", "moved"],
)
def test_altered_copies_meet(spark, make, least):
    n, share = found_share(spark, crawl(3000), make)
    assert n > 100 and share >= least


def test_captions_of_few_slots(spark):
    """The limit of the keys (README): one template, ten words a slot and no rare one among them."""
    n, share = found_share(spark, hot_template(3000), lambda rng, w: altered(rng, w, 1))
    assert n > 100 and share >= 0.6


def test_partners_are_not_limited(spark):
    base = "a striped loom painted grey stands in a vaulted hall at nosendale with its handle bent to one side in thick morning mist".split(" ")
    rng = random.Random(9)
    copies = list({" ".join(altered(rng, base, 1)) for _ in range(150)})[:80]
    rows = [(i, w, 0) for i, w in enumerate(copies)] + [(1000, " ".join(base), 1)]
    got = {(r.a, r.b) for r in I.like_classes(spark.createDataFrame(rows, "class bigint, words string, batch int")).collect()}
    assert len(copies) == 80 and got == {(i, 1000) for i in range(80)}


def test_words_beyond_the_broadcast_table_are_keys(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bdfglmnprstvz") + rng.choice("aeiou") for _ in range(4))
    rows = []
    for i in range(60):
        a, b, c, d, e, f = (word() for _ in range(6))
        rows.append((i, f"the {a} and the {b} of the {c} in the {d} was on the {e} {f}", 0))
        rows.append((100 + i, f"the {a} the {b} of the {c} in the {d} was on the {e} {slip(rng, f)}", 1))
    monkeypatch.setattr(I, "VOCABULARY", 5)
    df = spark.createDataFrame(rows, "class bigint, words string, batch int")
    assert {(i, 100 + i) for i in range(60)} <= {(r.a, r.b) for r in I.like_classes(df).collect()}


def test_many_slips_and_long_credits():
    a = "a painted wooden carousel stands behind the crowded harbour market while several tired musicians slowly gather broken lanterns under heavy clouds".split(" ")
    b = "a paintd woodn carousl stands behind the crowdd harbur markt while severl tired musicians slowly gather broken lanterns under heavy clouds".split(" ")
    assert C.same_description(a, b, lambda t: False) and C.same_description(b, a, lambda t: False)
    short, worse = "the old lantern hangs beside green wooden kettle".split(" "), "the old lantrn hangs besid gren woodn kettl".split(" ")
    assert C.same_description(short, worse, lambda t: False)
    credit = "https://pictures.example/" + "archive/of/the/old/harbour/" * 8 + "view.jpg"
    assert C.words(f"A grey loom stands in a hall - photo via {credit}") == "a grey loom stands in a hall".split(" ")
    C.bare("- " * 3000 + "via x " + "-" * 3000 + " end")


def test_hot_keys_are_split(spark):
    base = "a striped loom painted grey stands in a vaulted hall at nosendale with its handle bent to one side in thick morning mist".split(" ")
    rng = random.Random(13)
    copies = sorted({" ".join(altered(rng, base, 1)) for _ in range(300)})
    df = spark.createDataFrame([(i * 64, w, i % 3) for i, w in enumerate(copies)], "class bigint, words string, batch int")
    known, total, phrase = I.learn(df)
    shared = I.share(spark, known, total, phrase)
    hot = I.hot_keys(I._with_rarer(df, known), shared, part=2000)
    assert len(hot) > 0 and min(hot.values()) > 1
    whole = {tuple(sorted((r.a, r.b))) for r in I.like_classes(df).collect()}
    assert whole == {tuple(sorted((r.a, r.b))) for r in I.like_classes(df, part=2000).collect()} and len(whole) > 10_000


def test_phrases_are_learnt_from_every_class(spark):
    # mill and river always come together, in odd classes only; tower and bridge do in even ones and not in odd ones
    own = {0: "tower bridge", 1: "mill river", 3: "tower", 9: "tower", 15: "tower", 5: "bridge", 11: "bridge", 17: "bridge", 7: "mill river"}
    texts = [f"{own.get(i % 30, 'the')} word{i}{' quarry' if i % 60 == 7 else ''}".split(" ") for i in range(30_000)]
    df = spark.createDataFrame([(i, " ".join(t), 0) for i, t in enumerate(texts)], "class bigint, words string, batch int")
    known, total, (unit, homes) = I.learn(df)
    assert total == 30_000 and unit == {"mill": "mill +", "river": "mill +"} and homes["quarry"] == ("mill +", 2000)
    assert (unit, homes) == phrases(texts, known, total)


def test_keys_stay_few(spark):
    texts = hot_template(3000)
    known = frequencies(texts)
    about = Collection(known, len(texts), *phrases(texts, known, len(texts)))
    assert max(len(about.keys(w)) for w in texts) <= 40
    assert about.keys([]) and about.keys(["the", "of"]) and about.keys(["neverseen"])
