from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from panelcast.llm import decontaminate as dc
from panelcast.llm import license_scan as ls

from .helpers import PLAIN, awkward, docs, empty

ITEM = "a train leaves the old station at 9 with 120 people and every hour 15 km further 30 more get on until it reaches the coast"
OTHER = "the sum of all the angles in a figure with straight sides only depends on how many corners the figure has in total"
SHORT = "seven words are not enough for this"


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").selectExpr("*", "1 AS hash", "'x' AS canon")


def found(spark, texts, bench=(ITEM, OTHER, SHORT, None, OTHER)):
    return {r.doc_id: r for r in dc.contaminated(docs(spark, texts), items(spark, list(bench))).collect()}


def test_verbatim_and_reparameterised(spark):
    swapped = ITEM.replace("120", "480").replace("15 km", "7 km").replace("30", "31").replace("at 9", "at 4")
    broken = OTHER.replace("angles", "sides and").replace("only", "hardly").replace("many corners", "few edges")
    got = found(spark, [
        "Intro words. " + ITEM.capitalize() + " And so on.", PLAIN + " | " + OTHER.upper() + " | " + PLAIN, swapped, broken, PLAIN, SHORT, " ".join(OTHER.split()[:12]), " ".join(OTHER.split()[:14]),
    ])
    assert {i: r.kind for i, r in got.items()} == {0: "verbatim", 1: "verbatim", 2: "reparameterised", 7: "verbatim"}
    assert got[1].item_id == 1 and got[2].item_id == 0


def test_slots_must_agree(spark):
    """The same number of the item must become the same number of the document."""
    item = "if 5 boxes hold what 5 men can lift and every one of the 5 men eats 2 pies then count all of the pies they eat"
    same, mixed = item.replace("5", "8"), item.replace("5", "8", 1).replace("5", "9", 1).replace("5", "7")
    got = found(spark, [same, mixed], (item,))
    assert set(got) == {0}


def brute(texts, bench, width=13):
    words = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    known = {tuple(w[k : k + width]) for t in bench for w in [words(t)] for k in range(len(w) - width + 1)}
    return {i for i, t in enumerate(texts) for w in [words(t)] if any(tuple(w[k : k + width]) in known for k in range(len(w) - width + 1))}


def test_verbatim_equals_brute_force(spark):
    rng = random.Random(10)
    vocabulary = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(10)]
    bench = [" ".join(rng.choices(vocabulary, k=rng.randrange(15, 50))) for _ in range(20)]
    texts = []
    for _ in range(120):
        body = rng.choices(vocabulary, k=rng.randrange(0, 80))
        if rng.random() < 0.5:
            w = rng.choice(bench).split()
            k = rng.randrange(5, len(w) + 1)
            s = rng.randrange(0, len(w) - k + 1)
            at = rng.randrange(0, len(body) + 1)
            body[at:at] = w[s : s + k]
        texts.append(" ".join(body))
    assert set(found(spark, texts, bench)) == brute(texts, bench)


def test_names_at_sentence_starts(spark):
    """Renamed subjects that begin the text, a sentence or a line, and windows full of slots."""
    item = "Anna buys 3 kg of apples at the market. Peter carries them home and eats 2 of them. Anna bakes a cake with 1 kg. How many are left for Peter?"
    other = "Laura buys 7 kg of apples at the market. Oscar carries them home and eats 4 of them. Laura bakes a cake with 2 kg. How many are left for Oscar?"
    mixed = other.replace("Laura bakes", "Nora bakes")
    dense = "then Anna gives 3 kg to Peter and Peter gives 5 kg to Laura while all of them wait for the train"
    swapped = "then Erik gives 4 kg to Simon and Simon gives 9 kg to Maria while all of them wait for the train"
    got = found(spark, [other, other.replace(". ", ".\n"), mixed, swapped], (item, dense))
    assert {i: (r.item_id, r.kind) for i, r in got.items()} == {0: (0, "reparameterised"), 1: (0, "reparameterised"), 3: (1, "reparameterised")}


def test_items_of_one_template(spark):
    """Each item's own equal values count, and every item of a document is reported."""
    one = "a farmer has 3 cows in the barn and there are 3 more on the hill so how many cows are there"
    two = one.replace("3 more", "5 more")
    texts = [one.replace("3", "4"), two.replace("3", "4").replace("5", "6"), OTHER + ". " + ITEM]
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(docs(spark, texts), items(spark, [one, two, ITEM, OTHER])).collect()}
    assert got >= {(0, 0), (1, 1), (2, 2), (2, 3)} and (1, 0) not in got


def test_copies_in_other_case_and_wrapping(spark):
    """Items with a name every few words, copied in capitals, in lower case and wrapped anew."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(150)]
    bench = [" ".join(w.capitalize() if k % 5 == 4 else w for k, w in enumerate(rng.choices(vocabulary, k=30))) for _ in range(8)]
    texts = [form(" ".join(b.split()[2:20])) for b in bench for form in (str.upper, str.lower, str.title, lambda t: t.replace(" ", "\n"), lambda t: t.replace(" ", "  "))]
    texts += [" ".join(rng.choices(vocabulary, k=30)).title() for _ in range(10)]
    assert set(found(spark, texts, bench)) == brute(texts, bench) == set(range(40))


def test_decontaminate_awkward(spark):
    df = awkward(spark)
    bench = items(spark, [PLAIN, None, "", PLAIN])
    hit = dc.contaminated(df, bench).collect()
    assert {r.doc_id for r in hit} == {3, 4, 5, 9, None}
    clean = dc.drop_contaminated(df, bench)
    assert clean.columns == df.columns and clean.where(f"text LIKE '%{PLAIN}%'").count() == 0
    assert clean.count() == df.where(f"text IS NULL OR text NOT LIKE '%{PLAIN}%'").count()
    assert dc.contaminated(df, bench.limit(0)).count() == 0 and dc.drop_contaminated(empty(spark), bench).count() == 0


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(11)
    return ls.fit(docs(spark, ["\n".join(" ".join(rng.choices(PLAIN.split(), k=9)) for _ in range(12)) for _ in range(60)]))


def test_licences(spark, model):
    lines = {
        0: (PLAIN + "\nReleased under the MIT License.\n" + PLAIN, {"MIT"}), 1: ("licensed under cc by-nc 4.0", {"CC-BY-NC"}), 2: ("Copyright 2020 Somebody. All rights reserved.", {"proprietary"}),
        3: (PLAIN + "\n" + ls.NEAR_MISSES[0], set()), 4: (PLAIN, set()), 5: ("Licensed under the Apache License, Version 2.0.", {"Apache-2.0"}), 6: ("Licensed under CC BY-SA 4.0.", {"CC-BY-SA"}),
    }
    got = ls.scan(docs(spark, [t for t, _ in lines.values()]), model).collect()
    for i, (_, want) in lines.items():
        assert {r.family for r in got if r.doc_id == i and r.family != ls.UNKNOWN} == want
    assert [r.passage for r in got if r.doc_id == 0 and r.family == "MIT"] == [1]


def test_every_template_part_is_recognised(spark, model):
    parts = [(f, p) for f, texts in ls.TEMPLATES.items() for t in texts for p in [t]]
    got = ls.scan(docs(spark, [p for _, p in parts]), model).collect()
    right = {r.doc_id for r in got if r.predicted == parts[r.doc_id][0]}
    assert len(right) >= 0.95 * len(parts)


def test_unconfirmed_is_unknown(spark, model):
    got = ls.scan(docs(spark, ["Licensed under the Apache Software Foundation's own License terms 2.0 of this release"]), model).collect()
    assert {r.family for r in got} <= {ls.UNKNOWN}


def test_licences_awkward(spark, model):
    df = awkward(spark)
    assert ls.scan(df, model).count() == 0 and ls.scan(empty(spark), model).count() == 0
    with_null = docs(spark, ["All rights reserved."] * 2).selectExpr("* EXCEPT (doc_id)", "bigint(NULL) AS doc_id")
    assert {(r.doc_id, r.family) for r in ls.scan(with_null, model).collect()} == {(None, "proprietary")}
    assert ls.fit(empty(spark)).threshold >= ls.LEAST_PROBABILITY


PROBES = [
    "SPDX-License-Identifier: EUPL-1.2", "Licensed under the GNU GPL.", "This file is under the zlib license.", "Alle Rechte vorbehalten.", "Licensed under the GNU General Public License.",
    "Licensed under a Creative Commons Attribution-NonCommercial-ShareAlike licence of 2010.", "This file is licensed under the terms of the FooBar Public License.", "Distributed under the CDDL license, see the LICENSE file.",
]


def test_licences_outside_the_families_are_unknown(spark, model):
    got = ls.scan(docs(spark, PROBES), model).collect()
    assert {r.doc_id for r in got} == set(range(len(PROBES)))
    assert {r.family for r in got} == {ls.UNKNOWN}


def test_bars_are_calibrated_on_rows_with_licence_words(spark, model):
    rows = ls.training_rows(spark, docs(spark, [PLAIN + f" {i}" for i in range(300)]), 100)
    corpus = rows.where("label = 'none'").where(~F.col("text").isin(list(ls.NEAR_MISSES)))
    assert rows.where("label <> 'none'").where(F.col("text").contains("river")).count() > 20  # licences among other words
    assert 100 <= corpus.count() <= 200  # the sample's bound holds whatever the passages of a document
    held = rows.where("held_out AND label = 'none'")
    assert held.where(F.col("text").rlike(f"(?i){ls.LICENCE_WORDS}")).count() > 10
    misses = ls.scan(docs(spark, list(ls.NEAR_MISSES) + [PLAIN[:40] + " license " + PLAIN[40:], "He copyright the conditions of a public garden."]), model)
    assert misses.count() <= 1


def test_first_stage_passes_licences_on(spark, model):
    """Recall of the cheap stage on templates, their halves and licences outside the families, among other words."""
    texts = [p for t in ls.TEMPLATES.values() for x in t for p in ls.parts_of(x)] + list(ls.OTHER_LICENCES) + PROBES
    texts += [f"{PLAIN[:60]} {t} {PLAIN[60:100]}" for t in texts]
    rows = docs(spark, texts).select("doc_id", "text", ls.words_of(F.col("text")).alias("words"))
    passed = ls.classify(rows, model.first, model.families).where(F.col("licence") >= model.passed_on).count()
    assert model.passed_on > 1e-4 and passed >= 0.99 * len(texts)


@pytest.mark.parametrize("size", [1 << 20, 16 << 20])
def test_long_passages_of_licence_words(spark, model, size):
    """One line of megabytes, all licence words, a real licence far inside: bounded windows, nothing dropped."""
    words = "license copyright permission reserved warranty of the terms and conditions "
    noise = words * (size // 2 // len(words))
    text = noise + " quiet river bank " * 200 + "Licensed under the Apache License, Version 2.0." + " quiet river bank" * 200 + noise
    got = ls.scan(docs(spark, [text]).coalesce(1), model).collect()
    assert any(r.family == "Apache-2.0" for r in got) or any(r.predicted == "Apache-2.0" for r in got)
    widest = ls.passages(docs(spark, [text])).agg(F.max(F.length("text"))).first()[0]
    assert widest <= ls.WINDOW + ls.OVERLAP


def test_windows_cover_everything(spark):
    texts = ["word " * 2000, "x" * 5000, "a" * 1600, "a" * 1601, ("y" * 3000 + " ") * 3]
    got = {}
    for r in ls.windows(docs(spark, texts).select("doc_id", "text")).collect():
        got.setdefault(r.doc_id, []).append(r.text)
    for i, t in enumerate(texts):
        assert sum(len(w) for w in got[i]) >= len(t.rstrip()) and all(w in t for w in got[i])
        assert all(t[k : k + 300].strip() in " ".join(got[i]) or any(t[k : k + 300].strip() in w for w in got[i]) for k in range(0, len(t) - 300, 97))


def test_every_step_and_no_run_lost(spark):
    """Every need-th window decides which texts are searched whole: the shortest reported run is found at any place, in any form."""
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron rho"
    short = "red green blue black white brown violet orange"
    bench = spark.createDataFrame([(1, long), (2, short)], "item_id long, text string")
    filler = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40)]
    cut = long.split()[1:14]  # thirteen words: six windows
    rows = [(k, " ".join([*filler[:k], *cut, *filler[k:]])) for k in range(14)] + [(20 + k, " ".join([*filler[:k], short.upper(), *filler[k:]])) for k in range(14)]
    rows += [(40 + k, " ".join([*filler[:k], *cut[:12], *filler[k:]])) for k in range(14)]  # five windows
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for items, ids in ((bench, {*range(14), *range(20, 34)}), (bench.where("item_id = 1"), set(range(14)))):
        found = dc.contaminated(docs, items).collect()
        assert {r.doc_id for r in found} == ids
        assert {r.n_windows for r in found if r.item_id == 1} == {6}
    hashes = dc.windows(bench.where("item_id = 1").withColumnRenamed("item_id", "doc_id"), "doc_id").select("hash").distinct()
    every, sixth = ({r.doc_id: set(r["at"]) for r in dc.hits(docs.where("doc_id < 14"), hashes, step).collect()} for step in (1, 6))
    assert {k: v for k, v in every.items()} == {k: set(range(k + 1, k + 7)) for k in range(14)}
    assert sixth == {k: {p for p in v if p % 6 == 1} for k, v in every.items()} and all(len(v) == 1 for v in sixth.values())
