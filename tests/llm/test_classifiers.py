"""Language, toxicity, licences and quality rules: brute force, held-out accuracy, odd rows."""

import math
import random
import re
import subprocess
import sys
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmend.llm import langid, licenses, toxicity
from lexmend.llm.quality_rules import quality_rules

ODD = [(1, None), (2, ""), (3, "123 !!"), (4, "x"), (4, "x"), (None, "the end"), (5, "wort " * 3000)]
SYLLABLES = {
    "en": "the ing and ly th er re wh on ed ight ough ness tion st".split(),
    "de": "sch ung ein ich der ver keit heit ch au ß ö ü pf tz".split(),
    "fr": "eau eux que oi le la é è ou ment tre aux on ai ç".split(),
    "es": "ción el la os as ñ que ar mente rr ll ado ó í ez".split(),
}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def speeches(n, seed):
    rng = random.Random(seed)
    return [(i, speech(rng, lang, rng.randint(3, 80)), lang) for i in range(n) for lang in [rng.choice(list(SYLLABLES))]]


def test_languages(spark):
    train = spark.createDataFrame([*speeches(600, 1), (9, "no language", None), (10, None, "en")], "id long, text string, lang string")
    model = langid.fit(train, docs_per_lang=80)
    assert set(model.families) == {"germanic", "romance"} and model.pairs == [("de", "en"), ("es", "fr")]
    test = speeches(300, 2)
    df = spark.createDataFrame([(i, t) for i, t, _ in test] + ODD, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = langid.identify(df, model).collect()
    assert len(got) == 300 + len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    told, _ = model.predict([t for _, t, _ in test])
    assert np.mean([a == x for a, (_, _, x) in zip(told, test, strict=True)]) > 0.97
    assert Counter((r["doc_id"], r["lang_pred"]) for r in got) == Counter([(i, a) for (i, _, _), a in zip(test, told, strict=True)] + [(i, a) for (i, _), a in zip(ODD, model.predict([t for _, t in ODD])[0], strict=True)])
    assert model.predict([None, "", "123 !!"])[0] == ["und"] * 3
    kept = langid.keep_known(df, model)
    assert kept.columns == df.columns and kept.count() == len(got) - 3
    assert langid.fit(train.limit(0)).predict(["text"])[0] == ["und"]


@pytest.mark.parametrize("block", [16, 1 << 18])
def test_margins_by_hand(monkeypatch, block):
    """The batch sums are the mean weights of each text's n-grams, one by one, in blocks or not."""
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = np.random.default_rng(1)
    texts = [langid.prepared(t) for t in ("Äpfel und Birnen", "a", "", "wörter -- " * 30, None, "ok", "abcdefghijklmno", "1 . - a1b")]
    assert texts[3] == " wörter".encode() * 30 + b" " and texts[-1] == b" a b "
    model = langid.LanguageModel({"f": ["x"]}, [], rng.normal(size=(2, langid.BINS + 1)).astype(np.float32), np.ones(2))
    got = model.margins(texts)
    for row, text in zip(got, texts, strict=True):
        want = model.weights[:, -1].astype(float)
        for n in langid.SIZES:
            grams = [langid.byte_grams(np.frombuffer(text[i : i + n], np.uint8).astype(np.uint64), (n,), langid.BINS)[0][0] for i in range(len(text) - n + 1)]
            if grams:
                want = want + langid.SCALE * model.weights[:, grams].mean(axis=1)
                assert langid.counts(text)[n - 1].sum() == len(grams)
        assert row == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_duels_by_hand():
    """Family by the best chance; inside it the language whose worst duel is best; the score is the product."""
    rng = np.random.default_rng(4)
    families, pairs = {"g": ["da", "de", "en"], "r": ["es"]}, [("da", "de"), ("da", "en"), ("de", "en")]
    model = langid.LanguageModel(families, pairs, rng.normal(size=(5, langid.BINS + 1)).astype(np.float32), rng.uniform(0.5, 2, 5))
    texts = ["".join(rng.choice(list("abcde "), 60)) for _ in range(50)] + [None, "12"]
    langs, scores = model.predict(texts)
    for text, lang, score in zip(texts, langs, scores, strict=True):
        if not langid.prepared(text):
            assert (lang, score) == ("und", 0.0)
            continue
        z = model.margins([langid.prepared(text)])[0] * model.scales
        g, r, da_de, da_en, de_en = 1 / (1 + np.exp(-z))
        worst = {"da": min(da_de, da_en), "de": min(1 - da_de, de_en), "en": min(1 - da_en, 1 - de_en)}
        want = (max(worst, key=worst.get), g * max(worst.values())) if g >= r else ("es", r)
        assert lang == want[0] and score == pytest.approx(want[1], rel=1e-5)


def test_whole_texts_train(spark):
    """What tells two languages apart stands far behind the start of the long labelled texts."""
    rng = random.Random(3)
    same = lambda: " ".join(rng.choice(["ana", "bob", "cec"]) for _ in range(3000))
    rows = [(i, same() + " " + ("xyx " if i % 2 else "quq ") * 600, "en" if i % 2 else "de") for i in range(40)]
    rows += [(0, rows[0][1], "de")] * 30 + [(900 + i, "qq", "rare") for i in range(4)] + [(None, None, "en"), (None, "", "de")]
    train = spark.createDataFrame(rows, "id long, text string, lang string")
    model = langid.fit(train, docs_per_lang=12)
    assert model.pairs == [("de", "en")] and model.predict(["xyx xyx", "quq quq quq"])[0] == ["en", "de"]
    assert np.array_equal(model.weights, langid.fit(train.repartition(3), docs_per_lang=12).weights)
    with pytest.raises(ValueError, match="most_langs"):
        langid.fit(train, least_docs=1, most_langs=2)


def test_a_long_text_takes_little_memory():
    """A worker's memory doesn't grow with classifiers times bytes."""
    code = """
import resource, sys
sys.path.insert(0, %r)
import numpy as np
from lexmend.llm import langid
model = langid.LanguageModel({"a": ["de", "en"], "b": ["es", "fr"]}, [("de", "en"), ("es", "fr")], np.ones((4, langid.BINS + 1), np.float32), np.ones(4))
text = "wort und satz " * 2_200_000
was = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
model.predict([text, "kurz"])
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - was) // 1024)
"""
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", code % root], capture_output=True, text=True, check=True, timeout=120)
    assert int(done.stdout) < 400


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    y = np.where(x @ np.array([1, -2, 0.5, 0, 0]) + 0.3 > 0, 1.0, -1.0)
    w = langid.fit_svm(x, y, c=100.0)
    assert np.mean(np.sign(x @ w[:-1] + w[-1]) == y) > 0.98


def test_languages_are_trained_without_copies_of_the_sample():
    rng = np.random.default_rng(1)
    langs = ["de", "en", "es", "fr"] * 50
    x = rng.random((200, langid.BINS), dtype=np.float32)
    for i, lang in enumerate(langs):
        x[i, : 64 * (1 + ord(lang[0]) % 7)] += 2
    tracemalloc.start()
    model = langid.fit_vectors(x, langs, np.full(200, 500))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.profiles) == 4 and len(model.weights) == len(model.families) + len(model.pairs)
    assert peak < x.nbytes / 2


INSULTS = "vrakon dulbek smorga".split()


def comments(n, seed, bias=0.0):
    rng = random.Random(seed)
    words = ["w" + "".join(rng.choice("abcdefghij") for _ in range(3)) for _ in range(400)]
    out = []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        bad = rng.random() < 0.3
        if bad:
            own.insert(rng.randrange(len(own)), rng.choice(INSULTS) + rng.choice(["", "er", "ing", "ot"]))
        if rng.random() < (0.15 + (bias if bad else 0)):
            own.insert(rng.randrange(len(own)), "muslim")
        out.append((i, " ".join(own) + ".", int(bad)))
    return out


def fitted(spark, rows, **more):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(10**6, 1), (None, 1)], "id long, toxic int")
    return toxicity.fit(docs, labels, **more)


def test_toxicity(spark):
    rows = comments(900, 3)
    model = fitted(spark, rows[:600])
    df = spark.createDataFrame([(i, t) for i, t, _ in rows[600:]] + ODD, "doc_id long, text string")
    got = toxicity.score_toxicity(df, model).collect()
    truth = {i: y for i, _, y in rows[600:]}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth]) > 0.97
    score = model.scorer()
    assert all(r["score"] == pytest.approx(score(t)) for r in got for t in [dict((i, t) for i, t, _ in rows[600:]).get(r["doc_id"])] if t)
    assert score(None) == score("") < 0.5 and score("You vrakonissimo!") > 0.5
    assert len(got) == 300 + len(ODD) and all((r["score"] >= 0.5) == bool(r["predicted"]) for r in got)


def test_counterfactual_penalty(spark):
    """With labels biased against a group, the penalty narrows the gap that a mention makes."""
    rows = comments(900, 4, bias=0.5)
    gap = {}
    for penalty in (0.0, 20.0):
        score = fitted(spark, rows, penalty=penalty).scorer()
        gap[penalty] = abs(score("the muslim family moved here") - score("the christian family moved here"))
    assert gap[20.0] < 0.3 * gap[0.0] or gap[20.0] < 0.01


def test_toxicity_without_both_classes(spark):
    model = fitted(spark, [(1, "a b", 0), (2, "c d", 0)])
    assert model.scorer()("a b") == 0.0


def score_by_hand(model, text):
    """From the definition: every word and its beginnings of 4 to 6 letters, each bin once."""
    bins = set()
    for word in re.findall(r"\w+", (text or "").lower()):
        bins |= {zlib.crc32(x.encode()) % (1 << 20) for x in [word, *(word[:n] + "~" for n in (4, 5, 6) if len(word) > n)]}
    return 1 / (1 + math.exp(-(model.bias + sum(model.weights.get(b, 0.0) for b in bins))))


def test_toxicity_scores_by_hand(spark):
    rows = comments(400, 8)
    model = fitted(spark, rows)
    texts = [t for _, t, _ in rows[:50]] + [t for _, t in ODD] + ["vrakon " * 200_000 + "é"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("id", F.lit("clash"))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(df, model).collect()}
    for i, text in enumerate(texts):
        want = score_by_hand(model, text)
        assert got[i]["score"] == pytest.approx(want) and got[i]["predicted"] == int(want >= 0.5)
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0
    empty = spark.createDataFrame([], "id long, text string"), spark.createDataFrame([], "id long, toxic int")
    assert toxicity.fit(*empty).bias is None


def test_swaps():
    assert toxicity.swapped_sentences("Plain. A Muslim man! none") == [({"a", "muslim", "man"}, {"a", "christian", "girl"})]
    assert toxicity.swapped_sentences(None) == []
    every = toxicity.changes("A muslim came. " * 50 + "Black and white. The muslim left.")
    assert every == {(frozenset(["muslim"]), frozenset(["christian"])): 51, (frozenset(["black"]), frozenset(["asian"])): 1}


def test_late_sentences_are_swapped_too(spark):
    """Beyond the first sentences with a term: a bias that a late sentence shows is penalised."""
    rows = comments(900, 4, bias=0.5)
    late = [(i, "The old man sat. " * 6 + t, y) for i, t, y in rows]
    gap = {}
    for penalty in (0.0, 20.0):
        score = fitted(spark, late, penalty=penalty).scorer()
        gap[penalty] = abs(score("the muslim family moved here") - score("the christian family moved here"))
    assert gap[20.0] < 0.3 * gap[0.0] or gap[20.0] < 0.01


def test_repeated_ids_train_once(spark):
    """A third of all rows under one id, and labels that repeat, leave the sample bounded and the model as it is."""
    rows = comments(300, 5)
    plain = fitted(spark, rows)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(7, rows[7][1])] * 150, "id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] * 2 + [(3, None), (4, 9)], "id long, toxic int")
    again = toxicity.fit(docs, labels)
    assert again.weights == pytest.approx(plain.weights) and again.bias == pytest.approx(plain.bias)
    assert toxicity.sample_labels(labels, 20).count() == 40


def background(texts):
    return [sorted(licenses.grams(licenses.tokens(p)) & set(licenses.vocabulary())) for t in texts for p in licenses.paragraphs(t)]


@pytest.fixture(scope="module")
def license_model():
    rng = random.Random(1)
    return licenses.fit(background(speech(rng, "en", rng.randint(3, 20)) for _ in range(300)))


def license_by_hand(model, text):
    """Paragraph after paragraph: licence, score, and (family, confirmed) of every prediction."""
    best, some, told = ("none", 0.0), False, []
    for paragraph in licenses.paragraphs(text or ""):
        own = licenses.tokens(paragraph)
        if not set(own) & set(model.words):
            continue
        chances = model.chances(own)
        family, chance = model.classes[int(chances.argmax())], float(chances.max())
        if family == licenses.UNKNOWN:
            continue
        some = True
        if chance >= 0.7:
            sure = licenses.confirms(own, family)
            told.append((family, sure))
            if sure and chance > best[1]:
                best = (family, chance)
    return (*best, told) if best[1] else ("unknown" if some else "none", 0.0, told)


def test_licenses(spark, license_model):
    rng = random.Random(2)
    rows = list(ODD)
    for i in range(120):
        lines = [speech(rng, "en", rng.randint(1, 15)).rstrip(rng.choice(". ")) for _ in range(rng.randint(0, 6))]
        family = rng.choice(list(licenses.TEMPLATES))
        lines.insert(rng.randint(0, len(lines)), rng.choice([*licenses.texts_of(family), *licenses.NEAR_MISSES]))
        rows.append((100 + i, rng.choice(["\n", "\n\n", " \n# * \n"]).join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("clash")).withColumn("_text", F.lit("clash"))
    got = licenses.scan_licenses(df, license_model).collect()
    want = Counter((i, a, round(b, 4), tuple(c)) for i, t in rows for a, b, c in [license_by_hand(license_model, t)])
    assert Counter((r["doc_id"], r["license"], round(r["score"], 4), tuple((x["family"], x["confirmed"]) for x in r["paragraphs"])) for r in got) == want
    assert licenses.scan_licenses(df.limit(0), license_model).count() == 0


def test_license_accuracy(license_model):
    told = {f: [license_by_hand(license_model, f"noise before.\n{t}\n\nand after") for t in licenses.texts_of(f)] for f in licenses.TEMPLATES}
    right = [a == f for f, all_ in told.items() for a, _, _ in all_]
    assert np.mean(right) > 0.93
    assert np.mean([license_by_hand(license_model, t)[0] in ("none", "unknown") for t in licenses.NEAR_MISSES]) > 0.93
    assert license_by_hand(license_model, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software")[0] == "mit"


HEADERS = {
    "mit": """/* Copyright (c) 2020 Someone
 *
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software, and to permit persons to whom the Software is
 * furnished to do so, subject to the following conditions:
 */""",
    "apache": """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "gpl": """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.""",
    "bsd": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.""",
}


def test_wrapped_headers(spark, license_model):
    rows = [(i, f"import os\n\n{text}\n\ndef main():\n    pass\n") for i, text in enumerate(HEADERS.values())]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), license_model).orderBy("doc_id").collect()
    assert [r["license"] for r in got] == list(HEADERS)
    assert all(x["confirmed"] for r in got for x in r["paragraphs"])


def test_confirmation_decides(spark, license_model):
    """A prediction that no template confirms doesn't stand against a confirmed one, however sure it is."""
    sure = "MIT license granted: this MIT project has MIT license terms, the MIT license of the project."
    text = f"{sure}\n\n{HEADERS['bsd']}"
    chances = license_model.chances(licenses.tokens(sure))
    assert license_model.classes[int(chances.argmax())] == "mit" and chances.max() > 0.7 and not licenses.confirms(licenses.tokens(sure), "mit")
    got = licenses.scan_licenses(spark.createDataFrame([(1, text), (2, sure)], "doc_id long, text string"), license_model).orderBy("doc_id").collect()
    assert [r["license"] for r in got] == ["bsd", "unknown"] and got[1]["score"] == 0.0


def test_license_behind_a_long_text(spark, license_model):
    text = "wort " * 400_000 + "\n" + "x\n" * 100_000 + "\nReleased under the MIT License.\n"
    got = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string"), license_model).collect()
    assert got[0]["license"] == "mit"


def features_by_hand(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
    inside = {j for i in range(len(found) - 7) if windows[tuple(found[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality_rules(spark):
    rng = random.Random(7)
    rows = list(ODD)
    for i in range(150):
        own = [rng.choice(["the", "of", "a", "b", "c#", "é<", "\n", "\t", "  "]) for _ in range(rng.randint(0, 60))]
        rows.append((100 + i, " ".join(own * rng.randint(1, 3))))
    rows.append((999, "the quick brown fox jumps over a lazy dog and runs to the hill in the north of the old town by the sea"))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = quality_rules(df).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == Counter((i, *features_by_hand(t)) for i, t in rows)
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in got)
    assert all(r["kept"] == (not r["base_failed"] and not r["failed_rules"]) for r in got)
    assert [r["kept"] for r in got if r["doc_id"] == 999] == [True] and not any(r["kept"] for r in got if r["doc_id"] in (1, 2, 3, 4))
    assert quality_rules(df.limit(0)).count() == 0


def test_dup_windows_that_overlap(spark):
    text = " ".join(["a"] * 30) + " x y z " + " ".join(map(str, range(9))) + " q " + " ".join(map(str, range(9)))
    got = quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert got["n_repeat_words"] == features_by_hand(text)[4]


def test_frequent_notice_is_no_background(spark):
    """A notice that a third of the documents have, alone in its paragraph or in a longer one, is still found; the background is whole and bounded."""
    rng = random.Random(6)
    notice = "Licensed under the Apache License, Version 2.0."
    for line in (notice, f"Copyright by the authors of this file. {notice} See elsewhere for more of it."):
        rows = [(i, "\n".join([*[line][: i % 3 == 0], *[speech(rng, "en", 12) for _ in range(12)], "software of the project."])) for i in range(200)]
        docs = spark.createDataFrame([*rows, *ODD], "doc_id long, text string")
        found = licenses.sample_background(docs)
        assert found == licenses.sample_background(docs.repartition(3)) and ["project", "software"] in found and not any("apache" in own for own in found)
        assert len(licenses.sample_background(docs, background_paragraphs=7)) == 7
        assert license_by_hand(licenses.fit(found), f"some words\n{notice}\nmore words")[0] == "apache"
    assert licenses.sample_background(docs.limit(0)) == [] and licenses.fit([]).classes[-1] == licenses.UNKNOWN


def test_unlearned_languages_and_junk_go(spark):
    """An absolute fit: the duels of two languages can't reject a text that is neither."""
    import corpus_pipeline

    rng = random.Random(8)
    clean = speeches(900, 3)
    foreign = ["Język polski należy do grupy zachodniosłowiańskiej i jest językiem urzędowym w Polsce", "Русский язык является одним из восточнославянских языков", "Kiswahili ni lugha ya Kibantu inayozungumzwa na watu wengi katika Afrika ya Mashariki"]
    foreign += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(200)) for _ in range(5)]
    rows = [(i, t, lang, "s", 0) for i, t, lang in clean] + [(10_000 + i, t, None, "s", 0) for i, t in enumerate(foreign)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert not [i for i in kept if i >= 10_000] and len(kept) > 0.995 * len(clean)
