"""Quality, toxicity and licence classifiers on held-out rows and odd input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvale.llm import licenses, quality, toxicity

SMALL = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, score double, label int, threshold string"
ODD = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n\t"), (10**6 + 3, "x" * 30_000), (10**6 + 4, "word " * 20_000), (None, "no id"), (10**6 + 4, "word"), (10**6 + 4, "word")]


@pytest.fixture(scope="module")
def data(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")


def odd(spark, rows=ODD):
    return spark.createDataFrame([(i, t, None, 0.5, 1, "x") for i, t in rows], DOCS)


@pytest.mark.parametrize("module, column, least", [(quality, "quality", 0.97), (toxicity, "toxic", 0.85)])
def test_held_out_accuracy(spark, data, module, column, least):
    docs, labels = data
    scored = module.score(docs, module.train(docs, labels)).join(labels, "doc_id").where("held_out").select("score", "predicted", F.col(column).alias("y")).toPandas()
    right = [(a > b) + 0.5 * (a == b) for a in scored.score[scored.y == 1] for b in scored.score[scored.y == 0]]
    assert np.mean(right) > least
    assert (scored.predicted == (scored.score >= 0.3)).all() and scored.score.between(0, 1).all()


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(spark, data, module):
    docs, labels = data
    model = module.train(docs, labels)
    found = module.score(odd(spark), model).collect()
    assert len(found) == len(ODD) and all(0 <= r["score"] <= 1 for r in found)
    assert module.score(odd(spark, []), model).count() == 0


@pytest.mark.parametrize("module, none", [(quality, 0.5), (toxicity, 0.0)])
def test_training_without_labels(spark, module, none):
    model = module.train(odd(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["score"] for r in module.score(odd(spark), model).collect()} == {none}


def test_contradictory_and_null_labels_are_left_out(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (3, 1), (3, 1), (None, 1)], "doc_id long, quality int")
    found = quality.labelled(labels, "quality", F.col("doc_id").isNotNull(), 10).collect()
    assert [(r["doc_id"], r["label"]) for r in found] == [(3, 1)]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_training_on_negative_ids(spark, module):
    docs = spark.createDataFrame([(-i, "bad bad" if i % 2 else "some good words", "en") for i in range(1, 60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(-i, i % 2, i % 2) for i in range(1, 60)], "doc_id long, quality int, toxic int")
    scores = {r["doc_id"]: r["score"] for r in module.score(docs, module.train(docs, labels)).collect()}
    assert scores[-1] > scores[-2]


def test_stages_keep_columns_and_clean_rows(spark, data):
    docs, labels = data
    good = quality.keep_good(docs, labels)
    assert good.columns == docs.columns
    kept = good.join(labels, "doc_id").groupBy("quality").count().collect()
    assert {r["quality"]: r["count"] for r in kept}.get(1, 0) >= 0.98 * labels.where("quality = 1").count()
    assert {r["quality"]: r["count"] for r in kept}.get(0, 0) <= 0.1 * labels.where("quality = 0").count()
    clean = toxicity.keep_clean(docs, labels)
    assert clean.columns == docs.columns and clean.count() < docs.count()


def test_training_words_are_bounded(spark, data):
    assert toxicity.within([(1, 0, 5), (2, 1, 9), (3, 0, 6), (4, 0, 4), (5, 1, 2)], 10) == {1, 2, 4}
    docs, labels = data
    model = toxicity.train(docs, labels, most_words=2000)
    assert model.constant is None or 0 <= model.constant <= 1


def test_tables_without_lang(spark, data):
    docs, labels = data
    bare = docs.drop("lang").limit(60)
    model = toxicity.train(bare, labels)
    assert toxicity.score(bare, model).count() == 60
    assert toxicity.keep_clean(bare, labels).columns == bare.columns


def test_pooling_does_not_reach_over_texts():
    model = toxicity.Convolution(np.zeros((4, toxicity.SIZE), dtype=np.float32), [np.ones((w, toxicity.SIZE, toxicity.FILTERS), dtype=np.float32) for w in toxicity.WIDTHS], np.full(toxicity.FILTERS * 3, -9, dtype=np.float32), np.zeros(toxicity.FILTERS * 3))
    words = np.array([[1.0] * toxicity.SIZE, [2.0] * toxicity.SIZE], dtype=np.float32)
    which, lengths = np.array([0, 1, 1, 0]), np.array([1, 0, 2, 1])
    values, places = model.pooled(words, which, lengths, want_places=True)
    s = toxicity.SIZE
    assert values[:, 0].tolist() == [s, -9, 2 * s, s]
    assert values[:, toxicity.FILTERS].tolist() == [s, -9, 4 * s, s]
    assert values[:, 2 * toxicity.FILTERS].tolist() == [s, -9, 4 * s, s]
    assert places[1].tolist() == [-1] * (3 * toxicity.FILTERS)


def test_licences(spark, data):
    docs, _ = data
    model = licenses.train(docs)
    lines = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "All rights reserved.": "all-rights-reserved", "This work is licensed under the GNU General Public License, version 3.": "gpl"}
    found = {r["doc_id"]: r for r in licenses.scan(docs, model).collect()}
    wrong = 0
    for r in docs.collect():
        want = {lines[x] for x in (r["text"] or "").split("\n") if x in lines}
        wrong += set(found[r["doc_id"]]["families"].split(",")) - {""} != want
    assert len(found) == docs.count() and wrong <= 0.01 * docs.count()
    assert model.scan(b"He lost his driving license in the general reserve.\nAll roads are reserved for the public.") == []
    assert [x[1] for x in model.scan("Foo\nThis program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation\n".encode())] == ["gpl"]
    assert [(r["n_paragraphs"], r["n_licensed"]) for r in licenses.scan(odd(spark, ODD[:2]), model).collect()] == [(1, 0), (1, 0)]
    assert licenses.scan(odd(spark, []), model).count() == 0


WRAPPED = {
    "mit": "MIT License\n\nCopyright (c) 2020 A. Person\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n",
    "bsd": "Copyright 2019 Someone\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above notice\n",
    "isc": "Copyright 2018 Someone\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\nnotice appears in all copies.\n",
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n",
}


def test_wrapped_licences(spark, data):
    model = licenses.train(data[0])
    forms = {
        "plain": lambda t: t,
        "comment": lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.split("\n")) + " */\nint x;\n",
        "hash": lambda t: "".join(f"# {x}\n" for x in t.split("\n")),
        "narrow": lambda t: "\n".join(" ".join(t.split()[i : i + 4]) for i in range(0, len(t.split()), 4)),
        "within one line": lambda t: "some words of a story " * 900 + " ".join(t.split()) + " and so on with the tale" * 900,
    }
    rows = [(n, form(text), family) for n, (form, family, text) in enumerate((f, k, v) for f in forms.values() for k, v in WRAPPED.items())]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").coalesce(1)
    found = {r["doc_id"]: (r["families"], r["n_licensed"]) for r in licenses.scan(docs, model).collect()}
    assert found == {n: (family, 1) for n, _, family in rows}
    half = WRAPPED["gpl"].split("\n", 1)
    docs = spark.createDataFrame([(1, half[0]), (2, half[1].split("\n")[1])], "doc_id long, text string").coalesce(1)
    assert {r["n_licensed"] for r in licenses.scan(docs, model).collect()} == {0}  # no run over two documents
    assert [x[:2] for x in model.scan(b"Title\n" + WRAPPED["bsd"].encode())] == [(3, "bsd")]


@pytest.fixture(scope="module")
def notices(data):
    return licenses.train(data[0])


def families_of(model, text):
    return [x[1] for x in model.scan(text.encode())]


def test_notices_of_every_family(notices):
    for family, texts in licenses.TEMPLATES.items():
        for text in texts:
            words = text.split()
            for width in (3, 8, 12, 1000):
                lines = [" ".join(words[i : i + width]) for i in range(0, len(words), width)]
                for form in ("\n".join(lines), "\n".join(f" * {x}" for x in lines), "Some words before.\n\n" + "\n".join(f"# {x}" for x in lines) + "\n\nMore words."):
                    assert families_of(notices, form) == [family], (family, form)


NEAR_MISSES = {
    "This work is licensed under the GNU Affero General Public License, version 3.": ["agpl"],
    "This work is licensed under the GNU Free Documentation License, version 1.3.": ["gfdl"],
    "This work is licensed under the GNU Lesser General Public License, version 2.1.": ["lgpl"],
    "This work is licensed under the GNU General Public License, version 2.": ["gpl"],
    "Licensed under the Academic Free License, Version 3.0.": ["afl-3.0"],
    "Licensed under the Academic Free License, Version 2.1.": [],
    "Licensed under the Apache License, Version 1.1.": ["apache-1.1"],
    "Licensed under the Apache License, Version 1.0.": [],
    "Licensed under the Mozilla Public License, Version 1.1.": [],
    "Licensed under the Nokia Public License, Version 2.0.": [],
    "Licensed under the Artistic License, Version 2.0.": [],
    "Licensed under the Foobar Public License, Version 2.0.": [],
    "Released under the Python License.": [],
    "Licensed under CC BY-NC-ND 4.0.": [],
    "This work is licensed under a Creative Commons Attribution 3.0 Unported License.": ["cc-by"],
}


@pytest.mark.parametrize("text", NEAR_MISSES)
def test_neighbours_of_known_notices(notices, text):
    assert families_of(notices, text) == NEAR_MISSES[text]


def test_licence_scores_against_plain_loops(notices):
    """The regression's probability, from plain loops over words and neighbouring pairs."""
    import zlib

    paragraphs = [b"", b" ", b"Released under the MIT License.", b"MIT", "é l'été Ä -- x".encode(), b"a " * 500, *(t.encode() for ts in licenses.TEMPLATES.values() for t in ts)]
    want = []
    for p in paragraphs:
        words = p.lower().split()
        hashes = [zlib.crc32(w.strip(licenses._EDGES)) % licenses.BUCKETS for w in words]
        score = notices.bias.astype(float).copy()
        for k, h in enumerate(hashes):
            pair = (h * 40503 + hashes[k + 1] * 30011 + 7) % licenses.BUCKETS + licenses.BUCKETS if k + 1 < len(hashes) else 2 * licenses.BUCKETS
            score += (notices.weights[h].astype(float) + notices.weights[pair]) / len(words) ** 0.5
        e = np.exp(score - score.max())
        want.append(e / e.sum())
    best, chance = notices.predict(paragraphs)
    assert np.allclose(chance, [w.max() for w in want], rtol=1e-4)
    none = len(licenses.FAMILIES) - 1
    assert best.tolist() == [int(w.argmax()) if w.argmax() == none or w.max() >= notices.least else none for w in want]


def test_licences_of_odd_rows(spark, notices):
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "Released under the MIT License."), (2, "x " * 400_000 + "Released under the MIT License." + " y" * 400_000), (3, "\n" * 100_000)]
    found = licenses.scan(odd(spark, rows), notices).collect()
    assert sorted((r["doc_id"] or 0, r["families"]) for r in found) == [(0, "mit"), (1, "mit"), (1, "mit"), (2, "mit"), (3, "")]


def test_quality_scores_against_plain_loops(spark, data):
    """Mahalanobis log-density differences by inverse and determinant, over statistics counted character by character."""
    import math

    docs, labels = data
    model = quality.train(docs, labels)
    texts = [r["text"] for r in docs.limit(40).collect()] + [None, "", "A b, 1! ß\nA b, 1! ß\n\nx x x"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in quality.score(frame, model).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        letters = [chr(b) for b in raw]
        share = lambda test: math.sqrt(sum(map(test, letters)) / max(1, len(letters)))
        upper, lower, digit = (lambda c: "A" <= c <= "Z"), (lambda c: "a" <= c <= "z"), (lambda c: "0" <= c <= "9")
        stop, high = (lambda c: c in ".,;:?"), (lambda c: ord(c) > 127)
        symbol = lambda c: 33 <= ord(c) < 127 and not (upper(c) or lower(c) or digit(c) or stop(c))
        words, lines = raw.split(), raw.split(b"\n")
        n = max(1, len(words))
        bare = "".join(c for c in letters if not (upper(c) or lower(c) or digit(c) or stop(c) or high(c)))
        x = np.array([
            math.log(1 + len(words)), math.log(1 + len(raw) / n), share(upper), share(lower), share(digit), share(stop), share(symbol), share(high),
            math.sqrt(sum(words[k] == words[k + 1] for k in range(len(words) - 1)) / n), math.log(1 + len(set(words))) / math.log(1 + n),
            math.log(1 + len(lines)) / math.log(2 + n), math.sqrt(1 - len(set(lines)) / len(lines)), math.sqrt(len(bare.split()) / n),
            math.log(1 + max([len(w) for w in words], default=0)),
        ])
        z = (x - model.centre) / model.scale
        density = []
        for mean, factor in zip(model.means, model.factors):
            cov = factor @ factor.T
            density.append(-0.5 * (z - mean) @ np.linalg.inv(cov) @ (z - mean) - 0.5 * np.linalg.slogdet(cov)[1])
        raw_score = density[1] - density[0]
        raw_score = math.copysign(math.sqrt(abs(raw_score)), raw_score)
        assert found[i] == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, model.slope * raw_score + model.shift)))), rel=1e-6, abs=1e-9)


def test_toxicity_scores_against_plain_loops(spark, data):
    """Embeddings, filters, largest activations and the logistic map, word by word."""
    import math

    docs, labels = data
    model = toxicity.train(docs, labels)
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(25).collect()] + [None, "", "one", "Ä! two", "bad " * 400]
    frame = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in toxicity.score(frame, model).collect()}
    for i, text in enumerate(texts):
        vectors = [sum(model.embedding[b].astype(float) for b in toxicity.word_buckets(w)) for w in (text or "").encode().split()]
        pooled = []
        for k, (width, filters) in enumerate(zip(toxicity.WIDTHS, model.filters)):
            for f in range(toxicity.FILTERS):
                most = float(model.bias[k * toxicity.FILTERS + f])
                for at in range(len(vectors)):  # windows over the end are shorter
                    most = max(most, sum(float(vectors[at + o] @ filters[o][:, f]) for o in range(width) if at + o < len(vectors)))
                pooled.append(most)
        raw = float(np.dot(pooled, model.weights)) + model.shift
        want = 1 / (1 + math.exp(-max(-40, min(40, model.slope * raw + model.offset))))
        assert found[i]["score"] == pytest.approx(want, rel=1e-3, abs=1e-6)
        assert found[i]["predicted"] == int(found[i]["score"] >= 0.3) and found[i]["flagged"] == (found[i]["score"] >= model.threshold("en"))


def test_thresholds_come_from_all_labelled_rows_that_were_not_fitted(spark):
    """Quantiles by language against a sort; rows fitted on, held out or with contradictory labels have no say."""
    import zlib

    number = lambda lang: None if lang is None else zlib.crc32(lang.encode()) % toxicity.LANGUAGES
    rng = np.random.default_rng(3)
    rows = []
    for i in range(3000):
        label = int(rng.random() < 0.3)
        lang = "en" if i % 3 else [None, "de", "xx"][i % 9 // 3]
        rows.append((i, lang, label, float(np.clip(rng.normal(0.15 + 0.6 * label, 0.08), 0, 1))))
    fitted = set(range(0, 3000, 7))
    model = toxicity.Convolution(np.zeros((1, 1)), [], np.zeros(1), np.zeros(1), fitted=np.array(sorted(fitted)))
    few = {i for i, lang, label, _ in rows if lang == "xx" and label == 1}
    labels = [(i, label) for i, lang, label, _ in rows if i not in few] + [(5, 0), (5, 1)]
    scores = spark.createDataFrame([(i, number(lang), score) for i, lang, _, score in rows], "doc_id long, language int, score double")
    toxicity.calibrate(model, scores, spark.createDataFrame(labels, "doc_id long, toxic int"))
    known = [r for r in rows if r[0] not in fitted | few | {5} and zlib.crc32(str(r[0]).encode()) % 4 != 2]

    def expected(some):
        clean, toxic = (sorted(r[3] for r in some if r[2] == k) for k in (0, 1))
        low, high = clean[int(np.ceil(0.99 * len(clean))) - 1], toxic[int(np.ceil(0.02 * len(toxic))) - 1]
        return float(np.clip((low + high) / 2, *toxicity.THRESHOLDS))

    assert set(model.thresholds) == {None, number("en"), number("de")}
    for lang in ("en", "de"):
        assert abs(model.threshold(lang) - expected([r for r in known if r[1] == lang])) < 2 / toxicity.STEPS
    assert abs(model.threshold(None) - expected(known)) < 2 / toxicity.STEPS
    assert model.threshold("xx") == model.threshold(None)


def test_keep_clean_with_columns_of_its_own_names(spark, data):
    docs = data[0].limit(80).withColumns({"language": F.lit("x"), "score": F.lit(1), "Threshold": F.lit(2)})
    clean = toxicity.keep_clean(docs, data[1])
    assert clean.columns == docs.columns and 0 < clean.count() <= 80
