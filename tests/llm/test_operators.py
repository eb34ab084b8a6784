"""Each operator against a brute-force version, on texts that are null, empty, long, tied and repeated, and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripmill.llm import ann, lm_scoring, mixing, near_dedup, packing, quality_classifier, quality_rules, secret_scan, substring_dedup, textkernel
from tripmill.llm import license_scan as licenses
from tripmill.llm.common import Scratch
from tripmill.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node string, kept string, found string"
SPACES = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACES.split(text or "") if w]


def make(spark, texts, ids=None, sources=None):
    """Documents with extra columns whose names clash with those of the operators."""
    ids = ids if ids is not None else range(len(texts))
    sources = sources or [f"s{i % 3}" for i in range(len(texts))]
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 0.5, "n", "k", "f") for i, t, s in zip(ids, texts, sources)], SCHEMA).repartition(3)


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "tion", "ing", "Éau", "ñé", "stone", "river", "Light", "0x1f", "walk"]) + rng.choice(["", "s", "ed", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    near = []
    for t in base[:12]:
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    odd = [None, "", "   \n\t ", "word", "Word", "same line\nsame line\n\nsame line", "a" * 3000, "x\x85y\xa0z \x1c q", "####", "😀 " * 150, prose(rng, 9000), "A&B " * 500]
    return base + near + base[:5] + odd


def by_row(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def key(rows):
    return sorted(rows, key=repr)


# 1


def test_quality_rules(spark, texts):
    want = []
    for i, t in enumerate(texts):
        w = words(t)
        grams = defaultdict(list)
        for j in range(len(w) - 7):
            grams[tuple(w[j : j + 8])].append(j)
        covered = {k for at in grams.values() if len(at) > 1 for j in at for k in range(j, j + 8)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        n, rep = len(w), len(covered)
        want.append((i, n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), rep, n < 20 or 100 * rep > 30 * n))
    rows = quality_rules.ledger(make(spark, texts))
    got = quality_rules.apply_policy(rows, quality_rules.BASE).withColumn("bad", ~F.col("kept"))
    assert by_row(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "bad") == want
    for version in quality_rules.POLICIES:
        kept = quality_rules.apply_policy(rows, version).where("kept").count()
        report = quality_rules.ablation(rows, version).collect()
        assert {r.n_kept for r in report} == {kept} and len(report) == len(quality_rules.POLICIES[version])
        for r in report:
            rest = quality_rules.mask(version) & ~r.bit
            assert r.n_kept_without == rows.where(F.col("failed").bitwiseAND(F.lit(rest)) == 0).count() == kept + r.n_only


# 2


def test_license_scan(spark):
    texts = [
        None, "", "nothing here", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "CC-BY cc by, CC\nBY-NC 4.0", "xcc by ccby",
        "All rights reserved. all rights reserved", "Released under the MIT License. MIT license", "zero license", "SPDX-License-Identifier: GPLv3", "ALL RIGHTS RESERVED é all-rights-reserved",
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(make(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        at = [(j, label) for phrase, label in licenses.BASE for j in range(len(w)) if w[j : j + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(at)), t
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert "apache-2.0" in got[3].labels and "apache," not in got[3].labels + ","  # the shorter name lies within the longer
    assert got[4].labels == "gpl,gpl-3.0" and "mit" in got[8].labels and got[9].labels == "" and "gpl-3.0" in got[10].labels and got[2].score == 0


def test_license_rules_each_have_a_text():
    """Every rule, in every choice: it opens the gate, its keyword is there, and it matches its own words."""
    from itertools import product

    from tripmill.llm.license_rules import parsed

    assert len(licenses.rules()) > 250
    for (tier, label, keyword, pattern), (*_, words_) in zip(licenses.rules(), parsed()):
        fixed = [w for w in words_.split() if not w.endswith("?")]
        whole = [w.rstrip("?") for w in words_.split()]
        for tokens in (fixed, whole):
            for text in product(*(w.strip("()").split("|") for w in tokens)):
                spaced = "".join(f" {w} " for w in text)
                opens = any(all(stem in " ".join(text) for stem in stems) and re.search(regex, " ".join(text)) for stems, regex in licenses.GATE)
                assert opens and keyword in spaced and re.fullmatch(pattern, spaced), (label, text)


def test_license_texts(spark):
    """Texts as they occur, with the labels wanted and, after a bar, labels that a containing detection suppresses."""
    cases = [
        ("SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"), ("SPDX-License-Identifier: ISC", "isc"), ("SPDX-License-Identifier: MPL-2.0", "mpl-2.0"),
        ("SPDX-License-Identifier: EPL-2.0", "epl-2.0"), ("SPDX-License-Identifier: BSL-1.0", "bsl-1.0"), ("SPDX-License-Identifier: Zlib", "zlib"), ("licensed under Apache 2.0", "apache-2.0"), ("Licensed under MIT", "mit"),
        ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0-or-later|gpl-2.0,gpl-2.0-only"), ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"), ("This program is distributed under the terms of the GNU General Public License, version 3.", "gpl-3.0|gpl"),
        ("see https://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa-4.0"), ("CC BY-SA 4.0", "cc-by-sa"), ("Expat License", "mit"), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0|mpl"),
        ("This is free and unencumbered software released into the public domain.", "unlicense|public-domain"), ("Proprietary and confidential", "confidential"), ("For internal use only.", "internal-use"), ("the river mitigates general use", ""),
    ]
    docs = [t for t, _ in cases]
    rows = {r.doc_id: r for r in licenses.scan_licenses(make(spark, docs + docs)).collect()}
    for i, (text, labels) in enumerate(cases):
        wanted, _, never = labels.partition("|")
        got = set(rows[i].labels.split(",")) - {""}
        extra = {label for phrase, label in licenses.BASE if phrase in re.sub(r"[^a-z0-9]+", " ", text.lower())}
        assert set(filter(None, wanted.split(","))) <= got and not (set(filter(None, never.split(","))) - extra) & got, (text, got)
        assert wanted or not got
        assert rows[i + len(cases)].labels == rows[i].labels  # repeated rows


# 3


def test_quality_classifier(spark):
    rng = random.Random(3)
    good = [prose(rng, rng.randint(30, 80)) for _ in range(150)]
    bad = [" ".join(rng.choice(["###", "$$", "BUY!!"]) + w for w in prose(rng, 40).split()) for _ in range(150)]
    docs = make(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    forest = quality_classifier.train(docs, labels, trees=30)
    rows = quality_classifier.score_quality(docs, forest).collect()
    assert len(rows) == 302
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id < 300]
    folds = make(spark, ["x"] * 50).withColumn("f", quality_classifier.fold(F.col("doc_id")))
    assert held and all(r.f == zlib.crc32(str(r.doc_id).encode()) % 5 for r in folds.collect())
    assert sum((r.score >= 0.3) == (r.doc_id < 150) for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality_classifier.score_quality(docs, quality_classifier.train(docs, flipped, trees=30)).collect()}
    assert all(math.isclose(again[r.doc_id], r.score) for r in rows)  # held-out labels are never read
    assert quality_classifier.keep_good(docs, labels).columns == docs.columns
    none = quality_classifier.train(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.score_quality(docs, none).collect()} == {0.5}


def test_forest_walk():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(400, len(quality_classifier.FEATURES))), rng.integers(0, 2, 400).astype(float)
    forest = quality_classifier.fit(x, y, trees=5, depth=3)
    for i in range(20):
        raw = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            for _ in range(3):
                node = 2 * node + (2 if x[i, f[node]] > t[node] else 1)
            raw += leaf[node - 7]
        assert math.isclose(1 / (1 + math.exp(-raw)), forest.score(x[i : i + 1])[0])


def test_features_against_a_loop(texts):
    import pyarrow as pa

    got = quality_classifier.features(pa.array(texts))
    assert got.shape == (len(texts), len(quality_classifier.FEATURES))
    groups = {"stops": b".", "commas": b",;:", "exclamations": b"!", "bars": b"|", "symbols": b"#*$%&<>", "lines": b"\n"}
    for row, text in zip(got, texts):
        data = (text or "").encode()
        w = re.findall(rb"[^\x20\x09-\x0d]+", data)
        sizes = [len(x) for x in w] or [0]
        n, k = max(len(data), 1), max(len(w), 1)
        want = {
            "log_bytes": math.log1p(len(data)), "log_words": math.log1p(len(w)), "word_bytes": sum(sizes) / k, "word_spread": float(np.std(sizes)), "letters": sum(97 <= c <= 122 for c in data) / n, "uppers": sum(65 <= c <= 90 for c in data) / n,
            "digits": sum(48 <= c <= 57 for c in data) / n, "high_bytes": sum(c >= 128 for c in data) / n, **{g: sum(c in chars for c in data) / k for g, chars in groups.items()},
        }
        if w:
            pairs = list(zip(w, w[1:]))
            want |= {"distinct_words": len(set(w)) / len(w), "top_word": max(Counter(w).values()) / len(w), "capitals": sum(65 <= x[0] <= 90 for x in w) / len(w)}
            want |= {"equal_neighbours": sum(a == b for a, b in pairs) / len(pairs), "distinct_pairs": len(set(pairs)) / len(pairs)} if pairs else {}
        if data:
            lines = data.split(b"\n")
            want["duplicate_lines"] = 1 - len(set(lines)) / len(lines)
        for name, value in want.items():
            assert math.isclose(row[quality_classifier.FEATURES.index(name)], value, rel_tol=1e-9, abs_tol=1e-12), (name, text and text[:30])


def test_histogram_split_is_the_best_one():
    """The root of the first tree against every cut of every feature, with few enough values that each has a bin of its own."""
    rng = np.random.default_rng(5)
    columns = len(quality_classifier.FEATURES)
    x, y = rng.integers(0, 12, (300, columns)).astype(float), rng.integers(0, 2, 300).astype(float)
    y[x[:, 4] > 7] = 1.0
    forest = quality_classifier.fit(x, y, trees=1, depth=1, ridge=1.0, least=1.0)
    p = np.full(300, y.mean())
    g, h = p - y, p * (1 - p)

    def gain(f, cut):
        right = x[:, f] > cut
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
        return part(right) + part(~right) - g.sum() ** 2 / (h.sum() + 1.0)

    best = max((gain(f, c), f, c) for f in range(columns) for c in range(11))
    assert math.isclose(gain(forest.feature[0, 0], forest.threshold[0, 0]), best[0]) and forest.feature[0, 0] == 4
    right = x[:, 4] > forest.threshold[0, 0]
    assert np.allclose(forest.leaf[0], [-0.15 * g[m].sum() / (h[m].sum() + 1.0) for m in (~right, right)])


# 4


def test_ann(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8)).round(3)
    x[50:90] = x[50]  # a common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [1.0] * 7 + [None]), (1003, [float("nan")] * 8), (1004, [1.0] * 3), (None, [1.0] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest_neighbours(vectors, vectors.where("vec_id % 50 = 0"), block=60).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(got) == [i for i in range(0, 400, 50)]
    hit = total = 0
    for q, found in got.items():
        cos = {i: float(x[i] @ x[q] / math.sqrt((x[i] @ x[i]) * (x[q] @ x[q]))) for i in range(400) if i != q}
        best = sorted(cos, key=lambda i: (-round(cos[i], 12), i))[:5]
        assert [r for r, *_ in found] == [1, 2, 3, 4, 5] and all(abs(s - cos[v]) < 1e-12 for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        hit, total = hit + len({v for _, v, _ in found} & set(best)), total + 5
    assert hit / total >= 0.9
    assert [v for _, v, _ in got[50]] == [51, 52, 53, 54, 55]
    few = vectors.where("vec_id < 3")
    assert ann.nearest_neighbours(few, few.where("vec_id = 0")).count() == 2
    assert ann.nearest_neighbours(vectors.limit(0), vectors.limit(0)).count() == 0


def test_ann_tight_clusters_and_outliers(spark):
    """Tight clusters set a small budget; queries alone in their cell, or with a cell of their own rows, still get five others."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 8))
    x = [(i, centres[i % 12].tolist()) for i in range(600)]
    x += [(1000 + i, [*centres[i, :4], *centres[i + 1, 4:]]) for i in range(2)]  # a cell that no cluster has
    x += [x[-1]] * 20  # many rows of one id
    x = [(i, [float(c) for c in v]) for i, v in x]
    vectors = spark.createDataFrame(x, "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id % 3 = 0 OR vec_id >= 1000")
    got = Counter(r.query_id for r in ann.nearest_neighbours(vectors, queries).collect())
    assert got == {i: 5 for i, _ in x if i % 3 == 0 or i >= 1000}


def test_ann_extreme_and_short_vectors(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e-200, 1e-200]), (2, [5e-324, 0.0]), (3, [-1e308, 1e308]), (4, [3.0, 4.0]), (5, [float("inf"), 1.0]), (6, [0.0, 0.0]), (4, [3.0, 4.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.nearest_neighbours(vectors, vectors.where("vec_id IN (0, 3, 4)")).collect()}
    assert got[0, 1] == (2, 1.0) and abs(got[0, 2][1] - math.sqrt(0.5)) < 1e-15 and got[0, 2][0] == 1 and len([1 for q, _ in got if q == 4]) == 4
    assert [got[0, r][0] for r in (3, 4)] == [4, 4] and abs(got[3, 1][1] - 1 / math.sqrt(50)) < 1e-15
    flat = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate((3, -2, 5, 0))], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in ann.nearest_neighbours(flat, flat.where("vec_id = 0")).orderBy("rank").collect()] == [(2, 1.0), (1, -1.0)]


def test_traversal_is_in_order():
    rng = np.random.default_rng(2)
    a, b = rng.uniform(size=6), rng.uniform(size=5)
    cells = list(ann.traverse(a, b))
    assert len(set(cells)) == 30 and [a[i] + b[j] for i, j in cells] == sorted(a[i] + b[j] for i, j in cells)


# 5


def test_packing(spark, texts):
    docs = make(spark, [*texts, "<|endoftext|> special", "漢字 and кириллица"])
    got = packing.pack(docs, capacity=64).collect()
    encode = packing._tokenizer(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for i, t in enumerate([*texts, "<|endoftext|> special", "漢字 and кириллица"]):
        ids = np.array([*encode.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 64 for r in own[1:]) and (len(own) == 1 or len(ids) > 64)
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.03 * sum(r.length for r in got) / 64 + 2
    doubled = packing.pack(docs.union(docs), capacity=64)
    assert doubled.count() == 2 * len(got) and doubled.select("sequence_id", "offset").distinct().count() == 2 * len(got)


@pytest.mark.parametrize("counts", [{}, {1: 5}, {2048: 3}, {1025: 10}, {700: 9, 648: 3, 300: 50, 5: 900}, {s: 1 + s % 3 for s in range(1, 2049)}])
def test_plan_places_every_piece(counts):
    rows, used, fill = packing.plan(counts), defaultdict(list), Counter()
    for s, first, bins, copies, base, at in rows.tolist():
        used[s].append((first, first + bins * copies))
        for b in range(base, base + bins):
            fill[b] += s * copies
    for s, n in counts.items():
        spans = sorted(used[s])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    total = sum(s * n for s, n in counts.items())
    assert max(fill.values(), default=0) <= 2048 and sorted(fill) == list(range(len(fill)))
    assert 2048 not in counts or len(counts) > 1 or len(fill) == 3
    if len(counts) > 100:
        assert len(fill) <= 1.02 * total / 2048 + 2


# 6


def brute_targets(sizes, most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s] + 1e-9}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark, texts):
    sources = [("big" if i % 2 else "zé" if i % 5 else None) if i % 7 else f"tiny{i % 3}" for i in range(len(texts))]
    docs = make(spark, texts, sources=sources)
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(texts)
    sizes, taken = Counter(), Counter()
    for s, t in zip(sources, texts):
        sizes[s] += len(words(t))
    target = brute_targets(sizes)
    for r in rows:
        assert r["size"] == len(words(texts[r.doc_id])) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r["size"]
        assert abs(r.target - target[r.source]) < 1e-6
        taken[r.source] += r.taken
    longest = {s: max(len(words(t)) for x, t in zip(sources, texts) if x == s) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in sizes) and sum(taken.values()) == sum(sizes.values())
    queue = sorted((r.finish + k * r.source_size / r.target, str(r.source), r["size"]) for r in rows if r["size"] for k in range(min(3, int(r.target / r.source_size) + 1)))
    left, whole = sum(sizes.values()), 0
    for _, _, n in queue:  # served whole in the order of finish while the budget lasts
        if n > left:
            break
        left, whole = left - n, whole + n
    assert abs(sum(r.taken for r in rows if r["size"] and r.taken % r["size"] == 0) - whole) <= max(longest.values())
    odd = make(spark, ["a b c", "a b c", "d e", "", None], ids=[4, 4, None, 7, None])
    assert sorted(r.taken for r in mixing.mix_sources(odd).collect()) == [0, 0, 0, 3, 5] and mixing.mix_documents(odd).count() == 6
    assert by_row(mixing.mix_sources(docs.repartition(7)), "doc_id", "taken") == by_row(mixing.mix_sources(docs), "doc_id", "taken")
    order = mixing.service_order(mixing.mix_sources(docs)).collect()
    assert sum(r.words for r in order) == sum(taken.values()) and [r.finish for r in order] == sorted(r.finish for r in order)
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.mix_sources(docs.limit(0)).count() == 0


# 7


def brute_repeats(texts, ids, length):
    seen, out = set(), {}
    for i in sorted(range(len(texts)), key=lambda i: ids[i]):
        b = (texts[i] or "").encode()
        cut = np.zeros(len(b), bool)
        for at in range(len(b) - length + 1):
            s = b[at : at + length]
            if s in seen:
                cut[at : at + length] = True
            seen.add(s)
        runs = int((np.diff(np.r_[0, cut.astype(int)]) == 1).sum())
        out[ids[i]] = (len(b), int(cut.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cut])).hexdigest())
    return out


@pytest.mark.parametrize("cover", ["minimal", "residues"])
@pytest.mark.parametrize("hot", [20_000, 3])
def test_substring_dedup(spark, texts, cover, hot):
    rng = random.Random(11)
    passage = prose(rng, 60)
    more = [prose(rng, 20) + passage + prose(rng, 10) for _ in range(12)] + [passage * 3, "ab" * 400, "z" * 500, passage[5:]]
    docs = [*texts, *more]
    want = brute_repeats(docs, list(range(len(docs))), 100)
    got = substring_dedup.remove_repeats(make(spark, docs), cover=cover, hot=hot).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(docs)


def test_difference_set():
    d = substring_dedup.difference_set()
    assert len(d) == 8 and len({(a - b) % 57 for a in d for b in d if a != b}) == 56


def test_substring_dedup_repeated_and_missing_ids(spark):
    rng = random.Random(5)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = substring_dedup.remove_repeats(make(spark, [a, a, b + a, a, b], ids=[1, 1, 2, None, 3])).collect()
    got = sorted(((r.doc_id if r.doc_id is not None else 99, r.n_removed) for r in rows))
    n, m = len(a.encode()), len(b.encode())
    assert got == [(1, 0), (1, 0), (2, n), (3, m), (99, 0)]
    assert substring_dedup.remove_repeats(make(spark, ["x"]).limit(0)).count() == 0


# 8


def brute_secrets(t):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t or "", re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t or "") if len(m[0]) >= 32]
    return sorted(out)


def test_secret_scan(spark, texts):
    rng = random.Random(9)
    pick = lambda abc, n: "".join(rng.choice(abc) for _ in range(n))
    planted = [
        'é password: "hunter2hunter2" and API_KEY=abc', "token = " + pick("0123456789abcdef", 40), "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), "AKIAshort AKIA1234", "password:token:abcdefgh1", "secret=token=abcdefghijk",
        "deadbeef" * 5, "Token='" + pick("abcXYZ0189+/", 30) + "'", "aKIA" + "B" * 20, pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 44), "abcXYZ123" * 15, "😀" * 5 + "passwd=12345678",
    ]
    docs = [*texts, *planted]
    kinds = ("assign", "access", "hex", "random")
    for r in secret_scan.scan_secrets(make(spark, docs)).collect():
        want = brute_secrets(docs[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in want) for j in range(3)), docs[r.doc_id]
        line = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))
        if r.doc_id == len(texts) + 9:
            assert r.spans == "random:0:44"
        if r.doc_id == len(texts) + 10:
            assert r.spans == ""  # a pattern is not random
    clean = secret_scan.redact_secrets(make(spark, docs))
    assert clean.columns == make(spark, docs).columns
    for r in clean.collect():
        assert not brute_secrets(r.text) and (brute_secrets(docs[r.doc_id]) or r.doc_id == len(texts) + 9 or r.text == docs[r.doc_id])
    assert secret_scan.scan_secrets(make(spark, docs).limit(0)).count() == 0


def test_randomness_of_random_runs(spark):
    rng = random.Random(1)
    runs = [["".join(rng.choice("0123456789abcdef") for _ in range(64))] for _ in range(300)] + [["0123456789abcdef" * 4]]
    df = spark.createDataFrame(runs, "x string").select(F.array(F.struct(F.lit(0).alias("s"), F.lit(64).alias("e"), "x")).alias("r"))
    ps = [r.m.p for r in secret_scan.randomness(df, "r").select(F.explode("r").alias("m")).collect()]
    assert 0.005 < np.mean([p < 0.05 for p in ps[:300]]) < 0.1 and ps[300] < 1e-4


STEMS = ("response", "event", "view", "model", "user", "account", "session", "index", "handler", "factory", "service", "manager", "request", "widget", "config", "update", "mapping", "render", "state", "parser", "Stream")


@pytest.mark.parametrize("style", ["camel", "snake", "capitals", "path"])
def test_reported_runs_are_keys_and_not_names(spark, duck, style):
    """A thousand names with a number, and a hundred keys, of like lengths: few names are reported, nearly all keys; and SQL agrees."""
    rng = random.Random(13)
    names, keys = [], []
    while len(names) < 1000:
        w = rng.sample(STEMS, 3)
        n = {"camel": "".join(x.title() for x in w), "snake": "_".join(w), "capitals": "_".join(w).upper(), "path": "/".join(w)}[style] + str(rng.choice([7, 42, 2024]))
        if len(n) >= 20:
            names.append(f"uses {n} here")
    abc = secret_scan.ALPHABETS["base62"]
    while len(keys) < 100:
        k = "".join(rng.choice(abc) for _ in range(rng.randint(20, 28)))
        if any(c.isdigit() for c in k):
            keys.append(f"key {k}.")
    docs = make(spark, [*names, *keys])
    rows = secret_scan.scan_secrets(docs).collect()
    hit = {r.doc_id for r in rows if "random" in r.spans}
    assert len([i for i in hit if i < 1000]) < 0.05 * len(hit) and len([i for i in hit if i >= 1000]) >= 90
    frame = docs.select("doc_id", "text").toPandas()
    con = duck.cursor()
    con.register("documents_here", frame)
    want = con.execute(secret_scan._sql().replace("FROM documents)", "FROM documents_here)")).df()
    assert dict(zip(want.doc_id, want.spans)) == {r.doc_id: r.spans for r in rows}


def test_many_matches_in_one_text(spark):
    """40 000 matches of one text within seconds, in the scan and when they are cut out."""
    import time

    text = "token=abcdefgh12 " * 40_000
    docs = make(spark, [text, None])
    began = time.time()
    got = {r.doc_id: r for r in secret_scan.scan_secrets(docs).collect()}
    assert (got[0].n_assign, got[1].n_assign) == (40_000, 0)
    assert secret_scan.redact_secrets(docs).where("doc_id = 0").first().text == "[secret] " * 40_000
    assert time.time() - began < 60
    licensed = licenses.scan_licenses(make(spark, ["mit license. " * 20_000])).first()
    assert licensed.n_words == 40_000 and licensed.labels == "mit" and time.time() - began < 120


# 9


def brute_components(texts, ids, width=2):
    sets = []
    for t in texts:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    label = list(ids)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if ids[i] == ids[j] or (sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))]
    for _ in ids:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return sorted((i, len(s), c, c == i) for i, s, c in zip(ids, sets, label))


@pytest.mark.parametrize("options", [{}, {"small": 4, "block": 4}])
def test_near_duplicates(spark, texts, options):
    rng = random.Random(2)
    base = prose(rng, 150).split(" ")
    chain = []
    for _ in range(25):  # each close to the one before
        base = base[:]
        base[rng.randrange(len(base))] = f"w{rng.random()}"
        chain.append(" ".join(base))
    docs = [*texts, *chain, *chain[:3]]
    got = near_dedup.near_duplicates(make(spark, docs), **options)
    assert by_row(got, "doc_id", "n_shingles", "component_id", "kept") == brute_components(docs, list(range(len(docs))))


def test_near_duplicates_in_a_large_group(spark):
    """One template filled in many ways, alike but not linked, with linked pairs among them that no window of a few rows holds."""
    rng = random.Random(5)
    docs = []
    for i in range(400):
        w = [f"t{j}" for j in range(200)]
        for j in rng.sample(range(0, 200, 5), 18):
            w[j] = f"d{i}x{j}"
        docs.append(" ".join(w))
        if i % 8 == 0:  # a copy with ten words of the template's changed again
            for j in rng.sample(range(2, 200, 5), 10):
                w[j] = f"e{i}x{j}"
            docs.append(" ".join(w))
    expected = brute_components(docs, list(range(len(docs))))
    assert 40 <= sum(not kept for *_, kept in expected) < 200
    got = near_dedup.near_duplicates(make(spark, docs), small=16, block=8, orders=2)
    assert by_row(got, "doc_id", "n_shingles", "component_id", "kept") == expected


def test_near_duplicates_in_one_template(spark):
    """Three thousand documents of one template, mostly just under the threshold of each other, in pairs just above it."""
    rng = np.random.default_rng(21)
    docs, keep = [], []
    for i in range(1500):
        w = np.array([f"t{j}" for j in range(200)], dtype=object)
        slots = rng.permutation(np.arange(1, 199, 2))
        for part in (slots[:9], slots[9:19]):  # a document, then its copy with ten words more of the template changed
            w = w.copy()
            w[part] = [f"d{i}x{j}" for j in part]
            docs.append(" ".join(w))
            old = np.array([x.startswith("t") for x in w])
            keep.append(old[1:] & old[:-1])
    template = np.array(keep, np.float32)
    both = np.rint(template @ template.T).astype(int)
    pair = np.arange(0, 3000, 2)
    both[pair, pair + 1] += 18  # two shingles for each word that the copy shares with its document alone
    linked = 100 * both >= 80 * (2 * 199 - both)
    label = near_dedup.stars(3000, *np.nonzero(np.triu(linked, 1)))
    got = dict(by_row(near_dedup.near_duplicates(make(spark, docs)), "doc_id", "component_id"))
    assert linked[pair, pair + 1].all() and len(set(label.tolist())) > 300
    assert [got[i] for i in range(3000)] == label.tolist()


def test_near_duplicates_by_five_words(spark):
    base = [f"w{i}" for i in range(200)]
    few, many = base[:], base[:]
    for j in (20, 90, 160):
        few[j] = "x"
    for j in range(5, 200, 16):
        many[j] = f"y{j}"
    short = ["a b c", "a  b\tC", "a b d"]
    got = dict(by_row(near_dedup.near_duplicates(make(spark, [" ".join(base), " ".join(few), " ".join(many), *short]), width=5), "doc_id", "component_id"))
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5}
    assert dict(by_row(near_dedup.near_duplicates(make(spark, [" ".join(base), " ".join(many)])), "doc_id", "component_id")) == {0: 0, 1: 1}


def test_near_duplicates_odd_ids(spark):
    rng = random.Random(3)
    a, b, c = (prose(rng, 40) for _ in range(3))
    docs = make(spark, [a, b, b, c, a, c], ids=[5, 5, 9, 2, None, 7])
    got = sorted(((r.doc_id if r.doc_id is not None else 99, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()))
    assert got == [(2, 2, True), (5, 5, True), (5, 5, True), (7, 2, False), (9, 5, False), (99, None, True)]
    kept = near_dedup.one_of_each(docs)
    assert sorted(r.doc_id or 99 for r in kept.collect()) == [2, 5, 99] and kept.columns == docs.columns
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, None)]
    label = {x: x for e in edges for x in e if x is not None}
    for _ in range(200):
        for a, b in edges:
            if b is not None:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect()}
    assert got == {k: v for k, v in label.items() if k in got} and len(got) >= len({x for a, b in edges if b is not None and a != b for x in (a, b)})


# 10


def test_lm_scoring(spark, texts):
    rng = random.Random(6)
    target = ["calm river stone light " * rng.randint(5, 20) for _ in range(30)]
    docs = make(spark, [*texts, *target])
    first = len(texts)
    chosen = spark.createDataFrame([(first + i,) for i in range(20)] + [(None,)], "doc_id long")
    models = lm_scoring.train(docs, chosen, strength=2.0)
    rows = {r.doc_id: r for r in lm_scoring.score_documents(docs, models).collect()}
    assert len(rows) == len(texts) + 30
    low = [tuple(words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for t in [*texts, *target]]
    single, pair = [Counter(), Counter()], [Counter(), Counter()]
    for i, w in enumerate(low):
        for m in (1, 0) if first <= i < first + 20 else (1,):
            single[m].update(w), pair[m].update(zip(("<s>", *w), w))
            single[m]["<s>"] += bool(w)
    scale = sum(single[0].values()) / sum(single[1].values())
    total, used = sum(single[0].values()), len(single[1])

    def loss(m, v, w):
        f = scale if m else 1
        p = (single[m][w] * f + 1) / (total + used + 1)
        return -math.log((pair[m][v, w] * f + 2.0 * p) / (single[m][v] * f + 2.0))

    for i, w in enumerate(low):
        assert rows[i].n_tokens == len(w)
        if not w:
            assert rows[i].score == 0 and rows[i].target_loss is None
        else:
            t, b = (np.mean([loss(m, v, x) for v, x in zip(("<s>", *w), w)]) for m in (0, 1))
            assert abs(rows[i].score - (t - b)) < 1e-9, (i, rows[i], t, b)
    assert max(rows[first + i].score for i in range(20, 30)) < min(rows[i].score for i in range(40) if low[i])
    assert {r.score for r in lm_scoring.score_documents(docs, lm_scoring.train(docs, chosen.limit(0))).collect()} == {0.0}
    empty = docs.limit(0)
    assert lm_scoring.score_documents(empty, lm_scoring.train(empty, chosen)).count() == 0


def test_lm_scoring_keeps_every_count(spark, monkeypatch):
    """Far more words and pairs than the smallest hashed vocabulary had buckets: every loss is still exact."""
    monkeypatch.setattr(lm_scoring, "SLICE", 100_000, raising=False)  # several slices
    rng = random.Random(8)
    low = [tuple(f"w{int(rng.paretovariate(0.2)) % 40_000}" for _ in range(600)) for _ in range(300)]
    docs = make(spark, [" ".join(w) for w in low])
    chosen = spark.createDataFrame([(i,) for i in range(0, 300, 3)], "doc_id long")
    models = lm_scoring.train(docs, chosen)
    single, pair = [Counter(), Counter()], [Counter(), Counter()]
    for i, w in enumerate(low):
        for m in (1, 0) if i % 3 == 0 else (1,):
            single[m].update(("<s>", *w)), pair[m].update(zip(("<s>", *w), w))
    size = [sum(c.values()) for c in single]
    assert len(pair[1]) > 65536

    def loss(m, v, w):
        f = size[0] / size[1] if m else 1
        return -math.log((pair[m][v, w] * f + 16 * (single[m][w] * f + 1) / (size[0] + len(single[1]) + 1)) / (single[m][v] * f + 16))

    expected = {i: tuple(np.mean([loss(m, v, x) for v, x in zip(("<s>", *w), w)]) for m in (0, 1)) for i, w in enumerate(low)}
    for scored in (docs, docs.where("doc_id < 50")):  # the corpus itself, and other documents against it
        rows = lm_scoring.score_documents(scored, models).collect()
        assert len(rows) == (300 if scored is docs else 50)
        for r in rows:
            t, b = expected[r.doc_id]
            assert abs(r.target_loss - t) < 1e-9 and abs(r.background_loss - b) < 1e-9 and abs(r.score - (t - b)) < 1e-9


# shared


def test_word_kernel(texts):
    import pyarrow as pa

    from tripmill.llm.common import byte_column

    buf, offs = byte_column(pa.array(texts))
    starts, ends, first = textkernel.word_spans(buf, offs)
    data = buf.tobytes()
    got = [[data[a:b] for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(first[:-1], first[1:])]
    assert got == [[w.encode() for w in words(t)] for t in texts]
    hashes, _ = textkernel.word_hashes(buf, offs)
    assert len(set(hashes.tolist())) == len({w for ws in got for w in ws})


def test_all_take_an_empty_table(spark, texts):
    empty = make(spark, ["x"]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.ledger(empty).count() == 0 and quality_rules.ablation(quality_rules.ledger(empty)).count() == 0
    assert licenses.scan_licenses(empty).count() == 0 and packing.pack(empty).count() == 0
    assert quality_classifier.score_quality(empty, quality_classifier.train(empty, labels)).count() == 0


def test_repeated_and_missing_ids_and_very_long_texts(spark):
    """One row out for one in; equal texts give equal results whatever their ids; a text of a million characters is like any other."""
    rng = random.Random(17)
    long = prose(rng, 160_000)
    texts = ["token = abcdefgh12 cc by", "token = abcdefgh12 cc by", None, "x y z", "token = abcdefgh12 cc by", long, long]
    docs = make(spark, texts, ids=[4, 4, None, None, None, 8, 9])
    labels = spark.createDataFrame([(4, 1), (4, 0), (8, 1), (9, 1)], "doc_id long, quality int")
    forest = quality_classifier.train(docs, labels, trees=3)
    results = {
        "rules": quality_rules.ledger(docs).select("doc_id", "failed", "n_words"), "licenses": licenses.scan_licenses(docs).select("doc_id", "labels", "n_words"),
        "secrets": secret_scan.scan_secrets(docs).select("doc_id", "spans", "n_assign"), "quality": quality_classifier.score_quality(docs, forest).select("doc_id", "score", F.lit(0)),
    }
    for name, df in results.items():
        rows = [tuple(r) for r in df.collect()]
        assert len(rows) == 7 and sum(r[0] is None for r in rows) == 3 and sum(r[0] == 4 for r in rows) == 2, name
        assert len({r[1:] for r in rows if r[0] == 4}) == 1 and len({r[1:] for r in rows if r[0] in (8, 9)}) == 1, name
        assert sum(r[1:] == next(x[1:] for x in rows if x[0] == 4) for r in rows) >= 3, name
