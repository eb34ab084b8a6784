"""Importance resampling, main text of pages and vector codes against brute force, on odd rows and empty tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.conftest import DATA
from tests.llm.test_operators import brute_components, by_row, key, make, prose
from tripmill.llm import html_extraction, mixing, near_dedup, quality_classifier, resampling, vector_codes
from tripmill.llm.common import join_by_share
from tripmill.llm.labelled_pages import PAGES

# 9: groups whose members or texts are too many for one task


def template(rng, n, own, words_=1000):
    """n texts of a common template with words of their own in the last ``own`` words; the first and the last are alike."""
    common = [f"t{i}" for i in range(words_ - own)]
    texts = [" ".join(common + [f"o{k}.{rng.random()}" for _ in range(own)]) for k in range(n)]
    texts[-1] = texts[0] + " end"
    return texts


@pytest.mark.parametrize("options", [{"heavy": 5000}, {"block": 16}, {"heavy": 5000, "orders": 1}, {}])
def test_links_of_long_texts_in_large_groups(spark, options):
    texts = template(random.Random(1), 64, 200)
    want = brute_components(texts, list(range(64)))
    assert len({c for _, _, c, _ in want}) == 63
    assert by_row(near_dedup.near_duplicates(make(spark, texts), **options), "doc_id", "n_shingles", "component_id", "kept") == want


def test_links_among_many_rows_of_one_document(spark):
    """Rows that repeat a doc_id don't push other members of its group apart."""
    texts = template(random.Random(4), 20, 150, 400)
    ids = list(range(20)) + [7] * 300
    got = near_dedup.near_duplicates(make(spark, texts + [texts[7]] * 300, ids), block=32)
    want = sorted(r for r in brute_components(texts, list(range(20))) for _ in range(301 if r[0] == 7 else 1))
    assert by_row(got, "doc_id", "n_shingles", "component_id", "kept") == want


@pytest.mark.parametrize("members, tokens", [(450, 200), (20, 4000)])
def test_confirmer_compares_first_and_last(members, tokens):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    common = rng.integers(0, 1 << 60, tokens * 2 // 3)
    sets = [np.sort(np.r_[common, rng.integers(0, 1 << 60, tokens - len(common))]) for _ in range(members)]
    sets[-1] = np.unique(np.r_[sets[0][: tokens - 2], rng.integers(0, 1 << 60, 2)])
    rows = pa.RecordBatch.from_arrays([pa.array([5] * members), pa.array(range(members)), pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))], names=["grp", "rep", "tokens"])
    got = [tuple(r.values()) for b in near_dedup.confirmer(80, 512, 4 << 20)(iter([rows.slice(0, members // 2), rows.slice(members // 2 - 1)])) for r in b.to_pylist()]
    assert got == [(members - 1, 0)]


# 3


def test_quality_scores_end_to_end(spark):
    """The registered query against features counted by loops and trees walked one node at a time."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    forest = quality_classifier.train(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))

    def features(text):
        data = text.encode()
        w = re.findall(rb"[^\x20\x09-\x0d]+", data)
        n, k, sizes, pairs = max(1, len(data)), max(1, len(w)), [len(x) for x in w] or [0], list(zip(w, w[1:]))
        share = lambda chars, per: sum(c in chars for c in data) / per
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        known = b".,;:!|#*$%&<>\n \t\r\x0b\x0c"
        others = sum(c < 128 and c not in known and not bytes([c]).isalnum() for c in data)
        lines = data.split(b"\n")
        out = [math.log1p(len(data)), math.log1p(len(w)), sum(sizes) / k, float(np.std(sizes)), share(range(97, 123), n), share(range(65, 91), n), share(range(48, 58), n), share(range(128, 256), n)]
        out += [share(b".", k), share(b",;:", k), share(b"!", k), share(b"|", k), share(b"#*$%&<>", k), others / k, share(b"\n", k)]
        out += [len(set(w)) / len(w), max(Counter(w).values()) / len(w)] if w else [0, 0]
        out += [sum(a == b for a, b in pairs) / len(pairs), len(set(pairs)) / len(pairs)] if pairs else [0, 0]
        return [*out, 1 - len(set(lines)) / len(lines), len(again) / k, sum(65 <= x[0] <= 90 for x in w) / k]

    def score(x):
        raw = forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
            raw += leaf[node - len(feature)]
        return 1 / (1 + math.exp(-raw))

    rows = quality_classifier.op3_quality_classifier(spark, DATA).collect()
    assert len(rows) == len(texts) and len(forest.leaf) > 0
    off = [r.doc_id for r in rows if not math.isclose(r.score, score(features(texts[r.doc_id])), rel_tol=1e-9)]
    assert not off
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)


# 6


def test_mixing_rows_without_id_and_kept_names(spark):
    """Many rows without doc_id, in ranges of the order each; kept columns may have any names but those of the result."""
    rows = [(None if i % 3 else i, f"word{i} " * (1 + i % 7), f"s{i % 4}", i, f"p{i}", i * 2) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, bucket int, place string, cap int").repartition(4)
    mixed = mixing.mix_sources(docs, keep=("bucket", "place", "cap", "text")).collect()
    assert sorted((r.bucket, r.place, r.cap, r.size) for r in mixed) == sorted((i, p, c, len(t.split())) for _, t, _, i, p, c in rows)
    assert sum(r.taken for r in mixed) == sum(r.size for r in mixed) and max(r.taken / r.size for r in mixed) <= 3
    other = mixing.mix_sources(docs, buckets=7, keep=("bucket",)).collect()
    assert {r.bucket: (r.taken, r.finish) for r in other} == {r.bucket: (r.taken, r.finish) for r in mixed}
    held = mixing.shuffled(docs, 1024).groupBy("source", "bucket").count().agg({"count": "max"}).first()[0]
    assert held < 20
    with pytest.raises(ValueError):
        mixing.mix_sources(docs.withColumn("size", docs.cap), keep=("size",))


# 11


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_resample(docs, target, most=1, percent=10, least=20, buckets=10_000):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    have, want = [features(t) for _, t in docs], [features(t) for t in target]
    s, t = Counter(b for _, f in have for b in f), Counter(b for _, f in want for b in f)
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for (i, _), (n, f) in zip(docs, have):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    drawn = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return [(*r[:4], drawn.get(id(r))) for r in rows]


def resampled(spark, docs, target, **options):
    frame = make(spark, [t for _, t in docs], [i for i, _ in docs])
    aims = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    return key(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in resampling.resample(frame, aims, **options).collect())


@pytest.fixture(scope="module")
def lines():
    """Texts of shared and own lines, some very common, in words that meet across line ends."""
    rng = random.Random(3)
    common = [prose(rng, rng.randint(1, 12)) for _ in range(30)]
    texts = ["\n".join(rng.choice(common) if rng.random() < 0.6 else prose(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 12))) for _ in range(120)]
    return texts + [None, "", "\n\n \n", "one", "A\nb\n\nC d", "É\x85ü ñ", common[0], "x\n" * 5000, prose(rng, 30_000)]


@pytest.mark.parametrize("most", [1, 3])
def test_resampling(spark, lines, most):
    docs = list(enumerate(lines)) + [(None, lines[0]), (None, None)]
    target = lines[:7] + [None, "", "river stone\nstone the river"]
    for hot in (20_000, 3):  # with and without lines that count as frequent
        assert resampled(spark, docs, target, most=most, hot=hot) == key(brute_resample(docs, target, most))


def test_resampling_repeated_rows(spark, lines):
    """Rows that repeat an id take part each; equal ones get the same score and neighbouring ranks."""
    docs = [(i, t) for i, t in enumerate(lines)] + [(5, lines[5])] * 2 + [(5, lines[6])] + [(7, lines[7])] * 400
    want = brute_resample(docs, lines[:3])
    got = resampled(spark, docs, lines[:3])
    assert Counter(r[:4] for r in got) == Counter(r[:4] for r in want)
    ranks = [r[4] for r in got if r[4] is not None]
    assert sorted(ranks) == list(range(1, sum(r[4] is not None for r in want) + 1))
    placed = sorted((r for r in got if r[4]), key=lambda r: r[4])
    assert placed == sorted(placed, key=lambda r: (-r[3], r[0], r[4]))


def test_resampling_without_rows(spark):
    assert resampled(spark, [], ["a b"]) == []
    docs = [(i, prose(random.Random(i), 25)) for i in range(20)]
    assert resampled(spark, docs, []) == key(brute_resample(docs, []))


def test_join_by_share(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 50}") for i in range(900)], "id long, k string")
    known = rows.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "length(k) AS size")
    for hot in (1, 4, 40, 10_000):
        joined = join_by_share(rows, known, "k", "n", hot)
        assert {(r.id, r.k, r.size) for r in joined.collect()} == {(r.id, r.k, len(r.k)) for r in rows.collect()} and joined.count() == 900


# 12

HARBOUR = "The committee met on Tuesday to discuss the new harbour wall, which had been damaged in the autumn storms and patched twice since."
STONE = "Engineers told the council that stone from the northern quarry would last longer than concrete, though it costs nearly twice as much to bring in by rail."
WEB = [
    (
        f"""<html><body class="single has-sidebar comments-open"><header class="site-header"><h1>The Gazette</h1><nav><a href=/>Home</a></nav></header><div class="cookie-notice"><p>We use cookies to make this
        site work better for all of our readers, every day.</p></div><div id="main" class="post"><h1>Harbour wall</h1><p class="byline">By A. Smith</p><p>{HARBOUR}</p><aside><p>Other things that go on and on for quite some while.
        </p></aside><p>{STONE}</p><div class="ad-slot"><p>Buy one, get one free! Until Sunday only.</p></div><p>{HARBOUR} {STONE}</p></div><div class="sidebar"><h3>Popular</h3><p>{STONE}</p></div><div id="comments"><h2>Comments</h2>
        <div class="comment"><p>{STONE} I do not agree at all.</p></div><form><p>Leave a reply and tell us what you think.</p><textarea>x</textarea></form></div><footer><p>All rights reserved. {HARBOUR}</p></footer></body></html>""",
        f"Harbour wall\nBy A. Smith\n{HARBOUR}\n{STONE}\n{HARBOUR} {STONE}",
    ),
    (f'<article><header><h1>Title here</h1></header><p>{HARBOUR}<br>line&nbsp;two &amp; more</p><section class="comments"><article><p>{STONE}</p></article></section></article><article class="teaser"><p>{STONE}</p></article>', f"Title here\n{HARBOUR} line two & more"),
    (f"<div><div><a href=1>a</a> <a href=2>b</a></div><div><h2>Wall</h2><p>{HARBOUR}</p><ul><li>one</li><li>two</li></ul><p>{STONE}</p></div><div>(c) 2020 Acme</div></div>", f"Wall\n{HARBOUR}\none\ntwo\n{STONE}"),
    (f"<p>{HARBOUR}", HARBOUR),
    ("just words", "just words"),
    ("<div>", ""),
    ("", ""),
    (None, ""),
    (f"<article><p>{HARBOUR}</p><foot", HARBOUR),
    (f'<article><p>{HARBOUR}</p><a href="x', HARBOUR),
    (f"<main><p>a < b and c > d</p><p>{STONE}</p></main>", f"a < b and c > d\n{STONE}"),
    (f'<body><form id="f"><div><h1>T</h1><p>{HARBOUR}</p><p>{STONE}</p></div></form></body>', f"T\n{HARBOUR}\n{STONE}"),
    (f"<body><nav><ul><li>Menu</ul></nav><article><h1>x</h1><p>{HARBOUR}<ul><li>a<li>b</ul><p>q</article><footer>f</footer>", f"x\n{HARBOUR}\na\nb\nq"),
    (f'<article><p title="a > b">{HARBOUR}</p><script>if (a < b) "</p>"</script><p>&#233;&eacute;&copy <b>b</b>old&lt;i&gt;</p><!-- <p>no</p> --></article>', f"{HARBOUR}\néé© bold<i>"),
]


def test_html_extraction(spark):
    rows = [(i, f"http://x/{i}", html, "t", 7) for i, (html, _) in enumerate(WEB)] + [(None, None, WEB[3][0], "t", 7), (3, None, WEB[3][0], "t", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long").repartition(3)
    got = sorted(html_extraction.extract(pages).collect(), key=repr)
    want = [(i, f"http://x/{i}", text, len(text)) for i, (_, text) in enumerate(WEB)] + [(None, None, HARBOUR, len(HARBOUR)), (3, None, HARBOUR, len(HARBOUR))]
    assert key(map(tuple, got)) == key(want)
    assert html_extraction.extract(pages.where("false")).collect() == []


def test_weights_from_labelled_pages():
    weights = html_extraction.log_odds(html_extraction.tally(PAGES, True))
    assert weights["link True"] < 0 < weights["any word"] and weights["place out"] < 0 < weights["place in"]
    for html in PAGES:
        page = html_extraction.Page(html)
        scores = page.scored(weights)
        assert all(s < 0 for s, (name, _, _, e, _) in zip(scores, page.items) if name and not page.out[e])
        inside = re.search("<!--main-->(.*?)<!--/main-->", html, re.DOTALL)
        assert html_extraction.main_text(html, weights) == (html_extraction.Page(f"<div>{inside[1]}</div>").text(0, len(html)) if inside else "")


def test_best_region():
    rng = random.Random(5)
    for _ in range(300):
        scores = [rng.randint(-5, 5) for _ in range(rng.randint(0, 14))]
        sums = {(i, j): sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)}
        a, b = html_extraction.best_region(scores)
        assert sum(scores[a:b]) == max([*sums.values(), 0]) and (b > a) == any(s > 0 for s in scores)


@pytest.mark.parametrize(
    "piece", ["<a ", '<a b="x>', "<script>", "<div>", "<p>x", "<!--", '<a b=">" ', "<span class=a>", "</p>", "<a><div>", "&", "<ul><li>", "<td>", "<form>", "x<br>"]
)
def test_long_broken_pages_take_linear_time(piece):
    weights = html_extraction.log_odds(html_extraction.tally(PAGES, True))
    began = time.process_time()
    html_extraction.main_text(piece * 100_000, weights)
    assert time.process_time() - began < 20


# 13


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = sorted((i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows)
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(col) // len(groups[k]) for col in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    of = Counter()
    for (_, _, label), e in zip(kept, errors):
        of[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in f), e, of[label], digest) for (i, _, label), f, e in zip(kept, found, errors)]


def coded(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, label, "c", 0) for i, v, label in rows], "vec_id long, embedding array<float>, label int, code string, n int").repartition(3)
    out, books = vector_codes.compress(frame, **options)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    return sorted((r.vec_id, r.code, r.error, r.label_error, digest) for r in vector_codes.label_errors(out).collect())


@pytest.mark.parametrize("n", [1, 9, 150])
def test_vector_codes(spark, n):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(5, 16))
    rows = [(int(i) * 3, (centres[i % 5] + rng.normal(size=16) * 0.2).astype(np.float32).tolist(), [None, 1, 2][i % 3]) for i in range(n)]
    rows += [(1000 + i, rows[0][1], 2) for i in range(n // 3)]  # copies, and ties between equal first entries
    odd = [(1, None, 1), (2, [None] + rows[0][1][1:], 1), (4, [math.nan] + rows[0][1][1:], 1), (5, [math.inf] + rows[0][1][1:], 1), (7, [], 1), (8, [1.0] * 15, 1)]
    assert coded(spark, rows + odd[:6] if n > 1 else rows) == brute_codes(rows)


def test_vector_codes_large_components(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i).normal(size=8) * 9000], 1) for i in range(40)]
    assert coded(spark, [(i, [np.float32(x).item() for x in v], k) for i, v, k in rows]) == brute_codes([(i, [np.float32(x).item() for x in v], k) for i, v, k in rows])
    vast = [(i, [3e38 * (-1) ** i] * 8, 1) for i in range(4)]
    assert coded(spark, vast) == brute_codes([(i, [65536.0 * (-1) ** i] * 8, k) for i, _, k in vast])


def test_vector_codes_without_rows(spark):
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1)]) == [] and coded(spark, [(1, [1.0] * 9, 1)]) == []


def test_pivots_prune_and_change_nothing():
    rng = np.random.default_rng(1)
    centres = rng.integers(-20_000, 20_000, (16, 8))
    points = centres[rng.integers(0, 16, 3000)] + rng.integers(-500, 500, (3000, 8))
    pivots = vector_codes.spread(centres, 4)
    near = vector_codes.lengths(points, pivots).astype(np.float32).astype(float)
    which, best, tried = vector_codes.assign(points, near, centres, vector_codes.lengths(centres, pivots))
    exact = ((points[:, None] - centres) ** 2).sum(axis=2)
    assert (which == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all() and tried < 0.3 * exact.size


