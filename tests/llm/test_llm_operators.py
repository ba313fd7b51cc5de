"""The operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import chat, components, exact_dedup, jaccard_join, licenses, mixing, packing, pii, quality, shared, textscan, tokenfile, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHING = ["kept", "score", "size", "h", "n", "node", "label", "path", "words", "taken", "times", "id", "row", "key", "grp", "ids", "sketch", "text_hash", "fold", "toxic", "others", "absent", "also", "copy", "dropped", "bits", "word"]
LONG = "word " * 40_000 + "end"
ROWS = [
    (1, "one two three four five six seven", "en", "a", 1), (2, "one two three four five six seven", "en", "b", 1), (2, "one two three four five six seven", "en", "b", 1), (3, None, "en", "a", 0), (4, "", None, None, 0), (5, " \n\t ", "en", "a", 3),
    (None, "no id at all", "en", "a", 1), (None, "no id at all", "en", "a", 1), (6, LONG, "en", "c", len(LONG)), (7, "a", "en", "a", 1), (7, "other text of seven", "en", "a", 1), (8, "Éléphant straße  ñandú 😀", "fr", "b", 1),
]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *[F.lit(-5).alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 1, 1), (None, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, k=5):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_words_and_windows_agree_with_python(docs):
    texts = [r.text for r in docs.limit(60).collect()] + ["", "a", " a  b\n", "é 😀x"]
    scan = textscan.scan(pa.array(texts))
    words = textscan.words(scan)
    assert words.count.tolist() == [len(WORD.findall(t)) for t in texts]
    hashes, rows = words.shingles(5)
    for k, t in enumerate(texts):
        assert len(set(hashes[rows == k].tolist())) == len(shingles(t))
    same = {}
    for h, w in zip(words.hash.tolist(), itertools.chain.from_iterable(WORD.findall(t) for t in texts)):
        assert same.setdefault(w, h) == h
    assert len(set(same.values())) == len(same)


# ---- 1 license scans


def test_license_scan_finds_templates_and_base_phrases(spark):
    long_mit = licenses.TEMPLATES[3][1].replace(" of ", "\nof ").replace("copies", "copy")
    rows = [(1, "x Under  the-MIT license, under the mit license", ), (2, "permit license\n" + "filler " * 150 + long_mit), (3, None), (4, "Apache License, Version 2.0"), (5, "the license under released"), (6, "Released under the MIT License."), (7, "cc by nc cc by nc")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (9, 2, 1, 5, "mit")
    assert got[2].labels == "mit" and got[2].base_labels == "" and got[2].score >= 0.9
    assert (got[3].n_words, got[3].labels, got[3].score, got[3].first_word) == (0, "", 0.0, None)
    assert got[4].labels == "apache-2" and got[4].n_base == 1
    assert got[5].labels == "" and got[6].labels == "mit"
    assert (got[7].n_base, got[7].first_word, got[7].last_word) == (2, 0, 3)


def test_license_filters_lose_no_template(spark):
    every = licenses.TEMPLATES + licenses.NOTICES
    r, vocabulary = random.Random(4), sorted({w for _, t in every for w in t.split()})
    rows = []
    for k in range(80):
        label, t = r.choice(every)
        w = t.split()
        for _ in range(r.randint(0, max(1, len(w) // 8))):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((k, " ".join(w)))
    got = {x.doc_id: x for x in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [(label, set(t.split())) for label, t in every]
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    for k, text in rows:
        met = [(label, s, len(set(text.split()) & s) / len(s)) for label, s in sets if len(set(text.split()) & s) >= 0.9 * len(s)]
        want = {label for label, s, part in met if not any(near(s, t) and more > part for _, t, more in met)}
        assert want <= set(got[k].labels.split(",")), text
        assert got[k].n_base or not met or got[k].score == pytest.approx(max(part for _, _, part in met))


def test_license_blocks_hold_the_longest_template(spark):
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(["filler"] * 37 * k + words + ["filler"] * 20)) for k in range(12)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), [("own", " ".join(words))]).collect()
    assert [r.labels for r in got] == ["own"] * 12 and {r.score for r in got} == {1.0}


def test_license_scan_finds_short_notices(spark):
    notices = {"This work is licensed under the GNU General Public License, version 3.": "gpl-3", "Released under the BSD 3-Clause License.": "bsd", "Licensed under the Mozilla Public License, version 2.0.": "mpl-2", "Distributed under the ISC license.": "isc", "Licensed under the GNU General Public License, version 2.": ""}
    rows = [(k, f"some text\n{line}\nmore text") for k, line in enumerate(notices)]
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(rows))] == list(notices.values())


def test_license_scan_finds_wrapped_notices(spark):
    r, rows, want = random.Random(8), [], []
    for k in range(60):
        label, t = r.choice([x for x in licenses.TEMPLATES + licenses.NOTICES if len(set(x[1].split())) <= licenses.SHORT_WORDS])
        w = ["filler"] * r.randint(0, 40) + t.split() + ["filler"] * r.randint(0, 40)
        width = r.randint(1, 6)
        rows.append((k, "\n".join(" ".join(w[i : i + width]) for i in range(0, len(w), width))))
        want.append(label)
    rows.append((60, "This work is licensed under the Creative Commons\nAttribution-ShareAlike 4.0 International License."))
    got = {x.doc_id: x.labels.split(",") for x in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[k] for k, label in enumerate(want)) and got[60] == ["cc-by-sa"]


def test_license_scan_keeps_all_licenses_of_a_text(spark):
    of = {label: t for label, t in licenses.TEMPLATES if len(set(t.split())) > licenses.SHORT_WORDS}
    cc = {label: t for label, t in licenses.TEMPLATES if "creative" in t}
    rows = [(1, of["gpl-3"] + "\n" + of["mpl-2"]), (2, of["mit"] + "\n" + of["apache-2"]), (3, cc["cc-by-sa"]), (4, cc["cc-by-nc"]), (5, "released under the mit license or under the isc license")]
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "gpl-3,mpl-2", 2: "apache-2,mit", 3: "cc-by-sa", 4: "cc-by-nc", 5: "isc,mit"}


# ---- 2 mixing


def test_targets_share_all_words_and_stop_at_three_times():
    got = mixing.targets([("a", 100), ("b", 10), (None, 1000)])
    assert sum(got.values()) == pytest.approx(1110) and got["b"] == 30 and got["a"] == pytest.approx(1080 / 4) and got[None] == pytest.approx(1080 * 3 / 4)
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


def test_knapsack_is_as_near_as_brute_force():
    r = np.random.default_rng(1)
    for _ in range(60):
        lengths = np.unique(r.integers(1, 30, 4))
        counts = r.integers(1, 4, len(lengths))
        budget = int(r.integers(0, (lengths * counts).sum() + 1))
        take = mixing.fit(lengths, counts, budget)
        assert ((take >= 0) & (take <= counts)).all()
        sums = {int((np.array(c) * lengths).sum()) for c in itertools.product(*[range(n + 1) for n in counts])}
        assert abs(int((take * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)
        far = mixing.fit(lengths, counts * 1000, budget * 1000, 500)
        assert (far <= counts * 1000).all() and abs(int((far * lengths).sum()) - budget * 1000) <= lengths.max()


@pytest.mark.parametrize("span", [40, 400, 1 << 15])
def test_fit_on_both_sides_of_the_span(span):
    """Up to span words the fit is the best there is, whatever the lengths; beyond, it is off by less than the longest document."""
    r = np.random.default_rng(span)
    for _ in range(20):
        lengths, counts = np.unique(r.integers(1, 90, 9)), None
        counts = r.integers(1, 6, len(lengths))
        total = int((lengths * counts).sum())
        sums = np.zeros(total + 1, bool)
        sums[0] = True
        for length, n in zip(lengths.tolist(), counts.tolist()):
            for _ in range(n):
                sums[length:] |= sums[:-length].copy()
        for budget in r.integers(0, total + 1, 8).tolist():
            off = abs(int((mixing.fit(lengths, counts, budget, span) * lengths).sum()) - budget)
            best = int(np.abs(np.flatnonzero(sums) - budget).min())
            assert off == best if budget <= span else off <= lengths.max()


def test_fit_with_a_very_long_text_is_small():
    lengths, counts = np.append(np.arange(2, 3002, 2), 5_000_001), np.ones(1501, np.int64)
    tracemalloc.start()
    take = mixing.fit(lengths, counts, 20_001)
    assert abs(int((take * lengths).sum()) - 20_001) == 1 and tracemalloc.get_traced_memory()[1] < 50 << 20
    tracemalloc.stop()
    assert mixing.fit(np.array([5_000_001]), np.array([1]), 2_000_000).tolist() == [0] and mixing.fit(np.array([0, 5]), np.array([3, 1]), 5).tolist()[1] == 1


def test_mix_meets_targets_on_whole_table(docs):
    rows = mixing.mix(docs).toPandas()
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    assert (rows["size"] == rows["doc_id"].map(size)).all() and (rows["taken"] <= 3 * rows["size"]).all() and (rows["taken"] % rows["size"].clip(lower=1) == 0).all()
    by = rows.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), least=("size", "min"))
    assert (abs(by["taken"] - by["target"]) <= by["least"] + 1).all()
    again = mixing.mix(docs.repartition(3)).toPandas()
    assert rows.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()


def test_mix_ranks_long_lists_by_ranges(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("w " * 7).alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    got = mixing.mix(rows).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 7 for r in got)


# ---- 3 toxicity


def test_toxicity_on_held_out_rows(spark, docs):
    # A ratio is a mean over the text, so one insult weighs by the text's length: there is one for every 40 words.
    rows, r = docs.where(F.length("text") > 200).select("doc_id", "text").collect(), random.Random(2)
    said = lambda words: " ".join(w + (" " + r.choice(("blockhead", "nitwit", "numpty")) if k % 40 == 7 else "") for k, w in enumerate(words))
    made = [(i, said(x.text.split()) if i % 4 == 0 else x.text, int(i % 4 == 0)) for i, x in enumerate(rows)]
    table, marks = spark.createDataFrame([m[:2] for m in made], "doc_id long, text string"), spark.createDataFrame([(m[0], m[2]) for m in made], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(table, marks).collect()}
    held = [m for m in made if zlib.crc32(str(m[0]).encode()) % 5 == 0]
    assert np.mean([got[m[0]].predicted == m[2] for m in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def brute_model(texts, word_discount, pair_discount, ratio=toxicity.RATIO):
    """P(w | v) of both classes by plain counting; texts are (words, class). The word None stands for all that no text has."""
    places = [(v, w, c) for words, c in texts for v, w in zip(["<"] + words, words + [">"])]
    pair = {c: Counter((v, w) for v, w, k in places if k == c) for c in "to"}
    plain = {c: Counter(w for _, w, k in places if k == c) for c in "to"}
    for c in "to":
        plain[c]["<"] = plain[c][">"]
    after = {c: Counter(w for _, w in pair[c]) for c in "to"}
    after_any = Counter(w for _, w in set(pair["t"]) | set(pair["o"]))
    size, all_ = {c: sum(after[c].values()) for c in "to"}, sum(after_any.values())

    def own(x, c, d, of, d_of, discount):
        times = of / d_of if d_of else 0
        left = x[c] - discount * max(times, 1)
        return left if left > 0 and left > ratio * x[d] * times else 0.0

    kept = {c: {w: own({k: after[k][w] for k in "to"}, c, d, size[c], size[d], word_discount) for w in after_any} for c, d in ("to", "ot")}
    free = {c: 1 - sum(kept[c].values()) / size[c] for c in "to"}

    def alone(c, w):
        return kept[c].get(w, 0) / size[c] + free[c] * ((after_any[w] - 0.75) / all_ if w in after_any else 0.75 * len(after_any) / all_)

    both = {c: {x: own({k: pair[k][x] for k in "to"}, c, d, plain[c][x[0]], plain[d][x[0]], pair_discount) for x in set(pair["t"]) | set(pair["o"])} for c, d in ("to", "ot")}

    def p(c, v, w):
        of_v = {x: both["t"][x] + both["o"][x] for x in both["t"] if x[0] == v and both["t"][x] + both["o"][x] > 0}
        if not of_v:
            return alone(c, w)
        left = 1 - sum(of_v.values()) / (plain["t"][v] + plain["o"][v])
        mine = sum(both[c][x] for x in of_v)
        q = (both[c][v, w] + pair_discount * of_v[v, w] / sum(of_v.values())) / (mine + pair_discount) if (v, w) in of_v else 0
        return (1 - left) * q + left * alone(c, w)

    return p, list(after_any)


def test_toxicity_ratios_agree_with_plain_counting(spark):
    r = random.Random(6)
    texts = []
    for k in range(160):
        words = [r.choice(["a", "b", "c", "d", f"r{r.randrange(50)}"]) for _ in range(r.randint(0, 12))]
        texts.append((words + (["you", "bad", "one"] if k % 3 == 0 else ["be", "well"]) * r.randint(0, 2), "t" if k % 3 == 0 else "o"))
    table = spark.createDataFrame([(k, " ".join(w)) for k, (w, _) in enumerate(texts)], "doc_id long, text string")
    known = spark.createDataFrame([(k, int(c == "t")) for k, (_, c) in enumerate(texts)], "doc_id long, toxic int")
    for discounts in ((1.5, 2.0), (3.0, 6.0)):
        model = toxicity.combine(toxicity.count(table, known, *discounts))
        p, vocabulary = brute_model([x for x in texts if x[0]], *discounts)
        for c in "to":
            for v in ("<", "a", "you", "bad", "be", "r1"):
                assert sum(p(c, v, w) for w in [*vocabulary, None]) == pytest.approx(1)
        tried = [w for w, _ in texts] + [["never", "seen", "you", "bad"], ["you"], []]
        got = toxicity.ratios(pa.array([" ".join(w) for w in tried]), model)
        for w, x in zip(tried, got):
            want = sum(math.log(p("t", a, b if b in vocabulary else None) / p("o", a, b if b in vocabulary else None)) for a, b in zip(["<"] + w, w + [">"])) / (len(w) + 1) if w else 0
            assert x == pytest.approx(want), w
        assert len(model.pairs.keys) > 2


def test_toxicity_models_are_bounded(spark, monkeypatch):
    """With more expressions than MODEL_ROWS, discounts are doubled until they fit."""
    table = spark.createDataFrame([(i, " ".join(f"{'t' if i % 2 else 'o'}{k} x{i % 50}" for k in range(i % 40))) for i in range(600)], "doc_id long, text string")
    known = table.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    whole = toxicity.count(table, known)
    monkeypatch.setattr(toxicity, "MODEL_ROWS", 10)
    few = toxicity.count(table, known)
    assert few.word_discount > whole.word_discount == toxicity.WORD_DISCOUNT and few.pair_discount / few.word_discount == whole.pair_discount / whole.word_discount
    model = toxicity.combine(few)
    assert (model.words.values != model.words.other).sum() <= 10 + 2 * len(model.pairs.keys) < (toxicity.combine(whole).words.values != model.words.other).sum()


def test_toxicity_keeps_all_expressions_whatever_the_bound(spark, monkeypatch):
    """With more expressions than MODEL_ROWS, ratios come from files of at most that many, and scores stay the same."""
    r = random.Random(8)
    said = lambda c: " ".join(r.choice([f"{c}{r.randrange(30)}", f"{c} bad", f"x{r.randrange(60)}", "a b"]) for _ in range(r.randint(0, 60)))
    texts = [said("t" if i % 3 == 0 else "o") for i in range(1500)]
    table = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(len(texts))], "doc_id long, toxic int")
    score = lambda: {x.doc_id: x.score for x in toxicity.toxicity(table, marks).collect()}
    whole, want = toxicity.combine(toxicity.count(table, marks)), score()
    monkeypatch.setattr(toxicity, "MODEL_ROWS", 7)
    got = score()
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert len(whole.pairs.keys) > 7 and len(set(want.values())) > 500

    model = toxicity.filed(*toxicity.expressions(table, marks))
    assert toxicity.ratios(pa.array(texts), model) == pytest.approx(toxicity.ratios(pa.array(texts), whole), abs=1e-12)
    assert len(model.words.files) > 3 and len(model.pairs.files) > 1
    keys = np.append(whole.pairs.keys, np.uint64(5))
    assert model.pairs[keys] == pytest.approx(whole.pairs[keys], abs=1e-12, nan_ok=True)
    for part in model.words.files + model.pairs.files:
        fs, name = shared.file_system(part)
        assert 0 < fs.get_file_info(name).size <= 7 * 16


def test_toxicity_ratio_is_normalised_by_length(spark):
    model = toxicity.Model(toxicity.Table(np.zeros(0, np.uint64), np.zeros(0), -0.5), toxicity.Table(np.zeros(0, np.uint64), np.zeros(0), np.nan), toxicity.Curve())
    assert toxicity.ratios(pa.array(["a b", "a " * 1000, "", None, " . "]), model).tolist() == pytest.approx([-0.5, -0.5, 0, 0, 0])
    assert toxicity.score(pa.array([""]), model).tolist() == [0.5]


def test_toxicity_curve_rises_and_a_falling_one_is_level():
    x, y = np.array([0.1, 0.2, 0.3, 0.4, -50, 60]), np.array([0, 0, 1, 1, 1, 0])
    curve = toxicity.fit_curve(x, y, np.array([10, 10, 10, 10, 1, 1]))
    assert (np.diff(curve(np.linspace(-3, 3, 50))) > 0).all() and curve(0.2) < 0.5 < curve(0.3)
    assert len(set(toxicity.fit_curve(x[:4], 1 - y[:4], np.ones(4))(x).tolist())) == 1


def test_toxicity_edge_values(spark, edge, none):
    some = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (6, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity(edge, some).collect()
    assert {r.score for r in rows if r.doc_id in (3, 4, 5)} == {next(r.score for r in rows if r.doc_id == 3)} and len({r.score for r in rows if r.doc_id == 2}) == 1
    alone = toxicity.toxicity(edge, some.where("toxic = 0 and doc_id = 6")).collect()
    assert all(r.score < 1e-6 and r.predicted == 0 for r in alone)
    assert all(r.score == 0.5 for r in toxicity.toxicity(edge, some.limit(0)).collect()) or all(r.score < 0.51 for r in toxicity.toxicity(edge, some.limit(0)).collect())


# ---- 4 quality


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {i + d for i, w in enumerate(windows) if w in twice for d in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_measures_agree_with_brute_force(docs, labels, sf, spark):
    rows = {r.doc_id: r for r in quality.quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    for r in docs.collect():
        q = rows[r.doc_id]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == brute_quality(r.text)
        assert q.base_failed == (q.n_words < 20 or 100 * q.n_repeat_words > 30 * q.n_words)
        assert not (q.kept and q.base_failed) and q.kept == (not q.base_failed and q.score >= quality.THRESHOLD)


def test_quality_score_is_the_mean_ratio_of_hashed_ngrams(docs, sf, spark):
    marks = spark.read.parquet(f"{sf}/labels.parquet")
    trusted = {r.doc_id for r in marks.where("quality = 1").collect()}
    rows = docs.collect()
    grams, table = {}, {}
    for r in rows:
        runs = re.findall(r"[A-Za-z0-9_\x80-\U0010FFFF]+|[^\s\x00-\x1fA-Za-z0-9_\x80-\U0010FFFF]+", r.text)
        pairs = ["same" if a == b else (a, b) for a, b in zip(runs, runs[1:])]
        grams[r.doc_id] = runs + pairs
        scan = textscan.scan(pa.array([r.text]))
        bucket, _ = quality._buckets(scan)
        for g, b in zip(grams[r.doc_id], bucket.tolist()):
            assert table.setdefault(g, b) == b
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for doc, found in grams.items():
        for g in found:
            raw[table[g]] += 1
            target[table[g]] += doc in trusted
    w = quality.log_ratios(raw, target)
    got = {r.doc_id: r.score for r in quality.quality(docs, marks).select("doc_id", "score").collect()}
    assert all(got[d] == pytest.approx(np.mean([w[table[g]] for g in f]) if f else 0) for d, f in grams.items())


def test_quality_counts_all_trusted_rows(spark):
    table = spark.range(21_000).selectExpr("id as doc_id", "concat('w', id % 4000, ' and w', id div 6) as text")
    marks = table.selectExpr("doc_id", "1 as quality")
    raw = np.bincount(quality._buckets(textscan.scan(pa.array([r.text for r in table.select("text").collect()])))[0], minlength=quality.BUCKETS).astype(float)
    assert np.allclose(quality.fit(table, marks), quality.log_ratios(raw, raw))


# ---- 5 near-duplicates


def brute_classes(rows, least=0.8):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    label = {}
    for k, (i, _) in enumerate(rows):
        label[find(k)] = min(label.get(find(k), i), i)
    return {i: (label[find(k)], links[k]) for k, (i, _) in enumerate(rows)}


def near_copies(r, n, words=120, edits=3):
    base = [f"w{r.randrange(10_000)}" for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for _ in range(r.randint(0, edits)):
            copy[r.randrange(words)] = f"x{r.randrange(10_000)}"
        yield " ".join(copy)


def test_near_classes_agree_with_brute_force(spark):
    r = random.Random(3)
    texts = [t for n in (40, 9, 3, 2, 1, 1) for t in near_copies(r, n)] + ["a b", "a b", "a b c"]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    got = {x.doc_id: (x.class_id, x.n_links) for x in jaccard_join.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_splitting_and_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAF", 8)
    monkeypatch.setattr(jaccard_join, "DEPTH", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    r = random.Random(5)
    rows = list(enumerate([t for n in (60, 12, 2) for t in near_copies(r, n)]))
    got = {x.doc_id: (x.class_id, x.n_links) for x in jaccard_join.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_one_of_each_removes_rows_not_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, 1), (7, text + " more", 2), (7, "a text of its own that has no copy", 3), (None, text + " less", 4), (1, text + " other", 5), (1, text, 6), (None, "x y z a b c", 7), (None, "x y z a b c", 8)]
    got = sorted((r.doc_id or 0, r.text) for r in jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect())
    assert len(got) == 3 and got[0] == (0, "x y z a b c") and got[1][0] == 1 and got[1][1].startswith(text) and got[2] == (7, rows[2][1])


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)}


def test_runs_grow_with_recall_and_depth():
    finds = [jaccard_join.run_finds(0.8, k) for k in (1, 4, 7)]
    assert finds[0] == pytest.approx(0.84) and finds[0] > finds[1] > finds[2] > 0.4
    assert jaccard_join.runs_for(0.5, 0.4) < jaccard_join.runs_for(0.99, 0.4) < jaccard_join.runs_for(0.9999, 0.4)
    r, lives = np.random.default_rng(1), 0
    for _ in range(4000):  # a pair at the threshold, down a tree of seven splits
        at = 1
        for _ in range(7):
            at = sum(r.random() < 0.8 for _ in range(at + r.binomial(at, 0.25)))
        lives += at > 0
    assert lives / 4000 == pytest.approx(finds[2], abs=0.03)


@pytest.mark.parametrize("depth", [0, 2, 4, 6])
def test_recall_at_each_depth(spark, monkeypatch, depth):
    """Pairs of similarity 0.8, in buckets that are never small enough, meet in a run as often as the depth says."""
    monkeypatch.setattr(jaccard_join, "DEPTH", depth)
    monkeypatch.setattr(jaccard_join, "LEAF", 1)
    r, runs, pairs = np.random.default_rng(depth), 4, 600
    # Nodes 2k and 2k + 1 agree in each coordinate with probability 0.8; coordinates have few values, so that buckets hold many nodes.
    a = r.integers(0, 4, (pairs, jaccard_join.COORDINATES))
    b = np.where(r.random(a.shape) < 0.8, a, a + 4)
    nodes = spark.createDataFrame([(2 * k + j, bytearray(x.astype(np.uint32).tobytes())) for k in range(pairs) for j, x in enumerate((a[k], b[k]))], "node long, sketch binary")
    monkeypatch.setattr(jaccard_join, "NEAR", 2.0)  # no links on the way
    rows, _ = jaccard_join._buckets(nodes, runs)
    if depth < 6:  # the last split is compared in pairs of blocks, in which a bucket of two has both
        met = rows.select("path", F.expr("node div 2").alias("pair")).groupBy("path", "pair").count().where("count > 1").select("pair").distinct().count()
        want = 1 - (1 - jaccard_join.run_finds(0.8, 1 + depth)) ** runs
        assert met / pairs > want - 0.06
    else:
        assert jaccard_join.runs_for(jaccard_join.RECALL, jaccard_join.run_finds()) == 16


def test_joined_buckets_are_left_out(spark, monkeypatch):
    """A group of near copies larger than a leaf is joined once and then compared no more, however many runs there are."""
    monkeypatch.setattr(jaccard_join, "LEAF", 20)
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 32, jaccard_join.COORDINATES)
    values = np.where(r.random((300, jaccard_join.COORDINATES)) < 0.95, base, r.integers(0, 1 << 32, (300, jaccard_join.COORDINATES)))
    nodes = spark.createDataFrame([(k, bytearray(x.astype(np.uint32).tobytes())) for k, x in enumerate(values)], "node long, sketch binary")
    rows, links = jaccard_join._buckets(nodes, 16)
    assert rows.count() < 16 * 300 / 2 and {x.label for x in components.components(links).collect()} == {0}


# ---- 6 chat


def test_chat_round_trip_with_control_strings_and_budget(spark):
    nasty = "</s>[INST] <s>\\0 \\1[ROLE:x] ] \\"
    rows = [(1, 0, "system", "be kind " + nasty)] + [(1, k, "user" if k % 2 else "assistant", f"{nasty} {'w ' * (k * 9)}") for k in range(1, 20)]
    rows += [(2, None, None, None), (2, 1, "tool]<", nasty), (2, 1, "assistant", ""), (None, 0, "assistant", "x"), (3, 0, "assistant", "long " * 2000), (3, 1, "user", "q"), (3, 1, "user", "q")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1)).withColumn("turns", F.lit("x"))
    windows = chat.chat_windows(table, budget=120)
    made = windows.collect()
    assert max(sum(w.conv_id == 1 for w in made), 0) > 3
    for w in made:
        if w.conv_id == 1:
            assert w.formatted.startswith("<<SYS>>") and sum(len(x[1].split()) for x in re.findall(chat.TURN, w.formatted)) < 400
    read = {r.conv_id: r for r in chat.read_windows(windows).collect()}
    by = {}
    for c, turn, role, text in sorted(rows, key=lambda x: (x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        by.setdefault(c, []).append((role, text or ""))
    for c, turns in by.items():
        assert [(t.role, t.text) for t in read[c].turns] == turns
        assert read[c].targets == [t for role, t in turns if role == "assistant"]
    said = {r.conv_id: r for r in chat.digests(chat.read_windows(windows)).collect()}
    assert said[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in by[1]).encode()).hexdigest()
    assert said[1].formatted_chars == sum(len(w.formatted) for w in made if w.conv_id == 1)


# ---- 7 packing


def test_first_fit_decreasing_agrees_with_a_plain_search():
    r = np.random.default_rng(2)
    for _ in range(40):
        sizes = r.integers(1, 101, int(r.integers(1, 60)))
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        room, want = [], {}
        for k in np.argsort(-sizes, kind="stable"):
            at = next((b for b, free in enumerate(room) if free >= sizes[k]), len(room))
            if at == len(room):
                room.append(100)
            want[k] = (at, 100 - room[at])
            room[at] -= sizes[k]
        assert {k: (int(bins[k]), int(offsets[k])) for k in want} == want


def check_pieces(rows, capacity=4096):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length and 0 < r.length <= capacity
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return by_doc, by_seq


def test_pieces_hold_every_id_once(docs):
    rows = packing.pack(docs).collect()
    by_doc, by_seq = check_pieces(rows)
    library = Tokenizer.from_file(tokens.VOCABULARY)
    for r in docs.collect():
        want = library.encode(r.text, add_special_tokens=False).ids + [2]
        parts = sorted(by_doc[(r.doc_id, len(want))], key=lambda p: p.start)
        assert np.frombuffer(b"".join(p.ids for p in parts), "<u4").tolist() == want
    assert sum(r.length for r in rows) / (4096 * len(by_seq)) > 0.97


def encode_all(e, texts):
    ids, starts = e.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(starts, starts[1:])]


def test_encoder_agrees_with_the_library_on_any_text():
    r, e = random.Random(1), tokens.Encoder(end=None)
    parts = ["a", "B", "é", "É", "ß", "'s", "'S", "'ll", "3", "12", "<|endoftext|>", " ", "\x1c", "́", "é", "İ", "Σ", "ς", "中文", "😀", "_", "-", "'", "|", "<", ">", "&", "\n", "\t", " ", "ﬁ", "ǅ", "½", "×", "\x00", "~", "~~", "÷", "Þ", "\xa0", "\u3000"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 20))) for _ in range(4000)]
    for lo in range(0, len(texts), 500):
        part = texts[lo : lo + 500]
        assert encode_all(e, part) == [e.tokenizer.encode(x, add_special_tokens=False).ids for x in part]


def test_encoder_gives_each_text_its_end():
    assert encode_all(tokens.Encoder(), [None, "", " a", "\n", "a b "]) == [[2], [2], [320, 2], [2], [320, 321, 2]]
    assert encode_all(tokens.Encoder(), []) == []


def test_encoder_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_BYTES", 500)
    e = tokens.Encoder(end=None)
    texts = [f"alpha{k} beta gamma{k}. delta ~{k}" for k in range(50)]
    for x in texts + texts:
        assert encode_all(e, [x, "beta delta."]) == [e.tokenizer.encode(y, add_special_tokens=False).ids for y in (x, "beta delta.")]
    assert e.runs.nbytes() < 5000 and e.words.nbytes() < 5000


def test_strings_with_equal_hashes_are_told_apart():
    known, s = tokens.Known([2]), tokens.Strings(pa.array(["ab", "cd", "ef", "xyz"]))
    s.hashes[:] = 7
    assert known.add(s, np.array([0]), np.array([5, 6], np.uint32), np.array([2])).tolist() == [1]
    assert known.find(s).tolist() == [1, -1, -1, -1]


def test_packing_cuts_large_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BYTES", 4_000)
    table = spark.range(600).select(F.lit(1).cast("long").alias("doc_id"), F.lit("the same text of a row " * 9).alias("text"))
    rows = packing.pack(table, capacity=512).collect()
    assert sum(r.length for r in rows) == 600 * rows[0].doc_tokens
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert at.get(r.sequence_id, 0) == r.offset
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 512 and sum(at.values()) / 512 / len(at) > 0.7


def test_packing_spreads_equal_rows(spark):
    table = spark.range(6000, numPartitions=16).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    groups = {r.sequence_id >> 32 for r in packing.pack(table).select("sequence_id").collect()}
    assert len(groups) > 1


# ---- 8 exact copies


def test_grace_spills_and_agrees_with_brute_force(spark):
    r = random.Random(2)
    rows = [(k, f"text {r.randrange(300)} " * 50) for k in range(2000)]
    got = {x.doc_id: x for x in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), most=20_000).collect()}
    by = {}
    for k, t in rows:
        by.setdefault(t, []).append(k)
    for k, t in rows:
        assert (got[k].keep_id, got[k].group_size, got[k].kept, got[k].text_sha256) == (max(by[t]), len(by[t]), k == max(by[t]), hashlib.sha256(t.encode()).hexdigest())


def test_table_compares_content_not_only_hashes(tmp_path):
    table = exact_dedup.ContentTable()
    for text in (b"a", b"b", b"a"):
        table.merge(5, text, (1,), 1)  # one hash for all
    assert sorted((e[1], e[3]) for e in table.entries) == [(b"a", 2), (b"b", 1)]
    schema = pa.schema([("h", pa.int64()), ("text", pa.string()), ("n", pa.int64()), ("doc_id", pa.int64())])
    batch = pa.RecordBatch.from_arrays([pa.array([7] * 30), pa.array([f"{k % 10} " * 40 for k in range(30)]), pa.array([1] * 30), pa.array(range(30))], schema=schema)
    rows = [r for b in exact_dedup.grace(iter([batch]), f"file://{tmp_path}/spill", most=200) for r in b.to_pylist()]
    assert sorted(r["n"] for r in rows) == [3] * 10 and {r["doc_id"] for r in rows} == set(range(20, 30))
    assert not list(tmp_path.iterdir())


# ---- 9 personal data


@pytest.mark.parametrize("text", ["ana.b@x.example.com, 1.2.3.4 and 1.2.3.4.5 999.1.1.1 +1 (499) 555-6503", "a@b@c.de @x.y x@y ..@-.-", "4111 1111 1111 1111 4111-1111-1111-1112 12 34", "+49 30 1234 5678+1 2 3", "", "aaa@bbb.cc@dd.ee", "0001.2.3.4 1.2.3.04", "+1 +2222222222"])
def test_base_rules_agree_with_plain_patterns(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(kind, s):
        digits = re.sub("[^0-9]", "", s)
        luhn = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in s.split(".")), "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]

    want = [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, text) if ok(k, m[0])]
    assert pii.base_spans(text) == want


def test_tagger_gradients():
    t = pii.Tagger(3)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    data = pii.examples(3, 1)
    x, y = np.stack([pii.codes(a) for a, _ in data]), np.stack([pii.tags(s, pii.WINDOW) for _, s in data])
    _, grads = t.gradients(x, y)
    for k, at in (("left", (3, 5)), ("right", (10, 40)), ("out", (4, 3)), ("embed", (33, 2)), ("moves", (1, 2))):
        t.p[k][at] += 1e-4
        up, _ = t.gradients(x, y)
        t.p[k][at] -= 2e-4
        down, _ = t.gradients(x, y)
        t.p[k][at] += 1e-4
        assert (up - down) / 2e-4 == pytest.approx(grads[k][at], rel=1e-4, abs=1e-6)


@pytest.fixture(scope="module")
def tagger():
    return pii.trained()


def test_tagger_on_unseen_examples_of_each_kind(tagger):
    data = pii.examples(150, 99, 600)
    count = Counter()
    inner = lambda spans: {s for s in spans if s[1] > 0 and s[2] < 600}
    for (_, gold), got in zip(data, pii.model_spans([t for t, _ in data], tagger)):
        for what, spans in (("want", inner(gold)), ("found", inner(got)), ("right", inner(gold) & inner(got))):
            count.update((what, kind) for kind, _, _ in spans)
    for kind in pii.KINDS:
        assert count["want", kind] > 300 and count["right", kind] >= 0.9 * count["want", kind] and count["right", kind] >= 0.9 * count["found", kind], (kind, count)


@pytest.mark.parametrize("s,kind", [("415.555.0132", "phone"), ("415-555-0132", "phone"), ("020 7946 0958", "phone"), ("(499) 555-6503", "phone"), ("3782 822463 10005", "card"), ("fe80::1ff:fe23:4567:890a", "ip"), ("josé@correo.es", "email"), ("123-45-6789", None), ("2020-10-12", None), ("10:30", None), ("3.0", None)])
def test_tagger_in_a_long_text(tagger, s, kind):
    """Wherever windows begin, a span is found whole, and as often as it stands."""
    for before in range(0, 64, 7):
        text = "x" * before + " plain words " * 20 + f"ask {s} now " + "more words " * 30 + f"and {s} too"
        want = [(kind, m.start(), m.end()) for m in re.finditer(re.escape(s), text)] if kind else []
        assert pii.model_spans([text, "none", text], tagger) == [want, [], want]


def test_viterbi_agrees_with_all_paths():
    r = np.random.default_rng(4)
    moves = r.standard_normal((pii.TAGS, pii.TAGS)).astype(np.float32)
    chains = [r.standard_normal((n, pii.TAGS)).astype(np.float32) for n in (1, 4, 3, 2, 4, 1)]
    value = lambda c, path: sum(c[t, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))
    for chain, got in zip(chains, pii.viterbi(chains, moves)):
        assert got.tolist() == list(max(itertools.product(range(pii.TAGS), repeat=len(chain)), key=lambda p: value(chain, p)))


def test_viterbi_in_parts_agrees(monkeypatch):
    r = np.random.default_rng(5)
    moves = r.standard_normal((pii.TAGS, pii.TAGS)).astype(np.float32)
    chains = [r.standard_normal((n, pii.TAGS)).astype(np.float32) for n in r.integers(1, 90, 40).tolist()]
    whole = pii.viterbi(chains, moves)
    monkeypatch.setattr(pii, "CHAIN_CELLS", 100)
    assert all((a == b).all() for a, b in zip(whole, pii.viterbi(chains, moves)))


def test_path_likelihoods_sum_over_all_paths():
    t = pii.Tagger(3)
    x = pii.codes("a1@b")[None]
    s, moves = t.scores(x)[:, 0], t.moves()
    paths = list(itertools.product(range(pii.TAGS), repeat=4))
    value = np.array([sum(s[k, p[k]] for k in range(4)) + sum(moves[a, b] for a, b in zip(p, p[1:])) for p in paths], np.float64)
    y = paths[700]
    loss, _ = t.gradients(x, np.array([y]))
    assert loss == pytest.approx(np.log(np.exp(value).sum()) - value[700], rel=1e-4)


def test_chain_scores_join_windows(tagger):
    text = "7" * 300
    ((begin, scores),) = pii.chain_scores(text, tagger)
    assert begin == 0 and scores.shape == (300, pii.TAGS)
    padded = np.concatenate([np.zeros(32, np.int64), pii.codes(text), np.zeros(64, np.int64)])
    one, two = (tagger.scores(padded[None, k : k + 64])[:, 0] for k in (96, 128))  # characters 64 to 127 and 96 to 159
    near, far = np.arange(32, 0, -1)[:, None] / 33, np.arange(1, 33)[:, None] / 33
    assert np.allclose(scores[96:128], one[32:] * near + two[:32] * far, atol=1e-4)
    assert list(pii.chain_scores("no digits", tagger)) == [] and list(pii.chain_scores("", tagger)) == []


def test_model_spans_yield_to_base_spans():
    base = [("phone", 10, 20), ("email", 30, 40)]
    assert pii.merged(base, [("ip", 5, 10), ("card", 5, 11), ("phone", 12, 15), ("ip", 20, 30), ("ip", 39, 50), ("ip", 41, 50)]) == [("email", 30, 40), ("ip", 5, 10), ("ip", 20, 30), ("ip", 41, 50), ("phone", 10, 20)]


def test_base_spans_stay(spark, tagger):
    rows = [(1, "mail ana@example.com or 10.0.0.1 " + "x " * 200 + "+1 (499) 555-6503"), (2, None), (3, "no data"), (4, "Ring (499) 555-6503 today.")]
    got = {r.doc_id: r for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string"), tagger).collect()}
    base = pii.base_spans(rows[0][1])
    assert set(pii.listed(base).split(",")) <= set(got[1].spans.split(",")) and (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 0, 1)
    assert got[1].base_sha256 == hashlib.sha256(pii.listed(base).encode()).hexdigest() and got[2].spans == "" and got[3].spans == ""
    assert got[4].spans == "phone:5:19" and [got[k].n_spans for k in (1, 2, 3, 4)] == [3, 0, 0, 1]


def test_personal_data_edge_values(spark, edge, tagger):
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r.spans == "" and r.base_sha256 == empty and r.n_spans == r.n_email == r.n_ip == r.n_card == r.n_phone == 0 for r in pii.find_spans(edge, tagger).collect())
    ends = "10.0.0.1" + " word" * 30_000 + " a@b.cc"
    (row,) = pii.find_spans(spark.createDataFrame([(1, ends)], "doc_id long, text string"), tagger).collect()
    assert row.spans == f"email:{len(ends) - 6}:{len(ends)},ip:0:8"


# ---- 10 token files


def test_token_files_round_trip_and_random_access(docs):
    manifest = tokenfile.write_tokens(docs)
    rows = sorted(tokenfile.read_tokens(manifest).collect(), key=lambda r: r.doc_id)
    library, at = Tokenizer.from_file(tokens.VOCABULARY), 0
    for r, d in zip(rows, docs.orderBy("doc_id").collect()):
        want = library.encode(d.text, add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start) == (d.doc_id, at) and np.frombuffer(r.ids, "<u4").tolist() == want
        at += len(want)
    fs, name = shared.file_system(manifest.first().file)
    with fs.open_input_file(name) as f:
        reader = tokenfile.Reader(f)
        doc = int(reader.index["doc"][3])
        (place,) = reader.find(doc)
        ((_, ids),) = reader.documents([place])
        assert ids.tolist() == np.frombuffer(next(r.ids for r in rows if r.doc_id == doc), "<u4").tolist()


def test_token_files_part_equal_rows(spark):
    table = spark.range(4000, numPartitions=16).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    manifest = tokenfile.write_tokens(table)
    assert manifest.count() > 1 and manifest.agg(F.max("docs")).first()[0] < 4000
    assert sorted(r.start for r in tokenfile.read_tokens(manifest).collect()) == list(range(0, 8000, 2))


def test_damaged_frame_is_noticed(tmp_path):
    path = tmp_path / "x"
    with open(path, "wb") as f:
        w = tokenfile.Writer(f, 2)
        w.add(1, np.arange(100, dtype="<u4"))
        w.close()
    raw = bytearray(path.read_bytes())
    raw[-13] ^= 1  # the checksum in the seek table
    path.write_bytes(raw)
    with pa.OSFile(str(path)) as f, pytest.raises(ValueError):
        list(tokenfile.Reader(f).documents())


# ---- edge cases of all


OPERATORS = {
    "licenses": lambda d, m: licenses.scan_licenses(d), "mix": lambda d, m: mixing.mix(d), "toxicity": toxicity.toxicity, "quality": quality.quality, "near": lambda d, m: jaccard_join.near_classes(d),
    "exact": lambda d, m: exact_dedup.exact_groups(d), "tokens": lambda d, m: tokenfile.read_tokens(tokenfile.write_tokens(d)), "pii": lambda d, m: pii.find_spans(d, pii.Tagger()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(name, edge, none, labels):
    rows = OPERATORS[name](edge, labels).collect()
    count = lambda ids: sorted(map(str, ids))
    assert count(r.doc_id for r in rows) == count(r[0] for r in ROWS)
    assert OPERATORS[name](none, labels.limit(0)).collect() == []


def test_quality_edge_values(edge, labels):
    rows = quality.quality(edge, labels).collect()
    blank = [r for r in rows if r.doc_id in (3, 4, 5)]
    assert len(blank) == 3 and all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.score) == (0, 0, 0, 0, 0, True, False, 0.0) for r in blank)
    (long,) = [r for r in rows if r.doc_id == 6]
    assert (long.n_words, long.word_chars, long.n_repeat_words, long.base_failed) == (40_001, 160_003, 40_000, True)
    twice = [r for r in rows if r.doc_id == 2]
    assert len(twice) == 2 and len({tuple(r) for r in twice}) == 1
    assert {r.score for r in quality.quality(edge, labels.limit(0)).collect()} == {0.0}


def test_token_file_edge_values(edge):
    rows = tokenfile.read_tokens(tokenfile.write_tokens(edge)).collect()
    library = Tokenizer.from_file(tokens.VOCABULARY)
    assert all(np.frombuffer(r.ids, "<u4").tolist() == [2] for r in rows if r.doc_id in (3, 4, 5))
    (long,) = [r for r in rows if r.doc_id == 6]
    assert np.frombuffer(long.ids, "<u4").tolist() == library.encode(LONG, add_special_tokens=False).ids + [2]
    starts = sorted((r.start, len(r.ids) // 4, r.doc_id is None, r.doc_id or 0) for r in rows)
    assert all(a[0] + a[1] == b[0] for a, b in zip(starts, starts[1:])) and [x[2] for x in starts[:2]] == [True, True] and [x[3] for x in starts[2:]] == sorted(x[3] for x in starts[2:])


CHAT_COLUMNS = ["window", "turns", "cost", "open", "body", "close", "upto", "starts", "sys", "part", "marks", "bodies", "targets", "formatted", "chars", "w", "repeated"]


def test_chat_edge_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    table = spark.createDataFrame([(1, 0, None, None), (1, 0, None, None), (1, 1, "assistant", LONG), (None, None, None, ""), (2, 0, "assistant", None), (2, 0, "user", "x")], schema).select("*", *[F.lit(-5).alias(c) for c in CHAT_COLUMNS])
    got = {r.conv_id: r for r in chat.digests(chat.read_windows(chat.chat_windows(table))).collect()}
    digest = lambda *turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (3, digest(("", ""), ("", ""), ("assistant", LONG)), len(LONG), hashlib.sha256(LONG.encode()).hexdigest())
    assert (got[None].n_turns, got[None].turns_sha256, got[None].loss_chars) == (1, digest(("", "")), 0) and (got[2].turns_sha256, got[2].loss_chars) == (digest(("assistant", ""), ("user", "x")), 0)
    empty = spark.createDataFrame([], schema)
    assert chat.chat_windows(empty).collect() == []
    (probe,) = chat.digests(chat.read_windows(chat.chat_windows(chat.probe(empty)))).collect()
    said = "</s>[INST] ok [/INST]"
    assert (probe.conv_id, probe.turns_sha256, probe.loss_chars) == (-1, digest(("user", said), ("assistant", said)), len(said))


def test_last_stage_on_edge_rows(spark, edge, none, sf):
    rows = corpus_pipeline.STAGES[4][1](spark, edge, sf).collect()
    library = Tokenizer.from_file(tokens.VOCABULARY)
    want = Counter(len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in ROWS)
    assert Counter(r.doc_tokens for r in rows if r.start == 0) == want and sum(r.length for r in rows) == sum(k * n for k, n in want.items())
    assert {r.ids_crc32 for r in rows if r.doc_id in (3, 4, 5)} == {zlib.crc32(np.array([2], "<u4").tobytes())}
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert at.get(r.sequence_id, 0) == r.offset
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 4096 and corpus_pipeline.STAGES[4][1](spark, none, sf).collect() == []


def test_packing_edge_rows(edge, none):
    rows = packing.pack(edge).collect()
    check_pieces(rows)
    assert sum(r.length for r in rows) == sum(len(Tokenizer.from_file(tokens.VOCABULARY).encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in ROWS)
    assert packing.pack(none).collect() == []


def test_exact_edge_rows(edge):
    rows = exact_dedup.exact_groups(edge).collect()
    assert {r.keep_id for r in rows if r.group_size == 3} == {2} and {r.keep_id for r in rows if r.doc_id in (3, 4)} == {4}
    assert [r.keep_id for r in rows if r.doc_id is None] == [None, None]


def test_near_edge_rows(edge):
    rows = jaccard_join.near_classes(edge).collect()
    assert {(r.class_id, r.n_links) for r in rows if r.doc_id in (1, 2)} == {(1, 2)} and {(r.class_id, r.n_links) for r in rows if r.doc_id in (3, 4, 5)} == {(3, 0), (4, 0), (5, 0)}


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_and_take_effect(k, spark, edge, none, sf):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, edge, sf)
    assert out.columns == edge.columns
    rows = out.collect()
    texts = [r.text for r in rows]
    if k == 1:
        assert sorted(map(str, texts)) == sorted(map(str, {(r[1] or "") if r[0] not in (3,) else "" for r in ROWS}))
    if k == 2:
        assert sum(t == ROWS[0][1] for t in texts) == 1 and LONG in texts
    if k == 3:
        sizes = {r[3]: 0 for r in ROWS}
        for r in rows:
            sizes[r.source] += len(WORD.findall(r.text))
        goal = mixing.targets([(s, sum(len(WORD.findall(r[1] or "")) for r in ROWS if r[3] == s)) for s in sizes])
        assert all(abs(sizes[s] - goal[s]) <= 7 or s == "c" for s in sizes)
    assert stage(spark, none, sf).collect() == []


def test_pipeline_against_its_stages_by_hand(spark, docs, sf):
    kept = {r.doc_id for r in quality.quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    last = {}
    for i, t in sorted(rows):
        last[t] = i
    rows = sorted((i, t) for t, i in last.items())
    classes = brute_classes(rows)
    want = {i for i, _ in rows if classes[i][0] == i}
    staged = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        staged = shared.written(stage(spark, staged, sf), "stage")
    assert {r.doc_id for r in staged.collect()} == want
    texts = dict(rows)
    mixed = shared.written(corpus_pipeline.STAGES[3][1](spark, staged, sf), "stage")
    times = Counter(r.doc_id for r in mixed.collect())
    packed = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == times and set(times) <= want
    library, pieces = Tokenizer.from_file(tokens.VOCABULARY), Counter()
    for r in packed:
        pieces[r.doc_id] += r.length
    for doc, n in times.items():
        ids = library.encode(texts[doc], add_special_tokens=False).ids + [2]
        assert pieces[doc] == n * len(ids) and all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in packed if r.doc_id == doc)
