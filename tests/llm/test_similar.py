"""Near-duplicates, lines, classifiers and the pipeline, against brute force."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillframe.llm import line_dedup, near_dedup, quality_gam, queries

FOLDER = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(sequence, alphabet, edits, rng):
    out = list(sequence)
    for _ in range(edits):
        k, what = rng.randrange(len(out) + 1), rng.randrange(3)
        if what == 0:
            out.insert(k, rng.choice(alphabet))
        elif out:
            k = min(k, len(out) - 1)
            if what == 1:
                out.pop(k)
            else:
                out[k] = rng.choice(alphabet)
    return out


def test_banded_distance():
    rng = random.Random(0)
    for _ in range(3000):
        a = [rng.randrange(4) for _ in range(rng.randrange(14))]
        b = edited(a, range(4), rng.randrange(6), rng)
        most = rng.randrange(8)
        want = min(distance(a, b), most + 1)
        assert near_dedup.banded_distance(a, b, most) == want
        assert near_dedup.edit_distance(a, b, most) == want


def words_apart(a, b):
    """The word edit distance, a row of the table at a time."""
    import numpy as np

    at = np.arange(len(b) + 1)
    row = at.copy()
    for i, x in enumerate(a, 1):
        new = np.minimum(row + 1, np.concatenate(([i], row[:-1] + np.array([x != y for y in b], int))))
        row = np.minimum.accumulate(new - at) + at
    return int(row[-1])


def similar(a, b):
    """Whether two lists of words are a link, by counted shingles and the whole table of edits."""
    grams = [collections.Counter(zip(*(w[k:] for k in range(near_dedup.SHINGLE)))) for w in (a, b)]
    common, every = (grams[0] & grams[1]).total(), (grams[0] | grams[1]).total()
    return every > 0 and common >= near_dedup.FLOOR * every and words_apart(a, b) <= (1 - near_dedup.SIMILAR) * max(len(a), len(b)) + 1e-9


def classes(texts):
    """Union of all similar pairs, by comparing each with each that is not yet in its class."""
    words = {i: re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower()) for i, t in texts}
    equal, root = {}, {i: i for i, _ in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, t in texts:
        if t:
            first = equal.setdefault(tuple(words[i]) or t, i)
            root[find(i)] = find(first) if first <= i else find(i)
    some = sorted(equal.values())
    shared = collections.defaultdict(set)
    for i in some:
        for gram in zip(*(words[i][k:] for k in range(near_dedup.SHINGLE))):
            shared[gram].add(i)
    for i in some:
        for j in sorted({j for g in zip(*(words[i][k:] for k in range(near_dedup.SHINGLE))) for j in shared[g] if j < i}):
            x, y = find(i), find(j)
            if x != y and similar(words[i], words[j]):
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in texts}


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(500)]
    passage = rng.choices(words, k=60)
    texts = []
    for _ in range(40):
        base = rng.choices(words, k=rng.randrange(30, 150))
        texts += [base] + [edited(base, words, rng.randrange(0, 1 + len(base) // 16), rng) for _ in range(rng.randrange(4))]
    base = rng.choices(words, k=120)
    texts += [edited(base, words, rng.randrange(1, 4), rng) for _ in range(150)]  # one large group of near copies
    texts += [passage + rng.choices(words, k=50) for _ in range(150)]  # one common passage
    out = [" ".join(t) for t in texts]
    out += [out[0]] * 60 + [None, "", None, "?!", "?!", "one two", "one two", "One, two!", "a b c d"]
    return list(enumerate(out))


@pytest.mark.parametrize("bucket", [48, 8])
def test_near_duplicates(spark, monkeypatch, bucket):
    monkeypatch.setattr(near_dedup, "BUCKET", bucket)
    texts = corpus()
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, class_id string, n int").repartition(5)
    got, want = {r.doc_id: r.class_id for r in near_dedup.classes(d).collect()}, classes(texts)
    assert all(want[i] == want[c] for i, c in got.items())  # nothing is joined that should not be
    assert sum(got[i] != want[i] for i in want) <= 0.005 * len(want)
    kept = near_dedup.keep_one(d)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 100_000])
def test_copies_of_copies_in_a_large_family(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(7)
    words = [f"w{k}" for k in range(5000)]
    source = rng.choices(words, k=100)
    texts = []
    for _ in range(1000):
        copy = list(source)
        for _ in range(5):
            copy[rng.randrange(100)] = rng.choice(words)
        second = list(copy)
        for _ in range(5):
            second[rng.randrange(100)] = rng.choice(words)
        texts += [" ".join(copy), " ".join(second)]
    rng.shuffle(texts)
    want = classes(list(enumerate(texts)))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(d).collect()}
    assert sum(got[k] != want[k] for k in got) <= 0.002 * len(want)


def test_near_duplicates_of_awkward_tables(spark):
    rows = [(None, "a b c d e f", 1), (1, "a b c d e f", 2), (1, "A b c d e f", 3), (1, "a b c d e f", 4), (None, None, 5), (None, "x y", 6), (None, "x, y", 7), (2, None, 8), (2, None, 9), (3, "", 10)]
    d = spark.createDataFrame(rows, "doc_id long, text string, key int").repartition(3)
    got = sorted(map(tuple, near_dedup.classes(d).collect()), key=str)
    assert got == sorted([(None, 1), (1, 1), (1, 1), (1, 1), (None, None), (None, None), (None, None), (2, 2), (2, 2), (3, 3)], key=str)
    kept = near_dedup.keep_one(d)
    assert kept.columns == d.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(left) == 5
    assert {(2, None), (3, ""), (None, None)} < set(left)
    assert sum(i == 1 for i, _ in left) == 1 and sum(t in ("x y", "x, y") for _, t in left) == 1
    assert near_dedup.classes(d.limit(0)).count() == 0
    assert near_dedup.keep_one(d.limit(0)).count() == 0


def test_alignment_of_very_long_texts_takes_memory_by_the_band():
    import tracemalloc

    rng = random.Random(3)
    a = list(range(100_000))
    b = edited(a, range(10**6, 10**6 + 9), 60, rng)
    tracemalloc.start()
    assert near_dedup.edit_distance(a, b, 20_000) <= 60
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    a = rng.choices(range(40), k=6000)
    b = edited(a, range(40), 300, rng)
    found = near_dedup.banded_distance(a, b, 600)
    near_dedup.SHORT, kept = 10_000, near_dedup.SHORT
    assert near_dedup.banded_distance(a, b, 600) == found <= 300
    near_dedup.SHORT = kept


def line_verdicts(texts, edits=1, an_edit=10):
    seen, out = {}, {}
    for i, t in texts:
        exact, near = [], []
        for k, line in enumerate((t or "").split("\n")):
            words = tuple(line.encode().lower().split())
            if not words:
                continue
            if words in seen:
                exact.append(k)
            else:
                bounds = ((w, min(edits, min(len(w), len(words)) // an_edit)) for w in seen)
                if any(n and abs(len(w) - len(words)) <= n and distance(w, words) <= n for w, n in bounds):
                    near.append(k)
                seen[words] = i
        out[i] = ((t or "").count("\n") + 1, exact, near)
    return out


@pytest.mark.parametrize(("edits", "an_edit"), [(2, 4), (3, 3)])
def test_lines_within_several_edits(spark, edits, an_edit):
    rng = random.Random(6)
    bases = [rng.choices("abcde", k=rng.randrange(2, 14)) for _ in range(12)]
    texts = [(i, "\n".join(" ".join(edited(rng.choice(bases), "abcde", rng.randrange(5), rng)) for _ in range(rng.randrange(5)))) for i in range(40)]
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_lines, r.exact, r.near) for r in line_dedup.line_report(d, edits=edits, an_edit=an_edit).collect()}
    want = line_verdicts(texts, edits, an_edit)
    assert got == want and sum(len(v[2]) for v in want.values()) > 10


def test_lines(spark):
    rng = random.Random(4)
    words = ["a", "b", "c", "d", "e"]
    bases = [rng.choices(words, k=rng.randrange(3, 16)) for _ in range(25)]
    texts = []
    for i in range(60):
        lines = [" ".join(edited(rng.choice(bases), words, rng.choice([0, 0, 1, 2]), rng)) for _ in range(rng.randrange(6))]
        texts.append((i, "\n".join(lines)))
    texts += [(60, None), (61, ""), (62, "\n\n"), (63, texts[0][1]), (64, "  ".join(["long"] * 300)), (65, " ".join(["long"] * 299))]
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in texts], "doc_id long, text string, near int, `doc.key` string").repartition(4)
    want = line_verdicts(texts)
    assert {r.doc_id: (r.n_lines, r.exact, r.near) for r in line_dedup.line_report(d).collect()} == want
    clean = line_dedup.dedup_lines(d)
    assert clean.columns == d.columns
    got = {r.doc_id: r.text for r in clean.collect()}
    for i, t in texts:
        gone = {*want[i][1], *want[i][2]}
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone) if gone else t
        assert got.get(i) == (left if not gone or left.split() else None)
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0


def test_lines_of_repeated_rows_stay(spark):
    d = spark.createDataFrame([(1, "one two three four five six")] * 2 + [(None, "one two three four five six seven")], "doc_id long, text string")
    assert line_dedup.dedup_lines(d).where("doc_id = 1").count() == 2


def test_quality_scores_hold_out(spark):
    folder = FOLDER.replace("0.001", "0.01")
    got = queries.op10_quality_gam(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)
    d = spark.createDataFrame([(1, None), (2, ""), (None, "x")], "doc_id long, text string")
    none = quality_gam.scores(d, labels.limit(0))
    assert [r.score for r in none.collect()] == [0.5] * 3
    assert quality_gam.scores(d.limit(0), labels).count() == 0


def test_gam_learns_interactions():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) != (x[:, 1] > 0)).astype(float)
    model = quality_gam.Gam(pairs=1).fit(x[:3000], y[:3000])
    assert model.pairs == [(0, 1)]
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_gam_scores_are_sums_of_table_entries(spark):
    """Against bins found one by one, and counts of texts with repeated rows, empty ones and one of 400,000 words."""
    import math

    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4)).round(2)
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float)
    model = quality_gam.Gam(bins=9, pair_bins=4, rounds=20, pair_rounds=10, pairs=2).fit(x, y)
    twice = quality_gam.Gam(bins=9, pair_bins=4, rounds=20, pair_rounds=10, pairs=2).fit(x, y, np.ones(600))
    assert np.allclose(model.score(x), twice.score(x))
    for row, got in zip(x, model.score(x), strict=True):
        at = lambda edges, v: sum(e <= v for e in edges)
        total = model.intercept + sum(t[at(e, v)] for t, e, v in zip(model.tables, model.edges, row, strict=True))
        total += sum(t[at(model.coarse[i], row[i]), at(model.coarse[j], row[j])] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        assert abs(got - 1 / (1 + math.exp(-total))) < 1e-12
    texts = [(i, f"plain words number {i} and some more of them." * (1 + i % 5), i % 2) for i in range(200)]
    d = spark.createDataFrame([*texts, texts[0], (500, "word " * 400_000, 1), (501, None, 0), (502, "", 0)], "doc_id long, text string, quality int")
    labels = d.select("doc_id", "quality").unionAll(d.select("doc_id", F.lit(7).alias("quality")))
    got = quality_gam.scores(d.withColumn("score", F.lit("clash")), labels)
    rows = got.collect()
    assert len(rows) == 204 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 0}) == 1
    few = quality_gam.scores(d, labels, sample=50).collect()
    assert len(few) == 204


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {r.doc_id for r in queries.op2_quality_rules(spark, FOLDER).where("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    verdicts = line_verdicts(sorted(texts.items()))
    left = {}
    for i, t in texts.items():
        gone = {*verdicts[i][1], *verdicts[i][2]}
        text = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone) if gone else t
        if not gone or text.split():
            left[i] = text
    group = classes(sorted(left.items()))
    left = {i: t for i, t in left.items() if group[i] == i}
    from tests.llm.test_exact import contamination

    dirty = {r[0] for r in contamination(left.items(), spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()) if r[2]}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert {i: r.text for i, r in got.items()} == {i: t for i, t in left.items() if i not in dirty}
    assert all(r.round_trip and len(r.ids) == 4 * r.n_tokens for r in got.values())
    assert collections.Counter(len(s) for s in corpus_pipeline.STAGES) == {2: 5}
