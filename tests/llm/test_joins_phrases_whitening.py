"""Operators 11 to 13 against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; and cases of earlier operators that were once wrong."""

import collections
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from handspan.llm import hilbert_ann, kneser_ney, mixing, overlap_join, packed, phrases, toxicity, warc_fixity, whitening
from handspan.llm.token_counts import token_counts

BPE = public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(autouse=True)
def many_parts(monkeypatch):
    monkeypatch.setattr(packed, "LEAST_BYTES", 4096)


# --- 11 --------------------------------------------------------------------------------------------------------------


def test_cholesky_and_jacobi():
    rng = np.random.default_rng(1)
    for d, rank in ((1, 1), (7, 7), (12, 5), (33, 33), (4, 0)):
        b = rng.standard_normal((d, rank)) * 10.0 ** rng.integers(-3, 3, rank)
        a = b @ b.T
        factor = whitening.pivoted_cholesky(a)
        assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, a, atol=1e-12 * max(1, np.abs(a).max(initial=0)))
        values, vectors = whitening.jacobi(factor)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-9, atol=1e-12 * np.abs(a).max(initial=0))
        assert np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-12)


def test_whitening(spark):
    rng = np.random.default_rng(2)
    spread = rng.standard_normal((6, 6)) * [3, 2, 1.5, 1, 0.6, 0.3]
    rows = [(i, (rng.standard_normal(6) @ spread.T).tolist()) for i in range(80)] + [(100 + i, [1.0] * 6) for i in range(40)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (200, None), (201, []), (202, [None, *[1.0] * 5]), (203, [float("nan")] * 6), (204, [float("inf"), *[0.0] * 5])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, n int").repartition(5)
    got = whitening.whiten(df, 4).collect()
    use = [(i, np.floor(64 * np.array(v, float)) + 1_000_000) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    fit = np.unique(np.array([x for _, x in use]), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - 1_000_000 - (fit - 1_000_000).mean(axis=0)
    cov = centred.T @ centred / n
    e, c = np.linalg.eigh(cov)
    e, c = e[::-1], c[:, ::-1]
    assert len(got) == 4 * len(use) == 4 * 122 and {r.n for r in got} == {n}
    by = collections.defaultdict(list)
    for r in got:
        by[r.vec_id].append(r)
    sign = {}
    for i, x in use:
        own = [r for r in by[i] if r.deviation == int(((n * x - s) ** 2).sum())]
        assert {r.component for r in own} == {1, 2, 3, 4}
        for r in own:
            k = r.component - 1
            want = (x - 1_000_000 - (fit - 1_000_000).mean(axis=0)) @ c[:, k] / np.sqrt(e[k])
            turned = sign.setdefault(k, 1 if abs(r.whitened - want) < abs(r.whitened + want) else -1)
            assert abs(turned * r.whitened - want) < 1e-8 and abs(r.explained - e[k] / np.trace(cov)) < 1e-10 and r.identity_error < 1e-10


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], schema)).collect()
    assert {r.component for r in line} == {1} and all(abs(r.explained - 1) < 1e-12 for r in line)
    far = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 5.0])], schema)).collect()
    assert {r.vec_id for r in far} == {1, 2, 3} and all(np.isfinite(r.whitened) for r in far)
    with pytest.raises(ValueError, match="lengths"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema))


# --- 12 --------------------------------------------------------------------------------------------------------------


def shingle_set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_components(rows, size, percent):
    sets = [(i, shingle_set(t, size)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, o in sets[:a]:
            if s and o and 100 * len(s & o) >= percent * len(s | o):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    want = collections.Counter((i, len(s), find(i)) for i, s in sets)
    return want + collections.Counter((None, len(shingle_set(t, size)), None) for i, t in rows if i is None)


def family(seed, n, words, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = rng.choice(["Edit", f"v{rng.randrange(10**6)}"])
        yield " ".join(w)


@pytest.mark.parametrize(("block", "size", "percent"), [(512, 3, 90), (4, 3, 90), (3, 5, 80), (6, 3, 60)])
def test_jaccard_components(spark, monkeypatch, block, size, percent):
    monkeypatch.setattr(overlap_join, "BLOCK_ROWS", block)
    monkeypatch.setattr(overlap_join, "SALT_ROWS", 5)
    monkeypatch.setattr(overlap_join, "GROUPED_PARTS", 50)
    rows = [(i, t) for i, t in enumerate([*family(1, 40, 150, 8), *family(2, 25, 60, 5), *family(3, 12, 14, 2), *family(4, 8, 5, 1), *family(5, 6, 2000, 60)])]
    rows += [(500, None), (501, ""), (502, " \n "), (503, "one"), (504, "ONE"), (505, "one two"), (None, rows[0][1]), (None, None), (7, rows[7][1]), (9, "another text of an id that two rows have"), (506, " ".join(rows[1][1].split() * 200))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, family string, `part` int").repartition(7)
    got = collections.Counter(tuple(r) for r in overlap_join.jaccard_components(df, size, percent).collect())
    assert got == brute_components(rows, size, percent)
    assert overlap_join.jaccard_components(df.where("doc_id > 9999"), size, percent).count() == 0


def test_search_is_counting():
    rng = np.random.default_rng(3)
    for n in (1, 5, 60):
        sets = [np.unique(rng.integers(0, 200, rng.integers(1, 80))).astype(np.uint64) for _ in range(n)]
        lists = overlap_join.Lists(sets)
        for q in [*sets[:8], np.array([999], np.uint64)]:
            for least in (1, 2, len(q) // 2 or 1, len(q)):
                place, both = lists.search(q, least)
                want = {i: len(np.intersect1d(q, s)) for i, s in enumerate(sets)}
                assert dict(zip(place.tolist(), both.tolist(), strict=True)) == {i: c for i, c in want.items() if c >= least}


def test_linked_sets_share_a_part():
    rng = np.random.default_rng(4)
    for percent in (60, 80, 90):
        for _ in range(150):
            n = int(rng.integers(1, 400))
            base = rng.integers(0, 1 << 62, n * 2).astype(np.uint64)
            a = np.unique(base[:n])
            drop, add = int(rng.integers(0, n // 5 + 1)), int(rng.integers(0, n // 5 + 1))
            b = np.unique(np.concatenate([a[drop:], base[n : n + add]]))
            both = len(np.intersect1d(a, b))
            if len(b) and not np.array_equal(a, b) and 100 * both >= percent * (len(a) + len(b) - both):
                h, row = overlap_join.part_hashes(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
                assert len(np.intersect1d(h[row == 0], h[row == 1]))


# --- 13 --------------------------------------------------------------------------------------------------------------


def brute_phrases(rows, support, longest, best, contained):
    f, n, out = collections.Counter(), collections.Counter(), {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= support}
    gone = {(g, p[i : i + k]) for (g, p), a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= contained * found[g, p[i : i + k]]}
    for (g, p), a in found.items():
        if (g, p) not in gone:
            score, _, left, right = min((1000 * a * n[g] // (f[g, p[:k]] * f[g, p[k:]]), k, f[g, p[:k]], f[g, p[k:]]) for k in range(1, len(p)))
            out.setdefault(g, []).append((-score, -a, " ".join(p).encode(), left, right))
    return {(g, i + 1, x[2].decode(), -x[1], x[3], x[4], n[g], -x[0]) for g, v in out.items() for i, x in enumerate(sorted(v)[:best])}


@pytest.mark.parametrize(("support", "longest", "best", "contained", "chunk"), [(6, 5, 2000, 100, 300), (3, 5, 25, 100, 10**6), (9, 3, 2000, 80, 50), (4, 2, 10, 100, 300)])
def test_collocations(spark, monkeypatch, support, longest, best, contained, chunk):
    monkeypatch.setattr(phrases, "CHUNK_WORDS", chunk)
    rng = random.Random(support)
    vocab = ["The", "of", "and", "état", "日本", "New", "York", "city", "a\tb", "x" * 40, *[f"w{i}" for i in range(25)]]
    prose = lambda k: "".join(rng.choice(vocab) + rng.choice([" ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b"]) for _ in range(k))
    rows = [(i, prose(rng.randrange(1, 120)) + "New York city of the and " * rng.randrange(3), rng.choice(["en", "de", None, "und"])) for i in range(60)]
    rows += [(100, None, "en"), (101, "", "en"), (102, ".,;", "fr"), (103, prose(9000), "en"), (None, prose(50), "en"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(i, t, g, 1, 2) for i, t, g in rows], "doc_id long, text string, lang string, least int, shard int").repartition(5)
    got = {tuple(r) for r in phrases.collocations(df, support, longest, best, contained).collect()}
    want = brute_phrases([(g, t) for _, t, g in rows], support, longest, best, contained)
    assert got == want and want
    assert phrases.collocations(df.where("doc_id > 9999"), support).count() == 0


# --- earlier operators -----------------------------------------------------------------------------------------------


def test_neighbours_of_tiny_and_huge_vectors(spark):
    rows = [(0, [1e-200, 2e-200]), (1, [1e200, 1e200]), (2, [1.0, 2.0]), (3, [3.0, -1.0]), (4, [5e-324, 1e-323])]
    got = hilbert_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [2, 4, 1, 3] and all(0 <= r.score <= 1 + 1e-15 for r in got)


def test_names_that_differ_by_case_or_hold_signs(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 5, 1, 2.0), (2, None, None, 7, 1, 2.0)], "doc_id long, text string, source string, N_Tokens long, `a.b` int, `back``tick` double")
    counted = token_counts(docs, BPE, 8)
    assert sorted(r.n_tokens for r in counted.select("n_tokens").collect()) == [0, 3] and "a.b" in counted.columns
    odd = docs.withColumn("MIX_EPOCH", F.lit(1))
    mixed = mixing.mix(odd, mixing.mixture(odd, BPE))
    assert mixed.select("mix_epoch").count() >= 2 and "back`tick" in mixed.columns and "MIX_EPOCH" not in mixed.columns
    scored = kneser_ney.score(docs.withColumn("SCORE", F.lit(1)), kneser_ney.train(docs, order=2))
    assert scored.select("score").count() == 2


def test_slots_of_large_ids_are_whole_numbers(spark):
    top = (1 << 62) + 4097
    pages = spark.createDataFrame([(top, "u", "x"), (top + 1, "u", "y"), (-3, "u", "z")], "page_id long, url string, html string")
    other = spark.createDataFrame([(top, "u", "x"), (top + 1, "u", "q"), (-3, "u", "w")], "page_id long, url string, html string")
    got = {r.slot: r.file for r in warc_fixity.audit(pages, other).collect()}
    assert got == {top + 1: (top + 1) // 4096, -3: -1}


def test_labels_of_a_shared_id_are_one_row(spark):
    docs = spark.createDataFrame([(1, f"awful text {i}") for i in range(50)] + [(i, "fine words here") for i in range(2, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 30)], "doc_id long, toxic int")
    assert toxicity.severity(docs, toxicity.fit(docs, labels)).count() == 78
