"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every corpus operator and every pipeline stage."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from handspan.llm import decontaminate, hilbert_ann, kneser_ney, mixing, near_dedup, packed, suffix_dedup, token_counts, token_output, toxicity, warc_fixity

BPE = public_tokenizers.path("byte_bpe_50k.json")
#: Names that the operators use on the way, or give to their own columns.
CLASHES = (
    "_text", "_key", "_tie", "_gone", "_epochs", "_s", "c_0", "c_1", "key", "k", "s", "t", "src", "row", "part", "kind", "data", "block", "epoch", "tie", "n_bytes", "n_tokens", "over_limit", "n_known", "score",
    "p_toxic", "rejected", "grade", "n_words", "n_hit", "items", "spans", "ranges", "contaminated", "mix_epoch", "mix_block", "mix_place", "n_blocks", "cut_block", "start", "kept", "component_id", "bands", "signature", "y", "target",
)
OWN = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(autouse=True)
def many_parts(monkeypatch):
    monkeypatch.setattr(packed, "LEAST_BYTES", 4096)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    long, base = prose(180_000), prose(80)
    assert len(long) > 1_000_000
    out = [(i, prose(40), "en", "a", 1) for i in range(12)]
    out += [(20, base, "en", "b", 1), (21, base, None, "b", None), (22, base + " more", "en", None, 1), (23, None, "en", "a", 1), (24, "", "en", "a", 1), (25, " \n ", None, None, None), (26, long, "en", "c", 1)]
    out += [(None, base, "en", "b", 1), (None, None, None, None, None), (20, base, "en", "b", 1), (3, "a text of an id that another row has too", "en", "a", 1)]
    return out


@pytest.fixture(scope="module")
def plain(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="module")
def clashing(plain):
    return plain.select("*", *[F.when(F.coalesce(F.col("doc_id"), F.lit(0)) % 2 == 0, F.lit(c)).alias(c) for c in CLASHES])


def digest(df, columns=None):
    """The rows as a sorted list of texts, of long values their hash."""
    return sorted(str([hash(v) if isinstance(v, str) and len(v) > 300 else v for v in r]) for r in df.select(*[F.col(f"`{c}`") for c in columns or df.columns]).collect())


def model(docs):
    return kneser_ney.train(docs, order=3)


def benchmark(docs):
    return docs.sparkSession.createDataFrame([("x", "one two three four five six seven eight nine ten eleven twelve thirteen"), ("y", None), ("z", "")], "item_id string, text string")


def labels(docs):
    return docs.sparkSession.createDataFrame([(0, 1, 0), (1, 1, 1), (2, None, None), (None, 1, 1), (20, 1, 0), (20, 1, 1)], "doc_id long, quality int, toxic int")


#: Operators as functions of documents, and their columns that depend on nothing but the documents.
OPERATORS = {
    "suffix_dedup": (lambda d: suffix_dedup.suffix_dedup(d), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]),
    "token_counts": (lambda d: token_counts.token_counts(d, BPE), ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]),
    "prefix_table": (lambda d: token_counts.prefix_table(d.where("length(text) < 1000 or text is null"), BPE).select("doc_id", F.size("ends").alias("n"), F.array_max("counts").alias("m")), ["doc_id", "n", "m"]),
    "mixing": (lambda d: mixing.mix(d, mixing.mixture(d, BPE)), [*OWN, "mix_epoch", "mix_block", "mix_place"]),
    "token_output": (lambda d: token_output.token_digest(token_output.write_token_shards(d, BPE)), ["doc_id", "start", "n_tokens", "ids_crc32"]),
    "lm_scoring": (lambda d: kneser_ney.score(d, model(d)).withColumn("score", F.round("score", 6)), [*OWN, "n_tokens", "n_known", "score"]),
    "decontamination": (lambda d: decontaminate.contamination(d, benchmark(d)), [*OWN, "n_words", "n_hit", "items", "contaminated"]),
    "cut_spans": (lambda d: decontaminate.cut_spans(d, benchmark(d)), OWN),
    "toxicity": (lambda d: toxicity.severity(d, toxicity.fit(d, labels(d))).withColumn("p_toxic", F.round("p_toxic", 6)), [*OWN, "p_toxic", "grade", "rejected"]),
    "near_dedup": (lambda d: near_dedup.near_duplicates(d), ["doc_id", "n_shingles", "component_id", "kept"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(plain, clashing, name):
    f, columns = OPERATORS[name]
    want, got = digest(f(plain), columns), digest(f(clashing), columns)
    if name == "token_output":  # of rows of one key and text either may come first
        want, got = ([r.split(", ")[0] for r in x] for x in (want, got))
    assert got == want
    if name not in ("mixing", "prefix_table", "suffix_dedup"):
        assert len(got) == plain.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_no_rows(plain, clashing, name):
    assert OPERATORS[name][0](clashing.where("doc_id = -5")).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, sf_dir, plain, clashing, name, stage):
    want, got = stage(spark, plain, sf_dir), stage(spark, clashing, sf_dir)
    if name == "token_output":
        assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r.doc_id) for r in plain.collect())
    else:
        assert got.columns == clashing.columns and want.columns == plain.columns
        assert digest(got, OWN) == digest(want)
        sides = [c for c in clashing.columns if c not in OWN]
        given = {str(r.doc_id): tuple(r[c] for c in sides) for r in clashing.collect()}
        assert all(tuple(r[c] for c in sides) == given[str(r.doc_id)] for r in got.collect())
    if name in ("toxicity", "decontamination"):  # nothing here is toxic or of the benchmark
        assert digest(want) == digest(plain)
    if name == "near_dedup":
        ids = [r.doc_id for r in want.collect()]
        assert 21 not in ids and 22 not in ids and ids.count(None) == 2 and {20, 23, 24, 25, 26} <= set(ids)
    if name == "mixing":
        assert {str(r) for r in digest(want)} == {str(r) for r in digest(plain)}
    nothing = stage(spark, clashing.where("doc_id = -5"), sf_dir)
    assert nothing.count() == 0


def test_pages(spark):
    pages = [(k, f"u{k}", "x" * k) for k in range(40)] + [(None, None, None), (41, None, "long " * 300_000), (7, "u7", "x" * 7)]
    a = spark.createDataFrame(pages, "page_id long, url string, html string")
    b = a.where("page_id is null or page_id != 9").withColumns({c: F.lit(None).cast("string") for c in ("node", "r", "h", "size", "digest", "records", "child")})
    b = b.withColumn("html", F.when(F.col("page_id") == 41, F.concat("html", F.lit("!"))).otherwise(F.col("html")))
    got = {r.slot: r.status for r in warc_fixity.audit(a, b).collect()}
    assert got == {9: "missing", 41: "changed"}
    assert warc_fixity.audit(a, a).count() == 0 and warc_fixity.audit(a.where("page_id < 0"), b.where("page_id < 0")).count() == 0


def test_vectors(spark):
    v = [(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(30)] + [(None, [1.0, 1.0, 1.0]), (31, None), (32, [0.0, 0.0, 0.0]), (33, [None, 1.0, 1.0]), (34, [float("nan"), 1.0, 1.0]), (3, [3.0, 1.0, 0.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    more = df.withColumns({c: F.lit(1) for c in ("entry", "vector", "ids", "asked", "curve", "rank", "id", "h", "query", "score", "own", "first")})
    rows = lambda d: sorted(map(tuple, hilbert_ann.nearest(d, F.col("vec_id") % 10 == 0, 4).collect()))
    got = rows(df)
    assert got == rows(more) and len(got) == 12 and all(r[2] < 30 for r in got)
    with pytest.raises(Exception, match="lengths"):
        hilbert_ann.nearest(df.union(spark.createDataFrame([(50, [1.0, 2.0, 3.0, 4.0])], df.schema)), F.col("vec_id") % 10 == 0, 4).collect()


def test_graded_labels(spark):
    """Severity grades in the labels are learned as they are."""
    rng = random.Random(4)
    mild, foul = [f"mild{i}" for i in range(8)], [f"foul{i}" for i in range(8)]
    rows, y = [], []
    for i in range(900):
        g = i % 3
        text = [rng.choice([f"word{k}" for k in range(200)]) for _ in range(30)] + [rng.choice(mild) for _ in range(4 * (g > 0))] + [rng.choice(foul) for _ in range(4 * (g > 1))]
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        y.append((i, g))
    docs, graded = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(y, "doc_id long, toxic int")
    m = toxicity.fit(docs.where("doc_id < 600"), graded)
    assert len(m.cuts) == 2 and m.cuts[0] < m.cuts[1]
    got = toxicity.severity(docs.where("doc_id >= 600"), m).collect()
    assert sum(r.grade == r.doc_id % 3 for r in got) > 0.9 * len(got)


def test_mixture_is_the_formula(spark, plain):
    """The plan and the rows that it takes, computed again on the driver."""
    import math

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    docs = plain.where("doc_id is not null and (doc_id < 20 or doc_id > 21) and (text is null or length(text) < 1000)").dropDuplicates(["doc_id"])
    n = {}
    for r in docs.collect():
        n.setdefault(r.source, []).append(len(tok.encode(r.text or "", add_special_tokens=False).ids))
    total = {s: sum(c) for s, c in n.items()}
    shares = {s: c / sum(total.values()) for s, c in total.items() if c}

    def entropy(t):
        z = sum(x**t for x in shares.values())
        return -sum(x**t / z * math.log2(x**t / z) for x in shares.values())

    low, high = 0.0, 1.0
    if entropy(1.0) < 0.95 * math.log2(len(shares)):
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if entropy(mid) >= 0.95 * math.log2(len(shares)) else (low, mid)
    else:
        low = 1.0
    plan = {r.src: r for r in mixing.mixture(docs, BPE, repeats=1000.0).collect()}
    z = sum(x**low for x in shares.values())
    size = sum(total.values()) * max(x ** (1 - low) for x in shares.values()) * z
    for s, share in shares.items():
        r = plan["null" if s is None else "=" + s]
        assert math.isclose(r.exponent, low, abs_tol=1e-9) and math.isclose(r.weight, share**low / z, rel_tol=1e-6)
        assert abs(r.target - size * share**low / z) <= 1 and r.n_tokens == total[s] and r.epochs == r.target // r.n_tokens
    taken = {}
    for r in mixing.mix(docs, mixing.mixture(docs, BPE, repeats=1000.0)).collect():
        taken.setdefault(r.source, []).append((r.mix_epoch, r.mix_block, r.mix_place, r.doc_id))
    count = {(r.source, r.doc_id): len(tok.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    for s in shares:
        r, own = plan["null" if s is None else "=" + s], sorted(taken[s])
        docs_of = sorted(d for (x, d) in count if x == s)
        for e in range(r.epochs):
            assert sorted(d for ep, _, _, d in own if ep == e) == docs_of
        tail = [count[s, d] for ep, _, _, d in own if ep == r.epochs]
        rest = r.target - r.epochs * r.n_tokens
        assert sum(tail) >= rest and (not tail or sum(tail) - tail[-1] < rest)
