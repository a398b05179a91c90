"""The ten corpus operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from handspan.llm import components, decontaminate, hilbert_ann, induced, kneser_ney, mixing, near_dedup, packed, suffix_dedup, text, token_counts, token_output, toxicity, warc_fixity

BPE = public_tokenizers.path("byte_bpe_50k.json")
SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def low(t):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())


def words_of(t, pattern=SPACE):
    return pattern.findall(low(t))


def corpus(seed=1, n=60):
    """Prose with copies, near copies, shared passages, odd bytes, nulls and empties."""
    rng = random.Random(seed)
    vocab = ["the", "of", "and", "Éclair", "ñandú", "日本", "alpha,", "beta.", "x" * 30, "gamma", "delta\t", "ep si", "zeta\n"] + [f"w{rng.randrange(10**6)}" for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    base, passage = prose(120), prose(60)
    rows = []
    for i in range(n):
        kind = i % 8
        t = {0: base, 1: prose(rng.randrange(1, 200)), 2: " ".join(w if rng.random() > 0.02 else "edit" for w in base.split(" ")), 3: prose(20) + " " + passage + " " + prose(15), 4: None, 5: "", 6: prose(2), 7: "a" * rng.randrange(40, 120) + prose(5)}[kind]
        rows.append((i * 3, t, "en", f"s{min(i % 5, 2)}" if i % 11 else None, len(t or "")))
    rows.append((1000, prose(9000), "en", "s1", 1))
    return rows


@pytest.fixture(autouse=True)
def many_parts(monkeypatch):
    """Small tables are dealt to as many parts as the session has, as large ones are."""
    monkeypatch.setattr(packed, "LEAST_BYTES", 1024)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 1 ---------------------------------------------------------------------------------------------------------------


def removed(rows, size=50):
    seen = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - size + 1) if i is not None else ():
            s = b[k : k + size]
            seen[s] = min(seen.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for k in range(len(b) - size + 1) if i is not None else ():
            if seen[b[k : k + size]] < i:
                mark[k : k + size] = b"\1" * size
        spans = len(re.findall(rb"\x01+", bytes(mark)))
        out.append((i, len(b), sum(mark), spans, hashlib.sha256(bytes(c for c, m in zip(b, mark, strict=True) if not m)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, seed):
    rows = [(r[0], r[1]) for r in corpus(seed)] + [(None, "n" * 80), (2, "ab" * 60), (4, "xy" + "ab" * 55), (5, "q" * 200), (9, "q" * 70), (9, "q" * 70), (9, "other text of this id " * 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffix_dedup.suffix_dedup(d).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == removed(rows)


def test_suffix_dedup_of_a_large_class(spark, monkeypatch):
    """A passage after many different beginnings is cut finely, and loses nothing by it."""
    rng = random.Random(5)
    w = lambda k: " ".join("".join(rng.choice("etaoin") for _ in range(rng.randrange(2, 7))) for _ in range(k))
    passage = w(30)
    rows = [(i, w(12) + " " + passage + " " + w(12)) for i in range(500)]
    monkeypatch.setattr(suffix_dedup, "LARGE_CLASS", 100)
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == removed(rows)


def test_suffix_dedup_sorts_little_that_is_shared_by_chance(spark, monkeypatch, tmp_path):
    """Texts of few syllables share most 34 bytes by chance, but hardly any 50: few of them need sorting."""
    rng = random.Random(11)
    syllables = ["ta", "rei", "mosu", "le"]
    passage = "".join(rng.choice(syllables) for _ in range(60))
    rows = [(i, "".join(rng.choice(syllables) for _ in range(150)) + (passage if i % 50 == 0 else "")) for i in range(700)]
    sort_shard = suffix_dedup.sort_shard

    def counted(texts, docs, length):
        (tmp_path / f"{hash(texts[0])}-{len(texts)}").write_text(str(sum(map(len, texts))))
        return sort_shard(texts, docs, length)

    monkeypatch.setattr(suffix_dedup, "sort_shard", counted)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffix_dedup.suffix_dedup(d).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == removed(rows)
    assert 0 < sum(int(f.read_text()) for f in tmp_path.iterdir()) < 0.2 * sum(len(t) for _, t in rows)


def test_suffix_dedup_sends_few_rows(spark, monkeypatch):
    """Removed ranges go from exchange to exchange as one row of each part, however many tasks have found them."""
    rng = random.Random(12)
    texts = ["".join(rng.choice("etaoin ") for _ in range(300)) for _ in range(40)]
    rows = [(i, rng.choice(texts) + rng.choice(texts)) for i in range(600)]
    monkeypatch.setattr(packed, "LEAST_BYTES", 80 << 10)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    ranges, parts = suffix_dedup.repeated_ranges(d)
    assert parts > 1
    assert 0 < ranges.where("kind = 0").count() <= parts * (parts + 1)
    got = suffix_dedup.suffix_dedup(d).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == removed(rows)


@pytest.mark.parametrize("length", [48, 53, 56])
def test_suffix_dedup_of_other_lengths(spark, length):
    rows = [(r[0], r[1]) for r in corpus(3)]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == removed(rows, length)


def test_suffix_dedup_keeps_texts_and_takes_empty_tables(docs, empty, rows):
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    kept = {r.doc_id: r.kept for r in suffix_dedup.kept_texts(docs).collect()}
    assert kept[0] == rows[0][1] and kept[12] == ""


@pytest.mark.parametrize("memory", [0, 300, 1 << 20])
def test_induced_sorting(memory):
    rng = np.random.default_rng(memory)
    for trial in range(60):
        t = rng.integers(1, rng.integers(2, 6), rng.integers(1, 150))
        t = np.append(np.repeat(t, rng.integers(1, 9, len(t))) if trial % 3 == 0 else t, 0).astype(np.uint16)
        d = int(rng.integers(2, 60))
        p, common = induced.sorted_suffixes(t, d, memory)
        assert sorted(p.tolist()) == list(range(len(t) - 1))
        pre = [tuple(t[i : i + d].tolist()) for i in p]
        assert pre == sorted(pre)
        for a, b, c in zip(pre[:-1], pre[1:], common[1:], strict=True):
            assert c == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_shards_of_production_size_spill(monkeypatch):
    """A shard of the size that the query sorts has its queues, its symbols and its result on disk beyond their limits."""
    rng = np.random.default_rng(8)
    passages = [rng.integers(97, 123, 300, dtype=np.uint8).tobytes() for _ in range(40)]
    texts = [rng.integers(97, 123, 900, dtype=np.uint8).tobytes() + (passages[i % 40] if i % 3 else b"") + rng.integers(97, 123, 100, dtype=np.uint8).tobytes() for i in range(2600)]
    assert sum(map(len, texts)) <= suffix_dedup.SORT_BYTES
    docs = rng.permutation(len(texts)).astype(np.int64)
    spilled = []
    close = induced.BucketQueue.close
    monkeypatch.setattr(induced.BucketQueue, "close", lambda self: (spilled.append(self.file is not None), close(self)))
    got = suffix_dedup.sort_shard(texts, docs, 50)
    assert spilled.count(True) >= 3
    least = {}
    for t, d in zip(texts, docs.tolist(), strict=True):
        for k in range(len(t) - 49):
            s = t[k : k + 50]
            least[s] = min(least.get(s, d), d)
    for t, d, g in zip(texts, docs.tolist(), got, strict=True):
        assert g.tolist() == [k for k in range(len(t) - 49) if least[t[k : k + 50]] < d]


def test_parts_follow_the_size(spark):
    t = spark.createDataFrame([("x" * 1000,)] * 50, "_text string").repartition(2)
    assert packed.parts_of(t) == 4
    packed.LEAST_BYTES, packed.MOST_BYTES, old = 40_000, 1 << 30, packed.MOST_BYTES
    assert packed.parts_of(t) == 2
    packed.MOST_BYTES = 5_000
    assert packed.parts_of(t) == 10 and packed.parts_of(t.where("false")) == 1
    packed.MOST_BYTES = old


# --- 2 and 6 ---------------------------------------------------------------------------------------------------------


def test_token_counts(docs, empty, rows):
    t = Tokenizer.from_file(BPE)
    want = {i: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in rows}
    got = token_counts.token_counts(docs.withColumn("n_tokens", F.lit("clash")), BPE).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want and all(r.over_limit == (r.n_tokens > 1024) for r in got) and got[0].lang == "en"
    assert token_counts.token_counts(empty, BPE).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_units_join_to_the_librarys_ids(name):
    path = public_tokenizers.path(name)
    if name.endswith("model"):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids_of = m.encode
    else:
        t = Tokenizer.from_file(path)
        ids_of = lambda x: t.encode(x, add_special_tokens=False).ids
    rng = random.Random(3)
    bits = ["a", "don't", "we'll", "  ", "\n", " \n", "\t", " ", "　", "é", "日本", "1", "23", ".", "...", "'s", "'S", "<|endoftext|>", "<|", "\x1c", "\x85", "word", "***", "-", "à", " è", "à  b", "\r\n", "a" * 90, "½", "٣", " "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(1500)]
    u, at = token_counts.units(path), 0
    for _, _, data, offsets in text.blocks(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])):
        start, end = u.borders(data, offsets)
        slot = u.look_up(data, start, end)
        ids = u.ids(slot)
        total = np.concatenate([[0], np.cumsum(u.n[slot])])[np.searchsorted(start, offsets)]
        for k in range(len(offsets) - 1):
            assert ids[total[k] : total[k + 1]].tolist() == list(ids_of(texts[at])), texts[at]
            at += 1


def test_every_stored_prefix_is_exact(docs, rows):
    t = Tokenizer.from_file(BPE)
    texts = {r[0]: r[1] or "" for r in rows[:20]}
    table = token_counts.prefix_table(docs.where(F.col("doc_id").isin(list(texts))), BPE)
    for r in table.collect():
        for end, n in zip(r.ends, r.counts, strict=True):
            assert len(t.encode(texts[r.doc_id][:end], add_special_tokens=False).ids) == n
    cut = table.withColumn("cut", token_counts.cut_at(20)).withColumn("at", F.lit(10**9)).withColumn("all", token_counts.count_at())
    for r in cut.collect():
        assert len(t.encode(texts[r.doc_id][: r.cut], add_special_tokens=False).ids) <= 20
        assert r.all == (r.counts[-1] if r.counts else 0)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_prefixes_at_every_character(spark, name):
    path = public_tokenizers.path(name)
    if name.endswith("model"):
        import sentencepiece

        ids_of = sentencepiece.SentencePieceProcessor(model_file=path).encode
    else:
        t = Tokenizer.from_file(path)
        ids_of = lambda x: t.encode(x, add_special_tokens=False).ids
    rng = random.Random(8)
    bits = ["a", "don't", "  ", " \n", "\t", " ", "\u3000", "é", "日本語", "1", "23", "...", "'s", "<|endoftext|>", "<|", "word", "***", " è", "\u00a0", "\r\n", "tokenizer", "a" * 70, "½", "😀"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(60)] + ["日本語の文章には空白がない" * 4, "supercalifragilistic", "", None]
    table = token_counts.prefix_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path)
    want = {k: [len(ids_of((x or "")[:i])) for i in range(len(x or "") + 1)] for k, x in enumerate(texts)}
    every = table.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("ends")))).withColumn("n", token_counts.count_at())
    got = {(r.doc_id, r["at"]): r.n for r in every.select("doc_id", "at", "n").collect()}
    assert got == {(k, i): n for k, w in want.items() for i, n in enumerate(w)}
    budgets = (0, 1, 2, 3, 5, 8, 13, 40, 10**6)
    for r in table.select("doc_id", *[token_counts.cut_at(b).alias(f"b{b}") for b in budgets]).collect():
        for b in budgets:
            assert r[f"b{b}"] == max((i for i, n in enumerate(want[r.doc_id]) if n <= b), default=0)


def test_token_memory_is_bounded(monkeypatch):
    u = token_counts.Units(BPE, limit=50)
    texts = [f"word{i} other{i % 7} text" for i in range(200)]
    for k in range(0, 200, 10):
        _, _, data, offsets = next(text.blocks(pa.RecordBatch.from_arrays([pa.array(texts[k : k + 10])], names=["text"])))
        u.look_up(data, *u.borders(data, offsets))
        assert len(u.keys) <= 60


def test_token_files(spark, docs, empty, rows):
    t = Tokenizer.from_file(BPE)
    manifest = token_output.write_token_shards(docs.unionAll(docs.where("doc_id = 9")), BPE)
    ids = sorted([(i, t.encode(x or "", add_special_tokens=False).ids + [0]) for i, x, *_ in [*rows, *[r for r in rows if r[0] == 9]]])
    want, at = [], 0
    for i, x in ids:
        want.append((i, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert sorted(map(tuple, token_output.token_digest(manifest).collect())) == want
    assert token_output.token_digest(token_output.write_token_shards(empty, BPE)).count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_and_index(tmp_path, kind):
    rng = np.random.default_rng(1)
    docs_ = [(k, rng.integers(0, 1 << 32 if k % 2 else 50_000, n, dtype=np.uint64).astype("<u4")) for k, n in enumerate([0, 1, 700, 3000, 5, 0, 1024])]
    fs = pa.fs.LocalFileSystem() if hasattr(pa, "fs") else __import__("pyarrow.fs", fromlist=["x"]).LocalFileSystem()
    with fs.open_output_stream(str(tmp_path / "s")) as out:
        w = token_output.ShardWriter(out, kind, block_ids=512)
        for k, ids in docs_:
            w.add(k, ids.tobytes())
        assert w.close() == 4730
    with fs.open_input_file(str(tmp_path / "s")) as f:
        r = token_output.ShardReader(f)
        whole = np.concatenate([x for _, x in docs_])
        for a, n in ((0, 4730), (511, 2), (700, 1500), (4729, 1), (10, 0)):
            assert (r.ids(a, n) == whole[a : a + n]).all()
        assert r.index["counts"] == [len(x) for _, x in docs_]


# --- 3 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("budget", [None, 20_000, 60_000])
def test_mixing(docs, rows, budget):
    plan = mixing.mixture(docs, BPE, entropy=0.99, repeats=50, budget=budget)
    t = Tokenizer.from_file(BPE)
    tokens = {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x, *_ in rows}
    by = collections.defaultdict(int)
    for i, _, _, s, _ in rows:
        by[s] += tokens[i]
    p = {None if r.src == "null" else r.src[1:]: r for r in plan.collect()}
    assert {s: r.n_tokens for s, r in p.items()} == dict(by)
    w = [r.weight for r in p.values()]
    assert math.isclose(sum(w), 1) and -sum(x * math.log2(x) for x in w if x) >= 0.99 * math.log2(len(w)) - 1e-9
    assert len({round(math.log(r.weight / p["s2"].weight) / math.log(r.share / p["s2"].share), 6) for s, r in p.items() if s != "s2"}) == 1
    mixed = mixing.mix(docs, plan).collect()
    got, used = collections.Counter(), collections.defaultdict(int)
    for r in mixed:
        got[r.doc_id] += 1
        used[r.source] += tokens[r.doc_id]
    largest = max(tokens.values())
    for s, r in p.items():
        assert r.target <= used[s] <= r.target + largest, s
    if budget is None:
        assert set(got) == {r[0] for r in rows}
    for s in p:
        n = [got[r[0]] for r in rows if r[3] == s]
        assert max(n) - min(n) <= 1


def test_mixing_holds_the_repetition_limit(docs):
    total = mixing.mixture(docs, BPE, entropy=1.0, repeats=1.5)
    r = total.agg(F.max(F.col("target") / F.col("n_tokens")), F.max("exponent")).first()
    assert r[0] <= 1.51 and 0 < r[1] <= 1


def test_mixing_of_nothing(empty):
    plan = mixing.mixture(empty, BPE)
    assert plan.count() == 0 and mixing.mix(empty, plan).count() == 0


# --- 4 ---------------------------------------------------------------------------------------------------------------


def test_fixity(spark):
    pages = [(i, f"http://x/{i}", "<p>" + "y" * (i % 50)) for i in range(700)] + [(5, "http://x/5", "again"), (5, "http://x/5", "again"), (None, None, None), (9000, "u", None)]
    other = [p for p in pages if p[0] != 17]
    other[3] = (3, "http://x/3", "<q>" + "y" * 3)
    other[4] = (4, "http://x/changed", "<p>" + "y" * 4)
    other = [*other[::-1], (701, "http://x/701", "new")]
    other.remove((5, "http://x/5", "again"))
    a, b = (spark.createDataFrame(x, "page_id long, url string, html string") for x in (pages, other))
    assert {r.slot: r.status for r in warc_fixity.audit(a, b).collect()} == {3: "changed", 4: "changed", 5: "changed", 17: "missing", 701: "extra"}
    assert warc_fixity.audit(a, a.repartition(3)).count() == 0
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_fixity.audit(none, none).count() == 0 and warc_fixity.audit(none, a).count() == 702


# --- 5 ---------------------------------------------------------------------------------------------------------------


def vectors(spark, kind):
    rng = np.random.default_rng(4)
    if kind == "clusters":
        centres = rng.standard_normal((12, 16)) * 4
        v = centres[rng.integers(0, 12, 600)] + rng.standard_normal((600, 16)) * 0.3
    else:
        v = rng.standard_normal((600, 16))
    rows = [(i, v[i].astype(np.float32).tolist()) for i in range(600)]
    rows += [(600 + i, rows[7][1]) for i in range(60)] + [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [1.0, None] * 8), (3, rows[3][1]), (None, rows[4][1])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("kind", ["clusters", "noise"])
def test_neighbours(spark, kind, monkeypatch):
    monkeypatch.setattr(hilbert_ann, "BLOCK_ROWS", 64)
    rows, df = vectors(spark, kind)
    got = collections.defaultdict(list)
    for r in hilbert_ann.nearest(df, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    use = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)}
    hit = total = 0
    for q in [i for i in use if i % 50 == 0]:
        score = {i: float(v @ use[q] / np.linalg.norm(v) / np.linalg.norm(use[q])) for i, v in use.items() if i != q}
        best = sorted(score, key=lambda i: (-round(score[i], 12), i))[:5]
        assert len(got[q]) == 5 and all(abs(s - score[i]) < 1e-12 for i, s in got[q])
        hit, total = hit + len({i for i, _ in got[q]} & set(best)), total + 5
        if q == 600:
            assert [i for i, _ in got[q]] == [7, 601, 602, 603, 604]
    assert hit / total >= 0.9


def test_ties_of_parallel_vectors_go_to_the_smaller_ids(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal(16)
    rows = [(i, (v * 2.0 ** int(e)).tolist()) for i, e in enumerate(rng.permutation(30) - 15)] + [(100 + i, rng.standard_normal(16).tolist()) for i in range(20)]
    got = collections.defaultdict(list)
    for r in hilbert_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") < 30, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == {q: [i for i in range(6) if i != q][:5] for q in range(30)}


def test_hilbert_curve_visits_neighbours():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    key = hilbert_ann.hilbert_keys(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    steps = np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_neighbours_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in hilbert_ann.nearest(few, F.col("vec_id") == 0, 5).collect()] == [(0, 1, 1)]
    assert hilbert_ann.nearest(few.where("vec_id > 9"), F.col("vec_id") == 0, 5).count() == 0


# --- 7 ---------------------------------------------------------------------------------------------------------------


def test_language_model(docs, rows, empty):
    train = docs.where(~kneser_ney.held_out())
    model = kneser_ney.train(train)
    got = {r.doc_id: r for r in kneser_ney.score(docs, model).withColumn("held_out", kneser_ney.held_out()).collect()}
    count, pair = collections.Counter(), collections.Counter()
    for i, t, *_ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
        if not got[i].held_out:
            s = [None, *words_of(t), 0]
            count.update(s[1:])
            pair.update(zip(s[:-1], s[1:], strict=True))
    n, v = sum(count.values()), len(count)
    after, different, ctx = collections.defaultdict(collections.Counter), collections.Counter(w for _, w in pair), collections.Counter()
    for (a, _), c in pair.items():
        after[a][min(c, 3)] += 1
        ctx[a] += c
    of = lambda values: [sum(x == k for x in values) for k in (1, 2, 3, 4)]
    d2, d1 = [0, *kneser_ney.discounts(*of(pair.values()))], [0, *kneser_ney.discounts(*of(different.values()))]
    types = len(pair)
    b_low = sum(d1[min(x, 3)] for x in different.values()) / types
    low_p = lambda w: b_low / (v + 1) + (different[w] - d1[min(different[w], 3)] if w in different else 0) / types

    def p(a, w):
        if not ctx[a]:
            return low_p(w)
        c = pair[a, w]
        return (c - d2[min(c, 3)]) / ctx[a] + sum(d2[k] * m for k, m in after[a].items()) / ctx[a] * low_p(w)

    assert math.isclose(sum(p("the".encode(), w) for w in count) + p("the".encode(), "unseen"), 1)
    for i, t, *_ in rows:
        s = [None, *words_of(t), 0]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(s) - 1, sum(count[w] > 0 for w in s[1:]), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in s[1:]), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(a, w)) for a, w in zip(s[:-1], s[1:], strict=True)), rel_tol=1e-9)
    nothing = kneser_ney.train(empty)
    assert kneser_ney.score(docs, nothing).where("n_known = 0 and score <= 0").count() == len(rows)


@pytest.mark.parametrize("order", [3, 4])
def test_language_model_of_higher_order(docs, rows, order, monkeypatch):
    monkeypatch.setattr(kneser_ney, "CHUNK_TOKENS", 500)
    model = kneser_ney.train(docs.where(~kneser_ney.held_out()), order=order)
    got = {r.doc_id: r for r in kneser_ney.score(docs, model).collect()}
    count, a = collections.Counter(), {m: collections.Counter() for m in range(1, order + 1)}
    of_text = lambda t: [None, *words_of(t), 0]
    for i, t, *_ in rows:
        s = of_text(t)
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(s[1:])
            for m in range(2, order + 1):
                a[m].update(tuple(s[k : k + m]) for k in range(len(s) - m + 1) if m == order or k == 0)
    for m in range(order, 1, -1):
        a[m - 1].update(g[1:] for g in a[m])
    d = {m: [0, *kneser_ney.discounts(*[sum(x == k for x in a[m].values()) for k in (1, 2, 3, 4)])] for m in a}
    after = collections.defaultdict(list)
    for m in a:
        for g, c in a[m].items():
            after[g[:-1]].append(c)

    def p(h, w):
        m = len(h) + 1
        low = p(h[1:], w) if h else 1 / (len(count) + 1)
        if not after[h]:
            return low
        c, held = a[m][(*h, w)], sum(d[m][min(x, 3)] for x in after[h])
        return (c - d[m][min(c, 3)]) / sum(after[h]) + held / sum(after[h]) * low

    some = next(g for g in a[order] if len(after[g[:-1]]) > 1 and None not in g)[:-1]
    assert math.isclose(sum(p(some, w) for w in count) + p(some, "unseen"), 1)
    for i, t, *_ in rows:
        s = of_text(t)
        assert got[i].n_known == sum(count[w] > 0 for w in s[1:]) and got[i].train_tokens == sum(count.values())
        assert math.isclose(got[i].score, sum(math.log10(p(tuple(s[max(0, k - order + 1) : k]), s[k])) for k in range(1, len(s))), rel_tol=1e-9)


# --- 8 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("set_words", [1_000_000, 20])
def test_decontamination(spark, docs, rows, set_words):
    long = [r for r in rows if r[1] and len(words_of(r[1], ALNUM)) > 60]
    take = lambda t, a, z: " ".join(w.decode() for w in words_of(t, ALNUM)[a:z])
    items = [(1, take(long[0][1], 5, 40).upper()), (2, take(long[1][1], 3, 7)), (10, take(long[0][1], 20, 33)), (3, None), (4, ""), (5, "--- ,,"), (6, "never there at all"), (2, take(long[2][1], 0, 13))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    grams = collections.defaultdict(set)
    for i, t in items:
        w = words_of(t, ALNUM)
        k = min(13, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            grams[tuple(w[a : a + k])].add(str(i))
    got = {r.doc_id: r for r in decontaminate.contamination(docs.withColumn("spans", F.lit(1)), bench, set_words=set_words).withColumn("h", decontaminate.items_digest()).collect()}
    cut = {r.doc_id: r.text for r in decontaminate.cut_spans(docs, bench, set_words=set_words).collect()}
    for i, t, *_ in rows:
        w = words_of(t, ALNUM)
        hit, ids = set(), set()
        for k in {len(g) for g in grams}:
            for a in range(len(w) - k + 1):
                if s := grams.get(tuple(w[a : a + k])):
                    hit.update(range(a, a + k))
                    ids |= s
        r = got[i]
        assert (r.n_words, r.n_hit, r.items, r.contaminated) == (len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w))
        assert r.h == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        assert words_of(cut[i], ALNUM) == [x for k, x in enumerate(w) if k not in hit] if r.spans else cut[i] == t
    left = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench, set_words=set_words).collect()}
    assert left == {i for i, r in got.items() if not r.contaminated}


def test_decontamination_holds_one_set_at_a_time(spark, monkeypatch):
    from pyspark import SparkContext
    from pyspark.core.broadcast import Broadcast

    made, gone = [], []
    broadcast, destroy = SparkContext.broadcast, Broadcast.destroy

    def make(self, value):
        assert len(made) == len(gone)
        made.append(broadcast(self, value))
        return made[-1]

    monkeypatch.setattr(SparkContext, "broadcast", make)
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: (gone.append(self), destroy(self, *a)))
    bench = spark.createDataFrame([(i, f"item{i} says some words of its own") for i in range(6)], "item_id long, text string")
    d = spark.createDataFrame([(0, "x item1 says some words of its own and item4 says some words of its own")], "doc_id long, text string")
    r = decontaminate.contamination(d, bench, set_words=40).first()
    assert len(made) > 1 and len(gone) == len(made) - 1 and (r.n_hit, r["items"]) == (14, ["1", "4"])


def test_decontamination_against_nothing(docs, empty, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).where("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.contamination(empty, none).count() == 0


# --- 9 ---------------------------------------------------------------------------------------------------------------


def toxic_corpus(n=600, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randrange(30, 200))]
        toxic = i % 6 == 0
        for _ in range(rng.randrange(1, 9) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["Vilest!", "scumbag", "vermin,"]))
        rows.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame([*rows, (9001, None), (9002, ""), (9003, "w1 " * 20000)], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, lab)
    assert (np.diff(model.cuts) > 0).all() and len(model.keys) <= toxicity.MOST_FEATURES
    got = {r.doc_id: r for r in toxicity.severity(docs.withColumn("grade", F.lit("x")), model).collect()}
    wrong = [i for i, _ in rows if got[i].rejected != (i % 6 == 0)]
    assert len(wrong) <= 6 and not any(got[i].rejected for i in (9001, 9002, 9003))
    heavy, light = ([i for i, t in rows if i % 6 == 0 and (len(re.findall("(?i)vilest|scumbag|vermin", t)) >= 7) == x] for x in (True, False))
    assert np.mean([got[i].severity for i in heavy]) > np.mean([got[i].severity for i in light]) > 1
    assert toxicity.drop_toxic(docs, model).columns == docs.columns


def test_toxicity_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.severity(docs, toxicity.fit(docs, none)).where("rejected").count() == 0
    assert toxicity.severity(empty, toxicity.fit(empty, none)).count() == 0


def test_ordinal_slopes():
    """Fitted thresholds and one shared weight recover the odds that the grades were drawn with."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=8000)
    p = 1 / (1 + np.exp(np.array([0.0, 1.0, 2.5])[None, :] - 1.5 * x[:, None]))
    grade = (rng.random(8000)[:, None] < p).sum(axis=1)
    w, cuts = toxicity.fit_ordinal(np.arange(8000), np.zeros(8000, int), x, grade, 1)
    assert abs(w[0] - 1.5) < 0.12 and np.allclose(cuts, [0, 1, 2.5], atol=0.15)


# --- 10 --------------------------------------------------------------------------------------------------------------


def groups(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, size, percent):
    got = near_dedup.near_duplicates(docs, size, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == groups([r[:2] for r in rows], size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("edits", [6, 12])
def test_near_duplicates_around_the_threshold(spark, monkeypatch, edits):
    """Copies of copies whose similarities lie about the threshold, in blocks of a few rows."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 16)
    rng = random.Random(edits)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows, pool = [], [base]
    for i in range(90):
        w = list(rng.choice(pool[-6:] if edits == 6 else pool[:3]))
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        pool.append(w)
        rows.append((i, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == groups(rows, 3, 85)


def test_near_duplicates_edges(spark, empty):
    rows = [(None, "a b c d"), (5, "a b c d"), (2, "A  b\tc d"), (2, "A  b\tc d"), (7, None), (8, ""), (9, " \n"), (1, "one"), (0, "ONE")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()), key=str)
    assert got == sorted([(None, None, True), (5, 2, False), (2, 2, True), (2, 2, True), (7, 7, True), (8, 8, True), (9, 9, True), (1, 0, False), (0, 0, True)], key=str)
    assert near_dedup.near_duplicates(empty, 3, 85).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    assert got == {x: root(x) for x in up}


# --- pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    from handspan.llm.shared import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_output"]
    for n, stage in corpus_pipeline.STAGES[:-1]:
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stored(stage(spark, docs, sf_dir), n)
        after = docs.collect()
        assert docs.columns == names and all(before[r.doc_id] == r.text for r in after)
        got = {r.doc_id for r in after}
        if n == "near_dedup":
            assert got == {i for i, (_, c) in groups([(i, before[i]) for i in ids], 5, 80).items() if c == i}
        assert got == ids if n == "mixing" else got <= ids
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len(out) == docs.count() and max(r.start + r.n_tokens for r in out) == sum(r.n_tokens for r in out)


def test_registered():
    from handspan.llm.queries import QUERIES

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and json.dumps(sorted(QUERIES))
