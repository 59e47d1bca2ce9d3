"""Word hashes, fill-in-middle, hard negatives and MinHash near duplicates on small inputs."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest
import test_documents as documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyline.llm.fill_middle import CODE_POINT, cut, fill_in_middle, restored
from tallyline.llm.hard_negatives import Slices, hard_negatives, scores
from tallyline.llm.hashing import WordHasher
from tallyline.llm.lm_scoring import lm_scores
from tallyline.llm.minhash_dedup import OddSketcher, Sets, follow, minhash_dedup, odd_bits
from tallyline.llm.ngram_join import ngram_join
from tallyline.llm.vector_topk import top_k


def _thue_morse(bits: int) -> tuple[str, str]:
    """Words of 2**bits letters on which every polynomial modulo 2**64 with an odd base agrees, from bits = 10 on."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << bits))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_fool_polynomials(spark):
    rows = [(10 * bits + side, w) for bits in range(9, 15) for side, w in enumerate(_thue_morse(bits))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join(docs).collect()
    assert all(r.component_id == r.doc_id and r.n_links == 0 and r.n_shingles == 1 for r in got) and len(got) == len(rows)
    scored = lm_scores(docs, F.col("doc_id") % 2 == 0).collect()
    # Words of odd ids aren't among the even ids' words: only the end of the text is known.
    assert {(r.doc_id % 2, r.n_known) for r in scored} == {(0, 2), (1, 1)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text("abcABé\0", min_size=1, max_size=20), max_size=6), max_size=5))
def test_word_hashes_are_of_the_words_alone(texts):
    chunks = list(WordHasher().chunks(pa.array([" \t".join(t) + " " for t in texts] + ["", None], pa.string())))
    hashes = [int(h) for words, _ in chunks for h in words]
    words = [w.translate(str.maketrans("AB", "ab")) for t in texts for w in t]
    seen = dict(zip(words, hashes, strict=True))
    assert [seen[w] for w in words] == hashes and len(set(seen.values())) == len(seen)


def _fim(doc_id, text):
    """By slices of the list of units."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = list(text)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return (doc_id, len(units), "plain", None, None, text)
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if h4 % 100 < 20:
        return (doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark):
    texts = [None, "", "a", "\n", "<P", "P>", "<P>", "x<S>y", "<M>", "\U0001f600é\0x\r\n", "<" * 7, "ab " * 9, "<S" * 5 + ">"]
    rows = [(i, texts[i % len(texts)], 5, "form") for i in range(260)] + [(3, "a", 1, ""), (3, "a", 1, ""), (None, "null id", 1, ""), (None, None, 1, ""), (-4, "minus", 1, ""), (2**62, "y" * 3_000_000 + "z", 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, form string").repartition(3)
    made = fill_in_middle(docs)
    got = made.select("*", restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((_fim(r[0], r[1]) for r in rows), key=repr)
    assert sorted((r.doc_id, r.back) for r in got if r.doc_id is not None) == sorted((r[0], r[1] or "") for r in rows if r[0] is not None)
    assert {r.form for r in got} == {"plain", "psm", "spm"} and fill_in_middle(docs.limit(0)).count() == 0
    words = fill_in_middle(docs, unit=r"\S+", fim_rate=100, spm_rate=50)
    assert sorted((r.doc_id, r.back) for r in words.where("doc_id is not null").select("doc_id", restored(F.col("output"), F.col("form")).alias("back")).collect()) == sorted((r[0], r[1] or "") for r in rows if r[0] is not None)


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n\U0001f600", max_size=12), st.sampled_from([CODE_POINT, r"\S+", "a", "zz"]), st.randoms())
def test_cuts_lie_behind_units(text, pattern, rng):
    ends = [0, *(m.end() for m in re.finditer(pattern, text))]
    n = len(ends) - 1
    ends[n] = len(text)
    low, high = sorted(rng.randint(0, n) for _ in range(2))
    assert cut(text, n, low, high, re.compile(pattern)) == (ends[low], ends[high])


LONG = 2**63


def _vectors(rows):
    """Place, id, label and whole components of the rows that take part."""
    fine = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    return [(i, r[0], r[2], [math.floor(256 * x) for x in r[1]]) for i, r in enumerate(rows) if r[2] is not None and fine(r[1])]


def _ranked(v, others):
    """(score, id, place) of others, best first."""
    product = lambda w: min(LONG - 1, max(-LONG, sum(x * y for x, y in zip(v, w))))
    return sorted(((product(w), b, j) for j, b, _, w in others if len(w) == len(v)), key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))


def _mined(rows, positives, negatives):
    fine, out = _vectors(rows), []
    for i, a, label, v in fine:
        if a is None or a % 5:
            continue
        for p, b, _ in _ranked(v, [x for x in fine if x[0] != i and x[2] == label])[:positives]:
            found = [x for x in _ranked(v, [x for x in fine if x[2] != label]) if 30 * p <= 100 * x[0] <= 90 * p]
            out += [(a, b, n + 1, c, p, s) for n, (s, c, _) in enumerate(found[:negatives])]
    return sorted(out, key=str)


def _vector_rows(rng, n, dim, spread):
    centres = rng.normal(size=(4, dim))
    rows = [(i, [float(x) for x in centres[i % 4] * (1 + i % 3) + rng.normal(scale=spread, size=dim)], int(rng.choice([0, 0, 0, 1, 2]))) for i in range(n)]
    rows += [(10, rows[10][1], 0), (10, rows[10][1], 1), (None, rows[10][1], 1), (None, rows[10][1], 0), (500, None, 1), (505, [1.0, None, *[0.0] * (dim - 2)], 1), (510, [float("nan")] * dim, 0), (515, [float("-inf")] * dim, 0)]
    return [*rows, (520, rows[0][1], None), (525, [1.0, 2.0], 3), (530, [2.0, 1.0], 4), (531, [2.0, 2.0], 3), (535, [], 1), (540, [], 2), (545, [0.0] * dim, 1), (550, [-x for x in rows[0][1]], 0)]


@pytest.mark.parametrize(("block", "spread"), [(7, 0.05), (2048, 0.9)])
def test_hard_negatives(spark, monkeypatch, block, spread):
    monkeypatch.setattr("tallyline.llm.hard_negatives.INDEX_BLOCK", block)
    monkeypatch.setattr("tallyline.llm.hard_negatives.ANCHOR_BLOCK", 4)
    monkeypatch.setattr("tallyline.llm.hard_negatives.ANCHORS_OF_COPY", 3)
    rows = _vector_rows(np.random.default_rng(block), 150, 6, spread)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, v string, place int").coalesce(1)
    for positives, negatives in ((5, 10), (2, 1)):
        got = [tuple(r) for r in hard_negatives(table, F.col("vec_id") % 5 == 0, F.col("label"), positives, negatives).collect()]
        assert sorted(got, key=str) == _mined(rows, positives, negatives) and got
    assert hard_negatives(table.limit(0), F.lit(True), F.col("label")).count() == 0


def _huge(rng):
    rows = [(i, [float(x) for x in rng.normal(size=3) * 10.0 ** (i % 5 * 6)], i % 3) for i in range(40)]
    return [*rows, (40, [-1e20, 1.0, 0.0], 0), (41, [1e300, 0.0, 1.0], 1), (45, [0.0, 1.0, 2.0], 0), (46, [0.0, 1.5, 2.0], 0), (47, [0.0, 0.5, 1.0], 1), (48, [float(np.finfo(float).max)] * 3, 1)]


def test_components_of_any_finite_size(spark):
    rows = _huge(np.random.default_rng(2))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1)
    kept = [r for r in rows if all(math.isfinite(256 * x) for x in r[1])]
    assert len(kept) == len(rows) - 1
    got = sorted((tuple(r) for r in hard_negatives(table, F.col("vec_id") % 5 == 0, F.col("label")).collect()), key=str)
    assert got == _mined(kept, 5, 10) and got
    fine = _vectors([(*r[:2], 0) for r in kept])
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(table, F.col("vec_id") % 5 == 0).collect())
    assert found == sorted((a, n + 1, b, s) for i, a, _, v in fine if a % 5 == 0 for n, (s, b, _) in enumerate(_ranked(v, [x for x in fine if x[0] != i])[:5]))


def test_planes_drop_no_row_of_a_band():
    rng = np.random.default_rng(9)
    for size in (3, 40, 3000):
        x, q = np.floor(rng.normal(size=(90, 8)) * size), np.floor(rng.normal(size=(5, 8)) * size)
        exact = (q @ x.T).astype(np.int64)
        low = np.sort(rng.choice(exact.ravel(), (5, 3)).astype(float), 1)
        high = low + rng.integers(-1, 20 * size * size, (5, 3))
        low[0, 0], high[0, 0] = -np.inf, np.inf
        allowed = rng.random(exact.shape) < 0.8
        for k in (1, 4):
            got, alive = scores(q, Slices.of(x), allowed, low, high, k)
            assert (got[alive] == exact[alive]).all() and not (alive & ~allowed).any()
            for i, j in np.ndindex(low.shape):
                inside = np.flatnonzero(allowed[i] & (exact[i] >= low[i, j]) & (exact[i] <= high[i, j]))
                best = np.sort(exact[i, inside])[::-1][:k]
                assert (len(best) == 0 or alive[i, inside[exact[i, inside] >= best[-1]]].all())
            assert size == 3 or alive.sum() < allowed.sum() / 2


def _components(rows, width, p, q):
    return sorted(((r[0], n, c) for r, (_, n, c, _) in zip(rows, documents._joined(rows, width, p, q), strict=True)), key=str)


def _without_hot_keys(monkeypatch, **sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(f"tallyline.llm.minhash_dedup.{name}", value)


def _near_rows():
    """Copies that shade off into one another, so that components are chains of links."""
    rng = np.random.default_rng(6)
    words, rows = [f"w{i}" for i in range(400)], []
    for group in range(4):
        now = list(rng.choice(words, 40 + 60 * group))
        for i in range(40):
            rows.append((1000 * group + 7 * i % 1000, " ".join(now)))
            for at in rng.choice(len(now), int(rng.integers(1, 4)) * (1 + group), replace=False):
                now[at] = str(rng.choice(words))
    return rows


@pytest.mark.parametrize(
    ("width", "p", "q", "sizes"),
    [(4, 4, 5, {}), (5, 4, 5, {"FLUSH": 100, "LOCAL_BUCKET": 2, "BUCKET": 3}), (4, 4, 5, {"CHUNK_WEIGHT": 900}), (4, 9, 10, {"CHUNK_SETS": 5, "LOCAL_BUCKET": 1, "GROUP": 50})],
)
def test_minhash_dedup(spark, monkeypatch, width, p, q, sizes):
    _without_hot_keys(monkeypatch, **sizes)
    odd = documents._rows()
    docs = spark.createDataFrame(odd, documents.SCHEMA).repartition(5)
    got = minhash_dedup(docs, width, p, q).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == _components(odd, width, p, q)
    kept = [(r.component_id, r.doc_id) for r in got if r.kept and r.n_shingles]
    assert len(set(kept)) == len(kept) and all(a == b for a, b in kept) and all(r.kept for r in got if not r.n_shingles)
    near = _near_rows()
    chains = minhash_dedup(spark.createDataFrame(near, "doc_id long, text string").repartition(6), width, p, q).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in chains), key=str) == _components(near, width, p, q)
    assert minhash_dedup(docs.limit(0), width, p, q).count() == 0


def test_odd_sketches_estimate_and_lose_no_pair():
    rng, sketcher = np.random.default_rng(1), OddSketcher(4, 5)
    for size in (10, 50, 1000):
        sets = []
        for _ in range(250):
            whole = rng.integers(0, 2**64 - 1, size, dtype=np.uint64, endpoint=True)
            sets += [np.unique(whole[size // 10 :]), np.unique(whole[: -size // 10])]
        bands, sketches = sketcher.of(sets)
        words = sketches.view(np.uint64)
        true = np.array([len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a, b in zip(sets[::2], sets[1::2])])
        assert (true == 0.8).all()
        odd = odd_bits(words[::2], words[1::2])
        assert (bands[::2] == bands[1::2]).any(1).all() and (odd <= sketcher.most).all()
        assert abs((sketcher.similarity(odd) - true).mean()) < 0.02 and (sketcher.similarity(odd) - true).std() < 0.06
        strangers = odd_bits(words[:-2:2], words[2::2])
        assert (strangers > sketcher.most).all()


def test_follow_against_all_pairs():
    rng, sketcher = np.random.default_rng(4), OddSketcher(4, 5)
    base = rng.integers(0, 2**63, (6, 40), dtype=np.uint64)
    sets = list({s.tobytes(): s for s in (np.unique(np.where(rng.random(40) < rng.choice([0.02, 0.1]), rng.integers(0, 2**63, 40, dtype=np.uint64), base[i % 6])) for i in range(120))}.values())
    rows = [{"key": s.tobytes(), "shingles": s.tobytes(), "sketch": x.tobytes()} for s, x in zip(sets, sketcher.of(sets)[1], strict=True)]
    near = [[j for j in range(len(sets)) if 5 * (o := len(np.intersect1d(sets[i], sets[j]))) >= 4 * (len(sets[i]) + len(sets[j]) - o)] for i in range(len(sets))]

    def reached(edges, label):
        label = list(label)
        for a, b in edges:
            label = [label[a] if x == label[b] else x for x in label]
        return {frozenset(i for i in range(len(label)) if label[i] == x) for x in label}

    n = len(sets)
    every = [(i, j) for i in range(n) for j in near[i]]
    edges = list(follow(Sets(rows, sketcher), np.arange(n), np.arange(n)))
    assert reached(edges, range(n)) == reached(every, range(n)) and len(edges) < n and set(edges) <= set(every)
    sources, label = np.arange(0, n, 3), np.arange(n) // 4
    some = [(i, j) for i, j in every if i % 3 == 0 or j % 3 == 0]
    assert reached(follow(Sets(rows, sketcher), sources, label), label) == reached(some, label)
