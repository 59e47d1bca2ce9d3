"""Exact deduplication, the n-gram join, mixing, packing, quality and language-model scores on small documents."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm.common import FILE_CLEANUP, doc_crc, mark, materialize, release
from tallyline.llm.exact_dedup import exact_dedup, exact_dedup_stage, merge_runs, digests
from tallyline.llm.lm_scoring import DISCOUNT, lm_scores
from tallyline.llm.mixing import mix, mixing_stage, source_targets
from tallyline.llm.ngram_join import divide_skip, ngram_join, ngram_join_stage
from tallyline.llm.packing import QUANTUM, WINDOW, RoundRobin, Piece, Tokenizer, VOCABULARY, pack
from tallyline.llm.quality import METADATA, THRESHOLD, Machine, fit_quality, quality_stage, score_quality

SCHEMA = "doc_id long, text string, source string, n_chars long, row_id long, key string, score string, size string, part int, copies string"
WORDS = "the of and on in re is to a an er th ea nd".split() + [f"w{i}" for i in range(60)]


def _text(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _rows() -> list[tuple]:
    rng = random.Random(5)
    base = [_text(rng, n) for n in (400, 200, 60, 12)]
    near = [" ".join(w if rng.random() > 0.01 else f"x{rng.randrange(9)}" for w in base[0].split(" ")) for _ in range(25)]
    texts = [None, "", "  \n\t ", "one", "One two", "one  two", *base, base[1] + " ", " ".join(base[1]), base[2].upper(), *near, *near[:3], "a b c", "A\x0bb\x0cc", "ünï cödé 漢字 \U0001f600 x", _text(rng, 3000), "<|endoftext|> x", "x" * 3000]
    rows = [(i, t, None if i % 9 == 8 else f"s{i % 3}", None if i % 7 == 3 else len(t or ""), 7, "k", "s", "z", 1, "c") for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[7], (None, base[0], "s0", 1, 7, "k", "s", "z", 1, "c"), (None, "only here", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def _same(a, b):
    assert sorted(a, key=repr) == sorted(b, key=repr)


def test_exact_dedup(docs, rows, nothing):
    got = exact_dedup(docs, fan_in=2).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    expected = []
    for text, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        sha = hashlib.sha256(text.encode()).hexdigest()
        expected += [(r[0], best[0], len(members), sha) for r in members]
        mine = [r for r in got if r.text_sha256 == sha]
        assert [r.kept for r in mine].count(True) == 1
        assert next(r for r in mine if r.kept).doc_id == best[0]
    _same([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], expected)
    assert exact_dedup(nothing).count() == 0


def test_exact_dedup_does_not_depend_on_the_rounds(docs):
    each = [sorted(map(str, merge_runs(digests(docs.repartition(n)), fan_in).select("digest", "keep.doc_id", "group_size").collect())) for n, fan_in in ((1, 8), (7, 2), (9, 3))]
    assert each[0] == each[1] == each[2]


def test_exact_dedup_stage_keeps_columns(docs, spark, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    out = exact_dedup_stage(spark, stored, "")
    assert out.columns == docs.columns
    assert out.count() == exact_dedup(stored).where("kept").count()


@pytest.mark.parametrize("stage", [exact_dedup_stage, ngram_join_stage])
def test_stages_leave_texts_where_they_are(stage, docs, spark, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    out = stage(spark, spark.read.parquet(str(tmp_path / "d")), "")
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()


def test_what_was_shuffled_for_a_table_goes_with_its_writing(docs, spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {n for n in disk.getAllFiles().mkString("\n").split("\n") if n.endswith(".data")}
    before, setting = shuffled(), spark.conf.get(FILE_CLEANUP)
    materialize(docs.repartition(3, "text"), "shuffled")
    for _ in range(50):  # executors delete a moment later
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before and spark.conf.get(FILE_CLEANUP) == setting


def _sets(text: str | None, width: int) -> frozenset:
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < width else [tuple(words[i : i + width]) for i in range(len(words) - width + 1)])


def _joined(rows: list[tuple], width: int, p: int, q: int) -> list[tuple]:
    sets = [_sets(r[1], width) for r in rows]
    near = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            shared = len(a & sets[j])
            if a and sets[j] and q * shared >= p * (len(a) + len(sets[j]) - shared):
                near[i].add(j)
                near[j].add(i)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((r[0], len(sets[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None), len(near[i])))
    return out


@pytest.mark.parametrize(("width", "p", "q"), [(3, 9, 10), (5, 4, 5), (2, 1, 2)])
def test_ngram_join(docs, rows, nothing, width, p, q):
    got = [tuple(r) for r in ngram_join(docs, width, p, q).select("doc_id", "n_shingles", "component_id", "n_links").collect()]
    _same(got, _joined(rows, width, p, q))
    assert ngram_join(nothing, width, p, q).count() == 0


def test_ngram_join_cuts_large_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr("tallyline.llm.ngram_join.CHUNK_WEIGHT", 900)
    monkeypatch.setattr("tallyline.llm.ngram_join.FLUSH", 50)
    got = [tuple(r) for r in ngram_join(docs).select("doc_id", "n_shingles", "component_id", "n_links").collect()]
    _same(got, _joined(rows, 3, 9, 10))


def test_divide_skip_against_all_pairs():
    rng = np.random.default_rng(3)
    for p, q in ((9, 10), (4, 5), (1, 2)):
        base = rng.choice(5000, 120, replace=False)
        sets = [np.unique(np.where(rng.random(120) < rng.choice([0.01, 0.05, 0.2]), rng.integers(0, 9000, 120), base)).astype(np.uint64) for _ in range(150)]
        sets = sorted({s.tobytes(): s for s in sets}.values(), key=len)
        side = rng.integers(0, 2, len(sets))
        for sides in (None, side):
            got = {(i, int(j)) for i, found in divide_skip(sets, p, q, sides) for j in found}
            shared = lambda a, b: len(np.intersect1d(a, b))
            assert got == {
                (i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
                if q * (o := shared(sets[i], sets[j])) >= p * (len(sets[i]) + len(sets[j]) - o) and (sides is None or side[i] != side[j])
            }


def test_ngram_join_stage(docs, spark):
    out = ngram_join_stage(spark, docs, "")
    joined = ngram_join(docs, 5, 4, 5).where("doc_id is not null")
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect() if r.doc_id is not None} == {r.component_id for r in joined.collect()}


def test_ngram_join_stage_keeps_one_row_of_each_group(spark, tmp_path):
    rng = random.Random(8)
    a, b, c, d = (_text(rng, 200) for _ in range(4))
    near = lambda t, i: t + f" x{i}"
    rows = [
        (1, a, "a"), (2, near(a, 1), "a"), (2, b, "b"),  # id 2 is a near copy and a clean row
        (None, near(a, 2), "a"), (None, c, "c"), (None, near(c, 1), "c"), (None, near(c, 2), "c"),
        (5, d, "d"), (5, near(d, 1), "d"), (4, near(d, 2), "d"), (4, near(d, 2), "d"),
        (None, "", ""), (None, None, ""), (9, " ", ""),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3).write.parquet(str(tmp_path / "d"))
    out = ngram_join_stage(spark, spark.read.parquet(str(tmp_path / "d")), "")
    assert out.columns == ["doc_id", "text", "row"]
    _same([(r.doc_id, r.row) for r in out.collect()], [(1, "a"), (2, "b"), (None, "c"), (4, "d"), (None, ""), (None, ""), (9, "")])


def test_mixing(docs, rows, nothing):
    out = mix(docs).toPandas()
    assert len(out) == len(rows)
    assert (out["taken"] <= 2 * out["size"]).all() and (out["taken"] == out["copies"] * out["size"]).all()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(out["size"]) == sorted(words(r[1]) for r in rows)
    per = defaultdict(int)
    for r in rows:
        per[r[2]] += words(r[1])
    order = sorted(per, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(per.values()), set(order), {}
    while over := [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * per[s]]:
        for s in over:
            target[s] = 2.0 * per[s]
        open_ -= set(over)
        left = 1.5 * sum(per.values()) - sum(target.values())
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    for source, group in out.groupby("source", dropna=False):
        source = None if not isinstance(source, str) else source
        assert group["target"].iloc[0] == pytest.approx(target[source])
        assert abs(group["taken"].sum() - target[source]) <= group["size"].max()
    again = mix(docs.repartition(3)).toPandas()
    keys = lambda x: sorted(zip(x["doc_id"].fillna(-1), x["size"], x["taken"]))
    assert keys(out) == keys(again)
    assert mix(nothing).count() == 0
    assert mix(docs.where("doc_id in (0, 1, 2)")).agg(F.sum("taken")).first()[0] == 0


def test_mixing_is_near_the_target_and_unbiased(spark):
    rng = random.Random(1)
    many = spark.createDataFrame([(i, " ".join("w" * rng.choice([1, 3, 5]) for _ in range(rng.choice([5, 50, 300]))), f"s{i % 4}") for i in range(3000)], "doc_id long, text string, source string")
    out = mix(many)
    for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("size").alias("m")).collect():
        assert abs(r.t - r.g) <= 2 * r.m
    assert {r.copies for r in out.select("copies").distinct().collect()} <= {0, 1, 2}


def test_source_targets_share_alike(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 10), (None, 100), ("c", 0)], "source string, size long")
    got = {r.source: r.target for r in source_targets(sizes).collect()}
    assert got["a"] == 20 and got["b"] == 20 and got["c"] == 0 and got[None] == pytest.approx(140)


def test_source_targets_of_many_sources(spark):
    rng = random.Random(9)
    rows = [(f"s{i}" if i else None, rng.choice([0, 1, 7, 50, 900])) for i in range(300) for _ in range(2)]
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(rows, "source string, size long").repartition(6)).collect()}
    per = Counter()
    for s, n in rows:
        per[s] += n
    order = sorted(per, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(per.values())
    while over := [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * per[s]]:
        target |= {s: 2.0 * per[s] for s in over}
        open_ -= set(over)
        left = 1.5 * sum(per.values()) - sum(target.values())
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    assert got == pytest.approx(target)


def test_mixing_stage(docs, spark, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    out = mixing_stage(spark, stored, "")
    assert out.columns == docs.columns and out.count() == mix(stored).agg(F.sum("copies")).first()[0]


def test_tokenizer_is_the_reference(rows):
    t = Tokenizer(VOCABULARY)
    for r in rows:
        text = r[1] or ""
        assert t.ids(text).tolist() == t.plain.encode(text, add_special_tokens=False).ids
    assert t.ids(" " * 5000 + "x").tolist() == t.plain.encode(" " * 5000 + "x", add_special_tokens=False).ids


@pytest.mark.parametrize("weights", [None, {"s0": 3.0, "s1": 1.0}])
def test_packing_round_trip(docs, rows, nothing, weights):
    pieces = pack(docs, weights=weights).toPandas()
    t = Tokenizer(VOCABULARY)
    per_row = pieces.sort_values("start").groupby("row_id")
    assert len(per_row) == len(rows)
    found = []
    for _, g in per_row:
        assert (g["start"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() == g["doc_tokens"].iloc[0]
        found.append((g["doc_tokens"].iloc[0], tuple(zip(g["start"], g["length"], g["ids_crc32"]))))
    texts = Counter()
    for r in rows:
        ids = np.array([*t.ids(r[1] or "").tolist(), 0], dtype="<u4")
        texts[ids.tobytes()] += 1
    for tokens, cut in found:
        match = [k for k in texts if len(k) == 4 * tokens and texts[k] and all(zlib.crc32(k[4 * a : 4 * (a + n)]) == c for a, n, c in cut)]
        assert match
        texts[match[0]] -= 1
    assert not +texts
    lengths = []
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"] == s["length"].cumsum() - s["length"]).all()
        lengths.append(s["length"].sum())
    assert all(n == WINDOW or n & (n - 1) == 0 for n in lengths) and sum(n < WINDOW for n in lengths) <= 10
    assert pack(nothing).count() == 0


def test_round_robin_carries_deficits():
    robin = RoundRobin(100, {"a": 3.0, "b": 1.0}, 0)
    for i in range(200):
        robin.add(Piece(i, i, "ab"[i % 2], 0, 37, np.zeros(37, dtype=np.uint32)))
    share = Counter()
    for sequence, offset, piece in robin.serve(4000):
        share[piece.source] += len(piece.ids)
        if sequence >= 5:
            assert abs(share["a"] - 0.75 * (share["a"] + share["b"])) <= 37 + 100
    assert share["a"] > 2 * share["b"]


def test_windows_follow_the_corpus_and_not_the_queues():
    robin = RoundRobin(100, {"a": 1.0, "b": 1.0, "c": 2.0, None: 0.0}, 0)
    robin.add(Piece(0, 0, "a", 0, 9000, np.zeros(9000, dtype=np.uint32)))
    for i in range(10):
        robin.add(Piece(i, i, "b", 0, 50, np.zeros(50, dtype=np.uint32)))
    robin.add(Piece(11, 11, None, 0, 30, np.zeros(30, dtype=np.uint32)))
    per = defaultdict(Counter)
    for sequence, _, piece in robin.serve(0):
        per[sequence][piece.source] += len(piece.ids)
    # Half and half as long as b lasts; what has no weight waits for the others.
    assert all(abs(sum(per[i]["b"] for i in range(n)) - 50 * n) <= 50 for n in range(1, 10))
    assert [p.source for p in robin.rest()] == [None] and sum(len(p.ids) for p in robin.rest()) == 30
    owed = dict(robin.deficits())
    assert set(owed) == {"a", "b", "c", None} and owed["c"] == 100 * len(per) / 2 and sum(owed.values()) == pytest.approx(0)


def test_every_window_holds_the_target_proportions():
    weights = {"a": 5.0, "b": 3.0, "c": 1.5, "d": 0.5}
    robin = RoundRobin(WINDOW, weights, 0)
    rng = random.Random(2)
    for i in range(400):
        n = rng.choice([1, 40, 900, 30_000])
        for s, w in weights.items():
            robin.add(Piece(i, i, s, 0, int(n * w) + 1, np.zeros(int(n * w) + 1, dtype=np.uint32)))
    per, pieces = defaultdict(Counter), Counter()
    for sequence, _, piece in robin.serve(2_000_000):
        per[sequence][piece.source] += len(piece.ids)
        pieces[sequence, piece.source] += 1
    assert len(per) > 1000
    for sequence, held in per.items():
        assert sum(held.values()) == WINDOW
        assert all(abs(held[s] - WINDOW * w / 10) <= 2 * QUANTUM + 4 for s, w in weights.items())
    for s, w in weights.items():
        total = np.cumsum([per[i][s] for i in range(len(per))])
        assert (abs(total - WINDOW * w / 10 * np.arange(1, len(per) + 1)) <= 2 * QUANTUM + 4).all()


def test_packing_keeps_ids_and_spreads_equal_rows(spark):
    text = "one and the same text for all of these rows"
    rows = [(2**60 + i, f"{i} {text}", "s") for i in (1, 3)] + [(None, None, None), (None, "", "s")] + [(7, text, "s")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pieces = pack(docs).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {r.doc_id for r in pieces} == {2**60 + 1, 2**60 + 3, None, 7} and sum(r.length for r in pieces if r.doc_id is None) == 2
    # A task numbers its sequences from its own base: equal rows went to all four, and to the tree.
    tasks = Counter(r.sequence_id >> 33 for r in pieces if r.doc_id == 7)
    assert len(tasks) == 5 and sum(r.length for r in pieces if r.doc_id == 7) == 3000 * next(r.doc_tokens for r in pieces if r.doc_id == 7)


def test_packing_counts_each_deficit_once(spark, monkeypatch):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, _text(rng, rng.choice([3, 40, 700])), "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string")
    monkeypatch.setattr("tallyline.llm.packing.FAN_IN", 2)
    seen = []

    def watched(df, name):
        out = materialize(df, name)
        if "part" in out.columns:
            seen.append(out.where("sequence_id is null and ids is null").groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("source").alias("s"), F.sum("deficit").alias("d"), F.max(F.abs("deficit")).alias("m")).collect())
        return out

    monkeypatch.setattr("tallyline.llm.packing.materialize", watched)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pieces = pack(docs, window=64).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(seen) >= 2 and len(seen[0]) > 1
    for r in (r for level in seen for r in level):
        assert r.n == r.s == 3 and r.d == pytest.approx(0, abs=1e-6)
    assert pieces["row_id"].nunique() == 300


def test_machine_equals_all_pairs():
    rng = np.random.default_rng(0)
    m = Machine(20, 3, 2)
    m.w, m.v, m.bias = rng.normal(size=22), rng.normal(size=(22, 3)), 0.3
    at, value, dense = [np.array([1, 4, 9]), np.array([], dtype=np.int64)], [rng.normal(size=3), np.zeros(0)], rng.normal(size=(2, 2))
    got = m.raw(*m.join(at, value, dense))[0]
    for row in range(2):
        x = np.zeros(22)
        x[at[row]] = value[row]
        x[20:] = np.clip(dense[row], -6, 6) * 0.3
        pairs = sum(m.v[i] @ m.v[j] * x[i] * x[j] for i in range(22) for j in range(i + 1, 22))
        assert got[row] == pytest.approx(m.bias + m.w @ x + pairs)


def test_quality_separates_and_takes_all_rows(spark, docs, nothing):
    rng = random.Random(2)
    good = [(i, _text(rng, 80), len(WORDS)) for i in range(300)]
    bad = [(1000 + i, " ".join(w + "!!" for w in _text(rng, 40).upper().split()), None) for i in range(80)]
    corpus = spark.createDataFrame(good + bad, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000)) for r in good + bad] + [(0, None), (None, 1), (5, 7)], "doc_id long, label int")
    machine = fit_quality(corpus, labels.where(doc_crc(F.col("doc_id")) % 4 != 2), ("n_chars",), epochs=6)
    held = score_quality(corpus, machine, ["doc_id"], ("n_chars",)).where(doc_crc(F.col("doc_id")) % 4 == 2).toPandas()
    assert len(held) > 50 and ((held["score"] >= 0.7) == (held["doc_id"] < 1000)).mean() > 0.97
    every = score_quality(docs, machine, docs.columns, ("n_chars",))
    assert every.columns == [c for c in docs.columns if c != "score"] + ["score"]
    scores = [r.score for r in every.collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    assert score_quality(nothing, machine, ["doc_id"], ("n_chars",)).count() == 0


def test_quality_without_labels_or_with_one_class(spark, docs):
    none = spark.createDataFrame([], "doc_id long, label int")
    machine = fit_quality(docs, none)
    assert {r.score for r in score_quality(docs, machine, ["doc_id"]).collect()} == {0.5}
    ones = spark.createDataFrame([(7, 1), (8, 1)], "doc_id long, label int")
    assert all(r.score > 0.9 for r in score_quality(docs, fit_quality(docs, ones), ["doc_id"]).collect())


def test_quality_stage_with_columns_of_any_name(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = [(i, _text(rng, 60) if i % 4 else "!!! " * 30, 5, "x", i, 0.5) for i in range(200)] + [(None, None, None, None, None, None), (7, "", 1, "y", 1, 1.0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, label string, `a.b` int, Score double")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr("tallyline.llm.quality.EPOCHS", 4)
    out = quality_stage(spark, docs.repartition(3), str(tmp_path))
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    kept = Counter(r.doc_id for r in out.collect())
    scored = score_quality(docs, fit_quality(docs, spark.read.parquet(str(tmp_path / "labels.parquet")).where(doc_crc(F.col("doc_id")) % 4 != 2).select("doc_id", F.col("quality").alias("label")), METADATA), ["doc_id"], METADATA)
    assert kept == Counter(r.doc_id for r in scored.collect() if r.score >= THRESHOLD) and {i for i in kept if i is not None and i != 7} >= {i for i in range(200) if i % 4 and i != 7}


def test_stages_take_rows_that_are_not_stored(spark):
    """Rows that repeat ids, out of a shuffle that numbers them anew at every reading."""
    rng = random.Random(6)
    texts = [_text(rng, 50) for _ in range(40)]
    rows = [(None if i % 5 == 0 else i % 7, texts[i % 40] if i % 3 else _text(rng, 30), "ab"[i % 2], i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row long")
    shuffled = lambda: docs.repartition(8, F.rand())
    out = exact_dedup_stage(spark, shuffled(), "").collect()
    assert len(out) == len({r[1] for r in rows}) == len({r.text for r in out})
    assert len(ngram_join_stage(spark, shuffled(), "").collect()) == len({r[1] for r in rows})
    taken = Counter(r.row for r in mixing_stage(spark, shuffled(), "").collect())
    assert set(taken.values()) <= {1, 2}
    words = Counter()
    for r in rows:
        words[r[2]] += taken[r[3]] * len(r[1].split())
    for r in mix(docs).groupBy("source").agg(F.first("target").alias("t")).collect():
        assert abs(words[r.source] - r.t) <= 50


def test_mixing_of_many_equal_rows(spark):
    rows = [(None, "a b c", "s")] * 900 + [(None, f"w{i} x", "s") for i in range(300)] + [(5, "only", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix(docs.repartition(7)).toPandas()
    for _, g in out.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 3
    again = mix(docs.repartition(3)).toPandas()
    assert Counter(zip(out["size"], out["copies"])) == Counter(zip(again["size"], again["copies"]))


def test_release_deletes_what_is_over(spark):
    import os

    start = mark(spark)
    first, second = materialize(spark.range(3), "first"), materialize(spark.range(4), "second")
    paths = [f.removeprefix("file://") for d in (first, second) for f in d.inputFiles()[:1]]
    release(spark, start, start + 1)
    assert [os.path.exists(p) for p in paths] == [False, True] and second.count() == 4


def _model(rows: list[tuple], held, share: int) -> list[tuple]:
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(table)), "\n"] for r in rows]
    train = [t for r, t in zip(rows, tokens) if not held(r)]
    count = Counter(w for t in train for w in t)
    n, v = sum(count.values()), len(count)
    every = Counter(w for t in tokens for w in ["\t", *t[:-1]])
    heavy = {w for w, c in every.items() if c * share >= sum(every.values())} | {"\t"}
    grams, totals, kinds = Counter(), Counter(), Counter()
    events = lambda t: zip(["", "\t", *t], ["\t", *t], t)
    levels = lambda a, b: [(a, b)] if b in heavy else [(a, b), (b,)]
    for t in train:
        for a, b, w in events(t):
            for c in levels(a, b):
                kinds[c] += not grams[c, w]
                grams[c, w] += 1
                totals[c] += 1
    out = []
    for r, t in zip(rows, tokens):
        size = math.log10(n + v + 1)
        base = sum(math.log10(count[w] + 1) - size for w in t)
        score = 0.0
        for a, b, w in events(t):
            for c in levels(a, b):
                if grams[c, w]:
                    score += math.log10((grams[c, w] - DISCOUNT) / totals[c])
                    break
                score += math.log10(min(1.0, DISCOUNT * kinds[c] / totals[c])) if totals[c] else 0
            else:
                score += math.log10(count[w] + 1) - size
        out.append((r[0] is None, r[0] or 0, len(t), sum(count[w] > 0 for w in t), n, base, score))
    return sorted(out, key=lambda x: (x[0], x[1], x[2], x[5]))


@pytest.mark.parametrize(("share", "flush", "shard"), [(512, 400_000, 1_000_000), (512, 300, 700), (20, 300, 700), (4, 1000, 100)])
def test_lm_scores(docs, rows, nothing, monkeypatch, share, flush, shard):
    monkeypatch.setattr("tallyline.llm.lm_scoring.FLUSH", flush)
    monkeypatch.setattr("tallyline.llm.lm_scoring.HEAVY_SHARE", share)
    monkeypatch.setattr("tallyline.llm.lm_scoring.MOST_PARTITIONS", 5)
    held = lambda r: zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 7 == 2
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm_scores(docs, doc_crc(F.col("doc_id")) % 7 != 2, shard_events=shard).collect()), key=lambda x: (x[0], x[1], x[2], x[5]))
    expected = _model(rows, held, share)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    for g, e in zip(got, expected):
        assert g[5] == pytest.approx(e[5], rel=1e-9)
        assert g[6] == pytest.approx(e[6], abs=2e-3 * e[2])
    assert lm_scores(nothing, F.lit(True)).count() == 0
    untrained = lm_scores(docs, F.lit(False)).collect()
    assert len(untrained) == len(rows) and all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in untrained)


def test_signatures_that_stand_alone_are_not_exchanged(spark):
    """Of texts of which few are alike, few signatures are exchanged, and every one that two sets share is."""
    import pyarrow as pa

    from tallyline.llm import ngram_join as join

    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(150, 400))) for _ in range(300)]
    texts += [t.replace(" ", " x ", 1) for t in texts[:10]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sketch = np.zeros(1 << join.SKETCH_BITS, dtype=np.uint32)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        edges = join._sharing(docs, 5, sketch, 4, 5)
        found = {frozenset((r.a, r.b)) for r in edges.collect()}
        sent, todo = [], [edges._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            todo += [node.children().apply(i) for i in range(node.children().size())]
            if node.nodeName() == "Exchange" and "signature" in node.simpleString(200):
                sent.append(node.metrics().apply("shuffleRecordsWritten").value())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    shingler, signer = join.Shingler(5), join.Signer(4, 5, sketch)
    sets = list(shingler.sets(pa.array(texts)))
    signs = [set(signer.sign(s).tolist()) for s in sets]
    keys = [int(np.uint64(join.short_key(join.set_key(s))).astype(np.int64)) for s in sets]
    shared = {frozenset((keys[i], keys[300 + i])) for i in range(10) if signs[i] & signs[300 + i]}
    assert len(shared) == 10 and found == shared
    assert len(sent) == 1 and sent[0] < sum(map(len, signs)) / 5
