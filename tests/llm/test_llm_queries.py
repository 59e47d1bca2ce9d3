"""Every query of the subpackage on the smallest driver tables, against its SQL where there is one."""

from __future__ import annotations

import os
import re
from collections import Counter
from string import ascii_lowercase, ascii_uppercase

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")

from tallyline.llm.mixing import mix  # noqa: E402
from tallyline.llm.packing import VOCABULARY, Tokenizer  # noqa: E402
from tallyline.llm.registry import ORACLES, QUERIES  # noqa: E402


def _rows(columns, rows):
    """Columns by name and sorted rows as texts; null is empty, and whole numbers stay whole beside nulls."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple("" if r[i] is None or r[i] != r[i] else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    got = QUERIES[name](spark, DATA)
    rows = got.collect()
    assert rows
    if name in ORACLES:
        with duckdb.connect() as db:
            for t in os.listdir(DATA):
                db.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{DATA}/{t}'")
            wanted = db.execute(ORACLES[name])
            assert _rows(got.columns, rows) == _rows([c[0] for c in wanted.description], wanted.fetchall())


def _exact(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(ascii_uppercase, ascii_lowercase)))
    return frozenset([tuple(words)] if 0 < len(words) < 5 else (tuple(words[i : i + 5]) for i in range(len(words) - 4)))


def test_pipeline(spark):
    """Every stage's decisions against plain ones, on what the stage before kept."""
    from corpus_pipeline import STAGES, run

    assert [s.__module__.rpartition(".")[2] for _, s in STAGES] == ["quality", "exact_dedup", "ngram_join", "mixing", "packing"]
    out = run(spark, DATA).toPandas()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    kept = {r.doc_id for r in QUERIES["op1_quality"](spark, DATA).where("predicted = 1").collect()}
    best = {}
    for i in sorted(kept):
        key = _exact(docs[i].text)
        if key not in best or len(docs[i].text or "") > len(docs[best[key]].text or ""):
            best[key] = i
    kept, sets = set(best.values()), {i: _shingles(docs[i].text) for i in best.values()}
    near = {i: [j for j in kept if i != j and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in kept}
    first = set()
    for i in sorted(kept):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in near[todo.pop()] if j not in seen and not seen.add(j)]
        if min(seen) == i:
            first.add(i)
    assert 0 < len(first) < len(docs)
    mixed = mix(spark.createDataFrame([docs[i] for i in sorted(first)])).where("copies > 0").collect()
    tokens = Tokenizer(VOCABULARY)
    wanted = Counter({(r.doc_id, len(tokens.ids(docs[r.doc_id].text or "")) + 1): r.copies for r in mixed})
    got = out.groupby(["doc_id", "doc_tokens"])["length"].sum()
    assert {k: n // k[1] for k, n in got.items()} == wanted and all(n % k[1] == 0 for k, n in got.items())
    lengths = out.groupby("sequence_id")["length"].sum()
    assert all(n == 1024 or n & (n - 1) == 0 for n in lengths)
