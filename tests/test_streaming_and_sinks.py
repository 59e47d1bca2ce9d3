"""Incremental intake and the export's files."""

from __future__ import annotations

import glob
import json
import os
import random
from datetime import date

from pyspark.sql import functions as F

from tallyline.operators import ledger, workflow
from tallyline.sources import bank_files, mail
from tallyline.sources.sinks import COLUMNS, write_export, write_summary
from tallyline.sources.stored import PartTable
from tallyline.streaming.ingest import LINES, ingest, stored_lines, take_in
from tallyline.streaming.promotion import Promotion


def _lines(spark, statement, n):
    return spark.createDataFrame([(statement, i, 1, date(2024, 1, 1), i % 3, "DEBIT", "d", None) for i in range(n)], LINES)


def test_files_that_arrive_twice_add_nothing(spark, tmp_path):
    incoming, table, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    for round_ in range(3):
        _lines(spark, 1, 6).unionByName(_lines(spark, 2 + round_, 4)).coalesce(1).write.mode("append").parquet(incoming)
        ingest(spark, incoming, table, state).awaitTermination()
    stored = stored_lines(spark, table)
    assert stored.count() == 6 + 3 * 4 == stored.select("statement_id", "row_index").distinct().count()
    take_in(table)(_lines(spark, 1, 6).unionByName(_lines(spark, 2, 4)), 0)  # the first batch again
    assert stored_lines(spark, table).count() == 6 + 3 * 4
    assert ledger.promote(stored_lines(spark, table)).count() > 0


def test_batches_of_many_ranges(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "table")
    rows = _lines(spark, 1, 3).unionByName(_lines(spark, 150_000, 2)).unionByName(_lines(spark, -5, 1))
    take_in(table)(rows, 0)
    take_in(table)(rows.unionByName(_lines(spark, 150_000, 4)), 1)
    monkeypatch.setattr("tallyline.streaming.ingest.MOST_RANGES", 1)
    take_in(table)(rows.unionByName(_lines(spark, 150_001, 4)), 2)
    assert sorted((r.batch, r["count"]) for r in stored_lines(spark, table).groupBy("batch").count().collect()) == [(0, 6), (1, 2), (2, 4)]


def test_export_files(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-02", "b", "d", "Debit", 1.5, "USD", None, "Yes", None, None, None, 7), ("2024-01-01", "a", "d", "Debit", 2.0, "USD", None, "Yes", None, None, None, None)], ", ".join(f"{c} {'double' if c == 'amount' else 'long' if c == 'document' else 'string'}" for c in COLUMNS))
    write_export(rows, str(tmp_path / "x"), "https://books.example")
    back = spark.read.option("header", True).csv(str(tmp_path / "x"))
    assert back.columns == list(COLUMNS) and {r.document for r in back.collect()} == {None, "https://books.example/documents/7"}
    write_export(rows, str(tmp_path / "y"), "javascript:alert(1)", "parquet")
    assert {r.document for r in spark.read.parquet(str(tmp_path / "y")).collect()} == {None}
    write_summary(spark.createDataFrame([(1, 2, 3)], "workspace_id int, matched long, blocked long"), str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == 2


def test_stored_tables_change_by_parts(spark, tmp_path):
    schema = "parent long, child long, note string"
    rows = [(p, c, "old") for p in [*range(40), None] for c in range(3)]
    table = PartTable(f"file://{tmp_path}/t", schema, ("parent",), 8)
    frame = lambda rows: spark.createDataFrame(rows, schema)
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/t/part=*/*.parquet")}
    key = lambda r: (r[0] is None, *map(str, r))
    held = lambda: sorted(map(tuple, table.read(spark).collect()), key=key)
    table.create(frame(rows))
    assert held() == sorted(rows, key=key)
    before = files()
    gone = [(5, None, None), (None, None, None)]
    for _ in range(2):  # a repeated replacement changes nothing
        table.replace(frame([(5, 9, "new"), (77, 1, "new")]), frame(gone))
        rows = [r for r in rows if r[0] not in (5, 77, None)] + [(5, 9, "new"), (77, 1, "new")]
        assert held() == sorted(rows, key=key)
    touched = {r[0] for r in frame([*gone, (77, None, None)]).select(F.pmod(F.xxhash64("parent"), 8)).collect()}
    same = {f for f, t in before.items() if files().get(f) == t}
    assert {int(f.split("part=")[1].split("/")[0]) for f in same} == set(range(8)) - touched
    table.upsert(frame([(5, 9, "twice"), (None, None, "null keys"), (6, 1, "changed")]), ("parent", "child"))
    table.upsert(frame([(None, None, "once")]), ("parent", "child"))
    table.update(frame([(6, 2, None), (6, 99, "nobody's")]), ("parent", "child"))
    rows = [r for r in rows if r[:2] not in ((5, 9), (6, 1), (6, 2))] + [(5, 9, "twice"), (None, None, "once"), (6, 1, "changed"), (6, 2, None)]
    assert held() == sorted(rows, key=key)
    part = frame([(6, 0, None)]).select(F.pmod(F.xxhash64("parent"), 8)).first()[0]
    everyone = table._stored(spark).where(F.col("part") == part).drop("part")
    table.delete(everyone, ("parent", "child"))
    assert held() == sorted((r for r in rows if spark.createDataFrame([r], schema).select(F.pmod(F.xxhash64("parent"), 8)).first()[0] != part), key=key) and not glob.glob(f"{tmp_path}/t/part={part}/*")


def test_attachments_at_any_depth(spark):
    leaf = lambda i, **more: {"partId": str(i), "filename": f"f{i}", "body": {"attachmentId": f"a{i}", "size": i}} | more
    deep = leaf(50)
    for i in range(49, 0, -1):
        deep = leaf(i, parts=[None, {"filename": "", "body": {"attachmentId": "x"}}, deep, {"filename": f"g{i}", "mimeType": "t/p", "body": {"attachmentId": f"b{i}", "size": "9"}}])
    trees = [(1, json.dumps(deep)), (2, json.dumps({"parts": {"a": leaf(1)}, "filename": 3})), (3, "no json"), (4, None), (5, json.dumps({"parts": "x"})), (6, json.dumps([leaf(1)])), (7, json.dumps(leaf(7)))]
    got = [tuple(r) for r in mail.attachments(spark.createDataFrame(trees, "message_id long, payload string")).orderBy("message_id", "place").collect()]
    order = [(f"f{i}", i, "application/octet-stream", f"a{i}", str(i)) for i in range(1, 51)] + [(f"g{i}", 0, "t/p", f"b{i}", "") for i in range(49, 0, -1)]
    assert [(r[3], r[5], r[4], r[6], r[2]) for r in got if r[0] == 1] == order and [r[1] for r in got if r[0] == 1] == list(range(1, 100))
    assert [r for r in got if r[0] != 1] == [(7, 1, "7", "f7", "application/octet-stream", 7, "a7")]


def test_positioned_text_from_files(spark, tmp_path):
    word = lambda text, x, y, w: f'<word xMin="{x}" yMin="{y - 8}" xMax="{x + w}" yMax="{y}">{text}</word>'
    page = lambda words: f'<page width="500" height="700">{"".join(words)}</page>'
    rows = [[("Date", 20, 30), ("Text", 90, 40), ("Amount", 200, 40)], *[[(f"0{i}/01/24", 20, 30), (f"A &amp; B{i}", 90, 40), (f"{i}.00", 200, 40)] for i in range(1, 5)]]
    pages = [page(word(t, x, 50 + 20 * n, w) for n, row in enumerate(rows) for t, x, w in row), page([word("05/01/24", 20, 50, 30), word("C5", 90, 50, 40), word("5.00", 200, 50, 40)])]
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.bbox.html").write_text("<html><body><doc>" + "".join(pages) + "</doc></body></html>")
    (tmp_path / "in/deep/b.bbox.html").write_text("<word>lost</word><page><word xMin='x'>scan 7</word></page>")
    (tmp_path / "in/other.txt").write_text("<page></page>")
    (tmp_path / "in/empty.bbox.html").write_text("")
    items = bank_files.positioned_text(spark, f"file://{tmp_path}/in")
    assert {r.doc_id.rsplit("/", 1)[1] for r in items.select("doc_id").distinct().collect()} == {"a.bbox.html", "b.bbox.html"}
    first = items.where("text = 'A & B1'").first()
    assert (first.page, first.x, first.y, first.width) == (0, 90.0, 630.0, 40.0) and items.where("text = 'scan 7'").first()[4:] == (0.0, 0.0, 0.0)
    cells = {(r.row_index, r.column): r.text for r in bank_files.pdf_grid(items.where("doc_id like '%/a.bbox.html'")).collect()}
    assert [cells[i, 1] for i in range(6)] == ["Text", "A & B1", "A & B2", "A & B3", "A & B4", "C5"] and cells[5, 2] == "5.00"
    extent = {r.doc_id.rsplit("/", 1)[1]: (r.pages, r.characters, r.has_digit) for r in workflow.text_extent(items, "doc_id").collect()}
    assert extent == {"a.bbox.html": (2, 100, True), "b.bbox.html": (1, 6, True)}


def test_promotion_over_a_stream(spark, tmp_path):
    rng = random.Random(3)
    rows = [(s, i, rng.randrange(2), date(2024, 1, rng.randrange(1, 3)), rng.randrange(2), "DEBIT", rng.choice(["d", None]), rng.choice([None, None, f"R{rng.randrange(4)}"])) for s in rng.sample(range(40), 9) for i in range(rng.randrange(1, 7))]
    rng.shuffle(rows)
    incoming, state = str(tmp_path / "in"), str(tmp_path / "state")
    promotion = Promotion(f"file://{tmp_path}/tables", 4)
    order = lambda r: tuple(map(str, r))
    now = lambda: sorted((tuple(r) for r in promotion.ledger.read(spark).collect()), key=order)
    wanted = lambda some: sorted((tuple(r) for r in ledger.promote(spark.createDataFrame(some, LINES)).collect()), key=order)
    third = len(rows) // 3
    for n, part in enumerate((rows[:third], rows[third : 2 * third], rows[2 * third :] + rows[:5])):
        spark.createDataFrame(part, LINES).coalesce(1).write.mode("append").parquet(incoming)
        promotion.run(spark, incoming, state, files=1).awaitTermination()  # a new run goes on where the last one ended
        assert now() == wanted(rows[: min(len(rows), (n + 1) * third) if n < 2 else len(rows)])
    # What failed half-way comes again, and so does what is long done.
    for part in (rows[:third], rows):
        promotion.add()(spark.createDataFrame(part, LINES), 0)
    assert now() == wanted(rows)
