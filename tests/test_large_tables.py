"""What lets statements be read at size: lines exchanged once, code that the JVM compiles, packed tables between steps, and quick ways that say what the long ones say."""

from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyline.functions.money import read_amount
from tallyline.functions.text import js_trim
from tallyline.operators import parsing, walk
from tallyline.sources import bank_files

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture
def plain_plans(spark):
    """Plans as they are before any of their stages has run."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


@here
def test_lines_are_exchanged_once(spark, plain_plans, capsys):
    from tallyline.plans.domain import load

    load(spark, DATA, "printed_lines").explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1


@here
def test_rows_are_read_by_code_that_is_compiled(spark, plain_plans, capsys):
    """Methods above 8000 bytes are interpreted for ever."""
    from tallyline.plans.domain import load
    from tallyline.plans.flow_queries import _structures

    grid = spark.createDataFrame([(1, 0, ["a"])], bank_files.GRID)
    usable = parsing.usable_structures(load(spark, DATA, "parse_requests"), _structures(spark, DATA))
    walk.read_rows(grid, usable).explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


@here
def test_the_flow_writes_packed_tables(spark):
    """Of each line of the input, the flow writes less than it reads."""
    from tallyline.functions.lineage import shared_folder
    from tallyline.plans import QUERIES

    def size():
        return sum(os.path.getsize(os.path.join(p, f)) for p, _, files in os.walk(shared_folder(spark).removeprefix("file:").replace("///", "/")) for f in files)

    before = size()
    assert QUERIES["flow_log"](spark, DATA).count()
    assert 0 < size() - before < 120 * spark.read.parquet(f"{DATA}/lineitem.parquet").count()


def test_words_are_no_amounts_and_odd_numbers_are(spark):
    texts = ["Debit", "Closing", "", None, ".", ",", "-", "()", "5.", "12345678901234567", "123456789012345.67", "(1,234,567,890,123.45)", "(5", "5)", "-0.5", "$.", "1 000,5"]
    old = [None, None, None, None, 0, None, None, None, 500, 1234567890123456700, 12345678901234567, 123456789012345, None, None, 50, 0, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", read_amount(F.col("t"), F.lit("USD"))["minor"].alias("m")).orderBy("i").collect()
    assert [None if r.m is None else int(r.m) for r in rows] == old


def test_trimming(spark):
    """By a pattern of Unicode's white space and the byte order mark, every character of the plane is trimmed or kept alike."""
    marks = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    frame = spark.createDataFrame([(f"{c}a b{c}{c}",) for c in marks] + [("",), (" 　 ",), (None,)], "t string")
    pattern = F.regexp_replace("t", r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")
    assert frame.where(~pattern.eqNullSafe(js_trim(F.col("t")))).count() == 0


def _by_character(text, delimiter):
    """Cells as a state machine reads them."""
    rows, row, cell, quoted, some, i = [], [], "", False, False, 0
    while i < len(text):
        c = text[i]
        if quoted:
            if c == '"' and text[i + 1 : i + 2] == '"':
                cell, i = cell + '"', i + 1
            elif c == '"':
                quoted = False
            else:
                cell += c
        elif c == '"':
            quoted = True
        elif c == delimiter:
            row, cell, some = [*row, cell], "", True
        elif c in "\r\n":
            i += text[i : i + 2] == "\r\n"
            rows.append([*row, cell])
            row, cell, some = [], "", False
        else:
            cell += c
        i += 1
    if some or cell:
        rows.append([*row, cell])
    return [[x.strip(bank_files.TRIMMED) for x in r] for r in rows]


def _delimiter(text):
    counts, lines, quoted = dict.fromkeys(bank_files.DELIMITERS, 0), 0, False
    for c in text:
        quoted ^= c == '"'
        if not quoted and c in counts:
            counts[c] += 1
        elif not quoted and c in "\r\n":
            lines += 1
            if lines >= 20:
                break
    return max(bank_files.DELIMITERS, key=counts.get)


def test_cells_and_delimiters_against_a_state_machine():
    rng = random.Random(11)
    for n in range(20_000):
        text = "".join(rng.choices('ab ,;|\t"\n\r﻿', weights=[4, 4, 1, 4, 2, 1, 1, 2 * (n % 2), 3, 1, 1], k=rng.randrange(80 if n % 10 else 400)))
        assert bank_files.sniff(text) == _delimiter(text)
        for d in bank_files.DELIMITERS:
            assert bank_files.split_cells(text, d) == _by_character(text, d), text
    long = "a;b\n" * 5000 + "a,b,c,d,e,f\n" * 5000
    assert bank_files.sniff(long) == ";" and len(bank_files.rows_of(long.encode())) == 10_000
