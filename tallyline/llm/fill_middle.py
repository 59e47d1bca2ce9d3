"""Fill-in-middle transformation with a constant-memory two-pass matcher.

A text is cut between units: matches of a pattern, code points unless told otherwise. The
first pass runs the pattern over the text and counts; the second advances a lazy iterator
of matches to the lower and then to the higher rank, and ends there. Only the two
positions are held, never the units, so memory doesn't grow with their number.

Everything random comes from a digest of the document's id, so a repeated run, or a task
that runs again on another executor, makes the same rows. Rows are made where they are
read, without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CODE_POINT = r"(?s:.)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Documents in a hundred that are transformed, and of those, in a hundred, with the suffix first.
FIM_RATE, SPM_RATE = 90, 20
#: Code points of text in a batch of rows; a longer text travels alone.
BATCH_CHARS = 1 << 22


def draws(doc_id: int | None, seed: int = 1) -> list[int]:
    """Four numbers of 32 bits from the id; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def cut(text: str, n: int, low: int, high: int, unit: re.Pattern) -> tuple[int, int]:
    """Positions behind the low-th and the high-th of a text's n units; rank 0 is the start, and rank n the end of the text."""
    matches, at, found = unit.finditer(text), 0, []
    for rank, steps in ((low, low), (high, high - low)):
        if rank == n:
            found.append(len(text))
            continue
        if steps:
            at = next(islice(matches, steps - 1, None)).end()
        found.append(at)
    return found[0], found[1]


def transform(doc_id: int | None, text: str, unit: re.Pattern, seed: int = 1, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, str]:
    """n units, form, code points of prefix and middle, and the output."""
    n = sum(1 for _ in unit.finditer(text))
    a, b, keep, order = draws(doc_id, seed)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or keep % 100 >= fim_rate:
        return n, "plain", None, None, text
    low, high = sorted((a % (n + 1), b % (n + 1)))
    i, j = cut(text, n, low, high, unit)
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if order % 100 < spm_rate:
        return n, "spm", i, j - i, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", i, j - i, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


MADE = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}


def fill_in_middle(docs: DataFrame, unit: str = CODE_POINT, seed: int = 1, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n long, form, prefix_chars, middle_chars, output: one row per row of docs.

    n is the number of matches of ``unit``, left to right over code points. form is plain
    (output is the text) where the text is empty or null, holds one of the marks, or isn't
    drawn; psm is prefix, suffix, middle, and spm suffix, prefix, middle, each behind its
    mark. The prefix ends behind the lower of two drawn ranks and the middle behind the
    higher; what stands between two matches goes with the one behind it, and what follows
    the last with the suffix unless a rank is n. A pattern without matches makes every cut
    at the end of the text. Repeated rows are made alike, a null id draws like an empty
    one, an empty table gives an empty result, and other columns are ignored.
    """
    compiled = re.compile(unit)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for doc_id, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                doc_id, text = doc_id.as_py(), text.as_py() or ""
                rows.append((doc_id, *transform(doc_id, text, compiled, seed, fim_rate, spm_rate)))
                held += len(text)
                if held >= BATCH_CHARS:
                    yield batch(rows)
                    rows, held = [], 0
            yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(MADE)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, MADE.values(), strict=True)], names=list(MADE))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text of an output, by its form. No mark begins as it ends, so none can arise where two parts meet."""
    after = lambda text, mark: F.substring(text, F.length(F.substring_index(text, mark, 1)) + 1 + len(mark), F.length(text))
    first, last = F.substring_index(output, MIDDLE, 1), after(output, MIDDLE)
    psm = F.concat(F.substring(F.substring_index(first, SUFFIX, 1), F.lit(1 + len(PREFIX)), F.length(first)), last, after(first, SUFFIX))
    spm = F.concat(after(first, PREFIX), last, F.substring(F.substring_index(first, PREFIX, 1), F.lit(1 + len(SUFFIX)), F.length(first)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (
  SELECT *, substring(t, 1, least(a, b)) AS p, substring(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS m, substring(t, greatest(a, b) + 1) AS s FROM r)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c
"""
