"""Bank files: CSV bytes to grids, positioned text to grids, and what kind of file it is."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

DELIMITERS = (",", ";", "\t", "|")
SNIFF_LINES = 20
#: Characters of a file whose delimiters may be counted at once.
SNIFF_WHOLE = 8192
#: White space that is trimmed off cells: the Unicode spaces, tabs and line ends, and the byte order mark.
TRIMMED = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
GRID = "statement_id long, row_index int, cells array<string>"
#: How many cells are handed on at once; a file's stay together.
GRID_CELLS = 100_000


def decode(raw: bytes) -> str:
    """UTF-16 by its byte order mark, else UTF-8 with or without one."""
    if raw[:2] == b"\xff\xfe":
        return raw[2:].decode("utf-16-le", "replace")
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    return raw.decode("utf-8-sig", "replace")


def sniff(text: str) -> str:
    """The delimiter that stands most often outside quotes in the first lines; the earlier of equals, a comma if none."""
    if len(text) <= SNIFF_WHOLE:
        # A short file is counted at once if it has no more lines than these.
        bare = _QUOTES.sub("", text) if '"' in text else text
        if bare.count("\n") + bare.count("\r") < SNIFF_LINES:
            return max(DELIMITERS, key=bare.count)
    counts, lines = dict.fromkeys(DELIMITERS, 0), 0
    for m in _MARKS.finditer(text):
        mark = m[0]
        if mark in counts:
            counts[mark] += 1
        elif mark in "\r\n":
            lines += 1
            if lines >= SNIFF_LINES:
                break
    return max(DELIMITERS, key=counts.get)


_QUOTES = re.compile(r'"[^"]*+(?:"|\Z)')
_LINE_ENDS = re.compile(r"\r\n?|\n")
#: Delimiters and line ends, and quoted stretches whole.
_MARKS = re.compile(rf'"[^"]*+(?:"|\Z)|[\r\n{re.escape("".join(DELIMITERS))}]')
#: A cell as it is printed, quoted stretches whole, and what ends it.
_CELLS = {d: re.compile(rf'((?:[^"\r\n{re.escape(d)}]+|"[^"]*+(?:"|\Z))*+)({re.escape(d)}|\r\n?|\n|\Z)') for d in DELIMITERS}
_QUOTED = re.compile(r'"([^"]*+(?:""[^"]*+)*+)(?:"|\Z)')


def split_cells(text: str, delimiter: str) -> list[list[str]]:
    """Rows of trimmed cells. A quote opens anywhere in a cell and closes at the next single quote; within, two stand for one.

    A row ends with CR, LF or both; what follows the last one is a row if it has text or a delimiter.
    """
    if '"' not in text:
        lines = _LINE_ENDS.split(text)
        if lines[-1] == "":
            lines.pop()
        return [[cell.strip(TRIMMED) for cell in line.split(delimiter)] for line in lines]
    rows: list[list[str]] = []
    row: list[str] = []
    for cell, stop in _CELLS[delimiter].findall(text):
        if '"' in cell:
            # Most quoted cells are one stretch.
            whole = cell[0] == cell[-1] == '"' and cell.count('"') == 2
            cell = cell[1:-1] if whole else _QUOTED.sub(lambda q: q[1].replace('""', '"'), cell)
        if stop == "" and not row and cell == "":
            break
        row.append(cell.strip(TRIMMED))
        if stop != delimiter:
            rows.append(row)
            row = []
        if stop == "":
            break
    return rows


def rows_of(raw: bytes) -> list[list[str]]:
    """Trimmed cells by row; blank rows stay, and all rows are as wide as the widest."""
    text = decode(raw)
    rows = split_cells(text, sniff(text))
    width = max(map(len, rows), default=0)
    return [r if len(r) == width else r + [""] * (width - len(r)) for r in rows]


def csv_grid(files: DataFrame) -> DataFrame:
    """files (statement_id, content) -> statement_id, row_index, cells. A null file has no rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, widths, cells = [], [], [], []
            for i, raw in zip(b.column("statement_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = rows_of(raw) if raw is not None else []
                ids.append(i)
                sizes.append(len(rows))
                widths.append(len(rows[0]) if rows else 0)
                for r in rows:
                    cells += r
                if len(cells) >= GRID_CELLS:
                    yield _grid(ids, sizes, widths, cells)
                    ids, sizes, widths, cells = [], [], [], []
            yield _grid(ids, sizes, widths, cells)

    return files.select(F.col("statement_id").cast("long"), "content").mapInArrow(read, GRID)


def _grid(ids: list, sizes: list[int], widths: list[int], cells: list[str]) -> pa.RecordBatch:
    """GRID of files by their numbers of rows, and cells in each of them."""
    n = np.array(sizes, np.int64)
    starts = np.cumsum(n) - n
    place = np.arange(n.sum(), dtype=np.int64) - np.repeat(starts, n)
    offsets = np.concatenate([[0], np.cumsum(np.repeat(np.array(widths, np.int64), n))]).astype(np.int32)
    of = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), n)))
    rows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells, pa.string()))
    return pa.RecordBatch.from_arrays([of, pa.array(place.astype(np.int32)), rows], names=["statement_id", "row_index", "cells"])


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def accepted(mime: Column, filename: Column) -> Column:
    """Whether an upload is taken: PDF or CSV by its type or its name."""
    return F.coalesce(mime.isin("application/pdf", "text/csv"), F.lit(False)) | F.coalesce(filename.rlike(r"(?i)\.(pdf|csv)$"), F.lit(False))


def media_type(content: Column) -> Column:
    """By the first bytes: JPEG, PNG, WEBP or PDF; null for anything else."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(head.startswith("255044462D"), "application/pdf")
    )


POSITIONED = "doc_id string, page int, seq int, text string, x double, y double, width double"


class _Words(HTMLParser):
    """Words of a file of boxes, as (page, seq, text, x, y, width); heights from the foot of their page."""

    def __init__(self):
        super().__init__()
        self.words: list[tuple] = []
        self.page, self.height, self.box, self.text = -1, 0.0, None, ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        of = dict(attrs)
        if tag == "page":
            self.page, self.height = self.page + 1, _size(of.get("height"))
        elif tag == "word":
            self.box, self.text = [_size(of.get(c)) for c in ("xmin", "ymax", "xmax")], ""

    def handle_data(self, data: str) -> None:
        self.text += data

    def handle_endtag(self, tag: str) -> None:
        if tag == "word" and self.box is not None and self.page >= 0:
            left, foot, right = self.box
            self.words.append((self.page, len(self.words), self.text, left, self.height - foot, right - left))
        self.box = None if tag == "word" else self.box


def _size(text: str | None) -> float:
    try:
        return float(text or "")
    except ValueError:
        return 0.0


def positioned_text(spark: SparkSession, path: str, pattern: str = "*.bbox.html") -> DataFrame:
    """The positioned text of documents below a folder: doc_id (the file's path), page, seq, text, x, y, width.

    Files are what PDF tools write as boxes of words (pages with their height, words with
    xMin, yMin, xMax and yMax from the top), in UTF-8. Spark lists and reads them wherever
    they are, a file within a task; conditions on the file's path, size or time
    (doc_id comes of the path) keep files from being read. Boxes without a page or number are left out or 0.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64())
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                found = _Words()
                found.feed(content.decode("utf-8", "replace"))
                columns = list(zip(*found.words, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[name] * len(found.words), *columns], types, strict=True)], names=[c.split()[0] for c in POSITIONED.split(", ")])

    return files.select("path", "content").mapInArrow(words, POSITIONED)


LINE_TOLERANCE, EDGE_TOLERANCE = 3.0, 2
SUPPORT_RATIO, MINIMUM_SUPPORT = 0.08, 2


@F.pandas_udf(ArrayType(IntegerType()))
def _lines(heights: pd.Series) -> pd.Series:
    """The line of each height of a page, from the top down."""

    def number(page: np.ndarray) -> list[int]:
        out, top, line = [], None, -1
        for y in page.tolist():
            if top is None or y is None or not abs(top - y) <= LINE_TOLERANCE:
                top, line = y, line + 1
            out.append(line)
        return out

    return heights.map(number)


def pdf_lines(items: DataFrame) -> DataFrame:
    """items (doc_id, page, seq, text, x, y, width) with their line: from the top, a line takes what is within 3 of its first item.

    Whether an item starts a line depends on where the line before it started, so each
    page is gone through in order, once; the heights of a page are all that leaves the JVM.
    """
    shown = items.where(F.trim("text") != "")
    page = F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("down"), "seq", "text", "x", "y", "width")))
    pages = shown.groupBy("doc_id", "page").agg(page.alias("items"))
    numbered = pages.withColumn("lines", _lines(F.transform("items", lambda i: i["y"])))
    zipped = numbered.select("doc_id", "page", F.explode(F.arrays_zip("items", "lines")).alias("z"))
    return zipped.select("doc_id", "page", F.col("z.lines").alias("line"), "z.items.seq", "z.items.text", "z.items.x", "z.items.width")


def _keys(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers with NaN for null, and which are given: keys of an order with nulls first and NaN last, as Spark's."""
    return column.fill_null(float("nan")).to_numpy(), column.is_valid().to_numpy()


def _edges(of: np.ndarray, at: np.ndarray, given: np.ndarray, required: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray]:
    """Clusters of rounded positions, at most 2 from the last, that enough of a document's items share: document, weighted mean."""
    bucket, doc = np.nan_to_num(np.floor(at[given] + 0.5), nan=0.0, posinf=2.0**63, neginf=-(2.0**63)), of[given]
    order = np.lexsort((bucket, doc))
    bucket, doc = bucket[order], doc[order]
    other = np.diff(doc, prepend=-1) != 0
    start = np.flatnonzero(other | (np.diff(bucket, prepend=0) > EDGE_TOLERANCE))
    if not len(start):
        return doc, bucket
    n = np.diff(start, append=len(doc)).astype(float)
    # What has no position supports its document's first edge.
    blank = np.bincount(of[~given], minlength=len(required))
    n += np.where(other[start], blank[doc[start]], 0)
    enough = n >= required[doc[start]]
    return doc[start][enough], (np.add.reduceat(bucket, start) / n + shift)[enough]


def _cells(items: pa.Table) -> pa.RecordBatch:
    """The cells of whole documents, which lie one behind the other."""
    docs, texts = items["doc_id"].combine_chunks(), items["text"].combine_chunks()
    ends = pc.run_end_encode(docs).run_ends.to_numpy()
    first = np.concatenate([[0], ends[:-1]])
    of = np.repeat(np.arange(len(ends)), ends - first)
    (x, x_given), (y, y_given), (width, width_given) = (_keys(items[c]) for c in ("x", "y", "width"))
    page, paged, seq = items["page"].fill_null(-(2**63)).to_numpy(), items["page"].is_valid().to_numpy(), items["seq"].fill_null(-(2**63)).to_numpy()
    rank = lambda: pc.rank(texts, tiebreaker="dense").to_numpy()
    # Lines, from a page's top down; texts matter only to what has no height and no place of its own.
    order = np.lexsort((width, x, np.zeros(len(of)) if np.isfinite(y).all() else rank(), seq, -y, y_given, page, of))
    fresh = (np.diff(of[order], prepend=-1) != 0) | (np.diff(page[order], prepend=0) != 0)
    starts, top = [], 0.0
    for i, (height, turned) in enumerate(zip(y[order].tolist(), fresh.tolist(), strict=True)):
        if turned or not abs(top - height) <= LINE_TOLERANCE:
            starts.append(i)
            top = height
    fresh[starts] = True
    line = np.empty(len(of), np.int64)
    line[order] = np.cumsum(fresh) - 1
    required = np.maximum(MINIMUM_SUPPORT, np.ceil(np.bincount(of[order][fresh & paged[order]], minlength=len(ends)) * SUPPORT_RATIO))
    required[docs.is_null().to_numpy(zero_copy_only=False)[first]] = np.inf
    # Columns: how many of the document's edges an item's middle has passed.
    both = x_given & width_given
    edges = [np.concatenate(c) for c in zip(_edges(of, x, x_given, required, 0.0), _edges(of, x + width, both, required, 0.5), strict=True)]
    order = np.lexsort(edges[::-1])
    owner, edge = edges[0][order], edges[1][order]
    single = (np.diff(owner, prepend=-1) != 0) | (np.diff(edge, prepend=np.nan) != 0)
    owner, edge = owner[single], edge[single]
    order = np.lexsort((np.repeat([0, 1], [len(owner), len(of)]), np.concatenate([edge, x + width / 2]), np.concatenate([owner, of])))
    passed = np.empty(len(order), np.int64)
    passed[order] = np.cumsum(order < len(owner))
    place = np.where(both, passed[len(owner) :] - np.searchsorted(owner, of), 0)
    used, column = np.unique(of * (len(owner) + 1) + place, return_inverse=True)
    column = column - np.searchsorted(used // (len(owner) + 1), np.arange(len(ends)))[of]
    # Cells: texts from the left.
    order = np.lexsort((seq, x, x_given, column, line))
    same = lambda k: k[order][1:] == k[order][:-1]
    if (same(seq) & (same(x) | np.isnan(x[order][1:])) & same(column) & same(line)).any():
        order = np.lexsort((rank(), seq, x, x_given, column, line))
    start = np.flatnonzero(np.concatenate([[True], ~(same(line) & same(column))]))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(start, len(of)), pa.int32()), texts.take(pa.array(order)).cast(pa.string())), " ")
    head = order[start]
    row = line[head] - np.minimum.reduceat(line, first)[of[head]]
    return pa.RecordBatch.from_arrays([docs.take(pa.array(head)), pa.array(row, pa.int32()), pa.array(column[head], pa.int32()), joined], names=["doc_id", "row_index", "column", "text"])


def _grids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of items in the order of their documents, as soon as a document ends."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        runs = pc.run_end_encode(b["doc_id"]).run_ends.to_numpy()
        last = int(runs[-2]) if len(runs) > 1 else 0
        if last or (held and held[-1]["doc_id"][-1].as_py() != b["doc_id"][0].as_py()):
            whole = [*held, b.slice(0, last)]
            yield _cells(pa.Table.from_batches(whole))
            held = []
        held.append(b.slice(last))
    if held:
        yield _cells(pa.Table.from_batches(held))


def pdf_grid(items: DataFrame) -> DataFrame:
    """items -> doc_id, row_index, column, text: the cells of a document's table, columns found from shared edges.

    A column begins where enough items start, or end; an item belongs to the column its
    middle lies in. Texts of a cell are joined by spaces; columns without any text go.

    Items are exchanged once, by document. A task goes through its documents one after the
    other, many at once where they are short, and holds no more than one and a batch, as Arrow.
    """
    # Lines are told as pdf_lines tells them.
    shown = items.select("doc_id", F.col("page").cast("long"), F.col("seq").cast("long"), F.trim("text").alias("text"), *[F.col(c).cast("double") for c in ("x", "y", "width")]).where("text <> ''")
    schema = StructType([StructField("doc_id", items.schema["doc_id"].dataType)]).add("row_index", "integer").add("column", "integer").add("text", "string")
    return shown.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(_grids, schema)
