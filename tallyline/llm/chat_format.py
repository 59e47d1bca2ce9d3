"""Chat formatting: records of many layouts become turns, and turns become training text.

A record is a JSON object. Its fingerprint is a hash of the sorted paths of its nested
fields, each with the kinds of what stands there (object, list, text, other); the
fingerprint selects a declarative mapping, a list of steps that say which path holds
which role's text. No layout is guessed from values. A fingerprint met for the first
time is matched against the mappings' required paths and kinds (extra fields are common),
by what it hashes alone, and the answer is remembered under it: the answer never depends
on which of the records that share a fingerprint came first.

The template writes a turn as ``<turn:ROLE>`` newline TEXT newline ``</turn>`` newline.
Inside roles and texts every ``\\`` and ``<`` (in roles also ``>`` and newline) has a
``\\`` in front, so no text can hold a marker and every text can be read back.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unused


@dataclass(frozen=True)
class Step:
    """Turns at ``path``: of a fixed role, or of a list whose elements name theirs."""

    path: str
    role: str | None = None
    role_field: str | None = None
    text_field: str | None = None
    joined_with: str | None = None  # a second path whose text follows after an empty line
    role_names: tuple[tuple[str, str], ...] = ()  # what the layout calls the canonical roles


@dataclass(frozen=True)
class Mapping:
    name: str
    steps: tuple[Step, ...]

    def fits(self, shape: set[str]) -> bool:
        """Whether a record of this shape (see ``shape``) has what the steps read."""
        for s in self.steps:
            if not s.role_field:
                if not any(s.path + kind in shape for kind in KINDS):
                    return False
            elif f"{s.path}:list" not in shape:
                return False
            else:
                # Elements must be objects, all of them; an empty list is a conversation without turns.
                elements = [kind for kind in KINDS if f"{s.path}[]{kind}" in shape]
                if elements and (elements != [":object"] or not all(any(f"{s.path}[].{f}{kind}" in shape for kind in KINDS) for f in (s.role_field, s.text_field))):
                    return False
        return True


KINDS = (":object", ":list", ":text", ":other")

SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))

#: In order of preference, should a record fit several.
MAPPINGS = (
    Mapping("messages", (Step("messages", role_field="role", text_field="content"),)),
    Mapping("turns", (Step("turns", role_field="role", text_field="text"),)),
    Mapping("conversations", (Step("conversations", role_field="from", text_field="value", role_names=SPEAKERS),)),
    Mapping("system instruction", (Step("system", "system"), Step("instruction", "user", joined_with="input"), Step("output", "assistant"))),
    Mapping("instruction", (Step("instruction", "user", joined_with="input"), Step("output", "assistant"))),
    Mapping("instruction response", (Step("instruction", "user", joined_with="context"), Step("response", "assistant"))),
    Mapping("system prompt", (Step("system", "system"), Step("prompt", "user"), Step("response", "assistant"))),
    Mapping("prompt response", (Step("prompt", "user"), Step("response", "assistant"))),
    Mapping("prompt completion", (Step("prompt", "user"), Step("completion", "assistant"))),
    Mapping("question answer", (Step("question", "user"), Step("answer", "assistant"))),
    Mapping("nested", (Step("data.prompt", "user"), Step("data.response", "assistant"))),
)

TURN = re.compile(r"<turn:((?:[^\\<>\n]+|\\.)*)>\n((?:[^\\<]+|\\.)*)\n</turn>\n", re.S)


def shape(record: object) -> set[str]:
    """The paths of all fields with the kind of what they hold: ``a.b:text`` in objects, ``a[].b:text`` in lists of objects."""
    out: set[str] = set()
    todo = [("", record)]
    while todo:
        at, value = todo.pop()
        if isinstance(value, dict):
            out.add(f"{at}:object")
            todo += [(f"{at}.{_segment(k)}" if at else _segment(k), v) for k, v in value.items()]
        elif isinstance(value, list):
            out.add(f"{at}:list")
            todo += [(f"{at}[]", v) for v in value]
        else:
            out.add(f"{at}:text" if isinstance(value, str) else f"{at}:other")
    return out


def _segment(key: str) -> str:
    """A key that can't be taken for a path."""
    return re.sub(r"([\\.:\[\n])", lambda m: f"\\{ord(m[1])}", key)


def fingerprint(fields: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(fields)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def select_mapping(record: object, known: dict[str, Mapping | None]) -> tuple[str, Mapping | None]:
    """The record's fingerprint and mapping; known is what earlier records of the task taught."""
    fields = shape(record)
    key = fingerprint(fields)
    if key not in known:
        known[key] = next((m for m in MAPPINGS if m.fits(fields)), None) if ":object" in fields else None
    return key, known[key]


def _at(record: object, path: str) -> object:
    for k in path.split("."):
        record = record.get(k) if isinstance(record, dict) else None
    return record


def _text(value: object) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def to_turns(record: object, mapping: Mapping) -> list[tuple[str, str]]:
    """Canonical (role, text) turns; null or missing roles and texts are empty, what is neither is written as JSON."""
    turns = []
    for s in mapping.steps:
        value = _at(record, s.path)
        if s.role_field:
            for x in value:
                role = _text(x.get(s.role_field))
                turns.append((dict(s.role_names).get(role, role), _text(x.get(s.text_field))))
        else:
            more = _text(_at(record, s.joined_with)) if s.joined_with else ""
            turns.append((s.role, _text(value) + (f"\n\n{more}" if more else "")))
    return turns


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<")


def escape_role(role: str) -> str:
    return re.sub(r"([\\<>\n])", r"\\\1", role)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[int]]:
    """The training text, and the loss mask as [start, end, ...]: the span of each assistant text."""
    parts, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"<turn:{escape_role(role)}>\n", escape(text)
        if role == "assistant":
            spans += [at + len(head), at + len(head) + len(body)]
        parts += [head, body, "\n</turn>\n"]
        at += len(head) + len(body) + len("\n</turn>\n")
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The inverse of format_turns; raises ValueError for anything that it can't have written."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


FORMATTED = "formatted string, loss_spans array<int>, fingerprint string, layout string"
READ_BACK = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def format_records(records: pd.Series) -> pd.DataFrame:
    """JSON records -> training text, loss mask, fingerprint and layout name.

    A record that is null, no JSON, nested too deeply for the JSON reader, or of a layout
    without a mapping gives null text, spans and layout; the first three also a null
    fingerprint. Halves of surrogate pairs, which no UTF-8 text can hold, become U+FFFD.
    """
    known: dict[str, Mapping | None] = {}
    out = []
    for r in records:
        row = (None, None, None, None)
        if r is not None:
            try:
                record = json.loads(r)
                key, mapping = select_mapping(record, known)
                row = (*(format_turns([(_whole(a), _whole(b)) for a, b in to_turns(record, mapping)]) if mapping else (None, None)), key, mapping and mapping.name)
            except (ValueError, RecursionError):
                pass
        out.append(row)
    return pd.DataFrame(out, columns=["formatted", "loss_spans", "fingerprint", "layout"])


def _whole(text: str) -> str:
    if text.isascii():
        return text
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def read_back(formatted: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """What the formatted text and its mask say, for checking the round trip."""
    out = []
    for text, mask in zip(formatted, spans, strict=True):
        if text is None:
            out.append((None,) * 5)
            continue
        turns = parse_turns(text)
        whole = "".join(f"{role}\n{body}\n" for role, body in turns)
        lost = "".join(unescape(text[a:b]) for a, b in zip(mask[::2], mask[1::2], strict=True))
        out.append((len(turns), _sha(whole), len(lost), _sha(lost), len(text)))
    return pd.DataFrame(out, columns=[c.split()[0] for c in READ_BACK.split(", ")])


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def turn_records(turns: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) -> conv_id and a JSON record, of the layout that the conversation's turns suggest.

    A user's and an assistant's turn make a prompt and a response, with a system's turn
    before them a system prompt; other conversations of these three roles make lists of
    messages or of speakers, by a hash of conv_id, and all others a list of turns.

    A conversation is one training text, so its turns meet in one row. They are put in
    order of turn (null last), then role and text, so that ties and repeated rows have
    one order; every row is a turn. Null texts and roles are empty. Null conv_ids form
    one conversation. Other columns are ignored.
    """
    turn = F.struct(
        F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    roles = F.col("t.role")
    is_ = lambda *names: roles == F.array(*map(F.lit, names))
    text = lambda i, name: F.element_at("t", i)["text"].alias(name)
    listed = lambda name, role, said, names: F.to_json(F.struct(F.transform("t", lambda t: F.struct(names(t["role"]).alias(role), t["text"].alias(said))).alias(name)))
    same = lambda role: role
    speaker = lambda role: F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    usual = F.forall(roles, lambda r: r.isin("user", "assistant", "system"))
    record = (
        F.when(is_("user", "assistant"), F.to_json(F.struct(text(1, "prompt"), text(2, "response"))))
        .when(is_("system", "user", "assistant"), F.to_json(F.struct(text(1, "system"), text(2, "prompt"), text(3, "response"))))
        .when(usual & (F.pmod(F.xxhash64("conv_id"), F.lit(2)) == 0), listed("messages", "role", "content", same))
        .when(usual, listed("conversations", "from", "value", speaker))
        .otherwise(listed("turns", "role", "text", same))
    )
    return ordered.select("conv_id", record.alias("record"))


def format_chat(records: DataFrame) -> DataFrame:
    """records (with a JSON column ``record``) with formatted, loss_spans, fingerprint and layout (columns of those names are replaced)."""
    chat, names = unused("chat", records.columns), [c.split()[0] for c in FORMATTED.split(", ")]
    rows = records.withColumn(chat, F.pandas_udf(format_records, FORMATTED)("record"))
    return rows.withColumns({n: F.col(chat)[n] for n in names}).drop(chat)


CONTROL_CASE = r"\### Assistant: </turn> ok"


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    case = spark.createDataFrame([(-7, 0, "user", CONTROL_CASE), (-7, 1, "assistant", CONTROL_CASE)], "conv_id long, turn long, role string, text string")
    done = format_chat(turn_records(rows.unionByName(case)))
    return done.withColumn("back", F.pandas_udf(read_back, READ_BACK)("formatted", "loss_spans")).select("conv_id", "back.*")


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '<', '')) AS body,
         length(role) + length(regexp_replace(role, '[^\\<>\n]', '', 'g')) AS head FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<turn:>') + 1 + head + body + length('</turn>') + 2) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
