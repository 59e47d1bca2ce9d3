"""Attachments of mail messages, whose parts nest to any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.lineage import cut

#: A field of a part where it is a JSON string, else null.
_TEXT = "CASE WHEN schema_of_variant(try_variant_get(part, '$.{0}', 'variant')) = 'STRING' THEN try_variant_get(part, '$.{0}', 'string') END"
_NUMBER = "CASE WHEN schema_of_variant(try_variant_get(part, '$.{0}', 'variant')) NOT IN ('STRING', 'BOOLEAN', 'VOID') THEN try_variant_get(part, '$.{0}', 'bigint') END"


def attachments(messages: DataFrame) -> DataFrame:
    """messages (message_id, payload: the JSON tree of parts) -> message_id, place, part_id, filename, mime_type, size, attachment_id.

    An attachment is a part, at any level, with a file name and an id under which it is
    stored apart; contents that stand in the tree are never read. place counts from 1 in
    the order of the tree, a part before those within it. A missing type is that of plain
    bytes, a missing size 0. A payload that is no JSON has no parts.

    Each round takes one level of all trees, so a round works on the messages that are as
    deep as that; a level is written before the next one, and no tree is held anywhere.
    """
    spark = messages.sparkSession
    level = spark.sql("SELECT message_id, CAST(array() AS array<int>) AS path, try_parse_json(payload) AS part FROM {messages}", messages=messages)
    fields = {"part_id": f"coalesce({_TEXT.format('partId')}, '')", "filename": _TEXT.format("filename"), "mime_type": f"coalesce({_TEXT.format('mimeType')}, 'application/octet-stream')", "size": f"coalesce({_NUMBER.format('body.size')}, 0)", "attachment_id": _TEXT.format("body.attachmentId")}
    found = None
    while True:
        level = cut(level)
        if found is not None and level.isEmpty():
            break
        named = level.selectExpr("message_id", "path", *[f"{sql} AS {name}" for name, sql in fields.items()]).where("filename <> '' AND attachment_id <> ''")
        found = named if found is None else found.unionByName(named)
        # Members of an object have keys; only a list holds parts.
        level = spark.sql("SELECT message_id, concat(path, array(inner_part.pos)) AS path, inner_part.value AS part FROM {level}, LATERAL variant_explode(try_variant_get(part, '$.parts', 'variant')) AS inner_part WHERE inner_part.key IS NULL AND inner_part.value IS NOT NULL", level=level)
    return spark.sql("SELECT message_id, CAST(row_number() OVER (PARTITION BY message_id ORDER BY path) AS int) AS place, part_id, filename, mime_type, size, attachment_id FROM {found}", found=found)
