"""Schema descriptions as prompt text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from askgauge.functions.text import first_filled, or_blank

ITEMS_TYPE = (
    "array<struct<table_name: string, table_comment: string, column_names: array<string>,"
    " column_types: array<string>, column_comments: array<string>, pk_indicators: array<int>>>"
)
SCHEMA_TYPE = f"struct<schema_items: {ITEMS_TYPE}, foreign_keys: array<array<string>>>"


def column_text(name: Column, kind: Column, comment: Column, is_key: Column) -> Column:
    """``name (type: t; comment: c; primary key)``; empty parts are left out."""
    said = lambda col, label: F.when(or_blank(col) != "", F.concat(F.lit(label), col))
    notes = F.filter(
        F.array(
            said(kind, "type: "),
            said(comment, "comment: "),
            F.when(F.coalesce(is_key, F.lit(0)) != 0, F.lit("primary key")),
        ),
        lambda n: n.isNotNull(),
    )
    return F.when(
        F.size(notes) > 0, F.concat(name, F.lit(" ("), F.array_join(notes, "; "), F.lit(")"))
    ).otherwise(name)


def _table_text(item: Column) -> Column:
    columns = F.transform(
        F.coalesce(item["column_names"], F.array().cast("array<string>")),
        lambda name, i: column_text(
            name,
            F.get(item["column_types"], i),
            F.get(item["column_comments"], i),
            F.get(item["pk_indicators"], i),
        ),
    )
    comment = or_blank(item["table_comment"])
    title = F.concat(
        F.lit("Table "),
        F.coalesce(first_filled(item["table_name"]), F.lit("unknown_table")),
        F.when(comment != "", F.concat(F.lit(" ("), comment, F.lit(")"))).otherwise(""),
    )
    return F.when(
        F.size(columns) > 0,
        F.concat(title, F.lit(" has columns: "), F.array_join(columns, ", "), F.lit(".")),
    ).otherwise(F.concat(title, F.lit(" has no columns listed.")))


def schema_text(schema: Column) -> Column:
    """All tables, then the foreign keys that have exactly four parts."""
    tables = F.transform(
        F.coalesce(schema["schema_items"], F.from_json(F.lit("[]"), ITEMS_TYPE)),
        _table_text,
    )
    links = F.transform(
        F.filter(
            F.coalesce(schema["foreign_keys"], F.array().cast("array<array<string>>")),
            lambda k: F.size(k) == 4,
        ),
        lambda k: F.concat(k[0], F.lit("."), k[1], F.lit(" -> "), k[2], F.lit("."), k[3]),
    )
    keys = F.when(
        F.size(links) > 0,
        F.array(F.concat(F.lit("Foreign keys: "), F.array_join(links, ", "), F.lit("."))),
    ).otherwise(F.array().cast("array<string>"))
    return F.trim(F.array_join(F.concat(tables, keys), " "))


def record_prompt(question: Column, text: Column, schema: Column) -> Column:
    """``Question: q Schema: s``; null unless both parts are filled."""
    asked = first_filled(question, text)
    described = F.when(schema.isNotNull(), F.nullif(schema_text(schema), F.lit("")))
    return F.concat(F.lit("Question: "), asked, F.lit(" Schema: "), described)
