"""Delimited rows that fail to parse: separate them with reasons, load the sound ones.

For each schema one anchored regex describes a whole valid row. Only rows that don't match it are
taken through incremental field-prefix patterns (the first k fields, for k = 1, 2, ...), which tell
the first broken field and the reasons. All patterns use possessive quantifiers: matching is linear
and needs no stack, also for very long rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provgraph.functions.text import NUMBER, NUMBER_NOT_NEGATIVE, WS

#: One RFC 4180 field: quoted, or bare without quotes and commas.
FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
_ALNUM = r"\p{L}\p{Nd}"


@dataclass(frozen=True)
class RowField:
    """A column of a delimited row; `valid` is a regex for the whole field, `reason` its failure,
    `nullable` makes an empty field null when loaded."""

    name: str
    valid: str | None = None
    reason: str | None = None
    nullable: bool = False


def _either(content: str) -> str:
    """A pattern without quotes or commas, for the bare and the quoted writing of a field."""
    pad = f"[{WS}]*+"
    return f'(?:"{pad}(?:{content}){pad}"|{pad}(?:{content}){pad})'


def number_field(name: str, reason: str, not_negative: bool = False) -> RowField:
    """A finite decimal number, blanks around it allowed."""
    return RowField(name, _either(NUMBER_NOT_NEGATIVE if not_negative else NUMBER), reason)


def enum_field(name: str, reason: str, values: list[str]) -> RowField:
    """One of `values`, blanks around it and any case allowed."""
    return RowField(name, _either("(?iu:" + "|".join(values) + ")"), reason)


def alnum_field(name: str, reason: str) -> RowField:
    """Text with at least one letter or digit."""
    quoted = rf'"(?:[^"{_ALNUM}]++|"")*+[{_ALNUM}][^"]*+(?:""[^"]*+)*+"'
    return RowField(name, rf'(?:{quoted}|[^",{_ALNUM}]*+[{_ALNUM}][^",]*+)', reason)


def valid_row_pattern(schema: list[RowField]) -> str:
    """The anchored regex of a whole valid row."""
    return r"\A" + ",".join(f.valid or FIELD for f in schema) + r"\z"


def structure_pattern(schema: list[RowField]) -> str:
    """A row of sound quoting with the right number of fields; one group per field."""
    return r"\A" + ",".join(f"({FIELD})" for _ in schema) + r"\z"


def _prefix(fields: list[str]) -> str:
    return r"\A" + ",".join(fields) + r"(?:,|\z)"


def parse_rows(df: DataFrame, raw: str, schema: list[RowField]) -> DataFrame:
    """`df` with `_reasons` (array, empty for a valid row) and `_broken_field` (its position from
    1, null for a valid row; one more than the number of fields where there are too many).

    'quoting' stands alone, else 'column_count' stands alone, else one reason per invalid field.
    A null row is a row of one empty field. Text of any length is taken whole.
    """
    row = F.coalesce(F.col(raw), F.lit(""))
    ok = row.rlike(valid_row_pattern(schema))
    quoting_ok = row.rlike(rf"\A{FIELD}(?:,{FIELD})*+\z")
    count_ok = row.rlike(structure_pattern(schema).replace(f"({FIELD})", FIELD))
    each: list[Column] = []
    typed_break = F.lit(None).cast("int")
    prefix_break = F.lit(len(schema) + 1)
    for k in range(len(schema), 0, -1):
        f = schema[k - 1]
        prefix_break = F.when(~row.rlike(_prefix([FIELD] * k)), F.lit(k)).otherwise(prefix_break)
        if f.valid:
            bad = ~row.rlike(_prefix([FIELD] * (k - 1) + [f.valid]))
            each.insert(0, F.when(bad, F.lit(f.reason)))
            typed_break = F.when(bad, F.lit(k)).otherwise(typed_break)
    none = F.array().cast("array<string>")
    reasons = (
        F.when(ok, none)
        .when(~quoting_ok, F.array(F.lit("quoting")))
        .when(~count_ok, F.array(F.lit("column_count")))
        .otherwise(F.array_compact(F.array(*each)) if each else none)
    )
    broken = F.when(ok, F.lit(None).cast("int")).when(quoting_ok & count_ok, typed_break).otherwise(prefix_break)
    return df.withColumn("_reasons", reasons).withColumn("_broken_field", broken)


def rejects(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """One row per failing row and reason: `keep`, reason, broken_field."""
    return parsed.where(F.size("_reasons") > 0).select(
        *keep, F.explode("_reasons").alias("reason"), F.col("_broken_field").alias("broken_field")
    )


def loaded(parsed: DataFrame, raw: str, schema: list[RowField], keep: list[str]) -> DataFrame:
    """The valid rows with their fields as columns, unquoted; an empty field of a nullable column is null."""
    pattern = structure_pattern(schema)
    columns = []
    for k, f in enumerate(schema, 1):
        x = F.regexp_extract(raw, pattern, k)
        inner = F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
        value = F.when(x.startswith('"'), inner).otherwise(x)
        columns.append((F.when(value != "", value) if f.nullable else value).alias(f.name))
    return parsed.where(F.size("_reasons") == 0).select(*keep, *columns)
