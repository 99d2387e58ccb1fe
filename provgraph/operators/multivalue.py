"""Several values packed in one field: one value per row, position kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provgraph.functions.text import WS, squeeze

# Placeholders are <MARK>index<END>. MARK characters of the data are doubled into <MARK><ESC>
# first, so that no data can look like a placeholder.
_MARK, _END, _ESC = "", "", ""

#: Separators wherever they stand; '/' and '+' separate only between blanks, at an end of the text
#: or beside a quoted value, as in 'A/B' or 'A+B' they belong to the value.
_HARD = r"|;,\t\r\n"
_BEFORE = rf"(?<=\A|[{_HARD}/+{WS}])"
_AFTER = rf"(?=[{WS}]*(?:\z|[{_HARD}/+]))"
_QUOTED = rf"""{_BEFORE}(?:"[^"]*+(?:""[^"]*+)*+"|'[^']*+(?:''[^']*+)*+'){_AFTER}"""
_QUOTED_JSON = rf"""{_BEFORE}"[^"\\]*+(?:\\.[^"\\]*+)*+"{_AFTER}"""
_SPLIT = (
    rf"[{_HARD}]|(?<=\A|[{WS}{_END}])[/+](?=\z|[{WS}{_MARK}])"
    rf"|\A[{WS}]*[/+]|[/+](?=[{WS}]*\z)"
)


def _unquote(span: Column, is_json: Column) -> Column:
    inner = F.substr(span, F.lit(2), F.length(span) - 2)
    plain = F.when(span.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(
        F.replace(inner, F.lit("''"), F.lit("'"))
    )
    # A JSON string is decoded by the JSON reader; text it rejects only loses its backslashes.
    decoded = F.get_json_object(F.concat(F.lit('{"v":'), span, F.lit("}")), "$.v")
    return F.when(is_json, F.coalesce(decoded, F.regexp_replace(inner, r"\\(.)", "$1"))).otherwise(plain)


def split_values(c: Column) -> Column:
    """The array of values packed in `c`.

    Separators are | ; , tab and line break, and / or + between blanks or at an end of the text.
    A value may be in single or double quotes (doubled quotes escape) or all in a JSON array
    (backslash escapes); separators inside quotes belong to the value. Quoted spans are replaced
    by indexed placeholders that no data can imitate, the rest is split, and spans are put back by
    array lookup. Values are squeezed; empty ones dropped. An unclosed quote is ordinary text.
    Null, empty and blank text give an empty array.
    """
    is_json = c.rlike(rf"\A[{WS}]*\[[^\r\n]*\][{WS}]*\z")
    body = F.when(is_json, F.regexp_replace(c, rf"\A[{WS}]*\[[{WS}]*|[{WS}]*\][{WS}]*\z", "")).otherwise(c)
    body = F.regexp_replace(body, rf"\A[{WS}]+|[{WS}]+\z", "")
    body = F.replace(body, F.lit(_MARK), F.lit(_MARK + _ESC))

    def spans_of(pattern: str) -> Column:
        return F.regexp_extract_all(body, F.lit(pattern), F.lit(0))

    def masked_by(pattern: str) -> Column:
        marked = F.transform(F.split(body, pattern), lambda x, i: F.concat(x, F.lit(_MARK), i.cast("string"), F.lit(_END)))
        return F.regexp_replace(F.array_join(marked, ""), rf"{_MARK}[0-9]+{_END}\z", "")

    spans = F.when(is_json, spans_of(_QUOTED_JSON)).otherwise(spans_of(_QUOTED))
    masked = F.when(is_json, masked_by(_QUOTED_JSON)).otherwise(masked_by(_QUOTED))
    whole = rf"\A[{WS}]*{_MARK}([0-9]+){_END}[{WS}]*\z"

    def restore(row: Column, piece: Column) -> Column:
        index = F.regexp_extract(piece, whole, 1)
        span = F.get(row["spans"], index.try_cast("int"))
        text = F.when(index != "", _unquote(span, row["is_json"])).otherwise(piece)
        return squeeze(F.replace(text, F.lit(_MARK + _ESC), F.lit(_MARK)))

    # An expression inside a lambda is evaluated for each element. The spans are bound to a lambda
    # variable, over an array of one, so that they are made once per row and only looked up.
    row = F.struct(spans.alias("spans"), is_json.alias("is_json"), F.split(masked, _SPLIT).alias("pieces"))
    pieces = F.flatten(F.transform(F.array(row), lambda r: F.transform(r["pieces"], lambda x: restore(r, x))))
    return F.coalesce(F.filter(pieces, lambda x: x != ""), F.array().cast("array<string>"))


def explode_values(df: DataFrame, packed: str, keep: list[str], value: str = "value") -> DataFrame:
    """One row per value of column `packed`: `keep`, pos (from 0), `value`."""
    return df.select(*keep, F.posexplode(split_values(F.col(packed))).alias("pos", value))
