"""YAML headers of result files, parsed by column expressions: keys, raw values and their YAML types.

Headers stand in comments ('#' or '%' before each line, 'comment "..."' in graph files), as one flow map or as one
'key: value' line each. A header counts only if the whole of it is one such map.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUOTED = r"""'(?:[^']|'')*+'|"(?:[^"\\]|\\.)*+\""""
BARE_KEY = r"[^\s,\[\]{}#&*!|>'\"%@`:?\-](?:[^,\[\]{}:\n]|:(?![\s,}]|$))*+"
LIST = r"\[(?:'[^'\n]*+'|\"[^\"\n]*+\"|[^\[\]'\"{}\n])*+\]"
FLOW_VALUE = rf"{LIST}|{QUOTED}|[^\s,\[\]{{}}'\"](?:[^,\[\]{{}}\n:]|:(?!\s))*+|"
LINE_VALUE = rf"{LIST}|{QUOTED}|[^\s\[\]{{}}'\",#%&*!|>@`](?:[^\n:#]|:(?!\s)|(?<!\s)#)*+|"
FLOW_PAIR = rf"({QUOTED}|{BARE_KEY})\s*:(?=[\s,}}])\s*+({FLOW_VALUE})"
LINE_PAIR = rf"({QUOTED}|{BARE_KEY})[ \t]*:(?=\s|$)[ \t]*+({LINE_VALUE})"
FLOW_MAP = rf"^\{{\s*+(?:{FLOW_PAIR}\s*+(?:,\s*+(?=[^\s}}])|,?\s*+(?=\}}$)))*+\}}$"
LINE_MAP = rf"^(?:{LINE_PAIR}[ \t]*+(?:\n+|$))++$"

# How YAML 1.1 reads plain scalars.
NULL = r"^(~|null|Null|NULL|)$"
BOOLEAN = r"^(yes|Yes|YES|no|No|NO|true|True|TRUE|false|False|FALSE|on|On|ON|off|Off|OFF)$"
INTEGER = r"^([-+]?0b[0-1_]+|[-+]?0[0-7_]+|[-+]?(0|[1-9][0-9_]*)|[-+]?0x[0-9a-fA-F_]+|[-+]?[1-9][0-9_]*(:[0-5]?[0-9])+)$"
FLOAT = r"^([-+]?[0-9][0-9_]*\.[0-9_]*([eE][-+][0-9]+)?|\.[0-9][0-9_]*([eE][-+][0-9]+)?|[-+]?[0-9][0-9_]*(:[0-5]?[0-9])+\.[0-9_]*|[-+]?\.(inf|Inf|INF)|\.(nan|NaN|NAN))$"


def body(header: Column) -> Column:
    """The header without comment marks, blank lines and surrounding blanks."""
    graph = F.regexp_extract(header, r"(?s)^\s*comment\s+\"(.*)\"\s*$", 1)
    lines = F.regexp_replace(F.regexp_replace(header, r"\r", ""), r"(?m)^[ \t]*[#%]++ ?", "")
    text = F.when(header.rlike(r"^\s*comment\s"), graph).otherwise(lines)
    return F.regexp_replace(F.regexp_replace(text, r"(?m)^[ \t]*\n", ""), r"^\s+|\s+$", "")


def unquote(s: Column) -> Column:
    """A scalar without its quotes."""
    inner = F.substring(s, F.lit(2), F.greatest(F.length(s) - 2, F.lit(0)))
    single, double = F.regexp_replace(inner, "''", "'"), F.regexp_replace(inner, r"\\(.)", "$1")
    return F.when(s.startswith("'"), single).when(s.startswith('"'), double).otherwise(s)


def type_tag(raw: Column) -> Column:
    """integer, float, boolean, string or list by YAML 1.1; null for null."""
    s = F.trim(raw)
    return (
        F.when(s.startswith("["), "list").when(s.startswith("'") | s.startswith('"'), "string").when(s.rlike(NULL), None)
        .when(s.rlike(BOOLEAN), "boolean").when(s.rlike(INTEGER), "integer").when(s.rlike(FLOAT), "float").otherwise("string")
    )


def typed_value(raw: Column, tag: str) -> Column:
    """A value of the given type_tag as BIGINT, DOUBLE, BOOLEAN, STRING or ARRAY<STRING>; null where that can't hold it.

    Integers may be hexadecimal, octal, binary or base 60 and have '_' between digits, as in YAML 1.1.
    """
    s = F.trim(raw)
    plain = F.regexp_replace(s, "[_+]", "")
    sign = F.when(plain.startswith("-"), F.lit(-1)).otherwise(F.lit(1)).cast("bigint")
    bare = F.regexp_replace(plain, "^-", "")

    def based(prefix: str, base: int) -> Column:
        return sign * F.conv(F.regexp_replace(bare, f"^{prefix}", ""), base, 10).try_cast("bigint")

    if tag == "integer":
        sixty = F.aggregate(F.split(bare, ":"), F.lit(0).cast("bigint"), lambda acc, x: acc * 60 + x.try_cast("bigint"))
        return F.when(bare.rlike("^0x"), based("0x", 16)).when(bare.rlike("^0b"), based("0b", 2)).when(bare.rlike("^0[0-7]+$"), based("0", 8)).when(bare.contains(":"), sign * sixty).otherwise(plain.try_cast("bigint"))
    if tag == "float":
        sixty = F.aggregate(F.split(bare, ":"), F.lit(0.0), lambda acc, x: acc * 60 + x.try_cast("double"))
        low = F.lower(bare)
        return F.when(low == ".inf", sign * F.lit(float("inf"))).when(low == ".nan", F.lit(float("nan"))).when(bare.contains(":"), sign * sixty).otherwise(plain.try_cast("double"))
    if tag == "boolean":
        return F.when(s.rlike(BOOLEAN), F.lower(s).isin("yes", "true", "on"))
    if tag == "list":
        inner = F.regexp_extract_all(F.substring(s, F.lit(2), F.length(s) - 2), F.lit(rf"({QUOTED}|[^,\[\]]+)"), F.lit(1))
        return F.filter(F.transform(inner, lambda x: unquote(F.trim(x))), lambda x: x != "")
    return unquote(s)


def pairs(b: Column) -> Column:
    """ARRAY<STRUCT<key, raw>> of a header's body in the order written; null if it is not one complete map.

    Keys come without quotes and surrounding blanks, values as written. '{}' is the empty array.
    """
    flow, line = b.rlike(FLOW_MAP), b.rlike(LINE_MAP)

    def both(pattern: str) -> Column:
        keys, values = F.regexp_extract_all(b, F.lit(pattern), F.lit(1)), F.regexp_extract_all(b, F.lit(pattern), F.lit(2))
        return F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda e: F.struct(F.trim(unquote(F.trim(e["k"]))).alias("key"), F.trim(e["v"]).alias("raw")))

    return F.when(flow, both(rf"(?<=[{{,])\s*+{FLOW_PAIR}")).when(line, both(rf"(?m)^{LINE_PAIR}"))
