"""SQLite-flavoured query text for Spark SQL.

Most differences are settled by session settings (:data:`DIALECT_SETTINGS`) and
by SQL functions (:data:`DIALECT_FUNCTIONS`); the rest are small text rewrites
outside quoted strings. Spark parses and plans the query.
"""

from __future__ import annotations

import re
from collections.abc import Callable

# Division by zero and failed casts give NULL instead of an error.
DIALECT_SETTINGS = {
    "spark.sql.ansi.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

_STRFTIME = "fmt"
for _code, _letters in (
    ("%Y", "yyyy"), ("%m", "MM"), ("%d", "dd"), ("%H", "HH"),
    ("%M", "mm"), ("%S", "ss"), ("%j", "DDD"),
):
    _STRFTIME = f"replace({_STRFTIME}, '{_code}', '{_letters}')"

DIALECT_FUNCTIONS = (
    "CREATE OR REPLACE TEMPORARY FUNCTION strftime(fmt STRING, ts STRING) RETURNS STRING "
    f"RETURN date_format(CAST(ts AS TIMESTAMP), {_STRFTIME})",
    "CREATE OR REPLACE TEMPORARY FUNCTION julianday(ts STRING) RETURNS DOUBLE "
    "RETURN unix_micros(CAST(ts AS TIMESTAMP)) / 86400000000D + 2440587.5D",
)

_QUOTED = re.compile(r"('(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`)")
_NAME = r"(?:\w+\.)?\w+"


def outside_quotes(sql: str, rewrite: Callable[[str], str]) -> str:
    """Apply ``rewrite`` to the parts of ``sql`` that are not quoted."""
    parts = _QUOTED.split(sql)
    return "".join(p if i % 2 else rewrite(p) for i, p in enumerate(parts))


def _quoted_names(sql: str, names: set[str]) -> str:
    """A double-quoted name of the schema is a name, any other one a string."""
    def swap(match: re.Match) -> str:
        text = match.group(0)
        is_name = text.startswith('"') and text[1:-1].lower() in names
        return f"`{text[1:-1]}`" if is_name else text

    return _QUOTED.sub(swap, sql)


def _integer_division(integers: set[str]) -> Callable[[str], str]:
    operand = rf"(count\s*\([^()]*\)|(?<![\w.]){_NAME}(?![\w.(]))"
    pattern = re.compile(rf"{operand}\s*/\s*{operand}", re.IGNORECASE)

    def is_integer(text: str) -> bool:
        text = text.lower()
        return (
            text.startswith("count") and "(" in text
        ) or text.isdigit() or text.split(".")[-1] in integers

    def swap(match: re.Match) -> str:
        left, right = match.groups()
        return f"{left} div {right}" if is_integer(left) and is_integer(right) else match.group(0)

    return lambda text: pattern.sub(swap, text)


def to_spark_sql(sql: str, names: set[str], integers: set[str]) -> str:
    """Rewrite one statement; ``names`` and ``integers`` are lower-case.

    ``names`` are the table and column names of the database, ``integers`` its
    columns of integer type.
    """
    text = re.sub(r";\s*\Z", "", sql.strip())
    text = _quoted_names(text, names)
    rules = [
        (r"\bnot\s+like\b", "NOT ILIKE"),
        (r"\blike\b", "ILIKE"),
        (r"\biif\s*\(", "if("),
        (r"\bgroup_concat\s*\(\s*((?:distinct\s+)?[^(),]+?)\s*\)", r"listagg(\1, ',')"),
        (r"\bgroup_concat\s*\(", "listagg("),
    ]
    for pattern, new in rules:
        text = outside_quotes(
            text, lambda part, p=pattern, n=new: re.sub(p, n, part, flags=re.IGNORECASE)
        )
    text = outside_quotes(text, _integer_division(integers))
    if re.search(r"\bfrom\s*\Z", text, re.IGNORECASE):
        raise ValueError("syntax error: incomplete FROM clause")
    return text


def any_value_of(sql: str, column: str) -> str | None:
    """Wrap the first selected use of ``column`` that no aggregate covers.

    SQLite lets a select list name a column that is not grouped and takes it
    from an arbitrary row. None if there is nothing to wrap.
    """
    name = column.strip("`").split(".")[-1].replace("`", "")
    pattern = re.compile(
        rf"(select\s+(?:distinct\s+)?(?:[^()]|\([^()]*\))*?)(?<![\w.`(])((?:\w+\.)?`?{re.escape(name)}`?)(?![\w(`])",
        re.IGNORECASE,
    )
    changed, n = pattern.subn(r"\1any_value(\2)", sql, count=1)
    return changed if n and changed != sql else None
