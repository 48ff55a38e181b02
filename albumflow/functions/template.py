"""Text templates over columns: ``$Tag``, ``${Group:Tag}``, ``${Tag;expression}``, ``${List@;expression}``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PART = re.compile(r"\$(?:(?P<mark>[$/])|\{(?P<braced>[^}]*)\}|(?P<name>\w+(?::\w+)*#?))")


#: Quoted texts and names of a SQL expression, and the value's own name outside of them.
_TOKEN = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|(?<![\w`'"])_(?![\w`'"])""", re.DOTALL)


class Template:
    """A template for rows with a column a tag.

    ``$$`` is a dollar sign and ``$/`` a line end.  A group before the tag (``EXIF:Make``) names the column ``EXIF:Make`` if
    there is one, else the tag's; ``#`` after it the column of stored values (``Make#``) if there is one.  An
    expression is Spark SQL in which ``_`` is the value, or each item of a list after ``@``; no other code is ever run.
    Names of columns are matched letter case aside; ``params`` are further names with fixed values.
    """

    def __init__(self, text: str, params: dict[str, str] | None = None):
        self.text, self.params = text, {k.lower(): v for k, v in (params or {}).items()}

    def _value(self, rows: DataFrame, inside: str) -> Column:
        name, _, expression = inside.partition(";")
        name, each = name.strip().removesuffix("@"), name.strip().endswith("@")
        have = {c.lower(): c for c in rows.columns}
        plain = name.removesuffix("#")
        options = [name, plain, plain.rpartition(":")[2]]
        own = next((have[o.lower()] for o in options if o.lower() in have), None)
        if own is None:
            fixed = next((self.params[o.lower()] for o in options if o.lower() in self.params), None)
            value = "cast(null as string)" if fixed is None else "'" + fixed.replace("\\", "\\\\").replace("'", "\\'") + "'"
        else:
            value = f"`{own}`"
        if each:
            return F.array_join(F.expr(f"transform({value}, _ -> {expression.strip() or '_'})"), ", ")
        return F.expr(_TOKEN.sub(lambda m: value if m[0] == "_" else m[0], expression) if expression.strip() else value)

    def column(self, rows: DataFrame, missing: str | None = None) -> Column:
        """The text of each row; null where a tag is missing, unless ``missing`` stands for it."""
        parts, at = [], 0
        for m in _PART.finditer(self.text):
            parts.append(F.lit(self.text[at : m.start()]))
            at = m.end()
            if m["mark"]:
                parts.append(F.lit("$" if m["mark"] == "$" else "\n"))
            else:
                value = self._value(rows, m["braced"] if m["braced"] is not None else m["name"])
                kinds = dict(rows.select(value.alias("v")).dtypes)["v"]
                text = F.array_join(value, ", ") if kinds.startswith("array") else value.cast("string")
                parts.append(text if missing is None else F.coalesce(text, F.lit(missing)))
        return F.concat(*parts, F.lit(self.text[at:]))
