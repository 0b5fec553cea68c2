"""Letters of other scripts to Latin: tables that stay in the JVM, for two scripts; others need a kernel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from polyloom.functions.text import is_blank, unicode_trim

_CYRL = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e ë ž z i j k l m n o p r s t u f h c č š ŝ ʺ y ʹ è û â".split()))
_GREK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώϊϋ", "a b g d e z ē th i k l m n x o p r s s t y ph ch ps ō á é ḗ í ó ý ṓ ï ÿ".split()))


def _both_cases(table: dict[str, str]) -> dict[str, str]:
    return table | {k.upper(): v[:1].upper() + v[1:] for k, v in table.items() if k.upper() != k and len(k.upper()) == 1}


SCRIPTS = {"Cyrl": _both_cases(_CYRL), "Grek": {k: v for k, v in _both_cases(_GREK).items() if k != "Σ"} | {"Σ": "S"}}


def _by_table(c: Column, table: dict[str, str]) -> Column:
    """Single letters by one ``translate``; those that become two, by ``replace``."""
    one = {k: v for k, v in table.items() if len(v) == 1}
    c = F.translate(c, "".join(one), "".join(one.values()))
    for k, v in table.items():
        if len(v) > 1:
            c = F.replace(c, F.lit(k), F.lit(v))
    return c


def transliterate(text: Column, script: Column) -> Column:
    """Trimmed and in Latin letters; null for blank or ASCII text, for Latin, and for a script without a table."""
    plain = unicode_trim(text)
    out = F.lit(None).cast("string")
    for code, table in SCRIPTS.items():
        out = F.when(script == code, _by_table(plain, table)).otherwise(out)
    return F.when(~is_blank(text) & ~plain.rlike(r"\A\p{ASCII}*\z"), out)
