"""Column-level text helpers built only from Spark SQL functions (see ``sqltext``
for the SQL-text builders the detectors use).

Offsets are **character** offsets (Spark ``substring``/``length`` count code
points); byte lengths, where the semantics need them, come from
``octet_length``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakroom.functions.sqltext import PIECE

UPPER = string.ascii_uppercase
LOWER = string.ascii_lowercase

# Alphanumeric in the Unicode sense (alphabetic or numeric), as a Java class.
ALNUM_CLASS = r"[\p{IsAlphabetic}\p{N}]"
NON_ALNUM_RUN = r"[^\p{IsAlphabetic}\p{N}]+"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character (and the length) is kept."""
    return F.translate(c, UPPER, LOWER)


def ascii_upper(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


def java_quote(s: str) -> str:
    """Literal-quote a string for a Java regex (same rule as Pattern.quote)."""
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def let(bindings: dict[str, Column], body) -> Column:
    """Evaluate each binding once per row and pass them to ``body`` as fields.

    ``transform`` over a one-element array acts as a let: the array is built
    once, and the lambda reads its fields, so expensive expressions such as a
    regex scan are not re-evaluated where the body references them twice.
    """
    packed = F.array(F.struct(*[v.alias(k) for k, v in bindings.items()]))
    return F.element_at(F.transform(packed, body), 1)


def pieces(text: Column) -> Column:
    """A text as pieces of equal length, for ``cut``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), 0)


def cut(parts: Column, at: Column, n: Column) -> Column:
    """``n`` characters of a text behind ``at``, of the ``pieces`` that hold them (``substring`` counts from the text's beginning)."""
    first, last = F.floor(at / PIECE), F.floor((at + n) / PIECE)
    near = F.array_join(F.slice(parts, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
    return F.substring(near, at % PIECE + 1, n)


def explode_rows(df, arr: Column, keep: list, pos: str = "pos", item: str = "item"):
    """One row per element of ``arr`` (rows with an empty array vanish).

    Uses ``posexplode_outer`` + a null filter rather than ``explode``: for a
    plain explode Catalyst infers ``size(arr) > 0`` and pushes it below the
    projection, which would evaluate an expensive ``arr`` (a detector) twice.
    """
    g = df.select(*keep, F.posexplode_outer(arr).alias(pos, item))
    return g.where(F.col(pos).isNotNull())
