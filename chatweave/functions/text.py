"""String expressions whose results must not depend on engine defaults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatweave.functions import fixed_values as fv


def strip(col: Column) -> Column:
    """Trim every Unicode space at both ends (plain ``trim`` only knows U+0020)."""
    return F.btrim(col, F.lit(fv.SPACES))


def clip(col: Column, max_chars: int) -> Column:
    """Stripped text, cut to ``max_chars`` with an ellipsis as the last character."""
    if max_chars <= 0:
        return F.lit("")
    text = strip(F.coalesce(col, F.lit("")))
    return F.when(F.length(text) <= max_chars, text).otherwise(
        F.concat(F.substring(text, 1, max_chars - 1), F.lit("…"))
    )


def blank_to_null(col: Column) -> Column:
    return F.when(strip(col) != "", col)


def sender_to_id(sender: Column, me: list[str] | None = None, them: list[str] | None = None) -> Column:
    """ME / THEM / stripped sender. ME wins; matching ignores case; null stays null."""
    name = strip(sender)
    out = name
    for label, names in (("THEM", them), ("ME", me)):
        if names:
            out = F.when(F.lower(name).isin([n.lower() for n in names]), F.lit(label)).otherwise(out)
    return F.when(sender.isNotNull(), out)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    A lambda reads its outer expressions again for every element. Catalyst may also put the
    definition of a column in place of its name, for example when it moves a filter down. As a
    lambda variable the value stays computed once whatever the optimizer does.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
