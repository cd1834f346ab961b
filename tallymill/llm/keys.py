"""Spelling keys as Spark expressions: width, case, white space, invisible characters, marks."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that print nothing or only space, as a class of Java's regular expressions.
UNSEEN = r"[\p{Z}\p{C}\s\u034F\u115F\u1160\u17B4\u17B5\u180B-\u180F\u2800\u3164\uFE00-\uFE0F\uFFA0]"


def _widths() -> tuple[str, str]:
    """Every wide or narrow form that stands for one other character, by the Unicode data."""
    wide, plain = [], []
    for cp in range(0x3000, 0x10000):
        kind, _, rest = unicodedata.decomposition(chr(cp)).partition(" ")
        if kind in ("<wide>", "<narrow>") and " " not in rest:
            wide.append(chr(cp))
            plain.append(chr(int(rest, 16)))
    return "".join(wide), "".join(plain)


WIDE, PLAIN = _widths()


def one_width(c: Column) -> Column:
    return F.translate(c, WIDE, PLAIN)


def folded(c: Column) -> Column:
    """Without differences of width, case (upper first, so that ß equals SS), and unseen characters."""
    return F.regexp_replace(F.lower(F.upper(one_width(c))), UNSEEN, "")


def letters_only(c: Column) -> Column:
    """Folded, letters and digits only."""
    return F.regexp_replace(folded(c), r"[^\p{L}\p{N}]", "")


def group_key(value: Column, item_id: Column) -> Column:
    """The name of a group, whatever the spelling of ``<data set><marks><key>``.

    The data set ends at the first run of marks that holds one other than ``_`` and ``-``. If there
    is none, the data set is that of the item, when the value begins with it; else it ends at the
    first mark. Marks inside the data set's name are dropped, those inside the key stay.
    """
    v = folded(value)
    strong = r"^([\p{L}\p{N}][\p{L}\p{N}_\-]*?)[_\-]*[^\p{L}\p{N}_\-][^\p{L}\p{N}]*(.*)$"
    weak = r"^([\p{L}\p{N}]+)[_\-]+(.*)$"
    own = F.regexp_replace(F.regexp_extract(folded(item_id), r"^([^:/|]+)", 1), r"[^\p{L}\p{N}]", "")
    with_own = F.concat(F.lit("^"), F.regexp_replace(own, r"(.)", r"$1[_\\-]*"), F.lit("(.*)$"))
    bare = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]", "")
    return (
        F.when(v.rlike(strong), F.concat(bare(F.regexp_extract(v, strong, 1)), F.lit(":"), F.regexp_extract(v, strong, 2)))
        .when(
            (own != "") & bare(v).startswith(own) & (F.length(bare(v)) > F.length(own)),
            F.concat(own, F.lit(":"), F.call_function("regexp_extract", v, with_own, F.lit(1))),
        )
        .when(v.rlike(weak), F.concat(F.regexp_extract(v, weak, 1), F.lit(":"), F.regexp_extract(v, weak, 2)))
        .otherwise(v)
    )
