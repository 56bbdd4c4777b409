"""Two readings of one page compared: pairs by likeness, typed differences, merged words."""

from __future__ import annotations

import difflib

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Readings at least this alike are of one thing.
LEAST_ALIKE = 0.72
#: Letters of both scripts that look alike, Latin then Cyrillic.
_LOOKS = str.maketrans("ABCEHKMOPTXaceopxyi", "АВСЕНКМОРТХасеорхуі")


def alike(a: str, b: str) -> float:
    """Share of matching characters of both, 2 * matches / length."""
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def merged_words(a: str, b: str) -> str:
    """The words of ``a`` with those of ``b`` set beside where they differ, as
    ``[left|right]``; what one of them lacks stands alone in the bracket."""
    x, y = a.split(), b.split()
    out = []
    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        out += x[i1:i2] if op == "equal" else ["[" + " ".join(x[i1:i2]) + "|" + " ".join(y[j1:j2]) + "]"]
    return " ".join(out)


def difference(a: str, b: str) -> str:
    """Kind of the difference of two readings, the slightest that explains it."""
    if a == b:
        return "SAME"
    if a.translate(_LOOKS) == b.translate(_LOOKS):
        return "HOMOGLYPH"
    bare = lambda s: regex.sub(r"[^\p{L}\p{N}]", "", s)
    if bare(a) == bare(b):
        return "SPACING"
    if regex.sub(r"\d", "", a) == regex.sub(r"\d", "", b):
        return "NUMBER"
    if bare(a).lower() == bare(b).lower():
        return "CASE"
    return "CHARS"


def compared_readings(stored: DataFrame, read: DataFrame, page: str, ident: str, text: str, least: float = LEAST_ALIKE) -> DataFrame:
    """(page, stored_id, read_id, ratio, kind, merged) of both readers' rows.

    Within a page rows are paired greedily from the most alike pair down to ``least``,
    each once, the smaller ids first at a tie; a row left over is STORED_ONLY or
    READ_ONLY. Null texts take no part. A page is a bounded list of rows, and only
    rows of one page are compared.
    """
    kind = stored.schema[page].dataType.simpleString()
    ids = stored.schema[ident].dataType.simpleString()
    side = lambda df, name: df.where(F.col(text).isNotNull()).select(F.col(page).alias("page"), F.lit(name).alias("side"), F.col(ident).alias("id"), F.col(text).alias("text"))
    both = side(stored, "a").unionByName(side(read, "b"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        a = list(rows[rows["side"] == "a"].sort_values("id")[["id", "text"]].itertuples(index=False))
        b = list(rows[rows["side"] == "b"].sort_values("id")[["id", "text"]].itertuples(index=False))
        tried = []
        for i, x in enumerate(a):
            m = difflib.SequenceMatcher(None, "", x.text, autojunk=False)
            m.set_seq2(x.text)
            for j, y in enumerate(b):
                m.set_seq1(y.text)
                if m.real_quick_ratio() >= least and m.quick_ratio() >= least and (r := alike(x.text, y.text)) >= least:
                    tried.append((-r, i, j))
        left, right, out = set(range(len(a))), set(range(len(b))), []
        at = rows["page"].iloc[0]
        for r, i, j in sorted(tried):
            if i in left and j in right:
                left.remove(i)
                right.remove(j)
                out.append((at, a[i].id, b[j].id, round(-r, 6), difference(a[i].text, b[j].text), merged_words(a[i].text, b[j].text)))
        out += [(at, a[i].id, None, None, "STORED_ONLY", a[i].text) for i in sorted(left)]
        out += [(at, None, b[j].id, None, "READ_ONLY", b[j].text) for j in sorted(right)]
        return pd.DataFrame(out, columns=["page", "stored_id", "read_id", "ratio", "kind", "merged"])

    return both.groupBy("page").applyInPandas(compare, f"page {kind}, stored_id {ids}, read_id {ids}, ratio double, kind string, merged string")
