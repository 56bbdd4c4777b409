"""Mentions of a closed vocabulary in running text: passes, claims, fallbacks."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.names import declined, title_key, word_stem
from vellum.operators.sizing import lookup
from vellum.session import materialize, settled

_QUOTE = regex.compile(r"«([^»\n]+)»")
#: Titles before a name.
_HONORED = regex.compile(r"(?<!\p{L})(?:г-жа|г-жи|г-нъ|г-на|гг?\.|Mrs?\.?|Miss|Mme|Mlle|Herr|Frau)\s+(?:\p{Lu}\.\s*)*(\p{Lu}[\p{L}’'-]+)")
_BARE = regex.compile(r"(?<!\p{L})\p{Lu}\p{Ll}{2,}(?!\p{L})")
_SPAN = T.ArrayType(
    T.StructType([T.StructField("pass", T.StringType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("said", T.StringType()), T.StructField("quote", T.IntegerType())])
)


@F.pandas_udf(_SPAN)
def _spans(texts: pd.Series) -> pd.Series:
    """Spans that could be mentions, with the pass they belong to and the quotation they
    lie in. A name behind a title is claimed by its pass, so that it is no bare word."""

    def of(text: str | None) -> list[tuple]:
        if not text:
            return []
        quotes = [m.span(1) for m in _QUOTE.finditer(text)]
        out = [("quoted", a, b, text[a:b], i) for i, (a, b) in enumerate(quotes)]
        inside = lambda at: next((i for i, (a, b) in enumerate(quotes) if a <= at < b), None)
        claimed = set()
        for m in _HONORED.finditer(text):
            claimed.add(m.start(1))
            out.append(("honoured", *m.span(1), m[1], inside(m.start(1))))
        out += [("bare", *m.span(), m[0], inside(m.start())) for m in _BARE.finditer(text) if m.start() not in claimed]
        return out

    return texts.map(of)


def name_lexicon(names: DataFrame, name: str, entity: str) -> DataFrame:
    """(form, rank, method, entity): surnames as they are, in other cases, and by stem;
    a form of several entities means the smallest."""
    base = names.where(F.col(name).isNotNull()).select(F.col(name).alias("n"), F.col(entity).alias("e")).distinct()
    exact = base.select(F.col("n").alias("form"), F.lit(0).alias("rank"), F.lit("exact").alias("method"), "e")
    cases = base.select(F.explode(declined(F.col("n"))).alias("form"), F.lit(1).alias("rank"), F.lit("declined").alias("method"), "e")
    stems = base.select(word_stem(F.col("n")).alias("form"), F.lit(2).alias("rank"), F.lit("stem").alias("method"), "e").where(F.length("form") >= 4)
    return exact.unionByName(cases).unionByName(stems).groupBy("form", "rank", "method").agg(F.min("e").alias("entity"))


@settled
def text_mentions(texts: DataFrame, key: str, text: str, titles: DataFrame, title: str, title_id: str, names: DataFrame, name: str, name_id: str) -> DataFrame:
    """(key, kind, char_start, char_end, surface, entity, method, confidence) (M1).

    Pass one: quoted titles by their key. Pass two: names behind a title of address.
    Pass three: bare capitalised words. A matched quotation claims its words; a name of
    pass two isn't taken again in pass three. Names are looked up as they are, then in
    other cases, then by stem. Offsets count code points; null and blank texts hold
    nothing, repeated rows give their mentions once. Nothing is compared but by equality.
    """
    spans = texts.select(F.col(key), F.explode(_spans(F.col(text))).alias("s")).select(key, "s.*").distinct()
    spans = materialize(spans)
    works = materialize(titles.where(F.col(title).isNotNull()).groupBy(title_key(F.col(title)).alias("form")).agg(F.min(title_id).alias("entity")).where("form <> ''"))
    lex = materialize(name_lexicon(names, name, name_id))
    quoted = spans.where("pass = 'quoted'").withColumn("form", title_key(F.col("said"))).join(lookup(works), "form").drop("form").withColumn("method", F.lit("exact"))
    quoted = materialize(quoted)
    free = spans.where("pass <> 'quoted'").join(quoted.select(key, "quote").distinct(), [key, "quote"], "left_anti")
    tried = free.withColumn("t", F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), c.alias("form")) for r, c in enumerate((F.col("said"), F.col("said"), word_stem(F.col("said"))))])))
    met = tried.select(*free.columns, "t.rank", "t.form").join(lookup(lex), ["form", "rank"])
    best = met.groupBy(*free.columns).agg(F.min(F.struct("rank", "method", "entity")).alias("m")).select(*free.columns, F.col("m.entity").alias("entity"), F.col("m.method").alias("method"))
    both = quoted.withColumn("kind", F.lit("work")).unionByName(best.withColumn("kind", F.lit("person")))
    sure = F.when(F.col("pass") == "bare", F.when(F.col("method") == "exact", "medium").otherwise("low")).otherwise(F.when(F.col("method") == "stem", "medium").otherwise("high"))
    return both.select(key, "kind", F.col("a").alias("char_start"), F.col("b").alias("char_end"), F.col("said").alias("surface"), "entity", "method", sure.alias("confidence"))
