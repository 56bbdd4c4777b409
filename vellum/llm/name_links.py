"""Linking the spellings of one person by a noisy channel.

Frequent spellings are ranked as candidate canonical forms: a person is a surname
with the initials of the given names, weighted by how many different spellings and
rows show it. Every other spelling is taken as such a form gone through slips of the
typist (edits of the surname), abbreviation (initials, familiar forms, cut words,
ordinals) or transliteration, and is attached to the candidate of the highest
posterior: log prior of the candidate minus the cost of what the channel did. A
spelling that explains itself best stays a canonical form of its own.

Rows are first reduced to distinct spellings, so a name on a third of all rows is
one row from then on. Candidates meet on symmetric deletions of the surname.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.canonical_list import deletions, edit_distance
from vellum.llm.charforms import consistent
from vellum.llm.name_parts import first_names, folded_surname, initial, parse
from vellum.operators.matching import final_of_chain
from vellum.session import materialize, settled

#: Costs of the channel, in units of log probability.
EDIT_COST = {0: 0.0, 1: 0.6, 2: 1.5}
#: The same where both initials agree, which two persons with alike surnames rarely share.
SURE_EDIT_COST = {0: 0.0, 1: 0.25, 2: 0.6}
#: Weight of rows against different spellings in the prior of a candidate.
ROW_WEIGHT = 0.1
CUT_COST, SHORT_COST, LATIN_COST = 0.4, 0.3, 0.3
#: Shortest surname that may hold one slip, and two.
ONE_SLIP, TWO_SLIPS = 5, 8
#: A bare surname that fits several persons goes to the best only if its posterior
#: exceeds the next one's by this much.
MARGIN = 0.7

_PARTS = T.StructType(
    [
        T.StructField("sur", T.StringType()),
        T.StructField("lat", T.StringType()),
        T.StructField("foreign", T.BooleanType()),
        T.StructField("cut", T.BooleanType()),
        T.StructField("gender", T.StringType()),
        T.StructField("inits", T.ArrayType(T.StringType())),
        T.StructField("first", T.StringType()),
        T.StructField("pi", T.StringType()),
        T.StructField("ord", T.StringType()),
    ]
)


@F.pandas_udf(_PARTS)
def _parts(forms: pd.Series) -> pd.DataFrame:
    rows = []
    for form in forms:
        n = parse(form)
        if n is None:
            rows.append((None, None, False, False, "", [], "", "", ""))
            continue
        fold, foreign = folded_surname(form, n)
        inits = sorted({initial(f) for f in (first_names(n.first) if n.first_kind == "full" else [n.first])}) if n.first else []
        rows.append((fold, n.surname, foreign, n.cut, n.gender, inits, n.first if n.first_kind == "full" else "", initial(n.patronymic), n.ordinal))
    return pd.DataFrame(rows, columns=_PARTS.fieldNames())


def spellings(values: DataFrame, value: str) -> DataFrame:
    """Distinct spellings with their parts: (value, n, form, sur, ...). Nulls and
    values without a surname are left out."""
    counted = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    formed = counted.withColumn("form", F.trim(consistent(F.col("value"))))
    return formed.withColumn("p", _parts(F.col("form"))).select("value", "n", "form", "p.*").where("sur is not null")


def _slips(length: Column) -> Column:
    return F.when(length >= TWO_SLIPS, 2).when(length >= ONE_SLIP, 1).otherwise(0)


def _near_surnames(a: DataFrame, b: DataFrame) -> DataFrame:
    """(sur, other, d) for surnames of ``a`` and ``b`` within the slips allowed."""
    left = a.select("sur").distinct().select("sur", F.explode(deletions(F.col("sur"), _slips(F.length("sur")))).alias("key"))
    right = b.select(F.col("sur").alias("other")).distinct().select("other", F.explode(deletions(F.col("other"), _slips(F.length("other")))).alias("key"))
    # exploded keys outgrow what the planner expects of the files: never broadcast them
    met = left.join(right.hint("merge"), "key").select("sur", "other").distinct().withColumn("d", edit_distance(F.col("sur"), F.col("other")))
    return met.where(F.col("d") <= F.least(_slips(F.length("sur")), _slips(F.length("other"))))


def _cost(d: Column, sure: Column) -> Column:
    usual = F.when(d == 0, EDIT_COST[0]).when(d == 1, EDIT_COST[1]).otherwise(EDIT_COST[2])
    return F.when(sure, F.when(d == 0, SURE_EDIT_COST[0]).when(d == 1, SURE_EDIT_COST[1]).otherwise(SURE_EDIT_COST[2])).otherwise(usual)


@settled
def attribute_names(values: DataFrame, value: str) -> DataFrame:
    """(value, person): every distinct spelling with the canonical form it is
    attributed to; ``person`` is a key of surname and initials.

    Nulls, blanks and values without letters are left out, repeated rows only raise
    a spelling's weight, ties go to the alphabetically first candidate, and an empty
    table gives an empty one.
    """
    told = materialize(spellings(values, value))
    forms = told.groupBy("form", "sur", "lat", "foreign", "cut", "gender", "inits", "first", "pi", "ord").agg(F.sum("n").alias("n"))
    forms = materialize(forms.withColumn("whole", ~F.col("foreign") & ~F.col("cut") & (F.size("inits") == 1)))

    # candidates: surname and initials, as shown by whole spellings
    keyed = forms.where("whole").withColumn("fi", F.get("inits", F.lit(0)))
    full = keyed.where("pi <> ''").groupBy("sur", "lat", "fi", "pi").agg(
        F.count("*").alias("v"), F.sum("n").alias("n"), F.max_by("first", F.when(F.col("first") != "", F.col("n"))).alias("first"), F.max("gender").alias("gender")
    )
    half = (
        keyed.where("pi = ''")
        .join(full.select("sur", "fi").distinct(), ["sur", "fi"], "left_anti")
        .groupBy("sur", "lat", "fi")
        .agg(F.count("*").alias("v"), F.sum("n").alias("n"), F.max("first").alias("first"), F.max("gender").alias("gender"))
        .withColumn("pi", F.lit(""))
    )
    people = full.unionByName(half).withColumn("person", F.concat_ws("|", "sur", "fi", "pi"))
    ordinals = (
        keyed.where("ord <> ''").groupBy("sur", "fi").agg(F.max_by("ord", "n").alias("ord"))
    )
    # spellings without the second initial count for the persons who have one
    extra = keyed.where("pi = ''").groupBy("sur", "fi").agg(F.count("*").alias("v2"), F.sum("n").alias("n2"))
    people = (
        people.join(ordinals, ["sur", "fi"], "left")
        .join(extra, ["sur", "fi"], "left")
        .withColumn("v2", F.when(F.col("pi") != "", F.col("v2")))
        .withColumn("n2", F.when(F.col("pi") != "", F.col("n2")))
        .withColumn("prior", F.log(F.col("v") + F.coalesce("v2", F.lit(0))) + ROW_WEIGHT * F.log(F.col("n") + F.coalesce("n2", F.lit(0))))
        .drop("v", "n", "v2", "n2")
    )
    people = materialize(people)

    # candidates that are themselves slips of better ones
    near = materialize(_near_surnames(people, people))
    other = people.select(*[F.col(c).alias(c + "_c") for c in people.columns])
    rival = (
        people.join(near, "sur")
        .join(other, (F.col("other") == F.col("sur_c")) & (F.col("fi") == F.col("fi_c")))
        .where((F.col("pi") == F.col("pi_c")) | (F.col("pi") == "") | (F.col("pi_c") == ""))
        .where("gender = '' or gender_c = '' or gender = gender_c")
        .withColumn("post", F.col("prior_c") - _cost(F.col("d"), (F.col("pi") == F.col("pi_c")) & (F.col("pi") != "")))
    )
    best = materialize(rival.groupBy("person").agg(F.max(F.struct("post", "prior_c", "person_c")).alias("b")).select("person", F.col("b.person_c").alias("to")))
    # a slip of a slip: to the end of the chain, however long; raises if there is none
    ends = final_of_chain(best.where("person <> to"), "person", "to").select("person", "final")
    up = best.join(ends, "person", "left").select("person", F.coalesce("final", "to").alias("to"))
    up = materialize(up)

    # every spelling to its best candidate
    canon = people.join(up.where("person = to").select("person"), "person", "left_semi").select(*[F.col(c).alias(c + "_c") for c in people.columns])
    canon = materialize(canon)
    direct = forms.where("whole and pi <> ''").select("form", F.concat_ws("|", "sur", F.get("inits", F.lit(0)), "pi").alias("person")).join(up, "person").select("form", F.col("to").alias("person"))
    loose = forms.where("not (whole and pi <> '')").drop("whole")
    russian = loose.where("not foreign").join(_near_surnames(loose.where("not foreign"), canon.select(F.col("sur_c").alias("sur"))), "sur")
    latin = loose.where("foreign").select("*", F.lit(None).cast("string").alias("other"), F.lit(0).alias("d"))
    # with a given name or initial a surname meets only persons who share it, so that
    # the spellings and persons of a frequent surname don't all meet; bare ones apart
    def meet(some: DataFrame, at: str, name: str) -> DataFrame:
        on = F.col(at) == F.col(name)
        named = some.where("size(inits) > 0").withColumn("_fi", F.explode("inits"))
        named = named.join(canon, on & (F.col("_fi") == F.col("fi_c"))).drop("_fi")
        return named.unionByName(some.where("size(inits) = 0").join(canon, on))

    fits = (
        meet(russian, "other", "sur_c")
        .unionByName(meet(latin, "lat", "lat_c"))
        .where("pi = '' or pi_c = '' or pi = pi_c")
        .where("gender = '' or gender_c = '' or gender = gender_c")
        .where("ord = '' or ord_c is null or ord = ord_c")
    )
    short = F.when(F.size("inits") == 0, 2 * SHORT_COST).otherwise(F.when(F.col("pi") == "", SHORT_COST).otherwise(0.0))
    # an ordinal says who it is only if it alone is left for one person
    guess = (F.col("ord") != "") & F.col("ord_c").isNull() & (F.size("inits") == 0)
    told_ord = F.when(guess, 3.0).otherwise(0.0)
    slip = F.when(F.col("cut") & (F.col("d") > 0), F.lit(CUT_COST)).otherwise(_cost(F.col("d"), F.lit(False)))
    post = F.col("prior_c") - slip - short - told_ord - F.when(F.col("foreign"), LATIN_COST).otherwise(0.0)
    order = Window.partitionBy("form").orderBy(F.desc("post"), "person_c")
    rest = F.size(F.collect_set(F.when(guess, F.col("ord"))).over(Window.partitionBy("person_c")))
    judged = fits.withColumn("post", post).withColumn("guess", guess).withColumn("rest", rest).withColumn("r", F.row_number().over(order)).withColumn("next", F.lead("post").over(order))
    bare = (F.size("inits") == 0) & (F.col("ord") == "")
    clear = F.col("next").isNull() | ~bare & ~F.col("guess") | bare & (F.col("post") - F.col("next") >= MARGIN)
    chosen = judged.where("r = 1").where(clear & (~F.col("guess") | (F.col("rest") == 1))).select("form", F.col("person_c").alias("person"))
    known = direct.unionByName(chosen)
    left = forms.join(known.select("form"), "form", "left_anti")
    alone = left.select("form", F.concat_ws("|", "sur", F.coalesce(F.get("inits", F.lit(0)), F.lit("")), "pi", "ord", F.lit("alone")).alias("person"))
    return told.select("value", "form").join(known.unionByName(alone), "form").select("value", "person")


def spelling_pairs(attributed: DataFrame) -> DataFrame:
    """(name_a, name_b): the different spellings of each person, name_a the smaller
    by code points."""
    a = attributed.select("person", F.col("value").alias("name_a"))
    b = attributed.select("person", F.col("value").alias("name_b"))
    return a.join(b, "person").where("name_a < name_b").select("name_a", "name_b")
