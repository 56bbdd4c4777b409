"""Personal information in free text by a skip-chain conditional random field.

The field (``crf``) labels every token: outside, or first or later token of an e-mail
address, phone number, identity number, address or name. It is fitted on a bounded
sample of documents whose weak labels come from patterns and word lists (``pii_cues``);
the patterns for names and identity numbers are used there only. All documents are
then labelled by the field alone, from words, endings, shapes, formats and repeats.
Skip edges between distant tokens with the same or a similar word make their answers
agree: a bare surname follows the full name given elsewhere, a doubtful one falls
where the word is clearly no name elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.crf import Field, blocks_of, spans_of, weak_labels
from vellum.llm.pii_cues import cue_spans
from vellum.session import spread

#: Documents the field is fitted on, at most, and the longest of them in code points.
#: They are chosen by a hash of the key; documents beyond the length are labelled like
#: all others, only not fitted on.
FIT_DOCS, FIT_CHARS = 3_000, 20_000
#: Documents put into one block of the fit.
FIT_BLOCK = 400


def sample(docs: DataFrame, key: str, text: str, most: int = FIT_DOCS) -> list[str]:
    """At most ``most`` texts for the fit, in the order of a hash of the key."""
    rows = docs.select(F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(text).alias("t")).where(f"length(t) between 1 and {FIT_CHARS}")
    share = min(1.0, 1.1 * most / max(docs.count(), 1))
    drawn = rows.where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * most).collect()
    return [r.t for r in sorted(drawn, key=lambda r: (r.h, r.t))[:most]]


def fit_texts(texts: list[str], **how) -> Field:
    """The field fitted on the weak labels of the texts."""
    blocks, labels = [], []
    for i in range(0, len(texts), FIT_BLOCK):
        for places, block in blocks_of(texts[i : i + FIT_BLOCK]):
            blocks.append(block)
            labels.append(weak_labels(block, [cue_spans(texts[i + j]) for j in places]))
    return Field().fit(blocks, labels, **how)


def fit(docs: DataFrame, key: str, text: str) -> Field:
    """The field fitted on a bounded sample of the documents (``FIT_DOCS``)."""
    return fit_texts(sample(docs, key, text))


def checked(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that can be what they are called: numbers and addresses hold a digit,
    names a letter."""
    return [(k, a, b) for k, a, b in spans if (k == "email" or any(map(str.isalpha if k == "name" else str.isdigit, text[a:b])))]


def label(field: Field, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
    """Spans of each text; null, empty and blank texts hold none."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    filled = [i for i, t in enumerate(texts) if t]
    for places, block in blocks_of([texts[i] for i in filled]):
        for j, spans in zip(places, spans_of(block, field.decode(block))):
            out[filled[j]] = checked(texts[filled[j]], spans)
    return out


def find_personal(docs: DataFrame, key: str, text: str, field: Field | None = None) -> DataFrame:
    """(key, kind, char_start, char_end) of everything found, offsets in code points.

    Null, empty and blank texts hold nothing; a text of any length is read whole;
    repeated rows give their spans once; further columns are dropped. Where there are
    no texts to fit on nothing is found.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or fit(docs, key, text))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = label(shared.value, batch["_t"].tolist())
            rows = [(k, *span) for k, spans in zip(batch["_k"].tolist(), found) for span in spans]
            yield pd.DataFrame(rows, columns=[key, "kind", "char_start", "char_end"])

    rows = spread(docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(text).alias("_t")))
    return rows.mapInPandas(run, f"`{key}` {kind}, kind string, char_start int, char_end int").distinct()


def redact(docs: DataFrame, key: str, text: str, field: Field | None = None) -> DataFrame:
    """(key, redacted): the texts with typed placeholders such as ``[NAME]``; all
    other characters unchanged. Null stays null; repeated rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(field or fit(docs, key, text))

    def placed(t: str | None, spans: list[tuple[str, int, int]]) -> str | None:
        if not spans:
            return t
        out, at = [], 0
        for kind, a, b in spans:
            out += [t[at:a], f"[{kind.upper()}]"]
            at = b
        return "".join([*out, t[at:]])

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        values = texts.tolist()
        return pd.Series([placed(t, s) for t, s in zip(values, label(shared.value, values))], dtype=object)

    return spread(docs.select(key, F.col(text).alias("_t"))).select(key, run("_t").alias("redacted"))
