"""Exact byte-pair encoding by dynamic programming over prefixes.

For every prefix of a byte string the table holds the one token that the encoding
of this prefix ends with. A token may follow another exactly when the pair encodes
to itself; a prefix has exactly one last token that follows validly on the prefix
before it. So bytes can be appended without touching what is stored, and after an
edit the table is recomputed from the edit on, only until it agrees again.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.session import spread

#: Where the vocabulary files lie; a parameter of every operator here.
VOCABULARY = os.environ.get("VELLUM_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
#: How a text is cut into pieces before merging: fixed values of the vocabulary.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pieces whose ids a worker remembers.
REMEMBERED = 200_000
#: Pairs of tokens whose answer a worker remembers.
REMEMBERED_PAIRS = 1_000_000


class PrefixEncoder:
    """The vocabulary, with the table of valid neighbours filled on demand."""

    def __init__(self, path: str):
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    word, rank = line.split()
                    self.ranks[base64.b64decode(word)] = int(rank)
        self.words = {rank: word for word, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        # trie over the reversed tokens: all tokens that end at a position
        self.endings: dict = {}
        for word, rank in self.ranks.items():
            node = self.endings
            for byte in reversed(word):
                node = node.setdefault(byte, {})
            node[-1] = rank
        self._follows: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain merging by rank; only used on pairs of tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def follows(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) >= REMEMBERED_PAIRS:
                self._follows.clear()
            known = self._follows[key] = self.merge(self.words[left] + self.words[right]) == [left, right]
        return known

    def extend(self, data: bytes, last: list[int], upto: int | None = None) -> None:
        """Fill the table for the prefixes of ``data`` longer than ``len(last)``."""
        ranks, follows = self.endings, self.follows
        for end in range(len(last) + 1, (len(data) if upto is None else upto) + 1):
            node, start, chosen = ranks, end, -1
            while start > 0:
                node = node.get(data[start - 1])
                if node is None:
                    break
                start -= 1
                token = node.get(-1)
                if token is not None and (start == 0 or follows(last[start - 1], token)):
                    chosen = token
                    break
            last.append(chosen)

    def path(self, data: bytes, last: list[int]) -> list[int]:
        ids, end = [], len(last)
        while end:
            ids.append(last[end - 1])
            end -= len(self.words[last[end - 1]])
        ids.reverse()
        return ids

    def encode_bytes(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        last: list[int] = []
        self.extend(data, last)
        return self.path(data, last)


class PieceTable:
    """The prefix table of one piece, open to appends and edits."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.encoder.extend(self.data, self.last)

    def edit(self, start: int, end: int, data: bytes) -> int:
        """Replace bytes start..end; gives how many prefixes were computed anew.

        Behind the edit the old entries are taken over as soon as as many of them in
        a row agree as the longest token has bytes: from there on nothing differs.
        """
        tail, old = self.data[end:], self.last[end:]
        self.data = self.data[:start] + data + tail
        del self.last[start:]
        done = start + len(data)
        self.encoder.extend(self.data, self.last, done)
        reach = self.encoder.longest
        same = k = 0
        while k < len(old) and same < reach:
            self.encoder.extend(self.data, self.last, done + k + 1)
            same = same + 1 if self.last[-1] == old[k] else 0
            k += 1
        self.last.extend(old[k:])
        return len(data) + k

    def ids(self) -> list[int]:
        return self.encoder.path(self.data, self.last)


class TextEncoder:
    """Ids of whole texts; pieces seen before are looked up."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PIECES):
        self.encoder = PrefixEncoder(path)
        self.pattern = regex.compile(pattern)
        self.seen: dict[str, list[int]] = {}

    def piece(self, text: str) -> list[int]:
        ids = self.seen.get(text)
        if ids is None:
            ids = self.encoder.encode_bytes(text.encode("utf-8", "replace"))
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            if len(text) <= 64:
                self.seen[text] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Null and empty texts give the empty list; special tokens are plain text."""
        ids: list[int] = []
        if text:
            for part in self.pattern.findall(text):
                ids += self.piece(part)
        return ids

    def reencode(self, before: str, ids: list[int], after: str) -> list[int]:
        """Ids of ``after`` from those of ``before``: pieces before and behind the
        edited stretch keep their ids; only what lies between is encoded again."""
        old = [m.span() for m in self.pattern.finditer(before)]
        new = [m.span() for m in self.pattern.finditer(after)]
        head = 0
        while head < min(len(old), len(new)) and before[slice(*old[head])] == after[slice(*new[head])]:
            head += 1
        tail = 0
        while tail < min(len(old), len(new)) - head and before[slice(*old[-1 - tail])] == after[slice(*new[-1 - tail])]:
            tail += 1
        width = [len(self.piece(before[slice(*s)])) for s in old]
        first, rest = sum(width[:head]), sum(width[len(width) - tail :]) if tail else 0
        middle = [i for s in new[head : len(new) - tail] for i in self.piece(after[slice(*s)])]
        return ids[:first] + middle + (ids[len(ids) - rest :] if rest else [])


@lru_cache(maxsize=2)
def text_encoder(path: str = VOCABULARY) -> TextEncoder:
    """One encoder per worker process and vocabulary."""
    return TextEncoder(path)


def shipped(spark: SparkSession, path: str) -> str:
    """The vocabulary file sent to every executor; gives its name there."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def encode_corpus(docs: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, ids) for every row: ids by the vocabulary, without special tokens.

    Null and empty texts give the empty list; blank ones the ids of their blanks.
    Repeated rows stay, further columns are dropped, an empty table stays empty, and
    a text of any length is encoded whole.
    """
    kind = docs.schema[key].dataType.simpleString()
    name = shipped(docs.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = text_encoder(SparkFiles.get(name)).encode
        for batch in batches:
            yield pd.DataFrame({key: batch.iloc[:, 0], "ids": [encode(t) for t in batch.iloc[:, 1]]})

    return spread(docs.select(key, text)).mapInPandas(run, f"`{key}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, keep: list[str], text: str, path: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and n_tokens of every row; null texts have 0."""
    name = shipped(docs.sparkSession, path)

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        encode = text_encoder(SparkFiles.get(name)).encode
        return texts.map(lambda t: len(encode(t))).astype("int32")

    return spread(docs.select(*keep, F.col(text).alias("_text"))).select(*keep, count("_text").alias("n_tokens"))
