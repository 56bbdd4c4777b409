"""Repair of text from scanned pages.

Lines that are running heads or page numbers are taken out, words broken over lines
are joined, and misread letters are corrected. Everything is learned from the corpus
itself: heads are lines that come back whole in the middle of sentences; a frequency
lexicon of all words says which words are real. A symmetric-delete index over this
lexicon finds candidates for a doubtful word; a weighted edit distance in which only
what scanners confuse is cheap, several slips of a word added up, ranks them together
with their frequency and how often they follow the word before (bigrams), so that one
misreading may be repaired differently in different places. All counts are made over
all texts. Texts are read once; only those that hold a learned head are read again.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators.sizing import lookup
from vellum.session import materialize, num_slots

#: What scanners read (second) for what is printed (first), with the cost.
CONFUSIONS = [
    ("о", "0", 0.3), ("а", "8", 0.3), ("б", "6", 0.3), ("ч", "4", 0.3), ("з", "3", 0.3), ("ѣ", "Ь", 0.3), ("н", "п", 1.0), ("е", "с", 1.0), ("с", "е", 1.0),
    ("т", "г", 1.0), ("л", "д", 1.0), ("и", "н", 1.0), ("в", "п", 1.0), ("п", "и", 1.0), ("м", "ін", 0.6), ("ы", "ьі", 0.4), ("ю", "іо", 0.6), ("ш", "т", 1.2), ("г", "т", 1.2),
    ("О", "0", 0.3), ("З", "3", 0.3), ("Б", "6", 0.3), ("Ч", "4", 0.3), ("і", "1", 0.3), ("н", "и", 1.2), ("ъ", "ь", 1.2), ("ь", "ъ", 1.2), ("ц", "п", 1.4), ("щ", "ш", 1.2), ("о", "с", 1.4),
    ("ѣ", "ь", 0.8), ("в", "з", 1.4), ("п", "л", 1.4), ("ж", "я;", 0.3), ("д", "л", 1.4),
]
COST = {(printed, read): cost for printed, read, cost in CONFUSIONS}
_READ_AS: dict[str, list[tuple[str, float]]] = {}
for _printed, _read, _cost in CONFUSIONS:
    _READ_AS.setdefault(_printed, []).append((_read, _cost))
#: Slips of one word may cost this much together.
MOST_COST = 2.0
#: What can't stand inside a word and what was printed, in small letters
#: and between capitals.
SURE = {"0": "о", "8": "а", "6": "б", "4": "ч", "3": "з", "1": "і", "Ь": "ѣ", "я;": "ж"}
SURE_UPPER = {"0": "О", "3": "З", "6": "Б", "4": "Ч"}
#: A word is doubted against one at least this many times as frequent.
RATIO = 8.0
#: A name known from the tables of names counts like a word seen this often.
KNOWN_NAME = 25
#: A line must come back this often, and this part of the times in mid-sentence, and
#: its first words stand at a line's start this part of the times, to be a head.
HEAD_COUNT, HEAD_OPEN, HEAD_START = 3, 0.3, 0.85

_PAGE = r"(?:[-–—]\s*\d{1,4}\s*[-–—]|\[\s*\d{1,4}\s*\]|\*\s*\d{1,4}|стр\.\s*\d{1,4}\.?|\d{1,4}\.?|(?=[IVXLCDM]{2,})M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3}))"
PAGE_LINE = regex.compile(rf"^\s*{_PAGE}\s*$")
PAGE_BESIDE = regex.compile(rf"^\s*(?P<a>{_PAGE})\s+(?P<rest>.*\S)\s*$|^\s*(?P<rest2>\S.*?)\s+(?P<b>{_PAGE})\s*$")
SPACED = regex.compile(r"^\W*(?:\p{L}\s){3,}\p{L}\W*$")
BREAK = regex.compile(r"(?P<left>(?:[\p{L}\d-]|(?<=я);(?=[\p{Ll}=¬‐‑­-]))*(?:[\p{L}\d]|(?<=я);))(?P<mark>[-=¬‐‑­])\s*$")
#: `я;` inside a word is a misread letter, too
WORD = regex.compile(r"(?:[\p{L}\p{N}]|(?<=\p{L}я);(?=\p{Ll}))+(?:-(?:[\p{L}\p{N}]|(?<=\p{L}я);(?=\p{Ll}))+)*")
OPEN_END = regex.compile(r"[\p{L}\d,­¬=‐-]")
QUOTED = regex.compile(r"[«»\"„“,;:()]")
LETTERS = regex.compile(r"\p{L}")
UPPER = regex.compile(r"\p{Lu}")
_NUMBERED = regex.compile(r"[\dIVXLCDM]")
_NUMERAL = regex.compile(r"[IVXLCDM\s.]+")
_BLANKS, _DIGIT = regex.compile(r"\s+"), regex.compile(r"\d")
_MARKS = "-=¬‐‑\u00ad"


def page_line(line: str) -> bool:
    return bool(_NUMBERED.search(line) and PAGE_LINE.match(line))


def without_page(line: str) -> tuple[str, bool]:
    """The line without a page number at its side, and whether there was one."""
    found = PAGE_BESIDE.match(line) if _NUMBERED.search(line) else None
    if found is None:
        return line.strip(), False
    return (found["rest"] or found["rest2"]).strip(), True


def line_break(line: str):
    """The match of a word broken at the line's end, if there is one."""
    bare = line.rstrip()
    if bare[-1:] == "" or bare[-1] not in _MARKS:
        return None
    return BREAK.search(line, bare.rfind(" ") + 1)


def head_key(text: str) -> str:
    """A head with its digits (years, misread letters) levelled."""
    return _BLANKS.sub(" ", _DIGIT.sub("#", text.replace("—", "-").replace("–", "-"))).strip()


def head_shape(text: str) -> bool:
    """Capitals throughout, or letters set apart."""
    upper, letters = len(UPPER.findall(text)), len(LETTERS.findall(text))
    if letters < 4 or upper == letters and _NUMERAL.fullmatch(text):
        return False
    return upper >= 0.8 * letters or bool(SPACED.match(text))


def clues(text: str) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """Whole lines in the middle (with 1 where the sentence before is open) and pairs
    of words that begin with a capital (with 1 where they begin a line)."""
    whole, pairs = [], []
    open_before = False
    for i, raw in enumerate(text.split("\n")):
        line, _ = without_page(raw)
        if not line or page_line(raw):
            continue
        if 0 < i and line[0].isupper() and " " in line and not QUOTED.search(line) and not head_shape(line):
            whole.append((head_key(line), int(open_before)))
        words = line.split()
        for j in range(len(words) - 1):
            if words[j][0].isupper():
                pairs.append((head_key(words[j] + " " + words[j + 1]), int(j == 0)))
        open_before = bool(OPEN_END.match(line[-1]))
    return whole, pairs


def learned_heads(read: DataFrame) -> DataFrame:
    """(head): lines in small letters that are running heads of this corpus."""
    tally = lambda c: read.select(F.explode(c).alias("c")).groupBy("c.key").agg(F.count("*").alias("n"), F.sum("c.hit").alias("hits"))
    lines = materialize(tally("lines").where((F.col("n") >= HEAD_COUNT) & (F.col("hits") >= HEAD_OPEN * F.col("n"))))
    first = lines.select("key", F.array_join(F.slice(F.split("key", " "), 1, 2), " ").alias("pair"))
    # only pairs that begin such a line matter
    pairs = read.select(F.explode("pairs").alias("c")).select(F.col("c.key").alias("pair"), F.col("c.hit").alias("hit"))
    starts = pairs.join(lookup(materialize(first.select("pair").distinct())), "pair", "left_semi").groupBy("pair").agg((F.sum("hit") / F.count("*")).alias("share"))
    return first.join(starts, "pair", "left").where(F.coalesce("share", F.lit(1.0)) >= HEAD_START).select(F.col("key").alias("head"))


class Reading:
    """One field read line by line: noise found, running words, breaks."""

    __slots__ = ("head", "page", "pieces")

    def __init__(self, text: str, heads: set[str], heading: bool):
        self.head = self.page = False
        #: pieces of running text: (text, break mark at its end)
        self.pieces: list[tuple[str, bool]] = []
        for i, raw in enumerate(text.split("\n")):
            if not raw.strip():
                continue
            if not heading and page_line(raw):
                self.page = True
                continue
            rest, beside = without_page(raw)
            if not heading and i > 0 and (head_shape(rest) or heads and head_key(rest) in heads):
                self.head = True
                self.page |= beside
                continue
            self.pieces.append((raw.strip(" \t\r"), line_break(raw) is not None))

    def joined(self, own) -> list[tuple[str, tuple[str, str] | None]]:
        """Words of the running text; a word over a break comes with its halves."""
        words: list[tuple[str, tuple[str, str] | None]] = []
        carry: str | None = None
        for k, (line, broken) in enumerate(self.pieces):
            tokens = WORD.findall(line)
            last = None
            if broken and k + 1 < len(self.pieces):
                found = line_break(line)
                last = found["left"]
                tokens = WORD.findall(line[: found.start()])
            if carry is not None:
                if tokens or last is not None:
                    first = tokens[0] if tokens else last
                    if first[:1].islower() or not first[:1].isalpha() or carry[-1:].isupper():
                        joint = (carry, first)
                        word = own(carry, first)
                        if tokens:
                            tokens = tokens[1:]
                            words.append((word, joint))
                        else:  # a word over two breaks
                            words.append((word, joint))
                            last = None
                    else:
                        words.append((carry, None))
                else:
                    words.append((carry, None))
            words += [(w, None) for w in tokens]
            carry = last
        if carry is not None:
            words.append((carry, None))
        return words


_HITS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("hit", T.IntegerType())]))
_WORD = T.StructType([T.StructField(name, T.StringType()) for name in ("w", "left", "right", "before")])
_WORDS = T.StructType([T.StructField("head", T.BooleanType()), T.StructField("page", T.BooleanType()), T.StructField("words", T.ArrayType(_WORD))])


def _read(text: str, heads: set[str]) -> tuple[bool, bool, list]:
    r = Reading(text, heads, False)
    out, before = [], ""
    for w, halves in r.joined(lambda a, b: a + b):
        if LETTERS.search(w):
            out.append((w, *(halves or (None, None)), before))
        before = w
    return r.head, r.page, out


@F.pandas_udf(T.StructType([*_WORDS.fields, T.StructField("lines", _HITS), T.StructField("pairs", _HITS)]))
def _first_reading(texts: pd.Series, headings: pd.Series) -> pd.DataFrame:
    rows = [((False, False, [], [], []) if not t or h else (*_read(t, set()), *clues(t))) for t, h in zip(texts, headings)]
    return pd.DataFrame(rows, columns=["head", "page", "words", "lines", "pairs"])


@F.pandas_udf(_WORDS)
def _second_reading(texts: pd.Series, heads: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_read(t, set(h)) for t, h in zip(texts, heads)], columns=["head", "page", "words"])


def surely(word: str) -> str:
    """The word with everything that can't stand in a word put right."""
    out, i = [], 0
    capitals = bool(UPPER.search(word)) and not any(map(str.islower, word))
    while i < len(word):
        two = word[i : i + 2]
        if two in SURE and i and word[i + 2 : i + 3].islower():
            out.append(SURE[two])
            i += 2
            continue
        c = word[i]
        if capitals and c in SURE_UPPER:
            c = SURE_UPPER[c]
        elif c.isdigit() or c == "Ь" and i and word[i - 1].islower():
            c = SURE.get(c, c)
        out.append(c)
        i += 1
    return "".join(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _keys(words: pd.Series) -> pd.Series:
    """Index keys of a word, as it is and with its sure slips put right: itself, each
    single deletion, and the deletion of each pair of letters one letter is misread as."""
    pairs = sorted({read for _, read in COST if len(read) == 2})

    def of(word: str) -> set[str]:
        keys = {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}
        for pair in pairs:
            at = word.find(pair)
            while at >= 0:
                keys.add(word[:at] + word[at + 2 :])
                at = word.find(pair, at + 1)
        return keys

    return words.map(lambda w: list(of(w) | of(surely(w))), na_action="ignore")


@lru_cache(maxsize=500_000)
def confusion_cost(printed: str, read: str) -> float:
    """Weighted edit distance in which letters are the same or confused by scanners,
    any number of times; infinite where that doesn't lead from one to the other or
    costs more than MOST_COST."""
    best: dict[tuple[int, int], float] = {(0, 0): 0.0}
    for i, letter in enumerate(printed):
        after: dict[tuple[int, int], float] = {}
        for (_, j), cost in best.items():
            ways = [(letter, 0.0), *_READ_AS.get(letter, ())]
            for seen, more in ways:
                if cost + more <= MOST_COST and read.startswith(seen, j):
                    at = (i + 1, j + len(seen))
                    after[at] = min(after.get(at, float("inf")), cost + more)
        best = after
        if not best:
            return float("inf")
    return best.get((len(printed), len(read)), float("inf"))


@F.pandas_udf(T.DoubleType())
def _confusion(printed: pd.Series, read: pd.Series) -> pd.Series:
    return pd.Series([confusion_cost(a, b) for a, b in zip(printed, read)], dtype="float64")


#: Endings of surnames (old spelling) and what they become in other cases.
CASES = [
    ("ій", "аго ому имъ омъ ій"), ("ый", "аго ому ымъ омъ ый"), ("ая", "ой ою ую ая"), ("овъ", "ова ову овымъ овѣ овъ овы"), ("евъ", "ева еву евымъ евѣ евъ евы"),
    ("инъ", "ина ину инымъ инѣ инъ ины"), ("ова", "овой овою ову ова"), ("ева", "евой евою еву ева"), ("ина", "иной иною ину ина"), ("йнъ", "йна йну йномъ йнѣ йнъ"), ("чъ", "ча чу чемъ чѣ чъ"),
]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _case_forms(words: pd.Series) -> pd.Series:
    def of(word: str) -> list[str]:
        forms = {word}
        for ending, others in CASES:
            if word.endswith(ending):
                forms |= {word[: -len(ending)] + o for o in others.split()}
        return list(forms)

    return words.map(of, na_action="ignore")


def name_forms(names: DataFrame, name: str) -> DataFrame:
    """(w): words of known names in all cases; words printed once are left out."""
    words = names.select(F.explode(F.regexp_extract_all(F.col(name), F.lit(r"(\p{Lu}\p{Ll}{3,})"), F.lit(1))).alias("w"))
    often = words.groupBy("w").count().where("count >= 2")
    return often.select(F.explode(_case_forms(F.col("w"))).alias("w")).distinct()


class Repairs:
    """What was found: ``rows`` (text, heading) and ``fields`` (head, page) of every
    text, ``words`` as read, ``breaks``, ``told`` (words joined over breaks), ``slips``
    per word and word before, ``heads`` of the texts that hold learned ones, and the
    key columns."""

    def __init__(self, **frames):
        self.__dict__.update(frames)


def find_noise(texts: DataFrame, keys: list[str], text: str, heading: str, names: DataFrame | None = None, name: str = "name") -> Repairs:
    """Noise of every text.

    ``keys`` identify a text, ``heading`` is a boolean column: the text is itself a
    heading, in which nothing is noise. Null, empty and blank texts hold nothing;
    repeated rows are read once; further columns are ignored.
    """
    spark = texts.sparkSession
    tasks = max(num_slots(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = texts.select(*keys, F.col(text).alias("_text"), F.coalesce(F.col(heading), F.lit(False)).alias("_heading")).where("_text is not null")
    rows = rows.repartition(tasks, *keys).dropDuplicates(keys)
    first = materialize(rows.withColumn("r", _first_reading("_text", "_heading")).select(*rows.columns, "r.*"))
    learned = materialize(learned_heads(first))
    # texts that hold a learned head are read again, knowing it
    held = first.select(*keys, F.explode("lines").alias("l")).select(*keys, F.col("l.key").alias("head"))
    heads = materialize(held.join(lookup(learned), "head").groupBy(*keys).agg(F.collect_set("head").alias("_heads")))
    again = first.select(*keys, "_text").join(lookup(heads), keys).withColumn("r", _second_reading("_text", "_heads")).select(*keys, "r.*")
    again = materialize(again)
    read = first.join(lookup(heads), keys, "left_anti").select(*again.columns).unionByName(again)
    words = materialize(read.select(*keys, F.explode("words").alias("x")).select(*keys, "x.*"))
    # the lexicon: words not broken over lines
    plain = materialize(words.where("left is null").groupBy("before", "w").agg(F.count("*").alias("k")))
    lexicon = plain.groupBy("w").agg(F.sum("k").alias("n"))
    if names is not None:
        known = name_forms(names, name).select("w", F.lit(KNOWN_NAME).alias("n"))
        lexicon = lexicon.unionByName(known).groupBy("w").agg(F.sum("n").alias("n"))
    lexicon = materialize(lexicon.where(F.length("w") >= 2))
    # broken words: does the word have a hyphen of its own?
    cut = words.where("left is not null")
    halves = materialize(cut.groupBy("left", "right").agg(F.count("*").alias("times")))
    solid = lexicon.select(F.col("w").alias("solid"), F.col("n").alias("n_solid"))
    dashed = lexicon.where(F.col("w").contains("-")).select(F.col("w").alias("dashed"), F.col("n").alias("n_dashed"))
    breaks = (
        halves.withColumn("solid", F.concat("left", "right"))
        .withColumn("dashed", F.concat_ws("-", "left", "right"))
        .join(solid, "solid", "left")
        .join(dashed, "dashed", "left")
        .withColumn("own", F.coalesce("n_dashed", F.lit(0)) > F.coalesce("n_solid", F.lit(0)))
        .select("left", "right", "own", F.when(F.col("own"), F.col("dashed")).otherwise(F.col("solid")).alias("word"))
    )
    breaks = materialize(breaks)
    joined = cut.join(lookup(breaks), ["left", "right"]).withColumn("w", F.col("word"))
    told = words.where("left is null").select(*keys, "w", "before").unionByName(joined.select(*keys, "w", "before"))
    pairs = plain.unionByName(joined.groupBy("before", "w").agg(F.count("*").alias("k"))).groupBy("before", "w").agg(F.sum("k").alias("k"))
    return Repairs(first=first, fields=read.select(*keys, "head", "page"), words=words, told=told, breaks=breaks, slips=_slips(materialize(pairs), lexicon), heads=heads, keys=keys)


#: A word of letters and digits that is no ordinal, or with a letter out of place.
_BROKEN = r"^(?=.*\p{L})(?=.*\d)(?!\d+(-\p{L}{1,4})?$)(?!.*[A-Za-z]).*$|\p{Ll}Ь|\p{L}я;\p{Ll}"


@F.pandas_udf(T.StringType())
def _surely(words: pd.Series) -> pd.Series:
    return words.map(surely, na_action="ignore")


def _slips(pairs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(before, w, right): misread words with the word that was printed there.

    ``pairs`` has every word with the word before and how often (k). A word that holds
    what no word can hold and has no candidate is put right letter by letter.
    """
    seen = pairs.groupBy("w").agg(F.sum("k").alias("seen")).where(F.length("w") >= 3)
    counts = materialize(seen.join(lexicon, "w", "left").select("w", F.greatest(F.coalesce("n", F.lit(0)), F.least("seen", F.lit(1))).alias("n")))
    left = counts.select("w", "n", F.explode(_keys(F.col("w"))).alias("key"))
    right = lexicon.where((F.col("n") >= RATIO) & (F.length("w") >= 3)).select(F.col("w").alias("c"), F.col("n").alias("n_c"), F.explode(_keys(F.col("w"))).alias("key"))
    # exploded keys outgrow what the planner expects of the files: never broadcast them
    met = left.join(right.hint("merge"), "key").where((F.col("c") != F.col("w")) & (F.col("n_c") >= RATIO * F.col("n"))).select("w", "n", "c", "n_c").distinct()
    near = materialize(met.withColumn("cost", _confusion(F.col("c"), F.col("w"))).where(F.col("cost") <= MOST_COST).select("w", "c", "n_c", "cost"))
    sure = counts.where(F.col("w").rlike(_BROKEN)).join(near.select("w").distinct(), "w", "left_anti").withColumn("right", _surely("w")).where("w <> right")
    # the word before: how often the candidate follows it
    doubtful = pairs.join(lookup(materialize(near.select("w").distinct())), "w", "left_semi").select("before", "w")
    likely = materialize(near.select(F.col("c").alias("w")).distinct())
    follows = pairs.join(lookup(likely), "w", "left_semi").select("before", F.col("w").alias("c"), F.col("k").alias("follows"))
    scored = doubtful.join(lookup(near), "w").join(follows, ["before", "c"], "left")
    score = F.log("n_c") + F.log1p(F.coalesce("follows", F.lit(0))) - F.col("cost")
    best = scored.groupBy("before", "w").agg(F.max_by("c", F.struct(score.alias("s"), F.col("c"))).alias("right"))
    rest = pairs.select("before", "w").join(lookup(materialize(sure.select("w", "right"))), "w").select("before", "w", "right")
    return materialize(best.unionByName(rest))


def noise_kinds(found: Repairs) -> DataFrame:
    """(keys..., noise): each kind of noise once per text that holds it."""
    keys = found.keys
    page = found.fields.where("page").select(*keys, F.lit("page_number").alias("noise"))
    head = found.fields.where("head").select(*keys, F.lit("running_head").alias("noise"))
    split = materialize(found.breaks.where("not own").select("left", "right"))
    broken = found.words.where("left is not null").join(lookup(split), ["left", "right"], "left_semi").select(*keys, F.lit("hyphen_break").alias("noise"))
    misread = found.told.join(lookup(found.slips), ["before", "w"], "left_semi").select(*keys, F.lit("misread").alias("noise"))
    return page.unionByName(head).unionByName(broken).unionByName(misread).distinct()


def repaired(found: Repairs) -> DataFrame:
    """(keys..., repaired): every text as one continuous line: heads and page numbers
    left out, broken words joined, misread words replaced. Headings stay as they are."""
    keys = found.keys
    wrong = found.told.join(lookup(found.slips), ["before", "w"]).groupBy(*keys).agg(F.collect_set(F.struct("before", "w", "right")).alias("slips"))
    own = materialize(found.breaks.where("own").select("left", "right"))
    dashed = found.words.where("left is not null").join(lookup(own), ["left", "right"], "left_semi")
    dashed = dashed.groupBy(*keys).agg(F.collect_set(F.concat_ws("-", "left", "right")).alias("dashed"))

    def build_one(text: str, heads: set[str], fixes: dict, plain: dict, dashes: set[str]) -> str:
        whole = ""
        for line, broken in Reading(text, heads, False).pieces:
            if whole.endswith("\0"):
                left = WORD.findall(whole[:-1])[-1:] or [""]
                right = WORD.findall(line)[:1] or [""]
                whole = whole[:-1] + ("-" if left[0] + "-" + right[0] in dashes else "") + line
            else:
                whole += (" " if whole else "") + line
            if broken:
                whole = whole[: line_break(whole).end("left")] + "\0"
        whole = _BLANKS.sub(" ", whole.replace("\0", "-"))
        before = [""]

        def fix(m) -> str:
            w, last = m[0], before[0]
            before[0] = w
            return fixes.get((last, w), plain.get(w, w))

        return WORD.sub(fix, whole)

    @F.pandas_udf(T.StringType())
    def build(texts: pd.Series, headings: pd.Series, heads: pd.Series, slips: pd.Series, owns: pd.Series) -> pd.Series:
        out = []
        for text, heading, known, fixes, own_ in zip(texts, headings, heads, slips, owns):
            if heading or not text:
                out.append(text)
                continue
            rows = [] if fixes is None else sorted((f["before"], f["w"], f["right"]) for f in fixes)
            # a word after a hyphen of its own has another word before it here than above
            out.append(build_one(text, set() if known is None else set(known), {(b, w): r for b, w, r in rows}, {w: r for _, w, r in rows}, set() if own_ is None else set(own_)))
        return pd.Series(out, dtype=object)

    all_ = found.first.select(*keys, "_text", "_heading").join(lookup(found.heads), keys, "left").join(wrong, keys, "left").join(dashed, keys, "left")
    return all_.select(*keys, build("_text", "_heading", "_heads", "slips", "dashed").alias("repaired"))
