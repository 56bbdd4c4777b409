"""One consistent form for text that looks the same but differs in its characters.

Rules for widths, blanks, invisible characters, accents and look-alike letters are
compiled once into transducers: tries over grapheme clusters, walked with longest
match. Compilation refuses rules that contradict each other, and rules whose output
would be rewritten again, so one pass is enough and a second pass changes nothing.
A cluster that no rule names, such as a letter under several accents, is compiled
when it is first met, and checked in the same way.

Look-alike letters have an output per script, so there is one transducer for each
script and one for what stands between words. A text is cut into clusters once, the
script of each word is chosen, and its clusters go through that transducer alone. A
word takes the script of its letters that exist in one script only; a word of
look-alikes alone takes the script of the nearest other word, of the following one at
a tie, unless it is a Roman numeral.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters that look alike in Latin, Cyrillic and Greek, in one order.
LATIN = "ABCEHIKMOPTXYSJaceiopxysj"
CYRILLIC = "АВСЕНІКМОРТХУЅЈасеіорхуѕј"
GREEK_PAIRS = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "α": "a", "ρ": "p", "ι": "i", "υ": "y", "χ": "x", "κ": "k", "ε": "e",
}
#: Letters of other blocks or rare letters that look like Cyrillic or Latin ones.
CYRILLIC_RARE = {"ӏ": "І", "Ӏ": "І", "ԛ": "q", "ԝ": "w", "һ": "h", "ɑ": "a", "ɡ": "g", "ı": "i"}
#: Characters that show nothing.
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF, *range(0xFE00, 0xFE10)]
#: Blanks other than the ordinary one.
BLANKS = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 0x2028, 0x2029, 0x85]

_ROMAN = regex.compile(r"M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})")


#: Clusters a worker remembers in one transducer.
MOST_CLUSTERS = 200_000
#: Texts in which nothing can look like something else: letters of one script, ordinary marks.
_PLAIN = regex.compile(r"[ -~]*|[ -@\[-`{-~А-яЁёІіѢѣѲѳѴѵЇї«»„“”’—–…№\n]*")


class ConflictError(ValueError):
    """Two rules contradict each other or one undoes another."""


_CLUSTER = regex.compile(r"\X")


class Transducer:
    """Trie of rewriting rules over clusters; longest match, one pass."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.rules: dict[str, str] = {}
        for source, target in rules:
            if not source or self.rules.get(source, target) != target:
                raise ConflictError(f"two outputs for {source!r}")
            if source != target:
                self.rules[source] = target
        self.trie: dict = {}
        for source, target in self.rules.items():
            self._put(_CLUSTER.findall(source), target)
        for source, target in self.rules.items():
            if self(_CLUSTER.findall(target)) != target:
                raise ConflictError(f"the output of {source!r} is rewritten again")

    def _put(self, clusters: list[str], target: str) -> None:
        node = self.trie
        for cluster in clusters:
            node = node.setdefault(cluster, {})
        node[""] = target

    def _compile(self, cluster: str) -> None:
        """Rules for a cluster of several code points that none names: its longest
        beginnings are rewritten by the rules there are, and the whole is composed."""
        out, at = [], 0
        while at < len(cluster):
            end = len(cluster)
            while end > at + 1 and cluster[at:end] not in self.rules:
                end -= 1
            out.append(self.rules.get(cluster[at:end], cluster[at:end]))
            at = end
        target = unicodedata.normalize("NFC", "".join(out))
        while (again := unicodedata.normalize("NFC", "".join(self.rules.get(c, c) for c in target))) != target:
            target = again
        if len(self.trie) >= MOST_CLUSTERS:  # odd clusters without end: forget what was compiled
            self.trie = {}
            for source, known in self.rules.items():
                self._put(_CLUSTER.findall(source), known)
        self._put([cluster], target)

    def __call__(self, clusters: list[str]) -> str:
        out, at, n, trie = [], 0, len(clusters), self.trie
        while at < n:
            first = clusters[at]
            if len(first) > 1 and first not in trie:
                self._compile(first)
            node, end, found, stop = trie.get(first), at + 1, None, at + 1
            while node is not None:
                if "" in node:
                    found, stop = node[""], end
                if end >= n:
                    break
                node = node.get(clusters[end])
                end += 1
            out.append(first if found is None else found)
            at = stop
        return "".join(out)


def width_rules() -> Iterable[tuple[str, str]]:
    """Full-width and half-width forms, by their compatibility decomposition."""
    for code in range(0xFF01, 0xFFEF):
        char = chr(code)
        plain = unicodedata.normalize("NFKC", char)
        if plain != char and unicodedata.east_asian_width(char) in "FH":
            yield char, "".join("" if ord(c) in INVISIBLE else " " if ord(c) in BLANKS else c for c in plain)


def blank_rules() -> Iterable[tuple[str, str]]:
    for code in BLANKS:
        yield chr(code), " "
    for code in INVISIBLE:
        yield chr(code), ""


def letter_rules(script: str) -> Iterable[tuple[str, str]]:
    """Look-alikes to the letters of one script, ``cyrillic`` or ``latin``."""
    to_cyrillic = dict(zip(LATIN, CYRILLIC))
    for a, b in zip(LATIN, CYRILLIC):
        yield (a, b) if script == "cyrillic" else (b, a)
    for greek, latin in GREEK_PAIRS.items():
        yield greek, to_cyrillic.get(latin, latin) if script == "cyrillic" else latin
    for rare, plain in CYRILLIC_RARE.items():
        yield rare, to_cyrillic.get(plain, plain) if script == "cyrillic" else plain.replace("І", "I")


def accent_rules(letters: dict[str, str]) -> Iterable[tuple[str, str]]:
    """Letters with accents, written in one or several characters, to the composed
    letter; ``letters`` maps their base to the script wanted."""
    for code in [*range(0xC0, 0x250), *range(0x400, 0x530), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        apart = unicodedata.normalize("NFD", char)
        if len(apart) > 1:
            wanted = unicodedata.normalize("NFC", letters.get(apart[0], apart[0]) + apart[1:])
            if len(wanted) > 1:  # no such letter in the other script
                wanted = unicodedata.normalize("NFC", char)
            yield char, wanted
            yield apart, wanted
            if letters.get(apart[0], apart[0]) != apart[0] and wanted[0] != char:
                yield wanted[0], wanted


class Normalizer:
    """The compiled transducers and the choice between them."""

    def __init__(self) -> None:
        first = [*width_rules(), *blank_rules()]
        self.between = Transducer(first)
        self.by_script = {}
        for script in ("cyrillic", "latin"):
            letters = dict(letter_rules(script))
            widths = [(a, "".join(letters.get(c, c) for c in b)) for a, b in first]
            self.by_script[script[0]] = Transducer([*widths, *letters.items(), *accent_rules(letters)])
        self.by_script[""] = self.between
        self.to_latin = dict(letter_rules("latin"))
        self.look_alike = set(LATIN) | set(CYRILLIC) | set(GREEK_PAIRS) | set(CYRILLIC_RARE)
        self.kinds: dict[str, str] = {}

    def plain(self, cluster: str) -> str:
        """The letter of a cluster without width and accents."""
        return unicodedata.normalize("NFD", self.between([cluster]))[:1]

    def kind(self, cluster: str) -> str:
        """``c`` or ``l`` for a letter of one script only, ``b`` for a look-alike,
        ``o`` for another letter, ``x`` for what doesn't end a word, else empty."""
        known = self.kinds.get(cluster)
        if known is None:
            plain = self.plain(cluster)
            name = unicodedata.name(plain, "") if plain else ""
            if not plain or unicodedata.combining(plain):
                known = "x"
            elif not plain.isalpha():
                known = ""
            elif plain in self.look_alike:
                known = "b"
            else:
                known = "c" if name.startswith("CYRILLIC") else "l" if name.startswith("LATIN") else "o"
            if len(self.kinds) < MOST_CLUSTERS:
                self.kinds[cluster] = known
        return known

    def __call__(self, text: str | None) -> str | None:
        """The consistent form; null stays null, empty stays empty."""
        if not text or _PLAIN.fullmatch(text):
            return text
        clusters = _CLUSTER.findall(text)
        kinds = [self.kind(c) for c in clusters]
        spans, start = [], -1
        for i, k in enumerate(kinds):
            if k and (start >= 0 or k != "x"):
                start = i if start < 0 else start
            elif not k and start >= 0:
                spans.append((start, i))
                start = -1
        if start >= 0:
            spans.append((start, len(clusters)))
        counts = [(kinds[a:b].count("c"), kinds[a:b].count("l"), b - a - kinds[a:b].count("x")) for a, b in spans]
        sides = ["" if not c and not l else "c" if c >= l else "l" for c, l, _ in counts]
        after = [""] * len(sides)  # nearest word with a script, behind and before
        for i in range(len(sides) - 2, -1, -1):
            after[i] = (1, sides[i + 1]) if sides[i + 1] else (after[i + 1][0] + 1, after[i + 1][1]) if after[i + 1] else ""
        before = ""
        out, at = [], 0
        for i, ((a, b), (_, _, n)) in enumerate(zip(spans, counts)):
            near = min([x for x in (after[i], before) if x], key=lambda x: x[0], default=(0, ""))[1]
            word = clusters[a:b]
            script = sides[i] or self._script(word, kinds[a:b], n, near, clusters[b][:1] in (".", "．") if b < len(clusters) else False)
            out.append(self.between(clusters[at:a]))
            out.append(self.by_script[script](word))
            before = (1, sides[i]) if sides[i] else (before[0] + 1, before[1]) if before else ""
            at = b
        out.append(self.between(clusters[at:]))
        return "".join(out)

    def _script(self, word: list[str], kinds: list[str], n: int, near: str, point: bool) -> str:
        """The script of a word without a letter of one script only."""
        if "o" in kinds:  # a word of another script
            return ""
        letters = [self.plain(c) for c, k in zip(word, kinds) if k != "x"]
        latin = "".join(self.to_latin.get(c, c) for c in letters)
        if _ROMAN.fullmatch(latin) and (n > 1 or not point) and any(c not in CYRILLIC for c in letters):
            return "l"
        if near:
            return near
        votes = sum(c in CYRILLIC for c in letters) - sum(c in LATIN for c in letters)
        return "c" if votes >= 0 else "l"


@lru_cache(maxsize=1)
def normalizer() -> Normalizer:
    return Normalizer()


@lru_cache(maxsize=100_000)
def _seen(text: str) -> str | None:
    return normalizer()(text)


def consistent_form(text: str | None) -> str | None:
    """The consistent form of one value; short values are remembered."""
    if text is None:
        return None
    return _seen(text) if len(text) < 200 else normalizer()(text)


def consistent(text: Column) -> Column:
    """The consistent form of a text column.

    Null stays null and empty stays empty; texts of any length are rewritten whole;
    repeated values are rewritten once per worker.
    """

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(consistent_form, na_action="ignore")

    return run(text)
