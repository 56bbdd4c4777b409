"""Taking a printed personal name apart: surname, given names, ordinal."""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import regex

from vellum.llm.charforms import consistent_form

#: Letters of old and new Russian spelling in the Latin letters used for names in French.
LATIN_OF = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "j", "з": "z", "и": "i", "й": "i", "і": "i", "ї": "i", "к": "k",
    "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "ou", "ф": "f", "ѳ": "f", "х": "kh", "ц": "ts", "ч": "tch",
    "ш": "ch", "щ": "chtch", "ы": "y", "э": "e", "ѣ": "e", "ю": "iou", "я": "ia", "ь": "", "ъ": "", "ѵ": "i",
}
#: Familiar forms of given names, by the Latin form of the full name.
FAMILIAR = {
    "aleksandr": "саша шура", "aleksandra": "саша шура", "aleksei": "алеша леша", "anna": "аня нюра анюта", "anastasiia": "настя", "boris": "боря",
    "varvara": "варя", "vasilii": "вася", "vera": "вера", "viktor": "витя", "vladimir": "володя вова", "galina": "галя", "georgii": "жоржъ гоша", "glafira": "глаша",
    "grigorii": "гриша", "daria": "даша", "dmitrii": "митя дима", "evgenii": "женя", "evgeniia": "женя", "ekaterina": "катя", "elena": "лена леля", "elizaveta": "лиза", "efim": "фима",
    "janna": "жанна", "zakhar": "захаръ", "zinaida": "зина", "ivan": "ваня", "irina": "ира", "iosif": "ося", "kirill": "кира", "klavdiia": "клава клаша", "konstantin": "костя", "kouzma": "кузя",
    "lev": "лева", "lidiia": "лида", "lioubov": "люба", "lioudmila": "люда мила", "margarita": "рита", "mariia": "маша маня маруся", "mikhail": "миша", "nadejda": "надя", "nataliia": "наташа",
    "nikolai": "коля", "nina": "нина", "oleg": "олегъ", "olga": "оля", "pavel": "паша", "petr": "петя", "pelagia": "поля", "praskovia": "параша паша", "raisa": "рая", "roman": "рома", "sergei": "сережа",
    "sofia": "соня", "stepan": "степа", "tamara": "тома", "tatiana": "таня", "timofei": "тима", "fedor": "федя", "fekla": "фекла", "feodosiia": "феня", "iakov": "яша", "iouri": "юра", "iouliia": "юля юленька", "ioulii": "юлій", "orest": "орестъ",
}

_REFORM = str.maketrans("ѣіѳѵё", "еифие")
_HONORIFIC = regex.compile(r"^(?:(?i:г-жа|г-жи|г-нъ|г-н|г-на|гг|mr|mrs|miss|mme)|г)(?:\.\s*|\s+)(?=\p{L}{3}|\p{Lu}\.)")
_ORDINAL = regex.compile(r"\s*\b([1-9])\s*-\s*(й|я|го|ой)\b", regex.IGNORECASE)
_PART = regex.compile(r"\p{L}+(?:-\p{L}+)*\.?")


class Name(NamedTuple):
    """Parts of a name in Latin letters; empty where not printed.

    first_kind and patronymic_kind: ``full``, ``initial``, ``abbrev`` or empty.
    cut: the surname's end is left out, as a point shows.
    """

    surname: str
    cut: bool
    first: str
    first_kind: str
    patronymic: str
    patronymic_kind: str
    ordinal: str
    gender: str


@lru_cache(maxsize=200_000)
def latin(text: str) -> str:
    """Lower case, Latin letters, spelling reform undone; other scripts stay."""
    low = text.lower()
    if not regex.search(r"\p{Cyrillic}", low):
        return "".join(c for c in low if c.isalpha())
    out = []
    for c in low:
        if c.isalpha():
            out.append(LATIN_OF.get(c, c))
    return "".join(out)


_BY_FAMILIAR: dict[str, list[str]] = {}
for _full, _forms in FAMILIAR.items():
    for _form in _forms.split():
        _BY_FAMILIAR.setdefault(latin(_form), []).append(_full)


def _kind(part: str) -> str:
    bare = part.rstrip(".")
    if "-" in bare and regex.fullmatch(r"\p{Lu}-\p{Ll}{1,3}", bare):
        return "abbrev"
    if part.endswith("."):
        return "initial" if len(bare) == 1 or latin(bare) in ("iou", "ia", "tch", "ch", "ts", "kh") else "abbrev"
    return "initial" if len(bare) == 1 else "full"


def gender_of(surname: str, first: str, ordinal_end: str) -> str:
    """``f``, ``m`` or empty, from the surname's ending, the given name, the ordinal."""
    if ordinal_end == "я":
        return "f"
    if regex.search(r"(?:ova|eva|ina|aia|yna)$", surname):
        return "f"
    if regex.search(r"(?:ov|ev|in|ii|yn|kii)$", surname) and not surname.endswith("ein"):
        return "m"
    if ordinal_end == "й":
        return "m"
    return ""


@lru_cache(maxsize=200_000)
def parse(text: str | None) -> Name | None:
    """The parts of a printed name, or null where no surname can be seen."""
    if not text:
        return None
    plain = (consistent_form(text) or "").strip()
    if plain.endswith(".") and not regex.search(r"\b\p{L}\.$", plain) and not regex.search(r"(?:^|\s)\p{L}{1,3}\.$", plain) or plain.endswith(".."):
        plain, cut = plain.rstrip(".").rstrip(), True
    else:
        cut = False
    plain = _HONORIFIC.sub("", plain)
    found = _ORDINAL.search(plain)
    ordinal, end = (found[1], found[2][-1].lower().replace("о", "й").replace("г", "й")) if found else ("", "")
    plain = _ORDINAL.sub("", plain)
    before, comma, after = plain.partition(",")
    parts, tail = _PART.findall(before), _PART.findall(after) if comma else []
    if not parts:
        return None
    if comma and tail:
        surname, given = parts[-1], tail
    else:
        words = [p for p in parts if _kind(p) != "initial" and not (p.endswith(".") and p is not parts[-1])]
        words = [w for w in words if _kind(w) == "full"] or words
        if not words:
            return None
        if len(parts) > 1 and _kind(parts[0]) == "full" and all(_kind(p) == "initial" for p in parts[1:]):
            surname, given = parts[0], parts[1:]
        else:
            surname, given = parts[-1], parts[:-1]
    sur = latin(surname)
    if len(sur) < 3:
        return None
    first = given[0] if given else ""
    patronymic = given[1] if len(given) > 1 else ""
    first_latin = latin(first) if "-" not in first else latin(first.split("-")[0]) + "-" + latin(first.split("-")[1])
    return Name(sur, cut, first_latin, _kind(first) if first else "", latin(patronymic), _kind(patronymic) if patronymic else "", ordinal, "" if cut and not end else gender_of(sur, first_latin, end))


def folded_surname(text: str, name: Name) -> tuple[str, bool]:
    """The surname in reformed Russian spelling, and whether it was printed in Latin
    letters (then it is given as printed)."""
    plain = (consistent_form(text) or "").lower()
    for word in regex.findall(r"\p{L}+(?:-\p{L}+)*", plain):
        if latin(word) == name.surname:
            if not regex.search(r"\p{Cyrillic}", word):
                return name.surname, True
            return regex.sub(r"ъ$", "", word.translate(_REFORM)), False
    return name.surname, not regex.search(r"\p{Cyrillic}", plain)


def initial(part: str) -> str:
    """First sound of a name in Latin letters, as an initial would give it."""
    for lead in ("iou", "ia", "tch", "chtch", "ch", "ts", "kh", "j"):
        if part.startswith(lead):
            return lead
    return part[:1]


def first_names(first: str) -> list[str]:
    """Full names a familiar form may stand for; itself if it is none."""
    return _BY_FAMILIAR.get(first, [first])
