"""Cues of personal information in one text: tokens, patterns, word lists.

``formats`` are observations of the field in ``crf``. ``cue_spans`` gives the weak labels
of the texts it is fitted on, and nothing else.
"""

from __future__ import annotations

import regex

#: Given names by language, in their usual spelling.
GIVEN_NAMES = """
Hugh Harriet Clara Simon Maud Beatrice Edwin Walter Nora Oliver Agnes Albert Alice Arthur Charles Edith Edward Eleanor Emily Florence Frank Frederick George
Grace Henry James Jane John Margaret Mary Robert Ruth Thomas William
Bastien Élise Céline Solène Gaspard Rémi Mathieu Odile Antoine Camille Claire Étienne Jean Louise Luc Marie Paul Pierre Sophie
Ilse Anselm Greta Jürgen Heiner Käthe Björn Lotte Anna Fritz Hans Heinrich Karl Otto Ursula Wilhelm
""".split()
#: Russian given names in reformed spelling, without the hard sign.
GIVEN_NAMES_RU = """
Александр Александра Алексей Алёна Анна Анастасия Борис Валентин Варвара Василий Вера Виктор Владимир Галина Георгий Глафира Григорий Дарья Дмитрий Евгений Евгения
Екатерина Елена Елизавета Ефим Жанна Захар Зинаида Иван Игорь Илья Ирина Кирилл Клавдия Константин Кузьма Лариса Лев Леонид Лидия Любовь Людмила Мария Марк Михаил Надежда
Наталья Николай Никита Нина Олег Ольга Орест Осип Павел Пётр Прасковья Раиса Родион Роман Савелий Семён Сергей Софья Степан Тамара Татьяна Тимофей Федор Фёдор Фома Фекла
Эдуард Юлий Юлия Юрий Яков Ярослав Костя Аня Варя Соня Катя Коля Маша Миша Надя Оля Паша Саша Таня Петя
""".split()
_REFORM = str.maketrans("ѣіѳѵё", "еифие")
_REFORM_UP = str.maketrans("ѢІѲѴЁ", "ЕИФИЕ")


def reformed(word: str) -> str:
    return word.translate(_REFORM).translate(_REFORM_UP).removesuffix("ъ").removesuffix("Ъ").lower()


GIVEN = {g.lower() for g in GIVEN_NAMES} | {reformed(g) for g in GIVEN_NAMES_RU}

#: Words before a number that make it a record, a shelf mark or a page.
NOT_PERSONAL = r"(?:record|entry|batch|shelf\s+mark|folder\s+marked|folder|item|cote|bestellt|signatur|запрошено|запис[иья]|каталоге|ф\.|оп\.|д\.|л\.|page|pages|seite|стр\.?|странице|№\s*дела)"
#: Words before a number that make it an identity number.
IDENTITY = r"(?:паспорт\w*|удостоверен\w*|identit\w+|identity\s+number|\bid\b|ausweis\w*|personalausweis\w*|passport|снилс|инн|insurance\s+number|numéro\s+d['’]identité)"

EMAIL = regex.compile(
    r"(?<![\w.+@＠-])[\w+-]+(?:\.[\w+-]+)*(?:\s?[@＠]\s?|\s?[\(\[\{]\s?(?:at|собака|ät|arobase)\s?[\)\]\}]\s?)[\w-]+(?:(?:\.|\s?[\(\[\{]\s?(?:dot|точка|punkt|point)\s?[\)\]\}]\s?|\s(?:dot|точка|punkt|point)\s)[\w-]+)+"
    r"|(?<![\w.+@＠-])[\w+-]+(?:\.[\w+-]+|\s(?:dot|точка|punkt|point)\s[\w+-]+)*\s(?:at|собака|ät|chez|arobase)\s[\w-]+(?:\s(?:dot|точка|punkt|point)\s[\w-]+)+",
    regex.IGNORECASE,
)
ID = regex.compile(
    r"(?<![\w-])(?:QQ\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]"
    r"|L0[0-9A-Z]{2}\s?[0-9A-Z]{3}\s?[0-9A-Z]{2,3}"
    r"|\d{3}-\d{3}-\d{3}[ -]\d{2}"
    r"|[12]\s\d{2}\s\d{2}\s(?:\d{2}|2[AB])\s\d{3}\s\d{3}\s\d{2}|[12]\d{14}"
    r"|00\s?\d{2}(?:,?\s(?:номер|№|N)\s?|\s?№?\s?)\d{6}"
    r"|(?:000|666|9\d\d)[- ]\d{2}[- ]\d{4})(?![\w-])"
)
ID_AFTER = regex.compile(rf"{IDENTITY}(?:\W+(?:\p{{Ll}}+\W+){{0,4}}?|\W+)(?P<n>[A-Z0-9](?:[\w №-]|,\s?номер\s)*\d\w*)(?!\w)", regex.IGNORECASE)
PHONE = regex.compile(
    r"(?<![\w/.+-])(?:\+\d{1,3}[ -]?(?:\(\d{1,5}\)[ -]?)?\d(?:[ ./–-]?\d){6,11}"
    r"|8[ -]?\(?\d{3,4}\)?[ -]?\d{3}[ -]?\d{2}[ -]?\d{2}"
    r"|\(\d{2,5}\)[ -]?\d{3,4}[ -]?\d{3,5}"
    r"|\d{3}[.-]\d{3}[.-]\d{4}"
    r"|0[1-9](?:[ .]\d{2}){4}"
    r"|0[1-9]\d{1,4}[ /-]\d{3,5}[ -]?\d{3,5}|0[1-9]\d[ /-]?\d{5}[ -]?\d{3}"
    r"|020\s?\d{4}\s?\d{4}|0[1-9]\d{8,9})(?![\w]|[-./]\d)"
)
#: Where an e-mail address may stand: only lines that hold one of these are read for it.
EMAIL_MARK = regex.compile(
    r"[@＠]|[\(\[\{]\s?(?:at|собака|ät|arobase)\s?[\)\]\}]|\s(?:at|собака|ät|chez|arobase)\s[\w-]+\s(?:dot|точка|punkt|point)\s", regex.IGNORECASE
)
#: Any number of some length, whatever it means.
NUMBER = regex.compile(r"(?<![\w.+-])[+(]?\p{Lu}{0,2}\d[\p{Lu}\d]*(?:(?:[ .–/()-]{1,3}|,\s?номер\s|\s№\s?)\p{Lu}?\d[\p{Lu}\d]*|[ -][\p{Lu}\d]{1,3}(?=[\s.,;)]|$))*(?!\w)")
_TOWN = r"\p{Lu}[\p{L}’'-]+(?:[^\S\r\n]\p{Lu}\p{L}+)?"
_STREET_RU = r"(?:(?:ул\.|улица|наб\.|набережная|пер\.|переулок|просп\.|проспект|пл\.|площадь|бульв\.|бульвар|шоссе)[^\S\r\n]?\p{Lu}[\p{L}-]+|\p{Lu}[\p{L}-]+[^\S\r\n](?:ул\.|улица|наб\.|набережная|пер\.|переулок|просп\.|проспект|пл\.|площадь|бульв\.|бульвар|шоссе))"
ADDRESS = regex.compile(
    rf"(?<![\w])(?:\d{{6}},[^\S\r\n])?(?:(?:г\.|город|с\.|пос\.)[^\S\r\n]?{_TOWN},[^\S\r\n]|(?<!по[^\S\r\n])\p{{Lu}}\p{{Ll}}+,[^\S\r\n])?{_STREET_RU},[^\S\r\n](?:д\.|дом)?[^\S\r\n]?\d+\p{{L}}?(?:[-/]\d+)?(?:,[^\S\r\n](?:корп\.|к\.|стр\.)[^\S\r\n]?\d+)?(?:,[^\S\r\n](?:кв\.|квартира)[^\S\r\n]?\d+)?"
    rf"|(?<![\w])(?:(?:Flat|Apt|Apartment|Unit)[^\S\r\n]\d+,[^\S\r\n])?\d+[a-z]?,?[^\S\r\n](?:\p{{Lu}}[\p{{L}}’']+[^\S\r\n]){{1,2}}(?:Street|St\.?|Lane|Road|Rd\.?|Avenue|Ave\.?|Square|Terrace|Row|Close|Drive|Way)(?:,[^\S\r\n](?:Flat|Apt|Apartment|Unit)[^\S\r\n]\d+)?(?:,[^\S\r\n]{_TOWN})?(?:,?[^\S\r\n][A-Z]{{1,2}}\d{{1,2}}[^\S\r\n]\d[A-Z]{{2}}|,?[^\S\r\n]\d{{5}}\b)?"
    rf"|(?<![\w])(?:PO|P\.O\.)[^\S\r\n]Box[^\S\r\n]\d+(?:,[^\S\r\n]{_TOWN})?(?:,?[^\S\r\n][A-Z]{{1,2}}\d{{1,2}}[^\S\r\n]\d[A-Z]{{2}}|,?[^\S\r\n]\d{{5}}\b)?"
    rf"|(?<![\w])(?:BP[^\S\r\n]\d+|\d+(?:[^\S\r\n](?:bis|ter))?,?[^\S\r\n](?:rue|av\.|avenue|bd|boulevard|quai|place|impasse|allée|chemin)[^\S\r\n](?:(?:de[^\S\r\n]la|des|du|de[^\S\r\n]l['’]|de|d['’])[^\S\r\n]?)?\p{{Lu}}[\p{{L}}-]+(?:[^\S\r\n]\p{{Lu}}[\p{{L}}-]+)*),[^\S\r\n](?:\d{{5}}[^\S\r\n])?{_TOWN}"
    rf"|(?<![\w])(?:Postfach[^\S\r\n]\d+|(?:(?:Am|An[^\S\r\n]der|Im|Zum)[^\S\r\n])?\p{{Lu}}\p{{L}}*(?:weg|platz|gasse|straße|strasse|str\.|allee|ufer|ring|damm)[^\S\r\n]\d+[^\S\r\n]?[a-z]?\b)(?:,[^\S\r\n](?:\d{{5}}[^\S\r\n])?{_TOWN})?"
)
_SURNAME_RU = (
    r"\p{Lu}[\p{Ll}]+(?:ов|ев|ёв|ин|ын|ский|скій|цкий|цкій|енко|ейн|ич|ова|ева|ина|ская|цкая|скаго|цкаго|ского|цкого|скимъ?|цкимъ?|скому|цкому|овымъ?|евымъ?|инымъ?|ейномъ?|ичемъ?|овой|овою|евой|евою|иной|иною|ской|скою|цкой|цкою|ейна|ича)ъ?"
)
_CAP = r"(?:\p{Lu}['’]\p{Lu}\p{Ll}+|\p{Lu}[\p{Ll}]+(?:\p{Lu}\p{Ll}+)?(?:-\p{Lu}\p{Ll}+)?|\p{Lu}{3,}(?:['’-]\p{Lu}{2,})?|\p{Lu}['’]\p{Lu}{3,})"
_INIT = r"(?:\p{Lu}\.|Iou\.|Ia\.|Tch\.|Ch\.|Ts\.|Kh\.)"
_S = r"[^\S\r\n]?"
_GIVEN_RU = "|".join(sorted({regex.sub(r"[её]", "[еёѣ]", regex.sub(r"и", "[иі]", regex.sub(r"[Фф]", "[ФѲфѳ]", g))) for g in GIVEN_NAMES_RU}, key=len, reverse=True))
_GIVEN_EN = "|".join(sorted(map(regex.escape, GIVEN_NAMES), key=len, reverse=True))
_G = rf"(?:{_GIVEN_RU}|{_GIVEN_EN})ъ?(?!\p{{L}})"
_PATR = r"\p{Lu}[\p{Ll}]+(?:ович|евич|ич|ична|овна|евна|инична)ъ?"
NAME = regex.compile(
    rf"(?<![\p{{L}}\d'’.-])(?:{_G}[^\S\r\n](?:{_PATR}[^\S\r\n])?(?:{_INIT}{_S})*{_CAP}"  # Oliver H. Surname, Имя Отчество Фамилія
    rf"|(?:{_INIT}{_S}){{1,3}}{_CAP}"  # А. Б. Фамилія
    rf"|{_CAP},[^\S\r\n]{_G}(?![^\S\r\n](?!{_PATR}){_CAP})(?:[^\S\r\n]{_PATR}|(?:[^\S\r\n]{_INIT})+(?![\p{{L}}\d]))?"  # Surname, Oliver
    rf"|{_SURNAME_RU}[^\S\r\n](?:{_G}[^\S\r\n]{_PATR}|{_G}(?=[\s,.;:)]|$))"  # Фамилія Имя Отчество
    rf"|{_SURNAME_RU}[^\S\r\n]{_INIT}(?:{_S}{_INIT})?|{_SURNAME_RU},[^\S\r\n]{_INIT}(?:{_S}{_INIT})?+(?!{_S}{_CAP}))(?!\p{{L}}|['’]\p{{L}})"
)
HONORED = regex.compile(rf"(?<![\p{{L}}.])(?:[Гг]-(?:жа|жи|жѣ|жею|жу|нъ|на|ну|номъ|н)|гг?\.|Mrs?\.?|Miss|Ms\.?|Dr\.?|Mme|Mlle|Herr|Herrn|Frau|Monsieur|Madame)[^\S\r\n](?P<n>(?:(?:{_INIT}{_S}){{1,3}})?{_CAP}(?:[^\S\r\n](?:{_INIT}{_S})*{_CAP})?(?:,[^\S\r\n]{_G}(?:[^\S\r\n]{_INIT})?(?![^\S\r\n]{_CAP}))?)(?!\p{{L}})")
LABELLED = regex.compile(rf"(?:Заявитель|Выдал|Applicant|Issued[^\S\r\n]by|Name|Antragsteller|Nom|Demandeur|получатель)[^\S\r\n]?:?[^\S\r\n](?P<n>{_SURNAME_RU},?[^\S\r\n]{_INIT}(?:{_S}{_INIT})?|(?:{_INIT}{_S})*{_CAP}(?:[^\S\r\n](?:{_INIT}{_S})*{_CAP}){{0,2}}(?:,?[^\S\r\n](?:{_INIT}{_S}){{1,2}}(?!\p{{L}})|,[^\S\r\n]{_G}(?:[^\S\r\n]{_INIT})?)?)(?!\p{{L}})")
BARE_RU = regex.compile(rf"(?<=[\p{{Ll}},;ъ»)\d][^\S\r\n])(?P<n>{_SURNAME_RU})(?!\p{{L}})")
QUOTED = regex.compile(r"«[^»\n]{0,200}»")
THEATRE = regex.compile(r"[Тт]еатр\p{L}*\s(?:\p{Lu}\p{Ll}+\s?){1,2}")
#: Words with a capital that begin no name.
NO_NAME = set(
    """Prince Queen Mill King Princess Moscow Prima Flat Apt Road Street Lane Page Record Batch Shelf Entry The Half Nothing Nobody Asked Checked For Questions Footnotes Receipts Spent She
    Dear Yours Please My Sehr Meine Auf Für Die Mit Ma Mon Le La Les Madame Monsieur Avec Cordialement Если Мой Моя Роль Номер Дело Для Копию Посылку Бабушка По Прошу Пишите Адрес Театръ Театр Въ В Къ Съ
    Балетъ Балет Опера Первое Новая Новый Авторъ Рисунки Изъ Нельзя Публика Вообще Послѣдній Вторымъ Хористы Покойная Надъ Товарищи Память Лучшими Оставивъ Послѣдніе""".split()
)
DIGIT = regex.compile(r"\d")
TOKEN = regex.compile(r"[\p{L}\p{N}]+(?:['’_][\p{L}\p{N}]+)*|[^\s]")
SUR_END = regex.compile(_SURNAME_RU)


def tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


def emails(text: str):
    """Matches of e-mail addresses; lines without a mark of one are passed over."""
    at = 0
    while (mark := EMAIL_MARK.search(text, at)) is not None:
        begin, stop = text.rfind("\n", 0, mark.start()) + 1, text.find("\n", mark.end())
        stop = len(text) if stop < 0 else stop
        yield from EMAIL.finditer(text, max(begin, at), stop)
        at = stop


def formats(text: str) -> list[tuple[str, int, int]]:
    """Number, address and e-mail formats of a text, whatever they stand for."""
    found = [("email", *m.span()) for m in emails(text)]
    if DIGIT.search(text):
        found += [("address", *m.span()) for m in ADDRESS.finditer(text) if DIGIT.search(m[0])]
        found += [("id", *m.span()) for m in ID.finditer(text)]
        found += [("phone", *m.span()) for m in PHONE.finditer(text)]
        found += [("number", *m.span()) for m in NUMBER.finditer(text) if sum(map(str.isdigit, m[0])) >= 5]
    return found


def _name_ok(text: str, a: int, b: int) -> bool:
    first = regex.match(r"\p{L}+", text[a:b])
    return not (first and first[0] in NO_NAME and text[a + len(first[0]) : a + len(first[0]) + 1] != ".")


def cue_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern matches as (kind, start, end), not overlapping, surer kinds first."""
    found: list[tuple[str, int, int]] = []

    def add(kind: str, a: int, b: int) -> None:
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a and all(b <= x or a >= y for _, x, y in found):
            found.append((kind, a, b))

    for m in emails(text):
        add("email", *m.span())
    barred = [m.span() for m in QUOTED.finditer(text)] + [m.span() for m in THEATRE.finditer(text)]
    for m in ADDRESS.finditer(text):
        if regex.search(r"\d", m[0]):
            add("address", *m.span())
    for m in ID.finditer(text):
        before = text[max(0, m.start() - 40) : m.start()]
        if not regex.search(rf"(?:^|\W){NOT_PERSONAL}\W*$", before, regex.IGNORECASE):
            add("id_number", *m.span())
    for m in ID_AFTER.finditer(text):
        a, b = m.span("n")
        if sum(c.isdigit() for c in text[a:b]) >= 6 and not regex.search(rf"(?:^|\W){NOT_PERSONAL}", text[m.start() : a], regex.IGNORECASE):
            add("id_number", a, b)
    for m in PHONE.finditer(text):
        before = text[max(0, m.start() - 40) : m.start()]
        if not regex.search(rf"(?:^|\W){NOT_PERSONAL}\W*$", before, regex.IGNORECASE):
            add("phone", *m.span())

    def name(a: int, b: int) -> None:
        if all(b <= x or a >= y for x, y in barred) and _name_ok(text, a, b):
            add("name", a, b)

    for pattern in (HONORED, LABELLED):
        for m in pattern.finditer(text):
            name(*m.span("n"))
    at = 0
    while (m := NAME.search(text, at)) is not None:
        a, b = m.span()
        if _name_ok(text, a, b):
            name(a, b)
            at = b
        else:  # a capital word before the name itself
            at = a + 1
    for m in BARE_RU.finditer(text):
        name(*m.span("n"))
    return sorted(found, key=lambda s: s[1])


def shape(word: str) -> str:
    """Coarse shape of a token."""
    if word.isdigit():
        return f"d{min(len(word), 7)}"
    if word.isalpha() or word.replace("'", "").replace("’", "").isalpha():
        if len(word) == 1:
            return "I" if word.isupper() else "x"
        if word.isupper():
            return "UP"
        if word[0].isupper():
            return ("G" if reformed(word) in GIVEN else "S" if SUR_END.fullmatch(word) else "C")
        return "w"
    if any(c.isdigit() for c in word) and any(c.isalpha() for c in word):
        return "m"
    return word if len(word) == 1 else "?"
