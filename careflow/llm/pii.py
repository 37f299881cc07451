"""Surrogates for personal data.

Detected entities get replacements that keep their type and format: digits
stay digits, letters keep their case and script, separators and lengths stay,
addresses stay addresses, card numbers keep whether their check digit is
right, names keep their script and gender. A replacement is a keyed hash of
the entity alone, so one entity has the same surrogate in every document and
in every case and separators it is written in, each mention in its own.
Surrogates that two entities would share, or that are themselves an entity of
the corpus, are drawn again until none collides.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from careflow.llm.common import cut, tidy

KEY = b"surrogate key"
#: Given names by script and gender. Fixed values.
NAMES = {
    ("latin", "f"): "Anna Maria Sofia Laura Julia Emma Clara Elena Marta Alice Sarah Helen Ingrid Camille".split(),
    ("latin", "m"): "Peter Paul Martin Thomas David Daniel Robert Jean Carlos Hans John James Michael Luis".split(),
    ("cyrillic", "f"): "Анна Мария Ольга Елена Ирина Наталья Светлана Татьяна".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Андрей Алексей Дмитрий Николай Михаил".split(),
}
#: Family names by script. Fixed values.
FAMILY = {"latin": "Adler Bauer Costa Dumas Ellis Ferrer Graham Hartmann Keller Lopez Moreau Novak Palmer Roux Stone "
                   "Turner Vega Weber".split(),
          "cyrillic": "Иваненко Петренко Ткаченко Шевченко Кравченко Бондаренко Коваленко Лысенко".split()}
#: Given names that are only found, not given. Fixed values.
FOUND = {
    ("latin", "f"): "Amelia Amy Andrea Angela Anne Annette Antonia Barbara Beatriz Birgit Brigitte Carla Carmen Carol "
                    "Caroline Catherine Charlotte Chiara Chloe Christina Christine Claire Claudia Cristina Diana Dorothy "
                    "Elisabeth Elizabeth Emily Emilia Eva Francesca Gabriele Giulia Hannah Heike Ines Irene Isabel Jane "
                    "Jennifer Jessica Joan Johanna Judith Karen Karin Katharina Katherine Kim Lea Lena Linda Lisa Lucia "
                    "Lucy Margaret Marie Marina Martina Mary Mia Michelle Monica Monika Nancy Natalie Nicole Olivia "
                    "Patricia Paula Petra Pilar Rachel Rebecca Rosa Ruth Sabine Sandra Sharon Silvia Sophia Sophie Stefanie "
                    "Stephanie Susan Susanne Teresa Ursula Valentina Valerie Victoria".split(),
    ("latin", "m"): "Adam Albert Alberto Alejandro Alexander Alfred Andreas Andrew Anthony Antoine Antonio Arthur Benjamin "
                    "Bernd Brian Charles Christian Christopher Claude Daniele Diego Dieter Dirk Edward Enrique Eric Fernando "
                    "Francesco Francisco Frank Franz George Georg Giovanni Giuseppe Guillaume Heinrich Henry Ivan Jack "
                    "Jason Javier Jeff Jeffrey Joachim Johannes Jonathan Jorge Jose José Joseph Juan Julien Kevin Klaus "
                    "Lars Laurent Leonardo Louis Lukas Manuel Marco Mario Mark Marc Matthew Matthias Max Miguel Nicholas "
                    "Nicolas Olivier Otto Pablo Patrick Pedro Philipp Philippe Pierre Rafael Ralf Raul Ricardo Richard "
                    "Roberto Ronald Ryan Samuel Scott Sergio Simon Stefan Stephen Steven Thierry Timothy Tobias Uwe "
                    "Vincent Walter Werner William Wolfgang".split(),
    ("cyrillic", "f"): "Александра Алина Алла Анастасия Валентина Вера Виктория Галина Дарья Екатерина Елизавета "
                       "Юлия Ксения Лариса Любовь Людмила Марина Надежда Оксана Полина".split(),
    ("cyrillic", "m"): "Александр Антон Артём Борис Вадим Валерий Василий Виктор Виталий Владимир Георгий Григорий "
                       "Денис Евгений Егор Игорь Илья Кирилл Константин Максим Олег Павел Роман Степан Юрий".split(),
}
_GENDER = {n: k for found in (FOUND, NAMES) for k, names in found.items() for n in names}
_LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя"}
_GIVEN = "|".join(x for n in sorted(_GENDER, key=len, reverse=True) for x in (n, n.upper()))
#: What stands before a name: titles, and words that introduce one. Fixed values.
_TITLE = (r"(?:(?:Mrs?|Ms|Miss|Dr|Prof|Mme|Mlle|Sra?|Srta|MRS?|MS|MISS|DR|PROF|MME|MLLE|SRA?|SRTA)\.?"
          r"|Herrn?|Frau|HERRN?|FRAU|Monsieur|Madame|Señora?|Professor|Господин|Госпожа)")
_INTRO = (r"(?:[Mm]y name is|[Ii]ch hei(?:ß|ss)e|[Mm]ein Name ist|[Jj]e m['’]appelle|[Mm]e llamo|[Мм]еня зовут"
          r"|[Ss]igned by|[Ff]ull name ?:|[Nn]ame ?:|NAME ?:)")
_UPPER, _LOWER = "A-ZÀ-ÖØ-ÞŁŚŠŽČĆŐŰİА-ЯЁІЇЄ", "a-zß-öø-ÿłśšžčćőűıа-яёіїє"
_PART = rf"(?:(?:Mc|Mac|[OD]['’])?[{_UPPER}][{_LOWER}]+|(?:[OD]['’])?[{_UPPER}]{{2,}})"
_SURNAME = rf"(?:(?:von|van|de|del|della|di|da|la|le|der|den|ter|dos) ){{0,2}}{_PART}(?:-{_PART})*"
#: A word that names a telephone number. Fixed values.
_CALL = r"(?:[Tt]el(?:ephone|efon|éfono|éphone)?|[Pp]hone|[Ff]ax|[Mm]obile|[Cc]ell|[Cc]all|[Hh]andy|TEL|PHONE|FAX|MOBILE)\.?:? ?"
_H = "[0-9A-Fa-f]{1,4}"

#: Entity patterns, the earlier ones first where they overlap.
_ANY = [
    r"(?P<email>(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+)",
    r"(?P<secret>(?<![0-9A-Za-z])(?:(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,}"
    r"|(?:sk|pk|ghp|AKIA|xox[bp])[-_]?[0-9A-Za-z]{16,}|(?:SK|PK|GHP|XOX[BP])[-_][0-9A-Z]{16,})(?![0-9A-Za-z]))",
    r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)",
    r"(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))",
    rf"(?P<ipv6>(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{_H}:){{7}}{_H}|(?=(?:[0-9A-Fa-f]*:){{2,7}}[0-9A-Fa-f]+(?![\w:]))"
    rf"{_H}(?::{_H}){{0,5}}::{_H}(?::{_H}){{0,5}})(?![\w:]))",
    r"(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}"
    r"|00[1-9]\d{0,2}[ ./-](?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|00[1-9]\d{7,9}"
    r"|(?:1[ .-])?\(\d{3}\) ?\d{3}[ .-]\d{4}|(?:1[ .-])?\d{3}[.-]\d{3}[.-]\d{4}|1 \d{3} \d{3} \d{4}"
    r"|\(0\d{1,5}\) ?\d{2,4}(?:[ -]?\d{2,4}){1,3}|0\d{2,5}[/-]\d{3,9}|(?=(?:\d ?){9,13}(?!\d))0\d{1,4}(?: \d{2,4}){2,4}"
    r")(?!\w))",
    r"(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))",
    r"(?P<card>(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w))",
]
_NAMES = [
    rf"(?P<name>\b(?=[{_UPPER}])(?:{_GIVEN}) {_SURNAME}(?!\w))",
    rf"(?P<titled>\b(?=[{_UPPER}]){_TITLE} (?:{_TITLE} )?(?P<who>{_SURNAME}(?: {_SURNAME})?)(?!\w))",
    rf"(?P<intro>\b{_INTRO} (?P<self>{_PART} {_SURNAME})(?!\w))",
]
_CALLS = [rf"(?P<called>\b{_CALL}(?!(?:\d{{1,3}}\.){{3}}\d{{1,3}}(?!\d)|\d{{3}}-\d\d-\d{{4}}(?!\d))(?P<number>\(?\d(?:[ ()/.-]{{0,2}}\d){{6,14}})(?!\w))"]
#: By whether a text can have names and named numbers; what it can't have isn't looked for.
PATTERN = {(n, c): re.compile("|".join(_ANY + n * _NAMES + c * _CALLS)) for n in (False, True) for c in (False, True)}

#: Every entity but a name has one of these.
_SIGNS = re.compile(r"[0-9@]|(?:sk|pk|ghp|AKIA|xox[bp])[-_0-9A-Za-z]{16}|(?:SK|PK|GHP|XOX[BP])[-_][0-9A-Z]{16}")
_WORDS = re.compile(r"\b[A-ZА-Я]\w+")
_KNOWN = _GENDER.keys() | {n.upper() for n in _GENDER}
_KNOWN |= frozenset("Mr Mrs Ms Miss Dr Prof Mme Mlle Sr Sra Srta MR MRS MS MISS DR PROF MME MLLE SR SRA Herr Herrn Frau "
                    "HERR HERRN FRAU Monsieur Madame Señor Señora Professor Господин Госпожа".split())
_LEADS = ("name is", "heiße", "heisse", "Name ist", "appelle", "me llamo", "Me llamo", "зовут", "igned by", "name:", "name :", "Name:",
          "Name :", "NAME:", "NAME :")
_NUMBERED = re.compile(rf"{_CALL}\(?\d")
#: Calling codes of one and two digits; others have three. Fixed values.
_CODES = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]")
_TAIL = re.compile(rf"[{_UPPER}][\w'’-]*\w")
#: What of a match is the mention, where not all of it.
_INNER = {"titled": "who", "intro": "self", "called": "number"}


def _address(text: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(text))
    except ValueError:
        return False


def _titled(word: str) -> str:
    return "-".join(w.capitalize() for w in word.split("-"))


def _halves(name: str) -> tuple[str, str]:
    """Given and family name; a single word, or one after a particle, is a family name."""
    given, _, family = name.partition(" ")
    return (given, family) if family and not given.islower() else ("", name)


def canonical(kind: str, mention: str) -> str:
    """The entity that a mention writes: one for all cases and separators."""
    if kind in ("email", "ssn"):
        return mention.casefold() if kind == "email" else mention
    if kind == "secret":
        return mention.lower() if re.fullmatch("[0-9A-Fa-f]+", mention) else mention
    if kind == "ipv6":
        return ipaddress.IPv6Address(mention).exploded
    if kind == "iban":
        return mention.replace(" ", "")
    if kind == "name":
        return " ".join(w if w.islower() else _titled(w) for w in mention.replace("’", "'").split(" "))
    digits = "".join(c for c in mention if "0" <= c <= "9")
    if kind == "phone":
        if mention[0] == "+" or digits.startswith("00"):
            return "+" + digits.removeprefix("00")
        if len(digits) == 11 and digits[0] == "1" or len(digits) == 10 and digits[0] != "0" or \
                re.fullmatch(r"\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}", mention):
            return "+" + ("1" if len(digits) == 10 else "") + digits
    return digits if kind in ("phone", "card") else mention


def mentions(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, type, entity, part) of the mentions in a text, which don't overlap.

    part is given or family where a mention has only that part of a name that
    the text has in full before it, else whole.
    """
    signs = _SIGNS.search(text)
    names = not _KNOWN.isdisjoint(_WORDS.findall(text)) or any(x in text for x in _LEADS)
    if not signs and not names:
        return []
    out, people = [], False
    for m in PATTERN[names, bool(signs and _NUMBERED.search(text))].finditer(text):
        kind = m.lastgroup
        s, e = m.span(_INNER.get(kind, kind))
        if kind == "ipv6" and not _address(m[0]):
            continue
        kind = {"titled": "name", "intro": "name", "called": "phone"}.get(kind, kind)
        out.append((s, e, kind, canonical(kind, text[s:e]), "whole"))
        people = people or kind == "name"
    return _parts(text, out) if people else out


def _parts(text: str, found: list[tuple[int, int, str, str, str]]) -> list[tuple[int, int, str, str, str]]:
    """With the later mentions of a part of a name found in full, which refer to the last that has it."""
    out, last, known = [], 0, {}

    def between(a: int, b: int) -> None:
        for m in _TAIL.finditer(text, a, b) if known else ():
            word, end = m[0], m.end()
            for tail in ("'s", "’s", "'S"):
                if word.endswith(tail):
                    word, end = word[:-2], end - 2
            word = canonical("name", word)
            if word in known:
                out.append((m.start(), end, "name", *known[word]))

    for s, e, kind, entity, part in found:
        between(last, s)
        last = e
        if kind == "name":
            given, family = _halves(entity)
            if given and family:
                known[given], known[family] = (entity, "given"), (entity, "family")
            elif family in known:
                entity, part = known[family]
        out.append((s, e, kind, entity, part))
    between(last, len(text))
    return out


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the mentions in a text, which don't overlap."""
    return [m[:3] for m in mentions(text)]


class _Stream:
    """Keyed pseudo-random numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.head, self.n, self.pool = (key, f"{kind}\0{value}\0{attempt}".encode()), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hashlib.blake2b(self.head[1] + self.n.to_bytes(4, "big"), key=self.head[0][:64]).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x % n


def _alike(text: str, r: _Stream) -> str:
    out = []
    for c in text:
        if "0" <= c <= "9":
            out.append(str(r.below(10)))
        elif c.isalpha():
            pool = _LETTERS["cyrillic" if "Ѐ" <= c <= "ӿ" else "latin"]
            d = pool[r.below(len(pool))]
            out.append(d.upper() if c.isupper() else d)
        else:
            out.append(c)
    return "".join(out)


def _luhn(digits: list[int]) -> int:
    return sum(d if i % 2 == 0 else (2 * d - 9 * (d > 4)) for i, d in enumerate(reversed(digits))) % 10


def surrogate(kind: str, value: str, key: bytes = KEY, attempt: int = 0) -> str:
    """The replacement of an entity, as ``canonical`` writes it, in its own format."""
    r = _Stream(key, kind, value, attempt)
    if kind == "email":
        local, _, domain = value.partition("@")
        *inner, _, top = domain.split(".")
        # a reserved domain, so that no one's address is made up
        top = top if top in ("com", "net", "org") else "com"
        return f"{_alike(local, r)}@{'.'.join([*(_alike(x, r) for x in inner), 'example', top])}"
    if kind == "ip":
        return ".".join(str(1 + r.below(254)) for _ in range(4))
    if kind == "ipv6":
        # the documentation block; groups of 0 stay, so that what is shortened stays so
        groups = [g if g == "0000" and not attempt else f"{1 + r.below(0xfffe):04x}" for g in value.split(":")[2:]]
        return ":".join(["2001", "0db8", *groups])
    if kind == "secret":
        return "".join("0123456789abcdef"[r.below(16)] if re.fullmatch("[0-9a-f]+", value) else _alike(c, r) for c in value)
    if kind == "iban":
        return value[:2] + _alike(value[2:], r)
    if kind == "phone" and value[0] == "+":
        code = _CODES.match(value, 1)
        head = code.end() if code else min(4, len(value) - 4)
        return value[:head] + _alike(value[head:], r)
    if kind == "phone" and value[0] == "0":
        return "0" + _alike(value[1:], r)
    if kind == "name":
        given, family = _halves(value)
        script, gender = _GENDER.get(given, ("cyrillic" if "Ѐ" <= value[0] <= "ӿ" else "latin", "fm"[r.below(2)]))
        pool, families = NAMES[script, gender], FAMILY["cyrillic" if "Ѐ" <= family[0] <= "ӿ" else "latin"]
        # past the list's combinations, attempts lengthen the family name
        tail = "".join(_LETTERS[script][r.below(20)] for _ in range(2 * attempt))
        first = f"{pool[r.below(len(pool))]} " if given else ""
        return f"{first}{families[r.below(len(families))]}{tail}"
    out = _alike(value, r)
    if kind == "card":
        digits = [int(c) for c in value if c.isdigit()]
        if _luhn(digits) == 0:
            last = max(i for i, c in enumerate(out) if c.isdigit())
            rest = [int(c) for c in out[:last] if c.isdigit()]
            out = out[:last] + str(-_luhn([*rest, 0]) % 10) + out[last + 1:]
    return out


def render(kind: str, mention: str, given: str, part: str = "whole") -> str:
    """The surrogate of a mention's entity in the mention's own case and separators."""
    if kind in ("phone", "card"):
        digits, out = [c for c in given if c.isdigit()], []
        for c in reversed(mention):
            out.append(digits.pop() if "0" <= c <= "9" and digits else c)
        return "".join(reversed(out))
    if kind == "iban":
        left = iter(given)
        return "".join(c if c == " " else next(left) for c in mention)
    if kind == "name":
        first, _, rest = given.partition(" ")
        given = {"whole": given, "given": first, "family": rest}[part]
        return given.upper() if mention.isupper() else given
    if kind == "ipv6":
        address = ipaddress.IPv6Address(given)
        given = address.compressed if "::" in mention else ":".join(f"{int(g, 16):x}" for g in given.split(":"))
        return given.upper() if mention.isupper() else given
    if kind == "secret" and re.fullmatch("[0-9A-Fa-f]+", mention):
        if len({c.isupper() for c in mention if c.isalpha()}) == 1:
            return given.upper() if mention.isupper() else given
        return "".join(g.upper() if c.isupper() else g for c, g in zip(mention, given))
    if kind == "email":
        if mention.isupper():
            return given.upper()
        n = mention.index("@")
        return "".join(g.upper() if c.isupper() else g for c, g in zip(mention[:n], given)) + given[n:]
    return given


def _drawn(rows: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt, surrogate) of (kind, value, attempt)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [surrogate(k, v, key, a) for k, v, a in zip(*(b.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.string())],
                                             names=["kind", "value", "attempt", "surrogate"])
    return rows.select("kind", "value", "attempt").mapInArrow(
        run, "kind string, value string, attempt int, surrogate string")


def assigned(values: DataFrame, key: bytes, rounds: int = 30) -> DataFrame:
    """(kind, value, surrogate) of distinct entities, without two that share one.

    An entity whose surrogate is an entity of the corpus, or is also that of
    an entity with fewer attempts or a smaller value, draws again.
    """
    now = cut(_drawn(values.withColumn("attempt", F.lit(0)), key))
    for _ in range(rounds):
        real = values.select(F.col("kind"), F.col("value").alias("surrogate"), F.lit(True).alias("real"))
        first = Window.partitionBy("kind", "surrogate").orderBy("attempt", "value")
        judged = (now.withColumn("n", F.row_number().over(first)).join(real, ["kind", "surrogate"], "left")
                  .withColumn("clash", (F.col("n") > 1) | F.col("real").isNotNull()))
        clash = judged.where("clash").select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        if clash.isEmpty():
            return now.select("kind", "value", "surrogate")
        kept = judged.where(~F.col("clash")).select("kind", "value", "attempt", "surrogate")
        now = cut(kept.unionByName(_drawn(clash, key)))
    raise RuntimeError("surrogates still collide")


def replace(docs: DataFrame, key: str = "doc_id", text: str = "text", secret: bytes = KEY,
            carry: list[str] | None = None) -> DataFrame:
    """(key, *carry, text, n_entities, kinds) of every row, with surrogates for its entities.

    ``text`` is the whole text with all entities replaced (null stays null),
    kinds counts the entities of each type. Rows with equal keys and texts are
    alike; null keys are carried through; an empty table stays empty.
    """
    kind = docs.schema[key].dataType.simpleString()
    docs = docs.select(key, *[c for c in carry or []], text).withColumn("text_hash", F.xxhash64(text))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, kinds, values = [], [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                if t:
                    for k, v in dict.fromkeys((k, v) for _, _, k, v, _ in mentions(t)):
                        row.append(i), kinds.append(k), values.append(v)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(kinds, pa.string()),
                 pa.array(values, pa.string())], names=[key, "text_hash", "kind", "value"])

    found = cut(docs.select(key, "text_hash", text).mapInArrow(
        find, f"`{key}` {kind}, text_hash long, kind string, value string"))
    given = assigned(cut(found.select("kind", "value").distinct()), secret)
    lists = cut(found.join(given, ["kind", "value"]).distinct().groupBy(key, "text_hash").agg(
        F.collect_list(F.struct("kind", "value", "surrogate")).alias("given")))
    tidy(docs.sparkSession)
    same = F.col(f"d.{key}").eqNullSafe(F.col(f"x.{key}")) & (F.col("d.text_hash") == F.col("x.text_hash"))
    joined = docs.alias("d").join(lists.alias("x"), same, "left").select(
        *[f"d.{c}" for c in [key, *(carry or []), text]], "x.given")
    at = 1 + len(carry or [])
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in [key, *(carry or [])])

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, kinds = [], [], []
            for t, given in zip(b.column(at).to_pylist(), b.column(at + 1).to_pylist()):
                n: dict[str, int] = {}
                if given:
                    to = {(g["kind"], g["value"]): g["surrogate"] for g in given}
                    parts, last = [], 0
                    for s, e, k, v, p in mentions(t):
                        parts += [t[last:s], render(k, t[s:e], to[k, v], p)]
                        last, n[k] = e, n.get(k, 0) + 1
                    t = "".join([*parts, t[last:]])
                texts.append(t), counts.append(sum(n.values())), kinds.append(list(n.items()))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:at], pa.array(texts, pa.string()), pa.array(counts, pa.int64()),
                 pa.array(kinds, pa.map_(pa.string(), pa.int64()))],
                names=[key, *(carry or []), text, "n_entities", "kinds"])

    return joined.mapInArrow(swap, fields + f"`{text}` string, n_entities long, kinds map<string,bigint>")
