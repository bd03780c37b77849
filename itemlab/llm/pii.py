"""Personal data replaced by surrogates: keyed, of the same type and form, distinct and coreferent.

An entity's surrogate is drawn by an HMAC of its type, its canonical form and an attempt. All
documents' distinct entities are listed once; those whose surrogate another entity has, or is an
entity itself, draw again until none is left. As nearly all keep their first draw, only the others'
attempts are sent to the texts.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import ipaddress
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, resident, scratch_path, small_batches, stored, table, valid

#: Key of the surrogates; a secret of the caller in production.
KEY = b"surrogate-key"
#: Entities of which the attempts are broadcast at most; beyond that they are joined to the documents.
BROADCAST_ROWS = 500_000
#: Characters before a number in which a word for cards makes it one, though its check digit is wrong.
CARD_REACH = 64
#: From this attempt on a surrogate is longer than its form, or of a wider range, so that small ranges can't run out.
WIDEN = 12

#: Given names that are recognised and drawn from, by gender and script; an own choice of frequent ones.
NAMES = {
    ("f", "latin"): "Anna Maria Laura Julia Emma Sophie Claire Camille Elena Carmen Lucia Ingrid Katrin Petra Susan Linda Karen"
    " Jennifer Jessica Sarah Emily Olivia Alice Helen Nancy Margaret Elizabeth Barbara Isabel Marta Ana Sofia Rosa Giulia Chloé Léa"
    " Heike Astrid Fatima Aisha Priya Yuki Mei Amara".split(),
    ("m", "latin"): "James John Robert Michael David William Richard Thomas Charles Daniel Matthew Andrew Peter Paul George"
    " Kevin Brian Edward Hans Klaus Stefan Pierre Jean Antoine Carlos Miguel Pablo Javier Luis Diego José Juan Jorge Mateo Marco Luca"
    " Jürgen Uwe Lars Sven Mohammed Ahmed Omar Raj Wei Hiroshi Kofi".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия".split(),
    ("m", "cyrillic"): "Иван Алексей Дмитрий Сергей Андрей Михаил Николай Павел Виктор Олег".split(),
}
#: Family names to draw from, by script; Cyrillic ones in -а for women.
FAMILIES = {
    "latin": "Abbott Barker Carter Dalton Ellison Fisher Garner Harlow Irving Jarvis Keller Lawson Mercer Norton Osborne"
    " Palmer Quinn Ramsey Sutton Turner Upton Vaughn Walton Yates Weber Richter Moreau Laurent Navarro Ortega".split(),
    "cyrillic": "Белов Волков Громов Зайцев Климов Лебедев Морозов Орлов Соколов Титов".split(),
}
#: Titles before a name, by the gender they say; n: none.
TITLES = {
    "f": "Mrs Ms Miss Madame Mme Mlle Frau Señora Sra Doña Signora Госпожа".split(),
    "m": "Mr Monsieur Herr Señor Sr Don Signor Господин".split(),
    "n": "Dr Prof Professor Doctor Docteur Доктор Профессор".split(),
}
#: What comes before a full name in a letter or an introduction.
GREETINGS = frozenset("Dear Hello Hallo Liebe Lieber Bonjour Cher Chère Hola Estimado Estimada Querido Querida Уважаемый Уважаемая".split())
INTRODUCTIONS = (
    "name is ", "name: ", "signed by ", "written by ", "contact ", "sincerely, ", "sincerely,\n", "regards, ", "regards,\n", "ich heiße ",
    "name ist ", "je m'appelle ", "me llamo ", "nombre es ", "меня зовут ",
)

_GENDER = {n: (g, s) for (g, s), names in NAMES.items() for n in names}
_TITLE = {t: g for g, titles in TITLES.items() for t in titles}
_CAPITAL = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][^\W\d_A-ZÀ-ÖØ-ÞА-ЯЁ]+"
_CAPITAL = rf"{_CAPITAL}(?:-{_CAPITAL})*"

_LOCAL, _DOMAIN = re.compile(r"[^\W_][\w.%+-]{0,63}\Z"), re.compile(r"[^\W_][\w-]*(?:\.[\w-]+)*\.[^\W\d_]{2,}")
_NUMBER = re.compile(
    r"(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))"
    r"|(?P<mac>(?<![\w:])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![\w:]))"
    r"|(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f:]*:)[0-9A-Fa-f:]{6,39}(?![\w:]|\.\d))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,5}\)|\d{1,5})(?:[ .-]?\d{2,5}){1,4}(?!\w)"
    r"|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.-])[2-6](?:\d{12,18}|\d{3}(?:[ -]\d{4}){3}|\d{3}[ -]\d{6}[ -]\d{5})(?![\w]|[.-]\d))"
)
_SECRET = re.compile(
    r"(?P<aws>(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9]))"
    r"|(?P<prefixed>(?<![A-Za-z0-9])(?:gh[pousr]_|sk-|xox[abp]-)[A-Za-z0-9-]{16,})"
    r"|(?P<block>-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----)"
    r"|(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)(?P<quote>[\"']?\s{0,3}[=:]\s{0,3}[\"']?)(?P<value>[^\s\"',;&<>#]{6,})",
    re.S,
)
_HINTS = "akia asia ghp_ gho_ ghu_ ghs_ ghr_ sk- xoxa- xoxb- xoxp- passw pwd token secret apikey api_key api-key accesskey access_key access-key".split()
#: First digits of card numbers: Mastercard's second range, and those of American Express, Diners, JCB, Visa, Mastercard, Maestro, Discover.
_BRAND = re.compile(r"222[1-9]|22[3-9]|2[3-6]|27[01]|2720|[3-6]")
_CARD_WORD = re.compile(r"(?i:\b(?:(?:credit|debit|kredit|bank)?(?:card|karte|carte|tarjeta)s?n?|visa|mastercard|amex|maestro)\b)")
_WORD = re.compile(r"\w")
_CAPITALISED = re.compile(_CAPITAL)  # what is beside it is looked at afterwards, as looking behind would slow the search
_TITLED, _NEXT = re.compile(rf"\.?[ ]({_CAPITAL}(?:[ ]{_CAPITAL})?)(?!\w)"), re.compile(rf"[ ]({_CAPITAL})(?!\w)")
_PEM = re.compile(r"(-----BEGIN [A-Z ]*-----)(.*)(-----END [A-Z ]*-----)", re.S)
#: Networks of a special kind, which a surrogate shares with its address.
_SPECIAL = [ipaddress.ip_network(x) for x in (
    "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.88.99.0/24 192.168.0.0/16"
    " 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4 2001:db8::/32 fe80::/10 fc00::/7 ff00::/8"
).split()]


def card(digits: str, text: str, begin: int) -> bool:
    """Whether digits are a card's number: a known brand's, and a valid one or one that a word for cards announces."""
    return bool(_BRAND.match(digits)) and (luhn(digits) == 0 or bool(_CARD_WORD.search(text, max(0, begin - CARD_REACH), begin)))


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """Begin, end, type and canonical form of the personal data of a text, in order and disjoint."""
    if not text:
        return []
    found = []
    at = text.find("@")
    while at >= 0:
        local, domain = _LOCAL.search(text, max(0, at - 64), at), _DOMAIN.match(text, at + 1)
        if local and domain:
            found.append((local.start(), domain.end(), "email", text[local.start() : domain.end()].lower()))
        at = text.find("@", at + 1)
    lower = text.lower()
    if any(map(lower.__contains__, _HINTS)) or "PRIVATE KEY" in text:
        for m in _SECRET.finditer(text):
            group = "value" if m.lastgroup == "value" else m.lastgroup
            found.append((m.start(group), m.end(group), "secret", m[group]))
    if any(map(text.__contains__, "0123456789")):
        for m in _NUMBER.finditer(text):
            kind, raw = m.lastgroup, m[0]
            if kind in ("ip", "ip6"):
                if (canon := address(raw)) is not None:
                    found.append((m.start(), m.end(), "ip", canon))
                continue
            if kind == "phone" and sum(map(str.isdigit, raw)) > 15:
                continue
            if kind == "card" and not card(re.sub(r"\D", "", raw), text, m.start()):
                continue
            canon = re.sub(r"[^0-9A-Za-z]", "", raw)
            if kind == "phone" and raw.startswith("+1") and len(canon) == 11:
                canon = canon[1:]  # the national number, as it is written without the country
            found.append((m.start(), m.end(), kind, canon.lower() if kind == "mac" else canon))
    found += people(text)
    found.sort(key=lambda x: (x[0], -x[1]))
    out = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return resolved(text, out) if any(kind.startswith("name:") for _, _, kind, _ in out) else out


def address(raw: str) -> str | None:
    """An IP address in one form; None for what isn't one, or says nothing of anybody."""
    try:
        ip = ipaddress.ip_address(".".join(str(int(x)) for x in raw.split(".")) if "." in raw else raw)
    except ValueError:
        return None
    if ip.is_unspecified or ip.is_loopback or ip.version == 6 and not any(map(str.isdigit, raw)):
        return None
    return str(ip)


def people(text: str) -> list[tuple[int, int, str, str]]:
    """Names after titles, of known given names, and full names after greetings and introductions."""
    out, done = [], 0
    for m in _CAPITALISED.finditer(text):
        begin, end = m.span()
        if begin < done or begin and _WORD.match(text, begin - 1) or _WORD.match(text, end):
            continue
        word, family = m[0], None
        if word in _TITLE:
            if name := _TITLED.match(text, m.end()):
                out.append((*name.span(1), _name_kind(name[1], _TITLE[word]), name[1]))
                done = name.end()
            continue
        if word in _GENDER or text[end : end + 1] == " ":
            family = _NEXT.match(text, end)
        if not family:
            continue
        name = f"{word} {family[1]}"
        if word in _GENDER:
            out.append((m.start(), family.end(), _name_kind(name, "n"), name))
            done = family.end()
        elif word in GREETINGS:
            second = _NEXT.match(text, family.end())
            if second and family[1] not in _TITLE and family[1] not in _GENDER:
                name = f"{family[1]} {second[1]}"
                out.append((family.start(1), second.end(), _name_kind(name, "n"), name))
                done = second.end()
        elif text[max(0, m.start() - 16) : m.start()].lower().endswith(INTRODUCTIONS):
            out.append((m.start(), family.end(), _name_kind(name, "n"), name))
            done = family.end()
    return out


def _name_kind(name: str, gender: str) -> str:
    """Type of a name: the gender of a known given name, else that of the title before it."""
    script = "cyrillic" if re.match("[А-ЯЁ]", name) else "latin"
    given = name.split(" ", 1)[0]
    return f"name:{_GENDER[given][0] if ' ' in name and given in _GENDER else gender}:{script}"


def resolved(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """found with each mention of a person under the full name, and with the bare repeats of the names' parts.

    A title and family name is the last full name of that family before it, or the first after it, whose
    gender isn't another; a bare given or family name after a name is the last one before it that has it.
    A full name is of the gender that one of its mentions says.
    """
    gender, full = {}, {}
    for _, _, kind, canon in found:
        if kind.startswith("name:") and " " in canon and not kind.startswith("name:n"):
            gender.setdefault(canon, kind)
    found = [(b, e, gender.get(canon, kind) if kind.startswith("name:") else kind, canon) for b, e, kind, canon in found]
    for begin, _, kind, canon in found:
        if kind.startswith("name:") and " " in canon:
            full.setdefault(canon.split(" ", 1)[1], []).append((begin, kind, canon))
    out, parts = [], {}
    for begin, end, kind, canon in found:
        if kind.startswith("name:"):
            if " " not in canon:
                same = [x for x in full.get(canon, ()) if x[1] == kind or "n" in (x[1][5], kind[5])]
                if same:
                    _, kind, canon = same[max(0, bisect.bisect(same, (begin,)) - 1)]
            for part in canon.split(" ", 1):
                parts.setdefault(part, []).append((begin, kind, canon))
        out.append((begin, end, kind, canon))
    bare, begins = [], [x[0] for x in out]
    for part, named in parts.items():
        at = text.find(part, named[0][0])
        while at >= 0:
            end = at + len(part)
            k = bisect.bisect(begins, at) - 1
            free = (k < 0 or out[k][1] <= at) and (k + 1 == len(out) or end <= begins[k + 1])
            if free and not _WORD.match(text[at - 1 : at]) and not _WORD.match(text[end : end + 1]):
                bare.append((at, end, *named[bisect.bisect(named, (at,)) - 1][1:]))
            at = text.find(part, end)
    taken = []
    for x in sorted(bare, key=lambda x: (x[0], -x[1])):  # parts may overlap, as Weber and Weber-Ortega
        if not taken or x[0] >= taken[-1][1]:
            taken.append(x)
    return sorted(out + taken)


class Draw:
    """Numbers that a key, a type, a canonical form and an attempt determine."""

    def __init__(self, key: bytes, *parts: str):
        self.seed = hmac.new(key, "\0".join(parts).encode("utf-8", "surrogatepass"), hashlib.sha256).digest()
        self.used, self.pool = 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hashlib.sha256(self.seed + self.used.to_bytes(4, "big")).digest()
            self.used += 1
        value, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return value % n

    def alike(self, text: str, fixed: int = 0) -> str:
        """Letters for letters and digits for digits, of the same case and script; the first fixed stay."""
        out = list(text[:fixed])
        hexadecimal = re.fullmatch("[0-9a-f]{8,}|[0-9A-F]{8,}", text) and not text.isdigit()
        for c in text[fixed:]:
            if hexadecimal:
                out.append("0123456789abcdef"[self.below(16)] if text.islower() else "0123456789ABCDEF"[self.below(16)])
            elif c.isdigit():
                out.append(str(self.below(10)))
            elif "a" <= c.lower() <= "z":
                new = chr(97 + self.below(26))
                out.append(new.upper() if c.isupper() else new)
            elif "а" <= c.lower() <= "я":
                new = chr(1072 + self.below(32))
                out.append(new.upper() if c.isupper() else new)
            elif c.isalpha():
                near = [x for x in map(chr, range(ord(c) & ~31, (ord(c) | 31) + 1)) if x.isalpha() and x.islower() == c.islower()]
                out.append(near[self.below(len(near))])
            else:
                out.append(c)
        return "".join(out)


def luhn(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def surrogate(key: bytes, kind: str, canon: str, attempt: int) -> str:
    """The canonical form of an entity's surrogate."""
    draw = Draw(key, kind, canon, str(attempt))
    extra = draw.alike("0" * (attempt - WIDEN + 1)) if attempt >= WIDEN else ""
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        labels = domain.split(".")
        other = Draw(key, "domain", domain)  # the same for all addresses there
        return f"{draw.alike(local)}{extra}@{'.'.join([other.alike(x) for x in labels[:-1]] + labels[-1:])}"
    if kind == "ip":
        old = ipaddress.ip_address(canon)
        special = [x for x in _SPECIAL if old in x]
        wide = attempt // WIDEN  # first the form's own range, then private or public IPv6 of 120 bits
        if special and not wide:
            return str(special[0][draw.below(special[0].num_addresses)])
        if special:
            return str(ipaddress.ip_network("fd00::/8")[draw.below(1 << 60) << 60 | draw.below(1 << 60)])
        while True:
            v6 = old.version == 6 or wide
            new = ipaddress.ip_address((0x20 << 120 | draw.below(1 << 61) << 60 | draw.below(1 << 60)) if v6 else draw.below(224 << 24))
            if new.is_global and not new.is_multicast:
                return str(new)
    if kind == "mac":
        longer = "ffff" if attempt >= WIDEN else ""  # an address of eight bytes
        return canon[:1] + "".join("0123456789abcdef"[draw.below(16)] for _ in canon[1:] + longer)
    if kind == "card":
        body = draw.alike(canon, 4 if canon[0] == "2" else 1)  # the brand stays
        if luhn(canon) == 0:
            body = next(body[:-1] + str(d) for d in range(10) if luhn(body[:-1] + str(d)) == 0)
        elif luhn(body) == 0:
            body = body[:-1] + str((int(body[-1]) + 1) % 10)
        return body + extra
    if kind == "phone":
        lead = 1 if canon[0] == "1" and len(canon) == 11 else 0
        new = list(draw.alike(canon, lead))
        if new[lead] in "01":  # area codes don't begin with these
            new[lead] = str(2 + draw.below(8))
        if len(canon) - lead == 10 and canon[lead + 3 : lead + 6] == "555":
            new[lead + 3 : lead + 6] = "555"
        return "".join(new) + extra
    if kind == "iban":
        rest = draw.alike(canon[4:])
        valid = _iban_check(canon[:2], canon[4:]) == canon[2:4]
        return canon[:2] + (_iban_check(canon[:2], rest) if valid else draw.alike(canon[2:4])) + rest + extra
    if kind.startswith("name:"):
        _, gender, script = kind.split(":")
        own = canon.split(" ", 1)  # not to be drawn: parts of a name are replaced by themselves, too
        given = [x for g in ("f", "m") if gender in (g, "n") for x in NAMES[g, script] if x != own[0]]
        families = [x for x in FAMILIES[script] if own[-1] not in (x, x + "а")]
        family = families[draw.below(len(families))]
        if attempt >= 3:  # lists are short: a second family name, then more
            family += "".join("-" + families[draw.below(len(families))] for _ in range(1 + (attempt - 3) // 3))
        if script == "cyrillic" and gender == "f":
            family = "-".join(x + "а" for x in family.split("-"))
        return f"{given[draw.below(len(given))]} {family}" if " " in canon else family
    if kind == "secret":
        fixed = len(re.match(r"(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abp]-)?", canon)[0])
        if pem := _PEM.fullmatch(canon):
            return f"{pem[1]}{draw.alike(pem[2])}{extra}{pem[3]}"
        return draw.alike(canon, fixed) + extra
    return draw.alike(canon) + extra


def dressed(kind: str, surface: str, canon: str, new: str) -> str:
    """The surrogate in the form of the surface: its separators and its case."""
    if kind.startswith("name:") and " " in canon and surface != canon:  # a mention by a part of the name
        return new.split(" ", 1)[0 if surface == canon.split(" ", 1)[0] else 1]
    if kind in ("phone", "card", "ssn", "iban", "mac"):
        if kind == "phone" and surface.startswith("+1") and sum(map(str.isdigit, surface)) == len(canon) + 1:
            new = "1" + new
        letters, out = iter(new), []
        for c in surface:
            out.append(next(letters, "") if c.isalnum() else c)
        text = "".join(out) + "".join(letters)
        return text.upper() if kind == "mac" and surface.upper() == surface else text
    if kind == "email":
        if surface == surface.upper():
            return new.upper()
        return "".join(n.upper() if c.isupper() else n for c, n in zip(surface, new, strict=False)) + new[len(surface) :]
    return new


def replace(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, dict[str, int]]:
    """The text with surrogates, and the number of entities of each type."""
    out, last, counts = [], 0, {}
    for begin, end, kind, canon in entities(text):
        new = surrogate(key, kind, canon, attempts.get((kind, canon), 0))
        out += [text[last:begin], dressed(kind, text[begin:end], canon, new)]
        last = end
        name = kind.partition(":")[0]
        counts[name] = counts.get(name, 0) + 1
    return ("".join([*out, text[last:]]), counts) if out else (text, counts)


def inventory(docs: DataFrame) -> DataFrame:
    """Distinct ``kind, canon`` of all documents."""

    def run(batches):
        for batch in batches:
            found = {(kind, canon) for t in batch.column(0).to_pylist() for _, _, kind, canon in entities(t)}
            kinds, canons = ([x[k] for x in sorted(found)] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(canons, pa.string())], ["kind", "canon"])

    return docs.select(valid("text")).mapInArrow(run, "kind string, canon string").distinct()


def redrawn(found: DataFrame, key: bytes, scratch: Scratch) -> DataFrame:
    """``kind, canon, attempt`` of the entities whose first surrogate is taken.

    A round gives each entity without a surrogate the draw of the next attempt, unless an entity or a
    settled surrogate of the type is that; of several with one draw the first by canonical form gets it.
    From WIDEN attempts on the range of draws is so large that nearly all succeed, so rounds are few.
    """

    def kernel(kinds: pa.Array, canons: pa.Array, attempts: pa.Array) -> pa.Array:
        rows = zip(kinds.to_pylist(), canons.to_pylist(), attempts.to_pylist(), strict=True)
        return pa.array([surrogate(key, k, c, a) for k, c, a in rows], pa.string())

    draw = F.arrow_udf(kernel, "string")
    spark = found.sparkSession
    group = F.split_part("kind", F.lit(":"), F.lit(1))  # a name of one gender may not become another's
    found = scratch.store(found.withColumn("type", group), "pii-entities")
    schema = "type string, new string, kind string, canon string, attempt int"
    settled = scratch_path(spark, "pii-settled")
    scratch.paths["pii-settled"] = settled
    open_, attempt = found, 0
    while not open_.isEmpty():
        drawn = open_.withColumn("attempt", F.lit(attempt)).withColumn("new", draw("kind", "canon", "attempt"))
        drawn = scratch.store(drawn, f"pii-drawn-{attempt}")
        taken = found.select("type", F.col("canon").alias("new"))
        if attempt:
            taken = taken.union(spark.read.schema(schema).parquet(settled).select("type", "new"))
        free = drawn.join(taken.distinct(), ["type", "new"], "left_anti")
        first = free.groupBy("type", "new").agg(F.min(F.struct("canon", "kind")).alias("own"))
        won = first.select("type", "new", "own.kind", "own.canon", F.lit(attempt).alias("attempt"))
        won.write.mode("append").parquet(settled)
        won = spark.read.schema(schema).parquet(settled).where(F.col("attempt") == attempt)
        open_ = scratch.store(open_.join(won.select("kind", "canon"), ["kind", "canon"], "left_anti"), f"pii-open-{attempt}")
        scratch.drop(f"pii-drawn-{attempt}", *([f"pii-open-{attempt - 1}"] if attempt else []))
        attempt += 1
    if not attempt:
        return spark.createDataFrame([], "kind string, canon string, attempt int")
    return spark.read.schema(schema).parquet(settled).where("attempt > 0").select("kind", "canon", "attempt")


_RESULT = "struct<text: string, n: long, kinds: map<string, long>>"


def with_surrogates(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """docs (``doc_id, text``) with the text's entities replaced, and ``n_entities`` and ``entity_types`` added.

    Equal entities get equal surrogates throughout, distinct ones distinct surrogates, none of which
    is an entity of the documents. Null and empty texts, and texts without personal data, stay as they
    are. Repeated rows are treated alike; other columns stay, but for those two, which are replaced.
    """
    with Scratch(docs.sparkSession) as scratch:
        exceptions = stored(redrawn(inventory(docs), key, scratch), "pii-attempts")
    name, shipped, own = uuid.uuid4().hex, None, F.lit(None).cast("map<string, int>")
    if exceptions.count() <= BROADCAST_ROWS:
        rows = exceptions.toArrow()
        keys = zip(rows.column("kind").to_pylist(), rows.column("canon").to_pylist(), strict=True)
        shipped = docs.sparkSession.sparkContext.broadcast(dict(zip(keys, rows.column("attempt").to_pylist(), strict=True)))
    else:
        docs, own = _joined(docs, exceptions), F.col("__attempts")

    def kernel(texts: pa.Array, maps: pa.Array) -> pa.Array:
        known, out = resident(name, lambda: shipped.value if shipped else {}), []
        for text, extra in zip(texts.to_pylist(), maps.to_pylist(), strict=True):
            if text is None:
                out.append({"text": None, "n": 0, "kinds": []})
                continue
            mine = {tuple(k.split("\0", 1)): v for k, v in extra} if extra else known
            new, counts = replace(text, key, mine)
            out.append({"text": new, "n": sum(counts.values()), "kinds": sorted(counts.items())})
        kind = pa.struct([("text", pa.string()), ("n", pa.int64()), ("kinds", pa.map_(pa.string(), pa.int64()))])
        return pa.array(out, kind)

    out = docs.withColumn("__pii", F.arrow_udf(kernel, _RESULT)(valid("text"), own))
    added = {"text": F.col("__pii.text"), "n_entities": F.col("__pii.n"), "entity_types": F.col("__pii.kinds")}
    return out.withColumns(added).drop("__pii", "__attempts")


def _joined(docs: DataFrame, exceptions: DataFrame) -> DataFrame:
    """docs with the attempts of each document's own entities in ``__attempts``."""

    def kernel(texts: pa.Array) -> pa.Array:
        out = [[{"kind": k, "canon": c} for k, c in {(k, c) for _, _, k, c in entities(t)}] for t in texts.to_pylist()]
        return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("canon", pa.string())])))

    docs = docs.withColumn("__doc", F.xxhash64("text"))
    listed = F.explode(F.arrow_udf(kernel, "array<struct<kind: string, canon: string>>")(valid("text")))
    pairs = docs.select("__doc", listed.alias("e")).select("__doc", "e.kind", "e.canon").distinct()
    pairs = pairs.join(exceptions, ["kind", "canon"])
    entry = F.struct(F.concat("kind", F.lit("\0"), "canon").alias("k"), F.col("attempt").cast("int").alias("v"))
    own = pairs.groupBy("__doc").agg(F.map_from_entries(F.collect_set(entry)).alias("__attempts"))
    return docs.join(own, "__doc", "left").drop("__doc")


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    types = F.array_join(F.array_sort(F.map_keys("entity_types")), ",")
    return docs.select("doc_id", "text", "n_entities", types.alias("entity_types"))
