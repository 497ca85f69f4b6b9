"""Personal data: expressions propose spans, checksums confirm them, context adjusts the score.

Base kinds, leftmost and non-overlapping within each kind, failing ones dropped without retry:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip    ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, each part at most 255
* card  ``[0-9]([\\x20-]?[0-9])+``, 13 to 19 digits that pass Luhn
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]``, 9 to 15 digits

The method adds spans of four kinds, which never change the base ones:

* iban: a country's two letters, two check digits and as many letters and digits as that country has,
  with or without spaces, remainder 1 modulo 97
* secret: the value of ``name = "value"`` or ``name: value`` where the name says token, secret, key or
  password, and bare values of well-known shapes (``AKIA...``, ``ghp_...``, private-key headers)
* ssn: three, two and four digits with hyphens, in the ranges that are given out
* national_phone: three, three and four digits (or national form with a leading zero), without ``+``

Base spans always stay.  An added span is reported only from ``MIN_SCORE`` on: the shape gives
its kind's prior, a checksum or the randomness of a secret's characters adds, a word of its kind
nearby adds, a word that speaks against it (version, order, example) takes away.  So a bare ssn
or phone number is reported only beside a word that names it, and a placeholder is no secret.

Defined cases: null and empty texts have no spans; spans are code points, end exclusive;
repeated rows are scanned each for itself; long runs of digits or letters take linear time;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .textbytes import tidy

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "secret", "ssn", "national_phone")
CONTEXT_CHARS = 48
MIN_SCORE = 0.5

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Each pattern begins with a plain set of characters, which the engine skips to, and looks back only from there.
# No match can begin within a run of digits whose first digit began none.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?: ?[A-Z0-9]){11,30}")
_ASSIGN = re.compile(r"[=:]")
_NAME = re.compile(r"(?i)(?<![a-z0-9])(?:token|secret|password|passwd|pwd|api[_ -]?key|apikey|access[_ -]?key|private[_ -]?key|auth[_ -]?key|credentials?)\"?'?\s{0,3}\Z")
_VALUE = re.compile(r"(?i)(?:=|:=|:|=>)\s{0,3}(?:\"([^\"\n]{6,200})\"|'([^'\n]{6,200})'|((?:bearer\s)?[^\s\"',;<>()]{6,200}))")
NAME_CHARS = 16  # the longest name, two quotes and three white characters
_SHAPED = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]{10,72}|eyJ[A-Za-z0-9_-]{10,2000}\.eyJ[A-Za-z0-9_-]{10,4000}\.[A-Za-z0-9_-]{10,2000}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)")
_SHAPES = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "eyJ", "-----BEGIN ")
_SSN = re.compile(r"[0-8](?<![0-9A-Za-z-][0-8])(?:(?<=0)(?!00)|(?<=6)(?!66)|(?<![06]))[0-9]{2}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])")
_NATIONAL = re.compile(r"[(02-9](?<![0-9A-Za-z+./-][(02-9])(?:(?:(?<=\()[2-9][0-9]{2}\) ?|(?<=[2-9])[0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9A-Za-z-])|(?<=0)[1-9][0-9]{0,3}[ /-][0-9]{2,4}(?: ?[0-9]{2,4}){1,3}(?![0-9A-Za-z-]))")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\W_]+")

# Lengths of account numbers by country.
IBAN_LENGTHS = "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
# Words near a span that make its kind likelier, and words that make any less so.
CONTEXT = {
    "email": "mail email contact write courriel correo kontakt",
    "ip": "ip address host server adresse ping login client dirección",
    "card": "card credit debit visa mastercard amex payment karte kreditkarte carte tarjeta crédito",
    "phone": "phone call tel telephone mobile cell fax contact sms telefon handy mobil téléphone portable teléfono móvil llamar appelez anrufen",
    "iban": "iban account bank transfer payment konto bankverbindung überweisung compte virement cuenta transferencia bic swift",
    "secret": "token secret key password credentials auth login bearer config env export passwort kennwort clé contraseña",
    "ssn": "ssn social security taxpayer",
    "national_phone": "phone call tel telephone mobile cell fax contact sms telefon handy mobil téléphone portable teléfono móvil llamar appelez anrufen",
}
AGAINST = "version isbn issn order invoice example sample placeholder dummy test serial part sku doi ticket"
_LENGTHS = {x[:2]: int(x[2:]) for x in IBAN_LENGTHS.split()}
_CONTEXT = {k: frozenset(v.split()) for k, v in CONTEXT.items()}
_AGAINST = frozenset(AGAINST.split())
#: what a kind's shape is worth alone, and what its confirmation adds
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.4, "phone": 0.5, "iban": 0.3, "secret": 0.2, "ssn": 0.35, "national_phone": 0.35}
CONFIRMED = {"card": 0.3, "iban": 0.4, "secret": 0.4}
NEAR, AGAINST_BY = 0.2, 0.25


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rest = 0
    for c in iban[4:] + iban[:4]:
        rest = (rest * (100 if c.isalpha() else 10) + int(c, 36)) % 97
    return rest == 1


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        if at >= free:
            begin = at
            while begin > free and _LOCAL.match(text, begin - 1):
                begin -= 1
            m = _DOMAIN.match(text, at + 1) if begin < at else None
            if m:
                out.append((begin, m.end()))
                free = m.end()
            elif begin < at:
                free = at  # what stands before this sign cannot be part of a later match
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def entropy(value: str) -> float:
    """Bits a character of the value's own distribution."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def random_looking(value: str) -> bool:
    """Characters of a generated secret: several kinds of them or long hexadecimal, and no word repeated."""
    if len(value) < 8 or " " in value.strip():
        return False
    kinds = sum(bool(re.search(x, value)) for x in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return entropy(value) >= 2.75 and (kinds >= 3 or kinds >= 2 and bool(re.search("[0-9]", value)))


def score(text: str, kind: str, begin: int, end: int, confirmed: bool = True) -> float:
    """The kind's prior, more for what confirms it, and more or less for the words around."""
    near = text[max(0, begin - CONTEXT_CHARS) : begin].lower() + " " + text[end : end + CONTEXT_CHARS // 2].lower()
    words = set(_WORD.findall(near))
    s = PRIOR[kind] + CONFIRMED.get(kind, 0) * confirmed
    return round(min(1.0, max(0.0, s + NEAR * (not words.isdisjoint(_CONTEXT[kind])) - AGAINST_BY * (not words.isdisjoint(_AGAINST)))), 2)


def ibans(text: str) -> list[tuple[int, int]]:
    """Account numbers of their country's length that pass modulo 97, whatever capitals follow."""
    out, at = [], 0
    while m := _IBAN.search(text, at):
        at = m.start() + 2
        need = _LENGTHS.get(m[0][:2])
        if need is None:
            continue
        end, count = m.start(), 0
        while count < need and end < m.end():
            count += text[end] != " "
            end += 1
        solid = text[m.start() : end].replace(" ", "")
        if count == need and not (text[end : end + 1].isalnum()) and mod97(solid):
            out.append((m.start(), end))
            at = end
    return out


def named_values(text: str) -> list[tuple[int, int, bool]]:
    """Place of each value that a name for secrets is given, and whether it is quoted; found from the sign between them."""
    out, free = [], 0
    for sign in _ASSIGN.finditer(text):
        at = sign.start()
        if at > free and _NAME.search(text, max(free, at - NAME_CHARS), at) and (m := _VALUE.match(text, at)):
            k = next(k for k in (1, 2, 3) if m[k] is not None)
            out.append((*m.span(k), k < 3))
            free = m.end()
    return out


def added_proposals(text: str) -> list[tuple[str, int, int, bool]]:
    """Kind, place, and whether its checksum or its characters confirm it."""
    out = [("iban", a, b, True) for a, b in ibans(text)]
    for a, b, k in named_values(text):
        if not k:
            b = a + len(text[a:b].rstrip(".!?"))
        out.append(("secret", a, b, random_looking(text[a:b])))
    taken = [x[1:3] for x in out if x[0] == "secret"]
    if any(x in text for x in _SHAPES):
        out += [("secret", *m.span(), True) for m in _SHAPED.finditer(text) if not any(a < m.end() and m.start() < b for a, b in taken)]
    out += [("ssn", *m.span(), True) for m in _SSN.finditer(text)]
    out += [("national_phone", *m.span(), True) for m in _NATIONAL.finditer(text) if 7 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def added_spans(text: str) -> list[tuple[str, int, int]]:
    return [(kind, a, b) for kind, a, b, sure in added_proposals(text) if score(text, kind, a, b, sure) >= MIN_SCORE]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


@tidy
def _find(batches):
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores", "n_added"]
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            base = base_spans(text) if text else []
            added = added_spans(text) if text else []
            every = base + added
            counts = [sum(s[0] == k for s in base) for k in BASE]
            scores = ",".join(f"{score(text, k, a, b):.2f}" for k, a, b in sorted(every, key=lambda s: (KINDS.index(s[0]), s[1])))
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), scores, len(added)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        kinds = [pa.int64()] * 4 + [pa.string()] * 3 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts by base kind, base_sha256, spans, scores, and how many spans were added."""
    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string, n_added long")
