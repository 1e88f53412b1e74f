"""Personal data: regular expressions propose spans, checksums and ranges confirm or reject them, and
the words nearby move the score.

A proposal whose validator fails is dropped. Otherwise its score is the kind's base, plus BOOST if one
of the kind's words stands within NEAR characters before it (or a third of that after it), minus
DAMPEN if a word that speaks for another kind of number does. Spans of THRESHOLD or more are reported;
of overlapping ones the best (then the longest, then the first) stays.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import quoted, text_batches

THRESHOLD = 0.5
NEAR = 48
BOOST = 0.3
DAMPEN = 0.1

# lengths of IBANs by country, as published in the IBAN registry
IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, EG=29, ES=24, FI=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27,
    GT=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, MC=27, MD=24, ME=22, MK=19, MR=27, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28,
    PS=29, PT=25, QA=29, RO=24, RS=22, SA=24, SC=31, SE=24, SI=19, SK=24, SM=27, ST=25, SV=28, TL=23, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20,
)


def luhn(digits: str) -> bool:
    """The Luhn checksum over a string of digits; a run of one repeated digit never passes."""
    if len(set(digits)) < 2:
        return False
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d <<= k & 1
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The ISO 7064 mod-97 check of an IBAN without spaces, of its country's length."""
    if IBAN_LENGTHS.get(iban[:2]) != len(iban):
        return False
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _octets(text: str) -> bool:
    parts = text.split(".")
    return all(p == str(int(p)) and int(p) < 256 for p in parts) and parts[0] != "0"


def _mixed(text: str) -> bool:
    """At least eight different characters, letters and digits both among them."""
    return len(set(text.lower())) >= 8 and not text.isdigit() and not text.isalpha()


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


_AT = re.compile(r"@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
_RUN = re.compile(r"(?<![\w-])(?<!\d\.)[0-9](?:[ -]?[0-9]){12,18}(?![\w-])(?!\.\d)")
_CHAIN = re.compile(r"(?<![0-9])(?<![0-9][ -])(?=(?:[ -]?[0-9]){13})[0-9]+(?:[ -][0-9]+)*")
_GROUP = re.compile(r"[0-9]+")
_BEFORE, _AFTER = re.compile(r"(?<![\w-])(?<!\d\.)"), re.compile(r"(?![\w-])(?!\.\d)")
_ISSUED = re.compile(r"4(?:\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|2[2-7]\d{14}|3[47]\d{13}|3[0689]\d{12}|35\d{14}|6\d{15,18}")  # prefixes and lengths of the large issuers
_LOCAL = re.compile(r"[\w%+-](?:[\w.%+-]{0,62}[\w%+-])?\Z")
_IBAN = re.compile(r"(?<![^\W_])[A-Z]{2}[0-9]{2}(?=[ A-Z0-9])")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("@")
    while at >= 0:
        if (domain := _AT.match(text, at)) and (local := _LOCAL.search(text[max(0, at - 64) : at])):
            yield at - (local.end() - local.start()), domain.end()
        at = text.find("@", at + 1)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        left, end = IBAN_LENGTHS.get(m[0][:2], 0) - 4, m.end()
        while left > 0 and end < len(text):
            if text[end] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
                left -= 1
            elif text[end] != " " or text[end - 1] == " ":
                break
            end += 1
        if not left and not text[end : end + 1].isalnum():
            yield m.start(), end


def _cards(text: str) -> Iterator[tuple[int, int]]:
    """The runs of 13 to 19 digits, with single spaces or dashes among them, that pass the Luhn check. Other numbers may
    stand beside a card (its security code, its date), so every part of a longer run is tried that begins and ends at
    a separator and is written in groups of three digits or more, as cards are: any part of a line of short
    numbers would pass too easily. Of overlapping ones, that of a large issuer, the longest, the first is taken."""
    runs = {m.start(): m.end() for m in _RUN.finditer(text)}
    for chain in _CHAIN.finditer(text):
        groups = [m.span() for m in _GROUP.finditer(text, *chain.span())]
        last = {end: j for j, (_, end) in enumerate(groups)}
        tried = set()
        for i, (start, _) in enumerate(groups):
            if start in runs:
                tried.add((i, last[runs[start]]))
            if i or _BEFORE.match(text, start):
                n = 0
                for j in range(i, len(groups)):
                    size = groups[j][1] - groups[j][0]
                    n += size
                    if n > 19 or size < 3:
                        break
                    if n >= 13 and (j + 1 < len(groups) or _AFTER.match(text, groups[j][1])):
                        tried.add((i, j))
        passed = []
        for i, j in tried:
            digits = _digits(text[groups[i][0] : groups[j][1]])
            if luhn(digits):
                passed.append((not _ISSUED.fullmatch(digits), -len(digits), i, j))
        taken: set[int] = set()
        for _, _, i, j in sorted(passed):
            if taken.isdisjoint(range(i, j + 1)):
                taken.update(range(i, j + 1))
                yield groups[i][0], groups[j][1]


def _matches(pattern: str) -> Callable[[str], Iterator[tuple[int, int]]]:
    compiled = re.compile(pattern)
    return lambda text: (m.span() for m in compiled.finditer(text))


@dataclass(frozen=True)
class Kind:
    name: str
    propose: Callable[[str], Iterator[tuple[int, int]]]
    valid: Callable[[str], bool]
    base: float
    words: str  # alternatives of a regular expression
    against: str = r"version|isbn|serial|order|invoice|tracking"


KINDS = (
    Kind("email", _emails, lambda s: ".." not in s, 0.8, r"e-?mail|mail|contact|write|correo|courriel|kontakt"),
    Kind("card", _cards, lambda s: luhn(_digits(s)), 0.7, r"card|credit|debit|visa|mastercard|amex|tarjeta|carte|karte|kreditkarte"),
    Kind("iban", _ibans, lambda s: mod97(s.replace(" ", "")), 0.8, r"iban|bank|account|konto|cuenta|compte"),
    Kind("ipv4", _matches(r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w)(?!\.\d)"), _octets, 0.6, r"ip|address|host|server|adresse|direcci[oó]n"),
    Kind("phone", _matches(r"(?<![\w+.-])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}|\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4})(?![\w-])(?!\.\d)"), lambda s: 8 <= len(_digits(s)) <= 15, 0.6, r"phone|tel|call|mobile|fax|tel[eé]fono|t[eé]l[eé]phone|telefon"),
    Kind("phone", _matches(r"(?<![\w+.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])(?!\.\d)"), lambda s: s[0] not in "01", 0.45, r"phone|tel|call|mobile|fax|tel[eé]fono|t[eé]l[eé]phone|telefon"),
    Kind("ssn", _matches(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000", 0.6, r"ssn|social security"),
    Kind("secret", _matches(r"(?<![\w-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{32,64}|xox[abp]-[A-Za-z0-9-]{10,72})(?![\w-])"), _mixed, 0.8, r"key|token|secret"),
    Kind("secret", _matches(r"(?<![\w-])[0-9a-fA-F]{32,128}(?![\w-])"), _mixed, 0.3, r"token|api[_ -]?key|key|secret|passwor[dt]|passwd|credential|bearer"),
)
_WORDS = {k.words: re.compile(rf"(?<![^\W_])(?:{k.words})(?![^\W_])", re.IGNORECASE) for k in KINDS}
_AGAINST = {k.against: re.compile(rf"(?<![^\W_])(?:{k.against})(?![^\W_])", re.IGNORECASE) for k in KINDS}
_ANY = re.compile(r"[0-9@]")  # every proposal holds one of these


def find_pii(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of the confirmed spans, in characters, by position."""
    if not text or not _ANY.search(text):
        return []
    found = []
    for kind in KINDS:
        for start, end in kind.propose(text):
            if not kind.valid(text[start:end]):
                continue
            before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR // 3]
            near = bool(_WORDS[kind.words].search(before) or _WORDS[kind.words].search(after))
            off = bool(_AGAINST[kind.against].search(before))
            score = round(min(1.0, kind.base + BOOST * near - DAMPEN * off), 4)
            if score >= threshold:
                found.append((kind.name, start, end, score))
    found.sort(key=lambda x: (-x[3], x[1] - x[2], x[1], x[0]))
    starts: list[int] = []  # of the kept spans, by position
    kept: dict[int, tuple[str, int, int, float]] = {}
    for span in found:
        i = bisect(starts, span[1])
        if (not i or kept[starts[i - 1]][2] <= span[1]) and (i == len(starts) or starts[i] >= span[2]):
            starts.insert(i, span[1])
            kept[span[1]] = span
    return [kept[s] for s in starts]


def redact(text: str | None, threshold: float = THRESHOLD) -> str | None:
    """The text with each confirmed span replaced by its kind in angle brackets."""
    if not text:
        return text
    parts, at = [], 0
    for kind, start, end, _ in find_pii(text, threshold):
        parts += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*parts, text[at:]]) if parts else text


_SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def pii_spans(text: Column, threshold: float = THRESHOLD) -> Column:
    """The spans of a text column as an array of structs."""

    def run(texts: pa.Array) -> pa.Array:
        rows = [[dict(zip(("kind", "start", "end", "score"), s)) for s in find_pii(t.as_py(), threshold)] for t in texts]
        return pa.array(rows, _SPAN_TYPE)

    return F.arrow_udf(run, _SPANS)(text)


def pii_report(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kind, start, end, value, score), a row for each span of each row of docs.

    start and end count characters from 0. Null and empty texts have no spans; a null doc_id is
    reported as null; repeated rows are reported each. A text of any length is searched as a whole, in time that grows
    with its length and its spans (and the logarithm of their number). Of overlapping spans of one score the longest,
    then the first counts. Other columns are not read. An empty table gives an empty one.
    """
    text_batches(docs.sparkSession)
    spans = docs.select("doc_id", quoted("text").alias("text"), F.explode(pii_spans(quoted("text"), threshold)).alias("s"))
    return spans.select("doc_id", "s.kind", "s.start", "s.end", F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"), "s.score")


def redact_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the spans in text replaced and n_chars, if there is one, counted again; the other
    columns, of whatever names, and all rows stay as they are, repeated ones and those without a doc_id too. A null text
    stays null and an empty one empty; a text of any length is searched as a whole. An empty table gives an empty one."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([redact(t.as_py(), threshold) for t in texts], pa.string())

    text_batches(docs.sparkSession)
    out = docs.withColumn("text", F.arrow_udf(run, "string")(quoted("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
