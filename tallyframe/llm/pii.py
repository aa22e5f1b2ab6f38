"""Personal data: patterns propose spans, checksums confirm them, context moves the score.

Candidates come from regular expressions. Luhn confirms card numbers, mod-97 confirms
IBANs, digit counts and part sizes confirm phones and addresses; a candidate that fails is
dropped and the search goes on behind it. Words near a span, more of them before it than
behind it, raise or lower its score. The four base kinds stay whatever their score; the kinds that the method adds
(``iban``, ``short_card``, ``national_id``) must reach ``MIN_SCORE``.

The searches are anchored so that a text costs time in proportion to its length, whatever
it holds: e-mail is looked for from each ``@`` outwards, addresses in whole dotted runs.

Defined results: null and empty texts have no spans; offsets are code points, end
exclusive; repeated rows, null ids and other columns pass through as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "short_card", "national_id")
MIN_SCORE = 0.5
CONTEXT_CHARS, CONTEXT_BEHIND = 48, 24
SPAN_TYPE = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"

DIGIT = re.compile(r"[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}|[a-z]{2}[0-9]{2}(?:\x20?[a-z0-9]){11,30})")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
WORD = re.compile(r"[^\W\d_]+")

#: Lengths of IBANs by country (ISO 13616).
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22,
    "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
#: Of a country that is not listed, any length that the standard allows.
ANY_LENGTH = range(34, 14, -1)
START_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "short_card": 0.35, "national_id": 0.3}
RAISES = {
    "email": {"email", "mail", "contact", "write", "correo", "courriel"},
    "ip": {"ip", "address", "host", "server", "adresse"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "karte", "carte", "tarjeta"},
    "phone": {"phone", "tel", "telefon", "call", "mobile", "fax", "telefono"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
    "short_card": {"card", "visa", "amex", "credit", "debit", "karte", "carte", "tarjeta"},
    "national_id": {"ssn", "social", "security", "id", "identity"},
}
LOWERS = {"ip": {"version", "release", "section", "v"}, "card": {"order", "tracking", "isbn", "invoice"}, "short_card": {"order", "tracking", "isbn", "invoice"}, "phone": {"isbn", "order"}, "national_id": {"part", "model", "serial"}}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rest = 0
    for c in iban[4:] + iban[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def card_numbers(text: str) -> Iterator[tuple[int, int, int]]:
    """start, end, digits of every run that passes Luhn."""
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.start(), m.end(), len(digits)


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Spans whose length is their country's, or any where the country is not listed, and which mod-97 confirms."""
    m = IBAN.search(text)
    while m:
        places = [i for i in range(m.start(), m.end()) if text[i] != " "]
        code = "".join(text[i] for i in places)
        known = IBAN_LENGTH.get(code[:2].upper())
        end = next((places[n - 1] + 1 for n in ([known] if known else ANY_LENGTH) if n <= len(code) and not text[places[n - 1] + 1 : places[n - 1] + 2].isalnum() and mod97(code[:n])), 0)
        if end:
            yield m.start(), end
        # what fails may have swallowed the start of another
        m = IBAN.search(text, end or m.start() + 4)


def scored(text: str, kind: str, start: int, end: int) -> float:
    near = {w.lower() for w in WORD.findall(f"{text[max(0, start - CONTEXT_CHARS) : start]} {text[end : end + CONTEXT_BEHIND]}")}
    s = START_SCORE[kind] + 0.3 * bool(near & RAISES[kind]) - 0.3 * bool(near & LOWERS.get(kind, set()))
    return round(min(1.0, max(0.0, s)), 3)


def spans_of(text: str | None) -> list[tuple[str, int, int, float, bool]]:
    """All spans of a text, in the order of the kinds as listed, then by start."""
    if not text:
        return []
    found = {k: [] for k in (*BASE_KINDS, *ADDED_KINDS)}
    if "@" in text:
        found["email"] = list(emails(text))
    if DIGIT.search(text):
        found["ip"] = list(addresses(text))
        for start, end, n in card_numbers(text):
            found["card" if n >= 16 else "short_card"].append((start, end))
        if "+" in text:
            found["phone"] = list(phones(text))
        found["iban"] = list(ibans(text))
        found["national_id"] = [m.span() for m in NATIONAL.finditer(text)]
    out = []
    for kind, spans in found.items():
        base = kind in BASE_KINDS
        for start, end in spans:
            s = scored(text, kind, start, end)
            if base or s >= MIN_SCORE:
                out.append((kind, start, end, s, base))
    return out


def redacted(text: str | None) -> str | None:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    spans = sorted((s, e, k) for k, s, e, _, _ in spans_of(text))
    if not spans:
        return text
    out, done = [], 0
    for start, end, kind in spans:
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join(out) + text[done:]


def _find(text: pd.Series) -> pd.Series:
    names = ("kind", "start", "end", "score", "base")
    return pd.Series([[dict(zip(names, s, strict=True)) for s in spans_of(t)] for t in text], dtype=object)


def _redact(text: pd.Series) -> pd.Series:
    return pd.Series([redacted(t) for t in text], dtype=object)


def find_spans(text: Column) -> Column:
    """array<struct<kind, start, end, score, base>> of a text column."""
    return F.pandas_udf(_find, SPAN_TYPE)(text)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of the text column replaced; n_chars follows where it exists."""
    out = docs.withColumn(text_col, F.pandas_udf(_redact, "string")(F.col(text_col)))
    return out.withColumn("n_chars", F.length(text_col).cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, hash of the base spans, list of all spans."""
    found = docs.select("doc_id", find_spans(F.col("text")).alias("found"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = _listed(F.filter("found", lambda s: s["base"]))
    return found.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(base, 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))
