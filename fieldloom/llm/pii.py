"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust the score.

Every kind has a pattern, a score for what the pattern proposes, a validator
(Luhn for cards, mod-97 for bank accounts, ranges for addresses and numbers)
that drops or confirms a proposal, and words that raise the score where they
stand within 50 characters.  A span is kept from a score of 0.6 on.  The four
base kinds score that much by themselves; kinds that look like other numbers
need their context.

All patterns are matched in time that is linear in the text: e-mail addresses
are found from their @, network addresses from runs of digits and dots, so
that no long run is tried from each of its characters.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, CONFIRMED, CONTEXT, NEAR = 0.6, 0.2, 0.35, 50
#: Lengths of bank account numbers by country, as the standard's registry states them.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26,
    "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}

Span = tuple[int, int]
_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9._%+-]+"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED, _PART = re.compile(r"[0-9][0-9.]*"), re.compile(r"[0-9]+")
_CARD, _PHONE = re.compile(r"[0-9](?:[ -]?[0-9])+"), re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]){11,30}")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.)-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_DATE = re.compile(r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9/-])")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    """Whether the digits pass: every second one from the right doubled, tens and ones added, a multiple of ten."""
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod_97(account: str) -> bool:
    """Whether an account number (no spaces) leaves 1 by 97, its first four characters last and letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local part, @ and a domain with a dot, none overlapping; sought from each @."""
    done, at = 0, text.find("@")
    while at >= 0:
        if domain := _DOMAIN.match(text, at + 1):
            begin = at
            while begin > done and text[begin - 1] in _LOCAL_CHARS:
                begin -= 1
            if begin < at:
                yield begin, domain.end()
                done = domain.end()
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[Span]:
    """Leftmost runs of four numbers with single dots between them, none overlapping, inside each run of digits and dots."""
    for run in _DOTTED.finditer(text):
        held: list[Span] = []
        for part in _PART.finditer(text, run.start(), run.end()):
            if held and part.start() != held[-1][1] + 1:
                held = []
            held.append(part.span())
            if len(held) == 4:
                yield held[0][0], held[3][1]
                held = []


def accounts(text: str) -> Iterator[Span]:
    """Account numbers of known countries, cut to their country's length."""
    for m in _IBAN.finditer(text):
        want, end, n = IBAN_LENGTHS.get(m.group()[:2]), m.start(), 0
        while end < m.end() and n < (want or 0):
            n += text[end] != " "
            end += 1
        if want and n == want and not text[end : end + 1].isalnum():
            yield m.start(), end


def _found(pattern: re.Pattern) -> Callable[[str], Iterator[Span]]:
    return lambda text: (m.span() for m in pattern.finditer(text))


def _is_address(value: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in value.split("."))


def _is_card(value: str) -> bool:
    return 14 <= len(d := digits(value)) <= 19 and luhn(d)


def _is_ssn(value: str) -> bool:
    area, group, serial = value.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _is_date(value: str) -> bool:
    a, b, c = (int(x) for x in re.split("[./-]", value))
    year, first, second = (a, b, c) if a > 31 else (c, a, b)
    return 1900 <= year <= 2099 and 1 <= min(first, second) <= 12 and 1 <= max(first, second) <= 31


class Kind(NamedTuple):
    name: str
    hint: str  # a text without any of these characters has none
    propose: Callable[[str], Iterator[Span]]
    valid: Callable[[str], bool]
    score: float  # of a proposal
    confirms: bool  # whether valid is a checksum, which raises the score
    context: re.Pattern


def _words(*words: str) -> re.Pattern:
    return re.compile(r"(?<![a-z])(?:" + "|".join(words) + r")(?![a-z])", re.IGNORECASE)


#: In the order of spans that begin together; the first four are the base kinds.
KINDS = (
    Kind("email", "@", emails, lambda v: True, 0.8, False, _words("e-?mail", "mail", "contact", "courriel", "correo")),
    Kind("ip", ".", addresses, _is_address, 0.6, False, _words("ip", "address", "host", "server", "login", "adresse")),
    Kind("card", "0123456789", _found(_CARD), _is_card, 0.6, True, _words("card", "credit", "visa", "mastercard", "amex", "karte", "carte", "tarjeta")),
    Kind("phone", "+", _found(_PHONE), lambda v: 10 <= len(digits(v)) <= 15, 0.6, False, _words("phone", "call", "tel", "mobile", "fax", "telefon", "téléphone", "teléfono")),
    Kind("iban", "0123456789", accounts, lambda v: mod_97(v.replace(" ", "")), 0.5, True, _words("iban", "account", "bank", "konto", "compte", "cuenta")),
    Kind("ssn", "-", _found(_SSN), _is_ssn, 0.3, False, _words("ssn", "social security", "social", "taxpayer", "security number")),
    Kind("local_phone", "0123456789", _found(_LOCAL_PHONE), lambda v: True, 0.3, False, _words("phone", "call", "tel", "mobile", "cell", "fax", "telefon", "téléphone", "teléfono")),
    Kind("birth_date", "0123456789", _found(_DATE), _is_date, 0.3, False, _words("born", "birth", "birthday", "dob", "geboren", "né", "née", "nacido", "nacida")),
)
BASE = tuple(k.name for k in KINDS[:4])
_DIGIT = re.compile("[0-9]")


def merged(spans: list[Span]) -> list[Span]:
    """The same characters as disjoint spans, in order."""
    out: list[Span] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def overlaps(disjoint: list[Span], a: int, b: int) -> bool:
    at = bisect_left(disjoint, (b, 0)) - 1  # the last that begins before b
    return at >= 0 and disjoint[at][1] > a


def spans_of(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of the personal data of a text, by start and kind; code points, end excluded.

    Spans of one kind don't overlap.  Spans of a kind beyond the base ones go
    where they overlap an earlier kind's.
    """
    made, taken = [], []
    digit = _DIGIT.search(text) is not None
    for rank, kind in enumerate(KINDS):
        if not (digit if kind.hint[0].isdigit() else kind.hint in text):
            continue
        before = merged(taken) if rank >= len(BASE) else []
        for a, b in kind.propose(text):
            value = text[a:b]
            if not kind.valid(value):
                continue
            score = kind.score + CONFIRMED * kind.confirms
            if kind.context.search(text, max(0, a - NEAR), a) or kind.context.search(text, b, b + NEAR):
                score += CONTEXT
            if score < KEEP or (before and overlaps(before, a, b)):
                continue
            taken.append((a, b))
            made.append((a, rank, kind.name, b, min(1.0, round(score, 2))))
    return [(name, a, b, score) for a, _, name, b, score in sorted(made)]


SPAN = "array<struct<kind:string,start:int,end:int,score:double,text:string>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of structs kind, start, end, score, text) of each row of docs (doc_id, text; other columns are ignored).

    Whole texts are searched.  A null or empty text has no spans; repeated
    rows are rows of their own; an empty table gives no rows.  start and end
    are code points, end excluded; spans are in order of start, then of kind
    as KINDS lists them.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                rows.append([{"kind": k, "start": a, "end": b, "score": s, "text": text[a:b]} for k, a, b, s in spans_of(text)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPANS)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, f"doc_id bigint, spans {SPAN}")


def masked(text: str) -> str:
    """text with each span of personal data as its kind in angle brackets; spans that overlap become one, by the first's kind."""
    out, at = [], 0
    for kind, a, b, _ in spans_of(text):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced by its kind; all rows and columns are kept, null texts stay null."""
    at = docs.columns.index("text")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([None if t is None else masked(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at).name, text)

    return docs.mapInArrow(mask, docs.schema)


def digest(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
