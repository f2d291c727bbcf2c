"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Four base kinds (email, ip, card, phone) are reported whenever their pattern and
their numeric test hold. The other kinds are reported when their score, after the
context words, reaches the threshold. Spans count code points, end exclusive.

Null and empty texts have no spans. Equal rows give equal results; the input's
other columns are never touched, so clashing names cannot occur.
"""

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the task: the base kinds in their listed order, and their patterns.
BASE_KINDS = ("email", "ip", "card", "phone")
EMAIL_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL_DOMAIN = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

OTHER_KINDS = ("iban", "ssn")
KINDS = BASE_KINDS + OTHER_KINDS
THRESHOLD = 0.6
CONTEXT_CHARS = 48
CONTEXT_STEP = 0.2

# score before context, words that raise it, words that lower it
RULES = {
    "email": (0.9, "mail email contact write correo courriel kontakt", "example"),
    "ip": (0.7, "ip host server address login", "version release chapter section"),
    "card": (0.8, "card credit visa mastercard payment tarjeta carte karte", "isbn serial order tracking"),
    "phone": (0.8, "call phone tel mobile fax telefon telefono", "score ratio"),
    "iban": (0.8, "iban bank account konto compte cuenta", "serial"),
    "ssn": (0.4, "ssn social security taxpayer", "order part serial isbn"),
}

_find_domain = re.compile(EMAIL_DOMAIN).match
_find_local_end = re.compile(EMAIL_LOCAL + "*").match
# a run of digits is entered at its first digit only, so that long runs cost one pass
_find_ip = re.compile(r"(?<![0-9])" + IP.replace("[0-9]+", "[0-9]++")).finditer
_find_card = re.compile(CARD).finditer
_find_phone = re.compile(PHONE).finditer
_find_iban = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])").finditer
_find_ssn = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])").finditer
_words = re.compile(r"[^\W\d_]+").findall
_context = {k: (base, frozenset(up.split()), frozenset(down.split())) for k, (base, up, down) in RULES.items()}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    """Every second digit from the right is doubled; the sum of all decimal digits is a multiple of ten."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def mod97(code: str) -> bool:
    """The number made of the code turned round by four, letters as 10 to 35, leaves 1 when divided by 97."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text):
    at, low = text.find("@"), 0
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        domain = _find_domain(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            low = domain.end()
        at = text.find("@", max(at + 1, low))


def _only_digits(s):
    return re.sub(r"[^0-9]", "", s)


def _ips(text):
    for m in _find_ip(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m[0].split(".")):
            yield m.span()


def _cards(text):
    for m in _find_card(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
            yield m.span()


def _phones(text):
    if "+" in text:
        for m in _find_phone(text):
            if 9 <= len(_only_digits(m[0])) <= 15:
                yield m.span()


def _ibans(text):
    for m in _find_iban(text):
        code = m[0].replace(" ", "")
        if 15 <= len(code) <= 34 and mod97(code):
            yield m.span()


def _ssns(text):
    for m in _find_ssn(text):
        yield m.span()


FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "ssn": _ssns}


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's own score, moved one step for each kind of nearby word, within 0 and 1."""
    base, up, down = _context[kind]
    near = set(_words((text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]).lower()))
    return round(min(1.0, max(0.0, base + CONTEXT_STEP * (bool(near & up) - bool(near & down)))), 3)


def spans_of(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of all personal data in a text, by start and then kind."""
    if not text:
        return []
    found = []
    for kind, finder in FINDERS.items():
        for start, end in finder(text):
            s = score(text, kind, start, end)
            if kind in BASE_KINDS or s >= threshold:
                found.append((kind, start, end, s))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


SPANS_TYPE = "array<struct<kind:string,start:int,end:int,score:double>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def find(text: Column, threshold: float = THRESHOLD) -> Column:
    """All spans of personal data of a text column."""

    @F.arrow_udf(SPANS_TYPE)
    def spans(texts: pa.Array) -> pa.Array:
        rows = [[dict(zip(("kind", "start", "end", "score"), s)) for s in spans_of(t.as_py(), threshold)] for t in texts]
        return pa.array(rows, type=_ARROW)

    return spans(text)


def redacted(text: str | None, threshold: float = THRESHOLD) -> str | None:
    """The text with each span, or each run of overlapping spans, replaced by its first kind in brackets."""
    spans = spans_of(text, threshold)
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end, _ = spans[i]
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], "[", kind.upper(), "]"]
        at = end
    return "".join(out) + text[at:]


def redact(text: Column, threshold: float = THRESHOLD) -> Column:
    """The text column with personal data replaced; null stays null."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array((redacted(t.as_py(), threshold) for t in texts), type=pa.string())

    return clean(text)


def joined(spans: Column, kinds=None) -> Column:
    """Spans as kind:start:end, comma-joined; only of some kinds if these are given."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
