"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds (email, ip, card, phone) are fixed by their pattern and rule; their spans always stay. The further kinds
start from a score, gain when a checksum holds or a telling word stands in the `CONTEXT` characters before or after, lose
when a denying word stands before, and count from `THRESHOLD` on. An IBAN ends after its country's length, or else after the
longest stretch of whole tokens, as the checksum confirms. Every scan is linear in the text: no pattern is tried again
inside a run that it has already read, but for an IBAN's, of 34 characters at most, which may begin at each token.

Cases: a null or empty text has no spans, an empty table no rows; equal and overlapping spans of different kinds are all
reported, and a tie of two starts goes by the order of KINDS; repeated rows, and rows with the same id or none, each get their
row; texts of any length are searched whole; other columns are not read by `find` and carried through by `masked`, whatever
their names; masking joins overlapping spans.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import map_rows, positions

KINDS = ("email", "ip", "card", "phone", "iban", "secret", "local_phone")
BASE = KINDS[:4]
THRESHOLD = 0.5
CONTEXT = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Further kinds: pattern, score to start from, telling words, denying words.
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_TOKEN = re.compile(r"[A-Za-z0-9]+")
_WORD = re.compile(r"\w")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?i:password|passwd|secret|token|api_?key) ?[=:] ?\"?[A-Za-z0-9_/+-]{12,}\"?)")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])")
FURTHER = {
    "iban": (0.2, re.compile(r"(?i)\b(?:iban|account|konto|compte|cuenta|bank)\b"), re.compile(r"(?i)\b(?:invoice|isbn|order|serial)\b")),
    "secret": (0.6, re.compile(r"(?i)\b(?:aws|key|secret|login|credential)\b"), re.compile(r"(?i)\b(?:example|placeholder|dummy)\b")),
    "local_phone": (0.3, re.compile(r"(?i)\b(?:phone|tel|call|fax|mobile|contact)\b"), re.compile(r"(?i)\b(?:isbn|order|serial|version|invoice)\b")),
}
_LENGTHS = (
    "NO15 BE16 DK18 FI18 FO18 GL18 NL18 SD18 MK19 SI19 AT20 BA20 EE20 KZ20 LT20 LU20 XK20 CH21 HR21 LI21 LV21 BG22 BH22 CR22 DE22 GB22 GE22 IE22 ME22 RS22 VA22 AE23 GI23 IL23 IQ23 TL23 "
    "AD24 CZ24 ES24 MD24 PK24 RO24 SA24 SE24 SK24 TN24 VG24 LY25 PT25 ST25 IS26 TR26 FR27 GR27 IT27 MC27 MR27 SM27 AL28 AZ28 BY28 CY28 DO28 GT28 HU28 LB28 PL28 SV28 BR29 EG29 PS29 QA29 UA29 "
    "JO30 KW30 MU30 MT31 SC31 LC32"
)
IBAN_LENGTH = {x[:2]: int(x[2:]) for x in _LENGTHS.split()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Of an IBAN without spaces: moved four places, letters as 10 to 35, the number leaves 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in order."""
    out = [(s, 0, e) for s, e in emails(text)]
    first = _DIGIT.search(text)
    if first:
        begin = first.start()
        for m in _IP.finditer(text, begin):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text, begin):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def ibans(text: str) -> list[tuple[int, int]]:
    """Spans of whole tokens that the checksum confirms: by the country's length, else the longest."""
    out, m = [], _IBAN.search(text)
    while m:
        plain, ends = "", {}
        for at in range(m.start(), m.end()):
            if text[at] != " ":
                plain += text[at]
                if 15 <= len(plain) <= 34 and not _TOKEN.match(text, at + 1):
                    ends[len(plain)] = at + 1
        # No other length is tried: of twenty, one in five would be confirmed by chance.
        tried = [n for n in (IBAN_LENGTH.get(plain[:2]), max(ends, default=None)) if n in ends]
        end = next((ends[n] for n in tried if mod97(plain[:n])), 0)
        if end:
            out.append((m.start(), end))
        m = _IBAN.search(text, end or _TOKEN.match(text, m.start()).end())
    return out


def _near(text: str, start: int, end: int, kind: str) -> float:
    """The kind's score with its context, whose outer ends are cut at word boundaries. A denying word names what comes next, so it only counts before."""
    score, telling, denying = FURTHER[kind]
    low, high = max(0, start - CONTEXT), min(len(text), end + CONTEXT)
    while 0 < low < start and _WORD.match(text, low - 1) and _WORD.match(text, low):
        low += 1
    while end < high < len(text) and _WORD.match(text, high - 1) and _WORD.match(text, high):
        high -= 1
    before, after = text[low:start], text[end:high]
    return score + 0.3 * bool(telling.search(before) or telling.search(after)) - 0.3 * bool(denying.search(before))


def further_spans(text: str) -> list[tuple[int, int, int, float]]:
    """(start, kind number, end, score) of the kinds that the score decides."""
    out = []
    for start, end in ibans(text):
        out.append((start, 4, end, _near(text, start, end, "iban") + 0.6))
    for m in _SECRET.finditer(text):
        out.append((m.start(), 5, m.end(), _near(text, m.start(), m.end(), "secret")))
    for m in _LOCAL_PHONE.finditer(text):
        out.append((m.start(), 6, m.end(), _near(text, m.start(), m.end(), "local_phone")))
    return [x for x in out if x[3] >= THRESHOLD]


def joined(spans) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    more = [(s, k, e) for s, k, e, _ in further_spans(text)]
    return base, sorted(base + more) if more else base


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the name of its first kind."""
    out, at, held = [], 0, None
    for s, k, e in spans:
        if held and s < held[1]:
            held = (held[0], max(held[1], e), held[2])
            continue
        if held:
            out += [text[at : held[0]], f"<{KINDS[held[2]]}>"]
            at = held[1]
        held = (s, e, k)
    if held:
        out += [text[at : held[0]], f"<{KINDS[held[2]]}>"]
        at = held[1]
    return "".join(out) + text[at:]


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of `df`."""

    def run(batch):
        counts: list[list[int]] = [[], [], [], []]
        digests, spans = [], []
        for text in batch.column(1).to_pylist():
            base, every = all_spans(text or "")
            for kind, held in enumerate(counts):
                held.append(sum(k == kind for _, k, _ in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(every))
        return {"doc_id": batch.column(0), "n_email": counts[0], "n_ip": counts[1], "n_card": counts[2], "n_phone": counts[3], "base_sha256": digests, "spans": spans}

    return map_rows(
        df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
        run,
    )


def masked(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with the spans of its text masked; null texts stay null, other columns stay as they are."""
    at = df.columns.index(text_col)

    def run(batch):
        import pyarrow as pa

        texts = [mask(t, spans) if t and (spans := all_spans(t)[1]) else t for t in batch.column(at).to_pylist()]
        columns = list(batch.columns)
        columns[at] = pa.array(texts, type=batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    def whole(batches):
        yield from map(run, batches)

    return positions(df, lambda plain: plain.mapInArrow(whole, plain.schema))
