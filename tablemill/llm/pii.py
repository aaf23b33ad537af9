"""Personal data: anchors found by Aho-Corasick, spans grown and validated by local parsers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds in the order that breaks ties of starts; the first four are the base kinds.
KINDS = ["email", "ip", "card", "phone", "url", "account"]
#: Cues that announce an identifier, matched in lower, title and upper case.
CUES = ["iban", "account", "acct", "konto", "cuenta", "compte", "ssn", "passport", "customer", "member"]
#: Query parameters that carry personal data.
PARAMETERS = ["email", "mail", "user", "username", "phone", "tel", "name", "ssn"]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*$")
URL_TAIL = re.compile(r"[^\s<>\"'`{}|\\^]+")
USER_INFO = re.compile(r"[^/?#@]+@[^/?#@]+")
PARAMETER = re.compile(r"[?&](?:" + "|".join(PARAMETERS) + r")=[^&#]+", re.I)
IDENTIFIER = re.compile(r"(?:\s*(?:number|no|nr|id)\b)?[\s:=#.\"'-]{1,6}([A-Za-z0-9](?:[ -]?[A-Za-z0-9]){5,33})(?![A-Za-z0-9])")
BARE = re.compile(r"(?:\s*(?:number|no|nr|id)\b)?[\s:=#.\"'-]{1,6}([A-Za-z0-9-]{6,34})(?![A-Za-z0-9])")


@cache
def automaton() -> ahocorasick.Automaton:
    """All anchors: at-signs, schemes, plus signs, digits and identifier cues."""
    a = ahocorasick.Automaton()
    for anchor in ["@", "+", "://", *"0123456789"]:
        a.add_word(anchor, (anchor if not anchor.isdigit() else "0", len(anchor)))
    for cue in CUES:
        for form in (cue, cue.title(), cue.upper()):
            a.add_word(form, ("cue", len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban(value: str) -> bool:
    v = re.sub(r"[ -]", "", value).upper()
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", v)) and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def account(text: str, at: int) -> tuple[int, int] | None:
    """The identifier that follows a cue ending at ``at``: a valid IBAN, or one token with four digits or more."""
    if m := IDENTIFIER.match(text, at):
        start, end = m.span(1)
        while end > start and not iban(text[start:end]):  # an IBAN may be followed by further words
            cut = max(text.rfind(" ", start, end), start)
            end = cut if cut > start else start
        if end > start:
            return start, end
    if (m := BARE.match(text, at)) and sum(c.isdigit() for c in m[1]) >= 4:
        return m.span(1)
    return None


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, by start and then kind; a span that fails validation is dropped.

    Each base kind is leftmost and without overlaps of its own kind. Web addresses count when they carry user
    data, accounts when they overlap no base span.
    """
    found, extra = [], []
    email_end = quad_end = digits_end = phone_end = url_end = 0
    for last, (anchor, length) in automaton().iter(text):
        at = last - length + 1
        if anchor == "0":
            if at >= digits_end and (m := DIGITS.match(text, at)):
                digits_end = m.end()
                digits = re.sub("[ -]", "", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((at, 2, digits_end))
            if at >= quad_end and (at == quad_end or not "0" <= text[at - 1 : at] <= "9") and (m := QUAD.match(text, at)):
                quad_end = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                    found.append((at, 1, quad_end))
        elif anchor == "@":
            start = at
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email_end = m.end()
                found.append((start, 0, email_end))
        elif anchor == "+":
            if at >= phone_end and (m := PHONE.match(text, at)):
                phone_end = m.end()
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found.append((at, 3, phone_end))
        elif anchor == "://":
            if at >= url_end and (s := SCHEME.search(text, max(url_end, at - 20), at)) and (m := URL_TAIL.match(text, at + 3)):
                tail = m[0].rstrip(".,;:!?)]")
                if tail and (USER_INFO.match(tail) or PARAMETER.search(tail)):
                    url_end = at + 3 + len(tail)
                    found.append((s.start(), 4, url_end))
        elif not (text[at - 1 : at].isalpha() and at) and not text[last + 1 : last + 2].isalpha() and (span := account(text, last + 1)):
            extra.append(span)
    taken = [(a, b) for a, _, b in found]
    for a, b in extra:
        if all(b <= x or a >= y for x, y in taken):
            found.append((a, 5, b))
            taken.append((a, b))
    return sorted(found)


SPANS = "array<struct<kind:string,start:int,end:int>>"


def pii_spans(text: str | Column) -> Column:
    """Spans of personal data of a text as kind, start, end (code points, end exclusive), by start, then kind.

    Null and empty texts have none. Texts are searched whole; a task holds one Arrow batch of them.
    """

    @F.pandas_udf(SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[] if t is None else [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find(t)] for t in texts])

    return spans.asNondeterministic()(text)
