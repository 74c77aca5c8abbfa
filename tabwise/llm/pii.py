"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a whole text in one pass:
at-signs, scheme marks, plus signs, digits and identifier cues ("account",
"IBAN" and the like). At each anchor a small deterministic parser expands to
the left and right, bounded by what its kind may contain, and validates what it
found (label structure, octets, Luhn, digit counts, remainder 97).

Kinds, in the order in which spans with one start are listed:

- ``email``  ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
- ``ip``     four dotted numbers, each at most 255
- ``card``   14 to 19 digits, one space or hyphen between two of them, Luhn
- ``phone``  plus sign, then digits, spaces, brackets, dots, hyphens; 10 to 15 digits
- ``url``    scheme, ``://``, host and the rest up to white space or a quote
- ``iban``   country, check digits, 11 to 30 more characters, remainder 97
- ``account`` 6 to 18 digits after an account cue

The first four are base kinds: per kind they are the leftmost non-overlapping
matches of their patterns from the text's start; a match that fails its
validation is dropped with all its characters. The last three are what the
method adds; they may overlap base spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwise.llm.common import small_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account")

#: Cues that announce an account number, as written in running text.
ACCOUNT_CUES = ("account", "acct", "a/c", "konto", "compte", "cuenta")
IBAN_CUE = "iban"

Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DIGITS = frozenset("0123456789")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_dotted = re.compile(r"[0-9]+(?:\.[0-9]+)*").match
_chain = re.compile(r"[0-9](?:[\x20-]?[0-9])*").match
_dialled = re.compile(r"[\x20().0-9-]*").match
_address = re.compile(r"[A-Za-z0-9\[][^\s<>\"'`{}|\\^]*").match
_iban = re.compile(r"([A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30})(?![A-Za-z0-9])").match
_number = re.compile(r"(?:[\x20]?(?:no|nr|num|number|id))?[.:#=\x20]{0,4}([0-9](?:[\x20-]?[0-9]){5,17})(?![0-9])",
                     re.IGNORECASE).match


@cache
def automaton() -> ahocorasick.Automaton:
    """Anchors and their kinds; cues in lower, capitalised and upper case."""
    found = ahocorasick.Automaton()
    found.add_word("@", "email")
    found.add_word("+", "phone")
    found.add_word("://", "url")
    for digit in "0123456789":
        found.add_word(digit, "card")
        found.add_word(f".{digit}", "ip")
    for kind, cues in (("account", ACCOUNT_CUES), ("iban", (IBAN_CUE,))):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.upper()}:
                found.add_word(form, kind)
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def remainder_97(iban: str) -> bool:
    """The check digits of an account number in the international form."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _octet(part: str) -> bool:
    significant = part.lstrip("0")
    return len(significant) < 4 and int(significant or "0") <= 255


class _Parsers:
    """Local parsers of one text; each keeps where its last match ended, so
    every character is expanded over at most once per kind."""

    def __init__(self, text: str):
        self.text = text
        self.found: list[Span] = []
        self.ends = dict.fromkeys(KINDS, 0)

    def email(self, last: int) -> None:
        text, start, first = self.text, last, self.ends["email"]
        while start > first and text[start - 1] in _LOCAL:
            start -= 1
        if start < last and (m := _domain(text, last + 1)):
            self._keep("email", start, m.end())

    def ip(self, last: int) -> None:
        text, start = self.text, last - 1
        if start < self.ends["ip"]:
            return
        while start > self.ends["ip"] and text[start - 1] in _DIGITS:
            start -= 1
        if start == last - 1:
            return
        m = _dotted(text, start)
        parts, at = m.group().split("."), start
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(_octet, four)):
                self.found.append((at, end, "ip"))
            at = end + 1
        self.ends["ip"] = m.end()

    def card(self, last: int) -> None:
        if last < self.ends["card"]:
            return
        m = _chain(self.text, last)
        digits = m.group().replace(" ", "").replace("-", "") if 14 <= m.end() - last <= 37 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            self.found.append((last, m.end(), "card"))
        self.ends["card"] = m.end()
        if last >= 2 and self.text[last - 2:last].isalpha():
            self._iban_at(last - 2)

    def phone(self, last: int) -> None:
        text = self.text
        if last + 1 >= len(text) or text[last + 1] not in _DIGITS:
            return
        end = _dialled(text, last + 2).end()
        while end > last + 3 and text[end - 1] not in _DIGITS:
            end -= 1
        if end > last + 3 and 10 <= sum(c in _DIGITS for c in text[last:end]) <= 15:
            self._keep("phone", last, end)

    def url(self, last: int) -> None:
        text, start = self.text, last - 2
        if start < self.ends["url"]:
            return
        while start > self.ends["url"] and text[start - 1] in _SCHEME:
            start -= 1
        while start < last - 2 and not (text[start].isascii() and text[start].isalpha()):
            start += 1
        if start < last - 2 and (m := _address(text, last + 1)):
            end = m.end()
            while text[end - 1] in ".,;:!?)]":
                end -= 1
            if end > last + 1:
                self._keep("url", start, end)

    def iban(self, last: int) -> None:
        start = last + 1
        while start < min(last + 6, len(self.text)) and self.text[start] in " :=#.":
            start += 1
        self._iban_at(start)

    def _iban_at(self, start: int) -> None:
        text = self.text
        if start < self.ends["iban"] or (start and text[start - 1].isalnum()):
            return
        if (m := _iban(text, start)) and remainder_97(m.group(1).replace(" ", "")):
            self._keep("iban", start, m.end(1))

    def account(self, last: int) -> None:
        if last >= self.ends["account"] and (m := _number(self.text, last + 1)):
            self._keep("account", m.start(1), m.end(1))

    def _keep(self, kind: str, start: int, end: int) -> None:
        self.found.append((start, end, kind))
        self.ends[kind] = end


def spans(text: str | None) -> list[Span]:
    """``(start, end, kind)`` of one text by start, then kind; code points,
    end exclusive. A null text has none."""
    if not text:
        return []
    parsers = _Parsers(text)
    at = {kind: getattr(parsers, kind) for kind in KINDS}
    for last, kind in automaton().iter(text):
        at[kind](last)
    return sorted(parsers.found, key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([",".join(f"{k}:{s}:{e}" for s, e, k in spans(t)) for t in batch], dtype=object)


def joined_spans(text: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined ("" if there is none)."""
    return F.pandas_udf(_joined, "string")(text)


def find(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """All columns of ``docs`` and ``spans_col``: array of (kind, start, end,
    value), by start, then kind. Null and empty texts have an empty array,
    repeated rows the same spans each; an empty table stays empty. A column of
    the name ``spans_col`` is replaced, others stay as they are. Sets the
    session's Arrow batches to at most 1000 rows, as whole texts go through
    Python; the result needs no shuffle."""
    small_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    fields = F.filter(F.split(joined_spans(text), ","), lambda x: x != "")

    def span(x: Column) -> Column:
        part = F.split(x, ":")
        start, end = F.get(part, 1).cast("long"), F.get(part, 2).cast("long")
        return F.struct(F.get(part, 0).alias("kind"), start.alias("start"), end.alias("end"),
                        F.substring(text, start.cast("int") + 1, (end - start).cast("int")).alias("value"))
    return docs.withColumn(spans_col, F.transform(fields, span))


def _masked(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([mask_text(t) for t in batch], dtype=object)


def mask_text(text: str | None) -> str | None:
    """The text with ``<kind>`` in place of every span; of overlapping spans
    the union is replaced and the first one names it. A null text stays null."""
    if not text:
        return text
    out, at = [], 0
    for start, end, kind in spans(text):
        if start >= at:
            out += text[at:start], f"<{kind}>"
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` masked; other columns stay."""
    small_batches(docs.sparkSession)
    return docs.withColumn(text_col, F.pandas_udf(_masked, "string")(F.col(f"`{text_col}`")))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, the counts of the base kinds, ``base_sha256`` over
    the base spans and ``spans``. Nulls, empty texts, repeated rows: as in
    ``find`` (a row without spans has counts 0 and the digest of "")."""
    small_batches(docs.sparkSession)
    found = docs.select(F.col(f"`{id_col}`").alias(id_col), joined_spans(F.col(f"`{text_col}`")).alias("spans"))
    base = F.filter(F.split("spans", ","), lambda x: F.substring_index(x, ":", 1).isin(*BASE))
    counted = found.withColumn("__base", base)

    def count(kind: str) -> Column:
        return F.size(F.filter("__base", lambda x: x.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")
    return counted.select(
        id_col, *[count(kind) for kind in BASE],
        F.sha2(F.concat_ws(",", "__base"), 256).alias("base_sha256"), "spans")
