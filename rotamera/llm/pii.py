"""Personal data by anchor expansion.

An Aho-Corasick automaton goes over a text once and stops at anchors: at-signs, ``://``, plus signs,
digits and identifier cues. A parser for each kind grows the span from its anchor and checks it. Parsers
look no further than the run of characters that may belong to a span and never behind the last
span of their kind, so a text costs in proportion to its length.

Base kinds give what a left-to-right search for their patterns gives: email, ip (four parts of at
most 255), card (14 to 19 digits, Luhn), phone (10 to 15 digits). The method adds:

* ``login``: a url with user information, ``scheme://user[:password]@host``;
* ``iban``: after the cue ``iban``, two letters, two digits and 11 to 30 more, checked modulo 97;
* ``account``: after ``account``, ``acct``, ``passport`` or ``ssn``, up to three letters and 6 or
  more digits.

A cue counts in either case, if no letter, digit or underscore stands next to it; ``no`` or
``number``, one of ``.:#=`` and single blanks may follow it.

Defined results: a null or empty text has no spans. Offsets are code points, ends exclusive. Spans
of one kind do not overlap, those of different kinds may. Texts are read whole; every row is
judged on its own, repeated rows alike. Other columns pass unchanged. There is no shuffle.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

KINDS = ("email", "ip", "card", "phone", "login", "iban", "account")
BASE = KINDS[:4]
CUES = ("iban", "account", "acct", "passport", "ssn")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = LOCAL - frozenset("_%")
WORD = LOCAL - frozenset(".%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
FOUR = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
USER = re.compile(r"""://[^\x00-\x20/?#@"'<>]++@[A-Za-z0-9.-]++""")
AFTER_CUE = r"(?i:\x20(?:no|number))?\x20?[.:#=]?\x20?"
IBAN = re.compile(AFTER_CUE + r"([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
ACCOUNT = re.compile(AFTER_CUE + r"([A-Z]{0,3}[0-9](?:[\x20-]?[0-9]){5,})")


@lru_cache(1)
def anchors():
    import ahocorasick
    a = ahocorasick.Automaton()
    for c in "@+0123456789":
        a.add_word(c, (c if c in "@+" else "0", 1))
    a.add_word("://", ("://", 3))
    for cue in CUES:
        for way in itertools.product(*((c, c.upper()) for c in cue)):
            a.add_word("".join(way), (cue, len(cue)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _left(text: str, at: int, low: int, chars: frozenset) -> int:
    while at > low and text[at - 1] in chars:
        at -= 1
    return at


def spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind's place in ``KINDS``, end), sorted."""
    out: list[tuple[int, int, int]] = []
    done = [0] * len(KINDS)      # where the last match of each kind ends, valid or not

    def add(kind, start, end, valid=True):
        done[kind] = end
        if valid:
            out.append((start, kind, end))

    for last, (what, size) in anchors().iter(text or ""):
        at = last - size + 1
        if what == "0":
            if at >= done[2] and (m := DIGITS.match(text, at)):
                digits = m[0].replace(" ", "").replace("-", "")
                add(2, at, m.end(), 14 <= len(digits) <= 19 and luhn(digits))
            if at >= done[1] and not (at and text[at - 1] in "0123456789") and (m := FOUR.match(text, at)):
                add(1, at, m.end(), all(map(small, m.groups())))
        elif what == "@":
            start = _left(text, at, done[0], LOCAL)
            if start < at and (m := DOMAIN.match(text, at + 1)):
                add(0, start, m.end())
        elif what == "+":
            if at >= done[3] and (m := PHONE.match(text, at)):
                add(3, at, m.end(), 10 <= sum(c in "0123456789" for c in m[0]) <= 15)
        elif what == "://":
            start = _left(text, at, done[4], SCHEME)
            while start < at and not text[start].isalpha():
                start += 1
            if start < at and (m := USER.match(text, at)):
                add(4, start, m.end())
        elif not (at and text[at - 1] in WORD) and text[last + 1:last + 2] not in WORD:
            kind = 5 if what == "iban" else 6
            m = (IBAN if kind == 5 else ACCOUNT).match(text, last + 1)
            if at >= done[kind] and m:
                add(kind, m.start(1), m.end(), kind == 6 or mod97(m[1]))
    return sorted(out)


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()),
                              StructField("end", LongType())]))


@F.arrow_udf(SPANS)
def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The spans of each text by start, then kind as listed in ``KINDS``."""
    kinds = pa.array(KINDS)
    for a in texts:
        each = [spans(t) for t in a.to_pylist()]
        flat = list(itertools.chain.from_iterable(each))
        offsets = [0, *itertools.accumulate(map(len, each))]
        start, kind, end = (pa.array([x[i] for x in flat], pa.int64()) for i in range(3))
        rows = pa.StructArray.from_arrays([kinds.take(kind), start, end], ["kind", "start", "end"])
        yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)
