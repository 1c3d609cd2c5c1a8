"""Personal data, by anchor expansion.

Method. One Aho-Corasick pass over a text finds anchors: at-signs, schemes, plus signs, digits and identifier
cues. At an anchor a small deterministic parser expands to the boundaries of an email address, a network address,
a card or phone number, an account number (IBAN, or digits after their cue), a social security or passport number, a
login inside an address, an issued key, or a password, key or token assigned after its cue, and
validates it. Cues count in either case (issued keys in their own). Texts without an anchor cost that one pass.

The four base kinds are the leftmost non-overlapping matches of these patterns, kept if they validate:
  email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
  ip     four runs of digits joined by dots, each at most 255
  card   digits with at most one space or hyphen between two, 14 to 19 of them, passing Luhn
  phone  a plus sign and a run of digits, spaces, dots, brackets and hyphens, 10 to 15 digits
Positions are code points. Rows are independent: no shuffle, nothing held beyond a batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.exchange import annotate_rows

#: In the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone", "account", "login", "secret", "identity")

Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_SPACED = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: In one piece, in either case; or in groups of four, in capitals.
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}[A-Za-z0-9]{11,30}(?![A-Za-z0-9])")
_IBAN_GROUPS = re.compile(r"[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOGIN = re.compile(r"[A-Za-z0-9._~%-]+:[^\s/@]+(?=@)")
_EQUALS = re.compile(r"[\"']?\s?[=:]\s?([\"']?)")
_BEARER = re.compile(r"\s+([A-Za-z0-9._~+/=-]{16,})")
_RUN = re.compile(r"[^\s\"']*")
#: What may stand between "account" or the like and the number.
_NUMBER = re.compile(r"(?i:[\s_]?(?:number|num|nr|no|#))?[\s.:#=]{0,3}(?:is\s)?([0-9](?:[ -]?[0-9]){6,16})(?![A-Za-z0-9]|[ -]?[0-9])")
_SOCIAL = re.compile(r"(?i:[\s_]?security)?(?i:[\s_]?(?:number|num|no|#))?[\s.:#=]{0,3}(?:is\s)?([0-9]{3})([ -]?)([0-9]{2})\2([0-9]{4})(?![A-Za-z0-9])")
_PASSPORT = re.compile(r"(?i:[\s_]?(?:number|num|no|#))?[\s.:#=]{0,3}(?:is\s)?((?=[A-Z]{0,2}[0-9])[A-Z0-9]{7,9})(?![A-Za-z0-9])")
#: Beginnings of issued keys (fixed values), with the rest that each needs.
_ISSUED = {
    "AKIA": r"[A-Z0-9]{16}", "ASIA": r"[A-Z0-9]{16}", "AIza": r"[A-Za-z0-9_-]{35}", "ghp_": r"[A-Za-z0-9]{20,}", "gho_": r"[A-Za-z0-9]{20,}", "ghs_": r"[A-Za-z0-9]{20,}", "github_pat_": r"[A-Za-z0-9_]{22,}",
    "glpat-": r"[A-Za-z0-9_-]{20,}", "sk-": r"(?=[A-Za-z-]*[0-9])[A-Za-z0-9_-]{20,}", "sk_live_": r"[A-Za-z0-9]{16,}", "pk_live_": r"[A-Za-z0-9]{16,}", "xoxb-": r"[A-Za-z0-9-]{20,}", "xoxp-": r"[A-Za-z0-9-]{20,}",
    "npm_": r"[A-Za-z0-9]{30,}", "hf_": r"[A-Za-z0-9]{30,}", "eyJ": r"[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
}
_ISSUED_KEYS = {cue: re.compile(re.escape(cue) + rest + r"(?![A-Za-z0-9])") for cue, rest in _ISSUED.items()}
#: Cues are found in either case; issued keys are then matched in their own.
_CUES = {
    "@": "at", "://": "scheme", "+": "plus", "bearer": "bearer", "account": "account", "acct": "account", "iban": "account", "ssn": "social", "social": "social", "passport": "passport",
    **dict.fromkeys(("password", "passwd", "passphrase", "pwd", "token", "secret", "credential", "api_key", "api-key", "apikey", "access_key", "access-key", "private_key", "auth_key"), "assigned"),
}
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _lowered(text: str) -> str:
    """Of the same length, A-Z in lower case at least."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban(text: str) -> bool:
    compact = text.replace(" ", "")
    if not 15 <= len(compact) <= 34:
        return False
    moved = compact[4:] + compact[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


class Finder:
    """All spans of a text, by start, then kind. A text is gone through once, however many cues it has."""

    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        cues: dict[str, list[tuple[str, str]]] = {}
        for cue, kind in [*_CUES.items(), *((str(d), "digit") for d in range(10)), *((cue, "issued") for cue in _ISSUED)]:
            cues.setdefault(cue.lower(), []).append((kind, cue))
        for low, some in cues.items():
            self.automaton.add_word(low, (some, len(low)))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[Span]:
        found: list[Span] = []
        ends = {"email": 0, "dotted": 0, "spaced": 0}
        run = [0, 0, -1]  # the last run without white space or quotes: its bounds, its last digit
        for end, (kinds, size) in self.automaton.iter(_lowered(text)):
            for kind, cue in kinds:
                self._expand(text, kind, cue, end + 1 - size, end + 1, found, ends, run)
        return sorted(set(found), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))

    def _expand(self, text: str, kind: str, cue: str, at: int, after: int, found: list[Span], ends: dict[str, int], run: list[int]) -> None:
        """What a cue at text[at:after] leads to."""
        if kind == "digit":
            if at >= ends["dotted"]:
                match = _DOTTED.match(text, at)
                ends["dotted"] = match.end()
                if "." in match[0]:
                    found += self._ips(match[0], at)
            if at >= ends["spaced"]:
                match = _SPACED.match(text, at)
                ends["spaced"] = match.end() if match else at + 1
                if match and 14 <= match.end() - at:
                    digits = match[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        found.append((at, match.end(), "card"))
                if at >= 2 and text[at - 2 : at].isascii() and text[at - 2 : at].isalpha():
                    found += self._account(text, at - 2)
        elif kind == "at":
            start = at
            while start > ends["email"] and text[start - 1] in _LOCAL:
                start -= 1
            match = _DOMAIN.match(text, at + 1) if start < at else None
            if match:
                ends["email"] = match.end()
                found.append((start, match.end(), "email"))
        elif kind == "plus":
            match = _PHONE.match(text, at)
            if match and 10 <= sum(c.isdigit() for c in match[0]) <= 15:
                found.append((at, match.end(), "phone"))
        elif kind == "scheme":
            match = _LOGIN.match(text, after)
            if match:
                found.append((*match.span(), "login"))
        elif kind == "issued":
            match = _ISSUED_KEYS[cue].match(text, at)
            if match and not (at and (text[at - 1].isalnum() or text[at - 1] == "_")):
                found.append((*match.span(), "secret"))
        elif kind == "assigned":
            match = _EQUALS.match(text, after)
            if match:
                self._value(text, match.end(), match[1], found, run)
        elif at and text[at - 1].isalnum():  # the other cues are words
            return
        elif kind == "bearer":
            match = _BEARER.match(text, after)
            if match and any(c.isdigit() for c in match[1]):
                found.append((*match.span(1), "secret"))
        elif kind == "account":
            match = _NUMBER.match(text, after)
            if match:
                found.append((*match.span(1), "account"))
        elif kind == "social":
            match = _SOCIAL.match(text, after)
            if match and match[1] not in ("000", "666") and match[1] < "900" and match[3] != "00" and match[4] != "0000":
                found.append((match.start(1), match.end(), "identity"))
        elif kind == "passport":
            match = _PASSPORT.match(text, after)
            if match:
                found.append((*match.span(1), "identity"))

    def _value(self, text: str, start: int, quote: str, found: list[Span], run: list[int]) -> None:
        """An assigned value of eight characters or more with a digit; its run is looked at once for all cues in it."""
        if not run[0] <= start < run[1]:
            stop = _RUN.match(text, start).end()
            last = next((k for k in range(stop - 1, start - 1, -1) if text[k].isdigit()), -1)
            run[:] = [start, stop, last]
        if run[1] - start >= 8 and run[2] >= start and (not quote or text[run[1] : run[1] + 1] == quote):
            found.append((start, run[1], "secret"))

    def _ips(self, chain: str, at: int) -> list[Span]:
        out, parts = [], chain.split(".")
        for k in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[k : k + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts[k : k + 4]):
                out.append((at, at + size, "ip"))
            at += size + 1
        return out

    def _account(self, text: str, at: int) -> list[Span]:
        if at and text[at - 1].isalnum():
            return []
        for shape in (_IBAN, _IBAN_GROUPS):
            match = shape.match(text, at)
            while match:
                if _iban(match[0].upper()):
                    return [(at, match.end(), "account")]
                shorter = match[0].rfind(" ")  # the last group may be the next word
                match = shape.fullmatch(text, at, at + shorter) if shorter > 0 else None
        return []


def redact(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind in brackets; overlapping ones by the kind of the first."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


_finder: list[Finder] = []


def finder() -> Finder:
    """The worker's own automaton."""
    if not _finder:
        _finder.append(Finder())
    return _finder[0]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def _columns(texts: pa.Array) -> list[pa.Array]:
    spans, clean = [], []
    for text in texts:
        text = text.as_py()
        found = finder().spans(text or "")
        spans.append([{"start": s, "end": e, "kind": k} for s, e, k in found])
        clean.append(redact(text, found) if found else text)
    return [pa.array(spans, _SPANS), pa.array(clean, pa.string())]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, spans (array of start, end, kind; empty for a null or empty text).

    Ids may be null or repeat; texts are taken whole, in time that grows with their length; other columns play no part;
    an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["id"], _columns(batch["text"])[0]], names=["id", "spans"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "id long, spans array<struct<start: long, end: long, kind: string>>")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with its own columns, personal data in the text replaced by [EMAIL], [IP] and so on; null stays null."""
    clean: Callable[[pa.Array], list[pa.Array]] = lambda texts: [_columns(texts)[1]]
    marked = annotate_rows(docs, [text_col], clean, "clean string")
    return marked.select(*[F.col("clean").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
