"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a single pass: at-signs and their written-out forms, schemes, plus signs, digits,
and words that announce an identifier. At each anchor a small local parser expands to both sides, and the value found is checked.
No parser looks at characters that another match of its kind has taken, and each moves only over the run of characters its
grammar allows, so the time grows with the text, also on long runs that a search by patterns would try again and again.

Base kinds, found and dropped as their patterns say (leftmost, not overlapping, without retries):
email, ip (parts up to 255), card (13 to 19 digits by Luhn), phone (9 to 15 digits).

The method adds, where no base match of the kind lies:

- email: letters beyond ASCII on either side of the at-sign, and ``[at]``, ``(at)``, `` at `` written out; with `` at `` every
  dot must be written out too, and the last label be one of a short list. The last label has two letters or more.
- ip: a bracketed IPv6 address after a scheme. phone: 7 to 15 digits after ``tel:``.
- account: after its cue an IBAN (by its check sum), a social security number (possible area, group and serial), an account
  number of 6 to 17 digits, a passport number of 6 to 9 letters and digits, 5 digits at least.
- login: a url with user name and password, up to the end of its host.

Cues count in lower case, capitals and with a capital first, and only as whole words.

Defined cases: a null text counts as empty and has no spans; a null id stays null; repeated rows give equal results; spans
of different kinds may overlap (:func:`redact` replaces what they cover together); texts are read whole; an empty table gives
an empty result; columns of any other name are left out, by :func:`redact` kept as they are.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType

from .common import map_texts, packed, pick, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "login")
#: Words before an identifier, and the parser that reads it.
CUES = {
    "iban": "iban", "ssn": "ssn", "social security": "ssn", "passport": "passport",
    "account": "account", "acct": "account", "konto": "account", "cuenta": "account", "compte": "account",
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGIT_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LABELS = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")
_WRITTEN_LABELS = re.compile(r"[A-Za-z0-9-]++(?:(?:\.| ?[\[(]dot[\])] ?| dot )[A-Za-z0-9-]++)++", re.I)
_WRITTEN_DOTS = re.compile(r"[A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++", re.I)
_LAST_LABEL = re.compile(r"[^\W\d_]{2,}\Z")
#: What an address ends on where all its signs are written out as words, which prose may hold as well.
_ENDINGS = re.compile(r" (?:com|org|net|edu|gov|info|biz|io|eu|de|fr|es|it|nl|uk|us)\Z", re.I)
_TEL = re.compile(r"[0-9](?:[\x20().-]{0,2}[0-9]){6,14}(?![0-9])")
_IPV6 = re.compile(r"[0-9A-Fa-f:.]{2,45}(?=\])")
_LOGIN = re.compile(r"[^\s/?#@:<>\"']+:[^\s/?#@<>\"']+@[A-Za-z0-9.-]+")
_BETWEEN = re.compile(r"(?:[\x20]?(?:no|nr|num|number)\b\.?)?[\x20]?[:#=]?[\x20]?", re.I)
_VALUES = {
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}(?![A-Za-z0-9])"),
    "ssn": re.compile(r"[0-9]{3}([\x20-]?)[0-9]{2}\1[0-9]{4}(?![0-9])"),
    "passport": re.compile(r"[A-Z0-9]{6,9}(?![A-Za-z0-9])"),
    "account": re.compile(r"[0-9](?:[\x20-]?[0-9]){5,16}(?![0-9])"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _right_iban(value: str) -> bool:
    value = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _right_ssn(value: str) -> bool:
    d = re.sub("[^0-9]", "", value)
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


_CHECKS = {"iban": _right_iban, "ssn": _right_ssn, "passport": lambda v: sum(c.isdigit() for c in v) >= 5, "account": lambda v: True}


def _right_ipv6(value: str) -> bool:
    import ipaddress

    try:
        return ipaddress.ip_address(value).version == 6
    except ValueError:
        return False


class Finder:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        anchors = {"@": "at", "+": "plus", "://": "scheme", " at ": "written dots"} | {str(d): "digit" for d in range(10)}
        for words, parser in ((("[at]", "(at)"), "written"), (("tel:",), "tel"), *(((cue,), parser) for cue, parser in CUES.items())):
            for word in words:
                anchors |= dict.fromkeys((word, word.upper(), word.capitalize(), word.title()), parser)
        for anchor, parser in anchors.items():
            self.automaton.add_word(anchor, (parser, len(anchor)))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[str, int, int, bool]]:
        """(kind, start, end, whether it is a base match), in the order of KINDS, then by start."""
        base: dict[str, list[tuple[int, int]]] = {kind: [] for kind in BASE_KINDS}
        later = []
        taken = {"email": 0, "ip": 0, "card": 0}
        for last, (parser, width) in self.automaton.iter(text):
            start, end = last + 1 - width, last + 1
            if parser == "digit":
                if start >= taken["card"]:
                    chain = _DIGIT_CHAIN.match(text, start)
                    taken["card"] = chain.end()
                    digits = chain[0].replace(" ", "").replace("-", "") if chain.end() - start >= 13 else ""
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        base["card"].append(chain.span())
                if start >= taken["ip"]:
                    chain = _DOTTED.match(text, start)
                    taken["ip"] = chain.end()
                    if chain.end() - start >= 7:
                        base["ip"] += self._addresses(chain[0], start)
            elif parser == "at":
                at = start
                domain = _DOMAIN.match(text, end)
                if domain:
                    while at > taken["email"] and text[at - 1] in _LOCAL:
                        at -= 1
                if domain and at < start:
                    base["email"].append((at, domain.end()))
                    taken["email"] = domain.end()
                else:
                    later.append((parser, start, end))
            elif parser == "plus":
                number = _PHONE.match(text, start)
                if number and 9 <= sum(c.isdigit() for c in number[0]) <= 15:
                    base["phone"].append(number.span())
            else:
                later.append((parser, start, end))
        found = [(kind, a, b, True) for kind in BASE_KINDS for a, b in base[kind]]
        if later:
            found += self._added(text, later, base)
            found.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
        return found

    @staticmethod
    def _addresses(chain: str, start: int) -> list[tuple[int, int]]:
        """Four parts at a time of a chain of numbers with single dots between."""
        out, parts = [], chain.split(".")
        for i in range(0, len(parts) - 3, 4):
            end = start + sum(len(p) + 1 for p in parts[i : i + 4])
            if all(small_part(p) for p in parts[i : i + 4]):
                out.append((start, end - 1))
            start = end
        return out

    def _added(self, text: str, anchors, base) -> list[tuple[str, int, int, bool]]:
        """What the anchors other than those of base matches give; of one kind nothing overlaps, base matches least of all."""
        out = []
        taken = {kind: list(base.get(kind, ())) for kind in KINDS}
        reached = dict.fromkeys(KINDS, 0)
        for parser, start, end in anchors:
            kind, span = self._parse(text, parser, start, end, reached["email"])
            if span is None or span[0] < reached[kind]:
                continue
            if self._overlaps(taken[kind], span):
                continue
            reached[kind] = span[1]
            out.append((kind, *span, False))
        return out

    @staticmethod
    def _overlaps(spans: list[tuple[int, int]], span: tuple[int, int]) -> bool:
        from bisect import bisect_left

        i = bisect_left(spans, (span[1],))  # the first that starts at or behind the end
        return i > 0 and spans[i - 1][1] > span[0]

    def _parse(self, text: str, parser: str, start: int, end: int, floor: int) -> tuple[str, tuple[int, int] | None]:
        if parser in ("at", "written", "written dots"):
            return "email", self._email(text, parser, start, end, floor)
        if parser == "scheme":
            if text.startswith("[", end):
                address = _IPV6.match(text, end + 1)
                return "ip", address.span() if address and _right_ipv6(address[0]) else None
            rest = _LOGIN.match(text, end)
            while rest and start > 0 and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+.-"):
                start -= 1
            return "login", (start, rest.end()) if rest and text[start].isalpha() else None
        if text[start - 1 : start].isalnum():
            return "phone" if parser == "tel" else "account", None
        if parser == "tel":
            number = _TEL.match(text, end)
            return "phone", number.span() if number else None
        if text[end : end + 1].isalnum():
            return "account", None
        value = _VALUES[parser].match(text, _BETWEEN.match(text, end).end())
        while value and not _CHECKS[parser](value[0]):  # capitals after an IBAN look like more of it
            value = _VALUES[parser].fullmatch(text, value.start(), value.start() + max(0, value[0].rfind(" "))) if parser == "iban" else None
        return "account", value.span() if value else None

    @staticmethod
    def _email(text: str, parser: str, start: int, end: int, floor: int) -> tuple[int, int] | None:
        if parser == "written":
            end += text.startswith(" ", end)
            start -= text.startswith(" ", start - 1) and start > 0
        domain = (_LABELS if parser == "at" else _WRITTEN_DOTS if parser == "written dots" else _WRITTEN_LABELS).match(text, end)
        if not domain or not (_ENDINGS if parser == "written dots" else _LAST_LABEL).search(domain[0]):
            return None
        at = start
        while at > floor and (text[at - 1] in _LOCAL or parser == "at" and text[at - 1].isalnum()):
            at -= 1
        return (at, domain.end()) if at < start else None


def _written(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b, *_ in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_values: bool = True) -> DataFrame:
    """One row per row of docs: id_col, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans as kind:start:end,
    and with_values found, an array of (kind, start, end, base, value); places count code points, end exclusive.
    """
    rows = pick(docs, id_col, text_col).toDF("id", "text")
    fields = [(id_col, rows.schema["id"].dataType), *[(f"n_{kind}", "long") for kind in BASE_KINDS], ("base_sha256", "string"), ("spans", "string")]
    value = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("value", pa.string())])

    def make():
        finder = Finder()

        def f(ids, texts):
            columns: list[list] = [[] for _ in range(len(BASE_KINDS) + 2 + with_values)]
            for held in texts:
                text = held.as_py() or ""
                spans = finder.spans(text)
                base = [s for s in spans if s[3]]
                row = [*(sum(s[0] == kind for s in base) for kind in BASE_KINDS), hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans)]
                if with_values:
                    row.append([{"kind": k, "start": a, "end": b, "base": is_base, "value": text[a:b]} for k, a, b, is_base in spans])
                for column, v in zip(columns, row):
                    column.append(v)
            kinds = [*[pa.int64()] * len(BASE_KINDS), pa.string(), pa.string(), pa.list_(value)]
            return [ids, *[pa.array(c, kind) for c, kind in zip(columns, kinds)]]

        return f

    if with_values:
        from pyspark.sql.pandas.types import from_arrow_type

        fields.append(("found", from_arrow_type(pa.list_(value))))
    return map_texts(rows, make, fields)


def redacted(text: str, spans) -> str:
    """text with ``<KIND>`` in place of each span; spans that overlap count as one, of the first one's kind."""
    out, done, end = [], 0, -1
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[done:a], f"<{kind.upper()}>"]
        end = done = max(end, b)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, all columns, with what is found in the text replaced by its kind; a null text stays null."""
    rows = packed(docs, text_col).toDF("text", "row")

    def make():
        finder = Finder()
        return lambda texts, kept: [pa.array([None if (t := x.as_py()) is None else redacted(t, finder.spans(t)) for x in texts], pa.string()), kept]

    out = map_texts(rows, make, [("text", StringType()), ("row", rows.schema["row"].dataType)])
    at = docs.columns.index(text_col)
    return out.select(*["text" if i == at else f"row.c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def op13_personal_data(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), with_values=False)
