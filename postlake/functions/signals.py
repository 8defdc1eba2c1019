"""The labels of programs, the AI and data topic and areas by one automaton pass over a text, in place of a pattern after the other.

Every pattern needs some plain words: what it must hold is read off the pattern itself. One Aho-Corasick automaton finds the words of all rules at
once; only a rule whose words occur looks at the text. The labels are those of :mod:`postlake.functions.classifiers`. As the rules are data of a Python worker, not expressions of the plan, planning
does not grow with them.
"""

from __future__ import annotations

import re
import re._constants as ops
import re._parser as parser
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.functions import classifiers as C
from postlake.functions import fixed

_TEXTS = pa.list_(pa.string())
_TYPE = pa.struct([
    ("program", pa.struct([("internship", pa.string()), ("coop", pa.string())])), ("topic", pa.struct([("matched", pa.bool_()), ("score", pa.int32()), ("evidence", _TEXTS)])),
    ("areas", pa.list_(pa.struct([("area", pa.string()), ("score", pa.int32()), ("evidence", _TEXTS)]))),
])
LABELS = "struct<program:struct<internship:string,coop:string>,topic:struct<matched:boolean,score:int,evidence:array<string>>,areas:array<struct<area:string,score:int,evidence:array<string>>>>"


def needed_words(pattern: str) -> set[str]:
    """Words, in lower case, one of which every match of the pattern holds; empty where none can be told.

    Classes of letters (``\\p{L}``) and checks before or after a match say nothing and are passed over.
    """
    def best(parts) -> set[str]:
        found, run = [], ""
        for op, value in [*parts, (None, None)]:
            if op is ops.LITERAL:
                run += chr(value)
                continue
            if op is ops.AT:
                continue
            if run:
                found.append({run})
                run = ""
            if op is ops.SUBPATTERN:
                found.append(best(value[3]))
            elif op is ops.BRANCH:
                each = [best(x) for x in value[1]]
                found.append(set().union(*each) if all(each) else set())
            elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and value[0] > 0:
                found.append(best(value[2]))
        return max((f for f in found if f), key=lambda f: min(map(len, f)), default=set())

    # look-arounds and classes of letters tell no words; a place holder keeps what stands beside them apart
    plain = re.sub(r"\\p\{[A-Z]\}", ".", pattern)
    return {w.lower() for w in best(parser.parse(plain))}


class Rules:
    """(key, pattern) rules of one kind; the order is kept."""

    def __init__(self, rules: Iterable[tuple[str, str]], words_of: Iterable[str] | None = None):
        import regex

        self.rules = [(key, regex.compile(p, regex.ASCII | regex.IGNORECASE | regex.V0)) for key, p in rules]
        self.words = [needed_words(p) for _, p in (zip([k for k, _ in self.rules], words_of) if words_of else rules)]


#: How rules begin and end that match a word by itself.
ALONE = (r"(^|[^a-z0-9])", r"([^a-z0-9]|$)")


class Matcher:
    """One automaton over the words of several sets of rules."""

    def __init__(self, sets: dict[str, Rules]):
        import ahocorasick

        self.sets = sets
        held: dict[str, tuple[list, list]] = {}  # of each word the rules that it may be part of a longer word for, and those where it stands alone
        self.always = {name: [i for i, w in enumerate(r.words) if not w] for name, r in sets.items()}
        for name, r in sets.items():
            for i, ((_, rule), words) in enumerate(zip(r.rules, r.words)):
                alone = ALONE[0] in rule.pattern and ALONE[1] in rule.pattern
                for w in words:
                    held.setdefault(w, ([], []))[alone].append((name, i))
        self.automaton = ahocorasick.Automaton()
        for w, rules in held.items():
            self.automaton.add_word(w, (w, *rules))
        self.automaton.make_automaton()

    def candidates(self, text: str) -> dict[str, set[int]]:
        """For each set the numbers of the rules whose words occur in the text; one pass for all sets."""
        out = {name: set(always) for name, always in self.always.items()}
        low = text.lower()
        n, inside, alone = len(low), set(), set()
        for last, (word, anywhere, by_itself) in self.automaton.iter(low):
            if anywhere and word not in inside:
                inside.add(word)
                for name, i in anywhere:
                    out[name].add(i)
            if by_itself and word not in alone:
                before, after = last - len(word), last + 1
                if (before < 0 or low[before] not in PLAIN) and (after == n or low[after] not in PLAIN):
                    alone.add(word)
                    for name, i in by_itself:
                        out[name].add(i)
        return out

    def keys(self, text: str, candidates: dict[str, set[int]], name: str) -> list[str]:
        """The keys of the rules of a set that match, in order."""
        rules = self.sets[name].rules
        return [rules[i][0] for i in sorted(candidates[name]) if rules[i][1].search(text)]


PLAIN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_COMPATIBLE = str.maketrans(*C._COMPATIBLE)
_ODD = re.compile(f"[{re.escape(C._COMPATIBLE[0])}]")
_SPACES = re.compile(r"\s+", re.A)


def spaced(text: str | None) -> str:
    """What ``classifiers.spaced`` makes of a text."""
    if not text:
        return ""
    if not text.isascii() and _ODD.search(text):
        text = text.translate(_COMPATIBLE)
    return _SPACES.sub(" ", text).strip(" ")


FIELDS = ("title", "department", "team", "businessUnit", "jobFamily", "jobFunction")
SOFTWARE = ("title", "jobFamily", "jobFunction")


class Labels:
    def __init__(self):
        short = fixed.SUPPORTING[:3]
        sets = {
            "internship": Rules(C.INTERNSHIPS), "coop": Rules(C._words(fixed.COOP_WORDS)), "recruits": Rules([("", fixed.RECRUITS_INTERNS)]), "clinical": Rules([("", fixed.CLINICAL)]),
            "field": Rules([*fixed.DOMAIN, *short]), "skill": Rules([*fixed.DOMAIN, *fixed.TOOLS, *short]), "domain": Rules(fixed.DOMAIN), "supporting": Rules(fixed.SUPPORTING),
        }
        for area, signals in fixed.AREAS.items():
            sets[area] = Rules(signals)
            if area != "software-engineering":
                tracks = [*signals, *(fixed.DATA_TRACK if area == "data-analytics" else [])]
                sets[f"{area} track"] = Rules([(key, f"(?={p}){C._in_track(area)}") for key, p in tracks], [p for _, p in tracks])
        sets["lead"] = Rules([("", fixed.TRACK_LEAD)])
        self.matcher = Matcher(sets)

    def read(self, text: str):
        """What the rules of a set say of the text, by name of the set; the text is scanned once for all of them."""
        found = self.matcher.candidates(text) if text else None
        return lambda name: self.matcher.keys(text, found, name) if text else []

    def program(self, title: str) -> dict:
        said = self.read(title)
        internships, coops = said("internship"), said("coop")
        first = internships[0] if internships else None
        if first and (said("recruits") or first == "externship" and said("clinical")):
            first = None
        return {"internship": first and f"title:{first}", "coop": f"title:{coops[0]}" if coops else None}

    def all(self, row: dict) -> dict:
        row = row | {part: [spaced(t) for t in row[part] or []] for part in ("fields", "skills", "body")}
        fields, skills, body = ([self.read(t) for t in row[part]] for part in ("fields", "skills", "body"))
        order = lambda name, keys: [k for k, _ in self.matcher.sets[name].rules if k in keys]
        of = lambda texts, name: order(name, {k for said in texts for k in said(name)})
        structural = [f"{name}:{k}" for name, said in zip(FIELDS, fields) for k in said("field")]
        owned = [f"skill:{k}" for k in of(skills, "skill")]
        domain, supporting = [f"body:{k}" for k in of(body, "domain")], [f"body:{k}" for k in of(body, "supporting")]
        d, s = len(domain), len(supporting)
        matched = bool(structural) or bool(owned) or d >= 2 or s >= 3 or d >= 1 and s >= 2
        topic = {"matched": matched, "score": 4 * len(structural) + 4 * len(owned) + 2 * d + s, "evidence": sorted({*structural, *owned, *domain, *supporting})}

        amp = lambda part, read: [said if "&" not in t else self.read(re.sub("&amp;", "&", t, flags=re.I | re.A)) for t, said in zip(row[part], read)]
        fields, skills, body = amp("fields", fields), amp("skills", skills), amp("body", body)
        tracks = [said for said in body if said("lead")]  # no track without a lead
        areas = []
        for area in fixed.AREAS:
            software = area == "software-engineering"
            four = [f"{name}:{k}" for name, said in zip(FIELDS, fields) if not software or name in SOFTWARE for k in said(area)]
            two = []
            if not software:
                four += [f"skill:{k}" for k in of(skills, area)]
                two = [f"body-track:{k}" for k in of(tracks, f"{area} track")]
            if four or two:
                areas.append({"area": area, "score": 4 * len(four) + 2 * len(two), "evidence": sorted([*four, *two])})
        return {"program": self.program(row["title"]), "topic": topic, "areas": areas}


_HELD: list[Labels] = []


def labels(fields: dict[str, Column], skills: Column, body: list[Column]) -> Column:
    """struct(program, topic, areas) of a posting: what ``classifiers.programs`` says of its title, and ``ai_data_topic`` and ``areas`` of all of it."""
    row = F.struct(
        F.trim(F.regexp_replace(F.regexp_replace(C.unaccented(fields["title"]), "[‐‑‒–—]", "-"), r"\s+", " ")).alias("title"), F.array(*[fields[n] for n in FIELDS]).alias("fields"),
        skills.alias("skills"), F.array(*body).alias("body"))

    @F.arrow_udf(LABELS)
    def found(rows: pa.Array) -> pa.Array:
        if not _HELD:  # once a worker
            _HELD.append(Labels())
        return pa.array([_HELD[0].all(r) for r in rows.to_pylist()], _TYPE)

    return found(row)
