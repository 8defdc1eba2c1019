"""Row classifiers of postings as built-in column expressions: they run inside a projection, without Python and without a shuffle.

Nulls count as missing text. All of them read whole texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

EDGE_BEFORE, EDGE_AFTER = r"(?:^|[^\p{L}\p{N}])", r"(?=$|[^\p{L}\p{N}])"


def _one_letter(form: str, ranges: Iterable[range], strip_marks: bool) -> tuple[str, str]:
    """Characters of the ranges whose normal form is one character, and those characters."""
    pairs = []
    for c in map(chr, (i for r in ranges for i in r)):
        plain = unicodedata.normalize(form, c)
        plain = "".join(x for x in plain if not unicodedata.category(x).startswith("M")) if strip_marks else plain
        if len(plain) == 1 and plain != c:
            pairs.append((c, plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_WIDTHS = (range(0xA0, 0x100), range(0x2000, 0x2070), range(0x3000, 0x3001), range(0xFF01, 0xFF5F))
_COMPATIBLE = _one_letter("NFKC", _WIDTHS, False)
_UNACCENTED = _one_letter("NFKD", (*_WIDTHS, range(0x100, 0x250), range(0x370, 0x530), range(0x1E00, 0x2000)), True)


def spaced(c: Column) -> Column:
    """One width of letters and spaces, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), *_COMPATIBLE), r"\s+", " "))


def unaccented(c: Column) -> Column:
    """Lower case without marks on letters."""
    return F.lower(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), *_UNACCENTED), r"\p{M}+", ""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_label(c: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """The label of the first pattern that occurs; null if none does."""
    return F.coalesce(*[F.when(c.rlike(p), F.lit(label)) for label, p in rules])


def labels(prefix: str, rules: Iterable[tuple[str, str]], occurs: Callable[[str], Column]) -> Column:
    return F.array_compact(F.array(*[F.when(occurs(f"(?i){p}"), F.lit(f"{prefix}:{key}")) for key, p in rules]))


def _labels_as(prefix: str, rules: list[tuple[str, str]]) -> Callable[[Column], Column]:
    return lambda t: labels(prefix, rules, t.rlike)


def in_any(texts: Column, prefix: str, rules: list[tuple[str, str]]) -> Column:
    """The labels whose pattern occurs in at least one text of the array."""
    return let(texts, lambda ts: labels(prefix, rules, lambda p: F.exists(ts, lambda t: t.rlike(p))))


def _words(rules: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return [(label, EDGE_BEFORE + p + EDGE_AFTER) for label, p in rules]


INTERNSHIPS = [(label, EDGE_BEFORE + p + EDGE_AFTER if edges else p) for label, p, edges in fixed.INTERNSHIPS]


def programs(title: Column) -> Column:
    """struct(internship, coop): the evidence ``title:<label>`` of each program, null where the title is none."""

    def both(t: Column) -> Column:
        plain = lambda label: F.when(~t.rlike(fixed.RECRUITS_INTERNS) & ~((label == "externship") & t.rlike(fixed.CLINICAL)), F.concat(F.lit("title:"), label))
        coop = F.concat(F.lit("title:"), first_label(t, _words(fixed.COOP_WORDS)))
        return F.struct(let(first_label(t, INTERNSHIPS), plain).alias("internship"), coop.alias("coop"))

    return let(F.trim(F.regexp_replace(F.regexp_replace(unaccented(title), "[‐‑‒–—]", "-"), r"\s+", " ")), both)


def _type_values(value: Column) -> Column:
    """The parts of a text between ; and , or of each member of a JSON array; JSON that can't be read has none."""
    text = F.trim(F.coalesce(value, F.lit("")))
    members = F.when(text.startswith("["), F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array(text))
    parts = F.flatten(F.transform(F.array_compact(members), lambda m: F.split(m, "[;,]")))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda p: p != "")


def employment_type(value: Column) -> Column:
    """Known employment types, joined by `` / ``, in the order of the text; co-op comes before all others; null if none is known."""
    known = F.create_map(*[F.lit(x) for pair in fixed.TYPES.items() for x in pair])

    def one(part: Column) -> Column:
        return let(F.regexp_replace(F.lower(part), "[^a-z0-9]", ""), lambda token: F.coalesce(F.try_element_at(known, token), first_label(token, fixed.TYPE_PATTERNS)))

    def joined(values: Column) -> Column:
        text = F.array_join(F.array_distinct(F.array_compact(F.transform(values, one))), " / ")
        return F.when(F.exists(values, lambda p: p.rlike(fixed.COOP_TYPE)), "Co-op").otherwise(F.nullif(text, F.lit("")))

    return let(_type_values(value), joined)


def bullet_fields(bullets: Column) -> Column:
    """struct(employment_type, department) of a card's short texts: the first known type, the first text that is no type, requisition or promotion."""
    texts = F.filter(F.transform(F.coalesce(bullets, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda b: b != "")
    department = F.filter(texts, lambda b: ~b.rlike(fixed.REQUISITION) & employment_type(b).isNull() & ~b.rlike(fixed.PROMOTION))
    return F.struct(F.get(F.array_compact(F.transform(texts, employment_type)), F.lit(0)).alias("employment_type"), F.get(department, F.lit(0)).alias("department"))


def effective_program(kind: Column, internship: Column, coop: Column) -> Column:
    """struct(employment_type, keys): a co-op by type or title is no internship; a type of internship makes one; without a type the program gives it."""
    is_coop = F.coalesce(kind == "Co-op", F.lit(False)) | coop.isNotNull()
    is_intern = internship.isNotNull() | F.coalesce(F.array_contains(F.split(kind, " / "), "Internship"), F.lit(False))
    keys = F.when(is_coop, F.array(F.lit("coop"))).when(is_intern, F.array(F.lit("internship"))).otherwise(F.array().cast("array<string>"))
    return F.struct(F.when(is_coop, "Co-op").otherwise(F.coalesce(kind, F.when(internship.isNotNull(), "Internship"))).alias("employment_type"), keys.alias("keys"))


def in_united_states(country: Column, location: Column) -> Column:
    """The narrow test of the recruiting year: a country's name, or a state's code at the end or before a comma."""
    place = F.trim(F.translate(F.coalesce(location, F.lit("")), *_COMPATIBLE))
    code = F.regexp_extract(place, r"(?:^|,\s*|\s)([A-Z]{2})(?:\s+\d{5}(?:-\d{4})?)?(?:$|,)", 1)
    named = F.lower(F.trim(F.coalesce(country, F.lit("")))).isin("us", "usa", "united states", "united states of america")
    return named | place.rlike(r"(?i)\b(?:united states(?: of america)?|u\.s\.a?\.)\b") | code.isin(*fixed.STATE_CODES)


def recruiting_years(title: Column, body: Column, in_us: Column, published: Column, keys: Column) -> Column:
    """Ascending array of struct(year, evidence): years of the title, of recruiting cycles in the body, else by the month of a US program's publication.

    A cycle is passed over where "graduate" or "graduation" stands before it in the same sentence, within 100 characters.
    """
    of_title = F.filter(F.split(F.coalesce(title, F.lit("")), "[^0-9]+"), lambda t: t.rlike(r"^20\d{2}$"))
    no_graduation = r"(?<!graduate[^.!?]{0,92})(?<!graduation[^.!?]{0,90})"
    text = F.coalesce(body, F.lit(""))
    of_body = F.concat(*[F.regexp_extract_all(text, F.lit(f"(?i){no_graduation}{p}"), F.lit(1)) for p in fixed.CYCLES])
    entry = lambda kind: lambda y: F.struct(y.cast("int").alias("year"), F.lit(kind).alias("evidence"))
    valid = lambda years: F.filter(F.array_distinct(years), lambda y: y.cast("int").between(2000, 2100))
    stated = F.concat(F.transform(valid(of_title), entry("title:explicit-year")), F.transform(valid(F.array_except(of_body, of_title)), entry("body:explicit-program-cycle")))
    at = F.try_to_timestamp(published)
    late = F.month(at) >= 7
    guess = F.struct((F.year(at) + F.when(late, 1).otherwise(0)).alias("year"), F.when(late, "inferred:us-program-posted-h2").otherwise("inferred:us-program-posted-h1").alias("evidence"))
    return let(stated, lambda found: F.when(F.size(found) > 0, F.array_sort(found)).when((F.size(keys) > 0) & in_us & at.isNotNull(), F.array(guess)).otherwise(found))


def ai_data_topic(fields: dict[str, Column], skills: Column, body: list[Column]) -> Column:
    """struct(matched, score, evidence). fields: title, department, team, businessUnit, jobFamily, jobFunction.

    Four points for each signal of a field or of the skills; of the body's signals two for a domain, one for a supporting one.
    The body alone counts with two domains, three supporting signals, or one and two.
    """
    short = fixed.SUPPORTING[:3]
    structural = F.concat(*[let(spaced(c), _labels_as(name, [*fixed.DOMAIN, *short])) for name, c in fields.items()])
    of_skills = in_any(F.transform(F.coalesce(skills, F.array().cast("array<string>")), lambda x: spaced(x)), "skill", [*fixed.DOMAIN, *fixed.TOOLS, *short])
    texts = F.array(*[spaced(c) for c in body])
    found = F.struct(structural.alias("fields"), of_skills.alias("skills"), in_any(texts, "body", fixed.DOMAIN).alias("domain"), in_any(texts, "body", fixed.SUPPORTING).alias("supporting"))

    def topic(x: Column) -> Column:
        d, s = F.size(x["domain"]), F.size(x["supporting"])
        matched = (F.size(x["fields"]) > 0) | (F.size(x["skills"]) > 0) | (d >= 2) | (s >= 3) | ((d >= 1) & (s >= 2))
        score = 4 * F.size(x["fields"]) + 4 * F.size(x["skills"]) + 2 * d + s
        evidence = F.array_sort(F.array_distinct(F.concat(x["fields"], x["skills"], x["domain"], x["supporting"])))
        return F.struct(matched.alias("matched"), score.alias("score"), evidence.alias("evidence"))

    return let(found, topic)


def _in_track(area: str) -> str:
    """A pattern to stand before a signal: it follows a lead such as "rotations in" in its sentence, and no phrase of other uses of AI is near."""
    near = "".join(rf"(?!.{{0,{180 - n}}}?\b{p}\b)(?<!\b{p}\b.{{0,{120 - n}}})" for p, n in fixed.INCIDENTAL) if area == "ai-ml" else ""
    return rf"(?<=\b{fixed.TRACK_LEAD}\b[^.!?;]{{0,220}}){near}"


def areas(fields: dict[str, Column], skills: Column, body: list[Column]) -> Column:
    """Array of struct(area, score, evidence), in the order ai-ml, data-analytics, software-engineering.

    Four points for each signal of a field or of the skills, two for each of the body, where a signal counts only inside
    an explicit list of tracks. Software engineering is told by title, jobFamily and jobFunction alone.
    """
    clean = lambda c: F.regexp_replace(spaced(c), "(?i)&amp;", "&")
    each, texts = F.transform(F.coalesce(skills, F.array().cast("array<string>")), lambda x: clean(x)), F.array(*[clean(c) for c in body])
    found = []
    for area, signals in fixed.AREAS.items():
        software = area == "software-engineering"
        own = [c for c in fields if not software or c in ("title", "jobFamily", "jobFunction")]
        four = F.concat(*[let(clean(fields[name]), _labels_as(name, signals)) for name in own])
        two = F.array().cast("array<string>")
        if not software:
            four = F.concat(four, in_any(each, "skill", signals))
            tracks = [*signals, *(fixed.DATA_TRACK if area == "data-analytics" else [])]
            guard = _in_track(area)
            two = in_any(texts, "body-track", [(key, f"(?={p}){guard}") for key, p in tracks])
        found.append(F.struct(F.lit(area).alias("area"), four.alias("four"), two.alias("two")))
    own = F.filter(F.array(*found), lambda a: F.size(a["four"]) + F.size(a["two"]) > 0)
    score = lambda a: 4 * F.size(a["four"]) + 2 * F.size(a["two"])
    return F.transform(own, lambda a: F.struct(a["area"].alias("area"), score(a).alias("score"), F.array_sort(F.concat(a["four"], a["two"])).alias("evidence")))


def _place(c: Column) -> Column:
    return F.trim(F.regexp_replace(unaccented(c), "[^a-z0-9]+", " "))


def _phrase(c: Column, phrases: list[str]) -> Column:
    return F.concat(F.lit(" "), c, F.lit(" ")).rlike(f" (?:{'|'.join(phrases)}) ")


def _generic(place: Column) -> Column:
    return (place == "") | place.isin(*fixed.NO_PLACE) | place.rlike(r"^\d+ locations?$")


def _of_location(location: Column) -> Column:
    code = F.regexp_extract(F.trim(F.coalesce(location, F.lit(""))), fixed.PLACE_CODE, 1)
    return let(_place(location), lambda place: (
        F.when(_generic(place), None).when(_phrase(place, fixed.US_NAMES), "us").when(_phrase(place, fixed.ELSEWHERE), "non_us").when(_phrase(place, fixed.STATES), "us")
        .when(code.isin(*fixed.STATE_CODES), "us").when(code.isin(*fixed.PROVINCE_CODES), "non_us")
    ))


def region(location: Column, city: Column, state: Column, country: Column, secondary: Column, source_in_us: Column | None = None) -> Column:
    """us, non_us, mixed or unknown; source_in_us says that a career site lists US postings only, and counts where a posting names no place."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    land, others = _place(country), F.coalesce(secondary, F.array().cast("array<string>"))
    of_country = F.when(land.isin(*fixed.NO_COUNTRY), None).when(land.isin(*fixed.US_NAMES), "us").otherwise("non_us")
    of_state = F.when((F.coalesce(country, F.lit("")) == "") & (F.coalesce(city, F.lit("")) != "") & F.upper(F.trim(state)).isin(*fixed.STATE_CODES), "us")
    found = F.array_compact(F.concat(F.array(of_country, of_state, _of_location(location)), F.transform(others, _of_location)))
    us, other = lambda f: F.array_contains(f, "us"), lambda f: F.array_contains(f, "non_us")
    nowhere = _generic(_place(location)) & ~F.exists(others, lambda x: ~_generic(_place(x))) & blank(city) & blank(state) & land.isin(*fixed.NO_COUNTRY)
    hint = nowhere & F.coalesce(source_in_us, F.lit(False)) if source_in_us is not None else F.lit(False)
    return let(found, lambda f: F.when(us(f) & other(f), "mixed").when(us(f), "us").when(other(f), "non_us").when(hint, "us").otherwise("unknown"))


def url_adapter(url: Column) -> Column:
    """The applicant tracking system that a url shows; custom if none."""
    u = F.lower(F.coalesce(url, F.lit("")))
    return F.coalesce(*[F.when(u.contains(part), name) for name, part in fixed.ADAPTERS], F.lit("custom"))


def _matchable(*texts: Column) -> Column:
    whole = F.translate(F.concat_ws(" ", *texts), *_COMPATIBLE)
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(whole), "[‐‑‒–—]", "-"), r"[^\p{L}\p{N}+#./-]+", " "), r"\s+", " "))


def _first_points(c: Column, rules: list[tuple[str, int, str]]) -> Column:
    return F.coalesce(*[F.when(c.rlike(p), F.struct(F.lit(code).alias("code"), F.lit(points).alias("points"))) for code, points, p in rules])


def resume_match(p: Callable[[str], Column], target_year: int = 2027, least: int = 60) -> Column:
    """struct(eligible, score, evidence array of struct(code, label, points), exclusion) of a posting whose columns p gives by name.

    p: title, job_family, job_function, summary, description, responsibilities, qualifications, education_requirements,
    experience_requirements, security_clearance, published_at, region; arrays skills, program_keys, recruiting_years (int).
    The first exclusion that fits ends it. Points of skills count up to 30 together, all points up to 100.
    """
    role = [p(x) for x in ("title", "job_family", "job_function", "summary", "description", "responsibilities", "qualifications")]
    terms = [p(x) for x in ("qualifications", "education_requirements", "experience_requirements", "security_clearance")]
    skills = [*[p(x) for x in ("summary", "description", "responsibilities", "qualifications")], F.array_join(p("skills"), " "), p("job_family"), p("job_function")]
    education = [p(x) for x in ("education_requirements", "qualifications", "description")]
    texts = {"title": [p("title")], "role": role, "terms": terms, "skills": skills, "education": education}
    return let(F.struct(*[_matchable(*parts).alias(name) for name, parts in texts.items()]), lambda t: _match(p, t, target_year, least))


def _named(e: Column) -> Column:
    """struct(code, label, points) of evidence; the label of another target year follows the year's."""
    names = F.create_map(*[F.lit(x) for pair in fixed.EVIDENCE_LABELS.items() for x in pair])
    year = F.when(F.startswith(e["code"], F.lit("year:")), F.concat(F.substring(e["code"], 6, 4), F.lit(" recruiting cycle")))
    label = F.coalesce(F.try_element_at(names, F.concat_ws(":", e["code"], e["points"].cast("string"))), F.try_element_at(names, e["code"]), year)
    return F.struct(e["code"].alias("code"), label.alias("label"), e["points"].alias("points"))


def _match(p: Callable[[str], Column], t: Column, target_year: int, least: int) -> Column:
    title, role_text, terms, skill_text, education_text = (t[name] for name in ("title", "role", "terms", "skills", "education"))
    no = lambda c: F.coalesce(c, F.lit(False))
    school = (title.rlike(fixed.HIGH_SCHOOL) & title.rlike(fixed.HIGH_SCHOOL_TITLE)) | (terms.rlike(fixed.HIGH_SCHOOL) & (~terms.rlike(fixed.HIGHER_EDUCATION) | terms.rlike(fixed.HIGH_SCHOOL_ONLY)))
    doctoral = terms.rlike(fixed.DOCTORAL_ONLY) | (title.rlike(fixed.DOCTORAL) & ~terms.rlike(fixed.BELOW_DOCTORAL))
    excluded = (
        F.when(~no(p("region") == "us"), "region:not-us").when(~no(F.arrays_overlap(p("program_keys"), F.array(F.lit("internship"), F.lit("coop")))), "program:not-internship")
        .when(title.rlike(fixed.RECRUITING_TITLE), "role:recruiting").when(school, "education:high-school-only").when(doctoral, "education:phd-only")
        .when(terms.rlike(fixed.CITIZENS), "authorization:citizen-only").when(terms.rlike(fixed.CLEARANCE), "authorization:active-clearance")
    )
    role = F.coalesce(_first_points(title, fixed.ROLES), F.when(~title.rlike(fixed.OTHER_TITLE), _first_points(role_text, fixed.ROLES)))
    skills, before = [], F.lit(0)
    for code, points, pattern in fixed.SKILLS:
        has = skill_text.rlike(pattern)
        own = F.when(has, F.least(F.lit(points), F.greatest(30 - before, F.lit(0)))).otherwise(0)
        skills.append(F.when(own > 0, F.struct(F.lit(code).alias("code"), own.alias("points"))))
        before = before + F.when(has, points).otherwise(0)
    more = lambda condition, code: F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(5).alias("points")))
    parts = [role, *skills, _first_points(role_text, fixed.DOMAINS), _first_points(education_text, fixed.EDUCATION)]
    parts += [more(no(F.array_contains(p("recruiting_years"), target_year)), f"year:{target_year}"), more(F.coalesce(p("published_at"), F.lit("")) != "", "freshness:published")]
    found = let(F.struct(excluded.alias("excluded"), F.array(*parts).alias("parts")), lambda x: F.struct(
        F.coalesce(x["excluded"], F.when(F.get(x["parts"], F.lit(0)).isNull(), "role:not-supported")).alias("excluded"), F.transform(F.array_compact(x["parts"]), _named).alias("evidence")))
    kept = let(found, lambda x: F.struct(x["excluded"].alias("excluded"), F.filter(x["evidence"], lambda _: x["excluded"].isNull()).alias("evidence")))
    summed = let(kept, lambda x: F.struct(x["excluded"].alias("excluded"), x["evidence"].alias("evidence"), F.least(F.lit(100), F.aggregate(x["evidence"], F.lit(0), lambda a, e: a + e["points"])).alias("score")))
    return let(summed, lambda x: F.struct(
        (x["excluded"].isNull() & (x["score"] >= least)).alias("eligible"), x["score"].alias("score"), x["evidence"].alias("evidence"),
        F.coalesce(x["excluded"], F.when(x["score"] < least, "score:below-threshold")).alias("exclusion")))
