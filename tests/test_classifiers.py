"""The posting classifiers on small postings of our own wording, nulls and empty texts among them."""

import pytest
from pyspark.sql import functions as F

from postlake.functions import classifiers as C

FIELDS = ("title", "department", "team", "businessUnit", "jobFamily", "jobFunction")


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.select("i", column.alias("v")).orderBy("i").select("v").collect()]


@pytest.mark.parametrize("title, internship, coop", [
    ("Harbour Pilot Intern", "intern", None), ("Interns for the Lighthouse Desk", "intern", None), ("Externship at the Map Room", "externship", None), ("Working Student, Tide Tables", "working student", None),
    ("Student Researcher (Fog)", "student worker", None), ("Industrial Trainee - Ropes", "student trainee", None), ("Summer Trainee - Ropes", "student trainee", None), ("Placement Year: Cartography", "placement", None), ("Werkstudentin Seekarten", "werkstudent", None),
    ("Praktikantin Wetterdienst", "praktikum", None), ("Stagiaire cartographe", "stagiaire", None), ("Estagiária de Marés", "estagio", None), ("Becaria de archivo", "practicante", None), ("Stagista archivio", "tirocinio", None), ("Stażystka w porcie", "staz", None),
    ("Stajyer", "stajyer", None), ("Стажер", "стажер", None), ("实习", "实习", None), ("Stage - Cartographie", "stage (FR/NL)", None), ("Stage Lighting Hand", None, None), ("Stage Crew", None, None), ("Late - Stage Ventures", None, None),
    ("Anchor Design Co - op", None, "co-op"), ("Anchor Design CO OP", None, "co-op"), ("Coop, Sails", None, "co-op"), ("Co-operative Education: Sails", None, "cooperative education"), ("Work Term Student", None, "work term"),
    ("Internal Post Clerk", None, None), ("Internist", None, None), ("Coordinator, Intern Recruiting", None, None), ("Radiology Externship", None, None), (" ", None, None), (None, None, None),
])
def test_programs(spark, title, internship, coop):
    got = values(spark, [(title,)], "t string", C.programs(F.col("t")))[0]
    assert (got.internship, got.coop) == (internship and f"title:{internship}", coop and f"title:{coop}")


@pytest.mark.parametrize("text, kind", [
    ("full time", "Full-time"), ("Fulltime (nights)", "Full-time"), ("part-time; SEASONAL", "Part-time / Seasonal"), ("Apprentice,apprenticeship", "Apprenticeship"), ("Casual, Co Op", "Co-op"), ('["Freelance", "Full_Time", "freelance"]', "Freelance / Full-time"),
    ("cooperative work term", "Co-op"), ("Fixed-Term until May", "Fixed-term"), ("Internship Program", "Internship"), ("REQ-00417", None), ("Lisbon", None), ('["unclosed', None), ("[]", None), ("  ", None), (None, None),
])
def test_employment_type(spark, text, kind):
    assert values(spark, [(text,)], "t string", C.employment_type(F.col("t"))) == [kind]


def test_bullets_and_effective_program(spark):
    got = values(spark, [(["JR_99120", "Tide Desk", "Part time"],), (["Spotlight Job", ""],), (None,)], "b array<string>", C.bullet_fields(F.col("b")))
    assert [tuple(g) for g in got] == [("Part-time", "Tide Desk"), (None, None), (None, None)]
    rows = [("Seasonal", "title:intern", "title:work term"), ("Co-op", None, None), ("Seasonal / Internship", None, None), (None, "title:staz", None), ("Casual", None, None), (None, None, None)]
    got = values(spark, rows, "k string, i2 string, c string", C.effective_program(F.col("k"), F.col("i2"), F.col("c")))
    assert [(g.employment_type, g["keys"]) for g in got] == [("Co-op", ["coop"]), ("Co-op", ["coop"]), ("Seasonal / Internship", ["internship"]), ("Internship", ["internship"]), ("Casual", []), (None, [])]


def test_recruiting_years(spark):
    rows = [
        ("Rope Intern 2031", "those graduating Winter 2033", "Salem, OR", None, ["internship"]), ("Rope Maker", None, "Salem, OR", "2030-09-01", []), ("Rope Intern", "Apply for Autumn 2030, our 2030 co-op, or start interning", None, None, []),
        ("Rope Intern", None, "Salem, OR", "2030-09-01", ["internship"]), ("Rope Intern", "", "Salem, OR 97301", "2030-02-01", ["coop"]), ("Rope Intern 52031", "graduation in Summer 2032", "Porto", "2030-02-01", ["coop"]), (None, None, None, "later", None),
    ]
    years = C.recruiting_years(F.col("t"), F.col("b"), C.in_united_states(F.lit(None).cast("string"), F.col("l")), F.col("p"), F.col("k"))
    got = values(spark, rows, "t string, b string, l string, p string, k array<string>", years)
    assert [[(y.year, y.evidence.split(":")[0]) for y in g] for g in got] == [[(2031, "title"), (2033, "body")], [], [(2030, "body")], [(2031, "inferred")], [(2030, "inferred")], [], []]


def test_region(spark):
    us = ["Salem, OR", "Bangor, Maine", "Juneau, AK, United States", "Old Town, ME, 04468 USA"]
    other = ["Porto, Portugal", "Hobart, Australia", "Gander, Newfoundland and Labrador", "Moncton, NB", "Whitehorse, YT Y1A 1A1", "Osaka, Japan"]
    unknown = ["Worldwide?", "Remote", "Multiple Locations", "3 locations", "OR", " ", None]
    rows = [(t, None, None, None, None) for t in us + other + unknown] + [("Remote", None, None, c, None) for c in ("usa", "U.S.", "Iceland")]
    rows += [("Remote", "Bangor", "ME", None, None), ("Salem, OR", None, None, None, ["Porto, Portugal"]), ("Remote", None, None, None, ["Osaka, Japan"])]
    cols = [F.col(c) for c in ("l", "c", "s", "n", "o")]
    got = values(spark, rows, "l string, c string, s string, n string, o array<string>", C.region(*cols))
    assert got == ["us"] * 4 + ["non_us"] * 6 + ["unknown"] * 7 + ["us", "us", "non_us", "us", "mixed", "non_us"]


def test_ai_data_topic(spark):
    rows = [
        ("Deep Learning for Tides", None, [], None), ("Decision Scientist, Ports", None, None, None), ("Chart Editor", "BI", ["Hugging Face"], None), ("Harbour Clerk", None, [], "Statistical modeling of berths; data pipelines; model training."),
        ("Harbour Clerk", None, [], "Data science and computer vision at the quay."), ("Harbour Clerk", None, [], "You may ask an AI to draft letters."), ("Mail Room", None, ["Sailing"], "We said so in the main hall."), (None, None, None, None),
    ]
    none = F.lit(None).cast("string")
    fields = {"title": F.col("t"), "department": none, "team": F.col("m"), "businessUnit": none, "jobFamily": none, "jobFunction": none}
    got = values(spark, rows, "t string, m string, s array<string>, b string", C.ai_data_topic(fields, F.col("s"), [F.col("b")]))
    assert [g.matched for g in got] == [True] * 5 + [False] * 3
    assert got[2].evidence == ["skill:hugging face", "team:bi"] and got[2].score == 8 and [g.score for g in got[3:6]] == [3, 4, 1]


def test_areas(spark):
    rows = [
        ("Computer Vision and Mobile Engineers", None), ("Statistician, Tides", None), ("Decision Science for Ports", None), ("Front-end Developer, Charts", None), ("Android Engineer", None),
        ("Clerk", "Tracks include ropes, informatics, and NLP."), ("Clerk", "Tracks include recruiting with AI."), ("Clerk", "NLP is dear to us."), (None, ""),
    ]
    none = F.lit(None).cast("string")
    got = values(spark, rows, "t string, b string", C.areas({f: F.col("t") if f == "title" else none for f in FIELDS}, F.lit(None).cast("array<string>"), [F.col("b")]))
    assert [[a.area for a in g] for g in got] == [["ai-ml", "software-engineering"]] + [["data-analytics"]] * 2 + [["software-engineering"]] * 2 + [["ai-ml", "data-analytics"], [], [], []]
    assert got[5][0].score == 2 and got[5][1].evidence == ["body-track:informatics"]


def test_resume_match(spark):
    base = dict(title="Deep Learning Trainee", region="us", keys=["coop"], skills=["pandas", "etl"], years=[2027], pub="2030-01-02", qual=None)
    cases = [{}, dict(title="Knowledge Graph Trainee", skills=["pandas", "RAG"]), dict(title="Data Platform Trainee"), dict(title="Backend Developer", skills=["TypeScript"]), dict(title="KYC Fraud Trainee"), dict(title="Rope Maker"),
             dict(title="Deep Learning Recruiter"), dict(region="unknown"), dict(keys=["regular"]), dict(title="Doctoral Deep Learning Trainee"), dict(title="High School Deep Learning Interns"), dict(qual="U.S. citizenship is required"),
             dict(qual="top secret clearance required"), dict(title=None, region=None, keys=None, skills=None, years=None, pub=None)]
    rows = [tuple((base | c)[k] for k in base) for c in cases]
    named = {"title": "title", "region": "region", "program_keys": "keys", "skills": "skills", "recruiting_years": "years", "published_at": "pub", "qualifications": "qual"}
    got = values(spark, rows, "title string, region string, keys array<string>, skills array<string>, years array<int>, pub string, qual string", C.resume_match(lambda n: F.col(named[n]) if n in named else F.lit(None).cast("string")))
    assert [g.eligible for g in got] == [True] * 5 + [False] * 9, got
    assert [(e.code, e.label) for e in got[1].evidence][0] == ("role:llm-nlp", "LLM, NLP, RAG, or knowledge systems") and got[2].evidence[0].code == "role:data-engineering"
    assert ("role:data-analytics", "Risk or fraud analytics role") in [(e.code, e.label) for e in got[4].evidence] and "domain:aml-risk" in [e.code for e in got[4].evidence]
    assert [g.exclusion for g in got[5:13]] == ["role:not-supported", "role:recruiting", "region:not-us", "program:not-internship", "education:phd-only", "education:high-school-only", "authorization:citizen-only", "authorization:active-clearance"]
    assert got[0].score == 35 + 20 + 5 + 5 and all(e.label for g in got for e in g.evidence)
