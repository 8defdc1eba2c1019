"""Resampling, fill-in-middle and personal data against brute force, on odd tables and on sf0.001."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from oracle import connect, same

from postlake.llm import fill_middle, html_text, personal_data, resampling

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, Text string, row string, score string, id string, at string"
LONG = "word " * 30_000
ODD = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (None, "a b c d e f"), (None, None), (5, LONG), (6, " \t\n"), (7, "é 語 😀 <P> don't a@b.co")]


def docs(spark, rows):
    return spark.createDataFrame([(*r, *"vwxyz") for r in rows], SCHEMA)


# --- resampling


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def features_of(text):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_resample(rows, target):
    """{(doc_id, text): (n_features, weight, score)} and the drawn in order."""
    s, t = collections.Counter(), collections.Counter()
    for _, text in rows:
        s.update(features_of(text))
    for text in target:
        t.update(features_of(text))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    out, enough = {}, []
    for i, text in rows:
        f = features_of(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out[i, text] = len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        if len(words_of(text)) >= 20:
            enough.append((-out[i, text][2], i is None, i or 0))
    return out, sorted(enough)[: 5 * len(enough) // 100]


def test_resampling_of_a_table_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want, drawn = brute_resample(rows, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    text = dict(rows)
    out = resampling.op11_resampling(spark, SF).collect()
    assert len(out) == len(rows) and drawn
    assert all((r.n_features, r.weight, r.score) == want[r.doc_id, text[r.doc_id]] for r in out)
    assert [(-r.score, False, r.doc_id) for r in sorted((r for r in out if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, len(drawn) + 1))


def test_resampling_of_odd_rows(spark):
    rows = [*ODD, *[(i, "the Same twenty words " * 6 + "É" * (i % 3)) for i in range(10, 130)]]
    want, drawn = brute_resample(rows, ["same words", None])
    target = spark.createDataFrame([("same words", 1), (None, 2)], "text string, Text long")
    out = resampling.resample(docs(spark, rows), target).collect()
    assert sorted((str(r.doc_id), r.n_features, r.weight, r.score) for r in out) == sorted((str(i), *want[i, t]) for i, t in rows)
    assert [(-r.score, r.doc_id is None, r.doc_id or 0) for r in sorted((r for r in out if r["rank"]), key=lambda r: r["rank"])] == drawn
    kept = resampling.drawn(docs(spark, rows), target)
    assert kept.columns == docs(spark, rows).columns
    assert sorted((r[0], r[1], r[2]) for r in kept.collect()) == sorted((i, dict(rows)[i], "v") for _, _, i in drawn)
    assert resampling.resample(docs(spark, []), target).count() == 0
    assert resampling.resample(docs(spark, rows), target.limit(0)).count() == len(rows)


def test_resampling_ranks_across_many_parts(spark):
    """Ties of score, and one id that a third of all rows have: places add up over the parts of the sort."""
    rows = [(7 if i % 3 == 0 else i, "one two three four five " * 4) for i in range(3000)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = resampling.resample(docs(spark, rows), docs(spark, rows), percent=50).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    ranked = sorted((r for r in out if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 1501))
    assert [(-r.score, r.doc_id) for r in ranked] == sorted((-r.score, r.doc_id) for r in out)[:1500]


def test_run_buckets_of_random_bytes():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("aB1 .é語_\x00"), rng.integers(0, 60))) for _ in range(300)]
    n, offsets, found = resampling.run_buckets([t.encode() for t in texts], 10_000)
    for i, text in enumerate(texts):
        assert n[i] == len(words_of(text)) and found[offsets[i] : offsets[i + 1]].tolist() == features_of(text)


# --- fill-in-middle


def brute_fim(i, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(text), "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return len(text), *(("spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"))


def test_fill_in_middle_equals_its_sql(spark):
    same(fill_middle.op12_fill_in_middle(spark, SF), fill_middle.SQL, connect(SF))


def test_fill_in_middle_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    parts = ["a", "<", "P>", "<P", "S>", "M", ">", "é", "😀", "\n", "\x00", " "]
    rows = [*ODD, *[(i, "".join(rng.choice(parts, rng.integers(0, 40)))) for i in range(100, 700)]]
    out = collections.defaultdict(list)
    for r in fill_middle.fill_in_middle(docs(spark, rows)).collect():
        out[r.doc_id].append(r)
    assert sum(map(len, out.values())) == len(rows)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    seen = set()
    for i, text in rows:
        want = brute_fim(i, text)
        assert (*want, digest(want[4]), digest(text or "")) in [(r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.output_sha256, r.restored_sha256) for r in out[i]]
        seen.add(want[1])
    assert seen == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs(spark, [])).count() == 0


@pytest.mark.parametrize("unit, pattern", [("char", "(?s:.)"), ("line", r"[^\n]*\n|[^\n]+"), ("word", r"[^\s]*\s+|[^\s]+")])
def test_units_and_places(unit, pattern):
    """Every cut by rank falls where a split into units puts it, and each output gives its text back."""
    scan, rng = fill_middle.Scan(unit), np.random.default_rng(6)
    for case in range(200):
        text = "".join(rng.choice(["a", "bc", " ", "\n", "\t", "é", "😀", "<P", ">"], rng.integers(0, 30)))
        units = re.findall(pattern, text, re.A)
        places, ranks, found = scan.units(text)
        assert "".join(units) == text and ranks[-1] == len(units) and found == ("<P>" in text)
        assert [scan.place(places, ranks, k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]
        n, form, a, b, output = fill_middle.transform(scan, text, str(case))
        assert scan.restore(output, form) == text


# --- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def right(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def brute_base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if right(k, m[0])]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_base_matches_equal_the_patterns():
    finder, rng = personal_data.Finder(), np.random.default_rng(7)
    alphabets = [["a", "b", "@", ".", "-", "é", " ", "x.y", "@c.d"], ["1", "25", "256", ".", "..", " ", "0", "9.9.9.9"], list("0123456789") * 3 + [" ", "-", "  ", "+", "(", ")", "."], list("+0123456789 ().-") + ["4111111111111111", "+1 (555) 010-9999", "10.0.0.1", "q@w.er", "😀"]]
    n = collections.Counter()
    for case in range(6000):
        text = "".join(rng.choice(alphabets[case % 4], rng.integers(0, 60)))
        got = [(k, a, b) for k, a, b, base in finder.spans(text) if base]
        assert got == brute_base(text), text
        n.update(k for k, _, _ in got)
    assert min(n[k] for k in PATTERNS) > 50


def test_base_matches_of_a_table(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in personal_data.op13_personal_data(spark, SF).collect():
        want = brute_base(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in want) for kind in PATTERNS]
        assert set(joined(want).split(",")) <= set(r.spans.split(","))


ADDED = [
    ("write to jörg.müller@büro.example today", "email", "jörg.müller@büro.example"), ("mary [at] mail (dot) example.com.", "email", "mary [at] mail (dot) example.com"),
    ("joe at mail dot example dot org now", "email", "joe at mail dot example dot org"), ("see http://[2001:db8::7]/x", "ip", "2001:db8::7"), ("tel:030 1234567 or", "phone", "030 1234567"),
    ("IBAN: DE89 3704 0044 0532 0130 00 AND MORE", "account", "DE89 3704 0044 0532 0130 00"), ("his SSN 123-45-6789.", "account", "123-45-6789"), ("Account no. 0012 3456 78", "account", "0012 3456 78"),
    ("Passport: C01X00T47,", "account", "C01X00T47"), ("ftp://bob:secret@files.example.org/a", "login", "ftp://bob:secret@files.example.org"),
]
CLEAN = ["we met at noon and at the dot of five", "a handle @mary, a version 1.2.3", "IBAN DE89 3704 0044 0532 0130 01", "SSN 000-12-3456", "accounting 123456789", "http://example.org/a:b@c", "passport CONTROL", "the hotel: 12", "look at example.com", "10 000 000 people", "http://[x]/"]


def test_added_matches():
    finder = personal_data.Finder()
    for text, kind, value in ADDED:
        assert (kind, value) in [(k, text[a:b]) for k, a, b, base in finder.spans(text) if not base], text
    assert [finder.spans(t) for t in CLEAN] == [[]] * len(CLEAN)


def test_personal_data_of_odd_rows(spark):
    rows = [*ODD, (8, "a@b.co, +1 (555) 010-9999, 4111 1111 1111 1111 and 10.0.0.1 😀 x@y.zz"), (9, "a" * 200_000 + "@" + "1" * 200_000 + ".com"), (10, "1." * 100_000), (11, "+1" + " (" * 100_000)]
    out = personal_data.find(docs(spark, rows)).collect()
    assert len(out) == len(rows) and personal_data.find(docs(spark, [])).count() == 0
    for r, text in ((r, dict(rows)[r.doc_id]) for r in out if r.doc_id is not None):
        if r.doc_id < 9:
            assert joined(brute_base(text)) == ",".join(f"{x.kind}:{x.start}:{x.end}" for x in r.found if x.base)
        assert all(text[x.start : x.end] == x.value for x in r.found)
    # long runs, on which the patterns take time that grows with the square
    assert {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in out if r.doc_id is not None and r.doc_id > 8} == {9: (1, 0, 0, 0), 10: (0, 25_000, 0, 0), 11: (0, 0, 0, 0)}
    clean = personal_data.redact(docs(spark, rows))
    assert clean.columns == docs(spark, rows).columns
    texts = {r[0]: r[1] for r in clean.collect()}
    assert texts[8] == "<EMAIL>, <PHONE>, <CARD> and <IP> 😀 <EMAIL>" and texts[3] is None and texts[1] == "a b c d e f" and texts[9] == "<EMAIL>"


# --- main text of pages

SAY = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


def test_region_against_all_stretches():
    rng = np.random.default_rng(8)
    for _ in range(500):
        scores = [float(x) for x in rng.integers(-6, 5, rng.integers(0, 14))]
        start, stop = html_text.region(scores)
        best = max((sum(scores[a:b]) for a in range(len(scores)) for b in range(a, len(scores) + 1)), default=0.0)
        assert sum(scores[start:stop]) == max(best, 0.0)


def test_compound_names_go_by_their_head():
    weights = html_text.learn_weights()
    page = "<html><body><nav><a href='/'>Home</a></nav><article><p>" + SAY + " first.</p><{e} class='{c}'>Words in question.</{e}><p>" + SAY + " last.</p></article><footer>Foot</footer></body></html>"
    held = lambda e, c: "Words in question." in html_text.main_text(page.replace("{e}", e).replace("{c}", c), weights)
    for c in "share-price search-results login-story hidden-valley comment-text form-of-words alert-level tags-intro".split():
        assert held("p", c) and held("div", c), c
    for c in "cookie-notice adSlot post-comments related-posts newsletter-signup social-share sidebar_widget main-nav comment-list article-footer ad".split():
        assert not held("div", c), c


@pytest.mark.parametrize("links", ["<div>{}</div>", "<ul><li>{}</li></ul>"])
def test_a_long_list_of_links_parts_no_article(links):
    weights = html_text.learn_weights()
    joint = "</li><li>" if "li" in links else " "
    links = links.format(joint.join(f"<a href='/{i}'>Link {i}</a>" for i in range(60)))
    said = f"{SAY} {SAY}."
    assert html_text.main_text(f"<html><body><div>{said}</div>{links}<div>{SAY} {said}</div></body></html>", weights) == f"{said}\n{SAY} {said}"
    assert html_text.main_text(f"<html><body><div><a href='/a'>A</a></div>{links}<div>{said}</div>{links}<div>All rights reserved</div></body></html>", weights) == said


# --- the pipeline and the mix on odd tables


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls, repeats, empty and long texts, an id that many rows share, columns of clashing names, and empty tables."""
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long, row string, kept string, _text string, c0 string"
    said = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(30)]
    texts = [*[(i, t, "a" if i % 2 else None) for i, t in enumerate(said)], (None, said[0], "a"), (5, said[5], "a"), (40, None, "b"), (41, "", "b"), (42, " \n", None), (None, None, None), (43, "long " * 30_000, "c"), *[(50, f"{said[1]} tail{i}", "d") for i in range(20)]]
    rows = [(i, t, "en", s, len(t or ""), "r", "k", "t", "c") for i, t, s in texts]
    for name, table, labels in (("odd", rows, [(0, 1, 0), (1, 1, 0), (None, None, None)]), ("empty", [], [])):
        folder = tmp_path / name
        spark.createDataFrame(table, kind).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, str(folder)).collect()
        if not table:
            assert out == []
            continue
        held = {r.doc_id for r in out}
        assert held <= {i for i, t, _ in texts if t and t.strip()}
        assert sum(i in held for i in range(2, 30)) >= 20  # texts of their own stay, but where a mix leaves one out
        assert len({r.decoded for r in out if r.doc_id == 50}) <= 1  # one of a group of near copies
        docs_ = spark.read.parquet(f"{folder}/documents.parquet")
        now = docs_
        for stage, f in corpus_pipeline.STAGES[:-1]:
            now = f(spark, now, str(folder))
            assert now.columns == docs_.columns, stage


def test_mix_spreads_rows_that_share_an_id(spark):
    from postlake.llm import mixing

    rows = [(7, f"word{i} " * (1 + i % 3), "s" if i % 2 else "t") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = (sorted((r.size, r.taken) for r in mixing.mix(df).collect()) for _ in range(2))
    assert first == again and len(first) == 300
