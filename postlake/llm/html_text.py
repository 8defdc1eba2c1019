"""Main text of web pages as the maximum-scoring contiguous region.

A page is one sequence of tokens. Words score positive and tags negative, by
weights learned from labelled pages, in two steps. An element's weight is the log
odds that its words are main text, from its name and the words of its class and
id; it makes the words inside main, noise or neither. A word's weight is then the
log odds for its place, a tag's for its name. One linear scan finds the
contiguous region with the largest sum; it starts and ends with main text, and
what lies before and after it is gone by that alone. A list of links between two stretches counts against them by a bounded sum,
so a paragraph before a long list stays. Noise inside an article (a notice
or an advert) counts nothing in the scan, and negative words between kept ones are cut.
Blocks come in page order; blocks of an unmarked place that hold only links go, and
links among other words stay.

The tokenizer passes over a page once, whatever is left open in it: each quote of a
tag that never ends is looked at once.

Defined cases: null or empty html gives an empty text; markup that never closes
ends with the page, but a head ends at <body>, at the first words or at the
first element that may not stand in it, and a button, select or text field that never
closes hides nothing; long pages are read whole, one at a time; repeated rows each
give their text; columns of any other name are left out; every row gives one row, an
empty table none.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import light, pick, text_batches

# Element names by their part in a page.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
RAW = set("script style title textarea iframe noscript noframes noembed".split())
SKIPPED = set("template object svg math canvas select button audio video".split())
HEAD_PARTS = set("base basefont bgsound link meta frame noscript noframes script style template title".split())
SECTIONS = set("nav header footer aside form dialog menu article main section".split())
TRACKED = SECTIONS | set("div ul ol table p td li details figure span blockquote".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())

# Words at the end of a class that say how an element is laid out, not what it holds.
HOLDERS = set("area articles bar block box btn button buttons col column container icons inner item items left link links list mobile news outer panel posts right row section slot stories top trail unit wrap wrapper".split())

TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
MARK = re.compile("[>\"']")
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
HIDDEN = re.compile(r"""\shidden(?:[\s=>]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
NAME_WORD = re.compile(r"[a-z]+|[A-Z][a-z]+|[A-Z]+")
#: An element of at least this weight, for or against, decides about the words in it.
SURE = 1.0
#: As many plain words outweigh any list of links between them and the rest of the text.
LIST_WORDS = 12


def markup(page: str):
    """(kind, text) pieces of a page in order: 'text', 'tag' or 'raw', a raw element with its content. Comments are left out."""
    at, n, last = 0, len(page), page.rfind(">")
    low = None  # in lower case and of the same length, made when first needed
    dead: set[int] = set()  # quotes after which no tag ends
    open_: set[str] = set()  # raw elements that no longer close
    while at < n:
        start = page.find("<", at)
        if start < 0:
            yield "text", page[at:]
            return
        if start > at:
            yield "text", page[at:start]
        c = page[start + 1 : start + 2]
        if c == "!" or c == "?":
            close = "-->" if page.startswith("<!--", start) else "]]>" if page.startswith("<![CDATA[", start) else ">"
            end = page.find(close, start + 2)
            at = n if end < 0 else end + len(close)
            continue
        name = TAG.match(page, start)
        if not name:
            yield "text", "<"
            at = start + 1
            continue
        if start > last:  # no tag ends after this one
            return
        end, seen, here = -1, [], name.end()
        while True:
            m = MARK.search(page, here)
            if m is None:
                break
            if m[0] == ">":
                end = m.start() + 1
                break
            if m.start() in dead:
                break
            seen.append(m.start())
            here = page.find(m[0], m.end()) + 1
            if not here:
                break
        if end < 0:  # a quote is open to the end of the page: the tag ends at its first >
            dead.update(seen)
            end = page.find(">", start) + 1
        tag = page[start:end]
        word = name[1].lower()
        if word in RAW and tag[1] != "/" and not tag.endswith("/>"):
            low = low or re.sub("[A-Z]+", lambda x: x[0].lower(), page)
            close = -1 if word in open_ else low.find(f"</{word}", end)
            if close < 0:
                open_.add(word)
            if close >= 0 or word in ("script", "style"):
                stop = page.find(">", close) + 1 if close >= 0 else 0
                at = stop or n
                yield "raw", tag
                continue
        yield "tag", tag
        at = end


def names_of(tag: str) -> set[tuple[str, ...]]:
    """The words of each class, id and role: those before its head, then the head, its last word that says what the element holds."""
    out = set()
    for _, value in NAMED.findall(tag) if "=" in tag else ():
        for name in value.strip("\"'").split():
            words = [w.lower() for w in NAME_WORD.findall(name)]
            while len(words) > 1 and words[-1] in HOLDERS:
                words.pop()
            if words:
                out.add(tuple(words))
    return out


def element_features(name: str, tag: str, in_article: bool) -> list[tuple[str, ...]]:
    """What an element is known by, each beside the words that qualify it; a header inside an article is another thing than a page's."""
    inner = "article " if in_article else ""
    named = [(f"{inner}.{w[-1]}" if w[-1] == "header" else f".{w[-1]}", *(f".{x}" for x in w[:-1])) for w in sorted(names_of(tag))]
    return [(f"{inner}<{name}>",)] * (name in SECTIONS) + named


def element_weight(weights: dict[str, float], name: str, tag: str, in_article: bool) -> float:
    """The strongest features decide: an article of class advert is an advert, a div of class post-content is content.

    A compound name goes by its head: post-comments holds comments, and share-price no sharing. A head for the text under a word against it, as
    in comment-text, decides nothing.
    """
    if HIDDEN.search(tag):
        return -math.inf
    known = []
    for head, *before in element_features(name, tag, in_article):
        weight = weights.get(head, 0.0)
        known.append(0.0 if weight > 0 and any(weights.get(b, 0.0) <= -SURE for b in before) else weight)
    against, for_ = min(known, default=0.0), max(known, default=0.0)
    return against if against <= -SURE else for_


def place(around: str, weight: float) -> str:
    """The place of words in an element: main, plain, noise, or cut for noise inside a main container."""
    if around in ("noise", "cut") or -SURE < weight < SURE:
        return around
    return "main" if weight > 0 else "cut" if around == "main" else "noise"


def walk(page: str):
    """(kind, value, stack) events: 'tag', 'raw' and 'text', with the open elements as a list of (name, tag, in_article).

    Text that is never shown is left out. The stack is the walker's own and changes with the next event.
    """
    stack: list[tuple[str, str, bool]] = []
    head, hidden, closes = False, None, None
    for kind, t in markup(page):
        if kind == "text":
            if hidden is None and (not head or t.strip()):
                head = False
                yield "text", t, stack
            continue
        name, shut = TAG.match(t)[1].lower(), t[1] == "/"
        if hidden is not None:
            inside_text = hidden in ("button", "select") and not shut and name in BLOCKS and name not in ("option", "hr")
            if not inside_text:
                hidden = None if shut and name == hidden else hidden
                continue
            hidden = None  # no block stands in a button: it was left open
        if name == "head":
            head = not shut
        elif head:  # its close may be left out: it ends at the first element that may not stand in it
            if name not in HEAD_PARTS and not (shut and name not in ("body", "html", "br")):
                head = False
        if name in SKIPPED and not shut and not t.endswith("/>"):
            if closes is None:
                low = page.lower()
                closes = {x: low.rfind(f"</{x}") >= 0 for x in SKIPPED}
            hidden = name if closes[name] else None
            yield "raw", t, stack
            continue
        if head:
            continue
        yield "raw" if kind == "raw" else "tag", t, stack
        if kind == "raw" or name not in TRACKED:
            continue
        if shut:
            at = next((i for i in range(len(stack) - 1, max(-1, len(stack) - 500), -1) if stack[i][0] == name), None)
            if at is not None:
                del stack[at:]
        elif not t.endswith("/>"):
            if name in ("p", "li", "td") and stack and stack[-1][0] == name:
                stack.pop()
            in_article = bool(stack) and stack[-1][2]
            stack.append((name, t, in_article or name in ("article", "main")))


def tokens(page: str, weights: dict[str, float]) -> list[tuple[str, str]]:
    """(kind, value): ('tag', name), ('block', '') at block borders, ('space', ' '), or (place of the words, text).

    Noise inside a main container comes as ('cut', text), and its tags not at all: it says nothing about the region.
    """
    out: list[tuple[str, str]] = []
    places: list[str] = []
    link = 0
    for kind, t, stack in walk(page):
        while len(places) > len(stack):
            places.pop()
        for name, tag, _ in stack[len(places) :]:
            in_article = bool(places) and stack[len(places) - 1][2]
            places.append(place(places[-1] if places else "plain", element_weight(weights, name, tag, in_article)))
        here = places[-1] if places else "plain"
        if kind == "text":
            out.append(("cut", t) if here == "cut" else (f"word:{here}" + (":link" if link else ""), t))
            continue
        name, shut = TAG.match(t)[1].lower(), t[1] == "/"
        if name == "a":
            link = 0 if shut else 1
        if kind == "tag":
            if name in BLOCKS:
                out.append(("block", ""))
            elif name == "br":
                out.append(("space", " "))
        if here != "cut":
            out.append(("tag", name))
        if shut and name in TRACKED and places and stack and stack[-1][0] == name:
            places.pop()  # the walker closes it after this event
    return out


# Labelled pages: markup with its main text between the marks [[ and ]].
WRITTEN = [
    '<html><head><title>T</title></head><body><nav><ul><li><a href="/a">Home page</a></li><li><a href="/b">All news</a></li></ul></nav><div class="ad">Buy now and save.</div><article>[[<h1>A day at the lake</h1><p><b>The water was calm that morning.<br><p>We rowed out early and came back late with a few small fish for dinner.</p><p>Nobody spoke much on the way home, and the night was warm.</p>]]</article><footer>&copy; lake.example &middot; some words below.</footer></body></html>',
    '<html><body><header><a href="/">Site name</a> your daily source</header><main>[[<h1>Growing beans</h1><p>Plant the seeds in spring when the soil is warm enough.</p><ul><li>Water them each evening.</li><li>Pick them young.</li></ul><p>Old beans are tough and dry.</p>]]</main><aside><h3>Related</h3><ul><li><a href="/x">Peas and you</a></li></ul></aside><footer>All rights reserved</footer></body></html>',
    '<html><body><div id="menu"><a href="/1">One</a> <a href="/2">Two</a></div><div class="cookie-notice">We use cookies on this site.</div><div class="post-content">[[<h2>Old bridges</h2><p>Stone bridges last for many centuries if floods spare them.</p><blockquote>No arch ever sleeps, the builders said.</blockquote><p>They were right about that.</p>]]</div><div class="comments"><p>I like this one very much, thank you.</p><p>Me too, great post.</p></div><form><label>Name</label><input></form></body></html>',
    '<html><body><div><a href="/">Start</a> | <a href="/c">Contact</a></div><div>[[<p>The train left on time and the carriage was full of people going to the market.</p><p>At noon it stopped in the fields for an hour.</p><p>Then it went on as if nothing had happened at all.</p>]]</div><div><a href="/p">Privacy</a> <a href="/i">Imprint</a></div></body></html>',
    '<html><body><nav><a href="/">Top</a></nav><article><header>[[<h1>Night sky</h1>]]</header>[[<p>Venus is bright this month and stands low in the west.</p><div class="ad">Telescopes for less.</div><p>Look for it soon after sunset with the naked eye.</p>]]</article><section class="comments"><p>I saw it last night from my roof.</p></section><footer>Contact us</footer></body></html>',
    '<html><body><div class="sidebar"><h3>Archive</h3><ul><li><a href="/jan">January</a></li><li><a href="/feb">February</a></li></ul></div><div class="entry">[[<h1>Bread without haste</h1><p>Mix flour, water and salt, and wait a whole day.</p><pre>bake for one hour</pre><p>Let it cool before you cut it.</p>]]</div><div class="newsletter"><p>Sign up for our weekly letter today.</p><form><input><button>Send</button></form></div></body></html>',
]


# Names that pages give to what is not their text, and to their text.
AROUND = "ad ads advert adverts advertisement adbox banner promo promotion sponsor sponsored cookie cookies consent notice alert popup modal overlay sidebar widget menu nav navbar navigation breadcrumb breadcrumbs topbar toolbar header masthead footer comment comments reply replies respond discussion disqus share sharing social related recommended newsletter subscribe signup login search form pager pagination tags copyright skip hidden".split()
WITHIN = "article content entry post main story body text".split()


def made_up_pages() -> list[str]:
    """Labelled pages by rule: one for each name, with its element beside the text or around it."""
    say = "the rain fell on the roofs and the river rose by the hour ."
    out = [f'<html><body><div class="{w}">read this too now please</div><div class="content">[[<p>{say}</p>]]<div class="{w}">read this as well today</div>[[<p>{say}</p>]]</div><div id="{w}">one more thing here</div></body></html>' for w in AROUND]
    out += [f"<html><body><{w}>read this too now please</{w}><article>[[<p>{say}</p>]]<{w}>read this as well today</{w}>[[<p>{say}</p>]]</article></body></html>" for w in ("nav", "footer", "aside", "form", "dialog", "menu")]
    out += [f'<html><body><div><a href="/">Start here</a></div><div class="{w}">[[<p>{say}</p><p>{say}</p>]]</div><div><a href="/c">Contact us</a></div></body></html>' for w in WITHIN]
    out += [f"<html><body><{w}><section>[[<p>{say}</p>]]</section><section>[[<p>{say}</p>]]</section></{w}></body></html>" for w in ("main", "article")]
    out += [f"<html><body><nav>read this too</nav><section>[[<p>{say}</p>]]</section><section>[[<p>{say}</p>]]</section></body></html>"]
    return out


LABELLED = WRITTEN + made_up_pages()


def _marked(events, depth: bool = False):
    """(words inside the marks, words outside) of each text, with its event."""
    for event in events:
        inside = outside = 0
        for part in re.split(r"(\[\[|\]\])", event[1]) if "[" in event[1] or "]" in event[1] else [event[1]]:
            if part in ("[[", "]]"):
                depth = part == "[["
            elif depth:
                inside += len(part.split())
            else:
                outside += len(part.split())
        yield event, inside, outside, depth


def _odds(inside: Counter, outside: Counter) -> dict[str, float]:
    return {f: math.log((inside[f] + 0.5) / (outside[f] + 0.5)) for f in inside | outside}


def learn_weights(pages: list[str] = LABELLED) -> dict[str, float]:
    """Weights of elements, then of words by place and of tags: log odds of standing inside the marked text."""
    inside, outside = Counter(), Counter()
    for page in pages:
        for (kind, _, stack), yes, no, _ in _marked(walk(page)):
            if kind == "text":
                # the innermost element with features answers for its words
                open_ = [f for f in (element_features(x, tag, i > 0 and stack[i - 1][2]) for i, (x, tag, _) in enumerate(stack)) if f]
                for f in {head for head, *_ in open_[-1]} if open_ else ():
                    inside[f] += yes
                    outside[f] += no
    weights = _odds(inside, outside)
    inside, outside = Counter(), Counter()
    for page in pages:
        for (kind, text), yes, no, depth in _marked(tokens(page, weights)):
            if kind == "tag":
                (inside if depth else outside)[f"tag:{text}"] += 1
            elif kind.startswith("word:"):
                inside[kind] += yes
                outside[kind] += no
    # words for the region, tags against it: a tag never speaks for a region, and a word of unmarked place does
    return weights | {f: min(w, -0.1) if f.startswith("tag:") else w for f, w in _odds(inside, outside).items()}


def region(scores: list[float]) -> tuple[int, int]:
    """The contiguous stretch with the largest sum, by one linear scan; (0, 0) if no score is positive."""
    best, best_at, run, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, best_at = run, (start, i + 1)
    return best_at


def in_sentences(found: list[tuple]) -> list[bool]:
    """For each token whether it is link words of a block that has as many words outside links."""
    out, start = [False] * len(found), 0
    for stop in [*(i for i, (kind, _) in enumerate(found) if kind == "block"), len(found)]:
        linked, n_linked, n_own = [], 0, 0
        for i in range(start, stop):
            kind, text = found[i]
            if kind in ("word:main:link", "word:plain:link"):
                linked.append(i)
                n_linked += len(text.split())
            elif kind in ("word:main", "word:plain"):
                n_own += sum(any(map(str.isalnum, w)) for w in text.split())
        if n_own >= n_linked:
            for i in linked:
                out[i] = True
        start = stop + 1
    return out


def bound_lists(scores: list[float], found: list[tuple], most: float) -> None:
    """Let a run of blocks of unmarked places that hold links alone count against a region by ``most`` at most, however long it is."""
    start, run = 0, 0.0
    for stop in [*(i for i, (kind, _) in enumerate(found) if kind == "block"), len(found)]:
        if any(kind.startswith("word:") and kind != "word:plain:link" and any(map(str.isalnum, text)) for kind, text in found[start:stop]):
            run = 0.0
        else:
            total = sum(scores[start:stop])
            if run + total < -most:
                scores[start:stop] = [0.0] * (stop - start)
                scores[start] = -most - run
                total = -most - run
            run = min(0.0, run + total)
        start = stop + 1


def main_text(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    found = tokens(page, weights)
    plain = weights.get("word:plain", 0.5)
    worth = []
    for (kind, text), spoken in zip(found, in_sentences(found)):
        each = weights.get(f"tag:{text}", -0.1) if kind == "tag" else weights.get(kind, plain) if kind.startswith("word:") else 0.0
        worth.append(max(each, 0.0) if spoken else each)
    scores = [w * len(text.split()) if kind.startswith("word:") else w for w, (kind, text) in zip(worth, found)]
    bound_lists(scores, found, LIST_WORDS * plain)
    start, stop = region(scores)
    if start < stop:  # whole lines: a link may open or end one
        while start and found[start - 1][0] not in ("block", "space"):
            start -= 1
        while stop < len(found) and found[stop][0] not in ("block", "space"):
            stop += 1
    kept = [i for i in range(start, stop) if found[i][0].startswith("word:") and worth[i] >= 0 and found[i][1].strip()]
    first, last = (kept[0], kept[-1]) if kept else (start, start)
    blocks, now, links, spoken = [], [], 0, False
    for i in [*range(start, stop), -1]:
        kind, text = found[i] if i >= 0 else ("block", "")
        if kind == "block":
            # links alone are no text of an unmarked place, and neither are the signs between them
            blocks.append([t for t, plain_link in now if spoken or not plain_link] if spoken or not links else [])
            now, links, spoken = [], 0, False
        elif kind == "space":
            now.append((text, False))
        elif kind == "word:plain:link":
            now.append((text, weights.get(kind, plain) <= 0))
            links += now[-1][1] and bool(text.strip())
            spoken = spoken or not now[-1][1]
        elif kind.startswith("word:") and (worth[i] > 0 or kind == "word:main:link" or not first <= i <= last):
            now.append((text, False))
            spoken = spoken or any(map(str.isalnum, text))
    done = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(b for b in done if b)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: list[str] | None = None) -> DataFrame:
    """One row per row of pages: id_col, url_col, text, n_chars (code points)."""
    weights = learn_weights(labelled or LABELLED)
    narrow = text_batches(pick(pages, id_col, url_col, html_col).toDF("id", "url", "html"))
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema.fields}

    def run(batches):
        for batch in light(batches):
            texts = [main_text(h.as_py(), weights) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    out = narrow.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})


def op10_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
