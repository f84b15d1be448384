"""Operators 1, 2, 3, 4, 8, 9 and 10 against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cindermill.llm import audio, bpe, decontaminate, html_text, licences, quality, queries, toxicity

ODD = [None, "", " ", "a", "x" * 200_000, "A B\tC\n" * 5000, "ünï 日本語 😀 <|endoftext|> it's 3²", "dup", "dup"]


def odd_docs(spark, extra=True):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (7, "dup")], "doc_id long, text string")
    return df.withColumns({"score": F.lit("s"), "n_words": F.lit("w"), "n_tokens": F.lit(1), "media": F.lit("m"), "feature": F.lit(0), "hash": F.lit(0)}) if extra else df


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(queries.queries()[name], queries.oracle_sql()[name])


# --- 1 ---------------------------------------------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="sidebar"><p>Popular things to read now</p></div>{before}<p>First <b>bo</b>ld &amp; long enough text &eacute;, with words to weigh.</p><p>Second
  paragraph<br>after a break, also with words.</p><form><input value=x><button>Send</button>label</form>{after}
<div id="comments"><p>Reader says hello, a comment of some length to compete with.</p></div><footer>&copy; 2024</footer></body></html>"""
TEXT = "First bold & long enough text é, with words to weigh. Second paragraph after a break, also with words."


@pytest.mark.parametrize("around", [("<article>", "</article>"), ("<main>", "</main>"), ("<div class=story>", "</div>"), ("<div><section>", "</section></div>"), ("", "")])
def test_main_text(around):
    assert html_text.main_text(PAGE.format(before=around[0], after=around[1])) == TEXT


@pytest.mark.parametrize(
    ("source", "want"),
    [(None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a b"), ("<p title='a>b'>q</p>", "q"), ("<p>un<i>clos</p>ed", "unclos ed"), ("<!-- <p>x</p> -->", ""), ("<script>x", ""), ("a < b", "a < b"), ("<p>&#65;&lt;</p>", "A<"), ("</div></p>x", "x")],
)
def test_odd_pages(source, want):
    assert html_text.main_text(source) == want


def test_deep_and_long_pages_end():
    assert html_text.main_text("<div>" * 20_000 + "x") == "x"
    assert html_text.main_text("<a href='" * 3000) == ""
    assert len(html_text.main_text("<p>" + "word " * 200_000)) == 999_999


STORY = [[f"<p>{f'{part} paragraph {i} ' + 'of the story ' * 14}</p>" for i in range(10)] for part in ("first", "second")]
FIRST, SECOND = (" ".join(re.sub("<.*?>", " ", "".join(part)).split()) for part in STORY)


@pytest.mark.parametrize("tags", [("<div>", "</div>"), ("<section>", "</section>"), ("<article>", "</article>"), ("<div><div>", "</div></div>")])
def test_story_in_sibling_sections(tags):
    """All parts as dense as the threshold are kept, in page order; a list of links between them is not."""
    links = "<ul>" + "<li><a href=/x>Other story</a></li>" * 20 + "</ul>"
    page = "<html><body>" + links.join(tags[0] + "".join(part) + tags[1] for part in STORY) + "</body></html>"
    assert html_text.main_text(page) == f"{FIRST} {SECOND}"
    assert html_text.main_text(page.replace(links, "")) == f"{FIRST} {SECOND}"
    small = page.replace("".join(STORY[1]), STORY[1][0])
    assert html_text.main_text(small) == f"{FIRST} {' '.join(re.sub('<.*?>', ' ', STORY[1][0]).split())}"


def test_marked_paragraph_stays_whole():
    """The text around a dense inline part goes with it."""
    odd = "<p>" + "around " * 200 + "<b>in <i>aaaaaaaa</i> <i>bbbbbbbb</i></b> and after.</p>"
    page = "<html><body><div>" + "".join(STORY[0]) + "</div><div>" + odd + "</div></body></html>"
    assert html_text.main_text(page) == f"{FIRST} {'around ' * 200}in aaaaaaaa bbbbbbbb and after."


def test_tag_names_decide_nothing():
    """Density alone decides: the article tag neither widens nor narrows the choice."""
    for tag in ("article", "div", "section", "main"):
        page = f"<html><body><{tag}>" + "".join(STORY[0]) + f"</{tag}><div>" + "".join(STORY[1][:3]) + "</div><div>" + "<p>x <a href=/y>more</a></p>" * 12 + "</div></body></html>"
        assert html_text.main_text(page) == f"{FIRST} {' '.join(re.sub('<.*?>', ' ', ''.join(STORY[1][:3])).split())}"


BLOCK_TAGS, INLINE_TAGS = ["div", "section", "ul", "p"], ["b", "a", "i"]


def random_tree(rng, depth=0):
    """[tag, children]; a child is a text or a tree. Paragraphs and inline tags hold no blocks."""
    tag = "body" if depth == 0 else rng.choice(["div", "section", "article", "p", "nav"])
    inline = lambda d=0: [rng.choice(INLINE_TAGS), [inline(1) if d == 0 and rng.random() < 0.3 else "w" * rng.randint(1, 30)]]
    if tag == "p" or depth > 3:
        return ["p", [inline() if rng.random() < 0.4 else "t" * rng.randint(0, 120) for _ in range(rng.randint(1, 4))]]
    return [tag, [random_tree(rng, depth + 1) for _ in range(rng.randint(1, 4))]]


def show_tree(t):
    return t if isinstance(t, str) else f"<{t[0]}>{''.join(map(show_tree, t[1]))}</{t[0]}>"


def chosen_by_hand(root):
    """The definition of the choice, node by node and recursively, over the node paths of a tree."""
    import math

    nodes = {}
    collect = lambda t, path: (nodes.update({path: t}), [collect(c, (*path, i)) for i, c in enumerate(t[1]) if not isinstance(c, str)])
    collect(root, ())
    below = lambda p: [q for q in nodes if q[: len(p)] == p]
    is_cut = lambda p: any(nodes[p[:k]][0] == "nav" for k in range(len(p) + 1))
    in_link = lambda p: any(nodes[p[:k]][0] == "a" for k in range(len(p) + 1))

    def measure(gone):
        chars = lambda p, link: sum(len(c) for q in below(p) if not gone(q) and (in_link(q) or not link) for c in nodes[q][1] if isinstance(c, str))
        share = chars((), True) / max(chars((), False), 1)
        density, plain = {}, {}
        for p in nodes:
            kids = [q for q in below(p) if q != p and not gone(q)]
            c, lc = chars(p, False), chars(p, True)
            t, lt = max(len(kids), 1), max(sum(nodes[q][0] == "a" for q in kids), 1)
            density[p] = plain[p] = 0.0
            if c and not gone(p):
                plain[p] = (c - lc) / t
                base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
                density[p] = c / t * max(math.log(c / max(lc, 1) * t / lt) / max(math.log(base), 1.0), 1e-6)
        return density, plain, chars

    density, plain, chars = measure(is_cut)
    around, plain_around, _ = measure(lambda p: False)
    has_blocks = {p: any(q != p and not is_cut(q) and nodes[q][0] not in INLINE_TAGS and chars(q, False) for q in below(p)) for p in nodes}
    total = {p: sum(density[q] for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p) if has_blocks[p] else density[p] for p in nodes}
    order = list(nodes)
    live = [p for p in order if density[p] > 0]
    whole = [p for p in live if p == () or has_blocks[p[:-1]]]
    if not live:
        return []
    best = max(whole, key=lambda p: (total[p], -order.index(p)))
    path = [best[:k] for k in range(len(best) + 1)]
    floor = min(min(density[p], around[p]) for p in path)
    plain_floor = min(min(plain[p], plain_around[p]) for p in path)
    dense = lambda p: density[p] >= floor or plain[p] >= plain_floor > 0
    marked = set()

    def walk(p):
        if any(p[:k] in marked for k in range(len(p) + 1)) or not dense(p):
            return
        marked.add(max((q for q in whole if q[: len(p)] == p), key=lambda q: (total[q], -order.index(q))) if p in whole else p)
        for q in live:
            if len(q) == len(p) + 1 and q[: len(p)] == p:
                walk(q)

    walk(())
    return [order.index(p) for p in live if any(p[:k] in marked for k in range(len(p) + 1))]


def test_choice_equals_brute_force_on_random_trees():
    rng = random.Random(21)
    kept = 0
    for _ in range(400):
        tree = random_tree(rng)
        page = html_text.parse(show_tree(tree))
        assert page.names[1] == "body"
        inside = set()
        for i in html_text.choose(page):
            inside.add(i)
        for i in range(1, len(page.names)):
            if page.parents[i] in inside and not page.cut[i]:
                inside.add(i)
        own = html_text.Measures(page, page.cut)
        got = sorted(i - 1 for i in inside if own.density[i] > 0 and i)
        assert got == chosen_by_hand(tree), show_tree(tree)
        kept += 0 < len(got) < sum(d > 0 for d in own.density[1:])
    assert kept > 50


def test_pages_without_landmarks(sf_dir):
    """The same text comes out where the pages' article tags are plain divisions."""
    import pyarrow.parquet as pq

    for html in pq.read_table(f"{sf_dir}/pages.parquet").column("html").to_pylist():
        assert html_text.main_text(html) == html_text.main_text(html.replace("<article>", "<div>").replace("</article>", "</div>"))


def test_page_query(spark, sf_dir):
    out = queries.queries()["op1_html_text"](spark, sf_dir)
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = out.collect()
    assert out.columns == ["page_id", "url", "text", "n_chars"] and len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)
        tags = re.sub(r"<[^>]+>", lambda m: " " if re.match(r"</?(p|h1|br)\b", m[0]) else "", body[1])
        assert r.text == " ".join(__import__("html").unescape(tags).split()) and r.n_chars == len(r.text)


# --- 2 and 4 ---------------------------------------------------------------------------------------------------------
def test_training_keeps_more_than_thirty_thousand_features():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000)) for _ in range(8)]
    y = np.array([i % 2 for i in range(8) for _ in range(4)], dtype=np.float64)
    assert len(toxicity.train([t for t in texts for _ in range(4)], y, np.ones(len(y))).features) > 40_000


def toxic_data(n, seed):
    rng = random.Random(seed)
    calm, bad = "sun river stone walk green quiet hand over table light wind".split(), "blargh nurgling vorpalscum".split()
    texts, y = [], []
    for i in range(n):
        w = [rng.choice(calm) for _ in range(rng.randint(5, 80))]
        if i % 3 == 0:
            w[rng.randrange(len(w))] = rng.choice(bad)
        texts.append(" ".join(w))
        y.append(float(i % 3 == 0))
    return texts, np.array(y)


def test_toxicity_on_held_out_texts():
    texts, y = toxic_data(600, 1)
    score = toxicity._Score(toxicity.train(texts, y, np.ones(len(y))))()
    held, want = toxic_data(200, 2)
    assert [score(t)[0] >= 0.7 for t in held] == [w == 1 for w in want]
    assert score(None) == score("") and 0 <= score("")[0] < 0.7


def test_grams_do_not_depend_on_blocks(monkeypatch):
    text = "".join(random.Random(5).choice("abc é") for _ in range(5000))
    whole = toxicity.distinct_grams(text)
    monkeypatch.setattr(toxicity, "BLOCK", 97)
    assert np.array_equal(toxicity.distinct_grams(text), whole)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_models_of_one_class_or_nothing(module):
    for texts, y in (([], []), (["a b c"], [1.0]), (["a b c"], [0.0])):
        model = module.train(texts, np.array(y), np.ones(len(y)))
        value = model.score("x y") if module is quality else module._Score(model)()("x y")[0]
        assert 0.0 <= value <= 1.0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5):
        u, stay, turn = rng.normal(size=n) * 2, 0.7, -0.4
        weights = {}
        for state in range(1 << n):
            bits = [state >> i & 1 for i in range(n)]
            weights[state] = np.exp(sum(u[i] for i in range(n) if bits[i]) + sum(stay if a == b else turn for a, b in zip(bits, bits[1:], strict=False)))
        total = sum(weights.values())
        want = [sum(w for s, w in weights.items() if s >> i & 1) / total for i in range(n)]
        assert np.allclose(quality.marginals(u, stay, turn), want)


def test_quality_on_held_out_texts():
    rng = random.Random(4)
    words = "the sun went over a stone hill and we saw it again from our old house".split()

    def text(good):
        lines = []
        for _ in range(rng.randint(1, 12)):
            w = [rng.choice(words) for _ in range(rng.randint(6, 20))]
            lines.append(" ".join(w).capitalize() + "." if good else " ".join(x.upper() + "!!$$" for x in w))
        return "\n".join(lines)

    data = [(text(i % 2), float(i % 2)) for i in range(300)]
    model = quality.train([t for t, _ in data], np.array([y for _, y in data]), np.ones(300))
    assert all((model.score(text(k)) >= 0.3) == bool(k) for k in [0, 1] * 40)


@pytest.mark.parametrize(("name", "folds", "held"), [("op2_toxicity", 3, 1), ("op4_quality", 5, 0)])
def test_classifier_queries(spark, sf_dir, name, folds, held):
    rows = queries.queries()[name](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(rows) == docs.count()
    limit = 0.7 if name == "op2_toxicity" else 0.3
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= limit)


def test_held_out_labels_do_not_matter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert np.array_equal(a.features, b.features) and np.allclose(a.weights, b.weights)


def test_classifiers_on_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 1), (None, 1, 1), (1, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == docs.count()
    model = quality.fit(docs, labels)
    assert quality.score(docs, model).count() == docs.count()
    assert quality.keep_good(docs, quality.Model(np.zeros(quality.FEATURES), 0.0, 0.0)).columns == docs.columns
    assert quality.score(docs.limit(0), model).count() == 0


# --- 3 ---------------------------------------------------------------------------------------------------------------
def base_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for p, label in licences.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_licence_scan_equals_brute_force():
    rng = random.Random(6)
    parts = ["MIT", "License", "apache", "general", "public", "licensE", "é", "x", ".", "\n", "-", "MIT License", "GNU General Public License"]
    scan = licences.Scanner()
    for _ in range(2000):
        text = rng.choice(["", " "]).join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(0, 25)))
        assert scan(text)[:5] == base_by_hand(text)


@pytest.mark.parametrize(
    ("text", "postfix", "value"),
    [
        ("MIT OR Apache-2.0 AND BSD-3-Clause", "MIT Apache-2.0 BSD-3-Clause and or", 1.0),
        ("(MIT OR Apache-2.0) AND GPL-2.0-only", "MIT Apache-2.0 or GPL-2.0-only and", 0.3),
        ("GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0-only Classpath-exception-2.0 with", 0.5),
        ("MIT and this text goes on", "MIT this and", 0.5),
        ("MIT */ int x;", "MIT", 1.0),
        ("(MIT", None, None),
        ("OR MIT", None, None),
        ("", None, None),
        ("((MIT))", "MIT", 1.0),
    ],
)
def test_expressions(text, postfix, value):
    got = licences.to_postfix(text)
    assert (None if got is None else " ".join(got)) == postfix
    if got:
        assert licences.evaluate(got)[0] == value


@pytest.mark.parametrize(
    ("text", "want"),
    [("SPDX-License-Identifier: MIT */ /* SPDX-License-Identifier: GPL-2.0", "MIT; GPL-2.0"), ("SPDX-License-Identifier: MIT OR SPDX-License-Identifier: ISC OR MIT\nmore", "MIT; ISC MIT or"), ("License Identifier: MIT", "MIT"), ("the license identifier is here", ""), ("License-Identifier:\nMIT", "")],
)
def test_every_tag_of_a_line_is_evaluated(text, want):
    assert licences.Scanner()(text)[-1] == want


def test_very_long_expressions_take_linear_time():
    began = time.time()
    text = "SPDX-License-Identifier: " + " OR ".join(["MIT", "(GPL-2.0 WITH (X AND Y))", "ISC"] * 40_000)
    row = licences.Scanner()(text)
    assert time.time() - began < 20 and row[5] == "gpl,isc,mit" and row[7] == 1.0
    assert len(licences.Scanner()("license identifier: (" * 30_000)) == 9
    assert licences.Scanner()("SPDX-License-Identifier: MIT\n" * 50_000 + "mit license " * 50_000)[1:4] == (50_000, 200_000, 299_998)


def test_licence_tags_and_odd_rows(spark):
    row = licences.Scanner()("// SPDX-License-Identifier: Apache-2.0 OR MIT\nUnder the Apache License.")
    assert row[1:6] == (1, 10, 10, "apache", "apache,mit") and row[7] == 1.0 and 0.9 < row[6] < 1
    docs = odd_docs(spark)
    out = licences.scan(docs).collect()
    assert len(out) == docs.count() and {r.score for r in out} == {0.0} and all(r.labels == "" and r.first_word is None for r in out)
    assert licences.scan(docs.limit(0)).count() == 0


def expression_by_hand(text):
    """Recursive descent over the longest well-formed expression at the start of ``text``: (value, labels, postfix) or None."""
    words = []
    at = 0
    while m := re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+\-]*)").match(text, at):
        words.append(m[1])
        at = m.end()
    known = lambda x: licences.PERMISSIVENESS.get(x, 0.5)

    def operand(k):
        if k < len(words) and words[k] == "(":
            got = level(k + 1, 0)
            return (got[0], got[1] + 1) if got and got[1] < len(words) and words[got[1]] == ")" else None
        if k < len(words) and words[k] not in "()" and words[k].lower() not in ("and", "or", "with"):
            label = licences.family(words[k].rstrip(".-"))
            return (known(label), [label], [words[k].rstrip(".-")]), k + 1
        return None

    def level(k, rank):
        """Operators of rank 0 (or), 1 (and), 2 (with), to the left first."""
        left = operand(k) if rank == 3 else level(k, rank + 1)
        while left and rank < 3 and left[1] < len(words) and words[left[1]].lower() == ("or", "and", "with")[rank]:
            right = operand(left[1] + 1) if rank == 2 else level(left[1] + 1, rank + 1)
            if not right:
                break
            (x, xl, xp), (y, yl, yp) = left[0], right[0]
            value, labels = (max(x, y), xl + yl) if rank == 0 else (min(x, y), xl + yl) if rank == 1 else (min(1.0, x + 0.2), xl)
            left = (value, labels, [*xp, *yp, ("or", "and", "with")[rank]]), right[1]
        return left

    got = level(0, 0)
    return got and got[0]


def scan_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = lambda p: sum(words[i : i + len(p.split())] == p.split() for i in range(len(words)))
    n_words, n_base, first, last, base = base_by_hand(text)
    notices = {p: places(p) for p in licences.NOTICES}
    labels = set(filter(None, base.split(","))) | {licences.NOTICES[p] for p, n in notices.items() if n}
    values, shown = [], []
    # A tag ends where its line does, or where the next one begins.
    for line in re.split(r"[\r\n]", text or ""):
        for part in re.split(r"(?i)(?<![0-9a-z\x80-\U0010ffff])(?:SPDX-)?Licen[cs]e(?:-Identifier(?![0-9a-z\x80-\U0010ffff])\s*:?|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+Identifier\s*:)[ \t]*", line)[1:]:
            if got := expression_by_hand(part):
                values.append(got[0])
                labels |= set(got[1])
                shown.append(" ".join(got[2]))
    score = 1 - 0.5 ** min(n_base, 60) * 0.6 ** min(sum(notices.values()), 60) * 0.1 ** min(len(values), 60)
    values = values or [licences.PERMISSIVENESS.get(x, 0.5) for x in labels]
    return n_words, n_base, first, last, base, ",".join(sorted(labels)), pytest.approx(score), min(values, default=None), "; ".join(shown)


def test_whole_scan_equals_brute_force():
    rng = random.Random(16)
    parts = ["SPDX-License-Identifier: ", "Licence Identifier: ", "license-identifier", "MIT", "GPL-2.0-only", "Apache-2.0", "(", ")", " AND ", " OR ", " WITH ", "x.", "\n", "BSD License", "MIT License", "public domain", "CC0", "cc by sa", "unlicense, "]
    scan = licences.Scanner()
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 14)))
        assert scan(text) == scan_by_hand(text), repr(text)


def test_licence_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.queries()["op3_licences"](spark, sf_dir).collect():
        assert tuple(r)[1:] == scan_by_hand(texts[r.doc_id])


# --- 8 ---------------------------------------------------------------------------------------------------------------
def hits_by_hand(text, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    doc, hit, names = find(text), set(), set()
    for name, t in items:
        w = find(t)
        n = min(10, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(doc) - n + 1):
            if tuple(doc[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                names |= {str(name)} if name is not None else set()
    return len(doc), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("limit_mb", [32, 0])
def test_contamination_equals_brute_force(spark, limit_mb):
    rng = random.Random(8)
    word = lambda: rng.choice(["a", "b", "ab", "Ç", "d1"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([12, 30, 10, 9, 3, 1, 0, 25, 11])] + [(None, "zz yy xx"), (3, "q q q q"), (50, None)]
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(30)]
    texts += [f"x {t} y, {t}" for _, t in items if t] + ["a " * 400, None, "", "q q q q q", "zz YY. xx"]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, texts[31])], "doc_id long, text string").withColumn("n_hit", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    out = decontaminate.contamination(docs, bench, limit_mb=limit_mb).collect()
    want = sorted(((i, *hits_by_hand(t, items)) for i, t, _ in docs.collect()), key=str)
    assert sorted(map(tuple, out), key=str) == want
    left = decontaminate.drop_contaminated(docs, bench, limit_mb=limit_mb)
    assert left.columns == docs.columns and left.count() == sum(not w[-1] for w in want)


@pytest.mark.parametrize("limit_mb", [32, 0])
def test_contamination_of_long_and_hot_texts(spark, limit_mb):
    """A million equal words against an item of 200 of them, a hot text, and ids and texts that are null in turn."""
    long = "a " * 1_000_000
    docs = spark.createDataFrame([(1, long), *[(i, "b " * 12) for i in range(2, 60)], (99, "b " * 9)], "doc_id long, text string").withColumns({"contaminated": F.lit("c"), "N_WORDS": F.lit(1)})
    items = spark.createDataFrame([("x", "a " * 200), ("y", "b " * 300), ("y2", "b " * 10), (None, "x"), ("x", None), ("z", "c " * 10)], "item_id string, text string")
    out = decontaminate.contamination(docs, items, limit_mb=limit_mb, keep=("doc_id", "contaminated", "N_WORDS"))
    assert out.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    digest = lambda names: hashlib.sha256(names.encode()).hexdigest()
    want = [(1, 1_000_000, 1_000_000, 1, digest("x"), True), *[(i, 12, 12, 2, digest("y,y2"), True) for i in range(2, 60)], (99, 9, 0, 0, digest(""), False)]
    assert sorted(map(tuple, out.collect())) == want


def test_winnowing_keeps_a_print_of_every_window():
    rng = np.random.default_rng(9)
    for _ in range(200):
        shared = rng.integers(0, 3, 10).astype(np.uint64)
        prints = []
        for _ in range(2):
            before, after = (rng.integers(0, 3, rng.integers(0, 20)).astype(np.uint64) for _ in range(2))
            at, p = decontaminate.winnow(np.concatenate([before, shared, after]), 10, 6)
            inside = (at >= len(before)) & (at <= len(before) + 4)
            prints.append(set((at[inside] - len(before)).tolist()))
        assert prints[0] & prints[1]


def test_empty_benchmark(spark):
    docs = odd_docs(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).filter("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), none).count() == 0


# --- 9 ---------------------------------------------------------------------------------------------------------------
def test_audio_round_trip_and_determinism(spark):
    docs = odd_docs(spark)
    rows = audio.media_digest(audio.store_audio(docs)).collect()
    assert len(rows) == docs.count()
    for r, t in zip(rows, [x.text for x in docs.collect()], strict=True):
        raw = (t or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_bytes == len(payload) + 44
    by_text = {}
    for r in rows:
        by_text.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())
    assert audio.media_digest(audio.store_audio(docs.limit(0))).count() == 0


def test_the_query_stores_tensors(spark, sf_dir, tmp_path):
    """The stored column holds fixed-shape tensors with spans that follow each other, and features come from them."""
    docs = spark.createDataFrame([(1, "abc " * 5000), (2, None), (3, "x")], "doc_id long, text string")
    audio.store_features(audio.store_audio(docs)).write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    for r in back.collect():
        windows = audio.from_tensors(r.tensors)
        assert windows.schema.field("log_mel").type == audio.LOG_MEL and windows.schema.field("voiced").type == audio.VOICED
        assert windows.column("log_mel").to_numpy_ndarray().shape == (windows.num_rows, audio.WINDOW_FRAMES, audio.MELS)
        start, end = windows.column("start_ms").to_pylist(), windows.column("end_ms").to_pylist()
        assert start == [640 * i for i in range(len(start))] and end[:-1] == start[1:]
    assert sorted(map(tuple, audio.media_digest(back).collect())) == sorted(map(tuple, audio.media_digest(audio.store_audio(docs)).collect()))
    nothing = audio.media_digest(audio.store_audio(docs).withColumns({"media": F.lit(None).cast("binary"), "FEATURE": F.lit(1)}), keep=("doc_id", "FEATURE"))
    assert nothing.columns == ["doc_id", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    assert all(set(tuple(r)[1:]) == {None} for r in nothing.collect())


def feature_by_hand(text):
    """Log-mel steps and segments of a text by plain loops: zero-stuffing and convolution, a plain DFT, frame by frame."""
    raw = (text or "").encode()
    raw += b" " * (-len(raw) % 192 if raw else 192)
    x = np.array(list(raw), dtype=np.int64) - 128
    stuffed = np.zeros(len(x) * 5, np.int64)
    stuffed[::5] = x
    y = np.convolve(stuffed, audio.polyphase_taps().T.reshape(-1))[: len(x) * 5][::8]
    rate, count = 10_000.0, max(1, -(-max(len(y) - 250, 0) // 100) + 1)
    mel_of, hz_of = lambda f: 2595 * np.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = [hz_of(mel_of(rate / 2) * k / 41) for k in range(42)]
    turn = np.exp(-2j * np.pi * np.outer(np.arange(129), np.arange(250)) / 256)
    steps, energy = [], []
    for k in range(count):
        frame = np.zeros(250)
        part = y[k * 100 : k * 100 + 250]
        frame[: len(part)] = part
        frame = frame / (128 * 2**14)
        frame -= frame.mean()
        power = np.abs(turn @ (frame * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(250) / 249)))) ** 2
        row = []
        for m in range(40):
            total = sum(power[b] * max(0.0, min((f - edges[m]) / (edges[m + 1] - edges[m]), (edges[m + 2] - f) / (edges[m + 2] - edges[m + 1]))) for b, f in enumerate(np.arange(129) * rate / 256))
            row.append(10 * np.log10(max(total, 1e-8)))
        steps.append(row)
        energy.append(10 * np.log10(max((frame**2).mean(), 1e-8)))
    base, on, segments, voiced = sorted(energy)[count // 10], False, 0, 0
    for e in energy:
        was, on = on, e >= base + 1.5 or (on and e >= base + 0.5)
        segments += on and not was
        voiced += on
    return count, segments, voiced, np.array(steps)


def test_features_equal_brute_force(sf_dir):
    import pyarrow.parquet as pq

    texts = [None, "", "a" * 500, "Some words.\n" * 40] + [t for t in pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist() if t and len(t) < 3000][:15]
    for text in texts:
        count, segments, voiced, mel = feature_by_hand(text)
        blob = audio.to_tensors(audio.to_wav(audio.pad((text or "").encode())))
        got = dict(p.split("=") for p in audio.feature_text(blob)[0].split(";"))
        assert (int(got["frames"]), int(got["segments"]), int(got["voiced"])) == (count, segments, voiced)
        steps = audio.from_tensors(blob).column("log_mel").to_numpy_ndarray().reshape(-1, 40)
        assert np.abs(steps[:count] - mel).max() <= 0.5 + 1e-6 and (steps[count:] == audio.QUIET).all()


def test_audio_query_equals_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.queries()["op9_audio"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        wav = b"RIFF" + (36 + len(payload)).to_bytes(4, "little") + b"WAVEfmt " + bytes.fromhex("10000000 0100 0100 803e0000 803e0000 0100 0800") + b"data" + len(payload).to_bytes(4, "little") + payload
        assert tuple(r)[1:7] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(wav), hashlib.sha256(wav).hexdigest())
        if len(raw) < 1200:
            count, segments, voiced, mel = feature_by_hand(texts[r.doc_id])
            got = dict(p.split("=") for p in r.feature.split(";"))
            assert (int(got["frames"]), int(got["segments"]), int(got["voiced"])) == (count, segments, voiced)
            assert np.abs(np.array(list(map(int, got["mel"].split(",")))) - mel.mean(axis=0)).max() <= 1.0


def test_polyphase_equals_direct_filter():
    x = np.random.default_rng(1).integers(-128, 128, 500)
    up, down = audio.UP, audio.DOWN
    taps = audio.polyphase_taps()
    stuffed = np.zeros(len(x) * up, np.int64)
    stuffed[::up] = x
    full = np.convolve(stuffed, taps.T.reshape(-1))
    assert np.array_equal(audio.resample(x), full[: len(x) * up][::down])


def test_hysteresis_by_hand():
    e = np.array([0, 0, 2, 1, 1, 0, 1, 0, 2, 2], dtype=float)
    assert audio.hysteresis(e, 1.5, 0.5) == [(2, 5), (8, 10)]


def test_tensors_have_a_fixed_shape(spark):
    docs = spark.createDataFrame([(1, "abc " * 5000), (2, None)], "doc_id long, text string")
    windows = audio.log_mel_windows(audio.store_audio(docs))
    rows = windows.orderBy("doc_id", "start_ms").collect()
    assert all(len(r.log_mel) == audio.WINDOW_FRAMES * audio.MELS for r in rows)
    assert [r.start_ms for r in rows if r.doc_id == 1] == [640 * i for i in range(sum(r.doc_id == 1 for r in rows))]
    tensors = audio.as_tensors(windows.toArrow().column("log_mel"))
    assert tensors.to_numpy_ndarray().shape == (len(rows), audio.WINDOW_FRAMES, audio.MELS)


# --- 10 --------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.vocabulary_path())


def test_encoding_equals_the_library(library):
    rng = random.Random(10)
    coder = bpe.load(bpe.vocabulary_path())
    signs = list("ab  \n\t'sSre09é²一ñß\x1c\x1f\x85\xa0​　<|endoftext|>·") + ["<|endoftext|>", "😀", "́", "'ll", "aaaa", "the"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(5000)] + [t or "" for t in ODD]
    for text, digest in zip(texts, coder.digests(texts), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert coder.encode(text) == coder.ids_of(text) == ids and coder.decode(ids) == back
        assert digest == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_suffix_automaton_equals_brute_force():
    rng = random.Random(14)
    for _ in range(60):
        tokens = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 6))): i for i in range(rng.randint(1, 25))}
        tokens = {raw: i for i, raw in enumerate(tokens)}
        automaton = bpe.SuffixAutomaton(tokens)
        parts = {raw[i:j] for raw in tokens for i in range(len(raw)) for j in range(i + 1, len(raw) + 1)}
        places = {p: frozenset((raw, k) for raw in tokens for k in range(len(raw) + 1) if raw[:k].endswith(p)) for p in parts}
        assert len(automaton.link) == len(set(places.values())) + 1  # a state for each set of places, and the root
        for _ in range(20):
            text = bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 12)))
            for k, token in enumerate(automaton.matches(text), 1):
                got = []
                while token >= 0:
                    got.append(token)
                    token = automaton.shorter[token]
                assert got == [tokens[text[i:k]] for i in range(k) if text[i:k] in tokens]


def test_known_pieces_may_be_forgotten(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEEP", 2)
    coder = bpe.PrefixBpe(bpe.vocabulary_path())
    text = "one two three one two three four"
    assert coder.ids_of(text) == library.encode(text).ids and len(coder.known) <= 2


def test_encode_decode_frames(spark):
    docs = odd_docs(spark)
    tokens = bpe.encode(docs)
    assert [r.text for r in bpe.decode(tokens).collect()] == [r.text or "" for r in docs.collect()]
    assert bpe.token_digest(docs).count() == docs.count() and bpe.token_digest(docs.limit(0)).count() == 0


def test_token_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.queries()["op10_bpe"](spark, sf_dir).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
