"""Operators 5, 6 and 7 and the pipeline, against brute force and exact round trips."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cindermill.llm import line_dedup, near_duplicates, queries, warc
from cindermill.llm.components import components


class Joined:
    """Union-find by hand."""

    def __init__(self):
        self.up = {}

    def find(self, a):
        self.up.setdefault(a, a)
        while self.up[a] != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components_by_hand(rows, k, num):
    sets = {i: shingle_set(t, k) for i, t in rows}
    joined = Joined()
    ids = sorted(sets)
    for x, a in enumerate(ids):
        joined.find(a)
        for b in ids[:x]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= num * (len(sets[a]) + len(sets[b]) - inter):
                joined.join(a, b)
    return {i: (len(sets[i]), joined.find(i)) for i in ids}


def near_copies(seed, families=6, size=12, length=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = " ".join(word() for _ in range(30))
    texts = [None, "", " \n", "one", "One", "one two", "a b c", "A  B\tC", "a a a a a", "x y " * 3000]
    for _ in range(families):
        base = [word() for _ in range(rng.randint(3, length))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[word()], [], [word(), word()]])
            texts.append(" ".join(w))
    texts += [f"{passage} {' '.join(word() for _ in range(40))}" for _ in range(8)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("words", "num", "n2", "k2", "skip"), [(3, 90, 2, 1, False), (5, 80, 2, 1, True), (2, 60, 3, 1, True), (1, 80, 1, 0, False)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, words, num, n2, k2, skip):
    rows = near_copies(words * num)
    monkeypatch.setattr(near_duplicates, "FIRST_DOCS", 3)
    monkeypatch.setattr(near_duplicates, "BLOCK_DOCS", 5)  # so that families are cut into blocks
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"node": F.lit("x"), "family": F.lit(1), "g": F.lit(2)})
    out = near_duplicates.similar_components(docs, words, num, 100, n2, k2, skip)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == components_by_hand(rows, words, num)


@pytest.fixture
def compared(spark, monkeypatch):
    """Characters that each comparison of a join deals out, in small blocks."""
    monkeypatch.setattr(near_duplicates, "FIRST_DOCS", 3)
    monkeypatch.setattr(near_duplicates, "BLOCK_DOCS", 5)
    frame, seen = type(spark.range(1)), []

    def repartition(self, *args, dealt=frame.repartition):
        if self.columns == ["g", "side", "node", "text"]:
            seen.append(self.agg(F.sum(F.length("text"))).first()[0] or 0)
        return dealt(self, *args)

    monkeypatch.setattr(frame, "repartition", repartition)
    return seen


def test_jaccard_join_copies_little_text_at_a_time(spark, compared):
    """Sixty unlike versions of one text, and a near copy of every sixth: all are tied, and compared pair by pair."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):
        w = list(base)
        for at in rng.sample(range(60), 2):
            w[at] = f"v{i}x{at}"
        texts += [" ".join(w)] + [" ".join([*w, "end"])] * (i % 6 == 0)
    rows = list(enumerate(texts))
    out = near_duplicates.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, skip_frequent=False).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == components_by_hand(rows, 3, 90)
    total = sum(map(len, texts))
    assert sum(compared) > 8 * total and max(compared) < 3 * total


def test_a_passage_alone_leads_to_no_comparison(spark, compared):
    """Texts tied by the cells of a passage that did not count as frequent come apart before they are compared."""
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(20))
    texts = [f"{passage} {' '.join(str(rng.random()) for _ in range(80))}" for _ in range(60)]
    texts.append(f"{texts[7]} more")
    rows = list(enumerate(texts))
    out = near_duplicates.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, skip_frequent=False).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == components_by_hand(rows, 5, 80)
    assert sum(compared) < 10 * len(texts[0])


def test_jaccard_join_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "q r s t"), (4, None), (4, None)], "doc_id long, text string")
    out = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates.similar_components(docs, 3, 90).collect())
    assert out == Counter({(1, 2, 1): 2, (None, 2, 1): 1, (None, 2, None): 1, (4, 0, 4): 2})
    assert near_duplicates.similar_components(docs.limit(0), 3, 90).count() == 0


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for num, n2, k2 in ((90, 2, 1), (80, 2, 1), (80, 3, 1), (70, 1, 0)):
        scheme = near_duplicates.Scheme(num, 100, n2, k2)
        for _ in range(300):
            n = int(rng.integers(1, 300))
            a = rng.integers(0, 1 << 62, n).astype(np.uint64)
            drop, add = rng.integers(0, n // 8 + 2), rng.integers(0, n // 8 + 2)
            b = np.concatenate([a[min(drop, n - 1) :], rng.integers(0, 1 << 62, add).astype(np.uint64)])
            inter = len(np.intersect1d(a, b))
            a, b = np.unique(a), np.unique(b)
            if 100 * inter >= num * (len(a) + len(b) - inter) and inter < len(a) + len(b) - inter:
                both = np.union1d(a, b)
                for share in (0.0, 0.3, 0.9, 1.0):
                    frequent = both[rng.random(len(both)) < share]
                    assert len(np.intersect1d(scheme.signatures(a, frequent), scheme.signatures(b, frequent))), (num, n2, k2, n, share)


def test_similar_sets_of_over_a_million_features_share_signatures():
    """Sets on either side of 2**20 features share as many signatures as sets on one side."""
    items = near_duplicates.mix(np.arange(1_049_076, dtype=np.uint64))
    scheme = near_duplicates.Scheme(90, 100, 2, 1)
    for n in (1_048_076, 1_048_576, 1_049_000):
        assert len(np.intersect1d(scheme.signatures(np.sort(items[:n])), scheme.signatures(np.sort(items)))) > 200_000


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(13)
    words = ["".join(rng.choice("aBcé") for _ in range(rng.choice([1, 5, 60, 700]))) for _ in range(300)]
    data = "".join(w + rng.choice([" ", "\n\t "]) for w in words).encode() + b"end" * 400
    hasher = near_duplicates.WordHasher(near_duplicates.is_space_free)
    whole = hasher(data)
    assert len(whole) == 301 and len(set(whole.tolist())) == len({w.lower() if w.isascii() else w.translate({66: "b"}) for w in words}) + 1
    for block in (512, 700, 4096):
        monkeypatch.setattr(near_duplicates.WordHasher, "BLOCK", block)
        assert np.array_equal(near_duplicates.WordHasher(near_duplicates.is_space_free)(data), whole)


def test_word_hashes_of_a_long_text_need_little_memory():
    import subprocess
    import sys

    code = "import resource as r; from cindermill.llm.near_duplicates import shingles; t = 'some words of text ' * 2_600_000; a = r.getrusage(0).ru_maxrss; shingles(t, 3); print((r.getrusage(0).ru_maxrss - a) // 1024)"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=corpus_pipeline.__file__.rpartition("/")[0]).stdout) < 600


def test_spanning_links_equal_brute_force():
    rng = random.Random(11)
    for _ in range(30):
        sets = [np.unique(np.array(rng.sample(range(40), rng.randint(1, 30)), dtype=np.uint64)) for _ in range(25)]
        for cut in (None, 10):
            left, right = (sets, None) if cut is None else (sets[:cut], sets[cut:])
            want, got = Joined(), Joined()
            for i in range(25):
                for j in range(i):
                    inter = len(np.intersect1d(sets[i], sets[j]))
                    if inter and (cut is None or (j < cut <= i)) and 100 * inter >= 50 * (len(sets[i]) + len(sets[j]) - inter):
                        want.join(i, j)
            links = near_duplicates.spanning_links(left, right, 50, 100)
            for i, j in links:
                got.join(i, j)
            assert [want.find(i) for i in range(25)] == [got.find(i) for i in range(25)] and len(links) < 25


def test_components(spark):
    rng = random.Random(12)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    want = Joined()
    for a, b in edges:
        want.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for n in {x for e in edges for x in e}:
        assert got.get(n, n) == want.find(n)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 6 ---------------------------------------------------------------------------------------------------------------
def test_archives_round_trip(spark):
    from cindermill.llm.common import shared_path

    long = "<p>" + "long page " * 400_000
    rows = [(3, "http://a", "same"), (1, "http://b\r\nX: y", "same"), (2, None, None), (9, "u", ""), (4, "u", long), (5, "u", "é\0\r\n\r\nWARC/1.1"), (1, "http://b", "same"), (None, "u", "same"), (None, None, None), (7, "u", "once")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"first": F.lit(1), "n": F.lit(2), "digest": F.lit("d"), "key": F.lit("k"), "payload": F.lit("p")})
    path = shared_path(spark, "warc-test")
    warc.write_archives(pages, path)
    got = warc.read_archives(spark, path).collect()
    want = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        first = min(i for i, _, h in rows if i is not None and (h or "") == (html or ""))
        revisit = page_id is not None and page_id != first
        want.append((None if page_id is None else str(page_id), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", str(first) if revisit else None, None if revisit else raw))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got), key=str) == sorted(want, key=str)


def test_ids_of_any_signs(spark):
    from cindermill.llm.common import shared_path

    ids = ["a\r\nPage-ID: b", "", " ", "x: y", "é%0D", "a%0D%0Ab", "\x00", "same", "zz"]
    pages = spark.createDataFrame([(i, "u", "same" if k > 4 else f"t{k}") for k, i in enumerate(ids)], "page_id string, url string, html string")
    path = shared_path(spark, "warc-test")
    warc.write_archives(pages, path)
    got = {r.page_id: r.refers_to for r in warc.read_archives(spark, path).collect()}
    assert got == {i: "\x00" if k > 4 and i != "\x00" else None for k, i in enumerate(ids)}


def test_small_payloads_may_all_be_kept(spark):
    from cindermill.llm.common import shared_path

    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(["ab", "ab", "abcdef", "abcdef"])], "page_id long, url string, html string")
    path = shared_path(spark, "warc-test")
    warc.write_archives(pages, path, min_bytes=3)
    assert Counter(r.record_type for r in warc.read_archives(spark, path).collect()) == {"response": 3, "revisit": 1}


def test_no_pages(spark):
    from cindermill.llm.common import shared_path

    path = shared_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


@pytest.mark.parametrize("count", [1, 3, 400])
def test_frames(count):
    rng = random.Random(count)
    records = [warc.build_record(str(i), "http://x", f"<html><body class=page>{rng.random()} text {i % 7}</body></html>".encode() * rng.randint(0, 30), None) for i in range(count)]
    frames = list(warc.write_frames(iter(records)))
    data = warc.SEPARATOR.join(frames)
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC and len(frames) == count + 1
    assert list(warc.read_frames(data)) == records
    if count == 400:
        assert len(data) < sum(map(len, records)) / 3


# --- 7 ---------------------------------------------------------------------------------------------------------------
def lines_by_hand(rows, sites=10):
    """(id, text, lines, lines removed) of each (id, text, site)."""
    spread, first = {}, {}
    for i, t, s in rows:
        for j, line in enumerate((t or "").split("\n") if t is not None else []):
            key = line.strip(" \t\r")
            if key:
                spread.setdefault(key, set()).add(s)
                if i is not None:
                    first[key] = min(first.get(key, (i, j)), (i, j))
    want = []
    for i, t, _ in rows:
        lines = t.split("\n") if t is not None else []
        keep = [x for j, x in enumerate(lines) if i is None or not (k := x.strip(" \t\r")) or len(spread[k] - {None}) < sites or first[k] == (i, j)]
        want.append((i, None if t is None else "\n".join(keep), len(lines), len(lines) - len(keep)))
    return want


@pytest.mark.parametrize("lg_k", [12, 4])
def test_line_dedup_equals_brute_force(spark, lg_k):
    rng = random.Random(7)
    common = [f"common line {i}" for i in range(12)]
    rows = []
    for i in range(160):
        lines = [rng.choice(common[: rng.randint(1, 12)]) + rng.choice(["", " ", "\r"]) if rng.random() < 0.5 else f"own {i} {j}" if rng.random() < 0.8 else "" for j in range(rng.randint(1, 8))]
        rows.append((i, "\n".join(lines), f"s{rng.randrange(14)}"))
    rows += [(900, None, "s1"), (901, "", "s1"), (902, common[0], None), (None, common[0], "s2"), (5, rows[5][1], rows[5][2]), (903, "\n".join(common * 40), "s3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"h": F.lit("h"), "pos": F.lit("p"), "n_lines": F.lit("z")})
    want = lines_by_hand(rows)
    out = line_dedup.dedup_lines(docs, lg_k=lg_k)
    assert [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_removed"] == out.columns
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str) == sorted(want, key=str)
    assert sum(w[3] for w in want) > 100


def test_line_dedup_of_long_documents_and_repeated_ids(spark):
    """A document of 200,000 boilerplate lines, and rows that share an id but not the text."""
    import time

    shared = [f"shared {i}" for i in range(200_000)]
    rows = [(i, "\n".join(shared), f"s{i}") for i in range(3)] + [(7, "shared 5\nown", "s1"), (7, "own\nshared 5\n\nshared 5", "s2"), (7, "own", "s2"), (8, " shared 5", "s4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    began = time.time()
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs, min_sites=3).collect())
    assert time.time() - began < 60
    gone = lambda i: (i, "", 200_000, 200_000)
    assert got == Counter([(0, rows[0][1], 200_000, 0), gone(1), gone(2), (7, "own", 2, 1), (7, "own\n", 4, 2), (7, "own", 1, 0), (8, "", 1, 1)])


def test_line_dedup_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert line_dedup.dedup_lines(docs).count() == 0


def test_line_dedup_is_native(spark, sf_dir):
    plan = queries.queries()["op7_line_dedup"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_repeated_passages_on_few_sites(spark, sf_dir):
    """A passage in four documents, three of them on the hot site, and one on the hot site alone, stay at their first places; a short line stays."""
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n))
    few, hot, once, short = words(60), words(51), words(80), words(50)
    rows = [(i, "\n".join([words(70), *lines]), site) for i, (site, lines) in enumerate([("hot", [once]), ("hot", [few, short]), ("hot", [f" {few}\r", short]), ("s1", [short, few, few]), ("hot", [few, hot]), ("s2", [once[:-1], short]), ("hot", [hot])])]
    rows.append((9, few, "s3"))
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = {i: t for i, t, _ in rows if i != 9}
    want[2] = want[2].replace(f"\n {few}\r", "")
    want[3] = want[3].replace(f"\n{few}", "")
    want[4] = want[4].replace(f"\n{few}", "")
    want[6] = want[6].replace(f"\n{hot}", "")
    out = dict(corpus_pipeline.STAGES)["benchmark_decontamination"](spark, dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, sf_dir), sf_dir)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == want and all(r.n_chars == len(r.text) for r in out.collect())
