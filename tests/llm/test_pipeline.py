"""The corpus pipeline: every stage against a version of its own, and odd rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F
from test_models import score_by_hand
from test_table_operators import components_by_hand, lines_by_hand
from test_text_operators import hits_by_hand

import corpus_pipeline
from cindermill.llm import bpe, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_row_of_a_group_stays_where_ids_repeat_or_are_null(spark, sf_dir):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(2, a), (1, a), (1, a), (None, a), (None, b), (None, b), (3, c), (3, f"{c} more"), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, sf_dir)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text[:2]) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(1, "a0"), (None, "b0"), (3, "c0"), (4, "")], key=str)


def passages_by_hand(rows):
    """Texts without lines of over 50 words that an earlier place has, where two documents have them."""
    first, owners = {}, {}
    for i, t in sorted(rows):
        for j, line in enumerate(t.split("\n")):
            key = line.strip(" \t\r")
            if len(re.findall(r"[^\x20\x09-\x0D]+", line)) > 50:
                first.setdefault(key, (i, j))
                owners.setdefault(key, set()).add(i)
    return {i: "\n".join(x for j, x in enumerate(t.split("\n")) if len(owners.get(k := x.strip(" \t\r"), ())) < 2 or first[k] == (i, j)) for i, t in rows}


def kept_by_hand(before, after):
    """Texts of which a cut has left something."""
    return {i: t for i, t in after.items() if t.strip(" \t\r\n") or t == before[i]}


def test_pipeline_stages_by_hand(spark, sf_dir):
    """Each stage on what the one before kept."""
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.vocabulary_path())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "bpe_encoding_decoding"]

    out = stages["quality_classifier"](spark, docs, sf_dir).cache()
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert out.columns == columns and sorted(r.doc_id for r in out.collect()) == sorted(i for i, r in before.items() if score_by_hand(model, r.text) >= 0.3)

    cut = stages["line_dedup"](spark, out, sf_dir).cache()
    assert cut.columns == columns and cut.schema == docs.schema
    rows = [(r.doc_id, r.text, r.source) for r in out.collect()]
    want = kept_by_hand({i: t for i, t, _ in rows}, {i: t for i, t, _, _ in lines_by_hand(rows)})
    assert {r.doc_id: r.text for r in cut.collect()} == want and all(r.n_chars == len(r.text) for r in cut.collect())

    unique = stages["ngram_jaccard_join"](spark, cut, sf_dir).cache()
    groups = components_by_hand([(r.doc_id, r.text) for r in cut.collect()], 5, 80)
    assert unique.columns == columns and sorted(r.doc_id for r in unique.collect()) == sorted(i for i, (_, root) in groups.items() if i == root)

    clean = stages["benchmark_decontamination"](spark, unique, sf_dir).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = {r.doc_id: r.text for r in unique.collect() if not hits_by_hand(r.text, items)[-1]}
    assert clean.columns == columns and {r.doc_id: r.text for r in clean.collect()} == kept_by_hand(left, passages_by_hand(list(left.items())))

    last = stages["bpe_encoding_decoding"](spark, clean, sf_dir)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in last.collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in clean.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert got.pop(r.doc_id) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert not got
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()} == {tuple(r) for r in last.collect()}


def odd_rows():
    long = " ".join(f"w{i % 977}" for i in range(250_000))
    line = "A line of an ordinary text, with words enough to be told from noise."
    return [(None, line), (None, None), (1, None), (2, ""), (3, " \n "), (4, line), (4, line), (5, line + " More."), (6, long), (7, long + " end"), (None, long)]


def test_stages_on_odd_rows_and_columns(spark, sf_dir):
    """Nulls, repeated ids and rows, long texts, and columns with names that stages use inside."""
    extra = ["h", "pos", "n_lines", "score", "contaminated", "node", "family", "__cut", "n_words", "component_id"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in odd_rows()], SCHEMA).withColumns({c: F.lit(f"x-{c}") for c in extra})
    stages = dict(corpus_pipeline.STAGES)
    model = quality.Model(quality.np.zeros(quality.FEATURES), 0.0, 0.0)
    assert sorted(quality.keep_good(docs, model).collect(), key=str) == sorted(docs.collect(), key=str)
    kept = docs
    for name, count in (("line_dedup", 11), ("ngram_jaccard_join", 6), ("benchmark_decontamination", 6)):
        kept = stages[name](spark, kept, sf_dir)
        assert kept.columns == docs.columns and kept.count() == count, name
        assert all(r[c] == f"x-{c}" for r in kept.collect() for c in extra) and all(r.n_chars == len(r.text or "") for r in kept.collect() if r.text is not None)
    assert sorted((r.doc_id, len(r.text or "")) for r in kept.filter("doc_id IS NOT NULL").collect())[:3] == [(1, 0), (2, 0), (3, 3)]
    assert stages["bpe_encoding_decoding"](spark, kept, sf_dir).count() == 6


def test_stages_on_empty_tables(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0, name


def test_pipeline_without_labels_or_benchmark(spark, sf_dir, tmp_path):
    """Every half-decided document stays, and none is contaminated."""
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert 20 <= corpus_pipeline.run(spark, str(tmp_path)).count() <= 30
