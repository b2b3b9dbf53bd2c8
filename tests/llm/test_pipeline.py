"""The pipeline's stages, one after the other, against what each one promises."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from ohmweave.llm import decontam, secrets
from ohmweave.llm.common import stored, table

from . import test_decontam, test_jaccard, test_packing, test_secrets


def test_stages_narrow_the_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near-dedup", "decontamination", "secrets", "packing"]
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, sf_dir), name)
        assert out.columns == docs.columns
        left = {r.doc_id for r in out.select("doc_id").collect()}
        assert left <= ids
        assert len(left) == out.count() > 0
        docs, ids = out, left
    assert decontam.contained_items(docs, table(spark, sf_dir, "benchmark")).count() == 0
    assert docs.join(secrets.find_secrets(docs).where("spans <> ''"), "doc_id").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids


def test_run_is_the_stages_result(spark, sf_dir):
    once, again = (corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "start", "length", "ids_crc32") for _ in range(2))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))


def test_empty_documents(spark, tmp_path):
    table(spark, "/root/testdata/sf0.001", "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, "/root/testdata/sf0.001", "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_edge_rows(spark, sf_dir, tmp_path):
    """Null ids and texts, rows repeated or alike in id alone, a very long text, secrets, benchmark passages, clashing names."""
    item = table(spark, sf_dir, "benchmark").orderBy("item_id").first().text
    some = [r.text for r in table(spark, sf_dir, "documents").where("length(text) between 300 and 900 and lang = 'en'").orderBy("doc_id").limit(12).collect()]
    base, own = some[0], some[1]
    rows = [(1, base), (2, base), (2, own), (2, own), (3, None), (4, ""), (5, "12 34 !!"), (6, base + " token = abcdefghijk"), (7, some[2] + " " + item), (None, some[3]), (8, " ".join(some[4:]) + " " + " ".join(f"{w}{k}" for k in range(300) for w in ("house", "river", "the", "of", "and"))), *((20 + k, x) for k, x in enumerate(some[4:]))]
    df = spark.createDataFrame([(i, t, "en", "s", 1, 2, 3, "x") for i, t in rows], "doc_id long, text string, lang string, source string, node int, text_hash int, row int, key string").withColumnRenamed("key", "a.b")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, sf_dir, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, str(tmp_path)), name)
        assert out.columns == df.columns
        docs = out
    left = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in docs.collect())
    ids = [i for none, i, _ in left if not none]
    assert ids.count(1) == 1  # of the copies the least id
    assert [t for none, i, t in left if i == 2] == [own]  # the other text of an id stays, once
    assert not {3, 4, 5, 6, 7} & set(ids)
    assert (True, 0, some[3]) in left
    assert 8 in ids
    got = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").sum("length").collect()
    assert sorted(i for i in (r.doc_id for r in got) if i is not None) == sorted(set(ids))


def test_run_matches_brute_force(spark, sf_dir):
    """After the learned stage: all pairs by Jaccard, shingle sets of items, Python's re, and a plain tokenizer."""
    docs = stored(corpus_pipeline.language(spark, table(spark, sf_dir, "documents"), sf_dir), "language")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    kept = set(test_jaccard.brute_kept(rows))
    rows = [r for r in rows if r[0] in kept]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    bad = {d for d, _, _, _ in test_decontam.brute(rows, items)}
    rows = [(i, t) for i, t in rows if i not in bad and not test_secrets.brute(t)[-1]]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    test_packing.check(packed, rows, lambda text: [*plain.encode(text or "", add_special_tokens=False).ids, 0])
