from collections import Counter

import zstandard
from tokenizers import Tokenizer

import corpus_pipeline as c
from tests.llm import plain
from tidelog.llm import packing, quality_rules


def test_stages(spark, sf, folder):
    path = folder(documents=spark.read.parquet(f"{sf}/documents.parquet"))
    now = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in c.STAGES:
        before = now
        out = stage(spark, before, path)
        out.write.parquet(f"{path}/{name}")
        now = spark.read.parquet(f"{path}/{name}")
        seen[name] = (before.collect(), now.collect())
        if name != c.STAGES[-1][0]:
            assert now.columns == before.columns
    ins, outs = seen["quality_rules"]
    want, packer = Counter(), zstandard.ZstdCompressor(level=3)
    for r in ins:
        raw = (r["text"] or "").encode()
        base = plain.base_counts(r["text"])
        if not quality_rules.base_failed(base[0], base[4]) and quality_rules.compression(raw, quality_rules.Bands(), packer)[3]:
            want[(r["doc_id"], r["text"])] += 1
    assert Counter((r["doc_id"], r["text"]) for r in outs) == want and outs
    ins, outs = seen["ngram_jaccard_join"]
    roots, _ = plain.jaccard_groups([r["text"] for r in ins], 5, 80)
    assert len(outs) == len(set(roots)) and len(outs) < len(ins)
    ins, outs = seen["suffix_array_dedup"]
    want = {}
    for r, (raw, mask) in zip(ins, plain.repeated([r["text"] for r in ins], 400)):
        left = bytes(b for b, m in zip(raw, mask) if not m).decode("utf-8", "ignore")
        if left.strip():
            want[(r["doc_id"], left)] = 1
    assert {(r["doc_id"], r["text"]) for r in outs} == set(want)
    ins, outs = seen["mixing"]
    assert {(r["doc_id"], r["text"]) for r in outs} <= {(r["doc_id"], r["text"]) for r in ins}
    ins, outs = seen["packing"]
    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for r in ins:
        want[r["doc_id"]] += len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in outs:
        got[r["doc_id"]] += r["length"]
    assert got == want


def test_run_on_nulls_clashes_and_repeats(spark, docs, folder):
    out = c.run(spark, folder(documents=docs))
    assert out.count() > 0 and out.filter("length < 1").count() == 0


def test_run_on_an_empty_table(spark, none, folder):
    assert c.run(spark, folder(documents=none)).count() == 0
