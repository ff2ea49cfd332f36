"""The pipeline's stages against plain Python on the smallest tables."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from quillgrid.llm import bpe
from quillgrid.llm.common import table
from tests.llm.test_corpus import WORDS, plain_copies, plain_lines, plain_targets


def test_stages(spark, small, tmp_path):
    docs = table(spark, small, "documents")
    columns, rows = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{name}")
        rows[name] = (docs.collect(), (docs := spark.read.parquet(f"{tmp_path}/{name}")).collect())
        assert name == "bpe" or docs.columns == columns
    labels = {r["doc_id"]: r["quality"] for r in table(spark, small, "labels").collect()}
    before, after = rows["quality"]
    kept = {r["doc_id"] for r in after}
    right = [(r["doc_id"] in kept) == bool(labels[r["doc_id"]]) for r in before if r["doc_id"] in labels]
    assert sum(right) / len(right) > 0.9
    before, after = rows["linededup"]
    assert sorted(plain_lines([(r["doc_id"], r["source"], r["text"]) for r in before])) == sorted((r["doc_id"], r["text"]) for r in after)
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = rows["simhash"]
    roots = plain_copies([r["text"] for r in before])
    least = {}
    for r, root in zip(before, roots, strict=True):
        least[root] = min(r["doc_id"], least.get(root, r["doc_id"]))
    assert sorted(least.values()) == sorted(r["doc_id"] for r in after)
    before, after = rows["mixing"]
    words = lambda t: len(WORDS.findall(t or ""))
    sizes, taken = Counter(), defaultdict(int)
    for r in before:
        sizes[r["source"]] += words(r["text"])
    for r in after:
        taken[r["source"]] += words(r["text"])
    assert dict(taken) == {s: round(x) for s, x in plain_targets(dict(sizes)).items() if round(x)}
    tok = bpe._tokenizer(bpe.read_tokenizer(bpe.default_tokenizer()))
    before, after = rows["bpe"]
    want = Counter((r["doc_id"], tuple(tok.encode(r["text"], add_special_tokens=False).ids)) for r in before)
    assert want == Counter((r["doc_id"], tuple(r["ids"])) for r in after)


def test_stages_on_odd_documents(spark, small, odd_docs, no_docs, tmp_path):
    """Nulls, ties, repeated rows, a clashing column and no rows at all pass through every stage."""
    clash = odd_docs.withColumns({c: F.lit("mine") for c in ("predicted", "lines", "fp", "size", "ids", "n_tokens", "__hash")})
    for kind, docs in (("odd", clash), ("none", no_docs)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, small).write.parquet(f"{tmp_path}/{kind}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{kind}-{name}")
            assert name == "bpe" or docs.columns == columns
            assert name == "bpe" or {r["score"] for r in docs.collect()} <= {"clash"}
        assert (docs.count() > 0) == (kind == "odd")


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0
