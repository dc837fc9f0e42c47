import hashlib
import math

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm import mixing, toxicity
from tidemark.llm.common import read
from tidemark.llm.pieces import MODEL
from tidemark.llm.pii import base


def test_stages_by_themselves(spark, sf_dir, tmp_path):
    """Each stage takes what the one before wrote; all but the last keep the columns of documents."""
    docs = read(spark, sf_dir, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    toxic, single, redacted, _ = sizes[1:5]
    assert sizes[0] >= toxic >= single == redacted > 0.7 * sizes[0]
    assert not any(base(r["text"]) for r in spark.read.parquet(f"{tmp_path}/2").collect())
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    for r in docs.collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True) and r["decoded"] == library.decode(r["ids"])
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.columns == docs.columns and whole.count() == sizes[-1]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_rows_pass_each_stage(spark, sf_dir, odd, empty, tmp_path, name, stage):
    """Nulls, empty and very long texts, repeats, an empty table, and columns named like those of the operators."""
    for k, docs in enumerate((odd, empty)):
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}-out")
        found = spark.read.parquet(f"{tmp_path}/{k}-out")
        if name != "sentencepiece":
            assert found.schema == docs.schema
            changed = ("text", "n_chars") if name == "pii" else ()
            same = [f"`{c.replace('`', '``')}`" for c in docs.columns if c not in changed]
            assert found.select(*same).distinct().exceptAll(docs.select(*same).distinct()).isEmpty()
        rows = {"toxicity": docs.count(), "simhash": min(6, docs.count()), "pii": docs.count(), "sentencepiece": docs.count()}
        if name in rows:
            assert found.count() == rows[name]
    assert found.isEmpty()


def near(a, b):
    a, b = ({" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in (a.split(), b.split()))
    return len(a & b) >= 0.8 * len(a | b)


def test_stages_against_brute_force(spark, sf_dir):
    """Toxicity by the plain formula, near copies by all pairs of shingle sets, counts of the mixture by inversion."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    clean = [r for r in rows if toxicity.noisy_or([z for *_, z in model.sentences(r["text"] or "")]) < 0.5]
    kept = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert sorted(r["doc_id"] for r in kept.collect()) == [r["doc_id"] for r in clean]

    lower = [("".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")) for r in clean]
    root = list(range(len(clean)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(clean)):
        for i in range(j):
            if (a := find(i)) != (b := find(j)) and near(lower[i], lower[j]):
                root[max(a, b)] = min(a, b)
    single = corpus_pipeline.drop_near_duplicates(spark, kept, sf_dir)
    assert sorted(r["doc_id"] for r in single.collect()) == [clean[i]["doc_id"] for i in range(len(clean)) if root[i] == i]

    mixed = corpus_pipeline.mix_sources(spark, single, sf_dir).groupBy("doc_id").count().collect()
    table = {r["bucket"]: r for r in mixing.rates(single, mixing.WEIGHTS).collect()}
    counts = {r["doc_id"]: r["count"] for r in mixed}
    for r in single.collect():
        rate = table[r["source"] if r["source"] in mixing.WEIGHTS else mixing.OTHERS]
        assert counts.get(r["doc_id"], 0) == sum(inverted(r["doc_id"], part, rate["rate"] / rate["parts"]) for part in range(1, rate["parts"] + 1))


def inverted(doc_id, part, mean):
    """The Poisson count at the uniform of (doc_id, seed, part)."""
    u = int(hashlib.md5(f"{doc_id}:{mixing.SEED}:{part}".encode()).hexdigest()[:13], 16) / 2**52
    k, p = 0, math.exp(-mean)
    total = p
    while total <= u and k < mixing.TERMS:
        k += 1
        p *= mean / k
        total += p
    return k if total > u else k + 1
