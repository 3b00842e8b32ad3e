"""Each stage of the pipeline on its own input."""

import numpy as np
import public_tokenizers

import corpus_pipeline
from eventspark.llm import compression_quality, gray_simhash, prefix_viterbi, pu_toxicity, source_mixing

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    toxic = pu_toxicity.fit(docs, labels)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before, after = docs.collect(), out.collect()
        if name == "toxicity":
            want = sorted(r["doc_id"] for r in before if toxic.score(r["text"], {}) < 0.5)
        elif name == "quality":
            model = compression_quality.fit(docs, labels)
            want = sorted(r["doc_id"] for r in before if model.score(r["text"]) >= 0.3)
        elif name == "simhash":
            from tests.llm.test_simhash import brute_fingerprint, brute_groups

            ids = [r["doc_id"] for r in before]
            want = sorted(set(brute_groups(ids, [brute_fingerprint(r["text"]) for r in before])))
        elif name == "mixing":
            want = sorted(i for r in source_mixing.plan(docs).collect() if r["size"] for i in [r["doc_id"]] * -(-r["taken"] // r["size"]))
        else:
            want = sorted(r["doc_id"] for r in before)
            pieces = prefix_viterbi.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
            texts = sorted((r["doc_id"], prefix_viterbi.decode_ids(r["ids"], pieces)) for r in after)
            assert texts == sorted((r["doc_id"], r["text"]) for r in before)
        assert sorted(r["doc_id"] for r in after) == want, name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        docs = out
    whole = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, whole)) == sorted((r["doc_id"], r["n_tokens"]) for r in docs.collect())
    assert np.all([r["n_tokens"] > 0 for r in whole])


def test_stages_on_odd_rows_and_on_none(spark, odd_docs):
    """Nulls, empty and long texts, repeated rows and clashing names go through every stage, as does an empty table."""
    docs = odd_docs.withColumnRenamed("score", "__mix_size").withColumnRenamed("label", "__near_id")
    for rows in (docs, docs.limit(0)):
        now = rows
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            now = corpus_pipeline.store(stage(spark, now, SF), name)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == docs.columns and [f.dataType for f in now.schema] == [f.dataType for f in docs.schema], name
        assert (now.count() > 0) == (rows is docs)


def test_toxicity_and_quality_stages_by_plain_scores(spark):
    """The decisions of both stages from the fitted numbers, worked out without the scoring code."""
    import zstandard

    labels, docs = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "documents"))
    toxic = pu_toxicity.fit(docs, labels)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()}
    weight = {f: toxic.weights[k] for f, k in toxic.index.items()}
    rows = docs.collect()
    for r in rows:
        z = toxic.bias + sum(weight.get(f, 0.0) for f in pu_toxicity.text_features(r["text"] or ""))
        assert (r["doc_id"] in kept) == (1 / (1 + np.exp(-z)) < 0.5)
    quality = compression_quality.fit(docs, labels)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_low_quality(spark, docs, SF).collect()}
    pack = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            for d in (quality.good, quality.bad)]
    for r in rows:
        data = (r["text"] or "").encode()
        good, bad = (sum(len(c.compress(data[at:at + 1024])) for at in range(0, len(data), 1024)) for c in pack)
        z = quality.slope * (bad - good) / max(len(data), 1) + quality.offset
        assert (r["doc_id"] in kept) == (1 / (1 + np.exp(-z)) >= 0.3)


def test_mixing_stage_by_plain_budgets(spark):
    """Each source's words by the targets worked out plainly, whole documents in order of their keys, one in part."""
    from tests.llm.test_mixing import brute_targets, size_of

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, out = docs.collect(), corpus_pipeline.mix_sources(spark, docs, SF).collect()
    sizes, words, source = {}, {}, {}
    for r in rows:
        source[r["doc_id"]] = r["source"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + size_of(r["text"])
    want, text = brute_targets(sizes), {r["doc_id"]: r["text"] for r in rows}
    for r in out:
        words[source[r["doc_id"]]] = words.get(source[r["doc_id"]], 0) + size_of(r["text"])
        assert (text[r["doc_id"]] or "").startswith(r["text"]) and r["source"] == source[r["doc_id"]]
    assert all(abs(words.get(s, 0) - t) <= 0.5 for s, t in want.items())
    assert sum(r["text"] != text[r["doc_id"]] for r in out) <= len(sizes)
