"""The pipeline against a brute-force version, stage by stage, on small tables."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import _best, _covered, _fingerprint, _plain

import corpus_pipeline
from weftspark.llm import decontam, quality, registry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    d = tmp_path_factory.mktemp("tables")

    def good(n):
        return " ".join("".join(rng.choice(["the", "re", "in", "on", "an", "er"]) for _ in range(rng.randint(1, 4))) for _ in range(n))

    items = [good(n) for n in (12, 30, 50)]
    passage = good(80)
    texts = [good(rng.randint(5, 200)) for _ in range(120)]
    texts += [" ".join(rng.choice(["$$$", "###", "&&&", "BUY!!", "| x"]) + rng.choice("abcd") for _ in range(rng.randint(5, 200))) for _ in range(120)]
    texts += [texts[0], texts[0], texts[5] + " end", f"{good(30)} {passage} {good(40)}", f"{good(25)} {passage}", f"{good(30)}\n{items[1]}\n{good(20)}", f"{items[2]} {good(90)}", None, "", "   "]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, items


def test_stages_have_the_given_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring", "decontamination", "sentencepiece"]


def test_pipeline(spark, folder):
    import sentencepiece

    d, rows, items = folder
    docs = {i: t for i, t, *_ in rows}
    model = quality.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"), F.lit(True))
    use = quality._compressors(model.good, model.bad, model.trained)
    kept = {i: t for i, t in docs.items() if quality._logistic(quality._differences([t], use), model.slope, model.offset)[0] >= quality.THRESHOLD}
    assert sum(i < 120 for i in kept) > 110 and sum(120 <= i < 240 for i in kept) < 10
    fp = {i: _fingerprint(t) for i, t in kept.items()}
    label = {i: i for i in kept}
    for _ in range(5):
        label = {i: min(label[j] for j in kept if bin(fp[i] ^ fp[j]).count("1") <= 3) for i in kept}
    kept = {i: t for i, t in kept.items() if label[i] == i}
    order = sorted(kept)
    for i, (w, gone) in zip(order, _covered([(i, kept[i]) for i in order], 50), strict=True):
        if gone:
            kept[i] = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
    plain = [_plain(x) for x in items]
    kept = {i: t for i, t in kept.items() if all(_best(a, _plain(t)) < decontam.SIMILARITY * 2 * len(a) for a in plain)}
    lib = sentencepiece.SentencePieceProcessor(model_file=registry.tokenizer_path())
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, d).collect()}
    assert got == {i: [*lib.encode(t or ""), lib.eos_id()] for i, t in kept.items()}


def test_stages_keep_the_columns(spark, folder):
    d = folder[0]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(r.n_chars == len(r.text or "") for r in docs.collect())


def test_pipeline_of_nothing(spark, folder, tmp_path):
    d = folder[0]
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").where("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
