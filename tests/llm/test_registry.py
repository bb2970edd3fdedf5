"""The registered queries, columns and all, on the smallest tables."""

import collections
import hashlib
import os
import zlib

import duckdb
import pytest
from test_operators import _base, _best, _fingerprint, _plain

import corpus_pipeline
from weftspark.llm import decontam, quality, registry

DATA = os.environ.get("WEFT_TEST_DATA", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def run(spark, name):
    df = registry.queries()[name](spark, DATA)
    return df.columns, df.collect()


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    columns, rows = run(spark, name)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(columns) == sorted(names)
    assert collections.Counter(tuple(str(r[c]) for c in names) for r in rows) == collections.Counter(tuple(map(str, r)) for r in found.fetchall())


def test_op2(spark, documents):
    columns, rows = run(spark, "op2_sharding")
    assert columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.grown_shard) for r in rows} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode()), "rows", None) for i, t in documents.items()}
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(16)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(rows) == len(documents)


def test_op5(spark, documents):
    columns, rows = run(spark, "op5_simhash")
    assert columns == ["doc_id", "fingerprint", "component_id"]
    fp = {i: _fingerprint(t) for i, t in documents.items()}
    label = {i: i for i in documents}
    for _ in range(5):
        label = {i: min(label[j] for j in documents if (fp[i] ^ fp[j]).bit_count() <= 3) for i in documents}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{fp[i]:016x}", label[i]) for i in documents}


def test_op7(spark, documents):
    columns, rows = run(spark, "op7_quality")
    assert columns == ["doc_id", "held_out", "score", "predicted"] and len(rows) == len(documents)
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    seen = [(r.score, labels[r.doc_id]) for r in rows if labels.get(r.doc_id) is not None]
    better = [(a > b) + (a == b) / 2 for a, y in seen if y == 1 for b, z in seen if z == 0]
    assert sum(better) / len(better) > 0.9


def test_op8(spark, documents):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=registry.tokenizer_path())
    columns, rows = run(spark, "op8_sentencepiece")
    assert columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    wanted = {}
    for i, t in documents.items():
        ids = [*lib.encode(t), lib.eos_id()]
        wanted[i] = len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids))
    assert {r.doc_id: tuple(r)[1:] for r in rows} == wanted


def test_op9(spark, documents):
    rows = run(spark, "op9_decontamination")[1]
    items = {r.item_id: _plain(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.score for r in rows}
    plain = {i: _plain(t) for i, t in documents.items()}
    # all pairs with half of an item's words in common, which a similarity of 0.5 needs
    wanted = {}
    for i, w in plain.items():
        have = set(w)
        for k, a in items.items():
            if len(a) >= decontam.LEAST_WORDS and 2 * sum(x in have for x in a) >= len(a) and len(w) < 1500:
                s = _best(a, w) / (2 * len(a))
                if s >= decontam.SIMILARITY:
                    wanted[i, k] = s
    assert {x: s for x, s in got.items() if len(plain[x[0]]) < 1500} == pytest.approx(wanted) and wanted


def test_op10(spark, documents):
    columns, rows = run(spark, "op10_lm_scoring")
    assert {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"} <= set(columns)
    ids = sorted(documents)
    base = dict(zip(ids, _base([documents[i] for i in ids], [k for k, i in enumerate(ids) if crc(i) % 7 != 2]), strict=True))
    for r in rows:
        n, known, total, b = base[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id) % 7 == 2, n, known, total)
        assert r.base_score == pytest.approx(b, rel=1e-9) and r.score < 0
    assert len(rows) == len(documents)


def test_one_long_text_goes_through_every_stage(spark, tmp_path):
    """Twelve megabytes in one row, beside a short one that is part of it."""
    word = [f"w{k * 7919 % 99991}" for k in range(60_000)]
    long = " ".join(word[(k * k + k // 60_000) % 60_000] for k in range(2_000_000))
    rows = [(1, long, "en", "a", len(long)), (2, " ".join(long.split(" ", 400)[100:300]), "en", "a", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    item = " ".join(long.split(" ", 200)[150:190])
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(5, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        got[name] = {r.doc_id: r for r in stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert set(got["quality"]) == set(got["near_dedup"]) == set(got["substring"]) == set(got["sentencepiece"]) == {1, 2}
    assert got["substring"][2].text == "" and got["substring"][1].text == long
    assert set(got["decontamination"]) == set()
    assert got["sentencepiece"][1].n_tokens > 2_000_000


def test_stages_with_awkward_rows(spark, tmp_path):
    """Null ids, repeated ids and rows, null texts, and columns whose names clash with results'."""
    good = " ".join(f"the{k % 17} on re{k % 5}in" for k in range(120))
    rows = [(None, good, 1, 1.0), (3, good, 2, 2.0), (3, good + " end", 3, 3.0), (4, None, 4, 4.0), (None, None, 5, 5.0), (6, "", 6, 6.0), (7, "other words altogether", 7, 7.0), (7, "other words altogether", 7, 7.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans long, score double")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this is anywhere at all in here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = out
    got = collections.Counter((r.doc_id, r.spans) for r in docs.collect())
    # null ids stay, both rows of 3 stay together, and of 4, 6 and equal texts the smallest id
    assert got == collections.Counter([(None, 1), (None, 5), (3, 2), (3, 3), (4, 4), (7, 7), (7, 7)])
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 7


def test_all_rows_stay_without_a_model(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert quality.keep_good(docs, quality.Model()).count() == 2
