"""Each operator against a brute-force version on a small table with awkward rows."""

import collections
import hashlib
import math
import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from weftspark.llm import chat, common, components, decontam, embeddings, lm, mixing, pieces, quality, registry, sharding, simhash, substring, warc

LOW = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))


def words(text):
    return (text or "").encode().split()


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_word_spans_and_steps(texts):
    raw, off = common.texts_of(pa.array(texts))
    for lo, hi in common.steps(off, 500):
        part = raw[off[lo] : off[hi]]
        a, b, first = common.word_spans(part, off[lo : hi + 1] - off[lo])
        for k in range(lo, hi):
            got = [part[x:y].tobytes() for x, y in zip(a[first[k - lo] : first[k - lo + 1]], b[first[k - lo] : first[k - lo + 1]], strict=True)]
            assert got == words(texts[k])


@pytest.mark.parametrize("most,overlap", [(300, 0), (300, 4), (1, 1)])
def test_text_steps(texts, most, overlap):
    """Each sequence of overlap + 1 words is in one part, at its place."""
    raw, off = common.texts_of(pa.array(texts))
    got = collections.defaultdict(dict)
    for lo, hi, part, at, before in common.text_steps(raw, off, overlap, most):
        a, b, first = common.word_spans(part, at)
        for k in range(lo, hi):
            own = [part[x:y].tobytes() for x, y in zip(a[first[k - lo] : first[k - lo + 1]], b[first[k - lo] : first[k - lo + 1]], strict=True)]
            for i in range(len(own) - overlap):
                assert before + i not in got[k]
                got[k][before + i] = own[i : i + overlap + 1]
    for k, t in enumerate(texts):
        w = words(t)
        assert got[k] == {i: w[i : i + overlap + 1] for i in range(len(w) - overlap)}


def test_hashes(monkeypatch):
    rng = random.Random(7)
    text = " ".join("".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 3, 30, 200]))) for _ in range(300)).encode()
    raw = np.frombuffer(text, np.uint8)
    a, b, _ = common.word_spans(raw, np.array([0, len(raw)]))
    whole = common.word_hashes(raw, a, b)
    seen = collections.defaultdict(set)
    for w, h in zip(text.split(), whole.tolist(), strict=True):
        seen[w].add(h)
    assert all(len(x) == 1 for x in seen.values()) and len(set().union(*seen.values())) == len(seen)
    common._powers.cache_clear()
    monkeypatch.setattr(common, "_REACH", 16)
    assert common.word_hashes(raw, a, b).tolist() == whole.tolist()
    common._powers.cache_clear()
    for width in (1, 2, 5, 12, 50):
        h = common.window_hashes(whole, width, common.WORD_BASE).tolist()
        again = [common.window_hashes(whole[i : i + width], width, common.WORD_BASE)[0] for i in range(0, 250, 7)]
        assert len(h) == 301 - width and again == h[:250:7]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(40)] + [(1000, i) for i in range(500, 600)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    got = dict(rows(components.components(spark.createDataFrame(edges, "u long, v long"))))
    assert got == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert rows(components.components(spark.createDataFrame([], "u long, v long"))) == []


# 1

def _vectors():
    """Two labels of loose clusters, a dense ball, equal vectors, vectors that link with nothing, repeated ids, null ids."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((7, 16))
    out, n = [], 0
    for k, c in enumerate(centres):
        for _ in range(50):
            out.append((n, [float(x) for x in (c + rng.standard_normal(16) * (0.01 if k == 6 else 0.12)).astype(np.float32)], k % 2))
            n += 1
    out += [(n, out[0][1], 0), (n + 1, out[0][1], 1), (n + 2, None, 0), (n + 3, [0.0] * 16, 0), (n + 4, [float("nan")] * 16, 0), (n + 5, [1.0, None] + [0.0] * 14, 0), (n + 6, out[0][1], None), (n + 7, [], 0), (n + 8, [2 * x for x in out[0][1]], 0), (n + 9, [1.0] * 8, 0), (n + 10, [0.0, -0.0] + [1.0] * 14, 1), (n + 11, [-0.0, 0.0] + [1.0] * 14, 1)]
    # one id with two vectors of different clusters, one with the same twice, and rows without id
    out += [(5, out[320][1], 0), (120, out[330][1], 0), (7, out[7][1], 0), (None, out[0][1], 0), (None, out[1][1], 0)]
    return out


@pytest.mark.parametrize("block,tile,crowd", [(512, 4096, 1024), (8, 4096, 4), (8, 6, 40)])
def test_embeddings(spark, monkeypatch, block, tile, crowd):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "TILE", tile)
    monkeypatch.setattr(embeddings, "CROWD", crowd)
    monkeypatch.setattr(embeddings, "STRIP", 16)
    data = _vectors()
    df = spark.createDataFrame([(*r, 5) for r in data], "vec_id long, embedding array<float>, label int, n_links int").repartition(3)
    got = collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect())
    fine = [k for k, (i, v, y) in enumerate(data) if i is not None and v and y is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(data[k][1], float) / np.linalg.norm(np.array(data[k][1], float)) for k in fine}
    links, label = collections.Counter(), {k: data[k][0] for k in range(len(data))}
    pairs = [(a, b) for a in fine for b in fine if b < a and data[a][2] == data[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in range(10):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    wanted = collections.Counter((i, links[k], label[k], i is None or label[k] == i) for k, (i, *_) in enumerate(data))
    assert got == wanted


def test_embeddings_of_nothing(spark):
    assert rows(embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))) == []


# 2

def test_sharding(docs, texts, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 4000)
    out = [(r.doc_id, r.text, r.shard, r.slot) for r in sharding.shard(docs, 7, seed=3).collect()]
    again = [(r.doc_id, r.text, r.shard, r.slot) for r in sharding.shard(docs, 7, seed=3).collect()]
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert collections.Counter((i, t) for i, t, *_ in out) == collections.Counter([*enumerate(texts), (None, "no id at all")])
    slots = collections.defaultdict(list)
    for _, _, s, k in out:
        slots[s].append(k)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 7
    other = [(r.doc_id, r.shard, r.slot) for r in sharding.shard(docs, 7, seed=4).collect()]
    assert sorted(map(str, other)) != sorted(str((i, s, k)) for i, _, s, k in out)


def test_sharding_deals_buckets_evenly(docs, monkeypatch):
    """Two buckets to a task, without another exchange for the groups."""
    out = sharding.scatter_and_shuffle(docs, 3, "doc_id", "text", 9)
    got = {r.bucket: r.p for r in out.select("bucket", F.spark_partition_id().alias("p")).distinct().collect()}
    assert got == {b: b // 2 for b in range(9)}


def test_sharding_hot_rows(spark):
    df = spark.createDataFrame([(None, "same")] * 500, "doc_id long, text string").repartition(2)
    got = collections.Counter(r.shard for r in sharding.shard(df, 16).collect())
    assert sum(got.values()) == 500 and max(got.values()) - min(got.values()) <= 1


def test_sharding_of_nothing(no_docs):
    assert rows(sharding.shard(no_docs, 4)) == []


def test_write_shards(spark, docs, tmp_path):
    sharded = common.save(sharding.shard(docs, 3), "test")
    sharding.write_shards(sharded, str(tmp_path / "out"), 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


# 3

def test_warc(spark, tmp_path):
    tricky = "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 5
    html = [("a" * 99, 0), ("a" * 99, 1), ("b" * 100, 2), ("b" * 100, 3), ("é" * 50, 4), (None, 5), ("", 6), (tricky, 7), (tricky, 8), ("z" * 70_000, 9), ("b" * 100, None)]
    twice = [("q" * 120, 20), ("r" * 130, 20), ("q" * 120, 21), ("s" * 5, 22), ("s" * 5, 22)]  # one id, several rows
    pages = spark.createDataFrame([(i, None if i == 4 else f"http://www.Host{(i or 0) % 2}.org/p?b=1&a=2#f\r\nx", h, "c") for h, i in html + twice], "page_id long, url string, html string, refers_to string").repartition(3)
    out = warc.archive_pages(pages, str(tmp_path / "w"))
    got = {r.page_id: r for r in out.collect()}
    again = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in out.where("page_id >= 20").collect())
    assert again == {(20, 120, "response", None): 1, (20, 130, "response", None): 1, (21, 120, "revisit", 20): 1, (22, 5, "response", None): 2}
    first = {}
    for h, i in sorted((h or "", i) for h, i in html if i is not None):
        first.setdefault(h, i)
    for h, i in html:
        raw = (h or "").encode()
        seen = first[h or ""] if len(raw) >= 100 and i is not None and first[h or ""] != i else None
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), hashlib.sha256(raw).hexdigest(), "response" if seen is None else "revisit", seen)
    keys = [(r.url_key, r.captured_at, r.page_id if r.page_id is not None else -1) for r in out.collect()]
    assert keys == sorted(keys)


def test_loser_tree():
    rng = random.Random(2)
    for k in range(0, 12):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        got = list(warc.LoserTree([iter([(x, x) for x in r]) for r in runs]))
        assert got == sorted(x for r in runs for x in r)


@pytest.mark.parametrize("a,b", [("http://www.A.org/x", "https://a.org/x"), ("http://a.org", "http://a.org/"), ("http://a.org/?b=1&a=2", "http://a.org/?a=2&b=1"), ("http://a.org/x#f", "http://a.org/x")])
def test_url_key_joins(a, b):
    assert warc.url_key(a) == warc.url_key(b)


def test_url_key_of_nothing():
    assert warc.url_key(None) == warc.url_key("") and warc.url_key("http://[bad") == "http://[bad"


def test_warc_of_nothing(spark, tmp_path):
    assert rows(warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))) == []


# 4

def _covered(docs, window):
    seen = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            seen[key] = min(seen.get(key, i), i)
    out = []
    for i, t in docs:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((w, gone))
    return out


@pytest.mark.parametrize("window", [50, 7, 1])
def test_substring(docs, texts, window):
    got = {r.doc_id: r for r in substring.digest(docs, window).collect()}
    for i, (w, gone) in enumerate(_covered(list(enumerate(texts)), window)):
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    assert got[None].n_removed == 0


def test_substring_shuffled_join(docs, texts, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert sum(r.n_removed for r in substring.digest(docs).collect()) == sum(len(g) for _, g in _covered(list(enumerate(texts)), 50))


def test_substring_text(docs, texts):
    got = {r.doc_id: r.text for r in substring.remove_repeats(docs).collect()}
    for i, (w, gone) in enumerate(_covered(list(enumerate(texts)), 50)):
        assert got[i] == (b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else texts[i])


def test_substring_of_nothing(no_docs):
    assert rows(substring.digest(no_docs)) == []


# 5

def _fingerprint(text):
    w = (text or "").encode().translate(LOW).split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_fingerprints_are_sparks_xxhash64(spark):
    text = "ä b c"
    assert spark.createDataFrame([(text,)], "t string").select(F.xxhash64("t")).first()[0] % (1 << 64) == _fingerprint(text)


def test_simhash(docs, texts):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fp = [_fingerprint(t) for t in texts]
    assert all(got[i].fp % (1 << 64) == x for i, x in enumerate(fp))
    label = list(range(len(fp)))
    for _ in fp:
        label = [min([label[j] for j in range(len(fp)) if bin(fp[i] ^ fp[j]).count("1") <= 3]) for i in range(len(fp))]
    assert [got[i].component_id for i in range(len(fp))] == label
    assert got[None].component_id is None


@pytest.mark.parametrize("block", [2048, 5])
def test_simhash_links_lose_nothing(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    fps = {x for b in base for x in [b] + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 5))) for _ in range(25)]}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = {}
    for node, c in rows(components.components(simhash.links(df))):
        got.setdefault(c, set()).add(node % (1 << 64))
    rest, wanted = set(fps), set()
    while rest:
        todo, group = [rest.pop()], set()
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in rest if bin(x ^ y).count("1") <= 3}
            rest -= near
            todo += near
        if len(group) > 1:
            wanted.add(frozenset(group))
    assert {frozenset(g) for g in got.values()} == wanted


def test_simhash_keep_one(docs, texts):
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    near = {r.doc_id for r in simhash.near_duplicates(docs).collect() if r.doc_id is None or r.component_id == r.doc_id}
    assert kept == near


def test_simhash_of_nothing(no_docs):
    assert rows(simhash.near_duplicates(no_docs)) == []


# 6

SAY = "</s>[INST] ok [/INST]"


def test_chat(spark):
    template = chat.Template()
    convs = {1: [("system", "be <<SYS>> kind"), ("user", "hi \\ [INST"), ("assistant", "yo\\"), ("user", ""), ("assistant", "bye </s>")], 2: [("assistant", "first"), ("user", "[ROLE]x[TEXT]")], 3: [("tool", "[/ROLE] out"), ("user", "q"), ("assistant", "é🙂" * 50)], -1: [("user", SAY), ("assistant", SAY)], 5: [("user", None)], 6: [("user", "x" * 20000), ("assistant", "<s>" * 5000)], 7: [(None, "who"), ("we[TEXT]ird", "y")]}
    data = [(c, k, r, t, "z") for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, n_turns string").repartition(3)
    got = {r.conv_id: r for r in chat.read_back(chat.segments(df, template), template).collect()}
    for c, turns in convs.items():
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a or ''}\n{t or ''}\n" for a, t in turns).encode()).hexdigest()
        loss = "".join(t for a, t in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [c for c in sorted(convs) if got[c].valid] == [-1, 1, 6]


def test_chat_escapes():
    codec = chat.Codec(chat.Template())
    for t in ("", "\\", "\\\\", SAY, "<s></s><<SYS>>", "[ROLE\\]", "<\\s>", "\\<s>"):
        e = codec.escape(t)
        assert codec.unescape(e) == t and not any(c in e for c in codec.template.controls())


def test_chat_repeated_rows_and_nothing(spark):
    template = chat.Template()
    df = spark.createDataFrame([(None, None, "user", "a")] * 3, "conv_id long, turn long, role string, text string")
    r = chat.read_back(chat.segments(df, template), template).collect()
    assert len(r) == 1 and r[0].n_turns == 3 and r[0].conv_id is None
    assert rows(chat.read_back(chat.segments(df.where("false"), template), template)) == []


# 7

def _labelled(spark):
    rng = random.Random(4)
    good = [" ".join("".join(rng.choice(["the", "re", "in", "on", "an", "er"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 200))) for _ in range(300)]
    bad = [" ".join(rng.choice(["$$$", "###", "&&&", "BUY!!", "| x"]) + rng.choice("abcd") for _ in range(rng.randint(5, 200))) for _ in range(300)]
    docs = [(i, t) for i, t in enumerate(good + bad)] + [(9000, ""), (9001, None), (None, "x"), (9002, "w" * 50_000)]
    labels = [(i, int(i < 300), 0) for i in range(600)] + [(9001, 1, 0), (None, 1, 0), (7, 1, 1), (99999, 0, 0), (8, None, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("s")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = _labelled(spark)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = quality.fit(docs, labels, ~held)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(got) == docs.count() and all(0 <= s <= 1 for s in got.values())
    test = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= quality.THRESHOLD) == (i < 300) for i in test) / len(test) > 0.95
    kept = {r.doc_id for r in quality.keep_good(docs, model).collect()}
    assert kept == {i for i, s in got.items() if s >= quality.THRESHOLD}


def test_quality_scores_are_those_of_two_compressors(spark):
    """Each score from the model's dictionaries by fresh compressors, and the calibration's slope where the weighted likelihood is flat; repeated and null ids."""
    import zstandard

    docs, labels = _labelled(spark)
    docs = docs.union(docs.where("doc_id in (3, 400)")).union(spark.createDataFrame([(3, "$$$a BUY!!b", "s")], docs.schema))
    model = quality.fit(docs, labels, F.lit(True))
    assert model.known and model.trained

    def size(book, raw):
        c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(book), write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(c.compress(raw))

    def x(text):
        raw = (text or "").encode()
        return (size(model.bad, raw) - size(model.good, raw)) / (len(raw) + 1) ** 0.5

    every = docs.collect()
    wanted = collections.Counter((r.doc_id, round(1 / (1 + math.exp(-max(-30, min(30, model.slope * x(r.text) + model.offset)))), 6)) for r in every)
    assert collections.Counter((r.doc_id, round(r.score, 6)) for r in quality.score(docs, model).collect()) == wanted
    good, bad = ([x(r.text) for r in every if r.doc_id in ids] for ids in (range(300), range(300, 600)))
    best = sum(a > b for a in good for b in bad) / len(good) / len(bad)
    assert best > 0.95 and model.slope > 0


def test_fitting_reads_the_corpus_once(spark, tmp_path, monkeypatch):
    docs, labels = _labelled(spark)
    docs.write.parquet(f"{tmp_path}/docs")
    plans, whole = [], common.save
    monkeypatch.setattr(common, "save", lambda df, name: (plans.append(df), whole(df, name))[1])
    stored = spark.read.parquet(f"{tmp_path}/docs")
    quality.fit(stored, labels, F.lit(True))
    (plan,) = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert plan.split("Initial Plan")[0].count(f"{tmp_path}/docs") == 1


def test_quality_without_labels(spark, docs):
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), F.lit(True))
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5}


def test_quality_of_nothing(spark, no_docs):
    model = quality.fit(no_docs, _labelled(spark)[1], F.lit(True))
    assert rows(quality.score(no_docs, model)) == []


# 8

EXTRA = [" ", "  ", "a  b ", " ▁x", "日本語テキスト🙂 ok", "</s> <s> <unk> <0x41>", "▁▁a b", "\x00a", "   " * 50, "a².b ²x", "é́a 1a2 _x_", "a b\x85c"]


def test_pieces(spark, texts):
    import sentencepiece

    path = registry.tokenizer_path()
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    every = [*texts, *EXTRA]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(every)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in pieces.encode_documents(df, path, with_ids=True).collect()}
    for i, t in enumerate(every):
        ids = [*lib.encode(t or ""), lib.eos_id()]
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def _codec():
    with open(registry.tokenizer_path(), "rb") as f:
        return pieces.PieceCodec(f.read())


def test_pieces_agendas_agree(monkeypatch):
    codec, rng = _codec(), random.Random(6)
    words = ["".join(rng.choice("abcdefghiéthx1.,日²") for _ in range(rng.randint(0, 31))) for _ in range(500)]
    matrix = codec.words(words)
    monkeypatch.setattr(pieces, "WIDTHS", ())
    heap = codec.words(words)
    assert matrix[0].tolist() == heap[0].tolist() and matrix[1].tolist() == heap[1].tolist()


@pytest.mark.parametrize("rows", [1 << 14, 3])
def test_pieces_batches(texts, monkeypatch, rows):
    monkeypatch.setattr(pieces, "ROWS", rows)
    codec = _codec()
    every = [t or "" for t in [*texts, *EXTRA]]
    ids, begin = codec.encode(every)
    assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:], strict=False)] == codec.library.encode(every)
    assert codec.encode([])[1].tolist() == [0] and codec.encode(["", ""])[1].tolist() == [0, 0, 0]


def test_pieces_differences_are_found():
    codec = _codec()
    codec.cost[codec.ids["▁the"]] = pieces.NEVER
    with pytest.raises(AssertionError):
        codec.encode(["the theme of these other things is another"])


def test_pair_table(monkeypatch):
    rng = random.Random(3)
    pairs = {(rng.randrange(40), rng.randrange(40)): k for k in range(600)}
    monkeypatch.setattr(pieces.PairTable, "BITS", 2)
    table = pieces.PairTable(pairs)
    a, b = np.divmod(np.arange(1600), 40)
    assert table.find(a, b).tolist() == [pairs.get((x, y), -1) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_pieces_of_nothing(no_docs):
    assert rows(pieces.encode_documents(no_docs, registry.tokenizer_path())) == []


# 9

def _plain(text):
    import re

    return re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def _best(a, b):
    h, top = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            top = max(top, h[i][j])
    return top


def test_lookup():
    rng = np.random.default_rng(4)
    table = np.unique(np.concatenate([rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2), np.arange(50, dtype=np.uint64)]))
    values = np.concatenate([rng.choice(table, 300), rng.integers(0, 1 << 63, 300).astype(np.uint64), np.arange(100, dtype=np.uint64)])
    at, place = decontam.Lookup(table).find(values)
    assert at.tolist() == np.flatnonzero(np.isin(values, table)).tolist() and (table[place] == values[at]).all()
    assert len(decontam.Lookup(table[:0]).find(values)[0]) == 0


@pytest.mark.parametrize("most", [decontam.BLOCK_BYTES, 0])
def test_decontamination(spark, texts, monkeypatch, most):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", most)
    rng = random.Random(8)
    items = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the", "rho", "tau", "phi"]) + str(rng.randrange(30)) for _ in range(n)) for n in (8, 20, 40, 60)]
    edited = " ".join(w if k % 6 else "EDIT" for k, w in enumerate(items[2].split()))
    data = [t for t in texts if t is None or len(t) < 4000] + [f"xx {items[0]}. yy", items[1].upper().replace(" ", ",\n "), f"pre {edited} post", " ".join(items[3].split()[:20]), f"{items[1]} and {items[3]} twice {items[1]}"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(data)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate([*items, "too short", None])], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.leaks(df, bench).collect()}
    wanted = {}
    for i, t in enumerate(data):
        for k, item in enumerate(items):
            a = _plain(item)
            s = _best(a, _plain(t)) / (2 * len(a))
            if s >= decontam.SIMILARITY:
                wanted[i, k] = s
    assert got.keys() == wanted.keys() and len(wanted) >= 5
    assert all(abs(got[x] - wanted[x]) < 1e-9 for x in wanted)
    kept = {r.doc_id for r in decontam.clean(df, bench).collect()}
    assert kept == set(range(len(data))) - {i for i, _ in wanted}


@pytest.mark.parametrize("most", [decontam.BLOCK_BYTES, 0])
def test_decontamination_of_dense_edits(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", most)
    """Copies with every few words replaced, lost or parted by others, beside common words, against alignment of all with all."""
    rng = random.Random(31)
    items = [[rng.choice(["of", "the", "in"]) if rng.random() < 0.4 else f"w{rng.randrange(400)}" for _ in range(n)] for n in (8, 9, 15, 24, 40, 41)]
    data = [" ".join(rng.choice(["of", "the", "in"]) if rng.random() < 0.5 else f"w{rng.randrange(400)}" for _ in range(120)).split() for _ in range(20)]
    for item in items:
        for step in (2, 3, 4, 5):
            for shift in range(step):
                data.append(["x"] * 3 + ["new" if k % step == shift else w for k, w in enumerate(item)] + ["y"] * 3)
                data.append([w for k, w in enumerate(item) if k % step != shift])
        for step in (1, 2, 3):
            data.append([x for k, w in enumerate(item) for x in ([w, "new"] if k % step == 0 else [w])])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(data)], "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    wanted = {(i, k): _best(a, t) / (2 * len(a)) for i, t in enumerate(data) for k, a in enumerate(items)}
    for similarity in (0.5, 0.7):
        got = {(r.doc_id, r.item_id): r.score for r in decontam.leaks(df, bench, similarity).collect()}
        assert got == pytest.approx({x: s for x, s in wanted.items() if s >= similarity})
        assert len(got) > 50


@pytest.mark.parametrize("most", [decontam.BLOCK_BYTES, 0])
def test_decontamination_of_short_items(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", most)
    """Whole copies of short items, and items in scripts without spaces."""
    rng = random.Random(32)
    chinese = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(30))
    thai = "".join(chr(0xE01 + rng.randrange(40)) for _ in range(20))
    edited = "".join("\u6587" if k % 5 == 2 else c for k, c in enumerate(chinese))
    bench = [(0, "What is the capital of France?"), (1, "Name it"), (2, "forty-two"), (3, chinese), (4, thai), (5, "..."), (6, "name IT!"), (7, "\u4f60\u597dabc\u4e16"), (8, "no one has this")]
    data = ["So: what is the  capital of france", "what is the capital of", "name", "it name it it name it", "42 forty two", f"abc{chinese}def", "a\u3042" + edited, thai[:15] + "\u0e2f" + thai[15:], "x \u4f60\u597d abc\u4e16\u754c", "is the capital of france what", "", None, "forty", "two"]
    got = {(r.doc_id, r.item_id, r.start_word, r.end_word): r.score for r in decontam.leaks(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").repartition(1), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert {x[:2] for x in got} == {(0, 0), (3, 1), (3, 6), (4, 2), (5, 3), (6, 3), (7, 4), (8, 7)}
    assert got[0, 0, 1, 7] == 1 and got[3, 1, 1, 3] == 1 and got[4, 2, 1, 3] == 1 and got[5, 3, 1, 31] == 1 and got[8, 7, 1, 5] == 1


def test_alignment():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, 6, rng.integers(1, 20)).astype(np.uint64) for _ in range(2))
        score, lo, hi = decontam.align(a, b)
        assert score == _best(a.tolist(), b.tolist())
        assert score == 0 or decontam.align(a, b[lo:hi])[0] == score


def test_decontamination_by_joins(spark, docs, monkeypatch):
    """Items in tables give the rows of items that travel, ties, repeated rows, nulls and long texts among them."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(words, n))
    items = [(k, text(int(n))) for k, n in enumerate(rng.integers(1, 40, 40))]
    bench = spark.createDataFrame([*items, items[3], (3, text(20)), (50, None), (None, text(12)), (51, "")], "item_id long, text string")
    rows = [(k, text(30) + " " + items[k % 40][1] + " " + text(10)) for k in range(60)]
    rows += [(7, rows[0][1]), (None, rows[1][1]), (100, None), (101, ""), (102, text(60_000) + " " + items[30][1])]
    data = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    one = sorted(map(str, decontam.leaks(data, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 0)
    assert one == sorted(map(str, decontam.leaks(data, bench).collect())) and len(one) > 60


def test_clean_keeps_texts_with_a_short_item(spark):
    items = [(1, "Yes"), (2, "new york city"), (3, "one two three four five six seven eight nine ten")]
    docs = [(1, "yes it is a long text about nothing"), (2, "Yes"), (3, "oh yes"), (4, "in new york city one may say yes to all"), (5, "New York City"), (6, "so one two three four five six seven eight nine ten and more words follow"), (7, None), (None, "yes"), (2, "a text of the same id")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(d, b).where("doc_id is not null").collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (4, 2), (5, 2), (6, 3)}
    assert sorted((r.doc_id or 0, r.text or "") for r in decontam.clean(d, b).collect()) == sorted((i or 0, t or "") for i, t in docs if (i, t) not in [(2, "Yes"), (3, "oh yes"), (5, "New York City"), (6, docs[5][1])])


def test_decontamination_of_nothing(spark, no_docs, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert rows(decontam.leaks(no_docs, bench)) == [] and rows(decontam.leaks(docs, bench)) == []
    assert decontam.clean(docs, bench).count() == docs.count()


# 10

def _base(texts, train):
    count = collections.Counter()
    for i in train:
        count.update((texts[i] or "").encode().translate(LOW).split() + [b"\n"])
    n, v, out = sum(count.values()), len(count), []
    for t in texts:
        w = (t or "").encode().translate(LOW).split() + [b"\n"]
        out.append((len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)))
    return out


@pytest.mark.parametrize("head", [400_000, 20, 0])
def test_lm_base(docs, texts, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    got = {r.doc_id: r for r in lm.score(docs, F.col("doc_id") % 3 > 0).collect()}
    for i, (n, known, total, base) in enumerate(_base(texts, [i for i in range(len(texts)) if i % 3])):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0


def test_lm_bits_per_byte(docs, texts):
    for r in lm.score(docs, F.col("doc_id") % 3 > 0).where("doc_id is not null").collect():
        n = len(b" ".join(words(texts[r.doc_id]))) + 1
        assert r.n_bytes == n
        assert r.bits == pytest.approx(-r.score * math.log2(10)) and r.bits_per_byte == pytest.approx(r.bits / n)


def test_lm_beats_its_code_and_an_untrained_model():
    """On held-out texts of words from a small lexicon."""
    rng = random.Random(12)
    lexicon = ["".join(rng.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(rng.randint(1, 4))) for _ in range(800)]
    texts = [" ".join(rng.choice(lexicon) for _ in range(300)) for _ in range(220)]
    stream, held = (mixing.Stream(*common.texts_of(pa.array(t))) for t in (texts[:200], texts[200:]))
    code = mixing.Code(np.bincount(stream.pairs(), minlength=1 << 16))
    learner, empty = mixing.Learner(code, mixing.BITS), mixing.Learner(code, mixing.BITS)
    learner.learn(stream)
    bits = [-mixing.Scorer(code, [mixing.odds(x.counts(k)) for k in range(4)], x.weights).score(held).sum() / math.log(2) for x in (learner, empty)]
    plain = code.length[held.pairs()].sum()
    assert bits[0] < 0.8 * plain and bits[1] > 0.9 * plain


@pytest.mark.parametrize("seen", [0, 1 << 23])
def test_lm_weights_learn_from_all_bits(seen):
    """Bit by bit, however many have been seen before."""
    rng = random.Random(13)
    stream = mixing.Stream(*common.texts_of(pa.array([" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(6000)) for _ in range(2)])))
    code = mixing.Code(np.bincount(stream.pairs(), minlength=1 << 16))
    learner = mixing.Learner(code, mixing.sizes(1 << 20))
    learner.seen = seen
    learner.learn(stream)
    counts, weights = [collections.Counter() for _ in mixing.BITS], np.full((mixing.GATES, len(mixing.ORDERS)), 0.3)
    contexts = stream.contexts(mixing.sizes(1 << 20))
    for lo in stream.chunks():
        slots, bit, _ = mixing.bits_of(stream, contexts, code, lo)
        slots, bit = [s.tolist() for s in slots], bit.tolist()
        x = [[max(-mixing.MOST, min(mixing.MOST, math.log((c[s[i], 1] + 0.4) / (c[s[i], 0] + 0.4)))) for c, s in zip(counts, slots, strict=True)] for i in range(len(bit))]
        gates = collections.defaultdict(list)
        for i, v in enumerate(x):
            gates[sum(abs(v[-1]) > y for y in mixing.SURE)].append(i)
        for gate, own in gates.items():
            for a in range(0, len(own), mixing.BATCH):
                part = own[a : a + mixing.BATCH]
                weights[gate] = weights[gate] + mixing.LEARN * sum((bit[i] - 1 / (1 + math.exp(-weights[gate] @ np.array(x[i])))) * np.array(x[i]) for i in part)
        for c, s in zip(counts, slots, strict=True):
            c.update(zip(s, bit, strict=True))
    assert learner.weights == pytest.approx(weights, abs=2e-3) and abs(weights - 0.3).max() > 0.05
    for k, c in enumerate(counts):
        assert all(learner.counts(k)[s, v] == n for (s, v), n in c.items())
    assert len(mixing.ORDERS) == 4


def test_lm_tables_grow_and_counts_keep_their_odds():
    assert mixing.sizes(1 << 30) == mixing.BITS and mixing.sizes(1 << 34) == tuple(b + 2 for b in mixing.BITS) and min(mixing.sizes(0)) == mixing.LEAST_BITS
    stream = mixing.Stream(*common.texts_of(pa.array(["ab " * 40_000])))
    code = mixing.Code(np.bincount(stream.pairs(), minlength=1 << 16))
    learner = mixing.Learner(code, mixing.sizes(1 << 20))
    for _ in range(9):
        learner.learn(stream)
    every = np.concatenate([learner.counts(k) for k in range(4)])
    assert 1 << 14 < every.max() < 3 << 14 and (every.min(axis=1) < 100).all()


@pytest.mark.parametrize("halves", [[3, 2], [1]])
def test_lm_counts_are_added_whole(halves):
    """Sums of parts keep more than 32 bits."""
    part = np.array([60000, 1, 0, 60000], np.uint16)
    first = [b for n in halves for b in lm._added(iter([lm._parts([(1, 0, 0, lm._pack(part))] * n)]))]
    (last,) = lm._added(iter(first))
    assert lm._unpack(last.column(3)[0].as_py(), np.uint64).tolist() == [x * sum(halves) for x in part.tolist()]
    (big,) = lm._added(iter([lm._parts([(1, 0, -1, lm._pack(np.array([8 * 10**9, 5 * 10**9], np.uint64)))])]))
    assert mixing.odds(lm._unpack(big.column(3)[0].as_py(), np.uint64).reshape(-1, 2)).tolist() == [round(math.log(5 / 8) * mixing.STEP)]


def test_lm_learner_holds_its_room_and_scores_in_small_chunks(monkeypatch):
    """The learner's floats are made once, not chunk by chunk; scores are the same in chunks of any size."""
    rng = random.Random(15)
    stream = mixing.Stream(*common.texts_of(pa.array([" ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(12_000)) for _ in range(2)])))
    code = mixing.Code(np.bincount(stream.pairs(), minlength=1 << 16))
    assert ((code.steps >> 1) == code.nodes).all() and ((code.steps & 1) == code.bits).all()
    learner = mixing.Learner(code, mixing.sizes(1 << 20))
    learner.learn(stream)
    room = learner.room
    learner.learn(stream)
    assert len(stream.chunks()) > 3 and learner.room is room
    scores = []
    for size in (1 << 9, mixing.SCORED, 1 << 20):
        monkeypatch.setattr(mixing, "SCORED", size)
        scores.append(mixing.Scorer(code, [mixing.odds(learner.counts(k)) for k in range(4)], learner.weights).score(stream).tolist())
    assert scores[0] == scores[1] == scores[2]


def test_lm_steps_keep_their_memory():
    """A step's arrays come from memory that the step before gave back: in a new process, few pages are cleared for it."""
    code = """if True:
        import resource
        import numpy as np, pyarrow as pa
        from weftspark.llm import lm, mixing
        text = " ".join(str(i * i % 99_991) for i in range(40_000))
        code = mixing.Code(np.zeros(1 << 16, int))
        scorer, had = mixing.Scorer(code, [np.zeros(1 << b, np.int8) for b in mixing.sizes(1 << 20)], np.full((mixing.GATES, len(mixing.ORDERS)), 0.3)), []
        for _, _, _, stream, _, _, _ in lm._steps(iter([pa.RecordBatch.from_arrays([pa.array([text] * 8)], names=["text"])]), 0):
            scorer.score(stream)
            had.append(resource.getrusage(resource.RUSAGE_SELF).ru_minflt)
        print(len(had), (had[-1] - had[3]) / (len(had) - 4) * resource.getpagesize() / len(stream.data))
    """
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)}, timeout=120)
    steps, cleared = got.stdout.split()
    assert int(steps) == 8 and float(cleared) < 20  # bytes for each byte of text


@pytest.mark.parametrize("most,size", [(400_000, 1 << 25), (300, 1 << 25), (400_000, 5000)])
def test_lm_words_are_counted_in_parts(texts, monkeypatch, most, size):
    """As split() counts them, whatever a task holds, and a long text's words once."""
    texts = [*texts, " ".join(f"Wörd{i % 700}" for i in range(3000)) + " ", "\x1c \x85a\x0b", None]
    monkeypatch.setattr(common, "STEP_BYTES", 2000)
    monkeypatch.setattr(lm, "HELD", most)
    monkeypatch.setattr(lm, "HELD_BYTES", size)
    batches = list(lm._counted(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])))
    got = collections.Counter()
    for b in batches:
        got.update({t.encode(): n for t, n in zip(*(c.to_pylist() for c in b.columns), strict=True)})
    pairs = [n for t, n in got.items() if t[:1] == b"\n" and len(t) > 1]
    assert sum(pairs) == sum(len(b" ".join(words(t))) + 1 for t in texts) and got[b"\n"] == len(texts)
    assert {t: n for t, n in got.items() if t[:1] != b"\n"} == collections.Counter(w for t in texts for w in (t or "").encode().translate(LOW).split())
    assert (len(batches) > 3) == (most == 300 or size == 5000)


def test_lm_logarithms_and_bytes_of_bits():
    """Logarithms of ratios are looked up to a thousandth, none for a ratio of one; a byte's bits are its path."""
    ratios = np.random.default_rng(3).lognormal(0, 3, 100_000).astype(np.float32)
    ratios[:2] = 1, 1e30
    got = np.take(mixing._logs(), (ratios.view(np.uint32) + np.uint32(1 << 12)) >> np.uint32(13))
    assert abs(got - np.clip(np.log(ratios), -mixing.MOST, mixing.MOST)).max() < 1e-3 and got[0] == 0 and got[1] == np.float32(mixing.MOST)
    stream = mixing.Stream(*common.texts_of(pa.array(["the theme, then", "", "é"])))
    code = mixing.Code(np.bincount(stream.pairs(), minlength=1 << 16))
    contexts = stream.contexts(mixing.sizes(1))
    slots, bit, length = mixing.bits_of(stream, contexts, code, 0)
    paths = [range(code.first[p], code.first[p] + code.length[p]) for p in stream.pairs().tolist()]
    assert length.tolist() == [len(p) for p in paths] and bit.tolist() == [code.bits[i] for p in paths for i in p]
    assert slots[1].tolist() == [contexts[1][k] ^ code.nodes[i] for k, p in enumerate(paths) for i in p]


def test_lm_gates_learn_side_by_side(monkeypatch):
    """A chunk takes as many updates as its most frequent gate has batches, not as all gates have; texts of any length are refined as they are alone."""
    rng = random.Random(16)
    texts = [" ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(n)) for n in (9000, 1, 40, 700, 0, 2500)]
    stream = mixing.Stream(*common.texts_of(pa.array(texts)))
    code = mixing.Code(np.bincount(stream.pairs(), minlength=1 << 16))
    learner, made, gates, adapt, exp = mixing.Learner(code, mixing.sizes(1 << 20)), [], [], mixing.Learner._adapt, np.exp

    def watched(self, n, bit):
        size = abs(self.room[-1, :n])
        gates.append(np.bincount(sum((size > v).astype(int) for v in mixing.SURE)))
        adapt(self, n, bit)

    monkeypatch.setattr(mixing.Learner, "_adapt", watched)
    monkeypatch.setattr(np, "exp", lambda *a, **b: (made.append(1), exp(*a, **b))[1])
    learner.learn(stream)
    monkeypatch.undo()
    assert len(made) == sum(-(-int(c.max()) // mixing.BATCH) for c in gates) < sum(sum(-(-c // mixing.BATCH)) for c in gates)
    scorer = mixing.Scorer(code, [mixing.odds(learner.counts(k)) for k in range(4)], learner.weights)
    alone = [scorer.score(mixing.Stream(*common.texts_of(pa.array([t]))))[0] for t in texts]
    assert scorer.score(stream).tolist() == pytest.approx(alone, rel=1e-6)


def test_lm_probabilities_sum_to_one():
    """Over all next bytes of a context, by the chain of bits."""
    raw, off = common.texts_of(pa.array(["the theme then " * 50, "other words here"]))
    stream = mixing.Stream(raw, off)
    code = mixing.Code(np.bincount(stream.pairs(), minlength=1 << 16))
    learner = mixing.Learner(code, mixing.sizes(1 << 20))
    learner.learn(stream)
    scorer = mixing.Scorer(code, [mixing.odds(learner.counts(k)) for k in range(4)], learner.weights)
    contexts = stream.contexts(mixing.sizes(1 << 20))
    total = 0.0
    for value in range(256):
        pairs = contexts[-1].copy()
        pairs[100] = pairs[100] // 256 * 256 + value
        slots, bit, length = mixing.bits_of(stream, [*contexts[:-1], pairs], code, 0)
        lo = int(length[:100].sum())
        x = scorer.tables[-1][slots[-1]].view(np.uint8)
        z = scorer.word[x] + sum(w[mixing._LEVEL[x]] * t[s].astype(np.float32) for w, t, s in zip(scorer.weights[:-1], scorer.tables[:-1], slots[:-1], strict=True))
        p = mixing.squash(z[lo : lo + int(length[100])])
        total += np.prod(np.where(bit[lo : lo + int(length[100])], p, 1 - p))
    assert total == pytest.approx(1, abs=1e-4)


def test_lm_stream(texts):
    raw, off = common.texts_of(pa.array(texts))
    s = mixing.Stream(raw, off)
    wanted = [b" ".join((t or "").encode().translate(LOW).split()) + b"\n" for t in texts]
    assert s.data.tobytes() == b"".join(wanted)
    assert np.diff(s.off).tolist() == [len(x) for x in wanted]
    a, b = s.spans()
    assert [s.data[x:y].tobytes() for x, y in zip(a, b, strict=True)] == [w for x in wanted for w in x.split()]
    assert s.words.tolist() == [len(x.split()) for x in wanted]


def test_lm_texts_are_scored_alone():
    """A text's score doesn't depend on the texts beside it."""
    many = ["the theme then " * 40, "", "an other text", "x" * 5000, "the end"]
    raw, off = common.texts_of(pa.array(many))
    code = mixing.Code(np.zeros(1 << 16, int))
    learner = mixing.Learner(code, mixing.sizes(1 << 20))
    learner.learn(mixing.Stream(raw, off))
    scorer = mixing.Scorer(code, [mixing.odds(learner.counts(k)) for k in range(4)], learner.weights)
    together = scorer.score(mixing.Stream(raw, off))
    for k, t in enumerate(many):
        assert scorer.score(mixing.Stream(*common.texts_of(pa.array([t]))))[0] == pytest.approx(together[k], rel=1e-5)


def _scalar_score(text, code, tables, weights, bits):
    """Natural log probability of a text, a bit at a time, from its bytes."""
    data = list(b" ".join((text or "").encode().translate(LOW).split()) + b"\n")
    m, mask = 0x2F0B4C47, (1 << 32) - 1
    nodes, paths = code.nodes.tolist(), code.bits.tolist()
    total, done, stop, scale, shift = 0.0, 0, mixing.FIRST, 1.0, 0.0
    h, sums, start = [float(mixing.HOLD[0]), 0.0, float(mixing.HOLD[1])], [0.0] * 5, 0
    for t, byte in enumerate(data):
        if done == stop:
            h = [x + y for x, y in zip(h, sums[:3], strict=True)]
            det = h[0] * h[2] - h[1] * h[1]
            scale, shift = min(5, max(0.2, scale + (h[2] * sums[3] - h[1] * sums[4]) / det)), min(3, max(-3, shift + (h[0] * sums[4] - h[1] * sums[3]) / det))
            sums, stop = [0.0] * 5, 2 * stop
        slots = []
        for order, size in zip(mixing.ORDERS, bits, strict=True):
            x = 0
            if order:
                for j in range(order, 0, -1):
                    x = (x + ((data[t - j] if t >= j else mixing.END) + 1) * pow(m, order - j, 1 << 32)) & mask
                x = (x ^ x >> 15) * (0x85EBCA6B + 2 * order) & mask
            else:
                x = sum((data[i] + 1) * pow(m, i - start, 1 << 32) for i in range(start, t)) & mask
                x = (x ^ x >> 15) * 0xC2B2AE3D & mask
            slots.append(x >> 32 - size)
        pair = 256 * (data[t - 1] if t else 32) + byte
        for k in range(int(code.first[pair]), int(code.first[pair] + code.length[pair])):
            logs = [int(table[s ^ nodes[k]]) for table, s in zip(tables, slots, strict=True)]
            gate = sum(abs(logs[-1]) / mixing.STEP >= v for v in mixing.SURE)
            z = sum(float(w) * x for w, x in zip(weights[gate], logs, strict=True)) / mixing.STEP
            p = 1 / (1 + math.exp(-max(-15.0, min(15.0, z * scale + shift))))
            y = paths[k]
            total += math.log(p if y else 1 - p)
            sums = [s + v for s, v in zip(sums, (p * (1 - p) * z * z, p * (1 - p) * z, p * (1 - p), (y - p) * z, y - p), strict=True)]
        done += 1
        if byte in (32, mixing.END):
            start = t + 1
    return total


@pytest.fixture(scope="module")
def learnt():
    """A code and tables learnt from some texts, and held-out texts of the same words."""
    rng = random.Random(31)
    lexicon = ["".join(rng.choice(["th", "er", "on", "an", "Re", "hé"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    texts = [" ".join(rng.choice(lexicon) for _ in range(n)) for n in (400, 300, 1, 2000, 30)] + ["", " \t ", "x" * 700]
    stream = mixing.Stream(*common.texts_of(pa.array(texts)))
    code, bits = mixing.Code(np.bincount(stream.pairs(), minlength=1 << 16)), mixing.sizes(1 << 18)
    learner = mixing.Learner(code, bits)
    learner.learn(stream)
    return texts, code, [mixing.odds(learner.counts(k)) for k in range(4)], learner.weights, bits


def test_lm_scores_are_those_of_a_scalar_mixer(learnt):
    texts, code, tables, weights, bits = learnt
    texts = [t[:1500] for t in texts] + ["the unknown words of another text"]
    got = mixing.Scorer(code, tables, weights).score(mixing.Stream(*common.texts_of(pa.array(texts))))
    assert got == pytest.approx([_scalar_score(t, code, tables, weights, bits) for t in texts], rel=2e-4)


@pytest.mark.parametrize("step", [150, 1000])
@pytest.mark.parametrize("tail", ["", " " * 3000, " end"])
def test_lm_long_texts_are_scored_in_parts(learnt, monkeypatch, step, tail):
    texts, code, tables, weights, bits = learnt
    texts = ["short", texts[3] + tail, "", texts[0]]
    whole = mixing.Stream(*common.texts_of(pa.array(texts)))
    scorer = mixing.Scorer(code, tables, weights)
    wanted, size = scorer.score(whole), np.diff(whole.off)
    slots = whole.contexts(bits)
    monkeypatch.setattr(common, "STEP_BYTES", step)
    monkeypatch.setattr(mixing, "CHUNK", 64)
    got, seen, parts = {}, collections.defaultdict(list), 0
    for _, lo, hi, stream, skip, begins, last in lm._steps(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]), 0):
        own = stream.contexts(bits)
        for t in range(lo, hi):
            a, b = (stream.off[t - lo], stream.off[t - lo + 1]) if begins and last else (skip, len(stream.data))
            seen[t].append([x[a:b] for x in own])
        if begins and last:
            got |= dict(zip(range(lo, hi), scorer.score(stream), strict=True))
            continue
        refined, parts = mixing.Refinement() if begins else refined, parts + 1
        for chunk in scorer.mixed(stream, skip):
            refined.add(*chunk)
        if last:
            got[lo] = refined.total
    assert parts > 4 and [got[k] for k in range(4)] == pytest.approx(wanted.tolist(), rel=1e-4)
    for t in range(4):
        for k in range(5):  # every byte once, with the slots it has in the whole text
            assert np.concatenate([x[k] for x in seen[t]]).tolist() == slots[k][whole.off[t] : whole.off[t] + size[t]].tolist()


def test_lm_of_long_texts(spark, monkeypatch):
    """Counts of long texts are exact in parts; repeated and null ids stay."""
    rng = random.Random(4)
    long = " ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(3000))
    rows_ = [(1, long), (2, long + "   \n "), (2, "a b c"), (None, long), (4, None)]
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    monkeypatch.setattr(common, "STEP_BYTES", 1500)
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm.score(df, F.col("doc_id") == 1).collect()))
    base = _base([t for _, t in rows_], [0])
    size = [len(b" ".join(words(t))) + 1 for _, t in rows_]
    wanted = sorted((i or 0, s, *b) for (i, _), s, b in zip(rows_, size, base, strict=True))
    assert [x[:5] for x in got] == [x[:5] for x in wanted] and [x[5] for x in got] == pytest.approx([x[5] for x in wanted], rel=1e-9)


def test_lm_of_nothing(no_docs, docs):
    assert rows(lm.score(no_docs, F.lit(True))) == []
    got = lm.score(docs, F.lit(False)).collect()
    assert len(got) == docs.count() and all(r.train_tokens == 0 and r.n_known == 0 for r in got)
