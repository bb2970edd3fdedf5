"""Quality rules, periodic runs and tokenizer alignment against brute-force versions, with awkward rows."""

import collections
import hashlib
import itertools
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftspark.llm import alignment, common, periodic, registry, rules

DATA = os.environ.get("WEFT_TEST_DATA", "/root/testdata/sf0.001")
LONG = " ".join(f"w{k * k % 199_999}" for k in range(200_000))


def words(text):
    return (text or "").encode().split()


def measures(text):
    text = text or ""
    w = [x.decode() for x in words(text)]
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = collections.Counter(windows)
    again = {k for i, x in enumerate(windows) if twice[x] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(again)


def failed(m):
    n, chars, symbols, lines, dup, again = m
    return sum(bit << k for k, bit in enumerate([n < 50, 100 * again > 50 * n, 10 * symbols > n, 100 * dup > 40 * lines, chars < 3 * n, chars > 10 * n]))


@pytest.fixture(scope="module")
def awkward(spark, texts):
    """The shared texts and some that fail rules, with null and repeated ids, repeated rows and columns named like results."""
    more = [*texts, "a b c " * 40, "# $ % " * 30, "\n".join(["the same line of words again"] * 20), "x " * 60, ("abcdefghijk" * 2 + " ") * 55, "a b a b a b\x0bc\x1cd e e e e e e", LONG, "\x85    x  y", "\x00 a\x00b ﻿", "▁ a", "a ▁b c"]
    rows = [(k, t, 1, "x") for k, t in enumerate(more)] + [(None, more[0], 2, "y"), (3, "other text of a repeated id", 3, "z"), (3, more[3], 1, "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, n_words long, bits string").repartition(5)


def test_rules_are_measured(awkward):
    rows, docs = awkward
    ledger = rules.evaluate(docs)
    assert ledger.columns == ["doc_id", *rules.MEASURES, "bits"]
    wanted = collections.Counter((i, *(m := measures(t)), failed(m)) for i, t, *_ in rows)
    assert collections.Counter(tuple(r) for r in ledger.collect()) == wanted
    assert {k for *_, bits in wanted for k in range(6) if bits >> k & 1} == set(range(6))


def test_policies_and_ablations(spark, awkward):
    rows, docs = awkward
    ledger = rules.evaluate(docs)
    bits = [failed(measures(t)) for _, t, *_ in rows]
    place = {r.name: k for k, r in enumerate(rules.RULES)}
    got = {(r.version, r.rule): (r.n_docs, r.n_kept, r.n_failed, r.n_kept_without, r.implied) for r in rules.ablations(ledger).collect()}
    for p in rules.POLICIES:
        mask = sum(1 << place[r] for r in p.rules)
        kept = lambda m, p=p: sum((b & m).bit_count() <= p.allowed for b in bits)
        assert rules.verdicts(ledger, [p]).where(f"kept_v{p.version}").count() == kept(mask)
        for name in p.rules:
            own = [b for b in bits if b >> place[name] & 1]
            together = own[0] if own else None
            for b in own:
                together &= b
            assert got.pop((p.version, name)) == (len(bits), kept(mask), len(own), kept(mask & ~(1 << place[name])), together)
    assert not got
    assert rules.ablations(rules.evaluate(docs.where("false"))).count() == 0


def test_rules_keep_rows_whole(awkward):
    rows, docs = awkward
    out = rules.keep_good(docs)
    assert out.columns == docs.columns
    assert collections.Counter(tuple(r) for r in out.collect()) == collections.Counter(r for r in rows if failed(measures(r[1])) == 0)


def test_rules_stay_inside_spark(awkward):
    plan = rules.keep_good(awkward[1])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def stretches(w, periods=4, least=6):
    """Maximal stretches of smallest period q, of q * periods and `least` words at least."""
    ids, out = {}, {}
    v = np.array([ids.setdefault(x, len(ids)) for x in w], np.int64)
    for q in range(1, len(w) // periods + 1):
        step = np.diff(np.concatenate([[0], v[:-q] == v[q:], [0]]).astype(np.int8))
        for s, e in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
            if e - s >= (periods - 1) * q:
                out.setdefault((s, e + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items() if e - s >= least)


def collapsed(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return b" ".join(x for k, x in enumerate(w) if k not in gone)


@pytest.mark.parametrize("leaves", [1 << 19, 3])
def test_suffix_trees_find_every_run(monkeypatch, leaves):
    monkeypatch.setattr(periodic, "LEAVES", leaves)
    monkeypatch.setattr(periodic, "COMPARED", leaves)
    rng = random.Random(3)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(0, 5)):
            w = [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 8])]) for _ in range(rng.randint(0, 50))]
            if w and rng.random() < 0.5:
                a = rng.randrange(len(w))
                p = 1 + (len(w) - a) // rng.randint(2, 9)
                w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            texts.append(w)
        begin = np.cumsum([0, *map(len, texts)])
        start, length, period = periodic.SuffixTree(np.array([ord(x) for w in texts for x in w], np.int64), begin).runs()
        wanted = [(int(b) + s, n, q) for b, w in zip(begin, texts, strict=False) for s, n, q in stretches(w, 2, 2)]
        assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == sorted(wanted, key=lambda r: (r[0], r[2]))


def test_runs_of_documents(awkward):
    rows, docs = awkward
    got = collections.Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic.find_runs(docs).collect())
    wanted = collections.Counter()
    for i, t, *_ in rows:
        w = words(t)
        r = stretches(w) if t is not LONG else ()
        wanted[i, len(w), tuple(r), collapsed(w, r).decode()] += 1
    assert got == wanted


@pytest.mark.parametrize("p", [1, 2, 1777])
def test_a_long_text_of_one_run(p):
    raw, off = common.texts_of(pa.array(["end " + " ".join(str(k % p) for k in range(60_000)) + " end"]))
    text, start, length, period, n = periodic.runs_of_texts(raw, off)
    assert (text.tolist(), start.tolist(), length.tolist(), period.tolist(), n.tolist()) == ([0], [1], [60_000], [p], [60_002])


def test_runs_of_nothing(no_docs):
    assert periodic.find_runs(no_docs).collect() == []


def test_most_periods(spark):
    kind = "array<struct<start: bigint, length: bigint, period: bigint>>"
    df = spark.createDataFrame([(1, [(0, 12, 3), (20, 9, 2), (40, 9, 2), (60, 4, 1)]), (2, [])], f"k int, runs {kind}")
    assert [r.b and tuple(r.b) for r in df.orderBy("k").select(periodic.most_periods(F.col("runs")).alias("b")).collect()] == [(20, 9, 2), None]


def planted(i, w):
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_op12(spark):
    sha = lambda x: hashlib.sha256(x).hexdigest()
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = registry.op12_runs(spark, DATA)
    assert got.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    wanted = {}
    for i, w in docs.items():
        w = planted(i, w)
        r = stretches(w)
        best = min(r, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if r else (None,) * 3
        wanted[i] = len(r), *best, 1000 * best[1] // best[2] if r else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in r).encode()), sha(collapsed(w, r))
    assert {r.doc_id: tuple(r)[1:8] for r in got.collect()} == wanted and sum(x[0] > 0 for x in wanted.values()) > 5


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(registry.tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=registry.tokenizer_path())


def aligned(tokenizers, texts):
    """The columns of each text, whole texts being encoded in one piece."""
    a, b = tokenizers
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = dict(zip(map(chr, plain), plain, strict=True)) | {chr(256 + k): x for k, x in enumerate(sorted(set(range(256)) - set(plain)))}
    rows, every = [], []
    for t in texts:
        x, y, links, groups = [], [], [], []
        if t:
            x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            xs = [bytes(byte[c] for c in a.id_to_token(i)) for i in x]
            ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
            if b"".join(xs) != (" " + t).encode() or b"".join(ys) != (" " + t).encode():
                x, y, xs, ys = [], [], [], []
            ends = {e: k for k, e in enumerate(itertools.accumulate(map(len, xs)))}
            i = j = 0
            for k, e in enumerate(itertools.accumulate(map(len, ys))):
                if e in ends:
                    groups.append(",".join(map(str, x[i : ends[e] + 1])) + "|" + ",".join(map(str, y[j : k + 1])))
                    i, j = ends[e] + 1, k + 1
                    links.append((x[i - 1], y[k]))
        rows.append((len(x), len(y), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""))
        every.append(links)
    count = collections.Counter(x for links in every for x in links)
    best = collections.Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(*r[:4], sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), r[4]) for r, links in zip(rows, every, strict=True)]


ODD = ["", None, " ", "  two  spaces ", "tab\tand\nline\r\n end", "▁", "a▁b c", "x <|endoftext|> y<|endoftext|>", "<unk> </s> <s> <0x41>", "日本語 テキスト", "🙂 🙂🙂", "a b   c", "it's we'll 've 's", "\x00 \x1c x \x85 y", "é é", "1234567 89,000.50", "ſ ẞ ß"]


@pytest.mark.parametrize("shard,held,step,joined", [(1 << 20, 1 << 20, 1 << 20, 1 << 14), (50, 40, 300, 20)])
def test_alignment(spark, awkward, tokenizers, monkeypatch, shard, held, step, joined):
    monkeypatch.setattr(alignment, "SHARD_ROWS", shard)
    monkeypatch.setattr(alignment, "HELD", held)
    monkeypatch.setattr(alignment, "STEP", step)
    monkeypatch.setattr(alignment, "JOINED", joined)
    rows = [*awkward[0], *((1000 + k, t, k, "") for k, t in enumerate(ODD))]
    docs = spark.createDataFrame(rows, awkward[1].schema).repartition(3)
    got = alignment.align(docs, registry.tokenizer_path("byte_bpe_50k.json"), registry.tokenizer_path())
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    wanted = aligned(tokenizers, [r[1] for r in rows])
    assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter((r[0], *w) for r, w in zip(rows, wanted, strict=True))


def test_alignment_of_nothing(no_docs):
    assert alignment.align(no_docs, registry.tokenizer_path("byte_bpe_50k.json"), registry.tokenizer_path()).collect() == []


def test_parts_have_the_units_of_the_whole():
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice(["a", " ", " ", "\n", "é", "　", "bc"]) for _ in range(rng.randint(0, 60)))
        parts = list(alignment.cut(text, rng.randint(1, 10)))
        assert [u for p in parts for u in alignment._CUT.split(p)] == alignment._CUT.split(text) and " ".join(parts) == text


@pytest.mark.parametrize("mapped", [True, False])
def test_shards(spark, tmp_path, monkeypatch, mapped):
    """Counts of keys that many partial counts hold, from mapped shards and from those that can't be mapped."""
    if not mapped:
        monkeypatch.setattr(alignment.pafs, "LocalFileSystem", ())
    rng = random.Random(4)
    pairs = [(rng.randrange(300) << 32 | rng.randrange(3), rng.randrange(1, 2**40)) for _ in range(3000)] + [(7 << 32, 1)] * 500
    df = spark.createDataFrame(pairs, "key long, n long").repartition(6)
    found = alignment.write_shards(df, f"file://{tmp_path}/shards", 9).collect()
    count, best = collections.Counter(), collections.Counter()
    for k, n in pairs:
        count[k] += n
    for k, n in count.items():
        best[k >> 32] = max(best[k >> 32], n)
    assert len(found) > 5 and sum(r.rows for r in found) == len(count)
    keys = np.array(sorted({*count, 0, 5, 1 << 60}))
    shards = alignment.Shards([(r.path, r.rows, r.least) for r in found])
    assert shards.find(keys).tolist() == [count[k] for k in keys.tolist()]
    most = collections.Counter()
    for r in found:
        for b, n in zip(r.b, r.most, strict=True):
            most[b] = max(most[b], n)
    assert most == best


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_op13(spark, tokenizers):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    wanted = {i: w for (i, _), w in zip(docs, aligned(tokenizers, [t for _, t in docs]), strict=True)}
    assert {r.doc_id: tuple(r)[1:] for r in registry.op13_alignment(spark, DATA).collect()} == wanted
