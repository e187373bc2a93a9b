"""Tokenizers, language model, quality, mixing and the pipeline."""

import base64
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
ROWS = [(0, "the cat sat"), (1, None), (2, ""), (3, "the dog.  The END\n"), (4, "zäöß 日本 😀 <|endoftext|>"), (None, "the cat"), (6, "x " * 60_000), (3, "the dog.  The END\n"), (7, "\t\n ")]
SCHEMA = "doc_id long, text string, n_tokens string, start int, rate int, id int, body int"


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "clash", 1, 2, 3, 4) for i, t in rows], SCHEMA).repartition(2)


def byte_encoder():
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_equals_the_library():
    from millrace.llm.bpe_fst import loaded

    bpe, want, rng = loaded(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), byte_encoder(), random.Random(1)
    parts = ["a", "b", "the", "ing", "er", " ", "  ", "\n", "ä", "ß", "日", "́", "😀", "'s", "12", "!!", "…", "　"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert bpe.encode(text) == want.encode_ordinary(text)
    for _ in range(300):
        data = bytes(rng.randrange(256) for _ in range(rng.randint(1, 16)))
        assert bpe.memo.fst.encode(data) == want._encode_single_piece(data)
    for text in ("a" * 40_000, "ab" * 9000):
        assert bpe.encode(text) == want.encode_ordinary(text)


def test_streaming_decode_at_every_cut():
    from millrace.llm.bpe_fst import Utf8Stream

    for data in ("aé日😀z".encode(), b"\xf0\x9f\x98", b"\xe6\x97a\xff\xc3", b"\xed\xa0\x80x"):
        for cut in range(len(data) + 1):
            s = Utf8Stream()
            assert s.feed(data[:cut]) + s.feed(data[cut:]) + s.finish() == data.decode("utf-8", "replace")


def test_streaming_decode_of_tokens():
    from millrace.llm.bpe_fst import loaded

    bpe, rng = loaded(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), random.Random(8)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(256), rng.randrange(50_000)]) for _ in range(rng.randint(0, 12))]
        ids = [i for i in ids if i in bpe.bytes_of]
        stream, cut = bpe.decoder(), rng.randint(0, len(ids))
        text = stream.feed_tokens(ids[:cut]) + stream.feed_tokens(ids[cut:]) + stream.finish()
        assert text == b"".join(bpe.bytes_of[i] for i in ids).decode("utf-8", "replace")


def test_tokens_leave_after_bounded_lookahead():
    """What is held back never spans more bytes than the longest token."""
    from millrace.llm.bpe_fst import loaded

    bpe = loaded(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    longest, rng = max(map(len, bpe.bytes_of.values())), random.Random(9)
    for text in ["a" * 3000, "ab" * 1500, "".join(rng.choice("theandingr ") for _ in range(3000))]:
        state, out = bpe.memo.fst.start, 0
        for n, byte in enumerate(text.encode(), 1):
            state, got = state[byte]
            out += sum(len(bpe.bytes_of[t]) for t in got)
            assert n - out <= 2 * longest


def test_encode_documents(spark):
    from millrace.llm.bpe_fst import encode_documents

    found = encode_documents(frame(spark), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, with_text=True, batch_ids=500).collect()
    want = []
    for i, t in ROWS:
        ids = byte_encoder().encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids, t or ""))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    assert encode_documents(frame(spark).limit(0), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_word_encoder_equals_the_library():
    from tokenizers import Tokenizer

    from millrace.llm.sstable import WordEncoder

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    own, rng = WordEncoder(P.path("word_bpe_49k.json"), most=200, recent=20), random.Random(2)
    parts = ["a", "B", "the", "ä", "É", "İ", "Σ", "!", ".", ",", "1", "́", "̈", " ", "\n", " ", " ", "\x1c", "\x85", "'s", "•", "<|endoftext|>", "ᄀ", "ᅡ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for text, ids in zip(texts, own.encode_all(t.encode() for t in texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_added_tokens_as_the_library_by_itself(spark, tmp_path):
    from tokenizers import Tokenizer

    from millrace.llm.queries import op10_token_shards
    from millrace.llm.sstable import WordEncoder

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    own, rng = WordEncoder(P.path("word_bpe_49k.json"), most=200, recent=20, added=True), random.Random(3)
    parts = ["a", "One", " ", "\n", "!", "\u0301", "é", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|end", "oftext|>", "<", "|>"]
    texts = ["one <|endoftext|> two", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000))]
    for text, ids in zip(texts, own.encode_all(t.encode() for t in texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
    frame(spark, [(1, texts[0]), (2, "b")]).write.parquet(str(tmp_path / "documents.parquet"))
    found = op10_token_shards(spark, str(tmp_path)).orderBy("doc_id").collect()
    for r, t, start in zip(found, (texts[0], "b"), (0, 4), strict=True):
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_token_shards_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    from millrace.llm.sstable import lookup, read_shards, token_files, write_shards

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    ids = {(i, t): [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in ROWS}
    order, at, want = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)), 0, []
    for r in order:
        want.append((r[0], at, len(ids[r]), np.array(ids[r], "<u4").tobytes()))
        at += len(ids[r])
    written = write_shards(frame(spark), P.path("word_bpe_49k.json"), "file://" + str(tmp_path / "t"), partitions=3).cache()
    assert sorted(map(repr, map(tuple, read_shards(written).collect()))) == sorted(map(repr, want))
    paths = [(r.path, r.first) for r in written.orderBy("path").collect()]
    for r in order:
        assert lookup(paths, r[0]).tolist() == ids[r]
    assert lookup(paths, 99) is None and lookup(paths, -1) is None
    assert token_files(frame(spark).limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_table_of_many_keys(tmp_path):
    from millrace.llm.files import write_atomic
    from millrace.llm.sstable import SSTable, pack, sstable

    rows = [(k * 3, pack(np.array([k, k + 70_000 * (k % 2)], np.uint32))) for k in range(5000)]
    path = write_atomic(str(tmp_path), "x.mrsst", "1", (p for p in sstable(rows, block_bytes=512) if isinstance(p, bytes)))
    table = SSTable(path)
    assert len(table.blocks) > 50
    assert all(table.get(k * 3).tolist() == [k, k + 70_000 * (k % 2)] for k in range(0, 5000, 37))
    assert all(table.get(k * 3 + 1) is None for k in range(0, 5000, 37))
    assert sum(1 for _ in table.scan()) == 5000


def lm_expected(rows):
    c = collections.Counter()
    out = {}
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    words = lambda t: [*(t or "").encode().lower().split(), None]
    for i, t in rows:
        if not held(i):
            c.update(words(t))
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        w = words(t)
        out[i] = (held(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    return out


@pytest.mark.parametrize("frequent", [500_000, 3])
def test_language_model(spark, frequent):
    from millrace.llm.brown_lm import lm_scores

    found = lm_scores(frame(spark), head=8, groups=4, classes=6, frequent=frequent).collect()
    want = lm_expected(ROWS)
    assert len(found) == len(ROWS)
    for r in found:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9) and math.isfinite(r.score)
    assert lm_scores(frame(spark).limit(0), head=8, groups=4, classes=6).count() == 0
    only = lm_scores(frame(spark, [(None, "a b")]), head=8, groups=4, classes=6).collect()[0]
    assert only.train_tokens == 0 and only.score == only.base_score


def test_language_model_beats_the_base_on_held_out_text(spark):
    from millrace.llm.queries import op3_brown_class_lm

    held = op3_brown_class_lm(spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert held[0] > held[1]


def test_words_beyond_the_head_get_classes_from_their_own_neighbours(spark):
    from millrace.llm.brown_lm import lm_scores

    rng, rows = random.Random(4), []
    for i in range(400):
        k = i % 20
        rows.append((i, " ".join(rng.choice([f"aa xx{k}ing bb", f"cc yy{k}ing dd", "aa hx bb", "cc hy dd"]) for _ in range(8))))
    rows += [(10_000 + j, f"{a} {w}{k}ing {b}") for j, (a, w, k, b) in enumerate((a, w, k, b) for a, b in (("aa", "bb"), ("cc", "dd")) for w in ("xx", "yy") for k in range(20))]
    of = {r.doc_id: r for r in lm_scores(frame(spark, rows), head=6, groups=1, classes=8).collect()}
    for frequent in (3, 20):  # the same scores by file and by join
        for r in lm_scores(frame(spark, rows), head=6, groups=1, classes=8, frequent=frequent).collect():
            assert r.score == pytest.approx(of[r.doc_id].score, rel=1e-9)
    gain = {i: r.score - r.base_score for i, r in of.items()}
    right, wrong = [gain[10_000 + j] for j in (*range(20), *range(60, 80))], [gain[10_000 + j] for j in range(20, 60)]
    assert min(right) > max(wrong)


def test_scores_by_brute_force(spark):
    """Transitions, emissions and mixture by their definitions, for classes that the exchange gives; probabilities sum to one."""
    from millrace.llm import brown_lm as B
    from millrace.llm.wordhash import words

    rng = random.Random(11)
    vocabulary = [f"w{k}{'ing' if k % 3 else 'ed'}" for k in range(30)]
    rows = [(i, " ".join(rng.choice(vocabulary[(i % 2) * 10 :]) for _ in range(rng.randint(0, 25))) + (" unseen" if i % 7 == 0 else "")) for i in range(120)]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    split = lambda t: t.encode().lower().split()
    count = collections.Counter(w for i, t in rows if not held[i] for w in [*split(t), None])
    hashed = {w: int(words([w])[0][0].view(np.int64)) for w in {w for _, t in rows for w in split(t)}}
    ending = {w: words([w])[2] for w in hashed}
    classes, groups, mix, weight = 6, 4, 0.98, 20.0
    top = sorted((w for w in count if w), key=lambda w: (-count[w], hashed[w]))
    units = B.Units([hashed[w] for w in top], groups)
    unit = lambda w: 0 if w is None else int(units.of(np.array([hashed[w]]).view(np.uint64), ending[w])[0])
    pairs = np.zeros((units.n, units.n), np.int64)
    for i, t in rows:
        if not held[i]:
            seq = [None, *split(t), None]
            for a, b in zip(seq, seq[1:]):
                pairs[unit(a), unit(b)] += 1
    cls = B.exchange(pairs, classes)
    k = lambda w: int(cls[unit(w)])
    table = np.zeros((classes, classes))
    for a, b in np.argwhere(pairs):
        table[cls[a], cls[b]] += pairs[a, b]
    tokens = table.sum(0)
    size = collections.Counter(k(w) for w in count)
    total, distinct = sum(count.values()), len(count)
    prior = (tokens + 0.5) / (tokens + 0.5).sum()

    def emission(w, c):
        return (count[w] + 0.1) / (tokens[c] + 0.1 * (size[c] + 1))

    def p(w, before):
        follows = (table[k(before), k(w)] + weight * prior[k(w)]) / (table[k(before)].sum() + weight)
        return mix * follows * emission(w, k(w)) + (1 - mix) * (count[w] + 0.1) / (total + 0.1 * (distinct + 1))

    for c in range(classes):  # the words of a class and one that was never seen
        assert sum(emission(w, c) for w in count if k(w) == c) + 0.1 / (tokens[c] + 0.1 * (size[c] + 1)) == pytest.approx(1)
    for r in B.lm_scores(frame(spark, rows), head=100, groups=groups, classes=classes).collect():
        seq = [None, *split(dict(rows)[r.doc_id]), None]
        assert r.score == pytest.approx(sum(math.log10(p(w, before)) for before, w in zip(seq, seq[1:])), rel=1e-9)


def test_exchange_separates_two_languages():
    from millrace.llm.brown_lm import exchange

    rng, pairs = np.random.default_rng(0), np.zeros((41, 41), np.int64)
    for lo in (1, 21):
        for a in range(lo, lo + 20):
            for b in rng.integers(lo, lo + 20, 60):
                pairs[a, b] += 1
    cls = exchange(pairs, 3)
    assert cls[0] == 0 and len(set(cls[1:21])) == len(set(cls[21:])) == 1 and cls[1] != cls[21]


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(9)
    good = [f"w{k}" for k in range(200)]
    rows, labels = [], []
    for i in range(240):
        kind = i % 6
        words = [rng.choice(good) for _ in range(80)]
        if kind == 1:
            words = ["SPAM!!"] * 60 + words[:10]
        if kind == 2:
            words[5::9] = ["scum"] * len(words[5::9])
        rows.append((i, " ".join(words)))
        if i < 120:
            labels.append((i, int(kind != 1), int(kind == 2)))
    rows += [(1000, None), (1001, ""), (None, rows[0][1]), (0, rows[0][1])]
    return frame(spark, rows), spark.createDataFrame(labels + [(None, 1, 0), (5000, None, None), (0, 1, 0)], "doc_id long, quality int, toxic int")


GRAM_TEXTS = [b"a b a b a", b"the The cat", b"", b"\t\n", b"x", b"yy zz yy yy yy zz\nqq", "é ü é".encode(), b"a b"]


def own_grams(text):
    """The n-grams of a text, one at a time: (kind, key)."""
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in text)
    words = low.split()
    kinds = []
    for i, w in enumerate(words):
        back = next((b for b in range(1, 9) if i >= b and words[i - b] == w), 0)
        kinds.append(min(back, 3))
    out = [("word", w) for w in words] + [("pair", p) for p in zip(words, words[1:])]
    return out + [("byte", low[i : i + 3]) for i in range(len(low) - 2)] + [("rep", tuple(kinds[i : i + 3])) for i in range(len(kinds) - 2)]


def test_ngrams_by_brute_force():
    from millrace.llm.importance import STARTS, grams, log_ratios

    found = grams(GRAM_TEXTS)
    bucket = {}  # every n-gram has one bucket, wherever it stands
    for k, text in enumerate(GRAM_TEXTS):
        want = [[g for g in own_grams(text) if g[0] == kind] for kind in ("word", "pair", "byte", "rep")]
        for (buckets, of), mine, lo, hi in zip(found, want, STARTS, STARTS[1:]):
            own = buckets[of == k].tolist()
            assert len(own) == len(mine) and all(lo <= b < hi for b in own)
            for b, g in zip(own, mine):
                assert bucket.setdefault(g, b) == b
    raw, target = np.zeros(STARTS[-1]), np.zeros(STARTS[-1])
    for k, text in enumerate(GRAM_TEXTS):
        for g in own_grams(text):
            raw[bucket[g]] += 1
            target[bucket[g]] += k == 0
    ratios = log_ratios(raw, target)
    g = ("pair", (b"a", b"b"))
    n_pairs, t_pairs, size = sum(x[0] == "pair" for t in GRAM_TEXTS for x in own_grams(t)), 4, STARTS[2] - STARTS[1]
    want = math.log((target[bucket[g]] + 1) / (t_pairs + size)) - math.log((raw[bucket[g]] + 1) / (n_pairs + size))
    assert ratios[bucket[g]] == pytest.approx(want)


def test_importance_resampling(judged):
    from pyspark.sql import functions as F

    from millrace.llm.importance import calibrate, fit, grams, gumbel_key, kth_largest, labelled, resample, with_weight

    docs, labels = judged
    found = resample(docs, labels).collect()
    kept = {r.doc_id: r.kept for r in found}
    new = [i for i in range(120, 240)]
    assert sum(kept[i] for i in new if i % 6 != 1) >= 0.97 * 100 and sum(kept[i] for i in new if i % 6 == 1) < 10
    even = {r.doc_id: r.kept for r in resample(docs, labels, cost=1.0).collect()}  # no leaning towards keeping
    assert sum(even[i] for i in new if i % 6 != 1) >= 0.97 * 100 and not any(even[i] for i in new if i % 6 == 1)
    # weights of whole texts, log odds, keys and the choice, each by its definition
    known = labelled(labels, 20_000)
    ratios, texts = fit(docs, known), {}
    for i, t in docs.select("doc_id", "text").collect():
        texts.setdefault(i, (t or "").encode())
    line = calibrate(with_weight(docs, ratios).select("doc_id", "__mr_weight", "__mr_grams"), known)
    odds = []
    for r in found:
        own = np.concatenate([b for b, _ in grams([texts[r.doc_id]])])
        assert r.log_weight == pytest.approx(ratios[own].sum(), abs=1e-6)
        odds.append(line.slope * r.log_weight / max(1, len(own)) ** line.power + line.intercept)
        assert r.log_odds == pytest.approx(odds[-1], abs=1e-6)
    k = math.ceil(sum(20 * math.exp(min(x, 500)) / (1 + 20 * math.exp(min(x, 500))) for x in odds) - 1e-6)
    cut = sorted((r.gumbel_key for r in found), reverse=True)[k - 1]
    assert all(r.kept == (r.gumbel_key >= cut) for r in found)
    # the noise decides: half of the documents drawn aren't those of the greatest weights
    half = resample(docs, labels, keep=100).collect()
    top = {r.doc_id for r in sorted(half, key=lambda r: -r.log_odds)[:100]}
    assert len(top - {r.doc_id for r in half if r.kept}) > 10 and 100 <= sum(r.kept for r in half) <= 103
    noise = [r.gumbel_key - r.log_odds for r in half]
    assert abs(np.mean(noise) - 0.5772) < 0.3 and abs(np.std(noise) - 1.2825) < 0.4
    rows = resample(docs, labels, kept_only=True)
    assert rows.columns == docs.columns and {r.doc_id for r in rows.collect()} == {i for i, k in kept.items() if k}
    assert resample(docs.limit(0), labels).count() == 0
    assert resample(docs, labels.limit(0)).where("kept").count() == docs.count()
    keys = docs.selectExpr("doc_id", "cast(doc_id % 50 as double) / 7 AS odds").where("doc_id IS NOT NULL").withColumn("k", gumbel_key(F.col("odds"), "doc_id", 1))
    keys = keys.union(keys.limit(30)).union(keys.selectExpr("doc_id", "odds", "1.5D"))  # ties
    values = sorted((r.k for r in keys.collect()), reverse=True)
    for k in (1, 7, 100, 200, 300, len(values)):
        assert kth_largest(keys, "k", k, few=5) == values[k - 1]


def test_logistic_by_gradient():
    from millrace.llm.logistic import logistic

    rng = np.random.default_rng(3)
    z = rng.standard_normal((500, 2))
    label = (rng.random(500)[:, None] > np.cumsum(np.exp(np.c_[np.zeros(500), 1 + z[:, 0], z[:, 1] - z[:, 0]]) / np.exp(np.c_[np.zeros(500), 1 + z[:, 0], z[:, 1] - z[:, 0]]).sum(1, keepdims=True), 1)).sum(1)
    lines, _ = logistic(z, label, 3)
    x = np.c_[np.ones(503), np.r_[z, np.zeros((3, 2))]]
    p = np.exp(np.c_[np.zeros(503), x @ lines.T])
    p /= p.sum(1, keepdims=True)
    slope = x.T @ (p - np.eye(3)[np.r_[label, 0, 1, 2]])
    assert np.abs(slope).max() < 0.1 and np.abs(lines - [[1, 1, 0], [0, -1, 1]]).max() < 0.6
    assert np.isfinite(logistic(np.r_[np.full(20, -5.0), np.full(20, 5.0)][:, None], np.repeat([0, 1], 20), 2)[0]).all()  # separable
    assert np.isfinite(logistic(np.zeros((0, 2)), np.zeros(0, int), 3)[0]).all()


def own_domain(q, t):
    return 1 if q == 0 else 2 if t == 1 else 0 if q == 1 and t == 0 else None


def test_mixing_by_brute_force(judged):
    """Odds, posteriors and rates against the same definitions in plain Python."""
    import re

    from pyspark.sql import functions as F

    from millrace.llm import mixing as M

    docs, labels = judged
    spark = docs.sparkSession
    model = M.fit_classifier(docs, labels, "doc_id", "text", 20_000, 2.0, 30.0)
    domain = {}
    for i, q, t in labels.collect():
        if i is not None and own_domain(q, t) is not None:
            domain[i] = max(domain.get(i, 0), own_domain(q, t))
    once = {}
    for i, text in docs.select("doc_id", "text").collect():
        if i in domain:
            key = (text or "", domain[i])
            once[key] = min(once.get(key, i), i)
    hashed = spark.createDataFrame([(i,) for i in once.values()], "i long").select("i", F.pmod(F.xxhash64("i", F.lit(5)), F.lit(2)))
    half = dict(map(tuple, hashed.collect()))

    def features(text):
        words = [w for w in re.split("[ \\t-\\r]+", text) if w]
        same = ([False] + [a == b for a, b in zip(words, words[1:])])[: len(words)]
        return [("w", w.lower()) for w in words] + [("s", w.lower()[-3:]) for w in words] + [("r", s) for s in same]

    # different words may share a bucket: the hashes of the words and endings themselves
    texts = [(i, t or "") for i, t in docs.select("doc_id", "text").collect()]
    every = sorted({g for _, t in texts for g in features(t) if g[0] != "r"})
    sized = spark.createDataFrame(every, "kind string, v string").select("kind", "v", F.pmod(F.xxhash64("v"), F.when(F.col("kind") == "w", M.WORDS).otherwise(M.ENDINGS)))
    place = {(k, v): (k, b) for k, v, b in sized.collect()}
    plain, features = features, lambda text: [place.get(g, g) for g in plain(text)]
    count = [collections.Counter() for _ in range(3)]
    for (text, d), i in once.items():
        if half[i] == 0:
            count[d].update(features(text))
    n = [sum(c.values()) for c in count]

    def odds(g, d):
        share = n[d] / (n[0] + n[d])
        e = (count[d][g] + count[0][g]) * share
        z2 = (count[d][g] - e) ** 2 / (e * (1 - share) + 0.5)
        floor = 2.0 / sum(n)
        return math.log((count[d][g] / n[d] + floor) / (count[0][g] / n[0] + floor)) * z2 / (z2 + 30)

    rows = M.posteriors(docs, model, "doc_id", "text").collect()
    want = []
    for i, t in texts:
        f = features(t)
        tokens = sum(g[0] == "w" for g in f)
        z = [sum(odds(g, d) if any(c[g] for c in count) else 0.0 for g in f) / max(1, tokens) ** model.power for d in (1, 2)]
        logits = np.r_[0.0, model.lines[:, 0] + model.lines[:, 1:] @ z]
        p = np.exp(logits - logits.max())
        want.append((i is None, i or 0, tokens, *(p / p.sum())))
    got = sorted((r["__mr_id"] is None, r["__mr_id"] or 0, r["__mr_tokens"], r["__mr_p_clean"], r["__mr_p_low"], r["__mr_p_toxic"]) for r in rows)
    bad = [(a, b) for a, b in zip(got, sorted(want)) if not np.allclose(np.array(a, float), np.array(b, float), atol=1e-6)]
    assert not bad
    assert len({round(r[3], 6) for r in got}) > 100

    # the rates: the same steps on plain arrays, for bounds that bind and for none
    p = np.array([r[3:] for r in got])
    t = np.array([r[2] for r in got], float)
    frame_ = spark.createDataFrame([(r[1], r[2], *map(float, r[3:])) for r in got], "__mr_id long, __mr_tokens long, __mr_p_clean double, __mr_p_low double, __mr_p_toxic double")
    for targets, top in (((0.5, 0.3, 0.2), None), ((0.7, 0.02, 0.05), 1.0)):
        goal = np.array(targets) * t.sum()
        inverse = np.linalg.pinv((p * t[:, None]).T @ p, rcond=1e-9, hermitian=True)
        r, last = np.ones(len(t)), None
        while True:
            have = (r * t) @ p
            if np.abs(have - goal).max() <= 1e-4 * t.sum() or (last is not None and np.abs(have - last).max() <= 1e-5 * t.sum()):
                break
            last = have
            r = np.clip(r - p @ inverse @ (have - goal), 0, top)
        found = M.fit_rates(frame_, dict(zip(M.DOMAINS, goal)), top).select("__mr_id", "__mr_tokens", "__mr_p_clean", "__mr_rate").collect()
        own = sorted((i, n_, c, x) for i, n_, c, x in zip([g[1] for g in got], t, p[:, 0], r))
        assert np.allclose(np.array(sorted(map(tuple, found)))[:, 3], np.array(own)[:, 3], atol=1e-6)


def test_mixing_reaches_targets(judged):
    from millrace.llm.mixing import mix

    docs, labels = judged
    want = {"clean": 0.5, "low": 0.3, "toxic": 0.2}
    out = mix(docs, labels, want)
    rows = out.collect()
    total = sum(r.n_tokens for r in rows)
    for d in want:
        assert sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) / total == pytest.approx(want[d], abs=0.01)
    assert all(r.rate >= 0 and r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in rows)
    new = {r.doc_id: r for r in rows if r.doc_id is not None and 120 <= r.doc_id < 240}
    assert sum(new[i].p_toxic > 0.5 for i in new if i % 6 == 2) >= 18 and sum(new[i].p_clean > 0.5 for i in new if i % 6 not in (1, 2)) >= 78
    assert mix(docs.limit(0), labels, want).count() == 0 and mix(docs, labels.limit(0), want).count() == docs.count()
    # labels of one identifier that clash count as the last domain, however they are ordered
    clash = labels.union(labels.selectExpr("doc_id", "1 - quality", "toxic").where("doc_id % 12 = 0"))
    one, two = (sorted(map(tuple, mix(docs, x, want).select("doc_id", "n_tokens", "copies").fillna(-1).collect())) for x in (clash, clash.orderBy("quality")))
    assert one == two


def test_mixing_stage_meets_its_weights(spark, tmp_path):
    import corpus_pipeline as c

    rng = random.Random(12)
    good = [f"w{k}" for k in range(200)]
    kinds = {i: i % 6 for i in range(2400)}
    rows = [(i, " ".join(["SPAM!!"] * 60 * (k == 1) + ["scum"] * 20 * (k == 2) + [rng.choice(good) for _ in range(20 if k == 1 else 80)])) for i, k in kinds.items()]
    spark.createDataFrame([(i, int(kinds[i] != 1), int(kinds[i] == 2)) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = [r.doc_id for r in c.mixed(spark, frame(spark, rows), str(tmp_path)).collect()]
    tokens = [sum((100 if d == 2 else 80) for i in kept if d == {1: 1, 2: 2}.get(kinds[i], 0)) for d in range(3)]
    assert tokens[0] >= 0.99 * 80 * 1600
    for n, d in zip(tokens, ("clean", "low", "toxic")):
        assert n / sum(tokens) == pytest.approx(c.WEIGHTS[d], abs=0.015)


EDGE = [(1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, None), (4, "one line that is long enough\n" * 3), (3, "another text with the same identifier here"), (7, "z " * 40_000)]


@pytest.mark.parametrize("name", ["quality", "lines", "near", "mixed", "tokens"])
def test_stage_edges(spark, tmp_path, name):
    """Nulls, repeated identifiers and rows, very long texts, empty tables and clashing columns in every stage."""
    import corpus_pipeline as c

    spark.createDataFrame([(3, 1, 0), (4, 0, 0), (None, 1, 0), (99, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "c", 1, 2) for i, t in EDGE], "doc_id long, text string, lang string, source string, n_chars long, kept string, rate int, id int")
    stage = dict(c.STAGES)[name]
    out = stage(spark, docs, str(tmp_path))
    rows = out.collect()
    if name == "tokens":
        assert len(rows) == len(EDGE)
    else:
        assert out.columns == docs.columns
        left = collections.Counter((r.doc_id, r.text) for r in rows)
        if name in ("quality", "mixed"):
            assert not left - collections.Counter(EDGE)
        if name == "near":
            assert left == collections.Counter([(1, None), (2, ""), (3, "a b c d e f"), (None, None), EDGE[6], EDGE[7], EDGE[8]])
        if name == "lines":
            assert len(rows) == len(EDGE)
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        left = {r[0] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and left <= ids, name
        ids = left
    found = c.run(spark, sf)
    assert {r[0] for r in found.select("doc_id").collect()} == ids
    texts = dict(docs.select("doc_id", "text").collect())
    for r in found.limit(20).collect():
        assert list(r.ids) == byte_encoder().encode_ordinary(texts[r.doc_id] or "")
