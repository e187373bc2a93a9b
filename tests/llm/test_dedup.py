"""Exact, line and near dedup of texts, and of embeddings, against brute force."""

import base64
import hashlib
import math
import random

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, n_lines long, kept string, __x int, group_size string"
LINE = "a line that is long enough to count"


def corpus():
    rng = random.Random(3)
    vocabulary = [f"word{k}" for k in range(300)]
    texts = ["", None, "one", "One", " one ", "two words", LINE, LINE, f"{LINE}\n{LINE.upper()} \nshort", "é" * 25 + "\n" + LINE, "x" * 200_000]
    base = [rng.choice(vocabulary) for _ in range(80)]
    for k in range(12):
        near = list(base)
        for at in rng.sample(range(80), k % 4):
            near[at] = f"changed{k}_{at}"
        texts.append(" ".join(near))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(10)]
    texts += [texts[-1], texts[-1], None]
    rows = [(i, t, 7, "clash", 1, "g") for i, t in enumerate(texts)]
    return rows + [(None, "one", None, None, None, None), (3, "One", 7, "clash", 1, "g")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup(docs, keep):
    from millrace.llm.exact_dedup import exact_dedup

    groups = {}
    for i, t, *_ in corpus():
        groups.setdefault(t or "", []).append(i)
    found = exact_dedup(docs, keep=keep).collect()
    want = []
    for i, t, *_ in corpus():
        ids = [x for x in groups[t or ""] if x is not None]
        best = (max if keep == "max" else min)(ids) if ids else None
        want.append((i, best, len(groups[t or ""]), i == best, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


@pytest.mark.parametrize("budget", [1 << 30, 2000, 1])
def test_trie_spills_by_subtree_and_loses_nothing(budget, tmp_path):
    from millrace.llm.exact_dedup import PatriciaTrie

    rng = random.Random(5)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(800)] + [b"p" * 500 + bytes([k % 7]) for k in range(50)]
    trie = PatriciaTrie(lambda a, b: a + b, budget)
    for w in words:
        trie.insert(w, 1)
    assert bool(trie.spilled) == (budget < 1 << 30)
    assert dict(trie.items()) == {w: words.count(w) for w in words}


def _lines(rows, least=20, docs=3):
    space = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(space).translate(lower)
    held = {}
    for n, (i, t, *_) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n") if len(key(x)) >= least}:
            held.setdefault(k, []).append(i)
    out = []
    for i, t, *_ in rows:
        kept = []
        for line in (t or "").split("\n"):
            ids = held.get(key(line), [])
            known = [x for x in ids if x is not None]
            if len(ids) < docs or i == (max(known) if known else None):
                kept.append(line)
        out.append((i, "\n".join(kept), (t or "").count("\n") + 1))
    return out


@pytest.mark.parametrize("bound", [32 << 20, 1 << 12])
def test_line_dedup(docs, bound):
    from millrace.llm.line_dedup import line_dedup

    found = line_dedup(docs, max_filter_bytes=bound)
    assert found.columns == ["doc_id", "text", "kept", "__x", "group_size", "n_lines", "n_dropped"]
    assert sorted(repr((r.doc_id, r.text or "", r.n_lines)) for r in found.collect()) == sorted(map(repr, _lines(corpus())))
    assert found.where("kept = 'clash'").count() == len(corpus()) - 1


def _sets(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_dedup(docs):
    from millrace.llm.near_dedup import near_dedup

    rows = [r for r in corpus() if r[0] is not None]
    sets = {i: _sets(t) for i, t, *_ in rows}
    component = {i: i for i in sets}
    while True:
        new = dict(component)
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    new[a] = min(new[a], component[b])
        if new == component:
            break
        component = new
    found = near_dedup(docs, block=4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found.where("doc_id IS NOT NULL").collect()}
    assert got == {i: (len(sets[i]), component[i], component[i] == i) for i in sets}
    # a row without identifier joins the class of its text
    assert [tuple(r) for r in found.where("doc_id IS NULL").collect()] == [(None, 1, 2, False)]


def test_near_dedup_tells_rows_apart_by_text(spark):
    from millrace.llm.near_dedup import near_dedup, near_first

    a = " ".join(f"a{k}" for k in range(40))
    near_a = a + " more"
    b, c = " ".join(f"b{k}" for k in range(40)), " ".join(f"c{k}" for k in range(40))
    rows = [(2, a), (5, near_a), (5, b), (None, c), (None, c + " x"), (None, b.upper()), (9, None), (9, ""), (7, c), (7, c), (7, a.replace(" ", "  "))]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, __mr_key int").repartition(3)
    found = sorted((repr((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in near_dedup(df).collect()))
    want = [(2, 36, 2, True), (5, 37, 2, False), (5, 36, 5, True), (None, 36, 7, False), (None, 37, 7, False), (None, 36, 5, False), (9, 0, 9, True), (9, 0, 9, True), (7, 36, 7, True), (7, 36, 7, True), (7, 36, 2, False)]
    assert found == sorted(map(repr, want))
    left = near_first(df.drop("__mr_key"))
    assert sorted(map(repr, map(tuple, left.collect()))) == sorted(map(repr, [(2, a), (5, b), (7, c), (9, None), (9, "")]))
    only_null = spark.createDataFrame([(None, a), (None, near_a), (None, c)], "doc_id long, text string")
    assert near_first(only_null).count() == 2


def test_near_dedup_at_exactly_the_threshold(spark):
    from millrace.llm.near_dedup import near_dedup

    rows = []
    for k in range(30):
        words = [f"w{k}_{j}" for j in range(46)]
        rows.append((2 * k, " ".join(words)))
        rows.append((2 * k + 1, " ".join(words[:40] + [f"v{k}_{j}" for j in range(6)])))  # 42 shingles each, 36 shared of 48: 0.75
    found = {r.doc_id: r.component_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[2 * k + 1] == 2 * k for k in range(30))


def test_sketch_estimates_follow_similarity():
    from millrace.llm.near_dedup import may_reach, set_sketches

    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    a, near, far = np.unique(pool[:1000]), np.unique(pool[100:1050]), np.unique(pool[900:1900])
    s = set_sketches([a, near, far, np.unique(np.concatenate([a, far]))])
    assert (np.maximum(s[0], s[2]) == s[3]).all()  # mergeable
    n = np.array([float(len(a))])
    check = lambda k, m: may_reach(np.array([(s[0] > s[k]).sum()]), np.array([(s[0] < s[k]).sum()]), n, np.array([float(m)]), 0.75)[0]
    assert check(1, len(near)) and not check(2, len(far))


def test_empty_tables(spark, docs):
    from millrace.llm.exact_dedup import exact_dedup
    from millrace.llm.line_dedup import line_dedup
    from millrace.llm.near_dedup import near_dedup

    none = docs.limit(0)
    assert exact_dedup(none).count() == line_dedup(none).count() == near_dedup(none).count() == 0


def test_embedding_dedup(spark):
    from millrace.llm.embedding_dedup import embedding_dedup

    rng = np.random.default_rng(2)
    rows = []
    for c in range(6):
        center = rng.standard_normal(16)
        for _ in range(20):
            rows.append((len(rows), [float(x) for x in center + rng.standard_normal(16) * 0.12], 1, 0))
    rows += [(len(rows) + k, rows[0][1], 0, 0) for k in range(5)]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 0.0], [1.0, 0.0]]
    rows += [(len(rows) + k, v, None, 0) for k, v in enumerate(odd)]
    rows += [rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links int")
    ok = lambda v: v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0

    def linked(a, b):
        return bool(ok(a) and ok(b) and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95)

    table = [[linked(x[1], y[1]) for y in rows] for x in rows]
    component = {x[0]: x[0] for x in rows}
    for _ in range(12):
        for p, x in enumerate(rows):
            for q, y in enumerate(rows):
                if table[p][q]:
                    component[x[0]] = component[y[0]] = min(component[x[0]], component[y[0]])
    want = [(x[0], sum(t) - bool(ok(x[1])), component[x[0]], component[x[0]] == x[0]) for x, t in zip(rows, table)]
    for block in (512, 5):
        found = embedding_dedup(df, block=block)
        assert sorted(map(tuple, found.collect())) == sorted(want)
    assert embedding_dedup(df.limit(0)).count() == 0


def test_embeddings_are_told_apart_by_vector(spark):
    from millrace.llm.embedding_dedup import embedding_dedup

    x, y = [1.0, 0.0, 0.1, 0.0], [0.0, 1.0, 0.0, 0.1]
    near = lambda v, e: [v[0], v[1], v[2], v[3] + e]
    rows = [(1, x), (1, y), (9, near(x, 0.05)), (None, near(x, 0.02)), (4, near(y, 0.05)), (6, near(y, -0.05)), (None, y)]
    found = embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    want = [(1, 2, 1, True), (1, 3, 1, True), (9, 2, 1, False), (None, 2, 1, False), (4, 3, 1, False), (6, 3, 1, False), (None, 3, 1, False)]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    # a cosine of exactly 0.95 links: (20, 0) and (19, y) with 19 / 20, in numbers that leave no rounding
    tie = [(0, [20.0, 0.0]), (1, [19.0, math.sqrt(39.0)])]
    exact = np.dot(tie[0][1], tie[1][1]) / np.linalg.norm(tie[0][1]) / np.linalg.norm(tie[1][1])
    out = embedding_dedup(spark.createDataFrame(tie, "vec_id long, embedding array<double>"), threshold=float(exact)).collect()
    assert [r.n_links for r in out] == [1, 1]


def test_code_estimates_are_unbiased_and_bounded():
    from millrace.llm.embedding_dedup import EPS, encode, quantised, upper_bound

    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 64))
    y = 0.7 * x + 0.5 * rng.standard_normal((400, 64))
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    code, factor = encode(x, 7)
    planes, low, step, total = quantised(y, 7)
    exact = (x * y).sum(1)
    bound = upper_bound(code, factor, planes, low, step, total)
    bits = 128
    slack = (np.sqrt(1 - factor**2) * EPS / np.sqrt(bits - 1) + step * EPS / np.sqrt(12)) / factor
    assert (bound >= exact).all() and abs((bound - slack - exact).mean()) < 0.01


def test_warc(spark, tmp_path):
    from millrace.llm.warc import archive, read_warc, urn_page

    rows = [(5, "http://a/\nb c", "<p>é</p>", 1), (2, None, "<p>é</p>", 1), (9, "u", None, None), (7, "u", "", 0), (11, "v", "z" * 300_000, 2), (2, None, "<p>é</p>", 1), (None, "n", "<p>é</p>", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type int")
    folder = "file://" + str(tmp_path / "w")
    found = archive(df, folder).select(urn_page("record_id").alias("p"), "payload_bytes", "payload_digest", "record_type", urn_page("refers_to").alias("r")).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    owner = {"<p>é</p>": 2, "": 7, "z" * 300_000: 11}
    want = [(p, len((t or "").encode()), digest(t), *(("response", None) if p == owner[t or ""] else ("revisit", owner[t or ""]))) for p, _, t, _ in rows]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    full = read_warc(spark, folder)
    assert {r.payload.decode() for r in full.where("record_type = 'response'").select("payload").collect()} == {"<p>é</p>", "", "z" * 300_000}
    assert full.where("record_type = 'revisit' AND payload_bytes > 5").count() == 2
    assert full.where("target_uri IS NULL").count() == 2
    assert archive(df.limit(0), "file://" + str(tmp_path / "none")).count() == 0


def test_warc_skips_without_inflating(spark, tmp_path):
    import gzip
    import zlib

    from pyarrow import fs

    from millrace.llm.warc import RecordStream, read_warc, record

    rng = random.Random(1)
    bodies = [bytes(rng.randrange(256) for _ in range(200_000)), b"", b"short\r\n\r\nwith a gap", bytes(rng.randrange(256) for _ in range(300_000))]
    parts = [record(k, f"http://x/{k}", b, None, 0) for k, b in enumerate(bodies)]
    # a record of another writer: no skip lengths, no HTTP block
    other = zlib.compressobj(6, zlib.DEFLATED, 31)
    plain = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Type: text/plain\r\nContent-Length: 5000\r\n\r\n" + b"p" * 5000 + b"\r\n\r\n"
    parts.insert(2, other.compress(plain) + other.flush())
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    assert len(gzip.decompress(b"".join(parts))) > 500_000  # any gzip reader reads it

    def stream():
        return RecordStream(fs.LocalFileSystem().open_input_file(str(tmp_path / "a.warc.gz")), 4096)

    reader, kinds = stream(), []
    while (head := reader.headers()) is not None:
        kinds.append(head["warc-type"])
        reader.skip()
    assert kinds == ["response", "response", "resource", "response", "response"] and reader.inflated < 20_000
    reader, found = stream(), []
    while reader.headers() is not None:
        found.append(reader.payload())
    assert found == [*bodies[:2], b"p" * 5000, *bodies[2:]]
    rows = read_warc(spark, "file://" + str(tmp_path)).where("record_type = 'resource'").collect()
    assert [bytes(r.payload) for r in rows] == [b"p" * 5000]


def test_hot_keys_are_joined_without_meeting(spark, docs, monkeypatch):
    from millrace.llm import line_dedup as lines, near_dedup as near, skew, warc

    plain = [sorted(map(repr, map(tuple, f(docs).collect()))) for f in (lines.line_dedup, near.near_dedup)]
    pages = docs.selectExpr("doc_id AS page_id", "'u' AS url", "text AS html")
    names = ("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    archived = sorted(map(repr, map(tuple, warc.archive(pages).select(*names).collect())))
    monkeypatch.setattr(skew, "hot_limit", lambda total, *a: 1)
    monkeypatch.setattr(warc, "hot_limit", lambda total, *a: 1)
    assert plain == [sorted(map(repr, map(tuple, f(docs).collect()))) for f in (lines.line_dedup, near.near_dedup)]
    assert archived == sorted(map(repr, map(tuple, warc.archive(pages).select(*names).collect())))
    assert skew.hot_limit(10) == 1


def test_components(spark):
    from millrace.llm.graph import components

    chain = [(k, k + 1) for k in range(40)] + [(100, 50), (50, 70), (7, 7), (None, 3)]
    found = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert found == {**dict.fromkeys(range(41), 0), 50: 50, 70: 50, 100: 50}
