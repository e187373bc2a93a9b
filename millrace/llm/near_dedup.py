"""MinHash-style near-dedup on SetSketch registers.

Every shingle starts a Poisson process of marked arrivals, one mark per register; a register's
smallest arrival is an exponential minimum, kept as floor(1 - log_b) and truncated to 16 bits
(b = 1.001), so sketches merge by maximum and equal registers tell similarity. Four
registers make a band. Documents with equal shingle sets become one class first. In each bucket
every class is compared with the bucket's smallest one (a star, not all pairs); where
the other members then still lie in different components, their pairs between components are
compared in blocks. A comparison first estimates the similarity jointly from the counts of
greater, smaller and equal registers and the known set sizes; only a pair whose
likelihood ratio rules the threshold out is dropped, the rest is verified on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.graph import components
from millrace.llm.skew import lookup_join
from millrace.session import bounded_batches, materialise
from millrace.llm.worker import owns

M = 128
BANDS = 32
BASE = 1.001
RATE = 20.0
TOP = 65535
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
POLY = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles; a shorter text is one shingle, one without words none."""
    words = [(t or b"").lower().split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    total = int(counts.sum())
    flat = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in words for w in ws), np.uint64, total)
    rolled = np.zeros(max(0, total - size + 1), np.uint64)
    for k in range(size):
        rolled = rolled * POLY + flat[k : k + len(rolled)]
    rolled = _mix(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(rolled[at : at + n - size + 1]))
        elif n:
            value = np.full(1, n, np.uint64)
            for w in flat[at : at + n]:
                value = value * POLY + w
            out.append(_mix(value + GOLDEN))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def set_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers, one row of M unsigned 16-bit integers per set."""
    low = np.full((len(sets), M), np.inf)
    state = np.concatenate([*sets, np.zeros(0, np.uint64)])
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    time = np.zeros(len(state))
    flat, draws = low.ravel(), 1
    while len(state):
        for _ in range(draws):
            state = state + GOLDEN
            z = _mix(state)
            time = time - np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (M * RATE)
            np.minimum.at(flat, doc * M + (z & np.uint64(M - 1)).astype(np.int64), time)
        go = time < low.max(axis=1)[doc]
        state, doc, time = state[go], doc[go], time[go]
        draws = min(16, draws * 2)
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(1.0 - np.log(low) / np.log(BASE)), 0, TOP).astype(np.uint16)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1) / BASE) / np.log(BASE)


def may_reach(plus: np.ndarray, minus: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float, ratio: float = 10.0) -> np.ndarray:
    """Whether similarity >= threshold stays possible for pairs with these register counts and set sizes.

    Joint log-likelihood of the similarity J: plus * log p(u - vJ) + minus * log p(v - uJ) +
    equal * log(1 - both). A pair is ruled out only if some J below the threshold is
    more likely than every J at or above it by a factor of e^ratio.
    """
    u = n_a / (n_a + n_b)
    v = 1.0 - u
    most = np.minimum(u / v, v / u)
    tiny = 1e-12

    def fit(js: np.ndarray) -> np.ndarray:
        best = np.full(len(u), -np.inf)
        for j in js:
            j = np.minimum(j, most)
            up, down = _p(u - v * j), _p(v - u * j)
            ll = plus * np.log(np.maximum(up, tiny)) + minus * np.log(np.maximum(down, tiny)) + (M - plus - minus) * np.log(np.maximum(1 - up - down, tiny))
            best = np.maximum(best, ll)
        return best

    return fit(np.linspace(0, threshold, 26)[:-1]) - fit(np.linspace(threshold, 1.0, 11)) <= ratio


def _profile(size: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), ("registers", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns("near")
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                sets = shingle_sets(part.column(1).cast(pa.binary()).to_pylist(), size)
                registers = set_sketches(sets)
                keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.record_batch([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in registers], pa.binary())], schema=schema)

    return run


def _sets(size: int):
    schema = pa.schema([("set_key", pa.binary()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns("near")
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                sets = [s.tobytes() for s in shingle_sets(part.column(1).cast(pa.binary()).to_pylist(), size)]
                yield pa.record_batch([pa.array(list(map(xxhash.xxh3_128_digest, sets)), pa.binary()), pa.array(sets, pa.binary())], schema=schema)

    return run


def _with_key(size: int, text_col: str, names: list[str]):
    """Rows with the key of their shingle set as __mr_key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns("near")
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                sets = shingle_sets(part.column(text_col).cast(pa.binary()).to_pylist(), size)
                yield pa.record_batch([*part.columns, pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())], names=[*names, "__mr_key"])

    return run


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _estimate(threshold: float):
    """(a, b, n_a, n_b, registers of both) -> pairs that may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns("near")
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("ra", "rb"))
            n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b"))
            ok = may_reach((ra > rb).sum(1), (ra < rb).sum(1), n_a, n_b, threshold)
            yield pa.record_batch([batch.column("a"), batch.column("b")], schema=PAIR).filter(pa.array(ok))

    return run


def _blocks(hundredths: int):
    """Rows in order of (bucket, i, j), side -> links between components of a bucket's block, or of two blocks.

    A pair is compared in the first band only where it shares a bucket; links that join what a
    block has joined before are left out, so at most one row per member comes out.
    """
    threshold = hundredths / 100

    def links(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        ids, root, n, side = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2, 5))
        band = rows[0][6]
        regs = np.frombuffer(b"".join(r[3] for r in rows), np.uint16).reshape(-1, M)
        keys = regs.view(np.uint64)
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        two = bool(side.any())
        order = np.arange(len(ids))
        code = owner = None
        for x in np.flatnonzero(side == 0).tolist():
            ok = (root != root[x]) & (100 * np.minimum(n, n[x]) >= hundredths * np.maximum(n, n[x])) & (side == 1 if two else order > x)
            other = np.flatnonzero(ok)
            if len(other) and band:
                other = other[~(keys[other, :band] == keys[x, :band]).any(1)]
            if len(other):
                other = other[may_reach((regs[x] > regs[other]).sum(1), (regs[x] < regs[other]).sum(1), np.full(len(other), float(n[x])), n[other].astype(float), threshold)]
            if not len(other):
                continue
            if len(other) < 16:
                common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for y in other.tolist()])
            else:
                if code is None:
                    values, code = np.unique(np.concatenate(sets), return_inverse=True)
                    owner = np.repeat(order, n)
                    mine, ends = np.zeros(len(values), bool), np.cumsum(n)
                own = code[ends[x] - n[x] : ends[x]]
                mine[own] = True
                common = np.bincount(owner[mine[code]], minlength=len(ids))[other]
                mine[own] = False
            for y in other[100 * common >= hundredths * (n[x] + n[other] - common)].tolist():
                if root[y] != root[x]:
                    root[root == root[y]] = root[x]
                    yield int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns("near")
        current, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            found = list(links(held)) if len(held) > 1 else []
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], schema=PAIR)

        for batch in batches:
            for bucket, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j", "id", "component", "n", "registers", "shingles", "side", "band"))):
                if (bucket, i, j) != current:
                    yield from done()
                    current, held = (bucket, i, j), []
                held.append(row)
        yield from done()

    return run


def _verify(hundredths: int):
    """(a, b, sa, sb) -> links by exact intersection of the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns("near")
        for batch in batches:
            keep = []
            for sa, sb in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                na, nb = len(sa) // 8, len(sb) // 8
                both = np.sort(np.concatenate([np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= hundredths * (na + nb - common))
            yield pa.record_batch([batch.column("a"), batch.column("b")], schema=PAIR).filter(pa.array(keep, pa.bool_()))

    return run


def _grouped(df: DataFrame, id_col: str, text_col: str, hundredths: int, shingle: int, block: int, broadcast_ids: int) -> DataFrame:
    """Per input row: id, n, set_key; and of its component the smallest identifier (head) and the set that has it (head_key). Null heads and keys: an empty set, or no identifier known."""
    bounded_batches(df.sparkSession)
    threshold = hundredths / 100
    base = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    profile = materialise(base.mapInArrow(_profile(shingle), "id long, n long, set_key binary, registers binary"), "profiles")
    classes = profile.where("n > 0").groupBy("set_key").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # numbers are as written; two sets may share an identifier
    wide = classes.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.substring(F.col("registers"), k * 8 + 1, F.lit(8)))).alias("band", "key"))
    # the band in the low bits: a bucket tells its band
    member = wide.select((F.shiftleft(F.xxhash64("band", "key"), 5) + F.col("band")).alias("bucket"), "id")
    buckets = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("center")).where("size > 1")
    buckets = materialise(buckets, "buckets")
    total = buckets.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    member = materialise(lookup_join(member, buckets, "bucket", "size", total).where(F.col("id") != F.col("center")), "members")

    known = classes.select("id", "n", "registers")

    def sized(pairs: DataFrame) -> DataFrame:
        centers = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("pairs")).join(known.toDF("a", "n_a", "ra"), "a")
        return (
            lookup_join(pairs, centers, "a", "pairs", total)
            .join(known.toDF("b", "n_b", "rb"), "b")
            .where(100 * F.least("n_a", "n_b") >= hundredths * F.greatest("n_a", "n_b"))
            .mapInArrow(_estimate(threshold), "a long, b long")
        )

    def sets_of(ids: DataFrame) -> DataFrame:
        ids = materialise(ids.distinct().join(classes.select("id", "set_key", "least"), "id"), "set-ids")
        docs = ids.select(F.col("least").alias("__mr_least")).distinct()
        docs = F.broadcast(docs) if ids.count() <= broadcast_ids else docs
        made = base.join(docs, F.col("id").eqNullSafe(F.col("__mr_least")), "left_semi").mapInArrow(_sets(shingle), "set_key binary, shingles binary")
        return materialise(made.join(ids.select("id", "set_key"), "set_key").groupBy("id").agg(F.first("shingles").alias("shingles")), "sets")

    star = materialise(sized(materialise(member.select(F.col("center").alias("a"), F.col("id").alias("b")).distinct(), "stars")), "star-pairs")
    sets = sets_of(star.select(F.explode(F.array("a", "b")).alias("id")))
    both = star.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a")
    links = materialise(both.mapInArrow(_verify(hundredths), "a long, b long"), "links")
    found = materialise(components(links), "first-components")

    # what the stars left open: members of one bucket, the center apart, in different components
    labelled = member.where("size > 2").join(found, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component")).join(classes.select("id", "n"), "id")
    open_ = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("all")).where("lo < hi")
    parts = F.greatest(F.ceil(F.col("size") / F.lit(block)), F.ceil(F.col("all") / F.lit(block * 2000))).cast("int")
    rest = materialise(lookup_join(labelled.drop("n"), open_.select("bucket", "size", parts.alias("parts")), "bucket", "size", total).drop("size"), "open-members")
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j"), (F.col("own") > k).cast("int").alias("side")))
    full = rest.withColumn("own", own).join(known, "id").join(sets_of(rest.select("id")), "id").withColumn("band", F.pmod("bucket", F.lit(BANDS)).cast("int"))
    dealt = full.withColumn("cell", F.explode(cells)).select("bucket", "cell.i", "cell.j", "cell.side", "id", "component", "n", "registers", "shingles", "band")
    second = materialise(dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side").mapInArrow(_blocks(hundredths), "a long, b long"), "open-links")
    if not second.isEmpty():
        found = materialise(components(links.union(second)), "components")

    of_class = materialise(classes.select("id", "set_key", "least").join(found, "id", "left").select("set_key", "least", F.coalesce("component", "id").alias("component")), "class-components")
    # the head is the set that has the smallest identifier; the smallest key decides where sets share it
    best = of_class.groupBy("component").agg(F.min("least").alias("head"), F.min(F.struct(F.col("least").isNull(), "least", "set_key")).alias("b"))
    heads = of_class.join(best, "component").select("set_key", "head", F.col("b.set_key").alias("head_key"))
    return profile.select("id", "n", F.when(F.col("n") > 0, F.col("set_key")).alias("set_key")).join(heads, "set_key", "left")


def near_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hundredths: int = 75, shingle: int = 5, block: int = 512, broadcast_ids: int = 2_000_000
) -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, component_id, kept.

    Words are runs free of ASCII white space, A-Z lower-cased; a set holds the distinct shingles
    of ``shingle`` words as 64-bit hashes; sets link where 100 * common >= ``hundredths`` *
    union. With 32 bands of four registers a pair at 0.75 is missed with a chance below
    one in 100,000. Null and empty texts have empty sets and link with nothing. Rows are told apart by
    set, not by identifier: rows that repeat an identifier with different texts have components of their own,
    and rows of null identifier link like any other. component_id is the smallest identifier reachable, null
    where a component has none, and every row that bears it is kept. ``block``: size of blocks in buckets compared
    between components. ``broadcast_ids``: up to so many identifiers (8 bytes each) are broadcast
    to pick the documents whose sets are needed; beyond, a shuffle join does it. Further
    columns are ignored; an empty table gives no rows.
    """
    component = F.when(F.col("n") > 0, F.col("head")).otherwise(F.col("id"))
    return _grouped(df, id_col, text_col, hundredths, shingle, block, broadcast_ids).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


def near_first(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hundredths: int = 75, shingle: int = 5, block: int = 512, broadcast_ids: int = 2_000_000
) -> DataFrame:
    """The rows of ``df`` with one row left of each component (see near_dedup), unchanged.

    The row of the component's smallest identifier stays; of several rows with this identifier and the same set,
    one of the smallest text. Decisions hold by row: where an identifier repeats with different texts, the
    loss of one leaves the others alone. Rows with empty sets all stay.
    """
    rows = materialise(_grouped(df, id_col, text_col, hundredths, shingle, block, broadcast_ids).withColumn("stays", (F.col("n") == 0) | (F.col("id").eqNullSafe(F.col("head")) & (F.col("set_key") == F.col("head_key")))), "near-rows")
    many = materialise(rows.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("id").alias("__mr_id")), "repeated-ids")
    gone = rows.where(~F.col("stays")).select(F.col("id").alias("__mr_id")).union(many)
    own = F.col(id_col).cast("long").eqNullSafe(F.col("__mr_id"))
    single = df.join(gone, own, "left_anti")
    if many.isEmpty():
        return single
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", __mr_key binary"
    keyed = df.join(many, own, "left_semi").mapInArrow(_with_key(shingle, text_col, df.columns), ddl)
    decided = rows.where("stays AND n > 0").select(F.col("id").alias("__mr_id"), F.col("set_key").alias("__mr_set")).distinct()
    held = keyed.join(decided, own & (F.col("__mr_key") == F.col("__mr_set"))).groupBy("__mr_id", "__mr_set").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("row")).select("row.*")
    empty = keyed.where(F.col("__mr_key") == F.lit(xxhash.xxh3_128_digest(b""))).drop("__mr_key")
    return single.unionByName(held).unionByName(empty)
