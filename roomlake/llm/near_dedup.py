"""MinHash near-dedup by a multi-index Hamming join over b-bit signatures."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, numbered, small_batches

#: Signature: SLOTS values of 16 bits. Two sets of similarity s differ in a slot with probability 1 - s; within RADIUS
#: differences they surely share a bucket, beyond it almost always: at 0.8 no bucket is shared with probability 3e-7.
SLOTS, RADIUS = 64, 23
#: Signatures that differ in more slots are not compared on full sets, wherever they meet: at 0.8 that has probability 3e-7.
SCREEN = 30
#: A bucket with more members than this, in several components, is compared in blocks of BLOCK documents.
HOT_BUCKET, BLOCK = 64, 64
#: A document with a larger set is a block of its own.
LONG_SET = 20_000
#: At most this many ids (16 MB) are broadcast to the scan of the texts.
MAX_BROADCAST_IDS = 2_000_000
#: Links that one task of the component search takes.
LINKS_PER_TASK = 200_000
#: A node with more than this share of all link ends is joined by broadcast; there are at most HUBS of them.
HUBS = 512
#: Words whose hashes a task keeps before it starts anew.
CACHE_WORDS = 150_000
#: Rounds in which each bucket compares its members with one leader before the exact round.
STAR_ROUNDS = 1
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
_MIX = np.uint64(0x9E3779B97F4A7C15)


def chunks(slots: int = SLOTS, radius: int = RADIUS) -> list[tuple[range, int]]:
    """(slots of a chunk, errors allowed in it): pigeonhole over sum(errors + 1) > radius.

    With one error a chunk, (radius + 1) / 2 chunks suffice: signatures within the radius agree in some
    chunk but for one slot at most.
    """
    n = -(-(radius + 1) // 2)
    bounds = [slots * k // n for k in range(n + 1)]
    return [(range(a, b), 1) for a, b in zip(bounds, bounds[1:])]


class Shingler:
    """64-bit hashes of the distinct word n-grams of lower-cased texts; words are hashed once a worker."""

    def __init__(self, words: int) -> None:
        self.words, self.known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        found = (text or "").encode().translate(_LOWER).split()  # bytes split at the six ASCII spaces alone
        if not found:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(found).difference(known):
            known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        n = min(self.words, len(h))
        mixed = np.full(len(h) - n + 1, np.uint64(n))
        for k in range(n):
            mixed = (mixed ^ h[k : len(h) - n + 1 + k]) * _MIX
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


_SEEDS = np.random.default_rng(20240501).integers(1, 1 << 62, size=(2, SLOTS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """SLOTS b-bit minima (16 bits each) of a set of hashes."""
    low = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        x = hashes[at : at + 4096, None] * _SEEDS[0]
        x ^= x >> np.uint64(32)
        x *= _SEEDS[1]
        low = np.minimum(low, x.min(axis=0))
    low ^= low >> np.uint64(31)
    return ((low * _MIX) >> np.uint64(48)).astype(np.uint16)


def bucket_keys(sig: np.ndarray) -> np.ndarray:
    """Hashes of each chunk with each allowed slot left out: equal keys mean agreement within the chunk's errors."""
    keys = []
    s = sig.astype(np.uint64)
    for c, (slots, _) in enumerate(chunks()):
        for gone in slots:
            key = np.uint64((c * 64 + gone + 1) * int(_MIX) % (1 << 64))
            for k in slots:
                if k != gone:
                    key = (key ^ s[..., k]) * _MIX
                    key = key ^ (key >> np.uint64(31))
            keys.append(key)
    return np.stack(keys, axis=-1).view(np.int64)


def _describe(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for batch in batches:
            n, digest, sig = [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py())
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], names=["id", "n", "digest", "sig"])

    return run


def _distance(a: Column, b: Column) -> Column:
    """Pandas UDF: slots in which two signatures differ."""

    @F.pandas_udf("int")
    def differing(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="int32")
        p, q = (np.frombuffer(b"".join(v), np.uint16).reshape(len(v), SLOTS) for v in (x, y))
        return pd.Series((p != q).sum(axis=1).astype("int32"))

    return differing(a, b)


def _join_small(ends: DataFrame, told: DataFrame, n_ends: int) -> DataFrame:
    """``ends`` (u, v) with ``told`` (u, m, degree), one row a node.

    The ends of a hub, a node that has more than 1/HUBS of them, never move: the rows of the hubs, HUBS at most, are broadcast. So no
    node's ends are gathered in one task beyond that share.
    """
    hub = F.col("degree") * HUBS > n_ends
    hubs = told.filter(hub).select("u", "m").collect()  # HUBS rows at most
    if not hubs:
        return ends.join(told.select("u", "m"), "u")
    few = F.broadcast(ends.sparkSession.createDataFrame(hubs, "u long, m long"))
    rest = ends.join(few.select("u"), "u", "left_anti").join(told.filter(~hub).select("u", "m"), "u")
    return ends.join(few, "u").unionAll(rest)


def components(links: DataFrame, nodes: str = "node") -> DataFrame:
    """(node, root): smallest node reachable, for every node of the links (a, b).

    Alternates two star steps: every node hangs its larger neighbours on its smallest neighbour, then
    its smaller ones; checkpointed each time, until nothing changes. Minima are partial aggregates and a hub's
    links are joined where they are (_join_small), so a hub is never gathered in one task.
    """
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    state, seen = _state(edges), None
    while state != seen:
        # as few tasks as the links need: each step's files are counted by tasks, not by rows
        few = max(1, math.ceil(state[0] / LINKS_PER_TASK))
        edges = edges.coalesce(few)
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
        low = checkpointed(low.select("u", F.least("u", "m").alias("m"), "degree").coalesce(few))
        large = _join_small(both, low, 2 * state[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        large = checkpointed(large.coalesce(few).distinct().coalesce(few))
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
        stars = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = _join_small(large, least, state[0]).select(F.explode(stars).alias("e")).select("e.*").filter("u > v")
        edges = checkpointed(small.coalesce(few).distinct().coalesce(few))
        state, seen = _state(edges), state
    own = edges.select(F.col("v").alias(nodes), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias(nodes), F.col("v").alias("root")).unionAll(own)


def _state(edges: DataFrame) -> tuple:
    """(number, digest) of the links."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        held: tuple[int | None, np.ndarray] = (None, np.empty(0))
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb, good = batch.column("text_a"), batch.column("text_b"), []
            for k in range(len(a)):
                if held[0] != a[k]:
                    held = (a[k], shingles(ta[k].as_py()))
                x, y = held[1], shingles(tb[k].as_py())
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good)], names=["a", "b", "good"])

    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long, good boolean").filter("good").select("a", "b")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: key, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; a document's set is its distinct
    ``words``-word shingles (the whole sequence if it is shorter). Documents link if 100 * intersection >=
    ``percent`` * union on full sets; component_id is the smallest key reachable by links.

    Equal sets are one class, represented by its smallest key. Signatures are cut into chunks by pigeonhole and each chunk
    is indexed with each allowed error, so every pair within RADIUS shares a bucket; pairs up to SCREEN that share one are compared too. A bucket's members are first
    compared with one leader (STAR_ROUNDS times, another leader each time), which joins large groups without all their
    pairs; then all pairs of a bucket between different components are compared, in crowded buckets by blocks of
    texts (_hot_links). So no link between components that share a bucket is lost, and pairs within a
    component are never enumerated. Every link is confirmed on full sets, whatever its bucket's size.

    Null and empty texts have no shingles and stand alone; keys are integers (others raise an error); a null key is a component of its own (null);
    repeated keys link if any of their texts do; an empty table gives no rows; other columns are not read, whatever their names.
    Texts of any length are read whole; a worker holds one batch of them, or two blocks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    told = checkpointed(slim.mapInArrow(_describe(words), "id long, n long, digest binary, sig binary"))
    valid = told.filter("digest is not null and id is not null")
    reps = checkpointed(valid.groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")))

    @F.pandas_udf("array<long>")
    def keys(sigs: pd.Series) -> pd.Series:
        if not len(sigs):
            return pd.Series([], dtype=object)
        return pd.Series(list(bucket_keys(np.frombuffer(b"".join(sigs), np.uint16).reshape(len(sigs), SLOTS))))

    # what is joined to by bucket is written first, so that Spark can split a hot bucket of either side
    entries = reps.select("rep", "n", F.explode(keys("sig")).alias("bucket"))
    crowded = checkpointed(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket"))
    index = checkpointed(entries.join(crowded, "bucket").select("bucket", "rep", "n"))
    texts = checkpointed(_wanted_texts(slim, index.select(F.col("rep").alias("id")).distinct(), told))

    sigs = reps.select("rep", "sig")

    def confirm(pairs: DataFrame) -> DataFrame:
        told_a = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")
        both = told_a.join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
        near = both.filter(_distance(F.col("sig_a"), F.col("sig_b")) <= SCREEN).select("a", "b")
        return checkpointed(_verified(checkpointed(near), texts, words, percent).distinct())

    links = spark.createDataFrame([], "a long, b long")
    placed = index.withColumn("root", F.col("rep"))
    alike = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)  # noqa: E731  no link between sizes further apart
    for turn in range(STAR_ROUNDS):
        rank = F.xxhash64("rep", F.lit(turn))
        leaders = checkpointed(
            placed.groupBy("bucket").agg(F.min_by(F.struct("rep", "root", "n"), rank).alias("lead"), F.min("root").alias("r0"), F.max("root").alias("r1"))
            .filter("r0 <> r1").select("bucket", F.col("lead.rep").alias("lead"), F.col("lead.root").alias("lead_root"), F.col("lead.n").alias("lead_n"))
        )
        pairs = placed.join(leaders, "bucket").filter((F.col("root") != F.col("lead_root")) & alike(F.col("n"), F.col("lead_n")))
        links = links.unionAll(confirm(pairs.select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()))
        placed = _with_roots(index, links)
    mixed = checkpointed(placed.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("size")).filter("r0 <> r1").select("bucket", "size"))
    open_ = checkpointed(placed.join(mixed, "bucket"))
    few = open_.filter(F.col("size") <= HOT_BUCKET).drop("size")
    other = few.select("bucket", F.col("rep").alias("b"), F.col("root").alias("root_b"), F.col("n").alias("n_b"))
    across = few.select("bucket", F.col("rep").alias("a"), "root", "n").join(other, "bucket").filter((F.col("root") < F.col("root_b")) & alike(F.col("n"), F.col("n_b")))
    links = links.unionAll(confirm(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
    links = links.unionAll(_hot_links(open_.filter(F.col("size") > HOT_BUCKET), texts.join(sigs.withColumnRenamed("rep", "id"), "id"), words, percent))
    roots = components(links)

    classes = reps.select("digest", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("component_id"))
    found = told.select("id", "n", "digest").join(classes, "digest", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return found.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept")
    )


def _with_roots(index: DataFrame, links: DataFrame) -> DataFrame:
    """Index rows with the component that the links so far put them in."""
    roots = components(links).withColumnRenamed("node", "rep")
    return checkpointed(index.join(roots, "rep", "left").select("bucket", "rep", "n", F.coalesce("root", "rep").alias("root")))


def _hot_links(hot: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between components among the members of crowded mixed buckets, on full sets.

    Buckets with the same largest component form a cluster, so both members of a pair are in one. Its members, in order of
    component, are cut into blocks of BLOCK texts (a very long text is one), and a task compares two blocks at a time: all their pairs by one product of 0/1 matrices. Only confirmed links
    leave the task, one a pair of components; two blocks of one component are not compared, nor blocks whose sizes rule a link out. Block p of
    n goes with the n / 2 blocks after it, round the circle, so every block is on either side equally often: pairs are made
    where their block p is and dealt by (cluster, p), then (cluster, q), keys with n / 2 pairs each. So a
    cluster of any size is many small tasks, and no pair becomes a row.
    """
    spark = hot.sparkSession
    hot = checkpointed(hot)
    if hot.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    shares = hot.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("k"))
    cluster = checkpointed(shares.groupBy("bucket").agg(F.max(F.struct("k", "root")).alias("m")).select("bucket", F.col("m.root").alias("cluster")))
    members = checkpointed(hot.join(cluster, "bucket").select("cluster", "rep", "root", "n").distinct())
    raw = F.when(F.col("n") > LONG_SET, -1 - F.col("at")).otherwise(F.expr(f"at div {BLOCK}"))
    placed = checkpointed(numbered(members, ["cluster"], ["root", "n", "rep"], "at").withColumn("raw", raw))
    stats = placed.groupBy("cluster", "raw").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    blocks = checkpointed(numbered(checkpointed(stats), ["cluster"], ["raw"], "block"))
    placed = placed.join(blocks.select("cluster", "raw", "block"), ["cluster", "raw"])
    sizes = blocks.groupBy("cluster").agg(F.count(F.lit(1)).alias("blocks"))
    x = blocks.join(sizes, "cluster").withColumn("d", F.explode(F.expr("sequence(0L, blocks div 2)"))).withColumn("q", F.expr("(block + d) % blocks"))
    x = x.filter("d * 2 < blocks or (d * 2 = blocks and block < q)").alias("x")  # the opposite block is met from both sides
    y = blocks.alias("y")
    one = (F.col("x.r0") == F.col("x.r1")) & (F.col("y.r0") == F.col("y.r1")) & (F.col("x.r0") == F.col("y.r0"))
    reach = (100 * F.col("x.n1") >= percent * F.col("y.n0")) & (100 * F.col("y.n1") >= percent * F.col("x.n0"))
    tasks = x.join(y, (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.q") == F.col("y.block")) & ~one & reach)
    tasks = checkpointed(tasks.select("x.cluster", F.col("x.block").alias("p"), F.col("y.block").alias("q")))
    loads = checkpointed(placed.join(texts.withColumnRenamed("id", "rep"), "rep").groupBy("cluster", "block").agg(F.collect_list(F.struct("rep", "root", "sig", "text")).alias("docs")))
    both = tasks.join(loads.select("cluster", F.col("block").alias("p"), F.col("docs").alias("mine")), ["cluster", "p"]).join(loads.select("cluster", F.col("block").alias("q"), F.col("docs").alias("theirs")), ["cluster", "q"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for batch in batches:
            for k in range(batch.num_rows):
                sides = []
                for name in ("mine", "theirs"):
                    docs = batch.column(name)[k].as_py()
                    sig = np.frombuffer(b"".join(d["sig"] for d in docs), np.uint16).reshape(len(docs), SLOTS)
                    sides.append(([shingles(d["text"]) for d in docs], np.array([d["rep"] for d in docs]), np.array([d["root"] for d in docs]), sig))
                (xs, xi, xr, xg), (ys, yi, yr, yg) = sides
                nx, ny = np.array([len(v) for v in xs]), np.array([len(v) for v in ys])
                common = _common(xs, ys)
                close = (xg[:, None, :] != yg).sum(axis=2) <= SCREEN
                i, j = np.nonzero(close & (100 * common >= percent * (nx[:, None] + ny - common)) & (xr[:, None] != yr))
                if len(i):
                    _, keep = np.unique(np.stack([xr[i], yr[j]]), axis=1, return_index=True)
                    yield pa.RecordBatch.from_arrays([pa.array(xi[i[keep]]), pa.array(yi[j[keep]])], names=["a", "b"])

    # a row holds two blocks of texts, so few go to a worker at once
    return checkpointed(both.select("mine", "theirs").mapInArrow(run, "a long, b long"))


def _common(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by slices of the shared values."""
    out = np.zeros((len(xs), len(ys)), np.int64)
    flat = [np.concatenate(s) if s else np.empty(0, np.uint64) for s in (xs, ys)]
    shared = np.intersect1d(*flat)
    owners = [np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (xs, ys)]
    spots = []
    for values, owner in zip(flat, owners):
        at = np.minimum(np.searchsorted(shared, values), max(len(shared) - 1, 0))
        hit = shared[at] == values if len(shared) else np.zeros(len(values), bool)
        spots.append((at[hit], owner[hit]))
    for lo in range(0, len(shared), 8192):
        sides = []
        for (at, owner), s in zip(spots, (xs, ys)):
            m = np.zeros((len(s), min(8192, len(shared) - lo)), np.float32)
            pick = (at >= lo) & (at < lo + 8192)
            m[owner[pick], at[pick] - lo] = 1
            sides.append(m)
        out += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    return out


def _wanted_texts(slim: DataFrame, wanted: DataFrame, told: DataFrame) -> DataFrame:
    """(id, text) of the wanted ids; few ids go to the texts by broadcast, many meet them by sort-merge."""
    wanted = checkpointed(wanted)
    few = wanted.count() <= MAX_BROADCAST_IDS
    texts = slim.join(F.broadcast(wanted) if few else wanted, "id", "left_semi")
    repeats = told.filter("id is not null").groupBy("id").count().filter("count > 1").limit(1).count()
    return texts.dropDuplicates(["id", "text"]) if repeats else texts


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows that stay, with all their columns: each component's smallest key (and its repeated rows, null keys too).

    Nulls, ties, long texts and empty tables as in near_groups; no column of ``docs`` is touched, whatever its name.
    """
    gone = near_groups(docs, key, text, words, percent).filter("not kept").select(F.col(key)).distinct()
    return docs.join(gone, key, "left_anti")
