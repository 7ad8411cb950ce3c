"""Edges of the operators: inputs read twice in another order, clashing columns, empty tables, limits that once cut."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomlake.llm import common, exact_dedup, language_crf, line_rules, lm_scoring, mixing, near_dedup, packing, quality_cnn

from .conftest import text

#: Names that operators use inside or give to their results.
CLASHING = ["rate", "copy", "shuffle_key", "_source", "_cdf", "_n", "_row", "_digest", "_edge", "_part", "_least", "_text", "_lines", "_verdicts", "_raw", "cleaned", "is_target", "sequence_id", "score", "component_id"]


@pytest.fixture(scope="session")
def clashing(awkward):
    return awkward.drop("_row").select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(c) for c in CLASHING])


def same_columns(made, given, but=()):
    """The rows of ``made`` are rows of ``given``, in all columns but those."""
    names = [c for c in given.columns if c not in but]
    assert set(names) <= set(made.columns)
    have = {tuple(r) for r in given.select(names).collect()}
    rows = [tuple(r) for r in made.select(names).collect()]
    assert set(rows) <= have
    return rows


# exact dedup


@pytest.mark.parametrize("shape", ["repartition", "distinct", "join", "parquet", "few"])
@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_drop_of_any_input(spark, clashing, tmp_path, shape, keep):
    copies = spark.range(3000).select((F.col("id") + 9000).alias("doc_id"), F.concat(F.lit("one beginning " * 20), (F.col("id") % 40).cast("string")).alias("text"))
    docs = clashing.unionByName(copies, allowMissingColumns=True)
    if shape == "repartition":
        docs = docs.repartition(13)
    elif shape == "distinct":
        docs = docs.distinct()
    elif shape == "join":
        docs = docs.join(docs.select("doc_id").distinct(), "doc_id")
    elif shape == "parquet":
        docs.write.parquet(f"{tmp_path}/docs")
        docs = spark.read.parquet(f"{tmp_path}/docs")
    else:
        docs = docs.coalesce(1)
    groups = collections.defaultdict(list)
    for r in docs.collect():
        groups[r.text or ""].append(r.doc_id)
    left = exact_dedup.drop_exact_copies(docs, keep=keep)
    assert left.columns == docs.columns
    same_columns(left, docs)
    rows = left.collect()
    assert len(rows) == len(groups)
    for r in rows:
        known = [i for i in groups[r.text or ""] if i is not None]
        assert r.doc_id == ((min if keep == "min" else max)(known) if known else None)


def test_exact_scan_crosses_every_cut(spark):
    # few texts over many partitions: runs that begin, fill and end partitions
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise(F.lit(None)).alias("text")).repartition(5)
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == 900 and all(r.group_size == 300 and r.keep_id == r.doc_id % 3 and r.kept == (r.doc_id < 3) for r in got)
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_copies(docs, keep="max").collect()) == [897, 898, 899]


# clashing columns


def test_clashing_columns(spark, clashing):
    mixed = mixing.poisson_mix(clashing, None, seed=1)
    assert len(mixed.columns) == len(set(mixed.columns)) and same_columns(mixed, clashing, ("rate", "copy", "shuffle_key"))
    cleaned = line_rules.line_first_clean(clashing)
    assert set(cleaned.columns) == {*clashing.columns, "lost_percent"}
    assert len(same_columns(cleaned, clashing, ("cleaned",))) == clashing.count()
    marked = lm_scoring.mark_targets(clashing, spark.createDataFrame([(3,), (None,)], "doc_id long"))
    assert sorted(marked.columns) == sorted(clashing.columns) and [r.doc_id for r in marked.filter("is_target").collect()] == [3]
    same_columns(near_dedup.drop_near_copies(clashing), clashing)
    net = quality_cnn.initial()
    same_columns(quality_cnn.keep_quality(clashing, net, 0.0), clashing)
    assert quality_cnn.score_quality(clashing, net).columns == ["doc_id", "held_out", "score", "predicted"]
    pieces = clashing.select(F.length(F.coalesce("text", F.lit(""))).alias("n"), "doc_id", "sequence_id", F.lit(0).alias("_rank")).select(F.least(F.col("n") + 1, F.lit(99)).cast("long").alias("length"), "doc_id", "sequence_id", "_rank")
    placed = packing.place_pieces(pieces, 128, ("doc_id",))
    assert sorted(placed.columns) == ["_rank", "doc_id", "length", "offset", "sequence_id"] and placed.count() == pieces.count()


def test_numbering_without_broadcast(spark, monkeypatch):
    df = spark.range(500).select((F.col("id") % 7).alias("g"), "id")
    want = sorted(map(tuple, common.numbered(df, ["g"], ["id"], "at").collect()))
    monkeypatch.setattr(common, "MAX_BROADCAST_OFFSETS", 0)
    assert sorted(map(tuple, common.numbered(df, ["g"], ["id"], "at").collect())) == want
    assert all(at == i // 7 for g, i, at in want)


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(Conf)

    class Session:
        sparkContext, conf = Context, Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session)


# mixing


def test_poisson_cdf_of_high_rates(spark):
    rates = [0.0, 0.2, 5.0, 4000.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rates], "r double").select(mixing.poisson_cdf("r")).collect()]
    assert got[0] == [1.0]
    for rate, cdf in zip(rates[1:], got[1:]):
        total = 0.0
        for k, c in enumerate(cdf):
            total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            assert abs(c - total) < 1e-10
        assert abs(cdf[-1] - 1) < 1e-9


# language


@pytest.mark.parametrize("segment", [2, 3, 128])
def test_chains_are_not_cut(monkeypatch, segment):
    monkeypatch.setattr(language_crf, "SEGMENT_WORDS", segment)
    rng = np.random.default_rng(4)
    lengths = np.array([7, 1, 5, 8])
    emit, moves = rng.normal(size=(21, 2)), 2 * rng.normal(size=(2, 2))
    post, expected = language_crf.forward_backward(emit, lengths, moves, True)
    at, all_moves = 0, np.zeros((2, 2))
    for n in lengths:
        label, move, z = np.zeros((n, 2)), np.zeros((2, 2)), 0.0
        for y in itertools.product(range(2), repeat=int(n)):
            p = math.exp(sum(emit[at + k, s] for k, s in enumerate(y)) + sum(moves[i, j] for i, j in zip(y, y[1:])))
            z += p
            for k, s in enumerate(y):
                label[k, s] += p
            for i, j in zip(y, y[1:]):
                move[i, j] += p
        assert np.allclose(post[at : at + n], label / z)
        all_moves += move / z
        at += n
    assert np.allclose(expected, all_moves)


def test_a_long_line_is_one_chain():
    rng = np.random.default_rng(5)
    emit, moves = rng.normal(size=(1000, 3)), rng.normal(size=(3, 3))
    post, _ = language_crf.forward_backward(emit, np.array([1000]), moves)
    alpha, beta = [np.exp(emit[0])], [np.ones(3)]
    for t in range(1, 1000):
        a = (alpha[-1] @ np.exp(moves)) * np.exp(emit[t])
        alpha.append(a / a.sum())
        b = np.exp(moves) @ (np.exp(emit[1000 - t]) * beta[-1])
        beta.append(b / b.sum())
    want = np.array(alpha) * np.array(beta[::-1])
    assert np.allclose(post, want / want.sum(axis=1, keepdims=True))


def test_word_features_one_by_one():
    words = ["a", "der", "über", "x" * 9]
    buckets, owner = language_crf.word_features(words)
    one = lambda raw, tag: int(language_crf._bucket(np.array([int.from_bytes(raw, "little")], np.uint64), tag)[0])
    for k, w in enumerate(words):
        raw, want = b"^" + w.encode() + b"$", []
        for n, tag in ((3, 1 << 40), (4, 2 << 40)):
            want += [one(raw[i : i + n], tag) for i in range(len(raw) - n + 1)]
        for n in (1, 2, 3):
            if len(raw) >= n + 2:
                want += [one(raw[1 : 1 + n], (2 + n) << 40), one(raw[-1 - n : -1], (5 + n) << 40)]
        assert sorted(buckets[owner == k].tolist()) == sorted(want)


def test_language_edges(spark, clashing):
    rows = language_crf.training_rows(clashing)
    net = language_crf.fit([t for t, _ in rows] + ["krzt brzk strv"], [g for _, g in rows] + ["zz"], steps=5)
    got = language_crf.predict_language(clashing, net)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == clashing.count()
    assert all(0 <= r.score <= 1 and r.lang_pred in {*net.labels, "und"} for r in got.collect())
    assert language_crf.predict_language(clashing.limit(0), net).count() == 0
    assert language_crf.training_rows(clashing.limit(0)) == [] and language_crf.fit([], []).predict(["a b", None]) == [("und", 0.0)] * 2
    long = "krzt " * 30000
    assert net.predict([long])[0][0] == net.predict(["krzt krzt krzt"])[0][0]
    twice = spark.createDataFrame([(9, "bb aa", "de"), (9, "aa bb", "en"), (9, "x" * (1 << 17) + "y", "fr")], "doc_id long, text string, lang string")
    one = language_crf.training_rows(twice)
    assert len(one) == (zlib.crc32(b"9") % 3 != 1) and all(language_crf.training_rows(twice.repartition(k)) == one for k in (1, 3))


# quality


def small_net(monkeypatch, kind=np.float64):
    net = quality_cnn.initial(3)
    return quality_cnn.ByteCnn(*(x.astype(kind) for x in net.parameters()))


def test_convolution_position_by_position(monkeypatch):
    net = small_net(monkeypatch)
    for said in ("", "abc", text(1, 40), "é" * 70, text(2, 300)):
        raw = list((said or "").encode()) + [0] * (2 * quality_cnn.WIDTH)
        best = [-math.inf] * quality_cnn.FILTERS
        for a in range(0, max(1, len(said.encode())), quality_cnn.STRIDE):
            chunk = np.concatenate([net.embedding[b] for b in raw[a : a + quality_cnn.WIDTH]])
            best = [max(old, float(chunk @ net.filters[:, f])) for f, old in enumerate(best)]
        z = sum(math.tanh(b + c) * o for b, c, o in zip(best, net.bias, net.out)) + net.out_bias[0]
        assert net.scores([said])[0] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_segments_meet_without_a_seam(monkeypatch):
    net = small_net(monkeypatch)
    texts = [text(k, n) for k, n in enumerate((1, 40, 300, 2000))] + [None]
    whole = net.scores(texts)
    for size in (64, 256, 4096):
        monkeypatch.setattr(quality_cnn, "_SEGMENT", size)
        assert np.allclose(net.scores(texts), whole, atol=1e-12)


def test_gradient_by_finite_differences(monkeypatch):
    net = small_net(monkeypatch)
    texts = [quality_cnn.text_bytes(text(k, 20 + k)) for k in range(4)]
    y, w = np.array([1.0, 0, 1, 0]), np.array([0.2, 0.4, 0.3, 0.1])
    _, grads = net.gradients(texts, y, w)
    rng = np.random.default_rng(1)
    for x, g in zip(net.parameters(), grads):
        flat, wanted = x.reshape(-1), g.reshape(-1)
        some = np.argsort(-np.abs(wanted))[:5].tolist() + rng.integers(0, flat.size, 5).tolist()
        for k in some:
            old, sides = flat[k], []
            for h in (1e-6, -1e-6):
                flat[k] = old + h
                sides.append(net.gradients(texts, y, w)[0])
            flat[k] = old
            assert (sides[0] - sides[1]) / 2e-6 == pytest.approx(wanted[k], rel=1e-3, abs=1e-6)


def test_quality_training_rows(spark, clashing):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(3, None), (5, 1), (5, 0), (None, 1), (12345, 1)], "doc_id long, quality int")
    rows = quality_cnn.training_rows(clashing, labels)
    open_ = {r.text for r in clashing.filter("doc_id < 40").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    assert {t for t, _ in rows} == open_ and len(rows) == len(open_)
    assert all(quality_cnn.training_rows(clashing.repartition(k), labels) == rows for k in (1, 5))
    assert quality_cnn.training_rows(clashing.limit(0), labels) == [] and quality_cnn.score_quality(clashing.limit(0), quality_cnn.initial()).count() == 0


# line rules


def lost_words(said):
    """(words, words of failing lines) by the rules as README states them."""
    total = lost = 0
    for line in (said or "").split("\n"):
        words = re.findall(r"[^\x20\x09-\x0D]+", line)
        if not words:
            continue
        low = line.lower()
        found = False
        for phrase in line_rules.BOILERPLATE:
            for m in re.finditer(re.escape(phrase), low):
                before, after = low[: m.start()][-1:], low[m.end() :][:1]
                found |= not before.isalpha() and not after.isalpha()
        short = len(words) < 8 and words[-1][-1] not in ".!?…:;\"'”»)]}"
        signs = sum(line.count(c) for c in "#*$%&|<>") > len(words)
        menu = 5 * sum(w in list("|»«•·›>/→*-") for w in words) >= len(words)
        shout = 2 * sum(w.endswith(("!!", "!!.")) for w in words) > len(words)
        total += len(words)
        lost += len(words) * (short or signs or menu or shout or (found and len(words) < 25))
    return total, lost


def test_line_verdicts_from_the_rules(spark, awkward):
    lines = [
        "This catalog in the library holds maps.", "They design up to nine boats.", "Please log in to see the rest of it.", "Sign up!", "We blog in the morning and read moreover a lot.", "Éclick here is not the phrase that we mean.",
        "A | B | C | D | E of the site map of this place.", "Home", "x", "It ends here.", "#### $$$$ a b c.", "NO!! YES!! go.", "", "  ", "All rights reserved. " + text(3, 40), text(5, 9),
    ]
    rng = random.Random(9)
    rows = [(k, "\n".join(rng.choices(lines, k=rng.randint(1, 12)) + [text(k, 30)] * rng.randint(0, 3))) for k in range(150)] + [(r.doc_id, r.text) for r in awkward.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = collections.Counter()
    for k, said in rows:
        total, lost = lost_words(said)
        want[(k, total, round(100.0 * lost / max(total, 1), 9))] += 1
    cleaned = line_rules.line_first_clean(df).withColumn("n", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    assert collections.Counter((r.doc_id, r.n, round(r.lost_percent, 9)) for r in cleaned.collect()) == want
    kept = {(r.doc_id, r.n_words): r.kept for r in line_rules.line_first_report(df).filter("not base_failed").collect()}
    assert kept and all(kept[k, n] == (lost <= 30) for k, n, lost in want if (k, n) in kept)
    first = line_rules.line_first_clean(spark.createDataFrame([(1, "\n".join(lines[:4]))], "doc_id long, text string")).first()
    assert first.cleaned == "\n".join(lines[:2])
    assert line_rules.line_first_report(df.limit(0)).count() == 0 and line_rules.line_first_clean(df.limit(0)).count() == 0


# near dedup


def test_components_of_hubs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HUBS", 8)
    rng = random.Random(3)
    pairs = [(0, k) for k in range(1, 400)] + [(5000, k) for k in range(4000, 4300)] + [(399, 4000)] + [(7000 + k, 7001 + k) for k in range(20)]
    pairs += [(rng.randint(8000, 8200), rng.randint(8000, 8200)) for _ in range(150)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: find(k) for k in list(root)}


@pytest.mark.parametrize("block", [2, 3, 16])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, block):
    # families that share a passage, so that their buckets hold many components
    monkeypatch.setattr(near_dedup, "HOT_BUCKET", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "LONG_SET", {2: 20_000, 3: 80, 16: 0}[block])
    rng, rows = random.Random(block), []
    passage = [f"p{k}" for k in range(60)]
    for f in range(12):
        own = [f"f{f}x{k}" for k in range(rng.randint(12, 30))]
        for _ in range(4):
            words = passage + [w if rng.random() > 0.06 else f"r{rng.randint(0, 10**6)}" for w in own]
            rows.append((len(rows), " ".join(words)))
    sets = [{tuple(t.split()[k : k + 2]) for k in range(len(t.split()) - 1)} for _, t in rows]
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and root[i] != root[j]:
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words=2).collect()
    assert len(set(root)) > 1 and {r.doc_id: r.component_id for r in got} == dict(enumerate(root))
