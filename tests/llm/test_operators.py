"""Operators against brute force, round trips and held-out accuracy, on small tables with awkward rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomlake.llm import chat, exact_dedup, language_crf, line_rules, lm_scoring, mixing, near_dedup, packing, quality_cnn, sharding, word_bpe
from roomlake.llm.queries import op3_lm_cross_entropy_difference, op5_mix_poisson, tokenizer_path

from .conftest import text

TOKENIZER = tokenizer_path()


# 1 packing


def test_word_bpe_equals_the_library():
    bpe = word_bpe.WordBpe(TOKENIZER)
    texts = [text(1, 50), "it's we'll DON'T 'st ÀÉ ΣΑΣ İ x²y 12.5% a_b\tc d\x85e\xa0f 你好 日本語 é", "", "  ", "</w> a</w>b", "x <|endoftext|> y", "a\x1cb", "q" * 5000, "!?." * 300]
    ids, sizes = bpe.encode(texts)
    ends = np.cumsum(sizes)
    for t, n, e in zip(texts, sizes, ends):
        assert ids[e - n : e].tolist() == bpe.library.encode(t, add_special_tokens=False).ids


def test_fill_window_is_best():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(5)}
        room = rng.randint(1, 60)
        got = packing.fill_window(counts, room)
        sums = {0}
        for n, c in counts.items():
            sums = {s + k * n for s in sums for k in range(c + 1)}
        assert sum(n * c for n, c in got.items()) == max(s for s in sums if s <= room)
        assert all(c <= counts[n] for n, c in got.items())


def test_packing_places_every_id_once(spark, awkward):
    pieces = packing.cut_documents(awkward, TOKENIZER, capacity=256, with_ids=True)
    rows = packing.place_pieces(pieces, 256).collect()
    bpe = word_bpe.word_bpe(TOKENIZER)
    spans = collections.defaultdict(list)
    for r in rows:
        spans[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for parts in spans.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    want = collections.Counter((r.doc_id, len(bpe.encode([r.text or ""])[0]) + 1) for r in awkward.collect())
    got = collections.Counter()
    for r in rows:
        got[(r.doc_id, r.doc_tokens)] += r.length
    assert got == {k: n * k[1] for k, n in want.items()}
    total = sum(r.length for r in rows)
    assert len(spans) * 256 - total < 3 * 256
    full = packing.build_sequences(packing.place_pieces(pieces, 256), 256).collect()
    assert all(len(r.input_ids) == 256 or math.log2(r.tokens).is_integer() for r in full)


def test_packing_nothing(spark, awkward):
    assert packing.pack_documents(awkward.limit(0), TOKENIZER).count() == 0


# 2 sharding


def test_shards_move_only_into_the_new_one(awkward):
    a = sharding.shard_documents(awkward, [1.0] * 7).collect()
    b = {(r.doc_id, r.text_crc32): r.shard for r in sharding.shard_documents(awkward, [1.0] * 8).collect()}
    assert len(a) == awkward.count()
    for r in a:
        assert r.grown_shard == b[(r.doc_id, r.text_crc32)] and r.grown_shard in (r.shard, 7)
    slots = collections.defaultdict(list)
    for r in a:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shard_weights(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = collections.Counter(r.shard for r in sharding.shard_documents(df, [1.0, 3.0, 0.0]).collect())
    assert abs(n[1] / 4000 - 0.75) < 0.03 and n[2] == 0
    assert sharding.shard_documents(df.limit(0), [1.0]).count() == 0


# 3 LM scoring


def test_lm_scores_equal_counts(spark, awkward):
    docs = awkward.withColumn("is_target", F.when(F.col("doc_id") < 20, True))
    rows = docs.select("doc_id", "text", "is_target").collect()
    models = lm_scoring.fit(docs)
    single, pair = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    for r in rows:
        m, before = (0 if r.is_target else 1), "<s>"
        for w in (r.text or "").split():
            single[m][w] += 1
            pair[m][(before, w)] += 1
            before = w
        single[m]["<s>"] += bool((r.text or "").split())
    words = {w for c in single for w in c if w != "<s>"}
    v = len(words) + 2
    tokens = [sum(n for w, n in c.items() if w != "<s>") for c in single]
    scale = [1.0, tokens[0] / tokens[1]]

    def loss(m, t):
        before, total = "<s>", 0.0
        for w in t:
            alone = (single[m][w] * scale[m] + 1) / (tokens[m] * scale[m] + v)
            total -= math.log((pair[m][(before, w)] * scale[m] + lm_scoring.SMOOTHING * alone) / (single[m][before] * scale[m] + lm_scoring.SMOOTHING))
            before = w
        return total / max(len(t), 1)

    want = sorted((len(t), round(loss(0, t), 6), round(loss(1, t), 6)) for t in ((r.text or "").split() for r in rows))
    got = lm_scoring.cross_entropy_difference(docs, models).collect()
    assert sorted((r.n_tokens, round(r.target_loss, 6), round(r.background_loss, 6)) for r in got) == want
    assert np.mean([r.score for r in got if r.doc_id is not None and r.doc_id < 20]) < 0


def test_lm_keeps_the_most_frequent_pairs_only(spark, awkward):
    docs = awkward.withColumn("is_target", F.lit(True))
    models = lm_scoring.fit(docs, vocabulary=30, max_bigrams=50)
    assert len(models.words) == 30 and 0 < len(models.codes) <= 50
    empty = lm_scoring.fit(docs.limit(0))
    assert lm_scoring.cross_entropy_difference(docs.limit(0), empty).count() == 0


def test_lm_corpus_scores_keep_every_word_and_pair(spark, awkward, monkeypatch):
    docs = awkward.withColumn("is_target", F.when(F.col("doc_id") < 20, True))
    show = lambda df: sorted(str((r.doc_id, r.n_tokens, round(r.target_loss, 6), round(r.background_loss, 6), round(r.score, 6))) for r in df.collect())
    want = show(lm_scoring.cross_entropy_difference(docs, lm_scoring.fit(docs)))
    monkeypatch.setattr(lm_scoring, "VOCABULARY", 5)
    monkeypatch.setattr(lm_scoring, "MAX_BIGRAMS", 5)
    assert show(lm_scoring.corpus_cross_entropy_difference(docs, leave_one_out=False)) == want
    # chunks of a document or two, many parts, a cache that is emptied
    monkeypatch.setattr(lm_scoring, "CHUNK_TOKENS", 50)
    monkeypatch.setattr(lm_scoring, "PART_TOKENS", 1000)
    monkeypatch.setattr(lm_scoring, "_HELD_WORDS", 20)
    monkeypatch.setattr(lm_scoring, "_CHUNK_CHARS", 100)
    assert show(lm_scoring.corpus_cross_entropy_difference(docs, leave_one_out=False)) == want
    assert lm_scoring.corpus_cross_entropy_difference(docs.limit(0)).count() == 0


def test_lm_query_counts_more_pairs_than_a_bounded_model(spark, tmp_path):
    words = [f"w{k}" for k in range(3000)]
    rng = random.Random(5)
    texts = [rng.choices(words, k=18000) for _ in range(70)]
    spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1), (2, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert len({p for t in texts for p in zip(t, t[1:])}) > lm_scoring.MAX_BIGRAMS
    got = {r.doc_id: r.target_loss for r in op3_lm_cross_entropy_difference(spark, str(tmp_path)).collect()}
    # each target document is left out of its own model
    for k, known in ((0, [2]), (2, [0]), (1, [0, 2])):
        single, pair = collections.Counter(w for d in known for w in texts[d]), collections.Counter(p for d in known for p in zip(["", *texts[d]], texts[d]))
        total, n = 0.0, 18000 * len(known)
        for before, w in zip(["", *texts[k]], texts[k]):
            alone = (single[w] + 1) / (n + len(words) + 2)
            total -= math.log((pair[(before, w)] + lm_scoring.SMOOTHING * alone) / ((single[before] if before else len(known)) + lm_scoring.SMOOTHING))
        assert abs(got[k] - total / 18000) < 1e-6


def test_lm_leaves_each_document_out(spark, awkward, monkeypatch):
    docs = awkward.withColumn("is_target", F.when(F.col("doc_id") < 20, True))
    rows = [(r.doc_id, bool(r.is_target), (r.text or "").split()) for r in docs.collect()]
    words = len({w for _, _, t in rows for w in t})
    counts = []
    for _, _, t in rows:
        counts.append((collections.Counter(t) + collections.Counter({"": 1} if t else {}), collections.Counter(zip(["", *t], t))))
    want = collections.Counter()
    for k, (key, target, t) in enumerate(rows):
        single, pair, tokens = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()], [0, 0]
        for j, (_, other, own) in enumerate(rows):
            if j != k:
                m = 0 if other else 1
                single[m] += counts[j][0]
                pair[m] += counts[j][1]
                tokens[m] += len(own)
        loss = []
        for m in range(2):
            scale, total = max(tokens[0], 1) / max(tokens[m], 1), 0.0
            for before, w in zip(["", *t], t):
                alone = (single[m][w] * scale + 1) / (tokens[m] * scale + words + 2)
                total -= math.log((pair[m][(before, w)] * scale + lm_scoring.SMOOTHING * alone) / (single[m][before] * scale + lm_scoring.SMOOTHING))
            loss.append(total / max(len(t), 1))
        want[(key, len(t), round(loss[0], 6), round(loss[1], 6), round(loss[0] - loss[1], 6))] += 1
    show = lambda df: collections.Counter((r.doc_id, r.n_tokens, round(r.target_loss, 6), round(r.background_loss, 6), round(r.score, 6)) for r in df.collect())
    assert show(lm_scoring.corpus_cross_entropy_difference(docs)) == want
    monkeypatch.setattr(lm_scoring, "CHUNK_TOKENS", 50)
    monkeypatch.setattr(lm_scoring, "PART_TOKENS", 1000)
    assert show(lm_scoring.corpus_cross_entropy_difference(docs)) == want


# 4 language ID


def languages(n):
    rng = random.Random(2)
    pools = {"aa": ["kala", "mola", "sina", "tolo", "pona"], "bb": ["krzt", "brzk", "strv", "plzt", "vrch"]}
    out = []
    for k in range(n):
        lang = "aa" if k % 2 else "bb"
        out.append((" ".join("".join(rng.choices(pools[lang], k=rng.randint(1, 2))) for _ in range(20)), lang))
    return out


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    emit, moves = rng.normal(size=(7, 2)), rng.normal(size=(2, 2))
    post, _ = language_crf.forward_backward(emit, np.array([4, 3]), moves)
    for a, b in ((0, 4), (4, 7)):
        total = np.zeros((b - a, 2))
        for code in range(2 ** (b - a)):
            y = [code >> k & 1 for k in range(b - a)]
            p = math.exp(sum(emit[a + k, s] for k, s in enumerate(y)) + sum(moves[i, j] for i, j in zip(y, y[1:])))
            for k, s in enumerate(y):
                total[k, s] += p
        assert np.allclose(post[a:b], total / total.sum(1, keepdims=True))


def test_language_held_out_and_code_switched(spark):
    rows = languages(120)
    net = language_crf.fit([t for t, _ in rows[:80]], [g for _, g in rows[:80]], steps=40)
    assert [p for p, _ in net.predict([t for t, _ in rows[80:]])] == [g for _, g in rows[80:]]
    mixed = rows[80][0] + "\n" + rows[81][0]
    assert 0.4 < net.predict([mixed])[0][1] < 0.6
    df = spark.createDataFrame([(1, rows[80][0]), (2, None), (3, "12 34 !"), (4, ""), (None, rows[81][0])], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_crf.predict_language(df, net).collect()}
    assert got[2] == got[3] == got[4] == ("und", 0.0) and got[1][0] == rows[80][1] and got[None][0] == rows[81][1]


def test_language_learns_outside_the_fold(awkward):
    ids = {t for t, _ in language_crf.training_rows(awkward)}
    held = {r.text for r in awkward.collect() if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    open_ = {r.text for r in awkward.collect() if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    assert ids and ids <= open_ and not ids & (held - open_)


# 5 mixing


def test_poisson_counts(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.lit("k").alias("copy_of"))
    rows = mixing.poisson_mix(df, {"a": 0.5, "b": 0.5}, seed=3).collect()
    assert rows == mixing.poisson_mix(df, {"a": 0.5, "b": 0.5}, seed=3).collect()
    n = collections.Counter(r.source for r in rows)
    assert abs(n["a"] - 1500) < 120 and abs(n["b"] - 1500) < 120
    one = collections.Counter(r.doc_id for r in rows if r.source == "a")
    counts = collections.Counter(one[k] for k in range(0, 3000, 3))
    for k in range(4):
        assert abs(counts[k] / 1000 - math.exp(-1.5) * 1.5**k / math.factorial(k)) < 0.05
    keys = [r.shuffle_key for r in rows]
    assert keys == sorted(keys)


def test_mixing_awkward_rows(awkward):
    rows = mixing.poisson_mix(awkward, None, seed=1).collect()
    assert {"doc_id", "kept", "_row", "copy"} <= set(rows[0].asDict())
    assert mixing.poisson_mix(awkward, {}, seed=1).count() == 0
    assert mixing.poisson_mix(awkward.limit(0), None).count() == 0


def test_mixing_without_broadcast(awkward, monkeypatch):
    small = sorted(str((r.doc_id, r.copy, r.source)) for r in mixing.poisson_mix(awkward).collect())
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    assert sorted(str((r.doc_id, r.copy, r.source)) for r in mixing.poisson_mix(awkward).collect()) == small


def test_mix_query_shuffles_the_texts(spark):
    plan = op5_mix_poisson(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "RepartitionByExpression":
        plan = plan.children().apply(0)
    assert {"doc_id", "text", "shuffle_key"} <= {plan.output().apply(k).name() for k in range(plan.output().size())}


# 6 near-dedup


def shingles(t, n):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(rows, n):
    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def family(seed, base, n, edits):
    rng = random.Random(seed)
    words = text(base, 80).split()
    out = []
    for _ in range(n):
        w = list(words)
        for k in rng.sample(range(len(w)), rng.randint(0, edits)):
            w[k] = f"w{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("hot", [64, 4])
def test_near_groups_equal_brute_force(spark, awkward, monkeypatch, hot):
    monkeypatch.setattr(near_dedup, "HOT_BUCKET", hot)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    extra = family(1, 900, 40, 9) + family(2, 901, 25, 4) + [text(2000 + k, 60) for k in range(40)] + ["Of the", "of THE", "of", "OF "]
    rows = [(r.doc_id, r.text) for r in awkward.collect()] + [(1000 + k, t) for k, t in enumerate(extra)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_dedup.near_groups(df, words=2).collect()
    want = brute_components(rows, 2)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.component_id == r.doc_id) for r in got if r.doc_id is not None)
    sizes = {r.doc_id: r.n_shingles for r in got}
    assert all(sizes[i] in {len(shingles(t, 2)) for j, t in rows if j == i} for i in sizes)


def test_near_links_beyond_the_radius(spark):
    # at exactly 0.8, in a common bucket, with more than RADIUS slots apart
    shingler, rows = near_dedup.Shingler(1), []
    for k in range(20000):
        a, b = (" ".join(f"w{k}x{i}" for i in own) for own in (range(9), range(1, 10)))
        p, q = (near_dedup.signature(shingler(t)) for t in (a, b))
        if (p != q).sum() > near_dedup.RADIUS and (near_dedup.bucket_keys(p) == near_dedup.bucket_keys(q)).any():
            rows += [(2 * k, a), (2 * k + 1, b)]
            break
    assert rows
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), words=1, percent=80).collect()
    assert {r.component_id for r in got} == {rows[0][0]}


def test_near_drop_and_empty(spark, awkward):
    kept = near_dedup.drop_near_copies(awkward)
    assert set(kept.columns) == set(awkward.columns)
    ids = [r.doc_id for r in kept.collect()]
    assert 5 in ids and not {200, 201, 202, 203, 204} & set(ids) and None in ids and 100 in ids and 101 in ids
    assert near_dedup.near_groups(awkward.limit(0)).count() == 0


def test_pigeonhole():
    parts = near_dedup.chunks()
    assert sum(e + 1 for _, e in parts) > near_dedup.RADIUS and sorted(k for s, _ in parts for k in s) == list(range(near_dedup.SLOTS))
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, near_dedup.SLOTS).astype(np.uint16)
        b = a.copy()
        b[rng.choice(near_dedup.SLOTS, near_dedup.RADIUS, replace=False)] ^= 1
        assert len(np.intersect1d(near_dedup.bucket_keys(a), near_dedup.bucket_keys(b)))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 200), (200, 300)], "a long, b long")
    got = {r.node: r.root for r in near_dedup.components(links).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 200: 100, 300: 100}


# 7 exact dedup


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups_equal_brute_force(spark, awkward, keep):
    copies = spark.createDataFrame([(5000 + k, "the same text " * 20) for k in range(700)], "doc_id long, text string")
    docs = awkward.select("doc_id", "text").unionAll(copies).repartition(7)
    rows = docs.collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    got = exact_dedup.exact_groups(docs, keep=keep).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = collections.Counter()
    for r in got:
        ids = by_sha[r.text_sha256]
        best = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == ((min if keep == "min" else max)(best) if best else None)
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}


def test_exact_drop_keeps_columns(awkward):
    left = exact_dedup.drop_exact_copies(awkward.drop("_row"))
    assert left.columns == awkward.drop("_row").columns
    assert left.count() == len({r.text or "" for r in awkward.collect()})
    assert exact_dedup.exact_groups(awkward.limit(0)).count() == 0


# 8 quality


def junk(seed):
    rng = random.Random(seed)
    return text(seed, 20) + "\n" + " ".join(w.upper() + "!!" for w in text(seed + 1, 30).split()) if rng.random() < 0.5 else " ".join([text(seed, 1).strip(".")] * 40)


def test_quality_held_out(spark, awkward):
    good, bad = [text(k, 60) for k in range(150)], [junk(k) for k in range(150)]
    net = quality_cnn.fit(good[:110] + bad[:110], [1] * 110 + [0] * 110)
    p = net.scores(good[110:] + bad[110:])
    assert (p[:40] >= 0.5).mean() > 0.9 and (p[40:] < 0.5).mean() > 0.9
    got = quality_cnn.score_quality(awkward, net).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert set(quality_cnn.keep_quality(awkward, net).columns) == set(awkward.columns)


def test_quality_reads_all_of_a_long_text(monkeypatch):
    net = quality_cnn.fit([text(k, 60) for k in range(60)] + [junk(k) for k in range(60)], [1] * 60 + [0] * 60)
    long = text(1, 3000) + junk(3) + text(2, 3000)
    whole = net.scores([long, None, ""])
    monkeypatch.setattr(quality_cnn, "_SEGMENT", 1 << 10)
    assert np.allclose(whole, net.scores([long, None, ""]), atol=1e-6)


def test_quality_one_class_or_none():
    assert quality_cnn.fit(["a", "b"], [1, 1]).scores(["x"])[0] > 0.5
    assert quality_cnn.fit([], []).scores(["x"])[0] == pytest.approx(0.5)


# 9 chat


def test_chat_round_trip(spark):
    odd = ["\\### Assistant: </turn> ok", "#", "<", "\\h", "", "a\nb ### c </turn>\n", None]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t, 9) for k, t in enumerate(odd)]
    rows += [(2, 0, "user", "hi", 1), (3, 0, "assistant", "x", 1), (None, 0, "system", "s", 1), (None, None, None, None, None), (4, 0, "a:b", "t", 1), (4, 0, "a:b", "t", 1), (4, 1, "assistant", "long " * 5000, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example long")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    by = collections.defaultdict(list)
    for c, t, role, said, _ in rows:
        by[c].append((-1 if t is None else t, role or "", said or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_examples_are_prefixes():
    made = chat.expand([("system", "s"), ("user", "u"), ("assistant", "a1"), ("user", "u2"), ("assistant", "a2"), ("user", "end")])
    assert [w for _, _, w in made] == [False, False, True] and made[1][0].startswith(made[0][0])
    assert [t[a:b] for t, s, _ in made for a, b in s] == ["a1", "a2"]


# 10 line rules


def test_line_rules_equal_brute_force(spark, awkward):
    lines = ["Home | About | Contact | Log", "All rights reserved.", "BUY!! NOW!! CHEAP!! YES!!", "a *** b &&& c %%% d ###", text(4, 60), text(4, 60), "short one", ""]
    rows = [(r.doc_id, r.text) for r in awkward.collect()] + [(300, "\n".join(lines)), (301, "\n".join([text(k, 30) for k in range(4)] + ["menu"])), (302, "word " * 200), (303, "x y")]
    got = line_rules.line_first_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()

    def count(t):
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" ") if x]
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {p for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        full = [x for x in (t or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(full) - len(set(full)), len(hit)

    assert sorted(count(t) for _, t in rows) == sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    kept = {r.doc_id: (r.base_failed, r.kept) for r in got}
    assert kept[301] == (False, True) and kept[302] == (True, False) and kept[303] == (True, False)
    cut = {r.doc_id: r.cleaned for r in line_rules.line_first_clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert cut[300] == "\n".join([text(4, 60), text(4, 60), ""]) and "menu" not in cut[301]
