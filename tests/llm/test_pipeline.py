"""The corpus pipeline's stages against brute force, each on what its predecessor kept, and the whole against the stages."""

import collections
import hashlib
import math
import os
import zlib

import numpy as np
import pytest

import corpus_pipeline
from roomlake.llm import quality_cnn, word_bpe
from roomlake.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before the first stage and after each, every output written and read again."""
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        out.append(docs.collect())
    return out


def same(got, want):
    assert collections.Counter(map(tuple, got)) == collections.Counter(tuple(r[c] for c in COLUMNS) for r in want)


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "mixing sources to target weights", "packing"]


def test_quality_stage(spark, stages):
    before, after = stages[0], stages[1]
    label = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        if r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            label[r.doc_id] = max(label.get(r.doc_id, 0), r.quality)
    texts = {r.doc_id: r.text for r in before}
    rows = [(texts[k], y) for k, y in sorted(label.items()) if k in texts and len((texts[k] or "").encode()) <= quality_cnn.MAX_TRAINING_BYTES]
    net = quality_cnn.fit([t for t, _ in rows], [y for _, y in rows])
    same(after, [r for r in before if net.scores([r.text])[0] >= 0.5])
    assert len(after) < len(before)


def test_exact_stage(stages):
    least = {}
    for r in stages[1]:
        least[r.text or ""] = min(r.doc_id, least.get(r.text or "", r.doc_id))
    same(stages[2], [r for r in stages[1] if least[r.text or ""] == r.doc_id])
    assert len(stages[2]) < len(stages[1])


def test_near_stage(stages):
    def shingles(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in words.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    rows = sorted(stages[2], key=lambda r: r.doc_id)
    sets = [shingles(r.text) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and root[i] != root[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    same(stages[3], [r for k, r in enumerate(rows) if root[k] == k])
    assert len(stages[3]) < len(stages[2])


def test_mixing_stage(stages):
    size = collections.Counter()
    for r in stages[3]:
        size[r.source] += len(r.text or "") + 1
    whole, flat = sum(size.values()), sum(math.sqrt(n) for n in size.values())
    want = []
    for r in stages[3]:
        rate = whole * math.sqrt(size[r.source]) / flat / size[r.source]
        u = (int(hashlib.md5(f"17:{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        n, total = 0, math.exp(-rate)
        while total <= u:
            n += 1
            total += math.exp(n * math.log(rate) - rate - math.lgamma(n + 1))
        want += [r] * n
    same(stages[4], want)


def test_packing_stage(stages):
    bpe, spans, covered = word_bpe.word_bpe(tokenizer_path()), collections.defaultdict(list), collections.defaultdict(list)
    ids = {r.doc_id: np.append(bpe.encode([r.text or ""])[0], np.uint32(1)).astype("<u4") for r in {r.doc_id: r for r in stages[4]}.values()}
    for r in stages[5]:
        spans[r.sequence_id].append((r.offset, r.length))
        covered[r.doc_id].append((r.start, r.length))
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for parts in spans.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    copies = collections.Counter(r.doc_id for r in stages[4])
    assert set(covered) == set(copies)
    for doc, parts in covered.items():
        want = [(s, min(2048, len(ids[doc]) - s)) for s in range(0, len(ids[doc]), 2048)] * copies[doc]
        assert sorted(parts) == sorted(want)


def test_run_equals_the_stages(spark, stages, tmp_path):
    show = lambda rows: collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    assert show(corpus_pipeline.run(spark, SF).collect()) == show(stages[5])


def test_a_failed_run_goes_on_where_it_stopped(spark, stages, tmp_path, monkeypatch):
    calls, kept = [], list(corpus_pipeline.STAGES)

    def told(name, stage, fail=False):
        def run(*args):
            calls.append(name)
            if fail:
                raise RuntimeError("lost")
            return stage(*args)

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [told(n, s, k == 2) for k, (n, s) in enumerate(kept)])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, SF, str(tmp_path))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [told(n, s) for n, s in kept])
    rows = corpus_pipeline.run(spark, SF, str(tmp_path)).collect()
    names = [n for n, _ in kept]
    assert calls == names[:3] + names[2:] and len(rows) == len(stages[5]) and os.path.exists(f"{tmp_path}/3/_SUCCESS")


def test_empty_documents(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
