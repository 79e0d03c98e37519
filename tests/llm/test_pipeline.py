import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline as C
from cdrloom.llm import bpe, quality, toxicity
from cdrloom.llm.suffix_dedup import whole_points, without
from test_jaccard import brute as groups_of

SF = "/root/testdata/sf0.001"


def repeated_spans(texts, length):
    """Byte spans of each text that strings occurring twice cover, by counting all strings."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[k:k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k + 1:k + length + 1] = True
        edges = np.flatnonzero(np.diff(gone.astype(int)))
        out.append(edges.reshape(-1, 2))
    return data, out


def test_each_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(C.STAGES)
    assert [name for name, _ in C.STAGES] == ["quality rules", "toxicity", "n-gram Jaccard join", "suffix-array dedup", "packing"]
    rows = docs.collect()

    def step(name, frame):
        out = stages[name](spark, frame, SF)
        if name != "packing":
            assert out.columns == docs.columns
        return spark.createDataFrame(out.collect(), out.schema)

    good = step("quality rules", docs)
    config = quality.QualityConfig()
    verdict = quality.judge(pa.array([r.text for r in rows], pa.string()), quality.fit(docs, labels), config)["kept"]
    rows = [r for r, keep in zip(rows, verdict) if keep]
    assert Counter(good.collect()) == Counter(rows)

    mild = step("toxicity", good)
    config = toxicity.ToxicityConfig()
    scores = toxicity.probabilities(pa.array([r.text for r in rows], pa.string()), toxicity.fit(good, labels), config)
    rows = [r for r, s in zip(rows, scores) if s < config.threshold]
    assert Counter(mild.collect()) == Counter(rows)

    single = step("n-gram Jaccard join", mild)
    members = defaultdict(list)
    for r, (_, group, _) in zip(rows, groups_of([(r.doc_id, r.text) for r in rows])):
        members[group].append(r.doc_id)
    assert sorted(r.doc_id for r in single.collect()) == sorted(min(m) for m in members.values())
    rows = single.collect()

    cut = step("suffix-array dedup", single)
    data, spans = repeated_spans([r.text for r in rows], C.PASSAGE.length)
    kept = [without(b, whole_points(np.frombuffer(b, np.uint8), s)).decode() if len(s) else b.decode() for b, s in zip(data, spans)]
    assert Counter((r.doc_id, r.text, r.n_chars) for r in cut.collect()) == Counter((r.doc_id, t, len(t)) for r, t in zip(rows, kept))

    library = Tokenizer.from_file(bpe.default_path())
    found = defaultdict(list)
    for r in step("packing", cut).collect():
        found[r.doc_id].append((r.start, r.length, r.ids_crc32))
    for r, text in zip(rows, kept):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(found[r.doc_id])
        assert [s for s, _, _ in pieces] == [0, *np.cumsum([n for _, n, _ in pieces])[:-1]] and sum(n for _, n, _ in pieces) == len(ids)
        assert all(c == zlib.crc32(ids[s:s + n].tobytes()) for s, n, c in pieces)


def test_run_returns_packed_pieces(spark):
    out = C.run(spark, SF)
    assert {"doc_id", "sequence_id", "length"} <= set(out.columns) and out.count() > 0


def test_passages_of_more_than_fifty_words_go(spark):
    words = [f"w{k:03d}" for k in range(51)]  # 254 bytes
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    rows = [(k, f"start{k} " + " ".join(words) + f" end{k}", "en", "s", 1) for k in range(3)]
    cut = dict(C.STAGES)["suffix-array dedup"](spark, spark.createDataFrame(rows, docs.schema), SF).collect()
    assert sorted((r.doc_id, r.text) for r in cut) == [(k, f"start{k}{k}") for k in range(3)]
    assert all(r.n_chars == len(r.text) for r in cut)
