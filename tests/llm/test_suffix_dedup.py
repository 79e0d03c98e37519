import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cdrloom.llm import queries, suffix_dedup as sd


def brute(rows, length):
    """Rows of (id, bytes, removed, spans, digest) by comparing all strings."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k:k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [400, 250])
def test_equals_brute_force(make_docs, corpus, length):
    found = sd.removals(make_docs(corpus), sd.DedupConfig(length)).collect()
    assert sorted(map(tuple, found), key=str) == brute(corpus, length)


def test_passages_below_the_length_are_found_beside_it(make_docs, corpus):
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage = prose(51)  # 305 bytes, between the two lengths
    rows = corpus + [(100, prose(80) + " " + passage + " " + prose(70)), (101, prose(60) + " " + passage), (102, prose(150))]
    out = sd.removals(make_docs(rows), passages=sd.PASSAGE)
    found = sorted(map(tuple, out.collect()), key=str)
    assert out.columns[5:] == ["passage_removed", "passage_spans", "passage_kept_sha256"]
    assert sorted((r[:5] for r in found), key=str) == brute(rows, 400)
    assert sorted((r[:2] + r[5:] for r in found), key=str) == brute(rows, 250)
    by_id = {r[0]: r for r in found}
    assert [by_id[k][2] for k in (100, 101, 102)] == [0, 0, 0] and [by_id[k][6] for k in (100, 101, 102)] == [1, 1, 0]
    with pytest.raises(ValueError):
        sd.removals(make_docs(rows), passages=sd.DedupConfig(401))


def test_query_returns_passages(spark, make_docs, tmp_path):
    rng = random.Random(3)
    passage, *other = (" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)) for n in (51, 90, 70, 120))
    make_docs([(1, other[0] + " " + passage), (2, passage + " " + other[1]), (3, other[2])]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.QUERIES["op1_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert [rows[k].n_removed for k in (1, 2, 3)] == [0, 0, 0]
    assert [rows[k].passage_removed >= len(passage) for k in (1, 2, 3)] == [True, True, False]


def test_cover_is_perfect():
    differences = Counter((a - b) % sd.PERIOD for a in sd.COVER for b in sd.COVER if a != b)
    assert len(differences) == sd.PERIOD - 1 and set(differences.values()) == {1}


@pytest.mark.parametrize("period", sorted(sd.COVERS))
def test_every_cover_is_perfect(period):
    differences = Counter((a - b) % period for a in sd.COVERS[period] for b in sd.COVERS[period] if a != b)
    assert len(differences) == period - 1 and set(differences.values()) == {1}


@pytest.mark.parametrize("width", [8, sd.SAMPLE_BYTES])
def test_a_range_is_compared_in_little_memory(width):
    rng, dealer, batches = np.random.default_rng(7), sd.Dealer(1, width, 2), []
    common = rng.integers(0, 1 << 8 * width - 1, 500, np.uint64) * np.uint64(2)
    for k in range(8):
        names = rng.integers(0, 1 << 8 * width - 1, 120_000, np.uint64) * np.uint64(2)
        names[::2400] = rng.choice(common, 50, replace=False)
        dealer.add([bytes([k, 0])], names, np.zeros(len(names), np.int64), np.arange(len(names)))
        batches += [(names, b) for b in dealer.deal(share=False)]
    tracemalloc.start()
    out = list(sd._repeated(1, width, 2)(b for _, b in batches))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * 8 * 120_000
    rows = pa.Table.from_batches(out).to_pylist()
    found = set()
    for row in rows:
        text = np.repeat(np.frombuffer(row["keys"], np.uint8)[::2], np.frombuffer(row["counts"], np.uint32)).tolist()
        runs = np.frombuffer(row["runs"], np.int32).reshape(-1, 2).tolist()
        found.update((t, p) for t, (first, last) in zip(text, runs) for p in range(first, last + 1))
    name, n = np.unique(np.concatenate([names for names, _ in batches]), return_counts=True)
    assert found == {(k, p) for k, (names, _) in enumerate(batches) for p in np.flatnonzero(np.isin(names, name[n > 1])).tolist()} and found


def test_no_batch_of_texts_is_copied_whole():
    texts = [f"{k} " * 2000 for k in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array([b"%016d" % (k // 2 * 2) for k in range(2000)], pa.binary()), pa.array(texts)], ["key", "text"])
    before, most, found = pa.total_allocated_bytes(), 0, 0
    for out in sd._pack_texts(iter([batch])):
        most, found = max(most, pa.total_allocated_bytes() - before), found + out.num_rows
    assert found == 1000 and most < batch.nbytes / 4


def test_empty_table(make_docs):
    docs = make_docs([])
    assert sd.removals(docs).count() == 0
    assert sd.remove_repeats(docs).count() == 0


def test_remove_repeats_keeps_rows_and_valid_text(make_docs, corpus):
    docs = make_docs(corpus)
    out = sd.remove_repeats(docs, size_column="n_chars")
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len(corpus)
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[0].text == "" and by_id[2].text is None and by_id[7].text == dict(corpus)[7]
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    assert "�" not in "".join(r.text or "" for r in rows)
