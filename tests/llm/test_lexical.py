import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cdrloom.llm import lexical as L

TERMS = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item long, id string, score double, rank int"
ITEMS = "item_id long, text string, doc_id string"


def terms(text):
    return TERMS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    """(item, rank, doc, score) by scoring every document."""
    found = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = Counter()
    for item, own in asked.items():
        scores = []
        for i, c in found:
            n = sum(c.values())
            m = 50 + (50 * n * n_docs) // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score > 0:
                scores.append((-score, math.inf if i is None else i))
        out.update((item, r, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1))
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeéß漢Z9") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    prose = lambda n: "".join(rng.choice(words[:int(300 ** rng.random())]) + rng.choice([" ", ", ", "\n", "-", "\x00"]) for _ in range(n))
    docs = [(k, prose(rng.randint(1, 60))) for k in range(600)]
    docs += [(k, docs[3][1]) for k in range(600, 660)]  # ties
    docs += [(700, None), (701, ""), (702, " .,\x00-"), (703, prose(30000)), (None, docs[3][1]), (None, prose(40)), (5, docs[5][1]), (6, "other " + docs[5][1])]
    items = [(k, prose(rng.randint(1, 40))) for k in range(30)] + [(30, docs[3][1]), (31, None), (32, ""), (33, "nowhereword"), (34, docs[5][1].upper())]
    return docs, items + [(7, "a b"), (None, docs[9][1]), items[4], (35, "É é ß"), (36, "common " * 4)]


def ranked(spark, docs, items, config):
    docs = spark.createDataFrame([(i, t, 1, "x", 0.5, 3) for i, t in docs], DOCS)
    items = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    return Counter(map(tuple, L.rank(docs, items, config).collect()))


@pytest.mark.parametrize("config", [L.SearchConfig(), L.SearchConfig(k=7, shard=2000, block=8), L.SearchConfig(k=3, shard=1 << 14, block=16, group=900)])
def test_equals_brute_force(spark, tables, config, monkeypatch):
    monkeypatch.setattr(L, "SEED_SHARDS", 2)
    assert ranked(spark, *tables, config) == brute(*tables, config.k)


def test_empty_tables(spark, tables):
    assert not ranked(spark, [], tables[1], L.SearchConfig())
    assert not ranked(spark, tables[0], [], L.SearchConfig())
    assert not ranked(spark, [(1, None), (2, "..")], [(1, "a")], L.SearchConfig())


def shard_of(docs, items, config):
    """One shard over all documents, the terms of the items and their weights."""
    import pyarrow as pa
    from cdrloom.llm.flat import flat_bytes

    hashes, sizes = L.term_hashes(*flat_bytes(pa.array(items, pa.string())))
    vocabulary, places = np.unique(hashes, return_inverse=True)
    own = [np.unique(x) for x in np.split(places, np.cumsum(sizes)[:-1])]
    builder = L.ShardBuilder(vocabulary, 0)
    builder.add(np.arange(len(docs)), pa.array(docs, pa.string()))
    row = {k: v[0] for k, v in builder.row().to_pydict().items()}
    frequency = np.zeros(len(vocabulary), np.int64)
    present, counts = (L.join_planes(row[c], np.uint32) for c in ("terms", "counts"))
    frequency[present] = counts
    weights = np.array([math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df + 1))) for df in frequency])
    pairs = [L.term_pairs(x, weights) for x in own]
    return L.Shard(row, weights, sorted({p for x in pairs for p in x}), row["n_docs"], row["n_terms"], config), pairs


def test_pair_bounds_hold_and_are_tighter(tables):
    docs, items = [t for _, t in tables[0]], [t for _, t in tables[1]]
    shard, paired = shard_of(docs, items, L.SearchConfig(block=32))
    tighter = 0
    for (a, b), (top, bound) in shard.bounds.items():
        total = np.zeros(len(docs), np.int64)
        alone = 0
        for t in {a, b}:
            place, impact = shard.postings(t)
            total[place] += impact
            alone += impact.max(initial=0)
        blocks = np.maximum.reduceat(total, np.arange(0, len(docs), 32))
        assert (bound >= blocks).all() and top == total.max()
        tighter += top < alone
    assert tighter > len(shard.bounds) // 4


def test_search_skips_documents_but_no_result(tables):
    docs, items = [t for _, t in tables[0]], [t for _, t in tables[1]]
    shard, paired = shard_of(docs, items, L.SearchConfig(block=32))
    looked = every = 0
    for pairs in paired:
        all_found, all_scores, n = shard.search(pairs, 1)
        if len(all_found) < 10:
            continue
        least = int(np.sort(all_scores)[-5])
        found, scores, seen = shard.search(pairs, least)
        keep = all_scores >= least
        assert dict(zip(found, scores)) == dict(zip(all_found[keep], all_scores[keep]))
        looked, every = looked + seen, every + n
    assert looked < 0.7 * every
