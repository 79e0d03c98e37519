import random
import re
from collections import Counter

import numpy as np
import pytest

from cdrloom.llm import jaccard as J


def sets_of(rows):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        out.append((i, {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def brute(rows):
    """(id, least id of the group, links) of each row, by comparing all pairs."""
    sets = sets_of(rows)
    n = len(sets)
    linked = [[j for j in range(n) if j != i and sets[i][1] and len(sets[i][1] & sets[j][1]) >= 0.8 * len(sets[i][1] | sets[j][1])] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            root[i] = min([root[i], *(root[j] for j in linked[i])])
    least = {r: min([sets[i][0] for i in range(n) if root[i] == r and sets[i][0] is not None], default=None) for r in set(root)}
    return [(sets[i][0], least[root[i]], len(linked[i])) for i in range(n)]


@pytest.mark.parametrize("block", [512, 4])
def test_equals_brute_force(make_docs, corpus, block):
    found = J.similar_documents(make_docs(corpus), J.JoinConfig(block=block)).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in found) == Counter(brute(corpus))


def test_keep_one_leaves_one_of_each_group(make_docs, corpus):
    docs = make_docs(corpus)
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    groups = {(g, i if g is None else 0) for i, g, _ in brute(corpus)}
    assert set(ids) == {g for g, _ in groups}
    assert ids[0] == 1 and ids[39] == 1


def test_documents_without_id_keep_their_groups(make_docs):
    rows = [(None, " ".join(f"w{k}x{j}" for j in range(30))) for k in (1, 2, 2, 3)] + [(None, None), (7, ""), (8, None)]
    kept = J.keep_one(make_docs(rows)).collect()
    assert Counter((r.doc_id, (r.text or "")[:2]) for r in kept) == Counter({(None, "w1"): 1, (None, "w2"): 1, (None, "w3"): 1, (None, ""): 1, (7, ""): 1, (8, ""): 1})


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    config = J.JoinConfig()
    grams = [np.unique(rng.integers(0, 1 << 63, 400, np.uint64))]
    for k in range(60):  # 360 of 440 shared: above the threshold
        grams.append(np.unique(np.concatenate([grams[0][:360], rng.integers(0, 1 << 63, 40, np.uint64)])))
    flat, offsets = np.concatenate(grams), np.concatenate([[0], np.cumsum([len(g) for g in grams])])
    a, b = J.surviving_pairs(J.minhash(flat, offsets, config), None, config)
    assert {(0, k) for k in range(1, 61)} <= set(zip(a.tolist(), b.tolist()))
    assert J.exact_links(np.array([0]), np.array([1]), flat, offsets, 0.8)[0]
    assert not J.exact_links(np.array([0]), np.array([1]), flat, offsets, 0.83)[0]


def test_needed_matches_follow_the_posterior():
    from math import comb
    need = J.least_matches(120, 8, 0.8, 1e-9)
    for r, m in enumerate(need, 1):
        mass = lambda top, n: sum(comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(top + 1))
        assert mass(m, 8 * r) >= 1e-9 and (m == 0 or mass(m - 1, 8 * r) < 1e-9)


def test_empty_table(make_docs):
    assert J.similar_documents(make_docs([])).count() == 0
    assert J.keep_one(make_docs([])).count() == 0


def test_components(spark):
    from cdrloom.llm.components import connected
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 330)]
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    expected = {(x, r) for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert {tuple(r) for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()} == expected
