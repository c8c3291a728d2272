"""Near copies in dense templates, where most pairs stay a little below the threshold, against all pairs."""

import random

import numpy as np

from conftest import at, write_tables
from textward.llm import p1_near_copies as p1


def request(i, text):
    return {"request_id": i, "text": text, "direction": "input", "ts": at(i), "received_at": at(i)}


def template(rnd, name, size, pairs):
    """Texts of 50 shared words and 8 own ones (0.76 among them); in planted pairs 3 of these are shared (0.84)."""
    base = [f"{name}w{k}" for k in range(50)]
    own = [[f"{name}r{i}s{k}" for k in range(8)] for i in range(size)]
    for i, j in pairs:
        own[j][:3] = own[i][:3]
    out = []
    for slots in own:
        words = base + slots
        rnd.shuffle(words)
        out.append(" ".join(words))
    return out


def all_pairs(texts):
    """(record, group) of groups of two or more, from all pairs of texts without repeated words."""
    words = {}
    rows = [[words.setdefault(w, len(words)) for w in t.split()] for t in texts]
    m = np.zeros((len(rows), len(words)), dtype=np.float32)
    for i, r in enumerate(rows):
        m[i, r] = 1
    shared, size = m @ m.T, m.sum(axis=1)
    near = shared >= 0.8 * (size[:, None] + size[None, :] - shared) - 1e-6
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    count = np.bincount([find(i) for i in range(len(rows))], minlength=len(rows))
    return {(i, find(i)) for i in range(len(rows)) if count[find(i)] > 1}


def check(spark, folder, texts):
    want = all_pairs(texts)
    got = {(r.record_id, r.group_id) for r in p1.found(spark, write_tables(folder, {"scan_requests": [request(i, t) for i, t in enumerate(texts)]})).collect()}
    assert got == want


def test_candidates_that_fail_do_not_hide_others(spark, tmp_path):
    rnd = random.Random(3)
    texts = []
    for k in range(6):
        order = rnd.sample(range(60), 60)
        texts += template(rnd, f"t{k}", 60, zip(order[:20], order[20:40]))
    check(spark, tmp_path / "t", texts)


def test_pairs_far_apart_in_a_dense_region(spark, tmp_path):
    rnd = random.Random(4)
    order = rnd.sample(range(1500), 1500)
    check(spark, tmp_path / "t", template(rnd, "t", 1500, zip(order[:400], order[400:800])))
