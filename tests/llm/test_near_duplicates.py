"""SimHash, embeddings and components against brute force."""

import numpy as np
import pytest
import xxhash

from textloom.llm import components, embedding_dedup, simhash


def brute_components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 6000 + k) for k in range(100)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == brute_components({x for e in real for x in e}, real)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("radius", [0, 3, 4, 7, 12, 20])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    f = rng.integers(0, 2**63, 301, dtype=np.int64).view(np.uint64)
    f[150:] = f[:151]
    for k in range(150, 301):
        for b in rng.choice(64, rng.integers(0, 15), replace=False):
            f[k] ^= np.uint64(1 << int(b))
    d = np.bitwise_count(f[:, None] ^ f[None, :]).astype(int)
    i, j = np.nonzero(d <= radius)
    assert sorted(zip(*simhash.compare(f, f, radius).tolist())) == sorted(zip(i.tolist(), j.tolist(), d[i, j].tolist()))


@pytest.mark.parametrize("n", [10, 10**6, 10**10])
def test_pigeonhole_masks_miss_nothing(n):
    rng = np.random.default_rng(1)
    masks = simhash.pigeonhole_masks(n, 4)
    for _ in range(300):
        x = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(x & m == 0 for m in masks)


def brute_fingerprint(text, words):
    parts = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def variants(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = base.split()
        for k in rng.choice(len(words), edits, replace=False):
            words[k] = f"w{rng.integers(1e9)}"
        out.append(" ".join(words))
    return out


def corpus():
    rng = np.random.default_rng(5)
    fresh = lambda n: " ".join(f"t{x}" for x in rng.integers(0, 5000, n))
    texts = [None, "", " \t ", "One", "one", "a b c", "É é x y z", "nb sp is a word"]
    for n, copies, edits in ((300, 6, 1), (200, 5, 3), (80, 4, 1), (500, 30, 1)):
        base = fresh(n)
        texts += [base, base.upper(), *variants(rng, base, copies, edits)]
    texts += [fresh(int(n)) for n in rng.integers(3, 200, 40)]
    ids = rng.permutation(10 * len(texts))[: len(texts)].tolist()
    return list(zip(ids, texts))


def test_simhash_equals_brute_force(spark, monkeypatch):
    data = corpus() + [(None, "one"), (None, "only without an id at all")]
    monkeypatch.setattr(simhash, "HEAVY", 6)  # large buckets are cut into parts
    got = simhash.group(spark.createDataFrame(data, "doc_id long, text string"), words=4, radius=4).collect()
    prints = [brute_fingerprint(t, 4) for _, t in data]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fp & (2**64 - 1)) for r in got) == sorted((i if i is not None else -1, p) for (i, _), p in zip(data, prints))
    known = [k for k, (i, _) in enumerate(data) if i is not None]
    links = [(data[a][0], data[b][0]) for a in known for b in known if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    want = brute_components([data[k][0] for k in known], links)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    alone = [r for r in got if r.doc_id is None]
    assert sorted(str(r.component_id) for r in alone) == sorted([str(want[next(i for i, t in data if t == "one" and i is not None)]), "None"])


def test_simhash_empty(spark):
    assert simhash.group(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    rng = np.random.default_rng(9)
    fresh = lambda n: " ".join(f"t{x}" for x in rng.integers(0, 100_000, n))
    bases = [fresh(200) for _ in range(12)]
    data, group = [], {}
    for g, base in enumerate(bases):
        for t in [base, base, *variants(rng, base, 3, 2)]:
            group[len(data)] = g
            data.append((len(data), t, "x"))
    clean = [fresh(150) for _ in range(40)]
    for t in clean:
        group[len(data)] = 1000 + len(data)
        data.append((len(data), t, "x"))
    data.append((0, bases[0], "again"))
    kept = simhash.representatives(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()
    assert sorted(group[r.doc_id] for r in kept) == sorted(set(group.values()))


def brute_similar(data, words, similarity):
    sets = [{" ".join(p[i : i + words]) for i in range(max(1, len(p) - words + 1))} for p in (t.lower().split() for _, t in data)]
    links = [(data[a][0], data[b][0]) for a in range(len(data)) for b in range(a) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    return brute_components([i for i, _ in data], links)


def templates(seed, families, shared=350, own=40):
    """Pairs of similarity 0.82 out of one template, by which all texts have 0.78."""
    rng = np.random.default_rng(seed)
    fresh = lambda n: " ".join(f"t{x}" for x in rng.integers(0, 10**9, n))
    template, out = fresh(shared), []
    for _ in range(families):
        family = fresh(10)
        out += [f"{template} {family} {fresh(own)}" for _ in range(2)]
    return [(k, out[k]) for k in rng.permutation(len(out)).tolist()]


@pytest.mark.parametrize("texts", [128, 16])
def test_dense_candidates_lose_no_similar_pair(spark, monkeypatch, texts):
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", texts)  # 16: the component is cut into parts
    data = templates(4, 40)
    want = brute_similar(data, 5, 0.8)
    assert len(set(want.values())) == 40
    got = simhash.group(spark.createDataFrame(data, "doc_id long, text string"), words=5, radius=15, similarity=0.8).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def two_clusters(seed, n=40, length=300):
    """Two groups by one template, members of a group at a similarity of about 0.8, across about 0.7."""
    rng = np.random.default_rng(seed)
    fresh = lambda n: [f"t{x}" for x in rng.integers(0, 10**9, n)]
    template, out = fresh(length), []
    for _ in range(2):
        head = fresh(20)
        for _ in range(n):
            words = head + template
            at = int(rng.integers(0, length - 30))
            words[at : at + 26] = fresh(26)
            out.append(" ".join(words))
    return [(k, out[k]) for k in rng.permutation(len(out)).tolist()]


def test_two_dense_clusters_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HEAVY", 16)  # buckets are cut into parts as well
    data, want = [], {}
    for seed in range(20):
        own = [(1000 * seed + k, t) for k, t in two_clusters(seed)]
        data += own
        want |= brute_similar(own, 5, 0.8)
    assert len(set(want.values())) > 20
    got = simhash.group(spark.createDataFrame(data, "doc_id long, text string"), words=5, radius=15, similarity=0.8).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_stars_thin_edges_to_one_a_node():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 400, (2, 500))
    node, low = components.stars(a, b)
    want = brute_components(set(a.tolist()) | set(b.tolist()), zip(a.tolist(), b.tolist()))
    assert dict(zip(node.tolist(), low.tolist())) == {k: v for k, v in want.items() if k != v} and len(node) == len(set(node.tolist()))


def test_chains_over_many_tasks(spark):
    rng = np.random.default_rng(6)
    order = rng.permutation(3000).tolist()
    edges = [(order[k], order[k + 1]) for k in range(2999) if k % 100 != 99] + [(10**6, 10**6 + k) for k in range(500)]
    table = spark.createDataFrame([edges[k] for k in rng.permutation(len(edges))], "a long, b long").repartition(24)
    got = {r.node: r.component for r in components.connected_components(table).collect()}
    assert got == brute_components({x for e in edges for x in e}, edges)


def test_repeated_lines_do_not_part_equal_sets(spark):
    rng = np.random.default_rng(8)
    line, data = " ".join(f"l{k}" for k in range(10)), []
    for k in range(20):
        body = " ".join(f"t{x}" for x in rng.integers(0, 10**9, 300))
        data += [(2 * k, f"{body} {' '.join([line] * 3)}"), (2 * k + 1, f"{body} {' '.join([line] * 100)}")]
    once = "a b c d e f g h i"
    assert simhash.both_fingerprints(once, 5)[0] == simhash.fingerprint(once, 5)
    got = simhash.group(spark.createDataFrame(data, "doc_id long, text string"), words=5, radius=15, similarity=0.8).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: k // 2 * 2 for k in range(40)}


def test_near_copies_without_an_id(spark):
    rng = np.random.default_rng(3)
    base, other = (" ".join(f"t{x}" for x in rng.integers(0, 10**9, 200)) for _ in range(2))
    lone = variants(rng, other, 2, 1)
    data = [(5, base), (None, variants(rng, base, 1, 1)[0]), (7, variants(rng, base, 1, 1)[0]), (None, lone[0]), (None, lone[1]), (None, None), (None, "")]
    table = spark.createDataFrame(data, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.group(table, words=5, radius=15, similarity=0.8).collect()}
    assert got == {(5, 5), (7, 5), (None, 5), (None, None)}
    kept = simhash.representatives(table).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(map(str, (d for d in data if d[0] != 7)))


def brute_vectors(data, threshold):
    x = [None if v is None or not len(v) or any(c is None or not np.isfinite(c) for c in v) or not any(v) else np.array(v, np.float32).astype(float) for _, v in data]
    x = [None if v is None else v / np.sqrt(v @ v) for v in x]
    links = [(a, b) for a in range(len(x)) for b in range(a) if x[a] is not None and x[b] is not None and len(x[a]) == len(x[b]) and x[a] @ x[b] >= threshold]
    n = np.zeros(len(x), int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    comp = brute_components([i for i, _ in data], [(data[a][0], data[b][0]) for a, b in links])
    return sorted((i, int(k), comp[i], comp[i] == i) for (i, _), k in zip(data, n))


def vectors(seed, clusters=30, dim=24):
    rng = np.random.default_rng(seed)
    out = []
    for c in rng.normal(size=(clusters, dim)):
        for _ in range(rng.integers(1, 12)):
            out.append((c + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.3])).astype(np.float32).tolist())
    hot = rng.normal(size=dim)
    out += [(hot + rng.normal(size=dim) * 0.05).astype(np.float32).tolist() for _ in range(120)]
    out += [out[0], out[0], [0.0] * dim, None, [], [1.0, None] + [0.0] * (dim - 2), [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [1.0, 2.0], [2.0, 4.0], [3e38] * dim, [1e-38] * dim]
    ids = rng.permutation(10 * len(out))[: len(out)].tolist()
    return list(zip(ids, out))


@pytest.mark.parametrize("exact", [True, False])
def test_embeddings_equal_brute_force(spark, exact, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)  # several blocks in a cell
    data = vectors(3)
    table = spark.createDataFrame([(i, v, 0, "clash") for i, v in data], "vec_id long, embedding array<float>, label int, cell string")
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(table, exact=exact).collect())
    want = brute_vectors(data, 0.95)
    if exact:
        assert got == want
    else:
        found, real = sum(r[1] for r in got), sum(r[1] for r in want)
        assert 0.9 * real <= found <= real and all(g[1] <= w[1] for g, w in zip(got, want))


def test_embeddings_empty_and_null_ids(spark):
    schema = "vec_id long, embedding array<double>"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0]), (4, [2.0, 0.0]), (None, [0.0, 1.0])], schema)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == sorted([("4", 1, "4"), ("None", 0, "None"), ("None", 1, "4")])
