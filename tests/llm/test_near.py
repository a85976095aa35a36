import random
import time

import numpy as np
import pytest

from loomspan.llm import embed_graph, simhash
from loomspan.llm.components import components
from tests.llm.helpers import AWKWARD, documents, least


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)]
    want = least(200, pairs)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs + [(3, 3), (5, None)], "a long, b long")).collect()}
    assert got == {i: want[i] for p in pairs if p[0] != p[1] for i in p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_by_hand():
    import xxhash

    words = "The quick BROWN fox É jumps over".split()
    low = ["the", "quick", "brown", "fox", "É", "jumps", "over"]
    h = [xxhash.xxh64_intdigest(" ".join(low[i : i + 4]), 42) for i in range(4)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 4)
    assert int(simhash.fingerprint("\t".join(words), 4)[0]) == want
    assert int(simhash.fingerprint("a b", 4)[0]) == xxhash.xxh64_intdigest("a b", 42)
    assert int(simhash.fingerprint(None, 4)[0]) == 0


def test_join_is_exact():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 900).astype(np.uint64)
    near = base[:300] ^ (np.uint64(1) << rng.integers(0, 60, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 60, 300).astype(np.uint64))
    fp = np.unique(np.concatenate([base, near]))[:, None]
    names = np.arange(len(fp))
    want = least(len(fp), [(i, int(j)) for i in range(len(fp)) for j in np.flatnonzero(simhash.distance(fp, fp[i]) <= 4)])
    tree = simhash.TopTree(fp[::3], 3)
    row, leaf, home = tree.route(fp, 4)
    pairs = []
    for k in np.unique(leaf):
        at = leaf == k
        for a, b in simhash.join_shard(fp[row[at & home]], names[row[at & home]], fp[row[at]], names[row[at]], 4):
            pairs += list(zip(a.tolist(), b.tolist()))
    assert least(len(fp), pairs) == want


def test_near_duplicates_of_awkward_rows(spark):
    got = simhash.near_duplicates(documents(spark, AWKWARD), words=4, radius=4, bits=64).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(AWKWARD)
    assert by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1 and by[1]["fp"] == 0
    assert by[6]["component_id"] == 6
    assert simhash.near_duplicates(documents(spark, AWKWARD).where("false")).count() == 0


def test_similar_texts_meet(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(words) for _ in range(400)] for _ in range(30)]
    edited = [[rng.choice(words) if rng.random() < 0.005 else w for w in b] for b in base]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)] + [(100 + i, " ".join(b)) for i, b in enumerate(edited)]
    comp = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(documents(spark, rows)).collect()}
    assert sum(comp[100 + i] == i for i in range(30)) >= 29 and all(comp[i] == i for i in range(30))


def test_repeated_bodies_meet(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    base = [text(rng.randint(100, 600)) for _ in range(30)]
    rows = list(enumerate(base)) + [(100 + i, f"{t} {t}") for i, t in enumerate(base)]
    comp = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(documents(spark, rows)).collect()}
    assert all(comp[i] == comp[100 + i] == i for i in range(30))


def brute_classes(spark, rows, words, radius, bits):
    """The least known id reachable, by all pairs of fingerprints."""
    fp = np.stack([simhash.fingerprint(t, words, bits) for _, t in rows])
    near = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2) <= radius
    root = least(len(rows), [(int(a), int(b)) for a, b in np.argwhere(near)])
    ids = {}
    for (i, _), r in zip(rows, root):
        ids.setdefault(r, []).append(i)
    return [min((x for x in ids[r] if x is not None), default=None) for r in root]


def family(seed=12):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 12)):
            base = [rng.choice(words) if rng.random() < 0.02 else w for w in base]
            rows.append((len(rows), " ".join(base)))
    return rows


def test_classes_as_brute_force(spark):
    """op6's settings, exactly; with points that only rows without an id have."""
    rows = family() + [(9000 + i, t) for i, t in AWKWARD if i is not None] + [(None, t) for _, t in family(3)[:40]] + [(None, None)]
    got = simhash.near_duplicates(documents(spark, rows), words=4, radius=12, bits=64).collect()
    want = brute_classes(spark, rows, 4, 12, 64)
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=key) == sorted(zip([i for i, _ in rows], want), key=key)
    got = simhash.near_duplicates(documents(spark, rows), words=4, radius=4, bits=64).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=key) == sorted(zip([i for i, _ in rows], brute_classes(spark, rows, 4, 4, 64)), key=key)


def test_a_row_without_id_connects(spark):
    zero = np.uint64(0)
    points = [(zero, 1), (zero ^ np.uint64(15), None), (zero ^ np.uint64(255), 2)]
    fps = spark.createDataFrame([(i, int(f.astype(np.int64)), 0) for f, i in points], "doc_id long, fp long, fp2 long")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(simhash, "fingerprints", lambda *a: fps)
        assert {r["component_id"] for r in simhash.near_duplicates(fps, words=4, radius=4, bits=64).collect()} == {1}


@pytest.mark.parametrize("shard", [1024, 8])
def test_forest_as_brute_force(spark, shard):
    """The pipeline's settings: with one shard exactly; with many, every class of near texts still holds together."""
    rows = family(5) + [(5000, None), (5001, ""), (None, "a b"), (5002, "a b")]
    got = simhash.near_duplicates(documents(spark, rows), shard=shard).collect()
    want = brute_classes(spark, rows, 5, 26, 128)
    key = lambda x: (str(x[0]), str(x[1]))
    a, b = sorted(((r["doc_id"], r["component_id"]) for r in got), key=key), sorted(zip([i for i, _ in rows], want), key=key)
    assert a == b if shard == 1024 else sum(x == y for x, y in zip(a, b)) >= 0.99 * len(b)


def test_forest_meets_pairs_at_the_radius():
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 2**63, (20000, 2)).astype(np.uint64)
    flip = np.zeros((20000, 128), np.uint8)
    for row in flip:
        row[rng.choice(128, 26, replace=False)] = 1
    other = fp ^ np.packbits(flip, axis=1).view(np.uint64)
    forest = simhash.Forest(2_000_000, 26, 128)
    met = np.zeros(20000, bool)
    for a, b in zip(forest.route(fp), forest.route(other)):
        met |= a == b
    assert forest.depth == 11 and met.mean() >= 0.985


def test_cells_are_exact():
    """One shard with a dense group, joined by vantage points and blocks, against all pairs."""
    rng = np.random.default_rng(6)
    noise = lambda n, k: np.packbits(rng.random((n, 128)) < k / 128, axis=1).view(np.uint64)
    fp = np.unique(np.concatenate([noise(900, 10) ^ np.uint64(7), noise(500, 16), rng.integers(0, 2**63, (700, 2)).astype(np.uint64)]), axis=0)
    fp = np.concatenate([fp, fp[:200] ^ noise(200, 22)])
    names = rng.permutation(len(fp))
    want = least(len(fp), [(int(names[i]), int(names[j])) for i in range(len(fp)) for j in np.flatnonzero(simhash.distance(fp, fp[i]) <= 26)])
    pairs = [p for a, b in simhash.join_cell(fp, names, 26) for p in zip(a.tolist(), b.tolist())]
    assert least(len(fp), pairs) == want


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, label, 1, b"k") for i, e, label in rows], "vec_id long, embedding array<float>, label int, home int, key binary").repartition(3)


def test_embeddings_as_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[100:160] = x[5] + rng.normal(size=(60, 16)) * 0.1
    x[200:210] = x[7]
    label = rng.integers(0, 2, 300)
    label[100:160], label[200:210] = label[5], label[7]
    rows = [(i, x[i].tolist(), int(label[i])) for i in range(300)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, x[7].tolist(), None), (404, [], 1), (405, [None] * 16, 0), (406, [1.0] * 4, 0)]
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    s = (u @ u.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(300, dtype=bool)
    want = least(300, np.argwhere(s).tolist())
    for shard in (4096, 60):
        got = {r["vec_id"]: r for r in embed_graph.near_duplicates(vectors(spark, rows), shard=shard).collect()}
        assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(400, 407))
        links = np.array([got[i]["n_links"] for i in range(300)])
        assert (links == s.sum(1)).all() and [got[i]["component_id"] for i in range(300)] == want
    assert embed_graph.near_duplicates(vectors(spark, rows).where("false")).count() == 0


def test_embeddings_across_many_shards(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(240, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.normal(size=(240, 64))
    side -= (side * base).sum(1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    cos = rng.uniform(0.94, 0.97, 240)[:, None]
    x = np.concatenate([base, cos * base + np.sqrt(1 - cos * cos) * side, base[:40]]).astype(np.float32)
    n = len(x)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    s = (u @ u.T >= 0.93) & ~np.eye(n, dtype=bool)
    want = least(n, np.argwhere(s).tolist())
    got = {r["vec_id"]: r for r in embed_graph.near_duplicates(vectors(spark, [(i, x[i].tolist(), 1) for i in range(n)]), shard=24).collect()}
    assert [got[i]["n_links"] for i in range(n)] == s.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(n)] == want
    assert [got[i]["kept"] for i in range(n)] == [i == w for i, w in enumerate(want)]


def test_one_row_per_vector(spark):
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, x, 1), (1, y, 1), (2, x, 1), (2, x, 2), (None, y, 1), (None, None, 1), (3, x, None)]
    got = embed_graph.near_duplicates(vectors(spark, rows)).collect()
    assert sorted(tuple(map(str, r[:4])) for r in got) == sorted(tuple(map(str, r)) for r in [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (2, 0, 2, True), (None, 1, 1, False), (None, 0, None, False), (3, 0, 3, True)])


def test_one_direction_in_many_lengths(spark):
    x = np.random.default_rng(1).normal(size=8)
    rows = [(i, (x * (i + 1)).tolist(), 1) for i in range(300)] + [(400 + i, (-x * (i + 1)).tolist(), 1) for i in range(5)]
    got = {r["vec_id"]: tuple(r)[1:4] for r in embed_graph.near_duplicates(vectors(spark, rows), shard=20).collect()}
    assert all(got[i] == (299, 0, i == 0) for i in range(300)) and all(got[400 + i] == (4, 400, i == 0) for i in range(5))


def test_recall_with_one_large_label(spark):
    """20000 vectors of one label, cut into shards twice over: links against brute force over all pairs."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(6000, 24))
    x = base[rng.integers(0, 6000, 20000)] + rng.normal(size=(20000, 24)) * rng.choice([0.05, 0.2, 0.25], 20000)[:, None]
    x = x.astype(np.float32)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    want = np.concatenate([(u[i : i + 1000] @ u.T >= 0.93).sum(1) - 1 for i in range(0, 20000, 1000)])
    got = embed_graph.near_duplicates(vectors(spark, [(i, v, 1) for i, v in enumerate(x.tolist())]), shard=1500).toPandas().sort_values("vec_id")
    links = got["n_links"].to_numpy()
    assert len(got) == 20000 and (links <= want).all() and want.sum() > 30000
    assert links.sum() >= 0.999 * want.sum() and got["audited"].min() >= 0


def test_recall_audit(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 16))[rng.integers(0, 200, 1500)] + rng.normal(size=(1500, 16)) * 0.2
    r = embed_graph.audit_recall(vectors(spark, [(i, v, i % 2) for i, v in enumerate(x.tolist())]), every=10).first()
    assert r["wanted"] > 100 and r["found"] >= 0.9 * r["wanted"]


def solved_by_hand(vec, weight, threshold):
    norm = np.linalg.norm(vec, axis=1)
    sim = (vec @ vec.T) / (norm[:, None] * norm[None, :]) >= threshold
    np.fill_diagonal(sim, False)
    return sim @ weight, least(len(vec), zip(*np.nonzero(sim)))


@pytest.mark.parametrize("seed", range(4))
def test_balls_as_brute_force(monkeypatch, seed):
    """Dense groups, some near each other, points around them and points on their own."""
    monkeypatch.setattr(embed_graph, "BALL", 20)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 24))
    centres[1] = centres[0] + 0.25 * rng.normal(size=24)  # balls that touch
    parts = [c + s * rng.normal(size=(n, 24)) for c, s, n in zip(centres, (0.05, 0.05, 0.02, 0.2, 0.3), (150, 120, 200, 100, 80))]
    vec = np.concatenate([*parts, rng.normal(size=(150, 24))])
    vec = vec[rng.permutation(len(vec))]
    weight, home = rng.integers(0, 4, len(vec)), rng.random(len(vec)) < 0.7
    links, root, recall = embed_graph.solve_shard(vec, weight, home, 0.93)
    want, star = solved_by_hand(vec, weight, 0.93)
    assert (links[home] == want[home]).all() and (links[~home] == 0).all() and recall >= 0.99
    # links between two guests are another shard's work; with all at home the classes are whole
    links, root, _ = embed_graph.solve_shard(vec, weight, np.ones(len(vec), bool), 0.93)
    assert (links == want).all()
    met = {}
    for a, b in zip(root.tolist(), star):
        assert met.setdefault(a, b) == b
    assert len(set(root.tolist())) == len(set(star))
    assert len(embed_graph.balls(vec / np.linalg.norm(vec, axis=1)[:, None], 0.93, np.random.default_rng(1))[1]) >= 3


def test_thirty_thousand_near_copies_in_a_minute():
    rng = np.random.default_rng(0)
    base = rng.normal(size=64)
    vec = np.concatenate([base + 1e-3 * rng.normal(size=(30_000, 64)), rng.normal(size=(500, 64)), base + 0.35 * rng.normal(size=(500, 64))])
    began = time.monotonic()
    links, root, _ = embed_graph.solve_shard(vec, np.ones(len(vec), np.int64), np.ones(len(vec), bool), 0.93)
    assert time.monotonic() - began < 60
    norm = np.linalg.norm(vec, axis=1)
    for q in (0, 29_999, 30_100, 30_600, 30_999):
        sim = vec @ vec[q] / (norm * norm[q]) >= 0.93
        assert links[q] == sim.sum() - 1
    assert len(set(root[:30_000].tolist())) == 1


def test_covering_masks_miss_no_pair():
    """Every difference within the radius is left out by one of the masks, for radii of all sizes; the forest missed a hundredth of
    those at the radius."""
    rng = np.random.default_rng(6)
    for bits, radius in ((128, 26), (64, 12), (64, 7)):
        masks = simhash.covering_masks(bits, radius)
        flip = np.zeros((3000, bits), np.uint8)
        for row in flip:
            row[rng.choice(bits, radius, replace=False)] = 1
        flip = np.packbits(flip, axis=1).view(np.uint64)
        assert ((flip[:, None] & masks[None]) == 0).all(2).any(1).all()


def test_all_pairs_at_the_radius(spark):
    """Far more points than a shard, in several blocks: each pair at the radius is one class, and nothing else is."""
    rng = np.random.default_rng(8)
    fp = rng.integers(0, 2**64, (6000, 2), dtype=np.uint64)
    flip = np.zeros((3000, 128), np.uint8)
    for row in flip:
        row[rng.choice(128, 26, replace=False)] = 1
    fp[3000:] = fp[:3000] ^ np.packbits(flip, axis=1).view(np.uint64)
    rows = [(i, int(a), int(b)) for i, (a, b) in enumerate(fp.view(np.int64).tolist())]
    points = spark.createDataFrame(rows, "node long, fp long, fp2 long").repartition(3)
    got = simhash.links(points, 26, 128, shard=4).collect()
    assert {tuple(sorted((r["a"], r["b"]))) for r in got} == {(i, i + 3000) for i in range(3000)}
