"""Embedding near-duplicates by a robust-pruned flat graph.

1. Equal vectors of one label are one point with a multiplicity; points have ids of their own, so repeated
   vec_ids stay separate rows.
2. A label with many points is cut into shards around sampled centroids, at most FAN a time, and shards that
   are still too large are cut again, so that no centroid list grows with the table. A point is at home with
   its nearest centroid and a guest with every other one where a point within the range could be at home: the
   triangle inequality loses no pair. Guests are counted and dealt into slices, each beside a copy of the
   shard's home points, so no task holds a whole label. Centroids lie in tables and meet the points in
   cogroups; nothing but the number of shards that are too large reaches the driver.
3. In a shard, points within half the range's angle of one centre all link with one another, by the triangle
   inequality; such balls are told first, and their links come from their weights, not from pairs. Links between a
   ball and points around it are counted in blocks. The other points go on: they fall into small overlapping clusters; each builds its own graph, the neighbours of a
   point being pruned so that no kept neighbour is much nearer to the dropped one than the point is. The
   clusters' adjacency lists are united, with their reverse edges.
4. Every point is searched from the clusters' medoids and its own node: a greedy beam first, then the range
   expands over all neighbours of points already in range. A point with very many partners reads the shard
   as one exact block instead. A link found from one end counts at the other end too. All links found are
   verified in double precision.
5. Each slice audits the recall on evenly spaced queries against brute force; under 0.99 the whole slice is
   joined by exact blocks. As every possible partner of a home point is in one of its slices, these audits
   speak for links across shards too. `audited` is the least recall among a point's slices.

Links are counted at each point's home and summed over its slices; a slice hands on one star per connected
group for the components. Null, zero and non-finite vectors, and rows without a label, link with nothing.
A shard whose centroids coincide, as one direction dominates it, isn't cut further: a
task holds such a group whole (8 bytes a number of each distinct vector), in time that grows with the group.
Vectors of different length don't link. Rows with equal vec_id are rows of their own; a null vec_id takes
part, and its component is the least known vec_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import discard, give_back, settle
from loomspan.llm.components import class_least, components

SHARD = 4096
#: Guests of a slice, in shards.
GUESTS = 3
#: Centroids of one cut, and rows that one task deals to them.
FAN = 64
DEALT = 16_384
CLUSTER = 400
DEGREE = 12
CANDIDATES = 48
ALPHA = 1.2
BEAM = 32
DENSE = 192
AUDIT = 48
#: Points of a ball at least, and centres that may be drawn in vain.
BALL, MISSES = 256, 8


def robust_graph(x: np.ndarray, clusters: list[np.ndarray]) -> list[np.ndarray]:
    """Adjacency lists of unit vectors: pruned in each cluster, united, with reverse edges."""
    src, dst = [], []
    for c in clusters:
        n = len(c)
        if n < 2:
            continue
        dist = np.maximum(0.0, 2 - 2 * (x[c] @ x[c].T))
        np.fill_diagonal(dist, np.inf)
        k = min(CANDIDATES, n - 1)
        cand = np.argpartition(dist, k - 1, 1)[:, :k]
        order = np.argsort(np.take_along_axis(dist, cand, 1), 1, kind="stable")
        cand = np.take_along_axis(cand, order, 1)
        near = np.take_along_axis(dist, cand, 1)
        alive = np.ones((n, k), bool)
        rows = np.arange(n)
        for _ in range(min(DEGREE, k)):
            first = alive.argmax(1)
            ok = alive[rows, first]
            r, p = rows[ok], cand[rows[ok], first[ok]]
            if not len(r):
                break
            src.append(c[r])
            dst.append(c[p])
            alive[r, first[ok]] = False
            alive[r] &= ~(ALPHA * ALPHA * dist[p[:, None], cand[r]] <= near[r])
    if not src:
        return [np.zeros(0, np.int64)] * len(x)
    a, b = np.concatenate(src), np.concatenate(dst)
    pairs = np.unique(np.concatenate([a * len(x) + b, b * len(x) + a]))
    a, b = pairs // len(x), pairs % len(x)
    return np.split(b, np.searchsorted(a, np.arange(1, len(x))))


def overlapping_clusters(x: np.ndarray, size: int, rng: np.random.Generator) -> tuple[list[np.ndarray], np.ndarray]:
    """(clusters of about `size` points, each point in its two nearest; the clusters' medoids)."""
    n = len(x)
    k = -(-n // size)
    if k <= 1:
        mean = x.mean(0)
        return [np.arange(n)], np.array([int((x @ mean).argmax())])
    centre = x[rng.choice(n, k, replace=False)]
    for _ in range(4):
        own = (x @ centre.T).argmax(1)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centre)
    two = np.argpartition(-(x @ centre.T), 1, 1)[:, :2]
    clusters = [np.flatnonzero((two == j).any(1)) for j in range(k)]
    medoids = np.array([c[(x[c] @ centre[j]).argmax()] for j, c in enumerate(clusters) if len(c)])
    return [c for c in clusters if len(c)], medoids


def search(x: np.ndarray, graph: list[np.ndarray], medoids: np.ndarray, queries: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, point, dense): candidate links of each query, and the places whose neighbourhood is dense."""
    n, m = len(x), len(queries)
    size = np.array([len(g) for g in graph])
    flat, first = np.concatenate(graph) if size.sum() else np.zeros(0, np.int64), np.cumsum(size) - size
    width = max(1, int(size.max()))
    table = np.full((n, width), -1, np.int64)
    table[np.repeat(np.arange(n), size), np.arange(len(flat)) - np.repeat(first, size)] = flat
    seen = np.zeros((m, n), bool)
    seeds = np.concatenate([np.repeat(medoids[None, :], m, 0), queries[:, None]], 1)
    rows = np.arange(m)
    seen[rows[:, None], seeds] = True
    sims = np.einsum("qsd,qd->qs", x[seeds], x[queries])
    hit_q, hit_p = [], []

    def note(q: np.ndarray, p: np.ndarray, s: np.ndarray) -> None:
        ok = s >= near
        hit_q.append(q[ok])
        hit_p.append(p[ok])

    note(np.repeat(rows, seeds.shape[1]), seeds.ravel(), sims.ravel())
    beam_p, beam_s, open_ = seeds, sims, np.ones_like(seeds, bool)
    while True:
        score = np.where(open_, beam_s, -np.inf)
        best = score.argmax(1)
        live = np.flatnonzero(score[rows, best] > -np.inf)
        if not len(live):
            break
        open_[live, best[live]] = False
        nxt = table[beam_p[live, best[live]]]
        fresh = (nxt >= 0) & ~seen[live[:, None], nxt]
        qi, ci = np.nonzero(fresh)
        new_s = np.full(nxt.shape, -np.inf)
        if len(qi):
            q, p = live[qi], nxt[qi, ci]
            seen[q, p] = True
            s = np.einsum("kd,kd->k", x[p], x[queries[q]])
            new_s[qi, ci] = s
            note(q, p, s)
        if len(live) < m:
            ps, ss, op = (np.concatenate([a[live], b], 1) for a, b in ((beam_p, nxt), (beam_s, new_s), (open_, fresh)))
        else:
            ps, ss, op = np.concatenate([beam_p, nxt], 1), np.concatenate([beam_s, new_s], 1), np.concatenate([open_, fresh], 1)
        keep = np.argpartition(-ss, min(BEAM, ss.shape[1]) - 1, 1)[:, :BEAM]
        got = [np.take_along_axis(a, keep, 1) for a in (ps, ss, op)]
        if len(live) < m:
            w = got[0].shape[1]
            if beam_p.shape[1] < w:
                grow = w - beam_p.shape[1]
                beam_p, beam_s, open_ = np.pad(beam_p, ((0, 0), (0, grow))), np.pad(beam_s, ((0, 0), (0, grow)), constant_values=-np.inf), np.pad(open_, ((0, 0), (0, grow)))
            beam_p, beam_s, open_ = beam_p[:, :w].copy(), beam_s[:, :w].copy(), open_[:, :w].copy()
            beam_p[live], beam_s[live], open_[live] = got
        else:
            beam_p, beam_s, open_ = got
    # the range expands over the neighbours of what is in range
    dense = np.zeros(m, bool)
    q, p = np.concatenate(hit_q), np.concatenate(hit_p)
    count = np.bincount(q, minlength=m)
    while len(q):
        dense |= count > DENSE
        go = ~dense[q]
        q, p = q[go], p[go]
        if not len(q):
            break
        nq, np_ = np.repeat(q, size[p]), table[p][np.arange(width)[None, :] < size[p][:, None]]
        fresh = ~seen[nq, np_]
        key = np.unique(nq[fresh] * n + np_[fresh])
        nq, np_ = key // n, key % n
        seen[nq, np_] = True
        s = np.einsum("kd,kd->k", x[np_], x[queries[nq]]) if len(nq) else np.zeros(0)
        note(nq, np_, s)
        ok = s >= near
        q, p = nq[ok], np_[ok]
        count += np.bincount(q, minlength=m)
    return np.concatenate(hit_q), np.concatenate(hit_p), np.flatnonzero(dense)


def joined(root: np.ndarray, a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Star roots after linking a[k] with p[k]: the least root of each class."""
    while len(a):
        low = np.minimum(root[a], root[p])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, p, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[p], low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    return root


def balls(x: np.ndarray, threshold: float, rng: np.random.Generator) -> tuple[np.ndarray, list[int]]:
    """(ball of each point, -1 for none; centres): disjoint sets of BALL points and more within half the threshold's angle of a
    centre. Any two points of a ball link, by the triangle inequality of angles, so a dense group needs no pairs."""
    half = np.cos(np.arccos(threshold) / 2) + 1e-9
    ball, centres, misses = np.full(len(x), -1), [], 0
    free = np.arange(len(x))
    while len(free) >= BALL and misses < MISSES:
        c = int(rng.choice(free))
        near = x[free] @ x[c] >= half
        if near.sum() >= BALL:
            ball[free[near]] = len(centres)
            centres.append(c)
            free, misses = free[~near], 0
        else:
            misses += 1
    return ball, centres


def solve_shard(vec: np.ndarray, weight: np.ndarray, home: np.ndarray, threshold: float, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """(links of each home point counted with multiplicities, star root of each point, audited recall).

    Balls of points that all link with one another are counted by their weights; the links between a ball and points outside,
    which can only lie within one and a half times the threshold's angle of its centre, are counted in blocks, without lists of
    pairs; all other points go by solve_sparse.
    """
    n = len(vec)
    vec = vec.astype(np.float64)
    norm = np.linalg.norm(vec, axis=1)
    x = vec / norm[:, None]
    ball, centres = balls(x, threshold, np.random.default_rng(seed))
    if not centres:
        return solve_sparse(vec, weight, home, threshold, seed)
    links, root, recall = np.zeros(n, np.int64), np.arange(n), 1.0
    rest = np.flatnonzero(ball < 0)
    if len(rest):
        got, star, recall = solve_sparse(vec[rest], weight[rest], home[rest], threshold, seed)
        links[rest] = got
        root = joined(root, rest, rest[star])
    angle = np.arccos(threshold)
    for g, c in enumerate(centres):
        inside = np.flatnonzero(ball == g)
        links[inside] += weight[inside].sum() - weight[inside]
        root = joined(root, inside, np.full(len(inside), inside[0]))
        w = weight[inside].astype(np.float64)
        near = np.flatnonzero((ball != g) & (x @ x[c] >= np.cos(min(np.pi, 1.5 * angle)) - 1e-9))
        step = max(1, (4 << 20) // len(inside))
        for i in range(0, len(near), step):
            q = near[i : i + step]
            s = x[q] @ x[inside].T
            hit = s >= threshold + 1e-9
            a, b = np.nonzero(np.abs(s - threshold) < 1e-9)
            if len(a):  # so near the threshold that the exact quotient decides
                hit[a, b] = np.einsum("kd,kd->k", vec[q[a]], vec[inside[b]]) / (norm[q[a]] * norm[inside[b]]) >= threshold
            number = hit.astype(np.float64)
            links[inside] += (weight[q].astype(np.float64) @ number).astype(np.int64)
            alone = ball[q] < 0  # other balls count theirs in their turn
            links[q[alone]] += (number[alone] @ w).astype(np.int64)
            met = q[hit.any(1)]
            root = joined(root, met, np.full(len(met), inside[0]))
    links[~home] = 0
    return links, root, recall


def solve_sparse(vec: np.ndarray, weight: np.ndarray, home: np.ndarray, threshold: float, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """The same for points in general: graph search, audited, or exact blocks."""
    n = len(vec)
    vec = vec.astype(np.float64)
    norm = np.linalg.norm(vec, axis=1)
    x = vec / norm[:, None]
    rng = np.random.default_rng(seed)
    homes = np.flatnonzero(home)
    links, root = np.zeros(n, np.int64), np.arange(n)

    def verified(q: np.ndarray, p: np.ndarray) -> np.ndarray:
        out = np.zeros(len(q), bool)
        for i in range(0, len(q), 1 << 16):
            a, b = q[i : i + (1 << 16)], p[i : i + (1 << 16)]
            out[i : i + (1 << 16)] = (np.einsum("kd,kd->k", vec[a], vec[b]) / (norm[a] * norm[b]) >= threshold) & (a != b)
        return out

    def exact(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, p = np.nonzero(x[q] @ x.T >= threshold - 1e-6)
        a = q[i]
        ok = verified(a, p)
        return a[ok], p[ok]

    def join(a: np.ndarray, p: np.ndarray) -> None:
        nonlocal root
        root = joined(root, a, p)

    clusters, medoids = overlapping_clusters(x, CLUSTER, rng)
    graph = robust_graph(x, clusters)
    block = max(64, min(512, (8 << 20) // max(1, n)))

    def by_graph(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(verified links of queries, and the queries that are left to exact blocks)."""
        at, p, dense = search(x, graph, medoids, q, threshold - 1e-6)
        full = np.isin(at, dense)
        a, p = q[at[~full]], p[~full]
        ok = verified(a, p)
        return a[ok], p[ok], q[dense]

    audit = homes[:: max(1, len(homes) // AUDIT)][:AUDIT] if len(homes) else homes
    recall = 1.0
    if len(audit):
        a, p, rest = by_graph(audit)
        want = exact(np.setdiff1d(audit, rest))
        recall = len(np.intersect1d(want[0] * n + want[1], a * n + p)) / len(want[0]) if len(want[0]) else 1.0
    left = np.ones(n, bool)  # home points whose links exact blocks find
    kept = [np.zeros(0, np.int64)]
    if recall >= 0.99:
        left[homes] = False
        for i in range(0, len(homes), block):
            a, p, rest = by_graph(homes[i : i + block])
            left[rest] = True
            kept.append(a * n + p)
            join(a, p)
    is_home = np.zeros(n, bool)
    is_home[homes] = True
    by_block = homes[left[homes]]
    for i in range(0, len(by_block), block):
        a, p = exact(by_block[i : i + block])
        np.add.at(links, a, weight[p])
        join(a, p)
        back = is_home[p] & ~left[p]
        kept.append(p[back] * n + a[back])
    # a link that one end found is the other end's too
    key = np.unique(np.concatenate(kept))
    a, p = key // n, key % n
    back = is_home[p] & ~left[p]
    key = np.unique(np.concatenate([key, p[back] * n + a[back]]))
    np.add.at(links, key // n, weight[key % n])
    return links, root, recall


def points_of(rows: DataFrame) -> DataFrame:
    """vec_id, key (of label and vector; null: links with nothing), label, vec (float64 bytes), from vec_id, embedding, label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, vec = [], []
            for e, label in zip(b.column(1), b.column(2).to_pylist()):
                v = None
                if e.is_valid and label is not None and e.values is not None and e.values.null_count == 0 and len(e.values):
                    v = e.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                    if not np.isfinite(v).all() or not v.any():
                        v = None
                key.append(None if v is None else hashlib.blake2b(label.encode() + b"\0" + v.tobytes(), digest_size=16).digest())
                vec.append(None if v is None else v.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key, pa.binary()), b.column(2), pa.array(vec, pa.binary())], ["vec_id", "key", "label", "vec"])

    return rows.selectExpr("cast(vec_id as bigint) vec_id", "embedding", "cast(label as string) label").mapInArrow(run, "vec_id long, key binary, label string, vec binary")


DEALT_ROWS = "shard string, home boolean, node long, m long, vec binary"


def cut(dealt: DataFrame, shard: int, reach: float) -> DataFrame | None:
    """`dealt` with every shard of more than 2 * `shard` home points cut around centroids; None if there is none."""
    whole = F.substring_index("shard", " ", 1).endswith("x")  # its points have one direction: nothing to cut
    sizes = dealt.where(~whole).groupBy("shard").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("rows")).where(F.col("homes") > 2 * shard)
    large = settle(sizes.select("shard", "homes", F.least(F.lit(FAN), F.ceil(F.col("homes") / shard)).cast("int").alias("fan"), F.ceil(F.col("rows") / DEALT).cast("int").alias("parts")))
    if not large.count():
        discard(large)
        return None
    work = dealt.join(large, "shard")
    # a few more than `fan` points of each shard pass by lot; the first ones are its centroids
    lot = F.pmod(F.xxhash64("vec"), F.lit(1 << 31)) / float(1 << 31)
    drawn = work.where(F.col("home") & (lot < (2 * F.col("fan") + 16) / F.col("homes"))).groupBy("shard").agg(F.array_sort(F.collect_list(F.struct(lot.alias("lot"), "vec"))).alias("c"))
    centres = large.join(drawn, "shard").select("shard", F.transform(F.slice("c", F.lit(1), F.col("fan")), lambda y: y["vec"]).alias("c"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def deal(key, rows: pa.Table, centroids: pa.Table) -> pa.Table:
        c = np.stack([np.frombuffer(v) for v in centroids["c"][0].as_py()])
        c = c / np.linalg.norm(c, axis=1, keepdims=True)
        # centroids of one direction would share all points: one of them stays
        same = 2 - 2 * (c @ c.T) <= (reach / 1000) ** 2
        c = c[[not same[i, :i].any() for i in range(len(c))]]
        x = np.stack([np.frombuffer(v) for v in rows["vec"].to_pylist()])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = np.maximum(0, 2 - 2 * (x @ c.T))
        first = d.argmin(1)
        gap = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
        # a partner can be at home beyond the bisecting plane between two centroids if the plane is within reach
        near = d - d[np.arange(len(x)), first][:, None] <= 2 * reach * gap[first] + 1e-9
        at, j = np.nonzero(near)
        home = rows["home"].to_numpy()[at] & (j == first[at])
        path, rest = key[0].as_py().split(" ", 1)
        names = pa.array([f"{path}.{k}{'' if len(c) > 1 else 'x'} {rest}" for k in range(len(c))])
        take = pa.array(at)
        return pa.table({"shard": names.take(pa.array(j)), "home": home, "node": rows["node"].take(take), "m": rows["m"].take(take), "vec": rows["vec"].take(take)})

    dealt_on = (
        work.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).select("shard", "part", "home", "node", "m", "vec").groupBy("shard", "part")
        .cogroup(centres.groupBy("shard", "part")).applyInArrow(deal, DEALT_ROWS)
    )
    return dealt.join(large.select("shard"), "shard", "left_anti").select(dealt_on.columns).union(dealt_on)


def near_duplicates(rows: DataFrame, threshold: float = 0.93, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept, audited (null: links with nothing) for each row."""
    points = settle(points_of(rows))
    groups = points.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("m"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    groups = settle(groups.withColumn("node", F.monotonically_increasing_id()))
    # a shard's name: its path of cuts, the vectors' length, the label
    dealt = settle(groups.select(F.concat_ws(" ", F.lit("0"), F.length("vec").cast("string"), "label").alias("shard"), F.lit(True).alias("home"), "node", "m", "vec"))
    reach = float(np.sqrt(2 - 2 * threshold))
    while (finer := cut(dealt, shard, reach)) is not None:
        before, dealt = dealt, settle(finer)
        discard(before)
    guests = dealt.groupBy("shard").agg(F.count_if(~F.col("home")).alias("guests")).select("shard", F.greatest(F.lit(1), F.ceil(F.col("guests") / (GUESTS * shard))).cast("int").alias("slices"))
    told = dealt.join(guests, "shard")
    mine = F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")
    # home points weigh nothing in the further slices: their links among themselves count once
    sliced = told.where("home").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumn("m", F.when(F.col("slice") == 0, F.col("m")).otherwise(F.lit(0))).union(
        told.where("not home").withColumn("slice", mine)
    )

    def solve(key, group):
        vec = np.stack([np.frombuffer(v) for v in group["vec"].to_pylist()])
        node, m, home = (group[c].to_numpy() for c in ("node", "m", "home"))
        order = np.argsort(node, kind="stable")
        vec, node, m, home = vec[order], node[order], m[order], home[order]
        links, root, recall = solve_shard(vec, m, home, threshold)
        give_back()
        return pa.table({"node": node, "home": home, "links": links, "root": node[root], "recall": np.full(len(node), recall)})

    found = settle(sliced.select("shard", "slice", "home", "node", "m", "vec").groupBy("shard", "slice").applyInArrow(solve, "node long, home boolean, links long, root long, recall double"))
    discard(dealt)
    classes = components(found.where("node <> root").selectExpr("node as a", "root as b")).select(F.col("node").alias("of"), "component")
    counted = found.where("home").groupBy("node").agg(F.sum("links").alias("links"), F.min("recall").alias("audited"))
    known = groups.select("key", "node", "m", "least").join(counted, "node").join(classes, F.col("node") == F.col("of"), "left")
    alone = known.where("component is null").withColumn("component_id", F.col("least"))
    together = class_least(known.where("component is not null"), "component", "least", "node", "component_id")
    by_key = alone.unionByName(together).select("key", (F.col("links") + F.col("m") - 1).alias("n_links"), "component_id", "audited")
    # rows that link with nothing don't meet under the null key
    none = points.where("key is null").select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(None).cast("double").alias("audited"))
    out = points.where("key is not null").select("vec_id", "key").join(by_key, "key").drop("key").unionByName(none)
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.isnull("n_links"), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"), "audited")
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), "audited")


def audit_recall(rows: DataFrame, threshold: float = 0.93, every: int = 100) -> DataFrame:
    """found, wanted: links of the vectors whose id is divisible by `every`, against brute force over all rows in blocks."""
    got = near_duplicates(rows, threshold).where(F.col("vec_id") % every == 0).select("vec_id", "n_links")
    points = points_of(rows).where("key is not null")
    queries = settle(points.where(F.col("vec_id") % every == 0).select("vec_id", "label", "vec"))

    def run(key, q, p):
        if not q.num_rows or not p.num_rows:
            return pa.table({"vec_id": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        a, b = (np.stack([np.frombuffer(v) for v in t["vec"].to_pylist()]) for t in (q, p))
        s = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T >= threshold
        same = q["vec_id"].to_numpy()[:, None] == p["vec_id"].to_numpy()[None, :]
        return pa.table({"vec_id": q["vec_id"], "n": pa.array((s & ~same).sum(1), pa.int64())})

    blocks = 16
    part = points.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    spread = queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    want = spread.groupBy("label", "block").cogroup(part.groupBy("label", "block")).applyInArrow(run, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    return got.join(want, "vec_id").agg(F.sum(F.least("n_links", "n")).alias("found"), F.sum("n").alias("wanted"))
