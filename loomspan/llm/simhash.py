"""SimHash near-duplicates: fingerprints of word shingles, joined by vantage-point trees.

A document's fingerprint has the majority bit of its shingles' hashes: 64 bits of XXH64, or 128 of XXH3.
Equal fingerprints are one point of the metric space, with an id of its own. For a small radius, a
vantage-point tree over a bounded sample cuts the space into shards: at each node a point goes inside or
outside the median distance to the vantage point, and as a query also to the other side whenever the triangle
inequality leaves a partner there (distance within `radius` of the median). Each shard is joined by a tree of
its own down to small blocks, which are compared exactly. That join is exact: no candidate is capped.

A radius that asks for a similarity rather than for a few bits leaves the top tree nothing to prune, distances
of unrelated texts being all alike. Then covering masks find the pairs, all of them (Pagh, CoveringLSH: Locality-Sensitive
Hashing without False Negatives, ACM Transactions on Algorithms 14, 2018). The bits are dealt to a few parts; a pair within
the radius differs in few bits of one part at least, and for each such difference one of that part's masks leaves all of it
out. So the pair agrees under one of the masks, and what agrees is compared. Points meet in blocks, a task a pair of blocks
and some of the masks.

A shard hands on one star per connected group, not its pairs; components of all stars give the classes. Null
texts count as empty; texts without words have the fingerprint zero, linked like any other. Repeated rows and
ids are rows of their own; a null doc_id takes part and gets the component of its class, null where the class
has no known id. Very long texts are read whole; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import discard, give_back, settle
from loomspan.llm.components import class_least, components
from loomspan.llm.windows import group_runs, mix

SEED = 42
SAMPLE = 6000
#: There are about sqrt(points) / SPREAD shards, so that neither a shard nor the copies of a query grow fast.
SPREAD = 64
BLOCK = 192
#: A forest's points of a shard, about; the chance to miss a pair at the radius; points of one task, in all its shards.
SHARD = 1024
MISS = 0.01
TASK = 50_000
#: Covering masks: shards of a block; tasks at least, and for a pair of blocks; differing bits that a part's masks leave out, and one.
SHARDS = 512
TASKS, SPLIT = 32, 4
DIMENSIONS = 7


def fingerprint(text: str | None, words: int, bits: int = 64) -> np.ndarray:
    """The fingerprint of a whole text as bits / 64 unsigned numbers: A-Z in lower case, words between ASCII white space.
    The majority counts a shingle as often as it occurs."""
    from xxhash import xxh3_128_digest, xxh64_digest

    ws = text.encode().lower().split() if text else []
    if not ws:
        return np.zeros(bits // 64, np.uint64)
    digest = xxh64_digest if bits == 64 else xxh3_128_digest
    line = b" ".join(ws)
    if len(ws) <= words:
        got = [digest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        got = [digest(line[s:e], SEED) for s, e in zip(starts[: len(ws) - words + 1].tolist(), ends[words - 1 :].tolist())]
    h = np.frombuffer(b"".join(got), np.uint8).reshape(len(got), bits // 8)  # big end first
    total = np.zeros(bits, np.int64)
    for lo in range(0, len(h), 32768):
        total += np.unpackbits(h[lo : lo + 32768], axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * total > len(h)).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, words: int = 5, bits: int = 64) -> DataFrame:
    """doc_id, fp, fp2 (longs, the unsigned values' bits; fp2 is 0 for 64 bits) for each row. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [fingerprint(t, words, bits) for t in b.column(1).to_pylist()]
            fp = np.zeros((len(got), 2), np.uint64)
            if got:
                fp[:, : bits // 64] = np.stack(got)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp[:, 0].copy().view(np.int64)), pa.array(fp[:, 1].copy().view(np.int64))], ["doc_id", "fp", "fp2"])
        give_back()

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, fp long, fp2 long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, the last axis being their words."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int16)


class TopTree:
    """Vantage points and medians that cut the space into 2**levels shards; nodes in heap order."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels = levels
        self.vantage = np.zeros((2**levels, sample.shape[1]), np.uint64)
        self.median = np.zeros(2**levels, np.int16)
        todo = [(1, sample[np.lexsort(sample.T)])] if levels else []
        while todo:
            node, pts = todo.pop()
            if len(pts):
                # the point farthest from the first one: a corner splits better than a centre
                v = pts[distance(pts, pts[0]).argmax()]
                d = distance(pts, v)
                self.vantage[node], self.median[node] = v, np.median(d)
            else:
                d = np.zeros(0, np.int16)
            if 2 * node < 2**levels:
                inside = d <= self.median[node]
                todo += [(2 * node, pts[inside]), (2 * node + 1, pts[~inside])]

    def route(self, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home): each point's own leaf, and every leaf that can hold a partner within radius."""
        row, node, home = np.arange(len(fp)), np.ones(len(fp), np.int64), np.ones(len(fp), bool)
        for _ in range(self.levels):
            d, m = distance(fp[row], self.vantage[node]), self.median[node]
            inside, outside = d <= m + radius, d > m - radius
            own = d <= m
            row, node, home = (
                np.concatenate([row[inside], row[outside]]),
                np.concatenate([2 * node[inside], 2 * node[outside] + 1]),
                np.concatenate([(home & own)[inside], (home & ~own)[outside]]),
            )
        return row, node, home


class Forest:
    """For callers that can do with nearly all pairs; links() doesn't use it. Trees that split by `depth` bits of their own choice each; a shard is a leaf of a tree."""

    def __init__(self, n: int, radius: int, bits: int, shard: int = SHARD, seed: int = 1):
        self.bits, self.depth = bits, max(0, int(np.ceil(np.log2(max(1, n) / shard))))
        stay = 1.0  # the chance that a pair at the radius agrees in a tree's bits
        for i in range(self.depth):
            stay *= (bits - radius - i) / (bits - i)
        trees = 1 if self.depth == 0 else int(np.ceil(np.log(MISS) / np.log1p(-stay)))
        rng = np.random.default_rng(seed)
        self.chosen = [rng.choice(bits, self.depth, replace=False) for _ in range(trees)]
        self.tasks = max(1, -(-n * trees // TASK))

    def route(self, fp: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree the shard of every point."""
        flat = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), -1), axis=1)
        for t, cols in enumerate(self.chosen):
            leaf = np.zeros(len(fp), np.uint64)
            for c in cols:
                leaf = leaf * np.uint64(2) + flat[:, c]
            yield mix(leaf * np.uint64(len(self.chosen)) + np.uint64(t))


def covering_masks(bits: int, radius: int, seed: int = 1) -> np.ndarray:
    """Masks (one a row, of bits / 64 numbers) so that any two fingerprints within the radius agree under one of them.

    Parts get k dimensions each, radius + 1 in all; a pair within the radius differs in less than k bits of some part. Each of
    its bits has a vector of k bits, and each v but 0 gives a mask of those whose vector has an odd number of bits in common
    with v: fewer than k vectors leave some v that has an even number with all of them."""
    parts = -(-(radius + 1) // DIMENSIONS)
    rng = np.random.default_rng(seed)
    masks = []
    for n, own in enumerate(np.array_split(rng.permutation(bits), parts)):
        k = (radius + 1) // parts + (n < (radius + 1) % parts)
        v = np.arange(1, 2**k)
        # vectors are exchanged as long as unrelated points agree less for it
        odd = (np.bitwise_count(v[:, None] & v[None]) & 1).astype(np.int64)
        chosen, better = rng.integers(0, len(v), len(own)), True
        while better:
            better = False
            for c in range(len(own)):
                weight = odd[:, chosen].sum(1) - odd[:, chosen[c]]
                agree = np.exp2(-(weight[:, None] + odd)).sum(0)
                if agree.min() < agree[chosen[c]] * (1 - 1e-9):
                    chosen[c], better = agree.argmin(), True
        flat = np.zeros((len(v), bits), np.uint8)
        flat[:, own] = odd[:, chosen]
        masks.append(np.packbits(flat, axis=1).view(np.uint64))
    return np.concatenate(masks)


def keys_under(fp: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """16 bits of a hash of the masked fingerprints; equal ones have equal keys."""
    h = np.zeros(len(fp), np.uint64)
    for w in range(fp.shape[1]):
        h = (h ^ (fp[:, w] & mask[w])) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.uint16)


def connect(root: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The roots of all points (each the least of its class) with these pairs linked, too."""
    while True:
        a, b = root[one], root[two]
        apart = a != b
        if not apart.any():
            return root
        one, two, a, b = one[apart], two[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def join_covered(fp: np.ndarray, masks: np.ndarray, radius: int) -> np.ndarray:
    """For each point the least place of its class, linking all pairs within the radius that agree under one of the masks."""
    root = np.arange(len(fp))
    for mask in masks:
        key = keys_under(fp, mask)
        order = np.argsort(key, kind="stable")
        key = key[order]
        start, size = group_runs(key)
        for s, m in zip(start[size > BLOCK], size[size > BLOCK]):
            run = order[s : s + m]
            for names, centre in join_cell(fp[run], run, radius):
                root = connect(root, names, centre)
        end = np.repeat(np.where(size > BLOCK, 0, start + size), size)
        words = [np.ascontiguousarray(fp[order, w]) for w in range(fp.shape[1])]
        at, shift = np.arange(len(fp)), 1
        while len(at := at[at + shift < end[at]]):
            far = np.bitwise_count(words[0][at] ^ words[0][at + shift])
            for w in words[1:]:
                far += np.bitwise_count(w[at] ^ w[at + shift])
            near = at[far <= radius]
            if len(near):
                root = connect(root, order[near], order[near + shift])
            shift += 1
    return root


def join_cell(fp: np.ndarray, names: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stars (name, centre) that connect all pairs of these points within radius."""
    order = np.argsort(names, kind="stable")
    fp, names = fp[order], names[order]
    poor = 0
    while len(fp) > BLOCK and poor < 4:
        d = distance(fp, fp[0])
        inside, shell = d <= radius, (d > radius) & (d <= 2 * radius)
        poor += inside.sum() * 32 < len(fp)
        yield names[inside], np.full(inside.sum(), names[0])
        yield from blocks(fp[inside], names[inside], fp[shell], names[shell], radius)
        fp, names = fp[~inside], names[~inside]
    for i in range(0, len(fp), BLOCK):
        yield from blocks(fp[i : i + BLOCK], names[i : i + BLOCK], fp[i:], names[i:], radius)


def blocks(s: np.ndarray, sn: np.ndarray, q: np.ndarray, qn: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(s), BLOCK):
        for j in range(0, len(q), 4096):
            yield from stars(s[i : i + BLOCK], sn[i : i + BLOCK], q[j : j + 4096], qn[j : j + 4096], radius)


def join_shard(points: np.ndarray, names: np.ndarray, queries: np.ndarray, query_names: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stars (name, centre) that connect all pairs of a point and a query within radius; names are numbers.

    A vantage-point recursion: points inside and outside the median distance, queries to where the triangle
    inequality leaves partners; a set that no vantage point can split, or whose split sends nearly all
    queries to both sides, is compared block by block.
    """
    todo = [(points, names, queries, query_names)]
    while todo:
        s, sn, q, qn = todo.pop()
        if not len(s) or not len(q):
            continue
        if len(s) > BLOCK:
            v = s[distance(s, s[0]).argmax()]
            d = distance(s, v)
            m = np.int16(np.median(d))
            inside = d <= m
            if inside.all() and (d < m).any():
                m -= 1
                inside = d <= m
            if not inside.all():
                dq = distance(q, v)
                left, right = dq <= m + radius, dq > m - radius
                if left.sum() + right.sum() < 1.9 * len(q):
                    todo += [(s[inside], sn[inside], q[left], qn[left]), (s[~inside], sn[~inside], q[right], qn[right])]
                    continue
        yield from blocks(s, sn, q, qn, radius)


def stars(s: np.ndarray, sn: np.ndarray, q: np.ndarray, qn: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    far = np.bitwise_count(q[:, 0][:, None] ^ s[:, 0][None, :])
    for w in range(1, s.shape[1]):
        far += np.bitwise_count(q[:, w][:, None] ^ s[:, w][None, :])
    qi, si = np.nonzero(far <= radius)
    other = qn[qi] != sn[si]
    qi, si = qi[other], si[other]
    if not len(qi):
        return
    qi_u, qa = np.unique(qi, return_inverse=True)
    si_u, sa = np.unique(si, return_inverse=True)
    ids = np.concatenate([qn[qi_u], sn[si_u]])
    values, label = np.unique(ids, return_inverse=True)
    one, two = label[qa], label[len(qi_u) + sa]
    root = np.arange(len(values))
    while True:
        low = np.minimum(root[one], root[two])
        new = root.copy()
        np.minimum.at(new, one, low)
        np.minimum.at(new, two, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    yield values, values[root]


def by_bits(radius: int, bits: int) -> bool:
    """Whether the radius is a few bits, so that trees prune, and not one that asks for a similarity."""
    return radius * 10 <= bits


def edges_of(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """The distinct edges (a, b) of stars."""
    parts = [np.stack([ids, centre], 1)[ids != centre] for ids, centre in found]
    got = np.unique(np.concatenate(parts), axis=0) if parts else np.zeros((0, 2), np.int64)
    return pa.table({"a": got[:, 0].copy(), "b": got[:, 1].copy()})


def links(points: DataFrame, radius: int = 4, bits: int = 64, shard: int = SHARD) -> DataFrame:
    """points: node (distinct longs), fp, fp2. Returns edges (a, b) of nodes that connect all pairs within radius."""
    n = points.count()
    return near_links(points, n, radius, bits) if by_bits(radius, bits) else covered_links(points, n, radius, bits, shard)


def near_links(points: DataFrame, n: int, radius: int, bits: int) -> DataFrame:
    """For few bits: shards of a vantage-point tree, queries in every shard that can hold a partner."""
    width = bits // 64
    levels = max(0, round(np.log2(max(1, n) ** 0.5 / SPREAD)))
    rank = F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(1 << 31)) / float(1 << 31)
    got = points.where(rank < min(1.0, SAMPLE / max(1, n))).select("fp", "fp2").limit(2 * SAMPLE).toArrow() if levels else None
    sample = np.stack([got["fp"].to_numpy(), got["fp2"].to_numpy()], 1).view(np.uint64)[:, :width] if got else np.zeros((0, width), np.uint64)
    tree = TopTree(sample, levels)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 8192):
                node, fp, fp2 = (c.to_numpy() for c in b.slice(i, 8192).columns)
                row, leaf, home = tree.route(np.stack([fp, fp2], 1).view(np.uint64)[:, :width], radius)
                yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(node[row]), pa.array(fp[row]), pa.array(fp2[row]), pa.array(home)], ["leaf", "node", "fp", "fp2", "home"])

    def solve(key, group):
        fp = np.stack([group["fp"].to_numpy(), group["fp2"].to_numpy()], 1).view(np.uint64)[:, :width]
        node, home = group["node"].to_numpy(), group["home"].to_numpy()
        return edges_of(join_shard(fp[home], node[home], fp, node, radius))

    dealt = points.select("node", "fp", "fp2").mapInArrow(route, "leaf int, node long, fp long, fp2 long, home boolean")
    return dealt.groupBy("leaf").applyInArrow(solve, "a long, b long")


def covered_links(points: DataFrame, n: int, radius: int, bits: int, shard: int) -> DataFrame:
    """For a similarity: every pair of blocks, under every mask."""
    width, blocks = bits // 64, max(1, -(-n // (shard * SHARDS)))
    pairs = blocks * (blocks + 1) // 2
    split = max(SPLIT, -(-TASKS // pairs))
    masks = covering_masks(bits, radius)

    def solve(key, group):
        fp = np.stack([group["fp"].to_numpy(), group["fp2"].to_numpy()], 1).view(np.uint64)[:, :width]
        node = group["node"].to_numpy()
        root = join_covered(fp, masks[key[0].as_py() % split :: split], radius)
        some = root != np.arange(len(root))
        give_back()
        return pa.table({"a": node[some], "b": node[root[some]]})

    own = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    each = points.select("node", "fp", "fp2", own.alias("block")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pair = F.least("block", "other").cast("long") * blocks + F.greatest("block", "other")
    each = each.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(split - 1)))).select((pair * split + F.col("part")).alias("task"), "node", "fp", "fp2")
    return each.groupBy("task").applyInArrow(solve, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, radius: int = 26, bits: int = 128, shard: int = SHARD) -> DataFrame:
    """doc_id, fp, fp2, component_id (the smallest doc_id reachable by links) for each row.

    Texts of Jaccard similarity 0.8 differ in 19 of 128 bits on average (deviation 4), of which a radius of 26 has all but a
    hundredth; every pair of fingerprints within it is linked. Unrelated texts differ in 64 (deviation 6).
    """
    fps = settle(fingerprints(docs, words, bits))
    points = settle(fps.groupBy("fp", "fp2").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    found = settle(links(points, radius, bits, shard))
    groups = components(found).select(F.col("node").alias("of"), "component")
    discard(found)
    known = points.join(groups, F.col("node") == F.col("of"), "left")
    alone = known.where("component is null").select("fp", "fp2", F.col("least").alias("component_id"))
    together = class_least(known.where("component is not null"), "component", "least", "node", "component_id").select("fp", "fp2", "component_id")
    return fps.join(alone.union(together), ["fp", "fp2"]).select("doc_id", "fp", "fp2", "component_id")
