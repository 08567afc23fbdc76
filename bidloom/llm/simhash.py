"""SimHash near-duplicate detection with vantage-point trees.

``fingerprints`` gives 64-bit SimHashes of word shingles. Pairs of fingerprints that differ in at most ``radius`` bits
are links. They are found exactly:

* The bits are cut into ``blocks`` equal blocks. Fingerprints within ``radius`` are within radius // blocks bits in one
  block at least. A vantage-point tree over each block's values partitions the fingerprints by Hamming distance to
  vantage points. (Over all 64 bits nearly all distances lie near 32, so a tree would send most points to both sides.)
* At each node a point goes to the inner side if its distance is at most the node's radius, else to the outer side. By
  the triangle inequality only inner points whose distance exceeds the node's radius less the block radius can have
  partners outside; these, and no others, go to the outer side as well: the boundary-overlapping shards.
* The trees that deal fingerprints to shards are built from a bounded sample (SAMPLE); every fingerprint is routed, so
  the sample decides only how even the shards are, never the result. In its task a shard goes on as a tree over all its
  points, down to leaves whose pairs are compared. Only a node that no vantage point can split is compared whole, by
  canopies that the triangle inequality bounds.
* A shard over SHARD_ROWS is cut into chunks, and each pair of chunks becomes a task's tile.

A shard returns links that connect what its pairs connect instead of all pairs, and they are merged into components by
alternating large-star and small-star rounds, with a table in the shared folder after each round.

``drop_near_duplicates`` asks for a Jaccard, which 64 bits tell too coarsely. It takes eight SimHashes of each text's set
of shingles (512 bits). Trees over 25 blocks of 20 bits find the texts that differ in at most one bit of a block; those
that differ in at most 32 of the first 128 bits are candidates. All pairs of a candidate component are then compared by
their shingles themselves, and only pairs that reach the Jaccard are links.

Null texts count as empty. Texts without words have fingerprint zero and are linked like any others. Texts with fewer
words than a shingle have one shingle. Rows that repeat an id are rows of their own. Null ids never are a component's
smallest id; a component without any id has a null component_id. Empty tables give empty results. Other columns are
ignored by ``near_duplicates`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, counted_join, cut

#: Most rows of the sample that the shards' trees are built from, and one in how many rows it takes at most; rows that a
#: shard should have; rows of a shard's leaf; rows over which a shard is cut into tiles; depth of a tree.
SAMPLE, SAMPLE_SHARE = 65_536, 16
SHARD_TARGET = 20_000
LEAF_ROWS = 256
SHARD_ROWS = 400_000
MOST_DEPTH = 32
STRIPE = 256
#: Near copies by Jaccard: 64-bit words of a sketch, bits and number of its blocks, the radius in a block; most differing
#: bits of a candidate's first 128; rows and characters of a chunk whose pairs are verified in a task.
SKETCH_WORDS = 8
BLOCK_BITS = 20
SKETCH_BLOCKS = 64 * SKETCH_WORDS // BLOCK_BITS
BLOCK_RADIUS = 1
CANDIDATE_BITS = 32
VERIFY_ROWS = 256
VERIFY_CHARS = 4_000_000


# --- Fingerprints --------------------------------------------------------------------------------------------------


def simhash(text: str | None, shingle: int, digest) -> int:
    """The SimHash of a text. Only A-Z are lower-cased and only ASCII white space parts words, as bytes do it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[k:] for k in range(shingle)], strict=False))
    hashes = np.fromiter((digest(s, 42) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprinter(shingle: int):
    def run(batches):
        import xxhash

        for batch in batches:
            texts = batch.column(1)
            found = np.fromiter((simhash(t.as_py(), shingle, xxhash.xxh64_intdigest) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprinter(shingle), "doc_id long, fp long")


# --- Vantage-point trees -------------------------------------------------------------------------------------------


def block_values(fps: np.ndarray, block: int, blocks: int) -> np.ndarray:
    low, high = 64 * block // blocks, 64 * (block + 1) // blocks
    return (fps >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)


def vantage_point(values: np.ndarray, radius: int, rng) -> tuple[int, int] | None:
    """(vantage, node radius) whose larger side, overlap included, is least; None if no side would be smaller by a tenth."""
    some = values if len(values) <= 512 else values[rng.integers(0, len(values), 512)]
    best, chosen = 0.9 * len(some), None
    for vantage in some[rng.integers(0, len(some), 4)]:
        distance = np.bitwise_count(some ^ vantage).astype(np.int64)
        median = int(np.median(distance))
        for r in (median - 1, median):
            larger = max(int((distance <= r).sum()), int((distance > r - radius).sum()))
            if r >= 0 and larger < best:
                best, chosen = larger, (int(vantage), r)
    return chosen


def sides(values: np.ndarray, node: tuple[int, int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the inner side, and of the outer side with the inner points that may have partners there."""
    distance = np.bitwise_count(values ^ values.dtype.type(node[0])).astype(np.int64)
    return np.flatnonzero(distance <= node[1]), np.flatnonzero(distance > node[1] - radius)


def build_tree(values: np.ndarray, leaf: int, radius: int, depth: int = 0, seed: int = 1) -> tuple | None:
    """((vantage, radius), inner, outer) nodes over a sample of block values; None is a leaf."""
    if len(values) <= leaf or depth >= MOST_DEPTH:
        return None
    node = vantage_point(values, radius, np.random.default_rng(seed))
    if node is None:
        return None
    inner, outer = sides(values, node, radius)
    return node, build_tree(values[inner], leaf, radius, depth + 1, 2 * seed), build_tree(values[outer], leaf, radius, depth + 1, 2 * seed + 1)


def route(values: np.ndarray, tree: tuple | None, radius: int) -> list[tuple[int, np.ndarray]]:
    """(leaf, row numbers) with the overlap that ``radius`` asks for; every pair within it meets in a leaf."""
    out, todo = [], [(tree, 1, np.arange(len(values)))]
    while todo:
        node, name, rows = todo.pop()
        if not len(rows):
            continue
        if node is None:
            out.append((name, rows))
            continue
        inner, outer = sides(values[rows], node[0], radius)
        todo += [(node[1], 2 * name, rows[inner]), (node[2], 2 * name + 1, rows[outer])]
    return out


def _distance(x: np.ndarray, y: np.ndarray, i, j) -> np.ndarray:
    return np.bitwise_count(x[i] ^ x[j]) + np.bitwise_count(y[i] ^ y[j])


def merged(lab: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels, each the least number that it hangs together with, after links i - j as well."""
    while len(i):
        low = np.minimum(lab[i], lab[j])
        np.minimum.at(lab, lab[i], low)
        np.minimum.at(lab, lab[j], low)
        while (lab != lab[lab]).any():
            lab = lab[lab]
        apart = lab[i] != lab[j]
        i, j = i[apart], j[apart]
    return lab


def compare_all(values: np.ndarray, x: np.ndarray, y: np.ndarray, radius: int, accept: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what all pairs connect that are within ``radius`` in the block and ``accept`` in x and y."""
    n = len(values)
    lab = np.arange(n)
    for at in range(0, n, STRIPE):  # a stripe of pairs at a time, whose links are merged at once
        i, j = np.nonzero(np.bitwise_count(values[at : at + STRIPE, None] ^ values[None, at:]) <= radius)
        i, j = i[i < j] + at, j[i < j] + at
        near = _distance(x, y, i, j) <= accept
        lab = merged(lab, i[near], j[near])
    moved = np.flatnonzero(lab != np.arange(n))
    return lab[moved], moved


def canopies(values: np.ndarray, x: np.ndarray, y: np.ndarray, radius: int, accept: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what pairs within ``accept`` connect, for points that lie too close for a tree.

    Points within half of ``accept`` of a pivot are within it of each other, so the pivot links them all; only points at
    up to ``accept`` and a half can be near one of them, and only those are compared. Then the canopy's points are done.
    """
    half, left, a, b = accept // 2, np.arange(len(values)), [], []
    while len(left) > 4 * LEAF_ROWS:
        distance = _distance(x, y, left[:1], left).astype(np.int64)
        star, shell = left[distance <= half], left[(distance > half) & (distance <= accept + half)]
        a.append(np.full(len(star) - 1, left[0]))
        b.append(star[1:])
        for at in range(0, len(shell), STRIPE):
            part = shell[at : at + STRIPE]
            for k in range(0, len(star), 16 * STRIPE):
                own = star[k : k + 16 * STRIPE]
                near = _distance(x, y, part[:, None], own[None, :]) <= accept
                hit = np.flatnonzero(near.any(axis=1))
                a.append(own[near[hit].argmax(axis=1)])
                b.append(part[hit])
        left = left[distance > half]
    i, j = compare_all(values[left], x[left], y[left], 64, accept)
    return np.concatenate([*a, left[i]]), np.concatenate([*b, left[j]])


def shard_links(nodes: np.ndarray, values: np.ndarray, x: np.ndarray, y: np.ndarray, radius: int, accept: int) -> np.ndarray:
    """Links (smaller, larger node) of a shard, by a vantage-point tree over all its points: from each point that hangs
    together with others to the least node of them, so that most shards give the same links."""
    order = np.argsort(nodes, kind="stable")
    nodes, values, x, y = nodes[order], values[order], x[order], y[order]
    rng, found = np.random.default_rng(len(nodes)), [np.empty((2, 0), np.int64)]
    todo = [(np.arange(len(nodes)), 0)]
    while todo:
        rows, depth = todo.pop()
        node = vantage_point(values[rows], radius, rng) if len(rows) > LEAF_ROWS and depth < MOST_DEPTH else None
        if node is not None:
            todo += [(rows[side], depth + 1) for side in sides(values[rows], node, radius)]
        elif len(rows) > 1:
            compare = canopies if len(rows) > 4 * LEAF_ROWS else compare_all
            i, j = compare(values[rows], x[rows], y[rows], radius, accept)
            found.append(np.stack([rows[i], rows[j]]))
    lab = merged(np.arange(len(nodes)), *np.concatenate(found, axis=1))
    away = nodes[lab] != nodes  # a tile can hold a node twice
    return np.stack([nodes[lab][away], nodes[away]], axis=1)


SHARD = "block int, leaf long, n int, points binary"


def _router(trees: list, radius: int, points):
    """A row for each shard that a batch has points of: their nodes, values, x and y as one run of bytes each.

    points(batch) gives node, x, y and a function of the block that gives the values.
    """

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            node, x, y, value = points(batch)
            found = []
            for block, tree in enumerate(trees):
                values = value(block)
                for leaf, rows in route(values, tree, radius):
                    columns = np.stack([node[rows], values[rows].astype(np.int64), x[rows], y[rows]])
                    found.append((block, leaf, len(rows), columns.tobytes()))
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], ["block", "leaf", "n", "points"])

    return run


def _linker(radius: int, accept: int):
    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(p, np.int64).reshape(4, -1) for p in table.column("points").to_pylist()]
        node, value, x, y = np.concatenate(parts, axis=1)
        links = shard_links(node, value.view(np.uint64), x.view(np.uint64), y.view(np.uint64), radius, accept)
        return pa.table({"a": links[:, 0], "b": links[:, 1]})

    return run


def _tiles(routed: DataFrame) -> DataFrame:
    """The rows of each shard, those over SHARD_ROWS points cut into chunks; i, j name the pair of chunks that meet."""
    # The counts are as many as leaves, which the sample bounds.
    large = routed.groupBy("block", "leaf").agg(F.sum("n").alias("k")).where(F.col("k") > SHARD_ROWS)
    large = large.select("block", "leaf", F.ceil(F.col("k") / SHARD_ROWS).cast("int").alias("parts"))
    split = routed.join(F.broadcast(large), ["block", "leaf"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    split = split.withColumn("own", F.pmod(F.xxhash64("points"), F.col("parts")).cast("int"))
    # A chunk meets every chunk, itself included.
    tiles = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return tiles.select("block", "leaf", "points", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _points_of(column: str, fewest: int):
    """A bounded sample for the shards' trees: at most SAMPLE rows and one in SAMPLE_SHARE; none of a small table."""

    def sample(df: DataFrame) -> tuple[list, float]:
        total = df.count()
        if total <= fewest:
            return [], 1.0
        share = min(1 / SAMPLE_SHARE, SAMPLE / total)
        some = df.where(F.pmod(F.xxhash64(column, F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30))).select(column).limit(2 * SAMPLE)
        return [r[0] for r in some.collect()], share

    return sample


def tree_links(points: DataFrame, sample, blocks: int, radius: int, accept: int, batch_points, sample_values, name: str) -> DataFrame:
    """a < b: links that connect what pairs connect that are within ``radius`` in a block and within ``accept``."""
    rows, share = sample(points)
    leaf = max(8, int(SHARD_TARGET * share))
    trees = [build_tree(np.sort(sample_values(rows, b)), leaf, radius) if rows else None for b in range(blocks)]
    routed = cut(points.mapInArrow(_router(trees, radius, batch_points), SHARD), name)
    return _tiles(routed).groupBy("block", "leaf", "i", "j").applyInArrow(_linker(radius, accept), "a long, b long")


def near_links(distinct: DataFrame, radius: int = 3, blocks: int = 2) -> DataFrame:
    """a < b: links whose connected components are those of all pairs of ``distinct.fp`` within ``radius`` bits."""

    def batch_points(batch):
        fps = np.asarray(batch.column(0), np.int64).view(np.uint64)
        return fps.view(np.int64), fps.view(np.int64), np.zeros(len(fps), np.int64), lambda b: block_values(fps, b, blocks)

    values = lambda rows, b: block_values(np.array(rows, np.int64).view(np.uint64), b, blocks)
    return tree_links(distinct.select("fp"), _points_of("fp", SHARD_TARGET), blocks, radius // blocks, radius, batch_points, values, "simhash-shards")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) for every node of ``links``."""
    edges = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    state, total = None, edges.count()
    for _ in range(most_rounds if total else 0):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: every larger neighbour is linked to the smallest neighbour.
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        least, up = cut(least, "links-least"), both.where("b > a")
        if least.agg(F.max("n")).first()[0] > 2 * total // HOT_SHARE + 1:
            hot, rest = counted_join(up, least, ["a"], "n", 2 * total, "inner")
            starred = hot.unionByName(rest)
        else:
            starred = up.join(least, "a")
        large = starred.select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # Small star: the smaller neighbours are linked to the smallest of them. After the large star they are few.
        root = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(root, "b").select(F.col("m"), "a", "b")
        after = small.select(F.col("m").alias("a"), F.col("b")).unionByName(small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        edges = cut(after, "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())
        if now == state:
            break
        state, total = now, now[0]
    else:
        if total:
            raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, blocks: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id for every row; component_id is the smallest id that links lead to."""
    printed = cut(fingerprints(docs, shingle, id_col, text_col), "simhash")
    distinct = cut(printed.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "simhash-distinct")
    member = components(near_links(distinct, radius, blocks))
    # Fingerprints outside all components are their own roots; the others are named by their root's least id.
    grouped = cut(distinct.join(member, distinct["fp"] == member["node"], "left").select("fp", "first_id", "n", "root"), "simhash-roots")
    roots = grouped.select(F.coalesce("root", "fp").alias("r"), "first_id").groupBy("r").agg(F.min("first_id").alias("component_id"), F.count("*").alias("k"))
    sizes = distinct.agg(F.count("*"), F.sum("n")).first()
    hot, rest = counted_join(grouped.select("fp", "n", F.coalesce("root", "fp").alias("r")), roots, ["r"], "k", sizes[0], "inner")
    named = cut(hot.unionByName(rest).select("fp", "n", "component_id"), "simhash-named")
    hot, rest = counted_join(printed, named, ["fp"], "n", sizes[1] or 0, "inner")
    return hot.unionByName(rest).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- Near copies by Jaccard ----------------------------------------------------------------------------------------


def shingle_set(text: str | None, shingle: int) -> set[bytes]:
    """The different shingles of a text, its words cut as simhash() cuts them."""
    words = (text or "").encode().lower().split()
    if len(words) < shingle:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*[words[k:] for k in range(shingle)], strict=False)))


def sketch(shingles: set[bytes], digest) -> np.ndarray:
    """SKETCH_WORDS independent 64-bit SimHashes of a set; each hash is mixed anew for each word."""
    hashes = np.fromiter((digest(s, 42) for s in shingles), np.uint64, len(shingles))
    ones = np.zeros(64 * SKETCH_WORDS, np.int64)
    for at in range(0, len(hashes), 1024):
        x = hashes[at : at + 1024, None] + np.arange(1, SKETCH_WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def _sketcher(shingle: int):
    def run(batches):
        import xxhash

        for batch in batches:
            found = [sketch(shingle_set(t.as_py(), shingle), xxhash.xxh64_intdigest).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["sha", "id", "sketch"])

    return run


def sketch_values(sketches: np.ndarray, block: int) -> np.ndarray:
    """The values of a block of BLOCK_BITS of sketches as rows of bytes."""
    at = BLOCK_BITS * block
    whole = np.zeros((len(sketches), 8), np.uint8)
    part = sketches[:, at // 8 : at // 8 + 8]
    whole[:, : part.shape[1]] = part
    return (whole.view("<u8")[:, 0] >> np.uint64(at % 8)) & np.uint64((1 << BLOCK_BITS) - 1)


def candidate_links(sketches: DataFrame) -> DataFrame:
    """a < b: links that connect what pairs of ``sketches`` (node, sketch) connect that are within BLOCK_RADIUS in a block
    and within CANDIDATE_BITS in the first 128 bits."""

    def as_bytes(rows):
        return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 8 * SKETCH_WORDS)

    def batch_points(batch):
        raw = as_bytes(batch.column(1).to_pylist())
        first = np.ascontiguousarray(raw[:, :16]).view(np.int64)
        return np.asarray(batch.column(0), np.int64), first[:, 0].copy(), first[:, 1].copy(), lambda b: sketch_values(raw, b)

    values = lambda rows, b: sketch_values(as_bytes(rows), b)
    return tree_links(sketches, _points_of("sketch", SHARD_TARGET), SKETCH_BLOCKS, BLOCK_RADIUS, CANDIDATE_BITS, batch_points, values, "near-shards")


def _near(a: set, b: set, similarity: float) -> bool:
    both = len(a & b)
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def jaccard_labels(sets: list[set], similarity: float, pivot: int) -> list[int]:
    """Row numbers that are equal for sets that hang together by pairs of ``similarity``; the pivot meets all sets first,
    and two sets that hang together already aren't compared."""
    up = [pivot if _near(s, sets[pivot], similarity) else k for k, s in enumerate(sets)]

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    ranked = sorted(range(len(sets)), key=lambda k: len(sets[k])) if any(k != pivot for k in up) else []
    for at, p in enumerate(ranked):
        for q in ranked[at + 1 :]:
            if len(sets[p]) < similarity * len(sets[q]) - 1e-9:  # larger ones still less
                break
            i, j = top(p), top(q)
            if i != j and _near(sets[p], sets[q], similarity):
                low, high = (j, i) if j == pivot else (i, j)
                up[high] = low
    return [top(k) for k in range(len(sets))]


def _verifier(shingle: int, similarity: float):
    """Of each chunk: node, the node that names what it hangs together with, and whether it is apart from the pivot."""

    def run(table: pa.Table) -> pa.Table:
        roots, nodes, pivots = (np.asarray(table.column(c)) for c in ("root", "node", "pivot"))
        texts, order = table.column("text"), np.lexsort((nodes, ~pivots, roots))
        found = [np.empty((4, 0), np.int64)]
        for group in np.split(order, np.flatnonzero(np.diff(roots[order])) + 1):
            # A pivot comes first; a whole component in one chunk has none and takes its first row.
            to = jaccard_labels([shingle_set(texts[int(k)].as_py(), shingle) for k in group], similarity, 0)
            has_pivot = len(group) > 0 and bool(pivots[group[0]])
            rows = [(roots[k], nodes[k], nodes[group[t]], int(has_pivot and t != 0)) for k, t in zip(group, to, strict=True) if not pivots[k]]
            found.append(np.array(rows, np.int64).reshape(-1, 4).T)
        root, node, to, apart = np.concatenate(found, axis=1)
        return pa.table({"root": root, "node": node, "to": to, "apart": apart.astype(bool)})

    return run


def _tile_verifier(shingle: int, similarity: float):
    """Links between the rows apart from their pivot and a chunk of all rows; what hangs together already is left out."""

    def run(table: pa.Table) -> pa.Table:
        from bisect import bisect_left, bisect_right

        nodes, to, left = (np.asarray(table.column(c)) for c in ("node", "to", "left"))
        sets = [shingle_set(t.as_py(), shingle) for t in table.column("text")]
        up = {int(k): int(k) for k in to}

        def top(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        right = sorted(np.flatnonzero(~left), key=lambda k: len(sets[k]))
        sizes, links = [len(sets[k]) for k in right], []
        for p in np.flatnonzero(left):
            n = len(sets[p])
            for q in right[bisect_left(sizes, similarity * n - 1e-9) : bisect_right(sizes, n / similarity + 1e-9)]:
                i, j = top(int(to[p])), top(int(to[q]))
                if i != j and _near(sets[p], sets[q], similarity):
                    up[j] = i
                    links.append(sorted((int(nodes[p]), int(nodes[q]))))
        found = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return run


def _parts(rows_of, chars_of):
    """Into how many chunks a component is cut."""
    return F.greatest(F.lit(1), F.ceil(rows_of / VERIFY_ROWS), F.ceil(chars_of / VERIFY_CHARS)).cast("int")


def pivots(rows: DataFrame, large: DataFrame, total: int) -> DataFrame:
    """root, pivot: of each ``large`` component (root, n) the node whose first 128 bits are nearest to the bits that most of
    the component's rows have. An original among its near copies is such a node. The choice never decides the result."""
    heads = [F.conv(F.hex(F.substring("sketch", 4 * k + 1, 4)), 16, 10).cast("bigint").alias(f"h{k}") for k in range(4)]
    hot, rest = counted_join(rows.select("root", "node", *heads), large.select("root", "n"), ["root"], "n", total, "inner")
    bits = [F.sum(F.shiftright(f"h{k}", b).bitwiseAND(F.lit(1))).alias(f"s{k}_{b}") for k in range(4) for b in range(32)]
    counts = hot.unionByName(rest).groupBy("root", "n").agg(*bits)
    most = [sum((F.when(2 * F.col(f"s{k}_{b}") > F.col("n"), 1 << b).otherwise(0).cast("bigint") for b in range(32)), F.lit(0).cast("bigint")).alias(f"m{k}") for k in range(4)]
    middle = cut(counts.select("root", "n", *most), "near-middles")
    hot, rest = counted_join(rows.select("root", "node", *heads), middle, ["root"], "n", total, "inner")
    away = sum((F.bit_count(F.col(f"h{k}").bitwiseXOR(F.col(f"m{k}"))) for k in range(1, 4)), F.bit_count(F.col("h0").bitwiseXOR(F.col("m0"))))
    return hot.unionByName(rest).groupBy("root").agg(F.min_by("node", F.struct(away, F.col("node"))).alias("pivot"))


def verified_links(candidates: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """a, b: links that connect what all pairs of one candidate component (node, root, sketch, text) connect whose exact
    Jaccard is ``similarity`` or more.

    A large component is cut into chunks. Each chunk's rows meet the component's pivot and each other. Two rows that hang
    together with the pivot need not meet; only those apart from it then meet all chunks, in tiles. So the work grows with
    the component's rows times those apart from its pivot, and with its rows alone where the pivot is like them all.
    """
    rows = cut(candidates.withColumn("size", F.length("text")), "near-candidates")
    n, chars = rows.agg(F.count("*"), F.sum("size")).first()
    sizes = rows.groupBy("root").agg(_parts(F.count("*"), F.sum("size")).alias("parts"), F.count("*").alias("n"))
    sizes = cut(sizes, "near-sizes")
    bundles = int(max(n / (8 * VERIFY_ROWS), (chars or 0) / (4 * VERIFY_CHARS))) + 1
    hot, rest = counted_join(rows.drop("sketch"), sizes, ["root"], "n", n, "inner")
    split = hot.unionByName(rest).select("root", "node", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("own"), F.lit(False).alias("pivot"), "text")
    large = sizes.where("parts > 1")
    if large.limit(1).count():
        chosen = large.join(pivots(rows, large, n), "root").select(F.col("pivot").alias("node"), "parts")
        copies = rows.join(chosen, "node").select("root", "node", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("own"), F.lit(True).alias("pivot"), "text")
        split = split.unionByName(copies)
    bundle = F.when(F.col("parts") > 1, F.col("root")).otherwise(-1 - F.pmod(F.xxhash64("root"), F.lit(bundles)))
    first = split.withColumn("bundle", bundle).groupBy("bundle", "own").applyInArrow(_verifier(shingle, similarity), "root long, node long, to long, apart boolean")
    first = cut(first, "near-first")
    links = first.where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b"))
    left = first.where("apart")
    if not left.limit(1).count():
        return links
    # Components with rows apart from their pivot, and into how many chunks those rows are cut.
    facts = left.join(rows.select("node", "size"), "node").groupBy("root").agg(_parts(F.count("*"), F.sum("size")).alias("left_parts"))
    facts = cut(facts.join(sizes, "root"), "near-left")
    hot, rest = counted_join(rows.select("root", "node", "text"), facts, ["root"], "n", n, "inner")
    again = hot.unionByName(rest).join(first.select("node", "to", "apart"), "node")
    own, place = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("left_parts")).cast("int")
    right = F.transform(F.sequence(F.lit(0), F.col("left_parts") - 1), lambda i: F.struct(i.alias("i"), own.alias("j"), F.lit(False).alias("left")))
    lefts = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(place.alias("i"), j.alias("j"), F.lit(True).alias("left")))
    tiles = again.select("root", "node", "to", "text", F.explode(F.when(F.col("apart"), F.concat(right, lefts)).otherwise(right)).alias("t"))
    tiles = tiles.select("root", "node", "to", "text", "t.*")
    return links.unionByName(tiles.groupBy("root", "i", "j").applyInArrow(_tile_verifier(shingle, similarity), "a long, b long"))


def near_components(docs: DataFrame, shingle: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """sha (of the text, null as empty), first_id, n (rows), copies (rows with first_id), root for every different text; texts
    of one root hang together by pairs whose sets of shingles have a Jaccard of ``similarity`` or more."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.sha2(text, 256).alias("sha"), F.col(id_col).alias("id"), text.alias("text"))
    sketched = rows.mapInArrow(_sketcher(shingle), f"sha string, id {docs.schema[id_col].dataType.simpleString()}, sketch binary")
    by_id = sketched.groupBy("sha", "id").agg(F.first("sketch").alias("sketch"), F.count("*").alias("k"))
    least = F.min_by(F.struct("id", "k"), F.struct(F.col("id").isNull(), "id")).alias("least")
    texts = by_id.groupBy("sha").agg(F.first("sketch").alias("sketch"), F.sum("k").alias("n"), least)
    texts = texts.select("sha", "sketch", "n", F.col("least.id").alias("first_id"), F.col("least.k").alias("copies"), F.monotonically_increasing_id().alias("node"))
    texts = cut(texts, "near-texts")
    others = components(candidate_links(texts.select("node", "sketch")))  # all but the roots themselves
    candidates = others.unionByName(others.select(F.col("root").alias("node"), "root").distinct())
    # Only here are texts dealt out, one of each sha.
    named = candidates.join(texts.select("node", "sha", "sketch"), "node")
    verified = rows.groupBy("sha").agg(F.first("text").alias("text")).join(named, "sha").drop("sha")
    member = components(verified_links(verified, shingle, similarity))
    return texts.drop("sketch").join(member, "node", "left").select("sha", "first_id", "n", "copies", F.coalesce("root", "node").alias("root"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the least by id (rows without one last), then text hash.

    Texts are linked where their sets of shingles have a Jaccard of ``similarity`` or more. Candidates are found by
    SimHash, and every link is verified by the texts themselves. Rows that repeat an id and a text count as one.
    """
    named = near_components(docs, shingle, similarity, id_col, text_col)
    order = F.struct(F.col("first_id").isNull(), "first_id", "sha")
    least = named.groupBy("root").agg(F.min_by(F.struct("sha", "first_id", "n", "copies"), order).alias("least"))
    names = {"sha": "__near_sha", "first_id": "__near_first", "n": "__near_n", "copies": "__near_copies"}
    stay = cut(least.select("least.*").withColumnsRenamed(names), "near-stay")
    total, most = stay.agg(F.sum("__near_n"), F.max("__near_copies")).first()
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    parts = counted_join(docs.withColumn("__near_sha", sha), stay, ["__near_sha"], "__near_n", total or 0, "inner")
    kept = [p.where(F.col(id_col).eqNullSafe(F.col("__near_first"))) for p in parts]
    if (most or 0) > 1:  # rows that repeat an id and a text
        kept = [p.dropDuplicates(["__near_sha"]) for p in kept]
    return kept[0].select(*docs.columns).unionByName(kept[1].select(*docs.columns))
