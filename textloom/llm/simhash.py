"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints: texts lower-cased in A-Z, words split at ASCII white space, word shingles
hashed by XXH64 with seed 42; a bit is 1 if it is set in over half of the hashes. Repeated
shingles count each time, unless a similarity of shingle sets decides: then once.

Links: distinct fingerprints are put into the buckets of several tables, each table
being a mask of bits. With the masks of ``pigeonhole_masks`` every pair within the
radius shares a bucket, so the links are exact. Buckets are compared in blocks: the
fingerprints' bits are stored as vertical planes, the distances of one fingerprint to
64 others per machine word are kept in carry-save counters (ones, twos, fours, ...),
and after every eight planes the rows whose lanes have all passed the radius are
abandoned. A block emits its links if they are few for each row, else a spanning forest.
Where links need a similarity as well, the forest names the components of candidates, and
all pairs inside a component count that the forest's verified edges have not joined.
A bucket larger than ``HEAVY`` is cut into salted parts. Each part is compared with itself
first; then part with part, in separate tasks, where components of the first round still
differ, so that the links listed stay in proportion to the nodes.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like
any other; texts of fewer words than a shingle are one shingle; equal fingerprints are
one node, however many rows have them; rows with a null id take part, but name a
component only if no row of it has an id (then it is null); an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import forget, small, small_batches, stored, tidied
from textloom.llm.components import connected_components

HEAVY = 1024
PACK = 256
#: How much farther than the radius second fingerprints may be apart.
SECOND_MORE = 3
#: Links of a block that are listed, per row; a denser block lists a spanning forest.
PAIRS_PER_ROW = 2
#: Texts in a block of verified pairs, in each direction.
BLOCK_TEXTS = 128
#: Rows without an id get numbers from here on, one each; real ids are smaller.
NO_ID = 2**62


# --- fingerprints ------------------------------------------------------------------------


def shingle_digests(text: str | None, words: int) -> np.ndarray:
    """(n, 8) bytes, big-endian XXH64 digests of all shingles, repeats included."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros((0, 8), np.uint8)
    joined, digest = b" ".join(parts), xxhash.xxh64_digest
    if len(parts) <= words:
        return np.frombuffer(digest(joined, 42), np.uint8).reshape(1, 8)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    stop = np.cumsum(size + 1) - 1
    first = (stop - size)[: len(parts) - words + 1].tolist()
    return np.frombuffer(b"".join([digest(joined[i:j], 42) for i, j in zip(first, stop[words - 1 :].tolist())]), np.uint8).reshape(-1, 8)


def _majority(digests: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for k in range(0, len(digests), 1 << 14):
        ones += np.unpackbits(digests[k : k + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(digests)).tobytes(), "big")


def fingerprint(text: str | None, words: int = 4) -> int:
    """Unsigned 64-bit SimHash of a text."""
    digests = shingle_digests(text, words)
    return _majority(digests) if len(digests) else 0


def distinct(digests: np.ndarray) -> np.ndarray:
    """The digests without repeats."""
    return np.unique(digests.copy().view(">u8").ravel()).view(np.uint8).reshape(-1, 8)


def both_fingerprints(text: str | None, words: int = 4) -> tuple[int, int]:
    """The SimHash of the set of shingles, and a second one from other bits (the digests mixed)."""
    digests = distinct(shingle_digests(text, words))
    if not len(digests):
        return 0, 0
    h = digests.copy().view(">u8").astype(np.uint64).ravel()
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return _majority(digests), _majority(h.view(np.uint8).reshape(-1, 8))


def fingerprints(docs: DataFrame, words: int = 4, second: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp: the fingerprint as a signed long, fp2: the second one, or 0).

    With ``second`` both are those of the distinct shingles, and rows without an id carry their ``text``."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "fp", "fp2", "text"][: 4 if second else 3]

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = np.array([both_fingerprints(t, words) if second else (fingerprint(t, words), 0) for t in texts], np.uint64).reshape(-1, 2).view(np.int64)
            columns = [batch.column(0), pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())]
            if second:
                columns.append(pa.array([t if i is None else None for i, t in zip(batch.column(0).to_pylist(), texts)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidied(run), "doc_id long, fp long, fp2 long" + (", text string" if second else ""))


# --- bit-sliced comparison ---------------------------------------------------------------


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, ceil(n / 64)) words: plane b holds bit b of all fingerprints, a lane each."""
    n = -(-len(fps) // 64) * 64
    bits = np.zeros((n, 64), np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _add(a, b, c):
    """Carry-save adder: sum and carry of three words."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def compare(queries: np.ndarray, fps: np.ndarray, radius: int):
    """Pairs (i, j, distance) with queries[i] and fps[j] within ``radius`` bits."""
    planes = bit_planes(fps)
    width = planes.shape[1]
    rows = np.arange(len(queries))
    masks = np.where(np.unpackbits(queries.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(bool), ~np.uint64(0), np.uint64(0))
    levels = max(3, radius.bit_length())
    count = [np.zeros((len(queries), width), np.uint64) for _ in range(levels)]
    over = np.full((len(queries), width), 0, np.uint64)
    if len(fps) % 64:
        over[:, -1] = ~np.uint64(0) << np.uint64(len(fps) % 64)  # lanes without a fingerprint
    for b in range(0, 64, 8):
        x = [planes[b + k][None, :] ^ masks[:, b + k][:, None] for k in range(8)]
        count[0], a1 = _add(count[0], x[0], x[1])
        count[0], a2 = _add(count[0], x[2], x[3])
        count[1], b1 = _add(count[1], a1, a2)
        count[0], a1 = _add(count[0], x[4], x[5])
        count[0], a2 = _add(count[0], x[6], x[7])
        count[1], b2 = _add(count[1], a1, a2)
        count[2], carry = _add(count[2], b1, b2)
        for k in range(3, levels):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        above, equal = over, ~over
        for k in reversed(range(levels)):
            if radius >> k & 1:
                equal = equal & count[k]
            else:
                above = above | (equal & count[k])
                equal = equal & ~count[k]
        alive = (above != ~np.uint64(0)).any(axis=1)
        if not alive.any():
            return np.zeros((3, 0), np.int64)
        if not alive.all():
            rows, masks, over, above = rows[alive], masks[alive], over[alive], above[alive]
            count = [c[alive] for c in count]
    hit, lane = np.nonzero(np.unpackbits((~above).view(np.uint8), axis=1, bitorder="little"))
    distance = np.zeros(len(hit), np.int64)
    for k in range(levels):
        distance += ((count[k][hit, lane >> 6] >> (lane & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << k
    return np.stack([rows[hit], lane, distance])


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Indices of the edges of a minimum spanning forest (Boruvka, ties by index)."""
    if len(a) < 2:
        return np.arange(len(a))
    comp, kept = np.arange(n), []
    key = weight * len(a) + np.arange(len(a))
    while True:
        live = np.flatnonzero(comp[a] != comp[b])
        if not len(live):
            return np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.int64)
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, comp[a[live]], key[live])
        np.minimum.at(best, comp[b[live]], key[live])
        chosen = np.unique(best[best != np.iinfo(np.int64).max] % len(a))
        kept.append(chosen)
        parent = list(range(n))

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(comp[a[chosen]].tolist(), comp[b[chosen]].tolist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        comp = np.array([root(x) for x in range(n)])[comp]


def block_links(fps: np.ndarray, others: np.ndarray, side: np.ndarray, own: np.ndarray, radius: int, second: int | None):
    """Links (i, j, distance) of one block; rows of side 1 are compared with side 0 only.

    Rows of one ``own`` are joined already: between two of them one link is enough. With ``second``, the second fingerprints (``others``) have to be that near too. All links
    are listed if they are few for each row, else a spanning forest, nearest first.
    """
    above = side > 0
    if above.any():
        i0, j0 = np.flatnonzero(~above), np.flatnonzero(above)
        i, j, d = compare(fps[i0], fps[j0], radius)
        i, j = i0[i], j0[j]
    else:
        i, j, d = compare(fps, fps, radius)
        up = i < j
        i, j, d = i[up], j[up], d[up]
    apart = own[i] != own[j]
    i, j, d = i[apart], j[apart], d[apart]
    if second is not None:
        more = np.bitwise_count(others[i] ^ others[j]).astype(np.int64)
        near = more <= second
        i, j, d = i[near], j[near], (d + more)[near]
    if above.any() or len(i) > PAIRS_PER_ROW * len(fps):
        _, group_of = np.unique(own, return_inverse=True)
        keep = spanning_forest(int(group_of.max()) + 1, group_of[i], group_of[j], d)
        i, j, d = i[keep], j[keep], d[keep]
    return i, j, d


# --- tables and buckets ------------------------------------------------------------------


def pigeonhole_masks(n: int, radius: int, bits: int = 64) -> list[int]:
    """Masks such that fingerprints within ``radius`` bits agree on one of them entirely.

    Of ``b`` pieces of the fingerprint at least ``b - radius`` are equal, so each choice of
    that many pieces is a table. The number of pieces is the cheapest for ``n`` fingerprints.
    """

    def cost(b):
        return math.comb(b, radius) * (64 + n / 2 ** (bits * (b - radius) // b))

    b = min(range(radius + 1, radius + 6), key=cost)
    edge = [bits * k // b for k in range(b + 1)]
    piece = [((1 << edge[k + 1]) - 1) ^ ((1 << edge[k]) - 1) for k in range(b)]
    return [sum(piece[k] for k in pick) for pick in combinations(range(b), b - radius)]


def sampled_masks(n: int, similarity: float, recall: float = 0.99, bits: int = 64, seed: int = 42) -> list[int]:
    """Masks of random bits: two texts of that Jaccard similarity share a bucket with
    probability ``recall``. Bits per mask follow the number of fingerprints, so that a bucket
    has about half a block's rows at any size; the number of masks follows from both."""
    agree = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    k = max(8, math.ceil(math.log2(max(n, 2) / PACK)) + 1)
    count = math.ceil(math.log(1 - recall) / math.log(1 - agree**k))
    draw = np.random.default_rng(seed)
    return [sum(1 << int(b) for b in draw.choice(bits, k, replace=False)) for _ in range(count)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame, rows: int, masks: list[int], radius: int, second: int | None = None) -> DataFrame:
    """Edges (a, b, distance) between nodes (node, fp, fp2), ``rows`` of them, with fingerprints
    within ``radius`` (and second ones within ``second``)."""
    keyed = nodes.select("node", "fp", "fp2", F.explode(F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(masks)])).alias("bucket"))
    # rows are counted by a short hash of the bucket first, which partial sums keep small; exact
    # counts are made only where such a count is high
    short = F.pmod("bucket", F.lit(max(1 << 12, rows * len(masks) // 128))).alias("short")
    high = stored(keyed.groupBy(short).agg(F.count("*").alias("n")).where(F.col("n") > HEAVY).select("short"), "simhash-high")
    some = high.limit(1).count() > 0
    if some:
        counted = keyed.select("bucket", short).join(high, "short", "left_semi").groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY)
        heavy = stored(counted.select("bucket", F.ceil(F.col("n") / HEAVY).cast("int").alias("parts")), "simhash-heavy")
    here = lambda df, block, own, side: _linked(df.select("node", "fp", "fp2", block.alias("block"), own.alias("own"), side.cast("byte").alias("side")), radius, second)
    if not some:
        return stored(here(keyed, F.col("bucket"), F.col("node"), F.lit(0)), "simhash-edges")
    part = F.pmod(F.xxhash64("fp", F.lit(7)), F.coalesce("parts", F.lit(1))).cast("int")
    cut = keyed.join(heavy, "bucket", "left").withColumn("part", part)
    block = F.when(F.col("parts").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", "part"))
    first = stored(here(cut, block, F.col("node"), F.lit(0)), "simhash-edges")
    # part against part, between components only: what the first round has joined needs no link
    joined = connected_components(first, "simhash-first")
    known = nodes.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("own"))
    rest = stored(cut.where("parts IS NOT NULL").join(known, "node"), "simhash-parts")
    apart = lambda df, by: df.join(df.groupBy(by).agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high").select(by), by, "left_semi")
    dealt = apart(rest, "bucket").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("part <> other")
    dealt = dealt.withColumn("block", F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")))
    dealt = stored(dealt.select("node", "fp", "fp2", "block", "own", F.when(F.col("part") > F.col("other"), 1).otherwise(0).alias("side")), "simhash-dealt")
    across = stored(here(apart(dealt, "block"), F.col("block"), F.col("own"), F.col("side")), "simhash-across")
    for done in (rest, dealt):
        forget(done)
    return first.unionByName(across)


def _linked(blocks: DataFrame, radius: int, second: int | None) -> DataFrame:
    """Links (a, b, distance) of the rows (node, fp, fp2, block, own, side) of each block: rows of side 1
    meet side 0 only, and rows of one ``own`` need no link."""

    def run(batches):
        held: list[np.ndarray] = []
        size = 0

        def work(rows):
            block, node, fp, side, fp2, own = rows
            edges = []
            start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            stop = np.concatenate([start[1:], [len(block)]])
            many = stop - start > 1
            start, stop = start[many], stop[many]
            k = 0
            while k < len(start):
                e = k + 1
                if stop[k] - start[k] <= PACK and not side[start[k] : stop[k]].any():
                    total = int(stop[k] - start[k])  # small buckets share a block: more pairs are compared, none are missed
                    while e < len(start) and total + stop[e] - start[e] <= PACK and not side[start[e] : stop[e]].any():
                        total += int(stop[e] - start[e])
                        e += 1
                at = np.concatenate([np.arange(i, j) for i, j in zip(start[k:e].tolist(), stop[k:e].tolist())])
                _, first = np.unique(node[at], return_index=True)
                if side[at].any():
                    first = np.arange(len(at))
                at = at[first]
                i, j, d = block_links(fp[at].view(np.uint64), fp2[at].view(np.uint64), side[at], own[at], radius, second)
                if len(i):
                    edges.append(np.stack([node[at[i]], node[at[j]], d]))
                k = e
            if edges:
                a, b, d = np.concatenate(edges, axis=1)
                pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), d]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in pair], ["a", "b", "distance"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6)]))
            size += batch.num_rows
            if size >= 1 << 18:
                rows = np.concatenate(held, axis=1)
                whole = int(np.flatnonzero(rows[0] != rows[0, -1])[-1]) + 1 if (rows[0] != rows[0, -1]).any() else 0
                yield from work(rows[:, :whole]) if whole else ()
                held, size = [rows[:, whole:]], rows.shape[1] - whole
        if held:
            yield from work(np.concatenate(held, axis=1))

    return blocks.select("block", "node", "fp", "side", "fp2", "own").repartition("block").sortWithinPartitions("block").mapInArrow(tidied(run), "a long, b long, distance long")


def group(docs: DataFrame, words: int = 4, radius: int = 4, similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every document.

    Without ``similarity`` all fingerprints within ``radius`` bits are linked. With it,
    such pairs are candidates if a second fingerprint agrees, and a link also needs that
    Jaccard similarity of the texts' shingle sets.
    """
    strict = similarity is not None
    prints = stored(fingerprints(docs, words, strict).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID) + F.monotonically_increasing_id())), "simhash-fps")
    nodes = stored(prints.groupBy("fp", "fp2").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    n = nodes.count()
    masks = sampled_masks(n, similarity) if strict else pigeonhole_masks(n, radius)
    edges = links(nodes, n, masks, radius, radius + SECOND_MORE if strict else None)
    if strict:
        # rows without an id are known by their number, which only ``prints`` has
        named = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        named = named.unionByName(prints.where(F.col("doc_id") >= NO_ID).select("doc_id", "text"))
        edges = verified(named, edges.select("a", "b").distinct(), words, similarity)
    found = connected_components(edges, "simhash")
    classes = stored(nodes.join(found, "node", "left").select("fp", "fp2", F.coalesce("component", "node").alias("component_id")), "simhash-classes")
    for done in (edges, nodes):
        forget(done)
    null = lambda c: F.when(F.col(c) < NO_ID, F.col(c)).alias(c)
    return prints.join(classes, ["fp", "fp2"]).select(null("doc_id"), "fp", null("component_id"))


def shingle_sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """(block, id, hashes) for (block, id) in ``members``: the sorted shingle hashes of that text."""
    small_batches(docs.sparkSession)

    def sets(batches):
        for batch in batches:
            found = [np.unique(shingle_digests(t, words).copy().view(">u8").astype("<u8").ravel()).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "hashes"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(small(members.select("id").distinct()), "id", "left_semi")
    return texts.mapInArrow(tidied(sets), "id long, hashes binary").join(small(members), "id")


def verified(docs: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Edges (a, b) of ids whose texts' shingle sets have that Jaccard similarity. They have the
    components of all such pairs inside the components of ``pairs``, which may be a forest.

    Pairs are dealt to blocks by their component, large components cut in both directions,
    so that a text's set is sent once to each block that needs it and not once per pair.
    """
    pairs = stored(pairs, "simhash-candidates")
    candidates = connected_components(pairs, "simhash-candidates")
    sizes = candidates.groupBy("component").agg(F.ceil(F.count("*") / BLOCK_TEXTS).cast("int").alias("parts"))
    of = stored(candidates.join(sizes, "component"), "simhash-candidate-components")
    part = lambda c: F.pmod(F.xxhash64(c, F.lit(3)), F.col("parts")).cast("int")
    blocked = pairs.join(of, pairs["a"] == of["node"]).select(F.xxhash64("component", part("a"), part("b")).alias("block"), "a", "b")
    blocked = stored(blocked, "simhash-blocks")
    members = stored(blocked.select("block", F.col("a").alias("id")).union(blocked.select("block", F.col("b").alias("id"))).distinct(), "simhash-members")
    rows = shingle_sets(docs, members, words).select("block", F.lit(0).alias("kind"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "hashes")
    rows = rows.unionByName(blocked.select("block", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("hashes")))

    def judge(batches):
        now, held = None, {}
        for batch in batches:  # by block, sets before pairs
            good = []
            for block, kind, a, b, x in zip(*(batch.column(k) for k in range(5))):
                block, a = block.as_py(), a.as_py()
                if block != now:
                    now, held = block, {}
                if kind.as_py() == 0:
                    x = x.as_py()
                    held[a] = max(x, held[a], key=bytes) if a in held else x  # an id that repeats: one text stands for it
                else:
                    b = b.as_py()
                    x, y = np.frombuffer(held[a], "<u8"), np.frombuffer(held[b], "<u8")
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    union = len(x) + len(y) - both
                    if union == 0 or both >= similarity * union - 1e-9:
                        good.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in good], pa.int64()) for k in range(2)], ["a", "b"])

    sure = stored(rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(tidied(judge), "a long, b long"), "simhash-sure")
    # a forest's edges may fail where other pairs of the component pass: test what is not joined yet
    joined = connected_components(sure, "simhash-sure").select("node", F.col("component").alias("own"))
    nodes = of.join(joined, "node", "left").select("node", "component", "parts", F.coalesce("own", "node").alias("own"))
    nodes = stored(nodes, "simhash-joined")
    open_ = nodes.groupBy("component").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high").select("component")
    dealt = nodes.join(open_, "component", "left_semi").withColumn("part", part("node")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(
        F.xxhash64("component", F.least("part", "other"), F.greatest("part", "other")).alias("block"),
        F.col("node").alias("id"),
        "own",
        F.when(F.col("part") > F.col("other"), 1).otherwise(0).cast("byte").alias("side"),
        (F.col("part") != F.col("other")).alias("cut"),
    )
    dealt = stored(dealt, "simhash-dealt")
    mixed = dealt.groupBy("block").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high").select("block")
    rest = stored(dealt.join(mixed, "block", "left_semi"), "simhash-rest")

    def complete(batches):
        now, held = None, {}
        for batch in batches:
            for block, a, own, side, cut, x in zip(*(c.to_pylist() for c in batch.columns)):
                if block != now:
                    yield from missing(held)
                    now, held = block, {}
                held[a] = (max(x, held[a][0]) if a in held else x, own, side, cut)
        yield from missing(held)

    def missing(held):
        if len(held) < 2:
            return
        ids, (x, own, side, cut) = np.array(list(held), np.int64), (list(c) for c in zip(*held.values()))
        i, j = similar_pairs([np.frombuffer(h, "<u8") for h in x], np.array(own, np.int64), np.array(side), cut[0], similarity)
        keep = spanning_forest(len(ids), i, j, np.zeros(len(i), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ids[i[keep]]), pa.array(ids[j[keep]])], ["a", "b"])

    rows = shingle_sets(docs, rest, words).select("block", "id", "own", "side", "cut", "hashes")
    more = rows.repartition("block").sortWithinPartitions("block").mapInArrow(tidied(complete), "a long, b long")
    return stored(sure.unionByName(more), "simhash-verified")


def similar_pairs(sets: list[np.ndarray], own: np.ndarray, side: np.ndarray, cut: bool, similarity: float):
    """Pairs (i, j) of one block, not of one ``own`` yet, whose sets have that Jaccard similarity;
    in a ``cut`` block only pairs of both sides."""
    size = np.array([len(s) for s in sets])
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    stop = np.cumsum(size)
    owner = np.repeat(np.arange(len(sets)), size)
    mark = np.zeros(int(number.max()) + 1 if len(number) else 0, bool)
    pairs = []
    for i in range(len(sets)):
        mark[number[stop[i] - size[i] : stop[i]]] = True
        both = np.bincount(owner[stop[i] :][mark[number[stop[i] :]]], minlength=len(sets))
        mark[number[stop[i] - size[i] : stop[i]]] = False
        good = (both >= similarity * (size + size[i] - both) - 1e-9) & (own != own[i]) & (np.arange(len(sets)) > i)
        if cut:
            good &= side != side[i]
        j = np.flatnonzero(good)
        pairs.append(np.stack([np.full(len(j), i), j]))
    return np.concatenate(pairs, axis=1)


def representatives(docs: DataFrame, words: int = 5, radius: int = 15, similarity: float = 0.8) -> DataFrame:
    """The documents that stay: of each group the one with the smallest id (whole rows).

    Rows without an id all stay; of rows that repeat an id one stays.
    """
    classes = group(docs, words, radius, similarity)
    gone = stored(classes.where("doc_id <> component_id").select("doc_id").distinct(), "simhash-gone")
    kept = docs.where("doc_id IS NOT NULL").join(small(gone), "doc_id", "left_anti")
    if classes.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id IS NULL"))
