"""SimHash near-duplicates, searched by the generalised pigeonhole principle.

Fingerprint: each shingle of words is hashed by XXH64; a bit is set if it is set in over half of the hashes. Texts with fewer
words than a shingle hash the whole sequence, texts without words (null and empty too) have the fingerprint zero.

Search: the bits are grouped into partitions, correlated bits together. Two fingerprints at most t bits apart are at most e_i
apart in some partition i if the sum of (e_i + 1) is t + 1 (a partition with e_i = -1 isn't probed). The thresholds are chosen
by dynamic programming over estimated costs: rows to shuffle for probing, and candidates to verify, from bit statistics of all
fingerprints. Equal fingerprints are one node. Each node goes to the bucket of its own key and probes those of greater keys at
most e_i away (lesser ones probe it). In buckets, candidates are verified in numpy blocks and only linked to one another's least id, so that a bucket's
output is linear in its rows. A bucket with more than ``block`` nodes is split into a grid of blocks that cover all its pairs.

With ``check_bits``, fingerprints carry a second word of 64 bits and a link must also keep both words' distance within that
bound: this tells apart texts that a wide bound on 64 bits would link by chance.

``near_copies`` takes links as candidates only. It searches both words, so that a pair is lost only if either word is over the
bound, and gathers the shingle sets of each candidate component, in a grid of blocks if it is large. A link counts if the
Jaccard similarity of the two sets reaches the bound.

Components are least ids reachable by links. Rows with one id and text agree, ids may repeat, a null id takes part in no
component but its own text's. Long texts are hashed whole, in blocks. Columns other than id and text aren't read. Empty tables
give empty results. Exact copies share a fingerprint, a hot key of the last join, which shuffles both sides: Spark splits it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, broadcast_if_small, keep, materialize, scratch, texts
from .grouped import components, map_sorted_groups, runs

#: Cost of a shuffled row and of a verified candidate, in microseconds as measured on one core.
ROW_COST, PAIR_COST = 2.6, 0.002
#: Keys have at least this many bits: narrower ones prune little and make large buckets.
LEAST_BITS = 6
BLOCK = 8192
#: Nodes of a block when shingle sets are compared.
SET_BLOCK = 1024


def shingle_hashes(text: str, width: int) -> np.ndarray:
    words = text.encode().lower().split()  # ASCII letters and ASCII space only
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(b" ".join(words), 42)] if words else [], np.uint64)
    return np.fromiter((h(s, 42) for s in map(b" ".join, zip(*(words[i:] for i in range(width))))), np.uint64, len(words) - width + 1)


def _majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; counts in blocks, so that long texts take little memory."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _second(hashes: np.ndarray) -> np.ndarray:
    """Another 64 bits from each hash (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    return np.unique(shingle_hashes(text, width))


def set_digest(hashes: np.ndarray) -> int:
    """Signed hash of a shingle set."""
    return _signed(xxhash.xxh64_intdigest(hashes.tobytes(), 7))


def fingerprints(docs: DataFrame, width: int = 3, distinct: bool = False, text_col: str = "text", id_col: str = "doc_id", digest: bool = False) -> DataFrame:
    """doc_id, fp and fp2: two words of 64 bits as long. distinct: a text's equal shingles count once. digest: also the set's hash."""
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = np.zeros((b.num_rows, 2), np.uint64)
            sets = np.zeros(b.num_rows, np.int64)
            for k, t in enumerate(texts(b)):
                h = shingle_set(t, width) if distinct or digest else shingle_hashes(t, width)
                if len(h):
                    both[k] = _majority(h), _majority(_second(h))
                    sets[k] = set_digest(h) if digest else 0
            cols = [b.column(0), *(pa.array(both[:, k].view(np.int64)) for k in (0, 1)), *([pa.array(sets)] if digest else [])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "fp", "fp2", "digest"][: len(cols)])

    return slim.mapInArrow(run, "doc_id long, fp long, fp2 long" + (", digest long" if digest else ""))


# --- partitions and thresholds ---


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    radius: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)

    def flips(self) -> list[int]:
        """Masks of all changes of at most radius bits; none comes first."""
        out = [0]
        for _ in range(self.radius):
            out = sorted({f | 1 << b for f in out for b in self.bits} | set(out))
        return out


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often each two bits are set together (64 x 64), over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, joint = 0, np.zeros((64, 64))
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy().astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n += len(x)
            joint += x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(np.append(joint.ravel(), n))], ["k", "v"])

    sums = {r.k: r.v for r in fps.select("fp").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}  # 4097 rows
    return int(sums.get(4096, 0)), np.array([sums.get(k, 0.0) for k in range(4096)]).reshape(64, 64)


def group_bits(n: int, joint: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """m groups of nearly equal size; a group grows by the bit that is most correlated with it."""
    p = np.diag(joint) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(joint / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, groups = list(range(64)), []
    for k in range(m):
        group = [left.pop(0)]
        while len(group) < ceil((64 - sum(map(len, groups))) / (m - k)):
            group.append(left.pop(int(np.argmax(corr[np.ix_(group, left)].mean(0)))))
        groups.append(tuple(sorted(group)))
    return groups


def near_probability(p: np.ndarray, most: int) -> np.ndarray:
    """Probability that two fingerprints differ in at most 0, 1, .. most of the bits that are set with probability p."""
    dist = np.zeros(most + 1)
    dist[0] = 1
    for q in 2 * p * (1 - p):
        dist = dist * (1 - q) + np.append(0, dist[:-1]) * q
    return np.cumsum(dist)


def allocate(n: int, joint: np.ndarray, threshold: int, widest: int = 2) -> list[Part]:
    """Partitions and thresholds of least estimated cost for a search at this threshold."""
    p = np.diag(joint) / max(n, 1)
    best: tuple[float, list[Part]] = (float("inf"), [])
    for m in range(1, min(threshold + 1, 64 // LEAST_BITS) + 1):
        groups = group_bits(n, joint, m)
        # state: sum of (radius + 1) so far -> (cost, radii)
        state = {0: (0.0, ())}
        for g in groups:
            near = near_probability(p[list(g)], widest)
            cost = [0.0]
            rows = 0.0
            for r in range(min(widest, len(g)) + 1):
                rows += _choose(len(g), r) / (2 if r else 1)  # of two different keys one probes the other
                cost.append(ROW_COST * rows + PAIR_COST * n * (near[0] + near[r]) / 2)
            grown: dict[int, tuple[float, tuple]] = {}
            for total, (c, radii) in state.items():
                for step, more in enumerate(cost):
                    t = min(threshold + 1, total + step)
                    if t not in grown or c + more < grown[t][0]:
                        grown[t] = (c + more, (*radii, step - 1))
            state = grown
        c, radii = state.get(threshold + 1, (float("inf"), ()))
        if c < best[0]:
            best = (c, [Part(g, r) for g, r in zip(groups, radii) if r >= 0])
    return best[1]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


# --- search ---


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def find_links(nodes: DataFrame, parts: list[Part], threshold: int, check_bits: int | None, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that connect all nodes (node, fp, fp2) within the threshold; nodes must be materialized."""
    top = lambda f: 1 << f.bit_length() - 1 if f else 0
    probes = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(_signed(p.mask)).alias("mask"), F.lit(_signed(f)).alias("flip"), F.lit(_signed(top(f))).alias("top")) for i, p in enumerate(parts) for f in p.flips()])
    # The greater of two keys has the highest changed bit set: the lesser one probes it.
    probes = F.filter(probes, lambda p: F.col("fp").bitwiseAND(p["top"]) == 0)
    rows = nodes.select("node", "fp", "fp2", F.explode(probes).alias("p"))
    rows = rows.select("node", "fp", "fp2", F.xxhash64("p.i", F.col("fp").bitwiseAND(F.col("p.mask")).bitwiseXOR(F.col("p.flip"))).alias("key"), (F.col("p.flip") == 0).alias("own"))
    # Keys with many nodes are split into a grid: those that own the key by those that probe it.
    sizes = rows.groupBy("key").agg(F.count_if("own").alias("a"), F.count(F.lit(1)).alias("b")).where(f"a > 0 and b > {block}")
    hot = broadcast_if_small(materialize(sizes.select("key", F.ceil(F.col("a") / block).cast("int").alias("na"), F.ceil(F.col("b") / block).cast("int").alias("nb"))))
    rows = rows.join(hot, "key", "left")
    turn = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "fp", "fp2"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda a, b, role: F.struct(a.alias("a"), b.alias("b"), F.lit(role).alias("role"))
    zero = F.lit(0)
    probing = F.transform(every("na"), lambda a: cell(a, turn("nb", 2), 1))
    owning = F.transform(every("nb"), lambda b: cell(turn("na", 1), b, 2))
    cells = F.when(F.col("na").isNull(), F.array(F.when(F.col("own"), cell(zero, zero, 0)).otherwise(cell(zero, zero, 1)))).when(F.col("own"), F.concat(probing, owning)).otherwise(probing)
    placed = rows.select("node", "fp", "fp2", "key", F.explode(cells).alias("c")).select(F.xxhash64("key", "c.a", "c.b").alias("cell"), F.col("c.role").cast("byte").alias("role"), "node", "fp", "fp2")

    def work(t: pa.Table) -> pa.Table | None:
        at = runs(t["cell"].to_numpy())
        role, node = t["role"].to_numpy(), t["node"].to_numpy()
        fp, fp2 = (t[c].to_numpy().view(np.uint64) for c in ("fp", "fp2"))
        us, vs = [], []
        for s, e in zip(at[:-1], at[1:]):
            if e - s > 1:
                u, v = link_cell(node[s:e], fp[s:e], fp2[s:e], role[s:e], threshold, check_bits)
                us.append(u)
                vs.append(v)
        return pa.table({"u": np.concatenate(us), "v": np.concatenate(vs)}) if us else None

    return map_sorted_groups(placed, "cell", [], work, "u long, v long")


def link_cell(node: np.ndarray, fp: np.ndarray, fp2: np.ndarray, role: np.ndarray, threshold: int, check_bits: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Links between probing (role 0 or 1) and owning (0 or 2) nodes of a cell, as edges to each linked set's least id."""
    a, b = np.flatnonzero(role < 2), np.flatnonzero(role != 1)
    if not len(a) or not len(b):
        return node[:0], node[:0]
    label = np.unique(node, return_inverse=True)[1]
    ids = np.unique(node)
    root = np.arange(len(ids))  # of each node, the least member of its set
    for at in range(0, len(a), 256):
        mine = a[at : at + 256]
        near = np.bitwise_count(fp[mine][:, None] ^ fp[b][None, :])
        match = near <= threshold
        if check_bits is not None:
            r, c = np.nonzero(match)
            match[r, c] = near[r, c].astype(int) + np.bitwise_count(fp2[mine[r]] ^ fp2[b[c]]) <= check_bits
        for k in np.flatnonzero(match.sum(1) > (role[mine] == 0)):
            sets = np.unique(np.append(root[label[b[match[k]]]], root[label[mine[k]]]))
            if len(sets) > 1:
                root[np.isin(root, sets)] = sets[0]
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def near_duplicates(docs: DataFrame, width: int = 3, threshold: int = 3, check_bits: int | None = None, distinct: bool = False, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, fp, fp2 and component_id, one row per document."""
    fps = materialize(fingerprints(docs, width, distinct, text_col, id_col))
    of = ["fp", "fp2"] if check_bits is not None else ["fp"]
    # Fingerprints alone don't hold the second word of the least id's text when only the first counts.
    nodes = fps.groupBy(*of).agg(F.min("doc_id").alias("node"))
    nodes = materialize(nodes if check_bits is not None else nodes.withColumn("fp2", F.lit(0).cast("long")))
    known = nodes.where("node is not null").select("node", "fp", "fp2")
    with scratch():
        found = keep(materialize(components(find_links(known, allocate(*bit_statistics(known), threshold), threshold, check_bits))))
    named = nodes.join(found, "node", "left").select(*of, F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, of).select("doc_id", "fp", "fp2", "component_id")


# --- exact similarity ---


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two shingle sets (ascending) have at least this Jaccard similarity."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def verify_cell(node: np.ndarray, fp: np.ndarray, fp2: np.ndarray, role: np.ndarray, sets: list[np.ndarray], check_bits: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of a cell as link_cell has them, of pairs within check_bits whose sets are alike. Linked pairs aren't compared again."""
    a, b = np.flatnonzero(role < 2), np.flatnonzero(role != 1)
    ids, label = np.unique(node, return_inverse=True)
    root = np.arange(len(ids))
    for at in range(0, len(a), 256):
        mine = a[at : at + 256]
        apart = np.bitwise_count(fp[mine][:, None] ^ fp[b][None, :]).astype(np.int16) + np.bitwise_count(fp2[mine][:, None] ^ fp2[b][None, :])
        match = apart <= check_bits
        for k in np.flatnonzero(match.sum(1) > (role[mine] == 0)):
            i, others = mine[k], b[match[k]]
            for j in others[root[label[others]] != root[label[i]]].tolist():
                u, v = root[label[i]], root[label[j]]
                if u != v and alike(sets[i], sets[j], similarity):
                    root[root == max(u, v)] = min(u, v)
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def verify_links(docs: DataFrame, nodes: DataFrame, loose: DataFrame, width: int, check_bits: int, similarity: float, block: int = SET_BLOCK) -> DataFrame:
    """Edges (u, v) that connect all alike nodes (node, fp, fp2, digest) of one loose component. docs: doc_id and text."""
    sizes = loose.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(f"n > {block}")
    hot = broadcast_if_small(materialize(sizes.select("component", F.ceil(F.col("n") / block).cast("int").alias("nb"))))
    placed = nodes.join(loose, "node").join(hot, "component", "left").select("component", F.coalesce("nb", F.lit(1)).alias("nb"), "node", "fp", "fp2", "digest")
    placed = broadcast_if_small(materialize(placed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [shingle_set(t, width) for t in texts(part)]
                own = part.column(5).to_pylist()
                kept = pa.array([k for k, (h, d) in enumerate(zip(sets, own)) if (set_digest(h) if len(h) else 0) == d], pa.int32())
                held = pa.array([h.tobytes() for h in sets], pa.binary()).take(kept)
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(kept) for k in range(5)), held], ["component", "nb", "node", "fp", "fp2", "shingles"])

    rows = docs.join(placed, docs["doc_id"] == placed["node"]).select("component", "nb", "node", "fp", "fp2", "digest", "text")
    rows = rows.mapInArrow(run, "component long, nb int, node long, fp long, fp2 long, shingles binary")
    mine = F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")
    role = lambda j: F.when(j == mine, 0).when(j > mine, 1).otherwise(2).cast("byte")
    cells = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(F.least(j, mine).alias("a"), F.greatest(j, mine).alias("b"), role(j).alias("role")))
    spread = rows.withColumn("c", F.explode(cells)).select(F.xxhash64("component", "c.a", "c.b").alias("cell"), "c.role", "node", "fp", "fp2", "shingles")

    def work(t: pa.Table) -> pa.Table | None:
        at = runs(t["cell"].to_numpy())
        role, node, held = t["role"].to_numpy(), t["node"].to_numpy(), t["shingles"]
        fp, fp2 = (t[c].to_numpy().view(np.uint64) for c in ("fp", "fp2"))
        us, vs = [], []
        for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
            sets = [np.frombuffer(x, np.uint64) for x in held.slice(s, e - s).to_pylist()]
            u, v = verify_cell(node[s:e], fp[s:e], fp2[s:e], role[s:e], sets, check_bits, similarity)
            us.append(u)
            vs.append(v)
        return pa.table({"u": np.concatenate(us), "v": np.concatenate(vs)}) if us else None

    return map_sorted_groups(spread, "cell", [], work, "u long, v long")


def near_copies(docs: DataFrame, width: int, threshold: int, check_bits: int, similarity: float, text_col: str = "text", id_col: str = "doc_id", block: int = SET_BLOCK) -> DataFrame:
    """doc_id and component_id, one row per document: linked are texts whose sets of shingles have this Jaccard similarity."""
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    fps = materialize(fingerprints(slim, width, distinct=True, digest=True))
    of = ["fp", "fp2", "digest"]
    nodes = materialize(fps.groupBy(*of).agg(F.min("doc_id").alias("node")))
    known = nodes.where("node is not null").select("node", *of)
    sides = [known.select("node", F.col(x).alias("fp"), F.col(y).alias("fp2")) for x, y in (("fp", "fp2"), ("fp2", "fp"))]
    with scratch():
        edges = [materialize(find_links(x, allocate(*bit_statistics(x), threshold), threshold, check_bits)) for x in sides]
        loose = materialize(components(edges[0].unionByName(edges[1]), few=BROADCAST_ROWS))
        found = keep(materialize(components(verify_links(slim, known, loose, width, check_bits, similarity, block), few=BROADCAST_ROWS)))
    named = nodes.join(found, "node", "left").select(*of, F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, of).select("doc_id", "component_id")
