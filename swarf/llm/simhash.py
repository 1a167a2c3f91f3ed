"""SimHash near-dedup by a binary trie self-join.

Fingerprints are taken in Arrow batches. Distinct fingerprints form a binary trie; its top levels are cut into subtrees,
and pairs of subtrees whose prefixes differ within the error budget meet in one task. There the two subtrees are
traversed together, node pair by node pair, adding up differing bits and dropping a pair once the budget is exceeded. A
task returns a spanning forest of the links it found, never all pairs; connected components join the forests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swarf.llm.common import components, document, stage, unstage
from swarf.shipping import ship

#: Fingerprints aimed at in a subtree, and the deepest cut.
SUBTREE, DEEPEST = 1024, 22
#: Node pairs expanded at once; node pairs of so few key pairs are compared key by key instead.
FRONTIER, SMALL = 1 << 18, 96


def shingles(text: str | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of all word shingles, of the whole sequence if that is shorter; none without words."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and the six ASCII spaces alone
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)] * bool(words), np.uint64)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def majority(h: np.ndarray) -> np.ndarray:
    """From n rows of 64-bit words: the words whose bits are 1 where over half of the rows have a 1."""
    ones = np.zeros(h.shape[1] * 64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, h.shape[1] * 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<u8")


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over all word shingles; 0 without words."""
    return int(majority(shingles(text, width, seed)[:, None])[0])


#: 64-bit words of the fingerprint that tables are made from, and of the one that their candidates are told apart by.
WIDE, WIDEST = 4, 16


def wide_fingerprint(h: np.ndarray, n: int = WIDE) -> bytes:
    """SimHash of a set of distinct hashes in n words of 64 bits, mixed from each hash; zeros if it is empty."""
    with np.errstate(over="ignore"):
        z = h[:, None] + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return majority(z).tobytes()


def with_fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, wide: bool = False) -> DataFrame:
    """uid, doc_id, fp (a signed long, or 32 bytes if wide) and the whole input row."""
    ship(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), document(docs).alias("row"))
    schema = T.StructType([T.StructField("uid", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("fp", T.BinaryType() if wide else T.LongType()), rows.schema["row"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if wide:
                fps = pa.array([wide_fingerprint(np.unique(shingles(t.as_py(), width, seed))) for t in b.column("text")], pa.binary())
            else:
                fps = pa.array(np.array([fingerprint(t.as_py(), width, seed) for t in b.column("text")], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), fps, b.column("row")], ["uid", "doc_id", "fp", "row"])

    return rows.mapInArrow(run, schema)


def join_subtrees(x: np.ndarray, y: np.ndarray, same: bool, depth: int, start: list[tuple[int, int, int, int, int]], budget: int, bits: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted distinct x and y (the same array if `same`) within `budget` bits, in chunks.

    start: node pairs (from, to, from, to, differing bits) at `depth`. A node is a range of a sorted array; its children
    part where the next bit turns 1; leaves lie `bits` deep. A node paired with itself (same, equal ranges) gives one mixed pair of children.
    """
    stack = [(depth, np.array(start, np.int64).reshape(-1, 5).T)]
    while stack:
        level, f = stack.pop()
        if f.shape[1] > FRONTIER:
            half = f.shape[1] // 2
            stack += [(level, f[:, :half]), (level, f[:, half:])]
            continue
        few = (f[1] - f[0]) * (f[3] - f[2]) <= SMALL
        yield from _compared(x, y, same, f[:4, few], budget)
        a, b, c, d, e = f[:, ~few]
        if level == bits or not len(a):
            yield (a, c)
            continue
        bit = np.uint64(1) << np.uint64(63 - level)
        keep = ~((bit << np.uint64(1)) - np.uint64(1)) if level else np.uint64(0)
        m, n = np.searchsorted(x, (x[a] & keep) | bit), np.searchsorted(y, (y[c] & keep) | bit)
        m, n = np.clip(m, a, b), np.clip(n, c, d)
        itself = (a == c) & same
        parts = [(a, m, c, n, e), (m, b, n, d, e), (a, m, n, d, e + 1), (m, b, c, n, e + 1)]
        out = []
        for k, (p, q, r, s, t) in enumerate(parts):
            ok = (p < q) & (r < s) & (t <= budget)
            if k == 3:
                ok &= ~itself
            if same and k < 2:
                ok &= ~((p == r) & (q - p == 1))  # a leaf with itself
            out.append(np.stack([v[ok] for v in (p, q, r, s, t)]))
        grown = np.concatenate(out, axis=1)
        if grown.shape[1]:
            stack.append((level + 1, grown))


def _compared(x: np.ndarray, y: np.ndarray, same: bool, f: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the budget among the keys of small node pairs."""
    step = max(1, 4 * FRONTIER // SMALL)
    for k in range(0, f.shape[1], step):
        a, b, c, d = f[:, k : k + step]
        n = (b - a) * (d - c)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(d - c, n)
        i, j = np.repeat(a, n) + at // wide, np.repeat(c, n) + at % wide
        ok = np.bitwise_count(x[i] ^ y[j]) <= budget
        if same:
            ok &= (i < j) | np.repeat(a != c, n)
        yield i[ok], j[ok]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n nodes the least node that it is linked with, directly or not."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root[root] != root).any():
                root = root[root]
    return root


def node_pairs(x: np.ndarray, y: np.ndarray, depth: int, budget: int, bits: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the budget, of the distinct keys x of one subtree, and of x with the keys y of others after x."""
    yield from join_subtrees(x, x, True, depth, [(0, len(x), 0, len(x), 0)], budget, bits)
    if len(y):
        top = lambda k: k >> np.uint64(64 - depth)
        tops, first = np.unique(top(y), return_index=True)
        apart = np.bitwise_count(tops ^ top(x[0])).tolist()
        start = list(zip([0] * len(tops), [len(x)] * len(tops), first.tolist(), [*first[1:].tolist(), len(y)], apart, strict=True))
        for a, c in join_subtrees(x, y, False, depth, start, budget, bits):
            yield a, c + len(x)


def links_at(depth: int, budget: int):
    """The applyInPandas function for one subtree (home rows) and the parts of others that visit it."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        fp = group["fp"].to_numpy().view(np.uint64)
        home = group["home"].to_numpy()
        x, y = np.sort(fp[home]), np.sort(fp[~home])
        root = forest(len(x) + len(y), node_pairs(x, y, depth, budget)) if len(x) else np.arange(0)
        linked = np.flatnonzero(root != np.arange(len(root)))
        both = np.concatenate([x, y]).view(np.int64)
        return pd.DataFrame({"a": both[linked], "b": both[root[linked]]})

    return run


def trie_links(fps: DataFrame, budget: int = 2, subtree: int = SUBTREE) -> DataFrame:
    """Links (a, b) of distinct fingerprints `fp`, whose components are those of all pairs within `budget` bits.

    The cut is as deep as needed for subtrees of about `subtree` fingerprints, and deeper while one holds over eight times
    that; what is still larger at the deepest cut is dealt to tasks in pairs of blocks. Each fingerprint goes to its own subtree
    and, of each pair of subtrees within the budget, to the one that a fixed mixing of the prefixes puts first, so that half of
    the neighbours are visited and work is even.
    """
    ship(fps.sparkSession)
    n = fps.count()
    prefix = lambda depth: F.shiftrightunsigned("fp", 64 - depth)
    largest = lambda depth: fps.groupBy(prefix(depth).alias("p")).count().agg(F.max("count")).first()[0] or 0
    depth = min(DEEPEST, max(4, math.ceil(math.log2(max(n, 1) / subtree))))
    while (hot := largest(depth) > 8 * subtree) and depth < DEEPEST:
        depth = min(DEEPEST, depth + 2)
    far = visits(fps.withColumn("p", prefix(depth)), depth, budget)
    if hot:
        far = in_blocks(far.select(F.lit(0).alias("tab"), F.col("fp").alias("id"), "fp", "subtree", "home"), 32 * subtree)
        return far.groupBy("subtree", "block").applyInPandas(links_at(depth, budget), "a long, b long")
    return far.groupBy("subtree").applyInPandas(links_at(depth, budget), "a long, b long")


def visits(keys: DataFrame, depth: int, budget: int) -> DataFrame:
    """Each row with the subtrees that it goes to, by its prefix `p` of `depth` bits: adds subtree and home."""
    masks = [0] + [1 << i for i in range(depth)] * (budget >= 1) + [1 << i | 1 << j for i in range(depth) for j in range(i)] * (budget >= 2)
    mixed = lambda c: ((c * 2654435761) % (1 << depth))
    far = keys.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
    far = far.withColumn("subtree", F.col("p").bitwiseXOR(F.col("mask"))).withColumn("home", F.col("mask") == 0)
    return far.where(F.col("home") | (mixed(F.col("subtree")) < mixed(F.col("p"))))


def near_dedup(docs: DataFrame, budget: int = 2, width: int = 3, seed: int = 42, subtree: int = SUBTREE) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, kept, row (the whole input row).

    component_id is the smallest doc_id within reach, so null only where all of them are. Null, empty and blank texts have
    fingerprint zero and link like any other; very long ones are read whole. Of each component one row is kept, that of the smallest doc_id (nulls last),
    the first of repeated rows. An empty table gives an empty result.
    """
    if not 0 <= budget <= 2:
        raise ValueError("the cut of the trie allows for a budget of 0 to 2 bits")
    rows = stage(with_fingerprints(docs, width, seed), "fingerprints")
    classes = stage(by_class(rows).withColumn("id", F.col("fp")), "classes")
    out = kept(rows, classes, components(trie_links(classes.select("fp"), budget, subtree)))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "kept", "row")


def by_class(rows: DataFrame) -> DataFrame:
    """fp, least (doc_id, then row, of those that share it)."""
    return rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "uid")).alias("least"))


def kept(rows: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with component_id and kept, from classes (fp, id, least) and the roots of linked ids."""
    linked = classes.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = stage(linked.groupBy("root").agg(F.min("least").alias("first")), "roots")  # staged, so that a hot root can be split
    found = linked.join(first, "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.uid").alias("keep_uid"))
    return rows.join(stage(found, "components"), "fp").withColumn("kept", F.col("uid") == F.col("keep_uid"))


#: Chance to find a pair just at the similarity asked for, before its fingerprints are compared.
FOUND = 0.99
#: Added to the share of differing bits: small sets of even size have more ties (measured over unions of 6 to 60 shingles).
TIES = 0.011
#: Candidates that a row is held against in each round, the nearest first, before all that are still apart are compared; and
#: the rows of one key that are all compared in those rounds. Of more, each is held against the first and its next ones alone,
#: and goes on to the last round whether one of these is near or not, so that it meets all of its key there.
STARS, ALL_OF_A_KEY = (2, 6), 4096
#: Keys aimed at in a subtree of one table; a subtree of over HOT times as many is dealt to tasks in blocks, and so is one with
#: over ONE_KEY keys that are equal in their first bits, as these are compared each with each.
TABLE, HOT, ONE_KEY = 1 << 18, 2, 1 << 15
#: Bytes of keys, about, that are dealt to subtrees at once; of more, some tables come after the others (one at a time at least).
AT_ONCE = 1 << 30
#: In place of the bits that differ: behind any candidate.
LAST = 1 << 20


def apart(similarity: float) -> float:
    """The share of bits that differ between SimHashes of sets of one size with that Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def tables(n: int, similarity: float) -> tuple[int, int]:
    """(bits of a key, number of tables): random pairs stay in proportion to n, and FOUND of those alike meet in a table."""
    bits, p = min(60, max(12, math.ceil(math.log2(max(n, 2))) + 6)), apart(similarity) + TIES
    meet = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(3))
    return bits, max(1, math.ceil(math.log(1 - FOUND) / math.log(1 - meet)))


def positions(table: int, bits: int) -> np.ndarray:
    """The bits of a fingerprint, of its first 256, that make up the key of a table."""
    return np.random.default_rng([17, table]).choice(256, bits, replace=False)


def key_at(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The key that the bits at these positions make up, from the bytes of fingerprints as rows; its first bit is the highest."""
    key = np.zeros((len(flat), 64), np.uint8)
    key[:, : len(at)] = flat[:, at >> 3] >> (at & 7).astype(np.uint8) & 1
    return np.packbits(key, axis=1).view(">u8").ravel().astype(np.uint64)


def keys_of(bits: int, some: range):
    """The mapInArrow function from (id, fp, ...) to (tab, key, id, fp, ...), one row for each of these tables."""
    where = [(t, positions(t, bits)) for t in some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(b.num_rows, -1)[:, : 8 * WIDE] if b.num_rows else np.zeros((0, 8 * WIDE), np.uint8)
            for t, at in where:
                key = key_at(flat, at).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), t, np.int32)), pa.array(key), *b.columns], ["tab", "key", *b.schema.names])

    return run


def by_parts(keys: DataFrame, depth: int, bits: int) -> DataFrame:
    """Each row once for each of the first three parts of `depth` bits of its key (once without depth): adds subtree, by the number and
    the bits of the part, and turns key so that these come first. Keys within two bits have one of the three parts in common, so
    they meet, and however many subtrees there are, a row goes to three.
    """
    turned = lambda k: F.shiftleft("key", k * depth).bitwiseOR(F.shiftleft(F.shiftrightunsigned("key", 64 - k * depth), 64 - bits)) if k else F.col("key")
    parts = [F.struct((F.shiftrightunsigned(turned(k), 64 - depth) + (k << depth)).alias("subtree"), turned(k).alias("key")) for k in range(3)] if depth else [F.struct(F.lit(0).cast("long").alias("subtree"), F.col("key"))]
    return keys.withColumn("part", F.explode(F.array(*parts))).select(*[c for c in keys.columns if c != "key"], "part.*")


def alike_at(depth: int, bits: int, limit: int, give: str = "forest", pick: int = 0, similarity: float = 0.0, places: np.ndarray | None = None):
    """The applyInPandas function for one subtree of one table: rows whose fingerprints differ in few bits.

    forest gives links (a, b) with the components of all such pairs. The others leave out pairs of one `comp`, and pairs
    whose sets can't be that similar by their sizes and how many of their shingles other sets have (`common`): stars gives of
    each row a the `pick` nearest b with the bits that differ, and a itself (off LAST) if its key holds more rows than are all compared
    then; all gives every pair; with `places` (table by bit, 1 where its key has the bit) only in the first table in which the
    pair meets. Rows without a `key` have that of their table, made again from the fingerprint; without `comp` each is a
    component of its own, and nothing is known of the sets. Subtrees are those of by_parts(), where a pair is given by the
    first part that it has in common; with `home` they are those of visits().
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        words = np.frombuffer(b"".join(group["fp"]), np.uint64).reshape(len(group), -1)
        part = int(group["subtree"].iloc[0]) >> depth if "subtree" in group and "home" not in group else 0
        key = group["key"].to_numpy().view(np.uint64) if "key" in group else key_at(np.ascontiguousarray(words[:, :WIDE]).view(np.uint8), np.roll(positions(int(group["tab"].iloc[0]), bits), -part * depth))
        earlier = [np.uint64(((1 << depth) - 1) << (64 - bits + k * depth)) for k in range(part)]  # parts that were in front, now behind
        home, ids = group["home"].to_numpy() if "home" in group else np.ones(len(group), bool), group["id"].to_numpy()
        order = np.lexsort((ids, key, ~home))  # those at home first, keys unsigned
        key, ids, mine = key[order], ids[order], int(home.sum())
        words, comp, sizes, common = words[order], None, None, None
        if give != "forest":
            comp, sizes, common = (group[c].to_numpy()[order] for c in ("comp", "size", "common")) if "comp" in group else (ids, *np.ones((2, len(ids)), np.int64))
        x, fx = np.unique(key[:mine], return_index=True)
        y, fy = np.unique(key[mine:], return_index=True)
        first = np.concatenate([fx, fy + mine])
        many = np.diff(np.concatenate([fx, fy + mine, [len(key)]]))

        def near(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            off = np.bitwise_count(words[a] ^ words[b]).sum(1, dtype=np.int64)
            ok = off <= limit
            if comp is not None:
                ok &= (comp[a] != comp[b]) & ((1 + similarity) * np.minimum(common[a], common[b]) >= similarity * (sizes[a] + sizes[b]) - 1e-6)
            return a[ok], b[ok], off[ok]

        def across(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for i in range(0, len(left), step := max(1, FRONTIER // max(1, len(right)))):
                part = left[i : i + step]
                yield near(np.repeat(part, len(right)), np.tile(right, len(part)))

        def within(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """Rows of one key."""
            if give == "all":  # those of one component need no link: each component's rows against those of the ones after it
                rows = rows[np.argsort(comp[rows], kind="stable")]
                begins = np.flatnonzero(np.diff(comp[rows], prepend=comp[rows[0]] - 1))
                if 4 * len(begins) < len(rows):
                    for i, j in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                        yield from across(rows[i:j], rows[j:])
                    return
            if give == "all" or give == "stars" and len(rows) <= ALL_OF_A_KEY:
                for i in range(0, len(rows), step := max(1, FRONTIER // len(rows))):
                    a, b, off = near(np.repeat(rows[i : i + step], len(rows)), np.tile(rows, len(rows[i : i + step])))
                    yield a[a < b], b[a < b], off[a < b]
                return
            if give == "stars":
                for ahead in (*range(1, 33), 0):
                    yield near(rows[:-ahead], rows[ahead:]) if ahead else near(np.full(len(rows) - 1, rows[0]), rows[1:])
                return
            a, b, off = near(np.full(len(rows) - 1, rows[0]), rows[1:])  # those near the first are one already
            yield a, b, off
            yield from across(np.setdiff1d(rows[1:], b), rows)

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for k in np.flatnonzero(many[: len(x)] > 1).tolist() if not part else ():
                yield from within(np.arange(first[k], first[k] + many[k]))
            both = np.concatenate([x, y])
            for a, b in node_pairs(x, y, depth, 2, bits):
                if part:
                    new = np.all([(both[a] ^ both[b]) & bits_of != 0 for bits_of in earlier], axis=0)
                    a, b = a[new], b[new]
                small = many[a] * many[b] == 1
                yield near(first[a[small]], first[b[small]])
                for i, j in zip(a[~small].tolist(), b[~small].tolist(), strict=True):
                    yield from across(np.arange(first[i], first[i] + many[i]), np.arange(first[j], first[j] + many[j]))

        found = pairs() if mine else iter(())
        if give == "forest":
            root = forest(len(key), ((a, b) for a, b, _ in found))
            linked = np.flatnonzero(root != np.arange(len(root)))
            return pd.DataFrame({"a": ids[linked], "b": ids[root[linked]]})
        if give == "all":
            if places is not None:
                found = (seldom(words, a, b, places[: int(group["tab"].iloc[0])]) for a, b, _ in found)
            both = [np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])], 1) for a, b, *_ in found if len(a)]
            both = np.unique(np.concatenate(both), axis=0) if both else np.zeros((0, 2), np.int64)
            return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})
        crowd = ids[:mine][np.repeat((many[: len(x)] > ALL_OF_A_KEY) & (not part), many[: len(x)])]
        best, held, size = np.zeros((3, 0), np.int64), [], 0
        for a, b, off in found:
            held += [np.stack([a, b, off]), np.stack([b, a, off])] if len(a) else []
            size += 2 * len(a)
            if size > 4 * FRONTIER:
                best, held, size = nearest(np.concatenate([best, *held], axis=1), pick), [], 0
        a, b, off = nearest(np.concatenate([best, *held], axis=1), pick)
        more = np.full(len(crowd), LAST)
        return pd.DataFrame({"a": np.concatenate([ids[a], crowd]), "b": np.concatenate([ids[b], crowd]), "off": np.concatenate([off, more])})

    return run


def seldom(words: np.ndarray, a: np.ndarray, b: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose keys are over two bits apart in each of the earlier tables, so that no other has given them."""
    off = np.unpackbits(np.ascontiguousarray(words[a, :WIDE] ^ words[b, :WIDE]).view(np.uint8).reshape(-1, 8 * WIDE), axis=1, bitorder="little")
    new = (off.astype(np.float32) @ earlier.T > 2.5).all(1)
    return a[new], b[new]


def nearest(found: np.ndarray, pick: int) -> np.ndarray:
    """Of pairs (a, b, bits that differ) as columns the `pick` nearest of each a, by b where these tie."""
    found = found[:, np.lexsort((found[1], found[2], found[0]))]
    twice = np.zeros(found.shape[1], bool)
    twice[1:] = (found[:2, 1:] == found[:2, :-1]).all(0)
    found = found[:, ~twice]
    place = np.arange(found.shape[1])
    starts = np.flatnonzero(np.diff(found[0], prepend=-1)) if found.shape[1] else place
    rank = place - np.repeat(starts, np.diff([*starts.tolist(), len(place)]))
    return found[:, rank < pick]


def in_blocks(keys: DataFrame, most: int, bits: int = 0) -> DataFrame:
    """Adds block to rows (tab, subtree, key, id, ...): subtrees of over `most` rows are cut into blocks of about half of that, and
    such as hold over ONE_KEY keys with the same first `bits` (if any) into blocks of half as many; each row goes to one task
    for each pair of blocks that has its own, so every two rows of a subtree still meet, whatever its size.
    """
    finer = keys.groupBy("tab", "subtree", *[F.shiftrightunsigned("key", 64 - bits).alias("first")] * (bits > 0)).agg(F.count("*").alias("n"))
    hot = finer.groupBy("tab", "subtree").agg(F.sum("n").alias("n"), F.max(F.when(F.lit(bits > 0), F.col("n")).otherwise(0)).alias("equal")).where((F.col("n") > most) | (F.col("equal") > ONE_KEY))
    hot = stage(hot.select("tab", "subtree", F.ceil(2 * F.col("n") / F.when(F.col("equal") > ONE_KEY, min(most, ONE_KEY)).otherwise(most)).alias("blocks")), "hot")
    if not hot.take(1):
        return keys.withColumn("block", F.lit(0).cast("long"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    pairs = lambda b: F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda other: F.least(b, other) * F.col("blocks") + F.greatest(b, other)))
    return keys.join(hot, ["tab", "subtree"], "left").withColumn("block", F.explode(pairs(own))).drop("blocks")


def shingle_sets(texts: DataFrame, width: int, seed: int) -> DataFrame:
    """From (id, text): id, hashes (of the distinct shingles, sorted), fp (of WIDEST words; its first ones are those of WIDE)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(i, 500) for i in range(0, big.num_rows, 500)):
                sets = [np.unique(shingles(t.as_py(), width, seed)) for t in b.column("text")]
                fps = pa.array([wide_fingerprint(h, WIDEST) for h in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([h.tobytes() for h in sets], pa.binary()), fps], ["id", "hashes", "fp"])

    return texts.mapInArrow(run, "id long, hashes binary, fp binary")


def set_sizes(sets: DataFrame) -> DataFrame:
    """id, fp, size, common: the shingles of each set, and how many of them other sets have as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(i, 500) for i in range(0, big.num_rows, 500)):
                flat = [np.frombuffer(v.as_buffer(), np.int64) for v in b.column("hashes")]
                ids = np.repeat(b.column("id").to_numpy(), [len(v) for v in flat])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([*flat, np.zeros(0, np.int64)]))], ["id", "h"])

    alone = sets.mapInArrow(run, "id long, h long").groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").groupBy("id").agg(F.count("*").alias("alone"))
    size = (F.octet_length("hashes") / 8).cast("int")
    return sets.select("id", "fp", size.alias("size")).join(alone, "id", "left").select("id", "fp", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).cast("int").alias("common"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the distinct pairs (a, b) those whose sets have that Jaccard similarity or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both / max(1, len(x) + len(y) - both) >= similarity)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = stage(pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a"), "half-pairs")  # staged, so that a hot row can be split in both joins
    two = one.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")
    out = stage(two.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "verified")
    unstage(one)
    return out


def similar_dedup(docs: DataFrame, similarity: float = 0.8, width: int = 5, seed: int = 42, slack: int = 18, subtree: int = TABLE) -> DataFrame:
    """As near_dedup, for texts whose sets of word shingles are that similar: doc_id, component_id, kept, row.

    Such texts differ in more bits than a trie can afford to allow for. So 256 bits are taken (1024 of those that have a first
    candidate), a number of tables hold a few
    of them each, the trie of each table is joined with itself within two bits, and the pairs it finds are candidates if they
    differ in no more bits than the share expected at that similarity, plus `slack` (three standard deviations). A candidate
    pair is linked if its sets of shingles themselves are that similar. Each row is held against its nearest candidates first,
    which joins most of a large group of copies; then all candidates are compared that are still in different components and
    that may be similar enough by the shingles which they have for themselves. Texts
    with equal fingerprints count as alike. So do null, empty and blank ones; very long texts are one sorted set of hashes, and
    of repeated rows one is kept. An empty table gives an empty result.
    """
    rows = stage(with_fingerprints(docs, width, seed, wide=True), "wide-fingerprints")
    classes = stage(by_class(rows).withColumn("id", F.col("least.uid")), "classes")
    n = classes.count()
    bits, count = tables(n, similarity)
    depth = min(bits // 3, max(0, math.ceil(math.log2(max(n, 1) / subtree))))
    limit = lambda n: round(64 * n * (apart(similarity) + TIES) + slack * math.sqrt(n / WIDE))  # noqa: E731  bits, of n words

    places = np.zeros((count, 64 * WIDE), np.float32)
    for t in range(count):
        places[t, positions(t, bits)] = 1

    def candidates(of: DataFrame, rows_of: int, give: str, pick: int, schema: str) -> DataFrame:
        words = WIDEST if "comp" in of.columns else WIDE
        known = [c for c in ("comp", "size", "common") if c in of.columns]

        def found(some: range) -> DataFrame:
            row = of.select("id", "fp", *known)
            keys = row.mapInArrow(keys_of(bits, some), T.StructType([T.StructField("tab", T.IntegerType()), T.StructField("key", T.LongType()), *row.schema]))
            keys = in_blocks(by_parts(keys, depth, bits), HOT * subtree, min(bits, depth + 4)).drop("key")  # the fingerprint has it
            return keys.groupBy("tab", "subtree", "block").applyInPandas(alike_at(depth, bits, limit(words), give, pick, similarity, places), schema)

        step = max(1, AT_ONCE // max(1, rows_of * (3 if depth else 1) * (8 * words + 24)))
        if step >= count:
            return found(range(count))
        return reduce(DataFrame.unionByName, [stage(found(range(t, min(t + step, count))), "found") for t in range(0, count, step)])

    of, sets, seen, links, roots = classes, None, None, None, None
    for turn, pick in enumerate((*STARS, 0)):
        if pick:
            ends = candidates(of, n, "stars", pick, "a long, b long, off long").groupBy("a").agg(F.collect_set(F.struct("off", "b")).alias("b"))  # at most pick from each table
            ends = stage(ends.select("a", F.slice(F.sort_array("b"), 1, pick)["b"].alias("b")), "stars")
            pairs = ends.select("a", F.explode("b").alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        else:
            pairs = candidates(of, n, "all", 0, "a long, b long")
        pairs = pairs.distinct()
        pairs = stage(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"), "pairs")
        if sets is None:  # whoever has a candidate at all is in the first stars, or in a key too full to say; the others go no further
            some = stage(ends.select(F.col("a").alias("id")), "candidates")
            sets = stage(shingle_sets(rows.select(F.col("uid").alias("id"), F.col("row.text").alias("text")).join(some, "id"), width, seed), "shingle-sets")
            of = stage(set_sizes(sets), "candidate-classes")
            n = of.count()
        good = verified(pairs, sets, similarity)
        seen, links = (pairs, good) if seen is None else (seen.unionByName(pairs), links.unionByName(good))
        roots = components(links)
        if pick:
            of = stage(of.drop("comp").join(roots.select(F.col("node").alias("id"), F.col("root").alias("comp")), "id", "left").withColumn("comp", F.coalesce("comp", "id")), "candidate-components")
    unstage(sets)
    return kept(rows, classes, roots).select("doc_id", "component_id", "kept", "row")
