"""SimHash near duplicates, found through vantage-point trees.

Two fingerprints within 3 bits differ by at most 1 bit in one 32-bit half, and
Hamming distance on a half is a metric.  So each half has a vantage-point tree:
a node splits its points at a radius around a vantage point, and by the triangle
inequality only points on the two rings next to that radius can have partners
on the other side.  Every fingerprint is a native of one leaf and a visitor of
the leaves that its ring membership cannot exclude.  Leaves are compared
exactly on all 64 bits.  On the whole 64 bits the same tree would need a slack
of 3, which excludes almost nothing because distances crowd around 32.

The trees are fitted on a bounded sample of fingerprints (``sample``); every
fingerprint is routed.  A leaf above ``block`` rows is cut into blocks, and each
pair of blocks is one task, so no task grows with the data and no pair is lost.
A task returns a spanning forest of what it has linked.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from profuse.llm.common import attach, join_checked
from profuse.llm.components import components, merge
from profuse.llm.setlinks import links_in_buckets
from profuse.session import stored

SEED = 42
SHINGLE = 3
DISTANCE = 3
SLACK = 1
PIECE = 1 << 22
BITS_AT_ONCE = 1 << 15
SET_SHINGLE = 5
BANDS, BAND_ROWS = 16, 4
SETS_AT_ONCE = 1024
ROWS_AT_ONCE = 256
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: An odd factor and a mask per minimum of the signature.
MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 64, (BANDS * BAND_ROWS, 2), dtype=np.uint64) | np.array([1, 0], dtype=np.uint64)


def _hash_counts(found: list, counts: np.ndarray) -> None:
    values = np.array(found, dtype="<u8")
    for k in range(0, len(values), BITS_AT_ONCE):
        bits = np.unpackbits(values[k:k + BITS_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)


def _shingle_hashes(words: list, shingle: int) -> list:
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], SEED) for s, e in zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())]


def shingle_hashes(text: str | None, shingle: int):
    """Lists of the hashes of a text's shingles; the whole text is one if it has fewer words, none if it has no word.

    The text is ASCII-lower-cased and worked through in pieces cut at white space.
    """
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    seen, carry, at = False, [], 0
    while at < len(raw):
        cut = _SPACE.search(raw, at + PIECE) if len(raw) - at > PIECE else None
        end = cut.start() if cut else len(raw)
        carry += raw[at:end].split()
        at = end
        if len(carry) >= shingle:
            seen = True
            yield _shingle_hashes(carry, shingle)
            carry = carry[len(carry) - shingle + 1:]
    if carry and not seen:
        yield [xxhash.xxh64_intdigest(b" ".join(carry), SEED)]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a text; 0 if it has no word."""
    counts, seen = np.zeros(64, dtype=np.int64), 0
    for found in shingle_hashes(text, shingle):
        seen += len(found)
        _hash_counts(found, counts)
    return sum(1 << k for k in np.flatnonzero(2 * counts > seen).tolist())


def _fingerprint_batches(batches):
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        found = np.fromiter((fingerprint(t.as_py()) for t in texts), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(found.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """The key columns and ``fp``, the fingerprint as a signed long."""
    rows = docs.select(*keys, F.col(text).cast("string").alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["fp long"])
    return rows.mapInArrow(_fingerprint_batches, schema)


def shingle_set(text: str | None, shingle: int = SET_SHINGLE) -> np.ndarray:
    """Distinct hashes of the shingles, ascending."""
    parts = [np.unique(np.array(x, dtype=np.uint64)) for x in shingle_hashes(text, shingle)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def band_keys(found: np.ndarray) -> list[int]:
    """One key per band of the min-hash signature of a set; none for an empty set."""
    if not len(found):
        return []
    odd, mask = MULTIPLIERS[:, :1], MULTIPLIERS[:, 1:]
    least = np.full(len(odd), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(found), SETS_AT_ONCE):
        mixed = (found[None, k:k + SETS_AT_ONCE] ^ mask) * odd
        mixed ^= mixed >> np.uint64(31)
        mixed *= odd
        least = np.minimum(least, mixed.min(axis=1))
    rows = least.reshape(BANDS, -1)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(rows)]


def _map_texts(docs: DataFrame, text: str, keys: tuple, of, kind: str, arrow: pa.DataType) -> DataFrame:
    """The key columns and ``found``, a function of the text."""
    rows = docs.select(*keys, F.col(text).cast("string").alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [f"found {kind}"])

    def run(batches):
        for batch in batches:
            values = [of(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, arrow)], names=[*batch.schema.names[:-1], "found"])

    return rows.mapInArrow(run, schema)


def similar_links(docs: DataFrame, key: str, text: str, similarity: float, shingle: int = SET_SHINGLE, block: int = 256) -> DataFrame:
    """Forest (a, b) over the keys of rows whose shingle sets have Jaccard ``similarity`` or more.

    Candidates share a band of the signature: 16 bands of 4 minima miss a pair at
    0.8 once in 4,600.  Each candidate pair is compared exactly, except inside
    what is already linked (``setlinks``).  Copies are one text.
    """
    marked = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("t")).where("id is not null and t is not null")
    marked = marked.withColumn("mark", F.xxhash64("t"))
    keys = _map_texts(marked, "t", ("id", "mark"), lambda t: band_keys(shingle_set(t, shingle)), "array<long>", pa.list_(pa.int64()))
    texts = keys.groupBy("mark").agg(F.min_by("found", "id").alias("found"), F.min("id").alias("node"))
    bands = stored(texts.select("mark", "node", F.posexplode("found").alias("band", "bucket")), "bands")

    def sets_of(wanted: DataFrame) -> DataFrame:
        # One row per text, though its key and text may be repeated.
        few = join_checked(marked, wanted.toDF("mark", "id"), ["mark", "id"], "inner")
        return _map_texts(few, "t", ("mark",), lambda t: shingle_set(t, shingle).tobytes(), "binary", pa.binary()).dropDuplicates(["mark"])

    return links_in_buckets(bands, sets_of, similarity, block)


class Tree:
    """Vantage-point tree over 32-bit values, as flat arrays; a negative child -1 - k is leaf k."""

    def __init__(self, points: np.ndarray, population: int, leaf_rows: int, seed: int) -> None:
        self.vantage, self.radius, self.inner, self.outer, self.leaves = [], [], [], [], 0
        rng = np.random.default_rng(seed)
        enough = max(8.0, leaf_rows * len(points) / max(population, 1))
        slots = [(points, None)]
        self.root = None
        while slots:
            mine, link = slots.pop()
            split = self._split(mine, rng) if len(mine) > enough else None
            if split is None:
                name, self.leaves = -1 - self.leaves, self.leaves + 1
            else:
                name = len(self.vantage)
                vantage, radius, near = split
                self.vantage.append(vantage)
                self.radius.append(radius)
                self.inner.append(None)
                self.outer.append(None)
                slots += [(mine[near], (self.inner, name)), (mine[~near], (self.outer, name))]
            if link is None:
                self.root = name
            else:
                link[0][link[1]] = name

    @staticmethod
    def _split(points, rng):
        """The candidate vantage point and radius with the fewest pairs left to compare."""
        best = None
        for vantage in points[rng.integers(0, len(points), 12)]:
            far = np.bitwise_count(points ^ vantage)
            rings = np.bincount(far, minlength=34) / len(points)
            below = np.cumsum(rings)
            for radius in range(32):
                inside = below[radius]
                if 0.05 < inside < 0.95:
                    cost = inside ** 2 + (1 - inside) ** 2 + rings[radius] * (1 - inside)
                    if best is None or cost < best[0]:
                        best = cost, vantage, radius, far <= radius
        return best[1:] if best else None

    def route(self, values: np.ndarray):
        """(row, leaf, visitor) of every visit that the triangle bounds cannot exclude."""
        visits = []
        stack = [(self.root, np.arange(len(values)), np.zeros(len(values), dtype=bool))]
        while stack:
            name, rows, visitor = stack.pop()
            if not len(rows):
                continue
            if name < 0:
                visits.append((rows, np.full(len(rows), -1 - name, dtype=np.int32), visitor))
                continue
            far = np.bitwise_count(values[rows] ^ self.vantage[name]).astype(np.int16)
            radius = self.radius[name]
            near = far <= radius
            into = near | (visitor & (far - SLACK <= radius))
            out = ~near | (far + SLACK > radius)
            stack.append((self.inner[name], rows[into], visitor[into]))
            stack.append((self.outer[name], rows[out], visitor[out] | near[out]))
        if not visits:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
        return tuple(np.concatenate(x) for x in zip(*visits))


def halves(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (prints >> np.uint64(32)).astype(np.uint32), (prints & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def close_pairs(prints: np.ndarray, native: np.ndarray, cross: bool):
    """Index pairs within the distance: natives with natives and visitors, or only with visitors."""
    left = np.flatnonzero(native)
    right = np.flatnonzero(~native) if cross else np.arange(len(prints))
    for k in range(0, len(left), ROWS_AT_ONCE):
        some = left[k:k + ROWS_AT_ONCE]
        i, j = np.nonzero(np.bitwise_count(prints[some][:, None] ^ prints[right][None, :]) <= DISTANCE)
        yield some[i], right[j]


def _forest(group: pa.Table) -> pa.Table:
    nodes = group.column("node").to_numpy()
    order = np.argsort(nodes, kind="stable")
    nodes = nodes[order]
    prints = group.column("fp").to_numpy()[order].view(np.uint64)
    native = ~group.column("visitor").to_numpy(zero_copy_only=False)[order].astype(bool)
    parent = np.arange(len(nodes))
    for i, j in close_pairs(prints, native, group.column("cross")[0].as_py()):
        merge(parent, i, j)
    linked = np.flatnonzero(nodes[parent] != nodes)
    return pa.table({"a": pa.array(nodes[linked], pa.int64()), "b": pa.array(nodes[parent[linked]], pa.int64())})


def links(prints: DataFrame, population: int, sample: int = 65_536, leaf_rows: int = 1536, block: int = 2048) -> DataFrame:
    """Forest (a, b) over the nodes of ``prints`` (fp, node), one row per distinct fingerprint."""
    share = min(1.0, sample / max(population, 1))
    chosen = prints.where(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("fp")
    points = np.array(sorted(r[0] for r in chosen.collect()), dtype=np.int64).view(np.uint64)
    trees = [Tree(np.unique(x), population, leaf_rows, k) for k, x in enumerate(halves(points))]

    def visit(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            nodes = batch.column("node").to_numpy()
            for k, half in enumerate(halves(fps.view(np.uint64))):
                rows, leaf, visitor = trees[k].route(half)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf * 2 + k, pa.int32()), pa.array(visitor), pa.array(fps[rows]), pa.array(nodes[rows])],
                    names=["leaf", "visitor", "fp", "node"])

    visits = stored(prints.select("fp", "node").mapInArrow(visit, "leaf int, visitor boolean, fp long, node long"), "visits")
    # At most two rows per sampled fingerprint.
    sizes = visits.groupBy("leaf").agg(
        F.ceil(F.sum((~F.col("visitor")).cast("int")) / block).cast("int").alias("n"),
        F.ceil(F.sum(F.col("visitor").cast("int")) / block).cast("int").alias("v"))
    sizes = sizes.where("n > 0").withColumn("one", (F.col("n") == 1) & (F.col("v") <= 1))
    part = F.when(F.col("visitor"), F.pmod(F.xxhash64("fp"), F.greatest("v", F.lit(1)))).otherwise(
        F.pmod(F.xxhash64("fp"), F.col("n"))).cast("int")
    zero, to_n = F.lit(0), F.sequence(F.lit(0), F.col("n") - 1)
    to_v = F.when(F.col("v") > 0, F.sequence(zero, F.col("v") - 1)).otherwise(F.array().cast("array<int>"))
    task = lambda x, y, cross: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(cross).alias("cross"))
    tasks = (
        F.when(F.col("one"), F.array(task(zero, zero, False)))
        .when(F.col("visitor"), F.transform(to_n, lambda i: task(i, F.col("part"), True)))
        .otherwise(F.concat(
            F.transform(to_n, lambda i: task(F.least(i, F.col("part")), F.greatest(i, F.col("part")), False)),
            F.transform(to_v, lambda w: task(F.col("part"), w, True)))))
    dealt = (visits.join(F.broadcast(sizes), "leaf").withColumn("part", part)
             .select("leaf", "visitor", "fp", "node", F.explode(tasks).alias("t")).select("leaf", "visitor", "fp", "node", "t.*"))
    return dealt.groupBy("leaf", "x", "y", "cross").applyInArrow(_forest, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float | None = None) -> DataFrame:
    """One row per document: key, ``fp`` (signed long), ``text_hash``, ``component_id``.

    ``component_id`` is the least key reachable over fingerprints within 3 bits.
    Null and empty texts and texts without words have fingerprint 0.  Copies
    share their fingerprint and are grouped before anything is compared.  A row
    without a key gets the component of its fingerprint and names none; rows
    that share a key are linked, and repeated rows each get a row.  Other columns
    are not read.  With ``similarity``, rows whose 5-word shingle sets are at least
    that similar are linked as well (``similar_links``).
    """
    marked = docs.withColumn("_hash", F.xxhash64(F.col(text).cast("string")))
    rows = stored(fingerprints(marked, text, key, "_hash").toDF("id", "text_hash", "fp"), "prints")
    prints = stored(rows.groupBy("fp").agg(F.min("id").alias("node"), F.count("*").alias("n")), "distinct")
    named = prints.where("node is not null")
    population, total = named.count(), rows.count()
    ties = links(named, population)
    several = stored(rows.where("id is not null").groupBy("id").agg(F.min("fp").alias("low"), F.max("fp").alias("high"))
                     .where("low <> high").select("id"), "several")
    if not several.isEmpty():
        texts = rows.join(several, "id", "left_semi").select("id", "fp").distinct()
        ties = ties.unionByName(texts.join(named, "fp").select(F.col("id").alias("a"), F.col("node").alias("b")))
    if similarity is not None:
        near = stored(similar_links(docs, key, text, similarity), "similar")
        # Pairs name keys; this links each key to the nodes of its fingerprints.
        ends = near.select(F.col("a").alias("id")).union(near.select("b")).distinct()
        own = rows.join(ends, "id", "left_semi").select("id", "fp").distinct().join(named, "fp")
        ties = ties.unionByName(near.select("a", "b")).unionByName(own.where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b")))
    roots = components(ties, "near").toDF("node", "root")
    classes = prints.join(roots, "node", "left").select("fp", "n", F.coalesce("root", "node").alias("component_id"))
    found = attach(rows, stored(classes, "classes"), "fp", "n", total)
    return found.select(F.col("id").alias(key), "fp", "text_hash", "component_id")


def hex_print(column: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float | None = None) -> DataFrame:
    """The document with the least key of each group, in one row; all columns stay.

    Rows that share a key are one group.  Rows without a key stay if their group
    has no key at all, one row per text.
    """
    found = near_duplicates(docs, key, text, similarity)
    lead = F.col(key).eqNullSafe(F.col("component_id"))
    gone = found.where(~lead).select(F.col(key).alias("_pf_key"), F.col("text_hash").alias("_pf_hash")).distinct()
    repeated = stored(found.where(lead).groupBy(F.col(key).alias("_pf_key")).count().where("count > 1").drop("count"), "repeated")
    mark = F.xxhash64(F.col(text).cast("string"))
    same = F.col(key).eqNullSafe(F.col("_pf_key"))
    left = docs.join(gone, same & mark.eqNullSafe(F.col("_pf_hash")), "left_anti")
    if repeated.isEmpty():
        return left
    single = left.join(repeated, same, "left_anti")
    several = left.join(repeated, same, "left_semi").withColumn("_pf_mark", F.when(F.col(key).isNull(), mark))
    return single.unionByName(several.dropDuplicates([key, "_pf_mark"]).drop("_pf_mark"))
