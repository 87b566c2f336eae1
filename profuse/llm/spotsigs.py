"""Document fingerprints: spot signatures.

Common words of running text are anchors.  The chain of content words that
follows an anchor, together with the anchor, is a signature; a text's
fingerprint is the set of its signatures, written as sorted 16-digit hex
numbers.  Menus and notices have few anchors and add little to it.  Sets are
compared by Jaccard similarity, and a comparison stops at what the lengths
allow; ``near_copies`` looks for similar sets among the sets of neighbouring
lengths only.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from profuse.llm.setlinks import links_in_buckets
from profuse.session import stored

# Frequent words of English, French, German and Spanish, lower case.
ANCHORS = frozenset((
    "the of and to a in is that for it was on with be as by this are at from have he his but not they which or had an were their she you all her we been has "
    "le la les de des du un une et est que qui pour dans par pas sur au avec plus ne se ce il sont aux elle ou "
    "der die das und den von zu mit sich auf des ist nicht im dem ein eine als auch es an werden aus er hat dass sie nach wird bei einer "
    "el los las y en del por una con no su para al lo como más o pero sus fue ha").split())
CHAIN = 3
#: Characters of text whose signatures are computed together.
TOGETHER = 1 << 19
SIMILARITY = 0.8
_WORD = re.compile(r"\w+")
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _join(parts: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash of several columns of hashes."""
    x = np.zeros(len(parts[0]), dtype=np.uint64)
    for part, k in zip(parts, _K):
        x = (x ^ part) * k
        x ^= x >> np.uint64(29)
    return x


def signature_sets(texts: list[str], chain: int = CHAIN) -> list[np.ndarray]:
    """The ascending distinct signatures of each text.

    A signature is an anchor and the next ``chain`` content words, fewer at the
    end of the text.  A text with words but no signature takes every word as an
    anchor and as content.  A text without words has none.
    """
    words = [_WORD.findall(t.lower()) for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    total = int(sizes.sum())
    if not total:
        return [np.zeros(0, dtype=np.uint64) for _ in texts]
    coded = pa.array([w for mine in words for w in mine]).dictionary_encode()
    known, ids = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in known], dtype=np.uint64)[ids]
    anchor = np.array([w in ANCHORS for w in known], dtype=bool)[ids]
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(texts)), sizes)

    def chains(at: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, signature) of the anchors at ``at``; ``content`` holds the places of content words."""
        first = np.searchsorted(content, at, side="right")
        last = np.searchsorted(content, ends[of[at]])
        parts = [hashes[at]]
        for k in range(chain):
            place = first + k
            there = place < last
            parts.append(np.where(there, hashes[content[np.minimum(place, len(content) - 1)]], np.uint64(0)))
        some = first < last
        return of[at][some], _join(parts)[some]

    content = np.flatnonzero(~anchor)
    mine, found = chains(np.flatnonzero(anchor), content) if len(content) else (of[:0], hashes[:0])
    bare = (sizes > 0) & (np.bincount(mine, minlength=len(texts)) == 0)
    if bare.any():
        every = np.flatnonzero(bare[of])
        # The last word of a text has no chain and stands for itself.
        more, others = chains(every, np.arange(total))
        lone = np.flatnonzero(bare & (sizes == 1))
        mine = np.concatenate([mine, more, lone])
        found = np.concatenate([found, others, hashes[ends[lone] - 1]])
    order = np.lexsort((found, mine))
    mine, found = mine[order], found[order]
    new = np.ones(len(mine), dtype=bool)
    new[1:] = (mine[1:] != mine[:-1]) | (found[1:] != found[:-1])
    mine, found = mine[new], found[new]
    return np.split(found, np.searchsorted(mine, np.arange(1, len(texts))))


def written(found: np.ndarray) -> str:
    """A set as text: 16 lowercase hex digits for each signature, ascending."""
    return found.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two ascending sets; 1 for two empty ones.

    With ``least``, sets whose lengths exclude it are not compared and give 0.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (small + large - both)


def edited(text: str, after: str) -> str:
    """The text whose second half is replaced by as much of the start of ``after``."""
    cut = len(text) // 2
    return text[:len(text) - cut] + after[:cut]


def _in_chunks(texts: list[str]) -> list[np.ndarray]:
    """``signature_sets`` of any number of texts, some characters at a time."""
    found, some, size = [], [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= TOGETHER:
            found += signature_sets(some)
            some, size = [], 0
    return found + (signature_sets(some) if some else [])


def fingerprints(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """The key columns and ``fingerprint`` of every row; null and empty texts have the empty one.

    Equal texts have equal fingerprints, so repeated rows and ties agree; other
    columns are not read.  One map over whole texts.
    """
    rows = docs.select(*keys, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_pf_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["fingerprint string"])

    def run(batches):
        for batch in batches:
            prints = [written(x) for x in _in_chunks(batch.column(batch.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints, pa.string())], names=[*batch.schema.names[:-1], "fingerprint"])

    return rows.mapInArrow(run, schema)


def near_copies(prints: DataFrame, key: str = "doc_id", fingerprint: str = "fingerprint", similarity: float = SIMILARITY, block: int = 256) -> DataFrame:
    """Forest (a, b) over the keys of rows whose fingerprints have Jaccard ``similarity`` or more; no link is lost.

    Sets are dealt by length into classes such that similar ones lie in one class
    or in two neighbouring ones.  Two similar sets share one of their rarest
    (1 - similarity) n + 1 signatures, so only sets that share such a one within
    the classes are compared.  Equal fingerprints are one row; null keys and empty
    fingerprints link with nothing; an empty table gives an empty result.
    """
    rows = prints.select(F.col(key).alias("id"), F.col(fingerprint).alias("p")).where("id is not null and p <> ''")
    rows = stored(rows.groupBy("p").agg(F.min("id").alias("node")).withColumn("mark", F.xxhash64("p")), "spot-sets")
    n = (F.length("p") / 16).cast("int")
    digits = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substr(F.col("p"), k * 16 + 1, F.lit(16)))
    flat = stored(rows.select("mark", "node", n.alias("n"), F.explode(digits).alias("s")), "spot-signatures")
    often = flat.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    shared = flat.join(often, "s", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    # The rarest signatures of a set; a set has them all in one row, so nothing else is grouped.
    rare = shared.groupBy("mark", "node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("all"))
    prefix = F.slice("all", 1, (F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).cast("int"))
    rank = F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(similarity)) + 1e-9).cast("int")
    near = F.explode(F.array(rank, rank + 1)).alias("band")
    held = rare.select("mark", "node", near, F.explode(F.transform(F.filter(prefix, lambda x: x["df"] > 1), lambda x: x["s"])).alias("s"))
    bands = stored(held.select("mark", "node", "band", F.xxhash64("s").alias("bucket")), "spot-buckets")

    def pack(batches):
        for batch in batches:
            sets = [np.frombuffer(bytes.fromhex(x.as_py()), dtype=">u8").astype(np.uint64).tobytes() for x in batch.column("p")]
            yield pa.RecordBatch.from_arrays([batch.column("mark"), pa.array(sets, pa.binary())], names=["mark", "found"])

    def sets_of(wanted: DataFrame) -> DataFrame:
        return rows.join(wanted.select("mark"), "mark", "left_semi").select("mark", "p").mapInArrow(pack, "mark long, found binary")

    return links_in_buckets(bands, sets_of, similarity, block)


def compare_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next key (null keys last; equal keys
    by a hash of the text; after the last comes the first; a lone document
    follows itself).  The edited text is the document's first half and as much
    of the next one's start.  Null texts are empty.  Repeated rows follow each
    other and each get a row; other columns are not read; an empty table gives an
    empty result.

    Keys alone are range-sorted to learn the first key of each stretch.  Texts
    are compressed and shuffled once, to the stretch that holds their key; the
    first text of a stretch also goes to the one before it.  A key or copy with a
    large share of the rows is several stretches.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[key].dataType.simpleString()
    t = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(t).alias("h"), t.alias("t"))
    order = [F.col("id").isNull().alias("none"), F.col("id"), F.col("h")]
    run = rows.select(*order, F.monotonically_increasing_id().alias("at")).repartitionByRange(parts, "none", "id", "h", "at")
    least = run.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("none", "id", "h")).alias("first"))
    # At most one row per shuffle partition.
    firsts = sorted((none, id_ if id_ is not None else 0, h) for (none, id_, h) in (r["first"] for r in least.collect()))
    heads = {}
    for k, first in enumerate(firsts):
        heads.setdefault(first, []).append((k - 1) % len(firsts))

    def deal(batches):
        small, sent = zstandard.ZstdCompressor(level=1), {}
        for batch in batches:
            out = []
            for id_, h, raw in zip(*(batch.column(c).to_pylist() for c in ("id", "h", "t"))):
                mark = (id_ is None, id_ if id_ is not None else 0, h)
                packed, stretch = small.compress(raw), bisect_right(firsts, mark) - 1
                if mark in heads:
                    # Equal rows that begin several stretches are dealt to them in turn, the last one first.
                    stretch -= sent.get(mark, 0) % (stretch - bisect_left(firsts, mark) + 1)
                    if mark not in sent:
                        out += [(k, True, id_, h, packed) for k in heads[mark]]
                    sent[mark] = sent.get(mark, 0) + 1
                out.append((stretch, False, id_, h, packed))
            columns = list(zip(*out)) or [()] * 5
            types = [pa.int32(), pa.bool_(), batch.column("id").type, pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], names=["stretch", "ahead", "id", "h", "z"])

    dealt = rows.mapInArrow(deal, f"stretch int, ahead boolean, id {kind}, h long, z binary")
    placed = dealt.repartition(parts, "stretch").sortWithinPartitions("stretch", "ahead", F.col("id").isNull(), "id", "h")

    def follow(batches):
        kept = Followers()
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("stretch", "ahead", "id", "z"))
            for stretch, ahead, id_, z in zip(*columns):
                if kept.add(stretch, ahead, id_, z):
                    yield kept.take(batch.column("id").type)
        if kept.texts:
            yield kept.take(batch.column("id").type)

    return placed.select("stretch", "ahead", "id", "z").mapInArrow(
        follow, f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


class Followers:
    """Texts in key order, some at a time; each is compared with the one after it in its stretch."""

    def __init__(self) -> None:
        self.large, self.names = zstandard.ZstdDecompressor(), ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        self.keys, self.texts, self.ends, self.size, self.stretch, self.over = [], [], [], 0, None, True

    def add(self, stretch: int, ahead: bool, id_, z: bytes) -> bool:
        """Whether enough has come together; of the texts that look ahead only the first counts."""
        if stretch != self.stretch:
            self.stretch, self.over = stretch, False
        if self.over:
            return False
        self.over = ahead
        self.keys.append(id_)
        self.texts.append(self.large.decompress(z).decode("utf-8", "replace"))
        self.ends.append(ahead)
        self.size += len(self.texts[-1])
        return self.size >= TOGETHER

    def take(self, kind: pa.DataType) -> pa.RecordBatch:
        """Rows of all texts that have their follower; the last one waits unless it is one."""
        pairs = [k for k in range(len(self.texts) - 1) if not self.ends[k]]
        new = [edited(self.texts[k], self.texts[k + 1]) for k in pairs]
        sets, others = _in_chunks(self.texts), _in_chunks(new)
        columns = [
            pa.array([self.keys[k] for k in pairs], kind), pa.array([len(self.texts[k]) for k in pairs], pa.int64()),
            pa.array([hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x in new], pa.string()),
            pa.array([written(sets[k]) for k in pairs], pa.string()), pa.array([written(x) for x in others], pa.string()),
            pa.array([likeness(sets[k], x) for k, x in zip(pairs, others)], pa.float64()),
            pa.array([likeness(sets[k], sets[k + 1]) for k in pairs], pa.float64())]
        self.keys, self.texts, self.ends = self.keys[-1:], self.texts[-1:], self.ends[-1:]
        self.size = len(self.texts[0]) if self.texts else 0
        return pa.RecordBatch.from_arrays(columns, names=self.names)
