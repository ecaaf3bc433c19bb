"""SimHash near-dedup by multi-index hashing.

Fingerprints are cut into segments. A small Hamming ball around each segment's value is enumerated, the codes are looked
up in one table for all segments, and what meets there is verified by the complete distance. Two forms:

* `link_components`: exact components under a distance of at most 2 (the contract of the query). Two 64-bit
  fingerprints within 2 bits have a common neighbour within 1 bit of each. So each fingerprint enters the table under
  its own value and under every value one bit away in one of its segments, the other segments held: 65 rows. No code
  can have more than 65 fingerprints, however many copies a text has, so there are no hot buckets and no pairs to
  enumerate: the members of a code form a chain, verified link by link.
* `near_duplicates`: components under a shingle similarity (the pipeline's stage). Fingerprints are minwise values of
  the five-word shingle sets, of which two texts share a part that is their Jaccard similarity on average, whatever the
  kind of edit; texts meet that agree in one segment of these values. One bit of each value makes a sketch whose distance
  rules out most of what meets, and exact Jaccard similarity decides.

Defined cases: a null text is empty. All texts without words have fingerprint zero and are linked like any other. Null
document ids are kept; they never name a component. Repeated rows are copies of one another. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .components import components

SEED = 42
SHINGLE_WORDS = 3
RADIUS = 2


def text_fingerprint(text: bytes, size: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; words are split at ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    if len(words) <= size:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], ">u8")
    else:
        stops = (ends[size - 1 :] - 1).tolist()
        starts = [0, *ends[: len(words) - size].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [text_fingerprint((t.as_py() or "").encode(), size) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def fingerprint_links(fps: DataFrame, segments: int = 2) -> DataFrame:
    """u and v: links between different fingerprints, enough to join all that lie within two bits of each other.

    fps: distinct values in column fp. Each segment's ball of radius 1 holds the other segments' bits, so that a code
    names the whole neighbour. What meets under a code is verified by its complete distance.
    """
    width = 64 // segments
    balls = [F.transform(F.sequence(F.lit(s * width), F.lit((s + 1) * width - 1)), lambda bit: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))) for s in range(segments)]
    table = fps.select("fp", F.explode(F.concat(F.array("fp"), *balls)).alias("code"))
    before = F.lag("fp").over(Window.partitionBy("code").orderBy("fp"))
    met = table.select("fp", before.alias("other")).filter("other IS NOT NULL")
    return met.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= RADIUS).select(F.col("fp").alias("u"), F.col("other").alias("v"))


def link_components(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links of at most two bits, itself included)."""
    rows = common.cut(fingerprints(docs, size))
    named = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(fingerprint_links(named.select("fp")))
    linked = roots.union(roots.select("root", "root").distinct()).toDF("fp", "root")
    # one row for a fingerprint from here on, whatever its copies
    found = named.join(linked, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = found.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = found.join(lowest, "root").select("fp", "component_id", "root")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id", "root")


# ---- near duplicates by shingle similarity

SIMILARITY = 0.8
SIMILAR_WORDS = 5
#: Segments of a fingerprint and minwise values in each: at a similarity of 0.8 no segment agrees in (1 - 0.8 ** 5) ** 25,
#: that is 5 of 100,000 pairs.
SEGMENTS = 25
SEGMENT_VALUES = 5
#: Bits of the sketch that may differ. Of the 125, texts at the least similarity differ in 12.5 on average, by a deviation
#: of 3.4; of a million such pairs two differ in more.
SKETCH_RADIUS = 30
#: Texts of a code that are compared as pairs; larger codes are compared block by block.
SMALL_CODE = 6
#: Texts and shingles of a block on average (a longer text makes its block longer).
BLOCK_TEXTS = 256
BLOCK_SHINGLES = 1 << 21
#: Bytes of text of a pass over all factors, which holds the shingles in the processor's cache.
MIN_PASS_BYTES = 1 << 19
#: Odd, so that each is a permutation of the shingles' hashes.
MIN_FACTORS = common.mix(np.arange(1, SEGMENTS * SEGMENT_VALUES + 1, dtype=np.uint64)) | np.uint64(1)


def _minwise(shingles: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the segments of its fingerprint, each as one hash, and its sketch as two longs."""
    there = np.diff(begin) > 0
    segments = np.zeros((len(there), SEGMENTS), np.uint64)
    bits = np.zeros((len(there), 128), bool)
    with np.errstate(over="ignore"):
        for k, factor in enumerate(MIN_FACTORS):
            s = k // SEGMENT_VALUES
            least = common.mix(np.minimum.reduceat(shingles * factor, begin[:-1][there])) if there.any() else np.zeros(0, np.uint64)
            bits[there, k] = least >> np.uint64(63)
            segments[there, s] = common.mix(segments[there, s] * np.uint64(0x9E3779B97F4A7C15) + least + np.uint64(s))
    return segments.view(np.int64), np.packbits(bits, axis=1).view(">u8").astype(np.uint64).view(np.int64)


def _distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes of each text, sorted."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, row))
    h, row = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(first) - 1))])


def _sequence_keys(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each text's word sequence: equal keys are equal texts up to case and punctuation."""
    with np.errstate(over="ignore"):
        place = np.arange(len(words), dtype=np.uint64) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix(words + common.mix(place)))])
        return common.mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64))


def _wide_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, key, size (number of shingles), segments, sketch and SimHash fingerprint (fp) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in common.text_passes(batch.column(2), MIN_PASS_BYTES):
                words, first = common.word_hashes(data, offsets)
                shingles, begin = common.shingle_hashes(words, first, SIMILAR_WORDS)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(end - row + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1))) for x in _minwise(shingles, begin)]
                keys = pa.array(_sequence_keys(words, first).view(np.int64))
                fps = [text_fingerprint((t.as_py() or "").encode()) for t in batch.column(2).slice(row, end - row)]
                lists.append(pa.array(np.array(fps, np.uint64).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), keys, pa.array(np.diff(begin)), *lists], ["doc_id", "text_hash", "key", "size", "segments", "sketch", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_hash"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, key long, size long, segments array<long>, sketch array<long>, fp long")


def _shingle_rows(docs: DataFrame) -> DataFrame:
    """key and the five-word shingle set of each row.

    A shingle is kept as 32 bits: among the few thousand of two texts, that many do not meet by chance.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in common.text_passes(batch.column(0)):
                words, first = common.word_hashes(data, offsets)
                sets, set_first = _distinct(*_short(common.shingle_hashes(words, first, SIMILAR_WORDS)))
                lists = pa.ListArray.from_arrays(pa.array(set_first, pa.int32()), pa.array(sets.astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(_sequence_keys(words, first).view(np.int64)), lists], ["key", "shingles"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "key long, shingles array<int>")


def text_hash(text: Column) -> Column:
    """A hash by which a row is found again: of its exact text, null being empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _short(hashes: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return hashes[0] >> np.uint64(32), hashes[1]


def _distance(x: Column, y: Column) -> Column:
    """In how many bits two sketches differ."""
    bits = [F.bit_count(F.get(x, k).bitwiseXOR(F.get(y, k))) for k in (0, 1)]
    return bits[0] + bits[1]


def _ordered(x: str, y: str) -> list[Column]:
    return [F.greatest(x, y).alias("u"), F.least(x, y).alias("v")]


def _shared_codes(firsts: DataFrame) -> DataFrame:
    """key, size, segments, sketch, segment and code of each code that several keys share, with one of these: leader and its sketch."""
    codes = firsts.filter("size > 0").select("key", "size", "segments", "sketch", F.posexplode("segments").alias("segment", "code"))
    small = codes.select("code", "key", "sketch")
    # which key leads is a draw of its own for each code; counts and minima are made in each task first
    leader = small.groupBy("code").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("key", "code").alias("draw"), "key", "sketch")).alias("first"))
    leader = leader.filter("n > 1").select("code", F.col("first.key").alias("leader"), F.col("first.sketch").alias("leader_sketch"))
    return codes.join(leader, "code")


def _simhash_pairs(firsts: DataFrame) -> DataFrame:
    """Pairs u, v of keys whose SimHash fingerprints are equal or linked within two bits, each fingerprint by its smallest key."""
    rows = firsts.filter("size > 0").select("key", "fp")
    lead = rows.groupBy("fp").agg(F.min("key").alias("lead"))
    same = rows.join(lead, "fp").filter("key <> lead").select(*_ordered("key", "lead"))
    links = fingerprint_links(lead.select("fp"))
    apart = links.join(lead.toDF("u", "a"), "u").join(lead.toDF("v", "b"), "v").select(*_ordered("a", "b"))
    return same.union(apart).distinct()


def _best(shared: DataFrame) -> DataFrame:
    """A pair u, v for each key: of the leaders of its codes the one whose sketch is nearest."""
    met = shared.select("key", "leader", _distance(F.col("sketch"), F.col("leader_sketch")).alias("bits")).filter(f"key <> leader AND bits <= {SKETCH_RADIUS}")
    nearest = met.groupBy("key").agg(F.min(F.struct("bits", "leader")).alias("best"))
    return nearest.select(*_ordered("key", "best.leader")).distinct()


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs u, v whose shingle sets have a Jaccard similarity of at least SIMILARITY."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= SIMILARITY * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
    sizes = F.least(F.size("a"), F.size("b")) >= F.lit(SIMILARITY) * F.greatest(F.size("a"), F.size("b"))
    return joined.filter(sizes).select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _mixed(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of shared whose code has several groups of roots, with root, main (the code's largest group), n, n_rest, words and words_rest."""
    named = shared.drop("leader", "leader_sketch").join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    groups = named.groupBy("code", "root").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    largest = F.max(F.struct("n", "root", "words"))
    sums = groups.groupBy("code").agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum("words").alias("words"), largest.alias("main")).filter("groups > 1")
    return named.join(sums.select("code", "n", "words", (F.col("n") - F.col("main.n")).alias("n_rest"), (F.col("words") - F.col("main.words")).alias("words_rest"), F.col("main.root").alias("main")), "code")


def _small_pairs(mixed: DataFrame) -> DataFrame:
    """The pairs u, v of different groups with like sketches in codes of at most SMALL_CODE keys."""
    rows = mixed.filter(F.col("n") <= SMALL_CODE).select("code", "key", "root", "sketch")
    x, y = rows.alias("x"), rows.alias("y")
    met = x.join(y, (F.col("x.code") == F.col("y.code")) & (F.col("x.root") < F.col("y.root")) & (_distance(F.col("x.sketch"), F.col("y.sketch")) <= SKETCH_RADIUS))
    return met.select(*_ordered("x.key", "y.key")).distinct()


def _blocks(mixed: DataFrame) -> DataFrame:
    """The rows of larger codes dealt into blocks: code, i, j, side, key, root and what else mixed has.

    Side 0 is what is not in the code's main group, side 1 is all. Every block of side 0 meets every block of side 1, so
    that a code takes rows in proportion to its keys where most are in one group already.
    """
    large = mixed.filter(F.col("n") > SMALL_CODE)
    pieces = lambda n, words: F.greatest(F.ceil(F.col(n) / BLOCK_TEXTS), F.ceil(F.col(words) / BLOCK_SHINGLES), F.lit(1)).cast("int")
    large = large.withColumns({"of_rest": pieces("n_rest", "words_rest"), "of_all": pieces("n", "words")})
    at = lambda salt, of: F.pmod(F.xxhash64("key", F.lit(salt)), F.col(of)).cast("int")
    rest = large.filter("root <> main").select("*", F.lit(0).alias("side"), at(0, "of_rest").alias("i"), F.explode(F.sequence(F.lit(0), F.col("of_all") - 1)).alias("j"))
    whole = large.select("*", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("of_rest") - 1)).alias("i"), at(1, "of_all").alias("j"))
    return rest.unionByName(whole).select("code", "i", "j", "side", "key", "root", "segment", "segments", "sketch")


def _meeting(blocks: DataFrame) -> DataFrame:
    """The rows of blocks that have a partner there: of another group, with a like sketch, and no earlier code in common."""
    names = ["code", "i", "j", "side", "key", "root"]

    def run(block: pa.Table) -> pa.Table:
        side, root = block.column("side").to_numpy(), block.column("root").to_numpy()
        sketch = block.column("sketch").combine_chunks().values.to_numpy().reshape(-1, 2).view(np.uint64)
        segments = block.column("segments").combine_chunks().values.to_numpy().reshape(-1, SEGMENTS)
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        meets = np.zeros(len(side), bool)
        for part in (x[k : k + BLOCK_TEXTS] for k in range(0, len(x), BLOCK_TEXTS)):
            pairs = (root[part][:, None] != root[y]) & (np.bitwise_count(sketch[part][:, None] ^ sketch[y]).sum(2) <= SKETCH_RADIUS)
            for s in range(block.column("segment")[0].as_py()):
                pairs &= segments[part, s][:, None] != segments[y, s]
            meets[part] |= pairs.any(1)
            meets[y] |= pairs.any(0)
        return block.select(names).filter(pa.array(meets))

    return blocks.groupBy("code", "i", "j").applyInArrow(run, "code long, i int, j int, side int, key long, root long")


def _block_links(meeting: DataFrame, sets: DataFrame) -> DataFrame:
    """Links u, v by exact similarity within blocks, as many as join what they join and no more."""

    def run(block: pa.Table) -> pa.Table:
        side, root, keys = (block.column(c).to_numpy() for c in ("side", "root", "key"))
        lists = block.column("shingles").combine_chunks()
        first = lists.offsets.to_numpy().astype(np.int64)
        names, tokens = np.unique(lists.values.to_numpy()[first[0] : first[-1]], return_inverse=True)
        first = first - first[0]
        sizes = np.diff(first)
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        of_y = np.concatenate([tokens[first[k] : first[k + 1]] for k in y])
        begin = np.concatenate([[0], np.cumsum(sizes[y])])
        there = np.zeros(len(names) + 1, np.int32)
        group = {r: r for r in root.tolist()}

        def find(r: int) -> int:
            while group[r] != r:
                group[r] = r = group[group[r]]
            return r

        links = []
        for k in x:
            there[:] = 0
            there[tokens[first[k] : first[k + 1]]] = 1
            both = np.concatenate([[0], np.cumsum(there[of_y])])
            both = both[begin[1:]] - both[begin[:-1]]
            for at in y[(both >= SIMILARITY * (sizes[k] + sizes[y] - both) - 1e-9) & (root[y] != root[k])]:
                a, b = find(int(root[k])), find(int(root[at]))
                if a != b:
                    group[max(a, b)] = min(a, b)
                    links.append((max(keys[k], keys[at]), min(keys[k], keys[at])))
        return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})

    return meeting.join(sets, "key").groupBy("code", "i", "j").applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, key and root: documents of one root are near copies, directly or over others.

    A minwise value of two texts agrees with a probability that is their similarity, so whether the edits are scattered,
    or a copy is cut or extended, makes no difference: of pairs at the very bound 5 in 100,000 meet in no segment, and far
    fewer above it. Texts of the same words (case and punctuation aside) are one key and are never compared.

    SimHash by multi-index hashing comes first: texts whose fingerprints lie within two bits are candidates. It cannot hold a
    bound on the similarity, so the minwise codes bring what it misses; exact similarity decides for both.

    Each code has a leader. A text is first compared with the leader nearest to it, which joins most groups by a link for
    each text. Codes whose texts are then in different groups still are compared whole, without a cap: all that is not in
    the code's main group with all of the code. Shingle sets are made once, and stored for keys that share a code.
    """
    rows = common.stored(_wide_rows(docs), "near")
    firsts = rows.groupBy("key").agg(*(F.first(c).alias(c) for c in ("size", "segments", "sketch")), F.min("fp").alias("fp"))
    shared = common.stored(_shared_codes(firsts), "codes")
    close = common.cut(_simhash_pairs(firsts))
    asked = shared.select("key").union(close.select("u")).union(close.select("v")).distinct()
    # copies are reduced to one set in each task before the shuffle; the join has the same keys and adds none
    sets = _shingle_rows(docs).groupBy("key").agg(F.first("shingles").alias("shingles"))
    sets = common.stored(sets.join(asked, "key", "left_semi"), "shingles")
    links = common.cut(_similar(_best(shared).union(close).distinct(), sets))
    mixed = common.cut(_mixed(shared, components(links)))
    links = links.union(_similar(_small_pairs(mixed), sets)).union(_block_links(common.cut(_meeting(_blocks(mixed))), sets))
    roots = components(links)
    return rows.select("doc_id", "text_hash", "key").join(roots.select(F.col("node").alias("key"), "root"), "key", "left").select("doc_id", "text_hash", "key", F.coalesce("root", "key").alias("root"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, with all its columns: that of the smallest doc_id (null comes last)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    kept = near_duplicates(docs).groupBy("root").agg(first).select("first.*")
    names, keys = docs.columns, ["__no_id", "__id", "__hash"]
    kept = kept.select(F.col("no_id").alias("__no_id"), F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    # the row in one struct, so that no column of docs clashes with these
    marked = docs.select(F.struct(*names).alias("__doc"), F.col("doc_id").cast("long").isNull().alias("__no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("__id"), text_hash(F.col("text")).alias("__hash"), F.xxhash64(*names).alias("__row"))
    # rows equal in doc_id and text are copies too; join and window have the same keys, so that texts are shuffled once
    found = marked.join(kept, keys, "left_semi")
    return found.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy("__row"))).filter("__place = 1").select("__doc.*")
