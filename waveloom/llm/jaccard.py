"""N-gram Jaccard join by chosen paths: sets split on sampled shared tokens, small buckets are compared, runs repeat."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, Words, components, mix, slices, table, utf8, utf8_bytes

SKETCH = 64  # bytes of the one-permutation sketch that pre-compares two sets


def shingle_sets(blob: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending inside it, and the n + 1 cuts between texts.

    A text with fewer than ``size`` words, but one at least, has one shingle of all its words.
    """
    w = Words(blob, offsets)
    h, at = w.windows(size)
    doc = w.doc[at]
    short = np.flatnonzero((w.count > 0) & (w.count < size))
    if len(short):
        single = np.array([int(mix(np.array([k], U64))[0]) for k in w.count[short]], U64)
        for j in range(size - 1):
            more = short[w.count[short] > j]
            pick = np.searchsorted(short, more)
            single[pick] = mix(single[pick] * U64(0x9E3779B97F4A7C15) + w.hash[w.first[more] + j])
        h, doc = np.concatenate([h, single]), np.concatenate([doc, short])
    by = np.lexsort((h, doc))
    h, doc = h[by], doc[by]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(offsets)))


def survival(rate: float, threshold: float, depth: int) -> float:
    """Chance that two sets of equal size at the threshold share a path of ``depth`` in one run."""
    shared = rate * 2 * threshold / (1 + threshold)
    q = 0.0
    for _ in range(depth):
        q = math.exp(-shared * (1 - q))
    return 1 - q


def runs_for(recall: float, rate: float, threshold: float, depth: int) -> int:
    """Runs until the chance of at least one common path reaches ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(rate, threshold, depth))))


def _children(tokens: np.ndarray, node: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``node``, child) for the tokens of one set that each node samples, ``rate`` of them on average."""
    limit = min(1.0, rate / len(tokens))
    draw = mix(tokens[None, :] ^ node[:, None])
    k, j = np.nonzero(draw <= U64(min(int(limit * 2**64), 2**64 - 1)))
    return k, mix(node[k] * U64(0x9E3779B97F4A7C15) + tokens[j])


def _sketch(tokens: np.ndarray) -> bytes:
    """Low byte of the smallest hash in each of ``SKETCH`` bins; 0 marks an empty bin."""
    m = np.sort(mix(tokens + U64(0x5851F42D4C957F2D)))
    bins = (m >> U64(58)).astype(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    out = np.zeros(SKETCH, np.uint8)
    out[bins[heads]] = (m[heads] & U64(0xFF)).astype(np.uint8) % 255 + 1
    return out.tobytes()


def signatures(docs: DataFrame, shingle: int, rate: float, runs: int, id_col: str, text_col: str) -> DataFrame:
    """id, hi, lo (128-bit hash of the shingle set), n, nodes (first nodes of all runs), sketch; texts without words are left out."""
    roots = mix(np.arange(1, runs + 1, dtype=U64) * U64(0xA0761D6478BD642F))

    def work(batches):
        for batch in batches:
            ids = batch.column(0)
            blob, offsets = utf8_bytes(utf8(batch.column(1)))
            for lo, hi in slices(offsets, 1 << 20):
                h, cuts = shingle_sets(blob[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo], shingle)
                some = np.flatnonzero(np.diff(cuts))
                if not len(some):
                    continue
                ones, twos = mix(h ^ U64(0x1D8E4E27C47D124F)), mix(h + U64(0xEB44ACCAB455D165))
                nodes, sketches = [], []
                for k in some:
                    t = h[cuts[k]: cuts[k + 1]]
                    nodes.append(np.unique(_children(t, roots, rate)[1]).view(np.int64))
                    sketches.append(_sketch(t))
                size = np.fromiter(map(len, nodes), np.int32, len(nodes))
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, hi - lo).take(pa.array(some)), pa.array(np.add.reduceat(ones, cuts[some]).view(np.int64)), pa.array(np.add.reduceat(twos, cuts[some]).view(np.int64)),
                    pa.array(np.diff(cuts)[some].astype(np.int64)),
                    pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), pa.array(np.concatenate(nodes))),
                    pa.array(sketches, pa.binary())], names=["id", "hi", "lo", "n", "nodes", "sketch"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(work, "id long, hi long, lo long, n long, nodes array<long>, sketch binary")


# ---------------------------------------------------------------- buckets

def _groups(batches, key: int, limit: int):
    """Rows sorted by a key column, as tables that hold whole groups; runs of small groups come together."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < limit:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        k = t.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1], side="left"))
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _few_groups(tables, key: int, limit: int):
    """The same whole groups in tables of at most ``limit`` rows, or one group where that alone is larger."""
    for t in tables:
        k = t.column(key).to_numpy()
        cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])), [len(k)]])
        for lo, hi in slices(cuts, limit):
            yield t.slice(cuts[lo], cuts[hi] - cuts[lo])


def _pairs_of(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs inside each of many small groups of consecutive rows."""
    rows = np.repeat(sizes, sizes)
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.repeat(starts, sizes) + place
    more = rows - 1 - place
    a = np.repeat(left, more)
    step = np.arange(len(a)) - np.repeat(np.cumsum(more) - more, more) + 1
    return a, a + step


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of sketches, row by row."""
    some = (x != 0) | (y != 0)
    return ((x == y) & some).sum(1) / np.maximum(some.sum(1), 1)


def _stars(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id of its component) over pairs of positions, for positions in a pair."""
    label = np.arange(len(ids))
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    label = rank.copy()
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        if (label == before).all():
            break
    by_rank = np.sort(ids)
    some = np.unique(np.concatenate([a, b]))
    return ids[some], by_rank[label[some]]


def _compare_buckets(rows: DataFrame, close: float, limit: int) -> DataFrame:
    """(a, b, kind): star edges of sets that look alike inside a bucket (kind 0), and rows of buckets over
    ``limit`` (kind 1: a set, b bucket) for the next split.

    Buckets are counted first, so sets alone in a bucket are never gathered, and those of a bucket over the limit
    pass by in whatever tasks they are.
    """

    def work(batches):
        for t in _groups(batches, 0, 20_000):
            node, ids = t.column(0).to_numpy(), t.column(1).to_numpy()
            heads = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            sizes = np.diff(np.append(heads, len(node)))
            use = sizes > 1
            if not use.any():
                continue
            sketch = np.frombuffer(b"".join(t.column(2).to_pylist()), np.uint8).reshape(-1, SKETCH)
            for s, m in zip(heads[use & (sizes > 512)], sizes[use & (sizes > 512)], strict=True):
                x, y = _stars_by_rows(ids[s: s + m], sketch[s: s + m], close)
                yield pa.RecordBatch.from_pydict({"a": x, "b": y, "kind": np.zeros(len(x), np.int32)})
            use &= sizes <= 512
            heads, sizes = heads[use], sizes[use]
            at = 0
            while at < len(heads):  # runs of groups with a bounded number of pairs
                many = np.cumsum(sizes[at:].astype(np.int64) * (sizes[at:] - 1) // 2)
                n = max(1, int(np.searchsorted(many, 200_000, side="right")))
                a, b = _pairs_of(heads[at: at + n], sizes[at: at + n])
                keep = np.concatenate([_alike(sketch[a[k: k + 50_000]], sketch[b[k: k + 50_000]]) >= close for k in range(0, len(a), 50_000)])
                a, b = a[keep], b[keep]
                if len(a):
                    # positions stand for (bucket, set), so buckets stay apart
                    lo, hi = heads[at], heads[at + n - 1] + sizes[at + n - 1]
                    x, y = _stars_in(node[lo: hi], ids[lo: hi], a - lo, b - lo)
                    yield pa.RecordBatch.from_pydict({"a": x, "b": y, "kind": np.zeros(len(x), np.int32)})
                at += n

    # a merge join at every size; its hot keys are split by adaptive execution
    counts = rows.groupBy("node").agg(F.count("*").alias("m")).filter("m > 1")
    shared = rows.join(counts.hint("merge"), "node")
    near = shared.filter(F.col("m") <= limit).select("node", "id", "sketch").repartition("node").sortWithinPartitions("node")
    large = shared.filter(F.col("m") > limit).select(F.col("id").alias("a"), F.col("node").alias("b"), F.lit(1).alias("kind"))
    return near.mapInArrow(work, "a long, b long, kind int").distinct().unionByName(large)


def _stars_by_rows(ids: np.ndarray, sketch: np.ndarray, close: float) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of one bucket, by blocks of rows against all later rows; pairs are joined at once and never kept."""
    order = np.argsort(ids, kind="stable")
    ids, sketch = ids[order], sketch[order]
    label = np.arange(len(ids))
    for lo in range(0, len(ids), 32):
        a, b = sketch[lo: lo + 32, None, :], sketch[None, lo:, :]
        some = (a != 0) | (b != 0)
        alike = ((a == b) & some).sum(2) >= close * np.maximum(some.sum(2), 1)
        for k, row in enumerate(alike):
            met = np.unique(label[lo:][row | (np.arange(len(row)) == k)])
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    out = ids != ids[label]
    return ids[out], ids[label][out]


def _stars_in(node, ids, a, b):
    """Star edges inside each bucket: every set in a pair with the smallest set of its component there."""
    order = np.lexsort((ids, node))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    x, y = _stars(place, a, b)
    x, y = ids[order[x]], ids[order[y]]
    return x[x != y], y[x != y]


def _split(docs: DataFrame, rows: DataFrame, shingle: int, rate: float) -> DataFrame:
    """Children (node, id, sketch) of the buckets a set is in, sampled from its tokens; rows: id, parents (array)."""

    def work(batches):
        for batch in batches:
            blob, offsets = utf8_bytes(utf8(batch.column(1)))
            for lo, hi in slices(offsets, 1 << 20):
                h, cuts = shingle_sets(blob[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo], shingle)
                for k in range(hi - lo):
                    t = h[cuts[k]: cuts[k + 1]]
                    if len(t):
                        child = np.unique(_children(t, np.array(batch.column(2)[lo + k].as_py(), np.int64).view(U64), rate)[1]).view(np.int64)
                        if not len(child):
                            continue
                        yield pa.RecordBatch.from_pydict({"node": child, "id": np.full(len(child), batch.column(0)[lo + k].as_py(), np.int64), "sketch": [_sketch(t)] * len(child)})

    wide = docs.join(rows, "id").select("id", "text", "parents")
    return wide.mapInArrow(work, "node long, id long, sketch binary").dropDuplicates(["node", "id"])


# ---------------------------------------------------------------- exact comparison

def _verify(rows: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(a, b, links): exact comparison of all sets of a candidate component, or of two of its tiles.

    ``rows``: job, side (0, 1, or 2 for both), id, hi, lo, text, sorted by job. ``links`` counts the sets that a set
    is linked to in this job; b is the smallest set of its component there.
    """

    def work(batches):
        for t in _few_groups(_groups(batches, 0, 64), 0, 1500):
            job, side, ids = (t.column(k).to_numpy() for k in (0, 1, 2))
            hi_, lo_ = t.column(3).to_numpy(), t.column(4).to_numpy()
            blob, offsets = utf8_bytes(utf8(t.column(5).cast(pa.large_string())))
            h, cuts = [], [0]
            for lo, hi in slices(offsets, 1 << 20):
                part, c = shingle_sets(blob[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo], shingle)
                h.append(part)
                cuts.extend((c[1:] + cuts[-1]).tolist())
            h, cuts = np.concatenate(h), np.array(cuts)
            n = np.diff(cuts)
            some = np.flatnonzero(n)
            sums = [np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)]
            if len(some):
                sums[0][some] = np.add.reduceat(mix(h ^ U64(0x1D8E4E27C47D124F)), cuts[some]).view(np.int64)
                sums[1][some] = np.add.reduceat(mix(h + U64(0xEB44ACCAB455D165)), cuts[some]).view(np.int64)
            right = (sums[0] == hi_) & (sums[1] == lo_)  # of rows that share an id, the one the set is from
            heads = np.flatnonzero(np.concatenate([[True], job[1:] != job[:-1]]))
            for s, e in zip(heads, np.append(heads[1:], len(job)), strict=True):
                k = np.arange(s, e)[right[s: e]]
                _, first = np.unique(ids[k], return_index=True)
                k = k[first]
                a, b = _linked(h, cuts, k, threshold)
                two = side[k] != 2
                if two.any():  # pairs inside one tile belong to that tile's own job
                    cross = side[k[a]] != side[k[b]]
                    a, b = a[cross], b[cross]
                if len(a):
                    links = np.bincount(np.concatenate([a, b]), minlength=len(k))
                    x, y = _stars(ids[k], a, b)
                    yield pa.RecordBatch.from_pydict({"a": x, "b": y, "links": links[np.searchsorted(ids[k], x)].astype(np.int64)})

    return rows.mapInArrow(work, "a long, b long, links long")


def _linked(h: np.ndarray, cuts: np.ndarray, k: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions in ``k`` whose sets are at least ``threshold`` alike: products of set-by-token blocks."""
    m = len(k)
    size = np.diff(cuts)[k]
    token = np.concatenate([h[cuts[i]: cuts[i + 1]] for i in k])
    who = np.repeat(np.arange(m), size)
    by = np.argsort(token, kind="stable")
    token, who = token[by], who[by]
    new = np.concatenate([[True], token[1:] != token[:-1]])
    col = np.cumsum(new) - 1
    shared = np.bincount(col) > 1
    use = shared[col]
    who, col = who[use], (np.cumsum(shared) - 1)[col[use]]
    both = np.zeros((m, m), np.float32)
    width = int(shared.sum())
    block = max(1024, (8 << 20) // max(m, 1))
    for lo in range(0, width, block):
        s, e = np.searchsorted(col, [lo, lo + block])
        x = np.zeros((m, min(block, width - lo)), np.float32)
        x[who[s: e], col[s: e] - lo] = 1
        both += x @ x.T
    a, b = np.nonzero(np.triu(both, 1))
    inter = both[a, b].astype(np.int64)
    keep = inter >= threshold * (size[a] + size[b] - inter) - 1e-9
    return a[keep], b[keep]


# ---------------------------------------------------------------- join

def near_duplicates(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, recall: float = 0.995, rate: float = 1.6, depth: int = 3,
                    bucket: int = 4096, tile: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, class_id, n_copies, n_links.

    Sets are the distinct ``shingle``-word sequences of a text (words: runs other than ASCII white
    space; a shorter text is one sequence). Two sets are linked if their Jaccard similarity is
    ``threshold`` or more. class_id: smallest id of the connected component of links (texts with equal
    sets are in one class); n_copies: other rows with an equal set; n_links: different sets linked.

    Null and empty texts and texts of white space only have no set: own class, no links. Rows with a null
    id keep a null class_id and no counts. Repeated rows are copies of each other. Other columns are not read.

    Method: rows with equal sets are one set from here on. In each run every set picks ``rate`` of its
    tokens on average by a hash that all sets share, and goes to the bucket of each. Buckets of up to
    ``bucket`` sets are compared; larger ones are split again on further tokens, to ``depth`` levels, and
    what is still larger after that is compared in tiles. Runs are repeated until two sets at the threshold meet
    with chance ``recall`` (at full depth; buckets compared earlier only raise it). Sketches
    drop pairs that are far from alike; the rest form candidate components, inside which all pairs of sets
    are compared exactly, in tiles of ``tile`` sets where a component is large. A bucket or component yields a
    star and counts per set, never its pairs.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    runs = runs_for(recall, rate, threshold, depth)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sig, _ = scratch.land(signatures(base.filter("id is not null"), shingle, rate, runs, "id", "text"))
    sets, _ = scratch.land(sig.groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.count("*").alias("copies"),
                                                        F.first("nodes").alias("nodes"), F.first("sketch").alias("sketch")))
    close = threshold - 4 * math.sqrt(threshold * (1 - threshold) / SKETCH)

    rows, edges = sets.select(F.explode("nodes").alias("node"), F.col("rep").alias("id"), "sketch"), None
    for level in range(1, depth + 1):
        found, _ = scratch.land(_compare_buckets(rows, close, bucket))
        edges = found.filter("kind = 0") if edges is None else edges.unionByName(found.filter("kind = 0"))
        large = found.filter("kind = 1")
        if large.isEmpty():
            break
        if level == depth:
            edges = edges.unionByName(_tiled(rows, large, close, bucket))
            break
        parents = large.groupBy(F.col("a").alias("id")).agg(F.collect_list("b").alias("parents"))  # a set's own nodes
        rows, _ = scratch.land(_split(base, parents, shingle, rate))
    comp, _ = components(scratch, edges.select("a", "b"))
    sizes = comp.groupBy("comp").agg(F.count("*").alias("m"))
    members = (comp.join(sizes, "comp").join(sets.select(F.col("rep").alias("node"), "hi", "lo"), "node")
               .select(F.col("node").alias("id"), "hi", "lo", "comp", F.ceil(F.col("m") / tile).cast("long").alias("tiles")))
    mine = F.pmod(F.xxhash64("id"), F.col("tiles"))
    # job of tile i with tile j >= i: a set goes to the jobs of its own tile, tiles in number
    jobs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.struct(
        F.least(j, F.col("mine")).alias("i"), F.greatest(j, F.col("mine")).alias("j"),
        F.when(j == F.col("mine"), 2).otherwise(F.when(j < F.col("mine"), 1).otherwise(0)).alias("side")))
    dealt = (base.join(members, "id").withColumn("mine", mine).select("id", "hi", "lo", "comp", "text", F.explode(jobs).alias("p"))
             .select(F.xxhash64("comp", "p.i", "p.j").alias("job"), F.col("p.side").cast("int").alias("side"), "id", "hi", "lo", "text")
             .repartition("job").sortWithinPartitions("job"))
    verified, _ = scratch.land(_verify(dealt, shingle, threshold))
    final, _ = components(scratch, verified.select("a", "b"))
    links = verified.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("n_links"))
    classes = (sets.select("hi", "lo", "rep", "copies").join(final.select(F.col("node").alias("rep"), "comp"), "rep", "left")
               .join(links, "rep", "left").select("hi", "lo", F.coalesce("comp", "rep").alias("class_id"),
                                                  (F.col("copies") - 1).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    known = sig.select("id", "hi", "lo").join(classes, ["hi", "lo"]).select("id", "class_id", "n_copies", "n_links")
    words = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", "")) > 0
    rest = base.filter(~words | F.col("id").isNull()).select(
        "id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return known.unionByName(rest).withColumnRenamed("id", id_col)


def _tiled(rows: DataFrame, large: DataFrame, close: float, bucket: int) -> DataFrame:
    """Compare the sketches of buckets that stay over the limit at the last level, tile by tile."""
    size = large.groupBy(F.col("b").alias("node")).agg(F.ceil(F.count("*") / bucket).cast("long").alias("tiles"))
    mine = F.pmod(F.xxhash64("id"), F.col("tiles"))
    dealt = (rows.join(size, "node").withColumn("mine", mine)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .select(F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("node"), "id", "sketch"))
    return _compare_buckets(dealt, close, 1 << 30)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
