"""Near-duplicate texts: a chosen-path set similarity join over minwise tokens, then exact confirmation.

A text is the set of its word shingles, sketched by K minwise hashes; the pairs (place, minwise value) are its
tokens. Texts of equal sets are one class from the start. A node of a tree is a set of classes; it branches by
two of its places, which are chosen by the node's own hash, so that classes with equal values there meet in a
child. Small nodes are compared exhaustively (by sketch), large ones branch on. Two sets of Jaccard
similarity s stay together in some node of a tree with probability 1 - q, q = (1 - s + s*q)^2 (0.97 at 0.85)
at any depth, and independent trees are repeated up to the target recall. Large nodes whose members are alike
on average leave the tree as candidate groups, as do nodes that are still large at the last depth: what members share
would carry them on together for ever. Candidate groups are then confirmed on the full sets, whatever their size;
nothing is linked by its sketch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, anew, checkpoint, distinct, id_and_text, mix, slices, texts_of, word_hashes
from .components import connected_components

SHINGLE = 5
THRESHOLD = 80
K = 96
#: A node of at most so many classes is compared exhaustively.
LEAF = 24
DEPTH = 4
#: A large node branches no further if its members' mean agreement with its head is so much of the threshold.
ALIKE = 0.9
RECALL = 0.9999
#: A candidate group is confirmed in blocks of at most about so many texts and shingles.
BLOCK_TEXTS, BLOCK_SHINGLES = 128, 1_000_000

_SEEDS = mix(np.arange(1, K + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)


def trees(threshold: int, recall: float = RECALL) -> int:
    """Independent trees for the target recall at the threshold (two branches at each node)."""
    s, q = threshold / 100, 0.0
    for _ in range(1000):
        q = (1 - s + s * q) ** 2
    return max(1, math.ceil(math.log(1 - recall) / math.log(min(max(q, 1e-12), 0.999))))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes; fewer than n words are one shingle."""
    if not len(hashes):
        return hashes
    with np.errstate(over="ignore"):
        m = min(n, len(hashes))
        out = mix(hashes[: len(hashes) - m + 1])
        for i in range(1, m):
            out = mix(out * np.uint64(3) + hashes[i : len(hashes) - m + 1 + i])
        return distinct(out + np.uint64(n - m))


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    words, size = word_hashes(texts)
    ends = np.cumsum(size).tolist()
    return [shingles(words[a:b], n) for a, b in zip([0, *ends], ends)]


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of K minwise values (32 bits) of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), K), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(K):
            x = flat * _SEEDS[k]
            x ^= x >> np.uint64(32)
            out[:, k] = np.minimum.reduceat(((x * _SEEDS[(k + 7) % K]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def sketch(docs: DataFrame, n: int) -> DataFrame:
    """Rows (doc_id, n_shingles, mark binary, sketch array<int>); mark and sketch are null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=1 << 20):
            sets = shingle_sets(texts_of(batch), n)
            some = [s for s in sets if len(s)]
            values = sketches(some).view(np.int32) if some else np.zeros((0, K), np.int32)
            ends = np.concatenate([[0], np.cumsum([K if len(s) else 0 for s in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()), mask=pa.array([not len(s) for s in sets]))
            marks = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary()), lists], ["doc_id", "n_shingles", "mark", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, mark binary, sketch array<int>")


def _children(members: DataFrame, classes: DataFrame) -> DataFrame:
    """members: node, id. Each node's two children by the values at two places that its hash chooses."""
    at = members.join(classes.select("id", "sketch"), "id")
    first = F.pmod(F.xxhash64("node"), F.lit(K)).cast("int")
    step = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(K - 1)).cast("int") + 1
    places = F.explode(F.array(first, F.pmod(first + step, F.lit(K))))
    return at.select("id", "node", "sketch", places.alias("place")).select(F.xxhash64("node", "place", F.element_at("sketch", F.col("place") + 1)).alias("node"), "id")


def _alike(large: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Rows (node, alike) of nodes whose members agree with the head, on average, nearly as much as links ask for.

    Branching would carry such members on together in most children, so the whole node is a candidate group now.
    """
    heads = large.select(anew("head")).distinct()
    led = heads.join(classes.select(F.col("id").alias("head"), F.col("sketch").alias("led")), "head").select(anew("head"), "led")
    met = large.join(classes.select("id", "sketch"), "id").join(led, "head")
    same = F.aggregate(F.zip_with("sketch", "led", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    shared = met.select(anew("node"), same.alias("same")).groupBy("node").agg(F.avg("same").alias("same"))
    return shared.where(F.col("same") >= ALIKE * threshold / 100 * K).select(anew("node"), F.lit(True).alias("alike"))


def _compare(threshold: int):
    """Links that hold a small node's similar classes together, by sketch; rows come sorted by node."""
    s = threshold / 100
    least = (s - 4.5 * math.sqrt(s * (1 - s) / K)) * K

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def links(t: pa.Table) -> pa.RecordBatch:
            node, ids, size = (t.column(c).to_numpy() for c in ("node", "id", "n_shingles"))
            values = np.concatenate([c.flatten().to_numpy() for c in t.column("sketch").chunks]).reshape(len(node), K)
            pairs = []
            for d in range(1, len(node)):
                near = np.flatnonzero(node[d:] == node[:-d])
                if not len(near):
                    break
                small, large = np.minimum(size[near], size[near + d]), np.maximum(size[near], size[near + d])
                near = near[100 * small >= threshold * large]
                same = (values[near] == values[near + d]).sum(1)
                pairs += [(int(i), int(i) + d) for i in near[same >= least]]
            forest = Forest(len(node))
            kept = [(i, j) for i, j in pairs if ids[i] != ids[j] and forest.join(i, j)]
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in kept], pa.int64()), pa.array([ids[j] for _, j in kept], pa.int64())], ["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            node = t.column("node").to_numpy()
            cut = int(np.searchsorted(node, node[-1], side="left")) if len(node) else 0
            if cut:
                yield links(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield links(held)

    return run


def candidates(classes: DataFrame, threshold: int, recall: float = RECALL) -> DataFrame:
    """Links (a, b) between classes (id, n_shingles, sketch) that make up candidate groups."""
    roots = F.array(*[F.struct(F.lit(t).alias("tree"), F.lit(p).alias("place")) for t in range(trees(threshold, recall)) for p in (2 * t, 2 * t + 1)])
    members = classes.select("id", "sketch", F.explode(roots).alias("r")).select(F.xxhash64(F.col("r.tree"), F.col("r.place"), F.element_at("sketch", F.col("r.place") + 1)).alias("node"), "id")
    found, large = [], None
    for depth in range(DEPTH):
        members = checkpoint(_children(large, classes) if depth else members)
        sizes = members.groupBy("node").agg(F.count("*").alias("count"), F.min("id").alias("head")).where("count > 1").select(anew("node"), "count", "head")
        full = checkpoint(members.join(sizes, "node"))
        small = full.where(F.col("count") <= LEAF).select("node", "id").join(classes.select("id", "n_shingles", "sketch"), "id")
        found.append(small.repartition("node").sortWithinPartitions("node").mapInArrow(_compare(threshold), "a long, b long"))
        large = full.where(F.col("count") > LEAF).select("node", "id", "head")
        if not large.limit(1).count():
            break
        alike = F.lit(True)
        if depth < DEPTH - 1:
            large = checkpoint(large.join(_alike(large, classes, threshold), "node", "left"))
            alike = F.col("alike").isNotNull()
        found.append(large.where(alike).select(F.col("id").alias("a"), F.col("head").alias("b")).where("a <> b"))
        large = large.where(~alike).select("node", "id")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def _links_of(docs: DataFrame, parts: DataFrame, n: int, threshold: int) -> DataFrame:
    """Rows (root, a, b): links of Jaccard similarity threshold % or more on full sets, for each part of a group.

    parts: root, x, y, id, mark, new. All pairs of a part with a new text count; the links hold what they link together.
    """
    met = docs.join(parts, docs["doc_id"] == parts["id"]).select("root", "x", "y", "new", "id", "mark", "text")

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, seen = [], set()
        for batch in batches:
            for part in slices([batch]):
                for i, mark, new, s in zip(part.column("id").to_pylist(), part.column("mark").to_pylist(), part.column("new").to_pylist(), shingle_sets(texts_of(part), n)):
                    # an id that is repeated with other texts brings those along
                    if len(s) and (i, mark) not in seen and xxhash.xxh3_128_digest(s.tobytes()) == mark:
                        seen.add((i, mark))
                        rows.append((new, i, s))
        rows.sort(key=lambda r: r[0])
        links = [(rows[i][1], rows[j][1]) for i, j in linked([s for *_, s in rows], threshold, sum(not new for new, *_ in rows))]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(links), pa.int64()), pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["root", "a", "b"])

    return met.groupBy("root", "x", "y").applyInArrow(run, "root long, a long, b long")


def _blocks(texts: str, shingles: str) -> Column:
    return F.greatest(F.ceil(F.col(texts) / BLOCK_TEXTS), F.ceil(F.col(shingles) / BLOCK_SHINGLES), F.lit(1)).cast("int")


def confirm(docs: DataFrame, groups: DataFrame, n: int, threshold: int) -> DataFrame:
    """Links (a, b) of Jaccard similarity threshold % or more on full sets that hold linked texts together.

    groups: id, root, n_shingles, mark. A group is dealt into blocks. First each block is compared with itself and
    with the group's first block, so that each text moves twice at most: near copies are one component then, however
    many they are. Only where a group is not, texts outside its largest component are compared with all others, in
    pairs of blocks; those of the first block have met all others already.
    """
    total = groups.groupBy("root").agg(F.count("*").alias("texts"), F.sum("n_shingles").alias("shingles")).select(anew("root"), _blocks("texts", "shingles").alias("blocks"))
    dealt = groups.join(total, "root").withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")).cast("int"))
    with_first = F.explode(F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))).alias("y")
    first = checkpoint(_links_of(docs, dealt.select("root", F.lit(0).alias("x"), "id", "mark", "block", with_first).withColumn("new", F.col("block") == F.col("y")), n, threshold))
    many = dealt.where("blocks > 1")
    if not many.limit(1).count():
        return first.select("a", "b")
    known = connected_components(first.join(many.select(anew("root")).distinct(), "root", "left_semi")).select("id", F.col("root").alias("part"))
    parted = many.join(known, "id", "left").withColumn("part", F.coalesce("part", "id"))
    sizes = parted.groupBy("root", "part").agg(F.count("*").alias("size")).groupBy("root").agg(F.max_by("part", "size").alias("core"), F.count("*").alias("parts")).where("parts > 1")
    open_ = checkpoint(parted.where("block > 0").join(sizes.select(anew("root"), "core"), "root").withColumn("rest", F.col("part") != F.col("core")))
    if not open_.where("rest").limit(1).count():
        return first.select("a", "b")
    size = lambda name, of: F.count_if(of).alias(f"{name}_texts"), lambda name, of: F.sum(F.when(of, F.col("n_shingles")).otherwise(0)).alias(f"{name}_shingles")
    both = [f(name, of) for name, of in (("rest", F.col("rest")), ("core", ~F.col("rest"))) for f in size]
    counts = open_.groupBy("root").agg(*both).select(anew("root"), _blocks("rest_texts", "rest_shingles").alias("r"), _blocks("core_texts", "core_shingles").alias("c"))
    met = open_.join(counts, "root")
    # blocks 0 to r-1 are the rest's, those from r on the core's; each of the rest's meets all
    own = F.pmod(F.xxhash64("id", F.lit(3)), F.when(F.col("rest"), F.col("r")).otherwise(F.col("c"))) + F.when(F.col("rest"), 0).otherwise(F.col("r"))
    met = met.withColumn("own", own.cast("int")).withColumn("other", F.explode(F.when(F.col("rest"), F.sequence(F.lit(0), F.col("r") + F.col("c") - 1)).otherwise(F.sequence(F.lit(0), F.col("r") - 1))))
    pairs = met.select("root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "id", "mark", F.col("own").alias("block"))
    later = _links_of(docs, pairs.select("root", "x", "y", "id", "mark", (F.col("block") == F.col("x")).alias("new")), n, threshold)
    return first.union(later).select("a", "b")


def linked(sets: list[np.ndarray], threshold: int, old: int = 0) -> list[tuple[int, int]]:
    """Links that make up the components of the sets' similarity graph, each by exact intersection; none between the
    first ``old`` sets."""
    n = len(sets)
    if n < 2:
        return []
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    same = flat[1:] == flat[:-1]
    keep = np.zeros(len(flat), bool)  # shingles of one text only count in its size
    keep[1:] |= same
    keep[:-1] |= same
    flat, owner = flat[keep], owner[keep]
    begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    run = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(flat))))
    end = np.append(begin[1:], len(flat))
    by = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[by], np.arange(n + 1))
    forest, out = Forest(n), []
    for i in range(old, n):
        if forest.parts == 1:
            break
        runs = run[by[cuts[i] : cuts[i + 1]]]
        if not len(runs):
            continue
        length = end[runs] - begin[runs]
        at = np.repeat(begin[runs] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        both = np.bincount(owner[at], minlength=n)
        hits = np.flatnonzero(100 * both >= threshold * (size + size[i] - both))
        out += [(i, int(j)) for j in hits if j != i and forest.join(i, int(j))]
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of docs.

    Texts link if their sets of word shingles have a Jaccard similarity of threshold % or more. component_id
    is the smallest id reachable, kept whether it is the row's own. Null, empty and blank texts have no
    shingles and link with nothing; texts of fewer words than a shingle are one shingle. Rows that share an
    id are one document whatever their texts. A null id links with nothing, has a null component and is kept.
    """
    plain = id_and_text(docs, id_col, text_col)
    rows = checkpoint(sketch(plain, shingle))
    has = rows.where("mark is not null and doc_id is not null")
    classes = checkpoint(has.groupBy("mark").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))
    groups = connected_components(candidates(classes, threshold, recall))
    marked = checkpoint(groups.join(classes.select("id", "mark", "n_shingles"), "id"))
    links = confirm(plain, marked, shingle, threshold)
    # an id's texts of other classes are the same document
    same = has.select("doc_id", "mark").distinct().join(classes.select("mark", "id"), "mark").where("doc_id <> id")
    repeated = has.groupBy("doc_id").agg(F.min("mark").alias("m"), F.max("mark").alias("n")).where("m <> n").select("doc_id")
    links = links.union(same.join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    roots = connected_components(links)
    by_mark = classes.select("mark", "id").join(roots, "id", "left").select("mark", F.coalesce("root", "id").alias("root"))
    out = rows.join(by_mark, "mark", "left").join(roots.select(F.col("id").alias("doc_id"), F.col("root").alias("own")), "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.least(F.coalesce("own", "root", "doc_id"), F.coalesce("root", "doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, threshold=85)
