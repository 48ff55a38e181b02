"""MinHash near-dedup with an LSH forest, confirmed on full shingle sets.

1. Every text becomes its set of word shingles, a digest of the set and ``TREES * DEPTH``
   minimum hashes.  Texts with equal sets are one row from here on.
2. Each tree orders the rows by its ``DEPTH`` minimum hashes (range partitions, sorted).
   Rows whose neighbour in some order has a common prefix of ``SHALLOW`` hashes are active.
3. Active rows are ordered again with short signatures; each row is compared with the
   ``REACH`` rows after it while the prefix lasts.  So a sparse region is searched to its
   shallowest depth, and in a crowded one the longest common prefixes come first.
   Pairs that may reach the threshold connect rows to clusters.
4. The full sets of a cluster are gathered and links are confirmed exactly.  A cluster
   of more than ``BLOCK`` rows is never gathered: in every tree it is cut into regions, each as
   deep as needed to have at most ``BLOCK`` rows; those still larger at the full depth are
   dealt by hash, with the region's first row in every part.
5. Rows of such a cluster that are not yet in its main component are compared with all its
   rows of a possible size, block by block.  So every link inside a cluster counts.
6. Components of the confirmed links; the smallest doc_id of each stays.

Edge cases: null and empty texts have an empty set and link with nothing; a text of fewer
words than a shingle is one shingle; rows with a null doc_id are components of their own;
rows that repeat a doc_id are one document if their texts are equal.  Other columns are
not read by ``near_duplicates``; ``drop_near_duplicates`` returns all of them.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumflow.llm import bloom
from albumflow.llm.components import components, stars
from albumflow.llm.kernels import U64, digests, mix64, shingle_hashes, split_words, table, text_slices, word_hashes
from albumflow.llm.shared import arrow_map, arrow_schema, fresh, partitions, saved

TREES = 16
DEPTH = 8
SHALLOW = 3
REACH = 256
BLOCK = 2048
POSTINGS = 4_000_000  # up to so many shingles a block is inverted in memory
SALTS = 64  # parts of a crowded region's rows in the join with its size
SIZE_STEP = 1.26  # sets whose sizes are more than two such steps apart cannot be linked
SURELY_NOT = 0.14  # an estimate this far below the threshold (4.5 deviations) rules a pair out

_FACTORS = mix64(np.arange(1000, 1000 + TREES * DEPTH, dtype=U64)) | U64(1)


def shingle_sets(texts, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row in the batch and sorted distinct shingle hashes of each text of a column."""
    for part in text_slices(texts):
        words = split_words(part)
        hashes = word_hashes(part, words, fold=True)
        grams = shingle_hashes(hashes, size)
        for i in range(part.count):
            a, b = int(words.bounds[i]), int(words.bounds[i + 1])
            if b - a >= size:
                yield part.first + i, np.unique(grams[a : b - size + 1])
            elif b > a:
                yield part.first + i, shingle_hashes(hashes[a:b], b - a)
            else:
                yield part.first + i, np.zeros(0, dtype=U64)


def _signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum of each of the hash functions over a set, as 32-bit values."""
    out = np.empty(len(_FACTORS), dtype=U64)
    for i in range(0, len(shingles), 1 << 12):
        part = (shingles[i : i + (1 << 12), None] * _FACTORS).min(axis=0)
        out = part if i == 0 else np.minimum(out, part)
    return (out >> U64(32)).astype(np.uint32)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set), sig of every row."""
    ddl = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, sig binary"
    schema = arrow_schema(ddl)

    def run(batch):
        count, own, sig = [], [], []
        for _, s in shingle_sets(batch.column(1), size):
            count.append(len(s))
            own.append(s.tobytes())
            sig.append(_signature(s).astype(">u4").tobytes() if len(s) else None)
        pair = digests(own)
        yield table(schema, batch.column(0), count, pair[:, 0], pair[:, 1], pa.array(sig, pa.binary()))

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, ddl)


def _ordered(rows: DataFrame, short: bool) -> DataFrame:
    """(tree, path, id[, short]) of every row and tree, in sorted range partitions."""
    ddl = "tree int, path binary, id bigint" + (", short binary" if short else "")
    schema = arrow_schema(ddl)

    def explode(batch):
        if not batch.num_rows:
            return
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        low = np.ascontiguousarray(sig[:, 3::4])
        for tree in range(TREES):
            path = np.ascontiguousarray(sig[:, tree * DEPTH * 4 : (tree + 1) * DEPTH * 4])
            columns = [np.full(batch.num_rows, tree), [x.tobytes() for x in path], batch.column(0)]
            yield table(schema, *columns, *([[x.tobytes() for x in low]] if short else []))

    dealt = arrow_map(rows.select("id", "sig"), explode, ddl)
    return dealt.repartitionByRange(partitions(rows), "tree", "path", "id").sortWithinPartitions("tree", "path", "id")


def _neighbours(paths: np.ndarray, tree: np.ndarray, lag: int) -> np.ndarray:
    """Whether rows i and i + lag share the SHALLOW prefix of one tree."""
    head = paths[:, :SHALLOW]
    return (tree[lag:] == tree[:-lag]) & (head[lag:] == head[:-lag]).all(axis=1)


def _blocks(batches, keep: int) -> Iterator[tuple[list, int]]:
    """Columns of successive batches, each led by the last ``keep`` rows before it; and how many lead."""
    tail = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*(tail.to_batches() if tail is not None else []), batch])
        lead = rows.num_rows - batch.num_rows
        yield [rows.column(i) for i in range(rows.num_columns)], lead
        tail = rows.slice(max(0, rows.num_rows - keep))


def _paths(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(len(column), DEPTH)


def active(rows: DataFrame) -> DataFrame:
    """Ids of rows with a neighbour in some tree, once each.

    The first and last rows of a partition count as active: their neighbour may be next door.
    """
    schema = arrow_schema("id bigint")

    def run(batches):
        first = last = None
        for (tree, path, ids), _ in _blocks(batches, 1):
            ids, tree, path = ids.to_numpy(), tree.to_numpy(), _paths(path)
            near = np.zeros(len(ids), dtype=bool)
            if len(ids) > 1:
                both = _neighbours(path, tree, 1)
                near[1:] |= both
                near[:-1] |= both
            first, last = ids[0] if first is None else first, ids[-1]
            yield table(schema, np.unique(ids[near]))
        if last is not None:
            yield table(schema, [first, last])

    return _ordered(rows, short=False).mapInArrow(run, "id bigint").distinct()


def similar(rows: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that connect rows whose short signatures may reach the threshold."""
    least = (threshold - SURELY_NOT) * TREES * DEPTH
    schema = arrow_schema("a bigint, b bigint")

    def run(batches):
        for (tree, path, ids, short), lead in _blocks(batches, REACH):
            ids, tree, path = ids.to_numpy(), tree.to_numpy(), _paths(path)
            sig = np.frombuffer(b"".join(short.to_pylist()), np.uint8).reshape(len(ids), -1)
            a, b = [], []
            for lag in range(1, min(REACH, len(ids) - 1) + 1):
                at = np.flatnonzero(_neighbours(path, tree, lag))
                if not len(at):
                    break
                at = at[at + lag >= lead]
                agree = at[(sig[at] == sig[at + lag]).sum(axis=1) >= least]
                a.append(agree)
                b.append(agree + lag)
            if a:
                yield table(schema, *stars(ids[np.concatenate(a)], ids[np.concatenate(b)]))

    return _ordered(rows, short=True).mapInArrow(run, "a bigint, b bigint")


def _regions(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """(block, id) of the large clusters' rows: regions of each tree, as deep as needed."""
    schema = arrow_schema("cluster bigint, tree int, path binary, id bigint")

    def explode(batch):
        for tree in range(TREES):
            paths = [s[tree * DEPTH * 4 : (tree + 1) * DEPTH * 4] for s in batch.column(1).to_pylist()]
            yield table(schema, batch.column(2), np.full(batch.num_rows, tree), pa.array(paths, pa.binary()), batch.column(0))

    left = saved(arrow_map(rows.join(clusters, "id").select("id", "sig", "cluster"), explode, "cluster bigint, tree int, path binary, id bigint"))
    out = None
    for depth in range(SHALLOW, DEPTH + 1):
        keyed = left.withColumn("head", F.substring("path", 1, 4 * depth)).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
        region = ["cluster", "tree", "head"]
        large = keyed.groupBy(*region).agg(F.count("*").alias("size"), F.min("id").alias("hub")).where(F.col("size") > BLOCK)
        large = large.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        sized = saved(keyed.join(large, [*region, "salt"], "left"))
        name = F.concat_ws("/", "cluster", "tree", F.lit(depth), F.hex("head"))
        fits = sized.where("size is null").select(name.alias("block"), "id")
        out = fits if out is None else out.unionByName(fits)
        left = sized.where("size is not null").select("cluster", "tree", "path", "id")
        if left.isEmpty():
            return out
    sized = sized.where("size is not null").withColumn("parts", F.ceil(F.col("size") / (BLOCK - 1)))
    part = F.concat_ws("/", name, F.pmod(F.xxhash64("id"), "parts"))
    hubs = sized.where("id = hub").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    hubs = hubs.select(F.concat_ws("/", name, "part").alias("block"), "id")
    return out.unionByName(sized.select(part.alias("block"), "id")).unionByName(hubs).distinct()


def _leftovers(rows: DataFrame, members: DataFrame, found: DataFrame) -> DataFrame:
    """(block, id, component) that bring each row outside its cluster's main component together
    with every row of the cluster of a possible size; ``members`` are (id, cluster)."""
    of = members.join(rows.select("id", "n_shingles"), "id").join(found.toDF("id", "component"), "id", "left")
    step = F.floor(F.log("n_shingles") / F.log(F.lit(SIZE_STEP))).cast("int").alias("step")
    of = saved(of.select("cluster", "id", F.coalesce("component", "id").alias("component"), step))
    main = of.groupBy("cluster", "component").agg(F.count("*").alias("size"))
    main = main.groupBy("cluster").agg(F.max(F.struct("size", "component"))["component"].alias("main"))
    rest = saved(of.join(main, "cluster").where("component <> main").drop("main"))
    parts = F.ceil(F.count("*") / (BLOCK // 2))
    few = rest.groupBy("cluster", "step").agg(parts.alias("few"))
    few = few.select("cluster", F.col("step").alias("from"), "few", F.explode(F.array(F.col("step") - 1, "step", F.col("step") + 1)).alias("step"))
    meet = saved(few.join(of.groupBy("cluster", "step").agg(parts.alias("many")), ["cluster", "step"]))

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        side = side.withColumn(own, F.pmod(F.xxhash64("id"), own))
        side = side.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        return side.select(F.concat_ws("/", "cluster", "from", "few", "to", "many").alias("block"), "id", "component")

    ways = meet.withColumnRenamed("step", "to")
    left = dealt(rest.withColumnRenamed("step", "from").join(ways, ["cluster", "from"]), "few", "many")
    right = dealt(of.withColumnRenamed("step", "to").join(ways, ["cluster", "to"]), "many", "few")
    return left.unionByName(right).distinct()


def confirmed(sets: list[np.ndarray], percent: int, root: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links between sets with 100 * |intersection| >= percent * |union|; of those that
    do not join components more, some are left out.  Sets of equal ``root`` are in one component."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.arange(n)
    invert = len(flat) <= POSTINGS
    if invert:
        _, term, often = np.unique(flat, return_inverse=True, return_counts=True)
        holders = owner[np.argsort(term, kind="stable")]
        ends = np.cumsum(often)
        bounds = np.append(0, np.cumsum(size))
        overlap = np.bincount(owner, often[term], minlength=n) / n
        order = np.argsort(-overlap / (size + size.mean() - overlap), kind="stable")  # the most typical first
    root = np.arange(n) if root is None else root.copy()
    a, b = [], []
    later = np.ones(n, dtype=bool)
    for i in order:
        later[i] = False
        other = later & (root != root[i]) & (100 * size >= percent * size[i]) & (percent * size <= 100 * size[i])
        if not other.any():
            continue
        if invert:
            terms = term[bounds[i] : bounds[i + 1]]
            common = np.zeros(n, dtype=np.int64)
            count = often[terms]
            at = np.repeat(ends[terms] - count - (np.cumsum(count) - count), count) + np.arange(count.sum())
            common = np.bincount(holders[at], minlength=n)
        else:
            common = np.bincount(owner[np.isin(flat, sets[i])], minlength=n)
        linked = np.flatnonzero(other & (100 * common >= percent * (size + size[i] - common)))
        if len(linked):
            a.append(np.full(len(linked), i))
            b.append(linked)
            merged = np.isin(root, np.append(root[linked], root[i]))
            root[merged] = root[merged].min()
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _confirmed_links(docs: DataFrame, blocks: DataFrame, count: int, size: int, percent: int) -> DataFrame:
    """Exact links (a, b) within each of (block, id, component), from the documents' full sets."""
    ids = blocks.select(F.col("id").alias("key")).distinct()
    spread = docs.sparkSession.sparkContext.broadcast(bloom.build(ids, count))
    set_schema, schema = arrow_schema("id bigint, shingles binary"), arrow_schema("a bigint, b bigint")

    def fetch(batch):
        batch = batch.filter(batch.column(0).is_valid())
        batch = batch.filter(pa.array(spread.value(batch.column(0).to_numpy(zero_copy_only=False))))
        sets = [s.tobytes() for _, s in shingle_sets(batch.column(1), size)]
        yield table(set_schema, batch.column(0), pa.array(sets, pa.binary()))

    def solve(ids: list[int], joined: list[int], sets: list[bytes]):
        known = dict(zip(ids, zip(joined, sets, strict=True), strict=True))  # rows that repeat a document are one
        names = np.array(list(known))
        root = np.array([x[0] for x in known.values()])
        a, b = confirmed([np.frombuffer(x[1], U64) for x in known.values()], percent, root)
        return table(schema, names[a], names[b])

    def run(batches):
        block, ids, joined, sets = None, [], [], []
        for batch in batches:
            for name, i, component, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != block:
                    if len(ids) > 1:
                        yield solve(ids, joined, sets)
                    block, ids, joined, sets = name, [], [], []
                ids.append(i)
                joined.append(component)
                sets.append(s)
        if len(ids) > 1:
            yield solve(ids, joined, sets)

    sets = arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), fetch, "id bigint, shingles binary")
    rows = sets.join(blocks, "id").select("block", "id", "component", "shingles")
    dealt = rows.repartition(partitions(docs), "block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs."""
    docs = docs.select("doc_id", "text")
    signed_docs = saved(signatures(docs, size))
    same = ["d1", "d2", "n_shingles"]
    filled = signed_docs.where("n_shingles > 0 and doc_id is not null")
    rows = saved(filled.groupBy(*same).agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")))
    near = rows.join(active(rows), "id", "left_semi").select("id", "sig")
    clusters = saved(components(similar(saved(near), percent / 100)).toDF("id", "cluster"))
    clusters = clusters.unionByName(clusters.select(F.col("cluster").alias("id"), "cluster").distinct()).distinct()
    sizes = saved(clusters.groupBy("cluster").agg(F.count("*").alias("size")))
    total, largest = sizes.agg(F.sum("size"), F.max("size")).first()
    members = clusters.join(sizes, "cluster")
    blocks = members.where(F.col("size") <= BLOCK).select(F.col("cluster").cast("string").alias("block"), "id")
    crowded = members.where(F.col("size") > BLOCK).select("id", "cluster")
    if (largest or 0) > BLOCK:
        blocks = blocks.unionByName(_regions(rows, crowded))
    blocks = saved(blocks.withColumn("component", F.col("id")))
    found = components(_confirmed_links(docs, blocks, total or 0, size, percent))
    if (largest or 0) > BLOCK:
        more = saved(_leftovers(rows, crowded, found))
        if not more.isEmpty():
            links = _confirmed_links(docs, more, total, size, percent)
            found = components(links.unionByName(found.toDF("a", "b")))
    groups = rows.select(*same, "id").join(found.toDF("id", "component"), "id", "left")
    groups = groups.select(*same, F.least(F.coalesce("component", "id"), "id").alias("component"))
    out = signed_docs.drop("sig").join(groups, same, "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Rows of docs, all columns, without those whose component has a smaller doc_id."""
    gone = fresh(docs.columns, "dropped_id")
    found = near_duplicates(docs, size, percent).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(found, docs["doc_id"] == found[gone], "left_anti")
