"""N-gram Jaccard join over a token-group matrix.

Documents become sets of word n-gram hashes; equal sets are one. A set's prefix holds so many of its tokens, in a global
order that puts frequent tokens last, that two sets at the threshold share a number of prefix tokens that grows with their
size (`needed`). A set joins the group of its size class and of one of its SKETCH smallest hashes, the one that is the smallest
of most sets, so that near copies, however many, fall into few groups. The token-group matrix has a row for each prefix token
of a group's union. The overlap of two groups' unions bounds that of any two of their members, so only group pairs that
reach the bound, in size classes that fit, are opened. An opened pair is compared in cells of at most BLOCK sets from each
side, and a cell returns a spanning forest of its links, never the pairs. Components of the forests are found by joins.

The order comes from a table of COUNTERS hashed counts, whose size is fixed; any order gives the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._core import LOWER, SLICE_BYTES, Texts, column, grams, looked_up, materialize, mix, per_row, slices, texts, unused, words

WORDS = 5
PERCENT = 80
COUNTERS = 1 << 20
COUNTER_BLOCK = 1 << 14
BLOCK = 256
OVERLAP = 2
SLOPE = 32
SKETCH = 4
SQUARE = 512
LIST = 512


def shingle_runs(t: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of n words, repeats included, and the rows' bounds. Fewer words are one run."""
    w = words(Texts(LOWER[t.data], t.offsets))
    h, at = grams(w, n)
    size = np.diff(w.first)
    runs = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    bounds = np.concatenate([[0], np.cumsum(runs)])
    out = np.zeros(int(bounds[-1]), np.uint64)
    whole = np.repeat(size >= n, runs)
    out[whole] = h
    for k in range(1, n):
        short = np.flatnonzero(size == k)
        if len(short):
            one = np.full(len(short), k, np.uint64)
            for j in range(k):
                one = mix(one + w.hash[w.first[short] + j])
            out[bounds[short]] = one
    return out, bounds


def shingles(t: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row's runs of n words, sorted in the row, and the rows' bounds."""
    h, bounds = shingle_runs(t, n)
    ends = bounds.tolist()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    keep[bounds[:-1][np.diff(bounds) > 0]] = True
    return h[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def needed(size: np.ndarray, percent: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """What a set of a size shares at least with one it links to, and how many of these lie in both prefixes; neither falls with the size."""
    least = -(-percent * size // 100)
    return least, np.minimum(least, overlap + size // SLOPE)


def token_counts(docs: DataFrame, n: int) -> np.ndarray:
    """COUNTERS hashed counts of all shingles of all documents, repeats included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in slices(batch):
                h, _ = shingle_runs(texts(part.column("text")), n)
                total += np.bincount((h % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        if total.any():
            blocks = total.astype("<u4").reshape(-1, COUNTER_BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], names=["block", "n"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(COUNTER_BLOCK, np.int64)
        for x in rows.column("n"):
            total += np.frombuffer(x.as_buffer(), "<u4")
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([total.tobytes()], pa.binary())})

    parts = docs.select("text").mapInArrow(count, "block int, n binary").groupBy("block").applyInArrow(add, "block int, n binary").collect()
    out = np.zeros((COUNTERS // COUNTER_BLOCK, COUNTER_BLOCK), np.int64)
    for r in parts:
        out[r["block"]] = np.frombuffer(r["n"], np.int64)
    return out.ravel()


def document_sets(docs: DataFrame, n: int, percent: int, counts: np.ndarray, overlap: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (d1, d2), its prefix tokens and its smallest hashes."""
    usual = counts.sum() / COUNTERS
    heavy = np.where(counts > usual + 8 * np.sqrt(usual + 1) + 8, np.log2(np.maximum(counts, 1)) * 4, 0).astype(np.uint8)  # COUNTERS bytes
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, bounds = shingles(texts(part.column("text")), n)
                size = np.diff(bounds)
                row = np.repeat(np.arange(len(size)), size)
                weight = shared.value[(h % np.uint64(COUNTERS)).astype(np.int64)]
                order = np.argsort(row << 8 | weight, kind="stable")  # a row's hashes are sorted
                place = np.arange(len(h)) - bounds[row]
                least, common = needed(size, percent, overlap)
                prefix = size - least + common
                front = h[order][place < prefix[row]].view(np.int64)
                ends = np.concatenate([[0], np.cumsum(prefix)]).astype(np.int32)
                low = np.minimum(size, SKETCH)
                sketch = h[np.repeat(bounds[:-1] - np.cumsum(low) + low, low) + np.arange(low.sum())].view(np.int64)  # rows are sorted by hash
                lows = np.concatenate([[0], np.cumsum(low)]).astype(np.int32)
                d = [per_row(mix(h + np.uint64(salt)), bounds).view(np.int64) for salt in (1, 7)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size), *map(pa.array, d), pa.ListArray.from_arrays(pa.array(ends), pa.array(front)), pa.ListArray.from_arrays(pa.array(lows), pa.array(sketch))],
                    names=["doc_id", "n_shingles", "d1", "d2", "prefix", "sketch"],
                )

    return docs.mapInArrow(describe, "doc_id long, n_shingles long, d1 long, d2 long, prefix array<long>, sketch array<long>")


def unions(fronts: DataFrame) -> DataFrame:
    """token, g, size from rows (g, size, prefix); the rows of a batch are combined, so that a hot group is sent about once a batch."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            token = lists.flatten().to_numpy()
            at = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            _, one = np.unique(token.view(np.uint64) ^ mix(column(batch, "g").view(np.uint64))[at], return_index=True)
            rows = pa.array(at[one])
            yield pa.RecordBatch.from_arrays([pa.array(token[one]), batch.column("g").take(rows), batch.column("size").take(rows)], names=["token", "g", "size"])

    return fronts.mapInArrow(combine, "token long, g long, size int")


def shared_tokens(matrix: DataFrame) -> DataFrame:
    """a, b, size, overlap: for groups a, b of the same or neighbouring size classes how many tokens of the matrix they share.

    matrix: distinct token, g, size, dealt out by token, which the join and the counts keep to. A token of more than SQUARE groups is a
    matrix of its own, cut into squares of about SQUARE groups a side, so that one key holds at most SQUARE ** 2 pairs, however frequent
    the token; only the rows of such tokens are sent once more.
    """
    counted = matrix.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("token")))

    def sides(rows: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
        return rows.select("token", *keys, F.col("g").alias("a"), F.col("size").alias("size_a")), rows.select("token", *keys, F.col("g").alias("b"), F.col("size").alias("size_b"))

    a, b = sides(counted.where(F.col("n") <= SQUARE))
    shared = a.join(b, "token")
    heavy = counted.where(F.col("n") > SQUARE).withColumn("squares", F.ceil(F.col("n") / SQUARE).cast("int"))
    a, b = sides(heavy, "squares")
    every = F.explode(F.sequence(F.lit(0), F.col("squares") - 1))
    own = lambda c: F.pmod(F.xxhash64(c), F.col("squares")).cast("int")
    a = a.withColumn("row", own("a")).withColumn("column", every).drop("squares")
    b = b.withColumn("column", own("b")).withColumn("row", every).drop("squares")
    shared = shared.unionByName(a.join(b, ["token", "row", "column"]).drop("row", "column")).where("a < b AND abs(size_a - size_b) <= 1")
    return shared.groupBy("a", "b", F.least("size_a", "size_b").alias("size")).agg(F.count(F.lit(1)).alias("overlap"))


def linked_forest(sizes: np.ndarray, tokens: list[np.ndarray], first: int, percent: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between sets [0, first) and [first, ...), or among all if first is their number."""
    total = len(sizes)
    both = first < total
    flat = np.concatenate(tokens)
    owner = np.repeat(np.arange(total), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    name = np.cumsum(new) - 1
    shared = np.bincount(name)[name] > 1
    name, owner = np.unique(name[shared], return_inverse=True)[1], owner[shared]
    common = np.zeros((total, total), np.float32)
    for lo in range(0, int(name.max(initial=-1)) + 1, 4096):
        cut = slice(*np.searchsorted(name, [lo, lo + 4096]))
        x = np.zeros((total, min(4096, int(name[-1]) - lo + 1)), np.float32)
        x[owner[cut], name[cut] - lo] = 1
        common += x @ x.T
    common = np.rint(common).astype(np.int64)
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    if both:
        linked[:first, :first] = linked[first:, first:] = False
    edges, seen = [], np.zeros(total, bool)
    for root in range(total):
        if not seen[root]:
            seen[root], queue = True, [root]
            while queue:
                for k in np.flatnonzero(linked[queue.pop()] & ~seen).tolist():
                    seen[k] = True
                    queue.append(k)
                    edges.append((root, k))
    return edges


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, packed (the text compressed) and size (its bytes): what a text's hashes take on disk is several times as much."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            for part in slices(batch):
                t = texts(part.column("text"))
                data, ends = memoryview(t.data), t.offsets.tolist()
                made = [codec.compress(data[x:y], asbytes=True) for x, y in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made, pa.binary()), pa.array(np.diff(t.offsets))], names=["doc_id", "packed", "size"])

    return docs.select("doc_id", "text").mapInArrow(pack, "doc_id long, packed binary, size long")


def unpacked_shingles(batch: pa.RecordBatch, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each row of a batch with packed texts, about SLICE_BYTES of text at a time."""
    codec = pa.Codec("zstd")
    column, sizes = batch.column("packed"), batch.column("size").to_numpy()
    ends = np.concatenate([[0], np.cumsum(sizes)])
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + SLICE_BYTES, "right")) - 1)
        data = b"".join(codec.decompress(column[i].as_buffer(), int(sizes[i]), asbytes=True) for i in range(start, stop))
        h, bounds = shingles(Texts(np.frombuffer(data, np.uint8), ends[start : stop + 1] - ends[start]), n)
        yield from (h[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True))
        start = stop


def open_cells(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Edges a, b from rows (cell, side, doc_id, packed, size), which come sorted by cell in each partition."""

    def compare(cell: list[tuple]) -> list[tuple[int, int]]:
        left = [r for r in cell if r[0] == 0]
        right = [r for r in cell if r[0] == 1]
        own = left + right
        tokens = [r[2] for r in own]
        edges = linked_forest(np.array([len(x) for x in tokens]), tokens, len(left), percent)
        return [(own[a][1], own[b][1]) for a, b in edges]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell, edges = None, [], []
        for batch in batches:
            for k, *row in zip(*(batch.column(c).to_pylist() for c in ("cell", "side", "doc_id")), unpacked_shingles(batch, n), strict=True):
                if k != key:
                    edges += compare(cell) if len(cell) > 1 else []
                    key, cell = k, []
                cell.append(row)
            if edges:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(edges, columns=["a", "b"]))
                edges = []
        edges += compare(cell) if len(cell) > 1 else []
        if edges:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(edges, columns=["a", "b"]))

    return rows.repartition(F.col("cell")).sortWithinPartitions("cell", "side", "doc_id").mapInArrow(each, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the nodes of edges a, b; each round points nodes to the smallest label near them and then to that label's own."""
    both = materialize(edges.union(edges.select("b", "a")).where("a <> b").distinct())
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        pulled = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = pulled.select(F.col("node").alias("label"), F.col("label").alias("up"))
        after = materialize(pulled.join(up, "label", "left").select("node", "old", F.least("label", "up").alias("label")))
        if after.where("label <> old").isEmpty():
            return after.select("node", F.col("label").alias("component"))
        labels = after.select("node", "label")


def ngram_jaccard_join(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, overlap: int = OVERLAP, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Documents link when 100 * |intersection| >= percent * |union| of their sets. Null, empty and wordless texts have no
    shingles and link with nothing; equal sets link; rows that repeat a doc_id are one document, whose texts all count for
    its links. Rows without an id link with nothing and have a null component. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counts = token_counts(rows, n)
    described = materialize(document_sets(rows, n, percent, counts, overlap))
    key = ["d1", "d2", "n_shingles"]
    sets = described.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"))
    sets = materialize(sets)
    popular = sets.groupBy(F.element_at("sketch", 1).alias("token")).agg(F.count(F.lit(1)).alias("n"))
    choice = sets.select("rep", F.explode("sketch").alias("token")).join(popular, "token", "left")
    choice = choice.groupBy("rep").agg(F.max(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best"))
    sets = sets.drop("sketch").join(choice.select("rep", "best.token"), "rep")
    # Sets at the threshold differ little in size, so size classes keep apart what shares a common passage only.
    step = 100 / percent
    sets = sets.withColumn("size", F.floor(F.log("n_shingles") / float(np.log(step))).cast("int"))
    sets = materialize(sets.withColumn("g", F.xxhash64("token", "size")).drop("token"))

    group = sets.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    group = materialize(group.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")))
    fronts = described.select(F.col("doc_id").alias("rep"), "d1", "d2", "prefix").join(sets.select("rep", "d1", "d2", "g", "size"), ["rep", "d1", "d2"])
    matrix = unions(fronts.select("g", "size", "prefix")).repartition(F.col("token")).distinct()
    bound = shared_tokens(matrix)
    # The smallest set of a size class needs the least; the tiny term keeps rounding on the safe side.
    smallest = F.floor(F.pow(F.lit(step), "size") - 1e-6)
    need = F.least(F.ceil(percent * smallest / 100), overlap + F.floor(smallest / SLOPE))
    fit = bound.where(F.col("overlap") >= need).select("a", "b")
    pairs = fit.join(group.select(F.col("g").alias("a"), F.col("n").alias("n_a")), "a").join(group.select(F.col("g").alias("b"), F.col("n").alias("n_b")), "b")
    # The larger group is the host; the sets of all its guests are dealt to cells together, so that it is sent once for each `block` of them.
    first = F.col("n_a") >= F.col("n_b")
    pairs = materialize(
        pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("host"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("guest"))
    )
    guests = pairs.join(group.select(F.col("g").alias("guest"), F.col("n").alias("sets")), "guest").groupBy("host").agg(F.sum("sets").alias("sets"))
    hosts = guests.join(group.select(F.col("g").alias("host"), "blocks"), "host").select("host", "blocks", F.ceil(F.col("sets") / block).cast("int").alias("chunks"))
    across = hosts.withColumn("part", F.explode(F.expr("sequence(0, blocks - 1)")))
    within = group.where("n > 1").withColumn("i", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("j", F.explode(F.expr("sequence(i, blocks - 1)")))
    within = within.withColumn("cell", F.xxhash64("g", "i", "j"))

    placed = sets.join(group.select("g", "blocks"), "g").select("rep", "g", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("part"))
    chunk = F.xxhash64(F.col("host"), F.col("part"), F.col("chunk"), F.lit("guests"))
    as_host = across.withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))).select(F.col("host").alias("g"), "part", chunk.alias("cell"), F.lit(0).alias("side"))
    as_left = within.select("g", F.col("i").alias("part"), "cell", F.lit(0).alias("side"))
    as_right = within.where("i <> j").select("g", F.col("j").alias("part"), "cell", F.lit(1).alias("side"))
    members = placed.join(as_host.unionByName(as_left).unionByName(as_right), ["g", "part"]).select("rep", "cell", "side")
    as_guest = placed.select("rep", F.col("g").alias("guest")).join(pairs, "guest").join(across, "host")
    as_guest = as_guest.withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(1)), "chunks").cast("int")).select("rep", chunk.alias("cell"), F.lit(1).alias("side"))
    # A text is sent anew for each LIST of its cells, so that no row's list grows with a family.
    lists = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("rep")) / LIST).cast("int")
    wanted = members.unionByName(as_guest).withColumn("list", F.pmod(F.xxhash64("cell"), lists)).groupBy("rep", "list").agg(F.collect_list(F.struct("cell", "side")).alias("cells"))

    opened = packed(rows).join(wanted, F.col("doc_id") == F.col("rep")).select("doc_id", "packed", "size", F.explode("cells").alias("c"))
    found = components(materialize(open_cells(opened.select("c.cell", "c.side", "doc_id", "packed", "size"), n, percent)))

    named = materialize(sets.join(found, F.col("rep") == F.col("node"), "left").select(*key, "copies", F.coalesce("component", "rep").alias("component_id")))
    linked = described.drop("prefix", "sketch").where("n_shingles > 0 AND doc_id IS NOT NULL")
    alone = described.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return looked_up(linked, named, key, "doc_id", "copies").select("doc_id", "n_shingles", "component_id").unionByName(alone)


def keep_one_of_each(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that are the smallest doc_id of their component, with all their columns, whatever their names; rows without an id stay."""
    name = unused(docs, "of")
    gone = materialize(ngram_jaccard_join(docs, n, percent).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct())
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone[name], "left_anti")
