"""Near duplicates of embeddings by Euclidean p-stable hashing.

Vectors are normalised; vectors of one direction are one class. A table's key is made of `width`-quantised Gaussian projections;
how many there are follows from the number of classes, and the number of tables from the recall asked of a pair at the threshold
itself (nearer pairs are found almost surely). Then cosines are exact, in double precision:

1. A class within half the threshold's angle of the first class of one of its buckets joins that one's ball. All members of a ball link, by the
   triangle inequality, and none of their pairs is made; so a hot family of near copies is a few balls.
2. Balls that meet in a bucket are candidates, unless signs of SIGNS more projections say that they are far apart (beyond six standard deviations).
   The angle between the centres and both radii decide whether all members link or none; two balls of one class each are always decided.
3. The other pairs of balls are opened: the members of the smaller ones are compared with those of the larger in cells of at most
   about BLOCK + BLOCK vectors, which return numbers of links and which balls are linked, never pairs of members.

Many balls that are neighbours without lying within half the threshold's angle of each other cost their pairs, as any count of links does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._core import looked_up, materialize, mix
from .ngram_join import components

COSINE = 0.9
RECALL = 0.99
WIDTH = 2.0
#: Classes of random direction that a bucket holds on average.
BUCKET = 32
SIGNS = 256
BLOCK = 1024
#: A bucket of more balls is joined in squares of about this many a side.
SQUARE = 2048
SEED = 20240611
BYTES = 8 << 20
_EDGE = 1e-9
_SKETCH = [f"s{k}" for k in range(SIGNS // 64)]


def collision(distance: float, width: float) -> float:
    """Probability that one quantised projection of two vectors at this distance is the same."""
    u = width / distance
    return math.erf(u / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * u) * (1 - math.exp(-u * u / 2))


class Tables(NamedTuple):
    """projections of each of `number` tables."""

    projections: int
    number: int

    @staticmethod
    def of(classes: int, cosine: float, recall: float, width: float) -> Tables:
        far, near = collision(math.sqrt(2), width), collision(math.sqrt(2 - 2 * cosine), width)
        k = max(2, round(math.log(max(classes, 1) / BUCKET) / -math.log(far))) if classes > BUCKET else 2
        return Tables(k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k))))


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x (little-endian doubles of length 1) of each row; x is null where a vector can't be compared."""

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            value = np.where(pc.is_null(flat).to_numpy(zero_copy_only=False), np.nan, pc.fill_null(flat, 0).to_numpy(zero_copy_only=False))
            x: list[bytes | None] = [None] * len(size)
            begin = np.cumsum(size) - size
            for d in np.unique(size[size > 0]).tolist():
                rows = np.flatnonzero(size == d)
                m = value[begin[rows][:, None] + np.arange(d)]
                most = np.abs(m).max(axis=1)
                good = np.isfinite(most) & (most > 0)
                m = m[good] / most[good, None]
                m = m / np.sqrt((m * m).sum(axis=1))[:, None] + 0.0  # -0.0 becomes 0.0
                for r, own in zip(rows[good].tolist(), m, strict=True):
                    x[r] = own.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(x, pa.binary())], names=["vec_id", "x"])

    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(normalise, "vec_id long, x binary")


def matrices(blobs: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their vectors, by number of dimensions and in blocks of about BYTES."""
    size = pc.binary_length(blobs).to_numpy(zero_copy_only=False)
    for d in np.unique(size).tolist():
        own = np.flatnonzero(size == d)
        step = max(1, BYTES // max(d, 1))
        for k in range(0, len(own), step):
            rows = own[k : k + step]
            yield rows, np.frombuffer(b"".join(blobs.take(pa.array(rows)).to_pylist()), "<f8").reshape(len(rows), -1)


def signatures(classes: DataFrame, tables: Tables, width: float) -> DataFrame:
    """cid, keys (of each table), and SIGNS signs as four longs."""
    salt = np.random.default_rng(SEED).integers(1, 2**63, tables.projections + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple] = {}
        for batch in batches:
            for rows, x in matrices(batch.column("x")):
                d = x.shape[1]
                if d not in drawn:
                    rng = np.random.default_rng([SEED, d])
                    signs = rng.standard_normal((d, SIGNS))
                    drawn = {d: (signs, rng.standard_normal((d, tables.number * tables.projections)), rng.uniform(0, width, tables.number * tables.projections))}
                signs, project, offset = drawn[d]
                cell = np.floor((x @ project + offset) / width).astype(np.int64).view(np.uint64).reshape(len(x), tables.number, -1)
                key = mix(np.arange(tables.number, dtype=np.uint64) * salt[-1] + np.uint64(d)) + np.zeros((len(x), 1), np.uint64)
                for k in range(tables.projections):
                    key = mix(key + cell[:, :, k] * salt[k])
                bits = np.packbits(x @ signs > 0, axis=1).view(np.int64)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables.number)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("cid").take(pa.array(rows)), pa.ListArray.from_arrays(ends, pa.array(key.view(np.int64).ravel())), *(pa.array(np.ascontiguousarray(b)) for b in bits.T)],
                    names=["cid", "keys", *_SKETCH],
                )

    return classes.select("cid", "x").mapInArrow(describe, "cid long, keys array<long>, " + ", ".join(f"{s} long" for s in _SKETCH))


def cosines(pairs: DataFrame, keep: str, out: str) -> DataFrame:
    """Adds cosine to rows with x and y, and drops these. Vectors of different numbers of dimensions have none: their rows go."""

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.strip().split()[0] for c in keep.split(",")]
        for batch in batches:
            batch = batch.filter(pc.equal(pc.binary_length(batch.column("x")), pc.binary_length(batch.column("y"))))
            for rows, x in matrices(batch.column("x")):
                part = batch.take(pa.array(rows))
                y = np.frombuffer(b"".join(part.column("y").to_pylist()), "<f8").reshape(x.shape)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array((x * y).sum(axis=1))], names=[*names, out])

    return pairs.mapInArrow(dot, f"{keep}, {out} double")


def differing(a: str, b: str, signs: int):
    """Signs, of the first so many, in which two sketches differ."""
    return sum((F.bit_count(F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}"))) for s in _SKETCH[: signs // 64]), F.lit(0))


def most_differing(angle, signs: int):
    """What two vectors at this angle exceed with a probability of about 1e-9."""
    share = F.least(angle / math.pi, F.lit(1.0))
    return signs * share + 6 * F.sqrt(signs * share * (1 - share)) + 1


def balls(classes: DataFrame, sketched: DataFrame, cosine: float) -> DataFrame:
    """cid, ball, angle of the classes that lie in another one's ball."""
    half = math.acos(cosine) / 2
    rows = sketched.select("cid", "s0", "s1", F.explode("keys").alias("key"))
    first = materialize(rows.groupBy("key").agg(F.min(F.struct("cid", "s0", "s1")).alias("p"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.col("p.cid").alias("pivot"), F.col("p.s0").alias("ps0"), F.col("p.s1").alias("ps1")))
    close = rows.join(first, "key").where((F.col("cid") > F.col("pivot")) & (differing("", "p", 128) <= most_differing(F.lit(half), 128)))
    close = materialize(close.select("cid", "pivot").distinct())
    pairs = close.join(classes.select("cid", "x"), "cid").join(classes.select(F.col("cid").alias("pivot"), F.col("x").alias("y")), "pivot")
    near = cosines(pairs, "cid long, pivot long", "cosine").where(F.col("cosine") >= math.cos(half - _EDGE))
    best = near.groupBy("cid").agg(F.min(F.struct("pivot", "cosine")).alias("b"))
    return best.select("cid", F.col("b.pivot").alias("ball"), F.acos(F.least(F.col("b.cosine"), F.lit(1.0))).alias("angle"))


def meeting(members: DataFrame, info: DataFrame, sketched: DataFrame, cosine: float) -> DataFrame:
    """Distinct pairs of balls a < b that meet in a bucket and may be near."""
    sketch = sketched.select(F.col("cid").alias("ball"), *_SKETCH).join(info.select("ball", "radius"), "ball")
    own = sketched.join(members.select("cid", "ball"), "cid")
    moved = own.where("cid <> ball").select("ball", F.explode("keys").alias("key")).distinct().join(sketch, "ball")
    stayed = own.where("cid = ball").drop("cid").join(info.select("ball", "radius"), "ball").withColumn("key", F.explode("keys"))
    rows = materialize(stayed.select("key", "ball", "radius", *_SKETCH).unionByName(moved.select("key", "ball", "radius", *_SKETCH)))
    heavy = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SQUARE).select("key", F.ceil(F.col("n") / SQUARE).cast("int").alias("squares")))
    cut = rows.join(heavy, "key", "left").withColumn("squares", F.coalesce("squares", F.lit(1)))
    place, every = F.pmod(F.xxhash64("ball"), F.col("squares")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("squares") - 1))
    a = cut.select("key", place.alias("row"), every.alias("column"), F.col("ball").alias("a"), F.col("radius").alias("ra"), *(F.col(s).alias(f"a{s}") for s in _SKETCH))
    b = cut.select("key", every.alias("row"), place.alias("column"), F.col("ball").alias("b"), F.col("radius").alias("rb"), *(F.col(s).alias(f"b{s}") for s in _SKETCH))
    near = differing("a", "b", SIGNS) <= most_differing(math.acos(cosine) + F.col("ra") + F.col("rb"), SIGNS)
    return a.join(b, ["key", "row", "column"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def judged(pairs: DataFrame, classes: DataFrame, info: DataFrame, cosine: float) -> DataFrame:
    """a, b, whole: pairs of balls all of whose members link (whole), or some of whose may."""
    centre = info.select("ball", "radius", "classes").join(classes.select(F.col("cid").alias("ball"), "x"), "ball")
    side = lambda n, x: centre.select(F.col("ball").alias(n), F.col("radius").alias(f"r{n}"), F.col("classes").alias(f"n{n}"), F.col("x").alias(x))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", (F.col("ra") + F.col("rb")).alias("reach"), ((F.col("na") == 1) & (F.col("nb") == 1) & (F.col("ra") + F.col("rb") == 0)).alias("single"), "x", "y")
    measured = cosines(both, "a long, b long, reach double, single boolean", "cosine")
    angle, most = F.acos(F.greatest(F.least(F.col("cosine"), F.lit(1.0)), F.lit(-1.0))), math.acos(cosine)
    whole = F.when(F.col("single"), F.col("cosine") >= cosine).otherwise(angle + F.col("reach") <= most - _EDGE)
    none = F.when(F.col("single"), F.col("cosine") < cosine).otherwise(angle - F.col("reach") > most + _EDGE)
    return measured.where(~none).select("a", "b", whole.alias("whole"))


def opened_links(opened: DataFrame, members: DataFrame, info: DataFrame, classes: DataFrame, cosine: float, block: int = BLOCK) -> DataFrame:
    """Rows (edge false, cid, number of vectors linked) and (edge true, ball, ball) of the opened pairs a, b."""
    size = info.select("ball", "classes")
    sized = opened.join(size.select(F.col("ball").alias("a"), F.col("classes").alias("na")), "a").join(size.select(F.col("ball").alias("b"), F.col("classes").alias("nb")), "b")
    first = F.col("na") >= F.col("nb")
    sized = materialize(
        sized.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("host"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("guest"), F.greatest("na", "nb").alias("n"), F.least("na", "nb").alias("guests"))
    )
    hosts = sized.groupBy("host").agg(F.ceil(F.max("n") / block).cast("int").alias("blocks"), F.ceil(F.sum("guests") / block).cast("int").alias("chunks"))
    hosts = materialize(hosts)
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = members.select("cid", "ball", "copies").join(classes.select("cid", "x"), "cid")
    as_host = own.join(hosts, own["ball"] == hosts["host"]).withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int")).withColumn("chunk", up_to("chunks"))
    as_guest = own.join(sized.select("host", "guest"), F.col("ball") == F.col("guest")).join(hosts, "host").withColumn("chunk", F.pmod(F.xxhash64("cid"), "chunks").cast("int")).withColumn("block", up_to("blocks"))
    cell = ["host", "block", "chunk"]
    rows = as_host.select(*cell, F.lit(True).alias("owner"), "ball", "cid", "copies", "x").unionByName(as_guest.select(*cell, F.lit(False).alias("owner"), "ball", "cid", "copies", "x"))

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        owner = rows.column("owner").to_numpy()
        cid, ball, copies = (rows.column(c).to_numpy() for c in ("cid", "ball", "copies"))
        blobs = rows.column("x").to_pylist()
        h, g = np.flatnonzero(owner), np.flatnonzero(~owner)
        edges, n = set(), np.zeros(len(cid), np.int64)
        if len(h) and len(g):
            host = np.frombuffer(b"".join(blobs[k] for k in h.tolist()), "<f8").reshape(len(h), -1)
            for k in range(0, len(g), block):
                some = g[k : k + block]
                guest = np.frombuffer(b"".join(blobs[j] for j in some.tolist()), "<f8").reshape(len(some), -1)
                linked = guest @ host.T >= cosine
                n[some] += linked @ copies[h]
                n[h] += copies[some] @ linked
                edges.update(ball[some[linked.any(axis=1)]].tolist())
        at = np.flatnonzero(n)
        top = int(ball[h[0]]) if len(h) else 0
        a, b = np.concatenate([cid[at], np.array(sorted(edges), np.int64)]), np.concatenate([n[at], np.full(len(edges), top)])
        return pa.table([pa.array(np.arange(len(a)) >= len(at)), pa.array(a), pa.array(b)], names=["edge", "a", "b"])

    return rows.groupBy(*cell).applyInArrow(compare, "edge boolean, a long, b long")


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, recall: float = RECALL, width: float = WIDTH, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id (the smallest vec_id reachable by links), kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do vectors of different
    numbers of dimensions. Rows that repeat, or repeat an id, are vectors each. A row without an id links with nothing, has
    a null component and is kept. Ties: the smallest id is kept. An empty table gives no rows; other columns are ignored.
    """
    rows = materialize(unit_vectors(vectors, id_col, vector_col).withColumn("sha", F.when(F.col("vec_id").isNotNull(), F.unhex(F.sha2("x", 256)))))
    grouped = rows.where("sha IS NOT NULL").groupBy("sha", "x").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(grouped.withColumn("cid", F.monotonically_increasing_id()))
    sketched = materialize(signatures(classes, Tables.of(classes.count(), cosine, recall, width), width))
    moved = materialize(balls(classes, sketched, cosine))
    members = classes.select("cid", "rep", "copies").join(moved, "cid", "left")
    members = materialize(members.select("cid", "rep", "copies", F.coalesce("ball", "cid").alias("ball"), F.coalesce("angle", F.lit(0.0)).alias("angle")))
    info = materialize(members.groupBy("ball").agg(F.max("angle").alias("radius"), F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("classes")))
    links = materialize(judged(materialize(meeting(members, info, sketched, cosine)), classes, info, cosine))
    inside = materialize(opened_links(links.where("not whole").select("a", "b"), members, info, classes, cosine, block))

    whole = links.where("whole").select("a", "b")
    found = components(whole.unionByName(inside.where("edge").select("a", "b")))
    other = info.select(F.col("ball").alias("b"), "copies")
    across = whole.unionByName(whole.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(other, "b").groupBy("a").agg(F.sum("copies").alias("more"))
    of_ball = info.join(across, F.col("ball") == F.col("a"), "left").join(found, F.col("ball") == F.col("node"), "left")
    of_ball = materialize(of_ball.select("ball", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("component", "ball").alias("component")))
    single = inside.where("not edge").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("some"))
    named = materialize(members.join(of_ball, "ball").join(single, "cid", "left").select("cid", "rep", "component", (F.col("links") + F.coalesce("some", F.lit(0))).alias("n_links")))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    given = materialize(named.join(least, "component").select("cid", "n_links", "component_id").join(classes.select("cid", "sha", "copies"), "cid"))

    out = looked_up(rows.where("sha IS NOT NULL").select("vec_id", "sha"), given, ["sha"], "vec_id", "copies").select("vec_id", "n_links", "component_id")
    alone = rows.where("sha IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
