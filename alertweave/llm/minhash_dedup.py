"""Near-duplicate detection with MinHash bands, confirmed on full shingle sets, and connected components.

A document's set holds its distinct runs of ``k`` lower-cased words; with fewer words, the whole sequence as one. Two
documents are linked if their sets have a Jaccard similarity of ``percent`` / 100 or more.

1. One pass over the texts makes a 128-bit key of each set and ``bands * rows`` universal hash minima. Documents with
   the same key are one class; only the class representative (least id) goes on.
2. Representatives that agree on all minima of a band share a bucket. A bucket is never paired off: each member meets
   two leaders of the bucket, so pairs grow with the members.
3. A pair goes on if its signatures agree on at least ``floor`` of their places (five standard deviations under the
   threshold), and is then confirmed on the two full sets.
4. Confirmed links are joined to components by alternating large-star and small-star steps.
5. No link between bucket mates may depend on the choice of leaders: members of one bucket that are still in different
   components are compared too, all but pairs whose sets provably share too little (see _able and _rest).
   Components are then completed with these links.

A pair at the threshold shares no bucket with a chance of (1 - 0.75**4)**32, about 5 in a million.

Null or empty texts have an empty set and are linked with nothing. A null id is linked with nothing and has no
component; its row is kept. Rows that repeat an id stay as many rows; where their texts differ, each text has its own set and
links, and what either reaches belongs to the one component of the id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertweave.llm.common import PART_BYTES, Runs, has_bit, mixed, over_texts, packed_bits, read, words_of
from alertweave.llm.components import components
from alertweave.session import materialise

_SEED = 20240229


def _families(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of n universal hash functions on 64-bit values."""
    draw = np.random.default_rng(_SEED).integers(0, 1 << 63, size=(2, n), dtype=np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def _sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each text, distinct and sorted within it, and where each text begins."""
    words = words_of(texts, lower=True)
    one, _ = words.hashes()
    n = words.counts
    shingles = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), shingles)
    first = np.concatenate(([0], np.cumsum(shingles)))
    start = np.arange(first[-1]) - first[owner] + words.bounds[owner]
    hashes = Runs(one)(start, np.minimum(start + k, words.bounds[owner + 1]))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(n))))).astype(np.int64)


def _minima(hashes: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """Signature of each non-empty text, one row for each."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.empty((len(full), n), dtype=np.uint32)
    if len(full):
        for i, (a, b) in enumerate(zip(*_families(n), strict=True)):
            out[:, i] = np.minimum.reduceat(((hashes * a + b) >> np.uint64(32)).astype(np.uint32), bounds[full])
    return out


def text_key() -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64("text")


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, n_shingles, key_one, key_two (null for an empty set) and the signature as bytes."""
    n = bands * rows

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        hashes, bounds = _sets(part.column("text"), k)
        size = np.diff(bounds)
        minima = iter(_minima(hashes, bounds, n))
        keys = [xxhash.xxh3_128_digest(hashes[bounds[i] : bounds[i + 1]].tobytes()) if size[i] else None for i in range(len(size))]
        one = [int.from_bytes(x[:8], "little", signed=True) if x else None for x in keys]
        two = [int.from_bytes(x[8:], "little", signed=True) if x else None for x in keys]
        return pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                part.column("text_key"),
                pa.array(size.astype(np.int64)),
                pa.array(one, pa.int64()),
                pa.array(two, pa.int64()),
                pa.array([next(minima).tobytes() if x else None for x in keys], pa.binary()),
            ],
            names=["doc_id", "text_key", "n_shingles", "key_one", "key_two", "signature"],
        )

    schema = "doc_id long, text_key long, n_shingles long, key_one long, key_two long, signature binary"
    return over_texts(docs.select("doc_id", "text", text_key().alias("text_key")), step, schema, limit=PART_BYTES)


def full_sets(docs: DataFrame, ids: DataFrame, heads: DataFrame, k: int, label: str, bits: int = 27) -> DataFrame:
    """doc_id of ``heads`` and its whole set as an array, for those listed by ``ids``; written to the shared folder.

    Texts stay where they are: tasks drop documents whose id, modulo 2**bits, is that of none listed (16 MB at most go
    to each), and what that lets through goes by a join of the sets.
    """
    size = 1 << bits
    wanted = heads.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "own_id", "text_key")
    listed = docs.sparkSession.sparkContext.broadcast(
        packed_bits(wanted.select(F.pmod("own_id", F.lit(size)).alias("cell")).distinct(), size)
    )

    def step(part: pa.RecordBatch) -> pa.RecordBatch | None:
        known = part.column("doc_id").fill_null(0).to_numpy().astype(np.int64)
        part = part.filter(pa.array(has_bit(listed.value, np.mod(known, size)) & ~np.asarray(part.column("doc_id").is_null())))
        if not part.num_rows:
            return None
        hashes, bounds = _sets(part.column("text"), k)
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), lists], names=["own_id", "text_key", "shingles"])

    texts = docs.select("doc_id", "text", text_key().alias("text_key"))
    sets = over_texts(texts, step, "own_id long, text_key long, shingles array<long>", limit=PART_BYTES)
    found = sets.join(wanted, ["own_id", "text_key"]).select("doc_id", "shingles").dropDuplicates(["doc_id"])
    found = materialise(found, label)
    # The sets are written; workers would keep the bits for as long as they live.
    listed.destroy()
    return found


def band_keys(heads: DataFrame, bands: int, rows: int) -> DataFrame:
    """One row for each band of each representative: band, bucket, doc_id."""

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        sig = np.frombuffer(b"".join(part.column("signature").to_pylist()), dtype="<u4").reshape(-1, bands, rows)
        key = np.zeros(sig.shape[:2], dtype=np.uint64)
        for r in range(rows):
            key = mixed(key + sig[:, :, r].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        ids = np.repeat(part.column("doc_id").to_numpy(), bands)
        band = np.tile(np.arange(bands, dtype=np.int32), part.num_rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(band), pa.array(key.reshape(-1).view(np.int64)), pa.array(ids)], names=["band", "bucket", "doc_id"]
        )

    return over_texts(heads.select("doc_id", "signature"), step, "band int, bucket long, doc_id long", column="signature")


def _pair(a: Column | str, b: Column | str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _alike(pairs: DataFrame, heads: DataFrame, n: int, floor: float) -> DataFrame:
    """Pairs whose signatures agree often enough."""
    sig = heads.select("doc_id", "signature")
    both = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        one, two = (np.frombuffer(b"".join(part.column(c).to_pylist()), dtype="<u4").reshape(-1, n) for c in ("sig_a", "sig_b"))
        keep = pa.array((one == two).sum(axis=1) >= floor * n)
        return pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], names=["a", "b"])

    return over_texts(both, step, "a long, b long", column="sig_a")


def confirmed(pairs: DataFrame, docs: DataFrame, heads: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose full sets reach the similarity."""
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = full_sets(docs, wanted, heads, k, "sets")
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return (
        both.select("a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b")).alias("total"))
        .where(100 * F.col("common") >= percent * (F.col("total") - F.col("common")))
        .select("a", "b")
    )


PLACE = ["band", "bucket"]


def _with_leaders(shared: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's two leaders: the member that meets most mates over all bands, which in
    a group of near copies is close to their common origin, and one by a hash, another in every band."""
    met = shared.groupBy("doc_id").agg(F.sum("mates").alias("met"))
    known = shared.join(met, "doc_id")
    leaders = known.groupBy(*PLACE).agg(
        F.max(F.struct("met", (-F.col("doc_id")).alias("order"), "doc_id")).alias("central"),
        F.min(F.struct(F.xxhash64("doc_id", "band").alias("h"), "doc_id")).alias("drawn"),
    )
    leaders = leaders.select(*PLACE, F.col("central.doc_id").alias("one"), F.col("drawn.doc_id").alias("two"))
    led = shared.join(leaders, PLACE)
    pairs = led.select("doc_id", F.col("one").alias("leader")).unionByName(led.select("doc_id", F.col("two").alias("leader")))
    return pairs.where("doc_id <> leader").select(*_pair("doc_id", "leader")).distinct()


def _open(member: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component."""
    spread = member.groupBy(*PLACE).agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    return member.join(spread.select(*PLACE), PLACE, "left_semi")


def _able(member: DataFrame, docs: DataFrame, heads: DataFrame, k: int, percent: int) -> DataFrame:
    """Members that can have a link at all, once for each middle (the most met member of a bucket) that they have: doc_id,
    middle, part, the size of their set (n), how much of it any other member has (common), and what the middle has not (outside).

    Two sets share at most what each has in common with anyone, so a set that is mostly its own reaches the similarity
    with no set of the bucket's least size or more. This rules out without loss what strays from a large group.
    """
    sets = full_sets(docs, member, heads, k, "open-sets")
    each = sets.select("doc_id", F.explode("shingles").alias("shingle"))
    twice = each.groupBy("shingle").agg(F.count("*").alias("holders")).where("holders > 1").select("shingle")
    common = each.join(twice, "shingle").groupBy("doc_id").agg(F.count("*").alias("common"))
    known = member.join(sets.select("doc_id", F.size("shingles").cast("long").alias("n")).join(common, "doc_id"), "doc_id")
    known = materialise(known, "open-members")
    least = known.groupBy(*PLACE).agg(F.min("n").alias("least"))
    reach = 100 * F.col("common") >= percent * (F.col("n") + F.col("least") - F.col("common"))
    able = materialise(_open(known.join(least, PLACE).where(reach).drop("least")), "able")

    met = able.groupBy("doc_id").agg(F.sum("mates").alias("met"))
    middle = able.join(met, "doc_id").groupBy(*PLACE).agg(
        F.max(F.struct("met", (-F.col("doc_id")).alias("order"), "doc_id")).alias("m")
    )
    placed = able.join(middle.select(*PLACE, F.col("m.doc_id").alias("middle")), PLACE)
    placed = placed.select("doc_id", "middle", "part", "n", "common").distinct()
    own = placed.join(sets.withColumnRenamed("shingles", "own"), "doc_id").join(sets.toDF("middle", "its"), "middle")
    outside = F.array_except("own", "its").alias("outside")
    return materialise(own.select("doc_id", "middle", "part", "n", "common", outside), "still-open")


def _rest(able: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components around one middle that may be linked; none that may be is left out.

    Sets of n and m shingles must share percent * (n + m) / (100 + percent) of them, or more. Within the middle they share at
    most what either has of it (``inside``). So two cases cover all pairs:

    * That is too little: they share shingles outside of the middle, at least ``k`` of them whatever the other set is.
      A set that lists all but k - 1 of its outside shingles, the rarest first, meets any such set in one of these.
    * It may do: then both sizes lie within what ``inside`` allows (up to ``top``), and the pair meets by size.

    Members of a middle's largest component look for no one, as all others look for them.
    """
    largest = able.groupBy("middle", "part").agg(F.count("*").alias("size")).groupBy("middle").agg(
        F.max(F.struct("size", "part")).alias("l")
    )
    least = able.groupBy("middle").agg(F.min("n").alias("least"))
    known = able.join(largest.select("middle", F.col("l.part").alias("largest")).join(least, "middle"), "middle")
    known = (
        known.withColumn("inside", F.col("n") - F.size("outside"))
        .withColumn("single", F.col("part") != F.col("largest"))
        .withColumn("low", F.greatest("least", F.ceil(percent * F.col("n") / 100)))
        .withColumn("top", F.floor((100 + percent) * F.col("inside") / percent) - F.col("n"))
        .withColumn("k", F.greatest(F.lit(1), F.ceil(percent * (F.col("n") + F.col("low")) / (100 + percent)) - F.col("inside")))
    )
    own = ("doc_id", "part", "n", "common", "inside")
    side = lambda df, x, *on: df.select("middle", *on, *[F.col(c).alias(f"{c}_{x}") for c in own])
    apart = F.least(F.col("n_a") - F.col("inside_a"), F.col("n_b") - F.col("inside_b"))
    both = F.least("common_a", "common_b", F.least("inside_a", "inside_b") + apart)
    able_both = (F.col("part_a") != F.col("part_b")) & ((100 + percent) * both >= percent * (F.col("n_a") + F.col("n_b")))

    each = known.select("middle", *own, "single", "k", F.explode("outside").alias("shingle"))
    held = each.groupBy("middle", "shingle").agg(F.count("*").alias("holders"), F.min("part").alias("a"), F.max("part").alias("z"))
    each = materialise(each.join(held.where("a < z").drop("a", "z"), ["middle", "shingle"]), "outside-shingles")
    one = Window.partitionBy("middle", "doc_id")
    looks = (
        each.where("single")
        .withColumn("listed", F.count("*").over(one))
        .withColumn("rank", F.row_number().over(one.orderBy("holders", "shingle")))
        .where("rank <= listed - k + 1")
    )
    outer = side(looks, "a", "shingle").join(side(each, "b", "shingle"), ["middle", "shingle"]).where(able_both)

    looks = known.where("single and low <= top").withColumn(
        "size", F.explode(F.sequence("low", F.least("top", F.floor(100 * F.col("n") / percent))))
    )
    mates = known.withColumn("size", F.col("n")).withColumn("top_b", F.col("top"))
    inner = side(looks, "a", "size").join(side(mates, "b", "size", "top_b"), ["middle", "size"])
    inner = inner.where("n_a <= top_b").where(able_both)
    return outer.select(*_pair("doc_id_a", "doc_id_b")).unionByName(inner.select(*_pair("doc_id_a", "doc_id_b"))).distinct()


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 75, bands: int = 32, rows: int = 4, floor: float = 0.56
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row for each row of ``docs``.

    ``text_key`` and ``text_kept`` say the same of the row's text alone: it stays if no text of a lesser id is linked with it,
    whatever other texts its id has.
    """
    signed = materialise(signatures(docs, k, bands, rows), "signatures")
    keys = ["key_one", "key_two"]
    known = signed.where("doc_id is not null and key_one is not null")
    least = known.groupBy(*keys).agg(F.min(F.struct("doc_id", "text_key")).alias("least"))
    classes = least.select(*keys, F.col("least.doc_id").alias("own_id"), F.col("least.text_key").alias("text_key"))
    # A class goes by its least id. Where unlike texts share that id, by a number of its own, below all others.
    several = classes.groupBy("own_id").agg(F.count("*").alias("texts")).where("texts > 1")
    number = F.shiftrightunsigned(F.xxhash64(*keys), 2) + F.lit(-(1 << 63))
    head = F.when(F.col("texts").isNull(), F.col("own_id")).otherwise(number)
    classes = materialise(classes.join(several, "own_id", "left").withColumn("head", head).drop("texts"), "classes")
    heads = materialise(
        known.join(classes.select(*keys, F.col("own_id").alias("doc_id"), "text_key", "head"), [*keys, "doc_id", "text_key"])
        .select(F.col("head").alias("doc_id"), F.col("doc_id").alias("own_id"), "text_key", "signature")
        .dropDuplicates(["doc_id"]),
        "heads",
    )

    in_bucket = band_keys(heads, bands, rows)
    crowded = in_bucket.groupBy(*PLACE).agg(F.count("*").alias("mates")).where("mates > 1")
    shared = materialise(in_bucket.join(crowded, PLACE), "buckets")
    first = materialise(_with_leaders(shared), "leader-pairs")
    links = materialise(confirmed(materialise(_alike(first, heads, bands * rows, floor), "alike"), docs, heads, k, percent), "links")

    # Bucket mates of different components, all of them; a member without a link is a component of its own.
    member = shared.join(components(links).toDF("doc_id", "part"), "doc_id", "left")
    member = _open(member.select(*PLACE, "mates", "doc_id", F.coalesce("part", "doc_id").alias("part")))
    rest = _rest(_able(materialise(member, "open-buckets"), docs, heads, k, percent), percent)
    rest = materialise(_alike(rest.join(first, ["a", "b"], "left_anti"), heads, bands * rows, floor), "rest")
    more = materialise(confirmed(rest, docs, heads, k, percent), "more-links")
    parts = components(links.unionByName(more)).toDF("head", "part")
    named = classes.join(parts, "head", "left").select(*keys, "own_id", F.coalesce("part", "head").alias("part"))
    # A component goes by its least id, which is not the number of a class.
    by_text = named.groupBy("part").agg(F.min("own_id").alias("smallest"))
    named = materialise(named.join(by_text, "part").select(*keys, "smallest"), "named")
    # An id with unlike texts ties their components together.
    texts = known.join(named, keys).select("doc_id", "smallest")
    ties = texts.groupBy("doc_id").agg(F.min("smallest").alias("a"), F.max("smallest").alias("z")).where("a < z").select("doc_id", "a")
    tied = components(texts.join(ties, "doc_id").where("a < smallest").select("a", F.col("smallest").alias("b"))).toDF("smallest", "whole")
    named = named.join(tied, "smallest", "left").select(*keys, "smallest", F.coalesce("whole", "smallest").alias("whole"))
    out = signed.select("doc_id", "text_key", "n_shingles", *keys).join(named, keys, "left")

    def of(column: str) -> Column:
        return F.when(F.col("doc_id").isNotNull(), F.coalesce(column, "doc_id"))

    first_of = lambda column: F.coalesce(of(column) == F.col("doc_id"), F.lit(True))
    return out.select(
        "doc_id", "n_shingles", of("whole").alias("component_id"), first_of("whole").alias("kept"),
        "text_key", first_of("smallest").alias("text_kept"),
    )


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("text_key", "text_kept")
