"""Near-duplicate records by b-bit MinHash.

1. Each record's 5-word shingles give HASHES minima. Bands of ROWS full minima are the candidate keys; of each
   minimum the low BITS bits stay in a packed signature.
2. Records with the same shingle set form a class; everything further works on classes, so exact copies never pair up.
3. A band's bucket of up to BUCKET classes gives its pairs. The classes of a fuller bucket (boilerplate) go through an
   exact prefix-filtered join on their rarest shingles instead (operators.similarity), whose prefixes end before text that
   all of them have in common, so no bucket is cut and none is expanded whole.
4. Equal signature positions are counted bitwise and corrected for chance collisions; pairs whose estimate lies
   far below the threshold drop out.
5. What is left is verified exactly on the shingle sets.

With 40 bands of 4 a pair at similarity 0.70 escapes all bands with probability (1 - 0.7**4)**40, about 2e-5, and the
estimate with about 1e-5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm import kernel as K
from quarryline.llm.records import fresh, records
from quarryline.operators.similarity import prefix_pairs, similar_pairs
from quarryline.shared import written

BANDS, ROWS, BITS, BUCKET, SHINGLE = 40, 4, 2, 64, 5
HASHES = BANDS * ROWS
WORDS = -(-HASHES // 64)
#: An estimate from 160 positions of 2 bits has a standard deviation of at most 0.05; pairs this far below go.
MARGIN = 0.2

SIGNED = "rec_table string, rec_key string, cls long, n int, sig array<long>, bands array<long>"


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    a = K.mixed(np.arange(1, HASHES + 1, dtype=np.uint64)) | K.U64(1)
    return a, K.mixed(a)


def shingle_sets(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and the bounds of each text's share."""
    words, bounds = K.word_hashes(texts)
    hashes, at = K.shingle_hashes(words, bounds, k)
    owner = np.searchsorted(bounds, at, "right") - 1
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


def _list(values: np.ndarray, n: int, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1).view(np.int64)))


def set_hashes(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each whole set; none may be empty."""
    return K.mixed(np.add.reduceat(K.mixed(hashes), bounds[:-1]) + np.diff(bounds).astype(np.uint64))


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each non-empty set: a hash of the whole set, its packed signature and its band keys."""
    starts, n = bounds[:-1], len(bounds) - 1
    a, b = _seeds()
    minima = np.empty((HASHES, n), np.uint32)
    for i in range(HASHES):
        minima[i] = np.minimum.reduceat(((hashes * a[i] + b[i]) >> K.U64(32)).astype(np.uint32), starts)
    cls = set_hashes(hashes, bounds)
    bands = np.empty((n, BANDS), np.uint64)
    for i in range(BANDS):
        key = np.full(n, i + 1, np.uint64)
        for row in minima[i * ROWS : (i + 1) * ROWS]:
            key = K.mixed(key * K.BASE + row)
        bands[:, i] = key
    sig = np.zeros((n, BITS * WORDS), np.uint64)
    for bit in range(BITS):
        planes = np.zeros((n, WORDS * 64), np.uint8)
        planes[:, :HASHES] = ((minima >> np.uint32(bit)) & np.uint32(1)).T
        sig[:, bit * WORDS : (bit + 1) * WORDS] = np.packbits(planes, axis=1, bitorder="little").view(np.uint64)
    return cls, sig, bands


def _sign(k: int):
    def run(batches):
        for keys, texts in fresh(batches, ["rec_table", "rec_key"], "text"):
            for i, j in K.chunks(texts):
                hashes, bounds = shingle_sets(texts[i:j], k)
                full = np.flatnonzero(np.diff(bounds))
                if not len(full):
                    continue
                cls, sig, bands = signatures(hashes, np.append(bounds[full], len(hashes)))
                n = len(full)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[i + r][c] for r in full], pa.string()) for c in (0, 1)]
                    + [pa.array(cls.view(np.int64)), pa.array(np.diff(bounds)[full].astype(np.int32)), _list(sig, n, sig.shape[1]), _list(bands, n, BANDS)],
                    names=["rec_table", "rec_key", "cls", "n", "sig", "bands"],
                )

    return run


def _shingled(k: int):
    """The sets of the texts that are of the wanted class; an id may have texts of other classes."""

    def run(batches):
        for keys, texts in fresh(batches, ["cls"], "text"):
            for i, j in K.chunks(texts):
                hashes, bounds = shingle_sets(texts[i:j], k)
                wanted = np.array([c for (c,) in keys[i:j]], np.int64)
                full = np.flatnonzero(np.diff(bounds))
                if not len(full):
                    continue
                own = np.zeros(j - i, bool)
                own[full] = set_hashes(hashes, np.append(bounds[full], len(hashes))).view(np.int64) == wanted[full]
                sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(wanted), sets], names=["cls", "shingles"]).filter(pa.array(own))

    return run


def _pairs_of(groups: DataFrame) -> DataFrame:
    """(a, b), a < b, of the sorted array `members`."""
    return (
        groups.select("members", F.posexplode("members").alias("at", "a"))
        .select("a", F.explode(F.expr("slice(members, at + 2, size(members))")).alias("b"))
    )


def similar_classes(recs: DataFrame, threshold: float, k: int = SHINGLE, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """Of records(): membership (rec_table, rec_key, cls) and the class pairs (a, b, similarity), a < b, at or above threshold."""
    signed = written(recs.mapInArrow(_sign(k), SIGNED), "minhash-signatures")
    classes = signed.groupBy("cls").agg(
        F.min("n").alias("n"), F.min("sig").alias("sig"), F.min("bands").alias("bands"), F.min(F.struct("rec_table", "rec_key")).alias("rep")
    )
    classes = written(classes, "minhash-classes")

    # From one row for each class: what is numbered and counted in a band are classes, however many records they have.
    banded = classes.select(F.explode("bands").alias("band"), "cls")
    ranked = banded.withColumn("at", F.row_number().over(Window.partitionBy("band").orderBy("cls"))).where(F.col("at") <= bucket + 1)
    buckets = ranked.groupBy("band").agg(F.array_sort(F.collect_set("cls")).alias("members"), F.count("*").alias("rows")).where(F.size("members") > 1)
    buckets = written(buckets, "minhash-buckets")
    near = _pairs_of(buckets.where(F.col("rows") <= bucket)).distinct()
    hot_bands = buckets.where(F.col("rows") > bucket).select("band")

    text_of = lambda wanted: (
        recs.join(wanted.select(F.col("rep.rec_table").alias("rec_table"), F.col("rep.rec_key").alias("rec_key"), "cls"), ["rec_table", "rec_key"])
        .select("cls", "text")
        .mapInArrow(_shingled(k), "cls long, shingles array<long>")
        .groupBy("cls")
        .agg(F.min("shingles").alias("shingles"))
    )

    a = classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    b = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    unequal = " + ".join(
        "bit_count(" + " | ".join(f"(sa[{bit * WORDS + w}] ^ sb[{bit * WORDS + w}])" for bit in range(BITS)) + ")" for w in range(WORDS)
    )
    chance = 2.0**-BITS
    likely = (
        near.join(a, "a")
        .join(b, "b")
        .where(F.expr(f"least(na, nb) >= {threshold} * greatest(na, nb)"))
        .where(F.expr(f"(({HASHES} - ({unequal})) / {float(HASHES)}D - {chance}D) / {1 - chance}D >= {threshold - MARGIN}D"))
        .select("a", "b")
    )
    if hot_bands.limit(1).count():
        hot = banded.join(hot_bands, "band", "left_semi").select("cls").distinct()
        full = written(text_of(hot.join(classes, "cls")).select(F.col("cls").alias("item"), F.col("shingles").alias("tokens")), "minhash-hot-sets")
        likely = likely.union(prefix_pairs(full, threshold)).distinct()
    likely = written(likely, "minhash-candidates")

    wanted = likely.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes, "cls")
    sets = written(text_of(wanted), "minhash-sets")
    pairs = similar_pairs(sets.select(F.col("cls").alias("item"), F.col("shingles").alias("tokens")), likely, threshold)
    return signed.select("rec_table", "rec_key", "cls").distinct(), pairs


def near_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.8, k: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """(id_a, id_b), id_a < id_b: keys whose texts have a Jaccard similarity of at least threshold between their sets of
    k-word shingles (lower-cased words of letters, digits and underscores).

    Rows that repeat a key and text count once; rows with a null key or text and texts of fewer than k words pair with
    nothing; an empty table gives no rows. Other columns of df are not looked at.
    """
    members, pairs = similar_classes(records(df, "", key, text), threshold, k, bucket)
    m = members.select("cls", "rec_key")
    x, y = (m.select(F.col("cls").alias(c), F.col("rec_key").alias(f"id_{c}")) for c in "ab")
    between = pairs.select("a", "b").join(x, "a").join(y, "b").select("id_a", "id_b")
    repeated = m.groupBy("cls").agg(F.count("*").alias("size")).where("size > 1").select("cls")
    same = m.join(repeated, "cls", "left_semi")
    within = same.select("cls", F.col("rec_key").alias("id_a")).join(same.select("cls", F.col("rec_key").alias("id_b")), "cls").where("id_a < id_b").select("id_a", "id_b")
    return between.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).where("id_a < id_b").unionByName(within).distinct()


def near_groups(df: DataFrame, key: str, text: str, threshold: float = 0.8, k: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """(id, group_id, links): each key with a text; group_id, the least key that it is linked to over any number of
    similar records; links, the number of other records at or above threshold.

    Nulls and repeats as in near_pairs; a text of fewer than k words is a group of its own with 0 links.
    """
    recs = records(df, "", key, text)
    members, pairs = similar_classes(recs, threshold, k, bucket)
    members, pairs = written(members, "minhash-members"), written(pairs, "minhash-pairs")
    sizes = members.groupBy("cls").agg(F.count("*").alias("size"), F.min("rec_key").alias("least"))
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.join(sizes.select(F.col("cls").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("others"))
    comp = components(sizes.select(F.col("cls").alias("node"), "least"), both)
    out = (
        members.join(sizes.select("cls", "size"), "cls")
        .join(comp.select(F.col("node").alias("cls"), "least"), "cls")
        .join(links.select(F.col("a").alias("cls"), "others"), "cls", "left")
        .groupBy(F.col("rec_key").alias("id"))
        .agg(F.min("least").alias("group_id"), F.max(F.expr("size - 1 + coalesce(others, 0)")).cast("long").alias("links"))
    )
    alone = recs.select(F.col("rec_key").alias("id")).distinct().join(out.select("id"), "id", "left_anti")
    return out.unionByName(alone.select("id", F.col("id").alias("group_id"), F.lit(0).cast("long").alias("links")))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The least label within each connected component, by label spreading with shortcuts: a node, and the node that its
    label comes from, take the least label of its neighbours, then the label that the node of that name has; until
    neighbours have equal labels. nodes (node, least), edges (a, b) both ways. A label is named by its node, as
    several nodes may have the same."""
    now = nodes.select("node", F.struct("least", F.col("node").alias("root")).alias("label"))
    while True:
        near = edges.join(now.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        own = F.struct("node", F.least("label", "near").alias("label"), F.coalesce(F.col("near") < F.col("label"), F.lit(False)).alias("moved"))
        root = F.struct(F.col("label.root").alias("node"), F.col("near").alias("label"), F.lit(False).alias("moved"))
        told = now.join(near, "node", "left").select(F.explode(F.array(own, root)).alias("x")).select("x.*")
        new = written(told.groupBy("node").agg(F.min("label").alias("label"), F.max("moved").alias("moved")), "components")
        if not new.where("moved").limit(1).count():
            return new.select("node", "label.least")
        roots = new.select(F.col("node").alias("root"), F.col("label").alias("further"))
        now = new.select("node", "label", "label.root").join(roots, "root").select("node", F.least("label", "further").alias("label"))
