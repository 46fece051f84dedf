"""op 4: b-bit MinHash near-duplicate classes, confirmed on full shingle sets.

One pass over the texts gives each row its set size, a 128-bit digest of the set, 32 band keys of 4 minima each and the low 4
bits of all 128 minima packed into eight longs.  Rows of equal digests collapse to one node with a number of its own; doc_ids
come in again only at the end, so rows that share a doc_id but not their text never join what isn't alike.  Band keys bring
candidates: every node of a bucket is paired with the bucket's node of the smallest doc_id only, the collision-corrected similarity of the
packed bits discards pairs that are far off (``MARGIN`` below the threshold, over five standard deviations), and the rest is
confirmed by intersecting full sets.  Links so found give components.  Where a bucket of more than ``BLOCK`` nodes still holds
two components, it is dealt to narrower ones by the rarest shingles of its nodes, which every pair at the threshold shares.  The
nodes of a bucket with two components are compared in blocks of bounded size: pairs across components whose packed bits are similar enough are tested on 32-bit
forms of the full sets on the spot, and a block gives on at most one pair for each merger it finds, which is then confirmed
like the others.  A pair at the threshold shares no band with probability (1 - 0.75^4)^32 = 5e-6; nothing is capped.

Defined cases: null, empty or blank texts have an empty set, are linked with nothing and kept; under five words the whole
sequence is one shingle; a null doc_id has a null component, is linked with nothing and kept; repeated rows get the same
values; rows that repeat a doc_id with other texts are judged by their own text, and are all kept if their doc_id is the
smallest of their component.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, WordHashes, gram_hashes, materialize, mix, release, signed

WORDS = 5
PERMS, ROWS, BITS = 128, 4, 4
MARGIN = 0.2
BLOCK = 2048
_rng = np.random.default_rng(20240901)
_A = (_rng.integers(0, 1 << 31, PERMS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, PERMS, dtype=np.uint64).astype(np.uint32)
_SIGS = "doc_id long, th long, n_shingles long, d1 long, d2 long, bands array<long>, bits array<long>"


def shingle_set(words: list[bytes], hashes: WordHashes, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words, of the whole sequence."""
    if not words:
        return np.empty(0, U64)
    h = hashes.of(words)
    if len(words) < k:
        return mix(gram_hashes(h, len(words)) + U64(len(words)))
    h = np.sort(mix(gram_hashes(h, k)))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def minima(s: np.ndarray) -> np.ndarray:
    x = (s >> U64(32)).astype(np.uint32)
    low = np.full(PERMS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        part = x[i : i + 4096]
        part = (part[None, :] ^ _B[:, None]) * _A[:, None]
        low = np.minimum(low, part.min(axis=1))
    return low


def _signatures(k: int):
    powers = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(ROWS)], dtype=U64)
    salt = mix(np.arange(1, PERMS // ROWS + 1, dtype=U64))
    shift = (np.arange(16, dtype=U64) * U64(BITS))[None, :]

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            n, d1, d2, lows = [], [], [], []
            for i in range(len(texts)):
                s = shingle_set((texts[i].as_py() or b"").lower().split(), hashes, k)
                n.append(len(s))
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                d1.append(d >> 64), d2.append(d & ((1 << 64) - 1))
                lows.append(minima(s))
            if not n:
                continue
            m = np.stack(lows).astype(U64)
            bands = mix((mix(m + U64(1)).reshape(len(n), -1, ROWS) * powers).sum(axis=2, dtype=U64) ^ salt)
            # the multiplicative hash is weak in its lowest bits, so bits are kept of a mixed minimum
            low = (mix(m) >> U64(40)) & U64((1 << BITS) - 1)
            bits = (low.reshape(len(n), -1, 16) << shift).sum(axis=2, dtype=U64)
            longs = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(signed(np.ascontiguousarray(x)).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("th"), pa.array(n, pa.int64()), pa.array(signed(np.array(d1, U64))), pa.array(signed(np.array(d2, U64))), longs(bands), longs(bits)],
                names=["doc_id", "th", "n_shingles", "d1", "d2", "bands", "bits"],
            )

    return run


def _sets(k: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            sets = [shingle_set(texts[i].as_py().lower().split(), hashes, k).tobytes() for i in range(len(texts))]
            digests = [xxhash.xxh3_128_intdigest(s) for s in sets]
            d1, d2 = (signed(np.array([f(d) for d in digests], U64)) for f in (lambda d: d >> 64, lambda d: d & ((1 << 64) - 1)))
            small = [(np.frombuffer(s, U64) >> U64(32)).astype(np.uint32).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), pa.array(sets, pa.binary()), pa.array(small, pa.binary())], names=["d1", "d2", "shingles", "small"])

    return run


def _unpacked(batches):
    """A row a shingle."""
    for batch in batches:
        sets = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("shingles")]
        n = np.array([len(x) for x in sets], np.int64)
        for lo in range(0, len(sets), 256):
            part, many = sets[lo : lo + 256], n[lo : lo + 256]
            b, v = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False)[lo : lo + 256], many) for c in ("bucket", "node"))
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(v), pa.array(np.repeat(many, many)), pa.array(np.concatenate(part))], names=["bucket", "node", "size", "shingle"])


def _narrowed(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """bucket, node of narrower buckets that hold every pair of large (bucket, node) with percent of its shingles in common.

    In any common order of shingles, the first n - ceil(t * n) + 1 of the larger set of such a pair and the first
    n - ceil(2 * t / (1 + t) * n) + 1 of the smaller one, n being their sizes and t the threshold, meet.  The order is that of
    frequency in the bucket, rarest first, so pages of one template, alike but for what each has alone, share none of those.
    A narrow bucket is a shingle that is among the fewer first ones of some set.
    """
    rows = large.select("bucket", "node").join(sets.select("node", "shingles"), "node").select("bucket", "node", "shingles")
    rows = materialize(rows.mapInArrow(_unpacked, "bucket long, node long, size long, shingle long"), "shingles")
    shared = rows.groupBy("bucket", "shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(shared, ["bucket", "shingle"])
    own = Window.partitionBy("bucket", "node")
    rows = rows.withColumn("place", F.row_number().over(own.orderBy("n", "shingle"))).withColumn("alone", F.col("size") - F.count(F.lit(1)).over(own))
    place = F.col("place") + F.col("alone")
    rows = rows.withColumn("short", place <= F.col("size") - F.ceil(F.col("size") * 2 * percent / (100 + percent)) + 1)
    first = rows.where(place <= F.col("size") - F.ceil(F.col("size") * percent / 100) + 1).select(F.xxhash64("bucket", "shingle").alias("bucket"), "node", "short")
    first = materialize(first, "first-shingles")
    return first.join(first.where("short").select("bucket").distinct(), "bucket", "left_semi").select("bucket", "node")


def _confirmed(percent: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column("sa"), batch.column("sb")
            ok = []
            for i in range(len(a)):
                x, y = np.frombuffer(a[i].as_py(), U64), np.frombuffer(b[i].as_py(), U64)
                small, large = (x, y) if len(x) < len(y) else (y, x)
                if 100 * len(small) < percent * len(large):
                    ok.append(False)
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


def similarity(x: str, y: str):
    """Collision-corrected similarity of two packed signatures: equal BITS-wide fields, less what chance makes equal."""
    fold = f"aggregate(zip_with({x}, {y}, (p, q) -> bit_count(((p ^ q) | shiftrightunsigned(p ^ q, 1) | shiftrightunsigned(p ^ q, 2) | shiftrightunsigned(p ^ q, 3)) & 1229782938247303441L)), 0, (s, z) -> s + z)"
    return F.expr(f"(({PERMS} - {fold}) / {float(PERMS)}D - {2.0**-BITS}D) / {1 - 2.0**-BITS}D")


def _blocks(least: float, percent: int):
    """Links of one block pair of a bucket between nodes of different components: a forest, no more."""
    field = np.uint64(0x1111111111111111)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        i, j = int(part["i"].iloc[0]), int(part["j"].iloc[0])
        part = part.sort_values("node", kind="stable")
        node, comp, blk = part["node"].to_numpy(), part["comp"].to_numpy().copy(), part["blk"].to_numpy()
        bits = np.stack(part["bits"].to_numpy()).astype(np.int64).view(U64)
        bands = np.stack(part["bands"].to_numpy()).astype(np.int64)
        own = np.flatnonzero(bands[0] == part["bucket"].iloc[0])
        earlier = bands[:, : int(own[0]) if len(own) else 0]  # a narrower bucket is none of the bands
        sets = [np.frombuffer(x, np.uint32) for x in part["small"]]
        size = np.array([len(x) for x in sets])
        names, places = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(size)
        here = np.zeros(len(names), np.int32)
        right = np.flatnonzero(blk == j)
        us, vs = [], []
        for p in np.flatnonzero(blk == i).tolist():
            if (comp[right] == comp[p]).all():
                continue
            x = bits[right] ^ bits[p]
            x |= x >> U64(1)
            x |= x >> U64(2)
            est = ((PERMS - np.bitwise_count(x & field).sum(axis=1, dtype=np.int64)) / PERMS - 2.0**-BITS) / (1 - 2.0**-BITS)
            at = right[(est >= least) & (comp[right] != comp[p]) & ((right > p) if i == j else True)]
            at = at[~(earlier[at] == earlier[p]).any(axis=1)]  # the pair's first common bucket compares it
            if not len(at):
                continue
            here[places[ends[p] - size[p] : ends[p]]] = 1
            inner = np.arange(size[at].sum()) - np.repeat(np.cumsum(size[at]) - size[at], size[at])
            both = np.add.reduceat(here[places[np.repeat(ends[at] - size[at], size[at]) + inner]], np.cumsum(size[at]) - size[at])
            here[places[ends[p] - size[p] : ends[p]]] = 0
            for q in at[100 * both >= percent * (size[p] + size[at] - both)].tolist():
                if comp[q] != comp[p]:
                    us.append(max(node[p], node[q])), vs.append(min(node[p], node[q]))
                    comp[comp == comp[q]] = comp[p]
        return pd.DataFrame({"u": np.array(us, np.int64), "v": np.array(vs, np.int64)})

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) of the nodes of edges (u, v): alternating large-star and small-star steps."""
    cur, before = materialize(edges.selectExpr("greatest(u, v) as u", "least(u, v) as v").where("u > v").distinct(), "edges"), None
    while True:
        both = cur.unionByName(cur.selectExpr("v as u", "u as v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        large = both.join(low, "u").where("v > u").selectExpr("v as u", "m as v").where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.selectExpr("v as u", "m as v").where("u <> v").unionByName(low.selectExpr("u", "m as v"))
        last, cur = cur, materialize(small.selectExpr("greatest(u, v) as u", "least(u, v) as v").distinct(), "edges")
        now = cur.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        release(last)
        if now == before:
            return cur.selectExpr("u as node", "v as comp")
        before = now


def _open(rows: DataFrame) -> DataFrame:
    """rows (bucket, node, comp) of the buckets that hold two components, with size, their number in the bucket."""
    found = rows.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count(F.lit(1)).alias("size")).where("a < b")
    return rows.drop("size").join(found.select("bucket", "size"), "bucket")


def classes(docs: DataFrame, percent: int = 75, words: int = WORDS) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, comp (number of the component; null: linked with nothing), component_id of every row of docs."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    least, parts = percent / 100 - MARGIN, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sigs = materialize(docs.mapInArrow(_signatures(words), _SIGS), "signatures")
    some = sigs.where("n_shingles > 0 and doc_id is not null")
    nodes = some.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "th", "bands", "bits")).alias("r"))
    # numbers are given once: the table is written before anything reads them
    nodes = materialize(nodes.select("d1", "d2", "r.*", F.monotonically_increasing_id().alias("node")), "nodes")
    bits = nodes.select("node", "bits")

    # a bucket's lead is its node of the smallest doc_id: buckets then share their leads, and pairs repeat
    pairs = nodes.select("doc_id", "node", F.explode("bands").alias("bucket"))
    leads = pairs.groupBy("bucket").agg(F.min(F.struct("doc_id", "node")).alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = materialize(pairs.drop("doc_id").join(leads.selectExpr("bucket", "lead.node as lead", "size"), "bucket"), "buckets")
    stars = rows.where("node <> lead").selectExpr("node as u", "lead as v").distinct()

    # full sets once, for every node that has company in a bucket, from one of its rows
    wanted = nodes.join(rows.select("node").distinct(), "node", "left_semi")
    texts = docs.where("doc_id is not null and text is not null").join(wanted.select("doc_id", "th").distinct().hint("shuffle_hash"), ["doc_id", "th"], "left_semi")
    sets = texts.select("text").mapInArrow(_sets(words), "d1 long, d2 long, shingles binary, small binary").dropDuplicates(["d1", "d2"])
    sets = materialize(sets.join(wanted.select("node", "d1", "d2"), ["d1", "d2"]).select("node", "shingles", "small"), "sets")

    def confirm(pairs: DataFrame, name: str) -> DataFrame:
        full = pairs.join(sets.selectExpr("node as u", "shingles as sa"), "u").join(sets.selectExpr("node as v", "shingles as sb"), "v")
        return materialize(full.select("u", "v", "sa", "sb").mapInArrow(_confirmed(percent), "u long, v long"), name)

    stars = stars.join(bits.selectExpr("node as u", "bits as bu"), "u").join(bits.selectExpr("node as v", "bits as bv"), "v").where(similarity("bu", "bv") >= least)
    links = confirm(stars.select("u", "v"), "star-links")
    comps = components(links)
    while True:
        mixed = rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        mixed = _open(mixed)
        if not mixed.where(F.col("size") > BLOCK).isEmpty():
            narrow = _narrowed(mixed.where(F.col("size") > BLOCK), sets, percent).join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            mixed = mixed.where(F.col("size") <= BLOCK).select("bucket", "node", "size", "comp").unionByName(_open(narrow).select("bucket", "node", "size", "comp"))
        mixed = mixed.join(nodes.select("node", "bits", "bands"), "node").join(sets.select("node", "small"), "node")
        mixed = mixed.withColumn("nb", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("blk", F.expr("cast(pmod(xxhash64(node), nb) as int)"))
        mixed = mixed.withColumn("o", F.explode(F.expr("sequence(0, nb - 1)"))).selectExpr("bucket", "node", "comp", "bits", "bands", "small", "blk", "least(blk, o) as i", "greatest(blk, o) as j")
        more = materialize(mixed.repartition(parts, "bucket", "i", "j").groupBy("bucket", "i", "j").applyInPandas(_blocks(least, percent), "u long, v long").distinct(), "more-pairs")
        late = confirm(more, "more-links")
        found = late.count()
        if found:
            links = links.unionByName(late)
            comps = components(links)
        if not found or found == more.count():  # else a pair that 32 bits let through may have hidden another
            break
    release(rows, sets)

    # each node with its component's smallest doc_id
    named = nodes.select("d1", "d2", "doc_id", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = materialize(named.drop("node"), "named")
    first = named.groupBy("comp").agg(F.min("doc_id").alias("first"))
    named = named.select("d1", "d2", "comp").join(first, "comp")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    out = sigs.select("doc_id", "th", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    return out.select("doc_id", "th", "n_shingles", F.when(linked, F.col("comp")).alias("comp"), F.when(linked, F.col("first")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 75, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return classes(docs, percent, words).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, percent: int = 75, words: int = WORDS) -> DataFrame:
    """Rows of docs, all columns as they are: one of each component, and one of the rows that repeat a doc_id and its text.

    Of a component the row of the smallest doc_id stays (of two texts under it, that of the smaller text hash); rows with an
    empty set are one component each; rows without a doc_id all stay.  Which of several rows of equal doc_id and text stays is
    settled by a hash of their other columns.
    """
    judged = classes(docs, percent, words).where("doc_id is not null")
    best = judged.where("comp is not null").groupBy("comp").agg(F.min(F.struct("doc_id", "th")).alias("r")).select("r.*")
    best = best.unionByName(judged.where("comp is null").select("doc_id", "th"))
    best = materialize(best.select(F.col("doc_id").alias("__kb_id"), F.col("th").alias("__kb_th")).distinct(), "representatives")
    known = docs.withColumn("__kb_h", F.xxhash64("text"))
    stay = known.join(best, (F.col("doc_id") == F.col("__kb_id")) & (F.col("__kb_h") == F.col("__kb_th")), "left_semi")
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    once = F.row_number().over(Window.partitionBy("doc_id", "__kb_h").orderBy(F.xxhash64(*plain)))
    stay = stay.withColumn("__kb_n", once).where("__kb_n = 1").drop("__kb_n", "__kb_h")
    return stay.unionByName(docs.where("doc_id is null"))
