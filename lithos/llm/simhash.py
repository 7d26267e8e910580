"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import fresh, materialize
from .components import connected_components

BITS, RADIUS = 64, 3
CHUNK = 1 << 16
TASK_ROWS = 2_000_000


def words_of(text: bytes | None) -> list[bytes]:
    """Words between the six ASCII blanks, with A-Z lower-cased."""
    return (text or b"").lower().split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``k`` words, or of all words if they are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    k = min(k, len(words))
    whole = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    h, out = xxhash.xxh64_intdigest, np.empty(len(words) - k + 1, np.uint64)
    for at in range(0, len(out), CHUNK):
        stop = min(at + CHUNK, len(out))
        out[at:stop] = [h(whole[s:e], 42) for s, e in zip(starts[at:stop].tolist(), ends[at + k - 1 : stop + k - 1].tolist(), strict=True)]
    return out


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit i is 1 if over half of the hashes have it; as a signed 64-bit number."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[at : at + CHUNK])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)``, a row for each row of ``docs``.

    A null or blank text has no shingle and the fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = [fingerprint_of(shingle_hashes(words_of(t.as_py()), shingle)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    from pyspark.sql import types as T

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: its size as planned (compressed, or before an explode) says too little for a broadcast."""
    return df.hint("merge")


def _half(fp: Column, half: int) -> Column:
    """Half 0 or 1 of a fingerprint, with the number of the half above it, as one key."""
    bits = F.shiftrightunsigned(fp, 32) if half else fp
    return bits.bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(half << 32))


def near_links(fps: DataFrame, col: str = "fp", dense: int = 256) -> DataFrame:
    """All pairs ``(a, b)``, a < b, of distinct fingerprints at up to three differing bits.

    One of the two 32-bit halves of such a pair differs in one bit at most.
    So every fingerprint emits, for each half, all variants within half the
    radius (3 // 2 = 1: 33 variants) on one side of the shuffle and the half
    itself on the other; pairs that collide are verified on all 64 bits.
    A half that more than ``dense`` fingerprints share is split by the
    16-bit quarters of the other half, of which again one differs in one bit
    at most: the same links, from smaller buckets.
    """
    fps = fps.select(F.col(col).cast("long").alias("fp")).filter("fp is not null").distinct()
    # by rows, not bytes: each becomes 66, so that no task writes more than TASK_ROWS
    fps = fps.repartition(1 + fps.count() * 66 // TASK_ROWS, "fp")
    flips = [0] + [1 << i for i in range(32)]
    exact = fps.select("fp", F.explode(F.array(_half(F.col("fp"), 0), _half(F.col("fp"), 1))).alias("key"))
    ball = lambda half: F.array(*[_half(F.col("fp"), half).bitwiseXOR(F.lit(m)) for m in flips])
    variants = fps.select("fp", F.explode(F.concat(ball(0), ball(1))).alias("key"))
    hot = materialize(exact.groupBy("key").count().filter(F.col("count") > dense).select("key"), "hot")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS

    def met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        left = left.withColumnRenamed("fp", "a").alias("l")
        right = right.withColumnRenamed("fp", "b").alias("r")
        same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on]
        cond = same[0]
        for s in same[1:]:
            cond = cond & s
        return left.join(_large(right), cond & (F.col("a") < F.col("b")) & near).select("a", "b")

    if hot.isEmpty():
        return met(exact, variants, ["key"]).distinct()
    plain = met(exact.join(hot, "key", "left_anti"), variants, ["key"])

    def quarters(rows: DataFrame, wide: bool) -> DataFrame:
        other = F.when(F.shiftrightunsigned("key", 32) == 1, F.col("fp")).otherwise(F.shiftrightunsigned("fp", 32))
        q = [F.shiftrightunsigned(other, 16 * i).bitwiseAND(F.lit(0xFFFF)).bitwiseOR(F.lit(i << 16)) for i in (0, 1)]
        steps = [0] + ([1 << i for i in range(16)] if wide else [])
        return rows.select("fp", "key", F.explode(F.array(*[x.bitwiseXOR(F.lit(m)) for x in q for m in steps])).alias("quarter"))

    split = met(quarters(exact.join(hot, "key", "left_semi"), False), quarters(variants.join(hot, "key", "left_semi"), True), ["key", "quarter"])
    return plain.unionByName(split).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)``: fingerprints within three bits link, links join groups.

    A row comes back for each input row. component_id is the smallest doc_id
    of the group, null only if all its doc_ids are. Equal fingerprints are one
    node, so a group of copies of any size costs one; repeated rows stay.

    An empty table gives no row. A long text is hashed in chunks, in time in
    proportion to its length.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected_components(near_links(nodes))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = materialize(named.join(least, "root").select("fp", "component_id"), "groups")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


# ---- whole-text similarity: what the corpus pipeline needs -----------------

BANDS, ROWS, SLOTS, TURNS = 18, 6, 4, 6


def _minhash_params(n: int) -> tuple[np.ndarray, np.ndarray]:
    made = np.random.Generator(np.random.PCG64(2024)).integers(1, 2**63, size=(2, n), dtype=np.uint64)
    return made[0] | np.uint64(1), made[1]


def band_keys(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> list[int]:
    """A key for each band of ``rows`` minima of the hashes: two sets of similarity s agree in a band with chance s ** rows."""
    if not len(hashes):
        return []
    mul, add = _minhash_params(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        for i in range(bands * rows):
            x = part * mul[i] + add[i]
            x ^= x >> np.uint64(29)
            least[i] = min(least[i], x.min())
    cut = least.reshape(bands, rows)
    return [int(np.uint64(xxhash.xxh64_intdigest(cut[i].tobytes(), i)).astype(np.int64)) for i in range(bands)]


def features(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """``(id, n, fp, bands)`` for each row; id: MD5 of the text, 16 bytes; n: its distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fp, bands = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                all_of = shingle_hashes(words_of(text.as_py()), shingle)
                distinct = np.unique(all_of)
                n.append(len(distinct))
                fp.append(fingerprint_of(all_of))
                bands.append(band_keys(distinct))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "n", "fp", "bands"])

    return _classed(docs, text_col).mapInArrow(run, "id binary, n long, fp long, bands array<long>")


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``(id, shingles)``, the distinct hashes, for each row of ``(id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.unique(shingle_hashes(words_of(t.as_py()), shingle)).view(np.int64) for t in part.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return texts.select("id", "text").mapInArrow(run, "id binary, shingles array<long>")


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _class(text_col: str) -> Column:
    """What names a text, however its rows are dealt: its MD5."""
    return F.unhex(F.md5(_text(text_col)))


def _classed(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(_class(text_col).alias("id"), _text(text_col).alias("text"))


def _active(named: DataFrame, before: DataFrame | None) -> DataFrame:
    """``(key, groups)`` of the buckets whose texts are in different groups, and in fewer than ``before``, if given."""
    now = named.select("key", "root").distinct().groupBy("key").agg(F.count("*").alias("groups")).filter("groups > 1")
    if before is not None:
        now = now.join(before.withColumnRenamed("groups", "were"), "key").filter("groups < were").select("key", "groups")
    return materialize(now, "active")


def _across(named: DataFrame, turn: int, fits: Column, ordered: list[Column]) -> DataFrame:
    """Pairs ``(a, b)`` of texts of a bucket that are in different groups: each with two texts from each of SLOTS parts of the bucket.

    Of a part these are a random text and the most central one; parts are
    dealt anew each turn. Both are aggregates, so that no bucket comes to
    one task.
    """
    at = F.xxhash64("x.id", "key", F.lit(turn))
    parts = named.groupBy("key", F.pmod(at, F.lit(SLOTS)).alias("part")).agg(F.min(F.struct(at.alias("at"), "x", "root")).alias("lo"), F.max(F.struct("central", "x", "root")).alias("hub"))
    parts = parts.select("key", F.explode(F.array_distinct(F.array(F.struct("lo.x", "lo.root"), F.struct("hub.x", "hub.root")))).alias("end"))
    parts = parts.select("key", F.col("end.x").alias("y"), F.col("end.root").alias("other"))
    return named.join(parts, "key").filter((F.col("root") != F.col("other")) & fits).select(*ordered).distinct()


def _untested(sets: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(a, b)`` of texts in different groups that no bound excludes from ``similarity``: all of them.

    With the shingles of every text in one order, the rarest first, two texts
    of that similarity share one of the first n - ceil(similarity * n) + 1 of
    both, and from the first shared one on enough shingles are left in both.
    Of the holders of a shingle those of its largest group meet only the
    others, so a family that is one group already costs nothing.
    """
    each = sets.select("id", "n", F.explode("shingles").alias("shingle"))
    counts = materialize(each.groupBy("shingle").agg(F.count("*").alias("texts")).filter("texts > 1"), "counts")
    ranked = each.join(counts, "shingle", "left").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("texts", F.lit(1)).alias("texts"), "shingle"))).alias("all"))
    first = (F.col("n") - F.ceil(similarity * F.col("n") - 1e-6) + 1).cast("int")
    heads = ranked.select("id", "n", F.posexplode(F.slice("all", F.lit(1), first)).alias("at", "s")).filter("s.texts > 1")
    heads = heads.join(roots.withColumnRenamed("node", "id"), "id", "left")
    heads = materialize(heads.select("id", "n", F.coalesce("root", "id").alias("root"), "s.shingle", (F.col("n") - F.col("at")).alias("left")), "heads")
    held = heads.groupBy("shingle", "root").agg(F.count("*").alias("texts"))
    mixed = held.groupBy("shingle").agg(F.max(F.struct("texts", "root"))["root"].alias("main"), F.count("*").alias("groups")).filter("groups > 1")
    mixed = materialize(heads.join(mixed.select("shingle", "main"), "shingle"), "mixed")
    x, y = mixed.filter("root <> main").alias("x"), mixed.alias("y")
    needed = similarity / (1 + similarity) * (F.col("x.n") + F.col("y.n")) - 1e-6
    cond = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.id") < F.col("y.id")))
    cond = cond & (F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n")) & (F.least("x.left", "y.left") >= needed)
    return x.join(y, cond).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def similar_groups(docs: DataFrame, text_col: str = "text", shingle: int = 5, similarity: float = 0.8, exact: bool = False) -> DataFrame:
    """``(id, root)`` of the texts that have a near-duplicate: Jaccard similarity of word shingles of ``similarity`` or more.

    id: MD5 of the text, null read as empty. Candidates come from ball hashing
    of 64-bit SimHashes and, since texts of similarity 0.8 differ in some ten
    of 64 bits, from min-wise bands over the same shingle hashes. In a bucket
    every text meets the first one and the most central one (whose buckets
    hold the most texts: the one with the least changes of its own), not all
    others, so a bucket of any size costs two candidates a text. Texts of a
    bucket that are in different groups then meet further ones of it, turn by
    turn, until a turn joins no groups of that bucket or TURNS are over. Of
    all texts of buckets, the pairs still in different groups are then
    candidates unless a bound excludes them. Each candidate is verified on
    all shingles. Texts are named and ordered by their MD5, so the result
    does not depend on how rows are dealt.

    Only a text that shares no bucket with its near-duplicates is missed. With
    ``exact`` the last pass takes the shingles of all texts, not just those in
    buckets: no pair is lost, for a shuffle of all shingles.

    Equal texts are one class; texts without words are similar to each other
    only; an empty table gives no row. A text's cost is its length times the
    108 minima of its bands.
    """
    light = materialize(features(docs, text_col, shingle).dropDuplicates(["id"]), "features")
    some = F.struct("id", "n")
    # texts that share a fingerprint meet its first one; fingerprints within the radius meet by their first texts
    first = materialize(light.groupBy("fp").agg(F.min(some).alias("first")), "first")
    end = lambda fp, text: first.select(F.col("fp").alias(fp), F.col("first").alias(text))
    balls = near_links(first).join(end("a", "x"), "a").join(end("b", "y"), "b").select("x", "y")
    same = light.select("fp", some.alias("x")).join(end("fp", "y"), "fp").select("x", "y")
    banded = light.select(some.alias("x"), F.explode("bands").alias("key"))
    crowds = banded.groupBy("key").agg(F.count("*").alias("texts")).filter("texts > 1")
    mine = Window.partitionBy("x.id")  # a row for each band at most
    shared = materialize(banded.join(crowds, "key").select("key", "x", F.sum("texts").over(mine).alias("central")), "shared")
    ends = shared.groupBy("key").agg(F.min("x").alias("lo"), F.max(F.struct("central", "x")).alias("hub"))
    met = shared.join(ends, "key").select("x", F.explode(F.array_distinct(F.array("lo", "hub.x"))).alias("y"))
    fits = (F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n")) & (F.col("x.id") != F.col("y.id"))
    ordered = [F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")]
    pairs = materialize(balls.unionByName(same).unionByName(met).filter(fits).select(*ordered).distinct(), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(shared.select(F.col("x.id").alias("id")))
    wanted = (light if exact else light.join(ids.distinct(), "id", "left_semi")).select("id", "n")
    texts = _classed(docs, text_col).dropDuplicates(["id"]).join(wanted, "id")
    sets = materialize(shingle_sets(texts, shingle).withColumn("n", F.size("shingles").cast("long")), "shingles")
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))

    def verified(some_pairs: DataFrame) -> DataFrame:
        found = some_pairs.join(left, "a").join(right, "b").filter(both >= similarity * (F.col("na") + F.col("nb") - both))
        return materialize(found.select("a", "b"), "links")

    tested, links, turn, active = pairs, verified(pairs), 0, None
    roots = connected_components(links)
    named = shared.join(roots.withColumnRenamed("node", "id"), F.col("x.id") == F.col("id"), "left").select("key", "x", "central", F.coalesce("root", "x.id").alias("root"))
    while turn < TURNS:
        active = _active(named, active)
        if active.isEmpty():
            break
        turn += 1
        named = materialize(named.join(active.select("key"), "key"), "mixed")
        more = materialize(_across(named, turn, fits, ordered).join(tested, ["a", "b"], "left_anti"), "pairs")
        found = verified(more)
        tested, links = tested.unionByName(more), links.unionByName(found)
        of = named.select(F.col("x.id").alias("id"), "root").distinct()
        end = lambda c: of.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
        joined = connected_components(found.join(end("a"), "a").join(end("b"), "b").select("ra", "rb"), "ra", "rb")
        renamed = joined.select(F.col("node").alias("root"), F.col("root").alias("later"))
        named = named.join(renamed, "root", "left").select("key", "x", "central", F.coalesce("later", "root").alias("root"))
    if turn:
        roots = connected_components(links)
    rest = verified(materialize(_untested(sets, roots, similarity).join(tested, ["a", "b"], "left_anti"), "pairs"))
    if not rest.isEmpty():
        roots = connected_components(links.unionByName(rest))
    return roots.select(F.col("node").alias("id"), "root")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, exact: bool = False) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest doc_id, null last, then of the least MD5.

    Exact copies and repeated rows are near-duplicates; null and empty texts
    are copies of each other; an empty table stays empty. All columns stay.
    See ``similar_groups`` for long texts, and for ``exact``.
    """
    group, unit = fresh(docs, "_group"), fresh(docs, "_unit")
    cls = _class(text_col)
    units = docs.select(F.col(id_col).alias("id"), cls.alias("cls")).groupBy("id", "cls").agg(F.count("*").alias("rows"))
    groups = similar_groups(docs, text_col, shingle, similarity, exact).withColumnRenamed("id", "cls")
    units = units.join(groups, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("cls").alias("cls"))
    winners = units.groupBy("root").agg(F.min(order).alias("w"))
    # by the winners themselves, not by group: no key of this join is hotter than another
    units = units.withColumn(unit, order).join(winners.select(F.col("w").alias(unit), F.lit(True).alias("won")), unit, "left")
    judged = materialize(units.select("id", "cls", "rows", F.coalesce("won", F.lit(False)).alias("wins")), "judged")
    rows = docs.withColumn(unit, F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), cls.alias("cls")))
    keyed = judged.select(order.alias(unit), "rows", "wins")
    lost = keyed.filter(~F.col("wins") | (F.col("rows") > 1)).select(unit)
    kept = rows.join(lost, unit, "left_anti").select(*docs.columns)
    again = keyed.filter(F.col("wins") & (F.col("rows") > 1)).select(unit)
    if again.isEmpty():
        return kept
    repeated = rows.join(again, unit, "left_semi").withColumn(group, F.col(unit)).dropDuplicates([group]).select(*docs.columns)
    return kept.unionByName(repeated)
