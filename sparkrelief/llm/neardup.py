"""Operator 7: near-duplicates by MinHash and a multi-index Hamming join.

A document's shingles are hashed; the b-bit signature has ``HASHES`` symbols of
``BITS`` bits. It is split into ``CHUNKS`` chunks. By the pigeonhole principle,
two signatures that differ in at most ``2 * CHUNKS - 1`` symbols have a chunk
with at most one difference; so each chunk is indexed once for every symbol left
out (the allowed error), and every pair within that distance shares a key. At a
similarity of 0.8 a symbol differs with a probability of at most 0.2, so a pair
exceeds the distance with a probability under four in a million (binomial tail).

Pairs are confirmed on full shingle sets. To find components it isn't needed to
compare all members of a key: first each is compared with one representative
(two rounds, with different representatives); members of one key that are still
in different components are then compared by signature, in blocks of bounded
size. A block holds its members' signatures and short hashes of their sets; each
pair within the distance is judged in the block of its first common key, and
only pairs that may reach the similarity leave it, to be confirmed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, giving_back, mix, pair, partitions, read, shingle_hashes, slices, staged, word_hashes
from .components import components

#: Symbols of a signature, bits of a symbol, chunks of a signature.
HASHES, BITS, CHUNKS = 48, 16, 12
DISTANCE = 2 * CHUNKS - 1
_EACH = HASHES // CHUNKS
#: Members of one key compared in one block.
BLOCK = 2048
#: Pairs of one document that are confirmed in one place.
PART = 512
#: Rounds that compare members of a key with one representative.
STAR_ROUNDS = 2
_SEED = np.random.default_rng(7)
_A = _SEED.integers(1, 1 << 63, HASHES, dtype=np.int64).astype(U) | U(1)
_B = _SEED.integers(1, 1 << 63, HASHES, dtype=np.int64).astype(U)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The b-bit MinHash of a non-empty set of shingle hashes."""
    least = np.full(HASHES, ~U(0))
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 2048):
            some = shingles[i : i + 2048]
            h = some[None, :] * _A[:, None] + _B[:, None]
            h ^= h >> U(31)
            np.minimum(least, (h * U(0x9E3779B97F4A7C15)).min(1), out=least)
    return (mix(least) >> U(64 - BITS)).astype("<u2")


def _signed(shingle: int):
    def run(batches):
        for batch in slices(batches):
            out = []
            for t in batch["text"].to_pylist():
                s = shingle_hashes(word_hashes(t), shingle) if t else np.empty(0, U)
                if not len(s):
                    out.append((0, None, None))
                    continue
                with np.errstate(over="ignore"):
                    k = np.arange(1, len(s) + 1, dtype=U)
                    whole = np.array([mix(pair(s, k)).sum(dtype=U), mix(s ^ (s << U(7))).sum(dtype=U)]).tobytes()
                out.append((len(s), whole, signature(s).tobytes()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], ["doc_id", "n_shingles", "set_hash", "sig"])

    return run


def _keyed(batches):
    """(key, id) of each signature, for every chunk and symbol of it left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), "<u2").reshape(-1, HASHES).astype(U)
        ids = batch["id"].to_numpy()
        keys = np.empty((len(ids), HASHES), U)
        with np.errstate(over="ignore"):
            for c in range(CHUNKS):
                for gap in range(_EACH):
                    h = np.full(len(ids), U(c * _EACH + gap + 1))
                    for j in range(_EACH):
                        if j != gap:
                            h = pair(h, sig[:, c * _EACH + j] + U(j << 16))
                    keys[:, c * _EACH + gap] = (mix(h) & ~U(63)) | U(c * _EACH + gap)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids, HASHES))], ["key", "id"])


def _near(batches):
    """Pairs whose signatures are within the distance and whose sizes allow the similarity."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u2").reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
        ok = (a != b).sum(1) <= DISTANCE
        yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(ok)), batch["b"].filter(pa.array(ok))], ["a", "b"])


def _confirmed(shingle: int, percent: int):
    """Pairs of texts whose shingle sets reach the similarity, from rows sorted by group: the text of ``a`` (``b`` null), then those of its ``b``."""

    def run(batches):
        group, kept = None, []
        for batch in batches:
            out = []
            for a, part, b, text in zip(*[batch[c].to_pylist() for c in ("a", "part", "b", "text")], strict=True):
                if (a, part) != group:
                    group, kept = (a, part), []
                t = shingle_hashes(word_hashes(text), shingle)
                if b is None:
                    # an id with several rows has several texts
                    if not any(np.array_equal(k, t) for k in kept):
                        kept.append(t)
                    continue
                for k in kept:
                    both = len(k) + len(t) - len(np.union1d(k, t))
                    if 100 * both >= percent * (len(k) + len(t) - both):
                        out.append((a, b))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], ["a", "b"])

    return run


def _with_texts(pairs: DataFrame, source: DataFrame) -> DataFrame:
    """(a, part, b, text): each pair's text of ``b``, and the text of ``a`` once for each part of its pairs.

    A part has about ``PART`` pairs. The pairs of one ``a`` are first gathered by a hash of ``b``, so that an id
    with very many pairs is spread before it is counted.
    """
    spread = partitions(pairs.sparkSession)
    gathered = pairs.groupBy("a", F.pmod(F.xxhash64("b"), F.lit(spread)).alias("slot")).agg(F.collect_list("b").alias("bs"))
    gathered = staged(gathered, "gathered")
    parts = gathered.groupBy("a").agg(F.ceil(F.sum(F.size("bs")) / PART).alias("parts"))
    dealt = gathered.join(parts, "a").select("a", F.pmod("slot", F.least("parts", F.lit(spread))).cast("int").alias("part"), F.explode("bs").alias("b"))
    # written, so that few pairs are known to be few and texts needn't be dealt to meet them
    dealt = staged(dealt, "dealt")
    heads = staged(dealt.select("a", "part").distinct(), "heads")
    texts = source.select("doc_id", F.col("text").cast("binary").alias("text")).where("text is not null")
    of_b = dealt.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "part", "b", "text")
    of_a = heads.join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    return of_a.union(of_b).repartition(spread, "a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))


def _short_sets(shingle: int):
    """Sorted 32-bit hashes of each text's shingles."""

    def run(batches):
        for batch in batches:
            sets = [np.unique((shingle_hashes(word_hashes(t), shingle) >> U(32)).astype("<u4")).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(sets, pa.binary())], ["id", "short"])

    return run


def _first_common(equal: np.ndarray) -> np.ndarray:
    """For rows of equal symbols, the first index (chunk and symbol left out) by which both have one key."""
    per = equal.reshape(len(equal), CHUNKS, _EACH)
    count = per.sum(2)
    chunk = (count >= _EACH - 1).argmax(1)
    rows = np.arange(len(equal))
    gap = np.where(count[rows, chunk] == _EACH, 0, (~per[rows, chunk]).argmax(1))
    return chunk * _EACH + gap


def _block_links(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Pairs of one (key, block) that are in different components and may reach the similarity.

    Short hashes may collide. Inside a set they then make its short form smaller, by a number that is known for each
    set; at most so many common shingles are not counted, and they are allowed for. The full sets decide.
    """
    ids = [r[1] for r in rows]
    comp = np.array([r[2] for r in rows])
    size = np.array([r[3] for r in rows], float)
    side = np.array([r[5] for r in rows])
    sig = np.frombuffer(b"".join([r[4] for r in rows]), "<u2").reshape(-1, HASHES)
    sets = [np.frombuffer(r[7], "<u4") for r in rows]
    lost = size - [len(x) for x in sets]
    mask, out = rows[0][0] & 63, []
    for i in range(len(rows) - 1):
        j = np.arange(i + 1, len(rows))
        j = j[(comp[j] != comp[i]) & ((side[j] != side[i]) | (side[i] == 0)) & (100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i]))]
        if not len(j):
            continue
        equal = sig[j] == sig[i]
        near = np.flatnonzero(equal.sum(1) >= HASHES - DISTANCE)
        near = near[_first_common(equal[near]) == mask] if len(near) else near
        for k in range(0, len(near), 256):
            some = j[near[k : k + 256]]
            lengths = np.array([len(sets[x]) for x in some])
            every = np.concatenate([sets[x] for x in some])
            at = np.minimum(np.searchsorted(sets[i], every), len(sets[i]) - 1)
            both = np.add.reduceat((sets[i][at] == every).astype(np.int64), np.cumsum(lengths) - lengths) + np.minimum(lost[i], lost[some])
            for x in some[100 * both >= percent * (size[i] + size[some] - both)].tolist():
                out.append((min(ids[i], ids[x]), max(ids[i], ids[x])))
    return out


def _across(percent: int):
    """Each (key, block) of sorted rows to its pairs."""

    def run(batches):
        held: list[tuple] = []

        def flushed(rows):
            got = sorted(set(_block_links(rows, percent))) if len(rows) > 1 else []
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], ["a", "b"])

        for batch in batches:
            for r in zip(*[batch[c].to_pylist() for c in ("key", "id", "component", "n_shingles", "sig", "side", "block", "short")], strict=True):
                if held and (held[0][0], held[0][6]) != (r[0], r[6]):
                    yield from flushed(held)
                    held = []
                held.append(r)
        yield from flushed(held)

    return run


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Words are runs of bytes other than blanks, A-Z lower-cased. Null texts and texts without words have an empty
    set and are linked with nothing; shorter texts have one shingle. Texts with equal sets (copies, repeated
    rows) count once until the end. Of rows with one doc_id, each gets the component of its own text. A null
    doc_id stands alone. Extra columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select("doc_id", "text")
    signed = source.withColumn("text", F.col("text").cast("binary")).mapInArrow(giving_back(_signed(shingle)), "doc_id long, n_shingles long, set_hash binary, sig binary")
    signed = staged(signed, "signed")
    able = signed.where("sig is not null and doc_id is not null")
    sets = staged(able.groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "sets")
    keys = sets.select("id", "sig").mapInArrow(_keyed, "key long, id long")
    shared = keys.groupBy("key").agg(F.min("id").alias("rep"), F.max("id").alias("_most")).where("rep < _most").drop("_most")
    members = staged(keys.join(shared, "key"), "members")
    labels = sets.select("id", F.col("id").alias("component"))
    links = None
    for turn in range(STAR_ROUNDS + 1):
        if turn:
            labelled = members.select("key", "id").join(labels, "id")
            open_keys = labelled.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.max_by("id", F.xxhash64("id", F.lit(turn))).alias("rep"), F.count(F.lit(1)).alias("n")).where("c0 < c1").drop("c0", "c1")
            labelled = labelled.join(open_keys, "key")
        if turn == 0:
            pairs = members.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()
        elif turn < STAR_ROUNDS:
            of = labels.select(F.col("id").alias("rep"), F.col("component").alias("rep_component"))
            pairs = labelled.join(of, "rep").where("component <> rep_component").select(F.least("rep", "id").alias("a"), F.greatest("rep", "id").alias("b")).distinct()
        else:
            pairs = _residual(labelled, sets, source, shingle, percent)
        if turn < STAR_ROUNDS:
            sig = sets.select("id", "sig", "n_shingles")
            with_a = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"), F.col("n_shingles").alias("n_a")), "a")
            with_b = with_a.join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"), F.col("n_shingles").alias("n_b")), "b")
            pairs = with_b.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b", "sig_a", "sig_b").mapInArrow(_near, "a long, b long")
        pairs = staged(pairs, "pairs")
        found = _with_texts(pairs, source).mapInArrow(giving_back(_confirmed(shingle, percent)), "a long, b long")
        found = staged(found, "found")
        if turn and not found.limit(1).count():
            continue
        links = found if links is None else staged(links.union(found), "links")
        linked = components(links)
        labels = staged(sets.select("id").join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "labels")
    out = signed.join(sets.select("set_hash", "id"), "set_hash", "left").join(labels, "id", "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _residual(labelled: DataFrame, sets: DataFrame, source: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs that may reach the similarity among members of one key in different components, by blocks of bounded size.

    A key with more members than ``BLOCK`` is dealt into parts; every two parts meet in a block of their own.
    """
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    part = F.pmod(F.xxhash64("id"), parts).cast("int")
    # a part meets itself once, and the others as the lower (1) or the upper (2) side
    block = F.transform(F.sequence(F.lit(0), parts - 1), lambda o: F.struct((F.least(part, o).cast("long") * 1_000_000 + F.greatest(part, o)).alias("block"), F.when(part == o, F.lit(0)).when(part < o, F.lit(1)).otherwise(F.lit(2)).alias("side")))
    dealt = labelled.select("key", "id", "component", F.explode(block).alias("b")).select("key", "id", "component", "b.block", "b.side")
    open_ids = labelled.select("id").distinct()
    texts = source.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    short = staged(texts.join(open_ids, "id", "left_semi").mapInArrow(giving_back(_short_sets(shingle)), "id long, short binary").join(sets.select("id", "n_shingles", "sig"), "id"), "short")
    full = dealt.join(short, "id")
    return full.repartition(partitions(labelled.sparkSession), "key", "block").sortWithinPartitions("key", "block", "id").mapInArrow(giving_back(_across(percent)), "a long, b long").distinct()


def one_of_each(docs: DataFrame) -> DataFrame:
    """Pipeline stage: one document of each group of near-duplicates stays (five words, 0.8), with its columns, whatever their names.

    The one with the smallest id stays. Of rows with its id, those of equal text count as one; other texts with that
    id all stay. Null and empty texts and rows without an id are alike to nothing and stay. An empty table gives an
    empty one.
    """
    judged = staged(near_duplicates(docs, shingle=5).where("kept").groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("rows")), "judged")
    several = staged(judged.where("rows > 1 and id is not null").select("id"), "several")
    named = docs.select(F.struct("*").alias("row"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    alone = named.drop("text").join(judged.where("rows = 1 or id is null"), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    # ids with several rows are few as a rule, and then no text is dealt out to meet them
    copied = named.join(several, F.col("doc_id") == F.col("id"), "left_semi").dropDuplicates(["doc_id", "text"])
    return alone.select("row").union(copied.select("row")).select("row.*")


def op7_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
