"""Near-duplicates: SimHash signatures of 256 bits, random bit-sampling tables, verified distances, connected groups."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyloom.llm.groups import row_ids
from polyloom.llm.tokens import Words, mix, portions
from polyloom.plans.bloom import bloom, might_contain
from polyloom.plans.components import components
from polyloom.plans.shared import materialize

BITS, LANES = 256, 4
#: Two documents are near-duplicates if at most so many of their bits differ: a cosine of 0.71 between their sets of word pairs.
MAX_DISTANCE = 64
#: At least so many tables; more where there are so many signatures that a pair at ``MAX_DISTANCE`` would be compared in none of them more often than once in ten.
TABLES = 32
#: A table's key has as many bits as leave about ``WHOLE`` times so many signatures in a bucket; those are compared each with each.
BUCKET, WHOLE = 320, 8
#: The chance that a pair at ``MAX_DISTANCE`` in one bucket is compared, if the bucket is too large to be compared whole.
MEET = 0.95
#: More tables than these have no place in a key; from there on buckets grow instead.
MOST_TABLES = 1023
SEED = 20250101
#: A task holds at most so many rows of a bucket, 10 MB of them. What a bucket has beyond it is compared in blocks, by other tasks.
HELD = 1 << 18


#: Eight bits as eight counters of a byte in one word of 64 bits.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0].copy()


def _ones_by_text(lanes: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each of the 256 bits is set in the rows of each text. Counters of a byte are added in stretches of at most 255 rows."""
    stretches = -(-counts // 255)
    begin = np.cumsum(stretches) - stretches
    at = np.repeat(first, stretches) + (np.arange(stretches.sum()) - np.repeat(begin, stretches)) * 255
    sums = np.add.reduceat(_SPREAD[lanes.view(np.uint8)], at, axis=0)
    return np.add.reduceat(sums.view(np.uint8).astype(np.int32), begin, axis=0)


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(four 64-bit lanes for each text, whether it has a word). Features are the distinct pairs of neighbouring words, the first word with a start mark."""
    out, some = np.zeros((len(texts), LANES), np.uint64), np.zeros(len(texts), bool)
    for a, b, data, offsets in portions(texts, 600_000):
        words = Words(data, offsets)
        h, rows = words.hashes(), words.rows
        if not len(h):
            continue
        with np.errstate(over="ignore"):
            before = np.full(len(h), 0x5851F42D4C957F2D, np.uint64)
            same = rows[1:] == rows[:-1]
            before[1:][same] = h[:-1][same]
            pair = mix(before * np.uint64(0x9E3779B97F4A7C15) + h)
        # distinct within a text: sorted by text, then by hash
        order = np.lexsort((pair, rows))
        pair, rows = pair[order], rows[order]
        fresh = np.ones(len(pair), bool)
        fresh[1:] = (pair[1:] != pair[:-1]) | (rows[1:] != rows[:-1])
        pair, rows = pair[fresh], rows[fresh]
        present, first, counts = np.unique(rows, return_index=True, return_counts=True)
        lanes = np.stack([mix(pair + np.uint64((0xA0761D6478BD642F * (k + 1)) % (1 << 64))) for k in range(LANES)], 1)
        ones = _ones_by_text(lanes, first, counts)
        # an even split is settled by the pairs' own sum, so that it doesn't favour ones
        majority = (2 * ones > counts[:, None]) | ((2 * ones == counts[:, None]) & (np.arange(BITS) % 2 == 1))
        out[a:b][present] = np.packbits(majority, axis=1).view(np.uint64)
        some[a:b][present] = True
    return out, some


def _together(bits: int) -> float:
    """The chance that a pair at ``MAX_DISTANCE`` agrees on so many sampled bits."""
    return math.prod((BITS - MAX_DISTANCE - i) / (BITS - i) for i in range(bits)) if bits <= BITS - MAX_DISTANCE else 0.0


def _needed(bits: int) -> int:
    """So many tables of ``bits`` bits miss a pair at ``MAX_DISTANCE`` once in ten, if each compares ``MEET`` of those that share a bucket."""
    return math.ceil(math.log(0.1) / math.log1p(-MEET * _together(bits)))


def bits_for(n: int, bucket: int = BUCKET) -> int:
    """How many bits the key of a table has: no more than the tables there may be can make up for."""
    bits = max(0, (n // (bucket * WHOLE)).bit_length())
    while _needed(bits) > MOST_TABLES:
        bits -= 1
    return bits


def tables_for(n: int, bucket: int = BUCKET) -> int:
    """How many tables ``n`` signatures take."""
    return max(TABLES, _needed(bits_for(n, bucket)))


def sampled(table: int) -> np.ndarray:
    """The coordinates of a table, in the order in which they're used."""
    return np.random.default_rng((SEED, table)).permutation(BITS)


def bits_at(lanes: np.ndarray, coordinates: np.ndarray) -> np.ndarray:
    """An integer from those coordinates of each signature, the first highest."""
    key = np.zeros(len(lanes), np.uint64)
    data = np.ascontiguousarray(lanes).view(np.uint8)
    for c in coordinates:
        key = (key << np.uint64(1)) | ((data[:, c // 8] >> (7 - c % 8)) & 1).astype(np.uint64)
    return key


def subbuckets(lanes: np.ndarray, coordinates: np.ndarray, used: int, most: int) -> list[np.ndarray]:
    """Rows of a bucket in parts of at most ``most``, split by further sampled bits. Distinct signatures differ somewhere, so it ends."""
    todo, done = [(np.arange(len(lanes)), used)], []
    while todo:
        rows, at = todo.pop()
        if len(rows) <= most or at >= len(coordinates):
            done.append(rows)
            continue
        step = min(len(coordinates) - at, max(1, (len(rows) // most).bit_length()))
        key = bits_at(lanes[rows], coordinates[at : at + step])
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        todo += [(part, at + step) for part in np.split(rows[order], cuts)]
    return done


def meetings(lanes: np.ndarray, seed: int, whole: int) -> Iterator[np.ndarray]:
    """Sets of a bucket's rows to be compared each with each, in which a pair at ``MAX_DISTANCE`` meets with a chance of at least ``MEET``, however dense the bucket is.

    A bucket above ``whole`` is split in several independent ways: to parts of ``whole``, but by no more bits than a depth which all share,
    and as often as makes up for that depth. The depth is that of the fewest comparisons; at 0 the bucket is compared whole.
    """
    order = lambda way: np.random.default_rng((SEED, seed & (1 << 64) - 1, way)).permutation(BITS)
    least, depth, ways = float(len(lanes)) ** 2, 0, 1
    for d in range(1, 41) if len(lanes) > whole else ():
        often = math.ceil(math.log1p(-MEET) / math.log1p(-_together(d)))
        sizes = np.array([len(p) for p in subbuckets(lanes, order(0)[:d], 0, whole)])
        if (cost := often * float((sizes.astype(float) ** 2).sum())) < least:
            least, depth, ways = cost, d, often
        if sizes.max() <= whole:
            break
    for way in range(ways):
        yield from subbuckets(lanes, order(way)[:depth], 0, whole)


def _near_blocks(lanes: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j at a distance of at most ``most``, some at a time."""
    for i in range(0, len(lanes), 128):
        for j in range(i, len(lanes), 4096):
            left, right = lanes[i : i + 128], lanes[j : j + 4096]
            distance = np.zeros((len(left), len(right)), np.uint16)
            for k in range(lanes.shape[1]):
                distance += np.bitwise_count(left[:, None, k] ^ right[None, :, k])
            a, b = np.nonzero(distance <= most)
            a, b = a + i, b + j
            later = b > a
            yield a[later], b[later]


def near_pairs(lanes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j at a distance of at most ``most``."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *_near_blocks(lanes, most)]
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def forest(ids: np.ndarray, lanes: np.ndarray, most: int) -> np.ndarray:
    """Near pairs that connect what all near pairs connect, as rows of (lesser id, greater id): at most len(ids) - 1."""
    root = np.arange(len(ids))  # of each row, the one that stands for all it is connected with
    kept = []
    for i, j in _near_blocks(lanes, most):
        for s in range(0, len(i), 4096):
            a, b = i[s : s + 4096], j[s : s + 4096]
            fresh = root[a] != root[b]
            if not fresh.any():
                continue
            a, b = a[fresh], b[fresh]
            up: dict[int, int] = {}

            def find(x: int) -> int:
                while (y := up.get(x, x)) != x:
                    up[x] = x = up.get(y, y)
                return x

            for x, y, rx, ry in zip(a.tolist(), b.tolist(), root[a].tolist(), root[b].tolist()):
                rx, ry = find(rx), find(ry)
                if rx != ry:
                    up[max(rx, ry)] = min(rx, ry)
                    kept.append((x, y))
            now = np.arange(len(ids))
            now[list(up)] = [find(x) for x in list(up)]
            root = now[root]
    if not kept:
        return np.zeros((0, 2), np.int64)
    return np.sort(ids[np.array(kept)], axis=1)


def _runs(batches: Iterator[pa.RecordBatch], held: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, bool]]:
    """(bucket, ids, lanes, block, whether others follow) of each run of equal buckets in sorted batches, in blocks of ``held`` rows, however long the run is."""
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    now, size, block = None, 0, 0

    def all_of(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])

    for batch in batches:
        bucket = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(bucket):
            continue
        ids = batch.column(1).to_numpy(zero_copy_only=False)
        lanes = np.stack([batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(LANES)], 1).view(np.uint64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        for s, e in zip(cuts[:-1], cuts[1:]):
            if waiting and bucket[s] != now:
                yield now, *all_of(waiting), block, False
                waiting, size, block = [], 0, 0
            now = int(bucket[s])
            while held and size + e - s > held:
                cut = s + held - size
                waiting.append((ids[s:cut], lanes[s:cut]))
                yield now, *all_of(waiting), block, True
                waiting, size, block, s = [], 0, block + 1, cut
            waiting.append((ids[s:e], lanes[s:e]))
            size += e - s
    if waiting:
        yield now, *all_of(waiting), block, False


def signature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, content (a hash of the text, which tells apart rows that share an id), l0..l3; rows without a word are left out."""

    @F.arrow_udf("struct<l0:bigint,l1:bigint,l2:bigint,l3:bigint,some:boolean>")
    def sign(texts: pa.Array) -> pa.Array:
        lanes, some = signatures(texts)
        lanes = lanes.view(np.int64)
        return pa.StructArray.from_arrays([*[pa.array(lanes[:, k]) for k in range(LANES)], pa.array(some)], [*[f"l{k}" for k in range(LANES)], "some"])

    base = row_ids(docs, id_col, text_col).where("text is not null")
    return base.select("doc_id", F.xxhash64("text").alias("content"), sign(F.lower("text")).alias("s")).where("s.some").select("doc_id", "content", *[f"s.l{k}" for k in range(LANES)])


def candidate_edges(distinct: DataFrame, n: int, most: int = MAX_DISTANCE, tables: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) of signatures (id, l0..l3; all different) at a distance of at most ``most``: of each bucket, as many as connect what its near pairs connect.

    A table's key has as many bits as leave about ``bucket`` * ``WHOLE`` of ``n`` signatures in one, and those are compared
    each with each; what exceeds twice that is split where it is read, in several ways. So no signature is dropped, and how dense they lie doesn't matter.
    Of a bucket with more than ``HELD`` rows, a task only passes blocks on: a second shuffle brings each two of its blocks together in a task.
    """
    bits, held = bits_for(n, bucket), HELD
    tables = tables or tables_for(n, bucket)
    names = [f"l{k}" for k in range(LANES)]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            columns = [batch.column(1 + k) for k in range(LANES)]
            lanes = np.stack([c.to_numpy(zero_copy_only=False) for c in columns], 1).view(np.uint64)
            for t in range(tables):
                key = (bits_at(lanes, sampled(t)[:bits]) << np.uint64(10)) | np.uint64(t)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), ids, *columns], ["bucket", "id", *names])

    def rows(a, b=None, key=None, block=None, blocks=None, lanes=None) -> pa.RecordBatch:
        n = len(a)
        full = lambda v, kind: pa.nulls(n, kind) if v is None else pa.array(np.full(n, v), kind)
        columns = [pa.array(a), pa.nulls(n, pa.int64()) if b is None else pa.array(b), full(key, pa.int64()), full(block, pa.int32()), full(blocks, pa.int32())]
        columns += [pa.nulls(n, pa.int64()) if lanes is None else pa.array(lanes[:, k].view(np.int64)) for k in range(LANES)]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "bucket", "block", "blocks", *names])

    def compare(batches: Iterator[pa.RecordBatch], held: int | None) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        size = 0
        for key, ids, lanes, block, more in _runs(batches, held):
            if block or more:
                yield rows(ids, key=key, block=block, lanes=np.ascontiguousarray(lanes))
                if not more:
                    yield rows(np.zeros(1, np.int64), key=key, blocks=block + 1)
                continue
            for part in meetings(lanes, key, 2 * bucket * WHOLE):
                if len(part) > 1:
                    edges = forest(ids[part], lanes[part], most)
                    waiting.append(edges)
                    size += len(edges)
            if size > 50_000:
                both = np.unique(np.concatenate(waiting), axis=0)
                waiting, size = [], 0
                yield rows(both[:, 0], both[:, 1])
        if waiting:
            both = np.unique(np.concatenate(waiting), axis=0)
            yield rows(both[:, 0], both[:, 1])

    lanes = ", ".join(f"l{k} bigint" for k in range(LANES))
    kind = f"a bigint, b bigint, bucket bigint, block int, blocks int, {lanes}"
    spread = distinct.select("id", *names).mapInArrow(keys, f"bucket bigint, id bigint, {lanes}")
    spark = distinct.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * tables // 500_000)
    sifted = materialize(spread.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: compare(b, held), kind), "sifted")
    edges = sifted.where("b is not null").select("a", "b")
    large = sifted.where("blocks is not null").select(F.col("bucket").alias("large"), F.col("blocks").alias("of"))
    if not large.isEmpty():
        other = F.filter(F.sequence(F.lit(0), F.col("of") - 1), lambda j: j != F.col("block"))
        pairs = sifted.where("block is not null").join(large, F.col("bucket") == F.col("large")).select("bucket", "block", "a", *names, F.explode(other).alias("other"))
        pairs = pairs.select(F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("bucket"), F.col("a").alias("id"), *names)
        edges = edges.unionByName(pairs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: compare(b, None), kind).select("a", "b"))
    return edges.distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that have near-duplicates: doc_id, content, group_id (the least doc_id), group_size, keep.

    Groups are connected by pairs at a distance of at most ``MAX_DISTANCE`` bits; equal signatures are
    at distance 0. keep is true for one row of each group: that of the least (doc_id, content).
    Null, empty and wordless texts are in no group. A null doc_id counts as greater than any other; rows
    repeated with id and text are members each, and if theirs is the row to keep, all have keep (``without_near`` keeps one).
    Other columns are ignored. Empty input: empty result.
    """
    signed = materialize(signature_table(docs, id_col, text_col), "signatures")
    lanes = [f"l{k}" for k in range(LANES)]
    # a number for each signature; once the table is written, it stays the same whatever is computed again
    ids = materialize(signed.groupBy(*lanes).agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()), "distinct")
    n = ids.count()
    edges = materialize(candidate_edges(ids, n), "edges")
    labels = components(edges)
    # signatures that matter: with a neighbour, or shared by several rows
    part = ids.join(labels.withColumnRenamed("node", "id"), "id", "left").where("component is not null or n > 1").select(*lanes, F.coalesce("component", "id").alias("component"))
    part = materialize(part, "members")
    may = bloom(part.select(F.xxhash64(*lanes).alias("k")), "k")
    rows = signed.where(might_contain(may, F.xxhash64(*lanes))).join(part, lanes)
    rows = materialize(rows.select("doc_id", "content", "component"), "rows")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "content")).alias("first"), F.count(F.lit(1)).alias("group_size"))
    out = rows.join(first, "component")
    keep = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("content") == F.col("first.content"))
    return out.select("doc_id", "content", F.col("first.doc_id").alias("group_id"), "group_size", keep.alias("keep"))


def without_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, all columns kept.

    Only rows that a Bloom prefilter can't clear are shuffled; the others pass as they are read.
    """
    groups = materialize(near_groups(docs, id_col, text_col), "groups")
    whole = docs.select(F.struct("*").alias("row"))  # as one column, so that no name of the caller's can clash
    id_, text = F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`")
    # what goes, and what occurs in several equal rows of which one stays
    marks = groups.groupBy("doc_id", "content").agg(F.first("keep").alias("keep"), F.count(F.lit(1)).alias("n")).where("not keep or n > 1")
    marks = materialize(marks.select(F.xxhash64("doc_id", "content").alias("k"), "doc_id", "content", "keep"), "marks")
    may = bloom(marks, "k")
    suspect = F.coalesce(might_contain(may, F.xxhash64(id_, F.xxhash64(text))), F.lit(False)) & text.isNotNull()
    clear = whole.where(~suspect)
    keyed = whole.where(suspect).withColumn("own", F.xxhash64(text))
    met = keyed.join(marks, id_.eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("content")), "left")
    free = met.where("content is null").select("row")
    one = met.where("keep").groupBy("doc_id", "content").agg(F.any_value("row").alias("row")).select("row")
    return clear.unionByName(free).unionByName(one).select("row.*")
