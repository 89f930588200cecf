"""Has this key been seen before? Partitioned cuckoo tables of short fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logfold.functions.text import message_id

SLOTS = 4
FULL = 0.9
KICKS = 200
FIRST_BUCKETS = 1 << 10
#: Keys that one task's tables may get at most; at 2.2 to 4.5 bytes a key they take up to 90 MB.
KEYS_PER_TASK = 20_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit number of each fingerprint, for the way to the other bucket."""
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class CuckooTable:
    """Sixteen-bit fingerprints in buckets of four, two candidate buckets for each key."""

    def __init__(self, buckets: int):
        self.mask = np.uint64(buckets - 1)
        self.slots = np.zeros((buckets, SLOTS), np.uint16)
        self.used = 0
        self.rng = np.random.default_rng(buckets)

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and the two buckets of 64-bit hashes."""
        fp = (h >> np.uint64(48)).astype(np.uint16)
        fp[fp == 0] = 1
        one = h & self.mask
        return fp, one.astype(np.int64), (one ^ (_mix(fp) & self.mask)).astype(np.int64)

    def contains(self, h: np.ndarray) -> np.ndarray:
        fp, one, two = self._places(h)
        return ((self.slots[one] == fp[:, None]) | (self.slots[two] == fp[:, None])).any(axis=1)

    @property
    def full(self) -> bool:
        return self.used >= int(FULL * self.slots.size)

    def insert(self, h: np.ndarray) -> np.ndarray:
        """Inserts what has room; the result tells which did not. Keys that meet in a bucket take turns."""
        fp, one, two = self._places(h)
        left = np.arange(len(h))
        for bucket in (one, two):
            while len(left):
                free = self.slots[bucket[left]] == 0
                can = np.flatnonzero(free.any(axis=1))
                _, turn = np.unique(bucket[left[can]], return_index=True)
                turn = can[turn]
                if not len(turn):
                    break
                self.slots[bucket[left[turn]], free[turn].argmax(axis=1)] = fp[left[turn]]
                self.used += len(turn)
                left = np.delete(left, turn)
        failed = [i for i in left.tolist() if not self._kick(int(fp[i]), int(two[i]))]
        out = np.zeros(len(h), bool)
        out[failed] = True
        return out

    def _kick(self, fp: int, bucket: int) -> bool:
        """Moves fingerprints to their other bucket until one finds room; on failure all moves are undone."""
        moved = []
        for _ in range(KICKS):
            room = np.flatnonzero(self.slots[bucket] == 0)
            if len(room):
                self.slots[bucket, room[0]] = fp
                self.used += 1
                return True
            slot = int(self.rng.integers(SLOTS))
            moved.append((bucket, slot, fp))
            fp, self.slots[bucket, slot] = int(self.slots[bucket, slot]), fp
            bucket ^= int(_mix(np.array([fp], np.uint16))[0] & self.mask)
        for bucket, slot, mine in reversed(moved):
            fp, self.slots[bucket, slot] = int(self.slots[bucket, slot]), fp
            assert fp == mine
        return False

    def delete(self, h: np.ndarray) -> np.ndarray:
        """Takes out one fingerprint for each key; tells which were there. Keys that meet in a bucket take turns."""
        fp, one, two = self._places(h)
        left = np.arange(len(h))
        for bucket in (one, two):
            while len(left):
                there = self.slots[bucket[left]] == fp[left, None]
                can = np.flatnonzero(there.any(axis=1))
                _, turn = np.unique(bucket[left[can]], return_index=True)
                turn = can[turn]
                if not len(turn):
                    break
                self.slots[bucket[left[turn]], there[turn].argmax(axis=1)] = 0
                self.used -= len(turn)
                left = np.delete(left, turn)
        done = np.ones(len(h), bool)
        done[left] = False
        return done


class CuckooFilter:
    """Cuckoo tables, each twice the one before; a new one opens when the last is saturated.

    Answers to ``contains`` are never wrongly no. They are wrongly yes at a rate of at most ``bound()``. ``delete`` takes keys out that
    were inserted; a key must be deleted as often as it was inserted.
    """

    def __init__(self, buckets: int = FIRST_BUCKETS):
        self.tables = [CuckooTable(buckets)]

    def contains(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        for t in self.tables:
            out |= t.contains(h)
        return out

    def insert(self, h: np.ndarray) -> None:
        while len(h):
            t = self.tables[-1]
            room = int(FULL * t.slots.size) - t.used
            head, h = h[: max(room, 0)], h[max(room, 0) :]
            failed = head[t.insert(head)] if len(head) else head
            h = np.concatenate((failed, h))
            if t.full or len(failed):
                self.tables.append(CuckooTable(2 * len(t.slots)))

    def delete(self, h: np.ndarray) -> None:
        for t in reversed(self.tables):
            h = h[~t.delete(h)]

    @property
    def used(self) -> int:
        return sum(t.used for t in self.tables)

    @property
    def bytes(self) -> int:
        return sum(t.slots.nbytes for t in self.tables)

    def bound(self) -> float:
        """Share of keys never met that are answered yes, at most: two buckets of the tables' fill against 16 bits."""
        return sum(2 * SLOTS * t.used / t.slots.size for t in self.tables) / 65535


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(3))


def first_in_batch(h: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether a row is the first of its key in a batch, by the order given."""
    o = np.lexsort((order, h))
    first = np.ones(len(h), bool)
    first[o[1:]] = h[o[1:]] != h[o[:-1]]
    return first


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: a row whose id came earlier in the same batch is decided, exactly, so a hot key leaves a batch once.

    Of a key of the checkpoint the earliest row of a batch is kept. repeated: the kept row of a key that a batch has several times.
    """
    for b in batches:
        _, src, no = _columns(b)
        at = b.column(4).to_numpy(zero_copy_only=False)
        code = b.column(3).dictionary_encode().indices.to_numpy()
        first, repeated = np.ones(len(src), bool), np.zeros(len(src), bool)
        for side, order in ((0, at), (1, no)):
            rows = np.flatnonzero(src == side)
            f = first_in_batch(code[rows], order[rows])
            first[rows], repeated[rows] = f, f & (np.bincount(code[rows], minlength=1)[code[rows]] > 1)
        decided = ~first & (src == 1)
        out = pa.RecordBatch.from_arrays([*b.columns, pa.array(decided), pa.array(repeated)], [*b.schema.names, "decided", "repeated"])
        yield out.filter(pa.array(first | decided))


def _flag(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams a partition backwards, the checkpoint last: the rows whose key the filter has met at a later row, or a batch had several times.

    The first occurrence of every key that occurs again is among them, and every row of the checkpoint whose key occurs in the store.
    """
    later = CuckooFilter()
    for b in batches:
        b = b.filter(pa.array(~_flag(b, "decided")))
        h, src, _ = _columns(b)
        h = h.view(np.uint64)
        first = first_in_batch(h, np.arange(len(h)))
        met = later.contains(h)
        later.insert(h[first & ~met & (src == 1)])
        hit = met | ~first | _flag(b, "repeated")
        if hit.any():
            yield b.select(["id", "src", "no", "at"]).filter(pa.array(hit))


def _answer(audit: bool):
    """Streams a partition, the checkpoint's keys first, then the rows by arrival, through one filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = CuckooFilter()
        asked = yes = 0
        for b in batches:
            h, src, no = _columns(b)
            h = h.view(np.uint64)
            decided = _flag(b, "decided")
            first = first_in_batch(h, np.arange(len(h))) & ~decided
            hit = decided | ~first
            ask = np.flatnonzero(first)
            met = seen.contains(h[ask])
            hit[ask] = met
            seen.insert(h[ask[~met]])
            hit &= src == 1
            asked, yes = asked + int((src == 1).sum()), yes + int(hit.sum())
            if not audit and hit.any():
                yield b.select(["no", "id", "at", "decided"]).filter(pa.array(hit))
        if audit:
            yield pa.RecordBatch.from_pydict({"fingerprints": [seen.used], "tables": [len(seen.tables)], "bytes": [seen.bytes], "asked": [asked], "answered_yes": [yes], "bound": [seen.bound()]})

    return run


def _keys(store: DataFrame, checkpoint: DataFrame) -> DataFrame:
    one = store.select(F.lit(1).alias("src"), F.col("arrival_no").cast("bigint").alias("no"), message_id("request_id").alias("id"), F.col("stored_at").cast("double").alias("at"))
    two = checkpoint.select(F.lit(0).alias("src"), F.lit(None).cast("bigint").alias("no"), message_id("request_id").alias("id"), F.col("applied_at").cast("double").alias("at"))
    return one.unionByName(two).where(F.col("id").isNotNull())


def _tasks(*tables: DataFrame) -> int:
    """Partitions of the key space, so that none has more than ``KEYS_PER_TASK`` keys: by the number of rows, which bounds that of keys."""
    least = int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-sum(t.count() for t in tables) // KEYS_PER_TASK))


def _parted(keys: DataFrame, tasks: int) -> DataFrame:
    """The keys in partitions of the key space; decided rows, which need no filter, are spread."""
    narrow = keys.select(F.xxhash64("id").alias("h"), "src", F.coalesce("no", F.lit(0)).alias("no"), "id", "at")
    combined = narrow.mapInArrow(_combine, "h bigint, src int, no bigint, id string, at double, decided boolean, repeated boolean")
    return combined.repartition(tasks, F.when(F.col("decided"), F.xxhash64("no")).otherwise(F.col("h")))


def _filtered(parted: DataFrame, audit: bool) -> DataFrame:
    return parted.sortWithinPartitions("src", "no").mapInArrow(_answer(audit), "fingerprints bigint, tables bigint, bytes bigint, asked bigint, answered_yes bigint, bound double" if audit else "no bigint, id string, at double, decided boolean")


def candidates(store: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Rows of the store that the filter answers yes for: no, id, at, decided. All rows that were truly met before are among them.

    Ids are hashed in the JVM, repeated keys of a batch are combined, then each partition of the key space streams through a filter of
    about 2.2 bytes a distinct key. Keys themselves are never held.
    """
    return _filtered(_parted(_keys(store, checkpoint), _tasks(store, checkpoint)), audit=False)


def seen_before(store: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """arrival_no of the rows whose id occurs with a smaller arrival_no in the store, or in the checkpoint with applied_at < stored_at.

    A filter gives the candidates. A second one, which streams the same partitions backwards, gives the rows that can be their evidence;
    only these are held against each other exactly. Rows that repeat an id of their own batch are decided before and pass by the join on a
    key of their own, so a hot id meets no task as a whole. Null and blank ids are never seen before, nor do they count; a null stored_at or
    applied_at is in no order. Either table may be empty. Other columns are not read.
    """
    parted = _parted(_keys(store, checkpoint), _tasks(store, checkpoint))
    alone = F.concat(F.lit("\x00"), F.col("no").cast("string"))
    found = _filtered(parted, audit=False).withColumn("key", F.when(F.col("decided"), alone).otherwise(F.col("id")))
    evidence = parted.sortWithinPartitions(F.desc("src"), F.desc("no")).mapInArrow(_evidence, "id string, src int, no bigint, at double")
    first = evidence.groupBy(F.col("id").alias("_id")).agg(F.min(F.when(F.col("src") == 1, F.col("no"))).alias("_no"), F.min(F.when(F.col("src") == 0, F.col("at"))).alias("_at"))
    return found.join(first, F.col("key") == F.col("_id"), "left").where(F.col("decided") | (F.col("_no") < F.col("no")) | (F.col("_at") < F.col("at"))).select(F.col("no").alias("arrival_no"))


def _expire(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams a partition: the stored keys are inserted, those that are out of date deleted, then the rows are asked."""
    seen = CuckooFilter()
    for b in batches:
        h, step, _ = _columns(b)
        h = h.view(np.uint64)
        seen.insert(h[step == 0])
        seen.delete(h[step == 1])
        hit = (step == 2) & seen.contains(h)
        if hit.any():
            yield b.select(["id"]).filter(pa.array(hit))


def live_ids(log: DataFrame, store: DataFrame, ttl: float) -> DataFrame:
    """The ids (column request_id, trimmed, in lower case) of a log that have a result in the store younger than ``ttl`` seconds at the store's latest time.

    Every stored id goes into the filter, and the ids whose latest result is too old are deleted from it; the ids that the filter then
    answers yes for are held against the ids that are left, exactly. Both sides are made distinct before their shuffle, so a hot id is one
    row of each task. Null and blank ids are never live, nor is a null stored_at. Either table may be empty.
    """
    now = store.agg(F.max(F.col("stored_at").cast("double"))).scalar()
    stored = store.select(message_id("request_id").alias("id"), F.col("stored_at").cast("double").alias("at")).where(F.col("id").isNotNull()).groupBy("id").agg(F.max("at").alias("at"))
    stored = stored.select("id", F.coalesce(F.col("at") > now - F.lit(float(ttl)), F.lit(False)).alias("live"))
    steps = stored.select("id", F.explode(F.when(F.col("live"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("src"))
    asked = log.select(message_id("request_id").alias("id")).where(F.col("id").isNotNull()).distinct().withColumn("src", F.lit(2))
    keys = steps.unionByName(asked).select(F.xxhash64("id").alias("h"), "src", F.lit(0).cast("bigint").alias("no"), "id")
    found = keys.repartition(_tasks(store), "h").sortWithinPartitions("src").mapInArrow(_expire, "id string")
    return found.join(stored.where("live").select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_semi").select(F.col("id").alias("request_id"))


def audit(store: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """One row: fingerprints, tables, bytes, rows asked, yes answers, wrong yes answers, wrong_rate among the rows not met before, and its bound.

    Here a row counts as met before if its id occurs earlier in the store or anywhere in the checkpoint: the question the filter answers.
    """
    keys = _keys(store, checkpoint)
    sizes = _filtered(_parted(keys, _tasks(store, checkpoint)), audit=True).agg(F.sum("fingerprints").alias("fingerprints"), F.max("tables").alias("tables"), F.sum("bytes").alias("bytes"), F.sum("asked").alias("asked"), F.sum("answered_yes").alias("answered_yes"), F.max("bound").alias("bound"))
    rows = keys.groupBy("id").agg(F.count_if(F.col("src") == 1).alias("n"), F.max((F.col("src") == 0).cast("int")).alias("known"))
    truth = rows.agg(F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(F.col("n") - 1)).alias("met_before"))
    both = sizes.unionByName(truth, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in (*sizes.columns, "met_before")])  # one row each
    wrong = F.col("answered_yes") - F.col("met_before")
    return both.select("fingerprints", "tables", "bytes", "asked", "answered_yes", "met_before", wrong.alias("wrong_yes"), F.try_divide(wrong, F.col("asked") - F.col("met_before")).alias("wrong_rate"), "bound")
