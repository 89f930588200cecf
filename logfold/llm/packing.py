"""Texts in containers of fixed capacity, at target proportions of their sources.

Mixture-controlled packing: a deficit round-robin over queues by source fills window after window to the target proportions. What a source got too
much or too little of is its deficit, which is carried into the next window and, as a prefix sum over the supply, into the next partition.
The items of a window go best-fit, largest first, into the open containers.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from logfold.llm.bpe import TOKENIZER, token_counts
from logfold.session import written

#: Tokens to a partition, and containers to a window.
PARTITION_TOKENS = 8_000_000
WINDOW = 64
#: Windows within which a carried deficit is made good.
CARRY_WINDOWS = 1.0
#: Hash buckets to a partition, for positions in the tokens of a source.
BUCKETS = 8
#: Rows that token_budgets may have.
BUDGET_ROWS = 1_000
#: Positions to a block of prefix sums.
BLOCK = 4_096

PLACED = "budget_id int, container_id bigint, slot int, window_no int, doc_id bigint, source string, token_start bigint, token_end bigint"


def budget_faults(token_budgets: DataFrame) -> DataFrame:
    """Every budget with what is wrong with it, or ``ok``: a capacity that isn't positive, or of a piece an overlap that is negative or not below the capacity."""
    overlap = F.coalesce("overlap_tokens", F.lit(0))
    status = F.when(F.coalesce(F.col("capacity_tokens") <= 0, F.lit(True)), "capacity").when((F.col("purpose") == "piece") & ((overlap < 0) | (overlap >= F.col("capacity_tokens"))), "overlap").otherwise("ok")
    return token_budgets.select("budget_id", "purpose", "capacity_tokens", "overlap_tokens", status.alias("status"))


def budgets(token_budgets: DataFrame, purpose: str) -> list[tuple[int, int, int]]:
    """budget_id, capacity, overlap of a purpose; faulty rows don't count (``budget_faults`` tells them). A table of parameters: more than ``BUDGET_ROWS`` rows raise."""
    rows = budget_faults(token_budgets).where((F.col("purpose") == purpose) & (F.col("status") == "ok")).select("budget_id", "capacity_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("o")).limit(BUDGET_ROWS + 1).collect()
    if len(rows) > BUDGET_ROWS:
        raise ValueError(f"more than {BUDGET_ROWS} budgets")
    return sorted(tuple(r) for r in rows)


def sum_before(df: DataFrame, keys: list[str], position: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all smaller positions of the same keys; positions are unique and from 0 on.

    In two levels: sums of ``BLOCK`` positions each, then within a block. So no task orders more than a block, or the sums of all blocks.
    """
    earlier = lambda *by: W.partitionBy(*by).rowsBetween(W.unboundedPreceding, -1)
    running = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    d = df.withColumn("_block", F.floor(F.col(position) / BLOCK)).withColumn("_in", running(value, earlier(*keys, "_block").orderBy(position)))
    by_block = d.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    base = by_block.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_bl"), running("_sum", earlier(*keys).orderBy("_block")).alias("_base"))
    same = F.col("_block") == F.col("_bl")
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"_k{i}"))
    return d.join(base, same).select(*df.columns, (F.col("_base") + F.col("_in")).alias(name))


class Containers:
    """Open containers by the room they have left; the lowest set bit at or above a size is the best fit."""

    def __init__(self, capacity: int):
        self.capacity, self.mask, self.by_room, self.slots = capacity, 0, {}, []

    def place(self, size: int) -> tuple[int, int]:
        """Container and slot of an item."""
        above = self.mask >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            at = self.by_room[room].pop()
            if not self.by_room[room]:
                self.mask &= ~(1 << room)
        else:
            room, at = self.capacity, len(self.slots)
            self.slots.append(0)
        if left := room - size:
            self.by_room.setdefault(left, []).append(at)
            self.mask |= 1 << left
        self.slots[at] += 1
        return at, self.slots[at] - 1


def pack(items: list[tuple[int, str, int]], capacity: int, share: dict[str, float], carried: dict[str, float], window: int = WINDOW, carry_windows: float = CARRY_WINDOWS) -> list[tuple]:
    """Placed pieces (container, slot, window, doc_id, source, token_start, token_end) of the items (doc_id, source, tokens) of a partition.

    Only an item above the capacity is cut, into full containers and a rest, each of which queues on its own. Each window adds its share to a
    source's deficit; a source sends as long as the deficit covers the next piece. All items are placed. A carried deficit counts up to
    ``carry_windows`` windows: where the supply can't meet the target it grows without end, and would keep whole sources out of a partition.
    """
    queues: dict[str, deque] = {}
    for doc, source, tokens in items:
        for a in range(0, tokens, capacity):
            queues.setdefault(source, deque()).append((doc, a, min(capacity, tokens - a)))
    most = carry_windows * window * capacity
    deficit = {s: max(-most, min(most, carried.get(s, 0.0))) for s in queues}
    open_, out, no = Containers(capacity), [], 0
    while queues:
        weight = {s: share.get(s, 0.0) for s in queues}
        if not any(weight.values()):  # only sources without a share are left
            weight = dict.fromkeys(queues, 1.0)
        whole_weight = sum(weight.values())
        part = {s: w / whole_weight for s, w in weight.items()}
        need = min((queues[s][0][2] - deficit[s]) / part[s] for s in queues if part[s])
        quantum = max(window * capacity, need + 1)  # a window in which nothing could be sent is joined with the next
        batch = []
        for s in sorted(queues):
            q = queues[s]
            deficit[s] += quantum * part[s]
            while q and q[0][2] <= deficit[s]:
                doc, a, size = q.popleft()
                deficit[s] -= size
                batch.append((size, doc, s, a))
            if not q:
                del queues[s]
        batch.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[3]))
        for size, doc, s, a in batch:
            at, slot = open_.place(size)
            out.append((at, slot, no, doc, s, a, a + size))
        no += 1
    return out


def pack_documents(sizes: DataFrame, capacities: list[tuple[int, int, int]], target: dict[str, float] | DataFrame | None = None, partition_tokens: int = PARTITION_TOKENS, window: int = WINDOW, carry_windows: float = CARRY_WINDOWS) -> DataFrame:
    """budget_id, container_id, slot, window_no, doc_id, source, token_start, token_end: every token of every text in one place per budget.

    sizes: doc_id, source, n_tokens. A text up to the capacity is in one place; a larger one fills whole containers and its rest is placed
    like an item. Texts without tokens take no room and have no row. A null source is a source of its own; null doc_ids are placed too.
    ``target`` has the proportions by source, as a mapping or as a table (source, share) (default: those of the whole corpus); sources it leaves out come last.

    Plan: texts are dealt to groups of about ``partition_tokens`` tokens so that every group gets its share of every source: the position of a text in the
    tokens of its source is a prefix sum, taken over hash buckets first and within a bucket then, so that a source with most of the
    rows needs no task of its own. What a group got too much or too little of, less than a text a source, is carried into the next one. Each group
    is packed by one task from rows of a few numbers. The dealt rows are written once, since supply, carry and packing all read them; all else runs
    when the result is asked for.
    """
    spark = sizes.sparkSession
    total = sizes.agg(F.greatest(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.lit(1)).alias("total"))
    parts = total.select(F.ceil(F.col("total") / partition_tokens)).scalar()
    docs = sizes.where(F.col("n_tokens") > 0).select(F.pmod(F.xxhash64("doc_id", "n_tokens"), parts * BUCKETS).alias("bucket"), "doc_id", F.coalesce("source", F.lit("")).alias("source"), "n_tokens")

    by_bucket = docs.groupBy("bucket", "source").agg(F.sum("n_tokens").alias("t"))
    base = sum_before(by_bucket, ["source"], "bucket", "t", "base").select(F.col("bucket").alias("_b"), F.col("source").alias("_s"), "base")
    totals = by_bucket.groupBy(F.col("source").alias("_t")).agg(F.sum("t").alias("of_source"))
    within = F.coalesce(F.sum("n_tokens").over(W.partitionBy("bucket", "source").orderBy("doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = docs.withColumn("within", within).join(base, (F.col("bucket") == F.col("_b")) & (F.col("source") == F.col("_s"))).join(totals, F.col("source") == F.col("_t"))
    part = F.floor((F.col("base") + F.col("within")) / F.col("of_source") * parts)
    rows = written(placed.select(F.least(part, parts - 1).cast("int").alias("part"), "doc_id", "source", "n_tokens"))

    supply = rows.groupBy("part", "source").agg(F.sum("n_tokens").cast("double").alias("tokens"))
    if target is None:
        share = totals.select(F.col("_t").alias("_s"), (F.col("of_source") / total.scalar()).alias("share"))
    elif isinstance(target, DataFrame):
        share = target.select(F.coalesce("source", F.lit("")).alias("_s"), F.col("share").cast("double").alias("share"))
    else:
        share = spark.createDataFrame([(s or "", float(x)) for s, x in target.items()], "_s string, share double")
    before = sum_before(supply.groupBy("part").agg(F.sum("tokens").alias("all")), [], "part", "all", "all_before").select(F.col("part").alias("_q"), "all_before")
    carry = sum_before(supply, ["source"], "part", "tokens", "given").join(before, F.col("part") == F.col("_q")).join(share, F.col("source") == F.col("_s"), "left")
    carry = carry.select(F.col("part").alias("_p"), F.col("source").alias("_src"), F.coalesce("share", F.lit(0.0)).alias("share"), (F.coalesce("share", F.lit(0.0)) * F.col("all_before") - F.col("given")).alias("carried"))
    rows = rows.join(carry, (F.col("part") == F.col("_p")) & (F.col("source") == F.col("_src"))).select("part", "doc_id", "source", "n_tokens", "share", "carried")

    def run(key: tuple, pdfs: pd.DataFrame) -> pd.DataFrame:
        pdf = pdfs.sort_values(["doc_id", "n_tokens"], kind="stable")
        ids = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]]
        items = list(zip(ids, pdf["source"], (int(x) for x in pdf["n_tokens"])))
        one = pdf.drop_duplicates("source")
        share_of, carried = dict(zip(one["source"], one["share"])), dict(zip(one["source"], one["carried"]))
        frames = []
        for budget, capacity, _ in capacities:
            got = pack(items, capacity, share_of, carried, window, carry_windows)
            f = pd.DataFrame(got, columns=["container_id", "slot", "window_no", "doc_id", "source", "token_start", "token_end"])
            f["container_id"] += int(key[0]) << 32
            f["doc_id"] = f["doc_id"].astype("Int64")
            f["source"] = f["source"].where(f["source"] != "", None)
            f.insert(0, "budget_id", budget)
            frames.append(f)
        return pd.concat(frames) if frames else pd.DataFrame(columns=[c.split()[0] for c in PLACED.split(", ")])

    # Rows are few bytes but much work: the number of tasks is given, not left to go by bytes.
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").groupBy("part").applyInPandas(run, PLACED)


def document_sizes(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, source of all documents, computed once into the shared checkpoint folder: the texts are encoded once, the numbers read often."""
    return written(token_counts(documents, keep=("source",), path=path))


def packed(documents: DataFrame, token_budgets: DataFrame, path: str = TOKENIZER, target: dict[str, float] | DataFrame | None = None) -> DataFrame:
    return pack_documents(document_sizes(documents, path), budgets(token_budgets, "container"), target)


def utilisation(placed: DataFrame, token_budgets: DataFrame) -> DataFrame:
    """budget_id, capacity_tokens, containers, tokens, and the share of room that is used."""
    by = placed.groupBy("budget_id", "container_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("t")).groupBy("budget_id").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    return by.join(token_budgets.select("budget_id", "capacity_tokens"), "budget_id").select("budget_id", "capacity_tokens", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("used_share"))


def even(sizes: DataFrame) -> DataFrame:
    """The target with equal shares of all sources that have tokens."""
    of = sizes.where("n_tokens > 0").select(F.coalesce("source", F.lit("")).alias("source")).distinct()
    return of.select("source", (F.lit(1.0) / of.agg(F.count("*")).scalar()).alias("share"))


def own(sizes: DataFrame) -> DataFrame:
    """The target with the shares that the sources have in the corpus."""
    of = sizes.where("n_tokens > 0").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum("n_tokens").alias("t"))
    return of.select("source", (F.col("t") / of.agg(F.sum("t")).scalar()).alias("share"))


def mixture(placed: DataFrame, target: DataFrame) -> DataFrame:
    """budget_id, windows, full_windows, mean_deviation, most_deviation: how far the windows are from the target shares (source, share).

    The deviation of a window is half the sum of the differences of its shares from the target, over all sources. A window is full as long as
    no source of its group has run out before it; the means are those of the full windows, since later ones can't keep to the target.
    """
    of = placed.groupBy("budget_id", F.shiftright("container_id", 32).alias("part"), "window_no", F.coalesce("source", F.lit("")).alias("source")).agg(F.sum(F.col("token_end") - F.col("token_start")).alias("t"))
    group = ["budget_id", "part"]
    last = of.groupBy(*group, "source").agg(F.max("window_no").alias("last")).groupBy(*group).agg(F.min("last").alias("out_at"), F.count("*").alias("n_sources"))
    shares = of.withColumn("of_window", F.sum("t").over(W.partitionBy(*group, "window_no"))).join(target.select(F.col("source").alias("_s"), "share"), F.col("source") == F.col("_s"), "left")
    here = F.coalesce("share", F.lit(0.0))
    each = shares.groupBy(*group, "window_no").agg(F.sum(F.abs(F.col("t") / F.col("of_window") - here)).alias("off"), F.sum(here).alias("met"))
    each = each.join(last.withColumnsRenamed({c: f"_{c}" for c in group}), (F.col("budget_id") == F.col("_budget_id")) & (F.col("part") == F.col("_part")))
    deviation = F.when(F.col("window_no") < F.col("out_at"), (F.col("off") + 1 - F.col("met")) / 2)  # sources that are absent from a window differ by their whole share
    return each.groupBy("budget_id").agg(F.count("*").alias("windows"), F.count(deviation).alias("full_windows"), F.round(F.avg(deviation), 6).alias("mean_deviation"), F.round(F.max(deviation), 6).alias("most_deviation"))


def checks(placed: DataFrame, sizes: DataFrame, token_budgets: DataFrame) -> DataFrame:
    """Of each budget: containers above its capacity, texts up to the capacity that are split, and texts whose tokens aren't placed once each. Texts are told apart by doc_id."""
    caps = token_budgets.select(F.col("budget_id").alias("_b"), "capacity_tokens")
    n = F.col("token_end") - F.col("token_start")
    full = placed.groupBy("budget_id", "container_id").agg(F.sum(n).alias("t")).join(caps, F.col("budget_id") == F.col("_b")).groupBy("budget_id").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("overfull"))
    texts = placed.groupBy("budget_id", "doc_id").agg(F.sum(n).alias("t"), F.count("*").alias("places"), F.max("token_end").alias("end")).join(caps, F.col("budget_id") == F.col("_b"))
    true = sizes.where("n_tokens > 0").groupBy(F.col("doc_id").alias("_d")).agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("longest"))
    texts = texts.join(true, F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    split = texts.groupBy("budget_id").agg(F.count_if((F.col("longest") <= F.col("capacity_tokens")) & (F.col("places") > 1) & (F.col("longest") == F.col("n"))).alias("split"), F.count_if(~F.col("t").eqNullSafe(F.col("n"))).alias("wrong"), F.count("*").alias("texts"))
    missing = split.join(full.withColumnRenamed("budget_id", "_f"), F.col("budget_id") == F.col("_f"))
    return missing.select("budget_id", "overfull", "split", (F.col("wrong") + true.agg(F.count("*")).scalar() - F.col("texts")).alias("wrong"))
