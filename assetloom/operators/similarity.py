"""Sessions, fingerprints, near-duplicate join and groups."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from assetloom.functions.exprs import hamming
from assetloom.operators.components import connected_components, roots, union_edges
from assetloom.operators.places import carry, ranged
from assetloom.session import cut, ready


def sessions(df: DataFrame, at: Column, gap: float, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Add `session`: numbers from 0 of runs whose neighbours are less than `gap` apart, within each `by` (all rows without one).

    Rows are dealt by ranges of key and time, so a key with most of all rows is many tasks; a run that goes on from the
    part before is stitched to it. A null time gets a null session.
    """
    by, new = by or [], F.col("new__")
    rows = ranged(df.withColumn("at__", at).where("at__ is not null"), by, [F.col("at__"), *map(F.col, order)])
    w = W.Window.partitionBy("part__", *by).orderBy("at__", *order)
    t = rows.withColumn("new__", F.coalesce(F.col("at__") - F.lag("at__").over(w) >= gap, F.lit(False)).cast("long")).withColumn("local__", F.sum(new).over(w.rowsBetween(W.Window.unboundedPreceding, 0)))
    p = W.Window.partitionBy(*by).orderBy("part__")  # a row for each key and part
    s = t.groupBy("part__", *by).agg(F.min("at__").alias("lo"), F.max("at__").alias("hi"), F.max("local__").alias("n"))
    s = s.withColumns({"starts": F.coalesce(F.col("lo") - F.lag("hi").over(p) >= gap, F.lit(False)).cast("long"), "goes_on": F.lag("hi").over(p).isNotNull(), "before": F.coalesce(F.sum("n").over(p.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))})
    offsets = s.select("part__", *by, "goes_on", (F.sum("starts").over(p.rowsBetween(W.Window.unboundedPreceding, 0)) + F.col("before")).alias("offset__")).where("goes_on").drop("goes_on")
    out = carry(t, by, offsets).withColumn("session", F.col("local__") + F.coalesce("offset__", F.lit(0))).select(*df.columns, "session")
    return out.unionByName(df.withColumn("at__", at).where("at__ is null").drop("at__").withColumn("session", F.lit(None).cast("long")))


def stitched_sessions(df: DataFrame, at: Column, gap: float, order: list[str], width: float) -> DataFrame:
    """The same as `sessions` in one global order, by fixed time buckets of `width`: sessions are numbered within each bucket,
    and one row for each bucket that is not empty decides whether its first session goes on from the bucket before."""
    t = cut(df.withColumn("at__", at).where("at__ is not null").withColumn("bucket__", F.floor(F.col("at__") / width)))
    w = W.Window.partitionBy("bucket__").orderBy("at__", *order)
    t = t.withColumn("new__", F.coalesce(F.col("at__") - F.lag("at__").over(w) >= gap, F.lit(False)).cast("long")).withColumn("local__", F.sum("new__").over(w.rowsBetween(W.Window.unboundedPreceding, 0)))
    b = W.Window.orderBy("bucket__")
    s = t.groupBy("bucket__").agg(F.min("at__").alias("lo"), F.max("at__").alias("hi"), F.max("local__").alias("n"))
    s = s.withColumn("starts", F.coalesce(F.col("lo") - F.lag("hi").over(b) >= gap, F.lit(False)).cast("long"))
    s = s.withColumn("offset__", F.sum("starts").over(b.rowsBetween(W.Window.unboundedPreceding, 0)) + F.coalesce(F.sum("n").over(b.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)))
    out = t.join(s.select("bucket__", "offset__"), "bucket__").withColumn("session", F.col("offset__") + F.col("local__")).select(*df.columns, "session")
    return out.unionByName(df.withColumn("at__", at).where("at__ is null").drop("at__").withColumn("session", F.lit(None).cast("long")))


def _hashed(distinct: pa.Array) -> np.ndarray:
    """The first 64 bits of each word's md5."""
    words = distinct.cast("large_binary").to_numpy(zero_copy_only=False).tolist()
    return np.frombuffer(b"".join([hashlib.md5(w, usedforsecurity=False).digest() for w in words]), ">u8")[::2].astype("<u8")


#: For each byte, its eight bits as the eight bytes of one number, so that up to 255 words are counted by sums of such numbers.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _majority(hashes: np.ndarray, code: np.ndarray, edges: np.ndarray, at_once: int) -> np.ndarray:
    """For each list of words, code[edges[i]] to code[edges[i+1]], the 64 bits that more than half of their hashes have, as a signed number."""
    n = np.diff(edges)
    ones = np.zeros((len(n), 64), np.int64)
    own = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(code)) - np.repeat(edges[:-1] - edges[0], n)
    lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8).T]  # a row for each byte of the hash
    for k in range(0, len(code), at_once):  # some words at a time
        some, of = code[k : k + at_once], own[k : k + at_once]
        new = np.concatenate([[True], of[1:] != of[:-1]])
        first = np.flatnonzero(new | (place[k : k + at_once] % 255 == 0))  # at most 255 words to a sum
        sums = np.stack([np.add.reduceat(lane[some], first) for lane in lanes], axis=1).view(np.uint8).reshape(-1, 64)
        starts = np.flatnonzero(new[first])
        ones[of[first[starts]]] += np.add.reduceat(sums, starts, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<i8").ravel()


def word_bits(words: pa.Array, edges: np.ndarray, at_once: int = 1 << 17) -> np.ndarray:
    """For each list of distinct words, edges[i] to edges[i+1], the 64 bits that more than half of the words' md5 have, as a signed number."""
    coded = words.dictionary_encode()  # each distinct word of the batch is hashed once
    return _majority(_hashed(coded.dictionary), coded.indices.to_numpy(), edges, at_once)


def _slices(sizes: np.ndarray, at_once: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `at_once` in all."""
    part = (np.cumsum(sizes) - sizes) // at_once
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(sizes) else np.zeros(0, np.int64)
    yield from zip(starts.tolist(), [*starts[1:].tolist(), len(sizes)], strict=True)


def simhash(df: DataFrame, key: str, words: Column, also: tuple[str, ...] = (), at_once: int = 1 << 18) -> DataFrame:
    """`(key, *also, fp)`: bit i is set where more than half of the distinct words' md5 have it (Charikar, 2002); null without words.

    A row's words never leave its task: no exchange. Other columns that are wanted with the fingerprint may come along. A
    batch is worked through by slices of about `at_once` words, so memory does not grow with what Spark puts into one.
    """
    ready(df.sparkSession)
    kept = [key, *also]
    each = df.select(*kept, F.coalesce(F.array_distinct(words), F.array().cast("array<string>")).alias("words__"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("words__").value_lengths().to_numpy()
            for a, b in _slices(n, at_once):
                some = batch.slice(a, b - a)
                fp = word_bits(some.column("words__").flatten(), np.concatenate([[0], np.cumsum(n[a:b])]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), pa.array(fp, mask=n[a:b] == 0)], [*kept, "fp"])

    return each.mapInArrow(run, f"{_kinds(each, kept)}, fp bigint")


def _kinds(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def text_simhash(df: DataFrame, key: str, text: Column, also: tuple[str, ...] = (), at_once: int = 1 << 22) -> DataFrame:
    """`(key, *also, n_words, n_distinct, n_blank, fp)` of a text: its words between ASCII white space, the distinct ones, its
    white space, and what `simhash` gives of these words. A null text is empty.

    The text travels to the task's Python as it is, and is split there by Arrow, about `at_once` bytes at a time.
    """
    ready(df.sparkSession)
    kept = [key, *also]
    each = df.select(*kept, F.coalesce(text, F.lit("")).alias("text__"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(pc.binary_length(batch.column("text__")).to_numpy(), at_once):
                some = batch.slice(a, b - a)
                made = _words_of(some.column("text__"))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), *made], [*kept, "n_words", "n_distinct", "n_blank", "fp"])

    return each.mapInArrow(run, f"{_kinds(each, kept)}, n_words int, n_distinct int, n_blank int, fp bigint")


_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _words_of(texts: pa.Array, at_once: int = 1 << 17) -> list[pa.Array]:
    """Words, distinct words, white space and fingerprint of each text."""
    rows = len(texts)
    texts = pa.concat_arrays([texts.cast("large_binary")])  # from its first byte on
    ends = np.frombuffer(texts.buffers()[1], np.int64, rows + 1)
    data = texts.buffers()[2]
    blank = np.flatnonzero(_BLANK[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]]) + ends[0] if data else np.zeros(0, np.int64)
    n_blank = np.diff(np.searchsorted(blank, ends))
    split = pc.ascii_split_whitespace(texts.cast("large_string"))
    each, own = split.flatten(), np.repeat(np.arange(rows), split.value_lengths().to_numpy())
    full = pc.greater(pc.binary_length(each), 0).to_numpy(zero_copy_only=False)  # a text that begins or ends with white space has empty ones
    if not full.all():
        each, own = each.filter(pa.array(full)), own[full]
    coded = each.dictionary_encode()  # each distinct word is hashed once
    size = max(1, len(coded.dictionary))
    distinct = pd.unique(own * size + coded.indices.to_numpy())  # in the order of rows
    of, code = np.divmod(distinct, size)
    n = np.bincount(of, minlength=rows)
    fp = _majority(_hashed(coded.dictionary), code, np.concatenate([[0], np.cumsum(n)]), at_once)
    return [pa.array(np.bincount(own, minlength=rows).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(n_blank.astype(np.int32)), pa.array(fp, mask=n == 0)]


#: Index rows, of 12 bytes each, that may be sent to all tasks.
BROADCAST_ROWS = 1_000_000


def exact_duplicates(df: DataFrame, key: str, fp: str = "fp") -> DataFrame:
    """`(fp, rep, size)`: the least key of each fingerprint."""
    return df.where(F.col(fp).isNotNull()).groupBy(F.col(fp).alias("fp")).agg(F.min(key).alias("rep"), F.count("*").alias("size"))


def bands(fps: DataFrame, radius: int, cols: list[str]) -> DataFrame:
    """Index rows (cols, at): each 16-bit band's number and value as one number, with all values of up to `radius` bits away."""
    flips = [0]
    for n in range(1, radius + 1):
        flips += [sum(1 << i for i in bits) for bits in combinations(range(16), n)]
    one = lambda i: F.call_function("shiftrightunsigned", F.col("fp"), F.lit(16 * i)).bitwiseAND(F.lit(0xFFFF)).cast("int")
    at = F.array(*(F.lit(i << 16).bitwiseOR(one(i)) for i in range(4)))
    out = fps.select(*cols, F.explode(at).alias("at"))
    return out.select(*cols, F.explode(F.array(*(F.col("at").bitwiseXOR(F.lit(m)) for m in flips))).alias("at")) if radius else out


def band_radius(threshold: int) -> int:
    """In how many bits one of four bands may differ at most in a pair closer than `threshold`."""
    if threshold > 12:
        raise ValueError("thresholds over 12 are not supported by four bands")
    return (threshold - 1) // 4


def hamming_pairs(df: DataFrame, key: str, threshold: int = 12, fp: str = "fp") -> DataFrame:
    """`(src, dst, dist)`: all pairs of distinct fingerprints closer than `threshold`, named by their least keys, and a pair
    at distance 0 from that key to each other key of the same fingerprint.

    Exact: of four 16-bit bands one differs in at most (threshold - 1) // 4 bits (multi-index hashing, Norouzi et al.,
    2012), so fingerprints are dealt by bands, and those of one deal compared by arrays in its task (`_compared`). Only
    fingerprints travel; keys are joined to the pairs found. What is compared grows with the square of the fingerprints,
    by about 0.8 % of it where bits are random, but no row is made of a pair that is not close. Thresholds over 12 would
    need a wider search and are refused. Missing fingerprints join nothing.
    """
    df = cut(df.select(key, fp).where(F.col(fp).isNotNull()))  # read twice: fingerprints of a text are made once
    reps = cut(exact_duplicates(df, key, fp))
    plain = bands(reps.select("fp"), 0, ["fp"]).select("at", F.col("fp").alias("lead"), F.col("fp").alias("other"), F.lit(0).alias("spread"), F.lit(None).cast("long").alias("main"))
    near = _compared(reps.select("fp", F.col("fp").alias("part")), plain, threshold, once=True).select(F.col("lead").alias("x"), F.col("fp").alias("y"), "dist")
    return _by_keys(near, reps, "dist").unionByName(_same(df, reps, key, fp).withColumn("dist", F.lit(0)))


#: Leads and queries that one task compares at once.
LEADS, QUERIES = 1 << 17, 1 << 20
#: Tasks of one comparison at most; beyond, a task has several blocks, one after the other.
TASKS = 4096


def _flips(bits: int, radius: int) -> list[int]:
    """All numbers of so many bits of which at most `radius` are set."""
    return [sum(1 << i for i in some) for n in range(radius + 1) for some in combinations(range(bits), n)]


def _compared(queries: DataFrame, leads: DataFrame, threshold: int, once: bool = False) -> DataFrame:
    """`(fp, part, at, lead, other, spread, dist)` of fingerprints `(fp, part)` and leads `(at, lead, other, spread, main)` of
    another part that have a band close, at a distance under threshold and spread; at values with a `main`, fingerprints of
    that part do not meet its leads. With `once` both are the same fingerprints, each its own part, and a pair comes once,
    from its first close band and with the one as lead whose band is less.

    Both sides are dealt by a band's number and first bits, fingerprints to all such deals within the radius; the bits left
    are looked up in the task. A deal has as many first bits as the counted leads ask for, and one that still is too large
    goes to a grid of tasks. What a task sends to a deal travels as one row of arrays (`_dealt`).
    """
    ready(queries.sparkSession)
    radius = band_radius(threshold)
    most = max([1, *(r["count"] for r in leads.groupBy(F.shiftright("at", 16).alias("b")).count().collect())])  # four rows
    high = min(16, max(3, (-(-most // LEADS) - 1).bit_length()))
    low = 16 - high
    n_leads, n_queries = np.zeros(4 << high, np.int64), np.zeros(4 << high, np.int64)  # of each deal
    for counts, at in ((n_leads, leads.select("at")), (n_queries, bands(queries, 0, ["fp"]).select("at"))):
        for deal, n in at.groupBy(F.shiftright("at", low).alias("deal")).count().collect():
            counts[deal] = n
    deals = np.arange(4 << high)
    n_queries = sum(np.where((deals ^ m >= deals) | (not once), n_queries[deals ^ m], 0) for m in _flips(high, radius))
    l_n, q_n = -(-n_leads // LEADS), np.maximum(1, -(-n_queries // QUERIES))

    def queries_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        value = batch.column("fp").to_numpy().view(np.uint64)
        deal, row = [], []
        for band in range(4):
            own = (band << high) | ((value >> np.uint64(16 * band + low)).astype(np.int64) & ((1 << high) - 1))
            for m in _flips(high, radius):
                some = np.flatnonzero((own ^ m <= own) | (not once))
                deal.append(own[some] ^ m)
                row.append(some)
        return np.concatenate(deal), np.concatenate(row)

    def leads_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return batch.column("at").to_numpy().astype(np.int64) >> low, np.arange(batch.num_rows)

    sent = ["fp"] if once else ["fp", "part"]
    q = _dealt(queries.select(sent), "fp", queries_of, q_n, l_n, False)
    led = _dealt(leads.select("lead", "at", *([] if once else ["other", "spread", "main"])), "lead", leads_of, l_n, q_n, True)

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = (pa.table([pa.concat_arrays([pa.array([], t.schema.field(c).type.value_type), *(x.flatten() for x in t.column(c).chunks)]) for c in t.column_names[3:]], t.column_names[3:]) for t in (a, b))
        if once:
            a = a.append_column("part", a.column("fp"))
            n = b.num_rows
            b = b.append_column("other", b.column("lead")).append_column("spread", pa.array(np.zeros(n, np.int32))).append_column("main", pa.nulls(n, pa.int64()))
        return _compared_here(key[0].as_py(), low, radius, threshold, a, b, once)

    # a block is much work and few bytes, so Spark is told how many tasks, and does not join small ones
    keys, tasks = ["deal", "i", "j"], int(np.clip(2 * (l_n * q_n).sum(), 1, TASKS))
    each = [df.repartition(tasks, *keys).groupBy(*keys) for df in (q, led)]
    return each[0].cogroup(each[1]).applyInArrow(run, "fp long, part long, at int, lead long, other long, spread int, dist int")


def _dealt(rows: DataFrame, by: str, to: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], own: np.ndarray, across: np.ndarray, flip: bool) -> DataFrame:
    """`(deal, i, j)` and the columns of `rows` as arrays: of each batch, `to` gives deals and places of rows that go there.
    A deal's rows are spread over `own` blocks by the hash of column `by`, and each goes to all blocks `across`; i is a
    block of `own` and j one of `across`, or with `flip` the other way round. Deals of no block get none."""
    names, kinds = rows.columns, ", ".join(f"{c} array<{k}>" for c, k in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deal, row = to(batch)
            value = batch.column(by).to_numpy().view(np.uint64)[row]
            mixed = ((value ^ (value >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            some = np.flatnonzero((own[deal] > 0) & (across[deal] > 0))
            deal, row, mixed = deal[some], row[some], mixed[some]
            block = (mixed % own[deal].astype(np.uint64)).astype(np.int64)
            n = across[deal]
            other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            deal, row, block = (np.repeat(x, n) for x in (deal, row, block))
            order = np.lexsort((other, block, deal))
            deal, row, block, other = (x[order] for x in (deal, row, block, other))
            new = np.flatnonzero(np.concatenate([[len(deal) > 0], (deal[1:] != deal[:-1]) | (block[1:] != block[:-1]) | (other[1:] != other[:-1])])[: len(deal)])
            edges = pa.array(np.append(new, len(deal)).astype(np.int32))
            i, j = (other, block) if flip else (block, other)
            lists = [pa.ListArray.from_arrays(edges, batch.column(c).take(pa.array(row))) for c in names]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[new].astype(np.int32)) for x in (deal, i, j)), *lists], ["deal", "i", "j", *names])

    return rows.mapInArrow(run, f"deal int, i int, j int, {kinds}")


def _compared_here(deal: int, low: int, radius: int, threshold: int, queries: pa.Table, leads: pa.Table, once: bool, at_once: int = 1 << 18) -> pa.Table:
    """One task's share of `_compared`: at each of the leads' values, all fingerprints whose band is close to it."""
    band, first, values = deal >> (16 - low), deal & ((1 << (16 - low)) - 1), 1 << low
    leads = leads.take(np.argsort(leads.column("at").to_numpy(), kind="stable"))
    at, lead, other, spread = (leads.column(c).to_numpy() for c in ("at", "lead", "other", "spread"))
    has_main, main = leads.column("main").is_valid().to_numpy(), leads.column("main").fill_null(0).to_numpy()
    fp, part = queries.column("fp").to_numpy(), queries.column("part").to_numpy()
    value = (fp.view(np.uint64) >> np.uint64(16 * band)).astype(np.int64) & 0xFFFF
    far = np.bitwise_count((value >> low) ^ first).astype(np.int64)  # bits that the deal's own first bits differ in
    slot = far * values + (value & (values - 1))
    order = np.argsort(slot, kind="stable")
    fp, part = fp[order].view(np.uint64), part[order]
    edges = np.searchsorted(slot[order], np.arange((radius + 1) * values + 1))
    flips = np.array([n * values + m for n in range(radius + 1) for m in _flips(low, radius - n)])
    limit, x = np.minimum(threshold + spread, 255).astype(np.uint8)[:, None], lead.view(np.uint64)  # distances are bytes
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def meet(l: np.ndarray, q: np.ndarray) -> None:  # noqa: E741
        step = max(1, at_once // max(1, len(l)))
        for k in range(0, len(q), step):
            some = q[k : k + step]
            dist = np.bitwise_count(x[l, None] ^ fp[None, some])
            i, j = np.divmod(np.flatnonzero((dist < limit[l]).ravel()), len(some))
            i_, j_ = l[i], some[j]
            if not once:
                keep = other[i_] != part[j_]
            else:  # a lower band that is close has the pair already
                both = x[i_] ^ fp[j_]
                keep = ((both >> np.uint64(16 * band)) & np.uint64(0xFFFF) > 0) | (lead[i_] < fp[j_].view(np.int64))
                for lower in range(band):
                    keep &= np.bitwise_count((both >> np.uint64(16 * lower)) & np.uint64(0xFFFF)) > radius
            if keep.any():
                found.append((i_[keep], j_[keep], dist[i, j][keep]))

    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
        own = int(at[a]) & (values - 1)
        slots = flips ^ own
        if once:
            slots = slots[slots >= own]  # of pairs within the deal the one with the lesser band is the lead
        n = edges[slots + 1] - edges[slots]
        q = np.repeat(edges[slots] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        here = np.arange(a, b)
        if has_main[a]:
            is_main = other[here] == main[a]
            meet(here[~is_main], q)
            meet(here[is_main], q[part[q] != main[a]])
        else:
            meet(here, q)
    i, j, dist = (np.concatenate([z[k] for z in found]) if found else np.zeros(0, np.int64) for k in range(3))
    cols = [fp[j].view(np.int64), part[j], at[i], lead[i], other[i], spread[i], dist.astype(np.int32)]
    return pa.table([pa.array(c) for c in cols], ["fp", "part", "at", "lead", "other", "spread", "dist"])


def _by_keys(near: DataFrame, reps: DataFrame, *also: str) -> DataFrame:
    named = lambda c, n: reps.select(F.col("fp").alias(c), F.col("rep").alias(n))
    return near.join(named("x", "p"), "x").join(named("y", "q"), "y").select(F.least("p", "q").alias("src"), F.greatest("p", "q").alias("dst"), *also)


def _same(df: DataFrame, reps: DataFrame, key: str, fp: str) -> DataFrame:
    return df.join(reps.where("size > 1").select(F.col("fp").alias(fp), "rep"), fp).where(F.col(key) != F.col("rep")).select(F.col("rep").alias("src"), F.col(key).alias("dst"))


#: Distinct fingerprints that one task compares with each other.
FEW = 16_384
#: Fingerprints of each band's value that stand for all that have it. There are four times 65536 such values, so all picks together are bounded.
PICKS = 4
#: Leads that a part may have at a band's value that is searched without first asking which part most fingerprints there belong to.
CALM = 4


def hamming_links(df: DataFrame, key: str, threshold: int = 12, fp: str = "fp") -> DataFrame:
    """`(src, dst)`: edges that connect the same keys as those of `hamming_pairs`, without meeting the pairs of a dense cluster.

    First every fingerprint meets a few picks of each band's value: at most `PICKS` for each, so the comparisons grow with
    the number of fingerprints. What that connects are parts. Then bands are searched exactly, but only between parts:
    in each band's value where a part has more than `CALM` leads, the part that most fingerprints there belong to does not
    meet itself, and where fingerprints of a part are within half the threshold of a common pick, their lead, others are
    compared with the lead, and with them only if the triangle inequality leaves room. One edge for each fingerprint, to the
    least of its part, and one for each pair of parts that are close is all that is returned. At most `FEW` distinct
    fingerprints, counted, are compared by one task instead.
    """
    reps = cut(exact_duplicates(df, key, fp))
    same = _same(df, reps, key, fp)
    if reps.count() <= FEW:
        ready(df.sparkSession)
        few = reps.select("fp").coalesce(1).mapInArrow(lambda batches: _few_linked(batches, threshold), "x bigint, y bigint")
        return _by_keys(cut(few), reps).unionByName(same)
    met = cut(_picked(reps.select("fp"), threshold))
    ends = met.select("fp", F.explode(F.array("lead", "reach")).alias("to")).where("fp <> to")
    parts = connected_components(ends, "fp", "to")
    rows = cut(met.join(parts, met["fp"] == parts["node"], "left").select("fp", "lead", F.coalesce("component", "fp").alias("part")))
    near = rows.where("fp <> part").select(F.col("part").alias("x"), F.col("fp").alias("y")).unionByName(_between(rows, threshold))
    return _by_keys(near, reps).unionByName(same)


def _few_linked(batches: Iterator[pa.RecordBatch], threshold: int, block: int = 128) -> Iterator[pa.RecordBatch]:
    """Edges `(x, y)` from each fingerprint to the least of its component, of few distinct fingerprints."""
    fp = np.sort(np.concatenate([np.zeros(0, np.int64), *(b.column("fp").to_numpy() for b in batches)]))
    x, up = fp.view(np.uint64), np.arange(len(fp))
    for k in range(0, len(x), block):
        near = np.bitwise_count(x[k : k + block, None] ^ x[None, k:]) < threshold
        own = roots(up, np.arange(k, len(x)))
        i, j = np.nonzero(near & (own[:block, None] != own[None, :]))
        union_edges(up, i + k, j + k)
    least = roots(up, np.arange(len(x)))
    far = np.flatnonzero(least != np.arange(len(x)))
    yield pa.RecordBatch.from_arrays([pa.array(fp[least[far]]), pa.array(fp[far])], ["x", "y"])


def _picked(fps: DataFrame, threshold: int) -> DataFrame:
    """`(fp, lead, reach)`: of the picks that have a band close to its own, in the order of their hashes, the first within half the threshold and the first within the threshold; the fingerprint itself where there is none.

    At most `PICKS` for each of four times 65536 values are sent to all tasks, which compare by arrays.
    """
    spark = fps.sparkSession
    ready(spark)
    picks = F.array_distinct(F.array(*(F.min_by("fp", F.xxhash64(F.lit(j), "fp")) for j in range(PICKS))))
    firsts = bands(fps, 0, ["fp"]).groupBy("at").agg(picks.alias("picks")).select("at", F.posexplode("picks").alias("place", "pick"))
    known = firsts.select("at", "place", "pick", F.xxhash64(F.lit(-1), "pick").alias("h")).toArrow()
    at, place, pick, h = (known.column(c).to_numpy() for c in known.column_names)
    table, there, order = (np.zeros((4 << 16, PICKS), kind) for kind in (np.uint64, bool, np.int64))
    table[at, place], there[at, place], order[at, place] = pick.view(np.uint64), True, h
    sent = spark.sparkContext.broadcast((table, there, order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.array(_flips(16, band_radius(threshold)))
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("fp"), *map(pa.array, _first_picks(fp, flips, threshold, *sent.value))], ["fp", "lead", "reach"])

    return fps.select("fp").mapInArrow(run, "fp bigint, lead bigint, reach bigint")


def _first_picks(fp: np.ndarray, flips: np.ndarray, threshold: int, table: np.ndarray, there: np.ndarray, order: np.ndarray, at_once: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Lead and reach of each fingerprint, of the picks at its bands' values and those `flips` away."""
    lead, reach, x = fp.copy(), fp.copy(), fp.view(np.uint64)
    wide = len(flips) * table.shape[1]
    step = max(1, at_once // wide)
    for k in range(0, len(fp), step):
        some = x[k : k + step]
        found = []
        for band in range(4):
            value = ((some >> np.uint64(16 * band)) & np.uint64(0xFFFF)).astype(np.int64)
            slots = (band << 16) | (value[:, None] ^ flips)
            dist = np.bitwise_count(table.take(slots, axis=0).reshape(len(some), wide) ^ some[:, None]).ravel()
            near = np.flatnonzero(dist < threshold)
            slot, p = slots.ravel()[near // table.shape[1]], near % table.shape[1]
            near, slot, p = (c[there[slot, p]] for c in (near, slot, p))
            found.append((near // wide, order[slot, p], table[slot, p], dist[near]))
        i, h, pick, dist = (np.concatenate(c) for c in zip(*found, strict=True))
        for out, most in ((lead, (threshold - 1) // 2), (reach, threshold - 1)):
            near = np.flatnonzero(dist <= most)
            near = near[np.lexsort((pick[near].view(np.int64), h[near], i[near]))]
            own, first = np.unique(i[near], return_index=True)
            out[k + own] = pick[near][first].view(np.int64)
    return lead, reach


def _meetings(rows: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """What meets of fingerprints `(fp, lead, part)`: `(fp, part, at, lead, other, spread, dist)` of a fingerprint and a lead of
    another part that have a band's value close, where the largest distance of the lead's fingerprints there leaves room
    (`_compared`); and the plain bands."""
    plain = bands(rows, 0, ["fp", "lead", "part"])
    each = cut(plain.groupBy("at", "part", "lead").agg(F.max(hamming(F.col("fp"), F.col("lead"))).alias("spread"), F.count("*").alias("n")))
    by_part = each.groupBy("at", "part").agg(F.sum("n").alias("n"), F.count("*").alias("leads"))
    # values whose parts have few leads each are searched as they are, as a fingerprint there passes few of its own part
    main = cut(by_part.groupBy("at").agg(F.when(F.max("leads") > CALM, F.max_by("part", F.struct("n", "part"))).alias("main")))
    leads = cut(each.join(main, "at").select("at", "lead", F.col("part").alias("other"), "spread", "main"))
    return _compared(rows.select("fp", "part"), leads, threshold), plain


def _between(rows: DataFrame, threshold: int) -> DataFrame:
    """`(x, y)`: parts that have close fingerprints, each pair once."""
    met, plain = _meetings(rows, threshold)
    near = cut(met)
    pair = [F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y")]
    # a lead is a fingerprint of its part, so one that is close settles the pair
    sure = cut(near.where(F.col("dist") < threshold).select(pair).distinct())
    open_ = near.where("spread > 0").withColumns({"x": pair[0], "y": pair[1]}).join(sure, ["x", "y"], "left_anti")
    members = plain.select("at", "lead", F.col("fp").alias("member"))
    return sure.unionByName(open_.join(members, ["at", "lead"]).where(hamming(F.col("fp"), F.col("member")) < threshold).select("x", "y")).distinct()


def dense_ids(labels: DataFrame, label: str, name: str) -> DataFrame:
    """Number distinct labels from 0 in their order, without one task sorting all: ranges first, then places within."""
    ranged = cut(labels.select(label).distinct().repartitionByRange(label).withColumn("part", F.spark_partition_id()))
    before = W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(W.Window.partitionBy("part").orderBy(label)) - 1
    return ranged.withColumn("place", place).join(offsets, "part").select(label, (F.col("offset") + F.col("place")).cast("long").alias(name))


def group_items(items: DataFrame, at: Column, gap: float, threshold: int = 12, key: str = "path", bucket: float = 3_600_000.0) -> DataFrame:
    """Add `group_id`: bursts and near-duplicates, linked through each other, numbered by their least key.

    Each burst is one node of the graph, so long bursts add no rounds; only edges between bursts are followed, and of close
    pairs only as many as connect them.
    """
    s = stitched_sessions(items.select(key, "fp", at.alias("at")), F.col("at"), gap, [key], bucket)
    heads = s.where("session is not null").groupBy("session").agg(F.min(key).alias("head"))
    nodes = cut(s.join(heads, "session", "left").select(key, "fp", F.coalesce("head", key).alias("node")))
    links = hamming_links(nodes, key, threshold)
    named = lambda c: nodes.select(F.col(key).alias(c), F.col("node").alias(f"{c}_node"))
    edges = links.join(named("src"), "src").join(named("dst"), "dst").select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"))
    parts = connected_components(edges)
    labelled = nodes.join(parts, "node", "left").select(key, F.coalesce("component", "node").alias("label"))
    # the label is the least burst head, and heads are least keys, so it is the least key of the group
    return items.join(labelled.join(dense_ids(labelled, "label", "group_id"), "label").select(key, "group_id"), key)
