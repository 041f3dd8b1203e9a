"""Exact Jaccard self-join of documents on word n-grams, by vertical partitioning.

Grams are ordered rare first: those of one document, then those of few, then the
frequent ones by classes of frequency, each by hash. Two sets of Jaccard
similarity t or more share a gram among the first n - ceil(t * n) + 1 of each,
so only those prefixes make candidates; a prefix gram that no other document
has is left out. Any order is right; frequencies only make candidates few.

1. Counts. Each task counts its gram hashes and sends them, as differences with
   their counts, to ranges of the hash; a range counts in how many rows each
   stands. Counted are
   hashes in the lower REGION of their space: prefixes reach no further unless a
   document has few rare grams. Kept are a bitmap of fixed size (grams of two
   rows or more) and the HEAVY most frequent grams.
2. Sets. The second pass writes per row its size and a digest of its set,
   and, if its prefix holds a gram that others may have, the prefix and the text.
   Rows of one digest are one class from here on, known by its least row number.
3. Candidates. Prefix grams go to ranges of the hash as arrays. A gram of up to
   SMALL classes gives their pairs, a larger one links each class to the least.
   Tasks do so for the grams that are large among their own rows already and send
   on one member of each, so that a range gets few rows of the most frequent gram.
4. Pairs whose sizes or parities (SIGNATURE bits that count the grams at a place modulo
   2, more for longer texts) rule them out go. Verification sends each text once to a block of pairs, cuts
   the sets into FRAGMENTS of the order, counts the overlap of each fragment by itself
   and sums them per pair. Each class is first checked against its least candidate;
   pairs that the components then join need no check, all others get one. In gram
   groups over SMALL whose members are not one component by then, the members
   outside the group's largest component are compared with all members of
   sizes that fit, in blocks of bounded size.

The number of ranges follows the rows, so a range stays as it is when data grow.
Hashes have 48 bits; overlaps are wrong only where different grams of two
compared documents collide. Null texts and texts without words have an empty
set and no links. Repeated rows and different texts under one id keep a row each,
and each links by its own text; a null id is no component's least id unless there is no
other. Empty tables give empty results; other columns are ignored. docs is read
twice and must give the same rows each time (a table does).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinvec.llm.common import dropped, few, resolve, written

NGRAM, PERCENT = 4, 85
BITS = 48
KEY_BITS, FILTER_BITS = 34, 28
REGION = 0.4
HEAVY_DF, HEAVY = 32, 1 << 18
SMALL, BLOCK = 8, 256
FLUSH = 1_500_000
CHUNK = 1_000_000
#: Rows a range, about; candidates of one class that one block checks.
RANGE_ROWS, CHECKED = 4000, 256
SIGNATURE = 1024
MARKS = 1 << 18


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_sets(texts: list[str | None], n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """-> the sorted distinct gram hashes of each text, in a row, and where each
    text's begin (and the end). A text of fewer words has one gram, all of them."""
    k = len(texts)
    data = np.frombuffer("\n".join(t or "" for t in texts).encode("utf-8", "replace"), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(k + 1, np.int64)
    sizes = np.fromiter((len((t or "").encode("utf-8", "replace")) + 1 for t in texts), dtype=np.int64, count=k)
    ends = np.cumsum(sizes)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], white, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(k + 1, np.int64)
    owner = np.searchsorted(ends, start, side="right")
    offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[~white].tobytes())]).dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.dictionary.to_pylist()), dtype=np.uint64, count=len(words.dictionary))
    w = hashes[words.indices.to_numpy()]
    per = np.bincount(owner, minlength=k)
    prime = np.uint64(0x9E3779B97F4A7C15)
    gram, who = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(w) >= n:
        gram = w[: len(w) - n + 1].copy()
        for j in range(1, n):
            gram = gram * prime + w[j : len(w) - n + 1 + j]
        inside = owner[: len(w) - n + 1] == owner[n - 1 :]
        gram, who = gram[inside], owner[: len(w) - n + 1][inside]
    firsts = np.cumsum(per) - per
    short = np.flatnonzero((per > 0) & (per < n))
    if len(short):
        h = np.full(len(short), 7, np.uint64)
        for j in range(n - 1):
            more = per[short] > j
            h[more] = h[more] * prime + w[firsts[short[more]] + j] + np.uint64(j + 1)
        gram, who = np.concatenate((gram, h)), np.concatenate((who, short))
    h = _mix(gram) >> np.uint64(64 - BITS)
    if k < 1 << (64 - BITS):
        both = np.unique((who.astype(np.uint64) << np.uint64(BITS)) | h)
        return both & np.uint64((1 << BITS) - 1), np.searchsorted(both, np.arange(k + 1).astype(np.uint64) << np.uint64(BITS))
    raise ValueError(f"at most {1 << (64 - BITS)} texts a call")


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


class Order:
    """The global order of grams: class of frequency, then hash."""

    def __init__(self, bitmap: np.ndarray, heavy: np.ndarray, heavy_class: np.ndarray):
        self.bitmap, self.heavy, self.heavy_class = bitmap, heavy, heavy_class

    def keys(self, h: np.ndarray) -> np.ndarray:
        bit = h >> np.uint64(BITS - FILTER_BITS)
        several = (self.bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
        cls = several.astype(np.uint64)
        if len(self.heavy):
            key = h >> np.uint64(BITS - KEY_BITS)
            at = np.minimum(np.searchsorted(self.heavy, key), len(self.heavy) - 1)
            hit = (self.heavy[at] == key) & (several == 1)
            cls[hit] = self.heavy_class[at[hit]]
        return (cls << np.uint64(BITS)) | h


#: Cuts of the order: by hash for grams of one document, by class and hash for others.
CUTS = np.array([1 << (BITS - 2), 2 << (BITS - 2), 3 << (BITS - 2), 1 << BITS, (1 << BITS) + (1 << (BITS - 2)), 2 << BITS], dtype=np.uint64)
LIMIT = np.uint64(int(REGION * (1 << BITS)))


def _chunks(column, most: int = CHUNK, rows: int = 20_000):
    a, n = 0, len(column)
    while a < n:
        texts, size = [], 0
        while a + len(texts) < n and size < most and len(texts) < rows:
            texts.append(column[a + len(texts)].as_py() or "")
            size += len(texts[-1])
        yield a, texts
        a += len(texts)


def gram_order(docs: DataFrame, ranges: int, n: int = NGRAM) -> Order:
    """Counts grams over all rows of docs (text)."""
    shift = KEY_BITS - int(math.log2(ranges))

    def send(batches):
        pack = zstandard.ZstdCompressor(level=1)
        held: list[np.ndarray] = []
        size = 0

        def flush():
            key, times = np.unique(np.concatenate(held) >> np.uint64(BITS - KEY_BITS), return_counts=True)
            held.clear()
            r, cut = np.unique((key >> np.uint64(shift)).astype(np.int64), return_index=True)
            gaps = [np.diff(key[a:b], prepend=np.uint64(k << shift)).astype(np.uint32) for k, a, b in zip(r.tolist(), cut, np.append(cut[1:], len(key)), strict=True)]
            each = np.split(times.astype(np.uint32), cut[1:])
            return pa.RecordBatch.from_arrays([pa.array(r, pa.int32())] + [pa.array([pack.compress(x.tobytes()) for x in col], pa.binary()) for col in (gaps, each)], names=["r", "keys", "times"])

        for batch in batches:
            for _, texts in _chunks(batch.column("text")):
                h, _ = gram_sets(texts, n)
                held.append(h[h < LIMIT])
                size += len(held[-1])
                if size > FLUSH:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    width = (1 << FILTER_BITS) // ranges

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        open_ = zstandard.ZstdDecompressor()
        r = int(pdf["r"].iloc[0])
        keys = np.concatenate([np.cumsum(np.frombuffer(open_.decompress(x), dtype=np.uint32).astype(np.uint64)) for x in pdf["keys"]]) + np.uint64(r << shift)
        times = np.concatenate([np.frombuffer(open_.decompress(x), dtype=np.uint32) for x in pdf["times"]])
        rows = np.argsort(keys, kind="stable")
        keys = keys[rows]
        head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        key, df = keys[head], np.add.reduceat(times[rows].astype(np.int64), head)
        several = df > 1
        bits = np.zeros(width, dtype=np.uint8)
        bits[(key[several] >> np.uint64(KEY_BITS - FILTER_BITS)).astype(np.int64) - r * width] = 1
        often = df >= HEAVY_DF
        # The bitmap's part of this range, and its frequent grams.
        return pd.DataFrame(
            {"r": np.concatenate(([r], np.full(often.sum(), -1))), "gram": np.concatenate(([0], key[often].astype(np.int64))),
             "df": np.concatenate(([0], df[often])), "bits": [np.packbits(bits, bitorder="little").tobytes()] + [None] * int(often.sum())}
        )

    counted = docs.select("text").mapInArrow(send, "r int, keys binary, times binary").groupBy("r").applyInPandas(count, "r int, gram long, df long, bits binary")
    counted = written(counted, "counts", few(ranges * RANGE_ROWS))
    bitmap = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8)
    for row in counted.where("r >= 0").select("r", "bits").toLocalIterator():
        a = row.r * width // 8
        bitmap[a : a + width // 8] = np.frombuffer(row.bits, dtype=np.uint8)
    top = counted.where("r < 0").orderBy(F.desc("df"), "gram").select("gram", "df").limit(HEAVY).toPandas().sort_values("gram")
    dropped(counted)
    return Order(bitmap, top["gram"].to_numpy(np.uint64), (2 + np.log2(np.maximum(top["df"].to_numpy(np.float64), 1) / HEAVY_DF)).astype(np.uint64))


def signature(keys: np.ndarray) -> np.ndarray:
    """Parities of the grams by place: two sets differ in at least as many grams
    as their signatures in bits. Sizes are SIGNATURE times a power of 2, two places a gram or
    more; folding the halves by xor gives the next smaller one."""
    size = SIGNATURE << max(0, math.ceil(math.log2(max(1, 2 * len(keys) / SIGNATURE))))
    bits = np.bincount((_mix(keys) % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def document_sets(docs: DataFrame, shared, n: int = NGRAM, percent: int = PERCENT, carry: bool = False) -> DataFrame:
    """(doc_id, text) -> uid (a row number), doc_id, n, digest, prefix (grams that others
    may have, null without any), parity and text (null without prefix), and with
    `carry` row, a struct of all columns. shared: a broadcast Order."""
    mask = np.uint64((1 << BITS) - 1)
    ends = [T.StructField(k, t) for k, t in (("n", T.LongType()), ("digest", T.BinaryType()), ("prefix", T.ArrayType(T.LongType())), ("parity", T.ArrayType(T.LongType())), ("text", T.StringType()))]

    def run(batches):
        o = Order(*shared.value)
        for batch in batches:
            for a, texts in _chunks(batch.column("text")):
                h, at = gram_sets(texts, n)
                keys = o.keys(h)
                sizes, digests, prefixes, parity = [], [], [], []
                for i in range(len(texts)):
                    own = keys[at[i] : at[i + 1]]
                    sizes.append(len(own))
                    digests.append(xxhash.xxh3_128_digest(h[at[i] : at[i + 1]].tobytes()) if len(own) else None)
                    shown = None
                    if len(own):
                        first = np.partition(own, p - 1)[:p] if (p := prefix_length(len(own), percent)) < len(own) else own
                        # Class 0 inside the counted region: no other document has the gram.
                        first = first[(first > mask) | (first >= LIMIT)]
                        shown = first.astype(np.int64) if len(first) else None
                    prefixes.append(shown)
                    parity.append(None if shown is None else signature(own & mask))
                part = batch.slice(a, len(texts))
                kept = [t if p is not None else None for t, p in zip(texts, prefixes, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in names[:-1]]
                    + [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(parity, pa.list_(pa.int64())), pa.array(kept, pa.string())],
                    names=[*names[:-1], *[f.name for f in ends]],
                )

    columns = [F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id")]
    if carry:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    given = docs.select(*columns, F.col("text").cast("string").alias("text"))
    names = given.columns
    return given.mapInArrow(run, T.StructType([*given.schema.fields[:-1], *ends]))


def _fits(na, nb, percent: int = PERCENT):
    return 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)


def _grouped(gram: np.ndarray, doc: np.ndarray, n: np.ndarray):
    """Rows by gram and id, once each: gram, id, size, the group's first row and its size, by row."""
    rows = np.lexsort((doc, gram))
    gram, doc, n = gram[rows], doc[rows], n[rows]
    new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])))
    gram, doc, n = gram[new], doc[new], n[new]
    head = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    size = np.diff(np.append(head, len(gram)))
    return gram, doc, n, np.repeat(head, size), np.repeat(size, size)


def candidates(reps: DataFrame, ranges: int, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, prefix) -> rows (a, b): pairs to check; rows with gram set: (a =
    member, b = its n) of gram groups over SMALL."""
    few = np.int64(-1)  # the size that marks the one member sent on of a group that is large already

    def stars_of(gram, doc, n, head, large):
        """Pairs of the large groups' first members with the others, where sizes fit, and the members."""
        b = np.flatnonzero(large & (head != np.arange(len(gram))))
        ok = _fits(n[head[b]], n[b], percent)
        return (doc[head[b][ok]], doc[b[ok]]), (gram[large], doc[large], n[large])

    def send(batches):
        held: list[tuple] = []
        size = salt = 0

        def flush():
            nonlocal salt
            gram, doc, n, head, many = _grouped(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            large = many > SMALL
            (a, b), (g, d, own) = stars_of(gram, doc, n, head, large)
            sent = ~large | (head == np.arange(len(gram)))
            state = np.where(large, few, 0)
            key, doc, n, state = gram[sent], doc[sent], n[sent], state[sent]
            # Ranges of the hash inside each class: no range holds the frequent grams alone.
            of = (key & ((1 << BITS) - 1)) >> (BITS - int(math.log2(ranges)))
            rows = np.argsort(of, kind="stable")
            r, cut = np.unique(of[rows], return_index=True)
            some = np.split(rows, cut[1:])
            cols = [r.tolist()] + [[x[i].tobytes() for i in some] for x in (key, doc, n, state)]
            for k in range(0, max(len(a), len(g)), 100_000):  # what is found here already, under spread keys
                x = slice(k, k + 100_000)
                salt += 1
                for c, v in zip(cols, (-1 - salt % ranges, *(y[x].astype(np.int64).tobytes() for y in (a, b, g, d))), strict=True):
                    c.append(v)
                done.append(own[x].astype(np.int64).tobytes())
            blank = [None] * (len(cols[0]) - len(done))
            out = pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in (*cols[1:], blank + done)], names=["r", "grams", "docs", "sizes", "states", "own"])
            done.clear()
            return out

        done: list[bytes] = []
        for batch in batches:
            p = batch.column("prefix")
            count = np.diff(p.offsets.to_numpy())
            held.append((p.flatten().to_numpy().astype(np.int64), np.repeat(batch.column("doc_id").to_numpy().astype(np.int64), count), np.repeat(batch.column("n").to_numpy().astype(np.int64), count)))
            size += len(held[-1][0])
            if size > FLUSH // 3:
                yield flush()
                size = 0
        if size:
            yield flush()

    def rows_of(pairs, members) -> pd.DataFrame:
        a, b = pairs
        g, d, n = members
        return pd.DataFrame(
            {"gram": pd.array(np.concatenate((np.zeros(len(a), np.int64), g)), dtype="Int64").copy(), "a": np.concatenate((a, d)), "b": np.concatenate((b, n))}
        ).assign(gram=lambda x: x["gram"].mask(np.arange(len(x)) < len(a)))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        read = lambda c: np.concatenate([np.frombuffer(x, dtype=np.int64) for x in pdf[c]])
        if pdf["r"].iloc[0] < 0:  # found by the sender
            return rows_of((read("grams"), read("docs")), (read("sizes"), read("states"), read("own")))
        gram, doc, n, state = (read(c) for c in ("grams", "docs", "sizes", "states"))
        known = np.unique(gram[state == few])
        gram, doc, n, head, many = _grouped(gram, doc, n)
        large = (many > SMALL) | np.isin(gram, known)
        left, right = [], []
        at = np.arange(len(gram)) - head
        for gap in range(1, SMALL):  # pairs of the small groups, by distance
            b = np.flatnonzero(~large & (at >= gap))
            left.append(b - gap)
            right.append(b)
        a, b = np.concatenate(left), np.concatenate(right)
        ok = _fits(n[a], n[b], percent)
        (x, y), members = stars_of(gram, doc, n, head, large)
        pairs = np.unique(np.stack((np.concatenate((doc[a[ok]], x)), np.concatenate((doc[b[ok]], y))), axis=1), axis=0)
        return rows_of((pairs[:, 0], pairs[:, 1]), members)

    sent = reps.select("doc_id", "n", "prefix").mapInArrow(send, "r int, grams binary, docs binary, sizes binary, states binary, own binary")
    return sent.groupBy("r").applyInPandas(join, "gram long, a long, b long")


def verified(pairs: DataFrame, table: DataFrame, shared, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """(a, b) -> those whose overlap, summed over the fragments of the order, is enough.
    table: (uid, text); shared: a broadcast Order. Texts of other ids go before any
    shuffle, by a broadcast of at most MARKS marks of the wanted ids; what passes by chance
    goes in the joins. Each block of up to about CHECKED pairs of one a gets a's text once."""
    mark = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS))
    marks = written(pairs.select(mark("a").alias("mark")).union(pairs.select(mark("b").alias("mark"))).distinct(), "marks", 1)
    texts = table.where("text is not null").select(F.col("uid").alias("id"), "text").withColumn("mark", mark("id"))
    texts = texts.join(F.broadcast(marks), "mark", "left_semi").drop("mark")
    hot = pairs.groupBy("a").count().where(F.col("count") > CHECKED).withColumnRenamed("a", "h")
    block = F.coalesce(F.pmod(F.xxhash64("b"), F.ceil(F.col("count") / CHECKED)), F.lit(0)).cast("int")
    placed = pairs.join(hot, F.col("a") == F.col("h"), "left").select("a", "b", block.alias("block"))
    # Merge joins at every size: neither side has a bound.
    right = placed.hint("merge").join(texts, F.col("b") == F.col("id")).select("a", "block", F.lit(1).alias("side"), "b", "text")
    left = placed.select("a", "block").distinct().hint("merge").join(texts, F.col("a") == F.col("id")).select("a", "block", F.lit(0), F.col("a"), "text")

    def run(batches):
        o = Order(*shared.value)
        base, whose = np.zeros(0, np.uint64), None
        for batch in batches:
            a, block, side, b = (batch.column(c).to_numpy() for c in ("a", "block", "side", "b"))
            for k, texts in _chunks(batch.column("text")):
                h, at = gram_sets(texts, n)
                keys = o.keys(h)
                linked = []
                for i in range(len(texts)):
                    own, r = keys[at[i] : at[i + 1]], k + i
                    if side[r] == 0:
                        base, whose = np.sort(own), (a[r], block[r])
                    elif whose == (a[r], block[r]) and len(base):
                        hit = own[base[np.minimum(np.searchsorted(base, own), len(base) - 1)] == own]
                        shares = np.bincount(np.searchsorted(CUTS, hit, side="right"), minlength=len(CUTS) + 1)
                        if (100 + percent) * int(shares.sum()) >= percent * (len(base) + len(own)):
                            linked.append(r)
                yield pa.RecordBatch.from_arrays([pa.array(a[linked]), pa.array(b[linked])], names=["a", "b"])

    both = left.union(right).toDF("a", "block", "side", "b", "text")
    return both.repartition("a", "block").sortWithinPartitions("a", "block", "side", "b").mapInArrow(run, "a long, b long")


def plausible(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) -> those that sizes and parities allow. sets: (doc_id, n, parity)."""
    x = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb"))
    # Sizes of pairs that fit differ by one folding at most.
    fold = lambda p, n: F.when(F.size(p) > n, F.transform(F.slice(p, F.lit(1), n), lambda v, i: v.bitwiseXOR(F.get(p, i + n)))).otherwise(F.col(p))
    size = F.least(F.size("pa"), F.size("pb"))
    differ = F.aggregate(F.zip_with(fold("pa", size), fold("pb", size), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    near = (100 + percent) * differ <= (100 - percent) * (F.col("na") + F.col("nb"))
    return pairs.join(x, "a").join(y, "b").where(near).select("a", "b")


def block_pairs(rows: DataFrame, prepare, carried: str, nearest: int, percent: int = 0, files: int | None = None) -> DataFrame:
    """(gram, doc_id, n, component_id, stray, carried) of key groups -> (a, b): for
    compare = prepare(rows, nearest), compare(stray place, member places) gives the members
    that a stray may be linked with and the cost of each. Groups of up to BLOCK members go many to a task's call; of a larger
    one, each block of strays meets each block of members whose sizes may fit. With `nearest`, a number
    other than 0, a larger group is dealt by a hash that changes with the number into blocks that
    are compared each by itself, and a stray gives only the pair of least cost. No call
    holds more than two blocks of a large group."""
    # Sizes that fit lie in neighbouring classes; at 0 percent all sizes fit.
    near = 1 if percent else 0
    cls = F.floor(F.log("n") / (math.log(100 / percent) + 1e-6)).cast("int") if percent else F.lit(0)
    r = written(rows.select("gram", "doc_id", "n", "component_id", "stray", carried, cls.alias("k")), "across_rows", files)
    large = written(r.groupBy(F.col("gram").alias("g")).agg(F.count("*").alias("all")).where(F.col("all") > BLOCK), "large_groups", files)
    columns = ["gram", "k", "x", "y", "side", "doc_id", "n", "component_id", carried]
    zero = F.lit(0)
    parts = F.lit(max(64, ranges_for(r.count())))
    # Side 2: a stray among its group's members.
    own = [zero.alias("k"), zero.alias("x"), F.col("deal").alias("y"), F.when(F.col("stray"), 2).otherwise(1).alias("side")]
    if nearest:
        dealt = r.join(large, r["gram"] == large["g"], "left").withColumn("deal", F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(nearest)), F.ceil(F.col("all") / BLOCK)), zero).cast("int"))
        sent = dealt.select(F.pmod(F.xxhash64("gram", "deal"), parts).alias("part"), "gram", *own, *columns[5:])
        return _in_groups(sent, columns, prepare, True)
    small = r.join(large, r["gram"] == large["g"], "left_anti").withColumn("deal", zero)
    small = small.select(F.pmod(F.xxhash64("gram"), parts).alias("part"), "gram", *own, *columns[5:])
    wide = r.join(large, r["gram"] == large["g"], "left_semi")
    # Strays go to the classes around theirs, members to their own.
    left = wide.where("stray").withColumn("k", F.explode(F.sequence(F.col("k") - near, F.col("k") + near)))
    xs = left.groupBy(F.col("gram").alias("g"), F.col("k").alias("o")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("xs"))
    ys = wide.groupBy(F.col("gram").alias("g"), F.col("k").alias("o")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("ys"))
    cut = written(xs.join(ys, ["g", "o"]), "blocks", files)
    at = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
    placed = lambda df: df.join(cut, (F.col("gram") == F.col("g")) & (F.col("k") == F.col("o"))).drop("g", "o")
    left = placed(left).select("gram", "k", at("xs").alias("x"), every("ys").alias("y"), zero.alias("side"), *columns[5:])
    right = placed(wide).select("gram", "k", every("xs").alias("x"), at("ys").alias("y"), F.lit(1).alias("side"), *columns[5:])
    blocks = left.union(right).select(F.xxhash64(*columns[:4]).alias("part"), *columns)
    return _in_groups(small.union(blocks), columns, prepare, False)


def _in_groups(rows: DataFrame, columns: list[str], prepare, nearest: bool) -> DataFrame:
    """rows: part and columns, (gram, k, x, y) naming who meets whom within a part."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*columns[:4], "doc_id"], kind="stable")
        keys = pdf[columns[:4]].to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1), [True])))
        side, ids, compare, found = pdf["side"].to_numpy(), pdf["doc_id"].to_numpy(), prepare(pdf, nearest), set()
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = side[i:j]
            members = i + np.flatnonzero(own != 0)
            for k in (i + np.flatnonzero(own != 1)).tolist():
                some, cost = compare(k, members)
                if nearest and len(some):
                    some = some[[np.argmin(cost)]]
                found.update((min(ids[k], o), max(ids[k], o)) for o in ids[some].tolist())
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    return rows.groupBy("part").applyInPandas(each, "a long, b long").distinct()


def _across(percent: int):
    """Members of other components that sizes and parities allow."""

    def prepare(rows: pd.DataFrame, nearest: bool):
        comp, n = rows["component_id"].to_numpy(), rows["n"].to_numpy()
        signs = [np.asarray(x, np.int64).view(np.uint64) for x in rows["parity"]]
        words = np.array([len(x) for x in signs])
        # By number of words: the signatures of that size, and the larger ones folded once.
        of, place = {}, {}
        for w in np.unique(words).tolist():
            own, twice = np.flatnonzero(words == w), np.flatnonzero(words == 2 * w)
            of[w] = np.stack([signs[i] for i in own] + [signs[i][:w] ^ signs[i][w:] for i in twice])
            place[w] = np.full(len(words), -1)
            place[w][np.concatenate((own, twice))] = np.arange(len(own) + len(twice))

        def compare(k: int, members: np.ndarray):
            fit = members[(comp[members] != comp[k]) & _fits(n[members], n[k], percent)]
            found, costs = [], []
            for w in np.unique(np.minimum(words[fit], words[k])).tolist():
                near = fit[np.minimum(words[fit], words[k]) == w]
                differ = np.bitwise_count(of[w][place[w][near]] ^ of[w][place[w][k]]).sum(axis=1, dtype=np.int64)
                # Jaccard j: the sets differ in (1 - j) / (1 + j) of the sum of their sizes at most.
                ok = (100 + percent) * differ <= (100 - percent) * (n[near] + n[k])
                found.append(near[ok])
                costs.append(differ[ok] / (n[near[ok]] + n[k]))
            return (np.concatenate(found), np.concatenate(costs)) if found else (fit, fit)

        return compare

    return prepare


def ranges_for(rows: int) -> int:
    """A power of 2, as many as hashes can tell apart at most (1.3e11 rows)."""
    return 1 << min(KEY_BITS - 9, max(6, math.ceil(math.log2(max(1, rows / RANGE_ROWS)))))


def _joined(docs: DataFrame, n: int, percent: int, carry: bool = False) -> tuple[DataFrame, DataFrame]:
    """-> the rows (of document_sets), and (d, best) for each digest d of several rows or
    with links: best, (no id, id, uid) of the first row of its component."""
    total = docs.count()
    ranges, files = ranges_for(total), few(total)
    order = gram_order(docs, ranges, n)
    shared = docs.sparkSession.sparkContext.broadcast((order.bitmap, order.heavy, order.heavy_class))
    table = written(document_sets(docs, shared, n, percent, carry), "sets", few(total, 16_000, 12))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("best")
    reps = table.where("n > 0").groupBy("digest").agg(F.min("uid").alias("doc_id"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("parity").alias("parity"), best)
    reps = written(reps, "classes", files)
    shown = reps.where("prefix is not null")
    found = written(candidates(shown, ranges, percent), "candidates", files)
    parity = shown.select("doc_id", "n", "parity")
    comps = resolve(
        found,
        total,
        lambda pairs: verified(pairs, table, shared, n, percent),
        lambda groups, nearest: block_pairs(groups.join(parity.drop("n"), "doc_id"), _across(percent), "parity", nearest, percent, files),
        lambda pairs: plausible(pairs, parity, percent),
    )
    dropped(found)
    shared.destroy()  # what follows reads tables
    ends = reps.select("digest", "rows", "best", "doc_id").join(comps, F.col("doc_id") == F.col("id"), "left").where("rows > 1 or id is not null")
    ends = ends.select(F.col("digest").alias("d"), F.coalesce("component_id", "doc_id").alias("c"), "best")
    first = ends.groupBy(F.col("c").alias("k")).agg(F.min("best").alias("least"))
    return table, written(ends.join(first, F.col("c") == F.col("k")).select("d", F.col("least").alias("best")), "ends", files)


def ngram_join(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id, a row for each row."""
    table, ends = _joined(docs, n, percent)
    slim = table.select("doc_id", "n", "digest")
    out = slim.join(ends, slim["digest"] == ends["d"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("best.doc_id", "doc_id").alias("component_id"))
    return out.coalesce(few(table.count()))


def near_duplicates(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay when each component keeps one: that of the least id,
    null last. Rows without words all stay."""
    table, ends = _joined(docs, n, percent, carry=True)
    slim = table.select("uid", "digest")
    gone = slim.join(ends, slim["digest"] == ends["d"]).where("uid <> best.uid").select("uid")
    total = table.count()
    return table.select("uid", "row").join(written(gone, "gone", few(total)), "uid", "left_anti").select("row.*").coalesce(few(total, 8000, 12))
