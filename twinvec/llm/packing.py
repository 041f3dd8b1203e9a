"""Lexical retrieval packing: full windows go as they are; what is left of each
document finds its neighbours by BM25 and shares windows with them.

1. Documents become token ids (two bytes each) and an end id. Every whole window
   of a document is a sequence; the rest is its tail. The same pass counts in how
   many tails each token id stands; the sums (one number a vocabulary entry)
   are broadcast. The tokenised rows are a written table.
2. Shards are made by content: tails are range-sorted by a lexical key, the commonest of
   the frequent tokens (which tells languages and styles apart) and the three rarest
   tokens by rank in the vocabulary, so that tails that share rare words lie side by side,
   and every SHARD_DOCS of them in a row are a shard. More documents make more shards and not
   larger ones, and a key of any number of tails is cut like any other.
3. A shard holds an inverted index of its tails, token id -> (tail, weight), the
   weights from BM25 under the counts of the whole corpus. The longest unused
   tail seeds a window; its unused neighbours join, best score first and those
   that share no token last, until one does not fit. That one is cut to fill the
   window, its rest staying unused under its index entry. So a shard pads one
   sequence at most.

A seed finds the neighbours of its shard alone. README has the share of a tail's best
neighbours in the whole corpus that its shard holds.

Null texts count as empty: one piece, the end id. Repeated and null ids are separate
documents. Ties go to the tail that comes first by (key, doc_id, start, tokens).
Sequence ids of whole windows are negative. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinvec.llm.common import few, written

WINDOW, SHARD_DOCS = 2048, 256
END_ID = 1
K1, B = 1.2, 0.75
CHUNK, CHUNK_ROWS, PART = 4_000_000, 1 << 16, 500_000
CACHE_WORDS = 200_000
#: New words in one call of the tokenizer, and bytes that UTF-8 never holds.
TOGETHER = 32
NO_TEXT = (0xC0, 0xC1, *range(0xF5, 0x100))
VOCABULARY = 1 << 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: kind: 0 a whole window, 1 a tail, -1 counts.
_ROWS = pa.schema([("kind", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("key", pa.int64())])
#: Token ids that are frequent in texts, by rank in the vocabulary.
FREQUENT = (256, 8192)
SPACE, WHITE, LETTER, NUMBER, OTHER = range(5)


def _class_of(cp: int) -> int:
    import unicodedata

    if cp == 32:
        return SPACE
    if 9 <= cp <= 13 or cp in (0x85, 0xA0):
        return WHITE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(cp))[0], OTHER)


#: Class of code points up to here; texts with others go to the tokenizer whole.
TABLE_END = 0x500
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


class Encoder:
    """Token ids of texts under a byte-level BPE vocabulary, equal to those of the
    tokenizer, which sees new words alone, many in a call: words are cut by array
    operations on UTF-8 bytes and looked up."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.table = np.array([_class_of(c) for c in range(TABLE_END)], dtype=np.uint8)
        # The visible character that stands for each byte in the vocabulary.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.shown = np.zeros(256, dtype="<u2")
        self.shown[shown], self.shown[hidden] = shown, range(256, 256 + len(hidden))
        vocabulary = self.tokenizer.get_vocab()
        alone = set(map(chr, self.shown[list(NO_TEXT)])) & vocabulary.keys()
        alone -= {c for token in vocabulary if len(token) > 1 for c in token}
        self.between = next((bytes([b]) for b in NO_TEXT if chr(self.shown[b]) in alone), None)
        self.between_id = vocabulary[chr(self.shown[self.between[0]])] if self.between else -1

    def _words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, the tokenizer being asked once for TOGETHER of them: the byte between
        them stands in no text and no token but its own, so nothing merges over it."""
        step = TOGETHER if self.between else 1
        ids: list[int] = []
        for i in range(0, len(words), step):
            joined = (self.between or b"").join([*words[i : i + step], b""])
            ids += [t.id for t in self.model.tokenize(self.shown[np.frombuffer(joined, dtype=np.uint8)].tobytes().decode("utf-16-le"))]
            if not self.between:
                ids.append(-1)
        got = np.array(ids, dtype=np.int64)
        end = np.flatnonzero(got == self.between_id)
        flat = got[got != self.between_id].astype("<u2").tobytes()
        ends = (2 * (end - np.arange(len(end)))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _known(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words. Those of the last CACHE_WORDS and of as many before them are kept."""
        if len(self.cache) > CACHE_WORDS:
            self.older, self.cache = self.cache, {}
        got = list(map(self.cache.get, words))
        lost = [i for i, x in enumerate(got) if x is None]
        new = []
        for i in lost:
            got[i] = self.older.get(words[i])
            if got[i] is None:
                new.append(i)
        for i, x in zip(new, self._words([words[i] for i in new]), strict=True):
            got[i] = x
        self.cache.update((words[i], got[i]) for i in lost)
        return got

    def starts(self, data: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Places in data where a word begins; heads: where texts begin. The rule
        is the vocabulary's own: a contraction; an optional space and a run of
        letters, of numbers, or of others; white space but for its last character
        before anything else."""
        n = len(data)
        follow = (data & 0xC0) == 0x80
        cls = self.table[np.minimum(data, 127)]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            cp = ((data[lead].astype(np.uint32) & 0x1F) << 6) | (data[lead + 1] & 0x3F)
            cls[lead] = self.table[cp]
            cls[lead + 1] = cls[lead]
        group = np.maximum(cls, WHITE)  # a space is white
        first = np.zeros(n + 1, dtype=bool)
        first[heads] = True
        first[n] = True
        change = first.copy()
        change[1:n] |= group[1:] != group[:-1]
        begin = change[:n].copy()
        # Where a run of others follows white space in the same text, the last white character begins a word.
        after = np.flatnonzero(change[1:n] & ~first[1:n]) + 1
        after = after[(group[after - 1] == WHITE)]
        last = after - 1
        last = np.where(follow[last], last - 1, last)
        begin[last] = True
        begin[after] = cls[last] != SPACE
        # A lone quote that no space precedes, before one of the contractions.
        quote = np.flatnonzero(data == 0x27)
        if len(quote):
            quote = quote[(quote + 1 < n)]
            quote = quote[begin[quote] & change[quote] & change[quote + 1] & ~first[quote + 1]]
            text_end = np.append(heads[1:], n)
            for q in quote.tolist():
                limit = int(text_end[np.searchsorted(heads, q, side="right") - 1])
                rest = data[q + 1 : min(q + 3, limit)].tobytes()
                for c in CONTRACTIONS:
                    if rest.startswith(c):
                        begin[q + 1] = False
                        if q + 1 + len(c) < limit:
                            begin[q + 1 + len(c)] = True
                        break
        return np.flatnonzero(begin)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """-> ids of all texts in a row, and where each text's begin (and the end)."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        plain = self._plain(raw, sizes)
        joined = b"".join(raw if plain.all() else [r for r, ok in zip(raw, plain.tolist(), strict=True) if ok])
        del raw
        counts = np.zeros(len(texts), dtype=np.int64)
        out = np.zeros(0, dtype="<u2")
        if joined:
            where = np.flatnonzero(plain & (sizes > 0))
            heads = np.cumsum(sizes[where]) - sizes[where]
            data = np.frombuffer(joined, dtype=np.uint8)
            # Words are cut in parts of some texts, so that the arrays over single bytes stay small.
            cut = np.flatnonzero(np.diff(heads // PART, prepend=-1))
            ends = np.append(heads[cut[1:]], len(data)).tolist()
            starts = np.concatenate([a + self.starts(data[a:b], own - a) for own, a, b in zip(np.split(heads, cut[1:]), heads[cut].tolist(), ends, strict=True)])
            offsets = np.append(starts, len(data)).astype(np.int32)
            words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
            ids = pa.array(self._known(words.dictionary.to_pylist()), pa.large_binary()).take(words.indices)
            _, ends, flat = ids.buffers()
            ends = np.frombuffer(ends, dtype=np.int64, count=len(ids) + 1) // 2
            out = np.frombuffer(flat, dtype="<u2", count=ends[-1])
            counts[where] = np.diff(ends[np.append(np.searchsorted(starts, heads), len(starts))])
        if not plain.all():
            parts, ends = [], np.cumsum(counts)
            for i, ok in enumerate(plain.tolist()):
                if ok:
                    parts.append(out[ends[i] - counts[i] : ends[i]])
                else:
                    parts.append(np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype="<u2"))
            counts = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
            out = np.concatenate(parts)
        return out, np.concatenate(([0], np.cumsum(counts)))

    def _plain(self, raw: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Of each text, whether its code points are below TABLE_END and no special token stands in it."""
        joined = b"".join(raw)
        plain = np.ones(len(raw), dtype=bool)
        high = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) >= chr(TABLE_END).encode()[0])
        plain[np.searchsorted(np.cumsum(sizes), high, side="right")] = False
        for s in self.special:
            if s.encode() in joined:
                plain &= [s.encode() not in r for r in raw]
        return plain


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def distinct_tokens(tails: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """-> the distinct tokens of each tail in ascending order, how often each stands there, and where each tail's begin (and the end)."""
    if not tails:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    sizes = np.fromiter(map(len, tails), dtype=np.int64, count=len(tails))
    both = np.repeat(np.arange(len(tails), dtype=np.uint32) << 16, sizes)
    both |= np.concatenate(tails)
    both.sort()
    at = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
    times = np.diff(np.append(at, len(both)))
    both = both[at]
    return (both & 0xFFFF).astype(np.int64), times, np.append(np.searchsorted(both >> 16, np.arange(len(tails))), len(both))


def lexical_keys(token: np.ndarray, times: np.ndarray, at: np.ndarray) -> list[int]:
    """Of the distinct tokens of tails and their counts: commonest frequent token, then the three
    rarest tokens by rank, 16 bits each."""
    frequent = np.flatnonzero((token >= FREQUENT[0]) & (token < FREQUENT[1]))
    first = np.zeros(len(at) - 1, dtype=np.int64)
    if len(frequent):
        begin = np.searchsorted(frequent, at)
        some = np.flatnonzero(begin[1:] > begin[:-1])
        # Of equal counts, the least token.
        first[some] = 0xFFFF - (np.maximum.reduceat((times[frequent] << 16) | (0xFFFF - token[frequent]), begin[some]) & 0xFFFF)
    key = (first - (1 << 15)) << 48
    for i in range(3):
        rare = at[1:] - 1 - i
        key |= np.where(rare >= at[:-1], token[np.maximum(rare, 0)], 0) << (32 - 16 * i)
    return key.tolist()


def _chunks(batches):
    """Rows of record batches -> (doc ids, texts) of about CHUNK characters and at most CHUNK_ROWS rows."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            ids.append(doc)
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= CHUNK or len(ids) == CHUNK_ROWS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def tokenised(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, text) -> whole windows (crc set), tails (ids and key set), and each
    task's counts by token id."""

    def run(batches):
        enc = encoder(tokenizer)
        stats = np.zeros(VOCABULARY + 2, dtype=np.int64)
        for doc_ids, texts in _chunks(batches):
            ids, at = enc.encode(texts)
            ids, at = np.insert(ids, at[1:], END_ID), (at + np.arange(len(at))).tolist()
            wholes = [a + (b - a) // window * window for a, b in zip(at, at[1:])]
            tails = [ids[a:b] for a, b in zip(wholes, at[1:]) if a < b]
            token, times, bounds = distinct_tokens(tails)
            stats[:VOCABULARY] += np.bincount(token, minlength=VOCABULARY)
            stats[-2:] += len(tails), sum(map(len, tails))
            keys = iter(lexical_keys(token, times, bounds))
            cols = {f.name: [] for f in _ROWS}

            def put(*row, cols=cols):
                for c, v in zip(cols.values(), row, strict=True):
                    c.append(v)

            for doc, a, tail, b in zip(doc_ids, at, wholes, at[1:]):
                for s in range(a, tail, window):
                    put(0, doc, s - a, window, crc(ids[s : s + window]), b - a, None, None)
                if tail < b:
                    put(1, doc, tail - a, b - tail, None, b - a, ids[tail:b].tobytes(), next(keys))
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in _ROWS], schema=_ROWS)
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for f, x in zip(_ROWS, (-1, None, None, None, None, None, stats.tobytes(), None), strict=True)], schema=_ROWS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "kind long, doc_id long, start long, length long, crc long, doc_tokens long, ids binary, key long")


def _corpus_counts(rows: DataFrame) -> np.ndarray:
    """Sums of the tasks' counts: VOCABULARY entries and two totals."""

    def spread(batches):
        total = np.zeros(VOCABULARY + 2, dtype=np.int64)
        for pdf in batches:
            for x in pdf["ids"]:
                total += np.frombuffer(x, dtype=np.int64)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"token": at, "n": total[at]})

    got = rows.where("kind = -1").select("ids").mapInPandas(spread, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(VOCABULARY + 2, dtype=np.int64)
    out[got["token"].to_numpy(np.int64)] = got["n"]
    return out


class Index:
    """BM25 postings of the tails of a shard."""

    def __init__(self, tails: list[np.ndarray], counts: np.ndarray):
        total, mean = max(int(counts[-2]), 1), max(counts[-1] / max(counts[-2], 1), 1.0)
        sizes = np.array([len(t) for t in tails], dtype=np.int64)
        key, tf = np.unique(np.concatenate(tails).astype(np.int64) * len(tails) + np.repeat(np.arange(len(tails)), sizes), return_counts=True)
        token, self.doc = key // len(tails), key % len(tails)
        df = counts[token]
        idf = np.log1p((total - df + 0.5) / (df + 0.5))
        self.weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[self.doc] / mean))
        self.tokens, self.at = np.unique(token, return_index=True)
        self.at = np.append(self.at, len(token))
        order = np.argsort(self.doc, kind="stable")
        self.row = np.searchsorted(self.tokens, token)[order]
        self.row_at = np.searchsorted(self.doc[order], np.arange(len(tails) + 1))
        self.n = len(tails)

    def scores(self, seed: int) -> np.ndarray:
        """Of every tail, for the tokens of the seed."""
        rows = self.row[self.row_at[seed] : self.row_at[seed + 1]]
        a, b = self.at[rows], self.at[rows + 1]
        n = b - a
        ends = np.cumsum(n)
        take = np.repeat(a - (ends - n), n) + np.arange(ends[-1])
        return np.bincount(self.doc[take], weights=self.weight[take], minlength=self.n)


def fill(tails: list[np.ndarray], counts: np.ndarray, window: int = WINDOW):
    """Yields windows: lists of (tail, from, to)."""
    if not tails:
        return
    index = Index(tails, counts)
    left = np.array([len(t) for t in tails], dtype=np.int64)  # of each tail, its last `left` ids are unused
    used = np.zeros(len(tails), dtype=np.int64)
    while True:
        seed = int(left.argmax())
        if not left[seed]:
            return
        out, room = [], window

        def take(i: int, n: int, out=out):
            out.append((i, int(used[i]), int(used[i]) + n))
            used[i] += n
            left[i] -= n

        room -= int(left[seed])
        take(seed, int(left[seed]))
        if room:
            order = np.argsort(-index.scores(seed), kind="stable")
            order = order[left[order] > 0]
            for i in order.tolist():
                n = min(int(left[i]), room)
                room -= n
                take(i, n)
                if not room:
                    break
        yield out


def shards(rows: DataFrame, total: int) -> DataFrame:
    """The tails in lexical order, in partitions of some thousands, each in order; part: the partition."""
    order = ["key", "doc_id", "start", "doc_tokens", "ids"]
    tails = rows.where("kind = 1").select("doc_id", "start", "doc_tokens", "ids", "key")
    return tails.repartitionByRange(few(total, 8000, 1), "key", "doc_id").sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(doc_id, text) -> the pieces of all sequences."""
    rows = written(tokenised(docs, tokenizer, window), "tokens")
    counts = docs.sparkSession.sparkContext.broadcast(_corpus_counts(rows))
    schema = pa.schema([(f.split()[0], pa.int64()) for f in PIECES.split(", ")])

    def run(batches):
        base = None
        held: list[tuple] = []

        def shard():
            nonlocal base
            ids, starts, sizes, tails = (list(c) for c in zip(*held, strict=True))
            held.clear()
            made = []
            for pieces in fill([np.frombuffer(x, dtype="<u2") for x in tails], counts.value, window):
                at = 0
                for i, a, b in pieces:
                    made.append((ids[i], starts[i] + a, b - a, crc(np.frombuffer(tails[i], dtype="<u2")[a:b]), sizes[i], base, at))
                    at += b - a
                base += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made, strict=True)], schema=schema)

        for batch in batches:
            if base is None and batch.num_rows:
                base = batch.column("part")[0].as_py() << 40
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                held.append(row)
                if len(held) == shard_docs:
                    yield shard()
        if held:
            yield shard()

    whole = rows.where("kind = 0").select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    total = rows.where("kind = 1").count()
    files = few(total, 8000)
    return shards(rows, total).mapInArrow(run, PIECES).coalesce(files).union(whole.coalesce(files))
