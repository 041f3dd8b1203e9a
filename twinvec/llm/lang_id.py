"""Language identification: scripts narrow the candidates of each word, character
trigrams score them, Viterbi with a switching penalty labels spans.

The model is trained on rows with a label, at most about `per_lang` of each
language, chosen by a hash of the text. Per language it holds hashed trigram
log-probabilities (BUCKETS of them) and the scripts it is written in, so its
size depends on the number of languages alone, of which it learns the MAX_LANGS most frequent. Prediction reads whole texts.

A word is a run of letters and marks with a letter. A word in a script that no learned
language uses scores nothing; a text of such words alone has the first language, with score 0. The label of a text is the language of most
letters; its score is that share, times the certainty that the language beats
the next one within each of its spans, by letters. Null texts and texts without a letter, and
all texts if nothing was learned, give `und` with score 0; ties go to the first
language in code point order. Rows are judged one by one: repeated rows keep a
row each, empty tables give empty results, other columns pass through.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
PER_LANG = 4000
MAX_LANGS = 256
PENALTY = 14.0
UND = "und"
#: First code points of script ranges, in order; the number is the script.
SCRIPTS = (
    (0x0000, 0), (0x0370, 1), (0x0400, 2), (0x0530, 3), (0x0590, 4), (0x0600, 5), (0x0700, 6), (0x0900, 7), (0x0980, 8), (0x0A00, 9),
    (0x0E00, 10), (0x0E80, 11), (0x0F00, 12), (0x10A0, 13), (0x1100, 14), (0x1200, 15), (0x1D00, 0), (0x1F00, 1), (0x2000, 0),
    (0x3040, 16), (0x3100, 17), (0x3130, 14), (0x3190, 17), (0xA000, 18), (0xAC00, 14), (0xD800, 18), (0xF900, 17), (0xFB00, 0), (0xFB1D, 4), (0xFB50, 5),
    (0xFE70, 5), (0xFF00, 0), (0x10000, 18), (0x20000, 17),
)
N_SCRIPTS = 19
_STARTS = np.array([a for a, _ in SCRIPTS], dtype=np.uint32)
_IDS = np.array([b for _, b in SCRIPTS], dtype=np.int8)
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Of each code point: 1 for a letter, 2 for a mark, else 0."""
    global _letters
    if _letters is None:
        kinds = {"L": 1, "M": 2}
        _letters = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)), dtype=np.uint8, count=sys.maxunicode + 1)
    return _letters


@dataclass
class Model:
    langs: list[str]
    #: BUCKETS x languages, log-probabilities.
    grams: np.ndarray
    #: scripts x languages, whether the language uses the script.
    scripts: np.ndarray


def _words(texts: list[str]):
    """Of all texts together: lower-case code points, (start, end) of each word,
    each word's text, and the bucket of the trigram around each code point."""
    cps = np.frombuffer(" ".join(texts).lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    lens = np.fromiter((len(t.lower()) for t in texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lens + 1)
    kind = letters()[cps]
    is_letter = kind > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], is_letter, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if (kind == 2).any():
        before = np.concatenate(([0], np.cumsum(kind == 1)))
        real = before[end] > before[start]
        for a, b in zip(start[~real], end[~real], strict=True):
            is_letter[a:b] = False  # marks without a letter
        start, end = start[real], end[real]
    owner = np.searchsorted(ends, start, side="right")
    c = np.where(is_letter, cps, 32).astype(np.uint32)
    before = np.concatenate((np.array([32], np.uint32), c[:-1]))
    after = np.concatenate((c[1:], np.array([32], np.uint32)))
    h = before * np.uint32(0x9E3779B1) ^ c * np.uint32(0x85EBCA6B) ^ after * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x27D4EB2F)
    return cps, start, end, owner, is_letter, (h >> np.uint32(16)).astype(np.int64)


def _chunks(texts: list, most: int = 500_000):
    """Slices of about `most` characters; a longer text is a slice by itself."""
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def train(docs: DataFrame, per_lang: int = PER_LANG, text: str = "text", lang: str = "lang", max_langs: int = MAX_LANGS) -> Model:
    """docs: the rows to learn from. Counts grams in the executors; the driver gets
    the sums, a row for each language and bucket at most."""
    known = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool))
    shares = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_lang / n))])
    picked = known.where((F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)) < F.coalesce(F.try_element_at(shares, F.col("lang")), F.lit(0.0)))

    def count(batches):
        grams: dict[str, np.ndarray] = {}
        for pdf in batches:
            for k, g in pdf.groupby("lang"):
                texts = g["text"].tolist()
                mine = grams.setdefault(k, np.zeros(BUCKETS + N_SCRIPTS, np.int64))
                for a, b in _chunks(texts):
                    cps, start, _, _, is_letter, bucket = _words(texts[a:b])
                    mine[:BUCKETS] += np.bincount(bucket[is_letter], minlength=BUCKETS)
                    mine[BUCKETS:] += np.bincount(_IDS[np.searchsorted(_STARTS, cps[start], side="right") - 1], minlength=N_SCRIPTS)
        for k, c in grams.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": k, "bucket": at, "n": c[at]})

    got = picked.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((BUCKETS + N_SCRIPTS, len(langs)))
    counts[got["bucket"].to_numpy(np.int64), np.searchsorted(np.array(langs, dtype=object), got["lang"].to_numpy(object))] = got["n"]
    g, s = counts[:BUCKETS] + 0.5, counts[BUCKETS:]
    grams = np.log(g / g.sum(axis=0))
    # Only differences between languages count.
    grams -= grams.max(axis=1, keepdims=True)
    return Model(langs, grams.astype(np.float32), s >= 0.001 * np.maximum(1, s.sum(axis=0)))


def _viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The labels of the words under the best path."""
    n, k = scores.shape
    best = scores.sum(axis=0, dtype=np.float64)
    top = int(best.argmax())
    # If no run of words gains half a penalty by leaving the best single label, no path with switches beats it.
    gain = np.cumsum(scores - scores[:, top : top + 1], axis=0, dtype=np.float64)
    low = np.minimum.accumulate(np.concatenate((np.zeros((1, k)), gain[:-1])), axis=0)
    if (gain - low).max() <= penalty / 2:
        return np.full(n, top, np.int64)
    from_, now = [], scores[0].tolist()
    for row in scores[1:].tolist():
        m = max(now)
        j = now.index(m)
        m -= penalty
        from_.append([i if now[i] >= m else j for i in range(k)])
        now = [s + (now[i] if now[i] >= m else m) for i, s in enumerate(row)]
    path = [now.index(max(now))]
    for step in reversed(from_):
        path.append(step[path[-1]])
    return np.array(path[::-1], np.int64)


def spans(texts: list[str], model: Model, penalty: float = PENALTY):
    """For each text: (letters of each language under the best path, those letters
    weighted by the certainty of their spans, labels of its words), or None without
    a letter. A span is a run of words of one label; its certainty is the logistic
    of the label's lead over the next language within the span."""
    out = []
    k = len(model.langs)
    for a, b in _chunks(texts):
        cps, start, end, owner, is_letter, bucket = _words(texts[a:b])
        if not len(start) or not k:
            out += [None] * (b - a)
            continue
        at = np.flatnonzero(is_letter)
        length = end - start
        firsts = np.cumsum(length) - length
        scores = np.add.reduceat(model.grams[bucket[at]], firsts, axis=0)
        allowed = model.scripts[_IDS[np.searchsorted(_STARTS, cps[start], side="right") - 1]]
        some = allowed.any(axis=1)
        scores = np.where(some[:, None], scores - 1000.0 * ~allowed, 0.0)
        scores -= scores.max(axis=1, keepdims=True)
        cut = np.searchsorted(owner, np.arange(b - a + 1))
        for i in range(b - a):
            x, y = cut[i], cut[i + 1]
            if x == y:
                out.append(None)
                continue
            path = _viterbi(scores[x:y], penalty)
            letters = length[x:y] * some[x:y]
            head = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
            total = np.add.reduceat(scores[x:y], head, axis=0, dtype=np.float64)
            label, row = path[head], np.arange(len(head))
            lead = total[row, label].copy()
            total[row, label] = -np.inf
            lead = lead - total.max(axis=1) if k > 1 else np.full(len(head), 50.0)
            sure = np.add.reduceat(letters, head) / (1.0 + np.exp(-np.clip(lead, -50, 50)))
            out.append((np.bincount(path, weights=letters, minlength=k), np.bincount(label, weights=sure, minlength=k), path))
    return out


def predict(docs: DataFrame, model: Model, text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """Adds (or replaces) lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.grams, model.scripts))

    @F.pandas_udf("lang_pred string, score double")
    def label(col: pd.Series) -> pd.DataFrame:
        m = Model(*shared.value)
        there = col.notna().to_numpy()
        texts = [t if ok else "" for t, ok in zip(col.tolist(), there, strict=True)]
        names, scores = [], []
        for got in spans(texts, m, penalty):
            if got is None:
                names.append(UND)
                scores.append(0.0)
                continue
            chars, sure, _ = got
            i = int(chars.argmax())
            names.append(m.langs[i])
            scores.append(float(sure[i] / max(chars.sum(), 1)))
        return pd.DataFrame({"lang_pred": names, "score": scores})

    both = "__lang"
    while both in docs.columns:
        both += "_"
    out = docs.withColumn(both, label(F.col(f"`{text}`")))
    return out.withColumns({"lang_pred": F.col(f"{both}.lang_pred"), "score": F.col(f"{both}.score")}).drop(both)


def held_out(doc_id) -> F.Column:
    """A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
