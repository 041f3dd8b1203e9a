"""Html extraction, language identification, packing, pipeline."""

import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from twinvec.llm import html_text, lang_id, packing, queries

# Html

PAGES = {
    "<p>a</p><p> b\n c </p>": "a\n\nb c",
    "<html><head><title>t</title><style>x</style></head><body><nav>menu</nav><article><h1>H</h1><p>One <b>two</b><br>three&amp;four &eacute;</p></article><footer>f</footer></body></html>": "H\n\nOne two three&four é",
    "<main><p>x</p><div class='comments'><p>reader</p></div><form><p>f</p></form><aside>s</aside><p>y</p></main>": "x\n\ny",
    "<article><header><h1>T</h1></header><p>a<script>if (1 < 2) {'</p>'}</script>b</p><div class='ad-box'>buy</div><!-- <p>no</p> --></article><article class='comment'><p>c</p></article>": "T\n\nab",
    "<article><p>a < b &lt;c&gt; <3</p><p>unclosed<p>next</article>": "a < b <c> <3\n\nunclosed\n\nnext",
    "<article><p>x</p><div role=navigation>n</div><div hidden>h</div><div id='cookie-notice'>k</div><p title=\"a>b\">y</p>": "x\n\ny",
    "<article><p>x</p><!-- never ends <p>y</p>": "x",
    "": "",
    "plain": "plain",
}


@pytest.mark.parametrize("page", list(PAGES))
def test_main_text(page):
    assert html_text.main_text(page) == PAGES[page]


def test_text_surges_without_an_article():
    menu = "".join(f"<div><a href='/{i}'>link {i}</a></div>" for i in range(12))
    body = "".join(f"<div>{'word ' * 40}{i}</div>" for i in range(6))
    want = "\n\n".join(f"{('word ' * 40)}{i}" for i in range(6))
    assert html_text.main_text(f"<body>{menu}{body}{menu}</body>") == want


WRAPPED = {
    "<div class='layout has-sidebar'><article><p>x</p></article></div><div class='sidebar'>s</div>": "x",
    "<div class='sidebar'><article><p>all of the text</p></article></div>": "all of the text",
    "<article><p>a</p><section id='discussion'><h2 id='social-impact'>b</h2><p>c</p></section><section id='related-work'><p>d</p></section></article>": "a\n\nb\n\nc\n\nd",
    "<article><p>a</p><h2 id='search-algorithms'>b</h2><div class='notice'>c</div><div class='sidebar'>d</div></article>": "a\n\nb\n\nc",
    "<article><p style='overflow: hidden'>a</p><p style=\"visibility: hidden\">b</p><p title='the hidden valley'>c</p><p hidden>d</p></article>": "a\n\nb\n\nc",
}


@pytest.mark.parametrize("page", list(WRAPPED))
def test_names_and_values_that_only_look_like_boilerplate(page):
    assert html_text.main_text(page) == WRAPPED[page]


def test_unmarked_pages_keep_closing_sections_and_linked_paragraphs():
    long = [f"{'word ' * 100}{i}" for i in range(10)]
    advert = "".join(f"<div class='ad'>buy {i}</div>" for i in range(3))
    linked = f"<a href='/'>{'link ' * 20}</a>end"
    page = "".join(f"<p>{x}</p>" for x in [*long[:5], linked, *long[5:]]) + advert + f"<p>{'close ' * 66}end</p>"
    want = [*long[:5], f"{'link ' * 20}end", *long[5:], f"{'close ' * 66}end"]
    assert html_text.main_text(f"<body>{page}</body>") == "\n\n".join(want)
    menu = "".join(f"<div><a href='/{i}'>{i}</a></div>" for i in range(12))
    far = f"<body><p>{long[0]}</p><p>{long[1]}</p>{menu}<p>{'close ' * 20}end</p></body>"
    assert html_text.main_text(far) == "\n\n".join([*long[:2], f"{'close ' * 20}end"])


def test_inline_boilerplate_and_hidden_stretches():
    page = """<article><p>Hi <span class="ad">BUY <span>NOW</span></span>there <span hidden>x</span>you <i style="a:b; display: none">q</i>!
    <b style="overflow:hidden" title="the hidden valley">kept</b> <span class="promo">never closed</p><p>next</p></article>"""
    assert html_text.main_text(page) == "Hi there you ! kept\n\nnext"


def test_unmatched_end_tags_stay_linear():
    began = time.time()
    assert html_text.main_text("<div>" * 60_000 + "x" + "</p></section>" * 60_000) == "x"
    assert time.time() - began < 5


def naive_picked(weight, window, surge):
    """Sums over a window by hand, region by region."""
    at = [i for i, w in enumerate(weight) if w is not None]
    w = [weight[i] for i in at]
    high = [sum(w[max(0, i - window // 2) : i + window // 2 + 1]) > surge for i in range(len(w))]
    out, i = [], 0
    while i < len(w):
        if w[i] and high[i]:
            j = i
            while j < len(w) and high[j]:
                j += 1
            j2 = max(k for k in range(i, j) if w[k]) + 1
            out += at[i:j2]
            i = j
        else:
            i += 1
    return out or [at[k] for k in range(min([k for k, x in enumerate(w) if x], default=0), max([k for k, x in enumerate(w) if x], default=-1) + 1)]


def test_surge_and_dive_against_hand_sums(spark, sf):
    r = random.Random(4)
    for _ in range(3000):
        weight = [r.choice([None, 0, 0, 5, 30, 61, 200]) for _ in range(r.randint(0, 14))]
        for window, surge in ((3, 60), (5, 100)):
            assert html_text.picked(weight, window, surge) == naive_picked(weight, window, surge), weight
    pages = [r.html for r in queries.table(spark, sf, "pages").collect()]
    whole = ["\n\n".join(x[0] for x in html_text.lines(p)[0]) for p in pages]
    assert sum(html_text.main_text(p) != w for p, w in zip(pages, whole, strict=True)) > len(pages) // 2


def test_html_query(spark, sf):
    got = queries.op1_html_text(spark, sf).collect()
    pages = {r.page_id: r.html for r in queries.table(spark, sf, "pages").collect()}
    assert len(got) == len(pages)
    for r in got:
        assert r.text == html_text.main_text(pages[r.page_id]) and r.n_chars == len(r.text) > 0
    d = spark.createDataFrame([(1, None, "x"), (2, "<p>" * 5000 + "a", "x"), (3, "<b" * 3000, "x")], "page_id long, html string, text string")
    assert [r.text for r in html_text.extract(d).orderBy("page_id").collect()] == ["", "a", ""]
    assert html_text.extract(d.limit(0)).count() == 0


# Languages


@pytest.fixture(scope="module")
def model(spark):
    d = queries.table(spark, "/root/testdata/sf0.01", "documents")
    return lang_id.train(d.where(~lang_id.held_out("doc_id")))


def test_held_out_accuracy(spark):
    got = queries.op6_language_id(spark, "/root/testdata/sf0.01").join(queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and np.mean([r.lang == r.lang_pred for r in got]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !? 42"), (4, "日本語"), (5, "the and of that " * 5000), (5, "the and of that " * 5000), (6, "\u0301\u0302 7 \u0301"), (7, "\u0301 the and of that"), (None, "the and of that")]
    d = spark.createDataFrame([(*r, "zz", "q") for r in rows], "doc_id long, text string, lang string, __lang string")
    out = lang_id.predict(d, model)
    assert out.columns == [*d.columns, "lang_pred", "score"] and out.where("__lang = 'q'").count() == len(rows)
    got = sorted((r.doc_id or 0, r.lang_pred, r.score) for r in out.collect())
    # A text with letters has a learned language, in whatever script; marks alone are no letter.
    assert [g[:2] for g in got] == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, model.langs[0]), (5, "en"), (5, "en"), (6, "und"), (7, "en")]
    assert got[4][2] == 0 and got[1][2] == 0
    assert [r[0] for r in d.where("doc_id is null").select(lang_id.held_out("doc_id")).collect()] == [False]
    assert lang_id.predict(d.limit(0), model).count() == 0
    none = lang_id.train(d.limit(0))
    assert {r.lang_pred for r in lang_id.predict(d, none).collect()} == {"und"}


def test_mixed_text_is_cut_into_spans(spark, model):
    d = {r.lang: r.text for r in queries.table(spark, "/root/testdata/sf0.01", "documents").where(F.length("text").between(800, 2000)).collect()}
    (got,) = lang_id.spans([d["en"] + " " + d["de"]], model)
    path = got[2]
    n = len(lang_id._words([d["en"]])[1])
    assert np.mean(path[:n] == model.langs.index("en")) > 0.9 and np.mean(path[n:] == model.langs.index("de")) > 0.9
    assert (np.diff(path) != 0).sum() <= 6


def test_best_path_by_trying_all():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n, k = rng.integers(1, 7), rng.integers(1, 4)
        s = rng.normal(size=(n, k)) * rng.choice([1, 5])
        value = lambda p: sum(s[i, j] for i, j in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        best = max(value(p) for p in np.ndindex(*[k] * n))
        assert abs(value(tuple(lang_id._viterbi(s, 3.0))) - best) < 1e-9


def test_scripts_narrow_candidates(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("привет мир это текст", "ru"), ("hello world this is text", "en")] * 20)]
    m = lang_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    (a, b) = lang_id.spans(["мир xxqq", "world ййщщ"], m)
    assert m.langs[a[2][0]] == "ru" and m.langs[b[2][0]] == "en"
    assert not m.scripts[2][m.langs.index("en")] and m.scripts[2][m.langs.index("ru")]


def test_bilingual_texts_keep_their_certainty(spark, sf, model):
    d = queries.table(spark, sf, "documents").where("length(text) > 300").select("lang", "text").collect()
    by: dict = {}
    for r in d:
        by.setdefault(r.lang, []).append(r.text[:300])
    mixed = [(i, x + " " + y) for a in by for b in by if a != b for i, (x, y) in enumerate(zip(by[a][:8], by[b][:8], strict=False))]
    got = lang_id.predict(spark.createDataFrame(mixed, "doc_id long, text string"), model).collect()
    assert len(got) > 20 and all(r.score > 0.3 for r in got)


# Packing


def check_pieces(docs, pieces, window=2048):
    enc = packing.encoder(queries.tokenizer_path())
    want: dict = {}
    for i, t in docs:
        want.setdefault(i, []).append([*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID])
    by: dict = {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
    assert set(by) == set(want)
    for i, copies in want.items():
        ids, k = copies[0], len(copies)  # copies under one id are equal here
        assert sum(p.length for p in by[i]) == k * len(ids)
        cover = np.zeros(len(ids), int)
        for p in by[i]:
            cut = ids[p.start : p.start + p.length]
            assert len(cut) == p.length > 0 and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(cut, "<u4").tobytes())
            cover[p.start : p.start + p.length] += 1
        assert (cover == k).all()
    seq: dict = {}
    for p in pieces:
        seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s in seq.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= window
    return sum(window - sum(n for _, n in s) for s in seq.values()) / (window * len(seq)), len(seq)


def test_packing_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    padding, _ = check_pieces(docs, queries.op2_retrieval_packing(spark, sf).collect())
    assert padding < 0.02


def test_packing_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, "x " * 9000), (4, "same text"), (4, "same text"), (5, "日本語 <|endoftext|> 'll“"), (6, "a" * 7000)]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, offset string")
    check_pieces(docs, packing.pack(d, queries.tokenizer_path()).collect())
    check_pieces(docs, packing.pack(d, queries.tokenizer_path(), window=256, shard_docs=2).collect(), 256)
    assert packing.pack(d.limit(0), queries.tokenizer_path()).count() == 0


def test_encoder_equals_the_tokenizer():
    rng = random.Random(3)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "a", "é", "ß", "1", "²", "!", "?", "\xa0", "́", "я", "x", "'s", "日", "“", "<|endoftext|>", "\t", "Ab", "\x85", "\x1c"]
    enc = packing.encoder(queries.tokenizer_path())
    texts = ["".join(rng.choice(parts[: rng.choice([12, 23, len(parts)])]) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    ids, at = enc.encode(texts)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, t


class Counted:
    """A model that counts its calls."""

    def __init__(self, model):
        self.model, self.calls = model, 0

    def tokenize(self, text):
        self.calls += 1
        return self.model.tokenize(text)


def test_new_words_go_to_the_tokenizer_many_at_once(monkeypatch):
    """Also where bytes that no text holds cannot part them, and words seen again outlast those seen once."""
    enc = packing.Encoder(queries.tokenizer_path())
    enc.model = Counted(enc.model)
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdehinorst\0ÿéя", k=rng.randint(1, 12))) for _ in range(50)) for _ in range(200)]
    want = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    ids, at = enc.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
    assert enc.model.calls < 1000  # some 9,900 distinct words
    monkeypatch.setattr(packing, "CACHE_WORDS", 100)
    enc.model.calls = 0
    for t, w in zip(texts, want, strict=True):
        ids, at = enc.encode([t, "the common words"])
        assert ids[: at[1]].tolist() == w
    assert b" common" in enc.cache | enc.older and len(enc.cache) + len(enc.older) < 1000
    assert enc.model.calls < 1000
    enc.between, enc.between_id, enc.cache, enc.older = None, -1, {}, {}
    ids, at = enc.encode(texts[:3])
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want[:3]


def test_rows_of_small_batches_are_encoded_together(spark, monkeypatch):
    calls, encode = [], packing.Encoder.encode
    monkeypatch.setattr(packing.Encoder, "encode", lambda self, texts: calls.append(len(texts)) or encode(self, texts))

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    run = packing.tokenised(Docs(), queries.tokenizer_path(), 4)
    texts = ["a b c d e", None, "", "x y z", "one"] * 20
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": pa.array([t], pa.string())}) for i, t in enumerate(texts)]
    rows = [r for b in run(iter(batches)) for r in b.to_pylist()]
    assert calls == [100]
    monkeypatch.setattr(packing, "CHUNK_ROWS", 7)
    assert rows == [r for b in run(iter(batches)) for r in b.to_pylist()] and max(calls[1:]) == 7
    assert [r["doc_id"] for r in rows[:-1]] == sorted(r["doc_id"] for r in rows[:-1]) and {r["doc_id"] for r in rows[:-1]} == set(range(100))
    assert [r["kind"] for b in run(iter([])) for r in b.to_pylist()] == [-1]


def test_keys_of_many_tails_equal_those_of_each():
    rng = np.random.default_rng(8)
    tails = [rng.integers(0, rng.choice([5, 300, 9000, 50000]), rng.integers(1, 60)).astype("<u2") for _ in range(300)]
    token, times, at = packing.distinct_tokens(tails)
    keys = packing.lexical_keys(token, times, at)
    for i, t in enumerate(tails):
        own, n = np.unique(t, return_counts=True)
        assert token[at[i] : at[i + 1]].tolist() == own.tolist() and times[at[i] : at[i + 1]].tolist() == n.tolist()
        common = [(-k, x) for x, k in zip(own.tolist(), n.tolist()) if packing.FREQUENT[0] <= x < packing.FREQUENT[1]]
        first = min(common)[1] if common else 0
        rare = [*own.tolist()[::-1], 0, 0, 0][:3]
        assert keys[i] == ((first - (1 << 15)) << 48) | (rare[0] << 32) | (rare[1] << 16) | rare[2]
    assert packing.lexical_keys(*packing.distinct_tokens([])) == []
    assert packing.lexical_keys(*packing.distinct_tokens([np.array([1], "<u2")])) == [(-(1 << 63)) | (1 << 32)]


def test_neighbours_share_windows():
    """Documents of one topic end up together more often than by chance."""
    rng = np.random.default_rng(5)
    topic = rng.integers(0, 8, 200)
    tails = [(t * 500 + rng.integers(0, 500, 300)).astype("<u2") for t in topic]
    counts = np.zeros(packing.VOCABULARY + 2, np.int64)
    for t in tails:
        counts[np.unique(t)] += 1
    counts[-2:] = len(tails), sum(map(len, tails))
    windows = list(packing.fill(tails, counts))
    assert sum(b - a for w in windows for _, a, b in w) == sum(map(len, tails))
    assert np.mean([len({topic[i] for i, _, _ in w}) == 1 for w in windows]) > 0.6


def test_shards_hold_neighbours_more_often_than_hashed_ones(spark):
    """The best ten of each twentieth tail over all tails, by brute force, that its shard holds."""
    d = queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    rows = packing.tokenised(d, queries.tokenizer_path()).cache()
    got = packing.shards(rows, rows.where("kind = 1").count()).select("doc_id", "ids").collect()
    tails, shard = [np.frombuffer(r.ids, "<u2") for r in got], np.arange(len(got)) // 64
    index = packing.Index(tails, packing._corpus_counts(rows))
    held = []
    for i in [i for i, r in enumerate(got) if r.doc_id % 20 == 0]:
        score = index.scores(i)
        score[i] = -1
        held.append(np.mean(shard[np.argsort(-score, kind="stable")[:10]] == shard[i]))
    assert np.mean(held) > 2 * 64 / len(got)


def test_sequences_of_several_shards_in_a_task_stay_apart(spark, monkeypatch, many_partitions):
    monkeypatch.setattr(packing, "few", lambda rows, each=0, least=8: 20 if least == 1 else 3)
    d = spark.createDataFrame([(i, f"w{i} " * (i % 90 + 1)) for i in range(300)], "doc_id long, text string")
    out = packing.pack(d, queries.tokenizer_path(), shard_docs=16)
    assert out.rdd.getNumPartitions() <= 6
    ends = {}
    for r in sorted(out.collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert len(ends) >= 20 and max(ends.values()) <= packing.WINDOW


def test_null_and_repeated_ids_are_packed_exactly(spark):
    big = 2**60 + 1
    docs = [(None, "a b"), (big, "same size x"), (big, "same size y"), (None, None), (big, "w " * 5000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    a, b = ([tuple(r) for r in packing.pack(d, queries.tokenizer_path()).collect()] for _ in range(2))
    assert {r[0] for r in a} == {None, big} and sorted(map(str, a)) == sorted(map(str, b))
    enc = packing.encoder(queries.tokenizer_path())
    assert sum(r[2] for r in a) == sum(1 + len(enc.tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t in docs)


def test_scores_equal_bm25():
    rng = np.random.default_rng(6)
    tails = [rng.integers(0, 30, rng.integers(5, 40)).astype("<u2") for _ in range(20)]
    counts = np.zeros(packing.VOCABULARY + 2, np.int64)
    for t in tails:
        counts[np.unique(t)] += 1
    counts[-2:] = len(tails), sum(map(len, tails))
    got = packing.Index(tails, counts).scores(3)
    for j, t in enumerate(tails):
        score = 0.0
        for q in set(tails[3].tolist()):
            tf, df = int((t == q).sum()), int(counts[q])
            score += np.log(1 + (20 - df + 0.5) / (df + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(t) / (counts[-1] / 20)))
        assert abs(score - got[j]) < 1e-9


# Pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline as p
    from twinvec.llm.common import written

    docs = queries.table(spark, sf, "documents")
    extra = spark.createDataFrame([(10**6, None, "en", "src0", 0), (10**6 + 1, "12 34", "en", "src0", 5)], docs.schema)
    docs = written(docs.union(extra))
    rows = {}
    for name, stage in p.STAGES[:-1]:
        before = docs
        docs = written(stage(spark, docs, sf))
        rows[name] = docs.collect()
        assert docs.columns == before.columns
        if name == "language_id":
            assert {r.doc_id for r in rows[name]} >= {r.doc_id for r in before.where("text is not null and doc_id < 1000000").collect()} - {r.doc_id for r in before.collect() if r.doc_id >= 10**6}
            assert not {10**6, 10**6 + 1} & {r.doc_id for r in rows[name]}
        if name == "near_duplicates":
            want = brute.ngram_join([(r.doc_id, r.text) for r in before.collect()], p.GRAM_WORDS, p.PERCENT)
            assert sorted(r.doc_id for r in rows[name]) == sorted(i for i, (_, c) in want.items() if i == c)
        if name == "pii":
            texts = {r.doc_id: r.text for r in before.collect()}
            for r in rows[name]:
                assert not brute.pii(r.text) and r.n_chars == len(r.text)
                assert (r.text == texts[r.doc_id]) or "<" in r.text
    pieces = p.STAGES[-1][1](spark, docs, sf)
    assert pieces.count() > 0 and {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in rows["mix_sources"]}
