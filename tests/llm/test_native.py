"""Mixing, personal data, URL filter, chat formatting."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.oracle import connect, same_rows
from twinvec.llm import chat, mixing, pii, queries, url_filter


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    same_rows(queries.queries()[name](spark, sf).toPandas(), connect(sf).execute(queries.oracle_sql()[name]).fetchdf())


def no_python(df) -> bool:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_native_plans(spark, sf):
    for name in ("op5_mix_sources", "op7_pii", "op8_url_filter", "op10_chat_format"):
        assert no_python(queries.queries()[name](spark, sf)), name


# Mixing

DOCS = "doc_id long, text string, source string, n_chars long, size string"


def docs_table(spark, rows):
    return spark.createDataFrame([(i, t, s, None, "x") for i, t, s in rows], DOCS)


def test_mix_edge_cases(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s"), (3, "", None), (4, "x " * 50, None), (5, " \n", "t"), (6, "word " * 400, "u")]
    p = mixing.plan(docs_table(spark, rows)).collect()
    total = sum(r["__mix_size"] for r in p)
    assert len(p) == 7 and total == 3 + 3 + 50 + 400
    by = {}
    for r in p:
        taken = r["__mix_full"] * r["__mix_size"] + r["__mix_cut"]
        assert 0 <= taken <= 3 * r["__mix_size"]
        by.setdefault(r.source, [0, r["__mix_target"], r["__mix_source_size"]])[0] += taken
    for taken, target, size in by.values():
        assert abs(taken - target) <= 0.5 and target <= 3 * size
    assert abs(sum(t for _, t, _ in by.values()) - total) < 1e-6


def test_mix_targets_by_resharing(spark):
    """The level equals sharing anew until no source is above its cap."""
    rng = random.Random(7)
    for _ in range(4):
        sizes = [(f"s{i}", rng.choice([0, 1, 5, 100, 1000])) for i in range(rng.randint(1, 8))]
        w = {s: (5, 2, 1)[i % 3] for i, (s, _) in enumerate(sizes)}
        size, total = dict(sizes), sum(n for _, n in sizes)
        capped: set = set()
        while True:
            left = total - sum(3 * size[s] for s in capped)
            free = [s for s in size if s not in capped]
            want = {s: left * w[s] / sum(w[x] for x in free) for s in free}
            over = {s for s in free if want[s] > 3 * size[s]}
            if not over:
                break
            capped |= over
        want |= {s: 3 * size[s] for s in capped}
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
        assert all(abs(got[s] - want[s]) < 1e-6 for s in size)


def test_mixed_corpus(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w%d" % rng.randint(0, 9)] * rng.randint(1, 30)), rng.choice("abcd")) for i in range(200)]
    d = docs_table(spark, rows)
    plan = {r.doc_id: r for r in mixing.plan(d).collect()}
    out = mixing.mix(d).collect()
    assert mixing.mix(d).columns == d.columns
    text = dict((i, t) for i, t, _ in rows)
    for i, r in plan.items():
        mine = [x.text for x in out if x.doc_id == i]
        assert mine.count(text[i]) == r["__mix_full"] + (r["__mix_cut"] == r["__mix_size"])
        assert sum(len(x.split()) for x in mine) == r["__mix_full"] * r["__mix_size"] + r["__mix_cut"]
    assert mixing.plan(d.limit(0)).count() == 0


def test_mix_ranges_beyond_one_level(spark, monkeypatch):
    """Prefix sums over several levels of ranges equal a sum over one order."""
    d = docs_table(spark, [(i, "w " * (i % 7 + 1), "ab"[i % 2]) for i in range(600)])
    want = sorted((r.doc_id, r["__mix_full"], r["__mix_cut"]) for r in mixing.plan(d).collect())
    monkeypatch.setattr(mixing, "RANGE_ROWS", 1)
    assert sorted((r.doc_id, r["__mix_full"], r["__mix_cut"]) for r in mixing.plan(d).collect()) == want


# Personal data


def test_pii_against_plain_search(spark):
    rng = random.Random(1)
    parts = ["a", "1", "2", ".", "@", "+", "-", " ", "(", ")", "4111 1111 1111 1111", "1.2.3.4", "a@b.co", "+1 (234) 555-1234", "%", "é", "😀", "\n", "256", "0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + [None, ""]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, pii int").drop("pii")
    for r in pii.detect(df).collect():
        assert [(s.start, s["rank"], s.kind, s.end) for s in r.pii if s["rank"] < 4] == brute.pii(texts[r.doc_id]), texts[r.doc_id]


def test_pii_added_kinds_and_context(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 here", "DE89 3704 0044 0532 0130 01", "my ssn is 123-45-6789", "code 123-45-6789", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "sha 04dbebab91ab85687d33eeaaf9ac699e1188f962", "call (212) 555-0100 now", "x (212) 555-0100"]
    got = {r.doc_id: [s.kind for s in r.pii] for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(8)] == [["iban"], [], ["ssn"], [], ["secret"], [], ["local_phone"], []]


def test_redaction(spark):
    texts = ["é 😀 a@b.co, 1.2.3.4 and 4111 1111 1111 1111.", "nothing here", None, "", "1.2.3.4@x.com"]
    d = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kind string")
    out = pii.redact(d)
    assert out.columns == d.columns
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["é 😀 <EMAIL>, <IP> and <CARD>.", "nothing here", None, "", "<EMAIL>"]
    assert pii.redact(d.limit(0)).count() == 0


def test_pii_long_texts_stay_linear(spark):
    long = ["a" * 100_000, "1" * 100_000, "a." * 50_000 + "@", "+1" * 50_000, "a@b" + ".c" * 50_000, "4111111111111111, " * 2000]
    got = {r.doc_id: len(r.pii) for r in pii.detect(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(6)] == [0, 0, 0, 0, 1, 2000]


def test_pii_many_spans_and_clashing_names(spark):
    parts = ["10.0.3.4", "a1@b.de", "4111 1111 1111 1111", "+1 (234) 555-1234", "é", "no", "1.2.3.4@x.com"]
    rng = random.Random(9)
    texts = ["".join(f"{rng.choice(parts)}, " for _ in range(6000)), " ".join(rng.choice(parts) for _ in range(300))]
    d = spark.createDataFrame([(i, t, "kept", "m", "s") for i, t in enumerate(texts)], "doc_id long, text string, pii string, __m_ip string, __spans string")
    out = {r.doc_id: r for r in pii.redact(d, pii.BASE).collect()}
    assert pii.redact(d).columns == d.columns and all((r.pii, r["__m_ip"], r["__spans"]) == ("kept", "m", "s") for r in out.values())
    for r in pii.detect(d, column="found").collect():
        spans = [(s.start, s["rank"], s.kind, s.end) for s in r.found if s["rank"] < 4]
        assert spans == brute.pii(texts[r.doc_id])
        parts_, at, end = [], 0, 0
        for start, _, kind, stop in spans:
            if start >= end:
                parts_ += [texts[r.doc_id][end:start], f"<{kind.upper()}>"]
            end = max(end, stop)
        assert out[r.doc_id].text == "".join(parts_) + texts[r.doc_id][end:]


def test_pii_long_secret(spark):
    d = spark.createDataFrame([(n, f"token = {'a1' * (n // 2)}") for n in (40, 140, 4000)], "doc_id long, text string")
    assert [(r.doc_id, [s.kind for s in r.pii]) for r in pii.detect(d).orderBy("doc_id").collect()] == [(40, ["secret"]), (140, ["secret"]), (4000, ["secret"])]


def test_pii_query(spark, sf):
    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    got = queries.op7_pii(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute.pii(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[2] == k for x in want) for k in pii.BASE]
        assert r.n_spans == (r.spans.count(",") + 1 if r.spans else 0)


# URL filter


def test_urls_and_rules(spark):
    cases = {
        "http://A.Example.org/es/x?q#f": ("a.example.org", "/es/x", "example.org/es/"),
        "https://example.org/en/12": ("example.org", "/en/12", "example.org/en/1"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/"),
        "https://badexample.org/es/": ("badexample.org", "/es/", "org/"),
        "https://x.com/fr": ("x.com", "/fr", None),
        "https://x.com/de/?a=/fr/": ("x.com", "/de/", "com/de/"),
        "https://x.org?u=http://y.com/de/": ("x.org", "", None),
        "no url": ("", "", None),
        "http://": ("", "", None),
        "a://b://c/d": ("b:", "//c/d", None),
    }
    rows = [(i, u, None, "h") for i, u in enumerate([*cases, None])]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule) for r in got] == [*cases.values(), ("", "", None)]


def test_propagation_against_loops(spark):
    rng = random.Random(5)
    hosts = [f"h{i}.net" for i in range(12)]
    edges = {(a, b) for _ in range(30) if (a := rng.choice(hosts)) != (b := rng.choice(hosts))}
    out = {h: sum(a == h for a, _ in edges) for h in hosts}
    into = {h: sum(b == h for _, b in edges) for h in hosts}
    t0 = {h: float(i % 4 == 0) for i, h in enumerate(hosts)}
    d0 = {h: float(i % 5 == 1) for i, h in enumerate(hosts)}
    t, d, c = dict(t0), dict(d0), url_filter.DAMPING
    for _ in range(url_filter.ROUNDS):
        t, d = ({h: (1 - c) * t0[h] + c * sum(t[a] / out[a] for a, b in edges if b == h) for h in hosts}, {h: (1 - c) * d0[h] + c * sum(d[b] / into[b] for a, b in edges if a == h) for h in hosts})
    e = spark.createDataFrame([(a, b, 1 / out[a], 1 / into[b]) for a, b in edges], "src string, dst string, fwd double, rev double")
    s = spark.createDataFrame([(h, t0[h], d0[h]) for h in hosts], "host string, t0 double, d0 double")
    for r in url_filter.propagate(s, e).collect():
        assert abs(r.trust - t[r.host]) < 1e-9 and abs(r.distrust - d[r.host]) < 1e-9


def test_links_spread_verdicts(spark):
    pages = [(0, "http://good.org/a", '<a href="http://friend.net/x">f</a>'), (1, "http://friend.net/", ""), (2, "http://x.example.org/es/1", ""), (3, "http://shady.net/", "<a href='//x.example.org/'>"), (3, "http://shady.net/", "<a href='//x.example.org/'>")]
    p = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge(p).collect()}
    assert got == {0: "allow", 1: "allow", 2: "block", 3: "block"} and url_filter.judge(p).count() == 5
    assert url_filter.judge(p.limit(0)).count() == 0


def test_seeds_weigh_alike_and_domains_join_hosts(spark):
    """Ten blocked pages do not outvote one allowed page by their number; a.b.net hears of c.b.net by b.net."""
    pages = [(i, f"http://example.org/es/{i}", "<a href = 'http://mid.net/'>") for i in range(10)] + [(20, "http://www.ok.org/", "<a href='http://mid.net/'>"), (21, "http://mid.net/", "")]
    pages += [(30, "http://u.b.net/", "<a href='//example.org/'>"), (31, "http://c.b.net/", ""), (32, "http://lone.net/", None), (33, None, None)]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[21] == "allow" and got[30] == "block" and got[31] == "block" and got[32] == "allow" and got[33] == "allow"


# Chat


def test_chat_round_trip(spark):
    rng = random.Random(2)
    parts = ["\\", "<|", "|>", "<|end|>", "<|next|>", "</s>", "[INST]", "[/INST]", "<s>", "<<SYS>>", "<", "[", "a", "é", "\n", " ", "$1"]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "we<|ird\n", None]), rng.choice([None, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))]), "x"))
    rows += [(None, 0, "user", "q", "x"), (99, None, "assistant", "late", "x"), (99, 1, "assistant", "", "x"), (99, 1, "assistant", "", "x")]
    got = chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"))).collect()
    want: dict = {}
    for c, t, r, x, _ in rows:
        want.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    assert len(got) == len(want)
    for g in got:
        turns = sorted(want[g.conv_id])
        assert [(x.role, x.text) for x in g.turns] == [t[1:] for t in turns]
        assert g.loss_texts == [x for _, r, x in turns if r == "assistant"]
        assert all(s not in "".join(g.formatted[s_.start : s_.start + s_.length] for s_ in g.loss_spans) for s in chat.CONTROLS)
    assert chat.format_chats(spark.createDataFrame(rows[:1], "conv_id long, turn long, role string, text string, formatted string").limit(0)).count() == 0


def test_adjacent_turns_become_one_message(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")]
    f = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first().formatted
    assert f == "<|turn|>user<|says|>a<|next|>b<|end|><|turn|>assistant<|says|>c<|end|>"


def test_op10_planted_conversation(spark, sf):
    r = queries.op10_chat_format(spark, sf).where("conv_id = -1").first()
    said = "</s>[INST] ok [/INST]"
    assert (r.n_turns, r.loss_chars) == (2, len(said))
    assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert F.col("x") is not None


def test_mix_of_few_rows_has_few_files(spark, sf, many_partitions):
    d = queries.table(spark, sf, "documents")
    out = mixing.mix(d)
    assert out.rdd.getNumPartitions() <= 12
    want = mixing.plan(d).selectExpr("sum(__mix_full + if(__mix_cut > 0, 1, 0)) n").first().n
    assert out.count() == want
