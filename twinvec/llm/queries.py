"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinvec.llm import chat, chroma, embed_dedup, html_text, lang_id, mixing, ngram_join, packing, pii, url_filter
from twinvec.llm.common import LOWER, UPPER, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return p.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = lang_id.train(d.where(~lang_id.held_out("doc_id")))
    return lang_id.predict(d, model).select("doc_id", lang_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    # No table holds audio: every vector is rendered as a recording, near copies as near copies.
    recordings = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec_id"), "embedding")
    return chroma.match(recordings, "embedding", chroma.NOTE_RATE, chroma.melody)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.size_of(F.col("text")).alias("size"))
    d = written(d, "sizes")
    p = mixing.plan(d, size=F.col("size"))
    return p.select(
        "doc_id",
        F.col("__mix_size").alias("size"),
        F.col("__mix_source_size").alias("source_size"),
        F.round("__mix_target", 6).alias("target"),
        (F.col("__mix_full") * F.col("__mix_size") + F.col("__mix_cut")).alias("taken"),
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("pii", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")  # noqa: E731
    base = F.filter("pii", lambda s: s["rank"] < len(pii.BASE))
    return d.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(pii.span_list(base), 256).alias("base_sha256"), pii.span_list(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    c = chat.read_back(chat.format_chats(t))
    digest = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return c.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )  # fmt: skip


def queries() -> dict:
    return {f.__name__: f for f in (op1_html_text, op2_retrieval_packing, op3_embedding_dedup, op4_chroma_fingerprints, op6_language_id, op5_mix_sources, op7_pii, op8_url_filter, op9_ngram_join, op10_chat_format)}


_ESC = "replace(coalesce({0}, ''), chr(92), chr(92) || chr(92))"
for _s in chat.CONTROLS:
    _ESC = f"replace({_ESC}, '{_s}', '{_s[0]}' || chr(92) || '{_s[1:]}')"
_OP10 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER w THEN 1 ELSE 0 END AS head,
             length({_ESC.format("text")}) AS n_text, length({_ESC.format("role")}) AS n_role
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n_text + CASE WHEN head = 1 THEN n_role + {len(chat.TURN + chat.SAYS + chat.END)} ELSE {len(chat.NEXT)} END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id"""
_OP5 = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT)] AS w,
             row_number() OVER (ORDER BY source NULLS LAST) AS i FROM s),
l AS (SELECT *, sum(size) OVER () - coalesce(sum(size * 3) OVER o, 0) AS ls, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS lw
      FROM w WINDOW o AS (ORDER BY CAST(size * 3 AS DOUBLE) / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, size AS source_size, least(w * max(CAST(ls AS DOUBLE) / CAST(lw AS DOUBLE)) OVER (), CAST(size * 3 AS DOUBLE)) AS target FROM l),
p AS (SELECT d.*, source_size, target, CAST(round(target) AS BIGINT) AS budget,
             CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS full_epochs,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(full_epochs * size + greatest(0, least(size, budget - full_epochs * source_size - before)) AS BIGINT) AS taken
FROM p"""


def _op8() -> str:
    """The rules as a CASE, longest first, and each round of both ranks as a table expression."""
    u = url_filter
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"  # noqa: E731
    rules = sorted(u.RULES, key=lambda r: -len(r[0] + r[1]))
    case = lambda of: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{of(h, p, v)}'" for h, p, v in rules) + " END"  # noqa: E731
    href = u.HREF.replace("'", "''")
    rounds = []
    for k in range(u.ROUNDS):
        rounds.append(f"""r{k + 1} AS (SELECT host, sum(t) AS t, sum(d) AS d FROM (
            SELECT e.dst AS host, {u.DAMPING} * e.fwd * r.t AS t, 0.0::DOUBLE AS d FROM e JOIN r{k} r ON e.src = r.host
            UNION ALL SELECT e.src, 0.0::DOUBLE, {u.DAMPING} * e.rev * r.d FROM e JOIN r{k} r ON e.dst = r.host
            UNION ALL SELECT host, {1 - u.DAMPING} * t, {1 - u.DAMPING} * d FROM r0) GROUP BY host)""")
    return rf"""
WITH a AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
j AS (SELECT *, {case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS said FROM p),
v AS (SELECT host, count(*) FILTER (said = 'allow')::DOUBLE AS t, count(*) FILTER (said = 'block')::DOUBLE AS d FROM j GROUP BY host),
r0 AS (SELECT host, t / coalesce(nullif(sum(t) OVER (), 0), 1) AS t, d / coalesce(nullif(sum(d) OVER (), 0), 1) AS d FROM v),
n AS (SELECT src, dst, count(*)::DOUBLE AS n FROM (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{href}', 1)), '{UPPER}', '{LOWER}') AS dst FROM p)
      WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
s AS (SELECT host AS src, regexp_extract(host, '{u.SITE}', 1) AS dst FROM v WHERE host <> ''),
l AS (SELECT src, dst, sum(n) AS n FROM (SELECT * FROM n UNION ALL SELECT src, dst, {u.SITE_WEIGHT} FROM s WHERE dst <> '' AND src <> dst
      UNION ALL SELECT dst, src, {u.SITE_WEIGHT} FROM s WHERE dst <> '' AND src <> dst) GROUP BY src, dst),
e AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS fwd, n / sum(n) OVER (PARTITION BY dst) AS rev FROM l),
{", ".join(rounds)}
SELECT page_id, j.host, path, rule, coalesce(said, CASE WHEN coalesce(d, 0) > coalesce(t, 0) + {u.MARGIN} THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN r{u.ROUNDS} r ON j.host = r.host"""


#: Components by reachability, the whole of it: for tables on which SQL can list it.
_OP3 = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS i, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda t: t IS NULL OR NOT isfinite(t))) = 0 AND len(list_filter(e, lambda t: t <> 0)) > 0),
l AS (SELECT a.i, b.i AS j FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.i <> b.i WHERE list_cosine_similarity(a.e, b.e) >= {embed_dedup.THRESHOLD}),
r(i, j) AS (SELECT i, i FROM v UNION SELECT r.i, l.j FROM r JOIN l ON r.j = l.i),
c AS (SELECT r.i, min(v.vec_id) AS component_id FROM r JOIN v ON r.j = v.i GROUP BY r.i),
n AS (SELECT i, count(*) AS n FROM l GROUP BY i)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept FROM v JOIN c USING (i) LEFT JOIN n USING (i)"""
_OP9 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^ 	-]+') AS w FROM documents),
s AS (SELECT i, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' '))) END AS g FROM d),
c AS (SELECT g, min(i) AS u, len(g) AS n FROM (SELECT i, doc_id, list_sort(g) AS g FROM s) GROUP BY g),
m AS (SELECT s.i, s.doc_id, c.u, c.n FROM s JOIN c ON list_sort(s.g) = c.g),
x AS (SELECT u, n, hash(unnest(g)) AS h FROM c),
l AS (SELECT a.u, b.u AS v FROM x a JOIN x b ON a.h = b.h AND a.u < b.u AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
      GROUP BY a.u, b.u, a.n, b.n HAVING 185 * count(*) >= 85 * (a.n + b.n)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(u, v) AS (SELECT u, u FROM c UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
k AS (SELECT r.u, min(m.doc_id) AS component_id FROM r JOIN m ON r.v = m.u GROUP BY r.u)
SELECT m.doc_id, m.n AS n_shingles, CASE WHEN m.n = 0 THEN m.doc_id ELSE k.component_id END AS component_id FROM m JOIN k ON m.u = k.u"""


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_dedup": _OP3, "op9_ngram_join": _OP9, "op8_url_filter": _op8(), "op5_mix_sources": _OP5, "op10_chat_format": _OP10}
