"""The package's registered queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainline.llm import bpe, decontam, hard_negatives, hmm, line_dedup, neardup, sharding, spelling, suffix_dedup, token_counts, topk, toxicity, url_filter
from grainline.llm.common import table


def word_bpe_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_exact_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), "id % 20 = 0", k=20)


def op2_url_filter(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op8_hilbert_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_super_minhash(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op5_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", kept.alias("kept_sha256"))


def op6_bwt_dedup(spark, sf_dir):
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_fm_decontamination(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontam.contamination_report(decontam.find_contamination(docs, items, ["doc_id"]))


def op9_hmm_scoring(spark, sf_dir):
    held_out = toxicity.remainder(F.col("doc_id")) == 1
    return hmm.score_documents(table(spark, sf_dir, "documents"), held_out)


def op10_bpe(spark, sf_dir):
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), word_bpe_file(), ["doc_id"]))


def byte_bpe_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), byte_bpe_file(), ["doc_id"], limit=512)


def op12_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), "vec_id % 100 = 0")


def op13_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_exact_topk, op2_url_filter, op3_toxicity, op4_super_minhash, op5_line_dedup, op6_bwt_dedup, op7_fm_decontamination, op8_hilbert_sharding, op9_hmm_scoring, op10_bpe, op11_token_counts, op12_hard_negatives, op13_spelling_variants)}
ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": r"""
        WITH RECURSIVE own AS (
            SELECT page_id, url, html,
                coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
                CASE WHEN contains(url, '://') THEN
                regexp_replace(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ':(80|443)$', '')
                || coalesce(nullif(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), ''), '/')
                || coalesce('?' || nullif(regexp_replace(array_to_string(list_filter(
                    string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
                    lambda q: NOT regexp_full_match(q, '(utm_[^=&#]*|gclid|fbclid|ref)(=.*)?')), '&'), '^&+', ''), ''), '') END AS key
            FROM pages
        ), rules(verdict, rhost, rpath) AS (
            VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                   ('block', 'net', '/es/'), ('block', 'net', '/fr/')
        ), tags AS (
            SELECT url, key, unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'),
                '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS tag
            FROM own WHERE key IS NOT NULL
        ), attrs AS (
            SELECT url, key, regexp_replace(regexp_replace(regexp_extract(tag, '(?is)\srel\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+)'), '(?s)^[^=]*=\s*', ''), '^["'']|["'']$', '', 'g') AS rel, regexp_replace(regexp_replace(regexp_extract(tag, '(?is)\shref\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+)'), '(?s)^[^=]*=\s*', ''), '^["'']|["'']$', '', 'g') AS href, regexp_replace(regexp_replace(regexp_extract(tag, '(?is)\shttp-equiv\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+)'), '(?s)^[^=]*=\s*', ''), '^["'']|["'']$', '', 'g') AS eq, regexp_replace(regexp_replace(regexp_extract(tag, '(?is)\scontent\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+)'), '(?s)^[^=]*=\s*', ''), '^["'']|["'']$', '', 'g') AS content FROM tags
        ), refs AS (
            SELECT url, key, replace(trim(ref), '&amp;', '&') AS ref, regexp_extract(url, '(?s)^(.*?)://', 1) AS scheme,
                   regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS root, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*/)', 1) AS folder
            FROM (SELECT url, key, href AS ref FROM attrs WHERE regexp_matches(rel, '(?i)(^|\s)canonical(\s|$)')
                  UNION ALL
                  SELECT url, key, regexp_extract(content, '(?is)url\s*=\s*["'']?([^"'']*)', 1) FROM attrs WHERE regexp_matches(eq, '(?i)^\s*refresh\s*$')) r
        ), targets AS (
            SELECT DISTINCT key AS u, CASE
                WHEN ref = '' THEN NULL
                WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN ref
                WHEN starts_with(ref, '//') THEN scheme || ':' || ref
                WHEN starts_with(ref, '/') THEN root || ref
                WHEN starts_with(ref, '#') OR regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
                ELSE root || coalesce(nullif(folder, ''), '/') || ref END AS target
            FROM refs
        ), links AS (
            SELECT u, target, CASE WHEN contains(target, '://') THEN
                regexp_replace(translate(regexp_extract(target, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ':(80|443)$', '')
                || coalesce(nullif(regexp_extract(target, '(?s)^.*?://[^/?#]*([^?#]*)', 1), ''), '/')
                || coalesce('?' || nullif(regexp_replace(array_to_string(list_filter(
                    string_split(regexp_extract(target, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
                    lambda q: NOT regexp_full_match(q, '(utm_[^=&#]*|gclid|fbclid|ref)(=.*)?')), '&'), '^&+', ''), ''), '') END AS v FROM targets WHERE target IS NOT NULL
        ), both_ways AS (
            SELECT u, v FROM links WHERE v IS NOT NULL UNION SELECT v, u FROM links WHERE v IS NOT NULL
        ), reach(a, b) AS (
            SELECT u, u FROM both_ways UNION SELECT r.a, e.v FROM reach r JOIN both_ways e ON r.b = e.u
        ), label AS (
            SELECT a AS key, min(b) AS component FROM reach GROUP BY a
        ), urls AS (
            SELECT key, host, path FROM own
            UNION ALL
            SELECT v, translate(regexp_extract(target, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   regexp_extract(target, '(?s)^.*?://[^/?#]*([^?#]*)', 1) FROM links
        ), matched AS (
            SELECT DISTINCT u.key, u.host, u.path, r.rhost || r.rpath AS rule, r.verdict
            FROM urls u JOIN rules r ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath)
            QUALIFY row_number() OVER (PARTITION BY u.key, u.host, u.path ORDER BY length(rule) DESC) = 1
        ), groups AS (
            SELECT coalesce(l.component, m.key) AS grp, bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow') AS blocked
            FROM matched m LEFT JOIN label l ON l.key = m.key WHERE m.key IS NOT NULL GROUP BY 1
        )
        SELECT o.page_id, o.host, o.path, m.rule,
               coalesce(m.verdict, CASE WHEN g.blocked THEN 'block' ELSE 'allow' END) AS verdict,
               m.rule IS NULL AND coalesce(g.blocked, FALSE) AS by_alias
        FROM own o
        LEFT JOIN matched m ON m.key IS NOT DISTINCT FROM o.key AND m.host = o.host AND m.path = o.path
        LEFT JOIN label l ON l.key = o.key
        LEFT JOIN groups g ON g.grp = coalesce(l.component, o.key)
    """,
    "op5_line_dedup": r"""
        WITH docs AS (
            SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE
                string_split(regexp_replace(text, '\n([ \t\r]*[^ \t\r\n])', chr(1) || '\1', 'g'), chr(1)) END AS parts
            FROM documents
        ), lines AS (
            SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS seq FROM docs
        ), ids AS (
            SELECT doc_id, part, seq, trim(part, chr(32) || chr(9) || chr(13) || chr(10)) AS line,
                   lead(line) OVER (PARTITION BY doc_id ORDER BY seq) AS line2
            FROM lines
        ), marks AS (
            SELECT *,
                   line <> '' AND length(line) >= 24
                   AND row_number() OVER (PARTITION BY line ORDER BY doc_id, seq) > 1 AS one,
                   line <> '' AND line2 IS NOT NULL
                   AND row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, seq) > 1 AS two
            FROM ids
        ), cut AS (
            SELECT *, one OR two OR coalesce(lag(two) OVER w, FALSE) AS gone FROM marks WINDOW w AS (PARTITION BY doc_id ORDER BY seq)
        ), runs AS (
            SELECT *, gone AND NOT coalesce(lag(gone) OVER w, FALSE) AS opens FROM cut WINDOW w AS (PARTITION BY doc_id ORDER BY seq)
        ), per_doc AS (
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_runs,
                   coalesce(string_agg(part, chr(10) ORDER BY seq) FILTER (NOT gone), '') AS kept
            FROM runs GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
               coalesce(n_runs, 0)::BIGINT AS n_runs, sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents d LEFT JOIN per_doc p ON d.doc_id = p.doc_id
    """,
    "op1_exact_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x
            FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.r, q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score
            FROM v q JOIN v ON q.vec_id % 20 = 0 AND v.r <> q.r
        )
        SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM scored QUALIFY rank <= 20
    """,
    "op12_hard_negatives": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.x, c.x)::BIGINT AS score
            FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.r <> c.r
        ), positives AS (
            SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score,
                   row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place
            FROM scored WHERE same QUALIFY place <= 5
        )
        SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.r, p.place ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
               s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
        FROM positives p JOIN scored s ON s.r = p.r AND NOT s.same
            AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
        QUALIFY rank <= 5
    """,
    "op13_spelling_variants": r"""
        WITH RECURSIVE crc_table AS (
            SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
            FROM range(256) r(i)
        ), runs AS (
            SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')),
                                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
            FROM documents
        ), counted AS (
            SELECT coalesce(doc_id::VARCHAR, '') || ':' AS head, run, count(*) AS n FROM runs GROUP BY ALL
        ), hashed AS (
            SELECT run, n, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(head || run, ''), lambda ch:
                    CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [192 + unicode(ch) // 64, 128 + unicode(ch) % 64] END))),
                    lambda acc, b: xor(acc // 256, t[xor(acc % 256, b) + 1])), 4294967295) AS h
            FROM counted, crc_table
        ), words AS (
            SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed
        ), vocabulary AS (
            SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
        ), deleted AS (
            SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM vocabulary, unnest(range(length(word))) u(i)
        ), near AS (
            SELECT a.word, b.word AS near, b.n AS near_n FROM deleted a JOIN deleted b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION
            SELECT a.word, v.word, v.n FROM deleted a JOIN vocabulary v ON a.rest = v.word
            UNION
            SELECT v.word, a.word, a.n FROM deleted a JOIN vocabulary v ON a.rest = v.word
        ), best AS (
            SELECT word, count(*) AS n_near, min((-near_n, near)) AS b FROM near GROUP BY word
        ), forms AS (
            SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 5 * v.n THEN b[2] END AS form, CASE WHEN -b[1] >= 5 * v.n THEN -b[1] END AS form_n
            FROM vocabulary v LEFT JOIN best USING (word)
        ), chains(word, root) AS (
            SELECT word, word FROM vocabulary UNION ALL SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
        ), roots AS (
            SELECT c.word, c.root FROM chains c JOIN forms f ON f.word = c.root WHERE f.form IS NULL
        )
        SELECT f.word, f.form, r.root, f.n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n FROM forms f JOIN roots r USING (word)
    """,
}
