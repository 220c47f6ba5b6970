"""The queries ``opN_*`` over the given tables, each a thin layer on its operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm import bpe, chat, decontam, divergence, licenses, linededup, mixing, quality, simhash, toxicity, urlfilter, vectorcodes, warc
from glossmill.llm.common import cut, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ARC archives, converted to WARC files in the shared folder, and read back."""
    arcs = warc.write_arc(table(spark, sf_dir, "pages"))
    records = cut(warc.convert_arc(arcs).where("record_type != 'warcinfo'"), "records")
    path = scratch_path(spark, "warc")
    warc.write_warc(warc.mark_revisits(records), path)
    back = warc.read_warc(spark, path)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target", "date")


OP1_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload,
         array_to_string([CASE WHEN ord(x) <= 32 OR ord(x) = 127 THEN printf('%%%02X', ord(x)) ELSE x END FOR x IN string_split(coalesce(url, ''), '')], '') AS target
  FROM pages
), hashed AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest, CASE WHEN target = '' THEN '-' ELSE target END AS target FROM p
), firsts AS (
  SELECT *, CASE WHEN payload_bytes < 100 THEN page_id ELSE min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM hashed
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, target, '2008-04-30T00:00:00Z' AS date
FROM firsts
"""


#: Rules of op2: a host with the beginning of a path, and what it says.
URL_RULES = [
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url, from rules and from the aliases of the url."""
    rules = spark.createDataFrame(URL_RULES, "rule string, action string")
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), rules).drop("component")


OP2_SQL = r"""
WITH RECURSIVE rules(rule, action) AS (
  VALUES ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'block'), ('example.net/de/8', 'block'), ('org/es/', 'block')
), p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
         regexp_extract(coalesce(url, ''), '^.*?://[^?#]*(\?[^#]*)', 1, 's') AS query, html
  FROM pages
), links AS (
  SELECT host || path || query AS node, unnest(list_concat(
    [regexp_extract(x, '(?is)href\s*=\s*["'']?([^"''>\s]+)', 1)
     for x in regexp_extract_all(html, '(?is)<link\b[^>]*>') if regexp_matches(x, '(?i)rel\s*=\s*["'']?canonical')],
    [regexp_extract(x, '(?is)url\s*=\s*["'']?([^"''>\s]+)', 1)
     for x in regexp_extract_all(html, '(?is)<meta\b[^>]*>') if regexp_matches(x, '(?i)http-equiv\s*=\s*["'']?refresh')])) AS target
  FROM p WHERE host <> ''
), edges AS (
  SELECT node AS a, translate(regexp_extract(target, '^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(target, '^.*?://[^/?#]*([^#]*)', 1) AS b
  FROM links WHERE contains(target, '://')
), both_ways AS (
  SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reach AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
), places AS (
  SELECT DISTINCT host, path FROM p
  UNION SELECT DISTINCT regexp_extract(b, '^[^/?#]*'), regexp_extract(b, '^[^/?#]*([^?#]*)', 1) FROM reach
), decided AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM places JOIN rules
    ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
   AND starts_with(path, substr(rule, strpos(rule, '/')))
  GROUP BY host, path
), said AS (
  SELECT r.a AS node, bool_or(d.action = 'allow') AS allows
  FROM reach r JOIN decided d ON d.host = regexp_extract(r.b, '^[^/?#]*') AND d.path = regexp_extract(r.b, '^[^/?#]*([^?#]*)', 1)
  GROUP BY r.a
)
SELECT p.page_id, p.host, p.path, d.rule,
       coalesce(d.action, CASE WHEN s.allows THEN 'allow' WHEN NOT s.allows THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN decided d USING (host, path) LEFT JOIN said s ON s.node = p.host || p.path || p.query
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by a factorization machine fitted on rows that are not held out."""
    docs, labels = (table(spark, sf_dir, x) for x in ("documents", "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels))
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, the base rules, and the weakly supervised verdict."""
    judged, _ = quality.judge(table(spark, sf_dir, "documents"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & F.col("good")).alias("kept"),
        "posterior",
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the line runs of at least 50 words that copy an earlier run."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.drop_copied_runs(docs, min_words=50, report=True)


OP5_SQL = """
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line
  FROM documents
), lines AS (
  SELECT doc_id, s, line, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS o,
         len(regexp_extract_all(s, '[^ \\t-\\r]+')) AS w
  FROM raw WHERE regexp_matches(s, '[^ \\t-\\r]')
), seqs AS (
  SELECT doc_id, list(s ORDER BY o) AS ss, list(w ORDER BY o) AS ws, list(line ORDER BY o) AS ls FROM lines GROUP BY doc_id
), spans AS (
  SELECT doc_id, o, m, ss[o:o + m - 1] AS run, ls[o] AS a, ls[o + m - 1] AS b,
         list_sum(ws[o:o + m - 1]) AS total, ws[o] AS head, ws[o + m - 1] AS tail
  FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS o FROM seqs) t, range(1, 51) r(m)
  WHERE o + m - 1 <= len(ss)
), tight AS (
  SELECT * FROM spans WHERE total >= 50 AND (total - head < 50 OR total - tail < 50)
), firsts AS (
  SELECT *, min(struct_pack(d := doc_id, o := o)) OVER (PARTITION BY run) AS f FROM tight
), cuts AS (
  SELECT doc_id, a, b FROM firsts WHERE struct_pack(d := doc_id, o := o) > f AND NOT (doc_id = f.d AND o < f.o + m)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS line FROM cuts
), kept AS (
  SELECT r.doc_id, string_agg(r.s, chr(10) ORDER BY r.line) AS text
  FROM raw r LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.line = g.line WHERE g.line IS NULL GROUP BY r.doc_id
), counted AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.line) AS n_deleted
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_deleted, 0) AS n_deleted
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN counted c ON d.doc_id = c.doc_id
"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    groups = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"), width=3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP7_SQL = f"""
WITH templates(license, words) AS (
  SELECT license, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')
  FROM (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in licenses.TEMPLATES)}) v(license, body)
), grams AS (
  SELECT license, list_distinct([words[i] || ' ' || words[i + 1] for i in range(1, len(words))]) AS g FROM templates
), raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
  FROM documents
), lines AS (
  SELECT doc_id, line, regexp_extract_all(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM raw
), parts AS (
  SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS part FROM lines WHERE len(words) > 0
), sentences AS (
  SELECT doc_id, line, unnest(pieces) AS s, generate_subscripts(pieces, 1) - 1 AS sentence
  FROM (SELECT doc_id, line, regexp_split_to_array(s, '[.!?][ \\t]+') AS pieces FROM raw)
  WHERE len([x for x in pieces if regexp_matches(x, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]')]) > 1
), units AS (
  SELECT doc_id, line AS line_from, line AS line_to, NULL::BIGINT AS sentence, words FROM parts
  UNION ALL
  SELECT doc_id, line, line, sentence, regexp_extract_all(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM sentences
  UNION ALL
  SELECT doc_id, min(line), max(line), NULL, flatten(list(words ORDER BY line)) FROM parts GROUP BY doc_id, part HAVING count(*) > 1
), sized AS (
  SELECT doc_id, line_from, line_to, sentence, list_distinct([words[i] || ' ' || words[i + 1] for i in range(1, len(words))]) AS u
  FROM units WHERE len(words) > 1
), scored AS (
  SELECT doc_id, license, line_from, line_to, sentence, 2.0::DOUBLE * len(list_intersect(u, g)) / (len(u) + len(g)) AS dice
  FROM sized JOIN grams ON len(g) >= 0.6 * len(u) AND len(u) >= 0.6 * len(g)
)
SELECT doc_id, license, dice, line_from, line_to, sentence FROM scored WHERE dice >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, line_from, line_to, sentence ORDER BY dice DESC, license) = 1
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes from every document."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, max_epochs=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS size,
         md5(concat_ws(':', 'mix', coalesce(CAST(doc_id AS VARCHAR), ''), md5(text))) AS r
  FROM documents
), ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST([5, 2, 1][CAST((rank - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS most FROM ranked
), fills AS (
  SELECT *, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS budget, coalesce(sum(most) OVER before, 0) AS filled,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open
  FROM weighed WINDOW before AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), water AS (
  SELECT (budget - filled) / open AS level FROM fills WHERE filled + open * most / weight >= budget ORDER BY most / weight, rank LIMIT 1
), targets AS (
  SELECT w.*, coalesce(least(most, weight * (SELECT level FROM water)), most) AS target FROM weighed w
), queued AS (
  SELECT doc_id, sized.source, size, r, rank, weight, source_size, target,
         sum(size) OVER (PARTITION BY rank ORDER BY r, doc_id, size ROWS UNBOUNDED PRECEDING) AS sent
  FROM sized JOIN targets t ON sized.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT *, CAST(epoch * source_size + sent AS DOUBLE) / weight AS finish FROM queued, (VALUES (0), (1)) e(epoch) WHERE size > 0
), ordered AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, r, doc_id, size ROWS UNBOUNDED PRECEDING) AS used FROM copies
), plan AS (
  SELECT doc_id, r, CAST(sum(size) AS BIGINT) AS taken FROM ordered WHERE used <= 1.5 * (SELECT sum(size) FROM sized) GROUP BY doc_id, r
)
SELECT q.doc_id, size, source_size, target, coalesce(taken, 0) AS taken, source
FROM queued q LEFT JOIN plan p ON q.doc_id = p.doc_id AND q.r = p.r
"""


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says control strings, formatted and read back from the output."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_conversations(turns.unionByName(planted)))
    return back.withColumn("valid", F.col("error").isNull()).drop("error")


OP9_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, row_number() OVER o AS k, count(*) OVER (PARTITION BY conv_id) AS n, lag(role) OVER o AS before,
         length(text) + length(regexp_replace(text, '[^\\]', '', 'gs'))
           + 2 * len(regexp_extract_all(text, '<</SYS>>|<<SYS>>|\[/INST\]|\[/ROLE\]|\[INST\]|\[ROLE\]|\[TEXT\]|\[OUT\]|</s>|<s>')) AS escaped,
         length(role) + length(regexp_replace(role, '[^\\]', '', 'gs'))
           + 2 * len(regexp_extract_all(role, '<</SYS>>|<<SYS>>|\[/INST\]|\[/ROLE\]|\[INST\]|\[ROLE\]|\[TEXT\]|\[OUT\]|</s>|<s>')) AS escaped_role
  FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(escaped + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 ELSE 19 + escaped_role END) AS BIGINT) AS formatted_chars,
       bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'assistant' OR before = 'system' THEN role = 'user'
                     WHEN before = 'user' THEN role = 'assistant' ELSE false END) AND bool_or(k = n AND role = 'assistant') AS valid
FROM marked GROUP BY conv_id
"""


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie inside windows of benchmark items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_benchmark(docs, table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


OP10_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS words
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM items WHERE len(w) > 0)
), places AS (
  SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, (SELECT DISTINCT n FROM windows))
), found AS (
  SELECT doc_id, k, n, item FROM places JOIN windows USING (n, words)
), hit AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS word FROM found) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(l.n_items, 0) AS n_items,
       sha256(coalesce(l.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN listed l USING (doc_id)
"""


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all usable vectors, four bytes each, and how far they are off."""
    coded, books = vectorcodes.compress(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)
    rated = vectorcodes.with_label_error(coded)
    return rated.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _op11_sql(rounds: int = 4) -> str:
    """The rounds one after another; an assignment compares every part with every entry."""
    ctes = [
        """kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, label, [CAST(floor(1024.0::DOUBLE * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and([coalesce(isfinite(x), false) FOR x IN embedding])
), parts AS (
  SELECT k, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS x FROM kept, range(4) r(p)
), book0 AS MATERIALIZED (
  SELECT p, k - 1 AS e, x AS c FROM parts WHERE k <= 256
)"""
    ]
    for n in range(rounds + 1):
        ctes.append(
            f"""near{n} AS MATERIALIZED (
  SELECT k, p, any_value(x) AS x, min(struct_pack(d := d, e := e)) AS best
  FROM (SELECT k, parts.p, e, x, CAST(list_sum([(a[1] - a[2]) * (a[1] - a[2]) FOR a IN list_zip(x, c)]) AS BIGINT) AS d FROM parts JOIN book{n} USING (p))
  GROUP BY k, p
)"""
        )
        if n < rounds:
            ctes.append(
                f"""means{n} AS (
  SELECT p, e, list(m ORDER BY i) AS c
  FROM (SELECT p, best.e AS e, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m
        FROM near{n}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS i) GROUP BY p, best.e, i)
  GROUP BY p, e
), book{n + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{n} b LEFT JOIN means{n} m ON b.p = m.p AND b.e = m.e
)"""
            )
    body = ", ".join(ctes)
    return f"""WITH {body}, coded AS (
  SELECT k, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY k
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (k)
"""


OP11_SQL = _op11_sql()


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source's words are from those of the other sources and of the language."""
    return divergence.source_divergence(table(spark, sf_dir, "documents"), least_documents=10, top_terms=10)


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), words AS (
  SELECT d, lang, source, unnest(w) AS term FROM docs
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10
), sizes AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), held AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), grps AS (
  SELECT DISTINCT lang, source FROM docs
), dense AS (
  SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n FROM grps JOIN kept USING (lang) LEFT JOIN held USING (lang, source, term)
), own AS (
  SELECT lang, source, term, n, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v)::HUGEINT AS p FROM dense JOIN sizes USING (lang)
), whole AS (
  SELECT lang, term, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v)::HUGEINT AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM dense GROUP BY lang, term) JOIN sizes USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), all_pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value
  FROM own JOIN whole USING (lang, term) WHERE n > 0 AND p > q
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank
FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 10
"""


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text by a public vocabulary, and the texts that come back of them, as digests."""
    coding = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = table(spark, sf_dir, "documents").select("doc_id", coding.encode(F.col("text")).alias("ids"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(coding.decode(F.col("ids")), 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_warc, op2_url_filter, op3_toxicity, op4_quality, op5_line_dedup, op6_simhash, op7_licenses, op8_mixing, op9_chat, op10_decontamination,
        op11_vector_codes, op12_divergence, op13_bpe,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": OP1_SQL,
        "op2_url_filter": OP2_SQL,
        "op5_line_dedup": OP5_SQL,
        "op7_licenses": OP7_SQL,
        "op8_mixing": OP8_SQL,
        "op9_chat": OP9_SQL,
        "op10_decontamination": OP10_SQL,
        "op11_vector_codes": OP11_SQL,
        "op12_divergence": OP12_SQL,
    }
