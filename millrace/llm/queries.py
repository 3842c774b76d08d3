"""The registered queries of the operators and SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import licenses
from millrace.llm.common import WORD, table
from millrace.llm.credentials import KINDS, scan_secrets
from millrace.llm.embeddings import near_duplicate_vectors
from millrace.llm.fim import fill_in_middle, restored
from millrace.llm.langid import identify
from millrace.llm.mixing import mix_sources
from millrace.llm.neardup import near_duplicates
from millrace.llm.packing import pack_documents
from millrace.llm.quality import quality_rules
from millrace.llm.runs import find_runs
from millrace.llm.substring import substring_dedup
from millrace.llm.toxicity import fit as fit_toxicity
from millrace.llm.toxicity import score as score_toxicity
from millrace.llm.urls import filter_urls, host_of


def label_quality(labels: DataFrame) -> DataFrame:
    """labels.quality as a sampling weight: 1 counts double, 0 half; unlabelled documents get 1."""
    return labels.select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).alias("quality"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), label_quality(table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), length=35).drop("kept_text", "key")


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels"))).drop("strongest")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, similarity=(80, 100))


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def list_events(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of pages, by rule: events(key, verdict, at).

    By a hash of the host: some are blocked, taken off after 60 days and
    blocked again 30 days later; some have their /en/ directory blocked; some
    are allowed from day 100. Every other domain of two labels is blocked from
    day 180.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct().withColumn("h", _number(F.col("host")))
    domains = hosts.select(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("host")).where("host <> ''").distinct().withColumn("h", _number(F.col("host")))
    key = lambda kind, tail="": F.concat(F.lit(kind), F.col("host"), F.lit(tail)).alias("key")
    event = lambda df, k, verdict, day: df.select(k, F.lit(verdict).alias("verdict"), F.expr(f"timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast({day} as int))").alias("at"))
    parts = [event(hosts.where("h % 5 = 0"), key("d:"), v, f"h % 200 + {d}") for v, d in (("block", 0), ("remove", 60), ("block", 90))]
    parts += [event(hosts.where("h % 5 = 1"), key("p:", "/en/"), "block", "h % 300"), event(hosts.where("h % 5 = 2"), key("d:"), "allow", "100"), event(domains.where("h % 2 = 0"), key("d:"), "block", "180")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are pages, fetched on a day of 2024 by their id."""
    pages = table(spark, sf_dir, "pages")
    at = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(page_id * 37 % 366 as int))")
    captures = pages.select("page_id", "url", at.alias("fetched_at"))
    return filter_urls(captures, list_events(pages)).select("page_id", "fetched_at", "entry", "verdict", "kept")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).drop("n_letters")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("lang", "low", "high")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie in a tree by source and id; every eleventh is its directory's licence file."""
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("LICENSE."), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    path = F.concat_ws("/", F.col("source"), F.when(F.col("doc_id") % 11 != 0, (F.col("doc_id") % 7).cast("string")), F.when(F.col("doc_id") % 3 == 1, (F.col("doc_id") % 5).cast("string")), name)
    return licenses.scan_licenses(docs.select("doc_id", path.alias("path"), "text")).select("doc_id", "path", "own_license", "cosine", "license", "inherited_from")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"), seed=7, rate=100, spm=50)
    digests = [F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")
    of = lambda kind: F.filter("spans", lambda s: s.kind == kind)
    base = F.filter("spans", lambda s: s.kind != KINDS[-1])
    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:-1]], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text; one text in ten, picked by a hash of the id, is given a period from some word on."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    docs = docs.select("doc_id", "text", h.alias("h")).withColumn("g", F.floor(F.col("h") / 10)).withColumn("w", words).withColumn("n", F.size("w"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    p = F.lit(1) + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("int")
    left = F.col("n") - F.col("a")
    again = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, p), F.ceil(left / p).cast("int"))), F.lit(1), left)
    return docs.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_periods(table(spark, sf_dir, "documents")), shortest=12)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, F.concat(r.period.cast("string"), F.lit("\n")))), "")
    found = found.withColumn("best", best)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    places = [(-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period")]
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *places, F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"), sha(lines).alias("runs_sha256"), sha(F.col("kept_text")).alias("collapsed_sha256"))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_pack_sequences": op3_pack_sequences,
    "op4_toxicity": op4_toxicity,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_license_scan": op10_license_scan,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_secret_scan": op12_secret_scan,
    "op13_periodic_runs": op13_periodic_runs,
}

OP1_SQL = r"""
WITH RECURSIVE q AS (
  SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE END) AS quality FROM labels GROUP BY doc_id),
d AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(q.quality, 1.0::DOUBLE) AS q,
         (('0x' || substr(md5('mix|' || coalesce(d.doc_id::VARCHAR, 'text|' || md5(coalesce(d.text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents d LEFT JOIN q USING (doc_id)),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3)::INT] AS weight FROM d GROUP BY source),
-- sources above 3 times their size are set there, and the rest is shared anew, until none is above
capped AS (
  SELECT 0 AS step, []::VARCHAR[] AS names
  UNION ALL
  SELECT step + 1, now FROM (
    SELECT step, names, (
      SELECT coalesce(list(coalesce('s' || source, 'null')), []) FROM s
      WHERE list_contains(names, coalesce('s' || source, 'null')) OR weight * (
        (SELECT sum(source_size) FROM s)::DOUBLE - 3.0::DOUBLE * coalesce((SELECT sum(source_size) FROM s WHERE list_contains(names, coalesce('s' || source, 'null'))), 0))
        / (SELECT sum(weight) FROM s WHERE NOT list_contains(names, coalesce('s' || source, 'null'))) > 3 * source_size) AS now
    FROM capped) WHERE len(now) > len(names)),
final AS (SELECT names FROM capped ORDER BY step DESC LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN list_contains(names, coalesce('s' || source, 'null')) THEN 3.0::DOUBLE * source_size ELSE
    (((SELECT sum(source_size) FROM s)::DOUBLE - 3.0::DOUBLE * coalesce((SELECT sum(source_size) FROM s WHERE list_contains(names, coalesce('s' || source, 'null'))), 0))
     / (SELECT sum(weight) FROM s WHERE NOT list_contains(names, coalesce('s' || source, 'null')))) * weight END AS target FROM s, final),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.q, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, round(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken
FROM p
"""

OP6_SQL = r"""
WITH c AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days((page_id * 37 % 366)::INT) AS fetched_at,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
hosts AS (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 8))::BIGINT AS h FROM c WHERE host <> ''),
domains AS (SELECT DISTINCT d AS host, ('0x' || substr(md5(d), 1, 8))::BIGINT AS h FROM (SELECT regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS d FROM hosts) WHERE d <> ''),
e AS (
  SELECT 'd:' || host AS key, v.verdict, h % 200 + v.day AS day FROM hosts, (VALUES ('block', 0), ('remove', 60), ('block', 90)) v(verdict, day) WHERE h % 5 = 0
  UNION ALL SELECT 'p:' || host || '/en/', 'block', h % 300 FROM hosts WHERE h % 5 = 1
  UNION ALL SELECT 'd:' || host, 'allow', 100 FROM hosts WHERE h % 5 = 2
  UNION ALL SELECT 'd:' || host, 'block', 180 FROM domains WHERE h % 2 = 0),
o AS (SELECT key, TIMESTAMP '2024-01-01' + to_days(day::INT) AS since, max(verdict) AS verdict FROM e GROUP BY ALL),
iv AS (SELECT key, verdict, since AS start, lead(since) OVER (PARTITION BY key ORDER BY since) AS stop FROM o QUALIFY verdict <> 'remove'),
asked AS (SELECT DISTINCT url, fetched_at, host, path FROM c WHERE url IS NOT NULL AND host <> ''),
k AS (
  SELECT url, fetched_at, 'd:' || array_to_string(string_split(host, '.')[i:], '.') AS key
  FROM (SELECT *, unnest(range(1, greatest(1, len(string_split(host, '.')) - 1) + 1)) AS i FROM asked)
  UNION ALL
  SELECT url, fetched_at, 'p:' || host || array_to_string(string_split(path, '/')[:i], '/') || '/'
  FROM (SELECT *, unnest(range(1, len(string_split(path, '/')))) AS i FROM asked WHERE contains(path, '/'))),
best AS (
  SELECT url, fetched_at, key AS entry, verdict FROM k JOIN iv USING (key) WHERE fetched_at >= start AND (stop IS NULL OR fetched_at < stop)
  QUALIFY row_number() OVER (PARTITION BY url, fetched_at ORDER BY key[1] DESC, len(key) DESC, key DESC) = 1)
SELECT c.page_id, c.fetched_at, entry, verdict, coalesce(verdict <> 'block', true) AS kept FROM c LEFT JOIN best USING (url, fetched_at)
"""

OP10_SQL = r"""
WITH forms(t, license, wording) AS (VALUES {forms}),
ft AS (SELECT t, license, term, count(*) AS tf FROM (SELECT t, license, unnest(regexp_extract_all(lower(wording), '{term}')) AS term FROM forms) GROUP BY ALL),
voc AS (SELECT DISTINCT term FROM ft),
d AS (
  SELECT doc_id, concat_ws('/', source, CASE WHEN doc_id % 11 <> 0 THEN (doc_id % 7)::VARCHAR END, CASE WHEN doc_id % 3 = 1 THEN (doc_id % 5)::VARCHAR END,
         CASE WHEN doc_id % 11 = 0 THEN 'LICENSE.' || doc_id ELSE doc_id || '.txt' END) AS path, text FROM documents),
tot AS (SELECT count(text)::DOUBLE AS total FROM d),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '{term}'))) AS term FROM d) JOIN voc USING (term) GROUP BY term),
idf AS (SELECT term, ln((1 + total) / (1 + coalesce(df, 0))) + 1 AS idf FROM voc LEFT JOIN df USING (term), tot),
l AS (
  SELECT doc_id, path, i, regexp_extract_all(lower(line), '{term}') AS own, regexp_matches(line, '{no_text}') AS blank, regexp_matches(line, '{comment}') AS comment
  FROM (SELECT doc_id, path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d WHERE text IS NOT NULL)),
l2 AS (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY i) AS paragraph, coalesce(min(CASE WHEN NOT comment THEN i END) OVER (PARTITION BY doc_id), 1000000000) AS top FROM l),
-- the distinct parts: lines, paragraphs, the comment at the top, and the whole of licence files
p AS (
  SELECT doc_id, own AS part FROM l
  UNION SELECT doc_id, flatten(list(own ORDER BY i)) FROM l2 WHERE NOT blank GROUP BY doc_id, paragraph
  UNION SELECT doc_id, flatten(list(own ORDER BY i)) FROM l2 WHERE i < top GROUP BY doc_id
  UNION SELECT doc_id, flatten(list(own ORDER BY i)) FROM l2 WHERE regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{licence_file}') GROUP BY doc_id),
w AS (
  SELECT doc_id, part, term, tf * coalesce(idf, ln((1 + total) / 2) + 1) AS w FROM (
    SELECT doc_id, part, term, count(*) AS tf FROM (SELECT doc_id, row_number() OVER () AS part, part AS words FROM p) x, unnest(x.words) AS u(term) GROUP BY ALL)
  LEFT JOIN idf USING (term), tot),
n AS (SELECT part, sqrt(sum(w * w)) AS norm FROM w GROUP BY part),
f AS (SELECT t, license, term, tf * idf AS v FROM ft JOIN idf USING (term)),
fnorm AS (SELECT t, sqrt(sum(v * v)) AS form_norm FROM f GROUP BY t),
c AS (
  SELECT doc_id, license, round(dot / (norm * form_norm), 6) AS cosine
  FROM (SELECT doc_id, part, t, license, sum(w * v) AS dot FROM w JOIN f USING (term) GROUP BY ALL) JOIN n USING (part) JOIN fnorm USING (t)),
own AS (SELECT doc_id, license AS own_license, cosine FROM c WHERE cosine >= 0.6 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, license) = 1),
files AS (SELECT d.doc_id, d.path, own_license, cosine, regexp_extract(d.path, '^(.*)/[^/]*$', 1) AS home FROM d LEFT JOIN own USING (doc_id)),
folders AS (SELECT home AS folder, own_license AS found FROM files WHERE own_license IS NOT NULL AND regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{licence_file}')
            QUALIFY row_number() OVER (PARTITION BY home ORDER BY cosine DESC, own_license) = 1),
up AS (SELECT home, i, array_to_string(string_split(home, '/')[:i], '/') AS folder FROM (SELECT home, unnest(range(0, len(string_split(home, '/')) + 1)) AS i FROM (SELECT DISTINCT home FROM files))),
near AS (SELECT home, folder, found FROM up JOIN folders USING (folder) QUALIFY row_number() OVER (PARTITION BY home ORDER BY i DESC) = 1)
SELECT doc_id, path, own_license, cosine, coalesce(own_license, found) AS license, CASE WHEN own_license IS NULL THEN near.folder END AS inherited_from
FROM files LEFT JOIN near USING (home)
"""
_quoted = lambda text: "'" + text.replace("'", "''") + "'"
_forms = ", ".join(f"({i}, {_quoted(a)}, {_quoted(b)})" for i, (a, b) in enumerate(licenses.TEMPLATES))
for _name, _text in (("term", licenses.TERM), ("no_text", licenses.NO_TEXT), ("comment", licenses.COMMENT), ("licence_file", licenses.LICENCE_FILE), ("forms", _forms)):
    OP10_SQL = OP10_SQL.replace("{" + _name + "}", _text if _name == "forms" else _text.replace("'", "''"))

OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS parts, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents),
h AS (
  SELECT *, len(parts) - (parts[-1] = '')::BIGINT AS n, [('0x' || substr(hex, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS h,
         t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS stays FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b, CASE WHEN stays OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
e AS (
  SELECT *, CASE WHEN a = 0 THEN '' WHEN a = n THEN t ELSE array_to_string(parts[:a], chr(10)) || chr(10) END AS prefix,
         CASE WHEN b = 0 THEN '' WHEN b = n THEN t ELSE array_to_string(parts[:b], chr(10)) || chr(10) END AS before FROM c),
f AS (SELECT *, substr(before, length(prefix) + 1) AS middle, substr(t, length(before) + 1) AS suffix FROM e)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""

ORACLE_SQL = {"op1_mix_sources": OP1_SQL, "op6_url_filter": OP6_SQL, "op10_license_scan": OP10_SQL, "op11_fill_in_middle": OP11_SQL}
