"""DuckDB oracle SQL, one statement per registered query.

Written independently of the Spark plans (plain joins, window functions
and a recursive CTE) over the same driver tables; only the pattern
constants and the input derivation rules are shared.
"""

from __future__ import annotations

from quire.functions import html as H
from quire.operators import files as V
from quire.operators import retrieve as Q
from quire.plans import derive as D
from quire.plans import sqlx as X

NL = "chr(10)"


def _case_list(values, key: str, else_sql: str = "NULL") -> str:
    """``[v0, v1, ...][key + 1]`` written as a CASE (1-based DuckDB lists)."""
    whens = " ".join(f"WHEN {i} THEN {X.lit(v) if isinstance(v, str) else v}" for i, v in enumerate(values))
    return f"CASE {key} {whens} ELSE {else_sql} END"


MARKED_PAGES = f"""
marked AS (
  SELECT page_id, url,
         {_case_list(D.FRAMEWORK_MARKERS, 'page_id % 7', "''")} || html || '<script>'
         || repeat('x', CAST(length(html) * (page_id % 5) AS INTEGER)) || '</script>' AS html
  FROM pages)"""


def _features_sql(src: str) -> str:
    return f"""
feat0 AS (
  SELECT page_id, {X.url_netloc('url')} AS host, CAST(length(html) AS BIGINT) AS html_len,
         CAST(length({X.visible_text('html')}) AS BIGINT) AS text_len, {X.frameworks('html')} AS frameworks
  FROM {src}),
feat AS (
  SELECT page_id, host, html_len, text_len,
         CASE WHEN html_len = 0 THEN 0.0 ELSE text_len / html_len END AS text_ratio, frameworks,
         frameworks <> '' AND (CASE WHEN html_len = 0 THEN 0.0 ELSE text_len / html_len END)
             < {X.dbl(H.TEXT_RATIO_THRESHOLD)} AS is_dynamic
  FROM feat0)"""


PAGE_FEATURES = f"WITH {MARKED_PAGES}, {_features_sql('marked')} SELECT * FROM feat"

STREAM_PAGE_FEATURES = f"WITH {_features_sql('pages')} SELECT * FROM feat"

SITE_RENDER_NEEDS = f"""WITH {MARKED_PAGES}, {_features_sql('marked')}
SELECT host, count(*) AS n_pages, count(*) FILTER (WHERE is_dynamic) AS n_dynamic,
       count(*) FILTER (WHERE NOT is_dynamic) AS n_static,
       count(*) FILTER (WHERE frameworks <> '') AS n_with_framework,
       CAST(sum(text_len) AS BIGINT) AS text_chars, CAST(sum(html_len) AS BIGINT) AS html_chars,
       CAST(sum(text_len) AS DOUBLE) / CAST(sum(html_len) AS DOUBLE) AS site_text_ratio
FROM feat GROUP BY host"""

URL_PARTS = f"""
SELECT page_id, {X.is_url('url')} AS is_url, {X.url_scheme('url')} AS scheme, {X.url_netloc('url')} AS netloc,
       {X.url_path('url')} AS path, {X.url_query('url')} AS query, {X.defrag('url')} AS defragged,
       {X.scope_path('url')} AS scope, {X.host_slug('url')} AS host_slug,
       {X.file_name(X.url_path('url'))} AS name, {X.file_stem(X.url_path('url'))} AS stem,
       {X.file_ext(X.url_path('url'))} AS ext
FROM pages"""


LINKED = f"""(SELECT url, '<a href="' || {X.scope_path('url')} || '/part?p=1#x"></a><a href=''beside.html''></a><a class="a" href=/></a><a href="https://other.example/'
    || {X.scope_path('url')} || '/part">o</a>' || html AS html FROM pages)"""


def _links_sql(scope: str, pages: str = "pages") -> str:
    steps = X.url_join_ctes("hrefs", "src", "href", "dst")
    ctes = ",\n".join(f"{n} AS ({s})" for n, s in steps)
    cond = f"{X.url_netloc('dst')} = {X.url_netloc('src')}"
    if scope == "page":
        cond += f" AND starts_with({X.scope_path('dst')}, {X.scope_path('src')})"
    return f"""WITH raw AS (SELECT url AS src, unnest({X.href_values('html')}) AS v FROM {LINKED if scope == "page" else pages}),
dec AS (SELECT src, {X.defrag(X.unquote_decode('v'))} AS href FROM raw),
hrefs AS (SELECT src, href FROM dec WHERE href <> ''),
{ctes}
SELECT DISTINCT src, dst FROM uj7 WHERE {cond}"""


PAGE_LINKS = _links_sql("site")

STREAM_RECRAWL = f"""WITH arrived AS (
  SELECT CASE WHEN page_id % 2 = 0 THEN 1 ELSE 2 END AS run, * FROM pages
  UNION ALL SELECT 2, page_id + {D.AGAIN}, url, html FROM pages WHERE page_id % 3 = 0),
firsts AS (SELECT page_id, url, html FROM arrived WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY run, page_id) = 1),
{_features_sql('firsts')},
links AS ({_links_sql('site', 'firsts')}),
n AS (SELECT src, count(*) AS n_links FROM links GROUP BY src)
SELECT feat.page_id, f.url, host, text_len, frameworks, is_dynamic, coalesce(n_links, 0) AS n_links
FROM feat JOIN firsts f USING (page_id) LEFT JOIN n ON n.src = f.url"""
PAGE_LINKS_SCOPED = _links_sql("page")

HOSTS = f"""
pg AS (SELECT page_id, url, {X.url_netloc('url')} AS host FROM pages),
reg AS (SELECT min(page_id) AS pos, host AS keyword, 'https://' || host || '/' AS url FROM pg GROUP BY host)"""

_KEYWORD_HITS = f"""{HOSTS},
req AS (
  SELECT page_id * 5 + 0 AS req_id, url AS keyword_or_url FROM pg UNION ALL
  SELECT page_id * 5 + 1, upper(host) FROM pg UNION ALL
  SELECT page_id * 5 + 2, split_part(host, '.', 1) FROM pg UNION ALL
  SELECT page_id * 5 + 3, host FROM pg UNION ALL
  SELECT page_id * 5 + 4, CASE WHEN page_id % 10 = 0 THEN '' ELSE 'nohost-' || page_id END FROM pg),
hits AS (
  SELECT r.req_id, r.keyword_or_url, g.pos, g.keyword, g.url
  FROM req r JOIN reg g ON instr(lower(g.keyword), lower(r.keyword_or_url)) > 0
  WHERE r.keyword_or_url <> '' AND NOT {X.is_url('r.keyword_or_url')})"""

KEYWORD_MATCHES = f"WITH {_KEYWORD_HITS} SELECT req_id, pos, keyword FROM hits"

RESOLVE_KEYWORDS = f"""WITH {_KEYWORD_HITS},
per AS (
  SELECT req_id, max(CASE WHEN keyword = keyword_or_url THEN url END) AS exact_url,
         arg_min(url, pos) FILTER (WHERE lower(keyword) = lower(keyword_or_url)) AS ci_url,
         count(*) AS n_sub, arg_min(url, pos) AS sub_url
  FROM hits GROUP BY req_id),
amb AS (
  SELECT req_id, string_agg(keyword, ', ' ORDER BY pos) AS names
  FROM hits GROUP BY req_id),
avail AS (SELECT string_agg(keyword, ', ' ORDER BY pos) AS available
          FROM reg),
t AS (
  SELECT req.req_id, req.keyword_or_url, per.exact_url, per.ci_url, coalesce(per.n_sub, 0) AS n_sub, per.sub_url,
         amb.names, avail.available,
         CASE WHEN req.keyword_or_url IS NULL OR req.keyword_or_url = '' THEN 'empty'
              WHEN {X.is_url('req.keyword_or_url')} THEN 'url'
              WHEN per.exact_url IS NOT NULL THEN 'exact'
              WHEN per.ci_url IS NOT NULL THEN 'case_insensitive'
              WHEN coalesce(per.n_sub, 0) = 1 THEN 'substring'
              WHEN coalesce(per.n_sub, 0) > 1 THEN 'ambiguous'
              ELSE 'not_found' END AS tier
  FROM req LEFT JOIN per USING (req_id) LEFT JOIN amb USING (req_id) CROSS JOIN avail)
SELECT req_id, keyword_or_url, tier,
       CASE tier WHEN 'url' THEN keyword_or_url WHEN 'exact' THEN exact_url WHEN 'case_insensitive' THEN ci_url
                 WHEN 'substring' THEN sub_url END AS url,
       CASE tier WHEN 'empty' THEN 'keyword_or_url cannot be empty'
                 WHEN 'ambiguous' THEN 'Keyword ''' || keyword_or_url || ''' matches multiple APIs: ' || names
                      || '. Please be more specific.'
                 WHEN 'not_found' THEN 'Keyword ''' || keyword_or_url
                      || ''' not found in URL config. Available keywords: ' || coalesce(available, '')
       END AS error
FROM t"""

INFER_DOC_TYPE = f"""WITH {HOSTS},
m AS (SELECT s.page_id AS seed_id, arg_min(r.keyword, r.pos) AS kw
      FROM pg s JOIN reg r ON instr(s.url, r.url) > 0 OR instr(r.url, s.url) > 0 GROUP BY s.page_id)
SELECT pg.page_id AS seed_id, pg.url AS start_url, coalesce(m.kw, {X.host_slug('pg.url')}) AS doc_type,
       CASE WHEN m.kw IS NOT NULL THEN 'registry' ELSE 'host' END AS source
FROM pg LEFT JOIN m ON m.seed_id = pg.page_id"""

STORES = """
stores AS (
  SELECT o_orderpriority AS doc_type, o_orderkey AS pos, 'stores/' || o_orderkey AS rag_id,
         CASE WHEN o_orderkey % 20 = 0 THEN NULL
              WHEN o_orderkey % 20 = 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')
              WHEN o_orderkey % 20 = 2 THEN '7th of May'
              ELSE strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') END AS created_at,
         'customer ' || o_custkey AS description, o_orderstatus
  FROM orders)"""

LATEST = """
latest AS (
  SELECT doc_type, rag_id, coalesce(created_at, '') AS created_at
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_type ORDER BY coalesce(created_at, '') DESC, pos) AS rn
        FROM stores) WHERE rn = 1)"""

LATEST_STORE = f"WITH {STORES}, {LATEST} SELECT * FROM latest"

STORE_COUNTS = f"WITH {STORES} SELECT doc_type, count(*) AS n_stores FROM stores GROUP BY ROLLUP (doc_type)"

EXPIRED = f"""
expired AS (
  SELECT doc_type, pos, rag_id, created_at, age_days FROM (
    SELECT *, CAST(floor((epoch(strptime({X.lit(D.NOW)}, '%Y/%m/%d %H:%M:%S'))
                          - epoch(try_strptime(created_at, '%Y/%m/%d %H:%M:%S'))) / 86400) AS BIGINT) AS age_days
    FROM stores WHERE created_at IS NOT NULL AND created_at <> '')
  WHERE age_days IS NOT NULL AND age_days > {D.MAX_AGE_DAYS})"""

EXPIRED_STORES = f"WITH {STORES}, {EXPIRED} SELECT * FROM expired"

REPORT = """
outcomes AS (SELECT 'stores/' || o_orderkey AS rag_id, NOT (o_orderkey % 7 = 3) AS ok,
                    CASE WHEN o_orderkey % 7 = 3 THEN 'Permission denied' END AS error FROM orders),
report AS (
  SELECT e.doc_type, e.pos, e.rag_id, e.created_at, e.age_days, coalesce(o.ok, true) AS deleted,
         CASE WHEN NOT coalesce(o.ok, true) THEN o.error END AS error
  FROM expired e LEFT JOIN outcomes o ON o.rag_id = e.rag_id)"""

RETENTION_REPORT = f"WITH {STORES}, {EXPIRED}, {REPORT} SELECT * FROM report"

RETENTION_SUMMARY = f"""WITH {STORES}, {EXPIRED}, {REPORT}
SELECT doc_type, count(*) FILTER (WHERE deleted) AS deleted_count, count(*) FILTER (WHERE NOT deleted) AS error_count,
       max(age_days) AS max_age_days
FROM report GROUP BY doc_type"""

RETENTION_TOTALS = f"""WITH {STORES}, {EXPIRED}, {REPORT}
SELECT doc_type, count(*) AS expired_count, count(*) FILTER (WHERE deleted) AS deleted_count, count(*) FILTER (WHERE NOT deleted) AS error_count,
       min(error) AS first_error
FROM report GROUP BY ROLLUP (doc_type)"""

REGISTRY_AFTER_RETENTION = f"""WITH {STORES}, {EXPIRED}, {REPORT}
SELECT s.doc_type, s.pos, s.rag_id, s.created_at FROM stores s
WHERE NOT EXISTS (SELECT 1 FROM report r WHERE r.deleted AND r.doc_type = s.doc_type AND r.rag_id = s.rag_id)"""

UNREGISTER_STORES = f"""WITH {STORES}
SELECT s.doc_type, s.pos, s.rag_id, s.created_at FROM stores s
WHERE NOT EXISTS (SELECT 1 FROM stores r WHERE r.o_orderstatus = 'F' AND r.doc_type = s.doc_type
                  AND r.rag_id = s.rag_id)"""

_EXT_CASE = _case_list(D.FILE_EXTENSIONS, "doc_id % 10", "''")
_SUPPORTED = ", ".join(X.lit(e) for e in V.SUPPORTED_EXTENSIONS)
_TEXT_EXT = ", ".join(X.lit(e) for e in V.TEXT_EXTENSIONS)

FILES = f"""
req AS (SELECT source AS batch_id, doc_id AS pos, '/corpus/' || source || '/doc' || doc_id || {_EXT_CASE} AS file_path
        FROM documents),
lst AS (SELECT r.file_path AS path, d.n_chars * {D.BYTES_PER_CHAR} AS length, instr(d.text, chr(65533)) = 0 AS utf8_ok
        FROM documents d JOIN req r ON r.pos = d.doc_id
        WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND l.doc_id = d.doc_id)),
v0 AS (SELECT req.*, lst.path AS _path, lst.length AS _len, lst.utf8_ok AS _utf8, {X.file_ext('req.file_path')} AS ext
       FROM req LEFT JOIN lst ON req.file_path = lst.path),
v1 AS (SELECT *, CASE WHEN _path IS NULL THEN 'File not found: ' || file_path
                      WHEN ext NOT IN ({_SUPPORTED})
                        THEN 'Unsupported file extension: ' || ext || '. Supported: {", ".join(V.SUPPORTED_EXTENSIONS)}'
                      WHEN _len > {V.MAX_FILE_BYTES}
                        THEN printf('File too large: %.2fMB. Maximum: {V.MAX_FILE_LABEL}', _len / 1024.0 / 1024.0)
                      WHEN ext IN ({_TEXT_EXT}) AND NOT coalesce(_utf8, true)
                        THEN 'Failed to read file encoding: ' || file_path END AS error
       FROM v0),
validated AS (
  SELECT batch_id, pos, file_path, error IS NULL AS valid, error,
         CAST(CASE WHEN _path IS NOT NULL AND ext IN ({_SUPPORTED}) THEN _len ELSE 0 END AS BIGINT) AS size,
         CASE WHEN _path IS NOT NULL THEN ext ELSE '' END AS extension
  FROM v1),
le AS (SELECT DISTINCT r.batch_id, r.file_path FROM req r JOIN labels l ON l.doc_id = r.pos WHERE l.quality = 0)"""

FILE_VALIDATION = f"WITH {FILES} SELECT * FROM validated"

_STORE_ID = "'stores/' || substr(sha256(CAST({b} AS VARCHAR)), 1, 16)"

LOAD_OUTCOME = f"""WITH {FILES},
v2 AS (SELECT v.*, le.file_path IS NOT NULL AS load_failed
       FROM validated v LEFT JOIN le ON le.batch_id = v.batch_id AND le.file_path = v.file_path),
agg AS (
  SELECT batch_id, count(*) AS n_files, count(*) FILTER (WHERE valid) AS n_valid,
         count(*) FILTER (WHERE NOT valid) AS n_invalid, count(*) FILTER (WHERE valid AND NOT load_failed) AS n_loaded,
         count(*) FILTER (WHERE valid AND load_failed) AS n_load_failed,
         CAST(coalesce(sum(size) FILTER (WHERE valid AND NOT load_failed), 0) AS BIGINT) AS loaded_bytes,
         arg_min({X.file_stem('file_path')}, pos) FILTER (WHERE valid) AS first_stem
  FROM v2 GROUP BY batch_id),
errs AS (
  SELECT batch_id, string_agg(error, {NL} ORDER BY pos) FILTER (WHERE NOT valid) AS invalid_errors,
         string_agg(file_path || ': no room left in the store', {NL} ORDER BY pos) FILTER (WHERE valid AND load_failed) AS load_errors
  FROM v2 GROUP BY batch_id)
SELECT batch_id, CASE WHEN n_loaded > 0 THEN {_STORE_ID.format(b='batch_id')} END AS store_id,
       first_stem AS doc_type, n_files, n_valid, n_invalid, n_loaded, n_load_failed, loaded_bytes,
       n_loaded > 0 AS success,
       CASE WHEN n_valid = 0 THEN 'No valid files to upload:' || {NL} || coalesce(invalid_errors, '')
            WHEN n_loaded = 0 THEN 'All file uploads failed:' || {NL} || coalesce(load_errors, '') END AS error,
       'Multiple files upload: ' || n_loaded || ' files' AS description
FROM agg LEFT JOIN errs USING (batch_id)"""

FILE_OUTCOMES = f"""WITH {FILES}
SELECT v.batch_id, v.pos, v.file_path,
       CASE WHEN NOT v.valid THEN 'invalid' WHEN le.file_path IS NOT NULL THEN 'failed' ELSE 'uploaded' END AS outcome,
       CASE WHEN NOT v.valid THEN v.error WHEN le.file_path IS NOT NULL THEN 'no room left in the store' END AS error
FROM validated v LEFT JOIN le ON le.batch_id = v.batch_id AND le.file_path = v.file_path"""

STORE_DOCUMENTS = f"""SELECT {_STORE_ID.format(b='batch_id')} AS store_id, batch_id, pos, file_path
FROM ({FILE_OUTCOMES}) WHERE outcome = 'uploaded'"""

FILE_COUNTS = f"""WITH {FILES}
SELECT {X.file_ext('path')} AS extension, count(*) AS file_count, CAST(sum(length) AS BIGINT) AS total_size FROM lst GROUP BY 1"""

REGISTERED_LATEST = f"""
SELECT substr(batch_id, 1, 4) AS doc_type, arg_min(store_id, (length(batch_id) % 2, batch_id)) AS rag_id, {X.lit(D.CRAWLED_AT)} AS created_at
FROM ({LOAD_OUTCOME}) WHERE success GROUP BY 1"""

STORES_OF_TYPE = f"""WITH {STORES} SELECT doc_type, pos, rag_id, created_at, description FROM stores WHERE doc_type = {X.lit(D.PRIORITY_DOC_TYPES[0])}"""

ORDERED_ENTRIES = f"WITH {STORES} SELECT doc_type, pos, rag_id, created_at, description FROM stores"

REGISTRY_TIMES = """
SELECT o_orderkey, strftime(CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) + INTERVAL 9 HOUR, '%Y/%m/%d %H:%M:%S') AS registry_time
FROM orders"""

LOAD_STORE = f"""WITH {FILES},
j AS (SELECT r.*, p.path AS _path FROM req r LEFT JOIN (SELECT DISTINCT path FROM lst) p ON p.path = r.file_path),
agg AS (SELECT batch_id, batch_id AS doc_type, count(file_path) AS n_files,
               count(*) FILTER (WHERE _path IS NULL AND file_path IS NOT NULL) AS n_missing,
               arg_min(file_path, pos) FILTER (WHERE _path IS NULL) AS first_missing
        FROM j GROUP BY batch_id)
SELECT batch_id, doc_type,
       CASE WHEN n_files > 0 AND n_missing = 0 THEN {_STORE_ID.format(b='batch_id')} END AS store_id,
       n_files, n_files > 0 AND n_missing = 0 AS success,
       CASE WHEN n_files = 0 THEN 'file list is empty'
            WHEN NOT (n_files > 0 AND n_missing = 0) THEN 'File not found: ' || first_missing END AS error,
       doc_type || ' API Documentation' AS description
FROM agg"""

_FILE_STORE = "'stores/' || substr(sha256(batch_id || '|' || file_path), 1, 16)"

COMMITTED_LOADS = f"""WITH whole AS ({LOAD_STORE}), partial AS ({LOAD_OUTCOME}), checked AS ({FILE_VALIDATION}),
files AS (SELECT source AS batch_id, '/corpus/' || source || '/doc' || doc_id || {_EXT_CASE} AS file_path FROM documents),
stores AS (
  SELECT doc_type, {_STORE_ID.format(b="'whole|' || batch_id")} AS rag_id, 1 AS n, 'whole' AS load FROM whole WHERE success
  UNION ALL SELECT {X.file_stem('file_path')}, {_FILE_STORE}, 2, 'single' FROM checked WHERE valid
  UNION ALL SELECT doc_type, store_id, 3, 'partial' FROM partial WHERE success),
docs AS (
  SELECT {_STORE_ID.format(b="'whole|' || batch_id")} AS store_id, f.file_path FROM whole w JOIN files f USING (batch_id) WHERE w.success
  UNION ALL SELECT {_FILE_STORE}, file_path FROM checked WHERE valid
  UNION ALL SELECT store_id, file_path FROM ({STORE_DOCUMENTS})),
newest AS (SELECT * FROM stores WHERE doc_type <> '' QUALIFY row_number() OVER (PARTITION BY doc_type ORDER BY n DESC, rag_id) = 1)
SELECT doc_type, rag_id, {_case_list(D.LOAD_TIMES, 'n - 1')} AS created_at, load, file_path FROM newest JOIN docs ON docs.store_id = rag_id"""

_BODIES = """(SELECT coalesce(source, 'none') AS doc_type, encode(coalesce(text, '')) || CASE WHEN doc_id % 9 = 0 THEN '\\xC3\\x28'::BLOB ELSE ''::BLOB END
  || '\\x0A'::BLOB AS body, doc_id % 9 <> 0 AS utf8_ok FROM documents)"""

CORPUS_FILES = f"SELECT doc_type, CAST(octet_length(body) AS BIGINT) AS size, utf8_ok, sha256(body) AS sha256 FROM {_BODIES}"

UPLOAD_INPUTS = """SELECT coalesce(source, 'none') AS doc_type, count(*) AS n_files, count(*) AS n_pos, CAST(NULL AS VARCHAR) AS error FROM documents GROUP BY 1
UNION ALL SELECT 'missing', 0, 0, 'No crawled files found for doc_type ''missing''. Crawl first.'"""

STORE_STATS = f"""WITH {FILES},
docs AS (SELECT {_STORE_ID.format(b='v.batch_id')} AS store_id,
                CASE WHEN le.file_path IS NULL THEN 'active' ELSE 'failed' END AS state, v.size
         FROM validated v LEFT JOIN (SELECT DISTINCT file_path FROM le) le ON le.file_path = v.file_path
         WHERE v.valid)
SELECT store_id, count(*) FILTER (WHERE state = 'active') AS active_documents,
       count(*) FILTER (WHERE state = 'pending') AS pending_documents,
       count(*) FILTER (WHERE state = 'failed') AS failed_documents,
       CAST(coalesce(sum(size) FILTER (WHERE state = 'active'), 0) AS BIGINT) AS size_bytes
FROM docs GROUP BY store_id"""

FETCHES = f"""
f0 AS (SELECT event_id, user_id, 'https://site' || user_id || '.example.com/e/' || event_id AS url,
              {_case_list(D.FETCH_STATUSES, 'event_id % 11')} AS status,
              CASE WHEN event_type = 'error' AND value >= 100 THEN 'timeout'
                   WHEN event_type = 'error' THEN 'network' END AS kind
       FROM events),
fo AS (SELECT event_id, user_id, status,
              CASE WHEN kind = 'timeout' THEN 'Timeout while fetching ' || url
                   WHEN kind = 'network' THEN 'Network error while fetching ' || url || ': connection failed'
                   WHEN status = 200 THEN NULL
                   WHEN status = 404 THEN 'Page not found (404): ' || url
                   WHEN status = 403 THEN 'Access forbidden (403): ' || url
                   WHEN status = 429 THEN 'Rate limit exceeded (429): ' || url
                   WHEN status >= 500 THEN 'Server error (' || status || '): ' || url
                   ELSE 'HTTP error (' || status || '): ' || url END AS error
       FROM f0)"""

FETCH_OUTCOMES = f"WITH {FETCHES} SELECT event_id, user_id, status, error IS NULL AS ok, error FROM fo"

RUN_STATS_COLS = """count(*) AS total_apis, count(*) FILTER (WHERE success) AS successful_apis,
       count(*) FILTER (WHERE NOT success) AS failed_apis, count(*) FILTER (WHERE success) AS file_count,
       CAST(coalesce(sum(page_count), 0) AS BIGINT) AS total_pages"""

FETCH_RUN_STATS = f"""WITH {FETCHES},
runs AS (SELECT user_id AS doc_type, count(*) FILTER (WHERE error IS NULL) AS page_count,
                count(*) FILTER (WHERE error IS NULL) > 0 AS success
         FROM fo GROUP BY user_id)
SELECT {RUN_STATS_COLS} FROM runs"""

GRAPH = """
lines AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part FROM lineitem GROUP BY l_orderkey, l_linenumber),
edges AS (SELECT DISTINCT a.part AS src, b.part AS dst
          FROM lines a JOIN lines b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber - 1 = a.l_linenumber)"""


def _walk(seeds_sql: str, depth: int = 3, keep: str = "true") -> str:
    return f"""
seeds AS ({seeds_sql}),
walk(seed, node, depth) AS (
  SELECT seed, node, 0 FROM seeds
  UNION
  SELECT w.seed, e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < {depth} AND {keep}),
reached AS (SELECT seed, node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY seed, node)"""


CRAWL_BFS = f"""WITH RECURSIVE {GRAPH},
{_walk("SELECT 'seed' AS seed, l_partkey AS node FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 1")}
SELECT seed, node, depth FROM reached"""

BRANDS = "SELECT p_brand AS seed, min(p_partkey) AS node FROM part GROUP BY p_brand"

CRAWL_REGISTRY = f"""WITH RECURSIVE {GRAPH}, {_walk(BRANDS)}
SELECT seed AS doc_type, node, depth FROM reached"""

CRAWL_SCOPED = f"""WITH RECURSIVE {GRAPH}, starts AS ({BRANDS}),
{_walk(BRANDS, 4, "e.dst % 4 = (SELECT s.node % 4 FROM starts s WHERE s.seed = w.seed)")}
SELECT seed AS doc_type, 's' || (node % 4) || '/' || node AS url, depth FROM reached"""

CRAWL_RUN_ERRORS = """SELECT 'gone ' || p_brand AS doc_type, 'No pages crawled for gone ' || p_brand AS error FROM part GROUP BY p_brand"""

SCAN_RENDERS = f"""SELECT CASE WHEN page_id % 5 IN (0, 2) THEN url || '#done' ELSE url END AS url, CASE WHEN page_id % 5 = 4 THEN 503 ELSE 200 END AS status,
  page_id % 5 < 3 AS success, CASE WHEN page_id % 5 < 2 THEN 'rendered ' || page_id ELSE '' END AS markdown,
  CASE WHEN page_id % 5 < 2 THEN {X.lit(D.CRAWLED_AT)} ELSE '' END AS timestamp,
  CASE page_id % 5 WHEN 3 THEN 'no browser' WHEN 4 THEN 'Unknown error' END AS error
FROM pages"""

CRAWL_RUN_STATS = f"""WITH RECURSIVE {GRAPH}, {_walk(BRANDS)},
per AS (SELECT seed AS doc_type, count(*) AS page_count, max(depth) AS max_depth_reached FROM reached GROUP BY seed)
SELECT s.seed AS doc_type, CAST(coalesce(per.page_count, 0) AS BIGINT) AS page_count, per.max_depth_reached,
       coalesce(per.page_count, 0) > 0 AS success
FROM seeds s LEFT JOIN per ON per.doc_type = s.seed"""

# Every host's entry starts at its first page, and no entry's address is part of another's.
CRAWL_TO_BUNDLES = f"""WITH RECURSIVE {_features_sql('pages')},
kinds AS (SELECT p.page_id, p.url, p.html, f.is_dynamic AND p.page_id % 3 = 0 AS rendered FROM pages p JOIN feat f USING (page_id)),
as_html AS (SELECT page_id, url, html FROM kinds WHERE url NOT IN (SELECT url FROM kinds WHERE rendered)),
edges AS ({_links_sql('site', 'as_html')}),
{_walk(f"SELECT {X.url_netloc('url')} AS seed, arg_min(url, page_id) AS node FROM pages GROUP BY 1")},
firsts AS (SELECT url, min(page_id) AS page_id FROM kinds GROUP BY url),
per AS (
  SELECT seed, count(f.page_id) AS page_count, count(*) FILTER (WHERE f.page_id IS NULL) AS failed_urls,
         count(*) FILTER (WHERE NOT k.rendered AND {X.visible_text('k.html')} = '') AS empty_pages,
         max(depth) FILTER (WHERE f.page_id IS NOT NULL) AS max_depth_reached
  FROM reached r LEFT JOIN firsts f ON f.url = r.node LEFT JOIN kinds k ON k.page_id = f.page_id GROUP BY seed)
SELECT seed AS doc_type, page_count, failed_urls, empty_pages, max_depth_reached, page_count > 0 AS success, page_count AS bundle_pages FROM per"""

RENDER_FALLBACK = f"""WITH {MARKED_PAGES}, {_features_sql('marked')},
rnd AS (
  SELECT url, CASE WHEN page_id % 3 = 0 THEN 200 WHEN page_id % 3 = 1
                   THEN {_case_list(D.RENDER_FAIL_STATUSES, 'page_id % 4')} ELSE 504 END AS status,
         page_id % 3 = 0 AS success, CASE WHEN page_id % 3 = 0 THEN '# rendered ' || url END AS markdown,
         CASE WHEN page_id % 3 = 1 THEN 'Navigation timeout' END AS error
  FROM pages),
ro AS (
  SELECT url, CASE WHEN status = 429 THEN 'Render rate limit exceeded'
                   WHEN status IN (401, 403) THEN 'Render authentication failed (' || status || ')'
                   WHEN status = 200 AND coalesce(success, false) THEN NULL
                   ELSE coalesce(error, 'Unknown error') END AS err, markdown
  FROM rnd),
j AS (
  SELECT m.page_id, m.url, m.html, f.is_dynamic, ro.url AS r_url, ro.err, ro.markdown
  FROM marked m JOIN feat f ON f.page_id = m.page_id LEFT JOIN ro ON f.is_dynamic AND ro.url = m.url)
SELECT page_id, url, is_dynamic,
       CASE WHEN NOT is_dynamic THEN 'not_needed' WHEN r_url IS NULL THEN 'missing'
            WHEN err IS NULL THEN 'rendered' ELSE 'fallback' END AS render_state,
       CASE WHEN is_dynamic AND r_url IS NOT NULL AND err IS NULL THEN 'markdown' ELSE 'html' END AS content_kind,
       CAST(length(CASE WHEN is_dynamic AND r_url IS NOT NULL AND err IS NULL THEN coalesce(markdown, '')
                        ELSE html END) AS BIGINT) AS content_len,
       err AS render_error
FROM j"""

DOC_PAGES = f"""
dp AS (SELECT {X.host_slug('url')} AS doc_type, page_id AS ord, url, {X.visible_text('html')} AS text FROM pages)"""

BUNDLE_BLOCKS = f"""WITH {DOC_PAGES},
f AS (SELECT doc_type, min(ord) AS first_ord FROM dp GROUP BY doc_type)
SELECT dp.doc_type, dp.ord, dp.url, dp.ord = f.first_ord AS is_first,
       CASE WHEN dp.ord = f.first_ord THEN '---' || {NL} || 'doc_type: ' || dp.doc_type || {NL} || 'crawled_at: '
            || {X.lit(D.CRAWLED_AT)} || {NL} || 'first_url: ' || dp.url || {NL} || '---' || {NL} || {NL} ELSE '' END
       || '# Page: ' || dp.url || {NL} || {NL} || dp.text || {NL} || {NL} || repeat('=', 80) || {NL} || {NL} AS block
FROM dp JOIN f USING (doc_type)"""

BUNDLE_ROUNDTRIP = f"""WITH {DOC_PAGES}
SELECT doc_type, row_number() OVER (PARTITION BY doc_type ORDER BY ord, url) - 1 AS page_no, url, text, {X.lit(D.CRAWLED_AT)} AS crawled_at,
       first_value(url) OVER (PARTITION BY doc_type ORDER BY ord, url) AS first_url
FROM dp"""

PAGES_PER_DOC_TYPE = f"""WITH {DOC_PAGES}
SELECT doc_type, count(*) AS page_count, count(*) FILTER (WHERE text = '') AS empty_pages FROM dp GROUP BY doc_type"""

_WS = Q.WORD_WS
CHUNKS = f"""
cw AS (SELECT doc_id, string_split_regex(regexp_replace(text, {X.lit('^' + _WS + '|' + _WS + '$')}, '', 'g'),
                                         {X.lit(_WS)}) AS w FROM documents),
cs AS (SELECT doc_id, w, len(w) AS n, unnest(generate_series(0, greatest(len(w) - 1, 0), 150)) AS s FROM cw),
chunks AS (
  SELECT doc_id, CAST(s // 150 AS INTEGER) AS chunk_no, CAST(s AS INTEGER) AS start_word,
         CAST(least(200, n - s) AS INTEGER) AS n_words, array_to_string(list_slice(w, s + 1, s + 200), ' ') AS text
  FROM cs WHERE (s = 0 OR s + 50 < n) AND array_to_string(list_slice(w, s + 1, s + 200), ' ') <> '')"""

CHUNK_DOCUMENTS = f"WITH {CHUNKS} SELECT * FROM chunks"

_TOK = X.lit(Q.TOKEN)
_K1, _B = Q.BM25_K1, Q.BM25_B
RETRIEVE_LEXICAL = f"""WITH {CHUNKS},
ct AS (SELECT doc_id, chunk_no, regexp_extract_all(lower(text), {_TOK}) AS toks FROM chunks),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(len(toks)) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avgdl FROM ct),
qt AS (SELECT DISTINCT prompt_id, term FROM (
         SELECT item_id AS prompt_id, unnest(regexp_extract_all(lower(text), {_TOK})) AS term FROM benchmark)),
tf AS (SELECT doc_id, chunk_no, dl, term, count(*) AS tf
       FROM (SELECT doc_id, chunk_no, len(toks) AS dl, unnest(toks) AS term FROM ct)
       WHERE term IN (SELECT term FROM qt) GROUP BY doc_id, chunk_no, dl, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (
  SELECT qt.prompt_id, tf.doc_id, tf.chunk_no,
         round(sum(ln({X.dbl(1.0)} + (st.n - df.df + {X.dbl(0.5)}) / (df.df + {X.dbl(0.5)})) * tf.tf * {X.dbl(_K1 + 1)}
                   / (tf.tf + {X.dbl(_K1)} * ({X.dbl(1 - _B)} + {X.dbl(_B)} * tf.dl / st.avgdl))), {Q.SCORE_DIGITS}) AS score
  FROM qt JOIN df ON df.term = qt.term JOIN tf ON tf.term = qt.term CROSS JOIN st
  GROUP BY qt.prompt_id, tf.doc_id, tf.chunk_no)
SELECT prompt_id, CAST(rank AS INTEGER) AS rank, doc_id, chunk_no, score FROM (
  SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, doc_id, chunk_no) AS rank FROM sc)
WHERE rank <= 5"""

RETRIEVE_VECTOR = f"""WITH
ev AS (SELECT vec_id, label, unnest(generate_series(1, len(embedding))) AS i, unnest(embedding) AS x FROM embeddings),
c AS (SELECT label AS qid, i, avg(CAST(x AS DOUBLE)) AS m FROM ev GROUP BY label, i),
qn AS (SELECT qid, sqrt(sum(m * m)) AS nq FROM c GROUP BY qid),
vn AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS nv FROM ev GROUP BY vec_id),
dot AS (SELECT c.qid, ev.vec_id, sum(c.m * CAST(ev.x AS DOUBLE)) AS d FROM c JOIN ev ON ev.i = c.i
        GROUP BY c.qid, ev.vec_id),
sc AS (SELECT dot.qid, dot.vec_id,
              round(CASE WHEN qn.nq = 0 OR vn.nv = 0 THEN 0.0 ELSE dot.d / (qn.nq * vn.nv) END, {Q.SCORE_DIGITS}) AS score
       FROM dot JOIN qn USING (qid) JOIN vn USING (vec_id))
SELECT CAST(qid AS BIGINT) AS qid, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM sc) WHERE rank <= 5"""

_DT_CASE = _case_list(D.PRIORITY_DOC_TYPES, "conv_id % 6")
ASSEMBLE_CONTEXT = f"""WITH {STORES}, {LATEST},
prompts AS (SELECT conv_id * 1000 + turn AS prompt_id, text AS prompt, {_DT_CASE} AS doc_type
            FROM conversations WHERE role = 'user'),
j AS (SELECT p.prompt_id, p.doc_type, l.rag_id AS store_id,
             CASE WHEN coalesce(p.prompt, '') = '' THEN 'prompt is required'
                  WHEN coalesce(p.doc_type, '') = '' THEN 'doc_type is required'
                  WHEN l.rag_id IS NULL THEN 'No store found for doc_type ''' || p.doc_type
                       || '''. Run upload_documents first.' END AS err
      FROM prompts p LEFT JOIN latest l ON l.doc_type = p.doc_type)
SELECT prompt_id, doc_type, CASE WHEN err IS NULL THEN store_id END AS store_id, err IS NULL AS success, err AS error
FROM j"""

_STORE_DT = _case_list(D.PRIORITY_DOC_TYPES[:5], "doc_id % 5")
ANSWER_PROMPTS = f"""WITH {CHUNKS},
answers AS ({ASSEMBLE_CONTEXT}),
sl AS (SELECT DISTINCT doc_type, rag_id FROM (WITH {STORES}, {LATEST} SELECT * FROM latest)),
sd AS (SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN 'stores/old' ELSE sl.rag_id END AS store_id
       FROM (SELECT doc_id, {_STORE_DT} AS doc_type FROM documents) d JOIN sl ON sl.doc_type = d.doc_type),
ct AS (SELECT sd.store_id, c.doc_id, c.chunk_no, regexp_extract_all(lower(c.text), {_TOK}) AS toks FROM chunks c JOIN sd ON sd.doc_id = c.doc_id),
st AS (SELECT store_id, CAST(count(*) AS DOUBLE) AS n, avg(len(toks)) AS avgdl FROM ct GROUP BY store_id),
qt AS (SELECT DISTINCT a.prompt_id, a.store_id, t.term FROM answers a
       JOIN (SELECT conv_id * 1000 + turn AS prompt_id, unnest(regexp_extract_all(lower(text), {_TOK})) AS term
             FROM conversations WHERE role = 'user') t ON t.prompt_id = a.prompt_id WHERE a.success),
tf AS (SELECT store_id, doc_id, chunk_no, dl, term, count(*) AS tf
       FROM (SELECT store_id, doc_id, chunk_no, len(toks) AS dl, unnest(toks) AS term FROM ct)
       WHERE (store_id, term) IN (SELECT (store_id, term) FROM qt) GROUP BY ALL),
df AS (SELECT store_id, term, count(*) AS df FROM tf GROUP BY store_id, term),
sc AS (
  SELECT qt.prompt_id, tf.doc_id, tf.chunk_no,
         round(sum(ln({X.dbl(1.0)} + (st.n - df.df + {X.dbl(0.5)}) / (df.df + {X.dbl(0.5)})) * tf.tf * {X.dbl(_K1 + 1)}
                   / (tf.tf + {X.dbl(_K1)} * ({X.dbl(1 - _B)} + {X.dbl(_B)} * tf.dl / st.avgdl))), {Q.SCORE_DIGITS}) AS score
  FROM qt JOIN df ON df.term = qt.term AND df.store_id = qt.store_id JOIN tf ON tf.term = qt.term AND tf.store_id = qt.store_id
  JOIN st ON st.store_id = qt.store_id GROUP BY qt.prompt_id, tf.doc_id, tf.chunk_no),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, doc_id, chunk_no) AS rank FROM sc) WHERE rank <= 3),
ctx AS (SELECT top.prompt_id, string_agg(c.text, {NL} || {NL} ORDER BY top.rank) AS context
        FROM top JOIN chunks c ON c.doc_id = top.doc_id AND c.chunk_no = top.chunk_no GROUP BY top.prompt_id)
SELECT a.*, ctx.context FROM answers a LEFT JOIN ctx ON ctx.prompt_id = a.prompt_id"""

MARKDOWN_TEXT = f"""WITH t AS (SELECT page_id, html, regexp_replace({X.visible_text("regexp_replace(html, '(?is)<title>.*?</title>', '', 'g')")}, '&amp$', '') AS text FROM pages),
l AS (SELECT page_id, regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS letters,
             list_transform({X.href_values('html')}, lambda v: {X.unquote_decode('v')}) AS hrefs FROM t)
SELECT page_id, md5(letters) AS letters, length(letters) AS n_letters, array_to_string(hrefs, ' ') AS links FROM l"""

ORACLE: dict[str, str] = {
    "answer_prompts": ANSWER_PROMPTS,
    "markdown_text": MARKDOWN_TEXT,
    "file_outcomes": FILE_OUTCOMES,
    "store_documents": STORE_DOCUMENTS,
    "file_counts": FILE_COUNTS,
    "registered_latest": REGISTERED_LATEST,
    "stores_of_type": STORES_OF_TYPE,
    "ordered_entries": ORDERED_ENTRIES,
    "registry_times": REGISTRY_TIMES,
    "site_render_needs": SITE_RENDER_NEEDS,
    "page_features": PAGE_FEATURES,
    "url_parts": URL_PARTS,
    "page_links": PAGE_LINKS,
    "page_links_scoped": PAGE_LINKS_SCOPED,
    "resolve_keywords": RESOLVE_KEYWORDS,
    "keyword_matches": KEYWORD_MATCHES,
    "infer_doc_type": INFER_DOC_TYPE,
    "latest_store": LATEST_STORE,
    "store_counts": STORE_COUNTS,
    "expired_stores": EXPIRED_STORES,
    "retention_report": RETENTION_REPORT,
    "retention_summary": RETENTION_SUMMARY,
    "retention_totals": RETENTION_TOTALS,
    "registry_after_retention": REGISTRY_AFTER_RETENTION,
    "unregister_stores": UNREGISTER_STORES,
    "file_validation": FILE_VALIDATION,
    "load_outcome": LOAD_OUTCOME,
    "load_store": LOAD_STORE,
    "committed_loads": COMMITTED_LOADS,
    "corpus_files": CORPUS_FILES,
    "upload_inputs": UPLOAD_INPUTS,
    "store_stats": STORE_STATS,
    "fetch_outcomes": FETCH_OUTCOMES,
    "fetch_run_stats": FETCH_RUN_STATS,
    "crawl_bfs": CRAWL_BFS,
    "crawl_registry": CRAWL_REGISTRY,
    "crawl_scoped": CRAWL_SCOPED,
    "crawl_run_errors": CRAWL_RUN_ERRORS,
    "scan_renders": SCAN_RENDERS,
    "crawl_to_bundles": CRAWL_TO_BUNDLES,
    "crawl_run_stats": CRAWL_RUN_STATS,
    "render_fallback": RENDER_FALLBACK,
    "bundle_blocks": BUNDLE_BLOCKS,
    "bundle_roundtrip": BUNDLE_ROUNDTRIP,
    "pages_per_doc_type": PAGES_PER_DOC_TYPE,
    "chunk_documents": CHUNK_DOCUMENTS,
    "retrieve_lexical": RETRIEVE_LEXICAL,
    "retrieve_vector": RETRIEVE_VECTOR,
    "assemble_context": ASSEMBLE_CONTEXT,
    "stream_page_features": STREAM_PAGE_FEATURES,
    "stream_recrawl": STREAM_RECRAWL,
}
