"""DuckDB SQL for the registered queries, written apart from the Spark code."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_AS_OF = "2025-01-01T00:00:00.000000+00:00"
_LATER = "2025-02-01T00:00:00.000000+00:00"


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


# --- chunks -------------------------------------------------------------------------------


def _cut(name: str, source: str, key: str, size: int) -> str:
    """CTEs that cut ``source(key, text)`` into ``name(key, chunk_number, content)``."""
    least = size * 0.3
    return f"""
{name}_walk AS (
  SELECT {key}, text AS rest, -1 AS n, '' AS piece FROM {source}
  UNION ALL
  SELECT {key}, substr(rest, e + 1), n + 1, substr(rest, 1, e) FROM (
    SELECT *, CASE
        WHEN ((length(w) - length(replace(w, '```', ''))) // 3) % 2 = 1
          THEN CASE WHEN strpos(substr(rest, {size} + 1), '```') > 0
                    THEN {size} + strpos(substr(rest, {size} + 1), '```') + 2 ELSE length(rest) END
        WHEN contains(w, chr(10) || chr(10))
          THEN CASE WHEN length(w) - strpos(reverse(w), chr(10) || chr(10)) - 1 > {least}
                    THEN length(w) - strpos(reverse(w), chr(10) || chr(10)) - 1 ELSE length(w) END
        WHEN contains(w, '. ') AND length(w) - strpos(reverse(w), ' .') - 1 > {least}
          THEN length(w) - strpos(reverse(w), ' .')
        ELSE length(w) END AS e
    FROM (SELECT *, substr(rest, 1, {size}) AS w FROM {name}_walk WHERE rest <> ''))
),
{name} AS (
  SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY n) - 1 AS INTEGER) AS chunk_number, content
  FROM (SELECT {key}, n, trim(piece, {_SPACE}) AS content FROM {name}_walk WHERE n >= 0)
  WHERE content <> ''
)"""


_URL = "'https://' || source || '.example.org/' || lang || '/' || doc_id"
_DOC_CHUNKS = _cut("chunk", "(SELECT doc_id, text FROM documents)", "doc_id", 5000)
_VARIANTS = """variant AS (
  SELECT doc_id, 'plain' AS variant, text FROM documents
  UNION ALL SELECT doc_id, 'paragraphs', replace(text, chr(10), chr(10) || chr(10)) FROM documents
  UNION ALL SELECT doc_id, 'fences', replace(text, chr(10), chr(10) || '```' || chr(10)) FROM documents
)"""

for _name, _size in (("chunk_text_default", 5000), ("chunk_text_small", 1000)):
    ORACLE[_name] = (
        _with(_VARIANTS, _cut("chunk", "variant", "doc_id, variant", _size), recursive=True)
        + "SELECT doc_id, variant, chunk_number, content FROM chunk"
    )

ORACLE["document_scan"] = f"SELECT {_URL} AS url, text AS content FROM documents"

ORACLE["chunk_documents"] = (
    _with(_DOC_CHUNKS, recursive=True)
    + f"SELECT {_URL} AS url, chunk_number, content FROM chunk JOIN documents USING (doc_id)"
)

ORACLE["chunks_per_page"] = (
    _with(_DOC_CHUNKS, recursive=True)
    + f"SELECT {_URL} AS url, count(*) AS n_chunks FROM chunk JOIN documents USING (doc_id) GROUP BY ALL"
)


def _squash(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'), ' ')"


def _title(x: str) -> str:
    return _squash(rf"""coalesce(
      nullif(regexp_extract({x}, '(?m)^#{{1,6}} +(\S[^\n]*)', 1), ''),
      nullif(regexp_extract({x}, '^\s*([^\n]*?[.!?])(?:\s|$)', 1), ''),
      regexp_extract({x}, '^\s*([^\n]*)', 1))""")


def _summary(x: str) -> str:
    body = _squash(rf"regexp_replace({x}, '(?m)^#{{1,6}} [^\n]*', ' ', 'g')")
    return rf"coalesce(nullif(trim(regexp_extract({body}, '^(?:.*?[.!?](?: |$)){{1,2}}')), ''), {body})"


def _metadata(path: str, x: str, stamp: str = _AS_OF) -> str:
    file = f"trim(regexp_replace({path} || '__', '[^A-Za-z0-9_-]', '_', 'g'), '_')"
    return (
        f"""'{{"source":"pydantic_ai_docs","chunk_size":' || length({x}) || ',"crawled_at":"{stamp}","url_path":"' """
        f"""|| {path} || '","file_path":"data/docs/' || {file} || '.md"}}'"""
    )


_PATH = "'/' || lang || '/' || doc_id"

ORACLE["chunk_title_summary"] = (
    _with(_DOC_CHUNKS, recursive=True)
    + f"SELECT doc_id, chunk_number, {_title('content')} AS title, {_summary('content')} AS summary FROM chunk"
)
ORACLE["chunk_metadata"] = (
    _with(_DOC_CHUNKS, recursive=True)
    + f"SELECT doc_id, chunk_number, {_metadata(_PATH, 'content')} AS metadata"
    " FROM chunk JOIN documents USING (doc_id)"
)
ORACLE["prompt_excerpt"] = (
    _with(_DOC_CHUNKS, recursive=True)
    + f"""SELECT doc_id, chunk_number,
  'URL: ' || {_URL} || chr(10) || chr(10) || 'Content:' || chr(10) || left(content, 1000) || '...' AS request
FROM chunk JOIN documents USING (doc_id)"""
)
ORACLE["content_keys"] = (
    _with(_DOC_CHUNKS, recursive=True)
    + f"""SELECT doc_id, chunk_number, sha256({_URL}) AS capture_key,
  sha256({_URL} || ':' || content) AS title_key, sha256(content) AS vector_key,
  sha256('native:' || content) AS model_vector_key
FROM chunk JOIN documents USING (doc_id)"""
)


def _vectors(name: str, source: str, keys: str, width: int = 256) -> str:
    """Sparse unit vectors ``name(keys, place, weight)`` of hashed words of ``source(keys, content)``."""
    return rf"""
{name}_word AS (
  SELECT {keys}, md5(w) AS h FROM (
    SELECT {keys}, unnest(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+')) AS w FROM {source})
),
{name}_count AS (
  SELECT {keys}, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % {width} AS place,
    sum(CASE WHEN substr(h, 9, 1) >= '8' THEN -1 ELSE 1 END) AS n
  FROM {name}_word GROUP BY ALL
),
{name} AS (
  SELECT {keys}, CAST(place AS INTEGER) AS place,
    CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {keys})) AS FLOAT) AS DOUBLE) AS weight
  FROM {name}_count WHERE n <> 0
)"""


ORACLE["chunk_embedding"] = (
    _with(_DOC_CHUNKS, _vectors("vec", "chunk", "doc_id, chunk_number"), recursive=True)
    + "SELECT doc_id, chunk_number, place, round(weight, 6) + 0.0 AS weight FROM vec"
)

# --- memo ---------------------------------------------------------------------------------

ORACLE["memo_misses"] = """
SELECT DISTINCT sha256('native:' || text) AS memo_key, CAST(length(text) AS INTEGER) AS n_chars FROM documents
WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en')"""

ORACLE["memo_enrich"] = f"""
WITH held AS (SELECT DISTINCT text FROM documents WHERE lang = 'en'),
d AS (SELECT doc_id, d.text, held.text IS NOT NULL AS hit, contains(d.text, 'ción') AS fails
      FROM documents d LEFT JOIN held ON d.text = held.text)
SELECT doc_id, hit AS memo_hit,
  CASE WHEN hit THEN 'Stored: ' || {_title("text")} WHEN fails THEN 'Error processing title'
       ELSE {_title("text")} END AS title,
  CASE WHEN fails AND NOT hit THEN 'Error processing summary' ELSE {_summary("text")} END AS summary,
  NOT hit AND NOT fails AS added
FROM d"""

ORACLE["hook_titles"] = """
SELECT doc_id, CASE WHEN ok THEN CAST(length(text) AS VARCHAR) ELSE 'Error processing title' END AS title,
  CASE WHEN ok THEN 'done' ELSE 'Error processing summary' END AS summary, ok AS added
FROM (SELECT doc_id, text, NOT contains(text, 'ción') AND NOT contains(text, 'é') AS ok FROM documents)"""

ORACLE["hook_vectors"] = """
SELECT doc_id, CASE WHEN ok THEN CAST(length(text) AS DOUBLE) ELSE 0.0::DOUBLE END AS first,
  CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS second, ok AS added
FROM (SELECT doc_id, text, NOT contains(text, 'ción') AND NOT contains(text, 'é') AS ok FROM documents)"""

# --- replies and registry -----------------------------------------------------------------

ORACLE["reply_parse"] = f"""
WITH r AS (SELECT doc_id, json_object('title', source, 'summary', {_summary("text")}) AS j, lang FROM documents)
SELECT doc_id,
  CASE WHEN lang = 'en' THEN json_extract_string(j, '$.title') ELSE 'Error processing title' END AS title,
  CASE WHEN lang = 'en' THEN json_extract_string(j, '$.summary') ELSE 'Error processing summary' END AS summary
FROM r"""

ORACLE["reply_unfence"] = f"""
SELECT doc_id, trim(CASE
  WHEN lang = 'de' AND NOT contains(text, chr(10)) THEN text
  WHEN lang = 'de' THEN replace(text, chr(10), ' ')
  ELSE text END, {_SPACE}) AS payload
FROM documents"""

ORACLE["docs_url_resolve"] = """
SELECT source || '-' || doc_id AS package,
  CASE WHEN lang IN ('en', 'fr', 'de') THEN 'https://' || source || '.example.org/' || doc_id END AS documentation_url,
  CASE WHEN lang NOT IN ('en', 'fr', 'de')
    THEN 'No documentation URL found for ' || source || '-' || doc_id END AS error
FROM documents"""

ORACLE["registry_url"] = """
SELECT source || '-' || doc_id AS package,
  'https://pypi.org/pypi/' || source || '-' || doc_id
    || CASE WHEN lang = 'en' THEN '/1.' || doc_id ELSE '' END || '/json' AS record_url
FROM documents"""

# --- URLs and pages -----------------------------------------------------------------------

_HOST = "split_part(split_part(split_part(url, '//', 2), '/', 1), '?', 1)"
_BARE = "split_part(url, '#', 1)"
_URLPATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"

ORACLE["url_parts"] = f"""
SELECT page_id, split_part(url, '://', 1) AS scheme, {_HOST} AS netloc, {_URLPATH} AS path,
  CASE WHEN contains({_BARE}, '?') THEN split_part({_BARE}, '?', 2) ELSE '' END AS query,
  split_part(url, '#', 2) AS fragment
FROM pages"""

_FILE = f"""coalesce(nullif(trim(regexp_replace({_URLPATH} || '_' || split_part({_BARE}, '?', 2)
  || '_' || split_part(url, '#', 2), '[^\\pL\\pN_-]', '_', 'g'), '_'), ''), 'index')"""

ORACLE["url_to_filename"] = f"SELECT page_id, {_FILE} AS filename FROM pages"

ORACLE["url_to_filename_wide"] = f"""
SELECT page_id, {_FILE} AS filename FROM (SELECT page_id, url || 'café_x²½‿東-' AS url FROM pages)"""

ORACLE["url_join"] = f"""
SELECT page_id, split_part(url, '://', 1) || '://' || {_HOST} || '/robots.txt' AS robots_url FROM pages"""

_SEEN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'),
  '(?is)<script[ >].*?</script>', '', 'g'), '(?is)<style[ >].*?</style>', '', 'g'),
  '(?is)<head>.*?</head>', '', 'g')"""


def _entities(x: str) -> str:
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
        x = f"regexp_replace({x}, '&{name};?', '{char}', 'g')"
    return x


def _inline(x: str) -> str:
    return _squash(_entities(f"regexp_replace({x}, '<[^>]*>', '', 'g')"))


_BLOCKS = (
    "html|body|main|article|section|header|footer|nav|aside|form|div|p|ul|ol|dl|dt|dd|table|thead|tbody"
    "|tr|td|th|blockquote|figure|figcaption|address|h[1-6]|pre|li|hr"
)


def _text(x: str) -> str:
    for level in range(1, 7):
        x = f"regexp_replace({x}, '(?i)<h{level}(?: [^>]*)?>', chr(10) || chr(10) || '{'#' * level} ', 'g')"
    x = f"regexp_replace({x}, '(?i)<br */?>', chr(10), 'g')"
    x = f"regexp_replace({x}, '(?i)<li(?: [^>]*)?>', chr(10) || '* ', 'g')"
    x = f"regexp_replace({x}, '(?i)</li *>', '', 'g')"
    x = f"regexp_replace({x}, '(?i)</?(?:{_BLOCKS})(?: [^>]*)?>', chr(10) || chr(10), 'g')"
    x = _entities(f"regexp_replace({x}, '<[^>]*>', '', 'g')")
    x = f"regexp_replace({x}, '[ \\t\\r]+', ' ', 'g')"
    x = f"regexp_replace({x}, ' ?\\n ?', chr(10), 'g')"
    return f"trim(regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g'), {_SPACE})"


_TEXT = _text(_SEEN)
ORACLE["page_text"] = f"SELECT page_id, {_TEXT} AS content FROM pages"

_CODE = r"def f(x):\n    if x < 1:\n\treturn 0"
ORACLE["page_text_code"] = f"""
SELECT page_id, replace({_TEXT}, '@@CODE@@', '```' || chr(10) || E'{_CODE}' || chr(10) || '```') AS content
FROM (SELECT page_id, replace(html, '</h1>', '</h1><p>@@CODE@@</p>') AS html FROM pages)"""

# Markup that patterns misread is planted behind each first heading; what a reader sees of it is written here.
_ODD_TEXT = (
    "1 < 2 and 3 > 2\n\nt © B\n\nx&y &unknown; €\n\n```\nif a < b:\n    return \"<p>\"\n```\n\n* in < b\n* last"
)
ORACLE["page_text_odd"] = f"""
SELECT page_id, replace({_TEXT}, '@@ODD@@', E'{_ODD_TEXT}') AS content
FROM (SELECT page_id, replace(html, '</h1>', '</h1><p>@@ODD@@</p>') AS html FROM pages)"""

_BLOCK_TAG = f"(?i)</?(?:{_BLOCKS})(?: [^>]*)?>"
_ANCHOR = r"""(?is)<a [^>]*?href="([^"]*)"[^>]*>(.*?)</a>"""
_MAIN = _SEEN
for _part in ("nav", "header", "footer", "aside", "form"):
    _MAIN = f"regexp_replace({_MAIN}, '(?is)<{_part}[ >].*?</{_part}>', chr(10), 'g')"

ORACLE["page_text_pruned"] = f"""
WITH block AS (
  SELECT page_id, unnest(b) AS b, unnest(list_concat([''], tags)) AS tag, unnest(range(len(b))) AS i FROM (
    SELECT page_id, regexp_split_to_array(main, '{_BLOCK_TAG}') AS b, regexp_extract_all(main, '{_BLOCK_TAG}') AS tags
    FROM (SELECT page_id, {_MAIN} AS main FROM pages))
),
scored AS (
  SELECT page_id, i, {_inline("regexp_replace(b, '(?i)<br */?>', ' ', 'g')")} AS t,
    length({_inline("array_to_string(regexp_extract_all(b, '" + _ANCHOR + "', 2), ' ')")}) AS linked,
    length(tag) + length(b) - length(regexp_replace(b, '</?[A-Za-z][^>]*>', '', 'g')) AS markup,
    CASE WHEN lower(tag) SIMILAR TO '</?(p|blockquote|article|main|section|dd)[ >].*' THEN 1.0::DOUBLE
      WHEN lower(tag) SIMILAR TO '</?(h[1-6]|li|td|th|dt|figcaption)[ >].*' THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END AS weight
  FROM block
),
leveled AS (
  SELECT *, 0.5::DOUBLE * (0.5::DOUBLE + sum(length(t)) OVER page / greatest(sum(length(t) + markup) OVER page, 1)) AS threshold
  FROM scored WINDOW page AS (PARTITION BY page_id)
)
SELECT page_id, coalesce(c, '') AS content FROM pages LEFT JOIN (
  SELECT page_id, string_agg(t, chr(10) || chr(10) ORDER BY i) AS c FROM leveled
  WHERE len(string_split(t, ' ')) >= 10 AND linked <= 0.5 * length(t)
    AND 0.5::DOUBLE * length(t) / greatest(length(t) + markup, 1) + 0.3::DOUBLE * (1 - linked / greatest(length(t), 1))
        + 0.2::DOUBLE * weight >= threshold
  GROUP BY page_id) USING (page_id)"""
# What is planted into nested side parts does not show.
ORACLE["page_text_pruned_nested"] = ORACLE["page_text_pruned"]

ORACLE["page_title"] = f"""
SELECT page_id, nullif({_inline("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '') AS title
FROM pages"""

_LINKS = f"""anchor AS (
  SELECT page_id, url, unnest(h) AS href, unnest(t) AS raw, unnest(range(len(h))) AS link_pos FROM (
    SELECT page_id, url, regexp_extract_all({_SEEN}, '{_ANCHOR}', 1) AS h,
      regexp_extract_all({_SEEN}, '{_ANCHOR}', 2) AS t FROM pages)
)"""
ORACLE["page_links"] = (
    _with(_LINKS)
    + f"SELECT page_id, CAST(link_pos AS INTEGER) AS link_pos, {_entities('href')} AS href,"
    + f" {_inline('raw')} AS text FROM anchor"
)

# Anchors before the heading keep their places, those behind it move on by the three that are planted.
ORACLE["page_links_odd"] = (
    _with(_LINKS)
    + f"""SELECT a.page_id, CAST(link_pos + CASE WHEN link_pos >= before AND before < total THEN 3 ELSE 0 END AS INTEGER) AS link_pos,
  {_entities('href')} AS href, {_inline('raw')} AS text
FROM anchor a JOIN (SELECT page_id, len(regexp_extract_all(split_part({_SEEN}, '</h1>', 1), '{_ANCHOR}')) AS before,
  len(regexp_extract_all({_SEEN}, '{_ANCHOR}')) AS total FROM pages) USING (page_id)
UNION ALL
SELECT page_id, CAST(before + n AS INTEGER), href, text
FROM (SELECT page_id, len(regexp_extract_all(split_part({_SEEN}, '</h1>', 1), '{_ANCHOR}')) AS before FROM pages
      WHERE contains(html, '</h1>')),
  (VALUES (0, '/x?a=1&copy=2', 't © B'), (1, '/y', ''), (2, 'z', 'in < b')) AS planted(n, href, text)"""
)
# Some pages get metadata, by their number; the planted title in a drawing is none.
ORACLE["page_meta"] = f"""
SELECT page_id, nullif({_inline("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '') AS title,
  regexp_extract(html, '<html lang="([a-z]*)"', 1) AS language,
  CASE WHEN page_id % 3 = 1 THEN 'https://example.org/p/' || page_id || '?a=1&b=2' END AS canonical,
  CASE WHEN page_id % 3 = 0 THEN 'first > ' || page_id END AS description,
  CASE WHEN page_id % 3 = 2 THEN 'article' END AS og_type,
  CASE WHEN page_id % 3 = 0 THEN 2 WHEN page_id % 3 = 2 THEN 1 ELSE 0 END AS names
FROM pages"""

_SITE = f"split_part(url, '://', 1) || '://' || {_HOST}"
ORACLE["link_class"] = (
    _with(_LINKS)
    + f"""SELECT page_id, CAST(link_pos AS INTEGER) AS link_pos, {_SITE} || href AS target, 'internal' AS link_class
FROM anchor
UNION ALL
SELECT page_id, CAST(link_pos AS INTEGER), 'https://cdn.example.org' || href, 'external' FROM anchor"""
)
_FOLDER = f"regexp_replace({_URLPATH}, '[^/]*$', '')"
ORACLE["link_resolve"] = (
    _with(_LINKS)
    + f"""SELECT page_id, CAST(link_pos AS INTEGER) AS link_pos, CAST(form AS INTEGER) AS form, CASE form
    WHEN 0 THEN {_SITE} || href
    WHEN 1 THEN {_SITE} || {_FOLDER} || href[2:]
    WHEN 2 THEN {_SITE} || {_URLPATH} || '?q=' || href[2:]
    WHEN 3 THEN split_part(url, '://', 1) || '://cdn.example.org/' || href[2:]
    ELSE 'mailto:' || href[2:] END AS target
FROM anchor, (SELECT unnest(range(5)) AS form)"""
)

_HELD = f"""held AS (
  SELECT url, min(page_id) AS page_id, arg_min(html, page_id) AS html
  FROM (SELECT page_id, {_BARE} AS url, html FROM pages) GROUP BY url
)"""
_FINAL = "CASE WHEN ends_with(url, '?utm_source=feed') THEN replace(url, '?utm_source=feed', '') ELSE url END"

ORACLE["redirect_resolve"] = _with(_HELD) + f"SELECT page_id, url, {_FINAL} AS final_url FROM held"

ORACLE["page_capture_scan"] = (
    _with(_HELD)
    + f"""SELECT url, {_FINAL} AS final_url, {_TEXT} AS content,
  array_to_string(list_transform(regexp_extract_all({_SEEN}, '{_ANCHOR}', 1),
    lambda h: {_SITE} || h), ' ') AS links
FROM held"""
)

ORACLE["capture_lines"] = """
SELECT CASE WHEN k IN (2, 3, 4, 6) THEN url END AS url,
  CASE WHEN k = 2 THEN url || '/end' WHEN k IN (3, 4, 6) THEN url END AS final_url,
  CASE WHEN k IN (2, 4, 6) THEN CAST(length(html) AS INTEGER) END AS n_chars,
  CASE WHEN k IN (2, 3, 6) THEN 2 WHEN k = 4 THEN 0 END AS n_links,
  CASE WHEN k IN (2, 3, 6) THEN url END AS first_link,
  CASE WHEN k IN (0, 5) THEN 'broken record' WHEN k = 1 THEN 'no URL' END AS reason
FROM (SELECT *, page_id % 7 AS k FROM pages)"""

ORACLE["doc_file_sink"] = f"""
SELECT file_path, arg_max(content, page_id) AS content FROM (
  SELECT page_id, 'data/docs/' || {_FILE} || '.md' AS file_path, {_TEXT} AS content FROM pages)
GROUP BY file_path"""

# --- traversal ----------------------------------------------------------------------------

_SITES = f"""{_HELD},
site AS MATERIALIZED (
  SELECT page_id, url, host, final_url, place,
    CASE WHEN ends_with(url, '.html') AND place > 0 THEN '' ELSE title END AS content
  FROM (SELECT page_id, url, {_HOST} AS host, {_FINAL} AS final_url,
    row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) - 1 AS place,
    {_inline("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title FROM held)
),
pair AS (
  SELECT p.url AS parent_url, c.url AS child, (c.place - 1) % 3 AS link_pos
  FROM site c JOIN site p ON c.host = p.host AND p.place = (c.place - 1) // 3 WHERE c.place > 0
),
link AS MATERIALIZED (
  SELECT url, CAST(link_pos AS INTEGER) AS link_pos, href FROM (
    SELECT parent_url AS url, link_pos, child AS href FROM pair
    UNION ALL SELECT child, 3, parent_url FROM pair
    UNION ALL SELECT url, 4, '' FROM site
    UNION ALL SELECT parent_url, 5, child || '#x' FROM pair WHERE link_pos = 0
    UNION ALL SELECT url, 6, 'https://elsewhere.example/' FROM site)
)"""
_TARGET = "replace(split_part(href, '#', 1), url, final_url)"
_QUEUE = f"""queue AS (
  SELECT url, target, min(link_pos) AS link_pos
  FROM (SELECT link.url, {_TARGET.replace("url,", "link.url,", 1)} AS target, link_pos, href
        FROM link JOIN site USING (url))
  WHERE href <> '' AND target <> '' GROUP BY ALL
)"""
_QUEUE = _QUEUE.replace("link.url, final_url", "url, final_url")

ORACLE["link_normalize"] = (
    _with(_SITES) + f"SELECT url, link_pos, {_TARGET} AS target FROM link JOIN site USING (url)"
)
ORACLE["link_dedup"] = _with(_SITES, _QUEUE) + "SELECT url, target, link_pos FROM queue"
ORACLE["crawl_scope_filter"] = (
    _with(_SITES, "request AS (SELECT url AS start_url, link_pos, href AS url FROM link)")
    + f"""SELECT start_url, link_pos, url,
  CASE WHEN url IN (SELECT url FROM held) THEN {_FINAL} ELSE url END AS final_url
FROM request WHERE {_HOST} = {_HOST.replace("url", "start_url")}"""
)

_ALLOWED = """CASE
  WHEN starts_with(host, 'www.') THEN NOT starts_with(regexp_extract(url, '^[a-z]+://[^/]*(.*)', 1), '/de/')
    AND (starts_with(regexp_extract(url, '^[a-z]+://[^/]*(.*)', 1), '/fr/')
      OR NOT starts_with(regexp_extract(url, '^[a-z]+://[^/]*(.*)', 1), '/fr'))
  WHEN starts_with(host, 'm.') THEN starts_with(regexp_extract(url, '^[a-z]+://[^/]*(.*)', 1), '/en/')
  ELSE true END"""
ORACLE["robots_filter"] = _with(_SITES) + f"SELECT page_id, url, {_ALLOWED} AS allowed FROM site"

_LEVELS = 9


def _crawl(starts: str, depth: int = _LEVELS, limit: int | None = None) -> str:
    """One CTE per level; ``stored(crawl_id, url, depth)`` at the end."""
    parts = [
        _SITES,
        _QUEUE,
        f"ok AS MATERIALIZED (SELECT url, final_url, host FROM site WHERE content <> '' AND {_ALLOWED})",
        """edge AS MATERIALIZED (
  SELECT q.url, q.link_pos, t.url AS target, t.final_url AS target_final
  FROM queue q JOIN ok s ON s.url = q.url JOIN ok t ON t.url = q.target WHERE s.host = t.host
)""",
        f"start AS ({starts})",
        """level0 AS MATERIALIZED (
  SELECT crawl_id, url, final_url, CAST([] AS INTEGER[]) AS path, CAST(NULL AS VARCHAR) AS via
  FROM start JOIN ok ON start_url = url
)""",
    ]
    for i in range(depth + 1):
        before = " UNION ALL ".join(f"SELECT crawl_id, final_url FROM stored{j}" for j in range(i))
        unseen = f"WHERE (crawl_id, final_url) NOT IN ({before})" if i else ""
        pick = f"""SELECT crawl_id, final_url, min(path) AS path FROM level{i} {unseen} GROUP BY ALL"""
        if limit is not None:
            had = f"coalesce((SELECT count(*) FROM ({before}) b WHERE b.crawl_id = f.crawl_id), 0)" if i else "0"
            pick = f"""SELECT crawl_id, final_url, path FROM (
  SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY path) + {had} AS n FROM ({pick}) f) WHERE n <= {limit}"""
        parts.append(f"stored{i} AS MATERIALIZED ({pick})")
        if i == depth:
            break
        asked = " UNION ALL ".join(f"SELECT crawl_id, url FROM level{j}" for j in range(i + 1))
        kept = " UNION ALL ".join(f"SELECT crawl_id, final_url FROM stored{j}" for j in range(i + 1))
        open_ = ""
        if limit is not None:
            open_ = f"WHERE (SELECT count(*) FROM ({kept}) k WHERE k.crawl_id = l.crawl_id) < {limit}"
        parts.append(f"""found{i + 1} AS MATERIALIZED (
  SELECT l.crawl_id, e.target AS url, e.target_final AS final_url, min(list_append(l.path, e.link_pos)) AS path,
    arg_min(l.final_url, list_append(l.path, e.link_pos)) AS via
  FROM level{i} l JOIN edge e ON e.url = l.url {open_} GROUP BY ALL
)""")
        parts.append(f"""level{i + 1} AS MATERIALIZED (
  SELECT * FROM found{i + 1} f
  WHERE (crawl_id, url) NOT IN ({asked}) AND (crawl_id, url) NOT IN ({kept})
    AND NOT EXISTS (SELECT 1 FROM found{i + 1} r WHERE r.crawl_id = f.crawl_id AND r.final_url = f.url
      AND r.url <> f.url AND r.path < f.path AND (r.crawl_id, r.url) NOT IN ({asked}))
)""")
    stored = " UNION ALL ".join(
        f"SELECT crawl_id, final_url AS url, {i} AS depth FROM stored{i}" for i in range(depth + 1)
    )
    parts.append(f"stored AS ({stored})")
    return _with(*parts)


_ALL_STARTS = "SELECT page_id AS crawl_id, url AS start_url FROM site WHERE place = 0"
_ONE_START = (
    _ALL_STARTS + " AND host = (SELECT host FROM site GROUP BY host ORDER BY count(*) DESC, host LIMIT 1)"
)
_STORED = "SELECT crawl_id, url, depth FROM stored"
ORACLE["crawl_bfs"] = _crawl(_ONE_START) + _STORED
ORACLE["crawl_bfs_multi"] = _crawl(_ALL_STARTS) + _STORED
ORACLE["crawl_bfs_depth"] = _crawl(_ALL_STARTS, depth=1) + _STORED
ORACLE["crawl_bfs_limited"] = _crawl(_ALL_STARTS, limit=3) + _STORED
ORACLE["links_per_page"] = (
    _crawl(_ALL_STARTS)
    + "SELECT crawl_id, via AS url, count(*) AS new_links FROM ("
    + " UNION ALL ".join(f"SELECT * FROM level{i}" for i in range(1, _LEVELS + 1))
    + ") GROUP BY ALL"
)
ORACLE["crawl_totals"] = (
    _crawl(_ALL_STARTS) + "SELECT crawl_id, depth, count(*) AS n_pages FROM stored GROUP BY ALL"
)

ORACLE["robots_parse"] = _with(f"host AS (SELECT DISTINCT {_HOST} AS netloc FROM pages)") + """
SELECT netloc, CAST(r.n AS INTEGER) AS rule_no, '*' AS agent, r.d AS directive, r.p AS path
FROM host, (VALUES ('www', 0, 'disallow', '/a'), ('www', 1, 'allow', '/b'), ('blog', 0, 'disallow', '/p'), ('', 0, 'disallow', ''))
  AS r(kind, n, d, p)
WHERE r.kind = CASE WHEN starts_with(netloc, 'www.') THEN 'www' WHEN starts_with(netloc, 'blog.') THEN 'blog'
                    WHEN starts_with(netloc, 'm.') THEN 'm' ELSE '' END"""


def _package_pages(kind: str, obeyed: bool = True, **bounds: int) -> str:
    """``(host, url)`` of the crawls of one kind of host."""
    sql = _crawl(f"SELECT * FROM ({_ALL_STARTS.replace('AS start_url', 'AS start_url, host')}) WHERE {kind}", **bounds)
    return f"({sql if obeyed else sql.replace(' AND ' + _ALLOWED, '')} SELECT host, stored.url FROM stored JOIN start USING (crawl_id))"


_KINDS = ("starts_with(host, 'www.')", "starts_with(host, 'blog.')", "starts_with(host, 'm.')")
ORACLE["package_ingest"] = f"""
WITH {_SITES},
package AS (
  SELECT host AS tool_name, url AS tool_url, '{{"version":null,"depth":' || CASE WHEN {_KINDS[0]} THEN '"1"' ELSE 'null' END
    || ',"strategy":"bfs","ignore_robots":"' || CASE WHEN {_KINDS[2]} THEN 'true' ELSE 'false' END || '","limit":'
    || CASE WHEN {_KINDS[1]} THEN '"3"' ELSE 'null' END || ',"caching_enabled":"true"}}' AS settings
  FROM site WHERE place = 0
),
crawled AS (
  SELECT * FROM {_package_pages(_KINDS[0], depth=1)}
  UNION ALL SELECT * FROM {_package_pages(_KINDS[1], limit=3)}
  UNION ALL SELECT * FROM {_package_pages(_KINDS[2], obeyed=False)}
  UNION ALL SELECT * FROM {_package_pages("NOT " + " AND NOT ".join(_KINDS))}
),
text AS (
  SELECT final_url AS url, arg_min(content, (url <> final_url, url)) AS content FROM site WHERE content <> '' GROUP BY 1
)
SELECT tool_name, tool_url, settings, c.url, CASE WHEN c.url IS NOT NULL THEN 0 END AS chunk_number, trim(content) AS content
FROM package LEFT JOIN (crawled c JOIN text ON text.url = c.url) ON c.host = tool_name"""

def _own_bounds(kind: str, **bounds: int) -> str:
    return _package_pages(kind, **bounds).replace("SELECT host, stored.url", "SELECT crawl_id, stored.url, stored.depth")


ORACLE["package_recrawl"] = f"""
WITH {_SITES},
crawled AS (SELECT * FROM {_package_pages("true", depth=1)}),
shown AS (
  SELECT final_url AS url, arg_min('page ' || place || ' of its host', (url <> final_url, url)) AS content
  FROM site WHERE content <> '' GROUP BY 1)
SELECT host AS tool_name, c.url, CASE WHEN {_KINDS[0]} THEN 'new ' ELSE '' END || content AS content,
  NOT {_KINDS[0]} AS remembered
FROM crawled c JOIN shown USING (url)"""
ORACLE["crawl_own_bounds"] = f"""
WITH {_SITES}
SELECT * FROM {_own_bounds(_KINDS[0], depth=0)}
UNION ALL SELECT * FROM {_own_bounds(_KINDS[1], limit=0)}
UNION ALL SELECT * FROM {_own_bounds(_KINDS[2], obeyed=False)}
UNION ALL SELECT * FROM {_own_bounds("NOT " + " AND NOT ".join(_KINDS))}"""

# --- catalog and usage --------------------------------------------------------------------

_CATALOG = f"""host_page AS (SELECT DISTINCT {_HOST} AS host, {_BARE} AS url FROM pages),
tool AS (SELECT DISTINCT host FROM (
  SELECT host FROM host_page UNION ALL SELECT regexp_extract(host, '[^.]+$') FROM host_page)),
catalog AS (
  SELECT tool.host AS tool_name, 'official_package_documentation' AS source_type,
    'https://' || tool.host || '.example.org/' AS url, count(*) AS page_count
  FROM tool LEFT JOIN host_page p ON p.host = tool.host GROUP BY ALL
)"""
ORACLE["tool_catalog"] = _with(_CATALOG) + "SELECT tool_name, source_type, url, page_count FROM catalog"
ORACLE["tool_catalog_line"] = (
    _with(_CATALOG)
    + """SELECT 'Available tools: ' || string_agg(
  tool_name || ' (' || source_type || ', ' || page_count || ' pages from ' || url || ')', ', '
  ORDER BY page_count DESC, tool_name) AS line FROM catalog"""
)

_USAGE = """usage AS (
  SELECT CASE WHEN event_type IN ('click', 'view') THEN 'completion' ELSE 'embedding' END AS kind,
    value / 1000 AS cost, user_id AS tokens FROM events
)"""
ORACLE["usage_totals"] = (
    _with(_USAGE)
    + """SELECT coalesce(kind, 'total') AS kind, round(sum(cost), 6) + 0.0 AS cost, CAST(sum(tokens) AS BIGINT) AS tokens
FROM usage GROUP BY ROLLUP (kind)"""
)
ORACLE["usage_priced"] = """
WITH priced AS (
  SELECT CASE WHEN event_type IN ('click', 'view') THEN 'completion' ELSE 'embedding' END AS kind, user_id AS tokens,
    user_id * CASE event_type WHEN 'click' THEN 0.25::DOUBLE WHEN 'view' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS cost
  FROM events)
SELECT coalesce(kind, 'total') AS kind, round(sum(cost), 6) + 0.0 AS cost, CAST(sum(tokens) AS BIGINT) AS tokens
FROM priced GROUP BY ROLLUP (kind)"""
ORACLE["usage_summary"] = (
    _with(
        _USAGE,
        """t AS (SELECT sum(cost) FILTER (kind = 'completion') AS cc, sum(cost) FILTER (kind = 'embedding') AS ec,
  sum(tokens) FILTER (kind = 'completion') AS ct, sum(tokens) FILTER (kind = 'embedding') AS et FROM usage)""",
    )
    + """SELECT '=== Cost and Token Usage Summary ===' || chr(10)
  || printf('Completion Cost: $%.6f', cc) || chr(10) || printf('Embedding Cost: $%.6f', ec) || chr(10)
  || printf('Total Cost: $%.6f', cc + ec) || chr(10) || chr(10)
  || 'Completion Tokens: ' || ct || chr(10) || 'Embedding Tokens: ' || et || chr(10)
  || 'Total Tokens: ' || (ct + et) AS summary FROM t"""
)

# --- knowledge base -----------------------------------------------------------------------

_TOOL_TEXTS = "source || '-' || lang AS tool_name, 'official_package_documentation' AS source_type"


def _batches(until: str) -> str:
    """Both upsert batches, table by table: old ids stay, new ones follow in key order."""
    tables = {
        "tool": ("tool_name, source_type, url", "metadata"),
        "page": ("tool_id, url", None),
        "chunk": ("page_id, chunk_number", "title, summary, content, metadata"),
    }
    parts = [f"""row1 AS (
  SELECT {_TOOL_TEXTS}, 'https://' || source || '.example.org/' AS tool_url, {_URL} AS url,
    doc_id, lang, text, 1 AS seq FROM documents WHERE lang <> 'fr')""",
        f"""row2 AS (
  SELECT {_TOOL_TEXTS}, 'https://' || source || '.example.org/' AS tool_url, {_URL} AS url,
    doc_id, lang, text, 2 AS seq FROM documents WHERE lang <> 'es'
  UNION ALL
  SELECT {_TOOL_TEXTS}, 'https://' || source || '.example.org/', {_URL}, doc_id, lang,
    text || chr(10) || chr(10) || 'Again.', 3 FROM documents WHERE lang = 'de')"""]  # fmt: skip
    for name, (key, values) in tables.items():
        for b, day, stamp, size in ((1, "2025-01-01", _AS_OF, 1000), (2, "2025-02-01", _LATER, 5000)):
            if name == "tool":
                rows = f"""SELECT tool_name, source_type, tool_url AS url, seq,
  '{{"version":"' || seq || '"}}' AS metadata FROM row{b}"""
            elif name == "page":
                rows = f"SELECT t.id AS tool_id, r.url, seq FROM row{b} r JOIN tool{b} t USING (tool_name)"
            else:
                parts.append(_cut(f"cut{b}", f"(SELECT doc_id, lang, url, seq, text FROM row{b})",
                                  "doc_id, lang, url, seq", size))
                rows = f"""SELECT p.id AS page_id, chunk_number, seq, content,
  seq || ': ' || {_title("content")} AS title, {_summary("content")} AS summary,
  {_metadata(_PATH, "content", stamp)} AS metadata FROM cut{b} c JOIN page{b} p ON p.url = c.url"""
            picked = f", {values}" if values else ""
            parts.append(
                f"{name}_new{b} AS (SELECT {key}{picked} FROM ({rows})"
                f" QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY seq DESC) = 1)"
            )
            if b == 1:
                parts.append(
                    f"{name}1 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {key}) AS id, {key}{picked},"
                    f" '{day}' AS created_at, '{day}' AS updated_at FROM {name}_new1)"
                )
                continue
            old_values = "".join(f", o.{v}" for v in values.split(", ")) if values else ""
            new_values = "".join(f", n.{v}" for v in values.split(", ")) if values else ""
            parts.append(f"""{name}2 AS MATERIALIZED (
  SELECT o.id, {", ".join("o." + k for k in key.split(", "))}{old_values}, o.created_at, o.updated_at
  FROM {name}1 o ANTI JOIN {name}_new2 n USING ({key})
  UNION ALL
  SELECT o.id, {", ".join("o." + k for k in key.split(", "))}{new_values}, o.created_at, '{day}'
  FROM {name}1 o JOIN {name}_new2 n USING ({key})
  UNION ALL
  SELECT (SELECT max(id) FROM {name}1) + row_number() OVER (ORDER BY {", ".join("n." + k for k in key.split(", "))}),
    {", ".join("n." + k for k in key.split(", "))}{new_values}, '{day}', '{day}'
  FROM {name}_new2 n ANTI JOIN {name}1 o USING ({key})
)""")
        if name == until:
            break
    return _with(*parts, recursive=True)


ORACLE["upsert_tools"] = (
    _batches("tool") + "SELECT id, tool_name, source_type, url, created_at, updated_at, metadata FROM tool2"
)
ORACLE["upsert_pages"] = _batches("page") + "SELECT id, tool_id, url, created_at, updated_at FROM page2"
ORACLE["upsert_chunks"] = (
    _batches("chunk")
    + "SELECT id, page_id, chunk_number, title, summary, content, metadata, created_at, updated_at FROM chunk2"
)

ORACLE["store_upsert"] = ORACLE["upsert_chunks"].replace(" FROM chunk2", ", CAST(2 AS BIGINT) AS reads FROM chunk2")

_KB_CHUNK = f"""{_DOC_CHUNKS},
kb AS MATERIALIZED (
  SELECT (doc_id + 1) * 2097152 + chunk_number AS id, doc_id + 1 AS page_id, chunk_number,
    {_title("content")} AS title, {_summary("content")} AS summary, content,
    {_metadata(_PATH, "content")} AS metadata,
    CASE WHEN chunk_number <> 0 THEN NULL
         WHEN lang = 'es' THEN list_transform(embedding, lambda x: CAST(0 AS DOUBLE))
         ELSE CAST(embedding AS DOUBLE[]) END AS vector,
    {_URL} AS url, source AS tool_name, 'official_package_documentation' AS source_type, lang, source
  FROM chunk JOIN documents USING (doc_id) LEFT JOIN embeddings ON vec_id = doc_id
)"""

_REASON = """CASE WHEN lang = 'fr' THEN 'null title' WHEN lang = 'de' AND vector IS NOT NULL THEN 'vector size'
  WHEN source = 'src5' THEN 'bad metadata' WHEN lang = 'es' THEN 'missing page' END"""
ORACLE["upsert_rejects"] = (
    _with(_KB_CHUNK, recursive=True) + f"SELECT page_id, chunk_number, {_REASON} AS reason FROM kb"
)

_NOT_NULL = {
    "tool_docs": "id tool_name source_type url created_at updated_at metadata",
    "page": "id tool_id url created_at updated_at",
    "page_chunk": "id page_id chunk_number title summary content metadata created_at updated_at",
}
_CHECKS = [
    (table, f"not null {c}", "(SELECT count(*) FROM kb WHERE lang = 'fr')" if c == "title" else "0")
    for table, columns in _NOT_NULL.items()
    for c in columns.split()
] + [
    ("tool_docs", "source type", "0"),
    ("tool_docs", "json metadata", "0"),
    ("page_chunk", "json metadata", "(SELECT count(*) FROM kb WHERE source = 'src5')"),
    ("page_chunk", "vector size", "(SELECT count(*) FROM kb WHERE lang = 'de' AND vector IS NOT NULL)"),
    ("tool_docs", "unique id", "0"),
    ("tool_docs", "unique tool_name, source_type, url", "0"),
    ("page", "unique id", "0"),
    ("page", "unique tool_id, url", "0"),
    ("page_chunk", "unique id", "(SELECT count(*) FROM kb)"),
    ("page_chunk", "unique page_id, chunk_number", "(SELECT count(*) FROM kb)"),
    ("page", "reference tool_id", "0"),
    ("page_chunk", "reference page_id", "(SELECT 2 * count(*) FROM kb WHERE lang = 'es')"),
]
ORACLE["kb_constraint_report"] = _with(_KB_CHUNK, recursive=True) + "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS constraint_name, CAST({v} AS BIGINT) AS violations"
    for t, c, v in _CHECKS
)

# --- search -------------------------------------------------------------------------------


def _cosine(a: str, b: str) -> str:
    """Similarity, or 2 where a vector is zero."""
    zero = f"list_dot_product({a}, {a}) = 0 OR list_dot_product({b}, {b}) = 0"
    return f"CASE WHEN {zero} THEN 2.0 ELSE greatest(-1.0, least(1.0, list_cosine_similarity({a}, {b}))) END"


ORACLE["cosine_similarity"] = (
    _with(_KB_CHUNK, recursive=True)
    + f"""SELECT id, round({_cosine("kb.vector", "CAST(e.embedding AS DOUBLE[])")}, 6) + 0.0 AS similarity
FROM kb LEFT JOIN embeddings e ON e.vec_id = kb.page_id AND kb.vector IS NOT NULL
WHERE kb.vector IS NOT NULL AND e.vec_id IS NOT NULL
UNION ALL
SELECT id, NULL FROM kb LEFT JOIN embeddings e ON e.vec_id = kb.page_id
WHERE kb.vector IS NULL OR e.vec_id IS NULL"""
)

ORACLE["chunk_page_tool_join"] = (
    _with(_KB_CHUNK, recursive=True)
    + "SELECT id, url, tool_name, source_type, chunk_number, title FROM kb"
)


def _ranked(items: str, queries: str, k: int, where: str = "true") -> str:
    """``hit(query_id, rank, id, similarity)`` of items(id, vector) and queries(query_id, q)."""
    return f"""scored AS (
  SELECT query_id, id, vector IS NULL AS missing, {_cosine("vector", "q")} AS s FROM {items}, {queries} WHERE {where}
),
hit AS MATERIALIZED (
  SELECT query_id, CAST(rank AS INTEGER) AS rank, id, CASE WHEN missing THEN NULL ELSE round(s, 6) + 0.0 END AS similarity
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY missing, s = 2.0, round(1 - s, 12), id) AS rank FROM scored) WHERE rank <= {k}
)"""


_QUERIES = "query AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings)"
_FIRST = "query AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings ORDER BY vec_id LIMIT 1)"
_COLUMNS = "id, url, tool_name, source_type, chunk_number, title, summary, content, metadata, similarity"

ORACLE["kb_search"] = (
    _with(_KB_CHUNK, _FIRST, _ranked("kb", "query", 10), recursive=True)
    + f"SELECT {_COLUMNS} FROM hit JOIN kb USING (id)"
)
ORACLE["kb_search_filtered"] = (
    _with(
        _KB_CHUNK, _FIRST,
        _ranked("kb", "query", 10, "contains(source, '1') AND NOT ends_with(source, '3')"), recursive=True,
    )
    + f"SELECT {_COLUMNS} FROM hit JOIN kb USING (id)"
)
ORACLE["kb_search_sql"] = ORACLE["kb_search"]
ORACLE["kb_search_sql_filtered"] = ORACLE["kb_search_filtered"]
ORACLE["kb_search_result"] = (
    _with(_KB_CHUNK, _FIRST, _ranked("kb", "query", 10), recursive=True)
    + """SELECT title, url AS source_url, tool_name, source_type, summary, similarity, chunk_number, content
FROM hit JOIN kb USING (id)"""
)
ORACLE["kb_search_batch"] = (
    _with(_KB_CHUNK, _QUERIES, _ranked("kb", "query", 10), recursive=True)
    + "SELECT query_id, rank, id, url, tool_name, chunk_number, title, similarity FROM hit JOIN kb USING (id)"
)
ORACLE["context_pack"] = (
    _with(_KB_CHUNK, _QUERIES, _ranked("kb", "query", 3), recursive=True)
    + """SELECT query_id,
  string_agg('## ' || title || chr(10) || url || chr(10) || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS content,
  string_agg(url, ' ' ORDER BY rank) FILTER (first_use) AS reference_urls
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY rank) = 1 AS first_use
      FROM hit JOIN kb USING (id))
GROUP BY query_id"""
)
ORACLE["ivf_search"] = (
    _with(
        "item AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)",
        _QUERIES, _ranked("item", "query", 10),
    )
    + "SELECT query_id, rank, id, similarity FROM hit"
)

_LISTS = (
    "centre AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS list_id, CAST(embedding AS DOUBLE[]) AS c"
    " FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 8))",
    """place AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, list_id, row_number() OVER (
    PARTITION BY vec_id ORDER BY round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), c), 12), list_id) AS near
  FROM embeddings, centre
)""",
)
_PROBED = (
    """pair AS (
  SELECT q.id AS query_id, i.id, 1 - list_cosine_similarity(q.v, i.v) AS far
  FROM place q JOIN place i ON i.near = 1 AND i.list_id = q.list_id WHERE q.near <= 2
)""",
    """hit AS (
  SELECT query_id, id, far, row_number() OVER (PARTITION BY query_id ORDER BY round(far, 12), id) AS rank FROM pair
)""",
)
ORACLE["ivf_assign"] = _with(*_LISTS) + "SELECT id, CAST(list_id AS INTEGER) AS list_id FROM place WHERE near = 1"
ORACLE["ivf_search_probed"] = (
    _with(*_LISTS, *_PROBED)
    + """SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(1 - far, 6) + 0.0 AS similarity
FROM hit WHERE rank <= 10"""
)
ORACLE["ivf_recall"] = (
    _with(
        *_LISTS, *_PROBED,
        """exact AS (
  SELECT q.id AS query_id, i.id FROM place q JOIN place i ON i.near = 1 WHERE q.near = 1
  QUALIFY row_number() OVER (
    PARTITION BY q.id ORDER BY round(1 - list_cosine_similarity(q.v, i.v), 12), i.id) <= 10
)""",
    )
    + """SELECT e.query_id, count(h.id) AS found, round(count(h.id) / count(*), 6) + 0.0 AS recall
FROM exact e LEFT JOIN (SELECT * FROM hit WHERE rank <= 10) h USING (query_id, id) GROUP BY 1"""
)

ORACLE["kb_search_text"] = (
    _with(
        _DOC_CHUNKS,
        "item AS (SELECT (doc_id + 1) * 2097152 + chunk_number AS id, content FROM chunk)",
        "asked AS (SELECT item_id AS query_id, text AS content FROM benchmark)",
        _vectors("iv", "item", "id"),
        _vectors("qv", "asked", "query_id"),
        "norm AS (SELECT id, sqrt(sum(weight * weight)) AS n FROM iv GROUP BY id)",
        "qnorm AS (SELECT query_id, sqrt(sum(weight * weight)) AS n FROM qv GROUP BY query_id)",
        """dot AS (SELECT id, query_id, sum(iv.weight * qv.weight) AS d FROM iv JOIN qv USING (place) GROUP BY ALL)""",
        """pair AS (
  SELECT query_id, id, coalesce(d, 0) / (norm.n * qnorm.n) AS s
  FROM norm CROSS JOIN qnorm LEFT JOIN dot USING (id, query_id)
)""",
        recursive=True,
    )
    + f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, {_title("content")} AS title, {_URL} AS source_url,
  source AS tool_name, 'official_package_documentation' AS source_type, {_summary("content")} AS summary,
  round(s, 6) + 0.0 AS similarity, chunk_number, content
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(1 - s, 12), id) AS rank FROM pair) r
JOIN (SELECT (doc_id + 1) * 2097152 + chunk_number AS id, doc_id, chunk_number, content FROM chunk) c USING (id)
JOIN documents USING (doc_id)
WHERE rank <= 5"""
)

ORACLE["accepted_answer"] = r"""
WITH numbered AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS turn_id FROM conversations),
question AS (
  SELECT u.turn_id AS question_id, u.text AS title, a.text AS body
  FROM numbered u JOIN numbered a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
),
word AS (
  SELECT question_id, w, count(*) AS tf FROM (
    SELECT question_id, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')) AS w FROM question)
  GROUP BY ALL
),
size AS (SELECT question_id, coalesce(sum(tf), 0) AS dl FROM question LEFT JOIN word USING (question_id) GROUP BY 1),
total AS (SELECT count(*) AS n, avg(dl) AS mean FROM size),
rarity AS (SELECT w, ln(1 + ((SELECT n FROM total) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM word GROUP BY w),
asked AS (
  SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM benchmark
),
score AS (
  SELECT query_id, question_id,
    sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT mean FROM total)))) AS s
  FROM asked JOIN rarity USING (w) JOIN word USING (w) JOIN size USING (question_id) GROUP BY ALL
),
best AS (
  SELECT query_id, question_id FROM score
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, question_id) = 1
)
SELECT b.item_id AS query_id, title AS question, body AS accepted_answer,
  'https://stackoverflow.com/q/' || question_id AS source_url
FROM benchmark b LEFT JOIN best ON best.query_id = b.item_id LEFT JOIN question USING (question_id)"""

# --- streaming ----------------------------------------------------------------------------

ORACLE["stream_ingest"] = (
    _with(
        f"""page_text AS (
  SELECT {_BARE} AS url, arg_max({_TEXT}, page_id) AS text FROM pages GROUP BY 1
)""",
        _cut("chunk", "page_text", "url", 5000),
        recursive=True,
    )
    + f"""SELECT {_HOST} AS tool_name, url, chunk_number, {_title("content")} AS title,
  {_summary("content")} AS summary, content FROM chunk"""
)
