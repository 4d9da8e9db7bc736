"""Queries over text functions, chunking and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.functions import chunking, merging
from lorespark.functions import text as T
from lorespark.functions.vectors import cosine
from lorespark.sources.work import spread

from . import standins as S

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(S.with_("chunks_") + "SELECT document_id, chunk_index, document_id * 1000000 + chunk_index AS vector_id, sha256(content) AS content_hash, chunk_index AS page_no FROM chunks_")
def chunk_hashes(spark, sf_dir):
    from lorespark.operators.lifecycle import vector_id

    none = F.lit(None).cast("long")
    return S.chunks(spark, sf_dir).select(
        "document_id", "chunk_index", vector_id(F.col("document_id"), F.col("chunk_index")).alias("vector_id"),
        T.content_hash(F.col("content")).alias("content_hash"), T.page_number(none, none, F.col("chunk_index")).alias("page_no"),
    )


@query()
def semantic_chunks(spark, sf_dir):
    """Lines count as paragraphs here: the test documents have no blank lines."""
    pages = spread(S.read(spark, sf_dir, "documents")).select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_no"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunking.chunk_pages(pages)


#: Documents as pages with headings: of each four lines the first three become headings of depth 1 to 3, of up to 20 letters.
_TITLED = """lines AS (SELECT doc_id, i, CASE (i - 1) % 4 WHEN 3 THEN line ELSE ['1', '1.1', '1.1.2'][(i - 1) % 4 + 1] || ' ' || trim(left(regexp_replace(line, '[^a-zA-Z ]', '', 'g'), 20)) END AS line
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
    placed AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS begins FROM lines),
    heads AS (SELECT doc_id, i, begins, trim(line) AS title, least(3, 1 + length(n) - length(replace(n, '.', ''))) AS depth FROM (SELECT *, regexp_extract(trim(line), '^(\\d+(?:\\.\\d+)*)', 1) AS n FROM placed)
        WHERE n <> '' AND length(trim(line)) BETWEEN 2 AND 40 AND NOT regexp_matches(trim(line), '[。！？；，、,.;:!?]$')),
    up AS (SELECT h.doc_id, h.i, max(a.i) AS above FROM heads h JOIN heads a ON a.doc_id = h.doc_id AND a.i < h.i AND a.depth < h.depth GROUP BY ALL),
    chains AS (SELECT h.doc_id, h.i, h.begins, h.depth, h.title AS chain FROM heads h ANTI JOIN up USING (doc_id, i)
        UNION ALL SELECT h.doc_id, h.i, h.begins, h.depth, c.chain || ' > ' || h.title FROM heads h JOIN up USING (doc_id, i) JOIN chains c ON c.doc_id = h.doc_id AND c.i = up.above)"""


def _titled(spark, sf_dir):
    number = F.array(F.lit("1"), F.lit("1.1"), F.lit("1.1.2"))
    letters = lambda line: F.trim(F.substring(F.regexp_replace(line, "[^a-zA-Z ]", ""), 1, 20))
    head = lambda line, i: F.when(i % 4 == 3, line).otherwise(F.concat(F.get(number, i % 4), F.lit(" "), letters(line)))
    text = F.array_join(F.transform(F.split("text", "\n"), head), "\n")
    return S.read(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@query(f"WITH RECURSIVE {_TITLED} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, begins AS \"offset\", depth::INT AS depth, chain FROM chains")
def heading_chains(spark, sf_dir):
    rows = _titled(spark, sf_dir).select("doc_id", F.posexplode(T.headings(F.col("text"))).alias("pos", "h"))
    return rows.select("doc_id", "pos", "h.offset", "h.depth", "h.chain")


@query(
    f"""WITH RECURSIVE {_TITLED}, starts AS (SELECT doc_id, unnest(range(0, greatest(sum(length(line) + 1)::INT - 1, 1), 300))::INT AS start FROM lines GROUP BY doc_id)
    SELECT s.doc_id, start, coalesce(max_by(chain, begins) FILTER (begins <= start), min_by(chain, begins)) AS chain FROM starts s LEFT JOIN chains c USING (doc_id) GROUP BY ALL"""
)
def heading_asof(spark, sf_dir):
    """The chain that each 300 characters of a page start under."""
    rows = _titled(spark, sf_dir).withColumn("found", T.headings(F.col("text")))
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(300))
    return rows.select("doc_id", "found", F.explode(starts).alias("start")).select("doc_id", "start", T.heading_at(F.col("found"), F.col("start")).alias("chain"))


_NAME = "regexp_extract(url, '[^/]*$')"


@query(
    f"""SELECT page_id, left(regexp_replace(CASE WHEN contains({_NAME}, '.') THEN regexp_replace({_NAME}, '\\.[^.]*$', '') ELSE {_NAME} END, '[^一-龥a-zA-Z0-9_\\-]', '_', 'g'), 100) AS safe_name,
    CASE WHEN contains({_NAME}, '.') THEN lower(regexp_extract({_NAME}, '[^.]*$')) ELSE '' END AS extension FROM pages"""
)
def file_names(spark, sf_dir):
    name = F.regexp_extract("url", "[^/]*$", 0)
    return S.read(spark, sf_dir, "pages").select("page_id", T.safe_name(name).alias("safe_name"), T.extension(name).alias("extension"))


@query("SELECT doc_id, source || '/2024/01/' || lpad((1 + doc_id % 28)::VARCHAR, 2, '0') || '/' || doc_id || '_' || lang || '_x.pdf' AS path FROM documents")
def object_paths(spark, sf_dir):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int"))
    return S.read(spark, sf_dir, "documents").select("doc_id", T.object_path(F.col("source"), day, F.col("doc_id"), F.concat("lang", F.lit(" x.PDF"))).alias("path"))


_FILE = "regexp_extract(url, '[^/]*$') || ['.pdf', '.PDF', '.docx', ''][page_id % 4 + 1]"


@query(
    f"""SELECT page_id, CASE WHEN contains({_FILE}, '.') THEN lower(regexp_extract({_FILE}, '[^.]*$')) ELSE '' END IN ('pdf', 'txt') AND strlen(html) > 0 AS accepted,
    length(trim(CASE WHEN page_id % 5 = 0 THEN '   scan  ' ELSE html END)) < 20 AS scanned FROM pages"""
)
def upload_gate(spark, sf_dir):
    """Which files may be uploaded, and which pages are scans."""
    from lorespark.sources.files import needs_ocr

    name = F.concat(F.regexp_extract("url", "[^/]*$", 0), F.get(F.array(*map(F.lit, (".pdf", ".PDF", ".docx", ""))), F.col("page_id") % 4))
    text = F.when(F.col("page_id") % 5 == 0, "   scan  ").otherwise(F.col("html"))
    return S.read(spark, sf_dir, "pages").select("page_id", (T.extension(name).isin("pdf", "txt") & (F.octet_length("html") > 0)).alias("accepted"), needs_ocr(text).alias("scanned"))


@query("SELECT doc_id, CASE WHEN length(text) > 120 THEN left(text, 120) || '...' ELSE text END AS snippet FROM documents")
def snippets(spark, sf_dir):
    return S.read(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


_ANSWER = "text || '[来源' || (turn + 2) || ']**b**[来源0' || (conv_id % 5 + 1) || ']`c`[来源9][来源' || (turn + 2) || ']'"
_FOUND = f"list_transform(regexp_extract_all({_ANSWER}, '\\[来源(\\d+)\\]', 1), lambda s: s::INT)"
_CITED = f"list_sort(list_distinct(list_filter({_FOUND}, lambda n: n BETWEEN 1 AND 5)))"


def _answers(spark, sf_dir):
    mark = lambda n: F.concat(F.lit("[来源"), n.cast("string"), F.lit("]"))
    rows = S.read(spark, sf_dir, "conversations")
    padded = F.concat(F.lit("0"), (F.col("conv_id") % 5 + 1).cast("string"))
    answer = F.concat("text", mark(F.col("turn") + 2), F.lit("**b**"), mark(padded), F.lit("`c`[来源9]"), mark(F.col("turn") + 2))
    rows = rows.select("conv_id", "turn", "role", answer.alias("answer"))
    return rows.withColumn("cited", T.citations(F.col("answer"), F.lit(5)))


@query(f"SELECT conv_id, turn, role, array_to_string({_CITED}, ',') AS cited FROM conversations")
def citations_extract(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", "role", F.array_join(F.transform("cited", lambda n: n.cast("string")), ",").alias("cited"))


_SHOWN = "replace(replace(text, '**', ''), '`', '')"
_MARK = lambda n, as_written: f"'[来源' || coalesce(nullif(list_position(cited, ({n})::INT), 0)::VARCHAR, {as_written}) || ']'"


@query(
    f"""WITH a AS (SELECT *, {_CITED} AS cited FROM conversations)
    SELECT conv_id, turn, role, {_SHOWN} || {_MARK("turn + 2", "(turn + 2)::VARCHAR")} || 'b' || {_MARK("conv_id % 5 + 1", "'0' || (conv_id % 5 + 1)")} || 'c[来源9]' || {_MARK("turn + 2", "(turn + 2)::VARCHAR")} AS answer FROM a"""
)
def citations_renumber(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", "role", T.renumber(T.strip_marks(F.col("answer")), F.col("cited")).alias("answer"))


@query(
    f"""SELECT event_id, CASE WHEN event_type = 'error' AND event_id % 3 < 2 THEN '{T.EMBEDDING_ERROR}' WHEN event_type = 'error' THEN 'EMBEDDING failed ' || props WHEN event_type = 'view' THEN 'TimeoutError: ' || props
    WHEN event_type = 'click' THEN left(repeat(props, 50), 200) || '...' ELSE props END AS message FROM events"""
)
def friendly_errors(spark, sf_dir):
    service = F.get(F.array(*map(F.lit, ("Embedding", "dashscope", "EMBEDDING"))), F.col("event_id") % 3)
    raw = F.when(F.col("event_type") == "error", F.concat(service, F.lit(" failed "), "props")).when(F.col("event_type") == "view", F.lit(" \u3000"))
    raw = raw.when(F.col("event_type") == "click", F.repeat("props", F.lit(50))).otherwise(F.col("props"))
    return S.read(spark, sf_dir, "events").select("event_id", T.friendly_error(raw, F.concat(F.lit("TimeoutError: "), "props")).alias("message"))


_SIZE = "strlen(text) * (1 + doc_id % 3 * 5000)"


@query(
    f"""SELECT doc_id, CASE WHEN {_SIZE} < 1024 THEN {_SIZE} || ' B' WHEN {_SIZE} < 1048576 THEN format('{{:.1f}} KB', floor({_SIZE} / 1024 * 10 + 0.5) / 10)
    ELSE format('{{:.1f}} MB', floor({_SIZE} / 1048576 * 10 + 0.5) / 10) END AS size FROM documents"""
)
def file_sizes(spark, sf_dir):
    return S.read(spark, sf_dir, "documents").select("doc_id", T.file_size(F.octet_length("text") * (1 + F.col("doc_id") % 3 * 5000)).alias("size"))


@query("SELECT o_orderkey, 'EMB' || epoch_ms(o_orderdate) || left(md5(o_orderkey::VARCHAR), 8) AS task_no FROM orders")
def task_numbers(spark, sf_dir):
    return S.read(spark, sf_dir, "orders").select("o_orderkey", T.task_number(F.col("o_orderdate"), T.md5(F.col("o_orderkey").cast("string"))).alias("task_no"))


@query(
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)
    SELECT vec_id, round(list_dot_product(e, p) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(p, p))), 6) AS similarity FROM v WHERE p IS NOT NULL"""
)
def adjacent_similarity(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = S.read(spark, sf_dir, "embeddings").withColumn("p", F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id")))
    return rows.where("p IS NOT NULL").select("vec_id", F.round(cosine(F.col("embedding"), F.col("p")), 6).alias("similarity"))


_BLANK = r"[\s\p{Z}]"
#: Lines as paragraphs, merged by a walk over them, and what is too long cut by another.
_MERGED = rf"""lines AS (
  SELECT doc_id, i, line, coalesce(sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS begins
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM lines WHERE NOT regexp_full_match(line, '{_BLANK}*')),
marked AS (SELECT *, sum(CASE WHEN k = 1 OR length(line) + 1 >= {chunking.MIN_SEGMENT} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM numbered),
segs AS (SELECT doc_id, n, string_agg(line || chr(10), '' ORDER BY i) AS t, min(begins) AS begins FROM marked GROUP BY doc_id, n),
vecs AS (SELECT *, list_transform(string_split('a,b,c,d,e,f,g,h,i,j,k,l,m,n,o,p,q,r,s,t,u,v,w,x,y,z', ','), lambda c: (length(lower(t)) - length(replace(lower(t), c, '')))::DOUBLE) AS v FROM segs),
near AS (SELECT *, CASE WHEN sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(p, p)) > 0 THEN list_dot_product(v, p) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(p, p))) ELSE 0 END AS s
         FROM (SELECT *, lag(v) OVER (PARTITION BY doc_id ORDER BY n) AS p FROM vecs)),
walk AS (
  SELECT doc_id, n, 0 AS g, length(t) AS size FROM near WHERE n = 1
  UNION ALL SELECT w.doc_id, x.n, CASE WHEN turn THEN w.g + 1 ELSE w.g END, CASE WHEN turn THEN length(x.t) ELSE w.size + length(x.t) END
  FROM walk w JOIN near x ON x.doc_id = w.doc_id AND x.n = w.n + 1,
       LATERAL (SELECT (x.s < {chunking.SIMILARITY} AND w.size >= {chunking.MIN_CHARS}) OR w.size + length(x.t) > {chunking.MAX_CHARS} AS turn)),
grouped AS (SELECT doc_id, g, string_agg(t, '' ORDER BY n) AS t, min(begins) AS begins FROM walk JOIN segs USING (doc_id, n) GROUP BY doc_id, g),
single AS (SELECT d.doc_id FROM documents d LEFT JOIN segs s USING (doc_id) GROUP BY d.doc_id HAVING count(s.n) <= 1),
cuts AS (
  SELECT doc_id, g, 0 AS k, 0 AS at_, NULL::VARCHAR AS piece, t, begins FROM grouped WHERE length(t) > {chunking.MAX_CHARS}
  UNION ALL SELECT doc_id, g, k + 1, at_ + took, substring(rest, 1, took), t, begins FROM (
    SELECT *, CASE WHEN e > {chunking.MIN_CHARS} + 1 THEN e ELSE length(rest) END AS took FROM (
      SELECT *, length(regexp_extract(rest, '(?s)^(.*[.?!\n])', 1)) AS e FROM (SELECT *, substring(t, at_ + 1, {merging.PIECE}) AS rest FROM cuts WHERE at_ < length(t))))),
made AS (
  SELECT doc_id, g, 0 AS k, t AS chunk, begins FROM grouped WHERE length(t) <= {chunking.MAX_CHARS} AND doc_id NOT IN (FROM single)
  UNION ALL SELECT doc_id, g, k, regexp_replace(piece, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS c, begins FROM cuts WHERE k > 0 AND doc_id NOT IN (FROM single) AND length(c) > {chunking.MIN_PART}
  UNION ALL SELECT doc_id, 0, 0, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)), 0 FROM documents WHERE doc_id IN (FROM single))"""


@query(f"WITH RECURSIVE {_MERGED} SELECT doc_id AS document_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g, k) - 1)::INT AS part, sha256(chunk) AS chunk_sha256, begins AS chunk_start FROM made")
def semantic_merge(spark, sf_dir):
    """semantic_chunks in column functions, before headings are put in front: likeness is by letters instead of a model."""
    pages = spread(S.read(spark, sf_dir, "documents")).select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_no"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return merging.merge_chunks(pages).select("document_id", "part", F.sha2("chunk", 256).alias("chunk_sha256"), "chunk_start")


@query(
    r"""SELECT doc_id, sha256(replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS html_sha256,
    CASE WHEN doc_id % 9 = 0 THEN '-' WHEN (doc_id * 50) % 1000 = 250 THEN (doc_id * 50 // 1000) || '.3s' ELSE printf('%.1fs', doc_id * 50 / 1000) END AS cost FROM documents"""
)
def display_formats(spark, sf_dir):
    """Texts for a page, and durations of which every other one ends in a half."""
    docs = S.read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(T.escape_html(F.col("text")), 256).alias("html_sha256"), T.duration(F.when(F.col("doc_id") % 9 != 0, F.col("doc_id") * 50)).alias("cost"))
