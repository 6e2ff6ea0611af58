"""Chunking, embedding and file-shape queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagemill.functions.text import extension_of, language_of, let, line_range, lines_of
from passagemill.operators import chunking
from passagemill.operators.changes import rehydrate_chunks
from passagemill.operators.chunking import Definition, Outline
from passagemill.operators.embedding import HashEmbedder, check_dimensions, embed, embed_queries
from passagemill.operators.symbols import extract_symbols
from passagemill.plans import roles

FILES = (
    "files AS (SELECT doc_id, source||'/'||lang||'/'||doc_id AS filepath, text AS content, lang AS language, "
    "CAST(n_chars AS DOUBLE) AS mtime FROM documents)"
)
LINES = FILES + ", lines AS (SELECT *, string_split(content, chr(10)) AS ls FROM files)"
CHUNKS = (
    LINES + ", chunks AS (SELECT filepath||':'||(i+1)||'-'||least(i+10, len(ls)) AS id, filepath, "
    "array_to_string(ls[i+1:i+10], chr(10)) AS content, i+1 AS start_line, least(i+10, len(ls)) AS end_line, language "
    "FROM (SELECT *, unnest(range(0, len(ls), 8)) AS i FROM lines) "
    "WHERE regexp_matches(array_to_string(ls[i+1:i+10], chr(10)), '\\S'))"
)

# The texts have no headings: a line under 30 characters opens a section, one under 80 a member.
TEXT_OUTLINE = Outline(
    (Definition(r"^(?=.{0,29}$)([^ ]*)", "class"),), (Definition(r"^(?=.{30,79}$)([^ ]*)", "method"),)
)
PAGE_OUTLINE = Outline(
    (Definition(r"^<(title|nav|article|footer)\b", "class"),), (Definition(r"^<(p|li|h1)>", "method"),)
)

LONG = ("start_line", "end_line")


def widened(df, *columns):
    for c in columns or [c for c in LONG if c in df.columns]:
        df = df.withColumn(c, F.col(c).cast("long"))
    return df


def text_chunks(spark, sf):
    return chunking.chunk_by_lines(roles.files(spark, sf), 10, 2)


def chunk_by_lines(spark, sf):
    return widened(text_chunks(spark, sf).select("id", "filepath", "content", "start_line", "end_line", "language"))


def whole_files(spark, sf):
    return roles.files(spark, sf).select(
        F.col("filepath").alias("id"), "filepath", "content", F.lit(1).alias("start_line"),
        F.size(lines_of(F.col("content"))).alias("end_line"), "language",
        F.lit("other").alias("symbol_type"), F.lit("text").alias("symbol_name"),
    )


def split_large_chunks(spark, sf):
    parts = chunking.split_large_chunks(whole_files(spark, sf), 6, 3)
    return widened(parts.select("id", "content", "start_line", "end_line", "symbol_name"))


# parts of a piece (content, start_line, symbol_type, symbol_name) over max_lines, short tail merged
def _parts_sql(source: str, max_lines: int, min_lines: int) -> str:
    return f"""
sized AS (SELECT *, string_split(content, chr(10)) AS pl, len(string_split(content, chr(10))) AS n FROM {source}),
shape AS (SELECT *, CAST(ceil(n / {max_lines}.0) AS BIGINT) AS cnt,
  CAST(ceil(n / ceil(n / {max_lines}.0)) AS BIGINT) AS per FROM sized WHERE n > {max_lines}),
kept AS (SELECT *, CASE WHEN per < {min_lines} THEN 1
  ELSE cnt - CASE WHEN n - (cnt - 1) * per < {min_lines} THEN 1 ELSE 0 END END AS k FROM shape),
parts AS (
  SELECT filepath, language, symbol_type,
    array_to_string(pl[(i-1)*per+1 : CASE WHEN i = k THEN n ELSE i*per END], chr(10)) AS content,
    start_line + (i-1)*per AS start_line,
    start_line + CASE WHEN i = k THEN n ELSE i*per END - 1 AS end_line,
    symbol_name || ' (part ' || i || ')' AS symbol_name
  FROM (SELECT *, unnest(range(1, k+1)) AS i FROM kept)
  UNION ALL
  SELECT filepath, language, symbol_type, content, start_line, start_line + n - 1, symbol_name
  FROM sized WHERE n <= {max_lines})"""


_ID = "filepath||':'||start_line||'-'||end_line||CASE WHEN coalesce(symbol_name,'')<>'' THEN ':'||symbol_name ELSE '' END AS id"

SECTIONS = LINES + """,
numbered AS (SELECT filepath, language, unnest(ls) AS line, unnest(range(1, len(ls)+1)) AS pos FROM lines),
flagged AS (SELECT *, length(line) < 30 AS is_def FROM numbered),
grouped AS (SELECT *, sum(CASE WHEN is_def OR pos = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY filepath ORDER BY pos) AS g FROM flagged),
sections AS (SELECT filepath, language, min(pos) AS start_line, string_agg(line, chr(10) ORDER BY pos) AS content,
  bool_or(is_def) AS named, regexp_extract(arg_min(line, pos), '^([^ ]*)', 1) AS word
  FROM grouped GROUP BY filepath, language, g),
typed AS (SELECT filepath, language, start_line, content, CASE WHEN named THEN 'class' ELSE 'other' END AS symbol_type,
  CASE WHEN named THEN word END AS symbol_name FROM sections WHERE regexp_matches(content, '\\S'))"""


def chunk_by_structure(spark, sf):
    chunks = chunking.chunk_by_structure(roles.files(spark, sf), TEXT_OUTLINE, max_lines=1000)
    return widened(chunks.select("id", "filepath", "content", "start_line", "end_line", "symbol_type", "symbol_name"))


def split_big_sections(spark, sf):
    chunks = chunking.chunk_by_structure(roles.files(spark, sf), TEXT_OUTLINE, max_lines=3, min_lines=2)
    return widened(chunks.select("id", "filepath", "content", "start_line", "end_line", "symbol_type", "symbol_name"))


def page_units(spark, sf):
    tags = F.regexp_extract_all("html", F.lit("<(title|h1|p|li|a|b)[ >]"), 1)
    pages = roles.table(spark, sf, "pages")
    units = pages.select(F.col("page_id").cast("string").alias("filepath"), F.posexplode(tags).alias("pos", "tag"))
    return units.select(
        "filepath",
        F.when(F.col("tag") == "a", F.lit("import")).otherwise(F.lit("other")).alias("symbol_type"),
        F.col("tag").alias("symbol_name"),
        (F.col("pos") + 1).alias("start_line"),
        (F.col("pos") + 1).alias("end_line"),
    )


def collapse_preamble(spark, sf):
    return widened(chunking.collapse_preamble(page_units(spark, sf)))


def routed(spark, sf):
    return chunking.chunk_files(roles.files(spark, sf), 10, 2, {"en": TEXT_OUTLINE})


def route_chunker(spark, sf):
    return (
        routed(spark, sf)
        .groupBy("filepath", "method", "fell_back")
        .agg(F.count(F.lit(1)).alias("chunks"), F.max("end_line").cast("long").alias("last_line"))
    )


def chunking_stats(spark, sf):
    per_file = routed(spark, sf).select("filepath", "method", "fell_back").distinct()
    return chunking.chunking_stats(per_file)


def extract_page_symbols(spark, sf):
    pages = roles.table(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("filepath"),
        F.lit("html").alias("language"),
        F.regexp_replace("html", "<", "\n<").alias("content"),
    )
    found = extract_symbols(pages, PAGE_OUTLINE)
    return widened(
        found.select(
            "filepath", "name", "name_path", "parent_path", F.col("kind").cast("long").alias("kind"),
            F.col("depth").cast("long").alias("depth"), "start_line", "end_line",
        )
    )


def read_line_range(spark, sf):
    lines = let(lines_of(F.col("content")), lambda ls: line_range(ls, F.lit(2), F.lit(4)))
    return roles.files(spark, sf).select("filepath", lines.alias("content"))


def rehydrated(spark, sf):
    hollow = text_chunks(spark, sf).withColumn("content", F.lit(None).cast("string"))
    return widened(
        rehydrate_chunks(hollow, roles.stored_snapshot(spark, sf)).select("id", "content", "start_line", "end_line")
    )


def language_of_paths(spark, sf):
    path = F.regexp_replace("url", r"[?#].*$", "")
    return roles.table(spark, sf, "pages").select("page_id", extension_of(path).alias("ext")).withColumn(
        "language", language_of(F.when(F.col("ext") == "html", F.lit("ts")).otherwise(F.col("ext")))
    )


def embed_texts(spark, sf):
    embedded = embed(roles.files(spark, sf).select("doc_id", "content"), "content", HashEmbedder())
    cells = embedded.select("doc_id", F.posexplode("embedding").alias("pos", "weight")).filter("weight <> 0")
    return cells.select(
        "doc_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("weight").cast("double"), 5).alias("weight")
    )


_WORDS = "SELECT {key}, lower(unnest(regexp_extract_all({text}, '[A-Za-z0-9_]+'))) AS w FROM {table}"
_VECTORS = """
words AS ({words}),
slots AS (SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS pos,
  CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END AS s FROM words),
cells AS (SELECT {key}, pos, CAST(sum(s) AS DOUBLE) AS v FROM slots GROUP BY 1, 2),
norms AS (SELECT {key}, sqrt(sum(v * v)) AS norm FROM cells GROUP BY 1)"""


def vectors_sql(key: str, text: str, table: str) -> str:
    return _VECTORS.format(key=key, words=_WORDS.format(key=key, text=text, table=table))


def embed_queries_query(spark, sf):
    """Every turn asks its text as a query; equal texts are embedded once."""
    asked = roles.table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("query"))
    vectors = embed_queries(asked, "query", HashEmbedder())
    used = F.size(F.filter("embedding", lambda x: x != 0)).cast("long")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    return vectors.select("conv_id", "turn", used.alias("used"), F.round(total, 4).alias("total"))


def check_dimensions_query(spark, sf):
    stored = roles.vectors(spark, sf)
    record = stored.agg(F.max(F.size("embedding")).alias("embedding_dimensions")).select(
        F.lit("hash").alias("embedding_backend"), F.lit("md5-words-64").alias("embedding_model"), "embedding_dimensions"
    )
    cases = [("hash", "md5-words-32", 32), ("hash", "md5-words-128", 64), ("other", "md5-words-64", 64), ("hash", "md5-words-64", 64)]
    out = None
    for name, model, dim in cases:
        one = check_dimensions(stored, record, name, model, dim).withColumn("case", F.lit(f"{name}/{model}/{dim}"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    "chunk_by_lines": chunk_by_lines,
    "split_large_chunks": split_large_chunks,
    "chunk_by_structure": chunk_by_structure,
    "split_big_sections": split_big_sections,
    "collapse_preamble": collapse_preamble,
    "route_chunker": route_chunker,
    "chunking_stats": chunking_stats,
    "extract_symbols": extract_page_symbols,
    "read_line_range": read_line_range,
    "rehydrate_chunks": rehydrated,
    "language_of_paths": language_of_paths,
    "embed_hash": embed_texts,
    "embed_queries": embed_queries_query,
    "check_dimensions": check_dimensions_query,
}

_ROUTED = LINES + """,
judged AS (SELECT *, language = 'en' AS tried, len(list_filter(ls, lambda x: length(x) < 30)) > 0 AS found FROM lines),
numbered AS (SELECT filepath, unnest(ls) AS line, unnest(range(1, len(ls)+1)) AS pos FROM judged WHERE tried AND found),
grouped AS (SELECT *, sum(CASE WHEN length(line) < 30 OR pos = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY filepath ORDER BY pos) AS g FROM numbered),
structured AS (SELECT filepath, g, max(pos) AS end_line FROM grouped GROUP BY ALL HAVING bool_or(regexp_matches(line, '\\S'))),
windows AS (SELECT filepath, least(i+10, len(ls)) AS end_line, ls[i+1:i+10] AS w, tried FROM (SELECT *, unnest(range(0, len(ls), 8)) AS i FROM judged WHERE NOT (tried AND found))),
routed AS (
  SELECT filepath, 'structure' AS method, false AS fell_back, end_line FROM structured
  UNION ALL
  SELECT filepath, 'lines', tried, end_line FROM windows WHERE regexp_matches(array_to_string(w, chr(10)), '\\S'))"""

SQL = {
    "chunk_by_lines": f"WITH {CHUNKS} SELECT * FROM chunks",
    "split_large_chunks": f"""WITH {LINES}, whole AS (SELECT filepath, language, content, 1 AS start_line, 'other' AS symbol_type, 'text' AS symbol_name FROM lines),
        {_parts_sql('whole', 6, 3)} SELECT {_ID}, content, start_line, end_line, symbol_name FROM parts""",
    "chunk_by_structure": f"""WITH {SECTIONS} SELECT filepath||':'||start_line||'-'||end_line||CASE WHEN coalesce(symbol_name,'')<>'' THEN ':'||symbol_name ELSE '' END AS id,
        filepath, content, start_line, end_line, symbol_type, symbol_name FROM
        (SELECT *, start_line + len(string_split(content, chr(10))) - 1 AS end_line FROM typed)""",
    "split_big_sections": f"""WITH {SECTIONS},
        tl AS (SELECT *, string_split(content, chr(10)) AS tls FROM typed),
        cand AS (SELECT *, symbol_type = 'class' AND len(tls) > 3 AND len(list_filter(tls, lambda x: length(x) BETWEEN 30 AND 79)) > 0 AS cut FROM tl),
        ml AS (SELECT filepath, language, start_line AS sec, symbol_name AS parent, unnest(tls) AS line, unnest(range(1, len(tls)+1)) AS pos FROM cand WHERE cut),
        mg AS (SELECT *, length(line) BETWEEN 30 AND 79 AS is_m, sum(CASE WHEN length(line) BETWEEN 30 AND 79 OR pos = 1 THEN 1 ELSE 0 END)
          OVER (PARTITION BY filepath, sec ORDER BY pos) AS g FROM ml),
        ms AS (SELECT filepath, language, sec + min(pos) - 1 AS start_line, string_agg(line, chr(10) ORDER BY pos) AS content, bool_or(is_m) AS named,
          any_value(parent) AS parent, regexp_extract(arg_min(line, pos), '^([^ ]*)', 1) AS word FROM mg GROUP BY filepath, language, sec, g),
        pieces AS (
          SELECT filepath, language, start_line, content, CASE WHEN named THEN 'method' ELSE 'class' END AS symbol_type,
            CASE WHEN named THEN concat_ws('.', parent, word) ELSE parent || ' (header)' END AS symbol_name FROM ms
          UNION ALL SELECT filepath, language, start_line, content, symbol_type, symbol_name FROM cand WHERE NOT cut),
        {_parts_sql('pieces', 3, 2)} SELECT {_ID}, filepath, content, start_line, end_line, symbol_type, symbol_name FROM parts""",
    "collapse_preamble": """WITH t AS (SELECT CAST(page_id AS VARCHAR) AS filepath, unnest(regexp_extract_all(html, '<(title|h1|p|li|a|b)[ >]', 1)) AS tag,
        generate_subscripts(regexp_extract_all(html, '<(title|h1|p|li|a|b)[ >]', 1), 1) AS pos FROM pages)
        SELECT filepath, 'import' AS symbol_type, 'imports' AS symbol_name, min(pos) AS start_line, max(pos) AS end_line FROM t WHERE tag = 'a' GROUP BY filepath
        UNION ALL SELECT filepath, 'other', tag, pos, pos FROM t WHERE tag <> 'a'""",
    "route_chunker": f"WITH {_ROUTED} SELECT filepath, method, fell_back, count(*) AS chunks, max(end_line) AS last_line FROM routed GROUP BY ALL",
    "chunking_stats": f"""WITH {_ROUTED}, f AS (SELECT DISTINCT filepath, method, fell_back FROM routed)
        SELECT count(*) FILTER (method = 'structure') AS structure_chunked, count(*) FILTER (method = 'lines') AS line_chunked,
        count(*) FILTER (fell_back) AS fallbacks, count(*) AS files, round(100.0 * count(*) FILTER (fell_back) / count(*), 1)::DOUBLE AS fallback_percent,
        coalesce(array_to_string((array_agg(filepath ORDER BY filepath) FILTER (fell_back))[1:5], ', '), '') AS fallback_names FROM f""",
    "extract_symbols": """WITH l AS (SELECT CAST(page_id AS VARCHAR) AS filepath, string_split(replace(html, '<', chr(10)||'<'), chr(10)) AS ls FROM pages),
        n AS (SELECT filepath, unnest(ls) AS line, unnest(range(1, len(ls)+1)) AS pos, len(ls) AS total FROM l),
        c AS (SELECT *, regexp_extract(line, '^<(title|nav|article|footer)\\b', 1) AS top, regexp_extract(line, '^<(p|li|h1)>', 1) AS mem FROM n),
        g AS (SELECT *, max(CASE WHEN top <> '' THEN pos END) OVER (PARTITION BY filepath ORDER BY pos) AS own FROM c),
        d AS (SELECT *, coalesce(lead(pos) OVER (PARTITION BY filepath ORDER BY pos) - 1, total) AS e_next FROM g WHERE top <> '' OR (mem <> '' AND own IS NOT NULL)),
        tops AS (SELECT filepath, top AS name, pos, coalesce(lead(pos) OVER (PARTITION BY filepath ORDER BY pos) - 1, total) AS e FROM g WHERE top <> '')
        SELECT filepath, name, '/'||name AS name_path, NULL::VARCHAR AS parent_path, 5::BIGINT AS kind, 0::BIGINT AS depth, pos AS start_line, e AS end_line FROM tops
        UNION ALL SELECT d.filepath, d.mem, '/'||t.name||'/'||d.mem, '/'||t.name, 6, 1, d.pos, d.e_next FROM d JOIN tops t ON t.filepath = d.filepath AND t.pos = d.own WHERE d.mem <> ''""",
    "read_line_range": f"WITH {LINES} SELECT filepath, array_to_string(ls[2:4], chr(10)) AS content FROM lines",
    "rehydrate_chunks": f"WITH {CHUNKS} SELECT id, CASE WHEN language = 'de' THEN '' ELSE content END AS content, start_line, end_line FROM chunks",
    "language_of_paths": """WITH p AS (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]\\.([^./]*)$', 1) AS ext FROM pages)
        SELECT page_id, ext, CASE WHEN ext = 'html' THEN 'typescript' ELSE ext END AS language FROM p""",
    "embed_hash": f"WITH {vectors_sql('doc_id', 'text', 'documents')} SELECT doc_id, pos, round((v / norm)::FLOAT::DOUBLE, 5) AS weight FROM cells JOIN norms USING (doc_id) WHERE v <> 0",
    "embed_queries": f"""WITH q AS (SELECT conv_id, turn, conv_id||'/'||turn AS k, text FROM conversations), {vectors_sql('k', 'text', 'q')},
        a AS (SELECT k, count(*) FILTER (v <> 0) AS used, round(coalesce(sum(abs((v / norm)::FLOAT::DOUBLE)), 0), 4) AS total FROM cells JOIN norms USING (k) GROUP BY 1)
        SELECT conv_id, turn, coalesce(used, 0) AS used, coalesce(total, 0) AS total FROM q LEFT JOIN a USING (k)""",
    "check_dimensions": """WITH w AS (SELECT max(len(embedding)) AS d FROM embeddings)
        SELECT 'hash/md5-words-32/32' AS "case", true AS mismatch, 'The vectors are '||d||' wide, those of hash are 32 wide. Index again.' AS reason FROM w
        UNION ALL SELECT 'hash/md5-words-128/64', true, 'The vectors come from model md5-words-64, this embedder is md5-words-128. Index again.'
        UNION ALL SELECT 'other/md5-words-64/64', true, 'The vectors come from hash, this embedder is other. Index again.'
        UNION ALL SELECT 'hash/md5-words-64/64', false, NULL""",
}
