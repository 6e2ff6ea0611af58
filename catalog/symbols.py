"""Symbol, reference and pattern-search queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.chunks import FILES, LINES
from passagemill.functions import names
from passagemill.functions.kinds import chunk_type_kind, kind_name, kind_number, parse_kind
from passagemill.operators import grep as grep_ops
from passagemill.operators import symbols as ops
from passagemill.plans import roles

TARGET = "that"


def _plain(df):
    for c in ("kind", "depth", "line", "column", "start_line", "end_line", "match_start", "match_length", "n", "children", "first_line", "last_line"):
        if c in df.columns:
            df = df.withColumn(c, F.col(c).cast("long"))
    return df


def _found(df):
    return _plain(df.select("filepath", "name_path", "kind"))


def symbols_overview(spark, sf):
    return _plain(ops.symbols_overview(roles.symbols(spark, sf), depth=1))


def overview_counts(spark, sf):
    return _plain(ops.overview_counts(roles.symbols(spark, sf), depth=2))


def find_symbol_relative(spark, sf):
    return _found(ops.find_symbol(roles.symbols(spark, sf), "NATION_3/Customer#*"))


def find_symbol_absolute(spark, sf):
    return _found(ops.find_symbol(roles.symbols(spark, sf), "/ASIA/NATION_2[0]"))


def find_symbol_prefix(spark, sf):
    return _found(ops.find_symbol(roles.symbols(spark, sf), "supplier#*", path="ASIA.tree"))


def find_symbol_by_kind(spark, sf):
    """Only modules, classes and functions: methods go, and nothing under a filtered kind would stay."""
    keep = [kind_number(k) for k in ("module", "class", "function")]
    return _found(ops.find_symbol(roles.symbols(spark, sf), "", kinds=keep, not_kinds=[kind_number("Module") + 100]))


def find_symbol_pruned(spark, sf):
    """Excluding classes hides their members too."""
    return _found(ops.find_symbol(roles.symbols(spark, sf), "*", not_kinds=[kind_number("Class")]))


def children_of(spark, sf):
    pairs = ops.children_of(roles.symbols(spark, sf))
    return pairs.groupBy("parent_kind", "kind").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("parent_kind").cast("long").alias("parent_kind"), F.col("kind").cast("long").alias("kind"), "n"
    )


def first_symbol_per_file(spark, sf):
    return ops.first_symbol_per_file(roles.symbols(spark, sf), "nation*")


def name_path_parts(spark, sf):
    """Name helpers over the paths of the crawled pages."""
    path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*", ""), "[?#].*$", "")
    pages = roles.table(spark, sf, "pages").select("page_id", path.alias("p"))
    p = F.col("p")
    return pages.select(
        "page_id",
        names.symbol_name(p).alias("name"),
        names.parent_path(p).alias("parent"),
        names.name_depth(p).cast("long").alias("depth"),
        names.display_name_path(p).alias("shown"),
        names.build_name_path(names.parent_path(p), F.lit("x")).alias("built"),
        names.match_name_path(p, "en/9*").alias("relative"),
        names.match_name_path(p, "/fr/825").alias("absolute"),
        names.match_name_path(p, "4", prefix=True).alias("prefix"),
    )


def kind_names(spark, sf):
    """Kind numbers by name and by chunk type for the tags of the pages."""
    tag = F.explode(F.regexp_extract_all("html", F.lit("<(title|article|footer|nav|h1)\\b"), 1)).alias("tag")
    tags = roles.table(spark, sf, "pages").select(tag)
    as_type = F.when(F.col("tag") == "h1", F.lit("method")).when(F.col("tag") == "nav", F.lit("import")).otherwise(F.lit("section"))
    return (
        tags.groupBy("tag")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "tag",
            "n",
            chunk_type_kind(as_type).cast("long").alias("kind"),
            kind_name(chunk_type_kind(as_type)).alias("kind_name"),
            parse_kind(F.when(F.col("tag") == "nav", F.lit("TYPEPARAMETER")).otherwise(F.col("tag"))).cast("long").alias("parsed"),
        )
    )


def _definitions(spark, sf, *wanted: str):
    """A name is defined on the first line of the first file that holds it."""
    files = roles.files(spark, sf)
    out = None
    for name in wanted:
        places = ops.find_occurrences(files, spark.createDataFrame([(name,)], "name string"))
        first = places.groupBy("name").agg(F.min(F.struct("filepath", "line")).alias("at"))
        one = first.select(
            F.col("at.filepath").alias("filepath"), "name", F.col("at.line").alias("start_line"), (F.col("at.line") + 2).alias("end_line")
        )
        out = one if out is None else out.unionByName(one)
    return out


def find_references(spark, sf):
    refs = ops.find_references(roles.files(spark, sf), _definitions(spark, sf, TARGET))
    return _plain(refs.select("filepath", "line", "column", "name", "snippet", "kind"))


def find_references_range(spark, sf):
    """Two names; occurrences inside the definitions' line ranges are left out."""
    refs = ops.find_references(roles.files(spark, sf), _definitions(spark, sf, "that", "with"), whole_range=True)
    return _plain(refs.select("filepath", "line", "column", "name"))


def references_by_file(spark, sf):
    return _plain(ops.references_by_file(ops.find_references(roles.files(spark, sf), _definitions(spark, sf, TARGET))))


def grep_context(spark, sf):
    """Capitalised words ending a line, with one line before and two after."""
    found = grep_ops.grep(roles.files(spark, sf), r"[A-Z][a-z]+\.$", before=1, after=2, include="src*/{en,de}/*", exclude="src1/**")
    return _plain(found)


def grep_multiline(spark, sf):
    """Matches that span two lines, per file."""
    found = grep_ops.grep(roles.files(spark, sf), r"\.\n[A-Z][a-z]+ ")
    return found.groupBy("filepath").agg(
        F.count(F.lit(1)).alias("n"), F.sum("match_length").alias("chars"), F.min("line").cast("long").alias("first_line")
    )


def grep_budget(spark, sf):
    found = grep_ops.within_budget(grep_ops.grep(roles.files(spark, sf), r"\bthe\b"), 50_000)
    return _plain(found.select("filepath", "line", "match_start", F.col("used").cast("long").alias("used")))


def matches_by_file(spark, sf):
    return _plain(grep_ops.matches_by_file(grep_ops.grep(roles.files(spark, sf), r"\bthe\b")))


def matched_files(spark, sf):
    return grep_ops.matched_files(grep_ops.grep(roles.files(spark, sf), "tion"))


def files_to_search(spark, sf):
    """Page paths as files: code extensions beat the include glob, excludes always apply."""
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "/?([?#].*)?$", "")
    pages = roles.table(spark, sf, "pages").select(
        F.regexp_replace(path, r"\.html$", ".py").alias("filepath"), F.col("html").alias("content")
    )
    code = grep_ops.files_to_search(pages, include="nothing", code_only=True).select("filepath", F.lit("code").alias("how"))
    kept = grep_ops.files_to_search(pages, include="*.example.*/en/**", exclude="**/9*").select("filepath", F.lit("glob").alias("how"))
    return code.unionByName(kept)


QUERIES = {
    "symbols_overview": symbols_overview,
    "overview_counts": overview_counts,
    "find_symbol_relative": find_symbol_relative,
    "find_symbol_absolute": find_symbol_absolute,
    "find_symbol_prefix": find_symbol_prefix,
    "find_symbol_by_kind": find_symbol_by_kind,
    "find_symbol_pruned": find_symbol_pruned,
    "children_of": children_of,
    "first_symbol_per_file": first_symbol_per_file,
    "name_path_parts": name_path_parts,
    "kind_names": kind_names,
    "find_references": find_references,
    "find_references_range": find_references_range,
    "references_by_file": references_by_file,
    "grep_context": grep_context,
    "grep_multiline": grep_multiline,
    "grep_budget": grep_budget,
    "matches_by_file": matches_by_file,
    "matched_files": matched_files,
    "files_to_search": files_to_search,
}

TREE = """n AS (SELECT n_nationkey, r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey),
tree AS (SELECT r_name || '.tree' AS filepath, r_name AS name, '/' || r_name AS name_path, NULL AS parent_path, 2 AS kind, 0 AS depth, r_regionkey + 1 AS line FROM region
  UNION ALL SELECT r_name || '.tree', n_name, '/' || r_name || '/' || n_name, '/' || r_name, 5, 1, n_nationkey + 1 FROM n
  UNION ALL SELECT r_name || '.tree', c_name, '/' || r_name || '/' || n_name || '/' || c_name, '/' || r_name || '/' || n_name, 6, 2, c_custkey + 1 FROM n JOIN customer ON c_nationkey = n_nationkey
  UNION ALL SELECT r_name || '.tree', s_name, '/' || r_name || '/' || n_name || '/' || s_name, '/' || r_name || '/' || n_name, 12, 2, s_suppkey + 1 FROM n JOIN supplier ON s_nationkey = n_nationkey)"""
_KINDS = "CASE kind WHEN 2 THEN 'Module' WHEN 5 THEN 'Class' WHEN 6 THEN 'Method' WHEN 12 THEN 'Function' END"
_FOUND = "SELECT filepath, name_path, kind::BIGINT AS kind FROM tree WHERE "
# occurrences of a word: split each line at the word and add up the pieces in front of it
OCCURRENCES = LINES + """,
nl AS (SELECT filepath, language, ls, unnest(ls) AS txt, unnest(range(1, len(ls)+1)) AS line FROM lines),
marked AS (SELECT filepath, ls, line, txt, string_split(regexp_replace(txt, '\\b{word}\\b', chr(1), 'g'), chr(1)) AS parts FROM nl),
occ AS (SELECT filepath, ls, line, txt, list_sum([length(x) for x in parts[1:k]])::BIGINT + (k - 1) * {n} AS col FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM marked))"""


def occurrences(word: str) -> str:
    return OCCURRENCES.format(word=word, n=len(word))


_FIRST = "def AS (SELECT filepath AS df, line AS dl FROM occ ORDER BY filepath, line LIMIT 1)"


def _two(word: str) -> str:
    return f"SELECT filepath, line, col AS \"column\", '{word}' AS name FROM (WITH {occurrences(word)}, {_FIRST} SELECT occ.* FROM occ, def WHERE NOT (filepath = df AND line BETWEEN dl AND dl + 2))"


SQL = {
    "symbols_overview": f"""WITH {TREE}, k AS (SELECT parent_path, count(*) AS c FROM tree WHERE parent_path IS NOT NULL GROUP BY 1)
        SELECT filepath, {_KINDS} AS kind_name, name, substr(name_path, 2) AS name_path, line || '-' || line AS lines, coalesce(c, 0) AS children FROM tree LEFT JOIN k ON k.parent_path = name_path WHERE depth <= 1""",
    "overview_counts": f"WITH {TREE} SELECT filepath, {_KINDS} AS kind_name, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY filepath) AS BIGINT) AS total_symbols FROM tree GROUP BY filepath, kind",
    "find_symbol_relative": f"WITH {TREE} {_FOUND} name_path LIKE '%/NATION_3/Customer#%'",
    "find_symbol_absolute": f"WITH {TREE} {_FOUND} name_path = '/ASIA/NATION_2'",
    "find_symbol_prefix": f"WITH {TREE} {_FOUND} filepath = 'ASIA.tree' AND lower(name) LIKE 'supplier#%'",
    "find_symbol_by_kind": f"WITH {TREE} {_FOUND} kind IN (2, 5, 12)",
    "find_symbol_pruned": f"WITH {TREE} {_FOUND} kind = 2",
    "children_of": f"WITH {TREE} SELECT p.kind::BIGINT AS parent_kind, c.kind::BIGINT AS kind, count(*) AS n FROM tree c JOIN tree p ON c.parent_path = p.name_path AND c.filepath = p.filepath GROUP BY 1, 2",
    "first_symbol_per_file": f"WITH {TREE} SELECT filepath, arg_min(name_path, (line, depth, name_path)) AS name_path FROM tree WHERE lower(name) LIKE 'nation%' GROUP BY filepath",
    "name_path_parts": """WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', '') AS p FROM pages),
        s AS (SELECT *, list_filter(string_split(p, '/'), lambda x: x <> '') AS a FROM p),
        r AS (SELECT *, CASE WHEN len(a) > 1 THEN '/' || array_to_string(a[1:-2], '/') END AS parent FROM s)
        SELECT page_id, coalesce(a[-1], '') AS name, parent, greatest(0, len(a) - 1) AS depth, regexp_replace(p, '^/', '') AS shown, coalesce(parent, '') || '/x' AS built,
        coalesce(len(a) >= 2 AND a[-2] = 'en' AND starts_with(a[-1], '9'), false) AS relative, a = ['fr', '825'] AS absolute, coalesce(starts_with(a[-1], '4'), false) AS prefix FROM r""",
    "kind_names": """WITH t AS (SELECT unnest(regexp_extract_all(html, '<(title|article|footer|nav|h1)\\b', 1)) AS tag FROM pages)
        SELECT tag, count(*) AS n, CASE tag WHEN 'h1' THEN 6 WHEN 'nav' THEN 2 ELSE 13 END::BIGINT AS kind, CASE tag WHEN 'h1' THEN 'Method' WHEN 'nav' THEN 'Module' ELSE 'Variable' END AS kind_name,
        CASE WHEN tag = 'nav' THEN 26::BIGINT END AS parsed FROM t GROUP BY tag""",
    "find_references": f"""WITH {occurrences(TARGET)}, {_FIRST}
        SELECT filepath, line, col AS "column", '{TARGET}' AS name, array_to_string(ls[greatest(1, line-1):line+1], chr(10)) AS snippet, 13::BIGINT AS kind FROM occ, def WHERE NOT (filepath = df AND line = dl)""",
    "find_references_range": f"{_two('that')} UNION ALL {_two('with')}",
    "references_by_file": f"""WITH {occurrences(TARGET)}, {_FIRST}
        SELECT filepath, count(*) AS n, min(line) AS first_line, max(line) AS last_line FROM occ, def WHERE NOT (filepath = df AND line = dl) GROUP BY filepath""",
    "grep_context": f"""WITH {LINES}, nl AS (SELECT filepath, language, ls, unnest(ls) AS txt, unnest(range(1, len(ls)+1)) AS line FROM lines),
        m AS (SELECT *, regexp_extract(txt, '[A-Z][a-z]+\\.$') AS hit FROM nl WHERE regexp_matches(txt, '[A-Z][a-z]+\\.$') AND language IN ('en', 'de') AND NOT starts_with(filepath, 'src1/'))
        SELECT filepath, line, length(txt) - length(hit) AS match_start, length(hit) AS match_length, array_to_string(ls[greatest(1, line-1):line+2], chr(10)) AS content FROM m""",
    "grep_multiline": f"""WITH {FILES}, m AS (SELECT filepath, content, regexp_extract_all(content, '\\.\\n[A-Z][a-z]+ ') AS hits FROM files)
        SELECT filepath, len(hits) AS n, list_sum([length(h) for h in hits])::BIGINT AS chars,
        1 + length(content[1:position(hits[1] IN content) - 1]) - length(replace(content[1:position(hits[1] IN content) - 1], chr(10), '')) AS first_line FROM m WHERE len(hits) > 0""",
    "grep_budget": f"""WITH {occurrences('the')}, b AS (SELECT *, coalesce(sum(length(txt) + 50) OVER (ORDER BY filepath, line, col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM occ)
        SELECT filepath, line, col AS match_start, used FROM b WHERE used < 50000""",
    "matches_by_file": f"WITH {occurrences('the')} SELECT filepath, count(*) AS n, min(line) AS first_line, max(line) AS last_line FROM occ GROUP BY filepath",
    "matched_files": "SELECT count(*) AS files FROM documents WHERE contains(text, 'tion')",
    "files_to_search": r"""WITH p AS (SELECT regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '/?([?#].*)?$', ''), '\.html$', '.py') AS filepath FROM pages)
        SELECT filepath, 'code' AS how FROM p WHERE ends_with(filepath, '.py')
        UNION ALL SELECT filepath, 'glob' FROM p WHERE regexp_matches(filepath, '^[^/]*\.example\.[^/]*/en/[^/]+') AND NOT regexp_matches(filepath, '(^|/)9[^/]*$')""",
}
