"""Rename, line-edit, note and issue queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.chunks import LINES
from catalog.symbols import TARGET, _definitions, _plain, occurrences
from passagemill.functions.text import join_lines
from passagemill.operators import edits, issues, notes
from passagemill.operators.symbols import find_references
from passagemill.plans import roles

NEW = "renamedWord"


def _targets(spark, sf):
    defined = _definitions(spark, sf, TARGET)
    return edits.rename_targets(find_references(roles.files(spark, sf), defined), defined)


def rename_dry_run(spark, sf):
    renamed = edits.rename(roles.files(spark, sf), _targets(spark, sf), TARGET, NEW, dry_run=True)
    return renamed.select("filepath", F.col("replacements").cast("long").alias("replacements"))


def rename_apply(spark, sf):
    renamed = edits.rename(roles.files(spark, sf), _targets(spark, sf), TARGET, NEW)
    return renamed.select("filepath", F.col("replacements").cast("long").alias("replacements"), "content")


def rename_some_lines(spark, sf):
    """Only the second and the last line of a file are targets."""
    files = roles.files(spark, sf)
    size = F.size(F.split("content", "\n", -1))
    lines = files.select("filepath", F.explode(F.array(F.lit(2), size)).alias("line"))
    renamed = edits.rename(files, lines.filter("line >= 1"), "the", NEW)
    return renamed.select("filepath", F.col("replacements").cast("long").alias("replacements"), "content")


def rename_totals(spark, sf):
    renamed = edits.rename(roles.files(spark, sf), _targets(spark, sf), TARGET, NEW, dry_run=True)
    return edits.replacement_totals(renamed)


def valid_identifiers(spark, sf):
    first = F.element_at(F.split("text", "[ \n]"), 1)
    return roles.table(spark, sf, "documents").select("doc_id", edits.valid_identifier(first).alias("valid"))


BODY = "    first\n\n      second\n   \n    third"


def apply_line_edits(spark, sf):
    """One edit per file, its kind by language: replace lines 2-3, or insert before or after line 2."""
    files = roles.files(spark, sf).withColumn("content", F.regexp_replace("content", "\n", "\n  "))
    size = F.size(F.split("content", "\n", -1))
    action = (
        F.when(F.col("language") == "en", F.lit("replace"))
        .when(F.col("language") == "fr", F.lit("insert_before"))
        .otherwise(F.lit("insert_after"))
    )
    wanted = files.select(
        "filepath", action.alias("action"), F.least(F.lit(2), size).alias("start_line"),
        F.least(F.lit(3), size).alias("end_line"), F.lit(BODY).alias("body"),
    )
    done = edits.apply_line_edits(files, wanted)
    return done.select(
        "filepath", "content", F.col("new_start").cast("long").alias("new_start"), F.col("new_end").cast("long").alias("new_end")
    )


def reindent(spark, sf):
    """Texts indented by the length of their language's first line break run."""
    shifted = F.concat(F.lit("   "), F.regexp_replace("content", "\n", "\n     "))
    return roles.files(spark, sf).select("filepath", join_lines(edits.reindent(shifted, F.lit("\t"))).alias("content"))


def upsert_latest(spark, sf):
    """First turns are stored, all later turns written over them."""
    writes = roles.notes(spark, sf)
    stored = writes.filter("modified_at = 0")
    return notes.upsert_docs(stored, writes.filter("modified_at > 0"))


def _current_notes(spark, sf):
    return notes.latest(roles.notes(spark, sf))


def list_docs(spark, sf):
    return notes.list_docs(_current_notes(spark, sf)).withColumn("size", F.col("size").cast("long"))


def docs_exist(spark, sf):
    asked = roles.table(spark, sf, "labels").select(F.concat(F.lit("note-"), F.col("doc_id").cast("string")).alias("name")).distinct()
    return notes.docs_exist(asked, _current_notes(spark, sf))


def delete_docs(spark, sf):
    gone = roles.table(spark, sf, "labels").select(F.concat(F.lit("note-"), F.col("doc_id").cast("string")).alias("name")).distinct()
    return notes.delete_docs(_current_notes(spark, sf), gone).select("name", "modified_at")


def _edited(df):
    return df.select("name", "content", F.col("match_count").cast("long").alias("match_count"))


def edit_docs_literal(spark, sf):
    return _edited(notes.edit_docs(_current_notes(spark, sf), "en.", "EN!", "literal"))


def edit_docs_regex(spark, sf):
    return _edited(notes.edit_docs(_current_notes(spark, sf), "^[A-Z]([a-z]+) ", "<$1> ", "regex"))


def issue_counts(spark, sf):
    return issues.issue_counts(roles.issues(spark, sf))


def facet_filter(spark, sf):
    kept = issues.facet_filter(issues.issue_view(roles.issues(spark, sf), "open"), " CUSTOMER 1", "none")
    return kept.select("id", "title", "status")


def facet_filter_page(spark, sf):
    """Third page of the ready issues that mention 7 and have priority 2, by title."""
    ready = issues.issue_view(roles.issues(spark, sf), "ready")
    ordered = issues.order_issues(issues.facet_filter(ready, "7", 2), "alpha-desc")
    return _plain(issues.page(ordered, 3).select("id", "title", "description"))


def issues_by_priority(spark, sf):
    """First page, most urgent first; issues without priority come last."""
    ordered = issues.order_issues(roles.issues(spark, sf), "priority-asc")
    return issues.page(ordered, 1, 25).select("id", F.col("priority").cast("long").alias("priority"))


QUERIES = {
    "rename_dry_run": rename_dry_run,
    "rename_apply": rename_apply,
    "rename_some_lines": rename_some_lines,
    "rename_totals": rename_totals,
    "valid_identifiers": valid_identifiers,
    "apply_line_edits": apply_line_edits,
    "reindent": reindent,
    "upsert_latest": upsert_latest,
    "list_docs": list_docs,
    "docs_exist": docs_exist,
    "delete_docs": delete_docs,
    "edit_docs_literal": edit_docs_literal,
    "edit_docs_regex": edit_docs_regex,
    "issue_counts": issue_counts,
    "facet_filter": facet_filter,
    "facet_filter_page": facet_filter_page,
    "issues_by_priority": issues_by_priority,
}

# every line holding the word is a target, so renaming the targets is renaming everywhere
_RENAMED = f"""WITH {occurrences(TARGET)}, hits AS (SELECT filepath, count(*) AS replacements FROM occ GROUP BY filepath)"""
_NOTES = """cur AS (SELECT 'note-' || conv_id AS name, arg_max(text, turn) AS content, max(turn) AS modified_at FROM conversations GROUP BY conv_id)"""
_ISSUES = """issues AS (SELECT 'T-' || o_orderkey AS id, 'Order ' || o_orderkey AS title, 'customer ' || o_custkey AS description,
  CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'blocked' ELSE 'closed' END AS status, nullif(CAST(substr(o_orderpriority, 1, 1) AS BIGINT), 5) AS priority FROM orders)"""

SQL = {
    "rename_dry_run": f"{_RENAMED} SELECT * FROM hits",
    "rename_apply": f"{_RENAMED} SELECT filepath, replacements, regexp_replace(content, '\\b{TARGET}\\b', '{NEW}', 'g') AS content FROM hits JOIN files USING (filepath)",
    "rename_some_lines": f"""WITH {LINES}, nl AS (SELECT filepath, len(ls) AS n, unnest(ls) AS txt, unnest(range(1, len(ls)+1)) AS line FROM lines),
        t AS (SELECT *, line = n OR line = 2 AS hit FROM nl),
        r AS (SELECT filepath, sum(CASE WHEN hit THEN len(regexp_extract_all(txt, '\\bthe\\b')) ELSE 0 END)::BIGINT AS replacements,
          string_agg(CASE WHEN hit THEN regexp_replace(txt, '\\bthe\\b', '{NEW}', 'g') ELSE txt END, chr(10) ORDER BY line) AS content FROM t GROUP BY filepath)
        SELECT * FROM r WHERE replacements > 0""",
    "rename_totals": f"{_RENAMED} SELECT count(*) AS files, CAST(sum(replacements) AS BIGINT) AS replacements FROM hits",
    "valid_identifiers": "SELECT doc_id, regexp_matches(regexp_extract(text, '^[^ \\n]*'), '^[a-zA-Z_][a-zA-Z0-9_]*$') AS valid FROM documents",
    "apply_line_edits": f"""WITH {LINES}, f AS (SELECT filepath, language, string_split(replace(content, chr(10), chr(10) || '  '), chr(10)) AS ls FROM files),
        e AS (SELECT *, least(2, len(ls)) AS s, least(3, len(ls)) AS e, CASE WHEN len(ls) > 1 THEN '  ' ELSE '' END AS ind FROM f),
        b AS (SELECT *, [ind || 'first', '', ind || '  second', '', ind || 'third'] AS body FROM e),
        p AS (SELECT *, CASE WHEN language = 'en' OR language = 'fr' THEN s - 1 ELSE e END AS cut, CASE WHEN language = 'fr' THEN s ELSE e + 1 END AS resume,
          CASE WHEN language NOT IN ('en', 'fr') AND trim(ls[e]) <> '' THEN [''] ELSE [] END AS above, CASE WHEN language = 'fr' AND trim(ls[s]) <> '' THEN [''] ELSE [] END AS below FROM b)
        SELECT filepath, array_to_string(list_concat(list_concat(list_concat(list_concat(CASE WHEN cut > 0 THEN ls[1:cut] ELSE [] END, above), body), below), ls[resume:]), chr(10)) AS content,
        cut + len(above) + 1 AS new_start, cut + len(above) + 5 AS new_end FROM p""",
    "reindent": f"""WITH {LINES} SELECT filepath, array_to_string([CASE WHEN i = 1 THEN CASE WHEN trim(ls[1]) = '' THEN '' ELSE chr(9) || ls[1] END ELSE CASE WHEN trim(ls[i]) = '' THEN '' ELSE chr(9) || '  ' || ls[i] END END
        for i in range(1, len(ls)+1)], chr(10)) AS content FROM lines""",
    "upsert_latest": f"WITH {_NOTES} SELECT name, content, modified_at FROM cur",
    "list_docs": f"WITH {_NOTES} SELECT name, strlen(content) AS size, modified_at FROM cur",
    "docs_exist": f"WITH {_NOTES} SELECT DISTINCT 'note-' || doc_id AS name, 'note-' || doc_id IN (SELECT name FROM cur) AS found FROM labels",
    "delete_docs": f"WITH {_NOTES} SELECT name, modified_at FROM cur WHERE name NOT IN (SELECT 'note-' || doc_id FROM labels)",
    "edit_docs_literal": f"WITH {_NOTES} SELECT name, replace(content, 'en.', 'EN!') AS content, (length(content) - length(replace(content, 'en.', ''))) // 3 AS match_count FROM cur",
    "edit_docs_regex": f"WITH {_NOTES} SELECT name, regexp_replace(content, '(?ms)^[A-Z]([a-z]+) ', '<\\1> ', 'g') AS content, len(regexp_extract_all(content, '(?ms)^[A-Z]([a-z]+) ')) AS match_count FROM cur",
    "issue_counts": f"WITH {_ISSUES} SELECT count(*) FILTER (status = 'open') AS ready, count(*) FILTER (status <> 'closed') AS open, count(*) AS total FROM issues",
    "facet_filter": f"WITH {_ISSUES} SELECT id, title, status FROM issues WHERE status <> 'closed' AND contains(description, 'customer 1') AND priority IS NULL",
    "facet_filter_page": f"""WITH {_ISSUES} SELECT id, title, description FROM issues WHERE status = 'open' AND priority = 2 AND (contains(title, '7') OR contains(description, '7'))
        ORDER BY title DESC, id LIMIT 10 OFFSET 20""",
    "issues_by_priority": f"WITH {_ISSUES} SELECT id, priority FROM issues ORDER BY coalesce(priority, 999) DESC, id LIMIT 25",
}
