"""Two snapshots of the documents, and patches made from their lines."""

from pyspark.sql import functions as F

from queries.base import DOCS, documents, hash_sql, query, table
from rulelens.sources.changes import changed_rows, mark_new, parse_hunks
from rulelens.sources.corpus import corpus_from_table, spread_small
from rulelens.sources.diffs import diff_hunks, renamed_rows

# The later snapshot: every 11th document is gone, every 7th edited, every 5th only gets trailing blanks, and
# every 13th has a new neighbour.
_LATER = """SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path,
  CASE WHEN doc_id % 7 = 0 THEN text || ' edited' WHEN doc_id % 5 = 0 THEN text || '  ' ELSE text END AS content
FROM documents WHERE doc_id % 11 <> 0
UNION ALL
SELECT source || '/' || lang || '/new-' || doc_id || '.txt', text || ' new' FROM documents WHERE doc_id % 13 = 0"""


def later(spark, sf):
    docs = table(spark, sf, "documents")
    doc_id, text = F.col("doc_id"), F.col("text")
    folder = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"))
    edited = (
        F.when(doc_id % 7 == 0, F.concat(text, F.lit(" edited")))
        .when(doc_id % 5 == 0, F.concat(text, F.lit("  ")))
        .otherwise(text)
    )
    kept = docs.filter(doc_id % 11 != 0).select(
        F.concat(folder, doc_id, F.lit(".txt")).alias("path"), edited.alias("content")
    )
    added = docs.filter(doc_id % 13 == 0).select(
        F.concat(folder, F.lit("new-"), doc_id, F.lit(".txt")).alias("path"),
        F.concat(text, F.lit(" new")).alias("content"),
    )
    return spread_small(kept.union(added), "path")


@query(
    "changed_rows",
    f"""WITH {DOCS}, later AS ({_LATER}), pairs AS (
  SELECT coalesce(n.path, o.path) AS path, o.content AS before, n.content AS after
  FROM docs o FULL OUTER JOIN later n ON n.path = o.path)
SELECT path, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' ELSE 'modified' END AS change,
  before IS NULL AS is_new
FROM pairs WHERE (before IS NULL OR after IS NULL OR rtrim(before) <> rtrim(after)) AND path NOT LIKE 'src4/%'""",
)
def changed(spark, sf):
    return changed_rows(
        documents(spark, sf), later(spark, sf), globs=["*.txt"], exclude=["src4"], keep_removed=True
    )


@query(
    "mark_new",
    f"WITH {DOCS}, later AS ({_LATER}) SELECT path, path NOT IN (SELECT path FROM docs) AS is_new FROM later",
)
def marked(spark, sf):
    return mark_new(later(spark, sf).select("path"), documents(spark, sf))


# Two hunks per document: all lines as context, added or removed in turn, then all lines as added.
@query(
    "parse_hunks",
    f"""WITH {DOCS}, split AS (SELECT path, doc_id, string_split(content, chr(10)) AS ls FROM docs),
lines AS (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM split),
bodies AS (SELECT path, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE n % 3 <> 0), '') AS kept,
  string_agg(line, chr(10) ORDER BY n) AS full_text FROM lines GROUP BY 1)
SELECT s.path, CAST(1 AS BIGINT) AS hunk_no, CAST(1 + doc_id % 50 AS BIGINT) AS start_line,
  CAST(doc_id % 50 + len(ls) - len(ls) // 3 AS BIGINT) AS end_line, sha256(kept) AS body_sha, 'part ' || doc_id AS header
FROM split s JOIN bodies b ON b.path = s.path
UNION ALL
SELECT s.path, 2, 90, 89 + len(ls), sha256(full_text), '' FROM split s JOIN bodies b ON b.path = s.path""",
)
def hunks(spark, sf):
    lines = F.split("text", "\n")
    marked_lines = F.transform(
        lines,
        lambda line, i: F.concat(
            F.when(i % 3 == 2, "-").when(i % 3 == 1, "+").otherwise(" "), line
        ),
    )
    doc_id = F.col("doc_id")
    patch = F.concat(
        F.lit("--- a/x\n+++ b/x\n@@ -3,"),
        F.size(lines) - F.floor((F.size(lines) + 1) / 3),
        F.lit(" +"),
        1 + doc_id % 50,
        F.lit(","),
        F.size(lines) - F.floor(F.size(lines) / 3),
        F.lit(" @@  part "),
        doc_id,
        F.lit(" \n"),
        F.array_join(marked_lines, "\n"),
        F.lit("\n@@ -70,0 +90,"),
        F.size(lines),
        F.lit(" @@\n"),
        F.array_join(F.transform(lines, lambda line: F.concat(F.lit("+"), line)), "\n"),
    )
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), doc_id, F.lit(".txt"))
    patches = spread_small(table(spark, sf, "documents").select(path.alias("path"), patch.alias("patch")), "path")
    return parse_hunks(patches).select(
        "path",
        F.col("hunk_no").cast("bigint"),
        F.col("start_line").cast("bigint"),
        F.col("end_line").cast("bigint"),
        F.sha2("content", 256).alias("body_sha"),
        "header",
    )


# Another later snapshot, made line by line: every 11th document is gone, every third has one line edited and if its number is
# even a line more, every 13th has a new neighbour.
EDITED = f"""{DOCS}, split AS (
  SELECT path, doc_id, string_split(regexp_replace(content, '\\n$', ''), chr(10)) AS ls FROM docs),
edited AS (
  SELECT path, doc_id, doc_id % 3 = 0 AS touched, false AS is_new, CASE WHEN doc_id % 3 = 0 THEN list_concat(list_transform(ls,
    lambda x, i: CASE WHEN i = 1 + doc_id % len(ls) THEN x || ' edited ' || doc_id ELSE x END),
    CASE WHEN doc_id % 2 = 0 THEN ['added ' || doc_id] ELSE [] END) ELSE ls END AS ls, len(ls) AS n
  FROM split WHERE doc_id % 11 <> 0
  UNION ALL SELECT replace(path, '/' || doc_id || '.txt', '/new-' || doc_id || '.txt'), doc_id, true, true, ls, 0 FROM split WHERE doc_id % 13 = 0),
changed_lines AS (
  SELECT path, is_new, ls, unnest(CASE WHEN is_new THEN range(1, len(ls) + 1) WHEN len(ls) > n THEN list_distinct([1 + doc_id % n, len(ls)])
    ELSE [1 + doc_id % n] END) AS line FROM edited WHERE touched)"""


def edited(spark, sf):
    """The later snapshot that EDITED describes."""
    doc_id = F.col("doc_id")
    docs = documents(spark, sf).withColumn("doc_id", F.regexp_extract("path", r"/([0-9]+)\.txt$", 1).cast("bigint"))
    # As columns of their own the lines are split once for a text, not again for each of its lines.
    lines = F.split(F.regexp_replace("content", r"\n\z", ""), "\n")
    split = docs.filter(doc_id % 11 != 0).withColumn("lines", F.when(doc_id % 3 == 0, lines))
    split = split.withColumn("at", doc_id % F.size("lines"))
    changed = F.transform("lines", lambda x, i: F.when(i == F.col("at"), F.concat(x, F.lit(" edited "), doc_id.cast("string"))).otherwise(x))
    more = F.when(doc_id % 2 == 0, F.array(F.concat(F.lit("added "), doc_id.cast("string")))).otherwise(F.array().cast("array<string>"))
    text = F.when(doc_id % 3 == 0, F.array_join(F.concat(changed, more), "\n")).otherwise(F.col("content"))
    kept = corpus_from_table(split, F.col("path"), text)
    neighbour = F.regexp_replace("path", r"/([0-9]+)\.txt$", "/new-$1.txt")
    return kept.unionByName(corpus_from_table(docs.filter(doc_id % 13 == 0), neighbour, F.col("content")))


@query(
    "diff_hunks",
    f"""WITH {EDITED}, wide AS (
  SELECT *, greatest(1, line - 3) AS a, least(len(ls), line + 3) AS b FROM changed_lines),
begun AS (
  SELECT *, CASE WHEN a <= 1 + max(b) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    THEN 0 ELSE 1 END AS begins FROM wide),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY path ORDER BY line) AS hunk FROM begun)
SELECT path, is_new, CAST(hunk AS BIGINT) AS hunk_no, min(a) AS start_line, max(b) AS end_line, CAST(count(*) AS BIGINT) AS changed,
  sha256(array_to_string(any_value(ls)[min(a):max(b)], chr(10))) AS body_sha FROM numbered GROUP BY path, is_new, hunk""",
)
def diffs(spark, sf):
    found = diff_hunks(documents(spark, sf), edited(spark, sf))
    rows = found.select("path", "is_new", "changed", F.posexplode("hunks").alias("at", "hunk"))
    lines = F.flatten(F.transform("changed", lambda s: F.sequence(s["first_line"], s["last_line"])))
    inside = F.filter(lines, lambda n: (n >= F.col("hunk.start_line")) & (n <= F.col("hunk.end_line")))
    return rows.select(
        "path", "is_new", (F.col("at") + 1).cast("bigint").alias("hunk_no"),
        F.col("hunk.start_line").cast("bigint").alias("start_line"), F.col("hunk.end_line").cast("bigint").alias("end_line"),
        F.size(inside).cast("bigint").alias("changed"), F.sha2("hunk.content", 256).alias("body_sha"),
    )


# Every fifth document moves to another folder, with a line more if its number is even.
@query(
    "renamed_rows",
    f"""WITH {DOCS}, gone AS (SELECT path AS old_path, doc_id, content FROM docs WHERE doc_id % 5 = 0),
come AS (SELECT 'moved/' || doc_id || '.txt' AS path, content || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'moved ' || doc_id ELSE '' END
  AS content FROM gone),
left_rows AS (SELECT *, {hash_sql('content')} AS hash, row_number() OVER (PARTITION BY {hash_sql('content')} ORDER BY old_path) AS place FROM gone),
right_rows AS (SELECT *, {hash_sql('content')} AS hash, row_number() OVER (PARTITION BY {hash_sql('content')} ORDER BY path) AS place FROM come),
same AS (SELECT old_path, path FROM left_rows JOIN right_rows USING (hash, place)),
l1 AS (SELECT old_path, unnest(list_distinct(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> ''))) AS line
  FROM gone WHERE old_path NOT IN (SELECT old_path FROM same)),
l2 AS (SELECT path, unnest(list_distinct(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> ''))) AS line
  FROM come WHERE path NOT IN (SELECT path FROM same)),
n1 AS (SELECT old_path, count(*) AS n FROM l1 GROUP BY 1), n2 AS (SELECT path, count(*) AS n FROM l2 GROUP BY 1),
o1 AS (SELECT line, min(old_path) AS old_path FROM l1 GROUP BY 1 HAVING count(*) = 1),
o2 AS (SELECT line, min(path) AS path FROM l2 GROUP BY 1 HAVING count(*) = 1),
pairs AS (SELECT old_path, path, count(*) AS lines FROM o1 JOIN o2 USING (line) GROUP BY 1, 2),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY old_path ORDER BY lines DESC, path) = 1
  AND row_number() OVER (PARTITION BY path ORDER BY lines DESC, old_path) = 1),
percent AS (SELECT old_path, path, 100 * lines // least(n1.n, n2.n) AS shared FROM best JOIN n1 USING (old_path) JOIN n2 USING (path))
SELECT old_path, path, CAST(100 AS BIGINT) AS shared FROM same
UNION ALL SELECT old_path, path, CAST(shared AS BIGINT) FROM percent WHERE shared >= 50""",
)
def renamed(spark, sf):
    docs = documents(spark, sf)
    doc_id = F.regexp_extract("path", r"/([0-9]+)\.txt$", 1).cast("bigint")
    more = F.when(doc_id % 2 == 0, F.concat(F.lit("\nmoved "), doc_id.cast("string"))).otherwise(F.lit(""))
    moved = corpus_from_table(
        docs.filter(doc_id % 5 == 0), F.concat(F.lit("moved/"), doc_id.cast("string"), F.lit(".txt")), F.concat("content", more)
    )
    found = renamed_rows(docs, docs.filter(doc_id % 5 != 0).unionByName(moved))
    return found.withColumn("shared", F.col("shared").cast("bigint"))
