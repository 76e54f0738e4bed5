"""Operators over the line detector's findings on all documents."""

from pyspark.sql import functions as F

from queries.base import (
    CAPPED,
    DOCS,
    PARTED,
    FINDINGS,
    RULES,
    document_findings,
    documents,
    query,
    quoted,
    rules_sql,
)
from rulelens.functions.findings import cached_form, findings_from_json, findings_to_json, issue_id, location_str
from rulelens.operators.findings import (
    all_findings,
    attach_snippet,
    dedup_findings,
    drop_disabled,
    enrich_findings,
    filter_rules,
    findings_by_category,
    findings_by_level,
    findings_by_path,
    findings_by_tag,
    findings_for_rule,
    findings_of_packs,
    limit_per_path,
)
from rulelens.operators.outline import prose_spans, section_context
from rulelens.operators.spans import enclosing_span
from rulelens.packs import HOUSE, PACKS
from rulelens.plans.storage import materialize
from rulelens.sources.rules import overlay_rules, rules_df

_COLUMNS = "path, start_line, rule_id, level, issue_id"


def _plain(df):
    return df.select("path", F.col("start_line").cast("bigint"), "rule_id", "level", "issue_id")


def _select(where, ctes=""):
    return f"{FINDINGS}{ctes} SELECT {_COLUMNS} FROM findings WHERE {where}"


@query("filter_rules", _select("rule_id LIKE '%privacy%' OR rule_id LIKE '%junk%'"))
def filtered(spark, sf):
    return _plain(filter_rules(document_findings(spark, sf), ["privacy", "junk"]))


@query("drop_disabled", _select("rule_id NOT IN ('quality/symbol-junk', 'privacy')"))
def not_disabled(spark, sf):
    return _plain(drop_disabled(document_findings(spark, sf), ["quality/symbol-junk", "privacy"]))


@query("findings_of_packs", _select("pack IN ('prose')"))
def of_packs(spark, sf):
    known = [p.name for p in [*PACKS, HOUSE]]
    return _plain(findings_of_packs(document_findings(spark, sf), known, ["prose", "web", "house"], ["house"]))


@query("findings_by_tag", _select("rule_id IN (SELECT rule_id FROM rules WHERE tags LIKE '%pii%')", f",\n{rules_sql()}"))
def by_tag(spark, sf):
    return _plain(findings_by_tag(document_findings(spark, sf), rules_df(spark, RULES), "pii"))


@query(
    "findings_by_category",
    _select("rule_id IN (SELECT rule_id FROM rules WHERE category = 'quality')", f",\n{rules_sql()}"),
)
def by_category(spark, sf):
    return _plain(findings_by_category(document_findings(spark, sf), rules_df(spark, RULES), "quality"))


@query("findings_by_level", _select("level = 'major'"))
def by_level(spark, sf):
    return _plain(findings_by_level(document_findings(spark, sf), "major"))


@query("findings_for_rule", _select("rule_id = 'email' OR rule_id LIKE '%/email'"))
def for_rule(spark, sf):
    return _plain(findings_for_rule(document_findings(spark, sf), "email"))


@query(
    "enrich_findings",
    f"""{FINDINGS}, {rules_sql()} SELECT f.path, f.start_line, f.rule_id, f.level, f.issue_id, r.name AS rule_name,
  r.category, r.fix FROM findings f JOIN rules r ON r.rule_id = f.rule_id""",
)
def enriched(spark, sf):
    joined = enrich_findings(document_findings(spark, sf), rules_df(spark, RULES))
    return joined.select(
        "path", F.col("start_line").cast("bigint"), "rule_id", "level", "issue_id", "rule_name", "category", "fix"
    )


@query(
    "enrich_unknown_rules",
    f"""{FINDINGS}, {rules_sql(RULES[::2])} SELECT f.path, f.start_line, f.rule_id, f.issue_id, r.name AS rule_name, r.category
FROM findings f LEFT JOIN rules r ON r.rule_id = f.rule_id""",
)
def enriched_in_part(spark, sf):
    """Findings of rules that are not in the table stay, without a name."""
    joined = enrich_findings(document_findings(spark, sf), rules_df(spark, RULES[::2]))
    return joined.select("path", F.col("start_line").cast("bigint"), "rule_id", "issue_id", "rule_name", "category")


# All packs as layers of one rule table, the overlay last: which rule of each id counts, and what it found.
_LAYERED = [(layer, place, rule) for layer, pack in enumerate([*PACKS, HOUSE]) for place, rule in enumerate(pack.rules)]
_LAYERS_SQL = "layered(layer, place, rule_id, pack, level) AS (VALUES " + ", ".join(
    f"({layer}, {place}, {quoted(r.rule_id)}, {quoted(r.pack)}, {quoted(r.level)})" for layer, place, r in _LAYERED
) + ")"


@query(
    "overlay_rules",
    f"""{FINDINGS}, {_LAYERS_SQL}, composed AS (
  SELECT rule_id, min(layer * 1000 + place) AS place, arg_max(pack, layer * 1000 + place) AS pack,
    arg_max(level, layer * 1000 + place) AS level FROM layered GROUP BY 1)
SELECT c.rule_id, CAST(c.place AS BIGINT) AS place, c.pack, c.level, CAST(count(f.path) AS BIGINT) AS findings
FROM composed c LEFT JOIN findings f ON f.rule_id = c.rule_id AND f.level = c.level GROUP BY ALL""",
)
def overlaid(spark, sf):
    rules = rules_df(spark, [rule for _, _, rule in _LAYERED]).drop("triggers", "examples", "checklist", "tags")
    places = spark.createDataFrame([(layer, place, r.rule_id, r.pack) for layer, place, r in _LAYERED], "layer int, place int, rule_id string, pack string")
    composed = overlay_rules(rules.join(places, ["rule_id", "pack"]))
    found = document_findings(spark, sf).groupBy("rule_id", "level").agg(F.count(F.lit(1)).alias("findings"))
    counted = composed.join(found, ["rule_id", "level"], "left")
    place = (F.col("layer") * 1000 + F.col("place")).cast("bigint").alias("place")
    return counted.select("rule_id", place, "pack", "level", F.coalesce("findings", F.lit(0)).cast("bigint").alias("findings"))


# A second, overlapping delivery of the privacy findings with its own confidence.
_AGAIN = """again AS (
  SELECT *, true AS cached, 1.0 AS confidence FROM findings WHERE rule_id LIKE 'privacy/%'
  UNION ALL SELECT *, false, 1.0 FROM findings
  UNION ALL SELECT *, false, 0.5 FROM findings)"""


def _twice(spark, sf):
    found = document_findings(spark, sf)
    privacy = filter_rules(found, ["privacy/"])
    return all_findings(privacy, found.union(found.withColumn("confidence", F.lit(0.5))))


@query("all_findings", f"{FINDINGS}, {_AGAIN} SELECT {_COLUMNS}, cached, CAST(confidence AS DOUBLE) AS confidence FROM again")
def everything(spark, sf):
    both = _twice(spark, sf)
    return both.select("path", F.col("start_line").cast("bigint"), "rule_id", "level", "issue_id", "cached", "confidence")


@query(
    "dedup_findings",
    f"""{FINDINGS}, {_AGAIN}, ranked AS (SELECT *, row_number() OVER (
  PARTITION BY path, issue_id ORDER BY cached DESC, confidence DESC) AS rn FROM again)
SELECT {_COLUMNS}, cached, CAST(confidence AS DOUBLE) AS confidence FROM ranked WHERE rn = 1""",
)
def deduped(spark, sf):
    one = dedup_findings(_twice(spark, sf))
    return one.select("path", F.col("start_line").cast("bigint"), "rule_id", "level", "issue_id", "cached", "confidence")


@query("limit_per_path", f"{FINDINGS}, {CAPPED} SELECT {_COLUMNS} FROM capped")
def capped(spark, sf):
    return _plain(limit_per_path(document_findings(spark, sf)))


@query(
    "findings_by_path",
    f"""{FINDINGS}, {PARTED} SELECT path, part, CAST(count(*) AS BIGINT) AS findings,
  string_agg(level || '@' || start_line || ' ' || rule_id, '; ' ORDER BY
    CASE level WHEN 'blocker' THEN 0 WHEN 'critical' THEN 1 WHEN 'major' THEN 2 WHEN 'minor' THEN 3 ELSE 4 END,
    start_line, rule_id, issue_id) AS listing
FROM parted GROUP BY path, part""",
)
def grouped(spark, sf):
    listing = F.transform(
        "entries", lambda e: F.concat(e["level"], F.lit("@"), e["start_line"], F.lit(" "), e["rule_id"])
    )
    return findings_by_path(document_findings(spark, sf)).select(
        "path", F.col("part").cast("bigint"), "findings", F.array_join(listing, "; ").alias("listing")
    )


_ENDS = "CASE start_line % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN start_line ELSE start_line + 2 END"


@query(
    "issue_id",
    f"""{FINDINGS}, ends AS (SELECT *, {_ENDS} AS end_line FROM findings), located AS (SELECT *,
  path || ':' || start_line || CASE WHEN end_line IS NOT NULL AND end_line <> 0 AND end_line <> start_line
    THEN '-' || end_line ELSE '' END AS location FROM ends)
SELECT location, rule_id, left(sha256(rule_id || ':' || location || ':' || title), 12) AS issue_id FROM located""",
)
def ids(spark, sf):
    found = document_findings(spark, sf).withColumn("end_line", F.expr(_ENDS).cast("int"))
    place = (F.col("path"), F.col("start_line"), F.col("end_line"))
    return found.select(
        location_str(*place).alias("location"),
        "rule_id",
        issue_id(F.col("rule_id"), *place, F.col("title")).alias("issue_id"),
    )


@query(
    "snippets",
    f"""{FINDINGS}, near AS (
  SELECT f.path, f.rule_id, f.start_line, l.line_no,
    CASE WHEN l.line_no BETWEEN f.start_line AND f.start_line + 1 THEN '>' ELSE ' ' END || ' '
      || lpad(CAST(l.line_no AS VARCHAR), 4, ' ') || ' | ' || l.line AS text
  FROM findings f JOIN lines l ON l.path = f.path AND l.line_no BETWEEN f.start_line - 2 AND f.start_line + 3)
SELECT path, rule_id, start_line, string_agg(text, chr(10) ORDER BY line_no) AS snippet
FROM near GROUP BY 1, 2, 3""",
)
def snippets(spark, sf):
    found = document_findings(spark, sf).withColumn("end_line", F.col("start_line") + 1)
    stored = materialize(found, "findings")
    return attach_snippet(stored, documents(spark, sf)).select(
        "path", "rule_id", F.col("start_line").cast("bigint"), "snippet"
    )


# Sections of 20 lines as classes, paragraphs of 6 lines as functions; a paragraph that fits a section is its child.
_SPANS = """spans AS (
  SELECT path, 'class' AS kind, 'Part' || (n // 20) AS name, n AS first, n + 19 AS last, 20 AS len,
    1000000 + n // 20 AS id, -1 AS parent FROM heads WHERE n % 20 = 1
  UNION ALL
  SELECT path, 'function', 'par' || (n // 6), n, n + 5, 6, n // 6,
    CASE WHEN (n - 1) // 20 = (n + 4) // 20 AND n // 6 % 3 > 0 THEN 1000000 + (n - 1) // 20 ELSE -1 END
  FROM heads WHERE n % 6 = 1)"""


@query(
    "enclosing_span",
    f"""{FINDINGS}, hit AS MATERIALIZED (SELECT path, start_line, rule_id FROM findings),
heads AS MATERIALIZED (SELECT path, line_no AS n FROM lines WHERE path IN (SELECT path FROM hit)),
{_SPANS.replace('spans AS (', 'spans AS MATERIALIZED (')},
classes AS MATERIALIZED (SELECT f.path, f.start_line, f.rule_id, s.name, s.id FROM hit f LEFT JOIN spans s
  ON s.path = f.path AND s.kind = 'class' AND s.first = (f.start_line - 1) // 20 * 20 + 1),
functions AS MATERIALIZED (SELECT f.path, f.start_line, f.rule_id, s.name, s.parent FROM hit f LEFT JOIN spans s
  ON s.path = f.path AND s.kind = 'function' AND s.first = (f.start_line - 1) // 6 * 6 + 1)
SELECT c.path, c.start_line, c.rule_id, CASE
  WHEN f.parent = c.id THEN 'in class ' || c.name || '.' || f.name || '()'
  WHEN f.name IS NOT NULL THEN 'in function ' || f.name
  WHEN c.name IS NOT NULL THEN 'in class ' || c.name END AS context
FROM classes c JOIN functions f ON f.path = c.path AND f.start_line = c.start_line AND f.rule_id = c.rule_id""",
)
def enclosing(spark, sf):
    heads = documents(spark, sf).select("path", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    n = F.col("pos") + 1
    section = (n / 20).cast("int")
    paragraph = (n / 6).cast("int")
    classes = heads.filter(n % 20 == 1).select(
        "path",
        (F.lit(1000000) + section).alias("span_id"),
        F.lit(-1).alias("parent_id"),
        F.lit("class").alias("kind"),
        F.concat(F.lit("Part"), section).alias("name"),
        n.alias("start_line"),
        (n + 19).alias("end_line"),
    )
    inside = (F.floor((n - 1) / 20) == F.floor((n + 4) / 20)) & (paragraph % 3 > 0)
    functions = heads.filter(n % 6 == 1).select(
        "path",
        paragraph.alias("span_id"),
        F.when(inside, F.lit(1000000) + F.floor((n - 1) / 20).cast("int")).otherwise(-1).alias("parent_id"),
        F.lit("function").alias("kind"),
        F.concat(F.lit("par"), paragraph).alias("name"),
        n.alias("start_line"),
        (n + 5).alias("end_line"),
    )
    stored = materialize(document_findings(spark, sf), "findings")
    return enclosing_span(stored, classes.union(functions)).select(
        "path", F.col("start_line").cast("bigint"), "rule_id", "context"
    )


@query(
    "findings_roundtrip",
    f"""{FINDINGS} SELECT path, start_line, rule_id, level, title, why, pack, CAST(1.0 AS DOUBLE) AS confidence,
  'regex' AS source FROM findings""",
)
def roundtrip(spark, sf):
    found = document_findings(spark, sf)
    whole = F.struct(*[F.col(c) for c in found.columns])
    text = findings_to_json(F.array(cached_form(whole)))
    back = found.select(F.explode(findings_from_json(text)).alias("f"))
    return back.select(
        "f.location.path",
        F.col("f.location.start_line").cast("bigint").alias("start_line"),
        "f.rule_id",
        "f.level",
        "f.title",
        "f.why",
        "f.pack",
        "f.confidence",
        "f.source",
    )


# The documents with a heading before every sixth line and a blank line before every fourth.
_PROSE = """split AS (SELECT path, string_split(regexp_replace(content, '\\n$', ''), chr(10)) AS ls FROM docs),
made AS (SELECT path, flatten(list_transform(ls, lambda x, i: list_concat(
  CASE WHEN i % 12 = 1 THEN ['# Part ' || (i // 12)] WHEN i % 6 = 1 THEN ['## Half ' || (i // 6)] ELSE [] END,
  CASE WHEN i % 4 = 1 THEN [''] ELSE [] END, [x]))) AS ls FROM split),
mlines AS MATERIALIZED (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS n, len(ls) AS size FROM made),
kinds AS MATERIALIZED (SELECT *, CASE WHEN starts_with(line, '# Part ') THEN 1 WHEN starts_with(line, '## Half ') THEN 2 ELSE 0 END AS depth FROM mlines),
sections AS MATERIALIZED (SELECT path, line AS title, depth, n AS first, coalesce(lead(n) OVER (PARTITION BY path ORDER BY n), size + 1) - 1 AS next_any,
  coalesce(min(CASE WHEN depth = 1 THEN n END) OVER (PARTITION BY path ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), size + 1) - 1 AS next_part
  FROM kinds WHERE depth > 0)"""


def _prose(spark, sf):
    lines = F.split(F.regexp_replace("content", r"\n\z", ""), "\n")

    def with_marks(x, i):
        number = i + 1
        none = F.array().cast("array<string>")
        part = F.concat(F.lit("# Part "), F.floor(number / 12).cast("string"))
        half = F.concat(F.lit("## Half "), F.floor(number / 6).cast("string"))
        head = F.when(number % 12 == 1, F.array(part)).when(number % 6 == 1, F.array(half)).otherwise(none)
        return F.concat(head, F.when(number % 4 == 1, F.array(F.lit(""))).otherwise(none), F.array(x))

    text = F.array_join(F.flatten(F.transform(lines, with_marks)), "\n")
    return materialize(documents(spark, sf).select("path", text.alias("content")), "prose")


@query(
    "prose_sections",
    f"""WITH {DOCS}, {_PROSE}
SELECT path, CASE depth WHEN 1 THEN substr(title, 3) ELSE substr(title, 4) END AS name, CAST(depth AS BIGINT) AS depth,
  CAST(first AS BIGINT) AS start_line, CAST(CASE depth WHEN 1 THEN next_part ELSE next_any END AS BIGINT) AS end_line FROM sections""",
)
def sections_of_prose(spark, sf):
    spans = prose_spans(_prose(spark, sf)).filter("kind = 'section'")
    return spans.select("path", "name", *[F.col(c).cast("bigint") for c in ("depth", "start_line", "end_line")])


@query(
    "section_context",
    f"""WITH {DOCS}, {_PROSE}, points AS (SELECT path, n FROM kinds WHERE n % 5 = 2),
around AS (SELECT p.path, p.n, string_agg(CASE depth WHEN 1 THEN substr(title, 3) ELSE substr(title, 4) END, ' / ' ORDER BY first) AS names
  FROM points p JOIN sections s ON s.path = p.path AND s.first <= p.n AND p.n <= CASE depth WHEN 1 THEN next_part ELSE next_any END GROUP BY 1, 2)
SELECT path, CAST(n AS BIGINT) AS start_line, 'in section ' || names AS context FROM points JOIN around USING (path, n)
WHERE EXISTS (SELECT 1 FROM kinds k WHERE k.path = points.path AND k.n = points.n)""",
)
def context_in_sections(spark, sf):
    """The sections around every fifth line, against a join of all lines with all sections of their text."""
    prose = _prose(spark, sf)
    points = prose.select("path", F.posexplode(F.split("content", "\n")).alias("at", "line")).filter("(at + 1) % 5 = 2")
    points = points.select("path", (F.col("at") + 1).alias("start_line"), F.concat_ws(":", "path", "at").alias("issue_id"), F.lit(None).cast("string").alias("context"))
    found = section_context(materialize(points, "points"), prose)
    return found.select("path", F.col("start_line").cast("bigint"), "context")
