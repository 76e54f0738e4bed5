"""Quality rules: a table of thresholds compiled into one projection of length, symbol, stop-word and line ratios."""

from dataclasses import dataclass

from pyspark.sql import functions as F

from rulelens.llm.fence import fenced

WORD_BREAK = "[\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SENTENCE_MARKS = ".,;:"
WINDOW = 8

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = tuple(
    """the of and to in a is that for it as was with on be by this are or from at which not have
    der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an
    de la le et les un du une que est pour qui dans par il au ne sur pas plus
    el en y los se del las por con no su para al lo como más""".split()
)


@dataclass(frozen=True)
class Threshold:
    """A document fails if 100 * `count` is below (`least`) or above (`most`) so many percent of `total`."""

    name: str
    count: str
    total: str
    least: int | None = None
    most: int | None = None

    def sql(self):
        """The failing condition, the same text in Spark and in other SQL engines."""
        tests = [f"100 * {self.count} {sign} {bound} * {self.total}"
                 for sign, bound in (("<", self.least), (">", self.most)) if bound is not None]
        return "(" + " OR ".join(tests) + ")"


# The contract's own rules, then the method's. A mean word has 2 to 15 characters.
BASE = (
    Threshold("too_short", "n_words", "1", least=2000),
    Threshold("repeated_words", "n_repeat_words", "n_words", most=30),
)
RULES = (
    Threshold("word_length", "word_chars", "n_words", least=200, most=1500),
    Threshold("symbols", "n_symbols", "n_words", most=10),
    Threshold("stop_words", "n_stop_words", "n_words", least=3),
    Threshold("repeated_lines", "n_dup_lines", "n_lines", most=50),
)
METRICS = ("n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")


def _failed(rules):
    return F.expr(" OR ".join(rule.sql() for rule in rules))


def _metrics(rows, keep):
    """The column `keep` with the counts of a text column `text` that is never null."""
    word = F.filter(F.split("text", WORD_BREAK, -1), lambda w: w != "")
    line = F.filter(F.split("text", "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    rows = rows.withColumns({"_words": word, "_lines": line})
    starts = F.sequence(F.lit(0), F.size("_words") - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(F.col("_words"), i + 1, WINDOW)))
    rows = rows.withColumn("_windows", F.when(F.size("_words") >= WINDOW, hashes))
    # Only texts with a window found twice are looked at more closely: windows sorted by hash, then place.
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_placed", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), placed))

    def twice(x, k):
        after = F.get(F.col("_placed"), k + 1)["h"]
        before = F.get(F.col("_placed"), k - 1)["h"]
        return (after == x["h"]) | (F.coalesce(before == x["h"], F.lit(False)))

    def known(x, k):
        return F.coalesce(twice(x, k), F.lit(False))

    again = F.array_sort(F.transform(F.filter("_placed", known), lambda x: x["i"]))
    rows = rows.withColumn("_again", again)
    # A window covers its words up to the next such window.
    covers = F.transform(
        "_again", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_again"), k + 1) - i, F.lit(WINDOW)))
    )
    covered = F.aggregate(covers, F.lit(0), lambda total, n: total + n)
    bare = F.filter("_words", lambda w: F.lower(F.rtrim(w, F.lit(SENTENCE_MARKS))).isin(*STOP_WORDS))
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.translate("text", BLANKS, "")),
        "n_symbols": F.length("text") - F.length(F.translate("text", SYMBOLS, "")),
        "n_stop_words": F.size(bare),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
    }
    return fenced(rows, [keep], {name: count.cast("bigint") for name, count in counts.items()})


def quality_rules(docs, base=BASE, rules=RULES, id_col="doc_id", text_col="text"):
    """Counts, failed rules and verdict of every text: `(id, counts, failed, base_failed, kept)`.

    One narrow projection. A null or blank text has no words and fails; rows map one to one, repeated ones and null ids
    included; other columns are not looked at. Windows are compared by a 64-bit hash within one text. `failed` lists
    the names of the rules, base rules first.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = _metrics(rows, "id")
    failed = F.filter(F.array(*[F.when(F.expr(r.sql()), r.name) for r in (*base, *rules)]), lambda x: x.isNotNull())
    base_failed, failing = _failed(base), _failed(rules)
    return rows.select(
        F.col("id").alias(id_col), *METRICS, failed.alias("failed"),
        base_failed.alias("base_failed"), (~base_failed & ~failing).alias("kept"),
    )


def keep_good(docs, base=BASE, rules=RULES, text_col="text"):
    """The rows of `docs`, with their own columns, whose text passes every rule. A text that fails, a null one too, goes."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kept = _metrics(rows, "_row").filter(~_failed(base) & ~_failed(rules))
    return kept.select(*[F.col("_row")[n].alias(n) for n in names])


# ---- the same in DuckDB SQL ----


def _quoted(words):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def metrics_sql(source):
    """CTEs ending in `judged`: all columns of `source`, the counts, `base_failed` and `kept`."""
    blank = "[^\\x20\\x09-\\x0D]"
    return f"""parsed AS (
  SELECT *, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '{blank}+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{blank}')) AS ls
  FROM {source}),
windows AS (
  SELECT rid, i, array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ') AS w
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM parsed)),
again AS (
  SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM (
    SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT rid, count(DISTINCT p) AS n FROM again GROUP BY rid),
counted AS (
  SELECT parsed.* EXCLUDE (ws, ls), CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(ws, lambda w: list_contains([{_quoted(STOP_WORDS)}], lower(rtrim(w, '{SENTENCE_MARKS}')))))
              AS BIGINT) AS n_stop_words,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words
  FROM parsed LEFT JOIN repeats USING (rid)),
judged AS (
  SELECT *, ({" OR ".join(r.sql() for r in BASE)}) AS base_failed,
         NOT ({" OR ".join(r.sql() for r in (*BASE, *RULES))}) AS kept FROM counted)"""
