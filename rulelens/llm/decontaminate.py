"""Benchmark decontamination over a positional inverted index of the training text, stored as a table.

Postings (term, id, pos) are kept for every word that a benchmark item has. Of each item window the two rarest words by
the index's counts are looked up; their lists, each less the word's offset in the item, meet where the item may lie.
There the window is compared word by word. Column expressions only; nothing is dropped for being frequent.
"""

from pyspark.sql import functions as F

from rulelens.llm.fence import fenced
from rulelens.plans.storage import materialize

WINDOW = 13
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Tables of terms, items and candidates are broadcast up to so many rows, else shuffled.
MAX_BROADCAST_ROWS = 50_000


def _small(df):
    """The stored table, with a broadcast hint if its counted rows are few."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def _words(column):
    """Words of a text as an array; null and wordless texts have an empty one."""
    text = F.coalesce(column, F.lit(""))
    # Where all is ASCII the quick `lower` does the same.
    small = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    # Only before the first and after the last word a piece can be empty.
    return F.array_remove(F.split(small, BREAK, -1), "")


def benchmark_items(items, window=WINDOW, id_col="item_id", text_col="text"):
    """Items with words: `(item_id, terms, width)`; `width` is the window, less for shorter items. Null ids are left out."""
    rows = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), _words(F.col(text_col)).alias("terms"))
    rows = rows.filter(F.size("terms") > 0).distinct()
    return rows.withColumn("width", F.least(F.size("terms"), F.lit(window)))


def index_postings(docs, terms, id_col="doc_id", text_col="text"):
    """The positional index of `docs` for a stored table of terms `(term, term_id)`: stored `(term_id, id, pos)`."""
    words = docs.select(F.col(id_col).alias("id"), _words(F.col(text_col)).alias("words"))
    placed = words.select("id", F.posexplode("words").alias("pos", "term"))
    return materialize(placed.join(_small(terms), "term").select("term_id", "id", "pos"), "postings")


def _item_terms(items, terms):
    placed = items.select("item_id", "terms", "width", F.posexplode("terms").alias("off", "term"))
    return placed.join(terms, "term")


def rarest_terms(items, terms, postings):
    """Of each item window the two rarest terms: distinct `(item_id, off1, term1, off2, term2)`.

    Windows with a term that the index does not have cannot occur and are left out.
    """
    counts = postings.groupBy("term_id").agg(F.count(F.lit(1)).alias("n"))
    counted = _item_terms(items, terms).join(counts, "term_id", "left")
    entry = F.struct("off", F.coalesce("n", F.lit(0)).alias("n"), "term_id")
    whole = counted.groupBy("item_id", "terms", "width").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    starts = whole.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("terms") - F.col("width"))))
    mine = F.slice("entries", F.col("start") + 1, F.col("width"))
    by_rarity = F.array_sort(F.transform(mine, lambda e: F.struct(e["n"].alias("n"), e["off"].alias("off"), e["term_id"].alias("term"))))
    ranked = starts.select("item_id", by_rarity.alias("r")).filter(F.get("r", F.lit(0))["n"] > 0)
    first, second = F.get("r", F.lit(0)), F.coalesce(F.get("r", F.lit(1)), F.get("r", F.lit(0)))
    return ranked.select(
        "item_id", first["off"].alias("off1"), first["term"].alias("term1"),
        second["off"].alias("off2"), second["term"].alias("term2"),
    ).distinct()


def intersect_lists(postings, rarest):
    """Where an item may lie: distinct `(item_id, id, base)`, base being the place of the item's first word."""
    rarest = _small(materialize(rarest, "rarest"))

    def lists(which):
        picked = rarest.withColumn("term_id", F.col(f"term{which}"))
        base = F.col("pos") - F.col(f"off{which}")
        return postings.join(picked, "term_id").select("item_id", "off1", "off2", "id", base.alias("base"))

    met = lists(1).join(lists(2), ["item_id", "off1", "off2", "id", "base"], "left_semi")
    return met.select("item_id", "id", "base").distinct()


def _matches(words):
    """Per candidate of a document, which windows of the item lie there: an array of (item_id, base, width, starts)."""

    def fits(c):
        return F.transform(c["terms"], lambda term, o: F.coalesce(F.get(words, c["base"] + o) == term, F.lit(False)))

    flagged = F.transform(
        "candidates", lambda c: F.struct(c["item_id"].alias("item_id"), c["base"].alias("base"), c["width"].alias("width"), fits(c).alias("fits"))
    )

    def starts(c):
        every = F.sequence(F.lit(0), F.size(c["fits"]) - c["width"])
        return F.filter(every, lambda s: F.forall(F.slice(c["fits"], s + 1, c["width"]), lambda x: x))

    return F.transform(
        flagged, lambda c: F.struct(c["item_id"].alias("item_id"), c["base"].alias("base"), c["width"].alias("width"), starts(c).alias("starts"))
    )


def phrase_matches(docs, items, window=WINDOW, id_col="doc_id", text_col="text"):
    """`docs`' own columns with `n_words`, `n_hit` and `hit_items` (sorted distinct ids as text, of windows that occur).

    A window is `window` consecutive words of an item, or a shorter item whole; words are runs of ASCII letters and digits
    and anything beyond ASCII, A-Z lower-cased. `n_hit` counts the words inside any occurrence. A null text has no
    words, an item without words no window. Rows map one to one, repeated ones and those with a null id (never hit)
    included; the three names are overwritten.
    """
    items = materialize(benchmark_items(items, window), "items")
    vocabulary = items.select(F.explode("terms").alias("term")).distinct()
    terms = materialize(vocabulary.withColumn("term_id", F.monotonically_increasing_id()), "terms")
    postings = index_postings(docs, terms, id_col, text_col)
    places = intersect_lists(postings, rarest_terms(items, terms, postings))
    candidate = F.struct("item_id", "base", "terms", "width")
    listed = places.join(_small(items), "item_id").groupBy(F.col("id").alias("_id"))
    listed = materialize(listed.agg(F.collect_set(candidate).alias("candidates")), "candidates")
    names = [n for n in docs.columns if n not in ("n_words", "n_hit", "hit_items")]
    rows = docs.select(F.struct(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)]).alias("_row"),
                       F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.join(_small(listed), "_id", "left").withColumn("_words", _words(F.col("_text")))
    rows = rows.withColumn("_found", F.filter(_matches(F.col("_words")), lambda m: F.size(m["starts"]) > 0))
    rows = rows.withColumn("_n", F.size("_words"))
    covered = F.transform("_found", lambda m: F.flatten(F.transform(
        m["starts"], lambda s: F.sequence(m["base"] + s, m["base"] + s + m["width"] - 1))))
    hit = F.coalesce(F.size(F.array_distinct(F.flatten(covered))), F.lit(0))
    ids = F.array_sort(F.array_distinct(F.transform("_found", lambda m: m["item_id"].cast("string"))))
    has = F.col("_found").isNotNull()
    rows = fenced(rows, ["_row"], {
        "n_words": F.col("_n").cast("bigint"),
        "n_hit": F.when(has, hit).otherwise(0).cast("bigint"),
        "hit_items": F.when(has, ids).otherwise(F.array().cast("array<string>")),
    })
    own = [F.col("_row")[f"c{i}"].alias(n) for i, n in enumerate(names)]
    return rows.select(*own, "n_words", "n_hit", "hit_items")


def contaminated():
    """A document is contaminated if words are hit, and at least one in twenty."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs, items, window=WINDOW, id_col="doc_id", text_col="text"):
    """The rows of `docs`, with their own columns, that are not contaminated."""
    return phrase_matches(docs, items, window, id_col, text_col).filter(~contaminated()).select(*docs.columns)


def proximity_matches(docs, items, slop, window=WINDOW, id_col="doc_id", text_col="text"):
    """Windows whose words all lie near their places: distinct `(id, item_id, start)`.

    A window matches at an occurrence of its rarest word if every other word occurs within `slop` words of where it would
    be in an exact match. `start` is the window's place in the item.
    """
    items = materialize(benchmark_items(items, window), "items")
    vocabulary = items.select(F.explode("terms").alias("term")).distinct()
    terms = materialize(vocabulary.withColumn("term_id", F.monotonically_increasing_id()), "terms")
    postings = index_postings(docs, terms, id_col, text_col)
    counts = postings.groupBy("term_id").agg(F.count(F.lit(1)).alias("n"))
    counted = _item_terms(items, terms).join(counts, "term_id")
    start = F.explode(F.sequence(F.greatest(F.lit(0), F.col("off") - F.col("width") + 1),
                                 F.least(F.col("off"), F.size("terms") - F.col("width"))))
    placed = materialize(counted.select("item_id", "width", "off", "term_id", "n", start.alias("start")), "windows")
    first = placed.groupBy("item_id", "start").agg(
        F.min(F.struct("n", "off", "term_id")).alias("rare"), F.first("width").alias("width"), F.count(F.lit(1)).alias("known")
    )
    first = first.filter("known = width").select("item_id", "start", "width", "rare.off", "rare.term_id")
    bucket = F.floor(F.col("base") / (slop + 1))
    anchor = postings.join(first, "term_id").select("item_id", "start", "width", "id", (F.col("pos") - F.col("off")).alias("base"))
    anchor = anchor.withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    near = postings.join(placed, "term_id").select("item_id", "start", "off", "id", (F.col("pos") - F.col("off")).alias("base"))
    near = near.withColumn("bucket", bucket).withColumnRenamed("base", "base2")
    met = anchor.join(near, ["item_id", "start", "id", "bucket"]).filter(F.abs(F.col("base") - F.col("base2")) <= slop)
    full = met.groupBy("item_id", "start", "width", "id", "base").agg(F.count_distinct("off").alias("n"))
    return full.filter("n = width").select(F.col("id").alias(id_col), "item_id", "start").distinct()


# ---- the same in DuckDB SQL ----


def phrase_sql(docs, items, window=WINDOW):
    """CTEs ending in `hits`: doc_id, n_words, n_hit, n_items, items."""
    words = "regexp_extract_all(translate(coalesce(text, ''), '{0}', '{1}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    words = words.format(UPPER, UPPER.lower())
    return f"""worded AS (SELECT doc_id, {words} AS ws FROM {docs}),
item_words AS (SELECT item_id, {words} AS ws FROM {items}),
item_windows AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS w FROM (
    SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i
    FROM (SELECT *, least(len(ws), {window}) AS k FROM item_words WHERE len(ws) > 0))),
doc_windows AS (
  SELECT doc_id, k, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS w FROM (
    SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i
    FROM worded, (SELECT DISTINCT k FROM item_windows))),
met AS (SELECT doc_id, item_id, k, i FROM doc_windows JOIN item_windows USING (k, w)),
spots AS (SELECT doc_id, unnest(range(i, i + k)) AS p FROM met),
counted AS (SELECT doc_id, count(DISTINCT p) AS n FROM spots GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM met) GROUP BY doc_id),
hits AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(counted.n, 0) AS BIGINT) AS n_hit,
         CAST(coalesce(listed.n, 0) AS BIGINT) AS n_items, coalesce(names, '') AS items
  FROM worded LEFT JOIN counted USING (doc_id) LEFT JOIN listed USING (doc_id))"""
