"""What the order of filters does: for every order of five filters, what each step keeps, removes and costs.

Texts become one bit mask of failed filters each, and masks are counted. The counts, at most 128 cells for each part, are
folded over the array of all orders, a constant that goes to the tasks with the plan: one struct for every order and step, weighted by the cell's count. The
structs of a part's cells are added up element by element.
"""

from itertools import permutations

from pyspark.sql import functions as F

from rulelens.llm.fence import fenced
from rulelens.plans.storage import materialize

FILTERS = "ABCDE"
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
# A: fewer words; B: fewer distinct words in a hundred; C: more capitals in a hundred characters; D: one of these.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failure_masks(docs, labels, id_col="doc_id", text_col="text", part_col="source"):
    """`(part, mask, good, toxic, n)`: how many rows of a part fail which filters; bit k of the mask is the k-th filter.

    A null text is empty, a null part is the empty string. The last filter fails a row whose text some smaller id has
    too, so no row of a null id, and no repeated row of the smallest id. Several labels of an id: good or toxic if any says
    so; an id without labels is neither. Every row counts; other columns are not looked at.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("_words", F.filter(F.split("text", WORD_BREAK, -1), lambda w: w != ""))
    words, chars = F.size("_words"), F.length("text")
    capitals = chars - F.length(F.translate("text", CAPITALS, ""))
    fails = [
        words < LEAST_WORDS,
        100 * F.size(F.array_distinct("_words")) < LEAST_DISTINCT * words,
        100 * capitals > MOST_CAPITALS * chars,
        F.col("text").rlike(SYMBOLS),
    ]
    mask = sum((F.when(fail, 1 << k).otherwise(0) for k, fail in enumerate(fails)), F.lit(0))
    read = fenced(rows, ["id", "part"], {"text_key": F.unhex(F.sha2("text", 256)), "mask": mask.cast("int")})
    read = read.groupBy("id", "part", "text_key", "mask").agg(F.count(F.lit(1)).alias("n"))
    said = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False))).alias(name)
    labels = labels.select(F.col(id_col).alias("id"), "quality", "toxic").filter("id is not null")
    labels = labels.groupBy("id").agg(said("quality"), said("toxic"))
    read = read.join(labels, "id", "left")
    read = read.withColumns({name: F.coalesce(F.col(c), F.lit(False)) for name, c in (("good", "quality"), ("toxic", "toxic"))})
    # Of a text's rows only counts and the smallest id go on, so that a frequent text is a few rows.
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    nameless = F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0))
    groups = read.groupBy("text_key", "part", "mask", "good", "toxic")
    groups = groups.agg(F.sum("n").alias("n"), nameless.alias("nameless"), first.alias("first"))
    groups = materialize(groups, "texts")
    least = groups.groupBy("text_key").agg(F.min("first.id").alias("least"))
    groups = groups.join(least, "text_key")
    fresh = F.col("nameless") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    copy = F.lit(1 << FILTERS.index("E"))
    both = F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), fresh.alias("n")),
        F.struct(F.col("mask").bitwiseOR(copy).alias("mask"), (F.col("n") - fresh).alias("n")),
    ))
    cells = groups.select("part", "good", "toxic", both.alias("cell")).select("part", "good", "toxic", "cell.*")
    return cells.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).filter("n > 0")


def _orders():
    return ["".join(order) for order in permutations(FILTERS)]


def fold_orders(cells):
    """`(part, filter_order, step, counts)` of a table of cells, a row for each order and step, zeros included."""
    orders = F.array(*[F.array(*[F.lit(FILTERS.index(f)) for f in order]) for order in _orders()])
    n, mask = F.col("n"), F.col("mask")
    fails = lambda f: mask.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(len(FILTERS))]), f + 1)) != 0
    number = lambda test: F.when(test, n).otherwise(F.lit(0).cast("bigint"))
    alone = lambda f: F.bit_count(mask).eqNullSafe(1) & fails(f)

    def steps(order):
        """A fold over an order: the bits seen so far, and a struct a step."""
        start = F.struct(
            F.lit(False).alias("gone"),
            F.array().cast("array<struct<f:int,kept:bigint,removed:bigint,redundant:bigint,unique_fails:bigint,"
                            "good_lost:bigint,toxic_lost:bigint>>").alias("done"),
        )

        def step(state, f):
            gone, hit = state["gone"], fails(f)
            here = hit & ~gone
            row = F.struct(
                f.alias("f"),
                number(~(gone | hit)).alias("kept"),
                number(here).alias("removed"),
                number(hit & gone).alias("redundant"),
                number(alone(f)).alias("unique_fails"),
                number(here & F.col("good")).alias("good_lost"),
                number(here & F.col("toxic")).alias("toxic_lost"),
            )
            return F.struct((gone | hit).alias("gone"), F.concat(state["done"], F.array(row)).alias("done"))

        return F.aggregate(order, start, step, lambda state: state["done"])

    folded = cells.select("part", F.flatten(F.transform(orders, steps)).alias("all"))
    rows = folded.select("part", F.posexplode("all").alias("at", "one")).select("part", "at", "one.*")
    sums = [F.sum(c).alias(c) for c in COUNTS[:-1]]
    added = rows.groupBy("part", "at", "f").agg(*sums)
    shares = added.groupBy("part", "f").agg(F.sum("removed").alias("shapley"))
    added = added.join(shares, ["part", "f"])
    names = F.array(*[F.lit(order) for order in _orders()])
    place = F.floor(F.col("at") / len(FILTERS)).cast("int")
    return added.select(
        "part", F.element_at(names, place + 1).alias("filter_order"), (F.col("at") % len(FILTERS) + 1).cast("int").alias("step"), *COUNTS
    )


def filter_audit(docs, labels, id_col="doc_id", text_col="text", part_col="source"):
    """`(part, filter_order, step, counts)`: what each step of each of the 120 orders of the five filters does.

    Counts of a part's rows: `kept` after the step, `removed` by it, `redundant` (fail its filter, were removed before),
    `unique_fails` (fail no other filter), `good_lost` and `toxic_lost` of the removed, and `shapley`, what its filter removes summed
    over all orders. Rows are read as by `failure_masks`. An empty table has no parts and gives no rows.
    """
    return fold_orders(failure_masks(docs, labels, id_col, text_col, part_col))


# ---- the same in DuckDB SQL ----


def audit_sql(source, labels):
    """CTEs ending in `audited`."""
    letters = ", ".join(f"('{f}', {1 << k})" for k, f in enumerate(FILTERS))
    orders = ", ".join(f"('{order}')" for order in _orders())
    return f"""texts AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM {source}),
said AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS bad
  FROM {labels} WHERE doc_id IS NOT NULL GROUP BY doc_id),
least AS (SELECT t, min(doc_id) AS id FROM texts GROUP BY t),
masked AS MATERIALIZED (
  SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
    CASE WHEN len(ws) < {LEAST_WORDS} THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(ws)) < {LEAST_DISTINCT} * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(x.t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(x.t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(x.t, '{SYMBOLS}') THEN 8 ELSE 0 END
    + CASE WHEN l.id < x.doc_id THEN 16 ELSE 0 END AS mask
  FROM texts x LEFT JOIN said USING (doc_id) JOIN least l ON l.t = x.t),
cells AS (SELECT part, mask, good, bad, count(*) AS n FROM masked GROUP BY ALL),
letters(f, bit) AS (VALUES {letters}),
orders(filter_order) AS (VALUES {orders}),
steps AS (
  SELECT filter_order, step, f, bit, (SELECT coalesce(sum(b.bit), 0) FROM letters b
    WHERE strpos(filter_order, b.f) < step) AS before
  FROM orders, range(1, {len(FILTERS) + 1}) s(step), letters WHERE substr(filter_order, CAST(step AS INT), 1) = f),
stepped AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, f,
    sum(CASE WHEN mask & CAST(before + bit AS INT) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & CAST(before AS INT) = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & CAST(before AS INT) > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & CAST(before AS INT) = 0 AND mask & bit > 0 AND good THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & CAST(before AS INT) = 0 AND mask & bit > 0 AND bad THEN n ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY ALL),
audited AS (
  SELECT part, filter_order, step, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in COUNTS[:-1])},
    CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM stepped)"""
