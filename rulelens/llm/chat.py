"""Chat formatting for preference data: the common beginning of two conversations once, then both completions with masks."""

from pyspark.sql import functions as F

ROLE_OPEN, ROLE_CLOSE, TURN_END = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def _render(turn):
    text = F.coalesce(turn["text"], F.lit(""))
    return F.concat(F.lit(ROLE_OPEN), F.coalesce(turn["role"], F.lit("")), F.lit(ROLE_CLOSE), text, F.lit(TURN_END))


def _rendered(turns):
    return F.array_join(F.transform(turns, _render), "")


def _spans(turns):
    """Where the trained turns' texts and end marks lie in the rendered turns: an array of (start, length)."""
    head = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state, turn):
        before = F.length(F.concat(F.lit(ROLE_OPEN), F.coalesce(turn["role"], F.lit("")), F.lit(ROLE_CLOSE)))
        size = F.length(F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(TURN_END)))
        span = F.struct((state["at"] + before).alias("start"), size.alias("length"))
        spans = F.when(turn["role"] == TRAINED_ROLE, F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct((state["at"] + before + size).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, head, step, lambda state: state["spans"])


def preference_format(turns, pairs):
    """`(pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans)` of every pair.

    `turns`: (conv_id, turn, role, text), in the order of turn, then role and text; `pairs`: (pair_id, chosen, rejected) by
    conv_id. The prompt is the longest prefix of turns with equal role and text; each completion has the rest, and
    its spans are the places (start, length, in characters) whose tokens are trained on: the assistant's texts with their
    end marks. Nulls equal each other and are rendered empty. A side without turns has an empty completion; a
    pair of which neither side has turns, and turns without a conv_id, give no row. Other columns are not looked at.
    """
    sides = pairs.select("pair_id", F.explode(F.array(
        F.struct(F.col("chosen").alias("conv_id"), F.lit(True).alias("good")),
        F.struct(F.col("rejected").alias("conv_id"), F.lit(False).alias("good")))).alias("s"))
    sides = sides.select("pair_id", "s.conv_id", "s.good")
    said = turns.select("conv_id", F.struct("turn", "role", "text").alias("said")).join(sides, "conv_id")
    both = said.groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("good"), F.col("said")))).alias("a"),
        F.array_sort(F.collect_list(F.when(~F.col("good"), F.col("said")))).alias("b"),
    )

    def differ(x, i):
        y = F.get(F.col("b"), i)
        return ~((i < F.size("b")) & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))

    first = F.array_position(F.transform("a", differ), True).cast("int")
    both = both.withColumn("n", F.when(first > 0, first - 1).otherwise(F.size("a")))
    rest = {c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0))) for c in ("a", "b")}
    both = both.withColumns({"a_rest": rest["a"], "b_rest": rest["b"], "prefix": F.slice("a", F.lit(1), F.col("n"))})
    return both.select(
        "pair_id", F.col("n").cast("bigint").alias("n_prompt_turns"), _rendered("prefix").alias("prompt"),
        _rendered("a_rest").alias("chosen"), _rendered("b_rest").alias("rejected"),
        _spans("a_rest").alias("chosen_spans"), _spans("b_rest").alias("rejected_spans"),
    )


def swapped_answers(turns, pairs, role=TRAINED_ROLE):
    """`(turns, pairs)` of conversations that differ in their last answer: the chosen one as it is, and the rejected one, which is the
    same up to its last turn of `role` and then has the other conversation's last such turn.

    `pairs` has (pair_id, chosen, other) by conv_id; a pair of which one has no such turn gives none. Of several rows
    of the last turn the greatest counts. The conversations come out as numbers 2 * pair_id and 2 * pair_id + 1, so `pair_id` is a whole number.
    """
    last = turns.filter((F.col("role") == role) & F.col("turn").isNotNull())
    last = last.groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    ends = pairs.join(last.withColumnRenamed("conv_id", "chosen"), "chosen").withColumnRenamed("last", "own")
    ends = ends.join(last.withColumnRenamed("conv_id", "other"), "other").withColumnRenamed("last", "others")
    good, bad = 2 * F.col("pair_id"), 2 * F.col("pair_id") + 1
    said = turns.select(F.col("conv_id").alias("chosen"), "turn", "role", "text").join(ends.select("pair_id", "chosen", "own"), "chosen")
    same = said.select(good.alias("conv_id"), "turn", "role", "text")
    begun = said.filter(F.col("turn") < F.col("own.turn")).select(bad.alias("conv_id"), "turn", "role", "text")
    ended = ends.select(bad.alias("conv_id"), F.col("own.turn").alias("turn"), F.lit(role).alias("role"), F.col("others.text").alias("text"))
    return same.unionByName(begun).unionByName(ended), ends.select("pair_id", good.alias("chosen"), bad.alias("rejected"))


def swapped_sql(turns, pairs, role=TRAINED_ROLE):
    """CTEs `swapped_turns` and `swapped_pairs` of the same."""
    return f"""lasts AS (
  SELECT conv_id, turn, text FROM {turns} WHERE role = '{role}' AND turn IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC NULLS LAST) = 1),
ends AS (
  SELECT pair_id, chosen, a.turn AS turn, b.text AS text FROM {pairs} JOIN lasts a ON a.conv_id = chosen JOIN lasts b ON b.conv_id = other),
swapped_turns AS (
  SELECT 2 * pair_id AS conv_id, t.turn, role, t.text FROM {turns} t JOIN ends ON conv_id = chosen
  UNION ALL SELECT 2 * pair_id + 1, t.turn, role, t.text FROM {turns} t JOIN ends e ON conv_id = chosen WHERE t.turn < e.turn
  UNION ALL SELECT 2 * pair_id + 1, turn, '{role}', text FROM ends),
swapped_pairs AS (SELECT pair_id, 2 * pair_id AS chosen, 2 * pair_id + 1 AS rejected FROM ends)"""


def preference_sql(turns, pairs):
    """CTEs ending in `formatted`; spans as text `start+length`, comma-joined."""
    head = f"'{ROLE_OPEN}' || coalesce(role, '') || '|>' || chr(10)"
    tail = "coalesce(text, '') || '<|end|>' || chr(10)"
    return f"""sided AS (
  SELECT pair_id, true AS good, chosen AS conv_id FROM {pairs} UNION ALL SELECT pair_id, false, rejected FROM {pairs}),
said AS (
  SELECT pair_id, good, role, text, {head} AS head, {tail} AS tail,
         row_number() OVER (PARTITION BY pair_id, good ORDER BY turn, role, text) AS i
  FROM {turns} JOIN sided USING (conv_id)),
aligned AS (
  SELECT a.pair_id, a.i, b.i IS NOT NULL AND a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text AS same
  FROM said a LEFT JOIN said b ON b.pair_id = a.pair_id AND b.i = a.i AND NOT b.good WHERE a.good),
prefix AS (
  SELECT pair_id, coalesce(min(CASE WHEN NOT same THEN i END) - 1, max(i)) AS n FROM aligned GROUP BY pair_id),
placed AS (
  SELECT said.*, coalesce(n, 0) AS n, coalesce(sum(length(head) + length(tail)) OVER (
           PARTITION BY pair_id, good, i > coalesce(n, 0) ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           + length(head) AS start
  FROM said LEFT JOIN prefix USING (pair_id)),
formatted AS (
  SELECT pair_id, CAST(max(n) AS BIGINT) AS n_prompt_turns,
    coalesce(string_agg(head || tail, '' ORDER BY i) FILTER (good AND i <= n), '') AS prompt,
    coalesce(string_agg(head || tail, '' ORDER BY i) FILTER (good AND i > n), '') AS chosen,
    coalesce(string_agg(head || tail, '' ORDER BY i) FILTER (NOT good AND i > n), '') AS rejected,
    coalesce(string_agg(CAST(start AS BIGINT) || '+' || length(tail), ',' ORDER BY i)
      FILTER (good AND i > n AND role = '{TRAINED_ROLE}'), '') AS chosen_mask,
    coalesce(string_agg(CAST(start AS BIGINT) || '+' || length(tail), ',' ORDER BY i)
      FILTER (NOT good AND i > n AND role = '{TRAINED_ROLE}'), '') AS rejected_mask
  FROM placed GROUP BY pair_id)"""
