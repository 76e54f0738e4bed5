"""The operators applied to the given tables, each with the SQL that checks it where SQL can express it."""

import public_tokenizers
from pyspark.sql import functions as F

from rulelens.llm import classifier, lm
from rulelens.llm.audit import audit_sql, filter_audit
from rulelens.llm.bpe import encode_decode
from rulelens.llm.chat import preference_format, preference_sql, swapped_answers, swapped_sql
from rulelens.llm.collocations import collocations, collocations_sql
from rulelens.llm.decontaminate import contaminated, phrase_matches, phrase_sql
from rulelens.llm.hosts import url_filter, url_filter_sql
from rulelens.llm.jaccard import jaccard_components, jaccard_sql
from rulelens.llm.langid import fit, predict, read_pieces
from rulelens.llm.quality import METRICS, metrics_sql, quality_rules
from rulelens.llm.sharding import shard
from rulelens.llm.substrings import substring_dedup, substring_sql

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op6_quality_rules", f"WITH {metrics_sql('documents')} SELECT doc_id, {', '.join(METRICS)}, base_failed, kept FROM judged")
def op6_quality_rules(spark, sf):
    return quality_rules(table(spark, sf, "documents")).drop("failed")


def rank_file(name="byte_bpe_50k.tiktoken"):
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


@query("op8_byte_bpe")
def op8_byte_bpe(spark, sf):
    coded = encode_decode(table(spark, sf, "documents"), rank_file(), public_tokenizers.PATTERN, cut_at_spaces=True)
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query(
    "op10_substring_dedup",
    f"WITH {substring_sql('documents')} SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM parsed",
)
def op10_substring_dedup(spark, sf):
    parsed = substring_dedup(table(spark, sf, "documents"))
    return parsed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op4_ngram_jaccard", f"WITH RECURSIVE {jaccard_sql('documents')} SELECT * FROM joined")
def op4_ngram_jaccard(spark, sf):
    return jaccard_components(table(spark, sf, "documents"))


@query(
    "op9_decontamination",
    f"""WITH {phrase_sql('documents', 'benchmark')}
SELECT doc_id, n_words, n_hit, n_items, sha256(items) AS items_sha256, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated
FROM hits""",
)
def op9_decontamination(spark, sf):
    found = phrase_matches(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
# A page's label is that of the document whose number stands after the language in its path.
PAGE_KEY = "://[^/?#]+/[a-z]+/([0-9]{1,18})"


@query(
    "op2_url_filters",
    f"""WITH marked AS (SELECT doc_id AS key, quality = 0 AS bad FROM labels WHERE quality IS NOT NULL),
{url_filter_sql('pages', 'marked', URL_RULES, f"TRY_CAST(regexp_extract(url, '{PAGE_KEY}', 1) AS BIGINT)")}
SELECT * FROM judged""",
)
def op2_url_filters(spark, sf):
    labels = table(spark, sf, "labels").filter("quality is not null")
    labels = labels.select(F.col("doc_id").alias("key"), (F.col("quality") == 0).alias("bad"))
    key = lambda url: F.regexp_extract(url, PAGE_KEY, 1).try_cast("bigint")
    return url_filter(table(spark, sf, "pages"), labels, URL_RULES, key=key)


def fold(parts):
    """Remainder of the crc32 of the id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


@query("op1_language_id")
def op1_language_id(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    pieces = read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    languages, prob = fit(docs.filter(fold(5) != 0), pieces)
    return predict(docs, pieces, languages, prob).select("doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score")


@query("op7_quality_classifier")
def op7_quality_classifier(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    weights = classifier.fit(docs, labels.filter(fold(4) != 2))
    scored = classifier.score(docs, weights)
    return scored.select(
        "doc_id", (fold(4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    )


@query(
    "op3_chat_formatting",
    f"""WITH pairs AS (
  SELECT conv_id // 2 AS pair_id, min(conv_id) AS chosen, max(conv_id) AS other FROM conversations
  WHERE conv_id IS NOT NULL GROUP BY 1 HAVING min(conv_id) < max(conv_id)),
{swapped_sql('conversations', 'pairs')},
{preference_sql('swapped_turns', 'swapped_pairs')}
SELECT * FROM formatted""",
)
def op3_chat_formatting(spark, sf):
    """Each conversation of an even id is preferred to itself with the last answer of the next one."""
    turns = table(spark, sf, "conversations")
    pair = F.floor(F.col("conv_id") / 2).cast("bigint").alias("pair_id")
    pairs = turns.groupBy(pair).agg(F.min("conv_id").alias("chosen"), F.max("conv_id").alias("other")).filter("chosen < other")
    out = preference_format(*swapped_answers(turns, pairs))

    def mask(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws("+", s["start"].cast("string"), s["length"].cast("string"))), ",")

    return out.select(
        "pair_id", "n_prompt_turns", "prompt", "chosen", "rejected",
        mask("chosen_spans").alias("chosen_mask"), mask("rejected_spans").alias("rejected_mask"),
    )


@query(
    "op5_lm_scoring",
    f"""WITH good AS (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0),
{lm.difference_sql('documents', 'good')}
SELECT doc_id, n_tokens, {', '.join(f'round({c}, 5) AS {c}' for c in ('target_loss', 'background_loss', 'score'))} FROM scored""",
)
def op5_lm_scoring(spark, sf):
    """The target is what the labels call good and not toxic."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    good = table(spark, sf, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    scored = lm.cross_entropy_difference(docs, good)
    return scored.select("doc_id", "n_tokens", *[F.round(c, 5).alias(c) for c in ("target_loss", "background_loss", "score")])


@query("op11_phrase_collocations", f"WITH {collocations_sql('documents')} SELECT * FROM ranked")
def op11_phrase_collocations(spark, sf):
    return collocations(table(spark, sf, "documents"))


@query("op12_filter_interaction_audit", f"WITH {audit_sql('documents', 'labels')} SELECT * FROM audited")
def op12_filter_interaction_audit(spark, sf):
    return filter_audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op13_sharding")
def op13_sharding(spark, sf):
    return shard(table(spark, sf, "documents"))
