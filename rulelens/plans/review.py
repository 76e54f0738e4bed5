"""A whole review run: match, triage against the cache, score under a budget, dedup, cap, score, report.

Texts are read where they lie and never shuffled unless more rows must be scored than a broadcast list may
hold. Everything between the stages is a slim table of keys, stored once in the shared folder.
"""

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulelens.functions.findings import cached_form, with_issue_id
from rulelens.functions.text import estimate_tokens, snippet, split_lines
from rulelens.operators.cache import cache_lookup, latest_entries, triage, with_cache_key
from rulelens.operators.findings import (
    all_findings,
    attach_snippet,
    dedup_findings,
    drop_disabled,
    filter_rules,
    limit_per_path,
)
from rulelens.operators.match import match_rules
from rulelens.operators.score import run_meta, summary
from rulelens.operators.scorer import (
    check_answers,
    explode_findings,
    finding_array,
    score_with,
    validate_findings,
    with_prompt,
)
from rulelens.operators.spans import enclosing_span
from rulelens.operators.usage import usage_rows
from rulelens.plans.joins import MAX_BROADCAST_ROWS, semi_by_key
from rulelens.plans.storage import materialize
from rulelens.plans.topn import first_n, first_within
from rulelens.schemas import CACHE, DEFAULT_TTL_HOURS, FINDINGS, MAX_FINDINGS_PER_PATH
from rulelens.sources.changes import changed_rows
from rulelens.sources.diffs import diff_hunks, on_changed_lines
from rulelens.sources.rules import prune_rules


@dataclass(frozen=True)
class Options:
    as_of: object
    run_id: str = "run"
    pack_name: str = "none"
    model: str = "canned/1"
    language: str = "en"
    prices: dict | None = None
    budget: int | None = None
    token_budget: int | None = None
    budget_order: tuple = ("path",)
    ttl_hours: int = DEFAULT_TTL_HOURS
    rule_filter: tuple = ()
    disabled_rules: tuple = ()
    min_confidence: float | None = None
    known_rules_only: bool = False
    per_path: int | None = MAX_FINDINGS_PER_PATH
    max_prompt_chars: int | None = None
    no_cache: bool = False
    cache_salt: str | None = None
    snippets: bool = True
    spans: DataFrame | None = None
    diffs: DataFrame | None = None


@dataclass(frozen=True)
class ReviewResult:
    findings: DataFrame
    summary: DataFrame
    run_meta: DataFrame
    statuses: DataFrame
    deferred: DataFrame
    rejected: DataFrame
    new_cache: DataFrame
    usage: DataFrame
    changes: DataFrame | None = None


def _key_of(rows):
    """What tells rows apart: the path, and the text's hash where there is one."""
    return [c for c in ("path", "file_hash") if c in rows.columns]


def apply_budget(misses, n=None, order=("path",), tokens=None):
    """`(chosen, deferred)`: the first misses by `order` (then path and hash), and the rest; together all misses.

    `n` bounds their number, `tokens` the sum of their `tokens` column: rows are taken up to the first that would pass
    it. No bound chooses all.
    """
    if n is None and tokens is None:
        return misses, misses.limit(0)
    key = _key_of(misses)
    order = [*order, *(c for c in key if c not in order)]
    chosen = misses if n is None else first_n(misses, n, order)
    if tokens is not None:
        chosen = first_within(chosen, tokens, F.col("tokens"), order)
    chosen = materialize(chosen, "chosen")
    return chosen, semi_by_key(misses, chosen.select(*key), key, "left_anti", known_rows=n)


def _once(rows, repeated):
    """Rows with a text that is listed as repeated are reduced to one of each; no other text is moved."""
    if repeated.isEmpty():
        return rows
    on = ["path", "file_hash"]
    single = semi_by_key(rows, repeated, on, "left_anti")
    return single.unionByName(semi_by_key(rows, repeated, on).dropDuplicates(on))


def _rows_to_score(matched, chosen, opts, cached):
    """Text and rule ids of the chosen rows: by a bounded broadcast, or, if all rows are due, in place."""
    if opts.budget is None and opts.token_budget is None and not cached:
        return matched.filter(F.size("rule_ids") > 0)
    if opts.budget is None and opts.token_budget is None:
        chosen = materialize(chosen, "chosen")
    return semi_by_key(matched, chosen, ["path", "file_hash"], known_rows=opts.budget)


def _with_snippets(findings, lines):
    def fill(x):
        return x.withField("snippet", snippet(lines, x["start_line"], x["end_line"]))

    return F.transform(findings, fill)


def _score_rows(rows, rules, scorer, opts):
    """Call the scorer once per row and keep its answer, findings and fault in a stored table."""
    answered = score_with(with_prompt(rows, rules, opts.language, opts.max_prompt_chars), scorer)
    answered = answered.select("path", "content", "file_hash", "rules_hash", "answer.*")
    found = finding_array(opts.pack_name)
    if opts.snippets:
        answered = answered.withColumn("_lines", split_lines(F.col("content")))
        found = _with_snippets(found, F.col("_lines"))
    checked = check_answers(answered.drop("content"), "response_json", "error").withColumn("findings", found)
    return materialize(checked.drop("_lines", "_parsed"), "scored")


def _cached_findings(keyed, cache, opts):
    """Findings of fresh cache entries, bound to the path and, by `file_hash`, to the text that ask for them now."""
    hits = cache_lookup(keyed, cache, opts.as_of, opts.ttl_hours)
    flat = hits.select("path", "file_hash", F.explode("findings").alias("_f"))
    given = {name: F.col(f"_f.{name}") for name in ("rule_id", "level", "title", "why", "do", "pack", "source")}
    given |= {name: F.col(f"_f.{name}") for name in ("confidence", "tags")}
    given |= {name: F.col(f"_f.location.{name}") for name in ("start_line", "end_line", "start_col", "end_col")}
    given |= {name: F.lit(None).cast("string") for name in ("snippet", "context")}
    flat = flat.select("path", "file_hash", *[col.alias(name) for name, col in given.items()])
    return with_issue_id(flat).select(*FINDINGS.fieldNames(), "file_hash")


def _final_findings(candidates, corpus, rules, opts):
    """Filter, dedup and cap; then fill in the snippets that cached findings do not carry."""
    kept = drop_disabled(filter_rules(candidates, opts.rule_filter), opts.disabled_rules)
    if opts.diffs is not None:
        kept = on_changed_lines(kept, opts.diffs)
    if opts.min_confidence is not None:
        kept = kept.filter(F.col("confidence") >= opts.min_confidence)
    if opts.known_rules_only:
        kept = kept.filter(F.col("rule_id").isin([r.rule_id for r in rules]))
    final = materialize(limit_per_path(dedup_findings(kept), opts.per_path), "findings")
    if opts.snippets:
        bare = final.filter("cached")
        filled = attach_snippet(bare, corpus)
        final = filled.unionByName(final.filter("not cached"))
    if opts.spans is not None:
        final = enclosing_span(materialize(final, "findings"), opts.spans)
    return final.select(FINDINGS.fieldNames())


def review(corpus, rules, scorer, opts, cache=None):
    """Run a review over `(path, content)` rows; see ReviewResult for the outputs.

    Order: rule filter, match, cache, budget, scorer, rule filter again, disabled rules, dedup, cap, score.
    `no_cache` skips reading the cache, its new entries are still returned. A bad answer is quarantined in
    `rejected` and never cached; it does not end the run. A row is its path and its text's hash: several texts of one path, a null
    one too, are scored, deferred and logged each for itself. A budget takes rows by `budget_order`, path and hash;
    a column `priority` of the corpus may be part of that order.
    """
    rules = prune_rules(rules, opts.rule_filter)
    ranks = [c for c in corpus.columns if c == "priority"]
    matched = with_cache_key(match_rules(corpus.select("path", "content", *ranks), rules), opts.cache_salt)
    # A text that arrives several times under one path is one row from here on.
    cost = [] if opts.token_budget is None else [F.max(estimate_tokens(F.col("content"))).alias("tokens")]
    keyed = matched.groupBy("path", "file_hash").agg(
        F.first("rule_ids").alias("rule_ids"), F.first("rules_hash").alias("rules_hash"), F.count(F.lit(1)).alias("copies"),
        *[F.min(c).alias(c) for c in ranks], *cost,
    )
    matched = matched.drop(*ranks)
    keyed = materialize(keyed, "keyed")
    repeated = keyed.filter("copies > 1").select("path", "file_hash")
    keyed = keyed.drop("copies")
    readable = None if opts.no_cache else cache
    statuses = triage(keyed, readable, opts.as_of, opts.ttl_hours)
    if readable is not None:
        statuses = materialize(statuses, "statuses")
    chosen, deferred = apply_budget(statuses.filter("status = 'analyze'"), opts.budget, opts.budget_order, opts.token_budget)
    rows = _once(_rows_to_score(matched, chosen, opts, readable is not None), repeated)
    scored = _score_rows(rows, rules, scorer, opts)

    # Fresh findings carry their snippet; only cached ones look for their text.
    fresh = explode_findings(scored).withColumn("file_hash", F.lit(None).cast("string"))
    stored = fresh.limit(0) if readable is None else _cached_findings(keyed, readable, opts)
    findings = _final_findings(all_findings(stored, fresh), corpus, rules, opts)

    # Only answers that passed are remembered, and only once per key.
    passed = scored.filter("fault is null").select(
        "file_hash",
        "rules_hash",
        F.transform("findings", cached_form).alias("findings"),
        F.lit(opts.as_of).cast("timestamp").alias("created_at"),
    )
    new_cache = latest_entries(passed).select(CACHE.fieldNames())
    calls = scored.withColumn("issues_found", F.size("findings"))
    usage = usage_rows(calls, opts.run_id, opts.as_of, opts.model, opts.pack_name, opts.prices)
    _, rejected = validate_findings(scored.drop("findings", "fault"), "response_json", "error")
    return ReviewResult(
        findings=findings,
        summary=summary(findings),
        run_meta=run_meta(statuses, usage),
        statuses=statuses,
        deferred=deferred.select("path", "file_hash"),
        rejected=rejected,
        new_cache=new_cache,
        usage=usage,
    )


def _changed(old, new, globs, exclude):
    return materialize(changed_rows(old, new, globs, exclude).select("path", "is_new"), "changed")


def changed_corpus(old, new, globs=None, exclude=None, changed=None):
    """The rows of `new` that were added or modified since `old`, with `is_new`."""
    changed = _changed(old, new, globs, exclude) if changed is None else changed
    short = changed.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    return new.drop("is_new").join(F.broadcast(changed) if short else changed, "path")


def review_changed(old, new, rules, scorer, opts, cache=None, globs=None, exclude=None, changed_lines_only=False):
    """A review of only the rows that changed between two snapshots; `changes` has `is_new` and hunks of each.

    `changed_lines_only` keeps the findings on lines that were added or changed, before any are capped.
    """
    paths = _changed(old, new, globs, exclude)
    changes = diff_hunks(old, new, changed=paths)
    if changed_lines_only:
        changes = materialize(changes, "changes")
        opts = replace(opts, diffs=changes)
    result = review(changed_corpus(old, new, changed=paths), rules, scorer, opts, cache)
    return replace(result, changes=changes)
