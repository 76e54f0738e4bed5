"""Scoring rows with a pluggable scorer: prompt in, structured answer out, answer checked into findings."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulelens.functions.findings import with_issue_id
from rulelens.functions.patterns import any_of
from rulelens.functions.text import estimate_tokens
from rulelens.schemas import (
    ANSWER,
    ANSWER_CORRUPT,
    DEFAULT_CONFIDENCE,
    EMPTY_ANSWER,
    FINDINGS,
    LEVELS,
    MAX_TITLE_CHARS,
    SCORED,
)


def rule_line(rule):
    """A rule as the prompt lists it: one JSON object."""
    return json.dumps({"rule": rule.rule_id, "level": rule.level, "name": rule.name, "about": rule.description}, ensure_ascii=False)


def build_prompt(path, content, rule_ids, rules, language="en", max_chars=None):
    """Prompt text of a row: path, one line per applicable rule, the text (only its first `max_chars` if asked for)."""
    if rules:
        lines = F.create_map(*[F.lit(x) for r in rules for x in (r.rule_id, rule_line(r))])
        listing = F.array_join(F.transform(rule_ids, lambda i: F.element_at(lines, i)), "\n")
    else:
        listing = F.lit("")
    ask = "" if language == "en" else f"Write titles, reasons and actions in {language}.\n"
    return F.concat(
        F.lit(f"{ask}Review the text below against the listed rules. Answer with JSON.\n\nPath: "),
        F.coalesce(path, F.lit("")),
        F.lit("\n\nRules:\n"),
        listing,
        F.lit("\n\nText:\n"),
        F.coalesce(content if max_chars is None else F.substring(content, 1, max_chars), F.lit("")),
        F.lit("\n"),
    )


def with_prompt(rows, rules, language="en", max_chars=None):
    prompt = build_prompt(F.col("path"), F.col("content"), F.col("rule_ids"), rules, language, max_chars)
    return rows.withColumn("prompt", prompt)


def prompt_stats(rows, max_chars=None):
    """Size of each prompt, its estimated tokens, number of rules and whether the text was cut."""
    return rows.select(
        "path",
        F.length("prompt").cast("bigint").alias("prompt_chars"),
        estimate_tokens(F.col("prompt")).alias("prompt_tokens"),
        F.size("rule_ids").cast("bigint").alias("rules"),
        (F.lit(False) if max_chars is None else F.length("content") > max_chars).alias("truncated"),
    )


def canned_answer(prompt, responses):
    """Deterministic scorer as an expression: the first response whose key occurs in the prompt."""
    out = None
    for key, response in responses.items():
        hit = prompt.contains(key)
        out = F.when(hit, F.lit(response)) if out is None else out.when(hit, F.lit(response))
    return F.lit(EMPTY_ANSWER) if out is None else out.otherwise(F.lit(EMPTY_ANSWER))


def canned_scorer(responses):
    """Deterministic scorer as a plug for `score_with`; it never leaves the JVM."""

    def scored(prompt):
        answer = canned_answer(prompt, responses)
        return F.struct(
            answer.alias("response_json"),
            estimate_tokens(prompt).alias("prompt_tokens"),
            estimate_tokens(answer).alias("completion_tokens"),
            F.lit(0).cast("bigint").alias("duration_ms"),
            F.lit(None).cast("string").alias("error"),
        )

    return scored


def python_scorer(answer, batch_size=32):
    """Wrap `answer(prompts) -> list of JSON texts` as a plug for `score_with`.

    It is called with up to `batch_size` prompts, as many calls at a time as there are tasks; only the prompt
    travels to Python. A failing call is reported in the `error` of its own rows and does not end the job.
    """

    def call(prompts):
        import time

        began = time.monotonic()
        try:
            texts, error = list(answer(prompts)), None
            if len(texts) != len(prompts):
                raise ValueError("a scorer must return one answer per prompt")
        except Exception as failure:
            texts, error = [None] * len(prompts), repr(failure)
        spent = int((time.monotonic() - began) * 1000) // len(prompts)
        return [(t, len(p) // 4, len(t or "") // 4, spent, error) for p, t in zip(prompts, texts)]

    names = SCORED.fieldNames()

    def run(batches):
        import pandas as pd

        for batch in batches:
            prompts = list(batch)
            starts = range(0, len(prompts), batch_size)
            rows = [row for i in starts for row in call(prompts[i : i + batch_size])]
            texts = {name: object for name in ("response_json", "error")}
            yield pd.DataFrame(rows, columns=names).astype(texts)

    def scored(prompt):
        from collections.abc import Iterator

        import pandas as pd

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
        return F.pandas_udf(run, SCORED).asNondeterministic()(prompt)

    return scored


def score_with(rows, scorer):
    """Add `answer` (the SCORED struct) to rows that have a `prompt`. Text columns stay in the JVM."""
    return rows.withColumn("answer", scorer(F.col("prompt")))


def parse_answer(text):
    """Answer text as a struct; `_corrupt` is set where it is not the expected JSON."""
    return F.from_json(text, ANSWER, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": ANSWER_CORRUPT})


def _line_number(text):
    """A whole number however it is written (3, 3.0, "3"); null for anything else."""
    number = text.try_cast("double")
    return F.when((number == F.floor(number)) & (F.abs(number) < 2**31), number.cast("int"))


def _issue_fields(issue):
    """The fields of one issue, with defaults for the optional ones."""
    fields = {name: issue[name] for name in ("rule_id", "level", "title", "why", "do")}
    fields["start_line"] = _line_number(issue["location"]["start_line"])
    fields["end_line"] = _line_number(issue["location"]["end_line"])
    fields["confidence"] = F.coalesce(issue["confidence"], F.lit(DEFAULT_CONFIDENCE))
    fields["tags"] = F.coalesce(issue["tags"], F.array().cast("array<string>"))
    return fields


_PARSED_FIELDS = ["rule_id", "level", "start_line", "end_line", "title", "why", "do", "confidence", "tags"]


def _explode_issues(parsed):
    key = [c for c in ("path", "file_hash") if c in parsed.columns]
    rows = parsed.select(*key, F.posexplode("_parsed.issues").alias("ordinal", "_i"))
    fields = _issue_fields(F.col("_i"))
    return rows.select(*key, "ordinal", *[fields[name].alias(name) for name in _PARSED_FIELDS])


def parse_responses(rows, json_col="response_json"):
    """One row per issue of each answer, as the model gave it, with its position; nothing is checked."""
    return _explode_issues(rows.select("path", parse_answer(F.col(json_col)).alias("_parsed")))


_TEXT_LIST = ["ARRAY<STRING>", "ARRAY<VOID>"]


def _wrong_types(variant):
    """Whether a field of any issue has another JSON type than text, list of texts or number; the typed parse
    alone would turn a number into text and could not tell null from absent."""

    def type_of(value, field):
        return F.coalesce(F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant")), F.lit("absent"))

    def odd(issue):
        texts = [~type_of(issue, name).isin("STRING", "VOID", "absent") for name in ("rule_id", "level", "title", "why")]
        lists = [~type_of(issue, name).isin(*_TEXT_LIST, "absent") for name in ("do", "tags")]
        return any_of([*texts, *lists, type_of(issue, "confidence") == "VOID"])

    issues = F.try_variant_get(variant, "$.issues", "array<variant>")
    return F.coalesce(F.exists(issues, odd), F.lit(False)) | (type_of(variant, "issues") == "VOID")


def answer_fault(parsed, text, error=None):
    """Why a whole answer is rejected, or null: a failed call, bad JSON, a missing or out-of-range field."""
    issues = parsed["issues"]

    def lacks_field(i):
        needed = [i["rule_id"], i["level"], i["location"]["start_line"], i["title"], i["why"], i["do"]]
        return any_of([field.isNull() for field in needed])

    def odd_line(i):
        ends = [i["location"][name] for name in ("start_line", "end_line")]
        return any_of([end.isNotNull() & _line_number(end).isNull() for end in ends])

    def bad_confidence(i):
        return F.coalesce((i["confidence"] < 0) | (i["confidence"] > 1), F.lit(False))

    def has_gap(texts):
        return F.coalesce(F.exists(texts, lambda t: t.isNull()), F.lit(False))

    variant = F.try_parse_json(text)
    no_object = ~F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))
    fault = (
        F.when(no_object | parsed[ANSWER_CORRUPT].isNotNull(), "malformed")
        .when(
            _wrong_types(variant) | F.exists(issues, lambda i: has_gap(i["do"]) | has_gap(i["tags"]) | odd_line(i)), "wrong_type"
        )
        .when(F.exists(issues, lacks_field), "missing_field")
        .when(F.exists(issues, lambda i: F.length(i["title"]) > MAX_TITLE_CHARS), "title_too_long")
        .when(F.exists(issues, bad_confidence), "confidence_range")
    )
    return fault if error is None else F.when(error.isNotNull(), "call_failed").otherwise(fault)


def check_answers(rows, json_col="response_json", error_col=None):
    """Add `_parsed` and `fault` to rows with an answer text; the text is parsed once."""
    error = F.col(error_col) if error_col else None
    parsed = rows.withColumn("_parsed", parse_answer(F.col(json_col)))
    return parsed.withColumn("fault", answer_fault(F.col("_parsed"), F.col(json_col), error))


def validate_findings(rows, json_col="response_json", error_col=None):
    """`(good, rejected)`: findings of valid answers, and a quarantine table with reasons.

    A fault anywhere rejects its whole answer (`ordinal` is null); an unknown level drops that one finding.
    """
    checked = check_answers(rows, json_col, error_col)
    found = _explode_issues(checked.filter("fault is null"))
    known = F.col("level").isin(LEVELS)
    key = [c for c in ("path", "file_hash") if c in rows.columns]
    whole = checked.filter("fault is not null").select(
        *key, F.lit(None).cast("int").alias("ordinal"), F.col("fault").alias("reject_reason")
    )
    single = found.filter(~known).select(*key, "ordinal", F.lit("unknown_level").alias("reject_reason"))
    return found.filter(known), whole.unionByName(single)


_FLAT = T.StructType([f for f in FINDINGS.fields if f.name != "issue_id"])


def finding_array(pack):
    """Flat findings of a checked answer as an array; empty for a faulty one, without unknown levels."""

    def to_finding(issue):
        given = _issue_fields(issue) | {"path": F.col("path"), "pack": F.lit(pack), "source": F.lit("llm")}
        columns = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in _FLAT.fields]
        return F.struct(*columns)

    valid = F.filter("_parsed.issues", lambda i: i["level"].isin(LEVELS))
    found = F.when(F.col("fault").isNull(), F.transform(valid, to_finding))
    return F.coalesce(found, F.array().cast(T.ArrayType(_FLAT)))


def explode_findings(rows, array_col="findings"):
    """Flat findings of an array column, with ids."""
    flat = rows.select(F.explode(array_col).alias("_f")).select("_f.*")
    return with_issue_id(flat).select(FINDINGS.fieldNames())
