"""Reviewing a stream with verdicts and waiting rows as keyed state.

Every text and rule set is a key. Its verdict is kept in the state store until it expires, so a batch looks up the keys it
has and nothing else, however many batches there were. Rows whose call failed, or for which no call was left, wait in
their key's state; a timer asks again.
"""

import sys
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from rulelens.operators.cache import with_cache_key
from rulelens.operators.match import match_rules
from rulelens.operators.scorer import check_answers, explode_findings, finding_array, with_prompt
from rulelens.schemas import CACHE_KEY, DEFAULT_TTL_HOURS

OUTCOME = "path string, file_hash string, rules_hash string, status string, response_json string, error string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_MS = 3_600_000


@contextmanager
def keyed_state(spark, idle_batches=False):
    """Streams started inside the block keep their state in RocksDB, which state with timers and expiry needs.

    Without `idle_batches` timers are looked at by batches that have rows, so that a stream over what is available
    ends; with them also while nothing arrives.
    """
    wanted = {_PROVIDER: _ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": str(idle_batches).lower()}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class KeyedReview(StatefulProcessor):
    """One call for a key that has no verdict; all its rows, also later ones, get that verdict until it expires."""

    def __init__(self, answer, ttl_ms, retry_ms, calls_per_task):
        self.answer, self.ttl_ms, self.retry_ms, self.calls_per_task = answer, ttl_ms, retry_ms, calls_per_task

    def init(self, handle):
        self.handle, self.calls = handle, 0
        self.verdict = handle.getValueState("verdict", "response_json string", self.ttl_ms)
        self.waiting = handle.getListState("waiting", "path string, prompt string")

    def _rows(self, key, paths, status, text=None, error=None):
        row = Row(*[part.split()[0] for part in OUTCOME.split(", ")])
        for path in paths:
            yield row(path, *key, status, text, error)

    def _ask(self, key, rows, timers, waited):
        """The verdict for rows `(path, prompt)`, or the rows as waiting; `waited` if some are in the state already."""
        text, error = None, "no call left"
        if self.calls_per_task is None or self.calls < self.calls_per_task:
            self.calls += 1
            try:
                text = list(self.answer([rows[0][1]]))[0]
            except Exception as failure:
                error = repr(failure)
        if text is None:
            self.waiting.put(rows)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.retry_ms)
            yield from self._rows(key, [path for path, _ in rows], "waiting", error=error)
            return
        self.verdict.update((text,))
        if waited:
            self.waiting.clear()
        yield from self._rows(key, [rows[0][0]], "scored", text)
        yield from self._rows(key, [path for path, _ in rows[1:]], "cached", text)

    def handleInputRows(self, key, rows, timerValues):
        verdict = self.verdict.get()
        if verdict is not None:
            yield from self._rows(key, (row["path"] for row in rows), "cached", verdict[0])
            return
        held = [tuple(row) for row in self.waiting.get()]
        fresh = [(row["path"], row["prompt"]) for row in rows]
        yield from self._ask(key, held + fresh, timerValues, bool(held))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = [tuple(row) for row in self.waiting.get()]
        if held:
            yield from self._ask(key, held, timerValues, True)

    def close(self):
        pass


def _first_in_batch(batches):
    for batch in batches:
        yield batch.drop_duplicates()


def review_outcomes(corpus_stream, rules, answer, language="en", ttl_hours=DEFAULT_TTL_HOURS, retry_seconds=60, calls_per_task=None, salt=None):
    """`(path, file_hash, rules_hash, status, response_json, error)` of the rows of a stream to which rules apply.

    `answer` takes prompts and returns one JSON text each. `scored`: its call was made; `cached`: the key had a verdict; `waiting`: the
    call failed or the task had made `calls_per_task` calls: the row comes out again when it is answered. Start the stream
    within `keyed_state`. Repeated rows of one Arrow batch are one row; a key's rows beyond them are handled
    in batches by the task that has its state.
    """
    matched = with_cache_key(match_rules(corpus_stream.select("path", "content"), rules), salt).filter(F.size("rule_ids") > 0)
    asked = with_prompt(matched, rules, language).select(*CACHE_KEY, "path", "prompt")
    asked = asked.mapInPandas(_first_in_batch, asked.schema)
    # The process that sets a processor up need not know this package, so the processor travels as code.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    # A timer that is already due would be dropped with the one that is just handled.
    processor = KeyedReview(answer, int(ttl_hours * HOUR_MS), max(1, int(retry_seconds * 1000)), calls_per_task)
    return asked.groupBy(*CACHE_KEY).transformWithState(
        statefulProcessor=processor, outputStructType=OUTCOME, outputMode="Append", timeMode="ProcessingTime"
    )


def findings_of_outcomes(outcomes, pack):
    """Findings of answered rows, `(path, ...)` as the batch review has them; faulty answers give none."""
    answered = outcomes.filter("status <> 'waiting'").select("path", "file_hash", "response_json")
    return explode_findings(check_answers(answered).withColumn("findings", finding_array(pack)))
