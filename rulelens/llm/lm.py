"""Cross-entropy difference: how much better a target model foretells a text than a background model of all other texts.

Both are bigram models interpolated with unigrams over one vocabulary, with counts of every word of every text. They are
matched: unseen words get the same share in both, so a difference in size makes no difference. A text is never foretold
by itself: its own counts are left out of its model.

Texts are put into chunks of bounded size. A chunk deals its distinct words and pairs, sorted by 63-bit hash, to ranges of hashes
as packed columns; a range adds up what all chunks have and hands each chunk its totals back, in the order the chunk has
them. So each word or pair is moved once a chunk, the tables grow with the corpus, and no task holds more than a chunk or a range.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from rulelens.llm.texts import PRIME, Words, mix, signed, slices
from rulelens.plans.joins import MAX_BROADCAST_ROWS
from rulelens.plans.storage import materialize

# Weight of a pair's share in its context, and how many times a word of the target counts without being seen.
PAIR_WEIGHT, UNSEEN = 0.6, 0.1
# Hash of the mark before a text's first word.
BEGIN = np.uint64(0x2545F4914F6CDD1D)
# Texts of one chunk, in bytes; one longer text is a chunk alone.
CHUNK_BYTES = 5 << 20
# Words of all chunks for each range of hashes.
RANGE_WORDS = 2 << 20
SIDES = ("target", "background")


class Grams:
    """Words and pairs of a chunk's texts.

    `keys`: sorted distinct hashes, words even and pairs odd; `word`, `pair`, `before`: for every word the places of its own, its pair's
    and the word's before it in `keys`.
    """

    def __init__(self, texts):
        words = Words(texts, lower=True)
        self.row, self.counts = words.row.astype(np.int32), words.counts
        self.begins = words.first[:-1][words.counts > 0]
        code, types = words.code.astype(np.int64), len(words.known)
        hashes = np.append(np.zeros(types, np.uint64), BEGIN)
        hashes[code] = words.hash
        del words
        before = np.empty_like(code)
        before[1:] = code[:-1]
        before[self.begins] = types
        pairs, pair = np.unique(before * (types + 1) + code, return_inverse=True)
        pair_keys = mix(hashes[pairs // (types + 1)] * PRIME + hashes[pairs % (types + 1)]) | np.uint64(1)
        word_keys = hashes[: types + (len(self.begins) > 0)] & ~np.uint64(1)
        self.keys, place = np.unique(np.concatenate([word_keys, pair_keys]), return_inverse=True)
        place = place.astype(np.int32)
        self.word, self.before, self.pair = place[code], place[before], place[len(word_keys) :][pair]
        self.mark = place[np.full(len(self.begins), types)]

    def added(self, weights=None):
        """Sums of the words' weights for each key; a text's mark weighs what its first word does."""
        one = None if weights is None else weights[self.begins]
        total = np.zeros(len(self.keys), np.int64)
        for places, own in ((self.word, weights), (self.pair, weights), (self.mark, one)):
            total += np.bincount(places, own, len(self.keys)).astype(np.int64)
        return total

    def own(self, held, asked):
        """How often each word's text has the key at its place in `asked` among those at its places in `held`."""
        base = self.row.astype(np.int64) * len(self.keys)
        known, counts = np.unique(base + held, return_counts=True)
        place = np.minimum(np.searchsorted(known, base + asked), len(known) - 1)
        return np.where(known[place] == base + asked, counts[place], 0) if len(known) else np.zeros(0, np.int64)


def _marked(docs, target_ids, id_col, text_col):
    """`(id, text, target)`: whether the text is one of the target's."""
    ids = target_ids.select(F.col(id_col).alias("_id")).filter("_id is not null").distinct()
    ids = materialize(ids.withColumn("target", F.lit(True)), "targets")
    short = ids.count() <= MAX_BROADCAST_ROWS
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(ids) if short else ids, F.col("id") == F.col("_id"), "left")
    return rows.select("id", "text", F.coalesce("target", F.lit(False)).alias("target"))


def _packed(batch):
    """A record batch as compressed bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data):
    return pa.ipc.open_stream(data).read_all().combine_chunks().to_batches()


def _chunks(batches):
    """Rows `(chunk, texts, target_words, background_words)`: texts of one task, packed, up to `CHUNK_BYTES`."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for at, n in slices(batch, "text", CHUNK_BYTES):
            part = batch.slice(at, n)
            words, target = Words(part["text"]), part["target"].to_numpy(zero_copy_only=False)
            sides = [int(words.counts[side].sum()) for side in (target, ~target)]
            columns = [[number], [_packed(part)], *([s] for s in sides)]
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["chunk", "texts", "target_words", "background_words"]
            )
            number += 1


def _range_ends(keys, bits):
    """Where the keys of each range end: ranges go by the first bits."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def _columns(**columns):
    return _packed(pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns)))


def _arrays(packed, *names):
    """Columns of packed batches, one after the other, as arrays."""
    batches = [batch for data in packed for batch in _unpacked(data.as_buffer())]
    return [np.concatenate([np.zeros(0, np.int64), *(batch[name].to_numpy() for batch in batches)]) for name in names]


def _dealt(bits):
    """Rows `(range, chunk, counts)`: the keys of a chunk in a range of hashes and their counts on both sides, packed."""

    def convert(batches):
        for batch in batches:
            for chunk, data in zip(batch["chunk"].to_pylist(), batch["texts"]):
                for part in _unpacked(data.as_buffer()):
                    grams = Grams(part["text"])
                    target = part["target"].to_numpy(zero_copy_only=False).astype(float)[grams.row]
                    keys, sides = signed(grams.keys), [grams.added(w) for w in (target, 1 - target)]
                    ends = _range_ends(grams.keys, bits)
                    cuts = [(i, a, b) for i, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]
                    counts = [_columns(key=keys[a:b], **{side: n[a:b] for side, n in zip(SIDES, sides)}) for _, a, b in cuts]
                    columns = [[i for i, _, _ in cuts], [chunk] * len(cuts), counts]
                    kinds = (pa.int32(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["range", "chunk", "counts"])

    return convert


def _totals(table):
    """Of one range: for each chunk the totals of its keys, packed, and once, in its first row, how many words are known."""
    table = table.combine_chunks()
    packed = table["counts"].combine_chunks()
    sizes = [sum(map(len, _unpacked(data.as_buffer()))) for data in packed]
    keys, *sides = _arrays(packed, "key", *SIDES)
    keys, place = np.unique(keys, return_inverse=True)
    sums = [np.bincount(place, side, len(keys)).astype(np.int64) for side in sides]
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    totals = [_columns(**{side: total[place[a:b]] for side, total in zip(SIDES, sums)}) for a, b in zip(cuts, cuts[1:])]
    known = np.zeros(len(table), np.int64)
    known[:1] = np.count_nonzero((keys & 1) == 0)
    return pa.Table.from_arrays([table["range"], table["chunk"], pa.array(known), pa.array(totals, pa.binary())], names=["range", "chunk", "known", "totals"])


def _losses(grams, target_doc, totals, sizes, known):
    """Negative log probability of every word in both models, the word's own text left out."""
    size = grams.counts[grams.row]
    out = []
    own = [grams.own(grams.word, grams.word), grams.own(grams.pair, grams.pair), grams.own(grams.word, grams.before)]
    own[2][grams.begins] = 1  # a text has one mark
    scale = sizes[1] / sizes[0] if all(sizes) else 1.0
    for mine, total, n, unseen in zip((target_doc, ~target_doc), totals, sizes, (UNSEEN, UNSEEN * scale)):
        less = mine[grams.row].astype(np.int64)
        word, pair, before = (total[places] - less * o for places, o in zip((grams.word, grams.pair, grams.before), own))
        single = (word + unseen) / (n - less * size + unseen * known)
        share = np.where(before > 0, pair / np.maximum(before, 1), single)
        out.append(-np.log(PAIR_WEIGHT * share + (1 - PAIR_WEIGHT) * single))
    return out


def _scored(sizes, known):
    names = ["id", "n_tokens", "target_loss", "background_loss", "score"]

    def convert(chunks, totals):
        order = np.argsort(totals["range"].to_numpy())
        sums = _arrays(totals["totals"].take(pa.array(order)), *SIDES)
        out = []
        for data in chunks["texts"]:
            for part in _unpacked(data.as_buffer()):
                grams = Grams(part["text"])
                if len(grams.keys) != len(sums[0]):
                    raise ValueError("a chunk's totals do not fit its texts")
                loss = _losses(grams, part["target"].to_numpy(zero_copy_only=False), sums, sizes, known)
                many = grams.counts
                mean = [np.bincount(grams.row, values, minlength=len(part)) / np.maximum(many, 1) for values in loss]
                columns = [pa.array(v, mask=many == 0) for v in (*mean, mean[1] - mean[0])]
                out.append(pa.RecordBatch.from_arrays([part["id"], pa.array(many), *columns], names=names))
        return pa.Table.from_batches(out)

    return convert


def cross_entropy_difference(docs, target_ids, id_col="doc_id", text_col="text"):
    """`(id, n_tokens, target_loss, background_loss, score)`: mean losses per word, and background less target.

    `target_ids` has the ids of the target's texts; all other texts are the background. A-Z are lower-cased, words are runs of
    anything but ASCII white space. A word's probability is PAIR_WEIGHT times its pair's share of the word before it (of the
    word itself where that was never seen) plus the rest times its own share, smoothed over all words known to either
    model. A text without words, a null one too, has null losses and score and counts for nothing. Rows map one to one,
    repeated ones (each counts; a row leaves out itself only) and null ids (background) included; an empty table gives no
    rows; repeated or null target ids change nothing; other columns are not looked at. Hashes of 63 bits stand for words and pairs.
    """
    chunks = materialize(_marked(docs, target_ids, id_col, text_col).mapInArrow(
        _chunks, "chunk bigint, texts binary, target_words bigint, background_words bigint"
    ), "chunks")
    sizes = [n or 0 for n in chunks.agg(F.sum("target_words"), F.sum("background_words")).first()]
    bits = (2 * sum(sizes) // RANGE_WORDS).bit_length()
    dealt = chunks.select("chunk", "texts").mapInArrow(_dealt(bits), "range int, chunk bigint, counts binary")
    totals = dealt.groupBy("range").applyInArrow(_totals, "range int, chunk bigint, known bigint, totals binary")
    totals = materialize(totals, "totals")
    known = 1 + (totals.agg(F.sum("known")).first()[0] or 0)
    kind = docs.select(id_col).dtypes[0][1]
    schema = f"id {kind}, n_tokens bigint, target_loss double, background_loss double, score double"
    mine, counted = chunks.select("chunk", "texts").groupBy("chunk"), totals.drop("known").groupBy("chunk")
    return mine.cogroup(counted).applyInArrow(_scored(sizes, known), schema).withColumnRenamed("id", id_col)


# ---- the same in DuckDB SQL ----


def difference_sql(source, targets):
    """CTEs ending in `scored`: doc_id, n_tokens, target_loss, background_loss, score; `targets` has the target's doc_ids."""

    def loss(side, mine):
        own = lambda name: f"(CASE WHEN {mine} THEN {name} ELSE 0 END)"
        unseen = UNSEEN if side == "t" else f"({UNSEEN} * CASE WHEN nt > 0 AND nb > 0 THEN nb / nt ELSE 1.0 END)"
        single = f"((w{side} - {own('own_w')} + {unseen}) / (n{side} - {own('size')} + {unseen} * known))"
        before = f"(b{side} - {own('own_b')})"
        share = f"CASE WHEN {before} > 0 THEN (p{side} - {own('own_p')}) / {before} ELSE {single} END"
        return f"-ln({PAIR_WEIGHT} * {share} + (1 - {PAIR_WEIGHT}) * {single})"

    return f"""texts AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, doc_id IS NOT NULL AND doc_id IN (SELECT doc_id FROM {targets} WHERE doc_id IS NOT NULL) AS target,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x20\\x09-\\x0D]+') AS ws FROM {source}),
worded AS (SELECT row, target, len(ws) AS size, generate_subscripts(ws, 1) AS place, unnest(ws) AS w FROM texts),
paired AS MATERIALIZED (
  SELECT *, CASE WHEN place = 1 THEN '' ELSE lag(w) OVER (PARTITION BY row ORDER BY place) END AS b FROM worded),
words AS MATERIALIZED (
  SELECT w, count(*) FILTER (target) AS t, count(*) FILTER (NOT target) AS b FROM (
    SELECT w, target FROM paired UNION ALL SELECT '', target FROM paired WHERE place = 1) GROUP BY w),
pairs AS (SELECT b AS x, w, count(*) FILTER (target) AS t, count(*) FILTER (NOT target) AS b FROM paired GROUP BY ALL),
sizes AS (SELECT count(*) FILTER (target) AS nt, count(*) FILTER (NOT target) AS nb FROM paired),
known AS (SELECT count(*) + 1 AS known FROM words),
own_words AS (SELECT row, w, count(*) AS n FROM paired GROUP BY ALL),
own_pairs AS (SELECT row, b, w, count(*) AS n FROM paired GROUP BY ALL),
counted AS (
  SELECT p.row, p.target, p.size, w.t AS wt, w.b AS wb, x.t AS bt, x.b AS bb, y.t AS pt, y.b AS pb, nt, nb, known,
    ow.n AS own_w, op.n AS own_p, coalesce(ob.n, 1) AS own_b
  FROM paired p JOIN words w ON w.w = p.w JOIN words x ON x.w = p.b JOIN pairs y ON y.x = p.b AND y.w = p.w
  JOIN own_words ow ON ow.row = p.row AND ow.w = p.w JOIN own_pairs op ON op.row = p.row AND op.b = p.b AND op.w = p.w
  LEFT JOIN own_words ob ON ob.row = p.row AND ob.w = p.b, sizes, known),
losses AS (SELECT row, avg({loss('t', 'target')}) AS t, avg({loss('b', 'NOT target')}) AS b FROM counted GROUP BY row),
scored AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_tokens, t AS target_loss, b AS background_loss, b - t AS score
  FROM texts LEFT JOIN losses USING (row))"""
