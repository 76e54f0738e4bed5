"""Substring dedup as a relative Lempel-Ziv parse: documents are factored against all text of smaller doc_id.

The reference is cut into blocks: runs of windows of 13 words that share an anchor, the smallest hash of any five words in
the window. Equal windows have equal anchors, so a document's factors can only come from blocks under its own
anchors, and an anchor that one document alone has indexes nothing. The windows of the blocks under an anchor are an index
to places of the reference; each window of a document is looked up there and gets the first place of the smallest id.

A document is then parsed from its first word on: a factor starts where a window was found and goes on word by word as long as
the reference does, then the next one takes over. Factors name their place in the reference. Windows across a factor boundary
are looked up like all others, so a boundary ends no duplicate span that goes on in another reference.
"""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from rulelens.llm.texts import Words, arrow_list, mix, signed, slices, whole_ids

WINDOW = 13
ANCHOR = 5
RUN = 32
BLANKS = " \t\n\x0b\x0c\r"
FACTOR = "start:int,length:int,ref_id:bigint,ref_start:int"
WORD = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")


def _anchored(words, window):
    """`(places, windows, anchors)`: where windows start, their hashes, and the smallest hash of words inside each."""
    span = min(ANCHOR, window)
    small, at = words.grams(span)
    full, places = words.grams(window)
    if not len(places):
        return places, full, full
    wide = np.full(len(words.hash), np.iinfo(np.uint64).max, np.uint64)
    wide[at] = small
    size = len(words.hash) - window + 1
    least = wide[:size].copy()
    for k in range(1, window - span + 1):
        np.minimum(least, wide[k : k + size], out=least)
    return places, full, least[places]


def _runs(words, places, anchors):
    """Starts of runs: up to 32 consecutive windows of one text under one anchor."""
    new = np.ones(len(places), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (places[1:] != places[:-1] + 1)
    new[1:] |= words.row[places[1:]] != words.row[places[:-1]]
    starts = np.flatnonzero(new)
    since = np.arange(len(places)) - np.repeat(starts, np.diff(np.append(starts, len(places))))
    return np.flatnonzero(since % RUN == 0)


def _anchor_rows(window):
    def convert(batches):
        for batch in batches:
            for at, n in slices(batch, "text"):
                words = Words(batch["text"].slice(at, n))
                places, _, anchors = _anchored(words, window)
                starts = _runs(words, places, anchors)
                row, anchor = words.row[places[starts]], anchors[starts]
                order = np.lexsort((anchor, row))
                row, anchor = row[order], anchor[order]
                keep = np.ones(len(row), bool)
                keep[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
                ids = batch["id"].slice(at, n).take(pa.array(row[keep]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(signed(anchor[keep]))], names=["id", "anchor"])

    return convert


def _shared(batches):
    """From rows sorted by anchor and id: those whose anchor more than one id has. Keeps one run of equal rows open."""
    held = None  # first row of the anchor that is open, while no second id was seen
    open_anchor, open_id, known = None, None, False
    for batch in batches:
        anchor, ids = batch["anchor"].to_numpy(), batch["id"].to_numpy()
        if not len(anchor):
            continue
        begins = np.ones(len(anchor), bool)
        begins[1:] = anchor[1:] != anchor[:-1]
        if open_anchor is not None and anchor[0] == open_anchor:
            begins[0] = False
        group = np.cumsum(begins)  # 0: continues the open anchor
        first = np.concatenate([[open_id if open_id is not None else 0], ids[begins]])
        several = np.bincount(group[ids != first[group]], minlength=group[-1] + 1) > 0
        several[0] |= known
        out_ids, out_anchor = ids[several[group]], anchor[several[group]]
        if several[0] and held is not None:
            out_ids, out_anchor = np.append(out_ids, held), np.append(out_anchor, open_anchor)
            held = None
        # The last anchor of the batch stays open; of its rows one id at most is held back.
        last = group[-1]
        if begins.any():
            open_anchor, open_id, known = anchor[-1], first[last], bool(several[last])
            held = None if known else open_id
        else:
            known = bool(several[0])
            held = None if known else open_id
        yield pa.RecordBatch.from_arrays([pa.array(out_ids), pa.array(out_anchor)], names=["id", "anchor"])


def _blocks(window):
    """Runs of windows under shared anchors: `(anchor, id, start, run, windows)`."""

    def convert(batches):
        for batch in batches:
            for at, n in slices(batch, "text"):
                part = batch.slice(at, n)
                rows = np.flatnonzero(part["anchors"].is_valid().to_numpy(zero_copy_only=False))
                if not len(rows):
                    continue
                part = part.take(pa.array(rows))
                words = Words(part["text"])
                places, full, anchors = _anchored(words, window)
                starts = _runs(words, places, anchors)
                if not len(starts):
                    continue
                lists = part["anchors"]
                wanted_row = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy(zero_copy_only=False))
                wanted = _pairs(wanted_row, lists.flatten().to_numpy().view(np.uint64))
                mine = _pairs(words.row[places[starts]], anchors[starts])
                found = np.isin(mine, wanted)
                ends = np.append(starts[1:], len(places))
                starts, ends = starts[found], ends[found]
                sizes = ends - starts
                flat = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                row = words.row[places[starts]] if len(starts) else np.zeros(0, np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(anchors[starts])),
                        part["id"].take(pa.array(row)),
                        pa.array((places[starts] - words.first[row]).astype(np.int32)),
                        pa.array(signed(_digest(full[flat], offsets))),
                        arrow_list(signed(full[flat]), offsets),
                    ],
                    names=["anchor", "id", "start", "run", "windows"],
                )

    return convert


def _pairs(row, h):
    """One 64-bit key of a text of the batch and a hash."""
    return mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _digest(values, offsets):
    """One hash of each list."""
    if not len(values):
        return np.zeros(len(offsets) - 1, np.uint64)
    step = np.arange(len(values), dtype=np.uint64) - np.repeat(offsets[:-1], np.diff(offsets)).astype(np.uint64)
    return np.add.reduceat(mix(values + (step + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), offsets[:-1])


def _found(batches):
    """From windows sorted by anchor, hash, id and place: those that a smaller id has too, with its first place there."""
    last = None
    for batch in batches:
        anchor, window, ids, place = (batch[c].to_numpy() for c in ("anchor", "window", "id", "place"))
        if not len(ids):
            continue
        begins = np.ones(len(ids), bool)
        begins[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1])
        if last is not None and (anchor[0], window[0]) == last[:2]:
            begins[0] = False
        group = np.cumsum(begins)
        owner = np.concatenate([[last[2] if last else 0], ids[begins]])[group]
        ref = np.concatenate([[last[3] if last else 0], place[begins]])[group].astype(np.int32)
        last = (anchor[-1], window[-1], owner[-1], ref[-1])
        later = pa.array(owner < ids)
        columns = [batch[c] for c in ("id", "place", "run", "k")] + [pa.array(owner), pa.array(ref)]
        yield pa.RecordBatch.from_arrays([c.filter(later) for c in columns], names=["id", "place", "run", "k", "ref_id", "ref_start"])


def _segments(batches):
    """From found windows sorted by id, run and place: windows in a row whose reference goes on, as one row with their number."""
    names = ["id", "place", "run", "k", "ref_id", "ref_start"]
    for batch in batches:
        if not len(batch):
            continue
        ids, place, run, _, ref_id, ref = (batch[c].to_numpy() for c in names)
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (run[1:] != run[:-1]) | (place[1:] != place[:-1] + 1)
        new[1:] |= (ref_id[1:] != ref_id[:-1]) | (ref[1:] != ref[:-1] + 1)
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(ids))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(first)) for c in names), pa.array(many)], names=[*names, "n"])


def _matched(words, found, window):
    """Places of the windows that were found, in order, with their reference; runs are checked against the text, as an id
    may have several."""
    places, full, anchors = _anchored(words, window)
    flat = found.flatten()
    if not len(flat) or not len(places):
        return (np.zeros(0, np.int64),) * 3
    row = np.repeat(np.arange(len(found)), pc.fill_null(found.value_lengths(), 0).to_numpy(zero_copy_only=False))
    place, run, k, ref_id, ref_start, many = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(6))
    # Each window of a segment by itself.
    row, place, run, k, ref_id, ref_start = (np.repeat(x, many) for x in (row, place, run, k, ref_id, ref_start))
    step = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    place, k, ref_start = place + step, k + step, ref_start + step
    starts = _runs(words, places, anchors)
    digests = signed(_digest(full, np.append(starts, len(places))))
    begin = words.first[row] + place - k
    at = np.minimum(np.searchsorted(places[starts], begin), len(starts) - 1)
    good = (places[starts[at]] == begin) & (digests[at] == run) & (begin < words.first[row + 1])
    at, first = np.unique((begin + k)[good], return_index=True)
    return at, ref_id[good][first], ref_start[good][first]


def _factors(words, found, window):
    """The parse: `(gone, factors)`; whether each word is in a factor, and each text's (start, length, ref_id, ref_start)."""
    at, ref_id, ref = found
    covered = np.zeros(len(words.hash) + window + 1, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + window, -1)
    gone = np.cumsum(covered)[: len(words.hash)] > 0
    row = words.row[at]
    new = np.ones(len(at), bool)  # a reference that does not go on
    new[1:] = (at[1:] != at[:-1] + 1) | (ref_id[1:] != ref_id[:-1]) | (ref[1:] != ref[:-1] + 1) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    row, start, ref_id, ref = row[first], at[first], ref_id[first], ref[first]
    end = at[np.append(first[1:], len(at)) - 1] + window if len(first) else start
    # A factor goes to its end; the next one starts there at the earliest.
    late = start.copy()
    late[1:] = np.maximum(start[1:], np.where(row[1:] == row[:-1], end[:-1], 0))
    length, ref = end - late, ref + late - start
    offsets = np.searchsorted(row, np.arange(len(words.first)))
    columns = [(late - words.first[row]).astype(np.int32), length.astype(np.int32), ref_id, ref.astype(np.int32)]
    names = ["start", "length", "ref_id", "ref_start"]
    return gone, arrow_list(pa.StructArray.from_arrays([pa.array(c) for c in columns], names), offsets)


def _parsed(window, cut):
    """Rows `(id, rest, n_words, n_removed, factors, text)`; the text is cut in place or its kept words joined."""

    def convert(batches):
        for batch in batches:
            for at, n in slices(batch, "text"):
                part = batch.slice(at, n)
                words = Words(part["text"])
                gone, factors = _factors(words, _matched(words, part["found"], window), window)
                removed = np.bincount(words.row[gone], minlength=n)
                if cut:
                    text = part["text"].to_pylist()
                    for i in np.flatnonzero(removed):
                        mine = gone[words.first[i] : words.first[i + 1]]
                        text[i] = "".join(w for w, out in zip(WORD.findall(text[i]), mine) if not out).lstrip(BLANKS)
                    text = pa.array(text, pa.string())
                else:
                    kept = np.concatenate([[0], np.cumsum(~gone)])[words.first]
                    text = pc.binary_join(arrow_list(words.flat.filter(pa.array(~gone)), kept), " ")
                yield pa.RecordBatch.from_arrays(
                    [part["id"], part["rest"], pa.array(words.counts), pa.array(removed), factors, text],
                    names=["id", "rest", "n_words", "n_removed", "factors", "text"],
                )

    return convert


def _parse(docs, rest, window, cut, id_col, text_col):
    whole_ids(docs, id_col)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), rest.alias("rest"), F.col(text_col).alias("text"))
    slim = texts.filter("id is not null").select("id", "text")
    anchors = slim.mapInArrow(_anchor_rows(window), "id bigint, anchor bigint")
    sorted_anchors = anchors.repartition("anchor").sortWithinPartitions("anchor", "id")
    shared = sorted_anchors.mapInArrow(_shared, "id bigint, anchor bigint")
    wanted = shared.groupBy("id").agg(F.collect_list("anchor").alias("anchors"))
    # One exchange of the texts serves both joins.
    placed = texts.repartition("id")
    own = placed.join(wanted, "id", "left").select("id", "text", "anchors")
    blocks = own.mapInArrow(_blocks(window), "anchor bigint, id bigint, start int, run bigint, windows array<bigint>")
    windows = blocks.repartition("anchor").select("anchor", "id", "start", "run", F.posexplode("windows").alias("k", "window"))
    windows = windows.withColumn("place", F.col("start") + F.col("k")).drop("start")
    found = windows.sortWithinPartitions("anchor", "window", "id", "place").mapInArrow(
        _found, "id bigint, place int, run bigint, k int, ref_id bigint, ref_start int"
    )
    segments = found.repartition("id").sortWithinPartitions("id", "run", "place").mapInArrow(
        _segments, "id bigint, place int, run bigint, k int, ref_id bigint, ref_start int, n int"
    )
    listed = segments.groupBy("id").agg(F.collect_list(F.struct("place", "run", "k", "ref_id", "ref_start", "n")).alias("found"))
    joined = placed.join(listed, "id", "left")
    kind = dict(joined.dtypes)["rest"]
    schema = f"id bigint, rest {kind}, n_words bigint, n_removed bigint, factors array<struct<{FACTOR}>>, text string"
    return joined.select("id", "rest", "text", "found").mapInArrow(_parsed(window, cut), schema)


def substring_dedup(docs, window=WINDOW, id_col="doc_id", text_col="text"):
    """Factors of every text that repeat text of a smaller id: `(id, n_words, n_removed, factors, kept)`.

    Words are runs of anything but ASCII white space. `factors` (start, length, ref_id, ref_start) are spans of words, equal to as many
    words of a smaller id from `ref_start` on; together they are all words in a window of `window` words that also starts
    in a text of a smaller id; windows are judged on the input. `kept` has the other words, joined by a space. A null text has no words; rows with a null id are kept whole
    and are no reference; rows of one id are one document; repeated rows map one to one. Other columns are not looked at.
    Ids are whole numbers; others are an error.
    """
    parsed = _parse(docs, F.lit(None).cast("boolean"), window, False, id_col, text_col)
    return parsed.select(F.col("id").alias(id_col), "n_words", "n_removed", "factors", F.col("text").alias("kept"))


def cut_duplicates(docs, window=WINDOW, id_col="doc_id", text_col="text"):
    """`docs` with the repeated spans cut out of the text; a document of which nothing is left goes.

    Untouched texts stay as they are, null and empty ones too; in others each kept word keeps the white space before it.
    """
    names = docs.columns
    rest = F.struct(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names) if n != text_col], F.lit(0).alias("_"))
    parsed = _parse(docs, rest, window, True, id_col, text_col).filter("n_removed = 0 or n_removed < n_words")
    return parsed.select(
        *[F.col("text").alias(n) if n == text_col else F.col("rest")[f"c{i}"].alias(n) for i, n in enumerate(names)]
    )


# ---- the same in DuckDB SQL ----


def substring_sql(source, window=WINDOW):
    """CTEs ending in `parsed`: doc_id, n_words, n_removed, kept."""
    return f"""worded AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM {source}),
windows AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + {window - 1}), ' ') AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {window - 2})) AS i FROM worded)),
owners AS (SELECT w, min(doc_id) AS owner FROM windows GROUP BY w),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS p FROM windows JOIN owners USING (w) WHERE owner < doc_id),
gone_lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
parsed AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
         CASE WHEN ps IS NULL THEN array_to_string(ws, ' ') ELSE array_to_string(
           list_filter(ws, lambda w, i: NOT list_contains(ps, i)), ' ') END AS kept
  FROM worded LEFT JOIN gone_lists USING (doc_id))"""
