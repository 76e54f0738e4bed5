"""Frequent word sequences whose words occur together far more often than their parts would by chance.

Texts are read four times, each time by tasks that hold tables of bounded size:

1. every word of a language is counted, and how many sequences each hash partition gets (its mass);
2. Misra-Gries summaries of all pairs of frequent words, 3. of all longer sequences made of pairs that may be frequent:
   each hash partition has several times as many counters as its mass divided by the threshold, so the sum of all
   decrements of a partition stays below a share of the threshold, and what is frequent keeps a counter;
4. sequences that may be frequent are counted exactly, as texts.

Summaries merge by adding counters and decrements; a task that reaches its memory bound hands its summary over and begins
another. What may be frequent reaches tasks as a bit table of bounded size that never misses a member (`Sieve`).
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from rulelens.llm.texts import PRIME, Words, arrow_list, mix, signed, slices
from rulelens.plans.joins import lookup_join
from rulelens.plans.storage import materialize

LONGEST = 5
UNNAMED = "und"
# A key's first bits are its hash partition.
PARTITION_BITS = 6
PARTITIONS = 1 << PARTITION_BITS
# Counters of a partition: so many times its mass divided by the threshold. The more, the fewer candidates there are in vain.
CAPACITY = 8
# Counters a task keeps, and keys it gathers before they are added to them.
MAX_COUNTERS, BUFFERED = 2_000_000, 1_000_000
# Bits of a sieve: at least so many for each member, as far as the bound allows.
SIEVE_BITS_EACH, MIN_SIEVE, MAX_SIEVE = 32, 1 << 16, 1 << 26
# Rows a task adds up before it hands them over.
MAX_ROWS = 500_000
# Occurrences for each range of phrases that are added up together.
RANGE_MASS = 1 << 22
SALTS = 64

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(10 if b in _BREAKS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Pieces(Words):
    """Lower-cased words of texts, with the piece (a stretch without breaks) and the language each stands in."""

    def __init__(self, texts, langs):
        texts = pc.fill_null(texts, "").cast(pa.string())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = bytes(memoryview(data)[offsets[0] : offsets[-1]]).translate(_TABLE) if data else b""
        offsets = offsets - offsets[0]
        super().__init__(pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(data)))
        byte = np.frombuffer(data, np.uint8)
        blank = (byte == 32) | (byte == 10)
        starts = ~blank
        starts[1:] &= blank[:-1]
        begin = offsets[:-1][offsets[:-1] < offsets[1:]]
        starts[begin] = ~blank[begin]
        pieces = byte == 10
        pieces[begin] = True  # a text begins a piece
        self.piece = np.cumsum(pieces, dtype=np.int32)[starts]
        coded = pc.fill_null(langs, UNNAMED).dictionary_encode()
        self.langs = coded.dictionary
        lang = coded.indices.to_numpy(zero_copy_only=False)
        self.lang = lang[self.row]
        salts = np.fromiter(map(xxhash.xxh3_64_intdigest, self.langs.to_pylist()), np.uint64, len(self.langs))
        self.salt = mix(salts)[self.lang] if len(salts) else np.zeros(0, np.uint64)

    def keys(self, n):
        """64-bit keys of the sequences of n words inside pieces, by language, and the places they start at."""
        size = len(self.hash) - n + 1
        if size <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = self.salt[:size].copy()
        for k in range(n):
            total = total * PRIME + self.hash[k : k + size]
        places = np.flatnonzero(self.piece[:size] == self.piece[n - 1 :])
        return mix(total[places] + np.uint64(n)), places

    def sifted(self, n, sieve, size):
        """As `keys(n)`, only of the sequences all of whose sequences of `size` words may be in the sieve."""
        keys, places = self.keys(size)
        able = np.zeros(len(self.hash) + 1, bool)
        able[places[sieve.has(keys)]] = True
        keys, places = self.keys(n)
        keep = np.ones(len(places), bool)
        for k in range(n - size + 1):
            keep &= able[places + k]
        return keys[keep], places[keep]


class Sieve:
    """Bits set by keys: `has` is true for every key put in, and for few others."""

    def __init__(self, bits, words):
        self.bits, self.words = bits, words

    @staticmethod
    def probes(key, bits):
        """Two bits a key, as Spark columns."""
        return [F.col(key).bitwiseAND(bits - 1), F.shiftrightunsigned(key, 26).bitwiseAND(bits - 1)]

    def has(self, keys):
        mask = np.uint64(self.bits - 1)
        out = np.ones(len(keys), bool)
        for at in (keys & mask, (keys >> np.uint64(26)) & mask):
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def sieve_of(keys):
    """The sieve of a stored table of keys. At most `MAX_SIEVE` bits reach the driver, whatever the number of keys."""
    many = keys.count()
    bits = min(MAX_SIEVE, max(MIN_SIEVE, 1 << (SIEVE_BITS_EACH * many).bit_length()))
    bit = keys.select(F.explode(F.array(*Sieve.probes("key", bits))).alias("bit"))
    one = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    table = bit.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(one).alias("word")).toArrow()
    words = np.zeros(bits >> 6, np.int64)
    words[table["at"].to_numpy()] = table["word"].to_numpy()
    return Sieve(bits, words.view(np.uint64))


def _sum_sorted(keys, counts):
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class Summary:
    """Misra-Gries counters by hash partition.

    A partition with more counters than its capacity loses, from every counter, as much as the largest one too many
    has. Each such step takes that much from more counters than the capacity, so all steps together, in however many
    summaries, take less than mass / capacity.
    """

    def __init__(self, capacity):
        self.capacity = capacity
        self.reset()

    def reset(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.cut = np.zeros(PARTITIONS, np.int64)
        self.waiting, self.n_waiting = [], 0

    def add(self, keys):
        self.waiting.append(keys)
        self.n_waiting += len(keys)
        if self.n_waiting >= BUFFERED:
            self.settle()

    def settle(self):
        keys = np.concatenate([self.keys, *self.waiting])
        counts = np.concatenate([self.counts, np.ones(self.n_waiting, np.int64)])
        self.waiting, self.n_waiting = [], 0
        if not len(keys):
            return
        self.keys, self.counts = _sum_sorted(keys, counts)
        part = (self.keys >> np.uint64(64 - PARTITION_BITS)).astype(np.int64)
        ends = np.cumsum(np.bincount(part, minlength=PARTITIONS))
        for p, (a, b) in enumerate(zip(np.concatenate([[0], ends]), ends)):
            if b - a > self.capacity[p]:
                at = b - a - self.capacity[p] - 1
                less = np.partition(self.counts[a:b], at)[at]  # the largest beyond the capacity
                self.counts[a:b] -= less
                self.cut[p] += less
        left = self.counts > 0
        self.keys, self.counts = self.keys[left], self.counts[left]

    def rows(self):
        """`(part, key, n, cut)`: counters, and for each partition its decrements with a null key."""
        self.settle()
        part = (self.keys >> np.uint64(64 - PARTITION_BITS)).astype(np.int32)
        cut = np.flatnonzero(self.cut)
        key = pa.concat_arrays([pa.array(signed(self.keys)), pa.nulls(len(cut), pa.int64())])
        columns = [np.concatenate([part, cut.astype(np.int32)]), np.concatenate([self.counts, np.zeros(len(cut), np.int64)])]
        columns.append(np.concatenate([np.zeros(len(part), np.int64), self.cut[cut]]))
        part, n, cut = map(pa.array, columns)
        return pa.RecordBatch.from_arrays([part, key, n, cut], names=["part", "key", "n", "cut"])


def _pieces(batches):
    for batch in batches:
        for at, n in slices(batch, "text"):
            yield Pieces(batch["text"].slice(at, n), batch["lang"].slice(at, n))


def _added_up(batches, keys):
    """Rows with a count `n`, added up by their keys in the task; handed over when there are too many of them."""
    held = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) > 2 * MAX_ROWS:
            held = _summed(held, keys)
            if len(held[0]) > MAX_ROWS:
                yield from held
                held = []
    if held:
        yield from _summed(held, keys)


def _summed(batches, keys):
    added = pa.Table.from_batches(batches).group_by(keys).aggregate([("n", "sum")]).rename_columns([*keys, "n"])
    return added.select(batches[0].schema.names).combine_chunks().to_batches() or [batches[0].slice(0, 0)]


def _distinct(columns):
    """First row of each distinct combination of the columns, and how often it is there."""
    order = np.lexsort(columns)
    new = np.ones(len(order), bool)
    new[1:] = False
    for column in columns:
        ranked = column[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def _words_and_masses(longest):
    """Rows `(lang, word, n, kind, part)`: words, and masses of a task (kind 2 for pairs, 3 for longer)."""

    def rows(batches):
        mass = np.zeros((2, PARTITIONS), np.int64)
        for words in _pieces(batches):
            for n in range(2, longest + 1):
                part = (words.keys(n)[0] >> np.uint64(64 - PARTITION_BITS)).astype(np.int64)
                mass[min(n - 2, 1)] += np.bincount(part, minlength=PARTITIONS)
            first, counts = _distinct([words.code, words.lang])
            none = pa.nulls(len(first), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [words.langs.take(pa.array(words.lang[first])), words.known.take(pa.array(words.code[first])), pa.array(counts), none, none],
                names=["lang", "word", "n", "kind", "part"],
            )
        kind, part = np.nonzero(mass)
        none = pa.nulls(len(part), pa.string())
        yield pa.RecordBatch.from_arrays(
            [none, none, pa.array(mass[kind, part]), pa.array((kind + 2).astype(np.int32)), pa.array(part.astype(np.int32))],
            names=["lang", "word", "n", "kind", "part"],
        )

    return lambda batches: _added_up(rows(batches), ["lang", "word", "kind", "part"])


def _summaries(shared, sizes, base, capacity):
    """Rows of summaries of the sequences of `sizes` words whose sequences of `base` words may be in the sieve."""

    def convert(batches):
        summary, sieve = Summary(capacity), Sieve(*shared.value)
        for words in _pieces(batches):
            for n in sizes:
                summary.add(words.sifted(n, sieve, base)[0])
            if len(summary.keys) > MAX_COUNTERS:
                yield summary.rows()
                summary.reset()
        yield summary.rows()

    return convert


def _candidates(rows, shared, sizes, base, mass, least):
    """Stored keys that may have `least` occurrences."""
    spark = rows.sparkSession
    capacity = CAPACITY * mass // least + 1
    convert = _summaries(shared, sizes, base, capacity)
    rows = materialize(rows.mapInArrow(convert, "part int, key bigint, n bigint, cut bigint"), "summaries")
    cuts = rows.filter("key is null").groupBy("part").agg(F.sum("cut").alias("cut")).collect()
    cut = dict(cuts)
    part_cut = spark.createDataFrame([(p, cut.get(p, 0)) for p in range(PARTITIONS)], "part int, cut bigint")
    merged = rows.filter("key is not null").groupBy("part", "key").agg(F.sum("n").alias("n"))
    able = merged.join(F.broadcast(part_cut), "part").filter(F.col("n") + F.col("cut") >= least)
    return materialize(able.select("key"), "candidates")


def _phrase_counts(shared, longest, ranges):
    """Rows `(range, lang, phrase, n)` of lists: the sequences of a task that may be in the sieve, counted as texts and dealt
    to ranges by their hash.

    A frequent sequence is in most tasks; as lists its counts travel as columns, a row for each task and range.
    """

    def rows(batches):
        sieve = Sieve(*shared.value)
        for words in _pieces(batches):
            for n in range(2, longest + 1):
                keys, places = words.keys(n)
                places = places[sieve.has(keys)]
                if not len(places):
                    continue
                first, counts = _distinct([*[words.code[places + k] for k in range(n)], words.lang[places]])
                at = places[first]
                parts = [words.known.take(pa.array(words.code[at + k])) for k in range(n)]
                phrase = pc.binary_join_element_wise(*parts, " ")
                yield pa.RecordBatch.from_arrays(
                    [words.langs.take(pa.array(words.lang[at])), phrase, pa.array(counts)], names=["lang", "phrase", "n"]
                )

    def convert(batches):
        for batch in _added_up(rows(batches), ["lang", "phrase"]):
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, batch["phrase"].to_pylist()), np.uint64, len(batch))
            of = (hashes % np.uint64(ranges)).astype(np.int32)
            order = np.argsort(of, kind="stable")
            filled, first = np.unique(of[order], return_index=True)
            offsets = np.append(first, len(of))
            lists = [arrow_list(batch[c].take(pa.array(order)), offsets) for c in ("lang", "phrase", "n")]
            yield pa.RecordBatch.from_arrays([pa.array(filled), *lists], names=["range", "lang", "phrase", "n"])

    return convert


def _frequent(least):
    """Of one range: the sequences with at least `least` occurrences in all tasks together."""

    def convert(table):
        flat = pa.table({c: table[c].combine_chunks().flatten() for c in ("lang", "phrase", "n")})
        added = flat.group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "f"])
        return added.filter(pc.greater_equal(added["f"], least))

    return convert


def phrase_counts(docs, least=100, longest=LONGEST, text_col="text", lang_col="lang"):
    """Stored tables `(phrases, words)`, each `(lang, phrase, f)`: all sequences of 2 to `longest` words with at least
    `least` occurrences, and all words.

    A-Z are lower-cased; texts are split at `.,;:!?` and line ends into pieces and those at blanks and tabs into words;
    occurrences may overlap. A null language counts as `und`, a null text as empty. Every row counts, repeated ones too;
    other columns are not looked at. Exact but for sequences of one slice of text being told apart by word codes only.
    """
    if longest < 2 or least < 1:
        raise ValueError("longest must be 2 at least, least 1 at least")
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNNAMED)).alias("lang"))
    read = materialize(
        rows.mapInArrow(_words_and_masses(longest), "lang string, word string, n bigint, kind int, part int")
        .groupBy("lang", "word", "kind", "part").agg(F.sum("n").alias("f")),
        "words",
    )
    words = read.filter("word is not null").select("lang", F.col("word").alias("phrase"), "f")
    mass = np.zeros((2, PARTITIONS), np.int64)
    for kind, part, n in read.filter("part is not null").select("kind", "part", "f").collect():
        mass[kind - 2, part] = n

    frequent = words.filter(F.col("f") >= least).select("lang", "phrase")
    keyed = frequent.mapInArrow(_word_keys, "key bigint")
    share = lambda sieve: spark.sparkContext.broadcast((sieve.bits, sieve.words))
    pairs = _candidates(rows, share(sieve_of(materialize(keyed, "frequent"))), [2], 1, mass[0], least)
    able = pairs
    if longest > 2:
        longer = _candidates(rows, share(sieve_of(pairs)), range(3, longest + 1), 2, mass[1], least)
        able = pairs.unionByName(longer)
    ranges = int(mass.sum()) // RANGE_MASS + 1
    counted = rows.mapInArrow(
        _phrase_counts(share(sieve_of(able)), longest, ranges), "range int, lang array<string>, phrase array<string>, n array<bigint>"
    )
    counted = counted.groupBy("range").applyInArrow(_frequent(least), "lang string, phrase string, f bigint")
    return materialize(counted, "phrases"), words


def _word_keys(batches):
    """Keys of single words, as `Pieces.keys(1)` has them."""
    for batch in batches:
        salts, hashes = (
            np.fromiter(map(xxhash.xxh3_64_intdigest, batch[c].to_pylist()), np.uint64, len(batch)) for c in ("lang", "phrase")
        )
        yield pa.RecordBatch.from_arrays([pa.array(signed(mix(mix(salts) * PRIME + hashes + np.uint64(1))))], names=["key"])


def collocations(docs, least=100, longest=LONGEST, top=2000, cover_percent=100, text_col="text", lang_col="lang"):
    """`(lang, rank, phrase, a, l, r, n, score)`: the first `top` phrases of each language.

    `a` counts the phrase, `n` all words of the language, `l` and `r` the two parts of the cut that scores lowest (of equal
    ones the first); the score is floor(1000 * a * n / (l * r)). A phrase is left out if a longer one that it lies in has at least
    `cover_percent` percent of its occurrences. Ranked by score, then `a`, both descending, then the phrase's bytes. Texts and
    nulls are taken as by `phrase_counts`; a table without frequent phrases gives no rows.
    """
    phrases, words = phrase_counts(docs, least, longest, text_col, lang_col)
    # Parts of a frequent phrase are frequent too.
    known = phrases.unionByName(words.filter(F.col("f") >= least))
    ws, size = F.split("phrase", " "), F.size(F.split("phrase", " "))
    join = lambda first, many: F.array_join(F.slice(ws, first, many), " ")
    cut = F.explode(F.transform(
        F.sequence(F.lit(1), size - 1), lambda k: F.struct(k.alias("k"), join(1, k).alias("left"), join(k + 1, size - k).alias("right"))
    ))
    cuts = materialize(phrases.select("lang", "phrase", F.col("f").alias("a"), cut.alias("cut")).select("lang", "phrase", "a", "cut.*"), "cuts")
    # A word such as an article is the first part of very many phrases.
    left = known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    halves = materialize(lookup_join(cuts, left, ["lang", "left"], "inner", spread=("phrase", "k")), "halves")
    scored = lookup_join(halves, right, ["lang", "right"], "inner", spread=("phrase", "k"))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    scored = scored.join(totals, "lang")
    wide = lambda name: F.col(name).cast("decimal(20,0)")
    scored = scored.withColumns({"_over": F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), "_under": wide("l") * wide("r")})
    scored = scored.withColumn("score", F.expr("_over div _under"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("least"))
    # Occurrences of a phrase do not fall from a longer sequence to one between, so it is enough to look one word further.
    longer = phrases.filter(size > 2)
    inner = F.explode(F.array_distinct(F.array(join(1, size - 1), join(2, size - 1))))
    covers = longer.select("lang", inner.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("cover"))
    best = best.join(covers, ["lang", "phrase"], "left")
    best = best.filter(F.col("cover").isNull() | (F.col("cover") * 100 < F.col("a") * cover_percent))
    found = best.select("lang", "phrase", "a", "least.l", "least.r", "n", "least.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    # First by shares of a language, so that no task gets more than so many rows of each share.
    found = found.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    found = found.withColumn("rank", rank("lang", "_salt")).filter(F.col("rank") <= top).drop("_salt")
    found = found.withColumn("rank", rank("lang")).filter(F.col("rank") <= top)
    return found.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


# ---- the same in DuckDB SQL ----


def collocations_sql(source, least=100, longest=LONGEST, top=2000):
    """CTEs ending in `ranked`: lang, rank, phrase, a, l, r, n, score."""
    sequences = "\nUNION ALL ".join(
        f"SELECT lang, {n} AS size, w || {' || '.join(f'{chr(39)} {chr(39)} || lead(w, {k}) OVER p' for k in range(1, n))} AS phrase "
        "FROM worded WINDOW p AS (PARTITION BY row, piece ORDER BY place)"
        for n in range(2, longest + 1)
    )
    return f"""pieced AS (
  SELECT row, lang, generate_subscripts(ps, 1) AS piece, unnest(ps) AS p FROM (
    SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS ps FROM {source})),
worded AS MATERIALIZED (
  SELECT row, lang, piece, generate_subscripts(ws, 1) AS place, unnest(ws) AS w
  FROM (SELECT *, regexp_extract_all(p, '[^\\x20\\x09]+') AS ws FROM pieced)),
totals AS (SELECT lang, count(*) AS n FROM worded GROUP BY lang),
singles AS (SELECT lang, w AS phrase, count(*) AS f FROM worded GROUP BY ALL),
phrases AS MATERIALIZED (
  SELECT lang, size, phrase, count(*) AS f FROM ({sequences})
  WHERE phrase IS NOT NULL GROUP BY ALL HAVING count(*) >= {least}),
known AS MATERIALIZED (SELECT lang, phrase, f FROM phrases UNION ALL SELECT * FROM singles),
cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp
  FROM (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS k FROM phrases)),
scored AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN known x ON x.lang = c.lang AND x.phrase = lp JOIN known y ON y.lang = c.lang AND y.phrase = rp
  JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
uncovered AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (
    SELECT 1 FROM phrases p WHERE p.lang = s.lang AND p.phrase <> s.phrase AND 100 * p.f >= 100 * s.a
      AND contains(' ' || p.phrase || ' ', ' ' || s.phrase || ' '))),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
  FROM uncovered QUALIFY rank <= {top})"""
