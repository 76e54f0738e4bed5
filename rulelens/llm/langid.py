"""Language ID by unigrams of public pieces, summed over all segmentations.

A language is a distribution over the pieces of a fixed public vocabulary. A word (a run of letters, whole, however long)
has the sum of the probabilities of all ways to write it as pieces (forward algorithm); the distributions are
fitted by expectation-maximisation with the same sums.
"""

import re
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import functions as F

from rulelens.llm.texts import slices
from rulelens.plans.storage import materialize

# Documents of one language that the model is fitted on, picked by a hash of the id (about so many, all if fewer).
TRAIN_DOCS = 1_000
ROUNDS = 2
SMOOTHING = 0.05
# Up to so many characters sums stay within the range of a double; longer words are summed as logarithms.
PLAIN_CHARS = 28
# Characters of words summed together.
GROUP_CHARS = 1 << 16
MAX_LANGUAGES = 1_000
# Words remembered by a worker, and bytes of text worked on at a time.
MAX_WORDS = 300_000
SLICE_BYTES = 12 << 20
START = "▁"
LETTERS = "\\p{L}+"
UNDETERMINED = "und"
_RUNS = regex.compile(LETTERS)
_WORDS = re.compile(r"[^\W\d_]+").findall


def read_pieces(path):
    """Pieces of a public sentence-piece model, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [model.id_to_piece(i) for i in plain]


class Lattice:
    """All places where pieces lie in strings, found by walking a trie of the pieces from every place at once.

    A character that is no piece counts as the unknown piece.
    """

    def __init__(self, pieces):
        self.ids = {piece: i for i, piece in enumerate(pieces)}
        self.unknown, self.longest = len(self.ids), max(map(len, pieces))
        nodes, ends = {"": 0}, [-1]
        for piece in pieces:
            for k in range(1, len(piece) + 1):
                if piece[:k] not in nodes:
                    nodes[piece[:k]] = len(nodes)
                    ends.append(-1)
            ends[nodes[piece]] = self.ids[piece]
        steps = sorted((nodes[p[:-1]] << 21 | ord(p[-1]), node) for p, node in nodes.items() if p)
        self.steps, self.next = (np.array(x, np.int64) for x in zip(*steps)) if steps else (np.zeros(0, np.int64),) * 2
        self.ends = np.array(ends)
        self.first = np.full(0x110000, -1, np.int64)
        roots = self.steps < 1 << 21
        self.first[self.steps[roots]] = self.next[roots]

    def arcs(self, texts):
        """Arrays (start, end, piece) over all texts set end to end, one place more than characters for each; sorted by end."""
        sizes = np.array([len(text) for text in texts])
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(texts)), sizes)
        last = (begins + sizes)[owner]
        at = np.arange(len(codes))
        node, depth = self.first[codes], 1
        single = np.where(node >= 0, self.ends[node], -1)
        found = [(at, at + 1, np.where(single >= 0, single, self.unknown))]
        alive = node >= 0
        at, node = at[alive], node[alive]
        while True:
            inside = at + depth < last[at]
            at, node = at[inside], node[inside]
            if not len(at) or not len(self.steps):
                break
            key = node << 21 | codes[at + depth]
            place = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            alive = self.steps[place] == key
            at, node = at[alive], self.next[place[alive]]
            depth += 1
            whole = self.ends[node] >= 0
            found.append((at[whole], at[whole] + depth, self.ends[node[whole]]))
        start, end, piece = (np.concatenate(x) for x in zip(*found))
        own = owner[start]
        start, end = start + own, end + own  # every text has a place more
        order = np.argsort(end, kind="stable")
        return start[order], end[order], piece[order]


def _places(sizes):
    """First and last place of each text, and the depth of every place in its text."""
    many = sizes + 1
    first = np.cumsum(many) - many
    return first, first + sizes, np.arange(many.sum()) - np.repeat(first, many)


def _sum_by(groups, values, logs):
    """`(group, summed rows)` of rows whose groups stand together."""
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    if not logs:
        return groups[first], np.add.reduceat(values, first)
    most = np.maximum.reduceat(values, first)
    share = np.exp(values - np.repeat(most, np.diff(np.append(first, len(groups))), axis=0))
    return groups[first], most + np.log(np.add.reduceat(share, first))


def _sums(arcs, sizes, prob, logs, backward=False):
    """Forward sums (or backward ones) at every place of all texts, for each column of `prob` (both logarithms if `logs`)."""
    start, end, piece = arcs
    first, last, depth = _places(sizes)
    out = np.full((len(depth), prob.shape[1]), -np.inf if logs else 0.0)
    out[last if backward else first] = 0.0 if logs else 1.0
    source, target = (end, start) if backward else (start, end)
    order = np.lexsort((target, depth[target]))
    source, target, piece = source[order], target[order], piece[order]
    cuts = np.flatnonzero(np.diff(depth[target])) + 1
    rounds = list(zip([0, *cuts], [*cuts, len(target)])) if len(target) else []
    for a, b in reversed(rounds) if backward else rounds:
        step = out[source[a:b]] + prob[piece[a:b]] if logs else out[source[a:b]] * prob[piece[a:b]]
        places, total = _sum_by(target[a:b], step, logs)
        out[places] = total
    return out


def _groups(words):
    """Places of words in groups of bounded size, short and long ones apart: `(places, logs)`."""
    sizes = np.array([len(w) + 1 for w in words])
    for logs, mine in ((False, np.flatnonzero(sizes <= PLAIN_CHARS)), (True, np.flatnonzero(sizes > PLAIN_CHARS))):
        mine = mine[np.argsort(sizes[mine], kind="stable")]
        group = np.cumsum(sizes[mine]) // GROUP_CHARS
        for part in np.split(mine, np.flatnonzero(np.diff(group)) + 1):
            if len(part):
                yield part, logs


def _log_probs(lattice, words, prob):
    """Log probability of each word in each language."""
    out, log_prob = np.empty((len(words), prob.shape[1])), np.log(prob)
    for part, logs in _groups(words):
        texts = [START + words[i] for i in part]
        sizes = np.array([len(t) for t in texts])
        sums = _sums(lattice.arcs(texts), sizes, log_prob if logs else prob, logs)[_places(sizes)[1]]
        out[part] = sums if logs else np.log(sums)
    return out


def _expected(pieces, prob):
    """Expected piece counts of `(lang, word, n)` rows: `(lang, piece, n)`; `prob` has a column per language."""

    def convert(batches):
        lattice, log_prob = Lattice(pieces), np.log(prob)
        total = np.zeros(prob.shape)
        for batch in batches:
            langs, words, counts = batch["lang"].to_numpy(), batch["word"].to_pylist(), batch["n"].to_numpy()
            for k in np.unique(langs):
                mine = np.flatnonzero(langs == k)
                own = [words[i] for i in mine]
                for part, _ in _groups(own):
                    texts = [START + own[i] for i in part]
                    sizes = np.array([len(t) for t in texts])
                    start, end, piece = arcs = lattice.arcs(texts)
                    column = log_prob[:, k : k + 1]
                    forward, backward = (_sums(arcs, sizes, column, True, back)[:, 0] for back in (False, True))
                    word = np.repeat(np.arange(len(texts)), sizes + 1)[start]
                    through = np.exp(forward[start] + column[piece, 0] + backward[end] - forward[_places(sizes)[1]][word])
                    np.add.at(total[:, k], piece, through * counts[mine[part]][word])
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[piece, lang])],
            names=["lang", "piece", "n"],
        )

    return convert


def fit(docs, pieces, id_col="doc_id", text_col="text", lang_col="lang", train_docs=TRAIN_DOCS):
    """`(languages, prob)` fitted on about `train_docs` documents of each language.

    Rows without text or language are passed over, as are texts without letters; repeated rows count again; other columns are
    not looked at. Without any language `prob` has no column. Only counts by language and piece reach the driver.
    """
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("name"))
    counts = rows.groupBy("name").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted(r["name"] for r in counts)
    if not names:
        return [], np.zeros((len(pieces) + 1, 0))
    many = {r["name"]: r["count"] for r in counts}
    table = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.struct(F.lit(i).alias("lang"), F.lit(many[n]).alias("many")))])
    rows = rows.withColumn("_of", table[F.col("name")])
    low = F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), 0)
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("double") * F.col("_of.many") < float(train_docs) * (1 << 30)
    words = rows.filter(share).select(F.col("_of.lang").alias("lang"), F.explode(low).alias("word"))
    words = materialize(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "words")
    prob = np.full((len(pieces) + 1, len(names)), 1 / (len(pieces) + 1))
    for _ in range(ROUNDS):
        found = words.mapInArrow(_expected(pieces, prob), "lang int, piece int, n double")
        total = np.full(prob.shape, SMOOTHING)
        found = found.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        total[found["piece"].to_numpy(), found["lang"].to_numpy()] += found["n"].to_numpy()
        prob = total / total.sum(axis=0)
    return names, prob


class Scorer:
    """Scores texts; remembers the words seen lately."""

    def __init__(self, pieces, prob):
        self.lattice, self.prob = Lattice(pieces), prob
        self.known, self.logs, self.used = {}, np.zeros((MAX_WORDS, prob.shape[1])), 0

    def _rows(self, words):
        """Log probabilities of distinct words."""
        at = np.fromiter(map(self.known.get, words, [-1] * len(words)), np.int64, len(words))
        out = self.logs[at]
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [words[i] for i in new]
            out[new] = logs = _log_probs(self.lattice, fresh, self.prob)
            if self.used + len(new) > MAX_WORDS:
                self.known, self.used = {}, 0
            kept = min(len(new), MAX_WORDS)
            self.logs[self.used : self.used + kept] = logs[:kept]
            self.known.update(zip(fresh[:kept], range(self.used, self.used + kept)))
            self.used += kept
        return out

    def score(self, texts):
        """Sums of log probabilities by text and language, and how many words each text has."""
        low = pc.utf8_lower(pc.fill_null(texts, ""))
        # Runs of word characters; of those that are not all letters, the runs of letters.
        found = [_WORDS(text) for text in low.to_pylist()]
        counts = np.array([len(f) for f in found])
        total, letters = np.zeros((len(texts), self.prob.shape[1])), np.zeros(len(texts), np.int64)
        if counts.sum():
            coded = pa.array(chain.from_iterable(found), pa.string(), size=int(counts.sum())).dictionary_encode()
            del found
            distinct, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            mixed = [i for i, word in enumerate(distinct) if not word.isalpha()]
            runs = [_RUNS.findall(distinct[i]) for i in mixed]
            for i in mixed:
                distinct[i] = None
            plain = [i for i, word in enumerate(distinct) if word is not None]
            rows, many = np.zeros((len(distinct), total.shape[1])), np.ones(len(distinct), np.int64)
            rows[plain] = self._rows([distinct[i] for i in plain])
            many[mixed] = [len(own) for own in runs]
            flat = list(dict.fromkeys(chain.from_iterable(runs)))
            logs = dict(zip(flat, self._rows(flat))) if flat else {}
            for i, own in zip(mixed, runs):
                rows[i] = sum((logs[run] for run in own), np.zeros(total.shape[1]))
            some = np.flatnonzero(counts)
            first = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
            total[some], letters[some] = np.add.reduceat(rows[code], first), np.add.reduceat(many[code], first)
        return total, letters


_SCORERS = {}


def _scorer(key, pieces, prob):
    """The scorer of a worker process, kept from task to task of one model."""
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(pieces, prob)
    return _SCORERS[key]


def predict(docs, pieces, languages, prob, id_col="doc_id", text_col="text"):
    """`(id, lang_pred, score)`: the language under which a text is likeliest, and its posterior at even odds.

    A text that is null or has no letters is `und` with score 0, as is every text if no language was learned. Equal
    languages: the first by name. Rows map one to one, repeated ones and null ids included; other columns are not
    looked at. The model is bounded by the vocabulary times the languages.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast((uuid4().hex, pieces, languages, prob))

    def convert(batches):
        key, own_pieces, names, own_prob = model.value
        scorer = _scorer(key, own_pieces, own_prob) if names else None
        named = np.array([*names, UNDETERMINED], object)
        for batch in batches:
            for at, n in slices(batch, "text", SLICE_BYTES):
                best, share = np.full(n, len(names)), np.zeros(n)
                if scorer:
                    total, counts = scorer.score(batch["text"].slice(at, n))
                    likely = np.exp(total - total.max(axis=1, keepdims=True))
                    best = np.where(counts > 0, total.argmax(axis=1), len(names))
                    share = np.where(counts > 0, likely.max(axis=1) / likely.sum(axis=1), 0.0)
                columns = [batch["id"].slice(at, n), pa.array(named[best].tolist(), pa.string()), pa.array(share)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "lang_pred", "score"])

    kind = rows.dtypes[0][1]
    return rows.mapInArrow(convert, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
