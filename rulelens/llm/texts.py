"""Words of texts as arrays, for the operators that work on Arrow batches inside tasks."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

# Texts worked on at a time, in bytes; one longer text is taken alone.
SLICE_BYTES = 4 << 20
PRIME = np.uint64(0x9E3779B97F4A7C15)


def slices(batch, name, size=SLICE_BYTES):
    """`(first row, rows)` that cut a batch into slices of bounded size, so that nothing derived from them gets large."""
    sizes = pc.fill_null(pc.binary_length(batch[name]), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for row, n in enumerate(sizes.tolist()):
        if row > at and total + n > size:
            yield at, row - at
            at, total = row, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes) - at


def text_slices(batch, name):
    for at, rows in slices(batch, name):
        yield at, batch[name].slice(at, rows).to_pylist()


def mix(h):
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """All words of a column of texts, split at ASCII white space.

    `row`: text of each word; `first`: where each text's words begin, one more than texts; `hash`: 64 bits a word.
    """

    def __init__(self, texts, lower=False):
        texts = pc.fill_null(texts, "")
        if lower:
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten()
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        real = pc.not_equal(flat, "")
        self.flat = flat.filter(real)
        self.row = row[real.to_numpy(zero_copy_only=False)]
        self.first = np.searchsorted(self.row, np.arange(len(lists) + 1))
        coded = self.flat.dictionary_encode()
        known = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        self.code, self.known = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        self.hash = known[self.code] if len(known) else np.zeros(0, np.uint64)

    @property
    def counts(self):
        return np.diff(self.first)

    def grams(self, n):
        """64-bit hashes of n words in a row, one for each word that n words of its text start at, and those words' places."""
        if len(self.hash) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        size = len(self.hash) - n + 1
        total = np.zeros(size, np.uint64)
        for k in range(n):
            total = total * PRIME + self.hash[k : k + size]
        places = np.flatnonzero(self.row[:size] == self.row[n - 1 :])
        return mix(total[places] + np.uint64(n)), places


def arrow_list(values, offsets):
    """A list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def signed(h):
    """Unsigned hashes as Spark's long."""
    return h.view(np.int64)


def whole_ids(docs, id_col):
    """Refuse ids that are no whole numbers, since casting them would lose or merge some."""
    kind = dict(docs.dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be a whole number, not {kind}")
