"""Join of near-equal texts by the Jaccard similarity of their word n-grams, down to the links' components.

1. A text is the sorted set of its n-grams' hashes. Texts of one set are one class and go on as that set's 64-bit key.
2. Sets are banded by size, and cut by hash into more parts than sets that link may differ in, plus some to spare. A pair
   that links so has more equal parts than there are to spare; each set therefore leaves out as many of its parts, those that
   most sets have, and the pair still meets in its rarest equal part. A passage that many texts share is left out by all of
   them. Sets that meet, directly or over others, are a family.
3. In a family every set is compared with the smallest key's. By the triangle inequality, sets that link to it need
   not be compared with each other, nor with sets twice as far away.
4. What is left is compared in size-banded tiles of bounded size. In 3 and 4 parity bitmaps come first: their
   differing bits bound the overlap from above; only pairs within the bound have their sorted arrays intersected.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from rulelens.llm.graph import components
from rulelens.llm.texts import Words, arrow_list, mix, signed, slices, whole_ids
from rulelens.plans.joins import MAX_BROADCAST_ROWS, lookup_join, semi_by_key
from rulelens.plans.storage import materialize

# Neighbouring bands differ by a third at least, so sets that link are in one band or in neighbouring ones from here on.
LEAST_PERCENT = 75
# Sets of a family compared at a time on either side of a tile, and elements they have together (one larger set is alone).
BLOCK, BLOCK_ELEMENTS = 1024, 1 << 22
# Last bits of a part's key: its tile.
TILE_BITS = 7
# Sets that have a part are counted up to here.
MANY = 1 << 16
# Set keys a task remembers, to give the parts of equal texts once.
REMEMBERED = 1 << 20
SETS_PER_TASK = 10_000
MAX_BITS = 1 << 16


def _edges_of_bands():
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, edges[-1] * 3 // 2))
    return np.array(edges)


BANDS = _edges_of_bands()


def _sets(words, n_texts, size):
    """Sorted distinct n-gram hashes of all texts: `(row, hash)`. A text of fewer words is one n-gram."""
    grams, places = words.grams(size)
    rows = [words.row[places]]
    hashes = [grams]
    for short in range(1, size):
        grams, places = words.grams(short)
        alone = words.counts[words.row[places]] == short
        rows.append(words.row[places[alone]])
        hashes.append(grams[alone])
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def _parts(percent, low, high):
    """How many parts a band's sets are cut into, and how many of them may be empty in a set before that is noted.

    Sets of `a` and `b` elements that link differ in at most (a + b) * (100 - percent) / (100 + percent).
    """
    differ = 2 * high * (100 - percent) // (100 + percent)
    spare = 2 + np.ceil((differ + 1) * np.minimum(0.5, 3 * np.exp(-low / (differ + 1)))).astype(np.int64)
    return differ + 1 + spare, spare


def _signatures(row, h, n, percent):
    """Parts of every set in its band, and in the next one if it can link to sets there: `(row, part, spared)`.

    A pair that links has more equal parts than `spare`. Empty parts are not given unless a set has more of them than
    that, so a set may leave out `spared` of its given parts, in an order all sets agree on: as many as are to spare, less
    its empty ones; none if those are given.
    """
    rows, parts_out, spared = [], [], []
    band = np.searchsorted(BANDS, n, side="right") - 1
    able = n * (100 - percent) >= percent
    for up in (0, 1):
        here = able & (n > 0) if up == 0 else able & (100 * n >= percent * BANDS[band + 1])
        tile = band + up
        parts, spare = _parts(percent, percent * BANDS[tile] // 100, BANDS[tile + 1] - 1)
        parts = np.where(here, parts, 0)
        base = np.concatenate([[0], np.cumsum(parts)])
        mine = here[row]
        r, x = row[mine], h[mine]
        # By the tile, not by `up`: sets of both bands that meet in a tile are cut alike.
        at = base[r] + (mix(x + tile[r].astype(np.uint64)) % parts[r].astype(np.uint64)).astype(np.int64)
        total = np.zeros(base[-1], np.uint64)
        np.add.at(total, at, mix(x ^ np.uint64(0x5BD1E995)))
        filled = np.bincount(at, minlength=base[-1]) > 0
        owner = np.repeat(np.arange(len(n)), parts)
        empty = parts - np.bincount(owner[filled], minlength=len(n))
        place = np.arange(base[-1]) - base[owner]
        keep = filled | (empty > spare)[owner]
        owner, number = owner[keep], tile[owner[keep]].astype(np.uint64)
        key = number << np.uint64(40) | place[keep].astype(np.uint64)
        rows.append(owner)
        parts_out.append(mix(total[keep] + mix(key)) << np.uint64(TILE_BITS) | number)
        spared.append(np.where(empty > spare, 0, spare - empty)[owner])
    return np.concatenate(rows), np.concatenate(parts_out), np.concatenate(spared)


def _sums(row, values, n):
    total = np.zeros(n, np.uint64)
    np.add.at(total, row, values)
    return total


def _set_keys(row, h, n):
    """64 bits that stand for each text's set."""
    return mix(_sums(row, mix(h), n))


def _profile(size):
    """Rows `(id, n, key)`: set size, and the set's key, null for an empty set."""

    def convert(batches):
        for batch in batches:
            for at, k in slices(batch, "text"):
                words = Words(batch["text"].slice(at, k), lower=True)
                row, h = _sets(words, k, size)
                n = np.bincount(row, minlength=k)
                key = pa.array(signed(_set_keys(row, h, k)), mask=n == 0)
                yield pa.RecordBatch.from_arrays([batch["id"].slice(at, k), pa.array(n), key], names=["id", "n", "key"])

    return convert


def _part_rows(size, percent):
    """Rows `(part, key, spared)`: the parts of every set. A task gives those of a set once as far as it remembers."""

    def convert(batches):
        seen = set()
        for batch in batches:
            for at, k in slices(batch, "text"):
                words = Words(batch["text"].slice(at, k), lower=True)
                row, h = _sets(words, k, size)
                keys = signed(_set_keys(row, h, k))
                new = np.array([key not in seen and not seen.add(key) for key in keys.tolist()], bool)
                if len(seen) > REMEMBERED:
                    seen.clear()
                mine = new[row]
                row, h = row[mine], h[mine]
                row, parts, spared = _signatures(row, h, np.bincount(row, minlength=k), percent)
                columns = [signed(parts), keys[row], spared.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "key", "spared"])

    return convert


def _common(batches):
    """From rows sorted by part and key: those of parts several sets have, once each, with how many (`sets`, up to MANY).

    The rows of a part are held until the next part comes, or until there are MANY of them.
    """
    names = ("part", "key", "spared")
    held, long = [np.zeros(0, np.int64)] * 3, False  # if long, the part's last row, which was given already
    for batch in batches:
        part, key, spared = (np.concatenate([h, batch[c].to_numpy()]) for h, c in zip(held, names))
        if not len(part):
            continue
        new = np.ones(len(part), bool)
        new[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1])
        part, key, spared = part[new], key[new], spared[new]
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sizes = np.diff(np.append(starts, len(part)))
        sets = np.minimum(sizes, MANY)
        if long:
            sets[0] = MANY
        each = np.repeat(sets, sizes)
        give = each > 1
        give[0] &= not long
        long = bool(sets[-1] == MANY)
        begin = len(part) - 1 if long else starts[-1]
        if not long:
            give[begin:] = False
        held = [part[begin:], key[begin:], spared[begin:]]
        columns = [c[give] for c in (part, key, spared.astype(np.int32), each.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*names, "sets"])
    if not long and len(held[0]) > 1:
        columns = [held[0], held[1], held[2].astype(np.int32), np.full(len(held[0]), len(held[0]), np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*names, "sets"])


def _leaders(batches):
    """From rows sorted by part and key: every key with the smallest one that has the part."""
    last = None
    for batch in batches:
        part, keys = batch["part"].to_numpy(), batch["key"].to_numpy()
        if not len(keys):
            continue
        begins = np.ones(len(keys), bool)
        begins[1:] = part[1:] != part[:-1]
        if last is not None and part[0] == last[0]:
            begins[0] = False
        first = np.concatenate([[last[1] if last else 0], keys[begins]])[np.cumsum(begins)]
        last = (part[-1], first[-1])
        joined = first != keys
        yield pa.RecordBatch.from_arrays([pa.array(keys[joined]), pa.array(first[joined])], names=["u", "v"])


def _meetings(texts, size, percent):
    """`(u, v)`: keys of sets that share a part neither leaves out, each with the smallest key that has it."""
    parts = texts.mapInArrow(_part_rows(size, percent), "part bigint, key bigint, spared int")
    common = parts.repartition("part").sortWithinPartitions("part", "key")
    common = common.mapInArrow(_common, "part bigint, key bigint, spared int, sets int")
    # The parts of one set in one tile, those that most sets have first; a part that no other set has is behind them all.
    tile = F.col("part").bitwiseAND((1 << TILE_BITS) - 1)
    place = F.row_number().over(Window.partitionBy("key", tile).orderBy(F.desc("sets"), F.desc("part")))
    left = common.withColumn("_place", place).filter(F.col("_place") > F.col("spared")).select("part", "key")
    return left.repartition("part").sortWithinPartitions("part", "key").mapInArrow(_leaders, "u bigint, v bigint")


def _member_sets(size):
    """Rows `(family, key, n, set)` of the texts whose set is the one asked for."""

    def convert(batches):
        for batch in batches:
            for at, k in slices(batch, "text"):
                words = Words(batch["text"].slice(at, k), lower=True)
                row, h = _sets(words, k, size)
                offsets = np.searchsorted(row, np.arange(k + 1))
                family, key = (batch[c].slice(at, k) for c in ("family", "key"))
                mine = pa.array(signed(_set_keys(row, h, k)) == key.to_numpy())
                out = [family, key, pa.array(np.diff(offsets)), arrow_list(signed(h), offsets)]
                yield pa.RecordBatch.from_arrays([c.filter(mine) for c in out], names=["family", "key", "n", "set"])

    return convert


def _bitmaps(sets, bits):
    """Parity bitmaps: every element flips one of `bits` bits."""
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for i, one in enumerate(sets):
        bit = (mix(one.view(np.uint64)) % np.uint64(bits)).astype(np.int64)
        odd = np.flatnonzero(np.bincount(bit, minlength=bits) & 1)
        np.bitwise_or.at(out[i], odd >> 6, np.uint64(1) << (odd & 63).astype(np.uint64))
    return out


def _width(n):
    return min(MAX_BITS, 1 << max(6, (4 * int(n)).bit_length()))


def _needed(a, b, percent):
    """Smallest overlap with which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


def _overlap(a, b):
    return len(np.intersect1d(a, b, assume_unique=True))


def _list_arrays(column):
    """The lists of a column as arrays."""
    values = column.flatten().to_numpy()
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(values, ends[:-1]) if len(column) else []


def _against_leader(percent):
    """Distance of each member from its family's leader, or null if it is too far to link to what the leader links to."""

    def convert(batches):
        for batch in batches:
            distance = []
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                for a, b in zip(_list_arrays(part["set"]), _list_arrays(part["leader_set"])):
                    distance.append(_distance(a, b, percent))
            yield pa.RecordBatch.from_arrays(
                [batch["family"], batch["key"], pa.array(distance, pa.float64())], names=["family", "key", "distance"]
            )

    return convert


def _distance(a, b, percent):
    far = 2 * (100 - percent)
    total = len(a) + len(b)
    least = -(-(100 - far) * total // (200 - far)) if far < 100 else 0  # overlap at the far distance
    if min(len(a), len(b)) < least:
        return None
    maps = _bitmaps([a, b], _width(max(len(a), len(b))))
    differ = int(np.bitwise_count(maps[0] ^ maps[1]).sum())
    if (total - differ) // 2 < least:
        return None
    both = _overlap(a, b)
    return 1 - both / (total - both)


def _tile(percent):
    """Links that tie the sets of a tile together; pairs already tied are passed over."""

    def links(table):
        table = table.combine_chunks()
        sets = _list_arrays(table["set"].chunk(0) if table["set"].num_chunks else table["set"])
        order = np.argsort([len(s) for s in sets], kind="stable")
        sets = [sets[i] for i in order]
        n = np.array([len(s) for s in sets])
        ids, block = (table[c].to_numpy()[order] for c in ("key", "block"))
        tied = table["tied"].to_numpy(zero_copy_only=False)[order]
        across = table["i"][0].as_py() != table["j"][0].as_py()
        group = np.where(tied, -1, np.arange(len(ids)))
        maps = _bitmaps(sets, _width(n.max()))
        out = []
        for x in range(len(ids)):
            end = np.searchsorted(n, n[x] * 100 // percent, side="right")
            y = np.arange(x + 1, end)
            y = y[(group[y] != group[x]) & ((block[y] != block[x]) | (not across))]
            differ = np.bitwise_count(maps[y] ^ maps[x]).sum(axis=1, dtype=np.int64)
            for k in y[(n[y] + n[x] - differ) // 2 >= _needed(n[y], n[x], percent)]:
                if group[k] != group[x] and _overlap(sets[x], sets[k]) >= _needed(n[k], n[x], percent):
                    group[group == group[k]] = group[x]
                    out.append((ids[x], ids[k]))
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})

    return links


def _tiles(rows, percent):
    """Rows of a family dealt to size-banded tiles, and large tiles to pairs of blocks: each pair meets in a tile.

    The rows are without their sets, which are large and join them once, when all is dealt.
    """
    size = F.col("n")
    edges = F.array(*[F.lit(int(e)) for e in BANDS])
    band = F.size(F.filter(edges, lambda e: e <= size))
    upper = F.get(edges, band)
    bands = F.when(F.lit(100) * size >= F.lit(percent) * upper, F.array(band, band + 1)).otherwise(F.array(band))
    rows = rows.withColumn("band", F.explode(bands))
    many = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_ELEMENTS)).cast("int")
    blocks = rows.groupBy("family", "band").agg(many.alias("blocks"))
    rows = rows.join(blocks, ["family", "band"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(
        "family", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "tied", "block"
    )


def _links(sets, percent):
    """`(u, v)`: keys of sets of one family that link, as far as components need them."""
    leaders = sets.filter("key = family").select("family", F.col("set").alias("leader_set"))
    others = sets.filter("key != family")
    compared = lookup_join(others, leaders, ["family"], "inner", spread=("key",), rows_per_task=SETS_PER_TASK)
    compared = compared.select("family", "key", "set", "leader_set")
    compared = compared.mapInArrow(_against_leader(percent), "family bigint, key bigint, distance double")
    compared = materialize(compared, "compared")
    limit = F.lit((100 - percent) / 100 + 1e-9)
    linked = compared.filter(F.col("distance") <= limit)
    apart = compared.filter(F.col("distance").isNull() | (F.col("distance") > limit))
    # Linked sets matter only where a set that did not link is near enough to link to one of them.
    reach = apart.groupBy("family").agg((F.min("distance") - limit - 1e-9).alias("reach"))
    edge = linked.join(reach, "family").filter("distance >= reach")
    rest = apart.select("family", "key", F.lit(False).alias("tied")).unionByName(edge.select("family", "key", F.lit(True).alias("tied")))
    slim = others.select("family", "key", "n").join(rest, ["family", "key"])
    tiles = _tiles(slim, percent).join(others.select("family", "key", "set"), ["family", "key"])
    more = tiles.groupBy("family", "band", "i", "j").applyInArrow(_tile(percent), "u bigint, v bigint")
    return linked.select(F.col("key").alias("u"), F.col("family").alias("v")).unionByName(more)


def jaccard_components(docs, size=3, percent=90, id_col="doc_id", text_col="text"):
    """`(id, n_shingles, component_id)`: distinct word n-grams of every text and the smallest id reachable over links.

    A-Z are lower-cased; words are runs of anything but ASCII white space; a text with fewer than `size` words is one
    n-gram. Two ids link when the overlap of their sets is at least `percent` percent of the union. A null or blank text
    has an empty set and links with nothing. An id is one document, whatever its rows; rows map one to one; rows
    with a null id link with nothing and have a null component. Other columns are not looked at. Ids are whole
    numbers (other types are an error), n-grams and whole sets are compared by 64-bit hashes; `percent` is from 75 to 100.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be from {LEAST_PERCENT} to 100")
    whole_ids(docs, id_col)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    profiles = materialize(texts.mapInArrow(_profile(size), "id bigint, n bigint, key bigint"), "profiles")
    real = profiles.filter("id is not null and n > 0")
    # Stored, so that the join with a class of very many ids below can be split.
    classes = materialize(real.groupBy("key").agg(F.min("id").alias("id")), "classes")
    members = components(_meetings(texts.filter("id is not null"), size, percent))
    members = members.select(F.col("component").alias("family"), F.col("u").alias("key"))
    members = members.unionByName(members.select("family", F.col("family").alias("key")).distinct())
    members = materialize(members.join(classes, "key"), "members")
    listed = members.count() <= MAX_BROADCAST_ROWS
    own = texts.join(F.broadcast(members) if listed else members, "id").select("family", "key", "text")
    sets = materialize(own.mapInArrow(_member_sets(size), "family bigint, key bigint, n bigint, set array<bigint>"), "sets")
    if sets.count() > members.count():  # repeated rows of an id: each of their texts once
        sets = materialize(sets.dropDuplicates(["key"]), "sets")

    links = _links(sets, percent)
    several = real.groupBy("id").agg(F.min("key").alias("v"), F.max("key").alias("w")).filter("v != w")
    links = links.unionByName(real.join(several, "id").filter("key != v").select(F.col("key").alias("u"), "v"))
    found = components(links).select(F.col("u").alias("key"), "component")
    groups = materialize(classes.join(found, "key", "left").select("key", "id", F.coalesce("component", "key").alias("group")), "groups")
    least = groups.groupBy("group").agg(F.min("id").alias("component_id"))
    named = lookup_join(groups.select("key", "group"), least, ["group"], "inner", spread=("key",)).select("key", "component_id")
    out = lookup_join(profiles, named, ["key"], spread=("id",))
    # An id may have a blank text beside others.
    blank = profiles.filter("id is not null and n = 0").select("id").distinct()
    if not blank.join(real, "id", "left_semi").isEmpty():
        other = out.filter("id is not null and n > 0").groupBy("id").agg(F.min("component_id").alias("_other"))
        out = out.join(other, "id", "left").withColumn("component_id", F.coalesce("component_id", "_other"))
    own_id = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own_id.alias("component_id"))


def one_per_component(docs, size=5, percent=80, id_col="doc_id", text_col="text"):
    """The rows of `docs`, with their own columns, less those whose id is not the smallest of its component."""
    found = jaccard_components(docs, size, percent, id_col, text_col)
    extra = materialize(found.filter(F.col("component_id") != F.col(id_col)).select(id_col).distinct(), "extra")
    return semi_by_key(docs, extra, [id_col], "left_anti")


# ---- the same in DuckDB SQL ----


def jaccard_sql(source, size=3, percent=90):
    """CTEs ending in `joined`: doc_id, n_shingles, component_id."""
    return f"""worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM {source}),
grams AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + {size - 1}), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {size - 2}, 2))) AS i FROM worded WHERE len(ws) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a AS u, b AS v FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id
    GROUP BY 1, 2) JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
  WHERE 100 * common >= {percent} * (s.n + t.n - common)),
reached(u, v) AS (
  SELECT doc_id, doc_id FROM worded UNION SELECT r.u, l.v FROM reached r JOIN links l ON l.u = r.v),
least AS (SELECT u AS doc_id, min(v) AS component_id FROM reached GROUP BY u),
joined AS (
  SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
  FROM worded LEFT JOIN sizes USING (doc_id) JOIN least USING (doc_id))"""
