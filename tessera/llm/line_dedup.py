"""Fuzzy line deduplication: MinHash bands of byte n-grams, edit similarity, one occurrence for each connected group."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, materialize, text_of
from .components import connected_components

SIMILARITY = 0.8
#: Shorter lines, in bytes, are compared for equality only.
FUZZY_BYTES = 9
#: Minima of a line's gram hashes that make a band; lines that agree in a band meet.
ROWS = 3
#: (least and most bytes of a line, bytes of a gram, minima, bands): the shorter a line, the more its grams suffer from
#: an edit. Ranges overlap so that near copies of different lengths meet.
GRAMS = [(FUZZY_BYTES, 60, 5, 30, 20), (48, math.inf, 8, 24, 16)]
_FACTORS = np.random.default_rng(5).integers(0, 1 << 31, max(g[3] for g in GRAMS)).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes whose grams are hashed at once.
_BLOCK = 1 << 15
#: Keys that a task deals out at once, and the parts that they fall to, for each partition of a shuffle.
HELD, PARTS = 1 << 20, 8
#: Pairs that a task compares at once.
PAIRS = 1 << 15
#: Pairs of a key's lines that one task compares, about; keys with more are dealt over several.
SPLIT = 1 << 18
#: Pairs whose edit distances are found side by side, the characters of the longest such line, and the words of 64 bits
#: that their tables take at most: some 16 MB with the halves they are put together from.
BATCH, WIDE, TABLE = 2048, 2048, 1 << 19
#: Fewer pairs than this, and one for each so many characters of the longest, are compared one by one.
FEW, FEW_CHARS = 24, 10
#: How much longer the longest line of such a batch may be than the shortest: few batches take less time than narrow ones.
SPREAD = 1.4
#: Characters of a line from which on counts of its trigrams hardly rule out a pair, and from which on likely pairs are aligned
#: by words first.
COUNTED, ALIGNED = 200, 400
#: Words of the filter that spots candidate lines: 2 MB, whatever the corpus.
FILTER = 1 << 18
#: ASCII white space, punctuation and control characters, but the newline, become spaces.
_PLAIN = bytes(c if c >= 128 or c == 10 or chr(c).isalnum() else 32 for c in range(256))


def normal_lines(text: str) -> list[bytes]:
    """The normalised lines: in lower case, with single spaces for runs of white space and ASCII punctuation; UTF-8."""
    plain = text.lower().encode().translate(_PLAIN)
    while b"  " in plain:
        plain = plain.replace(b"  ", b" ")
    return [line.strip(b" ") for line in plain.split(b"\n")]


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, nh, line) of every line that holds more than white space and ASCII punctuation.

    th: hash of the whole text; pos: position of the line, from 0; line: normalised; nh: its hash.
    """
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pos, nh, lines = [], [], [], []
            for k, text in enumerate(batch.column("text")):
                for p, line in enumerate(normal_lines(text.as_py() or "")):
                    if line:
                        row.append(k), pos.append(p), nh.append(xxhash.xxh64_intdigest(line)), lines.append(line)
            index = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(index), batch.column("th").take(index), pa.array(pos, pa.int32()),
                    pa.array(np.array(nh, np.uint64).view(np.int64)), pa.array(lines, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "th", "pos", "nh", "line"],
            )

    read = docs.select("doc_id", "text", F.xxhash64(text_of()).alias("th"))
    return read.mapInArrow(run, f"doc_id {kind.simpleString()}, th long, pos int, nh long, line string")


def _windows(c: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each window of ``gram`` bytes, put together from those of windows of powers of two."""
    power, width, base, out, have = c.astype(np.uint64) + np.uint64(1), 1, int(_MIX), None, 0
    while True:
        if gram & width:
            out = power if out is None else out[: len(out) - width] * np.uint64(base) + power[have : have + len(out) - width]
            have += width
        if have == gram:
            return out
        power = power[:-width] * np.uint64(base) + power[width:]
        base, width = base * base % (1 << 64), 2 * width


def band_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gram: int, minima: int, bands: int) -> np.ndarray:
    """A row of keys for each line data[start:end]: each mixes ``ROWS`` minima over the line's grams, under as many hashes.

    Two lines agree in a key with the Jaccard similarity of their grams to the power of ``ROWS``. Lines follow each
    other in ``data`` and have ``gram`` bytes or more.
    """
    least = np.empty((minima, len(starts)), np.uint32)
    at = 0
    while at < len(starts):
        begin = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, begin + _BLOCK, "right")))
        h = _windows(data[begin : ends[to - 1]], gram)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h = np.append((h >> np.uint64(32)).astype(np.uint32), np.uint32(0))
        spans = np.empty(2 * (to - at), np.int64)
        spans[::2] = starts[at:to] - begin
        spans[1::2] = ends[at:to] - begin - gram + 1
        for k in range(minima):
            least[k, at:to] = np.minimum.reduceat(h * _FACTORS[k], spans)[::2]
        at = to
    out = np.empty((len(starts), bands), np.uint64)
    straight = minima // ROWS
    for band in range(bands):
        key = np.full(len(starts), gram * 64 + band, np.uint64)
        for k in range(ROWS):
            # past the last straight band they step over the minima, so that two bands share one at most
            of = ROWS * band + k if band < straight else band - straight + k * straight
            key = (key ^ least[of]) * _MIX
            key ^= key >> np.uint64(29)
        out[:, band] = key
    return out


def bands_of(lines: DataFrame) -> DataFrame:
    """(part, bands) of the lines of ``FUZZY_BYTES`` bytes or more, once for each task: near copies are likely to share a
    key. bands: the keys that fall to a part, then their lines' hashes, some of a task's at once."""
    parts = PARTS * int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(got: list) -> pa.RecordBatch:
        key, nh = (np.concatenate(x) for x in zip(*got))
        part = (key % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part, both = part[order], (key.view(np.int64)[order], nh[order])
        starts, _ = _runs(part)
        bands = [b"".join(x[i:j].tobytes() for x in both) for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(part)])]
        return pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array(bands, pa.binary())], names=["part", "bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, got, n = np.zeros(0, np.int64), [], 0
        for batch in batches:
            nh, first = np.unique(batch.column("nh").to_numpy(), return_index=True)
            first = np.sort(first[~np.isin(nh, seen, assume_unique=True)])
            seen = np.union1d(seen, nh)
            line = batch.column("line").cast(pa.large_binary()).take(pa.array(first))
            nh = batch.column("nh").to_numpy()[first]
            size = pc.binary_length(line).to_numpy()
            for least, most, gram, minima, bands in GRAMS:
                some = np.flatnonzero((size >= least) & (size <= most))
                if len(some):
                    own = line.take(pa.array(some))
                    offsets = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
                    keys = band_keys(np.frombuffer(own.buffers()[2], np.uint8), offsets[:-1], offsets[1:], gram, minima, bands)
                    got.append((keys.ravel(), np.repeat(nh[some], bands)))
                    n += keys.size
            if n >= HELD:
                yield dealt(got)
                got, n = [], 0
        if got:
            yield dealt(got)

    return lines.select("nh", "line").mapInArrow(run, "part int, bands binary")


def shared_keys(bands: DataFrame) -> DataFrame:
    """(key, nh, least) of the keys that different lines share, each once; least: the smallest line of the key.

    ``bands``: of ``bands_of``, or rows (key, nh)."""

    def pairs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if "key" in batch.schema.names:
            yield batch.column("key").to_numpy(), batch.column("nh").to_numpy()
            return
        for x in batch.column("bands"):
            yield tuple(np.frombuffer(x.as_buffer(), np.int64).reshape(2, -1).copy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for b in batches if b.num_rows for x in pairs(b)]
        if not got:
            return
        key, nh = (np.concatenate(x) for x in zip(*got))
        got.clear()
        order = np.argsort(key)
        key, nh = key[order], nh[order]
        same = key[1:] == key[:-1]
        often = np.r_[False, same] | np.r_[same, False]
        key, nh = key[often], nh[often]
        order = np.lexsort((nh, key))
        key, nh = key[order], nh[order]
        once = np.r_[True, (key[1:] != key[:-1]) | (nh[1:] != nh[:-1])][: len(key)]
        key, nh = key[once], nh[once]
        same = key[1:] == key[:-1]
        often = np.r_[False, same] | np.r_[same, False][: len(key)] if len(key) else np.zeros(0, bool)
        key, nh = key[often], nh[often]
        starts, of = _runs(key)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, nh, nh[starts][of])], names=["key", "nh", "least"])

    dealt = bands.repartition("part" if "part" in bands.columns else "key")
    return dealt.mapInArrow(run, "key long, nh long, least long")


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where runs of equal rows begin, the run of each row)."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
    return np.flatnonzero(new), np.cumsum(new) - 1


def stars(held: DataFrame) -> DataFrame:
    """(a, b): of the lines of each key the smallest, a, with each other one, b."""
    return held.filter("nh <> least").select(F.col("least").alias("a"), F.col("nh").alias("b")).distinct()


def mixed_keys(classes: DataFrame) -> DataFrame:
    """(key, nh, class, main, pivot, blocks) of ``classes(key, nh, class)``, a row for each line of the keys with lines
    to compare.

    main: the key's largest class; pivot: its smallest line, which has met all others. Without it lines of two classes
    must be left. blocks: into how many the key's lines are dealt.
    """
    columns = ["key", "nh", "class"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(c).to_numpy() for c in columns] for b in batches if b.num_rows]
        if not got:
            return
        key, nh, kind = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((kind, key))
        key, nh, kind = key[order], nh[order], kind[order]
        starts, of = _runs(key)
        firsts, own = _runs(key, kind)
        n, size = np.diff(np.r_[starts, len(key)]), np.diff(np.r_[firsts, len(key)])
        kinds, pivot = np.bincount(of[firsts], minlength=len(starts)), np.minimum.reduceat(nh, starts)
        beside = size[own][nh == pivot[of]]  # lines of the pivot's class
        ranked = np.lexsort((kind[firsts], size, of[firsts]))
        most = ranked[np.cumsum(kinds) - 1]
        main, rest = kind[firsts][most], n - size[most]
        blocks = np.ceil(np.sqrt(n * rest / SPLIT)).astype(np.int64)
        some = ((kinds > 2) | (kinds == 2) & (beside > 1))[of]
        out = (key, nh, kind, main[of], pivot[of], blocks[of])
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in out], names=[*columns, "main", "pivot", "blocks"])

    return classes.select(*columns).repartition("key").mapInArrow(run, "key long, nh long, class long, main long, pivot long, blocks long")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of sorted batches, those of a (key, part) together."""
    held = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        last = int(_runs(held.column("key").to_numpy(), held.column("part").to_numpy())[0][-1]) if held.num_rows else 0
        if last:
            yield held.slice(0, last)
            held = held.slice(last)
    if held is not None and held.num_rows:
        yield held


def crossing(members: DataFrame) -> DataFrame:
    """(a, b): of ``members(key, class, nh, line, keys, main, pivot, blocks)`` the similar lines of a key that are of
    different classes.

    Lines of a key's largest class, ``main``, meet only those outside it, and its smallest line, ``pivot``, which has met
    all, none. They are compared where the key's lines are, so no pair is shuffled, and under the smallest key of a pair
    only: ``keys`` are a line's other keys of several classes. The lines of a key are dealt into
    ``blocks``, and each two of these meet in a group of their own. A task holds the lines of one group and of some
    ``PAIRS`` pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, texts = [], 0, {}
        for rows in _keys(batches):
            line = rows.column("line").combine_chunks()
            nh = rows.column("nh").to_numpy()
            for a, b in _meetings(rows, pc.utf8_length(line).to_numpy()):
                pairs.append(np.c_[np.minimum(nh[a], nh[b]), np.maximum(nh[a], nh[b])])
                n += len(a)
                at = np.unique(np.r_[a, b])
                texts.update(zip(nh[at].tolist(), line.take(pa.array(at)).to_pylist()))
                if n >= PAIRS:
                    yield _links(pairs, texts)
                    pairs, n, texts = [], 0, {}
        if pairs:
            yield _links(pairs, texts)
        pa.default_memory_pool().release_unused()

    spark = members.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    dealt = members.withColumn("block", F.pmod(F.xxhash64("nh"), "blocks"))
    # a block alone is a group, too: of two blocks only lines of different ones are compared
    with_ = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", with_).withColumn("part", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"))
    split = dealt.repartition(tasks, "key", "part").sortWithinPartitions("key", "part")
    return split.select("key", "part", "block", "class", "nh", "line", "keys", "main", "pivot").mapInArrow(run, "a long, b long").distinct()


def _meetings(rows: pa.Table, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows to compare (see ``crossing``), about ``PAIRS`` at once at most; size: characters of each line."""
    key, kind, nh, block, main, pivot = (rows.column(c).to_numpy() for c in ("key", "class", "nh", "block", "main", "pivot"))
    of = _runs(key, rows.column("part").to_numpy())[1]
    order = np.lexsort((nh, size, of))
    key, kind, nh, block, size = key[order], kind[order], nh[order], block[order], size[order].astype(np.int64)
    main, pivot = kind == main[order], nh == pivot[order]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])  # rows of a group were together before, too
    split = (np.minimum.reduceat(block, first) != np.maximum.reduceat(block, first))[of]
    spot = of << 32 | size
    i = np.flatnonzero(~main & ~pivot)
    lo = np.searchsorted(spot, of[i] << 32 | np.ceil(size[i] * SIMILARITY - 1e-6).astype(np.int64))
    hi = np.searchsorted(spot, of[i] << 32 | np.floor(size[i] / SIMILARITY + 1e-6).astype(np.int64), "right")
    ends = np.cumsum(hi - lo)
    shared = _SharedKeys(rows.column("keys").combine_chunks(), order, key)
    at = 0
    while at < len(i):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        span = (hi - lo)[at:to]
        a = np.repeat(i[at:to], span)
        b = np.arange(len(a)) + np.repeat(lo[at:to] - np.cumsum(span) + span, span)
        meet = (kind[a] != kind[b]) & ~pivot[b] & (main[b] | (b > a)) & (~split[a] | (block[a] != block[b]))
        a, b = a[meet], b[meet]
        if len(a):
            alone = ~shared(a, b)
            a, b = a[alone], b[alone]
        if len(a):
            yield order[a], order[b]
        at = to


class _SharedKeys:
    """Which pairs of rows share a key that is smaller than their own, and so meet elsewhere."""

    def __init__(self, keys: pa.ListArray, order: np.ndarray, key: np.ndarray):
        offsets = keys.offsets.to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        row = np.repeat(place, np.diff(offsets))
        values = keys.values.to_numpy()[offsets[0] : offsets[-1]]
        less = values < key[row]
        self.names, name = np.unique(values[less], return_inverse=True)
        self.codes = np.sort(row[less] * len(self.names) + name)
        row = self.codes // max(1, len(self.names))
        self.count = np.bincount(row, minlength=len(order))
        self.start = np.cumsum(self.count) - self.count
        # a bit for each of 64 kinds of keys: rows without a common bit share none
        self.bits = np.zeros(len(order), np.uint64)
        np.bitwise_or.at(self.bits, row, np.uint64(1) << (self.codes % max(1, len(self.names)) % 64).astype(np.uint64))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        may = np.flatnonzero(self.bits[a] & self.bits[b])
        for at in range(0, len(may), PAIRS // 4 + 1):
            some = may[at : at + PAIRS // 4 + 1]
            x, y = a[some], b[some]
            few = self.count[x] <= self.count[y]
            x, y = np.where(few, x, y), np.where(few, y, x)
            count = self.count[x]
            begins = np.cumsum(count) - count
            code = self.codes[np.arange(count.sum()) + np.repeat(self.start[x] - begins, count)]
            code += np.repeat((y - x) * len(self.names), count)
            found = self.codes[np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)] == code
            out[some] = np.logical_or.reduceat(found, begins)
        return out


def _links(pairs: list[np.ndarray], texts: dict) -> pa.RecordBatch:
    """Those of ``pairs`` that are similar."""
    pairs = np.unique(np.concatenate(pairs), axis=0)
    same = similar_pairs([texts[k] for k in pairs[:, 0].tolist()], [texts[k] for k in pairs[:, 1].tolist()])
    return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs[np.array(same, bool)].T.copy()], names=["a", "b"])


def spotter(ends: DataFrame):
    """A broadcast bit table of fixed size that holds the line hashes of ``ends`` and, by chance, few others.

    It only saves moving lines that are no candidates; the exact join follows. Its rows are ``FILTER`` at most.
    """
    words = ends.groupBy(F.pmod("nh", F.lit(FILTER)).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(shiftright(nh, 20), 64L) as int))")).alias("bits"))
    table = np.zeros(FILTER, np.uint64)
    for batch in words.toArrow().to_batches():
        table[batch.column("w").to_numpy()] = batch.column("bits").to_numpy().view(np.uint64)
    return ends.sparkSession.sparkContext.broadcast(table)


def candidate_lines(lines: DataFrame, ends: DataFrame) -> DataFrame:
    """(nh, line) of the normalised lines that ``ends`` names, each once."""
    shared = spotter(ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = shared.value, np.zeros(0, np.int64)
        for batch in batches:
            nh, first = np.unique(batch.column("nh").to_numpy(), return_index=True)
            bit = (table[nh % FILTER] >> ((nh >> 20) % 64).astype(np.uint64)) & np.uint64(1)
            named = (bit == 1) & ~np.isin(nh, seen, assume_unique=True)
            seen = np.union1d(seen, nh[named])
            if named.any():
                yield batch.take(pa.array(np.sort(first[named])))

    found = lines.select("nh", "line").mapInArrow(run, "nh long, line string")
    return found.join(ends, "nh", "left_semi").groupBy("nh").agg(F.min("line").alias("line"))


def edit_distance(a: str, b: str, most: float = math.inf) -> int:
    """Levenshtein distance, bit-parallel: one column of the table is one wide integer. Beyond ``most`` a number that is
    larger than that: a character of ``b`` brings the last row down by one at most."""
    start = len(os.path.commonprefix([a, b]))
    a, b = a[start:], b[start:]
    end = len(os.path.commonprefix([a[::-1], b[::-1]]))
    a, b = a[: len(a) - end], b[: len(b) - end]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    chars = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    where = {chr(c): int.from_bytes(np.packbits(chars == c, bitorder="little").tobytes(), "little") for c in np.unique(chars).tolist()}
    every, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = every, 0, len(a)
    for left, c in zip(range(len(b) - 1, -1, -1), b):
        same = where.get(c, 0)
        diagonal = same | down
        across = (((same & up) + up) ^ up) | same
        more, less = down | (every & ~(across | up)), up & across
        distance += 1 if more & top else -1 if less & top else 0
        if distance - left > most:
            return distance - left
        more, less = (more << 1 | 1) & every, less << 1 & every
        up, down = less | (every & ~(diagonal | more)), more & diagonal
    return distance


def surely_similar(a: str, b: str, allowed: int) -> bool:
    """Whether an alignment word by word, which meets again at the next two equal words, needs ``allowed`` edits or fewer."""
    x, y = a.split(" "), b.split(" ")
    i = j = cost = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        for gap in range(1, 13):
            for p in range(gap + 1):
                u, v = i + p, j + gap - p
                if x[u : u + 2] == y[v : v + 2] and u < len(x):
                    break
            else:
                continue
            break
        else:
            break
        cost += max(sum(map(len, x[i:u])) + u - i, sum(map(len, y[j:v])) + v - j)
        i, j = u, v
        if cost > allowed:
            return False
    cost += max(sum(map(len, x[i:])) + len(x) - i, sum(map(len, y[j:])) + len(y) - j)
    return cost <= allowed


def surely_apart(a: list[str], b: list[str], allowed: np.ndarray) -> np.ndarray:
    """Which pairs differ in more trigrams than ``allowed`` edits can change: an edit changes three on either side."""
    size = np.array([*map(len, a), *map(len, b)])
    code = np.frombuffer("".join([*a, *b]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    at = np.repeat(np.arange(len(size)), size)
    h = (code[:-2] * np.uint64(961) + code[1:-1] * np.uint64(31) + code[2:]) * _MIX >> np.uint64(64 - 9)
    inside = at[:-2] == at[2:]
    count = np.bincount(at[:-2][inside] * 512 + h[inside].astype(np.int64), minlength=512 * len(size)).reshape(2, len(a), 512)
    return np.abs(count[0] - count[1]).sum(axis=1) > 6 * allowed


def _rows(up: np.ndarray, down: np.ndarray, score: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(a column's distances in the words from ``first`` on, for each pair, the last of them ``score``; their rows)."""
    p, q = (np.unpackbits(np.ascontiguousarray(x.T).view(np.uint8), axis=1, bitorder="little").view(np.int8) for x in (up, down))
    steps = np.zeros((len(p), p.shape[1] + 1), np.int32)
    np.cumsum(p - q, axis=1, out=steps[:, 1:])
    steps += (score - steps[:, -1])[:, None].astype(np.int32)
    return steps, np.arange(64 * first, 64 * (first + len(up)) + 1)


def _once(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """(the different texts, which of them each text is)."""
    names: dict[str, int] = {}
    at = np.array([names.setdefault(x, len(names)) for x in texts], np.int64)
    return list(names), at


def within(a: list[str], b: list[str], allowed: np.ndarray) -> np.ndarray:
    """Which pairs have an edit distance of ``allowed`` or less: exact, many pairs at once. No ``b`` is longer than its ``a``.

    The columns of the table are words of 64 rows, as in ``edit_distance``, side by side for all pairs; what they are
    made of is held once for each different text. A way of ``allowed`` edits that steps aside must come back, so only
    words that it can touch then are worked on, and pairs with no such way left drop out every 64 columns.
    """
    out = np.zeros(len(a), bool)
    (a, left), (b, right) = _once(a), _once(b)
    sizes = [np.array([*map(len, x)], np.int64) for x in (a, b)]
    m, n = sizes[0][left], sizes[1][right]
    words = int(sizes[0].max() + 63) // 64
    text = [np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), np.uint32) for x in (a, b)]
    signs = np.zeros(max(int(x.max(initial=0)) for x in text) + 1, bool)
    for x in text:
        signs[x] = True
    number = np.cumsum(signs, dtype=np.int32) - 1
    col = int(number[-1]) + 2
    row, code = [np.repeat(np.arange(len(x)), x) for x in sizes], [number[x].astype(np.int64) for x in text]
    place = [np.arange(len(r)) - np.repeat(np.cumsum(x) - x, x) for r, x in zip(row, sizes)]
    bag = [np.bincount(r * col + c, minlength=len(x) * col).reshape(len(x), col) for r, c, x in zip(row, code, sizes)]
    differ = bag[0][left] - bag[1][right]  # an edit takes one character away or brings one, or both
    who = np.flatnonzero(np.maximum(np.maximum(differ, 0).sum(axis=1), np.maximum(-differ, 0).sum(axis=1)) <= allowed)
    if not len(who):
        return out
    at = (2 * (place[0] // 64) + place[0] // 32 % 2) * (len(a) * col) + row[0] * col + code[0]
    halves = np.bincount(at, np.exp2(place[0] % 32), 2 * words * len(a) * col).astype(np.uint64).reshape(words, 2, len(a) * col)
    same = halves[:, 0] | halves[:, 1] << np.uint64(32)
    across = np.full((int(sizes[1].max()), len(b)), col - 1, np.int32)
    across[place[1], row[1]] = code[1]

    one, top = np.uint64(1), np.uint64(63)
    below, above = int(((allowed - m + n) // 2)[who].max()), int(((allowed + m - n) // 2)[who].max())
    up, down = np.full((words, len(who)), ~np.uint64(0)), np.zeros((words, len(who)), np.uint64)
    score, opened = np.full(len(who), 64, np.int64), 0
    ends, base, of = set(n[who].tolist()), left[who] * col, right[who]
    room = np.empty((8, len(who)), np.uint64)
    eq = np.empty((min(words, (below + above) // 64 + 2), len(who)), np.uint64)
    for j in range(int(n[who].max())):
        first, last = max(0, j - below) // 64, min(words - 1, (j + above) // 64)
        score += 64 * (last - opened)  # words below start from the row above them
        opened = last
        here = eq[: last - first + 1]
        same[first : last + 1].take(across[j].take(of) + base, axis=1, out=here, mode="clip")
        x, h, rise, *carry = room
        plus = minus = None
        for w in range(first, last + 1):
            e, p, q = here[w - first], up[w], down[w]
            np.bitwise_or(e, q, out=x)
            if minus is not None:
                e |= minus
            np.bitwise_and(e, p, out=h)
            h += p
            h ^= p
            h |= e
            np.bitwise_or(h, p, out=rise)
            np.invert(rise, out=rise)
            rise |= q
            h &= p
            more, less = carry[:2] if plus is carry[2] else carry[2:4]
            np.right_shift(rise, top, out=more)
            np.right_shift(h, top, out=less)
            rise <<= one
            rise |= one if plus is None else plus
            h <<= one
            if minus is not None:
                h |= minus
            np.bitwise_and(rise, x, out=q)
            x |= rise
            np.invert(x, out=x)
            np.bitwise_or(h, x, out=p)
            plus, minus = more, less
        score += plus.view(np.int64)
        score -= minus.view(np.int64)
        if (j + 1) in ends:
            done = np.flatnonzero(n[who] == j + 1)
            d, i = _rows(up[first : last + 1, done], down[first : last + 1, done], score[done], first)
            end = m[who[done]]
            held = np.flatnonzero((end >= i[0]) & (end <= i[-1]))
            out[who[done[held]]] = d[held, end[held] - i[0]] <= allowed[who[done[held]]]
        if j % 64 == 63:
            d, i = _rows(up[first : last + 1], down[first : last + 1], score, first)
            end = m[who][:, None]
            d += np.abs(end - i - (n[who][:, None] - j - 1)).astype(np.int32)
            alive = (np.where(i <= end, d, 1 << 30).min(axis=1) <= allowed[who]) & (n[who] > j + 1)
            if not alive.all():
                who, up, down, score = who[alive], up[:, alive], down[:, alive], score[alive]
                if not len(who):
                    break
                base, of, room, eq = left[who] * col, right[who], room[:, : len(who)].copy(), eq[:, : len(who)].copy()
    return out


def similar_pairs(a: list[str], b: list[str], likely: bool = False) -> list[bool]:
    """Whether 1 - distance / length of the longer is ``SIMILARITY`` or more, for each pair: side by side, or by bounds where
    they decide and one by one where lines are long or few. likely: most pairs are, so long ones are aligned by words first."""
    sizes = np.array([[*map(len, a)], [*map(len, b)]], np.int64)
    longer, shorter = sizes.max(axis=0, initial=0), sizes.min(axis=0, initial=1 << 62)
    allowed = (longer * (1 - SIMILARITY) + 1e-9).astype(np.int64)
    out = np.zeros(len(a), bool)
    todo = np.flatnonzero((longer - shorter <= allowed) & (shorter > 0))
    todo = todo[np.argsort(longer[todo], kind="stable")]
    short = int(np.searchsorted(longer[todo], COUNTED))
    near = [np.zeros(0, np.int64)]
    for at in range(0, short, 256):
        some = todo[at : min(at + 256, short)]
        near.append(some[~surely_apart([a[k] for k in some], [b[k] for k in some], allowed[some])])
    todo = np.concatenate([*near, todo[short:]])
    if likely:
        out[todo] = [longer[k] >= ALIGNED and surely_similar(a[k], b[k], allowed[k]) for k in todo.tolist()]
        todo = todo[~out[todo]]
    at, single, signs = 0, [todo[longer[todo] > WIDE]], {}
    while at < len(todo) and longer[todo[at]] <= WIDE:
        end = at + BATCH
        end = min(end, int(np.searchsorted(longer[todo], min(WIDE, longer[todo[at]] * SPREAD), "right")))
        while True:
            some = todo[at:end].tolist()
            x, y = [max(a[k], b[k], key=len) for k in some], [min(a[k], b[k], key=len) if len(a[k]) != len(b[k]) else b[k] for k in some]
            rows = set(x)
            for text in rows.union(y):
                if text not in signs:
                    signs[text] = frozenset(text)
            if len(some) == 1 or len(rows) * len(frozenset().union(*map(signs.get, rows.union(y)))) * ((len(x[-1]) + 63) // 64) <= TABLE:
                break
            end = at + (end - at) // 2
        some, at = todo[at:end], end
        if len(some) < FEW + longer[some[-1]] // FEW_CHARS:
            single.append(some)
            continue
        out[some] = within(x, y, allowed[some])
    single = np.concatenate(single)
    for k, most in zip(single.tolist(), allowed[single].tolist()):
        out[k] = not (likely and longer[k] >= ALIGNED) and surely_similar(a[k], b[k], most) or edit_distance(a[k], b[k], most) <= most
    return out.tolist()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose normalised lines have an edit similarity of ``SIMILARITY`` or more."""
    both = (
        pairs.join(texts.select(F.col("nh").alias("a"), F.col("line").alias("la")), "a")
        .join(texts.select(F.col("nh").alias("b"), F.col("line").alias("lb")), "b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8 * BATCH):
                part = batch.slice(at, 8 * BATCH)
                same = similar_pairs(part.column("la").to_pylist(), part.column("lb").to_pylist(), likely=True)
                yield part.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def line_classes(lines: DataFrame) -> DataFrame:
    """(nh, class) of the lines that have a partner: connected by pairs that share a key and are similar.

    Of each key the smallest line is compared with the others first. What that connects need not meet again; lines of a
    key that are of different classes then are compared pair by pair, so that no similar pair that shares a key is left
    out. A pair that shares no key is missed (see the README's recall).
    """
    held = materialize(shared_keys(bands_of(lines)), "lines-keys")
    texts = materialize(candidate_lines(lines, held.select("nh").distinct()), "lines-text")
    rays = materialize(stars(held), "lines-pairs")
    first = materialize(connected_components(verified(rays, texts)), "lines-first")
    classes = held.join(first.withColumnRenamed("node", "nh"), "nh", "left").select("key", "nh", F.coalesce("component", "nh").alias("class"))
    spots = mixed_keys(classes).groupBy("nh").agg(F.min("class").alias("class"), F.collect_list(F.struct("key", "main", "pivot", "blocks")).alias("own"))
    members = spots.join(texts, "nh").select("nh", "class", "line", F.col("own.key").alias("keys"), F.inline("own"))
    more = crossing(members)
    reach = connected_components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    discard(held, texts, rays)  # the components are checkpointed
    return reach.select(F.col("node").alias("nh"), F.col("component").alias("class"))


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, th, gone array<int>): the positions of the lines to remove from each text that loses any."""
    lines = materialize(lines_of(docs), "lines")
    place = F.struct(F.col("doc_id"), F.col("th"), F.col("pos"))
    spots = lines.select("doc_id", "th", "pos", "nh")
    nodes = materialize(spots.groupBy("nh").agg(F.count("*").alias("n"), F.min(place).alias("first")), "lines-nodes")
    classes = materialize(line_classes(lines), "lines-classes")
    in_class = nodes.join(classes, "nh")
    least = in_class.groupBy("class").agg(F.min("first").alias("keep"), F.count("*").alias("m"))
    linked = join_hot(in_class, materialize(least, "lines-keepers"), "class", "m").select("nh", "n", "keep")
    alone = nodes.join(classes, "nh", "left_anti").filter("n > 1").select("nh", "n", F.col("first").alias("keep"))
    keepers = materialize(linked.unionByName(alone), "lines-keep")
    gone = join_hot(spots, keepers, "nh", "n").filter(~place.eqNullSafe(F.col("keep")))
    return gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` rid of repeated lines, and ``n_lines long`` and ``n_removed long`` behind its columns.

    A line is what stands between newlines. Lines that hold more than white space and ASCII punctuation are
    normalised (lower case; runs of both as single spaces). Two lines are linked if their normalised forms, of nine or
    more bytes, have an edit similarity of 0.8 or more; they meet by MinHash bands over their byte n-grams, which find
    nearly all such pairs (the README states the measured recall).
    Of each connected group, and of each set of equal lines, the occurrence with the smallest (doc_id, text hash,
    position) stays; nulls order first. Other lines stay as they are, in order.

    Null texts stay null, with no lines. Rows that repeat both doc_id and text are one document and get the same
    text. Extra columns stay; columns of the names n_lines and n_removed are replaced. Empty in, empty out.
    """
    gone = removals(docs).withColumnsRenamed({"doc_id": "__id", "th": "__th", "gone": "__gone"})
    base = docs.drop("n_lines", "n_removed").withColumn("__key", F.xxhash64(text_of()))
    joined = base.join(gone, base["doc_id"].eqNullSafe(gone["__id"]) & (base["__key"] == gone["__th"]), "left")
    split = F.split("text", "\n")

    def without(lines):  # transform(array(x), f) evaluates x once
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    spare = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.get(F.transform(F.array(split), without), F.lit(0)))
    return (
        joined.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long"))
        .withColumn("n_removed", F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long"))
        .withColumn("text", spare)
        .drop("__id", "__th", "__gone", "__key")
    )
