"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same bytes of texts.

Both token sequences of a text are cut at the byte offsets where a token of each ends; tokens whose byte ranges
overlap are linked. Links between tokens of the same bytes take a fast path: an array from each A id to the B id of
the same bytes names the only partner such a link can have, so it is counted in a vector as long as the vocabulary.
Only the other links are shuffled as pairs.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PerfectHash, Splitter, Vocabulary, _Cache, _worker, splitter, tokenizers_class
from .common import materialize, scratch

#: Pairs are dealt to this many buckets by hash; a bucket's share of all pairs of two vocabularies is bounded.
BUCKETS = 256
#: Characters of text whose links are packed together.
SLICE = 1 << 22
#: Characters of text whose tokens are laid end to end.
AT_ONCE = 1 << 18
#: Distinct pairs that a task counts before it gives them on.
HELD = 1 << 21
_LOW = (1 << 32) - 1


@lru_cache(maxsize=2)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class _Encoded(_Cache):
    """Pre-token to its ids by A: those that the vocabulary has whole from a table, the others by the merges."""

    known = encoded = staticmethod(tuple)


def encoder_parts(path: str, pattern: str) -> tuple:
    """A's vocabulary, its table of whole pre-tokens with their ids (by the merges themselves), and the split patterns.

    The ids are those of the tokenizers library without special tokens; what it takes for one is plain text here.
    """
    vocabulary, split = Vocabulary.from_json(path), splitter(pattern, tokenizers_class)
    pieces, keys, ids = Splitter(*split), [], []
    for t in vocabulary.tokens:
        try:
            word = t.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if word and [p for part in pieces(word) for p in part] == [word]:
            keys.append(t), ids.append(tuple(vocabulary.encode_piece(t)))
    return vocabulary, PerfectHash(keys), ids, split


def bytes_of_pieces(path: str) -> list[bytes]:
    """The bytes that each piece of a sentencepiece model stands for: U+2581 is a space, <0xHH> the byte HH."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    piece = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    return [piece(i) for i in range(model.get_piece_size())]


class Aligner:
    """Encodes texts by both tokenizers and links their tokens; also usable without Spark."""

    def __init__(self, vocabulary: Vocabulary, whole: PerfectHash, ids_of: list[tuple], split: tuple[str, str, str], path_b: str, bytes_b: list[bytes]):
        self.a, self.pieces, self.b = _Encoded(vocabulary, whole, ids_of), Splitter(*split), _pieces(path_b)
        self.bytes_a = bytes_a = vocabulary.tokens
        self.bytes_b = bytes_b
        self.len_a, self.len_b = (np.array([len(t) for t in v], np.int64) for v in (bytes_a, bytes_b))
        self.width = self.len_a.tolist()
        self.same = same_bytes(bytes_a, bytes_b)
        n = len(bytes_a)
        self.bits_a, self.bits_b = n.bit_length(), len(bytes_b).bit_length()
        self.bits = self.bits_a + self.bits_b
        ids = [str(i) for i in range(max(n, len(bytes_b)))]
        # an id and what follows it: more of its side, or the end of the side
        self.shown = [i + "," for i in ids[:n]] + [i + "|" for i in ids[:n]] + [i + "," for i in ids[: len(bytes_b)]] + [i + ";" for i in ids[: len(bytes_b)]]

    def tokens(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each text by both tokenizers; none where they don't give back a space and the text."""
        a, get = [], self.a.__getitem__
        b = self.b.encode(texts, num_threads=1)
        for k, t in enumerate(texts):
            raw = (" " + t).encode("utf-8", "surrogatepass")
            ids = [i for part in self.pieces(" " + t) for own in map(get, part) for i in own] if t else []
            a.append(ids)
            # A's tokens of a pre-token are its bytes, so theirs are the text's if the pre-tokens leave nothing out
            if len(raw) == 1 or sum(map(self.width.__getitem__, ids)) != len(raw) or b"".join(map(self.bytes_b.__getitem__, b[k])) != raw:
                a[k], b[k] = [], []
        return a, b

    def links(self, texts: list[str]):
        """Links of several texts: (n_a, n_b, n_groups, n_links, digests, even, odd).

        The first four are vectors over texts; a digest is that of ``a1,a2|b1;a3|b2,b3``. even: (text, A id, how often)
        of the links to same-bytes partners, odd: (text, pair, how often) of the others, each once for a text.
        The texts' tokens are laid end to end: every text's end is an end on both sides.
        """
        ids_a, ids_b = self.tokens(texts)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(texts)) for x in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, n) for x, n in ((ids_a, n_a.sum()), (ids_b, n_b.sum())))
        end_a, end_b = self.len_a[a].cumsum(), self.len_b[b].cumsum()
        # between two neighbouring ends lies one token of each side: a link, and no link lies in two such places
        ends = np.concatenate([end_a, end_b])
        ends.sort(kind="stable")
        twice = ends[1:] == ends[:-1]
        common = ends[1:][twice]
        ends = ends[np.concatenate([[True], ~twice])] if len(ends) else ends
        text_end = np.concatenate([[0], end_a])[n_a.cumsum()]
        n_groups, n_links = (np.diff(x.searchsorted(text_end, "right"), prepend=0) for x in (common, ends))
        at_a, at_b = end_a.searchsorted(ends), end_b.searchsorted(ends)
        ia, ib, text = a[at_a], b[at_b], text_end.searchsorted(ends)
        even = self.same[ia] == ib
        key = text << self.bits | ia << self.bits_b | ib
        some, times = np.unique(key[even], return_counts=True)
        pair = lambda k: (k >> self.bits_b & (1 << self.bits_a) - 1) << 32 | k & (1 << self.bits_b) - 1
        evens = some >> self.bits, pair(some) >> 32, times
        some, times = np.unique(key[~even], return_counts=True)
        return n_a, n_b, n_groups, n_links, self.digests(a, b, end_a, end_b, common, n_a, n_b), evens, (some >> self.bits, pair(some), times)

    def digests(self, a, b, end_a, end_b, common, n_a, n_b) -> list[str]:
        group_a, group_b = common.searchsorted(end_a), common.searchsorted(end_b)
        last = lambda g: np.concatenate([g[1:] != g[:-1], [True]]) if len(g) else np.zeros(0, bool)
        n, m = len(self.bytes_a), len(self.bytes_b)
        what = np.concatenate([a + n * last(group_a), 2 * n + b + m * last(group_b)])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        shown, at, out = list(map(self.shown.__getitem__, what[order].tolist())), 0, []
        for k in (n_a + n_b).tolist():
            out.append(hashlib.sha256("".join(shown[at : at + k])[:-1].encode()).hexdigest() if k else "")
            at += k
        return out


def same_bytes(bytes_a: list[bytes], bytes_b: list[bytes]) -> np.ndarray:
    """From each A id to the smallest B id of the same bytes, or -1."""
    first: dict[bytes, int] = {}
    for i, t in enumerate(bytes_b):
        first.setdefault(t, i)
    return np.array([first.get(t, -1) if t else -1 for t in bytes_a], np.int64)


def bucket_of(pairs: np.ndarray) -> np.ndarray:
    """The bucket of each pair, by a mix of its bits."""
    with np.errstate(over="ignore"):
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % BUCKETS


_FOUND = "rid long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, ids binary, times binary, bucket int, kind string"


def _found_arrow(doc_id: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("doc_id", doc_id), *[(c, pa.int64()) for c in ("rid", "n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()),
        *[(c, pa.binary()) for c in ("ids", "times")], ("bucket", pa.int32()), ("kind", pa.string()),
    ])


def _encode(shared, size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text a row "text"; of each slice of texts a row "pairs" for each bucket; of the task a row "vector".

    "text" has the ids that are linked to their same-bytes partners. "pairs" has, for each text of the slice and each
    other pair, the pair (``ids``) and, in two rows of numbers (``times``), the text's distance from the first text of
    the slice, which is ``rid``, and how often. "vector" counts, for each A id, the task's texts that link it to its
    partner.
    """
    aligner = _worker(shared, Aligner)
    vector = np.zeros(len(aligner.bytes_a), np.int64)
    rows, odd, held, schema = [], [], 0, None

    def record(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def packed() -> Iterator[tuple]:
        if not odd:
            return
        rids, pairs, times = (np.concatenate(x) for x in zip(*odd))
        first = int(rids.min())
        rids, times = (rids - first).astype(np.int32), times.astype(np.int32)
        order = np.argsort(bucket_of(pairs), kind="stable")
        pairs, rids, times = pairs[order], rids[order], times[order]
        bounds = np.searchsorted(bucket_of(pairs), np.arange(BUCKETS + 1))
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            own = slice(bounds[k], bounds[k + 1])
            yield (None, first, None, None, None, None, None, pairs[own].tobytes(), np.stack([rids[own], times[own]]).tobytes(), k, "pairs")

    def linked(ids: list, rids: list, texts: list[str]) -> None:
        n_a, n_b, n_groups, n_links, digests, (text, a, times), (odd_text, pairs, n_pairs) = aligner.links(texts)
        np.add.at(vector, a, 1)
        bounds = text.searchsorted(np.arange(len(texts) + 1)).tolist()
        a, times = a.astype(np.int32), times.astype(np.int32)
        numbers = [x.tolist() for x in (n_a, n_b, n_groups, n_links)]
        for k, (doc_id, rid) in enumerate(zip(ids, rids)):
            own = slice(bounds[k], bounds[k + 1])
            rows.append((doc_id, rid, *(x[k] for x in numbers), digests[k], a[own].tobytes(), times[own].tobytes(), 0, "text"))
        if len(pairs):
            odd.append((np.array(rids, np.int64)[odd_text], pairs, n_pairs))

    for batch in batches:
        schema = schema or _found_arrow(batch.schema.field("doc_id").type)
        ids, rids, texts, size_now = [], [], [], 0
        for doc_id, rid, text in zip(batch.column("doc_id").to_pylist(), batch.column("rid").to_pylist(), batch.column("text")):
            ids.append(doc_id), rids.append(rid), texts.append(text.as_py() or "")
            size_now += len(texts[-1]) + 64
            if size_now >= AT_ONCE:
                linked(ids, rids, texts)
                held += size_now
                ids, rids, texts, size_now = [], [], [], 0
            if held >= size:
                rows.extend(packed())
                yield record(rows)
                rows.clear(), odd.clear()
                held = 0
        if texts:
            linked(ids, rids, texts)
            held += size_now
    if schema is not None:
        rows.extend(packed())
        some = np.flatnonzero(vector).astype(np.int32)
        rows.append((None, None, None, None, None, None, None, some.tobytes(), vector[some].tobytes(), 0, "vector"))
        yield record(rows)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with how many texts of the task hold them."""
    held, n = [], 0

    def give() -> Iterator[pa.RecordBatch]:
        pairs, counts = np.unique(np.concatenate(held), return_counts=True)
        for i in range(0, len(pairs), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + (1 << 16)]), pa.array(counts[i : i + (1 << 16)])], names=["pair", "n"])

    for batch in batches:
        for ids in batch.column("ids"):
            held.append(np.frombuffer(ids.as_py(), np.int64))
            n += len(held[-1])
            if n >= HELD:
                yield from give()
                held, n = [], 0
    if held:
        yield from give()


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, int] = {}
    for batch in batches:
        for ids, times in zip(batch.column("ids"), batch.column("times")):
            for i, n in zip(np.frombuffer(ids.as_py(), np.int32).tolist(), np.frombuffer(times.as_py(), np.int64).tolist()):
                total[i] = total.get(i, 0) + n
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["a", "n"])


def _looked_up(best: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by bucket, counts first: for each text of a packed row its links, of the bucket, that are best and their counts."""
    bucket, known, counts, parts = None, None, None, []
    for batch in batches:
        get = lambda c, batch=batch: batch.column(c).to_pylist()
        for k, is_texts, pairs, ns, first, ids, times in zip(*map(get, ("bucket", "is_texts", "pairs", "ns", "rid", "ids", "times"))):
            if k != bucket:
                bucket, known, counts, parts = k, None, None, []
            if not is_texts:
                parts.append((np.array(pairs, np.int64), np.array(ns, np.int64)))
                continue
            if known is None:
                known, counts = np.concatenate([p for p, _ in parts]), np.concatenate([n for _, n in parts])
                order = np.argsort(known)
                known, counts, parts = known[order], counts[order], []
            pair = np.frombuffer(ids, np.int64)
            at, n = np.frombuffer(times, np.int32).astype(np.int64).reshape(2, -1)
            found = counts[known.searchsorted(pair)]
            texts, own = np.unique(at, return_inverse=True)
            n_best, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            np.add.at(n_best, own, np.where(found == best[pair >> 32], n, 0))
            np.add.at(total, own, n * found)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (texts + first, n_best, total)], names=["rid", "n_best", "count_sum"])


def _evened(even: np.ndarray, best: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for links to same-bytes partners, by the vectors."""
    for batch in batches:
        n_best, total = [], []
        for ids, times in zip(batch.column("ids"), batch.column("times")):
            a, n = np.frombuffer(ids.as_py(), np.int32), np.frombuffer(times.as_py(), np.int32).astype(np.int64)
            n_best.append(int(n[even[a] == best[a]].sum())), total.append(int((n * even[a]).sum()))
        yield batch.drop_columns(["ids", "times"]).append_column("even_best", pa.array(n_best, pa.int64())).append_column("even_sum", pa.array(total, pa.int64()))


def _vector(df: DataFrame, column: str, size: int) -> np.ndarray:
    """A vector as long as the vocabulary, from rows (a, ``column``), one at most for each id."""
    out = np.zeros(size, np.int64)
    found = df.select("a", column).toPandas()
    out[found["a"].to_numpy()] = found[column].to_numpy()
    return out


def align(docs: DataFrame, path_a: str, path_b: str, pattern: str, slice_chars: int = SLICE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, pairs, partners) of the whole texts of ``docs`` by tokenizers file ``path_a`` and sentencepiece model ``path_b``.

    ``pattern`` splits texts before A's merges.

    texts: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each input row. pairs:
    (a, b, n), the links that are not between tokens of the same bytes, with how many texts hold each; partners: (a,
    b, n), those that are. ``n_best`` counts links whose ``n`` is the highest of their A id, ties included; ``count_sum``
    adds up ``n`` over links.

    Texts are encoded once. Counts by id travel as vectors as long as A's vocabulary; pairs are counted where they
    arise before they are shuffled, and meet their counts by bucket: 256 buckets, each of which holds at most a 256th
    of the pairs that two vocabularies have, and several tasks for each where there are more shuffle partitions. A pair
    that every text holds is one entry of each packed row, so no key is hot. Texts that are null, empty or not given
    back by both tokenizers have zeros and an empty digest. Null doc_ids and repeated rows stay; each row counts as a
    text. Extra columns are ignored.
    """
    spark = docs.sparkSession
    parts, bytes_b = encoder_parts(path_a, pattern), bytes_of_pieces(path_b)
    bytes_a = parts[0].tokens
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, (*parts, path_b, bytes_b)))
    path = scratch(spark, "alignment")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_FOUND}"
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), "text")
    numbered.mapInArrow(lambda b: _encode(shared, slice_chars, b), schema).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    found = spark.read.schema(schema).parquet(path)  # rows have got their numbers for good
    packed = found.filter("kind = 'pairs'").select("bucket", "rid", "ids", "times")
    counted = packed.select("ids").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialize(counted, "alignment-pairs")
    evens = found.filter("kind = 'vector'").select("ids", "times").mapInArrow(_vectors, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    even = _vector(evens, "n", len(bytes_a))
    odd = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("n"))
    best = np.maximum(even, _vector(odd, "n", len(bytes_a)))
    vectors = spark.sparkContext.broadcast((even, best))

    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    # the same mix of bits as bucket_of, in lists of bounded length
    rows = counts.mapInArrow(_bucketed, "bucket int, pairs array<long>, ns array<long>")
    rows = rows.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(False).alias("is_texts"), "pairs", "ns")
    asked = packed.select("bucket", (F.abs(F.xxhash64("times")) % salts).cast("int").alias("salt"), F.lit(True).alias("is_texts"), "rid", "ids", "times")
    both = rows.unionByName(asked, allowMissingColumns=True).select("bucket", "salt", "is_texts", "pairs", "ns", "rid", "ids", "times").repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "is_texts")
    odd_links = both.mapInArrow(lambda b: _looked_up(vectors.value[1], b), "rid long, n_best long, count_sum long")
    odd_links = odd_links.groupBy("rid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    texts = found.filter("kind = 'text'").drop("bucket", "kind")
    texts = texts.mapInArrow(lambda b: _evened(*vectors.value, b), schema.split(", ids ")[0] + ", even_best long, even_sum long")
    whole = texts.join(odd_links, "rid", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    whole = whole.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", plus("even_best", "n_best").alias("n_best"), plus("even_sum", "count_sum").alias("count_sum"), "groups_sha256"
    )
    pairs = counts.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(_LOW).cast("int").alias("b"), "n")
    partner = same_bytes(bytes_a, bytes_b)
    partners = spark.createDataFrame([(i, int(partner[i]), int(even[i])) for i in np.flatnonzero(even).tolist()], "a int, b int, n long")
    return whole, pairs, partners


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs, n = batch.column("pair").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False)
        own = bucket_of(pairs)
        order = np.argsort(own, kind="stable")
        bounds = np.searchsorted(own[order], np.arange(BUCKETS + 1))
        some = np.flatnonzero(np.diff(bounds)).tolist()
        cut = lambda x: [x[order[bounds[k] : bounds[k + 1]]] for k in some]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(cut(pairs), pa.list_(pa.int64())), pa.array(cut(n), pa.list_(pa.int64()))], names=["bucket", "pairs", "ns"]
        )
