"""Byte-level BPE: encoding, decoding and token counts by a two-tier lookup of pre-tokens."""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

#: Texts up to this many characters are split at once; longer ones as a stream of matches.
AT_ONCE = 1 << 20
#: Pre-tokens in each of the two generations that a worker remembers.
CACHE = 400_000
_SHIFT = 32
_WORD = (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace: n keys, n slots, each key checked on lookup."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, n // 4)
        hashes = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, n)
        self.shift = np.zeros(self.buckets, np.int64)
        at = np.full(n, -1, np.int64)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        tries = np.arange(1, 1025, dtype=np.uint64)[:, None]
        for b in np.argsort(-np.diff(bounds), kind="stable").tolist():
            own = order[bounds[b] : bounds[b + 1]]
            if len(own) < 2:
                break
            base = 0
            while True:
                slots = self._slots(hashes[own][None, :], tries + np.uint64(base))
                fits = (at[slots] < 0).all(axis=1)
                if len(own) > 1:
                    ranked = np.sort(slots, axis=1)
                    fits &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if fits.any():
                    first = int(np.argmax(fits))
                    self.shift[b] = base + first + 1
                    at[slots[first]] = own
                    break
                base += len(tries)
        free = iter(np.flatnonzero(at < 0).tolist())
        for b in np.flatnonzero(np.diff(bounds) == 1).tolist():  # a lone key names its slot outright
            slot = next(free)
            self.shift[b] = -slot - 1
            at[slot] = order[bounds[b]]
        self.at = at
        self.keys = [keys[i] for i in at.tolist()]
        self._plain()

    def _slots(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (hashes ^ (shift * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((mixed >> np.uint64(32)) % np.uint64(max(1, self.n))).astype(np.int64)

    def _plain(self) -> None:
        self._shift, self._at = self.shift.tolist(), self.at.tolist()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_shift", "_at")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._plain()

    def find(self, key: bytes) -> int:
        """The position of ``key`` in the list of keys, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(key)
        s = self._shift[h % self.buckets]
        if s < 0:
            slot = -s - 1
        else:
            slot = ((((h ^ (s * 0x9E3779B97F4A7C15 & _WORD)) * 0xBF58476D1CE4E5B9) & _WORD) >> 32) % self.n
        return self._at[slot] if self.keys[slot] == key else -1


def merge(ids: list[int], pairs: dict[int, int], made: list[int]) -> list[int]:
    """BPE of one pre-token: a heap over linked symbols; the lowest rank merges first, the leftmost of equals.

    ``pairs``: left id << 32 | right id to rank; ``made``: rank to the id of the merged token. ``rank`` holds the rank
    of the pair that begins at each symbol now, so an entry of the heap that is out of date shows by its rank.
    """
    n = len(ids)
    get, pop, push = pairs.get, heapq.heappop, heapq.heappush
    rank = [get(a << _SHIFT | b, -1) for a, b in zip(ids, ids[1:])]
    rank.append(-1)
    heap = [r << _SHIFT | i for i, r in enumerate(rank) if r >= 0]
    if not heap:
        return ids
    heapq.heapify(heap)
    nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        top = pop(heap)
        i = top & 0xFFFFFFFF
        r = top >> _SHIFT
        if rank[i] != r:
            continue
        j = nxt[i]
        ids[i] = new = made[r]
        ids[j] = rank[j] = -1
        k = nxt[i] = nxt[j]
        if k < n:
            prev[k] = i
            rank[i] = r = get(new << _SHIFT | ids[k], -1)
            if r >= 0:
                push(heap, r << _SHIFT | i)
        else:
            rank[i] = -1
        h = prev[i]
        if h >= 0:
            rank[h] = r = get(ids[h] << _SHIFT | new, -1)
            if r >= 0:
                push(heap, r << _SHIFT | h)
    return [x for x in ids if x >= 0]


class Vocabulary:
    """Tokens by id, the ids of single bytes and the merges, from a rank file or a tokenizers file."""

    def __init__(self, tokens: list[bytes], pairs: dict[int, int], made: list[int]):
        self.tokens, self.pairs, self.made = tokens, pairs, made
        own = {t: i for i, t in enumerate(tokens) if len(t) == 1}
        self.byte_ids = [own[bytes([b])] for b in range(256)]

    @classmethod
    def from_ranks(cls, path: str) -> Vocabulary:
        """A rank file: any two tokens whose concatenation is a token merge, at that token's rank."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = [b""] * (max(ranks.values()) + 1)
        pairs = {}
        for t, r in ranks.items():
            tokens[r] = t
            for cut in range(1, len(t)):
                a, b = ranks.get(t[:cut]), ranks.get(t[cut:])
                if a is not None and b is not None:
                    pairs[a << _SHIFT | b] = r
        return cls(tokens, pairs, list(range(len(tokens))))

    @classmethod
    def from_json(cls, path: str) -> Vocabulary:
        """A byte-level BPE file of the tokenizers library: only the listed merges count, in their order."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        # Printable bytes stand for themselves; the others for the code points from 256 on, in order.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocab = model["vocab"]
        tokens = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            if all(c in byte_of for c in t):
                tokens[i] = bytes(byte_of[c] for c in t)
        pairs, made = {}, []
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pairs[vocab[a] << _SHIFT | vocab[b]] = rank
            made.append(vocab[a + b])
        return cls(tokens, pairs, made)

    def encode_piece(self, piece: bytes) -> list[int]:
        return merge(list(map(self.byte_ids.__getitem__, piece)), self.pairs, self.made)


class _Cache(dict):
    """What a worker remembers of pre-tokens, in two generations: a full one becomes the old one, and what is asked
    for again moves back to the young, so that frequent pre-tokens stay and memory is bounded."""

    def __init__(self, vocabulary: Vocabulary, table: PerfectHash, values):
        self.vocabulary, self.table, self.values_of, self.old = vocabulary, table, values, {}

    def __missing__(self, piece: str):
        got = self.old.get(piece)
        if got is None:
            raw = piece.encode("utf-8", "surrogatepass")
            found = self.table.find(raw)
            got = self.known(self.values_of[found]) if found >= 0 else self.encoded(self.vocabulary.encode_piece(raw))
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[piece] = got
        return got


class _Ids(_Cache):
    """Pre-token to its ids, joined by commas: the perfect hash for whole tokens, the heap for the rest."""

    known = staticmethod(str)

    @staticmethod
    def encoded(ids: list[int]) -> str:
        return ",".join(map(str, ids))


class _Lengths(_Cache):
    """Pre-token to its number of tokens: the broadcast table of frequent ones, the heap for the rest."""

    known = staticmethod(int)
    encoded = staticmethod(len)


def _ranges(chars: Iterable[str]) -> list[tuple[str, str]]:
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [(chr(a), chr(b)) for a, b in out]


#: The character classes of the pre-token pattern.
CLASSES = (r"\p{L}", r"\p{N}", r"\s")


def tiktoken_class(name: str, chars: str) -> set[str]:
    """Those of ``chars`` that tiktoken's own pattern engine puts into a class: it drops what a pattern does not match."""
    import tiktoken

    single = tiktoken.Encoding("bytes", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return set(single.decode(single.encode_ordinary(chars)))


def tokenizers_class(name: str, chars: str) -> set[str]:
    """The same by the pattern engine of the tokenizers library."""
    from tokenizers import Regex, normalizers

    negated = name.replace("p", "P").replace("s", "S")
    return set(normalizers.Replace(Regex(negated), "").normalize_str(chars))


@lru_cache
def splitter(pattern: str, members: Callable[[str, str], set[str]]) -> tuple[str, str, str]:
    """(pattern, exact pattern, pattern of the code points from which on the exact one is needed).

    The engine used here may know other Unicode versions than the library to agree with. ``members`` asks the library
    for its classes, all code points at once; the exact pattern takes out, or puts in, what differs. Texts below the
    first code point that differs take the plain pattern.
    """
    chars = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    exact, first = pattern, 0x110000
    for name in CLASSES:
        here, there = set(regex.findall(name, chars)), members(name, chars)
        text = lambda found: "".join(f"{regex.escape(a)}-{regex.escape(b)}" for a, b in _ranges(found))
        own = name
        if here - there:
            own = f"[{own}--[{text(here - there)}]]"
        if there - here:
            own = f"[{own}||[{text(there - here)}]]"
        exact = exact.replace(name, own)
        first = min([first, *map(ord, here ^ there)])
    # what stands for the complement of a class is not in the pattern, so the three replacements suffice
    return pattern, "(?V1)" + exact, f"[{re.escape(chr(first))}-\U0010ffff]" if first < 0x110000 else "(?!)"


class Splitter:
    """The pre-tokens of texts, as the library splits them, in lists of bounded size."""

    def __init__(self, plain: str, exact: str, high: str):
        self.plain, self.exact, self.high = regex.compile(plain), regex.compile(exact), re.compile(high)

    def __call__(self, text: str) -> Iterator[list[str]]:
        pattern = self.exact if not text.isascii() and self.high.search(text) else self.plain
        if len(text) <= AT_ONCE:
            yield pattern.findall(text)
            return
        found = (m.group() for m in pattern.finditer(text))
        while part := list(islice(found, 1 << 16)):
            yield part


def _worker(shared, make):
    """``make(*parts)`` of a broadcast (name, parts), made once in a worker process. It hangs on the broadcast, so that both
    go when the worker gets a task without it: what one stage needed takes no memory from the next."""
    if not hasattr(shared, "_made"):
        shared._made = make(*shared.value[1])
    return shared._made


class Codec:
    """Encoder and decoder over one vocabulary; also usable without Spark."""

    def __init__(self, vocabulary: Vocabulary, whole: PerfectHash, ids: list[int], split: tuple[str, str, str]):
        self.cache = _Ids(vocabulary, whole, ids)
        self.pieces = Splitter(*split)
        self.bytes_of = {str(i): t for i, t in enumerate(vocabulary.tokens)}

    def encode(self, text: str) -> Iterator[str]:
        """Ids joined by commas, in parts that are not empty."""
        get = self.cache.__getitem__
        for part in self.pieces(text):
            if part:
                yield ",".join(map(get, part))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(",")))

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of tokens, SHA-256 of the ids, SHA-256 of what they decode to)."""
        n, coded, plain = 0, hashlib.sha256(), hashlib.sha256()
        for part in self.encode(text):
            coded.update((b"," if n else b"") + part.encode())
            plain.update(self.decode(part))
            n += part.count(",") + 1
        return n, coded.hexdigest(), plain.hexdigest()


def whole_tokens(vocabulary: Vocabulary) -> tuple[PerfectHash, list[int]]:
    ids = [i for i, t in enumerate(vocabulary.tokens) if t]
    return PerfectHash([vocabulary.tokens[i] for i in ids]), ids


def codec(path: str, pattern: str) -> Codec:
    return Codec(*codec_parts(path, pattern))


def codec_parts(path: str, pattern: str) -> tuple:
    vocabulary = Vocabulary.from_ranks(path)
    return vocabulary, *whole_tokens(vocabulary), splitter(pattern, tiktoken_class)


def _share(docs: DataFrame, *parts):
    return docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, parts))


def _texts(batch: pa.RecordBatch) -> Iterable[str]:
    return (x.as_py() or "" for x in batch.column("text"))


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode every text: (doc_id, n_tokens, ids_sha256, decoded_sha256), a row for each input row.

    Tier one is a minimal perfect hash from whole pre-tokens in the vocabulary to their ids; tier two merges the
    bytes of the others by a heap over a linked list. Both travel in one broadcast whose size is the vocabulary's
    (about 50,000 entries), whatever the corpus. Null texts count as empty (no ids; digests of nothing); null doc_ids
    and repeated rows stay; texts over a million characters are split as a stream; extra columns are ignored.
    """
    shared = _share(docs, *codec_parts(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _worker(shared, Codec)
        for batch in batches:
            rows = [codec.digest(t) for t in _texts(batch)]
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def encode_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns of ``docs`` but any ``token_ids``, and ``token_ids array<int>`` of each whole text."""
    shared = _share(docs, *codec_parts(path, pattern))
    docs = docs.drop("token_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _worker(shared, Codec)
        for batch in batches:
            ids = [[int(i) for part in codec.encode(t) for i in part.split(",")] for t in _texts(batch)]
            yield batch.append_column("token_ids", pa.array(ids, pa.list_(pa.int32())))

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(run, schema)


def decode_ids(coded: DataFrame, path: str) -> DataFrame:
    """All columns but any ``decoded``, and ``decoded binary``: the bytes that ``token_ids`` stand for."""
    shared = _share(coded, Vocabulary.from_ranks(path).tokens)
    coded = coded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value[1][0]
        for batch in batches:
            raw = [b"".join(tokens[i] for i in ids.as_py() or ()) for ids in batch.column("token_ids")]
            yield batch.append_column("decoded", pa.array(raw, pa.binary()))

    from pyspark.sql import types as T

    return coded.mapInArrow(run, T.StructType([*coded.schema.fields, T.StructField("decoded", T.BinaryType())]))


class Counter:
    """Token counts of texts; also usable without Spark."""

    def __init__(self, vocabulary: Vocabulary, frequent: PerfectHash, lengths: bytes, split: tuple[str, str, str], specials: list[str]):
        self.cache = _Lengths(vocabulary, frequent, lengths)
        self.pieces = Splitter(*split)
        # the longest of the added tokens that begin at a place wins
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None

    def count(self, text: str) -> int:
        get = self.cache.__getitem__
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(sum(map(get, part)) for own in parts for part in self.pieces(own))


def added_tokens(path: str) -> list[str]:
    """The strings that a tokenizers file takes for one token wherever they stand in a text."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens") or []
    odd = [t["content"] for t in added if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")]
    if odd:
        raise ValueError(f"added tokens that take white space, whole words or normalised text are not supported: {odd}")
    return [t["content"] for t in added]


def counter_parts(path: str, pattern: str) -> tuple:
    """The vocabulary, the table of frequent pre-tokens' lengths, the pre-token patterns and the added tokens.

    Merges were learned from what is frequent in text, so the frequent pre-tokens are those the vocabulary has whole;
    each one's length is computed by the merges themselves.
    """
    vocabulary = Vocabulary.from_json(path)
    split = splitter(pattern, tokenizers_class)
    exact = regex.compile(split[1])
    keys, lengths = [], []
    for t in vocabulary.tokens:
        try:
            word = t.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if t and exact.fullmatch(word):
            keys.append(t), lengths.append(len(vocabulary.encode_piece(t)))
    return vocabulary, PerfectHash(keys), bytes(lengths), split, added_tokens(path)


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 1024) -> DataFrame:
    """Token counts of every whole text: (doc_id, n_bytes, n_tokens, over_limit), a row for each input row.

    Map side only: frequent pre-tokens' lengths come from a broadcast compact hash table (bounded by the vocabulary),
    others are encoded once and kept in a bounded cache of the worker process; no pre-token is shuffled. The file's added
    tokens count as one each wherever they stand in a text. Null texts count as empty; null doc_ids and repeated rows
    stay; extra columns are ignored.
    """
    shared = _share(docs, *counter_parts(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _worker(shared, Counter)
        for batch in batches:
            n = pa.array([counter.count(t) for t in _texts(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], names=["doc_id", "n_bytes", "n_tokens"])

    from pyspark.sql import functions as F

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = read.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
