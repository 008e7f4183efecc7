"""Token ids in ORC: stripes of run-length-encoded integers, row indexes and Bloom filters on document ids.

``encode_tokens`` turns whole texts into ids, ``write_store`` writes them in ascending document
order, ``read_store`` reads them back (a lookup by id prunes files, stripes and row groups through
statistics and Bloom filters), ``store_digest`` describes what the files hold.

Defined cases: a null text is empty; an empty text holds only the end id; a very long text is one row of its file; null
document ids sort first; rows with the same id stay, ordered by the hash of their content (equal rows in any order); an
empty table gives an empty store; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalguard.llm.common import in_arrow, kept_in_worker, release_memory, shared_path

END_ID = 0
#: Different pretokens whose ids a worker remembers (about 50 bytes each); when they are full, rarely used ones go.
CACHE_PRETOKENS = 400_000
#: Characters encoded at once.
PART_CHARS = 1 << 18

_U = np.uint64
_MULT = 0xD6E8FEB86659FD93
_LETTER, _NUMBER, _OTHER, _SPACE = 0, 1, 2, 3


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Pretokens:
    """Where byte-level BPE cuts text before its merges, by array operations on code points.

    The cuts are those of the tokenizer's pattern: contractions; runs of letters, numbers or other
    characters, each with one space before it; white space, whose last character stands alone before text.
    """

    def __init__(self) -> None:
        import regex

        every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
        self.kind = np.full(0x110000, _OTHER, np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                self.kind[m.start() : m.end()] = kind
        self.kind[0x1C:0x20] = _OTHER  # separators that are no white space for the tokenizer
        self.up, self.down = _powers(_MULT, 1 << 16), _powers(pow(_MULT, -1, 1 << 64), 1 << 16)

    def cuts(self, points: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Starts of the pretokens of joined texts; ``texts`` has the starts of non-empty texts and the end."""
        n = len(points)
        kind = self.kind[points]
        edge = np.zeros(n + 1, bool)
        edge[texts] = True
        start = np.empty(n, bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= edge[:n]
        space = kind == _SPACE
        run = np.flatnonzero(start)  # runs of one kind
        last = np.append(run[1:], n) - 1  # their last characters
        white = space[run] & ~edge[last + 1]  # runs of white space with text after them
        ends = last[white]
        start[ends] = True
        start[ends[points[ends] == 32] + 1] = False
        quotes = run[(points[run] == 39) & (last == run)]
        quotes = quotes[~edge[quotes + 1]]
        if len(quotes):
            before = np.where(quotes > 0, points[quotes - 1], 0)
            quotes = quotes[(before != 32) | edge[quotes]]
            one = points[np.minimum(quotes + 1, n - 1)]
            two = np.where(edge[np.minimum(quotes + 2, n)], 0, points[np.minimum(quotes + 2, n - 1)])
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
            for at, size in ((quotes[short], 2), (quotes[long & ~short], 3)):
                start[at + 1] = False
                after = at + size
                start[after[after < n]] = True
        return np.flatnonzero(start)

    def hashes(self, points: np.ndarray, cut: np.ndarray) -> np.ndarray:
        n = len(points)
        if n + 1 > len(self.up):
            self.up, self.down = _powers(_MULT, n + n // 8), _powers(pow(_MULT, -1, 1 << 64), n + n // 8)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + _U(1)) * self.up[:n], out=total[1:])
        h = (total[np.append(cut[1:], n)] - total[cut]) * self.down[cut]
        h ^= h >> _U(32)
        h *= _U(_MULT)
        return (h ^ (h >> _U(29))) | _U(1 << 63)  # never 0


class HashTable:
    """Open addressing from 64-bit hashes to small integers, by array operations."""

    def __init__(self, room: int) -> None:
        self.mask = (1 << max(4, (room - 1).bit_length())) - 1
        self.keys = np.zeros(self.mask + 1, np.uint64)  # 0: free
        self.values = np.zeros(self.mask + 1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The value of each hash, -1 where there is none."""
        out = np.full(len(h), -1, np.int64)
        slot = (h & _U(self.mask)).astype(np.int64)
        key = self.keys[slot]
        hit = key == h
        out[hit] = self.values[slot[hit]]
        left = np.flatnonzero(~hit & (key != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            key = self.keys[slot[left]]
            hit = key == h[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (key != 0)]
        return out

    def clear(self) -> None:
        self.keys[:] = 0

    def put(self, h: np.ndarray, values: np.ndarray) -> None:
        """Add distinct hashes that aren't there."""
        slot = (h & _U(self.mask)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = h[free]  # of several for one slot, one stays
            self.values[slot[free]] = values[free]
            left = left[self.keys[slot[left]] != h[left]]
            slot[left] = (slot[left] + 1) & self.mask


def _byte_characters() -> np.ndarray:
    """The character that byte-level BPE writes for each byte: printable Latin-1 ones stand for themselves, the others follow from U+0100 on."""
    kept = np.zeros(256, bool)
    kept[33:127] = kept[161:173] = kept[174:256] = True
    out = np.arange(256, dtype=np.uint32)
    out[~kept] = 256 + np.arange(256 - kept.sum())
    return out


class CachedEncoder:
    """Ids of whole texts, exactly those of the tokenizer, through a bounded cache of its pretokens.

    Merges never cross a pretoken, so a text's ids are its pretokens' ids in a row. A pretoken is
    known by a 64-bit hash of its characters; unknown ones go through the library's own BPE model. When the
    cache is full, pretokens that were not used again since the last time go, and of the others at most the
    more frequent half of the room stays. A text with an added token is encoded as a whole.
    """

    def __init__(self, path: str, cache: int = CACHE_PRETOKENS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        plan = json.loads(self.tokenizer.to_str())
        pre = plan.get("pre_tokenizer") or {}
        if plan["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or plan.get("normalizer"):
            raise ValueError(f"{path} is no byte-level BPE without normalizer")
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)").search
        self.model, self.character = self.tokenizer.model, _byte_characters()
        self.pretokens = Pretokens()
        self.cache = cache
        # ids of all known pretokens in a row and where each begins, in arrays with room to grow
        self.starts = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.int32)
        self.hashes, self.uses = np.zeros(cache, np.uint64), np.zeros(cache, np.int64)
        self.pieces, self.used = 0, 0
        self.table = HashTable(2 * cache)

    def _append(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Ids of new pretokens behind those of the known ones; they stay if ``pieces`` and ``used`` move on."""
        for name, least in (("starts", self.pieces + len(sizes) + 1), ("flat", self.used + len(ids))):
            have = getattr(self, name)
            if least > len(have):
                more = np.zeros(max(least, len(have) * 3 // 2), have.dtype)
                more[: len(have)] = have
                setattr(self, name, more)
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[self.pieces + 1 : self.pieces + 1 + len(sizes)] = self.starts[self.pieces] + np.cumsum(sizes)

    def _make_room(self) -> None:
        """Forget pretokens that were used only once since the last time, and the rarer ones beyond half of the room."""
        uses = self.uses[: self.pieces]
        stay = np.flatnonzero(uses > 1)
        if len(stay) > self.cache // 2:
            stay = np.sort(stay[np.argsort(-uses[stay], kind="stable")[: self.cache // 2]])
        size = np.diff(self.starts[: self.pieces + 1])[stay]
        total = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat(self.starts[stay] - total[:-1], size) + np.arange(total[-1])
        self.flat[: total[-1]] = self.flat[where]
        self.starts[: len(stay) + 1] = total
        self.hashes[: len(stay)] = self.hashes[stay]
        self.uses[: len(stay)] = uses[stay] // 2
        self.pieces, self.used = len(stay), int(total[-1])
        self.table.clear()
        self.table.put(self.hashes[: self.pieces], np.arange(self.pieces))

    def _tokens(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single pretokens: their bytes' characters through the BPE model."""
        size = end - begin
        where = np.repeat(begin - (np.cumsum(size) - size), size)
        where += np.arange(len(where))
        chosen = points[where]
        written = self.character[np.frombuffer(chosen.tobytes().decode("utf-32-le").encode(), np.uint8)].tobytes().decode("utf-32-le")
        widths = np.concatenate([[0], np.cumsum(1 + (chosen > 0x7F) + (chosen > 0x7FF) + (chosen > 0xFFFF))])
        at = widths[np.concatenate([[0], np.cumsum(size)])].tolist()
        tokenize = self.model.tokenize
        found = [[t.id for t in tokenize(written[a:b])] for a, b in zip(at[:-1], at[1:], strict=True)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))

    def _ids(self, points: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pretokens in a row, and how many each has."""
        h = self.pretokens.hashes(points, cut)
        code = self.table.find(h)
        missing = np.flatnonzero(code < 0)
        if len(missing):
            uniq, first, inverse = np.unique(h[missing], return_index=True, return_inverse=True)
            if self.pieces + len(uniq) > self.cache >= len(uniq):
                self._make_room()
                code = self.table.find(h)
                missing = np.flatnonzero(code < 0)
                uniq, first, inverse = np.unique(h[missing], return_index=True, return_inverse=True)
            first = missing[first]
            sizes, ids = self._tokens(points, cut[first], np.append(cut[1:], len(points))[first])
            self._append(sizes, ids)
            code[missing] = self.pieces + inverse
            if self.pieces + len(uniq) <= self.cache:
                self.table.put(uniq, self.pieces + np.arange(len(uniq)))
                self.hashes[self.pieces : self.pieces + len(uniq)] = uniq
                self.uses[self.pieces : self.pieces + len(uniq)] = 0
                self.pieces, self.used = self.pieces + len(uniq), self.used + len(ids)
        known = code[code < self.pieces]
        self.uses[: self.pieces] += np.bincount(known, minlength=self.pieces)
        starts, flat = self.starts, self.flat
        size = starts[code + 1] - starts[code]
        where = np.repeat(starts[code] - (np.cumsum(size) - size), size)
        where += np.arange(len(where))
        return flat[where], size

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text closed by the end id, and the offsets of the texts."""
        whole = {i: self.tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts) if self.added(t)}
        kept = ["" if i in whole else t for i, t in enumerate(texts)]
        joined = "".join(kept)
        sizes = np.zeros(len(texts), np.int64)
        ids = np.zeros(0, np.int32)
        if joined:
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, kept), np.int64, len(kept)))])
            cut = self.pretokens.cuts(points, offsets)
            ids, size = self._ids(points, cut)
            total = np.concatenate([[0], np.cumsum(size)])
            sizes = np.diff(total[np.searchsorted(cut, offsets)])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        if whole:
            parts = [np.array(whole[i], np.int32) if i in whole else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        out = np.full(len(ids) + len(texts), END_ID, np.int32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), np.diff(bounds))] = ids
        return out, bounds + np.arange(len(texts) + 1)


_KEEP = "token_store"


def _encoder(path: str, cache: int) -> CachedEncoder:
    """One encoder for each worker process, kept between the tasks of this operator."""
    mine = kept_in_worker.setdefault(_KEEP, {})
    if (path, cache) not in mine:
        mine[path, cache] = CachedEncoder(path, cache)
    return mine[path, cache]


def encode_tokens(docs: DataFrame, tokenizer_path: str, cache: int = CACHE_PRETOKENS) -> DataFrame:
    """(doc_id, token_ids, row) of every whole text, in the order of the rows of each partition, which ``row`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = _encoder(tokenizer_path, cache), 0
        for batch in batches:
            at = 0
            texts = batch.column(1)
            while at < batch.num_rows:
                to, size = at, 0
                part: list[str] = []
                while to < batch.num_rows and size < PART_CHARS:
                    part.append(texts[to].as_py() or "")
                    size += len(part[-1])
                    to += 1
                ids, offsets = encoder.encode(part)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), lists, pa.array(np.arange(row, row + to - at))], ["doc_id", "token_ids", "row"])
                row += to - at
                at = to
            release_memory()

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, token_ids array<int>, row long", keep=_KEEP)


#: UTF-8 bytes of text in a file of a store, more or less.
FILE_BYTES = 64 << 20


def in_doc_order(docs: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Range-partitioned and sorted by document id; rows of one id are ordered and dealt out by content, so one hot id fills many partitions.

    There are as many partitions as the session's shuffles have (small ones are put together at run time), or more
    if they would hold over ``file_bytes`` of text each.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    least = -(-(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // file_bytes)
    many = least > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartitionByRange(least, "doc_id", "th") if many else rows.repartitionByRange("doc_id", "th")).sortWithinPartitions("doc_id", "th")


def write_store(docs: DataFrame, path: str, tokenizer_path: str, stripe_bytes: int = 64 << 20, row_index_stride: int = 10_000) -> None:
    """Write the ids of all documents as ORC files in ascending document order.

    ORC holds integer columns as run-length and bit-packed runs; each stripe has a row index (min and
    max of every ``row_index_stride`` rows) and a Bloom filter on ``doc_id``. ``part`` numbers the files, ``row`` the rows of a file.
    """
    tokens = encode_tokens(in_doc_order(docs), tokenizer_path).withColumn("n_tokens", F.size("token_ids")).withColumn("part", F.spark_partition_id())
    (
        tokens.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true")
        .option("orc.row.index.stride", str(row_index_stride)).option("orc.stripe.size", str(stripe_bytes)).option("orc.encoding.strategy", "COMPRESSION").option("compression", "zstd").orc(path)
    )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Stripe-parallel scan of a store; filters on ``doc_id`` reach the ORC reader."""
    return spark.read.schema("doc_id long, token_ids array<int>, row long, n_tokens int, part int").orc(path)


def store_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files; ``start`` is the place of its first id in them, as they follow each other.

    It is a two-level prefix sum: totals by file (small: one row a file), then a running sum in
    each file. Files hold ranges of bounded size, so no task sees more than one range.
    """
    crc = crc_of(read_store(spark, path))
    totals = read_store(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select(F.col("part"), (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    inner = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return crc.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(before, "part").select(
        "doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32"
    )


def crc_of(store: DataFrame) -> DataFrame:
    """(doc_id, part, row, n_tokens, ids_crc32): unsigned CRC-32 of the ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<i4")
            offsets = lists.offsets.to_numpy()
            view = memoryview(values).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "part", "row", "n_tokens", "ids_crc32"])

    return in_arrow(store.select("doc_id", "part", "row", "token_ids"), run, "doc_id long, part int, row long, n_tokens long, ids_crc32 long")


def token_store(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the store into the shared folder and return its digest, read from the files."""
    path = shared_path(spark, "token-store")
    write_store(docs, path, tokenizer_path)
    return store_digest(spark, path)
