"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

``write`` deals documents into key ranges by id, sorts each range, encodes it
and writes one shard per range to a folder:

* ``shard-NNNNN.bin``: the token ids of all its documents, little-endian
  unsigned integers of 16 bits where the vocabulary allows it, else 32;
* ``shard-NNNNN.idx``: eight bytes of magic, the width of an id and the number
  n of documents (unsigned 64-bit each), n + 1 offsets into the ids (64-bit),
  n document ids (64-bit) and n bytes that are 0 where the id is null.

A shard's base, the number of ids before it, is the prefix sum of the shards'
sizes; only those sizes reach the driver.  Shards are written under another
name and renamed, and their content depends on their rows only, so a task may
run twice or be run again.  ``read`` maps the files and returns the ids.

Where the tokenizer cuts at white space and between letters and marks
(``WORDWISE``), a block of texts is cut into pieces on its bytes, each distinct
piece is encoded once and remembered by its hash, and the ids of the block are
gathered from theirs; plain Latin words go to the library's model directly.
With any other tokenizer whole texts are encoded.

A null or empty text holds the end id alone; null ids come last; rows that
repeat an id are ordered by a hash of their text; an empty table gives no
shard; extra columns are ignored.  A very long text is a block by itself and
takes some 40 times its bytes while it is encoded.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import exchange, words
from .storage import new_folder

MAGIC = b"WEFTTOK1"
END_ID = 2
#: Bytes of text in a shard, on average.
SHARD_BYTES = 16 << 20
#: Distinct pieces in each of the two generations that a worker remembers (about 40 bytes each).
REMEMBERED = 400_000
#: Pieces that are remembered one by one before they are packed.
LOOSE = 20_000
#: Bytes of text encoded at once.  A worker keeps the pages of its largest block until it ends (some 30 times its
#: bytes), through all later stages; larger blocks are no faster.
BLOCK = 256 << 10

_memory: dict[int, "Encoder"] = {}


#: fixed values: the cutting rule under which words may be encoded one by one
WORDWISE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# kinds of bytes: between words, letters, digits, marks, and what only the tokenizer itself can cut
_BETWEEN, _LETTER, _DIGIT, _MARK, _HARD = range(5)
_KIND = np.full(256, _HARD, np.uint8)
_KIND[33:127] = _MARK
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[words.SEPARATOR] = _BETWEEN
_KIND[ord("'")] = _HARD


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``starts``, one range after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def pieces(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a block of texts, starts, ends and kinds of its pieces, and each text's first piece.

    Words of ASCII and Latin-1 letters, digits and marks are lower-cased and cut
    where the tokenizer cuts them; a word with anything else is one piece.
    """
    raw, off = words.text_buffer(column)
    starts, ends, _ = words.spans(raw, off)
    text, kind = words.LOWER[raw], _KIND[raw]
    if len(raw) > 1:  # letters of the Latin-1 supplement, as UTF-8
        lead = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7))
        kind[lead] = kind[lead + 1] = _LETTER
        text[lead + 1] += np.where(raw[lead + 1] <= 0x9E, 32, 0).astype(np.uint8)
        kind[:-1][(raw[:-1] == 60) & (raw[1:] == 124)] = _HARD  # how special tokens begin
    hard = np.concatenate(([0], np.cumsum(kind == _HARD)))
    whole = hard[ends] > hard[starts]
    at = _ranges(starts[whole], (ends - starts)[whole])
    text[at], kind[at] = raw[at], _HARD
    opens = kind == _DIGIT
    opens[1:] |= kind[1:] != kind[:-1]
    opens &= kind != _BETWEEN
    opens[starts] = True
    closes = np.zeros(len(raw), bool)
    closes[:-1] = opens[1:] & (kind[:-1] != _BETWEEN)
    closes[ends - 1] = True
    s = np.flatnonzero(opens)
    return text, s, np.flatnonzero(closes) + 1, kind[s], np.searchsorted(s, off)


class Packed:
    """Ids of many pieces, by hash, in a few arrays."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, pool: np.ndarray):
        self.sizes, self.pool = sizes.astype(np.int32), pool
        self.begin = (np.cumsum(sizes) - sizes).astype(np.int32)
        self.index = words.Index(keys)

    def __len__(self) -> int:
        return len(self.sizes)

    def with_more(self, more: dict[int, bytes]) -> "Packed":
        values = list(more.values())
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // self.pool.itemsize
        keys = np.fromiter(more, np.uint64, len(more))
        return Packed(np.concatenate((self.index.keys, keys)), np.concatenate((self.sizes, sizes)), np.concatenate((self.pool, np.frombuffer(b"".join(values), self.pool.dtype))))


class Encoder:
    """Ids of texts, where the tokenizer allows it by way of the ids of their pieces."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.loose: dict[int, bytes] = {}
        self.young = self.old = self._nothing()
        rules = json.loads(source)
        cuts = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        lowers = [n.get("type") for n in (rules.get("normalizer") or {}).get("normalizers") or []]
        self.wordwise = cuts[0].get("pattern", {}).get("Regex") == WORDWISE and lowers == ["NFC", "Replace", "Lowercase"] and not rules["post_processor"]
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = (b for b in range(256) if b not in set(printable))
        self.alphabet = {b: b for b in printable} | {b: 256 + k for k, b in enumerate(rest)}

    def _nothing(self) -> Packed:
        return Packed(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, self.dtype))

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _learn(self, hashes: list[int], new: list[bytes], plain: list[bool]) -> None:
        """Remember the ids of ``new`` pieces by their hashes; ``plain`` ones are words of letters.

        What normalisation leaves alone and the cutting rule keeps whole goes to the model itself.
        """
        tokenize = self.tokenizer.model.tokenize
        letters = b" ".join([p for p, simple in zip(new, plain) if simple]).decode("latin-1").translate(self.alphabet).split(chr(self.alphabet[32]))
        ids = [[x.id for x in tokenize(p)] for p in letters if p]
        ends = np.cumsum([0, *map(len, ids)]) * self.dtype.itemsize
        flat = self._bytes([i for x in ids for i in x])
        self.loose.update((h, flat[i:j]) for h, i, j in zip((h for h, simple in zip(hashes, plain) if simple), ends[:-1].tolist(), ends[1:].tolist()))
        rest = {h: p.decode() for h, p, simple in zip(hashes, new, plain) if not simple}
        found = self.tokenizer.encode_batch_fast(list(rest.values()), add_special_tokens=False)
        self.loose.update((h, self._bytes(x.ids)) for h, x in zip(rest, found))

    def _known(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where in it those of each distinct piece begin and how many they are.

        When the young generation is full it takes the old one's place; what of
        the old one is used again becomes young.
        """
        if len(self.loose) > LOOSE:
            if len(self.young) > REMEMBERED:
                self.young, self.old = self._nothing(), self.young
            self.young, self.loose = self.young.with_more(self.loose), {}
        young, old, loose = self.young, self.old, self.loose
        at = young.index.find(hashes)
        hit = at >= 0
        if len(old):
            before = np.where(hit, -1, old.index.find(hashes))
            for k in np.flatnonzero(before >= 0).tolist():
                i = before[k]
                loose[int(hashes[k])] = old.pool[old.begin[i] : old.begin[i] + old.sizes[i]].tobytes()
        others = np.flatnonzero(~hit)
        keys = hashes[others].tolist()
        new = np.array([h not in loose for h in keys], bool)
        k = others[new]
        if len(k):
            self._learn(hashes[k].tolist(), [text[a:b].tobytes() for a, b in zip(starts[k].tolist(), ends[k].tolist())], plain[k].tolist())
        values = [loose[h] for h in keys]
        more = np.fromiter(map(len, values), np.int64, len(values)) // self.dtype.itemsize
        begin, size = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
        begin[hit], size[hit] = young.begin[at[hit]], young.sizes[at[hit]]
        begin[others], size[others] = len(young.pool) + np.cumsum(more) - more, more
        return np.concatenate((young.pool, np.frombuffer(b"".join(values), self.dtype))), begin, size

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another with an end id after each, and each text's number of ids."""
        if not self.wordwise:
            found = self.tokenizer.encode_batch_fast(column.fill_null("").to_pylist(), add_special_tokens=False)
            return np.array([i for x in found for i in (*x.ids, end_id)], self.dtype), np.array([len(x.ids) + 1 for x in found], np.int64)
        text, s, e, kinds, first = pieces(column)
        coded = pa.array(words.word_hashes(text, s, e)).dictionary_encode()
        which, some = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False)
        at = np.empty(len(some), np.int64)
        at[which[::-1]] = np.arange(len(which))[::-1]
        pool, begin, size = self._known(some, s[at], e[at], kinds[at] == _LETTER, text)
        # the end id after each text counts as a piece
        pool, begin, size = np.append(pool, np.array(end_id, self.dtype)), np.append(begin, len(pool)), np.append(size, 1)
        which = np.insert(which, first[1:], len(some))
        own = size[which]
        return pool[_ranges(begin[which], own)], words.totals(own, first + np.arange(len(first)))


def _encoder(source: str) -> Encoder:
    key = zlib.crc32(source.encode())
    if key not in _memory:
        _memory.clear()
        _memory[key] = Encoder(source)
    return _memory[key]


def _at(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def _put(fs: pafs.FileSystem, path: str, chunks: Iterator[bytes]) -> None:
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        for c in chunks:
            out.write(c)
    fs.move(part, path)


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards of ``docs``; a row ``shard, base, n_docs, n_tokens`` for each."""
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())  # a vocabulary file, whatever the corpus
    _, size = exchange.text_bytes(docs, text_col)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("row_key", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("row_key").asc()]
    dealt = text.repartitionByRange(max(1, -(-size // shard_bytes)), *order).sortWithinPartitions(*order)
    out = pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    fs, root = _at(folder)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        coder = _encoder(source.value)
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        fs, root = _at(folder)

        def encoded() -> Iterator[bytes]:
            for b in batches:
                here = b.column(0)
                ids.append(np.stack([here.fill_null(0).to_numpy(zero_copy_only=False), here.is_valid().to_numpy(zero_copy_only=False)]))
                for lo, hi in words.slices(b.column(1), BLOCK):
                    x, n = coder.encode(b.column(1).slice(lo, hi - lo), end_id)
                    sizes.append(n)
                    yield x.tobytes()

        first = next(found := encoded(), None)
        if first is None:
            return
        name = f"{root}/shard-{shard:05d}"
        _put(fs, f"{name}.bin", (c for part in ([first], found) for c in part))
        ids_all = np.concatenate(ids, axis=1)
        n = ids_all.shape[1]
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype("<i8")
        head = MAGIC + np.array([coder.dtype.itemsize, n], "<u8").tobytes()
        _put(fs, f"{name}.idx", iter([head, offsets.tobytes(), ids_all[0].astype("<i8").tobytes(), ids_all[1].astype(np.uint8).tobytes()]))
        yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([int(offsets[-1])], pa.int64())], schema=out)

    made = sorted(tuple(r) for r in dealt.mapInArrow(run, "shard int, n_docs long, n_tokens long").collect())  # a row per shard
    base, rows = 0, []
    for shard, n_docs, n_tokens in made:
        rows.append((shard, base, n_docs, n_tokens))
        base += n_tokens
    _put(fs, f"{root}/manifest.json", iter([json.dumps({"shards": rows, "n_tokens": base, "end_id": end_id}).encode()]))
    # as an Arrow table: rows of a list would pass through Python workers of another kind, which stay beside the encoding ones
    kinds = [("shard", pa.int32()), ("base", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]
    return spark.createDataFrame(pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds)}))


class Shard:
    """A shard's files, mapped where the folder is a local one."""

    def __init__(self, folder: str, shard: int):
        fs, root = _at(folder)
        name = f"{root}/shard-{shard:05d}"
        local = isinstance(fs, pafs.LocalFileSystem)
        self._files = [pa.memory_map(f"{name}.{x}") if local else fs.open_input_file(f"{name}.{x}") for x in ("idx", "bin")]
        head, data = (f.read_buffer() for f in self._files)
        if bytes(head[:8]) != MAGIC:
            raise ValueError(f"{name}.idx is not an index of token files")
        width, n = (int(x) for x in np.frombuffer(head, "<u8", 2, 8))
        self.offsets = np.frombuffer(head, "<i8", n + 1, 24)
        self.doc_ids = np.frombuffer(head, "<i8", n, 24 + 8 * (n + 1))
        self.set = np.frombuffer(head, np.uint8, n, 24 + 8 * (2 * n + 1)) > 0
        self.tokens = np.frombuffer(data, "<u2" if width == 2 else "<u4")

    def __len__(self) -> int:
        return len(self.doc_ids)

    def __getitem__(self, k: int) -> np.ndarray:
        """The ids of the ``k``-th document."""
        return self.tokens[self.offsets[k] : self.offsets[k + 1]]


def read(shards: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files."""
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = Shard(folder, shard)
                crc = np.fromiter((zlib.crc32(s[k].astype("<u4").tobytes()) for k in range(len(s))), np.int64, len(s))
                yield pa.record_batch([pa.array(s.doc_ids, pa.int64(), mask=~s.set), pa.array(base + s.offsets[:-1]), pa.array(np.diff(s.offsets)), pa.array(crc)], schema=out)

    n = max(1, shards.count())
    return shards.select("shard", "base").repartition(n, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode(docs: DataFrame, tokenizer_path: str | None = None, folder: str | None = None, **options) -> DataFrame:
    """Write ``docs`` to a new folder of the shared one (or ``folder``) and read it back."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = str(public_tokenizers.path("word_bpe_49k.json"))
    spark: SparkSession = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    return read(write(docs, folder, tokenizer_path, **options), folder)
