"""Token ids in binary shards by bit-plane shuffling.

A shard holds the ids of a run of documents, in ascending order of their ids or in the order that
other columns of the table give. Blocks of a fixed number of
ids are transposed into byte or bit planes, each plane is compressed with zstandard, and a
chunk index in the footer gives every block's place, so any id can be read by one seek.

Shard layout (little-endian): magic; the planes of all blocks; the zstandard-compressed
document table (valid byte, int64 id, uint64 ids in the document; columns one after the
other); the chunk index, per block uint64 place, uint32 ids, then uint32 bytes of each plane;
the tail (uint64 place and bytes of the table, uint64 place of the index, uint64 documents,
uint64 ids, uint32 blocks, uint32 block size, uint32 planes); magic.

Plan: one shuffle of the texts by range of that order, then every task encodes its run and
streams it to one file: memory holds a chunk of texts, its ids, and a block of ids. The file appears
under its name by a rename, so a repeated or speculative task leaves one whole shard.

Defined results: a null text is empty and has the end id alone. Ids are cast to long; null ids
come first. Rows of
one id are ordered by a hash of the text; equal rows each have an entry. An empty table gives
no shard with documents and no rows. Columns of an order come before the id, nulls first; others
are not looked at.
"""

from __future__ import annotations

import io
import struct
import sys
import types
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlume.llm.shared import new_folder, short_batches

MAGIC = b"LLPLANE1"
TAIL = "<5Q3I"
#: Pieces of a generation whose ids a worker remembers, and what their texts and ids may take.
REMEMBERED = 200_000
REMEMBERED_BYTES = 20 << 20
#: A longer piece is text without spaces; it does not come again and is not remembered.
LONG_PIECE = 48
#: Texts of which the different pieces are told apart together.
CHUNK_BYTES = 4 << 20


def planes_of(ids: np.ndarray, bits: bool) -> list[bytes]:
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        return [np.packbits(x).tobytes() for x in np.unpackbits(rows, axis=1, bitorder="little").T]
    return [np.ascontiguousarray(x).tobytes() for x in rows.T]


def ids_of(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 32:
        rows = np.stack([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x in planes], axis=1)
        return np.packbits(rows, axis=1, bitorder="little").reshape(-1).view("<u4")
    return np.stack([np.frombuffer(x, np.uint8) for x in planes], axis=1).reshape(-1).view("<u4")


class ShardWriter:
    def __init__(self, sink, block_ids: int, bits: bool, level: int = 3) -> None:
        self.sink, self.block_ids, self.bits = sink, block_ids, bits
        self.press = zstandard.ZstdCompressor(level=level)
        self.at, self.index, self.waiting, self.n_waiting, self.n_ids = 0, [], [], 0, 0
        self.valid, self.names, self.lengths = bytearray(), [], []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, name: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers of one document."""
        self.valid.append(name is not None)
        self.names.append(name or 0)
        self.lengths.append(len(ids) // 4)
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        self.n_ids += len(ids) // 4
        if self.n_waiting >= self.block_ids:
            joined = np.frombuffer(b"".join(self.waiting), "<u4")
            whole = len(joined) // self.block_ids * self.block_ids
            for i in range(0, whole, self.block_ids):
                self._block(joined[i : i + self.block_ids])
            self.waiting, self.n_waiting = [joined[whole:].tobytes()], len(joined) - whole

    def _block(self, ids: np.ndarray) -> None:
        place, pressed = self.at, [self.press.compress(x) for x in planes_of(ids, self.bits)]
        for x in pressed:
            self._put(x)
        self.index.append(struct.pack(f"<QI{len(pressed)}I", place, len(ids), *map(len, pressed)))

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.frombuffer(b"".join(self.waiting), "<u4"))
        table, place = self.press.compress(bytes(self.valid) + np.array(self.names, "<i8").tobytes() + np.array(self.lengths, "<u8").tobytes()), self.at
        self._put(table)
        index_at = self.at
        self._put(b"".join(self.index))
        self._put(struct.pack(TAIL, place, len(table), index_at, len(self.names), self.n_ids, len(self.index), self.block_ids, 32 if self.bits else 4))
        self._put(MAGIC)


class ShardReader:
    def __init__(self, source) -> None:
        self.source = source
        source.seek(0, 2)
        end = source.tell() - struct.calcsize(TAIL) - len(MAGIC)
        source.seek(end)
        tail = source.read(struct.calcsize(TAIL) + len(MAGIC))
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a whole shard")
        place, size, index_at, self.n_docs, self.n_ids, self.n_blocks, self.block_ids, self.n_planes = struct.unpack(TAIL, tail[: struct.calcsize(TAIL)])
        source.seek(index_at)
        row = struct.Struct(f"<QI{self.n_planes}I")
        self.index = [row.unpack(x) for x in (source.read(row.size) for _ in range(self.n_blocks))]
        source.seek(place)
        table = zstandard.ZstdDecompressor().decompress(source.read(size), max_output_size=17 * self.n_docs + 1) if self.n_docs else b""
        n = self.n_docs
        valid, names = table[:n], np.frombuffer(table[n : 9 * n], "<i8").tolist()
        self.names = [x if v else None for v, x in zip(valid, names, strict=True)]
        self.lengths = np.frombuffer(table[9 * n : 17 * n], "<u8").astype(np.int64)

    def block(self, k: int) -> np.ndarray:
        place, n, *sizes = self.index[k]
        self.source.seek(place)
        opened = zstandard.ZstdDecompressor()
        most = 4 * self.block_ids + 64
        return ids_of([opened.decompress(self.source.read(s), max_output_size=most) for s in sizes], n)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the shard, by the chunk index."""
        if end <= start:
            return np.zeros(0, "<u4")
        lo, hi = start // self.block_ids, (end - 1) // self.block_ids
        joined = np.concatenate([self.block(k) for k in range(lo, hi + 1)])
        return joined[start - lo * self.block_ids : end - lo * self.block_ids]

    def documents(self) -> Iterator[tuple[int | None, int, list[np.ndarray] | Iterator[np.ndarray]]]:
        """(id, number of ids, pieces) in order; a long document comes in several pieces."""
        k, rest = 0, np.zeros(0, "<u4")
        for name, n in zip(self.names, self.lengths.tolist(), strict=True):
            pieces, need = [], n
            while need:
                if not len(rest):
                    rest, k = self.block(k), k + 1
                pieces.append(rest[:need])
                rest, need = rest[need:], need - len(pieces[-1])
            yield name, n, pieces


def byte_letters() -> dict[int, str]:
    """The characters by which byte-level models spell bytes: printable ones as they are, the
    others in order from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in set(kept)]
    return {x: chr(x) for x in kept} | {x: chr(256 + i) for i, x in enumerate(rest)}


class Encoder:
    """Texts to ids as bytes, the end id appended.

    Neither the normaliser nor the splitter of the tokenizers this is meant for looks across a
    space or line feed, and both drop them, so a text's ids are those of its pieces, one after
    the other. The pieces of many texts are told apart at once in Arrow, and each different one
    is encoded once: plain letters (and a full stop or comma after them) go to the tokenizer's
    model in lower case, which is all the other steps do to them; the rest are encoded
    together, a mark of their own between them. What was met before is remembered in two
    generations of bounded bytes, so that the frequent stays; long pieces are not remembered.
    Probes confirm that the tokenizer is of this kind; if it isn't, whole texts are encoded.
    """

    MARK = "\x01"
    #: Letters below U+0130 have one lower-case letter and no other composed form.
    PLAIN = r"^[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}]+[.,]?$"

    def __init__(self, path: str, end_id: int | None) -> None:
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.model = self.tool.model
        self.close = b"" if end_id is None else struct.pack("<I", end_id)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.spelt = str.maketrans(byte_letters())
        own = self._ids(self.MARK)
        self.mark = int(own[0]) if len(own) == 1 else None
        self.stops = {x: self._ids(x).tobytes() for x in ".,"}
        words = ("hello", "UNFORESEEABLE", "Été", "Straße", "ÑANDÚ", "ĀĒ", "q", "ªº")
        self.modelled = all(self._ids(x + y).tobytes() == self._letters(x.lower()) + z for x in words for y, z in (("", b""), *self.stops.items()))
        probe = ["It's", "", "10", "o'clock,", "", "", "Été", "<|endoftext|>", "x\u0301", "!?\t", "a", "'S", ""]
        whole = self._ids(" ".join(probe).replace("  ", " \n")).tobytes()
        self.by_piece = self.mark is not None and whole == b"".join(self._ids(x).tobytes() for x in probe) == b"".join(self._together(probe))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tool.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _letters(self, stem: str) -> bytes:
        """Ids of a stem of plain letters in lower case."""
        spelt = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.spelt)
        ids = array("I", [x.id for x in self.model.tokenize(spelt)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _together(self, pieces: list[str]) -> list[bytes]:
        ids = self._ids(f" {self.MARK} ".join(pieces))
        cuts = np.flatnonzero(ids == self.mark).tolist()
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(ids)], strict=True)]

    def _known(self, keys: list[str], make: Callable[[list[str]], Iterable[bytes]]) -> list[bytes]:
        """The ids of different keys, remembered ones or made."""
        known, older = self.known, self.older
        out = [known.get(x) or older.get(x) for x in keys]
        places = [i for i, y in enumerate(out) if y is None]
        for i, y in zip(places, make([keys[i] for i in places]), strict=True):
            out[i] = y
        return out

    def _odd(self, pieces: list[str]) -> list[bytes]:
        plain = [x for x in pieces if self.MARK not in x]
        found: dict[str, bytes] = {x: self._ids(x).tobytes() for x in pieces if self.MARK in x}
        for i in range(0, len(plain), 4096):
            found.update(zip(plain[i : i + 4096], self._together(plain[i : i + 4096]), strict=True))
        return [found[x] for x in pieces]

    def _remember(self, keys: list[str], ids: list[bytes]) -> None:
        """An entry is two objects and a place in the table, 200 bytes or so besides the ids."""
        new = {x: y for x, y in zip(keys, ids, strict=True) if len(x) <= LONG_PIECE and x not in self.known}
        self.known |= new
        self.held += 200 * len(new) + sum(map(len, new.values()))

    def __call__(self, texts: list[str] | pa.Array) -> Iterator[bytes]:
        texts = pc.cast(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), pa.large_string())
        if not self.by_piece:
            yield from (self._ids(x).tobytes() + self.close for x in texts.to_pylist())
            return
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        told = pc.dictionary_encode(pieces.flatten())
        each = told.dictionary
        plain = pc.and_(pc.match_substring_regex(each, self.PLAIN), self.modelled)
        stop = np.where(pc.ends_with(each, ".").to_numpy(False), 1, np.where(pc.ends_with(each, ",").to_numpy(False), 2, 0))
        is_plain = plain.to_numpy(False)
        stems = pc.dictionary_encode(pc.utf8_lower(pc.utf8_rtrim(each.filter(plain), ".,")))
        stem_keys, odd_keys = stems.dictionary.to_pylist(), each.filter(pc.invert(plain)).to_pylist()
        stem_ids, odd_ids = self._known(stem_keys, lambda new: map(self._letters, new)), self._known(odd_keys, self._odd)

        parts = [b"", *self.stops.values(), *stem_ids, *odd_ids]
        starts = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(x) // 4 for x in parts], out=starts[1:])
        lists = pa.LargeListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(parts), "<u4")))
        two = np.zeros((len(each), 2), np.int64)  # a piece is a stem and a stop, or an odd one
        two[is_plain, 0] = 3 + stems.indices.to_numpy(False)
        two[is_plain, 1] = stop[is_plain]
        two[~is_plain, 0] = 3 + len(stem_ids) + np.arange(len(odd_ids))
        both = lists.take(pa.array(two.reshape(-1)))
        whole = pa.LargeListArray.from_arrays(pa.array(both.offsets.to_numpy()[::2]), both.flatten())
        spelt = whole.take(told.indices)
        ids, ends = spelt.flatten().to_numpy(), spelt.offsets.to_numpy()[pieces.offsets.to_numpy()]
        for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
            yield ids[a:b].tobytes() + self.close
        self._remember(stem_keys, stem_ids)
        self._remember(odd_keys, odd_ids)
        if len(self.known) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.older, self.known, self.held = self.known, {}, 0


def encoder(path: str, end_id: int | None) -> Encoder:
    """The worker's encoder, which outlives a task."""
    home = sys.modules.setdefault("_ledgerlume_words", types.ModuleType("_ledgerlume_words"))
    if (path, end_id) not in home.__dict__:
        home.__dict__[path, end_id] = Encoder(path, end_id)
    return home.__dict__[path, end_id]


def _open_shard(folder: str, number: int):
    system, root = pa.fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    final = f"{root}/shard-{number:06d}.llp"
    return system, final, f"{final}.{TaskContext.get().taskAttemptId()}.tmp"


def _chunks(batches) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(names, texts) of consecutive batches, up to CHUNK_BYTES of text and one batch more."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> tuple[pa.Array, pa.Array]:
        names, texts = (pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))
        return names, pc.fill_null(texts, "")

    for batch in batches:
        held.append(batch.set_column(1, "body", pc.cast(batch.column(1), pa.large_string())))
        size += batch.column(1).nbytes
        if size >= CHUNK_BYTES:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()
    pa.default_memory_pool().release_unused()  # the worker goes on to other tasks


def _writer(folder: str, tokenizer: str, end_id: int, block_ids: int, bits: bool):
    def write(batches):
        encode, number = encoder(tokenizer, end_id), TaskContext.get().partitionId()
        system, final, draft = _open_shard(folder, number)
        n_docs = 0
        with system.open_output_stream(draft) as sink:
            shard = ShardWriter(sink, block_ids, bits)
            for names, texts in _chunks(batches):
                for name, ids in zip(names.to_pylist(), encode(texts), strict=True):
                    shard.add(name, ids)
                n_docs += len(names)
            shard.close()
        if n_docs:
            system.move(draft, final)
            yield pa.RecordBatch.from_pydict({"shard": [number], "n_docs": [n_docs], "n_ids": [shard.n_ids]}, schema=pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
        else:
            system.delete_file(draft)

    return write


def write_shards(docs: DataFrame, folder: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, block_ids: int = 1 << 16, bits: bool = False, shard_bytes: int = 16 << 20, most_shards: int = 20_000, order: tuple[str, ...] = ()) -> DataFrame:
    """Writes the shards and returns their table: shard, n_docs, n_ids and start, the ids in
    all shards before. order: columns by which the documents are written, before their id.
    shard_bytes: of text for one shard, about; more where there would be more
    than most_shards, which bounds the table (a row for each shard comes to the driver)."""
    spark = docs.sparkSession
    short_batches(spark)
    by = [f"by{i}" for i in range(len(order))]
    own = docs.select(F.col(id_col).cast("long").alias("name"), F.col(text_col).alias("body"), *[F.col(c).alias(b) for c, b in zip(order, by, strict=True)])
    total = own.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n = min(most_shards, max(1, -(-total // shard_bytes)))
    tie = F.xxhash64("body")
    dealt = own.repartitionByRange(n, *by, F.col("name"), tie).sortWithinPartitions(*by, "name", tie).select("name", "body")
    rows = dealt.mapInArrow(_writer(folder, tokenizer, end_id, block_ids, bits), "shard long, n_docs long, n_ids long").collect()
    table, start = [], 0
    for r in sorted(rows):
        table.append((*r, start))
        start += r["n_ids"]
    return spark.createDataFrame(table, "shard long, n_docs long, n_ids long, start long")


def _reader(folder: str, digest: bool):
    def read(batches):
        system, root = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for number, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows, held = [], 0
                with system.open_input_file(f"{root}/shard-{number:06d}.llp") as source:
                    for name, n, pieces in ShardReader(source).documents():
                        if digest:
                            crc = 0
                            for x in pieces:
                                crc = zlib.crc32(x.tobytes(), crc)
                            rows.append((name, start, n, crc))
                        else:
                            rows.append((name, start, n, [i for x in pieces for i in x.tolist()]))
                            held += n
                        start += n
                        if len(rows) >= 4096 or held > 1 << 18:
                            yield _rows(rows, digest)
                            rows, held = [], 0
                if rows:
                    yield _rows(rows, digest)

    return read


def _rows(rows: list[tuple], digest: bool) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 if digest else [pa.int64()] * 3 + [pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])


def read_shards(shards: DataFrame, folder: str, *, digest: bool = False) -> DataFrame:
    """The documents in the files: doc_id, start, n_tokens, and ids or, as a digest, their crc32."""
    spark = shards.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, shards.count() // 8)
    spread = shards.select("shard", "start").repartition(tasks)
    return spread.mapInArrow(_reader(folder, digest), f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids array<long>'}")


def token_digest(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes docs into shards in the shared folder and describes what the files hold."""
    folder = new_folder(spark, "tokens")
    return read_shards(write_shards(docs, folder, tokenizer), folder, digest=True)


def roundtrip(ids: list[list[int]], block_ids: int, bits: bool) -> list[list[int]]:
    """ids through a shard in memory."""
    sink = io.BytesIO()
    shard = ShardWriter(sink, block_ids, bits)
    for k, x in enumerate(ids):
        shard.add(k, np.array(x, "<u4").tobytes())
    shard.close()
    return [[i for p in pieces for i in p.tolist()] for _, _, pieces in ShardReader(io.BytesIO(sink.getvalue())).documents()]
