"""Token-id shards as wavelet matrices: one compressed file per shard that answers access, count and find.

A shard holds the ids of consecutive documents, in ascending id order, each followed by an end token. Level
l of the matrix has bit l (most significant first) of every id, after ids were stably parted by the bits
above; zeros come first. rank is answered from counts kept per block of the plane, select by search in them.
File: magic, length of a JSON header, header, then zstd-compressed sections - document ids, their starts in
the shard, and for every level its rank directory and its plane in frames. The header names the sections'
sizes, so that a question reads the directories and the frames it touches, and nothing else of the file.

Documents are range-partitioned by id once; each task encodes its range with the tokenizers library, cuts it
into shards of about `shard_tokens` ids, and writes each under a name no other attempt uses, so a lost or
repeated task leaves no half file under a name that is read. The manifest, one row per shard, says which
files count and is written as a table before anything is read back.

Defined results: a null text is empty, and has the end token alone; repeated ids keep all their rows, next
to each other, in the order of their texts' hashes, then of the texts; null ids come first; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import string
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.llm.bpe import byte_characters
from deltaloom.llm.common import new_path, stash

MAGIC = b"WMTX0002"
#: Bits per block of the rank directory, and blocks per frame of a plane that is compressed by itself.
BLOCK = 4096
FRAME = 128
#: Elements that are parted by their bits at a time.
STEP = 1 << 16


class Plane:
    """One level's bits. ranks: ones before each block; frames: what gives the bytes of each frame."""

    def __init__(self, ranks: np.ndarray, frames: list[Callable[[], bytes]]):
        self.ranks, self.frames = ranks, frames
        self.held: dict[int, np.ndarray] = {}

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        """A plane of packed bits; what is missing of the last block counts as zeros."""
        step = BLOCK // 8
        padded = np.zeros(-(-len(bits) // step) * step, np.uint8)
        padded[: len(bits)] = bits
        ones = np.bitwise_count(padded).reshape(-1, step).sum(axis=1, dtype=np.int64)
        frames = [bits[at : at + FRAME * step].tobytes() for at in range(0, len(bits), FRAME * step)]
        return cls(np.concatenate([[0], np.cumsum(ones)]), [functools.partial(bytes, f) for f in frames])

    def block(self, k: int) -> np.ndarray:
        frame, at = divmod(k, FRAME)
        if frame not in self.held:
            self.held[frame] = np.frombuffer(self.frames[frame](), np.uint8)
        return self.held[frame][at * BLOCK // 8 : (at + 1) * BLOCK // 8]

    def whole(self) -> np.ndarray:
        return np.frombuffer(b"".join([f() for f in self.frames]), np.uint8)


def parting(bits: np.ndarray, zeros: int) -> Iterator[tuple[slice, np.ndarray, slice]]:
    """How elements move when those of zero bits go first: of the zeros and of the ones of every STEP elements,
    the STEP they are from, their places in it, and where they stand then. Places of few elements stay in the
    processor's cache, and go faster than masks."""
    ends = [0, zeros]
    for at in range(0, len(bits), STEP):
        part = bits[at : at + STEP]
        for bit, chosen in (0, ~part), (1, part):
            places, begin = np.flatnonzero(chosen), ends[bit]
            ends[bit] += len(places)
            yield slice(at, at + STEP), places, slice(begin, ends[bit])


class WaveletMatrix:
    """Bit planes of a sequence of ids below 2**levels. zeros: how many each plane has."""

    def __init__(self, planes: list[Plane], n: int, zeros: list[int]):
        self.planes, self.n, self.levels, self.zeros = planes, n, len(planes), zeros

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        planes, now, zeros = [], ids, []
        for level in range(levels - 1, -1, -1):
            chosen = (now & now.dtype.type(1 << level)) != 0
            planes.append(Plane.of(np.packbits(chosen)))
            zeros.append(len(ids) - int(planes[-1].ranks[-1]))
            if level:
                parted = np.empty_like(now)
                for step, places, then in parting(chosen, zeros[-1]):
                    now[step].take(places, out=parted[then], mode="clip")
                now = parted
        return cls(planes, len(ids), zeros)

    def _bit(self, level: int, at: int) -> int:
        return int(self.planes[level].block(at // BLOCK)[at % BLOCK >> 3]) >> (7 - (at & 7)) & 1

    def _rank(self, level: int, at: int) -> int:
        """Ones before place `at` of a level."""
        block, rest = divmod(at, BLOCK)
        out = int(self.planes[level].ranks[block])
        if rest:
            bits = self.planes[level].block(block)
            out += int(np.bitwise_count(bits[: rest >> 3]).sum())
            out += (int(bits[rest >> 3]) >> (8 - (rest & 7))).bit_count() if rest & 7 else 0
        return out

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) such bit of a level."""
        ranks = self.planes[level].ranks
        before = ranks if bit else np.minimum(np.arange(len(ranks)) * BLOCK, self.n) - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level].block(block))[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        out = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, at), self._rank(level, at)
            out = out << 1 | bit
            at = self.zeros[level] + ones if bit else at - ones
        return out

    def _range(self, token: int, upto: int) -> tuple[int, int]:
        lo, hi = 0, upto
        for level in range(self.levels):
            a, b = self._rank(level, lo), self._rank(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.levels - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, upto: int | None = None) -> int:
        """Occurrences of an id before a place (all without one)."""
        if not 0 <= token < 1 << self.levels:
            return 0
        lo, hi = self._range(token, self.n if upto is None else upto)
        return hi - lo

    def find(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of an id, -1 if there are fewer."""
        if k < 0 or k >= self.count(token):
            return -1
        at = self._range(token, 0)[0] + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def all(self) -> np.ndarray:
        """Every id in order: the parting of each level is undone from the last one up."""
        out = np.zeros(self.n, np.uint32 if self.levels > 16 else np.uint16)
        for level in range(self.levels - 1, -1, -1):
            bit = np.unpackbits(self.planes[level].whole(), count=self.n).view(bool)
            out[self.zeros[level] :] |= out.dtype.type(1 << (self.levels - 1 - level))
            up = np.empty_like(out)
            for step, places, then in parting(bit, self.zeros[level]):
                up[step][places] = out[then]
            out = up
        return out


def pack(ids: np.ndarray, doc_ids: list[int | None], starts: np.ndarray, levels: int) -> bytes:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    docs = np.array([d or 0 for d in doc_ids], "<i8")
    known = np.packbits(np.array([d is not None for d in doc_ids], np.uint8)).tobytes()
    matrix = WaveletMatrix.build(ids, levels)
    sections = [squeeze(x) for x in (docs.tobytes(), known, starts.astype("<i8").tobytes())]
    for p in matrix.planes:
        sections += [squeeze(x) for x in (np.diff(p.ranks).astype("<u2").tobytes(), *(f() for f in p.frames))]
    header = json.dumps({"n": len(ids), "docs": len(doc_ids), "levels": levels, "zeros": matrix.zeros, "block": BLOCK, "frame": FRAME, "sections": [len(s) for s in sections]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *sections])


class Shard:
    """A shard file by what reads (place, length) of it. Sections are read and unpacked when they are asked for."""

    def __init__(self, read: Callable[[int, int], bytes]):
        head = read(0, 12)
        if head[:8] != MAGIC:
            raise ValueError("not a shard file")
        (size,) = struct.unpack("<I", head[8:12])
        self.header = header = json.loads(read(12, size))
        if (header["block"], header["frame"]) != (BLOCK, FRAME):
            raise ValueError("a shard file of other blocks")
        places = np.cumsum([12 + size, *header["sections"]]).tolist()
        self._section = lambda k: zstandard.ZstdDecompressor().decompress(read(places[k], header["sections"][k]))
        frames = -(-header["n"] // (BLOCK * FRAME))
        ranks = lambda k: np.concatenate([[0], np.cumsum(np.frombuffer(self._section(k), "<u2"), dtype=np.int64)])
        firsts = [3 + level * (frames + 1) for level in range(header["levels"])]
        planes = [_LazyPlane(functools.partial(ranks, k), [functools.partial(self._section, k + 1 + f) for f in range(frames)]) for k in firsts]
        self.matrix = WaveletMatrix(planes, header["n"], header["zeros"])

    @functools.cached_property
    def docs(self) -> list[int | None]:
        known = np.unpackbits(np.frombuffer(self._section(1), np.uint8), count=self.header["docs"])
        return [d if k else None for d, k in zip(np.frombuffer(self._section(0), "<i8").tolist(), known.tolist(), strict=True)]

    @functools.cached_property
    def starts(self) -> np.ndarray:
        return np.frombuffer(self._section(2), "<i8")


class _LazyPlane(Plane):
    def __init__(self, make: Callable[[], np.ndarray], frames: list[Callable[[], bytes]]):
        self.make, self.frames, self.held = make, frames, {}

    @functools.cached_property
    def ranks(self) -> np.ndarray:
        return self.make()


def unpack(data: bytes) -> Shard:
    return Shard(lambda at, n: data[at : at + n])


def open_shard(path: str) -> Shard:
    """A shard of which only what is asked for is read."""
    fs, at = file_system(path)
    file = fs.open_input_file(at)
    return Shard(lambda place, n: file.read_at(n, place))


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system of a path or URI, and the path in it."""
    path = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def write_file(path: str, data: bytes) -> None:
    fs, at = file_system(path)
    fs.create_dir(os.path.dirname(at), recursive=True)
    with fs.open_output_stream(at) as out:
        out.write(data)


def read_file(path: str) -> bytes:
    fs, at = file_system(path)
    with fs.open_input_stream(at) as f:
        return f.read()


WIDE_SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where this is in a text, white space stands before a space: such texts are cut by WORDS alone.
RUNS = f"[\t-\r {WIDE_SPACES}] "
#: The split pattern of byte-level vocabularies, which public_tokenizers.PATTERN states too.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Bytes of text that are cut and looked up together, which bounds what a worker holds for it.
TOGETHER = 16 << 20


def cut(piece: str) -> list[str]:
    """WORDS.findall of a space and a piece without spaces, by its lines, which mostly are letters and then marks."""
    lines = piece.split("\n")
    out, space = [], " "
    for line in lines:
        letters = line.rstrip(string.punctuation)
        if letters.isalpha():
            out.append(space + letters)
            if len(letters) < len(line):
                out.append(line[len(letters) :])
        elif line and not line[0].isspace() and not line[-1].isspace():
            out += WORDS.findall(space + line)
        else:  # white space beside white space
            return WORDS.findall(" " + piece)
        out.append("\n")
        space = ""
    return out[:-1]


class LibraryEncoder:
    """The tokenizers library with memories of pieces of text, which go to the library's model when they are
    new; what a piece encodes to depends on nothing around it. Texts are cut at spaces many at a time, and
    each different piece of them is looked up once. Words of letters are remembered without the space before
    them, which most have. Memories keep what they were asked first, up to a number of words."""

    def __init__(self, path: str, remembered: int = 500_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        spec = json.loads(open(path, encoding="utf-8").read())
        pre = spec.get("pre_tokenizer") or {}
        self.apart = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.most = remembered
        self.spaced = {"": b""}  # letters -> ids of a space and the letters
        self.words: dict[str, bytes] = {}  # any other word of WORDS -> its ids
        chars = byte_characters()
        self.byte_chars = np.array([ord(c) for c in chars], "<u2")
        self.byte_chars[0xFF] = ord("\n")  # no byte of UTF-8: parts the words

    def _library(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _model(self, words: list[str]) -> list[bytes]:
        """Words of WORDS by the library's model, in the characters that stand for their bytes."""
        packed = np.frombuffer(b"\xff".join([w.encode("utf-8", "surrogatepass") for w in words]), np.uint8)
        tokenize = self.model.tokenize
        return [array("I", [t.id for t in tokenize(w)]).tobytes() for w in self.byte_chars[packed].tobytes().decode("utf-16-le").split("\n")]

    def _known(self, memory: dict[str, bytes], keys: list[str], make: Callable[[list[str]], list[bytes]], most: int) -> list[bytes]:
        """What a memory has for the keys; what it does not have is made, each key once."""
        out = list(map(memory.get, keys))
        if at := [i for i, v in enumerate(out) if v is None]:
            new = list(dict.fromkeys([keys[i] for i in at]))
            made = dict(zip(new, make(new), strict=True))
            for i in at:
                out[i] = made[keys[i]]
            memory.update(itertools.islice(made.items(), max(0, most - len(memory))))
        return out

    def _letters(self, pieces: list[str]) -> list[bytes]:
        return self._known(self.spaced, pieces, lambda new: self._model([" " + p for p in new]), self.most)

    def _others(self, words: list[str]) -> list[bytes]:
        return self._known(self.words, words, self._model, self.most // 2)

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words of WORDS."""
        spaced = [w[0] == " " and w[1:].isalpha() for w in words]
        letters = iter(self._letters([w[1:] for w, s in zip(words, spaced, strict=True) if s]))
        others = iter(self._others([w for w, s in zip(words, spaced, strict=True) if not s]))
        return [next(letters if s else others) for s in spaced]

    def _texts(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that are cut by WORDS."""
        found = [WORDS.findall(t) for t in texts]
        ids = iter(self._words([w for ws in found for w in ws]))
        return [b"".join(itertools.islice(ids, len(ws))) for ws in found]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of a space and each piece, which has no space within."""
        heads, at, more = list(pieces), [], []
        for i in [i for i, letters in enumerate(map(str.isalpha, pieces)) if not letters]:
            letters = pieces[i].rstrip(string.punctuation)
            if letters.isalpha():
                words = [pieces[i][len(letters) :]]
            else:
                words = cut(pieces[i])
                letters = words.pop(0)[1:] if words[0][0] == " " and words[0][1:].isalpha() else ""
            heads[i] = letters
            at += [i] * len(words)
            more += words
        out = self._letters(heads)
        for i, ids in zip(at, self._others(more), strict=True):
            out[i] += ids
        return out

    def encode(self, texts: pa.Array) -> list[bytes | memoryview]:
        """The ids of every text as little-endian unsigned 32-bit integers."""
        texts = texts.fill_null("")
        if not self.apart:
            return [self._library(t) for t in texts.to_pylist()]
        special = functools.reduce(pc.or_, [pc.match_substring(texts, s) for s in self.specials], pa.repeat(False, len(texts)))
        runs = pc.and_not(pc.match_substring_regex(texts, RUNS), special)
        plain = pc.invert(pc.or_(special, runs))
        # White space before a space: cutting at spaces would not be the same.
        own = {0: iter(self._cut(texts.filter(plain))), 1: iter(self._texts(texts.filter(runs).to_pylist())), 2: map(self._library, texts.filter(special).to_pylist())}
        return [next(own[2 if s else 1 if r else 0]) for s, r in zip(special.to_pylist(), runs.to_pylist(), strict=True)]

    def _cut(self, texts: pa.Array) -> list[memoryview]:
        """The ids of texts that may be cut at spaces."""
        lists = pc.split_pattern(texts, " ")
        bounds = np.cumsum([0, *pc.list_value_length(lists).to_pylist()])
        coded = lists.flatten().dictionary_encode()
        code, values = coded.indices.to_numpy().copy(), self._pieces(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        code[bounds[:-1]] = np.arange(len(values), len(values) + len(texts))  # no space before a text's first piece
        values += self._texts(pc.list_element(lists, 0).to_pylist()) if len(texts) else []
        whole = pa.array(values, pa.large_binary()).take(pa.array(code))
        _, ends, data = whole.buffers()
        if not data:
            return [memoryview(b"")] * len(texts)
        at, view = np.frombuffer(ends, np.int64)[whole.offset + bounds].tolist(), memoryview(data)
        return [view[a:b] for a, b in itertools.pairwise(at)]


@functools.lru_cache(maxsize=2)
def library_encoder(path: str, remembered: int = 500_000) -> LibraryEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return LibraryEncoder(path, remembered)


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of (id, text) with less than TOGETHER bytes of text after their first row."""
    sizes = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
    turns = np.cumsum(sizes, dtype=np.int64) // TOGETHER
    cuts = [0, *(np.flatnonzero(np.diff(turns)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in itertools.pairwise(cuts))


MANIFEST = "part int, shard int, path string, docs long, tokens long"


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1 << 21, levels: int = 16, parts: int | None = None) -> DataFrame:
    """Writes the shards into the folder; the manifest, a row per shard, ordered by (part, shard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        held: list[bytes] = []
        size = 0
        end = struct.pack("<I", end_id)
        room = 1 << levels

        def flush() -> pa.RecordBatch:
            nonlocal shard, size
            ids = np.frombuffer(b"".join(held), "<u4")
            if len(ids) and int(ids.max()) >= room:
                raise ValueError(f"token id {ids.max()} needs more than {levels} levels")
            starts = np.cumsum([0, *(len(h) // 4 for h in held)])[:-1]
            name = f"{folder}/{part:06d}-{shard:06d}-{uuid.uuid4().hex}.wm"
            write_file(name, pack(ids.astype(np.uint16) if levels <= 16 else ids, doc_ids, starts, levels))
            row = pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "path": name, "docs": len(doc_ids), "tokens": len(ids)}], pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))
            doc_ids.clear()
            held.clear()
            shard, size = shard + 1, 0
            return row

        encode = library_encoder(path).encode
        for batch in itertools.chain.from_iterable(map(portions, batches)):
            for d, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                held.append(b"".join((ids, end)))
                doc_ids.append(d)
                size += len(held[-1]) // 4
                if size >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    n = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The hash parts rows of one id that stands very often, and gives them an order that no attempt changes.
    ranged = rows.repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie", "text").select("id", "text")
    return stash(ranged.mapInArrow(run, MANIFEST), "manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files the manifest names."""
    earlier = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Shards are summed within the task that wrote them; the window without a key has one row per such task.
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("tokens")).select("part", earlier(Window.orderBy("part")).alias("first"))
    files = manifest.select("part", "path", earlier(Window.partitionBy("part").orderBy("shard")).alias("within"))
    files = files.join(parts, "part").select("path", (F.col("first") + F.col("within")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = unpack(read_file(path))
                matrix, docs, starts = shard.matrix, shard.docs, shard.starts
                ids = matrix.all().astype("<u4")
                bounds = np.append(starts, matrix.n)
                view = memoryview(ids.tobytes())
                crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts + base, pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(crcs, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, F.xxhash64("path")).mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, token: int) -> DataFrame:
    """(id, n): how often a token occurs in each document that has it, by count() and find() on the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                shard = open_shard(path)
                matrix, docs, starts = shard.matrix, shard.docs, shard.starts
                places = np.array([matrix.find(token, k) for k in range(matrix.count(token))], np.int64)
                own, n = np.unique(np.searchsorted(starts, places, side="right") - 1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([docs[i] for i in own], pa.int64()), pa.array(n, pa.int64())], ["id", "n"])

    return manifest.select("path").mapInArrow(run, "id long, n long")


def shard_documents(docs: DataFrame, path: str, end_id: int, **options) -> tuple[DataFrame, DataFrame]:
    """Writes the shards under the shared folder; (manifest, documents read back)."""
    manifest = write_shards(docs, new_path(docs.sparkSession, "shards"), path, end_id, **options)
    return manifest, read_documents(manifest)
