"""Token ids in binary files of patched frame-of-reference blocks."""

import os
import struct
import uuid
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from scenegrade.llm.common import gathered, open_storage, pick, shared_folder, stored, tasks_for

#: Ids of a block, percentile of bit widths that the packed width must cover, ids after which a new file begins.
BLOCK, COVERED, FILE_IDS = 1024, 0.9, 1 << 23
HEAD = struct.Struct("<IHHB")  # block minimum, ids, exceptions, packed width
TAIL = struct.Struct("<QQ4s")  # blocks, ids, mark
MARK = b"pfor"
#: Words whose ids a worker remembers.
REMEMBERED = 1_200_000
#: Bytes of text that are encoded at a time, if no text is longer.
PORTION = 1 << 24
#: Documents that are added to a file at a time.
ROWS = 64


def _pack(values: np.ndarray, width: int) -> bytes:
    """len(values) must be a multiple of 4, width even; four values of up to 16 bits share one 64-bit word."""
    parts = []
    for low in range(0, width, 16):
        w = min(16, width - low)
        v = ((values >> np.uint64(low)) & np.uint64((1 << w) - 1)).reshape(-1, 4)
        word = v[:, 0] | v[:, 1] << np.uint64(w) | v[:, 2] << np.uint64(2 * w) | v[:, 3] << np.uint64(3 * w)
        parts.append(word.view(np.uint8).reshape(-1, 8)[:, : w // 2].tobytes())
    return b"".join(parts)


def _unpack(data: memoryview, n: int, width: int) -> np.ndarray:
    values, at = np.zeros(n, np.uint64), 0
    for low in range(0, width, 16):
        w = min(16, width - low)
        words = np.zeros((n // 4, 8), np.uint8)
        words[:, : w // 2] = np.frombuffer(data, np.uint8, n // 4 * (w // 2), at).reshape(-1, w // 2)
        at += n // 4 * (w // 2)
        word, mask = words.view(np.uint64).reshape(-1, 1), np.uint64((1 << w) - 1)
        values |= ((word >> (np.arange(4, dtype=np.uint64) * np.uint64(w))) & mask).reshape(-1) << np.uint64(low)
    return values


def encode_block(ids: np.ndarray) -> bytes:
    """One block: HEAD, packed offsets from the minimum, positions and high parts of the exceptions."""
    n = len(ids)
    least = int(ids.min())
    rest = np.zeros(-(-n // 4) * 4, np.uint64)
    rest[:n] = ids - np.uint32(least)
    lengths = np.ceil(np.log2(rest[:n].astype(np.float64) + 1)).astype(np.int64)
    width = int(np.sort(lengths)[max(0, -(-int(n * COVERED * 100) // 100) - 1)])
    width += width % 2
    high = rest >> np.uint64(width)
    odd = np.flatnonzero(high)
    return b"".join([
        HEAD.pack(least, n, len(odd), width), _pack(rest, width), odd.astype("<u2").tobytes(), high[odd].astype("<u4").tobytes(),
    ])


def decode_block(data: memoryview) -> np.ndarray:
    least, n, odd, width = HEAD.unpack_from(data)
    padded = -(-n // 4) * 4
    at = HEAD.size + padded // 4 * (width // 2)
    values = _unpack(data[HEAD.size : at], padded, width)
    places = np.frombuffer(data, "<u2", odd, at)
    values[places] |= np.frombuffer(data, "<u4", odd, at + 2 * odd).astype(np.uint64) << np.uint64(width)
    return (values[:n] + np.uint64(least)).astype("<u4")


class Writer:
    """A file of blocks, then the block starts (u64 each) and TAIL. Ids are taken in any portions."""

    def __init__(self, folder: str, part: int):
        self.path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.pfor"
        fs, path = open_storage(self.path)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.starts, self.size, self.ids, self.rest = fs.open_output_stream(path), [], 0, 0, np.zeros(0, "<u4")

    def add(self, ids: np.ndarray) -> None:
        self.ids += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        for a in range(0, whole, BLOCK):
            self._block(ids[a : a + BLOCK])
        self.rest = ids[whole:].copy()

    def _block(self, ids):
        data = encode_block(ids)
        self.starts.append(self.size)
        self.size += len(data)
        self.out.write(data)

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        self.out.write(np.array([*self.starts, self.size], "<u8").tobytes() + TAIL.pack(len(self.starts), self.ids, MARK))
        self.out.close()


class Reader:
    """Ids of a file by position; only the blocks that hold them are read."""

    def __init__(self, path: str):
        fs, name = open_storage(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        blocks, self.n, mark = TAIL.unpack(self.file.read_at(TAIL.size, size - TAIL.size))
        if mark != MARK:
            raise ValueError(f"{path}: no token file")
        index = 8 * (blocks + 1)
        self.starts = np.frombuffer(self.file.read_at(index, size - TAIL.size - index), "<u8").astype(np.int64)

    def ids(self, first: int, n: int) -> np.ndarray:
        if not n:
            return np.zeros(0, "<u4")
        a, b = first // BLOCK, -(-(first + n) // BLOCK)
        base = int(self.starts[a])
        data = memoryview(self.file.read_at(int(self.starts[b]) - base, base))
        blocks = [decode_block(data[int(self.starts[k]) - base : int(self.starts[k + 1]) - base]) for k in range(a, b)]
        return np.concatenate(blocks)[first - a * BLOCK :][:n]


class Encoder:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library; words between spaces are remembered.

    The library's pre-tokenizer begins a new word at a space that stands alone, so the ids of a text are those of its
    words, each encoded by the library once per worker: a batch is split and its distinct words are found by Arrow, only
    those not yet known go to the library, and the ids are gathered by offsets. Texts that spaces alone don't cut
    safely, and those that hold a special token, go to the library whole. With `special_as_text` the strings of special
    tokens are ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [t.content for t in self.library.get_added_tokens_decoder().values()]
        n = self.library.get_vocab_size()
        self.begins = np.array([(self.library.id_to_token(i) or "").startswith("Ġ") for i in range(n)])
        self.forget()

    def forget(self) -> None:
        """Words by place; the ids of all of them, one after the other; where each word's ids begin, and how many."""
        self.places: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0
        self.begin, self.size = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, n = len(self.places), len(words)
        self.places.update(zip(words, range(first, first + n)))
        self.ids = _room(self.ids, self.used + len(ids))
        self.begin, self.size = _room(self.begin, first + n), _room(self.size, first + n)
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + n] = sizes
        self.used += len(ids)

    def _learn(self, words: list[str]) -> None:
        """Ids of new words. Those that are a space and then no space at either end are encoded side by side, as in a
        text; a word begins at each piece that begins with a space."""
        joined = [w for w in words if len(w) > 1 and w[0] == " " and not w[1].isspace() and not w[-1].isspace()]
        apart = set(words).difference(joined) if len(joined) < len(words) else set()
        for a in range(0, len(joined), 256):
            part = joined[a : a + 256]
            ids = np.array(self._library(["".join(part)])[0], "<u4")
            at = np.flatnonzero(self.begins[ids])
            if len(at) == len(part):
                self._keep(part, ids, np.diff(at, append=len(ids)))
            else:
                apart.update(part)
        if apart:
            apart = sorted(apart)
            found = self._library(apart)
            self._keep(apart, np.array([i for x in found for i in x], "<u4"), np.array([len(x) for x in found]))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the offsets of the texts in them."""
        if len(self.places) > REMEMBERED:
            self.forget()
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        at = split.offsets.to_numpy()
        words = split.values.dictionary_encode()
        names, which = words.dictionary.to_pylist(), words.indices.to_numpy()
        whole = np.array([any(s in t for s in self.special) for t in texts], bool) | _uncut(names, which, at)
        heads = [names[k] for k in which[at[:-1]]]  # no space stands before the first word
        keys = [" " + w for w in names] + heads
        places = np.fromiter(map(self.places.get, keys, repeat(-1)), np.int32, len(keys))
        new = [keys[k] for k in np.flatnonzero(places < 0).tolist() if keys[k]]
        if new:
            self._learn(sorted(set(new)))
            places[places < 0] = [self.places.get(keys[k], -1) for k in np.flatnonzero(places < 0).tolist()]
        which, first = places[which] if len(which) else places[:0].copy(), places[len(names) :]
        sizes = self.size[which]
        which[at[:-1]], sizes[at[:-1]] = first, np.where(first < 0, 0, self.size[first])
        ends = np.r_[0, np.cumsum(sizes, dtype=np.int32)].astype(np.int32)  # a batch holds fewer than 2**31 ids
        from_here = np.repeat(self.begin[which] - ends[:-1], sizes)
        from_here += np.arange(ends[-1], dtype=np.int32)
        ids, ends = self.ids[from_here], ends[at].astype(np.int64)
        if not whole.any():
            return ids, ends
        parts = np.split(ids, ends[1:-1])
        at = np.flatnonzero(whole)
        for k, found in zip(at, self._library([texts[k] for k in at])):
            parts[k] = np.array(found, "<u4")
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def _uncut(names: list[str], which: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Texts in which white space, a space and then white space or the end follow each other: there a word is no unit.

    names: the distinct words between spaces, which: those of the texts, at: offsets of the texts.
    """
    before, after = (np.array([not w or w[k].isspace() for w in names], bool) for k in (-1, 0))
    if not before.any() or not len(which):
        return np.zeros(len(at) - 1, bool)
    before, after = before[which], after[which]
    before[at[:-1]] &= np.array([bool(names[k]) for k in which[at[:-1]]], bool)  # an empty first word has nothing before its space
    hit = before[:-1] & after[1:]
    hit[at[1:-1] - 1] = False
    sums = np.r_[0, np.cumsum(hit), hit.sum()]
    return sums[at[1:]] > sums[at[:-1]]


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n - len(x), len(x)), x.dtype)])


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str, file_ids: int = FILE_IDS, special_as_text: bool = False) -> DataFrame:
    """Encodes every whole text, appends end_id, and writes the ids in ascending doc_id order to files in `folder`.

    Rows are range-partitioned and sorted by (doc_id, text); a task writes its range to files of about file_ids ids,
    so part and file order is id order. Null text is empty; null ids come first; rows with equal ids stay apart.
    Returns the index, stored beside the files: doc_id, part, path, first (place in the file), start (place in
    the part), n_tokens. Files of failed attempts are in no index. An empty input gives no file and an empty index.
    """
    rows = pick(docs, doc_id="doc_id", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.repartitionByRange(tasks_for(docs), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        encoder, part = worker_encoder(tokenizer, special_as_text), TaskContext.get().partitionId()
        writer, start = None, 0
        for batch in gathered(batches, "text", PORTION):
            found, ends = encoder(batch.column("text").to_pylist())
            n = np.diff(ends) + 1
            ids = np.insert(found, ends[1:], end_id)
            at, done = np.cumsum(n) - n, []
            for k in range(0, len(n), ROWS):
                if writer is None or writer.ids >= file_ids:
                    if writer:
                        writer.close()
                    writer = Writer(folder, part)
                rows, size = slice(k, k + ROWS), int(n[k : k + ROWS].sum())
                done.append((writer.path, writer.ids + at[rows] - at[k]))
                writer.add(ids[at[k] : at[k] + size])
            paths = [path for path, first in done for _ in first]
            columns = [pa.array(np.full(len(n), part, np.int32)), pa.array(paths, pa.string()), *(pa.array(x) for x in (np.concatenate([first for _, first in done]), start + at, n))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *INDEX])
            start += int(n.sum())
        if writer:
            writer.close()

    kind = rows.schema["doc_id"].dataType.simpleString()
    index = rows.mapInArrow(run, f"doc_id {kind}, part int, path string, first bigint, start bigint, n_tokens bigint")
    return stored(index, "index", f"{folder}/index.parquet")


INDEX = ["part", "path", "first", "start", "n_tokens"]
_encoders: dict[tuple[str, bool], Encoder] = {}


def worker_encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One encoder for each Python worker and file."""
    if (path, special_as_text) not in _encoders:
        _encoders[path, special_as_text] = Encoder(path, special_as_text)
    return _encoders[path, special_as_text]


def with_starts(index: DataFrame) -> DataFrame:
    """The index with `start` counted over all parts. Only one row for each part is ordered in one task."""
    sums = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return index.join(F.broadcast(before), "part").withColumn("start", F.col("start") + F.col("before")).drop("before")


def read_digests(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files: index rows are dealt by file and place."""
    rows = with_starts(index).repartitionByRange(tasks_for(index), "path", "first").sortWithinPartitions("path", "first")

    def run(batches):
        reader, path = None, None
        for batch in batches:
            names, first, n = (batch.column(c).to_pylist() for c in ("path", "first", "n_tokens"))
            sums, a = [], 0
            while a < len(names):
                b, held = a, 0
                while b < len(names) and names[b] == names[a] and (b == a or held + n[b] <= 1 << 20 and first[b] == first[b - 1] + n[b - 1]):
                    held += n[b]
                    b += 1
                if names[a] != path:
                    reader, path = Reader(names[a]), names[a]
                ids = memoryview(reader.ids(first[a], held)).cast("B")
                for k in range(a, b):
                    at = 4 * (first[k] - first[a])
                    sums.append(zlib.crc32(ids[at : at + 4 * n[k]]))
                a = b
            columns = [batch.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = index.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "path", "first", "start", "n_tokens").mapInArrow(
        run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def token_file_digests(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    folder = folder or shared_folder(docs.sparkSession, "tokens")
    return read_digests(write_tokens(docs, tokenizer, end_id, folder))
