"""Removal of passages that an earlier document holds, by anchors on a difference cover."""

import uuid
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from scenegrade.llm.common import flat, open_storage, pick, shared_folder, stored, tasks_for


@dataclass(frozen=True)
class Settings:
    """Words of a window; words and rows after which a block of documents is closed (a longer text is one block)."""

    window: int = 13
    block_words: int = 1 << 20
    block_rows: int = 20_000

    @property
    def period(self) -> int:
        return (self.window + 1) // 2

    @property
    def anchor(self) -> int:
        """Words of an anchor: two equal windows share one that begins within the first `period` words of both."""
        return self.window - self.period + 1


#: Stands for a missing id: later than every document.
LAST = np.iinfo(np.int64).max
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def difference_cover(period: int) -> list[int]:
    """Smallest set of residues whose differences give every residue of `period`: 0, 1, 3 for 7."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return list(cover)
    return [0]


def _joined(a: np.ndarray, b: np.ndarray, lane: int) -> np.ndarray:
    x = (a ^ (a >> np.uint64(29))) * MIX[lane] + b
    return (x ^ (x >> np.uint64(32))) * MIX[1 - lane]


def codes(words: np.ndarray, width: int, lane: int) -> np.ndarray:
    """A code of each run of `width` consecutive words, from the codes of runs of a power of two."""
    n, out, done, run, size = len(words) - width + 1, None, 0, words, 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        while size <= width:
            if width & size:
                part = run[done : done + n]
                out = part if out is None else _joined(out, part, lane)
                done += size
            run = _joined(run[:-size], run[size:], lane)
            size *= 2
    return out


class Block:
    """Documents of a block, in ascending order of id, and the words of those chosen, one after the other."""

    def __init__(self, path: str, own: list[int], settings: Settings):
        fs, name = open_storage(path)
        with fs.open_input_file(name) as file:
            table = pa.ipc.open_file(file).read_all().combine_chunks()
        self.ids = table["doc_id"].fill_null(LAST).to_numpy()[own]
        self.unknown = table["doc_id"].is_null().to_numpy()[own]
        self.words, self.at = [], np.zeros(len(own) + 1, np.int64)
        for k, place in enumerate(own):
            self.words += table["text"][place].as_py().split()
            self.at[k + 1] = len(self.words)
        known: dict[bytes, int] = {}
        number = np.fromiter((known.setdefault(w, len(known)) for w in self.words), np.int64, len(self.words))
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, known)) or bytes(16), np.uint64).reshape(-1, 2)
        self.high, self.low = digests[number, 0], digests[number, 1]
        self.owner = np.repeat(np.arange(len(own)), np.diff(self.at))
        self.settings = settings

    def inside(self, width: int) -> np.ndarray:
        """Positions at which a run of `width` words of one document begins."""
        n = max(0, len(self.words) - width + 1)
        return np.flatnonzero(self.owner[:n] == self.owner[width - 1 :][:n]) if n else np.zeros(0, np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions of anchors; their distinct codes, sorted; the code of each; whether two documents here hold it."""
        s = self.settings
        at = self.inside(s.anchor)
        cover = np.zeros(s.period, bool)
        cover[difference_cover(s.period)] = True
        at = at[cover[(at - self.at[self.owner[at]]) % s.period]]
        found, which = np.unique(codes(self.high, s.anchor, 0)[at] if len(at) else np.zeros(0, np.uint64), return_inverse=True)
        first, last = np.full(len(found), LAST), np.full(len(found), -LAST)
        np.minimum.at(first, which, self.ids[self.owner[at]])
        np.maximum.at(last, which, self.ids[self.owner[at]])
        return at, found, which, first < last

    def windows(self, elsewhere: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions of windows that hold an anchor shared with another document; their distinct codes (two columns, sorted);
        the code of each; the smallest document here that holds it. `elsewhere`: anchor codes that other blocks hold."""
        s = self.settings
        at, _, which, here = self.anchors()
        shared = np.zeros(len(self.words) + s.period + 1, np.int64)
        shared[at[(here | elsewhere)[which]] + 1] = 1
        sums = np.cumsum(shared)
        at = self.inside(s.window)
        at = at[sums[at + s.period] > sums[at]]
        high, low = (codes(x, s.window, lane)[at] if len(at) else np.zeros(0, np.uint64) for lane, x in enumerate((self.high, self.low)))
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        head = np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])] if len(at) else np.zeros(0, bool)
        which = np.empty(len(at), np.int64)
        which[order] = np.cumsum(head) - 1
        least = np.full(int(head.sum()), LAST)
        np.minimum.at(least, which, self.ids[self.owner[at]])
        return at, np.stack([high[head], low[head]], 1), which, least

    def covered(self, elsewhere: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """Words that a repeated window covers. `earlier`: windows that a smaller document of another block holds."""
        at, _, which, least = self.windows(elsewhere)
        repeated = at[earlier[which] | (self.ids[self.owner[at]] > least[which])]
        edges = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(edges, repeated, 1)
        np.add.at(edges, repeated + self.settings.window, -1)
        return np.cumsum(edges[:-1]) > 0


def write_blocks(docs: DataFrame, folder: str, settings: Settings) -> DataFrame:
    """Texts in compressed files of one block each; their index, stored: block, path, place, doc_id, n_words, digest.

    Nothing is shuffled. Files of failed attempts are in no index.
    """

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        held, words, n = [], 0, 0

        def closed():
            path = f"{folder}/block-{part:06d}-{number:06d}-{uuid.uuid4().hex}.arrow"
            table = pa.Table.from_batches(held).sort_by([("doc_id", "ascending")])
            texts = [t.as_py() for t in table["text"]]
            fs, name = open_storage(path)
            fs.create_dir(name.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(name) as out, pa.ipc.new_file(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
                file.write_table(table)
            n = len(texts)
            columns = [
                pa.array([part << 32 | number] * n, pa.int64()), pa.array([path] * n), pa.array(range(n), pa.int32()),
                table["doc_id"].combine_chunks(), pa.array([len(t.split()) for t in texts], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()),
            ]
            for a in range(0, n, 4096):
                yield pa.RecordBatch.from_arrays([c.slice(a, 4096) for c in columns], names=INDEX)

        for batch in batches:
            sizes = np.diff(flat(batch.column("text"))[0]) // 6 + 1  # words, about
            a = 0
            for b, size in enumerate(sizes.tolist(), 1):
                words, n = words + size, n + 1
                if words >= settings.block_words or n >= settings.block_rows:
                    held.append(batch.slice(a, b - a))
                    yield from closed()
                    a, held, words, n, number = b, [], 0, 0, number + 1
            if a < len(sizes):
                held.append(batch.slice(a))
        if held:
            yield from closed()

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    index = rows.mapInArrow(run, "block bigint, path string, place int, doc_id bigint, n_words bigint, digest binary")
    return stored(index, "index", f"{folder}/index.parquet")


INDEX = ["block", "path", "place", "doc_id", "n_words", "digest"]


def dealt(block: int, found: np.ndarray, shards: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (shard, block, columns as bytes) of the slices of sorted codes that fall to each shard."""
    shard = ((found >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    cuts = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
    full = np.flatnonzero(np.diff(cuts))
    slices = [pa.array([c[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()), *slices], names=["shard", "block", *[f"c{i}" for i in range(len(slices))]])


def marked_rows(rows: DataFrame, shards: int, columns: int, judge) -> DataFrame:
    """(block, shard, bits): for the codes of each row (shard, block, c0..), those that `judge` marks in view of the whole shard.

    A shard is read at once: its share of the distinct codes of each block, so a hot code counts once a block. Shards
    are as many as the session's shuffle partitions.
    """

    def run(batches):
        def answers(blocks, held):
            sizes = [len(x[0]) for x in held]
            marks = judge([np.concatenate(c) for c in zip(*held)], sizes)
            ends = np.cumsum(sizes)
            hit = [k for k, e in enumerate(ends) if marks[e - sizes[k] : e].any()]
            bits = [np.packbits(marks[ends[k] - sizes[k] : ends[k]]).tobytes() for k in hit]
            return pa.RecordBatch.from_arrays([pa.array([blocks[k] for k in hit], pa.int64()), pa.array([now] * len(hit), pa.int32()), pa.array(bits, pa.binary())], names=["block", "shard", "bits"])

        now, blocks, held = None, [], []
        for batch in batches:
            for k, shard in enumerate(batch.column("shard").to_pylist()):
                if shard != now and held:
                    yield answers(blocks, held)
                    blocks, held = [], []
                now = shard
                blocks.append(batch.column("block")[k].as_py())
                held.append([np.frombuffer(batch.column(f"c{i}")[k].as_buffer(), np.uint64) for i in range(columns)])
        if held:
            yield answers(blocks, held)

    spread = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "block")
    return spread.mapInArrow(run, "block bigint, shard int, bits binary")


def in_two_blocks(columns: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    _, which, n = np.unique(columns[0], return_inverse=True, return_counts=True)
    return n[which] > 1


def in_an_earlier_document(columns: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    high, low, least = columns[0], columns[1], columns[2].view(np.int64)
    order = np.lexsort((least, low, high))
    head = np.r_[True, (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)]
    first = least[order][np.flatnonzero(head)][np.cumsum(head) - 1]
    marks = np.empty(len(high), bool)
    marks[order] = first < least[order]
    return marks


def marks_of(found: np.ndarray, shards: int, bits: list[dict] | None) -> np.ndarray:
    """The marks of all codes of a block, from the bits of its shards."""
    out = np.zeros(len(found), bool)
    shard = ((found >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    for one in bits or []:
        a, b = np.searchsorted(shard, np.array([one["shard"], one["shard"] + 1], np.uint64))
        out[a:b] = np.unpackbits(np.frombuffer(one["bits"], np.uint8), count=b - a)
    return out


def without_repeats(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space), one row per row of `documents`.

    A word goes if a window of consecutive words covers it that also begins in a document with a smaller id, judged
    on the texts given. Texts are written to block files; tasks read them by path, so only codes are shuffled. Of
    equal texts only the one with the smallest id is searched, the others lose all words that stand in a window.
    Anchors, at positions whose place in the document is in the difference cover of the period, are compared over all
    blocks; each one that two documents hold is extended to the windows around it, and their codes of 128 bits are
    compared over all blocks in turn. What comes back to a block is one bit for each code.

    Null, empty and blank texts have no words. A null id is later than all others; rows with equal ids, and rows with
    null ids, remove nothing from each other, and a repeat within one document alone stays.
    """
    given = pick(documents, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    tasks, folder = tasks_for(documents), shared_folder(documents.sparkSession, "passages")
    index = write_blocks(given, folder, settings)
    least = stored(index.filter(F.col("n_words") >= settings.window).groupBy("digest").agg(F.min("doc_id").alias("least")), "texts")
    copy = index.join(least, "digest", "left").withColumn("own", F.col("least").isNull() | F.col("doc_id").eqNullSafe(F.col("least")))
    copy = stored(copy.select("block", "path", "place", "doc_id", "n_words", "own"), "copies")
    blocks = copy.filter("own").groupBy("block", "path").agg(F.sort_array(F.collect_list("place")).alias("own"))

    def each(frame, make, schema):
        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    yield make(row, Block(row["path"], row["own"], settings))

        return frame.repartitionByRange(tasks, "block").mapInArrow(run, schema)

    def bits_by_block(marks, name):
        return marks.groupBy("block").agg(F.collect_list(F.struct("shard", "bits")).alias(name))

    def send_anchors(row, block):
        found = block.anchors()[1]
        return dealt(row["block"], found, tasks, [found])

    def send_windows(row, block):
        _, found, _, first = block.windows(marks_of(block.anchors()[1], tasks, row["elsewhere"]))
        return dealt(row["block"], found[:, 0], tasks, [found[:, 0], found[:, 1], first])

    def finish(row, block):
        elsewhere = marks_of(block.anchors()[1], tasks, row["elsewhere"])
        gone = block.covered(elsewhere, marks_of(block.windows(elsewhere)[1][:, 0], tasks, row["earlier"]))
        kept = [b" ".join([w for w, g in zip(block.words[a:b], gone[a:b]) if not g]).decode() for a, b in zip(block.at, block.at[1:])]
        removed = np.add.reduceat(np.r_[gone, False].astype(np.int64), block.at[:-1]) * (np.diff(block.at) > 0)
        ids = pa.array(block.ids, mask=block.unknown)
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(block.at)), pa.array(removed), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    sent = "shard int, block bigint, c0 binary"
    anchors = stored(marked_rows(each(blocks, send_anchors, sent), tasks, 1, in_two_blocks), "anchors")
    blocks = stored(blocks.join(bits_by_block(anchors, "elsewhere"), "block", "left"), "blocks")
    windows = marked_rows(each(blocks, send_windows, f"{sent}, c1 binary, c2 binary"), tasks, 3, in_an_earlier_document)
    blocks = stored(blocks.join(bits_by_block(stored(windows, "windows"), "earlier"), "block", "left"), "blocks")
    own = each(blocks, finish, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
    rest = copy.filter("not own").select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit("").alias("kept"))
    return own.union(rest)
