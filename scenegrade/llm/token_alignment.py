"""Alignment of the tokens of two tokenizers by byte offsets, with corpus counts of linked id pairs."""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from scenegrade.llm.common import gathered, pick, spans, stored, tasks_for
from scenegrade.llm.token_blocks import worker_encoder


@dataclass(frozen=True)
class Settings:
    """Bytes of text of one block (a longer text is one block); distinct groups and pairs that a task holds back."""

    block: int = 1 << 20
    held: int = 1 << 20


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and the tokens' spellings in a description of groups."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece

        self.a = worker_encoder(byte_level, special_as_text=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        of = byte_of_character()
        names = [self.a.library.id_to_token(i) or "" for i in range(self.a.library.get_vocab_size())]
        bytes_a = [bytes(of[c] for c in x) if all(c in of for c in x) else x.encode() for x in names]
        n = self.b.get_piece_size()
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(n)))]
        self.bytes = [pa.array(x, pa.large_binary()) for x in (bytes_a, bytes_b)]
        self.sizes = [len(bytes_a), n]
        self.spelled = pa.array([f"{i}{end}".encode() for m in self.sizes for i in range(m) for end in ",|;"] + [f"{i}".encode() for i in range(n)], pa.large_binary())

    def encode(self, texts: list[str]) -> list[pa.Array]:
        """The ids of all texts as lists, by either tokenizer."""
        ids, ends = self.a([" " + t for t in texts])
        found = self.b.encode(texts, num_threads=1)
        return [pa.LargeListArray.from_arrays(ends.astype(np.int64), ids.astype(np.int32)), pa.array(found, pa.large_list(pa.int32()))]


_tokenizers: dict[tuple[str, str], Tokenizers] = {}


def worker_tokenizers(byte_level: str, pieces: str) -> Tokenizers:
    if (byte_level, pieces) not in _tokenizers:
        _tokenizers[byte_level, pieces] = Tokenizers(byte_level, pieces)
    return _tokenizers[byte_level, pieces]


def mixed(x: np.ndarray, lane: int) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[lane])
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)


def before(n: np.ndarray) -> np.ndarray:
    """Sum of the entries before each one."""
    return np.cumsum(n) - n


class Aligned:
    """The groups of a list of texts, none of them null or empty, and what they link."""

    def __init__(self, texts: list[str], tools: Tokenizers):
        lists = tools.encode(texts)
        sides = [(pc.list_parent_indices(x).to_numpy(), pc.list_flatten(x)) for x in lists]
        spelt = [pc.take(values, ids) for values, (_, ids) in zip(tools.bytes, sides)]
        places = [np.frombuffer(x.buffers()[1], np.int64)[: len(x) + 1] if len(x) else np.zeros(1, np.int64) for x in spelt]  # running sums of the tokens' bytes
        heads = [at[x.offsets.to_numpy()] for at, x in zip(places, lists)]
        joined = [bytes(x.buffers()[2]) if x.buffers()[2] else b"" for x in spelt]
        self.ok = np.array([all(j[h[k] : h[k + 1]] == b" " + t.encode() for j, h in zip(joined, heads)) for k, t in enumerate(texts)], bool)

        def tokens(k):
            doc, ids = sides[k]
            end = places[k][1:] - heads[k][doc]  # running sum within the document
            own = np.flatnonzero(self.ok[doc])
            return doc[own], ids.to_numpy()[own], end[own]

        (self.doc_a, self.a, end_a), (self.doc_b, self.b, end_b) = tokens(0), tokens(1)
        left, right = (pa.table({"doc": d, "end": e, name: np.arange(len(d))}) for name, d, e in (("i", self.doc_a, end_a), ("j", self.doc_b, end_b)))
        both = left.join(right, ["doc", "end"], join_type="inner", use_threads=False)
        cut_a, cut_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        cut_a[both["i"].to_numpy()], cut_b[both["j"].to_numpy()] = True, True
        self.group_a, self.group_b = before(cut_a.astype(np.int64)), before(cut_b.astype(np.int64))
        self.doc = self.doc_a[cut_a]
        self.n_a, self.n_b = (np.bincount(g, minlength=len(self.doc)) for g in (self.group_a, self.group_b))
        self.first_a, self.first_b = before(self.n_a), before(self.n_b)
        self.in_a, self.in_b = (np.arange(len(g)) - first[g] for g, first in ((self.group_a, self.first_a), (self.group_b, self.first_b)))
        self.texts, self.tools = len(texts), tools

    def numbers(self) -> list[np.ndarray]:
        """n_a, n_b, n_groups, n_links of each text."""
        count = lambda doc, n: np.bincount(doc, n, self.texts).astype(np.int64)
        return [count(self.doc_a, None), count(self.doc_b, None), count(self.doc, None), count(self.doc, self.n_a * self.n_b)]

    def described(self) -> list[bytes]:
        """The groups of each text in words: `a1,a2|b1;a3|b2,b3`."""
        start, n = before(self.n_a + self.n_b), self.tools.sizes
        out = np.zeros(len(self.a) + len(self.b), np.int64)
        last_of_doc = np.r_[self.doc[1:] != self.doc[:-1], True] if len(self.doc) else np.zeros(0, bool)
        out[start[self.group_a] + self.in_a] = 3 * self.a.astype(np.int64) + (self.in_a == self.n_a[self.group_a] - 1)
        end = self.in_b == self.n_b[self.group_b] - 1
        plain = end & last_of_doc[self.group_b]
        out[start[self.group_b] + self.n_a[self.group_b] + self.in_b] = np.where(plain, 3 * sum(n) + self.b, 3 * (n[0] + self.b.astype(np.int64)) + 2 * end)
        text = pc.take(self.tools.spelled, pa.array(out))
        at = np.frombuffer(text.buffers()[1], np.int64)[: len(out) + 1] if len(out) else np.zeros(1, np.int64)
        data = memoryview(text.buffers()[2] or b"")
        ends = at[np.cumsum(np.bincount(self.doc_a, minlength=self.texts) + np.bincount(self.doc_b, minlength=self.texts))]
        return [bytes(data[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def codes(self) -> list[np.ndarray]:
        """Two 64-bit codes of each group, by its ids on either side in order."""
        out = []
        for lane in (0, 1):
            x = [mixed(mixed(ids * 2 + side, lane) + place.astype(np.uint64), lane) for side, (ids, place) in enumerate(((self.a.astype(np.int64), self.in_a), (self.b.astype(np.int64), self.in_b)))]
            sums = [np.add.reduceat(v, first) if len(first) else v for v, first in zip(x, (self.first_a, self.first_b))]
            out.append(mixed(sums[0] * np.uint64(3) + sums[1], lane))
        return out

    def counted(self, groups: np.ndarray, ids: np.ndarray, first: np.ndarray, n: np.ndarray):
        """Distinct ids of the groups: for each group its place in `groups`, the id, how often it stands there."""
        own = np.repeat(np.arange(len(groups)), n[groups])
        pairs = pa.table({"g": own, "id": ids[spans(first[groups], n[groups])].astype(np.int64)})
        found = pairs.group_by(["g", "id"], use_threads=False).aggregate([([], "count_all")]).sort_by([("g", "ascending"), ("id", "ascending")])
        return [found[c].to_numpy() for c in ("g", "id", "count_all")]

    def links_of(self, groups: np.ndarray):
        """Distinct id pairs of the groups: sizes by group, then a, b and number of token pairs of each."""
        (ga, a, ca), (gb, b, cb) = self.counted(groups, self.a, self.first_a, self.n_a), self.counted(groups, self.b, self.first_b, self.n_b)
        da, db = (np.bincount(g, minlength=len(groups)) for g in (ga, gb))
        i = np.repeat(np.arange(len(a)), db[ga])
        j = spans(before(db)[ga], db[ga])
        return da * db, a[i], b[j], ca[i] * cb[j]


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte, so that storage compresses the high ones."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


FACTS = "kind string, block bigint, g bigint, other bigint, a array<int>, b array<int>, n array<bigint>, ids array<bigint>, numbers binary, digests binary, uses array<binary>, keys binary"
KIND = pa.schema([
    ("kind", pa.string()), ("block", pa.int64()), ("g", pa.int64()), ("other", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())),
    ("n", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("numbers", pa.binary()), ("digests", pa.binary()), ("uses", pa.list_(pa.binary())), ("keys", pa.binary()),
])


def batch_of(kind: str, rows: int, **columns) -> pa.RecordBatch:
    """A batch of `rows` rows of FACTS with these columns, the others null."""
    given = {"kind": pa.array([kind] * rows), **columns}
    return pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(rows, f.type) for f in KIND], schema=KIND)


def lists(values: np.ndarray, sizes: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values, kind))


def facts(docs: DataFrame, byte_level: str, pieces: str, settings: Settings) -> DataFrame:
    """One pass over all texts. Rows of three kinds:

    block: the documents of a block with their numbers and digests, the distinct groups of each document with how often
    they occur (places among the block's groups), and the codes of the block's groups in ascending order;
    group: code, second code and links (a, b, n) of a group, once a task as far as it remembers;
    pair: partial counts (a, b, n) of the documents that hold a pair linked.
    """

    def run(batches):
        tools, part, number = worker_tokenizers(byte_level, pieces), TaskContext.get().partitionId(), 0
        told, counts = np.zeros(0, np.uint64), []

        def pair_batches():
            merged = pa.concat_tables(counts).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")])
            a, b, n = (merged[c].to_numpy() for c in ("a", "b", "n_sum"))
            sizes = np.diff(np.r_[np.arange(0, len(a), 4096), len(a)])
            yield batch_of("pair", len(sizes), a=lists(a, sizes, pa.int32()), b=lists(b, sizes, pa.int32()), n=lists(n, sizes, pa.int64()))

        for batch in gathered(batches, "text", settings.block):
            texts = batch.column("text").to_pylist()
            full = np.array([bool(t) for t in texts], bool)
            x = Aligned([t for t in texts if t], tools)
            (code, other), place = x.codes(), np.flatnonzero(full)
            keys, first, which = np.unique(code, return_index=True, return_inverse=True)
            uses, times = np.unique(x.doc * len(keys) + which, return_counts=True) if len(keys) else (np.zeros(0, np.int64),) * 2
            doc, use = (uses // len(keys), uses % len(keys)) if len(keys) else (uses, uses)
            numbers = np.zeros((5, len(texts)), np.int64)
            numbers[:4, place] = x.numbers()
            numbers[4, place] = np.bincount(doc, minlength=x.texts)
            digests = np.zeros((len(texts), 32), np.uint8)
            for k, d in zip(place, x.described()):
                digests[k] = np.frombuffer(hashlib.sha256(d).digest(), np.uint8) if d else 0
            yield batch_of(
                "block", 1, block=pa.array([part << 32 | number]), ids=pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), batch.column("doc_id")), numbers=pa.array([numbers.tobytes()]),
                digests=pa.array([digests.tobytes()]), uses=pa.array([[planes(use), planes(times)]], pa.list_(pa.binary())), keys=pa.array([keys.tobytes()]),
            )
            number += 1
            if not len(keys):
                continue
            sizes, a, b, n = x.links_of(first)
            at = before(sizes)
            of_doc = pa.table({"doc": np.repeat(doc, sizes[use]), "k": spans(at[use], sizes[use])})
            of_doc = pa.table({"doc": of_doc["doc"], "a": a[of_doc["k"].to_numpy()], "b": b[of_doc["k"].to_numpy()]})
            held = of_doc.group_by(["doc", "a", "b"], use_threads=False).aggregate([])
            counts.append(held.group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["a", "b", "n"]))
            if sum(map(len, counts)) > settings.held:
                yield from pair_batches()
                counts.clear()
            new = np.flatnonzero(~np.isin(keys, told, assume_unique=True))
            told = np.union1d(told, keys[new]) if len(told) + len(new) <= settings.held else keys
            for some in np.array_split(new, -(-len(new) // 20_000)) if len(new) else []:
                k = spans(at[some], sizes[some])
                yield batch_of(
                    "group", len(some), g=pa.array(keys[some].view(np.int64)), other=pa.array(other[first[some]].view(np.int64)),
                    a=lists(a[k], sizes[some], pa.int32()), b=lists(b[k], sizes[some], pa.int32()), n=lists(n[k], sizes[some], pa.int64()),
                )
        if counts:
            yield from pair_batches()

    return docs.select("doc_id", "text").mapInArrow(run, FACTS)


def pair_counts(made: DataFrame) -> DataFrame:
    """a, b, documents (that hold the pair linked), best (whether no other b has more with this a), over the whole corpus."""
    pair = made.filter("kind = 'pair'").select(F.explode(F.arrays_zip("a", "b", "n")).alias("p"))
    counts = stored(pair.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("p.n").alias("documents")), "pairs")
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))
    return stored(counts.join(most, "a").select("a", "b", "documents", (F.col("documents") == F.col("most")).alias("best")), "counts")


def group_values(made: DataFrame, counts: DataFrame) -> DataFrame:
    """g, total (documents summed over the links of the group), best (links whose pair is the best of its a)."""
    once = made.filter("kind = 'group'").groupBy("g").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.first("n").alias("n"), F.min("other").alias("low"), F.max("other").alias("high"))
    sound = F.when(F.col("low") == F.col("high"), F.col("g")).otherwise(F.raise_error(F.lit("two groups have the same 64-bit code")).cast("bigint"))
    links = stored(once.select(sound.alias("g"), F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("g", F.col("p.a").alias("a"), F.col("p.b").alias("b"), F.col("p.n").alias("n")), "links")
    valued = links.join(counts, ["a", "b"])
    return valued.groupBy("g").agg(F.sum(F.col("n") * F.col("documents")).alias("total"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("best"))


def answered(values: DataFrame, blocks: DataFrame, shards: int) -> DataFrame:
    """(block, shard, total, best): the values of the block's groups in each shard, in the order of their codes.

    Codes are dealt to shards by their high bits. A block asks once for each of its groups, however many of its
    documents hold them.
    """

    def shard_of(codes):
        return ((codes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)

    def ask(batches):
        for batch in batches:
            for block, keys in zip(batch.column("block").to_pylist(), batch.column("keys").to_pylist()):
                codes = np.frombuffer(keys, np.uint64)
                cuts = np.searchsorted(shard_of(codes), np.arange(shards + 1, dtype=np.uint64))
                full = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()), pa.array([codes[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary())],
                    names=["shard", "block", "keys"],
                )

    def with_shard(batches):
        for batch in batches:
            shard = shard_of(batch.column("g").to_numpy().view(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns], names=["shard", "g", "total", "best"])

    asked = blocks.select("block", "keys").mapInArrow(ask, "shard int, block bigint, keys binary")
    known = values.mapInArrow(with_shard, "shard int, g bigint, total bigint, best bigint")
    rows = known.withColumn("block", F.lit(-1).cast("bigint")).unionByName(asked, allowMissingColumns=True)
    rows = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "block").select("shard", "block", "keys", "g", "total", "best")

    def run(batches):
        now, table, held = None, None, []
        for batch in batches:
            shard, block = batch.column("shard").to_numpy(), batch.column("block").to_numpy()
            for rows in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(shard)) + 1):
                if shard[rows[0]] != now:
                    now, table, held = shard[rows[0]], None, []
                given = rows[block[rows] < 0]
                if len(given):
                    held.append(np.stack([batch.column(c).take(pa.array(given)).to_numpy() for c in ("g", "total", "best")]))
                for k in rows[block[rows] >= 0]:
                    if table is None:
                        table = np.concatenate(held, axis=1)
                        table = table[:, np.argsort(table[0].astype(np.uint64))]
                        codes, table = table[0].astype(np.uint64), table[1:]
                    at = np.searchsorted(codes, np.frombuffer(batch.column("keys")[k].as_buffer(), np.uint64))
                    answer = [pa.array([v[at].tobytes()], pa.binary()) for v in table]
                    yield pa.RecordBatch.from_arrays([pa.array([block[k]]), pa.array([now], pa.int32()), *answer], names=["block", "shard", "total", "best"])

    return rows.mapInArrow(run, "block bigint, shard int, total binary, best binary")


def alignment(documents: DataFrame, byte_level: str, pieces: str, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Documents with their links, and the corpus counts (a, b, documents, best) of all linked id pairs.

    Tokens A are those of a space and the text by a byte-level BPE file, tokens B those of the text by a piece model that
    puts the space itself; strings of special tokens are ordinary text. Where tokens of both end at the same byte, the text
    is cut; all A and B tokens of a group between cuts are linked. Per row of `documents`: doc_id, n_a, n_b, n_groups,
    n_links, n_best (links whose pair has the most documents of its a, ties included), count_sum (documents summed
    over the links), groups_sha256.

    Null and empty texts, and those whose tokens of either side do not spell a space and the text, have no tokens:
    zeros and an empty digest. Repeated rows, ids and null ids stand for documents of their own.
    """
    given = pick(documents, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    made = stored(facts(given, byte_level, pieces, settings), "facts")
    blocks = made.filter("kind = 'block'")
    counts = pair_counts(made)
    values = stored(group_values(made, counts), "values")
    answers = stored(answered(values, blocks, tasks_for(documents)), "answers")
    by_block = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "total", "best"))).alias("answers"))
    whole = blocks.select("block", "ids", "numbers", "digests", "uses").join(by_block, "block", "left")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["ids"])
                numbers, digests = np.frombuffer(row["numbers"], np.int64).reshape(5, n), np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
                use, times = map(from_planes, row["uses"])
                ends, sums = np.cumsum(numbers[4]), []
                for name in ("best", "total"):
                    value = np.frombuffer(b"".join(x[name] for x in row["answers"] or []), np.int64)
                    total = np.r_[0, np.cumsum(value[use] * times)]
                    sums.append(total[ends] - total[ends - numbers[4]])
                text = [d.tobytes().hex() if groups else "" for d, groups in zip(digests, numbers[2])]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), *map(pa.array, numbers[:4]), *map(pa.array, sums), pa.array(text)], names=COLUMNS)

    out = whole.mapInArrow(run, ", ".join(f"{c} bigint" for c in COLUMNS[:-1]) + ", groups_sha256 string")
    return out, counts


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
