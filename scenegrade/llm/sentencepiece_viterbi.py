"""SentencePiece encoding and decoding by batched dynamic programming in numpy."""

import heapq
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scenegrade.llm.common import pick

SPACE = "▁"
BASE = 0x100000001B3
#: Words whose ids a worker remembers.
REMEMBERED = 800_000
#: Sizes of the bit table over piece hashes and of the table of remembered pairs.
TABLE_BITS, MEMORY_BITS = 22, 21
UNIGRAM, BPE = 1, 2
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _hash(codes: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes of equally long words (rows of code points): column i covers the first i."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * np.uint64(BASE) + codes[:, i] + np.uint64(1)
    return out


@dataclass
class Vocabulary:
    """A model file as arrays: sorted hashes of pieces, their ids, scores, lengths and last merges."""

    kind: int
    names: list[str]
    keys: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    hashes: np.ndarray
    lengths: np.ndarray
    left: np.ndarray
    right: np.ndarray
    whole: np.ndarray  # BPE: pieces that their own text encodes to
    bytes_of: list[bytes]
    byte_ids: list[int]
    unknown: int
    prefix: bool
    maybe: np.ndarray = field(init=False)

    def __post_init__(self):
        self.maybe = np.zeros(1 << TABLE_BITS, bool)
        self.maybe[self.keys >> np.uint64(64 - TABLE_BITS)] = True


def _merge(text: str, score: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """Pieces of a text after all merges, best score first, then leftmost; and the last merge. O(n log n)."""
    part, n = list(text), len(text)
    after, before, heap, last = list(range(1, n + 1)), list(range(-1, n - 1)), [], None

    def offer(i):
        j = after[i] if i >= 0 else n
        if i >= 0 and j < n and part[i] + part[j] in score:
            heapq.heappush(heap, (-score[part[i] + part[j]], i, part[i], part[j], j))

    for i in range(n):
        offer(i)
    while heap:
        _, i, a, b, j = heapq.heappop(heap)
        if part[i] != a or part[j] != b or after[i] != j:
            continue
        part[i], part[j], last = a + b, "", (a, b)
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [p for p in part if p], last


def load(path: str) -> Vocabulary:
    """Vocabulary of a unigram or BPE model with identity normalisation and byte fallback; others are refused."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kind, norm = model.trainer_spec.model_type, model.normalizer_spec
    if kind not in (UNIGRAM, BPE) or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not model.trainer_spec.byte_fallback:
        raise ValueError(f"{path}: only unigram and BPE models with plain normalisation and byte fallback are read")
    names = [p.piece for p in model.pieces]
    normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
    if any(p.type == 4 for p in model.pieces) or any(SPACE in p.lstrip(SPACE) or p.startswith(2 * SPACE) and p.strip(SPACE) for p in normal):
        raise ValueError(f"{path}: pieces across words and user-defined pieces aren't supported")
    n = len(names)
    scores = np.array([p.score for p in model.pieces], np.float64)
    lengths, hashes = np.array([len(p) for p in names], np.int64), np.zeros(n, np.uint64)
    for i, p in enumerate(names):
        hashes[i] = _hash(np.frombuffer(p.encode("utf-32-le"), np.uint32)[None].astype(np.uint64))[0, -1]
    left, right, whole = np.full(n, -1), np.full(n, -1), np.zeros(n, bool)
    if kind == BPE:
        score = {p: float(scores[i]) for p, i in normal.items()}
        for p, i in normal.items():
            parts, last = _merge(p, score) if p.strip(SPACE) or p == SPACE else ([], None)
            whole[i] = parts == [p]
            if whole[i] and last:
                left[i], right[i] = (normal.get(x, -1) for x in last)
                # validity of pairs rests on parts having been learned before the whole
                if any(len(x) > 1 and score[x] < score[p] for x in last):
                    raise ValueError(f"{path}: piece {p!r} scores above its parts")
    else:
        whole[list(normal.values())] = True
    known = np.array(sorted(normal.values(), key=lambda i: hashes[i]), np.int64)
    keys = hashes[known]
    if len(np.unique(keys)) != len(keys):
        raise ValueError("piece hashes collide")
    byte_ids = [names.index(f"<0x{b:02X}>") for b in range(256)]
    out = [p.replace(SPACE, " ").encode() for p in names]
    for b, i in enumerate(byte_ids):
        out[i] = bytes([b])
    for i, p in enumerate(model.pieces):
        if p.type in (2, 3):
            out[i] = b"" if p.type == 3 else b" \xe2\x81\x87 "
    return Vocabulary(kind, names, keys, known, scores, hashes, lengths, left, right, whole, out, byte_ids, n, norm.add_dummy_prefix)


def probe(v: Vocabulary, h: np.ndarray) -> np.ndarray:
    """Ids of hashed substrings, -1 where there is no such piece: a bit table leaves few for the search in the keys."""
    out = np.full(h.shape, -1)
    some = np.flatnonzero(v.maybe[(h >> np.uint64(64 - TABLE_BITS)).ravel()])
    asked = h.ravel()[some]
    at = np.searchsorted(v.keys, asked).clip(0, len(v.keys) - 1)
    out.ravel()[some] = np.where(v.keys[at] == asked, v.ids[at], -1)
    return out


def compatible(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether BPE leaves the pieces a, b apart when their texts stand side by side.

    Going back in time from the finished pair, the later of both merges is undone; at every moment the pair that touches
    must have no merge that was due before the next merge on either side (of equal scores the left one goes first).
    """
    power = np.uint64(BASE) ** np.arange(1, int(v.lengths.max()) + 1, dtype=np.uint64)
    ok = np.ones(len(a), bool)
    x, y, todo = a.copy(), b.copy(), np.arange(len(a))
    next_x, next_y = np.full(len(a), -np.inf), np.full(len(a), -np.inf)
    while len(todo):
        p, q = x[todo], y[todo]
        both = probe(v, v.hashes[p] * power[v.lengths[q] - 1] + v.hashes[q])
        due = np.where(both >= 0, v.scores[both], -np.inf)
        joins = (both >= 0) & (due > next_x[todo]) & (due >= next_y[todo])
        ok[todo[joins]] = False
        made_x, made_y = v.left[p] >= 0, v.left[q] >= 0
        more = ~joins & (made_x | made_y)
        todo, p, q, made_x, made_y = todo[more], p[more], q[more], made_x[more], made_y[more]
        score_x, score_y = np.where(made_x, v.scores[p], np.inf), np.where(made_y, v.scores[q], np.inf)
        undo_x = score_x < score_y
        next_x[todo[undo_x]], x[todo[undo_x]] = score_x[undo_x], v.right[p[undo_x]]
        next_y[todo[~undo_x]], y[todo[~undo_x]] = score_y[~undo_x], v.left[q[~undo_x]]
    return ok


class Pairs:
    """Answers of `compatible`, remembered in a table with one place for each hash: bounded, newer pairs replace older."""

    def __init__(self, v: Vocabulary):
        self.v, self.keys, self.ok = v, np.full(1 << MEMORY_BITS, -1), np.zeros(1 << MEMORY_BITS, bool)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = self.v.unknown + 1
        pair = a.astype(np.int64) * n + b
        place = ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MEMORY_BITS)).astype(np.int64)
        out, miss = self.ok[place], np.flatnonzero(self.keys[place] != pair)
        if len(miss):
            new, back = np.unique(pair[miss], return_inverse=True)
            answer = compatible(self.v, new // n, new % n)[back]
            out[miss] = answer
            # Both tables are written in one order, so a place that two pairs share holds one of them whole.
            last = np.unique(place[miss][::-1], return_index=True)[1]
            chosen = miss[len(miss) - 1 - last]
            self.keys[place[chosen]], self.ok[place[chosen]] = pair[chosen], out[chosen]
        return out


def segment(v: Vocabulary, words: list[str], pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of equally long words, all advanced together: ids one after the other, and where each word's begin.

    At each end i, all substrings that end there are probed at once. Unigram: the score is the best of the prefix plus
    the piece's. BPE: a piece counts if it is compatible with the last piece of the prefix's encoding, which exactly one is.
    The maximum is stored as a back pointer (the longest piece among equals). Characters without a piece are `unknown`.
    """
    n, many, longest = len(words[0]), len(words), int(v.lengths[v.ids].max())
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(many, n).astype(np.uint64)
    h = _hash(codes)
    power = np.uint64(BASE) ** np.arange(longest + 1, dtype=np.uint64)
    lowest = v.scores[v.ids].min() - 10
    last, back = np.full((many, n + 1), -1), np.zeros((many, n + 1), np.int32)
    best = np.zeros((many, n + 1))
    for i in range(1, n + 1):
        sizes = np.arange(min(i, longest), 0, -1)
        found = probe(v, h[:, i, None] - h[:, i - sizes] * power[sizes])
        single = found[:, -1]
        single[single < 0] = v.unknown
        row, at = np.nonzero(found >= 0)  # by row, longest first
        piece, size = found[row, at], sizes[at]
        good = (piece == v.unknown) | v.whole[np.minimum(piece, v.unknown - 1)]
        row, piece, size = row[good], piece[good], size[good]
        cut = i - size
        before = last[row, cut]
        if v.kind == BPE:
            ask = np.flatnonzero((before >= 0) & (before != v.unknown) & (piece != v.unknown))
            free = np.ones(len(row), bool)
            free[ask] = pairs(before[ask], piece[ask])
            row, piece, cut = row[free], piece[free], cut[free]
        else:
            gain = best[row, cut] + np.where(piece == v.unknown, lowest, v.scores[np.minimum(piece, v.unknown - 1)])
            order = np.lexsort((-gain, row))
            row, piece, cut = row[order], piece[order], cut[order]
            best[row[::-1], i] = gain[order][::-1]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        last[row[first], i], back[row[first], i] = piece[first], cut[first]
    used, end = np.zeros((many, n + 1), bool), np.full(many, n)
    for i in range(n, 0, -1):
        here = np.flatnonzero(end == i)
        used[here, i] = True
        end[here] = back[here, i]
    return last[used].astype(np.uint32), np.concatenate([[0], np.cumsum(used.sum(axis=1))])


class Codec:
    """Encodes and decodes whole texts; words are remembered by their ids."""

    def __init__(self, v: Vocabulary):
        self.v, self.pairs, self.known = v, Pairs(v), {}
        self.normal = {v.names[i]: i for i in v.ids.tolist()}
        self.score = {p: float(v.scores[i]) for p, i in self.normal.items()}

    def _spelled(self, ids: list[int], word: str) -> list[int]:
        """`unknown` replaced by the bytes of the character."""
        out, i = [], 0
        for t in ids:
            if t == self.v.unknown:
                out += [self.v.byte_ids[b] for b in word[i].encode()]
                i += 1
            else:
                out.append(t)
                i += len(self.v.names[t])
        return out

    def _learn(self, words: list[str]) -> None:
        """Ids of words; in BPE, marks in front of a word's last one are left out and merged after all else."""
        by_length: dict[int, list[tuple[str, int]]] = {}
        for w in words:
            head = len(w) - len(w.lstrip(SPACE)) - 1 if self.v.kind == BPE and w.startswith(2 * SPACE) else 0
            by_length.setdefault(len(w) - head, []).append((w, head))
        for n, group in by_length.items():
            step = max(1, 200_000 // max(1, n))
            for part in (group[a : a + step] for a in range(0, len(group), step)):
                ids, at = segment(self.v, [w[head:] for w, head in part], self.pairs)
                odd = np.add.reduceat(ids == self.v.unknown, at[:-1]) > 0
                data, at = ids.tobytes(), (4 * at).tolist()
                for k, (w, head) in enumerate(part):
                    found = data[at[k] : at[k + 1]]
                    if head or odd[k]:
                        own = np.frombuffer(found, "<u4").tolist()
                        alone = bool(head) and own[0] == self.normal.get(SPACE)
                        own = self._spelled(own, w[head:])
                        if head:
                            run = _merge(SPACE * (head + alone), self.score)[0]
                            own = [self.normal[r] for r in run] + own[alone:]
                        found = np.array(own, "<u4").tobytes()
                    self.known[w] = found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        split = []
        for text in texts:
            text = (SPACE if self.v.prefix else "") + text.replace(" ", SPACE) if text else ""
            split.append(WORDS.findall(text))
        self._learn(list({w for words in split for w in words if w not in self.known}))
        return [b"".join([self.known[w] for w in words]) for words in split]

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.v.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.v.prefix and text.startswith(" ") else text


_codecs: dict[str, Codec] = {}


def worker_codec(path: str) -> Codec:
    """One codec for each Python worker and file."""
    if path not in _codecs:
        _codecs[path] = Codec(load(path))
    return _codecs[path]


def portions(texts: list[str], chars: int = 1 << 21):
    """Consecutive texts of about `chars` characters at a time, so that few ids are held at once."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def round_trips(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of the ids as u32), n_decoded (characters of the decoded text), same (decoded = text).

    Whole texts are encoded and the ids decoded again. Null counts as empty: no ids, empty text. A text with the mark
    U+2581 itself decodes to spaces there, as with the library, so `same` is false.
    """
    rows = pick(docs, doc_id="doc_id", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        codec = worker_codec(model)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = []
            for part in portions(texts):
                for text, ids in zip(part, codec.encode(part)):
                    back = codec.decode(ids)
                    found.append((len(ids) // 4, zlib.crc32(ids), len(back), back == text))
            n, crc, chars, same = map(list, zip(*found)) if found else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, crc, chars)), pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "ids_crc32", "n_decoded", "same"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_ids bigint, ids_crc32 bigint, n_decoded bigint, same boolean")
