"""Near-duplicates on word shingles with b-bit MinHash signatures."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from scenegrade.llm.common import BROADCAST_IDS, flat, pick, spans, stored, tasks_for
from scenegrade.llm.components import components


@dataclass(frozen=True)
class Settings:
    """Shingle length; percent of overlap for a link; bands of rows minima each; low bits kept of every minimum.

    A pair at 80 percent shares no band with probability (1 - 0.8**4)**40, below 1e-9. `slack` is the number of
    standard deviations by which an estimate may fall short of the limit before a candidate is given up unseen. `block`
    bounds the shingles that a task holds of either side of a comparison.
    """

    words: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 4
    bits: int = 4
    slack: float = 6.0
    block: int = 2_000_000

    def least_equal(self) -> int:
        """Equal b-bit values that a candidate must show: the expectation at the limit, less the slack."""
        n, chance = self.bands * self.rows, 0.5**self.bits
        p = chance + (1 - chance) * self.percent / 100
        return int(n * p - self.slack * (n * p * (1 - p)) ** 0.5)


GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_words: dict[bytes, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text; of all words if there are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > 1_000_000:
        _words.clear()
    for w in set(words):
        if w not in _words:
            _words[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    n, code = len(h) - width + 1, np.full(1, width, np.uint64)
    for k in range(width):
        code = _mixed(code * GOLDEN + h[k : k + n])
    return np.unique(code)


def constants(settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    n = settings.bands * settings.rows
    return rng.integers(0, 2**32, n, np.uint32)[:, None], (rng.integers(0, 2**32, n, np.uint32) | np.uint32(1))[:, None]


def minima(codes: np.ndarray, add: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Least value of each hash function over the codes, in portions so that memory stays bounded."""
    x, best = (codes >> np.uint64(32)).astype(np.uint32), None
    for a in range(0, len(x), 2048):
        part = ((x[None, a : a + 2048] ^ add) * times).min(axis=1)
        best = part if best is None else np.minimum(best, part)
    return best


def packed(least: np.ndarray, bits: int) -> bytes:
    """The low bits of the minima, bit plane by bit plane."""
    planes = (least[None, :] >> np.arange(bits, dtype=np.uint32)[:, None]) & 1
    return np.packbits(planes.astype(np.uint8), axis=1).tobytes()


def equal_values(a: np.ndarray, b: np.ndarray, settings: Settings) -> np.ndarray:
    """Equal b-bit values of packed signatures (rows of bytes), by bit counts over the planes."""
    differ = np.bitwise_or.reduce((a ^ b).reshape(*np.broadcast_shapes(a.shape, b.shape)[:-1], settings.bits, -1), axis=-2)
    return settings.bands * settings.rows - np.bitwise_count(differ).sum(axis=-1, dtype=np.int64)


def estimate(equal, settings: Settings):
    """Similarity corrected for the chance that b low bits of different minima agree."""
    chance = 0.5**settings.bits
    return (equal / (settings.bands * settings.rows) - chance) / (1 - chance)


def sketches(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, n_shingles, digest of the whole set, packed signature, band keys (both null for empty sets)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def run(batches):
        add, times = constants(settings)
        for batch in batches:
            at, data = flat(batch.column("text"))
            data, n, digest, signature, bands = data.tobytes(), [], [], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                codes = shingles(data[a:b], settings.words)
                n.append(len(codes))
                digest.append(xxhash.xxh3_128_digest(codes) if len(codes) else None)
                if not len(codes):
                    signature.append(None)
                    bands.append(None)
                    continue
                least = minima(codes, add, times)
                signature.append(packed(least, settings.bits))
                keys = np.arange(settings.bands, dtype=np.uint64)
                for column in least.astype(np.uint64).reshape(settings.bands, -1).T:
                    keys = _mixed(keys * GOLDEN + column)
                bands.append(keys.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(signature, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "signature", "bands"],
            )

    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, signature binary, bands array<bigint>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(flat(column)[1], np.uint8).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.uint8)


def likely(pairs: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (u, v, su, sv) whose signatures agree in enough values, by vectorised bit counts."""

    def run(batches):
        for batch in batches:
            equal = equal_values(_matrix(batch.column("su")), _matrix(batch.column("sv")), settings)
            found = pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(estimate(equal, settings))], names=["u", "v", "similarity"])
            yield found.filter(pa.array(equal >= settings.least_equal()))

    return pairs.mapInArrow(run, "u bigint, v bigint, similarity double")


def one_sure_hub(pairs: DataFrame, settings: Settings) -> DataFrame:
    """Of the likely pairs (u, v, similarity) of each v, the one with the smallest u that is well above the limit; all if none is."""
    sure = F.when(F.col("similarity") >= settings.percent / 100 + 0.05, F.col("u"))
    best = pairs.groupBy("v").agg(F.min(sure).alias("hub"))
    return pairs.join(best, "v").filter(F.col("hub").isNull() | (F.col("hub") == F.col("u"))).select("u", "v")


def runs(batches, key: list[str]):
    """Record batches of the consecutive rows with equal integer keys, of sorted batches."""
    rest = None
    for batch in batches:
        rest = batch if rest is None or not len(rest) else pa.concat_batches([rest, batch])
        keys = np.stack([rest.column(c).to_numpy() for c in key], 1)
        heads = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else np.zeros(0, int)
        for a, b in zip(heads[:-1], heads[1:]):
            yield rest.slice(a, b - a)
        rest = rest.slice(heads[-1]) if len(heads) else rest
    if rest is not None and len(rest):
        yield rest


def shingle_sets(wanted: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, codes (sorted 64-bit hashes) of the whole texts of the wanted documents, stored."""
    wanted = stored(wanted.distinct(), "wanted")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted  # else the texts are dealt by id
    texts = docs.join(few, "doc_id", "left_semi").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def sets(batches):
        for batch in batches:
            at, data = flat(batch.column("text"))
            data = data.tobytes()
            made = [shingles(data[a:b], settings.words).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], names=["doc_id", "codes"])

    return stored(texts.mapInArrow(sets, "doc_id bigint, codes binary"), "sets")


def joining_links(component: np.ndarray, at: np.ndarray, codes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (places of two sets) that join sets of different components, enough to connect all that have a link.

    codes[at[k]:at[k + 1]] is set k. Every set is written as its differences from a reference B, the shingles that more
    than half of the sets hold: r of B missing, a beyond B. Two sets with s differences in common share |B| - r - r' + s of
    |B| + a + a' - s shingles, so they are linked if and only if (100 + percent) s >= w + w' - h, where
    w = 100 r + percent a and h = (100 - percent) |B|. All with w at most h less the least w are linked to the set that
    has it. Another pair needs s of at least one, so it shares a difference among the rarest ones of both (all but
    s - 1 of either): those are looked up, and s is counted exactly. What nearly all sets of a large group have in
    common is never compared.
    """
    n = len(component)
    owner = np.repeat(np.arange(n), np.diff(at))
    _, token, count = np.unique(codes, return_inverse=True, return_counts=True)
    common = 2 * count > n
    size_b = int(common.sum())
    held = np.zeros((n, size_b), bool)
    inside = common[token]
    held[owner[inside], (np.cumsum(common) - 1)[token[inside]]] = True
    r, a = size_b - held.sum(1), np.diff(at) - held.sum(1)
    w, h = 100 * r + percent * a, (100 - percent) * size_b

    root = {c: c for c in component.tolist()}

    def top(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    found, here = [], component.tolist()

    def link(u, v):
        x, y = top(here[u]), top(here[v])
        if x != y:
            root[x] = y
            found.append((u, v))

    least, first = int(w.min()), int(w.argmin())
    core = w + least <= h
    core[first] = True
    for u in np.flatnonzero(core):
        link(int(u), first)
    if core.all():
        return found

    missing, gap = np.nonzero(~held)
    own = np.concatenate([owner[~inside], missing])
    what = np.concatenate([token[~inside], len(count) + gap])
    times = np.bincount(what, minlength=len(count) + size_b)
    order = np.lexsort((what, times[what], own))
    own, what = own[order], what[order]
    begin = np.searchsorted(own, np.arange(n + 1))
    need = lambda own_w, other_w: -((h - own_w - other_w) // (100 + percent))  # noqa: E731  differences in common, rounded up
    place = np.empty(n, np.int64)
    by_weight = np.argsort(w, kind="stable")
    place[by_weight] = np.arange(n)
    rank = np.arange(len(own)) - begin[own]
    kept = (rank <= (r + a - need(w, np.maximum(w, h - least + 1)))[own]) & (times[what] > 1)
    index = np.sort(what[kept] * n + place[own[kept]])  # rare differences of each set, for sets of no less weight
    mark = np.zeros(len(times), bool)
    for u in by_weight[~core[by_weight]].tolist():
        mine = what[begin[u] : begin[u + 1]]
        rare = mine[: max(0, len(mine) - int(need(w[u], least)) + 1)]
        low, high = np.searchsorted(index, rare * n), np.searchsorted(index, rare * n + place[u])
        near = np.unique(index[spans(low, high - low)] % n)
        near = by_weight[near]
        near = near[[top(here[v]) != top(here[u]) for v in near.tolist()]] if len(near) else near
        if not len(near):
            continue
        mark[mine] = True
        sizes = begin[near + 1] - begin[near]
        hits = np.r_[0, np.cumsum(mark[what[spans(begin[near], sizes)]])]
        ends = np.cumsum(sizes)
        same = hits[ends] - hits[ends - sizes]
        mark[mine] = False
        for v in near[(100 + percent) * same >= w[near] + w[u] - h].tolist():
            link(u, v)
    return found


def hub_tasks(members: DataFrame, settings: Settings) -> DataFrame:
    """(hub, i, j, doc_id, component): documents that a task compares, for buckets of more than one component.

    members: key, doc_id, component, n_shingles, hub (smallest document of the bucket), main (its component). Buckets
    with the same hub go together, so a document comes once for each hub. Documents of the main component are
    dealt into blocks (j), the others into blocks (i), of bounded size; each block of others meets each main block, and,
    with j below 0, each later block of others. A group of one block each sends every document once.
    """
    mixed = members.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b").select("key")
    rows = members.join(mixed, "key", "left_semi").select("hub", "doc_id", "component", "n_shingles", (F.col("component") != F.col("main")).alias("other")).distinct()
    rows = stored(rows, "hub_members")
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.sum(F.when(c, F.col("n_shingles")).otherwise(0)) / F.lit(settings.block))).cast("int")
    plan = stored(rows.groupBy("hub").agg(blocks(F.col("other")).alias("others"), blocks(~F.col("other")).alias("mains")), "hub_blocks")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    to_main = F.transform(upto("mains"), lambda j: F.struct(mine("others").alias("i"), j.alias("j")))
    to_others = F.transform(F.filter(upto("others"), lambda o: o != mine("others")), lambda o: F.struct(F.least(o, mine("others")).alias("i"), (-F.greatest(o, mine("others"))).alias("j")))
    of_main = F.transform(upto("others"), lambda i: F.struct(i.alias("i"), mine("mains").alias("j")))
    dealt = rows.join(plan, "hub").withColumn("at", F.explode(F.when(F.col("other"), F.concat(to_main, to_others)).otherwise(of_main)))
    return dealt.select("hub", "at.i", "at.j", "doc_id", "component")


def joined_components(members: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """Links (u, v) between components, exact on full sets: for all pairs of a bucket that have one, the two are connected."""
    rows = stored(hub_tasks(members, settings), "hub_tasks")
    sets = shingle_sets(rows.select("doc_id"), docs, settings)
    rows = rows.join(sets, "doc_id").repartition(tasks_for(docs), "hub", "i", "j").sortWithinPartitions("hub", "i", "j")

    def run(batches):
        for group in runs(batches, ["hub", "i", "j"]):
            ids, component = (group.column(c).to_numpy() for c in ("doc_id", "component"))
            at, data = flat(group.column("codes"))
            found = np.array(joining_links(component, at // 8, data.view(np.uint64), settings.percent), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids[found[:, 0]]), pa.array(ids[found[:, 1]])], names=["u", "v"])

    return rows.select("hub", "i", "j", "doc_id", "component", "codes").mapInArrow(run, "u bigint, v bigint")


def confirmed(pairs: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """Those of the pairs (u, v) whose full shingle sets overlap enough. Only the sets of their documents are made."""
    wanted = pairs.select(F.col("u").alias("doc_id")).union(pairs.select(F.col("v").alias("doc_id")))
    codes = shingle_sets(wanted, docs, settings)
    both = pairs.join(codes.toDF("u", "cu"), "u").join(codes.toDF("v", "cv"), "v")

    def compare(batches):
        for batch in batches:
            (oa, da), (ob, db) = (flat(batch.column(c)) for c in ("cu", "cv"))
            da, db, oa, ob = da.view(np.uint64), db.view(np.uint64), oa // 8, ob // 8
            link = np.zeros(len(batch), bool)
            for k in range(len(batch)):
                a, b = da[oa[k] : oa[k + 1]], db[ob[k] : ob[k + 1]]
                if 100 * min(len(a), len(b)) >= settings.percent * max(len(a), len(b)):
                    common = np.intersect1d(a, b, assume_unique=True).size
                    link[k] = 100 * common >= settings.percent * (len(a) + len(b) - common)
            yield batch.select(["u", "v"]).filter(pa.array(link))

    return both.select("u", "v", "cu", "cv").mapInArrow(compare, "u bigint, v bigint").distinct()


def near_duplicates(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per row of `documents`: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    Documents with equal sets form a class, represented by its smallest id. Representatives meet in buckets of equal
    band keys. First, each is compared with the smallest of each bucket, its hub (as many pairs as bucket rows), as far as
    their signatures look likely. Then the buckets that still hold several components are searched for links between
    them, by the differences of their sets from what most of them share. Every link is exact on full sets, and
    nothing is capped.

    Words are lower-cased A-Z only. Null, empty and blank texts have no shingles, are linked with nothing and kept.
    Rows with the same id count as one node, so all their texts share a component. Rows with a null id are linked
    with nothing, have no component and are kept.
    """
    given = pick(documents, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    sketch = stored(sketches(given, settings), "sketches")
    docs = given.filter("doc_id is not null")
    real = sketch.filter("n_shingles > 0 and doc_id is not null")
    classes = real.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    copies = real.select("doc_id", "digest").join(classes, "digest").filter("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    reps = stored(real.join(classes, (real["digest"] == classes["digest"]) & (real["doc_id"] == classes["rep"]), "left_semi").dropDuplicates(["doc_id", "digest"]), "reps")

    rows = reps.select(F.explode("bands").alias("key"), "doc_id", "n_shingles")
    hubs = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("doc_id", "n_shingles")).alias("hub"))
    buckets = stored(rows.join(hubs.filter("size > 1"), "key"), "buckets")
    fits = 100 * F.least("n_shingles", "hub.n_shingles") >= settings.percent * F.greatest("n_shingles", "hub.n_shingles")
    star = buckets.filter(fits & (F.col("doc_id") != F.col("hub.doc_id"))).select(F.col("hub.doc_id").alias("u"), F.col("doc_id").alias("v")).distinct()
    signs = reps.select("doc_id", "signature")
    signed = star.join(signs.toDF("u", "su"), "u").join(signs.toDF("v", "sv"), "v")
    first = stored(confirmed(stored(one_sure_hub(stored(likely(signed.select("u", "v", "su", "sv"), settings), "likely"), settings), "candidates"), docs, settings), "confirmed")

    groups = components(first)
    here = F.coalesce("component", "doc_id").alias("component")
    of_hub = groups.select(F.col("node").alias("hub"), F.col("component").alias("main"))
    members = buckets.select("key", "doc_id", "n_shingles", "hub.doc_id").toDF("key", "doc_id", "n_shingles", "hub")
    members = members.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", "n_shingles", "hub", here)
    members = members.join(of_hub, "hub", "left").withColumn("main", F.coalesce("main", "hub"))
    second = joined_components(stored(members, "members"), docs, settings)

    found = components(first.union(second).union(copies))
    out = sketch.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of `documents` that are kept, with all columns; rows with a null id stay."""
    gone = near_duplicates(documents, settings).filter("not kept").select(F.col("doc_id").alias("gone")).distinct()
    names = documents.columns
    unique = documents.toDF(*[f"_{i}" for i in range(len(names))])
    return unique.join(gone, unique[f"_{names.index('doc_id')}"] == F.col("gone"), "left_anti").toDF(*names)
