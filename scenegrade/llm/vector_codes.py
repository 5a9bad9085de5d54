"""Product codes of vectors: exact Lloyd rounds in integers over partition-local cover trees."""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scenegrade.llm.common import pick, spans, stored


@dataclass(frozen=True)
class Settings:
    """A component x counts as floor(scale * x). Vectors are cut into `parts`, each with `entries` codebook entries.

    `tree` is the number of vectors of one cover tree, `leaf` the number of points up to which a node is not split.
    """

    scale: int = 1024
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    tree: int = 1024
    leaf: int = 4


#: Components of a vector part that share one row of partial sums.
WIDTH = 16
#: Largest magnitude of an integer component: squared distances and sums then stay within 64 bits.
LARGEST = 1 << 24
#: Columns of a tree's node table: range of points, centre, squared radius, range of children.
BEGIN, END, CENTRE, RADIUS2, FIRST, LAST = range(6)
TREES = "array<struct<points:binary,weights:binary,members:binary,nodes:binary>>"


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of a to all rows of b, as integers in float64 or int64."""
    most = int(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)))
    kind = np.float64 if a.shape[1] * (2 * most) ** 2 < 1 << 53 else np.int64  # float64 only where it is exact
    a, b = a.astype(kind), b.astype(kind)
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]


def among(alive: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """The distances, those to entries that are out of the question as large as can be."""
    return np.where(alive, distance, np.inf if distance.dtype == np.float64 else np.iinfo(np.int64).max)


def cover_tree(points: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the distinct points and node table of their cover tree.

    The children of a node are balls of half its radius around points of it, the first around its own centre; each next
    centre is a point that no earlier ball holds, so centres of a node lie more than that radius apart. The points of
    a subtree are neighbours in the order, children of a node are neighbours in the table.
    """
    distance, order = squared(points, points), np.arange(len(points))
    nodes = [[0, len(points), 0, int(distance[0].max()), 0, 0]]
    k = 0
    while k < len(nodes):
        begin, end, centre, radius2 = nodes[k][:4]
        if end - begin > leaf and radius2:
            left, at = order[begin:end].copy(), begin
            nodes[k][FIRST] = len(nodes)
            while len(left):
                reach = distance[centre][left]
                near = 4 * reach <= radius2
                inside = left[near]
                order[at : at + len(inside)] = inside
                nodes.append([at, at + len(inside), centre, int(reach[near].max()), 0, 0])
                at += len(inside)
                left = left[~near]
                centre = left[0] if len(left) else centre
            nodes[k][LAST] = len(nodes)
        k += 1
    table, place = np.array(nodes, np.int64), np.empty(len(points), np.int64)
    place[order] = np.arange(len(points))
    table[:, CENTRE] = place[table[:, CENTRE]]
    return order, table


def plant(vectors: np.ndarray, settings: Settings) -> list[dict]:
    """One tree for each part position: distinct points in tree order, how often each occurs, the point of each vector."""
    trees = []
    for part in np.split(vectors, settings.parts, axis=1):
        points, members, weights = np.unique(part, axis=0, return_inverse=True, return_counts=True)
        order, nodes = cover_tree(points, settings.leaf)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        columns = {"points": points[order], "weights": weights[order], "members": place[members.reshape(-1)], "nodes": nodes}
        trees.append({k: v.astype(np.int64).tobytes() for k, v in columns.items()})
    return trees


def opened(tree: dict, dims: int) -> dict:
    table = {k: np.frombuffer(v, np.int64) for k, v in tree.items()}
    return table | {"points": table["points"].reshape(-1, dims), "nodes": table["nodes"].reshape(-1, 6)}


def assign(points: np.ndarray, nodes: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of points (begin, end) in tree order that share their nearest entry, and that entry.

    By the triangle inequality an entry farther from a node's centre than the nearest one by more than twice the radius
    is nearest to no point of the subtree. A subtree with one entry left is settled whole; others hand the entries left
    to their children, and leaves compare their points with them exactly. Ties go to the lower entry.
    """
    own = np.sort(np.unique(book, axis=0, return_index=True)[1])  # an entry equal to a lower one never wins
    book = book[own]
    found, at, alive = [], np.zeros(1, np.int64), np.ones((1, len(book)), bool)
    while len(at):
        node = nodes[at]
        exact = among(alive, squared(points[node[:, CENTRE]], book))
        root = np.sqrt(exact.astype(np.float64))
        best, near, reach = exact.argmin(1), root.min(1)[:, None], np.sqrt(node[:, RADIUS2].astype(np.float64))[:, None]
        alive &= root - near <= 2 * reach + 1e-9 * (near + reach + 1)  # with room for the rounding of the roots
        whole = (alive.sum(1) == 1) | (node[:, RADIUS2] == 0)
        found.append((node[whole, BEGIN], node[whole, END], best[whole]))
        leaf = ~whole & (node[:, FIRST] == node[:, LAST])
        if leaf.any():
            size = node[leaf, END] - node[leaf, BEGIN]
            owner = np.repeat(np.flatnonzero(leaf), size)
            place = spans(node[leaf, BEGIN], size)
            found.append((place, place + 1, among(alive[owner], squared(points[place], book)).argmin(1)))
        inner = ~whole & ~leaf
        size = node[inner, LAST] - node[inner, FIRST]
        at, alive = spans(node[inner, FIRST], size), alive[np.repeat(np.flatnonzero(inner), size)]
    begin, end, best = map(np.concatenate, zip(*found))
    return begin, end, own[best]


def vectors_of(embeddings: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """vec_id, label, x (array of double) of the rows whose vector and all its components are there and finite."""
    rows = pick(embeddings, vec_id=vec_id, label=label, x=vector).withColumn("x", F.col("x").cast("array<double>"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return rows.filter(F.col("x").isNotNull() & F.forall("x", finite))


def whole_numbers(values: np.ndarray, settings: Settings) -> np.ndarray:
    x = np.floor(values.astype(np.float64) * settings.scale)
    if np.abs(x).max(initial=0) > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST / settings.scale:g}; its distances have no exact place in 64 bits")
    return x.astype(np.int64)


def forests(rows: DataFrame, dims: int, settings: Settings) -> DataFrame:
    """Rows (ids, labels, trees) of at most `tree` vectors each, as they lie in their partitions: nothing is shuffled."""

    def run(batches):
        def planted(group):
            x = whole_numbers(group.column("x").combine_chunks().flatten().to_numpy(), settings).reshape(-1, dims)
            columns = [group.column(c).combine_chunks() for c in ("vec_id", "label")]
            ends = pa.array([0, len(x)], pa.int32())
            arrays = [pa.ListArray.from_arrays(ends, c) for c in columns] + [pa.array([plant(x, settings)], kind)]
            return pa.RecordBatch.from_arrays(arrays, names=["ids", "labels", "trees"])

        kind = pa.list_(pa.struct([(c, pa.binary()) for c in ("points", "weights", "members", "nodes")]))
        rest = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            rest = new if rest is None else pa.concat_tables([rest, new])
            while len(rest) >= settings.tree:
                yield planted(rest.slice(0, settings.tree))
                rest = rest.slice(settings.tree)
        if rest is not None and len(rest):
            yield planted(rest)

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"ids array<bigint>, labels array<{label}>, trees {TREES}")


def partial_sums(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, block, n, s0.. of each task: how many vector parts it gives to an entry, and their sums by component.

    A subtree adds one difference of cumulative sums, however many vectors it holds.
    """
    parts, entries, dims = books.shape
    blocks = -(-dims // WIDTH)

    def run(batches):
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, blocks * WIDTH), np.int64)
        for batch in batches:
            for forest in batch.column("trees"):
                for p, tree in enumerate(forest.as_py()):
                    t = opened(tree, dims)
                    begin, end, entry = assign(t["points"], t["nodes"], books[p])
                    weight = np.r_[0, np.cumsum(t["weights"])]
                    total = np.concatenate([np.zeros((1, dims), np.int64), np.cumsum(t["points"] * t["weights"][:, None], axis=0)])
                    np.add.at(n[p], entry, weight[end] - weight[begin])
                    np.add.at(sums[p, :, :dims], entry, total[end] - total[begin])
        p, e = np.nonzero(n)
        for b in range(blocks):
            columns = [p, e, np.full(len(p), b), n[p, e], *sums[p, e, b * WIDTH : (b + 1) * WIDTH].T]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)

    names = ["part", "entry", "block", "n", *[f"s{i}" for i in range(WIDTH)]]
    return trees.select("trees").mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def trained(trees: DataFrame, books: np.ndarray, settings: Settings) -> np.ndarray:
    """Codebooks (part, entry, component) after all rounds. The driver gets one row an entry and block of components."""
    dims = books.shape[2]
    for _ in range(settings.rounds):
        found = partial_sums(trees, books).groupBy("part", "entry", "block").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(WIDTH)])
        books = books.copy()
        for part, entry, block, n, *sums in found.toLocalIterator():
            a = block * WIDTH
            books[part, entry, a : a + WIDTH] = [s // n for s in sums[: dims - a]]
    return books


def encoded(trees: DataFrame, books: np.ndarray, label: str) -> DataFrame:
    """vec_id, label, code, error of every vector of the forests."""
    dims = books.shape[2]

    def run(batches):
        for batch in batches:
            for k, forest in enumerate(batch.column("trees")):
                ids, labels = (batch.column(c)[k].values for c in ("ids", "labels"))
                codes, error = [], np.zeros(len(ids), np.int64)
                for p, tree in enumerate(forest.as_py()):
                    t = opened(tree, dims)
                    begin, end, entry = assign(t["points"], t["nodes"], books[p])
                    of_point = np.empty(len(t["points"]), np.int64)
                    of_point[spans(begin, end - begin)] = np.repeat(entry, end - begin)
                    apart = t["points"] - books[p][of_point]
                    error += (apart * apart).sum(1)[t["members"]]
                    codes.append(of_point[t["members"]])
                text = np.stack(codes, 1).astype(np.uint8).tobytes().hex() if books.shape[1] <= 256 else "".join(f"{c:04x}" for row in np.stack(codes, 1) for c in row)
                width = len(text) // max(1, len(ids))
                code = [text[i : i + width] for i in range(0, len(text), width)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return trees.mapInArrow(run, f"vec_id bigint, label {label}, code string, error bigint")


def decoded(code: str, books: np.ndarray, settings: Settings = Settings()) -> np.ndarray:
    """The vector that a code stands for, in the units of the input: the middle of each integer's interval."""
    width = len(code) // books.shape[0]
    entries = [int(code[i : i + width], 16) for i in range(0, len(code), width)]
    return (np.concatenate([books[p][e] for p, e in enumerate(entries)]) + 0.5) / settings.scale


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compressed(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", settings: Settings = Settings()) -> tuple[DataFrame, np.ndarray]:
    """Codes (vec_id, label, code, error) of all vectors, and the codebooks (part, entry, component).

    Rows with a null vector or a null or non-finite component are left out. The dimension is that of the smallest id's
    vector; vectors of another length (empty ones, too) stay with a null code and error, as all do if `parts` does not
    divide it. The codebooks begin with the parts of the smallest ids, of rows with equal ids those with the smaller
    vector, null ids last. With fewer rows than `entries` the codebooks are as many; without rows the result is empty.
    Repeated rows count as often as they occur. Components beyond LARGEST / scale end the job with an error.
    """
    rows = vectors_of(embeddings, vec_id, vector, label).withColumn("vec_id", F.col("vec_id").cast("bigint"))
    kind = rows.schema["label"].dataType.simpleString()
    order = [F.col("vec_id").asc_nulls_last(), F.col("x")]
    first = rows.select("vec_id", "x").orderBy(*order).limit(1).collect()
    dims = len(first[0]["x"]) if first else 0
    fits = (F.size("x") == dims) & F.lit(dims > 0 and dims % settings.parts == 0)
    odd = rows.filter(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    if not dims or dims % settings.parts:
        return odd, np.zeros((settings.parts, 0, 0), np.int64)
    start = rows.filter(fits).select("vec_id", "x").orderBy(*order).limit(settings.entries).collect()
    books = whole_numbers(np.array([r["x"] for r in start]), settings).reshape(len(start), settings.parts, -1).transpose(1, 0, 2)
    trees = stored(forests(rows.filter(fits), dims, settings), "forests")
    books = trained(trees, np.ascontiguousarray(books), settings)
    return encoded(trees, books, kind).union(odd), books


def code_report(embeddings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vec_id, code, error, label_error (sum of the errors of the label, null labels together), codebooks_sha256."""
    codes, books = compressed(embeddings, settings=settings)
    codes = stored(codes, "codes")
    sums = stored(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors").withColumnRenamed("label", "of")
    out = codes.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
