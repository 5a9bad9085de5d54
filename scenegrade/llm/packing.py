"""Packing documents into bins of fixed capacity by best fit under conflicts."""

from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scenegrade.llm.common import pick, tasks_for

#: Documents of a share: each is packed on its own, in one task.
SHARE = 2048


def best_fit(items: list[tuple[int, int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """(bin, start) of every item (size, order, source, cluster), given by descending size.

    Bins are kept ordered by what is left of them, each with a bitmap of its sources and one of its clusters. For an
    item the search begins at the least sufficient rest and goes on to successors until neither bitmap has the
    item's bit: the tightest compatible bin. Without one, a new bin is opened. Null sources and clusters never conflict.
    """
    sources = {s: 1 << k for k, s in enumerate(dict.fromkeys(i[2] for i in items if i[2] is not None))}
    often = Counter(i[3] for i in items if i[3] is not None)
    clusters = {c: 1 << k for k, c in enumerate(c for c, n in often.items() if n > 1)}
    rests: list[tuple[int, int]] = []
    used, with_source, with_cluster, placed = [], [], [], []
    for size, _, source, cluster in items:
        s, c = sources.get(source, 0), clusters.get(cluster, 0)
        at = bisect_left(rests, (size, -1))
        while at < len(rests) and (with_source[rests[at][1]] & s or with_cluster[rests[at][1]] & c):
            at += 1
        if at < len(rests):
            rest, b = rests.pop(at)
        else:
            rest, b = capacity, len(used)
            used.append(0)
            with_source.append(0)
            with_cluster.append(0)
        placed.append((b, used[b]))
        used[b] += size
        with_source[b] |= s
        with_cluster[b] |= c
        rest = (rest - size, b)
        rests.insert(bisect_left(rests, rest), rest)
    return placed


def pack_share(rows: list[tuple], capacity: int) -> list[tuple]:
    """(doc_id, piece, doc_start, n_units, bin, bin_start) of the documents (doc_id, length, source, cluster).

    A document over the capacity gives full pieces, which fill bins of their own, and a rest that is packed.
    """
    rows = [(d, max(0, n or 0), s, c) for d, n, s, c in rows]
    rests = [(n if n <= capacity else n % capacity, k, s, c) for k, (_, n, s, c) in enumerate(rows) if n <= capacity or n % capacity]
    rests.sort(key=lambda item: (-item[0], item[1]))
    out, bins = [], 0
    for (size, k, _, _), (b, start) in zip(rests, best_fit(rests, capacity)):
        doc, n = rows[k][0], rows[k][1]
        out.append((doc, (n - size) // capacity, n - size, size, b, start))
        bins = max(bins, b + 1)
    for doc, n, _, _ in rows:
        for piece in range(n // capacity if n > capacity else 0):
            out.append((doc, piece, piece * capacity, capacity, bins, 0))
            bins += 1
    return out


def pack(documents: DataFrame, capacity: int = 8192, share: int = SHARE) -> DataFrame:
    """Pieces of all documents (doc_id, length, source, cluster) in bins: doc_id, piece, doc_start, n_units, bin_id,
    bin_start.

    No bin gets two documents of one source, or of one cluster of duplicates, and none over its capacity. Documents are
    dealt by hash into shares of about `share` rows, which are packed apart, in order of their hash: shares are as many as
    the input asks for, so bins left half empty at the end of a share stay a fixed small part. A share that repeated
    rows make larger than twice that is packed in portions. Null or negative lengths count as 0; documents of length 0
    take a place in a bin. The result doesn't depend on partitions.
    """
    rows = pick(documents, doc_id="doc_id", length="length", source="source", cluster="cluster")
    shares = max(1, -(-rows.count() // share))
    h = F.xxhash64("doc_id", "length", "cluster")
    rows = rows.withColumn("share", F.pmod(h, F.lit(shares))).withColumn("h", h)
    rows = rows.repartition(tasks_for(documents), "share").sortWithinPartitions("share", "h", "doc_id", "length", "source", "cluster")

    def run(batches):
        now, held, bins = None, [], 0

        def close():
            nonlocal held, bins
            out = pack_share(held, capacity)
            base = (now << 32) + bins
            bins += 1 + max((p[4] for p in out), default=-1)
            columns = list(map(list, zip(*[(*p[:4], base + p[4], p[5]) for p in out]))) or [[]] * 6
            held = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=PIECES)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("share", "doc_id", "length", "source", "cluster"))):
                if held and (row[0] != now or len(held) >= 2 * share):
                    yield close()
                if row[0] != now:
                    now, bins = row[0], 0
                held.append(row[1:])
        if held:
            yield close()

    return rows.select("share", F.col("doc_id").cast("bigint"), F.col("length").cast("bigint"), "source", "cluster").mapInArrow(
        run, ", ".join(f"{c} bigint" for c in PIECES)
    )


PIECES = ["doc_id", "piece", "doc_start", "n_units", "bin_id", "bin_start"]


def pack_texts(documents: DataFrame, capacity: int = 8192) -> DataFrame:
    """`pack` with the UTF-8 bytes of the text and one end mark as length, and equal texts as clusters of duplicates."""
    rows = pick(documents, doc_id="doc_id", text="text", source="source")
    return pack(
        rows.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("bigint").alias("length"), "source", F.xxhash64("text").alias("cluster")),
        capacity,
    )
