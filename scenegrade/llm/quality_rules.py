"""Quality rules whose cutoffs are certified on labelled rows."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from scenegrade.llm.common import BROADCAST_IDS, flat, open_row, pick, stored, with_row

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MARKS = b"#*$%&|<>!"
CONTINUATION = bytes(range(0x80, 0xC0))
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Each rule rejects values above its cutoff. `steps` are the cutoffs tried, from loose to tight.
RULES = {
    "mark_share": [2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "upper_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4],
    "repeat_share": [0.9, 0.8, 0.7, 0.6, 0.5],
    "bar_share": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1],
}
#: Strata by number of words: lower bounds.
STRATA = [0, 200, 1000]
#: Bad rows that a step must reject for each good one, to be tried.
GOOD_WEIGHT = 50


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words covered by a window of `width` words that occurs at least twice in the list."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    code = ids[:n]
    for k in range(1, width):
        code = np.unique(code, return_inverse=True)[1] if len(known) ** (k + 1) >= 2**62 else code
        code = code * len(known) + ids[k : k + n]
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def measures(text: bytes) -> tuple:
    """The counts in BASE, then the values of RULES, of one whole text."""
    words = text.split()
    n = len(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    letters = len(text) - len(text.translate(None, LETTERS))
    upper = len(text) - len(text.translate(None, UPPER))
    base = (n, len(text.translate(None, SPACE + CONTINUATION)), len(text) - len(text.translate(None, SYMBOLS)), dup, repeat)
    marks = len(text) - len(text.translate(None, MARKS))
    return *base, (
        marks / max(1, n), upper / max(1, letters), dup / max(1, len(lines)), repeat / max(1, n),
        words.count(b"|") / max(1, n),
    )


def with_measures(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds BASE (long), `rules` (array of double in the order of RULES); the text column goes. Null text is empty."""
    rows = rows.withColumn("_bytes", F.coalesce(text, F.lit("")).cast("binary")).drop(text)
    kept = [c for c in rows.columns if c != "_bytes"]

    def run(batches):
        for batch in batches:
            at, data = flat(batch.column("_bytes"))
            data = data.tobytes()
            found = [measures(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            arrays = [batch.column(c) for c in kept]
            arrays += [pa.array([m[i] for m in found], pa.int64()) for i in range(len(BASE))]
            arrays.append(pa.array([m[-1] for m in found], pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *BASE, "rules"])

    schema = rows.drop("_bytes").schema
    for name in BASE:
        schema = schema.add(name, "long")
    return rows.mapInArrow(run, schema.add("rules", T.ArrayType(T.DoubleType())))


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def stratum():
    return sum(((F.col("n_words") >= low).cast("int") for low in STRATA[1:]), F.lit(0))


def upper_bound(rejected: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the rejection rate p at which `rejected` or fewer of n has probability delta."""
    if n == 0 or rejected >= n:
        return 1.0
    k = np.arange(rejected + 1)
    log_choose = np.array([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in k])

    def tail(p):
        terms = log_choose + k * math.log(p) + (n - k) * math.log1p(-p)
        return math.exp(min(0.0, float(terms.max() + np.log(np.exp(terms - terms.max()).sum()))))

    low, high = rejected / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mid <= 0 or (mid < 1 and tail(mid) > delta) else (low, mid)
    return high


def order_of_steps(rows: list[tuple[tuple, int, int]]) -> list[tuple]:
    """Cutoff places of the rules (0: off, k: the k-th of its steps), from loose to tight, chosen on the rows given.

    rows: (levels, quality, count), where a level is the number of a rule's cutoffs that the row lies above; its k-th step
    rejects it if the level is more than len(steps) - k. Each next entry tightens one rule, by the steps that gain most:
    bad rows newly rejected less GOOD_WEIGHT for each good one, of equal gains the first rule and the loosest step. The
    list ends when no step gains.
    """
    sizes = [len(steps) for steps in RULES.values()]
    levels = np.array([r[0] for r in rows], np.int64).reshape(-1, len(RULES))
    quality, count = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
    worth = np.where(quality == 0, 1, -GOOD_WEIGHT) * count
    now, out, gone = [0] * len(RULES), [], np.zeros(len(rows), bool)
    while True:
        best, step = 0, None
        for i, size in enumerate(sizes):
            for k in range(now[i] + 1, size + 1):
                gain = int(worth[(levels[:, i] > size - k) & ~gone].sum())
                if gain > best:
                    best, step = gain, (i, k)
        if step is None:
            return out
        now[step[0]] = step[1]
        gone |= levels[:, step[0]] > sizes[step[0]] - step[1]
        out.append(tuple(now))


def rejected(levels: np.ndarray, places: tuple) -> np.ndarray:
    """Rows that at least one rule rejects at these places."""
    return np.any([levels[:, i] > len(steps) - k for i, (steps, k) in enumerate(zip(RULES.values(), places))], axis=0)


def choose_cutoffs(counts: dict, alpha: float = 0.05, delta: float = 0.05) -> dict:
    """Cutoffs by (stratum, rule).

    counts[stratum, held_out] is a list of (levels, quality, count) of the labelled rows. The rows that are not held out fix
    the order in which cutoffs are tried, from loose to tight. Each set of cutoffs in it is tested on the held-out good
    rows: the exact upper bound on the share that all rules together reject, at confidence 1 - delta / strata
    (Bonferroni over strata), must be at most alpha. The last set before the first failure is taken (tests of a
    fixed sequence need no further correction), so with probability 1 - delta the rules falsely reject at most
    alpha in every stratum. With no good row rejected this takes 80 held-out good rows at the defaults.
    A rule without a certified cutoff stays off: its cutoff is infinite.
    """
    chosen = {(s, rule): math.inf for s in range(len(STRATA)) for rule in RULES}
    for s in range(len(STRATA)):
        good = [(r[0], r[2]) for r in counts.get((s, True), []) if r[1] == 1]
        levels, n = np.array([g[0] for g in good], np.int64).reshape(-1, len(RULES)), np.array([g[1] for g in good], np.int64)
        for places in order_of_steps(counts.get((s, False), [])):
            lost = int(n[rejected(levels, places)].sum())
            if upper_bound(lost, int(n.sum()), delta / len(STRATA)) > alpha:
                break
            chosen.update({(s, rule): steps[k - 1] for (rule, steps), k in zip(RULES.items(), places) if k})
    return chosen


def fit(measured: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> dict:
    """Cutoffs from all labelled rows of `measured` (doc_id, BASE, rules) that pass the base rules.

    A quarter of them, by a hash of the id, fixes the order of the cutoffs, three quarters are held out to certify them.
    What is gathered is one row per stratum, part, label and combination of levels, at most a few thousand whatever the
    input. Labels of 0 or 1 count, others and null ids don't. A document with several labels counts once for
    each different one.
    """
    labelled = pick(labels, doc_id="doc_id", quality="quality").filter("quality in (0, 1)").distinct()
    levels = [sum(((F.col("rules")[i] > c).cast("int") for c in steps), F.lit(0)) for i, steps in enumerate(RULES.values())]
    held_out = (F.pmod(F.xxhash64("doc_id"), F.lit(4)) != 0).alias("held_out")
    rows = (
        measured.filter(~base_failed()).select("doc_id", stratum().alias("s"), held_out, F.array(*levels).alias("levels")).join(labelled, "doc_id")
        .groupBy("s", "held_out", "levels", "quality").agg(F.count(F.lit(1)).alias("n")).collect()
    )
    counts: dict = {}
    for r in sorted(rows):
        counts.setdefault((r["s"], r["held_out"]), []).append((tuple(r["levels"]), r["quality"], r["n"]))
    return choose_cutoffs(counts, alpha, delta)


def passes(cutoffs: dict):
    """Column: no rule of the row's stratum rejects it."""
    ok = F.lit(True)
    for s in range(len(STRATA)):
        for i, rule in enumerate(RULES):
            if math.isfinite(cutoffs[s, rule]):
                ok = ok & ~((stratum() == s) & (F.col("rules")[i] > F.lit(cutoffs[s, rule])))
    return ok


def quality_verdicts(documents: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """One row per row of `documents`: doc_id, BASE, rules, base_failed, kept.

    The measures are taken once from the whole texts and stored; cutoffs come from the labelled ones. Null and empty
    texts have no words and fail the base rules. Without labels only the base rules act.
    """
    measured = stored(with_measures(pick(documents, doc_id="doc_id", text="text")), "measures")
    cutoffs = fit(measured, labels, alpha, delta)
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & passes(cutoffs))


def keep_good(documents: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The rows of `documents` that the rules keep, with all columns.

    Labelled documents are measured for the fit, then all for the verdict, so that no text is stored. Null, empty and
    blank texts go; rows with a null id or none in `labels` are judged by the same cutoffs; repeated rows stay repeated.
    """
    given = pick(documents, doc_id="doc_id", text="text")
    ids = stored(pick(labels, doc_id="doc_id", quality="quality").filter("quality in (0, 1)").select("doc_id").distinct(), "labelled")
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    cutoffs = fit(with_measures(given.join(few, "doc_id", "left_semi")), labels, alpha, delta)
    rows = with_measures(with_row(documents, text="text"))
    return open_row(rows.filter(~base_failed() & passes(cutoffs)), documents)
