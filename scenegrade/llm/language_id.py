"""Language identification by prediction by partial matching over bytes."""

import io
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from scenegrade.llm.common import flat, open_storage, shared_folder, stored

UNKNOWN = "und"
ORDER = 3
#: Parts of the labelled texts; each part is coded by a model of the others.
FOLDS = 4
#: A cutoff lies this much above the costliest labelled text, but at most so many times their upper quartile.
MARGIN, LOOSEST = 1.1, 2.4
#: Bits that any text may need beyond its cutoff: a few symbols out of place in a short one.
SPARE = 40.0


@dataclass
class Model:
    """Frozen statistics: contexts of up to ORDER bytes as states, with the code length of every next byte.

    kinds maps bytes to symbols (0: never seen, also before the start), states maps ORDER symbols to the longest
    known context, and bits holds the code length by state, symbol and language.
    """

    languages: list[str]
    kinds: np.ndarray
    states: np.ndarray
    bits: np.ndarray


@dataclass
class Fitted:
    """A model in a file of the shared folder; with the most bits a byte that a text of each language may need, if learned."""

    languages: list[str]
    path: str
    cutoffs: np.ndarray | None = None


def sample(rows: DataFrame, per_language: int, longest: int, most_bytes: int = 1 << 27) -> DataFrame:
    """At most `per_language` different texts (lang, text as bytes, place) of each language: those with the smallest hashes.

    A first pass estimates the number of different texts of each language; the second ranks only those below the hash
    that leaves about twice as many as wanted. Of a longer text only the first `longest` bytes are taken, or fewer if so
    many languages would hold more than `most_bytes` together; null texts and null languages don't count.
    """
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("h", F.xxhash64("text"))
    sizes = stored(rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")), "languages")
    many = sizes.count()
    longest = min(longest, max(1, most_bytes // (per_language * max(1, many))))
    rows = rows.withColumn("text", F.substring(F.col("text").cast("binary"), 1, longest))
    share = F.least(F.lit(1.0), F.lit(2.0 * per_language + 50) / F.col("n"))
    below = sizes.select("lang", ((share * 2.0**64) - 2.0**63).alias("limit"))
    few = rows.join(F.broadcast(below) if many <= 100_000 else below, "lang").filter(F.col("h") <= F.col("limit"))
    few = few.groupBy("lang", "h").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return few.withColumn("place", place).filter(F.col("place") <= per_language).select("lang", "text", "place")


def train(texts: list[tuple[str, bytes]], contexts: int = 8000, least: int = 2, table_bytes: int = 1 << 26) -> Model | None:
    """Context trees of all languages in `texts`; None without any text.

    Every language counts each symbol after each context of 0 to ORDER symbols. A context that it has seen n times
    with d different next symbols gives a symbol seen c times the probability c / (n + d) and escapes to the next
    shorter context with d / (n + d); below the empty context all 256 bytes are equally likely. Contexts of full
    order need `least` occurrences in all and are cut to the `contexts` most frequent ones: the order is variable. With
    very many languages each order keeps fewer, so that its table stays below `table_bytes`.
    """
    texts = sorted(t for t in texts if t[1])
    if not texts:
        return None
    languages = sorted({lang for lang, _ in texts})
    seen = np.flatnonzero(np.bincount(np.frombuffer(b"".join(t for _, t in texts), np.uint8), minlength=256))
    kinds = np.zeros(256, np.uint8 if len(seen) < 255 else np.uint16)
    kinds[seen] = np.arange(1, len(seen) + 1)
    size, many = len(seen) + 1, len(languages)
    pad = np.zeros(ORDER, np.int64)
    streams = {x: np.concatenate([np.concatenate([pad, kinds[np.frombuffer(t, np.uint8)].astype(np.int64)]) for lang, t in texts if lang == x]) for x in languages}
    grams = {}
    for x, stream in streams.items():
        codes = np.zeros(len(stream), np.int64)
        for back in range(ORDER + 1):  # code of the last back + 1 symbols, the newest in the lowest digit
            shifted = np.concatenate([np.zeros(back, np.int64), stream[: len(stream) - back]])
            codes = codes + shifted * size**back
            grams[x, back] = np.unique(codes[stream > 0], return_counts=True)

    bits = np.full((1, size, many), 8.0)
    tables, first = [], 0
    for order in range(ORDER + 1):
        totals: dict[int, int] = {}
        for x in languages:
            code, count = grams[x, order]
            for c, n in zip(*_sums(code // size, count)):
                totals[c] = totals.get(c, 0) + n
        here = np.array(sorted(totals), np.int64)
        room = max(1, table_bytes // (4 * size * many))
        if order == ORDER or len(here) > room:
            n = np.array([totals[c] for c in here.tolist()])
            rank = np.argsort(-n, kind="stable")[: min(contexts, room) if order == ORDER else room]
            here = np.sort(here[rank][(n[rank] >= least) | (order < ORDER)])
        bits = _shorter(tables, here, size, order) if order else bits
        for k, x in enumerate(languages):
            code, count = grams[x, order]
            at = np.searchsorted(here, code // size).clip(0, max(0, len(here) - 1))
            mine = here[at] == code // size if len(here) else np.zeros(len(code), bool)
            at, symbol, count = at[mine], (code % size)[mine], count[mine]
            total = np.bincount(at, count, len(here))
            kinds_seen = np.bincount(at, minlength=len(here))
            known_here = total > 0
            escape = np.zeros(len(here))
            escape[known_here] = np.log2((total + kinds_seen)[known_here] / kinds_seen[known_here])
            bits[:, :, k] += escape[:, None]
            bits[at, symbol, k] = np.log2((total + kinds_seen)[at] / count)
        tables.append((here, bits, first))
        first += len(here)
    states = np.zeros(size**ORDER, np.int32)
    for a in range(0, len(states), 1 << 20):
        codes = np.arange(a, min(len(states), a + (1 << 20)), dtype=np.int32)
        for order, (here, _, begin) in enumerate(tables):
            if len(here):
                tail = codes % size**order
                at = np.searchsorted(here, tail).clip(0, len(here) - 1)
                hit = here[at] == tail
                states[a : a + len(codes)][hit] = begin + at[hit]
    return Model(languages, kinds, states, np.concatenate([b.astype(np.float32) for _, b, _ in tables]))


def _shorter(tables: list, here: np.ndarray, size: int, order: int) -> np.ndarray:
    """Code lengths in the longest known shorter context of each context of `order` symbols."""
    out = np.repeat(tables[0][1], len(here), axis=0)
    for shorter in range(1, order):
        known, bits, _ = tables[shorter]
        tail = here % size**shorter
        at = np.searchsorted(known, tail).clip(0, max(0, len(known) - 1))
        hit = known[at] == tail if len(known) else np.zeros(len(here), bool)
        out[hit] = bits[at[hit]]
    return out


def _sums(keys: np.ndarray, counts: np.ndarray):
    found, at = np.unique(keys, return_inverse=True)
    return found.tolist(), np.bincount(at, counts, len(found)).astype(np.int64).tolist()


def code_lengths(model: Model, at: np.ndarray, data: np.ndarray, window: int = 1 << 19) -> np.ndarray:
    """Bits that each language needs for each text; data holds all bytes, at the offsets. `window` bounds memory."""
    n, size = len(at) - 1, int(model.kinds.max()) + 1
    text = np.repeat(np.arange(n), np.diff(at))
    symbols = np.zeros(len(data) + ORDER * n, model.kinds.dtype)
    place = np.arange(len(data)) + ORDER * (text + 1)
    symbols[place] = model.kinds[data]
    out = np.zeros((n, len(model.languages)))
    table = model.bits.reshape(-1, len(model.languages))
    for a in range(0, len(data), window):
        p, t = place[a : a + window], text[a : a + window]
        context = symbols[p - ORDER].astype(np.int64)
        for back in range(ORDER - 1, 0, -1):
            context = context * size + symbols[p - back]
        cost = table[model.states[context].astype(np.int64) * size + symbols[p]]
        heads = np.flatnonzero(np.diff(t, prepend=-1))
        out[t[heads]] += np.add.reduceat(cost, heads, axis=0, dtype=np.float64)
    return out


def rates(texts: list[tuple[str, bytes, int]], fold: int):
    """Bits a byte (language, rate) of the texts of a fold by a model of the others, in their own language if it has one."""
    model = train([(x, t) for x, t, f in texts if f != fold])
    for x, t, f in texts:
        if f == fold and t and model is not None and x in model.languages:
            bits = code_lengths(model, np.array([0, len(t)]), np.frombuffer(t, np.uint8))
            yield x, float(bits[0, model.languages.index(x)] / len(t))


def save(model: Model, path: str) -> None:
    data = io.BytesIO()
    np.savez(data, languages=np.array(model.languages), kinds=model.kinds, states=model.states, bits=model.bits)
    fs, name = open_storage(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(name) as out:
        out.write(data.getbuffer())


_models: dict[str, Model] = {}


def load(path: str) -> Model:
    """The model of a file; a Python worker keeps the last one."""
    if path not in _models:
        _models.clear()
        fs, name = open_storage(path)
        with fs.open_input_file(name) as file:
            data = np.load(io.BytesIO(file.read()))
            _models[path] = Model([str(x) for x in data["languages"]], data["kinds"], data["states"], data["bits"])
    return _models[path]


def identify(rows: DataFrame, model: Fitted | None, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (the posterior share of the best language under equal priors) to `rows`.

    The whole text is scored; the text column goes. Null texts, texts without a letter, and all texts if there is no
    model, get 'und' and score 0. Ties go to the first language in sort order. A model with cutoffs also gives
    `recognised`: whether the text, less SPARE bits, needs no more bits a byte than the cutoff of its best language.
    """
    rows = rows.withColumn("_letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    rows = rows.withColumn("_bytes", F.coalesce(F.when(F.col("_letters"), F.col(text)), F.lit("")).cast("binary")).drop(text)
    kept = [c for c in rows.columns if c not in ("_bytes", "_letters")]
    fitted, judged = model, model is not None and model.cutoffs is not None

    def run(batches):
        model = load(fitted.path) if fitted else None
        for batch in batches:
            letters = np.asarray(batch.column("_letters").to_numpy(zero_copy_only=False), bool)
            names, score = np.full(len(letters), UNKNOWN, object), np.zeros(len(letters))
            recognised = np.zeros(len(letters), bool)
            if model is not None and letters.any():
                at, data = flat(batch.column("_bytes"))
                bits = code_lengths(model, at, data)
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(bits.min(axis=1)[:, None] - bits).sum(axis=1)
                names[letters] = np.array(model.languages, object)[best[letters]]
                score[letters] = share[letters]
                if judged:
                    excess = bits.min(axis=1)[letters] - SPARE
                    recognised[letters] = excess <= fitted.cutoffs[best[letters]] * np.diff(at)[letters]
            arrays = [batch.column(c) for c in kept] + [pa.array(names, pa.string()), pa.array(score)]
            more = [pa.array(recognised)] if judged else []
            yield pa.RecordBatch.from_arrays(arrays + more, names=[*kept, "lang_pred", "score", *["recognised"][: len(more)]])

    schema = rows.drop("_bytes", "_letters").schema.add("lang_pred", "string").add("score", "double")
    schema = schema.add("recognised", "boolean") if judged else schema
    return rows.mapInArrow(run, schema)


def fit(rows: DataFrame, per_language: int = 300, longest: int = 1 << 16, cutoffs: bool = False) -> Fitted | None:
    """Model from a bounded sample of `rows` (lang, text): at most per_language texts for each, and of
    each text its first `longest` bytes. Every language with a text that is not empty is learned; None without any.

    The model is made by a task and kept in the shared folder, where tasks read it; the driver gets its path. With
    `cutoffs` four more tasks code each text of the sample by a model of the other three parts of it. A cutoff is MARGIN times
    the largest of these rates, and at most LOOSEST times their upper quartile, so junk with a label does not open it.
    A language with a single text has no such rate, and no cutoff.
    """
    folder = shared_folder(rows.sparkSession, "language")
    chosen = sample(rows, per_language, longest).withColumn("fold", F.pmod(F.col("place") - 1, F.lit(FOLDS)).cast("int"))
    jobs = [FOLDS, *range(FOLDS * cutoffs)]
    texts = chosen.withColumn("job", F.explode(F.array(*map(F.lit, jobs)))).repartitionById(FOLDS + 1, F.col("job"))

    def run(batches):
        job, held = None, []
        for batch in batches:
            job = batch.column("job")[0].as_py() if len(batch) else job
            held += zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "fold")))
        if job == FOLDS and (model := train([(x, t) for x, t, _ in held])):
            path = f"{folder}/model-{uuid.uuid4().hex}.npz"
            save(model, path)
            yield pa.RecordBatch.from_pylist([{"lang": x, "rate": None, "path": path} for x in model.languages], schema=kinds)
        elif job is not None and job < FOLDS:
            yield pa.RecordBatch.from_pylist([{"lang": x, "rate": r, "path": None} for x, r in rates(held, job)], schema=kinds)

    kinds = pa.schema([("lang", pa.string()), ("rate", pa.float64()), ("path", pa.string())])
    made = stored(texts.select("job", "lang", "text", "fold").mapInArrow(run, "lang string, rate double, path string"), "fitted")
    found = made.groupBy("lang").agg(F.max("path").alias("path"), F.max("rate").alias("most"), F.percentile("rate", F.lit(0.75)).alias("upper")).orderBy("lang").collect()
    found = [r for r in found if r["path"]]
    if not found:
        return None
    most = [np.inf if r["most"] is None else min(MARGIN * r["most"], LOOSEST * r["upper"]) for r in found]
    return Fitted([r["lang"] for r in found], found[0]["path"], np.array(most) if cutoffs else None)
