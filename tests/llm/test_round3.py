"""Token alignment, vector codes and repeated passages against brute force and odd input."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenegrade.llm import substring_dedup, token_alignment, vector_codes
from scenegrade.llm.common import configure, spans
from scenegrade.llm.queries import tokenizer_file

SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint, TEXT string, kept string, h int"
FILES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
LONG = "lorem ipsum dolor sit amet " * 20_000


@pytest.fixture(autouse=True)
def settings(spark):
    configure(spark)


def documents(spark, rows):
    """Documents with columns that clash with those the operators add."""
    return spark.createDataFrame([(d, t, "en", "s", None, "x", "y", 1) for d, t in rows], SHAPE)


def prose(rng, n, stock):
    return " ".join(rng.choice(stock) for _ in range(n))


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_tool = Tokenizer.from_file(tokenizer_file(FILES[0]))
    a_tool.encode_special_tokens = True
    b_tool = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(FILES[1]))
    of = token_alignment.byte_of_character()
    facts, links = [], []
    for d, text in rows:
        a, b = (a_tool.encode(" " + text, add_special_tokens=False).ids, b_tool.encode(text)) if text else ([], [])
        a_bytes = [bytes(of[c] for c in a_tool.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_tool.id_to_piece(i)[3:5], 16)]) if b_tool.is_byte(i) else b_tool.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            facts.append((d, 0, 0, 0, 0, ""))
            links.append(Counter())
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        groups, i, j, mine = [], 0, 0, Counter()
        for cut in sorted({*ends_a} & {*ends_b}):
            m, n = ends_a.index(cut) + 1, ends_b.index(cut) + 1
            groups.append((a[i:m], b[j:n]))
            mine.update((x, y) for x in a[i:m] for y in b[j:n])
            i, j = m, n
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        facts.append((d, len(a), len(b), len(groups), sum(mine.values()), hashlib.sha256(said.encode()).hexdigest()))
        links.append(mine)
    count = Counter(p for mine in links for p in mine)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    rows = [(*f[:5], sum(n for p, n in mine.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in mine.items()), f[5]) for f, mine in zip(facts, links)]
    return Counter(rows), {p: (n, n == most[p[0]]) for p, n in count.items()}


def test_alignment(spark):
    rng = random.Random(2)
    stock = ["".join(rng.choice("abcdefghé字") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    rows = [(k, prose(rng, rng.randint(1, 60), stock)) for k in range(60)]
    rows += [(k, rows[k][1]) for k in range(10)] + [(100 + k, rows[3][1]) for k in range(30)]
    odd = [None, "", " ", "▁x", "日本語 😀 <|endoftext|> </s> <unk>", "a\n\n  b   c\t", "a" * 3000, "\x00\x01 ﬁ Å  ", "x  y", "it's", " lead", "trail "]
    rows += [(1000 + k, t) for k, t in enumerate(odd)] + [(None, "no id"), (None, "no id")]
    want, counts = brute_alignment(rows)
    small = token_alignment.Settings(block=2000, held=50)
    for settings in (small, token_alignment.Settings()):
        found, pairs = token_alignment.alignment(documents(spark, rows).repartition(3), *map(tokenizer_file, FILES), settings)
        assert Counter(tuple(r) for r in found.collect()) == want
        assert {(r["a"], r["b"]): (r["documents"], r["best"]) for r in pairs.collect()} == counts
    found, _ = token_alignment.alignment(documents(spark, [(1, LONG)]), *map(tokenizer_file, FILES))
    one = found.collect()[0]
    assert one["n_links"] >= one["n_groups"] > 100_000 and one["n_best"] <= one["n_links"] == one["count_sum"]
    found, pairs = token_alignment.alignment(documents(spark, []), *map(tokenizer_file, FILES))
    assert (found.count(), pairs.count()) == (0, 0)
    found, _ = token_alignment.alignment(documents(spark, [(1, None), (2, "")]), *map(tokenizer_file, FILES))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def brute_codes(rows, s):
    """Codes, errors and codebooks of rows (vec_id, vector of floats, label), by plain loops over entries."""
    kept = [(i, [math.floor(s.scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dims = len(kept[0][1]) // s.parts
    cut = lambda v: [v[p * dims : (p + 1) * dims] for p in range(s.parts)]
    own = [(i, cut(v), label) for i, v, label in kept if len(v) == s.parts * dims]
    books = [[own[k][1][p] for k in range(min(s.entries, len(own)))] for p in range(s.parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), c) for c, e in enumerate(books[p]))

    for _ in range(s.rounds):
        taken = [defaultdict(list) for _ in range(s.parts)]
        for _, parts, _ in own:
            for p, x in enumerate(parts):
                taken[p][nearest(p, x)[1]].append(x)
        books = [[[sum(c) // len(taken[p][k]) for c in zip(*taken[p][k])] if k in taken[p] else e for k, e in enumerate(books[p])] for p in range(s.parts)]
    out, by_label = [], Counter()
    for i, parts, label in own:
        near = [nearest(p, x) for p, x in enumerate(parts)]
        out.append((i, "".join(f"{c:02x}" for _, c in near), sum(d for d, _ in near), label))
        by_label[label] += out[-1][2]
    out += [(i, None, None, label) for i, v, label in kept if len(v) != s.parts * dims]
    return Counter((i, code, error, by_label[label] if label in by_label else None) for i, code, error, label in out), books


@pytest.mark.parametrize("dims", [8, 72])
def test_vector_codes(spark, dims):
    rng = random.Random(dims)
    middles = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(6)]
    rows = [(k, [m + rng.gauss(0, 0.02) for m in rng.choice(middles)], rng.choice([0, 1, None])) for k in range(400)]
    rows += [(1000 + k, rows[7][1], 0) for k in range(200)]  # a vector that is very common
    rows += [(5, rows[5][1], 1), (5, rows[6][1], 1), (None, rows[1][1], None), (2000, None, 0), (2001, [None] * dims, 0), (2002, [float("nan")] * dims, 0), (2003, [float("inf")] * dims, 1), (2004, [], 7), (2005, [0.5] * (dims - 1), 7), (-3, [0.0] * dims, 0), (-2, [-1e-9] * dims, 0)]
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, label int, VEC_ID string, error int").repartition(3)
    for s in (vector_codes.Settings(entries=16, rounds=3, tree=50, leaf=2), vector_codes.Settings(entries=256 if dims == 8 else 4, rounds=2)):
        want, books = brute_codes(rows, s)
        found = vector_codes.code_report(df, s).collect()
        assert Counter((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in found) == want
        said = ",".join(str(x) for part in books for e in part for x in e)
        assert {r["codebooks_sha256"] for r in found} == {hashlib.sha256(said.encode()).hexdigest()}
    codes, learned = vector_codes.compressed(df, settings=s)
    one = codes.filter("vec_id = 7").collect()[0]
    middle = vector_codes.decoded(one["code"], learned, s)
    assert abs(float(((middle - np.array(rows[7][1])) ** 2).sum()) - one["error"] / s.scale**2) < 1
    assert vector_codes.code_report(df.limit(0)).count() == 0
    for row, code in ((rows[7], "00000000"), ((2004, [], 7), None)):
        assert [r["code"] for r in vector_codes.code_report(spark.createDataFrame([row], "vec_id bigint, embedding array<float>, label int")).collect()] == [code]


def test_subtrees_get_their_nearest_entry():
    rng = np.random.default_rng(4)
    points = np.unique(np.concatenate([rng.integers(-20, 20, (300, 3)), rng.integers(900, 905, (200, 3))]), axis=0)
    order, nodes = vector_codes.cover_tree(points, 1)
    points = points[order]
    for n in nodes:
        below = points[n[vector_codes.BEGIN] : n[vector_codes.END]]
        assert ((below - points[n[vector_codes.CENTRE]]) ** 2).sum(1).max() == n[vector_codes.RADIUS2]
        children = nodes[n[vector_codes.FIRST] : n[vector_codes.LAST]]
        if len(children):
            assert (4 * children[:, vector_codes.RADIUS2] <= n[vector_codes.RADIUS2]).all()
            apart = vector_codes.squared(points[children[:, vector_codes.CENTRE]], points[children[:, vector_codes.CENTRE]])
            assert (4 * apart[~np.eye(len(children), dtype=bool)] > n[vector_codes.RADIUS2]).all()
    book = np.concatenate([rng.integers(-20, 20, (20, 3)), [[902, 902, 902]] * 2, points[:2]])
    begin, end, entry = vector_codes.assign(points, nodes, book)
    assert (end - begin).max() > 100  # whole subtrees are settled at once
    found = np.empty(len(points), int)
    found[spans(begin, end - begin)] = np.repeat(entry, end - begin)
    assert (found == vector_codes.squared(points, book).argmin(1)).all()


def test_large_components_end_the_job(spark):
    df = spark.createDataFrame([(1, [1e9, 0.0, 0.0, 0.0], 0)], "vec_id bigint, embedding array<double>, label int")
    with pytest.raises(Exception, match="beyond"):
        vector_codes.code_report(df)


def brute_passages(rows, width):
    first, out = {}, []
    tokens = [(d, (t or "").encode().split()) for d, t in rows]
    rank = lambda d: math.inf if d is None else d
    for d, w in tokens:
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            first[x] = min(first.get(x, math.inf), rank(d))
    for d, w in tokens:
        gone = {k + j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < rank(d) for j in range(width)}
        out.append((d, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return Counter(out)


@pytest.mark.parametrize("width", [13, 5, 2, 1])
def test_repeated_passages(spark, width):
    rng = random.Random(width)
    stock = [f"w{k}" for k in range(3000)] + ["é字", "x|y"]
    passage = prose(rng, 40, stock)
    rows = [(k, prose(rng, rng.randint(0, 60), stock)) for k in range(80)]
    for k in range(80, 160):
        base = rng.choice(rows)[1].split()
        a = rng.randrange(len(base) + 1)
        cut = rng.randint(0, 25)
        piece = passage.split()[rng.randrange(20) :][:cut]
        rows.append((rng.randrange(300), " ".join(base[:a] + piece + base[a:][: rng.randint(0, 40)])))
    rows += [(400 + k, passage) for k in range(60)] + [(401, passage), (2, rows[2][1]), (None, passage), (None, rows[5][1] + " end"), (None, "alone " * 30), (None, "alone " * 30)]
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, passage.replace(" ", "\n\x0b ")), (504, passage + " " + passage), (505, "twice " * 40), (506, "a b " * 20), (507, "a b " * 20)]
    for settings in (substring_dedup.Settings(width, block_words=60, block_rows=7), substring_dedup.Settings(width)):
        found = substring_dedup.without_repeats(documents(spark, rows).repartition(4), settings).collect()
        assert Counter(map(tuple, found)) == brute_passages(rows, width)


def test_repeated_passages_at_the_edges(spark):
    assert substring_dedup.without_repeats(documents(spark, [])).count() == 0
    rows = [(3, LONG), (7, LONG + "end"), (9, None), (9, None)]
    found = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.without_repeats(documents(spark, rows)).collect()}
    assert found == {(3, 100_000, 0), (7, 100_001, 100_000), (9, 0, 0)}
    for period in range(1, 12):
        cover = substring_dedup.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert substring_dedup.difference_cover(7) == [0, 1, 3]
