"""Operators of the training-data subpackage against brute force, round trips and odd input."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenegrade.llm import chat_format, language_id, near_dedup, packing, quality_rules, token_blocks, url_filter, warc
from scenegrade.llm import sentencepiece_viterbi as sp
from scenegrade.llm.common import configure, forget, pick, stored, stored_names
from scenegrade.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from scenegrade.llm.queries import tokenizer_file

SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint, TEXT string, kept string, h int"
LONG = "lorem ipsum dolor " * 40_000


@pytest.fixture(autouse=True)
def settings(spark):
    configure(spark)


def words(rng, n, stock):
    return " ".join(rng.choice(stock) for _ in range(n))


def documents(spark, rows):
    """Documents with columns that clash with those the operators add."""
    return spark.createDataFrame([(d, t, lang, s, None, "x", "y", 1) for d, t, lang, s in rows], SHAPE)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    stock = {x: ["".join(rng.choice(a) for _ in range(rng.randint(2, 8))) for _ in range(300)] for x, a in (("en", "abcdefgh"), ("fr", "éèmnopqr"))}
    rows = []
    for k in range(160):
        lang = rng.choice(["en", "fr"])
        rows.append((k, words(rng, rng.randint(1, 140), stock[lang]), lang, rng.choice(["s0", "s0", "s1", "s2", None])))
    for k in range(160, 260):
        base = rows[rng.randrange(160)]
        text = base[1].split()
        for _ in range(rng.choice([0, 1, 2, 6])):
            text[rng.randrange(len(text))] = "changed"
        rows.append((k, " ".join(text) if k % 3 else base[1], base[2], base[3]))
    rows += [(300, None, "en", "s0"), (301, "", None, None), (302, " \n\t ", "fr", "s1"), (303, "123 456", "en", "s1"), (304, LONG, None, "s2"), (305, None, None, None), (306, "A", "en", "s1")]
    return rows


def test_exact_duplicates(spark, corpus):
    rows = [*corpus, *[(1000 + k, "hot text", "en", "s0") for k in range(150)], (1000, "hot text", "en", "s0"), (None, "hot text", None, None)]
    df = documents(spark, rows).repartition(3)
    for keep, best in (("smallest", min), ("largest", max)):
        found = exact_duplicates(df, keep).collect()
        groups = {}
        for d, t, *_ in rows:
            groups.setdefault(t or "", []).append(d)
        assert len(found) == len(rows)
        for r in found:
            group = groups[r["text"]]
            assert (r["keep_id"], r["group_size"]) == (best(d for d in group if d is not None), len(group))
            assert r["text_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
        kept = [r for r in found if r["kept"]]
        assert Counter(r["text"] for r in kept) == Counter(dict.fromkeys(groups, 1))
        assert all(r["doc_id"] == r["keep_id"] for r in kept)
    stay = drop_exact_duplicates(df)
    assert stay.columns == df.columns and stay.count() == len({t or "" for _, t, *_ in rows})
    assert stay.filter("doc_id = 300").collect()[0][1] is None
    assert drop_exact_duplicates(df.limit(0)).count() == 0


def brute_groups(rows, width, percent):
    def shingle_set(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets = {d: shingle_set(t) for d, t, *_ in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and k and 100 * k >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, corpus, width):
    small = near_dedup.Settings(words=width, block=300)
    rng = random.Random(7)
    base = [f"w{k}" for k in range(60)]
    chain = []
    for k in range(25):  # a chain whose ends differ, and outliers near the limit
        base = base[:]
        base[rng.randrange(60)] = f"z{k}"
        chain.append((2000 + k, " ".join(base), "en", "s0"))
    rows = [*corpus, *chain]
    found = near_dedup.near_duplicates(documents(spark, rows), small).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_groups(rows, width, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_near_duplicates_odd_input(spark, corpus):
    df = documents(spark, [(None, "a b c", "en", "s"), (5, "a b c", "en", "s"), (5, "a b c", "en", "s"), (6, "a B c", "en", "s")])
    found = near_dedup.near_duplicates(df, near_dedup.Settings(words=2)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in found) == [(0, 0, True), (5, 5, True), (5, 5, True), (6, 5, False)]
    stay = near_dedup.drop_near_duplicates(df)
    assert stay.columns == df.columns and stay.count() == 3
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def near_limit_group(rng, n, first=0):
    """Near copies of one 120-word text with 1 to 7 changed words: with 2-word shingles many pairs lie close to the limit."""
    base, rows = [f"b{k}" for k in range(120)], []
    for k in range(n):
        text = base[:]
        for place in rng.sample(range(120), rng.randint(1, 7)):
            text[place] = f"c{first + k}x{place}"
        rows.append((first + k, " ".join(text), "en", "s"))
    return rows


def test_links_near_the_limit_are_searched_in_linear_rows(spark, monkeypatch):
    rows_of = {}
    for n in (200, 400):
        given, stored, seen = near_limit_group(random.Random(n), n), near_dedup.stored, {}

        def counted(df, name, path=None, stored=stored, seen=seen):
            out = stored(df, name, path)
            seen[name] = seen.get(name, 0) + out.count()
            return out

        monkeypatch.setattr(near_dedup, "stored", counted)
        found = near_dedup.near_duplicates(documents(spark, given), near_dedup.Settings(words=2)).collect()
        monkeypatch.undo()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_groups(given, 2, 80)
        rows_of[n] = seen
    for documents_in, seen in rows_of.items():  # no table has more rows than the documents have bands
        assert max(seen.values()) <= near_dedup.Settings().bands * documents_in, seen


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_joining_links_connect_what_brute_force_connects(percent):
    rng = random.Random(percent)
    for trial in range(60):
        n, size = rng.randint(2, 14), rng.randint(3, 30)
        base = rng.sample(range(1000), size)
        sets = []
        for _ in range(n):
            own = [x for x in base if rng.random() > rng.choice([0.02, 0.1, 0.5])] + rng.sample(range(1000, 1040), rng.randint(0, 4))
            sets.append(sorted(set(own)) or [7])
        component = [rng.randrange(n) for _ in range(n)]
        at = np.cumsum([0, *map(len, sets)])
        codes = np.array([x for s in sets for x in s], np.uint64)
        found = near_dedup.joining_links(np.array(component), at, codes, percent)

        def groups(links):
            root = {c: c for c in component}
            for u, v in links:
                a, b = component[u], component[v]
                a, b = root[a], root[b]
                root = {c: (min(a, b) if r in (a, b) else r) for c, r in root.items()}
            return root

        linked = lambda u, v: 100 * len({*sets[u]} & {*sets[v]}) >= percent * len({*sets[u]} | {*sets[v]})
        assert all(linked(u, v) for u, v in found)
        assert groups(found) == groups([(u, v) for u in range(n) for v in range(u) if linked(u, v)])


def test_signature_estimate():
    s = near_dedup.Settings()
    a = near_dedup.shingles(" ".join(map(str, range(3000))).encode(), 1)
    b = near_dedup.shingles(" ".join(map(str, range(300, 3300))).encode(), 1)
    least = [np.frombuffer(near_dedup.packed(near_dedup.minima(x, *near_dedup.constants(s)), s.bits), np.uint8) for x in (a, b)]
    assert abs(near_dedup.estimate(near_dedup.equal_values(*least, s), s) - 2700 / 3300) < 0.15
    assert near_dedup.equal_values(least[0], least[0], s) == s.bands * s.rows


def test_language_identification(spark, corpus):
    df = documents(spark, corpus)
    model = language_id.fit(pick(df.filter("doc_id % 4 <> 0"), lang="lang", text="text"))
    rows = df.select("doc_id", F.col("n_chars")).join(spark.createDataFrame([(d, t) for d, t, *_ in corpus], "doc_id bigint, body string"), "doc_id")
    found = {r["doc_id"]: r for r in language_id.identify(rows, model, "body").collect()}
    for d, t, lang, _ in corpus:
        if not any(c.isalpha() for c in t or ""):
            assert (found[d]["lang_pred"], found[d]["score"]) == ("und", 0.0)
        elif d < 260 and d % 4 == 0:
            assert found[d]["lang_pred"] == lang and 0 <= found[d]["score"] <= 1
    empty = language_id.fit(pick(df.filter("false"), lang="lang", text="text"))
    assert empty is None
    assert {r["lang_pred"] for r in language_id.identify(rows, None, "body").collect()} == {"und"}


def test_language_query_learns_from_the_others_only(spark, tmp_path):
    """The held-out rule, and that id, source and language of a document are no inputs of its prediction."""
    rng = random.Random(9)
    stock = {x: ["".join(rng.choice(a) for _ in range(rng.randint(2, 8))) for _ in range(200)] for x, a in (("aa", "abcdefgh"), ("bb", "stuvwxyz"))}
    rows = [(k, words(rng, 30, stock["aa" if k % 2 else "bb"]), "aa" if k % 2 else "bb", "s") for k in range(200)]
    # the same texts again, as held-out documents with wrong labels and as unlabelled ones
    out = [k for k in range(1000, 5000) if zlib.crc32(str(k).encode()) % 4 == 2][:40]
    rows += [(d, rows[k][1], "zz", "elsewhere") for k, d in enumerate(out)] + [(9000 + k, rows[k][1], None, None) for k in range(40)]
    rows += [(None, rows[1][1], None, None), (7, rows[7][1], "aa", "s"), (9100, "ab", None, None), (9101, None, "aa", None), (9102, "1 2", "bb", None)]
    from scenegrade.llm.queries import op1_language_id

    for part, given in (("all", rows), ("none", [])):
        documents(spark, given).toDF("doc_id", "text", "lang", "source", "n_chars", "held_out", "score", "h").write.parquet(f"{tmp_path}/{part}/documents.parquet")
    found = {}
    for r in op1_language_id(spark, f"{tmp_path}/all").collect():
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        found.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert {x for v in found.values() for x, _ in v} == {"aa", "bb", "und"}  # the label of held-out rows is never learned
    for k in range(40):
        assert found[k][0] == found[out[k]][0] == found[9000 + k][0]
    assert len(found[7]) == 2 and len(set(found[7])) == 1 and found[None][0] == found[1][0]
    assert found[9101] == found[9102] == [("und", 0.0)]
    assert op1_language_id(spark, f"{tmp_path}/none").count() == 0


def test_ties_between_languages_go_to_the_first(spark):
    same = [("bb", "abab baba"), ("aa", "abab baba"), ("aa", "aabb"), ("bb", "aabb")]
    model = language_id.fit(spark.createDataFrame(same, "lang string, text string"))
    found = language_id.identify(spark.createDataFrame([("abba",)], "text string"), model).collect()[0]
    assert (found["lang_pred"], found["score"]) == ("aa", 0.5)


def test_many_languages_keep_the_table_small():
    texts = [(f"l{k}", bytes(range(97, 117)) * 20 + bytes([97 + k % 20, 100, 98]) * 30) for k in range(50)]
    model = language_id.train(texts, table_bytes=200_000)
    assert model.bits.nbytes <= 4 * 200_000 + 4 * 50 * 22 and len(model.languages) == 50
    whole = language_id.train(texts)
    assert whole.bits.nbytes > model.bits.nbytes


def test_code_lengths_against_direct_computation():
    texts = [("a", b"abracadabra abra"), ("b", b"banana bandana")]
    model = language_id.train(texts, contexts=100, least=1)

    seen_bytes = set(b"".join(t for _, t in texts))

    def bits(lang, data):
        data = bytes(b if b in seen_bytes else 0 for b in data)  # unseen bytes count as the mark before the start
        stream = b"\x00\x00\x00" + dict(texts)[lang]
        seen = {}
        for i in range(3, len(stream)):
            for k in range(4):
                seen.setdefault(stream[i - k : i], Counter())[stream[i]] += 1
        total, padded = 0.0, b"\x00\x00\x00" + data
        for i in range(3, len(padded)):
            for k in (3, 2, 1, 0):
                here = seen.get(padded[i - k : i])
                if here is None:
                    continue
                n, d = sum(here.values()), len(here)
                if padded[i] in here:
                    total += math.log2((n + d) / here[padded[i]])
                    break
                total += math.log2((n + d) / d)
            else:
                total += 8
        return total

    data = [b"abra ban", b"", b"zzz", b"cadabra"]
    at = np.cumsum([0, *map(len, data)])
    for window in (3, 1 << 19):
        found = language_id.code_lengths(model, at, np.frombuffer(b"".join(data), np.uint8), window)
        expected = [[bits(x, t) for x in ("a", "b")] for t in data]
        assert np.allclose(found, expected, atol=1e-3)


def brute_measures(text):
    b = (text or "").encode()
    w = b.split()
    lines = [x for x in b.split(b"\n") if x.split()]
    grams = Counter(zip(w, w[1:], w[2:]))
    repeated = {k + j for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
    return len(w), len(b"".join(w).decode()), sum(b.count(c) for c in b"#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def test_quality_measures_and_risk(spark, corpus):
    rng = random.Random(1)
    clean = [(k, words(rng, 60, [f"w{x}" for x in range(500)]), "en", "s") for k in range(5000, 5300)]
    junk = [(k, words(rng, 60, [f"w{x}###" for x in range(500)]) + "\n\nx\nx", "en", "s") for k in range(8000, 8040)]
    rows = [*corpus, *clean, *junk]
    labels = spark.createDataFrame([(k, int(k < 8000), 0) for k in [*range(5000, 5300), *range(8000, 8030), 8030, 8030]] + [(None, 1, 0), (1, None, 0), (304, 1, 0)], "doc_id bigint, quality int, toxic int")
    found = {r["doc_id"]: r for r in quality_rules.quality_verdicts(documents(spark, rows), labels).collect()}
    for d, t, *_ in rows:
        assert tuple(found[d][c] for c in quality_rules.BASE) == brute_measures(t)
        n, repeat = found[d]["n_words"], found[d]["n_repeat_words"]
        assert found[d]["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
    assert all(found[k]["kept"] for k in range(5000, 5300)) and not any(found[k]["kept"] for k in range(8000, 8040))
    off = quality_rules.quality_verdicts(documents(spark, rows), labels.limit(0)).filter("kept = base_failed")
    assert off.count() == 0
    stay = quality_rules.keep_good(documents(spark, rows), labels)
    assert {r[0] for r in stay.collect()} == {d for d, r in found.items() if r["kept"]} and stay.columns == documents(spark, []).columns
    assert quality_rules.keep_good(documents(spark, []), labels).count() == quality_rules.quality_verdicts(documents(spark, []), labels).count() == 0
    again = quality_rules.keep_good(documents(spark, [*rows, rows[-1], clean[0], clean[0], (None, clean[0][1], None, None)]), labels)
    assert again.count() == stay.count() + 3


def brute_cutoffs(counts, alpha, delta):
    """Cutoffs by trying, for every stratum, the sets of cutoffs one after the other on lists of single rows."""
    rules = list(quality_rules.RULES.items())
    chosen = {(s, rule): math.inf for s in range(len(quality_rules.STRATA)) for rule, _ in rules}

    def hit(levels, places):
        return any(k and levels[i] >= len(steps) - k + 1 for i, ((_, steps), k) in enumerate(zip(rules, places)))

    for s in range(len(quality_rules.STRATA)):
        first = [(lv, q) for lv, q, n in counts.get((s, False), []) for _ in range(n)]
        good = [lv for lv, q, n in counts.get((s, True), []) for _ in range(n) if q == 1]
        places = [0] * len(rules)
        while True:
            options = []
            for i, (_, steps) in enumerate(rules):
                for k in range(places[i] + 1, len(steps) + 1):
                    new = [*places[:i], k, *places[i + 1 :]]
                    fresh = [q for lv, q in first if hit(lv, new) and not hit(lv, places)]
                    options.append((fresh.count(0) - quality_rules.GOOD_WEIGHT * fresh.count(1), -i, -k, new))
            gain, _, _, new = max(options)
            if gain <= 0:
                break
            places, lost, n = new, sum(hit(lv, new) for lv in good), len(good)
            # the bound exceeds alpha exactly if so few losses are not too unlikely at a rate of alpha
            tail = sum(math.comb(n, j) * alpha**j * (1 - alpha) ** (n - j) for j in range(lost + 1))
            if n == 0 or tail > delta / len(quality_rules.STRATA):
                break
            for i, (rule, steps) in enumerate(rules):
                if places[i]:
                    chosen[s, rule] = steps[places[i] - 1]
    return chosen


def test_cutoffs_against_brute_force():
    rng = random.Random(8)
    sizes = [len(steps) for steps in quality_rules.RULES.values()]
    certified = 0
    for _ in range(25):
        counts = {}
        for s in range(3):
            for held_out in (False, True):
                rows = Counter()
                for _ in range(rng.choice([5, 60, 200])):
                    bad = rng.random() < 0.2
                    rows[tuple(min(n, int(rng.expovariate(0.25 if bad else 3))) for n in sizes), int(not bad)] += 1
                counts[s, held_out] = [(lv, q, n) for (lv, q), n in sorted(rows.items())]
        found = quality_rules.choose_cutoffs(counts, 0.1, 0.2)
        assert found == brute_cutoffs(counts, 0.1, 0.2)
        certified += sum(map(math.isfinite, found.values()))
    assert certified > 20
    assert set(quality_rules.choose_cutoffs({}).values()) == {math.inf}
    enough = [((3, 0, 0, 0, 0), 0, 5)]
    for n, acts in ((79, False), (80, True)):  # good rows held out that a stratum takes
        found = quality_rules.choose_cutoffs({(0, False): enough, (0, True): [((0, 0, 0, 0, 0), 1, n)]})
        assert math.isfinite(found[0, "mark_share"]) == acts


def test_exact_binomial_bound():
    def tail(k, n, p):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    for k, n in ((0, 50), (3, 80), (10, 30)):
        assert abs(tail(k, n, quality_rules.upper_bound(k, n, 0.01)) - 0.01) < 1e-6
    assert quality_rules.upper_bound(5, 5, 0.1) == 1.0 and quality_rules.upper_bound(0, 0, 0.1) == 1.0


@pytest.mark.parametrize("special_as_text", [False, True])
def test_token_files(spark, corpus, special_as_text):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = special_as_text
    odd = ["it 's  ok", "\n \n b c", "x   y z", " a", "a ", "<|endoftext|> a", "a <|endoftext|> b", "<|endoftext|>", "word\n next\n\n  line", "Ġ Ġb", "a\u3000 b", "\x1c  b", " "]
    rows = [(d, t, x, s) for d, t, x, s in corpus] + [(900 + k, t, "en", "s") for k, t in enumerate(odd)]
    rows += [(None, "no id", "en", "s"), (None, "a", "en", "s"), (3, "same id", "en", "s"), (3, "same id", "en", "s")]
    index = token_blocks.write_tokens(documents(spark, rows), path, 2, token_blocks.shared_folder(spark, "tokens"), special_as_text=special_as_text)
    found, want, start = Counter(tuple(r) for r in token_blocks.read_digests(index).collect()), Counter(), 0
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[d, start, len(ids), zlib.crc32(ids.tobytes())] += 1
        start += len(ids)
    assert found == want
    assert token_blocks.token_file_digests(documents(spark, []), path).count() == 0


def test_encoder_equals_the_library_on_odd_white_space():
    from tokenizers import Tokenizer

    path, rng = tokenizer_file("byte_bpe_50k.json"), random.Random(1)
    library = Tokenizer.from_file(path)
    stock = [" ", " ", "a", "b", "\n", "\t", "\u3000", "\u00a0", "1", "'s", "é", "<|endoftext|>", "\x1c", "\x85", "字"]
    for special_as_text in (False, True):
        library.encode_special_tokens, encoder = special_as_text, token_blocks.Encoder(path, special_as_text)
        for _ in range(60):
            texts = ["".join(rng.choice(stock) for _ in range(rng.randint(0, 14))) for _ in range(30)]
            ids, ends = encoder(texts)
            assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for ids in ([0], [5, 2**32 - 1, 0, 7], [*range(1000), 2**31], rng.integers(0, 2**17, 1023), [9] * 7):
        ids = np.array(ids, "<u4")
        assert (token_blocks.decode_block(memoryview(token_blocks.encode_block(ids))) == ids).all()


def test_chat_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", "", None, "a\\", "### User: x", "</turn>\n", "\\\\#<", "x: y"]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]
    rows += [(2, 0, "assistant", "early"), (3, 0, None, "x"), (3, 1, "odd: @#role\\", "y"), (None, 0, "user", "z"), (4, 0, "system", "s")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, ROLE int")
    found = {r["conv_id"]: r for r in chat_format.conversation_digests(df).collect()}
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        learned = "".join(t for role, t in turns if role == "assistant")
        r = found[conv]
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(learned)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    assert [found[c]["valid"] for c in (1, 2, 3, 4, None)] == [True, False, False, False, True]
    assert chat_format.conversation_digests(df.limit(0)).count() == 0


def test_packing_is_best_fit_without_conflicts(spark, corpus):
    rng = random.Random(5)
    items = [(rng.randint(0, 50), k, rng.choice(["a", "b", "c", None]), rng.choice([1, 2, None, None])) for k in range(200)]
    items.sort(key=lambda i: -i[0])
    bins = []
    for (size, _, s, c), (b, start) in zip(items, packing.best_fit(items, 100)):
        fit = [(100 - sum(x[0] for x in held), k) for k, held in enumerate(bins) if sum(x[0] for x in held) + size <= 100 and all(x[1] is None or x[1] != s for x in held) and all(x[2] is None or x[2] != c for x in held)]
        want = min(fit)[1] if fit else len(bins)
        if want == len(bins):
            bins.append([])
        assert b == want and start == sum(x[0] for x in bins[b])
        bins[b].append((size, s, c))

    df = documents(spark, [*corpus, (None, "x", None, None), (7, "repeat", "en", "s0"), (7, "repeat", "en", "s0")])
    pieces = packing.pack_texts(df, 500).collect()
    covered = Counter()
    for p in pieces:
        covered[p["doc_id"]] += p["n_units"]
    assert covered == Counter({d: n for d, n in ((d, len((t or "").encode()) + 1) for d, t, *_ in corpus if d != 7)}) + Counter({None: 2, 7: len(corpus[7][1].encode()) + 1 + 14})
    by_bin = {}
    for p in pieces:
        by_bin.setdefault(p["bin_id"], []).append(p)
    source = {d: s for d, _, _, s in corpus}
    for held in by_bin.values():
        held.sort(key=lambda p: (p["bin_start"], p["n_units"]))
        assert sum(p["n_units"] for p in held) <= 500
        assert [p["bin_start"] for p in held] == np.cumsum([0, *(p["n_units"] for p in held)])[:-1].tolist()
        owners = [source.get(p["doc_id"]) for p in held if p["doc_id"] != 7 and source.get(p["doc_id"])]
        assert len(owners) == len(set(owners))
    assert packing.pack_texts(df.limit(0)).count() == 0


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 100
    rows = [(5, "http://a/b c", big), (3, None, big), (9, "http://é/x", big), (9, "http://é/x", big), (1, "u", "tiny"), (2, "u", "tiny"), (4, "u", None), (7, "u", ""), (8, "http://l", LONG), (None, "n", "null id" * 30)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, HTML int")
    found = warc.archive_digests(df).collect()
    assert len(found) == len(rows)
    for r in found:
        html = next(h for p, _, h in rows if p == r["page_id"]) or ""
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if r["page_id"] in (5, 9) else ("response", None))
    assert warc.archive_digests(df.limit(0)).count() == 0
    fields, payload = warc.parse(warc.record(5, "u", b"<p>\r\n\r\n</p>", "ab" * 32, None))
    assert payload == b"<p>\r\n\r\n</p>" and fields["Content-Type"].startswith("application/http")
    assert warc.parse(warc.record(5, "u", b"", "ab" * 32, 3))[0]["WARC-Refers-To"] == warc.parse(warc.record(3, "u", b"x", "ab" * 32, None))[0]["WARC-Record-ID"]
    assert warc.ranges([0, 10, 500, 510], [10, 10, 10, 10], gap=5, most=100) == [(0, 2), (2, 4)]
    assert warc.ranges([0, 10, 20], [10, 10, 10], gap=5, most=20) == [(0, 2), (2, 3)]


def test_intermediates_are_forgotten(spark):
    before = stored_names(spark)
    stored(spark.range(3), "kept").count()
    assert len(stored_names(spark) - before) == 1
    forget(spark, before)
    assert stored_names(spark) == before


def test_url_rules(spark):
    rules = spark.createDataFrame([("com", "/en/", "block"), ("Example.COM", "/en/7", "allow"), ("net", None, "block"), ("net", "", "allow"), ("", "/", "block"), ("x.org", "/", "odd")], "host string, path string, verdict string")
    urls = {"http://a.example.com/en/71?q": ("example.com/en/7", "allow"), "https://A.COM/en/": ("com/en/", "block"), "com/en/": (None, "allow"), "x://com": (None, "allow"),
            "x://notcom/en/": (None, "allow"), "x://b.net#f": ("net", "block"), "": (None, "allow"), None: (None, "allow"), "x:///en/": (None, "allow"), "x://x.org/": (None, "allow"), "http://com/en/http://y": ("com/en/", "block"), "h://" + "a." * 60 + "com/en/" + "p" * 5000: ("com/en/", "block")}
    pages = spark.createDataFrame([(k, u, "") for k, u in enumerate([*urls, "x://b.net#f"])], "page_id bigint, url string, HOST string")
    found = {r["page_id"]: r for r in url_filter.judge_urls(pages, rules).collect()}
    for k, (u, (rule, verdict)) in enumerate(urls.items()):
        assert (found[k]["rule"], found[k]["verdict"]) == (rule, verdict), u
    assert len(found) == len(urls) + 1
    assert found[1]["host"] == "a.com" and found[0]["path"] == "/en/71"
    assert {r["verdict"] for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_url_rules_of_the_contract(spark, tmp_path):
    from scenegrade.llm import queries

    urls = {"http://a.net/de/1": ("net/de/", "allow"), "http://example.net/de/8": ("example.net/de/8", "block"), "http://example.net/de/7": ("net/de/", "allow"),
            "http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/7": ("example.com/en/7", "allow"), "http://b.org/es/": ("org/es/", "block"), "http://b.org/fr/": (None, "allow")}
    spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in queries.op10_url_filter(spark, str(tmp_path)).collect()}
    assert [found[k] for k in range(len(urls))] == list(urls.values())
    assert "('net', '/de/', 'allow')" in queries.ORACLES["op10_url_filter"]


def test_pieces_equal_the_library(spark, corpus):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = ["", " ", "  ", " a", "a  b", "   字 字  ", "héllo wörld\n\n  x\ty ", "▁x", "a" * 300, " " * 40 + "b", "😀 internationalization"]
    rows = [*[(d, t) for d, t, *_ in corpus if d != 304], *[(900 + k, t) for k, t in enumerate(odd)]]
    df = documents(spark, [(d, t, None, None) for d, t in rows])
    found = {r["doc_id"]: r for r in sp.round_trips(df, path).collect()}
    for d, t in rows:
        ids = library.encode(t or "")
        assert (found[d]["n_ids"], found[d]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert found[d]["same"] == (library.decode(ids) == (t or ""))


def test_unigram_search_finds_the_best_sum():
    v = sp.load(tokenizer_file("piece_bpe_32k.model"))
    v.kind = sp.UNIGRAM
    v.scores = -np.abs(v.scores % 97) - 1
    word = "▁international"
    ids, at = sp.segment(v, [word, "▁transnational"], sp.Pairs(v))
    names = {v.names[i]: v.scores[i] for i in v.ids.tolist() if v.whole[i]}
    best = [0.0] + [-math.inf] * len(word)
    for i in range(1, len(word) + 1):
        best[i] = max((best[j] + names[word[j:i]] for j in range(i) if word[j:i] in names), default=-math.inf)
    assert math.isclose(best[-1], sum(v.scores[i] for i in ids[: at[1]]))


def test_pipeline_against_brute_force(spark, corpus, tmp_path):
    import corpus_pipeline

    rows = [r for r in corpus if r[0] != 304]
    names = ["doc_id", "text", "lang", "source", "n_chars", "u", "component", "h"]
    documents(spark, rows).toDF(*names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names
        kept[name] = {r[0] for r in docs.collect()}
    lettered = {d for d, t, *_ in rows if any(c.isalpha() for c in t or "")}
    assert kept["language_id"] == lettered
    good = [r for r in rows if r[0] in lettered and (m := brute_measures(r[1]))[0] >= 50 and 100 * m[4] <= 50 * m[0]]
    assert kept["quality_rules"] == {r[0] for r in good}
    first = {}
    for r in sorted(good):
        first.setdefault(r[1], r)
    assert kept["exact_dedup"] == {r[0] for r in first.values()}
    groups = brute_groups(list(first.values()), 5, 80)
    assert kept["near_dedup"] == {d for d, (_, root) in groups.items() if d == root}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r[0] for r in packed.select("doc_id").collect()} == kept["near_dedup"]
    assert packed.columns == packing.PIECES


def test_pipeline_rejects_what_no_learned_language_explains(spark, corpus):
    import base64

    import corpus_pipeline

    rng = random.Random(11)
    letters = lambda a: "".join(rng.choice(a) for _ in range(rng.randint(2, 8)))
    unlearned = [letters("stuvwxyz") for _ in range(300)]
    odd = [
        words(rng, 60, unlearned), words(rng, 2000, unlearned),
        " ".join(letters("abcdefghijklmnopqrstuvwxyz") for _ in range(60)), " ".join(letters("бвгджзклмнпрст") for _ in range(60)),
        base64.b64encode(rng.randbytes(600)).decode(),
    ]
    clean = [r for r in corpus if r[0] != 304 and any(c.isalpha() for c in r[1] or "")]
    rows = [*clean, *[(5000 + k, t, None, "s0") for k, t in enumerate(odd)]]
    stay = corpus_pipeline.identify_language(spark, documents(spark, rows), "")
    assert {r[0] for r in stay.collect()} == {r[0] for r in clean}


def test_languages_with_long_texts_only_are_learned(spark):
    rng = random.Random(12)
    stock = {x: ["".join(rng.choice(a) for _ in range(rng.randint(2, 8))) for _ in range(200)] for x, a in (("aa", "abcdefgh"), ("bb", "stuvwxyz"))}
    rows = [(words(rng, 50, stock["aa"]), "aa") for _ in range(20)] + [(words(rng, 20_000, stock["bb"]), "bb") for _ in range(3)]
    assert min(len(t) for t, lang in rows if lang == "bb") > 1 << 16
    df = spark.createDataFrame(rows, "text string, lang string")
    sizes = {r["lang"]: (r["n"], r["most"]) for r in language_id.sample(df, 300, 1 << 16).groupBy("lang").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("most")).collect()}
    assert sizes["aa"][0] == 20 and sizes["bb"] == (3, 1 << 16)
    model = language_id.fit(df)
    assert model.languages == ["aa", "bb"]
    found = language_id.identify(df.withColumnRenamed("lang", "given"), model).collect()
    assert len(found) == 23 and all(r["lang_pred"] == r["given"] for r in found)
