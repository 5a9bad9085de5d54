"""URL rules by a blocked Bloom filter and an exact join (built-in DataFrame functions only)."""

from pyspark.sql import DataFrame, functions as F

from scenegrade.llm.common import pick

#: 64-bit words of the filter at most, bits set for each key, rules that may be broadcast for the exact join.
MOST_WORDS, HASHES, BROADCAST_RULES = 1 << 20, 5, 100_000


def _ascii_lower(text):
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url):
    """Host: after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased. Path: from there up to '?' or '#'."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return _ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def _place(key, words):
    """Word of the filter and mask of a key: the blocks of this filter are single 64-bit words."""
    h = F.xxhash64(key)
    bits = F.xxhash64(key, F.lit("bits"))
    mask = F.lit(0).cast("bigint")
    for k in range(HASHES):
        # shiftright keeps the sign; six bits of each part are used
        at = F.shiftright(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), at))
    return F.pmod(h, F.lit(words)).alias("word"), mask.alias("mask")


def canonical_rules(rules: DataFrame) -> DataFrame:
    """Distinct rules (host, path, verdict): host in lower case, null path empty; 'block' wins over 'allow' for one key.

    Rules with a null or empty host, or a verdict that is neither, don't count.
    """
    clean = pick(rules, host="host", path="path", verdict="verdict").filter("verdict in ('block', 'allow')")
    clean = clean.withColumn("host", _ascii_lower("host")).withColumn("path", F.coalesce("path", F.lit("")))
    return clean.filter("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))


def bloom_words(rules: DataFrame, n_rules: int) -> tuple[DataFrame, int]:
    """The filter as rows (word, filled) and its number of words: a power of two of about 16 bits a rule, bounded."""
    words = 64
    while words < MOST_WORDS and words * 4 < n_rules:
        words *= 2
    word, mask = _place(F.concat_ws("", "host", "path"), words)
    return rules.select(word, mask).groupBy("word").agg(F.bit_or("mask").alias("filled")), words


def judge_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", id_column: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of `pages`.

    A rule fits its host and all subdomains if the url's path starts with the rule's path; the longest rule (host and
    path together, then host) wins; no rule gives `otherwise`. Every different (host, path) is judged once: its host
    suffixes with the path prefixes of the lengths that rules have are looked up in the filter (words are broadcast, at
    most MOST_WORDS), and possible hits are joined with the rules, which removes false positives. Null urls and urls
    without '://' have empty host and path. An empty host fits no rule. Rows keep their number, repeated ids too.
    """
    rules = canonical_rules(rules)
    n_rules = rules.count()
    # Distinct path lengths of rules: at most one small integer per length.
    lengths = rules.agg(F.sort_array(F.collect_set(F.length("path")))).first()[0] or [0]
    host, path = host_and_path(F.col("url"))
    urls = pick(pages, page_id=id_column, url="url").select("page_id", host.alias("host"), path.alias("path"))
    places = urls.filter("host <> ''").select("host", "path").distinct()

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    prefixes = F.transform(fits, lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = (
        places.withColumn("rule_host", F.explode(suffixes)).withColumn("rule_path", F.explode(prefixes))
    )
    filled, words = bloom_words(rules, n_rules)
    word, mask = _place(F.concat_ws("", "rule_host", "rule_path"), words)
    possible = (
        keys.withColumn("word", word).withColumn("mask", mask).join(F.broadcast(filled), "word")
        .filter(F.col("filled").bitwiseAND(F.col("mask")) == F.col("mask"))
    )
    listed = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    listed = F.broadcast(listed) if n_rules <= BROADCAST_RULES else listed
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("all"), F.length("rule_host").alias("of_host"),
        F.concat_ws("", "rule_host", "rule_path").alias("rule"), "verdict",
    )
    best = possible.join(listed, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max(rank).alias("best"))
    out = urls.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
