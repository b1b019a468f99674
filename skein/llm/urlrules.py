"""URL filters by association rules, in DataFrame functions only.

Explicit (host, path) rules come first. Combinations of URL tokens that imply a verdict with enough
confidence and support, and that no shorter combination implies as well, are mined from
labelled URLs and matched through an inverted index from each rule's rarest token.

Mining is exact, level by level (Apriori): nothing caps items, baskets or rules. Tokens that the same
labelled URLs have are one item. A combination is extended only while it can lead to a rule that is kept: a verdict
has the support with it but not all its URLs, and each part of it has more URLs than itself (otherwise the part
implies whatever it does). Each level is a written table. Items are at most the tokens of a labelled URL in the mean / min_support.
Data with exponentially many such combinations take that long.

Up to RULES rules of up to ITEMS items are matched within the row, by literal maps and without a
shuffle; more by joins, over the distinct token sets of the URLs that no explicit rule decides.

With sigmas, a rule's confidence has to be more than chance: the lower end of its interval
(Wilson) must be above the share that its verdict has among all labelled URLs.

Edge cases: null URLs and those without :// have empty host and path, fit no
explicit rule and have no tokens, so they get the default verdict; of several
mined rules the one with the most confidence, then support, then tokens, then
the first in order decides; without labelled URLs only explicit rules and the
default apply; null verdicts are no labels; rows that repeat and extra columns don't
matter, and where one has the name of a result, the result's gets an underscore
behind it; URLs of any length are read whole.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import free_names, stash

MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.9
#: The largest model that literal maps hold: items and rules. Larger ones are joined.
ITEMS, RULES = 1000, 200
DEFAULT = "allow"
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), SPLIT, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), SPLIT, 2)


def explicit_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest (verdict, host, path) rule that fits, else null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        chosen = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens: every suffix of the host, its labels, and the path's segments with digits masked."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda n: F.concat(F.lit("host:"), F.array_join(F.slice(labels, -F.least(n, F.greatest(F.size(labels), F.lit(1))), n), ".")))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, r"\d+", "#")))
    found = F.array_distinct(F.concat(suffixes, segments))
    return F.when(F.size(labels) > 0, found).otherwise(F.array().cast("array<string>"))


def literal_map(pairs: dict, value) -> Column:
    return F.create_map(*[x for k in sorted(pairs) for x in (F.lit(k), value(pairs[k]))])


def items_of(tokens: Column, item: dict[str, int]) -> Column:
    """The items that tokens stand for, each once, in order."""
    known = literal_map(item, F.lit)
    return F.array_sort(F.array_distinct(F.transform(F.filter(tokens, lambda t: F.map_contains_key(known, t)), lambda t: known[t])))


def wilson(share: Column, n: Column, sigmas: float) -> Column:
    """Lower end of the interval of a share of n."""
    z = sigmas**2
    return (share + z / (2 * n) - sigmas * F.sqrt(share * (1 - share) / n + z / (4 * n * n))) / (1 + z / n)


def frequent_items(labelled: DataFrame, count: dict[str, int], floor: float) -> dict[str, int]:
    """The number of the item of each frequent token, the most telling ones first."""
    total = sum(count.values())
    basket = F.xxhash64("tokens").cast("decimal(38,0)")
    rows = labelled.select(F.explode("tokens").alias("token"), "verdict", basket.alias("a"), F.xxhash64("tokens", F.lit(1)).cast("decimal(38,0)").alias("b"))
    by_verdict = [F.count(F.when(F.col("verdict") == v, 1)).alias(f"n{i}") for i, v in enumerate(sorted(count))]
    each = rows.groupBy("token").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"), *by_verdict).where(F.col("n") >= floor)
    # How far the verdicts of a token's URLs are from those of all, in chi-square.
    far = sum(((F.col(f"n{i}") - F.col("n") * (count[v] / total)) ** 2 / (F.col("n") * (count[v] / total)) for i, v in enumerate(sorted(count))), F.lit(0.0))
    same = each.withColumn("far", far).groupBy("n", "a", "b").agg(F.max("far").alias("far"), F.collect_list("token").alias("tokens"))
    best = same.select("far", F.array_sort("tokens").alias("tokens")).orderBy(F.desc("far"), "tokens").collect()
    return {t: i for i, r in enumerate(best) for t in r.tokens}


def with_items(rows: DataFrame, item: dict[str, int]) -> DataFrame:
    """Rows (tokens, ...) with the items that tokens stand for, each once, in order. Token sets without items may be left out."""
    if len(item) <= ITEMS:
        return rows.withColumn("items", items_of(F.col("tokens"), item))
    known = rows.sparkSession.createDataFrame(sorted(item.items()), "token string, item int")
    found = rows.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token")).join(known, "token")
    return rows.join(found.groupBy("tokens").agg(F.array_sort(F.collect_set("item")).alias("items")), "tokens")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = 1, sigmas: float = 0.0) -> tuple[DataFrame | None, dict[str, int]]:
    """All rules from (tokens, verdict): a table of items, verdict, confidence, support and key (the
    rarest item), or None; and the item of each token."""
    labelled = labelled.where("verdict IS NOT NULL")
    # Verdicts are few, so are these counts.
    count = {r.verdict: r.n for r in labelled.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    total = sum(count.values())
    floor = max(min_count, min_support * total)
    item = frequent_items(labelled, count, floor) if total else {}
    if not item:
        return None, {}
    verdicts = sorted(count)
    every = range(len(verdicts))
    sums = [F.sum(f"c{i}").alias(f"c{i}") for i in every]
    sets = labelled.groupBy("tokens").agg(*[F.count(F.when(F.col("verdict") == v, 1)).alias(f"c{i}") for i, v in enumerate(verdicts)])
    baskets = with_items(sets, item).groupBy("items").agg(*sums)
    # Where each combination occurs: what its baskets have behind its last item.
    behind = F.slice("items", F.col("pos") + 2, F.size("items"))
    places = stash(baskets.select("*", F.posexplode("items").alias("pos", "item")).select(F.array("item").alias("set"), behind.alias("rest"), *[f"c{i}" for i in every]), "places")
    n = sum((F.col(f"c{i}") for i in every), F.lit(0))
    enough = [F.col(f"c{i}") >= floor - 1e-9 for i in every]
    level, size, levels = None, 1, []
    while True:
        met = places.groupBy("set").agg(*sums).withColumn("n", n)
        if level is None:
            met = met.select("*", *[F.lit(0.0).alias(f"best{i}") for i in every])
        else:
            part = F.explode(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: F.concat(F.slice("set", 1, k - 1), F.slice("set", k + 1, size)))).alias("part")
            below = level.select(F.col("set").alias("part"), F.col("n").alias("m"), *[F.col(f"up{i}").alias(f"best{i}") for i in every])
            sound = met.select("set", part).join(below, "part").groupBy("set").agg(F.count("*").alias("parts"), F.min("m").alias("m"), *[F.max(f"best{i}").alias(f"best{i}") for i in every])
            met = met.join(sound.where(F.col("parts") == size), "set").where("m > n").drop("parts", "m")
        share = [F.col(f"c{i}") / F.col("n") for i in every]
        fits = [enough[i] & (share[i] >= min_confidence) & (wilson(share[i], F.col("n"), sigmas) > count[v] / total if sigmas else F.lit(True)) for i, v in enumerate(verdicts)]
        rule = [F.when(fits[i] & (share[i] > F.col(f"best{i}")), share[i]).alias(f"rule{i}") for i in every]
        up = [F.greatest(f"best{i}", F.when(fits[i], share[i]).otherwise(0.0)).alias(f"up{i}") for i in every]
        more = F.lit(False)
        for i in every:
            more = more | (enough[i] & (F.col(f"c{i}") < F.col("n")))
        found = stash(met.select("set", "n", *[f"c{i}" for i in every], *rule, *up, more.alias("more")).where(" OR ".join(["more", *[f"rule{i} IS NOT NULL" for i in every]])), "combinations")
        levels.append(found)
        level = found.where("more")
        if not level.limit(1).count():
            break
        size += 1
        open_places = places.join(level.select("set"), "set").where(F.size("rest") > 0)
        grown = open_places.select("set", F.col("rest").alias("items"), *[f"c{i}" for i in every], F.posexplode("rest").alias("pos", "item"))
        places = stash(grown.select(F.concat("set", F.array("item")).alias("set"), behind.alias("rest"), *[f"c{i}" for i in every]).groupBy("set", "rest").agg(*sums), "places")
    kinds = F.array(*[F.struct((-F.col(f"rule{i}")).alias("less"), F.lit(v).alias("verdict"), F.col(f"c{i}").alias("c")) for i, v in enumerate(verdicts)])
    # Of the verdicts of a combination the most confident one.
    best = F.array_min(F.filter(kinds, lambda x: x["less"].isNotNull())).alias("best")
    rules = None
    for found in levels:
        own = found.select(F.col("set").alias("items"), best).where("best IS NOT NULL")
        rules = own if rules is None else rules.unionByName(own)
    rules = rules.select("items", "best.verdict", (-F.col("best.less")).alias("confidence"), (F.col("best.c") / total).alias("support"))
    rarity = places_of_one(baskets, every)
    keys = rules.select("items", F.explode("items").alias("item")).join(rarity, "item").groupBy("items").agg(F.min(F.struct("n", "item"))["item"].alias("key"))
    return stash(rules.join(keys, "items"), "url-rules"), item


def places_of_one(baskets: DataFrame, every: range) -> DataFrame:
    """(item, n): the labelled URLs of each item."""
    one = baskets.select(F.explode("items").alias("item"), sum((F.col(f"c{i}") for i in every), F.lit(0)).alias("n"))
    return one.groupBy("item").agg(F.sum("n").alias("n"))


def joined_verdicts(tokens: DataFrame, rules: DataFrame, item: dict[str, int]) -> DataFrame:
    """(tokens, verdict, shown) of the distinct token sets that a rule fits: the verdict of the best one, and its tokens."""
    known = tokens.sparkSession.createDataFrame(sorted(item.items()), "token string, item int")
    pairs = tokens.distinct().select("tokens", F.explode("tokens").alias("token")).join(known, "token")
    own = stash(pairs.groupBy("tokens").agg(F.array_sort(F.collect_list(F.struct("token", "item"))).alias("own")), "url-items")
    asked = own.select("tokens", "own", F.explode(F.array_distinct("own.item")).alias("key")).join(rules, "key")
    fit = asked.where(F.size(F.array_except("items", F.col("own.item"))) == 0)
    order = F.struct("confidence", "support", F.size("items").alias("size"), F.transform("items", lambda x: -x).alias("first"), "verdict", "items")
    best = fit.groupBy("tokens").agg(F.max(order).alias("best")).join(own, "tokens")
    shown = F.filter("own", lambda x: F.array_contains(F.col("best.items"), x["item"]))
    return best.select("tokens", F.col("best.verdict").alias("verdict"), F.array_join(shown["token"], " ").alias("shown"))


def mined_verdict(tokens: Column, rules: list[dict], item: dict[str, int]) -> Column:
    """(verdict, items) of the best rule that fits the tokens, else null."""
    kind = "struct<confidence:double,support:double,size:int,rank:int,verdict:string,items:array<int>>"
    if not rules:
        return F.lit(None).cast(kind)
    index: dict[int, list[Column]] = {}
    for rank, r in enumerate(rules):
        posting = F.struct(F.lit(float(r["confidence"])).alias("confidence"), F.lit(float(r["support"])).alias("support"), F.lit(len(r["items"])).alias("size"), F.lit(-rank).alias("rank"), F.lit(r["verdict"]).alias("verdict"), F.array(*map(F.lit, r["items"])).alias("items"))
        index.setdefault(r["key"], []).append(posting)
    used = {i for r in rules for i in r["items"]}
    own = items_of(tokens, {t: i for t, i in item.items() if i in used})
    postings = literal_map(index, lambda found: F.array(*found))
    met = F.flatten(F.transform(F.filter(own, lambda i: F.map_contains_key(postings, i)), lambda i: postings[i]))
    return F.array_max(F.filter(met, lambda r: F.size(F.array_except(r["items"], own)) == 0))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame | None = None, url: str = "url", **thresholds) -> DataFrame:
    """All rows with host, path, rule, verdict and mined (the tokens of the mined rule that decided, else null).

    labelled: (url, verdict) rows to mine from; by default the URLs that an explicit rule decides.
    """

    def parsed(df: DataFrame) -> DataFrame:
        return df.withColumns({"skein_host": host_of(F.col(url)), "skein_path": path_of(F.col(url))})

    tokens, explicit = tokens_of(F.col("skein_host"), F.col("skein_path")), explicit_rule(F.col("skein_host"), F.col("skein_path"), rules)
    if labelled is None:
        labelled = parsed(pages.select(url)).withColumn("verdict", explicit["verdict"])
    else:
        labelled = parsed(labelled.select(url, "verdict"))
    model, item = mine(labelled.select(tokens.alias("tokens"), "verdict").where(F.size("tokens") > 0), **thresholds)
    held = model.limit(RULES + 1).collect() if model is not None else []
    out = parsed(pages).withColumn("skein_rule", explicit)
    used = {i for r in held for i in r["items"]}
    if len(held) <= RULES and sum(i in used for i in item.values()) <= ITEMS:
        mined = [r.asDict() for r in sorted(held, key=lambda r: (-r.confidence, -r.support, len(r["items"]), r["items"], r.verdict))]
        out = out.withColumn("skein_mined", F.when(F.col("skein_rule").isNull(), mined_verdict(tokens, mined, item)))
        own = literal_map({t: i for t, i in item.items() if i in used}, F.lit) if used else None
        shown = F.filter(tokens, lambda t: F.array_contains(F.col("skein_mined.items"), own[t])) if used else F.array().cast("array<string>")
        implied, shown = F.col("skein_mined.verdict"), F.when(F.col("skein_mined").isNotNull(), F.array_join(F.array_sort(shown), " "))
    else:
        out = out.withColumn("skein_tokens", F.when(F.col("skein_rule").isNull(), tokens))
        found = joined_verdicts(out.where("skein_tokens IS NOT NULL").select(F.col("skein_tokens").alias("tokens")), model, item)
        out = out.join(found.select(F.col("tokens").alias("skein_tokens"), F.col("verdict").alias("skein_implied"), F.col("shown").alias("skein_shown")), "skein_tokens", "left")
        implied, shown = F.col("skein_implied"), F.col("skein_shown")
    found = [F.col("skein_host"), F.col("skein_path"), F.col("skein_rule.rule"), F.coalesce("skein_rule.verdict", implied, F.lit(DEFAULT)), shown]
    names = free_names(("host", "path", "rule", "verdict", "mined"), pages.columns)
    return out.select(*[F.col(f"`{c}`") for c in pages.columns], *[x.alias(n) for x, n in zip(found, names, strict=True)])
