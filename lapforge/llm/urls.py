"""URL filters: rules first, then gradient-boosted trees on lexical features.

A rule (host, path start) fits its host, all its subdomains, and every path that starts with
its own; the longest rule wins, of equally long ones that with the longer host, and of a rule
given twice the one that blocks. URLs without a rule get the verdict of gradient-boosted trees
trained from labelled URLs: length, depth, digit ratio, character entropy, parameter counts
and suffix statistics (how often labelled URLs of the same host suffix are bad, smoothed
towards the overall rate; a training URL's statistic leaves out the labels of its own fold).

DataFrame functions and Spark's own trees only. Training takes at most SAMPLE labelled rows,
those with the least seeded hash of key and URL; suffix statistics count all labelled rows. If
these rows hold one kind of label only, half of the sample is taken from each kind and weighted
by its share of the table.

Rules are one CASE; more than MAX_RULES of them are a table that is joined with the suffixes of
each distinct host, and the hosts' rules with the URLs.

Defined results: a null URL, or one without ://, has an empty host and path, fits no rule and
has features 0. Null labels don't train. Without labels of both kinds every URL without a
rule is allowed. Repeated rows are judged alike; an empty table gives an empty table. Columns of urls named host, path, rule, verdict
or by_model give way to those of the result; others come through untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, least_hashed, lower_ascii, stage

SAMPLE, FOLDS, SMOOTHING, TREES, DEPTH = 20_000, 5, 10.0, 10, 4
#: Host suffixes have one row each; broadcast up to this many.
MAX_BROADCAST = 100_000
#: Rules that go into one CASE at most.
MAX_RULES = 1000
KINDS = ("site", "top")
RESULT = ("host", "path", "rule", "verdict", "by_model")
FEATURES = (
    "length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "n_params",
    "n_hyphens", "host_labels", "secure", "fragment", "site_rate", "top_rate",
)


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z lower-cased."""
    return F.when(F.instr(url, "://") > 0, lower_ascii(F.regexp_extract(_after(url), r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _after(url: Column) -> Column:
    return F.substr(url, F.instr(url, "://") + 3)


def _rank(verdict: str, host: str, start: str) -> tuple[int, int, int]:
    """The order of rules, first the one that wins; rules of equal rank that fit one URL are the same."""
    return -len(host) - len(start), -len(host), int(verdict != "block")


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """A struct (rule, verdict) of the first rule by rank that fits, or null. rules: (verdict, host,
    path start with its slash). One CASE."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: _rank(*r), reverse=True):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _with_rules(rows: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """rows (with host and path) and their __rule, by a join: the rules of every suffix of a
    distinct host by rank, then the first of them that fits the path."""
    listed = [(*_rank(*r), *r) for r in rules]
    table = rows.sparkSession.createDataFrame(listed, "r1 int, r2 int, r3 int, verdict string, suffix string, start string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = rows.select("host").distinct().select("host", F.explode(suffixes).alias("suffix"))
    rule = F.struct("r1", "r2", "r3", "start", F.struct(F.concat("suffix", "start").alias("rule"), "verdict").alias("said"))
    found = hosts.join(table, "suffix").groupBy("host").agg(F.sort_array(F.collect_list(rule)).alias("__rules"))
    found = stage(found, "host_rules")
    joined = rows.join(broadcast_if_small(found, MAX_BROADCAST), "host", "left")
    first = F.get(F.filter("__rules", lambda x: F.startswith(F.col("path"), x["start"])), 0)
    return joined.withColumn("__rule", first["said"]).drop("__rules")


def _entropy(text: Column) -> Column:
    """Bits a character of its own distribution of characters."""
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.when(n > 0, F.aggregate(chars, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))).otherwise(0.0)


def lexical_features(urls: DataFrame, url: Column) -> DataFrame:
    """urls with host, path, site (last three labels of the host), top (last two) and the
    lexical features."""
    text = F.coalesce(url, F.lit(""))
    out = urls.withColumns({"host": host_of(text), "path": path_of(text)})
    host, path = F.col("host"), F.col("path")
    n = F.length(text)
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    known = host != ""
    counts = {
        "length": n,
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")),
        "digit_ratio": F.when(n > 0, F.regexp_count(text, F.lit("[0-9]")) / n).otherwise(0.0),
        "entropy": _entropy(text),
        "n_params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "n_hyphens": F.regexp_count(text, F.lit("[-_]")),
        "host_labels": F.size(F.split(host, r"\.")),
        "secure": text.startswith("https:").cast("int"),
        "fragment": text.contains("#").cast("int"),
    }
    out = out.withColumns({k: F.when(known, v).otherwise(0).cast("double") for k, v in counts.items()})
    return out.withColumns({"site": F.substring_index(host, ".", -3), "top": F.substring_index(host, ".", -2)})


def _with_rates(df: DataFrame, stats: DataFrame, rate: float, own_fold: bool = False) -> DataFrame:
    """df with the smoothed share of bad URLs by site and top; own_fold: without the labels of
    the row's fold."""
    for kind in KINDS:
        some = stats.where(F.col("kind") == kind).select(F.col("suffix").alias(kind), F.col("bad").alias("__bad"), F.col("n").alias("__n"))
        df = df.join(broadcast_if_small(some, MAX_BROADCAST), kind, "left")
        total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
        counted = lambda c: F.coalesce(total(c) - (F.get(c, F.col("fold").cast("int")) if own_fold else 0), F.lit(0))
        share = (counted("__bad") + SMOOTHING * rate) / (counted("__n") + SMOOTHING)
        df = df.withColumn(f"{kind}_rate", share).drop("__bad", "__n")
    return df


def _sampled(rows: DataFrame, sample: int, total: int, bad: int) -> DataFrame:
    """At most sample of the rows, with a weight; of both kinds of label, as rows has both."""
    taken = stage(least_hashed(rows, sample, total, "rank", "url", "bad").withColumn("weight", F.lit(1.0)), "taken")
    if taken.select("bad").distinct().count() > 1:
        return taken
    half, kinds = max(1, sample // 2), []
    for kind, n in ((0, total - bad), (1, bad)):
        some = least_hashed(rows.where(F.col("bad") == kind), half, n, "rank", "url")
        kinds.append(some.withColumn("weight", F.lit(n / min(n, half))))
    return kinds[0].union(kinds[1])


def train(labelled: DataFrame, sample: int = SAMPLE, key: str = "url"):
    """(trees or None, suffix statistics: counts by fold, overall rate) from (url, bad: 0 or 1). key names a
    column that tells rows with the same URL apart, so that the sample doesn't take them all
    or none."""
    rows = labelled.where("url is not null and bad is not null").select("url", "bad", F.xxhash64(key, "url", F.lit(10)).alias("rank"))
    rows = lexical_features(rows, F.col("url")).withColumn("fold", F.pmod(F.xxhash64("url", F.lit(9)), F.lit(FOLDS)))
    rows = stage(rows, "labelled")
    total, bad = rows.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
    rate = bad / total if total else 0.0
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("suffix")) for k in KINDS]))
    mine = [F.col("fold") == f for f in range(FOLDS)]
    stats = rows.select(pairs.alias("x"), "fold", "bad").groupBy("x.kind", "x.suffix").agg(
        F.array(*[F.sum(F.when(m, F.col("bad")).otherwise(0)).cast("long") for m in mine]).alias("bad"),
        F.array(*[F.count_if(m) for m in mine]).alias("n"),
    )
    stats = stage(stats, "stats")
    if not 0 < bad < total:
        return None, stats, rate
    rows = _with_rates(_sampled(rows, sample, total, bad), stats, rate, own_fold=True)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", F.col("bad").cast("double").alias("label"), "weight")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=1, maxBins=32, weightCol="weight")
    return trees.fit(stage(vectors, "vectors")), stats, rate


def judge(urls: DataFrame, model, rules: Sequence[tuple[str, str, str]], url: Column) -> DataFrame:
    """urls with host, path, rule, verdict (allow or block) and by_model (the trees' verdict)."""
    trees: GBTClassificationModel | None
    trees, stats, rate = model
    others = [c for c in urls.columns if c not in RESULT]
    kept = urls.select(F.struct(F.lit(0).alias("_"), *others).alias("__row"), url.alias("__url"))  # names can't clash then
    rows = _with_rates(lexical_features(kept, F.col("__url")), stats, rate)
    if trees is not None:
        rows = trees.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))
        by_model = F.when((F.col("prediction") == 1) & (F.col("host") != ""), "block").otherwise("allow")
    else:
        by_model = F.lit("allow")
    if len(rules) > MAX_RULES:
        rows = _with_rules(rows, rules)
    else:
        rows = rows.withColumn("__rule", matching_rule(F.col("host"), F.col("path"), rules))
    return rows.select(
        *[F.col("__row")[c].alias(c) for c in others],
        "host",
        "path",
        F.col("__rule.rule").alias("rule"),
        F.coalesce("__rule.verdict", by_model).alias("verdict"),
        by_model.alias("by_model"),
    )


def held_out_auc(labelled: DataFrame, fold: int = 0, key: str = "url") -> float:
    """ROC-AUC of trees trained without one of FOLDS parts of the labelled URLs, on that part."""
    part = F.pmod(F.xxhash64("url", F.lit(21)), F.lit(FOLDS)) == fold
    columns = dict.fromkeys((key, "url", "bad"))
    labelled = stage(labelled.where("url is not null and bad is not null").select(*columns, part.alias("held")), "split")
    trees, stats, rate = train(labelled.where("not held"), key=key)
    if trees is None:
        return float("nan")
    held = _with_rates(lexical_features(labelled.where("held").select("url", "bad"), F.col("url")), stats, rate)
    held = trees.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(held))
    return BinaryClassificationEvaluator(labelCol="bad").evaluate(held)
