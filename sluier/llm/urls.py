"""URL filters: rules first, then a character language-model ratio for URLs that no rule judges.

Two smoothed variable-order Markov models over characters, one of URLs that the rules allow and one of URLs that
they block, counted over all such URLs. A context is used at the longest length (ORDER at most) at which it was
seen; shorter ones smooth it (Witten and Bell). All counts are kept, in a written table that the grams of the URLs
to be scored are joined to. The whole URL is counted and scored, with scheme, query and fragment. A URL's
score is its log-likelihood difference divided by its length. The threshold is the score that best tells allowed from blocked URLs of a fifth that the models have not seen.

Defined cases: a null url, or one without ://, has empty host and path; a null or empty url has score 0; rules of
equal length are tried in the order given; without judged URLs of both kinds
all other URLs are allowed; repeated rows are judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluier.session import materialise

ORDER, FOLDS, SALTS = 4, 5, 16
#: Scores are binned at this width between -LIMIT and LIMIT to find the threshold.
BIN, LIMIT = 0.01, 5.0
ALPHABET = 256

# Host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def split_url(url: Column) -> tuple[Column, Column]:
    parts = "://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), parts, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(F.coalesce(url, F.lit("")), parts, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


@dataclass
class MarkovModel:
    """Counts of (context + character) for each order; context sums and kinds follow from them."""

    cells: dict[str, int]
    sums: dict[str, int] = field(default_factory=dict)
    kinds: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for gram, n in self.cells.items():
            context = gram[:-1]
            self.sums[context] = self.sums.get(context, 0) + n
            self.kinds[context] = self.kinds.get(context, 0) + 1

    def probability(self, context: str, char: str) -> float:
        p = 1 / ALPHABET
        for k in range(len(context) + 1):
            used = context[len(context) - k :]
            total = self.sums.get(used)
            if total is None:
                break
            kinds = self.kinds[used]
            p = (self.cells.get(used + char, 0) + kinds * p) / (total + kinds)
        return p


def count_grams(urls: DataFrame) -> DataFrame:
    """(verdict, gram, n) over all rows of (verdict, text): characters with contexts of 0 to ORDER characters."""
    places = F.sequence(F.lit(1), F.length("text"))
    grams = F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.greatest(F.lit(1), i - ORDER), i), lambda j: F.substring(F.col("text"), j, i - j + 1))))
    return urls.filter(F.length("text") > 0).select("verdict", F.explode(grams).alias("gram")).groupBy("verdict", "gram").agg(F.count(F.lit(1)).alias("n"))


def count_table(urls: DataFrame) -> DataFrame:
    """(gram, allow, block): all counts of (text, verdict) of judged URLs."""
    counted = count_grams(urls).groupBy("gram")
    of = lambda v: F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v)
    return counted.agg(of("allow"), of("block"))


def gram_ratios(wanted: DataFrame, cells: DataFrame) -> DataFrame:
    """(gram, ratio) of the grams wanted, which hold the ends of each gram too: the log-likelihood difference of the two models.

    As MarkovModel.probability, for all grams of a length at once: a gram's value follows from that of its end.
    """
    context = F.expr("substring(gram, 1, length(gram) - 1)")
    sums = cells.groupBy(context.alias("context")).agg(*(f for v in ("allow", "block") for f in (F.sum(v).alias(f"{v}_total"), F.count_if(F.col(v) > 0).alias(f"{v}_kinds"))))
    known = wanted.join(cells, "gram", "left").withColumn("context", context).join(sums, "context", "left").fillna(0)
    known = materialise(known.drop("context"), "grams")
    done, shorter = None, None
    for k in range(1, ORDER + 2):
        level = known.filter(F.length("gram") == k)
        if shorter is None:
            level = level.withColumns({f"{v}_end": F.lit(1 / ALPHABET) for v in ("allow", "block")})
        else:
            level = level.withColumn("end", F.expr("substring(gram, 2)")).join(shorter.select(F.col("gram").alias("end"), F.col("allow_p").alias("allow_end"), F.col("block_p").alias("block_end")), "end")
        p = lambda v: F.when(F.col(f"{v}_total") > 0, (F.col(v) + F.col(f"{v}_kinds") * F.col(f"{v}_end")) / (F.col(f"{v}_total") + F.col(f"{v}_kinds"))).otherwise(F.col(f"{v}_end"))
        shorter = materialise(level.select("gram", p("allow").alias("allow_p"), p("block").alias("block_p")), "level")
        done = shorter if done is None else done.unionByName(shorter)
    return done.select("gram", (F.log("allow_p") - F.log("block_p")).alias("ratio"))


def scores(texts: DataFrame, cells: DataFrame) -> DataFrame:
    """(row, score) of (row, text): the mean ratio over the characters. row is unique; a text without characters has no row.

    Counts are joined, never collected. A gram that many URLs hold is dealt to SALTS parts.
    """
    at = F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.substring(F.col("text"), F.greatest(F.lit(1), i - ORDER), F.least(i, F.lit(ORDER + 1))))
    held = materialise(texts.filter(F.length("text") > 0).select("row", F.explode(at).alias("gram")).groupBy("row", "gram").agg(F.count(F.lit(1)).alias("n")), "held")
    ends = F.transform(F.sequence(F.lit(1), F.length("gram")), lambda i: F.expr("gram").substr(i, F.length("gram")))
    ratios = gram_ratios(materialise(held.select("gram").distinct().select(F.explode(ends).alias("gram")).distinct(), "wanted"), cells)
    dealt = ratios.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    valued = held.withColumn("salt", F.pmod(F.hash("row"), F.lit(SALTS))).join(dealt, ["gram", "salt"])
    # Rounded, so that the order of the sum doesn't tell.
    return valued.groupBy("row").agg(F.round(F.sum(F.col("n") * F.col("ratio")) / F.sum("n"), 9).alias("score"))


def _threshold(bins: list[tuple[int, int, int]]) -> float:
    """The border with the best mean of both kinds' hit rates; of equal ones the nearest to 0."""
    allow, block = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not allow or not block:
        return 0.0
    best, below_allow, below_block = (0.5, 0.0, 0.0), 0, 0
    for i, (at, a, b) in enumerate(bins):
        below_allow, below_block = below_allow + a, below_block + b
        border = (at + (bins[i + 1][0] if i + 1 < len(bins) else at + 1)) / 2 * BIN
        best = max(best, (((allow - below_allow) / allow + below_block / block) / 2, -abs(border), border))
    return best[2]


def judge(pages: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages with host, path, rule, verdict and score (null where a rule judges); columns of these names are replaced."""
    host, path = split_url(F.col(url))
    rows = pages.withColumns({"host": host, "path": path}).withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = materialise(rows.withColumn("__text", F.coalesce(url, F.lit(""))).withColumn("__row", F.monotonically_increasing_id()), "urls")
    fold = F.pmod(F.crc32(F.col("__text")), F.lit(FOLDS))
    judged, free = F.col("__rule").isNotNull(), F.col("__rule").isNull()
    cells = materialise(count_table(rows.filter(judged & (fold > 0)).select(F.col("__text").alias("text"), F.col("__rule.verdict").alias("verdict"))), "counts")
    seen = cells.agg(F.coalesce(F.max("allow"), F.lit(0)), F.coalesce(F.max("block"), F.lit(0))).first()
    if not all(seen):
        rows = rows.withColumn("score", F.lit(None).cast("double"))
        verdict = F.coalesce("__rule.verdict", F.lit("allow"))
    else:
        scored = scores(rows.filter(free | (fold == 0)).select(F.col("__row").alias("row"), F.col("__text").alias("text")), cells)
        rows = rows.join(scored.withColumnRenamed("row", "__row"), "__row", "left").withColumn("score", F.when(free | (fold == 0), F.coalesce("score", F.lit(0.0))))
        rows = materialise(rows, "scored")
        place = F.round(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("score"))) / BIN).cast("int")
        bins = rows.filter(judged & (fold == 0)).groupBy(place.alias("bin")).agg(F.count_if(F.col("__rule.verdict") == "allow").alias("allow"), F.count_if(F.col("__rule.verdict") == "block").alias("block"))
        threshold = _threshold(sorted((r["bin"], r["allow"], r["block"]) for r in bins.collect()))
        rows = rows.withColumn("score", F.when(free, F.col("score")))
        verdict = F.coalesce("__rule.verdict", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return rows.withColumn("verdict", verdict).withColumn("rule", F.col("__rule.rule")).drop("__rule", "__text", "__row")


def op6(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
