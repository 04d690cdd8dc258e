"""URL filters: rules first, boosted trees on lexical features for the rest.

A rule is a host and the beginning of a path; it fits its host and all subdomains; the longest fitting
rule decides. The URLs that rules decide are the labelled ones: trees learn block or allow from their
length, depth, digits, entropy, parameters and punctuation, and from suffix statistics (how often the
last one and two labels of a host, and the latter with the first part of the path, were blocked among the examples,
smoothed), and judge the URLs
that no rule fits. An example's own suffix statistics come from the examples of the other folds, so that it doesn't
tell its label. Other labelled URLs can be given instead. `held_out` measures the trees on labelled URLs that
they haven't seen.

The trees are fitted on at most about `examples` labelled URLs, chosen by a hash, so the suffix table is bounded
by it too and is broadcast. Everything else is one pass over the URLs with built-in functions.

Defined results: a null URL, or one without ://, has an empty host and path; it is judged like any other
that no rule fits; where the labelled URLs don't show both verdicts, what no rule fits is allowed;
repeated rows come out as often as they go in; columns of other names are left alone; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import boosting
from lectern.llm.common import LOWER, UPPER, hashed_sample, let, written


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of the rules (host and path, as in `example.net/en/`) that fits, or null."""
    found = F.lit(None).cast("string")
    for text in sorted(rules, key=len):
        of, slash, start = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + start)
        found = F.when(fits, F.lit(text)).otherwise(found)
    return found


def _entropy(text: Column) -> Column:
    """Bits a character, from the lengths of the runs of equal characters in order."""

    def of(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        part = lambda run: run * F.log2(F.greatest(run, F.lit(1.0)))

        def step(acc: Column, c: Column) -> Column:
            same = c == acc["last"]
            return F.struct(c.alias("last"), F.when(same, acc["run"] + 1).otherwise(1.0).alias("run"), F.when(same, acc["sum"]).otherwise(acc["sum"] + part(acc["run"])).alias("sum"))

        start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
        return F.aggregate(chars, start, step, lambda acc: F.log2(n) - (acc["sum"] + part(acc["run"])) / n)

    return let(F.array_sort(F.split(text, "")), of)


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")


FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_share", "host_digits", "entropy", "parameters", "query_length", "hyphens", "host_hyphens", "fragment", "secure", "extension", "escapes", "suffix_blocked", "suffix_met", "domain_blocked", "domain_met", "section_blocked", "section_met")


def _plain(url: Column, h: Column, p: Column) -> list[Column]:
    u = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(u, "\\?([^#]*)", 1)
    n = F.greatest(F.length(u), F.lit(1))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        F.length(u).cast("double"), F.length(h).cast("double"), F.length(p).cast("double"), _count(p, "/"), _count(h, "."), _count(u, "0123456789") / n, _count(h, "0123456789"), _entropy(u),
        _count(query, "="), F.length(query).cast("double"), _count(u, "-"), _count(h, "-"), flag(u.contains("#")), flag(u.startswith("https:")), flag(p.rlike("\\.[a-z]{2,5}$")), _count(u, "%"),
    ]


FOLDS = 5


def _ends() -> dict[str, Column]:
    """The last label of a host, the last two, and these with the first part of the path."""
    domain = F.regexp_extract("host", "[^.]*\\.?[^.]*$", 0)
    return {"suffix": F.element_at(F.split("host", "\\."), -1), "domain": domain, "section": F.concat(domain, F.regexp_extract("path", "^/[^/]*", 0))}


def _counted(known: DataFrame) -> dict[str, DataFrame]:
    """Of each ending of hosts: how many examples they have, and how many of those are blocked. At most `examples` rows each."""
    return {name: known.groupBy(part.alias(f"_{name}")).agg(F.sum("label").alias(f"{name}_yes"), F.count("*").cast("double").alias(f"{name}_n")) for name, part in _ends().items()}


def _featured(df: DataFrame, stats: dict[str, DataFrame], own: dict[str, DataFrame] | None = None) -> DataFrame:
    """df (url, host, path) with f. own: statistics by `fold` to take off those of the whole."""
    df = df.withColumns({f"_{name}": part for name, part in _ends().items()})
    more = []
    for name, s in stats.items():
        df = df.join(F.broadcast(s), f"_{name}", "left")
        yes, n = F.coalesce(f"{name}_yes", F.lit(0.0)), F.coalesce(f"{name}_n", F.lit(0.0))
        if own:
            df = df.join(F.broadcast(own[name]), ["fold", f"_{name}"], "left")
            yes, n = yes - F.coalesce(f"{name}_own_yes", F.lit(0.0)), n - F.coalesce(f"{name}_own_n", F.lit(0.0))
        more += [(yes + 1) / (n + 2), F.log1p(n)]
    return df.withColumn("f", F.array(*_plain(F.col("url"), F.col("host"), F.col("path")), *more))


def _fit(known: DataFrame) -> tuple[boosting.Trees | None, dict[str, DataFrame]]:
    """Trees from examples (url, host, path, label, fold), and the suffix statistics that go with them."""
    stats = _counted(known)
    own = {name: known.groupBy("fold", part.alias(f"_{name}")).agg(F.sum("label").alias(f"{name}_own_yes"), F.count("*").cast("double").alias(f"{name}_own_n")) for name, part in _ends().items()}
    return boosting.fit(_featured(known, stats, own)), stats


def _ruled(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """df with host, path, rule and ruled, the rule's verdict."""
    verdict_of = F.create_map(*(F.lit(x) for r, v in sorted(rules.items()) for x in (r, v))) if rules else None
    df = df.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))).withColumn("rule", rule(F.col("host"), F.col("path"), rules))
    return df.withColumn("ruled", F.try_element_at(verdict_of, F.coalesce("rule", F.lit(""))) if rules else F.lit(None).cast("string"))


def _known(rows: DataFrame, labelled: DataFrame | None, examples: int) -> DataFrame:
    """At most about `examples` labelled URLs: url, host, path, label and fold, by a hash of the URL."""
    if labelled is None:
        known = rows.filter("ruled is not null").select("url", F.col("ruled").alias("verdict"))
    else:
        known = labelled.filter("url is not null and verdict in ('block', 'allow')").select("url", "verdict")
    known = written(hashed_sample(known, F.col("url"), examples, "urls"), "labelled")
    fold = F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS)).cast("int")
    return known.select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), (F.col("verdict") == "block").cast("double").alias("label"), fold.alias("fold"))


def judge(pages: DataFrame, rules: dict[str, str], labelled: DataFrame | None = None, examples: int = 20_000) -> DataFrame:
    """page_id, host, path, rule, verdict and blocked (the trees' probability; null where a rule decides).

    labelled: (url, verdict) to learn from; by default what the rules decide.
    """
    rows = _ruled(pages.select("page_id", F.col("url").cast("string").alias("url")), rules)
    trees, stats = _fit(_known(rows, labelled, examples))
    if trees is None:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("blocked"))
    scored = _featured(rows, stats).withColumn("blocked", F.when(F.col("ruled").isNull(), trees.probability(F.col("f"))))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("blocked") >= 0.5, "block").otherwise("allow")).alias("verdict"), "blocked")


def held_out(pages: DataFrame, rules: dict[str, str], labelled: DataFrame | None = None, examples: int = 20_000) -> tuple[int, int]:
    """How many labelled URLs of the first fold trees that are fitted on the others judge rightly, and how many there are."""
    known = _known(_ruled(pages.select("page_id", F.col("url").cast("string").alias("url")), rules), labelled, examples)
    trees, stats = _fit(known.filter("fold > 0"))
    asked = known.filter("fold = 0")
    if trees is None:
        return asked.filter("label = 0").count(), asked.count()
    right = _featured(asked, stats).filter((trees.probability(F.col("f")) >= 0.5) == (F.col("label") == 1.0))
    return right.count(), asked.count()
