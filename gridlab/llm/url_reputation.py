"""URL filter by rules and empirical-Bayes host reputation (DataFrame functions only).

Labelled page outcomes (good or not) are summed by host. The good rate of a
host is shrunk to that of its registered domain, which is shrunk to that of
its suffix, which is shrunk to the rate of all pages. At each level the prior
is a beta whose strength is estimated from the spread of the units around
their parents (method of moments of the beta-binomial). A host is blocked if
the upper posterior bound of its good rate (mean + z standard deviations)
stays below ``min_good``, so a host with few outcomes is allowed. A host
without outcomes is judged by the bound of its registered domain, else of its
suffix, else by the global rate.

Rules win over reputation: of the rules that fit, the longest.

Scale: outcomes are pre-aggregated by host; every table that is joined is
written first, so a hot host or domain meets a plain shuffled join, which
adaptive execution splits, and nothing is broadcast by hand. Rules are
configuration: up to ``MAX_RULES`` are evaluated as an expression, more of them
by an equi join on hosts' parents and paths' beginnings, with the same result.

Defined cases: a null url, or one without `://`, has empty host and path and
is judged by the global rate; hosts without outcomes are judged by their
parents; no outcomes at all: everything without a rule is allowed; null outcomes are
ignored; repeated pages each get a row; of the input's columns only page_id and
url are read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import run_folder, written

Z = 1.645
MIN_GOOD = 0.5
MAX_RULES = 1000
#: bounds of a prior's strength, in outcomes
MIN_STRENGTH, MAX_STRENGTH = 2.0, 1000.0
#: suffixes of two labels (fixed values)
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp",
                      "or.jp", "com.br", "com.cn", "com.mx", "co.in", "co.kr", "co.za", "com.tr", "com.ar")
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
         ("com/fr/", "allow"), ("com/de/", "block"))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def after_scheme(url: Column) -> Column:
    """What follows the first `://`; empty if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*(/[^?#]*)?", 1)


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Rules of
    equal length: the first in text order."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def joined_rules(rows: DataFrame, rules) -> DataFrame:
    """``rule_columns`` for any number of rules: (host, path, rule, says) of the
    distinct hosts and paths of ``rows`` that a rule fits. A host stands for
    itself and its parents, a path for its beginnings of the rules' lengths; both
    meet the rules in an equi join, so no host's rules are gathered."""
    spark = rows.sparkSession
    parts = [(text, says, *text.partition("/")) for text, says in rules]
    table = spark.createDataFrame([(own, slash + rest, text, says) for text, says, own, slash, rest in parts], "own string, start string, rule string, says string")
    sizes = F.array(*[F.lit(n) for n in sorted({len(slash + rest) for _, _, _, slash, rest in parts})])
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = rows.select("host", "path").distinct().select("host", "path", F.explode(parents).alias("own"), F.filter(sizes, lambda n: n <= F.char_length("path")).alias("sizes")) \
        .select("host", "path", "own", F.explode("sizes").alias("n")).select("host", "path", "own", F.expr("substring(path, 1, n)").alias("start"))
    best = F.min(F.struct((-F.char_length("rule")).alias("n"), "rule", "says")).alias("best")
    return asked.join(table, ["own", "start"]).groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.says")


def _strength(units: DataFrame) -> Column:
    """Strength of the beta prior from units (n, good, prior), an aggregate."""
    spread = F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("prior"), 2))
    own = F.col("prior") * (1 - F.col("prior"))
    rho = (spread - F.sum(own)) / F.nullif(F.sum(own * (F.col("n") - 1)), F.lit(0.0))
    return F.when(rho > 0, F.least(F.greatest(1 / rho - 1, F.lit(MIN_STRENGTH)), F.lit(MAX_STRENGTH))) \
        .otherwise(F.lit(MAX_STRENGTH))


def _shrunk(units: DataFrame, folder: str, name: str) -> DataFrame:
    """Units (.., n, good, prior) with the posterior's a and b and its mean."""
    units = written(units, f"{folder}/{name}-units")
    strength = float(units.agg(_strength(units).alias("s")).first()["s"] or MAX_STRENGTH)
    a = F.col("prior") * strength + F.col("good")
    total = F.col("n") + F.lit(strength)
    return written(units.withColumns({"a": a, "b": total - a, "mean": a / total}), f"{folder}/{name}")


def _bounded(level: DataFrame) -> DataFrame:
    """The posteriors with ``upper``, their upper bound."""
    deviation = F.sqrt(F.col("a") * F.col("b") / ((F.col("a") + F.col("b")) * (F.col("a") + F.col("b")) * (F.col("a") + F.col("b") + 1)))
    return level.withColumn("upper", F.col("mean") + F.lit(Z) * deviation)


def fit_levels(outcomes: DataFrame) -> tuple[dict[str, DataFrame], float | None]:
    """Reputation of every host, domain and suffix with outcomes (a table by
    level: its name, n, good, prior, a, b, mean, upper; hosts also domain and
    suffix), and the global good rate. outcomes: url, good (0 or 1)."""
    folder = run_folder(outcomes.sparkSession, "reputation")
    host = host_of(F.col("url"))
    hosts = written(outcomes.where(F.col("good").isNotNull()).select(host.alias("host"), F.col("good").cast("double").alias("good"))
                    .groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"))
                    .select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "good"),
                    f"{folder}/hosts")
    add = (F.sum("n").alias("n"), F.sum("good").alias("good"))
    whole = hosts.agg(*add).first()
    if not whole["n"]:
        return {level: hosts.select(level, F.lit(1.0).alias("mean"), F.lit(1.0).alias("upper")) for level in ("host", "domain", "suffix")}, None
    rate = float(whole["good"] / whole["n"])
    suffixes = _shrunk(hosts.groupBy("suffix").agg(*add).withColumn("prior", F.lit(rate)), folder, "suffixes")
    domains = _shrunk(hosts.groupBy("domain", "suffix").agg(*add).repartition("suffix")
                      .join(suffixes.select("suffix", F.col("mean").alias("prior")), "suffix"), folder, "domains")
    own = _shrunk(hosts.join(domains.select("domain", F.col("mean").alias("prior")), "domain"), folder, "reputation")
    return {"host": _bounded(own), "domain": _bounded(domains), "suffix": _bounded(suffixes)}, rate


def fit_reputation(outcomes: DataFrame) -> tuple[DataFrame, float | None]:
    """Reputation of every host with outcomes, and the global good rate."""
    levels, rate = fit_levels(outcomes)
    return levels["host"], rate


def host_bounds(hosts: DataFrame, levels: dict[str, DataFrame]) -> DataFrame:
    """(host, level, mean, upper) of distinct hosts: posterior mean and bound of
    the host, else of its domain, else of its suffix, else null (level
    ``all``). An empty host has no parents."""
    named = F.when(F.col("host") != "", F.col("host"))
    out = hosts.select("host", domain_of(named).alias("domain"), suffix_of(named).alias("suffix"))
    for level, table in levels.items():
        found = F.struct(F.lit(level).alias("level"), F.col("mean"), F.col("upper")).alias(f"of_{level}")
        out = out.join(table.select(level, found), level, "left")
    return out.select("host", F.coalesce(*[f"of_{level}" for level in levels]).alias("best")).select(
        "host", F.coalesce("best.level", F.lit("all")).alias("level"), "best.mean", "best.upper")


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, min_good: float = MIN_GOOD) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the level,
    mean and upper bound of the host or its nearest parent with outcomes
    (``all`` and null: none has)."""
    levels, rate = fit_levels(outcomes)
    host, path = host_of(F.col("url")), F.coalesce(path_of(F.col("url")), F.lit(""))
    rows = pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), path.alias("path"))
    bounds = written(host_bounds(rows.select("host").distinct(), levels), f"{run_folder(pages.sparkSession, 'host-bounds')}/hosts")
    if len(rules) > MAX_RULES:
        rows = rows.join(written(joined_rules(rows, rules), f"{run_folder(pages.sparkSession, 'url-rules')}/rules"), ["host", "path"], "left")
        rule, verdict = F.col("rule"), F.col("says")
    else:
        rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    unknown = F.lit("block" if rate is not None and rate < min_good else "allow")
    by_host = F.when(F.col("upper").isNull(), unknown).when(F.col("upper") < min_good, "block").otherwise("allow")
    return (rows.join(bounds, "host", "left")
            .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), "level", "mean", "upper"))
