"""URL filters: rules on host and path, and gradient-boosted trees on lexical features for the rest, all of it SQL expressions.

The trees see a url's length, depth, share of digits, entropy, parameter counts, and how urls of its
suffix were labelled. They are fitted on the driver from a bounded table of labelled urls whose features
the same expressions compute; over the pages run the fitted trees as CASE expressions.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import only
from lamella.llm.trees import Ensemble, boosted_trees

#: Labelled urls that the trees are fitted on, at most; parts that they are cut into, each with suffix statistics from the others.
TRAIN_ROWS, FOLDS = 20_000, 5

#: The rules of the query: verdict, host and path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# After the first "://": up to / ? # or the end, A-Z lower-cased; then up to ? # or the end.
_REST = "if(instr({u}, '://') > 0, substring({u}, instr({u}, '://') + 3), '')"
_HOST = "translate(regexp_extract({r}, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract({r}, '^[^/?#]*([^?#]*)', 1)"

#: The features by name, as SQL over url, host, path and query, none of them null.
FEATURES: dict[str, str] = {
    "length": "char_length(url)",
    "host_length": "char_length(host)",
    "labels": "size(split(host, '[.]'))",
    "depth": "regexp_count(path, '/[^/]')",
    "digit_ratio": "regexp_count(url, '[0-9]') / greatest(char_length(url), 1)",
    "host_digits": "regexp_count(host, '[0-9]')",
    "host_hyphens": "regexp_count(host, '-')",
    "signs": "regexp_count(url, '[^A-Za-z0-9:/.]') / greatest(char_length(url), 1)",
    "entropy": "aggregate(transform(array_distinct(split(host, '')), x -> (char_length(host) - char_length(replace(host, x, ''))) / greatest(char_length(host), 1)), 0D, (s, p) -> s - if(p > 0, p * ln(p) / ln(2), 0D))",
    "parameters": "regexp_count(query, '[^=&]+=')",
    "query_length": "char_length(query)",
    "longest_label": "array_max(transform(split(host, '[.]'), x -> char_length(x)))",
    "vowels": "regexp_count(host, '[aeiou]') / greatest(char_length(host), 1)",
    "secure": "cast(url like 'https:%' as int)",
}


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """df and the columns host and path: of a null url or one without "://" both are empty."""
    u = f"coalesce(`{url}`, '')"
    rest = _REST.format(u=u)
    return df.withColumns({"host": F.expr(_HOST.format(r=rest)), "path": F.expr(_PATH.format(r=rest))})


def rule_name(rule: Sequence[str]) -> str:
    return rule[1] + rule[2]


def rule_sql(rules: Sequence[Sequence[str]], what: int | None) -> str:
    """The longest rule that fits host and path (its name, or its verdict for what = 0), else null. A rule fits its host and
    every subdomain where the path starts with the rule's; of equally long ones the first wins."""
    cases = []
    for rule in sorted(rules, key=lambda r: -len(rule_name(r))):
        host, path, answer = (x.replace("\\", "\\\\").replace("'", "\\'") for x in (rule[1], rule[2], rule_name(rule) if what is None else rule[what]))
        cases.append(f"WHEN (host = '{host}' OR endswith(host, '.{host}')) AND startswith(path, '{path}') THEN '{answer}'")
    return f"CASE {' '.join(cases)} END" if cases else "cast(null as string)"


def labelled_urls(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """url, label (1: to block): made urls of known kind, the same on every call.

    Kept ones have short hosts of one or two plain words under usual subdomains, shallow paths and few parameters; blocked
    ones hyphenated or digit-laden hosts, random labels, deep paths or many parameters. Suffixes occur on both sides.
    """
    raw = spark.range(rows).selectExpr("id", "id % 2 as y", "cast(id div 2 as int) n", "md5(concat('u', id)) h")
    syllable = "element_at(array('an', 'the', 'her', 'ti', 'on', 'wor', 'lin', 'mo', 'sta', 're', 'ed', 'shi', 'en', 'ca', 'to', 'pra'), 1 + pmod(hash(id, {0}), 16))"
    s = [syllable.format(i) for i in range(8)]
    tld = "element_at(array('com', 'org', 'net', 'example.com', 'example.org', 'example.net'), 1 + pmod(hash(id, 20), 6))"
    sub = "element_at(array('', 'www.', 'blog.', 'm.', 'news.', ''), 1 + pmod(hash(id, 21), 6))"
    tail = "element_at(array('', '/', '.html', '?page=2&ref=x', '?utm_source=feed', '#top'), 1 + pmod(hash(id, 22), 6))"
    scheme = "element_at(array('http://', 'https://'), 1 + pmod(hash(id, 23), 2))"
    good = f"concat({s[0]}, {s[1]}, if(n % 3 = 0, {s[2]}, ''))"
    word = f"element_at(array('casino', 'bets', 'adult', 'spam', 'win', 'free', 'pills', 'loan', 'farm', 'click', 'cash', 'x', 'deals'), 1 + pmod(hash(id, 24), 13))"
    other = word.replace("(id, 24)", "(id, 25)")
    bad = f"element_at(array(concat({word}, '-', {other}), concat({word}, '-', {s[3]}, '-', {other}), concat({s[4]}, substr(h, 1, 9)), concat({word}, {other}, substr(cast(abs(hash(h)) as string), 1, 4)), concat({word}, '-', {s[5]}), concat(substr(h, 1, 14))), 1 + n % 6)"
    deep = f"if(n % 4 = 0, concat('/', {s[6]}, '/', substr(h, 3, 8), '/', {s[7]}, '?a=', substr(h, 5, 6), '&b=', id, '&c=1&d=2'), concat('/', element_at(array('en', 'de', 'fr', 'es'), 1 + pmod(hash(id, 26), 4)), '/', pmod(hash(id, 27), 1000), {tail}))"
    flat = f"concat('/', element_at(array('en', 'de', 'fr', 'es'), 1 + pmod(hash(id, 26), 4)), '/', pmod(hash(id, 27), 1000), {tail})"
    return raw.selectExpr(f"concat({scheme}, {sub}, if(y = 1, {bad}, {good}), '.', {tld}, if(y = 1, {deep}, {flat})) as url", "cast(y as int) as label")


class UrlModel:
    """Trees and suffix statistics, from a bounded table of labelled urls."""

    def __init__(self, labelled: DataFrame, rows: int = TRAIN_ROWS):
        known = only(labelled, "url", "label").where("url is not null and label is not null")
        share = min(1.0, 0.9 * rows / max(known.count(), 1))
        draw = known.where(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(rows)
        got = self.measured(with_parts(draw)).select("label", "suffix", *FEATURES).collect()
        if not got:
            raise ValueError("no labelled url to learn from")
        got.sort()
        y = np.array([r["label"] for r in got], np.float64)
        self.prior = float(y.mean())
        suffix = [r["suffix"] for r in got]
        self.suffixes = self.rates(suffix, y)
        # the trees learn from rates that a url's own label is no part of
        fold = np.random.default_rng(9).permutation(len(got)) % FOLDS
        seen = np.zeros(len(got))
        for k in range(FOLDS):
            apart = self.rates([s for s, f in zip(suffix, fold, strict=True) if f != k], y[fold != k])
            seen[fold == k] = [apart.get(s, self.prior) for s, f in zip(suffix, fold, strict=True) if f == k]
        x = np.column_stack([np.array([[r[f] for f in FEATURES] for r in got], np.float64), seen])
        self.trees: Ensemble = boosted_trees(x, y)

    def rates(self, suffix: list[str], y: np.ndarray) -> dict[str, float]:
        """The share of urls to block for each suffix, drawn towards the share of all where a suffix is rare."""
        count: dict[str, list[float]] = {}
        for s, label in zip(suffix, y, strict=True):
            n = count.setdefault(s, [0.0, 0.0])
            n[0] += 1
            n[1] += label
        return {s: round((b + 20 * self.prior) / (n + 20), 6) for s, (n, b) in sorted(count.items())}

    @staticmethod
    def measured(df: DataFrame) -> DataFrame:
        df = df.withColumn("query", F.expr("regexp_extract(url, '[?]([^#]*)', 1)")).withColumn("suffix", F.expr("substring_index(host, '.', -2)"))
        return df.withColumns({f: F.expr(f"cast(coalesce({e}, 0) as double)") for f, e in FEATURES.items()})

    def scored(self, df: DataFrame) -> DataFrame:
        """df (url, host, path) and score: how likely the url is one to block."""
        known = F.lit(json.dumps(self.suffixes))
        rate = F.coalesce(F.try_element_at(F.from_json(known, "map<string,double>"), F.col("suffix")), F.lit(self.prior))
        return self.measured(df).withColumn("suffix_rate", rate).withColumn("score", F.round(F.expr(self.trees.sql([*FEATURES, "suffix_rate"])), 6))


def judge(pages: DataFrame, rules: Sequence[Sequence[str]] = RULES, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of pages (page_id, url).

    rule: the longest rule that fits, as host and path together, else null. verdict: the rule's, else block where the trees'
    score is threshold or more, else allow. A null or empty url, or one without "://", has empty host and path, fits no rule and
    is allowed unless the trees say otherwise of an empty url (it is scored like one). Hosts keep ports and user names as written. Repeated
    rows have equal results; other columns are not read.
    """
    model = UrlModel(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    slim = only(pages, "page_id", "url").select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    out = model.scored(with_parts(slim))
    verdict = F.coalesce(F.expr(rule_sql(rules, 0)), F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.expr(rule_sql(rules, None)).alias("rule"), verdict.alias("verdict"), "score")
