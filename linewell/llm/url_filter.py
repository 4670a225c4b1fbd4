"""URL filters: pattern rules are indexed by their rarest literal token.

Every rule names literal tokens (runs of a-z and 0-9) that any URL it fits must contain whole. One pass counts in
how many URLs each of these tokens occurs, and a rule is filed under the rarest. The tokens of a URL fetch
candidate rules and only their regular expressions run. The index is as large as the rule list, never as the data.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)

# (host, path, verdict): a rule fits its host and all subdomains if the path starts with the rule's
HOST_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
# words of host labels that block a site where no host rule fits
BLOCKED_WORDS = ("ads", "adserver", "doubleclick", "adult", "porn", "xxx", "casino", "poker", "bets", "betting", "lottery", "pills", "viagra", "spam", "phishing", "malware", "warez")


@dataclass(frozen=True)
class Rule:
    """``regex`` is searched in host and path for host rules, in the folded URL for others."""
    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    of_host: bool


def host_rule(host: str, path: str, verdict: str) -> Rule:
    whole = host + path
    tokens = [m for m in re.finditer(TOKEN, whole.translate(FOLD)) if m.end() < len(whole)]  # a token at the end may go on in the url
    # the path starts with a slash, and a host has none: no other place can match
    return Rule(whole, verdict, r"^(?:[^/]*\.)?" + re.escape(whole), tuple(m[0] for m in tokens), True)


def word_regex(word: str) -> str:
    return r"://(?:[^/?#]*[.-])?" + word + "[.-]"


def word_rule(word: str) -> Rule:
    return Rule(word, "block", word_regex(word), (word,), False)


RULES = tuple([host_rule(*r) for r in HOST_RULES] + [word_rule(w) for w in BLOCKED_WORDS])


def split(url: str | None) -> tuple[str, str]:
    """Host (A-Z folded) and path; both empty for null or without ://"""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url[at + 3:])
    return m[1].translate(FOLD), m[2]


def index_rules(rules: tuple[Rule, ...], seen: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rule numbers by rarest token (ties: alphabetical), and those without a token, which every URL tries."""
    index: dict[str, list[int]] = {}
    always = []
    for k, r in enumerate(rules):
        if r.tokens:
            index.setdefault(min(r.tokens, key=lambda t: (seen.get(t, 0), t)), []).append(k)
        else:
            always.append(k)
    return index, always


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, default: str = "allow") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, pattern.

    Of the host rules that fit, the longest decides (ties: the first listed) and is named in ``rule``. Otherwise the
    first other rule whose pattern is found decides and is named in ``pattern``; otherwise ``default``. Null URLs
    and those without :// have an empty host and path and get the default. Null ids and repeated rows stay as
    they are; empty table: no rows. Only the id and URL columns are read.
    """
    named = sorted({t for r in rules for t in r.tokens})
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    seen = dict(urls.select(F.explode(F.array_distinct(F.regexp_extract_all(F.translate("url", UPPER, LOWER), F.lit(TOKEN), F.lit(0)))).alias("token"))
                .filter(F.col("token").isin(named)).groupBy("token").count().collect())  # one row per token of a rule at most
    index, always = index_rules(rules, seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, token = [re.compile(r.regex) for r in rules], re.compile(TOKEN)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for url in batch.column(1).to_pylist():
                host, path = split(url)
                folded = (url or "").translate(FOLD)
                spot = host + path
                rule = pattern = None
                for k in sorted({k for t in set(token.findall(folded)) for k in index.get(t, ())}.union(always)):
                    r = rules[k]
                    if r.of_host:
                        if host and (rule is None or len(r.name) > len(rule.name)) and compiled[k].search(spot):
                            rule = r
                    elif pattern is None and compiled[k].search(folded):
                        pattern = r
                for column, value in zip(out, (host, path, rule and rule.name, (rule or pattern).verdict if rule or pattern else default, pattern and pattern.name)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string()) for c in out]], ["page_id", "host", "path", "rule", "verdict", "pattern"])

    kind = urls.schema["page_id"].dataType.simpleString()
    return urls.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, pattern string")


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


_LONGEST = sorted(HOST_RULES, key=lambda r: -len(r[0] + r[1]))
ORACLE_SQL = f"""
WITH u AS (SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS folded, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, folded, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, CASE {' '.join(f"WHEN {_fits(h, p)} THEN '{h + p}'" for h, p, _ in _LONGEST)} END AS rule,
  CASE {' '.join(f"WHEN regexp_matches(folded, '{word_regex(w)}') THEN '{w}'" for w in BLOCKED_WORDS)} END AS pattern FROM p)
SELECT page_id, host, path, rule, CASE {' '.join(f"WHEN rule = '{h + p}' THEN '{v}'" for h, p, v in HOST_RULES)} WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern FROM r
"""
