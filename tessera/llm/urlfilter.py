"""URL filters: rules found by their rarest literal token.

Rules are either fixed (a host and a path prefix, for the host and its subdomains, longest rule first) or patterns with
wildcards. Each rule is filed under that token of its literal text which the fewest URLs of the whole table contain, so a
common token such as ``com`` rarely fetches a rule. A URL fetches the rules filed under its own tokens, and only those run
their regular expression. The index is as small as the rule list (a parameter, whose size is checked), not as the data:
one pass counts the rules' own tokens over all URLs, one pass judges, and no row is shuffled.

Defined results: a null URL or one without ``://`` has empty host and path, which fixed rules never fit; patterns still see
the text of a URL without ``://``; line breaks and very long URLs are text like any other; repeated rows stay; page_id may be
null; other columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import sent

MOST_RULES = 1_000_000
TOKEN = r"[a-z0-9]+"

#: (verdict, rule): fixed values of the contract.
FIXED = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
#: For URLs that no fixed rule fits. ``||`` starts at a host or a subdomain's end, ``*`` is any text, ``^`` a separator or the end.
PATTERNS = [
    ("block", "||spam-farm.*^"),
    ("block", "||casino.*^"),
    ("block", "*/adserver/*"),
    ("block", "*utm_source=spam*"),
    ("block", "*/wp-login.php*"),
]


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str
    regex: str  # a fixed rule's on the host, a pattern's on the URL, in lower case both
    path: str | None  # a fixed rule's, on the path as it stands
    literals: tuple[str, ...]

    @property
    def fixed(self) -> bool:
        return self.path is not None


def fixed_rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    host = host.lower()
    tokens = re.findall(TOKEN, host)
    # the last token of the path may go on in a URL, so it is not a whole token there unless something follows it
    tokens += re.findall(rf"{TOKEN}(?=[^a-z0-9])", (slash + path).lower())
    return Rule(text, verdict, rf"^(?:.*\.)?{re.escape(host)}\Z", "^" + re.escape(slash + path), tuple(dict.fromkeys(tokens)))


def pattern_rule(verdict: str, text: str) -> Rule:
    low = text.lower()
    anchored = low.startswith("||")
    body = low[2:] if anchored else low
    rx = "".join(".*" if c == "*" else r"(?:[^a-z0-9_.%-]|$)" if c == "^" else re.escape(c) for c in body)
    # whole tokens only: those with a literal that is no letter or digit (or an anchor) on either side
    tokens = [m[0] for m in re.finditer(TOKEN, body) if (m.start() > 0 and body[m.start() - 1] != "*" or m.start() == 0 and anchored) and m.end() < len(body) and body[m.end()] != "*"]
    return Rule(text, verdict, (r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?" if anchored else "") + rx, None, tuple(dict.fromkeys(tokens)))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def token_counts(urls: DataFrame, tokens: set[str]) -> dict[str, int]:
    """How many URLs have each of the rules' tokens, over all rows: as many numbers as the rules have tokens."""
    mine = urls.sparkSession.createDataFrame([(t,) for t in sorted(tokens)], "t string")
    own = urls.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("url"), F.lit(f"({TOKEN})"), 1))).alias("t"))
    return {r.t: r.n for r in own.join(F.broadcast(mine), "t").groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}


def judge(pages: DataFrame, fixed: list[tuple[str, str]] | None = None, patterns: list[tuple[str, str]] | None = None, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern): the longest fixed rule that fits, else null and the longest pattern's
    verdict, else ``default``. Equally long rules: the one later in the alphabet."""
    rules = [fixed_rule(v, t) for v, t in (FIXED if fixed is None else fixed)] + [pattern_rule(v, t) for v, t in (PATTERNS if patterns is None else patterns)]
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; the index is sent to every task, so {MOST_RULES} at most")
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    every = {t for r in rules for t in r.literals}
    seen = token_counts(urls, every) if every else {}
    index: dict[str | None, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.literals, key=lambda t: (seen.get(t, 0), t), default=None), []).append(r)
    held = sent(urls.sparkSession, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, token = held(), re.compile(TOKEN)
        compiled = {r: (re.compile(r.regex, re.S), re.compile(r.path or "", re.S)) for rs in by.values() for r in rs}
        lower = {c: c + 32 for c in range(65, 91)}
        longest = lambda r: (len(r.text), r.text)
        for b in batches:
            rules_, verdicts, hits = [], [], []
            for url, host, path in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                low = (url or "").translate(lower)
                ask = [r for t in {*token.findall(low), None} for r in by.get(t, ())]
                rule = max((r for r in ask if r.fixed and compiled[r][0].match(host) and compiled[r][1].match(path)), key=longest, default=None)
                hit = None if rule else max((r for r in ask if not r.fixed and compiled[r][0].search(low)), key=longest, default=None)
                rules_.append(rule and rule.text)
                hits.append(hit and hit.text)
                verdicts.append((rule or hit).verdict if rule or hit else default)
            yield pa.record_batch([b.column(0), b.column(2), b.column(3), pa.array(rules_, pa.string()), pa.array(verdicts, pa.string()), pa.array(hits, pa.string())], names=["page_id", "host", "path", "rule", "verdict", "pattern"])

    kind = pages.schema[id_col].dataType.simpleString()
    return urls.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, pattern string")


def _oracle() -> str:
    """The same with DuckDB: fixed rules by host suffix and path prefix, then patterns by regular expression."""
    fits = " UNION ALL ".join(f"SELECT '{v}' AS v, '{t}' AS rule, '{t.partition('/')[0]}' AS h, '/{t.partition('/')[2]}' AS p" for v, t in FIXED)
    pats = " UNION ALL ".join(f"SELECT '{v}' AS v, '{t}' AS rule, '{pattern_rule(v, t).regex.replace(chr(39), chr(39) * 2)}' AS rx" for v, t in PATTERNS)
    return f"""
WITH u AS (
  SELECT rowid AS k, page_id, coalesce(url, '') AS url,
         CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM (SELECT row_number() OVER () AS rowid, page_id, url FROM pages)
), hp AS (
  SELECT k, page_id, url, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), fixed AS ({fits}), pats AS ({pats}),
best AS (
  SELECT k, arg_max(rule, (length(rule), rule)) AS rule, arg_max(v, (length(rule), rule)) AS v FROM hp JOIN fixed
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k
), hit AS (
  SELECT k, arg_max(rule, (length(rule), rule)) AS rule, arg_max(v, (length(rule), rule)) AS v FROM hp JOIN pats ON regexp_matches(lower(url), rx, 's') GROUP BY k
)
SELECT hp.page_id, hp.host, hp.path, best.rule AS rule, coalesce(best.v, hit.v, 'allow') AS verdict,
       CASE WHEN best.rule IS NULL THEN hit.rule END AS pattern
FROM hp LEFT JOIN best USING (k) LEFT JOIN hit USING (k)"""


ORACLE = _oracle()
