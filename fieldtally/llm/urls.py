"""URL filters: host rules, and a weighted vocabulary found by Aho-Corasick.

All terms are searched in one pass over the lower-cased URL. An occurrence counts if neither
neighbour is a letter a-z or a digit. One strict term rejects the URL, and so do ``soft_limit`` different
soft ones. A host rule, where one fits, decides before the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import UPPER, texts

STRICT = ("casino", "porn", "xxx", "adult", "escort", "viagra", "cheap-pills", "free-bets", "sportsbet", "warez")
SOFT = ("win", "bets", "free", "cheap", "pills", "ads", "track", "spam", "farm", "poker", "slots", "loan", "crack", "torrent")
SOFT_LIMIT = 2
#: What a term can't have as its neighbour.
JOINED = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, below a path."""

    host: str
    path: str
    verdict: str

    def __str__(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty if it is null or has no ``://``."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    host = F.translate(F.coalesce(found, F.lit("")), UPPER, UPPER.lower())
    path = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))
    return host, path


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...], value: str) -> Column:
    """A field of the longest rule that fits, else null."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(str(r)), str(r))):  # the longest is asked first
        fits = (F.concat(F.lit("."), host).endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, F.lit(str(rule) if value == "rule" else rule.verdict)).otherwise(chosen)
    return chosen


def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in {*strict, *soft}:
        found.add_word(term.lower(), (term.lower(), term in strict))
    found.make_automaton()
    return found


def hits(machine: ahocorasick.Automaton, url: str | None) -> tuple[list[str], list[str]]:
    """The different strict and soft terms that stand alone in a URL, in order of the alphabet."""
    text = (url or "").lower()
    strict, soft = set(), set()
    for last, (term, is_strict) in machine.iter(text):
        first = last - len(term) + 1
        if text[first - 1 : first] not in JOINED and text[last + 1 : last + 2] not in JOINED:
            (strict if is_strict else soft).add(term)
    return sorted(strict), sorted(soft)


def filter_urls(
    pages: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    strict: tuple[str, ...] = STRICT,
    soft: tuple[str, ...] = SOFT,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """``page_id, url, host, path, strict_terms, soft_terms, rule, verdict`` of every page.

    A null URL has empty host and path, no terms, and is allowed. An empty vocabulary or an empty
    list of rules leaves the other to decide; of rules of equal length the last by name decides.
    Very long URLs are searched whole. Repeated rows give repeated results, an empty table an empty
    one; other columns (among them the page itself) are not read.
    """
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()),
        ("strict_terms", pa.list_(pa.string())), ("soft_terms", pa.list_(pa.string())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(strict, soft) if strict or soft else None
        for batch in batches:
            found = [hits(machine, url) if machine else ([], []) for url in texts(batch, "url")]
            terms = [pa.array([f[i] for f in found], pa.list_(pa.string())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *terms], schema=schema)

    rows = pages.select(pages["page_id"].cast("long"), pages["url"].cast("string"))
    judged = rows.mapInArrow(run, "page_id long, url string, strict_terms array<string>, soft_terms array<string>")
    host, path = url_parts(F.col("url"))
    judged = judged.withColumns({"host": host, "path": path})
    by_terms = (F.size("strict_terms") >= 1) | (F.size("soft_terms") >= soft_limit)
    rule = longest_rule(F.col("host"), F.col("path"), rules, "rule")
    verdict = longest_rule(F.col("host"), F.col("path"), rules, "verdict")
    return judged.withColumns({
        "rule": rule,
        "verdict": F.coalesce(verdict, F.when(by_terms, F.lit("block")).otherwise(F.lit("allow"))),
    })
