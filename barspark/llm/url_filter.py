"""URL filtering by host and path rules, indexed by each rule's rarest literal token. Built-in functions only."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: Up to so many rules the index is a hash table held as a literal of the plan (a few hundred bytes a rule); more are joined.
INLINE_RULES = 20_000
#: Up to so many rules (some 300 bytes each) the table of rules is broadcast; beyond, each rule is sent to so many parts of the URLs.
BROADCAST_RULES, PARTS = 100_000, 32


@dataclass(frozen=True)
class Rule:
    """``action`` is allow or block; the rule fits ``host`` and its subdomains if the path starts with ``path``."""

    action: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def patterns(self) -> tuple[str, str]:
        """Of the host and of the path, each matched by itself, so that a host never runs into a path."""
        return r"(?s)^(?:.*\.)?" + _quoted(self.host) + r"\z", "^" + _quoted(self.path)

    @property
    def tokens(self) -> list[str]:
        """Literals that every URL the rule fits has as whole tokens: host labels, and path segments closed by a slash."""
        closed = self.path.split("/")[1:-1] if self.path.startswith("/") else []
        return [f"h:{x}" for x in self.host.split(".")] + [f"p:{x}" for x in closed]


def _quoted(literal: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", literal)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lower-cased) and path; both empty for a null URL or one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(
        F.concat(
            F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x)),
            F.transform(F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/"))), lambda x: F.concat(F.lit("p:"), x)),
        )
    )


def hash_table(entries: Sequence[tuple[str, dict]], schema: str) -> Callable[[Column], Column]:
    """A function from a token to the array of its entries (empty if it has none): ``schema`` names what an entry holds beside its token ``t``.

    Twice as many slots as entries, a token's slot by its CRC-32: one slot is read, however many entries there are. Spark folds the table, sent as one
    JSON text, into a literal once for each plan."""
    slots: list[list[dict]] = [[] for _ in range(2 * len(entries) + 1)]
    for token, held in entries:
        slots[zlib.crc32(token.encode()) % len(slots)].append({"t": token, **held})
    held = F.from_json(F.lit(json.dumps({"slots": slots})), f"slots array<array<struct<t: string, {schema}>>>")["slots"]
    return lambda token: F.filter(F.get(held, F.pmod(F.crc32(token), F.lit(len(slots)))), lambda e: e["t"] == token)


def rarest_tokens(parts: DataFrame, rules: Sequence[Rule], inline_rules: int = INLINE_RULES) -> dict[Rule, str]:
    """Each rule's token that the fewest URLs hold. What returns to the driver is one count a rule token."""
    wanted = sorted({t for r in rules for t in r.tokens})
    tokens = url_tokens(F.col("host"), F.col("path"))
    if len(rules) <= inline_rules:
        known = hash_table([(t, {"n": 1}) for t in wanted], "n: int")
        seen = parts.select(F.explode(F.filter(tokens, lambda t: F.size(known(t)) > 0)).alias("t")).groupBy("t").count()
    else:
        table = parts.sparkSession.createDataFrame([(t,) for t in wanted], "t string")
        seen = parts.select(F.explode(tokens).alias("t")).groupBy("t").count().join(table, "t", "left_semi")
    counts = dict(seen.collect())
    return {r: min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)) for r in rules}


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", default: str = "allow", inline_rules: int = INLINE_RULES) -> DataFrame:
    """Every row of ``pages`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``.

    The URL's tokens fetch candidate rules from the index, each by one look-up whose cost doesn't depend on the number of rules; only
    candidates run their regular expressions, and the longest fitting rule decides (ties: the smaller rule text, then allow before block).
    Rows repeat as given; a null, empty or malformed URL has empty parts and the default verdict; columns of ``pages`` called host, path,
    rule or verdict are replaced. No shuffle of URLs up to ``inline_rules`` rules; beyond, the index is a table, distinct URL parts are joined
    to it by token, and the longest fit comes back by an equi-join on host and path.
    """
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "__url")]
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{url_col}`").alias("__url"))
    host, path = url_parts(F.col("__url"))
    rows = rows.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), path.alias("path"))
    rules = sorted(set(rules), key=lambda r: (-len(r.text), r.text, r.action))
    if not rules:
        return rows.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    rarest = rarest_tokens(rows.select("host", "path"), rules, inline_rules)
    fits_both = lambda h, p: F.regexp_like(F.col("host"), h) & F.regexp_like(F.col("path"), p)
    if len(rules) <= inline_rules:
        entries = [(rarest[r], {"i": i, "rule": r.text, "action": r.action, "h": r.patterns[0], "p": r.patterns[1]}) for i, r in enumerate(rules)]
        lookup = hash_table(entries, "i: int, rule: string, action: string, h: string, p: string")
        found = F.filter(F.flatten(F.transform(url_tokens(F.col("host"), F.col("path")), lookup)), lambda c: fits_both(c["h"], c["p"]))
        first = F.array_min(F.transform(found, lambda c: F.struct(c["i"], c["rule"], c["action"])))
        return rows.withColumn("__b", first).select(*keep, "host", "path", F.col("__b.rule").alias("rule"), F.coalesce(F.col("__b.action"), F.lit(default)).alias("verdict"))
    index = pages.sparkSession.createDataFrame([(rarest[r], i, r.text, r.action, *r.patterns) for i, r in enumerate(rules)], "token string, i int, rule string, action string, __h string, __p string")
    urls = rows.where("host <> ''").select("host", "path").distinct()
    if len(rules) <= BROADCAST_RULES:
        index, on = F.broadcast(index), ["token"]
    else:  # A token that most URLs hold is in as many tasks as there are parts.
        index, on = index.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["token", "__part"]
        urls = urls.withColumn("__part", F.pmod(F.crc32(F.concat_ws("/", "host", "path")), F.lit(PARTS)).cast("int"))
    urls = urls.withColumn("token", F.explode(url_tokens(F.col("host"), F.col("path"))))
    fits = urls.join(index, on).where(fits_both(F.col("__h"), F.col("__p")))
    best = fits.groupBy("host", "path").agg(F.min(F.struct("i", "rule", "action")).alias("__b"))
    return rows.join(best, ["host", "path"], "left").select(*keep, "host", "path", F.col("__b.rule").alias("rule"), F.coalesce(F.col("__b.action"), F.lit(default)).alias("verdict"))
