"""URL filter: rules and listed hosts held in one Bloom filter cascade.

Every URL gives a few keys: its host, and for each shape of the rules (labels of the host,
characters of the path) the part of the URL a rule of that shape would have to equal. Level 1
of the cascade encodes the listed keys; each further level encodes the keys of the corpus that
the level before admits wrongly, until none is left. As the levels are built over the complete
set of the corpus's keys, membership is exact for every URL of it, and no URL is joined with a
list.

Only DataFrame and SQL functions are used. A filter's size follows the listed keys: the first
level's false positives are held near their number, so the levels after it are no larger.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import columns_as
from fleetpulse.session import stage

#: Largest filter that is handed to all tasks: 2**28 bits are 32 MB.
MOST_BITS = 2**28
#: Probes of the first level, and bits a key and probes of the levels after it.
FIRST_PROBES, DEEP_BITS, DEEP_PROBES = 6, 8, 4
MOST_LEVELS = 64
_RULE, _ALLOW, _HOST = "rule ", "allow ", "host "


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without a ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, upper, lower), path


def _split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def _shapes(rules: Sequence[tuple[str, str]]) -> list[tuple[int, int]]:
    parts = [_split_rule(rule) for _, rule in rules]
    return sorted({(host.count(".") + 1, len(path)) for host, path in parts})


def _candidates(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> list[Column]:
    """The rule texts that would fit this URL: one per shape, null if the URL is too small."""
    labels = F.size(F.split(host, r"\."))
    return [
        F.when(
            (labels >= n) & (F.length(path) >= size),
            F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, size)),
        )
        for n, size in _shapes(rules)
    ]


def _probes(key: Column, level: int, bits: int, probes: int) -> list[Column]:
    one = F.pmod(F.xxhash64(key, F.lit(2 * level)), F.lit(bits))
    two = F.pmod(F.xxhash64(key, F.lit(2 * level + 1)), F.lit(bits))
    return [F.pmod(one + two * i + i * i * i, F.lit(bits)) for i in range(probes)]


class Level:
    """One Bloom filter: a one-row table of 64-bit words."""

    def __init__(self, keys: DataFrame, number: int, size: int, bits_a_key: int, probes: int):
        self.number, self.probes = number, probes
        self.bits = 64 * max(1, math.ceil(size * bits_a_key / 64))
        if self.bits > MOST_BITS:
            raise ValueError(f"{size} keys need {self.bits} bits; at most {MOST_BITS} are held")
        at = F.explode(F.array(*_probes(F.col("key"), number, self.bits, probes)))
        words = (
            keys.select(at.alias("bit"))
            .groupBy(F.shiftright("bit", 6).alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63L AS int)))").alias("value"))
        )
        every = keys.sparkSession.range(self.bits // 64).withColumnRenamed("id", "word")
        dense = every.join(words, "word", "left").select(
            F.struct("word", F.coalesce("value", F.lit(0)).alias("value")).alias("entry")
        )
        packed = dense.agg(F.array_sort(F.collect_list("entry")).alias("entries"))
        self.words = stage(packed.select(F.col("entries.value").alias("words")), "bloom-level")

    def admits(self, key: Column) -> Column:
        words = self.words.scalar()
        found = F.lit(True)
        for bit in _probes(key, self.number, self.bits, self.probes):
            word = F.element_at(words, (F.shiftright(bit, 6) + 1).cast("int"))
            mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
            found = found & (word.bitwiseAND(mask) != 0)
        return found


class Cascade:
    """Exact membership of ``listed`` keys among all keys of ``universe``.

    ``universe`` has a distinct, non-null column ``key`` and a boolean column ``listed``.
    """

    def __init__(self, universe: DataFrame):
        self.levels: list[Level] = []
        inside = universe.where("listed").select("key")
        outside = universe.where("NOT listed").select("key")
        encoded, n_encoded, n_other = inside, inside.count(), outside.count()
        tested = outside
        # The share that level 1 may admit wrongly: about as many keys as are listed.
        share = min(0.5, n_encoded / max(1, n_other))
        probes = FIRST_PROBES
        bits = math.ceil(-probes / math.log(1 - share ** (1 / probes))) if n_encoded else 1
        while n_encoded:
            if len(self.levels) == MOST_LEVELS:
                raise RuntimeError("the cascade does not end: the keys are not distinct")
            level = Level(encoded, len(self.levels) + 1, n_encoded, bits, probes)
            self.levels.append(level)
            wrong = stage(tested.where(level.admits(F.col("key"))), "bloom-wrong")
            encoded, tested, n_encoded = wrong, encoded, wrong.count()
            bits, probes = DEEP_BITS, DEEP_PROBES

    def has(self, key: Column) -> Column:
        """The first level that refuses a key decides: an odd one was built from listed keys."""
        result = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            refused = F.lit(level.number % 2 == 0)
            result = F.when(level.admits(key), result).otherwise(refused)
        return result


def key_universe(
    urls: DataFrame, rules: Sequence[tuple[str, str]], listed_labels: Sequence[str]
) -> DataFrame:
    """Every distinct key of the URLs; a host is listed if one of its labels is."""
    fitting = _candidates(rules, F.col("host"), F.col("path"))
    keys = F.array_compact(
        F.array(
            F.concat(F.lit(_HOST), F.col("host")),
            *[F.concat(F.lit(kind), c) for c in fitting for kind in (_RULE, _ALLOW)],
        )
    )
    distinct = urls.select(F.explode(keys).alias("key")).distinct()
    allowed = [_ALLOW + rule for verdict, rule in rules if verdict == "allow"]
    by_rule = F.col("key").isin([_RULE + rule for _, rule in rules] + allowed)
    labels = F.split(F.substr("key", F.lit(len(_HOST) + 1)), r"\.")
    by_label = F.col("key").startswith(_HOST) & F.arrays_overlap(
        labels, F.array(*[F.lit(label) for label in listed_labels]).cast("array<string>")
    )
    return distinct.withColumn("listed", by_rule | by_label)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    listed_labels: Sequence[str] = (),
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per page: host, path, the longest rule that fits (or null) and the verdict.

    ``rules`` are (allow or block, text) pairs with distinct texts. A rule fits its host and
    all subdomains where the path starts with the rule's. Without a rule, a page is blocked if
    its host is listed, else allowed. Null URLs and URLs without ``://`` have an empty host and
    path and are allowed; repeated rows are kept; other columns are ignored.
    """
    pages = columns_as(pages, page_id=id_col, url=url_col)
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    cascade = Cascade(stage(key_universe(urls, rules, listed_labels), "url-keys"))
    fitting = [
        F.when(
            cascade.has(F.concat(F.lit(_RULE), c)),
            F.struct(F.length(c).alias("size"), c.alias("rule")),
        )
        for c in _candidates(rules, F.col("host"), F.col("path"))
    ]
    none = F.lit(None).cast("struct<size: int, rule: string>")
    judged = urls.withColumn("best", F.greatest(none, none, *fitting)["rule"])
    allows = cascade.has(F.concat(F.lit(_ALLOW), F.col("best")))
    listed = cascade.has(F.concat(F.lit(_HOST), F.col("host")))
    blocked = F.when(F.col("best").isNotNull(), ~allows).otherwise(listed)
    verdict = F.when(blocked, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("best").alias("rule"), verdict.alias("verdict")
    )


def sql(rules: Sequence[tuple[str, str]], listed_labels: Sequence[str]) -> str:
    """DuckDB SQL for ``judge_urls`` over ``pages``."""
    rows = ", ".join(
        "('{}', '{}', '{}', '{}')".format(verdict, rule, *_split_rule(rule))
        for verdict, rule in rules
    )
    labels = "[" + ", ".join(f"'{label}'" for label in listed_labels) + "]"
    return f"""WITH rules(verdict, rule, rule_host, rule_path) AS (VALUES {rows}),
        rests AS (SELECT page_id, row_number() OVER () AS r,
            CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END
                AS rest FROM pages),
        urls AS (SELECT page_id, r, translate(regexp_extract(rest, '^([^/?#]*)', 1),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
        best AS (SELECT r, arg_max(rule, length(rule)) AS rule,
            arg_max(verdict, length(rule)) AS verdict FROM urls JOIN rules
            ON (host = rule_host OR ends_with(host, '.' || rule_host))
            AND starts_with(path, rule_path) GROUP BY r)
        SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN list_has_any(
            string_split(host, '.'), {labels}) THEN 'block' ELSE 'allow' END) AS verdict
        FROM urls LEFT JOIN best USING (r)"""
