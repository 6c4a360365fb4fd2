"""Secret scan with multipart credential linking, in DataFrame operations only.

Three base kinds are reported wherever they stand. Weak candidates (account identifiers,
short secrets, service endpoints) are reported only when complementary parts co-occur: an
identifier and a secret, or a secret and an endpoint, whose scopes overlap. A scope reaches
``scope`` code points beyond a part on both sides; the overlap is an interval join on
(text, bucket of positions), so a text's parts meet only their neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import columns_as
from fleetpulse.session import stage


@dataclass(frozen=True)
class Part:
    """One kind of span: the matches of ``pattern`` whose ``group`` is ``at_least`` long (and
    below ``below``). ``role`` says which part of a credential it can be."""

    kind: str
    pattern: str
    at_least: int
    role: str
    group: int = 0
    below: int | None = None
    base: bool = False


# The base patterns and least lengths that results must follow.
_ASSIGN = (
    r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
    r"([A-Za-z0-9+/_.=-]+)"
)
BASE = (
    Part("assign", _ASSIGN, 12, "secret", group=2, base=True),
    Part("access", r"AKIA[A-Z0-9]+", 18, "identifier", base=True),
    Part("hex", r"[0-9a-f]+", 16, "secret", base=True),
)
_IDENTIFIER = (
    r"(?i:user_?name|user_?id|login|account|client_?id|access_?key_?id)[\"']?\x20*[:=]\x20*"
    r"[\"']?([A-Za-z0-9@._+-]+)"
)
WEAK = (
    Part("identifier", _IDENTIFIER, 3, "identifier", group=1),
    Part("short", _ASSIGN, 6, "secret", group=2, below=12),
    Part("endpoint", r"[a-z][a-z0-9+.-]*://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+", 12, "endpoint"),
)
KINDS = (*BASE, *WEAK)
#: What stands in place of a masked span.
MASK = "[SECRET]"
#: Code points by which a part's scope reaches beyond it.
SCOPE = 120
#: A candidate of a kind cannot match where the text lacks this, so most texts are not split.
_NEEDS = {
    "access": r"AKIA[A-Z0-9]{14}",
    "hex": r"[0-9a-f]{16}",
    "endpoint": r"[a-z0-9+.-]://[A-Za-z0-9._~:/?#@!$&*+,;=%-]",
}
_SPANS = "array<struct<start: int, place: int, stop: int>>"


def _matches(text: Column, part: Part, place: int) -> Column:
    """All leftmost, non-overlapping matches of a part's pattern as (start, place, stop).

    Splitting at the matches gives the gaps before them; adding up gaps and matches gives
    their places in code points.
    """
    pattern = F.lit(part.pattern)
    found = F.regexp_extract_all(text, pattern, 0)
    tested = F.regexp_extract_all(text, pattern, part.group) if part.group else found
    gaps = F.split(text, part.pattern, -1)
    steps = F.zip_with(
        F.zip_with(found, gaps, lambda f, g: F.struct(F.length(f).alias("f"), F.length(g).alias("g"))),
        tested,
        lambda s, t: F.struct(s["f"].alias("f"), s["g"].alias("g"), F.length(t).alias("t")),
    )
    steps = F.filter(steps, lambda s: s["f"].isNotNull())
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))

    def add(done: Column, step: Column) -> Column:
        start = done["at"] + step["g"]
        stop = start + step["f"]
        good = step["t"] >= part.at_least
        if part.below is not None:
            good = good & (step["t"] < part.below)
        span = F.struct(start.alias("start"), F.lit(place).alias("place"), stop.alias("stop"))
        spans = F.when(good, F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct(stop.alias("at"), spans.alias("spans"))

    spans = F.aggregate(steps, zero, add, lambda done: done["spans"])
    needs = text.rlike(_NEEDS.get(part.kind, part.pattern))
    return F.when(needs, spans).otherwise(F.array().cast(_SPANS))


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, a hash of its text, and all parts by (start, kind)."""
    rows = columns_as(docs, doc_id=id_col, text=text_col)
    text = F.coalesce(F.col("text"), F.lit(""))
    lists = [_matches(text, part, place) for place, part in enumerate(KINDS)]
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.array_sort(F.concat(*lists)).alias("parts"),
    )


def _places(chosen) -> list[int]:
    return [place for place, part in enumerate(KINDS) if chosen(part)]


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts that have a complementary part within scope: one row per text and span.

    ``parts`` has one row per distinct text and part. A part lies in the buckets its scope
    touches, each two scopes wide; complementary roles meet by an equality join on the bucket.
    """
    wide = 2 * scope
    first = F.floor((F.col("start") - scope) / wide)
    last = F.floor((F.col("stop") + scope) / wide)
    placed = parts.withColumn("bucket", F.explode(F.sequence(first, last)))

    def of_role(name: str, prefix: str) -> DataFrame:
        rows = placed.where(F.col("place").isin(_places(lambda part: part.role == name)))
        return rows.select(
            "doc_id", "text_hash", "bucket",
            *[F.col(c).alias(f"{prefix}_{c}") for c in ("start", "place", "stop")],
        )

    near = (F.col("a_start") - scope <= F.col("b_stop") + scope) & (
        F.col("b_start") - scope <= F.col("a_stop") + scope
    )
    linked = []
    for left, right in (("identifier", "secret"), ("secret", "endpoint")):
        a, b = of_role(left, "a"), of_role(right, "b")
        same = [
            a[c].eqNullSafe(b[c]) if c == "doc_id" else a[c] == b[c]
            for c in ("doc_id", "text_hash", "bucket")
        ]
        pairs = a.join(b, same, "inner").where(near)
        ends = F.array(
            *[
                F.struct(*[F.col(f"{side}_{c}").alias(c) for c in ("start", "place", "stop")])
                for side in "ab"
            ]
        )
        linked.append(pairs.select(a["doc_id"], a["text_hash"], F.explode(ends).alias("span")))
    weak = F.col("span.place").isin(_places(lambda part: not part.base))
    return linked[0].union(linked[1]).where(weak).distinct()


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(part.kind) for part in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.element_at(names, s["place"] + 1), s["start"].cast("string"),
                s["stop"].cast("string"),
            ),
        ),
        ",",
    )


def _linked_weak(found: DataFrame, scope: int) -> DataFrame:
    """The linked weak spans of each distinct text: extra_doc_id, extra_hash and extra."""
    weak = found.where(F.exists("parts", lambda s: s["place"] >= len(BASE)))
    single = weak.dropDuplicates(["doc_id", "text_hash"])
    each = single.select("doc_id", "text_hash", F.explode("parts").alias("s"))
    linked = link_parts(each.select("doc_id", "text_hash", "s.*"), scope)
    extra = linked.groupBy("doc_id", "text_hash").agg(F.collect_list("span").alias("extra"))
    return extra.select(
        F.col("doc_id").alias("extra_doc_id"), F.col("text_hash").alias("extra_hash"), "extra"
    )


def _with_extra(rows: DataFrame, extra: DataFrame, doc_id: Column, text_hash: Column) -> DataFrame:
    same = doc_id.eqNullSafe(F.col("extra_doc_id")) & (text_hash == F.col("extra_hash"))
    return rows.join(extra, same, "left")


def secret_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE
) -> DataFrame:
    """One row per input row: counts of the base kinds, a hash of the base spans, all spans.

    Null and empty texts have no spans. Spans are ``kind:start:stop`` in code points, stop
    exclusive, by start and then kind. Repeated rows each get their text's result; a null
    doc_id is kept; other columns are ignored.
    """
    found = stage(find_parts(docs, id_col, text_col), "secret-parts")
    base = found.withColumn("base", F.filter("parts", lambda s: s["place"] < len(BASE)))
    joined = _with_extra(
        base, _linked_weak(found, scope), F.col("doc_id"), F.col("text_hash")
    )
    every = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(_SPANS))))

    def count(place: int) -> Column:
        return F.size(F.filter("base", lambda s: s["place"] == place)).cast("long")

    counts = [count(place).alias(f"n_{part.kind}") for place, part in enumerate(BASE)]
    return joined.select(
        "doc_id",
        *counts,
        F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"),
        _text_of(every).alias("spans"),
    )


def _masked(text: Column, spans: Column) -> Column:
    """``text`` with a mark in place of each span; overlapping spans share one."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("pieces"))

    def add(done: Column, span: Column) -> Column:
        fresh = span["start"] >= done["at"]
        gap = F.substring(text, done["at"] + 1, span["start"] - done["at"])
        pieces = F.when(fresh, F.concat(done["pieces"], F.array(gap, F.lit(MASK))))
        return F.struct(
            F.greatest(done["at"], span["stop"]).alias("at"),
            pieces.otherwise(done["pieces"]).alias("pieces"),
        )

    rest = F.length(text)
    return F.aggregate(
        spans,
        zero,
        add,
        lambda done: F.concat(
            F.array_join(done["pieces"], ""), F.substring(text, done["at"] + 1, rest)
        ),
    )


def mask_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE
) -> DataFrame:
    """All rows and columns, with every reported span of the text masked and ``n_chars``, where
    there is such a column, counted anew for changed texts."""
    found = stage(find_parts(docs, id_col, text_col), "secret-parts")
    extra = stage(_linked_weak(found, scope), "linked-parts")
    text = F.col(f"doc.`{text_col}`")
    whole = F.coalesce(text, F.lit(""))
    # The row travels as one struct, so no column of it can clash with the ones made here.
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"))
    base = F.concat(*[_matches(whole, part, place) for place, part in enumerate(BASE)])
    rows = rows.withColumn("base", base)
    joined = _with_extra(rows, extra, F.col(f"doc.`{id_col}`").cast("long"), F.xxhash64(whole))
    spans = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(_SPANS))))
    joined = joined.select("doc", spans.alias("spans"))
    some = F.size("spans") > 0
    joined = joined.withColumn(
        "masked", F.when(some, _masked(whole, F.col("spans"))).otherwise(text)
    )
    columns = []
    for name in docs.columns:
        column = F.col(f"doc.`{name}`")
        if name == text_col:
            column = F.col("masked")
        elif name == "n_chars":
            new = F.length("masked").cast(docs.schema[name].dataType)
            column = F.when(some, new).otherwise(column)
        columns.append(column.alias(name))
    return joined.select(*columns)


def _sql_matches(place: int, part: Part) -> str:
    pattern = part.pattern.replace("'", "''")
    bounds = f"length(tested[i]) >= {part.at_least}"
    if part.below is not None:
        bounds += f" AND length(tested[i]) < {part.below}"
    return f"""SELECT doc_id, text_hash, {place} AS place, start, start + length(found[i]) AS stop
        FROM (SELECT doc_id, text_hash, found, tested, i,
                list_sum(list_transform(gaps[1:i], lambda g: length(g)))
                + coalesce(list_sum(list_transform(found[1:i - 1], lambda g: length(g))), 0) AS start
            FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (
                SELECT doc_id, text_hash,
                    regexp_extract_all(text, '{pattern}', 0) AS found,
                    regexp_extract_all(text, '{pattern}', {part.group}) AS tested,
                    string_split_regex(text, '{pattern}') AS gaps
                FROM texts)))
        WHERE {bounds}"""


def sql(scope: int = SCOPE) -> str:
    """DuckDB SQL for ``secret_spans`` over ``documents``."""
    kinds = "[" + ", ".join(f"'{part.kind}'" for part in KINDS) + "]"
    roles = "[" + ", ".join(f"'{part.role}'" for part in KINDS) + "]"
    every = "\nUNION ALL\n".join(_sql_matches(place, part) for place, part in enumerate(KINDS))
    span = f"({kinds})[place + 1] || ':' || start || ':' || stop"

    def joined(condition: str) -> str:
        return (
            f"coalesce(string_agg({span}, ',' ORDER BY start, place, stop)"
            f" FILTER ({condition}), '')"
        )

    counts = ", ".join(
        f"CAST(count(*) FILTER (place = {place}) AS BIGINT) AS n_{part.kind}"
        for place, part in enumerate(BASE)
    )
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS text,
            hash(coalesce(text, '')) AS text_hash FROM documents),
        parts AS (SELECT *, ({roles})[place + 1] AS role FROM (SELECT DISTINCT * FROM ({every}))),
        kept AS (SELECT * FROM parts a WHERE place < {len(BASE)} OR EXISTS (
            SELECT 1 FROM parts b WHERE a.doc_id IS NOT DISTINCT FROM b.doc_id
            AND a.text_hash = b.text_hash
            AND (a.role || '+' || b.role) IN ('identifier+secret', 'secret+identifier',
                'secret+endpoint', 'endpoint+secret')
            AND a.start - {scope} <= b.stop + {scope} AND b.start - {scope} <= a.stop + {scope}))
        SELECT doc_id, n_assign, n_access, n_hex, sha256(base) AS base_sha256, spans FROM (
            SELECT t.doc_id, any_value(t.text_hash), {counts},
                {joined(f"place < {len(BASE)}")} AS base, {joined("place >= 0")} AS spans
            FROM (SELECT *, row_number() OVER () AS r FROM texts) t
            LEFT JOIN kept k ON t.doc_id IS NOT DISTINCT FROM k.doc_id
                AND t.text_hash = k.text_hash
            GROUP BY r, t.doc_id)"""
