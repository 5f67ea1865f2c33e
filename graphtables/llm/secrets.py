"""Secret scans with multipart credential linking.

Each kind of part has a pattern; its matches are leftmost and do not overlap one
another. Strong kinds (``assign``, ``access``, ``hex``) are reported wherever they
stand. Weak kinds are candidates: too plain to report alone, they are reported only
when parts that complement them stand in the same scope, which reaches ``REACH``
code points to either side:

* a weak secret (a short hex or a long mixed token) beside an identifier or an endpoint,
* a weak identifier (a user, client, account or similar id) beside a secret,
* an endpoint (URL, address) beside an identifier and a secret.

Scopes and parts meet in an interval join: parts are listed under the ``REACH``-wide
cells that they cover, weak ones under those that their scope covers, and the join is on
(text, cell). Parts of a kind are disjoint and have a least length, so a cell holds a
bounded number of them however many a text has. A weak candidate that overlaps a strong
part is no part of its own.

Positions are code points from 0, ends exclusive; they come from running sums over
the gaps between matches (a pattern is applied once, by marking its matches).
All of it is DataFrame expressions. Null texts are empty texts. Null ids and repeated
rows are scanned one by one; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphtables.llm.common import let, text_or_empty, written

REACH = 300


class Kind(NamedTuple):
    name: str
    pattern: str
    role: str
    weak: bool = False
    value_group: int = 0        # a match counts if this group has at least ..
    value_chars: int = 1        # .. so many code points


# Fixed patterns; the first three are the contract's, in its order.
KINDS = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         "secret", value_group=2, value_chars=6),
    Kind("access", r"AKIA[A-Z0-9]+", "identifier", value_chars=20),
    Kind("hex", r"[0-9a-f]{24,}", "secret"),        # the runs of 24 or more are all its matches
    Kind("weak_secret", r"(?<![0-9a-f])(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{16,23}(?![0-9a-f])"
         r"|(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[A-Z0-9+/]*[a-z])(?=[a-z0-9+/]*[A-Z])[A-Za-z0-9+/]{32,}",
         "secret", weak=True),
    Kind("weak_id", r"""(?i:client|account|user|access|tenant|login)[_-]?(?i:id|name|key_?id)["']?\x20*[:=]\x20*["']?"""
         r"[A-Za-z0-9@._-]{3,}|(?:ASIA|AROA|AIDA)[A-Z0-9]{12,}", "identifier", weak=True),
    Kind("endpoint", r"""[a-z][a-z0-9+.:-]{1,20}://[^\s"'<>\x01]{4,}|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])""",
         "endpoint", weak=True),
)
_MARK = "\x01"


def _matches(text: Column, number: int, kind: Kind) -> Column:
    """Array of (kind, k, gap before the match, its length, whether it counts)."""
    marked = F.regexp_replace(text, F.lit(kind.pattern), F.lit(f"{_MARK}$0{_MARK}"))

    def listed(parts: Column) -> Column:
        def match(k: Column) -> Column:
            found = F.get(parts, 2 * k + 1)
            value = F.regexp_extract(found, kind.pattern, kind.value_group) if kind.value_group else found
            return F.struct(F.lit(number).alias("kind"), k.alias("k"),
                            F.char_length(F.get(parts, 2 * k)).cast("long").alias("gap"),
                            F.char_length(found).cast("long").alias("length"),
                            (F.char_length(value) >= kind.value_chars).alias("counts"))

        numbers = F.sequence(F.lit(0), F.greatest(F.floor((F.size(parts) - 1) / 2).cast("int") - 1, F.lit(0)))
        return F.filter(F.transform(numbers, match), lambda m: m["gap"].isNotNull() & m["length"].isNotNull())

    return let(F.split(marked, _MARK), listed)


def find_parts(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
               kinds: tuple[Kind, ...] = KINDS) -> tuple[DataFrame, DataFrame]:
    """(texts, parts): the id of each row and its number ``row``; (row, kind, start, end) of
    every match, kind being its place in ``kinds``. The texts are read once."""
    clean = F.replace(text_or_empty(text), F.lit(_MARK), F.lit("\x02"))     # as long, and in no pattern
    scanned = written(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), clean.alias("text"))
        .select("row", "id", F.concat(*(_matches(F.col("text"), n, k) for n, k in enumerate(kinds))).alias("found")),
        "secret-matches")
    before = Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = (scanned.select("row", F.inline("found"))
             .withColumn("end", F.sum(F.col("gap") + F.col("length")).over(before))
             .where("counts").select("row", "kind", (F.col("end") - F.col("length")).alias("start"), "end"))
    return scanned.select("row", "id"), written(parts, "secret-parts")


def link_parts(parts: DataFrame, kinds: tuple[Kind, ...] = KINDS, reach: int = REACH) -> DataFrame:
    """``parts`` less the weak ones that nothing complements in their scope."""
    role = F.element_at(F.array(*(F.lit(k.role) for k in kinds)), F.col("kind") + 1)
    weak = F.element_at(F.array(*(F.lit(k.weak) for k in kinds)), F.col("kind") + 1)

    def cell(at: Column) -> Column:
        return F.floor(at / reach)

    scopes = parts.where(weak).withColumn("cell", F.explode(
        F.sequence(cell(F.greatest(F.col("start") - reach, F.lit(0))), cell(F.col("end") + reach))))
    near = parts.select("row", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end") - 1))).alias("cell"),
                        F.col("kind").alias("kind2"), F.col("start").alias("start2"), F.col("end").alias("end2"),
                        role.alias("role2"), (~weak).alias("strong2"))
    together = scopes.join(near, ["row", "cell"]).where(
        "start2 < end + {0} and end2 > start - {0} and not (kind = kind2 and start = start2)".format(reach))
    overlaps = F.col("strong2") & (F.col("start2") < F.col("end")) & (F.col("end2") > F.col("start"))
    seen = together.groupBy("row", "kind", "start", "end").agg(
        F.bool_or(overlaps).alias("covered"),
        *(F.bool_or(F.col("role2") == r).alias(r) for r in ("identifier", "secret", "endpoint")))
    complemented = (F.when(role == "secret", F.col("identifier") | F.col("endpoint"))
                    .when(role == "identifier", F.col("secret"))
                    .otherwise(F.col("identifier") & F.col("secret")))
    return parts.where(~weak).unionAll(
        seen.where(~F.col("covered") & complemented).select("row", "kind", "start", "end"))


def credential_links(reported: DataFrame, kinds: tuple[Kind, ...] = KINDS, reach: int = REACH) -> DataFrame:
    """The credentials that reported parts make up: (row, kind, start, end, kind2, start2, end2) of each identifier or
    endpoint and each secret whose scopes meet and that do not overlap. An interval join as above; a pair passes at the first
    cell that both are listed under."""
    role = F.element_at(F.array(*(F.lit(k.role) for k in kinds)), F.col("kind") + 1)

    def cell(at: Column) -> Column:
        return F.floor(at / reach)

    first = cell(F.greatest(F.col("start") - reach, F.lit(0)))
    owners = reported.where(role != "secret").select("row", "kind", "start", "end", first.alias("first"), F.explode(
        F.sequence(first, cell(F.col("end") + reach))).alias("cell"))
    found = reported.where(role == "secret").select(
        "row", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end") - 1))).alias("cell"),
        F.col("kind").alias("kind2"), F.col("start").alias("start2"), F.col("end").alias("end2"))
    met = owners.join(found, ["row", "cell"]).where(F.col("cell") == F.greatest("first", cell(F.col("start2"))))
    return met.where("start2 < end + {0} and end2 > start - {0} and (start2 >= end or end2 <= start)".format(reach)).select(
        "row", "kind", "start", "end", "kind2", "start2", "end2")


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", kinds: tuple[Kind, ...] = KINDS,
         reach: int = REACH) -> DataFrame:
    """One row per row of ``docs``: id, spans, an array of (start, kind, end) in that order, kind being its place in
    ``kinds``, and links, an array of (start, kind, end, start2, kind2, end2): which identifier or endpoint goes with which secret."""
    rows, parts = find_parts(docs, id_col, text, kinds)
    reported = written(link_parts(parts, kinds, reach), "secret-spans")
    spans = reported.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    links = credential_links(reported, kinds, reach).groupBy("row").agg(F.sort_array(F.collect_list(
        F.struct("start", "kind", "end", "start2", "kind2", "end2"))).alias("links"))

    def or_none(name: str, table: DataFrame) -> Column:
        return F.coalesce(name, F.array().cast(table.schema[name].dataType)).alias(name)

    return rows.join(spans, "row", "left").join(links, "row", "left").select("id", or_none("spans", spans), or_none("links", links))


def link_text(links: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """``kind:start:end>kind:start:end`` of each link, joined by commas."""
    names = F.array(*(F.lit(k.name) for k in kinds))

    def part(x: Column, end: str) -> Column:
        return F.concat_ws(":", F.element_at(names, x[f"kind{end}"] + 1), x[f"start{end}"].cast("string"), x[f"end{end}"].cast("string"))

    return F.array_join(F.transform(links, lambda x: F.concat_ws(">", part(x, ""), part(x, "2"))), ",")


def span_text(spans: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*(F.lit(k.name) for k in kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
