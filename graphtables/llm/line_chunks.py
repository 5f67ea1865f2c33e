"""Dedup of content-defined chunks of lines.

A text is cut into lines at ``\\n`` and the lines into chunks: a chunk ends after a line
where a rolling hash over the hashes of the last ``WINDOW`` lines is 0 modulo ``DIVISOR``,
and at the end of the text. Boundaries depend on nearby lines alone, so a passage that is
shifted, or shared by texts that differ around it, is cut alike from its first boundary
on. Of a chunk of two or more lines that occurs more than once among all texts, only
the first occurrence stays (smallest id, then position; null ids last).

Chunks meet by hash first; only those whose hash repeats are grouped by their bytes, so
different chunks of equal hashes stay. All of it is DataFrame expressions. The sets that
filter texts (repeated hashes, chunks to remove) are broadcast up to a counted number of
rows and joined by shuffle beyond it.

A chunk is removed only if it is shared whole, so :func:`remove_repeated` leaves what a shared
passage has outside its inner boundaries. :func:`remove_runs` removes every shared run:
beside the chunks it indexes each window of two lines, whatever the boundaries, and each line of ``RUN_WORDS``
words. A line goes if a chunk, window or line that covers it already occurred (equal 64-bit hash, then equal
bytes), and if the run of such lines around it has ``RUN_WORDS`` words or holds a repeated chunk. An
equal line stays at an earlier place for each line that goes.

Rows are numbered once, in a written table that every later step reads: a number that is computed again
follows the splits of the files, not the rows.

A null text stays null; the empty text is one empty line, never removed. A text may
lose all its chunks: its row stays, with an empty text. Repeated rows are later
occurrences of their first. Extra columns stay unchanged; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphtables.llm.common import bounded, free_name, let, written
from graphtables.operators.skew import split_join

WINDOW = 2
DIVISOR = 3
MIN_LINES = 2
#: words of a run, or of a line alone, that is removed though no whole chunk of it is repeated
RUN_WORDS = 10
#: rows of a filter that are broadcast
BROADCAST_ROWS = 500_000
#: of the rolling hash: a prime below 2^31 and a base, so that products stay below 2^63
MODULUS, BASE = 2147483647, 1000003


def _rolled(hashes: Column, end: Column, window: int) -> Column:
    """The rolling hash of the ``window`` lines that end with line ``end`` (from 1)."""
    value = F.lit(0).cast("long")
    for back in reversed(range(window)):
        line = F.coalesce(F.get(hashes, end - 1 - back), F.lit(0).cast("long"))
        value = F.pmod(value * BASE + line, F.lit(MODULUS).cast("long"))
    return value


def _ends(lines: Column, hashes: Column, window: int, divisor: int) -> Column:
    """The numbers (from 1) of the lines that end a chunk."""
    return F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: (i == F.size(lines)) | (
        F.pmod(_rolled(hashes, i, window), F.lit(divisor).cast("long")) == 0))


def _full(lines: Column) -> Column:
    return F.transform(lines, lambda line: F.xxhash64(line))


def _reduced(full: Column) -> Column:
    return F.transform(full, lambda h: F.pmod(h, F.lit(MODULUS).cast("long")))


def _hashed(lines: Column) -> Column:
    return _reduced(_full(lines))


def chunks(text: Column, with_text: bool, window: int = WINDOW, divisor: int = DIVISOR) -> Column:
    """Array of (lines: number of lines, hash, and the chunk's text if asked for) of a text."""
    def cut(lines: Column, hashes: Column) -> Column:
        def chunk(ends_: Column, end: Column, k: Column) -> Column:
            start = F.when(k == 0, 0).otherwise(F.get(ends_, k - 1))
            n = end - start
            fields = [n.alias("lines"), F.xxhash64(F.slice(hashes, start + 1, n)).alias("hash")]
            if with_text:
                fields.append(F.array_join(F.slice(lines, start + 1, n), "\n").alias("text"))
            return F.struct(*fields)

        return let(_ends(lines, hashes, window, divisor),
                   lambda ends_: F.transform(ends_, lambda end, k: chunk(ends_, end, k)))

    return let(F.split(text, "\n"), lambda lines: let(_hashed(lines), lambda hashes: cut(lines, hashes)))


def repeated_chunks(docs: DataFrame, order_by: str = "doc_id", text: str = "text", row: str = "row",
                    window: int = WINDOW, divisor: int = DIVISOR, min_lines: int = MIN_LINES,
                    broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(row, pos): the chunks (numbered from 0 in a text) to be removed. ``row`` is a unique number
    per row of ``docs``."""
    source = docs.where(F.col(text).isNotNull()).select(
        F.col(row).alias("row"), F.col(order_by).alias("order"), F.col(text).cast("string").alias("text"))

    def exploded(with_text: bool) -> DataFrame:
        return source.select("row", "order", F.posexplode(chunks(F.col("text"), with_text, window, divisor))
                             .alias("pos", "chunk")).where(F.col("chunk.lines") >= min_lines)

    hashes = exploded(False).groupBy("chunk.hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    hashes = bounded(written(hashes, "chunk-hashes"), broadcast_rows)
    found = exploded(True).select("row", "pos", F.col("chunk.hash").alias("hash"), F.col("chunk.text").alias("text"),
                                  F.struct(F.col("order").isNull().alias("none"), "order", "row", "pos").alias("place"))
    found = written(found.join(hashes, "hash", "left_semi"), "chunk-candidates")
    first = written(found.groupBy("hash", "text").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
                    .where("n > 1").drop("n"), "chunk-first")
    return found.join(first, ["hash", "text"]).where("place != first").select("row", "pos")


def remove_repeated(docs: DataFrame, order_by: str = "doc_id", text: str = "text", window: int = WINDOW,
                    divisor: int = DIVISOR, min_lines: int = MIN_LINES,
                    broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` without the chunks to be removed, and with a column ``n_removed`` of their
    number (``n_removed_`` and so on where ``docs`` has such a column)."""
    row, gone, cut = (free_name(docs, x) for x in ("row__", "gone__", "cut__"))
    numbered = written(docs.select("*", F.monotonically_increasing_id().alias(row)), "chunk-rows")
    removed = repeated_chunks(numbered, order_by, text, row, window, divisor, min_lines, broadcast_rows)
    removed = written(removed, "chunk-removals")
    by_row = removed.groupBy(F.col("row").alias(row)).agg(F.sort_array(F.collect_set("pos")).alias(gone))
    if removed.count() <= broadcast_rows:       # counted in positions, so the arrays are bounded as well
        by_row = F.broadcast(by_row)
    joined = numbered.join(by_row, row, "left")
    joined = joined.withColumn(cut, F.when(F.col(gone).isNotNull(), chunks(F.col(text).cast("string"), True, window, divisor)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col(gone))      # by hash, in order
    cleaned = F.when(F.col(gone).isNull(), F.col(text)).otherwise(let(F.col(cut), lambda all_: F.array_join(
        F.transform(kept, lambda k: F.get(all_, k)["text"]), "\n")))
    return joined.select(*(cleaned.alias(c) if c == text else F.col(c) for c in docs.columns),
                         F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(free_name(docs, "n_removed")))


def _words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))


def units(text: Column, with_text: bool, window: int = WINDOW, divisor: int = DIVISOR, min_lines: int = MIN_LINES,
          run_words: int = RUN_WORDS) -> Column:
    """Array of (pos: first line, from 0; lines; chunk: whether it is one; hash, and its text if asked for):
    the chunks of ``min_lines`` lines, every two lines and every line of ``run_words`` words of a text."""
    def spans(lines: Column, full: Column) -> Column:
        def span(pos: Column, n: Column, chunk: bool) -> Column:
            return F.struct(pos.alias("pos"), n.alias("lines"), F.lit(chunk).alias("chunk"))

        every = F.sequence(F.lit(0), F.size(lines) - 1)
        pairs = F.transform(F.filter(every, lambda i: i < F.size(lines) - 1), lambda i: span(i, F.lit(2), False))
        singles = F.transform(F.filter(every, lambda i: _words(F.get(lines, i)) >= run_words),
                              lambda i: span(i, F.lit(1), False))

        def start(ends: Column, k: Column) -> Column:
            return F.when(k == 0, 0).otherwise(F.get(ends, k - 1))

        whole = let(let(_reduced(full), lambda hashes: _ends(lines, hashes, window, divisor)), lambda ends: F.transform(
            ends, lambda end, k: span(start(ends, k), end - start(ends, k), True)))
        return F.concat(F.filter(whole, lambda s: s["lines"] >= min_lines), pairs, singles)

    def unit(lines: Column, full: Column, s: Column) -> Column:     # of all 64 bits: reduced hashes of many lines clash
        fields = [s["pos"].alias("pos"), s["lines"].alias("lines"), s["chunk"].alias("chunk"),
                  F.xxhash64(s["chunk"], F.slice(full, s["pos"] + 1, s["lines"])).alias("hash")]
        if with_text:
            fields.append(F.array_join(F.slice(lines, s["pos"] + 1, s["lines"]), "\n").alias("text"))
        return F.struct(*fields)

    return let(F.split(text, "\n"), lambda lines: let(_full(lines), lambda full: F.transform(
        spans(lines, full), lambda s: unit(lines, full, s))))


def repeated_units(docs: DataFrame, order_by: str = "doc_id", text: str = "text", row: str = "row",
                   window: int = WINDOW, divisor: int = DIVISOR, min_lines: int = MIN_LINES, run_words: int = RUN_WORDS,
                   broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(row, line, chunk): the lines (from 0) of the units that occurred at an earlier place, and whether a
    chunk covers them. ``row`` is a unique number per row of ``docs``."""
    source = docs.where(F.col(text).isNotNull()).select(
        F.col(row).alias("row"), F.col(order_by).alias("order"), F.col(text).cast("string").alias("text"))

    def exploded(with_text: bool) -> DataFrame:
        return source.select("row", "order", F.explode(units(
            F.col("text"), with_text, window, divisor, min_lines, run_words)).alias("unit")).select(
            "row", "unit.*", F.struct(F.col("order").isNull().alias("none"), "order", "row", F.col("unit.pos").alias("pos"))
            .alias("place"))

    hashes = exploded(False).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    hashes = bounded(written(hashes, "run-hashes"), broadcast_rows)
    # bytes are compared by the grouping; a task sends each text once, however often it has it
    met = written(exploded(True).join(hashes, "hash", "left_semi").groupBy("hash", "chunk", "text").agg(
        F.min("place").alias("first"), F.count(F.lit(1)).alias("n")), "run-texts")
    by_hash = met.groupBy("hash", "chunk").agg(
        F.count(F.lit(1)).alias("texts"), F.max("n").alias("n"), F.min("first").alias("first"))
    # of a hash with one text an equal hash is an equal text; the others are told apart by their bytes
    alone = written(by_hash.where("texts = 1 and n > 1").select(
        F.col("hash").alias("of"), F.col("chunk").alias("kind"), "first"), "run-first")
    several = written(by_hash.where("texts > 1").select("hash", "chunk"), "run-clashes")
    found = exploded(False).select("row", "pos", "lines", "chunk", "hash", "place")
    if alone.count() <= broadcast_rows:
        first = F.broadcast(alone)
        again = found.join(first, (F.col("hash") == F.col("of")) & (F.col("chunk") == F.col("kind")))
    else:
        again = split_join(found.join(hashes, "hash", "left_semi"), alone, ["hash", "chunk"], ["of", "kind"])
    if not several.isEmpty():
        clashing = exploded(True).join(several, ["hash", "chunk"], "left_semi")
        again = again.select("row", "pos", "lines", "chunk", "place", "first").unionByName(clashing.join(
            met.join(several, ["hash", "chunk"], "left_semi").select("hash", "chunk", "text", "first"),
            ["hash", "chunk", "text"]).select("row", "pos", "lines", "chunk", "place", "first"))
    again = again.where("place != first")
    return again.select("row", "chunk", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("lines") - 1)).alias(
        "line")).groupBy("row", "line").agg(F.max("chunk").alias("chunk"))


def remove_runs(docs: DataFrame, order_by: str = "doc_id", text: str = "text", window: int = WINDOW,
                divisor: int = DIVISOR, min_lines: int = MIN_LINES, run_words: int = RUN_WORDS,
                broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` without the runs of lines that occurred at an earlier place, and with a column ``n_removed`` of
    the number of their lines (named as in :func:`remove_repeated`)."""
    row, gone, cut = (free_name(docs, x) for x in ("row__", "gone__", "cut__"))
    numbered = written(docs.select("*", F.monotonically_increasing_id().alias(row)), "run-rows")
    again = written(repeated_units(numbered, order_by, text, row, window, divisor, min_lines, run_words, broadcast_rows),
                    "run-lines")
    by_row = again.groupBy(F.col("row").alias(row)).agg(F.sort_array(F.collect_list(F.struct("line", "chunk"))).alias(gone))
    if again.count() <= broadcast_rows:         # counted in lines, so the arrays are bounded as well
        by_row = F.broadcast(by_row)

    def removed(lines: Column, at: Column) -> Column:
        """The lines of the runs that go; ``at`` has all repeated ones in order."""
        starts = F.filter(F.sequence(F.lit(0), F.size(at) - 1), lambda k: (k == 0) | (
            F.get(at, k)["line"] != F.get(at, k - 1)["line"] + 1))
        runs = let(starts, lambda starts_: F.transform(starts_, lambda start, k: F.slice(
            at, start + 1, F.coalesce(F.get(starts_, k + 1), F.size(at)) - start)))
        goes = F.filter(runs, lambda run: F.exists(run, lambda x: x["chunk"]) | (F.aggregate(
            run, F.lit(0), lambda n, x: n + _words(F.get(lines, x["line"]))) >= run_words))
        return F.transform(F.flatten(goes), lambda x: x["line"])

    def cleaned(lines: Column, lost: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)       # by hash, in order
        return F.struct(F.array_join(F.transform(kept, lambda k: F.get(lines, k)), "\n").alias("text"),
                        F.size(lost).alias("n"))

    joined = numbered.join(by_row, row, "left").withColumn(cut, F.when(F.col(gone).isNotNull(), let(
        F.split(F.col(text).cast("string"), "\n"), lambda lines: let(
            removed(lines, F.col(gone)), lambda lost: cleaned(lines, lost)))))
    new = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.col(cut)["text"])
    return joined.select(*(new.alias(c) if c == text else F.col(c) for c in docs.columns),
                         F.coalesce(F.col(cut)["n"], F.lit(0)).cast("long").alias(free_name(docs, "n_removed")))
