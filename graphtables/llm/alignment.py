"""Token links between two tokenizers, counted over a corpus by external spill counting.

A text's tokens of both tokenizers are laid over its bytes. Offsets where tokens of both end cut them into groups,
and each token of A is linked with each of B in its group. The count of an id pair is the number of documents that
hold it linked.

Method. Tasks gather documents to runs of bounded size. A run's pair-document records (pair, document, times) are
sorted by A's id, then B's, and written compressed; its distinct pairs with their numbers of documents are
dealt by a radix of A's id into compressed slices. Of one radix, a k-way heap merge of the slices of all runs
adds up each pair's documents. As it reads A's side in order, all pairs of an id are complete when the id ends, so
their maximum is known, and count and maximum flow back to each run in the order of its slice.
The run's records then add them up by document. Beyond ``fan_in`` runs, slices are first merged to slices of
groups of runs, in as many passes as that takes, and the counts return the same way. A frequent
pair is one entry of a run, whatever number of documents holds it.

Between two characters that are not white space, a blank or a line break that is followed by a third begins
a new token in either tokenizer, so texts are cut there and each distinct piece is tokenized and aligned once a task. That
holds for byte-level BPE without normaliser and for pieces that have no blank but in front; for other files texts stay whole.

Null and empty texts, and those whose tokens do not spell blank + text, have no tokens: zeros and an empty
digest. Null ids and repeated rows are documents of their own; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphtables._workers import ship_with_tasks
from graphtables.llm.common import pack, unpack, written
from graphtables.llm.tokens import numbering

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: bytes of text of a run
RUN_BYTES = 6 << 20
#: pairs that the slices of one radix have together, about
SLICE_PAIRS = 400_000
#: runs that are merged at a time
FAN_IN = 1000
#: entries that a cursor of the merge holds
CURSOR = 4096
#: pieces that a task remembers beyond a run
REMEMBERED = 450_000
#: links of a group that are listed one by one
LARGE_GROUP = 4096

_SHIFT = 20                             # a pair is A's id above 20 bits of B's
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: pieces whose pre-tokens are their groups: a line break, Latin letters after a blank or none, ASCII signs (not the apostrophe)
_PLAIN = re.compile(r"(\n)?([ ]?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)")


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies spell bytes with: printable ones stand for themselves, the
    others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """Both tokenizers, and what a task has learnt of pieces of text: each has a number, and by that its measures."""

    def __init__(self, a_definition: str, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(a_definition)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()
                        for t, i in vocabulary.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        form = json.loads(a_definition)
        pre = form.get("pre_tokenizer") or {}
        self.cuts = (form.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                     and not pre.get("add_prefix_space")
                     and not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)
                     and b"".join(self.b_bytes[i] for i in self.b.encode("a  b\n c \n")) == b" a  b\n c \n")
        self.spelled = {b: c for c, b in alphabet.items()}
        known = range(max(self.a_bytes) + 1)
        self.a_size = np.array([len(self.a_bytes.get(i, b"")) for i in known], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        # an id of A then B, in the middle of its side of a group and at its end
        self.written = [f"{i}{x}" for i in known for x in ",|"] + [f"{i}{x}" for i in range(len(pieces)) for x in ",;"]
        self.forget()

    def forget(self) -> None:
        self.number = numbering()               # of a piece
        self.pair_number = numbering()          # of a pair of ids
        self.measures = array("q")              # of each piece: tokens of A and B, groups, links; -1s if it is not spelled
        self.groups: list[str] = []             # its groups as text
        self.ends = array("q", [0])             # its pairs end here
        self.pairs, self.times = array("q"), array("q")

    def pieces(self, text: str) -> list[str]:
        return _CUT.split(" " + text) if self.cuts else [" " + text]

    def numbers(self, text: str) -> np.ndarray:
        cut = self.pieces(text)
        return np.fromiter(map(self.number.__getitem__, cut), np.int64, len(cut))

    def _a_ids(self, pieces: list[str]) -> list[list[int]]:
        """A's ids of each piece. Where the pre-tokens are plain to see they go to the model as it spells them, which
        takes a third of the time; other pieces go to the whole tokenizer."""
        out: list = [None] * len(pieces)
        rest = []
        tokenize, spelled, blank = self.a.model.tokenize, self.spelled, self.spelled[32]
        for k, piece in enumerate(pieces):
            plain = _PLAIN.fullmatch(piece) if self.cuts else None
            if plain is None:
                rest.append(k)
                continue
            ids = []
            for part in plain.groups():
                if part:
                    part = part.replace(" ", blank) if part.isascii() and part != "\n" else (
                        part.encode().decode("latin-1").translate(spelled))
                    ids += [t.id for t in tokenize(part)]
            out[k] = ids
        for k, found in zip(rest, self.a.encode_batch_fast([pieces[k] for k in rest], add_special_tokens=False)):
            out[k] = found.ids
        return out

    def learn(self) -> None:
        """Tokenizes and aligns the pieces that have a number and no measures yet."""
        new = list(islice(self.number, len(self.groups), None))
        for at in range(0, len(new), 16_384):
            some = new[at:at + 16_384]
            b = self.b.encode([p[1:] if p[0] == " " else p for p in some], num_threads=1)
            self._align(some, self._a_ids(some), [two if piece[0] == " " else two[1:] for piece, two in zip(some, b)])

    def _align(self, pieces: list[str], a: list[list[int]], b: list[list[int]]) -> None:
        """Lays the tokens of many pieces, one piece after another, over their bytes."""
        texts_ = [p.encode() for p in pieces]
        n = np.array([len(t) for t in texts_], np.int64)
        whole = n > 0
        sides = []
        for ids, spelling, size in ((a, self.a_bytes, self.a_size), (b, self.b_bytes, self.b_size)):
            flat = np.fromiter(chain.from_iterable(ids), np.int64)
            of = np.repeat(np.arange(len(pieces)), [len(x) for x in ids])
            whole &= np.bincount(of, size[flat], minlength=len(pieces)).astype(np.int64) == n
            if not whole.all() or b"".join(map(spelling.__getitem__, flat.tolist())) != b"".join(texts_):
                whole &= np.array([b"".join(map(spelling.__getitem__, x)) == t for x, t in zip(ids, texts_)], bool)
            sides.append((flat, of, size))
        (a_ids, a_of), (b_ids, b_of) = ((f[whole[o]], o[whole[o]]) for f, o, _ in sides)
        ends_a, ends_b = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)     # the end of every piece among them
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        n_a, n_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        of = np.empty(len(common), np.int64)
        of[group_a] = a_of                                              # the piece of each group
        count = len(pieces)
        measure = np.stack([np.bincount(a_of, minlength=count), np.bincount(b_of, minlength=count),
                            np.bincount(of, minlength=count), np.bincount(of, n_a * n_b, minlength=count).astype(np.int64)], 1)
        measure[~whole] = -1
        self.measures.extend(measure.ravel().tolist())
        self._write_groups(count, a_ids, group_a, a_of, b_ids, group_b, b_of)
        self._link(count, of, n_a, n_b, a_ids, b_ids)

    def _write_groups(self, count: int, a_ids, group_a, a_of, b_ids, group_b, b_of) -> None:
        """Each group as ``a1,a2|b1``, and a piece's groups joined by ``;``."""
        last_a = np.append(group_a[1:] != group_a[:-1], True) if len(group_a) else np.zeros(0, bool)
        last_b = np.append(group_b[1:] != group_b[:-1], True) if len(group_b) else np.zeros(0, bool)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        word = np.concatenate([2 * a_ids + last_a, 2 * (b_ids + len(self.a_size)) + last_b])[order]
        of = np.concatenate([a_of, b_of])[order]
        words = list(map(self.written.__getitem__, word.tolist()))
        ends = np.cumsum(np.bincount(of, minlength=count)).tolist()
        start = 0
        for end in ends:
            self.groups.append("".join(words[start:end])[:-1])
            start = end

    def _link(self, count: int, of, n_a, n_b, a_ids, b_ids) -> None:
        """The pairs of each piece: all of a group's A tokens with all of its B tokens."""
        start_a, start_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        links = n_a * n_b
        large = links > LARGE_GROUP         # a group may be as long as a text: its distinct ids only
        small = np.flatnonzero(~large)
        row = np.repeat(small, links[small])
        k = np.arange(len(row)) - np.repeat(np.cumsum(links[small]) - links[small], links[small])
        codes = [a_ids[start_a[row] + k // n_b[row]] << _SHIFT | b_ids[start_b[row] + k % n_b[row]]]
        pieces, times = [of[row]], [np.ones(len(row), np.int64)]
        for g in np.flatnonzero(large).tolist():
            x, n = np.unique(a_ids[start_a[g]:start_a[g] + n_a[g]], return_counts=True)
            y, m = np.unique(b_ids[start_b[g]:start_b[g] + n_b[g]], return_counts=True)
            codes.append((x[:, None] << _SHIFT | y).ravel())
            times.append((n[:, None] * m).ravel())
            pieces.append(np.full(len(codes[-1]), of[g]))
        piece, code, often = (np.concatenate(x) for x in (pieces, codes, times))
        if len(pieces) > 1:
            order = np.argsort(piece, kind="stable")
            piece, code, often = piece[order], code[order], often[order]
        distinct, at = np.unique(code, return_inverse=True)
        numbers = np.fromiter(map(self.pair_number.__getitem__, distinct.tolist()), np.int64, len(distinct))
        base = len(self.pairs)
        self.pairs.extend(numbers[at].tolist())
        self.times.extend(often.tolist())
        self.ends.extend((base + np.cumsum(np.bincount(piece, minlength=count))).tolist())


def _run(documents: list[str | None], pair: Pair) -> dict:
    """The columns of a run but its name and ids."""
    if len(pair.groups) > REMEMBERED:
        pair.forget()
    numbers = [pair.numbers(t) if t else None for t in documents]
    pair.learn()
    groups = pair.groups
    measure = np.array(pair.measures, np.int64).reshape(-1, 4)
    counts, digests, entries, of_doc = np.zeros((len(documents), 4), np.int64), [], [], []
    for d, ids in enumerate(numbers):
        if ids is None or (measure[ids, 0] < 0).any():
            digests.append("")
            continue
        digests.append(hashlib.sha256(";".join(map(groups.__getitem__, ids.tolist())).encode()).hexdigest())
        found, often = np.unique(ids, return_counts=True)
        entries.append((found, often))
        of_doc.append(d)
    if not entries:
        none = pack(np.zeros(0, np.int64))
        return {"counts": counts, "digests": digests, "pairs": none, "docs": none, "rec_docs": none, "rec_times": none, "n": 0}
    piece, often = (np.concatenate(x) for x in zip(*entries))
    doc = np.repeat(np.array(of_doc, np.int64), [len(f) for f, _ in entries])
    for k in range(4):
        counts[:, k] = np.bincount(doc, measure[piece, k] * often, minlength=len(documents))
    # pair-document records: each piece of a document gives its pairs, A's side first, then B's, then the document
    codes = np.fromiter(pair.pair_number, np.int64, len(pair.pair_number))
    order = np.argsort(codes)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    ends = np.array(pair.ends, np.int64)
    size = ends[piece + 1] - ends[piece]
    at = np.repeat(ends[piece] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    key = rank[np.array(pair.pairs, np.int64)[at]] * len(documents) + np.repeat(doc, size)
    weight = np.array(pair.times, np.int64)[at] * np.repeat(often, size)
    by = np.argsort(key)
    key, weight = key[by], weight[by]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key, weight = key[starts], np.add.reduceat(weight, starts)
    of_pair, of_doc_ = np.divmod(key, len(documents))
    first = np.concatenate([[True], of_pair[1:] != of_pair[:-1]])
    step = np.where(first, of_doc_, np.diff(of_doc_, prepend=0))
    mine = np.flatnonzero(first)
    return {"counts": counts, "digests": digests, "pairs": pack(np.diff(codes[order][of_pair[mine]], prepend=0)),
            "docs": pack(np.diff(mine, append=len(of_pair))), "rec_docs": pack(step), "rec_times": pack(weight), "n": len(mine)}


_RUN = ("run string, n bigint, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
        "groups_sha256 array<string>, pairs binary, docs binary, rec_docs binary, rec_times binary")


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _runs(docs: DataFrame, a_file: str, b_file: str, run_bytes: int) -> DataFrame:
    """One row per run of documents (id, text)."""
    with open(a_file, encoding="utf-8") as f:       # the tokenizer files are the driver's and go with the tasks
        a_definition = f.read()
    with open(b_file, "rb") as f:
        b_model = f.read()
    schema = T.StructType([T.StructField("ids", T.ArrayType(docs.schema["id"].dataType)),
                           *T._parse_datatype_string(_RUN).fields])
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = None, 0
        ids: list = []
        held: list[str | None] = []
        size = 0

        def closed() -> pa.RecordBatch:
            nonlocal pair, number, ids, held, size
            pair = pair or Pair(a_definition, b_model)
            found = _run(held, pair)
            counts, digests = found.pop("counts"), found.pop("digests")
            record = {"ids": ids, "run": f"{TaskContext.get().partitionId()}.{number}", "groups_sha256": digests, **found,
                      **{name: counts[:, k].tolist() for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))}}
            number, ids, held, size = number + 1, [], [], 0
            return pa.RecordBatch.from_pylist([record], schema=arrow)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                ids.append(i)
                held.append(text)
                size += 100 + len(text or "")
                if size >= run_bytes:
                    yield closed()
        if ids:
            yield closed()

    return docs.mapInArrow(run, schema)


_SLICE = "radix int, run string, n bigint, pairs binary, docs binary"


def _slices(runs: DataFrame, radixes: int) -> DataFrame:
    """The distinct pairs of each run by the radix of A's id, in order, with their numbers of documents."""
    schema = T._parse_datatype_string(_SLICE)
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, pairs, docs in zip(*(c.to_pylist() for c in batch.columns)):
                codes, n = np.cumsum(unpack(pairs)), unpack(docs)
                radix = (codes >> _SHIFT) % radixes
                order = np.argsort(radix, kind="stable")        # a slice stays in the pairs' order
                codes, n, radix = codes[order], n[order], radix[order]
                bounds = [*np.flatnonzero(np.diff(radix, prepend=-1)), len(radix)]
                out = [{"radix": int(radix[a]), "run": name, "n": int(b - a), "pairs": pack(np.diff(codes[a:b], prepend=0)),
                        "docs": pack(n[a:b])} for a, b in zip(bounds, bounds[1:])]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return runs.select("run", "pairs", "docs").mapInArrow(run, schema)


def _cursor(number: int, codes: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, int]]:
    for at in range(0, len(codes), CURSOR):
        for code, k in zip(codes[at:at + CURSOR].tolist(), n[at:at + CURSOR].tolist()):
            yield code, number, k


def merged(slices: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int, list[int]]]:
    """(pair, documents, slices that have it) in order, by a heap over the slices' cursors."""
    code, total, where = -1, 0, []
    for now, number, n in heapq.merge(*(_cursor(k, *s) for k, s in enumerate(slices))):
        if now != code:
            if where:
                yield code, total, where
            code, total, where = now, 0, []
        total += n
        where.append(number)
    if where:
        yield code, total, where


def contributions(slices: list[tuple[np.ndarray, np.ndarray]]) -> list[list[int]]:
    """For each slice, in its order, twice a pair's documents, plus one if no pair of its A id has more."""
    out: list[list[int]] = [[] for _ in slices]
    side, most, waiting = -1, 0, []

    def flow() -> None:
        for total, where in waiting:
            value = 2 * total + (total == most)
            for k in where:
                out[k].append(value)

    for code, total, where in merged(slices):
        if code >> _SHIFT != side:
            flow()
            side, most, waiting = code >> _SHIFT, 0, []
        most = max(most, total)
        waiting.append((total, where))
    flow()
    return out


def _read(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.cumsum(unpack(p.as_py())), unpack(d.as_py())) for p, d in zip(table["pairs"], table["docs"])]


_ANSWER = "radix int, run string, answers binary"


def _counted(slices: DataFrame, n_runs: int, fan_in: int) -> DataFrame:
    """(radix, run, answers): the contributions of every slice."""
    answer, slice_ = (_arrow(T._parse_datatype_string(s)) for s in (_ANSWER, _SLICE))
    if n_runs <= fan_in:
        def merge(table: pa.Table) -> pa.Table:
            found = contributions(_read(table))
            return pa.Table.from_pylist([{"radix": r.as_py(), "run": run.as_py(), "answers": pack(np.array(x, np.int64))}
                                         for r, run, x in zip(table["radix"], table["run"], found)], schema=answer)

        return slices.groupBy("radix").applyInArrow(merge, _ANSWER)

    groups = math.ceil(n_runs / fan_in)
    group = F.pmod(F.xxhash64("run", F.lit(n_runs)), F.lit(groups)).cast("string")
    dealt = slices.withColumn("grouped", group)

    def add(table: pa.Table) -> pa.Table:
        rows = [(code, total) for code, total, _ in merged(_read(table))]
        codes, n = np.array(rows, np.int64).reshape(-1, 2).T
        return pa.Table.from_pylist([{"radix": table["radix"][0].as_py(), "run": table["grouped"][0].as_py(), "n": len(codes),
                                      "pairs": pack(np.diff(codes, prepend=0)), "docs": pack(n)}], schema=slice_)

    above = written(dealt.groupBy("radix", "grouped").applyInArrow(add, _SLICE), "alignment-merged")
    answers = _counted(above, groups, fan_in)

    def back(key: tuple, table: pa.Table, parent: pa.Table) -> pa.Table:
        parts = _read(table)
        codes = np.unique(np.concatenate([c for c, _ in parts]))
        values = unpack(parent["answers"][0].as_py())
        return pa.Table.from_pylist([
            {"radix": r.as_py(), "run": run.as_py(), "answers": pack(values[np.searchsorted(codes, c)])}
            for r, run, (c, _) in zip(table["radix"], table["run"], parts)], schema=answer)

    return dealt.groupBy("radix", "grouped").cogroup(answers.groupBy("radix", "run")).applyInArrow(back, _ANSWER)


_RESULT = ("n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")


def _totals(runs: DataFrame, answers: DataFrame, radixes: int) -> DataFrame:
    """One row per document: its run's records with the counts that flowed back."""
    ids = runs.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", ids), *T._parse_datatype_string(_RESULT).fields])
    arrow = _arrow(schema)

    def run(key: tuple, run_: pa.Table, back: pa.Table) -> pa.Table:
        row = run_.to_pylist()[0]
        codes, docs = np.cumsum(unpack(row["pairs"])), unpack(row["docs"])
        value = np.zeros(len(codes), np.int64)
        order = np.argsort((codes >> _SHIFT) % radixes, kind="stable")
        answered = sorted(zip(back["radix"].to_pylist(), back["answers"].to_pylist()))
        if answered:
            value[order] = np.concatenate([unpack(a) for _, a in answered])
        step = unpack(row["rec_docs"])
        ends = np.cumsum(docs)
        total = np.cumsum(step)                     # document numbers restart with each pair
        base = np.concatenate([[0], total[ends[:-1] - 1]]) if len(ends) else np.zeros(0, np.int64)
        doc = total - np.repeat(base, docs)
        times = unpack(row["rec_times"])
        of = np.repeat(value, docs)
        n = len(row["ids"])
        best, sums = np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.add.at(best, doc, times * (of & 1))
        np.add.at(sums, doc, times * (of >> 1))
        columns = [row["ids"], *(row[c] for c in ("n_a", "n_b", "n_groups", "n_links")), best.tolist(), sums.tolist(),
                   row["groups_sha256"]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return runs.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(run, schema)


def align(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text: str = "text",
          run_bytes: int = RUN_BYTES, slice_pairs: int = SLICE_PAIRS, fan_in: int = FAN_IN) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row of ``docs``: numbers of tokens, groups and
    links, of links whose pair no other pair of its A id outnumbers, the sum of the links' counts, and the digest of the groups
    written as ``a1,a2|b1;a3|b2,b3``. ``a_file`` is a byte-level file of tokenizers, ``b_file`` one of sentencepiece."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    runs = written(_runs(source, a_file, b_file, run_bytes), "alignment-runs", "none")
    totals = runs.agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs")).first()
    radixes = max(8, math.ceil(totals["pairs"] / slice_pairs))
    slices = _slices(runs, radixes)
    if totals["runs"] > fan_in:
        slices = written(slices, "alignment-slices", "none")
    return _totals(runs, _counted(slices, totals["runs"], fan_in), radixes)


ship_with_tasks(__name__)
