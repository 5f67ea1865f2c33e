"""Token counts without tokenising: pieces per distinct pre-token times its frequency.

Tasks gather texts to blocks of bounded size, and write for each block its distinct
pre-tokens and, per text, which of them it has how often. The pre-tokens of all blocks are
dealt by hash, so that equal ones meet; each distinct one is counted once by the tokenizer's
model. The counts return to the blocks (one number per distinct pre-token), and a text's
tokens are the sum of frequency times pieces. Common pre-tokens are one entry per block,
so none is hot; no ids are kept.

White space never is part of a pre-token of this tokenizer, so the normaliser and
pre-tokeniser run once per distinct blank-separated chunk of a block. Special strings inside a
text are found before, as the library does, and count one.

Null texts are empty texts (no bytes, no tokens). Null ids and repeated rows are counted
one by one; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphtables._workers import ship_with_tasks
from graphtables.llm.common import pack, pack_words, texts, unpack, unpack_words, written

TOKENIZER = "word_bpe_49k.json"
#: bytes of text of a block
BLOCK_BYTES = 12 << 20
#: dictionary entries that one group of the counting stage gets, about
GROUP_ENTRIES = 500_000
#: begins the key of a special string; no byte-level pre-token can
_SPECIAL = "\x00"


class PreTokens:
    """The library's normaliser, pre-tokeniser and model of one tokenizer file."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip or re.search(r"\s", t.content) for t in added):
            raise ValueError("only plain special strings are known here")
        by_length = sorted((t.content for t in added), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if by_length else None
        self.definition, self.ready = definition, False

    def _plain(self) -> None:
        """Prepares ``split`` and ``split_all`` for chunks of plain characters, ASCII and Latin letters with
        marks: of each, the library says once how it normalises and how it spells its bytes. They do
        not combine with one another, so chunks of them are normalised by character."""
        import regex

        pre_tokenizer = json.loads(self.definition)["pre_tokenizer"]
        split = next((x for x in pre_tokenizer.get("pretokenizers", [pre_tokenizer]) if x["type"] == "Split"), None)
        self.pattern = regex.compile(split["pattern"]["Regex"]) if split else None
        self.lines = regex.compile(split["pattern"]["Regex"] + "|\n") if split else None
        self.normal: dict[int, str] = {}
        self.spelled: dict[int, str] = {}
        for c in map(chr, (*range(0x21, 0x7F), *range(0xC0, 0x180))):
            n = self.tokenizer.normalizer.normalize_str(c)
            pieces = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(n)]
            if self.pattern and len(n) == 1 and len(pieces) == 1 and self.lines.findall(f"{n}\n{n}") == [n, "\n", n]:
                self.normal[ord(c)], self.spelled[ord(n)] = n, pieces[0]
        self.plain = f"[{re.escape(''.join(map(chr, self.normal)))}]+" if self.normal else "[^\\s\\S]"
        self.only_plain = re.compile(self.plain).fullmatch
        self.ready = True

    def split(self, chunk: bytes) -> list[str]:
        """The pre-tokens of a chunk without ASCII white space."""
        if not self.ready:
            self._plain()
        if chunk.isalpha():                 # ASCII letters only: one lower-case pre-token
            return [chunk.lower().decode()]
        out: list[str] = []
        text = chunk.decode()
        if self.only_plain(text) and not (self.special and self.special.search(text)):
            return [p.translate(self.spelled) for p in self.pattern.findall(text.translate(self.normal))]
        parts = self.special.split(text) if self.special else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(_SPECIAL + part)
            elif part:
                normal = self.tokenizer.normalizer.normalize_str(part)
                out += [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def split_all(self, chunks: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(distinct pre-tokens, their numbers, and where each chunk's begin among these and how many
        they are): as ``split``, but plain chunks are normalised and matched together, one to a line."""
        if not self.ready:
            self._plain()
        plain = pc.match_substring_regex(chunks, f"^{self.plain}$")
        if self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring_regex(chunks, self.special.pattern)))
        number_of, plain_ones = numbering(), chunks.filter(plain)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(plain_ones)], pa.int32()), plain_ones),
                              pa.scalar("\n", plain_ones.type))[0].as_py()
        met = numbering()
        met["\n"]                                   # number 0
        found = self.lines.findall(text.translate(self.normal)) if text else []
        numbers = np.fromiter(map(met.__getitem__, found), np.int64, len(found))
        spelled = "\n".join(islice(met, 1, None)).translate(self.spelled).split("\n") if len(met) > 1 else []
        number = np.fromiter(chain([0], map(number_of.__getitem__, spelled)), np.int64, len(met))
        ends = np.append(np.flatnonzero(numbers == 0), len(numbers))[:len(plain_ones)]
        n_plain = np.diff(ends, prepend=-1) - 1
        others = [[number_of[p] for p in self.split(c)] for c in texts(chunks.filter(pc.invert(plain)))]
        plain = plain.to_numpy(zero_copy_only=False)
        sizes = np.zeros(len(chunks), np.int64)
        sizes[plain], sizes[~plain] = n_plain, [len(p) for p in others]
        flat = np.concatenate([number[numbers[numbers > 0]], np.fromiter(chain.from_iterable(others), np.int64)])
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        starts = np.zeros(len(chunks), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return list(number_of), flat, starts, sizes

    def pieces(self, pre_token: str) -> int:
        return 1 if pre_token.startswith(_SPECIAL) else len(self.tokenizer.model.tokenize(pre_token))


def numbering() -> defaultdict:
    """A dictionary that gives each new key the next number."""
    return defaultdict(count().__next__)


def frequencies(documents: list[bytes | None], pre: PreTokens) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct pre-tokens, entries per document, their pre-token numbers, their frequencies)."""
    lists = pc.ascii_split_whitespace(pa.array(documents, pa.large_binary()).cast(pa.large_string()).fill_null(""))
    doc = np.repeat(np.arange(len(documents)), lists.value_lengths().to_numpy(zero_copy_only=False))
    chunks = lists.flatten().dictionary_encode()
    del lists
    pre_tokens, flat, starts, sizes = pre.split_all(chunks.dictionary)
    chunk = chunks.indices.to_numpy(zero_copy_only=False)
    spread = sizes[chunk]                       # each chunk becomes its pre-tokens
    inside = np.arange(int(spread.sum())) - np.repeat(np.cumsum(spread) - spread, spread)
    width = max(1, len(pre_tokens))
    key = np.repeat(doc, spread) * width + flat[np.repeat(starts[chunk], spread) + inside]
    key, total = np.unique(key, return_counts=True)
    return pre_tokens, np.bincount(key // width, minlength=len(documents)), key % width, total


def blocks(docs: DataFrame, definition: str, id_col: str, text: str, block_bytes: int) -> DataFrame:
    """A row per block: ids and n_bytes of its texts, entries per text, packed tokens (differences
    of the ascending pre-token numbers of a text) and times, and the block's pre_tokens and
    their number."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(source.schema[0].dataType)),
        T.StructField("n_bytes", T.ArrayType(T.LongType())), T.StructField("entries", T.ArrayType(T.IntegerType())),
        T.StructField("tokens", T.BinaryType()), T.StructField("times", T.BinaryType()),
        T.StructField("pre_tokens", T.BinaryType()), T.StructField("n_pre_tokens", T.LongType())])

    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, first, made = PreTokens(definition), TaskContext.get().partitionId() << 32, 0
        ids: list = []
        held: list[bytes | None] = []
        size = 0

        def block() -> pa.RecordBatch:
            words, entries, tokens, times = frequencies(held, pre)
            ends = np.cumsum(entries)
            steps = np.diff(tokens, prepend=0)
            begins = (ends - entries)[entries > 0]
            steps[begins] = tokens[begins]
            row = [first + made, ids, [len(t or b"") for t in held], entries.tolist(), pack(steps), pack(times),
                   pack_words(words), len(words)]
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, arrow)], names=names)

        arrow = None
        for batch in batches:
            arrow = arrow or [pa.int64(), pa.list_(batch.column(0).type), pa.list_(pa.int64()), pa.list_(pa.int32()),
                              *[pa.binary()] * 3, pa.int64()]
            for i, t in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                if held and size + len(t or b"") > block_bytes:
                    yield block()
                    made, size = made + 1, 0
                    ids, held = [], []
                ids.append(i)
                held.append(t)
                size += len(t or b"")
        if held:
            yield block()

    return written(source.mapInArrow(run, schema), "token-blocks")


def piece_counts(found: DataFrame, definition: str, group_entries: int) -> DataFrame:
    """(block, numbers, pieces): of every block, the pieces of each pre-token, in parts."""
    total = found.select(F.sum("n_pre_tokens")).first()[0] or 0
    groups = max(1, math.ceil(total / group_entries))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = unpack_words(words.as_py())
                part = np.fromiter((zlib.crc32(w.encode()) % groups for w in words), np.int64, len(words))
                order = np.argsort(part, kind="stable")
                for p, numbers in zip(*_runs(part[order], order)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p], pa.int64()), pa.array([b], pa.int64()), pa.array([pack(np.diff(numbers, prepend=0))]),
                         pa.array([pack_words([words[k] for k in numbers.tolist()])])],
                        names=["part", "block", "numbers", "words"])

    def count_once(table: pa.Table) -> pa.Table:
        pre, known, pieces = PreTokens(definition), {}, []
        for row in table["words"]:
            out = []
            for w in unpack_words(row.as_py()):
                n = known.get(w)
                if n is None:
                    n = known[w] = pre.pieces(w)
                out.append(n)
            pieces.append(pack(np.array(out, np.int64)))
        return pa.table({"block": table["block"], "numbers": table["numbers"], "pieces": pa.array(pieces, pa.binary())})

    dealt = found.select("block", "pre_tokens").mapInArrow(
        deal, "part long, block long, numbers binary, words binary")
    return dealt.groupBy("part").applyInArrow(count_once, "block long, numbers binary, pieces binary")


def _runs(sorted_keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    keys, at = np.unique(sorted_keys, return_index=True)
    return keys.tolist(), np.split(values, at[1:]) if len(keys) else []


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text",
                 block_bytes: int = BLOCK_BYTES, group_entries: int = GROUP_ENTRIES) -> DataFrame:
    """(id, n_bytes, n_tokens) per row of ``docs``, for a tokenizers file whose pre-tokens hold no
    white space (byte-level pre-tokens of a split that drops it)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    found = blocks(docs, definition, id_col, text, block_bytes)
    counts = piece_counts(found, definition, group_entries)
    id_type = found.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def total(block: pa.Table, parts: pa.Table) -> pa.Table:
        pieces = np.zeros(block["n_pre_tokens"][0].as_py(), np.int64)
        for numbers, n in zip(parts["numbers"], parts["pieces"]):
            pieces[np.cumsum(unpack(numbers.as_py()))] = unpack(n.as_py())
        flat = {c: block[c].combine_chunks().flatten() for c in ("ids", "n_bytes", "entries")}
        entries = flat["entries"].to_numpy()
        steps, times = unpack(block["tokens"][0].as_py()), unpack(block["times"][0].as_py())
        owner = np.repeat(np.arange(len(entries)), entries)
        run = np.cumsum(steps, dtype=np.int64)
        begins = np.cumsum(entries) - entries
        before = np.where(begins > 0, run[np.maximum(begins - 1, 0)] if len(run) else 0, 0)
        tokens = run - before[owner]                    # differences back to numbers
        sums = np.bincount(owner, weights=pieces[tokens] * times, minlength=len(entries)).astype(np.int64)
        return pa.table({"id": flat["ids"], "n_bytes": flat["n_bytes"], "n_tokens": sums})

    return found.drop("pre_tokens").groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(total, schema)


ship_with_tasks(__name__)
