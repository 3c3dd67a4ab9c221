"""Bounded-space online packing (operator 2).

Each partition keeps a fixed number of open windows. A document's tokens are cut into full windows
and a rest; the rest goes where it fits best. When it fits nowhere, the fullest window is emitted:
as it is if little room is left, else filled with the head of the piece, which may be cut. Windows
still open at the end of a partition are leftovers; these are merged, in groups whose number grows
with them, by the same rule, and last of all once more.
"""

from __future__ import annotations

import itertools
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import Scratch, blocks, given_back, kept

#: Windows open at a time in a partition; leftover windows that one merging task gets (many more than it leaves open).
OPEN, MERGE_WINDOWS = 64, 2048
#: A sequence's id has the merging turn, the partition and a number in it, from the highest bits down.
TURN_BIT, PARTITION_BIT, PARTITIONS = 59, 35, 1 << 24
#: Texts of about so many characters are encoded at once.
BLOCK_CHARS = 1_000_000
#: A window with at most this much room is emitted as it is.
ROOM = 16


class Packer:
    """Places pieces; ``emit(window)`` gets each window's pieces (key, start, length) when it closes."""

    def __init__(self, size: int, open_windows: int, emit: Callable[[list], None], room: int = ROOM):
        self.size, self.most, self.emit, self.room = size, open_windows, emit, room
        self.windows: list[tuple[int, list]] = []  # (tokens in it, pieces)

    def add(self, key, start: int, length: int) -> None:
        while length >= self.size:  # full windows need no place
            self.emit([(key, start, self.size)])
            start, length = start + self.size, length - self.size
        while length:
            fits = [i for i, (used, _) in enumerate(self.windows) if used + length <= self.size]
            if fits:
                i = max(fits, key=lambda i: self.windows[i][0])
                used, pieces = self.windows[i]
                pieces.append((key, start, length))
                if used + length == self.size:
                    self.emit(self.windows.pop(i)[1])
                else:
                    self.windows[i] = (used + length, pieces)
                return
            if len(self.windows) < self.most:
                self.windows.append((length, [(key, start, length)]))
                return
            i = max(range(len(self.windows)), key=lambda i: self.windows[i][0])
            used, pieces = self.windows.pop(i)
            left = self.size - used
            if left > self.room:
                pieces.append((key, start, left))
                start, length = start + left, length - left
            self.emit(pieces)

    def rest(self) -> list[list]:
        out, self.windows = [p for _, p in self.windows], []
        return out


class ByteBpe:
    """Ids of texts as little-endian unsigned 32-bit bytes, by ``tokenizers``, word by word.

    The pre-tokenizer always cuts before a single space that a character other than white space
    follows, so that such parts can be encoded by themselves and remembered (in a bounded cache).
    Strings of special tokens in a text are ordinary text.

    New words of Latin letters or digits with ASCII marks after these, or two such with a line feed
    between, are encoded many in one string, by ``plain``, which has no pattern: the pattern would cut
    before spaces and marks and around the line feed, but no token reaches over such a place, so its
    cuts change nothing. (A vocabulary with such a token gets the pattern for all words.) The words'
    first tokens, and no others, begin with a space and so tell the words apart.
    """

    #: Words known at a time in each of two generations; a word of the older one that comes again moves to the younger.
    CACHE = 300_000
    #: Words in one string.
    JOINED = 100
    #: Up to U+024F all are letters from U+00C0 on, but for two signs. An apostrophe is no mark here.
    LETTERS, MARKS = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F", r"!-&(-/:-@\[-`{-~"
    PLAIN = rf"(?:[{LETTERS}]+|[0-9]+)[{MARKS}]*"
    #: In the vocabulary's spelling of bytes, U+0120 is the space and U+010A the line feed; OF are digits and the bytes of LETTERS.
    OF = r"A-Za-z0-9\u00C3-\u00C9\u00A1-\u00BF\u0122-\u0143"
    #: Tokens over a place where the pattern cuts plain words.
    OVER = rf"(?=[{OF}{MARKS}\u0120\u010A]+\Z).*(?:[^\u0120]\u0120|[{OF}][{MARKS}\u010A]|[{MARKS}]\u010A|\u010A[{OF}])"

    def __init__(self, path: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.plain = Tokenizer.from_file(path)
        self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain.encode_special_tokens = True
        self.leads = np.zeros(self.tokenizer.get_vocab_size(), bool)  # by id: whether a token begins with a space
        self.leads[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
        over = any(map(re.compile(self.OVER).match, self.tokenizer.get_vocab(with_added_tokens=False)))
        self.known: dict[str, bytes] = {}  # of words with a space before them
        self.older: dict[str, bytes] = {}
        self.cut = re.compile(r" (?=\S)")
        self.is_plain = re.compile(rf"{self.PLAIN}(?:\n{self.PLAIN})?" if not over else r"(?!)").fullmatch

    def ids(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> None:
        is_plain = self.is_plain
        plain = [w for w in new if is_plain(w)]
        joined = [" " + " ".join(plain[i : i + self.JOINED]) for i in range(0, len(plain), self.JOINED)]
        if joined:
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.plain.encode_batch_fast(joined, add_special_tokens=False)])
            at, raw = (4 * np.flatnonzero(self.leads[ids])).tolist(), ids.tobytes()
            self.known.update(zip(plain, [raw[i:j] for i, j in zip(at, [*at[1:], len(raw)])], strict=True))
        if len(plain) < len(new):
            others = [w for w in new if w not in self.known]
            self.known.update(zip(others, self.ids([" " + w for w in others])))

    def odd(self, words: pa.LargeStringArray) -> np.ndarray:
        """Which words are empty or begin with white space; a look at first bytes leaves few to ask."""
        _, offsets, data = words.buffers()
        ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
        out = ends[1:] == ends[:-1]
        full = np.flatnonzero(~out)
        lead = np.frombuffer(data or b"", np.uint8)[ends[full]]
        for i in full[(lead < 33) | (np.isin(lead, (0xC2, 0xE1, 0xE2, 0xE3)))].tolist():  # others begin no white space
            out[i] = words[i].as_py()[0].isspace()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Texts are split, and the ids of their words gathered, by Arrow; Python sees each different word of a block once."""
        def numbered(words: pa.ListArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
            """Where each text's words begin, the different words, and all words as numbers of these."""
            starts, coded = words.offsets.to_numpy(), words.flatten().dictionary_encode()
            return starts - starts[0], coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)

        if len(self.known) > self.CACHE:
            self.older, self.known = self.known, {}
        words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        starts, different, at = numbered(words)
        odd = self.odd(different)[at]  # the pattern doesn't cut there
        odd[starts[:-1]] = False
        if odd.any():
            own = np.unique(np.searchsorted(starts, np.flatnonzero(odd), "right") - 1)
            place = np.arange(len(texts))
            place[own] = len(texts) + np.arange(len(own))
            cut = pa.array([self.cut.split(texts[i]) for i in own], words.type)
            starts, different, at = numbered(pa.concat_arrays([words, cut]).take(pa.array(place)))
        different = different.to_numpy(zero_copy_only=False).tolist()
        first, later = starts[:-1], np.ones(len(at), bool)
        later[first] = False
        heads = self.ids([different[i] for i in at[first]])
        needed = np.zeros(len(different), bool)
        needed[at[later]] = True
        at[first] = len(different) + np.arange(len(texts))
        ids = list(map(self.known.get, different))
        new = {different[i]: i for i, found in enumerate(ids) if found is None and needed[i]}
        again = {w: self.older[w] for w in filter(self.older.__contains__, new)}
        self.known.update(again)
        self.learn([w for w in new if w not in again])
        for w, i in new.items():
            ids[i] = self.known[w]
        gathered = pa.array(ids + heads, pa.large_binary()).take(pa.array(at))
        _, offsets, data = gathered.buffers()
        ends = np.frombuffer(offsets, np.int64)[starts].tolist()
        return [data.slice(i, j - i).to_pybytes() if i < j else b"" for i, j in itertools.pairwise(ends)]


def encoder(tokenizer: str) -> Callable[[list[str]], list[bytes]]:
    """One encoder for each worker process and file: its vocabulary and known words serve all tasks."""
    return kept(f"bpe {tokenizer}", lambda: ByteBpe(tokenizer)).encode


def first_id(turn: int, partition: int) -> int:
    if turn > 15 or partition >= PARTITIONS:
        raise ValueError(f"no sequence ids for partition {partition} of turn {turn}")
    return (turn << TURN_BIT) | (partition << PARTITION_BIT)


#: A piece: ids are little-endian unsigned 32-bit. closed: its sequence is complete.
def piece_schema(id_type: T.DataType, id_col: str) -> T.StructType:
    return T.StructType([T.StructField(id_col, id_type), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("closed", T.BooleanType()), T.StructField("ids", T.BinaryType())])


class Out:
    """Collects pieces and turns them into Arrow batches."""

    def __init__(self, schema, first: int):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.arrow, self.next, self.rows = to_arrow_schema(schema), first, []

    def window(self, pieces, closed: bool) -> None:
        """pieces: (document, start, length) with document = (id, tokens, ids, its first id's place in ids)."""
        offset = 0
        for (key, total, ids, base), start, length in pieces:
            at = 4 * (start - base)
            self.rows.append((key, start, length, total, self.next, offset, closed, ids[at : at + 4 * length]))
            offset += length
        self.next += 1

    def batches(self, at_least: int = 2000) -> Iterator[pa.RecordBatch]:
        if self.rows and len(self.rows) >= at_least:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*self.rows), self.arrow)], names=self.arrow.names)
            self.rows = []


def pack_texts(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, size: int, open_windows: int) -> DataFrame:
    """First pass: pieces of all documents; those of windows left open at a partition's end are not closed."""
    schema = piece_schema(docs.schema[id_col].dataType, id_col)

    def run(batches):
        from pyspark import TaskContext

        encode, out = encoder(tokenizer), Out(schema, first_id(0, TaskContext.get().partitionId()))
        packer = Packer(size, open_windows, lambda pieces: out.window(pieces, True))
        end = b"\0\0\0\0"  # the id after each document
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in blocks(texts, BLOCK_CHARS):
                for key, ids in zip(keys[i:j], encode([t or "" for t in texts[i:j]])):
                    ids += end
                    packer.add((key, len(ids) // 4, ids, 0), 0, len(ids) // 4)
                yield from out.batches()
        for pieces in packer.rest():
            out.window(pieces, False)
        yield from out.batches(1)
        given_back()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def merge(pieces: DataFrame, id_col: str, size: int, open_windows: int, turn: int, last: bool) -> DataFrame:
    """Packs the pieces of open windows anew, in each partition; at the last merge all windows close."""
    schema = pieces.schema

    def run(batches):
        from pyspark import TaskContext

        out = Out(schema, first_id(turn, TaskContext.get().partitionId()))
        packer = Packer(size, open_windows, lambda p: out.window(p, True))
        for batch in batches:
            for row in batch.to_pylist():
                packer.add((row[id_col], row["doc_tokens"], row["ids"], row["start"]), row["start"], row["length"])
            yield from out.batches()
        for p in packer.rest():
            out.window(p, last)
        yield from out.batches(1)

    return pieces.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, open_windows: int = OPEN) -> DataFrame:
    """One row for each piece: id, start, length, doc_tokens, sequence_id, offset, ids (binary).

    A document is its tokens and a final id 0; null counts as empty, so every row of ``docs`` has at
    least one piece. Repeated rows are packed each for itself. Sequences hold at most ``size`` ids,
    their pieces lie without gaps from offset 0. An empty table gives an empty result. Extra columns
    don't matter. ``tokenizer`` is the path of a byte-level tokenizers file.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    first = scratch.table(pack_texts(docs, tokenizer, id_col, text_col, size, open_windows), "pass-0")
    parts, turn = [first.where("closed")], 1
    left = first.where("not closed")
    while True:
        groups = -(-left.where("offset = 0").count() // max(MERGE_WINDOWS, 2 * open_windows))  # each window has one piece at offset 0
        # pieces of a window stay together and in order; the order of windows is that of their ids
        dealt = left.repartition(groups, "sequence_id").coalesce(groups) if groups > 1 else left.coalesce(1)
        dealt = dealt.sortWithinPartitions("sequence_id", "offset")
        merged = scratch.table(merge(dealt, id_col, size, open_windows, turn, groups <= 1), f"pass-{turn}")
        parts.append(merged.where("closed"))
        if groups <= 1:
            break
        left, turn = merged.where("not closed"), turn + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("closed")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
