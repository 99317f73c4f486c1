"""Token-ID output: Arrow files of fixed-size-list batches.

A file holds one stream of ids cut into sequences of equal length: column `ids` is a fixed-size list of
unsigned integers, column `mask` a fixed-size list of booleans that are false on the padding of the last
sequence. All record batches but the last hold the same number of sequences, so position p of the stream
lies in batch p // (length * per_batch): a reader maps the file and takes any sequence or span of ids
without copying. Files are in the order of the ids of their documents, and so are documents within a file.

Null texts count as empty; an empty text gives the end id alone. Rows with equal ids are ordered by a hash
of their text and then by the text, and each has its own span. An empty table writes no file that holds a
sequence and gives no rows. Other columns are not read.
"""

from __future__ import annotations

import gc
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.llm import common
from recallgrid.llm.common import materialize, scratch_path, shuffle_partitions

LENGTH, PER_BATCH = 2048, 64

#: Words remembered in each of two generations, and the longest one that is.
WORDS, WORD_BYTES = 700_000, 48


#: A run of letters whose case folds one to one, and ASCII marks after it but for the apostrophe, which may belong to a word.
_LETTERS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@[-`{-~]*)").fullmatch


class _Words:
    """Ids, as bytes, of the runs between ASCII blanks that were met lately."""

    def __init__(self, own, kind: np.dtype, suffix: str) -> None:
        from tokenizers import normalizers, pre_tokenizers

        self.own, self.kind = own, kind
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.plain = type(own).from_str(own.to_str())
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(own.get_vocab_size(), bool)
        self.ends[[i for token, i in own.get_vocab().items() if token.endswith(suffix)]] = True

    def _plain(self, words: list[str]) -> None:
        """Learns runs of small letters, which are words already: many of them are encoded as one text, whose ids
        are cut after each token that ends a word."""
        size, known = self.kind.itemsize, self.known
        for a in range(0, len(words), 1024):
            some = words[a : a + 1024]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            data, at = ids.tobytes(), 0
            for word, end in zip(some, ((np.flatnonzero(self.ends[ids]) + 1) * size).tolist(), strict=True):
                known[word.encode()] = data[at:end]
                at = end

    def _rest(self, runs: list[str]) -> None:
        for run, e in zip(runs, self.own.encode_batch_fast(runs, add_special_tokens=False), strict=True):
            self.known[run.encode()] = np.array(e.ids, self.kind).tobytes()

    def _learn(self, new: list[bytes]) -> None:
        """Marks after letters are encoded apart from them, and case is folded before; both leave the ids as they are
        and make for fewer different runs."""
        known, old = self.known, self.old
        kept = list(map(old.get, new))
        known.update((w, ids) for w, ids in zip(new, kept, strict=True) if ids is not None)
        fresh = [w for w, ids in zip(new, kept, strict=True) if ids is None]
        known[b""] = b""
        if not fresh:
            return
        parts, rest, texts = [], set(), b" ".join(fresh).decode()
        texts, folded = texts.split(" "), texts.lower().split(" ")
        for w, text, low, m in zip(fresh, texts, folded, map(_LETTERS, texts), strict=True):
            if m is None:
                rest.add(text)
                continue
            tail = m[2]
            if tail:
                parts.append((w, low[: -len(tail)].encode(), tail.encode()))
                rest.add(tail)
            elif low == text:
                parts.append((w, w, b""))
            else:
                parts.append((w, low.encode(), b""))
        self._plain([r.decode() for r in {core for _, core, _ in parts} if r not in known])
        self._rest([r for r in rest if r.encode() not in known])
        for w, core, tail in parts:
            known[w] = known[core] + known[tail]

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each). Arrow finds the runs and the different ones among them; only
        these are looked up."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        runs = coded.dictionary.cast(pa.binary()).to_pylist()
        ids = list(map(self.known.get, runs))
        new = [w for w, found in zip(runs, ids, strict=True) if found is None]
        if new:
            self._learn(new)
        known = self.known
        ids = [known[w] if found is None else found for w, found in zip(runs, ids, strict=True)]
        for w in new:
            if len(w) > WORD_BYTES:
                known.pop(w, None)
        if len(known) > WORDS:
            self.old, self.known = known, {}
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        flat, start = np.frombuffer(b"".join(ids), self.kind), np.cumsum(size) - size
        at, out, total = coded.indices.to_numpy(), [np.zeros(0, self.kind)], [np.zeros(1, np.int64)]
        for a in range(0, len(at), 1 << 18):
            some = at[a : a + (1 << 18)]
            n = size[some]
            upto = np.cumsum(n)
            out.append(flat[np.repeat(start[some] - upto + n, n) + np.arange(upto[-1])])
            total.append(upto + total[-1][-1])
        ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        return np.concatenate(out), np.diff(np.concatenate(total)[ends])


class _Whole:
    """Ids, as bytes, of texts that the library encodes one by one."""

    def __init__(self, own, kind: np.dtype) -> None:
        self.own, self.kind = own, kind

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(e.ids, self.kind) for e in self.own.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.zeros(0, self.kind), *ids]), np.array([len(x) for x in ids], np.int64)


def _by_words(own) -> str:
    """The suffix that ends words, if the file's normaliser and splitter treat the runs between ASCII blanks
    apart and letters as words, as encoding by words needs; else nothing."""
    plan = json.loads(own.to_str())
    steps = ((plan["normalizer"] or {}).get("normalizers") or []) if plan["normalizer"] else []
    split = ((plan["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    fit = {x["type"] for x in steps} <= {"NFC", "Replace", "Lowercase"} and {"type": "Lowercase"} in steps and all(x.get("pattern", {}).get("Regex") == r"\s+" for x in steps if x["type"] == "Replace")
    fit &= split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"] and r"|[\p{L}]+|" in split["pattern"].get("Regex", "") and r"[^\s\p{L}\p{N}]+" in split["pattern"].get("Regex", "")
    return (plan["model"].get("end_of_word_suffix") or "") if fit and plan["model"]["type"] == "BPE" else ""


_encoders: dict[str, tuple[_Words | _Whole, np.dtype]] = {}


def encoder(path: str) -> tuple[_Words | _Whole, np.dtype]:
    """The tokenizers library's encoder of a file. Where its normaliser and splitter never look across an ASCII
    blank, the ids of a text are those of the runs between blanks, in order, and runs are remembered.
    The ids take the narrowest unsigned type that holds the vocabulary."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        gc.set_threshold(100_000, 50, 1000)  # the tables are large and hold no garbage
        own = Tokenizer.from_file(path)
        kind = np.dtype("<u2") if own.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        suffix = _by_words(own)
        _encoders[path] = (_Words(own, kind, suffix) if suffix else _Whole(own, kind)), kind
    return _encoders[path]


class Writer:
    """Writes one stream of ids; the file appears under its name when it is complete."""

    def __init__(self, folder: str, name: str, kind: np.dtype, length: int = LENGTH, per_batch: int = PER_BATCH) -> None:
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder)
        self.name, self.kind, self.length, self.per_batch = name, kind, length, per_batch
        self.temp = f"{self.folder}/_{name}.{uuid.uuid4().hex}"
        item = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(pa.field("item", item, False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), length))])
        self.sink = self.fs.open_output_stream(self.temp)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.waiting = self.total = 0

    def add(self, ids: np.ndarray) -> int:
        """The position at which these ids start in the stream."""
        at, n = self.total, len(ids)
        self.held.append(ids)
        self.total += n
        self.waiting += n
        if self.waiting >= self.length * self.per_batch:
            self._flush(self.length * self.per_batch)
        return at

    def _flush(self, full: int) -> None:
        ids = np.concatenate(self.held)
        cut = len(ids) - len(ids) % full
        for a in range(0, cut, full):
            self._batch(ids[a : a + full], full)
        self.held, self.waiting = [ids[cut:]], len(ids) - cut

    def _batch(self, ids: np.ndarray, n: int) -> None:
        mask = np.arange(n) < len(ids)
        ids = np.concatenate((ids, np.zeros(n - len(ids), self.kind)))
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((ids, mask), self.schema, strict=True)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.waiting:
            ids = np.concatenate(self.held)
            self._batch(ids, -(-len(ids) // self.length) * self.length)
        self.out.close()
        self.sink.close()
        self.fs.move(self.temp, f"{self.folder}/{self.name}")


class Reader:
    """Random access to a file of sequences; of a local file nothing is copied."""

    def __init__(self, folder: str, name: str) -> None:
        fs, path = pafs.FileSystem.from_uri(folder)
        at = f"{path}/{name}"
        self.file = pa.ipc.open_file(pa.memory_map(at) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(at))
        self.length = self.file.schema.field("ids").type.list_size
        self.per_batch = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self._last: tuple[int, np.ndarray] = (-1, np.zeros(0))

    def _ids(self, batch: int) -> np.ndarray:
        if self._last[0] != batch:
            self._last = (batch, self.file.get_batch(batch).column(0).flatten().to_numpy())
        return self._last[1]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of sequence i."""
        batch = self.file.get_batch(i // self.per_batch).slice(i % self.per_batch, 1)
        return batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False)

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids [start, start + n) of the stream, in views of one batch each."""
        full = self.length * self.per_batch
        while n:
            ids = self._ids(start // full)[start % full :][:n]
            yield ids
            start, n = start + len(ids), n - len(ids)


def write(docs: DataFrame, folder: str, path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, appends end_id, and writes the ids in ascending order of id_col, a file for
    each range of ids. Returns the index (part, file, id, start in the file's stream, n_tokens). A task that
    runs again writes the same file again."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(text_col, F.lit("")).alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    rows = rows.repartitionByRange(shuffle_partitions(spark), id_col, "_tie").sortWithinPartitions(id_col, "_tie", "_text").select(id_col, "_text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("token_files", _encoders.clear)
        own, kind = encoder(path)
        end = np.array([] if end_id is None else [end_id], kind)
        part, out = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            name = f"part-{part:06d}.arrow"
            out = out or Writer(folder, name, kind)
            for a in range(0, batch.num_rows, 1024):
                some = batch.slice(a, 1024)
                ids, sizes = own.of(some.column(1))
                if len(end):
                    ids, sizes = np.insert(ids, np.cumsum(sizes), end[0]), sizes + 1
                starts, n = out.add(ids) + np.cumsum(sizes) - sizes, len(sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array([name] * n), some.column(0), pa.array(starts), pa.array(sizes)], ["part", "file", id_col, "start", "n_tokens"])
        if out:
            out.close()

    kind = docs.schema[id_col].dataType.simpleString()
    return materialize(rows.mapInArrow(run, f"part int, file string, `{id_col}` {kind}, start long, n_tokens long"), "token-index")


def read_digests(index: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, its ids read back from the files; start counts the
    ids of all files before, from one row for each file."""
    sizes = index.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = sizes.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            found = []
            for file, start, n in zip(*(batch.column(k).to_pylist() for k in ("file", "start", "n_tokens")), strict=True):
                if file != name:
                    name, reader = file, Reader(folder, file)
                crc = 0
                for ids in reader.span(start, n):
                    crc = zlib.crc32(ids.astype("<u4"), crc)
                found.append(crc)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("part", id_col, "start", "n_tokens")), pa.array(found, pa.int64())], ["part", id_col, "start", "n_tokens", "ids_crc32"])

    kind = index.schema[id_col].dataType.simpleString()
    found = index.select("part", "file", id_col, "start", "n_tokens").mapInArrow(run, f"part int, `{id_col}` {kind}, start long, n_tokens long, ids_crc32 long")
    return found.join(before, "part").select(id_col, (F.col("_before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def written_digests(docs: DataFrame, path: str, folder: str | None = None, **columns: str) -> DataFrame:
    """Writes the files into a new shared folder (or `folder`) and reads every document back from them."""
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    return read_digests(write(docs, folder, path, **columns), folder, columns.get("id_col", "doc_id"))
