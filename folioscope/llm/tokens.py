"""Token ids in Arrow files: equal-length sequences and masks, read without copying.

Documents are encoded in ascending order of their ids, each closed by an end
token, and packed end to end into sequences of seq_len tokens. A dataset is one
pair of Arrow IPC files for each range of ids:

    part-*.arrow       record batches of two fixed-size lists, input_ids (the
                       narrowest unsigned integer that holds the vocabulary)
                       and mask (bits; false where the last sequence is padded)
    part-*.docs.arrow  doc_id, start (in this part) and n_tokens of each document

Sequence i is batch i // rows, list i % rows: an offset into a memory map.
Every attempt of a task writes files of its own names and the driver's manifest
lists those of the attempts that succeeded, so lost executors leave no doubt.

Cases: a null text is empty and gives the end token alone; null ids come first;
rows that share an id are all kept, ordered by a hash of the text; an empty
table gives no parts and no rows.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import filterfalse
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import array_slices, shared_path, small_batches, tidied


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The piece that stands for a text's end.
LAST = "\x01end"


def byte_signs() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 itself, then from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """A byte-level BPE tokenizer with a bounded memory of what pieces encode to.

    Its pre-tokenizer puts a single space to the word on its right and keeps a
    single line feed by itself. So a text in which no white space stands but
    single spaces and line feeds between words falls into pieces (a word, with
    its space if it has one) that encode by themselves; letters and the marks
    after them do so too. New pieces of letters go to the model many at a time,
    their pre-tokenization known. Texts with other white space or with added
    tokens are encoded whole. The memory has two generations of MOST pieces, so
    what is frequent stays; None marks a piece that needs its whole text.
    """

    MOST, MARKS = 180_000, "!#$%&*+,./:;=?@|~-_)]}>"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        spec = json.loads(self.whole.to_str())
        pre, feed = spec.get("pre_tokenizer") or {}, self.ids("\n")
        self.by_piece = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and len(feed) == 1
        if self.by_piece:
            self.signs = byte_signs()
            self.letters = Tokenizer.from_file(path)
            self.letters.pre_tokenizer = Split(self.signs[10], "isolated")
            self.feed = feed[0]
        self.memo: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype)

    def _encoded(self, pieces: list[str], by_letters: bool) -> Iterator[tuple[str, bytes]]:
        """Ids of pieces without line feeds."""
        step = 1024 if by_letters else 256
        for k in range(0, len(pieces), step):
            part = pieces[k : k + step]
            text = "\n".join(part) + "\n"
            if by_letters:
                text = text.encode().decode("latin-1").translate(self.signs)
                ids = np.array(self.letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            else:
                ids = self.ids(text)
            ends = np.flatnonzero(ids == self.feed)
            raw, size, start = ids.tobytes(), self.dtype.itemsize, 0
            for p, e in zip(part, (ends * size).tolist(), strict=True):
                yield p, raw[start:e]
                start = e + size

    def _learn(self, new: list[str]) -> None:
        """Put pieces that memo lacks into it."""
        memo, old = self.memo, self.old
        known = list(filter(old.__contains__, new))
        memo.update(zip(known, map(old.__getitem__, known), strict=True))
        letters, others, marked = set(), set(), []
        for p in filterfalse(old.__contains__, new):
            if p.isalpha() or p[1:].isalpha() and p[0] == " ":
                letters.add(p)
                continue
            stem = p.rstrip(self.MARKS)
            if len(stem) > 1 and stem[1:].isalpha() and (stem[0] == " " or stem[0].isalpha()):
                marked.append((p, stem, p[len(stem) :]))
                letters.add(stem)
                others.add(p[len(stem) :])
            elif p in ("", " ") or (p[1:] if p[0] == " " else p).split() != [p.lstrip(" ")]:
                memo[p] = None
            else:
                others.add(p)
        memo.update(self._encoded(list(letters - memo.keys()), True))
        memo.update(self._encoded(list(others - memo.keys()), False))
        memo.update({p: memo[stem] + memo[marks] for p, stem, marks in marked})

    def encode(self, texts: pa.Array, end_id: int) -> tuple[bytes, np.ndarray]:
        """The ids of all texts (null: empty), each with its end, and how many ids each has."""
        texts = texts.fill_null("")
        size, end = self.dtype.itemsize, self.dtype.type(end_id).tobytes()
        if not self.by_piece:
            whole = [self.ids(t).tobytes() + end for t in texts.to_pylist()]
            return b"".join(whole), np.array([len(x) // size for x in whole], np.int64)
        if len(self.memo) > self.MOST:
            self.old, self.memo = self.memo, {}
        memo = self.memo
        memo["\n"], memo[LAST] = self.dtype.type(self.feed).tobytes(), end
        odd = np.zeros(len(texts), bool)
        for mark in ("\x00", LAST, *self.added):
            odd |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        cut = pc.replace_substring(pc.replace_substring(texts, " ", "\x00 "), "\n", "\x00\n\x00")
        cut = pc.split_pattern(pc.binary_join_element_wise(cut, LAST, "\x00"), "\x00")
        coded = cut.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(list(filterfalse(memo.__contains__, pieces)))
        ids = pa.array(list(map(memo.__getitem__, pieces)), pa.binary()).take(coded.indices)
        bounds = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        if ids.null_count:
            none = np.concatenate([[0], np.cumsum(ids.is_null().to_numpy(zero_copy_only=False))])
            odd |= none[bounds[1:]] > none[bounds[:-1]]
        at = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
        data, starts = memoryview(ids.buffers()[2]), at[bounds].astype(np.int64)
        counts = np.diff(starts) // size
        if not odd.any():
            return bytes(data[starts[0] : starts[-1]]), counts
        out, done = [], 0
        for i in np.flatnonzero(odd).tolist():
            whole = self.ids(texts[i].as_py())
            out += [data[starts[done] : starts[i]], whole.tobytes(), end]
            counts[i], done = len(whole) + 1, i + 1
        return b"".join([*out, data[starts[done] : starts[-1]]]), counts


def encoder_for(path: str) -> Encoder:
    """This worker process's encoder, kept from task to task with what it has learnt."""
    kept = sys.modules.setdefault("folioscope_kept", ModuleType("folioscope_kept"))
    if getattr(kept, "encoder_path", None) != path:
        kept.encoder, kept.encoder_path = Encoder(path), path
    return kept.encoder


@dataclass(frozen=True)
class TokenFiles:
    """A written dataset: parts in order, each (file, first token's place, tokens, documents)."""

    folder: str
    seq_len: int
    dtype: str
    parts: tuple[tuple[str, int, int, int], ...]
    id_type: str


def write(docs: DataFrame, folder: str, *, vocabulary: str | None = None, end_id: int = 0, seq_len: int = 1024, rows: int = 256, shards: int | None = None) -> TokenFiles:
    """Encode docs (doc_id, text) and write them to folder, any place pyarrow and Spark both reach."""
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = vocabulary or vocabulary_path()
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    id_type = docs.select("doc_id").schema[0].dataType
    dtype = Encoder(vocabulary).dtype.str

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = encoder_for(vocabulary)
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        shard = TaskContext.get().partitionId()
        name = f"part-{shard:05d}-{uuid.uuid4().hex[:12]}"
        width, item = seq_len * np.dtype(dtype).itemsize, pa.from_numpy_dtype(np.dtype(dtype))
        schema = pa.schema([("input_ids", pa.list_(pa.field("item", item, nullable=False), seq_len)), ("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), seq_len))], {"end_id": str(end_id), "rows": str(rows)})
        at = n_docs = 0
        left: list[bytes] = []
        held = 0

        def batch(data: bytes, tokens: int) -> pa.RecordBatch:
            n = len(data) // width
            ids = pa.Array.from_buffers(item, n * seq_len, [None, pa.py_buffer(data)])
            mask = pa.array(np.arange(n * seq_len) < tokens)
            return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(ids, type=schema.field(0).type), pa.FixedSizeListArray.from_arrays(mask, type=schema.field(1).type)], schema=schema)

        with fs.open_output_stream(f"{root}/{name}.arrow") as f, pa.ipc.new_file(f, schema) as w, fs.open_output_stream(f"{root}/{name}.docs.arrow") as g:
            index = None
            for b in tidied(batches):
                sizes = []
                for texts in array_slices(b.column("text")):
                    x, n = encoder.encode(texts, end_id)
                    left.append(x)
                    sizes.append(n)
                    held += len(x)
                    if held >= width * rows:
                        data, left = b"".join(left), []
                        full = len(data) - len(data) % (width * rows)
                        for k in range(0, full, width * rows):
                            w.write_batch(batch(data[k : k + width * rows], rows * seq_len))
                        left, held = [data[full:]], len(data) - full
                counts = np.concatenate([np.empty(0, np.int64), *sizes])
                starts = at + np.cumsum(counts) - counts
                part = pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(starts), pa.array(counts)], names=["doc_id", "start", "n_tokens"])
                index = index or pa.ipc.new_file(g, part.schema)
                index.write_batch(part)
                at, n_docs = at + int(counts.sum()), n_docs + len(counts)
            if held:
                data = b"".join(left)
                w.write_batch(batch(data + bytes(-len(data) % width), len(data) // np.dtype(dtype).itemsize))
            if index:
                index.close()
        if n_docs:
            yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [name], "n": [at], "docs": [n_docs]})

    h = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    ordered = docs.select("doc_id", "text").repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), h).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), h)
    done = sorted(ordered.mapInArrow(put, "shard long, name string, n long, docs long").collect())  # a row for each part
    parts, base = [], 0
    for r in done:
        parts.append((r.name, base, r.n, r.docs))
        base += r.n
    out = TokenFiles(folder, seq_len, dtype, tuple(parts), id_type.simpleString())
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"seq_len": seq_len, "dtype": dtype, "end_id": end_id, "rows": rows, "id_type": out.id_type, "parts": parts}).encode())
    return out


def open_part(folder: str, name: str) -> pa.ipc.RecordBatchFileReader:
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    path = f"{root}/{name}.arrow"
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(path))


def sequence(files: TokenFiles, part: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (a view of the file) and mask of sequence i of a part."""
    reader = open_part(files.folder, files.parts[part][0])
    rows = int(reader.schema.metadata[b"rows"])
    b, k, n = reader.get_batch(i // rows), i % rows, files.seq_len
    ids = b.column(0).values.slice((b.column(0).offset + k) * n, n).to_numpy(zero_copy_only=True)
    return ids, b.column(1).values.slice((b.column(1).offset + k) * n, n).to_numpy(zero_copy_only=False)


def read_documents(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start (in the whole dataset), n_tokens and ids (little-endian 32-bit) of every document."""
    parts, folder = files.parts, files.folder

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidied(batches):
            for k in b.column(0).to_pylist():
                name, base, _, _ = parts[k]
                reader, at, flat, start = open_part(folder, name), 0, np.empty(0, np.uint16), 0
                for d in range((docs := open_part(folder, f"{name}.docs")).num_record_batches):
                    index = docs.get_batch(d)
                    starts, counts = index.column("start").to_numpy(), index.column("n_tokens").to_numpy()
                    first = 0
                    while first < len(counts):  # as many documents at a time as hold some 2 million tokens
                        last = max(first + 1, int(np.searchsorted(starts, starts[first] + 2_000_000)))
                        ids = []
                        for s, n in zip(starts[first:last].tolist(), counts[first:last].tolist(), strict=True):
                            pieces = []
                            while n:
                                if s >= start + len(flat):
                                    start += len(flat)
                                    c = reader.get_batch(at)
                                    m = c.column(1).values.true_count
                                    flat, at = c.column(0).values.to_numpy(zero_copy_only=True)[:m], at + 1
                                    continue
                                x = flat[s - start : s - start + n]
                                pieces.append(x)
                                s, n = s + len(x), n - len(x)
                            ids.append(np.concatenate(pieces).astype("<u4").tobytes())
                        part = index.slice(first, last - first)
                        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(starts[first:last] + base), part.column("n_tokens"), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                        first = last

    schema = f"doc_id {files.id_type}, start long, n_tokens long, ids binary"
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.range(0, len(parts), 1, len(parts)).mapInArrow(get, schema)


def digests(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Write docs, read the files back, and return each document's place, length and checksum."""
    files = write(docs, shared_path(spark, "tokens"), **options)
    return read_documents(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
