"""Token ids in flat binary files with 64-bit document offsets.

Documents are range-partitioned and sorted by id; each task encodes its range and
writes, in the shared folder,

- ``part-NNNNN.bin``  the ids one after the other, little-endian, 16 bits if the
  vocabulary fits and 32 otherwise;
- ``part-NNNNN.len``  the number of ids of every document (64 bits);
- ``part-NNNNN.doc``  the documents' ids (Arrow file).

The parts' totals are summed up in part order; such a prefix sum is the base of a part,
and a second pass writes ``part-NNNNN.idx``, the position of every document's first id
in the whole corpus and the end of the last. Files are written under a temporary name
and renamed, so a task that runs again replaces its own files with the same bytes.
Readers map the files into memory.

Encoding takes the strings of the tokenizer's added tokens out of a text first, as the library
does, then cuts before every single space between two other characters (a token
always starts there). The words of a group of texts are numbered (Arrow's dictionary encoding), each distinct
one is looked up in a cache of ids once, and the texts' ids are gathered by those numbers. Words not yet
known go through the vectorised pre-tokeniser and the library's merge model.

Defined cases: a null text is empty and has the end id only; null ids come first;
repeated ids stand in order of the first HEAD_CHARS characters of their text, null first, then of its
hash; a text of any length is one document; no rows give no files; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import functools
import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelens.llm import bpe
from hirelens.llm.common import batches, map_arrow, staged
from hirelens.session import work_path

#: Characters of a text that order rows with the same id.
HEAD_CHARS = 64
#: Entries of the caches of a Python worker. Full, the pieces start anew and the words become
#: the older ones, which are kept until the words are full again.
PIECES = 100_000
WORDS = 300_000
#: Bytes of text whose words are numbered together.
WORD_GROUP = 8 << 20


def byte_letters() -> list[str]:
    """The printable stand-ins for bytes in byte-level vocabularies, by their rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _strings(a: pa.Array) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Ids of whole texts as bytes, as the tokenizers library gives them for a byte-level BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        self.model = tok.model
        self.width = 2 if tok.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.code = {2: "H", 4: "I"}[self.width]
        self.letters = {i: c for i, c in enumerate(byte_letters())}
        self.space = self.letters[0x20]
        self.coded = [i.to_bytes(self.width, "little") for i in range(max(tok.get_vocab().values()) + 1)]
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}       # of what follows a single space
        self.older: dict[str, bytes] = {}       # the words before these
        self.tails = {p: self._merged(p) for p in ".,|"}
        held = tok.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip for t in held.values()):
            raise ValueError("added tokens that take white space or whole words are not supported")
        self.added = {t.content: array(self.code, [i]).tobytes() for i, t in held.items()}
        longest = sorted(self.added, key=len, reverse=True)     # of those that start at one place
        self.at_added = re.compile("(" + "|".join(map(re.escape, longest)) + ")")

    def _merged(self, p: str) -> bytes:
        if p.isascii() and p[0] == " " and p[1:].isalpha():
            letters = self.space + p[1:]                # printable ASCII stands for itself
        else:
            letters = p.encode("utf-8", "replace").decode("latin-1").translate(self.letters)
        coded = self.coded
        return b"".join([coded[t.id] for t in self.model.tokenize(letters)])

    def _piece(self, p: str) -> bytes:
        got = self.pieces.get(p)
        if got is None:
            got = self._merged(p)
            if len(p) <= bpe.CACHED_CHARS:
                if len(self.pieces) > PIECES:
                    self.pieces.clear()
                self.pieces[p] = got
        return got

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [b"".join(map(self._piece, pieces)) for pieces in bpe.slices(texts)]

    def _ids_of(self, words: list[str]) -> list[bytes | None]:
        """Ids of distinct words after a space, from the cache or merged; None for those that must not be cut off.

        A piece next to more white space belongs to it: its text is encoded as a whole.
        """
        if len(self.words) > WORDS:
            self.older, self.words = self.words, {}     # what is still in use comes back from there
        known, older, merged, tails = self.words, self.older, self._merged, self.tails
        out, rest = list(map(known.get, words)), []
        for k in [k for k, got in enumerate(out) if got is None]:
            p = words[k]
            got = older.get(p)
            if got is None:
                if p.isalpha():
                    got = known.get(p)          # a word before a mark may have brought it
                    if got is None:
                        got = merged(f" {p}")
                elif not p or p[0].isspace() or p[-1].isspace():
                    continue
                elif p[-1] in tails and p[:-1].isalpha():
                    w = p[:-1]                  # letters after a space are one piece, the mark another
                    got = known.get(w) or older.get(w)
                    if got is None:
                        got = merged(f" {w}")
                    known[w] = got
                    got += tails[p[-1]]
                else:
                    rest.append(k)
                    continue
            known[p] = out[k] = got
        for k, got in zip(rest, self._whole([f" {words[k]}" for k in rest])):
            known[words[k]] = out[k] = got
        return out

    def _with_added(self, text: str) -> bytes:
        parts = self.at_added.split(text)               # text, added token, text, ...
        plain = iter(self._whole(parts[::2]))
        return b"".join(self.added[x] if i % 2 else next(plain) for i, x in enumerate(parts))

    def gathered(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts (no nulls) one after the other, each text's followed by ``end``, and how many are each text's."""
        n = len(texts)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        cut = pc.split_pattern(texts, " ")              # never empty: what stands before the first space comes first
        edges = cut.offsets.to_numpy().astype(np.int64)
        edges -= edges[0]
        first, words = edges[:-1], cut.flatten()
        heads = _strings(words.take(pa.array(first)))
        later = np.ones(len(words), bool)
        later[first] = False
        of_text = np.repeat(np.arange(n), np.diff(edges) - 1)
        coded = words.filter(pa.array(later)).dictionary_encode()
        number = coded.indices.to_numpy(zero_copy_only=False)
        found = self._ids_of(_strings(coded.dictionary))
        unsafe = np.fromiter((x is None for x in found), bool, len(found))

        whole = np.zeros(n, bool)
        whole[of_text[unsafe[number]]] = True
        whole |= (np.diff(edges) > 1) & np.fromiter((not h or h[-1].isspace() for h in heads), bool, n)
        added = np.zeros(n, bool)
        for token in self.added:
            added |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        starts: list[bytes] = [b""] * n                 # ids of the head, or of a text that is not cut
        for at, encode in ((np.flatnonzero(added), lambda ts: [self._with_added(t) for t in ts]),
                           (np.flatnonzero(whole & ~added), self._whole)):
            for k, ids in zip(at.tolist(), encode(_strings(texts.take(pa.array(at))))):
                starts[k] = ids
        whole |= added
        at = np.flatnonzero(~whole).tolist()
        for k, ids in zip(at, self._whole([heads[k] for k in at])):
            starts[k] = ids

        # every text's entries: its start, its words unless the start is all of it, the end
        entries = [*(x or b"" for x in found), *starts, end]
        keep = ~whole[of_text]
        number, of_text = number[keep].astype(np.int64), of_text[keep]
        held = np.bincount(of_text, minlength=n)
        place = np.cumsum(held + 2) - held - 2          # of every text's start
        order = np.empty(len(number) + 2 * n, np.int64)
        order[place] = len(found) + np.arange(n)
        order[place + held + 1] = len(entries) - 1
        order[np.arange(len(number)) + 2 * of_text + 1] = number
        sizes = np.fromiter(map(len, entries), np.int64, len(entries)) // self.width
        flat, begin = np.frombuffer(b"".join(entries), self.dtype), np.cumsum(sizes) - sizes
        taken = sizes[order]
        counts = np.add.reduceat(taken, place)
        shift = np.repeat(begin[order] - (np.cumsum(taken) - taken), taken)
        shift += np.arange(len(shift))
        return flat[shift], counts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts. The strings of added tokens are cut out first; each is its own id."""
        ids, counts = self.gathered(pa.array(texts, pa.large_string()))
        data, ends = ids.tobytes(), (np.cumsum(counts) * self.width).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _put(path: str, data: bytes) -> None:
    fs, where = pafs.FileSystem.from_uri(path)
    fs.create_dir(where.rpartition("/")[0], recursive=True)
    tmp = f"{where}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(tmp) as f:
        f.write(data)
    fs.move(tmp, where)


def mapped(path: str, dtype) -> np.ndarray:
    """A flat file as an array: mapped into memory, or read where that is not possible."""
    fs, where = pafs.FileSystem.from_uri(path)
    if not fs.get_file_info(where).size:
        return np.zeros(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(where, dtype, "r")
    with fs.open_input_file(where) as f:
        return np.frombuffer(f.read(), dtype)


def _part(folder: str, part: int, kind: str) -> str:
    return f"{folder}/part-{part:05d}.{kind}"


def write(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
          folder: str | None = None) -> tuple[str, DataFrame]:
    """Write the files; the folder and its manifest (part, docs, tokens, base), base from prefix sums."""
    spark = docs.sparkSession
    folder = folder or work_path(spark, "llm", f"tokens-{uuid.uuid4().hex}")
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    head, tie = F.substring("_text", 1, HEAD_CHARS), F.monotonically_increasing_id()
    ordered = source.withColumns({"_head": head, "_hash": F.xxhash64("_text"), "_tie": tie})
    keys = ["_id", "_head", "_hash", "_tie"]        # rows equal in id and text spread over parts as well
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys).select("_id", "_text")
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("docs", T.LongType()),
                           T.StructField("tokens", T.LongType())])

    def run(it):
        enc = encoder(tokenizer_path)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype).tobytes()
        counts, ids, tmp = [], [], None
        fs, where = pafs.FileSystem.from_uri(_part(folder, part, "bin"))
        out = None
        for batch in batches(it, "_text", rows=1 << 20, held_bytes=WORD_GROUP):
            if out is None:
                fs.create_dir(where.rpartition("/")[0], recursive=True)
                tmp = f"{where}.{uuid.uuid4().hex}.tmp"
                out = fs.open_output_stream(tmp)
            tokens, sizes = enc.gathered(pc.fill_null(batch.column(1), ""), end)
            out.write(tokens)
            counts.append(sizes.astype("<u8"))
            ids.append(batch.column(0))
        if out is None:
            return
        out.close()
        fs.move(tmp, where)
        n = np.concatenate(counts)
        _put(_part(folder, part, "len"), n.tobytes())
        sink = pa.BufferOutputStream()
        table = pa.table({"id": pa.chunked_array(ids)}).combine_chunks()
        with pa.ipc.new_file(sink, table.schema) as w:
            w.write_table(table)
        _put(_part(folder, part, "doc"), sink.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(n)], pa.int64()),
                                          pa.array([int(n.sum())], pa.int64())], names=schema.names)

    parts = staged(map_arrow(ordered, run, schema), "parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = staged(parts.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long")),
                      "manifest")

    def index(it):
        for batch in it:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = mapped(_part(folder, part, "len"), "<u8")
                starts = np.concatenate([[0], np.cumsum(n, dtype=np.uint64)]).astype("<u8") + np.uint64(base)
                _put(_part(folder, part, "idx"), starts.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], names=["part"])

    done = map_arrow(_each_part(manifest).select("part", "base"), index,
                     T.StructType([T.StructField("part", T.IntegerType())]))
    written, expected = done.count(), manifest.count()
    if written != expected:
        raise RuntimeError(f"{written} of {expected} offset files written")
    return folder, manifest


def _each_part(manifest: DataFrame) -> DataFrame:
    """One part per task, as far as ranges of the part numbers allow."""
    return manifest.repartitionByRange(max(1, manifest.count()), "part")


def read_back(spark: SparkSession, folder: str, manifest: DataFrame, tokenizer_path: str,
              id_type: T.DataType, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the mapped files alone."""
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(it):
        dtype = encoder(tokenizer_path).dtype
        for batch in it:
            for part in batch.column(0).to_pylist():
                idx = mapped(_part(folder, part, "idx"), "<u8").astype(np.int64)
                ids = mapped(_part(folder, part, "bin"), dtype)
                fs, where = pafs.FileSystem.from_uri(_part(folder, part, "doc"))
                with fs.open_input_file(where) as f:
                    docs = pa.ipc.open_file(f).read_all().column("id").combine_chunks()
                local = idx - idx[0]
                for i in range(0, len(docs), 4096):
                    cuts = local[i:i + 4097].tolist()
                    wide = memoryview(np.asarray(ids[cuts[0]:cuts[-1]]).astype("<u4")).cast("B")
                    at = [4 * (c - cuts[0]) for c in cuts]
                    crc = [zlib.crc32(wide[a:b]) for a, b in zip(at, at[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [docs.slice(i, 4096), pa.array(idx[i:i + 4097][:-1]), pa.array(np.diff(idx[i:i + 4097])),
                         pa.array(crc, pa.int64())], names=schema.names)

    return map_arrow(_each_part(manifest).select("part"), run, schema)
