"""Token ids of texts, and their patched frame-of-reference files.

Encoding: the tokenizers library encodes pieces of texts that it would never join (it splits before white space, or
drops white space); ids of pieces seen before are taken from a bounded memory of the worker, so a text's ids are
those that the library gives for the whole text.

A file holds the ids of one range of documents as blocks of BLOCK ids. A block stores its minimum; the differences
to it are packed at the width that covers a percentile of them, and those that need more bits go, whole, to an
exception list. The foot has the start of every block and, per document, its id and its number of ids, so that any
document or range can be read without the rest. Files are written under a name of their own task attempt into the
folder all machines share; only the attempts that ended well are listed, so lost executors cost a rewrite of their
ranges and nothing else.

Null and empty texts have no ids besides the end id. Documents with a null id come first; those of equal id are in
order of their texts. Other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_characters, kept, shuffle_partitions, trim

BLOCK = 4096
MAGIC = b"TLOOMPF1"
#: White space as the tokenizers' patterns know it; all but the blank and the line feed.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD = "\t\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RUNS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: A word of Latin letters with punctuation behind it: always two or more words to the tokenizers' patterns.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_WORD = re.compile(f"( ?[{_LETTERS}]+)([!-/:-@\\[-`{{-~]*)")
#: Byte-level vocabularies write a byte as itself where it is printable, else as a character from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_BLANK = chr(_BYTE[32])


class Pieces(dict):
    """Ids (as bytes) of pieces of texts; a piece that isn't known is encoded by the library when it is asked for.

    A plain word is given to the library's byte-pair model as the library's own normalizer and pre-tokenizer would
    hand it over, without a search for words in it; all else goes through the whole of the library."""

    def __init__(self, library):
        super().__init__()
        self.library, self.model = library, library.model
        self.folds = library.normalizer is not None and library.normalizer.normalize_str("A\u00c9") == "a\u00e9"
        letters = re.findall(f"[{_LETTERS}]", "".join(map(chr, range(256))))
        words = [f" {a}{b}" for a, b in zip(letters, letters[1:] + letters[:1], strict=True)] + letters
        self.direct = all(self._of_word(word) == self.of_any(word) for word in words)

    def of_any(self, piece: str) -> bytes:
        ids = self.library.encode_batch_fast([piece], add_special_tokens=False)[0].ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _of_word(self, word: str) -> bytes:
        if self.folds:
            word = word.strip(" ").lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTE)
        elif word[0] == " ":
            word = _BLANK + word[1:]
        ids = [token.id for token in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, piece: str) -> bytes:
        word = _WORD.fullmatch(piece)
        if word is None:
            ids = self.of_any(piece)
        elif word[2]:
            ids = self[word[1]] + self[word[2]]
        else:
            ids = self._of_word(piece) if self.direct else self.of_any(piece)
        self[piece] = ids
        return ids


class PieceEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, most: int = 450_000):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self.known, self.most = Pieces(library), most
        self.special = [token.content for token in library.get_added_tokens_decoder().values()]
        self.bare = self.known.of_any("\n a \t b ") == self.known.of_any("a") + self.known.of_any("b")

    def pieces(self, text: str) -> list[str]:
        """Parts of a text that the library's words never reach across.

        Where it drops white space, all that white space parts, in lower case where case is dropped too and no
        special string comes about; else, in a text of lines of words with one blank between them, every word with
        its blank, and every line feed; in any other text runs of white space with what follows."""
        if self.bare:
            if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split only
                return _RUNS.findall(text)
            if self.known.folds and text.isascii() and not any(s in (low := text.lower()) for s in self.special):
                return low.split()
            return text.split()
        plain = "  " not in text and "\n\n" not in text and " \n" not in text and text[0] != " " and text[-1] != " " and "\0" not in text
        if plain and not any(c in text for c in (_ODD[:4] if text.isascii() else _ODD)):
            return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        return _RUNS.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        trim(self.known, self.most)
        ids_of = self.known.__getitem__
        return [b"".join(map(ids_of, self.pieces(text))) if text else b"" for text in texts]


def encoder(path: str) -> PieceEncoder:
    """One encoder a worker process and vocabulary, kept over its tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return kept(("encoder", path), lambda: PieceEncoder(path))


def encoded(texts: list[str | None], path: str) -> Iterator[bytes]:
    """`encode` in parts of bounded size."""
    texts = [text or "" for text in texts]
    for first, end in by_characters(texts):
        yield from encoder(path).encode(texts[first:end])


# --- blocks ---------------------------------------------------------------------------------------------------------


def pack_block(ids: np.ndarray, percentile: float = 0.98) -> bytes:
    """minimum u4, length u4, width u1, exceptions u4; packed low bits; exception places u2 and differences u4."""
    low = int(ids.min())
    delta = ids - np.uint32(low)
    at = min(len(delta) - 1, int(len(delta) * percentile))
    width = int(np.partition(delta, at)[at]).bit_length()
    odd = np.flatnonzero(delta >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    kept = delta.copy()
    kept[odd] = 0
    bits = np.unpackbits(kept.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - width :]
    return struct.pack("<IIBI", low, len(ids), width, len(odd)) + np.packbits(bits).tobytes() + odd.astype("<u2").tobytes() + delta[odd].astype("<u4").tobytes()


def unpack_block(data: bytes, at: int = 0) -> np.ndarray:
    low, n, width, n_odd = struct.unpack_from("<IIBI", data, at)
    at += 13
    n_packed = (n * width + 7) // 8
    wide = np.zeros((n, 32), np.uint8)
    if width:
        wide[:, 32 - width :] = np.unpackbits(np.frombuffer(data, np.uint8, n_packed, at), count=n * width).reshape(n, width)
    ids = np.packbits(wide, axis=1).view(">u4").reshape(-1).astype(np.uint32)
    at += n_packed
    if n_odd:
        ids[np.frombuffer(data, "<u2", n_odd, at)] = np.frombuffer(data, "<u4", n_odd, at + 2 * n_odd)
    return ids + np.uint32(low)


class TokenFileWriter:
    """Blocks, then block starts u8, document ids i8, null flags u1, numbers of ids u8; then their counts and the magic."""

    def __init__(self, out):
        self.out, self.at, self.starts = out, len(MAGIC), []
        self.ids, self.nulls, self.lengths = [], [], []
        self.waiting, self.n_waiting, self.n_ids = [], 0, 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.lengths.append(len(ids) // 4)
        self.n_ids += len(ids) // 4
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= 4 * BLOCK * 16:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        stream = np.frombuffer(b"".join(self.waiting), "<u4")
        end = len(stream) if all_of_it else len(stream) // BLOCK * BLOCK
        for first in range(0, end, BLOCK):
            packed = pack_block(stream[first : min(end, first + BLOCK)])
            self.starts.append(self.at)
            self.at += len(packed)
            self.out.write(packed)
        self.waiting = [stream[end:].tobytes()]
        self.n_waiting = len(self.waiting[0])

    def close(self) -> None:
        self._flush(True)
        for values, kind in ((self.starts, "<u8"), (self.ids, "<i8"), (self.nulls, "u1"), (self.lengths, "<u8")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(struct.pack("<QQQ", len(self.starts), len(self.ids), self.at) + MAGIC)


def read_documents(source, size: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) in order, block by block; `source` is a seekable file."""
    source.seek(size - 32)
    n_blocks, n_docs, index = struct.unpack("<QQQ", source.read(24))
    if source.read(8) != MAGIC:
        raise ValueError("not a token file, or cut short")
    source.seek(index)
    starts = np.frombuffer(source.read(8 * n_blocks), "<u8")
    doc_ids = np.frombuffer(source.read(8 * n_docs), "<i8")
    nulls = np.frombuffer(source.read(n_docs), "u1")
    lengths = np.frombuffer(source.read(8 * n_docs), "<u8")
    ends = np.append(starts[1:], np.uint64(index)) if n_blocks else starts
    block, have, used = 0, [np.empty(0, np.uint32)], 0
    for doc_id, null, length in zip(doc_ids.tolist(), nulls.tolist(), lengths.tolist(), strict=True):
        there = sum(map(len, have)) - used
        while there < length:
            source.seek(int(starts[block]))
            more = unpack_block(source.read(int(ends[block] - starts[block])))
            have.append(more)
            there += len(more)
            block += 1
        if len(have) > 1:
            have, used = [np.concatenate([have[0][used:], *have[1:]])], 0
        yield (None if null else doc_id), have[0][used : used + length]
        used += length


# --- on Spark -------------------------------------------------------------------------------------------------------


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> list[tuple[int, str, int, int, int]]:
    """Write all documents in ascending doc_id order; (part, path, bytes, documents, ids) of each file, in order.

    Texts are dealt out once, by ranges of doc_id. The list has one small entry a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, path = pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        fs.create_dir(path, recursive=True)
        name = f"{path}/part-{part:06d}-{uuid.uuid4().hex}.tlpf"
        end = np.array([end_id], "<u4").tobytes()
        with fs.open_output_stream(f"{name}.open") as out:
            writer = TokenFileWriter(out)
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1).to_pylist(), tokenizer), strict=True):
                    writer.add(doc_id, ids + end)
            writer.close()
        fs.move(f"{name}.open", name)
        size = fs.get_file_info(name).size
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, name, size, len(writer.ids), writer.n_ids)], names=["part", "path", "bytes", "docs", "ids"])

    dealt = docs.select("doc_id", "text").repartitionByRange(shuffle_partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first())
    files = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(run, "part bigint, path string, bytes bigint, docs bigint, ids bigint")
    return sorted(tuple(row) for row in files.collect() if row.docs)


def read_token_files(spark: SparkSession, folder: str, files: list[tuple[int, str, int, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files, one task a file."""
    rows, start = [], 0
    for _, path, size, _, ids in files:
        rows.append((path, size, start))
        start += ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        for batch in batches:
            for path, size, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = []
                with fs.open_input_file(path) as source:
                    for doc_id, ids in read_documents(source, size):
                        out.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        if len(out) == 10_000:
                            yield _rows(out)
                            out = []
                yield _rows(out)

    listed = spark.createDataFrame(rows, "path string, bytes bigint, start bigint").repartition(max(1, len(rows)), "path")
    return listed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])
