"""Token ids in binary files that can be read document by document.

A file holds, for each document in ascending id order, those without id first, one independent zstandard frame
with its token ids as little-endian unsigned 32-bit integers. After them come a
skippable frame with the document ids (where some have none, their number stands behind
the ids, and their own places are 0), and the seek table of the public zstandard
seekable format: for each frame its compressed size, its size and a checksum (the low
32 bits of the XXH64 of the content). A reader takes the table from the file's end and
then decompresses the frames that it wants only; any zstandard tool can unpack all.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, new_path, parts_of

# The zstandard seekable format.
SKIPPABLE, SEEK_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
END_ID = 0
# ASCII punctuation: signs that are a piece of text of their own after a letter.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

ENTRY = 130  # bytes, about, that a word takes beside its letters and ids
AT_ONCE = 1 << 20  # characters whose words are held at once; a longer text is taken alone


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all items of runs that begin at ``starts``, run after run."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Runs:
    """Runs of numbers by word, in one array that grows at its end."""

    def __init__(self, kind: str, entry: int):
        self.number: dict[str, int] = {}
        self.kind, self.entry, self.held = np.dtype(kind), entry, 0
        self.start, self.size, self.items = np.empty(1024, np.int64), np.empty(1024, np.int64), np.empty(1024, self.kind)
        self.n = self.used = 0

    def add(self, words: list[str], sizes: np.ndarray, items: np.ndarray) -> np.ndarray:
        """The numbers of new words, whose runs follow each other in ``items``."""
        n, used = self.n + len(words), self.used + len(items)
        if n > len(self.start):
            self.start, self.size = (np.concatenate([x[: self.n], np.empty(n - self.n + self.n // 2, np.int64)]) for x in (self.start, self.size))
        if used > len(self.items):
            self.items = np.concatenate([self.items[: self.used], np.empty(used - self.used + self.used // 2, self.kind)])
        self.start[self.n : n] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n : n] = sizes
        self.items[self.used : used] = items
        numbers = np.arange(self.n, n)
        self.number.update(zip(words, numbers.tolist(), strict=True))
        self.held += self.entry * len(words) + sum(map(len, words)) + self.kind.itemsize * len(items)
        self.n, self.used = n, used
        return numbers

    def of(self, words: list[str]) -> np.ndarray:
        """The numbers of words; -1 for those that aren't here."""
        get = self.number.get
        return np.array([get(w, -1) for w in words], np.int64)

    def taken(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, items) of these runs, one after another."""
        sizes = self.size[numbers]
        return sizes, self.items[ragged(self.start[numbers], sizes)]


class Encoder:
    """Ids of whole texts, by the tokenizers library.

    Byte-level pieces never cross the start of a space or line break that has something
    other than white space after it, so the ids of a text are those of its words, each
    with that space or line break before it. That holds for the pre-tokenizer that is
    asked for on loading; another one raises. Words recur: the different words of a batch
    are found first, and each is encoded once and its ids are kept, as long as they take
    about ``most`` bytes; then they are put aside, until as many others came, and those
    that come again are taken back. Words of more than ``longest`` characters, as in text
    without spaces, aren't kept. Texts with other white space, or with a special token,
    go to the library as a whole.
    """

    def __init__(self, path: str, most: int = 128 << 20, longest: int = 128):
        from tokenizers import Tokenizer

        t = self.tokenizer = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        parts = json.loads(t.to_str())
        rule = parts["pre_tokenizer"] or {}
        if parts["normalizer"] or rule.get("type") != "ByteLevel" or rule.get("add_prefix_space") or not rule.get("use_regex", True):
            raise ValueError("texts are cut for plain byte-level pieces")
        self.most, self.longest = most, longest
        self.special = [x.content for x in t.get_added_tokens_decoder().values()]
        self.starts = np.zeros(t.get_vocab_size(), bool)  # of ids that begin with a space or line break
        for token, i in t.get_vocab().items():
            self.starts[i] = token[0] in "\u0120\u010a"
        self.words_of, self.old = Runs("<u4", ENTRY), Runs("<u4", ENTRY)

    @property
    def held(self) -> int:
        return self.words_of.held

    @property
    def known(self) -> dict[str, int]:
        return self.words_of.number

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def spaced(self, text: str) -> str | None:
        """A text with spaces between its words: bare after a space, else with the line break
        before them; the first has one put before it. None if the text must be encoded
        as a whole."""
        if not text or text[0] in " \n" or "  " in text or text[-1] == " " or " \n" in text or "\n\n\n" in text or "\n\n " in text or text.endswith("\n\n") or any(x in text for x in self.special):
            return None
        spaced = text.replace("\n", " \n")
        return "\n" + spaced if text.replace("\n", "").isprintable() else None

    def words(self, text: str) -> list[str] | None:
        """The words of spaced(), if there are any."""
        spaced = self.spaced(text)
        return spaced.split(" ") if spaced else None

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of words, by the library, many at a time."""
        sizes, found = [np.empty(0, np.int64)], [np.empty(0, "<u4")]
        for at in range(0, len(words), 1024):
            ids = self.ids("".join([w if w[0] == "\n" else " " + w for w in words[at : at + 1024]]))
            sizes.append(np.diff(np.append(np.flatnonzero(self.starts[ids]), len(ids))))
            found.append(ids)
        return np.concatenate(sizes), np.concatenate(found)

    def learn(self, words: list[str]) -> None:
        """Encodes new words. Signs after a letter are a piece of text by themselves, so of
        such a word its beginning and its signs are encoded apart."""
        known = self.words_of
        again = self.old.of(words)
        at = np.flatnonzero(again >= 0)
        known.add([words[k] for k in at.tolist()], *self.old.taken(again[at]))
        new, joined = [], []
        for w in [words[k] for k in np.flatnonzero(again < 0).tolist()]:
            base = w.rstrip(SIGNS)
            if base != w and base and base[-1].isalpha() and base[-1] < "\u2000":
                joined.append((w, base, w[len(base) :]))
            else:
                new.append(w)
        new += {base for _, base, _ in joined if base not in known.number}.difference(new)
        known.add(new, *self.encoded(new))
        if joined:
            signs = list({x for _, _, x in joined})
            ids = [self.ids(x) for x in signs]
            ends = Runs("<u4", 0)
            ends.add(signs, np.array(list(map(len, ids)), np.int64), np.concatenate(ids))
            parts = [own.taken(own.of([x[k] for x in joined])) for k, own in ((1, known), (2, ends))]
            sizes = parts[0][0] + parts[1][0]
            out = np.empty(int(sizes.sum()), "<u4")
            starts = np.cumsum(sizes) - sizes
            for k, (n, items) in enumerate(parts):
                out[ragged(starts + k * parts[0][0], n)] = items
            known.add([w for w, _, _ in joined], sizes, out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as bytes, without an end id."""
        out: list[bytes] = []
        for part in parts_of(texts, AT_ONCE):
            out += self._encode(part)
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        if self.held > self.most:
            self.old, self.words_of = self.words_of, Runs("<u4", ENTRY)
        spaced = [self.spaced(t) for t in texts]
        words = pc.split_pattern(pa.array([t for t in spaced if t is not None], pa.string()), " ")
        place = words.flatten().dictionary_encode()
        # No word holds a space: to join and split them is faster than to take them one by one.
        one = pa.ListArray.from_arrays(pa.array([0, len(place.dictionary)], pa.int32()), place.dictionary)
        different = pc.binary_join(one, " ")[0].as_py().split(" ") if len(place.dictionary) else []
        known = self.words_of
        number = known.of(different)
        missing = np.flatnonzero(number < 0).tolist()
        self.learn([different[k] for k in missing])
        number[missing] = known.of([different[k] for k in missing])
        sizes, ids = known.taken(number[place.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(sizes)])[words.offsets.to_numpy()].tolist()
        # The line break that was put before a text is one id.
        found = (ids[a + 1 : b].tobytes() for a, b in zip(ends, ends[1:], strict=False))
        out = [self.ids(t).tobytes() if x is None else next(found) for t, x in zip(texts, spaced, strict=True)]
        for w in [different[k] for k in missing if len(different[k]) > self.longest]:
            for own in {w, w.rstrip(SIGNS)}.intersection(known.number):
                known.held -= known.entry + len(own)  # its ids go with the others
                del known.number[own]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The one of this worker process: tasks that follow each other share its words."""
    # Spark's tasks are the threads; the library's own would only wait for each other.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def frame(ids: bytes, compressor: zstandard.ZstdCompressor) -> tuple[bytes, int]:
    """The compressed frame of a document's ids, and its checksum."""
    return compressor.compress(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF


def tail(doc_ids: list[int | None], sizes: list[tuple[int, int, int]]) -> bytes:
    """What follows the frames: document ids and seek table. Documents without id are
    the first ones."""
    nulls = doc_ids.count(None)
    index = zlib.compress(np.array([0] * nulls + doc_ids[nulls:] + [nulls] * (nulls > 0), "<i8").tobytes(), 1)
    head = struct.pack("<II", SKIPPABLE, len(index)) + index
    # The skippable frame is in the table as well, as a frame without content.
    entries = np.array([*sizes, (len(head), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)], "<u4").tobytes()
    return head + struct.pack("<II", SEEK_TABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(sizes) + 1, 0x80, SEEKABLE)


def read_index(f, size: int) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """(document ids, how many of them, the first ones, stand for none, where each frame starts, rows of compressed size, size and
    checksum) of a file that is open for reading."""
    f.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE or flags != 0x80:
        raise ValueError("no seek table with checksums")
    f.seek(size - 9 - 12 * n)
    entries = np.frombuffer(f.read(12 * n), "<u4").reshape(n, 3)
    starts = np.concatenate([[0], np.cumsum(entries[:, 0], dtype=np.int64)])
    f.seek(int(starts[n - 1]) + 8)
    ids = np.frombuffer(zlib.decompress(f.read(int(entries[n - 1, 0]) - 8)), "<i8")
    return ids[: n - 1], int(ids[n - 1]) if len(ids) == n else 0, starts[: n - 1], entries[: n - 1]


def read_documents(f, size: int, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
    """(document id or None, its ids as bytes) of all documents, or of those wanted; only their
    frames are read and decompressed, and each is held against its checksum."""
    ids, nulls, starts, entries = read_index(f, size)
    unpack = zstandard.ZstdDecompressor()
    rows = range(len(ids)) if wanted is None else nulls + np.flatnonzero(np.isin(ids[nulls:], np.array(sorted(wanted), "<i8")))
    for k in rows:
        f.seek(int(starts[k]))
        raw = unpack.decompress(f.read(int(entries[k, 0])), max_output_size=max(1, int(entries[k, 1])))
        if len(raw) != entries[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != entries[k, 2]:
            raise ValueError(f"document {ids[k]}: checksum differs")
        yield None if k < nulls else int(ids[k]), raw


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id", level: int = 1, partitions: int | None = None
) -> DataFrame:
    """Encodes every text, appends id 0 and writes the files to ``folder``, a URI that
    driver and executors share. Returns one row per file, in no order: path, first_id,
    n_docs, n_tokens.

    Documents are dealt to files by ranges of their id, and the files' order is that of
    their first ids. A task writes a file of its own attempt, which the returned row
    names: what an attempt left that was lost or overtaken is in no row and is never
    read. Write the rows once, and read the files that they list. A null text is an empty one: its document has the end id only. Rows
    without id come first and keep none; rows that repeat an id, or have none, are
    separate documents, one after another in the order of what their texts begin with,
    in as many files as others. An empty table gives no file.
    Memory is that of one batch of texts, the index of one file and the words that a
    process remembers, which are bounded in bytes.
    """
    ids_of = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Behind the id, a key by which rows that have none, or share one, are dealt to many files.
    order = ("doc_id", "_begin", "_hash", "_row")
    keyed = ids_of.select("doc_id", "text", F.substring("text", 1, 64).alias("_begin"), F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    by_id = keyed.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        part = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        path = f"part-{part:06d}-{TaskContext.get().taskAttemptId()}.zst"
        encode, compressor = encoder(tokenizer_path).encode, zstandard.ZstdCompressor(level=level)
        doc_ids: list[int | None] = []
        sizes: list[tuple[int, int, int]] = []
        out, end = None, np.array([END_ID], "<u4").tobytes()
        for ids, texts in chunks(batches, "doc_id", "text", rows=1024):
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{path}", compression=None)
            for i, raw in zip(ids, encode(texts), strict=True):
                packed, check = frame(raw + end, compressor)
                out.write(packed)
                doc_ids.append(i)
                sizes.append((len(packed), len(raw) + 4, check))
        if out is not None:
            out.write(tail(doc_ids, sizes))
            out.close()
            numbers = [pa.array([x], pa.int64()) for x in (doc_ids[0], len(doc_ids), sum(s[1] for s in sizes) // 4)]
            yield pa.RecordBatch.from_arrays([pa.array([path]), *numbers], names=["path", "first_id", "n_docs", "n_tokens"])

    return by_id.mapInArrow(run, "path string, first_id long, n_docs long, n_tokens long")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """One row per document of the files that ``files`` lists, as write_token_files()
    returns them: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    # A row per file, not per document: its size is that of the list of files.
    first = F.sum("n_tokens").over(Window.orderBy("first_id", "path").rowsBetween(Window.unboundedPreceding, -1))
    listed = files.withColumn("start", F.coalesce(first, F.lit(0)).cast("long")).select("path", "start")

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for paths, starts in chunks(batches, "path", "start"):
            for path, start in zip(paths, starts, strict=True):
                name = f"{root}/{path}"
                rows: list[tuple[int | None, int, int, int]] = []
                with store.open_input_file(name) as f:
                    for i, raw in read_documents(f, f.size()):
                        rows.append((i, start, len(raw) // 4, zlib.crc32(raw)))
                        start += len(raw) // 4
                        if len(rows) == 4096:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    return listed.repartition(max(1, listed.sparkSession.sparkContext.defaultParallelism), "path").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def _rows(rows: list[tuple[int | None, int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_folder(spark: SparkSession) -> str:
    """A new folder for token files that all machines share."""
    return new_path(spark, "tokens")
