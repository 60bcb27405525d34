"""Benchmark decontamination by one Aho-Corasick automaton.

Test items are normalised to words. Every window of n words holds one of the runs of
(n + 1) / 2 words that an item is cut into, so the automaton has these runs alone (and
items of fewer than n words whole), each word once: it grows with the items, not with
their windows. A document is scanned once; where a run is found, the words of the item
around it are compared, and if n or more follow each other, they are hit. Hits are
mapped to offsets of the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import new_path, utf8

# Words are runs of digits, letters (of either case, in the original) and
# whatever isn't ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8, A-Z in lower case."""
    return utf8(text).translate(_LOWER).split()


class Items:
    """The automaton of test items, over numbers of words."""

    def __init__(self, items: Iterable[tuple[int | None, str | None]], n: int):
        self.n, self.part = n, (n + 1) // 2
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int | None]] = {}  # of each text of words, its items
        for i, text in items:
            words = tuple([self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)])
            if words:
                owners.setdefault(words, set()).add(i)
        self.ids = [tuple(x) for x in owners.values()]
        # Of each run, the words before and after it that a window may hold, and whose they are.
        around: dict[tuple, dict[tuple, list[int]]] = {}
        for k, words in enumerate(owners):
            if len(words) < n:
                around.setdefault(words, {}).setdefault((None, None), []).append(k)
                continue
            for at in range(0, len(words) - self.part + 1, self.part):
                end = at + self.part
                own = (words[max(0, end - n) : at], words[end : at + n])
                around.setdefault(words[at:end], {}).setdefault(own, []).append(k)
        self.automaton = None
        if around:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for run, own in around.items():
                self.automaton.add_word(run, (len(run), [(x, y, tuple(ks)) for (x, y), ks in own.items()]))
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set[int | None]]:
        """(which words are hit, ids of the items found); None instead of no hits."""
        if self.automaton is None or not words:
            return None, set()
        get = self.number.get
        line = tuple([get(w, 0) for w in words])
        hit, found, n = None, set(), self.n
        for last, (size, owners) in self.automaton.iter(line):
            end = last + 1
            at = end - size
            for before, after, ks in owners:
                x, y = at, end
                if before is not None:
                    for w in reversed(before):
                        if not x or line[x - 1] != w:
                            break
                        x -= 1
                    for w in after:
                        if y == len(line) or line[y] != w:
                            break
                        y += 1
                    if y - x < n:
                        continue
                if hit is None:
                    hit = np.zeros(len(words) + 1, np.int32)
                hit[x] += 1
                hit[y] -= 1
                found.update(ks)
        return (None, set()) if hit is None else (np.cumsum(hit)[:-1] > 0, {i for k in found for i in self.ids[k]})


@lru_cache(maxsize=1)
def items_at(folder: str, n: int) -> Items:
    """Those of a written table, built once in this worker process."""
    store, root = fs.FileSystem.from_uri(folder)
    files = dataset.dataset(root, filesystem=store, format="parquet")
    return Items((row for b in files.to_batches(columns=["item_id", "text"]) for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), n)


def spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of the original text, in characters, of the runs of hit words."""
    at = [m.span() for m in WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [(at[a][0], at[b - 1][1]) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), n: int = 13, min_part: int = 20, unnamed: bool = False
) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, then n_words, n_hit, n_items
    (long), items_sha256 (of the ids of the found items, sorted as strings, joined by
    commas), contaminated (some word is hit, and one in ``min_part`` of the words or more),
    hit_spans (start:end of the runs of hit words in the text, joined by commas).

    ``benchmark`` has item_id and text. It is a stated set of test items: it is written to
    the shared folder, where each worker process reads it and builds its automaton once,
    of some 200 bytes a word; the driver never holds it. Null and empty texts, in
    documents or items, have no words and no hit; items without id are left out or, if
    ``unnamed``, count for hits and, all of them together, as one more of the items
    found, but aren't in the list of ids. Repeated items and documents are each judged by
    themselves, texts of any length are scanned whole, empty tables give empty results or
    no hits, and further columns are ignored.
    """
    folder = new_path(docs.sparkSession, "items")
    items = benchmark.where("text is not null" if unnamed else "item_id is not null and text is not null")
    items.select("item_id", "text").write.parquet(folder)
    kept = docs.select(*keep, F.col(text).alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    names = "n_words n_hit n_items items_sha256 contaminated hit_spans".split()

    def run(batches):
        items = items_at(folder, n)
        for b in batches:
            at = b.schema.get_field_index("_text")
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                cols: list[list] = [[] for _ in names]
                for value in part.column(at):
                    t = value.as_py()
                    words = words_of(t)
                    hit, found = items.scan(words)
                    n_hit = 0 if hit is None else int(hit.sum())
                    digest = hashlib.sha256(",".join(sorted(str(i) for i in found if i is not None)).encode()).hexdigest()
                    bad = n_hit > 0 and min_part * n_hit >= len(words)
                    where = "" if hit is None else ",".join(f"{x}:{y}" for x, y in spans(t, hit))
                    for c, v in zip(cols, (len(words), n_hit, len(found), digest, bad, where), strict=True):
                        c.append(v)
                types = [pa.int64()] * 3 + [pa.string(), pa.bool_(), pa.string()]
                arrays = [part.column(i) for i in range(at)] + [pa.array(c, k) for c, k in zip(cols, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names[:at], *names])

    return kept.mapInArrow(run, ", ".join([*fields, "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans string"]))
