"""SentencePiece encoding by sampled segmentations, and lossless decoding.

All ways to cut a text into pieces form a lattice. Forward filtering sums the weights of
the ways that lead to each place; backward sampling then draws one way, from the end, in
proportion to its weight. Draws depend on the seed, the row's key and the place in the
row only, so a row has the same segmentation wherever and whenever it is made.

No piece goes past a space but at its beginning, and none holds a line break: the
lattice of a text falls apart into those of its words, which recur and are kept, as
long as they take a bounded number of bytes. Draws for all words of a batch are made
together, a piece at a time.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import parts_of, slices

SPACE = "▁"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # an odd number; products wrap
LITERAL = 0x110000  # beyond all characters
ENTRY = 150  # bytes, about, that a word takes beside its lattice
AT_ONCE = 1 << 18  # characters whose lattices are made together
LONG = 4096  # a longer word is taken alone
CUT = 24  # words of more characters are cut where no piece goes from one character to the next
ON = "\n\n"  # before a part that goes on with a word; no word holds two line breaks


class Pool:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.n, self.room = 0, np.empty(1024, kind)

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.room):
            self.room = np.concatenate([self.all, np.empty(max(len(x), len(self.room) // 2), self.room.dtype)])
        self.room[self.n : self.n + len(x)] = x
        self.n += len(x)


class Model:
    """Pieces of a SentencePiece model file, with weights for sampling.

    A model of byte-pair merges has ranks and no probabilities: the weight of a piece is
    1 / (rank + offset), as frequencies fall with rank, to the power ``theta``. With a
    large theta the likeliest segmentation is drawn almost always. Characters without a
    piece of their own are written as the pieces of their bytes.
    """

    def __init__(self, path: str, theta: float = 1.0, offset: float = 10.0, most: int = 96 << 20):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.most, self.bytes_of, self.byte_ids = most, [], [0] * 256
        self.ids: dict[str, int] = {}
        self.weight: list[float] = []
        for i in range(sp.get_piece_size()):
            piece, score = sp.id_to_piece(i), sp.get_score(i)
            self.weight.append(-theta * math.log(max(0.0, -score) + offset))
            if sp.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_ids[b] = i
                self.bytes_of.append(bytes([b]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
                if score > -1e8 and SPACE not in piece[1:]:
                    self.ids[piece] = i
        self.weights = np.array(self.weight)
        self.size, self.longest = sp.get_piece_size(), max(map(len, self.ids))
        self.by_length = [self.table([]), *[self.table([x for x in self.ids if len(x) == n]) for n in range(1, self.longest + 1)]]
        pairs = {ord(a) << 21 | ord(b) for x in self.ids for a, b in zip(x, x[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.uint64)  # characters that follow each other in a piece
        self.byte_weight = -theta * math.log(self.size + offset)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}  # the number of each word
        self.last = Pool(np.int32)  # of each word, its last node
        self.edge = Pool(np.int32)  # of each node, the first edge into it
        self.chance = Pool(np.float32)  # of each edge, cumulated among those into the node
        self.origin = Pool(np.int32)  # the node that an edge comes from; -1 at a word's start
        self.token = Pool(np.int32)  # an edge's piece, or the size of the vocabulary and more
        self.spelt: dict[str, int] = {}  # characters that are written as bytes
        self.spelling: list[list[int]] = []

    def table(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of pieces of one length, in order; their ids and characters."""
        letters = np.array([[ord(c) for c in x] for x in pieces], np.uint64).reshape(len(pieces), len(pieces[0]) if pieces else 0)
        h = np.zeros(len(pieces), np.uint64)
        for k in range(letters.shape[1]):
            h = h * MULTIPLIER + letters[:, k]
        order = np.argsort(h)
        return h[order], np.array([self.ids[x] for x in pieces], np.int64)[order], letters[order]

    def bytes_for(self, c: str) -> int:
        if (k := self.spelt.get(c)) is None:
            k = self.spelt[c] = len(self.spelling)
            self.spelling.append([self.byte_ids[b] for b in c.encode()])
        return self.size + k

    def edges(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The lattices of parts as words() gives them: of each piece that fits, the place
        of its first character among all characters, its length and its id; and the number
        of characters of each part, with the sign for the space before it.

        All pieces of one length are found at once: their hashes grow by a character with
        the length, and what has a piece's hash is compared with it by character."""
        whole = [p[2:] if p[:2] == ON else p if p[:1] == "\n" else SPACE + p for p in parts]
        text = "".join(whole)
        length = np.array(list(map(len, whole)), np.int64)
        base = np.cumsum(length) - length
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sign = np.zeros(len(code), bool)
        sign[base[[p[:1] != "\n" for p in parts]]] = True
        code[(code == ord(SPACE)) & ~sign] = LITERAL  # characters of the text that look like the sign
        left = np.repeat(base + length, length) - np.arange(len(code))
        at, h, out = np.arange(len(code)), np.zeros(len(code), np.uint64), []
        for n in range(1, self.longest + 1):
            stay = left[at] >= n
            at, h = at[stay], h[stay]
            h = h * MULTIPLIER + code[at + n - 1]
            hashes, ids, letters = self.by_length[n]
            if not len(hashes):
                continue
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = np.flatnonzero(hashes[k] == h)
            k, place = k[hit], at[hit]
            same = (code[place[:, None] + np.arange(n)] == letters[k]).all(axis=1)
            out.append((place[same], np.full(int(same.sum()), n), ids[k[same]]))
        lone = np.ones(len(code), bool)
        lone[out[0][0]] = False
        lone = np.flatnonzero(lone)  # characters without a piece
        if len(lone):
            chars, which = np.unique(np.where(sign[lone], ord(" "), code[lone]), return_inverse=True)
            spelt = np.array([self.bytes_for(SPACE if c == LITERAL else chr(c)) for c in chars.tolist()], np.int64)
            out.append((lone, np.ones(len(lone), np.int64), spelt[which]))
        return *(np.concatenate([o[k] for o in out]).astype(np.int64) for k in range(3)), length

    def learn(self, parts: list[str]) -> None:
        """Adds the lattices of new parts, with the chances of backward sampling. The sums
        of forward filtering go from place to place, for all parts together."""
        place, size, token, length = self.edges(parts)
        base = np.cumsum(length) - length
        first = np.repeat(base, length)[place]
        end = place - first + size
        order = np.lexsort((-size, first, end))
        end, size, token, first = end[order], size[order], token[order], first[order]
        node, origin = first + end - 1, np.where(end == size, -1, first + end - size - 1)
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        weight = np.where(token < self.size, self.weights[np.minimum(token, self.size - 1)], self.byte_weight)
        total, chance = np.zeros(int(length.sum())), np.empty(len(node))
        if len(length) == 1 and length[0] > LONG:
            chance[:] = _chances_of_one(starts.tolist(), node[starts].tolist(), origin.tolist(), weight.tolist())
        else:
            self._chances(starts, end, node, origin, weight, total, chance, int(length.max()))
        chance[np.append(starts[1:], len(node)) - 1] = 2.0  # the last one takes the rest
        nodes, edges = self.edge.n, self.chance.n
        into = np.empty(int(length.sum()), np.int64)
        into[node[starts]] = starts + edges
        self.edge.add(into)
        self.chance.add(chance)
        self.origin.add(np.where(origin < 0, -1, origin + nodes))
        self.token.add(token)
        for k, p in enumerate(parts, self.last.n):
            self.known[p] = k
        self.last.add(nodes + base + length - 1)

    @staticmethod
    def _chances(starts, end, node, origin, weight, total, chance, longest: int) -> None:
        """Fills ``chance``, a place in all words at once."""
        bounds = np.searchsorted(end[starts], np.arange(1, longest + 2))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):  # a place in all words
            if lo == hi:
                continue
            s = slice(starts[lo], starts[hi] if hi < len(starts) else len(node))
            at = starts[lo:hi] - s.start
            way = np.where(origin[s] < 0, 0.0, total[origin[s]]) + weight[s]
            n = np.diff(np.append(at, len(way)))
            top = np.repeat(np.maximum.reduceat(way, at), n)
            # Sums within a node only: they don't depend on the words beside it.
            ways = np.exp(way - top)
            for k in range(1, int(n.max())):
                on = at[n > k] + k
                ways[on] += ways[on - 1]
            sums = ways[at + n - 1]
            total[node[s][at]] = top[at] + np.log(sums)
            chance[s] = ways / np.repeat(sums, n)

    @property
    def held(self) -> int:
        """Bytes, about, that the known words take."""
        return ENTRY * len(self.known) + 8 * self.edge.n + 12 * self.chance.n

    def words(self, text: str) -> list[str]:
        """The parts of a text: bare after a space (one is thought before the text), or
        with the line break that they begin with. Long words, as in text without spaces,
        are cut wherever no piece can go on: all ways to cut the word do so there."""
        words = text.replace("\n", " \n").split(" ")
        if len(text) <= CUT or max(map(len, words)) <= CUT:
            return words
        return [p for w in words for p in (self.cut(w) if len(w) > CUT else (w,))]

    def cut(self, word: str) -> list[str]:
        """The parts of a long word; all but the first have the mark of what goes on."""
        code = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        pair = code[:-1] << np.uint64(21) | code[1:]
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        ends = [*(np.flatnonzero(self.pairs[at] != pair) + 1).tolist(), len(word)]
        return [word[: ends[0]], *[ON + word[a:b] for a, b in zip(ends, ends[1:], strict=False)]]

    def sample(self, texts: list[str], keys: list[int], seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's begin and the last one's end)."""
        parts = [self.words(t) for t in texts]
        if self.held > self.most:
            self.forget()
        missing = {w for ws in parts for w in ws}.difference(self.known)
        if missing:
            for some in parts_of([w for w in missing if len(w) <= LONG], AT_ONCE):
                self.learn(some)
            for w in missing:
                if len(w) > LONG:
                    self.learn([w])
        number = self.known.__getitem__
        counts = np.array([len(ws) for ws in parts], np.int64)
        word = np.array([k for ws in parts for k in map(number, ws)], np.int64)
        place = np.arange(len(word)) - np.repeat(np.cumsum(counts) - counts, counts)
        state = _mixed(np.repeat(_mixed(np.array([k & (1 << 64) - 1 for k in keys], np.uint64) + np.uint64(seed)), counts) + place.astype(np.uint64))
        node, alive = self.last.all[word], np.arange(len(word))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        into, chance, origin = self.edge.all, self.chance.all, self.origin.all
        while len(alive):
            drawn = ((_mixed(state[alive] + np.uint64(len(steps) + 1)) >> np.uint64(40)) * np.float32(2.0**-24)).astype(np.float32)
            edge = into[node]
            on = np.flatnonzero(chance[edge] <= drawn)
            while len(on):
                edge[on] += 1
                on = on[chance[edge[on]] <= drawn[on]]
            steps.append((alive, edge))
            node = origin[edge]
            alive, node = alive[node >= 0], node[node >= 0]
        pieces = np.zeros(len(word), np.int64)
        for at, _ in steps:
            pieces[at] += 1
        ends = np.cumsum(pieces)
        ids = np.empty(int(pieces.sum()), np.int32)
        for k, (at, edge) in enumerate(steps):
            ids[ends[at] - 1 - k] = self.token.all[edge]
        upto = np.concatenate([[0], ends[np.cumsum(counts) - 1]]) if len(texts) else np.zeros(1, np.int64)
        spelt = np.flatnonzero(ids >= self.size)
        if len(spelt):
            n = np.ones(len(ids), np.int64)
            letters = [self.spelling[k] for k in (ids[spelt] - self.size).tolist()]
            n[spelt] = [len(x) for x in letters]
            place = np.repeat(n > 1, n) | np.repeat(ids >= self.size, n)
            ids = np.repeat(ids, n)
            ids[place] = [b for x in letters for b in x]
            upto = np.concatenate([[0], np.cumsum(n)])[upto]
        return ids, upto

    def decode(self, ids: list[int]) -> str:
        """The text that ids stand for, less the space that is thought before it."""
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode()


def _chances_of_one(starts: list[int], nodes: list[int], origin: list[int], weight: list[float]) -> list[float]:
    """The same for one long word, in whose places there is nothing to do at once."""
    total, out = [0.0] * len(nodes), []
    for node, a, b in zip(nodes, starts, [*starts[1:], len(origin)], strict=True):
        ways = [weight[k] if origin[k] < 0 else total[origin[k]] + weight[k] for k in range(a, b)]
        top, upto, sums = max(ways), 0.0, []
        for way in ways:
            upto += math.exp(way - top)
            sums.append(upto)
        total[node] = top + math.log(upto)
        out += [x / upto for x in sums]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit number for each number, by multiplications and shifts."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=2)
def model(path: str, theta: float) -> Model:
    """The one of this worker process: tasks that follow each other share its words."""
    return Model(path, theta)


def sampled_pieces(
    docs: DataFrame, model_path: str, seed: int = 0, theta: float = 1.0, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True
) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, then n_chars, n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers), lossless (decoding
    gives the text back) and, if ``with_ids``, ids.

    ``key`` is an integer column that seeds a row's draws; rows of equal key and text get
    equal ids, and a null key counts as 0. A null text is an empty one, and an empty text
    is the piece of the space before it. Any other text is encoded without loss,
    whatever its characters. An empty table gives an empty one. Words of any length are
    taken whole; what a process holds grows with the longest text, not with the table. ``keep`` may name any columns but the added ones.
    """
    kept = docs.select(*keep, F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-2]]
    names = ["n_chars", "n_tokens", "ids_crc32", "lossless", *["ids"] * with_ids]

    def run(batches):
        m = model(model_path, theta)
        for b in batches:
            at = b.num_columns - 2
            for part in slices(b, at + 1, 256, 1 << 20):
                texts = part.column(at + 1).to_pylist()
                ids, upto = m.sample(texts, part.column(at).to_pylist(), seed)
                bounds = list(zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True))
                flat = ids.tolist()
                cols = [
                    pa.array(list(map(len, texts)), pa.int64()),
                    pa.array(np.diff(upto)),
                    pa.array([zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in bounds], pa.int64()),
                    pa.array([m.decode(flat[x:y]) == t for (x, y), t in zip(bounds, texts, strict=True)]),
                ]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids)))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(at)] + cols, names=[*part.schema.names[:at], *names])

    kinds = "n_chars long, n_tokens long, ids_crc32 long, lossless boolean" + ", ids array<int>" * with_ids
    return kept.mapInArrow(run, ", ".join([*fields, kinds]))


def decoded_pieces(rows: DataFrame, model_path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and text of rows with an array of ids; null for null ids, and
    an empty text for no ids. Rows are independent: repeated ones, further columns and an
    empty table change nothing."""
    kept = rows.select(*keep, F.col(ids).alias("_ids"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]

    def run(batches):
        m = model(model_path, 1.0)
        for b in batches:
            own = [None if x is None else m.decode(x) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns - 1)], pa.array(own, pa.string())], names=[*b.schema.names[:-1], "text"])

    return kept.mapInArrow(run, ", ".join([*fields, "text string"]))
