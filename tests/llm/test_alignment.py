"""Alignment of two tokenizers against a plain loop over all pairs of tokens."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm.alignment import counted_links, linked_by, overlaps, shared_cuts, token_groups
from tidemark.llm.queries import byte_bpe, op12_token_alignment, piece_model

ODD = [None, "", " ", "\n", "\n\n", "a", "  a", " a", "a ", "a\n", "▁", "a▁b", "<s>", "<|endoftext|>", "x<|endoftext|> y", "</s> a", "<0x41>", "a\n\n\nb", "a\n\n b", "\n a\nb c", "don't we'll", "ﬁ①", "\x00", "word " * 3000, "汉" * 5000]


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(sorted(set(range(256)) - set(own)))}
    return a, b, letters


def plain(text, a, b, letters):
    """(groups, links, n_a, n_b) by comparing all ends and all pairs."""
    if not text:
        return "", [], 0, 0
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    raw = (" " + text).encode()
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return "", [], 0, 0
    ends_a, ends_b = (np.cumsum(list(map(len, x))).tolist() for x in (bytes_a, bytes_b))
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(cut) + 1, ends_b.index(cut) + 1
        groups.append(",".join(map(str, ids_a[i:k])) + "|" + ",".join(map(str, ids_b[j:m])))
        i, j = k, m
    links, j = [], 0
    for i, end in enumerate(ends_a):
        start = ends_a[i - 1] if i else 0
        while ends_b[j] <= start:
            j += 1
        k = j
        while k < len(ends_b) and (ends_b[k - 1] if k else 0) < end:
            links.append((ids_a[i], ids_b[k]))
            k += 1
    return ";".join(groups), links, len(ids_a), len(ids_b)


def wanted(texts, tokenizers):
    found = [plain(t, *tokenizers) for t in texts]
    n = Counter(p for _, links, _, _ in found for p in set(links))
    best: dict[int, int] = {}
    for (x, _), k in n.items():
        best[x] = max(best.get(x, 0), k)
    return [
        (n_a, n_b, g.count(";") + 1 if g else 0, len(links), hashlib.sha256(g.encode()).hexdigest() if g else "", sum(n[p] == best[p[0]] for p in links), sum(n[p] for p in links))
        for g, links, n_a, n_b in found
    ]


def generated(n):
    rng = random.Random(1)
    signs = "abcdefghij  \n\n\t.,!'▁éßñ中文字日本語かな0123😀<s></s><|endoftext|> ​\x00ﬁ①"
    return ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_cuts_by_halves():
    rng = np.random.default_rng(5)
    for n in [1, 2, 3, 10, 100, 1000] * 20:
        end = int(rng.integers(n, 4 * n + 2))
        a, b = (np.unique(np.append(rng.integers(1, end + 1, int(rng.integers(1, n + 1))), end)) for _ in range(2))
        assert a[shared_cuts(a, b)].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
        starts = [np.concatenate([[0], x[:-1]]) for x in (a, b)]
        if n <= 100:
            both = (starts[0][:, None] < b[None]) & (starts[1][None] < a[:, None])
            assert list(zip(*map(np.ndarray.tolist, overlaps(a, b)))) == list(zip(*map(np.ndarray.tolist, np.nonzero(both))))
    a = np.arange(1, 50_001) * 2  # no cut but the last, and a cut everywhere
    assert shared_cuts(a, np.append(a[:-1] + 1, a[-1])).sum() == 1 and shared_cuts(a, a).all()


@pytest.mark.parametrize("most", [8_000_000, 0])
def test_against_all_pairs(spark, tokenizers, most):
    """Counts read by workers, and joined: the same rows; repeated and null ids, names that clash."""
    texts = ODD + generated(400) + ["the the the cat"] * 300 + ["the " * 700]
    ids = [None if k % 50 == 7 else k // 2 for k in range(len(texts))]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, texts)], "doc_id long, text string, n_a int, pair string").repartition(3)
    rows = token_groups(d, byte_bpe(), piece_model())
    from pyspark.sql import functions as F

    from tidemark.llm.common import written

    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("sha")
    got = counted_links(written(rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"), "rows"), linked_by(byte_bpe(), piece_model()), most=most)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "sha", "n_best", "count_sum"]
    want = Counter((i, *w) for i, w in zip(ids, wanted(texts, tokenizers)))
    assert Counter(map(tuple, got.collect())) == want


def test_query(spark, data, tokenizers, tmp_path):
    d = spark.read.parquet(f"{data}/documents.parquet")
    rows = d.select("doc_id", "text").collect()
    got = op12_token_alignment(spark, data).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, *w) for r, w in zip(rows, wanted([r.text for r in rows], tokenizers)))
    d.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert op12_token_alignment(spark, str(tmp_path)).count() == 0


def test_groups_as_text(spark, tokenizers):
    d = spark.createDataFrame([(1, "a cat sat"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in token_groups(d, byte_bpe(), piece_model()).collect()}
    assert got[1].groups == plain("a cat sat", *tokenizers)[0] and got[2].groups == "" and got[2].n_links == 0
