"""Cross-tokenizer alignment against plain loops over whole-text encodings."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from scribespark.llm import alignment, queries

DATA = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    None,
    "",
    " ",
    "\n",
    "a ▁ mark",
    "<|endoftext|> <s> </s> <0x0A>",
    "a\r\nb\rc \r d;\r\n",
    "\r\n x\r",
    "é ü　漢字かな交じり文 🙂🙂 ​ x",
    "tab\tand\x0b\x0c\x1cother\x1f",
    "  two  blanks   three    ",
    "don't we'll 12345 ... !!! ===",
    "\x00\x01 \x7f﻿",
    "word " * 3000,
    "é" * 500,
]


@pytest.fixture(scope="module")
def libraries():
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b


def visible():
    """Characters of byte-level entries: visible ones are themselves, the others follow U+0100 in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


def tokens_of(libraries, text):
    a, b = libraries
    if not text:
        return None
    chars = visible()
    ones = [(i, bytes(chars[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    twos = [(i, bytes([int(p[3:5], 16)]) if b.IsByte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    whole = (" " + text).encode()
    return (ones, twos) if b"".join(t for _, t in ones) == whole == b"".join(t for _, t in twos) else None


def brute_force(libraries, rows):
    per_doc, counts = [], Counter()
    for doc_id, text in rows:
        found = tokens_of(libraries, text)
        if not found:
            per_doc.append((doc_id, 0, 0, 0, [], ""))
            continue
        spans = []
        for side in found:
            at = 0
            spans.append([])
            for i, t in side:
                spans[-1].append((at, at + len(t), i))
                at += len(t)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, links = [], []
        k = [0, 0]
        for cut in cuts:
            parts = []
            for side in (0, 1):
                first = k[side]
                while k[side] < len(spans[side]) and spans[side][k[side]][1] <= cut:
                    k[side] += 1
                parts.append(spans[side][first : k[side]])
            groups.append("|".join(",".join(str(i) for _, _, i in p) for p in parts))
            links += [(x[2], y[2]) for x in parts[0] for y in parts[1] if x[0] < y[1] and y[0] < x[1]]
        counts.update(set(links))
        per_doc.append((doc_id, len(spans[0]), len(spans[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return [(d, a, b, g, len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links), sha) for d, a, b, g, links, sha in per_doc]


def rows_of(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_query(spark, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.QUERIES["op13_alignment"](spark, DATA)) == Counter(brute_force(libraries, rows))


@pytest.mark.parametrize("heavy", [1, 40, 100_000])
def test_odd_texts(spark, libraries, heavy, monkeypatch):
    """Also: repeated rows, null ids, extra columns; some, no and all pairs told to every task."""
    rows = [(k, t) for k, t in enumerate(ODD)] + [(5, ODD[5]), (None, ODD[5]), (None, None)]
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "doc_id long, text string, pair string, row string")
    assert rows_of(alignment.align(df, A, B, heavy=heavy)) == Counter(brute_force(libraries, rows))


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_long_texts_in_parts(libraries, monkeypatch):
    """Parts of documents, settled over several rounds, give what whole documents give; a bad part empties its document."""
    rows = [(1, " ".join(f"w{i % 97} größe\n" for i in range(3000))), (2, "short"), (3, "good words " * 1000 + "▁"), (4, "x " * 500)]
    rows += [(k, mark.join(["ab?!", "c\r", "", "\x1c", "d"] * 300) + "y" * n + mark) for k, mark, n in ((5, " ", 2000), (6, "\n", 3000), (7, "\t", 1999), (8, "\r\n", 1))]
    monkeypatch.setattr(alignment, "ROUND_BYTES", 8000)
    enc = alignment.Encoders(A, B)
    got = [r for batch in alignment._rows(enc, iter(rows)) for r in batch.to_pylist()]
    want = {r[0]: r for r in brute_force(libraries, rows)}
    assert len(got) == 8
    for r in got:
        assert tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")) == want[r["doc_id"]][:5] + want[r["doc_id"]][7:]
        assert sum(r["times"]) == r["n_links"] and len(set(r["pairs"])) == len(r["pairs"])


def test_cuts_of_any_ends():
    """Rare, clustered and missing shared ends, several texts at once."""
    rng = random.Random(5)
    for share in (0.0, 0.01, 0.3, 0.9):
        a, b, a_stop, b_stop, at = [], [], [], [], 0
        for _ in range(4):
            n = rng.choice([1, 2, 50, 3000])
            for k in range(n):
                common = rng.random() < share and k > n // 3
                a.append(at + 2 + (not common))
                b += [at + 2] if common else [at + 4] if rng.random() < 0.7 else []
                at += 6
            a.append(at)
            b.append(at)
            a_stop.append(len(a))
            b_stop.append(len(b))
        got = alignment.shared_cuts(*(np.array(x) for x in (a, b, a_stop, b_stop)))
        common = sorted(set(a) & set(b))
        assert got[0].tolist() == [a.index(e) + 1 for e in common] and got[1].tolist() == [b.index(e) + 1 for e in common]
