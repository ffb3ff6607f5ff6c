"""Token alignment, importance resampling and token counts against brute force on small awkward tables."""

import collections
import hashlib
import math
import os
import re
import string
import zlib

import public_tokenizers as P
import pytest

BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = [
    None, "", "   ", "one", "Hello, World! it's ÉCOLE école 123", "a" * 3000, "word " * 5000, "é🙂 日本語 \x1c odd\x85space İstanbul Σας", "<|endoftext|> plain<|endoftext|>", "<|endoftext|>", "x\ty\n\nz",
    "a \n  b \n", " lead  double   triple ", "trail ", "a▁b", "<0x41> <s> </s>", "\x00 nul", "é ﬁ   x", "👨‍👩‍👧 family", "it's we'll 'tis '' !'s", "ꟑ ͸ 𐖀 new letters", "\xa0 nbsp\xa0a", "tab \t b", "Hello, World! it's ÉCOLE école 123", "x y z " * 9,
]
ROWS = [*enumerate(TEXTS), (3, "one"), (3, "one"), (None, "one two three"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "clash", 1) for k, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, block string, at int").repartition(3)


@pytest.fixture(scope="module")
def small(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables here")
    return spark.read.parquet(path)


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple(map(str, r)))


# 11


def aligned(rows):
    """Whole texts, two pointers, dictionaries."""
    import sentencepiece
    from tokenizers import Tokenizer

    from quillspark.llm.alignment import byte_letters

    a_file, b_file, letters = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES), byte_letters()
    a_file.encode_special_tokens = True
    found, counts = [], collections.Counter()
    for key, text in rows:
        ids, links, groups = ([], []), [], []
        if text:
            ids = a_file.encode(" " + text, add_special_tokens=False).ids, b_file.encode(text)
            raw = [[bytes(letters[c] for c in a_file.id_to_token(i)) for i in ids[0]], [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b_file.id_to_piece, ids[1])]]
            if any(b"".join(r) != (" " + text).encode() for r in raw):
                ids = ([], [])
            else:
                ends, at, start = [0, 0], [0, 0], [0, 0]
                while at[0] < len(ids[0]):
                    stop = [ends[k] + len(raw[k][at[k]]) for k in (0, 1)]
                    links.append((ids[0][at[0]], ids[1][at[1]]))
                    if stop[0] == stop[1]:
                        groups.append("|".join(",".join(map(str, ids[k][start[k] : at[k] + 1])) for k in (0, 1)))
                        start = [at[0] + 1, at[1] + 1]
                    for k in (0, 1):
                        if stop[k] == min(stop):
                            ends[k], at[k] = stop[k], at[k] + 1
        counts.update(links)
        found.append((key, len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = collections.defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(k, a, b, g, len(l), sum(counts[x] == best[x[1]] for x in l), sum(counts[x] for x in l), h) for k, a, b, g, l, h in found]


@pytest.mark.parametrize("options", [{}, {"stripes": 7, "block_chars": 3000}])
def test_alignment(docs, small, options):
    from quillspark.llm.alignment import align_tokens

    for df in (docs, small):
        assert ordered(align_tokens(df, BYTES, PIECES, **options).collect()) == ordered(aligned(rows_of(df)))
    assert align_tokens(docs.where("false"), BYTES, PIECES).count() == 0


def test_alignment_of_one_block_and_many(docs, spark):
    """Blocks don't show in the result, and a chunk of a text that has no tokens isn't counted."""
    from quillspark.llm.alignment import align_tokens

    hot = spark.createDataFrame([(i, "the same words " * (1 + i % 3)) for i in range(300)] + [(300, "the same▁words")], "doc_id long, text string")
    want = ordered(aligned(rows_of(hot)))
    assert ordered(align_tokens(hot.repartition(5), BYTES, PIECES, block_chars=200).collect()) == want
    assert ordered(align_tokens(hot.coalesce(1), BYTES, PIECES).collect()) == want


# 12


def drawn(rows, target, percent, longest, buckets, least, seed):
    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    hashed = lambda w: [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    mine, theirs = [hashed(words(t)) for _, t in rows], collections.Counter(b for t in target for b in hashed(words(t)))
    counts = collections.Counter(b for h in mine for b in h)
    s_all, t_all = sum(counts.values()) + buckets, sum(theirs.values()) + buckets
    gain = [math.floor(1000 * math.log((theirs[b] + 1) * s_all / ((counts[b] + 1) * t_all))) for b in range(buckets)]
    out = []
    for (key, text), h in zip(rows, mine):
        u = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in h)
        out.append([key, len(h), weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296))), len(words(text)) >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[1]))
    rank = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


@pytest.mark.parametrize("percent,longest,buckets,least", [(10, 1, 10000, 20), (50, 2, 100, 2), (100, 3, 10, 0)])
def test_importance(docs, small, spark, percent, longest, buckets, least):
    from quillspark.llm.importance import resample

    target = spark.createDataFrame([("Hello World 123",), (None,), ("the words, the WORDS",)], "text string")
    for df in (docs, small):
        got = resample(df, target, percent=percent, longest=longest, buckets=buckets, least_words=least, seed=7)
        assert ordered(got.collect()) == ordered(drawn(rows_of(df), [r[0] for r in target.collect()], percent, longest, buckets, least, 7))
    assert resample(docs.where("false"), target).count() == 0
    assert resample(docs, target.where("false")).count() == len(ROWS)


def test_importance_equals_its_sql(spark):
    import duckdb

    from quillspark.llm.queries import OP12_SQL, op12_importance

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    theirs = con.sql(f"SELECT doc_id, n_features, weight, score, rank FROM ({OP12_SQL})").fetchall()
    assert ordered(op12_importance(spark, sf).select("doc_id", "n_features", "weight", "score", "rank").collect()) == ordered(theirs)


def test_ranks_of_many_equal_rows(spark):
    from pyspark.sql import functions as F

    from quillspark.llm.importance import ranked

    rows = spark.range(0, 5000, 1, 7).select((F.col("id") % 3 == 0).cast("int").alias("score"), F.col("id").alias("row"))
    placed, n = ranked(rows, [F.desc("score"), F.asc("row")])
    got = sorted(placed.select("place", "score", "row").collect())
    assert n == 5000 and [r["place"] for r in got] == list(range(1, 5001))
    assert [(r["score"], r["row"]) for r in got] == sorted(((r["score"], r["row"]) for r in got), key=lambda x: (-x[0], x[1]))


# 13


@pytest.mark.parametrize("block_chars", [1 << 24, 300])
def test_token_counts(docs, small, block_chars):
    from tokenizers import Tokenizer

    from quillspark.llm.token_counts import count_tokens

    whole = Tokenizer.from_file(BYTES)
    for df, limit in ((docs, 3), (small, 512)):
        want = [(k, len((t or "").encode()), n := len(whole.encode(t or "", add_special_tokens=False)), n > limit) for k, t in rows_of(df)]
        assert ordered(count_tokens(df, BYTES, P.PATTERN, limit=limit, block_chars=block_chars).collect()) == ordered(want)
    assert count_tokens(docs.where("false"), BYTES, P.PATTERN).count() == 0


def test_characters_of_other_classes_are_left_to_the_tokenizer():
    from quillspark.llm.token_counts import PreTokens

    pre = PreTokens(BYTES, P.PATTERN)
    for text in TEXTS:
        pieces = pre.split(text or "")
        if pieces is not None:
            assert "".join(pieces) == (text or "")
            assert sum(pre.lengths(pieces)) == len(pre.tokenizer.encode(text or "", add_special_tokens=False))


def test_a_pre_token_is_counted_once():
    """Equal pre-tokens of all blocks of a shard are given to the tokenizer once; a bound on what is known changes no number."""
    import pyarrow as pa

    from quillspark.llm import token_counts
    from quillspark.llm.blocks import packed, unpacked

    pieces = [["a", " stone", "xyzzyx"], ["a", " stone"], ["xyzzyx", " water", "a"]]
    batch = pa.RecordBatch.from_pydict({"shard": pa.array([0, 0, 0], pa.int32()), "block": [1, 2, 3], "at": pa.array([0, 0, 0], pa.int32()), "pieces": [packed({"piece": p}) for p in pieces]})
    given, lengths = [], token_counts.PreTokens.lengths
    token_counts.PreTokens.lengths = lambda self, some: given.extend(some) or lengths(self, some)
    try:
        out = [token_counts._count(BYTES, P.PATTERN, known)(iter([batch.slice(0, 2), batch.slice(2)])) for known in (1 << 19, 2)]
        wide, narrow = ([unpacked(raw).column(0).to_pylist() for b in o for raw in b.column(2).to_pylist()] for o in out[:1] * 1 + [out[1]])
        once = sorted(given[:4])
    finally:
        token_counts.PreTokens.lengths = lengths
    assert once == sorted({"a", " stone", "xyzzyx", " water"}) and wide == narrow and wide[0][:2] == [1, 1]


def test_very_long_texts(spark):
    """Megabytes of one text, with and without spaces."""
    from tokenizers import Tokenizer

    from quillspark.llm.alignment import align_tokens
    from quillspark.llm.importance import resample
    from quillspark.llm.token_counts import count_tokens

    rows = [(1, "long words of a text, again " * 80000), (2, "x1y" * 20000), (3, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = Tokenizer.from_file(BYTES)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in count_tokens(df, BYTES, P.PATTERN).collect()) == [(k, len(whole.encode(t, add_special_tokens=False))) for k, t in rows]
    assert ordered(align_tokens(df, BYTES, PIECES).collect()) == ordered(aligned(rows))
    assert {r["doc_id"]: r["n_features"] for r in resample(df, df).collect()} == {1: 480000, 2: 1, 3: 1}
