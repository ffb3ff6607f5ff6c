"""Quality by an interpolated modified Kneser-Ney model of bytes.

An n-gram is six bytes of UTF-8, packed into one integer; none is folded. The model is trained on every
trusted document: tables of Spark hold the counts of its n-grams and of their shorter continuations, which grow
with the trusted text. Counts and questions meet in shards by the two bytes before the last, so that an n-gram,
its contexts and its continuations of three bytes or more are in one shard. For scoring, a block of documents is
written to the shared folder and asks each shard for its distinct n-grams once; the shard's answers travel back
to the block, which adds up its documents. Texts fall into two folds by their hash, and a document of either
is scored by the model of the other fold's trusted texts, so that thresholds come from texts that their model
has not seen, as it has not seen the others. A document is kept if its log perplexity is no higher than its
language's threshold, a quantile of the trusted documents' own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import Stored, arrow_folder, fresh_worker, trim

#: Bytes of an n-gram, marks of a text's start and end (no bytes of UTF-8), values of a byte.
ORDER, START, END, VALUES = 6, 0xFF, 0xFE, 256
#: Orders held by every shard: at most 256 + 65536 n-grams whatever the corpus.
SHORT = (1, 2)
_STEP_DOCS, _STEP_BYTES, _STEP_GRAMS = 1000, 1 << 20, 1 << 20
_BLOCK_BYTES, _BLOCK_GRAMS = 1 << 26, 1 << 22
#: n-grams of the highest order in a shard, n-grams asked of one task, steps of a nat in which answers travel.
_SHARD_GRAMS, _TASK_ASKS, _STEPS = 1 << 17, 1 << 24, 1024


def shard_of(gram, shards: int):
    """The shard of n-grams of three bytes or more; for integers, numpy arrays of them and columns alike."""
    if isinstance(gram, Column):
        return F.shiftright((F.shiftright(gram, 8).bitwiseAND(0xFFFF) * 40503) % 65536 * shards, 16).cast("int")
    return (((gram >> 8) & 0xFFFF) * 40503 % 65536 * shards) >> 16


def _slices(batches, text_at: int):
    """Slices of Arrow batches of a bounded number of documents and bytes (a longer text is alone), with lengths and bytes of their texts (null: empty)."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        texts = batch.column(text_at)
        texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
        if not len(texts):
            continue
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(texts):
            end = min(at + _STEP_DOCS, max(at + 1, int(np.searchsorted(offsets, offsets[at] + _STEP_BYTES, "right")) - 1), len(texts))
            yield batch.slice(at, end - at), np.diff(offsets[at : end + 1]), data[offsets[at] : offsets[end]]
            at = end


def _grams(lengths, data):
    """(n-grams, whose) of texts laid end to end, a bounded number at a time; texts without bytes have none."""
    import numpy as np

    some = np.flatnonzero(lengths)
    if not len(some):
        return
    room = lengths[some] + ORDER
    begin = np.cumsum(room) - room
    laid = np.full(int(room.sum()), START, np.uint8)
    first = np.cumsum(lengths[some]) - lengths[some]
    if len(some) == 1:
        laid[ORDER - 1 : -1] = data
    else:
        laid[np.arange(len(data)) + np.repeat(begin + ORDER - 1 - first, lengths[some])] = data
    laid[begin + room - 1] = END
    ends = np.cumsum(lengths[some] + 1)
    for a in range(0, int(ends[-1]), _STEP_GRAMS):
        nth = np.arange(a, min(a + _STEP_GRAMS, int(ends[-1])))
        whose = np.searchsorted(ends, nth, "right")
        low = a + (ORDER - 1) * int(whose[0])
        piece = laid[low : int(nth[-1]) + (ORDER - 1) * int(whose[-1]) + ORDER].astype(np.int64)
        gram = np.zeros(len(piece) - ORDER + 1, np.int64)
        for j in range(ORDER):
            gram = gram << 8 | piece[j : j + len(gram)]
        yield gram[nth + (ORDER - 1) * whose - low], some[whose]


def _learn(batches):
    """(fold, text) to (gram, n0, n1): counts of the n-grams in the texts of either fold."""
    import numpy as np
    import pyarrow as pa

    fresh_worker()
    for rows, lengths, data in _slices(batches, 1):
        folds = rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for gram, whose in _grams(lengths, data):
            order = np.argsort(gram)
            gram, second = gram[order], folds[whose[order]]
            first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
            n, n1 = np.diff(np.r_[first, len(gram)]), np.add.reduceat(second, first)
            for at in range(0, len(first), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 65536]) for x in (gram[first], n - n1, n1)], names=["gram", "n0", "n1"])
    trim()


def fold(text_hash: Column) -> Column:
    return text_hash.bitwiseAND(1)


def ngrams(trusted: DataFrame, text: str = "text") -> dict[int, Stored]:
    """For each order gram, n0, n1 of every n-gram of the texts of folds 0 and 1.

    Counts of the highest order say how often an n-gram occurs, those of shorter ones what stands before them.
    """
    t = F.col(text).cast("string")
    made = trusted.select(fold(F.xxhash64(t)).cast("int").alias("fold"), t.alias("text")).mapInArrow(_learn, "gram bigint, n0 bigint, n1 bigint")
    levels = {ORDER: Stored(made.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), f"ngrams-{ORDER}")}
    for k in range(ORDER - 1, 0, -1):
        shorter = levels[k + 1].df.groupBy(F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram"))
        levels[k] = Stored(shorter.agg(F.count_if(F.col("n0") > 0).alias("n0"), F.count_if(F.col("n1") > 0).alias("n1")), f"ngrams-{k}")
    return levels


def discounts(levels: dict[int, Stored]) -> dict[int, list[list[float]]]:
    """Modified Kneser-Ney's D1, D2, D3+ of each order and fold, from how many n-grams occur one to four times."""
    rows = None
    for k, level in levels.items():
        row = level.df.agg(F.lit(k).alias("k"), *(F.count_if(F.col(n) == c).alias(f"{n}_{c}") for n in ("n0", "n1") for c in (1, 2, 3, 4)))
        rows = row if rows is None else rows.unionByName(row)
    out: dict[int, list[list[float]]] = {}
    for k, *seen in rows.collect():  # a row for each order
        out[k] = []
        for n1, n2, n3, n4 in (seen[:4], seen[4:]):
            y = n1 / (n1 + 2 * n2) if n1 else 0.5
            raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
            out[k].append([min(max(d, 0.05), c + 0.95) for c, d in enumerate(raw)])
    return out


class Model:
    """Probabilities of n-grams in either fold, from counts: {order: (gram, n0, n1)}, arrays in any order.

    All orders are interpolated, the shortest with 1 / VALUES. An order without the n-gram's context says nothing.
    """

    def __init__(self, counts: dict, gone: dict[int, list[list[float]]]):
        import numpy as np

        self.levels = {}
        for k in range(1, ORDER + 1):
            gram, *ns = counts[k]
            order = np.argsort(gram)
            gram = gram[order]
            if not len(gram):
                continue
            context = gram >> 8
            first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
            of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(gram)]))
            low, p, rest = self(gram & ((1 << 8 * (k - 1)) - 1), k - 1), [], []
            for f in (0, 1):
                n = ns[f][order]
                cut = np.choose(np.minimum(n, 3), [0.0, *gone[k][f]])
                total = np.add.reduceat(n, first)
                rest.append(np.where(total > 0, np.add.reduceat(cut, first) / np.maximum(total, 1), 1.0))
                p.append((n - cut) / np.maximum(total, 1)[of] + rest[f][of] * low[f])
            self.levels[k] = gram, np.stack(p), context[first], np.stack(rest)

    def __call__(self, asked, order: int = ORDER):
        """Array (2, n): each fold's probability of the last byte of n-grams of an order after those before it."""
        import numpy as np

        out = np.full((2, len(asked)), 1.0 / VALUES)
        for k in range(1, order + 1):
            if k not in self.levels:
                continue
            gram, p, contexts, rest = self.levels[k]
            want = asked & ((1 << 8 * k) - 1)
            at = np.minimum(np.searchsorted(gram, want), len(gram) - 1)
            seen = gram[at] == want
            out[:, seen] = p[:, at[seen]]
            left = np.flatnonzero(~seen)
            context = want[left] >> 8
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            known = contexts[at] == context
            out[:, left[known]] *= rest[:, at[known]]
        return out


def _pack(values, ascending: bool) -> bytes:
    """Integers as compressed bytes; ascending ones by their differences."""
    import numpy as np
    import pyarrow as pa

    if not len(values):
        return b""
    if ascending:
        values = np.diff(values, prepend=np.int64(0))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(packed: bytes, n: int, kind, ascending: bool):
    import numpy as np
    import pyarrow as pa

    if not n:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(packed, n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    values = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
    return np.cumsum(values) if ascending else values


def _ask(folder: str, shards: int):
    """(doc_id, lang, text_hash, text) to (block, shard, n, keys): writes blocks of rows to the folder, each asking each shard once for its distinct n-grams."""

    def run(batches):
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyarrow.fs import FileSystem

        fresh_worker()
        fs, path = FileSystem.from_uri(folder)
        out = None

        def merged():
            return np.unique(np.concatenate(known)) if known else np.zeros(0, np.int64)

        def told():
            out.close()
            sink.close()
            grams = merged()
            where = shard_of(grams, shards)
            parts = [(s, grams[where == s]) for s in np.unique(where)] or [(0, grams)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * len(parts), pa.int64()), pa.array([int(s) for s, _ in parts], pa.int32()), pa.array([len(g) for _, g in parts], pa.int64()), pa.array([_pack(g, True) for _, g in parts], pa.binary())],
                names=["block", "shard", "n", "keys"],
            )

        for rows, lengths, data in _slices(batches, 3):
            if out is None:
                block, size, known, loose = uuid.uuid4().int >> 65, 0, [], 0
                sink = fs.open_output_stream(f"{path}/{block}")
                out = pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3)))
            out.write_batch(rows)
            for gram, _ in _grams(lengths, data):
                known.append(np.unique(gram))
                loose += len(known[-1])
                if loose > 2 * _STEP_GRAMS:
                    known, loose = [merged()], 0
            size += len(data) + len(rows)
            if size >= _BLOCK_BYTES or known and len(known[0]) >= _BLOCK_GRAMS:
                yield from told()
                out = None
        if out is not None:
            yield from told()
        trim()

    return run


def _answer(short: dict, gone: dict[int, list[list[float]]]):
    """Rows sorted by (shard, salt, kind), a shard's counts before what it is asked, to (block, n, keys, p0, p1)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        fresh_worker()
        key, counts, model = None, [], None

        def built():
            level, *rest = (np.concatenate(x) for x in zip(*counts)) if counts else (np.zeros(0, np.int64),) * 4
            long = {k: tuple(x[level == k] for x in rest) for k in range(len(SHORT) + 1, ORDER + 1)}
            return Model(short | long, gone)

        for batch in batches:
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            keys, kinds = np.stack([column(0), column(1)], axis=1), column(2)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(keys)]):
                if tuple(keys[a]) != key:
                    key, counts, model = tuple(keys[a]), [], None
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    counts.append(tuple(part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3, 7)))
                    continue
                if model is None:
                    model, counts = built(), []
                for block, n, packed in zip(part.column(7).to_pylist(), part.column(8).to_pylist(), part.column(9)):
                    logs = [np.minimum(np.rint(-np.log(x) * _STEPS), 65535).astype(np.uint16) for x in model(_unpack(packed.as_py(), n, np.int64, True))]
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([n], pa.int64()), pa.array([packed.as_py()], pa.binary()), *(pa.array([_pack(x, False)], pa.binary()) for x in logs)], names=["block", "n", "keys", "p0", "p1"])
        trim()

    return run


def _add(folder: str):
    """(block, n, keys, p0, p1) sorted by block to (doc_id, lang, text_hash, n_symbols, nll) of the block's rows."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyarrow.fs import FileSystem

        fresh_worker()
        fs, path = FileSystem.from_uri(folder)

        def summed(block, parts):
            grams, *logs = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(grams)
            grams, logs = grams[order], np.concatenate([x[order] for x in logs])
            with fs.open_input_stream(f"{path}/{block}") as source:
                for rows, lengths, data in _slices(pa.ipc.open_stream(source), 3):
                    # a text of fold 0 takes the answers of fold 1
                    other = np.where(rows.column(2).to_numpy() & 1, 0, len(grams))
                    sums = np.zeros(len(lengths))
                    for gram, whose in _grams(lengths, data):
                        sums += np.bincount(whose, logs[np.searchsorted(grams, gram) + other[whose]], len(lengths))
                    yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(np.where(lengths > 0, lengths + 1, 0)), pa.array(sums / _STEPS)], names=["doc_id", "lang", "text_hash", "n_symbols", "nll"])

        block, parts = None, []
        for batch in batches:
            for name, n, *packed in zip(*(c.to_pylist() for c in batch.columns)):
                if name != block and block is not None:
                    yield from summed(block, parts)
                    parts = []
                block = name
                parts.append((_unpack(packed[0], n, np.int64, True), _unpack(packed[1], n, np.uint16, False), _unpack(packed[2], n, np.uint16, False)))
        if block is not None:
            yield from summed(block, parts)
        trim()

    return run


def _arrays(level: Stored):
    """(gram, n, lo, hi) of a short order."""
    import numpy as np

    rows = level.df.collect()  # at most 65536 rows
    return tuple(np.array([r[c] for r in rows], np.int64) for c in ("gram", "n0", "n1"))


def log_perplexity(docs: DataFrame, levels: dict[int, Stored], *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, lang, text_hash, n_symbols and nll (negative log likelihood by the other fold's model) of each row."""
    spark = docs.sparkSession
    folder = arrow_folder(spark, "blocks")
    gone, short = discounts(levels), {k: _arrays(levels[k]) for k in SHORT}
    shards = min(1 << 14, -(-levels[ORDER].df.count() // _SHARD_GRAMS) or 1)
    sent = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"), F.col(text).cast("string").alias("text"))
    asked = Stored(sent.mapInArrow(_ask(folder.uri, shards), "block bigint, shard int, n bigint, keys binary"), "asked")
    salts = asked.df.groupBy("shard").agg(F.ceil(F.sum("n") / _TASK_ASKS).cast("int").alias("salts"))
    counts = None
    for k in range(len(SHORT) + 1, ORDER + 1):
        one = levels[k].df.select(shard_of(F.col("gram"), shards).alias("shard"), F.lit(k).alias("k"), "gram", "n0", "n1")
        counts = one if counts is None else counts.unionByName(one)
    none, salts_of = F.lit(None), F.greatest("salts", F.lit(1))
    known = counts.join(salts, "shard").select("shard", F.explode(F.sequence(F.lit(0), salts_of - 1)).alias("salt"), F.lit(0).alias("kind"), "k", "gram", "n0", "n1", none.cast("bigint").alias("block"), none.cast("bigint").alias("n"), none.cast("binary").alias("keys"))
    wanted = asked.df.join(salts, "shard").select("shard", F.pmod(F.xxhash64("block"), salts_of).cast("int").alias("salt"), F.lit(1).alias("kind"), F.lit(0).alias("k"), *(none.cast("bigint").alias(c) for c in ("gram", "n0", "n1")), "block", "n", "keys")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # packed rows look small to Spark, which would join them into few tasks
    met = known.unionByName(wanted).repartition(tasks, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    back = met.mapInArrow(_answer(short, gone), "block bigint, n bigint, keys binary, p0 binary, p1 binary")
    sums = back.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(_add(folder.uri), "doc_id bigint, lang string, text_hash bigint, n_symbols bigint, nll double")
    done = Stored(sums, "perplexities")
    asked.drop()
    folder.drop()
    return done.df


def quantiles(values: DataFrame, by: list[str], value: Column, shares: dict[str, float], steps: int = 1000, least: int = 1) -> DataFrame:
    """Exact quantiles of value rounded up to 1/steps, for each group of at least so many values: the histogram is small whatever the table."""
    binned = values.groupBy(*by, F.ceil(value * steps).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    run = binned.withColumn("below", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    return run.where(F.col("all") >= least).groupBy(*by).agg(*(F.min(F.when(F.col("below") >= F.col("all") * q, F.col("bin") / steps)).alias(k) for k, q in shares.items()))


def classify(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", middle: float = 0.5, high: float = 0.99, spread: float = 3.0, least: float = 0.2, prior: float = 200.0, enough: int = 300, broadcast_rows: int = 4_000_000) -> DataFrame:
    """doc_id, lang, text_hash, n_symbols (bytes and an end mark), log_perplexity, threshold, kept for each row.

    labels: doc_id, quality, toxic; a document is trusted if a label gives quality 1 and toxic is not 1.
    The model is trained on all trusted documents; log_perplexity is per symbol. A text's threshold is the
    ``high`` quantile of the trusted texts of its language and length class if there are ``enough`` of them;
    else that of its length class over all languages, taken of the distances from the language's middle.
    Classes are powers of two of the length, joined from the shortest until each has ``enough``. With
    fewer than ``enough`` trusted texts in all, a high quantile is beyond what they show: then texts are
    drawn to their language's middle by ``prior`` symbols, and the threshold lies ``spread`` times the
    distance from the middle to the high quantile above the middle, and at least ``least``. A language
    without trusted texts, or a null one, takes the middle over all. Null and empty texts have no
    perplexity and are kept, and so is everything if nothing is trusted. Rows that share a doc_id are
    scored each by itself and share the label. An empty table gives no rows; other columns are ignored.
    """
    good = labels.where("quality = 1 AND coalesce(toxic, 0) <> 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("id")).distinct()
    few = good.count() <= broadcast_rows  # beyond that, rows of both sides are dealt out by id
    texts = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    levels = ngrams(texts.join(F.broadcast(good) if few else good, "id", "left_semi"))
    scored = log_perplexity(docs, levels, doc_id=doc_id, text=text, lang=lang)
    for level in levels.values():
        level.drop()
    marked = scored.join(good.withColumnRenamed("id", "doc_id").withColumn("trusted", F.lit(True)), "doc_id", "left")
    own = F.col("nll") / F.when(F.col("n_symbols") > 0, F.col("n_symbols"))
    trusted = marked.where("trusted AND n_symbols > 0")

    def by_language(value: Column, shares: dict[str, float], rows: DataFrame) -> DataFrame:
        """Quantiles of each language, and under a null one those of all."""
        return quantiles(rows.withColumn("lang", F.explode(F.array_distinct(F.array("lang", F.lit(None).cast("string"))))), ["lang"], value, shares)

    def with_language(rows: DataFrame, known: DataFrame) -> DataFrame:
        names = [c for c in known.columns if c != "lang"]
        every = known.where("lang IS NULL").select(*names).first() or [None] * len(names)
        rows = rows.join(known.where("lang IS NOT NULL"), "lang", "left")
        return rows.select(*(c for c in rows.columns if c not in names), *(F.coalesce(c, F.lit(v).cast("double")).alias(c) for c, v in zip(names, every)))

    centred = with_language(marked, by_language(own, {"centre": middle}, trusted))
    if trusted.limit(enough).count() < enough:
        drawn = F.when(F.col("n_symbols") > 0, (F.col("nll") + prior * F.coalesce("centre", own)) / (F.col("n_symbols") + prior))
        centred = centred.select("doc_id", "lang", "text_hash", "n_symbols", "trusted", drawn.alias("log_perplexity"))
        limits = by_language(F.col("log_perplexity"), {"mid": middle, "top": high}, centred.where("trusted AND n_symbols > 0"))
        done = with_language(centred, limits.select("lang", (F.col("mid") + F.greatest(spread * (F.col("top") - F.col("mid")), F.lit(least))).alias("threshold")))
    else:
        sized = centred.withColumn("size", F.when(F.col("n_symbols") > 0, F.floor(F.log2("n_symbols")).cast("int")))
        # powers of two are joined from the shortest up until each class has enough trusted texts
        classes, n = [[]], 0
        for r in sized.where("trusted AND n_symbols > 0").groupBy("size").count().orderBy("size").collect():  # at most 31 rows
            if n >= enough:
                classes, n = [*classes, []], 0
            classes[-1].append(r["size"])
            n += r["count"]
        if n < enough:
            classes[-2:] = [sum(classes[-2:], [])]
        sized = sized.withColumn("size", F.when(F.col("size").isNotNull(), sum((F.when(F.col("size") >= c[0], 1).otherwise(0) for c in classes[1:]), F.lit(0))))
        sized = sized.select("doc_id", "lang", "text_hash", "n_symbols", "trusted", "centre", "size", own.alias("log_perplexity"))
        far = sized.where("trusted AND n_symbols > 0").select("lang", "size", (F.col("log_perplexity") - F.col("centre")).alias("far"))
        of_size = quantiles(far, ["size"], F.col("far"), {"every": high})
        of_both = quantiles(far, ["lang", "size"], F.col("far"), {"one": high}, least=enough)
        done = sized.join(of_both, ["lang", "size"], "left").join(of_size, "size", "left").withColumn("threshold", F.col("centre") + F.coalesce("one", "every"))
    kept = F.coalesce(F.col("log_perplexity") <= F.col("threshold"), F.lit(True))
    return done.select("doc_id", "lang", "text_hash", "n_symbols", F.round("log_perplexity", 6).alias("log_perplexity"), "threshold", kept.alias("kept"))
