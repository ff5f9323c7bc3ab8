"""Language-model scores by prediction by partial matching over bytes, trained on the corpus itself.

A text's words, lower-cased and with one space between, are a sequence of bytes that an end symbol closes. Each symbol is predicted from
the bytes before it: by the longest context in the trie that has seen it, after an escape from each longer one, and without the
symbols that the longer context could have given (symbol exclusion). Method D: of a context with total T and q different symbols,
each symbol with count c has (2 c - 1) / (2 T), and the escape has q / (2 T). The trie holds every context of up to ``order`` bytes of
all training texts; longest contexts count occurrences, shorter ones the different longer contexts that they end (update exclusion).

The trie grows with the corpus, so it is a set of tables, a node being a context as a number, and never sent whole to a task. A
block of texts asks for the different (context, symbol) pairs in it, bucket by bucket of their hashes; the buckets are where
training counts meet and where the answers are given; the answers come back to the block, which sums up its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataprobe.llm.common import Words, map_arrow, materialize, mix64, pieces

ORDER = 5
END, SYMBOLS, SYMBOL_BITS = 256, 257, 9
#: Bytes of text in a block, and of text for each bucket of requests.
BLOCK_BYTES, BUCKET_BYTES = 16 << 20, 64 << 20
GRAM, WORD = 0, 1


def byte_grams(words: Words, order: int) -> tuple[np.ndarray, np.ndarray]:
    """``(grams, first)``: for each symbol of each text its context and itself, as ``context * 2^9 + symbol``; text ``d`` has
    those from ``first[d]`` to ``first[d + 1]``. Before a text stand spaces."""
    counts = words.counts()
    some = np.flatnonzero(counts)
    length = np.ones(len(counts), dtype=np.int64)
    length[some] = words.to[words.first[some + 1] - 1] + 1 - words.at[words.first[some]]
    first = np.concatenate([[0], np.cumsum(length)])
    stream = np.full(first[-1] + order * len(length), 0x20, dtype=np.uint16)
    place = np.arange(first[-1]) + np.repeat(order * np.arange(1, len(length) + 1), length)
    ends = first[1:] - 1 + order * np.arange(1, len(length) + 1)
    written = np.ones(first[-1], dtype=bool)
    written[first[:-1][counts == 0]] = False
    stream[place[written]] = words.text
    stream[ends] = END
    grams = stream.astype(np.uint64)
    for back in range(1, order + 1):
        grams[back:] |= stream[:-back].astype(np.uint64) << np.uint64(SYMBOL_BITS + 8 * (back - 1))
    return grams[place], first


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers in byte planes, compressed."""
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.decompress(blob[8:], 8 * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<i8")


def _pack_floats(values: np.ndarray) -> bytes:
    return pa.compress(values.astype("<f4").tobytes(), codec="zstd", asbytes=True)


def _unpack_floats(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, 4 * n, codec="zstd", asbytes=True), dtype="<f4")


def _pack_words(words: pa.Array) -> bytes:
    """Binary values: their lengths, then their bytes."""
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False)
    head, body = _pack(lengths), pa.compress(pc.binary_join(
        pa.ListArray.from_arrays(pa.array([0, len(words)], type=pa.int32()), words), pa.scalar(b"", type=pa.binary()))[0].as_py()
        or b" ", codec="zstd", asbytes=True)
    return len(head).to_bytes(8, "little") + head + body


def _unpack_words(blob: bytes) -> pa.Array:
    cut = 8 + int.from_bytes(blob[:8], "little")
    offsets = np.concatenate([[0], np.cumsum(_unpack(blob[8:cut]))]).astype(np.int32)
    body = pa.decompress(blob[cut:], max(int(offsets[-1]), 1), codec="zstd")
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), body])


def _words_of(words: Words) -> pa.Array:
    """The words as binary values, one after another."""
    solid = words.text[words.text != 0x20]
    offsets = np.concatenate([[0], np.cumsum(words.to - words.at)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(words.at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(solid.tobytes())])


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and the sum of the counts of each."""
    every, number = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every)
    every, number = every[order], number[order]
    begins = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, dtype=np.int64)
    return every[begins], np.add.reduceat(number, begins) if len(begins) else number


def _counted_grams(grams: np.ndarray, trains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different grams and how often they occur in training texts."""
    known, counts = np.unique(grams[trains], return_counts=True)
    other = np.unique(grams[~trains])
    return _summed([known, other], [counts, np.zeros(len(other), dtype=np.int64)])


def _looked_up(gram: np.ndarray, value: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The value of each symbol's gram; ``gram`` is in order. Each different gram is searched once."""
    coded = pa.array(symbols).dictionary_encode()
    return value[np.searchsorted(gram, coded.dictionary.to_numpy())][coded.indices.to_numpy()]


def _word_buckets(words: pa.Array, buckets: int) -> np.ndarray:
    """A bucket for each word; the end, which is the empty one here, is in the first."""
    joined = pa.array([b" ".join(words.to_pylist()).decode("utf-8", "surrogateescape").encode("utf-8", "replace")], type=pa.binary())
    filled = np.flatnonzero(pc.binary_length(words).to_numpy(zero_copy_only=False))
    out = np.zeros(len(words), dtype=np.int64)
    out[filled] = (Words(joined).hashes() % np.uint64(buckets)).astype(np.int64)
    return out


class _Block:
    """What a block of texts asks for: different grams and words, each with its count in training texts."""

    def __init__(self, order: int):
        self.order, self.bytes = order, 0
        self.grams: list[np.ndarray] = []
        self.gram_counts: list[np.ndarray] = []
        self.words: list[pa.Array] = []
        self.word_counts: list[np.ndarray] = []

    def add(self, texts: pa.Array, trains: np.ndarray) -> None:
        words = Words(texts, lower=True)
        self.bytes += len(words.text)
        grams, first = byte_grams(words, self.order)
        keys, counts = _counted_grams(grams, np.repeat(trains, np.diff(first)))
        self.grams.append(keys)
        self.gram_counts.append(counts)
        coded = _words_of(words).dictionary_encode()
        owners = np.repeat(trains, words.counts())
        counts = np.bincount(coded.indices.to_numpy(zero_copy_only=False)[owners], minlength=len(coded.dictionary))
        self.words.append(pa.concat_arrays([coded.dictionary, pa.array([b""], type=pa.binary())]))
        self.word_counts.append(np.append(counts, trains.sum()).astype(np.int64))
        if len(self.grams) > 16:        # many short pieces
            self._merge()

    def _merge(self) -> None:
        keys, counts = _summed(self.grams, self.gram_counts)
        self.grams, self.gram_counts = [keys], [counts]
        coded = pa.concat_arrays(self.words).dictionary_encode()
        totals = np.zeros(len(coded.dictionary), dtype=np.int64)
        np.add.at(totals, coded.indices.to_numpy(zero_copy_only=False), np.concatenate(self.word_counts))
        self.words, self.word_counts = [coded.dictionary], [totals]

    def requests(self, buckets: int) -> Iterator[tuple[int, int, bytes, bytes]]:
        """``(kind, bucket, keys, counts)``"""
        if not self.grams:
            return
        self._merge()
        (grams,), (counts,) = self.grams, self.gram_counts
        mine = (mix64(grams) % np.uint64(buckets)).astype(np.int64)
        for bucket in np.unique(mine).tolist():
            at = np.flatnonzero(mine == bucket)
            yield GRAM, bucket, _pack(np.diff(grams[at].astype(np.int64), prepend=0)), _pack(counts[at])
        (words,), (counts,) = self.words, self.word_counts
        mine = _word_buckets(words, buckets)
        for bucket in np.unique(mine).tolist():
            at = np.flatnonzero(mine == bucket)
            yield WORD, bucket, _pack_words(words.take(pa.array(at))), _pack(counts[at])


def _blocks_and_requests(texts: DataFrame, order: int, buckets: int) -> DataFrame:
    """The rows of ``texts (row, train, text)`` with their ``block``, and what each block asks for, in one table: a request has a
    ``kind``, a ``bucket``, ``keys`` and ``counts``, and a text has none of them."""
    schema = T.StructType([T.StructField(name, kind, True) for name, kind in (
        ("block", T.LongType()), *[(c, texts.schema[c].dataType) for c in ("row", "train", "text")], ("kind", T.IntegerType()),
        ("bucket", T.IntegerType()), ("keys", T.BinaryType()), ("counts", T.BinaryType()))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, block = TaskContext.get().partitionId(), 0, _Block(order)
        like: pa.RecordBatch | None = None

        def rows(n: int, at: int, given: dict[str, pa.Array], more: dict[str, pa.Array]) -> pa.RecordBatch:
            columns = {"block": pa.array(np.full(n, at), type=pa.int64())}
            columns |= {c: given[c] if c in given else pa.nulls(n, like[c].type) for c in ("row", "train", "text")}
            for c, kind in (("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())):
                columns[c] = more[c].cast(kind) if c in more else pa.nulls(n, kind)
            return pa.record_batch(columns)

        def close() -> Iterator[pa.RecordBatch]:
            for kind, bucket, keys, counts in block.requests(buckets):
                yield rows(1, task << 32 | number, {}, {"kind": pa.array([kind]), "bucket": pa.array([bucket]),
                                                        "keys": pa.array([keys]), "counts": pa.array([counts])})

        for piece in pieces(batches, "text"):
            like = piece
            block.add(piece["text"], piece["train"].to_numpy(zero_copy_only=False))
            yield rows(piece.num_rows, task << 32 | number, {c: piece[c] for c in ("row", "train", "text")}, {})
            if block.bytes >= BLOCK_BYTES:
                yield from close()
                number, block = number + 1, _Block(order)
        yield from close()

    return materialize(texts.mapInArrow(deal, schema), "blocks")


def _gram_counts(requests: DataFrame) -> DataFrame:
    """``(bucket, gram, c)`` for each gram that a block asks for; c is 0 if no training text has it."""
    def count(table: pa.Table) -> pa.Table:
        keys, counts = _summed([np.cumsum(_unpack(x)) for x in table["keys"].to_pylist()],
                               [_unpack(x) for x in table["counts"].to_pylist()])
        return pa.table({"bucket": pa.array(np.full(len(keys), table["bucket"][0].as_py()), type=pa.int32()),
                         "gram": pa.array(keys), "c": pa.array(counts)})

    return materialize(requests.select("bucket", "keys", "counts").groupBy("bucket").applyInArrow(
        count, "bucket int, gram long, c long"), "grams")


def _word_answers(requests: DataFrame) -> DataFrame:
    """``(block, keys, counts, n_distinct, n_tokens)``: each request with its words' counts in all training texts; the first row of a
    bucket also has the bucket's number of different words in training texts, and of words."""
    def answer(table: pa.Table) -> pa.Table:
        asked = table["keys"].to_pylist()
        words = [_unpack_words(x) for x in asked]
        coded = pa.concat_arrays(words).dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        totals = np.zeros(len(coded.dictionary), dtype=np.int64)
        np.add.at(totals, index, np.concatenate([_unpack(x) for x in table["counts"].to_pylist()]))
        ends = np.cumsum([len(w) for w in words])
        counts = [_pack(totals[part]) for part in np.split(index, ends[:-1])]
        first = np.arange(len(asked)) == 0
        return pa.table({"block": table["block"], "keys": pa.array(asked, type=pa.binary()), "counts": pa.array(counts, type=pa.binary()),
                         "n_distinct": pa.array(np.where(first, (totals > 0).sum(), 0)),
                         "n_tokens": pa.array(np.where(first, totals.sum(), 0))})

    return materialize(requests.select("block", "bucket", "keys", "counts").groupBy("bucket").applyInArrow(
        answer, "block long, keys binary, counts binary, n_distinct long, n_tokens long"), "word-answers")


def trie_levels(grams: DataFrame, order: int) -> list[DataFrame]:
    """For each context length from 0 to ``order`` the trie's ``(gram, c)``: how often a symbol follows a context in training
    texts, or, below ``order``, how many different bytes before the context that happens with."""
    levels = [grams.where("c > 0").select("gram", "c")]
    for length in range(order - 1, -1, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << (SYMBOL_BITS + 8 * length)) - 1))
        levels.append(materialize(levels[-1].groupBy(shorter.alias("gram")).agg(F.count("*").alias("c")), f"trie-{length}"))
    return levels[::-1]


def trie_nodes(levels: list[DataFrame]) -> list[DataFrame]:
    """For each context length the nodes ``(context, total, q, below)``: the sum of the context's counts, how many different symbols
    follow it, and the sum of these symbols' counts in the context that is one byte shorter (which an escape from here excludes)."""
    nodes = []
    for length, level in enumerate(levels):
        rows = level.withColumn("below", F.lit(0).cast("long"))
        if length:
            shorter = F.col("gram").bitwiseAND(F.lit((1 << (SYMBOL_BITS + 8 * (length - 1))) - 1))
            rows = level.withColumn("shorter", shorter).join(
                levels[length - 1].select(F.col("gram").alias("shorter"), F.col("c").alias("below")), "shorter")
        nodes.append(materialize(rows.groupBy(F.shiftright("gram", SYMBOL_BITS).alias("context")).agg(
            F.sum("c").alias("total"), F.count("*").alias("q"), F.sum("below").alias("below")), f"nodes-{length}"))
    return nodes


def gram_scores(grams: DataFrame, order: int) -> DataFrame:
    """``(bucket, gram, score)``: log10 of the probability of each gram's symbol in its context."""
    levels = trie_levels(grams, order)
    nodes = trie_nodes(levels)
    context = F.shiftright("gram", SYMBOL_BITS)
    known = grams.where("c > 0").withColumn("context", context).join(nodes[order], "context").select(
        "bucket", "gram", F.log10((2 * F.col("c") - 1) / (2 * F.col("total"))).alias("score"))
    # What has no count in its longest context goes down, level by level. ``lost`` adds up the escapes; what the last context
    # that exists excludes is out_c occurrences of out_q symbols.
    open_ = grams.where("c = 0").select("bucket", "gram", F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("lost"),
                                        F.lit(0).cast("long").alias("out_c"), F.lit(0).cast("long").alias("out_q"))
    for length in range(order, -1, -1):
        here = F.col("gram").bitwiseAND(F.lit((1 << (SYMBOL_BITS + 8 * length)) - 1))
        open_ = open_.withColumn("here", here).withColumn("context", F.shiftright("here", SYMBOL_BITS)).join(
            levels[length].withColumnRenamed("gram", "here"), "here", "left").join(nodes[length], "context", "left")
        left = F.col("q") - F.col("out_q")
        rest = 2 * (F.col("total") - F.col("out_c"))
        escape = F.when(left > 0, F.log10(left / rest)).otherwise(0.0)      # where all is excluded, the escape is sure
        here_known = F.col("score").isNull() & F.col("c").isNotNull()
        open_ = open_.select(
            "bucket", "gram", F.when(here_known, F.col("lost") + F.log10((2 * F.col("c") - 1) / rest)).otherwise(F.col("score")).alias("score"),
            F.when(F.col("q").isNotNull(), F.col("lost") + escape).otherwise(F.col("lost")).alias("lost"),
            F.coalesce("below", "out_c").alias("out_c"), F.coalesce("q", "out_q").alias("out_q"))
    last = F.col("lost") - F.log10(F.lit(float(SYMBOLS)) - F.col("out_q"))
    return materialize(known.unionByName(open_.select("bucket", "gram", F.coalesce("score", last).alias("score"))), "gram-scores")


def _gram_answers(requests: DataFrame, scores: DataFrame) -> DataFrame:
    """``(block, keys, counts)``: each request with its grams' scores (as 32-bit floats)."""
    def answer(asked: pa.Table, table: pa.Table) -> pa.Table:
        grams, values = table["gram"].to_numpy(), table["score"].to_numpy()
        order = np.argsort(grams)
        grams, values = grams[order], values[order]
        packed = [_pack_floats(values[np.searchsorted(grams, np.cumsum(_unpack(x)))]) for x in asked["keys"].to_pylist()]
        return pa.table({"block": asked["block"], "keys": asked["keys"], "counts": pa.array(packed, type=pa.binary())})

    return requests.select("block", "bucket", "keys").groupBy("bucket").cogroup(scores.groupBy("bucket")).applyInArrow(
        answer, "block long, keys binary, counts binary")


def score_texts(docs: DataFrame, train: Column, text: str = "text", order: int = ORDER) -> DataFrame:
    """All columns of ``docs`` but the text, and ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z were lower-cased; a text's tokens are its words and one end. With the count c of a token,
    the number N of all and V of different ones in the texts where ``train`` holds (true for a row, else false or null), ``base_score`` is the
    sum over the text's tokens of log10((c + 1) / (N + 1 * (V + 1))); ``n_known`` counts the tokens with c above 0, ``train_tokens`` is N.
    ``score`` is the log10 probability that the trie gives the words with one space between and the end; each symbol's is
    rounded to 32 bits. A text that trains is scored by the whole trie, itself included.

    Null and empty texts have the end only. Rows may repeat; equal texts have equal scores. Without training texts, N and V are 0 and
    every symbol has 1/257. Columns of ``docs`` that have a new column's name are replaced. An empty table gives an empty one.
    """
    if not 1 <= order <= 6:
        raise ValueError("order must be from 1 to 6")
    spark = docs.sparkSession
    carried = [c for c in docs.columns if c.lower() != text.lower()]
    texts = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carried]).alias("row"),
                        F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    table = _blocks_and_requests(texts, order, buckets)
    words = _word_answers(table.where(F.col("kind") == WORD))
    distinct, tokens = words.agg(F.coalesce(F.sum("n_distinct"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    asked = table.where(F.col("kind") == GRAM)
    scores = gram_scores(_gram_counts(asked), order)
    answers = _gram_answers(asked, scores).withColumn("kind", F.lit(GRAM)).unionByName(
        words.select("block", "keys", "counts", F.lit(WORD).alias("kind")))
    row = table.schema["row"]
    schema = T.StructType([row] + [T.StructField(name, kind) for name, kind in (
        ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()))])

    def add_up(block: pa.Table, given: pa.Table) -> pa.Table:
        kinds = given["kind"].to_numpy()
        blobs = [(keys, counts) for keys, counts in zip(given["keys"].to_pylist(), given["counts"].to_pylist())]
        grams, values = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.float32)]
        names, counts = [pa.array([], type=pa.binary())], [np.zeros(0, dtype=np.int64)]
        for kind, (keys, found) in zip(kinds.tolist(), blobs):
            if kind == GRAM:
                grams.append(np.cumsum(_unpack(keys)))
                values.append(_unpack_floats(found, len(grams[-1])))
            else:
                names.append(_unpack_words(keys))
                counts.append(_unpack(found))
        gram, value, name, count = np.concatenate(grams), np.concatenate(values), pa.concat_arrays(names), np.concatenate(counts)
        for done in (blobs, grams, values, names, counts):
            done.clear()
        sort = np.argsort(gram)
        gram, value = gram[sort].view(np.uint64), value[sort]
        del sort
        # The count of the end is that of the empty word.
        ends = int(count[pc.index(name, pa.scalar(b"", type=pa.binary())).as_py()]) if len(name) else 0
        parts = []
        for piece in pieces(iter(block.combine_chunks().to_batches()), "text"):
            words = Words(piece["text"], lower=True)
            symbols, first = byte_grams(words, order)
            score = np.add.reduceat(_looked_up(gram, value, symbols).astype(np.float64), first[:-1])
            coded = _words_of(words).dictionary_encode()
            known = np.append(count[pc.index_in(coded.dictionary, value_set=name).to_numpy(zero_copy_only=False)], ends)
            # Each text's words and then its end.
            tokens_first = words.first + np.arange(len(words.first))
            token = np.full(tokens_first[-1], len(known) - 1)
            inner = np.ones(len(token), dtype=bool)
            inner[tokens_first[1:] - 1] = False
            token[inner] = coded.indices.to_numpy(zero_copy_only=False)
            logs = np.log10((known + 1) / (tokens + 1 * (distinct + 1)))
            parts.append(pa.table({
                "row": piece["row"], "n_tokens": pa.array(words.counts() + 1), "n_known": pa.array(np.add.reduceat(
                    (known > 0)[token].astype(np.int64), tokens_first[:-1])),
                "base_score": pa.array(np.add.reduceat(logs[token], tokens_first[:-1])), "score": pa.array(score)}))
        return pa.concat_tables(parts)

    texts = table.where("kind IS NULL").select("block", "row", "text")
    scored = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add_up, schema)
    new = {"n_tokens": F.col("n_tokens"), "n_known": F.col("n_known"), "train_tokens": F.lit(tokens).cast("long"),
           "base_score": F.col("base_score"), "score": F.col("score")}
    return scored.select(*[F.col(f"row.`{c}`").alias(c) for c in carried if c.lower() not in new],
                         *[value.alias(name) for name, value in new.items()])
