"""Resampling documents towards a target: weights from bucketed word features, then a distributed quickselect."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from watchtide.llm.texts import WordMemo, per_text
from watchtide.session import materialize, scratch_path

BUCKETS = 10_000
LONGEST_RUN = 1  # words in a feature, at most
SCALE = 1000  # gains and scores are whole thousandths
SEED = 2024
LEAST_WORDS = 20  # of a document that can be drawn
PERCENT = 10  # of those documents that are drawn
PIVOTS = 8  # keys per round of the selection
PIECE = 1 << 20  # bytes of a text that are cut into words at once

# Byte to byte: A-Z lowered; digits, a-z and all of any character beyond ASCII kept; everything else a space.
WORD_BYTES = bytes(
    b + 32 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)
KEY = ["_down", "_no_id", "_id", "_text"]  # ascending: best score first, then smallest id, then the text's hash


def features(text: bytes | None, longest: int = LONGEST_RUN) -> Iterator[list[bytes]]:
    """The features of a text in lists of bounded size: its words, and its runs of up to `longest` of them."""
    flat = (text or b"").translate(WORD_BYTES)
    at, carried = 0, []
    while at < len(flat):
        stop = flat.find(b" ", at + PIECE)
        stop = len(flat) if stop < 0 else stop
        found = flat[at:stop].split()
        words = carried + found
        for n in range(2, longest + 1):
            ends = range(max(n, len(carried) + 1), len(words) + 1)
            found = found + [b" ".join(words[end - n:end]) for end in ends]
        yield found
        at, carried = stop, words[max(0, len(words) - longest + 1):] if longest > 1 else []


def _bucket_memo(buckets: int) -> WordMemo:
    return WordMemo(lambda words: [zlib.crc32(w) % buckets for w in words])


def _bucketed(text: bytes | None, memo: WordMemo, longest: int) -> Iterator[np.ndarray]:
    for found in features(text, longest):
        known = memo.of(set(found))
        yield np.fromiter((known[f] for f in found), np.int64, len(found))


def bucket_counts(texts: DataFrame, text: str, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> np.ndarray:
    """Features per bucket over all rows. A task sends one row per bucket it met, whatever its number of texts."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, counts = _bucket_memo(buckets), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                for ids in _bucketed(value.as_py(), memo, longest):
                    np.add.at(counts, ids, 1)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], names=["bucket", "n"])

    told = texts.select(F.col(f"`{text}`").cast("binary").alias("text")).mapInArrow(tally, "bucket bigint, n bigint")
    counts = np.zeros(buckets, dtype=np.int64)
    for bucket, n in told.groupBy("bucket").agg(F.sum("n")).collect():  # at most `buckets` rows
        counts[bucket] = n
    return counts


def bucket_gains(all_counts: np.ndarray, target_counts: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in the target and in all documents, floored."""
    buckets = len(all_counts)
    held, aimed = float(all_counts.sum() + buckets), float(target_counts.sum() + buckets)
    return np.array([
        math.floor(SCALE * math.log((float(t) + 1.0) * held / ((float(s) + 1.0) * aimed)))
        for s, t in zip(all_counts, target_counts)
    ], dtype=np.int64)


def weigh(text: Column, gains: np.ndarray, longest: int = LONGEST_RUN) -> Column:
    """struct(n_features, weight): the floored mean of a text's gains, by array lookups; 0 without features."""

    def score(batch: list[bytes | None]) -> dict[str, list[int]]:
        memo = _bucket_memo(len(gains))
        sizes, weights = [], []
        for value in batch:
            n = total = 0
            for ids in _bucketed(value, memo, longest):
                n, total = n + len(ids), total + int(gains[ids].sum())
            sizes.append(n)
            weights.append(total // n if n else 0)
        return {"n_features": sizes, "weight": weights}

    return per_text(text.cast("binary"), score, "n_features bigint, weight bigint")


def gumbel(id_column: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate, floored, from 32 bits of the SHA-256 of `<seed>:<id>` (no id: of `<seed>:`)."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def kth_key(rows: DataFrame, k: int, keys: list[str]) -> Row:
    """The k-th smallest composite key (1 is the first), repeats counted: a quickselect over all tasks.

    Each round draws a few random rows of those still in question as pivots, counts exactly how many lie before
    and at each pivot, and keeps only the rows strictly between the two pivots around the k-th. It ends when the
    k-th is at a pivot. Rows shrink by about the number of pivots a round and are written anew each time, so all
    rounds together read little more than the first. Only pivots and counts reach the driver.
    """
    key = F.struct(*keys)
    passed, turn = 0, 0
    while True:
        drawn = rows.select(*keys).orderBy(F.xxhash64(*keys, F.lit(turn)), *keys).limit(PIVOTS).collect()
        pivots = sorted(set(drawn))
        marks = [F.struct(*(F.lit(p[c]).cast(rows.schema[c].dataType).alias(c) for c in keys)) for p in pivots]
        counts = rows.agg(*(F.count_if(key < m) for m in marks), *(F.count_if(key <= m) for m in marks)).first()
        before, upto = counts[:len(marks)], counts[len(marks):]
        above = next((i for i, n in enumerate(upto) if passed + n >= k), len(marks))
        if above < len(marks) and passed + before[above] < k:
            return pivots[above]
        between = F.lit(True) if above == len(marks) else key < marks[above]
        if above:
            between = between & (key > marks[above - 1])
            passed += upto[above - 1]
        rows, turn = materialize(rows.filter(between)), turn + 1


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with their `rank` under the keys: a sort by ranges, where each range adds the sizes of those before it."""
    path = scratch_path(rows.sparkSession, "ranked")
    place = F.monotonically_increasing_id()  # the number of the range, then that of the row within it
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", place).write.parquet(path)
    placed = rows.sparkSession.read.parquet(path).withColumn("_range", F.shiftright("_place", 33))
    sizes = sorted(placed.groupBy("_range").count().collect())  # one row per range
    starts = np.cumsum([0] + [n for _, n in sizes])
    offsets = rows.sparkSession.createDataFrame(
        [(r, int(s)) for (r, _), s in zip(sizes, starts)], "_range bigint, _start bigint"
    )
    in_range = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), "_range").withColumn("rank", F.col("_start") + in_range + 1).drop(
        "_range", "_start", "_place"
    )


def resample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text: str = "text", target_text: str = "text",
    buckets: int = BUCKETS, longest: int = LONGEST_RUN, seed: int = SEED, least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """Every row of `docs` as (`doc_id`, `n_features`, `weight`, `score`, `rank`, `text_hash`); a rank is a draw.

    A document's weight is the mean gain of its features towards the target; its score adds a Gumbel variate, so
    the highest scores are a draw without replacement by the weights. Of the documents with at least `least_words`
    words, `percent` % are drawn (floored), highest scores first, ties to the smaller id, rows without an id last,
    then by text. Others have a null rank. Null and empty texts have no features and weight 0. Equal rows are
    drawn one by one, so copies at the cut may be drawn in part. Empty tables give no rows; an empty target gives
    gains of the corpus alone. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    gains = bucket_gains(
        bucket_counts(docs, "text", buckets, longest), bucket_counts(target, target_text, buckets, longest)
    )
    words = F.col("n_features")
    if longest > 1:  # runs are counted too; n words hold n + (n-1) + ... features
        words = F.col("n_words")
        docs = docs.withColumn("n_words", weigh(F.col("text"), gains)["n_features"])
    weighed = docs.withColumn("w", weigh(F.col("text"), gains, longest)).select(
        "doc_id", "w.n_features", "w.weight", (F.col("w.weight") + gumbel(F.col("doc_id"), seed)).alias("score"),
        F.xxhash64("text").alias("text_hash"), *(["n_words"] if longest > 1 else []),
    )
    path = scratch_path(spark, "weighed")
    weighed.withColumn("eligible", words >= least_words).drop("n_words").write.parquet(path)
    weighed = spark.read.parquet(path)
    keyed = weighed.withColumns({
        "_down": -F.col("score"), "_no_id": F.col("doc_id").isNull().cast("int"),
        "_id": F.coalesce("doc_id", F.lit(0).cast(weighed.schema["doc_id"].dataType)), "_text": F.col("text_hash"),
    })
    k = weighed.filter("eligible").count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    undrawn = F.lit(None).cast("bigint").alias("rank")
    if k == 0:
        return weighed.select(*columns, undrawn, "text_hash")
    last = kth_key(keyed.filter("eligible").select(*KEY), k, KEY)
    mark = F.struct(*(F.lit(last[c]).cast(keyed.schema[c].dataType).alias(c) for c in KEY))
    wins = F.col("eligible") & (F.struct(*KEY) <= mark)
    winners = ranked(keyed.filter(wins).select(*columns, "text_hash", *KEY), KEY)
    rank = F.when(F.col("rank") <= k, F.col("rank")).alias("rank")  # copies of the last key beyond the k-th are undrawn
    return winners.select(*columns, rank, "text_hash").unionByName(
        keyed.filter(~wins).select(*columns, undrawn, "text_hash")
    )


def drawn_documents(docs: DataFrame, resampled: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that `resample` drew. Copies with equal id and text come together."""
    drawn = resampled.filter("rank IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("_hash"))
    return docs.join(drawn, same, "left_semi")


# The same in SQL, for one-word features. CRC-32 runs byte by byte over a table made from its polynomial.
ORACLE = f"""
WITH crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS entries FROM (SELECT i,
    list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
worded AS (SELECT row_number() OVER () AS n, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
aimed AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
held AS MATERIALIZED (SELECT n, unnest(words) AS word FROM worded),
sought AS MATERIALIZED (SELECT unnest(words) AS word FROM aimed),
buckets AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i::INTEGER + 1, 2))::BIGINT)),
    lambda c, b: xor(entries[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % {BUCKETS} AS bucket
    FROM (SELECT word FROM held UNION SELECT word FROM sought), crc_table),
s AS (SELECT bucket, count(*) AS s FROM held JOIN buckets USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM sought JOIN buckets USING (word) GROUP BY 1),
gains AS MATERIALIZED (SELECT bucket, floor({SCALE} * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM held) + {BUCKETS})
    / ((s + 1)::DOUBLE * ((SELECT count(*) FROM sought) + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
summed AS (SELECT n, sum(gain)::BIGINT AS total FROM held JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY 1),
scored AS (SELECT n, doc_id, n_features, weight, weight + floor(-{SCALE} * ln(-ln((h + 0.5) / 4294967296.0)))::BIGINT AS score FROM (
    SELECT n, doc_id, len(words) AS n_features, coalesce((total - ((total % len(words)) + len(words)) % len(words)) // len(words), 0) AS weight,
    ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE AS h FROM worded LEFT JOIN summed USING (n))),
placed AS (SELECT *, n_features >= {LEAST_WORDS} AS eligible, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
    CASE WHEN eligible AND place <= (SELECT count(*) FROM placed WHERE eligible) * {PERCENT} // 100 THEN place END AS rank FROM placed
"""
