"""Importance resampling towards a target distribution of hashed n-grams.

A DuckDB connection in each task unnests the words of a batch of texts, makes
their runs of 1 to `order` words by windows, hashes them with a registered CRC-32
and counts buckets by document. The counts are spilled to Parquet in the shared
folder. Spark merges them to one number for each bucket, for the documents and for
the target; a bucket's gain is the logarithm of their ratio. Documents are scored
from the spilled counts, a Gumbel number made of the id is added, and the highest
scores are drawn, which samples without replacement in proportion to the weights.

Scores are integers from a bounded range, so a histogram of them tells the lowest
score that is drawn; only rows from there on are sorted, in ranges, and numbered
by prefix sums over the ranges.

A null text has no words and a null id counts as no characters; repeated rows are
documents of their own. Columns other than the id and the text play no part.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.storage import save, small_batches
from tidemill.sources.tables import ROW, with_row_ids

#: A text's words: runs of what is no ASCII but digits and letters.
_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NO_WORD = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Characters that a connection takes at a time, and of a text that go in one piece.
_BATCH, _PIECE = 4_000_000, 2_000_000
_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])


def _crc(values: pa.ChunkedArray) -> pa.Array:
    return pa.array([zlib.crc32(x) for x in values.cast(pa.binary()).to_pylist()], pa.int64())


def _connection() -> duckdb.DuckDBPyConnection:
    """In memory, one thread: Spark runs a task for each core."""
    con = duckdb.connect(config={"threads": "1", "memory_limit": "600MB", "temp_directory": ""})
    con.create_function("crc", _crc, ["VARCHAR"], "BIGINT", type="arrow")
    return con


def _sql(order: int, buckets: int) -> str:
    """Counts of buckets by piece. A run is told by its last word, so that a piece can begin with words of the one before it."""
    runs = ["SELECT piece, word AS feature FROM words WHERE i > skip"]
    for k in range(2, order + 1):
        before = " || ' ' || ".join([*(f"lag(word, {j}) OVER w" for j in range(k - 1, 0, -1)), "word"])
        runs.append(f"SELECT piece, feature FROM (SELECT piece, i, skip, {before} AS feature FROM words WINDOW w AS (PARTITION BY piece ORDER BY i)) WHERE i > skip AND feature IS NOT NULL")
    return f"""
WITH lists AS (SELECT piece, skip, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_CLASS}') AS words FROM pieces),
words AS (SELECT piece, skip, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM lists),
runs AS ({" UNION ALL ".join(runs)}),
features AS (SELECT piece, feature, count(*) AS n FROM runs GROUP BY piece, feature),
hashed AS (SELECT feature, crc(feature) % {buckets} AS bucket FROM (SELECT DISTINCT feature FROM features)),
counted AS (SELECT piece, bucket, sum(n) AS n FROM features JOIN hashed USING (feature) GROUP BY piece, bucket),
found AS (SELECT piece, list(bucket::INTEGER ORDER BY bucket) AS buckets, list(n::INTEGER ORDER BY bucket) AS counts FROM counted GROUP BY piece)
SELECT piece, greatest(len(words) - skip, 0)::BIGINT AS n_words, buckets, counts FROM lists LEFT JOIN found USING (piece) ORDER BY piece
"""


def _pieces(text: str, order: int, size: int) -> Iterator[tuple[int, str]]:
    """(words to skip, text): cut between words; a later piece begins with the order - 1 words ahead of it."""
    at, ahead = 0, []
    while True:
        cut = _NO_WORD.search(text, at + size) if len(text) - at > size else None
        end = cut.start() if cut else len(text)
        yield len(ahead), " ".join([*ahead, text[at:end]])
        if not cut:
            return
        if order > 1:
            ahead = [*ahead, *(w for w in _NO_WORD.split(text[at:end]) if w)][1 - order :]
        at = end


def _counted(order: int, buckets: int, size: int):
    sql = _sql(order, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connection()
        rows: list[tuple[int, int, str]] = []
        ids: list[int | None] = []
        held = 0

        def flush() -> pa.RecordBatch:
            pieces = pa.table({"piece": pa.array(range(len(rows)), pa.int64()), "skip": pa.array([r[1] for r in rows], pa.int64()), "text": pa.array([r[2] for r in rows], pa.large_string())})
            con.register("pieces", pieces)
            found = con.execute(sql).to_arrow_table().combine_chunks().to_batches()[0]
            con.unregister("pieces")
            owner = [r[0] for r in rows]
            if len(owner) == len(ids):  # no document in more than one piece
                lists = [found[c].fill_null([]) for c in ("buckets", "counts")]
                columns = [pa.array(ids, pa.int64()), found["n_words"], pa.array(_sums(lists[1]), pa.int64()), *(x.cast(t) for x, t in zip(lists, _COUNTS.types[3:]))]
                return pa.RecordBatch.from_arrays(columns, schema=_COUNTS)
            words, sums = [0] * len(ids), [{} for _ in ids]
            for doc, n, b, c in zip(owner, found["n_words"].to_pylist(), found["buckets"].to_pylist(), found["counts"].to_pylist()):
                words[doc] += n
                for bucket, count in zip(b or (), c or ()):
                    sums[doc][bucket] = sums[doc].get(bucket, 0) + count
            each = [sorted(s.items()) for s in sums]
            columns = [ids, words, [sum(s.values()) for s in sums], [[b for b, _ in e] for e in each], [[n for _, n in e] for e in each]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _COUNTS.types)], schema=_COUNTS)

        try:
            for batch in batches:
                for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                    rows += [(len(ids), skip, part) for skip, part in _pieces(text or "", order, size)]
                    ids.append(doc_id)
                    held += len(text or "") + 100
                    if held >= _BATCH:
                        yield flush()
                        rows, ids, held = [], [], 0
            if ids:
                yield flush()
        finally:
            con.close()

    return run


def _sums(lists: pa.ListArray) -> np.ndarray:
    ends = np.concatenate([[0], np.cumsum(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)])
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return ends[offsets[1:]] - ends[offsets[:-1]]


def bucket_counts(df: DataFrame, id_col: str, order: int = 1, buckets: int = 10_000, piece: int = _PIECE) -> DataFrame:
    """doc_id, n_words, n_features, buckets, counts of every row, as a stored table."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return save(rows.mapInArrow(_counted(order, buckets, piece), "doc_id long, n_words long, n_features long, buckets array<int>, counts array<int>"), "buckets")


def _merged(counts: DataFrame) -> DataFrame:
    each = counts.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    return each.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").cast("double").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = 10_000, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln of the smoothed ratio of target to raw) of each bucket: an array of `buckets` numbers."""
    n = np.zeros((2, buckets))
    for i, counts in enumerate((raw, target)):
        for bucket, count in _merged(counts).collect():  # a row for each bucket at most
            n[i, bucket] = count
    (s, t), (all_s, all_t) = n, n.sum(axis=1)
    ratio = (t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))
    return np.array([math.floor(scale * math.log(x)) for x in ratio], np.int64)


def _weighed(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, n_words, n_features, buckets, counts = batch.columns
            if batch.num_rows:
                ends = np.concatenate([[0], np.cumsum(gain[buckets.flatten().to_numpy()] * counts.flatten().to_numpy(), dtype=np.int64)])
                offsets = buckets.offsets.to_numpy() - buckets.offsets[0].as_py()
                n = n_features.to_numpy()
                weight = np.where(n > 0, (ends[offsets[1:]] - ends[offsets[:-1]]) // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([doc_id, n_words, n_features, pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return run


def _noise(doc_id: Column, seed: str, scale: int) -> Column:
    """A floored, scaled Gumbel number from the first 32 bits of a hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(docs: DataFrame, target: DataFrame, target_id: str = "item_id", order: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024", scale: int = 1000) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; rank is null where it isn't drawn.

    Of the documents with least_words words or more, floor(percent * N / 100) with
    the highest scores are drawn; of equal scores those with smaller ids (a null id
    is the smallest). No documents, or a target without words, are no error: gains
    then come from the smoothing alone.
    """
    raw = bucket_counts(docs, "doc_id", order, buckets)
    gain = gains(raw, bucket_counts(target, target_id, order, buckets), buckets, scale)
    weighed = raw.mapInArrow(_weighed(gain), "doc_id long, n_words long, n_features long, weight long")
    scored = save(weighed.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed, scale)), "scores")
    # A score is a floored logarithm of counts plus one of 32 bits, so there are no more than some hundred thousand.
    rows = scored.filter(F.col("n_words") >= least_words).groupBy("score").agg(F.count("*").alias("n")).collect()
    histogram = sorted(((r["score"], r["n"]) for r in rows), reverse=True)
    wanted, lowest, seen = percent * sum(n for _, n in histogram) // 100, None, 0
    for score, n in histogram:
        if seen >= wanted:
            break
        lowest, seen = score, seen + n
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if lowest is None:
        return scored.select(*names, none)
    high = (F.col("n_words") >= least_words) & (F.col("score") >= lowest)
    # The place keeps apart rows that are alike, so that ranges can divide them.
    ordered = scored.filter(high).withColumn("at", F.monotonically_increasing_id())
    ordered = with_row_ids(ordered.orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "at"))
    drawn = ordered.select(*names, F.when(F.col(ROW) < wanted, F.col(ROW) + 1).alias("rank"))
    return scored.filter(~high).select(*names, none).unionByName(drawn)


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    out = draw(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


_ORACLE = rf"""
WITH steps AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)),
crc AS (SELECT list(v ORDER BY i) AS t FROM steps),
d AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_CLASS}') AS words FROM documents),
dw AS (SELECT doc, unnest(words) AS word FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_CLASS}')) AS word FROM benchmark),
h AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
b AS (SELECT word, xor(list_reduce(list_prepend(4294967295, [('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT FOR i IN range(len(x) // 2)]), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, crc),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN b USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN b USING (word) GROUP BY bucket),
g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT doc, sum(gain) AS total, count(*) AS n FROM dw JOIN b USING (word) JOIN g USING (bucket) GROUP BY doc),
z AS (SELECT doc, doc_id, len(words) AS n_words, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE floor(total / n)::BIGINT END AS weight,
  ('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM d LEFT JOIN w USING (doc)),
c AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM z),
r AS (SELECT doc, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS place, 10 * count(*) OVER () // 100 AS wanted FROM c WHERE n_words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= wanted THEN place END AS rank, n_words::BIGINT AS n_words FROM c LEFT JOIN r USING (doc)
"""


QUERIES = {"op11_importance_resampling": op11_importance_resampling}
ORACLES = {"op11_importance_resampling": _ORACLE}
