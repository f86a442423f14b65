"""Removal of lines that many documents share, by DataFrame functions only.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of at
least ``min_chars`` code points that stand in at least ``min_docs`` documents lose all their
lines except those of the largest doc_id that holds them.

Hashes of keys (two of 64 bits) are range-partitioned together with the document, so the rows
of one frequent key lie in many partitions, sorted by hash, then document (largest first), then
position. Each partition is read as a stream by a window in that order, which needs no further
sort or shuffle: a line without a predecessor of its key and document is a first occurrence and
goes on, all other lines end there. First occurrences are merged to the largest document and the
number of documents of each key, one row per key and partition before the shuffle.
The decision returns to the documents as sparse bitmaps: words of 62 lines, of which only those
with a dropped line are kept. Texts never move with the lines.

Nulls and odd cases: a null or empty text is one empty line. Rows with a null doc_id count as
one document, smaller than all others. Repeated rows of one doc_id are one document and all get
the same decision. Lines beyond any length are treated alike. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LEAST_LONG, partitions, store

WORD_BITS = 62
_SPACE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _body(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """Text that decides whether two lines are the same."""
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _UPPER.lower())


def _judged_lines(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    body = _body(text)
    numbered = F.filter(
        F.transform(_split(body), lambda x, i: F.struct(i.alias("pos"), x.alias("line"))),
        lambda s: F.length(s["line"]) >= min_chars,
    )
    lines = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(LEAST_LONG)).alias("doc"),
        F.xxhash64(body).alias("row"),
        F.inline(numbered),
    ).withColumn("k", line_key(F.col("line")))
    return lines.where(F.length("k") >= min_chars).select(
        F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("2"), "k").alias("h2"), "doc", "row", "pos"
    )


def first_occurrences(lines: DataFrame) -> DataFrame:
    """(h1, h2, doc): the first line of each key in each document, streamed from sorted ranges."""
    # the complement of a document rises where the document falls
    order = ["h1", "h2", "after", "pos"]
    slim = lines.select("h1", "h2", F.bitwise_not("doc").alias("after"), "pos")
    ordered = slim.repartitionByRange(partitions(lines.sparkSession), "h1", "h2", "after").sortWithinPartitions(*order)
    stream = Window.partitionBy("h1", "h2", "after").orderBy("pos")
    return ordered.withColumn("before", F.lag("pos").over(stream)).where(F.col("before").isNull()).select(
        "h1", "h2", F.bitwise_not("after").alias("doc")
    )


def keep_bitmaps(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """(doc, row, drops): for each document that loses lines, its words with dropped lines.

    ``drops`` maps the number of a word to its bits; bit i of word w stands for line 62*w+i.
    ``doc`` is the document (null as the smallest long), ``row`` the hash of its text.
    """
    spark = docs.sparkSession
    lines = store(_judged_lines(docs, key, text, min_chars), "line-keys")
    by_key = first_occurrences(lines).groupBy("h1", "h2").agg(
        F.max("doc").alias("keeper"), F.count(F.lit(1)).alias("docs")
    )
    # stored, so that the join sees two plain shuffles and can split a frequent key
    shared = store(by_key.where(F.col("docs") >= min_docs).select("h1", "h2", "keeper"), "shared-lines")
    dropped = lines.join(shared, ["h1", "h2"]).where(F.col("doc") != F.col("keeper"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % WORD_BITS).cast("int"))
    bits = dropped.groupBy("doc", "row", F.floor(F.col("pos") / WORD_BITS).cast("int").alias("word")).agg(
        F.bit_or(bit).alias("bits")
    )
    return bits.groupBy("doc", "row").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drops")
    )


def _is_kept(drops: Column, pos: Column) -> Column:
    word = F.element_at(drops, F.floor(pos / WORD_BITS).cast("int"))
    return F.coalesce(F.getbit(word, (pos % WORD_BITS).cast("int")), F.lit(0)) == 0


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with ``_drops`` (null: nothing dropped)."""
    marks = bitmaps.select(F.col("doc").alias("_doc"), F.col("row").alias("_row"), F.col("drops").alias("_drops"))
    keyed = docs.withColumn("_doc", F.coalesce(F.col(key).cast("long"), F.lit(LEAST_LONG))).withColumn(
        "_row", F.xxhash64(_body(text))
    )
    return keyed.join(marks, ["_doc", "_row"], "left").drop("_doc", "_row")


def kept_text(text: str) -> Column:
    """The text without its dropped lines, given ``_drops``; a null text stays null."""
    kept = F.filter(_split(_body(text)), lambda x, i: _is_kept(F.col("_drops"), i))
    return F.when(F.col("_drops").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))


def drop_repeated_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """``docs`` with the shared lines taken out of their texts; all rows and columns stay."""
    whole = docs.select(F.struct("*").alias("_all"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    marked = with_bitmaps(whole, keep_bitmaps(docs, key, text, min_chars, min_docs), "_key", "_text")
    return marked.select(F.col("_all").withField(f"`{text}`", kept_text("_text")).alias("_all")).select("_all.*")


def line_report(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """Per document: key, n_lines, n_dropped, kept_sha256."""
    slim = docs.select(key, text)
    marked = with_bitmaps(slim, keep_bitmaps(slim, key, text, min_chars, min_docs), key, text)
    dropped = F.aggregate(
        F.map_values(F.coalesce(F.col("_drops"), F.create_map().cast(T.MapType(T.IntegerType(), T.LongType())))),
        F.lit(0).cast("long"),
        lambda n, bits: n + F.bit_count(bits),
    )
    return marked.select(
        key,
        F.size(_split(_body(text))).cast("long").alias("n_lines"),
        dropped.alias("n_dropped"),
        F.sha2(F.coalesce(kept_text(text), F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents)),
shared AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.*, s.k IS NOT NULL AND l.doc_id <> s.keeper AS gone
  FROM lines l LEFT JOIN shared s USING (k))
"""

LINE_REPORT_SQL = (
    LINES_SQL
    + """
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
)
