"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks of words.

Each source is an endless stream: its documents in a shuffled order, repeated. The stream is cut
into blocks of equally many words. The mix is a schedule of slots, one block each: the points of a
golden-ratio lattice over all slots are mapped through the cumulative numbers of blocks that the
sources are due, so every stretch of the schedule holds each source in proportion to its target.
The slots of a source are ranked in schedule order; the slot of rank k takes block k of its stream.

Targets: sources share all words by weight; a target stops at ``most`` times the size of its source
and the excess goes to the others by weight until none is above. No document is taken more than
``most`` times, since blocks stop at the end of the last whole repetition. A source misses its
target by less than one block, which is at most 1/256 of the target (or one word).

All columns are DataFrame expressions. No group is gathered: prefix sums run over range partitions,
slots are made from their source's row in steps of at most 4096, and blocks meet slots on (source,
rank), keys that hold one slot each. One row per partition or round goes to the driver.

Odd cases: null texts have no words; documents without words are taken 0 times, and so is every
document if no text has a word. A null source is the last source. Null and repeated keys stay: each
row has its own place in the stream (rows equal in key, source and text share their places in any
order). An empty table gives an empty result. Other columns of any name are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, store
from .sharding import _INDEX_BITS, _div, _scatter, number_rows, round_keys

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK = 1024
_SHARE = 256  # blocks a target has at least, so that small targets are met as well
_FAN = 4096  # slots or groups of slots made from one row
_GOLDEN = (math.sqrt(5) - 1) / 2


def running_totals(rows: DataFrame, order: list[str], amounts: list[str], name: str) -> tuple[DataFrame, dict]:
    """``rows`` with ``before_<amount>``, the sum over all earlier rows, and the whole sums.

    Rows get a ``_at`` that is unique and grows in the given order. Partitions are stored before
    they are added up, so sums stay the same if an executor is lost.
    """
    spark = rows.sparkSession
    spread = rows.withColumn("_any", F.monotonically_increasing_id())
    placed = store(
        spread.repartitionByRange(partitions(spark), *order, "_any")
        .sortWithinPartitions(*order, "_any")
        .drop("_any")
        .withColumn("_at", F.monotonically_increasing_id()),
        name,
    ).withColumn("_part", F.shiftright("_at", _INDEX_BITS))
    total = dict.fromkeys(amounts, 0)
    starts = []
    sums = placed.groupBy("_part").agg(*[F.sum(a).alias(a) for a in amounts])
    for r in sorted(sums.collect()):  # one row per partition, whatever the number of rows
        starts.append((r["_part"], *[total[a] for a in amounts]))
        total = {a: total[a] + r[a] for a in amounts}
    fields = ", ".join(f"_start_{a} long" for a in amounts)
    offsets = F.broadcast(spark.createDataFrame(starts, f"_part long, {fields}"))
    earlier = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    before = {
        f"before_{a}": F.col(f"_start_{a}") + F.coalesce(F.sum(a).over(earlier), F.lit(0)) for a in amounts
    }
    joined = placed.join(offsets, "_part").withColumns(before)
    return joined.select(*rows.columns, "_at", *before), total


def _exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _above(rest: int, open_weight: int, most: int) -> Column:
    """Whether a share of ``rest`` by weight is more than ``most`` times the source's size."""
    return _exact(F.col("weight")) * F.lit(rest) > _exact(F.col("source_size")) * F.lit(most * open_weight)


def _level(sources: DataFrame, total: int, most: int) -> tuple[int, int]:
    """Words shared by the sources below their limit, and these sources' weight.

    Each round stops the targets that are above; a stopped one stays stopped, as the rest grows.
    """
    open_weight = sources.agg(F.sum("weight")).first()[0] or 0
    rest, before = total, None
    while open_weight and (rest, open_weight) != before:
        before = rest, open_weight
        above = _above(rest, open_weight, most)
        size, weight = sources.agg(
            F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
        ).first()
        rest, open_weight = total - most * size, weight
    return rest, open_weight


def plan_sources(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK
) -> tuple[DataFrame, int]:
    """One row per source with its target, words a block and number of slots; all slots.

    ``sized`` has ``source`` and ``size``. The row also holds the slots and words of all earlier
    sources (``before_slots``, ``before_source_size``).
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sizes = sizes.withColumn("_none", F.col("source").isNull())
    numbered, _ = number_rows(sizes, ["_none", "source"], "sources")
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    ranked = store(
        numbered.select(
            "source",
            F.col("row_number").alias("source_rank"),
            "source_size",
            F.get(cycle, (F.col("row_number") % len(weights)).cast("int")).alias("weight"),
        ),
        "sources",
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    rest, open_weight = _level(ranked, total, most)
    share = _exact(F.col("weight")) * F.lit(rest)
    limit = F.col("source_size") * F.lit(most)
    target = F.when(_above(rest, open_weight, most), limit.cast("double")).otherwise(
        share.cast("double") / F.lit(max(open_weight, 1))
    )
    words = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("target") / _SHARE)))
    slots = F.least(F.floor(F.col("target") / F.col("block") + 0.5), F.expr(f"source_size * {most} div block"))
    planned = ranked.withColumn("target", target).withColumn("block", words).withColumn("slots", slots)
    placed, totals = running_totals(planned, ["source_rank"], ["slots", "source_size"], "source-plan")
    return placed.drop("_at"), totals["slots"]


def _quotients(a: int, b: int) -> list[int]:
    """Partial quotients of the continued fraction of a/b."""
    found = []
    while b:
        found.append(a // b)
        a, b = b, a % b
    return found


def lattice_step(n: int, tries: int = 256) -> int:
    """A step coprime to ``n`` near its golden section, with small quotients to the end.

    The smaller the quotients of step/n, the closer each stretch of multiples is to even.
    """
    middle = max(1, round(n * _GOLDEN))
    near = range(max(1, middle - tries), min(max(n, 2), middle + tries + 1))
    coprime = [g for g in near if math.gcd(g, n) == 1]
    return min(coprime, key=lambda g: (max(_quotients(n, g)), abs(g - middle)))


def _schedule(sources: DataFrame, n: int) -> DataFrame:
    """(source_rank, rank, slot): the slots of each source, ranked in schedule order."""
    step = lattice_step(n)
    back = pow(step, -1, n) if n > 1 else 0

    def split(level: int) -> Column:
        first = F.col("k") * F.lit(_FAN)
        return F.explode(F.sequence(first, F.least(first + F.lit(_FAN - 1), _div(F.col("slots") - 1, _FAN**level))))

    kept = ["source_rank", "before_slots", "slots"]
    rows = sources.where("slots > 0").select(*kept)
    rows = rows.select(*kept, F.explode(F.sequence(F.lit(0), _div(F.col("slots") - 1, _FAN**2))).alias("k"))
    rows = rows.select(*kept, split(1).alias("k")).repartition(partitions(sources.sparkSession), "source_rank", "k")
    point = F.col("before_slots") + F.col("k")
    # lattice point of slot i is i * step mod n; the slot of a point is found by the inverse
    slot = (point.cast("decimal(19,0)") * F.lit(back).cast("decimal(19,0)")) % F.lit(n).cast("decimal(19,0)")
    points = rows.select(*kept, split(0).alias("k")).select(
        "source_rank", "before_slots", slot.cast("long").alias("slot")
    )
    ranked, _ = number_rows(points, ["source_rank", "slot"], "schedule")
    return ranked.select("source_rank", (F.col("row_number") - F.col("before_slots")).alias("rank"), "slot")


def _sized(docs: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    """Key, source and number of words of each document, with its place in the shuffle."""
    keys = round_keys(seed)
    number = F.coalesce(F.col(key).cast("long"), F.lit(0))
    return store(
        docs.select(
            F.col(key).alias("key"),
            F.col(source).alias("source"),
            F.col(source).isNull().alias("none"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            _scatter(number, *keys[0]).alias("h1"),
            _scatter(number, *keys[1]).alias("h2"),
            F.xxhash64(text).alias("tie"),
        ),
        "document-sizes",
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    block: int = BLOCK,
    seed: int = 11,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """The documents with the plan of their source, and the mix itself.

    Documents: key, source, size, source_size, target, ``row``. Mix: slot, source, key, ``row``,
    repetition, first_word (from 0) and n_words: the words of a document that a slot takes. In the
    order of slot, repetition, first word of the stream the mix can be read off.
    """
    sized = _sized(docs, key, text, source, seed)
    sources, n = plan_sources(sized, weights, most, block)
    sources = store(sources, "source-plan")
    placed, _ = running_totals(sized, ["none", "source", "h1", "h2", "key", "tie"], ["size"], "shuffled")
    plan = sources.withColumnRenamed("source", "_source")
    joined = store(
        placed.join(plan, F.col("source").eqNullSafe(F.col("_source"))).select(
            F.col("_at").alias("row"),
            "key",
            "source",
            "size",
            "source_size",
            "target",
            "source_rank",
            "block",
            "slots",
            (F.col("before_size") - F.col("before_source_size")).alias("start"),
        ),
        "document-places",
    )
    end = F.col("slots") * F.col("block")
    repeats = _exact(end - 1) / _exact(F.col("source_size"))
    parts = (
        joined.where("size > 0 AND slots > 0")
        .withColumn("repetition", F.explode(F.sequence(F.lit(0), F.floor(repeats).cast("int"))))
        .withColumn("from", F.col("repetition") * F.col("source_size") + F.col("start"))
        .withColumn("to", F.least(F.col("from") + F.col("size"), end))
        .where("from < to")
        .withColumn("rank", F.explode(F.expr("sequence(`from` div block, (`to` - 1) div block)")))
        .withColumn("at", F.greatest("from", F.col("rank") * F.col("block")))
    )
    pieces = parts.select(
        "source_rank",
        "rank",
        "row",
        "key",
        "source",
        "repetition",
        (F.col("at") - F.col("from")).alias("first_word"),
        (F.least("to", (F.col("rank") + 1) * F.col("block")) - F.col("at")).alias("n_words"),
    )
    taken = pieces.join(_schedule(sources, n), ["source_rank", "rank"]) if n else pieces.withColumn("slot", F.col("rank"))
    found = taken.select("slot", "source", F.col("key").alias(key), "row", "repetition", "first_word", "n_words")
    return joined.select("row", F.col("key").alias(key), "source", "size", "source_size", "target"), found


def mixed_texts(mixed: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of each piece of a mix, joined by spaces; keys of ``docs`` must be unique."""
    texts = docs.select(F.col(key), F.col(text).alias("_whole"))
    words = F.slice(F.regexp_extract_all("_whole", F.lit(WORD), F.lit(0)), (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int"))
    return mixed.join(texts, key).withColumn("words", F.array_join(words, " ")).drop("_whole")


def mix_report(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row per document: key, size, source_size, target of its source, words taken."""
    known, mixed = mix(docs, key=key, **options)
    taken = mixed.groupBy("row").agg(F.sum("n_words").alias("taken"))
    return known.join(taken, "row", "left").select(
        key, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )


def mix_sql(seed: int = 11) -> str:
    """The same report in SQL: the first words of each source's repeated stream."""
    (m, c, d), (m2, c2, d2) = round_keys(seed)[:2]
    p = 2**31 - 1

    def scattered(m, c, d):
        t = f"((coalesce(doc_id, 0) % {p} * {m} + {c}) % {p})"
        return f"(({t} * {t} + {d}) % {p})"

    part = f"greatest(0, least(size, slots * block - ({{q}} * source_size + start)))"
    return f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         {scattered(m, c, d)} AS h1, {scattered(m2, c2, d2)} AS h2 FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)})::BIGINT AS weight
  FROM sized GROUP BY source),
stopped AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum({MOST} * source_size) OVER before, 0) AS rest,
         sum(weight) OVER after AS open_weight FROM ranked
  WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (
  SELECT rest, open_weight FROM stopped WHERE rest * weight <= {MOST} * source_size * open_weight
  ORDER BY open_weight DESC LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN level.rest * weight > {MOST} * source_size * level.open_weight
         THEN ({MOST} * source_size)::DOUBLE ELSE (level.rest * weight)::DOUBLE / level.open_weight END AS target
  FROM ranked, level),
planned AS (SELECT *, greatest(1, least({BLOCK}, floor(target / {_SHARE})))::BIGINT AS block FROM targets),
slotted AS (
  SELECT *, least(floor(target / block + 0.5)::BIGINT, {MOST} * source_size // block) AS slots FROM planned),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h1, h2, doc_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sized)
SELECT doc_id, size, source_size, target,
       ({" + ".join(part.format(q=q) for q in range(MOST))})::BIGINT AS taken
FROM placed JOIN slotted ON placed.source IS NOT DISTINCT FROM slotted.source
"""
