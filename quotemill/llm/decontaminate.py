"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Fixed masks over consecutive words leave some places out; hashes of the others are joined between
all places of the benchmark and of the documents. Around each hit the two texts are laid side by
side, and a hit is kept if some ``SPAN`` words there (a shorter item: all its words) agree in
``AGREE`` hundredths or more. The two masks together meet every run of 13 words in which any two
are replaced. An item of fewer words than ``SPAN`` has masks of its own size: its words in as many
blocks as it may have replaced words, and one more, so that a block stays whole. So nothing that
passes the check is missed by the seeds, whatever else is in the benchmark.

The benchmark's places are broadcast with the words around them, ``BROADCAST_BYTES`` at a time; a
larger benchmark is held against the documents in several passes.

Words are runs of letters and digits, lower-cased. Defined cases: null texts have no words; an item
of fewer than ``LEAST`` words is met only by texts that have just its words, an item without words
never; rows that share a doc_id are told apart by their texts and reported together, rows without
an id with null; an empty table on either side gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm import common

#: Fixed masks: the places that count.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 7, 8))
SPAN, AGREE, LEAST = 13, 80, 5
#: Bytes of benchmark places and words that are broadcast at once, about.
BROADCAST_BYTES = 64 << 20
#: Texts that go, by their SHA-256, at most for a broadcast.
BROADCAST_ROWS = 500_000
#: Words before and after a place that the check looks at.
_BEFORE, _AFTER = SPAN, 2 * SPAN


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def _key(words: Column, at: Column, mask: tuple[int, ...]) -> Column:
    """The hash of a place under a mask; null where the text ends before."""
    return F.when(at + mask[-1] < F.size(words), F.xxhash64(F.lit(",".join(map(str, mask))), *(F.get(words, at + o) for o in mask)))


def _whole(words: Column, at: Column) -> Column:
    """The hash of all words of a text that has fewer than LEAST."""
    return F.when((at == 0) & (F.size(words) < LEAST), F.xxhash64(F.lit("whole"), F.array_join(words, " ")))


def _seeded(df: DataFrame, words: str, keys) -> DataFrame:
    """A row for each place and key: _at, _key and the columns of ``df``. All columns stay where they are, so the words aren't copied for a place that meets nothing."""
    placed = df.where(F.size(words) > 0).select("*", F.explode(F.sequence(F.lit(0), F.size(words) - 1)).alias("_at"))
    keyed = placed.select("*", F.explode(F.array(*(k(F.col(words), F.col("_at")) for k in keys))).alias("_key"))
    return keyed.where("_key is not null")


def _blocks(n: int) -> list[tuple[int, int]]:
    """(start, size) of the blocks of an item of ``n`` words, of which one stays whole in all that the check allows."""
    parts = n - -(-n * AGREE // 100) + 1
    cuts = [n * k // parts for k in range(parts + 1)]
    return [(x, y - x) for x, y in zip(cuts, cuts[1:], strict=False)]


def _run(size: int):
    return lambda words, at: _key(words, at, tuple(range(size)))


def _masked(mask):
    return lambda words, at: _key(words, at, mask)


def _item_seeds(items: DataFrame, sizes: list[int]) -> DataFrame:
    """(_key, item_id, _iat, _isize, _iwords: the words around the place) of items (item_id, _iw)."""
    short = [F.struct(F.when(F.size("_iw") == n, F.get(F.array(_run(m)(F.col("_iw"), F.lit(o))), F.lit(0))).alias("_key"), F.lit(o).alias("_at")) for n in sizes if LEAST <= n < SPAN for o, m in _blocks(n)]
    short.append(F.struct(_whole(F.col("_iw"), F.lit(0)).alias("_key"), F.lit(0).alias("_at")))
    own = items.where((F.size("_iw") > 0) & (F.size("_iw") < SPAN)).select("item_id", "_iw", F.inline(F.array(*short))).select("item_id", "_iw", "_at", "_key").where("_key is not null")
    both = own.unionByName(_seeded(items.where(F.size("_iw") >= SPAN), "_iw", map(_masked, MASKS)).select("item_id", "_iw", "_at", "_key"))
    before = F.least(F.col("_at"), F.lit(_BEFORE))
    around = F.slice("_iw", F.col("_at") - before + 1, before + F.least(F.size("_iw") - F.col("_at"), F.lit(_AFTER)))
    return both.select("_key", "item_id", F.col("_at").alias("_iat"), F.size("_iw").alias("_isize"), around.alias("_iwords"))


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, _text, item_id, _at, _best): places of documents that pass the check; _text is the SHA-256 of the document's text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("_iw"))
    sizes = [r.n for r in items.select(F.least(F.size("_iw"), F.lit(SPAN)).alias("n")).distinct().collect()]  # SPAN + 1 at most
    seeds = _item_seeds(items, sizes)
    measured = seeds.agg(F.sum(F.octet_length(F.array_join("_iwords", " ")) + 16 * F.size("_iwords") + 64).alias("n")).first().n or 0
    passes = -(-measured // BROADCAST_BYTES)
    keys = [_masked(m) for m in MASKS] if SPAN in sizes else []
    keys += [_run(m) for m in sorted({m for n in sizes if LEAST <= n < SPAN for _, m in _blocks(n)})]
    keys += [_whole] if any(0 < n < LEAST for n in sizes) else []
    text = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("_text")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, tokens(F.col("text")).alias("_dw"))
    at, iat = F.col("_at"), F.col("_iat")
    left = F.least(at, iat, F.lit(_BEFORE))
    size = left + F.least(F.size("_dw") - at, F.col("_isize") - iat, F.lit(_AFTER))

    def hits(block: int) -> DataFrame:
        own = seeds if passes == 1 else seeds.where(F.pmod("_key", F.lit(passes)) == block)
        return _seeded(texts, "_dw", keys).join(F.broadcast(own), "_key").select(
            "doc_id", "_text", "item_id", "_at", "_iat",
            F.slice("_dw", at - left + 1, size).alias("_d"),
            F.slice("_iwords", F.least(iat, F.lit(_BEFORE)) - left + 1, size).alias("_i"),
            F.least(F.col("_isize"), F.lit(SPAN)).alias("_span"),
        )

    if not passes:
        return texts.select("doc_id", "_text", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("_at"), F.lit(0).alias("_best")).where("false")
    # One row for a place, and a border that keeps the checks below out of the join, which then copies no whole texts.
    places = reduce(DataFrame.unionByName, map(hits, range(passes))).groupBy("doc_id", "_text", "item_id", "_at", "_iat", "_span").agg(F.first("_d").alias("_d"), F.first("_i").alias("_i"))
    same = places.select("doc_id", "_text", "item_id", "_at", "_span", F.zip_with("_d", "_i", lambda a, b: (a == b).cast("int")).alias("_same")).where("size(_same) >= _span")
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("_same") - F.col("_span") + 1), lambda s: F.aggregate(F.slice("_same", s, F.col("_span")), F.lit(0), lambda a, b: a + b)))
    return same.withColumn("_best", best).where(F.col("_best") * 100 >= F.col("_span") * AGREE)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, agree_words (of the best SPAN words), hits and first_word for each document and item that overlap."""
    return _found(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max("_best").cast("long").alias("agree_words"), F.countDistinct("_text", "_at").alias("hits"), F.min("_at").cast("long").alias("first_word"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text overlaps no item; rows are matched by the SHA-256 of their texts."""
    gone, _ = common.materialize(_found(docs, benchmark).select("_text").distinct(), "contaminated")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    keyed = docs.select("*", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("_text"))
    return keyed.join(gone, "_text", "left_anti").select(*docs.columns)


def decontamination_query(spark, sf_dir: str) -> DataFrame:
    return contaminated(common.documents(spark, sf_dir), common.table(spark, sf_dir, "benchmark"))


def _sql_masks() -> str:
    return " UNION ALL ".join(f"SELECT {k} AS mask, {[*m]} AS places" for k, m in enumerate(MASKS))


#: For benchmarks whose items all have as many words as the widest mask, as the given ones have.
ORACLE_SQL = f"""
WITH masks AS ({_sql_masks()}),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark),
dk AS (SELECT doc_id, w, p, mask, array_to_string([w[p + 1 + o] FOR o IN places], ' ') AS k FROM (SELECT *, unnest(range(0, len(w))) AS p FROM d), masks WHERE p + places[-1] < len(w)),
ik AS (SELECT item_id, w, p, mask, array_to_string([w[p + 1 + o] FOR o IN places], ' ') AS k FROM (SELECT *, unnest(range(0, len(w))) AS p FROM i), masks WHERE p + places[-1] < len(w)),
hits AS (
  SELECT doc_id, item_id, dk.p AS p, dk.w AS dw, ik.w AS iw, ik.p AS ip, least(dk.p, ik.p, {SPAN}) AS l, least(len(dk.w) - dk.p, len(ik.w) - ik.p, {2 * SPAN}) AS r, least(len(ik.w), {SPAN}) AS span
  FROM dk JOIN ik USING (mask, k)),
same AS (SELECT doc_id, item_id, p, span, [CASE WHEN dw[p - l + 1 + j] = iw[ip - l + 1 + j] THEN 1 ELSE 0 END FOR j IN range(0, l + r)] AS s FROM hits),
best AS (SELECT doc_id, item_id, p, span, list_max([list_sum(s[j:j + span - 1]) FOR j IN range(1, len(s) - span + 2)]) AS b FROM same WHERE len(s) >= span)
SELECT doc_id, item_id, max(b)::BIGINT AS agree_words, count(DISTINCT p)::BIGINT AS hits, min(p)::BIGINT AS first_word FROM best WHERE b * 100 >= span * {AGREE} GROUP BY 1, 2
"""
