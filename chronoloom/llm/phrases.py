"""Collocations by contiguous pattern growth.

Words come first: their counts are aggregated, and those too rare for any
phrase are marked absent in a bit field of fixed size, which passes all others.
Pairs of frequent words are the prefixes that growth starts from: a pass over
the texts counts their hashes, and one more counts those pairs whose hash is
frequent enough.  The last pass projects, for every occurrence of a frequent
pair, the pointer to the one or two words after it, as long as each next pair is
frequent too.  Pointers of one prefix are dealt to one task, which reads them in
the order of the words they point at, so growing to the right depth-first means
closing runs of that order, and no prefix is ever held in memory.  Pointers of
prefixes with more occurrences than a bound are dealt to many tasks by the words
they point at, and what these count is summed.

Bits are chosen by hash, so the bit fields may let a rare pattern through,
never lose one; counts are of the words themselves and exact.

Defined cases: a null text has no words; a null language is ``und``, together
with rows of that language; rows that repeat count each; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import tidy
from chronoloom.llm.words import Words, byte_table, constant, groups, split, strings
from chronoloom.plans.materialize import materialize

TABLE = byte_table(b"\x09\x20", b".,;:!?\x0a\x0b\x0c\x0d")
LEAST, LONGEST, TOP, COVER = 30, 4, 2000, 80
#: Bits of a field (16 MB), in pieces that Spark's bitmap functions fill.
BITS, PIECE = 1 << 27, 32768
#: Pointers of prefixes with more occurrences than this, and than this share of all, are dealt to so many tasks; the share bounds the prefixes' number.
HOT, HOT_SHARE, SALTS = 1 << 16, 1 << 16, 256


def _spot(lang: Column, word: Column) -> Column:
    return F.xxhash64(F.concat(lang, F.lit("\x01"), word))


def _pair_spot(lang: Column, first: Column, second: Column) -> Column:
    h = _spot(lang, second)
    return _spot(lang, first).bitwiseXOR(F.shiftleft(h, 21).bitwiseOR(F.shiftrightunsigned(h, 43)))


def _spots(lang: str, names: pa.Array) -> np.ndarray:
    """The same hashes in numpy."""
    head = f"{lang}\x01".encode()
    return np.fromiter((xxhash.xxh64_intdigest(head + w, 42) for w in names.cast(pa.large_binary()).to_pylist()), np.uint64, len(names))


def _pair_spots(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first ^ ((second << np.uint64(21)) | (second >> np.uint64(43)))


def bit_field(spots: DataFrame) -> Broadcast:
    """A field of ``BITS`` bits in which those of the column ``spot`` are set, for every task."""
    spark = spots.sparkSession
    at = F.col("spot").bitwiseAND(F.lit(BITS - 1))
    rows = spots.select(at.alias("at")).selectExpr(f"at div {PIECE} AS piece", f"at % {PIECE} AS bit").groupBy("piece").agg(F.bitmap_construct_agg(F.col("bit")).alias("bits"))
    field = np.zeros(BITS // 8, np.uint8)
    for row in rows.collect():  # BITS / PIECE rows at most
        field[row["piece"] * PIECE // 8 :][: PIECE // 8] = np.frombuffer(row["bits"], np.uint8)[: PIECE // 8]
    return spark.sparkContext.broadcast(field)


def _set(field: np.ndarray, spots: np.ndarray) -> np.ndarray:
    at = spots & np.uint64(8 * len(field) - 1)
    return (field[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _over_texts(docs: DataFrame, run: Callable[[str, pa.Array], list[pa.Array]], schema: str) -> DataFrame:
    """Rows that ``run`` makes of the texts of each language of a batch."""
    names = [c.split()[0] for c in schema.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (lang,), part in groups(batch, "lang"):
                columns = run(lang, part.column("text"))
                yield pa.RecordBatch.from_arrays([constant(lang, len(columns[0])), *columns], names)

    return docs.mapInArrow(tidy(each), schema)


def _tally(keys: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    found, n = np.unique(keys, return_counts=True)
    return found, pa.array(n.astype(np.int64))


def word_counts(docs: DataFrame) -> DataFrame:
    """Occurrences of every word of a language."""

    def run(lang: str, texts: pa.Array) -> list[pa.Array]:
        w = split(texts, TABLE)
        return [strings(w.names), pa.array(np.bincount(w.codes, minlength=len(w.names)).astype(np.int64))]

    return _over_texts(docs, run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def _frequent_pairs(w: Words, lang: str, field: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of frequent words, and all words' hashes."""
    spots = _spots(lang, w.names)
    ok = _set(field, spots)[w.codes] if len(w.codes) else np.zeros(0, bool)
    return np.flatnonzero(w.runs_on[:-1] & ok[:-1] & ok[1:]), spots


def pair_field(docs: DataFrame, words: Broadcast, least: int) -> Broadcast:
    """Bits of the pairs of frequent words that together with those of the same bit occur ``least`` times."""

    def run(lang: str, texts: pa.Array) -> list[pa.Array]:
        w = split(texts, TABLE)
        at, spots = _frequent_pairs(w, lang, words.value)
        found, n = _tally(_pair_spots(spots[w.codes[at]], spots[w.codes[at + 1]]) & np.uint64(8 * len(words.value) - 1))
        return [pa.array(found.astype(np.int64)), n]

    rows = _over_texts(docs, run, "lang string, spot long, n long")
    return bit_field(rows.groupBy("spot").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("spot"))


def pair_counts(docs: DataFrame, words: Broadcast, pairs: Broadcast) -> DataFrame:
    """Occurrences of pairs of frequent words whose bit is set."""

    def run(lang: str, texts: pa.Array) -> list[pa.Array]:
        w = split(texts, TABLE)
        at, spots = _frequent_pairs(w, lang, words.value)
        at = at[_set(pairs.value, _pair_spots(spots[w.codes[at]], spots[w.codes[at + 1]]))]
        size = max(1, len(w.names))
        found, n = _tally(w.codes[at] * size + w.codes[at + 1])
        return [strings(w.names.take(pa.array(found // size))), strings(w.names.take(pa.array(found % size))), n]

    return _over_texts(docs, run, "lang string, first string, second string, n long").groupBy("lang", "first", "second").agg(F.sum("n").alias("f"))


def projections(docs: DataFrame, pairs: Broadcast, hot: Broadcast) -> DataFrame:
    """Pointers behind every occurrence of a frequent pair: the next word and the one after it, or an empty one.

    ``heat`` is 1 for a hot pair, and 2 if the pair that ends with the next word is hot too, as it is for every hot pattern of three words.
    """

    def run(lang: str, texts: pa.Array) -> list[pa.Array]:
        w = split(texts, TABLE)
        size, spots = len(w.names) + 1, _spots(lang, w.names)
        goes = np.zeros(len(w.codes) + 2, bool)
        at = np.flatnonzero(w.runs_on)
        goes[at] = _set(pairs.value, _pair_spots(spots[w.codes[at]], spots[w.codes[at + 1]]))
        at = np.flatnonzero(goes[:-2] & goes[1:-1])
        far = goes[at + 2]
        fourth = np.full(len(at), size - 1)
        fourth[far] = w.codes[at[far] + 3]
        heads, tails = w.codes[at] * size + w.codes[at + 1], w.codes[at + 2] * size + fourth
        order = np.lexsort((tails, heads))
        heads, tails = heads[order], tails[order]
        new = np.flatnonzero((np.diff(heads, prepend=-1) != 0) | (np.diff(tails, prepend=-1) != 0))
        n = np.diff(new, append=len(heads))
        heads, tails = heads[new], tails[new]
        names = pa.concat_arrays([w.names, pa.array([""], pa.large_string())])
        take = lambda codes: strings(names.take(pa.array(codes)))
        prefix = pc.binary_join_element_wise(take(heads // size), take(heads % size), " ")
        first, second, third = spots[heads // size], spots[heads % size], spots[tails // size]
        heat = np.isin(_pair_spots(first, second), hot.value).astype(np.int32)
        heat += heat * np.isin(_pair_spots(second, third), hot.value)
        return [prefix, take(tails // size), take(tails % size), pa.array(n.astype(np.int64)), pa.array(heat)]

    return _over_texts(docs, run, "lang string, prefix string, third string, fourth string, n long, heat int")


def grow(pointers: DataFrame, least: int) -> DataFrame:
    """Frequent patterns that begin with a prefix, from its pointers in the order of their words.

    A prefix is one task's, but for the hot ones: their pointers are dealt by the
    next word, and where that may be hot too, by the word after it as well; then
    a pattern of three words is counted in several tasks and summed afterwards.
    """
    depths = (("lang", "prefix", "third"), ("lang", "prefix", "third", "fourth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        still: list[tuple[tuple, int, bool] | None] = [None, None]  # the run of each depth that may go on

        def closed(found: list[tuple[tuple, int, bool]]) -> pa.RecordBatch:
            rows = [(k[0], " ".join(k[1:]), len(k), n) for k, n, part in found if (part or n >= least) and k[-1]]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], ["lang", "phrase", "words", "f"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new, n, in_parts = np.zeros(batch.num_rows, bool), batch.column("n").to_numpy(), batch.column("heat").to_numpy() == 2
            new[0] = True
            for depth, names in enumerate(depths):
                for name in names if not depth else names[-1:]:
                    column = batch.column(name)
                    new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
                at = np.flatnonzero(new)
                sums = np.add.reduceat(n, at)
                run_of = lambda i: (tuple(batch.column(name)[int(at[i])].as_py() for name in names), int(sums[i]), not depth and bool(in_parts[at[i]]))  # noqa: B023, E731
                found, first = [], still[depth]
                if first is not None:
                    if first[0] == run_of(0)[0]:
                        sums[0] += first[1]
                    else:
                        found.append(first)
                last = len(at) - 1
                found += [run_of(i) for i in np.flatnonzero((sums >= least) | (in_parts[at] & (not depth))) if i < last]
                still[depth] = run_of(last)
                yield closed(found)
        yield closed([s for s in still if s])

    salt = F.when(F.col("heat") == 0, 0).otherwise(F.pmod(F.xxhash64("third", F.when(F.col("heat") == 2, F.col("fourth")).otherwise("")), F.lit(SALTS)))
    dealt = pointers.withColumn("salt", salt).repartition("lang", "prefix", "salt").sortWithinPartitions("lang", "prefix", "third", "fourth")
    counted = dealt.select("lang", "prefix", "third", "fourth", "n", "heat").mapInArrow(tidy(run), "lang string, phrase string, words int, f long")
    return counted.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to 4 words with ``least`` occurrences (``lang``, ``phrase``, ``words``, ``f``), and each language's ``n``.

    ``docs`` has ``lang`` and ``text``.
    """
    counts = materialize(word_counts(docs), "phrase-words")
    sizes = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    words = counts.where(F.col("f") >= least)
    often = bit_field(words.select(_spot(F.col("lang"), F.col("phrase")).alias("spot")))
    pairs = materialize(pair_counts(docs, often, pair_field(docs, often, least)).where(F.col("f") >= least), "phrase-pairs")
    spots = pairs.select("f", _pair_spot(F.col("lang"), F.col("first"), F.col("second")).alias("spot"))
    total = pairs.agg(F.sum("f")).first()[0] or 0
    most = max(HOT, total // HOT_SHARE)
    hot = np.array([r["spot"] for r in spots.where(F.col("f") > most).select("spot").collect()], np.int64).view(np.uint64)
    grown = grow(projections(docs, bit_field(spots), docs.sparkSession.sparkContext.broadcast(hot)), least)
    short = words.select("lang", "phrase", F.lit(1).alias("words"), "f").unionByName(pairs.select("lang", F.concat_ws(" ", "first", "second").alias("phrase"), F.lit(2).alias("words"), "f"))
    return materialize(short.unionByName(grown), "phrase-frequent"), sizes


def scored(frequent: DataFrame) -> DataFrame:
    """Every phrase of two words or more with its lowest-scoring cut: ``a``, ``l``, ``r`` and ``score``."""
    parts = F.split("phrase", " ")
    cuts = frequent.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("parts", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("parts", F.col("k") + 1, F.size("parts")), " ").alias("tail"))
    part = lambda name, count: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    both = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    whole = lambda c: f"cast({c} AS decimal(20,0))"
    score = F.expr(f"(2000000BD * {whole('a')}) div ({whole('l')} + {whole('r')})")
    best = both.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "best.a", "best.l", "best.r", "best.score")


def covered(frequent: DataFrame) -> DataFrame:
    """The highest count of a longer phrase (``above``) around every phrase that lies in one."""
    parts = F.split("phrase", " ")
    longer = frequent.where("words > 2").select("lang", "f", parts.alias("parts"), F.explode(F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> struct(i, m))))")).alias("cut"))
    inner = longer.select("lang", F.array_join(F.slice("parts", F.col("cut.i"), F.col("cut.m")), " ").alias("phrase"), "f")
    return inner.groupBy("lang", "phrase").agg(F.max("f").alias("above"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, cover: int = COVER, lang: str = "lang", text: str = "text") -> DataFrame:
    """The first ``top`` phrases of each language by score; see the module's docstring."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    frequent, sizes = frequent_phrases(rows, least)
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    kept = scored(frequent).join(covered(frequent), ["lang", "phrase"], "left").where(F.col("above").isNull() | (whole("above") * 100 < whole("a") * cover))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
g AS (SELECT lang, m, ws[i:i + m - 1] AS p FROM (SELECT lang, m, ws, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS m))),
f AS (SELECT lang, m, p, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE m > 1 AND f >= {LEAST}),
cuts AS (SELECT lang, m, p, f AS a, unnest(range(1, m)) AS k FROM c),
s AS (SELECT cuts.lang, cuts.m, cuts.p, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.p = cuts.p[1:k] JOIN f y ON y.lang = cuts.lang AND y.p = cuts.p[k + 1:cuts.m]),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
subs AS (SELECT lang, p[i:i + j - 1] AS q, f FROM (SELECT *, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM c))),
top AS (SELECT lang, q, max(f) AS above FROM subs GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN top ON top.lang = best.lang AND top.q = best.p WHERE above IS NULL OR 100::HUGEINT * above < {COVER}::HUGEINT * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM kept)
SELECT lang, rank, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= {TOP}"""
