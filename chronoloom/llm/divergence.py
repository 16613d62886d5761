"""Divergence of sources: how each differs from the others of its language, and by which terms.

The first pass counts in how many documents of a language each term stands and
keeps the terms of at least three, numbered in byte order.  The second pass
recounts the kept terms' occurrences with Aho-Corasick automata.  A task holds
its texts as counted distinct terms, a bounded stretch at a time; these pass
once, in byte order and with delimiters between them, through the automata,
whose patterns have a delimiter on both sides, so only whole terms match.  The
vocabulary is dealt into parts of a bounded number of characters, each an
automaton of its own; a worker keeps what it may hold of them and starts with
those.  Work thus grows with texts, and with distinct terms of a stretch times
parts.

Counts give sparse postings.  The sum over all kept terms for a pair of sources
is written as a constant for terms that neither holds, one correction for each
distinct count of either source, and one for each term that both hold; the last
are summed in the tasks that read a term's postings, so pairs leave a task
summed, not once for each term.

All arithmetic is in integers or decimals.  Sums of the tasks may wrap around
64 bits and are right again once added, since the final values fit.

Defined cases: null texts, languages and sources are empty ones; sources
without a term are compared too; rows that repeat count each; ties go to the
smaller item in byte order; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import kept, open_fs, tidy, trim
from chronoloom.llm.words import byte_table, constant, grouped, split, strings
from chronoloom.plans.materialize import materialize, new_folder

TABLE = byte_table(bytes(range(0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80)))
LEAST_DOCUMENTS, TOP_TERMS, UNIT = 3, 200, 1_000_000_000
#: Characters of one automaton's terms (about 16 bytes of memory each), and bytes of counted terms between two passes through the automata.
PART_CHARS, STRETCH = 6_000_000, 32 << 20
#: Characters of the automata that a worker keeps from task to task (one at least), and rows sent to Spark at once.
KEPT_CHARS, ROWS = 9_000_000, 1 << 17
#: Pairs summed at once, and sums a task holds before it sends them on.
PAIRS, SUMS = 1 << 20, 1 << 20
#: Tasks that share a language's distinct counts.
SALTS = 32


@dataclass
class Tally:
    """Counts ``n`` of distinct terms (``code`` into ``names``) for the groups of a stretch of texts (``group`` into ``keys``)."""

    keys: list[tuple]
    names: pa.Array
    group: np.ndarray
    code: np.ndarray
    n: np.ndarray


def tallies(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], once: bool, stretch: int) -> Iterator[Tally]:
    """Occurrences of terms by the key columns (with ``once``, the texts that hold them), summed until ``stretch`` bytes are held."""

    def merged() -> Tally:
        names = pa.concat_arrays([t.names for t in held]).dictionary_encode()
        codes = np.split(names.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum([len(t.names) for t in held])[:-1])
        numbers: dict[tuple, int] = {}
        of = [np.array([numbers.setdefault(k, len(numbers)) for k in t.keys], np.int64) for t in held]
        size = max(1, len(names.dictionary))
        cell = np.concatenate([g[t.group] * size + c[t.code] for t, g, c in zip(held, of, codes, strict=True)])
        order = np.argsort(cell)
        cell, n = cell[order], np.concatenate([t.n for t in held])[order]
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        cell, n = cell[first], np.add.reduceat(n, first, dtype=np.int64) if len(first) else n.astype(np.int64)
        return Tally(list(numbers), names.dictionary, cell // size, cell % size, n)

    held, used = [], 0
    for batch in batches:
        found, of = [], np.empty(batch.num_rows, np.int64)
        for key, rows in grouped(batch, *keys):
            of[rows] = len(found)
            found.append(key)
        w = split(batch.column("text"), TABLE)
        size = max(1, len(w.names))
        if once:
            cell = np.unique(w.text * size + w.codes)
            cell = of[cell // size] * size + cell % size
        else:
            cell = of[w.text] * size + w.codes
        cell, n = np.unique(cell, return_counts=True)
        held.append(Tally(found, w.names, *(x.astype(np.int32) for x in (cell // size, cell % size, n))))
        used += w.names.nbytes + 12 * len(cell)
        del w, cell, n
        if used > stretch:
            yield merged()
            held, used = [], 0
    if held:
        yield merged()


def _rows(tally: Tally, names: list[str], **columns: pa.Array) -> Iterator[pa.RecordBatch]:
    """Rows of the tally's groups under ``names``, with further columns, a bounded number at once."""
    for at in range(0, len(tally.group), ROWS):
        group = pa.array(tally.group[at : at + ROWS])
        own = [pa.array([k[i] for k in tally.keys], pa.string()).take(group) for i in range(len(names))]
        yield pa.RecordBatch.from_arrays([*own, *(c.slice(at, ROWS) for c in columns.values())], [*names, *columns])


def document_frequencies(docs: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """In how many documents of a language each term stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tallies(batches, ("lang",), True, stretch):
            yield from _rows(t, ["lang"], term=strings(t.names.take(pa.array(t.code))), n=pa.array(t.n))

    return docs.select("lang", "text").mapInArrow(tidy(run), "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


def numbered(terms: DataFrame) -> DataFrame:
    """Distinct terms with an ``id`` that ascends in their byte order."""
    ordered = terms.select("term").distinct().repartitionByRange("term").sortWithinPartitions("term")
    return materialize(ordered.withColumn("id", F.monotonically_increasing_id()), "audit-terms")


def write_vocabulary(terms: DataFrame, part_chars: int = PART_CHARS) -> list[str]:
    """Numbered terms, dealt by hash into Parquet folders of about ``part_chars`` characters."""
    spark = terms.sparkSession
    parts = max(1, -(-(terms.agg(F.sum(F.char_length("term"))).first()[0] or 0) // part_chars))
    uri = new_folder(spark, "audit-vocabulary") + "/t"
    dealt = terms.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
    dealt.repartition(parts, "part").write.partitionBy("part").parquet(uri)
    found = {r["part"] for r in dealt.select("part").distinct().toLocalIterator()}
    return [f"{uri}/part={k}" for k in sorted(found)]


def _terms(uri: str) -> pa.Table:
    fs, path = open_fs(uri)
    return pq.read_table(path, filesystem=fs, columns=["term", "id"], partitioning=None).sort_by("id")


def _automaton(rows: pa.Table) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, term in enumerate(rows["term"].to_pylist()):
        machine.add_word(f" {term} ", i)
    machine.make_automaton()
    return machine


def term_ids(names: pa.Array, vocabulary: list[str], machines: dict[str, tuple[ahocorasick.Automaton, np.ndarray, int]]) -> np.ndarray:
    """Ids of distinct terms, -1 for those that aren't kept; parts whose automata are at hand come first."""
    out = np.full(len(names), -1, np.int64)
    order = pc.sort_indices(names)  # neighbours share their way through an automaton
    names = names.take(order)
    text = " " + "  ".join(names.to_pylist()) + " "
    ends = np.cumsum(pc.utf8_length(names).to_numpy(zero_copy_only=False).astype(np.int64) + 2) - 1
    place = order.to_numpy().astype(np.int64)
    for uri in sorted(vocabulary, key=lambda u: u not in machines):
        if uri not in machines:
            rows = _terms(uri)
            chars = pc.sum(pc.utf8_length(rows["term"])).as_py() or 0
            while machines and sum(m[2] for m in machines.values()) + chars > KEPT_CHARS:
                machines.pop(next(iter(machines)))
                trim()
            machines[uri] = (_automaton(rows), rows["id"].to_numpy(), chars)
        machine, ids, _ = machines[uri]
        found = np.fromiter(chain.from_iterable(machine.iter(text)), np.int64).reshape(-1, 2)
        out[place[np.searchsorted(ends, found[:, 0])]] = ids[found[:, 1]]
    return out


def occurrences(docs: DataFrame, vocabulary: list[str], stretch: int = STRETCH) -> DataFrame:
    """How often each source of a language holds each term of the vocabulary, by the term's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tallies(batches, ("lang", "source"), False, stretch):
            ids = term_ids(t.names, vocabulary, kept(f"automata:{vocabulary[:1]}", dict))[t.code]
            held = ids >= 0
            t.group, n = t.group[held], t.n[held]
            yield from _rows(t, ["lang", "source"], id=pa.array(ids[held]), n=pa.array(n))

    rows = docs.select("lang", "source", "text").mapInArrow(tidy(run, keeps=True), "lang string, source string, id long, n long")
    return rows.groupBy("lang", "source", "id").agg(F.sum("n").alias("n"))


def _share(count: str, of: str) -> Column:
    """``1 + floor(UNIT * (count + 1) / of)``."""
    whole = lambda c: f"cast({c} AS decimal(20,0))"
    return F.expr(f"1 + ({UNIT}BD * ({whole(count)} + 1)) div nullif({whole(of)}, 0)")


def _gap(p: str, q: str) -> str:
    return f"({p} - {q}) * ({p} - {q}) div {q}"


def shared_terms(postings: DataFrame) -> DataFrame:
    """For pairs of source numbers of a language, summed over the terms that both hold, what their pair adds to the two corrections."""

    def add(sums: tuple[np.ndarray, np.ndarray] | None, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if sums is not None:
            keys, values = np.concatenate([sums[0], keys]), np.concatenate([sums[1], values])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[at], np.add.reduceat(values[order], at) if len(at) else values[:0]

    def out(lang: str, sums: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([constant(lang, len(sums[0])), pa.array(sums[0] >> 32), pa.array(sums[0] & 0xFFFFFFFF), pa.array(sums[1])], ["lang", "a", "b", "value"])

    def pairs(run: np.ndarray, number: np.ndarray, p: np.ndarray, none: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys and values of all ordered pairs within the runs of equal terms, in blocks."""
        gap = lambda x, y: (x - y) * (x - y) // y
        first, size = np.flatnonzero(np.diff(run, prepend=-1)), np.diff(np.flatnonzero(np.diff(run, prepend=-1)), append=len(run))
        begin, count = np.repeat(first, size), np.repeat(size, size)  # for each row: its run
        upto = np.cumsum(count)
        at = 0
        while at < len(run):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            x = np.repeat(np.arange(at, to), count[at:to])
            y = np.arange(len(x)) - np.repeat(upto[at:to] - count[at:to] - (upto[at - 1] if at else 0), count[at:to]) + begin[x]
            x, y = x[x != y], y[x != y]
            yield (number[x] << 32) | number[y], gap(p[x], p[y]) - gap(p[x], none[y]) - gap(none[x], p[y]) + gap(none[x], none[y])
            at = to

    def each(rows: pa.Table) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        if not rows.num_rows:
            return
        new = np.ones(rows.num_rows, bool)
        lang, term = rows["lang"].combine_chunks(), rows["id"].combine_chunks()
        fresh = pc.not_equal(lang[1:], lang[:-1]).to_numpy(zero_copy_only=False)
        new[1:] = fresh | pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)
        number, p, none = (rows[c].to_numpy() for c in ("number", "p", "none"))
        edges = [0, *(np.flatnonzero(fresh) + 1), rows.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            for keys, values in pairs(np.cumsum(new[a:b]), number[a:b], p[a:b], none[a:b]):
                yield lang[int(a)].as_py(), keys, values

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums, rest = None, None, None
        for batch in _with_end(batches):
            rows = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if rows is None or not rows.num_rows:
                continue
            rest = None
            if batch is not None:  # the last term may go on in the next batch
                lang, term = rows["lang"][rows.num_rows - 1], rows["id"][rows.num_rows - 1]
                still = int(pc.index(pc.and_(pc.equal(rows["lang"], lang), pc.equal(rows["id"], term)), True).as_py())
                rest, rows = rows.slice(still), rows.slice(0, still)
            for lang, keys, values in each(rows):
                if sums is not None and (lang != at or len(sums[0]) > SUMS):
                    yield out(at, sums)
                    sums = None
                at, sums = lang, add(sums, keys, values)
        if sums is not None:
            yield out(at, sums)

    dealt = postings.select("lang", "id", "number", "p", "none").repartition("lang", "id").sortWithinPartitions("lang", "id")
    return dealt.mapInArrow(tidy(summed), "lang string, a long, b long, value long")


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, part_chars: int = PART_CHARS, stretch: int = STRETCH, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Pairs of sources and the terms that mark each source, ranked; see the module's docstring."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    vocabulary = materialize(document_frequencies(rows, stretch).where(F.col("n") >= least).select("lang", "term"), "audit-kept")
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("v"))
    terms = numbered(vocabulary)
    found = occurrences(rows, write_vocabulary(terms, part_chars), stretch)
    counts = materialize(found.join(vocabulary.join(terms, "term").select("lang", "id"), ["lang", "id"], "left_semi"), "audit-counts")

    by_source = counts.groupBy("lang", "source").agg(F.sum("n").alias("held"))
    named = rows.select("lang", "source").distinct().join(by_source, ["lang", "source"], "left").join(sizes, "lang", "left")
    named = named.select("lang", "source", F.coalesce("held", F.lit(0)).alias("held"), F.coalesce("v", F.lit(0)).alias("v"))
    named = named.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long"))
    sources = materialize(named.withColumn("all", F.col("held") + F.col("v")).withColumn("none", _share("0", "`all`")), "audit-sources")
    postings = materialize(counts.join(sources, ["lang", "source"]).select("lang", "source", "number", "id", "n", "none", _share("n", "`all`").alias("p")), "audit-postings")

    other = sources.select("lang", F.col("number").alias("b"), F.col("source").alias("item"), F.col("none").alias("none_b"))
    both = sources.select("lang", "source", F.col("number").alias("a"), "v", F.col("none").alias("none_a")).join(other, "lang").where("a <> b")
    wide = lambda e: F.expr(f"cast(coalesce({e}, 0) AS decimal(38,0))")
    neither = both.select("lang", "a", "b", wide(f"v * cast({_gap('none_a', 'none_b')} AS decimal(20,0))").alias("value"))
    levels = postings.groupBy("lang", "number", "none", "p").agg(F.count("*").alias("m"))
    times = lambda e: wide(f"m * cast({e} AS decimal(20,0))").alias("value")
    salted = levels.withColumnsRenamed({"number": "x", "none": "none_x"}).withColumn("salt", F.pmod(F.xxhash64("x", "p"), F.lit(SALTS)).cast("int"))
    others = other.withColumnsRenamed({"b": "y", "none_b": "none_y"}).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    one = salted.join(others, ["lang", "salt"]).where("x <> y")
    forth = one.select("lang", F.col("x").alias("a"), F.col("y").alias("b"), times(f"{_gap('p', 'none_y')} - {_gap('none_x', 'none_y')}"))
    back = one.select("lang", F.col("y").alias("a"), F.col("x").alias("b"), times(f"{_gap('none_y', 'p')} - {_gap('none_y', 'none_x')}"))
    shared = shared_terms(postings)
    parts = neither.unionByName(forth).unionByName(back).unionByName(shared.select("lang", "a", "b", wide("value").alias("value")))
    wrapped = F.expr("(sum(value) + 9223372036854775808BD) % 18446744073709551616BD")
    total = parts.groupBy("lang", "a", "b").agg(wrapped.alias("value"))
    total = total.withColumn("value", F.expr("cast(CASE WHEN value < 0 THEN value + 18446744073709551616BD ELSE value END - 9223372036854775808BD AS long)"))
    pair = both.join(total, ["lang", "a", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    of_lang = counts.groupBy("lang", "id").agg(F.sum("n").alias("n")).join(
        counts.groupBy("lang").agg(F.sum("n").alias("held")).join(sizes, "lang").select("lang", (F.col("held") + F.col("v")).alias("all")), "lang"
    )
    marks = postings.join(of_lang.select("lang", "id", _share("n", "`all`").alias("q")), ["lang", "id"]).where("p > q")
    term = marks.select("lang", "source", F.lit("term").alias("part"), "id", F.expr(_gap("p", "q")).alias("value"))
    order = lambda tie: Window.partitionBy("lang", "source").orderBy(F.desc("value"), tie)
    term = term.withColumn("rank", F.row_number().over(order("id"))).where(F.col("rank") <= top)
    term = term.join(terms.withColumnRenamed("term", "item"), "id").select("lang", "source", "part", "item", "value", "rank")
    ranked = pair.withColumn("rank", F.row_number().over(order("item"))).unionByName(term)
    return ranked.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT i, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT i) >= {LEAST_DOCUMENTS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(held, 0) AS held FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS held FROM c GROUP BY ALL) USING (lang, source)),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, (1 + {UNIT}::HUGEINT * (coalesce(c.n, 0) + 1) // (g.held + g.v))::BIGINT AS p
  FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
q AS (SELECT lang, term, (1 + {UNIT}::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)))::BIGINT AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms) WHERE rank <= {TOP_TERMS}"""
