"""Matching against a plain loop, alignment with a catalogue, documents merged from a stream against the batch answer."""

import random

import pytest
from pyspark.sql import functions as F

from chronoloom.plans import align as al
from chronoloom.streaming import documents as dc


@pytest.mark.parametrize("seed", range(3))
def test_matching_equals_a_loop_over_the_sorted_list(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(12), f"f{r.randrange(9)}", r.randrange(6) / 10) for _ in range(50)]
    best = {}
    for p, f, s in pairs:
        best[p, f] = max(s, best.get((p, f), 0))
    want, rows, fams = set(), set(), set()
    for s, p, f in sorted((-s, p, f) for (p, f), s in best.items()):
        if p not in rows and f not in fams:
            want.add((p, f, -s))
            rows.add(p)
            fams.add(f)
    got = al.matched(spark.createDataFrame(pairs, "pos int, family_id string, score double"))
    assert {(x.pos, x.family_id, x.score + 0.0) for x in got.collect()} == {(p, f, s + 0.0) for p, f, s in want}


def test_a_batch_meets_a_catalogue(spark):
    none = "cast(null as array<double>)"
    known = spark.createDataFrame([("f1", "Ada Lovelace (poet)", "wrote programs"), ("f2", "ada lovelace", "again"), ("f3", "London", "a city"), ("f4", "Bern", "a city of bears")], "family_id string, name string, content string").selectExpr("*", f"{none} as embedding")
    batch = spark.createDataFrame([(1, "Ada Lovelace", "x"), (2, "London", "y"), (3, "Zürich", "z"), (4, "LONDON (city)", "w")], "pos int, name string, content string").selectExpr("*", f"{none} as name_vector", f"{none} as full_vector")
    told = [("Ada Lovelace", "London", "lived there for many years"), ("ada lovelace", "Bern", "never went there as far as known"), ("Nobody", "Bern", "an end that is not known to us"), ("London", "LONDON (city)", "two names of the same place"), ("Ada Lovelace", "London", "lived there")]
    relations = spark.createDataFrame(told, "name1 string, name2 string, content string")
    versions, links, moves = al.align(batch, relations, known, "2024-01-01")
    rows = {r.pos: (r.family_id, r.is_new) for r in versions.collect()}
    assert rows[1] == ("f1", False) and rows[2] == ("f3", False) and rows[3][1] and rows[4][1]  # one row a family: the exact name has it
    assert {tuple(r) for r in moves.collect()} == {("f2", "f1")}
    got = {(r.fam1, r.fam2): r.content for r in links.collect()}
    assert got[("f1", "f3")] == "lived there for many years" and got[("f1", "f4")].startswith("never went") and len(got) == 3
    again = al.align(batch, relations, known, "2024-01-01")[0]
    assert {r.id for r in again.collect()} == {r.id for r in versions.collect()}
    unsure = batch.limit(1).select(F.lit(9).alias("pos"), F.lit("Lovelace").alias("name"), F.lit("q").alias("content"), "name_vector", "full_vector")
    assert al.align(unsure, relations, known, "2024-01-01")[0].first().is_new
    judged = al.align(unsure, relations, known, "2024-01-01", judge=lambda pairs: pairs)[0].first()
    assert (judged.family_id, judged.is_new) == ("f1", False)


def extraction(seed=2):
    """Rows of ten documents in windows, three of which never end."""
    r = random.Random(seed)
    rows = []
    for d in range(10):
        total = r.randrange(1, 5)
        for w in range(total):
            names = r.sample(["Ada", "Ada (poet)", "Bern", "London", "Zed"], r.randrange(0, 4)) or [None]
            rows += [(f"d{d}", w, 99 if d % 4 == 3 else total, n, f"{n} in {w}" if n else None, f"2024-01-01 00:{d:02d}:{w:02d}") for n in names]
    return rows


SCHEMA = "doc string, window int, total int, name string, content string, at string"


def test_stream_with_replay_and_restart_gives_the_batch_answer(spark, tmp_path):
    rows = extraction()
    by_window = sorted({(d, w) for d, w, *_ in rows})
    random.Random(1).shuffle(by_window)
    parts = [by_window[i::4] for i in range(4)]
    source = str(tmp_path / "in")
    want = {tuple(r) for r in dc.merged_batch(spark.createDataFrame(rows, SCHEMA)).collect()}
    seen = []

    def step(batch, number):
        seen.extend(tuple(r) for r in batch.collect())

    def run():
        stream = dc.merged_documents(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source))
        q = stream.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(300)

    late = [("end", 0, 1, None, None, "2024-01-02 12:00:00"), ("end2", 0, 1, None, None, "2024-01-03 12:00:00")]
    for i, chosen in enumerate([*parts, parts[0]]):  # the first part comes again
        mine = [r for r in rows if (r[0], r[1]) in set(chosen)]
        spark.createDataFrame(mine, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if i in (1, 4):
            run()  # a restart from the checkpoint between the parts
    done = {r for r in seen if r[5] == "complete"}
    assert done == {r for r in want if r[5] == "complete"} and len(done) == len([r for r in seen if r[5] == "complete"])
    for row in late:
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run()
    assert set(seen) == want and len(seen) == len(want)


def test_first_mentions(spark):
    closed = dc.merged_batch(spark.createDataFrame(extraction(), SCHEMA))
    first = {r.core: r.doc for r in dc.first_mentions(closed).collect()}
    assert first == {c: min(r.doc for r in closed.where(F.col("core") == c).collect()) for c in first}
