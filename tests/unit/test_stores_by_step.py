"""Stores that change step by step equal what is built anew of all they hold."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators.fact_store import FactStore, upsert_stream
from skein.operators.facts import succession
from skein.operators.lexical_store import LexicalStore
from skein.operators.search import Bm25Index
from tests.conftest import rows_of

WORDS = "apple pear plum fig nut oak elm ash yew bay".split()


def text(draw):
    return " ".join(draw.choice(WORDS) for _ in range(draw.randint(0, 9)))


def rebuilt(spark, living, queries):
    docs = spark.createDataFrame(list(living.items()) or [(-1, "")], "id long, text string")
    docs = docs.where("id >= 0")
    return rows_of(Bm25Index.build(docs).search(queries, 5).select("query_id", "id", "score", "rank"))


def test_every_step_of_a_lexical_store_equals_a_rebuild(spark, tmp_path):
    draw = random.Random(11)
    queries = spark.createDataFrame([(1, "apple fig"), (2, "OAK oak nut"), (3, "none"), (4, None)], "query_id long, text string")
    store, living = LexicalStore(spark, str(tmp_path), buckets=3), {}

    def same():
        assert rows_of(store.search(queries, 5).select("query_id", "id", "score", "rank")) == rebuilt(spark, living, queries)

    same()  # an empty store finds nothing
    for step in range(4):
        if step % 3 == 2:
            gone = draw.sample(sorted(living), 4) + [999]
            store.delete(spark.createDataFrame([(x,) for x in [*gone, None, gone[0]]], "id long"))
            living = {k: v for k, v in living.items() if k not in gone}
        else:
            new = {draw.randrange(30): text(draw) for _ in range(8)}
            store.add(spark.createDataFrame([*new.items(), (None, "apple")], "id long, text string"))
            living |= new
        same()
    assert store.compact(most=50) is None
    assert len(store.numbers()) == 4
    store.compact()
    same()
    assert len(store.numbers()) == 1
    store.clear()
    same()
    gone = sorted(living)
    store.delete(spark.createDataFrame([(x,) for x in gone], "id long"))
    living = {}
    same()
    store.add(spark.createDataFrame([(1, None), (2, "apple"), (2, "apple pear")], "id long, text string"))
    living = {1: "", 2: "apple pear"}
    same()


def test_a_writer_that_is_lost_leaves_the_version_before(spark, tmp_path):
    queries = spark.createDataFrame([(1, "apple")], "query_id long, text string")
    store = LexicalStore(spark, str(tmp_path))
    store.add(spark.createDataFrame([(1, "apple")], "id long, text string"))
    before = rows_of(store.search(queries))
    broken = LexicalStore(spark, str(tmp_path))
    broken.manifest.put = lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        broken.add(spark.createDataFrame([(2, "apple apple")], "id long, text string"))
    assert rows_of(store.search(queries)) == before
    store.add(spark.createDataFrame([(3, "apple")], "id long, text string"))
    assert {r.id for r in store.search(queries).collect()} == {1, 3}


FACTS = "fact_id long, scope_key string, valid_at timestamp, note string"


def made_facts(seed, n=60):
    import datetime

    draw = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        scope = draw.choice(["a", "a", "b", "c", None])
        # half seconds, so that some tie within a second and some are equal
        rows.append((i, scope, start + datetime.timedelta(milliseconds=500 * draw.randrange(80)), f"n{i}"))
    return rows


def told(frame):
    return rows_of(frame.select("fact_id", "scope_key", "valid_at", "note", "invalid_at", "status"))


@pytest.mark.parametrize("seed", [1, 2])
def test_facts_in_any_order_end_in_the_batch_succession(spark, tmp_path, seed):
    rows = made_facts(seed)
    random.Random(seed).shuffle(rows)
    store = FactStore(spark, str(tmp_path), buckets=3)
    assert store.read() is None
    for at in range(0, len(rows), 20):
        store.upsert(spark.createDataFrame(rows[at : at + 20], FACTS))
        assert told(store.read()) == told(succession(spark.createDataFrame(rows[: at + 20], FACTS)))
    store.clear()
    assert told(store.read()) == told(succession(spark.createDataFrame(rows, FACTS)))


def test_late_facts_shorten_and_replaced_ones_reopen(spark, tmp_path):
    import datetime

    day = lambda d: datetime.datetime(2024, 1, d)
    store = FactStore(spark, str(tmp_path))
    put = lambda *rows: store.upsert(spark.createDataFrame(list(rows), FACTS))
    state = lambda: {r.fact_id: (r.status, r.invalid_at) for r in store.read().collect()}
    put((1, "s", day(1), "x"))
    assert state() == {1: ("active", None)}
    put((2, "s", day(10), "x"))
    assert state()[1] == ("superseded", day(10))
    put((3, "s", day(5), "late"))
    assert state() == {1: ("superseded", day(5)), 3: ("superseded", day(10)), 2: ("active", None)}
    put((2, "s", day(3), "dated anew"))  # nothing closes the fifth day's fact any more
    assert state() == {1: ("superseded", day(3)), 2: ("superseded", day(5)), 3: ("active", None)}
    put()  # an empty batch
    assert len(state()) == 3


def test_a_stream_takes_each_batch_once(spark, tmp_path):
    rows = made_facts(3, 40)
    for k in range(4):
        spark.createDataFrame(rows[k::4], FACTS).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    store = FactStore(spark, f"{tmp_path}/store", buckets=2)
    stream = spark.readStream.schema(FACTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    upsert_stream(stream, store, f"{tmp_path}/checkpoint").awaitTermination()
    want = told(succession(spark.createDataFrame(rows, FACTS)))
    assert told(store.read()) == want
    store.upsert(spark.createDataFrame(made_facts(9, 5), FACTS), batch=3)  # a number that was taken
    assert told(store.read()) == want
    when = F.lit(1_704_067_210_000_000)
    assert {r.fact_id for r in store.at(when).collect()} <= {r[0] for r in rows}
