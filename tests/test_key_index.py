"""The key index of the fact: which dates a snapshot publish looks into and rewrites."""

from pyspark.sql import functions as F

from strata.contracts import FACT_PARTITION
from strata.operators.upsert import upsert
from strata.plans.scenarios import run_star
from strata.sinks import commits
from strata.sinks.gold import FACT_DIR, KEYS_DIR, key_index, publish_star, read_star, touched_parts
from tests.conftest import SF001


def rows(df):
    return sorted((tuple(r) for r in df.drop("load_timestamp").collect()), key=repr)


def test_a_trip_that_moves_to_another_date_is_found_by_its_hash(spark, work):
    root = f"{work}/star"
    publish_star(spark, run_star(spark, SF001, "run-a"), root, fact_mode="partitions")  # writes the index too
    first = commits.read_commit(spark, root)
    live, indexed = first.parts(FACT_DIR), first.parts(KEYS_DIR)
    assert set(live) == set(indexed) and len(live) > 3
    fact = read_star(spark, root)[FACT_DIR]
    hashes = key_index(spark, root, indexed.values())
    assert hashes.count() == fact.count()
    days = sorted(int(d) for d in live)

    # trips of the first date now fall on the last; one copied, one without a key
    moved = fact.filter(F.col(FACT_PARTITION) == days[0]).orderBy("trip_id").limit(2)
    moved = moved.withColumn(FACT_PARTITION, F.lit(days[-1]).cast(fact.schema[FACT_PARTITION].dataType))
    batch = moved.unionAll(moved.limit(1))
    batch = batch.unionByName(moved.limit(1).withColumn("trip_id", F.lit(None).cast("string")))
    keys = batch.select(FACT_PARTITION, "trip_id").distinct()
    want = touched_parts(spark, root, live, {}, keys)  # by the column itself
    assert touched_parts(spark, root, live, indexed, keys) == want == {str(days[0])}
    some = {d: indexed[d] for d in list(indexed)[::2]}  # some dates of a version without an index
    assert touched_parts(spark, root, live, some, keys) == want
    # the search reads no file of the fact
    assert all(f"/{KEYS_DIR}/" in name for name in hashes.inputFiles())

    full = rows(upsert(fact, batch.select(*fact.columns), "trip_id"))
    star = dict(run_star(spark, SF001, "run-a"))
    publish_star(spark, {**star, FACT_DIR: batch}, root)
    second = commits.read_commit(spark, root)
    assert rows(read_star(spark, root)[FACT_DIR]) == full
    changed = {d for d, where in second.parts(FACT_DIR).items() if live.get(d) != where}
    assert changed == {str(days[0]), str(days[-1])} and set(second.parts(KEYS_DIR)) == set(second.parts(FACT_DIR))
    assert key_index(spark, root, second.parts(KEYS_DIR).values()).count() == len(full)
